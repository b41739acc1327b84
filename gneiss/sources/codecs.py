"""Binary and JSON documents of the store: upload packs, tree snapshots, pointer stubs, repository manifests.

Decoders refuse with a short reason; what they accept, the encoders give back byte for byte.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata

from gneiss.sources.safetensors import Refused, strict_json

PACK_MAGIC, TREE_MAGIC, STUB_MAGIC = bytes.fromhex("54465031"), bytes.fromhex("54464d31"), bytes.fromhex("5446535354554231")
STUB_READER = bytes.fromhex("74656e736f726673").decode()
MOST_OBJECT, MOST_COUNT = 64 << 20, 1_000_000
EMPTY = hashlib.sha256(b"").digest()


# ---- packs


def encode_pack(objects: list[bytes]) -> bytes:
    """Whole objects, in the order of their digests."""
    rows = sorted((hashlib.sha256(o).digest(), o) for o in objects)
    index, at = b"", 0
    for d, o in rows:
        index += d + struct.pack("<QQ", at, len(o))
        at += len(o)
    out = PACK_MAGIC + struct.pack("<Q", len(rows)) + index + b"".join(o for _, o in rows)
    decode_pack(out)
    return out


def decode_pack(content: bytes, verify: bool = True) -> list[tuple[str, int, int]]:
    """(digest, offset into the pack, length) of the objects."""
    if len(content) < 12:
        raise Refused("bad-magic" if content[:4] != PACK_MAGIC[: len(content[:4])] else "truncated")
    if content[:4] != PACK_MAGIC:
        raise Refused("bad-magic")
    (n,) = struct.unpack_from("<Q", content, 4)
    if n == 0:
        raise Refused("zero-objects")
    if n > MOST_COUNT:
        raise Refused("object-limit")
    start = 12 + 48 * n
    if start > len(content):
        raise Refused("count-exceeds-input")
    out, at, last = [], 0, b""
    for i in range(n):
        row = content[12 + 48 * i : 60 + 48 * i]
        digest, (offset, length) = row[:32], struct.unpack("<QQ", row[32:])
        if digest == last:
            raise Refused("duplicate-digest")
        if digest < last:
            raise Refused("index-order")
        if length == 0:
            raise Refused("zero-length-object")
        if length > MOST_OBJECT:
            raise Refused("object-too-large")
        if offset != at:
            raise Refused("offset-mismatch")
        last, at = digest, at + length
        if at > MOST_OBJECT:
            raise Refused("payload-too-large")
        out.append((digest.hex(), start + offset, length))
    if start + at > len(content):
        raise Refused("truncated")
    if start + at < len(content):
        raise Refused("trailing-bytes")
    if verify:
        for digest, offset, length in out:
            if hashlib.sha256(content[offset : offset + length]).hexdigest() != digest:
                raise Refused("digest-mismatch")
    return out


# ---- stubs


def encode_stub(body: str, size: int) -> bytes:
    """The one line that stands for a file whose body is named so."""
    return STUB_MAGIC + f' {{"body_sha256":"{body}","size":{size},"read":"{STUB_READER}"}}\n'.encode()


_STUB = re.compile(re.escape(STUB_MAGIC) + rb' \{"body_sha256":"([0-9a-f]{64})","size":(0|[1-9][0-9]{0,19}),"read":"' + STUB_READER.encode() + rb'"\}\n')


def parse_stub(content: bytes) -> tuple[str, int] | None:
    """Name and size, or None: whatever isn't a stub to the letter is a file."""
    m = _STUB.fullmatch(content)
    return (m[1].decode(), int(m[2])) if m and int(m[2]) < 1 << 64 else None


# ---- trees

NAME = re.compile(r"[a-z0-9][a-z0-9-]*\.[a-z0-9][a-z0-9._-]*")
DEVICE = re.compile(r"(con|prn|aux|nul|com[1-9¹²³]|lpt[1-9¹²³])(\..*)?", re.I)
PLANNERS = {1: "safetensors", 2: "gguf", 4: "blob"}


def path_refusal(raw: bytes) -> str | None:
    """Why a tree's path is refused."""
    if not 1 <= len(raw) <= 4096:
        return "path-length"
    try:
        path = raw.decode()
    except UnicodeDecodeError:
        return "path-utf8"
    if not unicodedata.is_normalized("NFC", path):
        return "path-not-nfc"
    if path.startswith("/"):
        return "path-absolute"
    for c in path:
        if unicodedata.category(c) == "Cc" or c in '\\:*?"<>|':
            return "path-forbidden-character"
    for s in path.split("/"):
        if s == "":
            return "path-empty-segment"
        if s in (".", ".."):
            return "path-dot-segment"
        if s[-1] in ". ":
            return "path-trailing-dot-space"
        if DEVICE.fullmatch(s):
            return "path-windows-reserved"
    return None


class _Cursor:
    def __init__(self, content: bytes):
        self.content, self.at = content, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.content):
            raise Refused("truncated")
        self.at += n
        return self.content[self.at - n : self.at]

    def number(self, kind: str) -> int:
        return struct.unpack("<" + kind, self.take(struct.calcsize("<" + kind)))[0]


def decode_tree(content: bytes) -> dict:
    """parent and entries (path, kind, and by kind: executable, planner, size, contract, records, digest, target, ordinal)."""
    c = _Cursor(content)
    if c.take(min(4, len(content))) != TREE_MAGIC:
        raise Refused("bad-magic")
    flag = c.number("B")
    if flag > 1:
        raise Refused("parent-flag")
    parent = c.take(32).hex() if flag else None
    n = c.number("Q")
    if n > (len(content) - c.at) // 6:
        raise Refused("count-exceeds-input")
    entries: list[dict] = []
    last, folded, directories, files = b"", set(), set(), 0
    for _ in range(n):
        raw = c.take(length) if 1 <= (length := c.number("I")) <= 4096 else None
        if raw is None:
            raise Refused("path-length")
        if why := path_refusal(raw):
            raise Refused(why)
        if entries and raw == last:
            raise Refused("duplicate-path")
        if entries and raw < last:
            raise Refused("entry-order")
        path = raw.decode()
        low = path.lower()
        if low in folded:
            raise Refused("case-fold-collision")
        if "/" in path and path.rsplit("/", 1)[0] not in directories:
            raise Refused("missing-parent-directory")
        folded.add(low)
        last = raw
        kind = c.number("B")
        e: dict = {"path": path, "kind": {1: "directory", 2: "file", 3: "symlink", 4: "hardlink"}.get(kind)}
        if kind == 1:
            directories.add(path)
        elif kind == 2:
            e["executable"] = c.number("B")
            if e["executable"] > 1:
                raise Refused("executable-flag")
            e["executable"] = bool(e["executable"])
            planner = c.number("B")
            if planner not in PLANNERS:
                raise Refused("unknown-planner")
            e["planner"] = PLANNERS[planner]
            e["size"] = c.number("Q")
            if planner == 4:
                e["digest"] = (digest := c.take(32)).hex()
                if (e["size"] == 0) != (digest == EMPTY):
                    raise Refused("empty-blob-digest")
            else:
                e["contract"] = _contract(c)
                e["records"] = _records(c, e["size"])
            files += 1
        elif kind == 3:
            length = c.number("I")
            if not 1 <= length <= 4096:
                raise Refused("symlink-target")
            try:
                e["target"] = c.take(length).decode()
            except UnicodeDecodeError as x:
                raise Refused("symlink-target") from x
            if any(unicodedata.category(x) == "Cc" for x in e["target"]):
                raise Refused("symlink-target")
        elif kind == 4:
            e["ordinal"] = c.number("Q")
            if e["ordinal"] >= files:
                raise Refused("hardlink-ordinal")
        else:
            raise Refused("unknown-entry-kind")
        entries.append(e)
    if c.at != len(content):
        raise Refused("trailing-bytes")
    return {"parent": parent, "entries": entries}


def _contract(c: _Cursor) -> str | None:
    n = c.number("B")
    if n == 0xFF:
        return "sha256:" + c.take(32).hex()
    if n > 64:
        raise Refused("contract-name")
    raw, version = c.take(n), c.number("I")
    if (n == 0) != (version == 0):
        raise Refused("contract-version")
    if n == 0:
        return None
    try:
        name = raw.decode("ascii")
    except UnicodeDecodeError as e:
        raise Refused("contract-name") from e
    if not NAME.fullmatch(name):
        raise Refused("contract-name")
    return f"{name}@{version}"


def _records(c: _Cursor, size: int) -> list[tuple[str | None, int]]:
    n = c.number("Q")
    if n > MOST_COUNT:
        raise Refused("record-limit")
    if n > (len(c.content) - c.at) // 9:
        raise Refused("truncated")
    out: list[tuple[str | None, int]] = []
    total = 0
    for _ in range(n):
        tag = c.number("B")
        if tag not in (1, 2):
            raise Refused("unknown-record-tag")
        digest = c.take(32).hex() if tag == 1 else None
        length = c.number("Q")
        if length == 0:
            raise Refused("zero-length-record")
        if digest is not None and length > MOST_OBJECT:
            raise Refused("data-too-large")
        if digest is None and out and out[-1][0] is None:
            raise Refused("adjacent-holes")
        total += length
        if total >= 1 << 64:
            raise Refused("length-sum-mismatch")
        out.append((digest, length))
    if total != size:
        raise Refused("length-sum-mismatch")
    return out


def encode_tree(tree: dict) -> bytes:
    """The one encoding of a tree; entries may come in any order."""
    out = TREE_MAGIC + (b"\1" + bytes.fromhex(tree["parent"]) if tree.get("parent") else b"\0")
    entries = sorted(tree["entries"], key=lambda e: e["path"].encode())
    out += struct.pack("<Q", len(entries))
    for e in entries:
        raw = e["path"].encode()
        out += struct.pack("<I", len(raw)) + raw
        if e["kind"] == "directory":
            out += b"\1"
        elif e["kind"] == "file":
            out += b"\2" + bytes([e["executable"]]) + encode_body(e)
        elif e["kind"] == "symlink":
            target = e["target"].encode()
            out += b"\3" + struct.pack("<I", len(target)) + target
        else:
            out += b"\4" + struct.pack("<Q", e["ordinal"])
    decode_tree(out)
    return out


def encode_body(e: dict) -> bytes:
    """A file's planner and body, whose SHA-256 names the body."""
    planner = {v: k for k, v in PLANNERS.items()}[e["planner"]]
    out = bytes([planner]) + struct.pack("<Q", e["size"])
    if planner == 4:
        return out + bytes.fromhex(e["digest"])
    stamp = e.get("contract")
    if stamp is None:
        out += b"\0" + struct.pack("<I", 0)
    elif stamp.startswith("sha256:"):
        out += b"\xff" + bytes.fromhex(stamp[7:])
    else:
        name, version = stamp.rsplit("@", 1)
        out += bytes([len(name)]) + name.encode() + struct.pack("<I", int(version))
    out += struct.pack("<Q", len(e["records"]))
    for digest, length in e["records"]:
        out += (b"\2" if digest is None else b"\1" + bytes.fromhex(digest)) + struct.pack("<Q", length)
    return out


# ---- repository manifests


def decode_manifest(text: str) -> list[dict]:
    """Files (path, size_bytes, digest, chunks) of a manifest."""
    doc = strict_json(text)
    if not isinstance(doc, dict) or not {"format", "files"} <= set(doc) <= {"format", "files", "derived_from"} or doc["format"] != 1 or isinstance(doc["format"], bool) or not isinstance(doc["files"], list):
        raise Refused("manifest")
    whole = lambda x: isinstance(x, int) and not isinstance(x, bool) and 0 <= x < 1 << 63
    is_ref = lambda x: isinstance(x, str) and re.fullmatch("sha256:[0-9a-f]{64}", x)
    last, folded = "", set()
    for f in doc["files"]:
        if not isinstance(f, dict) or not {"path", "size_bytes", "digest"} <= set(f) <= {"path", "size_bytes", "digest", "chunks"}:
            raise Refused("file")
        if not isinstance(f["path"], str) or not f["path"] or f["path"].startswith("/") or "\\" in f["path"] or any(ord(c) < 32 or ord(c) == 127 for c in f["path"]) or any(s in ("", ".", "..") for s in f["path"].split("/")):
            raise Refused("path")
        if not whole(f["size_bytes"]) or not is_ref(f["digest"]):
            raise Refused("file")
        if "chunks" in f:
            if not isinstance(f["chunks"], list) or not all(isinstance(c, dict) and set(c) == {"digest", "len"} and is_ref(c["digest"]) and whole(c["len"]) and 1 <= c["len"] <= MOST_OBJECT for c in f["chunks"]):
                raise Refused("chunk")
            if not f["chunks"] or sum(c["len"] for c in f["chunks"]) != f["size_bytes"]:
                raise Refused("chunk-sum")
            if len(f["chunks"]) == 1 and f["chunks"][0]["digest"] != f["digest"]:
                raise Refused("chunk-digest")
        low = "".join(c.lower() if c.isascii() else c for c in f["path"])
        if low in folded:
            raise Refused("path-collision")
        if f["path"].encode() < last.encode():
            raise Refused("order")
        folded.add(low)
        last = f["path"]
    return doc["files"]


def encode_manifest(files: list[dict]) -> bytes:
    """The canonical bytes: files by path, no white space, the two line separators escaped."""
    rows = []
    for f in sorted(files, key=lambda f: f["path"].encode()):
        row = {"path": f["path"], "size_bytes": f["size_bytes"], "digest": f["digest"]}
        if f.get("chunks"):
            row["chunks"] = [{"digest": c["digest"], "len": c["len"]} for c in f["chunks"]]
        rows.append(row)
    text = json.dumps({"format": 1, "files": rows}, separators=(",", ":"), ensure_ascii=False)
    return text.replace("\u2028", "\\u2028").replace("\u2029", "\\u2029").encode()
