"""Headers of GGUF containers: strict parsing of versions 2 and 3, byte domains, and writing."""

from __future__ import annotations

import re
import struct

from gneiss.functions.dtypes import BLOCKS
from gneiss.sources.safetensors import Refused

MAGIC = b"GGUF"
SCALARS = {0: "B", 1: "b", 2: "H", 3: "h", 4: "I", 5: "i", 6: "f", 7: "?", 10: "Q", 11: "q", 12: "d"}
STRING, ARRAY = 8, 9
KEY = re.compile(rb"[a-z0-9_]+(\.[a-z0-9_]+)*")
MOST_KEYS, MOST_TENSORS, MOST_SYMBOLS, MOST_NAME, MOST_KEY = 100_000, 1_000_000, 64 << 20, 63, 65_535


class Reader:
    """A cursor over bytes that refuses to run past their end."""

    def __init__(self, content: bytes):
        self.content, self.at, self.symbols = content, 0, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.content):
            raise Refused("truncated")
        self.at += n
        return self.content[self.at - n : self.at]

    def number(self, kind: str) -> int | float:
        return struct.unpack("<" + kind, self.take(struct.calcsize("<" + kind)))[0]

    def text(self, most: int) -> bytes:
        n = int(self.number("Q"))
        self.symbols += n
        if n > most or self.symbols > MOST_SYMBOLS:
            raise Refused("resource")
        return self.take(n)

    def value(self, kind: int, depth: int = 0) -> object:
        if kind in SCALARS:
            if kind == 7:
                b = self.take(1)
                if b not in (b"\0", b"\1"):
                    raise Refused("boolean")
                return b == b"\1"
            return self.number(SCALARS[kind])
        if kind == STRING:
            return self.text(MOST_SYMBOLS)
        if kind == ARRAY:
            inner, n = int(self.number("I")), int(self.number("Q"))
            if depth >= 8 or n > len(self.content):
                raise Refused("array")
            if inner in SCALARS and inner != 7:
                raw = self.take(n * struct.calcsize("<" + SCALARS[inner]))
                return struct.unpack(f"<{n}{SCALARS[inner]}", raw)
            return [self.value(inner, depth + 1) for _ in range(n)]
        raise Refused("value-type")


def parse_header(content: bytes) -> dict:
    """metadata (key to type and value), alignment, the ends of the three header domains, and tensors (name, dtype, shape in
    logical row-major order, offset into the file, length) in the directory's order."""
    r = Reader(content)
    if r.take(4) != MAGIC:
        raise Refused("magic")
    if r.number("I") not in (2, 3):
        raise Refused("version")
    n_tensors, n_keys = int(r.number("Q")), int(r.number("Q"))
    if n_tensors > MOST_TENSORS or n_keys > MOST_KEYS:
        raise Refused("resource")
    metadata: dict[bytes, tuple[int, object]] = {}
    for _ in range(n_keys):
        key = r.text(MOST_KEY)
        if not KEY.fullmatch(key):
            raise Refused("key")
        if key in metadata:
            raise Refused("duplicate-key")
        kind = int(r.number("I"))
        metadata[key] = (kind, r.value(kind))
    alignment = 32
    if b"general.alignment" in metadata:
        kind, value = metadata[b"general.alignment"]
        if kind != 4 or not isinstance(value, int) or value < 8 or value & (value - 1):
            raise Refused("alignment")
        alignment = value
    directory = r.at
    tensors, names, expected = [], set(), 0
    for _ in range(n_tensors):
        name = r.text(MOST_NAME)
        if not name or name in names:
            raise Refused("name")
        names.add(name)
        rank = int(r.number("I"))
        if not 1 <= rank <= 4:
            raise Refused("rank")
        dims = [int(r.number("Q")) for _ in range(rank)]
        kind, offset = int(r.number("I")), int(r.number("Q"))
        if kind not in BLOCKS:
            raise Refused("type")
        dtype, elements, size = BLOCKS[kind]
        total = 1
        for d in dims:
            if d == 0:
                raise Refused("dimension")
            total *= d
        if dims[0] % elements or total >= 1 << 63:
            raise Refused("block")
        if offset != expected:
            raise Refused("offset")
        length = total // elements * size
        expected = -(-(offset + length) // alignment) * alignment
        try:
            text = name.decode()
        except UnicodeDecodeError as e:
            raise Refused("name") from e
        tensors.append({"name": text, "dtype": dtype, "shape": dims[::-1], "offset": offset, "length": length})
    start = -(-r.at // alignment) * alignment
    if len(content) != start + expected:
        raise Refused("size")
    for t in tensors:
        t["offset"] += start
    return {"metadata": metadata, "alignment": alignment, "directory_start": directory, "directory_end": r.at, "data_start": start, "tensors": tensors}


def _value(kind: int, value: object) -> bytes:
    if kind in SCALARS:
        return struct.pack("<" + SCALARS[kind], value)
    if kind == STRING:
        return struct.pack("<Q", len(value)) + value
    inner, items = value
    return struct.pack("<IQ", inner, len(items)) + b"".join(_value(inner, x) for x in items)


def write(metadata: dict[bytes, tuple[int, object]], tensors: list[dict], alignment: int = 32, version: int = 3) -> bytes:
    """A whole file of tensors (name, dtype, shape, data); arrays in the metadata are (type, items)."""
    ids = {name: k for k, (name, *_) in BLOCKS.items()}
    out = MAGIC + struct.pack("<IQQ", version, len(tensors), len(metadata))
    for key, (kind, value) in metadata.items():
        out += struct.pack("<Q", len(key)) + key + struct.pack("<I", kind) + _value(kind, value)
    at, data = 0, b""
    for t in tensors:
        name = t["name"].encode()
        out += struct.pack("<Q", len(name)) + name + struct.pack("<I", len(t["shape"])) + b"".join(struct.pack("<Q", d) for d in reversed(t["shape"])) + struct.pack("<IQ", ids[t["dtype"]], at)
        body = t["data"] + b"\0" * (-len(t["data"]) % alignment)
        data, at = data + body, at + len(body)
    return out + b"\0" * (-len(out) % alignment) + data
