"""Small JSON documents on the wire: stamps beside manifests, upload grants, computed headers, derived identities."""

from __future__ import annotations

import hashlib
import json
import re
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from gneiss.functions.idents import DEFAULT_ARRANGEMENT
from gneiss.sources.codecs import NAME, encode_manifest
from gneiss.sources.safetensors import Refused, strict_json

STAMP_FORMAT, DERIVED_FORMAT = bytes.fromhex("74656e736f7266732d7374616d702d7632").decode(), bytes.fromhex("74656e736f7266732d646572697665642d7632").decode()
REF = re.compile("sha256:[0-9a-f]{64}")


def is_handle(text: str) -> bool:
    name, at, version = text.partition("@")
    return bool(at and NAME.fullmatch(name) and len(name) <= 64 and re.fullmatch("[0-9]+", version) and 0 < int(version) < 1 << 32)


def parse_stamp(text: str) -> tuple[str, str, str]:
    """Topology, quant and arrangement of a stamp's text; the default arrangement has no text."""
    parts = text.split("+")
    if len(parts) not in (2, 3) or not all(map(is_handle, parts)) or parts[2:] == [DEFAULT_ARRANGEMENT]:
        raise Refused("stamp")
    return parts[0], parts[1], parts[2] if len(parts) == 3 else DEFAULT_ARRANGEMENT


def encode_sidecar(stamp: str, manifest: str) -> bytes:
    """The stamp of the tree that a manifest's reference names."""
    parse_stamp(stamp)
    if not REF.fullmatch(manifest):
        raise Refused("manifest")
    return json.dumps({"format": STAMP_FORMAT, "stamp": stamp, "manifest": manifest}, separators=(",", ":"), ensure_ascii=False).encode()


def parse_sidecar(content: bytes) -> tuple[str, str]:
    """Stamp and manifest."""
    d = strict_json(content)
    if not isinstance(d, dict) or set(d) != {"format", "stamp", "manifest"} or d["format"] != STAMP_FORMAT or not all(isinstance(x, str) for x in d.values()):
        raise Refused("sidecar")
    encode_sidecar(d["stamp"], d["manifest"])
    return d["stamp"], d["manifest"]


GRANT = ("digest", "size_bytes", "staging_key", "url", "headers", "expires_at")


def encode_grant(grant: dict) -> bytes:
    """A grant for the wire: headers never null, the expiry in UTC."""
    g = {**grant, "headers": grant.get("headers") or {}}
    at = g["expires_at"].astimezone(timezone.utc)
    text = at.strftime("%Y-%m-%dT%H:%M:%S") + (f".{at.microsecond:06d}".rstrip("0") if at.microsecond else "") + "Z"
    out = json.dumps({**{k: g[k] for k in GRANT[:5]}, "expires_at": text}, separators=(",", ":"), ensure_ascii=False).encode()
    parse_grant(out)
    return out


def parse_grant(content: bytes) -> dict:
    d = strict_json(content)
    if not isinstance(d, dict) or set(d) != set(GRANT):
        raise Refused("grant")
    if not isinstance(d["digest"], str) or not REF.fullmatch(d["digest"]) or isinstance(d["size_bytes"], bool) or not isinstance(d["size_bytes"], int) or d["size_bytes"] < 0:
        raise Refused("object")
    if any(not isinstance(d[k], str) or not d[k].strip() for k in ("staging_key", "url")):
        raise Refused("target")
    if not isinstance(d["headers"], dict) or not all(isinstance(v, str) for v in d["headers"].values()):
        raise Refused("headers")
    m = re.fullmatch(r"(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d)(?:\.(\d{1,9}))?Z", d["expires_at"]) if isinstance(d["expires_at"], str) else None
    if not m:
        raise Refused("expiry")
    return {**d, "expires_at": datetime.fromisoformat(m[1]).replace(microsecond=int((m[2] or "").ljust(6, "0")[:6] or 0), tzinfo=timezone.utc)}


def derived_digest(files: list[dict], source: str, morphism: str) -> str:
    """The identity of a tree that is derived from a source and may never be stored."""
    if not REF.fullmatch(source) or not morphism:
        raise Refused("derivation")
    preamble = f"{DERIVED_FORMAT}\nmorphism={morphism}\nsource={source}\n"
    return hashlib.sha256(preamble.encode() + encode_manifest(files)).hexdigest()


def expected_header(spark: SparkSession, text: str) -> DataFrame:
    """(stamp, component, role, key, dtypes, shape, optional) of a computed header's document."""
    d = strict_json(text)
    rows = [(d["stamp"], c["name"], c.get("role") or "", k, t["dtypes"], t["shape"], bool(t.get("optional"))) for c in d["components"] for k, t in sorted(c["tensors"].items())]
    return spark.createDataFrame(rows, "stamp string, component string, role string, key string, dtypes array<string>, shape array<bigint>, optional boolean")


def component_of(header: DataFrame, name: str | None = None) -> DataFrame:
    """One component of a header; without a name only if it has just one."""
    names = sorted(r[0] for r in header.select("component").distinct().collect())
    if name is None and len(names) != 1:
        raise KeyError(f"name one of {', '.join(names)}")
    if name is not None and name not in names:
        raise KeyError(f"no component {name!r}; there are {', '.join(names)}")
    return header.where(header["component"] == (name or names[0]))
