"""Documents on the wire, fills, files put together."""

import hashlib
import json
from datetime import datetime, timezone

import numpy as np
import pytest

from gneiss.operators import fill
from gneiss.plans import queries
from gneiss.sources import documents
from gneiss.sources.safetensors import Refused

REF = "sha256:" + "ab" * 32


def test_sidecars():
    raw = documents.encode_sidecar("a.b@1+c.d@2", REF)
    assert documents.parse_sidecar(raw) == ("a.b@1+c.d@2", REF)
    for broken in (raw.replace(b"a.b@1+", b""), raw.replace(b"sha256:", b""), raw[:-1] + b',"x":1}', raw + b"{}"):
        with pytest.raises(Refused):
            documents.parse_sidecar(broken)


def test_grants():
    g = {"digest": REF, "size_bytes": 3, "staging_key": "k", "url": "https://h/k", "headers": None, "expires_at": datetime(2024, 1, 2, 3, 4, 5, 600000, timezone.utc)}
    raw = documents.encode_grant(g)
    assert json.loads(raw)["headers"] == {} and json.loads(raw)["expires_at"] == "2024-01-02T03:04:05.6Z" and documents.parse_grant(raw)["expires_at"] == g["expires_at"]
    for broken in (raw.replace(b'"headers":{}', b'"headers":null'), raw.replace(b"6Z", b"6+00:00"), raw.replace(b'"size_bytes":3', b'"size_bytes":-1'), raw[:-1] + b',"more":1}'):
        with pytest.raises(Refused):
            documents.parse_grant(broken)


def test_derived_identities():
    files = [{"path": "a", "size_bytes": 0, "digest": REF}]
    one = documents.derived_digest(files, REF, "m.x@1")
    assert one == documents.derived_digest(files, REF, "m.x@1") != documents.derived_digest(files, REF, "m.x@2")
    with pytest.raises(Refused):
        documents.derived_digest(files, "ab", "m.x@1")


def test_expected_headers(spark):
    doc = {"stamp": "a.b@1+c.d@1", "components": [{"name": "x", "role": "r", "tensors": {"k": {"dtypes": ["F32"], "shape": [2]}}}, {"name": "y", "tensors": {"k": {"dtypes": ["U8"], "shape": [], "optional": True}}}]}
    h = documents.expected_header(spark, json.dumps(doc))
    assert h.count() == 2 and documents.component_of(h, "y").first().optional
    for name in (None, "z"):
        with pytest.raises(KeyError):
            documents.component_of(h, name)


def test_fills(spark):
    x = np.arange(130 * 6, dtype=np.int16)
    raw = fill.gather(x.tobytes(), [130, 6], queries.BLOCKSCALE, 2)
    assert len(raw) == 256 * 8 * 2 and fill.scatter(raw, [130, 6], queries.BLOCKSCALE, 2) == x.tobytes()
    small = np.arange(6, dtype=np.float32)
    rows = [("f", "t", [2, 3], 4, [bytearray(small.tobytes()[:10]), bytearray(small.tobytes()[10:])]), ("f", "short", [2, 3], 4, [bytearray(b"x")]), ("f", "rank", [6], 4, [bytearray(small.tobytes())])]
    df = spark.createDataFrame(rows, "artifact string, name string, shape array<bigint>, item int, chunks array<binary>")
    got = {r.name: (r.bytes, r.padding, r.runs, r.chunks, r.reason) for r in fill.fill(df, queries.TRANSPOSED).collect()}
    assert got == {"t": (24, 0, 6, 2, None), "short": (0, 0, 0, 0, "length"), "rank": (0, 0, 0, 0, "not-ratified")}


def test_files_put_together(spark):
    body = b"hello world"
    chunks = spark.createDataFrame([("a", 1, bytearray(body[5:])), ("a", 0, bytearray(body[:5])), ("b", 0, bytearray(b"x"))], "path string, ord int, content binary")
    files = spark.createDataFrame([("a", hashlib.sha256(body).hexdigest(), 11), ("b", "00", 1), ("c", hashlib.sha256(b"").hexdigest(), 0), ("d", "00", 5)], "path string, digest string, size bigint")
    got = {r.path: (bytes(r.content), r.reason) for r in fill.materialize_files(files, chunks).collect()}
    assert got == {"a": (body, None), "b": (b"x", "digest"), "c": (b"", None), "d": (b"", "size")}
