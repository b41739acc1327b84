"""Containers and codecs: round trips, refusals, plans."""

import hashlib
import struct

import numpy as np
import pytest

from gneiss.sources import codecs, containers, gguf, safetensors
from gneiss.sources.safetensors import Refused


def tensors():
    rng = np.random.default_rng(0)
    bodies = [rng.bytes(n) for n in (4 * 12, 2 * 6, 0, 8 * 3)]
    kinds = [("a", "F32", [3, 4]), ("b", "BF16", [6]), ("empty", "F32", [0, 4]), ("c", "I64", [3])]
    return [{"name": n, "dtype": d, "shape": s, "length": len(b), "data": b} for (n, d, s), b in zip(kinds, bodies)]


def safe(ts=None):
    ts = ts or tensors()
    return safetensors.write_header(ts, {"format": "pt"}) + b"".join(t["data"] for t in ts)


def block_file():
    ts = [{"name": "x", "dtype": "F32", "shape": [2, 5], "data": bytes(40)}, {"name": "q", "dtype": "Q8_0", "shape": [2, 32], "data": bytes(68)}]
    meta = {b"general.architecture": (8, b"llama"), b"general.alignment": (4, 64), b"t.list": (9, (8, [b"a", b"bc"])), b"t.numbers": (9, (5, [1, -2]))}
    return gguf.write(meta, ts, 64)


def test_safetensors_round_trip_and_plan():
    raw = safe()
    start, got = safetensors.parse_header(raw)
    assert {t["name"]: (t["dtype"], t["shape"], raw[t["offset"] : t["offset"] + t["length"]]) for t in got} == {t["name"]: (t["dtype"], t["shape"], t["data"]) for t in tensors()}
    regions = containers.plan(raw, 10)
    assert regions[0][2] == "header" and sum(n for _, n, _ in regions) == len(raw)
    assert all(a + n == b for (a, n, _), (b, *_) in zip(regions, regions[1:]))
    assert [n for o, n, k in regions if k == "tensor"] == [10, 10, 10, 10, 8, 10, 2, 10, 10, 4]
    assert start % 8 == 0


@pytest.mark.parametrize(
    "raw, reason",
    [
        (b"", "short"), (struct.pack("<Q", 1 << 40) + b"{}", "header-length"), (struct.pack("<Q", 2) + b"[]", "header-start"), (safe() + b"x", "coverage"),
        (struct.pack("<Q", 66) + b'{"a":{"dtype":"F32","shape":[1],"data_offsets":[0,4]},"a":{"dtype":"', "json"), (safe().replace(b'"F32"', b'"F99"', 1), "dtype"),
        (struct.pack("<Q", 56) + b'{"a":{"dtype":"F32","shape":[2],"data_offsets":[0,4]}}  ' + bytes(4), "extent"),
    ],
)
def test_safetensors_refusals(raw, reason):
    with pytest.raises(Refused, match=reason):
        safetensors.parse_header(raw)
    assert containers.plan(raw) == ([(0, len(raw), "blob")] if raw else [])


def test_gguf_round_trip_and_plan():
    raw = block_file()
    h = gguf.parse_header(raw)
    assert [(t["name"], t["dtype"], t["shape"], t["length"]) for t in h["tensors"]] == [("x", "F32", [2, 5], 40), ("q", "Q8_0", [2, 32], 68)]
    assert h["alignment"] == 64 and h["metadata"][b"t.list"][1] == [b"a", b"bc"] and h["metadata"][b"t.numbers"][1] == (1, -2)
    regions = containers.plan(raw)
    assert [k for *_, k in regions] == ["metadata", "directory", "padding", "tensor", "padding", "tensor", "padding"]
    assert regions[-1][0] + regions[-1][1] == len(raw)
    for broken in (raw[:-1], raw + b"\0", b"GGUG" + raw[4:], raw[:4] + b"\1\0\0\0" + raw[8:]):
        with pytest.raises(Refused):
            gguf.parse_header(broken)


def test_files_as_rows(spark, tmp_path):
    (tmp_path / "a.safetensors").write_bytes(safe())
    (tmp_path / "b.gguf").write_bytes(block_file())
    (tmp_path / "c.json").write_bytes(b'{"just": "text"}')
    files = containers.binary_files(spark, f"file://{tmp_path}")
    rows = containers.tensor_headers(files).collect()
    assert sorted((r.format or "", r.name or "") for r in rows) == [("", ""), ("gguf", "q"), ("gguf", "x"), *(("safetensors", n) for n in ("a", "b", "c", "empty"))]
    assert containers.plan_files(files).groupBy("path").sum("length").count() == 3
    spark.dataSource.register(containers.TensorHeaders)
    got = spark.read.format("tensor_headers").load(f"{tmp_path}/*.safetensors").collect()
    assert {(r.name, tuple(r.shape)) for r in got} == {(t["name"], tuple(t["shape"])) for t in tensors()}


def test_packs(spark, tmp_path):
    objects = [b"one", b"two two", b"3" * 1000]
    raw = codecs.encode_pack(objects)
    assert {d: raw[o : o + n] for d, o, n in codecs.decode_pack(raw)} == {hashlib.sha256(o).hexdigest(): o for o in objects}
    for broken, why in ((raw[:-1], "truncated"), (raw + b"x", "trailing-bytes"), (raw[:4] + bytes(8) + raw[12:], "zero-objects"), (b"XXXX" + raw[4:], "bad-magic"), (raw[:-1] + b"x", "digest-mismatch")):
        with pytest.raises(Refused, match=why):
            codecs.decode_pack(broken)
    (tmp_path / "p").write_bytes(raw)
    (tmp_path / "q").write_bytes(raw[:-1])
    rows = containers.unpack(containers.binary_files(spark, f"file://{tmp_path}")).collect()
    assert sum(r.reason is None for r in rows) == 3 and [r.reason for r in rows if r.reason] == ["truncated"]


def tree():
    d = hashlib.sha256(b"x").hexdigest()
    return {
        "parent": d,
        "entries": [
            {"path": "dir", "kind": "directory"}, {"path": "dir/blob", "kind": "file", "executable": True, "planner": "blob", "size": 1, "digest": d},
            {"path": "dir/model", "kind": "file", "executable": False, "planner": "safetensors", "size": 30, "contract": "maker.layout@3", "records": [(d, 10), (None, 20)]},
            {"path": "empty", "kind": "file", "executable": False, "planner": "blob", "size": 0, "digest": codecs.EMPTY.hex()}, {"path": "link", "kind": "symlink", "target": "dir/blob"}, {"path": "other", "kind": "hardlink", "ordinal": 1},
        ],
    }


def test_trees(spark, tmp_path):
    raw = codecs.encode_tree(tree())
    got = codecs.decode_tree(raw)
    assert codecs.encode_tree(got) == raw and [e["path"] for e in got["entries"]] == [e["path"] for e in tree()["entries"]]
    assert hashlib.sha256(codecs.TREE_MAGIC + bytes(9)).hexdigest().startswith("e67d41aa") and codecs.decode_tree(codecs.TREE_MAGIC + bytes(9)) == {"parent": None, "entries": []}
    for change, why in (
        (lambda e: e.update(path="dir/CON.txt"), "path-windows-reserved"), (lambda e: e.update(path="DIR"), "case-fold-collision"), (lambda e: e.update(path="no/blob"), "missing-parent"), (lambda e: e.update(path="dir/é"), "path-not-nfc"),
    ):
        t = tree()
        change(t["entries"][1])
        with pytest.raises(Refused, match=why):
            codecs.encode_tree(t)
    t = tree()
    t["entries"][2]["records"] = [(None, 10), (None, 20)]
    with pytest.raises(Refused, match="adjacent-holes"):
        codecs.encode_tree(t)
    (tmp_path / "t").write_bytes(raw)
    rows = containers.tree_entries(containers.binary_files(spark, f"file://{tmp_path}")).collect()
    assert len(rows) == 6 and {r.snapshot for r in rows} == {hashlib.sha256(raw).hexdigest()}


def test_stubs_and_manifests():
    h = hashlib.sha256(b"").hexdigest()
    for size in (0, 1, (1 << 64) - 1):
        assert codecs.parse_stub(codecs.encode_stub(h, size)) == (h, size)
    for other in (b"", codecs.encode_stub(h, 5)[:-1], codecs.encode_stub(h, 5) + b"\n", codecs.encode_stub(h, 1 << 64)):
        assert codecs.parse_stub(other) is None
    files = [{"path": "b", "size_bytes": 3, "digest": "sha256:" + h, "chunks": [{"digest": "sha256:" + h, "len": 1}, {"digest": "sha256:" + h, "len": 2}]}, {"path": "a", "size_bytes": 0, "digest": "sha256:" + h}]
    raw = codecs.encode_manifest(files)
    assert [f["path"] for f in codecs.decode_manifest(raw.decode())] == ["a", "b"]
    for broken in (raw.replace(b'"a"', b'"B"'), raw.replace(b'"len":2', b'"len":3'), raw.replace(b'"format":1', b'"format":1,"format":1'), raw + b"{}", raw.replace(b'"a"', b'"../a"')):
        with pytest.raises(Refused):
            codecs.decode_manifest(broken.decode())
