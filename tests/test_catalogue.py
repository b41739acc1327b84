"""Catalogue documents, seam contracts, writing and workspaces."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from gneiss.operators import adapters, decide, workspace, writer
from gneiss.plans import queries
from gneiss.sources import catalog, safetensors
from gneiss.sources.safetensors import Refused

T1 = {"format": "t", "name": "x.split", "version": 1, "dtype": "BF16", "components": [{"name": "dit", "role": "denoiser", "islands": {"n": "F32"}, "tensors": {"b.0.q": [16, 16], "b.0.k": [16, 16], "b.0.v": [32, 16], "n": [4]}}]}
T2 = {"format": "t", "name": "x.fused", "version": 1, "dtype": "BF16", "components": [{"name": "dit", "role": "denoiser", "tensors": {"b.0.qkv": [64, 16], "m": [4]}}]}
M = {"format": "m", "name": "x.fuse", "version": 1, "from": "x.split@1", "to": "x.fused@1", "tier": 2, "invertible": True, "rekey": [{"from_key": "n", "to_key": "m"}], "seams": [{"target": "b.{i}.qkv", "groups": 1, "parts": [{"role": r, "share": s, "key": f"b.{{i}}.{r}"} for r, s in (("q", 1), ("k", 1), ("v", 2))]}]}
PLAIN = {"format": "r", "name": "plain.bf16", "version": 1, "base_dtype": "BF16", "reference_tolerant": True}
DOCS = [T1, T2, M, PLAIN, {**queries.RULE, "format": "r"}]


def test_identities():
    assert catalog.canonical(T1) == "t\nname=x.split\nversion=1\ndtype=BF16\ncomponent name=dit role=denoiser\ntensor b.0.k=[16,16]\ntensor b.0.q=[16,16]\ntensor b.0.v=[32,16]\ntensor n=[4]\nisland n=F32\n"
    assert "eligible dtypes=F32,BF16 rank=2 rank>=0 suffix=.weight align=[16 16] block=true" in catalog.canonical({**queries.RULE, "format": "r"})
    assert catalog.refusal({**T1, "digest": catalog.digest(T1)}) is None and catalog.refusal({**T1, "digest": "0"}) == "digest"
    assert catalog.digest({**M, "provenance": ["said so"]}) == catalog.digest(M)


def test_catalogue_from_files(spark, tmp_path):
    for n, d in enumerate(DOCS):
        (tmp_path / f"{n}.json").write_text(json.dumps({**d, "digest": catalog.digest(d)}))
    docs = catalog.load(spark, str(tmp_path))
    assert len(docs) == 5 and catalog.unproved(spark, docs) == []
    wrong = {**M, "seams": [{**M["seams"][0], "parts": M["seams"][0]["parts"][:2]}]}
    assert catalog.unproved(spark, [T1, T2, wrong]) == ["x.fuse"]
    layouts = catalog.layouts(spark, docs)
    headers = spark.createDataFrame([("a", "m", n, k, "BF16", s) for n, (k, s) in enumerate([("b.0.qkv", [64, 16]), ("m", [4])])], "artifact string, member string, ord int, name string, dtype string, shape array<bigint>")
    assert decide.stamp(headers, layouts).first().layout == "x.fused@1+plain.bf16@1"
    routes = {(a, b): steps for a, b, steps, *_ in decide.routes(catalog.edges(docs))}
    assert routes["x.fused@1", "x.split@1"] == ["x.fuse-inverse"]
    (tmp_path / "bad.json").write_text('{"format": "r", "format": "r"}')
    with pytest.raises(Refused, match="duplicate-key"):
        catalog.load(spark, str(tmp_path))


CONTRACT = {"tensors": [{"role": "attn.{i}", "pattern": "b.{i}.qkv", "fusion": {"axis": 0, "groups": 2, "parts": [{"role": "q", "share": 1}, {"role": "v", "share": 3}]}}, {"role": "out.{i}", "pattern": "b.{i}.o", "permute": {"view": ["auto", 2], "axes": [1, 0]}}]}


def test_runs_by_role(spark):
    t = spark.createDataFrame([("f", "b.0.qkv", "F32", [8, 2], 100, 64), ("f", "b.0.o", "F32", [4], 164, 16), ("f", "zz", "F32", [1], 180, 4)], "artifact string, name string, dtype string, shape array<bigint>, offset bigint, length bigint")
    runs = adapters.role_runs(t, CONTRACT)
    got = {r.role: (r.offset, r.length, r.rows, r.permute, r.reason) for r in runs.collect()}
    assert got == {"attn.0#q@0": (100, 8, 1, None, None), "attn.0#v@0": (108, 24, 3, None, None), "attn.0#q@1": (132, 8, 1, None, None), "attn.0#v@1": (140, 24, 3, None, None), "out.0": (164, 16, 4, "1,0", None)}
    want = runs.select("artifact", "role", "dtype", "length", "permute", F.lit(True).alias("required"))
    assert adapters.decide(runs, want).first().decision == "run-preserving"
    assert adapters.decide(runs, want.withColumn("permute", F.lit(None).cast("string"))).first().decision == "rearranged"
    assert tuple(adapters.decide(runs, want.withColumn("dtype", F.when(F.col("role") == "out.0", "F16").otherwise(F.col("dtype")))).first()) == ("f", "conversion", "out.0")
    assert adapters.decide(runs.where("role <> 'out.0'"), want).first().role == "out.0"
    for change, why in (({"name": "x"}, "half-identity"), ({"tensors": CONTRACT["tensors"] * 2}, "duplicate-role"), ({"tensors": [{"role": "a", "pattern": "b.{i}"}]}, "holes")):
        assert adapters.contract_refusal({**CONTRACT, **change}) == why
    assert adapters.contract_refusal(CONTRACT) is None


def test_permutations_of_bytes():
    x = np.arange(24, dtype=np.int16)
    moved = adapters.permute_bytes(x.tobytes(), [24], [2, "auto", 4], [2, 0, 1], 2)
    assert np.array_equal(np.frombuffer(moved, np.int16), x.reshape(2, 3, 4).transpose(2, 0, 1).ravel())
    assert adapters.permute_bytes(moved, [24], [2, "auto", 4], [2, 0, 1], 2, inverse=True) == x.tobytes()
    assert adapters.resolve_view([24], ["auto", "auto"]) is None and adapters.resolve_view([24], [5, "auto"]) is None


def test_a_renamed_container_is_one_new_object(spark):
    body = [bytes([k]) * 8 for k in range(3)]
    digests = [hashlib.sha256(b).hexdigest() for b in body]
    rows = [("f", k, f"new.{k}", "U8", [8], [(d, 8)], None) for k, d in enumerate(digests)] + [("f", 3, "made", "U8", [2], None, bytearray(b"zz"))]
    t = spark.createDataFrame(rows, "artifact string, ord int, name string, dtype string, shape array<bigint>, records array<struct<digest:string,len:bigint>>, content binary")
    out = writer.compose(t).cache()
    fresh = {r.ord: bytes(r.content) for r in out.collect() if r.fresh}
    assert sorted(fresh) == [0, 4] and fresh[4] == b"zz"
    content = fresh[0] + b"".join(body) + b"zz"
    assert [x["name"] for x in safetensors.parse_header(content)[1]] == ["new.0", "new.1", "new.2", "made"]
    old = spark.createDataFrame([("f", d) for d in digests], "artifact string, digest string")
    assert tuple(writer.shared(old, out).first())[1:3] == (5, 3)


def test_workspaces(spark, tmp_path):
    w = workspace.Workspaces(spark, f"file://{tmp_path}/w")
    objects = spark.createDataFrame([("d1", 5), ("d2", 7), ("d3", 9), ("e", 0)], "digest string, size bigint")
    log = lambda rows: spark.createDataFrame([("a", n, *r) for n, r in enumerate(rows)], "workspace string, ord int, op string, path string, arg string")
    v = w.commit(log([("put", "x", "d1"), ("put", "y", "d2"), ("put", "z", "e")]), 0)
    first = w.seal("a", objects, None, 0)
    v = w.commit(log([("rename", "x", "w"), ("remove", "y", None)]), v)
    with pytest.raises(workspace.Moved):
        w.commit(log([("put", "q", "d1")]), v - 1)
    assert {(r.path, r.generation) for r in w.heads.read().collect()} == {("w", 2), ("z", 2)}
    second = w.seal("a", objects, first, 1)
    assert first != second and w.snapshots.version() == 2
    with pytest.raises(ValueError, match="absent-object"):
        v = w.commit(log([("put", "bad", "nowhere")]), v)
        w.seal("a", objects, None, 2)
    w.lease("transfer", spark.createDataFrame([("d3",)], "digest string"), 0)
    marks = {(r.root, r.digest) for r in w.marks().collect()}
    assert {("leases", "d3"), (first, "d2"), (second, "d1"), ("heads", "d1")} <= marks and (first, "e") not in marks
    w.clone(first, "b", v)
    assert {r.path for r in w.heads.read().where("workspace = 'b'").collect()} == {"x", "y", "z"}
    w.release("transfer", 1)
    w.drop_snapshot(first, 2)
    assert {r.root for r in w.marks().collect()} == {"heads", second}
