"""The operators over small hand-made tables: decisions, rules, morphisms, topologies, arrangements, the store, transfers."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gneiss.functions import dtypes, idents, shapes
from gneiss.functions.floats import bf16, e4m3, f16
from gneiss.operators import convert, decide, morphisms, ordered, planning, reads, relayout, rules, store, topology, transfer, writer
from gneiss.plans import queries
from gneiss.streaming import epochs


def values(df, *cols):
    return sorted((tuple(tuple(v) if isinstance(v, list) else v for v in (r[c] for c in cols)) for r in df.select(*cols).collect()), key=str)


# ---- sorted groups


def test_running_sums_match_brute_force(spark):
    """One group with most rows over many partitions, one with null for its key, values that are null."""
    rng = np.random.default_rng(7)
    rows = [("hot" if i % 3 else [None, "a", "b"][i % 2 + (i % 4 == 0) * (i % 2 == 0)], int(o), None if i % 11 == 0 else int(rng.integers(0, 9)), "x") for i, o in enumerate(rng.permutation(3000))]
    df = spark.createDataFrame(rows, "k string, ord long, v long, place string").repartition(7)
    got = ordered.running(df, ["k"], ["ord"], {"n": F.lit(1), "total": F.col("v")}, {"last": F.col("v")})
    want, state = [], {}
    for k, o, v, p in sorted(rows, key=lambda r: r[1]):
        n, total, last = state.get(k, (0, 0, None))
        want.append((k, o, v, p, n, total, last))
        state[k] = n + 1, total + (v or 0), v
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert ordered.running(df.limit(0), ["k"], ["ord"], {"n": F.lit(1)}).count() == 0


# ---- names and shapes


def test_handles_and_stamps(spark):
    texts = ["a.b@1", "a-1.b_c.d@12", "a@1", "A.b@1", "a.b@0", "a.b", "-a.b@1", "a." + "x" * 70 + "@1", "a.b@4294967296"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", idents.parse_handle(F.col("t")).alias("h"))
    assert {r.t: tuple(r.h) for r in df.collect() if r.h} == {"a.b@1": ("a.b", 1), "a-1.b_c.d@12": ("a-1.b_c.d", 12)}
    stamps = [("a.b@1+c.d@2", ("a.b@1", "c.d@2", idents.DEFAULT_ARRANGEMENT)), ("a.b@1+c.d@2+t.x@1", ("a.b@1", "c.d@2", "t.x@1")), (f"a.b@1+c.d@2+{idents.DEFAULT_ARRANGEMENT}", None), ("a.b@1", None)]
    df = spark.createDataFrame([(s,) for s, _ in stamps], "s string").select("s", idents.parse_layout(F.col("s")).alias("l"))
    assert {r.s: tuple(r.l) if r.l else None for r in df.collect()} == dict(stamps)
    back = spark.createDataFrame([("a.b@1", "c.d@2", x) for x in (None, idents.DEFAULT_ARRANGEMENT, "t.x@1")], "a string, b string, c string")
    assert {r[0] for r in back.select(idents.layout_text(F.col("a"), F.col("b"), F.col("c"))).collect()} == {"a.b@1+c.d@2", "a.b@1+c.d@2+t.x@1"}
    assert spark.range(1).select(idents.parse_bridge(F.lit("a.b@1>c.d@1"))["target"]).first()[0] == "c.d@1"


def test_paths(spark):
    bad = {"": "empty", "/a": "absolute", "a//b": "empty-segment", "a/../b": "dot-segment", "a\\b": "backslash", "a\tb": "control", "a/b": None}
    df = spark.createDataFrame([(p,) for p in bad], "p string").select("p", idents.path_refusal(F.col("p")).alias("r"))
    assert {r.p: r.r for r in df.collect()} == bad
    strict = {"a/CON.txt": "reserved-name", "a.": "trailing-dot-or-space", "a:b": "reserved-character", "é": "not-composed", "é": None}
    df = spark.createDataFrame([(p,) for p in strict], "p string").select("p", idents.strict_path_refusal(F.col("p"), idents.is_nfc(F.col("p"))).alias("r"))
    assert {r.p: r.r for r in df.collect()} == strict


@pytest.mark.parametrize("formula, shape, want", [("d0", [7], 7), ("d1/2", [1, 8], 4), ("d1/16", [1, 8], None), ("ceil(d0/128)*128*ceil(d1/16/4)*4", [200, 100], 256 * 8), ("ceil(d0/4/3)", [13], 2), ("d3", [1], None), ("2*3", [1], 6)])
def test_formulas(spark, formula, shape, want):
    got = spark.createDataFrame([(shape,)], "s array<bigint>").select(shapes.dimension(formula, F.col("s"))).first()[0]
    assert got == want == shapes.evaluate(formula, shape)


@pytest.mark.parametrize("text", ["", "d", "d0*", "ceil(d0", "0", "d0+1", "ceil()"])
def test_formulas_refused(text):
    with pytest.raises(shapes.FormulaError):
        shapes.parse(text)


def test_types(spark):
    df = spark.createDataFrame([("F32", [2, 3]), ("F4", [3]), ("F4", [4]), ("X", [1])], "d string, s array<bigint>")
    assert [r[0] for r in df.select(dtypes.n_bytes(F.col("d"), F.col("s"))).collect()] == [24, None, 2, None]


# ---- rules and decisions

TOPOLOGY = "topology string, component string, component_ord int, role string, key string, shape array<bigint>, island string, dtype string"


def topo(spark, rows):
    return spark.createDataFrame(rows, TOPOLOGY)


def test_rule_makes_a_header(spark):
    t = topo(spark, [
        ("t@1", "dit", 0, "denoiser", "b.0.x.weight", [32, 48], None, "BF16"), ("t@1", "dit", 0, "denoiser", "b.0.norm.weight", [32, 48], "F32", "BF16"), ("t@1", "dit", 0, "denoiser", "b.x.weight", [32, 48], None, "BF16"),
        ("t@1", "vae", 1, "autoencoder", "b.0.x.weight", [32, 48], "U8", "BF16"), ("t@1", "dit", 0, "denoiser", "0.x.weight", [32, 48], None, "BF16"),
    ])
    rule = {**queries.RULE, "eligible": {**queries.RULE["eligible"], "skip_module_substrings": ["norm"]}}
    got = {(r.component, r.key): (tuple(r.dtypes), tuple(r.shape), r.optional) for r in rules.apply_rule(t, rule).where("reason is null").collect()}
    assert got == {
        ("dit", "b.0.x.weight"): (("F8_E4M3",), (32, 48), False), ("dit", "b.0.x.weight_scale"): (("F32",), (32,), False), ("dit", "b.0.x.weight_blocks"): (("U8",), (512,), True),
        ("dit", "b.0.norm.weight"): (("BF16", "F32"), (32, 48), False), ("dit", "b.x.weight"): (("BF16",), (32, 48), False), ("vae", "b.0.x.weight"): (("BF16",), (32, 48), False), ("dit", "0.x.weight"): (("BF16",), (32, 48), False),
    }
    clash = topo(spark, [("t@1", "d", 0, "denoiser", "b.0.x.weight", [16, 16], None, "BF16"), ("t@1", "d", 0, "denoiser", "b.0.x.weight_scale", [16], None, "BF16")])
    assert set(values(rules.apply_rule(clash, rule).where("reason is not null"), "key", "reason")) == {("b.0.x.weight_scale", "emitted-twice")}
    odd = {**rule, "emissions": [{"key": "{key}", "dtype": "U8", "shape": ["d0/7"]}]}
    assert {r.reason for r in rules.apply_rule(t, odd).where("transformed").collect()} == {"shape-formula"}


HEADER = "artifact string, member string, ord int, name string, dtype string, shape array<bigint>"
LAYOUT = "layout string, layout_ord int, component string, component_ord int, key string, dtypes array<string>, shape array<bigint>, optional boolean, vacant boolean"


def test_decisions(spark):
    layouts = spark.createDataFrame([
        ("q", 0, "dit", 0, "a", ["F8"], [2], False, False), ("q", 0, "dit", 0, "s", ["F32"], [1], False, False), ("p", 1, "dit", 0, "a", ["BF16", "F32"], [2], False, False), ("p", 1, "dit", 0, "b", ["BF16"], [2], True, False),
        ("p", 1, "vae", 1, "c", ["BF16"], [3], False, False), ("z", 2, "dit", 0, "a", ["BF16"], [2], False, True), ("two", 3, "x", 0, "k", ["F32"], [1], False, False), ("two", 3, "y", 1, "k", ["F32"], [1], False, False),
    ], LAYOUT)
    headers = spark.createDataFrame([
        ("good", "dit/m", 0, "a", "BF16", [2]), ("good", "vae/m", 0, "c", "BF16", [3]), ("shape", "m", 0, "a", "BF16", [2]), ("shape", "n", 0, "c", "BF16", [4]), ("dtype", "m", 0, "c", "BF16", [3]), ("dtype", "n", 0, "a", "F64", [2]),
        ("missing", "m", 0, "a", "BF16", [2]), ("missing", "m", 1, "b", "BF16", [2]), ("unclaimed", "m", 0, "a", "F8", [2]), ("unclaimed", "m", 1, "x", "F32", [1]), ("none", "m", 0, "zzz", "F32", [1]),
        ("pair", "x/m", 0, "k", "F32", [1]), ("pair", "y/m", 0, "k", "F32", [1]), ("twice", "m", 0, "a", "BF16", [2]), ("twice", "n", 0, "a", "BF16", [2]),
    ], HEADER)
    # Of refusals that matched as much the first layout's counts, here q's.
    got = {r.artifact: (r.layout, r.reason, r.tensor) for r in decide.stamp(headers, layouts).collect()}
    assert got == {
        "good": ("p", None, None), "shape": (None, "dtype", "a"), "dtype": (None, "unclaimed", "c"), "missing": (None, "missing", "c"), "unclaimed": (None, "unclaimed", "x"), "none": (None, "no-stamp", None), "pair": ("two", None, None),
        "twice": (None, "dtype", "a"),
    }
    assert {(r.artifact, r.layout) for r in decide.stamp_all(headers, layouts).collect()} == {("good", "p"), ("pair", "two")}


# ---- morphisms

MORPH = {"name": "m.x", "version": 1, "from": "a@1", "to": "b@1", "rekey": [{"from_key": "l.{i}.o.{i}.w", "to_key": "n.{i}.p.{i}.w"}, {"from_prefix": "l.", "to_prefix": "r."}], "seams": [{**queries.SEAM, "target": "l.{i}.qkv", "parts": [{"role": r, "share": s, "key": f"l.{{i}}.{r}"} for r, s in (("q", 1), ("k", 1), ("v", 2))]}]}


def test_morphism_and_its_inverse(spark):
    rows = [("a@1", "c", 0, "r", k, s, i, "BF16") for k, s, i in (("l.0.q", [4, 8], "F32"), ("l.0.k", [4, 8], None), ("l.0.v", [8, 8], None), ("l.0.o.1.w", [2], "F32"), ("l.0.o.01.w", [2], None), ("x", [1], None))]
    t = topo(spark, rows)
    out = morphisms.apply_morphism(t, MORPH)
    assert values(out, "key", "shape", "island", "reason") == sorted([("l.0.qkv", (16, 8), None, None), ("n.0.p.1.w", (2,), "F32", None), ("r.0.o.01.w", (2,), None, None), ("x", (1,), None, None)], key=str)
    back = morphisms.apply_morphism(out, morphisms.inverse(MORPH))
    assert morphisms.difference(t, back).count() == 0
    broken = morphisms.apply_morphism(t.where("key <> 'l.0.k'"), MORPH)
    assert ("l.0.qkv", "parts") in values(broken, "key", "reason")
    assert values(morphisms.difference(t, t.where("key <> 'x'")), "key", "reason") == [("x", "only-left")]


# ---- topologies


def test_topology_from_headers(spark):
    h = spark.createDataFrame([
        ("t", "transformer/model-00001-of-00002.st", 0, "a", "BF16", [100]), ("t", "transformer/model-00002-of-00002.st", 0, "b", "F32", [2]), ("t", "vae/d.st", 0, "a", "F32", [500]), ("t", "vae/e.st", 0, "a", "F32", [5]),
        ("t", "text_encoder_2/m.st", 0, "k", "F16", [3]),
    ], HEADER)
    got = values(topology.topology_from_headers(h), "component", "role", "key", "island", "dtype")
    assert got == sorted([
        ("transformer", "denoiser", "a", None, "BF16"), ("transformer", "denoiser", "b", "F32", "BF16"), ("d", "autoencoder", "a", "F32", "BF16"), ("e", "autoencoder", "a", "F32", "BF16"), ("text_encoder_2", "text_encoder", "k", "F16", "BF16"),
    ], key=str)


# ---- arrangements


@pytest.mark.parametrize("record, shape", [(queries.TRANSPOSED, [3, 5]), (queries.CHANNELS_LAST, [2, 3, 2, 4]), (queries.BLOCKSCALE, [130, 6])])
def test_arrangements(spark, record, shape):
    n = int(np.prod(shape))
    src = relayout.indices(shape, record)
    assert relayout.record_refusal(record) is None and relayout.ratify(record, [shape, [d + 1 for d in shape]]) is None
    assert sum(r[2] for r in relayout.runs(shape, record)) == len(src)
    df = spark.createDataFrame([(list(map(float, range(n))), shape)], "v array<float>, s array<bigint>")
    p = df.select(relayout.plan(F.col("s"), record).alias("p")).first().p
    assert p.elements == len(src) and p.padded == (len(src) > n) and math.prod(p.storage) == len(src)
    if n < 100:
        moved = df.select(relayout.apply(F.col("v"), shape, record).alias("m"))
        assert moved.first().m == [float(i) if i >= 0 else 0.0 for i in src]
        assert moved.select(relayout.apply_inverse(F.col("m"), shape, record).alias("b")).first().b == list(map(float, range(n)))


def test_records_refused():
    sub = lambda *e: [{"axis": a, "extent": x} for a, x in e]
    for rank, subs, perm, why in ((2, sub((1, "d1"), (0, "d0")), [0, 1], "axes-order"), (2, sub((0, "d0")), [0], "axes-cover"), (1, sub((0, "d0")), [1], "permutation"), (1, sub((0, "d0")), [0], "changes-nothing")):
        assert relayout.record_refusal({"rank": rank, "sub_axes": subs, "permutation": perm}) == why


def test_narrow_floats(spark):
    xs = [0.0, 1.0, -1.0, 448.0, 1e9, -1e9, 0.0625, 1.0625, 1.1875, 0.013671875, 2**-9, 2**-10, 3 * 2**-10, 17.0, 19.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(e4m3(F.col("x"))).collect()]
    assert got == [0, 1, -1, 448, 448, -448, 0.0625, 1.0, 1.25, 0.013671875, 2**-9, 0, 2 * 2**-9, 16, 20]
    assert spark.createDataFrame([(float("nan"),)], "x double").select(e4m3(F.col("x"))).first()[0] == 448
    ys = [1.0, 1.00390625, 3.14159, -0.1, 0.0]
    bits = lambda y: np.frombuffer((np.float32(y).view(np.uint32) + 0x7FFF + ((np.float32(y).view(np.uint32) >> 16) & 1) & 0xFFFF0000).astype(np.uint32).tobytes(), np.float32)[0]
    got = [r[0] for r in spark.createDataFrame([(float(np.float32(y)),) for y in ys], "x double").select(bf16(F.col("x"))).collect()]
    assert got == [float(bits(y)) for y in ys]


def test_conversions(spark):
    layout = spark.createDataFrame([("c", "w", ["F8_E4M3"], [2, 2]), ("c", "w_scale", ["F32"], [2]), ("c", "n", ["BF16"], [2]), ("c", "u", ["F8_E4M3"], [2])], "component string, key string, dtypes array<string>, shape array<bigint>")
    rows = [("a", "c", "w", "BF16", [2, 2]), ("a", "c", "n", "F32", [2]), ("a", "c", "x", "F32", [1]), ("a", "c", "u", "F32", [2]), ("b", "c", "n", "F32", [3]), ("b", "c", "w", "F32", [2, 2]), ("b", "c", "w_scale", "F32", [2]), ("c", "c", "n", "I64", [2])]
    got = values(convert.conversion_plan(spark.createDataFrame(rows, "artifact string, component string, name string, dtype string, shape array<bigint>"), layout), "artifact", "name", "step", "reason")
    assert got == sorted([("a", "w", "quantize-rowwise", None), ("a", "n", "cast", None), ("a", "x", "inherit", None), ("a", "u", None, "no-scale"), ("b", "n", None, "shape"), ("b", "w", "inherit", None), ("b", "w_scale", "inherit", None), ("c", "n", None, "dtype")], key=str)
    assert convert.recipe_for({"name": "x.fp8-rowwise", "conventions": {}}) is None and convert.recipe_for({"name": "plain.bf16"}) == ("cast",) and convert.recipe_for({"name": "x.int3"}) is None
    err = convert.dequantise_error(spark.createDataFrame([([1.0, -3.0, 0.5],)], "values array<double>")).first()
    assert err.error <= 3.0 / 16


# ---- plans, transfers, store, reads


def test_grids_and_seams(spark):
    d = spark.createDataFrame([("f", 100, 25), ("g", 0, 0)], "f string, offset bigint, length bigint")
    assert values(planning.grid(d, ["f"], 10), "f", "ord", "offset", "length") == [("f", 0, 100, 10), ("f", 1, 110, 10), ("f", 2, 120, 5)]
    entry = {"pattern": "b.{i}.qkv", "fusion": {"groups": 2, "parts": [{"role": "q", "share": 1}, {"role": "k", "share": 1}]}}
    mb = 1 << 20
    t = spark.createDataFrame([("f", "b.0.qkv", [8, 4], 0, 4 * mb), ("f", "b.1.qkv", [8, 4], 0, mb), ("f", "b.2.qkv", [6, 4], 0, 4 * mb), ("f", "o", [8], 0, 4 * mb)], "f string, name string, shape array<bigint>, offset bigint, length bigint")
    assert values(planning.seam_cuts(t, [entry], ["f"]), "name", "ord", "offset", "length") == [("b.0.qkv", k, k * mb, mb) for k in range(4)]
    assert values(planning.set_members(t, ["b.{i}.qkv"]), "name") == [("b.0.qkv",), ("b.1.qkv",), ("b.2.qkv",)]
    files = spark.createDataFrame([("f", bytearray(b"abcdefghij"))], "f string, content binary")
    regions = planning.grid(spark.createDataFrame([("f", 0, 10)], "f string, offset bigint, length bigint"), ["f"], 4)
    assert values(planning.hash_regions(files, regions, ["f"]), "offset", "digest") == values(planning.hash_grid(files, ["f"], 4), "offset", "digest")


def test_transfers(spark):
    d = spark.createDataFrame([("s", 0, "a", 1), ("s", 1, "b", 2), ("s", 2, "a", 1), ("t", 0, "b", 2)], "session string, ord int, digest string, size bigint")
    plan = transfer.have_need(d, spark.createDataFrame([("a",), ("b",)], "digest string"), spark.createDataFrame([("s", "a"), ("t", "b")], "session string, digest string"))
    assert values(plan, "session", "digest", "status") == [("s", "a", "have"), ("s", "b", "need"), ("t", "b", "have")]
    closure = transfer.closure(d)
    assert values(closure, "session", "ord", "digest") == [("s", 0, "a"), ("s", 1, "b"), ("t", 0, "b")]
    bad = spark.createDataFrame([("s", 0, "b", 2), ("s", 1, "a", 1), ("t", 0, "b", 3)], "session string, ord int, digest string, size bigint")
    assert values(transfer.missing_refusals(closure, bad), "session", "reason") == [("s", "order"), ("t", "size")]
    lanes = spark.createDataFrame([("s", "a", 100, "pack"), ("s", "b", 5, "blob"), ("s", "c", 5, "pack")], "session string, digest string, size bigint, lane string")
    assert values(transfer.lane_refusals(lanes, 10), "digest", "reason") == [("a", "too-large-for-pack"), ("b", "small-blob")]
    assert values(transfer.pull(closure, spark.createDataFrame([("b", 2)], "digest string, size bigint")), "session", "digest") == [("s", "a")]
    left, n = transfer.push(plan, lambda pdf: pd.DataFrame({"session": pdf["session"], "digest": pdf["digest"], "sent": True}))
    assert n == 0 and left.count() == 0
    _, n = transfer.push(plan, lambda pdf: pd.DataFrame({"session": pdf["session"], "digest": pdf["digest"], "sent": False}), rounds=2)
    assert n == 1
    signed = transfer.grants(plan.withColumn("key", F.col("digest")), lambda k: f"https://host/{k}", 60, F.lit("2024-01-01").cast("timestamp")).first()
    assert signed.url == "https://host/b" and str(signed.expires_at) == "2024-01-01 00:01:00"
    ref = "sha256:" + "0" * 64
    files = [("ok", "a", 3, ref, [(ref, 3)]), ("sum", "a", 3, ref, [(ref, 2)]), ("case", "a", 1, ref, None), ("case", "A", 1, ref, None), ("two", "a", 1, ref, None), ("two", "b", 2, ref, None)]
    df = spark.createDataFrame(files, "session string, path string, size_bytes bigint, digest string, chunks array<struct<digest:string,len:bigint>>")
    assert values(transfer.manifest_refusals(df), "session", "reason") == [("case", "path-case"), ("sum", "chunk-sum"), ("two", "two-sizes")]


def test_store(spark):
    objects = spark.createDataFrame([(bytearray(b"x"),), (bytearray(b"x"),), (bytearray(b"y"),)], "content binary")
    held = store.admit(objects)
    assert held.count() == 2 and store.admit(objects, held).count() == 0 and store.corrupt(held).count() == 0
    assert store.corrupt(held.withColumn("content", F.lit("z").cast("binary"))).count() == 2
    refs, ids = spark.createDataFrame([("main", "1")], "name string, target string"), spark.createDataFrame([("1",), ("2",)], "id string")
    assert store.swap_ref(refs, "main", "2", "2", ids)[1] == "moved" and store.swap_ref(refs, "main", "1", "9", ids)[1] == "absent-target"
    assert values(store.swap_ref(refs, "main", "1", "2", ids)[0], "target") == [("2",)] and store.swap_ref(refs, "new", None, "1", ids)[1] is None
    entries = spark.createDataFrame([("s", "d", "directory"), ("s", "d/f", "file"), ("s", "e/g", "file"), ("s", "a", "file")], "s string, path string, kind string")
    assert values(store.orphans(entries, ["s"]), "path") == [("e/g",)] and values(store.ordinals(entries, ["s"]), "path", "ordinal") == [("a", 0), ("d/f", 1), ("e/g", 2)]
    rec = spark.createDataFrame([("f", 0, False, "a", 10), ("f", 1, True, None, 5), ("g", 0, True, None, 5), ("g", 1, True, None, 5)], "f string, ord int, hole boolean, digest string, length bigint")
    sizes = spark.createDataFrame([("f", 15), ("g", 10), ("h", 0), ("i", 1)], "f string, size bigint")
    assert values(store.record_refusals(rec, sizes, ["f"]), "f", "reason") == [("g", "adjacent-holes"), ("i", "sum")]
    cut = lambda n: values(store.truncate(rec.where("f = 'f'"), ["f"], F.lit(n)), "ord", "length", "reason")
    assert cut(12) == [(0, 10, None), (1, 2, None)] and cut(7) == [(0, 7, "inside-data")] and cut(20) == [(0, 10, None), (1, 10, None)]
    assert values(store.truncate(rec.where("f = 'f' and ord = 0"), ["f"], F.lit(12)), "ord", "hole", "length") == [(0, False, 10), (1, True, 2)]
    log = [("w", i, *x) for i, x in enumerate([("put", "a", "1"), ("put", "b", "2"), ("rename", "a", "c"), ("remove", "zz", None), ("link", "c", "d"), ("remove", "b", None), ("truncate", "d", "0")])]
    got = store.fold_mutations(spark.createDataFrame(log, "workspace string, ord int, op string, path string, arg string"))
    assert values(got, "path", "value", "generation", "refused") == [("c", "1", 6, 1), ("d", "1[:0]", 6, 1)]


def test_reads(spark):
    chunks = spark.createDataFrame([("f", o, 4, bytearray(b"abcdefghijkl"[o : o + 4])) for o in (0, 4, 8)], "f string, offset bigint, length bigint, content binary")
    ranges = spark.createDataFrame([("f", 1, 2, 9), ("f", 2, 0, 12), ("f", 3, 5, 5), ("f", 4, 11, 40)], "f string, range int, start bigint, end bigint")
    assert {r.range: bytes(r.bytes) for r in reads.read_ranges(ranges, chunks, ["f"], 3).collect()} == {1: b"cdefghi", 2: b"abcdefghijkl", 4: b"l"}
    t = spark.createDataFrame([("f", "a", 0, 4), ("f", "b", 4, 6), ("f", "c", 10, 2)], "f string, name string, offset bigint, length bigint")
    rec = chunks.select("f", "offset", "length", F.concat(F.lit("d"), F.col("offset").cast("string")).alias("digest"))
    assert values(reads.inherit(t, rec, ["f"]), "name", "records", "reason") == sorted([("a", ("d0",), None), ("b", ("d4",), "not-aligned"), ("c", None, "not-aligned")], key=str)
    names = spark.createDataFrame([("a", "z"), ("b", "c")], "old string, new string")
    assert values(reads.rekeyed(t, names, ["f"]), "name", "source", "reason") == [("c", "b", "collision"), ("c", "c", "collision"), ("z", "a", None)]
    kept, lacking = reads.subset(t, spark.createDataFrame([("f", "c"), ("f", "a"), ("f", "no")], "f string, name string"), ["f"])
    assert values(kept, "name", "new_offset") == [("a", 0), ("c", 4)] and values(lacking, "name") == [("no",)]
    e = spark.createDataFrame([("m.st", "file", "tensor", 5, None), ("d/x", "file", "blob", 5, "abcd"), ("e", "file", "blob", 0, "00")], "path string, kind string, body string, size bigint, digest string")
    assert values(reads.projection(e), "path", "artifact", "target") == sorted([("m.st", "stub", None), ("d/x", "link", "../../objects/ab/abcd"), ("e", "empty", None)], key=str)


def test_epochs_as_a_stream(spark, tmp_path):
    rows = [("a", 0), ("b", 0), ("a", 1), ("b", 2), ("a", 6), ("b", 4)]
    for n, part in enumerate((rows[:2], rows[2:])):
        spark.createDataFrame(part, "digest string, epoch long").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    stream = spark.readStream.schema("digest string, epoch long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = epochs.stream_collect(stream).writeStream.outputMode("append").format("memory").queryName("epochs").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert values(spark.table("epochs"), "digest", "epoch", "action") == sorted([("a", 0, "reference"), ("b", 0, "reference"), ("b", 2, "rescue"), ("b", 4, "rescue"), ("a", 6, "readmit")], key=str)


# ---- bytes of conversions, derived containers, objects as files


def test_codes_match_the_columns(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, s, 300) for s in (1e-4, 0.01, 1, 300)] + [[0.0, -0.0, 448, 464, 1e9, -1e9, 2**-9, 2**-10, 0.0155, 17, 17.0625]])
    codes = convert.e4m3_codes(x)
    decoded = np.where(codes > 127, -1, 1) * convert.E4M3_VALUES[codes & 127]
    want = [r[0] for r in spark.createDataFrame([(float(v),) for v in x], "x double").select(e4m3(F.col("x"))).collect()]
    assert np.array_equal(decoded, np.array(want))
    for dtype, kernel in (("BF16", bf16), ("F16", f16)):
        y = x[np.abs(x) < 6e4]
        want = [r[0] for r in spark.createDataFrame([(float(np.float32(v)),) for v in y], "x double").select(kernel(F.col("x"))).collect()]
        assert np.array_equal(convert.decode(convert.encode(np.float32(y).astype(float), dtype), dtype), np.array(want))


def test_converted_tree(spark):
    w = np.random.default_rng(1).normal(0, 1, (2, 16)).astype("<f4")
    rec = [("ab" * 32, 8)]
    tensors = spark.createDataFrame(
        [("t", "c", 0, "q.weight", "F32", [2, 16], rec, w.tobytes()), ("t", "c", 1, "b", "F32", [4], rec, np.arange(4, dtype="<f4").tobytes()), ("t", "c", 2, "k", "BF16", [4], rec, None), ("t", "c", 3, "bad", "F32", [4], rec, b"x"), ("t", "c", 4, "far", "F32", [4], rec, None)],
        "artifact string, component string, ord int, name string, dtype string, shape array<bigint>, records array<struct<digest:string,len:bigint>>, content binary",
    )
    plan = spark.createDataFrame([("t", "c", n, s, r) for n, s, r in (("q.weight", "quantize-rowwise", None), ("b", "cast", None), ("k", "inherit", None), ("bad", None, "shape"), ("far", "cast", None))], "artifact string, component string, name string, step string, reason string")
    got = {r.name: r for r in convert.convert_tree(tensors, plan).collect()}
    assert sorted(got) == ["b", "bad", "far", "k", "q.weight", "q.weight_scale"]
    assert got["b"].dtype == "BF16" and convert.decode(bytes(got["b"].content), "BF16").tolist() == [0, 1, 2, 3]
    assert got["bad"].refused == "shape" and got["far"].refused == "no-bytes" and got["k"].records[0].len == 8
    codes = np.frombuffer(bytes(got["q.weight"].content), np.uint8)
    scale = np.frombuffer(bytes(got["q.weight_scale"].content), "<f4")
    back = (np.where(codes > 127, -1, 1) * convert.E4M3_VALUES[codes & 127]).reshape(2, 16) * scale[:, None]
    assert np.abs(back - w).max() < 0.07 * np.abs(w).max() and got["q.weight_scale"].ord == 1
    file = writer.compose(convert.convert_tree(tensors, plan).where("refused is null").drop("refused")).collect()
    assert sum(r.fresh for r in file) == 4 and any(r.digest == "ab" * 32 for r in file)


def test_derived_container(spark):
    rows = [("t", 0, "m", "U8", [2, 3], 1, [("cd" * 32, 6)], bytes(range(6))), ("t", 1, "v", "U8", [3], 1, [("ef" * 32, 3)], bytes(3))]
    t = spark.createDataFrame(rows, "artifact string, ord int, name string, dtype string, shape array<bigint>, item int, records array<struct<digest:string,len:bigint>>, content binary")
    same = writer.derive(t, relayout.IDENTITY).collect()
    assert [r.digest for r in sorted(same, key=lambda r: r.ord)][1:] == ["cd" * 32, "ef" * 32]
    moved = sorted(writer.derive(t, queries.TRANSPOSED).collect(), key=lambda r: r.ord)
    assert bytes(moved[1].content) == bytes([0, 3, 1, 4, 2, 5]) and moved[2].digest == "ef" * 32


def test_objects_as_files(spark, tmp_path):
    a, b = (__import__("hashlib").sha256(x).hexdigest() for x in (b"one", b"two"))
    for d, x in ((a, b"one"), (b, b"two")):
        at = tmp_path / "objects" / d[:2] / d[2:4]
        at.mkdir(parents=True)
        (at / d).write_bytes(x)
    (tmp_path / "objects" / "stray").write_bytes(b"x")
    path = f"file://{tmp_path}/objects"
    assert values(store.object_files(spark, path), "digest", "length") == sorted([(a, 3), (b, 3)])
    both = spark.createDataFrame([(a,), (b,)], "digest string")
    assert values(store.remove_objects(spark, path, both, both.where(F.col("digest") == a)), "digest") == [(b,)]
    assert values(store.object_files(spark, path), "digest") == [(a,)]
    none = spark.createDataFrame([], "path string")
    assert store.reap(spark, path, 3600, none).count() == 0
    assert len(store.reap(spark, path, 0, none).where("reaped").collect()) == 2 and store.object_files(spark, path).count() == 0


def test_regions_are_admitted(spark):
    files = spark.createDataFrame([("f", b"aabbaa")], "path string, content binary")
    regions = spark.createDataFrame([("f", k, 2 * k, 2) for k in range(3)], "path string, ord int, offset long, length long")
    named, fresh = store.admit_regions(files, regions, ["path"])
    assert len({r.digest for r in named.collect()}) == 2 and sorted(bytes(r.content) for r in fresh.collect()) == [b"aa", b"bb"]
    assert store.admit_regions(files, regions, ["path"], fresh.where("content = cast('aa' as binary)"))[1].count() == 1


def test_all_kinds_of_mutations(spark):
    log = [("mkdir", "d", None), ("put", "d/f", "1"), ("rmdir", "d", None), ("symlink", "l", "d/f"), ("symlink", "l", "x"), ("chmod", "d/f", "x"), ("records", "d/f", "2"), ("records", "no", "2"), ("chmod", "l", "x"), ("mkdir", "e", None), ("rmdir", "e", None)]
    got = store.fold_mutations(spark.createDataFrame([("w", k, *x) for k, x in enumerate(log)], "workspace string, ord int, op string, path string, arg string"))
    assert {(r.path, r.value) for r in got.collect()} == {("d", None), ("d/f", "2*"), ("l", "@d/f")}
    assert {(r.generation, r.refused) for r in got.collect()} == {(7, 4)}


def test_refusals_name_the_closest_lane(spark):
    layouts = spark.createDataFrame([
        ("p", 0, "dit", 0, "a", ["BF16"], [2], False, False), ("p", 0, "dit", 0, "b", ["BF16"], [2], False, False), ("q", 1, "dit", 0, "a", ["F8"], [2], False, False), ("q", 1, "dit", 0, "s", ["F32"], [1], False, False),
        ("other", 2, "x", 0, "k", ["F32"], [1], False, False),
    ], LAYOUT)
    headers = spark.createDataFrame([("one", "m", 0, "a", "BF16", [2]), ("one", "m", 1, "b", "BF16", [3]), ("two", "m", 0, "k", "F32", [1]), ("three", "m", 0, "a", "BF16", [2]), ("three", "m", 1, "b", "BF16", [2])], HEADER)
    near = {r.artifact: (r.layout, r.matched, r.reason, r.tensor) for r in decide.closest_lane(headers, layouts, ["q", "p"]).collect()}
    assert near == {"one": ("p", 1, "shape", "b"), "two": ("q", 0, "unclaimed", "k"), "three": ("q", 0, "dtype", "a")}
    stamps = decide.stamp(headers, layouts)
    admitted = spark.createDataFrame([("two", None, "refuse", "no-bridge"), ("three", "p", "admit", None)], "artifact string, lane string, decision string, reason string")
    got = {r.artifact: (r.lane, r.decision, r.reason, r.closest, r.tensor, r.note) for r in decide.admit_files(headers, layouts, stamps, admitted, ["q", "p"]).collect()}
    assert got == {"one": (None, "refuse", "shape", "p", "b", None), "two": (None, "refuse", "unclaimed", "q", "k", "other"), "three": ("p", "admit", None, None, None, None)}
    assert {r.reason for r in decide.admit_files(headers, layouts, stamps, admitted, []).collect()} == {"no-lane"}
