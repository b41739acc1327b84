"""What plans may send to the driver: Spark's estimates don't count what rows explode into, so tables that grow with the input
aren't left to them. The tables here are small, and would be broadcast if the estimate chose."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from gneiss.operators import adapters, convert, decide, rules, transfer
from gneiss.operators.ordered import checkpoint as cut
from gneiss.operators.ordered import few, large

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["seam_decision", "seam_runs", "conversion_plan", "layout_emissions"])
def test_nothing_is_broadcast(spark, name):
    assert "Broadcast" not in plan(__spark_entry__.queries()[name](spark, SF))


def broadcasts(df) -> list[set[str]]:
    """The columns of each table that a plan broadcasts."""
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    found = re.findall(r"\) BroadcastExchange *\nInput \[\d+\]: \[([^\]]*)\]", df._jdf.queryExecution().explainString(mode))
    return [{c.split("#")[0].strip() for c in x.split(",")} for x in found]


@pytest.mark.parametrize("name", ["stamp", "closest_refusal", "stamp_all"])
def test_no_table_of_tensors_is_broadcast(spark, name, monkeypatch):
    """Neither in what the query returns nor in the steps whose lineage it cuts."""
    sent = []
    monkeypatch.setattr(decide, "checkpoint", lambda df: (sent.extend(broadcasts(df)), cut(df))[1])
    sent += broadcasts(__spark_entry__.queries()[name](spark, SF))
    assert sent and not [s for s in sent if s & {"name", "names", "key", "probe", "first_name", "rank"}]


@pytest.mark.parametrize("name", ["stamp", "closest_refusal", "stamp_all"])
def test_only_what_was_counted_is_broadcast(spark, name, monkeypatch):
    """Artifacts and layouts grow with the input too: beside the pairs that were counted, nothing a row of theirs is sent."""
    plans = []
    monkeypatch.setattr(decide, "few", large)
    monkeypatch.setattr(decide, "checkpoint", lambda df: (plans.append(plan(df)), cut(df))[1])
    plans.append(plan(__spark_entry__.queries()[name](spark, SF)))
    assert len(plans) == 3 and not [p for p in plans if "Broadcast" in p]


@pytest.mark.parametrize("name", ["admit", "derivation_steps"])
def test_no_stamps_are_broadcast(spark, name):
    sent = broadcasts(__spark_entry__.queries()[name](spark, SF))
    assert sent and not [s for s in sent if "artifact" in s]


def test_admits_odd_stamps(spark):
    """One artifact with two stamps gets the better way twice; no name, or a quantisation that no rule has, finds none."""
    stamps = spark.createDataFrame([("d", "a", "plain", "t"), ("d", "b", "plain", "t"), (None, "b", "plain", "t"), ("q", "b", "odd", "t"), ("x", "x", "plain", "t"), ("y", "y", "plain", "gone")], "artifact string, topology string, quant string, arrangement string")
    lanes = spark.createDataFrame([("L", 0, "b", "plain", "t"), ("M", 1, "b", "plain", "u"), ("Y", 2, "y", "plain", "t")], "lane string, lane_ord int, topology string, quant string, arrangement string")
    routes = spark.createDataFrame([("a", "b", 1, ["m"], 4, 4), ("b", "b", 0, [], 0, 0)], "source string, target string, hops int, steps array<string>, cost int, worst int")
    quants = spark.createDataFrame([("plain", False, False)], "quant string, transforms boolean, inverse boolean")
    records = spark.createDataFrame([("t", 2, False), ("u", 2, False)], "arrangement string, rank int, candidate boolean")
    for rows, want in ((stamps, [("L", "admit", 0, [], False, None)] * 2), (stamps.where("topology = 'a'"), [("L", "derive", 4, ["m"], True, None)])):
        got = decide.admit(rows, lanes, routes, quants, records).select("artifact", "lane", "decision", "cost", "steps", "lossy", "reason").collect()
        assert [tuple(r)[1:] for r in got if r.artifact == "d"] == want
    got = [tuple(r) for r in decide.admit(stamps, lanes, routes, quants, records).where("artifact is null or artifact <> 'd'").select("artifact", "decision", "reason").collect()]
    assert sorted(got, key=str) == [("q", "refuse", "no-bridge"), ("x", "refuse", "no-bridge"), ("y", "refuse", "no-record"), (None, "refuse", "no-bridge")]


def test_few(spark):
    """What was counted to be small is broadcast, whatever was estimated, and what is larger isn't."""
    rows, other = cut(spark.range(3)), spark.range(2)
    assert broadcasts(other.join(few(rows, 3), "id")) == [{"id"}] and broadcasts(other.join(few(rows, 2), "id")) == []


def test_roles_twice(spark):
    contract = {"tensors": [{"role": "r.{i}", "pattern": "l.{i}.w"}]}
    rows = [("a", "l.0.w", 8), ("a", "l.0.w", 8), ("a", "l.1.w", 8), ("b", "l.0.w", 8), (None, "l.0.w", 8), ("b", "other", 8)]
    t = spark.createDataFrame(rows, "artifact string, name string, length bigint").select("*", F.lit("F32").alias("dtype"), F.array(F.lit(2).cast("long")).alias("shape"), F.lit(0).cast("long").alias("offset"))
    got = [tuple(r) for r in adapters.role_runs(t, contract).select("artifact", "role", "reason").collect()]
    assert sorted(got, key=str) == [("a", "r.0", "duplicate-role"), ("a", "r.0", "duplicate-role"), ("a", "r.1", None), ("b", "r.0", None)]


def test_scales_twice(spark):
    """A scale that a layout or an artifact has twice makes no row twice."""
    layout = spark.createDataFrame([("c", "w", ["F8_E4M3"], [2]), ("c", "w_scale", ["F32"], [1]), ("c", "w_scale", ["F32"], [2])], "component string, key string, dtypes array<string>, shape array<bigint>")
    t = spark.createDataFrame([("a", "c", "w", "F32", [2]), ("b", "c", "w", "F32", [2]), ("b", "c", "w_scale", "U8", [9]), ("b", "c", "w_scale", "U8", [9])], "artifact string, component string, name string, dtype string, shape array<bigint>")
    got = [tuple(r) for r in convert.conversion_plan(t, layout).where("name = 'w'").select("artifact", "step", "reason").collect()]
    assert sorted(got) == [("a", "quantize-rowwise", None), ("b", "inherit", None)]


def test_emitted_twice(spark):
    """Also beside rows without a component, which are nobody's."""
    rule = {"name": "d.r", "version": 1, "base_dtype": "BF16", "eligible": {"key_suffix": ".w"}, "emissions": [{"key": "{module}.s", "dtype": "F32", "shape": ["d0"]}]}
    rows = [("t", "c", "a.w"), ("t", "c", "a.s"), ("t", "c", "b.w"), ("t", None, "a.w"), ("t", None, "a.w"), ("t", "d", "e.s"), ("t", "d", "e.s")]
    df = spark.createDataFrame(rows, "topology string, component string, key string").select("*", F.lit(0).alias("component_ord"), F.lit("r").alias("role"), F.array(F.lit(4).cast("long")).alias("shape"), F.lit(None).cast("string").alias("island"), F.lit("BF16").alias("dtype"))
    got = [tuple(r) for r in rules.apply_rule(df, rule).select("component", "key", "reason").collect()]
    assert sorted(got, key=str) == [("c", "a.s", "emitted-twice"), ("c", "a.s", "emitted-twice"), ("c", "b.s", None), ("d", "e.s", None), ("d", "e.s", None), (None, "a.s", None), (None, "a.s", None)]


def test_manifests_of_many_files(spark, tmp_path):
    """Languages of more documents than one declaration may have files: the query answers as its SQL, as if the service allowed them."""
    lang = F.when(F.col("id") < 6, F.element_at(F.array(*map(F.lit, ("de", "es", "fr"))), (F.shiftright("id", 1) + 1).cast("int"))).when(F.col("id") < 100_010, "fr").otherwise("en")
    spark.range(210_000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"), lang.alias("lang")).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in __spark_entry__.queries()["manifest_refusals"](spark, str(tmp_path)).collect()]
    db = duckdb.connect()
    db.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(got) == sorted(db.sql(__spark_entry__.oracle_sql()["manifest_refusals"]).fetchall())


def test_limits_of_manifests(spark):
    """The reference checks sums and paths before its limits, and the number of objects last."""
    ref = "sha256:" + "0" * 64
    rows = [("sum", "a", 3, ref, [(ref, 2)]), ("sum", "b", 3, ref, None), ("many", "a", 1, ref, None), ("many", "b", 1, "x", None), ("big", "a", 9, ref, None), ("all", "a", 5, ref, None), ("two", "a", 1, ref, None), ("two", "b", 2, ref, None), ("ok", "a", 1, ref, None)]
    df = spark.createDataFrame(rows, "session string, path string, size_bytes bigint, digest string, chunks array<struct<digest:string,len:bigint>>")
    reasons = lambda **x: dict(tuple(r) for r in transfer.manifest_refusals(df, transfer.Limits(**x)).collect())
    assert reasons() == {"sum": "chunk-sum", "two": "two-sizes"}
    assert reasons(files=1) == {"sum": "chunk-sum", "many": "files", "two": "files"}
    assert reasons(objects=1, object_size=8, total_size=4) == {"sum": "chunk-sum", "many": "objects", "big": "object-size", "all": "total-size", "two": "two-sizes"}
    assert transfer.Limits() == (100_000, 200_000, 512 << 30, 4 << 40)
