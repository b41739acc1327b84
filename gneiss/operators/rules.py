"""Quantisation rules applied to topologies: which tensors a rule transforms, and the header it makes of a topology.

A topology is a table (topology, component, component_ord, role, key, shape, island, dtype): one row a tensor, ``island`` its
element type where that differs from the topology's ``dtype``. A rule is its document as a dict.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gneiss.functions.dtypes import is_quantised
from gneiss.functions.shapes import dimensions

LAYOUT = ("topology", "quant", "component", "component_ord", "role", "key", "dtypes", "shape", "optional", "transformed", "reason")


def repeated_block(key: Column) -> Column:
    """Whether a segment that is neither first nor last is a number."""
    segments = F.split(key, r"\.")
    inner = F.slice(segments, 2, F.greatest(F.size(segments) - 2, F.lit(0)))
    return F.exists(inner, lambda s: s.rlike("^[0-9]+$"))


def module_of(key: Column, suffix: str) -> Column:
    """The key without the suffix."""
    return F.when(key.endswith(suffix), F.substr(key, F.lit(1), F.length(key) - F.lit(len(suffix)))).otherwise(key) if suffix else key


def reference_dtype() -> Column:
    """What the reference carries for a tensor."""
    return F.coalesce(F.col("island"), F.col("dtype"))


def eligible(rule: dict) -> Column:
    """Whether the rule transforms a topology's row."""
    p = rule.get("eligible")
    if not p:
        return F.lit(False)
    key, shape = F.col("key"), F.col("shape")
    tests: list[Column] = []
    if rule.get("scope_roles"):
        tests.append(F.coalesce(F.col("role").isin(*rule["scope_roles"]), F.lit(False)))
    if p.get("source_dtypes"):
        tests.append(F.coalesce(reference_dtype().isin(*p["source_dtypes"]), F.lit(False)))
    if p.get("rank"):
        tests.append(F.size(shape) == p["rank"])
    if p.get("rank_at_least"):
        tests.append(F.size(shape) >= p["rank_at_least"])
    if p.get("key_suffix"):
        tests.append(key.endswith(p["key_suffix"]))
    for axis, step in enumerate(p.get("dim_align") or []):
        if step:
            tests.append(F.coalesce(F.get(shape, F.lit(axis)) % step == 0, F.lit(False)))
    if p.get("require_repeated_block_segment"):
        tests.append(repeated_block(key))
    module = module_of(key, p.get("key_suffix") or "")
    tests += [~F.contains(module, F.lit(s)) for s in p.get("skip_module_substrings") or []]
    if p.get("skip_module_exact"):
        tests.append(~module.isin(*p["skip_module_exact"]))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def transforms(rule: dict) -> bool:
    return bool(rule.get("eligible")) and bool(rule.get("emissions"))


def passthrough_dtypes(rule: dict) -> Column:
    """What a tensor that the rule leaves alone may carry."""
    reference, base = reference_dtype(), F.lit(rule["base_dtype"])
    if rule["base_dtype"] == "@reference":
        return F.array(reference)
    if not rule.get("reference_tolerant"):
        return F.array(base)
    tolerated = F.col("island").isNotNull() & (reference != base) & ~is_quantised(reference)
    return F.when(tolerated, F.array(base, reference)).otherwise(F.array(base))


def handle(document: dict) -> str:
    return f"{document['name']}@{document['version']}"


def apply_rule(topology: DataFrame, rule: dict) -> DataFrame:
    """The header that the rule makes of each topology, a row a tensor; ``reason`` refuses: ``shape-formula`` where an
    emission's shape can't be had, ``emitted-twice`` where two emissions, or one and a tensor passed through, collide."""
    rows = topology.withColumn("hit", eligible(rule))
    passed = F.struct(F.col("key").alias("key"), passthrough_dtypes(rule).alias("dtypes"), F.col("shape").alias("shape"), F.lit(False).alias("optional"))
    suffix = (rule.get("eligible") or {}).get("key_suffix") or ""
    module = module_of(F.col("key"), suffix)
    emitted = []
    for e in rule.get("emissions") or []:
        parts: list[Column] = []
        for k, piece in enumerate(e["key"].replace("{key}", "\0k\0").replace("{module}", "\0m\0").split("\0")):
            parts.append(F.lit(piece) if k % 2 == 0 else F.col("key") if piece == "k" else module)
        emitted.append(F.struct(F.concat(*parts).alias("key"), F.array(F.lit(e["dtype"])).alias("dtypes"), dimensions(e["shape"], F.col("shape")).alias("shape"), F.lit(bool(e.get("optional"))).alias("optional")))
    if emitted:
        rows = rows.withColumn("out", F.explode(F.when(F.col("hit"), F.array(*emitted)).otherwise(F.array(passed))))
    else:
        rows = rows.withColumn("out", passed).where(~F.col("hit"))
    out = rows.select("topology", F.lit(handle(rule)).alias("quant"), "component", "component_ord", "role", "out.*", F.col("hit").alias("transformed"))
    w = Window.partitionBy("topology", "component", "key")  # no partial sums: they would hold all keys of a file in one task
    named = F.col("topology").isNotNull() & F.col("component").isNotNull() & F.col("key").isNotNull()
    twice = named & (F.count("*").over(w) > 1) & F.max("transformed").over(w)
    reason = F.when(F.col("shape").isNull(), "shape-formula").when(twice, "emitted-twice")
    return out.withColumn("reason", reason).select(*LAYOUT)


def layout_stats(layouts: DataFrame, transforming: list[str]) -> DataFrame:
    """Of each layout: required and optional tensors, those transformed, and whether its rule is one that transforms."""
    return layouts.groupBy("topology", "quant").agg(
        F.count_if(~F.col("optional")).alias("required"), F.count_if("optional").alias("optional"), F.count_if("transformed").alias("transformed"), F.max(F.col("quant").isin(*transforming) if transforming else F.lit(False)).alias("transforms")
    )
