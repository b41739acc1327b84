"""Morphisms between topologies: rekeying by prefix and pattern, and seams that fuse tensors or split them.

A topology is the table that ``rules`` describes. A morphism is its document as a dict: from, to, rekey (ordered), seams.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBER = "(0|[1-9][0-9]*)"


def pattern_regex(pattern: str) -> str:
    """The anchored regular expression of a pattern with ``{i}`` holes, which are numbers without leading zeros."""
    return "^" + NUMBER.join(re.escape(p) for p in pattern.split("{i}")) + "$"


def pattern_template(pattern: str) -> str:
    """The replacement that renders a pattern from the holes in order."""
    pieces = [p.replace("\\", "\\\\").replace("$", "\\$") for p in pattern.split("{i}")]
    return "".join(p + (f"${k + 1}" if k < len(pieces) - 1 else "") for k, p in enumerate(pieces))


def rekey(key: Column, rows: list[dict]) -> Column:
    """The key by the first row that matches it: within a row a pattern wins over a prefix; no row: the key itself."""
    out = F.when(F.lit(False), key)
    for r in rows:
        if r.get("from_key"):
            regex = pattern_regex(r["from_key"])
            out = out.when(key.rlike(regex), F.regexp_replace(key, regex, pattern_template(r["to_key"])))
        elif r.get("from_prefix"):
            out = out.when(key.startswith(r["from_prefix"]), F.concat(F.lit(r.get("to_prefix") or ""), F.substr(key, F.lit(len(r["from_prefix"]) + 1))))
    return out.otherwise(key)


def inverse(morphism: dict) -> dict:
    """The morphism backwards: rekeys swapped, seams read the other way."""
    swap = [{"from_prefix": r.get("to_prefix"), "to_prefix": r.get("from_prefix"), "from_key": r.get("to_key"), "to_key": r.get("from_key")} for r in morphism.get("rekey") or []]
    name = morphism["name"]
    return {**morphism, "name": f"{name}-inverse", "from": morphism["to"], "to": morphism["from"], "rekey": swap, "invertible": True, "inverted": not morphism.get("inverted", False)}


def units(seam: dict) -> int:
    return sum(p["share"] for p in seam["parts"])


def fuse(topology: DataFrame, seam: dict, ord_: int) -> DataFrame:
    """(topology, component, target, shape, keys, reason): split parts joined to the fused tensor along axis 0."""
    rows = topology if not seam.get("component") else topology.where(F.col("component") == seam["component"])
    choices = []
    for n, p in enumerate(seam["parts"]):
        regex = pattern_regex(p["key"])
        target = F.regexp_replace("key", regex, pattern_template(seam["target"]))
        choices.append(F.when(F.col("key").rlike(regex), F.struct(F.lit(n).alias("part"), target.alias("target"))))
    found = rows.withColumn("hit", F.explode(F.filter(F.array(*choices), lambda x: x.isNotNull()))).select("*", "hit.part", "hit.target")
    parts = F.array_sort(F.collect_list(F.struct("part", "key", "shape")))
    groups = found.groupBy("topology", "component", "target").agg(parts.alias("parts"))
    first = F.col("parts")[0]["shape"]
    tail = lambda s: F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0)))
    rows_ = F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + F.get(p["shape"], F.lit(0)))
    whole = units(seam) * int(seam.get("groups") or 1)
    reason = (
        F.when(F.size("parts") != len(seam["parts"]), "parts").when(F.exists("parts", lambda p: F.size(p["shape"]) != F.size(first)), "rank")
        .when(F.exists("parts", lambda p: tail(p["shape"]) != tail(first)), "inner").when(F.coalesce(rows_ % whole != 0, F.lit(True)), "shares")
    )
    return groups.select("topology", "component", "target", F.concat(F.array(rows_), tail(first)).alias("shape"), F.transform("parts", lambda p: p["key"]).alias("keys"), reason.alias("reason"), F.lit(ord_).alias("seam"))


def split(topology: DataFrame, seam: dict, ord_: int) -> DataFrame:
    """(topology, component, source, key, shape, reason): the fused tensor cut into its parts by share."""
    rows = topology if not seam.get("component") else topology.where(F.col("component") == seam["component"])
    regex, n = pattern_regex(seam["target"]), units(seam)
    rows = rows.where(F.col("key").rlike(regex)).withColumnRenamed("key", "source")
    first = F.get("shape", F.lit(0))
    whole = n * int(seam.get("groups") or 1)
    reason = F.when(F.size("shape") == 0, "scalar").when(first % whole != 0, "shares")
    tail = F.slice("shape", 2, F.greatest(F.size("shape") - 1, F.lit(0)))
    unit = F.call_function("div", first, F.lit(n).cast("long"))
    pieces = [F.struct(F.regexp_replace("source", regex, pattern_template(p["key"])).alias("key"), F.concat(F.array(unit * p["share"]), tail).alias("shape")) for p in seam["parts"]]
    return rows.withColumn("reason", reason).withColumn("p", F.explode(F.array(*pieces))).select("topology", "component", "source", "p.key", "p.shape", "reason", F.lit(ord_).alias("seam"))


def apply_morphism(topology: DataFrame, morphism: dict) -> DataFrame:
    """The topologies that the morphism makes of its sources; ``reason`` refuses a row: a seam's reason, or ``collision``
    where a seam's tensor meets one that survives. Islands of consumed tensors are dropped."""
    topology = topology.where(F.col("topology") == morphism["from"])
    made, consumed = [], []
    for n, seam in enumerate(morphism.get("seams") or []):
        if morphism.get("inverted"):
            s = split(topology, seam, n)
            made.append(s.select("topology", "component", "key", "shape", "reason"))
            consumed.append(s.where("reason is null").select("topology", "component", F.col("source").alias("key")))
        else:
            s = fuse(topology, seam, n)
            made.append(s.select("topology", "component", F.col("target").alias("key"), "shape", "reason"))
            consumed.append(s.where("reason is null").select("topology", "component", F.explode("keys").alias("key")))
    rest = topology
    for c in consumed:
        rest = rest.join(c.distinct(), ["topology", "component", "key"], "left_anti")
    kept = rest.select("topology", "component", "component_ord", "role", rekey(F.col("key"), morphism.get("rekey") or []).alias("key"), "shape", "island", "dtype", F.lit(None).cast("string").alias("reason"))
    if made:
        names = topology.groupBy("topology", "component").agg(F.first("component_ord").alias("component_ord"), F.first("role").alias("role"), F.first("dtype").alias("dtype"))
        new = reduce(DataFrame.unionByName, made).join(names, ["topology", "component"])
        clash = new.join(kept.select("topology", "component", "key").distinct().withColumn("clash", F.lit(True)), ["topology", "component", "key"], "left")
        new = clash.select("topology", "component", "component_ord", "role", "key", "shape", F.lit(None).cast("string").alias("island"), "dtype", F.coalesce("reason", F.when(F.col("clash"), "collision")).alias("reason"))
        kept = kept.unionByName(new)
    return kept.withColumn("topology", F.lit(morphism["to"]))


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """(component, key, reason) where two topologies differ in components, keys or shapes; roles, islands and types aside."""
    a = left.select("component", "key", F.col("shape").alias("ls"))
    b = right.select("component", "key", F.col("shape").alias("rs"))
    reason = F.when(F.col("ls").isNull(), "only-right").when(F.col("rs").isNull(), "only-left").when(F.col("ls") != F.col("rs"), "shape")
    return a.join(b, ["component", "key"], "full").select("component", "key", reason.alias("reason")).where("reason is not null")
