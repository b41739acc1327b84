"""Serving one layout from bytes of another: seam contracts, runs by role, view or conversion, and permutations of axes.

A contract is a dict: tensors [{role, pattern, dtypes, rank, required, fusion, permute}] and sets of patterns. Two contracts
that describe the same weights agree in roles, whatever they call the tensors.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gneiss.operators.morphisms import pattern_regex, pattern_template


def contract_refusal(contract: dict) -> str | None:
    """Why a contract isn't one; None if it is."""
    named = [contract.get("name"), contract.get("version")]
    if (named[0] is None) != (named[1] is None):
        return "half-identity"
    roles = [t["role"] for t in contract["tensors"]]
    patterns = [t["pattern"] for t in contract["tensors"]]
    if len(set(roles)) != len(roles):
        return "duplicate-role"
    if len(set(patterns)) != len(patterns):
        return "duplicate-pattern"
    for t in contract["tensors"]:
        if t["pattern"].count("{i}") != t["role"].count("{i}"):
            return "holes"
        if "{i}{i}" in t["pattern"]:
            return "ambiguous-pattern"
        f = t.get("fusion")
        if f and (f.get("axis", 0) != 0 or not f["parts"] or any(int(p["share"]) < 1 for p in f["parts"]) or int(f.get("groups") or 1) < 1):
            return "fusion"
        p = t.get("permute")
        if p and sorted(p["axes"]) != list(range(len(p["view"]))):
            return "permute"
    return None


def role_runs(tensors: DataFrame, contract: dict) -> DataFrame:
    """(artifact, role, name, dtype, offset, length, rows, row_shape, permute, reason): each byte run of tensors (artifact,
    name, dtype, shape, offset, length) by its role; a fused tensor has a run for each group and part, ``role#part@group``.
    ``reason`` is ``rows`` where a run isn't a whole number of rows, ``duplicate-role`` where two carry one role."""
    entry = F.when(F.lit(False), F.lit(0))
    role = F.when(F.lit(False), F.lit(""))
    for n, t in enumerate(contract["tensors"]):
        regex = pattern_regex(t["pattern"])
        hit = F.col("name").rlike(regex)
        entry = entry.when(hit, F.lit(n))
        role = role.when(hit, F.regexp_replace("name", regex, pattern_template(t["role"])))
    cuts, permutes = [], []
    whole = F.array(F.struct(F.lit("").alias("suffix"), F.lit(0).cast("long").alias("before"), F.lit(1).cast("long").alias("share"), F.lit(1).cast("long").alias("units")))
    for t in contract["tensors"]:
        f = t.get("fusion")
        spans, at = [], 0
        if f:
            groups = int(f.get("groups") or 1)
            units = groups * sum(int(p["share"]) for p in f["parts"])
            for g in range(groups):
                for p in f["parts"]:
                    spans.append(F.struct(F.lit(f"#{p['role']}@{g}").alias("suffix"), F.lit(at).cast("long").alias("before"), F.lit(int(p["share"])).cast("long").alias("share"), F.lit(units).cast("long").alias("units")))
                    at += int(p["share"])
        cuts.append(F.array(*spans) if spans else whole)
        permutes.append(F.lit(",".join(map(str, t["permute"]["axes"])) if t.get("permute") else None).cast("string"))
    rows = tensors.withColumn("entry", entry).where("entry is not null").withColumn("base", role)
    rows = rows.withColumn("run", F.explode(F.get(F.array(*cuts), F.col("entry"))))
    outer = F.greatest(F.coalesce(F.get("shape", F.lit(0)), F.lit(1)), F.lit(1))
    div = lambda a, b: F.call_function("div", a, b)
    unit, row_bytes = div(F.col("length"), F.col("run.units")), div(F.col("length"), outer)
    length = F.col("run.share") * unit
    good = (F.col("length") % F.col("run.units") == 0) & (row_bytes > 0) & (F.try_mod(length, F.nullif(row_bytes, F.lit(0).cast("long"))) == 0)
    out = rows.select(
        "artifact", F.concat("base", "run.suffix").alias("role"), "name", "dtype", (F.col("offset") + F.col("run.before") * unit).alias("offset"), length.alias("length"), div(length, F.nullif(row_bytes, F.lit(0).cast("long"))).alias("rows"),
        F.slice("shape", 2, F.greatest(F.size("shape") - 1, F.lit(0))).alias("row_shape"), F.get(F.array(*permutes), F.col("entry")).alias("permute"), F.when(~F.coalesce(good, F.lit(False)), "rows").alias("why"),
    )
    # A window and no join: a tensor makes many runs, which Spark's estimate doesn't count, so it would broadcast them.
    twice = F.count("*").over(Window.partitionBy("artifact", "role")) > 1
    return out.where("artifact is not null").withColumn("reason", F.coalesce("why", F.when(twice, "duplicate-role"))).drop("why")


def decide(source: DataFrame, target: DataFrame) -> DataFrame:
    """(artifact, decision, role): whether the runs of a source (``role_runs``) serve a target (artifact, role, dtype, length,
    permute, required): ``run-preserving``, ``rearranged`` where some run's axes differ, or ``conversion`` with the first
    role that is missing, orphaned, or of another type or length."""
    s = source.select("artifact", "role", F.col("dtype").alias("sd"), F.col("length").alias("sl"), F.col("permute").alias("sp"), F.lit(True).alias("there"))
    t = target.select("artifact", "role", "dtype", "length", "permute", "required", F.lit(True).alias("wanted"))
    rows = s.join(t, ["artifact", "role"], "full")
    bad = (F.col("there").isNull() & F.col("required")) | F.col("wanted").isNull() | (F.col("there") & F.col("wanted") & ((F.col("sd") != F.col("dtype")) | (F.col("sl") != F.col("length"))))
    moved = F.col("there") & F.col("wanted") & ~F.col("sp").eqNullSafe(F.col("permute"))
    # First by the bad role, which is null for most: the least text of all rows would be had by sorting them in each task.
    out = rows.groupBy("artifact", F.when(F.coalesce(bad, F.lit(False)), F.col("role")).alias("bad")).agg(F.max(F.coalesce(moved, F.lit(False))).alias("moved"))
    out = out.groupBy("artifact").agg(F.min("bad").alias("bad"), F.max("moved").alias("moved"))
    return out.select("artifact", F.when(F.col("bad").isNotNull(), "conversion").when(F.col("moved"), "rearranged").otherwise("run-preserving").alias("decision"), F.col("bad").alias("role"))


def resolve_view(shape: list[int], view: list[str | int]) -> list[int] | None:
    """The dimensions of a view of a shape; one may be ``auto``. None if it doesn't fit."""
    total = int(np.prod(shape))
    known = int(np.prod([int(v) for v in view if v != "auto"])) if any(v != "auto" for v in view) else 1
    autos = sum(v == "auto" for v in view)
    if autos > 1 or known == 0 or total % known or (not autos and known != total):
        return None
    return [total // known if v == "auto" else int(v) for v in view]


def permute_bytes(content: bytes, shape: list[int], view: list[str | int], axes: list[int], item: int, inverse: bool = False) -> bytes:
    """Elements of ``item`` bytes, seen as the view, their axes permuted (or back)."""
    dims = resolve_view(shape, view)
    if dims is None:
        raise ValueError("view")
    if inverse:
        back = list(np.argsort(axes))
        dims, axes = [dims[a] for a in axes], back
    return np.ascontiguousarray(np.frombuffer(content, np.dtype((np.void, item))).reshape(dims).transpose(axes)).tobytes()
