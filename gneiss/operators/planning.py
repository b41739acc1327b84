"""Cutting files into content-addressed objects: grids, seams, coverage, hashing; and pattern sets over an inventory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gneiss.functions.idents import digest
from gneiss.operators.morphisms import pattern_regex
from gneiss.operators.ordered import running

GRID = 64 << 20
SEAM_FLOOR = 1 << 20
MOST_OBJECTS = 1_000_000


def grid(domains: DataFrame, keys: list[str], step: int = GRID) -> DataFrame:
    """(keys, ord, offset, length): each domain (offset, length) cut on a grid that begins at its own start; domains without
    bytes have no regions."""
    starts = F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(step).cast("long"))
    rows = domains.where("length > 0").withColumn("at", F.explode(starts))
    return rows.select(*keys, F.call_function("div", F.col("at"), F.lit(step).cast("long")).alias("ord"), (F.col("offset") + F.col("at")).alias("offset"), F.least(F.lit(step).cast("long"), F.col("length") - F.col("at")).alias("length"))


def hash_regions(files: DataFrame, regions: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """Adds the SHA-256 of each region's bytes."""
    joined = regions.join(files.select(*keys, content), keys)
    piece = F.substr(F.col(content).cast("binary"), (F.col("offset") + 1).cast("int"), F.col("length").cast("int"))
    return joined.withColumn("digest", digest(piece)).drop(content)


def hash_grid(files: DataFrame, keys: list[str], step: int = GRID, content: str = "content") -> DataFrame:
    """(keys, ord, offset, length, digest) of each file on the grid in one pass, without a join: the pieces are cut where the
    bytes lie."""
    b = F.col(content).cast("binary")
    n = F.octet_length(b)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(step)))
    piece = lambda at: F.struct(at.cast("long").alias("offset"), F.least(F.lit(step), n - at).cast("long").alias("length"), F.sha2(F.substr(b, at + 1, F.lit(step)), 256).alias("digest"))
    out = files.select(*keys, F.posexplode(F.transform(starts, piece)).alias("ord", "o"))
    return out.select(*keys, F.col("ord").cast("long").alias("ord"), "o.offset", "o.length", "o.digest")


def coverage_refusals(regions: DataFrame, sizes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, reason) of the files whose regions don't cover them: ``start``, ``gap``, ``overlap``, ``empty``, ``size``, in
    this order."""
    rows = running(regions, keys, ["offset", "length"], {"place": F.lit(1)}, {"before": F.col("offset") + F.col("length")})
    rows = rows.withColumn("before", F.coalesce("before", F.lit(0))).withColumn("first", F.col("place") == 0)
    why = (
        F.when(F.col("first") & (F.col("offset") != 0), 1).when(F.col("offset") > F.col("before"), 2).when(F.col("offset") < F.col("before"), 3).when(F.col("length") <= 0, 4)
    )
    worst = rows.groupBy(*keys).agg(F.min(why).alias("why"), F.sum("length").alias("total"))
    reason = F.get(F.array(*map(F.lit, ("start", "gap", "overlap", "empty"))), F.col("why") - 1)
    out = sizes.join(worst, keys, "left").withColumn("reason", F.coalesce(reason, F.when(F.coalesce("total", F.lit(0)) != F.col("size"), "size")))
    return out.where("reason is not null").select(*keys, "reason")


def seam_cuts(tensors: DataFrame, entries: list[dict], keys: list[str]) -> DataFrame:
    """(keys, name, ord, offset, length): the runs into which the first entry that matches a tensor's name cuts it, by groups
    and shares along axis 0. A tensor with a run under the floor, or rows that don't divide, isn't cut at all."""
    entry = F.when(F.lit(False), F.lit(0))
    for n, e in enumerate(entries):
        entry = entry.when(F.col("name").rlike(pattern_regex(e["pattern"])), F.lit(n))
    rows = tensors.withColumn("entry", entry)
    cuts = []
    for e in entries:
        f = e.get("fusion")
        if not f:
            cuts.append(F.array().cast("array<struct<g:int,p:int,share:bigint,before:bigint>>"))
            continue
        spans, at = [], 0
        for g in range(int(f.get("groups") or 1)):
            for p, part in enumerate(f["parts"]):
                spans.append(F.struct(F.lit(g).alias("g"), F.lit(p).alias("p"), F.lit(int(part["share"])).cast("long").alias("share"), F.lit(at).cast("long").alias("before")))
                at += int(part["share"])
        cuts.append(F.array(*spans))
    total = F.when(F.lit(False), F.lit(0))
    for n, e in enumerate(entries):
        if e.get("fusion"):
            total = total.when(F.col("entry") == n, F.lit(sum(int(p["share"]) for p in e["fusion"]["parts"]) * int(e["fusion"].get("groups") or 1)))
    rows = rows.withColumn("units", total.cast("long")).withColumn("rows", F.get("shape", F.lit(0)))
    rows = rows.where((F.col("rows") % F.col("units") == 0) & (F.col("length") % F.col("units") == 0))
    rows = rows.withColumn("unit", F.call_function("div", F.col("length"), F.col("units"))).withColumn("cut", F.explode(F.get(F.array(*cuts), F.col("entry"))))
    out = rows.select(*keys, "name", (F.col("cut.before")).alias("before"), (F.col("offset") + F.col("cut.before") * F.col("unit")).alias("offset"), (F.col("cut.share") * F.col("unit")).alias("length"))
    least = out.groupBy(*keys, "name").agg(F.min("length").alias("least")).where(F.col("least") >= SEAM_FLOOR).drop("least")
    w = Window.partitionBy(*keys, "name").orderBy("offset")
    return out.join(least, [*keys, "name"]).withColumn("ord", F.row_number().over(w) - 1).select(*keys, "name", "ord", "offset", "length")


def set_members(tensors: DataFrame, patterns: list[str]) -> DataFrame:
    """The tensors that a named set of patterns holds."""
    return tensors.where(F.col("name").rlike("|".join(f"(?:{pattern_regex(p)})" for p in patterns)) if patterns else F.lit(False))


def offsets(length: Column, keys: list[str], *order: Column | str) -> Column:
    """Where each of a file's pieces begins."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(length).over(w), F.lit(0))
