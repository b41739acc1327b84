"""Mixing sources to target weights by capped water-filling.

Each source asks for its share of a word budget by weight; no source may be repeated more than ``epochs`` times, and what
a capped source can't take is shared among the others by weight until nobody is above the cap. A source's target is
taken as whole repetitions of all its texts and one fractional repetition: the texts in the order of a seeded hash,
until the target is full, the text at the edge in part. So every source meets its target to the word, the same on each run.

Cases: a null text has 0 words and takes 0; a null source is a source of its own, the last; a source without words has
target 0; an empty table gives an empty result; the hash is of id and text, and repeated rows are rows of their own;
columns beside those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, n_words, small

OWN = frozenset("doc_id source size source_size target taken".split())
BUCKET = 4  # hex digits of the hash that make a bucket: 65,536 buckets a source


def ranked_sources(totals: DataFrame, weights: tuple[float, ...]) -> tuple[DataFrame, int]:
    """(source, source_size, weight), weights cycling over the sources by code point, null last; and how many there are.

    The rank needs no single task: a range-partitioned sort, and offsets from the row count of each partition."""
    ordered = materialize(totals.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()), "sources")
    part = F.shiftright("at", 33)
    counts = sorted((r[0], r[1]) for r in ordered.groupBy(part.alias("p")).count().collect())  # a row a partition
    before, total = [], 0
    for p, n in counts:
        before.append((p, total))
        total += n
    offsets = ordered.sparkSession.createDataFrame(before or [(0, 0)], "p long, before long")
    rank = F.col("at").bitwiseAND((1 << 33) - 1) + F.col("before")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    out = ordered.withColumn("p", part).join(F.broadcast(offsets), "p")
    return out.select("source", "source_size", F.get(cycle, (rank % len(weights)).cast("int")).alias("weight")), total


def water_fill(sources: DataFrame, share: float, epochs: float) -> DataFrame:
    """Adds target: the source's share of ``share`` times all words, at most ``epochs`` times its size.

    Round by round, the sources above their cap are clamped, and the level rises for the rest; only sums reach the driver."""
    cap = F.col("source_size") * F.lit(float(epochs))
    all_words, all_weight = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    if not all_words:
        return sources.withColumn("target", F.lit(0.0))
    budget = min(float(all_words) * share, float(all_words) * epochs)
    level, clamped = budget / all_weight, 0
    while True:
        full = cap <= F.col("weight") * F.lit(level)
        n, words, weight = sources.agg(F.count_if(full), F.sum(F.when(full, F.col("source_size"))), F.sum(F.when(~full, F.col("weight")))).first()
        if n == clamped or not weight:
            break
        clamped, level = n, (budget - float(words or 0) * epochs) / weight
    return sources.withColumn("target", F.when(cap <= F.col("weight") * F.lit(level), cap).otherwise(F.col("weight") * F.lit(level)))


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, epochs: float = 2.0, seed: int = 17, whole_rows: bool = False) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every row of ``docs`` (doc_id, source, text); with
    ``whole_rows`` its other columns too, but for those with a name that the plan uses itself."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))).cast("binary"))
    rows = materialize(docs.select("doc_id", "source", n_words().alias("size"), key.alias("h")), "sizes")
    others = [c for c in docs.columns if whole_rows and c.lower() not in OWN]
    if whole_rows:
        read = docs.select("doc_id", "source", n_words().alias("size"), key.alias("h"), *([F.struct(*(f"`{c}`" for c in others)).alias("row")] if others else []))
    else:
        read = rows
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources, n = ranked_sources(totals, weights)
    sources = materialize(water_fill(sources, share, epochs), "targets")
    goal = F.floor("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(goal / F.greatest("source_size", F.lit(1)))).otherwise(0).cast("long")
    plan = sources.withColumn("whole", whole).withColumn("rest", goal - F.col("whole") * F.col("source_size"))
    # Words by hash bucket, then the bucket in which each source's fractional repetition ends.
    bucket = F.substring("h", 1, BUCKET)
    by_bucket = rows.groupBy("source", bucket.alias("b")).agg(F.sum("size").alias("words"))
    w = Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sides = by_bucket.withColumnRenamed("source", "s")
    edge = (
        sides.withColumn("upto", F.sum("words").over(w))
        .join(small(plan.select(F.col("source").alias("s2"), "rest"), n), F.col("s").eqNullSafe(F.col("s2")))
        .where("upto > rest and upto - words <= rest")
        .groupBy("s")
        .agg(F.min_by("b", "b").alias("edge"), F.min_by(F.col("upto") - F.col("words"), "b").alias("done"))
    )
    plan = materialize(plan.join(small(edge, n), F.col("source").eqNullSafe(F.col("s")), "left").drop("s"), "plan")
    d = read.withColumn("b", bucket).join(small(plan.withColumnRenamed("source", "s"), n), F.col("source").eqNullSafe(F.col("s")))
    plain = d.where("edge is null or b <> edge").withColumn("extra", F.when(F.col("edge").isNull() | (F.col("b") < F.col("edge")), F.when(F.col("rest") > 0, F.col("size")).otherwise(0)).otherwise(0))
    inner = Window.partitionBy("source").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.col("done") + F.sum("size").over(inner) - F.col("size")
    at_edge = d.where("b = edge").withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - before)))
    columns = ["doc_id", "source", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("extra")).cast("long").alias("taken"), *(F.col("row")[c].alias(c) for c in others)]
    return plain.select(*columns).unionByName(at_edge.select(*columns))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('17:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS h FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS weight
  FROM d GROUP BY source),
r AS (
  SELECT *, 2.0 * source_size / weight AS ratio, sum(2.0 * source_size) OVER o - 2.0 * source_size AS capped_before,
         sum(weight) OVER () - (sum(weight) OVER o - weight) AS weight_left, 1.5 * sum(source_size) OVER () AS budget
  FROM s WINDOW o AS (ORDER BY 2.0 * source_size / weight, source ROWS UNBOUNDED PRECEDING)),
l AS (SELECT arg_min((budget - capped_before) / weight_left, ratio) AS level FROM r WHERE (budget - capped_before) / weight_left < ratio),
t AS (SELECT source, source_size, CASE WHEN source_size = 0 THEN 0.0 ELSE least(2.0 * source_size, weight * (SELECT level FROM l)) END::DOUBLE AS target FROM s),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS whole FROM t),
c AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.whole, floor(p.target)::BIGINT - p.whole * p.source_size AS rest,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS before
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM c
"""


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    """The 150 % mix of all documents, weights 3, 1, 2 over the sources, two epochs at most."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")
