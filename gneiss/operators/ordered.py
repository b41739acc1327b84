"""Running sums and neighbours over sorted groups of any size, and lineage cut in the folder that all executors share.

A window over a group sorts the whole group in one task. Here rows are sorted by range, so a group may lie in many
partitions; each partition sums its own part of a group, a row for each part carries these sums on, and both are added up.
"""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def checkpoint(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in ``spark.checkpoint.dir``; only where the session has none (a local run or a test) a temporary
    folder takes its place."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        at = context.getConf().get("spark.checkpoint.dir") or df.sparkSession.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(at or "file://" + tempfile.mkdtemp(prefix="gneiss-"))
    return df.checkpoint()


def large(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that grows with the input, so that the join sorts both sides. Spark's estimate starts from
    compressed files and counts neither what is unpacked nor what rows explode into; it would send such a table to the driver."""
    return df.hint("merge")


def few(df: DataFrame, most: int = 100_000) -> DataFrame:
    """``df``, which is a checkpoint, as a side of a join that is sent to all tasks if it was counted to be small, and is
    ``large`` otherwise."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else large(df)


def running(rows: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column] | None = None, lags: dict[str, Column] | None = None) -> DataFrame:
    """``rows`` with, for each of ``sums``, the sum of its values over the rows before in the group (0 for the first), and for
    each of ``lags`` the value of the row before (null for the first). Rows that are equal in ``order`` come in any order.
    Null keys are a group; an empty table gives an empty result."""
    sums, lags = sums or {}, lags or {}
    own = rows.select("*", *(v.alias(f"_s_{n}") for n, v in sums.items()), *(v.alias(f"_l_{n}") for n, v in lags.items()))
    own = own.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    own = checkpoint(own.select("*", F.monotonically_increasing_id().alias("_at"))).withColumn("_p", F.shiftright("_at", 33))
    inside = Window.partitionBy("_p", *keys).orderBy("_at")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = own.select("*", *(F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(n) for n in sums), *(F.lag(f"_l_{n}").over(inside).alias(n) for n in lags), (F.row_number().over(inside) == 1).alias("_first"))
    parts = own.groupBy("_p", *keys).agg(F.count("*").alias("_n"), *(F.sum(f"_s_{n}").alias(f"_t_{n}") for n in sums), *(F.max_by(f"_l_{n}", "_at").alias(f"_e_{n}") for n in lags))
    along = Window.partitionBy(*keys).orderBy("_p")  # a row a partition at most
    upto = along.rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select(F.col("_p").alias("_q"), *(F.col(k).alias(f"_k_{k}") for k in keys), *(F.coalesce(F.sum(f"_t_{n}").over(upto), F.lit(0)).alias(f"_c_{n}") for n in sums), *(F.lag(f"_e_{n}").over(along).alias(f"_c_{n}") for n in lags))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], F.col("_p") == F.col("_q"))
    joined = local.join(carried, same)
    added = [(F.col(n) + F.col(f"_c_{n}")).alias(n) for n in sums] + [F.when(F.col("_first"), F.col(f"_c_{n}")).otherwise(F.col(n)).alias(n) for n in lags]
    return joined.select(*rows.columns, *added)
