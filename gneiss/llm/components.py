"""Connected components of a graph of long ids."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

LOCAL_EDGES = 500_000  # 8 MB: up to so many counted edges the driver labels them itself


def connected_components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(id, component) of every id in ``edges`` (a, b), component being its least id. Nothing is collected beyond
    ``local_edges`` counted edges; there the star contraction runs as joins."""
    edges = edges.select("a", "b")
    if edges.count() <= local_edges:
        table = edges.toArrow()
        return edges.sparkSession.createDataFrame(_label(table.column("a").to_numpy(), table.column("b").to_numpy()))
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, "large")
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array("v", "u")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = materialize(small, "small")
        same = small.count() == now.count() and small.exceptAll(now).isEmpty()
        now = small
        if same:
            break
    roots = now.select(F.col("v").alias("id")).distinct().withColumn("component", F.col("id"))
    alone = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(now.select(F.col("u").alias("id")), "id", "left_anti").withColumn("component", F.col("id"))
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots).unionByName(alone).distinct()


def _label(a: np.ndarray, b: np.ndarray) -> pa.Table:
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(ids))
    while True:
        new = label.copy()
        np.minimum.at(new, x, label[y])
        np.minimum.at(new, y, label[x])
        np.minimum.at(new, label, new)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return pa.table({"id": pa.array(ids, pa.int64()), "component": pa.array(ids[label] if len(ids) else ids, pa.int64())})
