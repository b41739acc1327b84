"""Exact top-k search by inner product with vector-approximation files.

Vectors become integers, floor(scale * x). ``index`` writes them once, with their approximation beside them: each component's
cell of 2**shift values, a byte, the shift being that of the vector (``cell_bits``, or more where its components are larger).
A search scans the cells alone, a block of queries at a time: they give an upper and a lower bound of every inner product,
and what can't be among the k best by these is left out, first in each partition, then over all. Exact vectors are then read
in the order of their bounds, once for all blocks, and scored until the k-th best is certain: no bound left reaches it.

Cases: vectors that are null, or hold null or non-finite components, and rows with a null id take no part; vectors of
different length don't meet; ties go to the smaller id; of query rows that repeat an id the least vector counts, and all
rows with the query's id are its own; repeated candidates are candidates each; scores beyond a long are cut to its ends;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, small, small_batches, trim

QUERY_ROWS = 16_384  # queries that go out at once
QUERY_BYTES = 8 << 20  # and bytes of their vectors, unless one query has more
BLOCK = 2_048
HELD = 2_000_000  # candidates of a partition before those that fell behind are dropped
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def integers(column: pa.Array, scale: float) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray]]]:
    """Rows that take part, and by vector length: (length, rows, integers as float64)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return np.zeros(0, bool), []
    kept = column.is_valid().to_numpy(zero_copy_only=False).copy()
    sizes = np.where(kept, column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0).astype(np.int64)
    values = column.flatten().cast(pa.float64())
    flat = values.to_numpy(zero_copy_only=False)  # null is NaN
    flat = np.floor(scale * flat)
    first = np.cumsum(sizes) - sizes
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    kept &= bad[first + sizes] == bad[first]
    groups = []
    for d in np.unique(sizes[kept]).tolist():
        rows = np.flatnonzero(kept & (sizes == d))
        groups.append((d, rows, flat[first[rows][:, None] + np.arange(d)]))
    return kept, groups


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, as integers; cut to the ends of a long."""
    if not q.size:
        return np.zeros(len(q), np.int64)
    if np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(1, q.shape[1]) < 2**53:
        return np.einsum("ij,ij->i", q, x).astype(np.int64)
    return np.array([max(_LEAST, min(_MOST, sum(int(a) * int(b) for a, b in zip(u, v)))) for u, v in zip(q, x)], np.int64)


def index(vectors: DataFrame, is_query: Column, scale: float = 256.0, cell_bits: int = 2) -> DataFrame:
    """The vector-approximation file of ``vectors`` (vec_id, embedding): row (its number), vec_id, is_query, shift, cells (a byte
    a component) and x (the integers), written to the shared folder; a scan of the cells doesn't read the integers."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for d, rows, x in integers(batch.column(2), scale)[1]:
                top = np.abs(x).max(1, initial=0)
                shift = np.maximum(cell_bits, np.frexp(top / 127)[1]).astype(np.int32)
                cells = np.floor(x / np.exp2(shift)[:, None]).astype(np.int8)
                at, n = pa.array(rows), len(rows)
                packed = pa.array([c.tobytes() for c in cells], pa.binary())
                values = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * d, pa.int32()), pa.array(x.ravel(), pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(number, number + n)), batch.column(0).take(at), batch.column(1).take(at), pa.array(shift), packed, values], ["row", "vec_id", "is_query", "shift", "cells", "x"])
                number += n
        trim()

    small_batches(vectors.sparkSession)
    rows = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long"), F.coalesce(is_query, F.lit(False)).alias("is_query"), "embedding")
    return materialize(rows.mapInArrow(f, "row long, vec_id long, is_query boolean, shift int, cells binary, x array<double>"), "approximation")


def bounds(q: np.ndarray, cells: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Upper and lower bounds of the inner products of queries and cells."""
    w = np.exp2(shift.astype(np.float64))
    exactly = np.abs(q).max(initial=0) * 128 * max(1, q.shape[1]) < 2**24
    kind = np.float32 if exactly else np.float64
    c = cells.astype(kind)
    with np.errstate(over="ignore", invalid="ignore"):
        corner = (q.astype(kind) @ c.T).astype(np.float64) * w
        # Beyond what a sum of doubles holds exactly, it is off by less than this.
        slack = 0.0 if exactly else np.linalg.norm(q, axis=1)[:, None] * (np.linalg.norm(cells.astype(np.float64), axis=1) * w)[None, :] * (max(1, q.shape[1]) * 2.0**-50)
        upper = corner + (w - 1)[None, :] * np.maximum(q, 0).sum(1)[:, None] + slack
        lower = corner + (w - 1)[None, :] * np.minimum(q, 0).sum(1)[:, None] - slack
    upper[np.isnan(upper)], lower[np.isnan(lower)] = np.inf, -np.inf
    return np.clip(upper, _LEAST, -_LEAST), np.clip(lower, _LEAST, -_LEAST)


class Candidates:
    """What may be among the k best of a block of queries, over cells that come in blocks."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, queries.astype(np.float64), k
        self.floor = np.full((len(ids), k), -np.inf)  # the k highest lower bounds so far
        self.kept: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, rows: np.ndarray, ids: np.ndarray, cells: np.ndarray, shift: np.ndarray) -> None:
        for i in range(0, len(ids), BLOCK):
            for j in range(0, len(self.ids), BLOCK):
                self._add(rows[i : i + BLOCK], ids[i : i + BLOCK], cells[i : i + BLOCK], shift[i : i + BLOCK], slice(j, j + BLOCK))
        if self.held > HELD:
            self.prune()

    def _add(self, rows: np.ndarray, ids: np.ndarray, cells: np.ndarray, shift: np.ndarray, part: slice) -> None:
        upper, lower = bounds(self.q[part], cells, shift)
        own = ids[None, :] == self.ids[part][:, None]
        upper[own] = lower[own] = -np.inf
        best = np.concatenate([self.floor[part], lower], 1)
        self.floor[part] = -np.partition(-best, self.k - 1, axis=1)[:, : self.k]
        a, b = np.nonzero((upper >= self.floor[part].min(1)[:, None]) & ~own)
        self.kept.append((a + part.start, rows[b], ids[b], upper[a, b], lower[a, b]))
        self.held += len(a)

    def prune(self) -> tuple[np.ndarray, ...]:
        """The candidates that haven't fallen behind: query, row, id, upper and lower bound."""
        if not self.kept:
            return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.float64, np.float64))
        a, rows, ids, upper, lower = (np.concatenate(x) for x in zip(*self.kept))
        keep = upper >= self.floor.min(1)[a]
        out = tuple(x[keep] for x in (a, rows, ids, upper, lower))
        self.kept, self.held = [out], len(out[0])
        return out


def search(file: DataFrame, k: int = 5, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): of an index's rows the k best of every query row."""
    queries = file.where("is_query").groupBy("vec_id").agg(F.min(F.struct(F.size("x").alias("d"), F.col("x").alias("x"))).alias("v"))
    queries = materialize(queries.select(F.col("vec_id").alias("query_id"), F.col("v.d").alias("d"), F.col("v.x").alias("q")), "queries")
    count, elements = queries.agg(F.count("*"), F.sum("d")).first()
    blocks = max(1, math.ceil(count / query_rows), math.ceil((elements or 0) * 8 / QUERY_BYTES))
    found = None
    for n in range(blocks):
        part = materialize(_scan(file, queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == n), k), "candidates")
        found = part if found is None else found.unionByName(part)
    # Over all partitions, what reaches the k-th lower bound; then exact vectors in the order of the upper bounds.
    by_floor = Window.partitionBy("query_id").orderBy(F.desc("lower"))
    least = found.withColumn("n", F.row_number().over(by_floor)).where(F.col("n") == k).select("query_id", F.col("lower").alias("least"))
    left = found.join(least, "query_id", "left").where("least is null or upper >= least").drop("least", "lower")
    left = materialize(left.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("upper"), "row"))), "left")
    # The 2 k with the highest bounds of each query are read first; of the others, those that may still pass the k-th of these.
    done = materialize(_read(left.where(F.col("n") <= 2 * k), file, queries, elements or 0), "scored")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = done.withColumn("rank", F.row_number().over(w)).where(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
    rest = materialize(left.where(F.col("n") > 2 * k).join(kth, "query_id", "left").where("kth is null or upper >= kth").drop("kth"), "rest")
    if not rest.isEmpty():
        done = done.unionByName(_read(rest, file, queries, elements or 0))
    return done.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _read(pairs: DataFrame, file: DataFrame, queries: DataFrame, elements: int) -> DataFrame:
    """The exact scores of these candidates."""
    vectors = file.select("row", "x").join(small(pairs.select("row").distinct(), pairs.count(), 1_000_000), "row", "left_semi")
    return _scored(pairs.join(small(queries.select("query_id", "q"), elements, 1_000_000), "query_id").join(vectors, "row"))


def _scored(pairs: DataFrame) -> DataFrame:
    """query_id, vec_id and the exact score of pairs of a query's and a candidate's integers."""

    def matrix(column: pa.Array, d: int) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
            for d in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == d))
                score = exact(matrix(part.column(2), d), matrix(part.column(3), d))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(score)], ["query_id", "vec_id", "score"])

    return pairs.select("query_id", "vec_id", "q", "x").mapInArrow(f, "query_id long, vec_id long, score long")


def _scan(file: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, row, vec_id, upper, lower of the candidates of a block of queries, by the cells of all rows."""
    table = queries.toArrow()
    sizes, ids = table.column("d").to_numpy(), table.column("query_id").to_numpy()
    flat = table.column("q").combine_chunks().flatten().to_numpy(zero_copy_only=False) if len(table) else np.zeros(0)
    first = np.cumsum(sizes) - sizes
    blocks = {d: (ids[sizes == d], flat[first[sizes == d][:, None] + np.arange(d)]) for d in np.unique(sizes).tolist()}
    sent = file.sparkSession.sparkContext.broadcast(blocks)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = {d: Candidates(who, q, k) for d, (who, q) in sent.value.items()}
        for batch in batches:
            cells = batch.column(3)
            sizes = np.diff(np.frombuffer(cells.buffers()[1], np.int32)[cells.offset : cells.offset + len(cells) + 1])
            for d in np.unique(sizes).tolist():
                if d in open_:
                    rows, ids, shift = (x.to_numpy() for x in batch.filter(pa.array(sizes == d)).columns[:3])
                    own = np.frombuffer(b"".join(cells.filter(pa.array(sizes == d)).to_pylist()), np.int8).reshape(len(rows), d)
                    open_[d].add(rows, ids, own, shift)
        for who, c in ((sent.value[d][0], c) for d, c in open_.items()):
            a, rows, ids, upper, lower = c.prune()
            for i in range(0, len(a), 100_000):
                at = slice(i, i + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(who[a[at]]), *map(pa.array, (rows[at], ids[at], upper[at], lower[at]))], ["query_id", "row", "vec_id", "upper", "lower"])
        trim()

    return file.select("row", "vec_id", "shift", "cells").mapInArrow(f, "query_id long, row long, vec_id long, upper double, lower double")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, cell_bits: int = 2, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): of ``vectors`` (vec_id, embedding) the k best candidates of every query row."""
    return search(index(vectors, is_query, scale, cell_bits), k, query_rows)


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op4_topk(spark, sf_dir: str) -> DataFrame:
    """The five nearest of every fiftieth embedding among all embeddings."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)
