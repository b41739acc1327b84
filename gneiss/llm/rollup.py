"""Token counts as delta-maintained rollups.

Inserts, deletes and revised counts become signed deltas, summed by source, language and tokenizer version before they are
stored. A batch is committed by its name, once: its sums are written to a folder of their own, then a marker is put beside
those of the name; of several markers (two jobs at a time, a job run again) the least counts, so a batch can't count twice
whatever fails, and no move has to be atomic. Totals add up all batches; compaction folds batches into one file that keeps
their names.

Cases: a null text has 0 tokens, and an empty one; null sources, languages and versions are groups of their own; a change
whose operation is null or unknown, or whose count is null, adds nothing to what it lacks (a missing count is 0; a missing
operation makes the row no change); repeated rows count each; totals that come to nothing disappear; an empty batch is
committed and adds nothing; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import at_exit, materialize, raw_bytes, shared_dir, small, small_batches, texts_of

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TOXIC_SOURCE = "toxic"
KEYS = ("source", "lang", "version")
SCHEMA = "batch string, source string, lang string, version string, docs long, tokens long"


@functools.lru_cache(maxsize=4)
def encoding(path: str):
    """The byte-level tokenizer whose ranks are in a file that every node has."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path.rsplit("/", 1)[-1], pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(docs: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """doc_id, source, lang, tokens of every row of ``docs`` (doc_id, text, lang, source), and the bytes of its text."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path).encode_ordinary
        for batch in batches:
            n = np.array([len(encode(t)) if t else 0 for t in texts_of(batch.column(3))], np.int64)
            size = np.diff(raw_bytes(batch.column(3))[1])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n), pa.array(size)], ["doc_id", "source", "lang", "tokens", "bytes"])

    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("source").cast("string"), F.col("lang").cast("string"), "text").mapInArrow(f, f"doc_id {kind}, source string, lang string, tokens long, bytes long")


def deltas(changes: DataFrame) -> DataFrame:
    """Signed sums by source, language and version of ``changes`` (op: insert, delete or revise; source, lang, version,
    tokens; old_tokens, that of a revision before)."""
    op = F.lower("op")
    tokens, old = F.coalesce("tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0)) if "old_tokens" in changes.columns else F.lit(0)
    docs = F.when(op == "insert", 1).when(op == "delete", -1).otherwise(0)
    change = F.when(op == "insert", tokens).when(op == "delete", -tokens).when(op == "revise", tokens - old).otherwise(0)
    out = changes.groupBy(*KEYS).agg(F.sum(docs).cast("long").alias("docs"), F.sum(change).cast("long").alias("tokens"))
    return out.where("docs <> 0 or tokens <> 0")


class Rollup:
    """Totals in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or f"{shared_dir(spark)}/gneiss-{spark.sparkContext.applicationId}/rollup-{uuid.uuid4().hex}"
        if path is None:
            at_exit(spark, self.path)
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _name(self, batch: str) -> str:
        return "batch-" + base64.urlsafe_b64encode(batch.encode()).decode()

    def _list(self, path: str) -> list[str]:
        """Names in a folder, ascending; none if it isn't there."""
        at = self._path(path)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _markers(self, batch: str) -> list[str]:
        return self._list(f"{self.path}/done/{self._name(batch)}")

    def names(self) -> set[str]:
        """Names of the committed batches."""
        found = (base64.urlsafe_b64decode(n[6:]).decode() for n in self._list(f"{self.path}/done") if n.startswith("batch-"))
        return {n for n in found if self._markers(n)}

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Adds a batch of changes; False if one of this name is there already. The marker is the commit."""
        if self._markers(batch):
            return False
        own = uuid.uuid4().hex
        deltas(changes).select(F.lit(batch).alias("batch"), *KEYS, "docs", "tokens").write.parquet(f"{self.path}/data/{self._name(batch)}/{own}")
        self._fs.mkdirs(self._path(f"{self.path}/done/{self._name(batch)}"))
        self._fs.createNewFile(self._path(f"{self.path}/done/{self._name(batch)}/{own}"))
        return self._markers(batch)[0] == own

    def _folded(self) -> int:
        """The newest fold; 0 for none."""
        return max(map(int, self._list(f"{self.path}/folded")), default=0)

    def _inside(self, fold: int) -> set[str]:
        """The batches that a fold holds."""
        return {r[0] for r in self.spark.read.parquet(f"{self.path}/folded/{fold}/names").collect()} if fold else set()

    def _rows(self, names: set[str]) -> DataFrame:
        """Deltas of these committed batches: the newest fold, and the batches that it doesn't hold."""
        fold = self._folded()
        done = [f"{self.path}/data/{self._name(b)}/{self._markers(b)[0]}" for b in sorted(names - self._inside(fold))]
        parts = [self.spark.read.schema(SCHEMA).parquet(*done)] if done else []
        if fold:
            parts.append(self.spark.read.schema(SCHEMA).parquet(f"{self.path}/folded/{fold}/totals"))
        out = parts[0] if parts else self.spark.createDataFrame([], SCHEMA)
        return out.unionByName(parts[1]) if len(parts) == 2 else out

    def totals(self, names: set[str] | None = None) -> DataFrame:
        """source, lang, version, docs, tokens over all committed batches."""
        out = self._rows(self.names() if names is None else names).groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return out.where("docs <> 0 or tokens <> 0")

    def compact(self) -> None:
        """Folds all batches that are committed now into one. The fold is moved into place with the names of its batches, so
        whatever fails, each batch counts once; only then the batches' files go. Commits may run beside it, but no other
        compaction."""
        names, last = self.names(), self._folded()
        aside = f"{self.path}/aside/{uuid.uuid4().hex}"
        self.totals(names).select(F.lit(None).cast("string").alias("batch"), *KEYS, "docs", "tokens").write.parquet(f"{aside}/totals")
        self.spark.createDataFrame([(n,) for n in sorted(names)], "name string").coalesce(1).write.parquet(f"{aside}/names")
        self._fs.mkdirs(self._path(f"{self.path}/folded"))
        self._fs.rename(self._path(aside), self._path(f"{self.path}/folded/{last + 1}"))
        for n in names:
            self._fs.delete(self._path(f"{self.path}/data/{self._name(n)}"), True)
        if last:
            self._fs.delete(self._path(f"{self.path}/folded/{last}"), True)


def ingest(docs: DataFrame, toxic: DataFrame, rollup: Rollup, path: str = TOKENIZER) -> None:
    """Three batches over ``docs`` (doc_id, text, lang, source): ``arrivals`` inserts every document with a guess, a token for
    four bytes; ``counts`` revises the guess to the count; ``moves`` takes the documents of ``toxic`` (doc_id, distinct) out of
    their source and puts them into that of TOXIC_SOURCE. Each is sent twice, as after a failure."""
    version = F.lit(path.rsplit("/", 1)[-1]).alias("version")
    counted = materialize(count_tokens(docs, path).withColumn("guess", F.floor(F.col("bytes") / 4).cast("long")).drop("bytes"), "counted")
    moved = toxic.select("doc_id").withColumn("moved", F.lit(True))
    rows = counted.join(small(moved, moved.count(), 1_000_000), "doc_id", "left")
    arrivals = counted.select(F.lit("insert").alias("op"), "source", "lang", version, F.col("guess").alias("tokens"))
    counts = counted.select(F.lit("revise").alias("op"), "source", "lang", version, "tokens", F.col("guess").alias("old_tokens"))
    gone = rows.where("moved").select("source", "lang", "tokens")
    ops = F.explode(F.array(*(F.struct(F.lit(op).alias("op"), s.alias("source")) for op, s in (("delete", F.col("source")), ("insert", F.lit(TOXIC_SOURCE))))))
    moves = gone.withColumn("o", ops).select("o.op", "o.source", "lang", version, "tokens")
    for name, batch in (("arrivals", arrivals), ("counts", counts), ("moves", moves)) * 2:
        rollup.commit(name, batch)


def op7_tokens(spark, sf_dir: str) -> DataFrame:
    """Documents and tokens by source, language and tokenizer version, toxic documents apart, by way of committed batches of
    inserts, revised counts and deletes. The tokenizer's file is ``spark.gneiss.tokenizer``, if that is set."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rollup = Rollup(spark)
    toxic = labels.where("toxic > 0 and doc_id is not null").select("doc_id").distinct()
    ingest(spark.read.parquet(f"{sf_dir}/documents.parquet"), toxic, rollup, spark.conf.get("spark.gneiss.tokenizer", TOKENIZER))
    return rollup.totals()
