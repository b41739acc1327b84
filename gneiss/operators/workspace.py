"""Workspaces and snapshots as versioned tables: trees, generations, seals, leases, and what they root.

A table is a folder of versions and a pointer to the current one: a change writes a new version aside and swaps the pointer,
so readers see either all of it or nothing, and a failed job leaves the old version.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.operators import store


class Moved(RuntimeError):
    """The table moved on since it was read."""


class VersionedTable:
    """A Parquet table with one writer at a time by compare-and-swap on its version."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.path}/versions"))

    def version(self) -> int:
        """The newest committed version; 0 for none."""
        names = (s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.path}/versions")))
        return max((int(n) for n in names if n.isdigit()), default=0)

    def read(self, version: int | None = None) -> DataFrame:
        v = self.version() if version is None else version
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/versions/{v}") if v else self.spark.createDataFrame([], self.schema)

    def swap(self, rows: DataFrame, expected: int) -> int:
        """Commits ``rows`` as the version after ``expected``; a rename that doesn't overwrite is the commit."""
        aside = f"{self.path}/aside/{uuid.uuid4().hex}"
        rows.write.parquet(aside)
        final = self._path(f"{self.path}/versions/{expected + 1}")
        if self.version() != expected or self._fs.exists(final) or not self._fs.rename(self._path(aside), final):
            self._fs.delete(self._path(aside), True)
            raise Moved(f"{self.path}: version {self.version()}, not {expected}")
        return expected + 1


TREE = "workspace string, path string, value string, generation bigint"
SNAPSHOTS = "id string, parent string, path string, digest string, size bigint"
LEASES = "lease string, kind string, digest string"


class Workspaces:
    """Named mutable trees, the snapshots sealed from them, and leases that pin objects."""

    def __init__(self, spark: SparkSession, path: str):
        self.heads = VersionedTable(spark, f"{path}/heads", TREE)
        self.snapshots = VersionedTable(spark, f"{path}/snapshots", SNAPSHOTS)
        self.leases = VersionedTable(spark, f"{path}/leases", LEASES)

    def commit(self, log: DataFrame, expected: int) -> int:
        """Applies ordered mutations (workspace, ord, op, path, arg) on the heads of version ``expected``; a workspace's tree
        is replayed as puts before them."""
        heads = self.heads.read(expected)
        before = heads.select("workspace", F.lit(-1).cast("long").alias("ord"), F.lit("put").alias("op"), "path", F.col("value").alias("arg"))
        touched = log.select("workspace").distinct()
        replay = before.join(touched, "workspace", "left_semi").unionByName(log.select("workspace", F.col("ord").cast("long").alias("ord"), "op", "path", "arg"))
        generation = heads.groupBy("workspace").agg(F.max("generation").alias("g"))
        after = store.fold_mutations(replay).select("workspace", "path", "value").join(generation, "workspace", "left")
        after = after.select("workspace", "path", "value", (F.coalesce("g", F.lit(0)) + 1).alias("generation"))
        return self.heads.swap(heads.join(touched, "workspace", "left_anti").unionByName(after), expected)

    def seal(self, workspace: str, objects: DataFrame, parent: str | None, expected: int) -> str:
        """Seals a workspace's tree, whose values are digests of resident objects (digest, size), as a snapshot; its id is the
        SHA-256 of its paths and digests. Refuses a tree with an object that isn't resident."""
        tree = self.heads.read().where((F.col("workspace") == workspace) & F.col("value").isNotNull()).select("path", F.col("value").alias("digest"))
        rows = tree.join(objects.select("digest", "size"), "digest", "left").cache()
        if not rows.where("size is null").isEmpty():
            raise ValueError("absent-object")
        line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "digest"))), lambda x: F.concat_ws(" ", x["path"], x["digest"])), "\n")
        ident = rows.agg(F.sha2(F.concat_ws("\n", F.lit(parent or ""), line), 256)).first()[0]
        known = self.snapshots.read(expected)
        if known.where(F.col("id") == ident).isEmpty():
            self.snapshots.swap(known.unionByName(rows.select(F.lit(ident).alias("id"), F.lit(parent).cast("string").alias("parent"), "path", "digest", F.col("size").cast("long"))), expected)
        rows.unpersist()
        return ident

    def clone(self, snapshot: str, workspace: str, expected: int) -> int:
        """A new workspace with a snapshot's tree."""
        entries = self.snapshots.read().where(F.col("id") == snapshot)
        log = entries.select(F.lit(workspace).alias("workspace"), F.monotonically_increasing_id().alias("ord"), F.lit("put").alias("op"), "path", F.col("digest").alias("arg"))
        return self.commit(log, expected)

    def drop_snapshot(self, snapshot: str, expected: int) -> int:
        return self.snapshots.swap(self.snapshots.read(expected).where(F.col("id") != snapshot), expected)

    def lease(self, name: str, digests: DataFrame, expected: int, kind: str = "pending-sync") -> int:
        """Pins objects until the lease is released."""
        return self.leases.swap(self.leases.read(expected).unionByName(digests.select(F.lit(name).alias("lease"), F.lit(kind).alias("kind"), "digest")), expected)

    def release(self, name: str, expected: int) -> int:
        return self.leases.swap(self.leases.read(expected).where(F.col("lease") != name), expected)

    def marks(self) -> DataFrame:
        """(root, digest): all heads are one root, all leases one, each snapshot one; an empty blob is nothing to reach."""
        heads = self.heads.read().select(F.lit("heads").alias("root"), F.col("value").alias("digest"))
        leases = self.leases.read().select(F.lit("leases").alias("root"), "digest")
        snapshots = self.snapshots.read().where("size > 0").select(F.col("id").alias("root"), "digest")
        return store.mark(heads, leases, snapshots)
