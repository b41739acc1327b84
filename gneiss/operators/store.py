"""The store as tables: objects, roots, usage, collection by epochs, scrubbing, references, trees, records and mutations."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.functions.idents import digest
from gneiss.operators.ordered import checkpoint, running


def admit(objects: DataFrame, resident: DataFrame | None = None) -> DataFrame:
    """(digest, size, content) of the objects that the store doesn't hold yet, each once; admitting again changes nothing."""
    rows = objects.select(digest(F.col("content")).alias("digest"), F.octet_length(F.col("content").cast("binary")).cast("long").alias("size"), F.col("content")).dropDuplicates(["digest"])
    return rows if resident is None else rows.join(resident.select("digest"), "digest", "left_anti")


def admit_regions(files: DataFrame, regions: DataFrame, keys: list[str], resident: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The regions (keys, ord, offset, length) of files (keys, content) with their digests, and the objects that the store
    doesn't hold yet; each region is read where its file lies, on its own."""
    piece = F.substr(F.col("content").cast("binary"), (F.col("offset") + 1).cast("int"), F.col("length").cast("int"))
    cut = regions.join(files.select(*keys, "content"), keys).withColumn("content", piece)
    named = cut.select(*keys, "ord", "offset", "length", digest(F.col("content")).alias("digest"))
    return named, admit(cut.select("content"), resident)


def object_files(spark: SparkSession, path: str) -> DataFrame:
    """(digest, length, path) of the objects in a folder that are well named (two folders of two digits, then the digest);
    their content isn't read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("length"))
    name = F.regexp_extract("path", "/([0-9a-f]{2})/([0-9a-f]{2})/(\\1\\2[0-9a-f]{60})$", 3)
    return listed.withColumn("digest", name).where("digest <> ''").select("digest", "length", "path")


def remove_objects(spark: SparkSession, path: str, garbage: DataFrame, marks: DataFrame) -> DataFrame:
    """Deletes the files of ``garbage`` (digest) that no mark (digest) reaches, where the executors find them; (digest,
    removed). An object that is gone already counts as removed, so a repeated task does no harm."""
    found = object_files(spark, path).join(garbage.select("digest").distinct(), "digest").join(marks.select("digest").distinct(), "digest", "left_anti")

    def f(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for p in pdf["path"]:
                fs, at = arrow_fs.FileSystem.from_uri(p)
                if fs.get_file_info(at).type != arrow_fs.FileType.NotFound:
                    fs.delete_file(at)
            yield pdf[["digest"]].assign(removed=True)

    return found.select("digest", "path").mapInPandas(f, "digest string, removed boolean")


def reap(spark: SparkSession, path: str, older_than: float, leased: DataFrame) -> DataFrame:
    """(path, reaped): temporary files in a folder that were last changed ``older_than`` seconds ago or before and whose path
    isn't ``leased`` (path) are deleted; the age is looked at again where the file is."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "modificationTime")
    old = listed.where(F.col("modificationTime") <= F.current_timestamp() - F.make_dt_interval(secs=F.lit(float(older_than)))).join(leased.select("path"), "path", "left_anti")

    def f(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            gone = []
            for p in pdf["path"]:
                fs, at = arrow_fs.FileSystem.from_uri(p)
                info = fs.get_file_info(at)
                due = info.type == arrow_fs.FileType.File and info.mtime.timestamp() <= time.time() - older_than
                if due:
                    fs.delete_file(at)
                gone.append(due)
            yield pdf[["path"]].assign(reaped=gone)

    return old.select("path").mapInPandas(f, "path string, reaped boolean")


def corrupt(objects: DataFrame) -> DataFrame:
    """Objects whose bytes aren't what their name says."""
    return objects.where(digest(F.col("content")) != F.col("digest"))


def swap_ref(refs: DataFrame, name: str, expected: str | None, new: str, targets: DataFrame) -> tuple[DataFrame, str | None]:
    """References (name, target) after a compare-and-swap, and why it was refused: ``moved`` or ``absent-target``."""
    now = refs.where(F.col("name") == name).select("target").take(1)
    if (now[0][0] if now else None) != expected:
        return refs, "moved"
    if targets.where(F.col("id") == new).isEmpty():
        return refs, "absent-target"
    row = refs.sparkSession.createDataFrame([(name, new)], refs.select("name", "target").schema)
    return refs.where(F.col("name") != name).select("name", "target").unionByName(row), None


def mark(*roots: DataFrame) -> DataFrame:
    """(root, digest), each once, over tables of roots and what they reach."""
    out = roots[0].select("root", "digest")
    for r in roots[1:]:
        out = out.unionByName(r.select("root", "digest"))
    return out.where("digest is not null").distinct()


def usage(marks: DataFrame, objects: DataFrame) -> DataFrame:
    """(root, objects, resident, exclusive): bytes that a root reaches, and those that no other does.

    The number of roots of an object is aggregated first, so an object that most roots share is no hot key of a window."""
    shared = marks.groupBy("digest").agg(F.count("*").alias("roots"))
    rows = marks.join(shared, "digest").join(objects.select("digest", "size"), "digest")
    return rows.groupBy("root").agg(F.count("*").alias("objects"), F.sum("size").alias("resident"), F.coalesce(F.sum(F.when(F.col("roots") == 1, F.col("size"))), F.lit(0)).alias("exclusive"))


def collect(resident: DataFrame, marks: DataFrame, quarantine: DataFrame, epoch: Column | int, grace: int = 2) -> DataFrame:
    """(digest, size, action, epoch) for each resident object at an epoch: ``keep`` what is reached, ``rescue`` what is
    reached again, ``delete`` what has been garbage for ``grace`` epochs, ``wait`` what hasn't, ``quarantine`` new garbage."""
    e = F.lit(epoch) if isinstance(epoch, int) else epoch
    live = marks.select("digest").distinct().withColumn("live", F.lit(True))
    q = quarantine.select("digest", F.col("epoch").alias("since"))
    rows = resident.select("digest", "size").join(live, "digest", "left").join(q, "digest", "left")
    action = (
        F.when(F.col("live") & F.col("since").isNotNull(), "rescue").when(F.col("live"), "keep").when(F.col("since").isNull(), "quarantine").when(F.col("since") <= e - grace, "delete").otherwise("wait")
    )
    return rows.select("digest", "size", action.alias("action"), F.when(action == "quarantine", e).when(action == "wait", F.col("since")).alias("epoch"))


def scrub(trees: DataFrame, refs: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(kind, name): trees, and references, whose snapshot isn't rooted."""
    known = snapshots.select("id")
    t = trees.select(F.lit("tree").alias("kind"), F.col("id").alias("name"), "id").join(known, "id", "left_anti")
    r = refs.select(F.lit("ref").alias("kind"), "name", F.col("target").alias("id")).join(known, "id", "left_anti")
    return t.unionByName(r).select("kind", "name")


def case_collisions(paths: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, folded, paths): paths that differ only in case."""
    out = paths.groupBy(*keys, F.lower("path").alias("folded")).agg(F.count_distinct("path").alias("n"), F.min("path").alias("first"), F.max("path").alias("last"))
    return out.where("n > 1")


def orphans(entries: DataFrame, keys: list[str]) -> DataFrame:
    """Entries whose parent directory isn't an entry."""
    parents = entries.where("kind = 'directory'").select(*keys, F.col("path").alias("parent"))
    inner = entries.where(F.contains("path", F.lit("/"))).withColumn("parent", F.regexp_replace("path", "/[^/]*$", ""))
    return inner.join(parents, [*keys, "parent"], "left_anti").select(*keys, "path")


def ordinals(entries: DataFrame, keys: list[str]) -> DataFrame:
    """Regular files numbered from 0 in the order of their paths."""
    return running(entries.where("kind = 'file'").select(*keys, "path"), keys, ["path"], {"ordinal": F.lit(1)})


def record_refusals(records: DataFrame, sizes: DataFrame, keys: list[str], most: int = 64 << 20) -> DataFrame:
    """(keys, reason) of record runs (ord, hole, length): too many, an empty one, holes side by side, data over the bound, a
    sum that isn't the file's size."""
    rows = running(records, keys, ["ord"], lags={"before": F.col("hole")})
    why = F.when(F.col("length") <= 0, 2).when(F.col("hole") & F.coalesce("before", F.lit(False)), 3).when(~F.col("hole") & (F.col("length") > most), 4)
    agg = rows.groupBy(*keys).agg(F.min(why).alias("why"), F.count("*").alias("n"), F.sum("length").alias("total"))
    reason = F.when(F.col("n") > 1_000_000, "count").otherwise(F.get(F.array(*map(F.lit, ("", "zero-length", "adjacent-holes", "record-size"))), F.col("why") - 1))
    out = sizes.join(agg, keys, "left").withColumn("reason", F.coalesce(reason, F.when(F.coalesce("total", F.lit(0)) != F.col("size"), "sum")))
    return out.where("reason is not null").select(*keys, "reason")


def truncate(records: DataFrame, keys: list[str], size: Column) -> DataFrame:
    """Record runs (ord, hole, digest, length) cut or extended to ``size``: a hole shrinks or is added at the end; ``reason``
    is ``inside-data`` where the cut falls into data."""
    rows = running(records, keys, ["ord"], {"start": F.col("length")}).withColumn("goal", size)
    kept = rows.where("start < goal").withColumn("cut", F.least(F.col("length"), F.col("goal") - F.col("start")))
    reason = F.when(~F.col("hole") & (F.col("cut") < F.col("length")), "inside-data")
    body = kept.select(*keys, "ord", "hole", "digest", F.col("cut").alias("length"), reason.alias("reason"))
    ends = rows.groupBy(*keys).agg(F.max("ord").alias("ord"), F.sum("length").alias("total"), F.max("goal").alias("goal"), F.max_by("hole", "ord").alias("last"))
    more = ends.where("goal > total")
    grown = body.join(more.where("last").select(*keys, "ord", (F.col("goal") - F.col("total")).alias("extra")), [*keys, "ord"], "left").withColumn("length", F.col("length") + F.coalesce("extra", F.lit(0))).drop("extra")
    tail = more.where("not last").select(*keys, (F.col("ord") + 1).alias("ord"), F.lit(True).alias("hole"), F.lit(None).cast("string").alias("digest"), (F.col("goal") - F.col("total")).alias("length"), F.lit(None).cast("string").alias("reason"))
    return grown.select(*tail.columns).unionByName(tail)


def tree_paths(dirents: DataFrame) -> DataFrame:
    """(inode, path) of every entry under the root 0, of (parent, name, inode): breadth first, a join a level; an inode with
    several paths is carried by its least."""
    level = dirents.where("parent = 0").select("inode", F.col("name").alias("path"))
    out = level
    while not level.isEmpty():
        step = dirents.select(F.col("parent").alias("up"), "name", F.col("inode").alias("to"))
        level = level.join(step, F.col("inode") == F.col("up")).select(F.col("to").alias("inode"), F.concat_ws("/", "path", "name").alias("path"))
        level = checkpoint(level)
        out = out.unionByName(level)
    return out


def carriers(paths: DataFrame) -> DataFrame:
    """The path that carries each inode."""
    return paths.groupBy("inode").agg(F.min("path").alias("path"))


MUTATIONS = ("put", "remove", "rename", "mkdir", "truncate", "link", "records", "rmdir", "symlink", "chmod")


def fold_mutations(log: DataFrame) -> DataFrame:
    """(workspace, path, value, generation, reason) after an ordered log (workspace, ord, op, path, arg): the tree of each
    workspace. Order decides, so a workspace's log is folded row by row as it streams by, sorted. A directory has no value, a
    symbolic link has ``@`` and its target, an executable file's value ends in ``*``. ``records`` replaces a file that is there,
    ``rmdir`` takes an empty directory, ``chmod`` sets (arg ``x``) or clears the mark of a file."""

    def f(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict[str, object] = {}
        now, generation, refused = None, 0, 0

        def rows() -> pd.DataFrame:
            return pd.DataFrame({"workspace": [now] * len(state), "path": list(state), "value": list(state.values()), "generation": [generation] * len(state), "refused": [refused] * len(state)})

        first = True
        for pdf in frames:
            for w, op, path, arg in zip(pdf["workspace"], pdf["op"], pdf["path"], pdf["arg"]):
                if first or w != now:
                    if not first and state:
                        yield rows()
                    state, now, generation, refused, first = {}, w, 0, 0, False
                ok = True
                if op in ("put", "mkdir"):
                    state[path] = arg if op == "put" else None
                elif op == "remove":
                    ok = path in state
                    state.pop(path, None)
                elif op in ("rename", "link"):
                    ok = path in state and arg not in state
                    if ok:
                        state[arg] = state[path]
                        if op == "rename":
                            del state[path]
                elif op == "truncate":
                    ok = path in state
                    if ok:
                        state[path] = f"{state[path]}[:{arg}]"
                elif op == "rmdir":
                    ok = path in state and state[path] is None and not any(p.startswith(f"{path}/") for p in state)
                    if ok:
                        del state[path]
                elif op == "symlink":
                    ok = path not in state
                    if ok:
                        state[path] = f"@{arg}"
                elif op in ("records", "chmod"):
                    old = state.get(path)
                    ok = isinstance(old, str) and not old.startswith("@")
                    if ok:
                        marked = arg == "x" if op == "chmod" else old.endswith("*")
                        state[path] = (old.rstrip("*") if op == "chmod" else str(arg)) + "*" * marked
                else:
                    ok = False
                generation += ok
                refused += not ok
        if not first and state:
            yield rows()

    kind = log.schema["workspace"].dataType.simpleString()
    ordered = log.select("workspace", "ord", "op", "path", "arg").repartition("workspace").sortWithinPartitions("workspace", "ord")
    return ordered.mapInPandas(f, f"workspace {kind}, path string, value string, generation long, refused long")
