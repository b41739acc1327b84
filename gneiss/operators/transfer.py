"""Transfers: what a publisher has and needs, packs, promotion, closures; manifests as tables of files and chunks.

Declared objects are a table (session, ord, digest, size); a store's inventory (digest, size[, checksum]).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.functions.idents import object_key, ref
from gneiss.operators.ordered import checkpoint, running

MOST_FILES, MOST_OBJECTS, MOST_OBJECT, MOST_TOTAL = 100_000, 200_000, 512 << 30, 4 << 40
PACK_BYTES, PACK_ROWS = 64 << 20, 1_000_000


def file_objects(files: DataFrame) -> DataFrame:
    """(session, path, ord, digest, size): a file's chunks, or the file itself if it has none."""
    chunks = F.when(F.size(F.coalesce("chunks", F.array())) > 0, F.col("chunks"))
    whole = F.array(F.struct(F.col("digest").alias("digest"), F.col("size_bytes").alias("len")))
    return files.select("session", "path", F.posexplode(F.coalesce(chunks, whole)).alias("ord", "o")).select("session", "path", "ord", F.col("o.digest").alias("digest"), F.col("o.len").alias("size"))


class Limits(NamedTuple):
    """What one declaration may have; a service may choose others. None: as many as there are."""

    files: int | None = MOST_FILES
    objects: int | None = MOST_OBJECTS
    object_size: int | None = MOST_OBJECT
    total_size: int | None = MOST_TOTAL


UNBOUNDED = Limits(None, None, None, None)


def manifest_refusals(files: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(session, reason): chunk sums that differ from the file, paths twice or twice but for case; then what is over the
    limits or has two sizes for one digest."""
    o = file_objects(files)
    f = files.withColumn("sum", F.aggregate(F.coalesce("chunks", F.array().cast("array<struct<digest:string,len:bigint>>")), F.lit(0).cast("long"), lambda a, c: a + c["len"]))
    per_file = f.groupBy("session").agg(
        F.count("*").alias("files"), F.sum("size_bytes").alias("total"), F.count_if((F.size(F.coalesce("chunks", F.array())) > 0) & (F.col("sum") != F.col("size_bytes"))).alias("bad_sums"), F.max("size_bytes").alias("largest")
    )
    paths = files.groupBy("session", F.translate("path", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("p")).agg(F.count("*").alias("n"), F.count_distinct("path").alias("d"))
    clash = paths.groupBy("session").agg(F.max(F.col("n") > F.col("d")).alias("twice"), F.max(F.col("d") > 1).alias("folded"))
    sizes = o.groupBy("session", "digest").agg((F.min("size") != F.max("size")).alias("two")).groupBy("session").agg(F.max("two").alias("two"), F.count("*").alias("objects"))
    over = lambda c, most: F.lit(False) if most is None else F.col(c) > most
    reason = (
        F.when(F.col("bad_sums") > 0, "chunk-sum").when(F.col("twice"), "path-twice").when(F.col("folded"), "path-case").when(over("files", limits.files), "files")
        .when(over("largest", limits.object_size), "object-size").when(over("total", limits.total_size), "total-size").when(F.col("two"), "two-sizes").when(over("objects", limits.objects), "objects")
    )
    return per_file.join(clash, "session").join(sizes, "session").select("session", reason.alias("reason")).where("reason is not null")


def distinct_objects(declared: DataFrame) -> DataFrame:
    """Each session's objects once, at their first appearance."""
    return declared.groupBy("session", "digest").agg(F.min("ord").alias("ord"), F.min_by("size", "ord").alias("size"))


def have_need(declared: DataFrame, resident: DataFrame, claimable: DataFrame | None = None, prefix: str = "staging") -> DataFrame:
    """(session, digest, size, status, key): ``have`` if the object is resident and, where ``claimable`` (session, digest) is
    given, the publisher may claim it; otherwise ``need`` with the key to put it at. What can't be claimed looks missing."""
    objects = distinct_objects(declared)
    there = objects.join(resident.select("digest").distinct(), "digest", "left_semi")
    if claimable is not None:
        there = there.join(claimable.select("session", "digest").distinct(), ["session", "digest"], "left_semi")
    have = there.select("session", "digest").withColumn("have", F.lit(True))
    out = objects.join(have, ["session", "digest"], "left")
    return out.select("session", "ord", "digest", "size", F.when(F.col("have"), "have").otherwise("need").alias("status"), F.when(F.col("have").isNull(), object_key(ref(F.col("digest")), prefix)).alias("key"))


def grants(plan: DataFrame, sign: Callable[[str], str], seconds: int, now: Column | None = None) -> DataFrame:
    """Needed objects with the URL to put them at and when it expires; ``sign`` is the caller's, applied in batches."""

    @F.pandas_udf("string")
    def signed(key: pd.Series) -> pd.Series:
        return key.map(sign)

    at = F.current_timestamp() if now is None else now
    expiry = at + F.make_dt_interval(secs=F.lit(float(seconds)))
    return plan.where("status = 'need'").withColumn("url", signed("key")).withColumn("expires_at", expiry)


def promotion(plan: DataFrame, store: DataFrame, prefix: str = "staging") -> DataFrame:
    """(session, digest, state): ``ready``, ``absent``, ``size`` or ``checksum`` for each planned object against the store's
    inventory; and ``undeclared`` for keys in the plan that aren't what the digest gives under ``prefix``."""
    s = store.select(F.col("digest"), F.col("size").alias("stored"), *([F.col("checksum")] if "checksum" in store.columns else [F.col("digest").alias("checksum")]))
    rows = plan.join(s, "digest", "left")
    bad_key = F.col("key").isNotNull() & (F.col("key") != object_key(ref(F.col("digest")), prefix))
    state = F.when(bad_key, "undeclared").when(F.col("stored").isNull(), "absent").when(F.col("stored") != F.col("size"), "size").when(F.col("checksum") != F.col("digest"), "checksum").otherwise("ready")
    return rows.select("session", "digest", state.alias("state"))


def promotion_report(plan: DataFrame, store: DataFrame, prefix: str = "staging") -> DataFrame:
    """(session, objects, ready, failed, complete)."""
    p = promotion(plan, store, prefix)
    return p.groupBy("session").agg(F.count("*").alias("objects"), F.count_if(F.col("state") == "ready").alias("ready"), F.count_if(F.col("state") != "ready").alias("failed"), (F.count_if(F.col("state") != "ready") == 0).alias("complete"))


def closure(declared: DataFrame) -> DataFrame:
    """(session, digest, size, ord): the unique objects in canonical order, by first appearance."""
    return running(distinct_objects(declared), ["session"], ["ord", "digest"], {"at": F.lit(1)}).withColumn("ord", F.col("at")).drop("at")


def missing_refusals(canonical: DataFrame, missing: DataFrame) -> DataFrame:
    """(session, reason): a missing list that isn't an order-preserving part of the closure with equal sizes."""
    m = missing.withColumnRenamed("size", "said").withColumnRenamed("ord", "place").join(canonical.select("session", "digest", "size", "ord"), ["session", "digest"], "left")
    m = running(m, ["session"], ["place"], lags={"before": F.col("ord")})
    why = F.when(F.col("ord").isNull(), 1).when(F.col("said") != F.col("size"), 2).when(F.col("ord") <= F.col("before"), 3)
    out = m.groupBy("session").agg(F.min(why).alias("why")).where("why is not null")
    return out.select("session", F.get(F.array(*map(F.lit, ("unknown", "size", "order"))), F.col("why") - 1).alias("reason"))


def lane_refusals(objects: DataFrame, bound: int = PACK_BYTES) -> DataFrame:
    """(session, digest, reason): packed objects over the bound, whole ones within it."""
    why = F.when((F.col("lane") == "pack") & (F.col("size") > bound), "too-large-for-pack").when((F.col("lane") == "blob") & (F.col("size") <= bound), "small-blob")
    return objects.select("session", "digest", why.alias("reason")).where("reason is not null")


def pack(objects: DataFrame, bound: int = PACK_BYTES, most: int = PACK_ROWS) -> DataFrame:
    """(session, ord, digest, size, pack, offset): objects in order, a pack closing when the next would overfill it.

    The choice resets, so it is sequential; but it streams: rows come sorted, and only a counter is held."""
    cols = ["session", "ord", "digest", "size"]

    def f(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session: object = object()
        number = held = rows = 0
        for pdf in frames:
            packs, places = [], []
            for s, size in zip(pdf["session"], pdf["size"]):
                if s != session:
                    session, number, held, rows = s, 0, 0, 0
                if rows and (held + size > bound or rows >= most):
                    number, held, rows = number + 1, 0, 0
                packs.append(number)
                places.append(held)
                held, rows = held + size, rows + 1
            yield pdf.assign(pack=packs, offset=places)

    kinds = ", ".join(f"{c} {objects.schema[c].dataType.simpleString()}" for c in cols)
    ordered = objects.select(*cols).repartition("session").sortWithinPartitions("session", "ord")
    return ordered.mapInPandas(f, f"{kinds}, pack long, offset long")


def push(plan: DataFrame, send: Callable[[pd.DataFrame], pd.DataFrame], rounds: int = 5) -> tuple[DataFrame, int]:
    """Sends what is needed until nothing is, or until ``rounds`` rounds in a row brought nothing forward; ``send`` gets
    batches of (session, digest, size, key) and returns (session, digest, sent). Returns what is left, and how much."""
    left, n, stalled = plan.where("status = 'need'"), -1, 0
    while True:
        count = left.count()
        stalled = stalled + 1 if count == n else 0
        n = count
        if n == 0 or stalled >= rounds:
            return left, n
        done = left.select("session", "digest", "size", "key").mapInPandas(lambda frames: (send(f) for f in frames), "session string, digest string, sent boolean").where("sent")
        done = checkpoint(done)
        left = left.join(done.select("session", "digest"), ["session", "digest"], "left_anti")
        left = checkpoint(left)


def pull(closure_: DataFrame, resident: DataFrame) -> DataFrame:
    """What a receiver has to fetch: the closure without what it holds at the same size."""
    return closure_.join(resident.select("digest", "size").distinct(), ["digest", "size"], "left_anti")
