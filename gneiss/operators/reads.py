"""Reads and containers made anew: byte ranges over chunks, renamed views, subsets, inherited records, adopted plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.operators.ordered import running


def read_ranges(ranges: DataFrame, chunks: DataFrame, keys: list[str], step: int) -> DataFrame:
    """(keys, range, bytes): the bytes [start, end) of each range over chunks (offset, length, content), in order, clipped.

    The overlap join is an equi-join on grid cells of ``step`` bytes; a chunk is listed in each cell it touches, and a
    (range, chunk) pair counts only in the first cell they share."""
    cell = lambda x: F.call_function("div", x, F.lit(step).cast("long"))
    c = chunks.where("length > 0").withColumn("cell", F.explode(F.sequence(cell(F.col("offset")), cell(F.col("offset") + F.col("length") - 1))))
    r = ranges.where("end > start").withColumn("cell", F.explode(F.sequence(cell(F.col("start")), cell(F.col("end") - 1))))
    rows = r.join(c, [*keys, "cell"]).where((F.col("offset") < F.col("end")) & (F.col("offset") + F.col("length") > F.col("start")))
    rows = rows.where(F.col("cell") == cell(F.greatest("offset", "start")))
    low, high = F.greatest("offset", "start"), F.least(F.col("offset") + F.col("length"), F.col("end"))
    piece = F.substr(F.col("content").cast("binary"), (low - F.col("offset") + 1).cast("int"), (high - low).cast("int"))
    parts = rows.select(*keys, "range", F.struct(F.col("offset").alias("offset"), piece.alias("piece")).alias("p"))
    return parts.groupBy(*keys, "range").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: F.hex(p["piece"])), "").alias("h")).select(*keys, "range", F.unhex("h").alias("bytes"))


def duplicate_names(tensors: DataFrame, keys: list[str]) -> DataFrame:
    """Tensor names that an artifact has more than once."""
    return tensors.groupBy(*keys, "name").count().where("count > 1").select(*keys, "name")


def rekeyed(tensors: DataFrame, names: DataFrame, keys: list[str], total: bool = False) -> DataFrame:
    """Tensors under new names (old, new), nothing stored anew; ``reason`` is ``collision`` where two get one name and, if
    the renaming has to be total, ``unnamed`` where one gets none."""
    rows = tensors.join(names.withColumnRenamed("old", "name"), "name", "left")
    out = rows.withColumn("to", F.coalesce("new", "name"))
    twice = out.groupBy(*keys, "to").agg((F.count("*") > 1).alias("twice"))
    reason = F.when(F.lit(total) & F.col("new").isNull(), "unnamed").when(F.col("twice"), "collision")
    return out.join(twice, [*keys, "to"]).select(*keys, F.col("to").alias("name"), F.col("name").alias("source"), *[c for c in tensors.columns if c not in (*keys, "name")], reason.alias("reason"))


def subset(tensors: DataFrame, wanted: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The named tensors in the order of their data, with their new places; and the names that aren't there."""
    kept = tensors.join(wanted.select(*keys, "name").distinct(), [*keys, "name"], "left_semi")
    placed = running(kept, keys, ["offset", "name"], {"new_offset": F.col("length")})
    return placed, wanted.select(*keys, "name").join(tensors.select(*keys, "name"), [*keys, "name"], "left_anti")


def inherit(spans: DataFrame, records: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, name, records, reason): the records that exactly cover each span [offset, offset + length); otherwise
    ``not-aligned``."""
    s = spans.select(*keys, "name", F.col("offset").alias("a"), (F.col("offset") + F.col("length")).alias("b"))
    rows = s.join(records, keys).where((F.col("offset") >= F.col("a")) & (F.col("offset") + F.col("length") <= F.col("b")))
    got = rows.groupBy(*keys, "name").agg(F.sum("length").alias("held"), F.transform(F.array_sort(F.collect_list(F.struct("offset", "digest"))), lambda x: x["digest"]).alias("records"))
    out = s.join(got, [*keys, "name"], "left")
    return out.select(*keys, "name", "records", F.when(F.coalesce("held", F.lit(0)) != F.col("b") - F.col("a"), "not-aligned").alias("reason"))


def adopt(regions: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
    """The regions of a new cut with the digest of the held object at the same place and length; null has to be hashed."""
    return regions.join(held.select(*keys, "offset", "length", "digest"), [*keys, "offset", "length"], "left")


def projection(entries: DataFrame) -> DataFrame:
    """(path, artifact, target): a stub for a tensor file, a relative link for a blob, an empty file for no bytes; by the kind
    of body."""
    depth = F.size(F.split("path", "/")) - 1
    link = F.concat(F.repeat(F.lit("../"), depth), F.lit("../objects/"), F.substring("digest", 1, 2), F.lit("/"), F.col("digest"))
    artifact = F.when(F.col("kind") == "directory", "directory").when(F.col("size") == 0, "empty").when(F.col("body") == "tensor", "stub").otherwise("link")
    return entries.select("path", artifact.alias("artifact"), F.when(artifact == "link", link).alias("target"))
