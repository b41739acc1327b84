"""Topology extraction from headers: roles, dominant element type, shard families, components and islands."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.functions.dtypes import n_bytes

ROLES = {
    "denoiser": ("transformer", "unet", "dit", "denoiser", "prior", "flow"), "autoencoder": ("vae", "autoencoder", "vqgan", "vae_decoder"), "text_encoder": ("text_encoder", "clip", "t5"),
    "tokenizer": ("tokenizer",), "vision_encoder": ("image_encoder", "vision", "vision_model"), "upsampler": ("upsampler", "latent_upsampler"), "vocoder": ("vocoder",), "scheduler": ("scheduler",),
}


def role_of_directory(path: Column) -> Column:
    """The role that a directory's name says, numbered siblings alike; ``backbone`` for the others."""
    name = F.regexp_replace(F.lower(F.element_at(F.split(path, "/"), -1)), "_[0-9]+$", "")
    out = F.when(F.lit(False), F.lit(""))
    for role, names in ROLES.items():
        out = out.when(name.isin(*names), F.lit(role))
    return out.otherwise("backbone")


def shard_family(member: Column) -> Column:
    """The file's stem with each run of digits as #."""
    return F.regexp_replace(F.regexp_replace(F.element_at(F.split(member, "/"), -1), r"\.[^.]*$", ""), "[0-9]+", "#")


def directory_of(member: Column) -> Column:
    return F.when(F.contains(member, F.lit("/")), F.regexp_replace(member, "/[^/]*$", "")).otherwise("")


def dominant_dtype(headers: DataFrame, keys: list[str], denoiser: Column | None = None) -> DataFrame:
    """The element type with most bytes (most tensors, if no bytes are known) of each group, within its denoisers if it has
    any; of equal ones the first by name."""
    rows = headers.withColumn("den", F.lit(False) if denoiser is None else denoiser).withColumn("size", F.coalesce(n_bytes(F.col("dtype"), F.col("shape")), F.lit(0)))
    sums = rows.groupBy(*keys, "dtype").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.sum(F.when(F.col("den"), F.col("size"))).alias("db"), F.count_if("den").alias("dn"))
    any_ = sums.groupBy(*keys).agg(F.sum("dn").alias("dn_all"), F.sum("db").alias("db_all"), F.sum("b").alias("b_all"))
    w = F.when(F.col("dn_all") > 0, F.when(F.col("db_all") > 0, F.coalesce("db", F.lit(0))).otherwise(F.col("dn"))).otherwise(F.when(F.col("b_all") > 0, F.col("b")).otherwise(F.col("n")))
    joined = sums.join(any_, keys).withColumn("w", w).where((F.col("dn_all") == 0) | (F.col("dn") > 0))
    return joined.groupBy(*keys).agg(F.min_by("dtype", F.struct(-F.col("w"), "dtype")).alias("dtype"))


def _partition(pdf: pd.DataFrame) -> pd.DataFrame:
    parts: list[tuple[str, set]] = []
    out = []
    for m, f, names in sorted(zip(pdf["member"], pdf["family"], pdf["names"]), key=lambda x: x[0]):
        own = set(names)
        at = next((i for i, (g, seen) in enumerate(parts) if g == f and not seen & own), None)
        if at is None:
            parts.append((f, set()))
            at = len(parts) - 1
        parts[at][1].update(own)
        out.append((m, at))
    return pd.DataFrame({"artifact": pdf["artifact"].iloc[0], "directory": pdf["directory"].iloc[0], "member": [m for m, _ in out], "part": [p for _, p in out], "parts": len(parts)})


def components(headers: DataFrame) -> DataFrame:
    """(artifact, member, directory, part, component): members of a directory go, in path order, to the first part of their
    shard family whose keys are disjoint from theirs; a directory in several parts names them by their first member."""
    files = headers.groupBy("artifact", "member").agg(F.collect_list("name").alias("names")).withColumn("directory", directory_of(F.col("member"))).withColumn("family", shard_family(F.col("member")))
    parts = files.groupBy("artifact", "directory").applyInPandas(_partition, "artifact string, directory string, member string, part int, parts int")
    first = parts.groupBy("artifact", "directory", "part").agg(F.min("member").alias("first"))
    stem = F.regexp_replace(F.element_at(F.split("first", "/"), -1), r"\.[^.]*$", "")
    base = F.element_at(F.split("directory", "/"), -1)
    return parts.join(first, ["artifact", "directory", "part"]).select("artifact", "member", "directory", "part", F.when(F.col("parts") > 1, stem).otherwise(base).alias("component"))


def topology_from_headers(headers: DataFrame) -> DataFrame:
    """(topology, component, component_ord, role, key, shape, island, dtype, reason) of each artifact's headers; reason is
    ``duplicate-component`` where two directories give one name."""
    parts = components(headers)
    rows = headers.join(parts, ["artifact", "member"]).withColumn("role", role_of_directory(F.col("directory")))
    top = dominant_dtype(rows, ["artifact"], F.col("role") == "denoiser").withColumnRenamed("dtype", "base")
    names = parts.select("artifact", "directory", "part", "component").distinct()
    twice = names.groupBy("artifact", "component").agg((F.count("*") > 1).alias("twice"))
    order = names.groupBy("artifact").agg(F.array_sort(F.collect_set("component")).alias("all"))
    rows = rows.join(top, "artifact").join(twice, ["artifact", "component"]).join(order, "artifact")
    return rows.select(
        F.col("artifact").alias("topology"), "component", (F.array_position("all", F.col("component")) - 1).cast("int").alias("component_ord"), "role", F.col("name").alias("key"), "shape",
        F.when(F.col("dtype") != F.col("base"), F.col("dtype")).alias("island"), F.col("base").alias("dtype"), F.when(F.col("twice"), "duplicate-component").alias("reason"),
    )
