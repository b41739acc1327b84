"""Writing containers: renamed, trimmed or converted ones, whose data objects are inherited where they can be.

A new container is a header object and, for each tensor, either the records it inherits or new bytes cut on the grid.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.operators import relayout
from gneiss.operators.fill import gather
from gneiss.operators.planning import GRID
from gneiss.sources.safetensors import Refused, write_header


@dataclass
class TensorWriter:
    """Collects a container's tensors in order; ``finish`` gives its records and the new objects."""

    grid: int = GRID
    tensors: list[dict] = field(default_factory=list)
    records: list[list[tuple[str, int]]] = field(default_factory=list)
    objects: dict[str, bytes] = field(default_factory=dict)

    def _named(self, name: str, dtype: str, shape: list[int], length: int) -> None:
        if any(t["name"] == name for t in self.tensors):
            raise Refused("duplicate-name")
        self.tensors.append({"name": name, "dtype": dtype, "shape": shape, "length": length})

    def _absorb(self, content: bytes) -> tuple[str, int]:
        digest = hashlib.sha256(content).hexdigest()
        self.objects[digest] = content
        return digest, len(content)

    def add(self, name: str, dtype: str, shape: list[int], content: bytes) -> None:
        """A tensor of new bytes."""
        self._named(name, dtype, shape, len(content))
        self.records.append([self._absorb(content[i : i + self.grid]) for i in range(0, len(content), self.grid)])

    def inherit(self, name: str, dtype: str, shape: list[int], records: list[tuple[str, int]]) -> None:
        """A tensor whose bytes are objects that exist."""
        self._named(name, dtype, shape, sum(n for _, n in records))
        self.records.append(records)

    def finish(self, metadata: dict[str, str] | None = None) -> tuple[list[tuple[str, int]], dict[str, bytes]]:
        """The file's records, header first, and the objects that are new."""
        header = self._absorb(write_header(self.tensors, metadata))
        return [header, *(r for t in self.records for r in t)], self.objects


FILE = "artifact string, ord int, digest string, length bigint, fresh boolean, content binary"


def compose(tensors: DataFrame) -> DataFrame:
    """The records of a new container for each artifact of tensors (artifact, ord, name, dtype, shape, records: its objects
    (digest, len), null where content has its bytes): (artifact, ord, digest, length, fresh, content of fresh objects).

    An artifact's tensor list is metadata, but content isn't: keep new bytes to what one task may hold."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        w = TensorWriter()
        for r in pdf.sort_values("ord").itertuples():
            if r.records is not None:
                w.inherit(r.name, r.dtype, [int(d) for d in r.shape], [(x["digest"], int(x["len"])) for x in r.records])
            else:
                w.add(r.name, r.dtype, [int(d) for d in r.shape], bytes(r.content))
        records, fresh = w.finish()
        rows = [(pdf["artifact"].iloc[0], k, d, n, d in fresh, fresh.get(d)) for k, (d, n) in enumerate(records)]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in FILE.split(", ")])

    return tensors.groupBy("artifact").applyInPandas(build, FILE)


def derive(tensors: DataFrame, record: dict) -> DataFrame:
    """The container of tensors (artifact, ord, name, dtype, shape, item, records, content) in another arrangement, as records:
    in their own they are inherited, otherwise their bytes are moved, and ``content`` has to be there."""
    if why := relayout.record_refusal(record):
        raise Refused(why)
    kept = ["artifact", "ord", "name", "dtype", "shape"]
    if record["rank"] == 0:
        return compose(tensors.select(*kept, "records", F.lit(None).cast("binary").alias("content")))

    def f(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            moved = [gather(bytes(c), [int(d) for d in s], record, int(i)) if len(s) == record["rank"] else None for c, s, i in zip(pdf["content"], pdf["shape"], pdf["item"])]
            yield pdf[kept].assign(content=moved)

    kinds = ", ".join(f"{c} {tensors.schema[c].dataType.simpleString()}" for c in kept)
    moved = tensors.select(*kept, "item", "content").mapInPandas(f, f"{kinds}, content binary").withColumn("storage", relayout.plan(F.col("shape"), record)["storage"])
    other = moved.where("content is null").select(*kept).join(tensors.select("artifact", "name", "records"), ["artifact", "name"]).withColumn("content", F.lit(None).cast("binary"))
    done = moved.where("content is not null").select("artifact", "ord", "name", "dtype", F.col("storage").alias("shape"), F.lit(None).cast(tensors.schema["records"].dataType).alias("records"), "content")
    return compose(done.unionByName(other))


def shared(old: DataFrame, new: DataFrame) -> DataFrame:
    """(artifact, objects, shared, bytes, shared_bytes): how much of a new container its artifact held already."""
    had = old.select("artifact", "digest").distinct().withColumn("had", F.lit(True))
    rows = new.join(had, ["artifact", "digest"], "left")
    return rows.groupBy("artifact").agg(F.count("*").alias("objects"), F.count("had").alias("shared"), F.sum("length").alias("bytes"), F.coalesce(F.sum(F.when(F.col("had"), F.col("length"))), F.lit(0)).alias("shared_bytes"))
