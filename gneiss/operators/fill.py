"""Filling buffers in an arrangement from chunked tensors, and putting files back together, batch by batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.operators import relayout

STATS = "artifact string, name string, bytes bigint, padding bigint, runs bigint, chunks bigint, reason string"


def gather(content: bytes, shape: list[int], record: dict, item: int) -> bytes:
    """A tensor's bytes in storage order, padding zero."""
    if record["rank"] == 0:
        return content
    src = relayout.indices(shape, record)
    out = np.zeros((len(src), item), np.uint8)
    out[src >= 0] = np.frombuffer(content, np.uint8).reshape(-1, item)[src[src >= 0]]
    return out.tobytes()


def scatter(content: bytes, shape: list[int], record: dict, item: int) -> bytes:
    """The bytes back in row-major order."""
    if record["rank"] == 0:
        return content
    src = relayout.indices(shape, record)
    out = np.zeros((int(np.prod(shape)), item), np.uint8)
    out[src[src >= 0]] = np.frombuffer(content, np.uint8).reshape(-1, item)[src >= 0]
    return out.tobytes()


def fill(tensors: DataFrame, record: dict, sink: Callable[[str, str, bytes], None] | None = None) -> DataFrame:
    """Statistics of each tensor (artifact, name, shape, item, chunks: an array of its pieces in order) written to ``sink`` in
    the arrangement; refused if it isn't ratified or the pieces don't add up to the shape. A sink runs where the bytes are
    and, tasks being repeated, has to bear the same tensor twice."""
    if relayout.record_refusal(record):
        raise ValueError(relayout.record_refusal(record))

    def f(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for t in pdf.itertuples():
                shape, pieces = [int(d) for d in t.shape], [bytes(c) for c in t.chunks]
                content = b"".join(pieces)
                if record["rank"] and (len(shape) != record["rank"] or relayout.ratify(record, [shape])):
                    rows.append((t.artifact, t.name, 0, 0, 0, 0, "not-ratified"))
                elif len(content) != int(np.prod(shape)) * t.item:
                    rows.append((t.artifact, t.name, 0, 0, 0, 0, "length"))
                else:
                    out = gather(content, shape, record, int(t.item))
                    runs = relayout.runs(shape, record) if record["rank"] else np.array([[0, 0, 1]])
                    if sink:
                        sink(t.artifact, t.name, out)
                    rows.append((t.artifact, t.name, len(out), len(out) - len(content), len(runs), len(pieces), None))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in STATS.split(", ")])

    return tensors.select("artifact", "name", "shape", "item", "chunks").mapInPandas(f, STATS)


def materialize_files(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """(path, content, reason): files (path, digest, size) put together from chunks (path, ord, content) and verified."""
    parts = chunks.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.hex(F.col("content")).alias("h")))), lambda x: x["h"]), "").alias("h"))
    rows = files.join(parts, "path", "left").withColumn("content", F.unhex(F.coalesce("h", F.lit("")))).drop("h")
    reason = F.when(F.octet_length("content") != F.col("size"), "size").when(F.sha2("content", 256) != F.col("digest"), "digest")
    return rows.select("path", "content", reason.alias("reason"))

