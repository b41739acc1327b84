"""Files as DataFrames: tensor headers and plans of containers, decoded packs and trees, catalogue documents.

All read the ``binaryFile`` source and work batch by batch; a refusal is a row with a reason. ``TensorHeaders`` is the same
as a data source, which reads only the beginning of each file.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from gneiss.operators.planning import GRID
from gneiss.sources import codecs, gguf, safetensors
from gneiss.sources.safetensors import Refused

HEADERS = "path string, format string, ord int, name string, dtype string, shape array<bigint>, offset bigint, length bigint, reason string"
PLAN = "path string, ord int, offset bigint, length bigint, kind string"


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """path, modificationTime, length, content of the files."""
    return spark.read.format("binaryFile").load(path)


def inventory(content: bytes) -> tuple[str | None, list[dict], str | None]:
    """Format, tensors and, for a file that is no container, why not."""
    if len(content) >= 24 and content[:4] == gguf.MAGIC:
        try:
            return "gguf", gguf.parse_header(content)["tensors"], None
        except Refused as e:
            return None, [], str(e)
    try:
        return "safetensors", safetensors.parse_header(content)[1], None
    except Refused as e:
        return None, [], str(e)


def plan(content: bytes, grid: int = GRID, cuts: Callable[[dict], list[int]] = lambda t: []) -> list[tuple[int, int, str]]:
    """(offset, length, kind) of a file's regions: header domains, each tensor on a grid from its own start (or from each of
    its cuts), padding; one blob for what is no container."""
    out: list[tuple[int, int, str]] = []

    def domain(at: int, end: int, kind: str) -> None:
        while at < end:
            n = min(grid, end - at)
            out.append((at, n, kind))
            at += n

    form, tensors, _ = inventory(content) if len(content) >= 10 else (None, [], None)
    if form is None:
        return [(0, len(content), "blob")] if content else []
    if form == "gguf":
        h = gguf.parse_header(content)
        domain(0, h["directory_start"], "metadata")
        domain(h["directory_start"], h["directory_end"], "directory")
        domain(h["directory_end"], h["data_start"], "padding")
    else:
        domain(0, safetensors.parse_header(content)[0], "header")
    ends = [t["offset"] for t in tensors[1:]] + [len(content)]
    for t, following in zip(tensors, ends):
        edges = [0, *cuts(t), t["length"]]
        for a, b in zip(edges, edges[1:]):
            domain(t["offset"] + a, t["offset"] + b, "tensor")
        if form == "gguf":
            domain(t["offset"] + t["length"], following, "padding")
    return out


def _map(files: DataFrame, f: Callable[[str, bytes], list[tuple]], schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [r for p, c in zip(pdf["path"], pdf["content"]) for r in f(p, bytes(c))]
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(each, schema)


def tensor_headers(files: DataFrame) -> DataFrame:
    """A row for each tensor of each file (path, content); one with a reason for a file that is no container."""

    def f(path: str, content: bytes) -> list[tuple]:
        form, tensors, reason = inventory(content)
        if form is None:
            return [(path, None, None, None, None, None, None, None, reason)]
        return [(path, form, i, t["name"], t["dtype"], t["shape"], t["offset"], t["length"], None) for i, t in enumerate(tensors)]

    return _map(files, f, HEADERS)


def plan_files(files: DataFrame, grid: int = GRID) -> DataFrame:
    """The regions of each file (path, content)."""
    return _map(files, lambda path, content: [(path, i, *r) for i, r in enumerate(plan(content, grid))], PLAN)


def unpack(files: DataFrame) -> DataFrame:
    """The objects in packs; reason for a pack that is refused."""

    def f(path: str, content: bytes) -> list[tuple]:
        try:
            return [(path, d, o, n, None) for d, o, n in codecs.decode_pack(content)]
        except Refused as e:
            return [(path, None, None, None, str(e))]

    return _map(files, f, "path string, digest string, offset bigint, length bigint, reason string")


def tree_entries(files: DataFrame) -> DataFrame:
    """The entries of tree snapshots, with the snapshot's id; reason for one that is refused."""
    import hashlib

    def f(path: str, content: bytes) -> list[tuple]:
        snapshot = hashlib.sha256(content).hexdigest()
        try:
            tree = codecs.decode_tree(content)
        except Refused as e:
            return [(snapshot, None, None, None, None, None, None, None, None, str(e))]
        return [(snapshot, tree["parent"], e["path"], e["kind"], e.get("planner"), e.get("size"), e.get("digest"), e.get("target"), e.get("ordinal"), None) for e in tree["entries"]]

    return _map(files, f, "snapshot string, parent string, path string, kind string, planner string, size bigint, digest string, target string, ordinal bigint, reason string")


class TensorHeaders(DataSource):
    """``spark.read.format("tensor_headers").load(glob)``: the tensors of safetensors files, a partition a file; only the
    header of a file is read. Register with ``spark.dataSource.register(TensorHeaders)``."""

    @classmethod
    def name(cls) -> str:
        return "tensor_headers"

    def schema(self) -> str:
        return HEADERS

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"])


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, pattern: str):
        self.pattern = pattern

    def partitions(self) -> list[_File]:
        import glob

        return [_File(p) for p in sorted(glob.glob(self.pattern.removeprefix("file://")))]

    def read(self, partition: _File) -> Iterator[tuple]:
        import os

        size = os.path.getsize(partition.path)
        try:
            with open(partition.path, "rb") as f:
                head = f.read(8)
                n = struct.unpack("<Q", head)[0] if len(head) == 8 else 0
                content = head + (f.read(n) if n <= safetensors.MOST_HEADER else b"")
            tensors = safetensors.parse_header(content, size)[1]
        except Refused as e:
            yield (partition.path, None, None, None, None, None, None, None, str(e))
            return
        for i, t in enumerate(tensors):
            yield (partition.path, "safetensors", i, t["name"], t["dtype"], t["shape"], t["offset"], t["length"], None)
