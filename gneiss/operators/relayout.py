"""Byte arrangements: sub-axes of a tensor's axes, permuted in storage, with padding where they exceed the axis.

A record is a dict: rank (0: any), sub_axes [{axis, extent formula}], permutation, candidate. Elements are arrays.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from gneiss.functions.shapes import dimension, evaluate

IDENTITY = {"rank": 0, "sub_axes": [], "permutation": [], "candidate": False}


def record_refusal(record: dict) -> str | None:
    """Why a record isn't one; None if it is."""
    subs, perm, rank = record["sub_axes"], record["permutation"], record["rank"]
    if rank == 0:
        return None if not subs and not perm else "identity-with-axes"
    axes = [s["axis"] for s in subs]
    if axes != sorted(axes):
        return "axes-order"
    if sorted(set(axes)) != list(range(rank)):
        return "axes-cover"
    if sorted(perm) != list(range(len(subs))):
        return "permutation"
    exact = all(axes.count(a) == 1 and next(s for s in subs if s["axis"] == a)["extent"] == f"d{a}" for a in range(rank))
    if perm == sorted(perm) and exact:
        return "changes-nothing"
    return None


def plan(shape: Column, record: dict) -> Column:
    """struct(extents, storage, elements, padded, reason) of an array column's shape."""
    if record["rank"] == 0:
        n = F.aggregate(shape, F.lit(1).cast("long"), lambda a, d: a * d)
        return F.struct(shape.alias("extents"), shape.alias("storage"), n.alias("elements"), F.lit(False).alias("padded"), F.lit(None).cast("string").alias("reason"))
    ext = [dimension(s["extent"], shape) for s in record["sub_axes"]]
    products = []
    for axis in range(record["rank"]):
        products.append(reduce(F.try_multiply, [e for e, s in zip(ext, record["sub_axes"]) if s["axis"] == axis]))
    dims = [F.get(shape, F.lit(a)) for a in range(record["rank"])]
    reason = F.when(F.size(shape) != record["rank"], "rank")
    for e in ext:
        reason = reason.when(e.isNull(), "formula")
    for p, d in zip(products, dims):
        reason = reason.when(p < d, "short")
    padded = reduce(lambda a, b: a | b, [p > d for p, d in zip(products, dims)])
    return F.struct(F.array(*ext).alias("extents"), F.array(*(ext[k] for k in record["permutation"])).alias("storage"), reduce(F.try_multiply, ext).alias("elements"), F.coalesce(padded, F.lit(False)).alias("padded"), reason.alias("reason"))


def source_index(i: Column, shape: list[int], record: dict) -> Column:
    """The source element of storage element ``i`` for a fixed shape; -1 is padding."""
    ext = [evaluate(s["extent"], shape) for s in record["sub_axes"]]
    perm = record["permutation"]
    coordinate: dict[int, Column] = {}
    step = 1
    for k in reversed(perm):
        coordinate[k] = F.pmod(F.call_function("div", i, F.lit(step)), F.lit(ext[k]))
        step *= ext[k]
    out, stride, inside = F.lit(0), 1, F.lit(True)
    for axis in reversed(range(len(shape))):
        at, unit = F.lit(0), 1
        for k in reversed([k for k, s in enumerate(record["sub_axes"]) if s["axis"] == axis]):
            at = at + coordinate[k] * unit
            unit *= ext[k]
        inside = inside & (at < shape[axis])
        out = out + at * stride
        stride *= shape[axis]
    return F.when(inside, out).otherwise(F.lit(-1))


def _elements(shape: list[int], record: dict) -> int:
    return int(np.prod([evaluate(s["extent"], shape) for s in record["sub_axes"]]))


def apply(values: Column, shape: list[int], record: dict, padding: Column | None = None) -> Column:
    """The elements in storage order; null if their number isn't the shape's. Padding is 0, or ``padding`` where another type
    of zero is wanted; without any, the type stays and null elements stay null."""
    if record["rank"] == 0:
        return values
    n, size = _elements(shape, record), int(np.prod(shape))
    at = lambda i: source_index(i, shape, record)
    element = lambda i: F.get(values, at(i).cast("int"))
    if n > size:
        zero = F.lit(0) if padding is None else padding
        moved = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(at(i) >= 0, element(i)).otherwise(zero))
    else:
        moved = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), element)
    return F.when(F.size(values) == size, moved)


def apply_inverse(values: Column, shape: list[int], record: dict) -> Column:
    """The elements back in row-major order; padding is skipped. The places are computed once, on the driver."""
    if record["rank"] == 0:
        return values
    places = np.empty(int(np.prod(shape)), np.int64)
    src = indices(shape, record)
    places[src[src >= 0]] = np.flatnonzero(src >= 0)
    return F.when(F.size(values) == len(src), F.transform(F.array(*map(F.lit, places.tolist())), lambda i: F.get(values, i.cast("int"))))


def indices(shape: list[int], record: dict) -> np.ndarray:
    """The source element of each storage element, by numpy; -1 is padding."""
    ext = [evaluate(s["extent"], shape) for s in record["sub_axes"]]
    grid = np.full([int(np.prod([e for e, s in zip(ext, record["sub_axes"]) if s["axis"] == a])) for a in range(len(shape))], -1, np.int64)
    grid[tuple(slice(0, d) for d in shape)] = np.arange(int(np.prod(shape))).reshape(shape)
    return grid.reshape(ext).transpose(record["permutation"]).ravel()


def runs(shape: list[int], record: dict) -> np.ndarray:
    """(destination, source or -1, length) of the longest runs, in order of the destination."""
    src = indices(shape, record)
    new = np.ones(len(src), bool)
    new[1:] = np.where(src[1:] >= 0, src[1:] != src[:-1] + 1, src[:-1] >= 0)
    at = np.flatnonzero(new)
    return np.stack([at, src[at], np.diff(np.append(at, len(src)))], 1)


def ratify(record: dict, shapes: list[list[int]]) -> str | None:
    """Whether over some shapes every element is written once and comes back; the reason if not."""
    for shape in shapes:
        src = indices(shape, record)
        if not np.array_equal(np.sort(src[src >= 0]), np.arange(int(np.prod(shape)))):
            return "coverage"
    return None
