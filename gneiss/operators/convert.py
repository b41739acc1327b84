"""Conversions between precisions: recipes, plans per tensor, and row-wise 8-bit kernels over arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.functions.floats import bf16, e4m3, f16, rowwise_scale
from gneiss.operators.ordered import large

RECIPES = {"plain": ("cast",), "fp8-rowwise": ("cast", "quantize-rowwise"), "fp8-storage": ("cast", "quantize")}
CASTABLE = ("F64", "F32", "F16", "BF16")


def recipe_for(rule: dict) -> tuple[str, ...] | None:
    """The kernels that make a rule's tensors; None for an unknown family, or for row-wise conventions that differ."""
    family = rule["name"].split(".", 1)[-1] if not rule["name"].startswith("plain.") else "plain"
    if family == "fp8-rowwise":
        c = rule.get("conventions") or {}
        if (c.get("element"), c.get("scale"), c.get("amax_divisor"), c.get("scale_dtype")) != ("fp8_e4m3", "per_channel_out", "448", "F32"):
            return None
    return RECIPES.get(family)


def conversion_plan(tensors: DataFrame, layout: DataFrame) -> DataFrame:
    """(artifact, name, step, reason) for tensors (artifact, component, name, dtype, shape) against a layout (component, key,
    dtypes, shape): inherit what isn't in it or fits it, refuse another shape, quantise to 8 bits where the layout has the
    scale and the tensor's artifact doesn't yet, cast between plain types."""
    scaled = lambda c: F.substr(c, F.lit(1), F.length(c) - len("_scale"))  # noqa: E731  the tensor that a scale belongs to
    scales = layout.where(F.endswith("key", F.lit("_scale"))).select("component", scaled("key").alias("name")).distinct().withColumn("scale_declared", F.lit(True))
    have = tensors.where(F.endswith("name", F.lit("_scale"))).select("artifact", "component", scaled("name").alias("name")).distinct().withColumn("scale_there", F.lit(True))
    want = layout.select("component", F.col("key").alias("name"), "dtypes", F.col("shape").alias("declared")).join(large(scales), ["component", "name"], "left")
    rows = tensors.select("artifact", "component", "name", "dtype", "shape").join(large(have), ["artifact", "component", "name"], "left").join(large(want), ["component", "name"], "left")
    fp8 = F.array_contains("dtypes", F.lit("F8_E4M3"))
    reason = (
        F.when(F.col("dtypes").isNull(), F.lit(None)).when(F.col("declared") != F.col("shape"), "shape").when(F.array_contains("dtypes", F.col("dtype")), F.lit(None))
        .when(fp8 & F.col("scale_declared").isNull(), "no-scale").when(~fp8 & ~F.col("dtype").isin(*CASTABLE), "dtype")
    )
    step = (
        F.when(reason.isNotNull(), F.lit(None)).when(F.col("dtypes").isNull() | F.array_contains("dtypes", F.col("dtype")), "inherit").when(fp8 & F.col("scale_there"), "inherit").when(fp8, "quantize-rowwise").otherwise("cast")
    )
    return rows.select("artifact", "component", "name", step.alias("step"), reason.alias("reason"))


def decode(content: bytes, dtype: str) -> np.ndarray:
    """The numbers that bytes of a plain type say, as doubles."""
    if dtype == "BF16":
        return (np.frombuffer(content, "<u2").astype(np.uint32) << 16).view(np.float32).astype(np.float64)
    return np.frombuffer(content, {"F64": "<f8", "F32": "<f4", "F16": "<f2"}[dtype]).astype(np.float64)


def encode(values: np.ndarray, dtype: str) -> bytes:
    """The bytes of numbers in a plain type, rounded to the nearest, ties to even."""
    if dtype == "BF16":
        bits = values.astype("<f4").view(np.uint32)
        rounded = ((bits + np.uint32(0x7FFF) + ((bits >> np.uint32(16)) & np.uint32(1))) >> np.uint32(16)).astype("<u2")
        return np.where(np.isnan(values), np.uint16(0x7FC0), rounded).astype("<u2").tobytes()
    with np.errstate(over="ignore"):
        return values.astype({"F64": "<f8", "F32": "<f4", "F16": "<f2"}[dtype]).tobytes()


def _e4m3_values() -> np.ndarray:
    code = np.arange(127)
    e, m = code >> 3, code & 7
    return np.where(e == 0, m * 2.0**-9, (1 + m / 8) * 2.0 ** (e - 7.0))


E4M3_VALUES = _e4m3_values()  # of the codes 0 to 126; 127 is NaN, and 128 more the negative ones


def e4m3_codes(values: np.ndarray) -> np.ndarray:
    """The 8-bit codes of numbers, as ``floats.e4m3`` rounds them."""
    m = np.minimum(np.where(np.isnan(values), 448.0, np.abs(values)), 448.0)
    high = np.minimum(np.searchsorted(E4M3_VALUES, m), 126)
    low = np.maximum(high - 1, 0)
    a, b = m - E4M3_VALUES[low], E4M3_VALUES[high] - m
    code = np.where((a < b) | ((a == b) & (low % 2 == 0)), low, high)
    code = np.where((m < 0.015625) & (code > 7), 7, code)
    return (code + np.where(values < 0, 128, 0)).astype(np.uint8)


def quantise_bytes(content: bytes, dtype: str, rows: int) -> tuple[bytes, bytes]:
    """The codes and the scales (F32) of a matrix's bytes, row by row."""
    x = decode(content, dtype).reshape(rows, -1)
    scale = np.maximum(np.nanmax(np.where(np.isnan(x), 0, np.abs(x)), 1, initial=0) / 448.0, 1e-12)
    return e4m3_codes(x / scale[:, None]).tobytes(), scale.astype("<f4").tobytes()


def convert_tree(tensors: DataFrame, plan: DataFrame, target: str = "BF16") -> DataFrame:
    """The tensors of a converted tree, as ``writer.compose`` takes them: of tensors (artifact, component, ord, name, dtype,
    shape, records, content) and their plan (``conversion_plan``), those to inherit with their records, cast ones as bytes of
    ``target``, quantised ones as codes with a tensor of scales after them. A tensor that the plan refuses, or whose bytes
    to be converted aren't there, is left out, with its reason in ``refused`` (content null, records null)."""
    rows = tensors.join(plan.select("artifact", "component", "name", "step", "reason"), ["artifact", "component", "name"])

    def f(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for r in pdf.itertuples():
                shape = [int(d) for d in r.shape]
                if r.step in ("cast", "quantize-rowwise") and r.content is None:
                    out.append((r.artifact, 2 * r.ord, r.name, r.dtype, shape, None, "no-bytes"))
                elif r.step == "cast":
                    out.append((r.artifact, 2 * r.ord, r.name, target, shape, encode(decode(bytes(r.content), r.dtype), target), None))
                else:
                    codes, scale = quantise_bytes(bytes(r.content), r.dtype, shape[0])
                    out.append((r.artifact, 2 * r.ord, r.name, "F8_E4M3", shape, codes, None))
                    out.append((r.artifact, 2 * r.ord + 1, f"{r.name}_scale", "F32", shape[:1], scale, None))
            yield pd.DataFrame(out, columns=["artifact", "ord", "name", "dtype", "shape", "content", "refused"])

    kind = tensors.schema["records"].dataType
    made = rows.where("step in ('cast', 'quantize-rowwise')").select("artifact", F.col("ord").cast("long").alias("ord"), "name", "dtype", "shape", "content", "step")
    made = made.mapInPandas(f, "artifact string, ord long, name string, dtype string, shape array<bigint>, content binary, refused string").withColumn("records", F.lit(None).cast(kind))
    rest = rows.where("step is null or step = 'inherit'").select("artifact", (F.col("ord") * 2).cast("long").alias("ord"), "name", "dtype", "shape", F.lit(None).cast("binary").alias("content"), F.col("reason").alias("refused"), F.when(F.col("reason").isNull(), F.col("records")).alias("records"))
    return made.unionByName(rest)


def quantise_rows(rows: DataFrame, values: str = "values") -> DataFrame:
    """Adds scale and codes (decoded) of each row's values: value / scale rounded to 8 bits."""
    scaled = rows.withColumn("scale", rowwise_scale(F.col(values)))
    return scaled.withColumn("codes", F.transform(values, lambda x: e4m3(x.cast("double") / F.col("scale"))))


def dequantise_error(rows: DataFrame, values: str = "values") -> DataFrame:
    """Adds the greatest error of the row's values after quantising and back."""
    q = quantise_rows(rows, values)
    errors = F.transform(F.arrays_zip(F.col(values).alias("v"), F.col("codes").alias("c")), lambda p: F.abs(p["v"].cast("double") - p["c"] * F.col("scale")))
    return q.withColumn("error", F.array_max(errors))


def cast_rows(rows: DataFrame, target: str, values: str = "values") -> DataFrame:
    """The values in another plain type, as what they decode to."""
    kernel = {"BF16": bf16, "F16": f16, "F32": lambda x: x.cast("float").cast("double"), "F64": lambda x: x.cast("double")}[target]
    return rows.withColumn(values, F.transform(values, kernel))
