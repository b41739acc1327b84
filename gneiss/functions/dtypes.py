"""Element types: bits of each, which are quantised, and block layouts of the block-quantised container."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = {
    "F4": 4, "F6_E2M3": 6, "F6_E3M2": 6, "BOOL": 8, "U8": 8, "I8": 8, "F8_E5M2": 8, "F8_E4M3": 8, "F8_E8M0": 8, "F8_E5M2FNUZ": 8, "F8_E4M3FNUZ": 8,
    "I16": 16, "U16": 16, "F16": 16, "BF16": 16, "I32": 32, "U32": 32, "F32": 32, "I64": 64, "U64": 64, "F64": 64, "C64": 64,
}

#: Ids of the block-quantised container's types: name, elements and bytes of a block; ids that are missing were withdrawn.
BLOCKS = {
    0: ("F32", 1, 4), 1: ("F16", 1, 2), 2: ("Q4_0", 32, 18), 3: ("Q4_1", 32, 20), 6: ("Q5_0", 32, 22), 7: ("Q5_1", 32, 24), 8: ("Q8_0", 32, 34), 9: ("Q8_1", 32, 40),
    10: ("Q2_K", 256, 84), 11: ("Q3_K", 256, 110), 12: ("Q4_K", 256, 144), 13: ("Q5_K", 256, 176), 14: ("Q6_K", 256, 210), 15: ("Q8_K", 256, 292),
    16: ("IQ2_XXS", 256, 66), 17: ("IQ2_XS", 256, 74), 18: ("IQ3_XXS", 256, 98), 19: ("IQ1_S", 256, 50), 20: ("IQ4_NL", 32, 18), 21: ("IQ3_S", 256, 110), 22: ("IQ2_S", 256, 82),
    23: ("IQ4_XS", 256, 136), 24: ("I8", 1, 1), 25: ("I16", 1, 2), 26: ("I32", 1, 4), 27: ("I64", 1, 8), 28: ("F64", 1, 8), 29: ("IQ1_M", 256, 56), 30: ("BF16", 1, 2),
    34: ("TQ1_0", 256, 54), 35: ("TQ2_0", 256, 66), 39: ("MXFP4", 32, 17), 40: ("NVFP4", 64, 36), 41: ("Q1_0", 128, 18), 42: ("Q2_0", 64, 18),
}

PLAIN = ("F64", "F32", "F16", "BF16", "I64", "I32", "I16", "BOOL")


def bits(dtype: Column) -> Column:
    """Bits of an element; null for an unknown type."""
    out = F.when(F.lit(False), F.lit(0))
    for name, n in BITS.items():
        out = out.when(dtype == name, F.lit(n))
    return out


def n_bytes(dtype: Column, shape: Column) -> Column:
    """Bytes of a tensor; null for an unknown type, an overflow, or elements that don't fill whole bytes."""
    elements = F.aggregate(shape, F.lit(1).cast("long"), lambda a, d: F.try_multiply(a, d))
    total = F.try_multiply(elements, bits(dtype).cast("long"))
    return F.when(total % 8 == 0, F.call_function("div", total, F.lit(8).cast("long")))


def is_quantised(dtype: Column) -> Column:
    """Whether an element type is a quantisation rather than a number or an index."""
    return ~dtype.isin(*PLAIN)
