"""Shape formulas: chains of integers, axes ``dN`` and ``ceil(...)`` by ``*`` and ``/``, compiled to column expressions.

A division outside ``ceil`` must be exact, each one inside it rounds up; a missing axis, an inexact division or an overflow
gives null, which callers report as a refusal.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


class FormulaError(ValueError):
    """A formula that can't be read."""


@dataclass(frozen=True)
class Factor:
    """An integer, an axis or a ceiling, with the sign before it."""

    divides: bool
    number: int | None = None
    axis: int | None = None
    inner: tuple[Factor, ...] | None = None


_ATOM = re.compile(r"d([0-9]+)|([0-9]+)")


def parse(text: str) -> tuple[Factor, ...]:
    """The factors of a formula."""
    factors, at = _chain(text.replace(" ", ""), 0, text)
    if at != len(text.replace(" ", "")):
        raise FormulaError(f"{text!r}: stray {text.replace(' ', '')[at]!r}")
    return factors


def _chain(s: str, at: int, text: str) -> tuple[tuple[Factor, ...], int]:
    out: list[Factor] = []
    divides = False
    while True:
        if s.startswith("ceil(", at):
            inner, at = _chain(s, at + 5, text)
            if at >= len(s) or s[at] != ")":
                raise FormulaError(f"{text!r}: unclosed ceil(")
            at += 1
            out.append(Factor(divides, inner=inner))
        else:
            m = _ATOM.match(s, at)
            if not m or (m[2] is not None and int(m[2]) == 0):
                raise FormulaError(f"{text!r}: no axis or positive integer at {at}")
            at = m.end()
            out.append(Factor(divides, axis=int(m[1])) if m[1] is not None else Factor(divides, number=int(m[2])))
        if at >= len(s) or s[at] == ")":
            return tuple(out), at
        if s[at] not in "*/":
            raise FormulaError(f"{text!r}: stray {s[at]!r}")
        divides, at = s[at] == "/", at + 1


def _value(f: Factor, shape: Column) -> Column:
    if f.number is not None:
        return F.lit(f.number).cast("long")
    if f.axis is not None:
        return F.get(shape, F.lit(f.axis)).cast("long")
    return _evaluate(f.inner or (), shape, True)


def _quotient(a: Column, b: Column) -> Column:
    """The whole quotient of two longs; null for a divisor of 0."""
    return F.call_function("div", a, F.nullif(b, F.lit(0).cast("long")))


def _evaluate(factors: tuple[Factor, ...], shape: Column, ceiling: bool) -> Column:
    out = F.lit(1).cast("long")
    for f in factors:
        v = _value(f, shape)
        if not f.divides:
            out = F.try_multiply(out, v)
        elif ceiling:
            out = _quotient(F.try_add(out, v - 1), v)
        else:
            out = F.when(F.try_mod(out, v) == 0, _quotient(out, v))
    return out


def dimension(formula: str, shape: Column) -> Column:
    """The value of one formula over a shape."""
    return _evaluate(parse(formula), shape, False)


def dimensions(formulas: list[str], shape: Column) -> Column:
    """The values of some formulas; null if any is."""
    parts = [dimension(f, shape) for f in formulas]
    good = F.lit(True)
    for p in parts:
        good = good & p.isNotNull()
    return F.when(good, F.array(*parts) if parts else F.array().cast("array<long>"))


def evaluate(formula: str, shape: list[int]) -> int | None:
    """The value of a formula over a shape on the driver."""

    def chain(factors: tuple[Factor, ...], ceiling: bool) -> int | None:
        out = 1
        for f in factors:
            if f.number is not None:
                v: int | None = f.number
            elif f.axis is not None:
                v = shape[f.axis] if f.axis < len(shape) else None
            else:
                v = chain(f.inner or (), True)
            if v is None:
                return None
            if not f.divides:
                out *= v
            elif v == 0:
                return None
            elif ceiling:
                out = -(-out // v)
            elif out % v:
                return None
            else:
                out //= v
        return out

    return chain(parse(formula), False)
