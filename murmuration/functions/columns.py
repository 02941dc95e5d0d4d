"""Column expressions shared by the operators: vectors, bins, wrapping."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = Sequence[Column]


def vector(*names: str) -> list[Column]:
    return [F.col(n) for n in names]


def dot(a: Vector, b: Vector) -> Column:
    return reduce(lambda x, y: x + y, (p * q for p, q in zip(a, b, strict=True)))


def cross(a: Vector, b: Vector) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def minus(a: Vector, b: Vector) -> list[Column]:
    return [p - q for p, q in zip(a, b, strict=True)]


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def finite(c: Column) -> Column:
    """NaN equals itself and exceeds everything in Spark, so both ends are tested."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def wrap(c: Column, length: float) -> Column:
    return c - F.lit(length) * F.floor(c / F.lit(length))


def bin_index(value: Column, edges: Sequence[float], closed: bool) -> Column:
    """How many edges are at most ``value``, less one; with ``closed`` the last edge belongs to the last bin.

    Out of range: -1 below, len(edges) - 1 at or above the last edge unless it is closed.
    """
    # comparisons stay in generated code, a lambda over an array of edges doesn't
    at = reduce(lambda x, y: x + y, ((value >= F.lit(float(e))).cast("int") for e in edges)) - 1
    return F.when(value == F.lit(float(edges[-1])), len(edges) - 2).otherwise(at) if closed else at
