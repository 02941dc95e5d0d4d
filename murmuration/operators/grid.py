"""Regular grids: lookups as equi-joins on cell indices, finite differences as windows along an axis."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AXES = ("ix", "iy", "iz")
VALUES = ("v1", "v2", "v3")


def spacing(box: Sequence[float], shape: Sequence[int]) -> list[float]:
    if any(b <= 0 for b in box):
        raise ValueError("box lengths must be positive")
    return [b / (n - 1) if n > 1 else b for b, n in zip(box, shape, strict=True)]


def nearest_cells(points: DataFrame, box: Sequence[float], shape: Sequence[int], position: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """Adds the nearest cell: half-even rounding, clamped at the faces; an axis of one cell is 0."""
    for axis, p, h, n in zip(AXES, position, spacing(box, shape), shape, strict=True):
        at = F.greatest(F.lit(0.0), F.least(F.rint(F.col(p) / F.lit(h)), F.lit(float(n - 1)))) if n > 1 else F.lit(0)
        points = points.withColumn(axis, at.cast("long"))
    return points


def sample_nearest(points: DataFrame, grid: DataFrame, box: Sequence[float], shape: Sequence[int], position: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    return nearest_cells(points, box, shape, position).join(grid, list(AXES))


def sample_trilinear(points: DataFrame, grid: DataFrame, key: Sequence[str], box: Sequence[float], shape: Sequence[int], position: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """Periodic trilinear interpolation: each point meets its eight corners by index, weights sum per point."""
    for axis, p, h in zip("xyz", position, spacing(box, shape), strict=True):
        points = points.withColumn(f"__f{axis}", F.col(p) / F.lit(h)).withColumn(f"__l{axis}", F.floor(f"__f{axis}"))

    def corner(side: tuple[int, int, int]) -> Column:
        cell = [F.pmod(F.col(f"__l{a}") + s, F.lit(n)).cast("long").alias(i) for a, s, n, i in zip("xyz", side, shape, AXES, strict=True)]
        weight = F.lit(1.0)
        for a, s in zip("xyz", side, strict=True):
            w = F.col(f"__f{a}") - F.col(f"__l{a}")
            weight = weight * (w if s else 1 - w)
        return F.struct(*cell, weight.alias("w"))

    corners = F.array(*[corner((i, j, k)) for i in (0, 1) for j in (0, 1) for k in (0, 1)])
    rows = points.select(*key, F.explode(corners).alias("c")).select(*key, "c.*").join(grid, list(AXES))
    return rows.groupBy(*key).agg(*[F.sum(F.col("w") * F.col(v)).alias(v) for v in VALUES])


def corner_table(grid: DataFrame, shape: Sequence[int]) -> DataFrame:
    """Each cell with the values at its up to eight corners, side by side: lookups that may not aggregate, as in a stream, join it once."""
    sides = F.array(*[F.struct(F.lit(i).alias("x"), F.lit(j).alias("y"), F.lit(k).alias("z")) for i in (0, 1) for j in (0, 1) for k in (0, 1)])
    rows = grid.select(*AXES, *VALUES, F.explode(sides).alias("side"))
    low = [F.pmod(F.col(a) - F.col(f"side.{a[1]}"), F.lit(n)).cast("long").alias(a) for a, n in zip(AXES, shape, strict=True)]
    return rows.select(*low, F.struct("side", *VALUES).alias("corner")).groupBy(*AXES).agg(F.collect_list("corner").alias("corners"))


def at_corners(points: DataFrame, corners: DataFrame, box: Sequence[float], shape: Sequence[int], position: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """``points`` with the periodic trilinear value at their place, null where the grid has no corner there."""
    part = {}
    for axis, p, h, n in zip(AXES, position, spacing(box, shape), shape, strict=True):
        at = F.col(p) / F.lit(h)
        part[axis[1]] = at - F.floor(at)
        points = points.withColumn(axis, F.pmod(F.floor(at), F.lit(n)).cast("long"))

    def weight(side: Column) -> Column:
        return reduce(lambda a, b: a * b, [F.when(side[a] == 1, f).otherwise(1 - f) for a, f in part.items()])

    value = lambda v: F.aggregate("corners", F.lit(0.0), lambda total, c: total + weight(c["side"]) * c[v])
    return points.join(corners, list(AXES), "left").select(*[F.col(c) for c in points.columns], *[value(v).alias(v) for v in VALUES])


SAMPLERS = ("nearest", "trilinear")


def sample(method: str, points: DataFrame, grid: DataFrame, key: Sequence[str], box: Sequence[float], shape: Sequence[int], position: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """The grid's values at ``points`` by the method named, one row per ``key``."""
    if method not in SAMPLERS:
        raise ValueError(f"method must be one of {', '.join(SAMPLERS)}")
    if method == "trilinear":
        return sample_trilinear(points, grid, key, box, shape, position)
    return sample_nearest(points, grid, box, shape, position).select(*key, *VALUES)


def difference(value: str, axis: str, h: float) -> Column:
    """First derivative along an axis: central inside, one-sided at the ends."""
    w = Window.partitionBy(*[a for a in AXES if a != axis]).orderBy(axis)
    before, after, here = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
    return F.when(before.isNull(), (after - here) / h).when(after.isNull(), (here - before) / h).otherwise((after - before) / (2 * h))


def gradient(grid: DataFrame, value: str, steps: Sequence[float]) -> DataFrame:
    return grid.select(*AXES, *[difference(value, a, h).alias(f"d{a[1]}") for a, h in zip(AXES, steps, strict=True)])


def divergence(grid: DataFrame, steps: Sequence[float], axes: int = 3) -> DataFrame:
    """Divergence over the first ``axes`` axes: with 2, of each plane by itself."""
    parts = [difference(v, a, h) for v, a, h in zip(VALUES, AXES, steps, strict=True)][:axes]
    return grid.select(*AXES, reduce(lambda a, b: a + b, parts).alias("div"))


def curl(grid: DataFrame, steps: Sequence[float]) -> DataFrame:
    """The field whose vector potential the grid holds."""
    d = lambda v, k: difference(v, AXES[k], steps[k])
    return grid.select(*AXES, (d("v3", 1) - d("v2", 2)).alias("v1"), (d("v1", 2) - d("v3", 0)).alias("v2"), (d("v2", 0) - d("v1", 1)).alias("v3"))
