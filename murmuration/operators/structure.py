"""Structure functions of probe pairs: same-step pairs, perpendicular lag, moments per lag bin.

Pairs come from an equi-join on the step with the residual ``i < j``; every moment is one pass of partial and final
aggregation, so a step's pairs are never gathered.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import bin_index, cross, finite, minus, norm, vector
from ..functions.tables import stage


def log_edges(low: float, high: float, bins: int) -> list[float]:
    """Edges computed once, in numpy, and sent as literals."""
    if bins <= 0 or low <= 0 or high < low:
        raise ValueError("bins and the lower edge must be positive and the range ascending")
    if low == high:
        low, high = low * 0.99, high * 1.01
    inner = np.logspace(np.log10(low), np.log10(high), bins + 1)[1:-1]
    return [float(low), *map(float, inner), float(high)]


def least_spacing(steps: Sequence[float]) -> float:
    """Half the smallest grid spacing: lags below it can't be told from a grid's own."""
    return 0.5 * min(steps)


def short_series(steps: int, order: int) -> bool:
    """Whether a series is too short for moments of an order."""
    return steps < order * np.log10(order)


def data_edges(pairs: DataFrame, bins: int, floor: float = 0.0) -> list[float]:
    """Log edges over the positive perpendicular lags, from ``floor`` at least: one small aggregate."""
    row = pairs.where(finite(F.col("lam")) & (F.col("lam") > 0)).agg(F.min("lam"), F.max("lam")).first()
    if row[0] is None:
        raise ValueError("no positive lag")
    return log_edges(max(row[0], floor), row[1], bins)


def same_step_pairs(series: DataFrame, id_col: str = "sc", position: Sequence[str] = ("x", "y", "z"), value: Sequence[str] = ("v1", "v2", "v3")) -> DataFrame:
    """(step, i, j) with i < j: separation dx.., mid field m.., difference d1.., perpendicular lag ``lam``."""
    cols = [id_col, *position, *value]
    a = series.select("step", *[F.col(c).alias(f"a_{c}") for c in cols])
    b = series.select("step", *[F.col(c).alias(f"b_{c}") for c in cols])
    p = a.join(b, "step").where(F.col(f"a_{id_col}") < F.col(f"b_{id_col}"))
    side = lambda s, names: vector(*[f"{s}_{n}" for n in names])
    r = minus(side("b", position), side("a", position))
    d = minus(side("b", value), side("a", value))
    mid = [(u + v) * 0.5 for u, v in zip(side("a", value), side("b", value), strict=True)]
    p = p.select("step", F.col(f"a_{id_col}").alias("i"), F.col(f"b_{id_col}").alias("j"), *[c.alias(f"r{k}") for k, c in enumerate(r, 1)], *[c.alias(f"d{k}") for k, c in enumerate(d, 1)], *[c.alias(f"m{k}") for k, c in enumerate(mid, 1)])
    return with_lag(p)


def with_lag(pairs: DataFrame) -> DataFrame:
    """Adds |r|, |B| and the length of the part of r that is perpendicular to the mid field (null without a field).

    They are computed once: the one-element array keeps later filters and bins on ``lam`` from being written out in full,
    over and over, in the condition of the join that made the pairs.
    """
    r, m = vector("r1", "r2", "r3"), vector("m1", "m2", "m3")
    # |r - (r.b)b| for the unit vector b along m is |r x m| / |m|
    lam = F.when(norm(m) > 0, norm(cross(r, m)) / norm(m))
    once = F.explode(F.array(F.struct(norm(r).alias("r"), norm(m).alias("b_local"), lam.alias("lam")))).alias("once")
    return pairs.select("*", once).select(*pairs.columns, "once.*")


def valid_pairs(pairs: DataFrame, edges: Sequence[float]) -> DataFrame:
    lam = F.col("lam")
    return pairs.where(finite(lam) & finite(F.col("d1")) & (lam > 0) & (lam >= edges[0]) & (lam <= edges[-1])).withColumn("bin", bin_index(lam, edges, True))


def all_bins(frame: DataFrame, edges: Sequence[float]) -> DataFrame:
    lo, hi = F.array(*map(F.lit, edges[:-1])), F.array(*map(F.lit, edges[1:]))
    return frame.sparkSession.range(len(edges) - 1).select(
        F.col("id").cast("int").alias("bin"), F.element_at(lo, F.col("id").cast("int") + 1).alias("lambda_lo"), F.element_at(hi, F.col("id").cast("int") + 1).alias("lambda_hi")
    )


def structure_functions(pairs: DataFrame, edges: Sequence[float], max_order: int = 4) -> DataFrame:
    """Per bin: n and S_p = mean |d1|**p for p = 1..max_order; empty bins have n = 0 and null moments."""
    if max_order <= 0:
        raise ValueError("max_order must be positive")
    d = F.abs("d1")
    moments = [F.avg(F.pow(d, F.lit(float(p)))).alias(f"s{p}") for p in range(1, max_order + 1)]
    sums = valid_pairs(pairs, edges).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), *moments)
    return F.broadcast(all_bins(pairs, edges)).join(sums, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def kurtosis(table: DataFrame) -> DataFrame:
    return table.withColumn("kurtosis", F.when(F.col("s2") != 0, F.col("s4") / (F.col("s2") * F.col("s2"))))


def bin_summary(pairs: DataFrame, edges: Sequence[float]) -> DataFrame:
    stats = [f(c).alias(f"{n}_{c}") for c in ("lam", "dv", "b_local", "r") for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))]
    return valid_pairs(pairs, edges).withColumn("dv", F.abs("d1")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), *stats)


def _reasons(edges: Sequence[float]) -> list[Column]:
    lam = F.col("lam")
    place, mid = finite(F.col("r")), finite(F.col("b_local"))
    field = place & mid & (F.col("b_local") > 0)
    lag = field & finite(lam) & (lam > 0)
    kept = lag & (lam >= edges[0]) & (lam <= edges[-1])
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return [
        F.count(F.lit(1)).alias("total"), n(kept).alias("kept"), n(~place).alias("bad_position"), n(~mid).alias("bad_field"), n(place & mid & (F.col("b_local") <= 0)).alias("zero_field"),
        n(field & ~F.coalesce(lag, F.lit(False))).alias("zero_lag"), n(lag & ~kept).alias("out_of_range"),
    ]


def exclusions(pairs: DataFrame, edges: Sequence[float]) -> DataFrame:
    """One row: total, kept, and why pairs were left out. Positions and fields that aren't finite are counted each for itself,
    and a pair may have both; the later reasons presume the earlier ones."""
    return pairs.agg(*_reasons(edges))


def write_valid_pairs(pairs: DataFrame, edges: Sequence[float], path: str) -> dict[str, int]:
    """Writes the pairs that are kept, and counts those left out while they pass: one run over the pairs for both."""
    seen = Observation("exclusions")
    good = finite(F.col("r")) & finite(F.col("b_local"))
    valid_pairs(pairs.observe(seen, *_reasons(edges)).where(good), edges).write.parquet(path)
    return seen.get


def undersampled(table: DataFrame, fraction: float = 0.05) -> DataFrame:
    """Flags bins with fewer than ``fraction`` of the fullest bin's pairs; all of them if every bin is empty."""
    if fraction < 0:
        raise ValueError("fraction must not be negative")
    most = F.max("n").over(Window.partitionBy())
    return table.withColumn("undersampled", (most == 0) | (F.col("n") < F.lit(fraction) * most))


def compare(production: DataFrame, reference: DataFrame, order: str = "s2", bins: int = 3, limit: float = 0.5) -> DataFrame:
    """The first populated bins side by side: relative difference, and whether it exceeds ``limit``."""
    a = production.select("bin", F.col(order).alias("production"))
    b = reference.select("bin", F.col(order).alias("reference"))
    rows = a.join(b, "bin", "full_outer").where(F.col("bin") < bins)
    apart = F.when(F.col("reference") != 0, F.abs(F.col("production") - F.col("reference")) / F.abs("reference"))
    return rows.withColumn("relative", apart).withColumn("warns", F.coalesce(apart > limit, F.lit(False)))


def local_offset_pairs(grid: DataFrame, reach: int = 1) -> DataFrame:
    """Each unordered pair of grid cells at most ``reach`` apart on every axis, once: an equi-join on shifted indices."""
    if reach <= 0:
        raise ValueError("reach must be positive")
    span = range(-reach, reach + 1)
    half = [(i, j, k) for i in span for j in span for k in span if (i, j, k) > (0, 0, 0)]
    shift = F.explode(F.array(*[F.struct(*[F.lit(v).cast("long").alias(n) for v, n in zip(o, ("oi", "oj", "ok"), strict=True)]) for o in half])).alias("o")
    a = grid.select(*[F.col(c).alias(f"a_{c}") for c in grid.columns], shift)
    a = a.select("*", *[(F.col(f"a_{c}") + F.col(f"o.{o}")).alias(f"b_{c}") for c, o in (("ix", "oi"), ("iy", "oj"), ("iz", "ok"))])
    b = grid.select(*[F.col(c).alias(f"b_{c}") for c in grid.columns])
    return a.join(b, ["b_ix", "b_iy", "b_iz"]).drop("o")


def cube_range(box: Sequence[float], steps: Sequence[float], low: float | None = None, high: float | None = None) -> tuple[float, float]:
    """Perpendicular lags of a cube: from the least spacing (or ``low``, but at least half of that) to the longer side across z."""
    low = max(min(steps) if low is None else low, least_spacing(steps))
    high = max(box[0], box[1]) if high is None else high
    if low <= 0 or high < low:
        raise ValueError("the range of lags must be positive and ascending")
    return low, high


def cell_pairs(pairs: DataFrame, steps: Sequence[float]) -> DataFrame:
    """Separation, difference, mid field and perpendicular lag of pairs of cells (a_ix.., a_v1.., b_ix.., b_v1..)."""
    axes, values = ("ix", "iy", "iz"), ("v1", "v2", "v3")
    r = [(F.lit(h) * (F.col(f"b_{a}") - F.col(f"a_{a}"))).alias(f"r{k}") for k, (h, a) in enumerate(zip(steps, axes, strict=True), 1)]
    d = [(F.col(f"b_{v}") - F.col(f"a_{v}")).alias(f"d{v[1]}") for v in values]
    mid = [((F.col(f"a_{v}") + F.col(f"b_{v}")) * 0.5).alias(f"m{v[1]}") for v in values]
    more = [c for c in pairs.columns if c[:2] not in ("a_", "b_")]
    return with_lag(pairs.select(*more, *[f"{s}_{a}" for s in "ab" for a in axes], *r, *d, *mid))


@dataclass
class Sample:
    """``considered``: every distinct pair in range that was drawn, with round, bin and whether it was taken; and how many draws and distinct pairs it took."""

    considered: DataFrame
    drawn: int
    distinct: int
    covered: bool

    @property
    def pairs(self) -> DataFrame:
        return self.considered.where("taken")


def drawn_pairs(spark: SparkSession, first: int, last: int, cells: int, seed: int) -> DataFrame:
    """(id, left, right) of the draws ``first`` to ``last``: a draw is a function of the seed and its number alone; a cell with itself is none."""
    h = F.md5(F.concat(F.lit(f"{seed},"), F.col("id").cast("string")).cast("binary"))
    cell = lambda at: F.conv(F.substring("h", at, 15), 16, 10).cast("long") % F.lit(cells)
    two = spark.range(first, last).select(h.alias("h")).select(cell(1).alias("l"), cell(17).alias("r")).where("l <> r")
    two = two.select(F.least("l", "r").alias("left"), F.greatest("l", "r").alias("right")).distinct()
    return two.select((F.col("left") * F.lit(cells) + F.col("right")).alias("id"), "left", "right")


def cube_random_pairs(grid: DataFrame, shape: Sequence[int], steps: Sequence[float], edges: Sequence[float], target: int = 256, budget: int = 200_000, seed: int = 0, least: int = 4096) -> Sample:
    """Random pairs of all cells of a cube, at most ``target`` in each bin of the perpendicular lag.

    Pairs are drawn from the space of all pairs, which is never built, in rounds: eight draws (and ``least`` at least) for each
    pair that the bins still lack, until all bins are full or ``budget`` draws are spent. A round's pairs are those that no
    round before has drawn; a bin takes them in the order of their ids. Cells that the grid lacks drop out with their pairs.
    """
    if target <= 0 or budget <= 0:
        raise ValueError("target and budget must be positive")
    spark, bins, cells = grid.sparkSession, len(edges) - 1, int(np.prod(shape))
    if cells < 2:
        raise ValueError("a cube needs two cells")
    at = (F.col("ix") * shape[1] + F.col("iy")) * shape[2] + F.col("iz")
    side = lambda s, key: grid.select(at.alias(key), *[F.col(c).alias(f"{s}_{c}") for c in ("ix", "iy", "iz", "v1", "v2", "v3")])
    held, spent, distinct, rounds, seen = [0] * bins, 0, 0, [], None
    while spent < budget and min(held) < target:
        size = min(budget - spent, max(least, 8 * sum(target - n for n in held)))
        new = drawn_pairs(spark, spent, spent + size, cells, seed)
        new = stage(new if seen is None else new.join(seen, "id", "left_anti"), "pairs-drawn")
        seen = new.select("id") if seen is None else seen.unionByName(new.select("id"))
        pairs = cell_pairs(new.join(side("a", "left"), "left").join(side("b", "right"), "right").drop("left", "right"), steps)
        room = F.element_at(F.array(*[F.lit(target - n) for n in held]), F.col("bin") + 1)
        rank = F.row_number().over(Window.partitionBy("bin").orderBy("id"))  # of a round's draws, not of the cube's pairs
        taken = valid_pairs(pairs, edges).withColumn("taken", rank <= room).withColumn("round", F.lit(len(rounds)))
        rounds.append(stage(taken, "pairs-considered"))
        for r in rounds[-1].where("taken").groupBy("bin").agg(F.count(F.lit(1)).alias("n")).collect():
            held[r.bin] += r.n
        spent, distinct = spent + size, distinct + new.count()
    return Sample(reduce(lambda a, b: a.unionByName(b), rounds), spent, distinct, min(held) >= target)


def sampling_bins(sample: Sample, edges: Sequence[float], target: int) -> DataFrame:
    """Per bin: candidates in range, accepted, accepted of the candidates, and accepted of the target."""
    n = sample.considered.groupBy("bin").agg(F.count(F.lit(1)).alias("candidates"), F.count_if("taken").alias("accepted"))
    rows = all_bins(sample.considered, edges).select("bin").join(n, "bin", "left").select("bin", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("candidates", "accepted")])
    share = F.when(F.col("candidates") > 0, F.col("accepted") / F.col("candidates")).otherwise(0.0)
    return rows.withColumn("accepted_fraction", share).withColumn("occupancy", F.col("accepted") / F.lit(target))


def sampling_diagnostics(sample: Sample, edges: Sequence[float], spacing: float, target: int, threshold: float = 0.5) -> DataFrame:
    """One row: draws, distinct pairs, those in range and accepted, their ratio, full coverage, the first filled bin and its centre, whether one of the
    first three bins is thin, and the candidates of bins whose centre is within 1, 2 and 4 spacings."""
    centre = F.element_at(F.array(*[F.lit(float(np.sqrt(a * b))) for a, b in zip(edges[:-1], edges[1:], strict=True)]), F.col("bin") + 1)
    rows = sampling_bins(sample, edges, target).withColumn("centre", centre)
    filled = F.col("accepted") > 0
    return rows.agg(
        F.lit(sample.drawn).cast("long").alias("drawn"), F.lit(sample.distinct).cast("long").alias("distinct_pairs"), F.sum("candidates").alias("in_range"), F.sum("accepted").alias("accepted"),
        F.when(F.sum("candidates") > 0, F.sum("accepted") / F.sum("candidates")).otherwise(0.0).alias("accepted_fraction"), F.lit(sample.covered).alias("covered"),
        F.min(F.when(filled, F.col("bin"))).alias("first_bin"), F.min(F.when(filled, F.col("centre"))).alias("first_centre"),
        F.coalesce(F.max(F.when(F.col("bin") < 3, F.col("occupancy") < threshold)), F.lit(True)).alias("left_edge_thin"),
        *[F.coalesce(F.sum(F.when(F.col("centre") <= k * spacing, F.col("candidates"))), F.lit(0)).alias(f"within_{k}") for k in (1, 2, 4)],
    )


def capped_pairs(pairs: DataFrame, edges: Sequence[float], target: int, order: Column) -> DataFrame:
    """At most ``target`` pairs of each bin: those of the least ``order``."""
    if target <= 0:
        raise ValueError("target must be positive")
    w = Window.partitionBy("bin").orderBy(order)
    return valid_pairs(pairs, edges).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= target)
