"""Elsasser fields, lag points and lag tetrahedra: cascade rates from affine gradients in lag space."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import dot, finite, minus, vector
from ..functions.order import running_total

SIGN = {"p": 1, "m": -1}
#: Runs of a stored pair at most.
RUNS = 32


def subtract_background(rows: DataFrame, b0: float, column: str = "v3") -> DataFrame:
    return rows.withColumn(column, F.col(column) - F.lit(b0))


def elsasser(rows: DataFrame, velocity: list[Column], field: list[Column], density: Column) -> DataFrame:
    """Adds z+ (zp1..3) and z- (zm1..3) = u +- B / sqrt(rho); a density that is zero or not finite is an error."""
    rho = F.when(finite(density) & (density != 0), density).otherwise(F.raise_error(F.lit("density must be finite and not zero")).cast("double"))
    rows = rows.withColumn("__root", F.sqrt(rho))
    cols = [(u + F.lit(s) * b / F.col("__root")).alias(f"z{n}{k}") for n, s in SIGN.items() for k, (u, b) in enumerate(zip(velocity, field, strict=True), 1)]
    return rows.select(*[c for c in rows.columns if c != "__root"], *cols)


def elsasser_pairs(rows: DataFrame) -> DataFrame:
    """Increments j - i of both fields and of unwrapped positions, for i < j at the same step."""
    keep = ["sc", "label", "ux", "uy", "uz", *[f"z{n}{k}" for n in SIGN for k in (1, 2, 3)]]
    a, b = (rows.select("step", *[F.col(c).alias(f"{s}_{c}") for c in keep]) for s in "ab")
    p = a.join(b, "step").where("a_sc < b_sc")
    lag = [(F.col(f"b_u{x}") - F.col(f"a_u{x}")).alias(f"l{k}") for k, x in enumerate("xyz", 1)]
    inc = [(F.col(f"b_z{n}{k}") - F.col(f"a_z{n}{k}")).alias(f"d{n}{k}") for n in SIGN for k in (1, 2, 3)]
    return p.select("step", F.col("a_sc").alias("i"), F.col("b_sc").alias("j"), F.concat_ws("__", "a_label", "b_label").alias("pair"), *lag, *inc)


def write_elsasser_pairs(pairs: DataFrame, path: str, run: int = 1024, steps: tuple[int | None, int | None] | None = None) -> None:
    """The pair product as Parquet, a folder for each pair and run of steps: who wants some pairs at some steps opens few files.

    Runs have ``run`` steps. In a series that would have more than RUNS of them they are doubled until it hasn't, so that the
    number of folders doesn't grow with the series; ``width`` is what they came to. In a file, rows lie by step, so that a scan
    skips what it doesn't want by the statistics of row groups. ``steps``: the first and the last step, where they are known.
    """
    first, last = steps or pairs.agg(F.min("step"), F.max("step")).first()
    width = run
    while last is not None and last // width - first // width >= RUNS:
        width *= 2
    rows = pairs.withColumn("width", F.lit(width).cast("long")).withColumn("run", F.floor(F.col("step") / width))
    rows = rows.repartition("pair", "run").sortWithinPartitions("width", "pair", "run", "step")
    rows.write.partitionBy("width", "pair", "run").option("compression", "zstd").parquet(path)


def read_elsasser_pairs(spark: SparkSession, path: str, labels: Sequence[str], steps: tuple[int, int], run: int = 1024) -> DataFrame:
    """The stored pairs of two of ``labels`` at the steps from the first to before the second, i and j being places among the labels.

    Pairs and runs are told by their folders, so the scan skips all others. Labels that repeat or that no stored pair has are errors.
    """
    if len(set(labels)) != len(labels) or len(labels) < 2:
        raise ValueError("name two different craft at least")
    stored = spark.read.parquet(path)
    names = stored.select("pair").distinct()
    known = {x for r in names.collect() for x in r.pair.split("__")}  # a row for each pair, from the folders' names
    if missing := sorted(set(labels) - known):
        raise ValueError(f"no stored pair of {', '.join(missing)}")
    first, last = steps
    some = stored.where(F.col("pair").isin([f"{a}__{b}" for a in labels for b in labels if a != b]))
    begin = F.col("run").cast("long") * F.col("width")
    some = some.where((begin < last) & (begin + F.col("width") > first) & (F.col("step") >= first) & (F.col("step") < last))
    order = F.array(*map(F.lit, labels))
    ends = F.split("pair", "__")
    return some.select("step", *[(F.array_position(order, F.get(ends, F.lit(k))) - 1).cast("long").alias(n) for k, n in enumerate("ij")], "pair", *[c for c in stored.columns if c not in ("step", "i", "j", "pair", "run", "width")])


def yaglom(pairs: DataFrame) -> DataFrame:
    """Per pair, means over the steps where all are finite: Y+ = dz- |dz+|**2 and Y- = dz+ |dz-|**2."""
    p, m = vector("dp1", "dp2", "dp3"), vector("dm1", "dm2", "dm3")
    yp, ym = [c * dot(p, p) for c in m], [c * dot(m, m) for c in p]
    mean = lambda y, k: F.avg(F.when(finite(y[0]) & finite(y[1]) & finite(y[2]), y[k]))
    return pairs.groupBy("i", "j", "pair").agg(*[mean(y, k).alias(f"{n}{k + 1}") for n, y in (("yp", yp), ("ym", ym)) for k in range(3)])


def lag_points(flux: DataFrame, lags: DataFrame, probes: int) -> DataFrame:
    """Two directed points for each pair: the stored one, and its reflection with lag and flux negated.

    ``pid`` is twice the pair's place among the pairs of ``probes``, plus one for the reflection, so pid ^ 1 reflects.
    """
    place = (F.col("i") * (2 * probes - F.col("i") - 1)) / 2 + F.col("j") - F.col("i") - 1
    rows = flux.join(lags, ["i", "j"]).withColumn("__p", place.cast("long"))
    cols = [f"{n}{k}" for n in ("l", "yp", "ym") for k in (1, 2, 3)]
    side = lambda s: F.struct((F.col("__p") * 2 + int(s < 0)).alias("pid"), *[(F.col(c) * s).alias(c) for c in cols])
    return rows.select(F.explode(F.array(side(1), side(-1))).alias("s")).select("s.*")


def _choose(x: np.ndarray, k: int) -> np.ndarray:
    """x over k in whole numbers: each product is divided as soon as it can be."""
    out = x.copy()
    for m in range(2, k + 1):
        out = out * (x - (m - 1)) // m
    return out


def unranked(rank: np.ndarray, size: int = 4) -> list[np.ndarray]:
    """The ascending combinations of these numbers: rank = (d over 4) + (c over 3) + (b over 2) + a."""
    out = []
    for k in range(size, 0, -1):
        at = np.floor((rank.astype(np.float64) * math.factorial(k)) ** (1 / k)).astype(np.int64) - 1  # no more than the largest x
        at = np.maximum(at, k - 1)
        while (low := _choose(at + 1, k) <= rank).any():
            at += low
        out.append(at)
        rank = rank - _choose(at, k)
    return out[::-1]


def combinations(points: DataFrame) -> DataFrame:
    """All a < b < c < d of the lag points, each from its number: the numbers are dealt to tasks in even ranges, nothing is joined.

    The points are few: n * (n - 1) for n probes.
    """
    ids = np.array(sorted(r.pid for r in points.select("pid").distinct().collect()), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]) for at in unranked(b.column("id").to_numpy())], list("abcd"))

    return points.sparkSession.range(math.comb(len(ids), 4)).mapInArrow(run, "a long, b long, c long, d long")


def not_redundant(rows: DataFrame) -> DataFrame:
    """Of a combination and its reflection the lexicographically smaller stays: a test of the row alone."""
    own = F.array("a", "b", "c", "d")
    other = F.array_sort(F.transform(own, lambda p: p.bitwiseXOR(F.lit(1).cast("long"))))
    return rows.where(own <= other)


def tetrahedra(points: DataFrame) -> DataFrame:
    """Distinct tetrahedra with the vertices of their four lag points and the barycentre."""
    rows = not_redundant(combinations(points))
    for v in "abcd":
        side = F.broadcast(points.select(F.col("pid").alias(v), *[F.col(c).alias(f"{v}_{c}") for c in points.columns if c != "pid"]))
        rows = rows.join(side, v)
    for k in (1, 2, 3):
        rows = rows.withColumn(f"c{k}", (F.col(f"a_l{k}") + F.col(f"b_l{k}") + F.col(f"c_l{k}") + F.col(f"d_l{k}")) / 4)
    return rows


def off_centre(rows: DataFrame, atol: float = 1e-12) -> DataFrame:
    c = vector("c1", "c2", "c3")
    return rows.where(F.sqrt(dot(c, c)) > atol)


MOST_CONDITION, MOST_D_EP = 1e12, 0.85
RATES = "a long, b long, c long, d long, elongation double, planarity double, d_ep double, det double, condition double, eps_plus double, eps_minus double, reason string"


def rates(rows: DataFrame, most: float = MOST_CONDITION, tiny: float = 1e-12) -> DataFrame:
    """Shape and cascade rates of each tetrahedron, in batches of 3 x 3 algebra.

    Eigenvalues of the tensor of the centred vertices (those below ``tiny`` of the largest count as 0) give elongation,
    planarity and their norm d_ep. epsilon+- = -1/4 trace of the affine gradient, through the adjugate of the lag
    differences; null, with a reason, where their condition number (Frobenius norm) is above ``most`` or a value isn't finite.
    """
    names = [f"{v}_{n}{k}" for n in ("l", "yp", "ym") for v in "abcd" for k in (1, 2, 3)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            v = np.stack([t.column(n).to_numpy(zero_copy_only=False) for n in names], 1).reshape(len(t), 3, 4, 3)
            at = v[:, 0] - v[:, 0].mean(1, keepdims=True)
            lam = np.linalg.eigvalsh(at.transpose(0, 2, 1) @ at / 4)[:, ::-1]
            lam = np.where(lam > tiny * lam[:, :1], lam, 0)
            diff = v[:, :, 1:] - v[:, :, :1]  # of lags and of both fluxes, from the first vertex
            b, c, d = (diff[:, 0, k] for k in range(3))
            adj = [np.stack([p[:, i] * q[:, j] - p[:, j] * q[:, i] for i, j in ((1, 2), (2, 0), (0, 1))], 1) for p, q in ((c, d), (d, b), (b, c))]
            trace = lambda y: sum((y[:, k, 0] * adj[k][:, 0] + y[:, k, 1] * adj[k][:, 1] + y[:, k, 2] * adj[k][:, 2] for k in (1, 2)), y[:, 0, 0] * adj[0][:, 0] + y[:, 0, 1] * adj[0][:, 1] + y[:, 0, 2] * adj[0][:, 2])  # noqa: E731, B023
            det = b[:, 0] * adj[0][:, 0] + b[:, 1] * adj[0][:, 1] + b[:, 2] * adj[0][:, 2]
            with np.errstate(all="ignore"):
                e = 1 - np.sqrt(np.where(lam[:, 0] > 0, lam[:, 1] / lam[:, 0], 0))
                p = 1 - np.sqrt(np.where(lam[:, 1] > 0, lam[:, 2] / lam[:, 1], 0))
                size = lambda x: np.sqrt(sum((y * y).sum(1) for y in x))
                cond = size((b, c, d)) * size(adj) / np.abs(det)
                eps = [trace(diff[:, n]) / det * -0.25 for n in (1, 2)]
            ill = (det == 0) | ~(cond <= most)
            odd = ~ill & ~(np.isfinite(eps[0]) & np.isfinite(eps[1]))
            reason = pa.array(np.where(ill, "ill-conditioned", "not finite"), mask=~(ill | odd))
            cols = [pa.array(e), pa.array(p), pa.array(np.sqrt(e * e + p * p)), pa.array(det), pa.array(cond, mask=det == 0), *[pa.array(x, mask=ill) for x in eps], reason]
            yield pa.RecordBatch.from_arrays([*[t.column(x) for x in "abcd"], *cols], [x.split()[0] for x in RATES.split(", ")])

    return rows.select(*"abcd", *names).mapInArrow(run, RATES)


def flagged(rows: DataFrame, most: float = MOST_D_EP) -> DataFrame:
    """Adds ``passes``: d_ep below ``most``. A flag, not a filter."""
    return rows.withColumn("passes", F.col("d_ep") < most)


def summaries(rows: DataFrame) -> DataFrame:
    """A row per metric: n, least, most, mean and population deviation of the finite values; rates only of tetrahedra that pass and are valid."""
    fine = F.col("passes") & F.col("reason").isNull()
    metrics = {"elongation": F.col("elongation"), "planarity": F.col("planarity"), "d_ep": F.col("d_ep"), "eps_plus": F.when(fine, F.col("eps_plus")), "eps_minus": F.when(fine, F.col("eps_minus"))}
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), c.alias("v")) for k, c in metrics.items()])).alias("s")).select("s.*")
    v = F.when(finite(F.col("v")), F.col("v"))
    return long.groupBy("metric").agg(F.count(v).alias("n"), F.min(v).alias("least"), F.max(v).alias("most"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"))


def histogram(rows: DataFrame, column: str, bins: int | None = None, symmetric: bool = False, digits: int = 6) -> DataFrame:
    """(bin, lo, hi, n) of the finite values: min(20, max(5, root of their number)) bins over their range, or over +- the greatest
    with ``symmetric``; the last bin is closed. Values are rounded first, so that bins don't hang on last bits."""
    v = rows.select(F.round(column, digits).alias("v")).where(finite(F.col("v")))
    n, lo, hi = v.agg(F.count("v"), F.min("v"), F.max("v")).first()
    if not n:
        lo = hi = 0.0
    if symmetric:
        hi = max(abs(lo), abs(hi))
        lo = -hi
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    bins = bins or min(20, max(5, int(n**0.5)))
    wide = (hi - lo) / bins
    at = F.least(F.floor((F.col("v") - F.lit(lo)) / F.lit(wide)), F.lit(bins - 1)).cast("int")
    every = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"), (F.lit(lo) + F.col("id") * F.lit(wide)).alias("lo"), (F.lit(lo) + (F.col("id") + 1) * F.lit(wide)).alias("hi"))
    counts = v.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return every.join(counts, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def cumulative(rows: DataFrame, column: str, digits: int = 5) -> DataFrame:
    """(value, n, fraction): for every value, rounded, the share of all that is at most that."""
    per = rows.select(F.round(column, digits).alias("value")).where(finite(F.col("value"))).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    upto = running_total(per, "n", "value")
    return upto.select("value", "n", (F.col("upto") / F.col("total")).alias("fraction"))


def preview(rows: DataFrame, limit: int = 64) -> DataFrame:
    """The first tetrahedra in the order of their points."""
    return rows.orderBy(*"abcd").limit(limit)
