"""Space-time correlation of lagged probe pairs, by blocks.

The series is cut into at most 32 blocks and lags into runs of the same length. A block meets the two blocks where its
partners lie, and products over all lags of a run are summed as spectra. That suffices for the lags at which a pair of probes
stays within one bin of distance, as bounds tell, and in a rigid formation at constant velocity these are nearly all; the
others are gone through step by step, in short blocks whose size depends on the number of probes alone. Least distances whose
open lags lie scattered are taken from the long blocks instead, where one copy of the places serves all lags of a run.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import bin_index, dot, finite
from ..functions.tables import stage

LEVEL = float(np.exp(-1.0))


def fluctuations(series: DataFrame, value: str = "v1") -> DataFrame:
    """Adds mean, population sigma and fluctuation of each probe: two grouped passes, joined back on the probe."""
    v = F.when(~F.isnan(value), F.col(value))
    mean = series.groupBy("label").agg(F.avg(v).alias("mean"))
    rows = series.join(F.broadcast(mean), "label").withColumn("fluct", F.col(value) - F.col("mean"))
    sigma = rows.groupBy("label").agg(F.sqrt(F.avg(F.when(~F.isnan("fluct"), F.col("fluct") * F.col("fluct")))).alias("sigma"))
    return rows.join(F.broadcast(sigma), "label")


def cadence(series: DataFrame, rtol: float = 1e-8, atol: float = 1e-10) -> DataFrame:
    """One row per probe: steps, first difference of times and how many differences of consecutive steps stray from it.

    A step meets the one before it by an equi-join, so a probe's steps are never in one task.
    """
    before = series.select("label", (F.col("step") + 1).alias("step"), F.col("time_seconds").alias("__before"))
    gaps = series.select("label", "step", "time_seconds").join(before, ["label", "step"], "left").withColumn("gap", F.col("time_seconds") - F.col("__before"))
    first = gaps.groupBy("label").agg(F.count(F.lit(1)).alias("steps"), F.min_by("gap", F.when(F.col("gap").isNotNull(), F.col("step"))).alias("dt"))
    stray = F.abs(F.col("gap") - F.col("dt")) > F.lit(atol) + F.lit(rtol) * F.abs("dt")
    return gaps.join(F.broadcast(first), "label").groupBy("label", "steps", "dt").agg(F.count_if(stray).alias("stray"))


def centred_edges(lags: int, dt: float) -> list[float]:
    """Edges half a step around every lag: with them, each lag has a tau bin of its own."""
    return [(k - 0.5) * dt for k in range(lags + 2)]


def max_lag(steps: int, fraction: float = 0.5, explicit: int | None = None, seconds: float | None = None, dt: float | None = None) -> int:
    """The greatest lag in steps: the whole steps of ``dt`` within ``seconds``, or ``explicit``, or a share of the series."""
    if seconds is not None:
        if not dt or dt <= 0 or seconds < 0:
            raise ValueError("seconds need a positive cadence")
        explicit = math.floor(seconds / dt)
    lag = max(1, int((steps - 1) * fraction)) if explicit is None else explicit
    if not 0 <= lag < steps:
        raise ValueError("the lag is out of range")
    return lag


def linear_edges(low: float, high: float, bins: int) -> list[float]:
    if bins <= 0 or high < low:
        raise ValueError("bins must be positive and the range ascending")
    if low == high:
        wide = 0.5 * max(abs(low), 1.0)
        low, high = low - wide, high + wide
    return [float(e) for e in np.linspace(low, high, bins + 1)]


BLOCK = 512
#: Blocks that the series is first cut into, at most; and how many of them one group of sums takes as its earlier side.
COARSE, SEGMENT = 32, 8
#: From this share of a short run's pairs and lags on, open lags are gone through in short blocks. Steps that are measured at once.
DENSE, AT_ONCE = 0.125, 8192
AXES = ("ux", "uy", "uz")


def _coarse(steps: int, block: int) -> int:
    """How often ``block`` doubles until at most COARSE blocks hold the series."""
    k = 0
    while -(-steps // (block << k)) > COARSE:
        k += 1
    return k


def _placed(series: DataFrame) -> tuple[DataFrame, list[float], float]:
    """Rows with a finite position, with y = u - v * step; the velocity v a step that the probes share, and what rounding may add.

    v is the probes' mean from their first to their last place. Only how tight bounds are hangs on it.
    """
    good = reduce(lambda a, b: a & b, [finite(F.col(p)) for p in AXES])
    rows = series.where(good).select(F.col("step").cast("long").alias("step"), F.col("sc").cast("long").alias("sc"), *[F.col(c).cast("double").alias(c) for c in AXES])
    ends = rows.groupBy("sc").agg(F.min(F.struct("step", *AXES)).alias("a"), F.max(F.struct("step", *AXES)).alias("b"), *[F.max(F.abs(F.col(c))).alias(c) for c in AXES])
    steps = F.col("b.step") - F.col("a.step")
    slope = [F.avg(F.when(steps > 0, (F.col(f"b.{c}") - F.col(f"a.{c}")) / steps)) for c in AXES]
    got = ends.agg(*slope, F.max("b.step"), F.max(F.greatest(*AXES))).first()
    v = [x if x is not None and math.isfinite(x) else 0.0 for x in got[:3]]
    pad = 4.5e-16 * ((got[4] or 0.0) + max(map(abs, v)) * (got[3] or 0))
    return rows.select("*", *[(F.col(c) - F.lit(x) * F.col("step")).alias(f"y{c[1]}") for c, x in zip(AXES, v, strict=True)]), v, pad


HELD = [*AXES, "yx", "yy", "yz"]


def _boxes(rows: DataFrame, block: int) -> DataFrame:
    """(sc, block, n, first, last, lo_.., hi_..) of each probe's blocks of steps."""
    ends = [f(F.struct("step", *AXES)).alias(n) for f, n in ((F.min, "first"), (F.max, "last"))]
    return rows.groupBy("sc", F.floor(F.col("step") / block).alias("block")).agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{m}_{c}") for c in HELD for f, m in ((F.min, "lo"), (F.max, "hi"))], *ends)


def _merged(boxes: DataFrame, k: int) -> DataFrame:
    """Boxes of blocks that are longer by 2**k."""
    held = [f(f"{m}_{c}").alias(f"{m}_{c}") for c in HELD for f, m in ((F.min, "lo"), (F.max, "hi"))]
    return boxes.groupBy("sc", F.shiftright("block", k).alias("block")).agg(F.sum("n").alias("n"), *held, F.min("first").alias("first"), F.max("last").alias("last"))


@dataclass
class _Bounds:
    """Between what the distance of a lagged pair lies, for each run of ``size`` lags and pair of probes.

    Positions less the shared motion lie in boxes; a run's bound is the union over all steps, moved on by v for each lag. Of a
    rigid formation at constant velocity nothing but rounding is left.
    """

    size: int
    v: np.ndarray
    pad: float
    probes: np.ndarray
    low: np.ndarray  # (runs, probes, probes, axes)
    high: np.ndarray

    def reach(self, lags: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least, greatest) distance, of shape (pairs, lags); the lags belong to one run. NaN where there is no pair at all."""
        run = int(lags[0]) // self.size
        near, far = np.zeros((len(i), len(lags))), np.zeros((len(i), len(lags)))
        with np.errstate(all="ignore"):
            for k in range(3):
                move = self.v[k] * lags[None]
                lo, hi = self.low[run, i, j, k][:, None] + move - self.pad, self.high[run, i, j, k][:, None] + move + self.pad
                near += np.maximum(np.maximum(lo, -hi), 0.0) ** 2
                far += np.maximum(np.abs(lo), np.abs(hi)) ** 2
            near, far = np.sqrt(near) * (1 - 1e-14), np.sqrt(far) * (1 + 1e-14)
        none = ~np.isfinite(self.low[run, i, j]).all(-1)
        near[none] = far[none] = np.nan
        return near, far


def _bounds(boxes: DataFrame, k: int, size: int, lags: int, probes: np.ndarray, v: list[float], pad: float) -> _Bounds:
    runs, n = lags // size + 1, len(probes)
    low, high = np.full((runs + COARSE + 1, n, 3), np.inf), np.full((runs + COARSE + 1, n, 3), -np.inf)
    for r in _merged(boxes, k).collect():  # a row for each probe and coarse block
        at = int(np.searchsorted(probes, r.sc))
        low[r.block, at], high[r.block, at] = [r[f"lo_{c}"] for c in HELD[3:]], [r[f"hi_{c}"] for c in HELD[3:]]
    out_low, out_high = np.full((runs, n, n, 3), np.inf), np.full((runs, n, n, 3), -np.inf)
    for run in range(runs):
        for p in range(COARSE):
            for q in (p + run, p + run + 1):
                if q < len(low):
                    out_low[run] = np.minimum(out_low[run], low[q][None] - high[p][:, None])
                    out_high[run] = np.maximum(out_high[run], high[q][None] - low[p][:, None])
    return _Bounds(size, np.array(v), pad, probes, out_low, out_high)


def _shrunk(x: np.ndarray) -> bytes:
    """Doubles as second differences of their bits, byte by byte: next to nothing of what moves at constant velocity, and exact."""
    bits = np.diff(np.diff(x.view(np.int64), prepend=0), prepend=0)
    return zlib.compress(((bits << 1) ^ (bits >> 63)).view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _regrown(data: bytes) -> np.ndarray:
    bits = np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1).T.copy().view(np.uint64).ravel()
    bits = ((bits >> np.uint64(1)) ^ (np.uint64(0) - (bits & np.uint64(1)))).view(np.int64)
    return np.cumsum(np.cumsum(bits)).view(float)


def _packed(series: DataFrame, size: int, places: bool = False) -> DataFrame:
    """(block, sc, g, code): a block of a probe as arrays, g being fluct / sigma where that is finite; code 1 there, 3 with a place.

    With ``places`` also ux, uy, uz, which are NaN where there is no place.
    """
    rows = series.select(F.col("step").cast("long").alias("step"), F.col("sc").cast("long").alias("sc"), F.floor(F.col("step") / size).alias("block"), *[F.col(c).cast("double").alias(c) for c in ("fluct", "sigma", *AXES)])

    def pack(table: pa.Table) -> pa.Table:
        block, at = table["block"][0].as_py(), table["step"].to_numpy() % size
        g, code = np.zeros(size), np.zeros(size, np.uint8)
        with np.errstate(all="ignore"):
            g[at] = np.nan_to_num(table["fluct"].to_numpy() / table["sigma"].to_numpy(), posinf=0.0, neginf=0.0)
        u = np.column_stack([table[c].to_numpy() for c in AXES])
        good = np.isfinite(u).all(1)
        code[at] = 1 + 2 * good
        out = {"g": g.tobytes(), "code": code.tobytes()}
        for k, c in enumerate(AXES if places else ()):
            x = np.full(size, np.nan)
            x[at[good]] = u[good, k]
            out[c] = _shrunk(x)
        return pa.table({"block": [block], "sc": [table["sc"][0].as_py()], **{c: pa.array([b], pa.binary()) for c, b in out.items()}})

    return rows.groupBy("block", "sc").applyInArrow(pack, "block long, sc long, g binary, code binary" + "".join(f", {c} binary" for c in AXES if places))


def _lag_sums(packed: DataFrame, lags: int, size: int, steps: int, probes: np.ndarray, work: Callable[..., pa.Table], schema: str, held: int = 3) -> DataFrame:
    """``work`` on every (run of lags, segment of blocks): the lags, and for each probe i the sums of g's products and the pairs there are, for j from i on.

    A block meets the two blocks where its partners lie. Their sums over all lags of the run are one product of spectra, added up
    over the segment's blocks before they are turned back. Blocks are a fixed share of the series, so a row is copied a bounded
    number of times. ``held`` is the code that rows must have to count as pairs; 1 counts all and then those with a place.
    """
    blocks, runs = -(-steps // size), lags // size + 1
    meet = sorted({(place, run, p // SEGMENT, early) for run in range(runs) for p in range(blocks - run) for place, early in ((p, True), (p + run, False), (p + run + 1, False)) if place < blocks})
    spark = packed.sparkSession
    sides = spark.createDataFrame(meet, "block long, run long, part long, early boolean")  # bounded: a block's part in each run
    n = len(probes)
    counted = (1, 3) if held == 1 else (3,)

    def group(table: pa.Table) -> pa.Table:
        run = table["run"][0].as_py()
        row = {(e, b, int(np.searchsorted(probes, c))): k for k, (e, b, c) in enumerate(zip(table["early"].to_pylist(), table["block"].to_pylist(), table["sc"].to_pylist(), strict=True))}
        sums = [[np.zeros((n - i, size + 1), complex) for i in range(n)] for _ in range(1 + len(counted))]

        def read(early: bool, block: int, c: int) -> list[np.ndarray]:
            k = row.get((early, block, c))
            if k is None:
                return [np.zeros(size)] * len(sums)
            g, code = (np.frombuffer(table[x][k].as_buffer(), kind) for x, kind in (("g", float), ("code", np.uint8)))
            return [g * (code >= counted[0]), *[(code >= x).astype(float) for x in counted]]

        for p in sorted({b for e, b, _ in row if e}):
            first = [[np.fft.rfft(x, 2 * size).conj() for x in read(True, p, c)] for c in range(n)]
            window = [zip(read(False, p + run, c), read(False, p + run + 1, c), strict=True) for c in range(n)]
            window = [[np.fft.rfft(np.concatenate(two)) for two in w] for w in window]
            for kind, total in enumerate(sums):
                later = np.array([w[kind] for w in window])
                for i in range(n):
                    total[i] += first[i][kind] * later[i:]
        lag_list = np.arange(run * size, min((run + 1) * size, lags + 1))
        back = lambda x: np.fft.irfft(x, 2 * size)[:, : len(lag_list)]
        return work(lag_list, ((i, back(sums[0][i]), *[np.rint(back(s[i])).astype(np.int64) for s in sums[1:]]) for i in range(n)))

    parts = 4 * spark.sparkContext.defaultParallelism
    return packed.select("block", "sc", "g", "code").join(F.broadcast(sides), "block").repartition(parts, "run", "part").groupBy("run", "part").applyInArrow(group, schema)


def _unsure(spark: SparkSession, bounds: _Bounds, lags: int, sure: Callable[..., np.ndarray]) -> DataFrame:
    """(i, j, first, last): runs of lags for which the bounds don't tell what ``sure`` asks of them, by places of the probes."""
    i, j = np.triu_indices(len(bounds.probes))
    size, pairs, runs = bounds.size, len(i), lags // bounds.size + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [[], [], [], []]
            for at in b.column("id").to_pylist():
                lag_list, k = np.arange(at // pairs * size, min((at // pairs + 1) * size, lags + 1)), [at % pairs]
                near, far = bounds.reach(lag_list, i[k], j[k])
                edge = np.flatnonzero(np.diff(np.concatenate([[0], (~sure(near, far) & ~np.isnan(near))[0], [0]])))
                for lo, hi in zip(edge[::2], edge[1::2], strict=True):
                    for o, x in zip(out, (i[k[0]], j[k[0]], lag_list[lo], lag_list[hi - 1]), strict=True):
                        o.append(int(x))
            yield pa.RecordBatch.from_arrays([pa.array(o, pa.int64()) for o in out], ["i", "j", "first", "last"])

    tasks = spark.range(0, pairs * runs, 1, min(pairs * runs, 4 * spark.sparkContext.defaultParallelism))
    return stage(tasks.mapInArrow(run, "i long, j long, first long, last long"), "unsure-lags")


def _scattered(open_: DataFrame, block: int, pairs: int) -> tuple[DataFrame, DataFrame]:
    """Open lags cut by runs of ``block``: those of runs where few of all pairs' lags are open, and the others."""
    run = F.explode(F.sequence(F.floor(F.col("first") / block), F.floor(F.col("last") / block))).alias("run")
    cut = open_.select("i", "j", run, "first", "last").withColumn("first", F.greatest("first", F.col("run") * block)).withColumn("last", F.least("last", F.col("run") * block + (block - 1)))
    cut = cut.withColumn("open", F.sum(F.col("last") - F.col("first") + 1).over(Window.partitionBy("run")))  # a run has a bounded number of rows
    few, held = F.col("open") < F.lit(DENSE * pairs * block), ["i", "j", "first", "last"]
    return cut.where(few).select(*held), cut.where(~few).select(*held)


def _needed(open_: DataFrame, size: int, steps: int, probes: np.ndarray) -> DataFrame:
    """(run, sc, early, block, place): the blocks ``place`` of a probe that each group (block, run) of ``size`` with open lags takes."""
    runs = F.explode(F.sequence(F.floor(F.col("first") / size), F.floor(F.col("last") / size))).alias("run")
    place = F.array(*[F.lit(int(c)) for c in probes])
    both = F.explode(F.array(F.struct(F.col("i").alias("at"), F.lit(True).alias("early")), F.struct(F.col("j").alias("at"), F.lit(False).alias("early")))).alias("s")
    need = open_.select("i", "j", runs).distinct().select("run", both).select("run", F.get(place, F.col("s.at")).cast("long").alias("sc"), F.col("s.early").alias("early")).distinct()
    need = need.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit((steps - 1) // size) - F.col("run"), F.lit(0)))))
    ahead = F.when(F.col("early"), F.array(F.col("block"))).otherwise(F.array(F.col("block") + F.col("run"), F.col("block") + F.col("run") + 1))
    return need.withColumn("place", F.explode(ahead))


def _measured(series: DataFrame, open_: DataFrame, lags: int, bounds: _Bounds, sure: Callable[..., np.ndarray], work: Callable[..., pa.Table], schema: str, size: int, steps: int) -> DataFrame | None:
    """``work`` on every (block, run of lags) of ``size`` that holds open pairs, which are gone through step by step; None without any.

    A group holds three blocks of the probes that are open in its run, whatever the length of the series. Groups are as many as
    blocks for each run, far more than the table of open lags lets the planner expect, so their list is never broadcast.
    """
    probes = bounds.probes
    if not open_.limit(1).count():
        return None
    need = _needed(open_, size, steps, probes).hint("merge")
    keep = ["fluct", "sigma", *AXES]
    rows = series.select(F.col("step").cast("long").alias("step"), F.col("sc").cast("long").alias("sc"), F.floor(F.col("step") / size).alias("place"), *[F.col(c).cast("double").alias(c) for c in keep])

    def group(table: pa.Table) -> pa.Table:
        v = {c: table[c].to_numpy(zero_copy_only=False) if c == "early" else table[c].to_numpy() for c in ("step", "sc", "early", *keep)}
        start, lag0 = table["block"][0].as_py() * size, table["run"][0].as_py() * size
        sides = []
        for early, length, begin in ((True, size, start), (False, 2 * size, start + lag0)):
            at = np.flatnonzero(v["early"] == early)
            t, c = v["step"][at] - begin, np.searchsorted(probes, v["sc"][at])
            side = {n: np.full((length, len(probes)), np.nan) for n in ("f", "s", *AXES)}
            for n in AXES:
                side[n][t, c] = v[n][at]
            side["f"][t, c], side["s"][t, c] = v["fluct"][at], v["sigma"][at]
            side["there"] = np.zeros((length, len(probes)), bool)
            side["there"][t, c] = True
            sides.append(side)
        lag_list = np.arange(lag0, min(lag0 + size, lags + 1))
        near, far = bounds.reach(lag_list, *np.triu_indices(len(probes)))
        return work(lag_list, lag0, ~sure(near, far) & ~np.isnan(near), *sides)

    # the work of a group is far more than its bytes say: tasks by cores, not merged by size
    parts = 4 * series.sparkSession.sparkContext.defaultParallelism
    return rows.join(need, ["sc", "place"]).repartition(parts, "block", "run").groupBy("block", "run").applyInArrow(group, schema)


def _each_lag(lag_list: np.ndarray, lag0: int, open_: np.ndarray, a: dict[str, np.ndarray], b: dict[str, np.ndarray]):
    """(lag, i, j, there, r, product) of a group's open pairs, lag by lag; i <= j are places of probes.

    A product that isn't finite is 0. Pairs without an open lag are left out; where all others are open, the arrays are filled
    anew for each lag: fresh ones would cost more than the sums.
    """
    some = np.flatnonzero(open_.any(1))
    i, j = (x[some] for x in np.triu_indices(a["there"].shape[1]))
    with np.errstate(all="ignore"):
        left, right = ({n: side[n][:, k] for n in (*AXES, "there")} | {"g": np.nan_to_num((side["f"] / side["s"])[:, k], posinf=0.0, neginf=0.0)} for side, k in ((a, i), (b, j)))
        whole = [np.empty(left["ux"].shape, kind) for kind in (float, float, float, bool)]
        for lag in lag_list:  # the columns are laid out once, each lag is a slice of them
            s, k = slice(lag - lag0, lag - lag0 + len(left["ux"])), np.flatnonzero(open_[some, lag - lag0])
            if not len(k):
                continue
            every = len(k) == len(some)
            r, gap, product, there = whole if every else [np.empty((len(w), len(k)), w.dtype) for w in whole]
            first = (lambda n: left[n]) if every else (lambda n, k=k: left[n][:, k])
            later = (lambda n, s=s: right[n][s]) if every else (lambda n, s=s, k=k: right[n][s][:, k])
            r.fill(0.0)
            for n in AXES:
                np.subtract(later(n), first(n), out=gap)
                np.multiply(gap, gap, out=gap)
                np.add(r, gap, out=r)
            np.logical_and(first("there"), later("there"), out=there)
            np.multiply(first("g"), later("g"), out=product)
            yield lag, i[k], j[k], there, np.sqrt(r, out=r), product


def _least_scattered(packed: DataFrame, open_: DataFrame, size: int, steps: int, probes: np.ndarray) -> DataFrame:
    """(lag, i, j, r): the least distance within each of the series' long blocks, for every one of the open lags.

    A group is a block and a run of lags, as in ``_lag_sums``: what is copied doesn't grow with the number of open lags.
    """
    by = ["run", "block"]
    need = F.broadcast(_needed(open_, size, steps, probes))  # bounded: a probe's part in each run, of at most COARSE blocks
    held = packed.select(F.col("block").alias("place"), "sc", *AXES).join(need, ["sc", "place"])
    runs = F.explode(F.sequence(F.floor(F.col("first") / size), F.floor(F.col("last") / size))).alias("run")
    wanted = open_.select("*", runs).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((steps - 1) // size) - F.col("run"))).alias("block"))

    def group(table: pa.Table, lags: pa.Table) -> pa.Table:
        row = {key: k for k, key in enumerate(zip(*[table[c].to_pylist() for c in ("early", "place", "sc")], strict=True))}
        run, block = (lags[c][0].as_py() for c in by) if len(lags) else (0, 0)

        def read(early: bool, place: int, at: int) -> np.ndarray:
            k = row.get((early, place, int(probes[at])))
            none = np.inf if early else -np.inf  # so that without a place on either side a distance is infinite
            return np.full((3, size), none) if k is None else np.nan_to_num([_regrown(table[c][k].as_buffer()) for c in AXES], nan=none)

        first, later = {}, {}
        out = [[], [], [], []]
        for i, j, lo, hi in sorted(zip(*[lags[c].to_pylist() for c in ("i", "j", "first", "last")], strict=True)):
            if i not in first:
                first[i] = read(True, block, i)
            if j not in later:
                later[j] = np.concatenate([read(False, block + run, j), read(False, block + run + 1, j)], 1)
            for lag in range(max(lo, run * size), min(hi, run * size + size - 1) + 1):
                least = np.inf
                for s in range(0, size, AT_ONCE):
                    e = min(s + AT_ONCE, size)
                    gap = later[j][:, lag - run * size + s : lag - run * size + e] - first[i][:, s:e]
                    gap *= gap
                    least = min(least, float((gap[0] + gap[1] + gap[2]).min()))
                if least < np.inf:
                    for o, x in zip(out, (lag, int(probes[i]), int(probes[j]), math.sqrt(least)), strict=True):
                        o.append(x)
        return pa.table([pa.array(o, kind) for o, kind in zip(out, (pa.int32(), pa.int64(), pa.int64(), pa.float64()), strict=True)], ["lag", "i", "j", "r"])

    parts = 4 * packed.sparkSession.sparkContext.defaultParallelism
    sides = [x.repartition(parts, *by).groupBy(*by) for x in (held, wanted)]
    return sides[0].cogroup(sides[1]).applyInArrow(group, "lag int, i long, j long, r double")


@dataclass
class Distance:
    """The largest distance, of how many lagged pairs it was measured, and how many the blocks that meet have."""

    most: float
    measured: int
    pairs: int


def farthest(series: DataFrame, lags: int, block: int = BLOCK) -> Distance:
    """The largest distance of any lagged pair, by branch and bound over the boxes of each probe's blocks of steps.

    Two boxes are no farther apart than their farthest corners, nor, less the shared motion, than at their first or last lag; the
    places of a block's first and last step, and the nearest corners of blocks without gaps, give distances that are reached.
    It starts from at most COARSE blocks; pairs that may be farther than the best of these are halved until they are as long as
    ``block``, and what is left then is measured step by step.
    """
    rows, v, pad = _placed(series)
    rows = rows.withColumn("block", F.floor(F.col("step") / block))
    fine = stage(_boxes(rows, block), "boxes")
    steps = fine.agg(F.max("last.step")).first()[0]
    if steps is None:
        return Distance(0.0, 0, 0)
    key = ["a_sc", "a_block", "b_sc", "b_block"]
    corner = [F.greatest(F.abs(F.col(f"b_hi_{c}") - F.col(f"a_lo_{c}")), F.abs(F.col(f"a_hi_{c}") - F.col(f"b_lo_{c}"))) for c in AXES]
    least_lag, most_lag = F.greatest(F.col("b_first.step") - F.col("a_last.step"), F.lit(0)), F.least(F.col("b_last.step") - F.col("a_first.step"), F.lit(lags))
    whole = reduce(lambda a, b: a & b, [F.col(f"{s}_n") == F.col(f"{s}_last.step") - F.col(f"{s}_first.step") + 1 for s in "ab"])

    def moved(lag: Column) -> tuple[Column, Column]:
        sides = [(F.col(f"b_lo_{c}") - F.col(f"a_hi_{c}") + F.lit(x) * lag - F.lit(pad), F.col(f"b_hi_{c}") - F.col(f"a_lo_{c}") + F.lit(x) * lag + F.lit(pad)) for c, x in zip(HELD[3:], v, strict=True)]
        near, far = [F.greatest(lo, -hi, F.lit(0.0)) for lo, hi in sides], [F.greatest(F.abs(lo), F.abs(hi)) for lo, hi in sides]
        return F.sqrt(dot(near, near)) * (1 - 1e-12), F.sqrt(dot(far, far)) * (1 + 1e-12)

    def reached(p: str, q: str) -> Column:
        gap = [F.col(f"b_{q}.{c}") - F.col(f"a_{p}.{c}") for c in AXES]
        return F.when((F.col(f"b_{q}.step") - F.col(f"a_{p}.step")).between(0, lags), F.sqrt(dot(gap, gap)))

    (near_0, far_0), (near_1, far_1) = moved(least_lag), moved(most_lag)
    lower = F.greatest(*[F.coalesce(reached(p, q), F.lit(-1.0)) for p in ("first", "last") for q in ("first", "last")], F.when(whole, F.greatest(near_0, near_1)).otherwise(F.lit(-1.0)))
    upper = F.least(F.sqrt(dot(corner, corner)) * (1 + 1e-12), F.greatest(far_0, far_1))
    best, total, pairs = -1.0, 0, None
    for k in range(_coarse(steps + 1, block), -1, -1):
        boxes = stage(_merged(fine, k), "boxes") if k else fine
        a, b = (boxes.select(*[F.col(c).alias(f"{s}_{c}") for c in boxes.columns]) for s in "ab")
        if pairs is None:
            met = a.withColumn("b_block", F.explode(F.sequence(F.col("a_block"), F.col("a_block") + lags // (block << k) + 1))).join(b, "b_block").where("a_sc <= b_sc")
        else:
            halves = lambda c: F.explode(F.array(F.col(c) * 2, F.col(c) * 2 + 1)).alias(c)
            met = pairs.select("a_sc", halves("a_block"), "b_sc", "b_block").select("a_sc", "a_block", "b_sc", halves("b_block")).join(a, key[:2]).join(b, key[2:])
        met = stage(met.where(least_lag <= most_lag).select(*key, upper.alias("upper"), lower.alias("lower"), (F.col("a_n") * F.col("b_n")).alias("n")), "box-pairs")
        most, held = met.agg(F.max("lower"), F.sum("n")).first()
        if held is None:
            return Distance(max(best, 0.0), 0, total)
        best, total = max(best, most), total or held
        pairs = met.where(F.col("upper") >= F.lit(best * (1 - 1e-12) if best > 0 else best))
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s}_sc").alias("sc"), F.col(f"{s}_block").alias("block")) for s in "ab"])).alias("s")
    held = pairs.select(F.struct(*key).alias("pair"), sides).select("pair", "s.*").join(rows, ["sc", "block"])

    def measure(table: pa.Table) -> pa.Table:
        x, step, side = np.column_stack([table[c].to_numpy() for c in AXES]), table["step"].to_numpy(), np.array(table["side"].to_pylist())
        p, q = side == "a", side == "b"
        lag = step[None, q] - step[p, None]
        d2 = sum((x[None, q, k] - x[p, None, k]) ** 2 for k in range(3))
        there = (lag >= 0) & (lag <= lags)
        return pa.table({"most": [float(np.sqrt(d2[there].max(initial=-1.0))) if there.any() else -1.0], "n": [int(there.sum())]})

    most, n = held.groupBy("pair").applyInArrow(measure, "most double, n long").agg(F.max("most"), F.sum("n")).first()
    return Distance(max(most or 0.0, best, 0.0), n or 0, total)


def greatest_distance(series: DataFrame, lags: int, block: int = BLOCK) -> float:
    """The first pass: the largest distance of any lagged pair."""
    return farthest(series, lags, block).most


def _prepared(series: DataFrame, lags: int, block: int, place: bool = True, places: bool = False) -> tuple[DataFrame, int, int, np.ndarray, _Bounds | None]:
    """The packed blocks (with ``places``, those too), their size, the steps, the probes and, with ``place``, the bounds of distances."""
    steps = (series.agg(F.max("step")).first()[0] or 0) + 1
    k = _coarse(steps, block)
    packed = stage(_packed(series, block << k, places), "packed")
    probes = np.array(sorted(r.sc for r in packed.select("sc").distinct().collect()), np.int64)  # a row for each probe
    if not place:
        return packed, block << k, steps, probes, None
    rows, v, pad = _placed(series)
    return packed, block << k, steps, probes, _bounds(_boxes(rows, block), k, block << k, lags, probes, v, pad)


def correlation_map(
    series: DataFrame, lags: int, edges: Sequence[float], min_fraction: float = 0.01, least: int | None = None, block: int = BLOCK,
    tau_edges: Sequence[float] | None = None, dt: float = 1.0,
) -> DataFrame:
    """Per (lag, r bin), or per (tau_bin, r bin) of ``tau_edges`` in units of ``dt``: n, correlation and validity.

    The last edges are open: the largest distance is left out, and so are lags at or beyond the last tau edge. A cell is valid
    with ``least`` samples, or, without it, ``min_fraction`` of the fullest cell's. Pairs of probes whose distance stays within
    one bin at a lag are summed by spectra, all others step by step.
    """
    if tau_edges is not None and (len(tau_edges) < 2 or any(b <= a for a, b in zip(tau_edges[:-1], tau_edges[1:], strict=True))):
        raise ValueError("tau edges must ascend")
    limits, bins = np.asarray(edges, float), len(edges) - 1
    packed, size, steps, probes, bounds = _prepared(series, lags, block)
    bin_of = lambda r: np.searchsorted(limits, r, "right")  # noqa: E731  0: below the first edge, bins + 1: beyond the last
    sure = lambda near, far: bin_of(near) == bin_of(far)

    def cells(lag_list: np.ndarray, n: np.ndarray, total: np.ndarray) -> pa.Table:
        at, k = np.nonzero(n[:, 1 : bins + 1])
        return pa.table({"lag": pa.array(lag_list[at].astype(np.int32)), "r_bin": pa.array(k.astype(np.int32)), "n": pa.array(n[at, k + 1].astype(np.int64)), "total": pa.array(total[at, k + 1].astype(float))})

    def summed(lag_list: np.ndarray, probe) -> pa.Table:
        n, total = np.zeros((len(lag_list), bins + 2), np.int64), np.zeros((len(lag_list), bins + 2))
        row = np.arange(len(lag_list))
        for i, product, pairs in probe:
            j = np.arange(i, len(probes))
            near, far = bounds.reach(lag_list, np.full(len(j), i), j)
            ok = sure(near, far) & ~np.isnan(near)
            for k in range(len(j)):
                at = bin_of(near[k])[ok[k]]
                n[row[ok[k]], at] += pairs[k][ok[k]]
                total[row[ok[k]], at] += product[k][ok[k]]
        return cells(lag_list, n, total)

    def counted(lag_list: np.ndarray, *args) -> pa.Table:
        n, total = np.zeros((len(lag_list), bins + 2), np.int64), np.zeros((len(lag_list), bins + 2))
        for lag, _, _, there, r, product in _each_lag(lag_list, *args):
            at = np.zeros(r.shape, np.int16)
            for e in limits:  # few edges: comparing with each is faster than a search; NaN fails every comparison
                at += r >= e
            at = (at * there).astype(np.int64).ravel()
            n[lag - lag_list[0]], total[lag - lag_list[0]] = np.bincount(at, minlength=bins + 2), np.bincount(at, product.ravel(), bins + 2)
        return cells(lag_list, n, total)

    schema = "lag int, r_bin int, n long, total double"
    m = _lag_sums(packed, lags, size, steps, probes, summed, schema)
    rest = _measured(series, _unsure(series.sparkSession, bounds, lags, sure), lags, bounds, sure, counted, schema, block, steps)
    m = (m if rest is None else m.unionByName(rest)).groupBy("lag", "r_bin").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    axis = "lag"
    if tau_edges is not None:
        axis = "tau_bin"
        m = m.withColumn(axis, bin_index(F.col("lag") * F.lit(float(dt)), tau_edges, False)).where(F.col(axis).between(0, len(tau_edges) - 2))
        m = m.groupBy(axis, "r_bin").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    m = stage(m.select(axis, "r_bin", "n", (F.col("total") / F.col("n")).alias("corr")), "correlation")
    if least is not None:
        return m.withColumn("valid", (F.col("n") > 0) & (F.col("n") >= F.lit(least)))
    fullest = m.agg(F.ceil(F.lit(min_fraction) * F.max("n")).alias("enough"))
    return m.crossJoin(F.broadcast(fullest)).withColumn("valid", (F.col("n") > 0) & (F.col("n") >= F.col("enough"))).drop("enough")


def rigid_map(series: DataFrame, lags: int, block: int = BLOCK, digits: int = 5) -> DataFrame:
    """For a rigid formation at constant velocity: the distance of (i, j, lag) is constant, so products average first.

    ``r`` is the least distance, such that it is right when rounded to ``digits``: where bounds tell that, it is their mean, and
    elsewhere it is measured: run by run in the long blocks, or, where much of a short run is open, in the short ones.
    """
    packed, size, steps, probes, bounds = _prepared(series, lags, block, places=True)
    unit = 10.0**digits

    def sure(near: np.ndarray, far: np.ndarray) -> np.ndarray:
        return np.floor(near * unit + 0.5 - 1e-6) == np.floor(far * unit + 0.5 + 1e-6)

    def summed(lag_list: np.ndarray, probe) -> pa.Table:
        out = []
        for i, product, there, placed in probe:
            for k, j in enumerate(range(i, len(probes))):
                near, far = bounds.reach(lag_list, np.array([i]), np.array([j]))
                r = np.where(sure(near, far)[0] & (placed[k] > 0), (near[0] + far[0]) / 2, np.nan)
                some = there[k] > 0
                out.append((lag_list[some], np.full(some.sum(), probes[i]), np.full(some.sum(), probes[j]), there[k][some], product[k][some], r[some]))
        lag, i, j, n, total, r = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"lag": pa.array(lag.astype(np.int32)), "i": pa.array(i), "j": pa.array(j), "n": pa.array(n), "total": pa.array(total), "r": pa.array(r, mask=np.isnan(r))})

    def least(lag_list: np.ndarray, *args) -> pa.Table:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for lag, i, j, there, r, _ in _each_lag(lag_list, *args):
            far = np.where(there & np.isfinite(r), r, np.inf).min(0)
            out.append((np.full(len(i), lag), probes[i], probes[j], far))
        lag, i, j, r = (np.concatenate(x) for x in zip(*out, strict=True))
        some = np.isfinite(r)
        none = np.zeros(some.sum())
        return pa.table({"lag": pa.array(lag[some].astype(np.int32)), "i": pa.array(i[some]), "j": pa.array(j[some]), "n": pa.array(none.astype(np.int64)), "total": pa.array(none), "r": pa.array(r[some])})

    schema = "lag int, i long, j long, n long, total double, r double"
    rows = _lag_sums(packed, lags, size, steps, probes, summed, schema, 1)
    open_ = _unsure(series.sparkSession, bounds, lags, sure)
    few, many = _scattered(open_, block, len(probes) * (len(probes) + 1) // 2)
    if few.limit(1).count():
        found = _least_scattered(packed, few, size, steps, probes)
        rows = rows.unionByName(found.withColumns({"n": F.lit(0).cast("long"), "total": F.lit(0.0)}))
    rest = _measured(series, many, lags, bounds, sure, least, schema, block, steps)
    rows = rows if rest is None else rows.unionByName(rest)
    return rows.groupBy("lag", "i", "j").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.coalesce(F.min("r"), F.lit(float("inf"))).alias("r"))


def hub_autocorrelation(series: DataFrame, lags: int, hub: str = "H", block: int = BLOCK) -> DataFrame:
    """Per lag: pairs and mean product of one probe with itself, wherever it is."""
    packed, size, steps, probes, _ = _prepared(series.where(F.col("label") == hub), lags, block, False)

    def summed(lag_list: np.ndarray, probe) -> pa.Table:
        n, total = np.zeros(len(lag_list), np.int64), np.zeros(len(lag_list))
        for _, product, there, _ in probe:
            n, total = n + there[0], total + product[0]
        some = n > 0
        return pa.table({"lag": pa.array(lag_list[some].astype(np.int32)), "n": pa.array(n[some]), "total": pa.array(total[some])})

    rows = _lag_sums(packed, lags, size, steps, probes, summed, "lag int, n long, total double", 1)
    return rows.groupBy("lag").agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("corr"))


def axis_cuts(corr: DataFrame, edges: Sequence[float], dt: float) -> DataFrame:
    """(axis, x, corr, valid): the map along r at the lag nearest 0 and along lag at the r bin nearest 0."""
    centres = [(a + b) / 2 for a, b in zip(edges[:-1], edges[1:], strict=True)]
    nearest = int(np.argmin(np.abs(centres)))
    centre = F.element_at(F.array(*map(F.lit, centres)), F.col("r_bin") + 1)
    space = corr.where(F.col("lag") == 0).select(F.lit("r").alias("axis"), centre.alias("x"), "corr", "valid")
    time = corr.where(F.col("r_bin") == nearest).select(F.lit("tau").alias("axis"), (F.col("lag") * F.lit(dt)).alias("x"), "corr", "valid")
    return space.unionByName(time)


def first_crossing(cuts: DataFrame, level: float = LEVEL) -> DataFrame:
    """Per axis: where the valid points first fall through ``level``, by linear interpolation."""
    w = Window.partitionBy("axis").orderBy("x")
    p = cuts.where("valid").withColumn("x1", F.lead("x").over(w)).withColumn("y1", F.lead("corr").over(w))
    y0, y1 = F.col("corr"), F.col("y1")
    hit = p.where(y1.isNotNull() & ((y0 == level) | ((y0 - level) * (y1 - level) <= 0) & (y0 != y1)))
    at = F.when(y0 == level, F.col("x")).otherwise(F.col("x") + (F.lit(level) - y0) / (y1 - y0) * (F.col("x1") - F.col("x")))
    return hit.withColumn("scale", at).groupBy("axis").agg(F.min_by("scale", "x").alias("scale"))
