"""Radial basis interpolation of any number of samples.

Without ``neighbors`` the samples are split by a k-d tree into patches of about ``patch`` samples. Each patch is solved with
the samples of its own region and of a margin around it, in one Arrow group; a point's value is the mean of the patches whose
margin reaches it, weighted by ramps that fall to 0 at the margin's end. A patch holds every sample that its weight reaches,
so the blend goes through the samples, and is as smooth as the ramps across borders. Sets of up to ``patch`` samples are one
patch: the plain global interpolant. With ``neighbors`` each point has a small system of its own, solved in stacks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import finite
from ..functions.tables import stage
from .kdtree import DEEPEST, SAMPLED, Tree, _columns, _mapped, nearest_samples

#: A patch's margin on each side, as a share of its samples' extent on that axis.
MARGIN = 0.25
PATCH, POINTS = 512, 8192

KERNELS = {
    "thin_plate_spline": lambda r: np.where(r > 0, r * r * np.log(np.maximum(r, 1e-300)), 0.0),
    "linear": lambda r: -r,
    "cubic": lambda r: r**3,
    "gaussian": lambda r: np.exp(-(r**2)),
    "multiquadric": lambda r: -np.sqrt(r**2 + 1),
}


class Stack:
    """Interpolants of B sets of samples at once, x of shape (B, n, axes) and y of (B, n, values), with a linear tail."""

    def __init__(self, x: np.ndarray, y: np.ndarray, kernel: str = "thin_plate_spline", smoothing: float = 0.0, epsilon: float = 1.0):
        if kernel not in KERNELS:
            raise ValueError(f"kernel must be one of {sorted(KERNELS)}")
        self.x, self.kernel, self.epsilon = x, kernel, epsilon
        self.shift, self.scale = x.mean(1, keepdims=True), np.maximum(np.ptp(x, axis=1, keepdims=True), 1e-300)
        tail, n = self._tail(x), x.shape[1]
        a = np.zeros((len(x), n + tail.shape[2], n + tail.shape[2]))
        a[:, :n, :n] = self._kernel(x, x) + smoothing * np.eye(n)
        a[:, :n, n:], a[:, n:, :n] = tail, tail.transpose(0, 2, 1)
        each, axis = np.nonzero(np.ptp(x, axis=1) == 0)
        a[each, n + 1 + axis, n + 1 + axis] = 1.0  # an axis on which a set doesn't vary has weight 0
        goal = np.concatenate([y, np.zeros((len(x), tail.shape[2], y.shape[2]))], 1)
        try:
            self.weights = np.linalg.solve(a, goal)
        except np.linalg.LinAlgError:
            self.weights = np.full(goal.shape, np.nan)
        off = np.abs(a @ self.weights - goal).max((1, 2)) if len(x) else np.zeros(0)
        for i in np.flatnonzero(~(off <= 1e-9 * (1 + np.abs(goal).max((1, 2), initial=0)))):  # samples on a line or plane, or repeated
            self.weights[i] = np.linalg.lstsq(a[i], goal[i], rcond=None)[0]

    def _kernel(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return KERNELS[self.kernel](self.epsilon * np.sqrt(((a[:, :, None] - b[:, None]) ** 2).sum(-1)))

    def _tail(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.ones((*x.shape[:2], 1)), (x - self.shift) / self.scale], 2)

    def __call__(self, q: np.ndarray) -> np.ndarray:
        n = self.x.shape[1]
        return self._kernel(q, self.x) @ self.weights[:, :n] + self._tail(q) @ self.weights[:, n:]


def over_neighbours(points: DataFrame, samples: DataFrame, key: str, position: Sequence[str], value: Sequence[str], neighbors: int, **settings) -> DataFrame:
    """Each point by the interpolant of its nearest samples; equal-sized systems are solved together."""
    at = [f"at_{p}" for p in position]
    s = samples.select("sample_id", *position, *value, *[F.col(p).cast("double").alias(n) for p, n in zip(position, at, strict=True)])
    near = nearest_samples(points, s, key, neighbors, position, [*value, *at])
    flat = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("rank", *at, *value))), lambda r: F.array(*[r[c].cast("double") for c in (*at, *value)])))
    rows = points.select(F.col(key).cast("long").alias(key), *[F.col(p).cast("double").alias(p) for p in position]).join(near.groupBy(key).agg(flat.alias("near")), key)
    wide, d = len(at) + len(value), len(at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, len(whole), 1024):
                b = whole.slice(first, 1024)
                q, lists = _columns(b, position), b.column("near")
                size = lists.value_lengths().to_numpy() // wide
                out = np.full((len(b), len(value)), np.nan)
                for n in np.unique(size):
                    row = np.flatnonzero(size == n)
                    x = lists.take(pa.array(row)).flatten().to_numpy(zero_copy_only=False).reshape(len(row), n, wide)
                    out[row] = Stack(x[:, :, :d], x[:, :, d:], **settings)(q[row][:, None])[:, 0]
                yield pa.RecordBatch.from_arrays([b.column(key), *[pa.array(out[:, k]) for k in range(len(value))]], [key, *value])

    return rows.select(key, *position, "near").mapInArrow(run, ", ".join([f"{key} long", *[f"{v} double" for v in value]]))


class Patches:
    """Regions of the leaves of a tree, which cover all of space, with their margins."""

    def __init__(self, tree: Tree, axes: int):
        self.tree, leaves = tree, tree.inner + 1
        low, high = [np.full(axes, -np.inf)], [np.full(axes, np.inf)]
        for node in range(tree.inner):
            for side in (0, 1):
                lo, hi = low[node].copy(), high[node].copy()
                (lo if side else hi)[tree.axis[node]] = tree.at[node]
                low.append(lo), high.append(hi)
        extent = np.where(tree.count[-leaves:, None] > 0, tree.high[-leaves:] - tree.low[-leaves:], 0.0)
        self.margin = np.maximum(MARGIN * extent, 1e-9)
        self.low, self.high = np.array(low), np.array(high)
        self.low[-leaves:] -= self.margin
        self.high[-leaves:] += self.margin
        for node in range(tree.inner - 1, -1, -1):
            two = slice(2 * node + 1, 2 * node + 3)
            self.low[node], self.high[node] = self.low[two].min(0), self.high[two].max(0)

    def reached(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(point, leaf, weight) of the patches that reach each point."""
        point, node = np.arange(len(x)), np.zeros(len(x), np.int64)
        for level in range(self.tree.depth + 1):
            if level:
                point, node = np.repeat(point, 2), np.stack([2 * node + 1, 2 * node + 2], 1).ravel()
            inside = ((x[point] >= self.low[node]) & (x[point] <= self.high[node])).all(1)
            point, node = point[inside], node[inside]
        leaf = node - self.tree.inner
        wide = 2 * self.margin[leaf]
        smooth = lambda t: t * t * (3 - 2 * t)
        ramp = smooth(np.clip((x[point] - self.low[node]) / wide, 0, 1)) * smooth(np.clip((self.high[node] - x[point]) / wide, 0, 1))
        weight = ramp.prod(1)
        keep = (weight > 0) & (self.tree.count[node] > 0)
        return point[keep], leaf[keep], weight[keep]


def leaf_tree(s: DataFrame, n: int, names: Sequence[str], patch: int) -> Tree:
    """A filled tree of the n samples, with leaves of at most about ``patch``."""
    depth = int(np.clip(np.ceil(np.log2(n / patch)), 0, DEEPEST))
    wanted = SAMPLED << depth
    some = s.where(F.pmod(F.xxhash64(*names), F.lit(max(1, n // wanted))) == 0) if depth else s.limit(0)
    tree = Tree(_columns(some.select(*names).limit(2 * wanted).toArrow(), names), depth)
    sent, d = s.sparkSession.sparkContext.broadcast(tree), len(names)
    placed = _mapped(s.select(*names), lambda b: pa.RecordBatch.from_arrays([*b.columns, pa.array(sent.value.leaves(_columns(b, names)))], [*b.schema.names, "leaf"]), f"{', '.join(f'{c} double' for c in names)}, leaf long")
    boxes = placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), *[f(c) for f in (F.min, F.max) for c in names]).collect()  # a row for each leaf
    tree.fill(np.array([r.leaf for r in boxes]), np.array([r.n for r in boxes]), np.array([r[2 : 2 + d] for r in boxes], float), np.array([r[2 + d :] for r in boxes], float))
    return tree


def blended(points: DataFrame, samples: DataFrame, key: str, position: Sequence[str], value: Sequence[str], patch: int = PATCH, **settings) -> DataFrame:
    """Each point by the weighted patches that reach it; samples at one position count once, with their mean."""
    good = reduce(lambda a, b: a & b, [finite(F.col(p)) for p in position])
    names = [f"s_{p}" for p in position]
    whole = reduce(lambda a, b: a & b, [finite(F.col(v).cast("double")) for v in value])
    s = samples.where(good & whole).groupBy(*[F.col(p).cast("double").alias(n) for p, n in zip(position, names, strict=True)]).agg(*[F.avg(v).alias(v) for v in value])
    s = stage(s, "radial-samples")
    p = points.select(F.col(key).cast("long").alias(key), *[F.col(c).cast("double").alias(c) for c in position])
    out = ", ".join([f"{key} long", *[f"{v} double" for v in value]])
    n = s.count()
    lost = p.where(~good).select(key, *[F.lit(float("nan")).alias(v) for v in value])
    if not n:
        return p.select(key, *[F.lit(float("nan")).alias(v) for v in value])
    tree, spark, d = leaf_tree(s, n, names, patch), s.sparkSession, len(names)
    patches = spark.sparkContext.broadcast(Patches(tree, d))

    def dealt(at: Sequence[str]):
        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            row, leaf, weight = patches.value.reached(_columns(b, at))
            return pa.RecordBatch.from_arrays([*b.take(pa.array(row)).columns, pa.array(leaf), pa.array(weight)], [*b.schema.names, "leaf", "weight"])

        return work

    left = stage(_mapped(p.where(good), dealt(position), f"{key} long, {', '.join(f'{c} double' for c in position)}, leaf long, weight double"), "radial-points")
    # a patch with many points is solved once for each part of them
    many = left.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / POINTS).alias("parts"))
    many = stage(many, "radial-parts")
    left = left.join(F.broadcast(many), "leaf").withColumn("part", F.pmod(F.xxhash64(key), F.col("parts"))).drop("parts")  # a row for each leaf
    right = _mapped(s, dealt(names), f"{', '.join(f'{c} double' for c in (*names, *value))}, leaf long, weight double")
    copies = many.select(F.col("leaf").alias("leaf"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    right = right.join(F.broadcast(copies), "leaf")

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({c.split()[0]: pa.array([], pa.int64() if c.endswith("long") else pa.float64()) for c in f"{out}, weight double".split(", ")})
        b = b.sort_by([(n, "ascending") for n in names])  # the same sums whatever came first
        model = Stack(_columns(b, names)[None], _columns(b, value)[None], **settings)
        q, w = _columns(a, position), a["weight"].to_numpy()
        y = np.concatenate([model(q[None, k : k + 512])[0] for k in range(0, len(q), 512)])
        return pa.table({key: a[key], **{v: pa.array(y[:, k] * w) for k, v in enumerate(value)}, "weight": pa.array(w)})

    parts = left.groupBy("leaf", "part").cogroup(right.groupBy("leaf", "part")).applyInArrow(meet, f"{out}, weight double")
    return parts.groupBy(key).agg(*[(F.sum(v) / F.sum("weight")).alias(v) for v in value]).unionByName(lost)


def radial_basis(points: DataFrame, samples: DataFrame, key: str, position: Sequence[str] = ("x", "y", "z"), value: Sequence[str] = ("v",), neighbors: int | None = None, patch: int = PATCH, **settings) -> DataFrame:
    """Radial basis interpolation: blended patches of the samples, or over each point's ``neighbors`` nearest samples.

    Points whose position isn't finite have NaN without ``neighbors`` and no row with them; the same holds without any sample.
    Patches take samples at one position as one, with their mean: ``numbered`` tells them apart.
    """
    if neighbors:
        return over_neighbours(points, samples, key, position, value, neighbors, **settings)
    return blended(points, samples, key, position, value, patch, **settings)


def numbered(samples: DataFrame, axis: str, step: float, position: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """Adds an axis on which samples at one position lie ``step`` apart, the first of each, by sample_id, at 0.

    No function of position goes through several values at one place. Over the position and this axis the interpolant does.
    """
    w = Window.partitionBy(*position).orderBy("sample_id")
    return samples.withColumn(axis, (F.row_number().over(w) - 1) * F.lit(float(step)))
