"""Nearest samples over a k-d tree of sampled medians.

The tree is built from a bounded share of the samples and cuts space into leaves that hold about equally many, however the
samples cluster. Samples carry their leaf; a leaf is known by the bounding box and the number of its samples, a node by
those of its leaves. A point first searches the leaf it falls in. That gives a bound of its k-th distance, and it goes down
the tree once more, to every other leaf whose box is no farther than the bound. Points and the samples of a leaf meet in cells
of bounded size: crowded leaves are cut, and their samples or points copied.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import finite
from ..functions.tables import stage

LEAF, DEEPEST, SAMPLED = 256, 16, 32  # samples of a leaf, levels at most, sampled positions for each leaf
POINTS, SAMPLES = 8192, 16384  # of a cell at most
SLACK = 1 + 1e-9  # distances to boxes and to samples round in different ways


class Tree:
    """Splits of a complete binary tree (node i has the children 2 i + 1 and 2 i + 2) and, once filled, the boxes of its nodes."""

    def __init__(self, positions: np.ndarray, depth: int):
        self.depth, self.inner = depth, 2**depth - 1
        self.axis, self.at = np.zeros(self.inner, np.int64), np.full(self.inner, np.inf)
        parts = [positions]
        for node in range(self.inner):  # by levels, so a node's part is there before its children's
            part = parts[node]
            parts[node] = None
            if len(part) > 1:
                axis = int(np.ptp(part, axis=0).argmax())
                self.axis[node], self.at[node] = axis, np.median(part[:, axis])
                above = part[part[:, axis] > part[:, axis].min(), axis]
                if self.at[node] == part[:, axis].min() and len(above):  # most share the least: neither side may be empty
                    self.at[node] = above.min()
            left = part[:, self.axis[node]] < self.at[node]
            parts += [part[left], part[~left]]

    def leaves(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[np.arange(len(x)), self.axis[node]] >= self.at[node])
        return node - self.inner

    def fill(self, leaf: np.ndarray, count: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """Boxes and counts of the leaves that hold samples, and of all nodes above them."""
        nodes, axes = 2 * self.inner + 1, low.shape[1]
        self.count, self.low, self.high = np.zeros(nodes, np.int64), np.full((nodes, axes), np.inf), np.full((nodes, axes), -np.inf)
        self.count[self.inner + leaf], self.low[self.inner + leaf], self.high[self.inner + leaf] = count, low, high
        for node in range(self.inner - 1, -1, -1):
            two = slice(2 * node + 1, 2 * node + 3)
            self.count[node], self.low[node], self.high[node] = self.count[two].sum(), self.low[two].min(0), self.high[two].max(0)

    def nearest(self, x: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Squared distance of points to the boxes of their nodes; infinite for an empty node."""
        gap = np.maximum(np.maximum(self.low[node] - x, x - self.high[node]), 0.0)
        return np.where(self.count[node] > 0, (gap * gap).sum(1), np.inf)

    def bound(self, x: np.ndarray, leaf: np.ndarray, k: int) -> np.ndarray:
        """No more than this is the k-th squared distance: the far corner of the first box above the leaf that holds k samples."""
        node = leaf + self.inner
        while (low := (self.count[node] < k) & (node > 0)).any():
            node = np.where(low, (node - 1) // 2, node)
        far = np.maximum(np.abs(x - self.low[node]), np.abs(x - self.high[node]))
        return np.where(self.count[node] >= k, (far * far).sum(1) * SLACK, np.inf)

    def within(self, x: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(point, leaf) for every leaf whose box isn't farther than the point's bound."""
        point = np.arange(len(x))
        node = np.zeros(len(x), np.int64)
        for level in range(self.depth + 1):
            if level:
                point, node = np.repeat(point, 2), np.stack([2 * node + 1, 2 * node + 2], 1).ravel()
            near = self.nearest(x[point], node) <= bound[point] * SLACK
            point, node = point[near], node[near]
        return point, node - self.inner


def _columns(b: pa.RecordBatch | pa.Table, names: Sequence[str]) -> np.ndarray:
    return np.column_stack([b.column(n).to_numpy() for n in names]).astype(np.float64).reshape(b.num_rows, len(names))


def _mapped(rows: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 4096):
                yield work(b.slice(at, 4096))

    return rows.mapInArrow(run, schema)


def _schema(df: DataFrame, *names: str) -> str:
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


def closest(d2: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k least of each row, in order, ties to the lower column."""
    if k == 1:
        return np.arange(len(d2)), d2.argmin(1)
    k = min(k, d2.shape[1])
    most = np.partition(d2, k - 1, 1)[:, k - 1]
    row, column = np.nonzero(d2 <= most[:, None])
    order = np.lexsort((column, d2[row, column], row))
    row, column = row[order], column[order]
    first = np.searchsorted(row, np.arange(len(d2)))
    keep = np.arange(len(row)) - first[row] < k
    return row[keep], column[keep]


def _search(visits: DataFrame, samples: DataFrame, tree: Tree, key: str, k: int, position: Sequence[str], names: Sequence[str], value: Sequence[str]) -> DataFrame:
    """(key, d2, sample_id, values): of each visit (key, position, leaf) the k nearest samples of the leaf, or of each part of a crowded one."""
    spark = visits.sparkSession
    held = {r.leaf: r.n for r in visits.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each leaf
    points = np.zeros(tree.inner + 1, np.int64)
    points[list(held)] = [-(-n // POINTS) for n in held.values()]
    parts = -(-tree.count[tree.inner :] // SAMPLES)
    sent = spark.sparkContext.broadcast((points, parts))

    def dealt(own: int, other: int, mark: Sequence[str]):
        """A row's part of its leaf is its hash's; it is copied to all parts of the other side."""

        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            leaf, deal = b.column("leaf").to_numpy(), b.column("__deal").to_numpy()
            mine, copies = np.maximum(sent.value[own][leaf], 1), sent.value[other][leaf]
            row = np.repeat(np.arange(len(b)), copies)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(copies) - copies, copies)
            part = (deal % mine)[row]
            cell = leaf[row] << 40 | (part if own == 0 else nth) << 20 | (nth if own == 0 else part)
            taken = b.take(pa.array(row))
            return pa.RecordBatch.from_arrays([pa.array(cell), *[taken.column(m) for m in mark]], ["cell", *mark])

        return work

    left = visits.select(key, *position, "leaf", F.pmod(F.xxhash64(key, *position), F.lit(1 << 20)).alias("__deal"))
    left = _mapped(left, dealt(0, 1, [key, *position]), f"cell long, {_schema(visits, key, *position)}")
    right = samples.where(F.col("leaf").isin(sorted(held))) if len(held) <= 64 else samples
    right = right.select("sample_id", *names, *value, "leaf", F.pmod(F.xxhash64("sample_id", *names), F.lit(1 << 20)).alias("__deal"))
    right = _mapped(right, dealt(1, 0, ["sample_id", *names, *value]), f"cell long, {_schema(samples, 'sample_id', *names, *value)}")

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        b = b.sort_by("sample_id")
        q, s = _columns(a, position), _columns(b, names)
        rows, columns, found = [], [], []
        for at in range(0, len(q) if len(s) else 0, 256):
            d2 = np.zeros((len(q[at : at + 256]), len(s)))
            for axis in range(q.shape[1]):
                gap = q[at : at + 256, axis, None] - s[None, :, axis]
                d2 += gap * gap
            i, j = closest(d2, k)
            rows.append(i + at), columns.append(j), found.append(d2[i, j])
        whole = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        i, j = pa.array(whole(rows, np.int64)), pa.array(whole(columns, np.int64))
        near = b.take(j)
        return pa.table([a.column(key).take(i), pa.array(whole(found, np.float64)), *[near.column(c) for c in ("sample_id", *value)]], [key, "d2", "sample_id", *value])

    schema = f"{_schema(visits, key)}, d2 double, {_schema(samples, 'sample_id', *value)}"
    return left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(meet, schema)


def _once(rows: DataFrame, crowded: list[int], names: Sequence[str], k: int) -> DataFrame:
    """In leaves that are crowded since many samples share a position, the k smallest ids of each: no other can be among the k nearest."""
    many = F.col("leaf").isin(crowded)
    w = Window.partitionBy(*names).orderBy("sample_id")
    few = rows.where(many).withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= k).drop("__rank")
    return rows.where(~many).unionByName(few)


def _boxes(rows: DataFrame, names: Sequence[str]) -> list:
    """A row for each leaf that holds samples: at most 2**DEEPEST."""
    return rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), *[F.min(n) for n in names], *[F.max(n) for n in names]).collect()


def nearest_samples(points: DataFrame, samples: DataFrame, key: str, k: int = 1, position: Sequence[str] = ("x", "y", "z"), value: Sequence[str] = ("v",), leaf: int = LEAF) -> DataFrame:
    """The k nearest samples of each point: key, rank, sample_id, d2 and the values; ties to the smallest sample_id.

    Points with a position that isn't finite have no nearest sample, samples with such a position aren't found. Where there
    are fewer than k samples, a point has as many rows as there are samples. ``key`` names each point once.
    """
    if k < 1:
        raise ValueError("k must be positive")
    good = lambda df: df.where(reduce(lambda a, b: a & b, [finite(F.col(p)) for p in position]))
    names = [f"s_{p}" for p in position]
    s = good(samples).select("sample_id", *[F.col(p).cast("double").alias(n) for p, n in zip(position, names, strict=True)], *value)
    p = good(points).select(key, *[F.col(c).cast("double").alias(c) for c in position])
    n = s.count()
    if not n:
        return p.limit(0).select(key, F.lit(1).alias("rank")).crossJoin(s.select("sample_id", F.lit(0.0).alias("d2"), *value).limit(0))
    depth = int(np.clip(np.ceil(np.log2(n / max(leaf, 8 * k))), 0, DEEPEST))
    wanted = SAMPLED << depth
    some = s.where(F.pmod(F.xxhash64("sample_id", *names), F.lit(max(1, n // wanted))) == 0) if depth else s.limit(0)
    tree = Tree(_columns(some.select(*names).limit(2 * wanted).toArrow(), names), depth)
    sent = s.sparkSession.sparkContext.broadcast(tree)

    def own(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(sent.value.leaves(_columns(b, names)))], [*b.schema.names, "leaf"])

    s = stage(_mapped(s, own, f"{_schema(s, *s.columns)}, leaf long"), "nearest-samples")
    boxes = _boxes(s, names)
    if crowded := [r.leaf for r in boxes if r.n > SAMPLES and r.n > 4 * n / 2**depth]:
        s = stage(_once(s, crowded, names, k), "nearest-samples")
        boxes = _boxes(s, names)
    at = np.array([r.leaf for r in boxes])
    d = len(names)
    tree.fill(at, np.array([r.n for r in boxes]), np.array([r[2 : 2 + d] for r in boxes], float), np.array([r[2 + d :] for r in boxes], float))
    full = s.sparkSession.sparkContext.broadcast(tree)

    def home(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(full.value.leaves(_columns(b, position)))], [*b.schema.names, "leaf"])

    shape = f"{_schema(p, *p.columns)}, leaf long"
    p = stage(_mapped(p, home, shape), "nearest-points")
    found = stage(_search(p, s, tree, key, k, position, names, value), "nearest-found")
    if depth:

        def further(b: pa.RecordBatch) -> pa.RecordBatch:
            """The other leaves that may hold one of the k nearest."""
            x, leaf = _columns(b, position), b.column("leaf").to_numpy()
            known = b.column("kth").to_numpy(zero_copy_only=False).astype(np.float64)
            bound = np.minimum(np.where(np.isnan(known), np.inf, known), full.value.bound(x, leaf, k))
            row, other = full.value.within(x, bound)
            row, other = row[other != leaf[row]], other[other != leaf[row]]
            taken = b.take(pa.array(row))
            return pa.RecordBatch.from_arrays([*[taken.column(c) for c in (key, *position)], pa.array(other)], [key, *position, "leaf"])

        least = F.min("d2") if k == 1 else F.try_element_at(F.array_sort(F.collect_list("d2")), F.lit(k))  # k for each part of the leaf
        kth = found.groupBy(key).agg(least.alias("kth"))
        visits = stage(_mapped(p.join(kth, key, "left"), further, shape), "nearest-visits")
        found = found.unionByName(stage(_search(visits, s, tree, key, k, position, names, value), "nearest-found"))
    if k == 1:  # the least by numbers alone stays in a hash aggregate
        best = found.groupBy(key).agg(F.min_by(F.struct("d2", "sample_id", *value), F.struct("d2", "sample_id")).alias("b"))
        return best.select(key, F.lit(1).alias("rank"), "b.sample_id", "b.d2", *[f"b.{v}" for v in value])
    rank = F.row_number().over(Window.partitionBy(key).orderBy("d2", "sample_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(key, "rank", "sample_id", "d2", *value)
