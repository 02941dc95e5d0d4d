"""Reconstruction from scattered samples, and its scores.

Nearest samples come from a k-d tree of sampled medians (``kdtree``), radial basis functions from its patches (``radial``),
whatever the number of samples. Piecewise-linear interpolation finds the simplex around each point by itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import finite
from ..functions.order import running_total
from ..functions.tables import stage as written
from .kdtree import _columns, _mapped, nearest_samples
from .radial import POINTS, Patches, leaf_tree, numbered, radial_basis

#: Samples that a scan takes or skips at once, and of a patch at most.
BLOCK, CROWDED = 256, 8192


def nearest(points: DataFrame, samples: DataFrame, key: str, position: Sequence[str] = ("x", "y", "z"), value: Sequence[str] = ("v",)) -> DataFrame:
    """The value of the nearest sample, ties to the smallest sample_id."""
    return nearest_samples(points, samples, key, 1, position, value).drop("rank")


def nearest_vectors(vectors: DataFrame, every: int = 50, chunk: int = 1024) -> DataFrame:
    """query_id, vec_id, d2 (rounded to 6 digits): the nearest other vector of each whose id is divisible by ``every``, ties to the smaller id.

    Queries go out in chunks of at most ``chunk`` vectors; candidates are read where they lie, each task sends one row a query.
    """
    spark = vectors.sparkSession
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("e")).where(F.col("vec_id").isNotNull() & F.col("e").isNotNull() & ~F.exists("e", lambda x: x.isNull()))
    asks = v.where(F.col("vec_id") % every == 0)
    parts = max(1, -(-asks.count() // chunk))
    found = []
    for part in range(parts):
        table = asks.where(F.pmod(F.crc32(F.col("vec_id").cast("string")), F.lit(parts)) == part).toArrow().combine_chunks()
        for at in range(0, table.num_rows, chunk):
            piece = table.slice(at, chunk)
            sent = spark.sparkContext.broadcast((piece["vec_id"].to_numpy(), np.array(piece["e"].to_pylist())))

            def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
                ids, q = sent.value
                best, of = np.full(len(ids), np.inf), np.full(len(ids), -1)
                for b in batches:
                    for k in range(0, len(b), 1024):
                        x, vec = np.array(b.column("e").slice(k, 1024).to_pylist()), b.column("vec_id").slice(k, 1024).to_numpy()
                        d = (q * q).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * (q @ x.T)
                        d[ids[:, None] == vec[None]] = np.inf
                        # sums by parts are off in their last digits: what may be the nearest is measured exactly
                        i, j = np.nonzero(d <= np.minimum(d.min(1), best)[:, None] + 1e-5)
                        exact = np.round(((q[i] - x[j]) ** 2).sum(1), 6)
                        order = np.lexsort((vec[j], exact, i))
                        i, j, exact = i[order], j[order], exact[order]
                        once = np.concatenate([[True], i[1:] != i[:-1]]) if len(i) else np.zeros(0, bool)
                        i, j, exact = i[once], j[once], exact[once]
                        less = (exact < best[i]) | (exact == best[i]) & (vec[j] < of[i])
                        best[i[less]], of[i[less]] = exact[less], vec[j[less]]
                use = of >= 0
                yield pa.RecordBatch.from_arrays([pa.array(ids[use]), pa.array(of[use]), pa.array(best[use])], ["query_id", "vec_id", "d2"])

            found.append(v.mapInArrow(run, "query_id long, vec_id long, d2 double"))
    if not found:
        return v.limit(0).select(F.col("vec_id").alias("query_id"), "vec_id", F.lit(0.0).alias("d2"))
    rows = reduce(lambda a, b: a.unionByName(b), found)
    return rows.groupBy("query_id").agg(F.min(F.struct("d2", "vec_id")).alias("m")).select("query_id", "m.vec_id", "m.d2")


class _Search:
    """The simplex of a Delaunay triangulation that holds a point, as the basis of a linear programme.

    Of all convex combinations of samples that give the point, the one of least summed height, where a sample's height is its
    squared norm, has the Delaunay simplex around the point as its support. Heights carry a tiny term from the sample's id:
    samples on one sphere then have one triangulation. Far corners that no sample reaches stand in at first; what still needs
    them at the end lies outside the hull. Coordinates are scaled by one factor to the samples' range.
    """

    TIE, TOL = 1e-9, 1e-12
    #: Pivots after which the entering sample is the first that improves (Bland's rule), and after which rounding is to blame.
    PATIENCE, MOST = 200, 20_000

    def __init__(self, axes: int):
        self.axes = axes
        self.corners = np.vstack([-np.ones(axes), np.eye(axes) * (2.0 * axes + 2) - 1]) * 4 + 0.5

    @staticmethod
    def ties(ids: np.ndarray) -> np.ndarray:
        """In [0, 1), from the ids alone."""
        with np.errstate(over="ignore"):
            mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (mixed >> np.uint64(11)) / 2.0**53

    def heights(self, ties: np.ndarray, x: np.ndarray) -> np.ndarray:
        return (x * x).sum(-1) + self.TIE * ties

    def solve(self, p: np.ndarray, ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``solve_all`` for one point."""
        members, weight, price = self.solve_all(p[None], self.ties(ids)[None], x[None])
        return members[0], weight[0], price[0]

    def solve_all(self, p: np.ndarray, ties: np.ndarray, x: np.ndarray, held: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Members of each point's basis (samples by place, corners by -1 - place), their weights, and both rows of prices.

        ``ties`` and ``x`` hold one set of samples for all points, or one for each, of which ``held`` tells the used places.
        """
        sets, n, d = x.shape
        corners = np.broadcast_to(np.column_stack([self.corners, np.ones(d + 1)]), (sets, d + 1, d + 1))
        a = np.concatenate([np.concatenate([x, np.ones((sets, n, 1))], 2), corners], 1)
        cost = np.zeros((sets, 2, n + d + 1))
        cost[:, 0, n:], cost[:, 1, :n] = 1.0, self.heights(ties, x)
        if held is not None:
            cost[:, 0, :n][~held] = np.inf
        basis = np.tile(np.arange(n, n + d + 1), (len(p), 1))
        weights, prices = np.zeros((len(p), d + 1)), np.zeros((len(p), 2, d + 1))
        goal, live = np.column_stack([p, np.ones(len(p))]), np.arange(len(p))
        for pivot in range(self.MOST):
            own, now = live if sets > 1 else np.zeros_like(live), basis[live]
            inverse = np.linalg.inv(a[own[:, None], now].transpose(0, 2, 1))
            weight = (inverse @ goal[live, :, None])[:, :, 0]
            price = cost[own[:, None], :, now].transpose(0, 2, 1) @ inverse
            if sets > 1:
                reduced = cost[live] - price @ a[live].transpose(0, 2, 1)
            else:
                reduced = cost - (price.reshape(-1, d + 1) @ a[0].T).reshape(len(live), 2, -1)
            # a corner at weight 0 costs nothing: what it would price counts in the second row alone
            first, second = reduced[:, 0], reduced[:, 1]
            np.put_along_axis(first, now, 0.0, 1), np.put_along_axis(second, now, 0.0, 1)
            first[:, n:] = np.inf
            phase = (first < -1e-11).any(1)
            beyond = ~phase & ((now >= n) & (weight > 1e-9)).any(1)
            price[beyond, 1] = np.r_[np.zeros(d), -np.inf]  # beyond the hull: no height can matter
            order = np.where(phase[:, None], first, np.where(np.abs(first) <= 1e-11, second, 0.0))
            worse = order < np.where(phase, -1e-11, -self.TOL)[:, None]
            enter = worse.argmax(1) if pivot > self.PATIENCE else np.where(worse, order, 0.0).argmin(1)
            step = (inverse @ a[own, enter][:, :, None])[:, :, 0]
            with np.errstate(divide="ignore", invalid="ignore"):
                ratio = np.where(step > 1e-11, np.maximum(weight, 0.0) / step, np.inf)
            leave = ratio.argmin(1)
            weights[live], prices[live] = weight, price
            go = ~beyond & worse.any(1) & np.isfinite(ratio.min(1))
            basis[live[go], leave[go]] = enter[go]
            live = live[go]
            if not len(live):
                break
        else:
            raise ArithmeticError(f"no simplex within {self.MOST} pivots: the samples' positions differ too little for their range")
        return np.where(basis < n, basis, n - 1 - basis), weights, prices


def linear(points: DataFrame, samples: DataFrame, key: str, position: Sequence[str] = ("x", "y", "z"), value: Sequence[str] = ("v",), near: int = 256, chunk: int = 8192, add: int = 8) -> DataFrame:
    """Piecewise-linear interpolation over the Delaunay triangulation of the samples; NaN outside their hull.

    Of points at one position one is searched, of samples at one position the one of least height. A point's simplex is sought
    among the samples of its patch, a leaf of about ``near`` samples of a k-d tree with its margin. It is the right one if its
    sphere lies within the patch. The other points, near the hull or beyond it, go out in chunks with the prices of their
    simplex; each task answers with the sample that most violates them, and they search again with the first ``add`` of these
    among all that they have met, until there is none that they haven't met.
    """
    spark, d = points.sparkSession, len(position)
    good = reduce(lambda a, b: a & b, [finite(F.col(p)) for p in position])
    stats = samples.where(good).agg(F.count(F.lit(1)), *[f(F.col(c).cast("double")) for c in position for f in (F.min, F.max)]).first()
    inside = good & reduce(lambda a, b: a & b, [F.col(p).cast("double").between(lo, h) for p, lo, h in zip(position, stats[1::2], stats[2::2], strict=True)]) if stats[0] else F.lit(False)
    none = points.where(~inside).select(F.col(key).cast("long").alias(key), *[F.lit(float("nan")).alias(v) for v in value])
    if not stats[0]:
        return none
    names, own = [f"at_{p}" for p in position], [f"q_{p}" for p in position]
    low, scale = stats[1::2], max([h - lo for lo, h in zip(stats[1::2], stats[2::2], strict=True)] + [0.0]) or 1.0
    scaled = lambda new: [((F.col(p).cast("double") - F.lit(lo)) / F.lit(scale)).alias(n) for p, n, lo in zip(position, new, low, strict=True)]
    row = [*names, "tie", *value]
    s = samples.where(good).select("sample_id", *scaled(names), *[F.coalesce(F.col(v).cast("double"), F.lit(float("nan"))).alias(v) for v in value])
    tied = lambda b: pa.RecordBatch.from_arrays([*b.columns, pa.array(_Search.ties(b.column("sample_id").to_numpy()))], [*b.schema.names, "tie"])
    s = _mapped(s.withColumn("sample_id", F.col("sample_id").cast("long")), tied, f"sample_id long, {', '.join(f'{c} double' for c in (*names, *value))}, tie double")
    s = s.groupBy(*names).agg(F.min(F.struct("tie", "sample_id", *value)).alias("m")).select(*names, "m.tie", *[f"m.{v}" for v in value])
    s = written(s, "linear-samples")
    n = s.count()
    # neighbours lie in one file, so that a scan can skip blocks of them
    cells = [F.floor(F.col(c) * math.ceil((n / BLOCK) ** (1 / d))).alias(c) for c in names]
    s = written(s.repartitionByRange(-(-n // 8192), *cells).sortWithinPartitions(*cells, *names), "linear-samples")
    every = points.where(inside).select(F.col(key).cast("long").alias(key), *scaled(own))
    q = every.groupBy(*own).agg(F.min(key).alias(key))
    schema = f"{key} long, {', '.join(f'{o} double' for o in own)}, found array<array<double>>, prices array<double>, done boolean, {', '.join(f'{v} double' for v in value)}"
    out_names = [c.split()[0] for c in schema.split(", ")]

    def state(keys: pa.Array, p: np.ndarray, found: pa.Array, prices: np.ndarray, done: np.ndarray, members: np.ndarray, weight: np.ndarray, v: np.ndarray) -> list[pa.Array]:
        """``v``: the values of each point's members."""
        outside = ((members < 0) & (weight > 1e-9)).any(1)
        at = np.where(((members >= 0) & (weight > 0))[:, :, None], weight[:, :, None] * v, 0.0).sum(1)
        at[outside] = np.nan
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * 2 * (d + 1), pa.int32()), pa.array(prices.ravel()))
        return [keys, *[pa.array(p[:, k]) for k in range(d)], found, flat, pa.array(done), *[pa.array(at[:, k]) for k in range(len(value))]]

    def lists(rows: np.ndarray, counts: np.ndarray) -> pa.Array:
        each = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * len(row), pa.int32()), pa.array(rows.ravel()))
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), each)

    tree = leaf_tree(s, n, names, near)
    sent = spark.sparkContext.broadcast(tree)
    patches = spark.sparkContext.broadcast(Patches(tree, d))
    left = written(_mapped(q, lambda b: pa.RecordBatch.from_arrays([*b.columns, pa.array(sent.value.leaves(_columns(b, own)))], [*b.schema.names, "leaf"]), f"{', '.join(f'{o} double' for o in own)}, {key} long, leaf long"), "linear-points")
    many = written(left.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / POINTS).alias("parts")), "linear-parts")
    left = left.join(F.broadcast(many), "leaf").withColumn("part", F.pmod(F.xxhash64(key), F.col("parts"))).drop("parts")  # a row for each leaf

    def dealt(b: pa.RecordBatch) -> pa.RecordBatch:
        at, leaf, _ = patches.value.reached(_columns(b, names))
        return pa.RecordBatch.from_arrays([*b.take(pa.array(at)).columns, pa.array(leaf)], [*b.schema.names, "leaf"])

    right = _mapped(s, dealt, f"{', '.join(f'{c} double' for c in row)}, leaf long")
    right = right.join(F.broadcast(many.select("leaf", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))), "leaf")

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        p, search, parts = _columns(a, own), _Search(d), []
        x = _columns(b.sort_by([(c, "ascending") for c in names]), row)
        if len(p):
            leaf = a["leaf"][0].as_py()
            lo, hi = patches.value.low[sent.value.inner + leaf], patches.value.high[sent.value.inner + leaf]
            if len(x) > CROWDED:  # a dense neighbour: the leaf's own samples
                lo, hi = lo + patches.value.margin[leaf], hi - patches.value.margin[leaf]
                x = x[((x[:, :d] >= lo) & (x[:, :d] <= hi)).all(1)]
        for k in range(0, len(p), size := max(1, 2**18 // (len(x) + d + 1))):
            few = p[k : k + size]
            members, weight, price = search.solve_all(few, x[None, :, d], x[None, :, :d])
            with np.errstate(invalid="ignore"):
                centre = price[:, 1, :d] / 2
                reach = np.sqrt(np.maximum((centre * centre).sum(1) + price[:, 1, d], 0.0))[:, None] + 1e-6
                done = (members >= 0).all(1) & ((centre - reach > lo) & (centre + reach < hi)).all(1) | np.isinf(np.r_[lo, hi]).all()
            real = members >= 0
            of = x[np.where(real, members, 0)] if len(x) else np.zeros((*members.shape, len(row)))
            parts.append(pa.RecordBatch.from_arrays(state(a[key].combine_chunks().slice(k, len(few)), few, lists(of[real], real.sum(1)), price, done, members, weight, of[:, :, d + 1 :]), out_names))
        kinds = [pa.int64(), *[pa.float64()] * d, pa.list_(pa.list_(pa.float64())), pa.list_(pa.float64()), pa.bool_(), *[pa.float64()] * len(value)]
        return pa.Table.from_batches(parts) if parts else pa.table([pa.array([], k) for k in kinds], out_names)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each point among the samples that it has met."""
        search = _Search(d)
        for whole in batches:
            for at in range(0, len(whole), 512):
                b = whole.slice(at, 512)
                p, counts = _columns(b, own), b.column("found").value_lengths().to_numpy()
                held = np.arange(counts.max()) < counts[:, None]
                x = np.zeros((*held.shape, len(row)))
                x[held] = b.column("found").flatten().flatten().to_numpy().reshape(-1, len(row))
                x, held = (x, held) if len(p) > 1 else (x.repeat(2, 0), held.repeat(2, 0))  # one set would be for all points
                members, weight, price = (o[: len(p)] for o in search.solve_all(p if len(p) > 1 else p.repeat(2, 0), x[:, :, d], x[:, :, :d], held))
                of = np.take_along_axis(x[: len(p)], np.maximum(members, 0)[:, :, None], 1)
                yield pa.RecordBatch.from_arrays(state(b.column(key), p, b.column("found"), price, np.zeros(len(p), bool), members, weight, of[:, :, d + 1 :]), out_names)

    first = written(left.groupBy("leaf", "part").cogroup(right.groupBy("leaf", "part")).applyInArrow(meet, schema), "linear-state")
    ready, left = [first.where("done")], written(first.where("NOT done"), "linear-left")
    while count := left.count():
        parts, answers = -(-count // chunk), []
        for part in range(parts):
            table = left.where(F.pmod(F.xxhash64(key), F.lit(parts)) == part).select(key, "prices").toArrow().combine_chunks()
            for begin in range(0, table.num_rows, chunk):
                piece = table.slice(begin, chunk)
                prices = spark.sparkContext.broadcast((piece[key].to_numpy(), np.array(piece["prices"].to_pylist()).reshape(-1, 2, d + 1)))
                answers.append(s.mapInArrow(_most_violating(prices, d, key, row), f"{key} long, excess double, {', '.join(f'{c} double' for c in row)}"))
        new = reduce(lambda a, b: a.unionByName(b), answers)
        more = new.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("excess", F.array(*row).alias("row")))).alias("more"))
        unmet = F.filter("more", lambda m: ~F.array_contains("found", m["row"]))
        step = left.join(more, key, "left").withColumn("more", F.transform(F.slice(unmet, 1, add), lambda m: m["row"]))
        step = written(step, "linear-step")
        ready.append(step.where("more IS NULL OR size(more) = 0").drop("more"))
        grown = step.where("size(more) > 0").withColumn("found", F.concat("found", "more")).drop("more")
        left = written(grown.mapInArrow(again, schema), "linear-left")
    found = reduce(lambda a, b: a.unionByName(b), ready).select(*own, *value)
    return every.join(found, own).select(key, *value).unionByName(none)


def _most_violating(sent, d: int, key: str, fields: Sequence[str]):
    """For each point of the chunk the sample of this task that most violates the prices, if one does; ``fields``: position, tie, values.

    A block of samples is measured by the points whose prices a place in its box can violate.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, price = sent.value
        search = _Search(d)
        best, row = np.zeros(len(keys)), np.full((len(keys), len(fields)), np.nan)
        one, two = price[:, 0], price[:, 1]
        for whole in batches:
            all_rows = _columns(whole, fields)
            for at in range(0, len(whole), BLOCK):
                block = all_rows[at : at + BLOCK]
                x, low, high = block[:, :d], block[:, :d].min(0), block[:, :d].max(0)
                least = -np.maximum(one[:, :d] * low, one[:, :d] * high).sum(1) - one[:, d]
                spot = np.clip(two[:, :d] / 2, low, high)
                sphere = (spot * (spot - two[:, :d])).sum(1) - two[:, d] < 1e-9
                may = np.flatnonzero((least < -5e-12) | (least < 2e-11) & sphere)
                a = np.column_stack([x, np.ones(len(x))])
                for k in range(0, len(may), 1024):
                    use = may[k : k + 1024]
                    first = -one[use] @ a.T
                    second = search.heights(block[:, d], x)[None] - two[use] @ a.T
                    order = np.where(first < -1e-11, first - 1e6, np.where((first <= 1e-11) & (second < -search.TOL), second, 0.0))
                    pick = order.argmin(1)
                    found = order[np.arange(len(use)), pick]
                    less = found < best[use]
                    best[use[less]], row[use[less]] = found[less], block[pick[less]]
        use = best < 0
        yield pa.RecordBatch.from_arrays([pa.array(keys[use]), pa.array(best[use]), *[pa.array(row[use, k]) for k in range(len(fields))]], [key, "excess", *fields])

    return run


METHODS = {"nearest": nearest, "linear": linear, "rbf": radial_basis}


def build_method(name: str):
    if name not in METHODS:
        raise ValueError(f"method must be one of {sorted(METHODS)}")
    return METHODS[name]


def metrics(rows: DataFrame, truth: Sequence[str], predicted: Sequence[str], *by: str) -> DataFrame:
    """rmse over all components of valid rows, relative L2, and how many rows are valid; for each group ``by`` if given."""
    good = F.lit(True)
    for p in predicted:
        good = good & finite(F.col(p))
    diff = sum(((F.col(t) - F.col(p)) * (F.col(t) - F.col(p)) for t, p in zip(truth, predicted, strict=True)), F.lit(0.0))
    size = sum((F.col(t) * F.col(t) for t in truth), F.lit(0.0))
    m = rows.groupBy(*by).agg(F.sum(F.when(good, diff)).alias("e"), F.sum(F.when(good, size)).alias("s"), F.count_if(good).alias("valid_count"), F.count_if(~good).alias("invalid_count"))
    return m.select(
        *by, F.sqrt(F.col("e") / (F.col("valid_count") * len(truth))).alias("rmse"),
        F.when(F.col("s") > 0, F.sqrt("e") / F.sqrt("s")).alias("relative_l2"),
        (F.col("valid_count") / (F.col("valid_count") + F.col("invalid_count"))).alias("valid_fraction"), "valid_count", "invalid_count",
    )


def sampling_order(cells: DataFrame, key: str, seed: int) -> DataFrame:
    """Adds ``rank`` (from 0): the samples of an experiment with n samples are the first n of this one order by hash."""
    h = F.md5(F.concat(F.lit(f"{seed},"), F.col(key).cast("string")).cast("binary"))
    return running_total(cells.withColumn("draw", h).withColumn("one", F.lit(1)), "one", "draw", key).withColumn("rank", F.col("upto") - 1).drop("draw", "one", "upto", "total")


def noise(key: str, seed: int, part: int) -> Column:
    """A normal deviate that is a function of key, seed and part alone."""
    h = F.md5(F.concat(F.lit(f"{seed},{part},"), F.col(key).cast("string")).cast("binary"))
    u = [(F.conv(F.substring(h, at, 12), 16, 10).cast("double") + 0.5) / F.lit(float(16**12)) for at in (1, 13)]
    return F.sqrt(-2 * F.log(u[0])) * F.cos(2 * math.pi * u[1])


def sampling_levels(cells: DataFrame, counts: Sequence[int], sigma: float, key: str = "id", value: Sequence[str] = ("v1", "v2", "v3"), seed: int = 1) -> DataFrame:
    """(samples, id, v.., p..): the cells rebuilt by nearest neighbour from the first n noisy samples, for every n of ``counts``.

    Each sample is searched once, among those that a count adds to the one before; the nearest of the first n is then the least
    of the levels up to n.
    """
    counts = sorted(set(counts))
    if not counts or counts[0] < 1:
        raise ValueError("counts must be positive")
    ranked = written(sampling_order(cells, key, seed).where(F.col("rank") < counts[-1]), "sampling-order")
    noisy = [(F.col(v) + F.lit(sigma) * noise(key, seed, k)).alias(v) for k, v in enumerate(value)]
    found = []
    for level, (low, high) in enumerate(zip([0, *counts], counts, strict=False)):
        some = ranked.where((F.col("rank") >= low) & (F.col("rank") < high)).select(F.col(key).alias("sample_id"), "x", "y", "z", *noisy)
        found.append(nearest_samples(cells, some, key, 1, value=value).withColumn("level", F.lit(level)))
    rows = written(reduce(lambda a, b: a.unionByName(b), found), "sampling-found")
    upto = Window.partitionBy(key).orderBy("level")  # a row for each count
    best = F.min(F.struct("d2", "sample_id", *value)).over(upto)
    rows = rows.select(key, F.get(F.array(*map(F.lit, counts)), F.col("level")).alias("samples"), best.alias("b"))
    return rows.select("samples", key, *[F.col(f"b.{v}").alias(f"p{v[1:]}") for v in value]).join(cells.select(key, *value), key)


def level_scores(rows: DataFrame, value: Sequence[str] = ("v1", "v2", "v3")) -> DataFrame:
    """rmse, relative L2 and valid rows of each number of samples."""
    return metrics(rows, value, [f"p{v[1:]}" for v in value], "samples")
