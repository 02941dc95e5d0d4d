"""Exact top-k inner products by a three-phase uniform threshold.

A score is a sum of ``lists`` partial scores, each over a block of the dimensions. Queries go in chunks of at most
``chunk`` vectors, so what is broadcast has a fixed bound; the candidates are scanned where they lie.

1. Each task keeps, for every query and list, its k best entries by partial score; the k best of all tasks are gathered.
   Only these entries get their full scores; the k-th best of them is a lower bound of the true k-th score.
2. That bound divided by ``lists`` is the uniform cutoff that goes out: an entry below it in every list can't reach the
   bound. Each task collects the entries that are at or above the cutoff in some list.
3. Only these get their missing partial scores, list by list; an entry that can't reach the bound even with the cutoff in
   each list still missing goes. Each task sends its k best of what is left, with their exact scores.

Defined results: vectors that are null, or hold null or non-finite components, take no part, nor do rows without
vec_id. Rows are told apart by a number of their own, so rows that repeat a vec_id are candidates each, of each other
too, and each of them that asks has its own k results under the shared query_id. Shorter vectors are padded with zeros.
Ties go to the smaller vec_id. Scores are exact: doubles hold the sums below 2**53, beyond that Python integers do.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import stage

BLOCK = 1024


def quantised(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """(row, vec_id, q): a number for each row that takes part, and floor(scale * x) of its components; write it before use."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    fine = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    q = F.transform(x, lambda v: F.floor(v * F.lit(float(scale))))
    return vectors.where(fine).select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long"), q.alias("q"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (lengths == dim).all():
        return flat.reshape(len(lengths), dim)
    out = np.zeros((len(lengths), dim))
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if a.size and b.size and np.abs(a).max() * np.abs(b).max() * max(1, a.shape[1]) >= 2**53:
        return a.astype(object) @ b.astype(object).T
    return a @ b.T


def _best(query: np.ndarray, vec: np.ndarray, row: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k highest scores of each query, ties to the smaller vec."""
    order = np.lexsort((row, vec, -score, query))
    query, vec, row, score = query[order], vec[order], row[order], score[order]
    first = np.searchsorted(query, query, "left")
    keep = np.arange(len(query)) - first < k
    return query[keep], vec[keep], row[keep], score[keep]


def _none() -> tuple[np.ndarray, ...]:
    return (*(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0))


def _cuts(dim: int, lists: int) -> list[tuple[int, int]]:
    """The blocks of dimensions that the lists hold."""
    at = np.linspace(0, dim, min(lists, max(dim, 1)) + 1).astype(int).tolist()
    return list(zip(at[:-1], at[1:], strict=True))


def _blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for whole in batches:
        for at in range(0, len(whole), BLOCK):
            batch = whole.slice(at, BLOCK)
            yield batch.column("row").to_numpy(), batch.column("vec_id").to_numpy(zero_copy_only=False), _matrix(batch.column("q"), dim)


def _sent(columns: list[np.ndarray], names: list[str]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(columns[0]), 10_000):
        yield pa.RecordBatch.from_arrays([pa.array([int(v) for v in c[at : at + 10_000]], pa.int64()) for c in columns], names)


def local_lists(batches: Iterator[pa.RecordBatch], asking: np.ndarray, queries: np.ndarray, lists: int, k: int) -> Iterator[pa.RecordBatch]:
    """Phase 1: (list, query, vec_id, row, part), the k best of a task in each list by partial score alone."""
    cuts = _cuts(queries.shape[1], lists)
    held = [_none()] * len(cuts)
    for row, vec, x in _blocks(batches, queries.shape[1]):
        own = asking[:, None] == row[None, :]
        for n, (a, b) in enumerate(cuts):
            p = _product(queries[:, a:b], x[:, a:b])
            picked = ~own
            if p.shape[1] > k + 1:  # one more for the query itself
                picked = np.zeros(p.shape, bool)
                np.put_along_axis(picked, np.argpartition(-p, k + 1, axis=1)[:, : k + 1], True, axis=1)
                picked &= ~own
            q, c = np.nonzero(picked)
            held[n] = _best(*(np.concatenate([h, v]) for h, v in zip(held[n], (q, vec[c], row[c], p[q, c]), strict=True)), k)
    for n, (q, vec, row, part) in enumerate(held):
        yield from _sent([np.full(len(q), n), asking[q], vec, row, part], ["list", "query", "vec_id", "row", "part"])


def full_scores(batches: Iterator[pa.RecordBatch], asking: np.ndarray, queries: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(query, score) of gathered entries (query, q)."""
    order = np.argsort(asking)
    for batch in batches:
        query, x = batch.column("query").to_numpy(), _matrix(batch.column("q"), queries.shape[1])
        y = queries[order[np.searchsorted(asking[order], query)]]
        if y.size and np.abs(x).max() * np.abs(y).max() * x.shape[1] >= 2**53:
            x, y = x.astype(object), y.astype(object)
        yield from _sent([query, (x * y).sum(1)], ["query", "score"])


def sufficient_entries(batches: Iterator[pa.RecordBatch], asking: np.ndarray, queries: np.ndarray, lists: int, k: int, bound: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Phases 2 and 3: the k best entries of a task that reach ``bound``; rows without query tell how many pairs there
    were (vec_id 0), how many were collected at the cutoff (1) and how many were resolved to the end (2)."""
    dim = queries.shape[1]
    cuts = _cuts(dim, lists)
    cutoff = bound / len(cuts)
    held, tally = _none(), np.zeros(3, np.int64)
    for row, vec, x in _blocks(batches, dim):
        # what an entry has at or above the cutoff, list after list, and which lists these are
        above, seen = np.zeros((len(asking), len(vec))), np.zeros((len(asking), len(vec)), np.int64)
        for n, (a, b) in enumerate(cuts):
            p = _product(queries[:, a:b], x[:, a:b])
            hit = p >= cutoff[:, None]
            above = above + np.where(hit, p, 0)
            seen |= hit.astype(np.int64) << n
        apart = asking[:, None] != row[None, :]
        q, c = np.nonzero((seen > 0) & apart)
        tally[:2] += [apart.sum(), len(q)]
        # a list that is missing holds less than the cutoff: list by list, entries that can't reach the bound any more go
        score, known = above[q, c], seen[q, c]
        for n, (a, b) in enumerate(cuts):
            todo = np.flatnonzero(known >> n & 1 == 0)
            left, right = queries[q[todo], a:b], x[c[todo], a:b]
            if len(todo) and np.abs(left).max() * np.abs(right).max() * dim >= 2**53:
                left, right, score = left.astype(object), right.astype(object), score.astype(object)
            score[todo] += (left * right).sum(1)
            known = known | 1 << n
            missing = len(cuts) - np.bitwise_count(known).astype(np.int64)
            alive = score + np.where(missing > 0, missing * np.maximum(cutoff[q], -1e300), 0) >= bound[q]
            q, c, score, known = q[alive], c[alive], score[alive], known[alive]
        tally[2] += len(q)
        held = _best(*(np.concatenate([h, v]) for h, v in zip(held, (q, vec[c], row[c], score), strict=True)), k)
    query, vec, _, score = held
    yield from _sent([asking[query], vec, score], ["query", "vec_id", "score"])
    yield pa.RecordBatch.from_arrays([pa.nulls(3, pa.int64()), pa.array([0, 1, 2], pa.int64()), pa.array(tally)], ["query", "vec_id", "score"])


def _below(x: float) -> float:
    """The largest double that isn't above ``x``."""
    return float(x) if float(x) <= x else math.nextafter(float(x), -math.inf)


def _phases(vectors: DataFrame, k: int, every: int, scale: int, lists: int, chunk: int) -> tuple[DataFrame, list[DataFrame]]:
    """The quantised vectors, and for each chunk of queries its staged results and tallies."""
    spark = vectors.sparkSession
    rows = stage(quantised(vectors, scale), "topk-vectors")
    asks = rows.where(F.col("vec_id") % every == 0)
    count, dim = asks.count(), rows.agg(F.max(F.size("q"))).first()[0] or 0
    parts = max(1, math.ceil(count / chunk))
    results = []
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    name = asks.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"))
    for part in range(parts):
        mine = asks if parts == 1 else asks.where(F.pmod(F.xxhash64("row"), F.lit(parts)) == part)
        table = mine.toArrow().combine_chunks()
        # hashing may put somewhat more than ``chunk`` rows in a part: the slices keep the bound
        for at in range(0, table.num_rows, chunk):
            piece = table.slice(at, chunk).combine_chunks()
            asking = piece.column("row").to_numpy()
            sent = spark.sparkContext.broadcast((asking, _matrix(piece.column("q").chunk(0), dim)))

            def lists_of(batches, sent=sent):
                yield from local_lists(batches, *sent.value, lists, k)

            def scores_of(batches, sent=sent):
                yield from full_scores(batches, *sent.value)

            local = rows.mapInArrow(lists_of, "list long, query long, vec_id long, row long, part long")
            best = F.row_number().over(Window.partitionBy("query", "list").orderBy(F.desc("part"), "vec_id"))
            gathered = local.withColumn("rank", best).where(F.col("rank") <= k).select("query", "row").distinct()
            first = gathered.join(rows, "row").select("query", "q").mapInArrow(scores_of, "query long, score long")
            bounds = {r[0]: r[1] for r in first.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score")))).where(F.col("rank") == k).select("query", "score").collect()}
            bound = spark.sparkContext.broadcast(np.array([_below(bounds.get(int(i), -np.inf)) for i in asking]))

            def entries_of(batches, sent=sent, bound=bound):
                yield from sufficient_entries(batches, *sent.value, lists, k, bound.value)

            found = rows.mapInArrow(entries_of, "query long, vec_id long, score long")
            # one pass over the candidates for both: a written table
            found = stage(found, "topk-entries")
            ranked = found.where("query IS NOT NULL").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).join(name, "query")
            results.append((stage(ranked.select("query_id", "rank", "vec_id", "score"), "topk-found"), found.where("query IS NULL")))
    return rows, results


def exact_topk(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, lists: int = 4, chunk: int = 2048) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other vectors of each vector whose vec_id is divisible by ``every``."""
    rows, results = _phases(vectors, k, every, scale, lists, chunk)
    if not results:
        return rows.limit(0).select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score"))
    out = results[0][0]
    for more, _ in results[1:]:
        out = out.unionByName(more)
    return out


def work_done(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, lists: int = 4, chunk: int = 2048) -> dict[str, int]:
    """How many (query, candidate) pairs there were, how many were collected at the cutoff, and how many were resolved to the end."""
    total = [0, 0, 0]
    for _, tally in _phases(vectors, k, every, scale, lists, chunk)[1]:
        for r in tally.groupBy("vec_id").agg(F.sum("score")).collect():
            total[r[0]] += r[1]
    return dict(zip(("pairs", "collected", "resolved"), total, strict=True))
