"""Spelling variants: words of one edit apart, found by dynamic programming over sorted lists.

* Words and their counts come from DataFrame functions over whole texts, with map-side combine.
* The vocabulary is sorted twice, by the words and by the words read backwards, and cut into blocks of consecutive words.
  Of two words with one edit between them, either the first ``least // 2`` code points agree, and they are neighbours in
  the first list, or the last ``least - least // 2`` do, and they are so in the second; the first list has pairs of the
  first kind, the second the rest, so each pair is found once.
* Blocks meet where they share such a beginning; a pair of blocks whose shared prefixes are already more than one edit
  apart is skipped. What is sent to the driver is two cut-off words for each of at most ``BLOCKS`` blocks.
* In a pair of blocks, every word of one scans the sorted other: ranges of words that share a prefix share one row of the
  edit matrix, three cells wide. Rows are computed once for each range (the common prefixes of adjacent words tell where
  ranges split), and a range whose row has no cell of at most one edit is skipped. All words of the block go down together.

Defined results: null or empty text has no words; a null doc_id counts as empty in the hash. Repeated rows count each.
An empty table gives an empty result. Other columns take no part, whatever their names.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCKS, BLOCK, SHOWN = 4096, 8192, 32  # blocks at most, words of a block at least, code points of a block's ends that the driver sees


def vocabulary(docs: DataFrame, least: int = 7, often: int = 2, drop_one_in: int = 31) -> DataFrame:
    """(word, n): lower-cased (A-Z) runs of letters, each ``drop_one_in``-th by hash without one code point, of at least ``least`` code points and ``often`` occurrences."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.expr(f"regexp_extract_all(text, '[A-Za-z\\u00C0-\\u00FF]{{{least},}}', 0)")).alias("w"))
    # most runs are lower-case already: the test is cheaper than translating
    runs = runs.withColumn("w", F.when(F.lower("w") == F.col("w"), F.col("w")).otherwise(F.translate("w", UPPER, LOWER)))
    if drop_one_in:
        runs = runs.withColumn("h", F.crc32(F.concat_ws(":", "id", "w").cast("binary")))
        at = (F.col("h") % F.char_length("w")).cast("int")
        cut = F.concat(F.substring("w", F.lit(1), at), F.substring("w", at + 2, F.char_length("w")))
        runs = runs.withColumn("w", F.when(F.col("h") % drop_one_in == 0, cut).otherwise(F.col("w")))
    counts = runs.where(F.char_length("w") >= least).groupBy(F.col("w").alias("word")).agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= often)


def compatible(x: str, y: str) -> bool:
    """Whether words that begin with ``x`` and with ``y`` can be at most one edit apart."""
    a = next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
    agree = lambda p, q: p.startswith(q) or q.startswith(p)
    return a == min(len(x), len(y)) or agree(x[a + 1 :], y[a + 1 :]) or agree(x[a:], y[a + 1 :]) or agree(x[a + 1 :], y[a:])


def meetings(ends: list[tuple[int, str, str]], same: int) -> list[tuple[int, int]]:
    """Pairs of blocks (block, first word, last word; in order) that may hold words with the first ``same`` code points in common and one edit apart."""
    shared = []
    for _, lo, hi in ends:
        k = next((i for i, (p, q) in enumerate(zip(lo, hi, strict=False)) if p != q), min(len(lo), len(hi)))
        shared.append(lo[:k])
    out = []
    for i, (block, _, hi) in enumerate(ends):
        out.append((block, block))
        for j in range(i + 1, len(ends)):
            if ends[j][1][:same] != hi[:same]:
                break
            if compatible(shared[i], shared[j]):
                out.append((block, ends[j][0]))
    return out


class Sorted:
    """A sorted list of words as code points, with the lengths of the common prefixes of adjacent words."""

    def __init__(self, words: list[str]):
        self.words = words
        self.length = np.array([len(w) for w in words], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.length)])
        self.points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        self.common = np.zeros(len(words), np.int64)  # of a word with the one before it
        at = np.arange(1, len(words))
        depth = 0
        while len(at):
            at = at[(self.length[at] > depth) & (self.length[at - 1] > depth)]
            at = at[self.points[self.first[at] + depth] == self.points[self.first[at - 1] + depth]]
            depth += 1
            self.common[at] = depth

    def point(self, word: np.ndarray, depth) -> np.ndarray:
        """The code point at a depth, -1 beyond the word's end."""
        inside = (depth >= 0) & (depth < self.length[word])
        return np.where(inside, self.points[np.where(inside, self.first[word] + depth, 0)], -1) if len(self.points) else np.full(len(word), -1)


def scan(asks: Sorted, found: Sorted, same: int, within: bool) -> tuple[np.ndarray, np.ndarray]:
    """(ask, word) by their places: words of ``found`` exactly one edit from an ask, with the first ``same`` code points in common.

    ``within``: both are one list, and only later words count.
    """
    spans: dict[str, tuple[int, int]] = {}
    low, high = np.zeros(len(asks.words), np.int64), np.zeros(len(asks.words), np.int64)
    for i, w in enumerate(asks.words):
        start = w[:same]
        if start not in spans:
            spans[start] = bisect_left(found.words, start), bisect_right(found.words, start, key=lambda x, n=same: x[:n])
        low[i], high[i] = spans[start]
    ask = np.arange(len(asks.words))
    if within:
        low = np.maximum(low, ask + 1)
    keep = low < high
    ask, low, high = ask[keep], low[keep], high[keep]
    # cells of the row at this depth: of the ask's prefixes one shorter, as long, and one longer
    row = np.stack([np.full(len(ask), 1 if same else 2), np.zeros(len(ask), np.int64), np.where(asks.length[ask] > same, 1, 2)]) if len(ask) else np.zeros((3, 0), np.int64)
    depth, pairs = same, []
    while len(ask):
        # the one word that ends here comes first in its range
        ends = found.length[low] == depth
        cell = asks.length[ask] - depth + 1
        done = ends & (cell >= 0) & (cell <= 2)
        hit = done & (row[np.clip(cell, 0, 2), np.arange(len(ask))] == 1)
        pairs.append((ask[hit], low[hit]))
        low = low + ends
        keep = low < high
        ask, low, high, row = ask[keep], low[keep], high[keep], row[:, keep]
        if not len(ask):
            break
        # ranges split where adjacent words part at this depth
        cuts = np.flatnonzero(found.common <= depth)
        before, after = np.searchsorted(cuts, low, "right"), np.searchsorted(cuts, high, "left")
        many = after - before + 1
        of = np.repeat(np.arange(len(ask)), many)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
        start = np.where(nth == 0, low[of], cuts[np.minimum(before[of] + nth - 1, len(cuts) - 1)])
        stop = np.where(nth == many[of] - 1, high[of], cuts[np.minimum(before[of] + nth, len(cuts) - 1)])
        ask, row = ask[of], row[:, of]
        point, length = found.point(start, np.full(len(start), depth)), asks.length[ask]
        cost = [(point != asks.point(ask, np.full(len(ask), depth + k))).astype(np.int64) for k in (-1, 0, 1)]
        one = np.where(length >= depth, np.minimum(row[0] + cost[0], row[1] + 1), 2)
        two = np.where(length >= depth + 1, np.minimum(np.minimum(row[1] + cost[1], row[2] + 1), one + 1), 2)
        three = np.where(length >= depth + 2, np.minimum(row[2] + cost[2], two + 1), 2)
        row = np.minimum(np.stack([one, two, three]), 2)
        keep = row.min(0) <= 1
        ask, low, high, row = ask[keep], start[keep], stop[keep], row[:, keep]
        depth += 1
    return (np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _meet(least: int, same: int, backwards: bool):
    """The words of a pair of blocks that are near each other, both ways round."""

    def work(table: pa.Table) -> pa.Table:
        lists, counts = [], []
        side = table["side"].to_numpy()
        for k in (0, 1):
            part = table.filter(pa.array(side == k)).sort_by("key")  # by bytes, which is by code points
            lists.append(Sorted(part["key"].to_pylist()))
            counts.append(part["n"].to_numpy())
        within = not len(lists[1].words)
        a, b = lists[0], lists[0] if within else lists[1]
        p, q = scan(a, b, same, within)
        if backwards and len(p):  # those that begin alike are found in the other list
            alike = np.ones(len(p), bool)
            for k in range(least // 2):
                alike &= a.point(p, a.length[p] - 1 - k) == b.point(q, b.length[q] - 1 - k)
            p, q = p[~alike], q[~alike]
        said = lambda s, at: [s.words[i][::-1] if backwards else s.words[i] for i in at.tolist()]
        left, right, n, m = said(a, p), said(b, q), counts[0][p], (counts[0] if within else counts[1])[q]
        return pa.table({"word": pa.array(left + right, pa.string()), "n": pa.array(np.concatenate([n, m]), pa.int64()), "near": pa.array(right + left, pa.string()), "near_n": pa.array(np.concatenate([m, n]), pa.int64())})

    return work


def near_pairs(words: DataFrame, least: int = 7, block: int = BLOCK) -> DataFrame:
    """(word, n, near, near_n), both ways round, of all words (word, n; of ``least`` code points or more) exactly one edit apart."""
    spark, total = words.sparkSession, words.count()
    blocks = max(1, min(BLOCKS, -(-total // block)))
    out = []
    for backwards in (False, True) if least > 1 else (False,):
        same = least - least // 2 if backwards else least // 2
        key = F.reverse("word") if backwards else F.col("word")
        cut = words.select(key.alias("key"), "n").repartitionByRange(blocks, "key").withColumn("block", F.spark_partition_id())
        cut = stage(cut, "spelling-blocks")
        ends = cut.groupBy("block").agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
        ends = ends.select("block", *[F.substring(c, 1, max(SHOWN, same)).alias(c) for c in ("lo", "hi")])
        met = meetings([tuple(r) for r in ends.orderBy("lo", "hi", "block").collect()], same)
        if not met:
            continue
        sides = [(b, pair, side) for pair, (i, j) in enumerate(met) for side, b in enumerate((i, j)) if side == 0 or i != j]
        dealt = spark.createDataFrame(sides, "block int, pair int, side int")
        both = cut.join(F.broadcast(dealt), "block")  # a few rows for each of at most BLOCKS blocks

        out.append(stage(both.groupBy("pair").applyInArrow(_meet(least, same, backwards), "word string, n long, near string, near_n long"), "spelling-near"))
    if not out:
        return words.limit(0).select("word", "n", F.col("word").alias("near"), F.col("n").alias("near_n"))
    return out[0].unionByName(out[1]) if len(out) > 1 else out[0]


def roots(forms: DataFrame, longest: int) -> DataFrame:
    """(word, root) of words that have a form: the last of the chain of forms, by pointer jumping; ``longest`` bounds a chain's length."""
    up = stage(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    for _ in range(math.ceil(math.log2(max(1, longest)))):
        further = up.select(F.col("word").alias("root"), F.col("root").alias("further"))
        up = stage(up.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "spelling-roots")
    return up


def group_variants(docs: DataFrame, least: int = 7, often: int = 2, drop_one_in: int = 31, times: int = 10, block: int = BLOCK) -> DataFrame:
    """A row for each word: form (its near word of largest n, ties to the smaller word, if that n is ``times`` the word's), root, n, n_near and form_n."""
    words = stage(vocabulary(docs, least, often, drop_one_in), "spelling-words")
    near = near_pairs(words, least, block)
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("w"))))
    rows = near.unionByName(words.select("word", "n", F.lit(None).cast("string").alias("near"), F.lit(None).cast("long").alias("near_n")))
    rows = rows.groupBy("word").agg(F.max("n").alias("n"), F.count("near").alias("n_near"), best.alias("b"))
    taken = -F.col("b.n") >= times * F.col("n")
    rows = stage(rows.select("word", F.when(taken, F.col("b.w")).alias("form"), "n", "n_near", F.when(taken, -F.col("b.n")).alias("form_n")), "spelling-forms")
    largest = words.agg(F.max("n")).first()[0] or 1
    top = roots(rows.where("form IS NOT NULL"), int(math.log(max(1, largest), times)) + 1 if times > 1 else largest)
    return rows.join(top, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
