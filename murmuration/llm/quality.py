"""Quality classifier: a generalised additive model with pairwise interactions.

Features are counted column-wise over whole texts. Cyclic boosting visits one feature after another, each time fitting a
shallow tree (up to four leaves over the feature's bins) to the gradient of the logistic loss and adding it to that
feature's lookup table; then the pairs with the largest gain get two-way tables by trees of one cut on each axis.
Scoring is one bin lookup and one addition for each table, vectorised over a batch.

Learning uses at most ``max_rows`` labelled rows, taken in the order of a hash of doc_id; everything else covers all
rows. Defined results: null text is empty and gets a score like any text; labels that are null are no labels; without
both classes among the labels every score is the labels' mean (0.5 without labels). Repeated rows are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import stage
from .words import Words, bytes_of, chunks

FEATURES = (
    "log_bytes", "log_words", "mean_word", "longest_word", "upper", "digits", "marks", "symbols", "bars", "beyond_ascii",
    "spaces", "newlines", "distinct_words", "top_word", "repeated_next", "distinct_pairs", "short_words", "marked_words",
    "log_lines", "mean_line", "distinct_lines", "stops",
)


def _table(chars: str) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars.encode())] = True
    return t


UPPER, LETTER, DIGIT = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"), _table("0123456789")
MARKS, SYMBOLS, BARS, STOPS = _table("!?"), _table("#$%&*+<=>@\\^_`{}~[]/"), _table("|"), _table(".")
BEYOND = np.arange(256) >= 128
PLAIN = LETTER | DIGIT | BEYOND | _table(".,;:'\"()-")


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[offsets]).astype(float)


def _distinct(doc: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each document, and the count of its most common one."""
    if not len(doc):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((value, doc))
    d, v = doc[order], value[order]
    edge = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (v[1:] != v[:-1])]))
    run = np.diff(np.concatenate([edge, [len(d)]]))
    most = np.zeros(n)
    np.maximum.at(most, d[edge], run)
    return np.bincount(d[edge], minlength=n).astype(float), most


def features(column: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text."""
    w = Words(column)
    raw, offsets = bytes_of(column)
    n, size = len(offsets) - 1, np.maximum(np.diff(offsets), 1).astype(float)
    h, doc = w.hashes(), w.docs()
    words, some = w.counts.astype(float), np.maximum(w.counts, 1)
    length = (w.ends - w.starts).astype(float)
    longest = np.zeros(n)
    np.maximum.at(longest, doc, length)
    distinct, top = _distinct(doc, h, n)
    pairs, at = w.windows(h, 2)
    distinct_pairs, _ = _distinct(doc[at], pairs, n)
    same = np.bincount(doc[at], weights=h[at] == h[at + 1], minlength=n) if len(at) else np.zeros(n)
    per_word = lambda x: np.bincount(doc, weights=x, minlength=n) / some
    marked = np.add.reduceat(~PLAIN[raw] & w.inside, w.starts) > 0 if len(doc) else np.zeros(0)
    breaks = raw == 10
    lines = _sums(breaks, offsets) + 1
    # a line's fingerprint: sum of its words' hashes
    line = np.cumsum(breaks)[w.starts] if len(doc) else np.zeros(0, np.int64)
    if len(doc):
        edge = np.flatnonzero(np.concatenate([[True], (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])]))
        filled, _ = _distinct(doc[edge], np.add.reduceat(h, edge), n)
        full = np.bincount(doc[edge], minlength=n)
    else:
        filled = full = np.zeros(n)
    share = lambda t: _sums(t[raw], offsets) / size
    letters = np.maximum(_sums(LETTER[raw], offsets), 1)
    columns = (
        np.log1p(np.diff(offsets)), np.log1p(words), per_word(length), np.log1p(longest), _sums(UPPER[raw], offsets) / letters, share(DIGIT),
        share(MARKS), share(SYMBOLS), share(BARS), share(BEYOND), 1 - _sums(w.inside, offsets) / size, lines / size, distinct / some, top / some,
        same / some, distinct_pairs / some, per_word(length <= 3), per_word(marked), np.log1p(lines), words / lines, filled / np.maximum(full, 1), share(STOPS),
    )
    return np.column_stack(columns)


class AdditiveModel:
    """Lookup tables per feature and per chosen pair of features."""

    def __init__(self, bins: int = 32, rounds: int = 150, rate: float = 0.15, pairs: int = 8, pair_rounds: int = 60):
        self.bins, self.rounds, self.rate, self.pairs, self.pair_rounds = bins, rounds, rate, pairs, pair_rounds
        self.edges: list[np.ndarray] = []
        self.tables: list[np.ndarray] = []
        self.crossed: list[tuple[int, int, np.ndarray]] = []
        self.start = 0.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)])

    @staticmethod
    def _leaf(g: float, h: float) -> float:
        return float(np.clip(g / (h + 1.0), -4, 4))

    def _shallow(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """A tree of at most four leaves over the bins of one feature."""
        out = np.zeros(len(g))

        def grow(a: int, b: int, depth: int) -> None:
            if depth and b - a > 1:
                cg, ch = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
                tg, th = g[a:b].sum(), h[a:b].sum()
                gain = cg**2 / (ch + 1) + (tg - cg) ** 2 / (th - ch + 1) - tg**2 / (th + 1)
                at = int(np.argmax(gain))
                if gain[at] > 1e-6:
                    grow(a, a + at + 1, depth - 1)
                    grow(a + at + 1, b, depth - 1)
                    return
            out[a:b] = self._leaf(g[a:b].sum(), h[a:b].sum())

        grow(0, len(g), 2)
        return out

    def _quadrants(self, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
        """The best tree of one cut on each axis of a two-way table, and its gain."""
        cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
        gain, sums = 0.0, []
        for c in (cg, ch):
            ll = c[:-1, :-1]
            lr, rl = c[:-1, -1:] - ll, c[-1:, :-1] - ll
            sums.append((ll, lr, rl, c[-1, -1] - ll - lr - rl))
        gain = sum(a**2 / (b + 1) for a, b in zip(*sums, strict=True)) - cg[-1, -1] ** 2 / (ch[-1, -1] + 1)
        i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
        leaf = [self._leaf(a[i, j], b[i, j]) for a, b in zip(*sums, strict=True)]
        out = np.empty(g.shape)
        out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = leaf
        return out, float(gain[i, j])

    def fit(self, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])] if len(x) else [np.zeros(0)] * x.shape[1]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        mean = y.mean() if len(y) else 0.5
        if not len(y) or mean in (0, 1):
            self.start = float(np.log(max(mean, 1e-3) / max(1 - mean, 1e-3)))
            return self
        self.start = float(np.log(mean / (1 - mean)))
        b, score = self._binned(x), np.full(len(y), self.start)

        def gradient() -> tuple[np.ndarray, np.ndarray]:
            p = 1 / (1 + np.exp(-score))
            return y - p, p * (1 - p)

        for _ in range(self.rounds):
            for j, table in enumerate(self.tables):
                g, h = gradient()
                step = self.rate * self._shallow(np.bincount(b[:, j], g, len(table)), np.bincount(b[:, j], h, len(table)))
                table += step
                score += step[b[:, j]]
        g, h = gradient()

        def flat(i: int, j: int) -> tuple[np.ndarray, tuple[int, int]]:
            shape = (len(self.tables[i]), len(self.tables[j]))
            return b[:, i] * shape[1] + b[:, j], shape

        gains = []
        for i in range(x.shape[1]):
            for j in range(i):
                k, shape = flat(i, j)
                if min(shape) > 1:
                    two = [np.bincount(k, v, shape[0] * shape[1]).reshape(shape) for v in (g, h)]
                    gains.append((self._quadrants(*two)[1], i, j))
        chosen = [(i, j, np.zeros(flat(i, j)[1])) for _, i, j in sorted(gains, reverse=True)[: self.pairs]]
        for _ in range(self.pair_rounds):
            for i, j, table in chosen:
                g, h = gradient()
                k, shape = flat(i, j)
                step, _ = self._quadrants(*(np.bincount(k, v, table.size).reshape(shape) for v in (g, h)))
                table += self.rate * step
                score += self.rate * step.ravel()[k]
        self.crossed = chosen
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self._binned(x)
        total = np.full(len(x), self.start)
        for j, table in enumerate(self.tables):
            total += table[b[:, j]]
        for i, j, table in self.crossed:
            total += table[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-total))


def remainder(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts))


def labelled(docs: DataFrame, labels: DataFrame, label: str, parts: int, held: int, max_rows: int) -> DataFrame:
    """(doc_id, label) of at most about ``max_rows`` rows outside the held-out fold: a bounded table."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (remainder(F.col("doc_id"), parts) != held))
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    return rows.orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id").limit(max_rows)


def feature_table(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the features of every row, counted in one pass over the texts."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole):
                x = features(batch.column("text"))
                flat = pa.array(x.ravel().astype(np.float32))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), flat)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(measured, "doc_id long, x array<float>")


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), len(FEATURES))


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", parts: int = 3, held: int = 1, max_rows: int = 20_000) -> DataFrame:
    """doc_id, held_out, score of every row of ``docs``."""
    spark = docs.sparkSession
    table = stage(feature_table(docs), "quality-features")
    sample = F.broadcast(stage(labelled(docs, labels, label, parts, held, max_rows), "quality-labels"))
    # a doc_id that repeats counts once: the sample stays bounded
    train = table.join(sample, "doc_id").groupBy("doc_id").agg(F.min("x").alias("x"), F.max("label").alias("label")).toArrow().combine_chunks()
    x = _rows(train["x"].chunk(0)) if train.num_rows else np.zeros((0, len(FEATURES)))
    order = np.argsort(train["doc_id"].to_numpy()) if train.num_rows else np.zeros(0, int)
    y = train["label"].to_numpy().astype(float) if train.num_rows else np.zeros(0)
    model = spark.sparkContext.broadcast(AdditiveModel().fit(x[order], y[order]))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.value.score(_rows(batch.column("x"))))], ["doc_id", "score"])

    found = table.mapInArrow(scored, "doc_id long, score double")
    return found.select("doc_id", F.coalesce(remainder(F.col("doc_id"), parts) == held, F.lit(False)).alias("held_out"), "score")
