"""Toxicity by noisy-channel deobfuscation.

* A character language model (trigrams over 28 classes: a-z, other letters, boundary) is counted in Spark over the words of
  all texts; its table has a fixed size, its counts grow with the corpus.
* Words that may be obfuscated (any sign of leetspeak, a letter twice or more in a row, letters set apart by spaces or
  separators) become character lattices: every character has its readings with a channel cost, a run of a letter may be
  one, two or all of its letters. Viterbi search under the model picks the reading. Signs at the end of a word may be marks
  or letters: both are read. A word with signs of leetspeak or with doubled letters only also counts as it is written.
* Restored texts are scored: a log-odds table over words and word beginnings, learnt from labelled rows, summed over a
  document's distinct features and calibrated by logistic regression.

Learning uses at most ``max_rows`` labelled rows outside the held-out fold; all their features that pass the weight rule are
kept. Defined results: null text is empty; without both classes among the labels every score is the labels' mean (0 without
labels). Repeated rows are scored each; of rows that repeat a doc_id, the least text is learnt from. Other columns pass through;
those named held_out or score are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import labelled, remainder
from .scratch import stage
from .words import BASE, LOWER, Words, chunks, mix64, powers

SYMBOLS = 28
CLASS = np.zeros(256, np.int64)
CLASS[97:123] = np.arange(1, 27)
CLASS[65:91] = np.arange(1, 27)
CLASS[128:] = 27
#: Readings of the signs of leetspeak (fixed values).
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c",
}
SEPARATORS = "._-*~/\\'`,:;"
LEET_COST, FOLD_COST, KEEP_RUN_COST, BREAK_COST = 0.7, 0.2, 1.0, 1.0
MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in LEET)
OUTER = "(<!|+"  # signs of leetspeak that are marks too
GAP = "\x1f"  # between letters set apart: nothing, or a break between words
_letters = np.zeros(256, bool)
_letters[65:91] = _letters[97:123] = _letters[128:] = True
_leet = np.zeros(256, bool)
_leet[[ord(c) for c in LEET]] = True
_separator = np.zeros(256, bool)
_separator[[ord(c) for c in SEPARATORS]] = True
_plain = _letters.copy()
_plain[48:58] = True
PREFIXES = (4, 5, 6)
REMEMBERED = 64  # characters: readings of longer words are searched each time


def gather_model(docs: DataFrame) -> np.ndarray:
    """Log-probabilities of a class after the two before it, from the words of every text: SYMBOLS**3 numbers."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            total = np.zeros(SYMBOLS**3, np.int64)
            for batch in chunks(whole):
                w = Words(batch.column("text"))
                c = np.where(w.inside, CLASS[w.data], 0)
                c = np.concatenate([[0, 0], c, [0]])
                total += np.bincount(c[:-2] * SYMBOLS**2 + c[1:-1] * SYMBOLS + c[2:], minlength=SYMBOLS**3)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["trigram", "n"])

    sums = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(counted, "trigram long, n long").groupBy("trigram").agg(F.sum("n").alias("n"))
    table = sums.toArrow().combine_chunks()
    counts = np.full(SYMBOLS**3, 0.0)
    counts[table["trigram"].to_numpy()] = table["n"].to_numpy()
    counts = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    two = counts.sum(0)
    two = (two + 0.5) / (two + 0.5).sum(1, keepdims=True)
    return np.log((counts + 20 * two[None]) / (counts.sum(2, keepdims=True) + 20))


class Restorer:
    """Viterbi search over the readings of one obfuscated word; readings are kept for words seen before."""

    def __init__(self, model: np.ndarray, known: int = 100_000):
        self.model, self.seen, self.known = model, {}, known

    @staticmethod
    def lattice(word: str) -> list[list[tuple[str, float]]]:
        """For each run of one character, its readings and their costs."""
        out, i = [], 0
        while i < len(word):
            c, j = word[i], i
            while j < len(word) and word[j] == c:
                j += 1
            run = j - i
            counts = {1: 0.0 if run == 1 else FOLD_COST * (run == 2) + (run > 2) * 0.0}
            if run >= 2:
                counts[2] = 0.0 if run == 2 else FOLD_COST
            if run > 2:
                counts[run] = KEEP_RUN_COST * run
            if c == GAP:
                out.append([("", 0.0), (" ", BREAK_COST)])
            elif c.isalpha():
                out.append([(c * k, cost) for k, cost in counts.items()])
            elif c in LEET:
                out.append([(r * k, cost + LEET_COST * k) for r in LEET[c] for k, cost in counts.items()])
            elif c in SEPARATORS:
                out.append([("", 0.0)])
            else:
                out.append([(word[i:j], 0.0)])
            i = j
        return out

    def read(self, word: str) -> str:
        word = word.lower()
        if word in self.seen:
            return self.seen[word]
        # what was read is a chain of (before, reading): words of any length take time in proportion to it
        best: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
        for readings in self.lattice(word):
            then: dict[tuple[int, int], tuple[float, tuple]] = {}
            for (a, b), (score, chain) in best.items():
                for reading, cost in readings:
                    p, q, s = a, b, score - cost
                    for ch in reading:
                        c = ord(ch) - 96 if "a" <= ch <= "z" else 0 if ch == " " else 27
                        s += self.model[p, q, c]
                        p, q = q, c
                    if (p, q) not in then or then[p, q][0] < s:
                        then[p, q] = (s, (chain, reading))
            best = then
        ends = []
        for (a, b), (score, chain) in best.items():
            parts = []
            while chain:
                chain, reading = chain
                parts.append(reading)
            ends.append((score + self.model[a, b, 0], "".join(reversed(parts))))
        text = max(ends)[1]
        if len(word) <= REMEMBERED and len(self.seen) < self.known:
            self.seen[word] = text
        return text


def suspects(w: Words) -> np.ndarray:
    """For each word: 1 if its own characters may hide something, 3 if it has no more than doubled letters, 2 if it is one of several single characters in a row."""
    n = len(w.starts)
    if not n:
        return np.zeros(0, np.int8)
    d, size = w.data, w.ends - w.starts
    letter, leet = _letters[d], _leet[d] & w.inside
    count = lambda x: np.add.reduceat(x & w.inside, w.starts)
    mixed = count(leet) > 0
    triple, double, low = np.zeros(len(d), bool), np.zeros(len(d), bool), LOWER[d]
    double[:-1] = (low[:-1] == low[1:]) & letter[:-1] & (low[:-1] < 128) & w.inside[1:]
    if len(d) > 2:
        triple[:-2] = (low[:-2] == low[1:-1]) & (low[1:-1] == low[2:]) & (letter | leet)[:-2] & w.inside[1:-1] & w.inside[2:]
    runs = count(triple & (letter | leet)) > 0
    doubled = count(double) > 0
    apart = np.zeros(len(d), bool)
    if len(d) > 4:
        s, ll = _separator[d], letter | leet
        apart[:-4] = ll[:-4] & s[1:-3] & ll[2:-2] & s[3:-1] & ll[4:]
    spelt = count(apart) > 0
    own = (size > 2) & (mixed | runs | spelt | doubled)
    # letters set apart by spaces: words of one character, the last perhaps with a mark behind it
    one = (size == 1) & (letter | leet)[w.starts]
    tail = (size == 2) & letter[w.starts] & ~_plain[d[w.ends - 1]]
    same = np.zeros(n, bool)
    doc = w.docs()
    same[1:] = (doc[1:] == doc[:-1]) & one[:-1] & (one | tail)[1:]
    linked = same.copy()
    linked[:-1] |= same[1:]
    out = np.where(own, np.where(mixed | runs | spelt, 1, 3), 0).astype(np.int8)
    out[linked] = 2
    return out


def _groups(w: Words, kind: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of words that are read as one word: each suspect, and each row of at least three single characters."""
    at, doc = np.flatnonzero(kind), None
    if not len(at):
        return
    doc = w.docs()
    i = 0
    while i < len(at):
        a = at[i]
        if kind[a] != 2:
            yield a, a + 1
            i += 1
            continue
        j = i
        while j + 1 < len(at) and at[j + 1] == at[j] + 1 and kind[at[j + 1]] == 2 and doc[at[j + 1]] == doc[a]:
            j += 1
        if j - i >= 2:
            yield a, at[j] + 1
        i = j + 1


def _core(word: str) -> str:
    """The word without marks around it; a leading sign of leetspeak stays if a letter follows."""
    while word and not word[-1].isalnum() and word[-1] not in "@$+":
        word = word[:-1]
    while word and not word[0].isalnum() and not (word[0] in LEET and len(word) > 1 and word[1].isalnum()):
        word = word[1:]
    return word


def _readings(text: str, restorer: Restorer) -> list[str]:
    """What a suspect may say: the signs around it taken as marks, or as letters too."""
    word, whole = GAP.join(_core(x) for x in text.split()), _signed(text)
    return [restorer.read(x) for x in {word: 0, whole: 0, whole.strip(OUTER): 0} if x]


def _signed(text: str) -> str:
    """One word without marks around it that aren't signs of leetspeak."""
    return "" if len(text.split()) > 1 else text.strip(MARKS)


def _feature_hashes(w: Words) -> list[np.ndarray]:
    """Hash of each word without the marks around it, and of its beginnings (0 where the word isn't longer)."""
    d = w.data
    if not len(w.starts):
        return [np.zeros(0, np.uint64)] * (1 + len(PREFIXES))
    at = np.arange(len(d))
    plain = _plain[d] & w.inside
    first = np.minimum.reduceat(np.where(plain, at, len(d)), w.starts)
    last = np.maximum.reduceat(np.where(plain, at, -1), w.starts)
    length = np.maximum(last - first + 1, 0)
    first = np.where(length > 0, first, w.starts)
    h, out = np.zeros(len(first), np.uint64), []
    for j in range(max(PREFIXES)):
        inside = length > j
        h = h * BASE + np.where(inside, d[np.minimum(first + j, len(d) - 1)].astype(np.uint64) + np.uint64(1), np.uint64(0))
        if j + 1 in PREFIXES:
            out.append(np.where(length > j + 1, mix64(h ^ np.uint64(0xA5A5 + j)), np.uint64(0)))
    # every byte from the first plain one to the last, by its place
    ends = np.stack([first, np.minimum(first + np.maximum(length, 1), len(d))], 1).ravel()
    place = np.maximum(at - np.repeat(np.concatenate([[0], first]), np.diff(np.concatenate([[0], first, [len(d)]]))), 0)
    terms = np.concatenate([(d.astype(np.uint64) + np.uint64(1)) * powers(int(place.max()) + 1)[place], np.zeros(1, np.uint64)])
    whole = np.where(length > 0, mix64(np.add.reduceat(terms, ends)[::2] * BASE + length.astype(np.uint64)), np.uint64(0))
    return [whole, *out]


def document_features(column: pa.Array, restorer: Restorer) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) pairs of the restored texts, repeats included."""
    w = Words(column, lower=True)
    kind = suspects(w)
    drop, doc, raw = np.zeros(len(w.starts), bool), w.docs(), w.data.tobytes()
    signs = np.add.reduceat(_leet[w.data] & w.inside, w.starts) > 0 if len(w.starts) else drop
    # each distinct suspect is read once; ``of`` tells whose reading it is, ``at`` and ``back`` where it stands
    single = np.flatnonzero((kind == 1) | (kind == 3))
    _, at, back = np.unique(w.hashes()[single], return_index=True, return_inverse=True)
    read, of, holders = [], [], []
    for u, i in enumerate(single[at].tolist()):
        text = raw[w.starts[i] : w.ends[i]].decode("utf-8", "replace")
        for word in _readings(text, restorer):
            if kind[i] == 1 or word != text:
                read.append(word)
                of.append(u)
    drop[single] = (kind[single] == 1) & ~signs[single]
    for a, b in _groups(w, np.where(kind == 2, kind, 0)):
        drop[a:b] = True
        for word in _readings(raw[w.starts[a] : w.ends[b - 1]].decode("utf-8", "replace"), restorer):
            read.append(word)
            of.append(len(at) + len(holders))
        holders.append(doc[a])
    hashes = [h[~drop] for h in _feature_hashes(w)]
    owner = [np.tile(doc[~drop], len(hashes))]
    if read:
        again = Words(pa.array(read))
        whose = np.asarray(of, np.int64)[again.docs()]
        place = np.concatenate([back, len(at) + np.arange(len(holders))])
        order = np.argsort(place, kind="stable")
        docs, n = np.concatenate([doc[single], np.asarray(holders, np.int64)])[order], np.bincount(place, minlength=len(at) + len(holders))
        begin, many = (np.cumsum(n) - n)[whose], n[whose]
        rows = np.repeat(np.arange(len(whose)), many)
        texts = docs[np.arange(len(rows)) - np.repeat(np.cumsum(many) - many, many) + begin[rows]]
        owner.append(np.tile(texts, 1 + len(PREFIXES)))
        hashes += [h[rows] for h in _feature_hashes(again)]
    owner, hashes = np.concatenate(owner), np.concatenate(hashes)
    keep = hashes != 0
    return owner[keep], hashes[keep]


def restore(text: str, restorer: Restorer) -> str:
    """A text with its obfuscated words replaced by their readings."""
    w = Words(pa.array([text]))
    raw, out, at = w.data.tobytes(), [], 0
    for a, b in _groups(w, suspects(w)):
        piece = raw[w.starts[a] : w.ends[b - 1]].decode()
        word = GAP.join(_core(x) for x in piece.split())
        if not any(c.isalpha() for c in piece):
            continue  # numbers stay in the text; scoring reads them too
        read = restorer.read(word)
        out.append(raw[at : w.starts[a]].decode() + (piece.replace(word, read) if word and word in piece else read))
        at = w.ends[b - 1]
    return "".join(out) + raw[at:].decode()


class Scorer:
    """Sorted features with weights, and the calibration of their sums."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, prior: float):
        order = np.argsort(features)
        self.features, self.weights, self.prior, self.line = features[order], weights[order], prior, None
        self.near = np.zeros(1 << 16, bool)
        self.near[(self.features & np.uint64(0xFFFF)).astype(np.int64)] = True

    def sums(self, column: pa.Array, restorer: Restorer) -> np.ndarray:
        """For each text: the sum of the weights of its distinct features, and the greatest weight."""
        doc, h = document_features(column, restorer)
        out = np.zeros((len(column), 2))
        maybe = np.flatnonzero(self.near[(h & np.uint64(0xFFFF)).astype(np.int64)])
        doc, h = doc[maybe], h[maybe]
        if not len(self.features) or not len(doc):
            return out
        at = np.minimum(np.searchsorted(self.features, h), len(self.features) - 1)
        hit = self.features[at] == h
        pairs = np.unique(doc[hit] * len(self.features) + at[hit])
        d, f = pairs // len(self.features), pairs % len(self.features)
        out[:, 0] = np.bincount(d, self.weights[f], len(column))
        np.maximum.at(out[:, 1], d, self.weights[f])
        return out

    @staticmethod
    def _design(s: np.ndarray) -> np.ndarray:
        return np.column_stack([np.ones(len(s)), np.sign(s[:, 0]) * np.log1p(np.abs(s[:, 0])), s[:, 1]])

    def calibrate(self, s: np.ndarray, y: np.ndarray) -> None:
        x = self._design(s)
        beta = np.array([np.log(self.prior / (1 - self.prior)), 0.0, 0.0])
        for _ in range(25):
            p = 1 / (1 + np.exp(np.clip(-x @ beta, -700, 700)))
            hess = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(3)
            beta += np.clip(np.linalg.solve(hess, x.T @ (y - p) - 0.1 * beta * [0, 1, 1]), -2, 2)
        self.line = beta

    def score(self, s: np.ndarray) -> np.ndarray:
        if self.line is None:
            return np.full(len(s), self.prior)
        return 1 / (1 + np.exp(np.clip(-self._design(s) @ self.line, -700, 700)))


def _scored(docs: DataFrame, labels: DataFrame, label: str = "toxic", parts: int = 4, held: int = 2, max_rows: int = 20_000, min_docs: int = 5) -> DataFrame:
    """row (the columns of ``docs`` as a struct), held_out and score."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = sc.broadcast(gather_model(texts))
    sample = F.broadcast(stage(labelled(docs, labels, label, parts, held, max_rows), "toxic-labels"))
    train = stage(texts.join(sample, "doc_id").groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.max("label").alias("label")), "toxic-train")

    def feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model.value)
        for whole in batches:
            for batch in chunks(whole):
                y = batch.column("label").to_numpy().astype(np.int64)
                doc, h = document_features(batch.column("text"), restorer)
                order = np.lexsort((doc, h))
                doc, h = doc[order], h[order]
                once = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]) if len(h) else np.zeros(0, bool)
                doc, h = doc[once], h[once]
                edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
                n = np.diff(np.concatenate([edge, [len(h)]])) if len(h) else edge
                t = np.add.reduceat(y[doc], edge) if len(h) else edge
                yield pa.RecordBatch.from_arrays([pa.array(h[edge].view(np.int64)), pa.array(n.astype(np.int64)), pa.array(t.astype(np.int64))], ["feature", "n", "t"])

    size = train.agg(F.count(F.lit(1)), F.sum("label")).first()
    rows, toxic = size[0] or 0, size[1] or 0
    prior = toxic / rows if rows else 0.0
    counts = train.mapInArrow(feature_counts, "feature long, n long, t long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    odds = F.log((F.col("t") + 0.5 * prior) / (F.col("n") - F.col("t") + 0.5 * (1 - prior))) - float(np.log(max(prior, 1e-9) / max(1 - prior, 1e-9)))
    # evidence shrinks by one standard error of the log-odds, so chance finds in few documents weigh little
    error = F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("n") - F.col("t") + 0.5))
    weighed = counts.where(F.col("t") >= min_docs).withColumn("weight", odds - error).where(F.col("weight") > 1.0)
    # bounded by the labelled rows, since each feature is in some of them
    learnt = weighed.where(F.lit(0 < toxic < rows)).orderBy("feature").select("feature", "weight").toArrow().combine_chunks()
    scorer = Scorer(learnt["feature"].to_numpy().view(np.uint64) if learnt.num_rows else np.zeros(0, np.uint64), learnt["weight"].to_numpy() if learnt.num_rows else np.zeros(0), prior)
    if 0 < toxic < rows:
        first = sc.broadcast(scorer)

        def training_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            restorer = Restorer(model.value)
            for whole in batches:
                for batch in chunks(whole):
                    s = first.value.sums(batch.column("text"), restorer)
                    yield pa.RecordBatch.from_arrays([pa.array(s[:, 0]), pa.array(s[:, 1]), batch.column("label")], ["a", "b", "label"])

        got = train.mapInArrow(training_sums, "a double, b double, label int").toArrow().combine_chunks()
        scorer.calibrate(np.column_stack([got["a"].to_numpy(), got["b"].to_numpy()]), got["label"].to_numpy().astype(float))
    final = sc.broadcast(scorer)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model.value)
        for whole in batches:
            for batch in chunks(whole):
                s = final.value.score(final.value.sums(batch.column("text"), restorer))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s)], [*batch.schema.names, "score"])

    # the other columns go as one, so that none of their names can clash
    full = docs.select(F.col("text").cast("string").alias("text"), F.struct(*docs.columns).alias("row"))
    found = full.mapInArrow(scored, full.withColumn("score", F.lit(0.0)).schema)
    held_out = F.coalesce(remainder(F.col("row.doc_id").cast("long"), parts) == held, F.lit(False))
    return found.select("row", held_out.alias("held_out"), "score")


def score_toxicity(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """The columns of ``docs`` with held_out and score, for every row."""
    names = [c for c in docs.columns if c.lower() not in ("held_out", "score")]
    return _scored(docs, labels, **settings).select(*[F.col("row").getField(c).alias(c) for c in names], "held_out", "score")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **settings) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with their columns."""
    return _scored(docs, labels, **settings).where(F.col("score") < threshold).select("row.*")
