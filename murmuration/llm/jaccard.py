"""N-gram Jaccard join by parity sketches.

* A document's tokens are its distinct shingles. Documents with equal sets collapse to the one with the smallest id.
* Within a size band of ratio ``RATIO``, linked sets differ in at most D tokens. A token flips one bit in the lower half of
  one of T > D words, so the Hamming distance of two sketches' lower halves is a lower bound of the symmetric difference.
  At least T - D words see none of the differing tokens and are equal: pigeonhole. The upper half of a word is the XOR of
  32 hashed bits of its tokens, so that words of different tokens are hardly ever equal. Documents near a band's lower
  edge are also sketched for it.
* Documents are joined on equal (band, place, word). Each leaves out its words of at most L tokens, L being the largest
  number for which these are at most ``thin``: of the T - D equal words of a linked pair, which hold equal tokens, at least
  ``need`` = T - D - thin have more than either document's L, so a linked pair shares ``need`` keys.
* A key of at most SMALL documents makes each a candidate for the others. A key of more is open: it links its documents to
  the smallest one, the hub. A document with fewer than ``need`` open keys shares a key that isn't open with each document
  that it is linked with: it is settled. The keys of the others are joined again without the settled ones, until they hardly
  get fewer; documents that share a passage are settled so, near copies of one text stay.
* Candidates must pass the Hamming bound, then verification: three tables of cells XOR the tokens themselves, and the XOR of
  two documents' tables peels into exactly the differing tokens. The cells hold about 0.6 D of them; what doesn't peel is
  settled from the texts. A hub's sketch is copied for every PARTNERS of its candidates, so none of them waits in one task.
* The last open keys whose documents are in several components after that make families of components; inside a family,
  documents that aren't settled and are in different components are compared by Hamming distance in blocks, so no link is
  lost where a hub links to neither side. This step alone costs the square of such a rest of near copies.

Keys travel as sorted compressed blobs; a batch sends a key that is open in it once, with its own hub, so hot keys stay small.

Defined results: text without words has no set (0 shingles) and is in a component of its own; null text is empty. A row
without doc_id has no component. Rows that repeat a doc_id are separate sets under one id. Empty table: empty result.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import new_path, stage
from .substring_dedup import decode, encode
from .words import BASE, Words, chunks, mix64

RATIO = 1.5
U = np.uint64
LOW = U(0xFFFFFFFF)
SMALL = 8
PARTNERS = 512
BLOCK_ROWS, BLOCK_BYTES = 512, 8_000_000
COMPARED = 8_000_000


class Bands:
    """Size bands for a threshold num/den, and the shape of each band's sketches."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        # J >= num/den  <=>  (den + num) * delta <= (den - num) * (sizes together)
        low = next(n for n in range(1, 1 << 20) if self.bound(2 * n + 1) >= 1)
        self.lows = [low + 1]
        while self.lows[-1] < 1 << 40:
            self.lows.append(math.ceil(self.lows[-1] * RATIO))
        self.lows = np.array(self.lows)
        differ = np.array([self.bound(2 * (int(hi) - 1)) for hi in self.lows[1:]])
        self.differ = differ
        # the lower the threshold, the fewer tokens a word has and the more words of few tokens there are to leave out
        self.places = differ + 5 + differ * 5 * (den - num) // (4 * den)
        self.need = 2 + (self.places - differ - 2) // 8
        self.thin = self.places - differ - self.need
        self.cells = differ // 4 + 8

    def bound(self, sizes: int | np.ndarray):
        return (self.den - self.num) * sizes // (self.den + self.num)

    def of(self, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The band of a size, and the next one if the size may link into it; -1 where there is none."""
        own = np.searchsorted(self.lows, n, "right") - 1
        upper = self.lows[own + 1]
        following = np.where(n * self.den >= self.num * upper, own + 1, -1)
        return own, following

    def width(self, band: int) -> int:
        return int(self.places[band] + 3 * self.cells[band])


def token_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(text, token) of the distinct shingles of each text, in order, and the number of texts."""
    w = Words(column, lower=True)
    h, doc = w.hashes(), w.docs()
    tokens, at = w.windows(h, size)
    owner = doc[at]
    for n in range(1, size):  # fewer words: the whole sequence
        few = np.flatnonzero(w.counts == n)
        if len(few):
            t = np.full(len(few), n, U)
            for j in range(n):
                t = t * BASE + h[w.bounds[few] + j]
            tokens, owner = np.concatenate([tokens, mix64(t)]), np.concatenate([owner, few])
    order = np.lexsort((tokens, owner))
    tokens, owner = tokens[order], owner[order]
    once = np.concatenate([[True], (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])]) if len(tokens) else np.zeros(0, bool)
    return owner[once], tokens[once], len(w.counts)


def _token(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """48 bits of a token with 16 bits that check them, and the mixed bits that place it."""
    base = t >> U(16)
    m = mix64(base)
    return (base << U(16)) | (m & U(0xFFFF)), mix64(m ^ BASE)


def _cell(r: np.ndarray, table: int, cells: np.ndarray) -> np.ndarray:
    return (mix64(r + U(table + 1)) % cells.astype(U)).astype(np.int64) + table * cells


def _sketches(owner: np.ndarray, tokens: np.ndarray, band: np.ndarray, bands: Bands) -> list[tuple[bytes | None, bytes | None]]:
    """For each text its sketch for ``band`` (-1: none) and which of its places hold too few tokens to be joined on."""
    use = band[owner] >= 0
    owner, value = owner[use], tokens[use]
    b = np.maximum(band, 0)
    width = np.where(band >= 0, bands.places[b] + 3 * bands.cells[b], 0)
    off = np.cumsum(width) - width
    out = np.zeros(int(width.sum()), U)
    held = np.zeros(int(width.sum()), np.int64)
    kept, r = _token(value)
    places, cells = bands.places[b][owner], bands.cells[b][owner]
    slot = ((r >> U(32)) * places.astype(U) >> U(32)).astype(np.int64)
    np.bitwise_xor.at(out, off[owner] + slot, (mix64(r) & ~LOW) | U(1) << (r & U(31)))
    held += np.bincount(off[owner] + slot, minlength=len(held))
    for t in range(3):
        np.bitwise_xor.at(out, off[owner] + places + _cell(r, t, cells), kept)
    result = []
    for i, g in enumerate(band):
        if g < 0:
            result.append((None, None))
        else:
            s = slice(off[i], off[i] + width[i])
            count = held[off[i] : off[i] + bands.places[g]]
            thin = count < np.sort(count)[bands.thin[g]]
            result.append((out[s].tobytes(), np.packbits(thin).tobytes()))
    return result


SETS = "doc_id long, n long, f1 long, f2 long"
SKETCH = "rep long, f1 long, n long, g1 int, s1 binary, t1 binary, g2 int, s2 binary, t2 binary"


def _sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Tokens of some texts, the size of each set and two fingerprints of it."""
    owner, tokens, count = token_sets(column, size)
    n = np.bincount(owner, minlength=count)
    ends = np.concatenate([[0], np.cumsum(n)])
    return owner, tokens, n, [np.diff(np.concatenate([[U(0)], np.add.accumulate(mix64(tokens ^ U(k)))])[ends]).view(np.int64) for k in (1, 2)]


def _set_rows(docs: DataFrame, size: int) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole):
                _, _, n, prints = _sets(batch.column("text"), size)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), *map(pa.array, prints)], [c.split()[0] for c in SETS.split(", ")])

    return docs.mapInArrow(rows, SETS)


def _sketch_rows(docs: DataFrame, size: int, bands: Bands) -> DataFrame:
    """Sketches of the representatives (doc_id, text, f1) whose sets aren't too small to differ from a linked one."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole):
                owner, tokens, n, prints = _sets(batch.column("text"), size)
                first, second = bands.of(n)
                columns = [batch.column("doc_id"), pa.array(prints[0]), pa.array(n)]
                for g in (first, second):
                    got = _sketches(owner, tokens, g, bands)
                    columns += [pa.array(g.astype(np.int32), mask=g < 0), pa.array([x[0] for x in got], pa.binary()), pa.array([x[1] for x in got], pa.binary())]
                # of rows that repeat a doc_id, the one with the set that the id stands for
                take = ((first >= 0) | (second >= 0)) & (prints[0] == batch.column("f1").to_numpy())
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SKETCH.split(", ")]).filter(pa.array(take))

    return docs.mapInArrow(rows, SKETCH)


def _by_rep(docs: DataFrame, classes: DataFrame, size: int, bands: Bands, buckets: int) -> tuple[DataFrame, str]:
    """The sketches as a table bucketed by document: three joins read it, none shuffles it.

    The texts are dealt to the buckets, and sketched there: the sketches take more bytes.
    """
    spark = docs.sparkSession
    name = f"jaccard_{uuid.uuid4().hex}"
    texts = docs.repartition(buckets, "doc_id").join(classes.select(F.col("rep").alias("doc_id"), "f1"), "doc_id")
    dealt = _sketch_rows(texts, size, bands).write.bucketBy(buckets, "rep").option("compression", "zstd")
    dealt.option("path", new_path(spark, "jaccard-reps")).saveAsTable(name)
    return spark.table(name), name


def _keys(batch: pa.RecordBatch, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) of every place of every sketch that has to be joined on."""
    keys, rows = [], []
    for g, s, t in (("g1", "s1", "t1"), ("g2", "s2", "t2")):
        for i, (band, sketch, thin) in enumerate(zip(*(batch.column(c).to_pylist() for c in (g, s, t)), strict=True)):
            if band is None:
                continue
            places = int(bands.places[band])
            words = np.frombuffer(sketch, U, places)
            few = np.unpackbits(np.frombuffer(thin, np.uint8), count=places).astype(bool)
            at = np.flatnonzero(~few)
            keys.append(mix64(words[at] ^ mix64(at.astype(U) + U(band << 32))))
            rows.append(np.full(len(at), i))
    return (np.concatenate(keys), np.concatenate(rows)) if keys else (np.zeros(0, U), np.zeros(0, np.int64))


def _bucket(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> U(64 - bits)).astype(np.int64)


def _groups(keys: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by key and document, where each key begins in that order, and each entry's key number."""
    order = np.lexsort((doc, keys))
    keys = keys[order]
    new = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
    return order, np.flatnonzero(new), np.cumsum(new) - 1


def _pairs(a: np.ndarray, b: np.ndarray, opened: np.ndarray) -> list[pa.Array]:
    """Distinct rows, and for the open ones how many keys gave each."""
    opened = opened > 0
    order = np.lexsort((opened, b, a))
    a, b, opened = a[order], b[order], opened[order]
    lead = np.ones(len(a), bool)
    lead[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (opened[1:] != opened[:-1])
    at = np.flatnonzero(lead)
    return [pa.array(a[at]), pa.array(b[at]), pa.array(opened[at]), pa.array(np.diff(np.append(at, len(a))) * opened[at])]


PAIRS = "a long, b long, open boolean, n long"


def _candidates(reps: DataFrame, bands: Bands, bits: int) -> DataFrame:
    """(a, b, open, n): documents that share a key, and from how many open keys, for which b is the hub; a hub is its own partner."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "a", "b", "open", "n", "blob"]
        for batch in batches:
            keys, rows = _keys(batch, bands)
            doc = batch.column("rep").to_numpy()[rows]
            order, begin, group = _groups(keys, doc)
            keys, doc = keys[order], doc[order]
            big = np.bincount(group, minlength=len(begin))[group] > SMALL
            lead = np.zeros(len(doc), bool)
            lead[begin] = True
            at = np.flatnonzero(big & ~lead)
            if len(at):
                found = _pairs(doc[at], doc[begin][group[at]], np.ones(len(at)))
                b = _bucket(mix64(found[0].to_numpy().view(U)), bits)
                yield pa.RecordBatch.from_arrays([pa.array(b.astype(np.int32)), *found, pa.nulls(len(b), pa.binary())], names)
            sent = ~big | lead
            keys, doc, weight = keys[sent], doc[sent], np.where(big[sent], SMALL + 1, 1).astype(np.int32)
            cuts = np.searchsorted(_bucket(keys, bits), np.arange((1 << bits) + 1))
            for k in np.flatnonzero(np.diff(cuts)):
                s = slice(cuts[k], cuts[k + 1])
                none = [pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.bool_(), pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *none, pa.array([encode([keys[s]], doc[s], weight[s])])], names)

    def join(table: pa.Table) -> pa.Table:
        names = ["a", "b", "open", "n"]
        held = [decode(x) for x in table["blob"].to_pylist() if x is not None]
        out = [table.filter(pc.is_null(table["blob"])).select(names)]
        if held:
            keys, doc, weight = (np.concatenate(x) for x in zip(*held, strict=True))
            order, begin, group = _groups(keys, doc)
            doc = doc[order]
            opened = (np.add.reduceat(weight[order], begin) > SMALL)[group]
            at = np.flatnonzero(opened)
            pairs = [(doc[at], doc[begin][group[at]], np.ones(len(at)))]
            for k in range(1, SMALL):
                at = np.flatnonzero((group[k:] == group[:-k]) & ~opened[k:]) + k
                pairs.append((doc[at], doc[at - k], np.zeros(len(at))))
            out.append(pa.table(_pairs(*(np.concatenate(x) for x in zip(*pairs, strict=True))), names=names))
        return pa.concat_tables(out)

    packed = reps.mapInArrow(pack, "bucket int, a long, b long, open boolean, n long, blob binary")
    return packed.groupBy("bucket").applyInArrow(join, PAIRS).groupBy("a", "b").agg(F.max("open").alias("open"), F.sum("n").alias("n"))


def _unsettled(reps: DataFrame, classes: int, bands: Bands, bits: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All candidates (a, b, open); those of the last join; and (rep) of the documents that it doesn't settle."""
    need = F.array(*[F.lit(int(n)) for n in bands.need])
    core, held, found = reps, classes, []
    while True:
        keyed = stage(_candidates(core, bands, bits), "jaccard-pairs")
        found.append(keyed.where("a <> b").select("a", "b", "open"))
        opens = keyed.where("open").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("opens"))
        of = lambda g: F.coalesce(F.get(need, F.when(F.col(g).isNotNull(), F.col(g))), F.lit(1 << 30))
        left = stage(core.select("rep", "g1", "g2").join(opens, "rep").where(F.col("opens") >= F.least(of("g1"), of("g2"))).select("rep"), "jaccard-core")
        count = left.count()
        if not count or count > 0.8 * held:
            break
        core, held = reps.join(left, "rep", "left_semi"), count
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    return pairs, found[-1], left


def peel(x: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """For XORed tables of pairs (rows): the number of tokens that peeled, and whether nothing is left."""
    x, count = x.copy(), np.zeros(len(x), np.int64)
    width = np.int64(cells)
    while True:
        p, c = np.nonzero(x)
        v = x[p, c]
        base = v >> U(16)
        m = mix64(base)
        ok = (v & U(0xFFFF)) == (m & U(0xFFFF))
        p, c, v, m = p[ok], c[ok], v[ok], m[ok]
        r = mix64(m ^ BASE)
        where = [_cell(r, t, np.full(len(r), width)) for t in range(3)]
        ok = np.choose(c // width, where) == c if len(c) else np.zeros(0, bool)
        p, v = p[ok], v[ok]
        if not len(p):
            return count, ~x.any(1)
        order = np.lexsort((v, p))
        p, v, where = p[order], v[order], [w[ok][order] for w in where]
        once = np.concatenate([[True], (p[1:] != p[:-1]) | (v[1:] != v[:-1])])
        for w in where:
            np.bitwise_xor.at(x, (p[once], w[once]), v[once])
        count += np.bincount(p[once], minlength=len(x))
        if count.max() > 64 * cells:  # cannot happen with true tokens
            return count, ~x.any(1)


def judge(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, band: int, bands: Bands) -> np.ndarray:
    """1: linked, 0: not, 2: can't tell; for rows of sketches of one band and the sizes of the two sets together."""
    x, t, bound = a ^ b, int(bands.places[band]), bands.bound(sizes)
    out = np.zeros(len(x), np.int8)
    near = np.flatnonzero(np.bitwise_count(x[:, :t] & LOW).sum(1) <= bound)
    if len(near):
        count, whole = peel(x[near][:, t:], int(bands.cells[band]))
        out[near] = np.where(whole, count <= bound[near], 2)
    return out


def _sides(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs (a, b) with the sketches of both.

    b may be the hub of very many: its sketch is copied, one copy for every PARTNERS of them.
    """
    cols = ["n", "g1", "s1", "g2", "s2"]
    side = lambda x: reps.select(F.col("rep").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in cols])
    many = stage(pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).cast("int").alias("copies")), "jaccard-hubs")
    salted = pairs.select("a", "b").join(many, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("copies")).cast("int").alias("copy"))
    left = salted.join(side("a"), "a").select("a", "b", "copy", *[f"a_{c}" for c in cols])
    right = side("b").join(many, "b").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    return left.join(right, ["b", "copy"])


def _lower_halves(reps: DataFrame, bands: Bands) -> DataFrame:
    """(rep, n, g1, s1, g2, s2) with the lower halves of the sketches' words alone, for the Hamming bound."""

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, s in (("g1", "s1"), ("g2", "s2")):
                at = [batch.schema.get_field_index(c) for c in (g, s)]
                halves = [None if k is None else (np.frombuffer(x, U, int(bands.places[k])) & LOW).astype(np.uint32).tobytes() for k, x in zip(*(batch.column(i).to_pylist() for i in at), strict=True)]
                batch = batch.set_column(at[1], s, pa.array(halves, pa.binary()))
            yield batch

    return reps.select("rep", "n", "g1", "s1", "g2", "s2").mapInArrow(strip, "rep long, n long, g1 int, s1 binary, g2 int, s2 binary")


def _near(pairs: DataFrame, lower: DataFrame, bands: Bands) -> DataFrame:
    """The pairs within the Hamming bound, by lower halves."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = {c: batch.column(c).to_pylist() for c in batch.schema.names}
            hit = []
            for i in range(len(batch)):
                common = next(((p, q) for p in (1, 2) for q in (1, 2) if v[f"a_g{p}"][i] is not None and v[f"a_g{p}"][i] == v[f"b_g{q}"][i]), None)
                if common:
                    x = np.frombuffer(v[f"a_s{common[0]}"][i], np.uint32)
                    y = np.frombuffer(v[f"b_s{common[1]}"][i], np.uint32)
                    if np.bitwise_count(x ^ y).sum(dtype=np.int64) <= bands.bound(v["a_n"][i] + v["b_n"][i]):
                        hit.append(i)
            take = pa.array(hit, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(take), batch.column("b").take(take)], ["a", "b"])

    return _sides(pairs, lower).mapInArrow(check, "a long, b long")


def _verified(pairs: DataFrame, reps: DataFrame, bands: Bands) -> DataFrame:
    """(a, b, state) of the candidates that are linked (1) or can't be told (2)."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = {c: batch.column(c).to_pylist() for c in batch.schema.names}
            by: dict[int, list[tuple[int, bytes, bytes]]] = {}
            for i in range(len(batch)):
                common = next(((v[f"a_g{p}"][i], v[f"a_s{p}"][i], v[f"b_s{q}"][i]) for p in (1, 2) for q in (1, 2) if v[f"a_g{p}"][i] is not None and v[f"a_g{p}"][i] == v[f"b_g{q}"][i]), None)
                if common:
                    by.setdefault(common[0], []).append((i, common[1], common[2]))
            for band, rows in by.items():
                i = np.array([r[0] for r in rows])
                x, y = (np.frombuffer(b"".join(r[k] for r in rows), U).reshape(len(rows), bands.width(band)) for k in (1, 2))
                sizes = np.array([v["a_n"][k] + v["b_n"][k] for k in i])
                state = judge(x, y, sizes, band, bands)
                hit = np.flatnonzero(state)
                take = pa.array(i[hit])
                yield pa.RecordBatch.from_arrays([batch.column("a").take(take), batch.column("b").take(take), pa.array(state[hit].astype(np.int32))], ["a", "b", "state"])

    return _sides(pairs, reps).mapInArrow(check, "a long, b long, state int")


def _from_texts(docs: DataFrame, pairs: DataFrame, size: int, bands: Bands) -> DataFrame:
    """The linked ones of a few pairs, by their shingles as text."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(ids, "doc_id")

    def shingles(text: str | None) -> set[tuple[str, ...]]:
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for blank in "\t\n\x0b\x0c\r":
            low = low.replace(blank, " ")
        words = [x for x in low.split(" ") if x]
        return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = []
            for i, (x, y) in enumerate(zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)):
                p, q = shingles(x), shingles(y)
                if len(p ^ q) <= bands.bound(len(p) + len(q)) and p and q:
                    hit.append(i)
            take = pa.array(hit, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(take), batch.column("b").take(take)], ["a", "b"])

    x = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("x"))
    y = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("y"))
    return pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(compare, "a long, b long").distinct()


def _compare_blocks(bands: Bands):
    """All pairs of different components in one block, or between two, of a family and band: spanning links only."""

    def find(parent: dict[int, int], x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def compare(table: pa.Table) -> pa.Table:
        band = table["band"][0].as_py()
        t = int(bands.places[band])
        n, rep, comp, block = (table[c].to_numpy() for c in ("n", "rep", "comp", "block"))
        s = np.frombuffer(b"".join(table["sketch"].to_pylist()), U).reshape(len(n), bands.width(band))
        low = (s[:, :t] & LOW).astype(np.uint32)
        left, right = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
        parent: dict[int, int] = {}
        out = []
        step = max(1, COMPARED // (t * len(right)))
        for at in range(0, len(left), step):
            i = left[at : at + step]
            apart = np.bitwise_count(low[i][:, None] ^ low[right][None]).sum(2)
            p, q = np.nonzero((apart <= bands.bound(n[i][:, None] + n[right][None, :])) & (comp[i][:, None] != comp[right][None, :]))
            p, q = i[p], right[q]
            while len(p):
                roots = np.array([(find(parent, a), find(parent, b)) for a, b in zip(comp[p].tolist(), comp[q].tolist(), strict=True)])
                open_ = roots[:, 0] != roots[:, 1]
                p, q, roots = p[open_], q[open_], np.sort(roots[open_], 1)
                if not len(p):
                    break
                _, first = np.unique(roots, axis=0, return_index=True)
                state = judge(s[p[first]], s[q[first]], n[p[first]] + n[q[first]], band, bands)
                for k, st in zip(first, state, strict=True):
                    if st:
                        out.append((int(rep[p[k]]), int(rep[q[k]]), int(st)))
                    if st == 1:
                        parent[find(parent, int(comp[p[k]]))] = find(parent, int(comp[q[k]]))
                rest = np.ones(len(p), bool)
                rest[first] = False
                p, q = p[rest], q[rest]
        cols = list(zip(*out, strict=True)) if out else [[], [], []]
        return pa.table([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32())], names=["a", "b", "state"])

    return compare


def _within_families(member: DataFrame, bands: Bands) -> DataFrame:
    """(a, b, state): links between different components of a family."""
    each = lambda k: member.select("family", "comp", "rep", "n", F.col(f"g{k}").alias("band"), F.col(f"s{k}").alias("sketch")).where("band IS NOT NULL")
    rows = stage(each(1).unionByName(each(2)), "jaccard-members")
    sizes = rows.groupBy("family", "band").agg(F.count(F.lit(1)).alias("m"), F.countDistinct("comp").alias("comps")).where("comps > 1")
    wide = np.maximum(8 * (bands.places + 3 * bands.cells), 1)
    most = F.element_at(F.array(*[F.lit(max(1, BLOCK_BYTES // int(w))) for w in wide]), F.col("band") + 1)
    # small enough to be dealt evenly, large enough that no row is copied more than some 16 times
    held = F.least(most, F.greatest(F.lit(BLOCK_ROWS), F.ceil(F.col("m") / 16)))
    rows = rows.join(stage(sizes.select("family", "band", F.ceil(F.col("m") / held).alias("blocks")), "jaccard-sizes"), ["family", "band"])
    rows = rows.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
    return rows.drop("other", "blocks").groupBy("family", "band", "lo", "hi").applyInArrow(_compare_blocks(bands), "a long, b long, state int")


def near_duplicates(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of each row: components of links with Jaccard >= num / den.

    Rows without doc_id have their set's size, but link with nothing: their component_id is null. With num = den, the
    classes of equal sets are the components.
    """
    if not 0 < num <= den:
        raise ValueError("the threshold must be above 0 and at most 1")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = stage(_set_rows(slim, size), "jaccard-sets")
    classes = stage(sets.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep")), "jaccard-classes")
    if num < den:
        final = components(_class_links(slim, classes, size, Bands(num, den))).select(F.col("node").alias("rep"), F.col("comp").alias("component"))
        classes = classes.join(final, "rep", "left").select("n", "f1", "f2", F.coalesce("component", "rep").alias("component"))
    found = stage(classes.withColumnRenamed("rep", "component"), "jaccard-found")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return sets.join(found, ["n", "f1", "f2"], "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def _class_links(slim: DataFrame, classes: DataFrame, size: int, bands: Bands) -> DataFrame:
    """(a, b): links between classes of equal sets, enough of them to have their components."""
    total = classes.agg(F.sum("n")).first()[0] or 0
    # a sketch takes about four bytes for each shingle; a key of eight bytes comes from two shingles at least
    buckets = max(int(slim.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total * 4 / 16e6))
    bits = max(3, math.ceil(math.log2(max(1, total / 2 / 400_000))))
    reps, name = _by_rep(slim, classes, size, bands, buckets)

    pairs, last, touched = _unsettled(reps, classes.count(), bands, bits)
    # first each document with one other; then the pairs that this has left in different components
    lower = stage(_lower_halves(reps, bands), "jaccard-lower")
    hubs = stage(_near(pairs.groupBy("a").agg(F.min("b").alias("b")), lower, bands), "jaccard-near")
    links = stage(_settled(slim, hubs, reps, size, bands), "jaccard-links")
    apart = stage(_near(_apart(pairs, components(links)), lower, bands), "jaccard-near")
    links = stage(links.unionByName(_settled(slim, apart, reps, size, bands)), "jaccard-links")
    labels = components(links)
    apart = _apart(last.where("open"), labels)
    families = components(apart.select(F.col("ca").alias("a"), F.col("cb").alias("b")))

    label = labels.select(F.col("node").alias("rep"), "comp")
    member = families.select(F.col("node").alias("comp"), F.col("comp").alias("family"))
    alone = member.join(label, "comp", "left_anti").select(F.col("comp").alias("rep"), "comp", "family")
    placed = label.join(member, "comp").select("rep", "comp", "family").unionByName(alone).join(touched, "rep", "left_semi")
    placed = stage(placed, "jaccard-placed")
    more = stage(_within_families(reps.join(placed, "rep"), bands), "jaccard-more")
    links = links.unionByName(more.where("state = 1").select("a", "b"))
    unsure = more.where("state = 2")
    if unsure.limit(1).count():
        links = links.unionByName(_from_texts(slim, unsure, size, bands))
    links = stage(links, "jaccard-all")
    slim.sparkSession.sql(f"DROP TABLE {name}")  # its files go with the other intermediate tables
    return links


def _settled(docs: DataFrame, pairs: DataFrame, reps: DataFrame, size: int, bands: Bands) -> DataFrame:
    """The linked ones among candidate pairs."""
    checked = stage(_verified(pairs.select("a", "b"), reps, bands), "jaccard-checked")
    links, unsure = checked.where("state = 1").select("a", "b"), checked.where("state = 2")
    return links.unionByName(_from_texts(docs, unsure, size, bands)) if unsure.limit(1).count() else links


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose documents are in different components ca and cb."""
    at = lambda x: labels.select(F.col("node").alias(x), F.col("comp").alias(f"c{x}"))
    rows = pairs.join(at("a"), "a", "left").join(at("b"), "b", "left").select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb"))
    return stage(rows.where("ca <> cb").distinct(), "jaccard-apart")


def drop_near_duplicates(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its component, and rows without doc_id."""
    found = near_duplicates(docs, **settings)
    gone = stage(found.where("component_id <> doc_id").select("doc_id").distinct(), "jaccard-gone")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
