"""Substring dedup: Rabin-Karp hashes of every window of ``size`` words, counted in Spark, merged into intervals.

Counting every window of a corpus moves eight bytes and more for each word, so it goes in two rounds:

1. Each window is named by its minimiser, the least hash of the short word runs in it. Neighbouring windows mostly share
   one, so there are few; windows of equal words have equal minimisers. A minimiser met in one document only rules out
   all its windows.
2. The other windows are counted by their own hash: one that also starts in a document with a smaller id is marked, and
   the marked windows of a document merge into maximal intervals of words to remove.

The first round's hashes have 64 bits: one met by chance in two documents lets a window through that the second round then
rules out. The second round compares 128 bits, from two hashes of every word that share nothing.

Hashes travel sorted, in blobs per map batch and key range, with byte planes compressed; a batch sends each hash once,
with its smallest document, and settles the others itself, so a passage in a third of all documents is no hot key. The
texts are dealt by document once; both joins read the same exchange.

Defined results: null or short text has no windows and loses nothing. A row without doc_id holds no windows and loses
nothing. Rows that repeat a doc_id are one document: what is marked for one is marked for each. 128-bit fingerprints stand
for words: among N windows about N*N/2**129 pairs of different ones would be taken as equal.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import OTHER, Words, chunks, mix64

PACKED = "bucket int, marks binary, blob binary"
MARKED = "part int, marks binary"


def _planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _unplanes(data: bytes, n: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, n).T).view(kind).ravel()


def encode(hashes: Sequence[np.ndarray], doc: np.ndarray, pos: np.ndarray) -> bytes:
    ids, back = np.unique(doc, return_inverse=True)
    head = np.array([len(doc), len(ids), len(hashes)], np.int64).tobytes()
    steps = np.diff(ids, prepend=0)
    return zstandard.compress(head + b"".join(map(_planes, hashes)) + _planes(steps) + _planes(back.astype(np.uint32)) + _planes(pos.astype(np.uint32)), 1)


def decode(blob: bytes) -> tuple[np.ndarray, ...]:
    """The hashes, the documents and the positions."""
    raw = zstandard.decompress(blob)
    n, m, k = np.frombuffer(raw[:24], np.int64)
    at = np.cumsum([24, *[8 * n] * int(k), 8 * m, 4 * n, 4 * n])
    part = [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    ids = np.cumsum(_unplanes(part[-3], m, np.int64))
    return *(_unplanes(x, n, np.uint64) for x in part[:-3]), ids[_unplanes(part[-2], n, np.uint32)], _unplanes(part[-1], n, np.uint32).astype(np.int32)


def encode_marks(doc: np.ndarray, pos: np.ndarray) -> bytes:
    ids, back = np.unique(doc, return_inverse=True)
    head = np.array([len(doc), len(ids)], np.int64).tobytes()
    return zstandard.compress(head + _planes(np.diff(ids, prepend=0)) + _planes(back.astype(np.uint32)) + _planes(pos.astype(np.uint32)), 1)


def decode_marks(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.decompress(blob)
    n, m = np.frombuffer(raw[:16], np.int64)
    ids = np.cumsum(_unplanes(raw[16 : 16 + 8 * m], m, np.int64))
    return ids[_unplanes(raw[16 + 8 * m : 16 + 8 * m + 4 * n], n, np.uint32)], _unplanes(raw[16 + 8 * m + 4 * n :], n, np.uint32).astype(np.int32)


def settle(hashes: Sequence[np.ndarray], doc: np.ndarray, shared: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by hash, which entries are marked, and which is the first of its hash in that order.

    Entries are equal if all their hashes are. An entry is marked if it is also in a smaller document, or with ``shared``
    if it is in another one.
    """
    order = np.lexsort((doc, *reversed(hashes)))
    hashes, doc = [h[order] for h in hashes], doc[order]
    lead = np.ones(len(doc), bool)
    lead[1:] = np.any([h[1:] != h[:-1] for h in hashes], axis=0)
    edge = np.flatnonzero(lead)
    run = np.diff(np.concatenate([edge, [len(doc)]]))
    marked = doc > np.repeat(doc[edge], run)
    if shared and len(doc):
        marked = np.repeat(np.maximum.reduceat(marked, edge), run)
    return order, marked, lead


def _packed(hashes: Sequence[np.ndarray], doc: np.ndarray, pos: np.ndarray, bits: int, shared: bool) -> Iterator[pa.RecordBatch]:
    """Blobs of a batch per key range, and what the batch could mark by itself."""
    order, marked, lead = settle(hashes, doc, shared)
    hashes, doc, pos = [h[order] for h in hashes], doc[order], pos[order]
    # a marked entry needs no answer; each hash is sent once, or for all runs of the one document that holds it
    if marked.any():
        bucket = int(mix64(doc[:1].view(np.uint64))[0] >> np.uint64(64 - bits))
        yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([encode_marks(doc[marked], pos[marked])]), pa.nulls(1, pa.binary())], ["bucket", "marks", "blob"])
    send = ~marked | lead
    hashes, doc, pos = [h[send] for h in hashes], doc[send], pos[send]
    if not len(doc):
        return
    key = (hashes[0] >> np.uint64(64 - bits)).astype(np.int64)
    cuts = np.searchsorted(key, np.arange((1 << bits) + 1))
    for b in np.flatnonzero(np.diff(cuts)):
        s = slice(cuts[b], cuts[b + 1])
        yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.nulls(1, pa.binary()), pa.array([encode([h[s] for h in hashes], doc[s], pos[s])])], ["bucket", "marks", "blob"])


def _counted(shared: bool, parts: int) -> Callable[[pa.Table], pa.Table]:
    """Marks of one key range, a blob for each part of the documents."""

    def count(table: pa.Table) -> pa.Table:
        held = [decode(b) for b in table["blob"].to_pylist() if b is not None]
        found = [decode_marks(b) for b in table["marks"].to_pylist() if b is not None]
        if held:
            *hashes, doc, pos = (np.concatenate(x) for x in zip(*held, strict=True))
            order, marked, _ = settle(hashes, doc, shared)
            found.append((doc[order][marked], pos[order][marked]))
        doc, pos = (np.concatenate(x) for x in zip(*found, strict=True))
        part = (mix64(doc.view(np.uint64)) >> np.uint64(32)).astype(np.int64) % parts
        order = np.argsort(part, kind="stable")
        doc, pos, part = doc[order], pos[order], part[order]
        cuts = np.searchsorted(part, np.arange(parts + 1))
        filled = np.flatnonzero(np.diff(cuts))
        blobs = [encode_marks(doc[cuts[p] : cuts[p + 1]], pos[cuts[p] : cuts[p + 1]]) for p in filled]
        return pa.table([pa.array(filled.astype(np.int32)), pa.array(blobs, pa.binary())], names=["part", "marks"])

    return count


def _collected(table: pa.Table) -> pa.Table:
    """One row per document of a part with its marks."""
    doc, pos = (np.concatenate(x) for x in zip(*map(decode_marks, table["marks"].to_pylist()), strict=True))
    order = np.argsort(doc, kind="stable")
    doc, pos = doc[order], pos[order]
    edge = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([edge, [len(doc)]]).astype(np.int32)), pa.array(pos))
    return pa.table([pa.array(doc[edge]), lists], names=["__id", "marks"])


def windows_of(column: pa.Array, size: int, short: int) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words, the hash and first word of each window, and the minimiser of each window."""
    w = Words(column)
    h = w.hashes()
    hashes, at = w.windows(h, size)
    grams, place = w.windows(h, short)
    full = np.full(len(h), np.iinfo(np.uint64).max, np.uint64)
    full[place] = grams
    least = np.full(len(at), np.iinfo(np.uint64).max, np.uint64)
    for j in range(size - short + 1):
        np.minimum(least, full[at + j], out=least)
    return w, hashes, at, least


def _runs(w: Words, at: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text of each window, and which windows begin a run of one minimiser."""
    doc = w.docs()[at]
    begin = np.ones(len(at), bool)
    begin[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
    return doc, begin


def kept_words(column: pa.Array, marks: list[np.ndarray | None], size: int) -> Iterator[tuple[int, int, str, list[tuple[int, int]]]]:
    """For each text: its number of words, of removed ones, the text of the others, and the removed intervals."""
    w = Words(column)
    raw = w.data.tobytes()
    for i, mark in enumerate(marks):
        a, b = w.bounds[i], w.bounds[i + 1]
        cover = np.zeros(b - a + 1, np.int32)
        if mark is not None and len(mark):
            np.add.at(cover, mark, 1)
            np.add.at(cover, np.minimum(mark + size, b - a), -1)
        gone = np.cumsum(cover)[:-1] > 0
        keep = np.flatnonzero(~gone) + a
        text = b" ".join([raw[s:e] for s, e in zip(w.starts[keep].tolist(), w.ends[keep].tolist(), strict=True)]).decode()
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
        yield int(b - a), int(gone.sum()), text, list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def substring_dedup(docs: DataFrame, size: int = 13, short: int = 7, per_task: int = 2_000_000, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, removed (intervals of words) and kept_text, or its sha256 with ``digest``."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total, rows = texts.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    total, parts = total or 0, max(16, math.ceil(rows / 4096))
    wide = math.ceil(math.log2(max(1, total / 6 / per_task)))
    bits = max(3, wide - 2)  # minimisers are about a quarter of the windows

    def first_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            held = []
            for batch in chunks(whole):
                w, _, at, least = windows_of(batch.column("text"), size, short)
                doc, begin = _runs(w, at, least)
                ids = batch.column("doc_id").to_numpy(zero_copy_only=False)[doc]
                held.append((least[begin], ids[begin], (at - w.bounds[doc])[begin]))
            if held:
                h, doc, pos = (np.concatenate(x) for x in zip(*held, strict=True))
                yield from _packed([h], doc, pos, bits, True)

    def by_document(packed: DataFrame, shared: bool) -> DataFrame:
        marks = packed.groupBy("bucket").applyInArrow(_counted(shared, parts), MARKED)
        return marks.groupBy("part").applyInArrow(_collected, "__id long, marks array<int>")

    shared = by_document(texts.where("doc_id IS NOT NULL").mapInArrow(first_round, PACKED), True)
    # rows without doc_id meet no marks: a second key spreads them
    texts = texts.withColumn("spread", F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("text"), F.lit(1 << 20)) + 1).otherwise(F.lit(0)).cast("long"))
    same = (F.col("doc_id") == F.col("__id")) & (F.col("spread") == F.col("zero"))
    near = texts.join(shared.withColumn("zero", F.expr("pmod(__id, 1L)")), same, "left").select("doc_id", "text", "marks")

    def second_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            whole = whole.filter(whole.column("marks").is_valid())
            held = []
            for batch in chunks(whole):
                w, hashes, at, least = windows_of(batch.column("text"), size, short)
                doc, begin = _runs(w, at, least)
                ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
                marks = batch.column("marks")
                flat, ends = marks.flatten().to_numpy(zero_copy_only=False), np.diff(marks.offsets.to_numpy())
                first = np.zeros(len(w.starts) + 1, bool)
                first[np.repeat(w.bounds[:-1], ends) + flat] = True
                take = (first[at] & begin)[np.flatnonzero(begin)][np.cumsum(begin) - 1]
                again, _ = w.windows(w.hashes(OTHER), size, OTHER)
                held.append((hashes[take], again[take], ids[doc][take], (at - w.bounds[doc])[take]))
            if held:
                h, more, doc, pos = (np.concatenate(x) for x in zip(*held, strict=True))
                yield from _packed([h, more], doc, pos, max(3, wide), False)

    found = by_document(near.mapInArrow(second_round, PACKED), False)
    joined = texts.join(found.withColumn("zero", F.expr("pmod(__id, 1L)")), same, "left").select("doc_id", "text", "marks")

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole):
                marks = [None if m is None else np.unique(np.asarray(m, np.int64)) for m in batch.column("marks").to_pylist()]
                rows = list(kept_words(batch.column("text"), marks, size))
                text = [hashlib.sha256(r[2].encode()).hexdigest() if digest else r[2] for r in rows]
                spans = pa.array([[{"start": a, "end": b} for a, b in r[3]] for r in rows], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), spans, pa.array(text, pa.string())], ["doc_id", "n_words", "n_removed", "removed", last])

    last = "kept_sha256" if digest else "kept_text"
    return joined.mapInArrow(removed, f"doc_id long, n_words long, n_removed long, removed array<struct<start:int,end:int>>, {last} string")
