"""Packing documents into token sequences: shortest-pack-first over the length histogram.

Tokens: the texts of a batch are cut into pre-tokens by array operations on code points; every distinct pre-token is
encoded once by the ``tokenizers`` library and the ids are gathered, so the result is what the library returns for the
whole text. Texts that contain an added token of the vocabulary are encoded whole by the library. A document is its ids and a closing 0. It is cut at every ``width`` tokens; the rest is one shorter piece.

Placing: the histogram of piece lengths (``width`` numbers) goes to the driver. Lengths are placed longest first, each
into the shortest pack that has room, many packs of one pattern at a time, by counts alone. Pieces get a rank within
their length from two-level counting (hashed buckets, so that a common length is never in one task) and find their
place by joining the pattern ranges on length and rank.

Defined results: null text is empty: the piece of one 0. Rows that repeat a doc_id are separate documents. An empty
table gives an empty result.
"""

from __future__ import annotations

import itertools
import math
import os
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import stage
from .words import BASE, bytes_of, chunks, mix64, powers

WIDTH = 1024
OTHER, LETTER, NUMBER, BLANK = 0, 1, 2, 3
#: White space of the pre-token pattern (fixed values: the Unicode White_Space property).
BLANKS = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Byte-level BPE of whole texts, distinct pre-tokens at a time."""

    def __init__(self, path: str, known: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), known
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        kinds = {"L": LETTER, "N": NUMBER}
        self.classes = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
        self.classes[list(BLANKS)] = BLANK
        self.forget()

    def forget(self) -> None:
        self.place: dict[int, int] = {}
        self.starts, self.lengths, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def cuts(self, c: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where pre-tokens start; ``first`` marks the first code point of each text."""
        n = len(c)
        kind = self.classes[c]
        run = first.copy()
        run[1:] |= kind[1:] != kind[:-1]
        blank = kind == BLANK
        start = run.copy()
        after = np.zeros(n, bool)  # the last of some blanks, with a text going on behind it
        after[:-1] = blank[:-1] & ~blank[1:] & ~first[1:]
        start |= after
        joined = np.zeros(n, bool)
        joined[1:] = after[:-1] & (c[:-1] == 0x20)
        start &= ~joined
        # 's 't 'm 'd 're 've 'll, where the apostrophe starts a pre-token
        quote = np.flatnonzero((c == 0x27) & start)
        if len(quote):
            ends = np.concatenate([np.flatnonzero(first)[1:], [n]])
            room = ends[np.searchsorted(ends, quote, "right")] - quote
            one, two = c[np.minimum(quote + 1, n - 1)], c[np.minimum(quote + 2, n - 1)]
            short = (room > 1) & np.isin(one, [ord(x) for x in "stmd"])
            long = (room > 2) & ((np.isin(one, [ord("r"), ord("v")]) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
            for which, size in ((short, 2), (long, 3)):
                at = quote[which]
                start[at + 1] = False
                start[at[room[which] > size] + size] = True
        return np.flatnonzero(start)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some texts, and the n + 1 offsets of the texts among them."""
        odd = np.zeros(len(column), bool)
        for content in self.added:
            odd |= pc.fill_null(pc.match_substring(column, content), False).to_numpy(zero_copy_only=False)
        if not odd.any():
            return self.encode_plain(column)
        ids, offsets = self.encode_plain(pc.if_else(pa.array(odd), pa.scalar("", column.type), column))
        parts = np.split(ids, offsets[1:-1])
        at = np.flatnonzero(odd)
        for i, e in zip(at.tolist(), self.tokenizer.encode_batch(column.take(pa.array(at)).to_pylist(), add_special_tokens=False), strict=True):
            parts[i] = np.asarray(e.ids, np.uint32)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])

    def encode_plain(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for texts without added tokens."""
        raw, offsets = bytes_of(column)
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        text = raw.tobytes().decode()
        c = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        begin = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[offsets]
        first = np.zeros(len(c), bool)
        first[begin[:-1][begin[:-1] < len(c)]] = True
        cuts = self.cuts(c, first)
        lengths = np.diff(np.concatenate([cuts, [len(c)]]))
        place = np.arange(len(c)) - np.repeat(cuts, lengths)
        h = mix64(np.add.reduceat((c.astype(np.uint64) + np.uint64(1)) * powers(int(lengths.max()))[place], cuts) * BASE + lengths.astype(np.uint64))
        keys, at, back = np.unique(h, return_index=True, return_inverse=True)
        if len(self.place) > self.known:
            self.forget()
        slots = [self.place.get(k, -1) for k in keys.tolist()]
        new = [i for i, s in enumerate(slots) if s < 0]
        if new:
            got = [e.ids for e in self.tokenizer.encode_batch([text[cuts[at[i]] : cuts[at[i]] + lengths[at[i]]] for i in new], add_special_tokens=False)]
            sizes = np.fromiter(map(len, got), np.int64, len(got))
            base = len(self.starts)
            self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(sizes) - sizes])
            self.lengths = np.concatenate([self.lengths, sizes])
            self.pool = np.concatenate([self.pool, np.fromiter((x for ids in got for x in ids), np.uint32, int(sizes.sum()))])
            for j, i in enumerate(new):
                slots[i] = base + j
            self.place.update(zip(keys[new].tolist(), range(base, base + len(new)), strict=True))
        slot = np.asarray(slots)[back]
        size = self.lengths[slot]
        ends = np.cumsum(size)
        ids = self.pool[np.repeat(self.starts[slot] - (ends - size), size) + np.arange(int(ends[-1]))]
        return ids, np.concatenate([[0], ends])[np.searchsorted(cuts, begin)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each Python worker and vocabulary."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, path: str, width: int = WIDTH, keep_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of each piece, and its ids if asked for."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for whole in batches:
            for batch in chunks(whole):
                flat, offsets = e.encode(batch.column("text"))
                tokens = np.diff(offsets) + 1
                ends = np.cumsum(tokens)
                ids = np.zeros(int(ends[-1]), np.uint32)
                ids[np.arange(len(flat)) + np.repeat(np.arange(len(tokens)), tokens - 1)] = flat
                parts = -(-tokens // width)
                doc = np.repeat(np.arange(len(tokens)), parts)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)) * width
                length = np.minimum(tokens[doc] - start, width)
                begin = (ends - tokens)[doc] + start
                little = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(little[4 * a : 4 * b]) for a, b in zip(begin.tolist(), (begin + length).tolist(), strict=True)]
                columns = [batch.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(tokens[doc])]
                if keep_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if keep_ids else [])]
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * keep_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, schema)


def shortest_pack_first(histogram: dict[int, int], width: int = WIDTH) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how many packs have each: lengths longest first, into the shortest pack with room."""
    open_: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)  # by what a pack holds
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        for held in sorted(k for k in open_ if k + length <= width):
            for pattern in sorted(open_[held]):
                if not left:
                    break
                n = min(left, open_[held][pattern])
                open_[held][pattern] -= n
                if not open_[held][pattern]:
                    del open_[held][pattern]
                to = open_[held + length]
                longer = (*pattern, length)
                to[longer] = to.get(longer, 0) + n
                left -= n
            if not open_[held]:
                del open_[held]
        while left:
            # packs of this length alone: as many of it as fit go together
            fit = min(width // length, left)
            n = left // fit
            pattern = (length,) * fit
            open_[length * fit][pattern] = open_[length * fit].get(pattern, 0) + n
            left -= n * fit
    return sorted((p, n) for group in open_.values() for p, n in group.items())


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, first offset, packs) of each run of one length in each pattern.

    A step of ``shortest_pack_first`` adds at most three patterns for a length, and a pattern has at most some sqrt(2 * width)
    different lengths: the table has a bound that the corpus doesn't move.
    """
    out, rank, sequence = [], defaultdict(int), 0
    for pattern, n in patterns:
        offset = 0
        for length, run in itertools.groupby(pattern):
            m = len(list(run))
            out.append((length, rank[length], rank[length] + n * m, sequence, offset, n))
            rank[length] += n * m
            offset += length * m
        sequence += n
    return out


def pack(docs: DataFrame, path: str | None = None, width: int = WIDTH, keep_ids: bool = False) -> DataFrame:
    """Pieces with their sequence_id and offset."""
    spark = docs.sparkSession
    rows = stage(pieces(docs, path or default_vocabulary(), width, keep_ids), "pack-pieces")
    buckets = 1 << min(12, max(4, math.ceil(math.log2(max(1, rows.count() / 8192)))))
    bucket = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)).alias("bucket")
    counts = stage(rows.groupBy("length", bucket).agg(F.count(F.lit(1)).alias("n")), "pack-counts")
    # at most ``width`` rows come to the driver
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = slots(shortest_pack_first(histogram, width))
    names = ("length", "first", "end", "sequence", "offset", "packs")
    schema = ", ".join(f"{n} long" for n in names)
    table = stage(spark.createDataFrame(pa.table(dict(zip(names, map(list, zip(*places, strict=True)), strict=True))) if places else [], schema), "pack-patterns")

    upto = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = stage(counts.select("length", "bucket", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("base")), "pack-ranks")
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = rows.withColumn("bucket", bucket).withColumn("inner", F.row_number().over(within) - 1)
    ranked = ranked.join(base.hint("merge"), ["length", "bucket"]).withColumn("rank", F.col("base") + F.col("inner"))
    # the pieces lie by length and bucket for their ranks: the merge join moves them no further. The patterns are bounded
    placed = ranked.join(F.broadcast(table), "length").where((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end")))
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("sequence") + (F.col("rank") - F.col("first")) % F.col("packs")).alias("sequence_id"),
        (F.col("offset") + F.expr("(rank - first) div packs") * F.col("length")).alias("offset"), *(["ids"] if keep_ids else []),
    )
