"""Product codes for vectors: k-means for each part, with norm-of-sum bounds before exact rescans.

A vector becomes integers, floor(scale * x), cut into equal consecutive parts; each part is coded by the nearest entry of
its codebook. From round to round every (row, part) keeps its entry, an upper bound of the distance to it and a lower bound
of the distance to all others, each stamped with the round in which it was measured. The driver keeps all codebooks so
far (rounds * entries * length integers, whatever the number of rows), so a bound of round s is loosened in round t by the
entry's net displacement between s and t, which is never more than the sum of its moves and often far less. Where the
loosened bounds still part, the entry stays; else the upper bound is measured again; only then are all entries compared.

Distances are integers, so ties go to the lower index exactly. Bounds are kept as 32-bit floats, rounded outwards.

Defined results: vectors that are null or hold null or non-finite components have no row. Rows that repeat an id are coded
each by itself; rows without an id come last in the order that picks the first entries (equal ids by their integers). With
fewer rows than entries there are as many entries as rows. An empty table gives an empty result. Vectors of different
lengths, lengths that ``parts`` doesn't divide and components beyond 2**26 after scaling are errors. Other columns take
no part, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import stage

LARGEST = 1 << 26
BOUNDS = {"code": np.uint8, "near": np.float32, "near_at": np.uint8, "far": np.float32, "far_at": np.uint8}
SLACK = 1e-6  # of a distance: far above the rounding of square roots, far below what bounds differ by


@dataclass
class Codes:
    """``rows``: id, label, code (a byte for each part) and error (squared distance); ``codebooks`` of shape (parts, entries, length of a part)."""

    rows: DataFrame
    codebooks: np.ndarray
    rescans: list[int]  # of each round after the first: how many (row, part) compared all entries

    def digest(self) -> str:
        """SHA-256 of all components as decimals, by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.codebooks.ravel().tolist())).encode()).hexdigest()


def integers(vectors: DataFrame, id_col: str, vector_col: str, label_col: str | None, scale: float) -> DataFrame:
    """(id, label, q) of the rows whose vector is whole and finite."""
    x = F.col(vector_col)
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    label = F.col(label_col) if label_col else F.lit(None).cast("string")
    kept = vectors.where(x.isNotNull() & ~F.coalesce(odd, F.lit(False)))
    return kept.select(F.col(id_col).cast("long").alias("id"), label.alias("label"), F.transform(x, lambda v: F.floor(v.cast("double") * F.lit(float(scale)))).alias("q"))


class Displacement:
    """How far each entry is from where it was in each earlier round, and the farthest move of all entries but one."""

    def __init__(self, history: list[np.ndarray]):
        now = history[-1]
        moved = np.array([np.sqrt(((now - old).astype(np.float64) ** 2).sum(-1)) for old in history])  # round, part, entry
        self.moved = moved
        self.most_at = moved.argmax(-1)
        rest = moved.copy()
        np.put_along_axis(rest, self.most_at[..., None], 0.0, -1)
        self.most, self.second = moved.max(-1), rest.max(-1)

    def loosened(self, s: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Upper and lower bounds of all (row, part) as of now."""
        part = np.arange(s["code"].shape[1])[None]
        far_at, code = s["far_at"], s["code"]
        others = np.where(self.most_at[far_at, part] == code, self.second[far_at, part], self.most[far_at, part])
        return s["near"] + self.moved[s["near_at"], part, code], s["far"] - others


def _apart(upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
    return upper * (1 + SLACK) + SLACK < lower * (1 - SLACK)


def _nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entry (ties to the lower index), its squared distance, and the squared distance of the next one."""
    d2 = (x * x).sum(1)[:, None] - 2 * (x @ book.T) + (book * book).sum(1)[None]
    at = d2.argmin(1)
    least = d2[np.arange(len(x)), at]
    if d2.shape[1] == 1:
        return at, least, np.full(len(x), np.inf)
    d2[np.arange(len(x)), at] = np.iinfo(np.int64).max if d2.dtype.kind == "i" else np.inf
    return at, least, d2.min(1)


def _state(batch: pa.RecordBatch, parts: int) -> dict[str, np.ndarray]:
    out = {}
    for name, kind in BOUNDS.items():
        column = batch.column(name)
        first = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2], np.uint8)[first[0] : first[-1]] if len(column) else np.zeros(0, np.uint8)
        out[name] = data.view(kind).reshape(len(column), parts).copy()
    return out


def _binary(values: np.ndarray) -> pa.Array:
    wide = values.shape[1] * values.itemsize
    offsets = np.arange(len(values) + 1, dtype=np.int32) * wide
    return pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def assign(x: np.ndarray, old: dict[str, np.ndarray] | None, book: np.ndarray, moves: Displacement | None, now: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The state of rows ``x`` (rows, parts, length) after an assignment in round ``now``, and how many parts of each row compared all entries."""
    n, parts, _ = x.shape
    if old is None:
        s = {k: np.zeros((n, parts), kind) for k, kind in BOUNDS.items()}
        open_ = np.ones((n, parts), bool)
    else:
        s = old
        upper, lower = moves.loosened(s)
        open_ = ~_apart(upper, lower)
        row, part = np.nonzero(open_)
        gap = x[row, part] - book[part, s["code"][row, part]]
        exact = np.sqrt((gap * gap).sum(1).astype(np.float64))
        s["near"][row, part] = np.nextafter(exact.astype(np.float32), np.float32(np.inf))
        s["near_at"][row, part] = now
        open_[row, part] = ~_apart(exact, lower[row, part])
    for part in range(parts):
        row = np.flatnonzero(open_[:, part])
        if len(row):
            at, near, far = _nearest(x[row, part], book[part])
            s["code"][row, part], s["near_at"][row, part], s["far_at"][row, part] = at, now, now
            s["near"][row, part] = np.nextafter(np.sqrt(near.astype(np.float64)).astype(np.float32), np.float32(np.inf))
            s["far"][row, part] = np.nextafter(np.sqrt(far.astype(np.float64)).astype(np.float32), np.float32(0))
    return s, open_.sum(1)


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = None, parts: int = 16, entries: int = 64, rounds: int = 2, scale: float = 256.0) -> Codes:
    """Codebooks after ``rounds`` rounds of assignment and floored means, and the codes of a last assignment."""
    if not 0 < entries <= 256 or not 0 <= rounds < 256 or parts < 1:
        raise ValueError("entries go to 256, rounds to 255, and there is a part at least")
    rows = stage(integers(vectors, id_col, vector_col, label_col, scale), "codes-vectors")
    kind = rows.schema["label"].dataType.simpleString()
    size = F.array_max(F.transform("q", lambda v: F.abs(v)))
    stats = rows.agg(F.count(F.lit(1)), F.min(F.size("q")), F.max(F.size("q")), F.max(size)).first()
    if not stats[0] or not stats[2]:
        return Codes(rows.limit(0).select("id", "label", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error")), np.zeros((parts, 0, 0), np.int64), [])
    if stats[1] != stats[2] or stats[2] % parts:
        raise ValueError(f"vectors have {stats[1]} to {stats[2]} components; they need one length that {parts} divides")
    if stats[3] > LARGEST:
        raise ValueError(f"a scaled component is beyond {LARGEST}")
    wide = stats[2] // parts
    # products and sums of the expanded square stay whole numbers in doubles below 2**53
    number = np.float64 if 4 * wide * stats[3] ** 2 < 1 << 53 else np.int64
    first = rows.orderBy(F.col("id").asc_nulls_last(), "q").limit(entries).select("q").collect()
    history = [np.array([r.q for r in first], np.int64).reshape(len(first), parts, wide).transpose(1, 0, 2)]
    spark, rescans = vectors.sparkSession, []
    count = history[0].shape[1]
    bounds = ", ".join(f"{n} binary" for n in BOUNDS)
    names = ["id", "label", "q", *BOUNDS, "scans", "slot", "n", "sums"]
    schema = f"id long, label {kind}, q array<bigint>, {bounds}, scans int, slot int, n long, sums array<bigint>"
    for now in range(rounds + 1):
        sent = spark.sparkContext.broadcast((history[-1].astype(number), Displacement(history)))
        last = now == rounds

        def run(batches: Iterator[pa.RecordBatch], now=now, sent=sent, last=last) -> Iterator[pa.RecordBatch]:
            book, moves = sent.value
            held, total = np.zeros((parts, count), np.int64), np.zeros((parts, count, wide), np.int64)
            labels = None
            for whole in batches:
                for at in range(0, len(whole), 4096):
                    b = whole.slice(at, 4096)
                    labels = b.column("label").type
                    q = b.column("q").flatten().to_numpy(zero_copy_only=False).reshape(len(b), parts, wide)
                    x = q.astype(number)
                    s, scans = assign(x, _state(b, parts) if now else None, book, moves, now)
                    if last:
                        gap = q - book.astype(np.int64)[np.arange(parts)[None], s["code"]]
                        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), _binary(s["code"]), pa.array((gap * gap).sum((1, 2))), pa.array(scans.astype(np.int32))], ["id", "label", "code", "error", "scans"])
                        continue
                    for part in range(parts):
                        held[part] += np.bincount(s["code"][:, part], minlength=count)
                        for k in range(wide):  # sums of a batch are whole numbers far below 2**53
                            total[part, :, k] += np.bincount(s["code"][:, part], q[:, part, k], count).astype(np.int64)
                    nulls = [pa.nulls(len(b), t) for t in (pa.int32(), pa.int64(), pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), b.column("q"), *[_binary(s[k]) for k in BOUNDS], pa.array(scans.astype(np.int32)), *nulls], names)
            if labels is not None and not last:
                m = parts * count
                empty = [pa.nulls(m, t) for t in (pa.int64(), labels, pa.list_(pa.int64()), *[pa.binary()] * len(BOUNDS), pa.int32())]
                sums = pa.ListArray.from_arrays(np.arange(m + 1, dtype=np.int32) * wide, total.ravel())
                yield pa.RecordBatch.from_arrays([*empty, pa.array(np.arange(m, dtype=np.int32)), pa.array(held.ravel()), sums], names)

        if last:
            rows = stage(rows.mapInArrow(run, f"id long, label {kind}, code binary, error long, scans int"), "codes")
        else:
            # one table holds the rows and, with a slot, what each task has summed
            both = stage((rows if now else rows.select("id", "label", "q")).mapInArrow(run, schema), "codes-round")
            sums = both.where("slot IS NOT NULL").groupBy("slot").agg(F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(k))).alias(f"s{k}") for k in range(wide)])
            book = history[-1].copy()
            for r in sums.where("n > 0").collect():  # parts * entries rows
                book[r.slot // count, r.slot % count] = np.array([r[f"s{k}"] for k in range(wide)], np.int64) // r.n
            history.append(book)
            rows = both.where("slot IS NULL").select("id", "label", "q", *BOUNDS, "scans")
        if now:
            rescans.append(rows.agg(F.sum("scans")).first()[0])
    return Codes(rows.drop("scans"), history[-1], rescans)


def with_label_error(codes: Codes, most: int = 100_000) -> DataFrame:
    """The rows with label_error, the sum of errors over equal labels (nulls together). Up to ``most`` labels are broadcast, more meet in a join by label."""
    totals = stage(codes.rows.groupBy("label").agg(F.sum("error").alias("label_error")), "codes-labels")
    named = totals.withColumnRenamed("label", "__label")
    small = totals.count() <= most
    return codes.rows.join(F.broadcast(named) if small else named, F.col("label").eqNullSafe(F.col("__label"))).drop("__label")
