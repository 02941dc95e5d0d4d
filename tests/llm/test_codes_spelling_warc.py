"""Vector codes, spelling variants and WARC archives on small tables with nulls, ties, repeats, empty and long texts and clashing columns."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmuration.llm import spelling, vector_codes, warc

VECTORS = "vec_id long, embedding array<float>, label int, id long, q string, code string, near string"


def _vectors(n=900, dim=32, seed=3):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(12, dim))
    x = (middle[rng.integers(0, 12, n)] + 0.3 * rng.normal(size=(n, dim))).astype(np.float32)
    x[5] = x[6]  # ties
    rows = [(int(i), [float(v) for v in x[i]], None if i % 7 == 0 else int(i % 4), 1, "q", "c", "n") for i in rng.permutation(n)]
    bad = [(2000, None, 1), (2001, [None] + [0.0] * (dim - 1), 1), (2002, [float("nan")] * dim, 2), (2003, [float("inf")] + [1.0] * (dim - 1), None)]
    return rows + [(*b, 1, "q", "c", "n") for b in bad] + [rows[0], (None, rows[1][1], 3, 1, "q", "c", "n")]


def _plain_codes(rows, parts, entries, rounds):
    good = [(i, np.floor(256 * np.array(v, np.float64)).astype(np.int64), lab) for i, v, lab, *_ in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    order = sorted(range(len(good)), key=lambda k: (good[k][0] is None, good[k][0] or 0, good[k][1].tolist()))
    x = np.array([g[1] for g in good]).reshape(len(good), parts, -1)
    book = x[order[:entries]].transpose(1, 0, 2).copy()
    for k in range(rounds + 1):
        d = ((x[:, :, None] - book[None]) ** 2).sum(-1)
        at = d.argmin(-1)
        if k < rounds:
            for p in range(parts):
                for e in range(book.shape[1]):
                    if (at[:, p] == e).any():
                        book[p, e] = x[at[:, p] == e, p].sum(0) // (at[:, p] == e).sum()
    error = d.min(-1).sum(1)
    totals = collections.Counter()
    for g, e in zip(good, error, strict=True):
        totals[g[2]] += int(e)
    return sorted((str(g[0]), bytes(a.astype(np.uint8)).hex(), int(e), totals[g[2]]) for g, a, e in zip(good, at, error, strict=True)), book


@pytest.mark.parametrize(("parts", "entries", "rounds"), [(16, 64, 2), (4, 8, 6), (2, 1, 1), (8, 256, 0)])
def test_vector_codes(spark, parts, entries, rounds):
    rows = _vectors()
    codes = vector_codes.compress(spark.createDataFrame(rows, VECTORS).repartition(3), label_col="label", parts=parts, entries=entries, rounds=rounds)
    want, book = _plain_codes(rows, parts, entries, rounds)
    got = sorted((str(r.id), bytes(r.code).hex(), r.error, r.label_error) for r in vector_codes.with_label_error(codes).collect())
    assert got == want and (codes.codebooks == book).all()
    assert codes.digest() == hashlib.sha256(",".join(str(v) for v in book.ravel()).encode()).hexdigest()
    assert got == sorted((str(r.id), bytes(r.code).hex(), r.error, r.label_error) for r in vector_codes.with_label_error(codes, most=0).collect())
    if rounds == 6:  # bounds spare comparisons, more so as entries come to rest
        assert codes.rescans[-1] < codes.rescans[0] < len(want) * parts


def test_net_displacement_is_tighter_than_drift():
    """An entry that goes and comes back loosens no bound."""
    a, b = np.zeros((1, 2, 2), np.int64), np.full((1, 2, 2), 9, np.int64)
    moves = vector_codes.Displacement([a, b, a])
    s = {"code": np.array([[0]], np.uint8), "near": np.array([[3.0]]), "near_at": np.array([[0]]), "far": np.array([[7.0]]), "far_at": np.array([[0]])}
    upper, lower = moves.loosened(s)
    assert upper[0, 0] == 3 and lower[0, 0] == 7


def test_vector_codes_large_and_odd(spark):
    rows = [(i, [float(2**16 + i * 700 * (k + 1)) for k in range(4)], 0) for i in range(40)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    codes = vector_codes.compress(frame, label_col="label", parts=2, entries=5, rounds=3)
    want, _ = _plain_codes(rows, 2, 5, 3)
    assert sorted((str(r.id), bytes(r.code).hex(), r.error, r.label_error) for r in vector_codes.with_label_error(codes).collect()) == want
    assert vector_codes.with_label_error(vector_codes.compress(frame.limit(0), label_col="label")).collect() == []
    for wrong in ([(1, [1.0] * 4, 0), (2, [1.0] * 8, 0)], [(1, [1.0] * 3, 0)], [(1, [1e30] * 4, 0)]):
        with pytest.raises(ValueError):
            vector_codes.compress(spark.createDataFrame(wrong, "vec_id long, embedding array<double>, label int"), parts=2)


def _near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


@pytest.mark.parametrize("least", [1, 2, 5, 7])
def test_scan_against_all_pairs(least):
    rng = random.Random(least)
    for trial in range(40):
        letters = "ab" if trial % 2 else "abç"
        words = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(least, least + 4))) for _ in range(50)})
        same, half = least // 2, len(words) // 2
        want = {(a, b) for a in words for b in words if a < b and a[:same] == b[:same] and _near(a, b)}
        p, q = spelling.scan(spelling.Sorted(words), spelling.Sorted(words), same, True)
        got = [(words[i], words[j]) for i, j in zip(p, q, strict=True)]
        assert set(got) == want and len(got) == len(want)
        p, q = spelling.scan(spelling.Sorted(words[half:]), spelling.Sorted(words[:half]), same, False)
        assert {(words[j], words[half + i]) for i, j in zip(p, q, strict=True)} == {w for w in want if w[0] in words[:half] and w[1] in words[half:]}


def test_skipped_blocks_hold_no_pair():
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(7, 10))) for _ in range(1500)})
    cut = [words[i : i + 4] for i in range(0, len(words), 4)]
    met = set(spelling.meetings([(k, c[0], c[-1]) for k, c in enumerate(cut)], 3))
    all_pairs = {(i, j) for i in range(len(cut)) for j in range(i, len(cut)) if cut[j][0][:3] <= cut[i][-1][:3]}
    assert len(met) < len(all_pairs)
    for i, j in all_pairs - met:
        assert not any(_near(a, b) and a[:3] == b[:3] for a in cut[i] for b in cut[j])


def _plain_variants(rows, least=7):
    counts = collections.Counter()
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= least:
                counts[w] += 1
    counts = {w: n for w, n in counts.items() if n >= 2}
    form, near = {}, {}
    for w, n in counts.items():
        near[w] = [v for v in counts if _near(w, v)]
        if near[w]:
            best = min(near[w], key=lambda v: (-counts[v], v))
            form[w] = best if counts[best] >= 10 * n else None
    out = []
    for w, n in counts.items():
        root = w
        while form.get(root):
            root = form[root]
        f = form.get(w)
        out.append((w, f, root, n, len(near[w]), counts.get(f)))
    return sorted(out)


DOCS = "doc_id long, text string, word string, n long, key string, block int"


def _docs():
    rng = random.Random(9)
    base = ["thousand", "thousands", "whispering", "ÉCLAIRÉES", "naïvement", "letterhead", "aaaaaaaa", "aaaaaaaaa", "abababab"]
    many = {w: 400 // (k + 1) for k, w in enumerate(base)}
    words = [w for w, n in many.items() for _ in range(n)]
    for w in base:
        for _ in range(30):
            k = rng.randrange(len(w))
            words += [w[:k] + rng.choice("abçz") + w[k + rng.choice((0, 1)) :]] * rng.choice((1, 2, 3, 30))
    words += ["structure"] * 500 + ["structures"] * 40 + ["structuress"] * 3  # a chain of forms
    words += ["short", "x" * 3000, "x" * 3000, "x" * 2999 + "y", "x" * 2999 + "y", "y" + "x" * 2999, "y" + "x" * 2999]
    rng.shuffle(words)
    texts = [rng.choice((" ", ", ", "1", "\n")).join(words[i : i + 40]) for i in range(0, len(words), 40)]
    rows = [(i, t) for i, t in enumerate([None, "", *texts])]
    return [(*r, "w", 1, "k", 2) for r in [*rows, rows[3], (None, texts[0])]]


@pytest.mark.parametrize("block", [8192, 16])
def test_spelling_variants(spark, block):
    rows = _docs()
    got = spelling.group_variants(spark.createDataFrame(rows, DOCS).repartition(3), block=block).collect()
    assert sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got) == _plain_variants(rows)
    assert any(r.form and r.root != r.form for r in got)


def test_no_words(spark):
    assert spelling.group_variants(spark.createDataFrame([(1, None, "w", 1, "k", 2), (2, "a bc", "w", 1, "k", 2)], DOCS)).collect() == []
    assert spelling.group_variants(spark.createDataFrame([], DOCS)).collect() == []


PAGES = "page_id long, url string, html string, file string, at long, type string, sha string"


def _pages():
    fake = "WARC/1.1\r\nWARC-Type: response\r\nX-Page-Id: 77\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    html = [None, "", "one", "one", "é" * 70_000, fake, "a\r\n\r\n" + fake, fake + fake + "tail", "x WARC/1.1\r\ny", "WARC/1.1\r\n" * 50, fake[:-2], "\r\n\r\n" + fake + "\r\n\r\n", "WARC/1.1", "\r\n\r\nWARC/1.1\r\nContent-Length: 99999\r\n\r\n", "one"]
    rows = [(i, f"http://example.org/{i}?WARC/1.1\r\n%", h) for i, h in enumerate(html)]
    rows += [rows[14], rows[14], (14, None, "one"), (None, "u", "one"), (None, None, "alone"), (50, "u", fake * 40), (51, "u", fake * 40)]
    return [(*r, "f", 1, "t", "s") for r in rows]


def _plain_records(rows, least=0):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[2] or ""].append(r[0])
    out = []
    for html, ids in groups.items():
        data = html.encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        first = max(ids, key=lambda i: (i is not None, i or 0))
        answered = False
        for i in ids:
            again = len(data) >= least and (i != first or answered)
            answered |= i == first
            out.append((str(i), len(data), digest, "revisit" if again else "response", str(first) if again else "None"))
    return sorted(out)


@pytest.mark.parametrize(("least", "per_file", "split"), [(0, 4096, "128m"), (4, 3, "6k")])
def test_warc_round_trip(spark, least, per_file, split):
    """Payloads full of the magic and of whole records, in one byte range and in many."""
    rows = _pages()
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        frame = spark.createDataFrame(rows, PAGES).repartition(2)
        records = warc.archive(frame, least, per_file, payloads=True)
        kept = {r.page: bytes(r.payload).decode() for r in records.where("type = 'response'").collect()}
        assert all(kept[str(i)] == (h or "") for i, _, h, *_ in rows if str(i) in kept and [r[0] for r in rows].count(i) == 1)
        assert records.where("type = 'response' AND declared <> concat('sha1:', sha1)").count() == 0
        for again in (records, warc.archive(frame, least, per_file)):
            got = warc.resolved(again).collect()
            assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in got) == _plain_records(rows, least)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)


def test_warc_broken_and_empty(spark, tmp_path):
    assert warc.resolved(warc.archive(spark.createDataFrame([], PAGES))).collect() == []
    path = tmp_path / "broken"
    path.mkdir()
    head = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\n"
    (path / "a.warc").write_text(head + "abc\r\n\r\n" + head + "ab\r\n\r\n", newline="")
    with pytest.raises(ValueError, match=r"a\.warc"):
        warc.read_archives(spark, f"file://{path}")
    (path / "a.warc").write_text(head + "abc\r\n\r\n" + head + "def\r\n\r\n", newline="")
    assert [bytes(r.payload) for r in warc.read_archives(spark, f"file://{path}").orderBy("at").collect()] == [b"abc", b"def"]


def test_pointer_jumping(spark):
    chain = [("f", 7 * i, 7 * (i + 1)) for i in range(45)] + [("f", 7 * i + 3, 7 * (i + 2)) for i in range(40)] + [("g", 5, 9)]
    got = warc.reached(spark.createDataFrame(chain, "file string, at long, to long"))
    assert sorted(r.at for r in got.where(F.col("file") == "f").collect()) == [7 * i for i in range(45)]
    assert got.where("file = 'g'").count() == 0
