"""Mixing against a rebuild in plain Python, and the splitting tree against the distribution it draws from."""

import math
import re
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from murmuration.llm import mixing

from .test_llm import DOCS, _texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def rows():
    sources = ["b", "a", None, "é", "zz", ""]
    out = [(i * 3, t, "en", sources[i % 6 if i % 5 else 0], len(t or ""), 1, "k", 2, "z") for i, t in enumerate(_texts())]
    return [*out, (None, out[5][1], "en", "a", 1, 1, "k", 2, "z"), (None, None, "en", None, 1, 1, "k", 2, "z"), out[5], out[5], out[-1]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


def _targets(sizes, cap=3):
    """Rounds of sharing by weight, in fractions; sizes by source."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight, total, fixed = {s: i % 3 + 1 for i, s in enumerate(order)}, sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        level = Fraction(total - sum(fixed.values()), sum(weight[s] for s in free)) if free else 0
        above = [s for s in free if level * weight[s] > cap * sizes[s]]
        if not above:
            return fixed | {s: level * weight[s] for s in free}
        fixed |= {s: Fraction(cap * sizes[s]) for s in above}


def test_targets(spark):
    for sizes in ({"a": 10, "b": 1000, "c": 1, None: 7, "é": 0}, {"x": 5}, {"a": 0}, {f"s{i:04d}": i * i % 97 for i in range(900)} | {None: 50_000}):
        got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(7)).collect()
        want = _targets(sizes)
        assert len(got) == len(want) and all(math.isclose(r.target, want[r.source], rel_tol=1e-12) for r in got)


def test_draws_are_hypergeometric(spark):
    n = 20_000
    for good, total, draws in ((40, 100, 30), (3, 4, 4), (0, 9, 3), (900, 40_000, 20_000)):
        u = (F.col("id") + 0.5) / n
        got = Counter(r.k for r in spark.range(n).select(mixing.hypergeometric(*(F.lit(x).cast("long") for x in (good, total, draws)), u).alias("k")).collect())
        for k in range(max(0, draws - total + good), min(good, draws) + 1):
            p = Fraction(math.comb(good, k) * math.comb(total - good, draws - k), math.comb(total, draws))
            assert abs(got.get(k, 0) / n - float(p)) <= 2 / n
        assert sum(got.values()) == n


@pytest.mark.parametrize(("fan", "shards"), [(3, 5)])
def test_the_tree_gives_every_slot_to_one_shard(spark, monkeypatch, fan, shards):
    monkeypatch.setattr(mixing, "FAN", fan)
    slots = {i: (i * 37) % 50 for i in range(20)} | {20: 4000}
    table = spark.createDataFrame(list(slots.items()), "item long, slots long")
    nodes, levels = [(0, shards, i, n) for i, n in slots.items()], math.ceil(math.log(21, fan)) if fan < 21 else 1
    frame = spark.createDataFrame(nodes, "lo long, hi long, item long, n long")
    for _ in range(math.ceil(math.log2(shards)) if shards > 1 else 0):
        after = [tuple(r) for r in mixing.split(frame, levels, 42).select("lo", "hi", "item", "n").collect()]
        for lo, hi, item, n in nodes:  # children add up to their parent, source by source
            assert sum(x[3] for x in after if lo <= x[0] and x[1] <= hi and x[2] == item) == n
        nodes, frame = after, spark.createDataFrame(after, "lo long, hi long, item long, n long")
    got = mixing.quotas(table, shards, 42).collect()
    assert sorted((r.shard, r.item, r.n) for r in got) == sorted((lo, i, n) for lo, _, i, n in nodes)
    sums = Counter()
    for r in got:
        sums[r.shard] += r.n
        assert r.n >= 0
    assert max(sums.values()) - min(sums.values()) <= math.ceil(math.log2(shards)) + 1 if shards > 1 else True


@pytest.mark.parametrize("shards", [5])
def test_against_a_rebuild(spark, docs, rows, shards):
    """Lines, permutations, quotas and draws again, one word at a time; only hashes come from Spark."""
    w, seed = 16, 42
    found = mixing.mix(docs, shards=shards, block_words=w).collect()
    assert len(found) == len(rows)
    slim = mixing._rows_of(docs).withColumn("order", F.xxhash64(F.lit(seed), "doc_id", "mark", "size")).collect()
    buckets = max(16, math.isqrt(len({tuple(r) for r in slim})))
    lines, sizes = {}, {}
    for r in slim:
        lines.setdefault(r.source, []).append(((r.order % buckets, r.order, r.doc_id is not None, r.doc_id or 0, r.mark), r))
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
    want, ranked = _targets(sizes), sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    plans, slots = {}, {}
    for item, s in enumerate(ranked):
        size, quota = sizes[s], math.floor(want[s] + Fraction(1, 2))
        blocks, epochs = -(-size // w), -(-quota // size) if size else 0
        key = "" if s is None else "s" + s
        hashes = {(r.e, r.b): r.h for r in spark.range(max(1, epochs)).selectExpr("id AS e").crossJoin(spark.range(max(1, blocks)).selectExpr("id AS b")).withColumn("h", F.xxhash64(F.lit(seed + 1), F.lit(key), "e", "b")).collect()}
        parts, drawn, left = math.ceil(math.sqrt(blocks)), [], quota
        for e in range(epochs):
            for b in sorted(range(blocks), key=lambda b: (hashes[e, b] % parts, hashes[e, b], b)):
                if left > 0:
                    drawn.append((b, min(left, w, size - b * w)))
                    left -= drawn[-1][1]
        plans[s], slots[item] = drawn, len(drawn)
    quota = {(r["item"], r.shard): r.n for r in mixing.quotas(spark.createDataFrame([x for x in slots.items() if x[1]], "item long, slots long"), shards, seed).collect()}
    taken = Counter()
    for item, s in enumerate(ranked):
        at = 0
        line = [r for _, r in sorted(lines[s], key=lambda x: x[0]) for _ in range(r["size"])]
        for shard in range(shards):
            for b, n in plans[s][at : at + quota.get((item, shard), 0)]:
                for r in line[b * w : b * w + n]:
                    taken[s, r.doc_id, r.mark, shard] += 1
            at += quota.get((item, shard), 0)
        assert at == len(plans[s])
    got = Counter()
    for r in found:
        assert r.taken == sum(p.length for p in r.pieces) <= 3 * r["size"] and r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source])
        for p in r.pieces:
            got[r.source, r.doc_id, r.mark, p.shard] += p.length
    assert got == taken
    again = mixing.mix(docs.repartition(5), shards=shards, block_words=w).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))


def test_a_shard_gets_blocks_through_its_slots(spark, docs):
    """More shards give the same totals; which shard holds a word comes from the tree alone."""
    plan = mixing._lines(docs, 3, 16, 42)[1]
    one, many = (mixing.drawn_blocks(plan, n, 16, 42).toPandas() for n in (1, 6))
    assert one.words.sum() == many.words.sum() and set(one.shard) == {0} and set(many.shard) == set(range(6))
    assert not many.duplicated(["key", "block", "epoch"]).any()


def test_empty_and_wide_tables(spark, docs):
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mixed_documents(docs.limit(0)).count() == 0
    wide = docs.limit(5).withColumn("copy", F.lit(9)).withColumn("pieces", F.lit("p")).withColumn("taken", F.lit(1)).withColumn("k0", F.lit(1)).withColumn("order", F.lit(3))
    out = mixing.mixed_documents(wide, block_words=16)
    assert out.columns == wide.columns and {r.copy for r in out.collect()} <= {9}


def test_pieces_are_dealt_to_shards_and_shuffled(docs, rows):
    whole = mixing.mix(docs, block_words=16, shards=4).toPandas()
    got = mixing.deal(docs, block_words=16, shards=4).select("*", "payload.doc_id", "payload.source").toPandas()
    for _, g in got.groupby("shard"):
        assert sorted(g.place) == list(range(len(g)))
    # a block of a source in an epoch is one slot, and a slot has one shard
    assert (got.groupby(["source", "epoch", "block"], dropna=False).shard.nunique() == 1).all()
    words = Counter((s, d, e, x) for s, d, e, a, n in zip(got.source.fillna("-"), got.doc_id.fillna(-1), got.epoch, got.start, got.length, strict=True) for x in range(a, a + n))
    copies = Counter(r[0] for r in rows)
    assert all(n <= copies[None if w[1] == -1 else w[1]] for w, n in words.items())
    assert got.length.sum() == whole.taken.sum() and (got.text.map(lambda t: len(WORD.findall(t))) == got.length).all()
    # shuffled: neighbours in a shard aren't neighbours in the sources' lines
    lines = got.sort_values(["shard", "place"])
    assert lines.source.fillna("-").ne(lines.source.fillna("-").shift()).mean() > 0.3
    out = mixing.mixed_documents(docs, block_words=16, shards=4)
    assert out.columns == docs.columns and [r.text for r in out.collect()] == lines.text.tolist()
    other = mixing.deal(docs, block_words=16, shards=4, seed=7).select("shard", "place", "text").toPandas().sort_values(["shard", "place"])
    assert other.text.tolist() != lines.text.tolist()
