"""Mixing sources to target weights through a multivariate-hypergeometric splitting tree (DataFrame functions only).

* Each source is a line of words: its documents in hashed order, cut into blocks of ``block_words`` words. Offsets come
  from two-level prefix sums (hashed buckets, then rows in a bucket), so no task ever holds a source.
* Targets: sources by code point, null last, weigh 1, 2, 3, repeating; a target stops at ``cap`` times the source and
  the excess is shared again by weight, round by round, until none is above.
* A source's quota is a number of slots: whole epochs of its blocks, then as many blocks of one more epoch as its target
  needs, the last one cut to the exact word. In every epoch the blocks lie in the order of a keyed hash.
* The tree splits the slots of all sources among the output shards. A node covers a range of shards and holds a number of
  slots of each source; the slots of its left half are drawn from the multivariate hypergeometric distribution. The draw
  goes down groups of ``FAN`` sources, groups of groups, and so on, so no row or task holds all sources.
* A leaf's slots of a source are a range of that source's slots, disjoint from the other shards' ranges: a row for each
  (shard, slot) meets the block that the permutation has there. What documents give is what lies in these blocks.
* Inside a shard, pieces are ordered by a hash: the local shuffle. A piece's place in its shard comes from two-level
  counts; ``mixed_documents`` writes its rows by shard and place.

Every draw is a hash of (seed, node, source), so reruns agree. Defined results: null text has size 0; null source is a
source of its own; documents of size 0 take 0; repeated rows are separate documents; an empty table gives an empty
result. Other columns take no part, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .line_dedup import SPACE
from .scratch import stage

#: Children of a node in the tree of sources: the longest array that a draw walks along.
FAN = 64
#: Numbers that one row of a range becomes in one task.
RUN = 4096
#: Words of a shard that are written as one partition.
PART_WORDS = 2_000_000
DOC = ("doc_id", "source", "mark", "size")
PIECE = "array<struct<epoch:bigint,block:bigint,shard:bigint,start:bigint,length:bigint>>"


def count_words(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, "[\\x20\\x09-\\x0D]+"))).cast("long")


def _uniform(*parts: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def _bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def hypergeometric(good: Column, total: Column, draws: Column, u: Column) -> Column:
    """Inverse-CDF draw: how many of ``good`` among ``total`` are in ``draws``.

    Two walks over the range of nine deviations around the mean (what lies outside is below the resolution of ``u``).
    """

    def span(r: Column) -> Column:
        least, most = F.greatest(F.lit(0).cast("long"), r["draws"] - (r["total"] - r["good"])), F.least(r["good"], r["draws"])
        share = r["good"] / F.greatest(r["total"], F.lit(1))
        mean = r["draws"] * share
        dev = F.sqrt(mean * (1 - share) * (r["total"] - r["draws"]) / F.greatest(r["total"] - 1, F.lit(1)))
        low = F.greatest(least, F.floor(mean - 9 * dev - 9).cast("long"))
        high = F.least(most, F.ceil(mean + 9 * dev + 9).cast("long"))
        return F.struct(*[r[c].alias(c) for c in ("good", "total", "draws", "u")], low.alias("low"), high.alias("high"))

    def walk(r: Column, found, last) -> Column:
        start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"), F.lit(None).cast("long").alias("at"))

        def step(a: Column, k: Column) -> Column:
            ratio = ((r["good"] - k) / (k + 1)) * ((r["draws"] - k) / (r["total"] - r["good"] - r["draws"] + k + 1))
            w = F.when(k < r["high"], a["w"] * ratio).otherwise(F.lit(0.0))
            return F.struct(w.alias("w"), (a["sum"] + a["w"]).alias("sum"), found(a, k).alias("at"))

        return F.aggregate(F.sequence(r["low"], r["high"]), start, step, last)

    def draw(r: Column) -> Column:
        mass = walk(r, lambda a, k: a["at"], lambda a: a["sum"])
        return _bind(r["u"] * mass, lambda goal: F.coalesce(walk(r, lambda a, k: F.coalesce(a["at"], F.when(a["sum"] + a["w"] >= goal, k)), lambda a: a["at"]), r["high"]))

    whole = F.struct(good.alias("good"), total.alias("total"), draws.alias("draws"), u.alias("u"))
    return _bind(whole, lambda r: _bind(span(r), lambda s: F.when(s["low"] >= s["high"], s["low"]).otherwise(draw(s))))


def _source_key(source: Column) -> Column:
    """A source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit(""))


def targets(sums: DataFrame, cap: int = 3) -> DataFrame:
    """(source, source_size) with rank (from 1), weight and target added; one row per source.

    Ranks come from ranges of sources and the counts before them; the rounds of sharing are sums over all sources.
    """
    dealt = sums.repartitionByRange(F.col("source").isNull(), F.col("source")).withColumn("range", F.spark_partition_id())
    dealt = stage(dealt, "mix-sums")
    counts = dealt.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("range").orderBy(F.col("source").asc_nulls_last()))
    t = dealt.join(F.broadcast(before), "range").withColumn("rank", F.col("before") + place).drop("range", "before")
    t = t.withColumn("weight", F.pmod(F.col("rank") - 1, F.lit(3)) + 1).withColumn("most", F.lit(cap) * F.col("source_size"))
    t = stage(t, "mix-ranks")
    total, level, left = t.agg(F.sum("source_size")).first()[0] or 0, 0.0, None
    while True:
        # whole numbers only, so every order of adding gives the same level
        stopped = (F.lit(level) * F.col("weight") > F.col("most")) if left is not None else F.lit(False)
        held, weights, n = t.agg(F.sum(F.when(stopped, F.col("most"))), F.sum(F.when(~stopped, F.col("weight"))), F.count_if(~stopped)).first()
        if not n or n == left:
            break
        left, level = n, (total - (held or 0)) / weights
    return t.withColumn("target", F.least(F.col("most").cast("double"), F.lit(level) * F.col("weight"))).drop("most")


def _numbers(rows: DataFrame, first: str, end: str, name: str) -> DataFrame:
    """Each row once for every whole number from column ``first`` to before column ``end``; long ranges are dealt in runs."""
    begin, stop = F.col(first), F.col(end)
    rows = rows.where(begin < stop).withColumn("__run", F.explode(F.sequence(begin, stop - 1, F.lit(RUN).cast("long"))))
    rows = rows.repartition(F.xxhash64("__run", "key", *([] if "shard" not in rows.columns else ["shard"])))
    return rows.withColumn(name, F.explode(F.sequence(F.col("__run"), F.least(F.col("__run") + RUN, stop) - 1))).drop("__run")


def permuted(plan: DataFrame, seed: int) -> DataFrame:
    """(key, epoch, block, place): the blocks of every needed epoch in the order of a keyed hash."""
    wide = plan.select("key", "blocks", "epochs", F.lit(0).cast("long").alias("zero"), F.ceil(F.sqrt("blocks")).cast("long").alias("parts"))
    rows = _numbers(wide, "zero", "blocks", "block")
    rows = rows.select("key", "block", "parts", F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs") - 1)).alias("epoch"))
    rows = rows.withColumn("order", F.xxhash64(F.lit(seed + 1), "key", "epoch", "block"))
    rows = stage(rows.withColumn("part", F.pmod("order", "parts")).drop("parts"), "mix-orders")
    counts = rows.groupBy("key", "epoch", "part").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("key", "epoch").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("key", "epoch", "part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("base"))
    inner = F.row_number().over(Window.partitionBy("key", "epoch", "part").orderBy("order", "block")) - 1
    return rows.withColumn("inner", inner).join(base, ["key", "epoch", "part"]).select("key", "epoch", "block", (F.col("base") + F.col("inner")).alias("place"))


def split(nodes: DataFrame, levels: int, seed: int) -> DataFrame:
    """One level of the tree: rows (lo, hi, item, n) of shard ranges become those of their halves.

    ``item`` numbers the sources from 0; ``levels`` groupings by FAN lead to one group of all.
    """
    whole, open_ = nodes.where("hi - lo < 2"), nodes.where("hi - lo > 1")
    counts = [open_]
    for _ in range(levels):
        counts.append(counts[-1].groupBy("lo", "hi", F.expr(f"item div {FAN}").alias("item")).agg(F.sum("n").alias("n")))
    drawn = counts[-1].select("lo", "hi", "item", F.expr("n * ((lo + hi) div 2 - lo) div (hi - lo)").alias("take"))
    for level in reversed(range(levels)):
        kids = counts[level].groupBy("lo", "hi", F.expr(f"item div {FAN}").alias("parent"))
        kids = kids.agg(F.sort_array(F.collect_list(F.struct("item", "n"))).alias("kids"), F.sum("n").alias("all"))
        kids = kids.join(drawn.withColumnRenamed("item", "parent"), ["lo", "hi", "parent"]).withColumn("salt", F.xxhash64(F.lit(seed), F.lit(level), "lo", "hi"))
        begin = F.struct(F.array().cast("array<struct<item:bigint,take:bigint>>").alias("out"), F.col("all").alias("n"), F.col("take").alias("take"))


        def one(a: Column, kid: Column) -> Column:
            u = _uniform(F.col("salt"), kid["item"])
            more = lambda d: F.struct(
                F.concat(a["out"], F.array(F.struct(kid["item"].alias("item"), d.alias("take")))).alias("out"), (a["n"] - kid["n"]).alias("n"), (a["take"] - d).alias("take")
            )
            return _bind(hypergeometric(kid["n"], a["n"], a["take"], u), more)

        drawn = kids.select("lo", "hi", F.explode(F.aggregate("kids", begin, one, lambda a: a["out"])).alias("d")).select("lo", "hi", "d.item", "d.take")
    both = open_.join(drawn, ["lo", "hi", "item"])
    mid = F.expr("(lo + hi) div 2")
    halves = F.array(
        F.struct(F.col("lo").alias("lo"), mid.alias("hi"), F.col("item").alias("item"), F.col("take").alias("n")),
        F.struct(mid.alias("lo"), F.col("hi").alias("hi"), F.col("item").alias("item"), (F.col("n") - F.col("take")).alias("n")),
    )
    return both.select(F.explode(halves).alias("h")).select("h.*").unionByName(whole)


def quotas(slots: DataFrame, shards: int, seed: int) -> DataFrame:
    """(item, shard, n) from (item, slots): how many slots of each source each shard takes."""
    top = slots.agg(F.max("item")).first()[0] or 0
    levels = 1
    while FAN**levels <= top:
        levels += 1
    nodes = slots.select(F.lit(0).cast("long").alias("lo"), F.lit(shards).cast("long").alias("hi"), F.col("item").cast("long"), F.col("slots").cast("long").alias("n"))
    for _ in range(math.ceil(math.log2(max(1, shards)))):
        nodes = stage(split(nodes, levels, seed), "mix-tree")
    return nodes.select("item", F.col("lo").alias("shard"), "n")


def _plan(sums: DataFrame, cap: int, block_words: int) -> DataFrame:
    """Per source: its target, its blocks, whole epochs and the words of one more."""
    t = targets(sums, cap).withColumn("key", _source_key(F.col("source")))
    t = t.withColumn("blocks", F.ceil(F.col("source_size") / F.lit(block_words)).cast("long"))
    t = t.withColumn("short", F.col("source_size") - (F.col("blocks") - 1) * block_words).withColumn("quota", F.round("target").cast("long"))
    t = t.withColumn("full", F.when(F.col("source_size") > 0, F.expr("quota div source_size")).otherwise(F.lit(0)).cast("long"))
    t = t.withColumn("rest", F.col("quota") - F.col("full") * F.col("source_size"))
    return t.withColumn("epochs", F.col("full") + (F.col("rest") > 0).cast("long"))


def drawn_blocks(plan: DataFrame, shards: int, block_words: int, seed: int) -> DataFrame:
    """(key, block, epoch, shard, words): the blocks that the shards draw, and how many of their words."""
    blocks = stage(permuted(plan.where("source_size > 0 AND epochs > 0"), seed), "mix-blocks")
    # in the last epoch the short block's place tells how many slots the rest needs
    last = blocks.join(plan.select("key", (F.col("blocks") - 1).alias("block"), F.col("full").alias("epoch")), ["key", "block", "epoch"]).select("key", F.col("place").alias("turn"))
    plan = plan.join(last, "key", "left").withColumn("turn", F.coalesce("turn", F.lit(0)))
    w = F.lit(block_words).cast("long")
    after = F.col("rest") - F.col("turn") * w - F.col("short")
    tail = F.when(after <= -F.col("short"), F.ceil(F.col("rest") / w)).when(after <= 0, F.col("turn") + 1).otherwise(F.col("turn") + 1 + F.ceil(after / w)).cast("long")
    plan = plan.withColumn("slots", F.col("full") * F.col("blocks") + F.when(F.col("rest") > 0, tail).otherwise(F.lit(0)))
    plan = stage(plan.withColumn("item", F.col("rank") - 1), "mix-slots")
    leaves = quotas(plan.where("slots > 0").select("item", "slots"), shards, seed)
    upto = Window.partitionBy("item").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    ranges = leaves.withColumn("end", F.sum("n").over(upto)).withColumn("begin", F.col("end") - F.col("n"))
    ranges = ranges.join(plan.select("item", "key"), "item").select("key", "shard", "begin", "end")
    slots = _numbers(ranges, "begin", "end", "slot").select("key", "shard", "slot")
    shape = plan.where("slots > 0").select("key", "blocks", "full", "rest", "short", "turn")
    rows = blocks.join(shape, "key").withColumn("slot", F.col("epoch") * F.col("blocks") + F.col("place"))
    rows = slots.join(rows, ["key", "slot"])
    size = F.when(F.col("block") == F.col("blocks") - 1, F.col("short")).otherwise(w)
    before = F.col("place") * w - F.when(F.col("place") > F.col("turn"), w - F.col("short")).otherwise(F.lit(0))
    words = F.when(F.col("epoch") < F.col("full"), size).otherwise(F.least(size, F.col("rest") - before))
    return rows.select("key", "block", "epoch", "shard", words.alias("words"))


def _rows_of(docs: DataFrame) -> DataFrame:
    """The columns that tell documents apart, as used by every table here."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.xxhash64(text).alias("mark"), count_words(text).alias("size"))


def _lines(docs: DataFrame, cap: int, block_words: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Distinct rows with their number, the target of their source and where they start in its line; and the plan."""
    slim = stage(_rows_of(docs).groupBy(*DOC).agg(F.count(F.lit(1)).alias("copies")), "mix-sizes")
    buckets = max(16, math.isqrt(slim.count()))
    order = F.xxhash64(F.lit(seed), "doc_id", "mark", "size")
    slim = slim.withColumn("key", _source_key(F.col("source"))).withColumn("order", order).withColumn("bucket", F.pmod("order", F.lit(buckets)))
    slim = slim.withColumn("span", F.col("size") * F.col("copies"))
    held = stage(slim.groupBy("key", "source", "bucket").agg(F.sum("span").alias("held")), "mix-buckets")
    plan = stage(_plan(held.groupBy("source").agg(F.sum("held").alias("source_size")), cap, block_words), "mix-plan")
    upto = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = held.select("key", "bucket", F.coalesce(F.sum("held").over(upto), F.lit(0)).alias("base")).join(plan.select("key", "source_size", "target"), "key")
    within = Window.partitionBy("key", "bucket").orderBy("order", "doc_id", "mark", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = slim.withColumn("inner", F.coalesce(F.sum("span").over(within), F.lit(0))).join(base, ["key", "bucket"])
    rows = rows.select(*DOC, "key", "copies", "source_size", "target", (F.col("base") + F.col("inner")).alias("at"))
    return stage(rows, "mix-lines"), plan


def mix(docs: DataFrame, cap: int = 3, shards: int = 16, block_words: int = 2048, seed: int = 42) -> DataFrame:
    """Per document: doc_id, source, mark (of its text), size, copy, source_size, target, taken and pieces.

    ``pieces`` holds (epoch, block, shard, start, length): the words from ``start`` that this shard's slot takes, in order.
    ``copy`` numbers rows that are the same.
    """
    rows, plan = _lines(docs, cap, block_words, seed)
    draws = drawn_blocks(plan, shards, block_words, seed)
    # a block is in a few epochs at most
    draws = stage(draws.groupBy("key", "block").agg(F.collect_list(F.struct("epoch", "shard", "words")).alias("draws")), "mix-draws")
    info = ("source_size", "target")
    copies = rows.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    some = copies.where("size > 0").withColumn("begin", F.col("at") + F.col("copy") * F.col("size")).withColumn("end", F.col("begin") + F.col("size"))
    some = some.withColumn("block", F.explode(F.sequence(F.expr(f"begin div {block_words}"), F.expr(f"(end - 1) div {block_words}"))))
    some = some.join(draws, ["key", "block"], "left")
    first = F.col("block") * F.lit(block_words).cast("long")

    def piece(d: Column) -> Column:
        start = F.greatest(first, F.col("begin"))
        length = F.least(first + d["words"], F.col("end")) - start
        return F.struct(d["epoch"].alias("epoch"), F.col("block").alias("block"), d["shard"].alias("shard"), (start - F.col("begin")).alias("start"), length.alias("length"))

    some = some.withColumn("p", F.filter(F.transform("draws", piece), lambda p: p["length"] > 0))
    some = some.groupBy(*DOC, "copy", "begin", *info).agg(F.sort_array(F.flatten(F.collect_list("p"))).alias("pieces")).drop("begin")
    none = copies.where("size = 0").select(*DOC, "copy", *info, F.array().cast(PIECE).alias("pieces"))
    both = some.withColumn("pieces", F.col("pieces").cast(PIECE)).unionByName(none)
    taken = F.aggregate("pieces", F.lit(0).cast("long"), lambda a, p: a + p["length"])
    return both.select(*DOC, "copy", *info, taken.alias("taken"), "pieces")


def _same() -> list[Column]:
    """The columns of DOC as keys that are never null."""
    return [F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull(), _source_key(F.col("source")), F.col("mark"), F.col("size")]


def deal(docs: DataFrame, cap: int = 3, shards: int = 16, block_words: int = 2048, seed: int = 42) -> DataFrame:
    """A row for each piece: shard, place (0, 1, 2, ... in the shard), epoch, block, start, length, text and the columns of ``docs`` as ``payload``.

    A document taken whole in one piece keeps its text; otherwise the words of the piece are joined by single spaces.
    """
    found = stage(mix(docs, cap, shards, block_words, seed), "mix-pieces")
    slim = found.select(*DOC, "copy", F.explode("pieces").alias("p")).select(*DOC, "copy", "p.*")
    order = F.xxhash64(F.lit(seed + 2), *DOC, "copy", "epoch", "block")
    slim = slim.withColumn("order", order)
    share = max(16, math.isqrt(math.ceil(slim.count() / max(1, shards))))
    slim = slim.withColumn("bucket", F.pmod("order", F.lit(share)))
    counts = stage(slim.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("words")), "mix-dealt")
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    table = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("words"))
    # runs of a shard's buckets become partitions; the window without a key runs over one row per shard
    table = table.withColumn("run", F.expr(f"words div {PART_WORDS}"))
    runs = table.groupBy("shard").agg((F.max("run") + 1).alias("runs"))
    runs = runs.select("shard", F.sum("runs").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), "runs")
    table = table.join(runs, "shard").select("shard", "bucket", "base", (F.col("upto") - F.col("runs") + F.col("run")).cast("int").alias("part"))
    table = stage(table, "mix-places")
    parts = (table.agg(F.max("part")).first()[0] or 0) + 1

    names = [f"k{i}" for i in range(5)]
    rest = [c for c in docs.columns if c != "text"]
    payload = F.struct(*[F.col(c) for c in rest]).alias("payload") if rest else F.struct(F.lit(0).alias("none")).alias("payload")
    text = F.col("text").cast("string")
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64(text).alias("mark"), count_words(text).alias("size"), text.alias("text"), payload)
    whole = whole.select(*[c.alias(n) for c, n in zip(_same(), names, strict=True)], "size", "text", "payload")
    # rows that are the same in these columns get the pieces of one copy each
    repeats = found.where("copy > 0").limit(1).count() > 0
    number = F.row_number().over(Window.partitionBy(*names).orderBy(F.to_json("payload"))) - 1 if repeats else F.lit(0)
    whole = whole.withColumn("copy", number.cast("long"))
    taken = found.where("taken > 0").select(*[c.alias(n) for c, n in zip(_same(), names, strict=True)], "copy", "pieces")
    rows = whole.join(taken, [*names, "copy"])

    is_whole = lambda p: (p["start"] == 0) & (p["length"] == F.col("size"))
    cut = lambda w, p: F.array_join(F.slice(w, (p["start"] + 1).cast("int"), p["length"].cast("int")), " ")
    each = lambda p, t: F.struct(p.alias("p"), t.alias("text"))
    words = F.split(F.btrim("text", F.lit(SPACE)), "[\\x20\\x09-\\x0D]+")
    parted = _bind(words, lambda w: F.transform("pieces", lambda p: each(p, F.when(is_whole(p), F.col("text")).otherwise(cut(w, p)))))
    rows = rows.withColumn("c", F.explode(F.when(F.forall("pieces", is_whole), F.transform("pieces", lambda p: each(p, F.col("text")))).otherwise(parted)))
    key = [F.when(F.col("k1"), F.lit(None).cast("long")).otherwise(F.col("k0")).alias("doc_id"), F.when(F.col("k2") != "", F.expr("substring(k2, 2)")).alias("source"), F.col("k3").alias("mark")]
    rows = rows.select(*key, "size", "copy", "payload", "c.p.*", "c.text")
    # a null text has no pieces, so a mark is never null here
    rows = rows.withColumn("order", order).withColumn("bucket", F.pmod("order", F.lit(share)))
    rows = rows.join(table, ["shard", "bucket"]).repartitionById(parts, F.col("part"))
    within = Window.partitionBy("part", "shard", "bucket").orderBy("order", *DOC, "copy", "epoch", "block")
    place = F.col("base") + F.row_number().over(within) - 1
    return rows.select("shard", place.alias("place"), "epoch", "block", "start", "length", "text", "payload")


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The mix as documents: a row for each piece, with the columns of ``docs``, dealt to the shards.

    A partition holds a run of places of one shard, in order; partitions follow the order of shards and places.
    """
    rows = deal(docs, **settings).sortWithinPartitions("shard", "place")
    return rows.select(*[F.col("text") if c == "text" else F.col("payload").getField(c).alias(c) for c in docs.columns])
