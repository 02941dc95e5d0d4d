"""Exact dedup over an extendible-hash index on shared files (DataFrame functions only).

* ``xxhash64`` of the whole text is the index key. The directory starts with the depth that half fills its buckets and
  doubles while many buckets hold more than ``capacity`` distinct keys; the few that still do split one by one. Copies
  share one key, so no group of copies makes a bucket split. A bucket is the range of keys with its first bits.
* The task that gets a bucket is its owner: it gathers the distinct (key, text) pairs of the bucket, which compares bytes
  wherever hashes are equal; map-side aggregation sends a text of a hot group once per task. Texts of one key form a chain.
* The index (bucket, key, chain) lies in the shared folder, laid out and sorted by bucket. Documents look themselves up
  by bucket and key: a chain of one text decides at once, in a longer one the digest picks the entry.

Defined results: null text counts as empty. A null doc_id ranks below every id. Where several rows of a group have
its largest doc_id, exactly one of them is kept. An empty table gives an empty result. Other columns take no part,
whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import stage

#: Buckets that split one by one, so that the table of splits stays small; with more of them the directory doubles.
SPLITS = 4096


def _key(text: Column, bits: int) -> Column:
    h = F.xxhash64(text)
    return F.shiftleft(F.shiftrightunsigned(h, 64 - bits), 64 - bits) if bits < 64 else h


def _bucket(key: str, depth: str | int) -> Column:
    """The first key of the bucket: ``depth`` bits of the key, then zeros."""
    return F.expr(f"CASE WHEN {depth} = 0 THEN 0L ELSE shiftleft(shiftrightunsigned({key}, 64 - {depth}), 64 - {depth}) END")


def directory(keys: DataFrame, capacity: int) -> tuple[int, DataFrame]:
    """The common depth, and (bucket, local_depth) of the buckets that are split further, for distinct ``key`` rows."""
    n = keys.count()
    depth = max(0, math.ceil(math.log2(max(1, 2 * n / capacity))))
    while True:
        held = keys.groupBy(_bucket("key", depth).alias("bucket")).agg(F.count(F.lit(1)).alias("held"))
        full = stage(held.where(F.col("held") > capacity).select("bucket"), "exact-full")
        overfull = full.count()
        if overfull <= SPLITS or depth >= 64:
            break
        depth += 1
    splits, level = None, depth
    while overfull and level < 64:
        inside = keys.withColumn("bucket", _bucket("key", level)).join(full, "bucket", "left_semi").select("key")
        level += 1
        held = stage(inside.groupBy(_bucket("key", level).alias("bucket")).agg(F.count(F.lit(1)).alias("held")), "exact-split")
        full = held.where(F.col("held") > capacity).select("bucket")
        overfull = full.count()
        fit = held.where((F.col("held") <= capacity) | F.lit(level == 64)).select("bucket", F.lit(level).alias("local_depth"))
        splits = fit if splits is None else splits.unionByName(fit)
    none = keys.select(F.col("key").alias("bucket"), F.lit(0).alias("local_depth")).limit(0)
    return depth, stage(none if splits is None else splits, "exact-directory")


def place(rows: DataFrame, depth: int, splits: DataFrame) -> DataFrame:
    """Adds the bucket and the local depth of each row's key."""
    table = splits.select(_bucket("bucket", depth).alias("cell"), F.col("bucket").alias("split"), "local_depth")
    rows = rows.withColumn("cell", _bucket("key", depth))
    rows = rows.join(table, (rows["cell"] == table["cell"]) & (_bucket("key", "local_depth") == F.col("split")), "left").drop("cell")
    return rows.withColumn("bucket", F.coalesce("split", _bucket("key", depth))).withColumn("local_depth", F.coalesce("local_depth", F.lit(depth))).drop("split")


def build_index(docs: DataFrame, capacity: int = 256, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """The index (bucket, local_depth, key, chain of digests) and the rows (doc_id, key, sha, copies, bucket) that look into it."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), _key(text, bits).alias("key"))
    slim = rows.groupBy("doc_id", "key", F.sha2("text", 256).alias("sha")).agg(F.count(F.lit(1)).alias("copies"))
    members = stage(slim, "exact-members")
    depth, splits = directory(stage(members.select("key").distinct(), "exact-keys"), capacity)
    held = place(rows.select("key", "text"), depth, splits).groupBy("bucket", "local_depth").agg(F.collect_set(F.struct("key", "text")).alias("texts"))
    entries = held.select("bucket", "local_depth", F.explode("texts").alias("t")).select("bucket", "local_depth", "t.key", F.sha2("t.text", 256).alias("sha"))
    chains = entries.groupBy("bucket", "local_depth", "key").agg(F.sort_array(F.collect_list("sha")).alias("chain"))
    index = chains.repartitionByRange("bucket").sortWithinPartitions("bucket", "key")
    return stage(index, "exact-index"), place(members, depth, splits)


def look_up(members: DataFrame, index: DataFrame) -> DataFrame:
    """The rows with their place in the index: bucket, key and number in the chain, and the digest found there."""
    found = members.join(index.select("bucket", "key", "chain"), ["bucket", "key"])
    link = F.when(F.size("chain") == 1, 1).otherwise(F.array_position("chain", F.col("sha"))).cast("int")
    return found.withColumn("link", link).withColumn("sha", F.element_at("chain", F.col("link"))).drop("chain")


def exact_dedup(docs: DataFrame, capacity: int = 256, bits: int = 64) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, bucket, key, link (number in the chain)."""
    index, members = build_index(docs, capacity, bits)
    found = stage(look_up(members, index), "exact-found")
    at = ["bucket", "key", "link"]
    groups = stage(found.groupBy(*at).agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size")), "exact-groups")
    rows = found.join(groups, at).withColumn("copy", F.explode(F.expr("sequence(1L, copies)")))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return rows.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("sha").alias("text_sha256"), "bucket", "key", "link")


def drop_exact_copies(docs: DataFrame, capacity: int = 256) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: decisions of the index, applied by id and digest."""
    found = exact_dedup(docs, capacity).groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("rows"), F.max("kept").alias("kept"))
    name = [F.col("doc_id").isNull().alias("n"), F.coalesce("doc_id", F.lit(0)).alias("i"), F.col("text_sha256").alias("s")]
    found = stage(found.select(*name, "rows", "kept"), "exact-decisions")
    # the other columns go as one, so none of their names can clash
    whole = docs.select(
        F.col("doc_id").cast("long").isNull().alias("n"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("i"),
        F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256).alias("s"), F.struct(*docs.columns).alias("row"),
    )
    gone, once = found.where("NOT kept").select("n", "i", "s"), found.where("kept AND rows > 1").select("n", "i", "s")
    stay = whole.join(gone, ["n", "i", "s"], "left_anti")
    if once.limit(1).count():
        one = Window.partitionBy("n", "i", "s").orderBy(F.to_json("row"))
        first = stay.join(once, ["n", "i", "s"], "left_semi").withColumn("copy", F.row_number().over(one)).where("copy = 1").drop("copy")
        stay = stay.join(once, ["n", "i", "s"], "left_anti").unionByName(first)
    return stay.select("row.*")
