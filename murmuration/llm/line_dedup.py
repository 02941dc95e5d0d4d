"""Line dedup: explode normalised lines, hash, count documents per hash, drop, reassemble by position.

DataFrame functions only. A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` with A-Z lower-cased, held as
128 bits of hash. The text is never exploded: only (document, position, hash) rows of long enough keys are, once, into
a shared table. Counting has map-side combine; only hashes with enough rows go on to the exact distinct count, and
the positions to drop come back to each document as one sorted array from which whole slices of lines are kept.

Defined results: null or empty text is one empty line. A row without doc_id holds no key and loses nothing. Rows that
repeat a doc_id count as one document; each loses its own lines. An empty table gives an empty result. Other columns pass
through; those that have the name of a result are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import stage

SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else; pure ASCII takes the byte path of lower()."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def line_positions(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, mark, pos, h1, h2) for each line whose key has at least ``min_chars`` code points."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = docs.where("doc_id IS NOT NULL").select(
        F.col("doc_id").cast("long"), F.xxhash64(text).alias("mark"), F.posexplode(F.split(lower_ascii(text), "\n")).alias("pos", "line")
    )
    keyed = lines.withColumn("key", F.btrim("line", F.lit(SPACE))).where(F.char_length("key") >= min_chars)
    return keyed.select("doc_id", "mark", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))


def line_dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``docs`` with the columns kept_text, n_lines and n_dropped added."""
    lines = stage(line_positions(docs, min_chars), "lines")
    often = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select("h1", "h2")
    hits = stage(lines.join(stage(often, "lines-often"), ["h1", "h2"]), "lines-hits")
    holders = hits.groupBy("h1", "h2").agg(F.countDistinct("doc_id").alias("held"), F.max("doc_id").alias("last"))
    common = stage(holders.where(F.col("held") >= min_docs).select("h1", "h2", "last"), "lines-common")
    drops = hits.join(common, ["h1", "h2"]).where("doc_id <> last").groupBy("doc_id", "mark").agg(F.array_sort(F.collect_set("pos")).alias("__drop"))
    text = F.coalesce(F.col("text"), F.lit(""))
    drops = drops.withColumnRenamed("doc_id", "__id").withColumnRenamed("mark", "__mark")
    # the other columns go as one, so that none of their names can clash
    mine = {"kept_text", "n_lines", "n_dropped"}
    names = [c for c in docs.columns if c.lower() not in mine]
    rows = docs.select("doc_id", F.struct(*names).alias("row"), text.alias("__text"), F.xxhash64(text).alias("__key"))
    text = F.col("__text")
    rows = rows.join(drops, (F.col("doc_id") == F.col("__id")) & (F.col("__key") == F.col("__mark")), "left")
    rows = rows.withColumn("__lines", F.split(text, "\n"))
    kept = F.flatten(
        F.zip_with(
            F.concat(F.array(F.lit(-1)), "__drop"),
            F.concat("__drop", F.array(F.size("__lines"))),
            lambda a, b: F.slice(F.col("__lines"), a + 2, b - a - 1),
        )
    )
    return rows.select(
        *[F.col("row").getField(c).alias(c) for c in names],
        F.when(F.col("__drop").isNull(), text).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
        F.size("__lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("__drop"), F.lit(0)).cast("long").alias("n_dropped"),
    )
