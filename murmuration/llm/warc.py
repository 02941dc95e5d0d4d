"""WARC archives: written as lines of text, read back by verifying the chain of record boundaries.

* Writing. A page's record is one value, and the lines of Spark's text writer end in the two blank lines that end a
  record: archives are written where the pages are read, by any store that Spark writes to, without a shuffle. Of pages
  with equal payloads (equal 256-bit digests and lengths) the one with the largest id is the response; the others become
  revisits that refer to it. Only the digests that several pages share are joined to the pages.
* Reading. Tasks read the archives in byte ranges, cut at every occurrence of the magic, and emit for each a candidate:
  its offset and that of its successor, from the header's Content-Length. A payload may hold the magic, or a whole
  record. So candidates are linked to their successors and pointer jumping goes from the start of each file: after k
  rounds the first 2**k records of every file are known. What isn't reached isn't a record. Links are three numbers; payloads
  take no part in the joins, but for those of records that the magic cuts in pieces, which are gathered by record.
* A chain that doesn't end with its file is an error that names the file.

Defined results: a null payload is empty. Rows that repeat an id and a payload are one response and revisits of it; pages
smaller than ``least`` bytes are all responses. Null ids rank below every id and come back as null. CR, LF and % of an
address are percent-encoded in the header. An empty table gives an empty result. Other columns take no part.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import new_path, stage

#: Fixed values of the format.
MAGIC, BLANK = "WARC/1.1\r\n", "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

FIELDS = {
    "type": "WARC-Type", "record_id": "WARC-Record-ID", "uri": "WARC-Target-URI", "refers": "WARC-Refers-To", "page": "X-Page-Id", "declared": "WARC-Payload-Digest",
}


def base32(hexadecimal: Column) -> Column:
    """Base 32 of a SHA-1 given in hex: five hex digits are four of its digits."""
    out = []
    for at in range(0, 40, 5):
        five = F.conv(F.substring(hexadecimal, at + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(ALPHABET), F.shiftright(five, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def _name(page: Column, sha: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(":"), sha, F.lit(">"))


def _record(kind: str, page: Column, uri: Column, payload: Column, sha: Column, digest: Column, refers: Column | None, date: str) -> Column:
    """The text of a record, without the blank lines that end it."""
    block = F.concat(F.lit(HTTP), payload) if kind == "response" else F.lit(HTTP)
    safe = uri
    for c, code in (("%", "%25"), ("\r", "%0D"), ("\n", "%0A")):
        safe = F.replace(safe, F.lit(c), F.lit(code))
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    lines = [
        F.lit(MAGIC + f"WARC-Type: {kind}\r\n"), line("WARC-Record-ID", _name(page, sha)), F.lit(f"WARC-Date: {date}\r\n"), line("WARC-Target-URI", safe), line("X-Page-Id", page.cast("string")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)), F.lit("Content-Type: application/http; msgtype=response\r\n"),
    ]
    if kind == "revisit":
        lines += [F.lit(f"WARC-Profile: {PROFILE}\r\n"), line("WARC-Refers-To", refers)]
    return F.concat(*lines, line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"), block)


def write_archives(pages: DataFrame, path: str, least: int = 0, per_file: int = 4096, date: str = "1970-01-01T00:00:00Z") -> None:
    """Archives of at most ``per_file`` records for the rows (page_id, url, html)."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha2(html, 256).alias("sha"))
    sized = stage(rows.where(F.octet_length("html") >= least).select("page", "sha"), "warc-digests")
    shared = sized.groupBy("sha").agg(F.count(F.lit(1)).alias("n"), F.max("page").alias("last")).where("n > 1").select("sha", "last")
    shared = stage(shared, "warc-shared")
    tied = sized.join(shared, "sha").where(F.col("page").eqNullSafe(F.col("last"))).groupBy("sha").agg(F.count(F.lit(1)).alias("ties"))
    shared = stage(shared.join(tied, "sha").select(F.col("sha").alias("s"), "last", "ties"), "warc-shared")
    digest = base32(F.sha1(F.col("html").cast("binary")))
    response = _record("response", F.col("page"), F.col("url"), F.col("html"), F.col("sha"), digest, None, date)
    revisit = _record("revisit", F.col("page"), F.col("url"), F.lit(""), F.col("sha"), digest, _name(F.col("last"), F.col("sha")), date)
    both = rows.join(shared, (F.col("sha") == F.col("s")) & (F.octet_length("html") >= least), "left")
    last = F.col("page").eqNullSafe(F.col("last"))
    plain = both.where(F.col("ties").isNull() | ~last | (F.col("ties") == 1))
    plain = plain.select(F.when(F.col("ties").isNull() | last, response).otherwise(revisit).alias("value"))
    plain.write.option("lineSep", BLANK).option("maxRecordsPerFile", per_file).text(path)
    if shared.where("ties > 1").limit(1).count():
        # several rows of the response's id: counted by address, and one of the smallest address is the response
        alike = both.where((F.col("ties") > 1) & last).groupBy("page", "sha", "last", "url").agg(F.count(F.lit(1)).alias("n"), F.first("html").alias("html"))
        first = alike.groupBy(F.col("sha").alias("s")).agg(F.min(F.coalesce("url", F.lit(""))).alias("u"), F.count_if(F.col("url").isNull()).alias("none"))
        rows = alike.join(first, F.col("sha") == F.col("s")).withColumn("copy", F.explode(F.expr("sequence(1L, n)")))
        chosen = F.when(F.col("none") > 0, F.col("url").isNull()).otherwise(F.col("url") == F.col("u"))
        rows = rows.select(F.when(chosen & (F.col("copy") == 1), response).otherwise(revisit).alias("value"))
        rows.write.mode("append").option("lineSep", BLANK).option("maxRecordsPerFile", per_file).text(path)


CHUNK = "file long, name string, start long, nth long, rel long, size long, total long, need long, head int, " + ", ".join(f"{f} string" for f in FIELDS) + ", bytes long, sha1 string, payload binary, body binary"


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()  # noqa: S324


def _payload(data: bytes, head: int, end: int) -> bytes:
    """What follows the HTTP header of a record's block, or the whole block if it has none."""
    if not data.startswith(b"HTTP/", head):
        return data[head:end]
    blank = data.find(b"\r\n\r\n", head, end)
    return data[blank + 4 : end] if blank >= 0 else b""


def _chunks(keep: bool, bodies: bool):
    """Candidates of the byte ranges of a task, in order; ``body`` holds what may be a piece of a longer record, or all with ``bodies``."""
    names = [c.split()[0] for c in CHUNK.split(", ")]
    kinds = [{"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[c.split()[1]] for c in CHUNK.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, nth, rel = None, 0, 0
        for whole in batches:
            for first in range(0, len(whole), 256):
                b, out = whole.slice(first, 256), []
                for file, name, start, total, data in zip(*(b.column(c).to_pylist() for c in ("file", "name", "start", "total", "value")), strict=True):
                    if (file, start) != at:
                        at, nth, rel = (file, start), 0, 0
                    row = dict.fromkeys(names) | {"file": file, "name": name, "start": start, "nth": nth, "rel": rel, "size": len(data), "total": total}
                    end = data.find(b"\r\n\r\n")
                    lines = dict(x.split(b": ", 1) for x in data[: max(end, 0)].split(b"\r\n") if b": " in x)
                    length = lines.get(b"Content-Length", b"").strip()
                    if end >= 0 and length.isdigit():
                        row |= {f: lines[k.encode()].decode("utf-8", "replace") for f, k in FIELDS.items() if k.encode() in lines}
                        row |= {"need": end + 8 + int(length), "head": end + 4}
                    if row["need"] == len(data):  # the block ends where the next magic begins: nothing to gather
                        payload = _payload(data, row["head"], len(data) - 4)
                        row |= {"bytes": len(payload), "sha1": _digest(payload), "payload": payload if keep else None}
                    if bodies or row["need"] != len(data):
                        row["body"] = data
                    out.append(row)
                    nth, rel = nth + 1, rel + len(data) + len(MAGIC)
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], k) for n, k in zip(names, kinds, strict=True)], names)

    return run


def reached(links: DataFrame) -> DataFrame:
    """(file, at) of the candidates (file, at, to) on the chain from offset 0 of each file: in every round the known part of a chain doubles."""
    pointers, known = stage(links.select("file", "at", "to"), "warc-links"), links.where("at = 0").select("file", "at")
    known = stage(known, "warc-known")
    while True:
        new = known.join(pointers, ["file", "at"]).select("file", F.col("to").alias("at"))
        new = stage(new.join(links.select("file", "at"), ["file", "at"], "left_semi"), "warc-known")
        if not new.limit(1).count():
            return known
        known = known.unionByName(new)
        target = pointers.select("file", F.col("at").alias("to"), F.col("to").alias("further"))
        pointers = stage(pointers.join(target, ["file", "to"], "left").select("file", "at", F.col("further").alias("to")), "warc-links")


def located(spark: SparkSession, path: str, payloads: bool, bodies: bool = False) -> tuple[DataFrame, DataFrame]:
    """The candidates of the archives, and without payloads, with their offsets: (file, start, nth) names a candidate in both.

    Files go by a hash of their path: numbers in the joins are as large in memory as their tables on disk let the planner think.
    """
    meta = F.col("_metadata")
    text = spark.read.option("lineSep", MAGIC).text(path)
    text = text.select(F.xxhash64(meta["file_path"]).alias("file"), meta["file_path"].alias("name"), meta["file_block_start"].alias("start"), meta["file_size"].alias("total"), F.col("value").cast("binary").alias("value"))
    chunks = stage(text.mapInArrow(_chunks(payloads, bodies), CHUNK), "warc-chunks")
    # a byte range begins where those before it in the file end: a row for each range
    ranges = chunks.groupBy("file", "start").agg(F.sum(F.col("size") + len(MAGIC)).alias("held"))
    before = ranges.alias("a").join(ranges.alias("b"), (F.col("a.file") == F.col("b.file")) & (F.col("b.start") < F.col("a.start")), "left")
    before = before.groupBy(F.col("a.file").alias("file"), F.col("a.start").alias("start")).agg(F.coalesce(F.sum("b.held"), F.lit(0)).alias("base"))
    # the magic stands before its chunk; what comes before a file's first magic is no candidate
    found = chunks.join(stage(before, "warc-ranges"), ["file", "start"]).withColumn("at", F.col("base") + F.col("rel") - len(MAGIC))
    slim = found.select("file", "at", "size", "need", (F.col("at") + F.col("need") + len(MAGIC)).alias("to"), "start", "nth")
    return chunks, stage(slim.where("at >= 0"), "warc-candidates")


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row for each record: file, at (its offset), type, record_id, uri, refers, page, declared (its digest line), bytes, sha1 and, if wanted, payload."""
    chunks, slim = located(spark, path, payloads)
    known = stage(reached(slim.where("to IS NOT NULL").select("file", "at", "to")), "warc-reached")
    records = stage(slim.join(known, ["file", "at"]), "warc-records")
    _verify(chunks, records)
    key, fields = ["file", "start", "nth"], [*FIELDS, "bytes", "sha1", *["payload"] * payloads]
    rows = chunks.where("need = size").select(*key, "name", *fields).join(records.where("need = size").select(*key, "at"), key).select(F.col("name").alias("file"), "at", *fields)
    cut = stage(records.where("need <> size").select("file", "at", "to"), "warc-cut")
    if not cut.limit(1).count():
        return rows
    pieces = stage(_pieces(slim, cut), "warc-pieces")
    bare = chunks.where("body IS NULL").select(*key).join(pieces, key, "left_semi")
    if bare.limit(1).count():  # whole records within a payload: their bytes are read again
        chunks, slim = located(spark, path, False, True)
        pieces = stage(_pieces(slim, cut), "warc-pieces")
    return rows.unionByName(_gathered(chunks, pieces, payloads))


def _verify(chunks: DataFrame, records: DataFrame) -> None:
    """Every file that isn't empty is a chain from its first byte to its last."""
    files = chunks.where("total > 0").groupBy("file").agg(F.max("total").alias("total"), F.first("name").alias("name"))
    ends = records.groupBy("file").agg(F.max("to").alias("end"))
    # the last record's two blank lines end the file
    broken = files.join(ends, "file", "left").where("end IS NULL OR end <> total").select("name", "end", "total").limit(3).collect()
    if broken:
        raise ValueError("no chain of records to the end of " + "; ".join(f"{r.name} (reached {r.end} of {r.total})" for r in broken))


def _pieces(slim: DataFrame, cut: DataFrame, wide: int = 1 << 20) -> DataFrame:
    """(file, start, nth, at, record) of the candidates from each cut record's start to its end, its own included.

    Both sides meet by blocks of ``wide`` bytes, so neither is compared with a whole file.
    """
    block = F.floor(F.col("at") / wide)
    over = cut.select("file", F.col("at").alias("record"), F.col("to").alias("until"), F.explode(F.sequence(block, F.floor((F.col("to") - 1) / wide))).alias("block"))
    return slim.withColumn("block", block).join(over, ["file", "block"]).where("at >= record AND at < until").select("file", "start", "nth", "at", "record")


def _gathered(chunks: DataFrame, pieces: DataFrame, payloads: bool) -> DataFrame:
    """The records that the magic cuts in pieces, put together by record."""
    held = pieces.join(chunks.select("file", "name", "start", "nth", "need", "head", *FIELDS, "body"), ["file", "start", "nth"])
    own = F.when(F.col("at") == F.col("record"), F.struct("name", "need", "head", *FIELDS))
    joined = held.groupBy("file", F.col("record")).agg(F.sort_array(F.collect_list(F.struct("at", "body"))).alias("pieces"), F.first(own, True).alias("own"))
    joined = joined.select(F.col("record").alias("at"), "pieces", "own.*").withColumnRenamed("name", "file")
    fields = [*FIELDS, "bytes", "sha1", *["payload"] * payloads]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(len(whole)):
                b = whole.slice(k, 1)
                data = MAGIC.encode().join(p["body"] for p in b.column("pieces")[0].as_py())
                payload = _payload(data, b.column("head")[0].as_py(), b.column("need")[0].as_py() - 4)
                cols = [b.column(c) for c in ("file", "at", *FIELDS)] + [pa.array([len(payload)], pa.int64()), pa.array([_digest(payload)])] + [pa.array([payload], pa.binary())] * payloads
                yield pa.RecordBatch.from_arrays(cols, ["file", "at", *fields])

    schema = "file string, at long, " + ", ".join(f"{f} string" for f in FIELDS) + ", bytes long, sha1 string" + ", payload binary" * payloads
    return joined.mapInArrow(run, schema)


def resolved(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of response and revisit records; a revisit has its response's payload."""
    page = F.col("page").cast("long")
    own = records.where("type = 'response'")
    answers = own.select(F.col("record_id").alias("refers"), page.alias("r_page"), F.col("bytes").alias("r_bytes"), F.col("sha1").alias("r_sha1"))
    again = records.where("type = 'revisit'").select(page.alias("page_id"), "refers")
    wanted = answers.join(again.select("refers").distinct(), "refers", "left_semi").groupBy("refers").agg(*[F.max(c).alias(c) for c in ("r_page", "r_bytes", "r_sha1")])
    again = again.join(stage(wanted, "warc-responses"), "refers")
    rows = own.select(page.alias("page_id"), F.col("bytes").alias("payload_bytes"), F.col("sha1").alias("payload_digest"), F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    return rows.unionByName(again.select("page_id", F.col("r_bytes").alias("payload_bytes"), F.col("r_sha1").alias("payload_digest"), F.lit("revisit").alias("record_type"), F.col("r_page").alias("refers_to")))


def archive(pages: DataFrame, least: int = 0, per_file: int = 4096, payloads: bool = False) -> DataFrame:
    """The pages written to archives in the shared folder and read back: a row for each record."""
    path = new_path(pages.sparkSession, "warc")
    write_archives(pages, path, least, per_file)
    return read_archives(pages.sparkSession, path, payloads)

