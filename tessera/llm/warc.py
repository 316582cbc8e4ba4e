"""WARC archives: written by Spark's own writer, read back by verifying the chain of record boundaries.

How it scales: archives are read in splits at any byte. Each place where a record might begin is a candidate with the offset of its successor; pointer jumping from
the start of each file keeps the candidates that the chain reaches, in as many rounds as the logarithm of records in a file. Only offsets take part in that.
Payloads are digested where they are read; only those that contain a boundary themselves are put together afterwards.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.store import dropped, new_path, saved

#: What comes between records, where text is cut into candidates. A header has no empty line, so it is never cut.
MAGIC = b"WARC/1."
CUT = b"\r\n\r\n" + MAGIC
#: The least payload that a revisit record may stand for.
LEAST_REVISIT = 100
#: Bytes of an archive in one bucket when payloads are put together, and rows of a list that may be broadcast (about 200 bytes each).
BUCKET, MAX_BROADCAST = 1 << 20, 100_000
DATE = "1970-01-01T00:00:00Z"


def _uri(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(F.url_encode(page_id.cast("string")), F.lit("")), F.lit(">"))


def write(pages: DataFrame, path: str, date: str = DATE) -> None:
    """Archives in the folder `path`: a record for each row of `pages` (page_id, url, html).

    Of rows with equal payloads of LEAST_REVISIT bytes or more the one with the smallest page_id is a response, the others revisit it without a body; smaller ones
    are all responses. Null html is an empty payload; a null page_id is written as none, and revisits if an equal payload has one.
    """
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    first = pages.where(F.octet_length("html") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    first = saved(first, "repeated")  # payloads that occur once need no company: few enough of the others travel to the pages, else the pages to them
    first = F.broadcast(first) if first.count() <= MAX_BROADCAST else first
    pages = pages.join(first, "digest", "left").withColumn("again", F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")))
    size = F.octet_length("html").cast("string")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(F.col("again"), F.lit("")).otherwise(F.col("html")))
    url = F.regexp_replace(F.coalesce("url", F.lit("urn:x-none:")), r"[\x00-\x20\x7F]+", "%20")
    refers = F.when(F.col("again"), F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), _uri(F.col("first")))).otherwise("")
    lines = [
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(F.col("again"), "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "),
        _uri(F.col("page_id")),
        F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "),
        url,
        F.lit("\r\nWARC-Payload-Digest: sha256:"),
        F.col("digest"),
        refers,
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"),
        F.lit("\r\n\r\n"),
        block,
    ]
    pages.select(F.concat(*lines).alias("value")).write.option("lineSep", "\r\n\r\n").text(path)


def _header(body: bytes) -> tuple[dict[bytes, bytes], int]:
    """(fields with names in lower case, where the content begins) of a record after its magic."""
    end = body.find(b"\r\n\r\n")
    lines = (body if end < 0 else body[:end]).split(b"\r\n")[1:]
    fields = {k.strip().lower(): v.strip() for k, sep, v in (x.partition(b":") for x in lines) if sep}
    return fields, len(body) + 4 if end < 0 else end + 4


def _record(fields: dict[bytes, bytes], content: bytes) -> tuple:
    """(id, kind, payload_bytes, payload_digest, refers, intact) of a whole record; a revisit has those of the payload that it stands for."""
    name = lambda k: m[1].decode() if (m := re.fullmatch(rb"<urn:x-page:(.+)>", fields.get(k, b""))) else None
    head, _, payload = content.partition(b"\r\n\r\n")
    kind, said = fields.get(b"warc-type", b"").decode("latin-1"), fields.get(b"warc-payload-digest", b"").decode("latin-1").removeprefix("sha256:")
    if kind == "revisit":
        size = re.search(rb"(?i)^content-length: *(\d+)\r?$", head, re.M)
        return name(b"warc-record-id"), kind, int(size[1]) if size else None, said, name(b"warc-refers-to"), True
    digest = sha256(payload).hexdigest()
    return name(b"warc-record-id"), kind, len(payload), digest, None, digest == said


_FIELDS = "id string, record_type string, payload_bytes long, payload_digest string, refers string, intact boolean"
_TYPES = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.bool_()]


def _cuts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", CUT.decode()).text(path).select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, int, bytes, bool]]:
    """(file, block, offset of the magic in the split, offset of the next, body after the magic, whether there was a magic)."""
    at, now = 0, None
    for batch in batches:
        for value, file, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now != (file, block):
                at, now = 0, (file, block)
            begins = block > 0 or at > 0
            body = value if begins else value[len(MAGIC) :]
            start = at - len(MAGIC) if begins else at
            magic = begins or value.startswith(MAGIC)
            at += len(value) + len(CUT)
            yield file, block, start, at - len(MAGIC), body, magic


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, place, next_place, successor, whole, ...) of every place where a record may begin; places count from the start of the split's first cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for file, block, place, after, body, magic in _places(batches):
            fields, content = _header(body)
            length = fields.get(b"content-length", b"")
            good = magic and length.isdigit()
            size = int(length) if good else 0
            whole = good and content + size <= len(body) or good and not size
            record = _record(fields, body[content : content + size]) if whole else (None,) * 6
            rows.append((file, block, place, after, place + len(MAGIC) + content + size + 4 if good else None, whole, *record))
            if len(rows) == 2000:
                yield table(rows)
                rows = []
        if rows:
            yield table(rows)

    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), *_TYPES]
    schema = f"file string, block long, place long, next_place long, successor long, whole boolean, {_FIELDS}"
    names = [x.split()[0] for x in schema.split(", ")]
    table = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
    return _cuts(spark, path).mapInArrow(run, schema)


def _bases(found: DataFrame) -> DataFrame:
    """(file, block, base): where each split's places begin in its file. A split is a row here."""
    from pyspark.sql import Window

    size = found.groupBy("file", "block").agg(F.max("next_place").alias("size"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # next_place of the last cut is where the next split's first magic stands; that split counts from 7 bytes further
    return size.select("file", "block", (F.coalesce(F.sum(F.col("size") + F.lit(len(MAGIC))).over(before), F.lit(0))).alias("base"))


def reached(nodes: DataFrame) -> DataFrame:
    """(file, at) of the `nodes` (file, at, successor) on the chain from offset 0 of their file, by pointer jumping: each round doubles the steps taken."""
    state = saved(nodes.select("file", "at", F.col("successor").alias("jump"), (F.col("at") == 0).alias("on")), "chain")
    count = -1
    while True:
        now = state.agg(F.sum(F.col("on").cast("long"))).first()[0] or 0
        if now == count:
            return state.where("on").select("file", "at")
        count = now
        hit = state.where("on and jump is not null").select("file", F.col("jump").alias("at"), F.lit(True).alias("hit")).distinct()
        far = state.select("file", F.col("at").alias("jump"), F.col("jump").alias("far"))
        after = state.join(hit, ["file", "at"], "left").join(far, ["file", "jump"], "left").select("file", "at", F.col("far").alias("jump"), (F.col("on") | F.col("hit").isNotNull()).alias("on"))
        after = saved(after, "chain")
        dropped(state)
        state = after


def _assembled(spark: SparkSession, path: str, spans: DataFrame, bases: DataFrame) -> DataFrame:
    """(file, at, ...) of records whose content holds boundaries: their cuts, in order, make the content."""

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, block, place, _, body, _ in _places(batches):
            yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block], pa.int64()), pa.array([place], pa.int64()), pa.array([body], pa.binary())], ["file", "block", "place", "body"])

    cuts = _cuts(spark, path).mapInArrow(bodies, "file string, block long, place long, body binary").join(bases, ["file", "block"])
    cuts = cuts.select("file", (F.col("base") + F.col("place")).alias("spot"), "body").withColumn("bucket", F.floor(F.col("spot") / BUCKET))
    wide = spans.select("file", "at", "successor", F.explode(F.sequence(F.floor(F.col("at") / BUCKET), F.floor(F.col("successor") / BUCKET))).alias("bucket"))
    wide = F.broadcast(wide) if wide.count() <= MAX_BROADCAST else wide
    parts = cuts.join(wide, ["file", "bucket"]).where("spot >= at and spot < successor").select("file", "at", "spot", "body")

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("spot")
        body = CUT.join(group.column("body").to_pylist())
        fields, content = _header(body)
        record = _record(fields, body[content : content + int(fields[b"content-length"])])
        return pa.table([group.column("file").slice(0, 1), group.column("at").slice(0, 1), *(pa.array([x], t) for x, t in zip(record, _TYPES, strict=True))], names=["file", "at", *(x.split()[0] for x in _FIELDS.split(", "))])

    return parts.groupBy("file", "at").applyInArrow(run, f"file string, at long, {_FIELDS}")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, id, record_type, payload_bytes, payload_digest, refers, intact) of each record of the archives in `path`.

    A file that does not begin with a record has none; what follows a record with a wrong length is not reached. `intact` says that the payload has its digest.
    """
    found = saved(candidates(spark, path), "candidates")
    bases = saved(_bases(found), "bases")
    placed = found.join(bases, ["file", "block"]).withColumn("at", F.col("base") + F.col("place")).withColumn("successor", F.col("base") + F.col("successor")).where("successor is not null")
    chain = reached(placed.select("file", "at", "successor"))
    records = placed.join(chain, ["file", "at"])
    names = ["file", "at", *(x.split()[0] for x in _FIELDS.split(", "))]
    out = records.where("whole").select(names)
    spans = saved(records.where("not whole").select("file", "at", "successor"), "spans")
    return out.unionByName(_assembled(spark, path, spans, bases)) if spans.limit(1).count() else out


def archived(pages: DataFrame, date: str = DATE) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, intact) of each row of `pages` (page_id, url, html), written to archives and read back.

    See `write` for which are revisits, and for nulls. An empty table gives no rows; repeated rows each have a record; other columns are not read.
    """
    spark, kind = pages.sparkSession, pages.schema["page_id"].dataType
    path = new_path(spark, "archives")
    write(pages.select("page_id", "url", "html"), path, date)
    found = read(spark, path)
    own = lambda c: F.url_decode(F.col(c)).cast(kind)
    return found.select(own("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", own("refers").alias("refers_to"), "intact")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, octet_length(encode(payload))::BIGINT AS payload_bytes, sha256(payload) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to, true AS intact
FROM f
"""
