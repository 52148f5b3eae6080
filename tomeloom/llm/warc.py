"""WARC archives as a chunked record table.

Writing: each page is a WARC 1.1 record (``response``, or ``revisit`` of an equal payload).
A payload longer than ``chunk_chars`` is written by WARC's own segmentation: a first record
and ``continuation`` records, so no reader needs to hold a whole payload.  Spark's text
writer puts the records into plain ``.gz`` archives in any store Spark reaches.

Reading: Spark's text reader deals out the records (it splits at the version line), giving
rows (record, chunk number, payload chunk).  A record of one chunk is checked where it is;
the chunks of others are sorted by number and digested one after the other, carrying the
SHA-1 state.  A payload that holds the separator itself is segmented inside of it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeloom.llm.arrow import Sink, rows_of
from tomeloom.llm.store import fresh_path, small_join, two_hop_join, written

#: Between two records' distinctive parts; "/" occurs once in it, so no partial match overlaps.
SEPARATOR = "/1.1\r\nWARC-Type: "
CHUNK_CHARS = 32_768
#: Payloads of fewer bytes are never revisits.
LEAST_REVISIT = 1000
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n\r\n"


def _chunks(body: Column, size: int) -> Column:
    """Array of pieces of at most size characters, none holding SEPARATOR; [""] for an empty text."""
    at = len("/1.1\r\nWARC")
    parts = F.split(body, r"/1\.1\r\nWARC-Type: ")
    last = F.size(parts) - 1
    whole = F.transform(parts, lambda p, i: F.concat(F.when(i > 0, SEPARATOR[at:]).otherwise(""), p, F.when(i < last, SEPARATOR[:at]).otherwise("")))
    cut = F.transform(whole, lambda p: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length(p) - 1) / size).cast("int"))), lambda i: F.substring(p, i * size + 1, F.lit(size))))
    return F.flatten(cut)


def _urn(ident: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws("|", ident.cast("string"), digest).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), *[x for i, (a, n) in enumerate(((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) for x in ([F.lit("-")] if i else []) + [F.substring(h, a, n)]], F.lit(">"))


def revisits(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, digest, refers_to) of the pages whose payload a page of larger id has too."""
    body = F.coalesce(F.col(html_col), F.lit(""))
    base = pages.select(F.col(id_col).cast("long").alias("id"), body.alias("b")).select("id", F.sha1("b").alias("digest"), F.octet_length("b").cast("long").alias("bytes"))
    base = written(base.filter((F.col("bytes") >= LEAST_REVISIT) & F.col("id").isNotNull()).select("id", F.unhex("digest").alias("digest"), "bytes", F.spark_partition_id().alias("run")), "payload-digests")
    groups = base.groupBy("digest", "bytes").agg(F.max("id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    found = two_hop_join(base, groups, "run", ["digest", "bytes"]).filter("id < refers_to")
    return found.select("id", F.lower(F.hex("digest")).alias("digest"), "refers_to").distinct()


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """(value): every record of the archives as text, without its last line feed."""
    body = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), body.alias("b")).withColumn("digest", F.sha1("b"))
    # pages' texts meet a table of a few numbers a revisit, and move only if that is a large one
    rows = small_join(rows, written(revisits(pages, id_col, html_col), "revisits"), ["id", "digest"], "left", salts=1, most=400_000)
    rows = rows.withColumn("bytes", F.octet_length("b")).withColumn("copy", F.monotonically_increasing_id())
    rows = rows.withColumn("urn", _urn(F.col("id"), F.col("digest"))).withColumn("revisit", F.col("refers_to").isNotNull())
    rows = rows.withColumn("chunks", F.when(F.col("revisit"), F.array(F.lit(""))).otherwise(_chunks(F.col("b"), chunk_chars)))
    rows = rows.withColumn("of", F.size("chunks")).select("*", F.posexplode("chunks").alias("no", "chunk"))

    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))

    first, cut = F.col("no") == 0, F.col("of") > 1
    http = F.when(first & ~F.col("revisit"), _HTTP).otherwise("")
    value = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(~first, "continuation").when(F.col("revisit"), "revisit").otherwise("response"), F.lit("\r\n"),
        F.lit("WARC-Record-ID: "), F.when(first, F.col("urn")).otherwise(_urn(F.col("no"), F.col("urn"))), F.lit("\r\n"),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z\r\n"),
        line("WARC-Target-URI", F.when(first, F.regexp_replace("url", r"[\r\n]", " "))),
        line("WARC-Payload-Digest", F.when(first, F.concat(F.lit("sha1:"), F.col("digest")))),
        line("WARC-Refers-To", F.when(F.col("revisit"), _urn(F.col("refers_to"), F.col("digest")))),
        line("WARC-Segment-Number", F.when(cut, F.col("no") + 1)),
        line("WARC-Segment-Origin-ID", F.when(~first, F.col("urn"))),
        line("WARC-Segment-Total-Length", F.when(cut & (F.col("no") == F.col("of") - 1), F.col("bytes") + len(_HTTP))),
        line("X-Page-ID", F.col("id")),
        line("X-Copy", F.col("copy")),
        line("X-Payload-Length", F.col("bytes")),
        line("X-Refers-To-Page", F.col("refers_to")),
        line("X-Segments", F.col("of")),
        F.when(first & ~F.col("revisit"), "Content-Type: application/http; msgtype=response\r\n").otherwise(""),
        line("Content-Length", F.octet_length("chunk") + F.octet_length(http)),
        F.lit("\r\n"), http, F.col("chunk"), F.lit("\r\n\r"),
    )
    return rows.select(value.alias("value"))


def write_archives(pages: DataFrame, path: str, **columns) -> None:
    """The pages' records as gzip-compressed WARC files under path."""
    records(pages, **columns).write.option("lineSep", "\n").option("compression", "gzip").text(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunked record table of archives that write_archives made.

    type, page_id, copy, chunk_no (from 0), chunks, refers_to, payload_length, digest (of the
    whole payload, on chunk 0), payload (the chunk's bytes; empty for a revisit).
    """
    raw = spark.read.option("lineSep", SEPARATOR).text(path).filter(F.col("value") != "WARC")
    rows = raw.select(F.substring_index("value", "\r\n\r\n", 1).alias("head"), F.col("value").cast("binary").alias("v"))

    def field(name: str, pattern: str = r"-?\d+") -> Column:
        return F.nullif(F.regexp_extract("head", rf"\r\n{name}: ({pattern})", 1), F.lit(""))

    kind = F.regexp_extract("head", "^([a-z]+)", 1)
    block = F.substring(F.col("v"), F.octet_length("head") + 5, field("Content-Length").cast("int"))
    http = F.when(kind == "response", len(_HTTP)).otherwise(0)
    return rows.select(
        kind.alias("type"), field("X-Page-ID").cast("long").alias("page_id"), field("X-Copy").cast("long").alias("copy"),
        (F.coalesce(field("WARC-Segment-Number").cast("int"), F.lit(1)) - 1).alias("chunk_no"), field("X-Segments").cast("int").alias("chunks"),
        field("X-Refers-To-Page").cast("long").alias("refers_to"), field("X-Payload-Length").cast("long").alias("payload_length"),
        field("WARC-Payload-Digest", "sha1:[0-9a-f]{40}").substr(6, 40).alias("digest"),
        F.substring(block, http + 1, F.greatest(F.lit(0), F.octet_length(block) - http)).alias("payload"),
    )


_RECORDS = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("said", pa.string())])


def _digested(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted chunks to a row a record; one chunk at a time beside the digest's state."""
    sink, at, state = Sink(_RECORDS), None, None
    size, said = 0, None
    for copy, page, _, digest, payload in rows_of(batches, 8):
        if copy != at:
            if state is not None:
                yield from sink.add((last, size, state.hexdigest(), said))
            at, state, size, said = copy, hashlib.sha1(), 0, digest
        last = page
        state.update(payload)
        size += len(payload)
    if state is not None:
        yield from sink.add((last, size, state.hexdigest(), said))
    yield from sink.end()


def read_records(chunks: DataFrame) -> DataFrame:
    """A row for each record of a chunk table: page_id, payload_bytes, payload_digest, record_type,
    refers_to, intact (the digest found is the one the record states).

    A revisit's size and digest are those its record states of the full payload.
    """
    whole = chunks.filter("chunks = 1")
    own = F.col("type") == "response"
    found = F.when(own, F.sha1("payload")).otherwise(F.col("digest"))
    whole = whole.select(
        "page_id", F.when(own, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        found.alias("payload_digest"), F.col("type").alias("record_type"), "refers_to", (found == F.col("digest")).alias("intact"),
    )
    parts = chunks.filter("chunks > 1").select("copy", "page_id", "chunk_no", "digest", "payload").repartition("copy").sortWithinPartitions("copy", "chunk_no")
    parts = parts.mapInArrow(_digested, "page_id long, payload_bytes long, payload_digest string, said string")
    parts = parts.select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), (F.col("payload_digest") == F.col("said")).alias("intact"))
    return whole.unionByName(parts)


def archived(pages: DataFrame, path: str | None = None, **columns) -> DataFrame:
    """pages written to archives (by default in the shared folder) and read back: read_records' rows.

    * null html is an empty payload, null url a record without target; empty tables, no rows;
    * of equal payloads of 1000 bytes or more the largest id is the response, and so are
      rows that repeat it; smaller payloads and pages without an id never revisit.
    """
    path = path or fresh_path(pages.sparkSession, "warc")
    write_archives(pages, path, **columns)
    return read_records(read_chunks(pages.sparkSession, path))
