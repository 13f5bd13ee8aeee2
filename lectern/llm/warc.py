"""WARC archives: writing captures as request, response or revisit, and metadata; reading and joining them."""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.scratch import new_path, written

CRLF = "\r\n"
#: Equal payloads from this size on are stored once.
LEAST_SHARED = 100
RECORDS = (
    "record_id string, record_type string, concurrent_to string, refers_to string, target_uri string, "
    "payload_digest string, payload_bytes long, stored_digest string, fields map<string,string>"
)


def _urn(kind: str, *parts: Column) -> Column:
    h = F.md5(F.concat_ws(" ", F.lit(kind), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _record(kind: Column, record_id: Column, mime: str, block: Column, *headers: tuple[str, Column]) -> Column:
    """A record up to, and without, the two line ends that close it. Headers with null values are left out."""
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)))
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), kind, F.lit(f"{CRLF}WARC-Record-ID: "), record_id, F.lit(CRLF),
        F.concat_ws("", *[line(n, v) for n, v in headers]),
        F.lit(f"Content-Type: {mime}{CRLF}Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF * 2), block,
    )


def size_classes(per_file: int, most_bytes: int) -> list[tuple[int, int]]:
    """(bytes, records): pages of up to so many bytes go into archives of up to so many records, three a page. The payloads of an archive are at most about
    most_bytes, or those of one page."""
    out = []
    while not out or out[-1][1] > 3:
        records = max(3, per_file // 16 ** len(out) // 3 * 3)
        out.append((3 * most_bytes // records, records))
    return out


def write_archives(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", per_file: int = 15_000, most_bytes: int = 1 << 30) -> None:
    """Writes gzipped archives of up to per_file records to folders in path: three records for each row of pages. Pages of very many bytes
    go into folders of their own, with fewer records an archive, so that its payloads stay below most_bytes: a task reads an archive at a time. A single page is
    bounded by what a string of Spark can hold, 2 GB.

    Spark's text writer does it, with a record's closing line ends as the line separator, so archives are committed
    as whole files in any file system and a lost task leaves none. The page with the least id of equal payloads of
    LEAST_SHARED bytes or more is a response, and the others revisit it; smaller payloads are all
    responses. Nulls: no html is an empty payload, no url leaves out the target. Line ends in a url are
    percent-encoded. Repeated rows are records of their own, and all of them are responses if the first is.
    """
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    rows = pages.select("page_id", url.alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("bytes", F.octet_length("html")).withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    # What is to be known of each page is found on narrow rows; the html is then shuffled once, and never sorted:
    # each partition holds the narrow rows of its pages in a hash table. Only repeated rows of a page are numbered by a sort.
    keys = rows.groupBy("page_id", "digest", "bytes").agg(F.count(F.lit(1)).alias("rows"))
    firsts = keys.where(F.col("bytes") >= LEAST_SHARED).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    known = keys.join(firsts, "digest", "left").select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "rows", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("first"))
    known = written(known, "pages")
    classes = size_classes(per_file, most_bytes)
    of_size = F.coalesce(*[F.when(F.col("bytes") <= most, F.lit(k)) for k, (most, _) in enumerate(classes)], F.lit(len(classes) - 1))
    present = sorted(r["k"] for r in keys.select(of_size.alias("k")).distinct().collect()) or [0]
    for k in present:
        some = rows.where(of_size == k) if len(present) > 1 else rows
        _write(some, known, f"{path}/size={k}", date, classes[k][1])


def _write(rows: DataFrame, known: DataFrame, path: str, date: str, per_file: int) -> None:
    of = lambda some: rows.join(some.hint("shuffle_hash"), rows["page_id"].eqNullSafe(some["p"]) & (rows["digest"] == some["d"]))
    repeated = of(known.where("rows > 1")).withColumn("copy", F.row_number().over(Window.partitionBy("page_id", "digest").orderBy("url")))
    rows = of(known.where("rows = 1")).withColumn("copy", F.lit(1)).unionByName(repeated)

    revisit = F.col("first").isNotNull()
    here = lambda kind: _urn(kind, F.col("page_id"), F.col("digest"), F.col("copy"))
    main = here("capture")
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF * 2))
    common = [("WARC-Date", F.lit(date)), ("WARC-Target-URI", F.col("url"))]
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest")))
    capture = _record(
        F.when(revisit, "revisit").otherwise("response"), main, "application/http;msgtype=response",
        F.concat(head, F.when(revisit, "").otherwise(F.col("html"))), *common, digest,
        ("WARC-Refers-To", F.when(revisit, _urn("capture", F.col("first"), F.col("digest"), F.lit(1)))),
        ("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
    )
    request = _record(
        F.lit("request"), here("request"), "application/http;msgtype=request",
        F.concat(F.lit("GET "), F.coalesce("url", F.lit("/")), F.lit(f" HTTP/1.1{CRLF * 2}")), *common, ("WARC-Concurrent-To", main),
    )
    fields = F.concat(
        F.concat_ws("", F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit(CRLF))),
        F.lit("payload-bytes: "), F.col("bytes").cast("string"), F.lit(CRLF),
    )
    metadata = _record(F.lit("metadata"), here("metadata"), "application/warc-fields", fields, *common, ("WARC-Concurrent-To", main))
    records = rows.select(F.explode(F.array(request, capture, metadata)).alias("value"))
    records.write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of a decompressed archive: headers by lower-case name, and the block."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        headers = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.partition(b":")
            headers[name.strip().lower().decode()] = value.strip().decode("utf-8", "replace")
        yield headers, stream.read(int(headers.get("content-length", 0)))


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in RECORDS.replace("map<string,string>", "map").split(", ")]
    for batch in batches:
        for content in batch["content"]:
            data = io.BytesIO(content)
            stream = io.BufferedReader(gzip.GzipFile(fileobj=data)) if content[:2] == b"\x1f\x8b" else data
            out = []
            for h, block in parse(stream):
                kind, payload, fields = h.get("warc-type"), None, {}
                if kind == "response":
                    payload = block.partition(b"\r\n\r\n")[2]
                elif kind == "metadata":
                    fields = dict(x.split(": ", 1) for x in block.decode("utf-8", "replace").split(CRLF) if ": " in x)
                out.append((
                    h.get("warc-record-id"), kind, h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"),
                    None if payload is None else hashlib.sha256(payload).hexdigest(), -1 if payload is None else len(payload),
                    h.get("warc-payload-digest", "").removeprefix("sha256:") or None, fields,
                ))
                if len(out) >= 5000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            yield pd.DataFrame(out, columns=names)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives at path (gzipped or plain); payloads are hashed and measured, not kept."""
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(_rows, RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture (the response or revisit), request, metadata, original.

    Requests and metadata join the response or revisit that their WARC-Concurrent-To names, a revisit joins the
    response that its WARC-Refers-To names. A capture without one of them has null there; records whose
    capture is missing are left out. A response's digest and size come from its payload.
    """
    whole = lambda name: F.struct("record_id", "record_type", "concurrent_to", "refers_to", "target_uri", "payload_digest", "payload_bytes", "stored_digest", "fields").alias(name)
    captures = records.where(F.col("record_type").isin("response", "revisit")).select(whole("capture"))
    requests = records.where("record_type = 'request'").select(F.col("concurrent_to").alias("q"), whole("request"))
    metadata = records.where("record_type = 'metadata'").select(F.col("concurrent_to").alias("m"), whole("metadata"))
    joined = captures.join(requests, F.col("capture.record_id") == F.col("q"), "left").join(metadata, F.col("capture.record_id") == F.col("m"), "left").drop("q", "m")
    joined = written(joined, "captures")
    originals = joined.where("capture.record_type = 'response'").select(
        F.struct(F.col("capture.record_id").alias("record_id"), F.col("capture.payload_digest").alias("payload_digest"), F.col("capture.payload_bytes").alias("payload_bytes"), F.col("metadata.fields").alias("fields")).alias("original")
    )
    return joined.join(originals, F.col("capture.refers_to") == F.col("original.record_id"), "left")


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """One row per row of pages, from archives written to path and read back: page_id, payload_bytes,
    payload_digest, record_type, refers_to, target_uri, request_id, digest_ok.

    No rows: no archives' records, and no rows. See write_archives for nulls, ties and repeated rows.
    """
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write_archives(pages, path)
    records = written(read_records(spark, path), "records")
    page = lambda fields: F.try_element_at(fields, F.lit("page-id")).cast("long")
    revisit = F.col("capture.record_type") == "revisit"
    value = lambda name: F.when(revisit, F.col(f"original.{name}")).otherwise(F.col(f"capture.{name}"))
    return assemble(records).select(
        page(F.col("metadata.fields")).alias("page_id"), value("payload_bytes").alias("payload_bytes"), value("payload_digest").alias("payload_digest"),
        F.col("capture.record_type").alias("record_type"), F.when(revisit, page(F.col("original.fields"))).alias("refers_to"),
        F.col("capture.target_uri").alias("target_uri"), F.col("request.record_id").alias("request_id"),
        (value("payload_digest") == F.col("capture.stored_digest")).alias("digest_ok"),
    )
