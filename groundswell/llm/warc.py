"""WARC archives: writing pages as captures, reading records back, and assembling transactions.

A capture is three records: the response (or, for a payload that an earlier capture holds, a revisit), the request
and the metadata. The last two name the first in WARC-Concurrent-To; assembly joins them through it and gives one
nested row a capture, with all its requests and all its metadata. A record may name several captures, and a capture
may name its requests instead.

Archives are written by Spark's own text sink (the record separator is its line separator), so they may lie in any
store that Spark writes to; each is gzip-compressed. They are read as whole files and parsed as a stream by
Content-Length, one file in memory at a time. A file's bytes are bounded: pages above SMALL bytes have files of their
own, and the pages in a file are so few that even the largest ones would fit in FILE_MOST.

Payloads are dealt once, by their row; who is the response of a payload is found out without them.

Defined results: a null html is an empty payload. A null page_id is the last to become a response and is never
referred to by number. Of rows with equal ids and payloads the one with the smallest URL (null first) counts as the
smallest; of rows that are equal in all three, any one. Line breaks and other control characters in a URL are dropped
from the header. Extra columns are not archived.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import joined, scratch_path, stored, table

CRLF = "\r\n"
SMALL = 256 << 10
FILE = 64 << 20  # bytes of a file, about, before compression
FILE_MOST = 1 << 30
CAPTURES = ("response", "revisit")
KEYS = ["k1", "k2"]
LEAST_REVISIT = 100
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "warc_type string, record_id string, concurrent_to array<string>, refers_to_id string, target_uri string, page_id long, payload_bytes long, payload_digest string, declared_digest string"


def urn(*parts: Column) -> Column:
    """A record id from what identifies the record."""
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]))
    cuts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def record(kind: str | Column, record_id: Column, headers: list[tuple[str, Column]], content_type: str, block: Column) -> Column:
    """A record without the separator that ends it; headers whose value is null are left out."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), record_id), F.lit(f"WARC-Date: {DATE}")]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in headers]
    lines += [F.lit(f"Content-Type: {content_type}"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF), block)


def keyed(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) with bytes, digest and two hashes that tell rows apart."""
    full = pages.select("page_id", F.regexp_replace("url", r"\p{Cntrl}", "").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    full = full.withColumns({"digest": F.sha2(F.encode("html", "UTF-8"), 256), "bytes": F.octet_length("html").cast("long")})
    return full.withColumns({"k1": F.xxhash64("page_id", "url", "digest"), "k2": F.xxhash64(F.lit(1), "digest", "url", "page_id")})


def payload_facts(pages: DataFrame) -> DataFrame:
    """A row for each different row of pages, without its payload: k1, k2, page_id, url, digest, bytes, and n, how often it is there."""
    facts = keyed(pages).groupBy(*KEYS, "page_id", "url", "digest", "bytes").agg(F.count(F.lit(1)).alias("n"))
    return stored(facts, "payloads")


def repeated(facts: DataFrame) -> DataFrame:
    """k1, k2 of rows whose payload others have as well, with the page (first_page, first_url) whose capture is its response."""
    rank = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "url")
    large = facts.where(F.col("bytes") >= LEAST_REVISIT)
    firsts = stored(large.groupBy("digest").agg(F.min(rank).alias("first"), F.sum("n").alias("copies"), F.count(F.lit(1)).alias("n")).where("copies > 1"), "firsts")
    met = joined(large.select(*KEYS, "digest"), firsts.select("digest", "first"), ["digest"], firsts.select("digest", "n"))
    return met.select(*KEYS, F.col("first.page_id").alias("first_page"), F.col("first.url").alias("first_url"), F.lit(True).alias("shared"))


def captures(pages: DataFrame, facts: DataFrame, low: int, high: int | None) -> DataFrame:
    """The captures of pages of more than low and at most high bytes: page_id, url, digest, bytes, copy (among equal rows), revisit,
    first_page, first_url, and html, which is empty for revisits."""
    size = F.col("bytes") > low if high is None else F.col("bytes").between(low + 1, high)
    rows = keyed(pages).where(size)
    again = facts.where(size & (F.col("n") > 1)).select(*KEYS, "n")
    if again.isEmpty():
        some = rows.withColumn("copy", F.lit(0).cast("long"))
    else:  # one of equal rows stands for all
        one = joined(rows, again, KEYS, again).dropDuplicates(KEYS)
        copies = one.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).drop("n")
        some = rows.join(again.select(*KEYS), KEYS, "left_anti").withColumn("copy", F.lit(0).cast("long")).unionByName(copies)
    met = some.join(repeated(facts), KEYS, "left")
    own = F.col("page_id").eqNullSafe(F.col("first_page")) & F.col("url").eqNullSafe(F.col("first_url")) & (F.col("copy") == 0)
    met = met.withColumn("revisit", F.coalesce("shared", F.lit(False)) & ~own).drop("shared", *KEYS)
    return met.withColumn("html", F.when(F.col("revisit"), F.lit("")).otherwise(F.col("html")))


def write_archives(pages: DataFrame, path: str) -> None:
    """Three records for each page, as gzip-compressed WARC files under path/small and path/large."""
    facts = payload_facts(pages)
    big = F.col("bytes") > SMALL
    kinds = {r["big"]: r for r in facts.groupBy(big.alias("big")).agg(F.max("bytes").alias("most"), F.avg("bytes").alias("mean")).collect()}
    for name, is_big, low, high in (("small", False, -1, SMALL), ("large", True, SMALL, None)):
        if is_big not in kinds and (is_big or kinds):
            continue  # an empty table still has a folder
        each = 1000 + (kinds[is_big]["mean"] if kinds else 0)  # headers count as well
        most = 1000 + (kinds[is_big]["most"] if kinds else 0)
        pages_a_file = max(1, min(int(FILE // each), int(FILE_MOST // most)))
        records(captures(pages, facts, low, high)).write.option("lineSep", CRLF + CRLF).option("compression", "gzip").option("maxRecordsPerFile", 3 * pages_a_file).text(f"{path}/{name}")


def records(c: DataFrame) -> DataFrame:
    """value: the response or revisit, the request and the metadata of each capture."""
    page, digest = F.col("page_id"), F.col("digest")
    row = (page, F.col("url"), digest, F.col("copy"))
    own = urn(F.lit("capture"), *row)
    first = urn(F.lit("capture"), F.col("first_page"), F.col("first_url"), digest, F.lit(0))
    uri, sha = ("WARC-Target-URI", F.col("url")), ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest))
    http = F.concat(F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF + "Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF + CRLF))
    response = record("response", own, [uri, sha], "application/http; msgtype=response", F.concat(http, F.col("html")))
    revisit = record("revisit", own, [uri, sha, ("WARC-Profile", F.lit(PROFILE)), ("WARC-Refers-To", first)], "application/http; msgtype=response", http)
    near = ("WARC-Concurrent-To", own)
    asked = F.concat(F.lit("GET "), F.coalesce("url", F.lit("/")), F.lit(" HTTP/1.1" + CRLF + CRLF))
    request = record("request", urn(F.lit("request"), *row), [uri, near], "application/http; msgtype=request", asked)
    about = F.coalesce(F.concat(F.lit("page-id: "), page.cast("string"), F.lit(CRLF)), F.lit(""))
    metadata = record("metadata", urn(F.lit("metadata"), *row), [uri, near], "application/warc-fields", about)
    return c.select(F.explode(F.array(F.when(F.col("revisit"), revisit).otherwise(response), request, metadata)).alias("value"))


def parsed(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, list[str]], bytes]]:
    """Headers (lower-case names, each with all its values) and block of each record of a decompressed archive."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not the start of a record: {line[:60]!r}")
        headers: dict[str, list[str]] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers.setdefault(name.strip().lower(), []).append(value.strip())
        yield headers, stream.read(int(headers["content-length"][0]))


def read_records(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """A row for each record; responses with size and SHA-256 of the payload as read, and the payload itself if asked for."""
    schema = RECORD + (", payload binary" if payload else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows: list[list] = []
                held = 0
                for headers, block in parsed(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content.as_py())))):
                    h = {name: values[0] for name, values in headers.items()}
                    row = dict.fromkeys(names) | {"warc_type": h.get("warc-type"), "record_id": h.get("warc-record-id"), "concurrent_to": headers.get("warc-concurrent-to", []), "refers_to_id": h.get("warc-refers-to"), "target_uri": h.get("warc-target-uri")}
                    row["declared_digest"] = h.get("warc-payload-digest", "").removeprefix("sha256:") or None
                    if row["warc_type"] == "response":
                        body = block.partition(b"\r\n\r\n")[2]
                        row |= {"payload_bytes": len(body), "payload_digest": hashlib.sha256(body).hexdigest()} | ({"payload": body} if payload else {})
                        held += len(body) * payload
                    elif row["warc_type"] == "metadata":
                        fields = dict(x.partition(b":")[::2] for x in block.split(b"\r\n") if x)
                        row["page_id"] = int(fields[b"page-id"]) if b"page-id" in fields else None
                    rows.append([row[n] for n in names])
                    if len(rows) >= 5000 or held > 32_000_000:
                        yield as_batch(rows)
                        rows, held = [], 0
                if rows:
                    yield as_batch(rows)

    def as_batch(rows: list[list]) -> pa.RecordBatch:
        kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary(), "concurrent_to": pa.list_(pa.string())}
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=kinds.get(n, pa.string())) for i, n in enumerate(names)], names=names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(run, schema)


def assembled(records: DataFrame) -> DataFrame:
    """One nested row for each capture: capture_id, capture, requests and metadata (arrays, by record id). Records that name no
    capture that is there, and that none names, are left out; captures of one record id get a row each."""
    row = F.struct("record_id", *[c for c in records.columns if c not in ("record_id", "concurrent_to")])
    own = F.col("warc_type").isin(*CAPTURES)
    heads = records.where(own).select(F.col("record_id").alias("capture_id"), row.alias("r"))
    others = records.where(~own & F.col("warc_type").isin("request", "metadata"))
    links = others.select(F.explode("concurrent_to").alias("capture_id"), row.alias("r"))
    named = records.where(own & (F.size("concurrent_to") > 0)).select(F.col("record_id").alias("capture_id"), F.explode("concurrent_to").alias("record_id"))
    if not named.isEmpty():  # captures that name their records
        links = links.union(others.join(named, "record_id").select("capture_id", row.alias("r"))).distinct()
    kind = lambda *kinds: F.sort_array(F.collect_list(F.when(F.col("r.warc_type").isin(*kinds), F.col("r"))))
    met = heads.union(links).groupBy("capture_id").agg(kind(*CAPTURES).alias("captures"), kind("request").alias("requests"), kind("metadata").alias("metadata"))
    return met.select("capture_id", F.explode("captures").alias("capture"), "requests", "metadata")


def resolved(transactions: DataFrame) -> DataFrame:
    """Captures with the size and digest of the full payload, which a revisit gets from the response it refers to."""
    page = F.get("metadata", F.lit(0))["page_id"]
    flat = stored(transactions.select("capture_id", F.col("capture.warc_type").alias("record_type"), F.col("capture.refers_to_id").alias("to_id"), page.alias("page_id"), F.col("capture.payload_bytes").alias("payload_bytes"), F.col("capture.payload_digest").alias("payload_digest")), "captures")
    responses = flat.where("record_type = 'response'")
    facts = responses.select(F.col("capture_id").alias("to_id"), F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest")
    revisits = flat.where("record_type = 'revisit'").select("page_id", "record_type", "to_id")
    met = joined(revisits, facts, ["to_id"], revisits.groupBy("to_id").agg(F.count(F.lit(1)).alias("n")), "left")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return responses.withColumn("refers_to", F.lit(None).cast("long")).select(names).union(met.select(names))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return resolved(assembled(stored(read_records(spark, path), "records")))


OP9_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""
QUERIES = {"op9_warc": op9_warc}
ORACLES = {"op9_warc": OP9_SQL}
