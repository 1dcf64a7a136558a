"""WARC archives: write pages as records, read them back, put segments together.

Archives are written by Spark's text writer: a record is text in bytes, and every record ends with
the writer's line separator. They are read back by Spark's text reader with the version line as
separator, so big uncompressed files are split over tasks. A payload travels as an HTTP response in
chunked transfer framing; where it holds the version line itself, a chunk ends inside it. A long
block is cut into a first record and continuations, which are grouped by origin, ordered by segment
number, checked against the total length and decoded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound, map_texts, shared_folder, table

VERSION = "WARC/1.1"
#: Bytes of a chunk and of a segment; payloads below LEAST_SHARED bytes are never revisits.
CHUNK, SEGMENT, LEAST_SHARED = 8192, 65536, 100
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def _cut(data: Column, width: int) -> Column:
    """Pieces of a binary value of ``width`` bytes; none for an empty one."""
    last = F.floor((F.octet_length(data) - 1) / width).cast("int")
    return F.when(F.octet_length(data) > 0, F.transform(
        F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
        lambda i: F.substring(data, i * width + 1, F.lit(width)))).otherwise(
        F.array().cast("array<binary>"))


def _chunked(text: str) -> Column:
    """Chunked framing of a string column."""
    parts = F.when(F.contains(F.col(text), F.lit(VERSION)), F.split(text, "(?<=WARC/)(?=1\\.1)")).otherwise(
        F.array(text))
    pieces = F.flatten(F.transform(parts, lambda p: _cut(p.cast("binary"), CHUNK)))
    framed = F.transform(pieces, lambda p: F.concat(
        F.lower(F.hex(F.octet_length(p))), F.lit("\r\n"), p.cast("string"), F.lit("\r\n")))
    return F.concat(F.array_join(framed, ""), F.lit("0\r\n\r\n"))


def _clean(c: Column) -> Column:
    """A header value without blanks and control characters."""
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"[\x00-\x20\x7f]", "%20")


def records(pages: DataFrame, date: str) -> DataFrame:
    """The column value: one archive record per row, without the last line end.

    Of rows with the same payload of LEAST_SHARED bytes or more, those with the smallest page_id
    are responses and the others revisits of it; a null page_id comes after all others, and rows
    without any other id than null are responses.
    """
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"),
                     F.monotonically_increasing_id().alias("row"))
    p = bound(p, digest=F.sha2(F.col("html").cast("binary"), 256),
              length=F.octet_length("html").cast("long"))
    first = p.where(F.col("length") >= LEAST_SHARED).where("page_id is not null").groupBy("digest").agg(
        F.min(F.struct("page_id", "row")).alias("first"),
        F.count("*").alias("n")).withColumnRenamed("digest", "of")
    nulls = p.where((F.col("length") >= LEAST_SHARED) & F.col("page_id").isNull()).select(
        F.col("digest").alias("of")).distinct()
    shared = first.join(nulls.withColumn("also", F.lit(True)), "of", "left").where(
        "n > 1 or also").select("of", "first")
    p = p.join(shared, (p.digest == shared["of"]) & (p.length >= LEAST_SHARED), "left")
    later = F.col("first").isNotNull() & F.coalesce(
        F.col("page_id") > F.col("first.page_id"), F.lit(True))

    def urn(page: Column, row: Column) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("null")),
                        F.lit(":"), row, F.lit(">"))

    p = bound(p, id=urn(F.col("page_id"), F.col("row")), revisit=later,
              block=F.when(~later, F.concat(F.lit(_HTTP), _chunked("html"))).otherwise(""))
    p = bound(p, parts=F.when(F.octet_length("block") > SEGMENT, _cut(
        F.col("block").cast("binary"), SEGMENT)).otherwise(F.array(F.col("block").cast("binary"))))
    many = F.size("parts") > 1
    p = p.select("*", F.posexplode("parts").alias("segment", "part"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    kind = F.when(F.col("segment") > 0, "continuation").when(F.col("revisit"), "revisit").otherwise("response")
    head = F.concat(
        F.lit(f"{VERSION}\r\n"), line("WARC-Type", kind),
        line("WARC-Record-ID", F.when(F.col("segment") > 0, F.concat(
            F.rtrim(F.col("id"), F.lit(">")), F.lit(":"), F.col("segment") + 1, F.lit(">"))).otherwise(F.col("id"))),
        line("WARC-Date", F.lit(date)), line("WARC-Target-URI", _clean(F.col("url"))),
        F.when(F.col("segment") == 0, F.concat(
            line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
            line("X-Payload-Length", F.col("length").cast("string")))).otherwise(""),
        F.when(F.col("revisit"), F.concat(
            line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            line("WARC-Refers-To", urn(F.col("first.page_id"), F.col("first.row"))))).otherwise(""),
        F.when(many, line("WARC-Segment-Number", (F.col("segment") + 1).cast("string"))).otherwise(""),
        F.when(F.col("segment") > 0, line("WARC-Segment-Origin-ID", F.col("id"))).otherwise(""),
        F.when(many & (F.col("segment") == F.size("parts") - 1), line(
            "WARC-Segment-Total-Length", F.octet_length("block").cast("string"))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length("part").cast("string")), F.lit("\r\n"))
    return p.select(F.concat(head, F.col("part").cast("string"), F.lit("\r\n")).alias("value"))


def write_archives(pages: DataFrame, path: str, date: str = "2000-01-01T00:00:00Z",
                   compression: str = "gzip") -> None:
    """Write (page_id, url, html) as WARC files; other columns are ignored."""
    records(pages, date).write.option("lineSep", "\r\n").option("compression", compression).text(path)


def _decode(block: bytes) -> bytes:
    """The payload of an HTTP response in chunked framing."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found or b"transfer-encoding: chunked" not in head.lower():
        return body
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        out.append(body[end + 2:end + 2 + size])
        if len(out[-1]) != size or body[end + 2 + size:end + 4 + size] != b"\r\n":
            raise ValueError("a chunk is shorter than it says")
        at = end + 4 + size


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per response or revisit: id, type, url, digest, length, refers_to, payload.

    The order of records and files does not matter. A record shorter than it says, a missing or
    repeated segment and a wrong total are errors. A revisit has a null payload.
    """
    raw = spark.read.option("lineSep", f"{VERSION}\r\n").text(path).where("value != ''")
    r = bound(raw, head=F.substring_index("value", "\r\n\r\n", 1))
    r = bound(r, h=F.str_to_map("head", F.lit("\r\n"), F.lit(": ")))
    get = lambda name: F.try_element_at("h", F.lit(name))
    length = get("Content-Length").cast("int")
    r = r.select(
        get("WARC-Record-ID").alias("id"), get("WARC-Type").alias("type"),
        get("WARC-Target-URI").alias("url"), get("WARC-Payload-Digest").alias("digest"),
        get("X-Payload-Length").cast("long").alias("length"), get("WARC-Refers-To").alias("refers_to"),
        get("WARC-Segment-Number").cast("int").alias("number"),
        get("WARC-Segment-Origin-ID").alias("origin"),
        get("WARC-Segment-Total-Length").cast("long").alias("total"), length.alias("n"),
        F.substring(F.col("value").cast("binary"), F.octet_length("head") + 5, length).alias("block"))
    r = r.withColumn("block", F.when(F.octet_length("block") == F.col("n"), F.col("block")).otherwise(
        F.raise_error(F.concat(F.lit("short record "), "id"))))
    columns = ["id", "type", "url", "digest", "length", "refers_to", "block"]
    single = r.where("number is null").select(columns)
    parts = r.where("number is not null").groupBy(F.coalesce("origin", "id").alias("id")).agg(
        *(F.max(F.when(F.col("number") == 1, F.col(c))).alias(c) for c in ("type", "url", "digest", "length", "refers_to")),
        F.max("total").alias("total"), F.sum("n").alias("n"), F.count("*").alias("k"),
        F.sort_array(F.collect_list(F.struct("number", "block"))).alias("parts"))
    good = (F.col("total") == F.col("n")) & (F.element_at("parts", -1)["number"] == F.col("k")) & (
        F.size(F.array_distinct(F.col("parts.number"))) == F.col("k"))
    joined = F.array_join(F.transform("parts", lambda p: p["block"].cast("string")), "").cast("binary")
    whole = parts.withColumn("block", F.when(F.coalesce(good, F.lit(False)), joined).otherwise(
        F.raise_error(F.concat(F.lit("incomplete segments of "), "id")))).select(columns)
    found = single.union(whole)

    def work(blocks):
        return [[_decode(b) if b else None for b in blocks]]

    return map_texts(found, "block", columns[:-1], work, "payload binary")


def op8_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages to archives, read them back, and describe each record's payload."""
    path = shared_folder(spark, "warc")
    pages = table(spark, sf_dir, "pages")
    write_archives(pages, path)
    kind = pages.schema["page_id"].dataType
    page = lambda c: F.nullif(F.split(c, ":")[2], F.lit("null")).cast(kind)
    r = read_archives(spark, path)
    known = F.col("type") == "revisit"
    return r.select(
        page(F.col("id")).alias("page_id"),
        F.when(known, F.col("length")).otherwise(F.octet_length("payload").cast("long")).alias("payload_bytes"),
        F.when(known, F.substring_index("digest", ":", -1)).otherwise(F.sha2("payload", 256)).alias("payload_digest"),
        F.col("type").alias("record_type"), page(F.rtrim(F.col("refers_to"), F.lit(">"))).alias("refers_to"))
