"""Web archives: writing pages as WARC records, and reading them back by boundary chains.

Writing is Spark's text writer with the two line breaks that end a record as line separator, so
archives go wherever Spark writes, and a lost task writes its file anew. Of pages with equal
payloads one is a response and the others are revisits that refer to it.

Reading is Spark's text reader with the magic "WARC/1." as separator: files are split by bytes,
and each task gives, for every place where the magic stands, the offset at which the record
would end if one began there. The magic may also stand inside a payload, and may be followed by
a whole record there. What is a record is settled by pointer jumping from the start of each
file: in round k every candidate points 2**k records on, and whatever a reached candidate
points to is reached. After log2(records of a file) rounds the reached ones are the records; a
payload that holds the magic is put together again from its parts.

Offsets come from the lengths of the parts: those before it in its split, and the sums of the
splits before. Defined results: a null payload is empty; a null id or address leaves the header
line out and reads back as null; line breaks in an address are percent-encoded; rows that share
the largest id among equal payloads are all responses; payloads shorter than ``least`` bytes
are never revisits; an empty table gives archives without records. A file that does not begin
with a record, or the rest of one whose chain breaks, has no records. Further columns of the
pages are not written, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut, shared_dir

MAGIC = "WARC/1."
END = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8" + END
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
#: The digits of base 32 that ``conv`` writes, and those of WARC digests.
DIGITS = ("0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def digest(payload: Column) -> Column:
    """SHA-1 in base 32: five hexadecimal digits are four of base 32."""
    sha = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(sha, k, 5), 16, 32), 4, "0") for k in range(1, 41, 5)]
    return F.translate(F.concat(*parts), *DIGITS)


def marked(pages: DataFrame, id_col: str, uri_col: str, payload_col: str,
           least: int = 0) -> DataFrame:
    """(id, uri, payload, digest, refers_to) of each page; refers_to is null for a response."""
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(uri_col).alias("uri"),
                        F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", digest(F.col("payload")))
    # Payloads met once need no row here.
    kept = rows.filter(F.octet_length("payload") >= least).groupBy("digest").agg(
        F.max("id").alias("kept"), F.count(F.lit(1)).alias("n")).filter(
        "n > 1 and kept is not null").select("digest", "kept")
    return rows.join(cut(kept, "warc-copies"), "digest", "left").withColumn(
        "refers_to", F.when((F.octet_length("payload") >= least) & ~F.col("id").eqNullSafe(
            F.col("kept")), F.col("kept"))).drop("kept")


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", uri_col: str = "url",
               payload_col: str = "html", least: int = 0, date: str = DATE) -> None:
    """One record for each page, in files under ``path``."""
    rows = marked(pages, id_col, uri_col, payload_col, least)
    response = F.col("refers_to").isNull()
    block = F.concat(F.lit(HTTP), F.when(response, F.col("payload")).otherwise(F.lit("")))
    address = F.replace(F.replace("uri", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))

    def line(name: str, *value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), *value, F.lit("\r\n")), F.lit(""))
    record = F.concat(
        F.lit(MAGIC + "1\r\n"),
        line("WARC-Type", F.when(response, F.lit("response")).otherwise(F.lit("revisit"))),
        line("WARC-Record-ID", F.lit("<urn:page:"), F.col("id").cast("string"), F.lit(">")),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", address),
        line("WARC-Payload-Digest", F.lit("sha1:"), F.col("digest")),
        line("WARC-Refers-To", F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">")),
        F.when(response, F.lit("")).otherwise(F.lit(f"WARC-Profile: {REVISIT}\r\n")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"), block)
    rows.select(record.alias("value")).write.option("lineSep", END).text(path)


def _field(header: Column, name: str, value: str) -> Column:
    found = F.regexp_extract(header, rf"(?i)\r\n{name}:[ \t]*{value}", 1)
    return F.when(found != "", found)


def _parsed(part: Column) -> dict[str, Column]:
    """Columns of the record that begins at a part (the magic is before it)."""
    header = F.substring_index(part, END, 1)
    length = _field(header, "Content-Length", r"(\d{1,15})[ \t]*(?:\r\n|$)").cast("long")
    sound = part.rlike(r"^[01]\r\n") & (F.octet_length(header) < F.octet_length(part))
    return {"header_bytes": F.octet_length(header).cast("long"),
            "block_bytes": F.when(sound, length),
            "type": _field(header, "WARC-Type", r"([^\r\n]*)"),
            "id": _field(header, "WARC-Record-ID", r"<urn:page:(-?\d+)>").cast("long"),
            "uri": _field(header, "WARC-Target-URI", r"([^\r\n]*)"),
            "refers_to": _field(header, "WARC-Refers-To", r"<urn:page:(-?\d+)>").cast("long")}


def _payload(part: Column, header_bytes: Column, block_bytes: Column) -> Column:
    """Bytes after the HTTP header of a record's block."""
    block = F.substring(part.cast("binary"), header_bytes.cast("int") + 5, block_bytes.cast("int"))
    head = F.octet_length(F.substring_index(block.cast("string"), END, 1))
    return F.substring(block, head + 5, F.octet_length(block))


def raw_parts(spark: SparkSession, path: str) -> DataFrame:
    """What stands after each magic. ``seq`` follows the splits of this one read and tells the
    order within a split; another read may be split otherwise, where ``key`` stays the same."""
    return spark.read.option("lineSep", MAGIC).text(path).select(
        F.xxhash64("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"), F.xxhash64("value").alias("key"),
        F.col("value"))


def parts(spark: SparkSession, path: str, measures: dict[str, Callable]) -> DataFrame:
    """The parts, parsed as if a record began at each. ``whole`` says that the record would end
    just where the next magic begins: then its measures are taken here."""
    rows = raw_parts(spark, path)
    rows = rows.select("*", *[c.alias(n) for n, c in _parsed(F.col("value")).items()])
    size = F.octet_length("value").cast("long") + len(MAGIC)
    record = len(MAGIC) + F.col("header_bytes") + 2 * len(END) + F.col("block_bytes")
    whole = F.coalesce(record == size, F.lit(False))
    payload = _payload(F.col("value"), F.col("header_bytes"), F.col("block_bytes"))
    return rows.select(
        "file", "block", "seq", "key", size.alias("size"), record.alias("record"), "header_bytes",
        "block_bytes", "type", "id", "uri", "refers_to", whole.alias("whole"),
        *[F.when(whole, f(payload)).alias(n) for n, f in measures.items()])


def candidates(found: DataFrame) -> DataFrame:
    """(file, seq, offset, next): where a record may begin, and the offset of its successor."""
    in_split = Window.partitionBy("file", "block").orderBy("seq")
    rows = found.select("file", "block", "seq", "record", F.sum("size").over(in_split).alias("to"),
                        "size")
    splits = found.groupBy("file", "block").agg(F.sum("size").alias("all"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "block", F.coalesce(F.sum("all").over(before), F.lit(0))
                           .alias("base"))
    rows = rows.join(splits, ["file", "block"])
    # The magic before a part lies before the part's own bytes.
    offset = F.col("base") + F.col("to") - F.col("size") - len(MAGIC)
    return rows.select("file", "seq", offset.alias("offset"),
                       (offset + F.col("record")).alias("next")).filter("offset >= 0")


def reached(places: DataFrame) -> DataFrame:
    """(file, offset) of the candidates that a chain from offset 0 reaches, by pointer jumping."""
    state = places.filter("next is not null").select(
        "file", "offset", F.col("next").alias("jump"), (F.col("offset") == 0).alias("reached"))
    known = -1
    while True:
        state = cut(state, "warc-chain")
        now = state.filter("reached").count()
        if now == known:
            return state.filter("reached").select("file", "offset")
        known = now
        ahead = state.select("file", F.col("offset").alias("jump"), F.col("jump").alias("far"))
        hop = state.join(ahead, ["file", "jump"], "left")
        moved = hop.select("file", "offset", F.col("far").alias("jump"), "reached").union(
            hop.filter("reached and jump is not null").select(
                "file", F.col("jump").alias("offset"), F.lit(None).cast("long"), F.lit(True)))
        # An offset that no candidate has, such as the end of the file, has no row to keep.
        state = moved.groupBy("file", "offset").agg(
            F.max("jump").alias("jump"), F.max("reached").alias("reached"),
            F.count(F.lit(1)).alias("n")).drop("n")


def read_warc(spark: SparkSession, path: str,
              measures: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """The records of all files under ``path``: file, offset, type, id, uri, refers_to, and what
    ``measures`` take from the payload (the payload itself by default)."""
    measures = measures or {"payload": lambda p: p}
    found = cut(parts(spark, path, measures), "warc-parts")
    places = cut(candidates(found), "warc-places")
    heads = reached(places)
    chain = places.join(heads.withColumn("head", F.lit(True)), ["file", "offset"], "left")
    own = ["type", "id", "uri", "refers_to"]
    told = chain.filter("head").select("seq", "offset").join(found, "seq")
    whole = told.filter("whole").select("file", "offset", *own, *measures)
    torn = told.filter("not whole")
    if torn.isEmpty():
        return whole
    # Of the other records: the part at the head and all parts up to the next record. Their texts
    # are read anew, and found by what they hold: parts of a file with equal size and key are equal.
    order = Window.partitionBy("file").orderBy("offset")
    owner = F.last(F.when(F.col("head"), F.col("seq")), ignorenulls=True).over(order)
    pieces = cut(chain.select("seq", "offset", owner.alias("owner")).join(
        torn.select(F.col("seq").alias("owner")), "owner", "left_semi").join(
        found.select("file", "seq", "key", "size"), "seq"), "warc-torn")
    by = ["file", "key", "size"]
    texts = raw_parts(spark, path).select("file", "key", (F.octet_length("value").cast("long") + len(
        MAGIC)).alias("size"), F.col("value").cast("binary").alias("rest"))
    texts = texts.join(pieces.select(*by).distinct(), by).groupBy(*by).agg(
        F.min("rest").alias("rest"))
    pieces = pieces.join(texts, by).groupBy("owner").agg(F.array_sort(F.collect_list(
        F.struct("offset", "rest"))).alias("pieces"))
    joined = F.aggregate("pieces", F.lit(None).cast("binary"), lambda done, x: F.coalesce(
        F.concat(done, F.lit(MAGIC).cast("binary"), x["rest"]), x["rest"]))
    torn = torn.join(pieces, F.col("seq") == F.col("owner")).withColumn("part", joined)
    payload = _payload(F.col("part"), F.col("header_bytes"), F.col("block_bytes"))
    torn = torn.select("file", "offset", *own, *[f(payload).alias(n) for n, f in measures.items()])
    return whole.union(torn)


def archived(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url",
             payload_col: str = "html", least: int = 0) -> DataFrame:
    """Write the pages as archives in the shared folder, read them back and describe each record;
    a revisit has the payload of the response that it refers to."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(pages, path, id_col, uri_col, payload_col, least)
    records = read_warc(spark, path, {
        "payload_bytes": lambda p: F.octet_length(p).cast("long"), "payload_digest": digest})
    records = cut(records, "warc-records")
    full = records.filter("type = 'response' and id is not null").groupBy(
        F.col("id").alias("refers_to")).agg(F.first("payload_bytes").alias("full_bytes"),
                                            F.first("payload_digest").alias("full_digest"))
    revisits = records.filter("type = 'revisit'").join(full, "refers_to").select(
        "id", F.col("full_bytes").alias("payload_bytes"),
        F.col("full_digest").alias("payload_digest"), "type", "refers_to")
    responses = records.filter("type = 'response'").select(
        "id", "payload_bytes", "payload_digest", "type", "refers_to")
    return responses.union(revisits).select(
        F.col("id").alias(id_col), "payload_bytes", "payload_digest",
        F.col("type").alias("record_type"), "refers_to")
