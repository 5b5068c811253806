"""Quartile bucket digests of documents, and a bounded difference between two digests.

Byte triplets taken from a sliding window of five bytes are hashed to 256 buckets and counted.
The digest keeps, for each bucket, in which quartile of the 256 counts it falls (two bits),
besides a code of the length, the ratios of the quartiles and a checksum. Two digests differ by
the steps between their bucket codes, with a step of three counted double, and by the steps
between their head codes; the difference is cut at that of two unrelated digests, so that
``likeness`` runs from 0 to 1.

Defined results: a null text counts as empty; an empty or very short text has a digest like any
other, and equal texts have equal digests. ``next_texts`` orders rows by descending id, nulls
last, ties by a hash of the text and by the text, and takes the first row after the last one: a
lone row is its own next. Repeated rows follow one another. An empty table gives an empty result. Further columns of the
input, whatever their names, are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .tables import bounded, raw

BUCKETS = 256
TRIPLETS = ((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4))
#: Mean difference of the bucket codes of two unrelated digests: 1.625 for each bucket.
UNRELATED = 416.0
LENGTH_STEP, RATIO_STEP, HEAD_MOST = 4, 2, 48
CHUNK = 2_000_000
#: Rows that a bucket of neighbouring ids is meant to hold, and the finest share of all rows by
#: which the bounds of buckets are told apart.
BUCKET_ROWS = 4_000
ACCURACY = 1_000_000


def _counts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    n = len(at) - 1
    size = np.diff(at)
    counts = np.zeros(n * BUCKETS, np.int64)
    owner = np.repeat(np.arange(n, dtype=np.int64) * BUCKETS, size)
    left = np.repeat(at[1:], size) - np.arange(len(data))  # bytes from here to the text's end
    x = data.astype(np.uint32)
    one, two, three = (x * np.uint32(k) for k in (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35))
    for k, (a, b) in enumerate(TRIPLETS):
        if len(data) <= b:
            continue
        stop = len(data) - b
        h = one[:stop] + two[a:a + stop] + three[b:b + stop] + np.uint32(0x27D4EB2F * k % 2**32)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        key = owner[:stop] + (h >> np.uint32(24))
        counts += np.bincount(key[left[:stop] > b], minlength=len(counts))
    return counts.reshape(n, BUCKETS)


def _checksum(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(data.astype(np.uint64) * (np.uint64(2) * np.arange(len(data), dtype=np.uint64)
                                        + np.uint64(1)), out=total[1:])
    run = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(data.astype(np.uint64), out=run[1:])
    begin = at[:-1].astype(np.uint64)
    here = (total[at[1:]] - total[at[:-1]]) - np.uint64(2) * begin * (run[at[1:]] - run[at[:-1]])
    here ^= here >> np.uint64(8)
    return (here & np.uint64(255)).astype(np.uint8)


def digest_rows(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of bytes for each text: length, ratios, checksum, then two bits a bucket."""
    counts = _counts(data, at)
    ranked = np.sort(counts, axis=1)
    q = ranked[:, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = (counts > q[:, :1]).astype(np.uint8) + (counts > q[:, 1:2]) + (counts > q[:, 2:])
    packed = codes[:, 0::4] | codes[:, 1::4] << 2 | codes[:, 2::4] << 4 | codes[:, 3::4] << 6
    length = np.minimum(255, np.round(np.log1p(np.diff(at)) / np.log(1.1))).astype(np.uint8)
    third = np.maximum(1, q[:, 2])
    ratios = ((15 * q[:, 0] // third) | (15 * q[:, 1] // third) << 4).astype(np.uint8)
    head = np.stack([length, ratios, _checksum(data, at)], axis=1)
    return np.concatenate([head, packed], axis=1)


def digests(texts: pa.Array) -> pa.Array:
    data, at = raw(texts)
    out, begin = [], 0
    while begin < len(texts):
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + CHUNK, "right")) - 1)
        end = min(end, len(texts))
        rows = digest_rows(data[at[begin]:at[end]], at[begin:end + 1] - at[begin])
        out += [row.tobytes().hex() for row in rows]
        begin = end
    return pa.array(out, pa.string())


def difference(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Differences of digests, row by row, before they are cut."""
    step = np.abs(one[:, 0].astype(int) - two[:, 0])
    head = np.minimum(HEAD_MOST, LENGTH_STEP * step)
    for shift in (0, 4):
        head += RATIO_STEP * np.abs((one[:, 1] >> shift & 15).astype(int) - (two[:, 1] >> shift & 15))
    head += one[:, 2] != two[:, 2]
    body = np.zeros(len(one), int)
    for shift in (0, 2, 4, 6):
        gap = np.abs((one[:, 3:] >> shift & 3).astype(np.int8) - (two[:, 3:] >> shift & 3).astype(np.int8))
        body += gap.sum(1) + 3 * (gap == 3).sum(1)
    return body + head


def likenesses(one: pa.Array, two: pa.Array) -> pa.Array:
    if not len(one):
        return pa.array([], pa.float64())
    rows = [np.frombuffer(bytes.fromhex("".join(x.to_pylist())), np.uint8).reshape(len(x), -1)
            for x in (one, two)]
    return pa.array(1.0 - np.minimum(1.0, difference(*rows) / UNRELATED))



def fingerprint(text):
    """Column of digests of a text column."""
    def run(texts: pa.Array) -> pa.Array:
        return digests(texts)
    return F.arrow_udf(run, "string")(F.coalesce(text.cast("binary"), F.lit(b"")))


def likeness(one, two):
    """Column of likenesses, 0 to 1, of two columns of digests."""
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return likenesses(a, b)
    return F.arrow_udf(run, "double")(one, two)


def id_buckets(docs: DataFrame, rows: int = BUCKET_ROWS):
    """Column of bucket numbers for (id, hash), growing in the order of ``next_texts``.

    The bounds are quantiles of the ids, so that far-off ids change nothing. An id (or null) met
    more than ``rows`` times has a bucket of its own, split by the hash. The driver holds eight
    bytes for every ``rows`` rows.
    """
    n = docs.count()
    cuts = max(1, n // rows)
    ids = docs.select(F.col("id").cast("long").alias("id"))
    bounds = ids.agg(F.percentile_approx("id", [k / cuts for k in range(1, cuts)] or [0.5], min(
        ACCURACY, max(10_000, 4 * cuts))).alias("b")).first()["b"] or []
    often = {r["id"]: r["n"] for r in ids.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter(
        F.col("n") > rows).collect()}
    alone = [i for i in often if i is not None]
    top = np.iinfo(np.int64).max
    bounds = np.unique(np.array([*bounds, *alone, *(i + 1 for i in alone if i < top)], np.int64))
    # Buckets of ids from the lowest up, after them the one of no id; how many parts each has.
    parts = np.ones(len(bounds) + 2, np.int64)
    parts[np.searchsorted(bounds, np.array(alone, np.int64), "right")] = [
        -(-often[i] // rows) for i in alone]
    parts[-1] = -(-often.get(None, 1) // rows)
    down = np.concatenate([np.arange(len(bounds), -1, -1), [len(bounds) + 1]])
    start = np.empty_like(parts)
    start[down] = np.cumsum(parts[down]) - parts[down]

    def number(ids: pa.Array, hashes: pa.Array) -> pa.Array:
        at = np.searchsorted(bounds, ids.fill_null(0).to_numpy(zero_copy_only=False), "right")
        at = np.where(ids.is_null().to_numpy(zero_copy_only=False), len(bounds) + 1, at)
        share = hashes.to_numpy(zero_copy_only=False) / 2.0**64 + 0.5
        part = np.minimum((share * parts[at]).astype(np.int64), parts[at] - 1)
        return pa.array(start[at] + part, pa.int64())
    return F.arrow_udf(number, "long")(F.col("id").cast("long"), F.col("hash"))


def next_texts(docs: DataFrame, rows: int = BUCKET_ROWS) -> DataFrame:
    """``docs`` (id, text, fingerprint) with ``next_text`` and ``next_fingerprint``.

    Rows go to buckets of neighbouring ids, so one shuffle of the texts is all. Of each bucket the
    first row is dealt a second time, to the bucket before it, where it serves as what follows the
    last row. The table of those first rows has three numbers a bucket; it is written, so that its
    size tells whether it can be broadcast.
    """
    docs = docs.withColumn("hash", F.xxhash64("text"))
    placed = docs.withColumn("bucket", id_buckets(docs, rows))
    # The largest id, and of its rows the one with the least hash.
    tops = placed.groupBy("bucket").agg(F.max(F.struct("id", F.bitwise_not("hash").alias("h")))
                                        .alias("top"))
    before = Window.orderBy("bucket")
    every = before.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tops = tops.select("bucket", "top", F.coalesce(
        F.lag("bucket").over(before), F.max("bucket").over(every)).alias("into"))
    dealt = placed.join(cut(tops, "digest-tops"), "bucket")
    own, again = (F.struct(F.col(c).alias("bucket"), F.lit(g).alias("again"))
                  for c, g in (("bucket", False), ("into", True)))
    first = F.col("id").eqNullSafe(F.col("top.id")) & (F.bitwise_not("hash") == F.col("top.h"))
    dealt = dealt.select("id", "text", "hash", "fingerprint", F.explode(
        F.when(first, F.array(own, again)).otherwise(F.array(own))).alias("to")).select(
        "id", "text", "hash", "fingerprint", "to.bucket", "to.again")
    order = Window.partitionBy("bucket").orderBy(
        "again", F.col("id").desc_nulls_last(), "hash", "text")
    return dealt.select("*", F.lead("text").over(order).alias("next_text"),
                        F.lead("fingerprint").over(order).alias("next_fingerprint")
                        ).filter(~F.col("again")).drop("hash")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id",
                        text_col: str = "text") -> DataFrame:
    """Digests of every text and of its edited text, and their likenesses.

    The edited text has its last half replaced by the beginning of the next row's text.
    """
    rows = bounded(docs).select(F.col(id_col).alias("id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = next_texts(rows.withColumn("fingerprint", fingerprint(F.col("text"))))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", 1, F.length("text") - half),
                      F.substring("next_text", 1, half))
    rows = rows.select(
        F.col("id"), F.length("text").cast("long").alias("n_chars"), edited.alias("edited"),
        "fingerprint", "next_fingerprint")
    rows = rows.withColumn("edited_fingerprint", fingerprint(F.col("edited")))
    return rows.select(
        F.col("id").alias(id_col), "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
