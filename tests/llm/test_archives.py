import sys
from pathlib import Path

import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parent))

import brute  # noqa: E402
from worklens.llm import QUERIES, warc  # noqa: E402

SF = "/root/testdata/sf0.001"
FAKE = ("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\n"
        "Content-Length: 5\r\n\r\nhello\r\n\r\n")


def told(frame):
    return {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type,
                        None if pd.isna(r.refers_to) else int(r.refers_to))
            for r in frame.toPandas().itertuples()}


def test_query_equals_brute_force(spark):
    pages = [(r.page_id, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    assert told(QUERIES["op1_warc"](spark, SF)) == brute.archived(pages)


def test_magic_in_payloads_and_odd_rows(spark):
    rows = [(1, "u", "x"), (2, "u", "x"), (3, None, None), (4, "a\r\nb", ""), (5, "é", "ñ" * 10),
            (6, "u", FAKE), (7, "u", "a WARC/1. b" + FAKE * 3), (8, "u", FAKE + "x"),
            (9, "u", "WARC/1."), (10, "u", "\r\n\r\nWARC/1.0\r\n\r\n"), (11, "u", "z" * 400_000),
            (12, "u", FAKE), (13, "u", FAKE[:-8])]
    pages = spark.createDataFrame([(*r, 0, "t") for r in rows],
                                  "page_id long, url string, html string, seq int, file string")
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")  # splits within records
    try:
        assert told(warc.archived(pages.coalesce(2))) == brute.archived([(r[0], r[2]) for r in rows])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)


def test_payloads_and_addresses_read_back(spark, tmp_path):
    rows = [(1, "http://a/é", "one"), (2, None, FAKE * 2 + "two"), (None, "u", "three")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_warc(pages, str(tmp_path / "out"))
    back = warc.read_warc(spark, str(tmp_path / "out")).collect()
    assert {(r["id"], r["uri"], bytes(r["payload"]).decode()) for r in back} == set(rows)


def test_small_payloads_are_no_revisits(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")],
                                  "page_id long, url string, html string")
    kinds = {r["page_id"]: r["record_type"] for r in warc.archived(pages, least=3).collect()}
    assert kinds == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_equal_ids_and_no_rows(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (1, "u", "ab"), (0, "u", "ab")],
                                  "page_id long, url string, html string")
    assert sorted((r["page_id"], r["record_type"]) for r in warc.archived(pages).collect()) == [
        (0, "revisit"), (1, "response"), (1, "response")]
    assert warc.archived(pages.limit(0)).count() == 0


def test_records_behind_a_broken_chain_are_left_out(spark, tmp_path):
    pages = spark.createDataFrame([(k, "u", f"page {k}") for k in range(4)],
                                  "page_id long, url string, html string").coalesce(1)
    warc.write_warc(pages, str(tmp_path / "out"))
    path = next((tmp_path / "out").glob("part-*"))
    (tmp_path / "broken.warc").write_bytes(path.read_bytes().replace(b"page 1", b"page 1 and more"))
    read = warc.read_warc(spark, str(tmp_path / "broken.warc"))
    assert {r["id"] for r in read.collect()} == {0, 1}


def test_reads_with_two_split_sizes(spark, monkeypatch):
    """Parts of torn records are found again though the second read is split otherwise."""
    rows = [(k, "u", f"{k} " + FAKE * (k % 4) + "x" * (37 * k % 500)) for k in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2)
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    sizes, real = iter(("700", "5000")), warc.raw_parts

    def split(session, path):
        session.conf.set("spark.sql.files.maxPartitionBytes", next(sizes))
        return real(session, path)
    monkeypatch.setattr(warc, "raw_parts", split)
    try:
        assert told(warc.archived(pages)) == brute.archived([(r[0], r[2]) for r in rows])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
