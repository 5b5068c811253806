"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    align, bpe, digest, hard_negatives, licenses, mixing, near_dup, pieces, quality, repeats, secret_spans,
    toxicity, warc,
)
from .license_sql import LICENSE_SQL
from .mixing_sql import MIX_SQL
from .negatives_sql import NEGATIVES_SQL
from .quality_sql import QUALITY_SQL, REPEATS_SQL
from .secret_sql import SECRET_SQL
from .tables import read
from .warc_sql import WARC_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build
    return register


@query("op4_fingerprints")
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.edited_fingerprints(read(spark, sf_dir, "documents"))


@query("op9_quality_rules", QUALITY_SQL)
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(read(spark, sf_dir, "documents"))


@query("op10_mixing", MIX_SQL)
def mixing_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(read(spark, sf_dir, "documents"))


@query("op6_toxicity")
def toxic_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judged(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query("op8_secrets", SECRET_SQL)
def secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans.secret_report(read(spark, sf_dir, "documents"))


@query("op5_sentence_pieces")
def sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(read(spark, sf_dir, "documents"))


@query("op7_repeated_passages", REPEATS_SQL)
def repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op1_warc", WARC_SQL)
def archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(read(spark, sf_dir, "pages"))


@query("op2_near_duplicates")
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(read(spark, sf_dir, "documents"))


@query("op3_licenses", LICENSE_SQL)
def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_report(read(spark, sf_dir, "documents"))


@query("op11_alignment")
def token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.alignment(read(spark, sf_dir, "documents"))


@query("op12_bpe")
def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op13_hard_negatives", NEGATIVES_SQL)
def mined_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(
        read(spark, sf_dir, "embeddings").withColumn("label", own), F.col("vec_id") % 50 == 0)
