"""From documents to token ids: five stages, each over all rows that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result to
the shared folder and reads it again as the next stage's input, so that a lost executor costs
at most the stage under way. All but the last return the columns of ``documents``:

1. toxicity: rows that score 0.3 or more go; the model learns from all labels.
2. near duplicates: of each class the row with the smallest id stays.
3. secrets: every secret span is replaced by a mark, and n_chars follows the new text.
4. mixing: rows are taken as often as the mix of sources asks, none more than twice.
5. pieces: the ids of each text, besides its doc_id, lang and source.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worklens.llm import mixing, near_dup, pieces, secret_spans, toxicity
from worklens.llm.tables import read
from worklens.session import cut


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.without_near_copies(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_spans.redacted(docs).withColumn(
        "n_chars", F.coalesce(F.length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = pieces.with_ids(docs)
    return coded.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_ids"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("sentence_pieces", encode_pieces),
]

#: The learned lexicon and the signatures have no SQL form; the tests hold run() against a
#: brute-force version of each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
