"""Search over works and over the names of places, members and agencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_name, text_position, text_rank
from .queue import any_contains, within

WORKS_MAX = 20

#: Texts of a work that any search looks at; what an index over works has to post. A search
#: takes ``postings.candidates`` of its own fields in place of all rows.
WORK_TEXTS = ["work_name", "description", "mp_name", "district", "state", "implementing_agency"]
RANKED_TEXTS = ["work_name", "implementing_agency", "mp_name"]

# How far each kind of entity sinks below an equal match of the kind before it.
KIND_BIAS = {"State": 0.1, "District": 0.2, "Member": 0.3, "Agency": 0.4}


def search_works(scored: DataFrame, q: str, limit: int = 6) -> DataFrame:
    """Works whose name, agency or member contains the text, best position first.

    Ranked over every match, then limited: taking some matches first and ranking those would
    give another answer on every run.
    """
    if len(q) < 2:
        return scored.limit(0)
    return (
        scored.filter(any_contains(RANKED_TEXTS, q))
        .orderBy(text_rank("work_name", q), text_position("work_name", q),
                 F.coalesce("overall_risk_score", F.lit(0.0)).desc(), "work_key")
        .limit(within(limit, WORKS_MAX))
        .select("work_key", "work_name", "state", "district", "sector", "implementing_agency",
                "mp_name", "sanctioned_amount", "overall_risk_score", "risk_level")
    )


def search_index(works: DataFrame) -> DataFrame:
    """Every distinct state, district, agency and member as one tagged table."""
    none = F.lit(None).cast("string")
    states = works.filter("state is not null").select(
        F.lit("State").alias("kind"), F.col("state").alias("label"), none.alias("sub"),
        none.alias("entity_id")).distinct()
    districts = works.filter("district is not null and state is not null").select(
        F.lit("District").alias("kind"), F.col("district").alias("label"),
        F.col("state").alias("sub"), none.alias("entity_id")).distinct()
    agencies = works.filter("implementing_agency is not null").select(
        F.lit("Agency").alias("kind"), F.col("implementing_agency").alias("label"),
        none.alias("sub"), none.alias("entity_id")).distinct()
    members = works.filter("mp_id is not null and mp_name is not null").select(
        "mp_id", "mp_name", "state", "constituency", "ls_term").distinct().select(
        F.lit("Member").alias("kind"), F.col("mp_name").alias("label"),
        F.nullif(F.concat_ws(" · ", F.nullif("constituency", F.lit("")),
                             F.nullif("state", F.lit(""))), F.lit("")).alias("sub"),
        F.concat_ws("|", "mp_id", F.col("ls_term").cast("string")).alias("entity_id"))
    return states.unionByName(districts).unionByName(agencies).unionByName(members)


def search_entities(index: DataFrame, q: str, limit: int = 8) -> DataFrame:
    """Best matches across kinds: start, word start, inside; then kind; then shorter label."""
    needle = q.lower()
    text = F.lower("label")
    at = F.locate(needle, text)
    before = F.substr(text, F.greatest(at - 1, F.lit(1)), F.lit(1))
    place = (
        F.when(at == 1, F.lit(0.0))
        .when(before.rlike(r"[\s(,\-/]"), 1 + (at - 1) / 1000.0)
        .otherwise(2 + (at - 1) / 1000.0)
    )
    bias = F.create_map(*[F.lit(x) for pair in KIND_BIAS.items() for x in pair])
    shown = F.when(F.col("kind") == "Member", clean_name("label")).otherwise(F.col("label"))
    rank = F.round((place + F.element_at(bias, F.col("kind"))).cast("decimal(12,4)"), 4)
    return (
        index.filter(at > 0).withColumn("rank", rank.cast("double"))
        .select("kind", shown.alias("label"), "sub", "entity_id", "rank")
        .orderBy("rank", F.length("label"), "label", "sub", "entity_id").limit(limit)
    )
