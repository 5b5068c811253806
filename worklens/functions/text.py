"""Text normalisation, names, sectors and search ranks."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .numeric import col

OTHER = "Other"

# The ordered sector rules. The first rule with a matching keyword wins.
SECTOR_RULES: list[tuple[str, list[str]]] = [
    ("Street Lighting", ["high mast", "highmast", "street light", "streetlight", "solar light",
                         "led light", "mast light", "light pole", "solar street", "lighting",
                         "lights", "prakash"]),
    ("Roads & Paving", ["road", "paver", "interlocking", "pathway", "culvert", "bridge", "marg",
                        "sadak", "rasta", "footpath", "cc block", "khadanja"]),
    ("Water", ["water", "borewell", "bore well", "hand pump", "handpump", "tubewell",
               "tube well", "pipeline", "tanker", "overhead tank", "jal", "pond", "talab",
               "kuan"]),
    ("Drainage & Sanitation", ["drain", "nali", "sewer", "toilet", "soak pit", "sanitation",
                               "shauchalay", "septic"]),
    ("Education", ["school", "classroom", "vidyalaya", "college", "library", "anganwadi",
                   "hostel", "shiksha", "pustakalaya"]),
    ("Health", ["hospital", "health centre", "health center", "phc", "chc", "ambulance",
                "dispensary", "aarogya", "swasthya"]),
    ("Community Buildings", ["community hall", "panchayat ghar", "bhawan", "bhavan", "chaupal",
                             "samudayik", "shed", "hall", "community centre",
                             "community center", "rain shelter", "waiting", "barat ghar"]),
    ("Religious & Cultural", ["mandir", "temple", "masjid", "church", "gurudwara", "samadhi",
                              "statue", "pratima", "murti", "ghat"]),
    ("Sports", ["playground", "stadium", "sports", "khel", "gym", "park"]),
    ("Boundary & Protection", ["boundary wall", "retaining wall", "chardiwari", "fencing",
                               "protection wall", "wall"]),
    ("Equipment & Vehicles", ["purchase", "computer", "furniture", "generator", "machine",
                              "vehicle", "equipment", "cctv", "cooler", "bench", "desk"]),
]

# Honorifics dropped from a member's name before it is keyed.
NAME_HONORIFICS = [
    "shri", "sh", "shrimati", "smt", "sri", "srimati", "dr", "prof", "mr", "mrs", "ms", "adv",
    "col", "capt", "maj", "gen", "kum", "kumari",
]

# Honorifics dropped before two registries' names are compared.
MATCH_HONORIFICS = [
    "shri", "smt", "sh", "dr", "adv", "advocate", "prof", "kumari", "km", "sushri", "ms", "mr",
    "mrs", "thiru", "tmt", "capt", "col", "lt", "gen", "retd", "sardar", "s", "choudhary",
    "ch", "pt", "pandit", "sri", "smti", "hon",
]

# Fixed value: a term marker written into a name - "(2022-28)", "(17th Lok Sabha)", "(17LS)".
# Other parentheses belong to the name and stay.
TERM_MARKER = (
    r"(?i)\(\s*(?:\d{4}\s*-\s*\d{2,4}|\d{1,2}\s*(?:st|nd|rd|th)?\s*(?:LS|Lok\s*Sabha))\s*\)"
)

# One spelling per state, whichever registry wrote it.
STATE_ALIASES = {
    "nct of delhi": "delhi",
    "national capital territory of delhi": "delhi",
    "keralam": "kerala",
    "orissa": "odisha",
    "pondicherry": "puducherry",
    "dadra and nagar haveli and daman and diu": "dadra and nagar haveli",
}


def _folded(text: str) -> str:
    plain = "".join(
        ch for ch in unicodedata.normalize("NFKD", text) if not unicodedata.combining(ch)
    )
    return " ".join(re.sub(r"[^a-z0-9\s]", " ", plain.casefold()).split())


@F.pandas_udf(StringType())
def _fold_unicode(texts: pd.Series) -> pd.Series:
    return texts.map(_folded, na_action="ignore")


def normalize_text(c, ascii_only: bool = False) -> Column:
    """Casefold, strip accents and punctuation, collapse whitespace; NULL becomes ''.

    ASCII text is handled by built-ins. Spark has no NFKD, so the rest goes through an
    Arrow-batched UDF that receives NULL for every ASCII row. ``ascii_only`` leaves the UDF
    out of the plan for columns known to hold plain ASCII.
    """
    text = F.coalesce(col(c), F.lit(""))
    plain = F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))
    if ascii_only:
        return plain
    beyond = text.rlike(r"[^\x00-\x7F]")
    return F.coalesce(_fold_unicode(F.when(beyond, text)), plain)


def _drop_tokens(text: Column, dropped: list[str]) -> Column:
    unwanted = F.array(*[F.lit(w) for w in dropped])
    kept = F.filter(
        F.split(text, " "),
        lambda t: (F.length(t) > 1) & ~F.array_contains(unwanted, t),
    )
    return kept


def normalize_person(c, ascii_only: bool = False) -> Column:
    """A member's name without term marker, honorifics and single letters."""
    unmarked = F.regexp_replace(F.coalesce(col(c), F.lit("")), TERM_MARKER, " ")
    tokens = _drop_tokens(normalize_text(unmarked, ascii_only), NAME_HONORIFICS)
    return F.array_join(tokens, " ")


def member_key(name, state, house, ascii_only: bool = False) -> Column:
    """Stable short id of one member; NULL when the name carries no usable text."""
    person = normalize_person(name, ascii_only)
    basis = F.concat_ws(
        "|", person, normalize_text(state, ascii_only), normalize_text(house, ascii_only)
    )
    return F.when(F.length(person) > 0, F.substring(F.sha1(basis), 1, 16))


def rule_pattern(keywords: list[str]) -> str:
    """Whole words with an optional plural; a keyword is text, not a pattern."""
    return r"(?<!\w)(?:" + "|".join(map(re.escape, keywords)) + r")(?:e?s)?(?!\w)"


def classify(c, rules=SECTOR_RULES, normalized: bool = False, ascii_only: bool = False) -> Column:
    """Sector of a description: first matching rule, else ``Other``.

    A pattern is tried only on texts that hold one of its keywords: looking for these is cheap.
    """
    text = col(c) if normalized else normalize_text(c, ascii_only)
    chosen = F
    for sector, keywords in rules:
        held = reduce(or_, [text.contains(word) for word in keywords] or [F.lit(True)])
        chosen = chosen.when(held & text.rlike(rule_pattern(keywords)), F.lit(sector))
    return chosen.otherwise(F.lit(OTHER))


def clean_name(c) -> Column:
    """A name without its trailing parenthesised tail; the name itself when nothing is left."""
    stripped = F.trim(F.regexp_replace(col(c), r"\s*\([^()]*\)\s*[A-Za-z]*\s*$", ""))
    return F.coalesce(F.nullif(stripped, F.lit("")), col(c))


def state_key(c) -> Column:
    """Canonical state name for joining two registries."""
    text = F.lower(F.trim(F.coalesce(col(c), F.lit(""))))
    text = F.regexp_replace(F.replace(text, F.lit("&"), F.lit("and")), "[^a-z ]", " ")
    text = F.trim(F.regexp_replace(text, r"\s+", " "))
    text = F.regexp_replace(text, "^the ", "")
    aliases = F.create_map(*[F.lit(x) for pair in STATE_ALIASES.items() for x in pair])
    return F.coalesce(F.try_element_at(aliases, text), text)


def boundary_key(c) -> Column:
    """State name squeezed to letters, as map boundary files need it."""
    text = F.lower(F.coalesce(col(c), F.lit("")))
    text = F.regexp_replace(text, r"^the\s+", "")
    text = F.replace(text, F.lit("&"), F.lit("and"))
    text = F.regexp_replace(text, r"\s+islands$", "")
    return F.regexp_replace(text, "[^a-z]", "")


def seat(constituency, house, upper: str = "Rajya Sabha") -> Column:
    """Upper-house rows name the house as their seat: only ``Nominated`` says anything."""
    nominated = F.coalesce(F.lower(col(constituency)).contains("nominated"), F.lit(False))
    return (
        F.when(~col(house).eqNullSafe(F.lit(upper)), col(constituency))
        .when(nominated, F.lit("Nominated"))
    )


def parse_amount(c) -> Column:
    """Digits and dots of a money text as a double; 0 when there are none."""
    digits = F.regexp_replace(F.coalesce(col(c), F.lit("")), "[^0-9.]", "")
    return F.when(digits == "", F.lit(0.0)).otherwise(digits.try_cast("double"))


def contains_text(c, needle: str) -> Column:
    """Case-insensitive containment; ``%`` and ``_`` are ordinary characters."""
    return F.coalesce(F.contains(F.lower(col(c)), F.lit(needle.lower())), F.lit(False))


def text_rank(c, needle: str) -> Column:
    """How early a needle stands: 0 leads the text, 1 leads a word, 2 is inside one, 3 is absent
    from this column."""
    text = F.lower(F.coalesce(col(c), F.lit("")))
    at = F.locate(needle.lower(), text)
    preceding = F.substr(text, F.greatest(at - 1, F.lit(1)), F.lit(1))
    return (
        F.when(at == 1, 0).when((at > 1) & (preceding == " "), 1).when(at > 1, 2).otherwise(3)
    )


def text_position(c, needle: str) -> Column:
    """Zero-based position of the needle, 9999 when it is elsewhere."""
    at = F.locate(needle.lower(), F.lower(F.coalesce(col(c), F.lit(""))))
    return F.when(at > 0, at - 1).otherwise(9999)


def name_tokens(c) -> Column:
    """Name tokens for registry matching: no parentheses, honorifics or single letters."""
    text = F.lower(F.coalesce(col(c), F.lit("")))
    text = F.regexp_replace(text, r"\(.*?\)", " ")
    text = F.trim(F.regexp_replace(text, "[^a-z]+", " "))
    return _drop_tokens(text, MATCH_HONORIFICS)


def seat_key(c) -> Column:
    """Seat name without its reservation mark, letters only."""
    text = F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), r"\((sc|st)\)", "")
    return F.regexp_replace(text, "[^a-z]", "")


def term_years(c) -> Column:
    """``2024-30`` or ``2024-2030`` -> struct(2024, 2030); NULL without such a span."""
    pattern = r"(\d{4})\s*-\s*(\d{2,4})"
    text = F.coalesce(col(c), F.lit(""))
    start = F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).cast("int")
    tail = F.nullif(F.regexp_extract(text, pattern, 2), F.lit(""))
    century = (F.floor(start / 100) * 100).cast("int")
    end = F.when(F.length(tail) == 4, tail.cast("int")).otherwise(century + tail.cast("int"))
    return F.when(start.isNotNull(), F.struct(start.alias("from_year"), end.alias("to_year")))
