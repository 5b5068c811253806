"""Secrets in texts: fixed patterns, and strings whose characters are too evenly spread.

Everything is a DataFrame expression. The places of a pattern's matches come from the matches
and the pieces between them: a match begins after all earlier pieces and matches. Candidate
strings of the entropy rule are runs of token characters; a window slides over each, and the
sum of n * log2(n) over its characters' counts is kept by taking the leaving character's count
down and the entering one's up. The largest entropy is held against the limit of the
candidate's class of characters; letters alone are judged where both cases come often. Of a
candidate that overlaps matches of a fixed pattern, the parts outside all of these are judged,
each on its own. What is on the allow-list is left out.

A text is taken in segments of about SEGMENT code points, cut where no match can reach over: at
a line's end, or at spaces that stand beside no colon or equals sign. So the places of any
number of matches cost time in proportion to the text.

The limits let 97 of 100 random strings of 20 characters pass as secrets, and more of longer ones.

Places are code points, the end exclusive. Defined results: a null text is empty and has no
spans, so its list is empty text; texts are read whole; equal places are ordered by kind;
repeated rows, null ids and an empty table need no case. ``redacted`` keeps all columns of its
input, whatever their names, and a null text stays null. Overlapping spans are redacted as one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
          r"""([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
VALUE_LEAST, ACCESS_LEAST = 6, 20
KINDS = ("assign", "access", "hex", "entropy")

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Classes of candidates, and from which entropy in bits a window is too even for prose.
CLASSES = ((r"^[0-9]+$", math.inf), (r"^[0-9a-f]+$|^[0-9A-F]+$", 3.0),
           (r"^[0-9a-z_-]+$|^[0-9A-Z_-]+$", 3.5), (r"^[A-Za-z]+$", 3.65), (r"", 3.7))
#: What a candidate must hold: a digit and a letter, or four letters of either case.
MIXED = ((r"[0-9]", r"[A-Za-z]"), (r"([A-Z][^A-Z]*){4}", r"([a-z][^a-z]*){4}"))
#: Code points of a segment, unless no cut comes sooner, and what ends one.
SEGMENT = 4000
CUT = r"(?:(?<=[^:=\x20])\x20+(?=[^:=\x20])|\n|\z)"
ALLOW = (r"(?i)example|sample|dummy|placeholder|change_?me|redacted|your[_-]",
         r"(?i)abcdefgh|01234567|12345678|qwerty", r"(.)\1{5}",
         r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$", r"^[A-Za-z]+(/[a-z_-]+)+$",
         r"^[0-9/_-]+$")
SCALE = 1_000_000
SPANS = "array<struct<start:int,kind:int,end:int,value:string>>"


def _weight(n: int) -> int:
    return round(n * math.log2(n) * SCALE) if n else 0


def most_sum(bits: float) -> int:
    """The sum over a window's counts that an entropy of ``bits`` leaves at most."""
    return -1 if math.isinf(bits) else math.floor((math.log2(WINDOW) - bits) * WINDOW * SCALE)


def _none(kind: str = SPANS) -> Column:
    return F.array().cast(kind)


def located(text: Column, hits: Column, pattern: str, kind: int) -> Column:
    """Spans of the ``hits`` of a pattern in a text, in order."""
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits))
    pairs = F.zip_with(hits, gaps, lambda h, g: F.struct(h.alias("hit"), F.length(g).alias("gap")))

    def add(done: Column, x: Column) -> Column:
        start = F.coalesce(F.try_element_at(done, F.lit(-1))["end"], F.lit(0)) + x["gap"]
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"),
                        (start + F.length(x["hit"])).alias("end"), x["hit"].alias("value"))
        return F.concat(done, F.array(span))
    return F.when(F.size(hits) > 0, F.aggregate(pairs, _none(), add)).otherwise(_none())


def evenness(value: Column) -> Column:
    """Smallest sum of n * log2(n), scaled, over the windows of a candidate."""
    table = F.array(*[F.lit(_weight(n)) for n in range(WINDOW + 1)])

    def count(window: Column, c: Column) -> Column:
        return F.length(window) - F.length(F.replace(window, c, F.lit("")))

    def change(n: Column) -> Column:  # from n to n + 1 of a character
        return F.element_at(table, n + 2) - F.element_at(table, n + 1)

    def slide(state: Column, p: Column) -> Column:
        old = F.substring(value, F.greatest(p - WINDOW, F.lit(1)), F.least(p - 1, F.lit(WINDOW)))
        kept = F.when(p > WINDOW, F.substring(value, p - WINDOW + 1, F.lit(WINDOW - 1))).otherwise(old)
        leaving = F.when(p > WINDOW, change(count(old, F.substring(old, F.lit(1), F.lit(1))) - 1))
        total = (state["total"] - F.coalesce(leaving, F.lit(0))
                 + change(count(kept, F.substring(value, p, F.lit(1)))))
        least = F.when(p >= WINDOW, F.least(state["least"], total)).otherwise(state["least"])
        return F.struct(total.cast("long").alias("total"), least.cast("long").alias("least"))
    begin = F.struct(F.lit(0).cast("long").alias("total"), F.lit(2**62).cast("long").alias("least"))
    return F.aggregate(F.sequence(F.lit(1), F.length(value)), begin, slide, lambda s: s["least"])


def too_even(value: Column, classes=CLASSES, allow=ALLOW) -> Column:
    limit = F.lit(most_sum(classes[-1][1]))
    for pattern, bits in reversed(classes[:-1]):
        limit = F.when(value.rlike(pattern), F.lit(most_sum(bits))).otherwise(limit)
    known = F.lit(False)
    for pattern in allow:
        known = known | value.rlike(pattern)
    mixed = F.lit(False)
    for one, two in MIXED:
        mixed = mixed | (value.rlike(one) & value.rlike(two))
    # Conditions in turn: the windows are counted only where all else holds.
    return F.when(mixed, F.when(~known, evenness(value) <= limit)).eqNullSafe(F.lit(True))


def _spans(seg: Column) -> Column:
    """One segment and its spans: (text, base, more)."""
    hits = F.struct(seg.alias("text"), *[F.regexp_extract_all(seg, F.lit(p), F.lit(0)).alias(f"hits{k}")
                                         for k, p in enumerate((ASSIGN, ACCESS, HEX, CANDIDATE))])

    def fixed(x: Column) -> Column:
        spans = [located(x["text"], x[f"hits{k}"], p, k) for k, p in enumerate((ASSIGN, ACCESS, HEX))]
        good = [F.filter(spans[0], lambda s: F.length(F.regexp_extract(
                    s["value"], ASSIGN, 1)) >= VALUE_LEAST),
                F.filter(spans[1], lambda s: F.length(s["value"]) >= ACCESS_LEAST), spans[2]]
        some = F.size(x["hits0"]) + F.size(x["hits1"]) + F.size(x["hits2"]) > 0
        return F.struct(x["text"], x["hits3"], F.when(some, F.array_sort(F.concat(*good))).otherwise(
            _none()).alias("base"))

    def whole(x: Column) -> Column:
        spans = located(x["text"], x["hits3"], CANDIDATE, 3)
        # Without a match or an uneven candidate nothing is left to place.
        likely = F.exists(x["hits3"], lambda v: too_even(v))
        more = F.when(F.size(x["base"]) > 0, F.filter(outside(spans, x["base"]), lambda s: too_even(
            s["value"]))).when(likely, F.filter(spans, lambda s: too_even(s["value"])))
        return F.struct(x["text"].alias("text"), x["base"].alias("base"),
                        F.coalesce(more, _none()).alias("more"))
    return F.transform(F.transform(F.transform(F.array(hits), lambda x: x), fixed), whole)[0]


def segmented(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` as ``row``, and the segments of their texts with their spans."""
    segments = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(
        rf"(?s).{{1,{SEGMENT}}}{CUT}|.+?{CUT}"), F.lit(0))
    return docs.select(F.struct(*docs.columns).alias("row"),
                       F.transform(segments, _spans).alias("segs"))


def with_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` as ``row``, and the spans of the fixed patterns (``base``) and of the
    entropy rule (``more``): arrays of (start, kind, end, value), places in the whole text."""
    found = segmented(docs, text_col).withColumn("starts", F.aggregate(
        "segs", F.array(F.lit(0)), lambda done, x: F.concat(
            done, F.array(F.element_at(done, F.lit(-1)) + F.length(x["text"])))))

    def moved(name: str) -> Column:
        def shift(x: Column, start: Column) -> Column:
            return F.transform(x[name], lambda s: F.struct(
                (s["start"] + start).alias("start"), s["kind"].alias("kind"),
                (s["end"] + start).alias("end"), s["value"].alias("value")))
        spread = F.flatten(F.zip_with("segs", F.slice("starts", F.lit(1), F.size("segs")), shift))
        return F.coalesce(spread, _none())
    return found.select("row", moved("base").alias("base"), moved("more").alias("more"))


def outside(spans: Column, base: Column) -> Column:
    """Of the ``spans`` the parts of a window or more that lie outside all of ``base`` (in order)."""
    def parts(s: Column) -> Column:
        def part(a: Column, b: Column) -> Column:
            value = F.substring(s["value"], a - s["start"] + 1, b - a)
            one = F.array(F.struct(a.alias("start"), s["kind"].alias("kind"), b.alias("end"),
                                   value.alias("value")))
            return F.when(b - a >= WINDOW, one).otherwise(_none())

        def add(state: Column, b: Column) -> Column:
            meets = (b["start"] < s["end"]) & (s["start"] < b["end"])
            return F.struct(
                F.when(meets, F.greatest(state["at"], b["end"])).otherwise(state["at"]).alias("at"),
                F.when(meets, F.concat(state["out"], part(state["at"], b["start"]))).otherwise(
                    state["out"]).alias("out"))
        begin = F.struct(s["start"].alias("at"), _none().alias("out"))
        return F.aggregate(base, begin, add,
                           lambda x: F.concat(x["out"], part(x["at"], s["end"])))
    return F.flatten(F.transform(spans, parts))


def listed(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])), ",")


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: how many spans of each kind, and where all spans lie."""
    found = with_spans(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))

    def number(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        F.col("row.id").alias(id_col), number(0).alias("n_assign"), number(1).alias("n_access"),
        number(2).alias("n_hex"), F.size("more").cast("long").alias("n_entropy"),
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.array_sort(F.concat("base", "more"))).alias("spans"))


def redacted(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of the text replaced by ``mark``; rows and columns stay."""
    def clean(seg: Column) -> Column:
        text = seg["text"]

        def add(state: Column, s: Column) -> Column:
            gap = F.when(s["start"] >= state["to"], F.concat(state["out"], F.substring(
                text, state["to"] + 1, s["start"] - state["to"]), F.lit(mark)))
            return F.struct(F.greatest(state["to"], s["end"]).alias("to"),
                            F.coalesce(gap, state["out"]).alias("out"))
        spans = F.concat(seg["base"], seg["more"])
        return F.when(F.size(spans) > 0, F.aggregate(
            F.array_sort(spans), F.struct(F.lit(0).alias("to"), F.lit("").alias("out")), add,
            lambda s: F.concat(s["out"], F.substring(text, s["to"] + 1, F.length(text))))).otherwise(text)
    some = F.exists("segs", lambda x: F.size(x["base"]) + F.size(x["more"]) > 0)
    whole = F.when(some, F.array_join(F.transform("segs", clean), "")).otherwise(
        F.col(f"row.`{text_col}`"))
    return segmented(docs, text_col).select(*[
        whole.alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns])
