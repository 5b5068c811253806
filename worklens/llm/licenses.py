"""License notices in texts: an exact set-similarity join of text blocks with notice templates.

A word is a run of digits, letters and bytes above 0x7F, in lower case. A template is the set of
words of a notice; a block is a stretch of a text, at two widths, each twice as wide as the
longest template of its class and moved on by half its width, so that every notice lies whole in
some block. A block meets a template if it holds at least CONTAINED of the template's words.

Only words of some template matter, and each text keeps those with their places, so texts are
read once. The words are ranked by the number of texts that hold them, rarest first, and each
block is its ranks in order. The join is on a rank among the first few of a template (its
prefix: fewer words than that cannot be missing), with a bound by length (the block has words
enough) and one by position (the words from here on, in both, are enough). Candidates are then
counted exactly. The ranks, at most as many as template words, are the only thing gathered.

Notices that are nearly alike hold most of each other's words, so a template also names the words
it cannot do without (``NEEDED``): a block without all of them does not meet it. And of two
templates one of which holds at least CONTAINED of the other's words, a block that meets both is
labelled by the one with the more words shared; the other loses (ties keep both).

Besides, the places of the base phrases are found, and labelled as such.

Defined results: a null or empty text has no words, no labels and score 0; texts are read whole;
repeated rows are judged alike, also where they share an id; null ids are kept; labels are
distinct, in order; an empty table gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CONTAINED = 0.8
#: Phrases and their labels (fixed values).
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"),
        ("cc by nc", "cc-by-nc"))
#: Notices by which licenses are applied, and their labels.
NOTICES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
            "software and associated documentation files"),
    ("apache-2", "Licensed under the Apache License, Version 2.0; you may not use this file except "
                 "in compliance with the License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are "
            "permitted provided that the following conditions are met"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the "
            "terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("lgpl", "This library is free software: you can redistribute it and/or modify it under the "
             "terms of the GNU Lesser General Public License"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with "
            "or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc0", "CC0 1.0 Universal Public Domain Dedication"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 "
                 "International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 "
                 "International License"),
)
#: Words without which a notice is another license's.
NEEDED = {"lgpl": ("lesser", "library"), "gpl": ("program",), "gpl-3": ("3",), "cc-by": ("attribution",),
          "cc-by-nc": ("noncommercial",), "cc-by-sa": ("sharealike",)}
#: Classes of templates by their length in words; a block has twice as many. A notice longer
#: than all of them adds a class of twice the last, and so on.
CLASSES = (16, 48)


def classes_of(notices=NOTICES) -> tuple[int, ...]:
    out, longest = list(CLASSES), max((len(re.findall("[0-9a-z]+", n.lower())) for _, n in notices),
                                      default=0)
    while out[-1] < longest:
        out.append(2 * out[-1])
    return tuple(out)


def templates(notices=NOTICES) -> list[tuple[str, int, list[str]]]:
    """Label, class and words of each notice."""
    out = []
    for label, notice in notices:
        found = re.findall("[0-9a-z]+", notice.lower())
        size = next(c for c in classes_of(notices) if len(found) <= c)
        out.append((label, size, sorted(set(found))))
    return out


def rivals(found: list[tuple[str, int, list[str]]], contained: float = CONTAINED) -> dict[str, list[str]]:
    """For each label those that a block of its words may meet too, or the other way round."""
    def near(a: list[str], b: list[str]) -> bool:
        return len(set(a) & set(b)) >= contained * min(len(a), len(b)) - 1e-9
    return {one: [two for two, _, b in found if two != one and near(a, b)] for one, _, a in found}


def lowered(text: Column) -> Column:
    """A-Z in lower case. Of other letters only two have a lower case that holds one of a-z."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(text.rlike("[İK]"), F.translate(text, upper, upper.lower())).otherwise(
        F.lower(text))


def _base(words: Column) -> dict[str, Column]:
    """Places of the base phrases, from the words set apart by single spaces. No two places
    overlap, since no phrase begins with words that another, or the same, ends with."""
    line = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    pattern = "(?<= )(?:" + "|".join(p for p, _ in BASE) + ")(?= )"
    likely = F.lit(False)
    for phrase, _ in BASE:
        likely = likely | F.array_contains(words, phrase.split()[-2])
    hits = F.when(likely, F.regexp_extract_all(line, F.lit(pattern), F.lit(0))).otherwise(
        F.array().cast("array<string>"))

    def spaces(c: Column) -> Column:
        return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))

    def starts(found: Column) -> Column:
        pairs = F.zip_with(found, F.slice(F.split(line, pattern, -1), F.lit(1), F.size(found)),
                           lambda h, g: F.struct(h.alias("h"), g.alias("g")))

        def add(s: Column, x: Column) -> Column:
            at = s["next"] + spaces(x["g"]) - 1
            return F.struct((at + spaces(x["h"]) + 1).alias("next"),
                            F.coalesce(s["first"], at).alias("first"), at.alias("last"))
        begin = F.struct(F.lit(0).alias("next"), F.lit(None).cast("int").alias("first"),
                         F.lit(None).cast("int").alias("last"))
        return F.aggregate(pairs, begin, add)
    return {"hits": hits, "starts": starts}


def scanned(docs: DataFrame, id_col: str, text_col: str, vocabulary: list[str]) -> DataFrame:
    """One row a document: words, base places and labels, and the template words with places."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("id", F.xxhash64("text").alias("same"), F.regexp_extract_all(
        lowered(F.col("text")), F.lit(WORD), F.lit(0)).alias("words"))
    base = _base(F.col("words"))
    kept = F.filter(F.transform("words", lambda w, i: F.when(w.isin(vocabulary), F.struct(
        i.alias("at"), w.alias("word")))), lambda x: x.isNotNull())
    rows = rows.select("id", "same", "words", kept.alias("kept"), base["hits"].alias("hits"))
    starts = F.when(F.size("hits") > 0, base["starts"](F.col("hits")))
    rows = rows.select("id", "same", F.size("words").cast("long").alias("n_words"), "kept", "hits",
                       starts.alias("starts"))
    labels = F.transform(F.array_distinct("hits"), _named)
    return rows.select(
        "id", "same", "n_words", "kept", F.size("hits").cast("long").alias("n_base"),
        F.col("starts.first").cast("long").alias("first_word"),
        F.col("starts.last").cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(labels)).alias("base_labels"))


def _named(phrase: Column) -> Column:
    other = F.lit(None).cast("string")
    for p, name in BASE:
        other = F.when(phrase == p, name).otherwise(other)
    return other


def ranked(rows: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Each template word's rank by the number of texts that hold it, rarest first."""
    counts = {r["word"]: r["n"] for r in rows.select(F.explode(F.array_distinct(
        F.transform("kept", lambda k: k["word"]))).alias("word")).groupBy("word").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    order = sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))
    return {w: k for k, w in enumerate(order)}


def _prefix_table(spark: SparkSession, found, ranks, contained: float) -> DataFrame:
    """(rank, place, label, class, size, need, all): the prefix of each template."""
    rows = []
    for number, (label, size, words) in enumerate(found):
        order = sorted(ranks[w] for w in words)
        need = math.ceil(contained * len(order) - 1e-9)
        musts = sorted(ranks[w] for w in NEEDED.get(label, ()) if w in words)
        rows += [(r, k, number, label, size, len(order), need, order, musts)
                 for k, r in enumerate(order[:len(order) - need + 1])]
    return spark.createDataFrame(rows, "rank int, place int, template int, label string, class int, "
                                       "size int, need int, ranks array<int>, musts array<int>")


def matches(rows: DataFrame, notices=NOTICES, contained: float = CONTAINED) -> DataFrame:
    """(id, same, label, share): for each text and label, the largest share of a template's
    words that a block holds, where it is at least ``contained``."""
    spark, found = rows.sparkSession, templates(notices)
    vocabulary = sorted({w for _, _, words in found for w in words})
    ranks = ranked(rows, vocabulary)
    # One row for each word in a template's prefix.
    table = _prefix_table(spark, found, ranks, contained)
    leading = sorted({w for _, _, words in found
                      for w in sorted(words, key=ranks.get)[:len(words) - math.ceil(
                          contained * len(words) - 1e-9) + 1]})
    likely = rows.filter(F.exists("kept", lambda k: k["word"].isin(leading))).select(
        "id", "same", F.explode("kept").alias("k"))
    names = spark.createDataFrame(list(ranks.items()), "word string, rank int")
    placed = likely.select("id", "same", "k.at", F.col("k.word").alias("word")).join(
        F.broadcast(names), "word")
    blocks = placed.select("id", "same", "rank", F.explode(F.array(*[
        F.struct(F.lit(c).alias("class"), (F.floor(F.col("at") / c) - back).cast("int")
                 .alias("block")) for c in classes_of(notices) for back in (0, 1)])).alias("b"))
    blocks = blocks.groupBy("id", "same", "b.class", "b.block").agg(
        F.array_sort(F.collect_set("rank")).alias("own"))
    blocks = blocks.filter(F.size("own") >= min(math.ceil(contained * len(w) - 1e-9)
                                                for _, _, w in found))
    probes = blocks.select("id", "same", F.col("class").alias("of"), "block", "own",
                           F.posexplode("own").alias("at", "probe"))
    left = F.least(F.col("size") - F.col("place"), F.size("own") - F.col("at"))
    pairs = probes.join(F.broadcast(table), (F.col("probe") == F.col("rank"))
                        & (F.col("of") == F.col("class"))
                        & (F.size("own") >= F.col("need"))
                        & (F.least("place", "at") + left >= F.col("need")))
    shared = F.size(F.array_intersect("own", "ranks"))
    pairs = pairs.filter((shared >= F.col("need"))
                         & (F.size(F.array_except("musts", "own")) == 0)).select(
        "id", "same", "of", "block", "label", shared.alias("shared"),
        (shared / F.col("size")).alias("share"))
    # A block meets a label once for each word of the prefix; a block's few labels are held together.
    met = pairs.groupBy("id", "same", "of", "block").agg(
        F.collect_set(F.struct("label", "shared", "share")).alias("met"))
    against = F.create_map(*[c for k, v in rivals(found, contained).items()
                             for c in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))])
    best = F.filter("met", lambda m: ~F.exists("met", lambda o: F.array_contains(
        F.element_at(against, m["label"]), o["label"]) & (o["shared"] > m["shared"])))
    return met.select("id", "same", F.explode(best).alias("m")).groupBy(
        "id", "same", F.col("m.label").alias("label")).agg(F.max("m.share").alias("share"))


def license_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   notices=NOTICES, contained: float = CONTAINED) -> DataFrame:
    """One row a document: words, places of the base phrases, labels and the score, which is 1
    for a base phrase and else the largest share of a notice."""
    vocabulary = sorted({w for _, _, words in templates(notices) for w in words})
    rows = cut(scanned(docs, id_col, text_col, vocabulary), "license-words")
    told = matches(rows, notices, contained).groupBy(
        F.col("id").alias("m_id"), F.col("same").alias("m_same")).agg(
        F.collect_set("label").alias("more"), F.max("share").alias("share"))
    both = rows.drop("kept").join(told, F.col("id").eqNullSafe(F.col("m_id"))
                                  & (F.col("same") == F.col("m_same")), "left")
    none = F.array().cast("array<string>")
    return both.select(
        F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word",
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base_labels", F.coalesce("more", none))), ",")
        .alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"))
