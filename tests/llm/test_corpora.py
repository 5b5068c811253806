"""Operators that look across documents: near copies, repeated passages, mixing, the pipeline."""

import random
import sys
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))
sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent))

import brute  # noqa: E402
import corpus_pipeline  # noqa: E402
from worklens.llm import QUERIES, mixing, near_dup, pieces, repeats, secret_spans, toxicity  # noqa: E402
from worklens.session import cut  # noqa: E402

SF = "/root/testdata/sf0.001"


def frame(spark, texts, start=0):
    return spark.createDataFrame([(k + start, t) for k, t in enumerate(texts)], "doc_id long, text string")


def prose(rng, n):
    return [f"w{rng.randrange(3000)}" for _ in range(n)]


# Near copies

def classes(frame_):
    return {r.doc_id: r.class_id for r in near_dup.classes(frame_).collect()}


def test_near_copies_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: r.class_id for r in QUERIES["op2_near_duplicates"](spark, SF).collect()}
    assert got == brute.near_classes(rows)


def test_a_group_of_edited_copies(spark):
    """Copies with more and fewer edits than a link allows, and copies of a copy."""
    rng = random.Random(7)
    base = prose(rng, 150)
    texts = []
    for k in range(160):
        own = list(base)
        for _ in range(rng.randrange(9)):
            own[rng.randrange(len(own))] = f"n{k}x{rng.randrange(99)}"
        texts.append(" ".join(own))
    for k in range(40):  # a second group, linked to the first by no single edit
        own = texts[5].split()
        own[::9] = [f"q{j}" for j in range(len(own[::9]))]
        if k % 3:
            own[rng.randrange(len(own))] = f"z{k}"
        texts.append(" ".join(own))
    texts += [" ".join(prose(rng, 120)) for _ in range(40)]
    got, want = classes(frame(spark, texts)), brute.near_classes(list(enumerate(texts)))
    assert got == want


def test_members_that_the_lead_does_not_link(spark):
    """In the second step only pairs that can be alike are compared."""
    rng = random.Random(2)
    base = prose(rng, 100)
    rows = [(0, base)]
    for k in range(1, 80):
        own = list(base)
        for j in rng.sample(range(100), 6):
            own[j] = f"u{k}x{j}"
        rows.append((k, own))
        if k % 20 == 0:
            rows.append((100 + k, own[:-1] + ["last"]))
    units = {k: sorted({hash(u) % 2**32 for u in brute.weighted(" ".join(t))}) for k, t in rows}
    import numpy as np
    table = spark.createDataFrame(
        [(k, bytearray(np.array(u, np.uint32).tobytes())) for k, u in units.items()], "node long, units binary")
    stars = spark.createDataFrame([(0, k, len(units[k])) for k, _ in rows if k], "a long, b long, n long")
    roots = spark.createDataFrame([(0, 0)], "node long, root long")
    pairs = {(r.a, r.b) for r in near_dup._rest(stars, roots, table, 0.8).collect()}
    assert {(20, 120), (40, 140), (60, 160)} <= pairs
    assert len(pairs) < 200  # of more than 3,000


def test_signature_agrees_as_often_as_texts_are_alike():
    import numpy as np
    rng = random.Random(1)
    a = prose(rng, 400)
    b = list(a)
    for k in range(12):
        b[30 * k] = f"e{k}"
    raw = [" ".join(x).encode() for x in (a, b, ["tiny"], ["tiny"])]
    at = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    doc, units, _ = near_dup.elements(np.frombuffer(b"".join(raw), np.uint8), at)
    sign = near_dup.throw(doc, units, 4)
    x, y = brute.weighted(raw[0].decode()), brute.weighted(raw[1].decode())
    assert abs((sign[0] == sign[1]).mean() - len(x & y) / len(x | y)) < 0.12
    assert (sign[2] == sign[3]).all() and (sign != 0).all()


def test_a_text_and_itself_with_a_passage_repeated(spark):
    """A run that stands once in one text and twice in the other is shared once."""
    import numpy as np
    rng = random.Random(11)
    texts = []
    for _ in range(20):
        own = [f"w{k}" for k in rng.sample(range(3000), 100)]
        texts += [" ".join(own), " ".join(own + own[-15:])]
    raw = [t.encode() for t in texts[:2]]
    at = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    doc, units, _ = near_dup.elements(np.frombuffer(b"".join(raw), np.uint8), at)
    one, two = set(units[doc == 0].tolist()), set(units[doc == 1].tolist())
    x, y = brute.weighted(texts[0]), brute.weighted(texts[1])
    assert (len(one & two), len(one | two)) == (len(x & y), len(x | y))
    got, want = classes(frame(spark, texts)), brute.near_classes(list(enumerate(texts)))
    assert got == want and len(set(want.values())) == 20


def test_near_copies_of_odd_rows(odd, none):
    got = {}
    for r in near_dup.classes(odd).collect():
        got.setdefault(r.doc_id, set()).add(r.class_id)
    assert got == {1: {1}, 2: {1}, 3: {3}, 4: {4}, None: {None}, 5: {5}, 6: {6}, 7: {3}}
    kept = near_dup.without_near_copies(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "4", "4", "5", "6", "None"]
    assert near_dup.classes(none).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(200, 260)] + [(1, k) for k in range(2, 90)] + [(300, 299), (299, 300)]
    got = {r.node: r.root for r in near_dup.components(
        spark.createDataFrame(links, "a long, b long")).collect()}
    assert set(got.values()) == {1, 200, 299} and len(got) == 61 + 89 + 2


# Repeated passages

def removed(frame_):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in repeats.without_repeats(frame_).collect()}


def test_repeats_query(spark):
    import hashlib
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = brute.without_repeats(rows)
    for r in QUERIES["op7_repeated_passages"](spark, SF).collect():
        n, gone, kept = want[r.doc_id]
        assert (r.n_words, r.n_removed) == (n, gone)
        assert r.kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_passages_that_overlap(spark, seed):
    rng = random.Random(seed)
    passages = [prose(rng, rng.randrange(18, 60)) for _ in range(6)] + [["a"] * 45, ["a", "b"] * 25]
    texts = []
    for _ in range(60):
        own = []
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages)
            cut_at = rng.randrange(len(p))
            own += rng.choice([p, p[cut_at:], p[:cut_at]]) + prose(rng, rng.randrange(3))
        texts.append(" ".join(own))
    texts += [None, "", texts[3], texts[3]]
    rng.shuffle(texts)
    assert removed(frame(spark, texts).repartition(5)) == brute.without_repeats(list(enumerate(texts)))


def test_chunks_match_among_themselves(spark, monkeypatch):
    """A passage that every row holds, over many chunks and batches."""
    rng = random.Random(9)
    passage = " ".join(prose(rng, 40))
    texts = [" ".join(prose(rng, 5)) + " " + passage for _ in range(300)]
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert removed(frame(spark, texts)) == brute.without_repeats(list(enumerate(texts)))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)


def test_factors_point_to_earlier_places(spark):
    rng = random.Random(4)
    p = prose(rng, 50)
    texts = [" ".join(prose(rng, 7) + p), " ".join(prose(rng, 3) + p[5:45] + prose(rng, 2))]
    got = {r.doc_id: r.factors for r in repeats.without_repeats(frame(spark, texts)).collect()}
    assert got[0] == [] and [tuple(f) for f in got[1]] == [(3, 40, 0, 12)]


def test_a_common_phrase_is_dealt_by_what_stands_beside_it(spark):
    rng = random.Random(11)
    said = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    phrases = [said(12) for _ in range(6)]
    texts = [" ".join(sum(([*said(15), *p] for p in phrases), said(0)) + said(15))
             for _ in range(300)]
    docs = frame(spark, texts).select(
        F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("text"))
    most = docs.mapInArrow(repeats._index, repeats.STRETCH).groupBy("anchor").count().agg(
        F.max("count")).first()[0]
    assert most <= 3
    assert repeats.without_repeats(frame(spark, texts)).agg(F.sum("n_removed")).first()[0] == 0


def test_repeats_of_odd_rows(odd, none):
    got = {}
    for r in repeats.without_repeats(odd).collect():
        got.setdefault(r.doc_id, set()).add((r.n_words, r.n_removed > 0))
    assert got[1] == {(0, False)} and got[None] == {(3, False)}
    assert got[4] == {(60_000, True)}  # it repeats itself; its second row is the same document
    assert repeats.without_repeats(none).count() == 0


# Mixing

@pytest.mark.parametrize("totals", [[5, 5, 5], [100, 1, 1, 1], [1, 1000, 3, 0], [7], [0, 0],
                                    [10, 20, 30, 40, 50, 60, 70]])
def test_targets_equal_resharing(spark, totals):
    sizes = spark.createDataFrame([(f"s{k}", t) for k, t in enumerate(totals)],
                                  "mix_source string, mix_total long")
    got = {r.mix_source: r.mix_target for r in mixing.targets(sizes).collect()}
    for k, want in enumerate(brute.levelled(totals)):
        assert got[f"s{k}"] == pytest.approx(want)


def test_mix_comes_near_and_repeats_itself(spark):
    rng = random.Random(5)
    rows = [(k, " ".join(["w"] * rng.randrange(60)), rng.choice(["a", "a", "a", "é", None, "z"]))
            for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first, again = mixing.mix_report(docs), mixing.mix_report(docs.repartition(7))
    assert sorted(first.collect()) == sorted(again.collect())
    got = first.groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect()
    assert len(got) == 4
    for r in got:
        assert abs(r.taken - r.target) <= 30 and r.target <= 2 * r.source_size
    assert first.filter("taken > 2 * size").count() == 0
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    taken = mixed.withColumn("n", mixing.n_words(F.col("text"))).agg(F.sum("n")).first()[0]
    assert taken == first.agg(F.sum("taken")).first()[0]


def test_mixes_are_nested(spark):
    docs = spark.createDataFrame([(k, "w " * (k % 9 + 1), "s") for k in range(300)],
                                 "doc_id long, text string, source string")
    small, large = ({r.doc_id for r in mixing.mix_report(docs, share=s).filter("taken > 0").collect()}
                    for s in (0.3, 0.6))
    assert small < large


def test_mixing_odd_rows(odd, none):
    got = mixing.mix_report(odd).collect()
    assert len(got) == 9 and all(r.taken <= 2 * r.size for r in got)
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns and mixed.filter("doc_id = 4").count() == 2 * 1
    assert mixing.mix_report(none).count() == 0 and mixing.mix(none).count() == 0


# Pipeline

def test_pipeline_equals_its_stages_by_hand(spark):
    """Each stage by a plain version on what the one before kept."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(docs, labels)
    import pyarrow as pa
    rows = docs.collect()
    scores = toxicity.scores(pa.array([(r.text or "").encode() for r in rows]), model)
    kept = {r.doc_id: r for r, x in zip(rows, scores) if x < toxicity.THRESHOLD}
    found = brute.near_classes([(i, r.text) for i, r in kept.items()])
    kept = {i: r for i, r in kept.items() if found[i] == i}
    spans = {r.doc_id: r.spans for r in secret_spans.secret_report(
        spark.createDataFrame(list(kept.values()), docs.schema)).collect()}
    clean = []
    for i, r in kept.items():
        text = r.text
        places = [tuple(map(int, s.split(":")[1:])) for s in spans[i].split(",") if s]
        merged = []
        for a, b in sorted(places):
            if merged and a < merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        for a, b in reversed(merged):
            text = text[:a] + "[SECRET]" + text[b:]
        clean.append((i, text, r.lang, r.source, len(text)))
    frame_ = cut(spark.createDataFrame(clean, docs.schema), "by-hand")
    times = {r.doc_id: r.taken // r.size if r.size else 0 for r in mixing.mix_report(frame_).collect()}
    v = pieces.load()
    want = sorted((i, lang, source, tuple(pieces.stream(pieces.marked(text), v)))
                  for i, text, lang, source, _ in clean for _ in range(times[i]))
    got = sorted((r.doc_id, r.lang, r.source, tuple(r.ids))
                 for r in corpus_pipeline.run(spark, SF).collect() if r.n_ids)
    assert got == [w for w in want if w[3]]


def test_stages_keep_the_columns(spark, odd):
    docs = odd.withColumn("n_chars", F.length("text").cast("long"))
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut(stage(spark, docs, SF), name)
        assert docs.columns == names, name
    assert isinstance(corpus_pipeline.STAGES[-1][1](spark, docs, SF).toPandas(), pd.DataFrame)
