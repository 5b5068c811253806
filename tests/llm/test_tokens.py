"""Byte-level BPE, alignment of two tokenizers, and hard negatives."""

import hashlib
import random
import sys
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, str(Path(__file__).resolve().parent))

import brute  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from worklens.llm import QUERIES, align, bpe, hard_negatives  # noqa: E402

SF = "/root/testdata/sf0.001"
ODD_TEXTS = [None, "", " ", "a▁b", "x  y <|endoftext|> <s></s>", "ﬁ x", " lead  \t z \n\n",
             "日本語 ünï \U0001f642", "it's I'LL 12three", "a" * 700, "x  y <|endoftext|> <s></s>"]


# BPE

@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(bpe.VOCABULARY)


def _ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("the ing'ss1 \n")),
                        max_size=150), max_size=4))
def test_bpe_equals_the_library(library, texts):
    texts = [*texts, "<|endoftext|>".join(texts)]
    v = bpe.load()
    library.encode_special_tokens = False
    for text, packed in zip(texts, bpe.encode(texts, v)):
        assert _ids(packed) == library.encode(text, add_special_tokens=False).ids
    library.encode_special_tokens = True
    for text, packed in zip(texts, bpe.encode(texts, v, special=False)):
        assert _ids(packed) == library.encode(text, add_special_tokens=False).ids


def test_bpe_knows_every_code_point_as_the_library_does(library):
    library.encode_special_tokens = False
    every = [chr(c) for c in range(1, 0x110000, 7) if not 0xD800 <= c <= 0xDFFF]
    texts = [f"a{c}b1{c}2 {c}{c} {c}" for c in every]
    wanted = library.encode_batch(texts, add_special_tokens=False)
    assert all(_ids(p) == w.ids for p, w in zip(bpe.encode(texts, bpe.load()), wanted))


def test_bpe_trees_of_every_size_agree(library):
    draw, v = random.Random(5), bpe.load()
    for letters in ("ab", "abcdefghij", "the", "é\U0001f642a"):
        for n in [*range(1, 40), 63, 64, 65, 128, 129, 1000, 20_000]:
            text = "".join(draw.choice(letters) for _ in range(n))
            symbols = v.byte[np.frombuffer(text.encode(), np.uint8)].tolist()
            ids = bpe._alone(symbols, v)
            assert ids == _ids(bpe.merge([text], v)[0])
            assert ids == library.encode(text, add_special_tokens=False).ids


def test_bpe_query_equals_the_library(spark, library):
    library.encode_special_tokens = False
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: r for r in QUERIES["op12_bpe"](spark, SF).collect()}
    assert len(got) == len(rows)
    for r in rows:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        told = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                hashlib.sha256(back.encode()).hexdigest())
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256, got[r.doc_id].decoded_sha256) == told


def test_bpe_of_odd_rows(odd, none):
    got = bpe.round_trip(odd).collect()
    assert len(got) == 9
    for r in got:
        assert r.n_tokens == len(r.ids) // 4
    texts = {r.doc_id: r.text for r in odd.collect()}
    assert all(r.decoded == (texts[r.doc_id] or "") for r in got)
    coded = bpe.with_ids(odd, ids_col="bands")
    assert coded.columns == odd.columns
    for r in coded.withColumn("back", bpe.decoded(F.col("bands"))).collect():
        assert r.back == (texts[r.doc_id] or "")
    assert bpe.round_trip(none).count() == 0 and bpe.with_ids(none).count() == 0


def test_bpe_memory_is_bounded_and_says_the_same(monkeypatch):
    v = bpe.load()
    texts = [f"word{k} and{k}" for k in range(200)]
    wanted = bpe.encode(texts, v)
    monkeypatch.setattr(bpe, "REMEMBERED", 10)
    assert [bpe.encode([t], v)[0] for t in texts] == wanted
    assert len(v.known) < 20


def test_bpe_refuses_ids_it_does_not_know():
    with pytest.raises(ValueError):
        bpe.decode(np.array([10**6]), np.array([0, 1]), bpe.load())
    # An id that is no whole character reads as the replacement mark.
    assert bpe.decode(bpe.load().byte[[0xE6]], np.array([0, 1]), bpe.load()) == ["�"]


# Alignment

def _rows(df):
    return sorted(df.collect(), key=lambda r: tuple((x is not None, x) for x in r))


def test_alignment_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()
            if len(r.text) < 3000] + [(-k, t) for k, t in enumerate(ODD_TEXTS, 1)] + [(None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in _rows(align.alignment(docs))]
    assert got == sorted(brute.aligned(rows, align.BYTES, align.PIECES),
                         key=lambda r: tuple((x is not None, x) for x in r))


def test_alignment_takes_any_road_to_its_counts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    texts = align.aligned(docs)
    counts = align.pair_counts(texts)
    wanted = sorted(map(tuple, align.scored(texts, counts).collect()))
    for frequent in (1, 20, 10**9):
        assert sorted(map(tuple, align.scored(texts, counts, 0, frequent).collect())) == wanted


def test_pair_counts_of_a_task_are_regrouped(monkeypatch):
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays(
        [pa.array([[1, 2], [2], [3]], pa.list_(pa.int64())),
         pa.array([[1, 1], [4], [1]], pa.list_(pa.int64()))], ["pairs", "counts"])
    for most in (1, 3, 100):
        monkeypatch.setattr(align, "GROUPED", most)
        total = {}
        for part in align._counted(iter([batch] * 5)):
            for pair, n in zip(*part.to_pydict().values()):
                total[pair] = total.get(pair, 0) + n
        assert total == {1: 5, 2: 25, 3: 5}


def test_alignment_of_odd_rows(odd, none):
    got = align.alignment(odd).collect()
    assert len(got) == 9
    by = {r.doc_id: r for r in got}
    assert by[2].n_a == 0 and by[2].groups_sha256 == ""
    assert by[4].n_links > 60_000 and by[4].n_links == by[4].n_groups
    assert align.alignment(none).count() == 0


def test_alignment_query(spark):
    got = QUERIES["op11_alignment"](spark, SF)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
                           "groups_sha256"]
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


# Hard negatives

@settings(max_examples=150, deadline=None)
@given(st.integers(1, 20), st.integers(1, 60), st.sampled_from([1, 40, 300, 10**5, 2**29]),
       st.integers(0, 2**32))
def test_packed_products_are_exact(dims, n, size, seed):
    draw = np.random.default_rng(seed)
    rows = draw.integers(-size, size + 1, (n, dims))
    anchors = draw.integers(-size, size + 1, (7, dims))
    p = hard_negatives.Packing.of(dims, -size, size)
    got = p.products(anchors, p.pack(rows), rows.sum(axis=1))
    whole = [[sum(x * y for x, y in zip(a, b)) for b in rows.tolist()] for a in anchors.tolist()]
    assert got.tolist() == whole


def test_packing_uses_several_fields_and_refuses_what_it_cannot_hold():
    assert hard_negatives.Packing.of(64, -133, 154).fields == 2
    assert hard_negatives.Packing.of(8, -3, 3).fields > 4
    with pytest.raises(ValueError):
        hard_negatives.Packing.of(64, 0, 1 << 29)


def _vectors(seed, n, dims, kinds, step):
    """Few different values, so that scores tie often."""
    draw = np.random.default_rng(seed)
    rows = [(int(i), int(draw.integers(kinds)), [float(x) for x in draw.integers(-3, 9, dims) / step])
            for i in range(n)]
    return rows


def _mined(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows],
                               "vec_id long, label int, embedding array<float>, slot string, row int")
    got = hard_negatives.hard_negatives(df, F.col("vec_id") % 5 == 0, **kw).collect()
    assert len(got) == len(set(got))
    return set(map(tuple, got))


@pytest.mark.parametrize("seed, step", [(1, 8.0), (2, 256.0), (3, 1.0)])
def test_negatives_equal_brute_force(spark, monkeypatch, seed, step):
    # Small blocks and cells: many of each.
    monkeypatch.setattr(hard_negatives, "ANCHORS", 7)
    monkeypatch.setattr(hard_negatives, "CANDIDATES", 16)
    monkeypatch.setattr(hard_negatives, "SIDE", 20)
    rows = _vectors(seed, 300, 4, 3, step)
    rows += rows[:40]                                            # repeated rows
    rows += [(3, 1, rows[9][2]), (10, 2, rows[17][2])]           # an id for two rows
    rows += [(500, None, [1.0] * 4), (505, 1, None), (None, 1, [1.0] * 4), (510, 1, [1.0, None, 2.0, 1.0]),
             (515, 1, [1.0, float("nan"), 2.0, 1.0]), (520, 1, [float("inf")] * 4)]
    rows += [(525, 1, [0.5, 0.25]), (530, 2, [])]                # shorter ones
    wanted = brute.hard_negatives([(*r, r[0] is not None and r[0] % 5 == 0) for r in rows])
    assert wanted and _mined(spark, rows) == wanted


def test_negatives_of_many_copies(spark):
    rows = [(i, i % 3, [0.5, 0.25, 0.125]) for i in range(5000)]
    rows += [(i, 1, [0.5, 0.25 + i / 4e4, 0.0]) for i in range(5000, 5100)]
    # Equal scores everywhere: none lies within 95 percent of the positive's.
    low = [(9000 + i, 2, [0.25, 0.25, 0.25]) for i in range(9)]
    df = rows + low
    got = {r for r in _mined(spark, df) if r[0] in (0, 5, 5000)}
    wanted = brute.hard_negatives([(*r, r[0] in (0, 5, 5000)) for r in df])
    assert got == wanted


def test_negatives_of_odd_tables(spark):
    assert _mined(spark, [(5, None, [1.0])]) == set()
    assert _mined(spark, [(1, 1, [1.0]), (2, 2, [1.0])]) == set()       # no anchor
    assert _mined(spark, [(5, 1, [1.0])]) == set()
    assert _mined(spark, [(5, 1, []), (6, 1, []), (7, 2, [])]) == {(5, 6, 1, 7, 0, 0)}
    text = spark.createDataFrame([(5, "a", [1.0]), (6, "a", [1.0]), (7, "b", [0.75])],
                                 "vec_id long, label string, embedding array<double>")
    got = hard_negatives.hard_negatives(text, F.col("vec_id") == 5).collect()
    assert [tuple(r) for r in got] == [(5, 6, 1, 7, 65536, 49152)]
