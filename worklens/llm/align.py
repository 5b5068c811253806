"""Alignment of two tokenizers' tokens over the bytes of the same texts, in Arrow.

Tokenizer A (byte-level BPE) encodes a space and the text, tokenizer B (pieces) the text, to
which it adds that space itself. The ids of a batch of texts are one list column each: lists are
flattened, parent indices tell the text of a token, and segmented cumulative sums of the tokens'
byte lengths give the offset at which each ends. A hash join of both sides on (text, end) gives
the links: the A and B tokens that end together. The offsets in it cut both sides into groups.

Counts of linked id pairs are grouped by Arrow, first within a text, then within a task, and
merged by Spark. The pair counts return to the texts through a join: broadcast while they are
within a checked number of rows, else a shuffle join of the texts' distinct pairs, where pairs
of FREQUENT links and more are dealt over SALTS keys.

Defined results: a null or empty text, and one whose bytes B changes (it normalises), has no
tokens, no links and zeros; special strings within a text are plain text; texts are read whole;
every row has a result of its own, repeated rows and null ids too; an empty table gives an empty
result; further columns are passed over.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import bpe
from .tables import bounded, chunks

BYTES = bpe.VOCABULARY
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: An id pair is one number: A's id times this, plus B's.
PAIR = 1 << 32
#: A link's key is one number: the text's place in its batch times this, plus the byte offset.
OFFSET = 1 << 40
#: Pairs of a task that are grouped before they are handed on.
GROUPED = 2_000_000
#: Rows of pair counts that are broadcast at most (24 bytes each).
BROADCAST = 2_000_000
#: Links that make a pair frequent, and the keys that it is dealt over.
FREQUENT, SALTS = 100_000, 64


@lru_cache(maxsize=2)
def _pieces(path: str):
    """The piece model, and the bytes that each id stands for."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    raw = [bytes([int(model.id_to_piece(i)[1:-1], 16)]) if model.is_byte(i)
           else b"" if model.is_control(i) else model.id_to_piece(i).replace(MARK, " ").encode()
           for i in range(model.get_piece_size())]
    return model, pa.array(raw, pa.large_binary())


@lru_cache(maxsize=2)
def _written(most: int) -> pa.Array:
    """Every id in decimal, before each of the signs that may follow it: , | ; or none."""
    return pa.array([f"{i}{sign}" for i in range(most) for sign in (",", "|", ";", "")],
                    pa.large_binary())


def _lists(ids: np.ndarray, at: np.ndarray) -> pa.LargeListArray:
    return pa.LargeListArray.from_arrays(pa.array(at), pa.array(ids))


def _bytes(raw: pa.Array, lists: pa.LargeListArray) -> list[memoryview]:
    """The joined bytes of each list of ids."""
    taken = raw.take(lists.flatten())
    _, ends, data = taken.buffers()
    at = np.frombuffer(ends, np.int64)[:len(taken) + 1][np.array(lists.offsets)]
    whole = memoryview(data).cast("B") if data is not None else memoryview(b"")
    return [whole[a:b] for a, b in zip(at[:-1], at[1:])]


def _ends(lists: pa.LargeListArray, raw: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Ids of all tokens, the text of each, and the key of the offset where it ends: cumulative
    sums of lengths, less the sum before the text."""
    ids = lists.flatten()
    parent = pc.list_parent_indices(lists).cast(pa.int64())
    lengths = pc.binary_length(raw.take(ids)).cast(pa.int64())
    total = pc.cumulative_sum(lengths)
    zero = pa.array([0], pa.int64())
    before = pa.concat_arrays([zero, total]).take(lists.offsets.slice(0, len(lists)))
    end = pc.subtract(total, before.take(parent))
    return ids, parent, pc.add(pc.multiply(parent, OFFSET), end)


def _links(a_lists: pa.LargeListArray, b_lists: pa.LargeListArray, a_raw: pa.Array,
           b_raw: pa.Array) -> tuple[pa.Table, tuple, tuple]:
    """Every A and B token that end together: text, pair, and their places (one row a link);
    ids, text and link mark of all tokens of A, of B."""
    sides, tables = [], []
    for lists, raw, name in ((a_lists, a_raw, "a"), (b_lists, b_raw, "b")):
        ids, parent, key = _ends(lists, raw)
        sides.append((ids, parent))
        tables.append(pa.table({"key": key, name: ids.cast(pa.int64()),
                                f"{name}_at": pa.array(np.arange(len(ids)))}))
    links = tables[0].join(tables[1], "key", join_type="inner", use_threads=False)
    marked = []
    for (ids, parent), name in zip(sides, ("a", "b")):
        mark = np.zeros(len(ids), bool)
        mark[np.array(links[f"{name}_at"])] = True
        marked.append((np.array(ids), np.array(parent), mark))
    pair = pc.add(pc.multiply(links["a"], PAIR), links["b"])
    text = pc.divide(links["key"], OFFSET)
    return pa.table({"text": text, "pair": pair}), marked[0], marked[1]


def _groups(a: tuple, b: tuple, n: int, most: int) -> tuple[np.ndarray, list[str]]:
    """How many groups each of ``n`` texts has, and the digest of what they hold, written
    `a1,a2|b1;a3|b2,b3`; '' for a text without tokens. Ids are below ``most``."""
    # A linked token ends its group, and so does a text; so both sides number groups alike.
    group = [np.cumsum(mark) - mark for _, _, mark in (a, b)]
    total = int(a[2].sum())
    held = [np.concatenate([[0], np.cumsum(np.bincount(g, minlength=total))]) for g in group]
    # Where a token stands when each group's tokens of A come before those of B.
    place = [np.arange(len(group[0])) + held[1][group[0]],
             np.arange(len(group[1])) + held[0][group[1] + 1]]
    coded = np.zeros(len(place[0]) + len(place[1]), np.int64)
    for side, (ids, parent, mark) in enumerate((a, b)):
        last = np.ones(len(ids), bool)
        last[:-1] = parent[1:] != parent[:-1]
        ends = np.where(last, 3, 2) if side else 1
        coded[place[side]] = 4 * ids + np.where(mark, ends, 0)
    taken = _written(most).take(pa.array(coded))
    _, ends, data = taken.buffers()
    at = sum(np.searchsorted(parent, np.arange(n + 1)) for _, parent, _ in (a, b))
    ends = np.frombuffer(ends, np.int64)[:len(taken) + 1][at]
    whole = memoryview(data).cast("B") if data is not None else memoryview(b"")
    digests = [hashlib.sha256(whole[x:y]).hexdigest() if y > x else "" for x, y in zip(ends, ends[1:])]
    return np.bincount(a[1][a[2]], minlength=n), digests


def _aligned(byte_path: str, piece_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = bpe.load(byte_path)
        model, b_raw = _pieces(piece_path)
        none = np.zeros(0, np.int64)
        for part, _, _ in chunks(batches, "text"):
            texts = [t or "" for t in part.column("text").to_pylist()]
            n = len(texts)
            spaced = [f" {t}" if t else "" for t in texts]
            packed = bpe.encode(spaced, v, special=False)
            pieces = model.encode(texts, num_threads=1)
            told = []
            for lists in ([np.frombuffer(p, "<u4").astype(np.int64) for p in packed],
                          [np.array(p, np.int64) for p in pieces]):
                told.append(lists)
            whole = [t.encode() for t in spaced]
            for lists, raw in zip(told, (v.raw, b_raw)):
                joined = _bytes(raw, _lists(*_flat(lists)))
                for k, (own, found) in enumerate(zip(whole, joined)):
                    if own != found:
                        told[0][k] = told[1][k] = none
                        whole[k] = b""
            # A text that B changes loses its tokens of A too, whichever was looked at first.
            a_lists, b_lists = (_lists(*_flat([x if w else none for x, w in zip(lists, whole)]))
                                for lists in told)
            links, a, b = _links(a_lists, b_lists, v.raw, b_raw)
            n_groups, digests = _groups(a, b, n, max(len(v.raw), len(b_raw)))
            counts = links.group_by(["text", "pair"], use_threads=False).aggregate(
                [("pair", "count")]).sort_by("text")
            text = np.array(counts["text"], np.int64)
            at = pa.array(np.searchsorted(text, np.arange(n + 1)).astype(np.int32))
            n_links = np.bincount(np.array(links["text"], np.int64), minlength=n)
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), part.column("id"),
                 *(pa.array(np.diff(np.array(x.offsets))) for x in (a_lists, b_lists)),
                 pa.array(n_groups.astype(np.int64)), pa.array(n_links.astype(np.int64)),
                 pa.array(digests, pa.string()),
                 *(pa.ListArray.from_arrays(at, counts[c].combine_chunks().cast(pa.int64()))
                   for c in ("pair", "pair_count"))],
                ["row", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "counts"])
    return run


def _flat(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    at = np.concatenate([[0], np.cumsum([len(x) for x in lists], dtype=np.int64)])
    return np.concatenate([*lists, np.zeros(0, np.int64)]), at


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the pairs of a task; grouped anew whenever GROUPED rows have gathered."""
    def grouped(tables: list[pa.Table]) -> pa.Table:
        found = pa.concat_tables(tables).group_by("pair", use_threads=False).aggregate([("n", "sum")])
        return pa.table({"pair": found["pair"], "n": found["n_sum"]})
    held, rows = [], 0
    for batch in batches:
        held.append(pa.table({"pair": batch.column("pairs").flatten(),
                              "n": batch.column("counts").flatten()}))
        rows += held[-1].num_rows
        if rows > GROUPED:
            held = [grouped(held)]
            rows = held[0].num_rows
            if rows > GROUPED // 2:
                yield from held[0].to_batches()
                held, rows = [], 0
    if held:
        yield from grouped(held).to_batches()


def aligned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            byte_path: str = BYTES, piece_path: str = PIECES) -> DataFrame:
    """One row of each text: its tokens of either kind, groups and links, the digest of its
    groups, and its linked id pairs with their numbers; written to the shared folder."""
    narrow = bounded(docs).select(F.monotonically_increasing_id().alias("row"),
                                  F.col(id_col).cast("long").alias("id"),
                                  F.col(text_col).alias("text"))
    return cut(narrow.mapInArrow(
        _aligned(byte_path, piece_path), "row long, id long, n_a long, n_b long, n_groups long, "
        "n_links long, groups_sha256 string, pairs array<long>, counts array<long>"), "aligned")


def pair_counts(texts: DataFrame) -> DataFrame:
    """(pair, n, best): links of each id pair in all texts, and whether no pair of its B id
    has more."""
    parts = bounded(texts).select("pairs", "counts").mapInArrow(_counted, "pair long, n long")
    counts = cut(parts.groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    piece = (F.col("pair") % F.lit(PAIR)).alias("piece")
    most = counts.groupBy(piece).agg(F.max("n").alias("most"))
    return cut(counts.withColumn("piece", piece).join(most, "piece").select(
        "pair", "n", (F.col("n") == F.col("most")).alias("best")), "pair-best")


def scored(texts: DataFrame, counts: DataFrame, broadcast: int = BROADCAST,
           frequent: int = FREQUENT) -> DataFrame:
    """(row, n_best, count_sum) of each text with links."""
    each = texts.filter("n_links > 0").select(
        "row", F.explode(F.arrays_zip("pairs", "counts")).alias("x")).select(
        "row", F.col("x.pairs").alias("pair"), F.col("x.counts").alias("times"))
    if counts.count() <= broadcast:
        met = each.join(F.broadcast(counts), "pair")
    else:
        # A text's own pair may be frequent or not: its row carries the salt in either case.
        often = F.col("n") >= frequent
        salted = counts.filter(often).withColumn("salt", F.explode(
            F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = each.withColumn("salt", F.pmod(F.hash("row"), F.lit(SALTS))).join(
            salted, ["pair", "salt"]).drop("salt").unionByName(
            each.join(counts.filter(~often), "pair"))
    return met.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("times") * F.col("n")).alias("count_sum"))


def alignment(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              byte_path: str = BYTES, piece_path: str = PIECES) -> DataFrame:
    """Per row: tokens of A and B, groups, links, links whose pair is its B id's most frequent
    one in all texts, the sum of the links' pair counts, and the digest of the groups."""
    texts = aligned(docs, id_col, text_col, byte_path, piece_path)
    told = scored(texts, pair_counts(texts))
    return texts.drop("pairs", "counts").join(told, "row", "left").select(
        F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links",
        F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"), "groups_sha256")
