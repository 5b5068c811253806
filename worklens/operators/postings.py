"""Text search by posted three-letter runs: which blocks of rows a text can stand in.

The rows are written as a store of blocks, rows of like texts side by side, and every run of
three letters of every searched field is posted with the rows of the block that hold it. A
search reads the postings of its own runs, intersects them within each block and field, and
opens only the blocks where a row is left; the exact test of the caller then runs over these
rows. Nothing is left out: a text that stands in a field has all its runs there. A text of one
or two letters is looked up by the runs it opens; for that, fields are padded at the end.

Defined results: null and empty fields are posted nowhere; rows that repeat are rows of their
own; an empty table gives a store and postings without rows; an empty text stands everywhere,
so all blocks are opened; columns of the input named as the store's own are refused.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import PACKED, cut

#: Rows of a block: also the most rows that one posting names.
BLOCK_ROWS = 16_384
#: Letters of a run, and folders that postings are kept in, by their first letter.
RUN = 3
SLOTS = 64
PAD = "\0"
OWN = ("block", "place")


@dataclass(frozen=True)
class Index:
    """A store of blocks and the postings of its fields, both written."""

    store: DataFrame
    postings: DataFrame
    fields: tuple[str, ...]


def _runs(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(run, number of its text) of every different run that opens at a letter of the texts; a
    run is the three code points in one number."""
    codes = np.frombuffer("".join(x + PAD * (RUN - 1) for x in texts).encode("utf-32-le"),
                          "<u4").astype(np.int64)
    sizes = np.array([len(x) for x in texts], np.int64)
    text = np.repeat(np.arange(len(texts)), sizes)
    at = np.arange(len(text)) + text * (RUN - 1)
    run, number = np.unique((codes[at] << 42) | (codes[at + 1] << 21) | codes[at + 2],
                            return_inverse=True)
    pairs = np.unique(number * len(texts) + text)
    return run[pairs // len(texts)], pairs % len(texts)


def _posted(values: pa.Array, places: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Runs of one field of a block's rows, where the places of each begin, and these places in
    order. Each different text is looked at once."""
    held = values.dictionary_encode()
    texts = held.dictionary.to_pylist()
    known = np.array([bool(x) for x in texts] + [False])
    at = pc.fill_null(held.indices, len(texts)).to_numpy(zero_copy_only=False).astype(np.int64)
    rows = np.flatnonzero(known[at])
    if not len(rows):
        return [], np.zeros(1, np.int64), np.zeros(0, np.int32)
    run, text = _runs([x or "" for x in texts])
    # The rows of each text side by side, then those of each run's texts.
    rows = rows[np.argsort(at[rows], kind="stable")]
    count = np.bincount(at[rows], minlength=len(texts))
    first = np.cumsum(count) - count
    long = count[text]
    ends = np.cumsum(long)
    met = np.arange(ends[-1]) - np.repeat(ends - long, long) + np.repeat(first[text], long)
    runs, number = np.unique(run, return_inverse=True)
    here = places[rows[met]].astype(np.int64)
    both = np.sort((np.repeat(number, long) << 32) | here)
    begins = np.searchsorted(both >> 32, np.arange(len(runs) + 1))
    letters = np.stack([runs >> 42, (runs >> 21) & 0x1FFFFF, runs & 0x1FFFFF], axis=1)
    names = letters.astype("<u4").tobytes().decode("utf-32-le")
    return ([names[k:k + RUN] for k in range(0, len(names), RUN)], begins,
            (both & 0xFFFFFFFF).astype(np.int32))


def _post(store: DataFrame, fields: list[str]) -> DataFrame:
    """(field, run, block, places) of a store, worked out where a block's rows lie: no run of a
    row is ever a row. A block whose file is read by several tasks has a list from each."""
    low = store.select("block", "place", *[F.lower(F.col(f"`{f}`")).alias(f"t{k}")
                                           for k, f in enumerate(fields)])
    schema = pa.schema([("field", pa.string()), ("run", pa.string()), ("block", pa.int32()),
                        ("places", pa.list_(pa.int32()))])

    def post(batches):
        def posted(block: int, parts: list):
            table = pa.Table.from_batches(parts).combine_chunks()
            places = table["place"].to_numpy()
            for k, field in enumerate(fields):
                runs, begins, at = _posted(table[f"t{k}"].combine_chunks(), places)
                if runs:
                    yield pa.RecordBatch.from_arrays([
                        pa.array([field] * len(runs)), pa.array(runs),
                        pa.array(np.full(len(runs), block, np.int32)),
                        pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array(at))],
                        schema=schema)

        now, parts = None, []
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
            for start, end in zip(edges, edges[1:]):
                if start == end:
                    continue
                if parts and blocks[start] != now:
                    yield from posted(now, parts)
                    parts = []
                now = int(blocks[start])
                parts.append(batch.slice(start, end - start))
        if parts:
            yield from posted(now, parts)

    return low.mapInArrow(post, "field string, run string, block int, places array<int>")


def slot(run: Column) -> Column:
    return F.pmod(F.ascii(run), F.lit(SLOTS))


def write_index(df: DataFrame, path: str, fields: list[str], near: list[str],
                block_rows: int = BLOCK_ROWS) -> Index:
    """Write ``df`` under ``path`` as blocks of about ``block_rows`` rows in the order of the
    columns ``near``, and the postings of ``fields``.

    ``near`` should end in a key: rows that agree in all of it can only go to one block.
    """
    taken = [c for c in df.columns if c.lower() in OWN]
    if taken:
        raise ValueError(f"columns {', '.join(taken)} are named like the store's own")
    blocks = max(1, -(-df.count() // block_rows))
    placed = df.repartitionByRange(blocks, *near).sortWithinPartitions(*near).select(
        "*", F.spark_partition_id().alias("block"),
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).cast("int").alias("place"))
    placed.write.option("compression", PACKED).partitionBy("block").parquet(f"{path}/store")
    spark = df.sparkSession
    store = _store(spark, path, df)
    _post(store, fields).withColumn("slot", slot(F.col("run"))).sortWithinPartitions(
        "slot", "run", "field", "block").write.option("compression", PACKED).partitionBy(
        "slot").parquet(f"{path}/postings")
    return read_index(spark, path, df, fields)


def _store(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in like.schema.fields)
    return spark.read.schema(f"{schema}, place int, block int").parquet(f"{path}/store")


def read_index(spark: SparkSession, path: str, like: DataFrame, fields: list[str]) -> Index:
    """A written index; ``like`` names the columns of the rows and their types."""
    postings = spark.read.schema(
        "field string, run string, block int, places array<int>, slot int").parquet(
        f"{path}/postings")
    return Index(_store(spark, path, like), postings, tuple(fields))


def hits(index: Index, fields: list[str], text: str) -> DataFrame:
    """(block, hits): blocks where rows hold every run of the text in one field, and how many."""
    unknown = set(fields) - set(index.fields)
    if unknown:
        raise ValueError(f"not posted: {', '.join(sorted(unknown))}")
    low = text.lower()
    asked = index.postings.filter(F.col("field").isin(list(fields)))
    if len(low) < RUN:
        rows = asked.filter((F.col("slot") == ord(low[0]) % SLOTS)
                            & F.col("run").startswith(low))
        held = rows.groupBy("block", "field").agg(
            F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"))
    else:
        own = sorted({low[i:i + RUN] for i in range(len(low) - RUN + 1)})
        rows = asked.filter(F.col("slot").isin(sorted({ord(g[0]) % SLOTS for g in own}))
                            & F.col("run").isin(own))
        whole = rows.groupBy("block", "field", "run").agg(
            F.flatten(F.collect_list("places")).alias("places"))
        each = whole.groupBy("block", "field").agg(F.collect_list("places").alias("lists"))
        held = each.filter(F.size("lists") == len(own)).select("block", "field", F.aggregate(
            "lists", F.element_at("lists", 1), F.array_intersect).alias("places"))
    return held.groupBy("block").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("hits"))


def candidates(index: Index, fields: list[str], text: str) -> DataFrame:
    """Rows of the blocks where the text can stand in one of the fields, for the exact test.

    The blocks found are written, one row each, so that the planner knows their size: below its
    limit they are broadcast and only their folders of the store are listed and read, beyond it
    the same join is a shuffle.
    """
    if not text:
        return index.store.drop(*OWN)
    found = cut(hits(index, fields, text), "blocks").filter(F.col("hits") > 0)
    return index.store.join(found, "block", "left_semi").drop(*OWN)
