"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Items are partitioned by size: partition p has the items of 2^p to 2^(p+1) - 1 shingles, and its own
sketch size and least document size.  An item's MinHash sketch holds the smallest hash values of its
set, and a document is searched for them: the share of a sketch that a document has estimates the
item's containment, however long the document is (a signature of the document itself couldn't show
an item that is a thousandth of it).  For containment t a document may miss ``floor((1 - t) * n)``
of an item's n shingles, so of the partition's ``floor((1 - t) * n_max) + SLACK`` smallest values it
has a known number at least: no pair is lost.  Candidates are verified by counting the item's
distinct shingles in the document's, so none is wrong.

Sketches are joined as a table and never gathered; the documents' shingles are thinned out before by
a bitmap of the sketch values, whose size is bounded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspar.llm import kernel
from fieldspar.llm.minhash import without_rows
from fieldspar.llm.storage import drop, materialize, small_batches, spread_join

#: Sketch values beyond those that a contained item may miss.
SLACK = 6
#: Bits of the bitmap for each sketch value, and in all: at most 8 MB are sent to a task.
BITS_EACH, MOST_BITS = 32, 1 << 26
#: Rows up to this number (16 bytes each) are broadcast to pick documents; more are joined by shuffle.
BROADCAST_ROWS = 2_000_000


def _least(n: int, percent: int) -> int:
    """Shared shingles that the containment asks for."""
    return -(-n * percent // 100)


def sketch_size(partition: int, percent: int) -> int:
    """Values in the sketches of a partition."""
    most = (2 << partition) - 1
    return most - _least(most, percent) + SLACK


def _sketches(size: int, percent: int) -> Callable:
    """(item, text) to (item, n, needed, sketch, hashes); items without words are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernel.small(batches, 1):
            sets = list(kernel.distinct_shingles(batch.column(1), size))
            rows = np.array([i for i, s in enumerate(sets) if len(s)], np.int64)
            sets = [sets[i] for i in rows]
            kept = [min(len(s), sketch_size(len(s).bit_length() - 1, percent)) for s in sets]
            needed = [k - (len(s) - _least(len(s), percent)) for k, s in zip(kept, sets, strict=True)]
            lists = lambda own: pa.array([s.view(np.int64) for s in own], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), pa.array([len(s) for s in sets], pa.int64()), pa.array(needed, pa.int64()), lists([s[:k] for s, k in zip(sets, kept, strict=True)]), lists(sets)],
                names=["item", "item_shingles", "needed", "sketch", "hashes"],
            )

    return run


def _bitmap(posts: DataFrame) -> np.ndarray:
    """A bitmap of the sketches' values by their low bits; its words are made on the executors."""
    n = posts.count()
    bits = 1 << max(10, min(MOST_BITS, BITS_EACH * max(n, 1)).bit_length() - 1)
    low = F.col("hash").bitwiseAND(F.lit(bits - 1))
    words = posts.groupBy(F.shiftright(low, 3).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1, cast((hash & {bits - 1}) & 7 as int))")).alias("bits")).toArrow()
    own = np.zeros(bits // 8, np.uint8)
    own[words.column("at").to_numpy()] = words.column("bits").to_numpy()
    return np.unpackbits(own, bitorder="little").view(bool) if bits <= 1 << 20 else own


def _marked(bitmap: np.ndarray, found: np.ndarray) -> np.ndarray:
    if bitmap.dtype == bool:
        return bitmap[found & np.uint64(len(bitmap) - 1)]
    low = found & np.uint64(8 * len(bitmap) - 1)
    return (bitmap[low >> np.uint64(3)] >> (low & np.uint64(7)).astype(np.uint8)) & np.uint8(1) != 0


def _hits(bitmap: np.ndarray, size: int) -> Callable:
    """(doc, h, text) to (doc, h, n, hash): the distinct shingles that the bitmap lets through, n of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernel.small(batches, 2):
            found, n = kernel.shingles(*kernel.words(batch.column(2)), size)
            at = np.flatnonzero(_marked(bitmap, found))
            row = np.searchsorted(np.cumsum(n), at, side="right")
            pairs = np.unique(np.stack([row.astype(np.uint64), found[at]]), axis=1)
            row = pairs[0].astype(np.int64)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(n[row]), pa.array(pairs[1].view(np.int64))], names=["doc", "h", "n", "hash"])

    return run


def _verify(size: int) -> Callable:
    """(text, hashes) beside other columns to these columns and the number of shared shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernel.small(batches, 0):
            sets = batch.column(1).to_pylist()
            own = kernel.distinct_shingles(batch.column(0), size)
            shared = [int(np.isin(np.array(s, np.int64).view(np.uint64), x).sum()) for s, x in zip(sets, own, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(shared, pa.int64())], names=[*batch.schema.names[2:], "shared"])

    return run


def _found(docs: DataFrame, items: DataFrame, percent: int, size: int) -> DataFrame:
    """(doc, h, item, shared, item_shingles) of (doc, h, text) and (item, text) rows."""
    small_batches(docs.sparkSession)
    sets = items.mapInArrow(_sketches(size, percent), "item long, item_shingles long, needed long, sketch array<long>, hashes array<long>")
    sets = materialize(sets.withColumn("key", F.monotonically_increasing_id()), "items")
    posts = materialize(sets.select("key", "item_shingles", "needed", F.explode("sketch").alias("hash")), "sketches")
    hits = materialize(docs.mapInArrow(_hits(_bitmap(posts), size), "doc long, h long, n long, hash long"), "hits")
    # All that share a sketch value are one row of the joined side, so that neither side repeats a key.
    side = posts.groupBy("hash").agg(F.collect_list(F.struct("key", "item_shingles", "needed")).alias("items"))
    pairs = spread_join(hits, side, ["hash"]).select("doc", "h", "n", F.inline("items"))
    pairs = pairs.where(f"100 * n >= {percent} * item_shingles").groupBy("doc", "h", "key").agg(F.count("*").alias("c"), F.first("needed").alias("needed"))
    pairs = materialize(pairs.where("c >= needed").select("doc", "h", "key"), "candidates")
    drop(hits)
    drop(posts)
    named = materialize(pairs.select("doc", "h").distinct(), "candidate-rows")
    few = F.broadcast(named) if named.count() <= BROADCAST_ROWS else named
    texts = docs.join(few, docs["doc"].eqNullSafe(named["doc"]) & (docs["h"] == named["h"]), "left_semi")
    # Grouped by text, not by item: an item in very many documents is dealt out.
    wanted = spread_join(pairs, sets.select("key", "item", "item_shingles", "hashes"), ["key"])
    rows = texts.join(wanted, texts["doc"].eqNullSafe(wanted["doc"]) & (texts["h"] == wanted["h"])).select("text", "hashes", texts["doc"], texts["h"], "item", "item_shingles")
    return rows.mapInArrow(_verify(size), "doc long, h long, item long, item_shingles long, shared long").where(f"100 * shared >= {percent} * item_shingles")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"), F.col(text_col).alias("text"))


def contaminated(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    *, percent: int = 80, size: int = kernel.SHINGLE_WORDS,
) -> DataFrame:
    """(id, item, shared, item_shingles, containment): items of which a text has ``percent`` of the distinct shingles.

    The documents are scanned twice, the second time for candidates only.

    Defined cases: ids are integers; null and empty texts, on either side, match nothing; an item of
    fewer than ``size`` words is its whole sequence, found only in texts that are that sequence;
    repeated rows on either side give repeated results; null ids are carried, on either side; an
    empty table on either side gives an empty result; other columns are ignored, whatever their names.
    """
    items = items.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("text"))
    rows = _found(_rows(docs, id_col, text_col), items, percent, size)
    return rows.select(F.col("doc").alias(id_col), F.col("item").alias(item_col), "shared", "item_shingles", (F.col("shared") / F.col("item_shingles")).alias("containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_text_col: str = "text", *, percent: int = 80, size: int = kernel.SHINGLE_WORDS) -> DataFrame:
    """The rows of ``docs`` whose text holds no item, decided by row: an id that repeats, or is null, decides nothing."""
    items = items.select(F.lit(None).cast("long").alias("item"), F.col(item_text_col).alias("text"))
    gone = _found(_rows(docs, id_col, text_col), items, percent, size).select(F.col("doc").alias("id"), "h").distinct()
    return without_rows(docs, materialize(gone, "contaminated"), id_col, text_col)
