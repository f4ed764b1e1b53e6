"""Near-duplicate embeddings by sorted projection passes.

In each pass every vector gets a key of concatenated random hyperplane signs, taken from the mean of
its label's vectors; vectors are ordered by label and key - by range partitioning, so no label needs
to fit one task - and compared with the WINDOW next ones.  Similar vectors agree in most signs and
meet in some pass; verified links of all passes are united.

A lone pair meets in a pass if it agrees in about log2(n / WINDOW) signs, n being the label's size,
so the number of passes grows with the size, and with how close the label's vectors are to each
other: it is chosen such that a pair at the bound is missed with a chance of MISS.

Equal vectors of a label are one class with a count beforehand.  Link numbers are then counted by
comparing each component with itself, in blocks of bounded size that only emit sums; a vector of a
component of m is sent to about sqrt(m) / 16 blocks.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator
from math import acos, ceil, log, log2, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspar.llm.components import connected_components
from fieldspar.llm.storage import materialize, small_batches, spread_join

SIGNS, WINDOW = 40, 40
#: Chance to miss a lone pair at the bound, and the least and the largest number of passes for labels above a window's size.
MISS, FEWEST, MOST = 0.01, 8, 64
#: Vectors of a component are dealt to sqrt(m) / DEAL chunks; bytes of a chunk, and numbers of a product at once.
DEAL, CHUNK_BYTES, PRODUCT = 16, 16 << 20, 1 << 22
#: Means of labels up to that size are broadcast to the vectors; more are joined by shuffle.
BROADCAST_BYTES = 32 << 20


def passes_needed(n: int, spread: float, cosine: float) -> int:
    """Passes for a label of n vectors, whose mean square distance from their mean is ``spread``."""
    if n <= WINDOW + 1:
        return 1
    agree = 1 - acos(max(-1.0, 1 - (1 - cosine) / max(spread, 1e-9))) / pi
    meet = agree ** log2(n / WINDOW) if agree > 0 else 0.0
    return FEWEST if meet >= 1 - 1e-12 else MOST if meet <= 0 else min(MOST, max(FEWEST, ceil(log(MISS) / log(1 - meet))))


@functools.lru_cache(maxsize=256)
def _planes(dim: int, at: int) -> np.ndarray:
    return np.random.default_rng([11, dim, at]).standard_normal((dim, SIGNS))


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, label, vector) to (id, label, dim, digest, unit), in any order: dim is null for vectors that can't link."""
    names = ["id", "label", "dim", "digest", "unit"]
    for batch in batches:
        ids, labels, column = batch.columns
        lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null parts are not finite
        starts = np.cumsum(lengths) - lengths
        usable = np.zeros(len(lengths), bool)
        labelled = labels.is_valid().to_numpy(zero_copy_only=False)
        for dim in np.unique(lengths[lengths > 0]).tolist():
            rows = np.flatnonzero((lengths == dim) & labelled)
            x = values[starts[rows][:, None] + np.arange(dim)]
            largest = np.abs(x).max(axis=1)
            good = np.isfinite(largest) & (largest > 0)
            usable[rows[good]] = True
            rows, x = rows[good], x[good]
            unit = x / largest[good][:, None]  # first by the largest part, against overflow
            unit /= np.sqrt(np.einsum("ij,ij->i", unit, unit))[:, None]
            digests = [hashlib.blake2b(r.tobytes(), digest_size=16).digest() for r in x + 0.0]
            ends = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(8 * dim)
            units = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(unit))])
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays([ids.take(at), labels.take(at), pa.array(np.full(len(rows), dim, np.int32)), pa.array(digests, pa.binary()), units], names=names)
        at = pa.array(np.flatnonzero(~usable))
        yield pa.RecordBatch.from_arrays([ids.take(at), labels.take(at), pa.nulls(len(at), pa.int32()), pa.nulls(len(at), pa.binary()), pa.nulls(len(at), pa.binary())], names=names)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of equal binary vectors as a matrix, without a copy of each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # no chunk at all
        return np.zeros((0, dim))
    first = np.frombuffer(column.buffers()[1], np.int32)[column.offset]
    return np.frombuffer(column.buffers()[2], np.float64, len(column) * dim, int(first)).reshape(-1, dim)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, dim, unit) to a batch's (label, dim, n, sum)."""
    for batch in batches:
        labels, dims = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for dim in np.unique(dims).tolist():
            rows = np.flatnonzero(dims == dim)
            own, at, n = np.unique(labels[rows], return_inverse=True, return_counts=True)
            x = _matrix(batch.column(2).take(pa.array(rows)), dim)
            order = np.argsort(at, kind="stable")
            total = np.add.reduceat(x[order], np.cumsum(n) - n, axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(len(own), dim, np.int32)), pa.array(n), pa.array([t.tobytes() for t in total], pa.binary())], names=["label", "dim", "n", "sum"])


def _means(cosine: float) -> Callable:
    """Sorted (label, dim, n, sum) to (label, dim, mean, passes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, total = None, 0, np.zeros(0)

        def out() -> pa.RecordBatch:
            mean = total / n
            need = passes_needed(n, 1 - float(mean @ mean), cosine)
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int64()), pa.array([now[1]], pa.int32()), pa.array([mean.tobytes()], pa.binary()), pa.array([need], pa.int32())], names=["label", "dim", "mean", "passes"])

        for batch in batches:
            for label, dim, own, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (label, dim) != now:
                    if now is not None:
                        yield out()
                    now, n, total = (label, dim), 0, np.zeros(dim)
                n, total = n + own, total + np.frombuffer(part)
        if now is not None:
            yield out()

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, label, dim, unit, mean, passes) to one row for each of its label's passes, with its key."""
    weight = 1 << np.arange(SIGNS - 1, -1, -1, dtype=np.int64)
    for batch in batches:
        dims, passes = batch.column(2).to_numpy(), batch.column(5).to_numpy()
        for dim in np.unique(dims).tolist():
            for p in range(int(passes[dims == dim].max())):
                rows = batch.filter(pa.array((dims == dim) & (passes > p)))
                signs = (_matrix(rows.column(3), dim) - _matrix(rows.column(4), dim)) @ _planes(dim, p) > 0
                yield pa.RecordBatch.from_arrays([pa.array(np.full(rows.num_rows, p, np.int32)), rows.column(1), rows.column(2), pa.array(signs @ weight), rows.column(0), rows.column(3)], names=["pass", "label", "dim", "key", "id", "unit"])


def _windows(cosine: float) -> Callable:
    """Sorted (pass, label, dim, key, id, unit) to links between rows at most WINDOW places apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None  # the last WINDOW rows of the run that a batch ends in
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = (pa.concat_tables([kept, rows]) if kept is not None else rows).combine_chunks()
            fresh = 0 if kept is None else kept.num_rows
            runs = np.stack([rows.column(c).to_numpy() for c in (0, 1, 2)])
            cuts = [0, *(np.flatnonzero((np.diff(runs) != 0).any(axis=0)) + 1).tolist(), rows.num_rows]
            pairs = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                x = _matrix(rows.column(5).slice(a, b - a), int(runs[2, a]))
                for d in range(1, min(WINDOW, b - a - 1) + 1):
                    near = np.flatnonzero(np.einsum("ij,ij->i", x[:-d], x[d:]) >= cosine)
                    near = near[near + a + d >= fresh]  # others were compared with the batch before
                    pairs.append(np.stack([near + a, near + a + d]))
            last = cuts[-2]
            kept = rows.slice(max(last, rows.num_rows - WINDOW))
            if pairs:
                at, ids = np.concatenate(pairs, axis=1), rows.column(4).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(ids[at[0]]), pa.array(ids[at[1]])], names=["a", "b"])

    return run


def _counts(cosine: float) -> Callable:
    """Sorted (block, side, id, copies, dim, unit) to (id, links to vectors of other classes)."""

    def count(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        rows = rows.combine_chunks()
        ids, copies = rows.column("id").to_numpy(), rows.column("copies").to_numpy()
        blocks, side = rows.column("block").to_numpy(), rows.column("side").to_numpy()
        dims, out = rows.column("dim").to_numpy(), np.zeros(len(ids), np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            x = _matrix(rows.column("unit").slice(a, b - a), int(dims[a]))
            m = a + int(np.searchsorted(side[a:b], 1))
            itself = m in (a, b)  # a chunk with itself
            left, right = (x, x) if itself else (x[: m - a], x[m - a :])
            strip = max(1, PRODUCT // len(right))
            for i in range(0, len(left), strip):
                linked = left[i : i + strip] @ right.T >= cosine
                if itself:
                    linked[np.arange(len(linked)), np.arange(i, i + len(linked))] = False
                    out[a + i : a + i + len(linked)] = linked @ copies[a:b]
                else:
                    out[a + i : a + i + len(linked)] = linked @ copies[m:b]
                    out[m:b] += copies[a + i : a + i + len(linked)] @ linked
        return ids, out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([kept, rows]) if kept is not None else rows
            blocks = rows.column("block").to_numpy()
            last = int(np.searchsorted(blocks, blocks[-1]))
            kept = rows.slice(last)
            if last:
                yield pa.RecordBatch.from_arrays(list(map(pa.array, count(rows.slice(0, last)))), names=["id", "n"])
        if kept is not None and kept.num_rows:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, count(kept))), names=["id", "n"])

    return run


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", *, cosine: float = 0.98) -> DataFrame:
    """(id, n_links, component_id, kept) for every row.

    Rows link if their labels are equal and their cosine, in double precision, is at least
    ``cosine``.  component_id is the smallest id reachable by links, kept whether it is the row's own.

    Defined cases: ids are integers, labels integers or anything that a string tells apart; vectors
    that are null, empty, zero or hold a null or non-finite part, and rows with a null label or id,
    link with nothing and are kept (kept is null for a null id); vectors of different lengths don't
    link; equal vectors link as any others; where an id repeats, each row links by its own vector;
    an empty table gives an empty result; other columns are ignored, whatever their names.
    """
    small_batches(vectors.sparkSession)
    whole = vectors.schema[label_col].dataType.typeName() in ("byte", "short", "integer", "long")
    label = F.col(label_col).cast("long") if whole else F.when(F.col(label_col).isNotNull(), F.xxhash64(F.col(label_col).cast("string")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.when(F.col(id_col).isNotNull(), label).alias("label"), F.col(vector_col).alias("vector"))
    rows = materialize(rows.mapInArrow(_prepare, "id long, label long, dim int, digest binary, unit binary"), "vectors")
    classes = rows.where("dim is not null").groupBy("label", "digest").agg(F.min("id").alias("leader"), F.count("*").alias("copies"), F.first("dim").alias("dim"), F.first("unit").alias("unit"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "vector-classes")

    sums = classes.select("label", "dim", "unit").mapInArrow(_sums, "label long, dim int, n long, sum binary").repartition("label", "dim").sortWithinPartitions("label", "dim")
    means = materialize(sums.mapInArrow(_means(cosine), "label long, dim int, mean binary, passes int"), "label-means")
    n, dim = means.agg(F.count("*"), F.max("dim")).first()
    leaders = classes.select(F.col("node").alias("id"), "label", "dim", "unit")
    keyed = leaders.join(F.broadcast(means), ["label", "dim"]) if n * 8 * (dim or 0) <= BROADCAST_BYTES else spread_join(leaders, means, ["label", "dim"])
    keyed = keyed.select("id", "label", "dim", "unit", "mean", "passes").mapInArrow(_keys, "pass int, label long, dim int, key long, id long, unit binary")
    ordered = keyed.repartitionByRange("pass", "label", "dim", "key").sortWithinPartitions("pass", "label", "dim", "key")
    found = materialize(connected_components(ordered.mapInArrow(_windows(cosine), "a long, b long"), "a", "b"), "vector-components")

    chunks = F.ceil(F.greatest(F.sqrt(F.count("*")) / DEAL, F.count("*") * (8 * (dim or 0)) / CHUNK_BYTES)).cast("long")
    sizes = found.groupBy("component").agg(chunks.alias("chunks"))
    members = spread_join(found, sizes, ["component"]).join(classes.select("node", "copies", "dim", "unit"), "node")
    members = members.withColumn("chunk", F.pmod(F.xxhash64("node"), "chunks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    low, high = F.least("chunk", "other"), F.greatest("chunk", "other")
    members = members.select(F.xxhash64("component", low, high).alias("block"), (F.col("chunk") > F.col("other")).cast("int").alias("side"), F.col("node").alias("id"), "copies", "dim", "unit")
    members = members.repartition("block").sortWithinPartitions("block", "side")
    links = members.mapInArrow(_counts(cosine), "id long, n long").groupBy(F.col("id").alias("node")).agg(F.sum("n").alias("n"))

    named = classes.select("node", "label", "digest", "leader", "copies").join(found, "node", "left").join(links, "node", "left")
    named = materialize(named.select("label", "digest", "leader", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component")), "vector-links")
    named = spread_join(named, named.groupBy("component").agg(F.min("leader").alias("first")), ["component"]).select("label", "digest", "n_links", "first")
    named = materialize(named, "named-vectors")
    component = F.coalesce("first", "id")
    return spread_join(rows.select("id", "label", "digest"), named, ["label", "digest"], "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept")
    )
