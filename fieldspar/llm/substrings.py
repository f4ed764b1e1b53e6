"""Substring dedup by sliding sentence spans.

Texts are cut into sentences - at line ends, after closing punctuation, at clause ends, and, where
no such end is within CLEAR words, after words whose MD5 is the least of the REACH ones on either
side.  A border depends only on the words around it, so that a passage falls into the same
sentences wherever it stands.  From every sentence on, the shortest run of at least RUN sentences
with MIN_WORDS words is hashed, to 96 bits.  Runs are joined globally; sentences that a non-first
occurrence of a run covers are removed.

There is one shuffle of runs.  An occurrence that is not the first one of its batch of texts is
known to be a later one at once: it is dealt out by its place, and only a batch's first goes to the
run's task, so that a very common run is no single task's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldspar.llm import kernel
from fieldspar.llm.storage import fresh, materialize, small_batches

RUN, MIN_WORDS = 3, 25
#: Words on either side that have no mark where a border is set by hash, and words whose hashes decide.
CLEAR, REACH = 4, 2
#: Ranges up to this number (about 40 bytes each) are broadcast to the texts; more are joined by shuffle.
BROADCAST_RANGES = 500_000

_CLOSING = np.zeros(256, bool)
_CLOSING[list(b".!?;:,")] = True
#: Marks of other scripts by their last two bytes in UTF-8, and by three.
_CLOSING_2, _CLOSING_3 = (np.array([int.from_bytes(c.encode()) for c in marks]) for marks in ("؟،؛۔։", "。、！，：；？．…।॥።፣។။"))


_OTHER = np.uint64(0x2545F4914F6CDD1D)


class _Sentences:
    """The sentences of a column's texts, as ranges of words and bytes, with each row's first one."""

    def __init__(self, column: pa.Array) -> None:
        data, self.offsets = kernel.string_buffers(column)
        self.data = data
        self.hashes, counts, first, last = kernel.words(column, places=True)
        self.first_byte, self.last_byte = first, last
        n = len(first)
        row_end = np.cumsum(counts)
        ends = np.zeros(n, bool)
        if n:
            lines = np.cumsum(np.append(data == 10, False))
            ends[:-1] = self._marked(first, last)[:-1] | (lines[first[1:] - 1] > lines[last[:-1] - 1])
            ends[row_end[counts > 0] - 1] = True
            ends |= self._least(ends)
        #: Word at which each sentence starts, and the end.
        self.start = np.append(np.flatnonzero(np.append(True, ends[:-1])), n) if n else np.zeros(1, np.int64)
        #: Sentences of each row.
        self.upto = np.searchsorted(self.start[:-1], row_end)
        self.per_row = np.diff(np.append(0, self.upto))

    def _marked(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Words that end in a closing mark."""
        marked = _CLOSING[self.data[last - 1]]
        wide = np.flatnonzero(self.data[last - 1] >= 128)
        byte = lambda i: np.where(last[wide] - i >= first[wide], self.data[last[wide] - i], 0).astype(np.int64)
        two = byte(2) << 8 | byte(1)
        marked[wide] = np.isin(two, _CLOSING_2) | np.isin(byte(3) << 16 | two, _CLOSING_3)
        return marked

    def _least(self, ends: np.ndarray) -> np.ndarray:
        """Words of the least MD5 within REACH, without an end within CLEAR; of equal ones all."""
        n = len(ends)
        upto, at = np.append(0, np.cumsum(ends)), np.arange(n)
        free = (at >= CLEAR) & (upto[np.minimum(at + CLEAR + 1, n)] == upto[np.maximum(at - CLEAR, 0)])
        near = free.copy()
        for d in range(1, min(REACH, n - 1) + 1):
            near[d:] |= free[:-d]
            near[:-d] |= free[d:]
        used = np.flatnonzero(near)
        _, first, own = np.unique(self.hashes[used], return_index=True, return_inverse=True)
        digest = lambda i: int.from_bytes(hashlib.md5(self.data[self.first_byte[i] : self.last_byte[i]].tobytes().lower(), usedforsecurity=False).digest()[:4])
        value = np.full(n, 1 << 32, np.int64)
        value[used] = np.array([digest(i) for i in used[first]], np.int64)[own]
        least = value.copy()
        for d in range(1, min(REACH, n - 1) + 1):
            np.minimum(least[d:], value[:-d], out=least[d:])
            np.minimum(least[:-d], value[d:], out=least[:-d])
        return free & (value == least)

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, place, hash, check) of every run: the place is its first sentence within the row, and how many it has."""
        n = len(self.start) - 1
        row = np.repeat(np.arange(len(self.per_row)), self.per_row)
        to = np.maximum(np.arange(n) + RUN, np.searchsorted(self.start, self.start[:-1] + MIN_WORDS))
        ok = np.flatnonzero(to <= self.upto[row]) if n else np.zeros(0, np.int64)
        a, b = self.start[ok], self.start[np.minimum(to[ok], n)]
        value, check = (kernel.mix(self._sums(x, a, b) + (b - a).astype(np.uint64)) for x in (self.hashes, kernel.mix(self.hashes ^ _OTHER)))
        first = ok - (self.upto - self.per_row)[row[ok]]
        return row[ok], first * 65536 + np.minimum(to[ok] - ok, 65535), value, (check >> np.uint64(32)).astype(np.uint32)  # a run has at most MIN_WORDS sentences

    def _sums(self, x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """A hash of each range of words that doesn't depend on where it stands."""
        m = len(x)
        running = np.zeros(m + 1, np.uint64)
        np.cumsum(x * kernel.power("up", m), out=running[1:])
        return (running[b] - running[a]) * (kernel.power("down", max(m, 1))[a] if m else np.uint64(1))

    def cut(self, row: int, ranges: list[tuple[int, int]]) -> tuple[str, int, list[tuple[int, int]]]:
        """The row's text without the sentences of the ranges, how many those are, and their byte ranges in the text."""
        base, n = int(self.upto[row] - self.per_row[row]), int(self.per_row[row])
        gone = np.zeros(n, bool)
        for a, k in ranges:
            gone[a : a + k] = True
        text0, text1 = int(self.offsets[row]), int(self.offsets[row + 1])
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
        kept, at, spans = [], text0, []
        for a, b in edge.reshape(-1, 2).tolist():
            begin = int(self.first_byte[self.start[base + a]])
            end = int(self.first_byte[self.start[base + b]]) if b < n else text1
            kept.append(self.data[at:begin].tobytes())
            spans.append((begin - text0, int(self.last_byte[self.start[base + b] - 1]) - text0))
            at = end
        kept.append(self.data[at:text1].tobytes())
        return b"".join(kept).decode(), int(gone.sum()), spans


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, text) to (key, check, doc, place) of runs; a later occurrence within a batch has a key of its own and a negative place."""
    for batch in kernel.small(batches, 1):
        row, place, value, check = _Sentences(batch.column(1)).runs()
        doc = batch.column(0).to_numpy()[row]
        order = np.lexsort((place, doc, check, value))
        k, c, d, p = value[order], check[order], doc[order], place[order]
        new = np.append(True, (k[1:] != k[:-1]) | (c[1:] != c[:-1]))[: len(order)]
        first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        again = (d != d[first]) | (p >> 16 != p[first] >> 16)
        later = np.zeros(len(order), bool)
        later[order] = again
        keep = np.zeros(len(order), bool)
        keep[order] = new | again  # not a repeated row of one id
        value = np.where(later, kernel.mix(doc.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + place.view(np.uint64)), value)
        columns = (value.view(np.int64), check.view(np.int32), doc, np.where(later, -1 - place, place))
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in columns], names=["key", "check", "doc", "place"])


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, check, doc, place) to (doc, place) of all occurrences but each run's first."""
    last = None  # key, check and first occurrence of the run that a batch ends in
    for batch in batches:
        key, check, doc, place = (x.to_numpy() for x in batch.columns)
        known = place < 0
        docs, places = [doc[known]], [-1 - place[known]]
        key, check, doc, place = (x[~known] for x in (key, check, doc, place))
        if len(key):
            new = np.append(True, (key[1:] != key[:-1]) | (check[1:] != check[:-1]))
            first = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
            first_doc, first_at = doc[first], place[first] >> 16
            if last is not None and last[:2] == (key[0], check[0]):
                first_doc[first == 0], first_at[first == 0] = last[2:]
            again = (doc != first_doc) | (place >> 16 != first_at)
            docs.append(doc[again])
            places.append(place[again])
            last = (key[-1], check[-1], first_doc[-1], first_at[-1])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(docs)), pa.array(np.concatenate(places))], names=["doc", "place"])


def _cut(at: int, width: int) -> Callable:
    """Rows with (…, ranges) to rows with the text cut, the numbers of sentences and of those removed, and where."""
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernel.small(batches, at):
            texts, ranges = batch.column(at), batch.column(width).to_pylist()
            own = _Sentences(texts)
            new, removed, where = texts.to_pylist(), np.zeros(len(ranges), np.int32), [[] for _ in ranges]
            for i, places in enumerate(ranges):
                if places:
                    new[i], removed[i], found = own.cut(i, [(p >> 16, p & 65535) for p in places])
                    where[i] = [{"start": a, "end": b} for a, b in found]
            columns = [*batch.columns[:width], pa.array(own.per_row.astype(np.int32)), pa.array(removed), pa.array(where, spans)]
            columns[at] = pa.array(new, texts.type)
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:width], "n_sentences", "n_removed", "removed"])

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with repeated passages cut from the text, and n_sentences, n_removed, removed.

    ``removed`` has the byte ranges of the UTF-8 text that were cut.  The first occurrence of a run,
    by id and place, stays.

    Defined cases: ids are integers; null and empty texts have no sentences and are unchanged; texts
    shorter than a run are never cut; rows that repeat an id count as the same occurrence and are cut
    alike, place by place; rows with a null id are neither compared nor cut; an empty table stays
    empty; columns named n_sentences, n_removed or removed are replaced, others kept.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("n_sentences", "n_removed", "removed")
    keyed = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).where("doc is not null")
    runs = keyed.mapInArrow(_runs, "key long, check int, doc long, place long")
    later = runs.repartition("key").sortWithinPartitions("key", "check", "doc", "place").mapInArrow(_later, "doc long, place long")
    ranges = materialize(later.groupBy("doc").agg(F.collect_set("place").alias("places")), "ranges")
    few = (ranges.agg(F.sum(F.size("places"))).first()[0] or 0) <= BROADCAST_RANGES
    names = docs.columns
    (own,) = fresh(docs, "places")
    side = ranges.select("doc", F.col("places").alias(own))
    rows = docs.join(F.broadcast(side) if few else side, docs[id_col].cast("long") == side["doc"], "left").select(*(docs[c] for c in names), side[own])
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    added = [T.StructField("n_sentences", T.IntegerType()), T.StructField("n_removed", T.IntegerType()), T.StructField("removed", T.ArrayType(span))]
    return rows.mapInArrow(_cut(names.index(text_col), len(names)), T.StructType([*docs.schema.fields, *added]))
