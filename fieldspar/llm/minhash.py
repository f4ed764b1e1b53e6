"""MinHash near-duplicate detection by a signature-coordinate inverted join.

Rows whose sets are equal are one class, and all that follows is about classes: ids may repeat, with
equal texts or with different ones.  Every class's document is posted under each of its (coordinate, value) pairs.  A pair of documents whose
sets are similar enough agrees in at least ``matches`` of the coordinates, so

* values that only one document has are dropped, and so is every document left with fewer than
  ``matches`` postings (prefix filter, first half);
* of the others only the ``postings - matches + 1`` rarest are merged: two documents that agree in
  ``matches`` coordinates must meet in those (prefix filter, second half);
* lists up to ``SHORT`` are merged at once.  Longer ones are skipped in that merge and probed
  afterwards: bounded chunks with the list's most central document first, then - only for members
  that are not yet in the component of the list's majority - all chunk pairs they can still be in.
  Nothing is capped: a pair that meets in any list is verified or already connected.

Verification counts shared shingles of the full sets inside blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspar.llm import kernel
from fieldspar.llm.components import connected_components
from fieldspar.llm.storage import drop, fresh, materialize, small_batches, spread_join

COORDINATES = 32
#: Chance to miss a pair exactly at the similarity bound; more similar pairs are safer by far.
MISS = 2e-5
#: Lists up to this length are merged in one block; longer ones go in chunks of CHUNK.
SHORT, CHUNK = 64, 40
#: Shingles of a block of a short list, and of a chunk; lists of more count as long ones.
BLOCK_SHINGLES = 2_000_000
#: Members, and shingles, of a chunk in the blocks for the rest.
REST_CHUNK, REST_SHINGLES = 512, 2_000_000
#: Ids up to this number (8 bytes each) are broadcast to pick texts; more are joined by shuffle.
BROADCAST_IDS = 2_000_000

_FACTORS = np.random.default_rng(7).integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def matches_needed(percent: int) -> int:
    """Coordinates that a pair at the bound shares with a chance of at least 1 - MISS."""
    p, missed = percent / 100, 0.0
    for t in range(COORDINATES):
        missed += comb(COORDINATES, t) * p**t * (1 - p) ** (COORDINATES - t)
        if missed > MISS:
            return max(t, 1)
    return COORDINATES


def signature(items: np.ndarray) -> np.ndarray:
    """The least value of each coordinate's hash over a set, folded to 32 bits."""
    least = None
    for at in range(0, len(items), 512):
        part = (items[at : at + 512, None] * _FACTORS).min(axis=0)
        least = part if least is None else np.minimum(least, part)
    return (kernel.mix(least) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _sum(items: np.ndarray) -> int:
    """Half of a set's fingerprint."""
    return int(items.sum(dtype=np.uint64).view(np.int64))


def _signatures(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernel.small(batches, 2):
            n, one, two, signs = [], [], [], []
            for items in kernel.distinct_shingles(batch.column(2), size):
                n.append(len(items))
                if len(items):
                    one.append(_sum(items))
                    two.append(int(kernel.mix(items ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)))
                    signs.append(signature(items))
                else:
                    one.append(None)
                    two.append(None)
                    signs.append(None)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(signs, pa.list_(pa.int32()))],
                names=["id", "h", "n_shingles", "one", "two", "signature"],
            )

    return run


def _same(n: int, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the linked pairs among n sets; shared items are counted by a product of indicator matrices."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), sizes)
    values, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = times[column] > 1  # an item of one set alone is in no intersection
    owner, column = owner[often], (np.cumsum(times > 1) - 1)[column[often]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    shared = np.zeros((n, n), np.int64)
    total, width = int((times > 1).sum()), 1 << 12
    for at in range(0, total, width):
        a, b = np.searchsorted(column, (at, at + width))
        part = np.zeros((n, min(width, total - at)), np.float32)
        part[owner[a:b], column[a:b] - at] = 1
        shared += (part @ part.T).astype(np.int64)
    linked = 100 * shared >= percent * (sizes[:, None] + sizes[None, :] - shared)
    left, edges = set(range(n)), []
    while left:
        todo = [left.pop()]
        while todo:
            i = todo.pop()
            for j in [j for j in np.flatnonzero(linked[i]).tolist() if j in left]:
                left.discard(j)
                edges.append((i, j))
                todo.append(j)
    return edges


def _streamed(batches: Iterator[pa.RecordBatch], work: Callable[[pa.Table], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Work on whole blocks of rows sorted by block; a block may reach over several batches."""
    kept = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([kept, rows]) if kept is not None else rows
        blocks = rows.column("block").to_numpy()
        last = int(np.searchsorted(blocks, blocks[-1]))
        kept = rows.slice(last)
        if last:
            yield work(rows.slice(0, last))
    if kept is not None and kept.num_rows:
        yield work(kept)


def _cuts(blocks: np.ndarray) -> Iterator[tuple[int, int]]:
    edges = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
    yield from zip(edges, edges[1:], strict=False)


def _promising(need: int) -> Callable:
    """Sorted (block, id, component, signature) to the members of each block that agree with one of another
    component in ``need`` coordinates, as (block, id); equal sets of members get one block."""

    def work(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        ids, components = rows.column("id").to_numpy(), rows.column("component").to_numpy()
        signs = rows.column("signature").combine_chunks().flatten().to_numpy().reshape(-1, COORDINATES)
        found = []
        for a, b in _cuts(rows.column("block").to_numpy()):
            same = np.zeros((b - a, b - a), np.int16)
            for k in range(COORDINATES):
                own = signs[a:b, k]
                same += own[:, None] == own[None, :]
            near = ((same >= need) & (components[a:b, None] != components[None, a:b])).any(axis=1)
            if near.any():
                own = np.unique(ids[a:b][near])
                found.append(np.stack([np.full(len(own), kernel.mix(own.view(np.uint64)).sum(dtype=np.uint64).view(np.int64)), own]))
        pairs = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["block", "id"])

    return lambda batches: _streamed(batches, work)


def _verify(size: int, percent: int) -> Callable:
    """Sorted (block, id, one, text) rows to verified links."""

    def links(rows: pa.Table) -> list[tuple[int, int]]:
        rows, out = rows.combine_chunks(), []
        ids, one = rows.column("id").to_pylist(), rows.column("one").to_pylist()
        for a, b in _cuts(rows.column("block").to_numpy()):
            texts = rows.slice(a, b - a).to_batches()
            found = [s for part in kernel.small(texts, 3) for s in kernel.distinct_shingles(part.column(3), size)]
            # a central document may also be in its chunk, and a row's id and text hash may not be its class's alone
            own = {i: x for i, mark, x in zip(ids[a:b], one[a:b], found, strict=True) if _sum(x) == mark}
            names = list(own)
            if len(names) > 1:
                out += [(names[i], names[j]) for i, j in _same(len(names), list(own.values()), percent)]
        return out

    return lambda batches: _streamed(batches, lambda rows: _pairs(links(rows)))


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    pairs = np.array(found, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _row_hash(text_col: str = "text") -> Column:
    """What tells rows of one id apart: null and empty texts are the same."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def _linked(blocks: DataFrame, classes: DataFrame, docs: DataFrame, again: DataFrame | None, size: int, percent: int) -> DataFrame:
    """Verified links within blocks of (block, id); the texts come from the row that each class's leader names."""
    blocks = materialize(blocks, "blocks")
    wanted = materialize(classes.join(blocks.select("id").distinct(), "id", "left_semi").select("id", "one", F.col("leader").alias("doc"), F.col("h").alias("g")), "wanted")
    few = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    texts = docs.join(few, docs["id"].eqNullSafe(wanted["doc"]) & (docs["h"] == wanted["g"])).select(wanted["id"], "one", "text")
    if again is not None:
        texts = texts.dropDuplicates(["id", "one"])
    rows = spread_join(blocks, texts, ["id"]).select("block", "id", "one", "text").repartition("block").sortWithinPartitions("block")
    return rows.mapInArrow(_verify(size, percent), "a long, b long")


def _chunk(id_: str, chunks: Column) -> Column:
    return F.pmod(F.xxhash64(id_), chunks)


def _first_blocks(prefix: DataFrame) -> DataFrame:
    """Blocks of short lists, and of chunks of long ones with each list's most central document."""
    short = prefix.select("id", F.explode("items").alias("item")).where("not item.long")
    short = short.groupBy("item.key").agg(F.array_sort(F.collect_list("id")).alias("ids")).where("size(ids) > 1")
    short = short.select("ids").distinct().select(F.xxhash64("ids").alias("block"), F.explode("ids").alias("id"))
    long = prefix.select("id", "score", "size", F.explode(F.expr("slice(reverse(items), 1, 2)")).alias("item")).where("item.long")
    long = materialize(long.select("id", "score", "size", F.col("item.key").alias("key")), "long-lists")
    chunks = F.ceil(F.greatest(F.count("*") / CHUNK, F.sum("size") / BLOCK_SHINGLES)).cast("long")
    hubs = long.groupBy("key").agg(F.max_by("id", F.struct("score", "id")).alias("hub"), chunks.alias("chunks"))
    parts = materialize(spread_join(long, hubs, ["key"]).select("hub", "id", F.xxhash64("key", _chunk("id", F.col("chunks"))).alias("block")), "parts")
    return short.union(parts.select("block", "id")).union(parts.select("block", F.col("hub").alias("id"))).distinct()


def _rest_blocks(prefix: DataFrame, components: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Blocks for what the first pass left open in long lists: members outside the majority's component.

    Sets whose sizes differ by more than the similarity allows can't link, so only neighbouring
    size classes meet.  The signatures of a block are compared before any text is fetched: only
    members that agree with one of another component in enough coordinates remain.
    """
    long = prefix.select("id", "size", F.explode("items").alias("item")).where("item.long").select("id", "size", F.col("item.key").alias("key"))
    long = long.join(components.toDF("id", "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    long = materialize(long, "long-lists")
    sums = long.groupBy("key", "component").count().groupBy("key").agg(F.max_by("component", F.struct("count", "component")).alias("major"), F.sum("count").alias("n"), F.max("count").alias("n_major"))
    grade = F.floor(F.log(F.col("size")) / float(-np.log(percent / 100)) + 1e-9)
    open_ = spread_join(long, sums.where("n > n_major"), ["key"])
    open_ = materialize(open_.select("key", "id", "size", "component", (F.col("component") != F.col("major")).alias("odd"), grade.alias("grade")), "open-lists")
    drop(long)
    counts = open_.groupBy("key", "odd", "grade").agg(F.ceil(F.greatest(F.count("*") / REST_CHUNK, F.sum("size") / REST_SHINGLES)).alias("chunks"))
    side = ["key", "odd", "grade", "chunk"]
    long = materialize(spread_join(open_, counts, side[:3]).withColumn("chunk", _chunk("id", F.col("chunks"))).select(*side, "id", "component"), "chunks")
    drop(open_)
    chunks = long.select(*side).distinct()
    other = chunks.toDF("key", "odd2", "grade2", "chunk2")
    meet = F.expr("case when not odd2 then abs(grade2 - grade) <= 1 else grade2 = grade + 1 or (grade2 = grade and chunk <= chunk2) end")
    pairs = chunks.where("odd").join(other, "key").where(meet)
    sides = F.array(F.struct("odd", "grade", "chunk"), F.struct(*(F.col(f"{c}2").alias(c) for c in side[1:])))
    pairs = pairs.select("key", F.xxhash64("key", "grade", "chunk", "odd2", "grade2", "chunk2").alias("block"), F.explode(sides).alias("side"))
    rows = long.join(pairs.select("key", "block", "side.*"), side).select("block", "id", "component").distinct()
    signed = rows.join(classes.select("id", "signature"), "id").select("block", "id", "component", "signature")
    near = signed.repartition("block").sortWithinPartitions("block").mapInArrow(_promising(matches_needed(percent)), "block long, id long")
    return near.distinct()


@dataclass
class Groups:
    """Rows (id, h, n_shingles, one, two), classes (id, one, two, leader, h, ...), verified links of classes, ids of several rows."""

    rows: DataFrame
    classes: DataFrame
    links: DataFrame
    again: DataFrame | None

    def components(self, by_id: bool) -> DataFrame:
        """(one, two, first, first_h): the leader of each class's component, with the smallest id.

        ``by_id`` also links the classes of rows that share an id.
        """
        links = self.links
        if by_id and self.again is not None:
            rows = self.rows.where("n_shingles > 0 and id is not null").join(self.again, "id", "left_semi").select(F.col("id").alias("doc"), "one", "two").distinct()
            rows = materialize(rows.join(self.classes.select("id", "one", "two"), ["one", "two"]).select("doc", "id"), "shared-ids")
            links = links.union(spread_join(rows, rows.groupBy("doc").agg(F.min("id").alias("least")), ["doc"]).select("least", "id").toDF("a", "b"))
        found = connected_components(links, "a", "b").toDF("id", "component")
        named = self.classes.select("id", "one", "two", "leader", "h").join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
        named = materialize(named, "named")
        first = named.groupBy("component").agg(F.min(F.struct(F.col("leader").isNull().alias("none"), "leader", "h")).alias("f"))
        return materialize(spread_join(named, first, ["component"]).select("one", "two", F.col("f.leader").alias("first"), F.col("f.h").alias("first_h")), "components-by-class")


def find_groups(docs: DataFrame, percent: int, size: int) -> Groups:
    """Verified links between the classes of (id, h, text) rows."""
    small_batches(docs.sparkSession)
    signed = materialize(docs.mapInArrow(_signatures(size), "id long, h long, n_shingles long, one long, two long, signature array<int>"), "signatures")
    leader = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("h")))
    classes = signed.where("n_shingles > 0").groupBy("one", "two").agg(leader.alias("f"), F.first("signature").alias("signature"), F.first("n_shingles").alias("size"))
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("id"), "one", "two", F.col("f.id").alias("leader"), F.col("f.h").alias("h"), "signature", "size"), "classes")
    again = materialize(signed.groupBy("id").count().where("count > 1").select("id"), "again")
    if again.isEmpty():
        drop(again)
        again = None

    need = matches_needed(percent)
    posts = classes.select("id", "size", F.posexplode("signature").alias("k", "value"))
    posts = posts.select("id", "size", F.expr("shiftleft(cast(k as bigint), 32) | (cast(value as bigint) & 4294967295)").alias("key"))
    counts = posts.groupBy("key").agg(F.count("*").alias("df"), F.sum("size").alias("mass")).where("df > 1")
    item = F.struct("df", "key", ((F.col("df") > SHORT) | (F.col("mass") > BLOCK_SHINGLES)).alias("long"))
    hits = posts.join(counts, "key").groupBy("id").agg(F.array_sort(F.collect_list(item)).alias("items"), F.sum("df").alias("score"), F.first("size").alias("size"))
    prefix = hits.where(F.size("items") >= need).select("id", "score", "size", F.expr(f"slice(items, 1, size(items) - {need - 1})").alias("items"))
    prefix = materialize(prefix, "prefix")

    links = materialize(_linked(_first_blocks(prefix), classes, docs, again, size, percent), "links")
    rest = materialize(_rest_blocks(prefix, connected_components(links, "a", "b"), classes, percent), "rest")
    if not rest.isEmpty():
        links = links.union(materialize(_linked(rest, classes, docs, again, size, percent), "links"))
    drop(prefix)
    drop(rest)
    return Groups(signed, classes, links, again)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), _row_hash(text_col).alias("h"), F.col(text_col).alias("text"))


def minhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, percent: int = 80, size: int = kernel.SHINGLE_WORDS) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row: groups of near-duplicate documents.

    A row's set holds its distinct runs of ``size`` words (all its words as one run if it has
    fewer).  Rows link if ``100 * shared >= percent * union`` on the full sets; component_id is the
    smallest id reachable by links and ``kept`` tells whether that is the row's own.

    Defined cases: ids are integers; null and empty texts have an empty set, link with nothing and
    are kept; equal sets are one class, collapsed before the join; an id is one document even if
    its rows have different texts, so that these rows share a component; a row with a null id links
    by its text, with a null component if nothing it reaches has an id; an empty table gives an
    empty result; other columns are ignored, whatever their names.
    """
    groups = find_groups(_rows(docs, id_col, text_col), percent, size)
    named = groups.components(by_id=True)
    if groups.again is not None:
        # Rows without words that share an id with a text have its component, too.
        ids = groups.rows.where("n_shingles > 0 and id is not null").join(groups.again, "id", "left_semi").select("id", "one", "two")
        known = spread_join(materialize(ids, "ids"), named, ["one", "two"]).groupBy("id").agg(F.min("first").alias("by_id"))
        known = materialize(known, "known")
    rows = spread_join(groups.rows.select("id", "n_shingles", "one", "two"), named.select("one", "two", "first"), ["one", "two"], "left")
    if groups.again is not None:
        empty = rows.where("n_shingles = 0").join(known, "id", "left").withColumn("first", F.col("by_id")).drop("by_id")
        rows = rows.where("n_shingles > 0").unionByName(empty)
    component = F.coalesce("first", "id")
    return rows.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), (F.col("id") == component).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, percent: int = 80, size: int = kernel.SHINGLE_WORDS) -> DataFrame:
    """The rows of ``docs`` with one row of each group of near-duplicate texts, the one with the smallest id.

    Decided by row, not by id: where an id repeats, each of its texts stays or goes by itself, and of
    repeated equal rows one stays.  Rows without words all stay; rows with a null id come last.
    Columns and their names are those of ``docs``; an empty table stays empty.
    """
    groups = find_groups(_rows(docs, id_col, text_col), percent, size)
    first = groups.components(by_id=False)
    rows = spread_join(groups.rows.where("n_shingles > 0").select("id", "h", "one", "two"), first, ["one", "two"])
    stays = F.col("id").eqNullSafe(F.col("first")) & (F.col("h") == F.col("first_h"))
    gone = materialize(rows.where(~stays).select("id", "h").distinct(), "near-duplicates")
    kept = without_rows(docs, gone, id_col, text_col)
    if groups.again is None:
        return kept
    again, id_ = groups.again, kept[id_col].cast("long")
    mark, words = fresh(kept, "h", "n")
    once = kept.join(again, id_.eqNullSafe(again["id"]), "left_semi").withColumns({mark: _row_hash(text_col), words: F.regexp_like(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]"))})
    once = once.where(F.col(words)).dropDuplicates([id_col, mark]).unionByName(once.where(~F.coalesce(F.col(words), F.lit(False)))).drop(mark, words)
    return kept.join(again, id_.eqNullSafe(again["id"]), "left_anti").unionByName(once)


def without_rows(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that a table of distinct (id, h) doesn't name; nulls count as values."""
    side = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    h = F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
    return docs.join(side, docs[id_col].cast("long").eqNullSafe(gone["id"]) & (h == gone["h"]), "left_anti")
