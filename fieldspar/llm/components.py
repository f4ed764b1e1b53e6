"""Connected components of a link table, without gathering links on one machine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspar.llm.storage import HEAVY, HEAVY_LEAST, drop, materialize


#: A forest of up to this number of links (16 bytes each) is finished by one task; of more, by rounds of joins.
SMALL_LINKS = 500_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's links as a spanning forest, each vertex linked to the smallest of its tree."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root.setdefault(up, up)
            x = root[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
    pairs = np.array([(x, r) for x in root if (r := find(x)) != x], np.int64).reshape(-1, 2)
    for at in range(0, len(pairs), 65536):
        yield pa.RecordBatch.from_arrays([pa.array(pairs[at : at + 65536, 0]), pa.array(pairs[at : at + 65536, 1])], names=["u", "v"])


def _star(rows: DataFrame, least: DataFrame, limit: int) -> DataFrame:
    """Rows (u, v) as (v, m), with m from the table of (u, m, n).

    A vertex of more than ``limit`` links is looked up from a broadcast, which at most 2 * HEAVY
    vertices are in; so its rows stay where they are and are no single task's.
    """
    hubs = F.broadcast(least.where(F.col("n") > limit).select("u", "m"))
    rest = rows.join(hubs, "u", "left_anti").join(least.where(F.col("n") <= limit).select("u", "m"), "u")
    return rows.join(hubs, "u").select("v", "m").union(rest.select("v", "m")).toDF("u", "v").where("u <> v")


def connected_components(links: DataFrame, a: str, b: str, name: str = "components") -> DataFrame:
    """(node, component) for every vertex of a link table; component is its smallest vertex.

    Each task first turns its own links into a forest, which shrinks the table to a few times the
    number of vertices.  A forest of at most SMALL_LINKS links is merged by one task; of more, large-star and small-star rounds then alternate until nothing changes.
    Minima are pre-aggregated before their shuffle, and vertices with very many links are joined
    without one.  Links with a null end and loops are dropped; an empty table has no components.
    """
    pairs = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
    pairs = pairs.where("u is not null and v is not null and u <> v")
    edges = materialize(pairs.mapInArrow(_forest, "u long, v long"), name)
    mark, n = None, edges.count()
    if n <= SMALL_LINKS:
        whole = materialize(edges.coalesce(1).mapInArrow(_forest, "u long, v long"), name)
        drop(edges)
        edges = whole
    while n > SMALL_LINKS:
        limit = max(HEAVY_LEAST, edges.count() // HEAVY)
        both = edges.union(edges.select("v", "u").toDF("u", "v"))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"), name)
        large = materialize(_star(both.where("v > u"), least, limit).distinct(), name)
        drop(least)
        tops = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = materialize(tops.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), name)
        small = materialize(_star(tops, low, limit).union(low.select("u", "m")).distinct(), name)
        now = small.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        for table in (edges, large, low):
            drop(table)
        edges = small
        if tuple(now) == mark:
            break
        mark = tuple(now)
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
