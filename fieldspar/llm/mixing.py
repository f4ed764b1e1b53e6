"""Mixing sources to target weights: capped water-filling and seeded repetitions, in DataFrame operations only.

Each source may be repeated at most ``epochs`` times.  The budget is shared by weight; sources
whose share is above their cap are clamped and what they can't take is shared again among the rest,
until no share is above its cap.  A source with target = (k + f) * its size takes every document k
times and, in the order of a seeded hash, once more up to f of its words; the one document at the
cut is taken in part, so that the source meets its target to a word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldspar.llm.storage import drop, materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Up to this number of sources (about 100 bytes each) their plan is broadcast; more are joined by shuffle.
BROADCAST_SOURCES = 100_000
#: Bits of the hash, and of those the ones that make a bucket.
HASH_BITS, BUCKET_BITS = 52, 12


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 if it is null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded_hash(id_: Column, seed: int) -> Column:
    """A place from 0 to 2^52 - 1 that depends on the id and the seed alone."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def rank_weights(sized: DataFrame, source_col: str = "source", cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(source, weight): the weights of ``cycle`` repeating over the sources by code point, null last."""
    sources = sized.select(F.col(source_col).alias("source")).distinct()
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.select("source", F.element_at(F.array(*map(F.lit, cycle)), (place % len(cycle) + 1).cast("int")).alias("weight"))


def _side(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_SOURCES else df


def plan_mix(sized: DataFrame, weights: DataFrame, *, budget: int | None = None, epochs: int = 3, seed: int = 0, id_col: str = "doc_id", source_col: str = "source", size_col: str = "size") -> tuple[DataFrame, int]:
    """One row per source: how often it is taken whole and where its extra part is cut; and the number of sources.

    ``weights`` is (source, weight); a source without a weight, or with one that is not above 0,
    gets nothing.  The budget is all words by default; beyond ``epochs`` times all words every
    source is at its cap.  Only sums over sources come to the driver.
    """
    sized = sized.select(F.col(source_col).alias("source"), F.col(size_col).alias("size"), seeded_hash(F.col(id_col), seed).alias("place"))
    bucket = F.expr(f"shiftright(place, {HASH_BITS - BUCKET_BITS})")
    buckets = materialize(sized.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("size")), "mix-buckets")
    sums = buckets.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = weights.select(F.col("source").alias("s"), F.greatest(F.col("weight").cast("double"), F.lit(0.0)).alias("weight"))
    sources = sums.join(named, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    cap = F.col("source_size") * F.lit(epochs)
    sources = materialize(sources.select("source", "source_size", F.coalesce("weight", F.lit(0.0)).alias("weight"), cap.alias("cap")), "mix-sources")

    n, words, level, clamped = *sources.agg(F.count("*"), F.coalesce(F.sum("source_size"), F.lit(0))).first(), 0.0, -1
    budget = words if budget is None else budget
    while True:
        full = F.col("cap") <= F.col("weight") * level
        row = sources.where("weight > 0").agg(F.count_if(full), F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0)), F.sum(F.when(~full, F.col("weight")))).first()
        if row[0] == clamped or row[2] is None:
            break
        clamped, level = row[0], (budget - row[1]) / row[2]
    share = F.col("weight") * level
    full = F.col("cap") <= share
    target = F.when(F.col("weight") <= 0, 0.0).when(full, F.col("cap").cast("double")).otherwise(share)
    whole = F.when(full & (F.col("weight") > 0), F.lit(epochs)).when(F.col("source_size") > 0, F.floor(target / F.col("source_size"))).otherwise(0)
    sources = sources.withColumns({"target": target, "whole": whole.cast("long")})
    sources = sources.withColumn("extra", F.greatest(F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"), F.lit(0)))
    sources = materialize(sources.select("source", "source_size", "target", "whole", "extra"), "mix-targets")

    upto = F.sum("size").over(Window.partitionBy("source").orderBy("bucket"))
    goal = sources.select(F.col("source").alias("s"), "extra")
    cut = buckets.withColumn("upto", upto).join(_side(goal, n), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    cut = cut.where("upto > extra and upto - size <= extra").select(F.col("source").alias("s"), F.col("bucket").alias("b"), (F.col("extra") - F.col("upto") + F.col("size")).alias("left"))
    inside = sized.withColumn("bucket", bucket).join(_side(cut, n), F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    places = inside.groupBy("source", "place", "left").agg(F.sum("size").alias("size"))
    places = places.withColumn("upto", F.sum("size").over(Window.partitionBy("source").orderBy("place"))).where("upto > left and upto - size <= left")
    cut = places.select(F.col("source").alias("s"), F.col("place").alias("cut"), (F.col("left") - F.col("upto") + F.col("size")).alias("part"), F.col("size").alias("part_of"))
    plan = sources.join(_side(cut, n), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    plan = materialize(plan.select(F.col("source").alias("mix_source"), "source_size", "target", "whole", "cut", "part", "part_of"), "mix-plan")
    drop(buckets)
    return plan, n


def take_mix(docs: DataFrame, plan: tuple[DataFrame, int], *, seed: int = 0, id_col: str = "doc_id", source_col: str = "source", size_col: str = "size") -> DataFrame:
    """``docs`` with source_size, target and taken: the words that the mix takes of each row, repeats counted.

    ``docs`` must have the rows that the plan was made from.  Columns of these names are replaced.

    Defined cases: a null source is a source of its own; a null id has the place of an empty one;
    rows that share an id share its place and, at the cut, its part in proportion to their sizes;
    empty and null texts have size 0 and taken 0; an empty table stays empty.
    """
    added = ("source_size", "target", "taken")
    docs = docs.drop(*added)
    own = [F.col(f"d.`{c}`") for c in docs.columns]
    side, n = plan
    rows = docs.alias("d").join(_side(side, n).alias("m"), F.col(f"d.`{source_col}`").eqNullSafe(F.col("m.mix_source")))
    size, place = F.col(f"d.`{size_col}`"), seeded_hash(F.col(f"d.`{id_col}`"), seed)
    extra = F.when(F.col("m.cut").isNull(), 0).when(place < F.col("m.cut"), size).when(place == F.col("m.cut"), F.expr(f"d.`{size_col}` * m.part div m.part_of")).otherwise(0)
    return rows.select(*own, F.col("m.source_size").alias("source_size"), F.col("m.target").alias("target"), (size * F.col("m.whole") + extra).cast("long").alias("taken"))
