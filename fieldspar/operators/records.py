"""Record-keeping operators: latest of a log, last-wins lookups, merges by key, change detection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(log: DataFrame, key: str | list[str], order: list[Column]) -> DataFrame:
    """The newest row of each key: a max over a struct, pre-aggregated before its shuffle.

    ``order`` lists columns that grow with time, most significant first.
    """
    key = [key] if isinstance(key, str) else key
    rest = [c for c in log.columns if c not in key]
    newest = log.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return newest.select(*key, *[F.col("_row")[c].alias(c) for c in rest])


def effective_status(reviews: DataFrame) -> DataFrame:
    """(anomaly_id, status, domain_validated): the latest decision; validated only if it is confirmed."""
    newest = latest(reviews, "anomaly_id", [F.col("created_at"), F.col("review_id")])
    return newest.select("anomaly_id", F.col("decision").alias("status"), (F.col("decision") == "confirmed").alias("domain_validated"))


def history(reviews: DataFrame) -> DataFrame:
    """Each anomaly's decisions in order."""
    ordered = F.array_sort(F.collect_list(F.struct("created_at", "review_id", "decision")))
    return reviews.groupBy("anomaly_id").agg(F.transform(ordered, lambda x: x["decision"]).alias("decisions"))


def valid_review(decision: Column, reviewer: Column) -> Column:
    """Whether a review may be appended."""
    return decision.isin("needs_more_evidence", "confirmed", "rejected") & (F.trim(reviewer) != "")


def last_wins(rows: DataFrame, key: str | list[str], order: list[Column]) -> DataFrame:
    """A lookup side with one row for each key: of repeated keys the last one."""
    return latest(rows, key, order)


def replace_by_key(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The table after all rows of the new rows' keys were replaced."""
    kept = existing.join(new.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def merge_by_key(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """An upsert: new values where a key is new or given again, old ones elsewhere."""
    rest = [c for c in existing.columns if c not in keys]
    both = existing.alias("o").join(new.withColumn("_new", F.lit(True)).alias("n"), keys, "full_outer")
    pick = [F.when(F.col("_new"), F.col(f"n.{c}") if c in new.columns else F.lit(None)).otherwise(F.col(f"o.{c}")).alias(c) for c in rest]
    return both.select(*keys, *pick)


def activate(runs: DataFrame, version: str) -> DataFrame:
    """Model runs with one version active."""
    return runs.withColumn("is_active", F.col("version") == version)


def changed(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows whose values differ, nulls equal; an unknown never replaces a known label."""
    pairs = old.alias("o").join(new.alias("n"), key)
    differs = reduce(lambda a, b: a | b, (~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) & (F.coalesce(F.col(f"n.{c}"), F.lit("unknown")) != "unknown") for c in columns))
    return pairs.where(differs).select(key, *[F.col(f"o.{c}").alias(f"old_{c}") for c in columns], *[F.col(f"n.{c}").alias(f"new_{c}") for c in columns])


def align_by_position(a: DataFrame, b: DataFrame, key: str, position: str) -> DataFrame:
    """Full outer merge by position within a key, with what is missing on either side."""
    left, right = a.withColumn("_a", F.lit(True)), b.withColumn("_b", F.lit(True))
    rows = left.join(right, [key, position], "full_outer")
    return rows.withColumns({"missing_left": F.col("_a").isNull(), "missing_right": F.col("_b").isNull()}).drop("_a", "_b")


def fingerprint(rows: DataFrame, *columns: str) -> DataFrame:
    """One row with a hash of the number of rows and the largest value of each column."""
    facts = rows.agg(F.count("*").cast("string").alias("n"), *[F.max(c).cast("string").alias(c) for c in columns])
    return facts.select(F.substring(F.sha2(F.concat_ws(":", "n", *columns), 256), 1, 16).alias("fingerprint"))


def ordered_hash(rows: DataFrame, by: list[str], order: str, text: str) -> DataFrame:
    """SHA-256 of each group's texts in order, one on a line."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text])
    return rows.groupBy(*by).agg(F.sha2(F.array_join(lines, "\n"), 256).alias("sha256"))


def islands(rows: DataFrame, by: list[str], position: str) -> DataFrame:
    """Runs of consecutive positions: (by, first, last, n)."""
    points = rows.select(*by, position).distinct()
    label = F.col(position) - F.row_number().over(Window.partitionBy(*by).orderBy(position))
    return points.withColumn("_run", label).groupBy(*by, "_run").agg(F.min(position).alias("first"), F.max(position).alias("last"), F.count("*").alias("n")).drop("_run")


def chat_context(turns: DataFrame, conversation: str, order: str, keep: int = 4) -> DataFrame:
    """(conversation, last turns in order, latest user text) from the last turns of each conversation."""
    newest = Window.partitionBy(conversation).orderBy(F.col(order).desc())
    kept = turns.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= keep)
    return kept.groupBy(conversation).agg(
        F.count("*").alias("n_turns"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "role"))), lambda x: x["role"]), ",").alias("roles"),
        F.max_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col(order))).alias("latest_user_text"),
    )
