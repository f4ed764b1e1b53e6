"""Rule candidates from operations and sections, stored once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rule: predicate over an operation, severity, confidence.
OPERATION_RULES: dict[str, tuple[str, str, float]] = {
    "operation_state_fail": ("state = 'fail'", "medium", 0.9),
    "operation_lost_circulation": ("sub_activity = 'lost_circulation' or lower(remark) like '%lost circulation%'", "high", 0.9),
    "operation_well_control": ("sub_activity = 'well_control' or lower(remark) like '%well control%'", "high", 0.9),
    "operation_repair": ("sub_activity = 'repair' or lower(remark) like '%repair%'", "medium", 0.9),
    "negative_operation_duration": ("hours < 0", "high", 0.9),
}


def operation_candidates(operations: DataFrame, rules: dict[str, tuple[str, str, float]] = OPERATION_RULES) -> DataFrame:
    """(record_type, rule, record_id, severity, confidence, score): one row for each rule that an operation meets, in one scan.

    ``operations`` has (operation_id, state, sub_activity, remark, hours).
    """
    hit: list[Column] = [
        F.when(F.coalesce(F.expr(test), F.lit(False)), F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence")))
        for rule, (test, severity, confidence) in rules.items()
    ]
    rows = operations.select("operation_id", F.explode(F.array_compact(F.array(*hit))).alias("c"))
    return rows.select(F.lit("operation").alias("record_type"), "c.rule", F.col("operation_id").alias("record_id"), "c.severity", "c.confidence", F.lit(1.0).alias("score"))


def section_candidates(sections: DataFrame, kind: str = "equipment_failure_information") -> DataFrame:
    """One candidate for each section of a kind."""
    return sections.where(F.col("section_type") == kind).select(
        F.lit("section").alias("record_type"), F.lit("equipment_failure_section_present").alias("rule"), F.col("section_id").alias("record_id"),
        F.lit("medium").alias("severity"), F.lit(1.0).alias("confidence"), F.lit(1.0).alias("score"),
    )


def detector_type(category: Column) -> Column:
    """Candidates about the source's data are data_quality, others rule."""
    return F.when(category == "source_data_quality", "data_quality").otherwise("rule")


def not_stored(new: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """New rows whose key, nulls equal, is not stored."""
    match = reduce(lambda a, b: a & b, (F.col(f"n.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys))
    return new.alias("n").join(stored.select(*keys).distinct().alias("s"), match, "left_anti")


def mark_known(rows: DataFrame, known: DataFrame, key: str, name: str) -> DataFrame:
    """Adds whether a row's key is among the known ones."""
    ids = known.select(F.col(key).alias("_k")).distinct().withColumn("_hit", F.lit(True))
    return rows.join(ids, F.col(key) == F.col("_k"), "left").withColumn(name, F.col("_hit").isNotNull()).drop("_k", "_hit")
