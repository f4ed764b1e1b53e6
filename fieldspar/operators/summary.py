"""Daily summaries: ordered first and last values, sums by activity, and their largest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspar.functions.text import meaningful


def depth_progress(rows: DataFrame, by: list[str], order: str, depth: str) -> DataFrame:
    """(by, n_depths, first_depth, last_depth, progress): progress needs two depths."""
    known = rows.where(F.col(depth).isNotNull())
    out = known.groupBy(*by).agg(F.count("*").alias("n_depths"), F.min_by(depth, order).alias("first_depth"), F.max_by(depth, order).alias("last_depth"))
    return out.withColumn("progress", F.when(F.col("n_depths") >= 2, F.round(F.col("last_depth") - F.col("first_depth"), 2)))


def hours_by_activity(rows: DataFrame, by: list[str], activity: str, hours: str, order: str) -> DataFrame:
    """Hours of each activity: missing hours count 0, a missing activity is unknown; with the first row's place."""
    total = F.sum(F.coalesce(F.col(hours), F.lit(0.0)).cast("decimal(18,4)")).cast("double")
    return rows.groupBy(*by, F.coalesce(F.col(activity), F.lit("unknown")).alias("activity")).agg(total.alias("hours"), F.min(order).alias("first_row"))


def main_activity(hours: DataFrame, by: list[str]) -> DataFrame:
    """The activity with most hours; of equal ones the one that comes first."""
    best = F.max_by(F.struct("activity", "hours"), F.struct("hours", -F.col("first_row")))
    return hours.groupBy(*by).agg(best.alias("best")).select(*by, F.col("best.activity").alias("main_activity"), F.col("best.hours").alias("main_hours"))


def daily_summary(reports: DataFrame, operations: DataFrame) -> DataFrame:
    """One row of facts and a sentence for each report.

    ``reports`` has (report_id, wellbore, period_start, period_end, summary_activities,
    summary_planned, file_name), ``operations`` (report_id, operation_id, row_index, depth, hours,
    main_activity, state, page_number).
    """
    by = ["report_id"]
    hours = hours_by_activity(operations, by, "main_activity", "hours", "row_index")
    split = hours.groupBy(*by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("activity", F.round("hours", 2))))).alias("hours_by_activity"), F.round(F.sum("hours"), 2).alias("total_hours"))
    counts = operations.groupBy(*by).agg(F.count("*").alias("operation_count"), F.count_if(F.col("state") == "fail").alias("fail_operation_count"))
    cited = operations.where("row_index < 5").groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("row_index", "operation_id", "page_number"))), lambda x: F.struct(x["operation_id"].alias("operation_id"), x["page_number"].alias("page_number"))).alias("cited_operations"))
    rows = reports
    for side in (counts, split, main_activity(hours, by), depth_progress(operations, by, "row_index", "depth"), cited):
        rows = rows.join(side, by, "left")
    rows = rows.withColumns({"operation_count": F.coalesce("operation_count", F.lit(0)), "fail_operation_count": F.coalesce("fail_operation_count", F.lit(0)), "summary_activities": meaningful(F.col("summary_activities")), "summary_planned": meaningful(F.col("summary_planned"))})
    sentence = F.concat_ws(
        " ",
        F.format_string("%s: %d operations, %d in a failed state.", F.coalesce("wellbore", F.lit("unknown")), F.col("operation_count"), F.col("fail_operation_count")),
        F.when(F.col("main_activity").isNotNull(), F.format_string("Main activity %s (%.2f h).", "main_activity", "main_hours")),
        F.when(F.col("progress").isNotNull(), F.format_string("Depth progress %.2f m.", "progress")),
        F.concat(F.lit("Completed: "), "summary_activities"), F.concat(F.lit("Planned: "), "summary_planned"),
    )
    return rows.withColumn("summary", sentence)
