"""Answer handlers: intent -> lazy plan over the stored tables.

Each handler takes the tables and a plan and returns the rows to show; ``answer`` runs the bounded
result and keeps the audit.  Filters on dates are ranges and reach the scans.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspar.functions.scores import python_round
from fieldspar.functions.temporal import day_number, iso, on_day
from fieldspar.functions.text import citation, meaningful
from fieldspar.operators import trend
from fieldspar.operators.summary import daily_summary
from fieldspar.plans.planner import Plan
from fieldspar.plans.retriever import Retriever, index_folder
from fieldspar.sources.sinks import log_query

Tables = Mapping[str, DataFrame]
Handler = Callable[[Tables, Plan], DataFrame]
FAILURE_LIMIT = 500


def _all(tests: list[Column]) -> Column:
    out = F.lit(True)
    for test in tests:
        out = out & test
    return out


def _reports(plan: Plan) -> list[Column]:
    tests = [F.col("wellbore") == plan.wellbore] if plan.wellbore else []
    if plan.date_from and plan.date_from == (plan.date_to or plan.date_from):
        return [*tests, on_day(F.col("period_end"), plan.date_from.isoformat())]
    if plan.date_from:
        tests.append(F.col("period_end") >= F.lit(plan.date_from.isoformat()).cast("timestamp_ntz"))
    if plan.date_to:
        tests.append(F.col("period_end") < F.date_add(F.lit(plan.date_to.isoformat()).cast("date"), 1).cast("timestamp_ntz"))
    return tests


def _files(tables: Tables) -> DataFrame:
    return tables["source_documents"].select("document_id", "file_name")


def identity_mapping(tables: Tables, plan: Plan) -> DataFrame:
    """Mappings that evidence confirms."""
    return tables["identity_mappings"].where("mapping_status = 'confirmed'").orderBy("source_namespace", "source_identifier", "target_identifier").limit(plan.limit)


def report_lookup(tables: Tables, plan: Plan) -> DataFrame:
    """The newest reports with what was done and is planned."""
    rows = tables["reports"].where(_all(_reports(plan))).join(_files(tables), "document_id")
    return rows.orderBy(F.desc_nulls_last("period_end"), "report_id").limit(plan.limit).select(
        "report_id", "wellbore", F.coalesce("filename_date", F.to_date("period_end")).alias("report_date"), iso(F.col("period_end")).alias("period_end"),
        meaningful(F.col("summary_activities")).alias("completed_activities"), meaningful(F.col("summary_planned")).alias("planned_activities"), "file_name",
    )


def summary(tables: Tables, plan: Plan) -> DataFrame:
    """The summary of the newest report that the question means."""
    newest = tables["reports"].where(_all(_reports(plan))).orderBy(F.desc_nulls_last("period_end"), "report_id").limit(1).join(_files(tables), "document_id")
    operations = tables["operations"].join(newest.select("report_id"), "report_id", "left_semi")
    return daily_summary(newest.select("report_id", "wellbore", "period_start", "period_end", "summary_activities", "summary_planned", "file_name"), operations)


def activity_analysis(tables: Tables, plan: Plan) -> DataFrame:
    """Hours of each activity in the reports that the question means, by file."""
    rows = tables["operations"].join(tables["reports"].where(_all(_reports(plan))).select("report_id", "wellbore", "period_end"), "report_id").join(_files(tables), "document_id")
    hours = python_round(F.sum("hours"), 2)
    return rows.groupBy("main_activity", "file_name").agg(F.coalesce(hours, F.lit(0.0)).alias("hours"), F.min("page_number").alias("page_number")).orderBy(F.desc("hours"), "main_activity", "file_name")


def count_aggregation(tables: Tables, plan: Plan) -> DataFrame:
    """Operations and hours of each activity and well; of failed ones if the question is about failing."""
    rows = tables["operations"].join(tables["reports"].select("report_id", "wellbore"), "report_id")
    if "fail" in plan.question.casefold():
        return rows.where("state = 'fail'").groupBy("wellbore").agg(F.count("*").alias("operations")).orderBy(F.desc("operations"), "wellbore").limit(min(plan.limit * 5, 100))
    rows = rows.where("main_activity is not null").groupBy("main_activity", "wellbore").agg(F.count("*").alias("operations"), F.coalesce(python_round(F.sum("hours"), 2), F.lit(0.0)).alias("hours"))
    return rows.orderBy(F.desc("operations"), "main_activity", "wellbore").limit(min(plan.limit * 5, 100))


def anomaly_candidates(tables: Tables, plan: Plan) -> DataFrame:
    """Candidates by detector, category, severity and status; only validated ones if that is asked."""
    rows = tables["anomalies"]
    if any(x in plan.question.casefold() for x in ("validated", "confirmed")):
        rows = rows.where("domain_validated")
    return rows.groupBy("detector_type", "category", "severity", "validation_status").agg(F.count("*").alias("candidates")).orderBy(F.desc("candidates"), "detector_type", "category", "severity", "validation_status")


def equipment_failures(tables: Tables, plan: Plan) -> DataFrame:
    """Failures with the operations that they are matched to, and where they are from."""
    rows = tables["equipment_failures"].alias("f").join(tables["reports"].alias("r"), F.col("f.report_id") == F.col("r.report_id")).join(_files(tables).alias("d"), F.col("f.document_id") == F.col("d.document_id"))
    if plan.wellbore:
        rows = rows.where(F.col("r.wellbore") == plan.wellbore)
    names = [e for e in plan.equipment if e != "equipment failure"]
    if names:
        hit = F.lit(False)
        for name in names:
            for column in ("f.equipment", "f.system_class", "f.remark"):
                hit = hit | F.col(column).ilike(f"%{name}%")
        rows = rows.where(hit)
    rows = rows.join(tables["failure_operation_matches"].alias("m"), F.col("f.failure_id") == F.col("m.failure_id"), "left").join(tables["operations"].alias("o"), F.col("m.operation_id") == F.col("o.operation_id"), "left")
    operation = F.when(F.col("o.operation_id").isNotNull(), F.struct(F.concat_ws(":", F.lit("operation"), F.col("o.operation_id").cast("string")).alias("id"), "o.main_activity", "o.sub_activity", "o.remark", "o.page_number"))
    shown = rows.select(
        F.col("f.failure_id").alias("failure_id"), F.concat_ws(":", F.lit("equipment_failure"), F.col("f.failure_id").cast("string")).alias("evidence_id"), "r.wellbore", iso(F.col("f.start")).alias("start"), "f.equipment", "f.system_class", "f.downtime_minutes",
        "f.remark", F.coalesce("m.status", F.lit("unmatched")).alias("match_status"), "m.confidence", operation.alias("operation"), citation(F.col("d.file_name"), F.col("f.page_number"), F.lit("equipment failures")).alias("citation"),
    )
    return shown.orderBy(F.desc_nulls_last("start"), "wellbore", "failure_id").limit(FAILURE_LIMIT)


def plot_facts(tables: Tables, plan: Plan) -> DataFrame:
    """Measured points left of their MIN curve."""
    points = tables["plot_points"].where("band_classification = 'below_min'").join(tables["plots"], "plot_id").join(_files(tables), "document_id")
    return points.select("plot_id", "plot_identifier", "point_index", "x_value", "y_value", "band_classification", "file_name").orderBy("plot_identifier", "point_index", "plot_id")


def plot_trends(tables: Tables, plan: Plan) -> DataFrame:
    """The robust trend of each series of dated points; points as they are, without a unit gate."""
    points = tables["plot_points"].where("observed_date is not null and y_value is not null").join(tables["plots"].where("plot_type = 'pressure_time'").select("plot_id", "plot_identifier"), "plot_id")
    by = ["plot_identifier", "series_identifier"]
    series = points.select(*by, day_number(F.col("observed_date")).cast("double").alias("x"), F.col("y_value").alias("y"))
    return trend.theil_sen(series, by).join(trend.spearman(series, by), by).where(F.col("n") >= trend.MIN_POINTS).orderBy(*by)


HANDLERS: dict[str, Handler] = {
    "identity_mapping": identity_mapping, "report_lookup": report_lookup, "daily_summary": summary, "activity_analysis": activity_analysis,
    "count_aggregation": count_aggregation, "compare_wellbores": count_aggregation, "anomaly_candidates": anomaly_candidates,
    "equipment_failures": equipment_failures, "plot_facts": plot_facts, "plot_trends": plot_trends,
}


@dataclass(frozen=True)
class Answer:
    """The rows of an answer and how they were found."""

    route: str
    rows: list
    seconds: float


def answer(spark: SparkSession, tables: Tables, plan: Plan, audit_path: str | None = None, index_path: str | None = None, sections: tuple[str, ...] = ()) -> Answer:
    """Rows by the plan's handler, or by retrieval if there is none or it finds nothing; logged to the audit.

    The index of the corpus lies in ``index_path`` and serves all questions until the chunks change.
    """
    began = time.time()
    handler = HANDLERS.get(plan.intent)
    rows, route = (handler(tables, plan).limit(FAILURE_LIMIT).collect(), f"structured_{plan.intent}") if handler else ([], "")
    if not rows and plan.intent != "unsupported_out_of_corpus":
        rows, found = Retriever(tables["retrieval_chunks"], index_path or index_folder(spark)).search(plan, sections)
        if found.status == "not_backfilled":
            return Answer(found.status, [], time.time() - began)
        route = "retrieval" if rows else "not_found_corpus"
    route = route or "not_found_corpus"
    took = time.time() - began
    if audit_path:
        log_query(spark, audit_path, route, plan.question, "", len(rows), took)
    return Answer(route, rows, took)
