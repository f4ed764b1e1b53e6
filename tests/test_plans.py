from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from fieldspar.plans import grounding, handlers, planner, sql_guard
from fieldspar.sources import schemas


@pytest.mark.parametrize(("question", "intent"), [
    ("How many operations failed by wellbore?", "count_aggregation"), ("compare activities", "compare_wellbores"), ("pressure trend", "plot_trends"), ("pressure now", "plot_facts"),
    ("current oil price", "unsupported_out_of_corpus"), ("son xəbər", "unsupported_out_of_corpus"), ("top drive breakdown", "equipment_failures"), ("hello", "narrative_corpus_search"),
])
def test_intents(question, intent):
    assert planner.analyze(question).intent == intent


def test_follow_up():
    history = [{"role": "user", "content": "Reports of 15/9-F-4 on 2008-01-02"}, {"role": "assistant", "content": "..."}]
    p = planner.analyze("what about its planned activities", history)
    assert p.follow_up and p.wellbore == "15/9-F-4" and p.date_from == date(2008, 1, 2) and p.intent == "report_lookup"
    assert not planner.analyze("what about its planned activities").follow_up


@pytest.mark.parametrize("sql", ["DELETE FROM reports", "SELECT 1; SELECT 2", "SELECT * FROM other", "CREATE TABLE x AS SELECT 1", "SELECT id FROM reports WHERE id IN (SELECT id FROM other)"])
def test_guard_refuses(spark, sql):
    with pytest.raises(sql_guard.Refused):
        sql_guard.guard(spark, sql, {"reports", "operations"})


def test_guard_limits(spark):
    assert sql_guard.guard(spark, "SELECT id FROM reports LIMIT 99999", {"reports"}, most=100).limit == 100
    assert sql_guard.guard(spark, "SELECT id FROM reports", {"reports"}).limit == 200
    assert sql_guard.guard(spark, "SELECT r.id AS x FROM reports r ORDER BY x", {"reports"}, {"id"}).tables == {"reports"}
    for sql in ("SELECT * FROM reports", "SELECT secret FROM reports"):
        with pytest.raises(sql_guard.Refused):
            sql_guard.guard(spark, sql, {"reports"}, {"id"})


def test_grounding(spark):
    row = ("There were 999 failures.", "structured", 1, 1, 0, False, ["report.pdf"], '[{"failure_count": 2}]', "There were 2 failures.")
    schema = "answer string, route string, n_rows long, n_evidence long, unresolved long, unit_unknown boolean, files array<string>, facts string, deterministic string"
    r = grounding.verify(spark.createDataFrame([row], schema)).first()
    assert (r.rejection, r.shown) == ("unsupported_number", "There were 2 failures.")


@pytest.fixture(scope="module")
def tables(spark):
    def fill(name, *rows):
        base = schemas.empty(spark, name)
        return base.unionByName(spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"{k} {base.schema[k].dataType.simpleString()}" for k in rows[0])), allowMissingColumns=True) if rows else base

    start = datetime(2008, 6, 13)
    known = {
        "source_documents": fill("source_documents", {"document_id": 1, "sha256": "a" * 64, "file_name": "report.pdf"}),
        "reports": fill("reports", {"report_id": 1, "document_id": 1, "wellbore": "15/9-F-14", "period_start": start, "period_end": datetime(2008, 6, 14), "summary_activities": "Drilled ahead.", "summary_planned": "Circulate clean."}),
        "operations": fill("operations", {"operation_id": 1, "report_id": 1, "document_id": 1, "page_number": 1, "row_index": 0, "hours": 1.0, "main_activity": "drilling", "sub_activity": "drill", "state": "fail", "remark": "Test evidence"}),
        "equipment_failures": fill("equipment_failures", {"failure_id": 1, "report_id": 1, "document_id": 1, "page_number": 1, "start": datetime(2008, 6, 13, 23), "equipment": "top drive", "system_class": "hoisting equipment", "downtime_minutes": 15.0}),
        "failure_operation_matches": fill("failure_operation_matches", {"failure_id": 1, "operation_id": 1, "status": "exact", "confidence": 0.98}),
        "anomalies": fill("anomalies", {"anomaly_id": 1, "category": "unusual_operation_duration", "severity": "high", "detector_type": "ml", "validation_status": "candidate", "domain_validated": False}, {"anomaly_id": 2, "category": "operational_weak_signal", "severity": "medium", "detector_type": "rule", "validation_status": "confirmed", "domain_validated": True}),
        "plots": fill("plots", {"plot_id": 1, "document_id": 1, "plot_type": "pressure_time", "plot_identifier": "P1"}),
        "plot_points": fill("plot_points", *({"point_id": i, "plot_id": 1, "point_index": i, "series_identifier": "s", "y_value": 100.0 + 10 * i, "observed_date": date(2026, 1, i + 1), "band_classification": "below_min" if i == 0 else None} for i in range(4))),
        "retrieval_chunks": fill("retrieval_chunks", {"chunk_key": "a", "source_type": "report_section", "document_id": 1, "wellbore": "15/9-F-14", "period_end": datetime(2008, 6, 14), "searchable_text": "Mud weight 1.20 sg in the drilling fluid"}, {"chunk_key": "b", "source_type": "operation", "document_id": 1, "wellbore": "15/9-F-14", "period_end": datetime(2008, 6, 14), "searchable_text": "Tripped out of hole"}),
    }
    return {name: known.get(name, schemas.empty(spark, name)) for name in schemas.SCHEMAS}


@pytest.mark.parametrize(("question", "route", "n"), [
    ("How many operations by wellbore?", "structured_count_aggregation", 1), ("How many failed operations by wellbore?", "structured_count_aggregation", 1), ("daily summary for 15/9-F-14", "structured_daily_summary", 1),
    ("planned activities of 15/9-F-14 on 2008-06-14", "structured_report_lookup", 1), ("top drive failures", "structured_equipment_failures", 1), ("Show anomalies", "structured_anomaly_candidates", 2), ("confirmed anomaly list", "structured_anomaly_candidates", 1),
    ("pressure trend", "structured_plot_trends", 1), ("pressure below MIN", "structured_plot_facts", 1), ("main activity on 2008-06-14", "structured_activity_analysis", 1), ("mud weight of the drilling fluid", "retrieval", 1), ("current oil price", "not_found_corpus", 0), ("qwertz uiop", "not_found_corpus", 0),
])
def test_answers(spark, tables, tmp_path, question, route, n):
    got = handlers.answer(spark, tables, planner.analyze(question), str(tmp_path / "audit"))
    assert got.route == route and len(got.rows) >= n
    log = spark.read.parquet(str(tmp_path / "audit")).first()
    assert log.row_count == len(got.rows) and log.question_hash and "question" not in log.asDict()


def test_failure_row(tables):
    r = handlers.equipment_failures(tables, planner.analyze("top drive failure")).first()
    assert (r.match_status, r.operation.main_activity, r.citation, r.start) == ("exact", "drilling", "report.pdf, page 1, equipment failures", "2008-06-13T23:00:00")


def test_empty_corpus(spark, tables):
    none = tables | {"retrieval_chunks": schemas.empty(spark, "retrieval_chunks")}
    assert handlers.answer(spark, none, planner.analyze("mud weight")).route == "not_backfilled"


def test_schemas(spark):
    for name in schemas.SCHEMAS:
        assert set(schemas.KEYS.get(name, [])) <= set(schemas.empty(spark, name).columns)
    odd = spark.createDataFrame([("x", 1)], "sha256 string, other int")
    assert schemas.conform(odd, "source_documents").select(F.count("sha256")).first()[0] == 1
