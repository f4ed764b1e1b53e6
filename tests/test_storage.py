from __future__ import annotations

import json
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from fieldspar.sources import readers, sinks
from fieldspar.streaming import jobs


def test_idempotent_writes(spark, tmp_path):
    path = str(tmp_path / "candidates")
    rows = spark.createDataFrame([("op", "r", 1), ("op", "r", None), ("op", "r", None)], "kind string, rule string, id int")
    assert sinks.insert_absent(rows, path, ["kind", "rule", "id"]) == 2
    assert sinks.insert_absent(rows, path, ["kind", "rule", "id"]) == 0
    assert spark.read.parquet(path).count() == 2


def test_replace_and_upsert(spark, tmp_path):
    path = str(tmp_path / "chunks")
    rows = lambda v: spark.createDataFrame(v, "document_id long, text string")
    sinks.replace(rows([(1, "a"), (2, "b")]), path, ["document_id"])
    sinks.replace(rows([(2, "c"), (2, "d")]), path, ["document_id"])
    assert sorted(r.text for r in spark.read.parquet(path).collect()) == ["a", "c", "d"]
    runs = str(tmp_path / "runs")
    run = lambda m: spark.createDataFrame([("t", "v1", m)], "model_type string, version string, is_active boolean")
    sinks.upsert(run(False), runs, "model_runs")
    sinks.upsert(run(True), runs, "model_runs")
    assert [r.is_active for r in spark.read.parquet(runs).collect()] == [True]


def test_seed_once(spark, tmp_path):
    source, target, marks = (str(tmp_path / n) for n in ("s", "t", "m"))
    spark.range(5).write.parquet(source)
    assert sinks.copy_once(spark, source, target, "v1", marks)
    assert not sinks.copy_once(spark, source, target, "v1", marks)
    with pytest.raises(ValueError):
        sinks.copy_once(spark, source, target, "v2", marks)


def test_documents_isolate_failures(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    (tmp_path / "b.txt").write_text("bad")

    def parse(path, content):
        if content == b"bad":
            raise ValueError("no report")
        return [{"line": x} for x in content.decode().split("\n")]

    rows = {r.path.rsplit("/", 1)[1]: r for r in readers.documents(spark, str(tmp_path), parse, "line string").collect()}
    assert [x.line for x in rows["a.txt"].rows] == ["one", "two"] and rows["b.txt"].error == "ValueError: no report"


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("a.pdf", "x")
        z.writestr("A.pdf", "x")
        z.writestr("../evil.pdf", "x")
    (tmp_path / "broken.zip").write_bytes(b"no zip")
    found = {(r.archive.rsplit("/", 1)[1], r.problem) for r in readers.archive_problems(readers.archive_entries(spark, str(tmp_path / "*.zip"))).collect()}
    assert found == {("x.zip", "repeated_name"), ("x.zip", "unsafe_path"), ("broken.zip", "broken")}


def test_json_list_and_files(spark, tmp_path):
    (tmp_path / "l.json").write_text(json.dumps([{"a": 1}, {"a": 2}]))
    (tmp_path / "o.json").write_text(json.dumps({"x": {"a": 3}}))
    assert sorted(r.a for r in readers.json_list(spark, str(tmp_path / "l.json"), "a int").collect()) == [1, 2]
    assert [r.a for r in readers.json_list(spark, str(tmp_path / "o.json"), "a int").collect()] == [3]
    assert {r.kind for r in readers.files(spark, str(tmp_path), "*.json").collect()} == {"unsupported"}


def test_streams(spark, tmp_path):
    source, stored = str(tmp_path / "in"), str(tmp_path / "stored")
    rows = lambda *v: spark.createDataFrame([(x,) for x in v], "sha256 string")
    rows("a", "b", "a").write.parquet(source)
    jobs.ingest_new(jobs.stream(spark, source, "sha256 string"), stored, str(tmp_path / "c")).awaitTermination()
    rows("b", "c").write.mode("append").parquet(source)
    jobs.ingest_new(jobs.stream(spark, source, "sha256 string"), stored, str(tmp_path / "c")).awaitTermination()
    assert sorted(r.sha256 for r in spark.read.parquet(stored).collect()) == ["a", "b", "c"]


def test_status_stream(spark, tmp_path):
    source, log, status = (str(tmp_path / n) for n in ("in", "log", "status"))
    schema = "review_id long, anomaly_id long, decision string, created_at timestamp_ntz"
    put = lambda *v: spark.createDataFrame(list(v), schema).write.mode("append").parquet(source)
    put((1, 7, "confirmed", datetime(2026, 1, 1)), (2, 8, "rejected", datetime(2026, 1, 1)))
    jobs.keep_status(jobs.stream(spark, source, schema), log, status, str(tmp_path / "c")).awaitTermination()
    put((3, 7, "rejected", datetime(2026, 1, 2)))
    jobs.keep_status(jobs.stream(spark, source, schema), log, status, str(tmp_path / "c")).awaitTermination()
    assert {r.anomaly_id: r.status for r in spark.read.parquet(status).collect()} == {7: "rejected", 8: "rejected"}
    assert spark.read.parquet(log).count() == 3


def test_windows(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(datetime(2024, 1, 1, 0, m), "x") for m in (1, 2, 59)], "ts timestamp, k string").write.parquet(source)
    q = jobs.window_counts(jobs.stream(spark, source, "ts timestamp, k string"), "ts", ["k"]).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.n for r in spark.table("w").collect()] == [3]
    assert "Markdown" not in sinks.markdown(spark.range(1).select(F.lit(1).alias("a")), "T")
