from __future__ import annotations

import math
import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from fieldspar.functions import scores, text
from fieldspar.operators import facets, textclass
from fieldspar.plans import grounding, providers, retriever
from fieldspar.plans.planner import Plan
from fieldspar.sources import readers, schemas, sinks
from fieldspar.streaming import jobs


def test_python_round(spark):
    rng = random.Random(3)
    values = [2.675, 0.125, 0.375, -0.125, 1.005, -2.5, 1e300, 4503599627370497.5, 0.0, math.inf, 5e-324]
    values += [rng.randrange(-10**6, 10**6) / 1000 for _ in range(2000)] + [rng.uniform(-1e9, 1e9) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (0, 2, 3, 4):
        for v, got in df.select("v", scores.python_round(F.col("v"), digits)).collect():
            assert got == round(v, digits), (v, digits)
    odd = spark.createDataFrame([(None,), (math.nan,)], "v double").select(scores.python_round(F.col("v"), 2).alias("r")).collect()
    assert odd[0].r is None and math.isnan(odd[1].r)


def test_small_functions(spark):
    one = spark.range(1)
    near = one.select(*(scores.color_near(F.lit(r), F.lit(20), F.lit(30), (10, 20, 30), 5).alias(f"c{r}") for r in (10, 15, 16))).first()
    assert tuple(near) == (True, True, False)
    shas = spark.createDataFrame([(" ABCDEF0123456789 ",), ("xyz",), ("abc",), (None,)], "s string").select(text.short_sha(F.col("s")).alias("s")).collect()
    assert [r.s for r in shas] == ["abcdef012345", "unknown", "unknown", "unknown"]
    maps = spark.createDataFrame([({"a": 1, "b": 2}, {"b": 3, "c": 4}), (None, {"a": 1}), ({"a": 1}, None)], "x map<string,int>, y map<string,int>")
    assert [r[0] for r in maps.select(text.merged(F.col("x"), F.col("y"))).collect()] == [{"a": 1, "b": 3, "c": 4}, {"a": 1}, {"a": 1}]


def test_facets(spark):
    rows = spark.createDataFrame([("rule", "high"), ("ml", "high"), ("ml", None)], "detector string, severity string")
    assert rows.where(facets.chosen({"detector": "ml", "severity": "all"})).count() == 2
    assert rows.where(facets.chosen({"detector": "ml", "severity": "high"})).count() == 1
    assert {tuple(r) for r in facets.facet_values(rows, ["detector", "severity"]).collect()} == {("detector", "rule", 1), ("detector", "ml", 2), ("severity", "high", 2)}
    reports = spark.createDataFrame([(i, 10 + i) for i in range(6)], "report_id long, document_id long")
    failing = spark.createDataFrame([(4,), (4,), (5,), (3,)], "report_id long")
    picked = facets.representative_sources(reports, failing, reports, 4).collect()
    assert [tuple(r) for r in picked] == [(13, "failure"), (14, "failure"), (10, "operation"), (11, "operation")]


def test_localized(spark):
    rows = [
        ("x", "hybrid_summary", "az", {"wellbore": "W", "operation_count": "3", "summary_planned": "P"}, 1), ("x", "hybrid_summary", "en", {}, 1), ("x", "plot_sql", "az", {}, 2),
        ("x", "hybrid_mapping", "az", None, 0), ("1 2 3 4 5 6 7", "structured_failure_activity", "az", None, 1), ("There is no such fact", "other", "az", None, 0), ("fine", "other", "az", None, 0),
    ]
    df = spark.createDataFrame(rows, "answer string, route string, language string, facts map<string,string>, n int")
    got = [r[0] for r in df.select(grounding.localized(F.col("answer"), F.col("route"), F.col("language"), F.col("facts"), F.col("n"))).collect()]
    assert got[0].startswith("W üçün tarixi məlum olmayan dövr tarixli DDR-də 3 ") and got[0].endswith("Planlaşdırılan fəaliyyət: P") and "Mənbə" not in got[0]
    assert got[1] == "x" and " 2 ölçülmüş" in got[2] and got[3] == grounding.NO_MAPPING_AZ and got[4].startswith("1 doldurulmuş") and "3 hesabatdan 2-də" in got[4]
    assert got[5] == grounding.UNKNOWN_AZ and got[6] == "fine"


def test_retriever(spark, tmp_path):
    names = "chunk_key string, source_type string, document_id long, wellbore string, period_end timestamp_ntz, section_type string, searchable_text string"
    rows = [(f"k{i}", "operation", i, "W1" if i % 2 else "W2", datetime(2008, 6, 1 + i), "bit" if i < 3 else "mud", f"plain words about part{i} of the work") for i in range(6)]
    chunks = schemas.conform(spark.createDataFrame([*rows, ("r", "section", 9, "W1", datetime(2008, 6, 20), "mud", "Résumé of torque losses")], names), "retrieval_chunks")
    find = lambda *terms, sections=(), **k: found.search(Plan("q", "en", "en", "", 0.0, terms=list(terms), **k), sections)
    found = retriever.Retriever(chunks, str(tmp_path))
    hits, about = find("resume", "torque")
    assert [h.chunk_key for h in hits] == ["r"] and about.stage == 1 and about.candidates == 7 and about.source_types == ("section",) and about.build_seconds > 0
    assert [h.chunk_key for h in find("part2", sections=("bit",))[0]] == ["k2", "k1", "k0"]  # the section alone lifts a chunk over the threshold
    hits, about = find("part4", sections=("none",))
    assert about.stage == 2 and hits[0].chunk_key == "k4"  # no chunk has the section, so the second stage leaves it out
    assert find("torque", wellbore="W2")[1].candidates == 3
    hits, _ = find("work", date_from=date(2008, 6, 3), latest_first=True, limit=2)
    assert [h.chunk_key for h in hits] == ["k5", "k4"]
    again = retriever.Retriever(chunks.repartition(3), str(tmp_path))
    assert again.fingerprint == found.fingerprint and again.search(Plan("q", "en", "en", "", 0.0, terms=["torque"]))[1].build_seconds == 0
    assert retriever.lexical_search(chunks, "torque losses", 3, str(tmp_path))[0].chunk_key == "r"
    assert retriever.Retriever(chunks.limit(0), str(tmp_path)).search(Plan("q", "en", "en", "", 0.0, terms=["x"]))[1].status == "not_backfilled"


def test_admit_questions(spark, tmp_path):
    at = lambda s: datetime(2024, 1, 1, 0, 0, s)
    rows = [("a", 1, at(0), "q"), ("a", 2, at(0), "q"), ("a", 3, at(2), "x" * 30), ("a", 4, at(3), "q"), ("a", 5, at(9), None), ("b", 6, at(1), "q")]
    schema = "session_id string, question_id long, asked_at timestamp, question string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    verdicts = jobs.admit_questions(jobs.stream(spark, str(tmp_path / "in"), schema), quota=2, cooldown=1.0, longest=20)
    query = verdicts.writeStream.format("memory").queryName("verdicts").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r.question_id: r.verdict for r in spark.table("verdicts").collect()} == {1: "admitted", 2: "cooldown", 3: "too_long", 4: "admitted", 5: "quota", 6: "admitted"}


def test_persist_reports(spark, tmp_path):
    root = str(tmp_path)
    ddl = "document_id long, report struct<wellbore:string>, operations array<struct<page_number:int,remark:string>>, pages array<struct<page_number:int,raw_text:string>>"
    sinks.persist_reports(spark.createDataFrame([(1, ("W",), [(1, "a"), (1, "b")], [(1, "t")]), (2, ("V",), [(1, "c")], [])], ddl), root)
    sinks.persist_reports(spark.createDataFrame([(1, ("W2",), [], [(1, "u")])], ddl), root)
    read = lambda name: spark.read.parquet(f"{root}/{name}")
    assert {(r.report_id, r.wellbore) for r in read("reports").collect()} == {(1, "W2"), (2, "V")}
    assert [(r.operation_id, r.report_id, r.remark) for r in read("operations").collect()] == [(2 << sinks.CHILD_BITS, 2, "c")]
    assert [(r.document_id, r.raw_text) for r in read("pages").collect()] == [(1, "u")]
    plot = "document_id long, plot struct<plot_type:string>, plot_points array<struct<point_index:int>>, anomalies array<struct<candidate_key:string>>"
    for _ in range(2):
        sinks.persist_plots(spark.createDataFrame([(7, ("pressure_time",), [(0,), (1,)], [("k",)])], plot), root)
    assert (read("plots").count(), read("plot_points").count(), read("anomalies").count()) == (1, 2, 1)


def test_rebuild_version(spark, tmp_path):
    ddl, path = "candidate_key string, model_version string, score double", str(tmp_path / "a")
    sinks.rebuild_version(spark.createDataFrame([("a", "1", 1.0), ("b", "2", 2.0), ("c", None, 3.0)], ddl), path, "1")
    sinks.rebuild_version(spark.createDataFrame([("b", "1", 9.0), ("d", "1", 4.0), ("d", "1", 4.0)], ddl), path, "1")
    assert {tuple(r) for r in spark.read.parquet(path).collect()} == {("b", "2", 2.0), ("c", None, 3.0), ("d", "1", 4.0)}


def test_coverage(spark):
    pages = spark.createDataFrame([(1, 2), (2, 2), (3, None)], "document_id long, page_count int")
    assert {tuple(r) for r in facets.page_histogram(pages).collect()} == {(2, 2), (None, 1)}
    reports = spark.createDataFrame([(1,), (2,), (3,), (4,)], "report_id long")
    sections = spark.createDataFrame([(1, "bit"), (1, "bit"), (2, "bit"), (4, "mud"), (9, "mud")], "report_id long, section_type string")
    assert {tuple(r) for r in facets.section_coverage(reports, sections).collect()} == {("bit", 2, 0.5), ("mud", 1, 0.25)}


def test_csv_mark(spark, tmp_path):
    sinks.csv_report(spark.sql("select 1 as a"), str(tmp_path / "c"), spark.sql("select 2 as b"))
    (file,) = (tmp_path / "c").glob("*.csv")
    assert file.read_bytes().startswith(b"\xef\xbb\xbfa,b")


def test_archives(spark, tmp_path):
    import zipfile

    for name, entry in (("good", "d/x.txt"), ("bad", "../x.txt")):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            z.writestr(entry, "hello")
    got = readers.archive_contents(spark, f"{tmp_path}/*.zip").collect()
    assert [(r.entry, bytes(r.content)) for r in got] == [("d/x.txt", b"hello")]
    frame = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    state = readers.bootstrap_state(frame([("a", "1", 2), ("b", "1", 2), ("c", "1", 2), ("d", "1", 2)], "name string, sha256 string, files long"), frame([("a", "2"), ("b", "1")], "name string, sha256 string"), frame([("b", 1), ("c", 2)], "name string, files long"))
    assert dict(state.collect()) == {"a": "different_hash", "b": "partial_extraction", "c": "complete", "d": "extract"}


@pytest.mark.parametrize("is_promoted", [True, False])
def test_model_artefact(spark, tmp_path, is_promoted):
    train = spark.createDataFrame([("drill ahead", "drilling"), ("trip out", "tripping")] * 6, "t string, l string")
    model = textclass.fit_classifier(train, "t", "l", iterations=5)
    textclass.save_classifier(model, str(tmp_path / "m"), version="v1", is_promoted=is_promoted)
    loaded = textclass.load_classifier(spark, str(tmp_path / "m"), "v1")
    assert (loaded is not None) == is_promoted and textclass.load_classifier(spark, str(tmp_path / "none")) is None
    if loaded:
        assert {r.predicted for r in textclass.classify(train, "t", loaded, 0.5).collect()} == {"drilling", "tripping"}
        assert textclass.load_classifier(spark, str(tmp_path / "m"), "v2") is None
        part = next((tmp_path / "m" / "model").rglob("part-00000*"))
        part.write_bytes(part.read_bytes() + b" ")
        (part.parent / f".{part.name}.crc").unlink(missing_ok=True)
        assert textclass.load_classifier(spark, str(tmp_path / "m"), "v1") is None


def test_providers():
    fallback = providers.choose([])
    assert not fallback.health().available and providers.worded(fallback, "two reports", []) == ("two reports", "deterministic")
    with pytest.raises(providers.ProviderError):
        fallback.describe_image(b"", mime_type="image/png", prompt="what")

    class Echo(providers.Fallback):
        def health(self):
            return providers.Health(True)

        def chat(self, messages, *, schema=None, limit=None):
            return messages[0]["text"]

    echo = Echo(name="echo")
    assert providers.choose([fallback, echo]) is echo
    assert providers.worded(echo, "two", [{"text": "deux"}]) == ("deux", "echo") and providers.worded(echo, "two", [{"text": " "}]) == ("two", "deterministic")


def test_classifier_weights(spark):
    texts = ["drill ahead ahead", "drill pipe", "trip out", "trip pipe", "drill on"]
    train = spark.createDataFrame([(t, t.split()[0]) for t in texts], "t string, l string")
    pipeline, _ = textclass.fit_classifier(train, "t", "l", words=3, iterations=5)
    counter, smooth = pipeline.stages[1:3]
    assert set(counter.vocabulary) == {"drill", "trip", "pipe"}  # the only words in two texts or more
    wanted = {w: math.log(6 / (1 + sum(w in t.split() for t in texts))) + 1 for w in counter.vocabulary}
    assert dict(zip(counter.vocabulary, smooth.getScalingVec().toArray(), strict=True)) == pytest.approx(wanted)
