from __future__ import annotations

import random
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldspar.operators import chunks, matching, plots, quality, records, robust, rules, search, summary, textclass, trend

T = datetime(2008, 6, 13, 23)
H = timedelta(hours=1)
FAILURES = "failure_id long, report_id long, start timestamp_ntz, end timestamp_ntz"
OPERATIONS = "operation_id long, report_id long, op_start timestamp_ntz, op_end timestamp_ntz, op_confidence double"


def decide(spark, failure, operations, **options):
    f = spark.createDataFrame([(1, 1, *failure)], FAILURES)
    o = spark.createDataFrame([(i, 1, a, b, 1.0) for i, (a, b) in enumerate(operations)], OPERATIONS)
    return sorted((r.status, r.operation_id, r.confidence, r.minutes) for r in matching.match_failures(f, o, **options).collect())


def test_match_decisions(spark):
    assert decide(spark, (T, None), [(T - H, T + H)]) == [("exact", 0, 0.98, 0.0)]
    assert [r[0] for r in decide(spark, (T, None), [(T - H, T + H), (T - H, T + 2 * H)])] == ["ambiguous"] * 2
    assert decide(spark, (None, None), [(T, T + H)])[0][0] == "missing_failure_time"
    assert decide(spark, (T, None), [(T, None)])[0][0] == "missing_operation_time"
    assert decide(spark, (T, None), [(T + 6 * H, T + 7 * H)]) == [("unmatched", None, 0.95, None)]
    assert decide(spark, (T, T + 2 * H), [(T + H, T + 3 * H)]) == [("overlap", 0, 0.9, None)]
    both = decide(spark, (T, T + 2 * H), [(T - H, T + H), (T + H, T + 3 * H)])
    assert [(r[0], r[1], r[2]) for r in both] == [("ambiguous", 0, 0.55), ("ambiguous", 1, 0.55)]
    assert decide(spark, (T, None), [(T + H, T + 2 * H)], tolerance_minutes=90) == [("inferred_nearest", 0, 0.5, 60.0)]
    assert [r[0] for r in decide(spark, (T, None), [(T + H, T + 2 * H), (T - 2 * H, T - H)], tolerance_minutes=90)] == ["ambiguous"] * 2
    assert decide(spark, (T, None), [(T - H, T)])[0][0] == "unmatched"  # ends are exclusive


@pytest.mark.parametrize("bucket", [600, 86400])
def test_interval_joins_against_all_pairs(spark, bucket):
    rng = np.random.default_rng(1)
    base = datetime(2024, 1, 1)
    points = [(i, int(rng.integers(3)), base + timedelta(minutes=int(rng.integers(3000)))) for i in range(80)]
    spans = [(i, int(rng.integers(3)), (a := base + timedelta(minutes=int(rng.integers(3000)))), a + timedelta(minutes=int(rng.integers(1, 600)))) for i in range(80)]
    p = spark.createDataFrame(points, "p long, k long, ts timestamp_ntz")
    s = spark.createDataFrame(spans, "s long, k long, a timestamp_ntz, b timestamp_ntz")
    got = {(r.p, r.s) for r in matching.interval_join(p, s, "k", "ts", "a", "b", bucket_seconds=bucket).collect()}
    assert got == {(x[0], y[0]) for x in points for y in spans if x[1] == y[1] and y[2] <= x[2] < y[3]}
    o = s.toDF("o", "k", "c", "d")
    found = [(r.s, r.o) for r in matching.overlap_join(s, o, "k", ("a", "b"), ("c", "d"), bucket_seconds=bucket).collect()]
    assert len(found) == len(set(found))
    assert set(found) == {(x[0], y[0]) for x in spans for y in spans if x[1] == y[1] and x[2] < y[3] and x[3] > y[2]}


def test_duration_outlier(spark):
    rows = [(i, "drilling", "drill", 24.0 if i == 99 else (1.0, 1.05, 1.1)[i % 3]) for i in range(100)]
    df = robust.fallback_groups(spark.createDataFrame(rows, "id long, main string, sub string, hours double"), "main", "sub")
    scored = robust.robust_scores(df, "hours", ["group_main", "group_sub"])
    found = robust.isolation_candidates(scored, ["group_main", "group_sub"], "id", version="v1")
    first = found.select("id", "candidate_key").collect()
    assert [r.id for r in first] == [99]
    assert first == found.select("id", "candidate_key").collect()  # a second run has the same key
    known = found.select("candidate_key")
    assert rules.not_stored(found.select("candidate_key"), known, ["candidate_key"]).count() == 0


def test_fallback_groups(spark):
    rows = [(i, "m", "big") for i in range(30)] + [(i, "m", "small") for i in range(5)] + [(i, "m", None) for i in range(40)]
    out = robust.fallback_groups(spark.createDataFrame(rows, "id long, main string, sub string"), "main", "sub")
    assert {(r.sub, r.group_sub) for r in out.collect()} == {("big", "big"), ("small", "*"), (None, "*")}


def observations(spark, values, unit="sg", days=None):
    rows = [("p", date(2026, 1, d), float(v), unit, True, None) for d, v in zip(days or range(1, 99), values, strict=False)]
    return spark.createDataFrame(rows, "series string, observed_at date, value double, unit string, included boolean, exclusion_reason string")


@pytest.mark.parametrize(("values", "direction", "slope"), [([1, 2, 3, 4, 5], "increasing", 1.0), ([5, 4, 3, 2, 1], "decreasing", -1.0), ([2] * 5, "stable_or_uncertain", 0.0)])
def test_trend_directions(spark, values, direction, slope):
    r = trend.parameter_trend(observations(spark, values), ["series"]).first()
    assert (r.applicable, r.direction, r.slope) == (True, direction, slope)
    assert r.p == pytest.approx(0.0 if slope else 1.0, abs=1e-9)


def test_trend_gates(spark):
    assert not trend.parameter_trend(observations(spark, [1, 2, 3]), ["series"]).first().applicable
    mixed = observations(spark, [1, 2, 3, 4]).union(observations(spark, [5], "ppg"))
    assert trend.parameter_trend(mixed, ["series"]).first().reason.startswith("Known units are mixed")
    twice = observations(spark, [1, 2.0, 2.2, 3, 4], days=[1, 2, 2, 3, 4])
    assert trend.parameter_trend(twice, ["series"]).first().n == 4


def test_spearman_p(spark):
    rows = [("s", float(x), float(y)) for x, y in zip(range(8), [1, 3, 2, 5, 4, 8, 6, 7], strict=True)]
    r = trend.spearman(spark.createDataFrame(rows, "k string, x double, y double"), ["k"]).first()
    assert r.rho == pytest.approx(0.8809523809) and r.p == pytest.approx(0.00385, abs=2e-4)


def test_summary(spark):
    reports = spark.createDataFrame([(1, "15/9-F-14", None, None, "Drilled ahead.", "n/a", "report.pdf")], "report_id long, wellbore string, period_start timestamp_ntz, period_end timestamp_ntz, summary_activities string, summary_planned string, file_name string")
    ops = [(1, 10, 0, 100.0, 2.0, "drilling", "ok", 1), (1, 11, 1, None, None, None, "fail", 1), (1, 12, 2, 130.5, 2.0, "moving", "ok", 2)]
    operations = spark.createDataFrame(ops, "report_id long, operation_id long, row_index int, depth double, hours double, main_activity string, state string, page_number int")
    r = summary.daily_summary(reports, operations).first()
    assert (r.operation_count, r.fail_operation_count, r.main_activity, r.progress, r.total_hours) == (3, 1, "drilling", 30.5, 4.0)
    assert r.hours_by_activity == {"drilling": 2.0, "moving": 2.0, "unknown": 0.0} and r.summary_planned is None
    assert [c.operation_id for c in r.cited_operations] == [10, 11, 12]


def test_reviews(spark):
    t0 = datetime(2026, 1, 1)
    log = [(1, 7, "needs_more_evidence", t0), (2, 7, "confirmed", t0 + H), (3, 7, "rejected", t0 + 2 * H), (4, 8, "confirmed", t0), (5, 8, "confirmed", t0)]
    df = spark.createDataFrame(log, "review_id long, anomaly_id long, decision string, created_at timestamp_ntz")
    assert {r.anomaly_id: (r.status, r.domain_validated) for r in records.effective_status(df).collect()} == {7: ("rejected", False), 8: ("confirmed", True)}
    assert {r.anomaly_id: r.decisions for r in records.history(df).collect()}[7] == ["needs_more_evidence", "confirmed", "rejected"]


def test_merges(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (2, "d"), (3, None)], "k int, v string")
    assert sorted(map(tuple, records.replace_by_key(old, new, ["k"]).collect()), key=str) == [(1, "a"), (2, "c"), (2, "d"), (3, None)]
    merged = records.merge_by_key(old, new.where("v = 'd' or v is null"), ["k"]).collect()
    assert sorted(map(tuple, merged), key=str) == [(1, "a"), (2, "d"), (3, None)]
    diff = records.changed(old, spark.createDataFrame([(1, "unknown"), (2, "z")], "k int, v string"), "k", ["v"]).collect()
    assert [tuple(r) for r in diff] == [(2, "b", "z")]
    runs = spark.createDataFrame([("p", d) for d in (1, 2, 3, 7, 8, 3)], "g string, d long")
    assert sorted((r.first, r.last, r.n) for r in records.islands(runs, ["g"], "d").collect()) == [(1, 3, 3), (7, 8, 2)]


def test_rule_candidates(spark):
    rows = [(1, "fail", "repair", "x", 1.0), (2, "ok", None, "had LOST circulation here", 1.0), (3, None, None, None, None), (4, "ok", "drill", "", -1.0)]
    df = spark.createDataFrame(rows, "operation_id long, state string, sub_activity string, remark string, hours double")
    got = {(r.rule, r.record_id) for r in rules.operation_candidates(df).collect()}
    assert got == {("operation_state_fail", 1), ("operation_repair", 1), ("operation_lost_circulation", 2), ("negative_operation_duration", 4)}
    stored = rules.operation_candidates(df)
    assert rules.not_stored(rules.operation_candidates(df), stored, ["record_type", "rule", "record_id"]).count() == 0


def test_sections_and_budget(spark):
    pages = spark.createDataFrame([(1, "intro\nOPS\na\nb\nFLUID\nc")], "doc long, text string")
    s = chunks.split_sections(chunks.lines(pages, ["doc"], "text"), ["doc"], ["line_no"], "line", F.when(F.col("line").rlike("^[A-Z]+$"), F.col("line")))
    assert [(r.heading, r.text) for r in s.orderBy("section_no").collect()] == [(None, "intro"), ("OPS", "OPS\na\nb"), ("FLUID", "FLUID\nc")]
    ranked = spark.createDataFrame([(1, i, n) for i, n in enumerate([4000, 2000, 2000, 10])], "g int, place_in int, n int")
    kept = chunks.within_budget(ranked, ["g"], [F.asc("place_in")], "n")
    assert sorted(r.place_in for r in kept.collect()) == [0, 1]  # a prefix: the small one after the cut is out


def test_two_stage_search(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["mud weight 1.20 sg", "top drive stopped drilling", "drilling ahead drilling", "circulate hole clean", "drilled drillers drill"])], "id long, text string")
    queries = spark.createDataFrame([(1, "top drive"), (2, "drillin"), (3, "zzzz")], "q long, text string")
    hits = search.two_stage(docs, "id", "text", queries, "q", "text").collect()
    best = max((r for r in hits if r.q == 1), key=lambda r: r.score)
    assert (best.id, best.stage) == (1, 1)
    assert {r.stage for r in hits if r.q == 2} == {2} and not [r for r in hits if r.q == 3]


@pytest.mark.parametrize("words, chars, pairs", [(25_000, 12_000, 200_000), (60, 90, 200_000), (60, 90, 0)])
def test_two_stage_search_holds_no_scores_or_grams(spark, monkeypatch, words, chars, pairs):
    for name, most in (("WORD_CAP", words), ("CHAR_CAP", chars), ("PAIRS", pairs), ("DOCS", 7), ("BLOCK", 3), ("QUERIES", 2)):
        monkeypatch.setattr(search, name, most, raising=False)
    draw = random.Random(7)
    vocabulary = [*"mud drill drilling pump Quyu əsas Zürich naïve İstanbul x 𝒳y वजन a_b 12 rig rigs top drive weight hole bit".split(), *(f"w{i}" for i in range(60))]
    rows = [(i // 2 if i < 20 else i, " ".join(draw.choice(vocabulary[: 1 + draw.randrange(len(vocabulary))]) for _ in range(draw.randrange(90)))) for i in range(90)]
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (902, "...")], "id long, text string").repartition(3)
    asked = [(1, "top drive"), (2, "drillin urich"), (3, "zzzz"), (4, "quyu esas mud"), (5, "rilli"), (6, None), (7, "mu dr w5")]
    queries = spark.createDataFrame(asked, "q long, text string")

    def by_joins():
        n = docs.count()
        first, second = (
            search.cosine(index := search.build_index(counts(docs, "id", "text"), "id", n, cap=cap, min_df=least), "id", search.query_vector(index, counts(queries, "q", "text"), "q"), "q").collect()
            for counts, cap, least in ((search.word_counts, words, 1), (search.char_counts, chars, search.CHAR_MIN_DF))
        )
        w, c = ({(r.q, r.id): r.score for r in x} for x in (first, second))
        strong = {k: (s, 1) for k, s in w.items() if s >= search.WORD_LEAST}
        open_ = {q for q, _ in asked} - {q for q, _ in strong}
        blend = {k: search.BLEND * w.get(k, 0) + (1 - search.BLEND) * c.get(k, 0) for k in {*w, *c} if k[0] in open_}
        return strong | {k: (s, 2) for k, s in blend.items() if s >= search.BLEND_LEAST}

    expected = by_joins()
    spark.catalog.clearCache()
    out = search.two_stage(docs, "id", "text", queries, "q", "text")
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()  # scores of all pairs of a text and a query are many times the input
    got = {(r.q, r.id): (r.score, r.stage) for r in out.collect()}
    assert got.keys() == expected.keys() and {s for _, s in got.values()} == {1, 2}
    assert all(got[k] == (pytest.approx(s, abs=1e-12), stage) for k, (s, stage) in expected.items())
    best = search.two_stage(docs, "id", "text", queries, "q", "text", most=3).collect()
    for q in {q for q, _ in expected}:
        order = sorted((-round(s, 6), k) for (own, k), (s, _) in expected.items() if own == q)
        assert sorted((-round(r.score, 6), r.id) for r in best if r.q == q)[:3] == order[:3]


def test_text_classes(spark):
    rows = [("a", "x", 1), ("a", "y", 2), ("b", "y", 3), ("b", "x", 4), ("b", "x", 5)]
    best = textclass.majority_labels(spark.createDataFrame(rows, "t string, l string, i long"), "t", ["l"], "i")
    assert {r.t: (r.l, r.votes, r.row_id) for r in best.collect()} == {"a": ("x", 1, 1), "b": ("x", 2, 4)}
    pairs = spark.createDataFrame([("p", "p", 3), ("p", "q", 1), ("q", "q", 2), ("r", "q", 1)], "actual string, predicted string, n long")
    m = textclass.overall_metrics(pairs).first()
    assert m.accuracy == pytest.approx(5 / 7) and m.macro_f1 == pytest.approx((6 / 7 + 2 / 3 + 0) / 3)
    assert [(r.actual, r.predicted) for r in textclass.confusion_pairs(pairs).collect()] == [("p", "q"), ("r", "q")]
    groups = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(20)], "g long, label string")
    train, test = textclass.grouped_split(groups, "g")
    assert train.count() + test.count() == 20 and textclass.leaked_groups(train, test, "g").isEmpty()
    chosen = spark.range(1).select(textclass.precedence(F.lit("unknown"), F.lit(None).cast("string"), F.lit("drill"), F.lit(0.9)).alias("p")).first().p
    assert (chosen.label, chosen.origin, chosen.confidence) == ("drill", "model", 0.9)


def test_classifier_learns(spark):
    rows = [(i, f"{'drilling ahead hole' if i % 2 else 'moving the rig away'} {i % 7}", "drill" if i % 2 else "move") for i in range(60)]
    df = spark.createDataFrame(rows, "i long, t string, l string")
    model = textclass.fit_classifier(df, "t", "l", iterations=15)
    out = textclass.classify(df, "t", model, 0.5)
    assert out.where("predicted = l").count() == 60
    assert textclass.classify(df, "t", model, 1.1).where("predicted <> 'unknown'").isEmpty()
    labels = spark.createDataFrame([("drill",), ("move",), ("moving",)], "l string")
    assert textclass.keyword_baseline(df, "i", "t", labels.withColumnRenamed("l", "name"), "name", "none").where("l = 'move'").first().predicted == "moving"


@pytest.mark.parametrize("most", [8 << 20, 0])
def test_keyword_runs_are_never_sent(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(textclass, "LABEL_BYTES", most, raising=False)
    texts = [(i, f"The {'rig' if i % 2 else 'top drive of the old rig'}-{i}") for i in range(20)] + [(20, None), (21, ""), (22, "rig")]
    names = [("x", n) for n in ("Rig", "rig", "drive", "top drive of the old rig", "top-drive of the old rig", "rig rig", None, "-", *[f"none {i}" for i in range(500)])]
    spark.createDataFrame(texts, "i long, t string").write.parquet(f"{tmp_path}/t")
    spark.createDataFrame(names, "x string, name string").write.parquet(f"{tmp_path}/n")  # more bytes than the texts
    out = textclass.keyword_baseline(spark.read.parquet(f"{tmp_path}/t"), "i", "t", spark.read.parquet(f"{tmp_path}/n"), "name", "none")
    got = {r.i: r.predicted for r in out.collect()}
    assert got == {i: "Rig" if i % 2 else "top drive of the old rig" for i in range(20)} | {20: "none", 21: "none", 22: "Rig"}
    plan = out._jdf.queryExecution().executedPlan().toString().splitlines()
    join = next(line for line in plan if "Join [_run" in line)
    assert "BroadcastHashJoin" in join and "BuildRight" in join if most else "SortMergeJoin" in join


def test_plots_and_quality(spark):
    samples = spark.createDataFrame([("x", 0.0, 10.0), ("x", 10.0, 30.0), ("y", 0.0, 1.0), ("y", 2.0, 3.0)], "axis string, p double, v double")
    fit = {r.axis: r for r in plots.fit_axis(samples, ["axis"], "p", "v").collect()}
    assert (fit["x"].slope, fit["x"].intercept, fit["x"].rmse) == (2.0, 10.0, 0.0) and fit["y"].slope is None
    pages = spark.createDataFrame([(1, 100, 0.9, 0.1), (1, 0, 0.0, 1.0), (2, 90, 0.8, 0.0)], "d int, c int, p double, i double")
    routed = pages.withColumn("route", quality.page_route(F.col("c"), F.col("p"), F.col("i")))
    assert {r.d: r.kind for r in quality.document_route(routed, ["d"], "route").collect()} == {1: "hybrid", 2: "digital"}
    texts = lambda t: spark.createDataFrame([(1, t)], "k int, t string")
    s = quality.token_scores(texts("a b b c"), texts("b b d"), "k", "t").first()
    assert (s.precision, s.recall) == (pytest.approx(2 / 3), 0.5)
    wer = spark.range(1).select(quality.word_error_rate(F.lit("a b c d"), F.lit("a x c")).alias("w")).first().w
    assert wer == 0.5
    kv = spark.createDataFrame([(1, 0, "Well:"), (1, 1, "A"), (1, 2, "Well:"), (1, 3, ""), (1, 4, "Rig:"), (1, 5, "B")], "d int, i int, c string")
    assert {r.field: r.value for r in quality.key_values(kv, ["d"], "i", "c").collect()} == {"Well": "A", "Rig": "B"}
