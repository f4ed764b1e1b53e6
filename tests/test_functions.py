from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fieldspar.functions import scores, taxonomy, temporal, text


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def each(spark, values, kind, use):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.out for r in rows.select("i", use(F.col("v")).alias("out")).orderBy("i").collect()]


@pytest.mark.parametrize(("raw", "expected"), [("-999.99", (None, "source_sentinel")), ("-999.9", (None, "source_sentinel")), ("8,8", (8.8, None)), ("", (None, "source_blank")), ("x", (None, "not_numeric")), ("1 000.5", (1000.5, None)), ("1,000.5", (None, "not_numeric"))])
def test_number(spark, raw, expected):
    n = value(spark, text.number(F.lit(raw)))
    assert (n.value, n.missing_reason) == expected


def test_labels(spark):
    mains = each(spark, ["Formation\nEvaluation", "plug & abandon", "DRILLING", "novel operation", None, " "], "string", taxonomy.normalize_main)
    assert [m.label for m in mains] == ["formation_evaluation", "plug_abandon", "drilling", "unknown", "unknown", "unknown"]
    assert [m.method for m in mains] == ["alias", "canonical", "canonical", "unknown", "unknown", "unknown"]
    subs = each(spark, ["surv\ney", "waitingon weather", "wire line", "mystery task"], "string", taxonomy.normalize_sub)
    assert [s.label for s in subs] == ["survey", "waiting_on_weather", "wireline", "unknown"]


def test_cells(spark):
    assert value(spark, text.join_wrapped(F.lit("surv\ney"), True)) == "survey"
    assert value(spark, text.join_wrapped(F.lit("top-\ndrive unit"), False)) == "top-drive unit"
    assert value(spark, text.join_wrapped(F.lit("operat\nion\nstopped now"), False)) == "operation stopped now"
    assert tuple(value(spark, text.split_pair(F.lit("hoisting equ -- top drive -- x")))) == ("hoisting equ", "top drive -- x")
    assert value(spark, text.failure_header(F.array(*map(F.lit, ["Start\ntime", "Operation Downtime (min)", "Remark"]))))
    assert value(spark, text.zip_cells(F.array(*map(F.lit, ["a", "b", "a"])), F.array(*map(F.lit, ["1", "2", "3", "4"])))) == {"b": "2", "a": "3"}
    assert value(spark, F.size(text.pad_cells(F.array(F.lit("x")), 6))) == 6
    assert value(spark, text.sentinel_cells(F.array(*map(F.lit, ["-999.99", "1", "-999,9"])))) == 2
    assert not value(spark, text.has_content(F.array(F.lit(None).cast("string"), F.lit(" "))))


def test_names(spark):
    found = value(spark, text.filename_identity(F.lit("/in/15_9_F_11_A_2008_01_02.pdf")))
    assert (found.wellbore, str(found.report_date)) == ("15/9-F-11 A", "2008-01-02")
    assert value(spark, text.filename_identity(F.lit("15_9_F_11_2008_13_02.pdf"))) is None
    assert value(spark, text.wellbore(F.lit(" 15/9 – f-4  a"))) == "15/9-F-4 A"


def test_language_and_terms(spark):
    assert each(spark, ["Which report?", "Hansı quyu?", "Hansı report?", ""], "string", text.language) == ["en", "az", "mixed", "en"]
    assert value(spark, text.search_terms(F.lit("What about the 15/9-F-4 mud weight mud?"))) == ["15/9-f-4", "mud", "weight"]
    assert [str(d) for d in value(spark, text.dates(F.lit("2008-02-30 and 2008-02-29, 2009-01-01")))] == ["2008-02-29", "2009-01-01"]
    assert sorted(value(spark, text.numbers(F.lit("1,200 at +5 and x9 -3")))) == ["-3", "1200", "5"]
    assert value(spark, text.cited_files(F.lit("see a.pdf, b.PNG and a.pdf"))) == ["a.pdf", "b.PNG"]
    assert value(spark, text.citation(F.lit("a.pdf"), F.lit(2), F.lit(None).cast("string"))) == "a.pdf, page 2"
    assert each(spark, ["none", " N/A ", "Drilled "], "string", text.meaningful) == [None, None, "Drilled"]
    assert each(spark, ["Straße ﬁn", None], "string", text.nfkc_casefold) == ["strasse fin", None]


def test_clocks(spark):
    period = F.lit("2008-06-13 06:00:00").cast("timestamp_ntz")

    def interval(a, b):
        i = value(spark, temporal.operation_interval(F.lit(a).cast("string"), F.lit(b).cast("string"), period))
        return i.status, str(i.start), str(i.end)

    assert interval("23:30", "00:15") == ("midnight_rollover", "2008-06-13 23:30:00", "2008-06-14 00:15:00")
    assert interval("08:00", "08:00") == ("equal_time_ambiguous", "2008-06-13 08:00:00", "None")
    assert interval("24:00", "08:00")[0] == "invalid_operation_time"
    assert interval(None, "08:00")[0] == "missing_operation_time"
    assert value(spark, temporal.duration_hours(F.lit("23:00"), F.lit("00:00"))) == 1.0
    assert value(spark, temporal.duration_hours(F.lit("08:00"), F.lit("08:00"))) == 24.0
    assert value(spark, temporal.day_number(F.lit("2008-06-13").cast("date"))) == 733206
    assert value(spark, temporal.failure_time(F.lit("25:00"), period)).status == "invalid_failure_time"


def test_scores(spark):
    low = F.lit(None).cast("double")
    band = lambda x, *c: value(spark, scores.band(F.lit(x), *[low if v is None else F.lit(v) for v in c]))
    assert band(1.0, 2.0, 3.0, 4.0, 5.0) == "below_min"
    assert band(4.5, 2.0, 3.0, 4.0, 5.0) == "between_max_virgin"
    assert band(6.0, 2.0, 3.0, 4.0, None) == "above_max"
    assert band(6.0, None, None, None, None) == "unclassified"
    assert value(spark, scores.severity(F.lit(-8.0))) == "high"
    assert value(spark, scores.guarded_recall(F.lit(3), F.lit(0))) == 1.0
    assert value(spark, scores.rate(F.lit(0), F.lit(0))) == 0.0
