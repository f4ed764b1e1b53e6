"""Queries of the report, plot, classifier and record operators; they join those of the catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspar.functions import scores, taxonomy, temporal, text
from fieldspar.operators import facets, plots, quality, records, reports, textclass, trend
from fieldspar.plans.catalogue import _MONTHS, _monthly, query, table


def _pick(n: Column, values: tuple) -> Column:
    """The value whose place is n modulo their number."""
    return F.get(F.array(*map(F.lit, values)), F.pmod(n, F.lit(len(values))).cast("int"))


def _clock(hour: Column, quarter: Column) -> Column:
    return F.format_string("%02d:%02d", hour.cast("int"), (quarter * 15).cast("int"))


# Trends ----------------------------------------------------------------------------------------------------------


@query(f"""
    WITH {_MONTHS},
    s AS (SELECT a.series, list_sort(list((b.y - a.y) / (b.x - a.x))) AS l FROM p a JOIN p b ON a.series = b.series AND a.x < b.x GROUP BY 1),
    t AS (SELECT series, sum(c * (c - 1) * (2 * c + 5)) AS ties, sum(c) AS n FROM (SELECT series, y, count(*) AS c FROM p GROUP BY 1, 2) GROUP BY 1),
    k AS (SELECT series, l, len(l) AS m, {trend.Z95} * sqrt((n * (n - 1) * (2 * n + 5) - ties) / 18) AS reach FROM s JOIN t USING (series)),
    i AS (SELECT series, l[CAST(greatest(round((m - reach) / 2), 1) AS INT)] AS a, l[CAST(least(round((m + reach) / 2) + 1, m) AS INT)] AS b FROM k)
    SELECT series, round(a, 6) AS slope_low, round(b, 6) AS slope_high, CASE WHEN a > 0 THEN 'increasing' WHEN b < 0 THEN 'decreasing' ELSE 'stable_or_uncertain' END AS direction FROM i
""")
def theil_sen_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = trend.theil_sen(_monthly(spark, sf_dir), ["series"])
    way = scores.trend_direction(F.col("slope_low"), F.col("slope_high"))
    return fit.select("series", F.round("slope_low", 6).alias("slope_low"), F.round("slope_high", 6).alias("slope_high"), way.alias("direction"))


@query(f"""
    WITH {_MONTHS},
    k AS (SELECT series, rank() OVER (PARTITION BY series ORDER BY x) AS rx, rank() OVER (PARTITION BY series ORDER BY y) + (count(*) OVER (PARTITION BY series, y) - 1) / 2.0 AS ry FROM p),
    r AS (SELECT series, corr(rx, ry) AS rho, count(*) - 2 AS v FROM k GROUP BY 1),
    a AS (SELECT series, rho, v, asin(abs(rho)) AS h FROM r),
    e AS (SELECT series, unnest(range(0, v // 2)) AS j, v, h FROM a),
    s AS (SELECT series, sum(CASE WHEN v % 2 = 0 THEN exp(lgamma(j + 0.5) - lgamma(0.5) - lgamma(j + 1)) * pow(cos(h), 2 * j) ELSE exp(lgamma(1.5) + lgamma(j + 1) - lgamma(j + 1.5)) * pow(cos(h), 2 * j + 1) END) AS terms FROM e GROUP BY 1)
    SELECT series, round(rho, 6) AS rho, round(1 - CASE WHEN v % 2 = 0 THEN sin(h) * terms ELSE 2 / pi() * (h + sin(h) * coalesce(terms, 0)) END, 6) AS p FROM a LEFT JOIN s USING (series)
""")
def spearman_p_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oracle has Student's distribution as the finite sum of its angle, for whole degrees of freedom."""
    return trend.spearman(_monthly(spark, sf_dir), ["series"]).select("series", F.round("rho", 6).alias("rho"), F.round("p", 6).alias("p"))


@query("""
    SELECT l_orderkey, l_linenumber, CAST(printf('%.2f', l_extendedprice * l_tax / 7) AS DOUBLE) AS two, CAST(printf('%.3f', l_extendedprice * l_discount / 3) AS DOUBLE) AS three, CAST(printf('%.1f', l_quantity / 4) AS DOUBLE) AS one FROM lineitem
""")
def python_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    ways = {"two": ("l_extendedprice * l_tax / 7", 2), "three": ("l_extendedprice * l_discount / 3", 3), "one": ("l_quantity / 4", 1)}
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[scores.python_round(F.expr(x), n).alias(name) for name, (x, n) in ways.items()])


# Labels and texts ------------------------------------------------------------------------------------------------

#: Spellings of sub-activities: all labels in three forms, all variants, and what is none.
_SPELLINGS = (
    *((x, x, "canonical") for x in taxonomy.SUB_LABELS), *((x.upper().replace("_", " / "), x, "canonical") for x in taxonomy.SUB_LABELS),
    *((a, x, "canonical" if a.replace(" ", "_") in taxonomy.SUB_LABELS else "alias") for a, x in taxonomy.SUB_ALIASES.items()), ("novel thing", "unknown", "unknown"), ("", "unknown", "unknown"),
)


@query(f"""
    WITH v AS (SELECT * FROM (VALUES {", ".join(f"({i}, {label!r}, {how!r})" for i, (_, label, how) in enumerate(_SPELLINGS))}) t(i, label, method))
    SELECT p_partkey AS id, label, method, CAST(CASE method WHEN 'canonical' THEN 1.0 WHEN 'alias' THEN 0.99 ELSE 0 END AS DOUBLE) AS confidence FROM part JOIN v ON p_partkey % {len(_SPELLINGS)} = i
""")
def normalize_sub_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _pick(F.col("p_partkey"), tuple(x for x, _, _ in _SPELLINGS))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), taxonomy.normalize_sub(raw).alias("n")).select("id", "n.label", "n.method", "n.confidence")


_HEADINGS = tuple(reports.HEADINGS)


@query(rf"""
    WITH v AS (SELECT * FROM (VALUES {", ".join(f"({i}, {reports.HEADINGS[h]!r})" for i, h in enumerate(_HEADINGS))}) t(i, section))
    SELECT doc_id, section, sha256(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')) AS body_hash FROM documents JOIN v ON doc_id % {len(_HEADINGS)} = i
""")
def section_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document below one heading of a report and above another, and what is found there."""
    head, other = _pick(F.col("doc_id"), _HEADINGS), _pick(F.col("doc_id") + 5, _HEADINGS)
    line = F.upper(F.replace(head, F.lit(" "), F.lit("  ")))
    body = F.concat(F.lit("Report\n"), line, F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("\n"), other, F.lit("\nrest"))
    rows = table(spark, sf_dir, "documents").select("doc_id", reports.section_type(line).alias("section"), body.alias("body"))
    found = F.coalesce(*[F.when(F.col("section") == section, reports.summary_text(F.col("body"), heading)) for heading, section in reports.HEADINGS.items()])
    return rows.select("doc_id", "section", F.sha2(found, 256).alias("body_hash"))


_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)


@query(rf"""
    WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_/.-]+') AS l FROM documents),
    e AS (SELECT doc_id, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM w),
    k AS (SELECT doc_id, t, min(i) AS i FROM e WHERE length(t) >= 2 AND t NOT IN ({_STOP}) GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM k),
    g AS (SELECT doc_id, string_agg(t, ' ' ORDER BY i) AS terms FROM r WHERE n <= 20 GROUP BY 1)
    SELECT doc_id, coalesce(terms, '') AS terms FROM documents LEFT JOIN g USING (doc_id)
""")
def search_terms_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.search_terms(F.col("text")), " ").alias("terms"))


@query(r"""
    SELECT page_id, substr(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), 1, 120) AS file, substr(regexp_replace(lower(html), '[^a-z0-9]', '', 'g'), 1, 32) AS evidence,
        url || CASE WHEN page_id % 3 > 0 THEN ', page ' || page_id ELSE '' END || CASE WHEN page_id % 2 > 0 THEN ', body' ELSE '' END AS citation,
        CASE page_id % 5 WHEN 0 THEN 'Pump leak' WHEN 4 THEN 'none known' END AS remark, CASE page_id % 4 WHEN 0 THEN 'drilling' WHEN 1 THEN 'moving' WHEN 2 THEN 'a' ELSE '' END AS main, CASE page_id % 4 WHEN 0 THEN 'trip' WHEN 2 THEN 'b -- c' WHEN 3 THEN 'x' END AS sub,
        CASE page_id % 4 WHEN 0 THEN 'drilled to TD' WHEN 1 THEN 'well-bore' WHEN 2 THEN 'circulated' ELSE 'in the hole' END AS wrapped, page_id % 3 <> 1 AS filled
    FROM pages
""")
def text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, evidence keys, citations, remarks, pairs and wrapped cells of pages."""
    n = F.col("page_id")
    pair = text.split_pair(_pick(n, ("drilling -- trip", "moving", "a--b -- c", " -- x")))
    wrapped = text.join_wrapped(_pick(n, ("drilled\n to TD ", "well-\n\nbore", "circula\nted", "in\n the hole")), False)
    cells = F.when(n % 3 == 0, F.array(F.lit(None).cast("string"), F.lit(" x"))).when(n % 3 == 1, F.array(F.lit(" "), F.lit(None).cast("string"))).otherwise(F.array(F.lit("1")))
    return table(spark, sf_dir, "pages").select(
        "page_id", text.safe_name(F.col("url")).alias("file"), text.evidence_key(F.col("html")).alias("evidence"),
        text.citation(F.col("url"), F.when(n % 3 > 0, n), F.when(n % 2 > 0, F.lit("body"))).alias("citation"), text.meaningful(_pick(n, (" Pump leak ", "None", " n/a", "Not available", "none known"))).alias("remark"),
        pair["first"].alias("main"), pair["second"].alias("sub"), wrapped.alias("wrapped"), text.has_content(cells).alias("filled"),
    )


# Tables of reports -----------------------------------------------------------------------------------------------

_TABLE = """
    r AS (SELECT o_orderkey AS k, o_orderkey % 500 AS document_id, o_orderkey // 500 % 4 AS page, o_custkey AS c, o_orderstatus AS s, CAST(o_totalprice AS DECIMAL(18, 2)) AS price FROM orders)"""


def _table_rows(spark: SparkSession, sf_dir: str, headers: tuple[str, ...], cells: list[Column]) -> DataFrame:
    """A table row for each order; of every 13 one stands under headers that no table of reports has."""
    k = F.col("o_orderkey")
    known, other = F.array(*map(F.lit, headers)), F.array(F.lit("Depth"), F.lit("Gas"))
    return table(spark, sf_dir, "orders").select(
        (k % 500).alias("document_id"), F.expr("o_orderkey div 500 % 4").alias("page_number"), F.lit(0).alias("table_index"), k.alias("table_row"),
        F.when(k % 13 == 0, other).otherwise(known).alias("header_cells"), F.array(*cells).alias("cells"), F.when(k % 11 != 0, F.lit("2008-06-13 00:00:00").cast("timestamp_ntz")).alias("period_start"),
    )


@query(f"""
    WITH {_TABLE},
    t AS (SELECT *, CASE WHEN k % 5 > 0 AND c % 25 < 24 THEN c % 25 * 3600 + k % 4 * 900 END AS a, k % 24 * 3600 + c % 4 * 900 AS b FROM r WHERE k % 13 > 0 AND k % 7 > 0)
    SELECT document_id, k AS table_row, row_number() OVER (PARTITION BY document_id ORDER BY page, k) - 1 AS row_index, round((b - a + CASE WHEN b <= a THEN 86400 ELSE 0 END) / 3600, 4) AS hours,
        CASE WHEN k % 11 = 0 THEN 'missing_report_period' WHEN k % 5 = 0 THEN 'missing_operation_time' WHEN a IS NULL THEN 'invalid_operation_time' WHEN b < a THEN 'midnight_rollover' WHEN a = b THEN 'equal_time_ambiguous' ELSE 'valid' END AS temporal_status,
        CASE WHEN k % 3 > 0 THEN CAST(price AS DOUBLE) END AS depth, CASE WHEN k % 3 = 0 THEN 'source_sentinel' END AS depth_missing_reason,
        CASE k % 3 WHEN 0 THEN 'drilling' WHEN 1 THEN 'formation_evaluation' ELSE 'unknown' END AS main_activity, CASE k % 3 WHEN 0 THEN 'trip' WHEN 1 THEN 'log' ELSE 'unknown' END AS sub_activity,
        CASE WHEN s = 'F' THEN 'fail' ELSE 'ok' END AS state, CASE s WHEN 'F' THEN 'well-bore' WHEN 'O' THEN 'line one of rest' ELSE 'drilled' END AS remark FROM t
""")
def report_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c, s = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus")
    none = F.lit(None).cast("string")
    cells = [
        F.when((k % 5 == 0) | (k % 7 == 0), none).otherwise(_clock(c % 25, k % 4)), F.when(k % 7 == 0, none).otherwise(_clock(k % 24, c % 4)),
        F.when(k % 3 == 0, "-999.99").otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string")), _pick(k, ("Drilling -- Trip", "formation\nevaluation -- log", "novel thing")),
        F.when(s == "F", "FA\nIL").otherwise("OK"), F.when(s == "F", "well-\nbore").when(s == "O", "line one\nof rest").otherwise("drill\ned"),
    ]
    rows = reports.operations(_table_rows(spark, sf_dir, ("Start time", "End time", "End Depth mMD", "Main - Sub Activity", "State", "Remark"), cells))
    return rows.select("document_id", "table_row", "row_index", "hours", "temporal_status", "depth", "depth_missing_reason", "main_activity", "sub_activity", "state", "remark")


@query(f"""
    WITH {_TABLE}
    SELECT document_id, k AS table_row, CASE WHEN k % 11 = 0 THEN 'missing_report_period' WHEN k % 6 = 0 THEN 'missing_failure_time' WHEN k % 9 = 0 THEN 'invalid_failure_time' ELSE 'valid' END AS temporal_status,
        CASE WHEN k % 11 > 0 AND k % 6 > 0 AND k % 9 > 0 THEN strftime(TIMESTAMP '2008-06-13' + to_seconds(CAST(c % 24 * 3600 + k % 4 * 900 AS BIGINT)), '%Y-%m-%dT%H:%M:%S') END AS start,
        CAST(CASE WHEN k % 4 > 0 THEN price END AS DOUBLE) AS depth, CASE s WHEN 'F' THEN 'pump' WHEN 'O' THEN 'mud system' ELSE 'crane' END AS system_class, CASE s WHEN 'F' THEN 'valve' WHEN 'O' THEN 'pump' END AS equipment,
        CAST(c % 90 AS DOUBLE) AS downtime_minutes, 'leak ' || k AS raw_remark FROM r WHERE k % 13 > 0
""")
def report_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c, s = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus")
    cells = [
        F.when(k % 6 == 0, "").when(k % 9 == 0, "25:00").otherwise(_clock(c % 24, k % 4)), F.when(k % 4 == 0, "-999.9").otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string")), F.lit("n/a"),
        F.when(s == "F", "Pump -- Valve").when(s == "O", "mud system--Pump").otherwise("Crane"), (c % 90).cast("string"), F.lit("20:00"), F.concat(F.lit("leak\n"), k.cast("string")),
    ]
    headers = ("Start\ntime", "Depth mMD", "Depth mTVD", "Sub Equip - Syst Class", "Operation Downtime (min)", "Equipment Repaired", "Remark")
    rows = reports.failures(_table_rows(spark, sf_dir, headers, cells))
    return rows.select("document_id", "table_row", "temporal_status", temporal.iso(F.col("start")).alias("start"), "depth", "system_class", "equipment", "downtime_minutes", F.col("raw_values")["Remark"].alias("raw_remark"))


@query("""
    WITH t AS (SELECT o_custkey AS line, o_orderkey * 2 AS x0, o_orderkey * 2 + o_orderkey % 7 AS x1, o_orderkey % 4 AS y, o_orderstatus AS s, o_orderkey % 101 AS conf, list_sum(list_transform([0, 500, 4000, 20000], lambda b: CAST(b <= o_orderkey * 2 AS INT))) - 1 AS col FROM orders)
    SELECT line, string_agg(s, ' ' ORDER BY x0) AS text, avg(y) AS y, round(avg(conf), 4) AS confidence, CAST(min(x0) AS DOUBLE) AS left_edge, CAST(max(x1) AS DOUBLE) AS right_edge, max(col) AS last_column, min(col) AS first_column FROM t GROUP BY 1
""")
def token_line_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as recognised tokens, a customer's on one line, dealt to four columns."""
    k = F.col("o_orderkey")
    tokens = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("line"), (k * 2).cast("double").alias("x0"), (k * 2 + k % 7).cast("double").alias("x1"), (k % 4).alias("top"), (k % 4 + 9).alias("bottom"),
        F.col("o_orderstatus").alias("text"), (k % 101).alias("confidence"), F.array(*map(F.lit, (0.0, 500.0, 4000.0, 20000.0))).alias("starts"),
    )
    columns = tokens.groupBy("line").agg(F.max(quality.column_of("x0", "starts")).alias("last_column"), F.min(quality.column_of("x0", "starts")).alias("first_column"))
    lines = quality.token_lines(tokens, ["line"]).join(columns, "line")
    return lines.select("line", "text", "y", "confidence", F.col("bbox.x0").alias("left_edge"), F.col("bbox.x1").alias("right_edge"), "last_column", "first_column")


@query("""
    SELECT o_custkey AS page, 'ocr_uncertain_structured_rows' AS code, 'medium' AS severity, count(*) AS row_count FROM orders WHERE o_orderkey % 10 < 6 GROUP BY 1
""")
def uncertain_row_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("page"), (F.col("o_orderkey") % 10 / 10).alias("confidence"))
    return reports.uncertain_rows(rows, ["page"])


@query("""
    WITH c AS (SELECT o_custkey AS row_id, o_orderkey AS n, CASE o_orderkey % 3 WHEN 0 THEN ' Status: ' WHEN 1 THEN 'Rig:' ELSE CASE WHEN o_orderstatus = 'P' THEN ' ' ELSE o_orderstatus || o_orderkey END END AS cell FROM orders),
    p AS (SELECT *, lead(cell) OVER (PARTITION BY row_id ORDER BY n) AS value FROM c),
    k AS (SELECT row_id, n, value, trim(replace(cell, ':', '')) AS field FROM p WHERE contains(cell, ':')),
    f AS (SELECT row_id, field, min(n) AS position, arg_max(value, n) FILTER (trim(value) <> '') AS value, count(*) FILTER (trim(value) <> '') AS filled FROM k GROUP BY 1, 2)
    SELECT row_id, field, value, position FROM f WHERE filled > 0
""")
def key_value_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that have a filled value."""
    cell = F.when(F.col("o_orderkey") % 3 == 0, " Status: ").when(F.col("o_orderkey") % 3 == 1, "Rig:").when(F.col("o_orderstatus") == "P", " ").otherwise(F.concat("o_orderstatus", F.col("o_orderkey").cast("string")))
    cells = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("row_id"), F.col("o_orderkey").alias("n"), cell.alias("cell"))
    return quality.key_values(cells, ["row_id"], "n", "cell").where("trim(value) <> ''").select("row_id", "field", "value", "position")


# Routing, audits and checks --------------------------------------------------------------------------------------

_FILES = (
    ("a.PDF", "pdf"), ("Press_Profile.png", "pressure_profile_image"), ("time_curve.JPG", "pressure_time_image"), ("photo.jpeg", "image"), ("x.zip", "archive"), ("x.txt", "unsupported"),
    ("profile_time.tiff", "pressure_profile_image"), ("time.pdf", "pdf"),
)


@query(f"""
    SELECT kind, count(*) AS n FROM pages JOIN (VALUES {", ".join(f"({i}, {kind!r})" for i, (_, kind) in enumerate(_FILES))}) t(i, kind) ON page_id % {len(_FILES)} = i GROUP BY 1
""")
def asset_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("/in/time profile/"), F.col("page_id").cast("string"), F.lit("/"), _pick(F.col("page_id"), tuple(name for name, _ in _FILES)))
    return table(spark, sf_dir, "pages").groupBy(quality.asset_kind(path).alias("kind")).agg(F.count("*").alias("n"))


@query("""
    WITH o AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R')
    SELECT origin, l_linestatus, count(*) AS n FROM (
        SELECT 'native' AS origin, l_linestatus FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.l_orderkey = l.l_orderkey AND o.l_linenumber = l.l_linenumber)
        UNION ALL SELECT 'ocr', l_linestatus FROM lineitem WHERE l_returnflag = 'R') GROUP BY 1, 2
""")
def hybrid_page_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus", "l_returnflag")
    both = quality.hybrid_pages(rows.withColumn("origin", F.lit("native")), rows.where("l_returnflag = 'R'").withColumn("origin", F.lit("ocr")), "l_orderkey", "l_linenumber")
    return both.groupBy("origin", "l_linestatus").agg(F.count("*").alias("n"))


@query(r"""
    WITH r AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN upper(html) WHEN 1 THEN 'not on this page at all, no' WHEN 2 THEN '--- ' || html END AS evidence, html FROM pages)
    SELECT page_id, page_id % 4 = 0 OR page_id % 4 = 2 OR (page_id % 4 = 1 AND contains(regexp_replace(lower(html), '[^a-z0-9]', '', 'g'), 'notonthispageatallno')) AS verified FROM r
""")
def evidence_on_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, n = table(spark, sf_dir, "pages"), F.col("page_id")
    evidence = F.when(n % 4 == 0, F.upper("html")).when(n % 4 == 1, "not on this page at all, no").when(n % 4 == 2, F.concat(F.lit("--- "), F.col("html")))
    return quality.verify_sources(pages.select("page_id", evidence.alias("evidence")), pages, ["page_id"], "evidence", "html").select("page_id", "verified")


@query("SELECT page_id, page_id % 4 = 0 AS verified FROM pages")
def stored_asset_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every four assets one is whole, one too long, one has another hash and one isn't a PDF."""
    n = F.col("page_id")
    body = F.concat(F.when(n % 4 == 3, "%PNG-").otherwise("%PDF-"), F.col("html")).cast("binary")
    rows = table(spark, sf_dir, "pages").select("page_id", body.alias("content_bytes"))
    size = F.length("content_bytes") + F.when(n % 4 == 1, 1).otherwise(0)
    sha = F.when(n % 4 == 2, F.sha2(F.lit("x").cast("binary"), 256)).otherwise(F.sha2("content_bytes", 256))
    return quality.verified_assets(rows.withColumns({"byte_size": size, "sha256": sha})).select("page_id", "verified")


_TARGETS = (("A", ">=", 0.04), ("N", "<=", 0.04), ("R", ">=", 0.5), ("missing", ">=", 0.0))


@query(f"""
    WITH t AS (SELECT * FROM (VALUES {", ".join(map(str, _TARGETS))}) v(name, op, target)),
    m AS (SELECT l_returnflag AS name, round(CAST(sum(CAST(l_discount AS DECIMAL(18, 4))) AS DOUBLE) / count(*), 6) AS value FROM lineitem GROUP BY 1)
    SELECT name, value, coalesce(CASE op WHEN '>=' THEN value >= target ELSE value <= target END, false) AS passed FROM t LEFT JOIN m USING (name)
""")
def metric_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.round(F.sum(F.col("l_discount").cast("decimal(18,4)")).cast("double") / F.count("*"), 6)
    metrics = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("name")).agg(value.alias("value"))
    return quality.target_results(metrics, spark.createDataFrame(list(_TARGETS), "name string, op string, target double")).select("name", "value", "passed")


@query("""
    SELECT count(*) AS cases, count(*) FILTER (o_totalprice > 1000 AND o_orderstatus <> 'P' AND o_orderkey % 10 > 0) AS passed, round(sum(o_custkey) / count(*), 6) AS mean_seconds, median(o_custkey) AS median_seconds, max(o_custkey) AS max_seconds FROM orders
""")
def case_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr("o_totalprice > 1000 as dear", "o_orderstatus <> 'P' as closed", "o_orderkey % 10 > 0 as odd", "o_custkey as seconds")
    return quality.case_results(rows, ["dear", "closed", "odd"]).withColumn("mean_seconds", F.round("mean_seconds", 6))


@query("""
    SELECT o_orderkey AS report_id, o_orderkey % 4 > 0 AND CASE o_orderkey % 4 WHEN 1 THEN true WHEN 2 THEN false ELSE false END AS excluded,
        strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS ends, date_diff('day', DATE '0001-01-01', CAST(o_orderdate AS DATE)) + 1 AS day FROM orders
""")
def spud_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wells begun two days after, one day after, one day before a report, or never."""
    end = F.col("o_orderdate").cast("timestamp_ntz")
    spud = F.when(F.col("o_orderkey") % 4 == 1, end + F.expr("interval 2 days")).when(F.col("o_orderkey") % 4 == 2, end + F.expr("interval 1 day")).when(F.col("o_orderkey") % 4 == 3, end - F.expr("interval 1 day"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("report_id"), temporal.spud_excluded(end, spud).alias("excluded"), temporal.iso(end).alias("ends"), temporal.day_number(end).alias("day"))


# Plots -----------------------------------------------------------------------------------------------------------


@query("""
    WITH b AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE event_type <> 'view' GROUP BY 1, 2),
    s AS (SELECT user_id, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS bands FROM b GROUP BY 1),
    f AS (SELECT user_id AS plot_id, count(*) AS n_points, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS series, min(value) AS x_min, max(value) AS x_max, min(value * 2) AS y_min, max(value * 2) AS y_max,
        arg_min(value * 2, ts) AS first_value, arg_max(value * 2, ts) AS last_value FROM events GROUP BY 1)
    SELECT f.*, bands, CASE WHEN last_value > first_value THEN 'up' WHEN last_value < first_value THEN 'down' ELSE 'flat' END AS direction FROM f LEFT JOIN s ON plot_id = user_id
""")
def plot_point_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as points, a user's on one plot."""
    points = table(spark, sf_dir, "events").selectExpr("user_id as plot_id", "event_type as series_identifier", "value as x_value", "value * 2 as y_value", "ts as observed_date", "nullif(event_type, 'view') as band_classification")
    named = F.array_join(F.transform(F.map_entries("bands"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return plots.plot_facts(points, ["plot_id"]).withColumns({"bands": named, "series": F.array_join("series", ",")})


@query("""
    WITH t AS (SELECT o_custkey % 50 AS plot, o_custkey % 110 - 10 AS x, o_orderkey % 130 - 10 AS y, o_orderdate AS d, o_orderkey AS k, CAST(o_totalprice AS DECIMAL(18, 2)) AS v FROM orders),
    s AS (SELECT plot, 'x' AS axis, x AS pixel, date_diff('day', DATE '0001-01-01', make_date(year(d), CASE WHEN month(d) < 10 THEN month(d) ELSE 1 END, 1)) + 1 AS value FROM t WHERE k % 2 = 0 AND year(d) >= 2000 AND y > 100 AND x BETWEEN 0 AND 90
        UNION ALL SELECT plot, 'y', y, v FROM t WHERE k % 2 = 1 AND k % 5 > 0 AND x < 0 AND y BETWEEN 0 AND 100 AND v BETWEEN 100 AND 100000)
    SELECT plot, axis, count(*) AS n, CAST(sum(pixel) AS DOUBLE) AS pixels, CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) AS total FROM s GROUP BY 1, 2
""")
def time_axis_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as recognised tokens: months on even ones, amounts on odd ones, of which every fifth has a unit; months of two digits count by the first (see plots.MONTH)."""
    k = F.col("o_orderkey")
    amount = F.concat(F.lit(" "), F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2), F.when(k % 5 == 0, " psi").otherwise(""))
    tokens = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("plot"), (F.col("o_custkey") % 110 - 10).alias("x"), (k % 130 - 10).alias("y"), F.when(k % 2 == 0, F.date_format("o_orderdate", "yyyy / M")).otherwise(amount).alias("text"))
    bounds = tokens.select("plot").distinct().selectExpr("plot", "0 as left", "90 as right", "0 as top", "100 as bottom")
    samples = plots.dated_axis_samples(tokens, bounds, ["plot"])
    return samples.groupBy("plot", "axis").agg(F.count("*").alias("n"), F.sum("pixel").alias("pixels"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"))


@query("""
    SELECT p_partkey AS id FROM part WHERE p_size / (1 + p_partkey % 60) BETWEEN 0.65 AND 1.45 AND p_size BETWEEN 12 AND 55 AND 1 + p_partkey % 60 BETWEEN 12 AND 55
""")
def marker_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = table(spark, sf_dir, "part").selectExpr("p_partkey as id", "p_size as width", "1 + p_partkey % 60 as height", "p_partkey as x", "p_size as y")
    return plots.markers(shapes).select("id")


@query("""
    WITH h AS (SELECT o_custkey % 40 AS plot_id, o_orderkey // 40 AS position FROM orders WHERE o_totalprice > 0.3 * 500000 GROUP BY 1, 2),
    g AS (SELECT *, position - row_number() OVER (PARTITION BY plot_id ORDER BY position) AS run FROM h),
    c AS (SELECT plot_id, (min(position) + max(position)) / 2 AS centre FROM g GROUP BY plot_id, run)
    SELECT plot_id, CAST(round(min(centre)) AS INT) AS first, CAST(round(max(centre)) AS INT) AS last FROM c GROUP BY 1
""")
def plot_bound_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a plot's rows with their dark pixels; the darkest order of a row counts."""
    rows = table(spark, sf_dir, "orders").selectExpr("o_custkey % 40 as plot_id", "o_orderkey div 40 as position", "o_totalprice as dark")
    rows = rows.groupBy("plot_id", "position").agg(F.max("dark").alias("dark")).withColumn("length", F.lit(500_000.0))
    return plots.plot_bounds(rows, ["plot_id"], "position", "dark", "length")


@query("""
    SELECT p.o_orderkey AS point_id, median(CAST(c.l_quantity AS DOUBLE)) AS reference_x FROM orders p LEFT JOIN lineitem c ON c.l_suppkey = p.o_custkey % 100 AND abs(p.o_orderkey % 3000 - c.l_partkey) <= 7 GROUP BY 1
""")
def curve_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "orders").selectExpr("o_orderkey as point_id", "o_custkey % 100 as plot_id", "o_orderkey % 3000 as y")
    curve = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey as plot_id", "l_quantity as x", "l_partkey as y")
    return plots.curve_at(points, curve, ["plot_id"]).select("point_id", "reference_x")


@query("""
    WITH f AS (SELECT event_id, user_id, CAST(floor(value) AS BIGINT) * 2 AS r FROM events)
    SELECT user_id, count(*) AS pixels, count(*) FILTER (sqrt((r % 256 - 200) ** 2 + (event_id % 256 - 30) ** 2 + (user_id % 256 - 40) ** 2) <= 90) AS near FROM f GROUP BY 1
""")
def color_mask_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    red = F.floor("value") * 2 % 256
    near = scores.color_near(red, F.col("event_id") % 256, F.col("user_id") % 256, (200, 30, 40), 90.0)
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("pixels"), F.count_if(near).alias("near"))


# Classifier and records ------------------------------------------------------------------------------------------


@query("SELECT count(*) AS n, CAST(0 AS BIGINT) AS leaked, true AS both_sides FROM lineitem")
def grouped_split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row is on one side, and no order on both."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey")
    train, test = textclass.grouped_split(rows, "l_orderkey")
    leaked = textclass.leaked_groups(train, test, "l_orderkey").selectExpr("0 as train", "0 as test", "1 as leaked")
    parts = train.selectExpr("1 as train", "0 as test", "0 as leaked").unionAll(test.selectExpr("0 as train", "1 as test", "0 as leaked")).unionAll(leaked)
    return parts.agg(F.sum(F.expr("train + test")).alias("n"), F.sum("leaked").alias("leaked"), ((F.sum("train") > 0) & (F.sum("test") > 0)).alias("both_sides"))


@query("SELECT l_partkey AS label, count(*) AS support FROM lineitem GROUP BY 1 HAVING count(*) >= 20")
def class_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textclass.large_classes(table(spark, sf_dir, "lineitem"), "l_partkey").groupBy(F.col("l_partkey").alias("label")).agg(F.count("*").alias("support"))


@query("""
    SELECT o_orderpriority AS actual, c_mktsegment AS predicted, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority <> c_mktsegment GROUP BY 1, 2 ORDER BY n DESC, actual, predicted LIMIT 20
""")
def confusion_pairs_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.expr("o_custkey = c_custkey"))
    return textclass.confusion_pairs(textclass.confusion(rows, "o_orderpriority", "c_mktsegment"))


_BASE = """
    t AS (SELECT p_partkey AS id, 'The ' || p_name || '-' || lower(p_type) || ', ' || p_brand AS remark FROM part),
    l AS (SELECT DISTINCT label FROM (SELECT p_name AS label FROM part WHERE p_size > 25 UNION ALL SELECT p_type FROM part WHERE p_size < 40)),
    k AS (SELECT *, ' ' || trim(regexp_replace(lower(label), '[^a-z0-9]+', ' ', 'g')) || ' ' AS run FROM l)"""


@query(f"""
    WITH {_BASE},
    h AS (SELECT id, label, row_number() OVER (PARTITION BY id ORDER BY length(label) DESC, label) AS n FROM t JOIN k ON contains(' ' || trim(regexp_replace(lower(remark), '[^a-z0-9]+', ' ', 'g')) || ' ', run))
    SELECT id, coalesce(label, 'other') AS predicted FROM t LEFT JOIN h USING (id) WHERE n IS NULL OR n = 1
""")
def keyword_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    rows = part.select(F.col("p_partkey").alias("id"), F.concat(F.lit("The "), F.col("p_name"), F.lit("-"), F.lower("p_type"), F.lit(", "), F.col("p_brand")).alias("remark"))
    labels = part.where("p_size > 25").selectExpr("p_name as label").union(part.where("p_size < 40").selectExpr("p_type"))
    return textclass.keyword_baseline(rows, "id", "remark", labels, "label", "other").select("id", "predicted")


@query("""
    WITH o AS (SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'drilling' WHEN 1 THEN 'unknown' END AS s, CASE WHEN o_orderkey % 5 = 0 THEN 'moving' END AS r, CASE WHEN o_orderkey % 7 > 2 THEN 'trip' ELSE 'unknown' END AS p, o_orderkey % 100 / 100 AS c FROM orders)
    SELECT id, CASE WHEN s = 'drilling' THEN s WHEN r IS NOT NULL THEN r WHEN p = 'trip' THEN p ELSE 'unknown' END AS label, CASE WHEN s = 'drilling' THEN 'source' WHEN r IS NOT NULL THEN 'rule' WHEN p = 'trip' THEN 'model' ELSE 'unknown' END AS origin,
        CAST(CASE WHEN s = 'drilling' OR r IS NOT NULL THEN 1 WHEN p = 'trip' THEN c ELSE 0 END AS DOUBLE) AS confidence FROM o
""")
def label_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    found = textclass.precedence(F.when(k % 3 == 0, "drilling").when(k % 3 == 1, "unknown"), F.when(k % 5 == 0, "moving"), F.when(k % 7 > 2, "trip").otherwise("unknown"), k % 100 / 100)
    return table(spark, sf_dir, "orders").select(k.alias("id"), found.alias("f")).select("id", "f.label", "f.origin", "f.confidence")


@query("""
    WITH o AS (SELECT o_orderkey AS id, o_orderstatus AS a, CASE o_orderkey % 4 WHEN 0 THEN o_orderstatus WHEN 1 THEN 'unknown' WHEN 2 THEN 'F' END AS b FROM orders)
    SELECT id, a AS old_label, b AS new_label FROM o WHERE a IS DISTINCT FROM b AND coalesce(b, '') <> 'unknown' AND b IS NOT NULL
""")
def label_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    old = table(spark, sf_dir, "orders").select(k.alias("id"), F.col("o_orderstatus").alias("label"))
    new = table(spark, sf_dir, "orders").select(k.alias("id"), F.when(k % 4 == 0, F.col("o_orderstatus")).when(k % 4 == 1, "unknown").when(k % 4 == 2, "F").alias("label"))
    return records.changed(old, new, "id", ["label"])


@query("""
    WITH a AS (SELECT o_custkey AS k, o_orderkey // 7 AS i, max(o_totalprice) AS x FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1, 2), b AS (SELECT o_custkey AS k, o_orderkey // 7 AS i, min(o_totalprice) AS y FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1, 2)
    SELECT missing_left, missing_right, count(*) AS n FROM (SELECT a.k IS NULL AS missing_left, b.k IS NULL AS missing_right FROM a FULL JOIN b ON a.k = b.k AND a.i = b.i) GROUP BY 1, 2
""")
def positional_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.expr("o_orderkey div 7").alias("i"), "o_totalprice", "o_orderstatus")
    a, b = rows.where("o_orderstatus <> 'P'").groupBy("k", "i").agg(F.max("o_totalprice").alias("x")), rows.where("o_orderstatus <> 'F'").groupBy("k", "i").agg(F.min("o_totalprice").alias("y"))
    return records.align_by_position(a, b, "k", "i").groupBy("missing_left", "missing_right").agg(F.count("*").alias("n"))


# Facets and counters ---------------------------------------------------------------------------------------------


@query("""
    SELECT 'o_orderpriority' AS facet, o_orderpriority AS value, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 2 UNION ALL SELECT 'o_orderstatus', o_orderstatus, count(*) FROM orders WHERE o_orderstatus = 'F' GROUP BY 2
""")
def facet_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").where(facets.chosen({"o_orderstatus": "F", "o_orderpriority": facets.ALL}))
    return facets.facet_values(rows, ["o_orderpriority", "o_orderstatus"])


@query("""
    WITH r AS (SELECT o_orderkey, o_custkey AS document_id FROM orders), f AS (SELECT DISTINCT document_id FROM r JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag = 'R' ORDER BY 1 LIMIT 10),
    p AS (SELECT DISTINCT document_id FROM r JOIN lineitem ON o_orderkey = l_orderkey WHERE document_id NOT IN (FROM f) ORDER BY 1 LIMIT 20)
    SELECT * FROM (SELECT document_id, 'failure' AS reason FROM f UNION ALL SELECT document_id, 'operation' FROM p) ORDER BY reason, document_id LIMIT 20
""")
def representative_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "report_id")
    orders = table(spark, sf_dir, "orders").selectExpr("o_orderkey as report_id", "o_custkey as document_id")
    return facets.representative_sources(orders, items.where("l_returnflag = 'R'"), items, 20)


@query("""
    SELECT l_returnflag AS section_type, count(DISTINCT l_orderkey) AS reports, round(count(DISTINCT l_orderkey) / (SELECT count(*) FROM orders), 6) AS share FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1
""")
def section_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    sections = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as report_id", "l_returnflag as section_type")
    return facets.section_coverage(table(spark, sf_dir, "orders").selectExpr("o_orderkey as report_id"), sections).withColumn("share", F.round("share", 6))


@query("SELECT nullif(p_size, 7) AS page_count, count(*) AS documents FROM part GROUP BY 1")
def page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.page_histogram(table(spark, sf_dir, "part").selectExpr("nullif(p_size, 7) as page_count"))


@query("""
    SELECT doc_id, lower(substr(sha256(text), 1, 12)) AS sha, CASE WHEN doc_id % 2 = 0 THEN 'b=2,a=9' ELSE 'a=1,b=2' END AS facts FROM documents WHERE text IS NOT NULL AND doc_id % 3 > 0
    UNION ALL SELECT doc_id, 'unknown', CASE WHEN doc_id % 2 = 0 THEN 'b=2,a=9' ELSE 'a=1,b=2' END FROM documents WHERE text IS NULL OR doc_id % 3 = 0
""")
def build_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short hashes, and the later of two maps' values where it has one."""
    k = F.col("doc_id")
    sha = F.when(k % 3 == 0, "not-a-hash").otherwise(F.upper(F.sha2("text", 256)))
    facts = text.merged(F.expr("map('a', 1, 'b', 2)"), F.when(k % 2 == 0, F.expr("map('a', 9)")))
    named = F.array_join(F.transform(F.map_entries(facts), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return table(spark, sf_dir, "documents").select("doc_id", text.short_sha(sha).alias("sha"), named.alias("facts"))
