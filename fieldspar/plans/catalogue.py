"""The query catalogue: name -> query, and name -> DuckDB SQL with the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldspar.functions import scores, taxonomy, temporal, text
from fieldspar.functions.scores import rate
from fieldspar.operators import chunks, matching, plots, quality, records, robust, rules, search, summary, textclass, trend
from fieldspar.plans import grounding, planner, sql_guard
from fieldspar.sources import sinks
from fieldspar.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a query under its function's name, with its oracle."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("""
    SELECT l_returnflag AS activity, o_orderstatus AS wellbore, count(*) AS operations,
           CAST(sum(CAST(l_quantity AS DECIMAL(18, 2))) AS DOUBLE) AS hours
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    WHERE l_returnflag IS NOT NULL
    GROUP BY 1, 2 ORDER BY operations DESC, activity, wellbore LIMIT 50
""")
def flagship_activity_aggregation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.expr("l_orderkey = o_orderkey"))
    rows = rows.where("l_returnflag is not null").groupBy(F.col("l_returnflag").alias("activity"), F.col("o_orderstatus").alias("wellbore"))
    hours = F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double")
    return rows.agg(F.count("*").alias("operations"), hours.alias("hours")).orderBy(F.desc("operations"), "activity", "wellbore").limit(50)


# Relational core -------------------------------------------------------------------------------------------------


@query("""
    SELECT c_mktsegment AS entity, count(*) AS reports FROM orders JOIN customer ON o_custkey = c_custkey
    GROUP BY 1 ORDER BY reports DESC, entity LIMIT 20
""")
def entity_report_counts_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.expr("o_custkey = c_custkey"))
    return rows.groupBy(F.col("c_mktsegment").alias("entity")).agg(F.count("*").alias("reports")).orderBy(F.desc("reports"), "entity").limit(20)


@query("""
    SELECT c_mktsegment AS segment, count(*) AS failed FROM orders JOIN customer ON o_custkey = c_custkey
    WHERE o_orderstatus = 'F' GROUP BY 1
""")
def fail_rows_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    rows = failed.join(table(spark, sf_dir, "customer"), F.expr("o_custkey = c_custkey"))
    return rows.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("failed"))


@query("""
    SELECT l_returnflag AS activity, c_mktsegment AS file_name, CAST(sum(CAST(l_quantity AS DECIMAL(18, 2))) AS DOUBLE) AS hours, min(l_linenumber) AS first_page
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    WHERE o_orderdate >= TIMESTAMP '1997-03-01' AND o_orderdate < TIMESTAMP '1997-03-08' GROUP BY 1, 2
""")
def main_activity_on_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "orders").where("o_orderdate >= timestamp_ntz'1997-03-01' and o_orderdate < timestamp_ntz'1997-03-08'")
    rows = table(spark, sf_dir, "lineitem").join(days, F.expr("l_orderkey = o_orderkey")).join(table(spark, sf_dir, "customer"), F.expr("o_custkey = c_custkey"))
    return rows.groupBy(F.col("l_returnflag").alias("activity"), F.col("c_mktsegment").alias("file_name")).agg(_exact_sum("l_quantity").alias("hours"), F.min("l_linenumber").alias("first_page"))


def _exact_sum(column: str) -> Column:
    return F.sum(F.col(column).cast("decimal(18,2)")).cast("double")


@query("""
    SELECT l_returnflag AS detector, l_linestatus AS category, o_orderpriority AS severity, o_orderstatus AS status, count(*) AS candidates
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_tax > 0.02 GROUP BY 1, 2, 3, 4
""")
def status_breakdown_4key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where("l_tax > 0.02").join(table(spark, sf_dir, "orders"), F.expr("l_orderkey = o_orderkey"))
    keys = {"l_returnflag": "detector", "l_linestatus": "category", "o_orderpriority": "severity", "o_orderstatus": "status"}
    return rows.groupBy(*[F.col(c).alias(n) for c, n in keys.items()]).agg(F.count("*").alias("candidates"))


@query("""
    SELECT o_orderkey AS failure_id, 'equipment_failure:' || o_orderkey AS evidence_id, c_name AS wellbore, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS report_date, l_linenumber AS row_index,
           CASE WHEN l_orderkey IS NOT NULL THEN 'operation:' || l_linenumber || ':' || coalesce(p_type, '') END AS operation
    FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'R' LEFT JOIN part ON p_partkey = l_partkey
    WHERE o_orderstatus = 'F' AND (o_orderpriority ILIKE '%urgent%' OR c_mktsegment ILIKE '%machin%')
""")
def failure_left_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").join(table(spark, sf_dir, "customer"), F.expr("o_custkey = c_custkey"))
    rows = rows.where(F.col("o_orderpriority").ilike("%urgent%") | F.col("c_mktsegment").ilike("%machin%"))
    rows = rows.join(table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'"), F.expr("l_orderkey = o_orderkey"), "left").join(table(spark, sf_dir, "part"), F.expr("p_partkey = l_partkey"), "left")
    return rows.selectExpr(
        "o_orderkey as failure_id", "concat('equipment_failure:', o_orderkey) as evidence_id", "c_name as wellbore", "cast(cast(o_orderdate as date) as string) as report_date", "l_linenumber as row_index",
        "case when l_orderkey is not null then concat('operation:', l_linenumber, ':', coalesce(p_type, '')) end as operation",
    )


@query("""
    WITH a AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'operation' ELSE 'section' END AS kind, o_orderkey AS record_id, o_custkey FROM orders)
    SELECT a.id, a.kind, count(l_orderkey) AS operations, min(c_name) AS wellbore
    FROM a LEFT JOIN lineitem ON a.kind = 'operation' AND l_orderkey = a.record_id LEFT JOIN customer ON l_orderkey IS NOT NULL AND c_custkey = a.o_custkey GROUP BY 1, 2
""")
def polymorphic_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").selectExpr("o_orderkey as id", "case when o_orderkey % 2 = 0 then 'operation' else 'section' end as kind", "o_orderkey as record_id", "o_custkey")
    rows = a.join(table(spark, sf_dir, "lineitem"), F.expr("kind = 'operation' and l_orderkey = record_id"), "left").join(table(spark, sf_dir, "customer"), F.expr("l_orderkey is not null and c_custkey = o_custkey"), "left")
    return rows.groupBy("id", "kind").agg(F.count("l_orderkey").alias("operations"), F.min("c_name").alias("wellbore"))


@query("""
    SELECT count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers,
           (SELECT count(DISTINCT user_id) FROM events) AS users, (SELECT count(DISTINCT o_custkey) FROM orders) AS customers FROM lineitem
""")
def distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Each count is deduplicated by itself: one Expand over all columns would multiply the rows.
    count = lambda t, c, n: table(spark, sf_dir, t).select(c).distinct().agg(F.count(c).alias(n))
    parts = [count("lineitem", "l_orderkey", "orders"), count("lineitem", "l_partkey", "parts"), count("lineitem", "l_suppkey", "suppliers"), count("events", "user_id", "users"), count("orders", "o_custkey", "customers")]
    return reduce(lambda a, b: a.crossJoin(b), parts)


@query("""
    SELECT count(*) AS rows, count(*) FILTER (l_returnflag = 'R') AS returned, count(*) FILTER (l_discount > 0.05) AS discounted,
           count(*) FILTER (l_linestatus = 'O' AND l_quantity > 25) AS open_large, count(*) FILTER (l_quantity > 25) / count(*) AS large_rate FROM lineitem
""")
def count_if_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = lambda test: F.count_if(F.expr(test))
    return table(spark, sf_dir, "lineitem").agg(
        F.count("*").alias("rows"), hit("l_returnflag = 'R'").alias("returned"), hit("l_discount > 0.05").alias("discounted"),
        hit("l_linestatus = 'O' and l_quantity > 25").alias("open_large"), rate(hit("l_quantity > 25"), F.count("*")).alias("large_rate"),
    )


@query("""
    SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45 AND l_returnflag IN ('R', 'A'))
""")
def semi_join_in_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = table(spark, sf_dir, "lineitem").where("l_quantity > 45 and l_returnflag in ('R', 'A')")
    return table(spark, sf_dir, "orders").join(large, F.expr("l_orderkey = o_orderkey"), "left_semi").select("o_orderkey", "o_orderstatus")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti_join_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.expr("l_orderkey = o_orderkey"), "left_anti").select("o_orderkey", "o_custkey")


@query("""
    WITH new AS (SELECT 'operation' AS kind, n_name AS rule, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE n_regionkey END AS record_id FROM nation),
    stored AS (SELECT 'operation' AS kind, n_name AS rule, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE 0 END AS record_id FROM nation WHERE n_nationkey % 2 = 0)
    SELECT * FROM new n WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.kind IS NOT DISTINCT FROM n.kind AND s.rule IS NOT DISTINCT FROM n.rule AND s.record_id IS NOT DISTINCT FROM n.record_id)
""")
def null_safe_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    new = nation.selectExpr("'operation' as kind", "n_name as rule", "case when n_nationkey % 3 = 0 then null else n_regionkey end as record_id")
    stored = nation.where("n_nationkey % 2 = 0").selectExpr("'operation' as kind", "n_name as rule", "case when n_nationkey % 3 = 0 then null else 0 end as record_id")
    return rules.not_stored(new, stored, ["kind", "rule", "record_id"])


@query("""
    SELECT o_orderstatus AS status, count(*) AS orders, count(*) FILTER (o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')) AS known FROM orders GROUP BY 1
""")
def mark_join_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    returned = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    marked = rules.mark_known(table(spark, sf_dir, "orders"), returned, "o_orderkey", "is_known")
    return marked.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("orders"), F.count_if("is_known").alias("known"))


@query("""
    WITH last AS (SELECT l_partkey, arg_max(struct_pack(s := l_suppkey, q := l_quantity), struct_pack(a := l_shipdate, b := l_orderkey, c := l_linenumber, d := l_suppkey, e := l_quantity)) AS r FROM lineitem GROUP BY 1)
    SELECT p_partkey, r.s AS last_supplier, r.q AS last_quantity FROM part LEFT JOIN last ON l_partkey = p_partkey
""")
def lookup_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_quantity", "l_shipdate", "l_orderkey", "l_linenumber")
    last = records.last_wins(rows, "l_partkey", [F.col(c) for c in ("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")])
    return table(spark, sf_dir, "part").join(last, F.expr("p_partkey = l_partkey"), "left").select("p_partkey", F.col("l_suppkey").alias("last_supplier"), F.col("l_quantity").alias("last_quantity"))


@query("""
    WITH c AS (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal > 9900), s AS (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000)
    SELECT 'both' AS kind, k FROM (SELECT k FROM c INTERSECT SELECT k FROM s) UNION ALL SELECT 'either', k FROM (SELECT k FROM c UNION SELECT k FROM s)
    UNION ALL SELECT 'customers_only', k FROM (SELECT k FROM c EXCEPT SELECT k FROM s)
""")
def set_union_intersect_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").where("c_acctbal > 9900").select(F.col("c_nationkey").alias("k"))
    s = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k"))
    tag = lambda df, kind: df.select(F.lit(kind).alias("kind"), "k")
    return tag(c.intersect(s), "both").union(tag(c.union(s).distinct(), "either")).union(tag(c.subtract(s), "customers_only"))


# Intervals and the match decision --------------------------------------------------------------------------------

_INTERVALS = """
    ops AS (SELECT event_id AS operation_id, user_id AS report_id, ts AS op_start, ts + INTERVAL 6 HOUR AS op_end FROM events WHERE event_type = 'view'),
    fails AS (SELECT event_id AS failure_id, user_id AS report_id, ts AS start FROM events WHERE event_type = 'error')"""


def _operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = table(spark, sf_dir, "events").where("event_type = 'view'")
    return views.selectExpr("event_id as operation_id", "user_id as report_id", "ts as op_start", "ts + interval 6 hours as op_end", "1.0D as op_confidence")


def _failures(spark: SparkSession, sf_dir: str, hours: int | None = None) -> DataFrame:
    end = f"ts + interval {hours} hours" if hours else "cast(null as timestamp_ntz)"
    return table(spark, sf_dir, "events").where("event_type = 'error'").selectExpr("event_id as failure_id", "user_id as report_id", "ts as start", f"{end} as end")


@query(f"""
    WITH {_INTERVALS} SELECT failure_id, operation_id FROM fails JOIN ops ON fails.report_id = ops.report_id AND op_start <= start AND start < op_end
""")
def interval_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.interval_join(_failures(spark, sf_dir), _operations(spark, sf_dir), "report_id", "start", "op_start", "op_end").select("failure_id", "operation_id")


@query(f"""
    WITH {_INTERVALS} SELECT failure_id, operation_id FROM fails JOIN ops ON fails.report_id = ops.report_id AND op_start < start + INTERVAL 3 HOUR AND op_end > start
""")
def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.overlap_join(_failures(spark, sf_dir, 3), _operations(spark, sf_dir), "report_id", ("start", "end"), ("op_start", "op_end")).select("failure_id", "operation_id")


@query(f"""
    WITH {_INTERVALS},
    d AS (SELECT failure_id, operation_id, least(abs(epoch_us(start) - epoch_us(op_start)), abs(epoch_us(start) - epoch_us(op_end))) / 60000000.0 AS distance FROM fails JOIN ops USING (report_id)),
    best AS (SELECT *, min(distance) OVER (PARTITION BY failure_id) AS least FROM d WHERE distance <= 240)
    SELECT failure_id, operation_id, round(distance, 6) AS distance, count(*) OVER (PARTITION BY failure_id) AS ties FROM best WHERE distance = least
""")
def nearest_with_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = matching.nearest_join(_failures(spark, sf_dir), _operations(spark, sf_dir), "report_id", "failure_id", "start", "op_start", "op_end", tolerance_minutes=240)
    return near.select("failure_id", "operation_id", F.round("distance", 6).alias("distance"), "ties")


_LATTICE = f"""
    WITH {_INTERVALS},
    spans AS (SELECT *, CASE WHEN failure_id % 2 = 0 THEN start + INTERVAL 2 HOUR END AS finish FROM fails),
    pairs AS (
        SELECT failure_id, operation_id, op_start <= start AND start < op_end AS is_exact, coalesce(op_start < finish AND op_end > start, false) AS is_overlap FROM spans JOIN ops USING (report_id)),
    n AS (SELECT failure_id, count(*) FILTER (is_exact) AS e, count(*) FILTER (is_overlap) AS o FROM pairs GROUP BY 1),
    decided AS (
        SELECT s.failure_id, CASE WHEN n.failure_id IS NULL THEN 'missing_operation_time' WHEN e > 1 THEN 'ambiguous' WHEN o = 1 AND e = 0 THEN 'overlap' WHEN o > 1 THEN 'ambiguous'
               WHEN e = 1 THEN 'exact' ELSE 'unmatched' END AS status,
               CASE WHEN e > 1 THEN 'e' WHEN o = 1 AND e = 0 THEN 'o' WHEN o > 1 THEN 'o' WHEN e = 1 THEN 'e' ELSE 'n' END AS uses
        FROM spans s LEFT JOIN n USING (failure_id))
    SELECT d.failure_id, p.operation_id, d.status FROM decided d
    LEFT JOIN pairs p ON p.failure_id = d.failure_id AND ((uses = 'e' AND is_exact) OR (uses = 'o' AND is_overlap))"""


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _failures(spark, sf_dir, 2).withColumn("end", F.expr("case when failure_id % 2 = 0 then end end"))


@query(_LATTICE)
def match_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.match_failures(_spans(spark, sf_dir), _operations(spark, sf_dir)).select("failure_id", "operation_id", "status")


@query(f"SELECT status, count(DISTINCT failure_id) AS failures FROM ({_LATTICE}) GROUP BY 1")
def match_lattice_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.status_counts(matching.match_failures(_spans(spark, sf_dir), _operations(spark, sf_dir)))


@query("""
    SELECT event_id, last_value(CASE WHEN event_type = 'signup' OR event_type = 'view' THEN event_id END IGNORE NULLS)
           OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM events
""")
def asof_carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("h", F.expr("case when event_type in ('signup', 'view') then event_id end"))
    return matching.carry_forward(rows, "user_id", ["ts", "event_id"], "h", "heading").select("event_id", "heading")


# Robust statistics and trends ------------------------------------------------------------------------------------

_FALLBACK = """
    base AS (SELECT event_id, event_type AS main, CASE WHEN user_id % 7 = 0 THEN NULL ELSE CAST(user_id % 40 AS VARCHAR) END AS sub, value FROM events),
    support AS (SELECT main, sub, count(*) AS n FROM base GROUP BY 1, 2),
    grouped AS (SELECT b.*, CASE WHEN coalesce(s.n, 0) >= 30 THEN coalesce(b.sub, 'unknown') ELSE '*' END AS grp
        FROM base b LEFT JOIN support s ON s.main = b.main AND s.sub = coalesce(b.sub, 'unknown')),
    med AS (SELECT main, grp, count(*) AS n, median(value) AS m, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM grouped GROUP BY 1, 2 HAVING count(*) >= 30),
    mads AS (SELECT g.main, g.grp, median(abs(value - m)) AS mad FROM grouped g JOIN med USING (main, grp) GROUP BY 1, 2),
    scored AS (SELECT g.*, n, m, q1, q3, (value - m) / greatest(mad * 1.4826, 0.000001) AS z FROM grouped g JOIN med USING (main, grp) JOIN mads USING (main, grp))"""


def _grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "events").selectExpr("event_id", "event_type as main", "case when user_id % 7 = 0 then null else cast(user_id % 40 as string) end as sub", "value")
    return robust.fallback_groups(base, "main", "sub")


@query(f"""
    WITH {_FALLBACK}
    SELECT event_id, grp AS group_sub, round(q1, 6) AS q1, round(q3, 6) AS q3, round(z, 6) AS z,
           CASE WHEN abs(z) >= 8 THEN 'high' WHEN abs(z) >= 5 THEN 'medium' ELSE 'low' END AS severity, round(least(0.99, 0.70 + least(abs(z), 10) / 40), 6) AS confidence
    FROM scored WHERE abs(z) >= 3.5
""")
def robust_z_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    far = robust.outliers(robust.robust_scores(_grouped(spark, sf_dir), "value", ["main", "group_sub"]))
    r = lambda c: F.round(c, 6).alias(c)
    return far.select("event_id", "group_sub", r("q1"), r("q3"), r("z"), "severity", r("confidence"))


@query("""
    SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) < 150
""")
def small_group_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robust.small_groups(table(spark, sf_dir, "lineitem"), ["l_suppkey", "l_returnflag"], min_group=150)


@query()
def isolation_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = robust.robust_scores(_grouped(spark, sf_dir), "value", ["main", "group_sub"])
    found = robust.isolation_candidates(scored, ["main", "group_sub"], "event_id", version="v1")
    return found.select("event_id", "main", "group_sub", F.round("z", 6).alias("z"), "severity", "candidate_key")


@query("""
    WITH o AS (SELECT l_orderkey AS operation_id, l_linenumber AS line, CASE WHEN l_returnflag = 'R' THEN 'fail' ELSE 'ok' END AS state, lower(p_type) AS sub, p_name AS remark, l_quantity - 1 AS hours
        FROM lineitem JOIN part ON p_partkey = l_partkey)
    SELECT rule, count(*) AS candidates FROM (
        SELECT 'operation_state_fail' AS rule FROM o WHERE state = 'fail' UNION ALL SELECT 'promo' FROM o WHERE sub = 'promo' OR remark ILIKE '%promo%'
        UNION ALL SELECT 'negative_operation_duration' FROM o WHERE hours < 1) GROUP BY 1
""")
def rule_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.expr("p_partkey = l_partkey"))
    operations = rows.selectExpr("l_orderkey as operation_id", "case when l_returnflag = 'R' then 'fail' else 'ok' end as state", "lower(p_type) as sub_activity", "p_name as remark", "l_quantity - 1 as hours")
    own = {
        "operation_state_fail": rules.OPERATION_RULES["operation_state_fail"], "promo": ("sub_activity = 'promo' or lower(remark) like '%promo%'", "high", 0.9),
        "negative_operation_duration": ("hours < 1", "high", 0.9),
    }
    return rules.operation_candidates(operations, own).groupBy("rule").agg(F.count("*").alias("candidates"))


_MONTHS = """
    m AS (SELECT o_orderpriority AS series, CAST(date_trunc('month', o_orderdate) AS DATE) AS day, median(o_totalprice) AS y FROM orders GROUP BY 1, 2),
    p AS (SELECT series, CAST(date_diff('day', DATE '0001-01-01', day) + 1 AS DOUBLE) AS x, y FROM m)"""


def _monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").withColumn("month", F.date_trunc("month", F.col("o_orderdate")).cast("timestamp_ntz"))
    return trend.daily_medians(rows.withColumnRenamed("o_orderpriority", "series"), ["series"], "month", "o_totalprice")


@query(f"""
    WITH {_MONTHS},
    s AS (SELECT a.series, median((b.y - a.y) / (b.x - a.x)) AS slope FROM p a JOIN p b ON a.series = b.series AND a.x < b.x GROUP BY 1),
    f AS (SELECT series, slope, median(y) - slope * median(x) AS intercept, count(*) AS n FROM p JOIN s USING (series) GROUP BY series, slope),
    r AS (SELECT series, y - slope * x - intercept AS e FROM p JOIN f USING (series)),
    q AS (SELECT series, median(e) AS me FROM r GROUP BY 1)
    SELECT f.series, n, round(slope, 6) AS slope, round(intercept, 3) AS intercept, round(median(abs(e - me)), 4) AS residual_mad
    FROM f JOIN r USING (series) JOIN q USING (series) GROUP BY f.series, n, slope, intercept
""")
def theil_sen_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = trend.theil_sen(_monthly(spark, sf_dir), ["series"])
    return fit.select("series", "n", F.round("slope", 6).alias("slope"), F.round("intercept", 3).alias("intercept"), F.round("residual_mad", 4).alias("residual_mad"))


@query(f"""
    WITH {_MONTHS},
    k AS (SELECT series, rank() OVER (PARTITION BY series ORDER BY x) + (count(*) OVER (PARTITION BY series, x) - 1) / 2.0 AS rx,
          rank() OVER (PARTITION BY series ORDER BY y) + (count(*) OVER (PARTITION BY series, y) - 1) / 2.0 AS ry FROM p)
    SELECT series, round(corr(rx, ry), 6) AS rho FROM k GROUP BY 1
""")
def spearman_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trend.spearman(_monthly(spark, sf_dir), ["series"], p_value=False).select("series", F.round("rho", 6).alias("rho"))


@query("""
    WITH o AS (SELECT o_orderpriority AS series, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 3 = 0 THEN 'manual' WHEN o_orderstatus = 'F' THEN 'data_quality_exclusion'
        WHEN o_orderkey % 11 = 0 THEN 'invalid_or_missing_date' WHEN o_orderkey % 13 = 0 THEN 'invalid_or_missing_value' WHEN o_orderkey % 17 = 0 THEN 'unknown_unit' END AS reason FROM orders)
    SELECT series, reason, count(*) AS n FROM o WHERE reason IS NOT NULL GROUP BY 1, 2
""")
def trend_exclusion_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr(
        "o_orderpriority as series", "o_orderstatus <> 'F' as included", "case when o_orderstatus = 'F' and o_orderkey % 3 = 0 then 'manual' end as given",
        "case when o_orderkey % 11 <> 0 then o_orderdate end as observed_at", "case when o_orderkey % 13 <> 0 then o_totalprice end as value", "case when o_orderkey % 17 = 0 then ' Unknown ' else 'sg' end as unit",
    )
    reason = trend.exclusion_reason(*(F.col(c) for c in ("included", "given", "observed_at", "value", "unit")))
    return rows.withColumn("reason", reason).where("reason is not null").groupBy("series", "reason").agg(F.count("*").alias("n"))


@query("""
    WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS row_index, CASE WHEN l_linenumber % 3 > 0 THEN l_extendedprice END AS depth FROM lineitem),
    h AS (SELECT l_orderkey, l_returnflag AS activity, CAST(sum(CAST(l_quantity AS DECIMAL(18, 4))) AS DOUBLE) AS hours, min(row_index) AS first_row FROM l GROUP BY 1, 2),
    t AS (SELECT l_orderkey, arg_max(activity, struct_pack(a := hours, b := -first_row)) AS main_activity, max(hours) AS main_hours FROM h GROUP BY 1),
    d AS (SELECT l_orderkey, count(depth) AS n_depths, round(arg_max(depth, row_index) - arg_min(depth, row_index), 2) AS progress FROM l WHERE depth IS NOT NULL GROUP BY 1)
    SELECT t.l_orderkey AS report_id, main_activity, round(main_hours, 2) AS main_hours, n_depths, CASE WHEN n_depths >= 2 THEN progress END AS progress FROM t LEFT JOIN d USING (l_orderkey)
""")
def daily_summary_first_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    rows = table(spark, sf_dir, "lineitem").withColumn("row_index", F.row_number().over(order) - 1).withColumn("depth", F.expr("case when l_linenumber % 3 > 0 then l_extendedprice end"))
    rows = rows.withColumnRenamed("l_orderkey", "report_id")
    best = summary.main_activity(summary.hours_by_activity(rows, ["report_id"], "l_returnflag", "l_quantity", "row_index"), ["report_id"])
    depths = summary.depth_progress(rows, ["report_id"], "row_index", "depth")
    return best.join(depths, "report_id", "left").select("report_id", "main_activity", F.round("main_hours", 2).alias("main_hours"), "n_depths", "progress")


# Logs, sections, chunks ------------------------------------------------------------------------------------------


@query("""
    SELECT conv_id, arg_max(role, turn) AS status, arg_max(role, turn) = 'assistant' AS validated, count(*) AS decisions FROM conversations GROUP BY 1
""")
def latest_status_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    newest = records.latest(log, "conv_id", [F.col("turn")])
    n = log.groupBy("conv_id").agg(F.count("*").alias("decisions"))
    return newest.join(n, "conv_id").select("conv_id", F.col("role").alias("status"), (F.col("role") == "assistant").alias("validated"), "decisions")


@query(r"""
    WITH d AS (SELECT source, doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 5 AS batch_no FROM documents)
    SELECT source, CAST(batch_no AS BIGINT) AS batch_no, count(*) AS n_rows, sha256(string_agg(t, chr(10) ORDER BY doc_id)) AS content_hash FROM d GROUP BY 1, 2
""")
def chunk_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches = chunks.batch_texts(table(spark, sf_dir, "documents"), ["source"], ["doc_id"], chunks.BATCH["operation"], text.collapse(F.col("text")))
    return batches.select("source", "batch_no", "n_rows", F.sha2("text", 256).alias("content_hash"))


@query(r"""
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
    h AS (SELECT *, CASE WHEN regexp_matches(line, '^[^ ]+( [^ ]+)?\.$') THEN line END AS heading FROM l),
    s AS (SELECT *, count(heading) OVER (PARTITION BY doc_id ORDER BY line_no) AS section_no FROM h)
    SELECT doc_id, section_no, max(heading) AS heading, count(*) AS n_lines, sha256(string_agg(line, chr(10) ORDER BY line_no)) AS text_hash FROM s GROUP BY 1, 2
""")
def section_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = chunks.lines(table(spark, sf_dir, "documents"), ["doc_id"], "text")
    heading = F.when(F.col("line").rlike(r"^[^ ]+( [^ ]+)?\.$"), F.col("line"))
    sections = chunks.split_sections(numbered, ["doc_id"], ["line_no"], "line", heading)
    return sections.select("doc_id", "section_no", "heading", "n_lines", F.sha2("text", 256).alias("text_hash"))


_TOKENS = r"regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}_]{2,}')"
_GRAMS = "unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])))"
_WORD_INDEX = rf"""
    dt AS (SELECT doc_id, {_TOKENS} AS t FROM documents), qt AS (SELECT item_id, {_TOKENS} AS t FROM benchmark),
    g AS (SELECT doc_id, {_GRAMS} AS term FROM dt),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM g GROUP BY 1, 2),
    df AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY 1 ORDER BY total DESC, term LIMIT 25000),
    w AS (SELECT doc_id, term, df, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term)),
    norms AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY 1),
    idx AS (SELECT doc_id, term, df, w / norm AS weight FROM w JOIN norms USING (doc_id)),
    qg AS (SELECT item_id, {_GRAMS} AS term FROM qt),
    qtf AS (SELECT item_id, term, count(*) AS tf FROM qg GROUP BY 1, 2),
    qw AS (SELECT item_id, term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS w FROM qtf JOIN df USING (term)),
    qn AS (SELECT item_id, sqrt(sum(w * w)) AS norm FROM qw GROUP BY 1),
    q AS (SELECT item_id, term, w / norm AS q FROM qw JOIN qn USING (item_id)),
    scored AS (SELECT item_id, doc_id, round(sum(weight * q), 6) AS score FROM idx JOIN q USING (term) GROUP BY 1, 2)"""


def _word_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, queries = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    index = search.build_index(search.word_counts(docs, "doc_id", "text"), "doc_id", docs.count(), cap=search.WORD_CAP)
    vector = search.query_vector(index, search.word_counts(queries, "item_id", "text"), "item_id")
    return search.cosine(index, "doc_id", vector, "item_id").withColumn("score", F.round("score", 6))


@query(f"""
    WITH {_WORD_INDEX}, r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM scored WHERE score >= 0.035)
    SELECT item_id, doc_id, score, place FROM r WHERE place <= 10
""")
def topk_search_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    hits = _word_scores(spark, sf_dir).where(F.col("score") >= search.WORD_LEAST).withColumn("place", F.row_number().over(best))
    return hits.where("place <= 10").select("item_id", "doc_id", "score", "place")


# Queries besides the benchmark's, which are whole: parts of words, for the second stage.
_SHORT = ("erou", "tiedi", "quell", "thbl", "tionl", "eroun dth")


@query()
def two_stage_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = _values(spark, [(-1 - i, t) for i, t in enumerate(_SHORT)], "item_id long, text string")
    queries = table(spark, sf_dir, "benchmark").select("item_id", "text").union(short)
    hits = search.two_stage(table(spark, sf_dir, "documents"), "doc_id", "text", queries, "item_id", "text", most=10).withColumn("score", F.round("score", 6))
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")  # rounded, so that equal scores are ties whatever the order of their sums
    return hits.withColumn("place", F.row_number().over(best)).where("place <= 10").select("item_id", "doc_id", "score", "stage")


@query("""
    WITH r AS (SELECT source, doc_id, length(substr(text, 1, 1000)) AS n, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS place FROM documents),
    u AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY place) AS upto FROM r)
    SELECT source, doc_id, place, CAST(upto AS BIGINT) AS upto FROM u WHERE upto <= 7000 AND place <= 12
""")
def evidence_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").withColumn("n", F.length(F.substring("text", 1, 1000)))
    return chunks.within_budget(rows, ["source"], [F.desc("n_chars"), F.asc("doc_id")], "n").select("source", "doc_id", "place", "upto")


# Normalisation of literals ---------------------------------------------------------------------------------------


def _values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


_CELLS = ("-999.99", "-999.9", "8,8", " 1 234.5 ", "1,234.5", "abc", "", "   ", None, "+7", "-0.5", "1e3", ".5", "5.", "--1")
_CELL_SQL = ", ".join(f"({i}, {'NULL' if c is None else repr(c)})" for i, c in enumerate(_CELLS))
_NUMBER_SQL = r"""
    trimmed AS (SELECT *, trim(raw) AS t, replace(trim(raw), ' ', '') AS p FROM cells),
    packed AS (SELECT *, CASE WHEN contains(p, ',') AND NOT contains(p, '.') THEN replace(p, ',', '.') ELSE p END AS n FROM trimmed),
    parsed AS (SELECT *, CASE WHEN regexp_matches(n, '^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN TRY_CAST(n AS DOUBLE) END AS v FROM packed),
    numbers AS (SELECT *, CASE WHEN v NOT IN (-999.99, -999.9) AND t <> '' THEN v END AS value,
        CASE WHEN t IS NULL OR t = '' THEN 'source_blank' WHEN v IS NULL THEN 'not_numeric' WHEN v IN (-999.99, -999.9) THEN 'source_sentinel' END AS missing_reason FROM parsed)"""


@query(f"""
    WITH cells AS (SELECT * FROM (VALUES {_CELL_SQL}) v(id, raw) UNION ALL SELECT event_id + 1000, json_extract_string(props, '$.k') FROM events), {_NUMBER_SQL}
    SELECT CAST(id AS BIGINT) AS id, value, missing_reason FROM numbers
""")
def normalize_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _values(spark, list(enumerate(_CELLS)), "id long, raw string")
    cells = cells.union(table(spark, sf_dir, "events").select(F.col("event_id") + 1000, F.get_json_object("props", "$.k")))
    n = cells.withColumn("n", text.number(F.col("raw")))
    return n.select("id", "n.value", "n.missing_reason")


_LABELS = ("Plug & Abandon", "plug_abandon", "Formation\nEvaluation", "DRILLING", "novel operation", None, "", "Moving ")


@query("""
    WITH l AS (SELECT CAST(p_partkey AS BIGINT) AS id, CASE p_partkey % 8 WHEN 0 THEN 'Plug & Abandon' WHEN 1 THEN 'plug_abandon' WHEN 2 THEN 'Formation' || chr(10) || 'Evaluation' WHEN 3 THEN 'DRILLING'
        WHEN 4 THEN 'novel operation' WHEN 6 THEN '' WHEN 7 THEN 'Moving ' END AS raw FROM part),
    k AS (SELECT *, nullif(trim(regexp_replace(lower(replace(raw, chr(10), '')), '[^a-z0-9]+', ' ', 'g')), '') AS key FROM l),
    n AS (SELECT *, CASE WHEN key IN ('completion', 'drilling', 'formation evaluation', 'interruption', 'moving', 'plug abandon', 'workover') THEN replace(key, ' ', '_') END AS canonical,
        CASE key WHEN 'formationevaluation' THEN 'formation_evaluation' WHEN 'plug abandon' THEN 'plug_abandon' WHEN 'plug and abandon' THEN 'plug_abandon' WHEN 'plugabandon' THEN 'plug_abandon' END AS alias FROM k)
    SELECT id, coalesce(canonical, alias, 'unknown') AS label, CASE WHEN canonical IS NOT NULL THEN 'canonical' WHEN alias IS NOT NULL THEN 'alias' ELSE 'unknown' END AS method,
           CAST(CASE WHEN canonical IS NOT NULL THEN 1.0 WHEN alias IS NOT NULL THEN 0.99 ELSE 0 END AS DOUBLE) AS confidence FROM n
""")
def normalize_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.get(F.array(*map(F.lit, _LABELS)), (F.col("p_partkey") % len(_LABELS)).cast("int"))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), taxonomy.normalize_main(raw).alias("n"))
    return rows.select("id", "n.label", "n.method", "n.confidence")


_CLOCKS = (("23:00", "00:00"), ("08:00", "12:30"), ("07:15", "07:15"), ("24:00", "01:00"), ("", "01:00"), (None, None), ("9:5", "10:00"), ("10:00:30", "10:01:00"))
_CLOCK_SQL = ", ".join(f"({i}, {'NULL' if a is None else repr(a)}, {'NULL' if b is None else repr(b)})" for i, (a, b) in enumerate(_CLOCKS))


@query(rf"""
    WITH c AS (SELECT * FROM (VALUES {_CLOCK_SQL}) v(id, a, b)),
    s AS (SELECT *, CASE WHEN regexp_matches(a, '^([01][0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9])?$') THEN epoch(CAST(a AS TIME)) END AS x,
        CASE WHEN regexp_matches(b, '^([01][0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9])?$') THEN epoch(CAST(b AS TIME)) END AS y FROM c),
    t AS (SELECT *, CASE WHEN (x IS NULL OR y IS NULL) AND (coalesce(a, '') = '' OR coalesce(b, '') = '') THEN 'missing_operation_time' WHEN x IS NULL OR y IS NULL THEN 'invalid_operation_time'
        WHEN y < x THEN 'midnight_rollover' WHEN x = y THEN 'equal_time_ambiguous' ELSE 'valid' END AS status FROM s)
    SELECT CAST(id AS BIGINT) AS id, status, strftime(TIMESTAMP '2008-06-13' + to_seconds(CAST(CASE WHEN status IN ('valid', 'midnight_rollover', 'equal_time_ambiguous') THEN x END AS BIGINT)), '%Y-%m-%dT%H:%M:%S') AS start,
           strftime(TIMESTAMP '2008-06-13' + to_seconds(CAST(CASE status WHEN 'valid' THEN y WHEN 'midnight_rollover' THEN y + 86400 END AS BIGINT)), '%Y-%m-%dT%H:%M:%S') AS finish,
           round((y - x + CASE WHEN y <= x THEN 86400 ELSE 0 END) / 3600, 4) AS hours FROM t
""")
def parse_clock_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _values(spark, [(i, a, b) for i, (a, b) in enumerate(_CLOCKS)], "id long, a string, b string")
    period = F.lit("2008-06-13 00:00:00").cast("timestamp_ntz")
    rows = rows.withColumn("i", temporal.operation_interval(F.col("a"), F.col("b"), period))
    return rows.select("id", "i.status", temporal.iso(F.col("i.start")).alias("start"), temporal.iso(F.col("i.end")).alias("finish"), temporal.duration_hours(F.col("a"), F.col("b")).alias("hours"))


_NAMES = ("15_9_F_11_A_2008_01_02.pdf", "15_9_19_A_1997_07_25.pdf", "data/15_9_F_4_2008_02_30.pdf", "notes.pdf", "15_9_2008_01_02.pdf", "c:\\in\\15_9_F_1_2013_12_31.PDF")
_NAME_SQL = ", ".join(f"({i}, '{n}')" for i, n in enumerate(_NAMES))


@query(rf"""
    WITH v AS (SELECT id, regexp_extract(path, '([^/\\]+)$', 1) AS name FROM (VALUES {_NAME_SQL}) t(id, path)),
    p AS (SELECT id, string_split(regexp_extract(name, '(?i)^(.+)_(\d{{4}})_(\d{{2}})_(\d{{2}})\.pdf$', 1), '_') AS k,
          TRY_CAST(regexp_replace(regexp_extract(name, '(?i)_(\d{{4}}_\d{{2}}_\d{{2}})\.pdf$', 1), '_', '-', 'g') AS DATE) AS day FROM v),
    w AS (SELECT id, day, CASE WHEN len(k) >= 4 AND upper(k[3]) = 'F' THEN k[1] || '/' || k[2] || '-F-' || k[4] ELSE k[1] || '/' || k[2] || '-' || k[3] END AS head,
          array_to_string(k[CASE WHEN len(k) >= 4 AND upper(k[3]) = 'F' THEN 5 ELSE 4 END:], ' ') AS tail, len(k) AS n FROM p)
    SELECT CAST(id AS BIGINT) AS id, CASE WHEN day IS NOT NULL AND n >= 3 THEN upper(trim(head || ' ' || tail)) END AS wellbore, CASE WHEN day IS NOT NULL AND n >= 3 THEN CAST(day AS VARCHAR) END AS report_date FROM w
""")
def filename_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _values(spark, list(enumerate(_NAMES)), "id long, path string").withColumn("i", text.filename_identity(F.col("path")))
    return rows.select("id", "i.wellbore", F.col("i.report_date").cast("string").alias("report_date"))


def _sql_list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


@query(rf"""
    WITH f AS (SELECT doc_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS t FROM documents),
    w AS (SELECT doc_id, length(t) - length(translate(t, '{text.AZ_LETTERS}', '')) AS letters, list_distinct(regexp_extract_all(t, '\p{{L}}+')) AS k FROM f),
    s AS (SELECT doc_id, letters + 2 * len(list_intersect(k, {_sql_list(text.AZ_WORDS)})) AS az, len(list_intersect(k, {_sql_list(text.EN_WORDS)})) AS en FROM w)
    SELECT doc_id, CASE WHEN az > 0 AND en > 0 THEN 'mixed' WHEN az > 0 THEN 'az' ELSE 'en' END AS language FROM s
""")
def language_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.language(F.col("text")).alias("language"))


# Questions, guard, grounding -------------------------------------------------------------------------------------

QUESTIONS = (
    "What was the main activity on 15/9-F-11 on 2008-01-02?", "Show the daily summary for 15/9-19 A", "How many operations are there by wellbore?", "Which equipment failure had the longest downtime?",
    "Pressure trend of the plots", "Are these related to the same well?", "Show unusual duration anomalies", "What is the current oil price?", "Completed activities for 15/9-F-4", "Mud weight of the drilling fluid", "stuck pipe problems",
    "Compare wellbore activities", "Hansı avadanlıq nasazlıq olub?",
)


@query()
def plan_intent_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(i, p.intent, p.confidence, p.language, p.wellbore, str(p.date_from) if p.date_from else None, ",".join(p.terms)) for i, p in enumerate(map(planner.analyze, QUESTIONS))]
    return _values(spark, rows, "id long, intent string, confidence double, language string, wellbore string, date_from string, terms string")


_ANSWERS = (
    ("a fact occurred", "structured_x", 0, 0, 0, False, [], ""), ("they are the same well", "structured_mapping", 0, 1, 0, False, [], ""), ("12 psi measured", "plot_sql", 1, 1, 0, True, [], "12"),
    ("All failures occurred during drilling", "structured_equipment_failures", 3, 1, 1, False, [], ""), ("see other.pdf", "x", 1, 1, 0, False, ["report.pdf"], ""), ("see report.pdf", "x", 1, 1, 0, False, ["report.pdf"], "report"),
    ("There were 999 failures.", "x", 1, 1, 0, False, [], "failure_count 2"), ("There were 2 failures, +1,5 h.", "x", 1, 1, 0, False, [], "2 1,5"),
)
_REJECTED = ("fact_without_evidence", "mapping_unresolved", "pressure_unit_unknown", "matches_unresolved", "foreign_citation", None, "unsupported_number", None)


@query("SELECT * FROM (VALUES " + ", ".join(f"(CAST({i} AS BIGINT), {'NULL' if r is None else repr(r)})" for i, r in enumerate(_REJECTED)) + ") v(id, rejection)")
def grounding_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _values(spark, [(i, *a) for i, a in enumerate(_ANSWERS)], "id long, answer string, route string, n_rows long, n_evidence long, unresolved long, unit_unknown boolean, files array<string>, facts string")
    return grounding.verify(rows.withColumn("deterministic", F.lit(""))).select("id", "rejection")


#: What the guarded tables show, and statements with the limit that they run under, or none.
_GUARDED = {"reports": {"id", "wellbore", "period_end"}, "operations": {"id", "report_id", "main_activity", "duration_hours"}}
STATEMENTS: tuple[tuple[str, int | None], ...] = (
    ("SELECT wellbore FROM reports", 200), ("SELECT wellbore FROM reports LIMIT 99999", 1000), ("SELECT wellbore FROM reports LIMIT 5;", 5), ("DELETE FROM reports", None), ("SELECT 1; SELECT 2", None),
    ("SELECT * FROM secrets", None), ("DROP TABLE reports", None), ("WITH r AS (SELECT wellbore FROM reports) SELECT wellbore FROM r", 200), ("SELECT wellbore FROM reports UNION SELECT main_activity FROM operations", 200),
    ("INSERT INTO reports VALUES (1)", None), ("SELECT wellbore FROM reports WHERE id IN (SELECT id FROM secrets)", None), ("SELECT secret AS secret FROM reports", None), ("SELECT duration_hours FROM reports", None),
    ("SELECT reflect('java.lang.System', 'getProperty', 'user.home')", None), ("SELECT id FROM range(100)", None), ("SELECT * FROM reports", None), ("SELECT count(*) AS n, avg(duration_hours) AS h FROM operations GROUP BY main_activity", 200),
    ("SELECT r.wellbore AS w, sum(o.duration_hours) AS h FROM reports r JOIN operations o ON o.report_id = r.id GROUP BY r.wellbore ORDER BY h DESC LIMIT 10", 10), ("SELECT r.main_activity FROM reports r JOIN operations o ON o.report_id = r.id", None),
    ("SELECT input_file_name() FROM reports", None), ("SELECT wellbore FROM reports LIMIT 0", 1), ("SELECT wellbore FROM reports LIMIT -3", None), ("SELECT wellbore AS secret FROM reports ORDER BY secret", 200), ("SELECT id FROM parquet.`/tmp/x`", None),
)


@query("SELECT * FROM (VALUES " + ", ".join(f"(CAST({i} AS BIGINT), {limit is not None}, CAST({'NULL' if limit is None else limit} AS INTEGER))" for i, (_, limit) in enumerate(STATEMENTS)) + ") v(id, allowed, applied_limit)")
def sql_guard_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for i, (statement, _) in enumerate(STATEMENTS):
        try:
            rows.append((i, True, sql_guard.guard(spark, statement, set(_GUARDED), _GUARDED).limit))
        except sql_guard.Refused:
            rows.append((i, False, None))
    return _values(spark, rows, "id long, allowed boolean, applied_limit int")


# Classification and evaluation -----------------------------------------------------------------------------------


@query(r"""
    WITH n AS (SELECT trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS t, quality, toxic, count(*) AS n, min(doc_id) AS first_id FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2, 3),
    r AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY n DESC, quality, toxic) AS k FROM n)
    SELECT t AS text, quality, toxic, n AS votes, first_id AS row_id FROM r WHERE k = 1
""")
def majority_label_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The texts are grouped by a hash and joined back by the winner's id, so that they are moved once.
    docs, whole = table(spark, sf_dir, "documents"), text.fold(F.col("text"))
    rows = docs.select("doc_id", F.sha2(whole, 256).alias("key")).join(table(spark, sf_dir, "labels"), "doc_id")
    best = textclass.majority_labels(rows, "key", ["quality", "toxic"], "doc_id")
    return best.join(docs, F.expr("row_id = doc_id")).select(whole.alias("text"), "quality", "toxic", "votes", "row_id")


_WORDS_SQL = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_/.\-]+')"


@query(rf"""
    WITH a AS (SELECT item_id AS id, t, count(*) AS n FROM (SELECT item_id, unnest({_WORDS_SQL}) AS t FROM benchmark) GROUP BY 1, 2),
    b AS (SELECT doc_id AS id, t, count(*) AS n FROM (SELECT doc_id, unnest({_WORDS_SQL}) AS t FROM documents WHERE doc_id IN (SELECT item_id FROM benchmark)) GROUP BY 1, 2),
    s AS (SELECT coalesce(a.id, b.id) AS id, sum(least(coalesce(a.n, 0), coalesce(b.n, 0))) AS hit, sum(coalesce(a.n, 0)) AS expected, sum(coalesce(b.n, 0)) AS found FROM a FULL JOIN b ON a.id = b.id AND a.t = b.t GROUP BY 1)
    SELECT id, round(CASE WHEN found > 0 THEN hit / found ELSE 0 END, 9) AS precision, round(CASE WHEN expected > 0 THEN hit / expected ELSE 0 END, 9) AS recall FROM s
""")
def token_multiset_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Each item is scored against the document of its id; documents without an item are not scored.
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text").join(items, "id", "left_semi")
    return quality.token_scores(items, docs, "id", "text").select("id", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


@query("""
    WITH c AS (SELECT CAST(quality AS VARCHAR) AS actual, CAST(CASE WHEN n_chars % 3 = 0 THEN 1 - quality ELSE quality END AS VARCHAR) AS predicted, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2),
    l AS (SELECT actual AS label FROM c UNION SELECT predicted FROM c),
    m AS (SELECT label, coalesce((SELECT sum(n) FROM c WHERE actual = label), 0) AS support, coalesce((SELECT sum(n) FROM c WHERE predicted = label), 0) AS guessed, coalesce((SELECT sum(n) FROM c WHERE actual = label AND predicted = label), 0) AS hits FROM l)
    SELECT label, CAST(support AS BIGINT) AS support, round(CASE WHEN guessed > 0 THEN hits / guessed ELSE 0 END, 9) AS precision, round(CASE WHEN support > 0 THEN hits / support ELSE 0 END, 9) AS recall,
           round(2 * hits / (guessed + support), 9) AS f1 FROM m
""")
def confusion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    rows = rows.selectExpr("cast(quality as string) as a", "cast(case when n_chars % 3 = 0 then 1 - quality else quality end as string) as p")
    r = lambda c: F.round(c, 9).alias(c)
    return textclass.class_metrics(textclass.confusion(rows, "a", "p")).select("label", "support", r("precision"), r("recall"), r("f1"))


@query(rf"""
    WITH cells AS (SELECT event_id AS id, unnest([CAST(value AS VARCHAR), CASE WHEN event_id % 5 = 0 THEN '-999.99' ELSE '1' END, CASE WHEN event_id % 7 = 0 THEN '-999,9' ELSE 'x' END]) AS raw FROM events), {_NUMBER_SQL}
    SELECT id, CAST(count(*) FILTER (missing_reason = 'source_sentinel') AS INTEGER) AS sentinels FROM numbers GROUP BY 1
""")
def json_array_cond_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = F.array(F.col("value").cast("string"), F.expr("case when event_id % 5 = 0 then '-999.99' else '1' end"), F.expr("case when event_id % 7 = 0 then '-999,9' else 'x' end"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), text.sentinel_cells(cells).alias("sentinels"))


# Plots, runs, hashes, pages --------------------------------------------------------------------------------------


@query("""
    WITH f AS (SELECT l_returnflag AS plot, l_linestatus AS axis, count(*) AS n, regr_slope(l_extendedprice, l_quantity) AS s, regr_intercept(l_extendedprice, l_quantity) AS b,
        max(l_quantity) - min(l_quantity) AS reach, max(l_extendedprice) - min(l_extendedprice) AS span FROM lineitem GROUP BY 1, 2),
    r AS (SELECT l_returnflag AS plot, l_linestatus AS axis, sqrt(avg((l_extendedprice - s * l_quantity - b) ** 2)) AS rmse FROM lineitem JOIN f ON plot = l_returnflag AND axis = l_linestatus GROUP BY 1, 2)
    SELECT plot, axis, n, round(s, 4) AS slope, round(b, 3) AS intercept, round(rmse, 3) AS rmse FROM f JOIN r USING (plot, axis) WHERE reach >= 5 AND span <> 0
""")
def axis_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumnsRenamed({"l_returnflag": "plot", "l_linestatus": "axis"})
    fit = plots.fit_axis(rows, ["plot", "axis"], "l_quantity", "l_extendedprice")
    return fit.select("plot", "axis", "n", F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"), F.round("rmse", 3).alias("rmse"))


@query("""
    WITH p AS (SELECT p_partkey, p_retailprice AS x, CASE WHEN p_size % 4 > 0 THEN 950 + p_size END AS low, CASE WHEN p_size % 3 > 0 THEN 1200 END AS base, CASE WHEN p_size % 5 > 0 THEN 1500 END AS high, CASE WHEN p_size % 2 > 0 THEN 1700 END AS virgin FROM part)
    SELECT band, count(*) AS n FROM (SELECT CASE WHEN x < low THEN 'below_min' WHEN x < base THEN 'between_min_base' WHEN x <= high THEN 'between_base_max' WHEN x <= virgin THEN 'between_max_virgin'
        WHEN x > virgin THEN 'above_virgin' WHEN x > high THEN 'above_max' ELSE 'unclassified' END AS band FROM p) GROUP BY 1
""")
def band_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    curves = ("case when p_size % 4 > 0 then 950 + p_size end", "case when p_size % 3 > 0 then 1200 end", "case when p_size % 5 > 0 then 1500 end", "case when p_size % 2 > 0 then 1700 end")
    return table(spark, sf_dir, "part").select(scores.band(F.col("p_retailprice"), *map(F.expr, curves)).alias("band")).groupBy("band").agg(F.count("*").alias("n"))


@query("""
    WITH d AS (SELECT DISTINCT user_id, CAST(date_diff('day', TIMESTAMP '2024-01-01', ts) AS BIGINT) AS day FROM events), r AS (SELECT *, day - row_number() OVER (PARTITION BY user_id ORDER BY day) AS run FROM d)
    SELECT user_id, min(day) AS first, max(day) AS last, count(*) AS n FROM r GROUP BY user_id, run
""")
def gaps_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long")
    return records.islands(table(spark, sf_dir, "events").select("user_id", day.alias("day")), ["user_id"], "day")


@query("SELECT source, sha256(string_agg(sha256(text), chr(10) ORDER BY doc_id)) AS sha256 FROM documents GROUP BY 1")
def hash_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = table(spark, sf_dir, "documents").select("source", "doc_id", F.sha2("text", 256).alias("h"))
    return records.ordered_hash(hashed, ["source"], "doc_id", "h")


@query(r"""
    WITH p AS (SELECT page_id % 20 AS document_id, length(html) AS chars, length(regexp_replace(html, '[^ -~]', '', 'g')) / greatest(length(html), 1) AS printable, (page_id % 7) / 6.0 AS image_share FROM pages),
    r AS (SELECT document_id, CASE WHEN (chars >= 80 AND printable >= 0.75 AND image_share < 0.95) OR (chars > 0 AND image_share = 0 AND printable >= 0.6) THEN 'native' ELSE 'ocr' END AS route FROM p)
    SELECT CAST(document_id AS BIGINT) AS document_id, count(*) AS pages, count(*) FILTER (route = 'native') AS native_pages,
           CASE WHEN count(*) FILTER (route = 'native') = count(*) THEN 'digital' WHEN count(*) FILTER (route = 'native') = 0 THEN 'scanned' ELSE 'hybrid' END AS kind FROM r GROUP BY 1
""")
def page_routing_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    printable = F.length(F.regexp_replace("html", "[^ -~]", "")) / F.greatest(F.length("html"), F.lit(1))
    rows = table(spark, sf_dir, "pages").select((F.col("page_id") % 20).alias("document_id"), quality.page_route(F.length("html"), printable, (F.col("page_id") % 7) / 6).alias("route"))
    return quality.document_route(rows, ["document_id"], "route")


@query("""
    WITH k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations)
    SELECT conv_id, count(*) AS n_turns, string_agg(role, ',' ORDER BY turn) AS roles, sha256(arg_max(text, turn) FILTER (role = 'user')) AS latest_user_hash FROM k WHERE n <= 4 GROUP BY 1
""")
def sequence_follow_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.chat_context(table(spark, sf_dir, "conversations"), "conv_id", "turn").select("conv_id", "n_turns", "roles", F.sha2("latest_user_text", 256).alias("latest_user_hash"))


_PAIRS = (("a", "x", 1.0), ("a", None, 2.0), (None, "x", 3.0), (None, None, 4.0), ("a", "x", 5.0))
_PAIR_SQL = ", ".join(f"({'NULL' if a is None else repr(a)}, {'NULL' if b is None else repr(b)}, {v})" for a, b, v in _PAIRS)


@query(f"""
    WITH p AS (SELECT * FROM (VALUES {_PAIR_SQL}) t(a, b, v))
    SELECT 'kept' AS nulls, a, NULL AS b, CAST(sum(v) AS DOUBLE) AS total, count(*) AS n FROM p GROUP BY a UNION ALL SELECT 'dropped', a, b, CAST(sum(v) AS DOUBLE), count(*) FROM p WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY a, b
""")
def pandas_null_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _values(spark, list(_PAIRS), "a string, b string, v double")
    kept = rows.groupBy("a").agg(F.sum("v").alias("total"), F.count("*").alias("n")).select(F.lit("kept").alias("nulls"), "a", F.lit(None).cast("string").alias("b"), "total", "n")
    dropped = rows.dropna(subset=["a", "b"]).groupBy("a", "b").agg(F.sum("v").alias("total"), F.count("*").alias("n"))
    return kept.union(dropped.select(F.lit("dropped"), "a", "b", "total", "n"))


@query("""
    SELECT wellbore, status, count(*) AS n FROM (
        SELECT c_mktsegment AS wellbore, CASE WHEN l_orderkey IS NULL THEN 'unmatched' ELSE 'exact' END AS status FROM orders JOIN customer ON o_custkey = c_custkey
        LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem) ON l_orderkey = o_orderkey) GROUP BY 1, 2
""")
def replace_by_key_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.expr("o_custkey = c_custkey")).select("o_orderkey", F.col("c_mktsegment").alias("wellbore"))
    stored = orders.withColumn("status", F.lit("unmatched"))
    new = orders.join(table(spark, sf_dir, "lineitem"), F.expr("l_orderkey = o_orderkey"), "left_semi").withColumn("status", F.lit("exact"))
    return records.replace_by_key(stored, new, ["o_orderkey"]).groupBy("wellbore", "status").agg(F.count("*").alias("n"))


@query("""
    SELECT o_orderkey AS version, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE 'old' END AS metrics FROM orders WHERE o_orderkey % 3 > 0 OR o_orderkey % 2 = 0 OR o_orderkey % 3 = 0
""")
def upsert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("version"))
    stored = keys.where("version % 3 > 0 or version % 2 = 0").withColumn("metrics", F.lit("old"))
    return records.merge_by_key(stored, keys.where("version % 3 = 0").withColumn("metrics", F.lit("new")), ["version"])


@query()
def stream_ext_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    source = jobs.stream(spark, f"{sf_dir}/events.parque[t]", schema)  # a pattern may match a file or a folder, a plain path only a folder
    rows = jobs.once(source.select("event_id", "event_type", F.col("ts").cast("timestamp")), "event_id", "ts", "60 days").select("event_id", "event_type")
    return jobs.written(rows, sinks.scratch(spark, "events_once")).groupBy("event_type").agg(F.count("*").alias("n"))
