"""Matching events to intervals: containment, overlap, nearest, and the decision by all three."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldspar.functions.temporal import minutes_between


def _bucket(ts: Column, seconds: int) -> Column:
    return F.floor(F.unix_micros(ts.cast("timestamp")) / (seconds * 1_000_000))


def interval_join(points: DataFrame, intervals: DataFrame, key: str, ts: str, start: str, end: str, *, bucket_seconds: int = 6 * 3600) -> DataFrame:
    """Pairs of a point and an interval of its key with ``start <= ts < end``.

    Intervals are posted under each time bucket that they touch, so the join is an equi-join on
    (key, bucket) and a key with very many rows is spread over its buckets.
    """
    first, last = _bucket(F.col(start), bucket_seconds), _bucket(F.col(end), bucket_seconds)
    posted = intervals.where(F.col(start) < F.col(end)).withColumn("_bucket", F.explode(F.sequence(first, last)))
    dealt = points.withColumn("_bucket", _bucket(F.col(ts), bucket_seconds))
    return dealt.join(posted, [key, "_bucket"]).where((F.col(start) <= F.col(ts)) & (F.col(ts) < F.col(end))).drop("_bucket")


def overlap_join(left: DataFrame, right: DataFrame, key: str, left_span: tuple[str, str], right_span: tuple[str, str], *, bucket_seconds: int = 6 * 3600) -> DataFrame:
    """Pairs of intervals of a key that overlap: ``s1 < e2 and e1 > s2``.

    Both sides are posted under their buckets; a pair is kept in the bucket in which its overlap
    starts, so no pair is doubled and none needs to be deduplicated.
    """
    (a, b), (c, d) = left_span, right_span
    span = lambda x, y: F.explode(F.sequence(_bucket(F.col(x), bucket_seconds), _bucket(F.col(y), bucket_seconds)))
    pairs = left.where(F.col(a) < F.col(b)).withColumn("_bucket", span(a, b)).join(right.where(F.col(c) < F.col(d)).withColumn("_bucket", span(c, d)), [key, "_bucket"])
    starts = _bucket(F.greatest(F.col(a), F.col(c)), bucket_seconds)
    return pairs.where((F.col(a) < F.col(d)) & (F.col(b) > F.col(c)) & (F.col("_bucket") == starts)).drop("_bucket")


def nearest_join(points: DataFrame, intervals: DataFrame, key: str, point_id: str, ts: str, start: str, end: str, *, tolerance_minutes: float, bucket_seconds: int | None = None) -> DataFrame:
    """For each point the intervals of its key whose nearer end is nearest, within a tolerance, with distance and number of ties."""
    width = bucket_seconds or max(1, int(tolerance_minutes * 60))
    ends = intervals.withColumn("_end", F.explode(F.array_distinct(F.array(start, end))))
    posted = ends.withColumn("_bucket", _bucket(F.col("_end"), width))
    reach = int(tolerance_minutes * 60 // width) + 1
    dealt = points.withColumn("_bucket", F.explode(F.sequence(_bucket(F.col(ts), width) - reach, _bucket(F.col(ts), width) + reach)))
    pairs = dealt.join(posted, [key, "_bucket"]).withColumn("distance", minutes_between(F.col(ts), F.col("_end"))).where(F.col("distance") <= tolerance_minutes)
    names = [c for c in pairs.columns if c not in ("_bucket", "_end", "distance")]
    pairs = pairs.groupBy(*names).agg(F.min("distance").alias("distance"))
    own = Window.partitionBy(point_id)
    best = pairs.withColumn("_least", F.min("distance").over(own)).where("distance = _least").drop("_least")
    return best.withColumn("ties", F.count("*").over(own))


def match_failures(failures: DataFrame, operations: DataFrame, *, tolerance_minutes: float = 0.0, bucket_seconds: int = 6 * 3600) -> DataFrame:
    """(failure_id, operation_id, status, confidence, rule, minutes) by the decision order of the rules.

    ``failures`` has (failure_id, report_id, start, end), ``operations`` (operation_id, report_id,
    op_start, op_end, op_confidence).  Without a start: missing_failure_time.  With no timed
    operation in the report: missing_operation_time.  Several intervals around the start are
    ambiguous; then several that overlap the failure are, even beside one exact; a single overlap
    without an exact one counts; then one exact; then, with a tolerance, the nearest; else unmatched.
    """
    timed = operations.where("op_start is not null and op_end is not null").withColumn("op_confidence", F.coalesce("op_confidence", F.lit(1.0)))
    has = timed.groupBy("report_id").agg(F.count("*").alias("n_timed"))
    base = failures.join(has, "report_id", "left")
    started = failures.where("start is not null")
    side = timed.select("report_id", "operation_id", "op_start", "op_end", "op_confidence")
    exact = interval_join(started, side, "report_id", "start", "op_start", "op_end", bucket_seconds=bucket_seconds).select("failure_id", "operation_id", "op_confidence", F.lit("exact").alias("how"), F.lit(0.0).alias("minutes"))
    spans = overlap_join(started.where("end > start"), side, "report_id", ("start", "end"), ("op_start", "op_end"), bucket_seconds=bucket_seconds)
    found = exact.union(spans.select("failure_id", "operation_id", "op_confidence", F.lit("overlap"), F.lit(None).cast("double")))
    if tolerance_minutes > 0:
        near = nearest_join(started, side, "report_id", "failure_id", "start", "op_start", "op_end", tolerance_minutes=tolerance_minutes)
        found = found.union(near.select("failure_id", "operation_id", "op_confidence", F.lit("nearest"), F.round("distance", 3)))
    own = Window.partitionBy("failure_id")
    number = lambda how: F.count_if(F.col("how") == how).over(own)
    found = found.withColumns({"n_exact": number("exact"), "n_overlap": number("overlap"), "n_nearest": number("nearest")})
    rule = (
        F.when(F.col("n_exact") > 1, "multiple_exact_interval_candidates")
        .when((F.col("n_overlap") == 1) & (F.col("n_exact") == 0), "failure_interval_overlaps_operation")
        .when(F.col("n_overlap") > 1, "multiple_overlap_candidates")
        .when(F.col("n_exact") == 1, "failure_start_inside_operation_interval")
        .when(F.col("n_nearest") == 1, "unique_operation_within_configured_tolerance")
        .when(F.col("n_nearest") > 1, "multiple_equidistant_nearest_candidates")
    )
    found = found.withColumn("rule", rule)
    uses = (
        F.when(F.col("rule").isin("multiple_exact_interval_candidates", "failure_start_inside_operation_interval"), "exact")
        .when(F.col("rule").isin("failure_interval_overlaps_operation", "multiple_overlap_candidates"), "overlap").otherwise("nearest")
    )
    table = {
        "multiple_exact_interval_candidates": ("ambiguous", 0.6), "failure_interval_overlaps_operation": ("overlap", 0.9),
        "multiple_overlap_candidates": ("ambiguous", 0.55), "failure_start_inside_operation_interval": ("exact", 0.98),
        "unique_operation_within_configured_tolerance": ("inferred_nearest", 0.5), "multiple_equidistant_nearest_candidates": ("ambiguous", 0.4),
    }
    status, most = F.lit(None).cast("string"), F.lit(None).cast("double")
    for name, (kind, bound) in table.items():
        status = F.when(F.col("rule") == name, kind).otherwise(status)
        most = F.when(F.col("rule") == name, bound).otherwise(most)
    decided = found.where(F.col("how") == uses).select("failure_id", "operation_id", status.alias("_status"), F.least(most, F.col("op_confidence")).alias("_confidence"), F.col("rule").alias("_rule"), "minutes")
    rows = base.join(decided, "failure_id", "left")
    none = F.col("start").isNull()
    empty = F.col("n_timed").isNull()
    pick = lambda a, b, c, d: F.when(none, a).when(empty, b).otherwise(F.coalesce(c, F.lit(d)))
    return rows.select(
        "failure_id", "operation_id",
        pick("missing_failure_time", "missing_operation_time", F.col("_status"), "unmatched").alias("status"),
        pick(1.0, 1.0, F.col("_confidence"), 0.95).alias("confidence"),
        pick("failure_start_unavailable", "no_valid_operation_intervals", F.col("_rule"), "no_supported_temporal_match").alias("rule"),
        "minutes",
    )


def status_counts(matches: DataFrame) -> DataFrame:
    """Failures by status, each counted once for a status."""
    return matches.groupBy("status").agg(F.countDistinct("failure_id").alias("failures"))


def carry_forward(rows: DataFrame, by: str | list[str], order: list[str], value: str, name: str) -> DataFrame:
    """The last known value at or before each row, as headings carry over to later pages."""
    by = [by] if isinstance(by, str) else by
    over = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(over))
