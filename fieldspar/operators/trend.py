"""Robust trends: Theil-Sen slope and Spearman correlation for each series, gated by units and dates."""

from __future__ import annotations

from math import exp, lgamma, log

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldspar.functions.scores import trend_direction
from fieldspar.functions.temporal import day_number

MIN_POINTS = 4
Z95 = 1.959964


def exclusion_reason(included: Column, given: Column, observed_at: Column, value: Column, unit: Column) -> Column:
    """Why an observation is left out of a trend: the first reason that holds; null if it is used."""
    known = F.lower(F.trim(unit))
    return (
        F.when(~F.coalesce(included, F.lit(False)), F.coalesce(F.nullif(given, F.lit("")), F.lit("data_quality_exclusion")))
        .when(observed_at.isNull(), "invalid_or_missing_date")
        .when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), "invalid_or_missing_value")
        .when(known.isNull() | known.isin("", "unknown", "n/a", "none"), "unknown_unit")
        .otherwise(given)
    )


def daily_medians(rows: DataFrame, by: list[str], ts: str, value: str) -> DataFrame:
    """One value for each day: (by, day, x, y), x the day's number."""
    day = F.to_date(ts)
    return rows.groupBy(*by, day.alias("day")).agg(F.median(value).alias("y")).withColumn("x", day_number(F.col("day")).cast("double"))


@F.pandas_udf(T.DoubleType())
def _two_sided_t(rho: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p-value of a rank correlation, by Student's t through the incomplete beta function's continued fraction."""
    def beta(a: float, b: float, x: float) -> float:
        if x <= 0 or x >= 1:
            return float(x >= 1)
        front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x))
        if x > (a + 1) / (a + b + 2):
            return 1 - beta(b, a, 1 - x)
        c, d = 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d or 1e-30)
        h = d
        for m in range(1, 300):
            for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / ((1 + k * d) or 1e-30)
                c = (1 + k / c) or 1e-30
                h *= d * c
            if abs(d * c - 1) < 1e-14:
                break
        return front * h / a

    def p(r: float, m: float) -> float | None:
        if r != r or m < 3:
            return None
        if abs(r) >= 1:
            return 0.0
        t2 = r * r * (m - 2) / (1 - r * r)
        return beta((m - 2) / 2, 0.5, (m - 2) / (m - 2 + t2))

    return pd.Series([p(r, m) for r, m in zip(rho, n, strict=True)])


def theil_sen(series: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, slope, slope_low, slope_high, intercept, residual_mad) of (by, x, y) points.

    All pairs of a series' points are needed, so collapse long series first (daily_medians); pairs
    are an equi-join on the series, never across series.  The interval is Sen's, with ties.
    """
    points = series.select(*by, "x", "y").where("x is not null and y is not null").withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy("x", "y")))
    other = points.select(*by, F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("_i").alias("_j"))
    slopes = points.join(other, by).where("_i < _j and x <> x2").select(*by, ((F.col("y2") - F.col("y")) / (F.col("x2") - F.col("x"))).alias("s"))
    tie = lambda c: points.groupBy(*by, c).agg(F.count("*").alias("t")).groupBy(*by).agg(F.sum(F.expr("t * (t - 1) * (2 * t + 5)")).alias(f"ties_{c}"))
    base = points.groupBy(*by).agg(F.count("*").alias("n"), F.median("x").alias("mx"), F.median("y").alias("my")).join(tie("x"), by).join(tie("y"), by)
    ranked = slopes.groupBy(*by).agg(F.median("s").alias("slope"), F.array_sort(F.collect_list("s")).alias("all"))
    sigma = F.sqrt(F.greatest((F.expr("n * (n - 1) * (2 * n + 5)") - F.col("ties_x") - F.col("ties_y")) / 18, F.lit(0.0)))
    size = F.size("all")
    low = F.greatest(F.round((size - Z95 * sigma) / 2).cast("int"), F.lit(1))
    high = F.least(F.round((size + Z95 * sigma) / 2).cast("int") + 1, size)
    fit = base.join(ranked, by).select(*by, "n", "slope", F.element_at("all", low).alias("slope_low"), F.element_at("all", high).alias("slope_high"), (F.col("my") - F.col("slope") * F.col("mx")).alias("intercept"))
    residual = points.join(fit, by).withColumn("r", F.col("y") - F.col("slope") * F.col("x") - F.col("intercept"))
    middle = residual.groupBy(*by).agg(F.median("r").alias("mr"))
    mad = residual.join(middle, by).groupBy(*by).agg(F.median(F.abs(F.col("r") - F.col("mr"))).alias("residual_mad"))
    return fit.join(mad, by)


def spearman(series: DataFrame, by: list[str], *, p_value: bool = True) -> DataFrame:
    """(by, rho[, p]) of (by, x, y) points, with average ranks of ties; rho is 0 and p 1 if y never changes."""
    points = series.select(*by, "x", "y").where("x is not null and y is not null")
    rank = lambda c: F.rank().over(Window.partitionBy(*by).orderBy(c)) + (F.count("*").over(Window.partitionBy(*by, c)) - 1) / 2
    ranks = points.withColumns({"rx": rank("x"), "ry": rank("y")})
    flat = F.max("y") == F.min("y")
    out = ranks.groupBy(*by).agg(F.coalesce(F.try_divide(F.covar_pop("rx", "ry"), F.stddev_pop("rx") * F.stddev_pop("ry")), F.lit(0.0)).alias("rho"), F.count("*").alias("m"), flat.alias("flat"))
    if not p_value:
        return out.select(*by, "rho")
    return out.select(*by, "rho", F.when(F.col("flat"), 1.0).otherwise(_two_sided_t("rho", F.col("m").cast("double"))).alias("p"))


def parameter_trend(rows: DataFrame, by: list[str]) -> DataFrame:
    """Trend of each series of (by, observed_at, value, unit, included, exclusion_reason), with a reason where none applies.

    Units must be known and the same; days are collapsed to their median; four days are needed.
    """
    reason = exclusion_reason(F.col("included"), F.col("exclusion_reason"), F.col("observed_at"), F.col("value"), F.col("unit"))
    rows = rows.withColumn("reason", reason)
    facts = rows.groupBy(*by).agg(
        F.count("*").alias("input_count"), F.count_if(F.col("reason").isNull()).alias("included_record_count"),
        F.sort_array(F.collect_set(F.when(F.col("reason").isNull(), F.lower(F.trim("unit"))))).alias("units"),
    )
    used = rows.where("reason is null").join(facts.where("size(units) = 1").select(*by), by, "left_semi")
    days = daily_medians(used, by, "observed_at", "value")
    many = days.groupBy(*by).agg(F.count("*").alias("days")).where(F.col("days") >= MIN_POINTS)
    days = days.join(many, by, "left_semi")
    fit = theil_sen(days, by).join(spearman(days, by), by)
    out = facts.join(fit, by, "left")
    why = F.when(F.size("units") == 0, "No known-unit observations.").when(F.size("units") > 1, "Known units are mixed and cannot be combined.").when(F.col("slope").isNull(), "At least four paired observations are required.")
    return out.withColumns({"applicable": F.col("slope").isNotNull(), "reason": why, "direction": F.when(F.col("slope").isNotNull(), trend_direction(F.col("slope_low"), F.col("slope_high")))})


def reason_counts(rows: DataFrame, by: list[str], reason: str = "reason") -> DataFrame:
    """Map of reason to number of excluded rows."""
    counts = rows.where(F.col(reason).isNotNull()).groupBy(*by, reason).agg(F.count("*").alias("n"))
    return counts.groupBy(*by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(reason, "n")))).alias("excluded_reasons"))

