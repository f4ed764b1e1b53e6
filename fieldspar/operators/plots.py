"""Plot facts: axis calibration, point values, markers, legends, reference curves and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldspar.functions.temporal import day_number


def fit_axis(samples: DataFrame, by: list[str], pixel: str, value: str) -> DataFrame:
    """(by, n, slope, intercept, rmse) of each axis; null where two samples, 5 pixels or two values are lacking.

    The squared error comes from the same sums as the slope, so the samples are read once.
    """
    x, y = F.col(pixel), F.col(value)
    sums = samples.where(x.isNotNull() & y.isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"), (F.max(x) - F.min(x)).alias("reach"), (F.max(y) - F.min(y)).alias("span"),
    )
    good = (F.col("n") >= 2) & (F.col("reach") >= 5) & (F.col("span") != 0)
    rmse = F.sqrt(F.greatest((F.col("syy") - F.col("slope") * F.col("sxy")) / F.col("n"), F.lit(0.0)))
    return sums.select(*by, "n", *[F.when(good, c).alias(name) for c, name in ((F.col("slope"), "slope"), (F.col("intercept"), "intercept"), (rmse, "rmse"))])


def apply_axis(pixel: Column, slope: Column, intercept: Column) -> Column:
    """The value at a pixel; null without a calibration."""
    return slope * pixel + intercept


def axis_samples(tokens: DataFrame, bounds: DataFrame, by: list[str]) -> DataFrame:
    """(by, axis, pixel, value): numeric tokens below the plot for x, left of it for y.

    ``tokens`` has (by, x, y, text), ``bounds`` (by, left, right, top, bottom).
    """
    number = F.regexp_replace("text", ",", "").try_cast("double")
    rows = tokens.join(bounds, by).withColumn("value", number).where("value is not null")
    below = (F.col("y") > F.col("bottom")) & F.col("x").between(F.col("left"), F.col("right"))
    beside = (F.col("x") > 0) & (F.col("x") < F.col("left")) & F.col("y").between(F.col("top"), F.col("bottom"))
    rows = rows.withColumn("axis", F.when(below, "x").when(beside, "y")).where("axis is not null")
    return rows.select(*by, "axis", F.when(F.col("axis") == "x", F.col("x")).otherwise(F.col("y")).alias("pixel"), "value")


# A month on a time axis, and the values that a time plot's y axis may show.  The pattern takes the
# first digit of October to December, so they count as January; results that must agree depend on it.
MONTH = r"(20\d{2})[-/.](0?[1-9]|1[0-2])"
TIME_LEAST, TIME_MOST = 100, 100_000


def dated_axis_samples(tokens: DataFrame, bounds: DataFrame, by: list[str]) -> DataFrame:
    """(by, axis, pixel, value) of a time plot: months below it, as the number of their first day, and plain numbers left of it.

    Tokens and bounds are those of axis_samples; a number outside the values of such plots is no sample.
    """
    bare, month = F.replace("text", F.lit(" "), F.lit("")), lambda i: F.regexp_extract(F.replace("text", F.lit(" "), F.lit("")), MONTH, i)
    below = bare.rlike(MONTH) & (F.col("y") > F.col("bottom")) & F.col("x").between(F.col("left"), F.col("right"))
    day = F.make_date(month(1).try_cast("int"), month(2).try_cast("int"), F.lit(1))
    plain = F.trim(F.replace("text", F.lit(","), F.lit("")))
    value = F.when(plain.rlike(r"^\d+(\.\d+)?$"), plain.try_cast("double"))
    beside = (F.col("x") < F.col("left")) & F.col("y").between(F.col("top"), F.col("bottom")) & value.between(TIME_LEAST, TIME_MOST)
    sample = F.when(below, F.struct(F.lit("x").alias("axis"), F.col("x").cast("double").alias("pixel"), day_number(day).cast("double").alias("value")))
    sample = sample.when(beside, F.struct(F.lit("y").alias("axis"), F.col("y").cast("double").alias("pixel"), value.alias("value")))
    return tokens.join(bounds, by).select(*by, sample.alias("_s")).where("_s is not null").select(*by, "_s.*")


def plot_bounds(projection: DataFrame, by: list[str], position: str, dark: str, length: str, share: float = 0.3) -> DataFrame:
    """(by, first, last) centres of the outermost runs of positions that are dark for a share of their length."""
    hits = projection.where(F.col(dark) > share * F.col(length)).select(*by, position)
    label = F.col(position) - F.row_number().over(Window.partitionBy(*by).orderBy(position))
    runs = hits.withColumn("_run", label).groupBy(*by, "_run").agg(F.avg(position).alias("centre"))
    return runs.groupBy(*by).agg(F.round(F.min("centre")).cast("int").alias("first"), F.round(F.max("centre")).cast("int").alias("last"))


def markers(components: DataFrame) -> DataFrame:
    """Components of a marker's shape and size, top to bottom."""
    aspect = F.col("width") / F.col("height")
    return components.where(aspect.between(0.65, 1.45) & F.col("width").between(12, 55) & F.col("height").between(12, 55)).orderBy("y", "x")


def curve_at(points: DataFrame, curve: DataFrame, by: list[str], reach: int = 7) -> DataFrame:
    """Adds reference_x: the curve's median x within ``reach`` rows of each point's y, by bands of rows."""
    width = 2 * reach + 1
    band = lambda c: F.floor(F.col(c) / width)
    near = points.withColumn("_band", F.explode(F.array_distinct(F.array(F.floor((F.col("y") - reach) / width), F.floor((F.col("y") + reach) / width)))))
    side = curve.select(*by, F.col("x").alias("cx"), F.col("y").alias("cy")).withColumn("_band", band("cy"))
    found = near.join(side, [*by, "_band"]).where(F.abs(F.col("y") - F.col("cy")) <= reach).groupBy("point_id").agg(F.median("cx").alias("reference_x"))
    return points.join(found, "point_id", "left")


def legend(components: DataFrame, by: list[str], tolerance: float = 6.0) -> DataFrame:
    """The largest vertical row of markers of at least three series with even gaps: those are legend entries."""
    column = F.round(F.col("x") / tolerance)
    rows = components.withColumn("_column", column)
    gap = F.col("y") - F.lag("y").over(Window.partitionBy(*by, "_column").orderBy("y"))
    facts = rows.withColumn("_gap", gap).groupBy(*by, "_column").agg(F.countDistinct("series").alias("series"), F.count("*").alias("n"), F.stddev_pop("_gap").alias("sd"), F.avg("_gap").alias("mean"))
    even = facts.where((F.col("series") >= 3) & (F.col("sd") <= F.greatest(F.lit(12.0), 0.4 * F.col("mean"))))
    best = even.groupBy(*by).agg(F.max_by("_column", F.struct("series", "n", -F.col("_column"))).alias("_column"))
    return rows.join(best, [*by, "_column"], "left_semi").drop("_column")


def without_legend(components: DataFrame, entries: DataFrame, key: str) -> DataFrame:
    """Markers that are data."""
    return components.join(entries.select(key), key, "left_anti")


def plot_facts(points: DataFrame, by: list[str]) -> DataFrame:
    """(by, n_points, series, x and y ranges, points by band, direction of each plot's dated points)."""
    facts = points.groupBy(*by).agg(
        F.count("*").alias("n_points"), F.sort_array(F.collect_set("series_identifier")).alias("series"),
        F.min("x_value").alias("x_min"), F.max("x_value").alias("x_max"), F.min("y_value").alias("y_min"), F.max("y_value").alias("y_max"),
        F.min_by("y_value", "observed_date").alias("first_value"), F.max_by("y_value", "observed_date").alias("last_value"),
    )
    bands = points.where("band_classification is not null").groupBy(*by, "band_classification").agg(F.count("*").alias("n")).groupBy(*by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("band_classification", "n")))).alias("bands"))
    change = F.col("last_value") - F.col("first_value")
    return facts.join(bands, by, "left").withColumn("direction", F.when(change > 0, "up").when(change < 0, "down").when(change == 0, "flat"))


def curve_candidates(points: DataFrame) -> DataFrame:
    """Points outside their reference curves."""
    return points.where(F.col("band_classification").isin("below_min", "above_max", "above_virgin")).select("point_id", F.lit("pixel_curve_relative_position").alias("rule"), F.lit("medium").alias("severity"))
