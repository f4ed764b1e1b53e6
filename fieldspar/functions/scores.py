"""Scores, bands and rates as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The scale of the median absolute deviation, its floor, and the severity bounds.
MAD_SCALE, MAD_FLOOR = 1.4826, 1e-6
HIGH, MEDIUM = 8.0, 5.0


def robust_z(x: Column, median: Column, mad: Column) -> Column:
    """Deviation from the median in scaled median absolute deviations."""
    return (x - median) / F.greatest(mad * MAD_SCALE, F.lit(MAD_FLOOR))


def severity(z: Column) -> Column:
    """high, medium or low by the size of a robust z."""
    return F.when(F.abs(z) >= HIGH, "high").when(F.abs(z) >= MEDIUM, "medium").otherwise("low")


def outlier_confidence(z: Column) -> Column:
    """Confidence of an outlier, from 0.70 to 0.95."""
    return F.least(F.lit(0.99), 0.70 + F.least(F.abs(z), F.lit(10.0)) / 40)


def rate(n: Column, total: Column) -> Column:
    """A share whose denominator is at least 1."""
    return n / F.greatest(total, F.lit(1))


def guarded_recall(found: Column, expected: Column) -> Column:
    """Share of what was expected, at most 1; 1 if nothing was."""
    return F.when(expected == 0, 1.0).otherwise(F.least(found / expected, F.lit(1.0)))


def f1(precision: Column, recall: Column) -> Column:
    """Harmonic mean; 0 if both are 0."""
    return F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)


def reaches(metric: Column, op: Column, target: Column) -> Column:
    """Whether a metric meets its target in the target's direction."""
    return F.when(op == ">=", metric >= target).otherwise(metric <= target)


def band(x: Column, low: Column, base: Column, high: Column, virgin: Column) -> Column:
    """Place of a value among nullable reference curves; an unknown curve is passed over."""
    return (
        F.when(x < low, "below_min").when(x < base, "between_min_base").when(x <= high, "between_base_max")
        .when(x <= virgin, "between_max_virgin").when(x > virgin, "above_virgin").when(x > high, "above_max").otherwise("unclassified")
    )


def trend_direction(slope_low: Column, slope_high: Column) -> Column:
    """Direction by the signs of a slope's confidence interval."""
    return F.when(slope_low > 0, "increasing").when(slope_high < 0, "decreasing").otherwise("stable_or_uncertain")


def python_round(x: Column, digits: int) -> Column:
    """The double nearest to the exact binary value rounded half-even to ``digits`` places, as Python's round.

    ``x * 10**digits`` is split into a rounded product and its exact error (factors are cut into
    halves of 26 bits), so ties are told from values beside them.  Null, NaN, infinite and values
    without a fraction at that scale stay as they are.
    """
    if not 0 <= digits <= 15:
        raise ValueError("digits must be 0 to 15")
    scale, cut = float(10**digits), 134_217_729.0
    high_s = cut * scale - (cut * scale - scale)
    low_s = scale - high_s

    def rounded(v: Column) -> Column:
        p, t = v * scale, v * cut
        high = t - (t - v)
        error = ((high * high_s - p) + high * low_s + (v - high) * high_s) + (v - high) * low_s
        whole = F.floor(p).cast("double")
        part = p - whole
        odd = (whole - 2 * F.floor(whole / 2)) != 0
        up = (part > 0.5) | ((part == 0.5) & ((error > 0) | ((error == 0) & odd)))
        return F.when(F.abs(p) < 2.0**52, F.when(up, whole + 1).otherwise(whole) / scale).otherwise(v)

    return F.get(F.transform(F.array(x.cast("double")), rounded), 0)


def color_near(r: Column, g: Column, b: Column, target: tuple[int, int, int], tolerance: float) -> Column:
    """Whether a pixel is within a Euclidean distance of a colour."""
    gaps = [c.cast("int") - t for c, t in zip((r, g, b), target)]
    return F.sqrt(gaps[0] * gaps[0] + gaps[1] * gaps[1] + gaps[2] * gaps[2]) <= tolerance
