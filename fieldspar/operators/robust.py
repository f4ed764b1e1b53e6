"""Grouped robust outliers with fallback groups, and an isolation forest on their scores."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspar.functions.scores import outlier_confidence, rate, robust_z, severity

MIN_GROUP, MIN_Z = 30, 3.5
TREES, SAMPLE, CONTAMINATION, SEED = 200, 256, 0.02, 42


def fallback_groups(rows: DataFrame, main: str, sub: str, *, min_group: int = MIN_GROUP) -> DataFrame:
    """Adds ``group_main`` and ``group_sub``: the pair if it has enough rows, else the main label with ``*``.

    Support is counted on the labels as they are and looked up with null as ``unknown``, so rows
    without a sub-label go to the fallback unless so many are literally called unknown.
    """
    known = lambda c: F.coalesce(F.col(c), F.lit("unknown"))
    support = rows.groupBy(F.col(main).alias("_m"), F.col(sub).alias("_s")).agg(F.count("*").alias("_n"))
    joined = rows.join(support, (known(main) == F.col("_m")) & (known(sub) == F.col("_s")), "left")
    enough = F.coalesce(F.col("_n"), F.lit(0)) >= min_group
    return joined.withColumns({"group_main": known(main), "group_sub": F.when(enough, known(sub)).otherwise("*")}).drop("_m", "_s", "_n")


def robust_scores(rows: DataFrame, value: str, groups: list[str], *, min_group: int = MIN_GROUP) -> DataFrame:
    """Adds n, median, mad, q1, q3 and z to the rows of groups with enough support.

    Medians are aggregates that are joined back, not windows, so a large group is no single task's
    sort; the joined side has a row for each group.
    """
    counts = rows.groupBy(*groups).agg(F.count("*").alias("n"), F.median(value).alias("median"), F.percentile(value, F.array(F.lit(0.25), F.lit(0.75))).alias("_q"))
    counts = counts.where(F.col("n") >= min_group).select(*groups, "n", "median", F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("q3"))
    kept = rows.join(counts, groups)
    mads = kept.groupBy(*groups).agg(F.median(F.abs(F.col(value) - F.col("median"))).alias("mad"))
    kept = kept.join(mads, groups)
    return kept.withColumn("z", robust_z(F.col(value), F.col("median"), F.col("mad")))


def small_groups(rows: DataFrame, groups: list[str], *, min_group: int = MIN_GROUP) -> DataFrame:
    """Groups that have too few rows to be scored."""
    return rows.groupBy(*groups).agg(F.count("*").alias("n")).where(F.col("n") < min_group)


def outliers(scored: DataFrame, *, min_z: float = MIN_Z) -> DataFrame:
    """Scored rows that are far out, with severity and confidence."""
    far = scored.where(F.abs("z") >= min_z)
    return far.withColumns({"severity": severity(F.col("z")), "confidence": outlier_confidence(F.col("z"))})


def _path_length(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search among n points."""
    m = np.maximum(n, 2).astype(float)
    return np.where(n < 2, 0.0, 2 * (np.log(m - 1) + 0.5772156649015329) - 2 * (m - 1) / m)


def forest_steps(x: np.ndarray, weight: np.ndarray | None = None, *, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Isolation scores as a step function of the value: where each step starts, and its score.

    The forest is of sorted one-dimensional values, each standing for ``weight`` rows.  A node is a
    range of its tree's sorted sample and a range of values.  All trees grow together, a level at a
    time; leaves add their depth to a range of values.
    """
    rng = np.random.default_rng(seed)
    p = None if weight is None else weight / weight.sum()
    m = int(min(sample, len(x) if weight is None else weight.sum()))
    levels = int(np.ceil(np.log2(max(m, 2))))
    leaf = _path_length(np.arange(m + 1))
    own = np.sort(np.stack([rng.choice(len(x), m, replace=weight is not None, p=p) for _ in range(trees)]), axis=1)
    keys = (own + len(x) * np.arange(trees)[:, None]).ravel()  # one sorted array of all trees
    own = x[own.ravel()]
    tree = np.arange(trees)
    a, b = tree * m, (tree + 1) * m
    low, high = np.full(trees, -np.inf), np.full(trees, np.inf)
    places, changes = [], []  # of the summed depths
    for d in range(levels + 1):
        first, last = own[np.minimum(a, len(own) - 1)], own[np.maximum(b - 1, 0)]
        done = (b - a < 2) | (first == last) | (d == levels)
        depth = d + leaf[(b - a)[done]]
        places += [low[done], high[done]]
        changes += [depth, -depth]
        a, b, low, high, tree, first, last = (v[~done] for v in (a, b, low, high, tree, first, last))
        if not len(a):
            break
        cut = first + (last - first) * rng.random(len(a))
        mid = np.clip(np.searchsorted(keys, np.searchsorted(x, cut) + len(x) * tree), a, b)
        a, b, low, high, tree = (np.concatenate(v) for v in ((a, mid), (mid, b), (low, cut), (cut, high), (tree, tree)))
    at, own = np.unique(np.concatenate(places), return_inverse=True)
    total = np.cumsum(np.bincount(own, np.concatenate(changes)))[: np.searchsorted(at, np.inf)]
    return at[: len(total)], 2 ** (-(total / trees) / max(float(_path_length(np.array(m))), 1e-9))


def forest_scores(x: np.ndarray, weight: np.ndarray | None = None, *, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED) -> np.ndarray:
    """Isolation scores of sorted one-dimensional values, each standing for ``weight`` rows."""
    at, score = forest_steps(x, weight, trees=trees, sample=sample, seed=seed)
    return score[np.searchsorted(at, x, side="right") - 1]


def isolation_candidates(scored: DataFrame, groups: list[str], key: str, *, version: str, contamination: float = CONTAMINATION, min_z: float = MIN_Z, most: int = TREES * SAMPLE) -> DataFrame:
    """Rows that the forest isolates and whose robust z is large, with a key that a second run repeats.

    A group's forest grows on its distinct z with counts, or on a sample of about ``most`` of them,
    chosen by hash: as many as all trees draw.  Every distinct z is then scored by the forest's
    leaves, in parts of about ``most``, and the cut-off is the scores' quantile over the group's
    rows, so a task is bounded whatever the group's size.
    """
    values = scored.where("z is not null").groupBy(*groups, "z").agg(F.count("*").alias("n"))
    sizes = values.groupBy(*groups).agg(F.count("*").alias("_d"))
    values = values.join(sizes, groups)
    share = F.pmod(F.xxhash64("z"), F.lit(1 << 30)) / (1 << 30)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("z", ignore_index=True)
        at, score = forest_steps(pdf["z"].to_numpy(), pdf["n"].to_numpy())
        return pd.DataFrame({**{g: [pdf[g].iloc[0]] * len(at) for g in groups}, "_d": pdf["_d"].iloc[0], "at": at, "score": score})

    def judge(pdf: pd.DataFrame, steps: pd.DataFrame) -> pd.DataFrame:
        steps = steps.sort_values("at")
        place = np.searchsorted(steps["at"].to_numpy(), pdf["z"].to_numpy(), side="right") - 1
        return pdf[[*groups, "z", "n"]].assign(score=steps["score"].to_numpy()[place])

    kinds = dict(scored.dtypes)
    names = ", ".join(f"`{g}` {kinds[g]}" for g in groups)
    parts = F.ceil(F.col("_d") / most).cast("int")
    steps = values.where(share * F.col("_d") < most).groupBy(*groups).applyInPandas(grow, f"{names}, _d long, at double, score double")
    steps = steps.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
    dealt = values.withColumn("_part", F.pmod(F.hash("z"), parts))
    judged = dealt.groupBy(*groups, "_part").cogroup(steps.groupBy(*groups, "_part")).applyInPandas(judge, f"{names}, z double, n long, score double")
    cuts = judged.groupBy(*groups).agg(F.percentile("score", 1 - contamination, F.col("n")).alias("_cut"))
    far = judged.where(F.abs("z") >= min_z).join(cuts, groups).where("score > _cut").select(*groups, "z", "score")
    rows = scored.join(far, [*groups, "z"])
    return rows.select(*scored.columns, "score", severity(F.col("z")).alias("severity"), outlier_confidence(F.col("z")).alias("confidence"), F.sha2(F.concat_ws(":", F.lit(version), F.lit("operation"), F.col(key).cast("string")), 256).alias("candidate_key"))


def run_metrics(candidates: DataFrame, eligible: int) -> DataFrame:
    """Number, rate and score range of a run's candidates."""
    return candidates.agg(F.count("*").alias("candidates"), F.min("score").alias("score_min"), F.median("score").alias("score_median"), F.max("score").alias("score_max")).withColumn("candidate_rate", rate(F.col("candidates"), F.lit(eligible)))

