"""Routing, audits, evaluation metrics and checks of stored tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldspar.functions.scores import f1, guarded_recall, reaches
from fieldspar.functions.text import evidence_key, words


def asset_kind(path: Column) -> Column:
    """Kind of a file by its name."""
    name = F.lower(F.regexp_extract(path, r"([^/\\]+)$", 1))
    image = name.rlike(r"\.(png|jpe?g|tiff?)$")
    return (
        F.when(name.rlike(r"\.pdf$"), "pdf").when(image & name.rlike("profile"), "pressure_profile_image")
        .when(image & name.rlike("time"), "pressure_time_image").when(image, "image").when(name.rlike(r"\.zip$"), "archive").otherwise("unsupported")
    )


def page_route(chars: Column, printable: Column, image_share: Column) -> Column:
    """native or ocr for a page by its text's length and quality and the images' share."""
    plain = (chars >= 80) & (printable >= 0.75) & (image_share < 0.95)
    short = (chars > 0) & (image_share == 0) & (printable >= 0.6)
    return F.when(plain | short, "native").otherwise("ocr")


def document_route(pages: DataFrame, by: list[str], route: str) -> DataFrame:
    """(by, pages, native_pages, kind): digital if all pages are native, scanned if none is, else hybrid."""
    facts = pages.groupBy(*by).agg(F.count("*").alias("pages"), F.count_if(F.col(route) == "native").alias("native_pages"))
    return facts.withColumn("kind", F.when(F.col("native_pages") == F.col("pages"), "digital").when(F.col("native_pages") == 0, "scanned").otherwise("hybrid"))


def hybrid_pages(native: DataFrame, ocr: DataFrame, key: str, page: str) -> DataFrame:
    """Native rows of the pages that weren't recognised, and the recognised pages' rows."""
    return native.join(ocr.select(key, page).distinct(), [key, page], "left_anti").unionByName(ocr, allowMissingColumns=True)


def token_scores(expected: DataFrame, found: DataFrame, key: str, text: str) -> DataFrame:
    """(key, precision, recall, f1) of the multisets of two texts' tokens."""
    count = lambda df, name: df.select(key, F.explode(words(F.col(text))).alias("t")).groupBy(key, "t").agg(F.count("*").alias(name))
    both = count(expected, "a").join(count(found, "b"), [key, "t"], "full_outer").fillna(0, ["a", "b"])
    sums = both.groupBy(key).agg(F.sum(F.least("a", "b")).alias("hit"), F.sum("a").alias("expected"), F.sum("b").alias("found"))
    share = lambda d: F.when(F.col(d) > 0, F.col("hit") / F.col(d)).otherwise(0.0)
    return sums.withColumns({"precision": share("found"), "recall": share("expected")}).withColumn("f1", f1(F.col("precision"), F.col("recall")))


@F.pandas_udf(T.DoubleType())
def word_error_rate(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Edits between two word sequences, by the sequence matcher's blocks, for each expected word."""
    from difflib import SequenceMatcher

    def rate(a: str | None, b: str | None) -> float:
        x, y = (a or "").split(), (b or "").split()
        edits = sum(max(j - i, n - m) for op, i, j, m, n in SequenceMatcher(None, x, y, autojunk=False).get_opcodes() if op != "equal")
        return edits / max(len(x), 1)

    for expected, found in batches:
        yield pd.Series([rate(a, b) for a, b in zip(expected, found, strict=True)], dtype="float64")


def supported_mean(metric: str, support: str) -> Column:
    """Mean over the samples that have support."""
    return F.avg(F.when(F.col(support) > 0, F.col(metric)))


def set_recall(expected: Column, found: Column) -> Column:
    """Share of expected values that were found."""
    return guarded_recall(F.size(F.array_intersect(expected, found)), F.size(F.array_distinct(expected)))


def target_results(metrics: DataFrame, targets: DataFrame) -> DataFrame:
    """Each target with its metric and whether it is met; ``targets`` has (name, op, target), ``metrics`` (name, value)."""
    return targets.join(metrics, "name", "left").withColumn("passed", F.coalesce(reaches(F.col("value"), F.col("op"), F.col("target")), F.lit(False)))


def case_results(cases: DataFrame, checks: list[str]) -> DataFrame:
    """Number of cases that pass all checks, and their times."""
    ok = F.forall(F.array(*checks), lambda x: x)
    return cases.agg(F.count("*").alias("cases"), F.count_if(ok).alias("passed"), F.avg("seconds").alias("mean_seconds"), F.median("seconds").alias("median_seconds"), F.max("seconds").alias("max_seconds"))


def audit(documents: DataFrame) -> DataFrame:
    """Totals over audited files: (kind, files, bytes, pages, distinct dates, sentinels)."""
    return documents.groupBy("kind").agg(F.count("*").alias("files"), F.sum("byte_size").alias("bytes"), F.sum("page_count").alias("pages"), F.countDistinct("report_date").alias("dates"), F.sum("sentinels").alias("sentinels"))


def verify_sources(rows: DataFrame, pages: DataFrame, keys: list[str], evidence: str, page_text: str) -> DataFrame:
    """Adds verified: whether the page has the row's evidence, compared by letters and digits."""
    side = pages.select(*keys, F.regexp_replace(F.lower(page_text), "[^a-z0-9]", "").alias("_page"))
    found = F.contains(F.col("_page"), evidence_key(F.col(evidence)))
    return rows.join(side, keys, "left").withColumn("verified", F.coalesce(found, F.lit(False))).drop("_page")


def orphans(rows: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose parent is not stored."""
    return rows.where(F.col(key).isNotNull()).join(parents.select(F.col(parent_key).alias(key)), key, "left_anti")


def verified_assets(assets: DataFrame) -> DataFrame:
    """Adds whether stored bytes have the length, hash and first bytes that they should."""
    ok = (F.length("content_bytes") == F.col("byte_size")) & (F.sha2("content_bytes", 256) == F.col("sha256")) & F.startswith("content_bytes", F.lit(b"%PDF-"))
    return assets.withColumn("verified", F.coalesce(ok, F.lit(False)))


def column_of(x: str, starts: str) -> Column:
    """Index of the last column that starts at or before a token."""
    return F.size(F.filter(F.col(starts), lambda s: s <= F.col(x))) - 1


def token_lines(tokens: DataFrame, by: list[str]) -> DataFrame:
    """Lines of recognised tokens: text by x, box, and mean confidence."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda t: t["text"]), " ")
    return tokens.groupBy(*by).agg(
        text.alias("text"), F.avg("top").alias("y"), F.round(F.avg("confidence"), 4).alias("confidence"),
        F.struct(F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom")).alias("bbox"),
    )


def key_values(cells: DataFrame, by: list[str], order: str, cell: str) -> DataFrame:
    """(by, field, value): a cell that ends with a colon takes the next one; of a repeated field the last filled value counts."""
    nxt = F.lead(cell).over(Window.partitionBy(*by).orderBy(order))
    pairs = cells.withColumn("value", nxt).where(F.trim(cell).endswith(":")).withColumn("field", F.regexp_replace(F.trim(cell), r"\s*:$", ""))
    filled = F.when(F.trim("value") != "", F.col(order))
    return pairs.groupBy(*by, "field").agg(F.coalesce(F.max_by("value", filled), F.first("value")).alias("value"), F.min(order).alias("position"))
