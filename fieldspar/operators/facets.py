"""Optional equality filters over tables that are shown, and a choice of documents to look at."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALL = "all"


def chosen(choices: Mapping[str, str]) -> Column:
    """Whether a row has all chosen values, compared as text; the choice ``all`` leaves its column out."""
    test = F.lit(True)
    for name, value in choices.items():
        if value != ALL:
            test = test & F.coalesce(F.col(name).cast("string") == value, F.lit(False))
    return test


def facet_values(rows: DataFrame, names: list[str]) -> DataFrame:
    """(facet, value, n): the values that can be chosen, in one pass over the rows."""
    pairs = F.explode(F.array(*(F.struct(F.lit(name).alias("facet"), F.col(name).cast("string").alias("value")) for name in names)))
    return rows.select(pairs.alias("p")).select("p.*").where("value is not null").groupBy("facet", "value").agg(F.count("*").alias("n"))


def representative_sources(reports: DataFrame, failures: DataFrame, operations: DataFrame, limit: int) -> DataFrame:
    """(document_id, reason): up to half of ``limit`` documents with failures, the rest with operations only, smallest ids first."""
    having = lambda rows: reports.join(rows.select("report_id"), "report_id", "left_semi").select("document_id").distinct()
    failing = having(failures).orderBy("document_id").limit(max(1, limit // 2))
    others = having(operations).join(failing, "document_id", "left_anti").withColumn("reason", F.lit("operation"))
    # failures first, so the operations fill what they leave of the limit
    return failing.withColumn("reason", F.lit("failure")).union(others).orderBy("reason", "document_id").limit(limit)


def page_histogram(documents: DataFrame) -> DataFrame:
    """(page_count, documents) of a corpus; documents whose pages are unknown count under null."""
    return documents.groupBy("page_count").agg(F.count("*").alias("documents"))


def section_coverage(reports: DataFrame, sections: DataFrame) -> DataFrame:
    """(section_type, reports, share): in how many reports of the corpus a section stands."""
    total = F.broadcast(reports.agg(F.count("*").alias("total")))  # one row
    own = sections.join(reports.select("report_id"), "report_id", "left_semi").groupBy("section_type").agg(F.countDistinct("report_id").alias("reports"))
    return own.join(total, F.lit(True)).select("section_type", "reports", (F.col("reports") / F.col("total")).alias("share"))
