"""Sections and search chunks: headings split pages into sections; rows are batched into chunks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldspar.functions.text import collapse, render

#: Rows of a chunk by source.
BATCH = {"operation": 5, "extracted_value": 20, "section_table_row": 12}


def lines(pages: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, line_no, line) of each page's lines."""
    return pages.select(*keys, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def split_sections(numbered: DataFrame, by: list[str], order: list[str], line: str, heading: Column) -> DataFrame:
    """(by, section_no, heading, n_lines, text): each heading starts a section that ends before the next one.

    ``heading`` is a Column that is the heading's name on heading lines, else null.  Lines before
    the first heading are section 0 without a heading.
    """
    over = Window.partitionBy(*by).orderBy(*order)
    rows = numbered.withColumn("_heading", heading)
    rows = rows.withColumn("section_no", F.count("_heading").over(over.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_pos", F.struct(*order))
    body = F.transform(F.array_sort(F.collect_list(F.struct("_pos", F.col(line).alias("line")))), lambda x: x["line"])
    return rows.groupBy(*by, "section_no").agg(F.max("_heading").alias("heading"), F.count("*").alias("n_lines"), F.array_join(body, "\n").alias("text"))


def batch(rows: DataFrame, by: list[str], order: list[str], size: int) -> DataFrame:
    """Adds batch_no: rows of a group by order, ``size`` to a batch."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("batch_no", F.floor((n - 1) / size))


def batch_texts(rows: DataFrame, by: list[str], order: list[str], size: int, text: Column) -> DataFrame:
    """(by, batch_no, n_rows, text): each batch's texts in order, one on a line."""
    kept = batch(rows.withColumn("_text", text), by, order, size)
    body = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col("_text").alias("t")))), lambda x: x["t"])
    return kept.groupBy(*by, "batch_no").agg(F.count("*").alias("n_rows"), F.array_join(body, "\n").alias("text"))


def chunk(source_type: str, rows: DataFrame, key: list[str], text: Column, *, document: str, section: Column | None = None, page: Column | None = None) -> DataFrame:
    """Rows of the chunk table: a stable key, where the text is from, the text and its hash."""
    body = F.substring(collapse(text), 1, 6000)
    return rows.select(
        F.concat_ws(":", F.lit(source_type), *[F.col(k).cast("string") for k in key]).alias("chunk_key"), F.lit(source_type).alias("source_type"),
        F.col(document).alias("document_id"), (section if section is not None else F.lit(None).cast("string")).alias("section_type"),
        (page if page is not None else F.lit(None).cast("int")).alias("page_number"), body.alias("searchable_text"), F.sha2(body, 256).alias("content_hash"),
    ).where("searchable_text <> ''")


def build_chunks(reports: DataFrame, sections: DataFrame, operations: DataFrame, values: DataFrame, table_rows: DataFrame, failures: DataFrame, anomalies: DataFrame, plots: DataFrame) -> DataFrame:
    """All kinds of chunks: summaries, sections, batches of rows and values, failures, confirmed anomalies, plots.

    Each input has document_id and page_number besides the columns named below.
    """
    js = lambda *c: F.to_json(F.struct(*c))
    page, section = F.col("page_number"), F.col("section_type")
    operation_rows = batch_texts(operations, ["document_id", "page_number"], ["row_index"], BATCH["operation"], js("main_activity", "sub_activity", "state", "remark"))
    value_rows = batch_texts(values, ["document_id", "page_number", "section_type"], ["value_id"], BATCH["extracted_value"], js("field_name", "raw_value", F.coalesce(F.nullif("normalized_text", F.lit("")), F.col("normalized_number").cast("string")).alias("value"), "unit"))
    cell_rows = batch_texts(table_rows, ["document_id", "page_number", "section_type", "table_index"], ["row_index"], BATCH["section_table_row"], js("header_cells", "raw_cells"))
    kinds = [
        chunk("report_summary", reports, ["report_id"], render(F.col("wellbore"), F.col("summary_activities"), F.col("summary_planned"), F.col("status_raw")), document="document_id", page=F.lit(1)),
        chunk("report_section", sections, ["section_id"], render(F.col("heading_raw"), F.col("text")), document="document_id", section=section, page=page),
        chunk("operation", operation_rows, ["document_id", "page_number", "batch_no"], F.col("text"), document="document_id", section=F.lit("operations"), page=page),
        chunk("extracted_value", value_rows, ["document_id", "page_number", "section_type", "batch_no"], F.col("text"), document="document_id", section=section, page=page),
        chunk("section_table_row", cell_rows, ["document_id", "page_number", "section_type", "table_index", "batch_no"], F.col("text"), document="document_id", section=section, page=page),
        chunk("equipment_failure", failures, ["failure_id"], render(F.col("equipment"), F.col("system_class"), F.col("downtime_minutes"), F.col("remark")), document="document_id", section=F.lit("equipment_failure_information"), page=page),
        chunk("validated_anomaly", anomalies.where("domain_validated"), ["anomaly_id"], render(F.col("category"), F.col("explanation"), F.col("detector_type")), document="document_id"),
        chunk("plot_fact", plots, ["plot_id"], render(F.col("plot_type"), F.col("n_points"), F.col("x_range"), F.col("y_range")), document="document_id"),
    ]
    return reduce(DataFrame.unionByName, kinds)


def within_budget(ranked: DataFrame, by: list[str], order: list[Column], length: str, *, budget: int = 7000, rows: int = 12) -> DataFrame:
    """The first rows of each group whose running length stays in the budget, as a prefix, and at most ``rows``."""
    over = Window.partitionBy(*by).orderBy(*order)
    upto = F.sum(length).over(over.rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumns({"upto": upto, "place": F.row_number().over(over)}).where((F.col("upto") <= budget) & (F.col("place") <= rows))
