"""Writers: staged replacement of tables, inserts once, logs, CSV and JSON summaries."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspar.operators.records import merge_by_key, replace_by_key
from fieldspar.operators.rules import not_stored
from fieldspar.sources.schemas import KEYS, conform


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


@functools.cache
def _own_folder(app: str) -> str:
    folder = tempfile.mkdtemp(prefix="fieldspar-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder name in ``spark.checkpoint.dir``; in one of our own only where that is unset and all runs on one machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = f"file://{_own_folder(spark.sparkContext.applicationId)}"
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def overwrite(df: DataFrame, path: str) -> None:
    """Write beside the table and swap the folders, so that a plan may read what it replaces."""
    spark = df.sparkSession
    staged, old = f"{path}.new-{uuid.uuid4().hex[:8]}", f"{path}.old-{uuid.uuid4().hex[:8]}"
    df.write.parquet(staged)
    p = lambda x: spark._jvm.org.apache.hadoop.fs.Path(x)
    fs = p(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(p(path)):
        fs.rename(p(path), p(old))
    fs.rename(p(staged), p(path))
    fs.delete(p(old), True)


def append(df: DataFrame, path: str) -> None:
    """Add rows to a table or log."""
    df.write.mode("append").parquet(path)


def replace(df: DataFrame, path: str, keys: list[str]) -> None:
    """Replace all rows of the given keys (a document's chunks, a report's failures)."""
    spark = df.sparkSession
    overwrite(replace_by_key(spark.read.parquet(path), df, keys) if _exists(spark, path) else df, path)


def insert_absent(df: DataFrame, path: str, keys: list[str]) -> int:
    """Append rows whose key is not stored; their number. A second run adds nothing."""
    spark = df.sparkSession
    fresh = df.dropDuplicates(keys)
    if _exists(spark, path):
        fresh = not_stored(fresh, spark.read.parquet(path), keys)
    fresh = fresh.persist()
    try:
        n = fresh.count()
        if n:
            append(fresh, path)
        return n
    finally:
        fresh.unpersist()


def rebuild_version(df: DataFrame, path: str, version: str, key: str = "candidate_key", column: str = "model_version") -> None:
    """Replace the rows of exactly one version; rows of others, and of none, stay, and their keys are not written again."""
    spark = df.sparkSession
    fresh = df.dropDuplicates([key])
    if _exists(spark, path):
        kept = spark.read.parquet(path).where(~F.col(column).eqNullSafe(F.lit(version)))
        fresh = kept.unionByName(fresh.join(kept.select(key), key, "left_anti"), allowMissingColumns=True)
    overwrite(fresh, path)


def upsert(df: DataFrame, path: str, table: str) -> None:
    """Merge rows into a table by its key."""
    spark = df.sparkSession
    overwrite(merge_by_key(spark.read.parquet(path), df, KEYS[table]) if _exists(spark, path) else df, path)


def copy_once(spark: SparkSession, source: str, target: str, version: str, marks: str) -> bool:
    """Seed a table once: refused if it has rows, skipped if the version is marked."""
    if _exists(spark, marks) and not spark.read.parquet(marks).where(F.col("version") == version).isEmpty():
        return False
    if _exists(spark, target) and not spark.read.parquet(target).isEmpty():
        raise ValueError("the target has rows")
    spark.read.parquet(source).write.mode("overwrite").parquet(target)
    append(spark.createDataFrame([(version,)], "version string").withColumn("applied_at", F.current_timestamp().cast("timestamp_ntz")), marks)
    return True


def log_query(spark: SparkSession, path: str, route: str, question: str, sql: str, rows: int, seconds: float) -> None:
    """Append to the query audit; of the question only its hash is kept."""
    row = spark.createDataFrame([(route, question, sql, rows, seconds)], "route string, question string, generated_sql string, row_count long, duration_seconds double")
    append(row.select("route", F.sha2("question", 256).alias("question_hash"), "generated_sql", "row_count", "duration_seconds", F.current_timestamp().cast("timestamp_ntz").alias("at")), path)


def csv_report(df: DataFrame, path: str, *more: DataFrame) -> None:
    """A report as one UTF-8 CSV file with a byte order mark and a header of all tables' columns."""
    for other in more:
        df = df.unionByName(other, allowMissingColumns=True)
    marked = df.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0])
    marked.coalesce(1).write.mode("overwrite").csv(path, header=True, encoding="UTF-8")


def json_summary(df: DataFrame, path: str) -> None:
    """A small summary as JSON lines."""
    df.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def markdown(df: DataFrame, title: str, limit: int = 100) -> str:
    """A small table as Markdown."""
    rows = df.limit(limit).collect()
    head = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
    return "\n".join([*head, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows)])


#: Child table: the column that numbers its rows, if it has one.
REPORT_CHILDREN = {"pages": None, "report_sections": "section_id", "operations": "operation_id", "extracted_values": "value_id", "section_table_rows": "row_id", "equipment_failures": "failure_id"}
PLOT_CHILDREN = {"plot_points": "point_id"}
#: Rows of a child table that a document can have, as a power of two.
CHILD_BITS = 20


def _renew(rows: DataFrame, documents: DataFrame, path: str, key: str) -> None:
    """Replace all rows of the documents, also of those that have none now."""
    spark = rows.sparkSession
    overwrite(spark.read.parquet(path).join(documents, key, "left_anti").unionByName(rows) if _exists(spark, path) else rows, path)


def _numbered(key: str, name: str) -> Column:
    """The id of the child row at a place of its document."""
    return (F.call_function("shiftleft", F.col(key), F.lit(CHILD_BITS)) + F.col("_at")).alias(name)


def _persist(parsed: DataFrame, root: str, parent: str, field: str, own_id: str, children: dict[str, str | None]) -> None:
    documents = parsed.select("document_id").distinct()
    rows = parsed.select(f"{field}.*", "document_id", F.col("document_id").alias(own_id))
    _renew(conform(rows, parent), documents, f"{root}/{parent}", "document_id")
    for table, number in children.items():
        if table not in parsed.columns:
            continue
        own = parsed.select("document_id", F.col("document_id").alias(own_id), F.posexplode(table).alias("_at", "_row"))
        row_id = [_numbered("document_id", number)] if number else []
        _renew(conform(own.select("_row.*", "document_id", own_id, *row_id), table), documents, f"{root}/{table}", "document_id")


def persist_reports(parsed: DataFrame, root: str) -> None:
    """Write parsed reports to their tables: the ``report`` struct, and an array of structs named as each child table.

    A report has its document's id and child rows are numbered by document and place, so a second
    run writes the same rows.  Fields of the structs must not repeat the ids.
    """
    parsed = parsed.persist()
    try:
        _persist(parsed, root, "reports", "report", "report_id", REPORT_CHILDREN)
    finally:
        parsed.unpersist()


def persist_plots(parsed: DataFrame, root: str) -> None:
    """Write parsed plots and points as reports are; ``anomalies`` and ``identity_mappings`` are inserted where they are new."""
    parsed = parsed.persist()
    try:
        _persist(parsed, root, "plots", "plot", "plot_id", {})
        _persist_points(parsed, root)
        for table in ("anomalies", "identity_mappings"):
            if table in parsed.columns:
                insert_absent(conform(parsed.select("document_id", F.explode(table).alias("_row")).select("_row.*", "document_id"), table), f"{root}/{table}", KEYS[table])
    finally:
        parsed.unpersist()


def _persist_points(parsed: DataFrame, root: str) -> None:
    plots = parsed.select(F.col("document_id").alias("plot_id")).distinct()
    for table, number in PLOT_CHILDREN.items():
        points = parsed.select(F.col("document_id").alias("plot_id"), F.posexplode(table).alias("_at", "_row"))
        _renew(conform(points.select("_row.*", "plot_id", _numbered("plot_id", number)), table), plots, f"{root}/{table}", "plot_id")
