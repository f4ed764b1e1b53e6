"""Readers: file listings, documents through an injected parser, archives, manifests and tables."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspar.operators.quality import asset_kind
from fieldspar.sources.schemas import SCHEMAS

ENTRY = "archive string, entry string, size long, packed long, error string"
#: Limits of an archive: entries, all bytes, bytes of an entry, ratio.
LIMITS = {"entries": 5000, "total": 2_000_000_000, "entry": 200_000_000, "ratio": 200.0}


def table(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """A parquet table, with its schema if it is one of ours."""
    reader = spark.read
    return (reader.schema(SCHEMAS[name]) if name in SCHEMAS else reader).parquet(path)


def jdbc_table(spark: SparkSession, url: str, name: str, *, key: str, low: int, high: int, partitions: int = 32) -> DataFrame:
    """A database table read in ranges of a key."""
    return spark.read.jdbc(url, name, column=key, lowerBound=low, upperBound=high, numPartitions=partitions)


def files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, name, kind, byte_size, modified) of all files below a folder, without reading them."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return found.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), asset_kind(F.col("path")).alias("kind"), F.col("length").alias("byte_size"), F.col("modificationTime").alias("modified"))


def documents(spark: SparkSession, root: str, parse: Callable[[str, bytes], list[dict]], schema: str, pattern: str = "*", *, max_bytes: int = 100_000_000) -> DataFrame:
    """(path, sha256, error, rows): each file through ``parse``; a file that fails or is too large has an error, the others go on."""
    loaded = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    loaded = loaded.select("path", F.sha2("content", 256).alias("sha256"), F.when(F.col("length") <= max_bytes, F.col("content")).alias("content"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, sha, content in batch.itertuples(index=False):
                try:
                    if content is None:
                        raise ValueError("larger than the limit")
                    out.append((path, sha, None, parse(path, content)))
                except Exception as error:  # noqa: BLE001  one file's failure is its own
                    out.append((path, sha, f"{type(error).__name__}: {error}"[:500], []))
            yield pd.DataFrame(out, columns=["path", "sha256", "error", "rows"])

    return loaded.mapInPandas(run, f"path string, sha256 string, error string, rows array<struct<{schema}>>")


def new_documents(found: DataFrame, stored: DataFrame) -> DataFrame:
    """Files whose content is not stored complete, each content once."""
    done = stored.where("processing_status = 'complete'").select("sha256")
    return found.dropDuplicates(["sha256"]).join(done, "sha256", "left_anti")


def archive_entries(spark: SparkSession, path: str) -> DataFrame:
    """One row for each entry of the archives, from their directories alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, content in batch.itertuples(index=False):
                try:
                    rows += [(name, x.filename, x.file_size, x.compress_size, None) for x in zipfile.ZipFile(io.BytesIO(content)).infolist() if not x.is_dir()]
                except zipfile.BadZipFile as error:
                    rows.append((name, None, None, None, str(error)))
            yield pd.DataFrame(rows, columns=["archive", "entry", "size", "packed", "error"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, ENTRY)


def unsafe_path(entry: Column) -> Column:
    """Whether an entry would leave its folder."""
    return entry.rlike(r"^[/\\]|^[A-Za-z]:|(^|[/\\])\.\.([/\\]|$)|\x00")


def archive_problems(entries: DataFrame, limits: dict[str, float] = LIMITS) -> DataFrame:
    """(archive, problem): limits that archives break, unsafe paths, and names that repeat without regard to case."""
    per = entries.groupBy("archive").agg(
        F.count("*").alias("n"), F.sum("size").alias("total"), F.max("size").alias("largest"), F.max(F.col("size") / F.greatest("packed", F.lit(1))).alias("ratio"),
        F.max(unsafe_path(F.col("entry"))).alias("unsafe"), F.max(F.col("error").isNotNull()).alias("broken"), F.countDistinct(F.lower("entry")).alias("names"), F.count("entry").alias("named"),
    )
    tests = {
        "too_many_entries": F.col("n") > limits["entries"], "too_large": F.col("total") > limits["total"], "entry_too_large": F.col("largest") > limits["entry"],
        "ratio": F.col("ratio") > limits["ratio"], "unsafe_path": F.col("unsafe"), "broken": F.col("broken"), "repeated_name": F.col("names") < F.col("named"),
    }
    return per.select("archive", F.explode(F.array_compact(F.array(*[F.when(t, name) for name, t in tests.items()]))).alias("problem"))


def archive_contents(spark: SparkSession, path: str, limits: dict[str, float] = LIMITS) -> DataFrame:
    """(archive, entry, content) of archives without a problem; an entry at a time is unpacked."""
    entries = archive_entries(spark, path)
    good = entries.select("archive").distinct().join(archive_problems(entries, limits), "archive", "left_anti")
    most = int(limits["entry"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in batch.itertuples(index=False):
                with zipfile.ZipFile(io.BytesIO(content)) as packed:
                    for x in packed.infolist():
                        if not x.is_dir():
                            with packed.open(x) as file:
                                own = file.read(most + 1)
                            if len(own) > most:  # the directory may understate a size
                                raise ValueError(f"{x.filename} is larger than {most} bytes")
                            yield pd.DataFrame({"archive": [name], "entry": [x.filename], "content": [own]})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.join(good.withColumnRenamed("archive", "path"), "path", "left_semi").mapInPandas(run, "archive string, entry string, content binary")


def bootstrap_state(sources: DataFrame, preserved: DataFrame, extracted: DataFrame) -> DataFrame:
    """(name, state) of archives: what a start has to do, or why it must stop.

    ``sources`` has (name, sha256, files), ``preserved`` (name, sha256) of earlier copies and
    ``extracted`` (name, files) that lie in their folders.
    """
    rows = sources.join(preserved.select("name", F.col("sha256").alias("kept")), "name", "left").join(extracted.select("name", F.col("files").alias("present")), "name", "left")
    there = F.coalesce("present", F.lit(0))
    state = F.when(F.col("kept") != F.col("sha256"), "different_hash").when(there == 0, "extract").when(there != F.col("files"), "partial_extraction").otherwise("complete")
    return rows.select("name", state.alias("state"))


def manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV manifest with a header."""
    return spark.read.csv(path, header=True, schema=schema)


def json_list(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON file that is a list of objects, or an object of them."""
    text = spark.read.text(path, wholetext=True)
    listed = F.ltrim("value").startswith("[")
    rows = F.when(listed, F.from_json("value", f"array<struct<{schema}>>")).otherwise(F.map_values(F.from_json("value", f"map<string,struct<{schema}>>")))
    return text.select(F.explode(rows).alias("r")).select("r.*")
