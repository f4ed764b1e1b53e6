"""Structured Streaming jobs; extensions that keep stored tables up to date as files and logs grow."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from fieldspar.operators.records import effective_status, replace_by_key
from fieldspar.sources.sinks import _exists, overwrite, remove

#: Where a stream's state is held: on disk, behind caches of a fixed size.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}


def stream(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A folder of parquet files as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def once(rows: DataFrame, key: str, ts: str, delay: str = "1 day") -> DataFrame:
    """Each key once, however often its rows come within the watermark's delay."""
    return rows.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def written(rows: DataFrame, folder: str) -> DataFrame:
    """What a stream has now, as a table below ``folder``, where its checkpoint and state lie until it ends.

    Rows go from tasks to files, and states to RocksDB, as keys within a delay can be more than memory holds.
    """
    conf = rows.sparkSession.conf
    before = {k: conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        conf.set(k, v)
    try:  # a query takes the settings of its start
        running = rows.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)
    try:
        running.awaitTermination()
    finally:
        remove(rows.sparkSession, f"{folder}/checkpoint")
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{folder}/rows")


def window_counts(rows: DataFrame, ts: str, by: list[str], size: str = "1 hour", slide: str | None = None, delay: str = "2 hours") -> DataFrame:
    """Rows by window and key; late rows count until the watermark has passed."""
    return rows.withWatermark(ts, delay).groupBy(F.window(ts, size, slide or size), *by).agg(F.count("*").alias("n"))


def sessions(rows: DataFrame, ts: str, by: list[str], gap: str = "30 minutes", delay: str = "2 hours") -> DataFrame:
    """Sessions of each key, closed by a gap."""
    return rows.withWatermark(ts, delay).groupBy(F.session_window(ts, gap), *by).agg(F.count("*").alias("n"))


def _batches(rows: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> StreamingQuery:
    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_new(files: DataFrame, stored: str, checkpoint: str, key: str = "sha256") -> StreamingQuery:
    """Append rows whose key is not stored; a batch that runs twice adds nothing."""

    def each(batch: DataFrame, _: int) -> None:
        fresh = batch.dropDuplicates([key])
        if _exists(batch.sparkSession, stored):
            fresh = fresh.join(batch.sparkSession.read.parquet(stored).select(key), key, "left_anti")
        fresh.write.mode("append").parquet(stored)

    return _batches(files, checkpoint, each)


def keep_status(reviews: DataFrame, log: str, status: str, checkpoint: str) -> StreamingQuery:
    """Append reviews to the log and renew the status of the anomalies that they are about."""

    def each(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        known = spark.read.parquet(log) if _exists(spark, log) else batch.limit(0)
        fresh = batch.join(known.select("review_id"), "review_id", "left_anti")
        fresh.write.mode("append").parquet(log)
        touched = spark.read.parquet(log).join(batch.select("anomaly_id").distinct(), "anomaly_id", "left_semi")
        new = effective_status(touched)
        overwrite(replace_by_key(spark.read.parquet(status), new, ["anomaly_id"]) if _exists(spark, status) else new, status)

    return _batches(reviews, checkpoint, each)


def rechunk(changed: DataFrame, chunks: str, checkpoint: str, build: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Rebuild the chunks of documents that changed."""

    def each(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = build(batch.select("document_id").distinct())
        overwrite(replace_by_key(spark.read.parquet(chunks), new, ["document_id"]) if _exists(spark, chunks) else new, chunks)

    return _batches(changed, checkpoint, each)


# Questions of a session, seconds between two, and characters of one.
QUOTA, COOLDOWN, LONGEST = 50, 1.0, 2000


def upload_once(uploads: DataFrame, session: str, sha: str, ts: str, delay: str = "1 day") -> DataFrame:
    """A session's uploads without those whose hash it has had."""
    return uploads.withWatermark(ts, delay).dropDuplicatesWithinWatermark([session, sha])


def admit_questions(questions: DataFrame, *, quota: int = QUOTA, cooldown: float = COOLDOWN, longest: int = LONGEST) -> DataFrame:
    """(session_id, question_id, verdict) of a stream of (session_id, question_id, asked_at, question).

    The verdict is too_long, quota, cooldown or admitted, the first that holds; only admitted questions
    count and start the cooldown.  A session's state is two numbers; its questions of one batch are
    taken by time, equal times by id.  Null questions are empty.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, last = state.get if state.exists else (0, float("-inf"))
        rows = pd.concat(list(batches)).sort_values(["at", "question_id"])
        verdicts = []
        for at, size in zip(rows["at"], rows["size"]):
            verdict = "too_long" if size > longest else "quota" if count >= quota else "cooldown" if at - last < cooldown else "admitted"
            if verdict == "admitted":
                count, last = count + 1, at
            verdicts.append(verdict)
        state.update((count, float(last)))
        yield pd.DataFrame({"session_id": key[0], "question_id": rows["question_id"].to_numpy(), "verdict": verdicts})

    short = questions.select(
        F.col("session_id").cast("string"), F.col("question_id").cast("long"), (F.unix_micros(F.col("asked_at").cast("timestamp")) / 1e6).alias("at"), F.coalesce(F.length("question"), F.lit(0)).alias("size")
    )
    return short.groupBy("session_id").applyInPandasWithState(run, "session_id string, question_id long, verdict string", "n int, last double", "append", GroupStateTimeout.NoTimeout)
