"""Shared storage for cut lineage: written tables under the folder the cluster names."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = 8 << 20
#: A key is heavy if it has more than that share of a table's rows, and that many; so at most HEAVY keys are.
HEAVY, HEAVY_LEAST = 1000, 256
#: Parts in which the rows of a heavy key are dealt out.
SALTS = 64

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only where that is unset and all runs on one machine, as in tests, one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        folder = tempfile.mkdtemp(prefix="fieldspar-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _OWN[app] = "file://" + folder
    return _OWN[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name in the shared folder."""
    return f"{shared_dir(spark)}/fieldspar/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The table outlives any executor, is computed once (a reliable checkpoint computes its last
    stage twice) and is columnar, so later readers only fetch the columns they use.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Let Spark hand texts to Python in batches of at most 8 MB: executors hold several copies of a batch."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if now <= 0 or now > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def drop(df: DataFrame) -> None:
    """Delete a materialised table that no later plan reads."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before those that the table has already (Spark's names don't mind case)."""
    used = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in used:
            name = "_" + name
        used.add(name.lower())
        out.append(name)
    return out


def spread_join(rows: DataFrame, side: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined (inner or left) with a table that has each key once, such that no key's rows meet in one task.

    ``rows`` must be materialised.  Its heavy keys are found by a count that is summed before the
    shuffle; they are at most HEAVY.  Their rows are dealt out to SALTS parts, and the other table's
    rows of these keys - at most HEAVY - are repeated for each part.
    """
    least = max(HEAVY_LEAST, rows.count() // HEAVY)
    heavy = materialize(rows.groupBy(*keys).count().where(f"count > {least}").select(*keys), "heavy")
    if heavy.isEmpty():
        drop(heavy)
        return rows.join(side, keys, how)
    few, salt = F.broadcast(heavy), fresh(rows.join(side.limit(0), keys), "salt")[0]
    hot = rows.join(few, keys, "left_semi").withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    copies = side.join(few, keys, "left_semi").withColumn(salt, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return hot.join(copies, [*keys, salt], how).drop(salt).unionByName(rows.join(few, keys, "left_anti").join(side, keys, how))
