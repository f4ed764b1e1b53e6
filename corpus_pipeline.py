"""A corpus pipeline: each stage takes all that the one before it kept.

toxicity -> minhash -> decontamination -> secrets -> mixing.  The first four return the columns of
``documents``; the mix adds size, source_size, target and taken, the words it takes of a document.
Decisions are about rows, named by their id and a hash of their text: where an id repeats, or is
null, each row stays or goes for its own text.  Null and empty texts have no words, so that no
stage but the toxicity score's finds anything in them; repeated equal rows share their fate, except
that near-duplicates leave one of them; columns that a stage doesn't know pass through it, and an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspar.llm.decontam import drop_contaminated
from fieldspar.llm.minhash import drop_near_duplicates
from fieldspar.llm.mixing import plan_mix, rank_weights, take_mix, word_count
from fieldspar.llm.secrets import mask_secrets
from fieldspar.llm.storage import drop, fresh, materialize
from fieldspar.llm.toxicity import fit_toxicity, labelled_texts, score_toxicity

SEED = 1


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a classifier, fitted on the labelled ones, does not call toxic."""
    model = fit_toxicity(labelled_texts(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    (score,) = fresh(docs, "toxicity")
    return score_toxicity(docs, model, score_col=score).where(F.col(score) < 0.5).drop(score)


def minhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id."""
    return drop_near_duplicates(docs, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked; n_chars follows the text."""
    masked = mask_secrets(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, with how many words it takes of each, repeats counted.

    Columns of the added names - size, source_size, target and taken - are replaced.
    """
    sized = docs.withColumn("size", word_count(F.col("text")))
    plan_rows = materialize(sized.select("doc_id", "source", "size"), "sizes")
    plan = plan_mix(plan_rows, rank_weights(plan_rows), seed=SEED)
    return take_mix(sized, plan, seed=SEED).where("taken > 0")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity), ("minhash", minhash), ("decontamination", decontamination), ("secrets", secrets), ("mixing", mixing)
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each one's rows are written and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
        if before is not None:
            drop(before)
        before = docs
    return docs


#: SQL can express neither the classifier nor the near-duplicate groups; tests use brute force.
ORACLE_SQL = None
