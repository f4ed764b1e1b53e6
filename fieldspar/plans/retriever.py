"""Retrieval for questions: an index over the whole corpus, built once for a state of the chunks.

Postings lie sorted by term, so a question reads the row groups of its few terms.  Sections must
hold in the first stage; the second leaves them out and adds character grams.
"""

from __future__ import annotations

import tempfile
import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from fieldspar.functions.scores import python_round
from fieldspar.operators import search
from fieldspar.plans.planner import Plan
from fieldspar.sources.sinks import _exists

KEY, TEXT = "chunk_key", "searchable_text"
SHOWN = (KEY, "source_type", "document_id", "page_number", "section_type")
#: Letters of a term that alone make it rare.
RARE_LENGTH = 8


@dataclass(frozen=True)
class Diagnostics:
    """What a search looked at."""

    status: str
    fingerprint: str
    chunks: int
    build_seconds: float
    stage: int
    candidates: int
    hits: int
    source_types: tuple[str, ...]


def fingerprint(chunks: DataFrame) -> tuple[str, int]:
    """A name of the chunks' keys and texts whatever their order, and their number."""
    row = chunks.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(KEY, TEXT)).alias("x"), F.sum(F.xxhash64(TEXT, KEY).cast("decimal(38,0)")).alias("s")).first()
    return f"{row.n}_{(row.x or 0) & (2**64 - 1):016x}_{int(row.s or 0) & (2**64 - 1):016x}", row.n


def index_folder(spark: SparkSession) -> str:
    """Where indexes lie: in the cluster's shared folder, or a temporary one where it is unset and the master local."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/retrieval"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir or name a folder that all executors share")
    return f"file://{tempfile.mkdtemp(prefix='retrieval-')}"


def _contains(text: Column, names: list[str]) -> list[Column]:
    return [F.contains(text, F.lit(name.lower())) for name in names]


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for test in tests:
        out = out | test
    return out


def boosted(score: Column, plan: Plan, sections: tuple[str, ...]) -> Column:
    """A chunk's score with what its well, section, identifiers, rare terms, activities and equipment add."""
    low = F.lower(TEXT)
    rare = [t for t in dict.fromkeys(x.lower() for x in plan.terms) if len(t) >= RARE_LENGTH or any(c in t for c in "/_-")]
    signals = sum((F.coalesce(test, F.lit(False)).cast("int") for test in _contains(low, rare)), F.lit(0))
    return search.boost(
        score, wellbore=F.lower("wellbore") == plan.wellbore.lower() if plan.wellbore else F.lit(False),
        section=F.col("section_type").isin(*sections) if sections else F.lit(False),
        identifier=_any(_contains(low, [t for t in plan.terms if "/" in t or "_" in t])), signals=signals,
        activity=_any(_contains(low, list(plan.activities))), equipment=_any(_contains(low, list(plan.equipment))),
    )


class Retriever:
    """Searches of one state of the chunks; the index is written below ``folder`` when it is first needed."""

    def __init__(self, chunks: DataFrame, folder: str) -> None:
        self.chunks, self.spark = chunks, chunks.sparkSession
        self.fingerprint, self.n = fingerprint(chunks)
        self.folder = f"{folder}/{self.fingerprint}"
        self.build_seconds = 0.0

    def _index(self, kind: str) -> search.Index:
        path = f"{self.folder}/{kind}"
        if not _exists(self.spark, f"{path}/terms/_SUCCESS"):
            began = time.time()
            counts, cap, least = (search.word_counts, search.WORD_CAP, 1) if kind == "words" else (search.char_counts, search.CHAR_CAP, search.CHAR_MIN_DF)
            built = search.build_index(counts(self.chunks, KEY, TEXT), KEY, self.n, cap=cap, min_df=least)
            built.postings.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
            built.terms.coalesce(1).write.mode("overwrite").parquet(f"{path}/terms")  # last, as its mark is looked for
            built.terms.unpersist()
            self.build_seconds += time.time() - began
        read = self.spark.read.parquet
        return search.Index(read(f"{path}/postings"), read(f"{path}/terms"), self.n)

    def _scores(self, kind: str, question: str) -> DataFrame:
        """(chunk_key, score) of the chunks that share a term with the question."""
        index = self._index(kind)
        asked = self.spark.createDataFrame([(0, question)], "query int, text string")
        counts = search.word_counts if kind == "words" else search.char_counts
        vector = search.query_vector(index, counts(asked, "query", "text"), "query").collect()  # as many rows as the question has terms
        if not vector:
            return self.spark.createDataFrame([], self.chunks.select(KEY).schema).withColumn("score", F.lit(0.0))
        weights = self.spark.createDataFrame([(0, r.term, r.query_weight) for r in vector], "query int, term string, query_weight double")
        own = index.postings.where(F.col("term").isin([r.term for r in vector]))
        return search.cosine(search.Index(own, index.terms, self.n), KEY, F.broadcast(weights), "query").select(KEY, "score")

    def search(self, plan: Plan, sections: tuple[str, ...] = ()) -> tuple[list[Row], Diagnostics]:
        """At most ``plan.limit`` chunks with score and stage: by score, newest period and key, or newest first if that is asked."""
        if not self.n:
            return [], Diagnostics("not_backfilled", self.fingerprint, 0, 0.0, 2, 0, 0, ())
        dates = (plan.date_from and plan.date_from.isoformat(), plan.date_to and plan.date_to.isoformat())
        words = self._scores("words", plan.search_text)
        hits: list[Row] = []
        stage = candidates = 0
        for stage, own, least in ((1, list(sections), search.WORD_LEAST), (2, None, search.BLEND_LEAST)):
            rows = self.chunks.where(search.eligible(plan.wellbore, *dates, own))
            candidates = rows.count()
            scored = words
            if stage == 2 and candidates:
                both = words.withColumnRenamed("score", "w").join(self._scores("chars", plan.search_text).withColumnRenamed("score", "c"), KEY, "full_outer")
                scored = both.select(KEY, (search.BLEND * F.coalesce("w", F.lit(0.0)) + (1 - search.BLEND) * F.coalesce("c", F.lit(0.0))).alias("score"))
            ranked = rows.join(scored, KEY, "left").withColumn("score", boosted(F.coalesce("score", F.lit(0.0)), plan, sections)).where(F.col("score") >= least)
            top = search.top_hits(ranked, KEY, plan.limit, recent_first=plan.latest_first, period="period_end")
            hits = top.select(*SHOWN, F.substring(TEXT, 1, 700).alias("excerpt"), python_round(F.col("score"), 4).alias("score"), F.lit(stage).alias("stage")).collect() if candidates else []
            if hits:
                break
        kinds = tuple(sorted({h.source_type for h in hits if h.source_type}))
        return hits, Diagnostics("ready", self.fingerprint, self.n, round(self.build_seconds, 3), stage, candidates, len(hits), kinds)


def lexical_search(chunks: DataFrame, query: str, limit: int, folder: str) -> list[Row]:
    """The best chunks for a text, without filters."""
    return Retriever(chunks, folder).search(Plan(query, "en", "en", "", 0.0, terms=query.split(), limit=limit))[0]
