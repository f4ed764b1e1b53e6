"""Activity classification: training rows, grouped split, TF-IDF with logistic regression, metrics and gates."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer, ElementwiseProduct, Normalizer, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldspar.functions.text import collapse
from fieldspar.operators.search import text_char_grams, word_grams

# Confidence that a predicted label needs, and what a model must reach to be used.
THRESHOLDS = {"main": 0.55, "sub": 0.40}
GATES = {"main": 0.50, "sub": 0.25}
MIN_CLASS = 20
# The vocabularies of word and character grams.
WORD_FEATURES, CHAR_FEATURES = 12_000, 18_000
#: Bytes of keyword labels that are sent to every task; more are joined by a merge.
LABEL_BYTES = 8 << 20


def majority_labels(rows: DataFrame, text: str, labels: list[str], row_id: str) -> DataFrame:
    """One row for each text: its most frequent labels, of equal ones the smallest, and the first row that has them."""
    counts = rows.groupBy(text, *labels).agg(F.count("*").alias("n"), F.min(row_id).alias("row_id"))
    best = F.min_by(F.struct(*labels, "n", "row_id"), F.struct(-F.col("n"), *labels))
    return counts.groupBy(text).agg(best.alias("b")).select(text, *[F.col(f"b.{c}").alias(c) for c in labels], F.col("b.n").alias("votes"), F.col("b.row_id").alias("row_id"))


def training_rows(operations: DataFrame) -> DataFrame:
    """Deduplicated (remark, main, sub, operation_id, report_id) of operations with known labels."""
    known = operations.where("main_activity is not null and main_activity <> 'unknown'").withColumn("remark_key", F.lower(collapse(F.col("remark")))).where("remark_key <> ''")
    best = majority_labels(known, "remark_key", ["main_activity", "sub_activity"], "operation_id")
    return best.join(known.select(F.col("operation_id").alias("row_id"), "report_id"), "row_id")


def fold(group: Column, folds: int = 5) -> Column:
    """A group's fold: rows of a group are all in it."""
    return F.pmod(F.xxhash64(group), F.lit(folds))


def grouped_split(rows: DataFrame, group: str, folds: int = 5) -> tuple[DataFrame, DataFrame]:
    """(train, test) without a group in both."""
    return rows.where(fold(F.col(group), folds) != 0), rows.where(fold(F.col(group), folds) == 0)


def leaked_groups(train: DataFrame, test: DataFrame, group: str) -> DataFrame:
    """Groups that are on both sides; empty for a right split."""
    return train.select(group).intersect(test.select(group))


def large_classes(rows: DataFrame, label: str, least: int = MIN_CLASS) -> DataFrame:
    """Rows of classes with enough of them."""
    enough = rows.groupBy(label).agg(F.count("*").alias("n")).where(F.col("n") >= least).select(label)
    return rows.join(enough, label, "left_semi")


def _grams(rows: DataFrame, text: str) -> DataFrame:
    return rows.withColumns({"_words": word_grams(F.col(text)), "_chars": text_char_grams(F.col(text), (3, 4, 5))})


def _weighting(rows: DataFrame, grams: str, most: int) -> list[Transformer]:
    """Stages from grams to vectors of length 1, fitted: ``ln((1 + n) / (1 + df)) + 1`` for each gram of a text, of the ``most`` frequent ones in two texts or more."""
    counter = CountVectorizer(inputCol=grams, outputCol=f"{grams}_n", vocabSize=most, minDF=2.0, binary=True).fit(rows)
    rarity = IDF(inputCol=f"{grams}_n", outputCol=f"{grams}_idf").fit(counter.transform(rows))
    smooth = ElementwiseProduct(scalingVec=Vectors.dense([x + 1 for x in rarity.idf.toArray()]), inputCol=f"{grams}_n", outputCol=f"{grams}_w")
    return [counter, smooth, Normalizer(p=2.0, inputCol=f"{grams}_w", outputCol=f"{grams}_v")]


def fit_classifier(train: DataFrame, text: str, label: str, *, words: int = WORD_FEATURES, chars: int = CHAR_FEATURES, iterations: int = 600) -> tuple[PipelineModel, list[str]]:
    """A class-balanced logistic regression over TF-IDF vectors of word and of character grams, each with a vocabulary of its own, and its labels by index.

    A gram that a text repeats counts once.  The penalty is that of a sum of losses: half the weights' squares.
    """
    counts = train.groupBy(label).agg(F.count("*").alias("_n"))
    total, kinds = counts.agg(F.sum("_n"), F.count("*")).first()
    rows = _grams(train, text).join(counts, label).withColumn("_weight", F.lit(float(total)) / (F.lit(float(kinds)) * F.col("_n")))
    stages = [StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc", handleInvalid="keep").fit(rows)]
    stages += [*_weighting(rows, "_words", words), *_weighting(rows, "_chars", chars), VectorAssembler(inputCols=["_words_v", "_chars_v"], outputCol="_features")]
    learner = LogisticRegression(
        featuresCol="_features", labelCol="_label", weightCol="_weight", regParam=1 / total, standardization=False, maxIter=iterations,
        probabilityCol="_p", predictionCol="_prediction", rawPredictionCol="_raw",
    )
    model = PipelineModel([*stages, learner.fit(PipelineModel(stages).transform(rows))])
    indexer: StringIndexerModel = model.stages[0]
    return model, list(indexer.labels)


def classify(rows: DataFrame, text: str, model: tuple[PipelineModel, list[str]], threshold: float) -> DataFrame:
    """Adds predicted and confidence; below the threshold the label is unknown."""
    pipeline, labels = model
    grams = _grams(rows, text)
    for stage in pipeline.stages[1:]:
        grams = stage.transform(grams)
    p = vector_to_array("_p")
    named = F.get(F.array(*map(F.lit, labels)), F.col("_prediction").cast("int"))
    best = F.array_max(p)
    return grams.select(*rows.columns, F.when(best >= threshold, F.coalesce(named, F.lit("unknown"))).otherwise("unknown").alias("predicted"), best.alias("confidence"))


def keyword_baseline(rows: DataFrame, key: str, text: str, labels: DataFrame, label: str, default: str, *, most_words: int | None = None) -> DataFrame:
    """The longest label whose words a text contains, of equal ones the smallest, else a default.

    Texts and labels are read as words of letters and digits; a text's runs of as many words as some
    label has (at most ``most_words``, if given) are looked up among the labels, so no text meets every
    label.  The labels are counted when this is called: few are sent to every task, more are merged.  The
    runs, which are many times the rows, are never sent, small as Spark takes them to be.
    """
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    names = labels.select(F.col(label).alias("_l")).distinct().withColumn("_run", plain("_l")).where("_run <> ''")
    size = names.agg(F.sum(F.octet_length("_l") + F.octet_length("_run") + 32).alias("bytes"), F.collect_set(F.size(F.split("_run", " "))).alias("words")).first()
    names = F.broadcast(names) if (size["bytes"] or 0) <= LABEL_BYTES else names.hint("merge")
    of = lambda n: F.transform(F.sequence(F.lit(1), F.size("_words") - n + 1), lambda i: F.array_join(F.slice("_words", i, F.lit(n)), " "))
    runs = [F.when(F.size("_words") >= n, of(n)).otherwise(F.array().cast("array<string>")) for n in sorted(size["words"]) if most_words is None or n <= most_words]
    texts = rows.select(key, F.split(plain(text), " ").alias("_words"))
    hits = texts.select(key, F.explode(F.array_distinct(F.concat(F.array().cast("array<string>"), *runs))).alias("_run")).join(names, "_run")
    best = hits.groupBy(key).agg(F.min(F.struct(-F.length("_l"), "_l")).alias("_best")).select(key, F.col("_best._l").alias("predicted"))
    return rows.join(best, key, "left").withColumn("predicted", F.coalesce("predicted", F.lit(default)))


def precedence(source: Column, rule: Column, predicted: Column, confidence: Column) -> Column:
    """(label, origin, confidence): the source's label, then a rule's, then the model's, else unknown."""
    known = lambda c: F.when(c != "unknown", c)
    s, r, p = known(source), known(rule), known(predicted)
    return F.struct(
        F.coalesce(s, r, p, F.lit("unknown")).alias("label"),
        F.when(s.isNotNull(), "source").when(r.isNotNull(), "rule").when(p.isNotNull(), "model").otherwise("unknown").alias("origin"),
        F.when(s.isNotNull() | r.isNotNull(), 1.0).when(p.isNotNull(), confidence).otherwise(0.0).alias("confidence"),
    )


def confusion(rows: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(actual, predicted, n)."""
    return rows.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def confusion_pairs(pairs: DataFrame, limit: int = 20) -> DataFrame:
    """The most frequent mistakes."""
    return pairs.where("actual <> predicted").orderBy(F.desc("n"), "actual", "predicted").limit(limit)


def class_metrics(pairs: DataFrame) -> DataFrame:
    """(label, support, precision, recall, f1) over all actual and predicted labels; 0 where a share has no base."""
    actual = pairs.groupBy(F.col("actual").alias("label")).agg(F.sum("n").alias("support"))
    guessed = pairs.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("guessed"))
    right = pairs.where("actual = predicted").select(F.col("actual").alias("label"), F.col("n").alias("hits"))
    rows = actual.join(guessed, "label", "full_outer").join(right, "label", "left").fillna(0, ["support", "guessed", "hits"])
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    rows = rows.withColumns({"precision": share(F.col("hits"), F.col("guessed")), "recall": share(F.col("hits"), F.col("support"))})
    return rows.select("label", "support", "precision", "recall", share(2 * F.col("hits"), F.col("guessed") + F.col("support")).alias("f1"))


def overall_metrics(pairs: DataFrame) -> DataFrame:
    """(n, accuracy, macro_f1, weighted_f1)."""
    by_class = class_metrics(pairs)
    total = pairs.agg(F.sum("n").alias("n"), (F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))
    return total.crossJoin(by_class.agg(F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1")))


def promoted(kind: str, macro_f1: float, baseline_f1: float) -> bool:
    """Whether a model may be used: above its gate and above the baseline."""
    return macro_f1 >= GATES[kind] and macro_f1 > baseline_f1


def first_occurrence(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row of each group."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")


def artefact_hash(spark: SparkSession, path: str) -> str:
    """SHA-256 over the names and hashes of a saved model's files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "[!_.]*").load(path)
    own = files.select(F.regexp_extract("path", r"/((?:metadata|stages|data)/.*)$", 1).alias("name"), F.sha2("content", 256).alias("sha"))
    listed = own.agg(F.array_sort(F.collect_list(F.concat_ws(":", "name", "sha"))).alias("all"))  # a model has a few dozen files
    return listed.select(F.sha2(F.array_join("all", "\n"), 256)).first()[0]


def save_classifier(model: tuple[PipelineModel, list[str]], path: str, *, version: str, is_promoted: bool) -> None:
    """Write a model, and beside it its labels, version, promotion and hash."""
    pipeline, labels = model
    pipeline.write().overwrite().save(f"{path}/model")
    spark = SparkSession.active()
    row = (version, is_promoted, labels, artefact_hash(spark, f"{path}/model"))
    spark.createDataFrame([row], "version string, promoted boolean, labels array<string>, sha256 string").coalesce(1).write.mode("overwrite").json(f"{path}/about")


def load_classifier(spark: SparkSession, path: str, version: str | None = None) -> tuple[PipelineModel, list[str]] | None:
    """A saved model, or None unless it was promoted, its files have the hash that was noted, and the version is the one asked for."""
    try:
        about = spark.read.schema("version string, promoted boolean, labels array<string>, sha256 string").json(f"{path}/about").first()
    except AnalysisException:
        return None
    if about is None or not about.promoted or version not in (None, about.version) or about.sha256 != artefact_hash(spark, f"{path}/model"):
        return None
    return PipelineModel.load(f"{path}/model"), list(about.labels)
