"""A counterfactual-regularised toxicity classifier.

A logistic model over the presence of words and of their stems (first bytes, so that unseen
inflections count).  For every labelled text that mentions an identity
term, the fit also looks at that text with the term swapped for each other term of its set and for
none, and penalises the squared change of the score's logit.  Weight that a term gained only by
standing in toxic texts is so pushed back to zero, and neutral mentions of a group stay neutral.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldspar.llm import kernel
from fieldspar.llm.storage import drop, materialize, small_batches

#: Sets of terms that may stand for each other (single lower-case words); a corpus may bring its own.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("women", "men", "girls", "boys", "nonbinary", "transgender"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "lesbian", "bisexual", "straight", "queer"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("deaf", "blind", "disabled", "autistic"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "christen", "juden", "hindus"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "hindous"),
    ("mujeres", "hombres", "chicas", "chicos"),
    ("musulmanes", "cristianos", "judíos", "hindúes"),
    # The language that a text is in marks the group that speaks it.
    ("the", "der", "le", "el"), ("this", "diese", "cette", "esta"), ("is", "ist", "est"), ("and", "und", "et"), ("with", "mit", "avec", "con"),
    ("was", "war", "était", "era"), ("from", "von", "depuis", "desde"), ("that", "dass", "que"), ("for", "für", "pour", "para"), ("in", "im", "dans"),
)

#: Labelled rows that a fit uses at most: of each label, those with the smallest hash of their id, half the bound or what the other leaves.
MAX_ROWS = 50_000
#: A word counts if that many labelled rows have it, its share differs by so many deviations - of a million words, one
#: does by chance - and by that factor: words of a language or a topic that is toxic a little more often tell little.
MIN_ROWS, MIN_Z, MIN_RATIO = 5, 5.0, 2.0
#: Weight of the ridge, and of the counterfactual penalty for each text.
RIDGE, FAIRNESS = 0.02, 5.0
#: Bytes of a word's stems.
STEMS = (4, 5, 6)


@dataclass
class ToxicityModel:
    """Words by hash, in ascending order, their weights and the intercept."""

    words: np.ndarray
    weights: np.ndarray
    bias: float
    stems: tuple[int, ...] = STEMS

    def logits(self, column: pa.Array) -> np.ndarray:
        """The logit of each row of a string column."""
        return self.bias + np.bincount((p := _present(column, self.words, self.stems))[0], self.weights[p[1]], minlength=len(column)) if len(self.words) else np.full(len(column), self.bias)

    def scores(self, column: pa.Array) -> np.ndarray:
        """Scores from 0 to 1."""
        return 1 / (1 + np.exp(-np.clip(self.logits(column), -30, 30)))


def _present(column: pa.Array, vocabulary: np.ndarray, stems: tuple[int, ...]) -> np.ndarray:
    """(row, word) for each vocabulary word or stem that a row has, once."""
    hashes, counts = kernel.words(column, kernel.LETTERS, stems=stems)
    marks = np.zeros(1 << 16, bool)
    marks[vocabulary & np.uint64(0xFFFF)] = True
    maybe = np.flatnonzero(marks[hashes & np.uint64(0xFFFF)])
    at = np.minimum(np.searchsorted(vocabulary, hashes[maybe]), len(vocabulary) - 1)
    right = vocabulary[at] == hashes[maybe]
    row = np.searchsorted(np.cumsum(counts), maybe[right], side="right")
    return np.unique(np.stack([row, at[right]]), axis=1)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's (word, label, rows)."""
    for batch in kernel.small(batches, 0):
        hashes, counts = kernel.words(batch.column(0), kernel.LETTERS, stems=STEMS)
        label = np.asarray(batch.column(1).to_numpy(zero_copy_only=False), np.int64)
        pairs = [np.unique(hashes[a:b]) for a, b in kernel.row_slices(counts)]
        for want in (0, 1):
            own = [p for p, y in zip(pairs, label, strict=True) if y == want]
            if own:
                word, n = np.unique(np.concatenate(own), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(np.full(len(word), want)), pa.array(n)], names=["word", "label", "n"])


def _features(vocabulary: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernel.small(batches, 0):
            row, word = _present(batch.column(0), vocabulary, STEMS)
            cuts = np.searchsorted(row, np.arange(batch.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(word.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(1), lists], names=["label", "words"])

    return run


@dataclass
class Rows:
    """Which words each of n rows has: (row, word) pairs.  Column ``width`` is the intercept."""

    n: int
    width: int
    row: np.ndarray
    word: np.ndarray

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.word], minlength=self.n) + w[-1]

    def transposed(self, v: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(self.word, v[self.row], minlength=self.width), v.sum())


def _changes(present: Rows, sets: list[list[int]]) -> list[tuple[int, int, float]]:
    """Entries of the sum, over all texts and swaps within a set, of the outer product of the change of features."""
    out = []
    for own in sets:
        column = np.full(present.width, -1, np.int64)
        column[own] = np.arange(len(own))
        at = column[present.word]
        has = np.zeros((present.n, len(own)))
        has[present.row[at >= 0], at[at >= 0]] = 1
        both = has.T @ has
        share = 1 / len(own)  # each other term, and none
        for i, g in enumerate(own):
            n = both[i, i]
            out.append((g, g, n * share))  # the term left out
            for j, h in enumerate(own):
                if i != j:
                    put = (n - both[i, j]) * share  # where a text has both, the swap only takes the term away
                    out += [(g, g, n * share), (h, h, put), (g, h, -put), (h, g, -put)]
    return out


def _solve(x: Rows, y: np.ndarray, ridge: np.ndarray, entries: list[tuple[int, int, float]]) -> np.ndarray:
    """Weights of least penalised logistic loss, by Newton steps that conjugate gradients find; nothing is dense."""
    i, j, value = (np.array(v) for v in zip(*entries, strict=True)) if entries else (np.zeros(0, np.int64),) * 3
    penalty = lambda w: ridge * w + np.bincount(i, value * w[j], minlength=len(w))
    diagonal = ridge + np.bincount(i[i == j], value[i == j], minlength=len(ridge))

    def loss(w: np.ndarray) -> float:
        z = x.times(w)
        return float(np.logaddexp(0, z).sum() - y @ z + 0.5 * w @ penalty(w))

    w, now = np.zeros(len(ridge)), float(len(y) * np.log(2))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x.times(w), -40, 40)))
        d = np.maximum(p * (1 - p), 1e-9)
        gradient = x.transposed(p - y) + penalty(w)
        scale = 1 / (diagonal + x.transposed(d))
        step, r = np.zeros(len(w)), gradient.copy()
        z = scale * r
        q, rz = z.copy(), r @ z
        for _ in range(300):
            if r @ r <= 1e-6 * min(1.0, gradient @ gradient) * (gradient @ gradient):  # the closer to the end, the more exactly
                break
            hq = x.transposed(d * x.times(q)) + penalty(q)
            a = rz / (q @ hq)
            step, r = step + a * q, r - a * hq
            z = scale * r
            rz, old = r @ z, rz
            q = z + rz / old * q
        size = 1.0
        while (then := loss(w - size * step)) > now + 1e-12 * abs(now) and size > 1e-6:
            size /= 2
        w, now = w - size * step, then
        if np.abs(size * step).max() < 1e-6:
            break
    return w


def _sample(rows: DataFrame, label_col: str, place: Column, most: int) -> DataFrame:
    """At most ``most`` rows, of both labels if there are both: of each the first by ``place``, half of them or what the other leaves."""
    n = {r[label_col]: r["count"] for r in rows.groupBy(label_col).count().collect()}
    if sum(n.values()) <= most:
        return rows
    parts = []
    for label, own in n.items():
        rest = sum(v for k, v in n.items() if k != label)
        quota = min(own, max(most // 2, most - rest))
        share = min(1.0, 1.2 * quota / own + 200 / own)  # thinned out before the exact cut
        near = rows.where(F.col(label_col) == label).where(F.pmod(place, F.lit(1 << 30)) <= int(share * (1 << 30)))
        parts.append(near.orderBy(F.pmod(place, F.lit(1 << 30)), place).limit(quota))
    return reduce(DataFrame.union, parts)


def fit_toxicity(labelled: DataFrame, text_col: str = "text", label_col: str = "toxic", *, fairness: float = FAIRNESS, terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS) -> ToxicityModel:
    """Fit on (text, label 0 or 1) rows; of more than MAX_ROWS, a sample that keeps both labels.

    Word counts are aggregated on the executors; the driver gets the words that tell the labels
    apart and, for each row of the bounded sample, which of them it has.  Rows with a null label are
    left out, a null text counts as empty, repeated rows count as often as they stand.  With no
    labelled rows, or one label only, the score is that label's (0.5 with none).
    """
    small_batches(labelled.sparkSession)
    rows = labelled.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(label_col).cast("long").alias("label")).where("label in (0, 1)")
    rows = materialize(rows, "labelled")
    few = _sample(rows.withColumn("place", F.xxhash64(F.monotonically_increasing_id())), "label", F.col("place"), MAX_ROWS)
    if rows.count() > MAX_ROWS:
        few, whole = materialize(few.select("text", "label"), "labelled"), rows
        drop(whole)
        rows = few
    n = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    if not n0 or not n1:
        return ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), 0.0 if not n0 + n1 else 4.0 if n1 else -4.0)

    counts = rows.mapInArrow(_word_counts, "word long, label long, n long").groupBy("word").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum("n").alias("df"))
    mean = F.col("df") / (n0 + n1)
    z = (F.col("a") / n1 - (F.col("df") - F.col("a")) / n0) / F.sqrt(F.greatest(mean * (1 - mean), F.lit(1e-12)) * (1 / n0 + 1 / n1))
    toxic, clean = F.col("a") / n1, (F.col("df") - F.col("a")) / n0
    apart = F.greatest(toxic, clean) >= MIN_RATIO * F.least(toxic, clean)
    best = counts.where((F.col("df") >= MIN_ROWS) & (F.abs(z) >= MIN_Z) & apart).select("word")
    chosen = best.toArrow().column("word").to_numpy().view(np.uint64)

    names = [t for group in terms for t in group]
    hashed = dict(zip(names, kernel.words(pa.array(names, pa.string()), kernel.LETTERS)[0].tolist(), strict=True))
    # A term counts by its own weight alone, which the swaps penalise, not by its stems.
    chosen = np.setdiff1d(chosen, kernel.words(pa.array(names, pa.string()), kernel.LETTERS, stems=STEMS)[0])
    vocabulary = np.unique(np.concatenate([chosen, np.array(list(hashed.values()), np.uint64)]))
    place = {int(h): i for i, h in enumerate(vocabulary)}
    sets = [sorted({place[hashed[t]] for t in group}) for group in terms]

    data = rows.mapInArrow(_features(vocabulary), "label long, words array<int>").toArrow()
    drop(rows)
    lists, y = data.column("words").combine_chunks(), data.column("label").to_numpy().astype(float)
    lengths = lists.value_lengths().to_numpy()
    x = Rows(len(y), len(vocabulary), np.repeat(np.arange(len(y)), lengths), lists.flatten().to_numpy().astype(np.int64))
    entries = [(g, h, fairness * v) for g, h, v in _changes(x, sets) if v] if fairness else []
    w = _solve(x, y, np.append(np.full(len(vocabulary), RIDGE), 1e-6), entries)
    return ToxicityModel(vocabulary, w[:-1], float(w[-1]))


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", score_col: str = "toxicity") -> DataFrame:
    """All columns of ``docs`` and the score of its text; null and empty texts get the model's base score.

    ``score_col`` replaces a column of that name.  Repeated rows get equal scores, an empty table
    stays empty.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop(score_col)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernel.small(batches, at):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.scores(batch.column(at)))], names=[*batch.schema.names, score_col])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())]))


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept from training: CRC-32 of its id's text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_texts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(text, label) of the labelled documents that training may see, of at most MAX_ROWS ids.

    Which ids are in is decided on the labels alone, so that a bounded list of ids (16 bytes each) is
    sent to the scan of the documents.  Null ids and labels are left out; of an id's labels the
    largest counts; an id's rows all have its label.
    """
    marks = labels.where(F.col(label_col).isNotNull() & ~held_out(id_col) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias(label_col))
    marks = materialize(_sample(marks, label_col, F.xxhash64("id"), MAX_ROWS), "marks")
    return docs.join(F.broadcast(marks), docs[id_col] == marks["id"]).select(docs[text_col], marks[label_col])
