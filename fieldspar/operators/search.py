"""TF-IDF search over chunks: word grams first, character grams where those find nothing.

Weights are ``(1 + ln tf) * (ln((1 + n) / (1 + df)) + 1)``, vectors have length 1.  The index is a
table of postings, so a query is a semi-join of its few terms with the postings and a sum.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldspar.functions.text import index_words
from fieldspar.sources.sinks import scratch

WORD_CAP, CHAR_CAP, CHAR_MIN_DF = 25_000, 12_000, 3
#: Terms of all queries that are sent to every task; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Between the texts of one key.
BREAK = " \n "
#: Bytes of texts that a task counts at once; texts and queries that are scored, and texts whose character grams are expanded at once.
PIECE, DOCS, QUERIES, BLOCK = 12 << 20, 2000, 256, 128
#: Pairs of words that are sent to every task to be counted.
PAIRS = 200_000
#: What scores may differ by and be equal to six places.
TIE = 2e-6
WORD_LEAST, BLEND_LEAST, BLEND = 0.035, 0.012, 0.65

# What a hit's score gains.
BOOSTS = {"wellbore": 0.18, "section": 0.12, "identifier": 0.18, "activity": 0.1, "equipment": 0.1}


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, as a lambda's variable."""
    return F.get(F.transform(F.array(value), use), 0)


def word_grams(text: Column, most: int = 2) -> Column:
    """Words and runs of up to ``most`` words."""

    def runs(tokens: Column) -> Column:
        grams = [tokens]
        for n in range(2, most + 1):  # each run is the one before it and the next word
            left = F.greatest(F.size(tokens) - n + 1, F.lit(0))
            grams.append(F.zip_with(F.slice(grams[-1], 1, left), F.slice(tokens, n, left), lambda a, b: F.concat_ws(" ", a, b)))
        return F.concat(*grams)

    return _bound(index_words(text), runs)


def char_grams(word: Column, sizes: tuple[int, ...] = (3, 4)) -> Column:
    """Character grams of a word with a space on either side."""
    own = lambda w, n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - n + 1, F.lit(1))), lambda i: F.substring(w, i, n))
    return _bound(F.concat(F.lit(" "), word, F.lit(" ")), lambda w: F.concat(*[own(w, n) for n in sizes]))


def text_char_grams(text: Column, sizes: tuple[int, ...] = (3, 4)) -> Column:
    """Character grams of all words of a text."""
    return F.flatten(F.transform(index_words(text), lambda w: char_grams(w, sizes)))


def word_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf) of words and pairs of words.

    Texts are dealt by key, which is the only shuffle: counts, norms and scores by key follow in place.
    """
    return docs.select(key, text).repartition(key).select(key, F.explode(word_grams(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def char_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf) of character grams; each distinct word of a text is cut into grams once."""
    words = docs.select(key, text).repartition(key).select(key, F.explode(index_words(F.col(text))).alias("w")).groupBy(key, "w").agg(F.count("*").alias("n"))
    grams = words.select(key, "n", F.explode(char_grams(F.col("w"))).alias("term"))
    return grams.groupBy(key, "term").agg(F.sum("n").alias("tf"))


@dataclass(frozen=True)
class Index:
    """Postings (key, term, weight) of document vectors of length 1, the terms' (term, df), and the number of documents."""

    postings: DataFrame
    terms: DataFrame
    n_docs: int


def build_index(counts: DataFrame, key: str, n_docs: int, *, cap: int, min_df: int = 1) -> Index:
    """An index of (key, term, tf) over the most frequent terms, of equal ones the first by name.

    The terms, at most ``cap``, are kept in memory; the postings are a plan over the documents.
    """
    terms = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).where(F.col("df") >= min_df)
    terms = terms.orderBy(F.desc("total"), "term").limit(cap).select("term", "df").persist()
    raw = counts.join(F.broadcast(terms), "term").withColumn("w", _weight(n_docs))
    norms = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.collect_list(F.struct("term", "w")).alias("own"))
    rows = norms.select(key, "norm", F.explode("own").alias("o")).select(key, "o.term", (F.col("o.w") / F.col("norm")).alias("weight"))
    return Index(rows, terms, n_docs)


def _weight(n: int) -> Column:
    return (1 + F.log("tf")) * (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1)


def query_vector(index: Index, counts: DataFrame, query_key: str) -> DataFrame:
    """(query, term, query_weight): query vectors of length 1 over the index's terms."""
    raw = counts.join(F.broadcast(index.terms), "term").withColumn("w", _weight(index.n_docs))
    norms = raw.groupBy(query_key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norms, query_key).select(query_key, "term", (F.col("w") / F.col("norm")).alias("query_weight"))


def cosine(index: Index, key: str, vector: DataFrame, query_key: str) -> DataFrame:
    """(query, key, score) of the documents that share a term."""
    vector = vector.persist()
    if vector.count() <= BROADCAST_ROWS:  # the postings stay where they are
        vector = F.broadcast(vector)
    return index.postings.join(vector, "term").groupBy(query_key, key).agg(F.sum(F.col("weight") * F.col("query_weight")).alias("score"))


def boost(score: Column, *, wellbore: Column, section: Column, identifier: Column, signals: Column, activity: Column, equipment: Column) -> Column:
    """A score with what its chunk's facts add; ``signals`` is the number of rare terms that it has."""
    gain = lambda test, name: F.when(F.coalesce(test, F.lit(False)), BOOSTS[name]).otherwise(0.0)
    return score + gain(wellbore, "wellbore") + gain(section, "section") + gain(identifier, "identifier") + F.least(F.lit(0.3), 0.2 * signals) + gain(activity, "activity") + gain(equipment, "equipment")


def eligible(wellbore: str | None, date_from: str | None, date_to: str | None, sections: list[str] | None = None) -> Column:
    """Filter on a chunk's well, period and section; without a period it fails any date bound."""
    test = F.lit(True)
    if wellbore:
        test = test & (F.lower("wellbore") == wellbore.lower())
    if date_from:
        test = test & F.coalesce(F.to_date("period_end") >= F.lit(date_from).cast("date"), F.lit(False))
    if date_to:
        test = test & F.coalesce(F.to_date("period_end") <= F.lit(date_to).cast("date"), F.lit(False))
    if sections:
        test = test & F.col("section_type").isin(*sections)
    return test


def top_hits(scored: DataFrame, key: str, k: int, *, recent_first: bool = False, period: str | None = None) -> DataFrame:
    """The k best hits: by score, newest period, smallest key; or newest first among all hits."""
    newest = F.col(period).desc_nulls_last() if period else None
    order = [F.desc("score")] + ([newest] if newest is not None else [])
    if recent_first and newest is not None:
        order = [newest, F.desc("score")]
    return scored.orderBy(*order, F.asc(key)).limit(k)


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, words): a table, written once, of the words of each key's texts, the texts of a repeated key apart."""
    spark = docs.sparkSession
    folder = scratch(spark, "search_words")
    words = docs.select(key, F.array_join(index_words(F.col(text)), " ").alias("words"))
    words.write.parquet(f"{folder}/rows")
    rows = spark.read.schema(words.schema).parquet(f"{folder}/rows")
    if rows.select(key).distinct().count() == rows.count():
        return rows
    joined = rows.groupBy(key).agg(F.array_join(F.collect_list("words"), BREAK).alias("words"))
    joined.write.parquet(f"{folder}/keys")
    return spark.read.schema(joined.schema).parquet(f"{folder}/keys")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about PIECE bytes at most."""
    for batch in batches:
        step = max(1, -(-batch.num_rows * PIECE // max(batch.nbytes, PIECE)))
        yield from (batch.slice(at, step) for at in range(0, batch.num_rows, step))


def _read(words: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Each word's text and number, -1 between texts, and the different words."""
    lists = pc.split_pattern(words.fill_null(""), " ")
    coded = lists.flatten().dictionary_encode()
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    none = pc.is_in(coded.dictionary, value_set=pa.array(["", BREAK.strip(" ")])).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(words)), pc.list_value_length(lists).to_numpy(zero_copy_only=False)), np.where(none[ids], -1, ids), coded.dictionary


def _pairs(doc: np.ndarray, ids: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """The text and the code, first * base + second, of each pair of neighbouring words that both have a number."""
    good = (ids[:-1] >= 0) & (ids[1:] >= 0) & (doc[:-1] == doc[1:])
    return doc[:-1][good], ids[:-1][good] * base + ids[1:][good]


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values, sorted, and how often each comes."""
    values = np.sort(values)
    at = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, dtype=np.int64)
    return values[at], np.diff(at, append=len(values))


def _totals(doc: np.ndarray, code: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, df, total)."""
    both, times = _runs(code * n_docs + doc)
    codes, df = _runs(both // n_docs)
    return codes, df, np.add.reduceat(times, np.cumsum(df) - df) if len(df) else df


def _gram_codes(words: pa.Array, known: np.ndarray | None = None) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For 3 and 4 characters, each word's (first gram, grams) as codes over the letters that ``known`` or the words have; those letters."""
    spaced = np.frombuffer("".join(f" {w} " for w in words.to_pylist()).encode("utf-32-le"), np.uint32)
    letters = np.unique(np.concatenate([np.flatnonzero(np.bincount(spaced, minlength=1)), [] if known is None else known])).astype(np.int64)
    table = np.zeros(int(letters.max(initial=0)) + 1, dtype=np.int64)
    table[letters] = np.arange(len(letters))
    code, ends = table[spaced], np.cumsum(pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 2)
    out = []
    for size in (3, 4):
        n = np.maximum(np.diff(ends, prepend=0) - size + 1, 0)
        at = _expand(ends - np.diff(ends, prepend=0), n)
        total = np.full(len(at), size - 3, dtype=np.int64)  # so that codes of 3 and 4 differ
        for i in range(size):
            total = total * len(letters) + code[at + i]
        out.append((total, n))
    return out, letters


def _expand(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each, n in all."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _texts_of(codes: np.ndarray, letters: np.ndarray) -> list[str]:
    """Grams of codes, the reverse of _gram_codes()."""
    base = len(letters)
    out = []
    for c in codes.tolist():
        c, chars = (c, 3) if c < base**3 else (c - base**4, 4)
        g = ""
        for _ in range(chars):
            c, x = divmod(c, base)
            g = chr(letters[x]) + g
        out.append(g)
    return out


def _by_text(doc: np.ndarray, ids: np.ndarray, n_words: int, grams: list[tuple[np.ndarray, np.ndarray]], n_docs: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, text, gram, times) of some texts at once: a gram for each different word of a text that has it."""
    good = ids >= 0
    both, times = _runs(doc[good] * n_words + ids[good])
    doc, word = both // n_words, both % n_words
    starts = [np.cumsum(n) - n for _, n in grams]
    for first in range(0, n_docs, BLOCK):
        part = slice(*np.searchsorted(doc, [first, first + BLOCK]))
        found = [(np.repeat(doc[part], n[word[part]]), codes[_expand(start[word[part]], n[word[part]])], np.repeat(times[part], n[word[part]])) for (codes, n), start in zip(grams, starts)]
        yield first, *(np.concatenate(x) for x in zip(*found))


def _counted(texts: DataFrame, kind: str, *, floor: float = 0.0, known: list[str] | None = None) -> DataFrame:
    """(term, df, total) of parts of the texts; the terms are words, pairs or chars.

    Of pairs, only those that come at least ``floor`` times for each word of a part, or only those known.
    """
    sent = texts.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = sent.value
        if only is not None:
            vocabulary = pa.array(dict.fromkeys(w for t in only for w in t.split(" ")), pa.string())
            number = {w: i for i, w in enumerate(vocabulary.to_pylist())}
            wanted = np.sort(np.array([number[a] * len(number) + number[b] for a, b in (t.split(" ") for t in only)], dtype=np.int64))
        for batch in _pieces(batches):
            doc, ids, words = _read(batch.column("words"))
            n = batch.num_rows
            if kind == "words":
                codes, df, total = _totals(doc[ids >= 0], ids[ids >= 0], n)
                terms = words.take(pa.array(codes))
            elif kind == "pairs":
                if only is not None:
                    words, place = vocabulary, pc.index_in(words, value_set=vocabulary).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                    ids = np.where(ids >= 0, place[ids], -1)
                base = max(len(words), 1)
                codes, df, total = _totals(*_pairs(doc, ids, base), n)
                kept = np.isin(codes, wanted) if only is not None else total >= floor * np.count_nonzero(ids >= 0)
                codes, df, total = codes[kept], df[kept], total[kept]
                terms = pc.binary_join_element_wise(words.take(pa.array(codes // base)), words.take(pa.array(codes % base)), " ")
            else:
                grams, letters = _gram_codes(words)
                different, where = np.unique(np.concatenate([c for c, _ in grams]), return_inverse=True)
                cut = len(grams[0][0])
                grams = [(where[:cut], grams[0][1]), (where[cut:], grams[1][1])]
                df, total = np.zeros((2, len(different)), dtype=np.int64)
                for _, at, gram, times in _by_text(doc, ids, len(words), grams, n):
                    total += np.bincount(gram, weights=times, minlength=len(different)).astype(np.int64)
                    df += np.bincount(_runs(at * len(different) + gram)[0] % max(len(different), 1), minlength=len(different))
                some = np.flatnonzero(df)
                terms, df, total = pa.array(_texts_of(different[some], letters), pa.string()), df[some], total[some]
            yield pa.record_batch([terms, pa.array(df, pa.int64()), pa.array(total, pa.int64())], ["term", "df", "total"])

    return texts.select("words").mapInArrow(run, "term string, df long, total long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))


def _top(counted: DataFrame, cap: int) -> list[tuple[str, int, int]]:
    return [tuple(r) for r in counted.orderBy(F.desc("total"), "term").limit(cap).select("term", "df", "total").collect()]


def _top_terms(texts: DataFrame, chars: bool) -> list[tuple[str, int]]:
    """The most frequent terms with their df, as build_index() takes them: at most CHAR_CAP or WORD_CAP.

    A pair is among them only if it is as frequent as the last of the most frequent words.  Then it is so,
    for its share of all words, in some part of the texts.  Sums over such parts bound what the last term
    needs; the few pairs that can reach that are counted in all texts, or all pairs where they aren't few.
    """
    if chars:
        return [t[:2] for t in _top(_counted(texts, "chars").where(F.col("df") >= CHAR_MIN_DF), CHAR_CAP)]
    folder = scratch(texts.sparkSession, "search_counts")
    _counted(texts, "words").write.parquet(folder)
    counts = texts.sparkSession.read.schema("term string, df long, total long").parquet(folder)
    words = _top(counts, WORD_CAP)
    every = counts.agg(F.sum("total")).first()[0] or 0
    known = None
    if len(words) == WORD_CAP:
        found, least = f"{folder}_pairs", words[-1][2]
        _counted(texts, "pairs", floor=least / every * (1 - 1e-9)).write.parquet(found)
        some = texts.sparkSession.read.schema("term string, df long, total long").parquet(found)
        last = min([r.total for r in counts.union(some).orderBy(F.desc("total")).limit(WORD_CAP).select("total").collect()])
        some = some.where(F.col("total") >= last - least)  # what parts left out of a pair is less than ``least``
        known = some.select("term").toArrow().column("term").to_pylist() if some.count() <= PAIRS else None
    pairs = _top(_counted(texts, "pairs", known=known), WORD_CAP) if known is None or known else []
    return [t[:2] for t in sorted(words + pairs, key=lambda t: (-t[2], t[0].encode()))[:WORD_CAP]]


class _Side:
    """One kind of term: document vectors over the index's terms, and the query vectors."""

    def __init__(self, terms: list[tuple[str, int]], n: int, chars: bool, vector: list[tuple[int, str, float]]) -> None:
        self.terms, self.chars = [t for t, _ in terms], chars
        self.idf = np.log((1 + n) / (1 + np.array([d for _, d in terms], dtype=float))) + 1
        number = {t: i for i, t in enumerate(self.terms)}
        vector = sorted((q, number[t], w) for q, t, w in vector)
        self.query, self.term = (np.array([v[i] for v in vector], dtype=np.int64) for i in (0, 1))
        self.weight = np.array([v[2] for v in vector], dtype=float)

    def prepare(self) -> None:
        """What a task needs to read texts."""
        number = {t: i for i, t in enumerate(self.terms)}
        if self.chars:
            self.letters = np.array(sorted({ord(c) for t in self.terms for c in t}), dtype=np.int64)
            return
        pairs = [(*t.split(" "), i) for t, i in number.items() if " " in t]
        words = {w: k for k, w in enumerate(dict.fromkeys([*(t for t in number if " " not in t), *(w for a, b, _ in pairs for w in (a, b))]))}
        self.words, self.base = pa.array(words, pa.string()), max(len(words), 1)
        self.single = np.array([number.get(w, -1) for w in words] + [-1])
        codes = np.array([words[a] * self.base + words[b] for a, b, _ in pairs] + [-1], dtype=np.int64)
        order = np.argsort(codes)
        self.codes, self.pair = codes[order], np.array([i for *_, i in pairs] + [-1])[order]

    def _found(self, doc: np.ndarray, ids: np.ndarray, words: pa.Array, n_docs: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(text, term, tf), by text."""
        size = len(self.terms)
        if not self.chars:
            place = pc.index_in(words, value_set=self.words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            ids = np.where(ids >= 0, place[ids], -1)
            at, codes = _pairs(doc, ids, self.base)
            spot = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
            hit, one = self.codes[spot] == codes, self.single[ids]
            both, tf = _runs(np.concatenate([doc[one >= 0] * size + one[one >= 0], at[hit] * size + self.pair[spot[hit]]]))
            yield both // max(size, 1), both % max(size, 1), tf
            return
        grams, letters = _gram_codes(words, self.letters)
        base, table = len(letters), {int(c): i for i, c in enumerate(letters)}
        codes = np.zeros(size, dtype=np.int64)
        for i, t in enumerate(self.terms):
            c = len(t) - 3
            for x in t:
                c = c * base + table[ord(x)]
            codes[i] = c
        order = np.append(np.argsort(codes), -1)
        codes = np.append(np.sort(codes), np.iinfo(np.int64).max)
        grams = [(np.where(codes[spot := np.searchsorted(codes, c)] == c, order[spot], -1), n) for c, n in grams]
        for first, at, gram, times in _by_text(doc, ids, len(words), grams, n_docs):
            at, gram, times = at[gram >= 0], gram[gram >= 0], times[gram >= 0]
            tf = np.bincount((at - first) * size + gram, weights=times, minlength=1)
            own = np.flatnonzero(tf)
            yield own // max(size, 1) + first, own % max(size, 1), tf[own]

    def vectors(self, texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """(terms, weights) of length 1 for each text."""
        n = len(texts)
        doc, term, tf = (np.concatenate(x) for x in zip(*self._found(*_read(texts), n)))
        w = (1 + np.log(tf)) * self.idf[term]
        w /= np.sqrt(np.bincount(doc, weights=w * w, minlength=n))[doc]
        ends = np.searchsorted(doc, np.arange(1, n))
        return list(zip(np.split(term, ends), np.split(w, ends)))

    def scores(self, vectors: list[tuple[np.ndarray, np.ndarray]], first: int, last: int) -> np.ndarray:
        """Cosines of the texts with the queries from ``first`` to before ``last``."""
        part = slice(*np.searchsorted(self.query, [first, last]))
        used, row = np.unique(self.term[part], return_inverse=True)
        asked = np.zeros((len(used), last - first))
        asked[row, self.query[part] - first] = self.weight[part]
        place = np.full(len(self.terms) + 1, -1)
        place[used] = np.arange(len(used))
        out = np.zeros((len(vectors), last - first))
        for i, (own, w) in enumerate(vectors):
            rows = place[own]
            hit = rows >= 0
            if hit.any():
                out[i] = w[hit] @ asked[rows[hit]]
        return out


def _scan(texts: DataFrame, key: str, sides: list[tuple[float, _Side]], names: DataFrame, n_queries: int, least: float, most: int | None) -> DataFrame:
    """(query, key, score) of at least ``least``, by one pass over the texts; scores are the sides' shares.

    With ``most``, a task leaves out what is below that many scores of its own by more than TIE.
    """
    sent = texts.sparkSession.sparkContext.broadcast(sides)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides, top = sent.value, {}
        for _, side in sides:
            side.prepare()
        for whole in _pieces(batches):
            for at in range(0, whole.num_rows, DOCS):
                batch = whole.slice(at, DOCS)
                own = batch.column("words")
                read = [side.vectors(own) for _, side in sides]
                for first in range(0, n_queries, QUERIES):
                    last = min(first + QUERIES, n_queries)
                    score = sum(share * side.scores(v, first, last) for (share, side), v in zip(sides, read))
                    good = score >= least
                    if most:
                        best = np.concatenate([top.get(first, np.full((most, last - first), -np.inf)), score])
                        top[first] = np.partition(best, len(best) - most, axis=0)[len(best) - most :]
                        good &= score >= top[first].min(axis=0) - TIE
                    doc, query = np.nonzero(good)
                    yield pa.record_batch([pa.array(query + first, pa.int64()), batch.column(key).take(pa.array(doc, pa.int64())), pa.array(score[doc, query], pa.float64())], ["_query", key, "score"])

    kind = texts.schema[key].dataType.simpleString()
    found = texts.select(key, "words").mapInArrow(run, f"_query long, `{key}` {kind}, score double")
    return found.join(F.broadcast(names), "_query").select(*[c for c in names.columns if c != "_query"], key, "score")


def two_stage(docs: DataFrame, key: str, text: str, queries: DataFrame, query_key: str, query_text: str, *, most: int | None = None) -> DataFrame:
    """(query, key, score, stage): word hits; queries without any get the blend of word and character scores.

    The character index is only built if there are such queries.  With ``most``, at least each query's
    best so many hits are returned and all whose score equals the last one's to six places; others may be
    left out.  Words are written once; terms are counted, and all queries scored, while texts are read,
    as grams or scores of all texts are many times the input.
    """
    spark = docs.sparkSession
    texts = _texts(docs, key, text)
    n = docs.count()
    keys = [r[0] for r in queries.where(F.col(query_key).isNotNull()).select(query_key).distinct().orderBy(query_key).collect()]
    number = {k: i for i, k in enumerate(keys)}
    names = spark.createDataFrame(list(enumerate(keys)), T.StructType([T.StructField("_query", T.LongType()), queries.schema[query_key]]))

    def side(terms: list[tuple[str, int]], chars: bool, asked: DataFrame) -> _Side:
        index = Index(docs, spark.createDataFrame(terms, "term string, df long"), n)
        vector = query_vector(index, (char_counts if chars else word_counts)(asked, query_key, query_text), query_key).collect()
        return _Side(terms, n, chars, [(number[r[0]], r.term, r.query_weight) for r in vector])

    terms = _top_terms(texts, False)
    strong = _scan(texts, key, [(1.0, side(terms, False, queries))], names, len(keys), WORD_LEAST, most).withColumn("stage", F.lit(1))
    folder = scratch(spark, "search_hits")
    strong.write.parquet(folder)
    strong = spark.read.schema(strong.schema).parquet(folder)
    open_ = queries.join(strong.select(query_key).distinct(), query_key, "left_anti")
    if open_.isEmpty():
        return strong
    keys = [r[0] for r in open_.where(F.col(query_key).isNotNull()).select(query_key).distinct().orderBy(query_key).collect()]
    number = {k: i for i, k in enumerate(keys)}
    names = spark.createDataFrame(list(enumerate(keys)), names.schema)
    sides = [(BLEND, side(terms, False, open_)), (1 - BLEND, side(_top_terms(texts, True), True, open_))]
    return strong.union(_scan(texts, key, sides, names, len(keys), BLEND_LEAST, most).withColumn("stage", F.lit(2)))
