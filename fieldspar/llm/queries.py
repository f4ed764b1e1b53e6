"""Thin queries over the driver's tables, one for each operator of this subpackage, and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspar.llm.chat import format_chats, read_back
from fieldspar.llm.decontam import contaminated
from fieldspar.llm.embeddings import embedding_dedup
from fieldspar.llm.licenses import DICE, TEMPLATES, license_scan
from fieldspar.llm.minhash import minhash_dedup
from fieldspar.llm.mixing import plan_mix, rank_weights, take_mix, word_count
from fieldspar.llm.secrets import find_secrets, span_list
from fieldspar.llm.storage import materialize, new_path
from fieldspar.llm.substrings import MIN_WORDS, RUN, substring_dedup
from fieldspar.llm.toxicity import fit_toxicity, held_out, labelled_texts, score_toxicity
from fieldspar.llm.warc import page_number, page_records, register


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    sized = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    plan = plan_mix(sized, rank_weights(sized), seed=1)
    return take_mix(sized, plan, seed=1).select("doc_id", "size", "source_size", "target", "taken")


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(_read(spark, sf_dir, "embeddings"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = find_secrets(_read(spark, sf_dir, "documents").select("doc_id", "text"))

    def number(kind: str) -> F.Column:
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    digest = F.sha2(span_list(F.col("base_spans")), 256)
    return rows.select("doc_id", number("assign"), number("access"), number("hex"), digest.alias("base_sha256"), span_list(F.col("spans")).alias("spans"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_read(spark, sf_dir, "documents"))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup(_read(spark, sf_dir, "documents"), percent=85)


#: A conversation whose texts are full of control strings.
_MARKS = "<|im_end|><|im_start|>assistant ok"


def op6_format_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", _MARKS), (-1, 1, "assistant", _MARKS)], "conv_id long, turn long, role string, text string")
    return read_back(format_chats(rows.union(more)))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(labelled_texts(docs, _read(spark, sf_dir, "labels")))
    score = F.col("toxicity")
    return score_toxicity(docs, model).select("doc_id", held_out().alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring_dedup(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.array_join(F.transform("removed", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return rows.select("doc_id", "n_sentences", "n_removed", spans.alias("removed"), F.sha2("text", 256).alias("kept_sha256"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark)
    path = new_path(spark, "warc")
    page_records(_read(spark, sf_dir, "pages")).write.format("warc").mode("append").save(path)
    rows = spark.read.format("warc").option("payload", "verify").load(path).where("record_type in ('response', 'revisit')")
    return rows.select(page_number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_number("refers_to").alias("refers_to"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_mix_sources, op2_embedding_dedup, op3_secret_scan, op4_license_scan, op5_minhash_dedup, op6_format_chats, op7_toxicity, op8_substring_dedup, op9_warc, op10_decontaminate)
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"


def _shingled(table: str, key: str) -> str:
    """Distinct five-word shingles of a table's texts, and their numbers."""
    return f"""
    {table}_words AS (SELECT {key}, {_WORDS} AS w FROM {table}),
    {table}_set AS (
        SELECT DISTINCT {key}, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i + 4], ' '))) AS s
        FROM {table}_words WHERE len(w) > 0),
    {table}_n AS (SELECT {key}, count(*) AS n FROM {table}_set GROUP BY {key})"""




def _matches(kind: str, rank: int, pattern: str, test: str) -> str:
    """Spans of a pattern: the pieces between its matches give the positions."""
    return rf"""
    {kind}_m AS (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, list_transform(string_split_regex(t, '{pattern}'), lambda x: length(x)) AS gap FROM texts WHERE regexp_matches(t, '{pattern}')),
    {kind}_p AS (SELECT doc_id, unnest(m) AS match, unnest(range(1, len(m) + 1)) AS i, gap, list_transform(m, lambda x: length(x)) AS own FROM {kind}_m),
    {kind}_s AS (SELECT doc_id, match, CAST(list_sum(gap[1:i]) + coalesce(list_sum(own[1:i - 1]), 0) AS BIGINT) AS a FROM {kind}_p),
    {kind} AS (SELECT doc_id, {rank} AS rank, '{kind}' AS kind, a, a + length(match) AS b, match FROM {kind}_s WHERE {test})"""


# The patterns of the secret scan for RE2, which has no look-around: whole runs are taken and tested.
_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_SECRETS = ", ".join((
    "texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)",
    _matches("assign", 1, _ASSIGN, f"length(regexp_extract(match, '{_ASSIGN}', 2)) >= 8"),
    _matches("access", 2, "AKIA[A-Z0-9]+", "length(match) >= 16"),
    _matches("hex", 3, "[0-9a-f]+", "length(match) >= 32"),
    _matches("entropy_hex", 4, "[0-9A-Za-z]+", "length(match) >= 24 AND regexp_matches(match, '^[0-9a-fA-F]+$') AND regexp_matches(match, '[0-9]') AND regexp_matches(match, '[a-fA-F]')"),
    _matches("entropy_base64", 5, "[A-Za-z0-9+/_=-]+", "length(match) >= 24 AND regexp_matches(match, '[0-9]') AND regexp_matches(match, '[A-Z]') AND regexp_matches(match, '[a-z]')"),
    _matches("entropy_base36", 6, "[0-9A-Za-z]+", "length(match) >= 24 AND regexp_matches(match, '[0-9]') AND (regexp_matches(match, '^[0-9a-z]*[g-z][0-9a-z]*$') OR regexp_matches(match, '^[0-9A-Z]*[G-Z][0-9A-Z]*$'))"),
))
# What the scan allows, in the words of its documentation: UUIDs, alphabets in order, the example key of a cloud's manual.
_SECRETS += ", " + ", ".join((
    _matches("uuid", 0, "[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", "true"),
    _matches("alphabet", 0, "(?:[+/_-]|0123456789|" + "|".join("".join(map(chr, range(a, a + 26))) for a in (65, 97)) + ")+", "true"),
    _matches("manual", 0, "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", "true"),
))


_LICENSE_GRAM = " || ' ' || ".join(f"translate(w[i{d}], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')" for d in ("", " + 1"))
_LICENSE_VALUES = ", ".join("({}, '{}', '{}')".format(k, name, body.replace("'", "''")) for k, (name, body) in enumerate(TEMPLATES))


def _units() -> str:
    """Sentences of the substring dedup, and its runs."""
    return rf"""
    w0 AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, string_split_regex(t, '[^\x20\x09-\x0D]+') AS g FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
    w1 AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i, unnest(g[:len(w)]) AS gap, unnest(list_transform(range(1, len(w) + 1), lambda j: contains(g[j + 1], chr(10)))) AS line, len(w) AS n FROM w0 WHERE len(w) > 0),
    w2 AS (SELECT *, regexp_matches(word, '[.!?;:,؟،؛۔։。、！，：；？．…।॥።፣]$') OR line OR i = n AS closes, md5(translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))[:8] AS low,
           octet_length(encode(gap)) AS gb, octet_length(encode(word)) AS wb FROM w1),
    w3 AS (SELECT *, i > 4 AND NOT max(closes) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)
           AND low = min(low) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS inner_end, sum(gb + wb) OVER (PARTITION BY doc_id ORDER BY i) AS ends FROM w2),
    w4 AS (SELECT *, coalesce(sum(CAST(closes OR inner_end AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM w3),
    units AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY min(i)) - 1 AS u, min(i) AS first, max(i) AS last, min(ends - wb) AS a, max(ends) AS b FROM w4 GROUP BY doc_id, part),
    starts AS (SELECT x.doc_id, x.u, min(y.u) AS e, x.first, min(y.last) AS last FROM units x JOIN units y ON y.doc_id = x.doc_id AND y.u >= x.u + {RUN - 1} AND y.u <= x.u + {MIN_WORDS} AND y.last - x.first + 1 >= {MIN_WORDS} GROUP BY ALL),
    low AS (SELECT doc_id, list_transform(w, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM w0),
    runs AS (SELECT s.doc_id, u, e, md5(array_to_string(w[first:last], ' ')) AS h FROM starts s JOIN low USING (doc_id)),
    later AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, u) AS k FROM runs) WHERE k > 1),
    gone AS (SELECT DISTINCT l.doc_id, x.u, x.a, x.b FROM later l JOIN units x ON x.doc_id = l.doc_id AND x.u BETWEEN l.u AND l.e)"""


_REACH = """
    reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
    least AS (SELECT a, least(a, min(b)) AS component FROM reach GROUP BY a)"""

ORACLES: dict[str, str] = {
    "op1_mix_sources": r"""
    WITH sized AS (
        SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
               CAST('0x' || substr(md5('1:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS place FROM documents),
    sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
    weighed AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM sums),
    ranked AS (SELECT *, cap / weight AS ratio, sum(source_size) OVER () AS words FROM weighed),
    levels AS (
        SELECT *, (words - coalesce(sum(cap) OVER (ORDER BY ratio RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP), 0))
               / sum(weight) OVER (ORDER BY ratio RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM ranked),
    final AS (SELECT arg_min(level, ratio) AS level FROM levels WHERE ratio > level),
    targets AS (
        SELECT r.source, r.source_size, CASE WHEN f.level IS NULL OR r.cap <= r.weight * f.level THEN CAST(r.cap AS DOUBLE) ELSE r.weight * f.level END AS target
        FROM ranked r, final f),
    plans AS (
        SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target / source_size) AS BIGINT) END AS whole,
               CAST(round(target - (CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size) END) * source_size) AS BIGINT) AS extra FROM targets),
    placed AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY place RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
               sum(size) OVER (PARTITION BY source, place) AS own FROM sized)
    SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
           CAST(size * whole + CASE WHEN upto <= extra THEN size WHEN upto - own < extra THEN size * (extra - upto + own) // own ELSE 0 END AS BIGINT) AS taken
    FROM placed JOIN plans ON placed.source IS NOT DISTINCT FROM plans.source""",
    "op2_embedding_dedup": f"""
    WITH RECURSIVE usable AS (
        SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
          AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM usable x JOIN usable y ON x.label = y.label AND x.vec_id <> y.vec_id
        WHERE list_cosine_similarity(x.v, y.v) >= 0.98),{_REACH}
    SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links, coalesce(component, e.vec_id) AS component_id,
           coalesce(component, e.vec_id) = e.vec_id AS kept
    FROM embeddings e LEFT JOIN least ON a = e.vec_id""",
    "op3_secret_scan": rf"""
    WITH {_SECRETS},
    base AS (SELECT * FROM assign UNION ALL SELECT * FROM access UNION ALL SELECT * FROM hex),
    candidates AS (SELECT * FROM entropy_hex UNION ALL SELECT * FROM entropy_base64 UNION ALL SELECT * FROM entropy_base36),
    allowed AS (SELECT doc_id, a, b FROM uuid UNION ALL SELECT doc_id, a, b FROM alphabet WHERE b - a >= 24 UNION ALL SELECT doc_id, a, b FROM manual),
    all_windows AS (SELECT *, unnest(range(0, length(match) - 23)) AS i FROM candidates),
    windows AS (SELECT * FROM all_windows w WHERE NOT EXISTS (SELECT 1 FROM allowed x WHERE x.doc_id = w.doc_id AND x.a <= w.a + w.i AND w.a + w.i + 24 <= x.b)),
    hot AS (SELECT doc_id, rank, kind, a + min(i) AS a, a + max(i) + 24 AS b FROM windows
        WHERE list_aggregate(string_split(substr(match, CAST(i AS BIGINT) + 1, 24), ''), 'entropy') >= CASE kind WHEN 'entropy_hex' THEN 3.0 WHEN 'entropy_base36' THEN 3.5 ELSE 4.1 END - 1e-9 GROUP BY doc_id, rank, kind, windows.a, match),
    more AS (SELECT * FROM hot h WHERE NOT EXISTS (SELECT 1 FROM base x WHERE x.doc_id = h.doc_id AND x.a <= h.a AND h.b <= x.b)),
    listed AS (SELECT doc_id, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank) AS s, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex FROM base GROUP BY 1),
    whole AS (SELECT doc_id, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank) AS s FROM (SELECT doc_id, rank, kind, a, b FROM base UNION ALL SELECT doc_id, rank, kind, a, b FROM more) GROUP BY 1)
    SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(listed.s, '')) AS base_sha256, coalesce(whole.s, '') AS spans
    FROM documents d LEFT JOIN listed USING (doc_id) LEFT JOIN whole USING (doc_id)""",
    "op4_license_scan": rf"""
    WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    tokens AS (SELECT doc_id, regexp_extract_all(t, '[0-9A-Za-z\x{{80}}-\x{{10FFFF}}]+') AS w, string_split_regex(t, '[0-9A-Za-z\x{{80}}-\x{{10FFFF}}]+') AS g FROM texts),
    pairs AS (SELECT doc_id, i, {_LICENSE_GRAM} AS gram, regexp_matches(g[i + 1], '\n|[.!?][\x01-\x20]') AS sentence_end, contains(g[i + 1], chr(10) || chr(10)) AS paragraph_end
        FROM (SELECT doc_id, w, g, unnest(range(1, len(w))) AS i FROM tokens)),
    cut AS (SELECT *, sum(CAST(sentence_end AS INT)) OVER o AS s, sum(CAST(paragraph_end AS INT)) OVER o AS p FROM pairs WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
    segments AS (SELECT DISTINCT doc_id, 1 AS level, s AS seg, gram FROM cut WHERE NOT sentence_end UNION ALL SELECT DISTINCT doc_id, 2, p, gram FROM cut WHERE NOT paragraph_end UNION ALL SELECT DISTINCT doc_id, 3, 0, gram FROM cut),
    sizes AS (SELECT doc_id, level, seg, count(*) AS n FROM segments GROUP BY ALL),
    templates AS (SELECT * FROM (VALUES {_LICENSE_VALUES}) v(k, license, body)),
    template_grams AS (SELECT DISTINCT k, license, gram FROM (SELECT k, license, unnest(list_transform(range(1, len(w)), lambda i: {_LICENSE_GRAM})) AS gram FROM (SELECT k, license, regexp_extract_all(body, '[0-9A-Za-z]+') AS w FROM templates))),
    template_sizes AS (SELECT k, license, count(*) AS n FROM template_grams GROUP BY ALL),
    shared AS (SELECT s.doc_id, s.level, s.seg, g.k, count(*) AS c FROM segments s JOIN template_grams g USING (gram) GROUP BY ALL),
    scored AS (SELECT h.doc_id, h.level, h.seg, h.k, t.license, 2 * c / (z.n + t.n) AS dice FROM shared h JOIN sizes z USING (doc_id, level, seg) JOIN template_sizes t USING (k)),
    best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, level, seg ORDER BY dice DESC, k) AS place FROM scored WHERE dice >= {DICE})
    SELECT doc_id, license, max(dice) AS dice FROM best WHERE place = 1 GROUP BY 1, 2""",
    "op5_minhash_dedup": f"""
    WITH RECURSIVE {_shingled("documents", "doc_id")},
    shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM documents_set x JOIN documents_set y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
    links AS (
        SELECT a, b FROM shared JOIN documents_n x ON x.doc_id = a JOIN documents_n y ON y.doc_id = b
        WHERE 100 * c >= 85 * (x.n + y.n - c)),{_REACH}
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component, d.doc_id) AS component_id, coalesce(component, d.doc_id) = d.doc_id AS kept
    FROM documents d LEFT JOIN documents_n n ON n.doc_id = d.doc_id LEFT JOIN least ON a = d.doc_id""",
    "op8_substring_dedup": f"""
    WITH {_units()},
    marked AS (SELECT x.*, g.u IS NOT NULL AS cut, lead(x.a) OVER (PARTITION BY x.doc_id ORDER BY x.u) AS next_a FROM units x LEFT JOIN gone g USING (doc_id, u)),
    grouped AS (SELECT *, u - row_number() OVER (PARTITION BY doc_id, cut ORDER BY u) AS island FROM marked),
    ranges AS (SELECT doc_id, min(a) AS a, max(b) AS b, arg_max(coalesce(next_a, -1), u) AS upto FROM grouped WHERE cut GROUP BY doc_id, island),
    cuts AS (SELECT doc_id, list(CAST(a AS BIGINT) ORDER BY a) AS starts, list(CAST(upto AS BIGINT) ORDER BY a) AS stops, string_agg(CAST(a AS BIGINT) || ':' || CAST(b AS BIGINT), ',' ORDER BY a) AS removed FROM ranges GROUP BY 1),
    n AS (SELECT doc_id, count(*) AS n_sentences, count(*) FILTER (cut) AS n_removed FROM marked GROUP BY 1),
    bytes AS (SELECT doc_id, hex(encode(text)) AS x FROM documents),
    kept AS (SELECT doc_id, list_reduce(list_prepend('', list_transform(range(0, len(starts) + 1), lambda j: CASE WHEN j > 0 AND stops[j] = -1 THEN '' ELSE
        substr(x, CASE WHEN j = 0 THEN 1 ELSE 2 * stops[j] + 1 END, CASE WHEN j = len(starts) THEN length(x) ELSE 2 * (starts[j + 1] - CASE WHEN j = 0 THEN 0 ELSE stops[j] END) END) END)), lambda p, q: p || q) AS x FROM cuts JOIN bytes USING (doc_id))
    SELECT d.doc_id, CAST(coalesce(n_sentences, 0) AS INTEGER) AS n_sentences, CAST(coalesce(n_removed, 0) AS INTEGER) AS n_removed, coalesce(removed, '') AS removed, sha256(coalesce(decode(unhex(kept.x)), d.text)) AS kept_sha256
    FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN cuts USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op9_warc": """
    WITH rows AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages),
    named AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY html) END AS first FROM rows)
    SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest,
           CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
    FROM named""",
    "op10_decontaminate": f"""
    WITH {_shingled("documents", "doc_id")}, {_shingled("benchmark", "item_id")},
    shared AS (SELECT doc_id, item_id, count(*) AS shared FROM documents_set d JOIN benchmark_set b ON d.s = b.s GROUP BY 1, 2)
    SELECT doc_id, item_id, shared, n AS item_shingles, shared / n AS containment
    FROM shared JOIN benchmark_n USING (item_id) WHERE 100 * shared >= 80 * n""",
}
