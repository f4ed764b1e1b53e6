"""Strings and numbers of field reports as Columns."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Numbers that stand for "missing".
SENTINELS = (-999.99, -999.9)

# Words and letters of the two languages, and words that no search uses.
AZ_LETTERS = "əğıöşüç"
AZ_WORDS = (
    "əsas", "avadanlıq", "bunlardan", "fəaliyyət", "fəaliyyətlər", "göstər", "hansı", "hesabat", "hesabatlarda", "mənbə",
    "nasazlıq", "planlaşdırılan", "qazma", "quyu", "quyuları", "saxlanılıb", "son", "tamamlanan", "tarixdə", "xülasə",
)
EN_WORDS = (
    "activities", "activity", "compare", "equipment", "failure", "fluid", "plot", "problems", "report", "reports", "show",
    "summarize", "what", "which",
)
STOP_WORDS = (
    "about", "across", "and", "are", "bu", "bunlardan", "contains", "corpus", "ddr", "ddr-lərdə", "et", "for", "from",
    "haqqında", "hansı", "hesabatlarda", "ilə", "in", "mention", "mentioned", "most", "nə", "of", "olan", "olub", "qeyd",
    "report", "reported", "reports", "show", "the", "these", "what", "when", "which", "were", "with", "var", "və",
)


def collapse(text: Column) -> Column:
    """White space trimmed and collapsed to single spaces."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


@F.pandas_udf(T.StringType())
def nfkc_casefold(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """NFKC, casefold and collapse: no built-in function does the first two for all of Unicode."""
    for series in texts:
        yield series.map(lambda x: None if x is None else " ".join(unicodedata.normalize("NFKC", x).casefold().split()))


def fold(text: Column) -> Column:
    """Comparison form of a text by built-in functions; nfkc_casefold is the full one."""
    return collapse(F.lower(text))


def number(raw: Column) -> Column:
    """(raw_value, value, missing_reason) of a cell: blanks, sentinels and other text have a reason and no value.

    A comma is the decimal mark if there is no point.
    """
    text = F.trim(raw.cast("string"))
    packed = F.replace(text, F.lit(" "), F.lit(""))
    packed = F.when(F.contains(packed, F.lit(",")) & ~F.contains(packed, F.lit(".")), F.replace(packed, F.lit(","), F.lit("."))).otherwise(packed)
    value = F.when(packed.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), packed.try_cast("double"))
    blank = text.isNull() | (text == "")
    missing = value.isin(*SENTINELS)
    return F.struct(
        text.alias("raw_value"),
        F.when(~blank & ~F.coalesce(missing, F.lit(False)), value).alias("value"),
        F.when(blank, "source_blank").when(value.isNull(), "not_numeric").when(missing, "source_sentinel").alias("missing_reason"),
    )


def normalize_cells(cells: Column) -> Column:
    """Each cell of a row as a struct of number()."""
    return F.transform(cells, number)


def sentinel_cells(cells: Column) -> Column:
    """Cells of a row that hold a sentinel."""
    return F.size(F.filter(normalize_cells(cells), lambda c: c["missing_reason"] == "source_sentinel"))


def has_content(cells: Column) -> Column:
    """Whether a row has a cell that isn't blank."""
    return F.exists(cells, lambda c: c.isNotNull() & (F.trim(c) != ""))


def pad_cells(cells: Column, n: int) -> Column:
    """A row of at least n cells, null-padded."""
    return F.concat(cells, F.array_repeat(F.lit(None).cast("string"), F.greatest(F.lit(n) - F.size(cells), F.lit(0))))


def zip_cells(headers: Column, cells: Column) -> Column:
    """Map of header to cell up to the shorter list; of equal headers the last one counts."""
    n = F.least(F.size(headers), F.size(cells))
    pairs = F.arrays_zip(F.slice(headers, 1, n).alias("h"), F.slice(cells, 1, n).alias("c"))
    last = F.filter(pairs, lambda p, i: ~F.array_contains(F.slice(headers, (i + 2).cast("int"), F.greatest(n - i - 1, F.lit(0)).cast("int")), p["h"]))
    return F.map_from_entries(last)


def join_wrapped(text: Column, compact: bool) -> Column:
    """A cell's lines as one: compact without separator, else glued after a hyphen or before a short word rest."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    if compact:
        return F.array_join(lines, "")

    def glue(done: Column, line: Column) -> Column:
        broken = done.rlike("-$") | (done.rlike("[A-Za-z0-9]$") & line.rlike("^[A-Za-z]{1,3}$"))
        return F.when(done == "", line).when(broken, F.concat(done, line)).otherwise(F.concat_ws(" ", done, line))

    return F.aggregate(lines, F.lit(""), glue)


def split_pair(text: Column) -> Column:
    """The two sides of the first double hyphen."""
    parts = F.split(text, r"\s*--\s*", 2)
    return F.struct(F.get(parts, 0).alias("first"), F.get(parts, 1).alias("second"))


def failure_header(headers: Column) -> Column:
    """Whether a table's headers are those of equipment failures."""
    keys = F.transform(headers, lambda h: F.regexp_replace(F.lower(h), "[^a-z0-9]", ""))
    return F.array_contains(keys, "starttime") & F.array_contains(keys, "operationdowntimemin") & F.array_contains(keys, "remark")


def wellbore(text: Column) -> Column:
    """Canonical form of a wellbore name."""
    dashed = F.regexp_replace(collapse(F.translate(text, "–", "-")), r"\s*-\s*", "-")
    return F.upper(dashed)


def filename_identity(path: Column) -> Column:
    """(wellbore, report_date) of ``A_B_C[_more]_YYYY_MM_DD.pdf``; null if the name or the date is not valid."""
    name = F.regexp_extract(path, r"([^/\\]+)$", 1)
    form = r"(?i)^(.+)_(\d{4})_(\d{2})_(\d{2})\.pdf$"
    tokens = F.split(F.regexp_extract(name, form, 1), "_")
    n, third = F.size(tokens), F.upper(F.get(tokens, 2))
    slot = (n >= 4) & (third == "F")
    head = F.concat(F.get(tokens, 0), F.lit("/"), F.get(tokens, 1), F.lit("-"), F.when(slot, F.concat(F.lit("F-"), F.get(tokens, 3))).otherwise(F.get(tokens, 2)))
    rest = F.array_join(F.slice(tokens, F.when(slot, 5).otherwise(4), F.greatest(n, F.lit(1))), " ")
    day = F.concat_ws("-", *(F.regexp_extract(name, form, i) for i in (2, 3, 4))).try_cast("date")
    ok = name.rlike(form) & (n >= 3) & day.isNotNull()
    return F.when(ok, F.struct(wellbore(F.concat_ws(" ", head, F.nullif(rest, F.lit("")))).alias("wellbore"), day.alias("report_date")))


def meaningful(text: Column) -> Column:
    """The trimmed text, null if it says nothing."""
    return F.when(F.lower(F.trim(text)).isin("", "none", "n/a", "not available"), None).otherwise(F.trim(text))


def words(text: Column) -> Column:
    """Search words: runs of letters, digits, ``_ / . -``."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)[\w/.-]+"), F.lit(0))


#: Letters with marks, each with its plain letter: those whose decomposition is one letter and marks.
_PLAIN = {c: d[0] for c in map(chr, (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))) if (d := unicodedata.normalize("NFKD", c)) != c and len([x for x in d if not unicodedata.combining(x)]) == 1}


def strip_accents(text: Column) -> Column:
    """Latin letters without their marks, composed or not."""
    return F.regexp_replace(F.translate(text, "".join(_PLAIN), "".join(_PLAIN.values())), r"\p{Mn}+", "")


def index_words(text: Column) -> Column:
    """Words of two or more letters or digits, without case and accents, as the search index has them."""
    return F.regexp_extract_all(strip_accents(F.lower(text)), F.lit(r"(?U)\w\w+"), F.lit(0))


def search_terms(text: Column, limit: int = 20) -> Column:
    """The first distinct search words that are longer than one character and no stop word."""
    kept = F.filter(words(fold(text)), lambda w: (F.length(w) >= 2) & ~w.isin(*STOP_WORDS))
    return F.slice(F.array_distinct(kept), 1, limit)


def language(text: Column) -> Column:
    """az, en or mixed, by letters and words; en if nothing tells."""
    low = fold(text)
    tokens = F.array_distinct(F.regexp_extract_all(low, F.lit(r"(?U)[^\W\d_]+"), F.lit(0)))
    letters = F.length(low) - F.length(F.translate(low, AZ_LETTERS, ""))
    count = lambda names: F.size(F.array_intersect(tokens, F.array(*map(F.lit, names))))
    az, en = letters + 2 * count(AZ_WORDS), count(EN_WORDS)
    return F.when((az > 0) & (en > 0), "mixed").when(az > 0, "az").otherwise("en")


def dates(text: Column) -> Column:
    """Valid ISO dates of a text, in order."""
    found = F.regexp_extract_all(text, F.lit(r"\b\d{4}-\d{2}-\d{2}\b"), F.lit(0))
    return F.filter(F.transform(found, lambda d: d.try_cast("date")), lambda d: d.isNotNull())


def cited_files(text: Column) -> Column:
    """Distinct file names in a text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?iU)[\w.-]+\.(?:pdf|png|jpe?g|tiff?)"), F.lit(0)))


def numbers(text: Column) -> Column:
    """Distinct numbers in a text, without thousands commas and plus signs."""
    found = F.regexp_extract_all(text, F.lit(r"(?U)(?<![\w])[-+]?\d+(?:[.,]\d+)?"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(F.replace(x, F.lit(","), F.lit("")), r"^\++", "")))


def citation(file: Column, page: Column, section: Column) -> Column:
    """``file, page N, section`` without what is missing."""
    return F.concat_ws(", ", file, F.concat(F.lit("page "), page.cast("string")), section)


def render(*values: Column, limit: int = 6000) -> Column:
    """Values as one searchable line: white space collapsed, blanks dropped, joined with bars, cut."""
    parts = F.filter(F.array(*[collapse(v.cast("string")) for v in values]), lambda x: x.isNotNull() & (x != ""))
    return F.substring(F.array_join(parts, " | "), 1, limit)


def evidence_key(text: Column, n: int = 32) -> Column:
    """The first n letters and digits, to find a text on a page."""
    return F.substring(F.regexp_replace(F.lower(text), "[^a-z0-9]", ""), 1, n)


def safe_name(text: Column, limit: int = 120) -> Column:
    """A name that is safe for files."""
    return F.substring(F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "_"), 1, limit)


def short_sha(sha: Column) -> Column:
    """The first 12 digits of a commit's hash in lower case; unknown if it is none."""
    bare = F.trim(sha)
    return F.when(bare.rlike("^[0-9a-fA-F]{7,64}$"), F.lower(F.substring(bare, 1, 12))).otherwise("unknown")


def merged(first: Column, second: Column) -> Column:
    """A map of both maps' entries; the second one's values win. A null map is empty."""
    keep = F.map_filter(first, lambda k, _: ~F.coalesce(F.map_contains_key(second, k), F.lit(False)))
    return F.when(first.isNull(), second).when(second.isNull(), first).otherwise(F.map_concat(keep, second))
