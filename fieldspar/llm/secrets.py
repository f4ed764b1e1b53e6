"""Secret scans in DataFrame operations only: patterns, and sliding-window entropy.

Base spans come from three patterns.  The entropy scan adds spans in candidate strings - long runs
of one character class - whose windows of WINDOW characters reach the class's Shannon entropy.  The
counts of a window change by one character in and one out, and with them the running sum of
``c * log2(c)``, so each step of the window is one update.  Counts are packed into a few integers
and long runs are worked through in pieces, so that time is linear and memory bounded.  Windows
inside a stretch of the allow-list are no secret, nor are entropy spans inside base spans.
Positions are code points, ends exclusive.
"""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspar.llm.storage import fresh

# The patterns of the base spans and their least lengths.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 8
ACCESS = r"AKIA[A-Z0-9]+"
ACCESS_LEAST = 16
HEX = r"[0-9a-f]+"
HEX_LEAST = 32

#: Runs of at least that many characters; the same patterns, made to fail early in ordinary words.
_LONG_ACCESS = r"AKIA[A-Z0-9]{12,}+"
_LONG_HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"

WINDOW = 24
#: A run that can hold a window of any class, and so any long hex run: what most texts are without.
_RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{24}"
#: Character class: its characters, the pattern of a candidate, and the least entropy of a window in bits.
CLASSES: dict[str, tuple[str, str, float]] = {
    "entropy_hex": ("0123456789abcdefABCDEF", r"(?<![0-9A-Za-z])(?=[0-9]*[a-fA-F])(?=[a-fA-F]*[0-9])[0-9a-fA-F]{24,}+(?![0-9A-Za-z])", 3.0),
    "entropy_base64": (
        "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=",
        r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[a-z0-9+/_=-]*[A-Z])(?=[A-Z0-9+/_=-]*[a-z])[A-Za-z0-9+/_=-]{24,}+",
        4.1,
    ),
    # Letters of one case with digits, but not hex alone: base32 and base36 keys.
    "entropy_base36": (
        "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
        r"(?<![0-9A-Za-z])(?:(?=[a-z]*[0-9])(?=[0-9a-f]*[g-z])[0-9a-z]{24,}+|(?=[A-Z]*[0-9])(?=[0-9A-F]*[G-Z])[0-9A-Z]{24,}+)(?![0-9A-Za-z])",
        3.5,
    ),
}
#: Stretches that are no secret - windows inside one don't count: UUIDs, alphabets in order, documented example keys.
ALLOWED: tuple[str, ...] = (
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    r"[+/_-]*+(?:ABCDEFGHIJKLMNOPQRSTUVWXYZ|abcdefghijklmnopqrstuvwxyz|0123456789)(?:ABCDEFGHIJKLMNOPQRSTUVWXYZ|abcdefghijklmnopqrstuvwxyz|0123456789|[+/_-])*",
    r"wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY",
)
#: Fewer characters than a window hold no window.
_STRETCH = 24
#: Characters of a piece of a long run; counts of five bits, so many to an integer.
PIECE, PACKED = 4096, 12
#: Matches whose spans are made at once; adding one by one to a long array would copy it each time.
BLOCK = 256

SPAN = "struct<start:int,rank:int,kind:string,end:int>"
_NONE = f"cast(array() as array<{SPAN}>)"


def _spans(text: Column, pattern: str, kind: str, rank: int, keep: Column | None = None) -> Column:
    """All matches as spans: pieces between matches and matches, by turns, give the positions.

    ``keep`` is an array of booleans beside the matches.
    """
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    ok = keep if keep is not None else F.transform(found, lambda _: F.lit(True))
    lengths = F.arrays_zip(F.transform(pieces, F.length).alias("gap"), F.transform(found, F.length).alias("own"), ok.alias("ok"))
    empty = F.struct(F.lit(0).alias("at"), F.expr(_NONE).alias("spans"))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        end = start + F.coalesce(x["own"], F.lit(0))
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(F.coalesce(x["ok"], F.lit(False)), F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    def block(state: Column, at: Column, all_: Column) -> Column:
        start = F.struct(state["at"].alias("at"), F.expr(_NONE).alias("spans"))
        own = F.array(F.aggregate(F.slice(all_, at, F.lit(BLOCK)), start, step))
        return F.transform(own, lambda x: F.struct(x["at"].alias("at"), F.concat(state["spans"], x["spans"]).alias("spans")))[0]

    def blocks(all_: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.size(all_), F.lit(BLOCK)), empty, lambda s, at: block(s, at, all_))["spans"]

    return F.transform(F.array(lengths), blocks)[0]


def _when(test: Column, spans: Column) -> Column:
    return F.when(test, spans).otherwise(F.expr(_NONE))


def _grow(by: int) -> Column:
    """Changes of c * log2(c) as a count c of 0 to WINDOW goes up or down by one, by count."""
    value = lambda c: c * log2(c) if c > 0 else 0.0
    return F.array(*(F.lit(value(c + by) - value(c)) for c in range(WINDOW + 1)))


def _hot(piece: Column, alphabet: str, bits: float, base: Column, allowed: Column) -> Column:
    """(first, last): starts of the first and the last window of a piece with at least ``bits`` of entropy, -1 if none.

    ``base`` is where the piece starts in the text that ``allowed`` has stretches of.
    """
    least = WINDOW * (log2(WINDOW) - bits)
    zero = F.array_repeat(F.lit(0).cast("long"), len(alphabet) // PACKED + 1)
    up, down = _grow(1), _grow(-1)

    def moves(places: Column) -> Column:
        """For each character what enters and leaves the window: the integer that counts it, where in it, and one of it there.

        Place p is counted in five bits of the integer p div PACKED; -1 stands for no change.
        """
        parts = lambda p, none, n: (F.when(none, -1).otherwise(F.floor(p / PACKED).cast("int")).alias(f"slot{n}"), (p % PACKED * 5).cast("int").alias(f"shift{n}"))

        def one(enter: Column, i: Column) -> Column:
            leave = F.when(i >= WINDOW, F.get(places, i - WINDOW)).otherwise(0)
            return F.struct(*parts(enter, enter == leave, 1), *parts(leave, (leave == 0) | (enter == leave), 2))

        return F.transform(places, one)

    def step(s: Column, x: Column) -> Column:
        count = lambda n: F.call_function("shiftright", F.get(s["counts"], x[f"slot{n}"]), x[f"shift{n}"]).bitwiseAND(F.lit(31).cast("long")).cast("int")
        one = lambda n: F.call_function("shiftleft", F.lit(1).cast("long"), x[f"shift{n}"])
        change = lambda n, by: F.when(x[f"slot{n}"] < 0, 0.0).otherwise(F.get(by, count(n)))
        moved = F.transform(s["counts"], lambda c, j: F.when(j == x["slot1"], c + one(1)).when(j == x["slot2"], c - one(2)).otherwise(c))
        both = F.transform(s["counts"], lambda c, j: F.when(j == x["slot1"], c + one(1) - one(2)).otherwise(c))
        counts = F.when((x["slot1"] < 0) & (x["slot2"] < 0), s["counts"]).when(x["slot1"] == x["slot2"], both).otherwise(moved)
        return F.struct((s["i"] + 1).alias("i"), counts.alias("counts"), (s["total"] + change(1, up) + change(2, down)).alias("total"), *ends(s))

    def ends(s: Column) -> tuple[Column, Column]:
        """The first and the last window, with the one that the state is at."""
        start = s["i"] - WINDOW
        hot = (start >= 0) & (s["total"] <= least + 1e-9) & ~F.exists(allowed, lambda a: (a["start"] <= base + start) & (base + start + WINDOW <= a["end"]))
        return F.when((s["first"] < 0) & hot, start).otherwise(s["first"]).alias("first"), F.when(hot, start).otherwise(s["last"]).alias("last")

    state = F.struct(F.lit(0).alias("i"), zero.alias("counts"), F.lit(0.0).alias("total"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))
    places = F.transform(F.regexp_extract_all(piece, F.lit("."), F.lit(0)), lambda c: F.instr(F.lit(alphabet), c))
    steps = F.transform(F.array(places), moves)[0]  # the places are a lambda's variable, so they are computed once
    return F.aggregate(steps, state, step, lambda s: F.struct(*ends(s)))


def hot_range(candidate: Column, alphabet: str, bits: float, start: Column | None = None, allowed: Column | None = None) -> Column:
    """(first, last): where the first window of at least ``bits`` of entropy starts and the last one ends, -1 if none."""
    start = F.lit(0) if start is None else start
    allowed = F.expr(_NONE) if allowed is None else allowed

    def pieces(parts: Column) -> Column:
        """A piece has the windows that start in it, so it reaches into the next one."""

        def one(part: Column, k: Column) -> Column:
            whole = F.concat(part, F.coalesce(F.substring(F.get(parts, k + 1), 1, WINDOW - 1), F.lit("")))
            hot = _hot(whole, alphabet, bits, start + k * PIECE, allowed)
            return F.transform(F.array(hot), lambda h: F.struct(F.when(h["first"] >= 0, h["first"] + k * PIECE).alias("first"), F.when(h["last"] >= 0, h["last"] + k * PIECE + WINDOW).alias("last")))[0]

        return F.transform(parts, one)

    parts = F.regexp_extract_all(candidate, F.lit(f".{{1,{PIECE}}}"), F.lit(0))
    found = F.transform(F.array(parts), pieces)[0]
    least = lambda f: F.struct(F.coalesce(F.array_min(F.transform(f, lambda h: h["first"])), F.lit(-1)).alias("first"), F.coalesce(F.array_max(F.transform(f, lambda h: h["last"])), F.lit(-1)).alias("last"))
    return F.transform(F.array(found), least)[0]


def _entropy(text: Column, kind: str, rank: int, allowed: Column) -> Column:
    alphabet, pattern, bits = CLASSES[kind]

    def narrowed(span: Column, own: Column) -> Column:
        hot = hot_range(own, alphabet, bits, span["start"], allowed)
        # one evaluation of hot for each candidate
        return F.transform(F.array(hot), lambda h: F.struct((span["start"] + h["first"]).alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), F.when(h["first"] >= 0, span["start"] + h["last"]).otherwise(-1).alias("end")))

    found = F.flatten(F.zip_with(_spans(text, pattern, kind, rank), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), narrowed))
    return _when(text.rlike(pattern), F.filter(found, lambda s: s["end"] >= 0))


def find_secrets(docs: DataFrame, text_col: str = "text", *, base_col: str = "base_spans", spans_col: str = "spans", allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """All columns of ``docs``, with its base spans and all spans as arrays of (start, rank, kind, end), by start and kind.

    Defined cases: a null text is empty and has no spans; spans of different kinds may overlap;
    columns of the two names are replaced; repeated rows have equal spans; whole texts are scanned,
    however long; an empty table stays empty.
    """
    docs = docs.drop(base_col, spans_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    (run_col,) = fresh(docs, f"{base_col}_run")
    run = F.col(run_col)
    long = F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= ASSIGN_LEAST)
    base = F.concat(
        _when(text.rlike(ASSIGN), _spans(text, ASSIGN, "assign", 1, long)),
        _when(F.contains(text, F.lit("AKIA")), _spans(text, _LONG_ACCESS, "access", 2)),
        _when(run & text.rlike(_LONG_HEX), _spans(text, _LONG_HEX, "hex", 3)),
    )
    # Stretches shorter than a window can't hold one.
    rule = "|".join(f"(?:{rule})" for rule in allowed) or "(?!)"
    stretches = _when(run & text.rlike(rule), F.filter(_spans(text, rule, "allowed", 0), lambda s: s["end"] - s["start"] >= _STRETCH))
    listed = F.array(stretches)
    scan = lambda kind, rank: _when(run, F.transform(listed, lambda own: _entropy(text, kind, rank, own))[0])
    more = F.concat(*(scan(kind, 4 + i) for i, kind in enumerate(CLASSES)))
    rows = docs.withColumn(run_col, text.rlike(_RUN)).withColumns({base_col: F.array_sort(base), spans_col: more}).drop(run_col)
    new = F.filter(F.col(spans_col), lambda s: ~F.exists(F.col(base_col), lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"])))
    return rows.withColumn(spans_col, F.array_sort(F.concat(F.col(base_col), new)))


def span_list(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def mask_secrets(docs: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with the union of all spans of each text replaced by ``mark``; texts without spans are unchanged."""
    names = docs.columns
    base_col, spans_col = fresh(docs, "base", "spans")
    rows = find_secrets(docs, text_col, base_col=base_col, spans_col=spans_col)
    text, spans = F.col(text_col), F.col(spans_col)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s: Column, x: Column) -> Column:
        fresh = F.concat(s["out"], F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.lit(mark))
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.when(x["start"] >= s["at"], fresh).otherwise(s["out"]).alias("out"))

    masked = F.aggregate(spans, start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    return rows.withColumn(text_col, F.when(F.size(spans) > 0, masked).otherwise(text)).select(*names)
