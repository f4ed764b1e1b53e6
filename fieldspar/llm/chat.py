"""Chat formatting in budgeted windows.

A conversation is cut into windows of whole turns: each takes as many further turns as fit the
token budget beside the system turn and a limited number of turns of history, by the prefix sums of
the turns' tokens.  The system turn and the history stand in every window but are targets in none
but their first; the loss mask covers each assistant text exactly once.  A turn that is longer than
the budget is a window of its own; nothing is cut or dropped.

Turns are written as ``<|im_start|>role``, newline, text, ``<|im_end|>``, newline.  Inside roles and
texts ``\\`` becomes ``\\\\`` and ``<|`` becomes ``<\\|``, which can be undone and leaves no control
string; a newline in a role becomes ``\\n``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspar.llm.storage import small_batches

# The marks of the template.
START, END = "<|im_start|>", "<|im_end|>"

BUDGET, HISTORY_TURNS, HISTORY_TOKENS = 1024, 2, 256
_TURN = re.compile(re.escape(START) + r"(.*?)\n(.*?)" + re.escape(END) + r"\n", re.DOTALL)

WINDOWS = "conv_id long, window long, repeated int, formatted string, loss array<struct<start:int,end:int>>"

Turn = tuple[str, str]


def escape(text: str) -> str:
    """A text without control strings."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    """The text that ``escape`` was given."""
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL) if "\\" in text else text


def _role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def _unrole(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role, flags=re.DOTALL)


def count_words(text: str) -> int:
    """Tokens of a text, by default its words."""
    return len(text.split())


def windows(turns: Iterator[Turn], budget: int, history_turns: int, history_tokens: int, tokens: Callable[[str], int]) -> Iterator[tuple[list[Turn], list[Turn]]]:
    """(repeated, fresh) turns of each window; the memory is that of a window."""
    system: Turn | None = None
    system_cost = 0
    past: list[tuple[Turn, int]] = []
    repeated: list[Turn] = []
    fresh: list[tuple[Turn, int]] = []
    used, first = 0, True
    for turn in turns:
        cost = tokens(turn[1]) + 4  # the role and the marks
        if fresh and used + cost > budget:
            yield repeated, [t for t, _ in fresh]
            past = (past + fresh)[-history_turns:] if history_turns else []
            own = past[1:] if system and past and past[0][0] is system else past
            repeated, fresh = ([system] if system else []), []
            room = min(history_tokens, budget - system_cost - cost)
            kept: list[Turn] = []
            for t, c in reversed(own):
                room -= c
                if room < 0:
                    break
                kept.insert(0, t)
            repeated = repeated + kept
            used = system_cost + sum(c for t, c in own[len(own) - len(kept) :])
        if first and turn[0] == "system":
            system, system_cost = turn, cost
        first = False
        fresh.append((turn, cost))
        used += cost
    if fresh:
        yield repeated, [t for t, _ in fresh]


def render(repeated: list[Turn], fresh: list[Turn]) -> tuple[str, list[tuple[int, int]]]:
    """A window's text and the ranges of it that count as loss."""
    parts, loss, at = [], [], 0
    for i, (role, text) in enumerate([*repeated, *fresh]):
        head, body = f"{START}{_role(role)}\n", escape(text)
        if i >= len(repeated) and role == "assistant":
            loss.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), loss


def parse(formatted: str) -> list[Turn]:
    """The turns of a window, unescaped."""
    return [(_unrole(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[tuple]]]:
    """Consecutive rows of one key, streamed."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    head = next(rows, None)
    while head is not None:
        key, ended = head[0], []

        def own(first: tuple = head, key: int | None = key, ended: list = ended) -> Iterator[tuple]:
            yield first
            for row in rows:
                if row[0] != key:
                    ended.append(row)
                    return
                yield row

        group = own()
        yield key, group
        for _ in group:  # what the caller left
            pass
        head = ended[0] if ended else None


def _format(budget: int, history_turns: int, history_tokens: int, tokens: Callable[[str], int]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            types = (pa.int64(), pa.int64(), pa.int32(), pa.string(), kind)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["conv_id", "window", "repeated", "formatted", "loss"])

        for key, rows in _grouped(batches):
            turns = ((role or "", text or "") for _, role, text in rows)
            for i, (repeated, fresh) in enumerate(windows(turns, budget, history_turns, history_tokens, tokens)):
                text, loss = render(repeated, fresh)
                out.append((key, i, len(repeated), text, [{"start": a, "end": b} for a, b in loss]))
                size += len(text)
                if size > 4 << 20:
                    yield batch()
                    out, size = [], 0
        if out:
            yield batch()

    return run


def format_chats(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    *, budget: int = BUDGET, history_turns: int = HISTORY_TURNS, history_tokens: int = HISTORY_TOKENS, tokens: Callable[[str], int] = count_words,
) -> DataFrame:
    """(conv_id, window, repeated, formatted, loss) for each window, in order within a partition.

    ``repeated`` is the number of turns at the window's start that an earlier window had; ``loss``
    has the code-point ranges of the assistant texts to learn.  Turns are streamed in order, so a
    conversation of any length takes the memory of one window.

    Defined cases: null texts and roles are empty; turns are ordered by turn, then role, then text,
    null first, and repeated turns stay; a null conv_id is a conversation of its own; an empty table
    has no windows; other columns are ignored, whatever their names.
    """
    small_batches(rows.sparkSession)
    turns = rows.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    turns = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return turns.mapInArrow(_format(budget, history_turns, history_tokens, tokens), WINDOWS)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = []
    for key, rows in _grouped(batches):
        turns, loss, n, chars, length = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
        for _, _, repeated, formatted, ranges in rows:
            length += len(formatted)
            for role, text in parse(formatted)[repeated:]:
                n += 1
                turns.update(f"{role}\n{text}\n".encode())
            for r in ranges:
                text = unescape(formatted[r["start"] : r["end"]])
                chars += len(text)
                loss.update(text.encode())
        out.append((key, n, turns.hexdigest(), chars, loss.hexdigest(), length))
        if len(out) == 10_000:
            yield _digests(out)
            out = []
    if out:
        yield _digests(out)


def _digests(out: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, parsed back from the windows as ``format_chats`` returns them."""
    return formatted.mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
