"""Passages without marks, wherever they stand."""

from __future__ import annotations

import random

import pytest

from fieldspar.llm import substrings

RNG = random.Random(8)


def some(n: int, mark: str = "") -> str:
    return " ".join("".join(RNG.choices("abcdefghijklmnop", k=7)) + mark for _ in range(n))


def covered(spark, rows: list[tuple[int, str]], passage: str) -> list[float]:
    """Share of the passage that is cut from each row but the first."""
    got = substrings.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    assert len(set(passage.split())) == 1 or got[0].n_removed == 0  # one word repeats itself in the first row, too
    shares = []
    for (_, text), r in zip(rows[1:], got[1:], strict=True):
        a = len(text[: text.index(passage)].encode())
        b = a + len(passage.encode())
        shares.append(sum(max(0, min(s.end, b) - max(s.start, a)) for s in r.removed) / (b - a))
    return shares


@pytest.mark.parametrize("n", [51, 80])
def test_every_offset(spark, n):
    passage = some(n)
    rows = [(0, f"{some(30)} {passage} {some(30)}"), *((i, f"{some(i)} {passage} {some(20)}") for i in range(1, 30))]
    assert min(covered(spark, rows, passage)) >= 0.6


def test_late_mark_and_one_word(spark):
    late = f"{some(45)}. {some(15)}"
    rows = [(0, f"{some(20)} {late} {some(9)}"), *((i, f"{some(i)} {late} {some(9)}") for i in range(1, 14))]
    assert min(covered(spark, rows, late)) >= 0.5
    same = " ".join(["mud"] * 60)
    assert min(covered(spark, [(0, f"{some(20)} {same}"), *((i, f"{some(i)} {same} {some(9)}") for i in range(1, 14))], same)) >= 0.6


def test_marks_of_other_scripts(spark):
    texts = [f"{some(5)}{m} {some(4)}" for m in "؟،؛۔։。、！，：；？…।॥።"]
    got = substrings.substring_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.n_sentences for r in got} == {2}
