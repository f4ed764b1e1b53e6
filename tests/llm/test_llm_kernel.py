from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldspar.llm import kernel

LOWER = {i: i + 32 for i in range(65, 91)}
TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAbB éЖ\n\t.😀", max_size=40)), max_size=8)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


@settings(max_examples=60, deadline=None)
@given(TEXTS, st.sampled_from([3, 17, 1 << 20]))
def test_words_and_shingles(texts, piece):
    old, kernel.PIECE_BYTES = kernel.PIECE_BYTES, piece
    try:
        column = pa.array(texts, pa.string())
        hashes, counts = kernel.words(column)
        own = [words(t) for t in texts]
        assert counts.tolist() == [len(w) for w in own]
        flat = [w for ws in own for w in ws]
        assert len(set(zip(flat, hashes.tolist(), strict=True))) == len(set(flat)) == len(set(hashes.tolist()))
        sets = [len({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))}) if w else 0 for w in own]
        assert [len(s) for s in kernel.distinct_shingles(column)] == sets
    finally:
        kernel.PIECE_BYTES = old


def test_places_and_slices():
    column = pa.array(["  Ab c", None, "d\n\ne"])
    hashes, counts, first, last = kernel.words(column, places=True)
    assert counts.tolist() == [2, 0, 2] and first.tolist() == [2, 5, 6, 9] and last.tolist() == [4, 6, 7, 10]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(["x" * n for n in (1, 2, 50, 3, 4)])], names=["i", "t"])
    parts = [b.column(0).to_pylist() for b in kernel.small([batch], 1, 10)]
    assert parts == [[0, 1], [2], [3, 4]]


def test_sliced_arrays():
    column = pa.array(["a b", "c d e", "f"])
    assert np.array_equal(kernel.words(column.slice(1))[0], kernel.words(pa.array(["c d e", "f"]))[0])


@pytest.mark.parametrize("n", [1, 4, 5, 6])
def test_short_rows(n):
    text = " ".join("abcdefgh"[:n])
    assert [len(s) for s in kernel.distinct_shingles(pa.array([text]))] == [max(n - 4, 1)]
