"""Queries of the catalogue over whole tables and whole texts, against plain Python."""

from __future__ import annotations

import hashlib
import os
import re
import shutil
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fieldspar.plans import catalogue


def store(spark, folder, **tables):
    """A folder with tables of (rows, schema)."""
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_every_item_is_scored(spark, tmp_path):
    items = [(i, f"w{i} w{i} drill") for i in range(60)]
    docs = [(i, f"w{i} drill mud") for i in range(100)]
    folder = store(spark, tmp_path, benchmark=(items, "item_id long, text string"), documents=(docs, "doc_id long, text string"))
    got = {r.id: (r.precision, r.recall) for r in catalogue.QUERIES["token_multiset_f1"](spark, folder).collect()}
    expected = {}
    for i, t in items:
        a, b = (Counter(re.findall(r"[\w/.-]+", x.lower())) for x in (t, docs[i][1]))
        expected[i] = (pytest.approx((a & b).total() / b.total(), abs=1e-8), pytest.approx((a & b).total() / a.total(), abs=1e-8))
    assert got == expected


def test_batches_hold_whole_texts(spark, tmp_path):
    docs = [(i, "ab"[i % 2], f"  mud\n\t{'word ' * 2000}end {i // 2 % 7}  ") for i in range(26)]
    folder = store(spark, tmp_path, documents=(docs, "doc_id long, source string, text string"))
    got = {(r.source, r.batch_no): (r.n_rows, r.content_hash) for r in catalogue.QUERIES["chunk_batches"](spark, folder).collect()}
    expected = {}
    for source in "ab":
        own = [" ".join(t.split()) for _, s, t in docs if s == source]
        for n in range(0, len(own), 5):
            expected[source, n // 5] = (len(own[n : n + 5]), hashlib.sha256("\n".join(own[n : n + 5]).encode()).hexdigest())
    assert got == expected


def test_items_are_searched_by_whole_texts(spark, tmp_path):
    items = [(i, f"zz query about topic{i} here") for i in range(6)]
    docs = [(i, f"topic{i} drilling mud quellen tiedings") for i in range(12)]
    folder = store(spark, tmp_path, benchmark=(items, "item_id long, text string"), documents=(docs, "doc_id long, text string"))
    hits = catalogue.QUERIES["two_stage_search"](spark, folder).collect()
    assert {r.item_id: (r.doc_id, r.stage) for r in hits if r.item_id >= 0} == {i: (i, 1) for i, _ in items}
    assert {r.stage for r in hits if r.item_id < 0} == {2}


@pytest.mark.parametrize("files", [1, 3])
def test_events_count_once_and_stay_off_the_driver(spark, tmp_path, files):
    at = "2024-01-01 00:00:00"
    events = [(i % 40, at, "abc"[i % 40 % 3], "x" * 50) for i in range(100)] + [(None, at, "d", "x")]
    rows = spark.createDataFrame(events, "event_id long, ts string, event_type string, props string").withColumn("ts", F.col("ts").cast("timestamp"))
    path = tmp_path / "events.parquet"
    rows.repartition(files).write.parquet(str(path))
    if files == 1:  # the table is a file, else a folder
        os.rename(next(path.glob("part-*")), tmp_path / "one")
        shutil.rmtree(path)
        os.rename(tmp_path / "one", path)
    views, state = len(spark.catalog.listTables()), spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    counts = catalogue.QUERIES["stream_ext_dedupe"](spark, str(tmp_path))
    assert {r.event_type: r.n for r in counts.collect()} == {"a": 14, "b": 13, "c": 13, "d": 1}
    assert len(spark.catalog.listTables()) == views  # rows in the driver's memory would be a view
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == state
    assert counts.inputFiles() and not os.path.exists(counts.inputFiles()[0].removeprefix("file://").split("/rows/")[0] + "/checkpoint")


def test_labels_are_voted_on_by_whole_texts(spark, tmp_path):
    stem = "drilled ahead " * 500
    docs = [(i, f"{stem}{i % 3}" if i % 2 else f"  {stem.upper()}\n\t{i % 3} ") for i in range(30)]
    labels = [(i, int(i % 5 < 3), int(i % 7 == 0)) for i in range(30)]
    folder = store(spark, tmp_path, documents=(docs, "doc_id long, text string"), labels=(labels, "doc_id long, quality int, toxic int"))
    got = {r.text: (r.quality, r.toxic, r.votes, r.row_id) for r in catalogue.QUERIES["majority_label_dedupe"](spark, folder).collect()}
    expected = {}
    for k in range(3):
        own = [(q, t) for i, q, t in labels if i % 3 == k]
        (q, t), n = min(Counter(own).items(), key=lambda x: (-x[1], x[0]))
        expected[f"{stem}{k}"] = (q, t, n, min(i for i, *x in labels if i % 3 == k and x == [q, t]))
    assert got == expected
