"""The thin queries against DuckDB, and the pipeline's stages."""

from __future__ import annotations

import os
import re

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fieldspar.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    cell = lambda x: "NULL" if x is None or x is pd.NA or x != x else f"{float(x):.9g}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    return sorted(tuple(cell(x.item() if hasattr(x, "item") else x) for x in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, SF)
    assert df.columns
    if name not in queries.ORACLES:
        assert df.count() > 0
        return
    con = duckdb.connect()
    for table in os.listdir(SF):
        con.execute(f"CREATE VIEW {table.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{table}')")
    assert rows(df.toPandas()) == rows(con.execute(queries.ORACLES[name]).df())


def test_pipeline(spark):
    secret = "token = abcdefgh12345678"
    start = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    clean = " ".join(f"clean{i}" for i in range(60))
    extra = [(90001, clean), (90002, clean + " more"), (90003, f"{' '.join(f'q{i}' for i in range(80))} {bench} end"), (90004, f"{' '.join(f'z{i}' for i in range(50))} {secret}"), (90005, None)]
    more = spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in extra], start.schema)
    docs = start.union(more)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "minhash", "decontamination", "secrets", "mixing"]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        seen[name] = {r.doc_id: r for r in docs.collect()}
        if name != "mixing":
            assert docs.columns == start.columns
    assert {i for i, _ in extra} <= set(seen["toxicity"])
    assert 90001 in seen["minhash"] and 90002 not in seen["minhash"]
    assert 90003 in seen["minhash"] and 90003 not in seen["decontamination"] and {90001, 90004, 90005} <= set(seen["decontamination"])
    masked = seen["secrets"][90004]
    assert secret not in masked.text and "[secret]" in masked.text and masked.n_chars == len(masked.text)
    assert seen["secrets"][90001].text == clean
    total = sum(r.size for r in seen["mixing"].values())
    assert total and all(0 < r.taken <= 3 * r.size for r in seen["mixing"].values())
    taken = docs.groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("g")).collect()
    assert all(abs(r.t - r.g) <= 2 for r in taken)


def test_guard():
    import __spark_entry__

    assert set(queries.QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())
    for n in range(1, 11):
        assert len([q for q in queries.QUERIES if re.match(rf"op{n}_", q)]) == 1
