"""Registered queries against their SQL, and the pipeline against a brute-force version."""

from __future__ import annotations

import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from onoma.llm import decontam, pii
from onoma.llm.common import prepare
from onoma.llm.oracles import ORACLES
from onoma.llm.queries import QUERIES

from test_operators import brute_groups, brute_spans

SF = "/root/testdata/sf0.001"


def values(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple("" if pd.isna(x) else str(int(x)) if isinstance(x, float) and x.is_integer() else str(x) for x in r) for r in df[cols].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "pages", "labels", "benchmark"):
        path = f"{SF}/{table}.parquet"
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    assert values(QUERIES[name](spark, SF).toPandas()) == values(con.execute(ORACLES[name]).df())


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline(spark):
    """Every stage against a brute-force version over its own input."""
    import corpus_pipeline as cp

    prepare(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs.toPandas()]
    for _, stage in cp.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, SF).toPandas())
        seen.append(docs.toPandas())
    raw, good, single, clean, private, mixed = seen
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    trusted = set(labels[labels.quality == 1].doc_id)
    assert len(trusted & set(good.doc_id)) >= 0.95 * len(trusted & set(raw.doc_id))
    groups = brute_groups(list(zip(good.doc_id, good.text)))
    assert {str(d) for d in single.doc_id} == {d for d, _, c in groups if d == c}
    items = [decontam.normal(t) for t in spark.read.parquet(f"{SF}/benchmark.parquet").toPandas().text]
    leaks = {
        d for d, t in zip(single.doc_id, single.text)
        if any(decontam.edit_search(x, decontam.normal(t), int(decontam.MAX_EDIT * len(x))) for x in items if len(x) >= decontam.MIN_CHARS)
    }
    assert set(clean.doc_id) == set(single.doc_id) - leaks
    before = dict(zip(clean.doc_id, clean.text))
    for d, t, n in zip(private.doc_id, private.text, private.n_chars):
        assert not brute_spans(t) and n == len(t)
        if not any(c.isdigit() or c == "@" for c in before[d]):
            assert t == before[d]
    assert set(private.doc_id) == set(clean.doc_id)
    for s in seen[1:5]:
        assert list(s.columns) == list(cp.COLUMNS)
    assert set(mixed.doc_id) <= set(private.doc_id) and (mixed.taken > 0).all()
    for _, g in mixed.groupby("source"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= max(0.03 * g.target.iloc[0], 64)
