"""Answers kept across batches."""

import tempfile

import pytest

from onoma.operators.keyindex import build_index
from onoma.plans import answers
from onoma.plans.match import match_distinct

REQ = "request_id long, name string, threshold double, limit int"


def _rows(df):
    return sorted(tuple(r) for r in df.select("request_id", *answers.HIT_COLUMNS).collect())


def test_second_batch_matches_only_new_keys(spark, names_df, monkeypatch):
    root, at = tempfile.mkdtemp(prefix="index-"), tempfile.mkdtemp(prefix="answers-")
    index = build_index(names_df, root)
    first = spark.createDataFrame([(1, "Ana Gomez", 40.0, 5), (2, "ANA gomez!", 40.0, 5), (3, "zzz", 99.0, 5), (4, None, 1.0, 1)], REQ)
    want = _rows(match_distinct(names_df, first))
    assert want and _rows(answers.match_reusing(index, first, at)) == want

    asked = []
    real = answers.match_index
    monkeypatch.setattr(answers, "match_index", lambda i, r, c: asked.append(sorted(x["name"] for x in r.collect())) or real(i, r, c))
    assert _rows(answers.match_reusing(index, first, at)) == want
    assert asked == []  # no key of the index is read, also for the request without hits
    more = spark.createDataFrame([(7, "ana gomez", 40.0, 5), (8, "juan perez", 50.0, 2), (9, "ana gomez", 40.0, 1)], REQ)
    assert _rows(answers.match_reusing(index, more, at)) == _rows(match_distinct(names_df, more))
    assert asked == [["ana gomez", "juan perez"]]

    less = names_df.filter("id <> 1")
    changed = build_index(less, root)
    assert _rows(answers.match_reusing(changed, first, at)) == _rows(match_distinct(less, first)) != want
    assert len(asked) == 2
    with pytest.raises(ValueError):
        answers.match_reusing(changed, first.union(first), at)
