"""Candidate pairs are bounded by task and not shuffled."""

import re

import pyref
import pytest
from onoma.operators import candidates as C
from onoma.plans.match import prepare_requests


@pytest.mark.parametrize("held", [0, 1_000_000])
def test_pairs_meet_in_the_task_of_their_id(spark, monkeypatch, held):
    monkeypatch.setattr(C, "TASK_PAIRS", 50)
    monkeypatch.setattr(C, "HELD_GRAMS", held)
    keys = ["ana ruiz", "ruiz ana ana", "juan perez", "an", "", "perez", "ana ruiz"] * 20
    names = spark.createDataFrame([(i, k, k) for i, k in enumerate(keys)], "id long, full_name string, normalized_name string")
    asked = ["ana ruiz", "perez juan", "an", "xyz"]
    reqs = prepare_requests(spark.createDataFrame(list(enumerate(asked)), "request_id long, name string"))
    got = C.candidate_ids(reqs, C.gram_index(names))
    assert sorted(tuple(r) for r in got.collect()) == [(i, j) for i, q in enumerate(asked) for j, k in enumerate(keys) if pyref.share_gram(q, k)]
    if held:
        shuffled = re.findall(r"hashpartitioning\(([^)]*)\)", got._jdf.queryExecution().executedPlan().toString())
        assert not [s for s in shuffled if "request_id" in s]
        tasks = [n for s in shuffled if re.match(r"id#", s) for n in re.findall(r", (\d+)$", s)]
        assert tasks and int(tasks[0]) >= 10


def test_nothing_asked_nothing_found(spark):
    names = spark.createDataFrame([(1, "x", "ana")], "id long, full_name string, normalized_name string")
    reqs = prepare_requests(spark.createDataFrame([(1, "zzzz")], "request_id long, name string"))
    assert C.candidate_ids(reqs, C.gram_index(names)).count() == 0
