"""Match job: golden cases, completeness, validation, parameters, ties, reuse, brute force."""

import pytest
from pyspark.sql import functions as F

import pyref
from onoma.operators.candidates import candidate_ids, gram_index
from onoma.operators.ranking import flat_payloads, payloads
from onoma.operators.scoring import score_pairs
from onoma.operators.standardize import standardize
from onoma.plans.match import MatchConfig, match, match_distinct, prepare_names, prepare_requests
from onoma.sources.tables import segment_names, segment_requests

SF = "/root/testdata/sf0.001"


def _req(spark, rows, schema="request_id long, name string"):
    return spark.createDataFrame(rows, schema)


def _hits(res):
    out = {}
    for r in res.hits.orderBy("request_id", "rank").collect():
        out.setdefault(r.request_id, []).append((r.id, r.similarity))
    return out


def test_golden_match(spark, names_df):
    reqs = _req(spark, [(1, "Juan Pérez"), (2, "ana gz muniz"), (3, "an"), (4, "xyzxyz")])
    res = match(names_df, reqs)
    hits = _hits(res)
    assert hits[1] == [(4, 100.0), (3, 90.93), (8, 82.5)]
    assert hits[2] == [(1, 76.92), (2, 76.92)]
    assert hits[3] == [(5, 100.0)]
    assert 4 not in hits
    summ = {r.request_id: r for r in res.summary.collect()}
    assert (summ[1].candidate_count, summ[1].fallback) == (3, False)
    assert (summ[4].candidate_count, summ[4].fallback) == (8, True)
    assert summ[2].tie_groups == 1 and summ[2].by_id == 1


def test_cap_keeps_lowest_ids(spark, names_df):
    reqs = _req(spark, [(1, "juan perez", 0.0)], "request_id long, name string, threshold double")
    res = match(names_df, reqs, MatchConfig(max_candidates=2))
    assert _hits(res)[1] == [(4, 100.0), (3, 90.93)]
    assert res.summary.collect()[0].candidate_count == 2


def test_empty_query_falls_back(spark, names_df):
    reqs = _req(spark, [(1, "", 0.0)], "request_id long, name string, threshold double")
    hits = _hits(match(names_df, reqs))[1]
    assert hits[0] == (7, 35.0)
    assert [h[0] for h in hits[1:]] == [1, 2, 3, 4, 5, 6, 8]


def test_explain_and_limit_columns(spark, names_df):
    reqs = _req(
        spark,
        [(1, "juan perez", 0.0, 2, 0.5, True), (2, "juan perez", 0.0, 1, 0.65, False)],
        "request_id long, name string, threshold double, limit int, w_token double, explain boolean",
    )
    rows = match(names_df, reqs).hits.orderBy("request_id", "rank").collect()
    assert [(r.request_id, r.rank) for r in rows] == [(1, 1), (1, 2), (2, 1)]
    assert rows[0].w_token == 0.5 and rows[0].token_score == 100.0
    assert rows[2].token_score is None and rows[2].w_token is None


def test_payload_lists_and_maps(spark, names_df):
    reqs = prepare_requests(_req(spark, [(1, "juan perez"), (2, "qqqqqq")]))
    res = match(names_df, reqs)
    got = {r.request_id: r for r in payloads(res.hits, reqs).collect()}
    assert [h.id for h in got[1].results] == [4, 3, 8]
    assert set(got[1].results_by_id) == {3, 4, 8}
    assert got[2].results == []


def test_distinct_requests_equal_direct(spark, names_df):
    reqs = _req(spark, [(1, "Juan Perez"), (2, "juan  perez!"), (3, "ana gz muniz"), (4, "JUAN PEREZ")])
    direct = {(r.request_id, r.rank, r.id, r.similarity) for r in match(names_df, reqs).hits.collect()}
    reused = {(r.request_id, r.rank, r.id, r.similarity) for r in match_distinct(names_df, reqs).collect()}
    assert direct == reused


def test_brute_force_small_fixture(spark):
    """Every thirtieth request of sf0.001 pair by pair, uncapped."""
    names = standardize(segment_names(spark, SF))
    reqs = segment_requests(spark, SF)
    keys = {r.id: r.normalized_name for r in names.collect()}
    raw = {r.request_id: r.name for r in reqs.collect()}
    res = match(names, reqs)
    hits = _hits(res)
    counts = {r.request_id: r.candidate_count for r in res.summary.collect()}
    distinct = {}
    for i, k in keys.items():
        distinct.setdefault(k, []).append(i)
    for rid in sorted(raw)[::30]:
        q = pyref.normalize(raw[rid])
        # scores are by key, so brute force scores a key once
        near = {k for k in distinct if pyref.share_gram(q, k)} or set(distinct)
        assert counts[rid] == sum(len(distinct[k]) for k in near), rid
        best = []
        for k in near:
            if abs(len(q) - len(k)) > 0.86 * (len(q) + len(k)):
                continue  # edit score below 14: no total of 70
            t, e = pyref.token_set_ratio(q, k), pyref.ratio(q, k)
            sim = 0.65 * t + 0.35 * e
            if sim >= 70.0:
                best += [(-sim, -t, -e, i) for i in distinct[k]]
        assert hits.get(rid, []) == [(i, round(-s, 2)) for s, _, _, i in sorted(best)[:10]], rid


def test_equal_keys_are_always_found(spark):
    names = standardize(segment_names(spark, SF))
    res = match(names, segment_requests(spark, SF))
    keys = {r.normalized_name for r in names.select("normalized_name").distinct().collect()}
    first = {r.request_id: r.similarity for r in res.hits.filter("rank = 1").collect()}
    equal = [r.request_id for r in res.requests.collect() if r.q_norm in keys and r.q_norm]
    assert len(equal) > 20
    assert all(first.get(i) == 100.0 for i in equal)


def test_invalid_requests_are_rejected(spark, names_df):
    schema = "request_id long, name string, threshold double, limit int, w_token double"
    rows = [(1, "juan perez", None, None, None), (2, "juan perez", None, 500, None), (3, "x", None, None, 7.0), (4, None, None, None, None), (5, "x", 101.0, None, None)]
    res = match(names_df, _req(spark, rows, schema))
    assert set(_hits(res)) == {1}
    assert {r.request_id for r in res.rejected.collect()} == {2, 3, 4, 5}
    assert {r.request_id for r in res.summary.collect()} == {1}


def test_duplicate_ids_fail(spark, names_df):
    with pytest.raises(ValueError, match="request ids"):
        match(names_df, _req(spark, [(1, "juan"), (1, "ana")]))
    with pytest.raises(ValueError, match="record ids"):
        match(names_df.unionByName(names_df), _req(spark, [(1, "juan")]))


def test_many_equal_records(spark):
    names = spark.createDataFrame([(i, "Ana Ruiz", "ana ruiz") for i in range(300)], "id long, full_name string, normalized_name string")
    res = match(names, _req(spark, [(1, "ana ruiz", 100)], "request_id long, name string, limit int"))
    assert [i for i, _ in _hits(res)[1]] == list(range(100))
    assert res.summary.first().candidate_count == 300


def test_probe_scores_equal_native_scores(spark):
    """The block probe and the column functions give the same numbers, long keys included."""
    names = standardize(segment_names(spark, SF))
    reqs = segment_requests(spark, SF).withColumn("threshold", F.lit(45.0)).withColumn("limit", F.lit(100))
    res = match(names, reqs)
    rows = res.display.select("request_id", "id", "token_raw", "edit_raw", "similarity_raw")
    pairs = rows.select("request_id", "id").join(prepare_names(names), "id").join(
        res.requests.select("request_id", "q_norm", "q_tokens", "q_tokens_len", "threshold", "w_token"), "request_id"
    )
    native = score_pairs(pairs).select("request_id", "id", "token_raw", "edit_raw", "similarity_raw")
    assert rows.count() > 1000
    assert rows.exceptAll(native).isEmpty() and native.exceptAll(rows).isEmpty()


def test_candidates_from_postings(spark, names_df):
    reqs = prepare_requests(_req(spark, [(1, "juan perez"), (2, "zzz")]))
    index = gram_index(names_df)
    assert {(r.request_id, r.id) for r in candidate_ids(reqs, index).collect()} == {(1, 3), (1, 4), (1, 8)}
    assert {r.id for r in candidate_ids(reqs, index, max_candidates=2).collect()} == {3, 4}


def test_match_plan_has_no_cross_join(spark, names_df):
    plan = match(names_df, _req(spark, [(1, "juan perez")])).summary._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_flat_payload(spark, names_df):
    schema = "request_id long, name string, include_by_id boolean"
    reqs = prepare_requests(_req(spark, [(1, "juan perez", True), (2, "juan perez", False)], schema))
    rows = flat_payloads(payloads(match(names_df, reqs).hits, reqs)).collect()
    assert sorted((r.request_id, r.pos, r.id, r.in_map) for r in rows) == [
        (1, 1, 4, True), (1, 2, 3, True), (1, 3, 8, True), (2, 1, 4, False), (2, 2, 3, False), (2, 3, 8, False)
    ]


def test_ranks_dense_and_bounded(spark):
    names = standardize(segment_names(spark, SF))
    reqs = segment_requests(spark, SF).withColumn("limit", F.lit(3)).withColumn("threshold", F.lit(20.0))
    rows = match(names, reqs).hits.groupBy("request_id").agg(F.max("rank").alias("m"), F.count(F.lit(1)).alias("n")).collect()
    assert rows and all(r.m == r.n <= 3 for r in rows)
