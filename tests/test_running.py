"""Running windows and exact percentiles of a query log."""

import random

import pytest
from pyspark.sql import functions as F

from onoma.operators import running
from onoma.operators.querylog import TIE_COLUMNS


def log(spark, rows):
    df = spark.createDataFrame(rows, "seq long, is_repeat boolean, latency_ms double, candidate_count long")
    return df.withColumns({c: F.lit(0).cast("long") for c in TIE_COLUMNS})


def sample(n, seed=1):
    rng = random.Random(seed)
    seqs = rng.sample(range(10 * n), n)
    return [(s, rng.random() < 0.2, rng.choice([None, round(rng.random() * 100, 2), 7.0]), rng.randrange(5)) for s in seqs]


@pytest.mark.parametrize("last_n, block", [(1, 10), (7, 10), (25, 10), (1000, 64)])
def test_running_figures_match_each_window(spark, monkeypatch, last_n, block):
    monkeypatch.setattr(running, "BLOCK_ROWS", block)
    rows = sample(200)
    got = {r["seq"]: tuple(r)[1:] for r in running.running_stats(log(spark, rows), last_n).collect()}
    searches = sorted(r for r in rows if not r[1])
    assert set(got) == {r[0] for r in searches}
    for i, r in enumerate(searches):
        window = searches[max(0, i + 1 - last_n) : i + 1]
        want = [len(window)]
        for at in (2, 3):
            known = [w[at] for w in window if w[at] is not None]
            held = sorted(window, key=lambda w: (w[at] is not None, w[at]))
            want += [sum(known) / len(known) if known else 0.0, held[int(0.95 * (len(held) - 1))][at] or 0.0]
        assert got[r[0]] == pytest.approx(want, abs=0.0051)


def test_no_window_over_one_partition(spark):
    plan = running.running_stats(log(spark, sample(50)))._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Window" not in plan


def test_empty_log(spark):
    empty = log(spark, [])
    assert running.running_stats(empty).collect() == []
    assert tuple(running.whole_stats(empty).first()) == (0, 0.0, 0.0)


@pytest.mark.parametrize(
    "values",
    [[3.0], [1.0] * 50, [1.0, 2.0], list(range(1000)), [1e300, -1e300, 0.0, 5e-324, -5e-324], [0.1 + i * 1e-17 for i in range(30)]]
    + [[random.Random(s).choice([1e-9, 1.0, 1e9]) * random.Random(s + i).gauss(0, 1) for i in range(300)] for s in range(2)],
)
def test_percentile_is_the_sorted_element(spark, monkeypatch, values):
    monkeypatch.setattr(running, "BINS", 16)
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    for share in (0.0, 0.5, 0.95, 1.0):
        assert running.exact_percentile(df, "v", share) == sorted(map(float, values))[int(share * (len(values) - 1))]
