"""Room that a match takes on disk: one index at a time, packed, and no shuffle files of actions that are over."""

import os
import time
from urllib.parse import urlparse

import numpy as np
import pytest
from pyspark.sql import functions as F

from onoma.operators import keyindex
from onoma.operators.keyindex import _NAMES, Lot, build_index, key_grams, key_tokens, lot_row, packed, unpacked
from onoma.operators.standardize import standardize
from onoma.plans import match as M
from onoma.session import ensure_checkpoint_dir, shuffles_dropped
from onoma.sources.tables import segment_names, segment_requests

SF = "/root/testdata/sf0.001"
NAMES = "id long, full_name string, normalized_name string"


def hits(res):
    return sorted(tuple(r) for r in res.hits.collect())


def indexes(spark):
    return {x for x in os.listdir(urlparse(ensure_checkpoint_dir(spark)).path) if x.startswith("match-index")}


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size())}


def test_index_of_a_call_goes_with_the_call(spark, names_df, tmp_path):
    before = indexes(spark)
    reqs = spark.createDataFrame([(1, "Juan Perez"), (2, "an"), (3, "xyzxyz"), (4, None)], "request_id long, name string")
    standing = M.match_index(build_index(names_df, str(tmp_path)), reqs)
    for cfg in (M.MatchConfig(), M.MatchConfig(max_candidates=1)):
        res = M.match(names_df, reqs, cfg)
        assert indexes(spark) == before
        # all that the result has can be read without it
        got = [sorted(map(str, df.collect())) for df in (res.hits, res.display, res.summary, res.counts, res.rejected, res.work)]
        assert all(got)
        assert cfg.max_candidates or hits(res) == hits(standing)
    with pytest.raises(ValueError, match="record ids"):
        M.match(names_df.unionByName(names_df), reqs)
    assert indexes(spark) == before
    # a stored index stays
    assert hits(M.match_index(keyindex.open_index(spark, str(tmp_path)), reqs)) == hits(standing)


def test_shuffle_files_go_with_their_action(spark, names_df, tmp_path):
    before = shuffle_files(spark)
    build_index(names_df, str(tmp_path))
    for _ in range(50):  # they are removed in the background
        left = {x for x in shuffle_files(spark) - before if x.startswith("shuffle_")}
        if not left:
            break
        time.sleep(0.1)
    assert not left


def test_setting_is_put_back(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    with pytest.raises(ZeroDivisionError), shuffles_dropped(spark):
        assert spark.conf.get(key) == "true"
        1 / 0
    assert spark.conf.get(key, None) is None
    spark.conf.set(key, "false")
    with shuffles_dropped(spark):
        pass
    assert spark.conf.get(key) == "false"
    spark.conf.unset(key)


def test_postings_are_packed():
    for rows in ([], [0], [5, 9, 8191, 0, 8191, 3], [65535, 0, 65535]):
        assert unpacked(packed(np.array(rows, np.int64))).tolist() == rows
    texts = ["", "ana", "ana ana", "àna ruiz", "z" * 90 + " ana", "ruiz"]
    for n in (3, 40):  # the latter numbers no grams
        lot = Lot(dict(zip(_NAMES, lot_row(texts, [1] * len(texts), n))))
        for names, ends, rows, parts in ((lot.token_names, lot.token_ends, lot.token_rows, key_tokens), (lot.gram_names, lot.gram_ends, lot.gram_rows, lambda t: key_grams(t, n))):
            got = {x: rows[ends[i] : ends[i + 1]].tolist() for i, x in enumerate(names.to_pylist())}
            assert got == {x: [i for i, t in enumerate(texts) if x in parts(t)] for t in texts for x in parts(t)}


def test_index_of_another_layout_is_built_again(spark, names_df, tmp_path):
    from onoma.sources import versions
    from onoma.streaming.match_stream import standing_index

    first = build_index(names_df, str(tmp_path))
    assert standing_index(names_df, str(tmp_path)).path == first.path

    def older(path):
        for table in ("records", "grams", "about"):
            spark.read.parquet(f"{first.path}/{table}").write.parquet(f"{path}/{table}")
        first.lots.withColumnRenamed("gram_sizes", "gram_ends").write.parquet(f"{path}/lots")

    old = versions.publish(spark, str(tmp_path), older)
    assert keyindex.open_index(spark, str(tmp_path)) is None
    assert standing_index(names_df, str(tmp_path)).path not in (old, first.path)


def test_stored_index_takes_less_room(spark, tmp_path):
    """Against the same tables written plainly, postings as 16-bit numbers with the ends of their lists. Full lots gain more than these."""
    index = build_index(standardize(segment_names(spark, SF)), str(tmp_path / "index"))

    def plain(batches):
        import pyarrow as pa

        for b in batches:
            cols = dict(zip(b.schema.names, b.columns))
            for kind in ("token", "gram"):
                cols[f"{kind}_rows"] = pa.array([unpacked(x.as_py()).tobytes() for x in cols[f"{kind}_rows"]], pa.binary())
                cols[f"{kind}_sizes"] = pa.array([np.cumsum(x.as_py()).astype(np.int32) for x in cols[f"{kind}_sizes"]], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    lots = index.lots.drop("wave")
    lots.mapInArrow(plain, lots.schema).write.parquet(f"{tmp_path}/plain/lots")
    index.records.write.parquet(f"{tmp_path}/plain/records")

    def size(path, table):
        return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(f"{path}/{table}") for f in fs if f.endswith(".parquet"))

    assert size(index.path, "lots") < 0.8 * size(f"{tmp_path}/plain", "lots")
    assert size(index.path, "records") < 0.8 * size(f"{tmp_path}/plain", "records")


def test_passes_over_the_keys_give_the_same_hits(spark, monkeypatch, tmp_path):
    names, reqs = standardize(segment_names(spark, SF)), segment_requests(spark, SF)
    names = names.unionByName(spark.createDataFrame([(-1, "!!", ""), (-2, None, None)], NAMES))
    one = build_index(names, str(tmp_path / "one"))
    monkeypatch.setattr(keyindex, "PASS_RECORDS", 10)
    many = build_index(names, str(tmp_path / "many"))
    keys = [sorted(map(tuple, i.lots.select(F.inline(F.arrays_zip("keys", "members"))).collect())) for i in (one, many)]
    assert keys[0] == keys[1] and len(keys[0]) == len({k for k, _ in keys[0]})
    assert sorted(one.grams.collect()) == sorted(many.grams.collect())
    assert hits(M.match_index(one, reqs)) == hits(M.match_index(many, reqs))


def test_records_are_not_shuffled_for_few_keys(spark, names_df, monkeypatch):
    reqs = spark.createDataFrame([(1, "Juan Perez"), (2, "an"), (3, "xyzxyz")], "request_id long, name string")
    pairs = spark.createDataFrame([("juan perez",), ("an",), ("an",)], "key string")
    none = pairs.filter("key IS NULL")
    held = "spark.sql.autoBroadcastJoinThreshold"
    threshold = spark.conf.get(held)
    spark.conf.set(held, "-1")
    try:
        plans = [names_df.join(M._held_keys(p), "normalized_name", "left_semi")._jdf.queryExecution().executedPlan().toString() for p in (pairs, none)]
        assert all("BroadcastHashJoin" in p and "hashpartitioning" not in p for p in plans)
        few = hits(M.match(names_df, reqs))
        monkeypatch.setattr(M, "HELD_KEYS", 0)
        assert hits(M.match(names_df, reqs)) == few
    finally:
        spark.conf.set(held, threshold)
