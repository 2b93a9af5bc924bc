"""Dedupe of arriving names against dedupe of all of them at once."""

import random
import tempfile

import pytest

from onoma.operators.arriving import ROWS, add_names, batch_changes, compact, stored_groups, stored_members
from onoma.operators.dedupe import dedupe, dedupe_members


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def _table(spark, rows):
    return spark.createDataFrame(rows, ROWS)


def test_batches_equal_the_whole(spark):
    """Random keys, a third of all rows under one key, in batches of any order."""
    rng = random.Random(4)
    rows = [(i, f"N{i}", "hot" if i % 3 == 0 else f"k{rng.randrange(40)}") for i in range(300)] + [(900, "x", ""), (901, "y", None)]
    rng.shuffle(rows)
    root = tempfile.mkdtemp(prefix="arriving-")
    cut = [0, 120, 121, len(rows)]
    for n, (a, b) in enumerate(zip(cut, cut[1:])):
        assert add_names(_table(spark, rows[a:b]), root, f"b{n}")
        assert _rows(stored_groups(spark, root)) == _rows(dedupe(_table(spark, rows[:b])))
    assert _rows(stored_members(spark, root)) == _rows(dedupe_members(_table(spark, rows)))
    before = _rows(stored_groups(spark, root)), _rows(stored_members(spark, root))
    open_reader = stored_members(spark, root)
    compact(spark, root)
    assert (_rows(stored_groups(spark, root)), _rows(stored_members(spark, root))) == before
    assert _rows(open_reader) == before[1]
    assert not add_names(_table(spark, rows[:120]), root, "b0")  # sent again, also after the merge
    assert add_names(_table(spark, [(1000, "Z", "hot")]), root, "b9")
    assert {r.normalized_name: r.member_count for r in stored_groups(spark, root).collect()}["hot"] == 101


def test_changes_of_representatives(spark):
    root = tempfile.mkdtemp(prefix="arriving-")
    add_names(_table(spark, [(5, "Ana", "ana"), (7, "ANA", "ana"), (9, "Juan", "juan")]), root, "1")
    add_names(_table(spark, [(2, "ana!", "ana"), (12, "juan", "juan"), (13, "Eva", "eva")]), root, "2")
    assert _rows(batch_changes(spark, root, "2").select("id", "old_id", "normalized_name", "full_name", "member_count").na.fill(-1)) == [
        (2, 5, "ana", "ana!", 1), (13, -1, "eva", "Eva", 1),
    ]
    assert _rows(stored_members(spark, root)) == [(2, 2), (2, 5), (2, 7), (9, 9), (9, 12), (13, 13)]
    with pytest.raises(ValueError):
        batch_changes(spark, root, "3")


def test_rejected_and_empty_batches(spark):
    root = tempfile.mkdtemp(prefix="arriving-")
    assert stored_groups(spark, root).count() == 0 and stored_members(spark, root).count() == 0
    assert add_names(_table(spark, []), root, "none")
    assert stored_groups(spark, root).count() == 0
    add_names(_table(spark, [(1, "A", "a")]), root, "1")
    for bad in ([(2, "B", "b"), (2, "B", "b")], [(1, "C", "c")], [(None, "D", "d")]):
        with pytest.raises(ValueError):
            add_names(_table(spark, bad), root, "2")
        assert _rows(stored_groups(spark, root)) == [(1, "A", "a", 1)]
    assert add_names(_table(spark, [(2, "B", "b")]), root, "2")  # the id of a rejected batch is free
    wide = _table(spark, [(3, "B", "b")]).selectExpr("*", "9 AS member_count", "'x' AS part", "1 AS old_id")
    assert add_names(wide, root, "3")
    assert _rows(stored_groups(spark, root)) == [(1, "A", "a", 1), (2, "B", "b", 2)]


def test_a_batch_writes_only_itself(spark):
    """Files of a later batch hold its own rows and keys, however much is stored."""
    import glob

    import pyarrow.parquet as pq

    root = tempfile.mkdtemp(prefix="arriving-")
    add_names(_table(spark, [(i, f"N{i}", f"k{i % 50}") for i in range(2000)]), root, "1")
    old = set(glob.glob(f"{root}/_parts/*"))
    add_names(_table(spark, [(5000 + i, f"M{i}", f"k{i}") for i in range(3)]), root, "2")
    (part,) = set(glob.glob(f"{root}/_parts/*")) - old
    assert [sum(pq.read_metadata(f).num_rows for f in glob.glob(f"{part}/{t}/*.parquet")) for t in ("rows", "groups")] == [3, 3]


def test_a_batch_writes_no_names_twice(spark, tmp_path):
    """The first batch adds its rows and groups alone, a later one the keys that were stored; changes hold after a merge."""
    root = str(tmp_path)
    add_names(_table(spark, [(i, f"N{i}", f"k{i}") for i in range(500, 1000)]), root, "1")
    add_names(_table(spark, [(3, "New", "k3"), (4, "Low", "k600"), (2000, "High", "k601")]), root, "2")
    schemas = {tuple(spark.read.parquet(str(p)).columns) for p in (tmp_path / "_met").iterdir()}
    assert schemas == {("normalized_name", "old_id")}
    assert sorted(spark.read.parquet(str(p)).count() for p in (tmp_path / "_met").iterdir()) == [0, 2]
    want = [("k3", None, 3, "New", 1), ("k600", 600, 4, "Low", 1)]
    assert _rows(batch_changes(spark, root, "2")) == want
    compact(spark, root)
    assert _rows(batch_changes(spark, root, "2")) == want
    assert batch_changes(spark, root, "1").count() == 500
