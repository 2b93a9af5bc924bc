"""CSV files with line breaks in fields, read by byte ranges: against Python's reader and Spark's one-task reader."""

from __future__ import annotations

import csv
import io
import random

import pytest

from onoma.sources.names_csv import read_names_lenient
from onoma.sources.quoted_csv import fields, read_quoted, records


@pytest.fixture
def small_ranges(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def field(rng):
    kind = rng.random()
    if kind < 0.03:
        return "\n".join("long line, of a record" for _ in range(60))  # over several ranges
    return "".join(rng.choice(["a", "b ", "\n", '"', ",", "é", "x"]) for _ in range(rng.randint(1, 25))).strip() or "z"


def test_records_reach_over_ranges(spark, small_ranges, tmp_path):
    rng = random.Random(5)
    want = []
    for k, end in enumerate(("\n", "\r\n")):
        rows = [(str(1000 * k + i), field(rng), field(rng)) for i in range(150)]
        want += rows
        out = io.StringIO(newline="")
        csv.writer(out, lineterminator=end).writerows([("id", "name", "note"), *rows])
        (tmp_path / f"f{k}.csv").write_bytes(out.getvalue().encode())
    got = records(spark, str(tmp_path))
    assert got.select("file", "start").distinct().count() > 20
    [(body, header)] = read_quoted(spark, str(tmp_path))
    assert header == ["id", "name", "note"]
    rows = sorted(tuple(r) for r in body.collect())
    assert rows == sorted(want)
    one_task = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path))
    assert rows == sorted(tuple(r) for r in one_task.collect())


def test_headers_bad_bytes_blank_lines_open_field(spark, small_ranges, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'\xef\xbb\xbfid,name\n1,"Ann\nLee"\n\n2,Bo\xff\n')
    (tmp_path / "b.csv").write_bytes(b'name,extra,id\r\n"Cy ""the"" Fox",x,3\r\n"open, and\r\nso on\r\n')
    got = {tuple(header): sorted(tuple(r) for r in body.collect()) for body, header in read_quoted(spark, str(tmp_path))}
    assert got["id", "name"] == [("1", "Ann\nLee"), ("2", "Bo�")]
    assert ('Cy "the" Fox', "x", "3") in got["name", "extra", "id"] and len(got["name", "extra", "id"]) == 2
    names = {r["id"]: r["full_name"] for r in read_names_lenient(spark, str(tmp_path), multi_line=True).collect()}
    assert names == {1: "Ann\nLee", 2: "Bo�", 3: 'Cy "the" Fox'}


def test_empty_file_has_no_header(spark, tmp_path):
    (tmp_path / "e.csv").write_bytes(b"")
    with pytest.raises(ValueError):
        read_quoted(spark, str(tmp_path))


def test_fields_pad_and_cut_like_the_csv_reader(spark, tmp_path):
    lines = ["a", 'a,"b,c",d', ',""', '"","x ""y"" "', " p , q "]
    (tmp_path / "w.csv").write_text("h,i\n" + "\n".join(lines) + "\n")
    want = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path)).collect()
    rows = spark.createDataFrame([(x,) for x in lines], "record string").select(fields("record", 2).alias("r")).select("r.*")
    assert [tuple(r) for r in rows.collect()] == [tuple(r) for r in want]
