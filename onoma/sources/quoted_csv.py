"""CSV files whose quoted fields hold line breaks, each read by many tasks.

A line ends a record if the quotes from the start of the file up to it are
even in number (a quote inside a quoted field is doubled). One pass counts the
quotes of every byte range that Spark makes of a file; their running sums, one
row per range, say which ranges start inside a field. A second pass cuts every
range into records by itself. Only the open ends (at most two per range) are
put together afterwards, so a record may reach over any number of ranges.

Lines end with ``\\n`` or ``\\r\\n``. Bytes that aren't UTF-8 become U+FFFD; blank
lines are no records; a field left open takes the rest of its file. A lone
quote within an unquoted field isn't allowed.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from onoma.session import materialize

#: Parts of a range: whole records, the end of one, the middle of one, the start of one.
WHOLE, END, MIDDLE, START = range(4)


def records(spark: SparkSession, path: str) -> DataFrame:
    """``file, start, seq, record``: every record of the files of ``path``; the first of a file has start 0 and seq 0."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.make_valid_utf8("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")
    )
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    ranges = lines.groupBy("file", "start").agg(F.sum(quotes).alias("quotes"))
    ranges = ranges.select("file", "start", (F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2 == 1).alias("inside"))
    ranges = materialize(ranges, "csv-ranges")  # its size is known when the join is planned: broadcast, or joined by range beyond the threshold
    placed = lines.withColumn("n", F.monotonically_increasing_id()).join(ranges, ["file", "start"]).sortWithinPartitions("file", "start", "n")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, inside, begun, seq = None, False, True, 0
        held: list[str] = []

        def part(kind: int) -> tuple:
            return (*at, seq, kind, "\n".join(held))

        def batch(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            if rows:
                types = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["file", "start", "seq", "kind", "record"])

        for b in batches:
            rows = []
            for file, start, opened, line in zip(*(c.to_pylist() for c in b.columns)):
                if (file, start) != at:
                    if held:
                        rows.append(part(START if begun else MIDDLE))
                    at, inside, begun, seq, held = (file, start), opened, not opened, 0, []
                held.append(line)
                inside ^= bool(line.count('"') & 1)
                if not inside:
                    rows.append(part(WHOLE if begun else END))
                    begun, seq, held = True, seq + 1, []
            yield from batch(rows)
        if held:
            yield from batch([part(START if begun else MIDDLE)])

    parts = placed.select("file", "start", "inside", "line").mapInArrow(cut, "file string, start long, seq long, kind int, record string")
    upto = Window.partitionBy("file").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)  # at most two rows per range
    ends = parts.filter(F.col("kind") != WHOLE).withColumn("begin", F.sum((F.col("kind") == START).cast("int")).over(upto))
    ends = ends.groupBy("file", "begin").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "seq", "record"))).alias("p"))  # one record
    joined = ends.select("file", F.col("p")[0]["start"].alias("start"), F.col("p")[0]["seq"].alias("seq"), F.array_join("p.record", "\n").alias("record"))
    whole = parts.filter(F.col("kind") == WHOLE).select("file", "start", "seq", "record")
    return whole.unionByName(joined).withColumn("record", F.regexp_replace("record", r"\r\z", "")).filter(F.col("record") != "")


def fields(record: str, width: int):
    """A struct ``_c0.._cN`` of text from the CSV record in column ``record``."""
    return F.from_csv(F.col(record), ", ".join(f"_c{i} string" for i in range(width)), {"escape": '"'})


def read_quoted(spark: SparkSession, path: str) -> list[tuple[DataFrame, list[str]]]:
    """(columns ``_c0.._cN``, header) for every different header among the files of ``path``."""
    rows = records(spark, path)
    first = (F.col("start") == 0) & (F.col("seq") == 0)
    heads = rows.filter(first).select("file", F.ltrim("record", F.lit("\ufeff")).alias("header"))
    out = []
    for (text,) in sorted(heads.select("header").distinct().collect()):  # one row per different header
        header = next(csv.reader(io.StringIO(text, newline="")))
        files = heads.filter(F.col("header") == text).select("file")
        body = rows.filter(~first).join(files, "file", "left_semi")
        out.append((body.select(fields("record", len(header)).alias("r")).select("r.*"), header))
    if not out:
        raise ValueError("CSV without a header")
    return out
