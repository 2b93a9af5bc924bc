"""Figures over a query log that need an order: running windows (M4) and exact percentiles (M3).

``running_stats`` gives mean and p95 of the newest ``last_n`` searches at every
search. Rows are numbered by a range partitioning on ``seq`` (one count per
range is all the driver sees) and cut into blocks; a block also gets the
``last_n - 1`` rows before it, so no window ever needs one partition for all.
Sums are kept in whole millionths, so they don't depend on the order of adding.

``exact_percentile`` finds the element at a rank of a whole log without
sorting it: a histogram of ``BINS`` bins over the value range is counted, the
bin that holds the rank becomes the next range, until one value is left. Each
step is one partially aggregated scan and at most ``BINS`` rows on the driver.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from onoma.functions.similarity import py_round
from onoma.operators.querylog import LAST_N, P95, searches
from onoma.session import materialize

BLOCK_ROWS = 20_000
BINS = 4096
#: Parts of a millisecond (or candidate) that sums are kept in.
PARTS = 1_000_000

_STATS = "seq long, n long, latency_ms_avg double, latency_ms_p95 double, candidates_avg double, candidates_p95 double"


# ---- running window -------------------------------------------------------

def numbered(rows: DataFrame, order: str) -> DataFrame:
    """``rows`` with ``rn``: 0-based place in the order of a column of distinct values."""
    spark = rows.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            places = pa.array(np.arange(at, at + b.num_rows), pa.int64())
            at += b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * b.num_rows, pa.int32()), places], [*b.schema.names, "part", "at"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    spread = rows.repartitionByRange(parts, order).sortWithinPartitions(order).mapInArrow(run, f"{columns}, part int, at long")
    spread = materialize(spread, "numbered")
    offset, bases = 0, []
    for r in spread.groupBy("part").agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():  # one row per range
        bases.append((r["part"], offset))
        offset += r["n"]
    table = spark.createDataFrame(bases, "part int, base long")
    return spread.join(F.broadcast(table), "part").withColumn("rn", F.col("base") + F.col("at")).drop("part", "at", "base")


def _window(values: list, keep: np.ndarray, last_n: int) -> tuple[list[float], list[float]]:
    """Mean and p95 of the newest ``last_n`` values at each kept place; nulls sort first and have no share in the mean."""
    cells = [0 if v is None else round(v * PARTS) for v in values]
    sums = [0]
    known = [0]
    for v, c in zip(values, cells):
        sums.append(sums[-1] + c)
        known.append(known[-1] + (v is not None))
    means, highs, held = [], [], []
    for i, v in enumerate(values):
        insort(held, -np.inf if v is None else v)
        low = max(0, i + 1 - last_n)
        if low:
            old = values[low - 1]
            del held[bisect_left(held, -np.inf if old is None else old)]
        if keep[i]:
            n = known[i + 1] - known[low]
            means.append((sums[i + 1] - sums[low]) / (n * PARTS) if n else 0.0)
            top = held[int(P95 * (len(held) - 1))]
            highs.append(0.0 if top == -np.inf else float(top))
    return means, highs


def running_stats(log: DataFrame, last_n: int = LAST_N) -> DataFrame:
    """``seq, n`` and the rolling figures at every search; ``n``: searches in the window. ``seq`` is unique."""
    rows = searches(log).select(F.col("seq").cast("long").alias("seq"), F.col("latency_ms").cast("double").alias("latency_ms"), F.col("candidate_count").cast("double").alias("candidates"))
    size = max(BLOCK_ROWS, last_n)
    rows = numbered(rows, "seq").withColumn("block", F.floor(F.col("rn") / size))
    halo = F.when(F.col("rn") % size > size - last_n, F.array(F.col("block"), F.col("block") + 1)).otherwise(F.array("block"))
    rows = rows.withColumn("into", F.explode(halo))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("rn")
        keep = np.array(table["block"]) == np.array(table["into"])
        rn = np.array(table["rn"])[keep]
        latency = _window(table["latency_ms"].to_pylist(), keep, last_n)
        candidates = _window(table["candidates"].to_pylist(), keep, last_n)
        # a block past the last one has a halo only
        columns = [pa.array(np.array(table["seq"])[keep]), pa.array(np.minimum(rn + 1, last_n))]
        columns += [pa.array(c, pa.float64()) for c in (*latency, *candidates)]
        return pa.table(columns, names=[c.split(" ")[0] for c in _STATS.split(", ")])

    out = rows.groupBy("into").applyInArrow(run, _STATS)
    return out.select("seq", "n", *[py_round(F.col(c), 2).alias(c) for c in out.columns[2:]])


# ---- selection ------------------------------------------------------------

def exact_percentile(values: DataFrame, column: str, share: float) -> float | None:
    """The element at 0-based place int(share * (n - 1)) of the sorted non-null values; None without one."""
    df = values.select(F.col(column).cast("double").alias("x")).filter(F.col("x").isNotNull())
    whole = df.agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    if not whole["n"]:
        return None
    rank, lo, hi = int(share * (whole["n"] - 1)), whole["lo"], whole["hi"]
    while lo != hi:
        width = hi / 2 - lo / 2  # halves keep it finite for any pair of doubles
        place = F.floor((F.col("x") / 2 - lo / 2) / width * BINS) if width else (F.col("x") > lo).cast("long")
        bins = (
            df.filter(F.col("x").between(lo, hi))
            .groupBy(F.least(place, F.lit(BINS - 1)).alias("bin"))
            .agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
            .orderBy("bin").collect()  # at most BINS rows
        )
        for b in bins:
            if rank < b["n"]:
                break
            rank -= b["n"]
        if (b["lo"], b["hi"]) == (lo, hi):  # two neighbouring doubles
            below = df.filter(F.col("x") == lo).count()
            return lo if rank < below else hi
        lo, hi = b["lo"], b["hi"]
    return lo


def whole_stats(log: DataFrame) -> DataFrame:
    """One row: searches, and the p95 of latency and candidates over the whole log, however long (M3)."""
    rows = searches(log)
    found = [exact_percentile(rows, c, P95) or 0.0 for c in ("latency_ms", "candidate_count")]
    counted = rows.agg(F.count(F.lit(1)).alias("searches"))
    return counted.select("searches", *[py_round(F.lit(v), 2).alias(c) for v, c in zip(found, ("latency_ms_p95", "candidates_p95"))])
