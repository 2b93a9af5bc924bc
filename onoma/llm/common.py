"""Shared helpers of the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from onoma.session import ensure_checkpoint_dir

#: ASCII white space (0x20, 0x09-0x0D); every other code point is part of a word.
SPACES = " \t\n\x0b\x0c\r"
#: A word in the sense of the contracts of operators 2, 7 and 8.
WORD = r"[^\x20\x09-\x0D]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Rows per Arrow batch: long documents stay a few MB per batch.
BATCH_ROWS = 512
BATCH_BYTES = 16 << 20


def prepare(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    ensure_checkpoint_dir(spark)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def n_words(text: Column) -> Column:
    """Number of words (null text: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def map_rows(
    df: DataFrame,
    fn: Callable[[dict[str, list]], dict[str, list]],
    schema: str,
) -> DataFrame:
    """Apply ``fn`` to whole Arrow batches, given and returned as lists by column."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    out_schema = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows == 0:
                continue
            out = fn({n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)})
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[f.name], type=f.type) for f in out_schema], schema=out_schema
            )

    return df.mapInArrow(run, schema)


def sampled_texts(docs: DataFrame, k: int) -> DataFrame:
    """``text`` of the rows that hold the ``k`` lowest (doc_id hash, text hash) pairs.

    Only pairs of hashes are ranked; the texts of the winners are then picked
    where they lie, so no task gathers texts. The list of pairs is broadcast:
    it has at most ``k`` rows. Copies of a chosen row (equal id and text) come
    along; null ids and texts hash like values.
    """
    hashed = docs.select("text", F.xxhash64("doc_id").alias("_id_hash"), F.xxhash64("text").alias("_text_hash"))
    lowest = hashed.select("_id_hash", "_text_hash").orderBy("_id_hash", "_text_hash").limit(k)
    return hashed.join(F.broadcast(lowest), ["_id_hash", "_text_hash"], "left_semi").select("text")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(written: DataFrame) -> None:
    """Delete the folder of a table that ``materialize`` wrote and nothing reads any more."""
    files = written.inputFiles()
    if files:
        _delete(written.sparkSession, files[0].rsplit("/", 1)[0])


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class ChunkTable:
    """Rows of a few MB in a table bucketed by ``key``, so that joins on it leave them where they are."""

    def __init__(self, rows: DataFrame, key: str, buckets: int):
        self._spark = rows.sparkSession
        self._name, self._path = f"chunks_{uuid.uuid4().hex}", shared_path(self._spark, "chunks")
        (
            rows.repartition(buckets, key).write.format("parquet")
            .option("path", self._path).option("compression", "none")
            .bucketBy(buckets, key).saveAsTable(self._name)
        )

    def rows(self) -> DataFrame:
        return self._spark.table(self._name)

    def drop(self) -> None:
        self._spark.sql(f"DROP TABLE IF EXISTS {self._name}")
        _delete(self._spark, self._path)
