"""Name and request tables derived from the driver's parquet tables.

The driver tables hold no person-name column, so names are derived with
Spark from whole values:

* ``segment_names``: every document text is split, whole, into its sentence
  and clause segments (at ``. ! ? ; : , |`` and line breaks). Each non-blank
  segment is one name; ``id = doc_id * SEGMENT_STRIDE + position``. Every
  character of every text lands in some segment.
* ``column_names``: one whole column value per row (``part.p_name``,
  ``customer.c_name``, ...).
* ``segment_requests``: the same segmentation of ``benchmark`` passages gives
  a batch of match requests with the request defaults.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Splits a text into sentence/clause segments.
SEGMENT_PATTERN = "[.!?;:,|\\n]+"
# Room for the segment position inside a combined id; a longer text raises.
SEGMENT_STRIDE = 1 << 28

# Defaults of absent request parameters.
REQUEST_DEFAULTS = {
    "threshold": 70.0,
    "limit": 10,
    "w_token": 0.65,
    "explain": False,
    "include_by_id": True,
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def segments(df: DataFrame, id_col: str, text_col: str, out_id: str = "id", out_text: str = "full_name") -> DataFrame:
    parts = df.select(
        F.col(id_col).alias("_src"), F.posexplode(F.split(F.col(text_col), SEGMENT_PATTERN)).alias("_pos", "_seg")
    )
    pos = F.when(F.col("_pos") < SEGMENT_STRIDE, F.col("_pos")).otherwise(F.raise_error(F.lit("too many segments in a text")).cast("int"))
    return parts.select(
        (F.col("_src") * F.lit(SEGMENT_STRIDE) + pos).alias(out_id),
        F.trim(F.col("_seg")).alias(out_text),
    ).filter(F.col(out_text) != "")


def segment_names(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    """(id, full_name) for every text segment of ``documents``."""
    id_col, text_col = {"documents": ("doc_id", "text"), "benchmark": ("item_id", "text")}[table]
    return segments(read_table(spark, sf_dir, table), id_col, text_col)


def column_names(spark: SparkSession, sf_dir: str, table: str, id_col: str, name_col: str) -> DataFrame:
    df = read_table(spark, sf_dir, table)
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(name_col).alias("full_name")).filter(
        F.col("full_name").isNotNull()
    )


def with_request_defaults(df: DataFrame) -> DataFrame:
    """Fill absent request parameters with the documented defaults."""
    out = df
    for key, default in REQUEST_DEFAULTS.items():
        value: Column = F.lit(default)
        if key in out.columns:
            value = F.coalesce(F.col(key), value)
        out = out.withColumn(key, value)
    return out.select(
        F.col("request_id").cast("long"),
        F.col("name"),
        F.col("threshold").cast("double"),
        F.col("limit").cast("int"),
        F.col("w_token").cast("double"),
        F.col("explain").cast("boolean"),
        F.col("include_by_id").cast("boolean"),
    )


def segment_requests(spark: SparkSession, sf_dir: str, table: str = "benchmark") -> DataFrame:
    """Match requests: one per segment of each ``benchmark`` passage."""
    segs = segment_names(spark, sf_dir, table).select(
        F.col("id").alias("request_id"), F.col("full_name").alias("name")
    )
    return with_request_defaults(segs)
