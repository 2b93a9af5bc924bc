"""Streams of match requests (ST1) and the query log they leave (ST2).

The names are indexed once, before the first batch; each micro-batch opens that
version of the index and writes only tables of its own size (ranking windows
are not allowed on a stream itself, hence ``foreachBatch``). Every batch writes to a folder named by its batch id with
mode overwrite, so a batch replayed after a failure replaces its own output
instead of duplicating it. All paths come from the caller and belong on
shared storage (the session's checkpoint folder in the tests).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from onoma.operators.querylog import TIE_COLUMNS
from onoma.operators.keyindex import KeyIndex, build_index, open_index
from onoma.plans.match import MatchConfig, match_index

# What makes two requests equal.
LOG_KEY = ["query_norm", "threshold", "limit", "w_token", "explain", "include_by_id"]


def _read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def batch_writer(index: KeyIndex, out_dir: str, cfg: MatchConfig = MatchConfig()):
    """The ``foreachBatch`` function: hits, rejections, log rows and first-seen keys of one micro-batch.

    The first-seen table has one row per request key and batch that brought a
    new key; a batch reads it (not the log) to mark repeats.
    """

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        result = match_index(index, batch, cfg)
        result.hits.write.mode("overwrite").parquet(f"{out_dir}/hits/batch_id={batch_id}")
        result.rejected.write.mode("overwrite").parquet(f"{out_dir}/rejected/batch_id={batch_id}")
        asked = result.requests.select("request_id", "threshold", "limit", "w_token", "explain", "include_by_id")
        rows = result.summary.join(asked, "request_id").select(
            F.col("request_id").alias("seq"),
            F.col("q_norm").alias("query_norm"),
            "threshold",
            "limit",
            "w_token",
            "explain",
            "include_by_id",
            F.lit(None).cast("double").alias("latency_ms"),
            F.col("candidate_count").cast("long"),
            *[F.col(c).cast("long") for c in TIE_COLUMNS],
        )
        first = rows.groupBy(*LOG_KEY).agg(F.min("seq").alias("first_seq"))
        known = _read_or_none(spark, f"{out_dir}/first")
        if known is not None:
            # a replayed batch must not meet its own keys
            known = known.filter(F.col("batch_id") < batch_id).select(*LOG_KEY, F.col("first_seq").alias("known_seq"))
            first = first.join(known, LOG_KEY, "left")
        else:
            first = first.withColumn("known_seq", F.lit(None).cast("long"))
        marked = rows.join(first, LOG_KEY).withColumn(
            "is_repeat", F.col("known_seq").isNotNull() | (F.col("seq") > F.col("first_seq"))
        )
        marked.drop("first_seq", "known_seq").write.mode("overwrite").parquet(f"{out_dir}/log/batch_id={batch_id}")
        first.filter("known_seq IS NULL").drop("known_seq").write.mode("overwrite").parquet(f"{out_dir}/first/batch_id={batch_id}")

    return write_batch


def standing_index(names: DataFrame, root: str, cfg: MatchConfig = MatchConfig()) -> KeyIndex:
    """The index that every micro-batch reads: built once, kept across restarts."""
    return open_index(names.sparkSession, root) or build_index(names, root, cfg.ngram_n)


def start_match_stream(
    spark: SparkSession,
    names: DataFrame,
    request_dir: str,
    request_schema,
    out_dir: str,
    checkpoint_dir: str,
    cfg: MatchConfig = MatchConfig(),
    files_per_batch: int = 1,
):
    """Start the stream over parquet request files arriving in ``request_dir``."""
    index = standing_index(names, f"{out_dir}/_index", cfg)
    stream = spark.readStream.schema(request_schema).option("maxFilesPerTrigger", files_per_batch).parquet(request_dir)
    return (
        stream.writeStream.foreachBatch(batch_writer(index, out_dir, cfg))
        .option("checkpointLocation", checkpoint_dir)
        .trigger(processingTime="0 seconds")
        .start()
    )


def read_stream_hits(spark: SparkSession, out_dir: str) -> DataFrame:
    return spark.read.parquet(f"{out_dir}/hits").drop("batch_id")


def read_stream_log(spark: SparkSession, out_dir: str) -> DataFrame:
    return spark.read.parquet(f"{out_dir}/log")
