"""Inverted gram index and candidate generation.

The index holds every posting. A caller may cap the candidates of a request
at the K lowest ids (``max_candidates``); nothing is capped unless asked for.

The match job itself does not join on grams: a common gram pairs nearly every
request with nearly every key, so it takes the request batch in blocks past
the stored lots instead (``onoma.operators.keyindex``, ``probe``). This view
serves lookups of few requests and the capped mode.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from onoma.functions.grams import distinct_grams

DEFAULT_NGRAM = 3
#: Pairs that a task takes, equal ones included, when nothing is capped.
TASK_PAIRS = 2_000_000
#: Grams of a request batch that each task may hold.
HELD_GRAMS = 1_000_000


def gram_index(names: DataFrame, n: int = DEFAULT_NGRAM) -> DataFrame:
    """(gram, id): each distinct gram of each key."""
    return names.select(F.explode(distinct_grams("normalized_name", n)).alias("gram"), "id")


def request_grams(requests: DataFrame, n: int = DEFAULT_NGRAM) -> DataFrame:
    """(request_id, gram) for every distinct gram of each request key."""
    return requests.select("request_id", F.explode(distinct_grams("q_norm", n)).alias("gram"))


def candidate_ids(requests: DataFrame, index: DataFrame, n: int = DEFAULT_NGRAM, max_candidates: int | None = None) -> DataFrame:
    """(request_id, id): union of the postings of a request's grams.

    Postings of grams that no request has are dropped before any shuffle when
    the batch's grams are few (AQE decides from their measured size). A gram
    that many keys and requests share is split by AQE's skew join. With
    ``max_candidates`` the K lowest ids per request are kept (C5):
    ``dense_rank`` over the raw rows trims each map task before its shuffle.

    Without a cap the pairs are counted first (once over the postings), and the
    postings are dealt by id over as many tasks as the pairs need: equal pairs
    have equal ids, so they meet in their task, the pairs are not shuffled and
    what a task holds does not grow with the tables.
    """
    grams = request_grams(requests, n)
    index = index.join(grams.select("gram").distinct(), "gram", "left_semi")
    if max_candidates is None:
        asked = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("_asked"))
        pairs = index.join(asked, "gram").agg(F.sum("_asked")).first()[0] or 0
        index = index.repartition(max(2 * index.sparkSession.sparkContext.defaultParallelism, -(-pairs // TASK_PAIRS)), "id")
        if grams.count() <= HELD_GRAMS:
            grams = F.broadcast(grams)
    hits = grams.join(index, "gram").select("request_id", "id")
    if max_candidates is not None:
        by_id = Window.partitionBy("request_id").orderBy("id")
        hits = hits.withColumn("_dr", F.dense_rank().over(by_id)).filter(F.col("_dr") <= F.lit(max_candidates)).drop("_dr")
    return hits.dropDuplicates(["request_id", "id"])


def candidate_counts(cands: DataFrame) -> DataFrame:
    """(request_id, candidate_count) for requests that hit the index."""
    return cands.groupBy("request_id").agg(F.count(F.lit(1)).alias("candidate_count"))
