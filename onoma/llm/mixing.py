"""Mixing sources to target weights by Sainte-Lague apportionment (operator 2).

1. Targets: sources, by code point with null last, weigh 5, 2, 1, repeating,
   and share the whole size; a target stops at ``MAX_EPOCHS`` times its
   source's size and the excess is reshared by weight (water filling).
2. Equal-token blocks: the targets' sum is cut into blocks of
   ``BLOCK_TOKENS`` and the blocks go to the sources by the highest
   Sainte-Lague quotients target/(2k+1).
3. Shards: a source is split by a hash of its documents into shards of about
   ``SHARD_TOKENS`` words, so a hot source never meets in one task; a
   source's blocks are apportioned over its shards by the same rule.
4. Selection: a shard's documents stand in the order of a seeded hash and are
   cut into n equal blocks; a quota of q blocks takes q div n whole passes
   and the q mod n blocks that follow a seeded one around the shard (which,
   in hashed order, are a random choice of documents). Which words of a
   document are taken follows from its place alone, so no block is ever
   materialised.

The quotas need the sources as a table (one row per source and shard); the
documents themselves are shuffled once, as (id, size).

Null texts have size 0 and take nothing. A null source is a source. Equal
doc_ids are ordered by size and interchangeable. Extra columns are ignored.
An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from onoma.llm.common import materialize, n_words

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
BLOCK_TOKENS = 32
SHARD_TOKENS = 200_000
SEED = "mix"


def _hash(*parts: Column) -> Column:
    """First 48 bits of an MD5 as a long: the same in any SQL engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(SEED), *parts)), 1, 12), 16, 10).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """``source, source_size, weight, target`` from ``source, source_size``.

    One row per source: windows without partition are over that small table.
    """
    rank = Window.orderBy(F.col("source").isNull(), F.col("source"))
    at = (F.row_number().over(rank) - 1) % len(WEIGHTS)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (at + 1).cast("int"))
    w = sizes.select("source", "source_size", weight.cast("long").alias("weight"))
    # fill in order of cap per weight: the sources before a row stop at their caps
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    share = (
        (F.sum("source_size").over(whole) - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * MAX_EPOCHS)
        / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    )
    cap = F.col("source_size") * MAX_EPOCHS
    w = w.withColumns({"full": share * F.col("weight") >= cap, "share": share})
    # from the first source on that isn't full, all have that one's share per weight
    level = F.first(F.when(~F.col("full"), F.col("share")), ignorenulls=True).over(
        order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    w = w.withColumn("level", level)
    target = F.least(cap.cast("double"), F.coalesce(F.col("level") * F.col("weight"), cap.cast("double")))
    return w.select("source", "source_size", "weight", target.alias("target"))


def sainte_lague(rows: DataFrame, weight: str, seats: Column, by: list[str], tie: list[Column], out: str) -> DataFrame:
    """Give ``seats`` of each group ``by`` to its rows by highest weight/(2k+1).

    With W the group's weight and S its rows, every divisor W/(seats - S/2)
    gives at most the seats and W/(seats + S/2) at least, by rounding halves.
    What the first gives is certain; the quotients between the two (about 2 S
    rows) are ranked for the rest.
    """
    g = Window.partitionBy(*by)
    total, s = F.sum(weight).over(g), F.count(F.lit(1)).over(g)
    r = rows.withColumn("_seats", seats)
    at_most = F.col("_seats") - s / 2 - 1
    sure = F.when((at_most > 0) & (total > 0), F.floor(F.col(weight) * at_most / total + 0.5)).otherwise(F.lit(0))
    most = F.when(total > 0, F.ceil(F.col(weight) * (F.col("_seats") + s / 2 + 1) / total + 0.5)).otherwise(F.lit(0))
    r = r.withColumns({"_sure": sure.cast("long"), "_most": most.cast("long")})
    r = r.withColumn("_left", F.col("_seats") - F.sum("_sure").over(g))
    more = F.when((F.col("_most") > F.col("_sure")) & (F.col(weight) > 0), F.sequence("_sure", F.col("_most") - 1))
    r = r.withColumn("_k", F.explode_outer(more)).withColumn("_q", F.col(weight) / (2 * F.col("_k") + 1))
    r = r.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc_nulls_last("_q"), *tie, "_k")))
    won = F.count(F.when(F.col("_k").isNotNull() & (F.col("_rank") <= F.col("_left")), 1))
    return r.groupBy(*rows.columns, "_sure").agg(won.alias("_won")).select(
        *rows.columns, (F.col("_sure") + F.col("_won")).alias(out)
    )


def mix(docs: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target, taken, source, shard`` per document."""
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size")
    )
    sized = materialize(sized, "mix-sizes")
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    all_seats = F.floor(F.sum("target").over(Window.partitionBy()) / BLOCK_TOKENS + 0.5).cast("long")
    one = F.lit(1).alias("_all")
    quota = sainte_lague(
        sources.select("*", one), "target", all_seats, ["_all"], [F.col("source").isNull(), F.col("source")], "source_blocks"
    ).drop("_all")
    quota = quota.withColumn("shards", F.floor(F.col("source_size") / SHARD_TOKENS).cast("long") + 1)
    quota = materialize(quota, "mix-sources")

    key = _hash(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    placed = (
        _with_source(sized, quota.select("source", "shards"))
        .withColumn("h", key)
        .withColumn("shard", F.col("h") % F.col("shards"))
        .drop("shards")
    )
    shards = (
        placed.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"))
        .join(quota.withColumnRenamed("source", "q_source"), F.col("source").eqNullSafe(F.col("q_source"))).drop("q_source", "shards")
    )
    shards = sainte_lague(shards, "shard_size", F.col("source_blocks"), ["source"], [F.col("shard")], "quota")
    shards = shards.withColumns({
        "n_blocks": F.greatest(F.floor(F.col("shard_size") / BLOCK_TOKENS + 0.5), F.lit(1)).cast("long"),
        "start": _hash(F.coalesce("source", F.lit("")), F.col("shard").cast("string")),
    }).withColumns({
        "quota": F.least("quota", MAX_EPOCHS * F.col("n_blocks")), "start": F.col("start") % F.col("n_blocks"),
    }).select(
        F.col("source").alias("s_source"), F.col("shard").alias("s_shard"),
        "shard_size", "source_size", "target", "quota", "n_blocks", "start",
    )
    run = Window.partitionBy("source", "shard").orderBy("h", "doc_id", "size")
    ends = placed.withColumn("end", F.sum("size").over(run.rowsBetween(Window.unboundedPreceding, 0)))
    rows = ends.join(shards, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("shard") == F.col("s_shard")))
    rows = rows.withColumn("passes", F.floor(F.col("quota") / F.col("n_blocks")).cast("long"))
    place = lambda block: F.floor(block * F.col("shard_size") / F.col("n_blocks")).cast("long")
    first, last = F.col("start"), F.col("start") + F.col("quota") % F.col("n_blocks")
    begin, end = F.col("end") - F.col("size"), F.col("end")
    overlap = lambda a, b: F.greatest(F.least(end, b) - F.greatest(begin, a), F.lit(0))
    ring = overlap(place(first), place(F.least(last, F.col("n_blocks")))) + overlap(
        F.lit(0), place(F.greatest(last - F.col("n_blocks"), F.lit(0)))
    )
    taken = F.col("passes") * F.col("size") + ring
    return rows.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "source", "shard")


def _with_source(docs: DataFrame, small: DataFrame) -> DataFrame:
    r = small.withColumnRenamed("source", "_source")
    return docs.join(r, docs["source"].eqNullSafe(r["_source"])).drop("_source")


def mixed(docs: DataFrame) -> DataFrame:
    """The documents of the mix (``taken`` above 0) with their columns and ``size, source_size, target, taken``.

    Expects unique ids; of rows with one id, each gets the largest ``taken``.
    """
    m = mix(docs).groupBy(F.col("doc_id").alias("m_id")).agg(
        *[F.max(c).alias(c) for c in ("size", "source_size", "target", "taken")]
    )
    return docs.select("doc_id", "text", "lang", "source", "n_chars").join(
        m.filter("taken > 0"), F.col("doc_id").eqNullSafe(F.col("m_id"))
    ).drop("m_id")
