"""Spelling variant grouping with a trie-node pair dictionary (operator 12).

Words are counted over all documents; two words are near when one inserted,
deleted or replaced code point makes them equal. A word's form is its nearest
more frequent spelling, its root the end of the chain of forms.

Trie nodes. ``number_nodes`` numbers the prefixes of all words: in code-point
order the node of a prefix belongs to the first word that has it, so a node is
(number of that word, depth) in one integer. Words are range-partitioned and
sorted; a task finds the first words within its range by the letters shared
with the word before, and the few nodes that began in an earlier range are
known from one border row per range. Reversed words give the nodes of suffixes.

Pairs. Each word w of m letters enters, for every place i, the integer pair
(node of w[:i], node of w[i+1:]) with the place skipped, and for every gap i
the pair (node of w[:i], node of w[i:]). Equal pairs mean equal letters on both
sides, so words that meet in skipped pairs differ by one replaced letter, and a
gap pair meeting a skipped pair is one inserted letter: exact, without a check
of the letters. A gap pair has one word and a skipped pair at most one word
per letter of the alphabet, so no group of pairs grows with the corpus; groups are
reduced to counts and the two best words, and no pair of words is ever listed.
Of equal adjoining letters only the first counts as the deleted one, so a pair
of words is counted once.

Chains of forms end after few steps (a form is at least twice as frequent), and
are followed by pointer doubling over written tables.

Null texts have no words; a null doc_id hashes as the empty string. Repeated
rows count again. Words of any length work: a word's pairs grow with its length.
Ties between forms go to the smallest word in code-point order. Extra columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from onoma.llm.common import LOWER, UPPER, materialize

MIN_LENGTH = 5
MIN_COUNT = 3
RATIO = 2
#: One occurrence of a run in so many documents loses a letter.
SLIP = 97
RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = str.maketrans(UPPER, LOWER)
#: Distinct words a task holds before it sends its counts.
HELD_WORDS = 200_000
#: Characters of words a range is planned for.
RANGE_CHARS = 8_000_000


# ---- words ----------------------------------------------------------------

def slipped(doc_id: int | None, run: str) -> str:
    """The run as the document has it: now and then without one letter."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % SLIP:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def count_words(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """``word, n`` of the words of ``doc_id, text``, partly counted in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for word, n in Counter(RUN.findall((text or "").translate(_LOWER))).items():
                    word = slipped(doc_id, word)
                    if len(word) >= min_length:
                        held[word] += n
                if len(held) >= HELD_WORDS:
                    yield flush()
                    held.clear()
        yield flush()

    counted = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


# ---- trie nodes -----------------------------------------------------------

def _shared(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(i for i in range(n) if a[i] != b[i])


def _first_words(keys: DataFrame) -> DataFrame:
    """``part, seq, key`` and the payload, with ``owners``: the number within the range of the first word of each prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, last = TaskContext.get().partitionId(), 0, ""
        owners = np.zeros(1, np.int64)
        for b in batches:
            got = []
            for key in b.column("key").to_pylist():
                keep = _shared(last, key)
                new = np.full(len(key) + 1, seq, np.int64)
                new[: keep + 1] = owners[: keep + 1]
                got.append(new)
                last, owners, seq = key, new, seq + 1
            if got:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part] * len(got), pa.int32()),
                        pa.array(np.arange(seq - len(got), seq)),
                        pa.array(got, pa.list_(pa.int64())),
                        *b.columns,
                    ],
                    ["part", "seq", "owners", *b.schema.names],
                )

    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keys.schema)
    return keys.mapInArrow(run, f"part int, seq long, owners array<long>, {columns}")


def number_nodes(keys: DataFrame, ranges: int, depth_bits: int) -> DataFrame:
    """The rows of ``keys`` (distinct ``key``, payload) with ``number`` (place in code-point order)
    and ``nodes``: the number of the trie node of every prefix, the empty one first."""
    spark = keys.sparkSession
    sorted_ = materialize(_first_words(keys.repartitionByRange(ranges, "key").sortWithinPartitions("key")), "trie-words")
    # one row per range: bounded by the number of ranges
    borders = (
        sorted_.groupBy("part")
        .agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first"), F.max("key").alias("last"), F.max_by("owners", "seq").alias("spine"))
        .orderBy("part").collect()
    )
    offset, before, path, rows = 0, "", [0], []
    for b in borders:
        # nodes of the range's first word that an earlier range has begun
        known = path[: _shared(before, b["first"]) + 1]
        rows.append((b["part"], offset, known))
        path = [known[d] if d < len(known) and o == 0 else o + offset for d, o in enumerate(b["spine"])]
        before, offset = b["last"], offset + b["n"]
    table = spark.createDataFrame(rows, "part int, base long, known array<long>")

    def node(owner: Column, depth: Column) -> Column:
        first = F.when((owner == 0) & (depth < F.size("known")), F.get("known", depth)).otherwise(owner + F.col("base"))
        return F.shiftleft(first, depth_bits).bitwiseOR(depth.cast("long"))

    out = sorted_.join(table, "part").withColumn("nodes", F.transform("owners", node))
    return out.withColumn("number", F.col("seq") + F.col("base")).drop("part", "seq", "owners", "base", "known")


# ---- pairs ----------------------------------------------------------------

def near_words(words: DataFrame) -> DataFrame:
    """``id, word, n, n_near, best``: number in code-point order, near words and the most frequent of them."""
    about = words.agg(F.sum(F.length("word")).alias("chars"), F.max(F.length("word")).alias("longest")).first()
    chars, longest = about["chars"] or 0, about["longest"] or 0
    spark = words.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), chars // RANGE_CHARS)
    depth_bits = max(longest.bit_length(), 1)
    forward = number_nodes(words.withColumnRenamed("word", "key"), ranges, depth_bits)
    forward = materialize(forward.select(F.col("number").alias("id"), F.col("key").alias("word"), "n", F.col("nodes").alias("heads")), "trie-forward")
    back = number_nodes(forward.select(F.reverse("word").alias("key"), "id"), ranges, depth_bits)
    both = forward.join(back.select("id", F.col("nodes").alias("tails")), "id")

    size = F.length("word")
    skipped = F.transform(
        F.sequence(F.lit(0), size - 1),
        lambda i: F.struct(
            F.get("heads", i).alias("head"),
            F.get("tails", size - i - 1).alias("tail"),
            F.lit(True).alias("skip"),
            # deleting any letter of a run gives one word
            ((i == 0) | (F.substr("word", i + 1, F.lit(1)) != F.substr("word", i, F.lit(1)))).alias("lone"),
        ),
    )
    gaps = F.transform(
        F.sequence(F.lit(0), size),
        lambda i: F.struct(F.get("heads", i).alias("head"), F.get("tails", size - i).alias("tail"), F.lit(False).alias("skip"), F.lit(False).alias("lone")),
    )
    pairs = both.select("id", "n", F.inline(F.concat(skipped, gaps)))

    # A pair has at most one gap word and one skipped word per letter.
    entry = F.struct(F.col("n").alias("n"), (-F.col("id")).alias("nid"))
    met = pairs.groupBy("head", "tail").agg(
        F.collect_list(F.when(F.col("skip"), F.struct("n", (-F.col("id")).alias("nid"), "lone"))).alias("skips"),
        F.max(F.when(~F.col("skip"), entry)).alias("gap"),
    )
    met = met.filter((F.size("skips") > 1) | ((F.size("skips") > 0) & F.col("gap").isNotNull()))
    lones = F.filter("skips", lambda x: x["lone"])
    top = F.array_sort("skips", lambda a, b: F.when(a["n"] != b["n"], F.signum(b["n"] - a["n"])).otherwise(F.signum(b["nid"] - a["nid"])).cast("int"))
    met = met.select("gap", lones.alias("lones"), top.alias("skips"))

    def plain(x: Column) -> Column:
        return F.struct(x["n"].alias("n"), x["nid"].alias("nid"))

    def of_skipped(x: Column) -> Column:
        rival = F.when(F.get("skips", F.lit(0))["nid"] != x["nid"], plain(F.get("skips", F.lit(0)))).otherwise(
            F.when(F.size("skips") > 1, plain(F.get("skips", F.lit(1))))
        )
        joins = x["lone"] & F.col("gap").isNotNull()
        best = F.array_max(F.array_compact(F.array(rival, F.when(joins, F.col("gap")))))
        return F.struct((-x["nid"]).alias("id"), (F.size("skips") - 1 + joins.cast("int")).cast("long").alias("k"), best.alias("best"))

    of_gap = F.struct(
        (-F.col("gap.nid")).alias("id"),
        F.size("lones").cast("long").alias("k"),
        F.array_max(F.transform("lones", plain)).alias("best"),
    )
    told = met.select(F.inline(F.concat(F.transform("skips", of_skipped), F.when(F.col("gap").isNotNull(), F.array(of_gap)).otherwise(F.array()))))
    told = told.filter("k > 0").groupBy("id").agg(F.sum("k").alias("n_near"), F.max("best").alias("best"))
    out = forward.select("id", "word", "n").join(told, "id", "left")
    return out.select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), (-F.col("best.nid")).alias("best"), F.col("best.n").alias("best_n")
    )


def follow(links: DataFrame) -> DataFrame:
    """``id, root``: the end of the chain of each ``id`` of ``id, form`` (no circles)."""
    at = links.select("id", F.col("form").alias("root"))
    while True:
        step = at.select(F.col("id").alias("root"), F.col("root").alias("next"))
        at = materialize(at.join(step, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        moved = at.filter("moved").take(1)
        at = at.drop("moved")
        if not moved:
            return at


def spelling_forms(docs: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of ``doc_id, text``."""
    words = materialize(count_words(docs), "words")
    near = near_words(words)
    is_form = F.col("best_n") >= RATIO * F.col("n")
    near = materialize(near.withColumns({"form": F.when(is_form, F.col("best")), "form_n": F.when(is_form, F.col("best_n"))}), "near-words")
    roots = follow(near.filter("form IS NOT NULL").select("id", "form"))
    names = near.select(F.col("id").alias("form"), F.col("word").alias("form_word"))
    tops = near.select(F.col("id").alias("root"), F.col("word").alias("root_word"))
    return (
        near.join(roots, "id", "left").join(names, "form", "left").join(tops, "root", "left")
        .select("word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")
    )
