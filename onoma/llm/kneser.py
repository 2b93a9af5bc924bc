"""Quality classifier: interpolated modified Kneser-Ney over trusted text (operator 3).

Tokens of the model are the bytes of words between a begin and an end mark,
order ``ORDER``; a word's score does not depend on its neighbours, so a task
scores each distinct word once. N-grams are packed exactly into a long
(fold and length in the top byte), which makes prefixes and suffixes bit operations.

1. ``pack`` writes the documents as compressed chunks of about
   ``CHUNK_BYTES`` into a table bucketed by chunk, so that later joins by
   chunk move only their small side.
2. ``count_ngrams`` joins the trusted ids (never the texts) to the chunks and
   sums raw counts of all trusted text by n-gram.
3. ``model`` derives continuation counts, per-order discounts and context
   weights as tables sharded by n-gram and by context.
4. ``requests`` holds the distinct n-grams of every chunk, one row per chunk
   and shard of n-grams, sorted and compressed (about 3 bytes an n-gram).
   ``probabilities`` takes those distinct over all chunks and their suffixes,
   and from one byte up joins each length with its counts and with the length
   below: p_m = alpha_m + gamma_m p_(m-1) (lengths of one and two bytes, at
   most 65,536 rows a fold by the alphabet, are broadcast).
   ``replies`` deals requests and probabilities out by shard; a task holds the
   probabilities of one shard and answers request after request. An answer is
   the probabilities alone: the chunk lists the same n-grams in the same order
   again.
5. There are two models: each is trained on the trusted documents of one fold
   (a checksum of the id) and scores the documents of the other, so that no
   document meets counts of its own.
6. Each document's log perplexity per byte, shrunk to its language's trusted
   mean by ``PRIOR`` bytes (short texts vary much), is compared with its
   language's ``QUANTILE`` of the trusted documents, found from a histogram
   with bins of ``BIN``; a language without trusted documents uses all trusted
   documents' values, and without any trusted document everything that has a
   word is kept.

Null and empty texts have no perplexity and are rejected. Null languages are
a language of their own. Repeated ids share trust and are scored one by one;
a null id is never trusted. Extra columns are ignored. Nothing is sampled: the
counts come from all trusted text.
"""

from __future__ import annotations

import io
import math
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from onoma.llm.common import materialize, remove, shared_path

ORDER = 5
CHUNK_BYTES = 5 << 20
CHUNK_ROWS = 50_000
LOT_WORDS = 20_000
QUANTILE = 0.995
PRIOR = 64
BIN = 0.001
BEGIN, END = 1, 2
#: Marks inside a text become another control character.
_MARKS = bytes(3 if c in (0, BEGIN, END) else c for c in range(256))
_BODY = (1 << 56) - 1


# ---- chunks ---------------------------------------------------------------

def pack(docs: DataFrame) -> DataFrame:
    """Bucketed table ``chunk, ids, langs, blob``; the blob is the rows of ``docs``, compressed."""
    schema = "chunk long, ids array<long>, langs array<string>, blob binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []

        def row() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part << 32 | seq], pa.int64()),
                    pa.array([table["doc_id"].to_pylist()], pa.list_(pa.int64())),
                    pa.array([table["lang"].to_pylist()], pa.list_(pa.string())),
                    pa.array([freeze(table)], pa.binary()),
                ],
                ["chunk", "ids", "langs", "blob"],
            )

        size = rows = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            size, rows = size + b.nbytes, rows + b.num_rows
            if size >= CHUNK_BYTES or rows >= CHUNK_ROWS:
                yield row()
                held.clear()
                size, rows, seq = 0, 0, seq + 1
        if held:
            yield row()

    spark = docs.sparkSession
    name = f"chunks_{uuid.uuid4().hex}"
    packed = docs.withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, schema)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed.write.format("parquet").option("path", shared_path(spark, "chunks")).option("compression", "none").bucketBy(buckets, "chunk").saveAsTable(name)
    return spark.table(name)


def freeze(table: pa.Table) -> bytes:
    import zstandard

    out = io.BytesIO()
    with pa.ipc.new_stream(out, table.schema) as w:
        w.write_table(table)
    return zstandard.ZstdCompressor(level=7).compress(out.getvalue())


def thaw(blob: bytes) -> pa.Table:
    import zstandard

    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob)).read_all()


def fold_of(doc_id: int | None) -> int:
    return zlib.crc32(str(doc_id).encode()) & 1


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_MARKS).split()


def pieces(distinct: list[bytes]) -> Iterator[list[bytes]]:
    """Words in lots of ``LOT_WORDS``: the arrays of a lot are a few MB."""
    for i in range(0, len(distinct), LOT_WORDS):
        yield distinct[i : i + LOT_WORDS]


def packed(values: np.ndarray) -> bytes:
    """An array, byte plane by byte plane, compressed: planes that hardly vary take hardly any room."""
    import zstandard

    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def unpacked(blob: bytes, dtype: type) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted n-grams as their differences."""
    return packed(np.diff(keys, prepend=np.int64(0)))


def unpack_keys(blob: bytes) -> np.ndarray:
    return np.cumsum(unpacked(blob, np.int64))


def ngrams(distinct: list[bytes], fold: int) -> tuple[np.ndarray, np.ndarray]:
    """(packed n-gram of the fold's model, index of its word) for every predicted byte."""
    joined = b"".join(b"\x01" + w + b"\x02" for w in distinct)
    b = np.frombuffer(joined, np.uint8).astype(np.int64)
    lengths = np.fromiter(map(len, distinct), np.int64, len(distinct)) + 2
    word = np.repeat(np.arange(len(distinct), dtype=np.int32), lengths)
    pos = np.arange(len(b)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    key = b.copy()
    for j in range(1, min(ORDER, len(b))):
        key[j:] |= b[:-j] << (8 * j)
    size = np.minimum(pos + 1, ORDER)
    masks = np.array([(1 << 8 * n) - 1 for n in range(ORDER + 1)])  # what reaches before the word goes
    key = key & masks[size] | (size | fold << 4) << 56
    predicted = pos > 0
    return key[predicted], word[predicted]


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their counts."""
    kinds, at = np.unique(keys, return_inverse=True)
    return kinds, np.bincount(at, counts, len(kinds)).astype(np.int64)


# ---- training -------------------------------------------------------------

def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of documents labelled as good text and never as toxic."""
    known = labels.filter(F.col("doc_id").isNotNull()).withColumn("id", F.col("doc_id").cast("long"))
    good = known.filter(F.col("quality") == 1).select("id").distinct()
    if "toxic" not in labels.columns:
        return good
    return good.join(known.filter(F.col("toxic") == 1), "id", "left_anti")


def count_ngrams(chunks: DataFrame, trusted: DataFrame) -> DataFrame:
    """``key, c``: raw counts over all trusted documents."""
    places = (
        chunks.select("chunk", F.posexplode("ids").alias("pos", "id")).filter(F.col("id").isNotNull())
        .join(trusted, "id").groupBy("chunk").agg(F.collect_list("pos").alias("places"))  # within one chunk
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rows = thaw(row["blob"]).select(["doc_id", "text"]).take(pa.array(row["places"]))
                by: tuple[Counter, Counter] = (Counter(), Counter())
                for i, t in zip(rows["doc_id"].to_pylist(), rows["text"].to_pylist()):
                    by[fold_of(i)].update(words(t))
                for fold, seen in enumerate(by):
                    if not seen:
                        continue
                    parts = []
                    for lot in pieces(list(seen)):
                        key, word = ngrams(lot, fold)
                        parts.append(summed(key, np.fromiter(map(seen.__getitem__, lot), np.int64, len(lot))[word]))
                    kinds, total = summed(*map(np.concatenate, zip(*parts)))
                    yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(total)], ["key", "c"])

    counted = chunks.select("chunk", "blob").join(places, "chunk").select("blob", "places").mapInArrow(run, "key long, c long")
    return counted.groupBy("key").agg(F.sum("c").alias("c"))


def _head(key: Column) -> Column:
    """Fold (bit 4) and length of a packed n-gram."""
    return F.shiftright(key, 56)


def _len(key: Column) -> Column:
    return _head(key).bitwiseAND(F.lit(15)).cast("int")


def suffix(key: Column, m: Column) -> Column:
    """Last m bytes of a packed n-gram."""
    mask = F.lit(0).cast("long")
    for n in range(ORDER, 0, -1):
        mask = F.when(m == n, F.lit((1 << 8 * n) - 1)).otherwise(mask)
    head = _head(key).bitwiseAND(F.lit(16)).bitwiseOR(m).cast("long")
    return F.shiftleft(head, 56).bitwiseOR(key.bitwiseAND(mask))


def context(key: Column) -> Column:
    """A packed n-gram without its last byte."""
    body = F.shiftright(key.bitwiseAND(F.lit(_BODY)), 8)
    return F.shiftleft(_head(key) - 1, 56).bitwiseOR(body)


def discounts(counts: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of n-grams seen 1 to 4 times."""
    n1, n2, n3, n4 = counts
    if not (n1 and n2 and n3):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.1), i - 0.1) for d, i in zip(raw, (1, 2, 3)))


def model(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``key, alpha``, ``ctx, gamma``) of every seen n-gram and context."""
    n = _len(F.col("key"))
    kinds = raw.select(F.col("key").alias("k"), F.explode(F.sequence(F.lit(1), n)).alias("m")).select(
        suffix(F.col("k"), F.col("m")).alias("key")
    ).distinct()
    longer = kinds.filter(n >= 2)
    lower = longer.groupBy(suffix(F.col("key"), n - 1).alias("key")).agg(F.count(F.lit(1)).alias("c"))
    counts = materialize(raw.unionByName(lower), "kn-counts")
    per = {
        r["n"]: [r["n1"], r["n2"], r["n3"], r["n4"]]
        for r in counts.groupBy(_head(F.col("key")).alias("n"))
        .agg(*[F.count(F.when(F.col("c") == i, 1)).alias(f"n{i}") for i in (1, 2, 3, 4)]).collect()  # one row per fold and order
    }
    d1, d2, d3 = (F.lit(x) for x in (0.5, 1.0, 1.5))
    for order, seen in per.items():
        got = discounts(seen)
        d1, d2, d3 = (F.when(_head(F.col("key")) == order, F.lit(g)).otherwise(d) for g, d in zip(got, (d1, d2, d3)))
    cut = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
    rows = counts.select("key", context(F.col("key")).alias("ctx"), "c", cut.alias("cut"))
    contexts = rows.groupBy("ctx").agg(F.sum("c").alias("total"), F.sum("cut").alias("freed"))
    alphas = rows.join(contexts, "ctx").select("key", ((F.col("c") - F.col("cut")) / F.col("total")).alias("alpha"))
    gammas = contexts.select("ctx", (F.col("freed") / F.col("total")).alias("gamma"))
    written = materialize(alphas, "kn-alpha"), materialize(gammas, "kn-gamma")
    remove(counts)
    return written


# ---- scoring --------------------------------------------------------------

def shard_count(spark: SparkSession) -> int:
    """A prime from ``spark.sql.shuffle.partitions`` on; 17 and 257 divide 256^k - 1 for small k and would deal by digit sums."""
    n = max(11, int(spark.conf.get("spark.sql.shuffle.partitions")))
    while n in (17, 257) or any(n % d == 0 for d in range(2, math.isqrt(n) + 1)):
        n += 1
    return n


def chunk_rows(blob: bytes) -> tuple[list[list[bytes]], list[int]]:
    """Words of every row of a chunk, and the fold of the model that scores it."""
    rows = thaw(blob).select(["doc_id", "text"])
    return [words(t) for t in rows["text"].to_pylist()], [1 - fold_of(i) for i in rows["doc_id"].to_pylist()]


def lots(split: list[list[bytes]], folds: list[int]) -> Iterator[tuple[int, list[bytes]]]:
    """(fold, words) of the distinct words of a chunk, in lots."""
    for fold in (0, 1):
        for lot in pieces(list(set(chain.from_iterable(ws for ws, f in zip(split, folds) if f == fold)))):
            yield fold, lot


def asked(grams: list[np.ndarray], shards: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct n-grams, sorted; their places by shard, then n-gram)."""
    keys = np.unique(np.concatenate([np.unique(g) for g in grams])) if grams else np.empty(0, np.int64)
    shard = keys % shards
    # numpy sorts 16-bit numbers by counting
    return keys, np.argsort(shard.astype(np.uint16) if shards < 1 << 16 else shard, kind="stable")


def by_shard(keys: np.ndarray, shard: np.ndarray) -> Iterator[tuple[int, slice]]:
    """(shard, places) of runs of equal shards."""
    cuts = np.flatnonzero(np.diff(shard)) + 1
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
        if lo < hi:
            yield int(shard[lo]), slice(lo, hi)


def requests(chunks: DataFrame, shards: int) -> DataFrame:
    """``shard, chunk, keys``: the distinct n-grams that each chunk's words ask for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, places = asked([ngrams(lot, fold)[0] for fold, lot in lots(*chunk_rows(row["blob"]))], shards)
                keys = keys[places]
                rows = [(k, row["chunk"], pack_keys(keys[at])) for k, at in by_shard(keys, keys % shards)]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary()))], ["shard", "chunk", "keys"]
                    )

    return chunks.select("chunk", "blob").mapInArrow(run, "shard int, chunk long, keys binary")


def distinct_keys(wanted: DataFrame, shards: int) -> DataFrame:
    """``key``: the n-grams that any chunk asks for; a task holds those of a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, fresh, size = np.empty(0, np.int64), [], 0
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                fresh.append(unpack_keys(blob))
                size += len(fresh[-1])
                if size > max(len(held), 1 << 18):
                    held, fresh, size = np.unique(np.concatenate([held, *fresh])), [], 0
        held = np.unique(np.concatenate([held, *fresh]))
        for i in range(0, len(held), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(held[i : i + (1 << 16)])], ["key"])

    return wanted.select("shard", "keys").repartitionById(shards, F.col("shard")).select("keys").mapInArrow(run, "key long")


def replies(wanted: DataFrame, logp: DataFrame, shards: int) -> DataFrame:
    """``chunk, shard, logps``: the answers to every row of ``wanted``, in the order of its n-grams."""

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, values = (np.asarray(c) for c in batch.columns)
            order = np.argsort(keys)
            order = order[np.argsort(keys[order] % shards, kind="stable")]
            keys, values = keys[order], values[order]
            for k, at in by_shard(keys, keys % shards):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k], pa.int32()), pa.array([-1], pa.int64()), pa.array([pack_keys(keys[at])]), pa.array([packed(values[at])])],
                    ["shard", "chunk", "keys", "logps"],
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts, keys, values = None, [], None, None
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if row["shard"] != shard:
                    shard, parts, keys = row["shard"], [], None
                if row["chunk"] < 0:
                    parts.append((unpack_keys(row["keys"]), unpacked(row["logps"], np.float32)))
                    continue
                if keys is None:
                    keys, values = map(np.concatenate, zip(*parts))
                    order = np.argsort(keys)
                    keys, values, parts = keys[order], values[order], []
                rows.append((row["chunk"], shard, packed(values[np.searchsorted(keys, unpack_keys(row["keys"]))])))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.binary()))], ["chunk", "shard", "logps"]
                )

    known = logp.select("key", "logp").mapInArrow(tables, "shard int, chunk long, keys binary, logps binary")
    dealt = known.unionByName(wanted.withColumn("logps", F.lit(None).cast("binary"))).repartitionById(shards, F.col("shard"))
    # the probabilities of a shard come before its requests
    return dealt.sortWithinPartitions("shard", "chunk").mapInArrow(run, "chunk long, shard int, logps binary")


def probabilities(keys: DataFrame, alphas: DataFrame, gammas: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(``key, logp``, tables it reads): natural log, for distinct ``key`` and all their suffixes."""
    n = _len(F.col("key"))
    known = materialize(keys, "kn-asked")
    grams = {ORDER: known.filter(n == ORDER)}
    for m in range(ORDER - 1, 0, -1):
        shorter = grams[m + 1].select(suffix(F.col("key"), F.lit(m)).alias("key"))
        grams[m] = materialize(known.filter(n == m).unionByName(shorter).distinct(), "kn-grams")
    levels: list[DataFrame] = []
    for m in range(1, ORDER + 1):
        small = F.broadcast if m <= 2 else (lambda df: df)  # at most 256 and 65,536 n-grams a fold, by the alphabet
        rows = (
            grams[m].withColumn("ctx", context(F.col("key")))
            .join(small(alphas.filter(n == m)), "key", "left")
            .join(small(gammas.filter(_len(F.col("ctx")) == m - 1)), "ctx", "left")
        )
        lower = F.lit(1.0 / 256)
        if levels:
            below = levels[-1].select(F.col("key").alias("shorter"), F.col("p").alias("lower"))
            rows = rows.withColumn("shorter", suffix(F.col("key"), F.lit(m - 1))).join(F.broadcast(below) if m <= 3 else below, "shorter")
            lower = F.col("lower")
        p = F.coalesce("alpha", F.lit(0.0)) + F.coalesce("gamma", F.lit(1.0)) * lower
        level = rows.select("key", p.alias("p"))
        levels.append(level if m == ORDER else materialize(level, "kn-levels"))
    logp = reduce(DataFrame.unionByName, levels).select("key", F.log("p").cast("float").alias("logp"))
    return logp, [known, *[grams[m] for m in range(1, ORDER)], *levels[:-1]]


def score_chunks(chunks: DataFrame, alphas: DataFrame, gammas: DataFrame) -> DataFrame:
    """``chunk, n, nll``: predicted bytes and their -log probability per row."""
    shards = shard_count(chunks.sparkSession)
    wanted = materialize(requests(chunks, shards), "kn-requests")
    logp, written = probabilities(distinct_keys(wanted, shards), alphas, gammas)
    answers = replies(wanted, logp, shards).groupBy("chunk").agg(
        F.collect_list(F.struct("shard", "logps")).alias("answers")  # what the chunk asked for
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                split, folds = chunk_rows(row["blob"])
                held = [(fold, lot, *ngrams(lot, fold)) for fold, lot in lots(split, folds)]  # 12 bytes a predicted byte
                keys, places = asked([key for _, _, key, _ in held], shards)
                logps = np.empty(len(keys))
                if len(keys):
                    got = sorted(row["answers"], key=lambda a: a["shard"])
                    logps[places] = np.concatenate([unpacked(a["logps"], np.float32) for a in got])
                of: tuple[dict[bytes, float], dict[bytes, float]] = ({}, {})
                for fold, lot, key, word in held:
                    lp = logps[np.searchsorted(keys, key)]
                    of[fold].update(zip(lot, np.bincount(word, -lp, len(lot)).tolist()))
                n = [sum(map(len, ws)) + len(ws) for ws in split]
                nll = [math.fsum(map(of[f].__getitem__, ws)) for ws, f in zip(split, folds)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["chunk"]], pa.int64()), pa.array([n], pa.list_(pa.int64())), pa.array([nll], pa.list_(pa.float64()))],
                    ["chunk", "n", "nll"],
                )

    scored = chunks.select("chunk", "blob").join(answers, "chunk", "left").mapInArrow(run, "chunk long, n array<long>, nll array<double>")
    done = materialize(scored, "kn-scores")
    for table in (wanted, *written):
        remove(table)
    return done


def trusted_levels(scores: DataFrame, trusted: DataFrame) -> DataFrame:
    """``lang, n, nll`` of the trusted documents that have a word."""
    return scores.filter(F.col("n") > 0).join(trusted, F.col("doc_id") == F.col("id"), "left_semi").select("lang", "n", "nll")


def means(levels: DataFrame) -> dict[str | None, tuple[int, float]]:
    """(bytes, -log probability) of the trusted documents by language."""
    rows = levels.groupBy("lang").agg(F.sum("n").alias("n"), F.round(F.sum(F.round("nll", 6).cast("decimal(38,6)")), 3).cast("double").alias("nll")).collect()
    return {r["lang"]: (r["n"], r["nll"]) for r in rows}  # one row per language


def thresholds(levels: DataFrame, quantile: float = QUANTILE) -> list:
    """Rows ``pooled, lang, limit`` of shrunk ``level`` from ``lang, level``; one per language and the pooled one."""
    bins = levels.groupBy("lang", F.floor(F.col("level") / BIN).alias("bin")).agg(F.count(F.lit(1)).alias("k"))
    both = bins.withColumn("pooled", F.lit(False)).unionByName(
        bins.groupBy("bin").agg(F.sum("k").alias("k")).withColumns({"lang": F.lit(None).cast("string"), "pooled": F.lit(True)})
    )
    w = Window.partitionBy("pooled", "lang")  # one row per bin, a few thousand
    below = F.sum("k").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    cut = both.withColumns({"below": below, "all": F.sum("k").over(w)}).filter(F.col("below") >= quantile * F.col("all"))
    return cut.groupBy("pooled", "lang").agg(((F.min("bin") + 1) * BIN).alias("limit")).collect()


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> tuple[DataFrame, DataFrame]:
    """(verdicts, chunks): verdicts are ``chunk, pos, doc_id, lang, n_tokens, perplexity, threshold, kept``."""
    spark = docs.sparkSession
    chunks = pack(docs)
    trusted = materialize(trusted_ids(labels), "kn-trusted")
    raw = materialize(count_ngrams(chunks, trusted), "kn-raw")
    alphas, gammas = model(raw)
    remove(raw)
    by_chunk = score_chunks(chunks, alphas, gammas).join(chunks.select("chunk", "ids", "langs"), "chunk")
    scores = by_chunk.select(
        "chunk", F.posexplode(F.arrays_zip(F.col("ids").alias("doc_id"), F.col("langs").alias("lang"), F.col("n"), F.col("nll"))).alias("pos", "r")
    ).select("chunk", "pos", "r.*")
    levels = materialize(trusted_levels(scores, trusted), "kn-trusted-levels")
    sums = means(levels)
    n, nll = (sum(x) for x in zip(*sums.values())) if sums else (0, 0.0)
    mean = {lang: b / a for lang, (a, b) in sums.items()}
    pooled = nll / n if n else None

    def level(df: DataFrame) -> DataFrame:
        small = spark.createDataFrame(list(mean.items()), "m_lang string, m_mean double")
        joined = df.join(F.broadcast(small), F.col("lang").eqNullSafe(F.col("m_lang")), "left")  # one row per language
        prior = F.coalesce("m_mean", F.lit(pooled).cast("double"))
        shrunk = F.when(F.col("n") > 0, F.coalesce((F.col("nll") + PRIOR * prior) / (F.col("n") + PRIOR), F.col("nll") / F.col("n")))
        return joined.withColumn("level", shrunk).drop("m_lang", "m_mean")

    limits = thresholds(level(levels), quantile)
    whole = next((r["limit"] for r in limits if r["pooled"]), None)
    small = spark.createDataFrame([(r["lang"], r["limit"]) for r in limits if not r["pooled"]], "t_lang string, t_limit double")
    verdicts = (
        level(scores).join(F.broadcast(small), F.col("lang").eqNullSafe(F.col("t_lang")), "left")  # one row per language
        .withColumn("limit", F.coalesce("t_limit", F.lit(whole).cast("double")))
        .select(
            "chunk", "pos", "doc_id", "lang", F.col("n").alias("n_tokens"),
            F.when(F.col("n") > 0, F.exp(F.col("nll") / F.col("n"))).alias("perplexity"),
            F.exp("level").alias("shrunk_perplexity"),
            F.exp("limit").alias("threshold"),
            ((F.col("n") > 0) & (F.col("limit").isNull() | (F.col("level") <= F.col("limit")))).alias("kept"),
        )
    )
    return verdicts, chunks


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, lang, n_tokens, perplexity, shrunk_perplexity, threshold, kept`` of every row."""
    verdicts, _ = classify(docs.select("doc_id", "text", "lang"), labels)
    return verdicts.drop("chunk", "pos")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The kept rows of ``docs`` (columns of documents)."""
    cols = ["doc_id", "text", "lang", "source", "n_chars"]
    verdicts, chunks = classify(docs.select(*cols), labels)
    good = verdicts.filter("kept").groupBy("chunk").agg(F.collect_list("pos").alias("places"))  # within one chunk

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from thaw(row["blob"]).take(pa.array(sorted(row["places"]))).to_batches(512)

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    return chunks.select("chunk", "blob").join(good, "chunk").select("blob", "places").mapInArrow(run, schema)
