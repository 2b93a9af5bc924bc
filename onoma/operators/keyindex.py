"""Stored index of a name table (C1), written once and opened by every match.

Equal keys are one entry with a member count. Entries are sorted by length and
cut into lots of keys of similar length; a lot is one row that holds

* the keys, their member counts and the ranges of their lengths;
* per key the number of letters of each class (the blank is one, another code
  point falls into one of 31), and their maxima over the lot;
* posting lists of its tokens and of its character n-grams, as differences,
  which compress better.

Postings are thus split by key, not by gram: a gram that stands in most keys is
spread over all lots, and a task that reads a lot can count candidates, bound
and score them without meeting another one. ``grams`` is the dictionary of all
grams with the number of records that hold them.

An index lives under a versioned root (``sources.versions``): building a new
one never disturbs a reader.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from onoma.operators.candidates import DEFAULT_NGRAM
from onoma.session import shuffles_dropped
from onoma.sources import versions

LOT_KEYS = 8192
LOT_CHARS = 1 << 19
#: Lots of a file: a task holds few of them at a time.
FILE_LOTS = 16
CLASSES = 32
#: Ends of the bands of a lot's keys by joined length, in 64ths.
BANDS = (1, 4, 12, 24, 44, 64)
#: A match of a large table meets the lots in waves: of 64 lots one, seven and the others.
WAVE_LOTS, WAVE_ENDS = 64, (1, 8)
#: The keys of a large table are shuffled in passes over the written records, of so many records each at least; and their most.
PASS_RECORDS, PASSES = 5_000_000, 4
#: How the tables are written: sorted strings and ids as differences, then compressed.
STORED = {"compression": "zstd", "parquet.writer.version": "v2"}

_SCHEMA = (
    "n int, shortest int, longest int, least_tokens int, keys array<string>, members array<long>, wide boolean, counts binary,"
    " tokens array<string>, token_sizes array<int>, token_rows binary, grams array<string>, gram_sizes array<int>, gram_rows binary"
)
_KINDS = [
    pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.bool_(), pa.binary(),
    pa.list_(pa.string()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.binary(),
]
_NAMES = [c.split()[0] for c in _SCHEMA.split(", ")]


def key_grams(key: str, n: int) -> set[str]:
    if len(key) <= n:
        return {key} if key else set()
    return {key[i : i + n] for i in range(len(key) - n + 1)}


def key_tokens(key: str) -> set[str]:
    return set(key.split(" ")) - {""}


def joined_length(tokens: set[str]) -> int:
    return sum(map(len, tokens)) + max(len(tokens) - 1, 0)


def _codes(keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all keys, lengths of the keys)."""
    codes = np.frombuffer("".join(keys).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return codes, np.fromiter(map(len, keys), np.int64, len(keys))


def letter_counts(keys: list[str]) -> np.ndarray:
    """(class, key) counts of letters."""
    return _letter_counts(*_codes(keys))


def _letter_counts(codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    n = len(lengths)
    codes = np.where(codes == 32, 0, 1 + codes % (CLASSES - 1))
    return np.bincount(codes * n + np.repeat(np.arange(n), lengths), minlength=CLASSES * n).reshape(CLASSES, n).astype(np.int32)


def packed(rows: np.ndarray) -> bytes:
    """Keys of posting lists as differences, the low bytes of all of them first."""
    steps = np.diff(rows.astype("<u2"), prepend=np.zeros(1, "<u2"))
    return steps.view(np.uint8).reshape(-1, 2).T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(2, -1).T).view("<u2").ravel()
    return np.cumsum(steps, dtype=np.uint16)  # differences wrap around, and so do their sums


def _postings(number: np.ndarray, rows: np.ndarray, n_keys: int) -> tuple[np.ndarray, np.ndarray, bytes]:
    """(numbers that occur, sizes of their lists, packed keys of the lists), each key once in a list."""
    both = np.sort(number * n_keys + rows)
    both = both[np.r_[True, both[1:] != both[:-1]]] if len(both) else both
    number = both // n_keys
    last = np.flatnonzero(np.r_[number[1:] != number[:-1], True]) if len(both) else np.zeros(0, np.int64)
    return number[last], np.diff(last, prepend=-1).astype(np.int32), packed(both % n_keys)


def _token_postings(keys: pa.Array) -> tuple[pa.Array, np.ndarray, bytes]:
    lists = pc.split_pattern(keys, " ")
    rows, words = pc.list_parent_indices(lists).to_numpy(), lists.flatten()
    kept = pc.not_equal(words, "")
    rows, words = rows[kept.to_numpy(zero_copy_only=False)], words.filter(kept).dictionary_encode()
    order = pc.array_sort_indices(words.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    _, sizes, posted = _postings(rank[words.indices.to_numpy()], rows, len(keys))
    return words.dictionary.take(pa.array(order)), sizes, posted


def _gram_postings(keys: list[str], codes: np.ndarray, lengths: np.ndarray, n: int) -> tuple[pa.Array, np.ndarray, bytes]:
    letters = np.flatnonzero(np.bincount(codes)) if len(codes) else codes
    base = len(letters) + 1
    if base**n * len(keys) >= 1 << 63:  # grams too many to be numbered
        lists = defaultdict(list)
        for i, key in enumerate(keys):
            for g in key_grams(key, n):
                lists[g].append(i)
        names = sorted(lists)
        sizes = np.array([len(lists[g]) for g in names], np.int32)
        return pa.array(names, pa.string()), sizes, packed(np.fromiter((i for g in names for i in lists[g]), np.uint16))
    numbers = np.zeros(int(letters.max(initial=0)) + 1, np.int64)
    numbers[letters] = np.arange(1, base)
    # a key shorter than a gram is padded by zeros behind it
    padded = np.zeros(len(codes) + n, np.int64)
    padded[: len(codes)] = numbers[codes]
    rows, ends = np.repeat(np.arange(len(keys)), lengths), np.cumsum(lengths)
    left = ends[rows] - np.arange(len(codes))
    first = np.flatnonzero((left >= n) | (left == lengths[rows]))
    number = np.zeros(len(first), np.int64)
    for i in range(n):
        number = number * base + np.where(left[first] > i, padded[first + i], 0)
    number, sizes, posted = _postings(number, rows[first], len(keys))
    places = [number // base**i % base for i in reversed(range(n))]
    letters = np.r_[0, letters].astype(np.uint32)
    grams = np.ascontiguousarray(np.stack([letters[x] for x in places], axis=1))
    return pa.array(grams.view(f"U{n}").ravel().tolist() if len(grams) else [], pa.string()), sizes, posted


def lot_row(keys: list[str] | pa.Array, members: list[int] | pa.Array, n: int) -> tuple:
    keys = keys if isinstance(keys, pa.Array) else pa.array(keys, pa.string())
    texts = keys.to_pylist()
    codes, lengths = _codes(texts)
    tokens, grams = _token_postings(keys), _gram_postings(texts, codes, lengths, n)
    own = unpacked(tokens[2]).astype(np.int64)
    sizes = np.repeat(pc.utf8_length(tokens[0]).to_numpy(zero_copy_only=False), tokens[1])
    count = np.bincount(own, minlength=len(keys))
    least = int((np.bincount(own, sizes, len(keys)) + np.maximum(count - 1, 0)).min())
    counts = _letter_counts(codes, lengths)
    wide = bool(counts.max(initial=0) > 255)
    counts = counts if wide else counts.astype(np.uint8)
    return len(keys), int(lengths.min()), int(lengths.max()), least, keys, members, wide, counts.tobytes(), *tokens, *grams


class Lot:
    """One row of the index in a task; lists may come as Arrow arrays."""

    def __init__(self, row: dict):
        self.n, self.shortest, self.longest, self.least_tokens = row["n"], row["shortest"], row["longest"], row["least_tokens"]
        self.key_names, self.token_names, self.gram_names = (
            row[x] if isinstance(row[x], pa.Array) else pa.array(row[x], pa.string()) for x in ("keys", "tokens", "grams")
        )
        self.members = np.array(row["members"], np.int64)
        self.counts = np.frombuffer(row["counts"], np.int32 if row["wide"] else np.uint8).reshape(CLASSES, self.n)
        self.most = self.counts.max(axis=1)
        self._letters: dict[tuple[bytes, bool], np.ndarray] = {}
        self.token_ends, self.gram_ends = (np.r_[0, np.cumsum(np.array(row[x], np.int64))] for x in ("token_sizes", "gram_sizes"))
        self.token_rows, self.gram_rows = (unpacked(row[x]).astype(np.int64) for x in ("token_rows", "gram_rows"))
        self.n_grams = len(self.gram_names)
        self.most_tokens = int(self.n_tokens.max())

    def gram_keys(self, i: int) -> np.ndarray:
        return self.gram_rows[self.gram_ends[i] : self.gram_ends[i + 1]]

    def gram_bits(self, width: int) -> np.ndarray:
        """(gram, 64 keys a word) bitmap of the postings, ``width`` bytes a gram."""
        bits = np.zeros(self.n_grams * width, np.uint8)
        gram = np.repeat(np.arange(self.n_grams), np.diff(self.gram_ends))
        np.bitwise_or.at(bits, gram * width + (self.gram_rows >> 3), np.left_shift(1, self.gram_rows & 7).astype(np.uint8))
        return bits.view(np.uint64).reshape(self.n_grams, width // 8)

    @cached_property
    def keys(self) -> list[str]:
        return self.key_names.to_pylist()

    @cached_property
    def joined(self) -> np.ndarray:
        """Length of each key's distinct tokens joined by blanks."""
        return self.token_chars + np.maximum(self.n_tokens - 1, 0)

    @cached_property
    def lengths(self) -> np.ndarray:
        return pc.utf8_length(self.key_names).to_numpy(zero_copy_only=False).astype(np.int32)

    @cached_property
    def n_tokens(self) -> np.ndarray:
        return np.bincount(self.token_rows, minlength=self.n).astype(np.int32)

    @cached_property
    def token_chars(self) -> np.ndarray:
        sizes = np.repeat(pc.utf8_length(self.token_names).to_numpy(zero_copy_only=False), np.diff(self.token_ends))
        return np.bincount(self.token_rows, sizes, self.n).astype(np.int32)

    @cached_property
    def singles(self) -> np.ndarray:
        """Lengths, joined lengths, blanks and blanks between the distinct tokens."""
        return np.array([self.lengths, self.joined, self.counts[0], np.maximum(self.n_tokens - 1, 0)], np.float32)

    @cached_property
    def _token_sets(self) -> dict[int, set[str]]:
        return {}

    def key_tokens(self, i: int) -> set[str]:
        if i not in self._token_sets:
            self._token_sets[i] = key_tokens(self.keys[i])
        return self._token_sets[i]

    @cached_property
    def bands(self) -> tuple[np.ndarray, np.ndarray]:
        """(keys by joined length, ends of bands of them): a few keys of repeated tokens don't loosen the bounds of the others."""
        order = np.argsort(self.joined, kind="stable")
        ends = np.unique([max(1, self.n * x // 64) for x in BANDS])
        return order, ends

    def letters(self, alphabet: np.ndarray, by_token: bool) -> np.ndarray:
        """Place by place each key's code point, as its number in ``alphabet`` from 1 (0: another one, or none).

        ``by_token`` takes the distinct tokens in order, joined by blanks.
        """
        at = alphabet.tobytes(), by_token
        if at not in self._letters:
            self._letters[at] = self._token_columns(alphabet) if by_token else _columns(self.keys, alphabet)
        return self._letters[at]

    def _token_columns(self, alphabet: np.ndarray) -> np.ndarray:
        order = np.argsort(self.token_rows, kind="stable")
        key, token = self.token_rows[order], np.repeat(np.arange(len(self.token_names)), np.diff(self.token_ends))[order]
        names = self.token_names.to_pylist()
        lengths = np.fromiter(map(len, names), np.int64, len(names))
        sizes = lengths[token]
        ends = np.cumsum(sizes + 1)
        start = ends - sizes - 1
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        start -= np.repeat(start[first], np.diff(np.r_[first, len(key)]))
        numbers = _numbers("".join(names), alphabet)
        out = np.zeros((max(1, int(self.joined.max(initial=0))), self.n), numbers.dtype)
        out[spread(start, sizes), np.repeat(key, sizes)] = numbers[spread((np.cumsum(lengths) - lengths)[token], sizes)]
        later = np.flatnonzero(start)
        out[start[later] - 1, key[later]] = _numbers(" ", alphabet)[0]
        return out


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def _numbers(text: str, alphabet: np.ndarray) -> np.ndarray:
    """Numbers of code points in ``alphabet`` from 1; 0 for another one."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    numbers = np.zeros(int(alphabet.max(initial=0)) + 2, np.uint16 if len(alphabet) > 255 else np.uint8)
    numbers[alphabet] = np.arange(1, len(alphabet) + 1)
    return numbers[np.minimum(codes, len(numbers) - 1)]


def _columns(texts: list[str], alphabet: np.ndarray) -> np.ndarray:
    """(place, text) numbers of code points in ``alphabet`` from 1; 0 for another one, or none."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    numbers = _numbers("".join(texts), alphabet)
    out = np.zeros((max(1, int(lengths.max(initial=0))), len(texts)), numbers.dtype)
    out[spread(np.zeros(len(texts), np.int64), lengths), np.repeat(np.arange(len(texts)), lengths)] = numbers
    return out


@dataclass
class KeyIndex:
    """An opened version of the index."""

    path: str
    ngram_n: int
    records: DataFrame
    lots: DataFrame
    grams: DataFrame
    n_records: int


def _lot_end(keys: pa.ChunkedArray) -> int:
    """How many of these keys, shorter ones first, are one lot: letters are laid out as keys x longest key."""
    lengths = pc.utf8_length(keys.slice(0, LOT_KEYS)).to_numpy().astype(np.int64)
    over = (lengths * np.arange(1, len(lengths) + 1) > LOT_CHARS) | (4 * lengths > 5 * lengths[0] + 40)
    over[0] = False
    return int(over.argmax()) if over.any() else len(lengths)


def _lots(keys: DataFrame, n: int) -> DataFrame:
    """Rows of the index from sorted ``key, members``."""

    def cell(value, kind: pa.DataType) -> pa.Array:
        if not pa.types.is_list(kind):
            return pa.array([value], kind)
        values = value if isinstance(value, pa.Array) else pa.array(value, kind.value_type)
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

    def lot(held: pa.Table) -> pa.RecordBatch:
        own, members = (c.combine_chunks() for c in held.columns)
        return pa.RecordBatch.from_arrays([cell(v, k) for v, k in zip(lot_row(own, members, n), _KINDS)], _NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            b = pa.Table.from_arrays([b.column(0).cast(pa.string()), b.column(1).cast(pa.int64())], ["key", "members"])
            held = b if held is None else pa.concat_tables([held, b])
            while held.num_rows > LOT_KEYS:
                end = _lot_end(held.column(0))
                yield lot(held.slice(0, end))
                held = held.slice(end)
        while held is not None and held.num_rows:
            end = _lot_end(held.column(0))
            yield lot(held.slice(0, end))
            held = held.slice(end)

    return keys.mapInArrow(run, _SCHEMA)


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, records of the lot that hold it): a posting list is never empty."""
    for b in batches:
        for members, grams, sizes, rows in zip(*b.columns):
            members, sizes = members.values.to_numpy(), sizes.values.to_numpy().astype(np.int64)
            starts = np.cumsum(sizes) - sizes
            held = members[unpacked(rows.as_py())]
            counts = np.add.reduceat(held, starts) if len(starts) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([grams.values, pa.array(counts, pa.int64())], ["gram", "n_ids"])


def build_index(names: DataFrame, root: str, ngram_n: int = DEFAULT_NGRAM) -> KeyIndex:
    """Write records, lots and the gram dictionary of standardised ``names`` as a new version below ``root``.

    Duplicate record ids raise and leave the current version as it is. Records
    without a key stay records but can't be found.
    """
    spark = names.sparkSession

    def write(path: str) -> None:
        names.select("id", "full_name", "normalized_name").write.options(**STORED).parquet(f"{path}/records")
        records = spark.read.parquet(f"{path}/records")
        if not records.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
            raise ValueError("duplicate record ids")
        # a small table is dealt over all cores; of a larger one Spark's partitions of keys are many enough
        n_records, parts = records.count(), 2 * spark.sparkContext.defaultParallelism
        passes = max(1, min(PASSES, n_records // PASS_RECORDS))
        for i in range(passes):
            own = records.filter(F.col("normalized_name").isNotNull())
            if passes > 1:
                own = own.filter(F.pmod(F.xxhash64("normalized_name", F.lit(passes)), F.lit(passes)) == i)
            keys = own.groupBy(F.col("normalized_name").alias("key")).agg(F.count(F.lit(1)).alias("members")).withColumn("size", F.length("key"))
            if n_records < parts * FILE_LOTS * LOT_KEYS:
                keys = keys.repartition(parts, "key")
            # a task's keys are an even share of all lengths, so that files of lots cost the same
            lots = _lots(keys.sortWithinPartitions("size", "key").select("key", "members"), ngram_n)
            lots = lots.withColumn("wave", F.pmod(F.xxhash64(F.element_at("keys", 1)), F.lit(WAVE_LOTS)))
            lots = lots.withColumn("wave", sum((F.col("wave") >= end).cast("int") for end in WAVE_ENDS))
            lots.write.mode("append").options(**STORED).option("maxRecordsPerFile", FILE_LOTS).partitionBy("wave").parquet(f"{path}/lots")
        grams = spark.read.parquet(f"{path}/lots").select("members", "grams", "gram_sizes", "gram_rows").mapInArrow(_gram_counts, "gram string, n_ids long")
        grams.groupBy("gram").agg(F.sum("n_ids").alias("n_ids")).write.parquet(f"{path}/grams")
        spark.createDataFrame([(ngram_n, n_records)], "ngram_n int, n_records long").write.parquet(f"{path}/about")

    with shuffles_dropped(spark):
        path = versions.publish(spark, root, write)
    return open_version(spark, path)


def open_version(spark: SparkSession, path: str) -> KeyIndex:
    about = spark.read.parquet(f"{path}/about").first()
    records, lots, grams = (spark.read.parquet(f"{path}/{t}") for t in ("records", "lots", "grams"))
    return KeyIndex(path, about["ngram_n"], records, lots, grams, about["n_records"])


def open_index(spark: SparkSession, root: str) -> KeyIndex | None:
    """The current version, or None where none was built in the present layout."""
    path = versions.current(spark, root)
    index = None if path is None else open_version(spark, path)
    return index if index and set(_NAMES) <= set(index.lots.columns) else None
