"""Substring dedup by level-wise doubling (operator 13).

A window is a run of consecutive words of one document. Level by level the
windows of L words that occur twice or more in the corpus are found; a window
of 2L words is a candidate at the next level only where both its halves are
repeated. Levels go on past ``window`` until no candidate survives, which
gives each document the length of its longest repeated window (in steps of the
doubling). At the level of ``window`` words the first occurrence of each
repeated window is found too, and every word under a later one is removed.

Plan. Documents are packed into chunks of a few MB of text (words coded by a
chunk's own vocabulary) in a bucketed table, so that a level reads its chunks
without a shuffle. Per level each chunk sends its *distinct* window keys,
sorted and gap-coded, to key shards: a window that fills a third of the corpus
is one key per chunk. A shard answers one bit per key (held by another chunk),
and at the window level a second one (the first occurrence is yours). Keys
below that level are cut to a few bits more than the corpus has words: a
collision only lets a candidate through to the next level. Keys of the window
level have 96 bits, those above it 64. What a chunk knows between levels (surviving positions,
removed words) travels with its answers as bitmaps. Nothing is collected but
one count per level, which ends the loop.

Order of occurrences: doc_id (null last), then start. Rows with one id are
ordered by a hash of their text and, where that is equal too, by place, so
equal rows give the same set of results in any order. Null and blank texts
have no words, nothing removed and the hash of the empty string. Texts
shorter than a window keep all words. Extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from onoma.llm.common import ChunkTable, materialize, remove

WINDOW = 20
#: The first level is the window halved while it stays at or above this length.
LEAST_START = 5
CHUNK_BYTES = 4 << 20
CHUNK_ROWS = 20_000
#: Distinct keys a shard is planned for; the number of shards follows the corpus.
SHARD_KEYS = 4_000_000
#: Words of text turned into codes at a time.
SLICE_BYTES = 1 << 20

_ODD = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3],
    np.uint64,
)

ANSWERS = "chunk long, shard int, repeated long, bits binary, firsts binary, longest binary"


def levels(window: int) -> list[int]:
    """Window lengths from the first level to ``window``."""
    out = [window]
    while out[0] % 2 == 0 and out[0] // 2 >= LEAST_START:
        out.insert(0, out[0] // 2)
    return out


# ---- chunks ---------------------------------------------------------------

def _slices(raw: bytes) -> Iterator[bytes]:
    """Pieces of about ``SLICE_BYTES``, cut after a blank."""
    start = 0
    while start < len(raw):
        stop = start + SLICE_BYTES
        while stop < len(raw) and raw[stop - 1] not in b" \t\n\x0b\x0c\r":
            stop += 1
        yield raw[start:stop]
        start = stop


def _press(raw: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(raw)


def _release(blob: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(blob)


def _planes(a: np.ndarray) -> bytes:
    """Bytes of equal weight together, compressed."""
    return _press(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes())


def _unplaned(blob: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(_release(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def pack(docs: DataFrame, buckets: int) -> ChunkTable:
    """Chunks of ``docs`` (``doc_id, text``): ids, hashes and word counts of its rows, vocabulary, codes."""
    schema = "chunk long, ids array<long>, marks array<int>, counts array<int>, vocabulary binary, codes binary"
    lists = [pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()

        def row(seq: int, rows: list[tuple]) -> pa.RecordBatch:
            # a chunk's own order is the order of occurrences
            rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
            codes = Codes()
            got: list[np.ndarray] = []
            counts = []
            for _, _, raw in rows:
                n = 0
                for piece in _slices(raw):
                    words = piece.split()
                    got.append(np.fromiter(map(codes.__getitem__, words), np.uint32, len(words)))
                    n += len(words)
                counts.append(n)
            flat = np.concatenate(got) if got else np.empty(0, np.uint32)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part << 32 | seq], pa.int64()),
                    pa.array([[r[0] for r in rows]], lists[0]),
                    pa.array([[r[1] for r in rows]], lists[1]),
                    pa.array([counts], lists[2]),
                    pa.array([_press(b" ".join(codes))], pa.binary()),
                    pa.array([_planes(flat)], pa.binary()),
                ],
                ["chunk", "ids", "marks", "counts", "vocabulary", "codes"],
            )

        rows: list[tuple] = []
        size = seq = 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                raw = (t or "").encode("utf-8", "surrogatepass")
                rows.append((i, xxhash.xxh32_intdigest(raw) - (1 << 31), raw))
                size += len(raw)
                if size >= CHUNK_BYTES or len(rows) >= CHUNK_ROWS:
                    yield row(seq, rows)
                    rows, size, seq = [], 0, seq + 1
        if rows:
            yield row(seq, rows)

    return ChunkTable(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema), "chunk", buckets)


# ---- window keys ----------------------------------------------------------

def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _joined(h: np.ndarray, step: int, first: int, second: int) -> np.ndarray:
    """Hash of the window at each place and the one ``step`` places on (the last ``step`` places are void)."""
    out = np.zeros_like(h)
    if step < len(h):
        out[:-step] = _mix(h[:-step] * _ODD[first] + h[step:] * _ODD[second])
    return out


class Codes(dict):
    """Numbers words as they come."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


class Windows:
    """Hashes of the windows of some rows of a chunk, level by level; ``at``: their words' places in the chunk."""

    def __init__(self, vocabulary: bytes, codes: np.ndarray, counts: np.ndarray, live: np.ndarray, start: int):
        import xxhash

        self.at = np.flatnonzero(np.repeat(live, counts))
        codes, counts = codes[self.at], counts[live]
        words = vocabulary.split(b" ") if vocabulary else []
        used = np.zeros(len(words), bool)
        used[codes] = True
        known = np.zeros(len(words), np.uint64)
        known[used] = np.fromiter((xxhash.xxh3_64_intdigest(words[i]) for i in np.flatnonzero(used).tolist()), np.uint64, int(used.sum()))
        word = known[codes]
        self.ends = np.repeat(np.cumsum(counts), counts)
        self.length = start
        h = np.zeros(len(word), np.uint64)
        for k in range(min(start, len(word))):
            h[: len(word) - k] += _mix(word[k:] + _ODD[5:6] * np.uint64(k))
        self.h = _mix(h)
        self.low = np.empty(0, np.uint64)

    def to(self, length: int) -> "Windows":
        while self.length < length:
            # the second hash of the windows, independent of the first one's cut
            self.low = _joined(self.h, self.length, 3, 4)
            self.h = _joined(self.h, self.length, 0, 1)
            self.length *= 2
        return self

    def fits(self) -> np.ndarray:
        return np.arange(len(self.h)) + self.length <= self.ends

    def halves(self, flags: np.ndarray) -> np.ndarray:
        """Candidates of twice the length: places whose two halves are both flagged."""
        out = flags & (np.arange(len(self.h)) + 2 * self.length <= self.ends)
        out[: -self.length] &= flags[self.length :]
        out[-self.length :] = False
        return out


def _distinct(w: Windows, places: np.ndarray, bits: int | None) -> tuple[np.ndarray, ...]:
    """Distinct keys of the places in order: key, low half, first place, count, index of each place's key.

    ``bits``: keys are cut to them; None: whole keys of 96 bits.
    """
    h = w.h[places]
    if bits is None:
        low = (w.low if len(w.low) else _mix(w.h * _ODD[6]))[places] >> np.uint64(32)
    else:
        h, low = h >> np.uint64(64 - bits), np.zeros(len(h), np.uint64)
    order = _sorted(h, low)
    h, low = h[order], low[order]
    starts = np.flatnonzero(_new(h, low))
    counts = np.diff(np.r_[starts, len(h)])
    inverse = np.empty(len(h), np.int64)
    inverse[order] = np.repeat(np.arange(len(starts)), counts)
    return h[starts], low[starts], np.minimum.reduceat(places[order], starts), counts, inverse


def _new(h: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Where a sorted key differs from the one before."""
    out = np.ones(len(h), bool)
    out[1:] = (h[1:] != h[:-1]) | (low[1:] != low[:-1])
    return out


def _sorted(h: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Order of the keys; the low halves are compared only where high halves clash."""
    order = np.argsort(h)
    a, b = h[order], low[order]
    return np.lexsort((low, h)) if np.any((a[1:] == a[:-1]) & (b[1:] != b[:-1])) else order


def _bitmap(flags: np.ndarray) -> bytes:
    return _press(np.packbits(flags).tobytes())


def _flags(blob: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(_release(blob), np.uint8), count=n).astype(bool)


def _cover(places: np.ndarray, length: int, n: int) -> np.ndarray:
    steps = np.zeros(n + 1, np.int32)
    steps[places] += 1
    steps[places + length] -= 1
    return np.cumsum(steps[:-1]) > 0


class Level:
    """What one level needs to know: lengths, the cut of its keys and its shards."""

    def __init__(self, start: int, length: int, window: int, bits: int, shard_bits: int):
        self.start, self.length, self.window = start, length, window
        self.bits, self.shard_bits = bits, shard_bits

    def cut(self, length: int) -> int | None:
        """Bits of a key; None: all 96."""
        return None if length == self.window else self.bits if length < self.window else 64


def _state(row: dict, level: Level) -> tuple[Windows | None, np.ndarray, np.ndarray, np.ndarray]:
    """Windows, flags of the level before, removed words and longest repeat of each row, from the last answers."""
    counts = np.array(row["counts"], np.int64)
    codes = _unplaned(row["codes"], np.uint32)
    n = len(codes)
    before = level.length // 2
    told = {a["shard"]: a for a in row["answers"] or []}
    if level.length == level.start:
        w = Windows(_release(row["vocabulary"]), codes, counts, np.ones(len(counts), bool), level.start)
        return w, np.ones(n, bool), np.zeros(n, bool), np.zeros(len(counts), np.int32)
    known = next(a for s, a in told.items() if s < 0)
    removed = _flags(known["firsts"], n)
    longest = np.frombuffer(_release(known["longest"]), np.int32).copy()
    asked = _flags(known["bits"], n)
    if not asked.any():
        return None, asked, removed, longest
    row_of = np.repeat(np.arange(len(counts)), counts)
    live = np.zeros(len(counts), bool)
    live[row_of[asked]] = True
    w = Windows(_release(row["vocabulary"]), codes, counts, live, level.start).to(before)
    places = np.flatnonzero(asked[w.at])
    flags = np.zeros(len(w.at), bool)
    h, _, first, count, inverse = _distinct(w, places, level.cut(before))
    shards = (h >> np.uint64((level.cut(before) or 64) - level.shard_bits)).astype(np.int64)
    each = np.unique(shards, return_counts=True)
    elsewhere = np.concatenate([_flags(told[s]["bits"], k) for s, k in zip(each[0].tolist(), each[1].tolist())])
    flags[places] = (elsewhere | (count > 1))[inverse]
    if before == level.window:
        mine = np.concatenate([_flags(told[s]["firsts"], k) for s, k in zip(each[0].tolist(), each[1].tolist())])
        later = flags[places] & ~((first[inverse] == places) & mine[inverse])
        removed[w.at] = _cover(places[later], before, len(w.at))
    if before >= level.window:
        longest[row_of[w.at[flags]]] = before
    return w, flags, removed, longest


def _asked(row: dict, level: Level) -> Iterator[tuple]:
    """Messages of a chunk at a level, and its state (shard below 0)."""
    w, flags, removed, longest = _state(row, level)
    places = np.empty(0, np.int64)
    asked = np.zeros(len(removed), bool)
    if w is not None and flags.any():
        places = np.flatnonzero(w.fits() if level.length == level.start else w.halves(flags))
        w.to(level.length)
        asked[w.at[places]] = True
    chunk = row["chunk"]
    yield chunk, -1 - (chunk & 0xFF) - ((chunk >> 32) << 8 & 0xFFFF00), 0, _bitmap(asked), None, None, None, None, _bitmap(removed), _press(longest.tobytes())
    if not len(places):
        return
    whole = level.cut(level.length) is None
    h, low, first, count, _ = _distinct(w, places, level.cut(level.length))
    width = level.cut(level.length) or 64
    gap = np.uint32 if width - level.shard_bits <= 32 else np.uint64
    shards = h >> np.uint64(width - level.shard_bits)
    edges = np.flatnonzero(np.diff(shards)) + 1
    row_of = np.repeat(np.arange(len(row["counts"])), row["counts"])[w.at]
    for s, k, lo, f, c in zip(shards[np.r_[0, edges]].tolist(), np.split(h, edges), np.split(low, edges), np.split(first, edges), np.split(count, edges)):
        if whole:
            rows, at = np.unique(row_of[f], return_inverse=True)
            ids = [row["ids"][r] for r in rows.tolist()]
            marks = [row["marks"][r] for r in rows.tolist()]
            yield chunk, s, int((c > 1).sum()), k.tobytes() + lo.astype(np.uint32).tobytes(), at.astype(np.uint32).tobytes(), ids, marks, len(k), None, None
        else:
            gaps = np.diff(k & np.uint64((1 << (width - level.shard_bits)) - 1), prepend=np.uint64(0)).astype(gap)
            yield chunk, s, int((c > 1).sum()), _planes(gaps), None, None, None, len(k), None, None


_MESSAGE = "chunk long, shard int, multi long, keys binary, rows binary, ids array<long>, marks array<int>, n int, removed binary, longest binary"
_MESSAGE_TYPES = [
    pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int32(), pa.binary(), pa.binary()
]
_MESSAGE_NAMES = [c.split(" ")[0] for c in _MESSAGE.split(", ")]


def ask(chunks: DataFrame, level: Level) -> DataFrame:
    """Messages of all chunks (with the answers of the level before)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                cols = list(zip(*_asked(b.slice(i, 1).to_pylist()[0], level)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _MESSAGE_TYPES)], _MESSAGE_NAMES)

    return chunks.mapInArrow(run, _MESSAGE)


def answer(messages: DataFrame, level: Level) -> DataFrame:
    """Answers of every shard; states pass through."""
    width = level.cut(level.length)
    whole = width is None
    gap = np.uint32 if not whole and width - level.shard_bits <= 32 else np.uint64

    def merge(table: pa.Table) -> pa.Table:
        chunk, shard = table["chunk"].to_pylist(), table["shard"].to_pylist()
        if shard[0] < 0:
            return pa.table(
                {
                    "chunk": table["chunk"], "shard": table["shard"], "repeated": table["multi"],
                    "bits": table["keys"], "firsts": table["removed"], "longest": table["longest"],
                }
            )
        sizes = table["n"].to_pylist()
        ends = np.cumsum(sizes)[:-1]
        if whole:
            blobs = table["keys"].to_pylist()
            high = np.concatenate([np.frombuffer(x, np.uint64, n) for x, n in zip(blobs, sizes)])
            low = np.concatenate([np.frombuffer(x, np.uint32, n, 8 * n) for x, n in zip(blobs, sizes)])
            order = _sorted(high, low)
            group = np.empty(len(order), np.int64)
            group[order] = np.cumsum(_new(high[order], low[order])) - 1
        else:
            keys = np.concatenate([np.cumsum(_unplaned(x, gap), dtype=gap) for x in table["keys"].to_pylist()])
            _, group = np.unique(keys, return_inverse=True)
        held = np.bincount(group)
        elsewhere = held[group] > 1
        firsts: list[bytes | None] = [None] * len(chunk)
        if whole:
            ids, marks = table["ids"].to_pylist(), table["marks"].to_pylist()
            owners = [(i is None, i or 0, m, c, p) for c, a, b in zip(chunk, ids, marks) for p, (i, m) in enumerate(zip(a, b))]
            rank = np.empty(len(owners), np.int64)
            rank[np.array(sorted(range(len(owners)), key=owners.__getitem__), np.int64)] = np.arange(len(owners))
            base = np.cumsum([0, *map(len, ids)])
            place = np.concatenate([np.frombuffer(x, np.uint32).astype(np.int64) + o for x, o in zip(table["rows"].to_pylist(), base.tolist())])
            least = np.full(len(held), len(owners), np.int64)
            np.minimum.at(least, group, rank[place])
            firsts = [_bitmap(x) for x in np.split(rank[place] == least[group], ends)]
        multi = sum(table["multi"].to_pylist()) + int((held > 1).sum())
        return pa.table(
            {
                "chunk": table["chunk"],
                "shard": table["shard"],
                "repeated": pa.array([multi] + [0] * (len(chunk) - 1), pa.int64()),
                "bits": pa.array([_bitmap(x) for x in np.split(elsewhere, ends)], pa.binary()),
                "firsts": pa.array(firsts, pa.binary()),
                "longest": pa.nulls(len(chunk), pa.binary()),
            }
        )

    return messages.groupBy("shard").applyInArrow(merge, ANSWERS)


# ---- removal --------------------------------------------------------------

_RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, longest long"


def _finish(row: dict) -> Iterator[tuple]:
    counts = np.array(row["counts"], np.int64)
    codes = _unplaned(row["codes"], np.uint32)
    words = _release(row["vocabulary"]).split(b" ")
    known = next((a for a in row["answers"] or [] if a["shard"] < 0), None)
    removed = _flags(known["firsts"], len(codes))
    longest = np.frombuffer(_release(known["longest"]), np.int32)
    at = 0
    for i, n, far in zip(row["ids"], counts.tolist(), longest.tolist()):
        kept = codes[at : at + n][~removed[at : at + n]]
        digest = hashlib.sha256()
        for p in range(0, len(kept), 100_000):
            digest.update((b" " if p else b"") + b" ".join(map(words.__getitem__, kept[p : p + 100_000].tolist())))
        yield i, n, n - len(kept), digest.hexdigest(), far
        at += n


def dedup_substrings(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, longest`` of every row of ``doc_id, text``.

    ``longest``: the greatest of window, 2 * window, 4 * window ... at which the
    document has a repeated window (0: none).
    """
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // (64 * CHUNK_BYTES))
    about = max(size // 6, 1)  # words, nearly
    shard_bits = max((about // SHARD_KEYS).bit_length(), 4)
    bits = min(max(about.bit_length() + 8, shard_bits + 16), shard_bits + 32, 56)
    steps = levels(window)
    table = pack(docs, buckets)
    answers, length = None, steps[0]
    while True:
        level = Level(steps[0], length, window, bits, shard_bits)
        chunks = _with_answers(table.rows(), answers)
        new = materialize(answer(ask(chunks, level), level), "substring-answers")
        if answers is not None:
            remove(answers)
        answers = new
        if not answers.agg(F.sum("repeated")).first()[0]:
            break
        length *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split(" ")[0] for c in _RESULT.split(", ")]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
        for b in batches:
            for i in range(b.num_rows):
                cols = list(zip(*_finish(b.slice(i, 1).to_pylist()[0])))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    out = materialize(_with_answers(table.rows(), answers.filter("shard < 0")).mapInArrow(run, _RESULT), "substrings")
    table.drop()
    remove(answers)
    return out


def _with_answers(chunks: DataFrame, answers: DataFrame | None) -> DataFrame:
    kind = "array<struct<shard:int,bits:binary,firsts:binary,longest:binary>>"
    if answers is None:
        return chunks.withColumn("answers", F.lit(None).cast(kind))
    by_chunk = answers.groupBy("chunk").agg(F.collect_list(F.struct("shard", "bits", "firsts", "longest")).alias("answers"))
    return chunks.join(by_chunk, "chunk", "left")
