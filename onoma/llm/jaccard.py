"""N-gram Jaccard join with token-combination prefixes (operator 8).

Documents are sets of distinct 5-word shingles; two link when their Jaccard
similarity is at least 4/5. Equal sets are one node (copies never pair up).

Frequencies. ``token_classes`` counts every shingle over all documents in
hash shards (compressed sorted runs, exact counts) and keeps two bitmaps of
fixed size: shingles held by two documents or more, and by ``FREQUENT`` or
more. A bitmap collision only moves a shingle to a more frequent class, the
same for every document, so results do not depend on it. The global order is
(unique, rare, frequent), then hash.

Prefixes. A set of n shingles may miss t = n - ceil(4n/5) of them, so of its
first t+1 tokens at least one is shared. Single tokens are indexed for the
rare classes (a unique token needs no entry). Frequent tokens are split into
M classes by hash and indexed as pairs within a class: the prefix is extended
until sum(n_rare) + sum over classes of (n_c - 1) reaches t+1; then a linked
set shares a rare token or two tokens of one class. M grows with the size
band (so that the pairs stay linear in n); linked sets are in one band or at
an edge, where the larger also enters the lower band. Sets of at most 50 use
single tokens only.

Verification. Sharing a signature makes a candidate. ``link`` first verifies
each node of a bucket against the bucket's hub, the set with the largest
shared part (hub rounds), then every pair of a bucket that still lies in
different components, so no link between components is lost and groups of
copies cost one check per member and hub, not one per pair. Those last pairs
must first pass a parity bitmap: sets that link differ in at most a ninth of
their sizes' sum, and the bits in which the bitmaps differ never exceed the
tokens in which the sets differ. Checks compare the whole shingle sets.
Components come from large-star/small-star rounds over written tables.

Null texts and texts without words have an empty set, no links and their own
id as component. Texts of fewer than five words have their whole word
sequence as one shingle. Repeated rows are copies. A null doc_id never names
a component that has another id, but its text links like any other. Extra
columns are ignored. ``keep_one`` goes by text, so unlike texts under one id or
under no id all stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from onoma.llm.common import WORD, materialize

SHINGLE = 5
#: Documents that share a token before it counts as frequent.
FREQUENT = 24
#: Bitmap positions: 2 x 16 MB, whatever the corpus.
BITS = 27
#: Upper edges of the size bands: 40, then times 4.
FIRST_EDGE, EDGE_RATIO = 40, 4
HUB_ROUNDS = 2
FLUSH_TOKENS = 2_000_000
DOCS_PER_SHARD = 8192

_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class WordHash(dict):
    """64-bit hashes of words, kept while there are few."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 100_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, hashes: WordHash) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    u = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    if len(u) < SHINGLE:
        whole = np.array([len(u)], np.uint64)
        for x in u:
            whole = _mix(whole * _MULT[0] + x)
        return whole
    h = np.zeros(len(u) - SHINGLE + 1, np.uint64)
    for k in range(SHINGLE):
        h += u[k : k + len(h)] * _MULT[k]
    return np.unique(_mix(h))


def fingerprint(tokens: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


# ---- token classes --------------------------------------------------------

def _pack_run(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted distinct uint32 keys and their counts, compressed."""
    import zstandard

    gaps = np.diff(keys, prepend=np.uint32(0)).astype(np.uint32)
    planes = gaps.view(np.uint8).reshape(-1, 4).T
    more = np.minimum(counts, 255).astype(np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes() + more.tobytes())


def _unpack_run(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    n = len(raw) // 5
    gaps = np.ascontiguousarray(raw[: 4 * n].reshape(4, n).T).view(np.uint32).ravel()
    return np.cumsum(gaps, dtype=np.uint32), raw[4 * n :].astype(np.int64)


def token_runs(docs: DataFrame, shard_bits: int) -> DataFrame:
    """``shard, run``: sorted shingle keys of the distinct sets of a task, by shard."""
    down = np.uint64(64 - shard_bits - 32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHash(), set()
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(held) >> down, return_counts=True)
            edges = np.searchsorted(keys, np.arange(1, 1 << shard_bits, dtype=np.uint64) << np.uint64(32))
            shards, runs = [], []
            for s, (k, c) in enumerate(zip(np.split(keys, edges), np.split(counts, edges))):
                if len(k):
                    shards.append(s)
                    runs.append(_pack_run((k & np.uint64(0xFFFFFFFF)).astype(np.uint32), c))
            return pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(runs, pa.binary())], ["shard", "run"])

        size = 0
        for b in batches:
            for text in b.column(0).to_pylist():
                tokens = shingles(text, hashes)
                fp = fingerprint(tokens)
                if not len(tokens) or fp in seen:
                    continue
                if len(seen) < 100_000:  # only saves work: copies count once per task
                    seen.add(fp)
                held.append(tokens)
                size += len(tokens)
                if size >= FLUSH_TOKENS:
                    yield flush()
                    held.clear()
                    size = 0
        if held:
            yield flush()

    return docs.select("text").mapInArrow(run, "shard int, run binary")


def token_classes(docs: DataFrame) -> tuple[bytes, bytes]:
    """Bitmaps of the shingles of two or more, and of ``FREQUENT`` or more documents."""
    import zstandard

    shard_bits = min(max((docs.count() // DOCS_PER_SHARD).bit_length(), 4), BITS - 3)
    width = 1 << (BITS - shard_bits)

    def merge(table: pa.Table) -> pa.Table:
        runs = [_unpack_run(r) for r in table["run"].to_pylist()]
        # a key counts at least k when it stands k times in a row once sorted
        keys = np.concatenate([np.repeat(k, np.minimum(c, FREQUENT)) for k, c in runs])
        keys.sort()
        maps = []
        for least in (2, FREQUENT):
            first = keys[: max(len(keys) - least + 1, 0)]
            bits = np.zeros(width, np.uint8)
            bits[first[first == keys[least - 1 :]] >> np.uint32(32 - (BITS - shard_bits))] = 1
            maps.append(zstandard.ZstdCompressor().compress(np.packbits(bits).tobytes()))
        return pa.table({"shard": table["shard"][:1], "multi": [maps[0]], "frequent": [maps[1]]})

    rows = (
        token_runs(docs, shard_bits).groupBy("shard").applyInArrow(merge, "shard int, multi binary, frequent binary")
        .collect()  # 2 x 16 MB of bits before compression, whatever the corpus
    )
    out = []
    for name in ("multi", "frequent"):
        whole = bytearray(1 << (BITS - 3))
        for r in rows:
            piece = zstandard.ZstdDecompressor().decompress(r[name])
            whole[r["shard"] * width // 8 : (r["shard"] + 1) * width // 8] = piece
        out.append(bytes(whole))
    return out[0], out[1]


# ---- signatures -----------------------------------------------------------

def _bands(n: int) -> list[tuple[int, int]]:
    """(band, lower edge) of a set of n tokens: its own and, near its lower edge, the one below."""
    band, low = 0, 0
    high = FIRST_EDGE
    while n > high:
        band, low, high = band + 1, high, high * EDGE_RATIO
    out = [(band, low)]
    if band and 4 * n <= 5 * low:
        out.append((band - 1, low // EDGE_RATIO if band > 1 else 0))
    return out


def parity(tokens: np.ndarray, band: int) -> np.ndarray:
    """Bitmap of a band's width: the parity of the tokens that fall on each bit."""
    width = 128 * EDGE_RATIO**band
    bits = np.bincount((tokens % np.uint64(width)).astype(np.int64), minlength=width) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def signatures(tokens: np.ndarray, multi: np.ndarray, frequent: np.ndarray) -> dict[int, np.ndarray]:
    """Index entries of a set by band (sorted hashes; flags of its tokens)."""
    n = len(tokens)
    need = n - (4 * n + 4) // 5 + 1
    kind = np.where(frequent, 2, np.where(multi, 1, 0))
    by_band = {}
    for band, low in _bands(n):
        out = []
        salt = np.array([2 * band], np.uint64)
        order = np.lexsort((tokens, kind))
        t, k = tokens[order], kind[order]
        singles = n if band == 0 else int((k < 2).sum())
        prefix = min(singles, need)
        out.append(_mix(t[:prefix][k[:prefix] > 0] + salt * _MULT[1]))
        if prefix < need:
            classes = (t[singles:] >> np.uint64(7)) % np.uint64(3 * low // 4)
            # entries gained by each further token: none for the first of its class
            first = np.zeros(len(classes), bool)
            first[np.unique(classes, return_index=True)[1]] = True
            gained = np.cumsum(~first)
            end = int(np.searchsorted(gained, need - prefix)) + 1
            rest, cls = t[singles : singles + end], classes[:end]
            by = np.argsort(cls, kind="stable")
            rest, cls = rest[by], cls[by]
            step = 1
            while step < len(rest):
                same = cls[step:] == cls[:-step]
                if not same.any():
                    break
                a, b = rest[:-step][same], rest[step:][same]
                out.append(_mix(_mix(a) * _MULT[2] + b + (salt + np.uint64(1)) * _MULT[3]))
                step += 1
        by_band[band] = np.unique(np.concatenate(out))
    return by_band


def _flags(bitmap: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    at = (tokens >> np.uint64(64 - BITS)).astype(np.int64)
    return (bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0


def sketch(docs: DataFrame, classes: tuple[bytes, bytes]) -> DataFrame:
    """``doc_id, mark, n, fp, lists, body``: text hash, size, set fingerprint, entries and bitmap by band, compressed text.

    ``lists`` and ``body`` are there only for documents with entries, which
    alone can link, and for the first copies of a set that a task meets.
    """
    maps = docs.sparkSession.sparkContext.broadcast(classes)  # two bitmaps of fixed size
    schema = "doc_id long, mark long, n long, fp long, lists array<struct<band:int,sigs:array<long>,bits:array<long>>>, body binary"
    lists = pa.list_(pa.struct([("band", pa.int32()), ("sigs", pa.list_(pa.int64())), ("bits", pa.list_(pa.int64()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        multi, frequent = (np.frombuffer(m, np.uint8) for m in maps.value)
        hashes, press, seen = WordHash(), zstandard.ZstdCompressor(level=3), set()
        for b in batches:
            rows: tuple[list, ...] = ([], [], [], [])
            for text in b.column(1).to_pylist():
                tokens = shingles(text, hashes)
                fp = fingerprint(tokens) if len(tokens) else None
                got = {}
                if fp is not None and fp not in seen:
                    got = signatures(tokens, _flags(multi, tokens), _flags(frequent, tokens))
                    if len(seen) < 100_000:  # only saves work: copies become one node later
                        seen.add(fp)
                got = [{"band": k, "sigs": v.view(np.int64), "bits": parity(tokens, k)} for k, v in got.items() if len(v)]
                rows[0].append(len(tokens))
                rows[1].append(fp)
                rows[2].append(got)
                rows[3].append(press.compress(text.encode("utf-8", "surrogatepass")) if got else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], lists), pa.array(rows[3], pa.binary())],
                ["doc_id", "mark", "n", "fp", "lists", "body"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("mark")).mapInArrow(run, schema)


# ---- links ----------------------------------------------------------------

def verify(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """The rows of ``a, b`` whose sets link; ``bodies`` has ``fp, body``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        hashes, press = WordHash(), zstandard.ZstdDecompressor()
        last: tuple[int | None, np.ndarray] = (None, np.empty(0, np.uint64))

        def tokens(body: bytes) -> np.ndarray:
            return shingles(press.decompress(body).decode("utf-8", "surrogatepass"), hashes)

        for batch in batches:
            keep = []
            for a, x, y in zip(batch["a"].to_pylist(), batch["body_a"].to_pylist(), batch["body_b"].to_pylist()):
                if last[0] != a:
                    last = (a, tokens(x))
                other = tokens(y)
                both = len(np.intersect1d(last[1], other, assume_unique=True))
                keep.append(100 * both >= 80 * (len(last[1]) + len(other) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    rows = (
        pairs.join(bodies.select(F.col("fp").alias("b"), F.col("body").alias("body_b")), "b")
        .join(bodies.select(F.col("fp").alias("a"), F.col("body").alias("body_a")), "a")
        .select("a", "b", "body_a", "body_b")
    )
    return rows.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """``node, comp`` (smallest node of the component) of every node of ``a, b``."""
    e = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "cc-edges")
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v"))
        )
        new = materialize(small.distinct(), "cc-edges")
        # stable when every node hangs on one node, and that one on none
        chained = new.join(new.select(F.col("u").alias("v")).distinct(), "v", "left_semi").select("u")
        torn = new.groupBy("u").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("u")
        if not chained.unionByName(torn).take(1):
            break
        e = new
    roots = new.select(F.col("v").alias("node")).distinct().withColumn("comp", F.col("node"))
    return new.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(roots)


def _comparable(m: str, n: str):
    return (5 * F.col(m) >= 4 * F.col(n)) & (5 * F.col(n) >= 4 * F.col(m))


def link(sketches: DataFrame) -> DataFrame:
    """``fp, comp`` of the nodes that link with another; see the module's text."""
    spark = sketches.sparkSession
    # a set is one node whatever its rows' ids; tasks have dropped most copies already
    nodes = materialize(sketches.filter(F.size("lists") > 0).select("fp", "n", "lists", "body").dropDuplicates(["fp"]), "nodes")
    listed = nodes.select("fp", "n", F.inline("lists"))
    entries = listed.select("fp", "n", "band", F.explode("sigs").alias("sig"))
    shared = entries.groupBy("sig").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("sig")
    entries = materialize(entries.join(shared, "sig"), "entries")
    # A set whose prefix is all shared is what the others were copied from, or the nearest to it.
    weights = entries.groupBy("fp", "n").agg((F.count(F.lit(1)) / F.col("n")).alias("weight")).drop("n")
    entries = materialize(entries.join(weights, "fp"), "entries")
    bodies = nodes.select("fp", "body")
    edges = spark.createDataFrame([], "a long, b long")
    comps = spark.createDataFrame([], "node long, comp long")
    done = edges
    for turn in range(HUB_ROUNDS + 1):
        open_ = entries.join(comps, entries["fp"] == comps["node"], "left").select(
            "sig", "band", "fp", "n", "weight", F.coalesce("comp", "fp").alias("comp")
        )
        span = open_.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo != hi").select("sig")
        open_ = open_.join(span, "sig")
        if turn < HUB_ROUNDS:
            best = F.max(F.struct("weight", "n", "fp", "comp")).alias("hub")
            hubs = open_.groupBy("sig").agg(best)
            for _ in range(turn):
                # the next hub of a bucket lies outside the component of the one before
                rest = open_.join(hubs, "sig").filter(F.col("comp") != F.col("hub.comp"))
                hubs = rest.drop("hub").groupBy("sig").agg(best)
            pairs = open_.join(hubs, "sig").filter(F.col("comp") != F.col("hub.comp")).select(
                F.col("hub.fp").alias("a"), F.col("fp").alias("b"), F.col("hub.n").alias("m"), "n"
            )
        else:
            bits = listed.select("fp", "band", "bits").join(open_.select("fp", "band").distinct(), ["fp", "band"])
            y = open_.join(bits, ["fp", "band"]).select("sig", "fp", "n", "comp", "bits")
            x = y.select("sig", F.col("fp").alias("a"), F.col("n").alias("m"), F.col("comp").alias("c"), F.col("bits").alias("bits_a"))
            differ = F.aggregate(
                F.zip_with("bits_a", "bits", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda t, k: t + k
            )
            near = (F.col("a") < F.col("fp")) & (F.col("c") != F.col("comp")) & _comparable("m", "n") & (9 * differ <= F.col("m") + F.col("n"))
            pairs = x.withColumnRenamed("sig", "sig_a").join(y, (F.col("sig_a") == F.col("sig")) & near).select(
                "a", F.col("fp").alias("b"), "m", "n"
            )
        pairs = pairs.filter(_comparable("m", "n")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = materialize(pairs.join(done, ["a", "b"], "left_anti"), "pairs")
        if not pairs.take(1):
            if turn < HUB_ROUNDS:
                continue
            break
        edges = materialize(edges.unionByName(verify(pairs, bodies)), "edges")
        done = done.unionByName(pairs)
        comps = components(edges)
    return comps.select(F.col("node").alias("fp"), "comp")


def grouped_rows(docs: DataFrame) -> DataFrame:
    """``doc_id, mark, n, comp`` of every row: hash of its text, set size and component (null without words)."""
    sketches = materialize(sketch(docs, token_classes(docs)), "sketches")
    comps = link(sketches)
    rows = sketches.select("doc_id", "mark", "n", "fp").join(comps, "fp", "left")
    return rows.select("doc_id", "mark", "n", F.coalesce("comp", "fp").alias("comp"))


def similarity_groups(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``doc_id, text``."""
    rows = grouped_rows(docs)
    least = rows.filter(F.col("comp").isNotNull()).groupBy("comp").agg(F.min("doc_id").alias("least"))
    return rows.join(least, "comp", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id")
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group: that of the smallest id (null last; equal ids: by text hash). Rows without words stay."""
    rows = grouped_rows(docs).filter(F.col("comp").isNotNull())
    first = rows.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark")).alias("row"))
    first = first.select(F.col("row.doc_id").alias("kept_id"), F.col("row.mark").alias("kept_mark"))
    marked = docs.withColumn("_mark", F.xxhash64("text"))
    same = marked["doc_id"].eqNullSafe(first["kept_id"]) & (marked["_mark"] == first["kept_mark"])
    one = marked.join(first, same, "left_semi").dropDuplicates(["doc_id", "_mark"])
    blank = marked.filter(~F.coalesce(F.col("text").rlike(WORD), F.lit(False)))
    return one.unionByName(blank).drop("_mark")
