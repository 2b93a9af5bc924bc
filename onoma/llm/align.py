"""Cross-tokenizer alignment in Arrow (operator 11).

Each text is encoded by two tokenizers; both token rows spell the same bytes
(a space and the text), so byte offsets make them comparable. Two tokens are
linked where their byte ranges end together, and those common ends cut both
rows into groups.

A segment of a text (mostly a word) that stands at many places of a chunk is
encoded once. Arrow pipeline, over a few MB of text at a time: token ids are flattened with
the indices of their parents, byte lengths are summed cumulatively and each
text's start is taken off (segmented sums), and a hash join of both tables on
(parent, end) gives the links. ``Table.group_by`` counts the links of each id
pair; Spark adds up the partial counts, finds the highest count of each id of
the second tokenizer, and hands every chunk the counts of its own pairs, from
which the sums of its texts follow by segmented sums again.

Scale. A chunk keeps its links as codes into its own distinct pairs, in a
table bucketed by chunk that is not shuffled again. A pair crosses the network
once per chunk that holds it, however often it is linked there. The counts of
all pairs are joined, never broadcast by hand or collected.

Special tokens in a text are plain text. Texts that are null or empty, or that
a tokenizer doesn't give back byte for byte, have no tokens: zeros and an empty
``groups_sha256``. Repeated rows and ids count as often as they stand there,
null ids stay null. Ties for an id's highest count are all best. Extra columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from onoma.llm.common import ChunkTable, materialize, remove

#: Folder of the vocabulary files; the same on every executor.
TOKENIZERS = "/opt/tokenizers"
BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
CHUNK_BYTES = 4 << 20
CHUNK_ROWS = 4096
#: Text handed to a tokenizer at a time.
LOT_BYTES = 1 << 18
_CUT = re.compile("(?<=[!-~À-ɏ]) (?=[!-~À-ɏ])")


# ---- tokenizers -----------------------------------------------------------

def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones stand for
    themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


@dataclass(frozen=True)
class Vocabulary:
    """Bytes of every token id and their lengths."""

    tokens: pa.Array
    lengths: pa.Array

    @staticmethod
    def of(tokens: list[bytes]) -> "Vocabulary":
        a = pa.array(tokens, pa.binary())
        return Vocabulary(a, pc.cast(pc.binary_length(a), pa.int64()))


class ByteLevel:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tok = Tokenizer.from_file(path)
        self._tok.encode_special_tokens = True
        letters = _byte_letters()
        tokens = [b""] * self._tok.get_vocab_size()
        for token, i in self._tok.get_vocab().items():
            tokens[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.vocabulary = Vocabulary.of(tokens)
        # the split into words takes a blank with the word behind it
        self.cuts = type(self._tok.pre_tokenizer).__name__ == "ByteLevel"

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self._tok.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


class Pieces:
    def __init__(self, path: str):
        import sentencepiece

        self._tok = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(self._tok.get_piece_size())
        self.vocabulary = Vocabulary.of(
            [
                bytes([int(p[3:5], 16)]) if self._tok.is_byte(i) else p.replace("▁", " ").encode()
                for i, p in ((i, self._tok.id_to_piece(i)) for i in ids)
            ]
        )
        # no piece reaches over the end of a word
        self.cuts = not any(re.search("[^▁]▁", self._tok.id_to_piece(i)) for i in ids)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self._tok.encode(texts, num_threads=1)


@lru_cache(maxsize=2)
def tokenizers(folder: str) -> tuple[ByteLevel, Pieces]:
    return ByteLevel(f"{folder}/{BYTE_LEVEL}"), Pieces(f"{folder}/{PIECES}")


# ---- alignment of a chunk -------------------------------------------------

def segments(texts: list[str], cut: bool) -> tuple[list[str], pa.Array, pa.Array]:
    """(distinct segments, index of each segment of each text, offsets of the texts).

    A segment ends before a single blank between two visible letters: there
    every token of either tokenizer ends too, so a segment is encoded once for
    all its places (a blank in front of it is what both put before a text).
    """
    numbers: dict[str, int] = {}
    codes: list[int] = []
    offsets = [0]
    for t in texts:
        codes += [numbers.setdefault(s, len(numbers)) for s in (_CUT.split(t) if cut else [t])]
        offsets.append(len(codes))
    return list(numbers), pa.array(codes, pa.int64()), pa.array(offsets, pa.int64())


def _encode(tok: ByteLevel | Pieces, distinct: list[str], codes: pa.Array, offsets: pa.Array) -> pa.ListArray:
    """Token ids of each text from those of its segments."""
    parts, lot, size = [], [], 0
    for i, t in enumerate(distinct):
        lot.append(t)
        size += len(t)
        if size >= LOT_BYTES or i == len(distinct) - 1:
            parts.append(pa.array(tok.encode(lot), pa.list_(pa.int32())))
            lot, size = [], 0
    ids = pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))
    placed = ids.take(codes)
    return pa.ListArray.from_arrays(placed.offsets.take(offsets), placed.values)


def _spelled(ids: pa.ListArray, vocabulary: Vocabulary) -> pa.Array:
    """Bytes of each row of tokens."""
    return pc.binary_join(pa.ListArray.from_arrays(ids.offsets, vocabulary.tokens.take(ids.values)), b"")


def segment_sums(values: pa.Array, offsets: pa.Array) -> pa.Array:
    """Sum of each segment of ``values`` between neighbouring offsets."""
    sums = pa.concat_arrays([pa.array([0], pa.int64()), pc.cumulative_sum(pc.cast(values, pa.int64()))])
    at = sums.take(offsets)
    return pc.subtract(at[1:], at[:-1])


def token_ends(ids: pa.ListArray, vocabulary: Vocabulary, name: str) -> pa.Table:
    """``parent, end`` and the token's id and place for every token of every row."""
    flat = pc.list_flatten(ids)
    parent = pc.list_parent_indices(ids)
    sums = pc.cumulative_sum(vocabulary.lengths.take(flat))
    before = pa.concat_arrays([pa.array([0], pa.int64()), sums]).take(ids.offsets[:-1])
    return pa.table({"parent": parent, "end": pc.subtract(sums, before.take(parent)), name: flat, f"{name}_at": pa.array(np.arange(len(flat)))})


def _id_runs(ids: pa.Array, last: pa.Array) -> pa.Array:
    """Comma-joined ids of each group; ``last``: the place of its last token."""
    offsets = pa.concat_arrays([pa.array([0], pa.int32()), pc.cast(pc.add(last, 1), pa.int32())])
    return pc.binary_join(pa.ListArray.from_arrays(offsets, pc.cast(ids, pa.string())), ",")


def align(texts: list[str | None], a: ByteLevel, b: Pieces) -> tuple[pa.Table, pa.Table]:
    """(``n_a, n_b, n_groups, groups_sha256`` of each text, links ``parent, a, b`` in order)."""
    n = len(texts)
    whole = [i for i, t in enumerate(texts) if t]
    rows = [texts[i] for i in whole]
    parts = segments(rows, a.cuts and b.cuts)
    ids_a, ids_b = _encode(a, *parts), _encode(b, *parts)
    wanted = pa.array([b" " + t.encode() for t in rows], pa.binary())
    same = pc.and_(pc.equal(_spelled(ids_a, a.vocabulary), wanted), pc.equal(_spelled(ids_b, b.vocabulary), wanted))
    ids_a, ids_b = ids_a.filter(same), ids_b.filter(same)
    at = pa.array(whole, pa.int64()).filter(same)
    table_a, table_b = token_ends(ids_a, a.vocabulary, "a"), token_ends(ids_b, b.vocabulary, "b")
    links = table_a.join(table_b, ["parent", "end"], join_type="inner", use_threads=False).sort_by("a_at").combine_chunks()
    counts = np.zeros((3, n), np.int64)
    places = at.to_numpy()
    counts[0, places], counts[1, places] = pc.list_value_length(ids_a).to_numpy(), pc.list_value_length(ids_b).to_numpy()
    digests = [""] * n
    if len(links):
        # every token has a length, so each common end is one link and one group
        parent = links["parent"].combine_chunks()
        per = np.bincount(parent.to_numpy(), minlength=len(at))
        counts[2, places] = per
        groups = pc.binary_join_element_wise(
            _id_runs(pc.list_flatten(ids_a), links["a_at"].combine_chunks()),
            _id_runs(pc.list_flatten(ids_b), links["b_at"].combine_chunks()),
            "|",
        )
        edges = pa.array(np.r_[0, np.cumsum(per)], pa.int32())
        spelled = pc.binary_join(pa.ListArray.from_arrays(edges, groups), ";")
        for i, s in zip(places.tolist(), spelled):
            digests[i] = hashlib.sha256(s.as_py().encode()).hexdigest()
    per_text = pa.table({"n_a": counts[0], "n_b": counts[1], "n_groups": counts[2], "groups_sha256": digests})
    return per_text, pa.table({"parent": at.take(links["parent"].combine_chunks()), "a": links["a"], "b": links["b"]})


# ---- corpus ---------------------------------------------------------------

_CHUNK = (
    "chunk long, ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, groups_sha256 array<string>,"
    " codes binary, a array<int>, b array<int>, k array<long>"
)
_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _press(a: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), 4).T).tobytes())


def _release(blob: bytes) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view(np.uint32).ravel()


def _chunk_row(chunk: int, ids: list, texts: list, a: ByteLevel, b: Pieces) -> pa.RecordBatch:
    per_text, links = align(texts, a, b)
    pairs = links.group_by(["a", "b"], use_threads=False).aggregate([("parent", "count")]).combine_chunks()
    coded = pairs.append_column("code", pa.array(np.arange(len(pairs), dtype=np.uint32)))
    numbered = links.append_column("at", pa.array(np.arange(len(links))))
    codes = numbered.join(coded, ["a", "b"], join_type="inner", use_threads=False).sort_by("at")["code"]
    lists = [per_text[c].to_pylist() for c in ("n_a", "n_b", "n_groups", "groups_sha256")]
    cols = [[chunk], [ids], *([x] for x in lists), [_press(codes.to_numpy())]]
    cols += [[pairs[c].to_numpy()] for c in ("a", "b", "parent_count")]
    kinds = [pa.int64(), pa.list_(pa.int64()), *[pa.list_(pa.int64())] * 3, pa.list_(pa.string()), pa.binary()]
    kinds += [pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], [c.split(" ")[0] for c in _CHUNK.split(", ")])


def aligned_chunks(docs: DataFrame, folder: str) -> ChunkTable:
    """Aligned texts of ``doc_id, text`` by chunk, with the chunk's distinct pairs and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        a, b = tokenizers(folder)
        part, seq, size = TaskContext.get().partitionId(), 0, 0
        ids: list[int | None] = []
        texts: list[str | None] = []
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(i)
                texts.append(t)
                size += len(t or "")
                if size >= CHUNK_BYTES or len(ids) >= CHUNK_ROWS:
                    yield _chunk_row(part << 32 | seq, ids, texts, a, b)
                    ids, texts, size, seq = [], [], 0, seq + 1
        if ids:
            yield _chunk_row(part << 32 | seq, ids, texts, a, b)

    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // (64 * CHUNK_BYTES))
    return ChunkTable(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _CHUNK), "chunk", buckets)


def pair_counts(chunks: DataFrame) -> DataFrame:
    """``a, b, count, best``: links of every id pair over all chunks, and whether no other pair of ``b`` has more."""
    partial = chunks.select(F.inline(F.arrays_zip("a", "b", "k")))
    counts = materialize(partial.groupBy("a", "b").agg(F.sum("k").alias("count")), "pair-counts")
    top = counts.groupBy("b").agg(F.max("count").alias("top"))
    return counts.join(top, "b").select("a", "b", "count", (F.col("count") == F.col("top")).alias("best"))


def _finish(chunk: pa.Table, told: pa.Table) -> pa.Table:
    row = chunk.to_pylist()[0]
    codes = pa.array(_release(row["codes"]))
    told = told.sort_by("code")  # one row for every code
    edges = pa.array(np.r_[0, np.cumsum(np.array(row["n_groups"], np.int64))])
    return pa.table(
        {
            "doc_id": pa.array(row["ids"], pa.int64()),
            "n_a": pa.array(row["n_a"], pa.int64()),
            "n_b": pa.array(row["n_b"], pa.int64()),
            "n_groups": pa.array(row["n_groups"], pa.int64()),
            "n_links": pa.array(row["n_groups"], pa.int64()),
            "n_best": segment_sums(told["best"].combine_chunks().take(codes), edges),
            "count_sum": segment_sums(told["count"].combine_chunks().take(codes), edges),
            "groups_sha256": pa.array(row["groups_sha256"], pa.string()),
        }
    )


def align_tokenizers(docs: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row of ``doc_id, text``."""
    table = aligned_chunks(docs, folder)
    counts = materialize(pair_counts(table.rows()), "pair-best")
    asked = table.rows().select("chunk", F.posexplode(F.arrays_zip("a", "b")).alias("code", "pair")).select("chunk", "code", "pair.a", "pair.b")
    told = asked.join(counts, ["a", "b"]).select(F.col("chunk").alias("of"), "code", "count", "best")
    rows = table.rows().select("chunk", "ids", "n_a", "n_b", "n_groups", "groups_sha256", "codes")
    out = rows.groupBy("chunk").cogroup(told.groupBy("of")).applyInArrow(_finish, _RESULT)
    out = materialize(out, "aligned")
    table.drop()
    remove(counts)
    return out
