"""Language identification by compression (operator 1).

``fit`` draws a bounded sample of labelled rows per language
(``SAMPLE_DOCS`` documents of lowest hash, one seeded piece of at most
``PIECE_CHARS`` of each) and makes a raw-content zstandard dictionary of at
most ``DICT_BYTES`` from it. ``predict`` encodes every text with every
dictionary, piece by piece over the whole text, and chooses the language with
the smallest sum; the margin over the second is the score, and a margin below
``MIN_MARGIN`` marks the row as rejected (the best guess stays, for callers
that must have one).

Only the text is an input of a prediction. Null texts and texts without a
letter are ``und`` with score 0, as is everything when no labelled text was
found. Ties go to the smaller language code. With one learned language the
score is 1. Repeated rows are judged one by one; extra columns are ignored.
The model holds one dictionary per language, so its size is bounded by
languages x ``DICT_BYTES``, whatever the size of the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from onoma.llm.common import map_rows

SAMPLE_DOCS = 128
PIECE_CHARS = 2000
DICT_BYTES = 112 * 1024
CHUNK_BYTES = 4 * 1024
LEVEL = 5
MIN_MARGIN = 0.02
UNKNOWN = "und"

_BLANKED = bytes(c if chr(c).isalpha() or c >= 128 else 32 for c in range(256))


def letters(text: str | None) -> bytes:
    """Lower-cased UTF-8 with ASCII non-letters blanked and blanks collapsed; empty without a letter."""
    if not text or not any(map(str.isalpha, text)):
        return b""
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_BLANKED).split())


def held_out(doc_id: Column) -> Column:
    """Fold of the contract: crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(rows: DataFrame) -> dict[str, bytes]:
    """One raw-content dictionary per language from ``doc_id, text, lang``.

    The top-k per language is trimmed inside each task before its shuffle, so
    a hot language sends at most ``SAMPLE_DOCS`` pieces per task.
    """
    h = F.xxhash64(F.col("doc_id").cast("string"))
    spare = F.greatest(F.length("text") - PIECE_CHARS, F.lit(0))
    begin = F.pmod(F.xxhash64(h), spare + 1)
    piece = F.col("text").substr((begin + 1).cast("int"), F.lit(PIECE_CHARS))
    rank = Window.partitionBy("lang").orderBy("h", "piece")
    sample = (
        rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("text").rlike(r"\p{L}"))
        .select("lang", h.alias("h"), piece.alias("piece"))
        .withColumn("rank", F.row_number().over(rank))
        .filter(F.col("rank") <= SAMPLE_DOCS)
        .orderBy("lang", "rank")
        .collect()  # at most SAMPLE_DOCS pieces per language
    )
    parts: dict[str, list[bytes]] = {}
    for r in sample:
        got = letters(r["piece"])
        if got and got not in parts.setdefault(r["lang"], []):
            parts[r["lang"]].append(got)
    return {lang: b" ".join(p)[:DICT_BYTES] for lang, p in sorted(parts.items()) if p}


class Encoder:
    """The dictionaries, digested once per worker."""

    def __init__(self, model: dict[str, bytes]):
        import zstandard

        self.langs = sorted(model)
        self.by = []
        for lang in self.langs:
            d = zstandard.ZstdCompressionDict(model[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.by.append(
                zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
            )

    def sizes(self, data: bytes) -> list[int]:
        pieces = [data[i : i + CHUNK_BYTES] for i in range(0, len(data), CHUNK_BYTES)]
        return [sum(len(c.compress(p)) for p in pieces) for c in self.by]

    def judge(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected)"""
        data = letters(text)
        if not data or not self.langs:
            return UNKNOWN, 0.0, True
        sizes = self.sizes(data)
        best = min(range(len(sizes)), key=sizes.__getitem__)
        rest = sizes[:best] + sizes[best + 1 :]
        score = 1.0 - sizes[best] / min(rest) if rest else 1.0
        return self.langs[best], score, score < MIN_MARGIN


def predict(docs: DataFrame, model: dict[str, bytes]) -> DataFrame:
    """``doc_id, lang_pred, score, rejected`` of every row of ``doc_id, text``."""
    kept: list[Encoder] = []

    def run(cols: dict[str, list]) -> dict[str, list]:
        if not kept:
            kept.append(Encoder(model))
        said = [kept[0].judge(t) for t in cols["text"]]
        return {
            "doc_id": cols["doc_id"],
            "lang_pred": [x[0] for x in said],
            "score": [x[1] for x in said],
            "rejected": [x[2] for x in said],
        }

    return map_rows(
        docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, lang_pred string, score double, rejected boolean"
    )
