"""Cross-tokenizer alignment against two pointers over byte offsets."""

from __future__ import annotations

import base64
import hashlib
import random
from collections import Counter

import pytest

from onoma.llm import align
from test_operators import EDGE


@pytest.fixture(scope="module")
def own():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(f"{align.TOKENIZERS}/byte_bpe_50k.json")
    a.encode_special_tokens = True
    with open(f"{align.TOKENIZERS}/byte_bpe_50k.tiktoken", "rb") as f:
        spelled = {int(i): base64.b64decode(t) for t, i in map(bytes.split, f)}
    b = sentencepiece.SentencePieceProcessor(model_file=f"{align.TOKENIZERS}/piece_bpe_32k.model")
    return a, spelled, b


def piece_bytes(b, i):
    return bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()


def brute(rows, own):
    a, spelled, b = own
    per, counts = [], Counter()
    for d, t in rows:
        ids, ids_b, groups = [], [], []
        if t:
            ids, ids_b = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
            raw, raw_b = [spelled[i] for i in ids], [piece_bytes(b, i) for i in ids_b]
            if b"".join(raw) != (" " + t).encode() or b"".join(raw_b) != (" " + t).encode():
                ids, ids_b = [], []
            i = j = at = at_b = 0
            left, right = [], []
            while i < len(ids) or j < len(ids_b):
                if at <= at_b:
                    at += len(raw[i])
                    left.append(ids[i])
                    i += 1
                else:
                    at_b += len(raw_b[j])
                    right.append(ids_b[j])
                    j += 1
                if at == at_b:
                    groups.append((left, right))
                    left, right = [], []
        per.append((d, len(ids), len(ids_b), groups))
        counts.update((x[-1], y[-1]) for x, y in groups)
    top = {}
    for (_, y), n in counts.items():
        top[y] = max(top.get(y, 0), n)
    out = []
    for d, n, m, groups in per:
        links = [(x[-1], y[-1]) for x, y in groups]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        out.append((d, n, m, len(groups), len(links), sum(counts[p] == top[p[1]] for p in links), sum(counts[p] for p in links), digest))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in align.align_tokenizers(df).collect()), key=str)


TEXTS = [
    "a plain line of words, and some more",
    " leads with a blank", "two  blanks and a\ttab\nline", "trailing blank ", "   ", " 　wide blanks",
    "<|endoftext|> and <s> </s> <unk> <0x41> are text", "naïve 你好 \U0001f600\U0001f468‍\U0001f469 ́x", "ﬁ ½ Ⅳ é",
    "▁real▁underscores", "x" * 3000, "word " * 500, "\x00\x01 control", "1234567890 12.5 https://example.com/?a=b",
]


def test_matches_brute_force(session, own, monkeypatch):
    """Blanks, other scripts, special tokens as text, one chunk per few rows."""
    monkeypatch.setattr(align, "CHUNK_BYTES", 300)
    monkeypatch.setattr(align, "LOT_BYTES", 40)
    rng = random.Random(1)
    rows = list(enumerate(TEXTS + ["".join(rng.choice(" abcé你<>|\n0") for _ in range(rng.randint(1, 60))) for _ in range(60)]))
    want = brute(rows, own)
    assert got(session.createDataFrame(rows, "doc_id long, text string").repartition(3)) == want
    assert any(r[1] for r in want) and any(not r[1] for r in want)


def test_ties_and_repeats(session, own):
    rows = [(1, "one two"), (1, "one two"), (2, "one three"), (None, "one three"), (3, "two one")]
    assert got(session.createDataFrame(rows, "doc_id long, text string")) == brute(rows, own)


def test_edges(session, own, odd, none):
    assert got(odd) == brute([(d, t) for d, t, *_ in EDGE], own)
    assert got(none) == []


def test_vocabularies_spell_the_same(own):
    a, b = align.tokenizers(align.TOKENIZERS)
    _, spelled, pieces = own
    assert all(a.vocabulary.tokens[i].as_py() == t for i, t in spelled.items())
    assert all(b.vocabulary.tokens[i].as_py() == piece_bytes(pieces, i) for i in range(3, pieces.get_piece_size()))
    assert min(a.vocabulary.lengths.to_pylist()) > 0 and min(b.vocabulary.lengths.to_pylist()) > 0


def test_segments_are_encoded_as_in_the_whole_text(own):
    """Blanks of all kinds between letters of all kinds, cut and uncut."""
    a, b = align.tokenizers(align.TOKENIZERS)
    assert a.cuts and b.cuts
    rng = random.Random(7)
    letters = ["a", "Z", "é", "7", "'s", "'", ".", "--", "\u0301", "\u00a0", "\u2003", "\x1c", "\x85", "你", "\U0001f600", "<s>", "▁", "ß", "×"]
    texts = ["".join(rng.choice(letters + [" "] * 8 + ["\n", "\t"]) for _ in range(rng.randint(1, 25))) for _ in range(3000)]
    for tok in (a, b):
        cut = align._encode(tok, *align.segments(texts, True))
        assert cut.to_pylist() == align._encode(tok, *align.segments(texts, False)).to_pylist()


def test_segment_sums():
    import pyarrow as pa

    assert align.segment_sums(pa.array([1, 2, 3, 4]), pa.array([0, 0, 3, 4, 4])).to_pylist() == [0, 6, 4, 0]
