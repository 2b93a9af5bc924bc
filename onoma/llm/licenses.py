"""License scan with a positional rare-token index (operator 4).

Templates are short licence notices. Document frequencies of their words over
all documents give IDFs; the ``RARE_WORDS`` highest-IDF words of each template
go, with their positions, into the index. A file looks up every index word it
holds (at most templates x ``RARE_WORDS``); each occurrence votes for
(template, file position - template position), so words that stand to each
other as in the template meet on one offset (insertions of up to ``SLACK``
words allowed). Templates whose key phrases have a word the file lacks cannot
be verified and take no votes.
A template whose voted IDF reaches ``MIN_COVER`` of its index words' IDF is a
candidate, and it is reported when all its mandatory key phrases stand, word
for word, around that offset.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. The
base phrases are counted at every place. Null text is empty: no words, no
labels, score 0. Repeated rows are judged one by one; extra columns are
ignored. Templates and IDFs are a few hundred values, whatever the corpus.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from onoma.llm.common import map_rows

# Base phrases and labels of the contract.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# Public licence notices (label, notice, mandatory phrases).
TEMPLATES = (
    ("gpl-3.0", "licensed under the GNU General Public License, version 3", ("gnu general public license", "version 3")),
    ("gpl-2.0", "licensed under the GNU General Public License, version 2", ("gnu general public license", "version 2")),
    ("gpl-3.0", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", ("gnu general public license", "version 3")),
    ("gpl-2.0", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License", ("gnu general public license", "version 2")),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ("gnu lesser general public license",)),
    ("agpl-3.0", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3", ("gnu affero general public license",)),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license", "version 2 0")),
    ("mit", "Released under the MIT License", ("mit license",)),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted", "free of charge")),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license", "2 0")),
    ("cc-by-4.0", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ("cc by sa 4 0",)),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    ("cc-by-4.0", "licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0",)),
    ("cc0-1.0", "dedicated to the public domain under CC0 1.0 Universal", ("cc0 1 0",)),
    ("unlicense", "This is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)

RARE_WORDS = 6
SLACK = 3
MIN_COVER = 0.5

_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


@dataclass(frozen=True)
class Index:
    """``postings``: word -> (template, position); ``weight``: template -> IDF of its index words."""

    idf: dict[bytes, float]
    postings: dict[bytes, tuple[tuple[int, int], ...]]
    weight: tuple[float, ...]
    phrases: tuple[tuple[tuple[bytes, ...], ...], ...]
    lengths: tuple[int, ...]
    labels: tuple[str, ...]


def document_frequencies(docs: DataFrame, templates=TEMPLATES) -> tuple[dict[bytes, int], int]:
    """Documents holding each template word, and all documents: over every row."""
    vocabulary = frozenset(w for _, notice, _ in templates for w in words(notice))

    def run(cols: dict[str, list]) -> dict[str, list]:
        seen: Counter = Counter()
        for text in cols["text"]:
            seen.update(vocabulary.intersection(words(text)))
        return {"word": [None, *(w.decode() for w in seen)], "n": [len(cols["text"]), *seen.values()]}

    rows = map_rows(docs.select("text"), run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    got = {r["word"]: r["n"] for r in rows}  # one row per template word
    return {w: got.get(w.decode(), 0) for w in vocabulary}, got.get(None, 0)


def build_index(df: dict[bytes, int], n_docs: int, templates=TEMPLATES) -> Index:
    idf = {w: math.log((n_docs + 1) / (n + 1)) + 1.0 for w, n in df.items()}
    postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
    weight, phrases, lengths, labels = [], [], [], []
    for t, (label, notice, keys) in enumerate(templates):
        at = words(notice)
        rare = sorted(set(at), key=lambda w: (-idf[w], w))[:RARE_WORDS]
        for w in rare:
            postings[w] += [(t, i) for i, x in enumerate(at) if x == w]
        weight.append(sum(idf[w] for w in rare))
        phrases.append(tuple(tuple(words(k)) for k in keys))
        lengths.append(len(at))
        labels.append(label)
    return Index(idf, {w: tuple(p) for w, p in postings.items()}, tuple(weight), tuple(phrases), tuple(lengths), tuple(labels))


def _stands(got: list[bytes], phrase: tuple[bytes, ...], begin: int, end: int) -> bool:
    k = len(phrase)
    return any(got[i] == phrase[0] and tuple(got[i : i + k]) == phrase for i in range(max(begin, 0), min(end, len(got) - k + 1)))


def match_templates(index: Index, got: list[bytes], held: set[bytes]) -> list[tuple[str, int, float]]:
    """(label, offset, coverage) of every verified template, best offsets first."""
    live = {t for t, phrases in enumerate(index.phrases) if all(map(held.issuperset, phrases))}
    if not live:
        return []
    postings = {w: tuple(x for x in index.postings[w] if x[0] in live) for w in held & index.postings.keys()}
    votes: dict[int, list[tuple[int, bytes]]] = defaultdict(list)
    for i, w in enumerate(got):
        for t, q in postings.get(w, ()):
            votes[t].append((i - q, w))
    out = []
    for t, cast in votes.items():
        cast.sort()
        low, best = 0, None
        tally: Counter = Counter()
        voted = 0.0
        for offset, w in cast:  # offsets within SLACK of each other meet
            tally[w] += 1
            voted += index.idf[w] if tally[w] == 1 else 0.0
            while cast[low][0] < offset - SLACK:
                old = cast[low][1]
                tally[old] -= 1
                voted -= index.idf[old] if not tally[old] else 0.0
                low += 1
            cover = voted / index.weight[t]
            if cover < MIN_COVER or best and cover <= best[2]:
                continue
            begin, end = cast[low][0] - SLACK, offset + index.lengths[t] + SLACK
            if all(_stands(got, p, begin, end) for p in index.phrases[t]):
                best = (index.labels[t], offset, min(cover, 1.0))
        if best:
            out.append(best)
    return sorted(out, key=lambda x: (-x[2], x[0], x[1]))


def base_places(got: list[bytes], held: set[bytes]) -> list[tuple[int, str]]:
    """(start word, label) of every place of a base phrase."""
    firsts = {p.split()[0]: (tuple(p.split()), label) for p, label in ((p.encode(), label) for p, label in BASE)}
    if held.isdisjoint(firsts):
        return []
    out = []
    for i, w in enumerate(got):
        if w in firsts:
            phrase, label = firsts[w]
            if tuple(got[i : i + len(phrase)]) == phrase:
                out.append((i, label))
    return out


def scan(docs: DataFrame, index: Index | None = None) -> DataFrame:
    """The contract's columns for every row of ``doc_id, text``."""
    index = index or build_index(*document_frequencies(docs))

    def one(text: str | None) -> tuple:
        got = words(text)
        held = set(got)
        base = base_places(got, held)
        found = match_templates(index, got, held)
        own = {label for _, label in base}
        best = max((x[2] for x in found), default=0.5 if base else 0.0)
        return (
            len(got), len(base), base[0][0] if base else None, base[-1][0] if base else None,
            ",".join(sorted(own)), ",".join(sorted(own | {x[0] for x in found})), best,
        )

    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")

    def run(cols: dict[str, list]) -> dict[str, list]:
        rows = [one(t) for t in cols["text"]]
        return {"doc_id": cols["doc_id"]} | {name: [r[i] for r in rows] for i, name in enumerate(names)}

    return map_rows(
        docs.select(F.col("doc_id").cast("long"), "text"), run,
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double",
    )
