"""Brute-force, fixture and edge-case tests of the training-data operators."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from onoma.llm import decontam, hosts, jaccard, kneser, langid, licenses, mixing, pii, rules, warc
from onoma.llm.common import prepare, sampled_texts

SF = "/root/testdata/sf0.001"

LONG = "lorem ipsum dolor " * 20000

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EDGE = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \t\n\x0b\x0c\r", "en", "a", 6),
    (4, "one two", "en", "b", 7),
    (5, "one two", "en", "b", 7),
    (5, "one two", "en", "b", 7),
    (6, LONG, None, "b", len(LONG)),
    (7, "İstanbul é\U0001f600 ﬁ 12", "tr", "c", 17),
    (None, "no id here at all", "en", None, 17),
]


@pytest.fixture(scope="module")
def spark_(spark):
    prepare(spark)
    return spark


@pytest.fixture(scope="module")
def edge(spark_):
    df = spark_.createDataFrame(EDGE, DOC_SCHEMA)
    # extra columns whose names the operators use themselves
    return df.withColumns({c: F.lit("x") for c in ("size", "kept", "fp", "n", "lang_pred", "chunk", "host", "key", "shard", "sig", "score")})


@pytest.fixture(scope="module")
def empty(spark_):
    return spark_.createDataFrame([], DOC_SCHEMA)


@pytest.fixture(scope="module")
def labels(spark_):
    return spark_.createDataFrame([(4, 1, 0), (5, 1, 0), (6, 0, 0), (None, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def docs(spark_):
    return spark_.read.parquet(f"{SF}/documents.parquet")


# ---- 1 language ID ----------------------------------------------------------

def test_language_id_edges(edge, empty):
    model = langid.fit(edge)
    rows = langid.predict(edge, model).collect()
    assert len(rows) == len(EDGE)
    got = {r["doc_id"]: r for r in rows}
    for i in (1, 2, 3):
        assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
    assert all(0 <= r["score"] <= 1 and r["lang_pred"] in {"und", "en", "tr"} for r in rows)
    assert langid.fit(empty) == {}
    assert langid.predict(empty, {}).count() == 0
    assert {r["lang_pred"] for r in langid.predict(edge, {}).collect()} == {"und"}
    assert langid.Encoder({"en": b"one two"}).judge("one") == ("en", 1.0, False)


def test_language_id_held_out_accuracy(spark_):
    d = spark_.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.held_out(F.col("doc_id"))
    said = langid.predict(d.filter(out), langid.fit(d.filter(~out))).join(d.select("doc_id", "lang"), "doc_id")
    right, n = said.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 200 and right > 0.93


# ---- 2 mixing ---------------------------------------------------------------

def brute_targets(sizes: dict, cap: int = 3) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, out = sum(sizes.values()), set(order), {}
    while open_:
        w = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / w > cap * sizes[s]}
        if not over:
            out |= {s: left * weight[s] / w for s in open_}
            break
        for s in over:
            out[s] = cap * sizes[s]
        left -= sum(cap * sizes[s] for s in over)
        open_ -= over
    return out


def test_mixing_targets_match_resharing(spark_):
    rng = random.Random(2)
    for _ in range(4):
        sizes = {f"s{i}": rng.choice([0, 3, 50, 1000, 90000]) for i in range(rng.randint(1, 9))} | {None: rng.randint(0, 500)}
        df = spark_.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
        want = brute_targets(sizes)
        assert got.keys() == want.keys()
        for s in want:
            assert got[s] == pytest.approx(want[s], abs=1e-6)


def test_sainte_lague_matches_highest_quotients(spark_):
    rng = random.Random(5)
    for seats in (0, 1, 7, 200):
        w = {f"k{i}": rng.choice([0.0, 1.0, 5.0, 33.3, 900.0]) for i in range(8)}
        df = spark_.createDataFrame([(k, v, 1) for k, v in w.items()], "k string, w double, g int")
        got = {r["k"]: r["q"] for r in mixing.sainte_lague(df, "w", F.lit(seats), ["g"], [F.col("k")], "q").collect()}
        quotients = sorted(((-v / (2 * i + 1), k, i) for k, v in w.items() if v for i in range(seats)))[:seats]
        want = Counter(k for _, k, _ in quotients)
        assert got == {k: want[k] for k in w}


def test_mixing_edges(edge, empty, docs):
    rows = mixing.mix(edge).collect()
    assert len(rows) == len(EDGE)
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    assert mixing.mix(empty).count() == 0
    a = mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g"), F.max("source_size").alias("n"))
    for r in a.collect():
        assert abs(r["t"] - r["g"]) <= max(0.02 * r["g"], 2 * mixing.BLOCK_TOKENS)
    again = [sorted(map(tuple, mixing.mix(docs).collect())) for _ in range(2)]
    assert again[0] == again[1]


# ---- 3 quality classifier -----------------------------------------------------

class BruteKN:
    """Interpolated modified Kneser-Ney over bytes of marked words, by definition."""

    def __init__(self, texts):
        self.counts = [Counter() for _ in range(kneser.ORDER + 1)]
        for t in texts:
            for w in kneser.words(t):
                s = b"\x01" + w + b"\x02"
                for i in range(1, len(s)):
                    g = s[max(0, i + 1 - kneser.ORDER) : i + 1]
                    self.counts[len(g)][g] += 1
        types = set()
        for level in self.counts:
            for g in level:
                types |= {g[i:] for i in range(len(g))}
        for g in types:
            if len(g) > 1:
                self.counts[len(g) - 1][g[1:]] += 1
        self.cuts, self.ctx = {}, defaultdict(list)
        for n, level in enumerate(self.counts):
            self.cuts[n] = kneser.discounts([sum(c == i for c in level.values()) for i in (1, 2, 3, 4)])
            for g, c in level.items():
                self.ctx[g[:-1]].append(c)

    def p(self, g):
        if not g:
            return 1 / 256
        seen = self.ctx.get(g[:-1])
        if not seen:
            return self.p(g[1:])
        d = self.cuts[len(g)]
        cut = lambda c: d[min(c, 3) - 1]
        c = self.counts[len(g)][g]
        total = sum(seen)
        return (c - cut(c) if c else 0) / total + sum(map(cut, seen)) / total * self.p(g[1:])

    def nll(self, text):
        out = 0.0
        for w in kneser.words(text):
            s = b"\x01" + w + b"\x02"
            out -= sum(math.log(self.p(s[max(0, i + 1 - kneser.ORDER) : i + 1])) for i in range(1, len(s)))
        return out


def test_kneser_ney_matches_definition(spark_, docs):
    small = docs.filter(F.length("text") < 1500).orderBy("doc_id").limit(60).cache()
    rows = small.collect()
    trusted = {r["doc_id"] for r in rows[::2]}
    lab = spark_.createDataFrame([(i, 1) for i in trusted], "doc_id long, quality int")
    models = [BruteKN([r["text"] for r in rows if r["doc_id"] in trusted and kneser.fold_of(r["doc_id"]) == f]) for f in (0, 1)]
    got = {r["doc_id"]: r for r in kneser.quality(small, lab).collect()}
    assert len(got) == len(rows)
    for r in rows:
        n = sum(len(w) + 1 for w in kneser.words(r["text"]))
        want = math.exp(models[1 - kneser.fold_of(r["doc_id"])].nll(r["text"]) / n)
        assert got[r["doc_id"]]["n_tokens"] == n
        assert got[r["doc_id"]]["perplexity"] == pytest.approx(want, rel=1e-6)
    assert sum(got[i]["kept"] for i in trusted) >= 0.9 * len(trusted)


def test_toxic_documents_are_not_trusted(spark_):
    rows = [(1, 1, 0), (2, 1, 1), (3, 1, None), (4, 0, 0), (5, 1, 0), (5, None, 1), (None, 1, 0), (6, 1, 0), (6, 1, 0)]
    lab = spark_.createDataFrame(rows, "doc_id long, quality int, toxic int")
    assert sorted(r["id"] for r in kneser.trusted_ids(lab).collect()) == [1, 3, 6]
    assert sorted(r["id"] for r in kneser.trusted_ids(lab.drop("toxic")).collect()) == [1, 2, 3, 5, 6]


def test_kneser_ney_takes_five_bytes():
    key, _ = kneser.ngrams([b"abcdef"], 0)
    assert int.from_bytes(b"abcde") in {int(k) & kneser._BODY for k in key}


def test_kneser_ney_requests_round_trip(spark_):
    rng = np.random.default_rng(7)
    for n in (1, 2, 1000):
        keys = np.unique(rng.integers(1, 1 << 61, n))
        assert (kneser.unpack_keys(kneser.pack_keys(keys)) == keys).all()
        logps = rng.normal(size=n).astype(np.float32)
        assert (kneser.unpacked(kneser.packed(logps), np.float32) == logps).all()
    shards = kneser.shard_count(spark_)
    split, folds = [[b"alpha", b"beta"], [], [b"beta", b"\xc3\xa9"]], [0, 1, 1]
    keys, places = kneser.asked([kneser.ngrams(lot, f)[0] for f, lot in kneser.lots(split, folds)], shards)
    assert keys.tolist() == sorted({int(k) for ws, f in zip(split, folds) if ws for k in kneser.ngrams(ws, f)[0]})
    assert keys[places].tolist() == sorted(keys.tolist(), key=lambda k: (k % shards, k))


def test_kneser_ney_replies_come_in_the_order_asked(spark_):
    shards = kneser.shard_count(spark_)
    rng = np.random.default_rng(8)
    known = rng.permutation(np.unique(rng.integers(1, 1 << 61, 3000)))
    of = {int(k): float(np.float32(-i)) for i, k in enumerate(known)}
    rows, want = [], {}
    for chunk in range(12):  # chunk 0 asks for everything, chunk 11 for one
        keys = np.unique(known if chunk == 0 else rng.choice(known, 1 if chunk == 11 else 400))
        for k in set((keys % shards).tolist()):
            mine = keys[keys % shards == k]
            rows.append((k, chunk, kneser.pack_keys(mine)))
            want[chunk, k] = [of[x] for x in mine.tolist()]
    wanted = spark_.createDataFrame(rows, "shard int, chunk long, keys binary").repartition(5)
    assert sorted(r["key"] for r in kneser.distinct_keys(wanted, shards).collect()) == sorted(of)
    logp = spark_.createDataFrame(list(of.items()), "key long, logp float").repartition(7)
    got = {(r["chunk"], r["shard"]): kneser.unpacked(r["logps"], np.float32).tolist() for r in kneser.replies(wanted, logp, shards).collect()}
    assert got == want


def test_kneser_ney_edges(edge, empty, labels):
    rows = kneser.quality(edge, labels).collect()
    assert len(rows) == len(EDGE)
    by = {r["doc_id"]: r for r in rows}
    for i in (1, 2, 3):
        assert by[i]["perplexity"] is None and not by[i]["kept"]
    assert kneser.quality(empty, labels).count() == 0
    unlabelled = kneser.quality(edge, labels.filter("false")).collect()
    assert {r["doc_id"] for r in unlabelled if r["kept"]} == {4, 5, 6, 7, None}
    kept = kneser.keep_good(edge, labels)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in rows if r["kept"]}


def test_kneser_ney_separates_labels(spark_):
    sf = "/root/testdata/sf0.01"
    lab = spark_.read.parquet(f"{sf}/labels.parquet")
    j = kneser.quality(spark_.read.parquet(f"{sf}/documents.parquet"), lab).join(lab, "doc_id")
    share = {r["quality"]: r["k"] for r in j.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert share[1] > 0.97 and share[0] < 0.2


# ---- 4 licences -----------------------------------------------------------------

def brute_places(text):
    got = [w for w in re.split(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    at = []
    for phrase, label in licenses.BASE:
        p = phrase.split()
        at += [(i, label) for i in range(len(got)) if got[i : i + len(p)] == p]
    return got, sorted(at)


def test_license_scan_matches_brute_force(spark_, docs):
    rows = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    for r in docs.collect():
        got, at = brute_places(r["text"])
        x = rows[r["doc_id"]]
        assert (x["n_words"], x["n_base"]) == (len(got), len(at))
        assert (x["first_word"], x["last_word"]) == ((at[0][0], at[-1][0]) if at else (None, None))
        assert x["base_labels"] == ",".join(sorted({label for _, label in at}))
        assert set(filter(None, x["base_labels"].split(","))) <= set(x["labels"].split(","))
        assert 0 <= x["score"] <= 1


def test_license_templates(spark_, empty):
    cases = [
        ("x y z. Licensed under the Apache License,\n Version 2.0!", "apache,apache-2.0"),
        ("the MIT License. " * 3, "mit"),
        ("this is free software; you can redistribute it and/or modify it under the terms of the (by now old) GNU General Public License as published by the Free Software Foundation; either version 3 of the License", "gpl,gpl-3.0"),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "mit"),
        ("CC-BY\u00a0x cc by nc sa gnu general public licenses", "cc-by"),
        ("permission is granted to be free of any charge", ""),
        (None, ""),
        ("", ""),
        (LONG, ""),
    ]
    df = spark_.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan(df).collect()}
    assert [got[i]["labels"] for i in range(len(cases))] == [want for _, want in cases]
    assert licenses.scan(empty).count() == 0


def test_license_notices_in_one_text(spark_, docs):
    """A text with many notices keeps the label of each, whatever the others are."""
    index = licenses.build_index(*licenses.document_frequencies(docs))
    notices = [notice for _, notice, _ in licenses.TEMPLATES]
    texts = [" . ".join(notices), " . ".join(notices[3::-3] + notices[6:9]), *(f"{a} filler words here {b}" for a in notices for b in notices)]
    want = [{x for x, _, _ in licenses.TEMPLATES}, {"gpl-2.0", "gpl-3.0", "apache-2.0", "mit"}]
    want += [{a, b} for a, _, _ in licenses.TEMPLATES for b, _, _ in licenses.TEMPLATES]
    df = spark_.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan(df, index).collect()}
    for i, labels in enumerate(want):
        assert labels <= set(got[i]["labels"].split(",")), texts[i]
        assert got[i]["score"] == pytest.approx(1.0)
    assert len(want[0]) == 14


# ---- 5 personal data --------------------------------------------------------------

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def brute_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(EMAIL, text)]
    out += [("ip", *m.span()) for m in re.finditer(IP, text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(CARD, text):
        d = digits(m[0])
        total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d)))
        if 12 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(PHONE, text) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_base_patterns_match_the_contract():
    rng = random.Random(9)
    odd = ["a@b.c", "@", "..@x-.y", "a@b", "a@b.c@d.e", "1.2.3.4.5.6.7.8", "256.1.1.1", "001.2.3.4", "+1 (319) 555-5132", "+12", "+1 2+3 44444444", "4111 1111 1111 1111", "4111-1111-1111-1112", "é+49 30 1234567 ", "9" * 40]
    for _ in range(3000):
        t = "".join(rng.choice(odd + list("ab.@+-() 0123456789%_\n")) for _ in range(rng.randint(0, 30)))
        assert pii.base_spans(t) == brute_spans(t), t
    assert pii.base_spans("a" * 200000 + "1" * 200000) == []  # in linear time


def test_pii_query_columns(spark_, docs, edge, empty):
    w = pii.train(docs)
    rows = {r["doc_id"]: r for r in pii.find_pii(docs, w).collect()}
    for r in docs.collect():
        base = brute_spans(r["text"] or "")
        x = rows[r["doc_id"]]
        assert [x[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in base) for k in pii.KINDS]
        assert x["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(x["spans"].split(",")) | {""}
    assert pii.find_pii(edge, w).count() == len(EDGE)
    assert pii.train(empty) == {} and pii.find_pii(empty).count() == 0
    same = pii.redact(edge, w).filter("doc_id <=> 4").first()
    assert same["text"] == "one two" and same["n_chars"] == 7


def test_semi_markov_field(spark_):
    """Likelihood and best path agree with enumeration over all segmentations."""
    text = "call +1 (319) 555-5132 or 4 times a@b.co now"
    (tokens,) = pii.regions(text)
    lat = pii.Lattice(text, tokens)
    rng = random.Random(1)
    names = {f"{t}|{f}" for c in lat.into for _, _, _, fs in c for f in fs for t in range(1, 5)} | {f"{p}>{t}" for p in range(5) for t in range(5)}
    w = {n: rng.uniform(-1, 1) for n in sorted(names)}
    scored = lat.scored(w)

    def paths(j):
        if j == 0:
            yield 0.0, 0, ()
        else:
            for i, t, s in scored[j]:
                for v, p, path in paths(i):
                    yield v + s + w.get(f"{p}>{t}", 0.0), t, (*path, (i, j, t))

    every = list(paths(lat.n))
    z = math.log(sum(math.exp(v) for v, _, _ in every))
    best = max(every, key=lambda x: x[0])
    ends = {(a, b): (i, j) for j, c in enumerate(lat.into) for i, a, b, _ in c}
    assert [(*ends[a, b], t) for t, a, b, _ in lat.decode(w)] == [x for x in best[2] if x[2]]
    gold = {(i, j): t for i, j, t in best[2] if t}
    grad = defaultdict(float)
    assert lat.gradient(w, gold, grad) == pytest.approx(best[0] - z)
    name = max(grad, key=lambda k: abs(grad[k]))
    up = dict(w) | {name: w.get(name, 0.0) + 1e-5}
    assert (lat.gradient(up, gold, defaultdict(float)) - (best[0] - z)) / 1e-5 == pytest.approx(grad[name], abs=1e-3)


def test_pii_numbers_in_runs(spark_, docs, empty):
    """Valid numbers side by side: the base pattern drops the joint run, the field finds each."""
    w = pii.train(docs)
    n, m = "4465758382889437", "4111111111111111"
    for text in (f"x {n} {n} y", f"x {n} {m} y", f"{n} {n} {n}", f"a {m}, {n} b", f"call 12 {n} now {m} {m}"):
        left = pii.redacted(text, pii.all_spans(text, w)[1])
        assert n not in left and m not in left, (text, left)
    clean = "in 2019 2020 some 12 of 4000 people 10.5 km 17 03 2021"
    assert pii.all_spans(clean, w) == ([], [])
    rows = pii.in_runs(f"mail {n} a@b.co", [("card", 5, 21), ("email", 22, 28)])
    assert len(rows) == 8 and all(t[a:b] in (n, "a@b.co") for t, spans in rows for _, a, b in spans)
    for r in pii.redact(docs, w).collect():
        left = [t for t in re.split(r"[\x20\x09-\x0D]+", r["text"] or "") if re.fullmatch("[0-9]{12,19}", t) and pii.luhn(t)]
        assert not left, (r["doc_id"], left)


def test_sampled_texts(spark_, docs, edge, empty):
    assert sampled_texts(empty, 5).count() == 0
    got = [r["text"] for r in sampled_texts(docs, 7).collect()]
    assert len(got) == 7 and sorted(got) == sorted(r["text"] for r in sampled_texts(docs.repartition(5), 7).collect())
    assert sampled_texts(edge, 10**6).count() == len(EDGE)  # null ids, null texts and copies included


def test_pii_redaction():
    spans = pii.base_spans("mail a.b@c.de, ip 1.2.3.4")
    assert pii.redacted("mail a.b@c.de, ip 1.2.3.4", spans) == "mail <EMAIL>, ip <IP>"
    assert pii.redacted("abcdef", [("card", 1, 4), ("phone", 2, 5)]) == "a<CARD>f"


# ---- 6 hosts ------------------------------------------------------------------------

def test_url_filter(spark_):
    urls = [
        (1, "http://A.Net/x"), (2, "https://w.example.net/en/1"), (3, "http://example.com/de/5?x"), (4, "http://notexample.com/de/"),
        (5, "ftp://x.org/fr/#a"), (6, "http://a.net"), (7, None), (8, "no scheme"), (9, "http://net/"), (10, "x://y://z.net/en"), (10, "x://y://z.net/en"),
    ]
    pages = spark_.createDataFrame([(i, u, i, "x") for i, u in urls], "page_id long, url string, key long, host string")
    none = spark_.createDataFrame([], "key long, bad int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in hosts.filter_urls(pages, none).collect()}
    assert got == {
        1: ("a.net", "/x", "net/", "block"), 2: ("w.example.net", "/en/1", "example.net/en/", "allow"),
        3: ("example.com", "/de/5", "example.com/de/", "block"), 4: ("notexample.com", "/de/", None, "allow"),
        5: ("x.org", "/fr/", "org/fr/", "allow"), 6: ("a.net", "", None, "allow"), 7: ("", "", None, "allow"),
        8: ("", "", None, "allow"), 9: ("net", "/", "net/", "block"), 10: ("y:", "//z.net/en", None, "allow"),
    }
    assert hosts.filter_urls(pages, none).count() == len(urls)
    assert hosts.filter_urls(pages.filter("false"), none).count() == 0


def test_host_reputation_blocks_on_evidence(spark_):
    rows = [(i, f"http://bad{i % 2}.example.com/", i) for i in range(200)] + [(1000 + i, f"http://good{i % 50}.example.org/", 1000 + i) for i in range(500)]
    pages = spark_.createDataFrame(rows, "page_id long, url string, key long")
    bad = spark_.createDataFrame([(k, int(k < 1000)) for _, _, k in rows if k % 3], "key long, bad int")
    v = hosts.filter_urls(pages, bad, rules=()).groupBy("host").agg(F.min("verdict").alias("lo"), F.max("verdict").alias("hi")).collect()
    for r in v:
        assert r["lo"] == r["hi"] == ("block" if r["host"].startswith("bad") else "allow")


# ---- 7 rules --------------------------------------------------------------------------

def brute_rules(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    wins = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    k = Counter(wins)
    covered = {i + j for i, x in enumerate(wins) if k[x] > 1 for j in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_rules_match_brute_force(spark_, docs, edge, empty):
    texts = [r["text"] for r in docs.collect()] + [t for _, t, *_ in EDGE] + ["a b " * 9, "a b c d e f g h", "x\n\nx\n x\n" * 3]
    df = spark_.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in rules.quality_rules(df).collect():
        n, chars, symbols, dup, rep = brute_rules(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, rep)
        assert r["base_failed"] == (n < 20 or 100 * rep > 30 * n)
        assert not (r["base_failed"] and r["kept"])
    assert rules.quality_rules(edge).count() == len(EDGE)
    assert rules.quality_rules(empty).count() == 0


def test_cascade_order_changes_work_not_verdict(docs):
    stats = rules.estimate(docs)
    assert [s["rule"] for s in stats] == [r.name for r in rules.RULES]
    order = rules.order_rules([{"rule": r.name, "cost": i + 1.0, "selectivity": 0.5} for i, r in enumerate(rules.RULES)])
    assert order == list(rules.RULES)
    a = rules.cascade(docs, stats=stats)
    b = rules.cascade(docs, rules=tuple(reversed(rules.RULES)), stats=[])
    assert sorted(map(tuple, a.select("doc_id", "kept").collect())) == sorted(map(tuple, b.select("doc_id", "kept").collect()))


# ---- 8 Jaccard ---------------------------------------------------------------------------

def brute_groups(rows):
    def one(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = [one(t) for _, t in rows]
    at = list(range(len(rows)))

    def root(x):
        while at[x] != x:
            x = at[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                at[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted((str(d), len(sets[i]), str(least.get(root(i)))) for i, (d, _) in enumerate(rows))


def got_groups(df):
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in jaccard.similarity_groups(df).collect())


def test_jaccard_edges(spark_, edge, empty):
    assert got_groups(edge) == brute_groups([(d, t) for d, t, *_ in EDGE])
    assert jaccard.similarity_groups(empty).count() == 0
    once = jaccard.keep_one(edge.select("doc_id", "text"))
    assert sorted(r["doc_id"] or 0 for r in once.collect()) == [0, 1, 2, 3, 4, 6, 7]


@pytest.mark.parametrize("frequent", [2, 6, 24])
def test_jaccard_matches_brute_force(spark_, frequent, monkeypatch):
    """Copies, edits around the threshold, shared passages and small sets, at several class borders."""
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    rng = random.Random(frequent)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows = []
    for base in range(14):
        n = rng.choice([3, 6, 20, 45, 60, 170, 400])
        words = [rng.choice(vocabulary) for _ in range(n)]
        for _ in range(rng.randint(1, 14)):
            w = list(words)
            for _ in range(rng.randint(0, max(1, n // 22))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                at = rng.randrange(len(w))
                w[at:at] = passage
            rows.append((len(rows), " ".join(w)))
    df = spark_.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got_groups(df) == brute_groups(rows)


def test_signatures_never_miss_a_link():
    import numpy as np

    rng = np.random.default_rng(4)
    for _ in range(400):
        n = int(rng.integers(1, 900))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        drop = int(rng.integers(0, n // 8 + 1))
        b = np.unique(np.concatenate([rng.permutation(a)[drop:], rng.integers(0, 2**63, drop, dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if not both or 100 * both < 80 * (len(a) + len(b) - both):
            continue
        share = rng.random()
        kinds = {int(t): rng.random() < share for t in np.union1d(a, b)}
        shared = set(np.intersect1d(a, b).tolist())

        def entries(x):
            frequent = np.array([kinds[t] and t in shared for t in x.tolist()])
            multi = np.array([t in shared for t in x.tolist()]) | frequent
            return jaccard.signatures(x, multi, frequent)

        x, y = entries(a), entries(b)
        met = [k for k in x.keys() & y.keys() if len(np.intersect1d(x[k], y[k]))]
        assert met
        for k in met:
            differ = np.bitwise_count((jaccard.parity(a, k) ^ jaccard.parity(b, k)).view(np.uint64)).sum()
            assert 9 * differ <= len(a) + len(b)


def test_components_of_chains_and_stars(spark_):
    edges = [(i, i + 1) for i in range(20)] + [(100, i) for i in range(101, 120)] + [(200, 201), (201, 200)]
    got = {r["node"]: r["comp"] for r in jaccard.components(spark_.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(21)} | {i: 100 for i in range(100, 120)} | {200: 200, 201: 200}


# ---- 9 WARC ---------------------------------------------------------------------------------

def test_warc_derivatives(spark_, tmp_path):
    pages = spark_.createDataFrame(
        [(1, "http://a/", "<html><head><title>t</title></head><body><p>Hi <b>you</b> &amp; me</p><script>x</script><p>two</p></body>", "x"),
         (2, None, None, "x"), (None, "http://b/", "", "x"), (1, "http://a/", "<p>é</p>", "x")],
        "page_id long, url string, html string, block string",
    )
    responses = warc.responses_from_pages(pages)
    records = warc.build_derivatives(responses)
    rows = records.collect()
    assert len(rows) == 8
    ids = {r["record_id"] for r in responses.collect()}
    assert {r["refers_to"] for r in rows} == ids and len({r["record_id"] for r in rows}) == 8
    text = {r["target_uri"]: r["block"] for r in rows if r["record_type"] == "conversion" and r["page_id"] == 1 and "é" not in r["block"]}
    assert text == {"http://a/": "Hi you & me\ntwo"}
    for r in rows:
        data = r["block"].encode()
        assert r["content_length"] == len(data)
        assert r["block_digest"] == "sha256:" + hashlib.sha256(data).hexdigest()
    path = str(tmp_path / "warc")
    warc.write_warc(records.coalesce(1), path)
    import glob
    import gzip

    (name,) = glob.glob(path + "/part-*.gz")
    raw, seen = gzip.open(name).read(), 0
    while raw:
        head, _, rest = raw.partition(b"\r\n\r\n")
        fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
        n = int(fields[b"Content-Length"])
        assert head.startswith(b"WARC/1.1") and fields[b"WARC-Block-Digest"] == b"sha256:" + hashlib.sha256(rest[:n]).hexdigest().encode()
        assert rest[n : n + 4] == b"\r\n\r\n"
        raw, seen = rest[n + 4 :], seen + 1
    assert seen == 8
    assert warc.build_derivatives(warc.responses_from_pages(pages.filter("false"))).count() == 0


# ---- 10 decontamination ------------------------------------------------------------------------

def edit_distance_within(item, text, most):
    """Smallest edit distance of item to a substring of text (plain dynamic programming)."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, x in enumerate(item):
            new.append(min(row[i] + (x != c), row[i + 1] + 1, new[i] + 1))
        row = new
        best = min(best, row[-1])
    return best if best <= most else None


def test_edit_search_is_exact():
    rng = random.Random(8)
    for _ in range(300):
        item = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 90)))
        text = "".join(rng.choice("abc ") for _ in range(rng.randint(0, 120)))
        most = rng.randint(0, len(item))
        got = decontam.edit_search(item, text, most)
        assert (got and got[0]) == edit_distance_within(item, text, most) or (got is None and most >= len(item))


def test_decontamination_matches_brute_force(spark_):
    rng = random.Random(3)
    rows = [r["text"] for r in spark_.read.parquet(f"{SF}/documents.parquet").select("text").limit(40).collect()]
    items = [(r["item_id"], r["text"]) for r in spark_.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts, found, want = [], 0, 0
    for k in range(60):
        _, t = rng.choice(items)
        s = list(t)
        for _ in range(rng.randint(0, len(s) // 14)):
            p = rng.randrange(len(s))
            s[p : p + 1] = rng.choice([[], ["x"], [s[p], "y"]])
        texts.append(rows[k % 40][:200] + " " + "".join(s) + " " + rows[(k + 7) % 40][:200] if k % 3 else rows[k % 40][:400])
    texts += [None, "", LONG]
    df = spark_.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("item_id", F.lit("x"))
    bench = spark_.createDataFrame([*items, (9001, None), (9002, "short")], "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontam.find_leaks(df, bench).collect()}
    for i, t in enumerate(texts[:60]):
        for j, item in items:
            a = decontam.normal(item)
            d = decontam.edit_search(a, decontam.normal(t), int(decontam.MAX_EDIT * len(a))) if len(a) >= decontam.MIN_CHARS else None
            want += d is not None
            found += d is not None and got.get((i, j)) == d[0]
            assert (i, j) not in got or d is not None  # no false alarm
    assert want > 20 and found >= 0.9 * want
    left = decontam.drop_leaks(df.selectExpr("doc_id", "text", "null lang", "null source", "null n_chars"), bench)
    assert {r["doc_id"] for r in left.collect()} == set(range(len(texts))) - {i for i, _ in got}
    assert decontam.find_leaks(df, bench.filter("false")).count() == 0
    assert decontam.find_leaks(df.filter("false"), bench).count() == 0


def test_decontamination_finds_every_edited_item():
    """Nothing is lost by item length or edit share, up to MAX_EDIT."""
    rng = random.Random(12)
    letters = "abcdefghijklmnopqrstuvwxyz "
    for size, tries in ((100, 40), (390, 40), (1000, 20), (2500, 8)):
        item = decontam.normal("".join(rng.choice(letters) for _ in range(size)))
        block = decontam.Block([(1, item)], decontam.MAX_EDIT)
        most = block.edits[0]
        for share in (0.05, 0.09, 0.1):
            texts = []
            for _ in range(tries):
                s = list(item)
                for p in rng.sample(range(len(s)), min(int(share * len(item)), most)):
                    s[p] = rng.choice(["", "#", s[p] + "#"])
                around = ["".join(rng.choice(letters) for _ in range(300)) for _ in range(2)]
                texts.append(around[0] + "".join(s) + around[1])
            want = [(i, 0, *decontam.edit_search(item, t, most)) for i, t in enumerate(texts)]
            assert sorted(block.matches(texts)) == want, (size, share)


def test_decontamination_matches_short_items_word_for_word(spark_):
    texts = ["The  Answer is 42.", "answers is 42", "preanswer is 42", "(answer is 42)", "answer is 421, answer is 42", "answer is 4 2", "", None]
    df = spark_.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark_.createDataFrame([(1, "Answer is\n42"), (2, "z"), (3, " "), (4, None), (5, "4 2")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["distance"], r["item_chars"], r["end_char"]) for r in decontam.find_leaks(df, bench).collect()}
    assert got == {(0, 1): (0, 12, 16), (3, 1): (0, 12, 13), (4, 1): (0, 12, 27), (5, 5): (0, 3, 13)}
    left = decontam.drop_leaks(df.selectExpr("doc_id", "text", "null lang", "null source", "null n_chars"), bench)
    assert {r["doc_id"] for r in left.collect()} == {1, 2, 6, 7}


def test_walks_are_stable():
    import numpy as np

    a, b = decontam.Walks(), decontam.Walks()
    row = decontam.points(["hello world, again and again"], 28)
    short = a.embed(row, 2, 84)
    assert np.array_equal(short, b.embed(decontam.points(["hello world, again and again"], 2000), 2, 1500)[:84])
