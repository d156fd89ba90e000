"""Phrases against a count of every phrase."""

import re
from collections import Counter

import numpy as np
import pytest

from seqloom.llm import phrases

SCHEMA = "doc_id long, text string, lang string, w1 string, n int, key string"


def expected(rows, least, top, percent=100):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    out = {}
    found = {k: v for k, v in f.items() if v >= least and len(k[1]) > 1}
    for lang in n:
        rows = []
        for (where, g), a in found.items():
            if where != lang:
                continue
            inside = any(
                len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h))) and 100 * b >= percent * a
                for (other, h), b in found.items() if other == lang
            )
            if not inside:
                cuts = [(1000 * a * n[lang] // (f[lang, g[:k]] * f[lang, g[k:]]), k) for k in range(1, len(g))]
                score, k = min(cuts)
                rows.append((-score, -a, " ".join(g).encode(), f[lang, g[:k]], f[lang, g[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            out[lang, rank] = (phrase.decode(), -a, left, right, n[lang], -score)
    return out


def made():
    rng = np.random.default_rng(11)
    words = ["The", "the", "cat", "CAT", "sat", "on", "é", "Émile", "mat", "x#1", "of"]
    rows = []
    for i in range(160):
        w = rng.choice(words, rng.integers(0, 40), p=[0.2, 0.2, 0.1, 0.1, 0.1, 0.05, 0.05, 0.05, 0.05, 0.05, 0.05])
        rows.append(("".join(x + rng.choice([" ", " ", "  ", "\t", ". ", "\n", ", "]) for x in w), [None, "en", "de", "und"][i % 4]))
    rows += [("to be or not to be " * 3, "en")] * 9 + [("a a a a a a a", "de")] * 3 + [(None, "en"), ("", None), (" .;\n", "fr"), ("word " * 300, "en"), ("solo", "fr")]
    return rows


@pytest.mark.parametrize("tight", [False, True])
def test_phrases(spark, monkeypatch, hot, tight):
    if tight:  # few ranks, hardly any bitmap, pieces cut into rows, every pair hot
        for name, value in {"CODES": 3, "FILTER_BITS": 128, "CHUNK": 3, "HOT": 1000, "SALTS": 3}.items():
            monkeypatch.setattr(phrases, name, value)
        monkeypatch.setattr(phrases, "bounded", lambda df: df)
    rows = made()
    df = spark.createDataFrame([(i, *r, "c", 1, "k") for i, r in enumerate(rows)], SCHEMA).repartition(5)
    for top, percent in ((10_000, 100), (4, 70)):
        got = {(r.lang, r.rank): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in phrases.collocations(df, 5, top, percent).collect()}
        assert got == expected(rows, 5, top, percent)


def test_hashes_that_meet(spark, monkeypatch):
    """Hashes of which two words share one are drawn anew."""
    whole = phrases._hash
    monkeypatch.setattr(phrases, "_hash", lambda lang, word, seed: whole(lang, word, seed) if seed else whole(lang, phrases.F.substring(word, 1, 1), seed))
    rows = [("one two once two", "en")] * 3
    df = spark.createDataFrame([(i, *r, "c", 1, "k") for i, r in enumerate(rows)], SCHEMA)
    got = {(r.lang, r.rank): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in phrases.collocations(df, 3).collect()}
    assert got == expected(rows, 3, 2000)


def test_packing(spark):
    """Ranks and hashes in all places come back as they were; equal first words have equal heads."""
    rng = np.random.default_rng(3)
    top = (1 << phrases.RANK_BITS) - 1
    rows = []
    for _ in range(400):
        n = rng.integers(2, 6)
        w = [int(rng.choice([1, 2, top, top - 1, -5, -(1 << 63), -(1 << 40)], p=[0.3, 0.2, 0.2, 0.1, 0.1, 0.05, 0.05])) for _ in range(n)]
        rows.append((*w, *[None] * (5 - n), 0))
    df = spark.createDataFrame(rows, "w1 long, w2 long, w3 long, w4 long, w5 long, salt int")
    packed = phrases._packed(df).cache()
    assert packed.where("wide is null").count() > 50
    back = phrases._unpacked(packed)
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted((tuple(r) for r in back.select(*df.columns).collect()), key=key) == sorted(rows, key=key)
    assert back.select("w1", "w2").distinct().count() == back.select("w1", "w2", "head").distinct().count()


def test_scores_are_exact(spark):
    big = 4_000_000_000_000_000_007
    row = spark.createDataFrame([(big, big, 3, 7)], "a long, n long, l1 long, r1 long")
    row = row.selectExpr("a", "n", "l1", "r1", *[f"cast(null as long) as {s}{k}" for k in (2, 3, 4) for s in "lr"])
    small = row.selectExpr("1000003 as a", "n", "cast(1000003 as long) as l1", "cast(999999999 as long) as r1", "l2", "r2", "l3", "r3", "l4", "r4")
    assert small.select(phrases._weakest(phrases.F.col("n")).score).first()[0] == 1000 * 1000003 * big // (1000003 * 999999999)


def test_nothing(spark):
    assert phrases.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert phrases.collocations(spark.createDataFrame([(1, None, None, "", 1, "")], SCHEMA)).count() == 0
