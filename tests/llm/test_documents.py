"""Odd rows and brute-force comparisons for the operators on documents."""

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from seqloom.llm import langid, licenses, linking, minhash, mixing, pieces, quality
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string, measures int, n_tokens int"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def sentence(seed, n):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


def odd_rows():
    base = sentence(1, 120)
    texts = [
        None, "", " \n\t ", "one", base, base, base.replace("alpha", "ALPHA"), base + " tail", sentence(2, 60),
        "word " * 400, "x" * 50_000, "###\n" * 80, "12 34 !!", "é" * 10, sentence(3, 3000), "a b c d",
        sentence(4, 70).upper(), "line one here\n" * 30,
    ]
    rows = [(i, t, "en" if i % 3 else None, f"src{i % 5}" if i % 4 else None, len(t or ""), "r", i, 7) for i, t in enumerate(texts)]
    return rows + [rows[4], (None, base, "en", "src1", 3, "r", 1, 1), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def repeat_words(text):
    w = brute.WORD.findall(text or "")
    seen = {}
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    return len({i + k for at in seen.values() if len(at) > 1 for i in at for k in range(3)})


def test_quality_measures(odd, empty):
    rows = quality.quality_report(odd).join(odd.select("doc_id", "text").where("doc_id is not null").distinct(), "doc_id").collect()
    assert rows
    for r in rows:
        w = brute.WORD.findall(r.text or "")
        assert r.n_words == len(w) and r.word_chars == sum(map(len, w))
        assert r.n_repeat_words == repeat_words(r.text)
        lines = [x for x in (r.text or "").split("\n") if brute.WORD.search(x)]
        assert r.n_dup_lines == len(lines) - len(set(lines))
        assert r.base_failed == (len(w) < 50 or 100 * r.n_repeat_words > 50 * len(w))
        assert not (r.base_failed and r.kept)
    assert quality.quality_report(empty).count() == 0
    assert quality.keep_good(odd).columns == odd.columns


def test_quality_ablation(odd):
    ledger = quality.ledger(odd, measures="m_", bits="b_").cache()
    bits = [r.b_ for r in ledger.select("b_").collect()]
    for r in quality.ablation(ledger, "b_").collect():
        mask = quality.POLICIES[r.policy]
        assert r.rejected == sum(1 for b in bits if b & mask)
        assert r.failed == sum(1 for b in bits if b & quality.BIT[r.rule])
        assert r.only_this == sum(1 for b in bits if b & mask == quality.BIT[r.rule])


def test_language_of_odd_rows(odd, empty):
    rows = langid.language_report(odd).collect()
    assert len(rows) == odd.count()
    by_id = {r.doc_id: r for r in rows}
    for i in (0, 1, 2, 11, 12):
        assert (by_id[i].lang_pred, by_id[i].score) == ("und", 0.0)
    assert all(r.lang_pred in ("en", "und") and 0 <= r.score <= 1 for r in rows)
    assert langid.language_report(empty).count() == 0
    kept = langid.keep_identified(odd)
    assert kept.columns == odd.columns and kept.where("text is null").count() == 0


def test_language_nothing_to_learn(spark):
    rows = spark.createDataFrame([(1, "some words", None)], "doc_id long, text string, lang string")
    assert [tuple(r)[2:] for r in langid.language_report(rows).collect()] == [("und", 0.0)]


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.language_report(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    n, right = rows.agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert n > 100 and right >= 0.97 * n


def test_language_ignores_labels(spark):
    """lang, source and doc_id are no inputs: the prediction of a text is the same whatever they say."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.fit(docs)
    a = langid.identified(docs, model).select("doc_id", "language").collect()
    b = langid.identified(docs.withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit("x")), model)
    assert sorted(map(str, a)) == sorted(map(str, b.select("doc_id", "language").collect()))


@pytest.mark.parametrize("n_languages", [2, 4])
def test_language_filter_of_foreign_and_junk_texts(spark, n_languages):
    rng = np.random.default_rng(5)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where(F.col("lang").isin(["en", "fr", "de", "es"][:n_languages]))
    signs = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
    junk = ["Это текст на незнакомом языке. " * 20, "これは知らない言葉の文章です。" * 20, "".join(rng.choice(signs, 4000)), "qxzjvkqx wjqzx kvqj " * 30, "1 2 3 x"]
    bad = spark.createDataFrame([(10**9 + i, t) for i, t in enumerate(junk)], "doc_id long, text string")
    kept = langid.keep_identified(docs.unionByName(bad, allowMissingColumns=True)).select("doc_id").collect()
    ids = [r.doc_id for r in kept]
    assert not [i for i in ids if i >= 10**9]
    assert len(ids) >= 0.98 * docs.count()


def test_pieces_like_the_library(odd, empty):
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = {r.doc_id: r.text or "" for r in odd.where("doc_id is not null").collect()}
    rows = pieces.token_report(odd).collect()
    assert len(rows) == odd.count()
    for r in rows:
        if r.doc_id is not None:
            assert list(r.token_ids) == sp.encode(texts[r.doc_id]) and r.n_tokens == len(r.token_ids) and r.round_trip
    assert pieces.token_report(empty).count() == 0


def test_pieces_round_trip(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = ["", " ", "  two  spaces ", " " * 45 + "x", "\n\n a\tb", "日本語 漢字 𠮷", "▁x", "aaaaaaaaaaaaaaaaaaaaaaaa", "naïve Straße", "\x00\x01"]
    rng = np.random.default_rng(5)
    texts += ["".join(rng.choice(list("abcdeo \n.,THE"), 60)) for _ in range(300)]
    e = pieces.Encoder(pieces.Pieces())
    tokens, at = e.encode(texts)
    data, back = e.decode(tokens, at)
    for i, t in enumerate(texts):
        assert tokens[at[i] : at[i + 1]].tolist() == sp.encode(t)
        assert data[back[i] : back[i + 1]].tobytes().decode() == t.replace("▁", " ")
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    ids = pieces.encoded(rows).select("i", "pieces.ids")
    got = {r.i: r.t for r in ids.select("i", pieces.decoder()("ids").alias("t")).collect()}
    assert got == {i: t.replace("▁", " ") for i, t in enumerate(texts)}


def test_unigram_scores(tmp_path):
    """A unigram model is segmented by the largest sum of scores, as the library does it."""
    vocab = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), ("▁", -3.0, 1)]
    vocab += [(c, -4.0 - 0.1 * i, 1) for i, c in enumerate("abc")] + [("ab", -5.1, 1), ("bc", -5.3, 1), ("abc", -8.9, 1), ("▁a", -4.4, 1), ("ca", -7.0, 1)]

    def field(n, kind, data):
        head = bytes([n << 3 | kind])
        return head + (bytes([len(data)]) + data if kind == 2 else data)

    model = b""
    for text, score, kind in vocab:
        piece = field(1, 2, text.encode()) + field(2, 5, np.float32(score).tobytes()) + field(3, 0, bytes([kind]))
        model += field(1, 2, piece)
    model += field(2, 2, field(3, 0, bytes([1]))) + field(3, 2, field(1, 2, b"identity") + field(3, 0, b"\x01") + field(4, 0, b"\x00"))
    path = tmp_path / "u.model"
    path.write_bytes(model)
    sp = sentencepiece.SentencePieceProcessor(model_file=str(path))
    e = pieces.Encoder(pieces.Pieces(str(path)))
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("abc "), 12)).strip() for _ in range(200)] + ["abz", "zz"]
    tokens, at = e.encode(texts)
    assert [tokens[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == sp.encode(texts)


def test_near_duplicates_of_odd_rows(odd, empty):
    rows = minhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    plain = [(r.doc_id, r.text) for r in odd.where("doc_id is not null").dropDuplicates(["doc_id"]).collect()]
    want = brute.near_duplicates(plain)
    for r in rows:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    assert minhash.near_duplicates(empty).count() == 0
    kept = minhash.deduplicated(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect() if r.doc_id is not None]
    assert sorted(ids) == sorted(d for d, (_, c) in want.items() if d == c)


def family(seed, size, base_words=90, edits=3):
    """Near copies of one text, each with a few words of its own."""
    rng = np.random.default_rng(seed)
    base = rng.choice(WORDS, base_words).tolist()
    out = []
    for k in range(size):
        w = list(base)
        for i in rng.choice(base_words, edits, replace=False):
            w[i] = f"own{seed}x{k}x{i}"
        out.append(" ".join(w))
    return out


def test_near_duplicates_in_blocks(spark, monkeypatch):
    """Groups far over the size of a block, hot passages, and small texts give what brute force gives."""
    monkeypatch.setattr(linking, "FEW", 0)
    monkeypatch.setattr(linking, "MINIMA", 0)  # as with more links than may be broadcast
    monkeypatch.setattr(minhash, "CAP", 12)
    monkeypatch.setattr(minhash, "BLOCK", 8)
    passage = sentence(99, 60)
    texts = family(1, 60, edits=1) + family(2, 40, edits=3) + family(3, 25, edits=5)
    texts += [f"{passage} {sentence(1000 + i, 12)}" for i in range(60)]
    texts += [sentence(500 + i // 2, 5 + i % 2) for i in range(40)] + [texts[0]] * 5
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(rows).collect()}
    assert got == brute.near_duplicates(list(enumerate(texts)))


def test_near_duplicates_of_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs).collect()}
    assert got == brute.near_duplicates([tuple(r) for r in docs.collect()])


def test_near_duplicates_stage_takes_five_words(spark):
    """One changed word in 45 leaves 80 % of the 4-grams or more but fewer of the 5-grams: the stage keeps both texts."""
    w = [f"w{i}" for i in range(45)]
    other = [*w[:20], "changed", *w[21:]]
    rows = spark.createDataFrame([(0, " ".join(w)), (1, " ".join(other)), (2, " ".join(w))], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, rows, "").collect()) == [0, 1]
    assert [r.doc_id for r in minhash.near_duplicates(rows).where("kept").collect()] == [0]


def test_near_duplicates_stage_like_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    want = brute.near_duplicates([(r.doc_id, r.text) for r in docs.collect()], size=5)
    assert got == sorted(d for d, (_, c) in want.items() if d == c)


def shares(children, budget):
    """(capacity, weight) -> what each gets: raise the level until the budget is used up."""
    got, left, open_ = [0] * len(children), budget, set(range(len(children)))
    while open_:
        weights = sum(children[i][1] for i in open_)
        full = {i for i in open_ if children[i][0] * weights <= left * children[i][1]}
        if not full:
            for i in open_:
                got[i] = left * children[i][1] // weights
            return got
        first = min(full, key=lambda i: children[i][0] / children[i][1])
        got[first] = children[first][0]
        left -= children[first][0]
        open_ -= {first}
    return got


def test_budgets(spark):
    leaves = [("d0", "en", "a", 100), ("d0", "en", "b", 5), ("d0", "de", "a", 40), ("d1", "en", "c", 1000), ("d1", "fr", "c", 0)]
    weights = [{"d0": 3}, {"en": 4, "de": 2}, {"a": 2}]
    df = spark.createDataFrame(leaves, "x string, y string, z string, available long")
    for percent in (1, 30, 70, 100, 150):
        got = {tuple(r)[:3]: r.budget for r in mixing.budgets(df, ["x", "y", "z"], weights, percent, 2).select("x", "y", "z", "budget").collect()}

        def down(rows, budget, depth, into):
            if depth == 3:
                into[rows[0][:3]] = budget
                return
            names = sorted({r[depth] for r in rows})
            parts = [[r for r in rows if r[depth] == n] for n in names]
            caps = [(sum(2 * r[3] for r in p), weights[depth].get(n, 1)) for n, p in zip(names, parts, strict=True)]
            for p, b in zip(parts, shares(caps, budget), strict=True):
                down(p, b, depth + 1, into)

        want = {}
        down(leaves, 1145 * percent // 100, 0, want)
        assert got == want


def test_mixing_of_odd_rows(odd, empty):
    rows = mixing.mixed(odd, percent=80).collect()
    tokens = {r.doc_id: r.n_tokens for r in rows}
    assert tokens and all(r.epoch < mixing.MAX_EPOCHS for r in rows)
    assert mixing.mixed(empty).count() == 0
    whole = mixing.mixed(odd, percent=80, whole_rows=True)
    assert whole.columns == odd.columns and whole.count() == len(rows)
    assert sorted(str(r.doc_id) for r in whole.collect()) == sorted(str(r.doc_id) for r in rows)


def test_licences(spark, odd, empty):
    mit = dict(licenses.KNOWN)["MIT"]
    full = next(t for n, t in licenses.KNOWN if n == "MIT" and t.startswith("Permission"))
    texts = [
        "Copyright (c) 2020 Someone\n\n" + full, full.upper().replace(" ", "\n"), full + " extra", mit,
        "intro\nreleased under the MIT Licence\nmore", "SPDX-License-Identifier: Apache-2.0\nLicensed under CC BY-NC 4.0.", None, "",
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.text_license, r.line_licenses, r.n_license_lines) for r in licenses.license_report(rows).collect()}
    assert got[0][0] == "MIT" and got[1][0] == "MIT" and got[2][0] is None and got[3][0] == "MIT"
    assert got[4] == (None, "MIT", 1) and got[5] == (None, "Apache-2.0 CC-BY-NC-4.0", 2)
    assert got[6] == (None, "", 0) and got[7] == (None, "", 0)
    assert licenses.license_report(odd).count() == odd.count() and licenses.license_report(empty).count() == 0


def test_whole_licence_texts_and_identifiers(spark):
    full = {n: t for n, t in reversed(licenses.whole_texts())}
    bsd3 = next(t for n, t in licenses.KNOWN if n == "BSD-3-Clause")
    isc = next(t for n, t in licenses.KNOWN if n == "ISC")
    cases = [(t, n, None) for n, t in full.items()]
    apache = full["Apache-2.0"]
    cases += [
        (apache.replace("Copyright [yyyy] [name of copyright owner]", "Copyright 2020 Someone"), "Apache-2.0", None),
        (apache[: apache.index("END OF TERMS")], "Apache-2.0", None),
        ("BSD 3-Clause License\n\nCopyright (c) 2020, Someone\nAll rights reserved.\n\n" + bsd3, "BSD-3-Clause", None),
        ("ISC License\n\nCopyright (c) 2020, Someone\n\n" + isc, "ISC", None),
        (apache + " more", None, None),
        ("x\n// SPDX-License-Identifier: LGPL-2.1-or-later\ny", None, "LGPL-2.1-or-later"),
        ("# SPDX-License-Identifier: (MIT OR EPL-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0\nx", None, "EPL-2.0 GPL-2.0-only MIT"),
        ("/* SPDX-License-Identifier: Unlicense */\nSPDX-License-Identifier: MIT\nx", None, "MIT Unlicense"),
        ("SPDX-License-Identifier: Zlib as the file says (and more)", None, "Zlib"),
        ("SPDX-License-Identifier:\nspdx", None, ""),
    ]
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.license_report(rows).collect()}
    for i, (text, whole, lines) in enumerate(cases):
        assert got[i].text_license == whole, text[:80]
        assert lines is None or got[i].line_licenses == lines, text
    assert len(full) == len(licenses.TEXTS)
