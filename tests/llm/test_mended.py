"""Cases that went wrong once."""

import time

import pytest

from seqloom.llm import html, langid, lattice, linking, minhash, quality
from tests.llm import brute

DOCS = "doc_id long, text string, lang string, _place int, _measures int, _language string, row string"


def docs(spark, rows):
    return spark.createDataFrame([(d, t, "en", 1, 2, "x", "r") for d, t in rows], DOCS)


def test_copies_and_ids(spark):
    """The text counts, not the id: texts that share an id all stay, copies go whatever their ids are."""
    a, b, c = "a b c d e f g", "other words that stand alone here", "a third text of some words"
    rows = [(1, a), (1, a), (1, b), (2, a), (None, c), (None, c), (None, b), (3, ""), (3, None), (4, c.upper())]
    df = docs(spark, rows)
    kept = minhash.deduplicated(df)
    assert kept.columns == df.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got == sorted([(1, a), (1, b), (4, c.upper()), (3, ""), (3, None)], key=str)
    assert all(r._place == 1 and r._measures == 2 and r._language == "x" and r.row == "r" for r in kept.collect())


def test_columns_of_any_name_stay(spark):
    text = "the words of this text are many and each of them is another one so that nothing is said twice here " * 1
    df = docs(spark, [(i, f"{text}{i} " + " ".join(f"word{i}x{k}" for k in range(60))) for i in range(8)])
    for kept in (quality.keep_good(df), langid.keep_identified(df)):
        assert kept.columns == df.columns
        assert {(r._place, r._measures, r._language, r.row) for r in kept.collect()} == {(1, 2, "x", "r")}


def test_windows_whose_hashes_meet(spark, monkeypatch):
    """Equal hashes of different windows count for nothing, equal windows among them do."""
    whole = quality.F.xxhash64
    monkeypatch.setattr(quality.F, "xxhash64", lambda *c: whole(*c) % 3)
    rows = [(0, "a b c d e f g h i j k l m"), (1, "a b c x a b c"), (2, "a a a a")]
    got = {r.doc_id: r.n_repeat_words for r in quality.quality_report(docs(spark, rows)).collect()}
    assert got[0] == 0 and got[2] == 4


def test_short_pages_lose_their_template(spark):
    """However much of a page it is, what recurs on the host's pages goes; a copied article stays."""
    box = "<p>Subscribe to our weekly letter and never miss a story again, promise!</p>"
    rows = [(i, f"http://s.example/{i}", f"<article><h1>Title {i}</h1><p>Short note {i}.</p>{box}</article>") for i in range(12)]
    parts = "".join(f"<p>Passage {k} of the copied article with a few words.</p>" for k in range(6))
    rows += [(50 + i, f"http://c.example/{i}", f"<article><h1>Copied</h1>{parts}<p>Day {i}</p></article>") for i in range(6)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.text_report(pages).collect()}
    assert all(got[i] == f"Title {i}\nShort note {i}." for i in range(12))
    assert all(got[50 + i].count("Passage") == 6 for i in range(6))


@pytest.mark.parametrize("piece", ["<b>|<hr>", "<p", "<a b='>'x", "<article>x", "<div><p>x", "<table><td>x", "<li>x", "</p>x", "<!--x", "<a \"'x"])
def test_hostile_pages_take_time_in_proportion(piece):
    """About 1 MB each."""
    first, _, second = piece.partition("|")
    n = 1_000_000 // len(first + second)
    start = time.perf_counter()
    html.Page(first * n + second * n).text()
    assert time.perf_counter() - start < 30


def test_components(spark, monkeypatch):
    """In one task and in rounds the same."""
    links = [(1, 2), (2, 3), (9, 8), (5, 5), (3, 1), (7, 6), (6, 4), (4, 8)] + [(100 + i, 101 + i) for i in range(40)]
    name = lambda x: x.to_bytes(2)
    edges = spark.createDataFrame([(name(a), name(b)) for a, b in links], "a binary, b binary")
    want = {k: v for k, v in brute.roots({x for e in links for x in e}, links).items() if k != 5}
    for few in (linking.FEW, 0, 20):
        monkeypatch.setattr(linking, "FEW", few)
        got = {int.from_bytes(r.node): int.from_bytes(r.root) for r in linking.components(edges).collect()}
        assert got == want
    assert linking.components(edges.limit(0)).count() == 0


def test_vectors_of_any_length(spark, hot):
    """Squares that overflow or vanish; a component that is looked up through copies."""
    rows = [[1e200, 1e200], [1e200, 1.0001e200], [1e-200, 0.0], [2e-200, 0.0], [5e-324, 0.0], [0.0, 0.0], [1.0, 1.0], [-1.0, 0.0], [1e308, -1e308]]
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(rows)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in lattice.near_duplicates(df).collect()}
    assert got == {0: (2, 0), 1: (2, 0), 6: (2, 0), 2: (2, 2), 3: (2, 2), 4: (2, 2), 5: (0, 5), 7: (0, 7), 8: (0, 8)}
