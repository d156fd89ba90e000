"""Odd rows and brute-force comparisons for the operators on pages, embeddings and conversations."""

import gzip
import hashlib

import numpy as np
import pytest

from seqloom.llm import archives, chat, lattice
from seqloom.llm.html import Page, extracted, text_report
from tests.llm import brute

PAGES = "page_id long, url string, html string, text string, host string"


@pytest.mark.parametrize("few", [True, False])
def test_archive_round_trip(spark, monkeypatch, few):
    """With repeated digests broadcast, and salted as when they are too many for that."""
    if not few:
        monkeypatch.setattr(archives, "bounded", lambda df: df)
    big, small = "<p>é</p>" * 30, "<p>x</p>"
    rows = [
        (5, "http://a.example/x y", big), (3, "http://b.example/", big), (9, None, big), (4, "http://a.example/", small), (2, "u", small),
        (7, "http://c.example/", None), (8, "http://c.example/", ""), (6, "http://d.example/", "WARC/1.1\r\n\r\n\nfiledesc://x\r\n" * 9),
        (5, "http://a.example/x y", big), (None, "http://e.example/", "z" * 200), (11, "http://f.example/", "q" * 300_000),
    ]
    pages = spark.createDataFrame([(*r, "t", "h") for r in rows], PAGES).repartition(4)
    got = archives.archive_report(pages).collect()
    assert len(got) == len(rows)
    want = sorted((r[0] or -1, len((r[2] or "").encode()), hashlib.sha256((r[2] or "").encode()).hexdigest()) for r in rows)
    assert sorted((g.page_id or -1, g.payload_bytes, g.payload_digest) for g in got) == want
    kinds = sorted((g.page_id or -1, g.record_type, g.refers_to or -1) for g in got if g.payload_bytes == len(big.encode()))
    assert kinds == [(3, "response", -1), (5, "revisit", 3), (5, "revisit", 3), (9, "revisit", 3)]
    assert {g.record_type for g in got if g.payload_bytes < 100} == {"response"}
    assert archives.archive_report(spark.createDataFrame([], PAGES)).count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_arc_lines(version):
    body = f"{version} 0 me\n{archives.ARC_FIELDS[version]}\n".encode()
    extra = " 200 - - 0 f" if version == 2 else ""
    data = f"filedesc://f 0.0.0.0 2001 text/plain{extra} {len(body)}\n".encode() + body + b"\n"
    content = b"HTTP/1.1 200 OK\r\n\r\nhello\n\nhttp://no 1 2 3 4\n"
    data += f"http://a/b c 1.2.3.4 20010203040506 text/html{extra} {len(content)}\n".encode() + content + b"\n"
    for raw in (data, gzip.compress(data)):
        (fields, _, block), = archives.parse_arc(raw)
        assert fields["URL"] == "http://a/b c" and fields["Archive-date"] == "20010203040506" and block == content
    with pytest.raises(ValueError, match="shorter"):
        list(archives.parse_arc(data[:-9]))
    with pytest.raises(ValueError, match="version block"):
        list(archives.parse_arc(b"http://a 1.2.3.4 2001 text/html 0\n\n"))
    assert archives.iso_date("20010203040506") == "2001-02-03T04:05:06Z" and archives.iso_date("2001") == "2001-01-01T00:00:00Z"


HTML_CASES = [
    ("", ""),
    ("just text", "just text"),
    ("<article><h1>A &amp; B</h1><p>one <b>two</b>three<p>four<br>five</article>", "A & B\none twothree\nfour five"),
    ("<body><nav>m</nav><article><p>x</p><aside>s</aside><form>f<input></form></article><footer>g</footer>", "x"),
    ("<div class='site-header'>h</div><div><p>keep &lt;b&gt; &#233;</p></div><div class='ad'>buy</div>", "keep <b> é"),
    ("<article><p>x</p><section id=comments><article><p>nice</p></article></section></article>", "x"),
    ("<main><p>a<!-- c --><script>var t='</p>';</script>b</p></main><div class=cookie-notice>c</div>", "ab"),
    ("<article><ul><li>1<li>2</ul><table><tr><td>3<td>4</table></article>", "1\n2\n3\n4"),
    ("<p>open <b>tag<p>next <!-- never closed", "open tag\nnext"),
    ("<p title='a>b'>q</p><p hidden>h</p>", "q"),
    ("<article><header><h1>T</h1></header><p>1 < 2 &nbsp; x\n y</p></article>", "T\n1 < 2 x y"),
]


@pytest.mark.parametrize(("source", "want"), HTML_CASES)
def test_html_text(source, want):
    assert Page(source).text() == want


NAMES = [
    ("<div class='layout has-sidebar'><article><p>a</p></article></div>", "a"),
    ("<body><div class=nav-open><div class=no-banner><article><p>a</p></article></div></div></body>", "a"),
    ("<div class=sidebar><main><p>a</p></main></div>", "a"),
    ("<div class=with-comments><p>the whole text</p></div><div class=ad>b</div>", "the whole text"),
    ("<div class=widget><p>the whole text</p></div><p>b</p>", "the whole text\nb"),
    ("<article><h2 id=related-work>R</h2><p class=notice>n</p><section id=comments-on-the-method>m</section><div id=share-price>s</div></article>", "R\nn\nm\ns"),
    ("<article><p>some text</p><div class='share-buttons'>s</div><div id=related-posts>r</div></article>", "some text"),
    ("<article><p>a</p></article><div id=comments><article><p>a longer comment</p></article></div>", "a"),
]


@pytest.mark.parametrize(("source", "want"), NAMES)
def test_html_names(source, want):
    assert Page(source).text() == want


def test_deep_and_broken_html():
    assert Page("<div>" * 20_000 + "x").text() == "x"
    assert Page("<" * 3000).text() == "<" * 3000
    assert Page("<p>a" * 5000).text().count("\n") == 4999


def test_site_template(spark):
    """What recurs on a host's pages goes without any telling name; what is an article's own stays."""
    box = "<div class=q7><span>Read our house rules</span></div>"
    rows = [(i, f"http://h.example/{i}", f"<body>{box}<div class=m><p>Story number {i} " + "goes on " * 20 + "</p></div></body>") for i in range(12)]
    rows += [(100 + i, f"http://k.example/{i}", f"<body>{box}<div class=m><p>Other {i} " + "text " * 20 + "</p></div></body>") for i in range(2)]
    same = "<article><p>A passage that every page quotes.</p><p>Own {}</p></article>"
    rows += [(200 + i, f"http://q.example/{i}", same.format(i)) for i in range(10)]
    rows += [(300, None, None), (301, "", ""), rows[0]]
    pages = spark.createDataFrame([(*r, "t", "h") for r in rows], PAGES).repartition(3)
    got = {r.page_id: r.text for r in text_report(pages).collect()}
    assert all("house rules" not in got[i] and got[i].startswith("Story") for i in range(12))
    assert all("house rules" in got[100 + i] for i in range(2))  # two pages are no template
    assert got[205] == "A passage that every page quotes.\nOwn 5"
    assert got[300] == "" and got[301] == ""
    assert extracted(pages, "found").columns == [*pages.columns, "found"]
    assert text_report(spark.createDataFrame([], PAGES)).count() == 0


def test_template_inside_articles(spark):
    """Only the counts can tell: all blocks are paragraphs, lists and headings of articles without a name."""
    box = "<p>Subscribe to our letter.</p>"
    links = "<h2>Read more</h2><ul><li>One<li>Two</ul>"
    quote = "<p>To be, or not to be, he said.</p>"

    def own(i, n=6):
        return [f"<p>Own passage {k} of article {i} " + f"word{i * 7 + k} " * 8 + "</p>" for k in range(n)]

    rows = []
    for i in range(200):  # a large host: box on 8 pages, quote on 6 of the others at different places, links on 100
        p = own(i)
        if 20 <= i < 26:
            p.insert(i - 20, quote)
            p += own(1000 + i, 2 * (i - 20))
        body = "<h2>Introduction</h2>" + "".join(p) + (box if i < 8 else "") + (links if i % 2 else "")
        rows.append((i, f"http://big.example/{i}", f"<article>{body}</article>"))
    copied = own(5000, 10)
    for i in range(6):  # one article at six addresses, with another date each
        rows.append((300 + i, f"http://copy.example/{i}", "<article>" + "".join(copied) + f"<p>Read on day {i}</p></article>"))
    pages = spark.createDataFrame([(*r, "t", "h") for r in rows], PAGES).repartition(3)
    got = {r.page_id: r.text for r in text_report(pages).collect()}
    assert all("Subscribe" not in got[i] for i in range(8))
    assert all("Read more" not in got[i] and "Two" not in got[i] for i in range(200))
    assert all("To be, or not to be" in got[i] for i in range(20, 26))
    assert all(got[i].startswith("Introduction\n") and got[i].count("Own passage") >= 6 for i in range(200))
    assert all(got[300 + i].count("Own passage") == 10 and got[300 + i].endswith(f"day {i}") for i in range(6))


def embeddings(seed=3, dims=16):
    rng = np.random.default_rng(seed)
    rows = []
    for label in range(3):
        for _ in range(40):
            v = rng.normal(size=dims)
            rows.append((v, label))
            for _ in range(rng.integers(0, 3)):
                rows.append((v + rng.normal(size=dims) * rng.choice([0.02, 0.04, 0.06, 0.1]), label))
    v = rng.normal(size=dims)
    rows += [(v + rng.normal(size=dims) * 0.03, 1) for _ in range(60)]
    return [(i, [float(np.float32(x)) for x in v], label) for i, (v, label) in enumerate(rows)]


def expected(rows):
    links, n = [], {}
    good = [(i, np.array(v, float), lab) for i, v, lab in rows if v and lab is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    for i, v, a in good:
        n[i] = 0
        for j, w, b in good:
            if i != j and a == b and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= lattice.COSINE:
                n[i] += 1
                links.append((i, j))
    ids = [r[0] for r in rows]
    found = brute.roots(ids, links)
    return {i: (n.get(i, 0), found[i]) for i in ids}


def test_embeddings(spark, monkeypatch):
    rows = embeddings()
    k = len(rows)
    rows += [(k, rows[0][1], 0), (k + 1, rows[0][1], 0), (k + 2, rows[0][1], None), (k + 3, None, 1), (k + 4, [], 1), (k + 5, [0.0] * 16, 1)]
    rows += [(k + 6, [None] + [1.0] * 15, 1), (k + 7, [float("nan")] * 16, 1), (k + 8, [float("inf")] + [1.0] * 15, 1), (k + 9, [1.0] * 8, 1), (k + 10, [2.0] * 8, 1)]
    monkeypatch.setattr(lattice, "BLOCK", 16)
    monkeypatch.setattr(lattice, "COUNT_BLOCK", 16)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, node string, unit int").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id) for r in lattice.near_duplicates(df).collect()}
    assert got == expected(rows)
    assert lattice.near_duplicates(df.limit(0)).count() == 0


def test_lattice_points():
    x = np.random.default_rng(1).normal(size=(500, 8)) * 2
    p = lattice.nearest(x)
    steps = lattice.minimal_vectors()
    assert steps.shape == (240, 8)
    whole = (p == np.rint(p)).all(1) | (p - 0.5 == np.rint(p - 0.5)).all(1)
    assert whole.all() and (p.sum(1) % 2 == 0).all()
    near = ((x - p) ** 2).sum(1)
    for s in steps:
        assert (near <= ((x - p - s) ** 2).sum(1) + 1e-9).all()


def test_recall():
    rng = np.random.default_rng(7)
    a = rng.normal(size=(3000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    z = rng.normal(size=a.shape)
    z -= (z * a).sum(1, keepdims=True) * a
    b = lattice.COSINE * a + np.sqrt(1 - lattice.COSINE**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    met = np.zeros(len(a), bool)
    for (x, near_x), (y, near_y) in zip(lattice.cells(a), lattice.cells(b), strict=True):
        met |= (x == y) | (near_x == y[:, None]).any(1) | (near_y == x[:, None]).any(1)
    assert met.mean() >= 0.999


TURNS = "pair_id long, turn long, role string, text string"


def test_preferences(spark):
    chosen = [(1, 0, "User", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", "ok"), (2, 0, "user", "a"), (3, 0, None, None), (4, 0, "user", "only")]
    rejected = [(1, 0, "user", "hi"), (1, 1, "assistant", "no <|im_end|>"), (2, 0, "user", "a"), (3, 0, "", ""), (5, 0, "assistant", "x")]
    got = {r.pair_id: r for r in chat.preference_pairs(spark.createDataFrame(chosen, TURNS), spark.createDataFrame(rejected, TURNS)).collect()}
    one = got[1]
    assert one.prompt == "<|im_start|>user\nhi<|im_end|>\n" and one.n_prefix_turns == 1
    assert one.chosen == "<|im_start|>assistant\nyes<|im_end|>\n<|im_start|>user\nok<|im_end|>\n"
    assert [one.chosen[s.start : s.stop] for s in one.chosen_spans] == ["yes<|im_end|>"]
    assert [one.rejected[s.start : s.stop] for s in one.rejected_spans] == ["no < |im_end|><|im_end|>"]
    assert (got[2].n_prefix_turns, got[2].chosen, got[2].rejected) == (1, "", "")
    assert got[3].n_prefix_turns == 1 and got[4].n_prefix_turns == 0 and got[4].rejected == ""
    assert got[5].chosen == "" and len(got[5].rejected_spans) == 1


def test_chat_of_odd_rows(spark):
    rows = [
        (1, 0, "user", "q"), (1, 1, "assistant", "first answer"), (1, 2, "user", "r"), (1, 3, "assistant", "second"),
        (2, 0, "user", "q"), (2, 1, "assistant", "four words in here"), (3, 0, "user", "alone"), (4, None, None, None), (None, 0, "assistant", ""),
        (5, 0, "assistant", "same"), (5, 1, "assistant", "same"), (5, 1, "assistant", "same"),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, chosen string")
    got = {r.conv_id: r for r in chat.chat_report(df).collect()}
    assert len(got) == 6
    assert "second" in got[1].chosen and "first answer" in got[1].rejected and got[1].n_prefix_turns == 3
    assert "four words<|im_end|>" in got[2].rejected
    assert got[3].chosen == got[3].rejected == "" and got[4].n_prefix_turns == 1
    assert chat.chat_report(df.limit(0)).count() == 0
