import random
import time

import numpy as np
import pytest

from pagewright.llm import html_text

PAGES = "page_id long, url string, html string, host string"
BODY = """<html><body><nav>menu</nav><article><div class="article-header"><h1>Title</h1></div><h2 id="social-impact">Impact</h2><p>One.</p>
<h2 id="related-work">Related work</h2><section id="share-of-votes"><p class="notice">Two.</p></section><div class="share-buttons">Tweet this</div>
<div class="newsletter">Sign up</div></article></body></html>"""


def test_names_of_headings_and_sections_do_not_drop_article_text():
    assert html_text.texts([BODY]) == ["Title\nImpact\nOne.\nRelated work\nTwo."]
    assert "Impact" in html_text.texts(['<body><h2 id="social-impact">Impact</h2><p class="notice">Text.</p></body>'])[0]


def test_reader_comments_go():
    page = '<article><h1>T</h1><p>Body</p><article class="comment"><p>Reader</p></article><div id="comments"><p>More</p></div></article><article class="user-comment">Last</article>'
    assert html_text.texts([page]) == ["T\nBody"]
    assert html_text.texts(['<article class="comment">Real</article><article><p>Text</p></article>']) == ["Text"]


def test_blocks_of_most_pages_go_inside_articles_too():
    page = "<body><article><h1>Title {0}</h1><p>Text {0} of its own.</p>{1}<p>Share this with all your friends.</p></article></body>"
    passage = "<p>A passage that two articles share.</p>"
    got = html_text.texts([page.format(k, passage if k < 2 else "") for k in range(8)])
    assert got == [f"Title {k}\nText {k} of its own." + ("\nA passage that two articles share." if k < 2 else "") for k in range(8)]


@pytest.mark.parametrize("n", range(11))
def test_pages_of_few_tokens(n):
    words = " ".join(f"w{k}" for k in range(n))
    assert html_text.texts([f"<p>{words}</p>"]) == [words]
    assert html_text.texts([words, "x y", None, ""]) == [words, "x y", "", ""]


@pytest.mark.parametrize(
    "unit,text",
    [("<a ", None), ("<div>x", "x"), ("<i>", ""), ("</x>", ""), ("<li>a<div>", None), ("<td>a<dd>b<li>", None), ("<a x='", None), ('<b x="1">y</b>', None), ("<!--", ""), ("<title>", ""), ("<p>a &amp; b", None)],
)
def test_time_is_in_proportion_to_broken_markup(unit, text):
    def seconds(n):
        start = time.process_time()
        got = html_text.texts([unit * n])[0]
        assert text is None or got.replace("\n", "") == text * n
        return time.process_time() - start

    seconds(100)
    assert seconds(40_000) <= 12 * max(seconds(10_000), 0.05)


def host(rng, n, declared):
    """Pages with their texts: a menu, a notice with a date in it, and in some articles a passage that others share."""
    menu, shared = [f"menu{k}" for k in range(12)], "a passage that several articles of the host have in common with others " * 2
    notice = "all of this is owned by the makers of this site and nobody may copy any of it without asking first"
    out = []
    for k in range(n):
        body = [" ".join(f"w{rng.randrange(500)}" for _ in range(30)) for _ in range(3)] + ([shared.strip()] if k % 9 == 0 else [])
        inner = "".join(f"<p>{b}</p>" for b in body)
        wrap = f"<article>{inner}</article>" if declared else f"<section>{inner}</section>"
        out.append((f"<div><span>{' '.join(menu)}</span></div>{wrap}<center>{notice} since {k}</center>", "\n".join(body)))
    return out


@pytest.mark.parametrize("declared", [True, False])
def test_a_host_over_many_partitions(spark, declared):
    rng = random.Random(4)
    pages = host(rng, 240, declared)
    assert html_text.texts([p for p, _ in pages]) == [t for _, t in pages]
    rows = [(k, f"https://a.example/{k}", p, "h") for k, (p, _) in enumerate(pages)]
    rows += [(1000 + k, f"https://b.example/{k}", p, None) for k, (p, _) in enumerate(host(rng, 3, declared))]
    rows += [(2000, None, None, None), (2000, None, None, None), (None, "https://a.example/x", pages[0][0], "h"), (2001, None, "<p>alone</p>", "h")]
    want = {}
    for h in ("https://a", "https://b", "None"):
        own = [r for r in rows if str(r[1]).startswith(h)]
        for r, t in zip(own, html_text.texts([r[2] for r in own])):
            want[r[0]] = t
    for parts in (1, 50):
        got = html_text.extract(spark.createDataFrame(rows, PAGES).repartition(parts)).collect()
        assert len(got) == len(rows) and {r.page_id: r.text for r in got} == want
        assert all(r.n_chars == len(r.text) for r in got)


def test_an_empty_table(spark):
    assert html_text.extract(spark.createDataFrame([], PAGES)).count() == 0


def test_suffix_array_against_brute_force():
    rng = random.Random(2)
    for n in (0, 1, 2, 9, 60, 300):
        pages = [[rng.randrange(3) for _ in range(rng.randrange(n + 1))] for _ in range(5)] + [[1] * n, [1] * n]
        flat = [x for p in pages for x in p]
        stops = [sum(map(len, pages[: k + 1])) for k, p in enumerate(pages) for _ in p]
        order, shared = html_text.suffix_array(np.array(flat, np.int64), np.array(stops, int))
        own = [flat[i : stops[i]] for i in order]
        assert sorted(order) == list(range(len(flat))) and own == sorted(own)
        for k in range(1, len(own)):
            assert shared[k] == next((m for m, (x, y) in enumerate(zip(own[k - 1], own[k])) if x != y), min(len(own[k - 1]), len(own[k])))
        streams = [np.array(p, np.uint32) for p in pages]
        for p, held in zip(pages, html_text.holders(streams, np.zeros(len(pages), int))):
            runs = [tuple(p[k : k + 8]) for k in range(len(p) - 7)]
            has = [{tuple(q[k : k + 8]) for k in range(len(q) - 7)} for q in pages]
            assert held[: len(runs)].tolist() == [sum(r in h for h in has) for r in runs]


NOTICE = "<p>all of this is owned by the makers of this site and nobody may copy any of it since {0}</p>"


def test_runs_of_most_pages_go_inside_articles():
    pages = [f"<article><p>Text {k} of its own, by x{k}, about y{k}.</p>{NOTICE.format(k)}</article>" for k in range(6)]
    assert html_text.texts(pages) == [f"Text {k} of its own, by x{k}, about y{k}." for k in range(6)]
    assert all("owned" in t for t in html_text.texts(pages[:3]))


@pytest.mark.parametrize("declared", [True, False])
def test_a_large_host_in_parts(spark, monkeypatch, declared):
    rng = random.Random(9)
    pages = [p + (f"<article>{NOTICE.format(k)}</article>" if declared else "") for k, (p, _) in enumerate(host(rng, 150, declared))]
    want = html_text.texts(pages)
    monkeypatch.setattr(html_text, "PART_PAGES", 20)
    rows = [(k, f"https://a.example/{k}", p, "h") for k, p in enumerate(pages)] + [(k, "https://a.example/again", pages[0], "h") for k in range(900, 1000)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, PAGES).repartition(7)).collect()}
    assert [got[k] for k in range(len(pages))] == want and {got[k] for k in range(900, 1000)} == {want[0]}
    assert not any("owned" in t for t in want)
