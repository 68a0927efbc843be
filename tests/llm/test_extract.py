import re
from collections import defaultdict
from html.parser import HTMLParser

import numpy as np
import pytest

from barloom.llm import extract as X

SF = "/root/testdata/sf0.01"
WORDS = np.random.default_rng(4)


def prose(n, seed):
    return " ".join(f"w{x}" for x in np.random.default_rng(seed).integers(0, 5000, n)) + "."


def texts(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, run string, host string")
    return {r["page_id"]: r for r in X.main_texts(df, **more).collect()}


@pytest.mark.parametrize("seed", range(6))
def test_suffix_array(seed):
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 + seed, rng.integers(1, 60))
    order, common = X.suffix_array(a)
    t = [tuple(a[k:]) for k in range(len(a))]
    assert [t[k] for k in order] == sorted(t)
    for k in range(1, len(a)):
        x, y = t[order[k - 1]], t[order[k]]
        n = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
        assert common[k] == n
    assert len(X.suffix_array(np.zeros(0, np.int64))[0]) == 0


def test_classes_are_the_runs_of_all_streams():
    rng = np.random.default_rng(8)
    streams = [rng.integers(0, 3, n).astype(np.uint64) for n in (0, 5, 6, 40, 33, 40)]
    streams.append(streams[3])
    run, low, high = X.shard_classes(streams, 77)
    in_ = defaultdict(set)
    for s in streams:
        for h in X.runs(s, 77):
            in_[int(h)].add(s.tobytes())
    assert sorted(run.tolist()) == sorted(in_)
    assert {int(r) for r, lo, hi in zip(run, low, high) if lo != hi} == {h for h, s in in_.items() if len(s) > 1}


class Article(HTMLParser):
    """The texts of the article's blocks, by the standard library's parser."""

    def __init__(self, html):
        super().__init__()
        self.blocks, self.on = [""], False
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.on |= tag == "article"
        if tag not in ("a", "b", "i", "em", "span", "strong"):
            self.blocks.append("")

    def handle_endtag(self, tag):
        self.on &= tag != "article"
        if tag not in ("a", "b", "i", "em", "span", "strong"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.on:
            self.blocks[-1] += data


def test_whole_table_against_another_parser(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r for r in X.main_texts(pages).collect()}
    rows = pages.collect()
    streams, hits = defaultdict(set), {}
    for r in rows:
        want = " ".join(x for x in (" ".join(b.split()) for b in Article(r["html"]).blocks) if x)
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)
        host = re.match("[^/?#]*", r["url"].partition("://")[2])[0].lower()
        words = tuple(w for zone, t in X.blocks(r["html"]) if zone < X.MAIN for w in t.split())
        hits[r["page_id"]] = (host, words)
        for k in range(len(words) - X.RUN + 1):
            streams[host, words[k : k + X.RUN]].add(words)
    for i, (host, words) in hits.items():
        covered = {k + j for k in range(len(words) - X.RUN + 1) if len(streams[host, words[k : k + X.RUN]]) > 1 for j in range(X.RUN)}
        assert (got[i]["words_outside"], got[i]["words_repeated"]) == (len(words), len(covered))
    assert sum(r["words_repeated"] for r in got.values()) > 500


SITE = """<html><head><title>T {n}</title><style>p{{}}</style><script>if (a < b) "</p>"</script></head><body class="page sidebar-left">
<header><h2>Site</h2></header><nav><ul><li><a href=x>Home</a><li>News</ul></nav><div class="cookie-notice"><p>We use cookies {n}<p>Accept</div>
{body}<aside>Other <b>things</b> {n}</aside><form>Name <input> <button>Send</button></form>
<section id="comments"><article>First! {n}</article></section><div class='ad'>Buy {n} now</div><footer>&copy; {n}</footer></body></html>"""


def test_markup(spark):
    article = "<article><header><h1>Ti&shy;tle &amp; more</h1></header><p class=lead>One&nbsp;<b>tw</b>o\n three<br>four<p>five &lt;six&gt; &#x263A; &bogus;<div class='share'>Tweet</div><ul><li>a<li>b</ul><!-- <p>no</p> --><pre>x\n  y</pre></article>"
    main = "<main><p>alpha <div>beta</div></main>"
    rows = [(1, "http://H.example/a", SITE.format(n=1, body=article)), (2, "http://h.example/b", SITE.format(n=2, body=main)), (3, None, None), (4, "nohost", ""), (5, "http://h.example/c", "<p>open <a href='x>y'>li&amp"), (None, "http://h.example/a", SITE.format(n=3, body="<article></article>"))]
    got = texts(spark, rows + [rows[0]])
    assert got[1]["text"] == "Ti­tle & more One two three four five <six> ☺ &bogus; a b x y"
    assert got[2]["text"] == "alpha beta" and got[3]["text"] == got[4]["text"] == got[None]["text"] == ""
    assert got[5]["text"].startswith("open")
    assert len(texts(spark, [])) == 0


def plain(k, junk, seed):
    return f"<body><div>{junk}</div><div><p>{prose(80, seed)}</p><p>{prose(4, seed + 1)}</p></div><div>{junk.upper()} page {k}</div></body>"


@pytest.mark.parametrize("most", [X.MOST_CLASSES, 0])
@pytest.mark.parametrize("shard_words", [X.SHARD_WORDS, 100])
def test_repeats_of_a_host_go(spark, most, shard_words):
    junk = "sign up for our weekly letter of news and offers today"
    rows = [(k, "https://one.example/p" + str(k), plain(k, junk, 10 * k)) for k in range(6)]
    rows += [(20, "https://two.example/", plain(20, junk, 1000)), (21, "https://one.example/copy", rows[0][2])]
    got = texts(spark, rows, most=most, shard_words=shard_words)
    for k in range(6):
        assert got[k]["text"] == f"{prose(80, 10 * k)} {prose(4, 10 * k + 1)}", k
    assert got[21]["text"] == got[0]["text"]  # an exact copy is no second page
    assert junk in got[20]["text"] and got[20]["words_repeated"] == 0  # another host says it once


def test_near_copies_and_quotations_stay(spark):
    body = prose(300, 5)
    rows = [(k, "http://h.example/", f"<body><p>{body} edition {k}</p></body>") for k in range(5)]
    rows += [(10 + k, "http://h.example/", f"<body><article><p>{body}</p><p>{prose(9, 50 + k)}</p></article></body>") for k in range(4)]
    got = texts(spark, rows)
    assert all(got[k]["text"] == f"{body} edition {k}" for k in range(5))
    assert all(got[10 + k]["text"] == f"{body} {prose(9, 50 + k)}" for k in range(4))


def test_long_page(spark):
    long_ = "".join(f"<p>{prose(50, k)}</p>" for k in range(4000))
    got = texts(spark, [(1, "http://h.example/", f"<body>{long_}</body>"), (2, "http://h.example/", "<p>" * 50_000 + "end"), (3, "http://h.example/", "<div " * 20_000), (4, "http://h.example/", '<a "' * 5_000)])
    assert got[1]["n_chars"] == len(" ".join(prose(50, k) for k in range(4000)))
    assert got[2]["text"] == "end" and got[3]["text"] == ""


def test_wrappers():
    text = lambda html: X.main_text(X.blocks(html), np.zeros(0, np.int64))[0]
    body = "<article><h1>a</h1><form>f</form><p>b</p></article>"
    assert text(f"<form id=x><div>top</div>{body}<div>end</div></form>") == "a b"  # a page that is one form
    assert text(f'<div class="site has-sidebar"><div>{body}</div></div>') == "a b"
    assert text(f'<div class="menu-page"><nav>n</nav><main><p>m</p>{body}</main></div>') == "a b"
    assert text(f'{body}<div class="sidebar"><article>teaser</article></div><section id=comments><main>no</main><article>c</article></section>') == "a b"
    assert text(f"<nav><form>{body}</form></nav><p>x</p>") == "x"
    assert text('<div class="content with-sidebar"><p>one</p><span class=ad>no <span>not</span> never</span> two</div>') == "one two"
