"""Main text of pages: markup by hand-made pages, repeated strings against brute force, all pages of the smallest table."""

import html
import random
import re

import pytest
from pyspark.sql import functions as F

import topicpulse.llm.html_extract as H
from topicpulse.llm.html_extract import boilerplate, extract, host_of, read_page, streams

from conftest import SF_SMALL
from llm_cases import collected, words


def text_of(source):
    return [b[1] for b in read_page(source).sorted_blocks() if not b[0]]


def test_markup():
    page = """<!DOCTYPE html><HTML><head><title>no</title><style>p{}</style><script>var t="</p>";</script></head>
    <body class="has-sidebar"><header><h1>site</h1></header><nav><ul><li><a href="/a>b">menu</a></ul></nav><!-- <p>no</p> -->
    <div class="ad">buy</div><article id=story><header><h1>The   title</h1></header>
    <p>One <b>bold<br>line &amp; &lt;tag&gt; &copy; &#8364; &amp not &am<p>Two<i> words</i>
    <div class="share-box"><p>share</p></div><aside><p>side</p></aside><form><p>ask</p><input value="x"></form>
    <p>a < b and <span>c</span>d</p><script>if (a<b) x("<p>no</p>")</script><p hidden>gone</p><p></p><p> &nbsp; </p>
    <blockquote>quoted</blockquote><section class="comments"><article class="comment"><p>first!</p></article></section>
    </article><div><p>elsewhere</p></div><article class="comment">reader</article><footer>(c)</footer></body></html>"""
    assert text_of(page) == ["The title", "One bold line & <tag> © € & not &am", "Two words", "a < b and cd", "quoted"]


@pytest.mark.parametrize("source, want", [
    (None, []), ("", []), (" \n ", []), ("<article>", []), ("<article>plain", ["plain"]),
    ("<article><p>one<p>two <b", ["one", "two"]), ("<article><p>one</article", ["one"]),
    ("<main><p>a</p></main><p>b", ["a"]), ("<div role='main'><p>a</p></div><p>b", ["a"]),
    ("<article><p>x<!-- never closed <p>y", ["x"]), ("<article><script>never closed <p>y", []),
    ("<article><p>İ<script>x</script><p>tail", ["İ", "tail"]), ("<nav><article><p>teaser</p></article></nav><article><p>a", ["a"]),
    ("<article><p>" + "long " * 300_000, ["long " * 299_999 + "long"])])
def test_odd_pages(source, want):
    assert text_of(source) == want


def test_hosts():
    urls = {"http://A.example.com:80/x": "a.example.com", "https://u:p@b.org?q": "b.org", "": "", None: "", "no url": "",
            "https://[::1]:8/": "[::1]", "http://c.net.": "c.net"}
    assert {u: host_of(u) for u in urls} == urls


def soup(rng, menu, foot, n=3):
    """A page without an article: menu and foot in plain boxes around paragraphs of its own."""
    own = "".join(f"<p>{words(rng, rng.randint(3, 30))}</p>" for _ in range(n))
    return f"<body><div><span>{menu}</span><ul><li>home</li><li>about</li></ul></div>{own}<div>{foot}</div></body>"


def brute_found(rows):
    """(host, tokens) -> the tokens that strings of RUN tokens cover which stand on another page of the host, too."""
    pages = {(host_of(u), tuple(read_page(h).tokens)) for _, u, h in rows}
    strings = {}
    for host, t in pages:
        for i in range(len(t) - H.RUN + 1):
            strings.setdefault((host, t[i:i + H.RUN]), set()).add(t)
    return {(host, t): {i + k for i in range(len(t) - H.RUN + 1) if len(strings[host, t[i:i + H.RUN]]) > 1 for k in range(H.RUN)}
            for host, t in pages}


def brute_text(url, source, found):
    page = read_page(source)
    blocks = page.sorted_blocks()
    covered = found[host_of(url), tuple(page.tokens)]
    kept = [t for is_open, t, a, b in blocks if not is_open or not set(range(a, b + 1)) <= covered]
    return "\n".join(kept or [b[1] for b in blocks])


def soup_rows():
    rng = random.Random(8)
    rows = []
    for host, n in (("hot.org", 120), ("b.org", 25), ("one.org", 1)):
        foots = [words(rng, 6) for _ in range(3)]
        rows += [(len(rows) + i, f"http://{host}/{i}", soup(rng, "our menu", rng.choice(foots))) for i in range(n)]
    rows += [(900 + i, "http://hot.org/copy", rows[5][2]) for i in range(30)]                         # one page, many times
    rows += [(950 + i, "http://hot.org/near", rows[6][2].replace("home", f"home {i}")) for i in range(9)]
    rows += [(None, None, None), (None, "x", ""), (970, None, "<p>alone</p>"), (971, "http://b.org", "<p>b")]
    rows += [(972, "http://b.org/t", "<article><h1>T</h1><ul><li>one</li><li>two of it</li></ul><p>own</p></article>"),
             (973, "http://b.org/u", "<article><h1>T</h1><ul><li>one</li><li>three</li></ul><p>own, too</p></article>")]
    return rows


@pytest.mark.parametrize("limit", [1_000_000, 400])
def test_repeated_strings_match_brute_force(spark, limit):
    rows = soup_rows()
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = brute_found(rows)
    read = streams(df)
    got = {bytes(r.d): {k for f in r.found for k in range(f.a, f.b + 1)} for r in boilerplate(read, limit).collect()}
    for host, t in want:
        assert got.get(H.digest(host, H.hashed(list(t))), set()) == want[host, t]
    assert sum(map(len, want.values())) > 1000


@pytest.mark.parametrize("limit", [1_000_000, 400])
def test_extraction_matches_brute_force(spark, limit):
    rows = soup_rows()
    found = brute_found(rows)
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns(
        {c: F.lit(1) for c in ("text", "host", "d", "stream", "blocks", "found", "n_chars", "shard", "a.b")})
    want = [(i, u, t, len(t)) for i, u, h in rows for t in [brute_text(u, h, found)]]
    got = extract(df, shard_tokens=limit)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert collected(got) == sorted(want, key=repr)
    texts = {i: t for i, _, t, _ in want}
    assert "menu" not in texts[0] and "home" not in texts[0] and "our menu" in texts[145]     # alone on its host
    assert texts[972] == "T\ntwo of it\nown" and extract(df.limit(0)).collect() == []


def test_whole_table_matches_its_template(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/pages.parquet").select("page_id", "url", "html").collect()]
    want = []
    for i, u, h in rows:
        article = re.search(r"<article>(.*?)</article>", h, re.S).group(1)
        pieces = (" ".join(html.unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>|<br>", article))
        text = "\n".join(x for x in pieces if x)
        want.append((i, u, text, len(text)))
    assert collected(extract(spark.read.parquet(f"{SF_SMALL}/pages.parquet"))) == sorted(want, key=repr)
