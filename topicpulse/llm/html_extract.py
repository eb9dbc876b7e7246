"""Main text of web pages: markup first, then what a host's suffix array finds repeated.

A page is read as a stream of tokens: its tags (with their classes) and, between them, its pieces of
visible text. Its blocks of text are sorted by their markup into three kinds:

* out: inside menus, page headers and footers, sidebars, notices, adverts, forms, reader comments,
  scripts and the like (by element, role or class), and, on a page with an article, outside it;
* prose: headings, paragraphs, quotations and plain text of the article, kept as they are;
* open: the other blocks of an article (lists, boxes, tables), and every block of a page without an
  article or main element. For these the host decides.

The token streams of a host's pages are put end to end, and a suffix array over them (suffixes sorted by
their first ``RUN`` tokens, by prefix doubling) brings the places of equal strings together: a string of
``RUN`` tokens or more that stands on two different pages is boilerplate. An open block all of whose text
such strings cover goes, and what is unique stays; a page of which nothing unique would be left has no
text of its own to be told from boilerplate (a near copy) and keeps its open blocks.

A host may have a third of all pages: its pages are dealt out to shards of a bounded number of tokens, each with a
suffix array of its own. Of a host with several shards each shard also gives out the strings of its array,
one row for a string that it knows as repeated, and strings that two shards have are repeated, too. Nothing is
lost to the shards' borders, and no string has more rows than shards and places in one page.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import OUT_ROWS, written
from .suffix_dedup import suffix_ranks

#: Tokens of the shortest string that counts as repeated: a piece of text with three tags around it.
RUN = 4
#: Tokens that one suffix array is built over (a longer page is a shard of its own).
SHARD = 1_000_000

# --- fixed values: elements of HTML by what they hold ---
OUT_ELEMENTS = set("""
head script style noscript template iframe object embed applet svg math canvas audio video map datalist dialog menu
nav aside form button select textarea fieldset
""".split())
PAGE_PARTS = {"header", "footer"}          # of the page; inside an article they belong to it
RAW_ELEMENTS = {"script", "style", "textarea", "title", "noscript", "iframe"}
VOID_ELEMENTS = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK_ELEMENTS = set("""
address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section
summary table tbody td tfoot th thead title tr ul
""".split())
PROSE_ELEMENTS = set("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption article main".split())
OUT_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu"}
COMMENT_WORDS = {"comment", "comments", "disqus", "respond"}
OUT_WORDS = COMMENT_WORDS | set("""
ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs consent cookie cookies footer gdpr header
masthead menu modal nav navbar navigation newsletter notice pagination popup promo related share sharing sidebar
social sponsor sponsored subscribe toolbar widget
""".split())
CLOSES_ITSELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
                 "th": {"td", "th"}, "option": {"option"}}

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^"'>]++|"[^"]*+"|'[^']*+')*+)>|<[!?/][^>]*+(?:>|\Z)""", re.S)
BROKEN_OFF = re.compile(r"<[a-zA-Z!?/][^>]*\Z")
ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
LETTERS = re.compile(r"[a-z0-9]+")
HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", re.I)


def host_of(url: str | None) -> str:
    found = HOST.match((url or "").strip())
    return found.group(1).lower().rstrip(".") if found else ""


@dataclass
class Element:
    name: str
    out: bool
    article: bool
    token: str


@dataclass
class Page:
    """Blocks as (is prose, inside an article, text, first and last token), and the stream of tokens."""
    blocks: list[tuple] = field(default_factory=list)
    tokens: list[str] = field(default_factory=list)

    def sorted_blocks(self) -> list[tuple[bool, str, int, int]]:
        """(open, text, first and last token) of the blocks that markup alone doesn't put out."""
        has_article = any(b[1] for b in self.blocks)
        return [(not prose or not has_article, text, a, b) for prose, inside, text, a, b in self.blocks
                if inside or not has_article]


def attributes(text: str) -> dict[str, str]:
    found = {}
    for m in ATTRIBUTE.finditer(text):
        value = m.group(2) or ""
        found.setdefault(m.group(1).lower(), value[1:-1] if value[:1] in "\"'" and value else value)
    return found


def judged(name: str, attrs: str, above: Element | None) -> Element:
    """An element with what its markup says: whether its text is out, and whether it is in an article."""
    out, article = (above.out, above.article) if above else (False, False)
    token = name
    words: set[str] = set()
    role = ""
    if attrs.strip(" /"):
        known = attributes(attrs)
        role = known.get("role", "").lower()
        label = html.unescape(f"{known.get('class', '')} {known.get('id', '')}").lower()
        words = set(LETTERS.findall(label))
        if words:
            token = f"{name}.{'.'.join(sorted(words))}"
        out = out or "hidden" in known or known.get("aria-hidden", "").lower() == "true"
    if name == "article" or name == "main" or role == "main" or role == "article":
        out = out or bool(words & COMMENT_WORDS)
        article = article or not out
    elif name not in ("html", "body"):
        out = out or name in OUT_ELEMENTS or (name in PAGE_PARTS and not article) or role in OUT_ROLES \
            or bool(words & OUT_WORDS)
    return Element(name, out, article, token)


def read_page(source: str | None) -> Page:
    """Blocks and tokens of a page. Tags that are never closed and pages that break off are read as far as they go."""
    page, source = Page(), source or ""
    stack: list[Element] = []
    held: list[str] = []            # pieces of the block that is being read
    places: list[int] = []          # their tokens
    tokens = page.tokens
    last = source.rfind(">")

    def flush() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text and places:
                top = next((e for e in reversed(stack) if e.name in BLOCK_ELEMENTS), None)
                inside = bool(stack) and stack[-1].article
                page.blocks.append((top is None or top.name in PROSE_ELEMENTS, inside, text, places[0], places[-1]))
            held.clear()
            places.clear()

    def piece(text: str) -> None:
        if text:
            shown = not (stack and stack[-1].out)
            if not text.isspace():
                if shown:
                    places.append(len(tokens))
                tokens.append(" ".join(text.split()))
            if shown:
                held.append(text)

    def close(upto: int) -> None:
        del stack[upto:]

    at = 0
    while True:
        m = TAG.search(source, at) if at <= last else None
        if m is None:
            cut = BROKEN_OFF.search(source, at)                 # the page breaks off inside a tag
            piece(source[at:cut.start()] if cut else source[at:])
            break
        piece(source[at:m.start()])
        at = m.end()
        name = (m.group(2) or "").lower()
        if not name:
            continue                                            # a comment or declaration
        block = name in BLOCK_ELEMENTS
        if m.group(1):
            here = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].name == name), None)
            if block or name in OUT_ELEMENTS:
                flush()
            if here is not None:
                # an inline element's end doesn't close blocks
                if block or name in OUT_ELEMENTS or not any(e.name in BLOCK_ELEMENTS for e in stack[here:]):
                    close(here)
            tokens.append(f"</{name}>")
            continue
        if name == "br":
            held.append(" ") if held else None
        if block or name in OUT_ELEMENTS:
            flush()
            ends = CLOSES_ITSELF.get(name, set()) | ({"p"} if block else set())
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].name in ends:
                    close(i)
                    break
                if stack[i].name in BLOCK_ELEMENTS:
                    break
        element = judged(name, m.group(3), stack[-1] if stack else None)
        tokens.append(f"<{element.token}>")
        if name in VOID_ELEMENTS or m.group(3).endswith("/"):
            continue
        if name in RAW_ELEMENTS:
            end = re.compile(f"</{name}", re.I).search(source, at)
            at = end.start() if end else len(source)
        stack.append(element)
    flush()
    return page


def hashed(tokens: list[str]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest
    return np.array([xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) for t in tokens], np.uint64).view(np.int64)


def digest(host: str, stream: np.ndarray) -> bytes:
    """128 bits that name a page's stream on its host: pages that differ in comments and scripts only are one page."""
    from hashlib import blake2b
    return blake2b(stream.tobytes(), digest_size=16, key=blake2b(host.encode()).digest()[:32]).digest()


BLOCKS = T.ArrayType(T.StructType([T.StructField("open", T.BooleanType()), T.StructField("text", T.StringType()),
                                   T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType())]))
ARROW_BLOCKS = pa.list_(pa.struct([("open", pa.bool_()), ("text", pa.string()), ("a", pa.int32()), ("b", pa.int32())]))


def streams(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, d, stream, blocks) of ``pages(page_id, url, html)``; blocks only of pages with open ones."""
    kind = pages.schema["page_id"].dataType

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, OUT_ROWS):
                part = batch.slice(at, OUT_ROWS)
                rows = []
                for url, source in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    page, host = read_page(source), host_of(url)
                    stream = hashed(page.tokens)
                    blocks = page.sorted_blocks()
                    rows.append((host, digest(host, stream), stream, [dict(zip(("open", "text", "a", "b"), b)) for b in blocks]
                                 if any(b[0] for b in blocks) else None))
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1)] + [pa.array(c, type=t) for c, t in zip(columns, (
                        pa.string(), pa.binary(), pa.list_(pa.int64()), ARROW_BLOCKS))],
                    names=["page_id", "url", "host", "d", "stream", "blocks"])

    schema = T.StructType([T.StructField("page_id", kind), T.StructField("url", T.StringType()),
                           *T.StructType.fromDDL("host string, d binary, stream array<bigint>").fields,
                           T.StructField("blocks", BLOCKS)])
    return pages.mapInArrow(run, schema)


def repeated_windows(pages: list[np.ndarray], groups: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(page, place, rank, whether on two pages) of all strings of ``RUN`` tokens of the pages' streams, by their suffix array.

    Pages of different groups (hosts) have no strings in common.
    """
    sizes = np.array([len(p) for p in pages])
    which = np.repeat(np.arange(len(pages)), sizes)
    tokens = np.concatenate(pages)
    group = np.array(groups, np.int64)[which]
    order = np.lexsort((tokens, group))
    new = np.ones(len(order), bool)
    new[1:] = (tokens[order][1:] != tokens[order][:-1]) | (group[order][1:] != group[order][:-1])
    symbols = np.empty(len(order), np.int64)
    symbols[order] = np.cumsum(new) - 1
    ranks = suffix_ranks(symbols, RUN)
    starts = np.arange(len(ranks))
    inside = which[starts] == which[starts + RUN - 1]
    starts = starts[inside]
    rank, page = ranks[inside], which[starts]
    # the suffix array: equal strings are neighbours, those of one page next to each other
    order = np.lexsort((page, rank))
    same = rank[order[1:]] == rank[order[:-1]]
    other = same & (page[order[1:]] != page[order[:-1]])
    twice = np.zeros(int(rank.max(initial=-1)) + 1, bool)
    twice[rank[order[1:]][other]] = True
    place = starts - (np.cumsum(sizes) - sizes)[page]
    return page, place, rank, twice[rank]


def ranges(places: np.ndarray) -> list[tuple[int, int]]:
    """Tokens covered by strings that start at these places (in order), as (first, last)."""
    cut = np.flatnonzero(np.diff(places) > RUN) + 1
    first = places[np.concatenate([[0], cut])]
    last = places[np.concatenate([cut, [len(places)]]) - 1] + RUN - 1
    return list(zip(first.tolist(), last.tolist()))


def shard_arrays(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Rows (host, shard, d, shards, stream), those of a shard together: what its suffix array finds.

    Shards follow each other into one array until it has ``limit`` tokens.

    (d, a, b): tokens a to b of page d are repeated; (host, w, shard, d, a): string w stands there once in a shard of several
    (d null: it is repeated within the shard, which is known already).
    """
    def done(held):
        groups, number = {}, []
        for host, shard, *_ in held:
            number.append(groups.setdefault((host, shard), len(groups)))
        pages = [np.asarray(r[4], np.int64) for r in held]
        page, place, rank, twice = repeated_windows(pages, number)
        rows = []
        order = np.flatnonzero(twice)
        for p, at in zip(*split_by(page[order], place[order])):
            rows += [(None, None, None, held[p][2], a, b) for a, b in ranges(at)]
        several = np.array([r[3] > 1 for r in held], bool)
        if several.any():
            mine = np.flatnonzero(several[page])
            w = np.zeros(len(place), np.uint64)
            base = np.cumsum([len(p) for p in pages]) - np.array([len(p) for p in pages])
            tokens = np.concatenate(pages).view(np.uint64)
            for k in range(RUN):
                w = (w + tokens[base[page] + place + k] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
                w ^= w >> np.uint64(31)
            w = w.view(np.int64)
            known = mine[twice[mine]]
            known = known[np.unique(rank[known], return_index=True)[1]] if len(known) else known
            rows += [(held[page[i]][0], int(w[i]), held[page[i]][1], None, None, None) for i in known.tolist()]
            rows += [(held[page[i]][0], int(w[i]), held[page[i]][1], held[page[i]][2], int(place[i]), None)
                     for i in mine[~twice[mine]].tolist()]
        for at in range(0, max(len(rows), 1), 20_000):
            columns = list(zip(*rows[at:at + 20_000])) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int32()))],
                names=["host", "w", "shard", "d", "a", "b"])

    held: list[tuple] = []
    size = 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and size > limit and row[:2] != held[-1][:2]:
                yield from done(held)
                held, size = [], 0
            if len(row[4]) >= RUN:
                held.append(row)
                size += len(row[4])
    if held:
        yield from done(held)


def split_by(owner: np.ndarray, values: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """Values of each owner, both in order of the owner."""
    if not len(owner):
        return [], []
    order = np.lexsort((values, owner))
    owner, values = owner[order], values[order]
    cut = np.flatnonzero(np.diff(owner)) + 1
    return owner[np.concatenate([[0], cut])].tolist(), np.split(values, cut)


def boilerplate(pages: DataFrame, limit: int = SHARD) -> DataFrame:
    """(d, found) of ``pages(host, d, stream)``: ranges (a, b) of tokens of page d that stand on another page of the host, too."""
    one = pages.groupBy("host", "d").agg(F.first("stream").alias("stream"))
    sizes = pages.groupBy("host").agg(F.sum(F.size("stream")).alias("tokens"))
    shards = F.coalesce(F.ceil(F.col("tokens") / limit).cast("int"), F.lit(1))
    # a hot host's pages meet its size under as many salts as there are partitions
    salts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    large = sizes.where(F.col("tokens") > limit).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = one.withColumn("salt", F.pmod(F.xxhash64("d"), F.lit(salts)).cast("int")) \
        .join(large, ["host", "salt"], "left").withColumn("shards", shards).select(
            "host", F.pmod(F.xxhash64(F.lit(1), "d"), F.col("shards")).cast("int").alias("shard"), "d", "shards", "stream")
    rows = written(dealt.repartition("host", "shard").sortWithinPartitions("host", "shard", "d").mapInArrow(
        lambda batches: shard_arrays(batches, limit), "host string, w bigint, shard int, d binary, a int, b int"), "host-arrays")
    inside = rows.where("b is not null").select("d", "a", "b")
    strings = rows.where("b is null")
    again = strings.groupBy("host", "w").agg(F.min("shard").alias("x"), F.max("shard").alias("y")).where("x < y")
    across = strings.where("d is not null").join(again, ["host", "w"], "left_semi") \
        .select("d", "a", (F.col("a") + RUN - 1).alias("b"))
    return inside.unionByName(across).groupBy("d").agg(F.collect_list(F.struct("a", "b")).alias("found"))


def unique_text(blocks: list[dict], found: list[dict] | None) -> str:
    """The text of a page's blocks without open ones that repeated strings cover, unless nothing else is there."""
    covered = np.zeros(1 + max((b["b"] for b in blocks), default=0), np.int64)
    for r in found or []:
        covered[r["a"]:r["b"] + 1] = 1
    kept = [b["text"] for b in blocks if not b["open"] or not covered[b["a"]:b["b"] + 1].all()]
    return "\n".join(kept or [b["text"] for b in blocks])


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            shard_tokens: int = SHARD) -> DataFrame:
    """(id, url, text, n_chars), one row per input row: the main text of every page.

    Character references are decoded, white space inside a block is one space (all that Python's ``str.split`` splits at,
    no-break spaces, too), blocks are joined by a line feed. No text: the empty string. Null html is an empty page; a null
    url or one without a host is of the host "". Rows that repeat, and pages that differ in comments and scripts only,
    are one page: they don't make each other boilerplate. Ids may be null or repeat; other columns are ignored; an
    empty table gives an empty result.
    """
    pages = df.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"),
                      F.col(f"`{html_col}`").alias("html"))
    kind = pages.schema["page_id"].dataType
    schema = T.StructType([T.StructField("page_id", kind), *T.StructType.fromDDL(
        "url string, text string, n_chars bigint").fields])
    names = schema.fieldNames()

    def batch_of(ids, urls, texts):
        return pa.RecordBatch.from_arrays([ids, urls, pa.array(texts, type=pa.string()),
                                           pa.array(map(len, texts), type=pa.int64())], names=names)

    def by_markup(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, OUT_ROWS):
                part = batch.slice(at, OUT_ROWS)
                blocks = [read_page(h).sorted_blocks() for h in part.column(2).to_pylist()]
                clear = pa.array([not any(b[0] for b in x) for x in blocks], type=pa.bool_())
                texts = ["\n".join(b[1] for b in x) for x in blocks if not any(b[0] for b in x)]
                yield batch_of(part.column(0).filter(clear), part.column(1).filter(clear), texts)

    def by_host(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, OUT_ROWS):
                part = batch.slice(at, OUT_ROWS)
                texts = [unique_text(b, f) for b, f in zip(part.column(2).to_pylist(), part.column(3).to_pylist())]
                yield batch_of(part.column(0), part.column(1), texts)

    read = written(streams(pages), "pages")
    undecided = read.where("blocks is not null").select("page_id", "url", "d", "blocks")
    found = boilerplate(read.select("host", "d", "stream"), shard_tokens)
    decided = undecided.join(found, "d", "left").select("page_id", "url", "blocks", "found").mapInArrow(by_host, schema)
    out = pages.mapInArrow(by_markup, schema).unionByName(decided)
    return out.withColumnsRenamed({"page_id": id_col, "url": url_col})
