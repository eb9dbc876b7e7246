"""Benchmark decontamination: a BM25 index of test items, block-max WAND, exact verification.

An item's question (all sentences but the last) and its answer (the last) are
segments of their own in a BM25 index, and every document, whole, is a query. A
document gives an item away if it holds, wherever they stand, a share ``overlap``
of the five-word shingles of the question and as much of those of question and
answer together. An answer so short that the second demand follows from the first
isn't asked for by itself: a question in the training text makes the item useless
as a test, and "42" or "Paris" stands in many texts; its share is reported.

What verification demands gives each segment its threshold, so the search loses
nothing. If at most L distinct shingles of a part are missing (and one is there),
at most L distinct words of the part stand in missing shingles only: give each
such word its first place in the part; before the shingle that is there, take the
shingle that begins at the place, behind it the one that ends there; these are all
missing and no two are the same. So the document has all words of the segment but
L, and at least the weight left when the L heaviest go. Impacts are shares of that
threshold: a segment is retrieved where they add up to one, and an item where its
question is and, if anything follows for its answer, its answer.

Documents are held against blocks of segments first: where the largest impacts of
a document's words don't add up to one in any block of questions, it is done; the
others go through the postings of such blocks by WAND, and what that retrieves is
held against its answer and verified.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import blocks, filter_rows, id_and_text, map_texts, written

K1, B = 1.2, 0.75
#: Segments in a block, and characters of documents that are held against the blocks at a time.
BLOCK, CHARS = 2, 500_000
#: Items and characters of items indexed (and sent to the tasks) at a time; more are done in further passes.
SHARD_ITEMS, SHARD_CHARS = 5000, 20_000_000
ASCII = bytes(b if bytes([b]).isalnum() or b >= 128 else 32 for b in range(256))
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words; ASCII characters other than letters and digits separate them."""
    return (text or "").lower().encode("utf-8").translate(ASCII).split()


def shingles(words: list[bytes], n: int = 5) -> set:
    """Distinct runs of n words; fewer words are one run, none are none."""
    if len(words) <= n:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(n))))


def question_answer(text: str | None) -> tuple[list[bytes], list[bytes]]:
    """Words of all sentences but the last, and of the last; a single sentence is all question."""
    parts = [w for s in SENTENCE.split(text or "") if (w := words_of(s))]
    if len(parts) < 2:
        return sum(parts, []), []
    return sum(parts[:-1], []), parts[-1]


def segments(text: str | None) -> list[list[bytes]]:
    """Question and answer, those that have words."""
    return [part for part in question_answer(text) if part]


def may_miss(runs: set, overlap: float) -> int:
    """How many of the shingles may be missing at most if their share ``overlap`` is there."""
    return int(len(runs) * (1 - overlap) + 1e-9)


class Index:
    """Postings of the questions and answers of some items, in blocks with their largest impact.

    ``items``: (id, text); ``df``: term -> number of segments with it, over all items;
    ``n``, ``mean``: number of segments and mean number of words of all items.
    """

    def __init__(self, items: list[tuple], df: dict[bytes, int], n: int, mean: float, overlap: float = 0.8):
        self.items, self.overlap = items, overlap
        self.parts = [question_answer(text) for _, text in items]
        self.item_of: list[int] = []
        self.answer: list[int | None] = []  # an item's answer; one for which nothing follows has no segment
        self.share: list[float] = []        # a segment's threshold as a share of its weight
        postings: dict[bytes, list] = defaultdict(list)
        for k, (question, answer) in enumerate(self.parts):
            runs = shingles(question)
            self.add(postings, k, question, may_miss(runs, overlap), runs, df, n, mean)
        self.question_blocks = -(-len(items) // BLOCK)      # questions come first
        for k, (question, answer) in enumerate(self.parts):
            lost = may_miss(shingles(question + answer), overlap)
            self.answer.append(self.add(postings, k, answer, lost, set(), df, n, mean))
        self.number = {t: i for i, t in enumerate(postings)}
        self.vocabulary = frozenset(postings)
        self.docs = [[d for d, _ in p] for p in postings.values()]
        self.impacts = [[x for _, x in p] for p in postings.values()]
        self.block_max = [[max(p[i:i + BLOCK]) for i in range(0, len(p), BLOCK)] for p in self.impacts]
        self.top = [max(p) for p in self.impacts]
        # the largest impacts once more by blocks of segments, end to end for all terms
        self.blocks = -(-len(self.item_of) // BLOCK) or 1
        largest: list[dict] = []
        for docs, impacts in zip(self.docs, self.impacts):
            own: dict[int, float] = {}
            for d, x in zip(docs, impacts):
                own[d // BLOCK] = max(own.get(d // BLOCK, 0.0), x)
            largest.append(own)
        self.n_blocks = np.array([len(x) for x in largest] + [0])
        self.first_block = np.cumsum(self.n_blocks) - self.n_blocks
        self.block_of = np.array([b for x in largest for b in x], np.int64)
        self.max_of = np.array([m for x in largest for m in x.values()])
        self.terms_of: list[list[int]] = [[] for _ in range(self.blocks)]
        for t, own in enumerate(largest):
            for b in own:
                self.terms_of[b].append(t)
        self.checks: dict[int, tuple] = {}

    def add(self, postings: dict, item: int, words: list[bytes], lost: int, runs: set, df: dict, n: int,
            mean: float) -> int | None:
        """A segment's number, its postings added; None if any document could have its threshold."""
        weight = {t: math.log(1 + (n - df[t] + .5) / (df[t] + .5)) * c * (K1 + 1)
                  / (c + K1 * (1 - B + B * len(words) / mean)) for t, c in Counter(words).items()}
        threshold = sum(sorted(weight.values())[:-lost or None])
        if runs:        # one of them is there
            threshold = max(threshold, min(sum(weight[t] for t in set(r)) for r in runs))
        if threshold <= 0:
            return None
        for t, x in weight.items():
            postings[t].append((len(self.item_of), x / threshold))
        self.item_of.append(item)
        self.share.append(threshold / sum(weight.values()))
        return len(self.item_of) - 1

    def wand(self, terms: list[int], threshold: float = 1.0, first: int = 0, end: int | None = None) -> list[tuple[int, float]]:
        """(segment, score) of every segment, of those from ``first`` to before ``end``, whose impacts add up to the threshold."""
        docs, impacts, block_max, top = self.docs, self.impacts, self.block_max, self.top
        slack = threshold - 1e-9
        end = len(self.item_of) if end is None else end
        # current segment, term, place in its postings
        at = [(docs[t][j], t, j) for t in terms if (j := bisect_left(docs[t], first)) < len(docs[t]) and docs[t][j] < end]
        found = []
        while at:
            at.sort()
            bound, pivot = 0.0, -1
            for i, (_, t, _) in enumerate(at):
                bound += top[t]
                if bound >= slack:
                    pivot = i
                    break
            if pivot < 0:
                break
            doc = at[pivot][0]
            last = pivot
            while last + 1 < len(at) and at[last + 1][0] == doc:
                last += 1
            # the largest impacts of the blocks in which the pivot segment lies
            bound, beyond = 0.0, at[last + 1][0] if last + 1 < len(at) else len(self.item_of)
            place = {}
            for i in range(last + 1):
                d, t, j = at[i]
                own, b = docs[t], j // BLOCK
                while b * BLOCK + BLOCK <= len(own) and own[b * BLOCK + BLOCK - 1] < doc:
                    b += 1
                if b * BLOCK < len(own) and own[-1] >= doc:
                    bound += block_max[t][b]
                    beyond = min(beyond, own[min(b * BLOCK + BLOCK, len(own)) - 1] + 1)
                place[t] = max(j, b * BLOCK)
            if bound >= slack:
                score = 0.0
                for i in range(last + 1):
                    t = at[i][1]
                    own, j = docs[t], place[t]
                    while j < len(own) and own[j] < doc:
                        j += 1
                    if j < len(own) and own[j] == doc:
                        score += impacts[t][j]
                        j += 1
                    place[t] = j
                if score >= slack:
                    found.append((doc, score))
                target = doc + 1
            else:       # nothing up to the nearest block end can reach the threshold
                target = max(beyond, doc + 1)
            moved = []
            for i, (d, t, j) in enumerate(at):
                if i <= last:
                    own, j = docs[t], place[t]
                    while j < len(own) and own[j] < target:
                        j += 1
                    if j < len(own) and own[j] < end:
                        moved.append((own[j], t, j))
                else:
                    moved.append((d, t, j))
            at = moved
        return found

    def promising(self, terms: list[np.ndarray]) -> list[list[int]]:
        """For documents, as numbers of their terms: blocks with questions whose largest impacts add up to one."""
        size = np.array([len(t) for t in terms])
        document, term = np.repeat(np.arange(len(terms)), size), np.concatenate(terms)
        n = self.n_blocks[term]
        entry = np.repeat(self.first_block[term] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        bound = np.bincount(np.repeat(document, n) * self.blocks + self.block_of[entry],
                            weights=self.max_of[entry], minlength=len(terms) * self.blocks)
        good = bound.reshape(len(terms), -1)[:, :self.question_blocks] >= 1 - 1e-9
        found: list[list[int]] = [[] for _ in terms]
        for k, b in zip(*map(np.ndarray.tolist, np.nonzero(good))):
            found[k].append(b)
        return found

    def candidates(self, terms: set[int], good: list[int]) -> dict[int, float]:
        """Item number -> share of its question's weight, of the items that a document with these terms may give away.

        ``good``: the blocks that ``promising`` names; the items found there are held against their answers.
        """
        found = {}
        for b in good:
            end = min((b + 1) * BLOCK, len(self.items))
            for question, score in self.wand([t for t in self.terms_of[b] if t in terms], 1.0, b * BLOCK, end):
                item = self.item_of[question]
                a = self.answer[item]
                if a is None or self.wand([t for t in self.terms_of[a // BLOCK] if t in terms], 1.0, a, a + 1):
                    found[item] = score * self.share[question]
        return found

    def verify(self, item: int, document: set) -> tuple[float, float] | None:
        """Shares of the question's and the answer's shingles in the document if they make a leak, else None."""
        if item not in self.checks:
            question, answer = self.parts[item]
            self.checks[item] = (shingles(question), shingles(answer), shingles(question + answer))
        q, a, whole = self.checks[item]
        share = lambda s: len(s & document) / len(s) if s else 1.0      # noqa: E731
        if whole and share(q) >= self.overlap and share(whole) >= self.overlap:
            return share(q), share(a)
        return None

    def leaks(self, texts: list) -> Iterator[list[tuple]]:
        """For each text (item id, score, question share, answer share) of every item it gives away."""
        for run in blocks(texts, CHARS):
            words = [words_of(t) for t in run]
            terms = [np.array(sorted(self.number[w] for w in self.vocabulary.intersection(ws)), np.int64) for ws in words]
            for ws, own, good in zip(words, terms, self.promising(terms)):
                yield self.given_away(ws, self.candidates(set(own.tolist()), good)) if good else []

    def given_away(self, words: list[bytes], found: dict[int, float]) -> list[tuple]:
        if not found:
            return []
        # shingles of short questions and answers are shorter than five words
        lengths = {min(5, len(p)) for k in found for p in (*self.parts[k], sum(self.parts[k], []))} - {0}
        document = set().union(*(set(zip(*(words[k:] for k in range(n)))) for n in lengths))
        return [(self.items[k][0], score, *v) for k, score in sorted(found.items()) if (v := self.verify(k, document))]


def shards(benchmark: DataFrame, id_col: str, text_col: str, overlap: float) -> list:
    """Functions, one for each shard of the items, that make its Index; corpus figures are those of all items.

    A shard and the document frequencies of its own words come to the driver, both bounded
    by the shard's size; callers let one Index go before they make the next.
    """
    if not 0 < overlap <= 1:
        raise ValueError("overlap must be above 0 and at most 1")
    items = id_and_text(benchmark, id_col, text_col).where(F.length(F.trim("text")) > 0)
    n_items, chars = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    if not n_items:
        return []
    many = max(1, math.ceil(n_items / SHARD_ITEMS), math.ceil(chars / SHARD_CHARS))
    items = items.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text"), F.lit(many)))
    sizes = map_texts(items.select(F.col("shard").alias("doc_id"), "text"), lambda: lambda texts: (
        ([t for s in segments(x) for t in sorted(set(s))], [len(s) for s in segments(x)]) for x in texts),
        [("terms", "array<string>"), ("sizes", "array<int>")])
    sizes = written(sizes, "benchmark-terms")
    n, total = sizes.agg(F.sum(F.size("sizes")), F.sum(F.aggregate("sizes", F.lit(0), lambda a, x: a + x))).first()
    if not n:
        return []
    by_shard = sizes.select(F.col("doc_id").alias("shard"), F.explode("terms").alias("t"))
    count = by_shard.groupBy("t").agg(F.count(F.lit(1)).alias("df"))

    def index(k: int) -> Index:
        rows = [tuple(r) for r in items.where(F.col("shard") == k).select("doc_id", "text").collect() if words_of(r["text"])]
        df = count.join(by_shard.where(F.col("shard") == k).select("t").distinct(), "t").collect()
        return Index(sorted(rows, key=lambda r: (r[0] is None, r[0], r[1])),
                     {r["t"].encode("utf-8"): r["df"] for r in df}, n, total / n, overlap)

    return [lambda k=k: index(k) for k in range(many)]


def leaks(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          item_col: str = "item_id", item_text_col: str = "text", overlap: float = 0.8) -> DataFrame:
    """(id, item_id, score, question_overlap, answer_overlap): one row for each document and item it gives away.

    ``score``: the share of the question's BM25 weight that the document's words have.
    Null and empty texts give nothing away, null and empty items can't be given
    away. Rows are judged one by one, so repeated rows give repeated results; ids
    may be null. No documents or no items: an empty result. Documents are not
    shuffled; the items go to the tasks in shards of bounded size, and with several
    shards the rows found by one are written before the next one's index is made.
    """
    docs = id_and_text(df, id_col, text_col)
    kind = benchmark.schema[item_col].dataType
    out, made = None, shards(benchmark, item_col, item_text_col, overlap)
    for make in made:
        index = make()

        def start(index=index):
            return lambda texts: (tuple(zip(*found)) or ([], [], [], []) for found in index.leaks(texts))

        hits = map_texts(docs, start, [("items", f"array<{kind.simpleString()}>"), ("score", "array<double>"),
                                       ("question", "array<double>"), ("answer", "array<double>")])
        hits = hits.select("doc_id", F.explode(F.arrays_zip("items", "score", "question", "answer")).alias("x"))
        if len(made) > 1:
            hits = written(hits, "leaks")
        out = hits if out is None else out.unionByName(hits)
    if out is None:
        return docs.limit(0).select(F.col("doc_id").alias(id_col), F.lit(None).cast(kind).alias("item_id"), *[
            F.lit(0.0).alias(c) for c in ("score", "question_overlap", "answer_overlap")])
    return out.select(F.col("doc_id").alias(id_col), F.col("x.items").alias("item_id"), F.round("x.score", 6).alias("score"),
                      F.col("x.question").alias("question_overlap"), F.col("x.answer").alias("answer_overlap"))


def without_leaks(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", overlap: float = 0.8) -> DataFrame:
    """The rows of ``df``, all columns, that give no item away.

    Rows are judged by their texts alone: null and empty texts stay, repeated rows stay or go together, ids may be
    anything. No items: all rows. With several shards of items what one leaves is written before the next.
    """
    made = shards(benchmark, item_col, item_text_col, overlap)
    for make in made:
        df = filter_rows(df, text_col, lambda index=make(): lambda texts: [not x for x in index.leaks(texts)])
        if len(made) > 1:
            df = written(df, "without-leaks")
    return df
