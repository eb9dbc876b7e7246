"""Toxicity by nearest labelled examples.

Examples are a bounded, hash-chosen sample of the labelled documents. Of their
words those are terms whose presence goes with the label beyond chance
(chi-squared over the examples); inverse document frequencies of the terms are
those of the whole corpus. Examples become TF-IDF vectors in an inverted index
cut into blocks of examples, with each term's largest weight per block. A document
gets its k nearest examples by exact cosine: blocks are visited by their upper
bound until no other can hold a nearer one. Votes weighted by squared cosine and
by the sampling rates give a raw score, and a logistic fit on the examples, each
scored without itself, turns it and the number and density of the terms it rests
on into a probability.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .common import id_and_text, map_texts
from .decontaminate import words_of

#: Bounds: examples of each class (in expectation; at most twice as many), and terms.
EXAMPLES, TERMS = 4000, 4096
BLOCK = 128
#: A term's chi-squared (one degree of freedom), lift and support with the label at least.
CHI2, LIFT, SUPPORT = 30.0, 10.0, 5
#: Besides whole words, their beginnings of so many characters are terms.
BEGINNINGS = (4, 5, 6, 7, 8)


def terms_of(word: bytes) -> list[str]:
    """The word itself, and its beginnings, marked, if it is longer."""
    w = word.decode("utf-8", "replace")
    return [w] + [f"{w[:n]}~" for n in BEGINNINGS if len(w) > n]


class Numbers(dict):
    """Word -> numbers of its terms; remembers up to a bound of words."""

    def __init__(self, number: dict[str, int]):
        super().__init__()
        self.number = number

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) > 400_000:
            self.clear()
        self[word] = found = tuple(n for t in terms_of(word) if (n := self.number.get(t)) is not None)
        return found


class NeighbourIndex:
    """Inverted index over examples (id, label, weight, {term: count}, words), in blocks with largest weights."""

    def __init__(self, examples: list[tuple], idf: dict[str, float]):
        terms = sorted(idf)
        self.number = {t: i for i, t in enumerate(terms)}
        self.idf = [idf[t] for t in terms]
        vectors = [(i, y, w, self.vector({self.number[t]: c for t, c in counts.items()}), (sum(counts.values()), n))
                   for i, y, w, counts, n in examples]
        self.empty = [(y, w) for _, y, w, v, _ in vectors if not v]
        vectors = [x for x in vectors if x[3]]
        # examples with the same heaviest term stand together, which keeps the bounds of blocks tight
        vectors.sort(key=lambda x: (max(x[3], key=lambda t: (x[3][t], t)), x[0]))
        self.ids = [x[0] for x in vectors]
        self.labels = np.array([x[1] for x in vectors], float)
        self.weights = np.array([x[2] for x in vectors], float)
        self.vectors = [x[3] for x in vectors]
        self.sizes = [x[4] for x in vectors]
        self.blocks = max(1, -(-len(vectors) // BLOCK))
        postings: dict[int, list] = defaultdict(list)
        for e, v in enumerate(self.vectors):
            for t, x in v.items():
                postings[t].append((e, x))
        self.postings: dict[int, dict[int, tuple]] = {}
        self.largest = np.zeros((len(terms), self.blocks))
        for t, p in postings.items():
            cut: dict[int, list] = defaultdict(list)
            for e, x in p:
                cut[e // BLOCK].append((e % BLOCK, x))
            self.postings[t] = {b: (np.array([e for e, _ in q]), np.array([x for _, x in q])) for b, q in cut.items()}
            for b, (_, x) in self.postings[t].items():
                self.largest[t, b] = x.max()

    def vector(self, counts: dict[int, int]) -> dict[int, float]:
        """TF-IDF of length one from the terms' counts; empty without terms."""
        v = {n: (1 + math.log(c)) * self.idf[n] for n, c in sorted(counts.items())}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}

    def nearest(self, v: dict[int, float], k: int, but: int = -1) -> list[tuple[float, int]]:
        """The k examples of largest cosine (above 0), largest first, ties by place; ``but`` is left out."""
        if not v or not len(self.ids):
            return []
        terms = np.fromiter(v, np.int64, len(v))
        bound = np.fromiter(v.values(), float, len(v)) @ self.largest[terms]
        best: list[tuple[float, int]] = []
        for b in np.argsort(-bound, kind="stable").tolist():
            if bound[b] <= 0 or len(best) >= k and bound[b] < -best[k - 1][0] - 1e-12:
                break
            total = np.zeros(BLOCK)
            for t, x in v.items():
                if (p := self.postings.get(t, {}).get(b)) is not None:
                    total[p[0]] += x * p[1]
            found = [(-round(float(total[e]), 12), b * BLOCK + e) for e in np.flatnonzero(total > 0).tolist()
                     if b * BLOCK + e != but]
            best = sorted(best + found)[:k]
        return [(-x, e) for x, e in best]

    def votes(self, near: list[tuple[float, int]]) -> float:
        """Share of the positive label among the neighbours, by squared cosine and sampling weight."""
        e = [i for _, i in near]
        w = np.array([x * x for x, _ in near]) * self.weights[e]
        return float(w @ self.labels[e] / w.sum())


def evidence_of(vote: float, matches: int, words: int) -> list[float]:
    """What the calibration sees: the vote, how many terms it rests on, and how dense they are."""
    return [1.0, vote, math.log1p(matches), vote * math.log1p(matches), math.log((1 + matches) / (1 + words))]


def calibrate(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 0.1, steps: int = 50) -> np.ndarray:
    """Coefficients of a weighted logistic regression by Newton's method; a small ridge keeps them finite."""
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        q = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (w * (y - q)) - ridge * beta
        curve = (x * (w * q * (1 - q))[:, None]).T @ x + ridge * np.eye(len(beta))
        step = np.linalg.solve(curve, slope)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return beta


class ToxicityModel:
    def __init__(self, index: NeighbourIndex, k: int):
        self.index, self.k = index, k
        self.numbers = Numbers(index.number)
        near = [index.nearest(v, k, but=e) for e, v in enumerate(index.vectors)]
        has = [e for e, found in enumerate(near) if found]
        x = np.array([evidence_of(index.votes(near[e]), *index.sizes[e]) for e in has]).reshape(-1, 5)
        self.beta = calibrate(x, index.labels[has], index.weights[has])
        rest = index.empty + [(index.labels[e], index.weights[e]) for e in range(len(near)) if not near[e]]
        self.without = (sum(y * w for y, w in rest) + .5) / (sum(w for _, w in rest) + 1)

    def score(self, text: str | None) -> tuple[float, list]:
        """Probability of the label, and the ids of the nearest examples (none: no term in common with any)."""
        words = words_of(text)
        counts = Counter(chain.from_iterable(map(self.numbers.__getitem__, words)))
        near = self.index.nearest(self.index.vector(counts), self.k) if counts else []
        if not near:
            return self.without, []
        odds = float(self.beta @ evidence_of(self.index.votes(near), sum(counts.values()), len(words)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))), [self.index.ids[e] for _, e in near[:3]]


def fold(id_col: str) -> Column:
    """crc32 of the id as text modulo 3; a null id has 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3, F.lit(0))


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        k: int = 25, examples: int = EXAMPLES) -> ToxicityModel:
    """Chooses examples among ``labels`` rows outside the held-out fold and builds the index.

    Rows with a null id or label, and ids without a document, teach nothing; equal
    texts with the same label are one example.
    """
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")) \
        .where("doc_id is not null and y is not null").where(fold("doc_id") != 1).distinct()
    n = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    rate = {y: min(1.0, examples / n[y]) if n.get(y) else 1.0 for y in (0, 1)}
    level = F.when(F.col("y") == 1, rate[1]).otherwise(rate[0]) * (1 << 20)
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < level).limit(4 * examples)
    docs = id_and_text(df, id_col, text_col)
    taught = docs.join(F.broadcast(chosen), "doc_id")       # at most 4 * examples rows of two numbers

    def start():
        def work(texts):
            for x in texts:
                counts: Counter = Counter()
                w = words_of(x)
                for word, own in Counter(w).items():
                    for t in terms_of(word):
                        counts[t] += own
                yield list(counts), list(counts.values()), len(w)
        return work

    pairs = taught.select(F.struct("doc_id", "y", F.xxhash64("text").alias("h")).alias("doc_id"), "text")
    counted = map_texts(pairs, start, [("t", "array<string>"), ("c", "array<int>"),
                                      ("words", "bigint")]).select("doc_id.*", "t", "c", "words").dropDuplicates(["y", "h"]).persist()
    try:
        size = {r["y"]: r["n"] for r in counted.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
        n1, n0 = size.get(1, 0), size.get(0, 0)
        a, b = F.col("a").cast("double"), F.col("b").cast("double")
        total = float(n0 + n1)
        chi2 = total * F.pow(a * (n0 - b) - b * (n1 - a), F.lit(2)) / (
            (a + b) * (total - a - b) * F.lit(float(n1 * n0) or 1.0))
        one = lambda y: F.when(F.col("y") == y, F.lit(1)).otherwise(0)      # noqa: E731
        # numbers of examples, uncapped, so that lift and chi-squared mean the same at every size
        terms = counted.select("y", F.explode("t").alias("t")).groupBy("t").agg(
            F.sum(one(1)).alias("a"), F.sum(one(0)).alias("b")) \
            .where((F.col("a") >= SUPPORT) & (a * n0 >= LIFT * b * n1)) \
            .withColumn("chi2", chi2).where(F.col("chi2") >= CHI2) \
            .orderBy(F.desc("chi2"), "t").limit(TERMS).select("t").collect()
        terms = {r["t"] for r in terms}
        chosen_terms = F.lit(sorted(terms)) if terms else F.array().cast("array<string>")
        kept = F.filter(F.arrays_zip("t", "c"), lambda x: F.array_contains(chosen_terms, x["t"]))
        rows = counted.select("doc_id", "y", kept.alias("v"), "words").collect()
    finally:
        counted.unpersist()
    # document frequencies over the whole corpus
    names = sorted(terms)
    number = {t: i for i, t in enumerate(names)}

    def start_terms():
        of = Numbers(number)
        return lambda texts: ((sorted(set(chain.from_iterable(map(of.__getitem__, words_of(t))))),) for t in texts)

    n_docs, df_of = 0, {}
    if terms:
        seen = map_texts(docs, start_terms, [("n", "array<int>")])
        df_of = {r["n"]: r["c"] for r in seen.select(F.explode(F.concat("n", F.array(F.lit(-1)))).alias("n"))
                 .groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect()}
        n_docs = df_of.pop(-1, 0)
    idf = {t: math.log((1 + n_docs) / (1 + df_of.get(i, 0))) + 1 for i, t in enumerate(names)}
    taught_rows = sorted(((r["doc_id"], r["y"], 1 / rate[r["y"]], {x["t"]: x["c"] for x in r["v"]},
                           r["words"])
                          for r in rows), key=lambda x: (x[0], x[1]))
    return ToxicityModel(NeighbourIndex(taught_rows, idf), k)


def toxicity(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "toxic", k: int = 25, threshold: float = 0.7,
             examples: int = EXAMPLES) -> DataFrame:
    """(id, held_out, score, predicted, evidence): one row per input row.

    ``held_out``: the id's fold, whose labels are never looked at. ``score``: the
    calibrated probability of the label; a text that shares no term with an example
    (an empty or null one, too) has that of such examples. ``evidence``: ids of the
    three nearest examples. Ids may repeat; a null id is in no held-out fold and has
    no label. Without labels every score is one half. Other columns are ignored.
    """
    model = fit(df, labels, id_col, text_col, label_col, k, examples)

    def start():
        return lambda texts: (((x := model.score(t))[0], x[1]) for t in texts)

    out = map_texts(id_and_text(df, id_col, text_col), start, [("score", "double"), ("evidence", "array<bigint>")])
    return out.select(F.col("doc_id").alias(id_col), (fold("doc_id") == 1).alias("held_out"),
                      F.round("score", 6).alias("score"),
                      (F.round("score", 6) >= threshold).cast("int").alias("predicted"), "evidence")
