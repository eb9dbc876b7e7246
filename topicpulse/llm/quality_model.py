"""Quality by weak supervision: labellers, their accuracies by expectation-maximisation, a hashed linear scorer.

Overlapping heuristic labellers vote good (1), bad (-1) or nothing (0) on each
document. The votes of all documents are counted by pattern (with ten
labellers at most 3^10 = 59049 patterns, whatever the corpus size) and
expectation-maximisation on these counts gives each labeller's vote
probabilities for good and for bad documents, and with them a posterior for each
pattern. The posteriors of a sample are the labels of a logistic regression over
hashed words, word shapes and coarse figures; it scores every document.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import id_and_text, map_texts
from .quality_rules import Profile

#: Buckets of words, of shapes and of figures, end to end.
WORDS, SHAPES = 1 << 14, 1 << 11
FIGURES = WORDS + SHAPES
BUCKETS = FIGURES + 16 * 8
#: Documents the scorer is fitted on (in expectation; at most twice as many).
SAMPLE = 4000
PUNCTUATION = b".,;:!?"
ODD = bytes(b for b in range(33, 127) if not bytes([b]).isalnum() and b not in b".,;:!?)\"'")
LETTERS = re.compile(rb"[a-z\x80-\xff]+")
CAPITALS = re.compile(rb"[A-Z]+")
DIGITS = re.compile(rb"[0-9]+")


def vote(bad: bool, good: bool) -> int:
    return -1 if bad else int(good)


def ended(p: Profile) -> int:
    return sum(1 for w in p.words if w[-1] in PUNCTUATION)


LABELLERS = {
    "symbols": lambda p: vote(10 * p.n_symbols > p.n_words, 100 * p.n_symbols <= p.n_words),
    "repetition": lambda p: vote(100 * p.n_repeat_words > 30 * p.n_words, p.n_words >= 50 and p.n_repeat_words == 0),
    "duplicate_lines": lambda p: vote(p.n_dup_lines >= 3 and 10 * p.n_dup_lines > 3 * len(p.lines), p.n_dup_lines == 0),
    "capitals": lambda p: vote(p.n_upper > p.n_lower, 5 * p.n_upper < p.n_lower),
    "length": lambda p: vote(p.n_words < 20, p.n_words >= 50),
    "word_length": lambda p: vote(not 2 * p.n_words <= p.word_chars <= 15 * p.n_words,
                                  3 * p.n_words <= p.word_chars <= 10 * p.n_words),
    "punctuation": lambda p: vote(2 * (e := ended(p)) > p.n_words, p.n_words <= 100 * e and 4 * e <= p.n_words),
    "variety": lambda p: vote(5 * p.n_distinct < p.n_words, 3 * p.n_distinct > p.n_words),
    "letters": lambda p: vote(4 * p.n_letters < 3 * p.word_bytes, 10 * p.n_letters > 9 * p.word_bytes),
    "endings": lambda p: vote(3 * (o := odd_ends(p)) > p.n_words, 20 * o <= p.n_words),
}


def odd_ends(p: Profile) -> int:
    """Words that end neither in a letter or digit nor in common punctuation."""
    return sum(1 for w in p.words if w[-1] in ODD)


def votes(p: Profile) -> tuple[int, ...]:
    return tuple(f(p) for f in LABELLERS.values())


def fit_labellers(patterns: np.ndarray, counts: np.ndarray, steps: int = 100) -> dict:
    """Expectation-maximisation over vote patterns with their counts.

    Returns the share of good documents, ``table[class, labeller, vote + 1]`` and
    the posterior of good for each pattern. Starts from the votes, of which a bad one
    counts as much as three good ones; counts are smoothed by one vote of each kind.
    """
    n_labellers = patterns.shape[1]
    good = 1 / (1 + np.exp(-np.where(patterns < 0, -3.0, patterns).sum(1)))
    onehot = np.stack([patterns == v for v in (-1, 0, 1)], axis=2).astype(float)     # pattern, labeller, vote
    for _ in range(steps):
        weight = np.stack([counts * (1 - good), counts * good])
        share = (weight[1].sum() + 1) / (counts.sum() + 2)
        table = np.einsum("cp,plv->clv", weight, onehot) + 1
        table /= table.sum(2, keepdims=True)
        logs = np.einsum("plv,clv->cp", onehot, np.log(table))
        odds = logs[1] - logs[0] + math.log(share / (1 - share))
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if np.abs(new - good).max(initial=0) < 1e-9:
            good = new
            break
        good = new
    accuracy = {name: (float(table[1, k, 2]), float(table[0, k, 0])) for k, name in enumerate(LABELLERS)} \
        if n_labellers == len(LABELLERS) and len(counts) else {}
    return {"share": share, "table": table, "posterior": good, "accuracy": accuracy}


def shape(word: bytes) -> bytes:
    """Word with runs of letters, capitals and digits as one character each; other characters, too, once a run."""
    s = DIGITS.sub(b"0", CAPITALS.sub(b"A", LETTERS.sub(b"a", word)))
    return re.sub(rb"(.)\1+", rb"\1", s, flags=re.S)


class Buckets(dict):
    """Word -> bucket of the word << 32 | bucket of its shape, up to a bound of remembered words."""

    def __missing__(self, w: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        self[w] = both = zlib.crc32(b"w" + w.lower()) % WORDS << 32 | WORDS + zlib.crc32(shape(w)) % SHAPES
        return both


class Features:
    """Hashed features of a text: words and shapes by the logarithm of their number, figures by their magnitude."""

    def __init__(self):
        self.known = Buckets()

    def of(self, p: Profile) -> tuple[np.ndarray, np.ndarray]:
        """Buckets and values; those of words and shapes are a vector of length one. No words: only figures."""
        both = np.fromiter(map(self.known.__getitem__, p.words), np.int64, p.n_words)
        at, counts = np.unique(np.concatenate([both >> 32, both & 0xFFFFFFFF]), return_counts=True)
        x = np.log1p(counts) * np.where(at < WORDS, .25, 1.0)
        x /= math.sqrt(float(x @ x)) or 1.0
        n = p.n_words + 1
        figures = {"length": n, "symbols": 1 + 100 * p.n_symbols // n, "repeat": 1 + 100 * p.n_repeat_words // n,
                   "dup": 1 + p.n_dup_lines, "upper": 1 + 100 * p.n_upper // (1 + p.n_lower),
                   "variety": 1 + 20 * p.n_distinct // n, "word": 1 + p.word_chars // n,
                   "letters": 1 + 20 * p.n_letters // (1 + len(p.data))}
        own = [FIGURES + 16 * k + min(v.bit_length(), 15) for k, v in enumerate(figures.values())]
        return np.concatenate([at, own]), np.concatenate([x, np.full(len(own), .5)])


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray, float]], rounds: int = 12) -> np.ndarray:
    """Weights (the last is the intercept) of a logistic regression on soft labels; both classes weigh the same."""
    w = np.zeros(BUCKETS + 1)
    grown = np.full(BUCKETS + 1, 1e-6)
    good = sum(y for _, _, y in rows)
    weight = (len(rows) / (2 * max(good, 1.0)), len(rows) / (2 * max(len(rows) - good, 1.0)))
    order = np.random.default_rng(0)
    for _ in range(rounds):
        for i in order.permutation(len(rows)):
            at, x, y = rows[i]
            odds = float(w[at] @ x + w[-1])
            q = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
            g = q * (1 - y) * weight[1] - (1 - q) * y * weight[0]
            step = g * x + 1e-5 * w[at]
            grown[at] += step ** 2
            w[at] -= .3 * step / np.sqrt(grown[at])
            grown[-1] += g * g
            w[-1] -= .3 * g / math.sqrt(grown[-1])
    return w


def quality_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE,
                   threshold: float = 0.2) -> DataFrame:
    """(id, posterior, score, kept): one row per input row.

    ``posterior``: probability of "good" from the labellers alone; ``score``: that
    of the hashed linear scorer; ``kept``: score >= threshold (below one half, as a doubtful document
    rather stays). Votes are counted
    over all documents; the scorer is fitted on about ``sample`` of them, chosen by
    a hash. Null texts are empty ones; ids may be null or repeat; other columns are
    ignored; an empty table gives an empty result.
    """
    docs = id_and_text(df, id_col, text_col)
    names = list(LABELLERS)
    counted = map_texts(docs, lambda: lambda texts: ((list(votes(Profile(t))),) for t in texts),
                        [("votes", "array<int>")]).groupBy("votes").agg(F.count(F.lit(1)).alias("n"))
    found = sorted((tuple(r["votes"]), r["n"]) for r in counted.collect())      # at most 3^labellers rows
    patterns = np.array([p for p, _ in found], np.int64).reshape(-1, len(names))
    counts = np.array([n for _, n in found], float)
    fitted = fit_labellers(patterns, counts)
    posterior = {p: float(q) for (p, _), q in zip(found, fitted["posterior"])}
    share = min(1.0, sample / max(1.0, counts.sum()))

    def start_sample():
        features = Features()

        def work(texts):
            for t in texts:
                p = Profile(t)
                at, x = features.of(p)
                yield zlib.crc32(p.data), at.tolist(), x.tolist(), posterior.get(votes(p), .5)
        return work

    chosen = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = map_texts(chosen, start_sample, [("h", "bigint"), ("at", "array<int>"), ("x", "array<double>"),
                                            ("y", "double")]).drop("doc_id").limit(2 * sample).collect()
    rows.sort(key=lambda r: (r["h"], r["at"]))
    weights = fit_scorer([(np.array(r["at"], np.int64), np.array(r["x"]), r["y"]) for r in rows])

    def start():
        features = Features()

        def work(texts):
            for t in texts:
                p = Profile(t)
                at, x = features.of(p)
                odds = float(weights[at] @ x + weights[-1])
                score = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
                yield posterior.get(votes(p), .5), round(score, 6)
        return work

    out = map_texts(docs, start, [("posterior", "double"), ("score", "double")])
    return out.select(F.col("doc_id").alias(id_col), F.round("posterior", 6).alias("posterior"), "score",
                      (F.col("score") >= threshold).alias("kept"))
