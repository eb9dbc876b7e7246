"""Quality rules as a short-circuit cascade ordered by rejection per cost.

A document is kept if it passes every rule, so the order of the rules changes
only the work. On a bounded sample each rule is run alone on every document;
its cost is the time this takes and its selectivity the share it rejects. The
rule with the most rejections per second goes first. For a whole corpus a
document then leaves the cascade at the first rule it fails, and whatever the
later rules would have needed (its words, lines, windows) is never computed.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import filter_rows, id_and_text, map_texts, utf8

SYMBOLS = "#*$%&|<>"
WINDOW = 8
BLANK = " \t\n\v\f\r"
UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))
LETTERS = UPPER + LOWER + bytes(range(128, 256))
BULLET = re.compile(r"[\x20\x09-\x0D]*[-*•]")
ELLIPSIS = re.compile(r"(?:\.\.\.|…)[\x20\x09-\x0D]*\Z")


class Profile:
    """What rules ask about a text; each figure is computed when first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def data(self) -> bytes:
        return utf8(self.text)

    @cached_property
    def words(self) -> list[bytes]:
        return self.data.split()        # of bytes: splits at exactly the six ASCII blanks

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, BLANK))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        return [line for line in self.text.split("\n") if line.strip(BLANK)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_upper(self) -> int:
        return len(self.data) - len(self.data.translate(None, UPPER))

    @cached_property
    def n_lower(self) -> int:
        return len(self.data) - len(self.data.translate(None, LOWER))

    @cached_property
    def n_letters(self) -> int:
        """Bytes of letters; all of a character beyond ASCII count."""
        return len(self.data) - len(self.data.translate(None, LETTERS))

    @cached_property
    def word_bytes(self) -> int:
        return sum(map(len, self.words))

    @cached_property
    def n_distinct(self) -> int:
        return len(set(self.words))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside windows of eight that the text has at least twice."""
        n = self.n_words - WINDOW + 1
        if n < 2:
            return 0
        hashed = np.fromiter(map(hash, self.words), np.int64, self.n_words).view(np.uint64)
        total = np.zeros(n, np.uint64)
        for k in range(WINDOW):
            total = total * np.uint64(0x9E3779B97F4A7C15) + hashed[k:k + n]
        _, which, times = np.unique(total, return_inverse=True, return_counts=True)
        if len(times) == n:
            return 0
        seen: dict[tuple, list[int]] = {}       # equal sums are compared word by word
        for i in np.flatnonzero(times[which] > 1).tolist():
            seen.setdefault(tuple(self.words[i:i + WINDOW]), []).append(i)
        covered = np.zeros(self.n_words + 1, np.int64)
        for places in seen.values():
            if len(places) > 1:
                np.add.at(covered, places, 1)
                np.add.at(covered, [i + WINDOW for i in places], -1)
        return int((np.cumsum(covered) > 0).sum())


@dataclass(frozen=True)
class Rule:
    name: str
    passes: Callable[[Profile], bool]


MIN_WORDS = Rule("min_words", lambda p: p.n_words >= 20)
REPETITION = Rule("repetition", lambda p: 100 * p.n_repeat_words <= 30 * p.n_words)
BASE = [MIN_WORDS, REPETITION]
RULES = BASE + [
    Rule("symbols", lambda p: 10 * p.n_symbols <= p.n_words),
    Rule("word_length", lambda p: 2 * p.n_words <= p.word_chars <= 15 * p.n_words),
    Rule("duplicate_lines", lambda p: p.n_dup_lines < 3 or 10 * p.n_dup_lines <= 3 * len(p.lines)),
    Rule("capitals", lambda p: p.n_upper <= p.n_lower),
    Rule("bullets", lambda p: 10 * sum(1 for x in p.lines if BULLET.match(x)) <= 9 * len(p.lines)),
    Rule("ellipses", lambda p: 10 * sum(1 for x in p.lines if ELLIPSIS.search(x)) <= 3 * len(p.lines)),
]


def estimate(df: DataFrame, rules: list[Rule], text_col: str = "text", sample: int = 256) -> list[tuple]:
    """(name, seconds, rejected) of each rule over at most ``sample`` documents; no documents: zeros.

    The sample are the first documents found (of up to a million characters, as they
    come to the driver), so that no whole table is read for an estimate.
    """
    text = F.col(f"`{text_col}`")
    texts = df.select(text.alias("t")).where(F.coalesce(F.length("t"), F.lit(0)) <= 1_000_000).take(sample)
    seconds, rejected = dict.fromkeys(rules, 0.0), dict.fromkeys(rules, 0)
    for row in texts:
        for rule in rules:
            profile = Profile(row["t"])
            began = time.perf_counter()
            rejected[rule] += not rule.passes(profile)
            seconds[rule] += time.perf_counter() - began
    return [(r.name, seconds[r], rejected[r]) for r in rules]


def ordered(rules: list[Rule], estimates: list[tuple]) -> list[Rule]:
    """Most rejections per second first; rules that reject nothing last, the cheapest of them first."""
    rank = {name: (-rejected / max(seconds, 1e-9), seconds) for name, seconds, rejected in estimates}
    return sorted(rules, key=lambda r: (rank[r.name], r.name))


def cascade(df: DataFrame, rules: list[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text",
            sample: int = 256) -> DataFrame:
    """(id, kept, failed): whether a document passes all rules, and the first rule it failed in the order found.

    One row per input row, without a shuffle. A null text is an empty one; ids may
    be null or repeat; other columns are ignored; an empty table gives an empty
    result. ``kept`` doesn't depend on the order; ``failed`` does if a document
    fails several rules.
    """
    order = ordered(rules, estimate(df, rules, text_col, sample))

    def start():
        def work(texts):
            for t in texts:
                profile = Profile(t)
                failed = next((r.name for r in order if not r.passes(profile)), None)
                yield failed is None, failed
        return work

    return map_texts(id_and_text(df, id_col, text_col), start, [("kept", "boolean"), ("failed", "string")]) \
        .withColumnRenamed("doc_id", id_col)


def keep_passing(df: DataFrame, rules: list[Rule] = RULES, text_col: str = "text", sample: int = 256) -> DataFrame:
    """The rows of ``df``, all columns, whose text passes all rules (a null text is an empty one)."""
    order = ordered(rules, estimate(df, rules, text_col, sample))

    def start():
        def passes(t):
            profile = Profile(t)
            return all(r.passes(profile) for r in order)
        return lambda texts: [passes(t) for t in texts]

    return filter_rows(df, text_col, start)


def quality_figures(df: DataFrame, rules: list[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text",
                    sample: int = 256) -> DataFrame:
    """The cascade's verdict with the base figures of every document, also of rejected ones.

    The base rules (too few words, too many repeated ones) are decided on figures
    that are returned anyway; the other rules run as a cascade on what is left.
    Nulls, repeated rows and empty tables are treated as in ``cascade``.
    """
    rest = [r for r in rules if r not in BASE]
    order = ordered(rest, estimate(df, rest, text_col, sample))

    def start():
        def work(texts):
            for t in texts:
                p = Profile(t)
                failed = not (MIN_WORDS.passes(p) and REPETITION.passes(p))
                kept = not failed and all(r.passes(p) for r in order)
                yield p.n_words, p.word_chars, p.n_symbols, p.n_dup_lines, p.n_repeat_words, failed, kept
        return work

    columns = [(n, "bigint") for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return map_texts(id_and_text(df, id_col, text_col), start,
                     columns + [("base_failed", "boolean"), ("kept", "boolean")]).withColumnRenamed("doc_id", id_col)


#: The same in SQL, over a table documents(doc_id, text).
SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
win AS (SELECT doc_id, i, list_slice(w, i, i + 7) AS g
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM dup, range(8) r(k) GROUP BY doc_id),
f AS (
  SELECT d.doc_id, t, l, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 10 * n_symbols <= n_words AND word_chars BETWEEN 2 * n_words AND 15 * n_words
       AND (n_dup_lines < 3 OR 10 * n_dup_lines <= 3 * len(l))
       AND length(regexp_replace(t, '[^A-Z]', '', 'g')) <= length(regexp_replace(t, '[^a-z]', '', 'g'))
       AND 10 * len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) <= 9 * len(l)
       AND 10 * len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) <= 3 * len(l) AS kept
FROM b
"""
