"""Periodic runs of words in every text, found on a grammar of its repeated stretches.

A run (maximal repetition) is a stretch of words with smallest period q, at least 2q and
12 words long, that can't be extended by a word on either side. Steps, all within a text:

1. Where runs can be at all. In a run of 12 words the first six words come again q words later, and
   so do the next six, up to the run's end. So a run lies in a chain of
   six-word strings that occur again, with gaps of at most five places. The
   rest of the text is set aside, which is exact; what is left are a few short segments.
2. Re-Pair, for all segments of a block of texts at once: in each round every place
   whose pair of symbols is more frequent in its segment than the pairs that overlap it
   becomes a nonterminal (of equal pairs the smaller one; in a stretch of one symbol
   every second place). It ends when no pair of a segment occurs twice.
   What is left of a segment is halved again and again, which makes a binary derivation tree.
3. For each nonterminal, once, the runs that cross the boundary between its two halves. A run of
   period q that crosses it has in one of its two aligned copies three words beside the boundary that come
   again q words away, so the places of these words give all periods; each is extended to both sides.
4. Every run of the text crosses the boundary of the lowest node of the derivation tree that
   contains it, so it is found whole there; at other nodes only parts of it are found. The
   intervals are moved to all positions of their nonterminal, and those of one period that overlap by
   a period or more are merged.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame

from .common import blocks, id_and_text, map_texts, utf8

#: Words of the shortest run, and the words at its beginning that must come again.
LEAST, SEED = 12, 6
#: Words at a boundary that must come again for a period to be looked at.
EDGE = 3
#: Characters of texts that go through steps 1 and 2 together (a longer text is a block of its own).
BLOCK = 2_000_000
MIX = np.uint64(0x9E3779B97F4A7C15)


def planted(doc_id, n: int) -> tuple[int, int] | None:
    """(start, period) of the suffix that is made periodic, by the id's checksum; None for all but a tenth of the texts."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def number(lists: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words of all lists, end to end, and the lists' begins (one more at the end)."""
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for ws in lists for w in ws], np.int64)
    return ids, np.concatenate([[0], np.cumsum([len(ws) for ws in lists])]).astype(np.int64)


def grams(ids: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of the ``width`` words from each place on (fewer places than words). Equal strings, equal hashes."""
    n = len(ids) - width + 1
    total = np.zeros(max(n, 0), np.uint64)
    for k in range(width if n > 0 else 0):
        total = (total + ids[k:k + n].astype(np.uint64) + np.uint64(1)) * MIX
        total ^= total >> np.uint64(29)
    return total


def again(key: np.ndarray) -> np.ndarray:
    """Whether each value occurs twice or more."""
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    out = np.zeros(len(key), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def segments(ids: np.ndarray, begins: np.ndarray) -> list[tuple[int, int]]:
    """Stretches (begin, end) of the numbered words outside which no list has a run."""
    hashed = grams(ids, SEED)
    bounds = list(zip(begins[:-1].tolist(), begins[1:].tolist()))
    while True:
        bounds = [(a, b) for a, b in bounds if b - a >= LEAST]
        if not bounds:
            return []
        lo = np.array([a for a, _ in bounds])
        sizes = np.array([b - a for a, b in bounds]) - SEED + 1
        shift = np.cumsum(sizes) - sizes
        at = np.repeat(lo - shift, sizes) + np.arange(int(sizes.sum()))
        which = np.repeat(np.arange(len(bounds)), sizes)
        # a segment's own hashes: different segments must not vouch for each other
        flagged = np.flatnonzero(again((hashed[at] + which.astype(np.uint64) * MIX) * MIX))
        if not len(flagged):
            return []
        places, owner = at[flagged], which[flagged]
        cut = np.flatnonzero((np.diff(places) > SEED) | (np.diff(owner) > 0)) + 1
        first = places[np.concatenate([[0], cut])].tolist()
        last = places[np.concatenate([cut, [len(places)]]) - 1].tolist()
        found = [(a, b + SEED) for a, b in zip(first, last)]
        if found == bounds:
            return bounds
        bounds = found


class Grammar:
    """Rules symbol -> (left, right) with the number of words below each symbol; symbols under ``words`` are words."""

    def __init__(self, words: int):
        self.words = words
        self.left = self.right = np.zeros(0, np.int64)
        self.size = np.ones(words, np.int64)

    def add(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """New symbols for pairs of known ones."""
        new = np.arange(len(self.size), len(self.size) + len(left))
        self.left, self.right = np.concatenate([self.left, left]), np.concatenate([self.right, right])
        self.size = np.concatenate([self.size, self.size[left] + self.size[right]])
        return new


def re_pair(symbols: np.ndarray, owner: np.ndarray, words: int) -> tuple[Grammar, np.ndarray, np.ndarray]:
    """The grammar of sequences of symbols (those of one ``owner`` belong together), and what is left of them.

    Owners have no symbols in common (the caller sees to that), so a pair belongs to one of them.
    """
    grammar = Grammar(words)
    while len(symbols) > 1:
        inside = owner[1:] == owner[:-1]
        key = symbols[:-1] * len(grammar.size) + symbols[1:]
        _, which, times = np.unique(key, return_inverse=True, return_counts=True)
        count = np.where(inside, times[which], 0)
        alive = count > 1
        if not alive.any():
            break
        # more frequent first, then the smaller pair: one number for each place
        rank = np.where(alive, count * (len(times) + 1) + len(times) - which, 0)
        padded = np.concatenate([[0], rank, [0]])
        before, after = padded[:-2], padded[2:]
        # a stretch of equal ranks is a stretch of one symbol: every second place, from the first that no neighbour beats
        begin = rank != before
        start = np.maximum.accumulate(np.where(begin, np.arange(len(rank)), 0))
        beaten = (before > rank) & begin
        offset = np.arange(len(rank)) - start - beaten[start]
        chosen = np.flatnonzero(alive & (offset >= 0) & (offset % 2 == 0) & (after <= rank))
        pairs, first, new = np.unique(key[chosen], return_index=True, return_inverse=True)
        fresh = grammar.add(symbols[:-1][chosen[first]], symbols[1:][chosen[first]])
        symbols = symbols.copy()
        symbols[chosen] = fresh[new]
        keep = np.ones(len(symbols), bool)
        keep[chosen + 1] = False
        symbols, owner = symbols[keep], owner[keep]
    return grammar, symbols, owner


def halved(grammar: Grammar, symbols: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Neighbours of one owner joined two by two until each owner has one symbol, its root; the roots in order."""
    while len(symbols):
        start = np.maximum.accumulate(np.where(np.concatenate([[True], owner[1:] != owner[:-1]]), np.arange(len(owner)), 0))
        even = (np.arange(len(owner)) - start) % 2 == 0
        at = np.flatnonzero(even[:-1] & (owner[1:] == owner[:-1]))
        if not len(at):
            break
        symbols = symbols.copy()
        symbols[at] = grammar.add(symbols[at], symbols[at + 1])
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        symbols, owner = symbols[keep], owner[keep]
    return symbols


def extend(t: np.ndarray, i: np.ndarray, j: np.ndarray, lo: int, hi: int, step: int) -> np.ndarray:
    """How many words in direction ``step`` from places i and j agree, within [lo, hi); i < j, pairs at once."""
    room = (hi - j) if step > 0 else (i - lo + 1)
    length = np.zeros(len(i), np.int64)
    alive = np.flatnonzero(room > 0)
    width = 8
    while len(alive):
        k = length[alive, None] + np.arange(width)
        ok = k < room[alive, None]
        a = t[np.where(ok, i[alive, None] + step * k, 0)]
        b = t[np.where(ok, j[alive, None] + step * k, 1)]
        same = ok & (a == b)
        full = same.all(axis=1)
        length[alive] += np.where(full, width, same.argmin(axis=1))
        alive = alive[full]
        width = min(2 * width, max(8, (1 << 20) // max(1, len(alive))))
    return length


def crossing(t: np.ndarray, edge: np.ndarray, lo: int, c: int, hi: int) -> list[tuple[int, int, int]]:
    """(begin, end, smallest period) of the runs of t[lo:hi] over the boundary before place c, and some beside it.

    ``edge``: hashes of the ``EDGE`` words from each place on. Of a run of length l and period q, l - q >= 6
    words come again q words further, in one of two alignments around c; on one side of c it is three or more.
    """
    last = hi - EDGE + 1
    shifts = [np.zeros(0, np.int64)]
    for at in (c, c - EDGE):
        if lo <= at < last:
            shifts.append(np.flatnonzero(edge[lo:last] == edge[at]) + (lo - at))
    shifts = np.unique(np.concatenate(shifts))
    shifts = shifts[(shifts != 0) & (2 * np.abs(shifts) <= hi - lo)]
    if not len(shifts):
        return []
    found: list[tuple[int, int, int]] = []
    order = np.argsort(np.abs(shifts), kind="stable")
    shifts = shifts[order]
    while len(shifts):
        # some periods at a time: a short one rules out its multiples
        now, shifts = shifts[:32], shifts[32:]
        q = np.abs(now)
        i = np.where(now > 0, c, c - q)
        ok = (i >= lo) & (i + q < hi)
        q, i = q[ok], i[ok]
        right = extend(t, i, i + q, lo, hi, 1)
        left = extend(t, i - 1, i + q - 1, lo, hi, -1)
        for p, b, e in zip(q.tolist(), (i - left).tolist(), (i + q + right).tolist()):
            if e - b >= max(LEAST, 2 * p) and not any(p % r == 0 and x <= b and e <= y for x, y, r in found):
                found.append((b, e, p))
        # a multiple of a run's period says nothing new where the run has both places that are compared
        for x, y, r in found:
            shifts = shifts[(shifts % r != 0) | (c + np.minimum(shifts, 0) < x) | (c + np.maximum(shifts, 0) > y)]
    return found


def grammar_runs(t: np.ndarray, edge: np.ndarray, grammar: Grammar, root: int, begin: int) -> set[tuple]:
    """Intervals (begin, end, period) of t found at all nodes of the tree below ``root``, whose words begin at ``begin``.

    A nonterminal is looked at once, where it stands first.
    """
    words = grammar.words
    places: dict[int, list[int]] = {}
    todo = [(root, begin)]
    while todo:
        x, at = todo.pop()
        if x >= words and grammar.size[x] >= LEAST:
            places.setdefault(x, []).append(at)
            y = int(grammar.left[x - words])
            todo += [(y, at), (int(grammar.right[x - words]), at + int(grammar.size[y]))]
    found = set()
    for x, at in places.items():
        here = at[0]
        middle = here + int(grammar.size[grammar.left[x - words]])
        for b, e, q in crossing(t, edge, here, middle, here + int(grammar.size[x])):
            found.update((b + p - here, e + p - here, q) for p in at)
    return found


def merged(intervals: Iterable[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Intervals (begin, end, period) of one period that overlap by a period or more made one; by begin, then period."""
    out: list[list[int]] = []
    for q, b, e in sorted((q, b, e) for b, e, q in intervals):
        if out and out[-1][0] == q and b + q <= out[-1][2]:
            out[-1][2] = max(out[-1][2], e)
        else:
            out.append([q, b, e])
    return sorted((b, e, q) for q, b, e in out)


def all_runs(lists: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """Of each list of words its runs (begin, end, smallest period), by begin, then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in lists]
    ids, begins = number(lists)
    places = segments(ids, begins)
    if not places:
        return out
    # only the segments from here on; a word of two segments is two symbols
    at = np.concatenate([np.arange(a, b) for a, b in places])
    owner = np.repeat(np.arange(len(places)), [b - a for a, b in places])
    t = np.unique(owner * (int(ids.max()) + 1) + ids[at], return_inverse=True)[1].astype(np.int64)
    words = int(t.max()) + 1
    grammar, symbols, rest = re_pair(t, owner, words)
    roots = halved(grammar, symbols, rest)
    edge = grams(t, EDGE)
    begin = 0
    lists_of = np.searchsorted(begins, [a for a, _ in places], side="right") - 1
    for (a, b), root, which in zip(places, roots.tolist(), lists_of.tolist()):
        shift = a - begin - int(begins[which])
        out[which] += [(x + shift, y + shift, q) for x, y, q in merged(grammar_runs(t, edge, grammar, root, begin))]
        begin += b - a
    return [sorted(runs) for runs in out]


def row_of(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    """The result's columns of one text."""
    lines = "".join(f"{b},{e - b},{q}\n" for b, e, q in sorted(runs, key=lambda r: (r[0], r[2])))
    gone = np.zeros(len(words) + 1, np.int64)
    for b, e, q in runs:
        gone[b + q] += 1
        gone[e] -= 1
    if runs:
        kept = [w for w, g in zip(words, np.cumsum(gone).tolist()) if not g]
    else:
        kept = words
    longest = (None,) * 4
    if runs:
        b, e, q = min(runs, key=lambda r: (r[0] - r[1], r[0], r[2]))
        longest = (b, e - b, q, 1000 * (e - b) // q)
    return (len(runs), *longest, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())


COLUMNS = [("n_runs", "bigint"), ("start", "bigint"), ("length", "bigint"), ("period", "bigint"),
           ("exponent_milli", "bigint"), ("runs_sha256", "string"), ("collapsed_sha256", "string")]


def results(rows: list[tuple], plant: bool) -> Iterator[tuple]:
    """The result's columns of every (id, text), a block of texts at a time."""
    at = 0
    for texts in blocks([t for _, t in rows], BLOCK):
        lists = []
        for (doc_id, _), text in zip(rows[at:at + len(texts)], texts):
            words = utf8(text).split()       # of bytes: splits at exactly the six ASCII blanks
            if plant and (where := planted(doc_id, len(words))):
                a, p = where
                words[a:] = (words[a:a + p] * (-(-(len(words) - a) // p)))[:len(words) - a]
            lists.append(words)
        at += len(texts)
        yield from map(row_of, lists, all_runs(lists))


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant: bool = False) -> DataFrame:
    """(id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256), one row per input row.

    ``start`` to ``exponent_milli`` are the longest run's (ties: smallest start, then period; no run: nulls);
    ``runs_sha256`` digests every run, ``collapsed_sha256`` the text without what runs repeat: a word is dropped if
    any run has it after its first period. With ``plant`` a tenth of the texts, by their ids, first get a
    periodic end (``planted``; a text without an id gets none). A null text is an empty one: no words, no runs. Rows
    that repeat each have their row, other columns are ignored, an empty table gives an empty result. Texts never
    meet, so nothing is shuffled; a text longer than ``BLOCK`` is a block of its own.
    """
    return map_texts(id_and_text(df, id_col, text_col), lambda: lambda rows: results(rows, plant), COLUMNS,
                     with_ids=True).withColumnRenamed("doc_id", id_col)
