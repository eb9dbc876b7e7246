"""Periodic runs against brute force over all periods."""

import hashlib
import random
import zlib

import numpy as np
import pytest

import topicpulse.llm.periodic_runs as R
from topicpulse.llm.periodic_runs import periodic_runs

from llm_cases import collected, documents, edge_rows, frame, words


def brute_runs(w):
    """(begin, end, smallest period) of every run: for each period its maximal stretches."""
    n, found = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(12, 2 * q):
                if not any(q % r == 0 and all(w[k] == w[k + r] for k in range(i, j + q - r)) for r in range(1, q)):
                    found.append((i, j + q, q))
            i = max(j, i + 1)
    return sorted(found)


def brute_row(doc_id, text, plant):
    for c in "\t\n\v\f\r":
        text = (text or "").replace(c, " ")
    w = [x for x in text.split(" ") if x]
    h = zlib.crc32(str(doc_id).encode())
    if plant and doc_id is not None and w and h % 10 == 0:
        a = h // 10 % len(w)
        p = 1 + (len(w) - a) // (3 + h // 10 % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    runs = brute_runs(w)
    gone = {i for b, e, q in runs for i in range(b + q, e)}
    b, e, q = min(runs, key=lambda r: (r[0] - r[1], r[0], r[2]), default=(None,) * 3)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()      # noqa: E731
    return (doc_id, len(runs), b, b if b is None else e - b, q, q if q is None else 1000 * (e - b) // q,
            sha("".join(f"{b},{e - b},{q}\n" for b, e, q in runs)),
            sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def odd_lists(rng):
    k, n = rng.choice([1, 2, 2, 3, 5, 30]), rng.randint(0, 70)
    base = [b"%d" % rng.randrange(k) for _ in range(n)]
    kind = rng.randrange(5)
    if kind == 1:                                                   # a period among others
        base = ((base[:rng.randint(1, 9)] or [b"x"]) * 20)[:rng.randint(0, 60)] + base[:20]
    elif kind == 2:                                                 # Fibonacci words: runs within runs
        a, b = [b"a"], [b"a", b"b"]
        for _ in range(rng.randint(2, 7)):
            a, b = b, b + a
        base = b[:80]
    elif kind == 3:                                                 # runs that overlap at a boundary
        base = ([b"a"] * rng.randint(5, 25) + [b"%d" % rng.randrange(3)]) * rng.randint(1, 4)
    elif kind == 4:                                                 # repeats that are no runs
        base = (base + [b"z"] + base + [b"y"] + base)[:150]
    return base


@pytest.mark.parametrize("seed", range(4))
def test_runs_match_brute_force(seed):
    rng = random.Random(seed)
    found = 0
    for _ in range(60):
        lists = [odd_lists(rng) for _ in range(rng.randint(1, 12))]
        want = [brute_runs(w) for w in lists]
        assert R.all_runs(lists) == want
        found += sum(map(len, want))
    assert found > 300


def test_grammar_spells_its_texts_and_no_pair_is_left_twice():
    rng = random.Random(9)
    for _ in range(30):
        t = np.array([rng.randrange(3) for _ in range(rng.randint(2, 200))])
        grammar, rest, owner = R.re_pair(t, np.zeros(len(t), np.int64), 3)

        def spelled(x):
            return [x] if x < 3 else spelled(grammar.left[x - 3]) + spelled(grammar.right[x - 3])
        assert [w for x in rest for w in spelled(x)] == t.tolist()
        assert grammar.size[rest].sum() == len(t)
        pairs = list(zip(rest[:-1].tolist(), rest[1:].tolist()))
        assert len(set(pairs)) >= len(pairs) - 1        # an "aaa" at the end may hold one pair twice, overlapping
        root, = R.halved(grammar, rest, owner)
        assert spelled(root) == t.tolist()


def test_query_matches_brute_force(spark):
    rng = random.Random(5)
    rows = edge_rows() + [(r.doc_id + 1000, r.text) for r in documents(spark).select("doc_id", "text").collect()
                          if len(r.text) < 4000]
    rows += [(5000 + i, words(rng, rng.randint(1, 60))) for i in range(60)]                 # short ones with planted ends
    rows += [(6000, "one two  three\tfour\n" * 9), (6001, " ".join(["x"] * 11)), (6002, " ".join(["x"] * 12))]
    for plant in (True, False):
        got = collected(periodic_runs(frame(spark, rows), plant=plant))
        assert got == sorted((brute_row(i, t, plant) for i, t in rows), key=repr)
    assert sum(r[1] > 0 for r in got) > 5
    assert periodic_runs(frame(spark, rows).limit(0), plant=True).collect() == []


def test_very_long_texts(spark):
    rng = random.Random(6)
    unit = words(rng, 7000).split()
    rows = [(1, "a " * 300_000), (2, " ".join(unit * 9)), (3, " ".join(unit) + " end " + " ".join(unit))]
    got = {r.doc_id: r for r in periodic_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1][1:6] == (1, 0, 300_000, 1, 300_000_000)
    assert got[2][1:6] == (1, 0, 63_000, 7000, 9000)
    assert got[2].collapsed_sha256 == hashlib.sha256(" ".join(unit).encode()).hexdigest()
    assert got[3].n_runs == 0 and got[3].start is None
