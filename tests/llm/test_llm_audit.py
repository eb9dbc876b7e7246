"""The filter interaction audit against brute force over documents, orders and steps."""

import random
from itertools import permutations

import numpy as np
from pyspark.sql import functions as F

from topicpulse.llm.filter_audit import FILTERS, Diagram, audit_part, filter_audit, swaps

from llm_cases import collected, edge_rows, words


def brute_masks(rows):
    """(part, failed filters, quality, toxic) of every row (id, text, part, quality, toxic)."""
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    for i, t, part, quality, toxic in rows:
        t = t or ""
        w = [x for x in t.replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if x]
        failed = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w),
                  "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": any(c in "#$%&*|" for c in t),
                  "E": i is not None and least[t] < i}
        yield part or "", {k for k, v in failed.items() if v}, quality == 1, toxic == 1


def brute_audit(rows):
    out = []
    judged = list(brute_masks(rows))
    for part in {p for p, *_ in judged}:
        own = [x[1:] for x in judged if x[0] == part]
        shapley = dict.fromkeys(FILTERS, 0)
        lines = []
        for order in permutations(FILTERS):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                shapley[f] += len(gone)
                lines.append((f, (part, "".join(order), step, len(left), len(gone),
                                  sum(f in x[0] for x in own) - len(gone), sum(x[0] == {f} for x in own),
                                  sum(x[1] for x in gone), sum(x[2] for x in gone))))
        out += [(*r, shapley[f]) for f, r in lines]
    return sorted(out, key=repr)


def test_swaps_visit_every_order_once():
    for n in range(1, 6):
        order, seen = list(range(n)), {tuple(range(n))}
        for level in swaps(n):
            order[level], order[level + 1] = order[level + 1], order[level]
            assert tuple(order) not in seen
            seen.add(tuple(order))
        assert len(seen) == len(list(permutations(range(n))))


def test_diagram_stays_the_same_function_after_swaps():
    rng = random.Random(2)
    counts = {m: np.array([rng.randint(1, 9), rng.randint(0, 2), 0]) for m in rng.sample(range(32), 17)}
    d = Diagram(counts, FILTERS)
    for level in swaps(5):
        d.swap(level)
        for m in range(32):
            at = d.root
            for v in d.order:
                at = None if at is None else d.nodes[at][1 + (m >> v & 1)]
            assert (at is None) == (m not in counts)
            assert at is None or d.weight[at].tolist() == counts[m].tolist()
    assert all(r[2:] == (0,) * 7 for r in audit_part({}))


def test_audit_matches_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, t) for i, t in edge_rows()]
    rows += [(100 + i, words(rng, rng.choice([150, 250]))) for i in range(12)]
    rows += [(200 + i, rows[-1 - i % 3][1]) for i in range(20)]                       # copies
    rows += [(300, "Loud " * 300), (301, words(rng, 220) + " #"), (302, "word " * 60_000)]
    full = [(i, t, [None, "", "web", "a b", "hot", "hot"][k % 6]) for k, (i, t) in enumerate(rows)]
    marks = {i: (rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i, _ in rows if i is not None and i % 3}
    docs = spark.createDataFrame(full, "doc_id long, text string, source string").withColumns(
        {c: F.lit(1) for c in ("part", "mask", "digest", "n", "first", "good", "toxic", "quality")})
    labels = spark.createDataFrame([(i, q, t) for i, (q, t) in marks.items()] + [(None, 1, 1), (9999, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    want = brute_audit([(i, t, p, *marks.get(i, (0, 0))) for i, t, p in full])
    got = filter_audit(docs, labels)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails",
                           "good_lost", "toxic_lost", "shapley"]
    assert collected(got) == want and any(r[6] for r in want) and any(r[5] for r in want)
    assert filter_audit(docs.limit(0), labels).collect() == []
    unmarked = brute_audit([(i, t, p, 0, 0) for i, t, p in full])
    assert collected(filter_audit(docs, labels.limit(0))) == unmarked


def test_an_id_with_two_labels_counts_once(spark):
    docs = spark.createDataFrame([(1, "few words", "a"), (1, "few words", "a")], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1)], "doc_id long, quality int, toxic int")
    row = filter_audit(docs, labels).where("filter_order = 'ABCDE' and step = 1").first()
    assert (row.kept, row.removed, row.good_lost, row.toxic_lost) == (0, 2, 2, 2)
