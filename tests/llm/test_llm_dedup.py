"""Near-duplicates, repeated spans, repeated bytes, leaks and the pipeline, each against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash

import topicpulse.llm.suffix_dedup as S
from topicpulse.llm import decontaminate as D
from topicpulse.llm import span_dedup as X
from topicpulse.llm.components import components
from topicpulse.llm.simhash import keep_one, links, simhash_components

from llm_cases import collected, documents, edge_rows, frame, sentences, words


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    counts = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g, 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(grams))


def brute_components(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3 and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {}
    for (i, _), g in zip(rows, group):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    return sorted(((i, f"{f:016x}", least.get(g)) for (i, _), f, g in zip(rows, fps, group)), key=repr)


def first_of_each(rows):
    """Of each group of rows linked by their fingerprints the one with the smallest id, then digest; all rows without id."""
    fps = [brute_fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3 and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    best = {}
    for g, row in zip(group, rows):
        place = (row[0] or 0, "" if row[1] is None else hashlib.sha256(row[1].encode()).hexdigest())
        if row[0] is not None and (g not in best or place < best[g][0]):
            best[g] = place, row
    return [row for _, row in best.values()] + [r for r in rows if r[0] is None]


def test_simhash_components_match_brute_force(spark):
    rows = edge_rows() + [(r.doc_id + 1000, r.text) for r in documents(spark).select("doc_id", "text").collect()]
    assert collected(simhash_components(frame(spark, rows))) == brute_components(rows)
    assert simhash_components(frame(spark, rows).limit(0)).collect() == []


def test_no_link_is_lost(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = {f ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for f in base for _ in range(25)} | {0, 1, 2 ** 63}
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    got = {tuple(sorted(r)) for r in links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()}
    want = {tuple(sorted((a, b))) for a in signed for b in signed
            if a < b and ((a ^ b) & (2 ** 64 - 1)).bit_count() <= 3}
    assert got == want and len(want) > 500
    with pytest.raises(ValueError):
        links(spark.createDataFrame([(1,)], "fp long"), 4)


def test_components_of_a_long_chain(spark):
    pairs = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7), (None, 3)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(pairs, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_one_document_of_each_group_stays(spark):
    rows = edge_rows()
    got = keep_one(frame(spark, rows))
    want = first_of_each(rows)
    assert got.columns == frame(spark, rows).columns
    assert collected(got.select("doc_id", "text")) == sorted(want, key=repr)
    assert sum(i is None for i, _ in want) == 2 and sum(i == 10 for i, _ in want) == 2


def test_groups_that_share_an_id_each_keep_one(spark):
    rng = random.Random(17)
    a, b, x, y = (words(rng, 80) for _ in range(4))
    rows = [(10, a), (10, b), (3, x), (20, x), (20, y), (25, x), (30, a), (10, b)]
    for order in (rows, rows[::-1]):
        got = collected(keep_one(frame(spark, order)).select("doc_id", "text"))
        assert got == sorted([(10, a), (10, b), (3, x), (20, y)], key=repr)
    # of one group's rows with the smallest id one stays, the same in any order
    got = [collected(keep_one(frame(spark, o)).select("doc_id", "text")) for o in ([(1, a), (1, a + " ")], [(1, a + " "), (1, a)])]
    assert got[0] == got[1] and len(got[0]) == 1


def brute_spans(rows):
    """Expected (id, text, n_sentences, n_removed): every span that is long enough but shorter at one end isn't."""
    out, seen = [], {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        pieces, places, w = X.cut(t)
        size, drop = [len(x) for x in w], set()

        def full(a, b):
            n = sum(size[a:b + 1])
            return b >= a and (n >= 25 or (b - a >= 2 and n >= 12))

        for a in range(len(w)):
            for b in range(a, len(w)):
                if full(a, b) and not (full(a, b - 1) and full(a + 1, b)):
                    key = tuple(" ".join(x) for x in w[a:b + 1])
                    if seen.setdefault(key, (i, a)) != (i, a):
                        drop.update(range(a, b + 1))
        for s in drop:
            pieces[places[s]] = ""
            if places[s] + 1 < len(pieces):
                pieces[places[s] + 1] = ""
        out.append((i, "".join(pieces) if t is not None else None, len(w), len(drop)))
    return sorted(out, key=repr)


def test_repeated_spans_match_brute_force(spark):
    rng = random.Random(9)
    passage = sentences(rng, 8)
    rows = [(i, sentences(rng, rng.randint(0, 5)) + " " + (passage if i % 3 == 0 else "") + " " + sentences(rng, 3))
            for i in range(12)] + [(50, None), (51, ""), (52, words(rng, 60) + "."), (None, passage), (53, "Er. Er. Er. Er.")]
    rows += [(54, rows[-3][1]), (55, "Er. Er. Er. Er.")]
    got = X.remove_repeated(frame(spark, rows))
    assert sorted(((r["doc_id"], r["text"], r["n_sentences"], r["n_removed"]) for r in got.collect()), key=repr) \
        == brute_spans(rows)
    assert got.columns[:2] == ["doc_id", "text"] and "kept" in got.columns
    by = {r["doc_id"]: r for r in got.collect()}
    assert by[0]["n_removed"] == 0 and by[3]["n_removed"] >= 8 and by[3]["first_docs"] == [0]
    assert passage not in by[3]["text"] and by[55]["n_removed"] == 0
    assert X.remove_repeated(frame(spark, rows).limit(0)).collect() == []


def test_spans_cover_a_passage_to_its_ends():
    rng = random.Random(5)
    for _ in range(200):
        sizes = [rng.randint(1, 15) for _ in range(rng.randint(1, 12))]
        found = X.spans(sizes)
        if sum(sizes) >= 25:
            assert {i for a, b in found for i in range(a, b + 1)} == set(range(len(sizes)))
        assert all(sum(sizes[a:b + 1]) >= 12 for a, b in found)


def test_cutting_keeps_every_character():
    assert all("".join(X.cut(t)[0]) == (t or "") for _, t in edge_rows())


def brute_bytes(rows):
    data, times = [(i, (t or "").encode()) for i, t in rows], {}
    for _, d in data:
        for a in range(len(d) - 199):
            times[d[a:a + 200]] = times.get(d[a:a + 200], 0) + 1
    out = []
    for i, d in data:
        gone = [False] * len(d)
        for a in range(len(d) - 199):
            if times[d[a:a + 200]] > 1:
                gone[a:a + 200] = [True] * 200
        runs = sum(g and not (j and gone[j - 1]) for j, g in enumerate(gone))
        kept = bytes(c for c, g in zip(d, gone) if not g)
        out.append((i, len(d), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot, chunk", [(2000, 1 << 20), (2, 1 << 20), (2000, 300)])
def test_repeated_bytes_match_brute_force(spark, monkeypatch, hot, chunk):
    monkeypatch.setattr(S, "HOT", hot)
    monkeypatch.setattr(S, "CHUNK", chunk)
    rows = [(i, t if len(t or "") < 8000 else t[:8000]) for i, t in edge_rows()]
    rng = random.Random(6)
    p = words(rng, 80)
    rows += [(60, p), (61, "x" + p), (62, p[:250] + p[:250]), (63, p[40:239]), (64, words(rng, 20) + p[40:300])]
    assert collected(S.remove_repeats(frame(spark, rows), with_bytes=False)) == brute_bytes(rows)


def test_long_runs_of_one_byte_go_past_one_task(spark, monkeypatch):
    """Groups are bounded by bytes: few phrases of many bytes each are dealt out, too."""
    monkeypatch.setattr(S, "HOT", 100_000)
    rng = random.Random(14)
    rows = [(i, words(rng, 10) + " " * (20_000 + 300 * i) + words(rng, 10)) for i in range(8)]
    assert collected(S.remove_repeats(frame(spark, rows), with_bytes=False)) == brute_bytes(rows)


def test_repeated_bytes_of_all_documents(spark):
    rows = [(r.doc_id, r.text) for r in documents(spark).select("doc_id", "text").collect()]
    out = S.remove_repeats(documents(spark))
    assert collected(out.drop("kept")) == brute_bytes(rows)
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in out.collect())
    assert S.remove_repeats(documents(spark).limit(0)).collect() == []


def test_suffix_ranks_are_the_order_of_strings():
    data = np.frombuffer(b"banana bandana banana band", np.uint8)
    ranks = S.suffix_ranks(data, 6).tolist()
    strings = [data[i:i + 6].tobytes() for i in range(len(data) - 5)]
    order = {s: k for k, s in enumerate(sorted(set(strings)))}
    assert ranks == [order[s] for s in strings]


def brute_leaks(rows, items):
    out = []
    for i, t in rows:
        w = D.words_of(t)
        has = lambda s: any(tuple(w[j:j + len(s)]) == s for j in range(len(w) - len(s) + 1))
        for item, text in items:
            q, a = D.question_answer(text)
            share = lambda g: sum(map(has, g)) / len(g) if g else 1.0
            if D.shingles(q + a) and share(D.shingles(q)) >= .8 and share(D.shingles(q + a)) >= .8:
                out.append((i, item))
    return sorted(out, key=repr)


def test_leaks_match_brute_force(spark):
    rng = random.Random(8)
    items = [(i, sentences(rng, rng.randint(1, 6))) for i in range(30)] + [(40, None), (41, ""), (42, sentences(rng, 40))]
    rows = edge_rows()[:14]
    for i, t in items[:20]:
        rows.append((100 + i, words(rng, rng.randint(0, 300)) + " " + t.upper().replace(".", " !") + " " + words(rng, 90)))
    rows += [(200, sentences(rng, 3) + items[-1][1]), (201, items[3][1][: len(items[3][1]) // 2]),
             (202, items[5][1] + items[6][1]), (202, items[5][1] + items[6][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.leaks(frame(spark, rows), bench)
    assert sorted(((r["doc_id"], r["item_id"]) for r in got.collect()), key=repr) == brute_leaks(rows, items)
    assert all(0 < r["score"] <= 1 and r["question_overlap"] >= .8 for r in got.collect())
    left = D.without_leaks(frame(spark, rows), bench)
    assert left.columns == frame(spark, rows).columns
    bad = {i for i, _ in brute_leaks(rows, items)}
    assert sorted(map(repr, (r["doc_id"] for r in left.collect()))) == sorted(repr(i) for i, _ in rows if i not in bad)


def test_leaks_with_parts_far_apart_match_brute_force(spark):
    rng = random.Random(21)
    items = [(i, sentences(rng, 1 + i % 4)) for i in range(24)] + [(30, "Who? Me."), (31, sentences(rng, 30))]
    items += [(40 + i, f"{words(rng, 26)}. {words(rng, 26)}.") for i in range(6)]       # either part is about a half
    rows = []
    for i, t in items:
        parts = [s for s in D.SENTENCE.split(t) if s]
        rows.append((i, (" " + words(rng, 210) + " ").join([" ".join(parts[:-1]), parts[-1]])))     # answer far away
        rows.append((100 + i, (" " + words(rng, 210) + " ").join(parts)))       # every sentence far away
        rows.append((200 + i, words(rng, 210) + " " + " ".join(parts[:-1])))    # the question alone
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.leaks(frame(spark, rows), bench)
    want = brute_leaks(rows, items)
    assert sorted(((r["doc_id"], r["item_id"]) for r in got.collect()), key=repr) == want
    left = {r["doc_id"] for r in D.without_leaks(frame(spark, rows), bench).collect()}
    assert left == {i for i, _ in rows} - {i for i, _ in want}


def test_leaks_in_shards_and_of_nothing(spark, monkeypatch):
    rng = random.Random(12)
    items = [(i, sentences(rng, 3)) for i in range(9)]
    rows = [(i, words(rng, 30) + " " + t) for i, t in items]
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = collected(D.leaks(frame(spark, rows), bench))
    monkeypatch.setattr(D, "SHARD_ITEMS", 2)
    assert collected(D.leaks(frame(spark, rows), bench)) == whole and len(whole) == 9
    assert D.leaks(frame(spark, rows), bench.limit(0)).collect() == []
    assert D.without_leaks(frame(spark, rows), bench.limit(0)).count() == 9
    assert D.leaks(frame(spark, rows).limit(0), bench).collect() == []


def test_wand_finds_all_above_the_threshold():
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(120)]
    items = [(i, " ".join(rng.choice(vocab[: rng.choice((10, 120))]) for _ in range(rng.randint(5, 60)))) for i in range(90)]
    df = {}
    for _, t in items:
        for s in D.segments(t):
            for x in set(s):
                df[x] = df.get(x, 0) + 1
    n = sum(len(D.segments(t)) for _, t in items)
    index = D.Index(items, df, n, 30.0)
    for _ in range(200):
        terms, threshold = sorted(rng.sample(range(len(index.number)), 25)), rng.choice([.05, .2, .4, .7])
        total = {}
        for t in terms:
            for d, x in zip(index.docs[t], index.impacts[t]):
                total[d] = total.get(d, 0) + x
        want = sorted(d for d, x in total.items() if x >= threshold - 1e-9)
        assert sorted(d for d, _ in index.wand(terms, threshold)) == want
        assert sorted(d for d, _ in index.wand(terms, threshold, 20, 50)) == [d for d in want if 20 <= d < 50]


@pytest.mark.parametrize("overlap", [.3, .5, .8, 1.0])
def test_thresholds_lose_no_item(overlap):
    """What the index retrieves and verifies is what verification alone accepts, for shingles in any order and places."""
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(" ".join(rng.choice(vocab[:rng.choice((2, 6, 60))]) for _ in range(rng.choice((1, 3, 6, 20))))
                          + "." for _ in range(rng.randint(1, 4)))) for i in range(40)]
    df = {}
    for _, t in items:
        for part in D.segments(t):
            for x in set(part):
                df[x] = df.get(x, 0) + 1
    n = sum(len(D.segments(t)) for _, t in items)
    index = D.Index(items, df, n, 9.0, overlap)
    texts = [None, "", "w1"]
    for _, t in items:
        runs = sorted(set().union(*map(D.shingles, (*D.question_answer(t), sum(D.question_answer(t), [])))))
        for share in (.2, .5, .8, .9, 1):       # some of the item's shingles, in any order, with other words between
            some = rng.sample(runs, round(share * len(runs)))
            texts.append(" zz ".join(b" ".join(r).decode() for r in some))
    hits = 0
    for text, got in zip(texts, index.leaks(texts)):
        w = D.words_of(text)
        document = {tuple(w[k:k + m]) for m in range(1, 6) for k in range(len(w) - m + 1)}
        assert [x[0] for x in got] == [k for k in range(len(items)) if index.verify(k, document)]
        hits += len(got)
    assert hits > 30
