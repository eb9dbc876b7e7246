"""Frequent keywords from mergeable summaries, against exact counts."""

import random
from collections import Counter

import pytest

from conftest import SF_SMALL
from topicpulse.operators.heavy import frequent_keywords, keyword_summary, merge_summaries, summary_store

ROWS = "topic string, keywords array<string>"


def exact(rows):
    return Counter((t, k) for t, ks in rows for k in ks or [] if k is not None)


def check(summary, rows, capacity):
    """Bounds of every keyword, size and error of every topic."""
    got = summary.collect()
    counts = exact(rows)
    total = Counter()
    for (t, _), n in counts.items():
        total[t] += n
    error = {r.topic: r.error for r in got if r.keyword is None}
    assert sorted(map(str, error)) == sorted(map(str, total)) == sorted(str(r.topic) for r in got if r.keyword is None)
    assert all(r.error == error[r.topic] and r.total == total[r.topic] for r in got)
    assert all(error[t] * (capacity + 1) <= total[t] for t in error)
    least = {(r.topic, r.keyword): r["count"] for r in got if r.keyword is not None}
    assert max(Counter(t for t, _ in least).values(), default=0) <= capacity
    assert all(least.get(k, 0) <= n <= least.get(k, 0) + error[k[0]] for k, n in counts.items())
    assert set(least) <= set(counts) and all(n > 0 for n in least.values())
    return error


def made(seed, n):
    rng = random.Random(seed)
    return [(rng.choice(["a", "a", "b", None]), [f"w{int(rng.paretovariate(.6)) % 60}" for _ in range(rng.randint(0, 5))])
            for _ in range(n)] + [("a", None), ("b", [None, "w1"]), ("c", ["only"]), ("d", [])]


@pytest.mark.parametrize("capacity", [1, 4, 1000])
def test_bounds_hold_however_summaries_are_merged(spark, capacity):
    parts = [made(s, 120) for s in range(3)]
    frames = [keyword_summary(spark.createDataFrame(p, ROWS), capacity) for p in parts]
    check(frames[0], parts[0], capacity)
    together = frames[0].unionByName(frames[1]).unionByName(frames[2])
    error = check(merge_summaries(together, capacity), sum(parts, []), capacity)
    two = merge_summaries(frames[2].unionByName(frames[0]), capacity)
    check(merge_summaries(two.unionByName(frames[1]), capacity), sum(parts, []), capacity)
    if capacity == 1000:
        assert set(error.values()) == {0}       # nothing was cut: the counts are exact


def test_certain_keywords_are_the_most_frequent(spark):
    rows = [("t", ["x"])] * 50 + [("t", ["y"])] * 30 + [("t", [f"r{i}"]) for i in range(20)]
    got = frequent_keywords(keyword_summary(spark.createDataFrame(rows, ROWS), 4), 2).orderBy("rank").collect()
    assert [(r.keyword, r.least, r.most, r.certain, r["rank"]) for r in got] == [
        ("x", 49, 50, True, 1), ("y", 29, 30, True, 2)]
    flat = [("t", [f"r{i}"]) for i in range(20)]
    assert frequent_keywords(keyword_summary(spark.createDataFrame(flat, ROWS), 4)).count() == 0    # none is frequent
    assert keyword_summary(spark.createDataFrame([], ROWS)).count() == 0
    with pytest.raises(ValueError):
        keyword_summary(spark.createDataFrame([], ROWS), 0)


def test_stored_summaries_survive_replay_and_compaction(spark, tmpdir_path):
    store = summary_store(spark, f"{tmpdir_path}/keywords", capacity=4, fanout=2)
    parts = [made(10 + s, 60) for s in range(5)]
    for n, p in enumerate(parts):
        for _ in range(2):      # every batch comes twice
            store.append(keyword_summary(spark.createDataFrame(p, ROWS), 4), n)
    assert len(store.segments()) < 5
    check(merge_summaries(store.read(), 4), sum(parts, []), 4)


def test_streamed_summaries_cover_the_stored_keywords(spark, tmpdir_path):
    from test_jobs import bus_files
    from topicpulse.sources.bus import read_bus
    from topicpulse.sources.tables import keyword_stopwords, seed_lexicon
    from topicpulse.streaming.stream import run_stream
    bus_files(spark, f"{tmpdir_path}/bus")
    q = run_stream(spark, read_bus(spark, path=f"{tmpdir_path}/bus"), f"{tmpdir_path}/out", seed_lexicon(spark),
                   keyword_stopwords(spark), checkpoint=f"{tmpdir_path}/ckpt", available_now=True)
    q.awaitTermination(300)
    assert q.exception() is None
    rows = [(r.topic, r.keywords) for r in spark.read.parquet(f"{tmpdir_path}/out/results").select("topic", "keywords").collect()]
    check(merge_summaries(summary_store(spark, f"{tmpdir_path}/out/keywords").read()), rows, 256)
