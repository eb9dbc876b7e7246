"""Stores whose manifest is written last: growth, replays, and a crash at every step."""

import datetime as dt
import os
import shutil

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import topicpulse.streaming.store
from topicpulse.operators import aggregates as A
from topicpulse.operators import partials as P
from topicpulse.sources.tables import AS_OF, scan_lookback
from topicpulse.sources.testdata import scored_from_events
from topicpulse.streaming.sinks import id_store, insert_new_only, publish_views, read_view
from topicpulse.streaming.store import Conflict, Files, Manifests, SegmentStore, ViewStore

from conftest import SF_SMALL


class Crash(Exception):
    pass


def folders(root):
    return len(os.listdir(f"{root}/data"))


def rows(spark, ids, batch):
    return spark.createDataFrame([(i, 0, batch) for i in ids], "post_id string, id_bucket int, batch_id bigint")


def content(store):
    return sorted(tuple(r) for r in store.read().collect())


class LocalFiles(Files):
    """The same operations on a local folder, without a call to the JVM for each name."""

    def names(self, folder):
        return sorted(os.listdir(f"{self.root}/{folder}")) if os.path.isdir(f"{self.root}/{folder}") else []

    def delete(self, name):
        at = f"{self.root}/{name}"
        shutil.rmtree(at) if os.path.isdir(at) else os.remove(at)

    def read(self, name):
        with open(f"{self.root}/{name}", "rb") as f:
            return f.read()

    def create(self, name, data):
        os.makedirs(os.path.dirname(f"{self.root}/{name}"), exist_ok=True)
        with open(f"{self.root}/{name}", "xb") as f:
            f.write(data)


def test_a_thousand_batches_leave_few_files(spark, tmpdir_path, monkeypatch):
    """Files are written without Spark; folders, manifests and compaction are the real ones."""
    def write(self, table, name):
        folder = self.manifests.new_folder(name)
        os.makedirs(f"{self.root}/{folder}")
        pq.write_table(table, f"{self.root}/{folder}/part.parquet")
        return folder

    def read(self, segments):
        return pa.concat_tables([pq.read_table(f"{self.root}/{s['folder']}/part.parquet") for s in segments])

    monkeypatch.setattr(topicpulse.streaming.store, "Files", LocalFiles)
    monkeypatch.setattr(SegmentStore, "_write", write)
    monkeypatch.setattr(SegmentStore, "_rows", read)
    store = id_store(spark, tmpdir_path)
    most = 0
    for n in range(1000):
        assert store.append(pa.table({"post_id": [str(n)], "batch_id": [n]}), n)
        most = max(most, folders(store.root))
    assert len(store.segments()) <= 4 * store.fanout and most <= 8 * store.fanout
    assert len(os.listdir(f"{store.root}/_manifests")) <= 40
    got = store.read()
    assert got.num_rows == 1000 and set(got["batch_id"].to_pylist()) == set(range(1000))
    # replays: of the newest batch, and of one that is part of a larger segment
    assert store.append(pa.table({"post_id": ["999"], "batch_id": [999]}), 999)
    assert not store.append(pa.table({"post_id": ["x"], "batch_id": [3]}), 3)
    assert sorted(store.read()["batch_id"].to_pylist()) == list(range(1000))
    levels = [s["level"] for s in store.segments()]
    assert max(levels) == 3 and all(levels.count(x) <= store.fanout for x in levels)


def test_id_store_dedupes_over_compacted_segments(spark, tmpdir_path):
    store = id_store(spark, tmpdir_path, fanout=2)
    t = dt.datetime(2024, 1, 1)
    seen = {}
    for n in range(7):
        ids = [str(i) for i in range(5 * n, 5 * n + 12)] + ["0", str(5 * n)]
        batch = spark.createDataFrame([(i, t) for i in ids], "post_id string, processed_at timestamp")
        for again in range(2):                                       # every batch comes twice
            new = insert_new_only(store.read(), batch, n)
            got = sorted(r.post_id for r in new.collect())
            if not again:
                assert got == sorted(set(ids) - set(seen))
                seen.update(dict.fromkeys(got, n))
            elif n == 6:
                assert got == sorted(i for i, b in seen.items() if b == n)
            store.append(new, n)
    assert {r.post_id: r.batch_id for r in store.read().collect()} == seen
    assert len(store.segments()) <= 4 and any(s["level"] for s in store.segments())


@pytest.mark.parametrize("where", ["_write", "commit", "vacuum"])
def test_a_crash_while_appending_or_compacting_loses_nothing(spark, tmpdir_path, monkeypatch, where):
    owner = SegmentStore if where == "_write" else Manifests
    real, calls, when = getattr(owner, where), [0], [None]

    def breaking(self, *args, **kwargs):
        calls[0] += 1
        if calls[0] == when[0]:
            if where == "_write":
                real(self, *args, **kwargs)                          # written, but never named
            raise Crash
        return real(self, *args, **kwargs)

    monkeypatch.setattr(owner, where, breaking)
    store = SegmentStore(spark, tmpdir_path, "post_id string, id_bucket int, batch_id bigint", ["post_id"], fanout=2, keep=2)
    want, broke = [], 0
    for n in range(5):
        for step in (1, 2, 3, None):                                 # break at the first call, the second, ...; then run through
            calls[0], when[0] = 0, step
            before = content(store)
            try:
                store.append(rows(spark, [str(n)], n), n)
            except Crash:
                broke += 1
                assert content(store) in (before, sorted(before + [(str(n), 0, n)]))
        want.append((str(n), 0, n))
        assert content(store) == want
    assert broke >= 5
    when[0] = None
    store.append(rows(spark, ["z"], 99), 99)
    assert folders(tmpdir_path) <= 12


def test_a_broken_manifest_is_passed_over_and_two_writers_conflict(spark, tmpdir_path):
    store = SegmentStore(spark, tmpdir_path, "post_id string, id_bucket int, batch_id bigint", ["post_id"])
    store.append(rows(spark, ["a"], 0), 0)
    number, state = store.manifests.newest()
    store.manifests.files.create(f"_manifests/{number + 1:012d}.json", b'{"segments": [')
    assert content(store) == [("a", 0, 0)]
    store.append(rows(spark, ["b"], 1), 1)
    assert content(store) == [("a", 0, 0), ("b", 0, 1)]
    with pytest.raises(Conflict):
        store.manifests.commit({"segments": []}, number)


def test_views_are_published_all_at_once(spark, tmpdir_path, monkeypatch):
    def views(n):
        t = AS_OF
        agg = spark.createDataFrame([("a", t, t, float(n))], "topic string, period_start timestamp, created_at timestamp, avg_sentiment double")
        return {"topic_aggregates": agg, "hourly_trends": spark.createDataFrame([("a", n)], "topic string, n int")}

    def state():
        return [read_view(spark, tmpdir_path, v, AS_OF).select(c).first()[0]
                for v, c in (("topic_aggregates", "avg_sentiment"), ("hourly_trends", "n"), ("alerts", "n"))]

    derived = lambda done: {"alerts": done["hourly_trends"].drop("batch_time")}       # noqa: E731
    publish_views(views(1), tmpdir_path, AS_OF, derived)
    assert state() == [1.0, 1, 1]
    held = read_view(spark, tmpdir_path, "hourly_trends", AS_OF)
    for owner, name, calls in ((ViewStore, "stage", 3), (Manifests, "commit", 1)):
        real = getattr(owner, name)
        for k in range(1, calls + 1):
            left = [k]

            def breaking(self, *args, **kwargs):
                left[0] -= 1
                if left[0] == 0:
                    raise Crash
                return real(self, *args, **kwargs)
            monkeypatch.setattr(owner, name, breaking)
            with pytest.raises(Crash):
                publish_views(views(2), tmpdir_path, AS_OF, derived)
            monkeypatch.setattr(owner, name, real)
            assert state() == [1.0, 1, 1]
    publish_views(views(3), tmpdir_path, AS_OF, derived)
    assert state() == [3.0, 3, 3]
    assert held.count() == 1                                         # a reader from before still has its files
    publish_views(views(4), tmpdir_path, AS_OF + dt.timedelta(hours=1), derived)
    assert state() == [3.0, 3, 3] and read_view(spark, tmpdir_path, "hourly_trends").count() == 2
    assert read_view(spark, tmpdir_path, "no such view") is None
    for n in range(12):
        publish_views(views(n), tmpdir_path, AS_OF, derived)
    assert folders(tmpdir_path) <= 3 * 10


def test_views_of_states_equal_the_full_recomputation(spark, tmpdir_path):
    s = scored_from_events(spark, SF_SMALL).withColumn(
        "sentiment_e4", F.when(F.col("topic") != "view", F.col("sentiment_e4"))).cache()
    late = F.col("processed_at") + F.when(F.col("topic") == "error", F.expr("INTERVAL 3 DAYS")).otherwise(F.expr("INTERVAL 0 DAYS"))
    slot = F.floor(F.unix_timestamp(late) / (5 * 86400))
    store = P.state_store(spark, tmpdir_path, fanout=2)
    slots = sorted(r[0] for r in s.select(slot).distinct().collect())
    for n, x in enumerate(slots):
        for _ in range(2):                                           # replayed
            store.append(P.partial_states(s.where(slot == x)), n)
    assert len(slots) > 5 and any(g["level"] > 1 for g in store.segments())
    for as_of, hours in ((AS_OF, 24 * 31), (AS_OF, 30), (AS_OF - dt.timedelta(minutes=20), 240)):
        part = scan_lookback(s, as_of=as_of, hours=hours)
        states = P.lookback_states(store.read(), as_of, hours, s)
        for of, full in ((P.topic_aggregates_of, A.topic_aggregates), (P.hourly_trends_of, A.hourly_trends),
                         (P.source_breakdown_of, A.source_breakdown)):
            got, want = of(states), full(part)
            assert got.columns == want.columns
            assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    with pytest.raises(ValueError):
        P.lookback_states(store.read(), AS_OF - dt.timedelta(minutes=20), 24)
    assert P.topic_aggregates_of(store.read().limit(0)).collect() == []


def test_run_batch_from_partial_states_equals_run_batch(spark, tmpdir_path):
    from topicpulse.plans.batch import run_batch
    s = scored_from_events(spark, SF_SMALL)
    s.write.parquet(f"{tmpdir_path}/scored")
    P.state_store(spark, f"{tmpdir_path}/partials").append(P.partial_states(s), 0)
    full = run_batch(spark, [f"{tmpdir_path}/scored"], f"{tmpdir_path}/v1", AS_OF, 72)
    fast = run_batch(spark, [f"{tmpdir_path}/scored"], f"{tmpdir_path}/v2", AS_OF, 72, partials=f"{tmpdir_path}/partials")
    assert set(full) == set(fast)
    for name in full:
        assert sorted(map(tuple, full[name].collect()), key=repr) == sorted(map(tuple, fast[name].select(full[name].columns).collect()), key=repr)
