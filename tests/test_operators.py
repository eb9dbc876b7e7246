"""Edge cases of the relational operators (FIXTURES.md section 3)."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from topicpulse.functions.labels import label3
from topicpulse.operators import aggregates as A
from topicpulse.operators import alerts as AL
from topicpulse.operators import ingest as I
from topicpulse.operators import views as G
from topicpulse.operators.anomaly import rolling_zscore

T0 = dt.datetime(2024, 1, 1)


def scored(spark, rows):
    """rows: (post_id, topic, e4 or None, label, hours after T0)."""
    data = [(p, t, e, lab, T0 + dt.timedelta(hours=h), 1) for p, t, e, lab, h in rows]
    df = spark.createDataFrame(data, "post_id string, topic string, sentiment_e4 bigint, sentiment_label string, "
                                     "processed_at timestamp, score int")
    return df.withColumn("sentiment_score", F.col("sentiment_e4") / 10000.0)


def test_topic_aggregates_nulls_and_single_row(spark):
    df = scored(spark, [("1", "a", 5000, "positive", 0), ("2", "b", None, None, 0), ("3", "b", 1000, "weird", 0)])
    out = {r.topic: r for r in A.topic_aggregates(df).collect()}
    assert out["a"].std_sentiment is None and out["a"].total_posts == 1 and out["a"].positive_pct == 100.0
    b = out["b"]
    assert b.total_posts == 2 and b.avg_sentiment == pytest.approx(0.1)  # avg skips null, count(*) does not
    assert b.positive_count + b.negative_count + b.neutral_count == 0  # unknown label: in no bucket


def _series(spark, values):
    rows = [("t", f"2024-01-01 {h:02d}:00:00", float(v)) for h, v in enumerate(values)]
    return spark.createDataFrame(rows, "topic string, hour string, avg_sentiment double")


@pytest.mark.parametrize("values,last_z,flag", [
    ([0, 0, 0, 0, 1], 1.788854, False),      # n = 5: never flagged
    ([0, 0, 0, 0, 0, 1], 2.041241, True),    # n = 6
    ([0, 0, 0, 0, 0, 0, 1], 2.267787, True),  # full frame, n = 7
    ([0, 0, 0, 0, 0, 0, 0, 0, 1], 2.267787, True),
    ([0.3] * 8, 0.0, False),                 # flat: std 0 -> divide by 1
])
def test_rolling_zscore_edges(spark, values, last_z, flag):
    rows = rolling_zscore(_series(spark, values)).orderBy("hour").collect()
    assert rows[-1].z_score == pytest.approx(last_z, abs=1e-6)
    assert rows[-1].is_anomaly is flag


def test_exclude_current_makes_critical_reachable(spark):
    rows = rolling_zscore(_series(spark, [0, 0.01, 0, 0.01, 0, 0.01, 1]), exclude_current=True).orderBy("hour").collect()
    assert abs(rows[-1].z_score) >= 3


def test_post_alert_threshold_is_strict(spark):
    df = scored(spark, [("1", "a", -5000, "negative", 0), ("2", "a", -5001, "negative", 0), ("3", "a", None, None, 0)])
    ids = [r.post_id for r in AL.post_alerts(df).collect()]
    assert ids == ["2"]


def test_apply_acks_earliest_and_unknown(spark):
    df = scored(spark, [("1", "a", -9000, "negative", 0), ("2", "a", -9000, "negative", 0)])
    alerts = AL.post_alerts(df)
    a1 = alerts.where("post_id = '1'").first().alert_id
    acks = spark.createDataFrame([(a1, T0 + dt.timedelta(hours=3)), (a1, T0 + dt.timedelta(hours=2)),
                                  ("nope", T0)], "alert_id string, acknowledged_at timestamp")
    out = {r.post_id: r for r in AL.apply_acks(alerts, acks).collect()}
    assert out["1"].acknowledged and out["1"].acknowledged_at == T0 + dt.timedelta(hours=2)
    assert not out["2"].acknowledged and out["2"].acknowledged_at is None
    assert AL.apply_acks(alerts, acks).count() == 2
    assert AL.list_alerts(AL.apply_acks(alerts, acks)).count() == 1


def test_decode_posts_permissive(spark):
    from topicpulse.sources.bus import decode_posts
    good = json.dumps({"post_id": "1", "topic": "t", "score": 3})
    rows = [("t:1", good), ("x", "not json"), ("t:2", json.dumps({"post_id": "2", "topic": "t", "score": "high"})),
            ("t:3", json.dumps({"topic": "t"})), ("t:4", None)]
    bus = spark.createDataFrame([(k.encode(), v.encode() if v else None, T0) for k, v in rows],
                                "key binary, value binary, timestamp timestamp")
    out = {r.kafka_key: r for r in decode_posts(bus).collect()}
    assert out["t:1"].valid and out["t:1"].score == 3
    assert not out["x"].valid and not out["t:3"].valid and not out["t:4"].valid
    assert out["t:2"].post_id == "2" and out["t:2"].score is None  # only the bad field is null


def test_insert_new_only_replay_is_idempotent(spark):
    from topicpulse.streaming.sinks import insert_new_only
    b0 = scored(spark, [("1", "a", 1, "neutral", 0), ("2", "a", 1, "neutral", 0)])
    b1 = scored(spark, [("2", "a", 1, "neutral", 1), ("3", "a", 1, "neutral", 1), ("3", "a", 1, "neutral", 2)])
    stored0 = b0.select("post_id", F.lit(0).cast("bigint").alias("batch_id"))
    first = insert_new_only(stored0, b1, 1)
    assert sorted(r.post_id for r in first.collect()) == ["3"]
    # replay of batch 1 after its rows were stored: same rows again, nothing lost
    stored1 = stored0.unionByName(first.select("post_id", "batch_id"))
    again = insert_new_only(stored1, b1, 1)
    assert sorted(r.post_id for r in again.collect()) == ["3"]


def test_cap_comments_counts_empty(spark):
    rows = [("p", f"c{i}", i, "" if i == 1 else f"text {i}") for i in range(11)]
    df = spark.createDataFrame(rows, "post_id string, comment_id string, position int, content string")
    out = I.cap_per_parent(df, 10).collect()
    assert len(out) == 9 and max(r.position for r in out) == 9


def test_assign_topics_first_topic_and_defaults(spark):
    reg = spark.createDataFrame([
        ("tech", ["s1", "s2"], True, T0), ("money", ["s2", "s3"], True, T0 + dt.timedelta(days=1)),
        ("off", ["s3"], False, T0 - dt.timedelta(days=1))],
        "name string, subreddits array<string>, active boolean, created_at timestamp")
    posts = spark.createDataFrame([("1", "s1"), ("2", "s2"), ("3", "s3"), ("4", "s9")], "post_id string, subreddit string")
    out = {r.post_id: r.topic for r in I.assign_topics(posts, reg).collect()}
    assert out == {"1": "tech", "2": "tech", "3": "money"}
    empty = reg.where("false")
    assert sorted(r.name for r in I.active_topics(empty).collect()) == ["finance", "technology"]


def test_latest_batch_view_period_edge(spark):
    as_of = dt.datetime(2024, 1, 31)
    rows = [("a", as_of - dt.timedelta(hours=48), as_of - dt.timedelta(hours=24), 0.1, 5),
            ("a", as_of - dt.timedelta(hours=72), as_of - dt.timedelta(hours=48), 0.2, 5),
            ("b", as_of - dt.timedelta(hours=72), as_of - dt.timedelta(hours=48), 0.3, 5)]
    v = spark.createDataFrame(rows, "topic string, period_start timestamp, period_end timestamp, "
                                    "avg_sentiment double, total_posts bigint")
    out = {r.topic: r for r in G.latest_batch_view(v, as_of, 24).collect()}
    assert set(out) == {"a"} and out["a"].avg_sentiment == 0.1  # period_end exactly at the cutoff counts
    with pytest.raises(ValueError):
        G.latest_batch_view(v, as_of, 0)


def test_label3_null(spark):
    df = spark.createDataFrame([(None,)], "s double")
    assert df.select(label3("s")).first()[0] is None


def test_load_lexicon_file(spark, tmpdir_path):
    from topicpulse.sources.tables import load_lexicon
    path = f"{tmpdir_path}/lexicon.txt"
    with open(path, "w") as f:
        f.write("good\t1.9\t0.9434\t[2, 1, 2]\n:)\t2.0\t1.1\t[2, 2]\n\"quoted\"\t-0.5\t0.5\t[0]\nbroken line\n")
    lex = {r.word: r.valence for r in load_lexicon(spark, path).collect()}
    assert lex == {"good": 1.9, ":)": 2.0, '"quoted"': -0.5}


def test_topic_changes_are_cumulative(spark):
    old = spark.createDataFrame([("a", ["s"], ["k0"], True, T0, T0), ("b", ["s"], ["k0"], True, T0, T0)],
                                "name string, subreddits array<string>, keywords array<string>, active boolean, "
                                "created_at timestamp, updated_at timestamp")
    t = [T0 + dt.timedelta(hours=h) for h in range(5)]
    ch = spark.createDataFrame([(" A ", None, ["k1"], None, False, t[1]), ("a", None, None, False, None, t[2]),
                                ("b", None, None, None, True, t[1]), ("B", ["n"], None, None, False, t[2]),
                                ("c", ["x"], None, None, False, t[3]), ("c", None, None, None, True, t[3])],
                               "name string, subreddits array<string>, keywords array<string>, active boolean, "
                               "deleted boolean, changed_at timestamp")
    got = {r.name: r for r in G.apply_topic_changes(old, ch).collect()}
    assert set(got) == {"a", "b"}
    assert (got["a"].subreddits, got["a"].keywords, got["a"].active) == (["s"], ["k1"], False)
    assert (got["a"].created_at, got["a"].updated_at) == (T0, t[2])
    assert (got["b"].subreddits, got["b"].keywords, got["b"].active, got["b"].created_at) == (["n"], [], True, t[2])


def test_limits_beyond_the_most_are_errors(spark):
    from topicpulse.streaming.sinks import history
    df = scored(spark, [("1", "a", -9000, "negative", 0)])
    with pytest.raises(ValueError):
        G.recent(df, 201)
    with pytest.raises(ValueError):
        AL.list_alerts(AL.post_alerts(df), limit=501)
    with pytest.raises(ValueError):
        history(df, limit=1001)


def test_upsert_of_equal_versions_takes_the_incoming(spark):
    from topicpulse.streaming.sinks import upsert_latest
    old = spark.createDataFrame([("a", 1, T0), ("b", 1, T0)], "k string, v int, created_at timestamp")
    new = spark.createDataFrame([("a", 2, T0), ("b", 0, T0 - dt.timedelta(hours=1))], "k string, v int, created_at timestamp")
    assert sorted(tuple(r) for r in upsert_latest(old, new, ["k"]).select("k", "v").collect()) == [("a", 2), ("b", 1)]


def test_a_damaged_store_is_an_error(spark, tmpdir_path):
    import os
    from topicpulse.sources.tables import read_if_there
    assert read_if_there(spark, f"{tmpdir_path}/none") is None
    os.makedirs(f"{tmpdir_path}/bad")
    with open(f"{tmpdir_path}/bad/part-0.parquet", "wb") as f:
        f.write(b"no parquet file at all")
    with pytest.raises(Exception):
        read_if_there(spark, f"{tmpdir_path}/bad").count()


def test_rules_of_the_stored_tables(spark):
    from topicpulse.operators import validate as V
    df = spark.createDataFrame([("1", "t", T0, 5), (None, "t", None, 5), ("3", None, T0, None)],
                               "post_id string, topic string, timestamp timestamp, title int")
    got = [r.reasons for r in V.validate(df, V.table_rules(df, "posts")).collect()]
    assert got == [["title_type"], ["post_id_required", "timestamp_required", "title_type"], ["topic_required"]]
    r = spark.createDataFrame([("1", "t")], "post_id string, topic string")
    assert V.validate(r, V.table_rules(r, "results")).first().reasons == ["sentiment_score_required", "timestamp_required"]


def test_nested_aggregates_of_null_sources(spark):
    from topicpulse.operators.keywords import top_keywords
    df = scored(spark, [("1", "a", 100, "neutral", 0), ("2", "a", 300, "neutral", 0)]) \
        .withColumn("subreddit", F.when(F.col("post_id") == "1", "s")).withColumn("keywords", F.array(F.lit("k")))
    r = A.nested_aggregates(df, top_keywords(df)).first()
    assert set(r.subreddit_breakdown) == {"s", "unknown"} and r.total_posts == 2
