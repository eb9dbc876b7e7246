"""State carried between batches, late rows, counts in passing, lemmas and ties."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from topicpulse.operators import aggregates as A
from topicpulse.operators import partials as P
from topicpulse.operators import validate as V
from topicpulse.operators import views as G
from topicpulse.operators.anomaly import carry_zscores, rolling_zscore
from topicpulse.operators.keywords import derive_lemmas, irregular_nouns
from topicpulse.sources.testdata import scored_from_events
from topicpulse.streaming.stream import anomaly_step, split_late

from conftest import SF_SMALL

T0 = dt.datetime(2024, 1, 1)


def rows(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=repr)


def test_zscores_hour_by_hour_equal_the_batch_table(spark, tmpdir_path):
    hours = A.hourly_trends(scored_from_events(spark, SF_SMALL)).cache()
    names = sorted(r[0] for r in hours.select("hour").distinct().collect())
    step = -(-len(names) // 6)
    got = []
    for n in range(6):
        part = hours.where(F.col("hour").isin(names[n * step:(n + 1) * step]))
        first = rows(anomaly_step(part, n, tmpdir_path))
        assert rows(anomaly_step(part, n, tmpdir_path)) == first         # a replay gives the same rows
        got += first
    assert sorted(got, key=repr) == rows(rolling_zscore(hours))
    from topicpulse.streaming.store import ViewStore
    store = ViewStore(spark, f"{tmpdir_path}/anomalies")
    assert len(store.keys("carried")) <= 2
    assert store.read("carried", store.keys("carried")[-1]).groupBy("topic").count().agg(F.max("count")).first()[0] == 6
    assert rows(store.read("zscores")) == rows(rolling_zscore(hours))
    with pytest.raises(ValueError):
        carry_zscores(hours, hours)


def test_late_rows_touch_only_their_hours(spark):
    s = scored_from_events(spark, SF_SMALL)
    on_time, late = split_late(s, T0 + dt.timedelta(days=3))
    assert on_time.count() + late.count() == s.count() and late.count() > 10
    before = A.hourly_trends(on_time).withColumn("post_count", F.col("post_count") + 0)
    states = P.partial_states(on_time).unionByName(P.partial_states(late))
    assert rows(P.corrected_trends(before, states, late)) == rows(A.hourly_trends(s))
    # an hour that nothing late touches is taken over, even if its states say otherwise
    marked = before.withColumn("post_count", F.lit(-1).cast("bigint"))
    got = P.corrected_trends(marked, states, late)
    hours = {(r.topic, r.hour) for r in A.hourly_trends(late).collect()}
    assert all((r.post_count == -1) == ((r.topic, r.hour) not in hours) for r in got.collect())
    assert rows(P.corrected_trends(before, states, late.limit(0))) == rows(before)


def test_counts_in_passing_equal_a_separate_aggregate(spark, tmpdir_path):
    df = spark.createDataFrame([("1", 5), ("2", None), (None, 70), ("4", 70), (None, None)], "post_id string, score int")
    rules = [("id", F.col("post_id").isNotNull()), ("score", F.col("score") < 50)]
    got = V.write_validated(df, rules, f"{tmpdir_path}/v")
    assert got == {"rows": 5, "valid": 1, "id": 2, "score": 4}
    back = spark.read.parquet(f"{tmpdir_path}/v")
    assert back.where("valid = 'true'").count() == 1 and back.where("valid = 'false'").count() == 4
    assert sorted(tuple(r.reasons) for r in back.where("valid = 'false'").collect()) == [("id", "score"), ("id", "score"), ("score",), ("score",)]
    checked, seen = V.observed(scored_from_events(spark, SF_SMALL), [("low", F.col("sentiment_e4") < 0)])
    assert checked._jdf.queryExecution().executedPlan().toString().count("Scan parquet") == 1
    checked.write.format("noop").mode("overwrite").save()
    assert seen.get["low"] == scored_from_events(spark, SF_SMALL).where("sentiment_e4 >= 0").count()


def test_irregular_lemmas_come_before_the_rules(spark):
    words = "children mice feet knives lives analyses bases cats women men boxes news data child base".split()
    vocab = spark.createDataFrame([(w,) for w in words + ["cat", "woman", "man", "box", "new", "lif", "basis"]], "word string")
    got = {r.word: r.base for r in derive_lemmas(vocab, irregular_nouns(spark)).collect()}
    assert got == {"children": "child", "mice": "mouse", "feet": "foot", "knives": "knife", "lives": "life",
                   "analyses": "analysis", "bases": "basis", "cats": "cat", "women": "woman", "men": "man", "boxes": "box",
                   "news": "new", "data": "datum"}
    without = {r.word: r.base for r in derive_lemmas(vocab).collect()}
    assert without["lives"] == "lif" and without["bases"] == "base" and "mice" not in without


def test_nested_sources_are_bounded_and_ties_ordered(spark):
    posts = spark.createDataFrame([("t", f"s{i % 7}", "positive", 100 * (i % 7), ["k"]) for i in range(30)],
                                  "topic string, subreddit string, sentiment_label string, sentiment_e4 bigint, keywords array<string>")
    from topicpulse.operators.keywords import top_keywords
    r = A.nested_aggregates(posts, top_keywords(posts), max_sources=3).first()
    assert {k: v.post_count for k, v in r.subreddit_breakdown.items()} == {"s0": 5, "s1": 5, "s2": 4}
    assert r.total_posts == 30
    ties = [("t", T0, T0, float(x)) for x in (3, 1, 2)]
    for order in (ties, ties[::-1]):
        df = spark.createDataFrame(order, "topic string, period_start timestamp, period_end timestamp, avg_sentiment double").repartition(3)
        assert G.latest_batch_view(df, T0).first().avg_sentiment == 3.0
    trends = spark.createDataFrame([("a", "2024-01-01 10:00:00", 0.5), ("new", "2024-01-01 10:00:00", 0.1)], "topic string, hour string, avg_sentiment double")
    names = spark.createDataFrame([("new",), ("a",)], "name string")
    assert [tuple(x) for x in G.trend_pivot(trends, names).collect()] == [("10:00", 0.5, 0.1)]
