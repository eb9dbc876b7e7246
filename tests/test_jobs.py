"""The streaming job and the hourly batch job, end to end on file sources."""

import datetime as dt
import os

from pyspark.sql import functions as F

from conftest import SF_SMALL
from topicpulse.sources.tables import AS_OF, keyword_stopwords, seed_lexicon
from topicpulse.sources.testdata import posts_from_documents, scored_from_events


def bus_files(spark, path):
    """Bus-shaped parquet files built from the documents, in three files."""
    from topicpulse.sources.bus import encode_posts
    posts = posts_from_documents(spark, SF_SMALL).withColumn("created_utc", F.lit(1.7e9))
    enc = encode_posts(posts).withColumn("timestamp", F.lit(AS_OF).cast("timestamp"))
    enc.repartition(3).write.parquet(path)
    return posts


def test_stream_equals_batch_and_replay(spark, tmpdir_path):
    from topicpulse.plans.scoring import score_posts
    from topicpulse.sources.bus import read_bus
    from topicpulse.streaming.stream import process_batch, run_stream
    src, out = f"{tmpdir_path}/bus", f"{tmpdir_path}/out"
    posts = bus_files(spark, src)
    lex, stop = seed_lexicon(spark), keyword_stopwords(spark)
    q = run_stream(spark, read_bus(spark, path=src, max_files_per_trigger=1), out, lex, stop, checkpoint=f"{tmpdir_path}/ckpt",
                   available_now=True)
    q.awaitTermination(300)
    assert q.exception() is None
    res = spark.read.parquet(f"{out}/results")
    assert res.count() == posts.count()
    assert res.select("post_id").distinct().count() == posts.count()
    batch = score_posts(posts, lex, stop, [], processed_at=AS_OF).select("post_id", "sentiment_e4", "keywords")
    diff = res.select("post_id", "sentiment_e4", "keywords").exceptAll(batch)
    assert diff.count() == 0
    hist = spark.read.parquet(f"{out}/history")
    assert hist.groupBy().sum("count").first()[0] == posts.count()
    from topicpulse.streaming.sinks import id_store
    ids = id_store(spark, out).read()
    assert ids.count() == posts.count() and ids.select("post_id").distinct().count() == posts.count()
    # the hourly job reads the results store through a day-partition filter
    from topicpulse.sources.tables import scan_lookback
    lb = scan_lookback(f"{out}/results", spark, as_of=AS_OF, hours=24)
    assert "PartitionFilters: [isnotnull(dt#" in lb._jdf.queryExecution().executedPlan().toString()
    # replay of batch 0: the same rows are rewritten, nothing is duplicated
    from topicpulse.sources.bus import decode_posts
    first_file = sorted(p for p in os.listdir(src) if p.endswith(".parquet"))[0]
    replay = decode_posts(spark.read.parquet(f"{src}/{first_file}")).withColumn("processed_at", F.current_timestamp())
    before = res.count()
    process_batch(replay, 0, out, lex, stop)
    after = spark.read.parquet(f"{out}/results")
    assert after.count() == before and after.select("post_id").distinct().count() == before


def test_a_post_that_comes_again_alerts_once(spark, tmpdir_path):
    from topicpulse.sources.bus import decode_posts, encode_posts
    from topicpulse.streaming.stream import process_batch
    posts = spark.createDataFrame([("1", "t", "bad bad bad", "awful"), ("2", "t", "fine", "words")],
                                  "post_id string, topic string, title string, content string")
    bus = encode_posts(posts).withColumn("timestamp", F.lit(AS_OF).cast("timestamp"))
    batch = decode_posts(bus).withColumn("processed_at", F.current_timestamp())
    lex = spark.createDataFrame([("bad", -2.5), ("awful", -2.0)], "word string, valence double")
    for batch_id in (0, 1):
        process_batch(batch, batch_id, tmpdir_path, lex, keyword_stopwords(spark))
    assert [r.post_id for r in spark.read.parquet(f"{tmpdir_path}/alerts").collect()] == ["1"]
    assert spark.read.parquet(f"{tmpdir_path}/results").count() == 2


def test_windowed_trends_equal_batch(spark, tmpdir_path):
    from topicpulse.operators.aggregates import hourly_trends
    from topicpulse.streaming.stream import windowed_trends
    path = f"{tmpdir_path}/scored"
    s = scored_from_events(spark, SF_SMALL)
    s.repartition(4).write.parquet(path)
    stream = spark.readStream.schema(s.schema).option("maxFilesPerTrigger", 1).parquet(path)
    q = windowed_trends(stream).writeStream.outputMode("complete").format("memory").queryName("wt_test").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("wt_test")
    exp = hourly_trends(s)
    assert got.count() == exp.count()
    assert got.exceptAll(exp.select(*got.columns)).count() == 0


def test_watermark_drops_late_rows(spark, tmpdir_path):
    from topicpulse.streaming.stream import windowed_trends
    schema = "post_id string, topic string, sentiment_e4 bigint, score int, processed_at timestamp"
    t = dt.datetime(2024, 1, 1, 10)
    batches = [[("1", "a", 100, 1, t)],
               [("2", "a", 100, 1, t + dt.timedelta(hours=5))],                      # moves the watermark
               [("3", "a", 100, 1, t + dt.timedelta(hours=4, minutes=30)),           # within the 1 h delay
                ("4", "a", 100, 1, t - dt.timedelta(hours=3))]]                      # beyond it: dropped
    src = f"{tmpdir_path}/late"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{src}/b{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true") \
        .parquet(src)
    q = windowed_trends(stream).writeStream.outputMode("append").format("memory").queryName("late_test").start()
    q.processAllAvailable()
    q.stop()
    hours = {r.hour: r.post_count for r in spark.table("late_test").collect()}
    # late rows are filtered against the watermark of the previous micro-batch (09:00 here)
    assert "2024-01-01 07:00:00" not in hours   # the late row's window never appears
    assert hours.get("2024-01-01 10:00:00") == 1


def test_run_batch_end_to_end(spark, tmpdir_path):
    from topicpulse.plans.batch import run_batch
    from topicpulse.plans.q_batch import q_topic_aggregates  # noqa: F401
    src = f"{tmpdir_path}/scored"
    s = scored_from_events(spark, SF_SMALL)
    s.write.parquet(src)
    missing = f"{tmpdir_path}/nothing-here"
    views = run_batch(spark, [missing, src], f"{tmpdir_path}/views", AS_OF, lookback_hours=72)
    assert views is not None
    assert set(views) >= {"topic_aggregates", "hourly_trends", "source_stats", "alerts"}
    agg = views["topic_aggregates"]
    n = s.where(F.col("processed_at") >= F.lit(AS_OF - dt.timedelta(hours=72))).count()
    assert agg.groupBy().sum("total_posts").first()[0] == n
    # a re-run of the same hour rewrites its own partitions
    run_batch(spark, [src], f"{tmpdir_path}/views", AS_OF, lookback_hours=72)
    from topicpulse.streaming.sinks import publish_views, read_view
    assert read_view(spark, f"{tmpdir_path}/views", "topic_aggregates").groupBy().sum("total_posts").first()[0] == n
    assert run_batch(spark, [missing], f"{tmpdir_path}/v2", AS_OF) is None
    # a re-run whose view is empty leaves no rows of the earlier run
    publish_views({"alerts": views["alerts"].drop("batch_time").limit(0)}, f"{tmpdir_path}/views", AS_OF)
    assert read_view(spark, f"{tmpdir_path}/views", "alerts", AS_OF).count() == 0


def test_parquet_and_console_sinks(spark, tmpdir_path):
    from topicpulse.streaming.sinks import sink_console, sink_parquet
    src = f"{tmpdir_path}/scored"
    s = scored_from_events(spark, SF_SMALL).select("post_id", "topic", "sentiment_e4", "processed_at")
    s.repartition(2).write.parquet(src)
    stream = spark.readStream.schema(s.schema).parquet(src)
    q = sink_parquet(stream, f"{tmpdir_path}/sink", f"{tmpdir_path}/sink-ckpt", available_now=True)
    q.awaitTermination(300)
    back = spark.read.parquet(f"{tmpdir_path}/sink")
    assert back.count() == s.count()
    assert back.select(*s.columns).exceptAll(s).count() == 0
    assert sorted(os.listdir(f"{tmpdir_path}/sink"))[0].startswith("_spark_metadata") or \
        any(d.startswith("topic=") for d in os.listdir(f"{tmpdir_path}/sink"))
    c = sink_console(spark.readStream.schema(s.schema).parquet(src), rows=5,
                     checkpoint=f"{tmpdir_path}/console-ckpt")
    c.processAllAvailable()
    c.stop()


def test_dedupe_stream_within_watermark(spark, tmpdir_path):
    from topicpulse.operators.ingest import dedupe_stream
    schema = "post_id string, processed_at timestamp"
    t = dt.datetime(2024, 1, 1, 10)
    for i, rows in enumerate([[("a", t), ("a", t)], [("a", t + dt.timedelta(minutes=10)), ("b", t)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmpdir_path}/d/b{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1) \
        .option("recursiveFileLookup", "true").parquet(f"{tmpdir_path}/d")
    q = dedupe_stream(stream, "1 hour").writeStream.format("memory").queryName("dd_test").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.post_id for r in spark.table("dd_test").collect()) == ["a", "b"]


def test_encode_alerts_round_trip(spark):
    from topicpulse.operators.alerts import post_alerts
    from topicpulse.sources.bus import encode_alerts
    a = post_alerts(scored_from_events(spark, SF_SMALL))
    e = encode_alerts(a)
    assert e.count() == a.count()
    r = e.select(F.col("key").cast("string").alias("k"),
                 F.get_json_object(F.col("value").cast("string"), "$.alert_type").alias("t")).first()
    assert r.t == "low_sentiment" and ":" not in r.k
