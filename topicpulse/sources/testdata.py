"""Adapters that present the generated test tables in this library's shapes.

* events        -> scored posts (topic = event_type, score in 1/10000 from ``value``)
* documents     -> raw posts (topic = lang, subreddit = source)
* conversations -> raw comments (parent = conv_id, position = turn)
* embeddings    -> 5 class logits (sums of every fifth value, so the whole vector counts)
* pages         -> html texts
* documents     -> topic registry (each language a topic, its sources as subreddits)

Every adapter is a projection or an aggregate of the table, so its work grows
with the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.labels import from_e4, label3
from .tables import AS_OF, read_table


def scored_from_events(spark: SparkSession, base: str) -> DataFrame:
    ev = read_table(spark, base, "events")
    e4 = F.round(F.lit(20000) * F.col("value") / (F.col("value") + 50) - 10000).cast("bigint")
    return (ev.select(
        F.col("event_id").cast("string").alias("post_id"),
        F.col("event_type").alias("topic"),
        F.concat(F.lit("s"), (F.col("user_id") % 20).cast("string")).alias("subreddit"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("author"),
        F.get_json_object("props", "$.k").cast("int").alias("score"),
        e4.alias("sentiment_e4"),
        F.col("ts").cast("timestamp").alias("processed_at"))
        .withColumn("sentiment_score", from_e4("sentiment_e4"))
        .withColumn("sentiment_label", label3("sentiment_score")))


def posts_from_documents(spark: SparkSession, base: str) -> DataFrame:
    d = read_table(spark, base, "documents")
    return d.select(
        F.col("doc_id").cast("string").alias("post_id"),
        F.col("lang").alias("topic"),
        F.col("source").alias("subreddit"),
        F.lit("").alias("title"),
        F.col("text").alias("content"),
        F.lit(None).cast("string").alias("author"),
        F.lit(None).cast("int").alias("score"),
        F.lit(0).alias("num_comments"),
        F.lit(False).alias("is_comment"))


def comments_from_conversations(spark: SparkSession, base: str) -> DataFrame:
    c = read_table(spark, base, "conversations")
    return c.select(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("comment_id"),
        F.col("conv_id").cast("string").alias("post_id"),
        F.col("turn").cast("int").alias("position"),
        F.col("role").alias("author"),
        F.col("text").alias("content"))


def logits_from_embeddings(spark: SparkSession, base: str) -> DataFrame:
    e = read_table(spark, base, "embeddings")
    x = F.col("embedding")
    # every value is touched once: class c sums the places c, c + 5, c + 10, ...
    sums = [F.aggregate(F.when(F.size(x) > c, F.sequence(F.lit(c), F.size(x) - 1, F.lit(5))).otherwise(F.array().cast("array<int>")),
                        F.lit(0.0), lambda a, i: a + F.get(x, i).cast("double")) for c in range(5)]
    return e.select("vec_id", F.array(*sums).alias("logits"))


def html_texts(spark: SparkSession, base: str) -> DataFrame:
    return read_table(spark, base, "pages").select("page_id", F.col("html").alias("text"))


def registry_from(df: DataFrame, topic_col: str, source_col: str) -> DataFrame:
    """Registry rule: one topic per distinct ``topic_col``; its subreddits are its
    sources, largest first (ties by name), so sources are shared between topics; the smallest topic is inactive; topics are created largest first."""
    counts = df.groupBy(F.col(topic_col).alias("name"), F.col(source_col).alias("source")) \
        .agg(F.count(F.lit(1)).alias("n"))
    rn = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("n"), "source"))
    reg = counts.withColumn("rn", rn).groupBy("name").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rn", "source"))), lambda s: s["source"]).alias("subreddits"),
        F.sum("n").alias("docs"))
    # the registry has one row per topic: a global window over it is registry-sized
    order = Window.orderBy(F.desc("docs"), "name")
    last = Window.orderBy("docs", F.desc("name"))
    return reg.select(
        "name", "subreddits",
        F.array().cast("array<string>").alias("keywords"),
        (F.row_number().over(last) > 1).alias("active"),
        (F.lit(AS_OF).cast("timestamp") - F.make_interval(days=F.row_number().over(order).cast("int") + 30))
        .alias("created_at"),
        F.lit(AS_OF).cast("timestamp").alias("updated_at"))


def topics_from_documents(spark: SparkSession, base: str) -> DataFrame:
    """Registry over documents: one topic per language, sources = document sources."""
    return registry_from(read_table(spark, base, "documents"), "lang", "source")


def topics_from_events(spark: SparkSession, base: str) -> DataFrame:
    """Registry over the event posts: one topic per event type, sources = 's' + user_id % 20."""
    return registry_from(scored_from_events(spark, base), "topic", "subreddit")
