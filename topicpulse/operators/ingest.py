"""Ingest transformations (B1-B9) as jobs over raw post and comment tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import wordlists as W
from ..functions.text import normalise_text

POST_COLS = ["post_id", "topic", "subreddit", "title", "content", "author", "score", "num_comments",
             "url", "created_utc", "is_comment", "parent_id"]
_TYPES = {"score": "int", "num_comments": "int", "created_utc": "double", "is_comment": "boolean"}


def _col(df: DataFrame, name: str, default=None) -> Column:
    if name in df.columns:
        return F.col(name)
    return F.lit(default).cast(_TYPES.get(name, "string")).alias(name)


def unify(posts: DataFrame, comments: DataFrame, clean: bool = False) -> DataFrame:
    """B2+B3: one table of posts and comments. A comment's id becomes ``post_id``, its
    post's id ``parent_id``; title '', num_comments 0, url '', is_comment true; a missing
    author becomes '[deleted]'. ``clean`` applies B1 to title and content."""
    def txt(df, c):
        x = _col(df, c)
        return normalise_text(x) if clean else x

    p = posts.select(
        F.col("post_id"), _col(posts, "topic"), _col(posts, "subreddit"), txt(posts, "title").alias("title"),
        txt(posts, "content").alias("content"),
        F.coalesce(_col(posts, "author"), F.lit(W.DEFAULT_AUTHOR)).alias("author"),
        _col(posts, "score").cast("int").alias("score"), _col(posts, "num_comments").cast("int").alias("num_comments"),
        _col(posts, "url"), _col(posts, "created_utc").cast("double").alias("created_utc"),
        F.lit(False).alias("is_comment"), F.lit(None).cast("string").alias("parent_id"))
    c = comments.select(
        F.col("comment_id").alias("post_id"), _col(comments, "topic"), _col(comments, "subreddit"),
        F.lit("").alias("title"), txt(comments, "content").alias("content"),
        F.coalesce(_col(comments, "author"), F.lit(W.DEFAULT_AUTHOR)).alias("author"),
        _col(comments, "score").cast("int").alias("score"), F.lit(0).alias("num_comments"), F.lit("").alias("url"),
        _col(comments, "created_utc").cast("double").alias("created_utc"),
        F.lit(True).alias("is_comment"), F.col("post_id").alias("parent_id"))
    return p.unionByName(c)


def cap_per_parent(comments: DataFrame, n: int = 10, parent: str = "post_id",
                   position: str = "position") -> DataFrame:
    """B4+B5: the first ``n`` comments of each post by position (the cap counts empty
    comments), then comments with null/empty bodies dropped. A post with millions of
    comments is cut to n rows per task by the WindowGroupLimit before its shuffle."""
    w = Window.partitionBy(parent).orderBy(position)
    capped = comments.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")
    return capped.where(F.length(F.coalesce(F.col("content"), F.lit(""))) > 0)


def dedupe(df: DataFrame, key: str = "post_id", order: list | None = None) -> DataFrame:
    """B6/A13 batch form: keep the first row per ``key`` by ``order`` (deterministic)."""
    order = list(order or []) + [F.col(key)]
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def dedupe_stream(stream_df: DataFrame, delay: str = "1 hour", key: str = "post_id",
                  ts_col: str = "processed_at") -> DataFrame:
    """B6 stream form: duplicates within the watermark delay are dropped; state is
    bounded by time. Later duplicates are caught by the result sink's anti join (A7)."""
    return stream_df.withWatermark(ts_col, delay).dropDuplicatesWithinWatermark([key])


def active_topics(registry: DataFrame, defaults: list | None = None) -> DataFrame:
    """Active topics of the registry; if none, the built-in default topics."""
    act = registry.where(F.col("active"))
    if not act.isEmpty():
        return act
    spark = registry.sparkSession
    rows = [(name, subs) for name, subs in (defaults or W.DEFAULT_TOPICS)]
    return spark.createDataFrame(rows, "name string, subreddits array<string>") \
        .select("name", "subreddits", F.array().cast("array<string>").alias("keywords"), F.lit(True).alias("active"),
                F.lit(None).cast("timestamp").alias("created_at"), F.lit(None).cast("timestamp").alias("updated_at"))


def source_topics(registry: DataFrame) -> DataFrame:
    """(subreddit, topic): each source under the first active topic that lists it, topics
    taken in registry order (created_at, name), as the crawl loop would meet them."""
    act = registry.where(F.col("active"))
    ex = act.select("name", "created_at", F.posexplode("subreddits").alias("pos", "subreddit"))
    w = Window.partitionBy("subreddit").orderBy(F.col("created_at").asc_nulls_last(), "name", "pos")
    return ex.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1) \
        .select("subreddit", F.col("name").alias("topic"))


def assign_topics(posts: DataFrame, registry: DataFrame) -> DataFrame:
    """Topic of each post from its source; posts of unlisted sources are dropped.
    """
    m = source_topics(registry)
    base = posts.drop("topic") if "topic" in posts.columns else posts
    return base.join(m, "subreddit", "inner")


def cap_per_source(posts: DataFrame, n: int = 25, order: list | None = None) -> DataFrame:
    """Top ``n`` posts per source in ranking order (default: score desc, post_id)."""
    order = order or [F.desc("score"), F.col("post_id")]
    w = Window.partitionBy("subreddit").orderBy(*order)
    return posts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
