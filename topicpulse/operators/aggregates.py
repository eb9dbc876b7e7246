"""Aggregations.

Topic counts are small, so every aggregate here is a hash aggregate with a
map-side partial step: a hot topic holding a third of all rows is pre-reduced in
every task before the shuffle and never lands in one task as raw rows.
Averages of scores sum the exact integer form (``sentiment_e4``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import E4
from ..functions.wordlists import LABELS5
from .keywords import keyword_rows


def _score_e4(df: DataFrame) -> Column:
    if "sentiment_e4" in df.columns:
        return F.col("sentiment_e4")
    return F.round(F.col("sentiment_score") * E4).cast("bigint")


def avg_e4(e4: Column) -> Column:
    """Exact mean of a 1/10000 fixed-point column, as DOUBLE score units; null if no value."""
    return F.try_divide(F.sum(e4).cast("double"), F.count(e4).cast("double") * E4)


def std_e4(e4: Column, digits: int = 8) -> Column:
    """Sample standard deviation in score units (null for one row), rounded."""
    return F.round(F.stddev_samp(e4) / E4, digits)


def mean(c: Column) -> Column:
    return F.try_divide(F.sum(c).cast("double"), F.count(c).cast("double"))


def topic_aggregates(df: DataFrame, by: str | list[str] = "topic") -> DataFrame:
    """Per topic: avg, sample std, count(*), five label counts and three shares in %."""
    by = [by] if isinstance(by, str) else list(by)
    e4 = _score_e4(df)
    lab = F.col("sentiment_label")
    counts = [F.count_if(lab == name).alias(f"{name}_count") for name in LABELS5]
    agg = df.groupBy(*by).agg(avg_e4(e4).alias("avg_sentiment"), std_e4(e4).alias("std_sentiment"),
                              F.count(F.lit(1)).alias("total_posts"), *counts)
    total = F.col("total_posts").cast("double")
    return agg.select(
        *by, "avg_sentiment", "std_sentiment", "total_posts", *[f"{n}_count" for n in LABELS5],
        (F.try_divide((F.col("very_positive_count") + F.col("positive_count")).cast("double"), total) * 100)
        .alias("positive_pct"),
        (F.try_divide((F.col("very_negative_count") + F.col("negative_count")).cast("double"), total) * 100)
        .alias("negative_pct"),
        (F.try_divide(F.col("neutral_count").cast("double"), total) * 100).alias("neutral_pct"))


def hour_bucket(ts: Column) -> Column:
    """Hour as the string ``yyyy-MM-dd HH:00:00`` (session time zone, UTC)."""
    return F.date_format(ts, "yyyy-MM-dd HH:00:00")


def hourly_trends(df: DataFrame, ts_col: str = "processed_at") -> DataFrame:
    """Per topic and hour: exact avg score, count(*), avg engagement score."""
    e4 = _score_e4(df)
    return (df.groupBy("topic", hour_bucket(F.col(ts_col)).alias("hour"))
            .agg(avg_e4(e4).alias("avg_sentiment"), F.count(F.lit(1)).alias("post_count"),
                 mean(F.col("score")).alias("avg_reddit_score")))


def source_breakdown(df: DataFrame) -> DataFrame:
    """D3: per topic and source: avg score, count(*), avg engagement."""
    e4 = _score_e4(df)
    return (df.groupBy("topic", "subreddit")
            .agg(avg_e4(e4).alias("avg_sentiment"), F.count(F.lit(1)).alias("post_count"),
                 mean(F.col("score")).alias("avg_reddit_score")))


def microbatch_stats(batch_df: DataFrame, batch_time) -> DataFrame:
    """Per topic avg (null -> 0) and count of one micro-batch, stamped ``batch_time``."""
    e4 = _score_e4(batch_df)
    ts = batch_time if isinstance(batch_time, Column) else F.lit(batch_time).cast("timestamp")
    return (batch_df.groupBy("topic")
            .agg(F.coalesce(avg_e4(e4), F.lit(0.0)).alias("avg_sentiment"), F.count(F.lit(1)).alias("count"))
            .withColumn("updated_at", ts))


def microbatch_history(df: DataFrame, every: str = "1 hour", ts_col: str = "processed_at") -> DataFrame:
    """D5 applied to every time slice of a table, as the stream would have produced it:
    one snapshot per (topic, slice), stamped with the slice end."""
    e4 = _score_e4(df)
    return (df.groupBy("topic", F.window(F.col(ts_col), every).alias("w"))
            .agg(F.coalesce(avg_e4(e4), F.lit(0.0)).alias("avg_sentiment"), F.count(F.lit(1)).alias("count"))
            .select("topic", "avg_sentiment", "count", F.col("w.end").alias("updated_at")))


def serving_stats(df: DataFrame, as_of=None, hours: int | None = None, band: float = 0.2,
                  ts_col: str = "processed_at") -> DataFrame:
    """Per topic avg, count and counts/shares by 3-way polarity (+-band, closed middle).
    The time cutoff applies only when both ``as_of`` and ``hours`` are given."""
    if as_of is not None and hours is not None:
        df = df.where(F.col(ts_col) >= F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {int(hours)} HOURS"))
    e4 = _score_e4(df)
    b = int(round(band * E4))
    agg = df.groupBy("topic").agg(
        avg_e4(e4).alias("average_score"), F.count(F.lit(1)).alias("post_count"),
        F.count_if(e4 > b).alias("positive_count"), F.count_if(e4 < -b).alias("negative_count"),
        F.count_if((e4 >= -b) & (e4 <= b)).alias("neutral_count"))
    n = F.col("post_count").cast("double")
    return agg.select("*", *[F.try_divide(F.col(f"{k}_count").cast("double"), n).alias(f"{k}_share")
                             for k in ("positive", "negative", "neutral")])


def overview(registry: DataFrame, snapshot: DataFrame, batch_view: DataFrame) -> DataFrame:
    """Per active topic whether a realtime snapshot / batch view exists, with totals."""
    act = registry.where(F.col("active")).select(F.col("name").alias("topic"))
    rt = snapshot.select("topic").distinct().withColumn("realtime_available", F.lit(True))
    bv = batch_view.select("topic").distinct().withColumn("batch_available", F.lit(True))
    out = (act.join(rt, "topic", "left").join(bv, "topic", "left")
           .select("topic", F.coalesce("realtime_available", F.lit(False)).alias("realtime_available"),
                   F.coalesce("batch_available", F.lit(False)).alias("batch_available")))
    # one row per active topic: the window over the whole result is registry-sized
    return out.withColumn("total_topics", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))))


def dashboard_totals(stats: DataFrame, alerts: DataFrame) -> DataFrame:
    """Total posts over topics, number of topics, number of alerts (one row)."""
    a = stats.agg(F.sum("post_count").alias("total_posts"), F.count(F.lit(1)).alias("active_topics"))
    b = alerts.agg(F.count(F.lit(1)).alias("alert_count"))
    both = a.unionByName(b, allowMissingColumns=True)
    return both.agg(F.coalesce(F.max("total_posts"), F.lit(0)).cast("bigint").alias("total_posts"),
                    F.max("active_topics").alias("active_topics"), F.max("alert_count").alias("alert_count"))


def trend_summary(trends: DataFrame, epsilon: float = 0.05) -> DataFrame:
    """H1: per topic: points, first and current value, change in % and direction
    (up / down / stable within ``epsilon`` absolute change), and the series itself, in order of
    time (a point for each hour of the look-back)."""
    h = F.col("hour")
    s = trends.groupBy("topic").agg(
        F.count(F.lit(1)).alias("points"),
        F.min_by("avg_sentiment", h).alias("first_value"),
        F.max_by("avg_sentiment", h).alias("current_value"),
        F.max(h).alias("last_hour"),
        F.array_sort(F.collect_list(F.struct("hour", "avg_sentiment", "post_count"))).alias("time_series"))
    change = F.col("current_value") - F.col("first_value")
    return s.select(
        "topic", "points", "first_value", "current_value", "last_hour",
        F.round(F.try_divide(change, F.abs(F.col("first_value"))) * 100, 4).alias("change_pct"),
        F.when(change > epsilon, "up").when(change < -epsilon, "down").otherwise("stable").alias("direction"),
        "time_series")


def top_entities(scored: DataFrame, n: int = 10) -> DataFrame:
    """Per topic its ``n`` most frequent entities (ties by text and type), for H4's nested column."""
    e = scored.select("topic", F.explode("entities").alias("e")) \
        .groupBy("topic", F.col("e.entity_type").alias("entity_type"), F.col("e.text").alias("entity")) \
        .agg(F.count(F.lit(1)).alias("count"))
    w = Window.partitionBy("topic").orderBy(F.desc("count"), "entity", "entity_type")
    return e.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def chart_points(trends: DataFrame) -> DataFrame:
    """Points of a trend chart: time of day, score and number of posts (missing: 0)."""
    return trends.select("topic", "hour", F.date_format(F.to_timestamp("hour"), "HH:mm").alias("time"),
                         F.coalesce("avg_sentiment", F.lit(0.0)).alias("score"),
                         F.coalesce("post_count", F.lit(0)).cast("bigint").alias("count"))


def word_cloud(scored: DataFrame) -> DataFrame:
    """H2: per topic and keyword: uses and the exact mean score of the posts using it."""
    e4 = _score_e4(scored)
    k = keyword_rows(scored.select("topic", e4.alias("e4"), F.array_distinct("keywords").alias("words")), "words", "word")
    return k.groupBy("topic", "word").agg(F.count(F.lit(1)).alias("count"), avg_e4(F.col("e4")).alias("avg_sentiment"))


def nested_aggregates(scored: DataFrame, top_keywords: DataFrame, k: int = 10,
                      entities: DataFrame | None = None, max_sources: int = 100) -> DataFrame:
    """H4: D1 plus nested columns: top keywords (array of struct, rank order),
    sentiment distribution (map label -> share) and per-source stats (map source -> struct; a null
    source is "unknown") of the ``max_sources`` largest sources (ties by name; all of them, a row each: D3).

    One aggregate per (topic, source) feeds both the per-source map and, rolled up, the
    per-topic figures (exact: integer sums; the sample variance from sum(x) and sum(x^2)
    in DECIMAL), so the scored input is read once for them, plus once for keywords.
    With ``entities`` (``top_entities``) their first ``k`` are a column, too.
    Nested values are bounded: k keywords, five labels, ``max_sources`` sources."""
    e4 = _score_e4(scored)
    lab = F.col("sentiment_label")
    big = "decimal(38,0)"
    per_src = scored.withColumn("subreddit", F.coalesce("subreddit", F.lit("unknown"))) \
        .groupBy("topic", "subreddit").agg(
        F.sum(e4).alias("s1"), F.count(e4).alias("n1"), F.sum(e4.cast(big) * e4.cast(big)).alias("s2"),
        F.count(F.lit(1)).alias("post_count"),
        *[F.count_if(lab == name).alias(f"{name}_count") for name in LABELS5])
    t = per_src.groupBy("topic").agg(
        F.sum("s1").alias("s1"), F.sum("n1").alias("n1"), F.sum("s2").alias("s2"),
        F.sum("post_count").alias("total_posts"), *[F.sum(f"{n}_count").alias(f"{n}_count") for n in LABELS5])
    largest = Window.partitionBy("topic").orderBy(F.desc("post_count"), "subreddit")
    entry = F.struct("subreddit", F.struct(F.try_divide(F.col("s1").cast("double"), F.col("n1").cast("double") * E4)
                                           .alias("avg_sentiment"), "post_count"))
    sources = per_src.withColumn("_rank", F.row_number().over(largest)).where(F.col("_rank") <= max_sources) \
        .groupBy("topic").agg(F.map_from_entries(F.collect_list(entry)).alias("subreddit_breakdown"))
    n, s1, s2 = F.col("n1").cast(big), F.col("s1").cast(big), F.col("s2").cast(big)
    var = F.when(F.col("n1") > 1, ((n * s2 - s1 * s1).cast("double") / (n * (n - 1)).cast("double")))
    total = F.col("total_posts").cast("double")
    share = lambda c: F.try_divide(c.cast("double"), total)
    base = t.select(
        "topic", F.try_divide(F.col("s1").cast("double"), F.col("n1").cast("double") * E4).alias("avg_sentiment"),
        F.round(F.sqrt(var) / E4, 8).alias("std_sentiment"), "total_posts",
        *[f"{n}_count" for n in LABELS5],
        (share(F.col("very_positive_count") + F.col("positive_count")) * 100).alias("positive_pct"),
        (share(F.col("very_negative_count") + F.col("negative_count")) * 100).alias("negative_pct"),
        (share(F.col("neutral_count")) * 100).alias("neutral_pct"),
        F.create_map(*[x for nm in LABELS5 for x in (F.lit(nm), share(F.col(f"{nm}_count")))])
        .alias("sentiment_distribution")).join(sources, "topic", "left")
    kw = (top_keywords.where(F.col("rank") <= k)
          .groupBy("topic")
          .agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "keyword", "count"))),
                           lambda s: F.struct(s["keyword"].alias("keyword"), s["count"].alias("count")))
               .alias("top_keywords")))
    out = base.join(kw, "topic", "left")
    if entities is None:
        return out
    en = (entities.where(F.col("rank") <= k).groupBy("topic")
          .agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "entity_type", "entity", "count"))),
                           lambda s: s.dropFields("rank")).alias("top_entities")))
    return out.join(en, "topic", "left")
