"""Serving views (G1-G14, H3) as whole-table DataFrames, filterable by topic.

Point lookups of the original service become per-topic top-k / latest-row
operators over the stored tables; "latest" is an aggregate (``max_by``) where one
row per key is wanted, and ``row_number() <= k`` (a WindowGroupLimit) where k rows
per key are wanted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import scale_0_100


def _topk(df: DataFrame, by: list[str], order: list[Column], k: int, rank_col: str | None = None) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    out = df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k)
    return out.withColumnRenamed("_rn", rank_col) if rank_col else out.drop("_rn")


def _check_limit(k: int, most: int) -> None:
    if not 1 <= int(k) <= most:
        raise ValueError(f"limit must be in 1..{most}")


def _newest_first(df: DataFrame, first: str, keys: list[str]) -> Column:
    """An order of a key's rows by ``first``, then by all their other values: of rows with one time always the same one."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema.fields}
    return F.struct(first, *[c for c in sorted(df.columns) if c not in [first, *keys] and kinds[c] != "map"])


def latest_batch_view(views: DataFrame, as_of, hours: int = 24) -> DataFrame:
    """Newest topic aggregate whose period ends within ``hours`` of ``as_of``
    (filter on ``period_end``, decision D-4). One row per topic via ``max_by``."""
    if not 1 <= int(hours) <= 168:
        raise ValueError("hours must be in 1..168")
    cutoff = F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {int(hours)} HOURS")
    cols = [c for c in views.columns if c != "topic"]
    latest = views.where(F.col("period_end") >= cutoff).groupBy("topic") \
        .agg(F.max_by(F.struct(*cols), _newest_first(views, "period_start", ["topic"])).alias("v"))
    return latest.select("topic", "v.*")


def recent(df: DataFrame, k: int = 50, label: str | None = None, ts_col: str = "processed_at",
           max_k: int = 200) -> DataFrame:
    """Newest ``k`` posts per topic (optionally of one label), ties by post id;
    more than ``max_k`` is an error."""
    _check_limit(k, max_k)
    if label is not None:
        df = df.where(F.col("sentiment_label") == label)
    return _topk(df, ["topic"], [F.desc(ts_col), F.col("post_id")], int(k), "position")


def trends_view(trend_rows: DataFrame, as_of, hours: int = 24) -> DataFrame:
    """Appended hourly rows with ``batch_time >= as_of - hours``; the newest batch's
    row per (topic, hour) (decision D-6), then the newest ``hours`` hours per topic."""
    cutoff = F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {int(hours)} HOURS")
    rows = trend_rows.where(F.col("batch_time") >= cutoff)
    cols = [c for c in rows.columns if c not in ("topic", "hour")]
    newest = _newest_first(rows, "batch_time", ["topic", "hour"])
    latest = rows.groupBy("topic", "hour").agg(F.max_by(F.struct(*cols), newest).alias("v")) \
        .select("topic", "hour", "v.*")
    return _topk(latest, ["topic"], [F.desc("hour")], int(hours))


def keywords_view(kw_rows: DataFrame, k: int = 20, max_k: int = 100) -> DataFrame:
    """Per topic, by batch_time desc, count desc (ties by keyword), first ``k``;
    more than ``max_k`` is an error."""
    _check_limit(k, max_k)
    return _topk(kw_rows, ["topic"], [F.desc("batch_time"), F.desc("count"), F.col("keyword")],
                 int(k), "position")


def sources_view(src_rows: DataFrame, k: int = 50) -> DataFrame:
    """Per topic, by batch_time desc, post_count desc (ties by source), first ``k``."""
    return _topk(src_rows, ["topic"], [F.desc("batch_time"), F.desc("post_count"), F.col("subreddit")],
                 int(k), "position")


def recent_array(scored: DataFrame, k: int = 10) -> DataFrame:
    """The k newest posts of each topic as one ARRAY<STRUCT> column (bounded by k)."""
    top = recent(scored, k)
    return top.groupBy("topic").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("position", "post_id", "sentiment_score",
                                                          "sentiment_label", "processed_at"))),
                    lambda s: s.dropFields("position")).alias("recent_posts"))


def combined_view(registry: DataFrame, snapshot: DataFrame, batch_view: DataFrame, stats: DataFrame,
                  scored: DataFrame, k: int = 10, active_only: bool = True) -> DataFrame:
    """Per registered topic: realtime snapshot + latest batch view + stats + k recent
    posts. Missing stats -> average 0, count 0, distribution null. All joins are on
    topic against per-topic tables (one row per topic each)."""
    reg = registry.where(F.col("active")) if active_only else registry
    topics = reg.select(F.col("name").alias("topic"))
    rt = snapshot.select("topic", F.col("avg_sentiment").alias("realtime_avg"),
                         F.col("count").alias("realtime_count"), F.col("updated_at").alias("realtime_updated_at"))
    bv = batch_view.select("topic", F.col("avg_sentiment").alias("batch_avg"),
                           F.col("total_posts").alias("batch_total"), F.col("period_start").alias("batch_period_start"))
    st = stats.select("topic", "average_score", "post_count",
                      F.struct(F.col("positive_share").alias("positive"), F.col("negative_share").alias("negative"),
                               F.col("neutral_share").alias("neutral")).alias("distribution"))
    out = (topics.join(rt, "topic", "left").join(bv, "topic", "left").join(st, "topic", "left")
           .join(recent_array(scored, k), "topic", "left"))
    return out.select(
        "topic", "realtime_avg", "realtime_count", "realtime_updated_at", "batch_avg", "batch_total",
        "batch_period_start", F.coalesce("average_score", F.lit(0.0)).alias("average_score"),
        F.coalesce("post_count", F.lit(0)).cast("bigint").alias("post_count"), "distribution",
        scale_0_100(F.coalesce("average_score", F.lit(0.0))).alias("score_0_100"),
        F.coalesce("recent_posts", F.array()).alias("recent_posts"))


def compare_topics(combined: DataFrame, topics: list[str]) -> DataFrame:
    """The combined view of each listed topic, in list order (``position``). A listed name
    that isn't registered has a view, too: average 0, count 0, nothing recent."""
    spark = combined.sparkSession
    wanted = spark.range(1).select(F.posexplode(F.array(*[F.lit(t) for t in topics])).alias("position", "topic"))
    zero = {"average_score": 0.0, "post_count": 0, "score_0_100": 50.0}
    j = wanted.join(combined, "topic", "left")
    kind = dict(combined.dtypes)
    cols = [F.coalesce(c, F.lit(zero[c]).cast(kind[c])).alias(c) if c in zero
            else F.coalesce(c, F.array().cast(kind[c])).alias(c) if c == "recent_posts" else F.col(c)
            for c in combined.columns if c != "topic"]
    return j.select("position", "topic", *cols).orderBy("position")


def topic_comparison(scored: DataFrame, topics: list[str], start, end) -> DataFrame:
    """H3: per listed topic, stats over ``start <= processed_at < end``, in list order."""
    from .aggregates import serving_stats
    per = scored.where((F.col("processed_at") >= F.lit(start).cast("timestamp")) &
                       (F.col("processed_at") < F.lit(end).cast("timestamp")))
    st = serving_stats(per)
    spark = scored.sparkSession
    wanted = spark.range(1).select(F.posexplode(F.array(*[F.lit(t) for t in topics])).alias("position", "topic"))
    return wanted.join(st, "topic", "left").select(
        "position", "topic", F.coalesce("average_score", F.lit(0.0)).alias("average_score"),
        F.coalesce("post_count", F.lit(0)).cast("bigint").alias("post_count"),
        "positive_share", "negative_share", "neutral_share",
        F.lit(start).cast("timestamp").alias("period_start"), F.lit(end).cast("timestamp").alias("period_end"))


def normalise_topic_name(c: Column) -> Column:
    return F.lower(F.trim(c))


def apply_topic_changes(registry: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply a change table (name, subreddits, keywords, active, deleted, changed_at) to the
    registry. Names are trimmed and lower-cased. Changes are cumulative: each field takes its
    last non-null value by ``changed_at`` (of equal times the larger value), else keeps the
    old one. A deletion drops the topic and all that was set up to then (also at the same
    time); changes after it create the topic anew. Unknown names are created."""
    ch = changes.withColumn("name", normalise_topic_name(F.col("name"))) \
        .withColumn("deleted", F.coalesce("deleted", F.lit(False)))
    gone = ch.where("deleted").groupBy("name").agg(F.max("changed_at").alias("_gone"))
    since = ch.where("NOT deleted").join(gone, "name", "left") \
        .where(F.col("_gone").isNull() | (F.col("changed_at") > F.col("_gone")))

    def last(c):
        value = F.max_by(F.struct(c), F.when(F.col(c).isNotNull(), F.struct("changed_at", c)))
        return value[c].alias(c)

    n = since.groupBy("name").agg(last("subreddits"), last("keywords"), last("active"),
                                  F.min("changed_at").alias("first_at"), F.max("changed_at").alias("last_at")).alias("n")
    o = registry.join(gone, "name", "left_anti").alias("o")
    empty = F.array().cast("array<string>")
    return o.join(n, F.col("o.name") == F.col("n.name"), "full_outer").select(
        F.coalesce("n.name", "o.name").alias("name"),
        F.coalesce("n.subreddits", "o.subreddits", empty).alias("subreddits"),
        F.coalesce("n.keywords", "o.keywords", empty).alias("keywords"),
        F.coalesce("n.active", "o.active", F.lit(True)).alias("active"),
        F.coalesce("o.created_at", "n.first_at").alias("created_at"),
        F.coalesce("n.last_at", "o.updated_at").alias("updated_at"))


def trend_pivot(trends: DataFrame, topics: list[str] | DataFrame) -> DataFrame:
    """One row per ``HH:mm``, one column per listed topic; the last point wins
    when days collapse onto one time; missing score -> 0. ``topics`` may be the registry, whose names (one for
    each column of the result) are then listed in order, so that a new topic gets its column."""
    if isinstance(topics, DataFrame):
        topics = [r[0] for r in topics.select("name").distinct().orderBy("name").collect()]
    t = trends.withColumn("ts", F.to_timestamp("hour")).withColumn("time", F.date_format("ts", "HH:mm"))
    p = t.groupBy("time").pivot("topic", topics).agg(F.max_by(F.coalesce("avg_sentiment", F.lit(0.0)), "ts"))
    return p


def distribution_rows(stats: DataFrame) -> DataFrame:
    """Shares as percentages, unpivoted to (topic, name, value) rows."""
    wide = stats.select("topic",
                        (F.coalesce("positive_share", F.lit(0.0)) * 100).alias("Positive"),
                        (F.coalesce("neutral_share", F.lit(0.0)) * 100).alias("Neutral"),
                        (F.coalesce("negative_share", F.lit(0.0)) * 100).alias("Negative"))
    return wide.unpivot("topic", ["Positive", "Neutral", "Negative"], "name", "value")
