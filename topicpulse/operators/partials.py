"""Mergeable partial states of the batch views D1-D3, so that an hourly run needn't read its whole look-back again.

A state is a row per topic, source and hour: counts, integer sums and sums of squares, all exact, so
that states of any parts of the posts add up to the state of all of them, in any order. The stream
appends the states of every micro-batch (``state_store``); late posts are states of an earlier hour in a
later batch and just add up. Where segments of the store are compacted their states are summed,
so that the store has a row per (topic, source, hour) and level, however many batches there were.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import E4
from ..functions.wordlists import LABELS5
from ..sources.tables import as_timestamp
from ..streaming.store import SegmentStore
from .aggregates import _score_e4

KEYS = ["topic", "subreddit", "hour"]
#: n posts; of those with a score their number, sum and sum of squares; engagement likewise; labels.
SUMS = ["n", "scored", "sum_e4", "reddit_n", "reddit_sum", *[f"{name}_count" for name in LABELS5]]
SQUARES = "sum_e4_sq"
SCHEMA = ("topic string, subreddit string, hour timestamp, " + ", ".join(f"{c} bigint" for c in SUMS)
          + f", {SQUARES} decimal(38,0)")


def partial_states(df: DataFrame, ts_col: str = "processed_at") -> DataFrame:
    """One row per topic, source and hour of the posts; a null topic, source or time is a key of its own."""
    e4 = _score_e4(df)
    square = e4.cast("decimal(19,0)") * e4.cast("decimal(19,0)")
    return df.groupBy("topic", "subreddit", F.date_trunc("hour", F.col(ts_col)).alias("hour")).agg(
        F.count(F.lit(1)).alias("n"), F.count(e4).alias("scored"), F.sum(e4).alias("sum_e4"),
        F.count("score").alias("reddit_n"), F.sum(F.col("score").cast("bigint")).alias("reddit_sum"),
        *[F.count_if(F.col("sentiment_label") == name).alias(f"{name}_count") for name in LABELS5],
        F.sum(square).cast("decimal(38,0)").alias(SQUARES))


def merge_states(states: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The states' sums by ``by`` (default: topic, source, hour)."""
    return states.groupBy(*(KEYS if by is None else by)).agg(
        *[F.sum(c).alias(c) for c in SUMS], F.sum(SQUARES).cast("decimal(38,0)").alias(SQUARES))


def state_store(spark: SparkSession, root: str, fanout: int = 8) -> SegmentStore:
    return SegmentStore(spark, root, SCHEMA, by=["hour", "topic"], merge=merge_states, fanout=fanout)


def lookback_states(states: DataFrame, as_of, hours: int = 24, posts: DataFrame | None = None,
                    ts_col: str = "processed_at") -> DataFrame:
    """States of the posts from ``as_of - hours`` on.

    Whole hours come from the states. Where the look-back begins within an hour the posts of the rest of that
    hour are needed, too: ``posts`` (the stored results) is read between the two times only. Without
    ``posts`` such a look-back is an error, not an approximation.
    """
    begin = as_timestamp(as_of) - F.expr(f"INTERVAL {int(hours)} HOURS")
    full = F.date_trunc("hour", begin + F.expr("INTERVAL 1 HOUR") - F.expr("INTERVAL 1 MICROSECOND"))
    whole = states.where(F.col("hour") >= full)
    if posts is None:
        exact = states.sparkSession.range(1).select((begin == full).alias("x")).first()[0]
        if not exact:
            raise ValueError("a look-back that begins within an hour needs the posts of that hour")
        return merge_states(whole)
    edge = posts.where((F.col(ts_col) >= begin) & (F.col(ts_col) < full))
    if "dt" in posts.columns:
        edge = edge.where((F.col("dt") >= F.to_date(begin)) & (F.col("dt") <= F.to_date(full)))
    return merge_states(whole.unionByName(partial_states(edge, ts_col)))


def _avg() -> Column:
    return F.try_divide(F.col("sum_e4").cast("double"), F.col("scored").cast("double") * E4)


def _reddit() -> Column:
    return F.try_divide(F.col("reddit_sum").cast("double"), F.col("reddit_n").cast("double"))


def topic_aggregates_of(states: DataFrame) -> DataFrame:
    """D1 from states; the sample deviation from the exact sums."""
    t = merge_states(states, ["topic"])
    big = "decimal(38,0)"
    n, s1, s2 = F.col("scored").cast(big), F.col("sum_e4").cast(big), F.col(SQUARES)
    var = F.when(F.col("scored") > 1, (n * s2 - s1 * s1).cast("double") / (n * (n - 1)).cast("double"))
    total = F.col("n").cast("double")
    share = lambda c: F.try_divide(c.cast("double"), total) * 100      # noqa: E731
    return t.select(
        "topic", _avg().alias("avg_sentiment"), F.round(F.sqrt(var) / E4, 8).alias("std_sentiment"),
        F.col("n").alias("total_posts"), *[f"{name}_count" for name in LABELS5],
        share(F.col("very_positive_count") + F.col("positive_count")).alias("positive_pct"),
        share(F.col("very_negative_count") + F.col("negative_count")).alias("negative_pct"),
        share(F.col("neutral_count")).alias("neutral_pct"))


def hourly_trends_of(states: DataFrame) -> DataFrame:
    """D2 from states."""
    return merge_states(states, ["topic", "hour"]).select(
        "topic", F.date_format("hour", "yyyy-MM-dd HH:00:00").alias("hour"), _avg().alias("avg_sentiment"),
        F.col("n").alias("post_count"), _reddit().alias("avg_reddit_score"))


def source_breakdown_of(states: DataFrame) -> DataFrame:
    """D3 from states."""
    return merge_states(states, ["topic", "subreddit"]).select(
        "topic", "subreddit", _avg().alias("avg_sentiment"), F.col("n").alias("post_count"),
        _reddit().alias("avg_reddit_score"))


def corrected_trends(trends: DataFrame, states: DataFrame, late: DataFrame, ts_col: str = "processed_at") -> DataFrame:
    """D2 after ``late`` rows: only the hours of topics that they touch are aggregated anew, from ``states`` that
    have them; all other rows of ``trends`` stay as they are. A null topic or time is a key like any other."""
    touched = late.select("topic", F.date_trunc("hour", F.col(ts_col)).alias("hour")).distinct()
    by_name = touched.select(F.col("topic").alias("_topic"), F.date_format("hour", "yyyy-MM-dd HH:00:00").alias("_hour"))
    other = trends.join(by_name, F.col("topic").eqNullSafe(F.col("_topic")) & F.col("hour").eqNullSafe(F.col("_hour")), "left_anti")
    again = touched.select(F.col("topic").alias("_topic"), F.col("hour").alias("_hour"))
    anew = states.join(again, F.col("topic").eqNullSafe(F.col("_topic")) & F.col("hour").eqNullSafe(F.col("_hour")), "left_semi")
    return other.unionByName(hourly_trends_of(anew))
