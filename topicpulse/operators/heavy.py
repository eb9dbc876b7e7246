"""Frequent keywords per topic from small mergeable summaries (D4/H2 for the stream).

A summary holds, for a topic, some keywords with a count that is never above the
true one, and the ``error`` by which any keyword's true count may exceed its count
in the summary (0 for a keyword that isn't in it). It is a Misra-Gries summary, built
and merged by aggregates and windows: keep the ``capacity`` largest counts less the
(capacity + 1)-th largest, and add that to the error. Each such cut takes the
same number from capacity + 1 counters, so over all cuts of a topic

    error <= occurrences / (capacity + 1)

however the rows were split into summaries and in whatever order these were merged.
The exact ranking (``keywords.top_keywords``) stays the default; summaries are for
streams, whose state per topic must not grow with the number of distinct keywords.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..streaming.store import SegmentStore
from .keywords import keyword_rows

SUMMARY = "topic string, keyword string, count long, error long, total long"


def _cut(counts: DataFrame, known: DataFrame, capacity: int) -> DataFrame:
    """(topic, keyword, count) and the topics' (topic, error, total) -> a summary of at most ``capacity`` keywords each.

    The rank is cut to capacity + 1 rows a topic in every task before the shuffle (WindowGroupLimit). Each
    topic also has a row without keyword, which carries its error and total where no keyword is left.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    w = Window.partitionBy("topic").orderBy(F.desc("count"), F.col("keyword"))
    top = counts.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= capacity + 1)
    less = top.groupBy(F.col("topic").alias("_of")).agg(
        F.coalesce(F.max(F.when(F.col("_rank") == capacity + 1, F.col("count"))), F.lit(0)).alias("_less"))
    facts = known.join(less, F.col("topic").eqNullSafe(F.col("_of")), "left").select(
        F.col("topic").alias("_of"), (F.col("error") + F.coalesce("_less", F.lit(0))).alias("error"), "total",
        F.coalesce("_less", F.lit(0)).alias("_less"))
    left = top.join(facts, F.col("topic").eqNullSafe(F.col("_of"))).where(F.col("count") > F.col("_less")).select(
        "topic", "keyword", (F.col("count") - F.col("_less")).alias("count"), "error", "total")
    bare = facts.select(F.col("_of").alias("topic"), F.lit(None).cast("string").alias("keyword"), F.lit(0).cast("long").alias("count"),
                        "error", "total")
    return left.unionByName(bare)


def keyword_summary(scored: DataFrame, capacity: int = 256) -> DataFrame:
    """Summary of the keyword arrays of (topic, keywords). Null arrays and null keywords count nothing; a topic may be null."""
    k = keyword_rows(scored.select("topic", "keywords")).where(F.col("keyword").isNotNull())
    counts = k.groupBy("topic", "keyword").agg(F.count(F.lit(1)).alias("count"))
    known = counts.groupBy("topic").agg(F.lit(0).cast("long").alias("error"), F.sum("count").alias("total"))
    return _cut(counts, known, capacity)


def merge_summaries(summaries: DataFrame, capacity: int = 256) -> DataFrame:
    """One summary of several, the rows of all of them in one table: counts, errors and totals add up, then one cut.

    An error or total is on every row of its summary, so those of the rows without keyword, one
    a topic and summary, are added.
    """
    known = summaries.where(F.col("keyword").isNull()).groupBy("topic").agg(
        F.sum("error").alias("error"), F.sum("total").alias("total"))
    counts = summaries.where(F.col("keyword").isNotNull()).groupBy("topic", "keyword").agg(F.sum("count").alias("count"))
    return _cut(counts, known, capacity)


def frequent_keywords(summary: DataFrame, n: int = 20) -> DataFrame:
    """(topic, keyword, least, most, certain, rank): the ``n`` keywords with the largest counts of each topic.

    The true count lies from ``least`` to ``most``. ``certain``: no keyword that isn't listed can have a
    larger true count than the ``least`` of this one.
    """
    w = Window.partitionBy("topic").orderBy(F.desc("count"), F.col("keyword"))
    s = summary.where(F.col("keyword").isNotNull()).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n + 1)
    beyond = F.max(F.when(F.col("rank") == n + 1, F.col("count"))).over(Window.partitionBy("topic"))
    s = s.withColumn("_beyond", F.coalesce(beyond, F.lit(0)) + F.col("error"))
    return s.where(F.col("rank") <= n).select(
        "topic", "keyword", F.col("count").alias("least"), (F.col("count") + F.col("error")).alias("most"),
        (F.col("count") >= F.col("_beyond")).alias("certain"), "rank")


def summary_store(spark: SparkSession, root: str, capacity: int = 256, fanout: int = 8) -> SegmentStore:
    """Stored summaries of micro-batches, by batch id: a replayed batch counts once, compaction merges summaries."""
    return SegmentStore(spark, root, SUMMARY, ["topic"], merge=lambda df: merge_summaries(df, capacity), fanout=fanout)
