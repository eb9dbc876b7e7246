"""Rolling z-score anomalies over the hourly trend table.

The window runs over the hourly aggregate (topics x hours), never over raw posts,
so its input is small however large the post table is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.wordlists import ZSCORE_THRESHOLD


def rolling_zscore(trends: DataFrame, preceding: int = 6, threshold: float = ZSCORE_THRESHOLD,
                   exclude_current: bool = False, digits: int = 6) -> DataFrame:
    """Frame ``ROWS preceding..CURRENT`` (or ``..1 PRECEDING`` with ``exclude_current``) per
    topic ordered by hour; z = (x - avg) / std, dividing by 1 when std is 0 or null;
    ``is_anomaly`` = |z| > threshold. Rows, not time: missing hours are skipped over."""
    end = -1 if exclude_current else 0
    w = Window.partitionBy("topic").orderBy("hour").rowsBetween(-preceding, end)
    x = F.col("avg_sentiment")
    avg = F.avg(x).over(w)
    std = F.stddev_samp(x).over(w)
    z = (x - avg) / F.when(std > 0, std).otherwise(F.lit(1.0))
    return (trends.withColumn("_z", z)
            .withColumn("rolling_avg", F.round(avg, digits) + 0.0)
            .withColumn("rolling_std", F.round(std, digits) + 0.0)
            .withColumn("z_score", F.round(F.col("_z"), digits) + 0.0)
            .withColumn("is_anomaly", F.coalesce(F.abs(F.col("_z")) > threshold, F.lit(False)))
            .drop("_z"))


def anomalies(trends: DataFrame, **kw) -> DataFrame:
    return rolling_zscore(trends, **kw).where(F.col("is_anomaly"))


def carry_zscores(carried: DataFrame, hours: DataFrame, preceding: int = 6, **kw) -> tuple[DataFrame, DataFrame]:
    """E1 hour by hour, without a look-back: (z-scores of the new ``hours``, what to carry to the next call).

    ``carried`` (topic, hour, avg_sentiment, ...) are each topic's last ``preceding`` points so far. New hours must be
    closed and later than those carried (hours of a topic that aren't are recomputed points that the frame has passed: an error).
    The z-scores are those of ``rolling_zscore`` over the whole history, as its frame reaches no further back.
    """
    known = carried.groupBy("topic").agg(F.max("hour").alias("_last"))
    late = hours.join(known, "topic").where(F.col("hour") <= F.col("_last"))
    if not late.isEmpty():
        raise ValueError("hours that are not later than the carried ones")
    both = carried.select(hours.columns).withColumn("_new", F.lit(False)) \
        .unionByName(hours.withColumn("_new", F.lit(True)))
    scored = rolling_zscore(both, preceding, **kw).where(F.col("_new")).drop("_new")
    newest = Window.partitionBy("topic").orderBy(F.desc("hour"))
    keep = both.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= preceding).drop("_rank", "_new")
    return scored, keep
