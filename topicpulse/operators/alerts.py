"""Alerts (F1-F6). ``alert_id`` is a hash of the alert's natural key, so a replayed
batch or a re-run hour yields the same ids and unions stay free of duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.wordlists import ALERT_THRESHOLD, CRITICAL_ZSCORE, ZSCORE_THRESHOLD
from ..schemas import ALERT_COLUMNS


def alert_id(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)


def _shape(df: DataFrame) -> DataFrame:
    """Common alert columns, in order, with typed nulls for the missing ones."""
    types = {"post_id": "string", "post_count": "bigint", "acknowledged_at": "timestamp",
             "sentiment_value": "double", "threshold": "double"}
    cols = []
    for c in ALERT_COLUMNS:
        if c in df.columns:
            cols.append(F.col(c).cast(types[c]).alias(c) if c in types else F.col(c))
        else:
            cols.append(F.lit(None).cast(types.get(c, "string")).alias(c))
    return df.select(*cols)


def post_alerts(scored: DataFrame, threshold: float = ALERT_THRESHOLD) -> DataFrame:
    """F1: one ``low_sentiment`` warning per post with score < threshold (null never alerts)."""
    s = F.col("sentiment_score")
    a = scored.where(s < threshold).select(
        alert_id(F.lit("low_sentiment"), F.col("topic"), F.col("post_id")).alias("alert_id"),
        "topic", F.lit("low_sentiment").alias("alert_type"),
        F.concat(F.lit("Low sentiment detected: "), s.cast("string")).alias("message"),
        F.lit("warning").alias("severity"), s.alias("sentiment_value"),
        F.lit(float(threshold)).alias("threshold"), "post_id",
        F.col("processed_at").alias("timestamp"), F.lit(False).alias("acknowledged"))
    return _shape(a)


def anomaly_alerts(zscores: DataFrame, threshold: float = ZSCORE_THRESHOLD,
                   critical: float = CRITICAL_ZSCORE) -> DataFrame:
    """flagged hours -> ``sentiment_anomaly``; warning if |z| < critical else critical."""
    z = F.col("z_score")
    a = zscores.where(F.col("is_anomaly")).select(
        alert_id(F.lit("sentiment_anomaly"), F.col("topic"), F.col("hour")).alias("alert_id"),
        "topic", F.lit("sentiment_anomaly").alias("alert_type"),
        F.format_string("Sentiment anomaly detected. Z-score: %.2f", z).alias("message"),
        F.when(F.abs(z) < critical, "warning").otherwise("critical").alias("severity"),
        F.col("avg_sentiment").alias("sentiment_value"), F.lit(float(threshold)).alias("threshold"),
        F.to_timestamp("hour").alias("timestamp"), F.lit(False).alias("acknowledged"))
    return _shape(a)


def topic_alerts(aggregates: DataFrame, batch_time, threshold: float = ALERT_THRESHOLD) -> DataFrame:
    """topic average < threshold -> ``low_avg_sentiment`` carrying the post count."""
    avg = F.col("avg_sentiment")
    ts = F.lit(batch_time).cast("timestamp")
    a = aggregates.where(avg < threshold).select(
        alert_id(F.lit("low_avg_sentiment"), F.col("topic"), ts).alias("alert_id"),
        "topic", F.lit("low_avg_sentiment").alias("alert_type"),
        F.format_string("Average sentiment below threshold: %.3f", avg).alias("message"),
        F.lit("warning").alias("severity"), avg.alias("sentiment_value"),
        F.lit(float(threshold)).alias("threshold"), F.col("total_posts").alias("post_count"),
        ts.alias("timestamp"), F.lit(False).alias("acknowledged"))
    return _shape(a)


def all_alerts(*parts: DataFrame) -> DataFrame:
    """one alert table from all kinds."""
    out = _shape(parts[0])
    for p in parts[1:]:
        out = out.unionByName(_shape(p))
    return out


def list_alerts(alerts: DataFrame, topic: str | None = None, unacknowledged_only: bool = True,
                limit: int = 100, max_limit: int = 500) -> DataFrame:
    """optional topic, unacknowledged by default, newest first, ``limit`` rows;
    a limit beyond ``max_limit`` is an error."""
    if limit > max_limit:
        raise ValueError(f"limit must be at most {max_limit}")
    df = alerts
    if topic is not None:
        df = df.where(F.col("topic") == topic)
    if unacknowledged_only:
        df = df.where(~F.col("acknowledged"))
    return df.orderBy(F.desc("timestamp"), "alert_id").limit(int(limit))


def apply_acks(alerts: DataFrame, acks: DataFrame) -> DataFrame:
    """apply acknowledgement events; the earliest ack per id wins, unknown ids are ignored."""
    first = acks.groupBy("alert_id").agg(F.min("acknowledged_at").alias("_ack_at"))
    j = alerts.join(first, "alert_id", "left")
    return _shape(j.withColumn("acknowledged", F.col("acknowledged") | F.col("_ack_at").isNotNull())
                  .withColumn("acknowledged_at", F.coalesce(F.col("acknowledged_at"), F.col("_ack_at"))))

