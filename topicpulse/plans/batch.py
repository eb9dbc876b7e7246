"""The hourly batch job (I4): one callable, ``run_batch(as_of)``; scheduling is the caller's.

Source: the first non-empty of (columnar scored store, result store), look-back
filtered (A4/A5) so the predicate reaches the parquet scan. The scan is persisted
once (MEMORY_AND_DISK; recomputable from the files if an executor is lost) and
feeds five views; every view is written once (no double computation).
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.aggregates import hourly_trends, source_breakdown, topic_aggregates
from ..operators.alerts import all_alerts, anomaly_alerts, topic_alerts
from ..operators.anomaly import rolling_zscore
from ..operators.keywords import top_keywords
from ..operators.partials import hourly_trends_of, lookback_states, source_breakdown_of, state_store, \
    topic_aggregates_of
from ..sources.tables import first_nonempty, scan_lookback
from ..streaming.sinks import publish_views


def compute_views(df: DataFrame, as_of, lookback_hours: int = 24, top_n: int = 20) -> dict[str, DataFrame]:
    """The views of the posts; alerts are computed from published views (``compute_alerts``)."""
    ts = F.lit(as_of).cast("timestamp")
    aggs = topic_aggregates(df).withColumn("period_start", ts - F.expr(f"INTERVAL {int(lookback_hours)} HOURS")) \
        .withColumn("period_end", ts).withColumn("created_at", ts)
    views = {"topic_aggregates": aggs, "hourly_trends": hourly_trends(df), "source_stats": source_breakdown(df)}
    if "keywords" in df.columns:
        views["batch_keywords"] = top_keywords(df, top_n)
    return views


def compute_alerts(trends: DataFrame, aggs: DataFrame, as_of) -> DataFrame:
    return all_alerts(anomaly_alerts(rolling_zscore(trends)), topic_alerts(aggs, as_of))


def views_of_states(states: DataFrame, as_of, lookback_hours: int = 24) -> dict[str, DataFrame]:
    """D1-D3 of the look-back from its partial states (``lookback_states``), in the shape of ``compute_views``."""
    ts = F.lit(as_of).cast("timestamp")
    aggs = topic_aggregates_of(states).withColumn("period_start", ts - F.expr(f"INTERVAL {int(lookback_hours)} HOURS")) \
        .withColumn("period_end", ts).withColumn("created_at", ts)
    return {"topic_aggregates": aggs, "hourly_trends": hourly_trends_of(states),
            "source_stats": source_breakdown_of(states)}


def run_batch(spark: SparkSession, sources: list[str], out: str, as_of, lookback_hours: int = 24,
              partials: str | None = None) -> dict | None:
    """Run one batch: returns the computed views (already published under ``out``), or
    None when no source has rows in the look-back window.

    With ``partials``, the folder of the stream's partial states, D1-D3 come from the states of
    the look-back's hours instead of its posts; only a first hour that the look-back cuts, and the
    keywords (their arrays alone), are read from the source. All views, and the alerts that follow from
    them, are published at once.
    """
    cands = [(lambda p=p: scan_lookback(p, spark, as_of=as_of, hours=lookback_hours)) for p in sources]
    df = first_nonempty(cands)
    if df is None:
        return None
    alerts = lambda done: {"alerts": compute_alerts(done["hourly_trends"], done["topic_aggregates"], as_of)}
    if partials is not None:
        states = lookback_states(state_store(spark, partials).read(), as_of, lookback_hours, df) \
            .persist(StorageLevel.MEMORY_AND_DISK)
        try:
            views = views_of_states(states, as_of, lookback_hours)
            if "keywords" in df.columns:
                views["batch_keywords"] = top_keywords(df)
            return publish_views(views, out, as_of, alerts)
        finally:
            states.unpersist()
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return publish_views(compute_views(df, as_of, lookback_hours), out, as_of, alerts)
    finally:
        df.unpersist()
