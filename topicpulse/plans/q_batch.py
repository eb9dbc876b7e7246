"""Registered queries: the numeric batch layer."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import aggregates as A
from ..operators import alerts as AL
from ..operators import partials as P
from ..operators import validate as V
from ..operators.anomaly import anomalies, rolling_zscore
from ..session import new_folder
from ..sources.tables import AS_OF
from ..sources.testdata import scored_from_events
from .catalog import register
from .sql import AVG_E4, HOURLY, MEAN, SCORED, TOPIC_AGG, ZSCORES, with_

AS_OF_SQL = "TIMESTAMP '2024-01-31 00:00:00'"


def _scored(spark, base):
    return scored_from_events(spark, base)


@register("topic_aggregates", with_(SCORED, TOPIC_AGG) + "SELECT * FROM topic_aggs")
def q_topic_aggregates(spark, base):
    return A.topic_aggregates(_scored(spark, base))


@register("hourly_trends", with_(SCORED, HOURLY) + "SELECT * FROM hourly")
def q_hourly_trends(spark, base):
    return A.hourly_trends(_scored(spark, base))


@register("source_breakdown", with_(SCORED) + f"""
SELECT topic, subreddit, {AVG_E4.format(c='sentiment_e4')} AS avg_sentiment, count(*) AS post_count,
       {MEAN.format(c='score')} AS avg_reddit_score
FROM scored GROUP BY 1, 2""")
def q_source_breakdown(spark, base):
    return A.source_breakdown(_scored(spark, base))


def _states(spark, base):
    """Partial states of the event posts as a stream would have stored them: batches of ten days, errors three days late."""
    s = _scored(spark, base)
    arrival = F.col("processed_at") + F.when(F.col("topic") == "error", F.expr("INTERVAL 3 DAYS")).otherwise(F.expr("INTERVAL 0 DAYS"))
    store = P.state_store(spark, new_folder(spark, "partials"), fanout=2)
    for n, (a, b) in enumerate([("2000-01-01", "2024-01-11"), ("2024-01-11", "2024-01-21"), ("2024-01-21", "2100-01-01")]):
        part = s.where((arrival >= F.to_timestamp(F.lit(a))) & (arrival < F.to_timestamp(F.lit(b))))
        store.append(P.partial_states(part), n)
    return store.read()


@register("incremental_topic_aggregates", with_(SCORED, TOPIC_AGG) + "SELECT * FROM topic_aggs")
def q_incremental_topic_aggregates(spark, base):
    return P.topic_aggregates_of(_states(spark, base))


@register("incremental_hourly_trends", with_(SCORED, HOURLY) + """
SELECT * FROM hourly WHERE hour >= '2024-01-21 00:00:00'""")
def q_incremental_hourly_trends(spark, base):
    return P.hourly_trends_of(P.lookback_states(_states(spark, base), AS_OF, 240))


@register("incremental_source_breakdown", with_(SCORED) + f"""
SELECT topic, subreddit, {AVG_E4.format(c='sentiment_e4')} AS avg_sentiment, count(*) AS post_count,
       {MEAN.format(c='score')} AS avg_reddit_score
FROM scored WHERE processed_at >= TIMESTAMP '2024-01-21 00:20:00' GROUP BY 1, 2""")
def q_incremental_source_breakdown(spark, base):
    """A look-back that begins within an hour: the rest of that hour comes from the posts."""
    as_of = AS_OF + dt.timedelta(minutes=20)
    return P.source_breakdown_of(P.lookback_states(_states(spark, base), as_of, 240, _scored(spark, base)))


@register("corrected_trends", with_(SCORED, HOURLY) + "SELECT * FROM hourly")
def q_corrected_trends(spark, base):
    """Trends of the rows on time, corrected by the rows that came when their windows were closed (a topic's first ten days)."""
    from ..streaming.stream import split_late
    s = _scored(spark, base)
    old, late = split_late(s, "2024-01-11 00:00:00")
    came_late = F.col("topic") == "error"
    first = s.where(~came_late).unionByName(s.where(came_late & (F.col("processed_at") >= F.to_timestamp(F.lit("2024-01-11 00:00:00")))))
    return P.corrected_trends(A.hourly_trends(first), _states(spark, base), late.where(came_late))


@register("carried_zscores", with_(SCORED, HOURLY, ZSCORES) + "SELECT * FROM zscores")
def q_carried_zscores(spark, base):
    """E1 in four batches of hours, each from the points carried by the one before it."""
    from ..streaming.stream import anomaly_step
    hours, out = A.hourly_trends(_scored(spark, base)), new_folder(spark, "zscores")
    days = ["2000-01-01", "2024-01-08", "2024-01-16", "2024-01-24", "2100-01-01"]
    parts = [anomaly_step(hours.where((F.col("hour") >= a) & (F.col("hour") < b)), n, out)
             for n, (a, b) in enumerate(zip(days, days[1:]))]
    return reduce(DataFrame.unionByName, parts)


@register("validation_counts", with_(SCORED) + """
SELECT rule, count(*) FILTER (WHERE bad) AS failures FROM (
  SELECT 'score_range' AS rule, NOT coalesce(score BETWEEN 0 AND 50, false) AS bad FROM scored
  UNION ALL SELECT 'topic_known', topic NOT IN ('click', 'view', 'signup') FROM scored
  UNION ALL SELECT 'tone_range', NOT sentiment_e4 BETWEEN -5000 AND 5000 FROM scored) GROUP BY rule""")
def q_validation_counts(spark, base):
    """Failures of each rule, counted while accepted and rejected rows are written."""
    rules = [("score_range", F.col("score").between(0, 50)), ("topic_known", F.col("topic").isin("click", "view", "signup")),
             ("tone_range", F.col("sentiment_e4").between(-5000, 5000))]
    counts = V.write_validated(_scored(spark, base), rules, new_folder(spark, "validated"))
    return spark.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(rule).alias("rule"), F.lit(counts[rule]).cast("bigint").alias("failures")) for rule, _ in rules])))


@register("rolling_zscore", with_(SCORED, HOURLY, ZSCORES) + "SELECT * FROM zscores")
def q_rolling_zscore(spark, base):
    return rolling_zscore(A.hourly_trends(_scored(spark, base)))


@register("anomalies", with_(SCORED, HOURLY, ZSCORES) + "SELECT * FROM zscores WHERE is_anomaly")
def q_anomalies(spark, base):
    return anomalies(A.hourly_trends(_scored(spark, base)))


# ------------------------------------------------------------------ alerts (F)
POST_ALERTS_SQL = """
post_alerts AS (
  SELECT sha256(concat_ws('|', 'low_sentiment', topic, post_id)) AS alert_id, topic,
         'low_sentiment' AS alert_type,
         'Low sentiment detected: ' || CAST(sentiment_score AS VARCHAR) AS message,
         'warning' AS severity, sentiment_score AS sentiment_value, -0.5 ::DOUBLE AS threshold,
         post_id, CAST(NULL AS BIGINT) AS post_count, processed_at AS "timestamp",
         false AS acknowledged, CAST(NULL AS TIMESTAMP) AS acknowledged_at
  FROM scored WHERE sentiment_score < -0.5)
"""
ANOMALY_ALERTS_SQL = """
anomaly_alerts AS (
  SELECT sha256(concat_ws('|', 'sentiment_anomaly', topic, hour)) AS alert_id, topic,
         'sentiment_anomaly' AS alert_type,
         printf('Sentiment anomaly detected. Z-score: %.2f', z_score) AS message,
         CASE WHEN abs(z_score) < 3.0 THEN 'warning' ELSE 'critical' END AS severity,
         avg_sentiment AS sentiment_value, 2.0 ::DOUBLE AS threshold, CAST(NULL AS VARCHAR) AS post_id,
         CAST(NULL AS BIGINT) AS post_count, CAST(hour AS TIMESTAMP) AS "timestamp",
         false AS acknowledged, CAST(NULL AS TIMESTAMP) AS acknowledged_at
  FROM zscores WHERE is_anomaly)
"""
TOPIC_ALERTS_SQL = f"""
topic_alerts AS (
  SELECT sha256(concat_ws('|', 'low_avg_sentiment', topic, CAST({AS_OF_SQL} AS VARCHAR))) AS alert_id, topic,
         'low_avg_sentiment' AS alert_type,
         printf('Average sentiment below threshold: %.3f', avg_sentiment) AS message,
         'warning' AS severity, avg_sentiment AS sentiment_value, -0.5 ::DOUBLE AS threshold,
         CAST(NULL AS VARCHAR) AS post_id, total_posts AS post_count, {AS_OF_SQL} AS "timestamp",
         false AS acknowledged, CAST(NULL AS TIMESTAMP) AS acknowledged_at
  FROM topic_aggs WHERE avg_sentiment < -0.5)
"""
ALL_ALERTS_SQL = """
all_alerts AS (
  SELECT * FROM post_alerts UNION ALL SELECT * FROM anomaly_alerts UNION ALL SELECT * FROM topic_alerts)
"""
ALERT_CTES = (SCORED, HOURLY, ZSCORES, TOPIC_AGG, POST_ALERTS_SQL, ANOMALY_ALERTS_SQL, TOPIC_ALERTS_SQL,
              ALL_ALERTS_SQL)


def _all_alerts(spark, base):
    s = _scored(spark, base)
    z = rolling_zscore(A.hourly_trends(s))
    return AL.all_alerts(AL.post_alerts(s), AL.anomaly_alerts(z), AL.topic_alerts(A.topic_aggregates(s), AS_OF))


@register("post_alerts", with_(SCORED, POST_ALERTS_SQL) + "SELECT * FROM post_alerts")
def q_post_alerts(spark, base):
    return AL.post_alerts(_scored(spark, base))


@register("anomaly_alerts", with_(SCORED, HOURLY, ZSCORES, ANOMALY_ALERTS_SQL) + "SELECT * FROM anomaly_alerts")
def q_anomaly_alerts(spark, base):
    return AL.anomaly_alerts(rolling_zscore(A.hourly_trends(_scored(spark, base))))


@register("topic_alerts", with_(SCORED, TOPIC_AGG, TOPIC_ALERTS_SQL.replace("-0.5", "0.5")) + "SELECT * FROM topic_alerts")
def q_topic_alerts(spark, base):
    """With a threshold above the usual one, so that topics do fall below it."""
    return AL.topic_alerts(A.topic_aggregates(_scored(spark, base)), AS_OF, threshold=0.5)


@register("all_alerts", with_(*ALERT_CTES) + "SELECT * FROM all_alerts")
def q_all_alerts(spark, base):
    return _all_alerts(spark, base)


@register("list_alerts", with_(*ALERT_CTES) + """
SELECT * FROM all_alerts WHERE NOT acknowledged ORDER BY "timestamp" DESC, alert_id LIMIT 100""")
def q_list_alerts(spark, base):
    return AL.list_alerts(_all_alerts(spark, base), limit=100)


ACKS_SQL = """
acks AS (
  SELECT alert_id, "timestamp" + INTERVAL 1 HOUR AS acknowledged_at FROM post_alerts WHERE topic = 'error'
  UNION ALL
  SELECT alert_id, "timestamp" + INTERVAL 2 HOUR FROM post_alerts WHERE topic = 'error'
  UNION ALL
  SELECT 'no-such-alert', TIMESTAMP '2024-01-31 00:00:00'),
first_ack AS (SELECT alert_id, min(acknowledged_at) AS ack_at FROM acks GROUP BY 1)
"""


def derived_acks(alerts):
    """Ack events derived from the alerts: two acks (1 h and 2 h later) for every
    post alert of topic 'error', plus one ack for an id that does not exist."""
    e = alerts.where((F.col("alert_type") == "low_sentiment") & (F.col("topic") == "error"))
    one = e.select("alert_id", (F.col("timestamp") + F.expr("INTERVAL 1 HOUR")).alias("acknowledged_at"))
    two = e.select("alert_id", (F.col("timestamp") + F.expr("INTERVAL 2 HOURS")).alias("acknowledged_at"))
    unknown = alerts.sparkSession.range(1).select(F.lit("no-such-alert").alias("alert_id"),
                                                 F.lit(AS_OF).cast("timestamp").alias("acknowledged_at"))
    return one.unionByName(two).unionByName(unknown)


@register("apply_acks", with_(*ALERT_CTES, ACKS_SQL) + """
SELECT a.alert_id, a.topic, a.alert_type, a.message, a.severity, a.sentiment_value, a.threshold, a.post_id,
       a.post_count, a."timestamp", a.acknowledged OR f.ack_at IS NOT NULL AS acknowledged,
       coalesce(a.acknowledged_at, f.ack_at) AS acknowledged_at
FROM all_alerts a LEFT JOIN first_ack f USING (alert_id)""")
def q_apply_acks(spark, base):
    alerts = _all_alerts(spark, base)
    return AL.apply_acks(alerts, derived_acks(AL.post_alerts(_scored(spark, base))))


# ------------------------------------------------- speed-layer views
MICRO_SQL = f"""
micro AS (
  SELECT topic, coalesce({AVG_E4.format(c='sentiment_e4')}, 0.0) AS avg_sentiment, count(*) AS "count",
         date_trunc('hour', processed_at) + INTERVAL 1 HOUR AS updated_at
  FROM scored GROUP BY topic, date_trunc('hour', processed_at))
"""


@register("microbatch_stats", with_(SCORED, MICRO_SQL) + "SELECT * FROM micro")
def q_microbatch_stats(spark, base):
    return A.microbatch_history(_scored(spark, base), "1 hour")


@register("realtime_snapshot", with_(SCORED, MICRO_SQL) + f"""
SELECT topic, arg_max(avg_sentiment, updated_at) AS avg_sentiment, arg_max("count", updated_at) AS "count",
       max(updated_at) AS updated_at
FROM micro WHERE updated_at > {AS_OF_SQL} - INTERVAL 300 SECOND GROUP BY topic""")
def q_realtime_snapshot(spark, base):
    from ..streaming.sinks import realtime_snapshot
    return realtime_snapshot(A.microbatch_history(_scored(spark, base), "1 hour"), AS_OF, ttl_seconds=300)


@register("history_topk", with_(SCORED, MICRO_SQL) + """
SELECT * FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY topic ORDER BY updated_at DESC) AS INTEGER) AS position FROM micro)
WHERE position <= 100""")
def q_history_topk(spark, base):
    from ..streaming.sinks import history
    return history(A.microbatch_history(_scored(spark, base), "1 hour"), limit=100)


# --------------------------------------------------------- serving stats
STATS_SQL = f"""
stats0 AS (
  SELECT topic, {AVG_E4.format(c='sentiment_e4')} AS average_score, count(*) AS post_count,
         count(*) FILTER (WHERE sentiment_e4 > 2000) AS positive_count,
         count(*) FILTER (WHERE sentiment_e4 < -2000) AS negative_count,
         count(*) FILTER (WHERE sentiment_e4 >= -2000 AND sentiment_e4 <= 2000) AS neutral_count
  FROM scored GROUP BY topic),
stats AS (
  SELECT *, CAST(positive_count AS DOUBLE) / CAST(post_count AS DOUBLE) AS positive_share,
            CAST(negative_count AS DOUBLE) / CAST(post_count AS DOUBLE) AS negative_share,
            CAST(neutral_count AS DOUBLE) / CAST(post_count AS DOUBLE) AS neutral_share
  FROM stats0)
"""


@register("serving_stats", with_(SCORED, STATS_SQL) + "SELECT * FROM stats")
def q_serving_stats(spark, base):
    return A.serving_stats(_scored(spark, base))


@register("distribution_rows", with_(SCORED, STATS_SQL) + """
SELECT topic, name, value FROM (
  SELECT topic, 'Positive' AS name, coalesce(positive_share, 0) * 100 AS value, 1 AS o FROM stats
  UNION ALL SELECT topic, 'Neutral', coalesce(neutral_share, 0) * 100, 2 FROM stats
  UNION ALL SELECT topic, 'Negative', coalesce(negative_share, 0) * 100, 3 FROM stats)""")
def q_distribution_rows(spark, base):
    from ..operators.views import distribution_rows
    return distribution_rows(A.serving_stats(_scored(spark, base)))


@register("dashboard_totals", with_(*ALERT_CTES, STATS_SQL) + """
SELECT (SELECT CAST(coalesce(sum(post_count), 0) AS BIGINT) FROM stats) AS total_posts,
       (SELECT count(*) FROM stats) AS active_topics,
       (SELECT count(*) FROM all_alerts) AS alert_count""")
def q_dashboard_totals(spark, base):
    return A.dashboard_totals(A.serving_stats(_scored(spark, base)), _all_alerts(spark, base))


# ------------------------------------------------------------ labels
LABEL_SQL = {
    "label3": "CASE WHEN sentiment_score >= 0.05 THEN 'positive' WHEN sentiment_score <= -0.05 THEN 'negative' "
              "WHEN sentiment_score IS NOT NULL THEN 'neutral' END",
    "label5": "CASE WHEN sentiment_score <= -0.6 THEN 'very_negative' WHEN sentiment_score <= -0.2 THEN 'negative' "
              "WHEN sentiment_score <= 0.2 THEN 'neutral' WHEN sentiment_score <= 0.6 THEN 'positive' "
              "WHEN sentiment_score IS NOT NULL THEN 'very_positive' END",
    "label5_display": "CASE WHEN coalesce(sentiment_score, 0) > 0.5 THEN 'Very Positive' "
                      "WHEN coalesce(sentiment_score, 0) > 0.2 THEN 'Positive' "
                      "WHEN coalesce(sentiment_score, 0) > -0.2 THEN 'Neutral' "
                      "WHEN coalesce(sentiment_score, 0) > -0.5 THEN 'Negative' ELSE 'Very Negative' END",
    "polarity3": "CASE WHEN sentiment_score > 0.2 THEN 'positive' WHEN sentiment_score < -0.2 THEN 'negative' "
                 "WHEN sentiment_score IS NOT NULL THEN 'neutral' END",
}
LABEL_FN = {"label3": L.label3, "label5": L.label5, "label5_display": L.label5_display, "polarity3": L.polarity3}


def _label_query(name):
    def q(spark, base):
        s = _scored(spark, base)
        return s.select("post_id", "sentiment_score", LABEL_FN[name]("sentiment_score").alias("label"),
                        L.scale_0_100("sentiment_score").alias("score_0_100"))
    return q


for _n in LABEL_FN:
    register(_n, with_(SCORED) + f"SELECT post_id, sentiment_score, {LABEL_SQL[_n]} AS label, "
                                 "(sentiment_score + 1) / 2 * 100 AS score_0_100 FROM scored")(_label_query(_n))


# ------------------------------------------------------------------ trend summary (H1)
@register("trend_summary", with_(SCORED, HOURLY) + """
SELECT topic, count(*) AS points, arg_min(avg_sentiment, hour) AS first_value,
       arg_max(avg_sentiment, hour) AS current_value, max(hour) AS last_hour,
       round((arg_max(avg_sentiment, hour) - arg_min(avg_sentiment, hour)) / abs(arg_min(avg_sentiment, hour)) * 100, 4)
         AS change_pct,
       CASE WHEN arg_max(avg_sentiment, hour) - arg_min(avg_sentiment, hour) > 0.05 THEN 'up'
            WHEN arg_max(avg_sentiment, hour) - arg_min(avg_sentiment, hour) < -0.05 THEN 'down'
            ELSE 'stable' END AS direction,
       string_agg(hour || '=' || CAST(post_count AS VARCHAR) || '@' || CAST(CAST(round(avg_sentiment * 1000000) AS BIGINT) AS VARCHAR),
                  ',' ORDER BY hour) AS time_series
FROM hourly GROUP BY topic""")
def q_trend_summary(spark, base):
    t = A.trend_summary(A.hourly_trends(_scored(spark, base)))
    return t.withColumn("time_series", F.array_join(F.transform(
        "time_series", lambda p: F.concat(
            p["hour"], F.lit("="), p["post_count"].cast("string"), F.lit("@"),
            F.round(p["avg_sentiment"] * 1000000).cast("bigint").cast("string"))), ","))


@register("chart_points", with_(SCORED, HOURLY) + """
SELECT topic, hour, strftime(CAST(hour AS TIMESTAMP), '%H:%M') AS time,
       CASE WHEN topic = 'error' THEN 0.0 ELSE avg_sentiment END AS score,
       CASE WHEN topic = 'signup' THEN 0 ELSE post_count END AS "count" FROM hourly""")
def q_chart_points(spark, base):
    """With a topic whose hours have no score and one whose hours have no count."""
    t = A.hourly_trends(_scored(spark, base))
    return A.chart_points(t.withColumn("avg_sentiment", F.when(F.col("topic") != "error", F.col("avg_sentiment")))
                          .withColumn("post_count", F.when(F.col("topic") != "signup", F.col("post_count"))))


# ------------------------------------------------ I5 window operator (batch execution)
@register("windowed_trends", with_(SCORED, HOURLY) + "SELECT * FROM hourly")
def q_windowed_trends(spark, base):
    """The streaming hourly-window operator run over the whole table (the watermark is
    inert in a batch plan); it must equal the hourly trend view."""
    from ..streaming.stream import windowed_trends
    return windowed_trends(_scored(spark, base))



# ------------------------------------------------------------- A12 on alerts, aggregates
@register("validate_alerts", with_(*ALERT_CTES) + """
SELECT alert_id, array_to_string(list_filter([CASE WHEN topic IS NULL THEN 'topic_required' END, CASE WHEN alert_type IS NULL THEN 'alert_type_required' END, CASE WHEN "timestamp" IS NULL THEN 'timestamp_required' END], lambda x: x IS NOT NULL), ',') AS reasons
FROM (SELECT alert_id, topic, alert_type, "timestamp" FROM all_alerts
      UNION ALL SELECT alert_id, NULL, NULL, "timestamp" FROM all_alerts)""")
def q_validate_alerts(spark, base):
    """Alert rules over the alerts and over bare records of them (an id and a time only)."""
    from ..operators import validate as V
    a = _all_alerts(spark, base)
    bare = a.withColumn("topic", F.lit(None).cast("string")).withColumn("alert_type", F.lit(None).cast("string"))
    both = a.unionByName(bare)
    return V.validate(both, V.table_rules(both, "alerts")).select("alert_id", F.array_join("reasons", ",").alias("reasons"))


@register("validate_aggregates", with_(SCORED) + """
SELECT topic, period_start, array_to_string(list_filter([CASE WHEN topic IS NULL THEN 'topic_required' END, CASE WHEN period_start IS NULL THEN 'period_start_required' END, CASE WHEN period_end IS NULL THEN 'period_end_required' END], lambda x: x IS NOT NULL), ',') AS reasons
FROM (SELECT topic, date_trunc('day', processed_at) AS period_start,
             date_trunc('day', processed_at) + INTERVAL 1 DAY AS period_end FROM scored GROUP BY ALL
      UNION ALL SELECT topic, NULL, NULL FROM scored GROUP BY topic)""")
def q_validate_aggregates(spark, base):
    """Aggregate rules over daily aggregates and over aggregates of all time, which have no period."""
    from ..operators import validate as V
    s = _scored(spark, base)
    day = F.date_trunc("day", "processed_at")
    daily = A.topic_aggregates(s.withColumn("period_start", day), by=["topic", "period_start"]) \
        .withColumn("period_end", F.col("period_start") + F.expr("INTERVAL 1 DAY"))
    both = daily.unionByName(A.topic_aggregates(s), allowMissingColumns=True)
    v = V.validate(both, V.table_rules(both, "aggregates"))
    return v.select("topic", "period_start", F.array_join("reasons", ",").alias("reasons"))
