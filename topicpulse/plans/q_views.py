"""Registered queries: serving views (G2-G14, D7, H3, H5) over stored batch/speed tables.

The stored tables are derived from the event posts the way the jobs would write them:
daily topic aggregates (batch views), two hourly batch runs appended by
``batch_time`` (trend and source rows), hourly micro-batch snapshots (speed layer).
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import views as G
from ..sources import bus as B
from ..sources.tables import AS_OF, scan_lookback
from ..sources.testdata import scored_from_events, topics_from_events
from ..streaming.sinks import realtime_snapshot
from .catalog import register
from .sql import AVG_E4, HOURLY, MEAN, SCORED, with_

AS_OF_SQL = "TIMESTAMP '2024-01-31 00:00:00'"
RUNS = ["2024-01-30 12:00:00", "2024-01-31 00:00:00"]
EVENT_TOPICS = ["click", "error", "purchase", "signup", "view"]


def registry_sql(src: str, topic: str, source: str) -> str:
    return f"""
cnts AS (SELECT {topic} AS name, {source} AS source, count(*) AS n FROM {src} GROUP BY 1, 2),
rtop AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY n DESC, source) AS rn FROM cnts),
reg0 AS (SELECT name, list(source ORDER BY rn) AS subreddits, sum(n) AS docs FROM rtop GROUP BY name),
registry AS (
  SELECT name, subreddits, CAST([] AS VARCHAR[]) AS keywords,
         row_number() OVER (ORDER BY docs, name DESC) > 1 AS active,
         {AS_OF_SQL} - to_days(CAST(row_number() OVER (ORDER BY docs DESC, name) + 30 AS INTEGER)) AS created_at,
         {AS_OF_SQL} AS updated_at
  FROM reg0)
"""


EV_REGISTRY = registry_sql("scored", "topic", "subreddit")

DAILY_SQL = f"""
daily AS (
  SELECT topic, date_trunc('day', processed_at) AS period_start,
         date_trunc('day', processed_at) + INTERVAL 1 DAY AS period_end,
         {AVG_E4.format(c='sentiment_e4')} AS avg_sentiment, count(*) AS total_posts
  FROM scored GROUP BY 1, 2, 3)
"""
BATCH_VIEW_SQL = f"""
batch_view AS (
  SELECT topic, arg_max(period_start, period_start) AS period_start, arg_max(period_end, period_start) AS period_end,
         arg_max(avg_sentiment, period_start) AS avg_sentiment, arg_max(total_posts, period_start) AS total_posts
  FROM daily WHERE period_end >= {AS_OF_SQL} - INTERVAL 48 HOUR GROUP BY topic)
"""
MICRO_SQL = f"""
micro AS (
  SELECT topic, coalesce({AVG_E4.format(c='sentiment_e4')}, 0.0) AS avg_sentiment, count(*) AS "count",
         date_trunc('hour', processed_at) + INTERVAL 1 HOUR AS updated_at
  FROM scored GROUP BY topic, date_trunc('hour', processed_at)),
snap AS (
  SELECT topic, arg_max(avg_sentiment, updated_at) AS avg_sentiment, arg_max("count", updated_at) AS "count",
         max(updated_at) AS updated_at
  FROM micro WHERE updated_at > {AS_OF_SQL} - INTERVAL 300 SECOND GROUP BY topic)
"""
STATS_SQL = f"""
stats AS (
  SELECT topic, {AVG_E4.format(c='sentiment_e4')} AS average_score, count(*) AS post_count,
         CAST(count(*) FILTER (WHERE sentiment_e4 > 2000) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS positive_share,
         CAST(count(*) FILTER (WHERE sentiment_e4 < -2000) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS negative_share,
         CAST(count(*) FILTER (WHERE sentiment_e4 BETWEEN -2000 AND 2000) AS DOUBLE) / CAST(count(*) AS DOUBLE)
           AS neutral_share
  FROM scored GROUP BY topic)
"""
RECENT_SQL = """
recent10 AS (
  SELECT topic, string_agg(post_id, ',' ORDER BY processed_at DESC, post_id) AS recent_ids FROM (
    SELECT topic, post_id, processed_at FROM scored
    QUALIFY row_number() OVER (PARTITION BY topic ORDER BY processed_at DESC, post_id) <= 10)
  GROUP BY topic)
"""
COMBINED_SQL = """
combined AS (
  SELECT r.name AS topic, s.avg_sentiment AS realtime_avg, CAST(s."count" AS DOUBLE) AS realtime_count,
         s.updated_at AS realtime_updated_at, b.avg_sentiment AS batch_avg, CAST(b.total_posts AS DOUBLE) AS batch_total,
         b.period_start AS batch_period_start, coalesce(st.average_score, 0.0) AS average_score,
         CAST(coalesce(st.post_count, 0) AS BIGINT) AS post_count,
         st.positive_share AS dist_positive, st.negative_share AS dist_negative, st.neutral_share AS dist_neutral,
         (coalesce(st.average_score, 0.0) + 1) / 2 * 100 AS score_0_100, coalesce(rc.recent_ids, '') AS recent_ids
  FROM registry r LEFT JOIN snap s ON s.topic = r.name LEFT JOIN batch_view b ON b.topic = r.name
       LEFT JOIN stats st ON st.topic = r.name LEFT JOIN recent10 rc ON rc.topic = r.name
  WHERE r.active)
"""
VIEW_CTES = (SCORED, EV_REGISTRY, DAILY_SQL, BATCH_VIEW_SQL, MICRO_SQL, STATS_SQL, RECENT_SQL, COMBINED_SQL)


def _scored(spark, base):
    return scored_from_events(spark, base)


def daily_views(scored):
    d = scored.withColumn("period_start", F.date_trunc("day", "processed_at"))
    agg = A.topic_aggregates(d, by=["topic", "period_start"])
    return agg.select("topic", "period_start", (F.col("period_start") + F.expr("INTERVAL 1 DAY")).alias("period_end"),
                      "avg_sentiment", "total_posts")


def _views(spark, base):
    s = _scored(spark, base)
    reg = topics_from_events(spark, base)
    snap = realtime_snapshot(A.microbatch_history(s, "1 hour"), AS_OF, 300)
    bv = G.latest_batch_view(daily_views(s), AS_OF, 48)
    stats = A.serving_stats(s)
    return s, reg, snap, bv, stats


def flat_combined(c, *more):
    return c.select(
        *more, "topic", "realtime_avg", F.col("realtime_count").cast("double").alias("realtime_count"), "realtime_updated_at",
        "batch_avg", F.col("batch_total").cast("double").alias("batch_total"), "batch_period_start", "average_score",
        "post_count",
        F.col("distribution.positive").alias("dist_positive"), F.col("distribution.negative").alias("dist_negative"),
        F.col("distribution.neutral").alias("dist_neutral"), "score_0_100",
        F.array_join(F.transform("recent_posts", lambda r: r["post_id"]), ",").alias("recent_ids"))


@register("latest_batch_view", with_(SCORED, DAILY_SQL, BATCH_VIEW_SQL) + "SELECT * FROM batch_view")
def q_latest_batch_view(spark, base):
    return G.latest_batch_view(daily_views(_scored(spark, base)), AS_OF, 48)


@register("recent_results", with_(SCORED) + """
SELECT * FROM (
  SELECT topic, post_id, processed_at, sentiment_score,
         CAST(row_number() OVER (PARTITION BY topic ORDER BY processed_at DESC, post_id) AS INTEGER) AS position
  FROM scored)
WHERE position <= 50""")
def q_recent_results(spark, base):
    return G.recent(_scored(spark, base), 50).select("topic", "post_id", "processed_at", "sentiment_score", "position")


@register("recent_posts", with_(SCORED) + """
SELECT * FROM (
  SELECT topic, post_id, processed_at, sentiment_label,
         CAST(row_number() OVER (PARTITION BY topic ORDER BY processed_at DESC, post_id) AS INTEGER) AS position
  FROM scored WHERE sentiment_label = 'negative')
WHERE position <= 50""")
def q_recent_posts(spark, base):
    r = G.recent(_scored(spark, base), 50, label="negative")
    return r.select("topic", "post_id", "processed_at", "sentiment_label", "position")


@register("combined_view", with_(*VIEW_CTES) + "SELECT * FROM combined")
def q_combined_view(spark, base):
    s, reg, snap, bv, stats = _views(spark, base)
    return flat_combined(G.combined_view(reg, snap, bv, stats, s, 10))


@register("compare_topics", with_(*VIEW_CTES) + """
SELECT w.position, w.topic, c.realtime_avg, c.realtime_count, c.realtime_updated_at, c.batch_avg, c.batch_total,
       c.batch_period_start, coalesce(c.average_score, 0.0) AS average_score,
       CAST(coalesce(c.post_count, 0) AS BIGINT) AS post_count, c.dist_positive, c.dist_negative, c.dist_neutral,
       coalesce(c.score_0_100, 50.0) AS score_0_100, coalesce(c.recent_ids, '') AS recent_ids
FROM (SELECT unnest(['view', 'click', 'nope']) AS topic,
                                    generate_subscripts(['view', 'click', 'nope'], 1) - 1 AS position) w
LEFT JOIN combined c USING (topic)""")
def q_compare_topics(spark, base):
    s, reg, snap, bv, stats = _views(spark, base)
    c = G.compare_topics(G.combined_view(reg, snap, bv, stats, s, 10), ["view", "click", "nope"])
    flat = flat_combined(c, "position")
    return flat.withColumn("position", F.col("position").cast("bigint"))


@register("overview", with_(*VIEW_CTES) + """
SELECT r.name AS topic, s.topic IS NOT NULL AS realtime_available, b.topic IS NOT NULL AS batch_available,
       count(*) OVER () AS total_topics
FROM registry r LEFT JOIN snap s ON s.topic = r.name LEFT JOIN batch_view b ON b.topic = r.name
WHERE r.active""")
def q_overview(spark, base):
    s, reg, snap, bv, stats = _views(spark, base)
    return A.overview(reg, snap, bv)


# ------------------------------------------------------- appended batch rows
RUNS_SQL = f"""
runs AS (SELECT * FROM (VALUES (TIMESTAMP '{RUNS[0]}'), (TIMESTAMP '{RUNS[1]}')) v(batch_time)),
trend_rows AS (
  SELECT s.topic, strftime(s.processed_at, '%Y-%m-%d %H:00:00') AS hour,
         {AVG_E4.format(c='s.sentiment_e4')} AS avg_sentiment, count(*) AS post_count,
         {MEAN.format(c='s.score')} AS avg_reddit_score, r.batch_time
  FROM runs r JOIN scored s ON s.processed_at >= r.batch_time - INTERVAL 24 HOUR
  GROUP BY s.topic, 2, r.batch_time),
source_rows AS (
  SELECT s.topic, s.subreddit, {AVG_E4.format(c='s.sentiment_e4')} AS avg_sentiment, count(*) AS post_count,
         {MEAN.format(c='s.score')} AS avg_reddit_score, r.batch_time
  FROM runs r JOIN scored s ON s.processed_at >= r.batch_time - INTERVAL 24 HOUR
  GROUP BY s.topic, s.subreddit, r.batch_time)
"""


def _run_rows(spark, base, fn):
    s = _scored(spark, base)
    parts = [fn(scan_lookback(s, as_of=t, hours=24)).withColumn("batch_time", F.to_timestamp(F.lit(t)))
             for t in RUNS]
    return parts[0].unionByName(parts[1])


@register("trends_view", with_(SCORED, RUNS_SQL) + f"""
SELECT * FROM (
  SELECT topic, hour, arg_max(avg_sentiment, batch_time) AS avg_sentiment, arg_max(post_count, batch_time) AS post_count,
         arg_max(avg_reddit_score, batch_time) AS avg_reddit_score, max(batch_time) AS batch_time
  FROM trend_rows WHERE batch_time >= {AS_OF_SQL} - INTERVAL 24 HOUR GROUP BY topic, hour)
QUALIFY row_number() OVER (PARTITION BY topic ORDER BY hour DESC) <= 24""")
def q_trends_view(spark, base):
    return G.trends_view(_run_rows(spark, base, A.hourly_trends), AS_OF, 24)


@register("sources_view", with_(SCORED, RUNS_SQL) + """
SELECT *, CAST(row_number() OVER (PARTITION BY topic ORDER BY batch_time DESC, post_count DESC, subreddit)
            AS INTEGER) AS position
FROM source_rows QUALIFY position <= 50""")
def q_sources_view(spark, base):
    return G.sources_view(_run_rows(spark, base, A.source_breakdown), 50)


@register("keywords_view", with_(SCORED) + """
, kw_rows AS (
  SELECT topic, 'w' || CAST(score AS VARCHAR) AS keyword, count(*) AS "count", b.batch_time
  FROM scored, (VALUES (TIMESTAMP '2024-01-30 12:00:00'), (TIMESTAMP '2024-01-31 00:00:00')) b(batch_time)
  WHERE processed_at >= b.batch_time - INTERVAL 24 HOUR GROUP BY topic, 2, b.batch_time)
SELECT *, CAST(row_number() OVER (PARTITION BY topic ORDER BY batch_time DESC, "count" DESC, keyword) AS INTEGER)
         AS position
FROM kw_rows QUALIFY position <= 20""")
def q_keywords_view(spark, base):
    def kw(df):
        return df.groupBy("topic", F.concat(F.lit("w"), F.col("score").cast("string")).alias("keyword")) \
            .agg(F.count(F.lit(1)).alias("count"))
    return G.keywords_view(_run_rows(spark, base, kw), 20)


# --------------------------------------------------------------- G11 registry changes
CHANGES_SQL = f"""
changes AS (
  SELECT '  ' || upper(topic) || ' ' AS name, list(subreddit ORDER BY subreddit) AS subreddits,
         CAST(NULL AS VARCHAR[]) AS keywords, true AS active, false AS deleted, max(processed_at) AS changed_at
  FROM (SELECT DISTINCT topic, subreddit, max(processed_at) OVER (PARTITION BY topic) AS processed_at FROM scored)
  GROUP BY topic
  UNION ALL
  SELECT name, NULL, [name || '-news'], NULL, false, {AS_OF_SQL} - INTERVAL 1 MINUTE FROM registry
  UNION ALL
  SELECT name, NULL, NULL, NOT active, name = (SELECT min(name) FROM registry), {AS_OF_SQL} FROM registry
  UNION ALL
  SELECT name, NULL, NULL, NULL, true, {AS_OF_SQL} - INTERVAL 2 MINUTE FROM registry
  WHERE name = (SELECT max(name) FROM registry)),
ch AS (SELECT * REPLACE (lower(trim(name)) AS name) FROM changes),
gone AS (SELECT name, max(changed_at) AS gone_at FROM ch WHERE deleted GROUP BY name),
since AS (SELECT ch.* FROM ch LEFT JOIN gone USING (name) WHERE NOT deleted AND (gone_at IS NULL OR changed_at > gone_at)),
fields AS (
  SELECT name, arg_max(subreddits, changed_at) FILTER (WHERE subreddits IS NOT NULL) AS subreddits,
         arg_max(keywords, changed_at) FILTER (WHERE keywords IS NOT NULL) AS keywords,
         arg_max(active, changed_at) FILTER (WHERE active IS NOT NULL) AS active,
         min(changed_at) AS first_at, max(changed_at) AS last_at
  FROM since GROUP BY name),
applied AS (
  SELECT coalesce(n.name, o.name) AS name, coalesce(n.subreddits, o.subreddits, CAST([] AS VARCHAR[])) AS subreddits,
         coalesce(n.keywords, o.keywords, CAST([] AS VARCHAR[])) AS keywords,
         coalesce(n.active, o.active, true) AS active, coalesce(o.created_at, n.first_at) AS created_at,
         coalesce(n.last_at, o.updated_at) AS updated_at
  FROM (SELECT * FROM registry WHERE name NOT IN (SELECT name FROM gone)) o FULL OUTER JOIN fields n ON o.name = n.name)
"""


def derived_changes(scored, registry):
    """Change events derived from the tables: each event type is (re)created under an
    untidy name with its sources; every registered topic then gains a keyword and, by a
    later change, flips ``active``; the alphabetically first one is deleted at the end, the
    last one before its two updates (so they create it anew)."""
    per = scored.select("topic", "subreddit").distinct().groupBy("topic").agg(
        F.array_sort(F.collect_list("subreddit")).alias("subreddits"))
    at = scored.groupBy("topic").agg(F.max("processed_at").alias("changed_at"))
    none = F.lit(None).cast("array<string>")
    as_of = F.lit(AS_OF).cast("timestamp")
    creates = per.join(at, "topic").select(
        F.concat(F.lit("  "), F.upper("topic"), F.lit(" ")).alias("name"), "subreddits", none.alias("keywords"),
        F.lit(True).alias("active"), F.lit(False).alias("deleted"), "changed_at")
    # the registry has a row for each topic: a window over all of it gives its first and last name
    w = Window.partitionBy(F.lit(1))
    ends = registry.withColumn("first", F.min("name").over(w)).withColumn("last", F.max("name").over(w))
    keyword = ends.select("name", none.alias("subreddits"), F.array(F.concat("name", F.lit("-news"))).alias("keywords"),
                          F.lit(None).cast("boolean").alias("active"), F.lit(False).alias("deleted"),
                          (as_of - F.expr("INTERVAL 1 MINUTE")).alias("changed_at"))
    flip = ends.select("name", none.alias("subreddits"), none.alias("keywords"), (~F.col("active")).alias("active"),
                       (F.col("name") == F.col("first")).alias("deleted"), as_of.alias("changed_at"))
    drop = ends.where(F.col("name") == F.col("last")).select(
        "name", none.alias("subreddits"), none.alias("keywords"), F.lit(None).cast("boolean").alias("active"),
        F.lit(True).alias("deleted"), (as_of - F.expr("INTERVAL 2 MINUTE")).alias("changed_at"))
    return creates.unionByName(keyword).unionByName(flip).unionByName(drop)


@register("topic_registry", with_(SCORED, EV_REGISTRY, CHANGES_SQL) + """
SELECT name, array_to_string(subreddits, ',') AS subreddits, array_to_string(keywords, ',') AS keywords, active,
       created_at, updated_at FROM applied""")
def q_topic_registry(spark, base):
    s = _scored(spark, base)
    reg = topics_from_events(spark, base)
    out = G.apply_topic_changes(reg, derived_changes(s, reg))
    return out.select("name", F.array_join("subreddits", ",").alias("subreddits"),
                      F.array_join("keywords", ",").alias("keywords"), "active", "created_at", "updated_at")


# ------------------------------------------------------------------ G12, H3, H5
@register("trend_pivot", with_(SCORED, HOURLY) + ", pts AS (SELECT *, CAST(hour AS TIMESTAMP) AS ts, "
          "strftime(CAST(hour AS TIMESTAMP), '%H:%M') AS time FROM hourly)\nSELECT time, " + ", ".join(
              f"arg_max(coalesce(avg_sentiment, 0.0), ts) FILTER (WHERE topic = '{t}') AS {t}" for t in EVENT_TOPICS)
          + " FROM pts GROUP BY time")
def q_trend_pivot(spark, base):
    return G.trend_pivot(A.hourly_trends(_scored(spark, base)), topics_from_events(spark, base))


@register("topic_comparison", with_(SCORED) + f"""
, per AS (
  SELECT topic, {AVG_E4.format(c='sentiment_e4')} AS average_score, count(*) AS post_count,
         CAST(count(*) FILTER (WHERE sentiment_e4 > 2000) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS positive_share,
         CAST(count(*) FILTER (WHERE sentiment_e4 < -2000) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS negative_share,
         CAST(count(*) FILTER (WHERE sentiment_e4 BETWEEN -2000 AND 2000) AS DOUBLE) / CAST(count(*) AS DOUBLE)
           AS neutral_share
  FROM scored WHERE processed_at >= TIMESTAMP '2024-01-10 00:00:00' AND processed_at < TIMESTAMP '2024-01-20 00:00:00'
  GROUP BY topic)
SELECT w.position, w.topic, coalesce(p.average_score, 0.0) AS average_score,
       CAST(coalesce(p.post_count, 0) AS BIGINT) AS post_count, p.positive_share, p.negative_share, p.neutral_share,
       TIMESTAMP '2024-01-10 00:00:00' AS period_start, TIMESTAMP '2024-01-20 00:00:00' AS period_end
FROM (SELECT unnest(['view', 'click', 'nope']) AS topic, generate_subscripts(['view', 'click', 'nope'], 1) - 1 AS position) w
LEFT JOIN per p USING (topic)""")
def q_topic_comparison(spark, base):
    c = G.topic_comparison(_scored(spark, base), ["view", "click", "nope"], "2024-01-10 00:00:00",
                           "2024-01-20 00:00:00")
    return c.withColumn("position", F.col("position").cast("bigint"))


@register("encode_results", with_(SCORED) + """
SELECT topic || ':' || post_id AS key, post_id, sentiment_label, sentiment_e4, processed_at AS "timestamp"
FROM scored""")
def q_encode_results(spark, base):
    e = B.encode_results(_scored(spark, base).select("post_id", "topic", "sentiment_e4", "sentiment_label",
                                                      "processed_at"))
    v = F.col("value").cast("string")
    return e.select(F.col("key").cast("string").alias("key"), F.get_json_object(v, "$.post_id").alias("post_id"),
                    F.get_json_object(v, "$.sentiment_label").alias("sentiment_label"),
                    F.get_json_object(v, "$.sentiment_e4").cast("bigint").alias("sentiment_e4"), "timestamp")



# ------------------------------------------------------------- A12 on alerts, topics
@register("validate_topics", with_(SCORED, EV_REGISTRY, CHANGES_SQL) + """
, cand AS (SELECT name, subreddits, active FROM applied
           UNION ALL SELECT name, NULL, NULL FROM changes)
SELECT name, array_to_string(list_filter([CASE WHEN name IS NULL THEN 'name_required' END, CASE WHEN subreddits IS NULL THEN 'subreddits_required' END, CASE WHEN active IS NULL THEN 'active_required' END], lambda x: x IS NOT NULL), ',') AS reasons FROM cand""")
def q_validate_topics(spark, base):
    """Registry rules over the applied registry and over change records without their fields."""
    from ..operators import validate as V
    s = _scored(spark, base)
    reg = topics_from_events(spark, base)
    ch = derived_changes(s, reg)
    cand = G.apply_topic_changes(reg, ch).select("name", "subreddits", "active") \
        .unionByName(ch.select("name", F.lit(None).cast("array<string>").alias("subreddits"),
                               F.lit(None).cast("boolean").alias("active")))
    return V.validate(cand, V.table_rules(cand, "topics")).select("name", F.array_join("reasons", ",").alias("reasons"))
