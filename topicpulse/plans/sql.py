"""SQL building blocks for the oracle queries (DuckDB dialect), mirroring the adapters."""

# scored posts from events (topic = event_type; score in 1/10000)
SCORED = """
scored0 AS (
  SELECT CAST(event_id AS VARCHAR) AS post_id,
         event_type AS topic,
         's' || CAST(user_id % 20 AS VARCHAR) AS subreddit,
         'u' || CAST(user_id AS VARCHAR) AS author,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS score,
         CAST(round(20000 * value / (value + 50) - 10000) AS BIGINT) AS sentiment_e4,
         CAST(ts AS TIMESTAMP) AS processed_at
  FROM events),
scored AS (
  SELECT *, CAST(sentiment_e4 AS DOUBLE) / 10000 AS sentiment_score,
         CASE WHEN CAST(sentiment_e4 AS DOUBLE) / 10000 >= 0.05 THEN 'positive'
              WHEN CAST(sentiment_e4 AS DOUBLE) / 10000 <= -0.05 THEN 'negative'
              WHEN sentiment_e4 IS NOT NULL THEN 'neutral' END AS sentiment_label
  FROM scored0)
"""

AVG_E4 = "CAST(sum({c}) AS DOUBLE) / (CAST(count({c}) AS DOUBLE) * 10000)"
STD_E4 = "round(stddev_samp({c}) / 10000, 8)"
MEAN = "CAST(sum({c}) AS DOUBLE) / CAST(count({c}) AS DOUBLE)"

TOPIC_AGG = f"""
topic_agg AS (
  SELECT topic,
         {AVG_E4.format(c='sentiment_e4')} AS avg_sentiment,
         {STD_E4.format(c='sentiment_e4')} AS std_sentiment,
         count(*) AS total_posts,
         count(*) FILTER (WHERE sentiment_label = 'very_negative') AS very_negative_count,
         count(*) FILTER (WHERE sentiment_label = 'negative') AS negative_count,
         count(*) FILTER (WHERE sentiment_label = 'neutral') AS neutral_count,
         count(*) FILTER (WHERE sentiment_label = 'positive') AS positive_count,
         count(*) FILTER (WHERE sentiment_label = 'very_positive') AS very_positive_count
  FROM scored GROUP BY topic),
topic_aggs AS (
  SELECT *, CAST(very_positive_count + positive_count AS DOUBLE) / CAST(total_posts AS DOUBLE) * 100 AS positive_pct,
            CAST(very_negative_count + negative_count AS DOUBLE) / CAST(total_posts AS DOUBLE) * 100 AS negative_pct,
            CAST(neutral_count AS DOUBLE) / CAST(total_posts AS DOUBLE) * 100 AS neutral_pct
  FROM topic_agg)
"""

HOURLY = f"""
hourly AS (
  SELECT topic, strftime(processed_at, '%Y-%m-%d %H:00:00') AS hour,
         {AVG_E4.format(c='sentiment_e4')} AS avg_sentiment,
         count(*) AS post_count,
         {MEAN.format(c='score')} AS avg_reddit_score
  FROM scored GROUP BY 1, 2)
"""

ZSCORES = """
zs0 AS (
  SELECT *, avg(avg_sentiment) OVER w AS ra, stddev_samp(avg_sentiment) OVER w AS rs
  FROM hourly WINDOW w AS (PARTITION BY topic ORDER BY hour ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)),
zs1 AS (
  SELECT *, (avg_sentiment - ra) / (CASE WHEN rs > 0 THEN rs ELSE 1.0 END) AS z FROM zs0),
zscores AS (
  SELECT topic, hour, avg_sentiment, post_count, avg_reddit_score,
         round(ra, 6) + 0.0 AS rolling_avg, round(rs, 6) + 0.0 AS rolling_std,
         round(z, 6) + 0.0 AS z_score, coalesce(abs(z) > 2.0, false) AS is_anomaly
  FROM zs1)
"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"
