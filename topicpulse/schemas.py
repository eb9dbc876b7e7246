"""Declared schemas (no inference on the hot path)."""

from pyspark.sql import types as T

POST = T.StructType([
    T.StructField("post_id", T.StringType()),
    T.StructField("topic", T.StringType()),
    T.StructField("subreddit", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("score", T.IntegerType()),
    T.StructField("num_comments", T.IntegerType()),
    T.StructField("url", T.StringType()),
    T.StructField("created_utc", T.DoubleType()),
    T.StructField("scraped_at", T.StringType()),
    T.StructField("is_comment", T.BooleanType()),
    T.StructField("parent_id", T.StringType()),
])

BUS = T.StructType([
    T.StructField("key", T.BinaryType()),
    T.StructField("value", T.BinaryType()),
    T.StructField("timestamp", T.TimestampType()),
])

ENTITY = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("entity_type", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
])

# columns of a scored post, in output order
SCORED_COLUMNS = [
    "post_id", "topic", "subreddit", "title", "content", "author", "score", "num_comments",
    "created_utc", "is_comment", "sentiment_e4", "sentiment_score", "sentiment_label",
    "confidence", "cleaned_text", "keywords", "entities", "processed_at",
]

ALERT_COLUMNS = [
    "alert_id", "topic", "alert_type", "message", "severity", "sentiment_value", "threshold",
    "post_id", "post_count", "timestamp", "acknowledged", "acknowledged_at",
]
