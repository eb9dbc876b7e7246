"""Message-bus records (A1-A3, H5): read, decode, encode.

A bus record is ``(key BINARY, value BINARY, timestamp TIMESTAMP)``; the value is a
JSON document. Decoding is ``from_json`` with a declared schema (PERMISSIVE: a
record that is not JSON decodes to nulls and is routed to the rejected side).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import BUS, POST

DEFAULT_BUS_OPTIONS = {
    "startingOffsets": "earliest",
    "failOnDataLoss": "false",
}


def read_bus(spark: SparkSession, servers: str | None = None, topic: str | None = None,
             path: str | None = None, options: dict | None = None, max_files_per_trigger: int | None = None) -> DataFrame:
    """A1: streaming bus source. With ``servers``/``topic`` it is the Kafka source
    (earliest offsets, no failure on data loss; a rate limit, ``maxOffsetsPerTrigger``,
    is an option); with
    ``path`` it reads bus-shaped parquet files, ``max_files_per_trigger`` at a time if given
    (the same record shape, for environments without the Kafka connector)."""
    if servers and topic:
        r = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
        for k, v in {**DEFAULT_BUS_OPTIONS, **(options or {})}.items():
            r = r.option(k, v)
        return r.load().select("key", "value", "timestamp")
    if path is None:
        raise ValueError("read_bus needs servers+topic or a path")
    r = spark.readStream.schema(BUS)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(path)


def decode_posts(bus: DataFrame, schema=POST, required: tuple = ("post_id", "topic")) -> DataFrame:
    """A2: key/value to strings, JSON to typed columns, bus timestamp kept; adds
    ``valid`` (all ``required`` fields present). Use ``split_decoded`` for two tables."""
    d = bus.select(F.col("key").cast("string").alias("kafka_key"),
                   F.from_json(F.col("value").cast("string"), schema).alias("d"),
                   F.col("timestamp").alias("kafka_timestamp")).select("kafka_key", "d.*", "kafka_timestamp")
    ok = None
    for c in required:
        cond = F.col(c).isNotNull()
        ok = cond if ok is None else ok & cond
    return d.withColumn("valid", F.coalesce(ok, F.lit(False)))


def split_decoded(decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    return decoded.where("valid").drop("valid"), decoded.where("NOT valid").drop("valid")


def encode_records(df: DataFrame, key_cols: list[str], ts_col: str | None = None) -> DataFrame:
    """A3/H5: key = ``k1:k2``, value = the whole row as JSON (timestamps as ISO text)."""
    key = F.concat_ws(":", *[F.col(c).cast("string") for c in key_cols])
    out = df.select(key.cast("binary").alias("key"),
                    F.to_json(F.struct(*[F.col(c) for c in df.columns])).cast("binary").alias("value"),
                    (F.col(ts_col) if ts_col else F.current_timestamp()).alias("timestamp"))
    return out


def encode_posts(posts: DataFrame) -> DataFrame:
    return encode_records(posts, ["topic", "post_id"], "processed_at" if "processed_at" in posts.columns else None)


def encode_results(scored: DataFrame) -> DataFrame:
    """H5: scored results on the results topic, keyed ``topic:post_id``."""
    return encode_records(scored, ["topic", "post_id"], "processed_at")


def encode_alerts(alerts: DataFrame) -> DataFrame:
    """H5: alerts on the alerts topic, keyed by topic."""
    return encode_records(alerts, ["topic"], "timestamp")


def write_bus(df: DataFrame, servers: str, topic: str) -> None:
    """Batch write of encoded records to Kafka (needs the Kafka connector at runtime)."""
    df.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()
