"""Sinks and the stores behind them (A6-A11), as parquet tables.

Stores are append/overwrite tables partitioned by a batch or period key, so each
write is idempotent: replaying a micro-batch rewrites exactly its own partition. The id index (A7)
and the batch views (A8) are kept by ``store``: new folders, named by a manifest that is written last.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import SegmentStore, ViewStore

DEFAULT_TTL_SECONDS = 300
DEFAULT_HISTORY = 1001
ID_BUCKETS = 1024


def id_bucket(key: str = "post_id", buckets: int = ID_BUCKETS):
    """Hash bucket of an id: the result store is partitioned by it, so a lookup of a
    batch's ids reads only the buckets those ids fall in."""
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


# ------------------------------------------------------------- read-side helpers
def realtime_snapshot(history_df: DataFrame, as_of, ttl_seconds: int = DEFAULT_TTL_SECONDS) -> DataFrame:
    """The latest snapshot per topic, absent when older than the TTL.

    ``max_by`` is an aggregate (partial per task, then merged), so a topic with a
    huge history is reduced map-side rather than sorted in one task."""
    cutoff = F.lit(as_of).cast("timestamp") - F.make_interval(secs=F.lit(ttl_seconds))
    fresh = history_df.where(F.col("updated_at") > cutoff)
    if "dt" in history_df.columns:  # day-partitioned store: prune to the days the TTL reaches
        fresh = fresh.where(F.col("dt") >= F.to_date(cutoff))
    # the greatest (time, batch, count, average): of snapshots with one time always the same one
    order = [c for c in ("updated_at", "batch_id", "count", "avg_sentiment") if c in history_df.columns]
    latest = fresh.groupBy("topic").agg(F.max(F.struct(*order)).alias("s"))
    return latest.select("topic", "s.avg_sentiment", "s.count", "s.updated_at")


def history(history_df: DataFrame, limit: int = 100, keep: int = DEFAULT_HISTORY,
            max_limit: int = 1000) -> DataFrame:
    """Newest snapshots per topic: the store keeps ``keep`` (1001), a read returns
    ``limit`` (more than ``max_limit`` is an error). ``row_number() <= k`` plans as a WindowGroupLimit, which
    trims each topic to k rows before the shuffle."""
    if limit > max_limit:
        raise ValueError(f"limit must be at most {max_limit}")
    k = min(int(limit), int(keep))
    # of equal times the larger batch, then count and average come first: any two rows that differ have an order
    more = [F.desc(c) for c in ("batch_id", "count", "avg_sentiment") if c in history_df.columns]
    w = Window.partitionBy("topic").orderBy(F.desc("updated_at"), *more)
    return history_df.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)


def latest_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Keep the first row per key by ``order`` (deterministic: callers end ``order``
    with a unique column)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def upsert_latest(existing: DataFrame, incoming: DataFrame, keys: list[str],
                  version_col: str = "created_at") -> DataFrame:
    """Upsert on ``keys``: the row with the newest ``version_col`` wins, of equal ones the incoming."""
    both = existing.withColumn("_in", F.lit(0)).unionByName(incoming.withColumn("_in", F.lit(1)),
                                                            allowMissingColumns=True)
    return latest_per_key(both, keys, [F.desc(version_col), F.desc("_in")]).drop("_in")


def insert_new_only(stored: DataFrame, batch_df: DataFrame, batch_id: int, key: str = "post_id",
                    order: list | None = None, buckets: int = ID_BUCKETS) -> DataFrame:
    """Rows of micro-batch ``batch_id`` to insert: duplicates inside the batch dropped
    (first by ``order`` wins), ids already stored by *other* batches dropped. Stored rows
    of the same batch id are ignored, so a replay recomputes the same partition.

    When the store is sorted or partitioned by ``id_bucket`` only the buckets of this batch's ids
    are read: their set has at most ``buckets`` small integers, so it is collected and
    becomes a filter that skips files and row groups of the ever-growing store (unless the batch
    touches so many buckets that there is little to skip)."""
    order = order or [F.col("processed_at"), F.col(key)]
    dedup = latest_per_key(batch_df, [key], order).withColumn("id_bucket", id_bucket(key, buckets))
    others = stored.where(F.col("batch_id") != batch_id)
    if "id_bucket" in stored.columns:
        touched = [r[0] for r in dedup.select("id_bucket").distinct().collect()]  # <= buckets values
        if len(touched) <= buckets // 8:
            others = others.where(F.col("id_bucket").isin(touched))
        cond = [key, "id_bucket"]
    else:
        cond = [key]
    return (dedup.join(others.select(*cond), cond, "left_anti")
            .withColumn("timestamp", F.col("processed_at"))
            .withColumn("batch_id", F.lit(batch_id).cast("bigint")))


# ------------------------------------------------------------------ write side
def write_batch_partition(df: DataFrame, path: str, batch_id: int, by: list[str] | None = None) -> None:
    """Overwrite exactly this batch's partitions (dynamic partition overwrite): the table
    is partitioned by ``by`` (default: ``dt`` when the frame has it) and then ``batch_id``,
    so a replayed batch rewrites the same directories."""
    if by is None:
        by = ["dt"] if "dt" in df.columns else []
    (df.withColumn("batch_id", F.lit(batch_id).cast("bigint")).write
     .mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*by, "batch_id").parquet(path))


def with_dt(df: DataFrame, ts_col: str) -> DataFrame:
    """Day partition column of a time-stamped table (look-back scans prune on it)."""
    return df.withColumn("dt", F.to_date(F.col(ts_col)))


IDS_SCHEMA = "post_id string, id_bucket int, batch_id bigint"


def id_store(spark: SparkSession, out: str, fanout: int = 8) -> SegmentStore:
    """The ids of all stored results below ``out/ids``: few compacted segments, sorted by id bucket."""
    return SegmentStore(spark, os.path.join(out, "ids"), IDS_SCHEMA, by=["id_bucket", "post_id"], fanout=fanout)


def sink_results(batch_df: DataFrame, batch_id: int, out: str) -> DataFrame:
    """A7 write: this batch's new rows go to ``out/results`` (partitioned by day, then
    batch: look-back scans prune by day) and their ids to the id store (sorted by id
    bucket: the next batches' dedupe skips files and row groups of buckets that they don't touch). Returns
    the inserted rows, persisted; the caller releases them."""
    ids = id_store(batch_df.sparkSession, out)
    new = insert_new_only(ids.read(), batch_df, batch_id).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        write_batch_partition(with_dt(new.drop("id_bucket", "batch_id"), "processed_at"), os.path.join(out, "results"), batch_id)
        ids.append(new, batch_id)
    except BaseException:
        new.unpersist()
        raise
    return new


def batch_key(batch_time) -> str:
    """The key of one batch's version of the views."""
    return re.sub(r"\D", "", str(batch_time))[:14].ljust(14, "0")


def publish_views(views: dict[str, DataFrame], out: str, batch_time,
                  derived: Callable[[dict[str, DataFrame]], dict[str, DataFrame]] | None = None) -> dict[str, DataFrame]:
    """A8 write: topic aggregates are upserted by (topic, period_start) into their batch's version; the
    other views of ``batch_time`` are replaced, also with nothing, so that a re-run leaves no rows of the
    earlier one. ``derived`` makes further views of those that are written but not yet published. All are
    published at once by one manifest: whoever reads meanwhile, or after a crash at any step, has the state before. Returns the published views."""
    spark = next(iter(views.values())).sparkSession
    store, key = ViewStore(spark, out), batch_key(batch_time)
    after = store.manifests.newest()[0]
    ts = F.lit(batch_time).cast("timestamp")

    def stage(some: dict[str, DataFrame]) -> dict[str, str]:
        folders = {}
        for name, df in some.items():
            if name == "topic_aggregates":
                stored = store.read(name, key)
                df = df if stored is None else upsert_latest(stored, df, ["topic", "period_start"])
            else:
                df = df.withColumn("batch_time", ts)
            folders[name] = store.stage(df, name, key)
        return folders

    folders = stage(views)
    if derived is not None:
        folders |= stage(derived({v: store.staged(f) for v, f in folders.items()}))
    store.publish(folders, key, after)
    return {v: store.staged(f) for v, f in folders.items()}


def read_view(spark: SparkSession, out: str, name: str, batch_time=None) -> DataFrame | None:
    """The published rows of a view, of one batch or of all; None if there are none."""
    return ViewStore(spark, out).read(name, None if batch_time is None else batch_key(batch_time))


def sink_parquet(stream_df: DataFrame, path: str, checkpoint: str, trigger_seconds: int = 30,
                 available_now: bool = False):
    """Append parquet partitioned by topic, own checkpoint, 30 s trigger."""
    w = (stream_df.writeStream.format("parquet").outputMode("append").partitionBy("topic")
         .option("path", path).option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=f"{trigger_seconds} seconds")
    return w.start()


def sink_console(stream_df: DataFrame, rows: int = 5, checkpoint: str | None = None):
    """Debug console sink, ``rows`` rows, untruncated."""
    w = stream_df.writeStream.format("console").outputMode("append") \
        .option("truncate", False).option("numRows", rows)
    if checkpoint:
        w = w.option("checkpointLocation", checkpoint)
    return w.start()
