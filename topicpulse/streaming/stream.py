"""The streaming job.

One query: bus -> decode (stateless, in the stream plan; ``processed_at`` stamped
there, once) -> ``foreachBatch``. Inside, the micro-batch is persisted once and fed
to the same batch operators the hourly job uses: per-post scoring, the result
store (A7: results by day, ids in a compacted store), the per-topic snapshot/history store
(D5 -> A9/A10), post alerts (F1), the partial states of D1-D3,
the keyword summaries of D4/H2 and the rejected records. Every target is written to
its ``batch_id=N`` partitions (under a day partition) with dynamic overwrite, or as the batch's own segment of a
store, so a replayed batch (after a failure between the write and
the checkpoint commit) rewrites the same rows instead of duplicating them.
Errors propagate, so a failed batch is not committed (decision D-10).
"""

from __future__ import annotations

import os

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.aggregates import microbatch_stats
from ..operators.alerts import post_alerts
from ..operators.anomaly import carry_zscores
from ..operators.heavy import keyword_summary, summary_store
from ..operators.ingest import dedupe
from ..operators.partials import partial_states, state_store
from ..plans.scoring import score_posts
from ..session import checkpoint_path
from ..sources.bus import decode_posts
from ..sources.tables import as_timestamp
from .sinks import sink_results, with_dt, write_batch_partition
from .store import ViewStore


def decoded_stream(bus: DataFrame) -> DataFrame:
    """Decode + stamp: ``processed_at`` is the micro-batch time (D-11)."""
    return decode_posts(bus).withColumn("processed_at", F.current_timestamp())


def process_batch(batch_df: DataFrame, batch_id: int, out: str, lexicon: DataFrame, stopwords: DataFrame,
                  entity_stopwords: list[str] | None = None) -> None:
    """One micro-batch: score once, write every target for ``batch_id`` idempotently."""
    batch_df = batch_df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        # B6 inside the batch: the first record of an id (by bus time) is scored
        valid = dedupe(batch_df.where("valid").drop("valid"), "post_id", [F.col("kafka_timestamp")])
        rejected = batch_df.where("NOT valid").drop("valid")
        write_batch_partition(rejected, os.path.join(out, "rejected"), batch_id, by=[])
        scored = score_posts(valid, lexicon, stopwords, entity_stopwords).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            new = sink_results(scored, batch_id, out)
            try:
                # snapshots, partial states and alerts of the inserted posts only: they agree with the stored
                # results, and a post that comes again counts and alerts once
                batch_time = new.agg(F.max("processed_at")).first()[0]  # one row: the batch stamp
                if batch_time is not None:
                    write_batch_partition(with_dt(microbatch_stats(new, batch_time), "updated_at"),
                                          os.path.join(out, "history"), batch_id)
                write_batch_partition(with_dt(post_alerts(new), "timestamp"), os.path.join(out, "alerts"), batch_id)
                state_store(batch_df.sparkSession, os.path.join(out, "partials")).append(partial_states(new), batch_id)
                summary_store(batch_df.sparkSession, os.path.join(out, "keywords")).append(keyword_summary(new), batch_id)
            finally:
                new.unpersist()
        finally:
            scored.unpersist()
    finally:
        batch_df.unpersist()


def anomaly_step(hours: DataFrame, batch_id: int, out: str, preceding: int = 6) -> DataFrame:
    """E1 in the stream: z-scores of a micro-batch's closed ``hours``, from the points carried since the last batch.

    The carried points (``preceding`` for each topic) and the z-scores are published together, by batch. A
    replayed batch starts from the state before it and gives the same rows; older states than that are let go.
    Returns the batch's published z-scores.
    """
    store = ViewStore(hours.sparkSession, os.path.join(out, "anomalies"))
    after = store.manifests.newest()[0]
    key = f"{batch_id:012d}"
    before = [k for k in store.keys("carried") if k < key]
    carried = store.read("carried", before[-1]) if before else hours.limit(0)
    scored, keep = carry_zscores(carried, hours, preceding)
    folders = {"zscores": store.stage(scored, "zscores", key), "carried": store.stage(keep, "carried", key)}
    store.publish(folders, key, after, {"carried": before[:-1]})
    return store.staged(folders["zscores"])


def split_late(df: DataFrame, closed_until, ts_col: str = "processed_at") -> tuple[DataFrame, DataFrame]:
    """I5's side output: (rows on time, rows of windows that closed before ``closed_until``). A row without a time is on time."""
    late = F.coalesce(F.col(ts_col) < as_timestamp(closed_until), F.lit(False))
    return df.where(~late), df.where(late)


def run_stream(spark: SparkSession, bus: DataFrame, out: str, lexicon: DataFrame, stopwords: DataFrame,
               entity_stopwords: list[str] | None = None, checkpoint: str | None = None,
               trigger_seconds: int | None = None, available_now: bool = False, name: str = "topicpulse"):
    """Start the streaming job; returns the ``StreamingQuery``."""
    ckpt = checkpoint or checkpoint_path(spark, f"{name}-stream")
    w = decoded_stream(bus).writeStream.queryName(name).option("checkpointLocation", ckpt) \
        .foreachBatch(lambda df, bid: process_batch(df, bid, out, lexicon, stopwords, entity_stopwords))
    if available_now:
        w = w.trigger(availableNow=True)
    elif trigger_seconds:
        w = w.trigger(processingTime=f"{trigger_seconds} seconds")
    return w.start()


def windowed_trends(scored_stream: DataFrame, delay: str = "1 hour", size: str = "1 hour",
                    ts_col: str = "processed_at") -> DataFrame:
    """Streaming form of the hourly trend view: tumbling event-time windows with a
    watermark; rows later than ``delay`` behind the watermark are dropped, and state
    for closed windows is released. Scores are averaged exactly (integer sum)."""
    from ..operators.aggregates import _score_e4, avg_e4, mean
    e4 = _score_e4(scored_stream)
    return (scored_stream.withWatermark(ts_col, delay)
            .groupBy("topic", F.window(F.col(ts_col), size).alias("window"))
            .agg(avg_e4(e4).alias("avg_sentiment"), F.count(F.lit(1)).alias("post_count"),
                 mean(F.col("score")).alias("avg_reddit_score"))
            .select("topic", F.date_format("window.start", "yyyy-MM-dd HH:00:00").alias("hour"),
                    "avg_sentiment", "post_count", "avg_reddit_score"))
