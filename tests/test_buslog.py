"""The file bus with offsets: rate limit, restart from a checkpoint, broken-off segments."""

import json
import os
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from topicpulse.sources.bus import decode_posts, encode_posts
from topicpulse.sources.buslog import BusLogReader, append_log, read_log, scan_log, share_of
from topicpulse.sources.tables import AS_OF
from topicpulse.sources.testdata import posts_from_documents


def records(spark):
    return encode_posts(posts_from_documents(spark, SF_SMALL)).withColumn("timestamp", F.lit(AS_OF).cast("timestamp"))


def run(spark, source, out, checkpoint, until=None):
    """Read the stream into files: all there is, or until as many records are offered and done."""
    w = source.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    q = (w.trigger(processingTime="0 seconds") if until else w.trigger(availableNow=True)).start()
    try:
        end = time.time() + 60
        while until and q.isActive and time.time() < end and done(checkpoint) < until:
            time.sleep(.2)
        if not until:
            q.awaitTermination(60)
    finally:
        q.stop()
    assert q.exception() is None
    return spark.read.parquet(out)


def done(checkpoint):
    """Records up to the offsets of the last batch that was committed."""
    folder = f"{checkpoint}/commits"
    batches = [int(n) for n in os.listdir(folder) if n.isdigit()] if os.path.isdir(folder) else []
    if not batches:
        return 0
    with open(f"{checkpoint}/offsets/{max(batches)}") as f:
        return sum(json.loads(f.read().splitlines()[-1]).values())


def test_limit_is_dealt_by_backlog():
    assert share_of({"0": 6, "1": 3, "2": 0}, 3) == {"0": 2, "1": 1, "2": 0}
    assert share_of({"0": 6, "1": 3}, 100) == {"0": 6, "1": 3}
    assert share_of({}, 5) == {} and share_of({"0": 0}, 5) == {"0": 0}
    for limit in range(1, 30):
        got = share_of({"0": 7, "1": 1, "2": 13}, limit)
        assert sum(got.values()) == min(limit, 21) and all(0 <= got[p] <= n for p, n in {"0": 7, "1": 1, "2": 13}.items())


def test_every_record_once_after_a_restart(spark, tmpdir_path):
    log, out, ckpt = f"{tmpdir_path}/log", f"{tmpdir_path}/out", f"{tmpdir_path}/ckpt"
    sent = records(spark)
    n = sent.count()
    assert append_log(sent, log, 3) == 0
    first = run(spark, read_log(spark, log), out, ckpt)
    assert first.count() == n
    assert append_log(sent.limit(0), log, 3) == 1           # an empty segment moves nothing
    extra = spark.createDataFrame([(None, None), (bytearray(b"k"), None), (bytearray(b"k"), bytearray(b"v"))],
                                  "key binary, value binary").withColumn("timestamp", F.lit(AS_OF).cast("timestamp"))
    assert append_log(extra, log, 3) == 2
    got = run(spark, read_log(spark, log), out, ckpt)
    assert got.count() == n + 3
    per = got.groupBy("partition").agg(F.count("*").alias("n"), F.countDistinct("offset").alias("d"),
                                       F.min("offset").alias("a"), F.max("offset").alias("b")).collect()
    assert all(r.n == r.d == r.b + 1 and r.a == 0 for r in per)          # offsets without gap or repetition
    assert got.select("key", "value", "timestamp").exceptAll(sent.unionByName(extra)).count() == 0
    assert scan_log(spark, log).select("key", "value", "timestamp").exceptAll(got.select("key", "value", "timestamp")).count() == 0
    keys = got.groupBy("key").agg(F.countDistinct("partition").alias("p"))
    assert keys.where("p > 1").count() == 0
    posts = decode_posts(got).where("valid")
    assert posts.count() == n


def test_rate_limit_holds_over_restarts(spark, tmpdir_path):
    log, out, ckpt, mark = (f"{tmpdir_path}/{x}" for x in ("log", "out", "ckpt", "offered.json"))
    n = append_log(records(spark), log, 4) or records(spark).count()
    limit = n // 5 + 1
    source = lambda: read_log(spark, log, limit, mark).withColumn("read_at", F.current_timestamp())     # noqa: E731
    run(spark, source(), out, ckpt, until=1)
    got = run(spark, source(), out, ckpt, until=n)          # goes on where it stopped
    assert got.count() == n and got.select("partition", "offset").distinct().count() == n
    batches = Counter(r.read_at for r in got.select("read_at").collect())
    assert len(batches) >= 4
    assert sum(size > limit for size in batches.values()) <= 1      # one offer may be lost at the stop
    with pytest.raises(ValueError):
        BusLogReader({"path": log, "maxOffsetsPerTrigger": "5"})


def test_a_segment_without_a_manifest_is_not_read(spark, tmpdir_path):
    log = f"{tmpdir_path}/log"
    append_log(records(spark), log, 2)
    before = BusLogReader({"path": log})
    ends = before.latestOffset()
    scan_log(spark, log).limit(5).write.parquet(f"{log}/segment-000000000001-broken")
    assert BusLogReader({"path": log}).latestOffset() == ends
    append_log(records(spark), log, 2)
    assert {p: 2 * e for p, e in ends.items()} == before.latestOffset()
    ranges = before.partitions(ends, before.latestOffset())
    assert sum(r.value[3] - r.value[2] for r in ranges) == sum(ends.values()) and before.partitions(ends, ends) == []
    half = {p: e // 2 for p, e in ends.items()}
    rows = [x for r in before.partitions(half, ends) for b in before.read(r) for x in b.column(1).to_pylist()]
    assert len(rows) == sum(ends.values()) - sum(half.values())
    assert BusLogReader({"path": f"{tmpdir_path}/none"}).latestOffset() == {}
