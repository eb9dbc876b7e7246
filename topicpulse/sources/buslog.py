"""A bus in shared files with partitions, offsets and a rate limit (A1, A3), without a broker.

A log is a folder. ``append_log`` writes encoded records as one segment: Parquet files
by partition, ``pmod(xxhash64(key), partitions)``, then one manifest that names the files and
their numbers of rows. Readers see a segment only by its manifest, so one that was broken off
is never read. A record's offset is its place in its partition, counted over the manifests in order.

``BusLog`` is the streaming source over it (``spark.readStream.format("buslog")``): an offset is a
number of records for each partition, kept in the query's checkpoint, so a query that is started
again goes on behind its last batch and reads every record once. Planning reads manifests only; records are
read by the tasks, a range of a file each, row groups outside the range skipped.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

MANIFESTS = "_manifests"
SCHEMA = "partition int, offset bigint, key binary, value binary, timestamp timestamp"
ARROW = pa.schema([("partition", pa.int32()), ("offset", pa.int64()), ("key", pa.binary()), ("value", pa.binary()),
                   ("timestamp", pa.timestamp("us", "UTC"))])
#: Rows of a file of the log at most, so that a task's range is bounded.
FILE_ROWS = 500_000


def _files(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI and the path in it."""
    if ":/" not in path:
        return pafs.LocalFileSystem(), path.rstrip("/")
    return pafs.FileSystem.from_uri(path.rstrip("/").replace("file:/", "file:///", 1) if path[:7] != "file://" and
                                    path.startswith("file:/") else path.rstrip("/"))


def _replace(files: pafs.FileSystem, name: str, data: bytes) -> None:
    """A file with this content at once: written beside its place, then moved there."""
    aside = f"{name}.{uuid.uuid4().hex}.tmp"
    with files.open_output_stream(aside) as out:
        out.write(data)
    files.move(aside, name)


def _manifest_names(files: pafs.FileSystem, root: str) -> list[str]:
    found = files.get_file_info(pafs.FileSelector(f"{root}/{MANIFESTS}", allow_not_found=True))
    return sorted(f.base_name for f in found if f.base_name.endswith(".json"))


def append_log(records: DataFrame, path: str, partitions: int = 8) -> int:
    """A3: append ``(key, value, timestamp)`` records as one segment; returns the segment's number.

    Records with one key stay in one partition, in the order of their timestamps within the segment; a null key is
    a key like any other. Null values are kept. One writer at a time. Only names and row counts of
    the files written come to the driver.
    """
    if partitions < 1:
        raise ValueError("partitions must be at least 1")
    spark, (files, root) = records.sparkSession, _files(path)
    names = _manifest_names(files, root)
    number = int(names[-1].split(".")[0]) + 1 if names else 0
    segment = f"segment-{number:012d}-{uuid.uuid4().hex}"
    kept = records.select(F.pmod(F.xxhash64("key"), F.lit(partitions)).cast("int").alias("partition"),
                          "key", "value", F.col("timestamp").cast("timestamp").alias("timestamp"))
    # timestamps as 64-bit numbers of microseconds, which every Parquet reader gives back alike
    kept.hint("rebalance", "partition").sortWithinPartitions("partition", "timestamp", "key", "value").select(
        "partition", "key", "value", F.unix_micros("timestamp").alias("micros")).write.option(
        "maxRecordsPerFile", FILE_ROWS).partitionBy("partition").parquet(f"{path.rstrip('/')}/{segment}")
    written = spark.read.schema("key binary, value binary, micros bigint, partition int").parquet(f"{path.rstrip('/')}/{segment}")
    sizes = written.groupBy("partition", F.regexp_extract(F.input_file_name(), "[^/]+$", 0).alias("file")).agg(
        F.count(F.lit(1)).alias("rows")).collect()
    entries = sorted([r["partition"], f"{segment}/partition={r['partition']}/{r['file']}", r["rows"]] for r in sizes)
    files.create_dir(f"{root}/{MANIFESTS}", recursive=True)
    _replace(files, f"{root}/{MANIFESTS}/{number:012d}.json", json.dumps(entries).encode())
    return number


def share_of(backlog: dict[str, int], limit: int) -> dict[str, int]:
    """``limit`` records (or all, if fewer wait) dealt to the partitions in proportion to what waits in each."""
    total = sum(backlog.values())
    limit = min(limit, total)
    taken, before = {}, 0
    for p in sorted(backlog, key=int):
        after = before + backlog[p]
        taken[p] = after * limit // total - before * limit // total if total else 0
        before = after
    return taken


class Range(InputPartition):
    """Rows ``first`` to before ``end`` of a file, the first of them with this offset."""

    def __init__(self, partition: int, file: str, first: int, end: int, offset: int):
        super().__init__((partition, file, first, end, offset))


class BusLogReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        if "path" not in options:
            raise ValueError("the bus log needs a path")
        self.path = options["path"]
        self.limit = int(options["maxOffsetsPerTrigger"]) if "maxOffsetsPerTrigger" in options else None
        self.progress = options.get("progress")
        if self.limit is not None and (self.limit < 1 or not self.progress):
            raise ValueError("maxOffsetsPerTrigger must be at least 1 and needs progress, the path of a file of the query's own")
        self.loaded: list[str] = []
        self.log: dict[str, list] = {}      # partition -> [first offset, rows, file], in order

    def ends(self) -> dict[str, int]:
        """Number of records by partition; manifests that were read before aren't read again."""
        files, root = _files(self.path)
        for name in _manifest_names(files, root)[len(self.loaded):]:
            with files.open_input_stream(f"{root}/{MANIFESTS}/{name}") as f:
                entries = json.loads(f.read())
            for p, file, rows in entries:
                own = self.log.setdefault(str(p), [])
                own.append((own[-1][0] + own[-1][1] if own else 0, rows, file))
            self.loaded.append(name)
        return {p: own[-1][0] + own[-1][1] for p, own in self.log.items()}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """All there is, or as far behind what was offered last as the rate limit allows.

        Spark asks without telling where it stands, so what was offered last is kept in the progress file. It is
        never behind the query's checkpoint; if a crash comes before Spark has noted an offer, the next batch has the
        records of two.
        """
        ends = self.ends()
        if self.limit is None:
            return ends
        files, name = _files(self.progress)
        offered = {}
        if files.get_file_info(name).type == pafs.FileType.File:
            with files.open_input_stream(name) as f:
                offered = json.loads(f.read())
        more = share_of({p: n - offered.get(p, 0) for p, n in ends.items()}, self.limit)
        offer = {p: offered.get(p, 0) + more[p] for p in ends}
        if offer != offered:
            _replace(files, name, json.dumps(offer).encode())
        return offer

    def partitions(self, start: dict, end: dict) -> list[Range]:
        self.ends()
        out = []
        for p, last in sorted(end.items(), key=lambda x: int(x[0])):
            first = start.get(p, 0)
            for offset, rows, file in self.log.get(p, []):
                a, b = max(first, offset), min(last, offset + rows)
                if a < b:
                    out.append(Range(int(p), file, a - offset, b - offset, a))
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        number, file, first, end, offset = partition.value
        files, root = _files(self.path)
        with files.open_input_file(f"{root}/{file}") as source:
            parquet, at = pq.ParquetFile(source), 0
            for group in range(parquet.num_row_groups):
                rows = parquet.metadata.row_group(group).num_rows
                if at + rows > first and at < end:
                    here = at
                    for batch in parquet.iter_batches(10_000, row_groups=[group], columns=["key", "value", "micros"]):
                        a, b = max(first - here, 0), min(end - here, batch.num_rows)
                        here += batch.num_rows
                        if a < b:
                            some = batch.slice(a, b - a)
                            yield pa.RecordBatch.from_arrays(
                                [pa.array([number] * len(some), pa.int32()),
                                 pa.array(range(offset, offset + len(some)), pa.int64()),
                                 some.column(0), some.column(1),
                                 some.column(2).cast(pa.timestamp("us")).cast(pa.timestamp("us", "UTC"))], schema=ARROW)
                            offset += len(some)
                at += rows


class BusLog(DataSource):
    """``spark.readStream.format("buslog")``, options ``path``, ``maxOffsetsPerTrigger`` with ``progress``."""

    @classmethod
    def name(cls) -> str:
        return "buslog"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> BusLogReader:
        return BusLogReader(self.options)        # names of options in any case


def read_log(spark: SparkSession, path: str, max_offsets_per_trigger: int | None = None,
             progress: str | None = None) -> DataFrame:
    """A1: the log as a stream of (partition, offset, key, value, timestamp).

    With a limit a batch has at most ``max_offsets_per_trigger`` records, dealt to the partitions by what waits
    in each; ``progress`` is a file of the query's own beside its checkpoint. An ``availableNow`` trigger asks for
    offsets once: with a limit it does one batch, so use a processing time there.
    """
    spark.dataSource.register(BusLog)
    r = spark.readStream.format("buslog").option("path", path)
    if max_offsets_per_trigger is not None:
        r = r.option("maxOffsetsPerTrigger", max_offsets_per_trigger).option("progress", progress or "")
    return r.load()


def scan_log(spark: SparkSession, path: str) -> DataFrame:
    """The log as a table, by Spark's own Parquet reader: (partition, key, value, timestamp) of all published segments."""
    files, root = _files(path)
    folders = set()
    for name in _manifest_names(files, root):
        with files.open_input_stream(f"{root}/{MANIFESTS}/{name}") as f:
            folders |= {file.split("/")[0] for _, file, _ in json.loads(f.read())}
    kind = "key binary, value binary, micros bigint, partition int"
    parts = [spark.read.schema(kind).parquet(f"{path.rstrip('/')}/{x}") for x in sorted(folders)]
    rows = parts[0] if parts else spark.createDataFrame([], kind)
    for other in parts[1:]:
        rows = rows.unionByName(other)
    return rows.select("partition", "key", "value", F.timestamp_micros("micros").alias("timestamp"))
