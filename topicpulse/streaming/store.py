"""Tables that are replaced piece by piece without a moment in which they are broken.

Files are never overwritten. A change writes new folders first and a small manifest, which
names every live folder, last; readers resolve the newest complete manifest and read only
the folders it names. So a job that dies at any step leaves the last state readable, and what
it had written is garbage for the next ``vacuum``.

A manifest is one JSON file with the next free number, created exclusively: of two writers that
start from the same state the second fails instead of hiding the first one's work. A manifest
that broke off is no JSON and is passed over. Folders and manifests that the last ``keep``
manifests don't name are deleted by the writer when it changes the table next, so readers that
resolved a manifest a moment ago still find its files.

``SegmentStore`` is a table that grows by micro-batches: a segment (folder) for each, and where
``fanout`` segments of one level exist they are rewritten into one of the next. So the number of folders
grows with the logarithm of the number of batches, each row is rewritten that many times, and each file has a size worth
opening. ``ViewStore`` keeps the newest version of several views by key, published together.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


class Files:
    """The few operations on the shared file system that Spark's readers and writers don't offer."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark._jvm
        self.root = root.rstrip("/")
        self.fs = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(os.path.join(self.root, name) if name else self.root)

    def names(self, folder: str) -> list[str]:
        at = self.path(folder)
        if not self.fs.exists(at):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at))

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def read(self, name: str) -> bytes:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def create(self, name: str, data: bytes) -> None:
        """Write a new file; a file that is there already is an error."""
        stream = self.fs.create(self.path(name), False)
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()


class Conflict(RuntimeError):
    """Another writer changed the table since its state was read."""


class Manifests:
    """Numbered manifests below ``root``; ``folders(content)`` lists the folders that a manifest names."""

    def __init__(self, spark: SparkSession, root: str, folders: Callable[[dict], set[str]], keep: int = 8):
        self.spark, self.root, self.keep, self.folders = spark, root.rstrip("/"), keep, folders
        self.files = Files(spark, root)
        self.known: dict[int, dict] = {}        # complete manifests never change; the last few stay here

    def numbers(self) -> list[int]:
        return [int(n[:-5]) for n in self.files.names("_manifests") if n.endswith(".json") and n[:-5].isdigit()]

    def load(self, number: int) -> dict | None:
        if number not in self.known:
            try:
                self.known[number] = json.loads(self.files.read(f"_manifests/{number:012d}.json"))
            except (ValueError, Py4JJavaError):        # broken off, or deleted since it was listed
                return None
            for old in sorted(self.known)[:-4 * self.keep]:
                del self.known[old]
        return self.known[number]

    def newest(self) -> tuple[int, dict]:
        """Number and content of the newest complete manifest; (0, {}) of a table that isn't there yet."""
        for number in reversed(self.numbers()):
            content = self.load(number)
            if content is not None:
                return number, content
        return 0, {}

    def commit(self, content: dict, after: int) -> None:
        """Make ``content`` the table's state if ``after`` is still the newest complete manifest."""
        numbers = self.numbers()
        if self.newest()[0] != after:
            raise Conflict(f"{self.root}: the table changed since manifest {after} was read")
        number = max(numbers, default=0) + 1
        try:
            self.files.create(f"_manifests/{number:012d}.json", json.dumps(content).encode())
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception):
                raise Conflict(f"{self.root}: manifest {number} was written by another writer") from e
            raise

    def new_folder(self, name: str) -> str:
        return f"data/{name}-{uuid.uuid4().hex}"

    def vacuum(self) -> None:
        """Delete what the last ``keep`` complete manifests don't name. Only the table's one writer may call it."""
        numbers = self.numbers()
        known = [(n, c) for n in numbers[-4 * self.keep:] if (c := self.load(n)) is not None][-self.keep:]
        live = {f.split("/", 1)[1] for _, c in known for f in self.folders(c)}
        for folder in self.files.names("data"):
            if folder not in live:
                self.files.delete(f"data/{folder}")
        oldest = known[0][0] if known else 0
        for n in numbers:
            if n < oldest:
                self.files.delete(f"_manifests/{n:012d}.json")


def joined(ranges: list[list[int]]) -> list[list[int]]:
    """The same whole numbers as disjoint ranges [first, last] in order."""
    out: list[list[int]] = []
    for a, b in sorted(map(list, ranges)):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


class SegmentStore:
    """Rows of micro-batches in few folders.

    ``schema`` is that of all rows; ``by`` the columns by which a segment's files are laid out and sorted, so
    that a filter on them skips files and row groups; ``merge`` what becomes of the rows of segments
    that are rewritten into one (nothing by default).
    """

    def __init__(self, spark: SparkSession, root: str, schema: str, by: list[str],
                 merge: Callable[[DataFrame], DataFrame] | None = None, fanout: int = 8, keep: int = 8):
        if fanout < 2:
            raise ValueError("fanout must be at least 2")
        self.spark, self.root, self.schema, self.by = spark, root.rstrip("/"), schema, by
        self.merge, self.fanout = merge or (lambda df: df), fanout
        self.manifests = Manifests(spark, root, lambda c: {s["folder"] for s in c.get("segments", [])}, keep)

    def segments(self) -> list[dict]:
        return self.manifests.newest()[1].get("segments", [])

    def read(self, skip_batch: int | None = None) -> DataFrame:
        """All rows; without the segment of its own that ``skip_batch`` has, if it has one."""
        return self._rows([s for s in self.segments() if skip_batch is None or s["level"] > 0
                           or s["batches"] != [[skip_batch, skip_batch]]])

    def _rows(self, segments: list[dict]) -> DataFrame:
        if not segments:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.root}/{s['folder']}" for s in segments])

    def _write(self, df: DataFrame, name: str) -> str:
        folder = self.manifests.new_folder(name)
        columns = [f.name for f in self.spark.createDataFrame([], self.schema).schema]
        # files of the size that adaptive execution aims at, however few or many rows there are
        df.select(columns).hint("rebalance", *self.by).sortWithinPartitions(*self.by).write.parquet(f"{self.root}/{folder}")
        return folder

    def append(self, df: DataFrame, batch_id: int) -> bool:
        """Store the rows of a micro-batch, then compact. A replay replaces the batch's rows.

        A batch that has been rewritten into a larger segment is final (a stream replays no batch but its last one, which
        gives the same rows again): nothing is written, and False returned.
        """
        self.manifests.vacuum()
        number, content = self.manifests.newest()
        segments = content.get("segments", [])
        if any(a <= batch_id <= b for s in segments if s["level"] for a, b in s["batches"]):
            return False
        own = [[batch_id, batch_id]]
        folder = self._write(df, f"batch{batch_id}")
        rest = [s for s in segments if s["batches"] != own]
        self.manifests.commit({"segments": rest + [{"folder": folder, "level": 0, "batches": own}]}, number)
        self.compact(keep_batch=batch_id)
        return True

    def compact(self, keep_batch: int | None = None) -> None:
        """Rewrite the segments of a level into one while there are ``fanout`` of them (but for the newest batch's,
        which may be replayed)."""
        while True:
            number, content = self.manifests.newest()
            segments = content.get("segments", [])
            levels = [s["level"] for s in segments if s["batches"] != [[keep_batch, keep_batch]] or s["level"]]
            full = [n for n in sorted(set(levels)) if levels.count(n) >= self.fanout]
            if not full:
                return
            old = [s for s in segments if s["level"] == full[0]
                   and (s["level"] or s["batches"] != [[keep_batch, keep_batch]])]
            folder = self._write(self.merge(self._rows(old)), f"level{full[0] + 1}")
            batches = joined([r for s in old for r in s["batches"]])
            self.manifests.commit({"segments": [s for s in segments if s not in old] + [
                {"folder": folder, "level": full[0] + 1, "batches": batches}]}, number)


class ViewStore:
    """The newest version of views by (view, key), published together: readers see all of a publication or nothing of it."""

    def __init__(self, spark: SparkSession, root: str, keep: int = 8):
        self.spark, self.root = spark, root.rstrip("/")
        self.manifests = Manifests(spark, root, lambda c: {f for v in c.get("views", {}).values() for f in v.values()}, keep)

    def stage(self, df: DataFrame, view: str, key: str) -> str:
        """Write a version that nobody reads yet; returns its folder."""
        folder = self.manifests.new_folder(f"{view}-{key}")
        df.write.parquet(f"{self.root}/{folder}")
        return folder

    def staged(self, folder: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{folder}")

    def keys(self, view: str) -> list[str]:
        return sorted(self.manifests.newest()[1].get("views", {}).get(view, {}))

    def publish(self, folders: dict[str, str], key: str, after: int, forget: dict[str, list[str]] | None = None) -> None:
        """Make the staged folders (view -> folder) the versions of ``key``, in place of those in manifest ``after``;
        the keys to ``forget`` (view -> keys) go at the same moment."""
        number, content = self.manifests.newest()
        if number != after:
            raise Conflict(f"{self.root}: the views changed since manifest {after} was read")
        views = {v: dict(k) for v, k in content.get("views", {}).items()}
        for view, folder in folders.items():
            views.setdefault(view, {})[key] = folder
        for view, keys in (forget or {}).items():
            for old in keys:
                views.get(view, {}).pop(old, None)
        self.manifests.commit({"views": views}, after)
        self.manifests.vacuum()

    def read(self, view: str, key: str | None = None) -> DataFrame | None:
        """The rows of a view, of one key or of all; None if nothing was published."""
        folders = self.manifests.newest()[1].get("views", {}).get(view, {})
        chosen = [f for k, f in sorted(folders.items()) if key is None or k == key]
        return self.spark.read.option("mergeSchema", "true").parquet(*[f"{self.root}/{f}" for f in chosen]) if chosen else None
