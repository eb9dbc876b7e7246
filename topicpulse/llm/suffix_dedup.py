"""Repeated byte strings by a prefix-free parse, its dictionary's suffix array and the parse's counts.

Every 200-byte string of a text is a member of one phrase: a rolling hash runs
over the text's 50-byte windows, and the phrase of a string is given by the least
hash among its 151 windows. As long as a string's successors have the same least
hash they belong to the same phrase; where it changes (the trigger) the next
phrase begins. A trigger depends on nothing but the bytes around it, so equal
strings are in phrases with the same least hash wherever they stand, and phrases
overlap by 199 bytes, so that each string lies whole in one phrase.

The distinct phrases are the dictionary, the list of phrases of all texts is the
parse, and the parse's count of a phrase is all that is needed of it: a phrase
that occurs twice has all its strings repeated. Only phrases that occur once can
share a part of their strings with other phrases of the same least hash. For such
a group of dictionary phrases the suffix array is built (prefix doubling up to 200
bytes), equal suffixes are neighbours in this order, and the counts of their
phrases add up to the times the string occurs in the corpus.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import id_and_text, utf8, written

LENGTH, GRAM = 200, 50
SPAN = LENGTH - GRAM + 1
#: Bytes hashed at a time. A phrase is cut there, which makes a phrase more but changes no result.
CHUNK = 1 << 20
#: A group with more bytes of dictionary phrases is dealt out by the strings' hashes instead of sorted in one task
#: (sorting takes some 55 bytes of memory for each of them).
HOT = 8 << 20
#: Bytes of phrases sorted at a time, at least one group.
SORTED = 4 << 20
#: Strings of a hot phrase hashed at a time.
STRINGS = 50_000
BASE = 0x9E3779B97F4A7C15


class Roller:
    """Rolling hashes of all windows of a chunk at once, by prefix sums of base powers modulo 2^64."""

    def __init__(self):
        up = np.full(CHUNK + LENGTH + 1, BASE, np.uint64)
        down = np.full(CHUNK + LENGTH + 1, pow(BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        self.up, self.down = np.cumprod(up), np.cumprod(down)

    def hashes(self, data: np.ndarray, width: int) -> np.ndarray:
        n = len(data)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=sums[1:])
        h = (sums[width:] - sums[:-width]) * self.down[:n - width + 1]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))

    def phrases(self, data: bytes) -> Iterator[tuple[np.ndarray, ...]]:
        """For each chunk: least hash, first and last start, and whether the hash is there twice, of its phrases."""
        whole = np.frombuffer(data, np.uint8)
        for at in range(0, len(whole) - LENGTH + 1, CHUNK):
            h = self.hashes(whole[at:at + CHUNK + LENGTH - 1], GRAM)
            starts = len(h) - SPAN + 1
            rows = -(-len(h) // SPAN)
            padded = np.full(rows * SPAN, np.uint64(2 ** 64 - 1))
            padded[:len(h)] = h
            padded = padded.reshape(rows, SPAN)
            left = np.minimum.accumulate(padded, axis=1).ravel()
            right = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
            least = np.minimum(right[:starts], left[SPAN - 1:SPAN - 1 + starts])
            cut = np.flatnonzero(least[1:] != least[:-1]) + 1
            first = np.concatenate([[0], cut])
            last = np.concatenate([cut, [starts]]) - 1
            own = least[first]
            # places of these hashes, and how many of them lie in the phrase
            values, which = np.unique(own, return_inverse=True)
            near = np.minimum(np.searchsorted(values, h), len(values) - 1)
            places = np.flatnonzero(values[near] == h)
            keys = np.sort(near[places] * len(h) + places)
            twice = (np.searchsorted(keys, which * len(h) + last + SPAN - 1, side="right")
                     - np.searchsorted(keys, which * len(h) + first)) > 1
            yield own.view(np.int64), first + at, last + at, twice


def phrase_rows(docs: DataFrame) -> DataFrame:
    """(p, h, k, first, size, twice) of ``docs(k, text)``: least hash, hash of the bytes, row key, place."""
    def run(batches):
        import xxhash
        digest = xxhash.xxh3_64_intdigest
        roller = Roller()
        for batch in batches:
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = utf8(text)
                for p, first, last, twice in roller.phrases(data):
                    h = np.array([digest(data[a:b + LENGTH]) for a, b in zip(first.tolist(), last.tolist())], np.uint64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(p), pa.array(h.view(np.int64)), pa.array(np.full(len(p), k, np.int64)),
                         pa.array(first.astype(np.int64)), pa.array((last - first + 1).astype(np.int64)),
                         pa.array(twice)], names=["p", "h", "k", "first", "size", "twice"])

    def joined(batches):
        """Few large batches instead of one for each text."""
        held, rows = [], 0
        for b in run(batches):
            held.append(b)
            rows += b.num_rows
            if rows >= 20_000:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, rows = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return docs.mapInArrow(joined, "p bigint, h bigint, k bigint, first bigint, size bigint, twice boolean")


def suffix_ranks(data: np.ndarray, width: int) -> np.ndarray:
    """Rank of the string of so many bytes at each place by prefix doubling (places too near the end: -1)."""
    rank, length = data.astype(np.int64), 1
    while length < width:
        step = min(length, width - length)
        pair = rank[:len(rank) - step] * (int(rank.max(initial=0)) + 1) + rank[step:]
        _, rank = np.unique(pair, return_inverse=True)
        length += step
    return rank


def repeated_starts(phrases: list[tuple[bytes, int]]) -> list[np.ndarray]:
    """For phrases (bytes, count) of any groups: for each the starts of its strings that occur twice or more."""
    if not phrases:
        return []
    ranks = suffix_ranks(np.frombuffer(b"".join(d for d, _ in phrases), np.uint8), LENGTH)
    sizes = np.array([len(d) for d, _ in phrases])
    ends = np.cumsum(sizes)
    begins = ends - sizes
    starts = sizes - LENGTH + 1
    shift = np.cumsum(starts) - starts
    at = np.repeat(begins - shift, starts) + np.arange(int(starts.sum()))
    own = ranks[at]
    times = np.bincount(own, weights=np.repeat([n for _, n in phrases], starts))
    again = times[own] > 1
    return [np.flatnonzero(x) for x in np.split(again, np.cumsum(starts)[:-1])]


def ranges(starts: np.ndarray) -> tuple[list[int], list[int]]:
    """Runs of consecutive numbers as their first and last ones."""
    if not len(starts):
        return [], []
    cut = np.flatnonzero(np.diff(starts) > 1)
    return starts[np.concatenate([[0], cut + 1])].tolist(), starts[np.concatenate([cut, [len(starts) - 1]])].tolist()


def sort_groups(batches):
    """Rows (p, n, k, first, data), those of a p together: ranges of repeated starts of phrases that occur once."""
    def done(held):
        found = repeated_starts([(r[4], r[1]) for r in held])
        rows = [(r[2], r[3] + a, r[3] + b) for r, s in zip(held, found) if r[1] == 1 for a, b in zip(*ranges(s))]
        columns = list(zip(*rows)) if rows else [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in columns], names=["k", "a", "b"])

    held: list[tuple] = []
    size = 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and size > SORTED and row[0] != held[-1][0]:
                yield done(held)
                held, size = [], 0
            held.append(row)
            size += len(row[4])
    if held:
        yield done(held)


def repeats(docs: DataFrame) -> DataFrame:
    """(k, a, b) of ``docs(k, text)``: ranges of starts whose string occurs twice or more in the corpus."""
    rows = phrase_rows(docs)
    # what is joined is written first: between two plain tables Spark splits a partition that one key fills
    often = written(rows.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.max("twice").alias("t"))
                    .where((F.col("n") > 1) | F.col("t")).select("p"), "often")
    parse = written(rows.join(often, "p", "left_semi"), "parse")
    dictionary = written(parse.groupBy("p", "h").agg(
        F.count(F.lit(1)).alias("n"), F.max("twice").alias("twice"),
        F.min(F.struct("k", "first", "size")).alias("at")), "dictionary")
    group = written(dictionary.groupBy("p").agg(F.count(F.lit(1)).alias("phrases"), F.min("n").alias("least"),
                                                F.max("twice").alias("t"),
                                                F.sum(F.col("at.size") + LENGTH - 1).alias("c"))
                    .where(((F.col("phrases") > 1) | F.col("t")) & (F.col("least") == 1)).select("p", "c"), "groups")
    asked = dictionary.join(group, "p").select("p", "n", "c", "at.*") \
        .groupBy("k").agg(F.collect_list(F.struct("p", "n", "c", "first", "size")).alias("asked"))

    def fetch(batches):
        for batch in batches:
            out = []
            for k, text, asked in zip(*(c.to_pylist() for c in batch.columns)):
                data = utf8(text)
                out += [(x["p"], x["n"], x["c"], k, x["first"], data[x["first"]:x["first"] + x["size"] + LENGTH - 1])
                        for x in asked]
            columns = list(zip(*out)) if out else [[]] * 6
            types = [pa.int64()] * 5 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types)],
                                             names=["p", "n", "c", "k", "first", "data"])

    phrases = written(docs.join(asked, "k").select("k", "text", "asked").mapInArrow(
        fetch, "p bigint, n bigint, c bigint, k bigint, first bigint, data binary"), "phrases")
    usual = phrases.where(F.col("c") <= HOT).select("p", "n", "k", "first", "data") \
        .repartition("p").sortWithinPartitions("p").mapInArrow(sort_groups, "k bigint, a bigint, b bigint")

    def strings(batches):
        import xxhash
        for batch in batches:
            for n, k, first, data in zip(*(c.to_pylist() for c in batch.columns)):
                places = range(len(data) - LENGTH + 1)
                for s in (places[i:i + STRINGS] for i in range(0, len(places), STRINGS)):
                    h = np.array([xxhash.xxh3_64_intdigest(data[i:i + LENGTH]) for i in s], np.uint64).view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h), pa.array([n] * len(h), pa.int64()), pa.array([k] * len(h), pa.int64()),
                         pa.array([first + i for i in s], pa.int64())], names=["s", "n", "k", "a"])

    dealt = phrases.where(F.col("c") > HOT).select("n", "k", "first", "data") \
        .mapInArrow(strings, "s bigint, n bigint, k bigint, a bigint")
    again = dealt.groupBy("s").agg(F.sum("n").alias("times")).where("times > 1").select("s")
    hot = dealt.where("n = 1").join(again, "s", "left_semi").select("k", "a", F.col("a").alias("b"))
    whole = parse.join(dictionary.where("n > 1").select("p", "h"), ["p", "h"], "left_semi") \
        .select("k", F.col("first").alias("a"), (F.col("first") + F.col("size") - 1).alias("b"))
    return whole.unionByName(usual).unionByName(hot)


def left_over(data: bytes, found: list | None) -> tuple[bytes, int, int]:
    """Bytes not covered by strings that start in the ranges; the number removed, and of maximal removed runs."""
    if not found:
        return data, 0, 0
    change = np.zeros(len(data) + 1, np.int64)
    np.add.at(change, [r["a"] for r in found], 1)
    np.add.at(change, [r["b"] + LENGTH for r in found], -1)
    gone = np.cumsum(change)[:-1] > 0
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return np.frombuffer(data, np.uint8)[~gone].tobytes(), int(gone.sum()), runs


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_bytes: bool = True) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept, kept_sha256), one row per input row.

    Removed is every byte of a text (as UTF-8) that a 200-byte string covers which
    starts anywhere else, too, in the same or in another row. ``kept``: the bytes
    left, end to end (they may be no valid UTF-8; left out with
    ``with_bytes=False``). A null text is an empty one; texts of fewer than 200
    bytes stay whole; rows that repeat count as further places, so both are removed;
    ids may be null. Other columns are ignored; an empty table gives an empty result.
    Phrases are compared by 64-bit hashes of their bytes, strings of phrases by the
    bytes themselves (by such hashes in groups of more than ``HOT`` bytes).
    """
    docs = id_and_text(df, id_col, text_col).withColumn("k", F.xxhash64("doc_id", "text"))
    found = repeats(docs.select("k", "text")).groupBy("k").agg(F.collect_list(F.struct("a", "b")).alias("found"))
    joined = docs.join(found, "k", "left").select("doc_id", "text", "found")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            out = []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data = utf8(text)
                kept, removed, spans = left_over(data, found)
                out.append((len(data), removed, spans, kept, hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*out)) if out else [[]] * 5
            types = [pa.int64()] * 3 + [pa.binary(), pa.string()]
            names = ["n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"]
            arrays = [pa.array(c, type=t) for c, t in zip(columns, types)]
            if not with_bytes:
                del arrays[3], names[3]
            yield pa.RecordBatch.from_arrays([batch.column(0)] + arrays, names=["doc_id"] + names)

    kept = "kept binary, " if with_bytes else ""
    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, "
                                  f"{kept}kept_sha256 string").withColumnRenamed("doc_id", id_col)
