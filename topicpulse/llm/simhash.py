"""SimHash near-duplicates by a segment-popcount embedding and a grid range-join.

A 64-bit fingerprint is mapped to the bit counts of its 32 segments of two bits.
The Manhattan distance of two such vectors is never more than the Hamming
distance of the fingerprints. So fingerprints that differ in at most three bits
are at most three apart, and over one of the two halves (16 segments) at most
one apart. For each half the vector is a cell of a grid; a fingerprint is
compared with those in its own cell and in the cells one step away, and every
candidate is verified by the exact number of differing bits. Of two neighbouring
cells one has an even sum of counts, and only its fingerprints look into the
other, so no pair is looked at from both sides.
"""

from __future__ import annotations

from itertools import islice

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import fresh, id_and_text, map_texts, utf8, written
from .components import components

SEED = 42
HALF = 0xFFFFFFFF
PAIRS_OF_BITS = 0x55555555      # the lower bit of each two-bit segment


def shingles(text: str | None, words: int) -> list[bytes]:
    """Runs of so many words (a shorter text: all its words), repeats included; A-Z count as a-z."""
    w = utf8(text).lower().split()      # of bytes: ASCII letters and the six ASCII blanks only
    if len(w) <= words:
        return [b" ".join(w)] if w else []
    return list(map(b" ".join, zip(*(islice(w, k, None) for k in range(words)))))


def fingerprint(text: str | None, words: int = 3) -> int:
    """SimHash as a signed 64-bit integer; 0 for a text without words."""
    import xxhash
    grams = shingles(text, words)
    if not grams:
        return 0
    digest = xxhash.xxh64_intdigest
    total = np.zeros(64, np.int64)
    for at in range(0, len(grams), 65536):
        part = grams[at:at + 65536]
        h = np.fromiter((digest(g, SEED) for g in part), np.uint64, len(part))
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(grams), bitorder="little").view(np.int64)[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(doc_id, fp): one row per input row, without a shuffle."""
    return map_texts(id_and_text(df, id_col, text_col),
                     lambda: lambda texts: ((fingerprint(t, words),) for t in texts), [("fp", "bigint")])


def links(fps: DataFrame, distance: int = 3) -> DataFrame:
    """(a, b) with a <> b for distinct fingerprints ``fps(fp)`` that differ in at most ``distance`` <= 3 bits, whole."""
    if not 0 <= distance <= 3:
        raise ValueError("the grid is made for distances up to 3")
    half = F.explode(F.array(*[
        F.struct(F.lit(h).alias("h"), F.shiftrightunsigned("fp", 32 * h).bitwiseAND(F.lit(HALF)).alias("x"))
        for h in (0, 1)]))
    cells = fps.select("fp", half.alias("s")).select(
        "fp", F.col("s.h").alias("h"), (F.bit_count("s.x") % 2 == 0).alias("even"),
        # in each two-bit segment: its value less its upper bit, which is its bit count
        (F.col("s.x") - F.shiftrightunsigned("s.x", 1).bitwiseAND(F.lit(PAIRS_OF_BITS))).alias("v"))
    steps = []
    for k in range(16):
        count = F.shiftrightunsigned("v", 2 * k).bitwiseAND(F.lit(3))
        one = F.lit(1 << 2 * k).cast("long")
        steps += [F.when(count < 2, F.col("v") + one), F.when(count > 0, F.col("v") - one)]
    key = lambda v: (v * 2 + F.col("h")).alias("cell")      # noqa: E731
    home = cells.select(F.col("fp").alias("b"), "even", key(F.col("v")))
    own = cells.select(F.col("fp").alias("a"), F.lit(True).alias("same"), key(F.col("v")))
    around = cells.where("even").select("fp", "h", F.explode(F.array_compact(F.array(*steps))).alias("w")) \
        .select(F.col("fp").alias("a"), F.lit(False).alias("same"), key(F.col("w")))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    return own.unionByName(around).join(home, "cell").where(near & (~F.col("same") | (F.col("a") < F.col("b")))) \
        .select("a", "b")


def groups(fps: DataFrame, distance: int = 3) -> DataFrame:
    """(fp, root, component_id) for every distinct fingerprint of ``fps(doc_id, fp)``; root names the component for sure."""
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    tree = components(links(fps.select("fp").distinct(), distance), "simhash-links")
    tree = written(nodes.join(tree, nodes.fp == tree.node, "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")), "simhash-nodes")
    # written, so that a component that fills a partition of the join can be split
    ids = written(tree.groupBy("root").agg(F.min("first").alias("component_id")), "simhash-ids")
    return tree.join(ids, "root").select("fp", "root", "component_id")


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3,
                       distance: int = 3) -> DataFrame:
    """(id, fingerprint, component_id), one row per input row.

    ``fingerprint``: 16 lowercase hex digits. ``component_id``: the smallest id
    that can be reached over links of at most ``distance`` differing bits, the
    row's own included. Rows with equal fingerprints are one node, so copies, be
    they a third of the table, are never paired with each other. A null text is an
    empty one; texts without words have fingerprint zero and are linked like any
    other. Null ids are no component's name: a component of null ids only has
    component_id null. Repeated rows each keep their row. An empty table gives an
    empty result.
    """
    fps = written(fingerprints(df, id_col, text_col, words), "simhash")
    return fps.join(groups(fps, distance).drop("root"), "fp").select(
        F.col("doc_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3,
             distance: int = 3) -> DataFrame:
    """The rows of ``df``, all columns, of which each component keeps the one with the smallest id.

    Of several rows of a component with that id the one whose text has the smallest
    digest stays. Rows of other components stay, whatever ids they share. Rows
    without an id can't be named as copies and stay.
    """
    digest = F.coalesce(F.sha2(F.col(f"`{text_col}`").cast("binary"), 256), F.lit(""))
    texts = df.select(F.struct(F.col(f"`{id_col}`").alias("doc_id"), digest.alias("digest")).alias("doc_id"),
                      F.col(f"`{text_col}`").alias("text"))
    fps = written(fingerprints(texts, words=words).select("doc_id.*", "fp"), "simhash")
    # equal texts are in the same component, so a digest and an id name one component's row
    mark = fresh(df, "digest")
    first = fps.join(groups(fps, distance), "fp").where(F.col("doc_id") == F.col("component_id")) \
        .groupBy("root").agg(F.min(F.struct("doc_id", "digest")).alias("x")) \
        .select(F.col("x.doc_id").alias(id_col), F.col("x.digest").alias(mark))
    return df.where(F.col(f"`{id_col}`").isNotNull()).withColumn(mark, digest) \
        .join(first, [id_col, mark], "left_semi").dropDuplicates([id_col, mark]).select(df.columns) \
        .unionByName(df.where(F.col(f"`{id_col}`").isNull()))
