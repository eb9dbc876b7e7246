"""Substring dedup by sliding sentence spans.

A text is cut into sentences. From every sentence on, and up to every sentence,
the shortest span that is long enough is hashed: three sentences with at least
``MIN_WORDS`` words, or any number with ``LONG_WORDS``. (Spans to both sides, so
that a repeated passage is covered up to its last sentence.) Spans are joined
globally by hash; every occurrence but the first, by id and place, marks its
sentences, and marked sentences are removed.
"""

from __future__ import annotations

import re
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import fresh, map_texts, written

SENTENCES, MIN_WORDS, LONG_WORDS = 3, 12, 25
BREAK = re.compile(r"((?<=[.!?])\s+|\s*\n\s*)")


def cut(text: str | None) -> tuple[list[str], list[int], list[list[str]]]:
    """Pieces (sentence, gap, sentence, ...), and of the sentences with words the piece and the words."""
    pieces = BREAK.split(text or "")
    places, words = [], []
    for i in range(0, len(pieces), 2):
        if w := pieces[i].split():
            places.append(i)
            words.append(w)
    return pieces, places, words


def spans(sizes: list[int]) -> list[tuple[int, int]]:
    """(first, last) sentence of each span, for sentences of so many words; each span once."""
    total = [0, *accumulate(sizes)]
    n, found = len(sizes), set()
    enough = lambda i, j: (w := total[j + 1] - total[i]) >= LONG_WORDS or (     # noqa: E731
        j - i + 1 >= SENTENCES and w >= MIN_WORDS)
    j = 0
    for i in range(n):      # shortest span from i on; its end never moves back
        j = max(i, j)
        while j < n and not enough(i, j):
            j += 1
        if j == n:
            break
        found.add((i, j))
    i = n - 1
    for j in range(n - 1, -1, -1):      # shortest span up to j
        i = min(i, j)
        while i >= 0 and not enough(i, j):
            i -= 1
        if i < 0:
            break
        found.add((i, j))
    return sorted(found)


def span_hashes(text: str | None) -> list[tuple[int, int]]:
    """(hash, first << 32 | last) of each span; the words of its sentences count, not the space between."""
    import xxhash
    _, _, words = cut(text)
    line = [" ".join(w) for w in words]
    return [(xxhash.xxh64_intdigest("\n".join(line[i:j + 1])) - 2 ** 63, i << 32 | j)
            for i, j in spans([len(w) for w in words])]


def without(text: str | None, marked: list | None) -> tuple[str | None, int, int, int]:
    """Text without the sentences of the marked spans, its sentences, those removed, and characters removed."""
    pieces, places, _ = cut(text)
    if not marked:
        return text, len(places), 0, 0
    drop = set()
    for span in marked:
        drop.update(range(span >> 32, (span & 0xFFFFFFFF) + 1))
    for s in drop:      # with the gap behind, or in front of the last sentence
        i = places[s]
        pieces[i] = ""
        if i + 1 < len(pieces):
            pieces[i + 1] = ""
    kept = "".join(pieces)
    return kept, len(places), len(drop), len(text) - len(kept)


def remove_repeated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with the text left after removal, and n_sentences, n_removed, n_chars_removed, first_docs.

    One row per input row, all columns kept. ``first_docs``: ids of the documents
    with the first occurrences of what was removed, sorted. The first occurrence is
    that of the smallest id (a null id comes last), of equal ids that of the smaller
    hash of the text, then the first in the text. Rows with the same id and text are
    one document to the join and get the same result. Null texts stay null, texts
    without a long enough span stay as they are, also if they repeat. The added
    columns replace columns of these names. An empty table gives an empty result.
    """
    key, marked, firsts = fresh(df, "k"), fresh(df, "marked"), fresh(df, "first")
    order = F.struct(F.col("id").isNull(), F.col("id"), F.col("k"), F.col("at"))
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def start():
        return lambda texts: (tuple(zip(*x)) if (x := span_hashes(t)) else ([], []) for t in texts)

    keyed = rows.select(F.struct("id", F.xxhash64("id", "text").alias("k")).alias("doc_id"), "text")
    hashed = map_texts(keyed, start, [("h", "array<bigint>"), ("at", "array<bigint>")])
    found = hashed.select("doc_id.*", F.explode(F.arrays_zip("h", "at")).alias("x")) \
        .select("id", "k", F.col("x.h").alias("h"), F.col("x.at").alias("at"))
    # Which hashes occur twice is counted on hashes alone; only their occurrences go on. What is
    # joined is written first: between two plain tables Spark splits a partition that one hash fills.
    twice = written(found.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "spans-twice")
    found = written(found.join(twice, "h", "left_semi"), "spans")
    first = written(found.groupBy("h").agg(F.min(order).alias("first")), "spans-first")
    later = found.join(first, "h").where(order != F.col("first"))
    by_row = later.groupBy("k").agg(F.collect_set("at").alias(marked),
                                    F.sort_array(F.collect_set("first.id")).alias(firsts)) \
        .withColumnRenamed("k", key)
    joined = df.withColumn(key, F.xxhash64(id_col, text_col)).join(by_row, key, "left")
    added = [("n_sentences", "bigint"), ("n_removed", "bigint"), ("n_chars_removed", "bigint")]
    names = [c for c in df.columns if c not in {n for n, _ in added} | {"first_docs"}]
    joined = joined.select(*[F.col(f"`{c}`") for c in names], marked, firsts)
    at = names.index(text_col)
    schema = T.StructType([joined.schema[c] for c in names]
                          + [T.StructField(n, T.LongType()) for n, _ in added]
                          + [T.StructField("first_docs", T.ArrayType(df.schema[id_col].dataType))])

    def run(batches):
        for batch in batches:
            done = [without(t, m) for t, m in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist())]
            text, *figures = [list(x) for x in zip(*done)] if done else [[], [], [], []]
            columns = [batch.column(i) for i in range(len(names))]
            columns[at] = pa.array(text, type=columns[at].type)
            yield pa.RecordBatch.from_arrays(columns + [pa.array(f, type=pa.int64()) for f in figures]
                                             + [batch.column(len(names) + 1)], names=schema.names)

    return joined.mapInArrow(run, schema)
