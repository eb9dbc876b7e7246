"""How a set of filters interacts, for every order in which they could be applied.

Which filters a document fails is a mask of five bits, and all that any order of
the filters does to a part of the corpus follows from the part's counts by mask.
These counts are a Spark aggregate. Over them a decision diagram is built for each
part: a level for each filter, a branch for passing and one for failing it, and
at every node the number of documents that come by. The path that passes every
level visits, from the top, exactly the documents that are left after each step:
the weight of its failing branch is what the step removes, that of its passing
branch what it keeps. Two neighbouring filters change places by a swap of their two
levels, which touches the nodes of the upper level only; a sequence of such swaps
goes through all orders, each one swap from the last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import utf8, written

FILTERS = "ABCDE"
SYMBOLS = b"#$%&*|"
UPPER = bytes(range(65, 91))
MIN_WORDS = 200
COUNTS = ["n", "good", "toxic"]


class Diagram:
    """A reduced decision diagram over failure masks whose nodes carry vectors of counts.

    A node is (level's variable, pass child, fail child); children and weights are kept
    by number. Equal nodes are one node (``make`` looks them up), a subtree without documents is
    ``None``. All documents below a node pass or fail the variables above it alike, so a
    node's weight is the sum of its children's.
    """

    def __init__(self, counts: dict[int, np.ndarray], variables: str):
        self.order = list(range(len(variables)))       # variable at each level
        self.nodes: list[tuple] = []
        self.weight: list[np.ndarray] = []
        self.unique: dict[tuple, int] = {}
        self.root = self.build(counts, 0)

    def make(self, key: tuple, weight: np.ndarray) -> int:
        at = self.unique.get(key)
        if at is None:
            at = self.unique[key] = len(self.nodes)
            self.nodes.append(key)
            self.weight.append(weight)
        return at

    def leaf(self, weight: np.ndarray) -> int | None:
        return self.make(("leaf", *weight.tolist()), weight) if weight.any() else None

    def node(self, variable: int, passed: int | None, failed: int | None) -> int | None:
        if passed is None and failed is None:
            return None
        below = [self.weight[x] for x in (passed, failed) if x is not None]
        return self.make((variable, passed, failed), sum(below[1:], below[0]))

    def build(self, counts: dict[int, np.ndarray], level: int) -> int | None:
        if not counts:
            return None
        if level == len(self.order):
            return self.leaf(sum(counts.values()))
        v = self.order[level]
        sides = [{m: w for m, w in counts.items() if (m >> v & 1) == bit} for bit in (0, 1)]
        return self.node(v, *(self.build(s, level + 1) for s in sides))

    def swap(self, level: int) -> None:
        """Exchange the variables of ``level`` and the next one; nodes below both stay as they are."""
        upper, lower = self.order[level], self.order[level + 1]
        done: dict[int, int | None] = {}

        def children(x: int | None) -> tuple:
            return (None, None) if x is None else self.nodes[x][1:]

        def rebuilt(x: int | None, depth: int) -> int | None:
            if x is None:
                return None
            if x not in done:
                v, passed, failed = self.nodes[x]
                if depth < level:
                    done[x] = self.node(v, rebuilt(passed, depth + 1), rebuilt(failed, depth + 1))
                else:
                    (pp, pf), (fp, ff) = children(passed), children(failed)
                    done[x] = self.node(lower, self.node(upper, pp, fp), self.node(upper, pf, ff))
            return done[x]

        self.root = rebuilt(self.root, 0)
        self.order[level], self.order[level + 1] = lower, upper

    def steps(self, size: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(kept, removed) of each level along the path that passes every filter."""
        none, at, out = np.zeros(size, np.int64), self.root, []
        for _ in self.order:
            passed, failed = (None, None) if at is None else self.nodes[at][1:]
            out.append((none if passed is None else self.weight[passed], none if failed is None else self.weight[failed]))
            at = passed
        return out


def swaps(n: int) -> Iterator[int]:
    """Levels to swap, one after the other, so that all orders of n variables come by (by plain changes)."""
    if n < 2:
        return
    down = True
    inner = list(swaps(n - 1))
    for k in range(len(inner) + 1):
        run = range(n - 2, -1, -1) if down else range(n - 1)
        yield from run
        if k < len(inner):
            # the largest variable stands first (down) or last: the others' levels are one lower, or the same
            yield inner[k] + 1 if down else inner[k]
        down = not down


def audit_part(counts: dict[int, np.ndarray]) -> list[tuple]:
    """(filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of one part.

    ``counts``: of each mask (bit v set: filter v fails) the numbers of documents, of
    good and of toxic ones. No documents: zeros.
    """
    n = len(FILTERS)
    diagram = Diagram(counts, FILTERS)
    fails = [sum(int(w[0]) for m, w in counts.items() if m >> v & 1) for v in range(n)]
    alone = [int(counts[1 << v][0]) if 1 << v in counts else 0 for v in range(n)]
    shapley, rows = [0] * n, []
    for level in [None, *swaps(n)]:
        if level is not None:
            diagram.swap(level)
        order = "".join(FILTERS[v] for v in diagram.order)
        for step, (v, (kept, removed)) in enumerate(zip(list(diagram.order), diagram.steps(len(COUNTS))), 1):
            shapley[v] += int(removed[0])
            rows.append((v, order, step, int(kept[0]), int(removed[0]), fails[v] - int(removed[0]), alone[v],
                         int(removed[1]), int(removed[2])))
    return [(*r[1:], shapley[r[0]]) for r in rows]


RESULT = ("filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, "
          "good_lost bigint, toxic_lost bigint, shapley bigint")


def mask_of(text: str | None) -> int:
    """Bits of the filters A to D that a text fails."""
    text = text or ""
    data = utf8(text)
    words = data.split()            # of bytes: splits at exactly the six ASCII blanks
    upper = len(data) - len(data.translate(None, UPPER))
    return ((len(words) < MIN_WORDS) | (100 * len(set(words)) < 50 * len(words)) << 1
            | (100 * upper > 2 * len(text)) << 2 | (len(data) != len(data.translate(None, SYMBOLS))) << 3)


def judged(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask, digest) of ``docs(doc_id, part, text)``, in Arrow batches: the texts go no further."""
    from hashlib import blake2b
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = batch.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([mask_of(t) for t in texts], type=pa.int32()),
                 pa.array([blake2b(utf8(t), digest_size=16).digest() for t in texts], type=pa.binary())],
                names=["doc_id", "part", "mask", "digest"])

    return docs.select("doc_id", "part", "text").mapInArrow(
        run, f"doc_id {kind}, part string, mask int, digest binary")


def mask_counts(df: DataFrame, labels: DataFrame, part_col: str = "source", id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """(part, mask, n, good, toxic): the documents of each part by the filters they fail, one row of 32 at most for each mask.

    Filter E needs the whole table: of the rows of one text those with the smallest id pass.
    Ids of equal texts are grouped by (digest, id) and met again by (digest, id), so a text
    that a third of all rows have is no hot key. Rows without an id pass E and make no
    other row fail it. Labels of an id that has several are joined to one: good (toxic) if any says so.
    """
    part = F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit(""))
    docs = df.select(F.col(f"`{id_col}`").alias("doc_id"), part.alias("part"), F.col(f"`{text_col}`").alias("text"))
    marks = labels.groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = judged(docs).groupBy("doc_id", "digest", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    rows = written(rows.join(marks, "doc_id", "left").select(
        "doc_id", "digest", "part", "mask", "n", F.coalesce("good", F.lit(0)).alias("good"),
        F.coalesce("toxic", F.lit(0)).alias("toxic")), "filter-audit")
    first = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.lit(True).alias("first"))
    e = 1 << FILTERS.index("E")
    passes = F.col("first").isNotNull() | F.col("doc_id").isNull()
    return rows.join(first, ["digest", "doc_id"], "left") \
        .groupBy("part", F.when(passes, F.col("mask")).otherwise(F.col("mask") + e).alias("mask")) \
        .agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"),
             F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def filter_audit(df: DataFrame, labels: DataFrame, part_col: str = "source", id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    One row for each part (value of ``part_col``; null: the empty string), each of the 120 orders of
    the filters A to E and each step. Failing is: A, under 200 words; B, under 50 % distinct
    words (a text without words doesn't); C, over 2 % of the characters in A-Z; D, any of #$%&*|; E, a row with a smaller id has
    the same text. A null text is an empty one. Rows that repeat count as often as they stand there, and copies
    of one id don't fail E by each other; see ``mask_counts`` for null ids and labels. Columns other than
    those named are ignored. An empty table has no part: an empty result. ``labels`` may be empty.

    Only counts by mask, at most 32 rows a part, reach the diagrams, however large the part is.
    """
    counts = mask_counts(df, labels, part_col, id_col, text_col)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        part = rows["part"].iloc[0]
        found = {int(m): np.array(c, np.int64) for m, *c in rows[["mask", *COUNTS]].itertuples(index=False)}
        out = pd.DataFrame(audit_part(found), columns=[c.split()[0] for c in RESULT.split(", ")])
        out.insert(0, "part", part)
        return out

    return counts.groupBy("part").applyInPandas(run, f"part string, {RESULT}")


SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
judged AS (
  SELECT d.doc_id, d.part, coalesce(l.quality, 0) AS quality, coalesce(l.toxic, 0) AS toxic,
         (len(w) < 200)::INT
         + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
         + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text))::INT
         + 8 * regexp_matches(text, '[#$%&*|]')::INT
         + 16 * (d.doc_id > min(d.doc_id) OVER (PARTITION BY text))::INT AS mask
  FROM words d LEFT JOIN labels l ON l.doc_id = d.doc_id),
counts AS (
  SELECT part, mask, count(*) AS n, sum((quality = 1)::INT) AS good, sum((toxic = 1)::INT) AS toxic
  FROM judged GROUP BY part, mask),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND length(replace(a.c || b.c || c.c || d.c || e.c, a.c, '')) = 4
    AND length(replace(a.c || b.c || c.c || d.c || e.c, b.c, '')) = 4
    AND length(replace(a.c || b.c || c.c || d.c || e.c, c.c, '')) = 4
    AND length(replace(a.c || b.c || c.c || d.c || e.c, d.c, '')) = 4),
places AS (
  SELECT filter_order, s::INT AS step, bits[s] AS bit, list_sum(bits[1:s])::INT - bits[s] AS before
  FROM orders, unnest([1, 2, 3, 4, 5]) AS t(s)),
steps AS (
  SELECT part, filter_order, step, bit,
         sum(CASE WHEN mask & (before + bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
         sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN mask & before > 0 AND mask & bit > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
         sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM counts, places GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM steps
"""
