"""Exact token counts with a whole-token shortcut.

The model joins neighbouring symbols only into strings of its vocabulary, so a
place whose two characters stand side by side in no vocabulary string can never
be joined: a text may be cut there and its parts counted alone. Before a job
starts, ``prove`` checks on the vocabulary that this holds in front of a run of
spaces and on both sides of a line end, and finds out which vocabulary strings,
encoded alone, come out as the one token they are. A part of a text that is such
a string costs one dictionary look-up; only the rest is merged by the library.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from .common import blocks, id_and_text, map_texts, utf8

SPACE = "▁"
RUN = re.compile(" +[^ ]*")
#: Parts whose count a task remembers at most, and the text it cuts up at a time (memory only, not results).
REMEMBERED, BLOCK_CHARS = 400_000, 2_000_000


def load(model: bytes):
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_proto=model)


def prove(model: bytes) -> dict:
    """What is certain about this vocabulary: where texts may be cut, and its whole tokens.

    ``after_space`` / ``bare``: strings that are exactly one token behind a single
    space / without one. ``cut``: False if some vocabulary string spans a cut, and
    then texts are encoded whole.
    """
    sp = load(model)
    pieces = [(i, sp.id_to_piece(i)) for i in range(sp.get_piece_size())
              if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    cut = not any(SPACE in p.lstrip(SPACE) or "\n" in p for _, p in pieces)
    # a space stays a space, one is put in front, and a line end is one token
    cut = cut and sp.encode("a") == sp.encode_as_ids("a") and len(sp.encode("\n")) == 2 \
        and len(sp.encode("\n\n")) == 3 and sp.encode(" a") != sp.encode("a") \
        and sp.encode("▁▁a") == sp.encode("  a") and len(sp.encode(" ")) == 1
    lead = sp.encode("\n")
    after_space, bare = set(), set()
    for i, p in pieces:
        if p.startswith(SPACE):
            s = p[1:].replace(SPACE, " ")
            if s and sp.encode(s) == [i]:
                after_space.add(s)
        elif sp.encode("\n" + p) == lead + [i]:
            bare.add(p)
    return {"cut": cut, "after_space": after_space, "bare": bare}


class Counts(dict):
    """Part of a text -> its number of tokens. What isn't proven is encoded once, many parts a call."""

    def __init__(self, proven, encode_many):
        super().__init__(dict.fromkeys(proven, 1))
        self.proven, self.encode_many = proven, encode_many

    def learn(self, parts: set) -> None:
        new = [p for p in parts if p not in self]
        if len(self) + len(new) > REMEMBERED + len(self.proven):
            self.clear()
            self.update(dict.fromkeys(self.proven, 1))
            new = [p for p in parts if p not in self]
        self.update(zip(new, self.encode_many(new)))


def parts_of(text: str) -> tuple[list, list, int]:
    """Parts behind a space, parts behind a line end, and the number of line ends."""
    first, *rest = text.replace(SPACE, " ").split("\n")
    after, bare = [], []
    for s in [" " + first, *rest]:
        head, gap, tail = s.partition(" ")
        if head:
            bare.append(head)
        if gap:
            if "  " in s:
                after += [run[1:] for run in RUN.findall(gap + tail)]
            else:
                after += tail.split(" ")
    return after, bare, len(rest)


def counter(model: bytes, proof: dict):
    """A function from texts to their numbers of tokens."""
    sp = load(model)
    if not proof["cut"]:
        return lambda texts: [len(sp.encode(t)) if t else 0 for t in texts]
    # a space alone is one token; behind a line end, the space in front and the line end are two
    after = Counts(proof["after_space"], lambda new: [len(x) or 1 for x in sp.encode(new, num_threads=1)])
    bare = Counts(proof["bare"], lambda new: [len(x) - 2 for x in sp.encode(["\n" + s for s in new], num_threads=1)])

    def count(texts: list) -> list[int]:
        out: list[int] = []
        for block in blocks(texts, BLOCK_CHARS):
            cut = [parts_of(t) if t else ([], [], 0) for t in block]
            after.learn(set().union(*(c[0] for c in cut)))
            bare.learn(set().union(*(c[1] for c in cut)))
            out += [sum(map(after.__getitem__, a)) + sum(map(bare.__getitem__, b)) + n for a, b, n in cut]
        return out

    return count


def token_counts(df: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 4096) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit), one row per input row, without a shuffle.

    A null text counts as empty (0 bytes, 0 tokens); ids may be null or repeat;
    texts of any length are counted whole; other columns are ignored; an empty
    table gives an empty result. ``model`` holds the bytes of a model file (some
    hundred kB) and is sent to the tasks with what is proven about it.
    """
    proof = prove(model)

    def start():
        count = counter(model, proof)
        return lambda texts: zip([len(utf8(t)) for t in texts], count(texts))

    out = map_texts(id_and_text(df, id_col, text_col), start, [("n_bytes", "bigint"), ("n_tokens", "bigint")])
    return out.withColumn("over_limit", F.col("n_tokens") > F.lit(limit)).withColumnRenamed("doc_id", id_col)
