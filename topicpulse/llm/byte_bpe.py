"""Byte-level BPE encoding and decoding by merge replay over a corpus block.

Spark deals the corpus out in blocks. Within a block every distinct pre-token
(match of the split pattern) that is no whole token gets one row of linked byte
symbols, and an inverted index holds, for each possible merge, the places where
its two symbols stand side by side. The merges are then replayed over the whole
block in rank order: a merge visits exactly the places the index lists for it and
looks only at the two neighbours of the new symbol. Texts are put together from
their pre-tokens' ids afterwards. A block's words are all the state there is, so
nothing is shuffled and a lost task is simply run again.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame

from .common import blocks, id_and_text, map_texts

#: Characters of text worked on at a time, and words a task remembers between blocks (memory only).
BLOCK_CHARS, REMEMBERED = 4_000_000, 400_000
#: Places of the inverted index that are worked on at a time, if the lowest rank has no more.
AT_ONCE = 8192
#: Words of more bytes are merged one by one, as they would hold up the replay of the others.
LONG_WORD = 200
NONE, GONE = 2 ** 40, -1


def read_ranks(file: bytes) -> dict[bytes, int]:
    """Token bytes -> rank, from the lines of a rank file."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file.splitlines()) if token}


class Merges:
    """The vocabulary as a table of pairs: (left id, right id) -> id of the joined token, which is also its rank."""

    def __init__(self, ranks: dict[bytes, int]):
        get, keys, joined = ranks.get, [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = get(token[:i]), get(token[i:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    joined.append(rank)
        keys, joined = np.array(keys + [2 ** 62], np.int64), np.array(joined + [NONE], np.int64)
        order = np.argsort(keys)
        self.keys, self.joined = keys[order], joined[order]
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)

    def of(self, left, right) -> np.ndarray:
        """Rank of the merge of each pair of ids, NONE where there is none."""
        key = left << 32 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.joined[at], NONE)


def replay(words: list[bytes], merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """All merges applied to all (non-empty) words in rank order: the words' ids end to end, and each word's number."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    n = int(sizes.sum())
    token = merges.byte[np.frombuffer(b"".join(words), np.uint8)]
    word = np.repeat(np.arange(len(words)), sizes)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)     # places of a symbol's neighbours
    ends = np.cumsum(sizes)
    after[ends - 1] = -1
    before[ends - sizes] = -1
    rank_at = np.full(n, NONE)          # rank of the merge of a place's symbol with the next one
    inner = np.flatnonzero(after >= 0)
    rank_at[inner] = merges.of(token[inner], token[inner + 1])
    # the inverted index: rank -> places whose symbol and the next make that merge (or did when it was noted)
    order = np.argsort(rank_at, kind="stable")
    order = order[:np.searchsorted(rank_at[order], NONE)]
    ranks, first = np.unique(rank_at[order], return_index=True)
    index = dict(zip(ranks.tolist(), (x.tolist() for x in np.split(order, first[1:])))) if len(ranks) else {}
    todo = list(index)
    heapq.heapify(todo)
    while todo:
        # The lowest ranks together, until they make up a batch worth a vector operation. A
        # word's lowest merge (the leftmost of equal ones) is in the batch if any of its merges
        # is, and only that one is done now: the others wait in the index, as it may use up
        # their symbols or make a merge possible that comes before them.
        places: list[int] = []
        while todo and len(places) < AT_ONCE:
            places += index.pop(heapq.heappop(todo))
        limit = todo[0] if todo else NONE
        p = np.array(places, np.int64)
        p = p[rank_at[p] < limit]
        if not len(p):
            continue
        rank = rank_at[p]
        order = np.lexsort((p, rank, word[p]))
        p, rank = p[order], rank[order]
        own = word[p]
        lead = np.ones(len(p), bool)
        np.not_equal(own[1:], own[:-1], out=lead[1:])
        waiting = ~lead
        for other, place in zip(rank[waiting].tolist(), p[waiting].tolist()):
            if other in index:
                index[other].append(place)
            else:
                index[other] = [place]
                heapq.heappush(todo, other)
        p, rank = p[lead], rank[lead]
        q = after[p]
        r = after[q]
        token[p], token[q], rank_at[p], rank_at[q] = rank, GONE, NONE, NONE
        after[p] = r
        has = r >= 0
        p_r, r = p[has], r[has]
        before[r] = p_r
        rank_at[p_r] = merges.of(token[p_r], token[r])
        left = before[p]
        p_l = p[left >= 0]
        left = left[left >= 0]
        rank_at[left] = merges.of(token[left], token[p_l])
        touched = np.concatenate([p_r, left])
        found = rank_at[touched]
        some = found != NONE
        for other, place in zip(found[some].tolist(), touched[some].tolist()):
            if other in index:
                index[other].append(place)
            else:
                index[other] = [place]
                heapq.heappush(todo, other)
    left = token != GONE
    return token[left], np.bincount(word[left], minlength=len(words))


def replay_one(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same for a single long word, whose merges are done one at a time in (rank, place) order."""
    symbols: list = [word[i:i + 1] for i in range(len(word))]
    n = len(symbols)
    after, before = list(range(1, n)) + [-1], list(range(-1, n - 1))
    heap = [(ranks[pair], i) for i in range(n - 1) if (pair := word[i:i + 2]) in ranks]
    heapq.heapify(heap)
    while heap:
        rank, p = heapq.heappop(heap)
        q = after[p]
        if symbols[p] is None or q < 0 or ranks.get(symbols[p] + symbols[q]) != rank:
            continue
        symbols[p], symbols[q] = symbols[p] + symbols[q], None
        r = after[p] = after[q]
        if r >= 0:
            before[r] = p
            if (other := ranks.get(symbols[p] + symbols[r])) is not None:
                heapq.heappush(heap, (other, p))
        if before[p] >= 0 and (other := ranks.get(symbols[before[p]] + symbols[p])) is not None:
            heapq.heappush(heap, (other, before[p]))
    return [ranks[s] for s in symbols if s is not None]


class Numbers(dict):
    """Chunk -> its number; an unknown one is put at the end of the list of chunks, with ``lead`` in front."""

    def __init__(self, chunks: list, lead: str):
        super().__init__()
        self.chunks, self.lead = chunks, lead

    def __missing__(self, chunk: str) -> int:
        self[chunk] = n = len(self.chunks)
        self.chunks.append(self.lead + chunk)
        return n


class BlockEncoder:
    """Encodes texts block by block; keeps the words of earlier blocks up to a bound."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        self.ranks, self.merges = ranks, Merges(ranks)
        self.split = regex.compile(pattern).findall
        self.token = {i: t for t, i in ranks.items()}
        self.name = {i: str(i) for i in self.token}
        self.forget()

    def forget(self) -> None:
        self.chunks: list[str] = []                     # chunks by number; each is one or more matches of the pattern
        self.bare, self.spaced = Numbers(self.chunks, ""), Numbers(self.chunks, " ")
        self.line_end = self.bare["\n"]
        self.ids: list[list] = []                       # ids of a chunk
        self.text: list[str] = []                       # the same in decimal, joined by commas

    def learn(self, chunks: list[str]) -> None:
        """Ids of new chunks, which have got the numbers that follow."""
        cut = [self.split(c) for c in chunks]
        ids: dict[str, list[int]] = {}
        merge, data = [], []
        for w in set().union(*cut):
            d = w.encode("utf-8")
            if d in self.ranks:
                ids[w] = [self.ranks[d]]
            elif len(d) > LONG_WORD:
                ids[w] = replay_one(d, self.ranks)
            else:
                merge.append(w)
                data.append(d)
        flat, sizes = replay(data, self.merges)
        flat, ends = flat.tolist(), np.cumsum(sizes).tolist()
        for w, e, n in zip(merge, ends, sizes.tolist()):
            ids[w] = flat[e - n:e]
        name = self.name.__getitem__
        text = {w: ",".join(map(name, x)) for w, x in ids.items()}
        for words in cut:
            if len(words) == 1:
                self.ids.append(ids[words[0]])
                self.text.append(text[words[0]])
            else:
                self.ids.append(list(chain.from_iterable(map(ids.__getitem__, words))))
                self.text.append(",".join(map(text.__getitem__, words)))

    def encode(self, texts: list):
        """For each text its ids and the text of its decimal ids."""
        if len(self.text) > REMEMBERED:
            self.forget()
        rows = [self.row(t) if t else [] for t in texts]
        self.learn(self.chunks[len(self.text):])
        ids, text = self.ids.__getitem__, self.text.__getitem__
        for row in rows:
            yield list(chain.from_iterable(map(ids, row))), ",".join(map(text, row))

    def row(self, text: str) -> list[int]:
        """A text as the numbers of its chunks.

        Where a single space or line end stands between two characters that are no
        white space, the pattern ends a match in front of it: no alternative reaches
        past such a character into white space, and none looks back. A line end there
        is a match of its own, a space begins the next. Texts with any other white
        space are one chunk for each match of the pattern.
        """
        if text.replace("\n", " ") != " ".join(text.split()):
            return list(map(self.bare.__getitem__, self.split(text)))
        out, bare, spaced = [], self.bare.__getitem__, self.spaced.__getitem__
        for line in text.split("\n"):
            first, *more = line.split(" ")
            out.append(bare(first))
            out += map(spaced, more)
            out.append(self.line_end)
        out.pop()
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


def encode_decode(df: DataFrame, rank_file: bytes, pattern: str, id_col: str = "doc_id",
                  text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """(id, n_tokens, ids, ids_sha256, decoded_sha256), one row per input row, without a shuffle.

    ``ids`` are the token ids of the whole text (left out with ``with_ids=False``),
    ``ids_sha256`` the SHA-256 of the decimal ids joined by commas and
    ``decoded_sha256`` that of the bytes the ids decode to. A null text counts as
    empty (no ids); ids of rows may be null or repeat; other columns are ignored;
    an empty table gives an empty result. Special strings in a text are ordinary
    text. ``rank_file`` (some hundred kB) must hold all 256 single bytes.
    """
    if missing := 256 - sum(len(t) == 1 for t in read_ranks(rank_file)):
        raise ValueError(f"rank file lacks {missing} single bytes")

    def start():
        encoder = BlockEncoder(read_ranks(rank_file), pattern)

        def work(texts):
            for block in blocks(texts, BLOCK_CHARS):
                for ids, text in encoder.encode(block):
                    row = (len(ids), hashlib.sha256(text.encode()).hexdigest(),
                           hashlib.sha256(encoder.decode(ids)).hexdigest())
                    yield (ids, *row) if with_ids else row

        return work

    columns = [("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    return map_texts(id_and_text(df, id_col, text_col), start,
                     [("ids", "array<int>")] * with_ids + columns).withColumnRenamed("doc_id", id_col)


def decode_ids(df: DataFrame, rank_file: bytes, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) from rows with arrays of token ids: the inverse of ``encode_decode``.

    A null array gives a null text; an unknown id fails the job; bytes that are no
    UTF-8 come out as replacement characters.
    """
    def start():
        token = {i: t for t, i in read_ranks(rank_file).items()}
        return lambda rows: [(None if ids is None else
                              b"".join(token[i] for i in ids).decode("utf-8", "replace"),) for ids in rows]

    return map_texts(id_and_text(df, id_col, ids_col), start, [("decoded", "string")]) \
        .withColumnRenamed("decoded", "text").withColumnRenamed("doc_id", id_col)
