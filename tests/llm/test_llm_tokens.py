"""Token counts and byte-level BPE against the libraries, on edge rows and on every test document."""

import hashlib

import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken

from topicpulse.llm.byte_bpe import Merges, decode_ids, encode_decode, read_ranks, replay, replay_one
from topicpulse.llm.queries import tokenizer_file
from topicpulse.llm.token_counts import counter, prove, token_counts

from llm_cases import collected, documents, edge_rows, frame

MODEL, RANKS = "piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken"


def test_token_counts_equal_the_library(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path(MODEL))
    rows = edge_rows() + [(r.doc_id, r.text) for r in documents(spark).select("doc_id", "text").collect()]
    want = sorted(((i, len((t or "").encode()), len(sp.encode(t or "")), len(sp.encode(t or "")) > 4096)
                   for i, t in rows), key=repr)
    assert collected(token_counts(frame(spark, rows), tokenizer_file(MODEL))) == want


def test_whole_tokens_are_proven():
    proof = prove(tokenizer_file(MODEL))
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path(MODEL))
    assert proof["cut"] and len(proof["after_space"]) > 10_000
    assert all(len(sp.encode(s)) == 1 for s in proof["after_space"])
    # without the proof texts are encoded whole, with the same result
    texts = [t for _, t in edge_rows()]
    assert counter(tokenizer_file(MODEL), {**proof, "cut": False})(texts) == counter(tokenizer_file(MODEL), proof)(texts)


def test_token_limit_and_empty_table(spark):
    df = frame(spark, [(1, "a b c"), (2, "a")])
    assert collected(token_counts(df, tokenizer_file(MODEL), limit=2).select("doc_id", "over_limit")) == [(1, True), (2, False)]
    assert token_counts(df.limit(0), tokenizer_file(MODEL)).collect() == []


@pytest.fixture(scope="module")
def ranks():
    return read_ranks(tokenizer_file(RANKS))


def test_byte_bpe_equals_the_library_and_round_trips(spark, ranks):
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = edge_rows() + [(r.doc_id, r.text) for r in documents(spark).select("doc_id", "text").collect()]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = sorted(((i, ids, len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode()))
                   for i, t in rows for ids in [enc.encode_ordinary(t or "")]), key=repr)
    out = encode_decode(frame(spark, rows), tokenizer_file(RANKS), P.PATTERN)
    assert collected(out) == want
    texts = collected(decode_ids(out, tokenizer_file(RANKS)))
    assert texts == sorted(((i, t or "") for i, t in rows), key=repr)
    assert encode_decode(frame(spark, rows).limit(0), tokenizer_file(RANKS), P.PATTERN).collect() == []


def test_replay_agrees_with_merging_one_by_one(ranks):
    words = [b"aaaaaaaa", b"abababab", b" the", b"theinganderes", b"\xff\xfe", b"zzzz" * 40, "réalité".encode()]
    flat, sizes = replay(words, Merges(ranks))
    got, at = [], 0
    for n in sizes.tolist():
        got.append(flat[at:at + n].tolist())
        at += n
    assert got == [replay_one(w, ranks) for w in words]
    assert all(b"".join({i: t for t, i in ranks.items()}[x] for x in ids) == w for ids, w in zip(got, words))


def test_rank_file_must_hold_all_bytes(spark):
    with pytest.raises(ValueError, match="single bytes"):
        encode_decode(frame(spark, [(1, "a")]), b"YQ== 0\n", P.PATTERN)
