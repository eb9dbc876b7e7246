"""Registration, the pipeline against brute force, and the SQL oracles of this subpackage."""

import os
import sys

import duckdb
import public_tokenizers as P
import tiktoken

import __spark_entry__ as E
import corpus_pipeline as C
from topicpulse.llm import decontaminate as D
from topicpulse.llm import quality_rules as R
from topicpulse.llm.byte_bpe import read_ranks
from topicpulse.llm.queries import ORACLE, QUERIES, tokenizer_file

from conftest import ROOT, SF_SMALL
from test_llm_dedup import brute_leaks, brute_spans, first_of_each

sys.path.insert(0, os.path.join(ROOT, "scripts"))
from check_oracle import rows_of, type_diff  # noqa: E402


def test_operators_and_the_pipeline_are_registered():
    names = set(E.queries())
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= names
    assert [n for n, _ in C.STAGES] == ["quality", "near_duplicates", "repeated_passages", "benchmark_leaks", "encode"]


def test_sql_oracles(spark):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    for name, sql in ORACLE.items():
        frame = QUERIES[name](spark, SF_SMALL)
        assert type_diff(frame, con, sql) == {}
        assert rows_of(frame.toPandas()) == rows_of(con.execute(sql).df())


def test_pipeline_matches_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    docs = [(i, t) for i, t in docs if all(r.passes(R.Profile(t)) for r in R.RULES)]
    docs = [(i, t) for i, t, _, _ in brute_spans(first_of_each(docs))]
    leaked = {i for i, _ in brute_leaks(docs, items)}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, special_tokens={},
                            mergeable_ranks=read_ranks(tokenizer_file("byte_bpe_multi_50k.tiktoken")))
    want = {i: enc.encode_ordinary(t) for i, t in docs if i not in leaked}
    got = {r["doc_id"]: r["ids"] for r in C.run(spark, SF_SMALL).collect()}
    assert got == want and leaked


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    n = docs.count()
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, SF_SMALL)
        assert out.dtypes == docs.dtypes, name
        assert out.count() <= n
        assert stage(spark, docs.limit(0), SF_SMALL).collect() == []
    assert C.STAGES[-1][1](spark, docs, SF_SMALL).count() == n
