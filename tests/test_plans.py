"""Physical plan checks: no Python evaluation, pushdown, top-k pruning, broadcast where meant."""

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(E.queries()) - set(E.LLM_QUERIES)))
def test_no_python_udf(spark, name):
    p = plan(E.queries()[name](spark, SF_SMALL))
    assert "EvalPython" not in p and "PythonUDF" not in p


def test_top_keywords_uses_window_group_limit(spark):
    assert "WindowGroupLimit" in plan(E.queries()["top_keywords"](spark, SF_SMALL))


def test_lookback_filter_reaches_parquet(spark, tmpdir_path):
    from topicpulse.sources.tables import AS_OF, scan_lookback
    from topicpulse.sources.testdata import scored_from_events
    path = f"{tmpdir_path}/scored"
    scored_from_events(spark, SF_SMALL).write.parquet(path)
    df = scan_lookback(path, spark, as_of=AS_OF, hours=24).select("post_id")
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(processed_at), GreaterThanOrEqual(processed_at" in p
    assert "ReadSchema: struct<post_id:string,processed_at:timestamp>" in p


def test_post_keywords_shuffles_text_once(spark):
    from topicpulse.operators.keywords import by_post, post_keywords
    from topicpulse.sources.tables import keyword_stopwords
    from topicpulse.sources.testdata import posts_from_documents
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        d = by_post(posts_from_documents(spark, SF_SMALL).select("post_id", "content"))
        df = post_keywords(d.withColumnRenamed("content", "cleaned_text"), keyword_stopwords(spark))
        p = plan(df)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    # the text is hash-partitioned by post_id once; the aggregate, rank and collect add
    # no exchange and need no join back to the posts
    assert p.count("Exchange hashpartitioning(post_id") == 1
    assert "BroadcastHashJoin" in p  # the optimizer knows that the stop words are few


@pytest.mark.parametrize("name", sorted(set(E.queries()) - set(E.LLM_QUERIES)))
def test_no_cross_join(spark, name):
    p = plan(E.queries()[name](spark, SF_SMALL))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


@pytest.mark.parametrize("name", ["post_keywords", "top_keywords", "frequent_keywords", "frequent_keywords_bounds"])
def test_keywords_are_counted_in_the_posts_row(spark, name):
    # no row for each token, grouped by post or shuffled with its text
    p = plan(E.queries()[name](spark, SF_SMALL))
    assert "keys=[post_id" not in p and "hashpartitioning(post_id" not in p


@pytest.mark.parametrize("name", ["lexicon_score", "lexicon_score_phrases"])
def test_lexicon_tokens_are_made_once(spark, name):
    # the edge punctuation's pattern stands once in the plan, and not below a filter that tells posts without tokens
    from topicpulse.operators.lexicon import EDGE_PUNCT
    p = E.queries()[name](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert p.count(EDGE_PUNCT) == 1


def test_word_cloud_does_not_shuffle_texts(spark):
    p = plan(E.queries()["word_cloud"](spark, SF_SMALL))
    above = [line for line in p.splitlines() if "Exchange hashpartitioning(post_id" in line]
    assert len(above) == 2      # the posts with their keywords, and the scores
