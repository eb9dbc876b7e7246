"""Hand fixtures (FIXTURES.md section 3) and brute-force comparisons with plain Python."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicpulse.functions import labels as L
from topicpulse.functions import text as T
from topicpulse.functions import wordlists as W


def one_col(spark, values, expr, schema="s string"):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in df.select(expr(F.col(df.columns[0]))).collect()]


# ------------------------------------------------------------------ B1, C1, C2, C3
def test_normalise_text(spark):
    texts = [None, "", "   ", "a\t  b\n", "x" * 10001]
    assert one_col(spark, texts, T.normalise_text) == ["", "", "", "a b", "x" * 10001]
    assert len(one_col(spark, texts, lambda c: T.normalise_text(c, 10_000))[4]) == 10_000


def test_full_text_leading_space(spark):
    df = spark.createDataFrame([(None, "body"), ("", "body"), ("T", None)], "t string, c string")
    assert [r[0] for r in df.select(T.full_text("t", "c")).collect()] == [" body", " body", "T "]


CLEANED = [("visit https://x.org/a?b=1 now", "visit now"), ("www.site.com rocks", "rocks"),
           ("  tabs\tand\u00a0nbsp  ", "tabs and nbsp"), ("see http://a.b", "see"), ("", ""), ("Fish &amp; chips", "Fish &amp; chips")]
PREPROCESSED = [("menu/items are good", "men are good"),     # the u/ rule bites mid-word
                ("see /r/python and /u/someone", "see and"), ("Fish &amp; chips", "fish chips"),
                ("Caf\u00e9 d\u00e9j\u00e0 vu!!", "caf\u00e9 d\u00e9j\u00e0 vu!!"), ("visit https://x.org/a?b=1 now", "visit now"),
                ("It's 5 > 4, *really*?", "it's 5 4, really?"), ("   ", ""), (None, "")]


@pytest.mark.parametrize("rule, pairs", [(T.strip_urls, CLEANED), (T.preprocess, PREPROCESSED)])
def test_cleaning(spark, rule, pairs):
    assert one_col(spark, [x for x, _ in pairs], rule) == [y for _, y in pairs]


# ------------------------------------------------------------------ C5-C8, C14
def test_label_thresholds(spark):
    vals = [0.05, 0.0499, -0.05, -0.0499, 0.2, 0.2001, -0.2, -0.2001, 0.5, 0.5001, -0.5, -0.5001,
            0.6, 0.6001, -0.6, -0.6001, None]
    df = spark.createDataFrame([(v,) for v in vals], "s double")
    rows = df.select(L.label3("s"), L.label5("s"), L.label5_display("s"), L.polarity3("s"),
                     L.scale_0_100("s")).collect()
    got = {v: tuple(r) for v, r in zip(vals, rows)}
    assert got[0.05][0] == "positive" and got[0.0499][0] == "neutral"
    assert got[-0.05][0] == "negative" and got[-0.0499][0] == "neutral"
    assert got[-0.6][1] == "very_negative" and got[-0.6001][1] == "very_negative" and got[-0.2][1] == "negative"
    assert got[0.2][1] == "neutral" and got[0.2001][1] == "positive" and got[0.6][1] == "positive"
    assert got[0.6001][1] == "very_positive"
    assert got[0.5][2] == "Positive" and got[0.5001][2] == "Very Positive" and got[-0.5][2] == "Very Negative"
    assert got[-0.2][2] == "Negative" and got[0.2][2] == "Neutral"
    assert got[0.2][3] == "neutral" and got[0.2001][3] == "positive" and got[-0.2001][3] == "negative"
    assert got[None][0] is None and got[None][3] is None and got[None][2] == "Neutral"
    assert got[0.5][4] == pytest.approx(75.0)


# ------------------------------------------------------------------------- C9
def test_class_probs_score_matches_numpy(spark):
    rng = np.random.default_rng(7)
    logits = [list(map(float, rng.normal(size=5))) for _ in range(50)] + [[0.0] * 5]
    df = spark.createDataFrame([(x,) for x in logits], "l array<double>")
    got = df.select(L.class_probs_score("l").alias("r")).select("r.*").collect()
    for x, r in zip(logits, got):
        p = np.exp(x) / np.exp(x).sum()
        s = float((p * np.array(W.CLASS_WEIGHTS)).sum())
        assert r.score == pytest.approx(round(s, 4), abs=1e-4)
        assert r.confidence == pytest.approx(round(float(p.max()), 4), abs=1e-4)
        assert r.predicted_class == int(p.argmax())


# ------------------------------------------------------------------------ C10
KEYWORDS = [("beta alpha beta alpha gamma", ["beta", "alpha", "gamma"]),     # ties by first occurrence
            ("a bit odd", []), ("the they them their which would", []), ("", []),
            ("Zeta zeta ZETA omega omega", ["zeta", "omega"]),
            ("one-two words, words! snake_case words2", ["words", "snake_case", "words2"]),
            ("aaaa bbbb cccc dddd eeee ffff", ["aaaa", "bbbb", "cccc", "dddd", "eeee"])]


def test_post_keywords(spark):
    from topicpulse.operators.keywords import post_keywords
    from topicpulse.sources.tables import keyword_stopwords
    df = spark.createDataFrame([(str(i), t) for i, (t, _) in enumerate(KEYWORDS)], "post_id string, cleaned_text string")
    got = {r.post_id: list(r.keywords) for r in post_keywords(df, keyword_stopwords(spark)).collect()}
    assert got == {str(i): k for i, (_, k) in enumerate(KEYWORDS)}


# ------------------------------------------------------------------------ C12
EN_STOP = set(W.words(W.ENGLISH_STOPWORDS_TEXT + " " + W.SITE_STOPWORDS_TEXT))
ENTITIES = [
    ("Apple Inc met The Board", [("ORG_OR_PERSON", "Apple Inc"), ("ORG_OR_PERSON", "The Board")]),
    ("Alpha, Beta, Gamma, Delta, Epsilon, Zeta", [("ORG_OR_PERSON", x) for x in "Alpha Beta Gamma Delta Epsilon Zeta".split()]),
    ("costs $1,200.50 or 300 dollars or 5 USD and $7 then $8", [("MONEY", x) for x in ("$1,200.50", "300 dollars", "5 USD", "$7", "$8")]),
    ("grew 4.5% and 10% and 3% and 7%", [("PERCENT", x) for x in ("4.5%", "10%", "3%", "7%")]),
    ("\u00dcnder \u00c9clair Bob", [("ORG_OR_PERSON", "Bob")]), ("The An It", [("ORG_OR_PERSON", "The An It")]), ("The", []),
]


def test_entities(spark):
    df = spark.createDataFrame([(t,) for t, _ in ENTITIES], "t string")
    got = df.select(T.entities("t", sorted(EN_STOP)).alias("e")).collect()
    assert [[(e.entity_type, e.text) for e in r.e] for r in got] == [want for _, want in ENTITIES]
    capped = df.select(T.entities("t", sorted(EN_STOP), caps=(5, 3, 3)).alias("e")).collect()
    assert [len(r.e) for r in capped] == [2, 5, 3, 3, 1, 1, 0]


def test_short_texts_are_neutral_without_confidence(spark):
    df = spark.createDataFrame([("ab", [5.0, 0.0, 0.0, 0.0, 0.0]), (None, [5.0, 0.0, 0.0, 0.0, 0.0]),
                                ("abc", [5.0, 0.0, 0.0, 0.0, 0.0])], "t string, l array<double>")
    out = df.select(L.short_text_default("t", L.class_probs_score("l")).alias("r")).select("r.*").collect()
    assert [(r.score, r.confidence, r.predicted_class, r.label) for r in out[:2]] == [(0.0, 0.0, None, "neutral")] * 2
    assert out[2].predicted_class == 0


def test_softmax_of_large_logits(spark):
    df = spark.createDataFrame([([800.0, 0.0, 0.0, 0.0, 0.0],), ([-800.0] * 5,)], "l array<double>")
    a, b = df.select(L.class_probs_score("l").alias("r")).select("r.*").collect()
    assert (a.score, a.confidence, a.predicted_class, a.label) == (-1.0, 1.0, 0, "very_negative")
    assert (b.score, b.confidence, b.predicted_class) == (0.0, 0.2, 0)


# ------------------------------------------------------------------------ C4, C13
LEX = [("good", 1.9), ("bad", -2.5)]


def compound(s):
    return round(s / math.sqrt(s * s + 15), 4)


@pytest.mark.parametrize("text,expected", [
    ("good", compound(1.9)),
    ("not good", compound(1.9 * -0.74)),
    ("very good", compound(1.9 + 0.293)),
    ("GOOD movie", compound(1.9 + 0.733)),
    ("good!!!", compound(1.9 + 3 * 0.292)),
    ("good!!!!!!", compound(1.9 + 4 * 0.292)),
    ("good but bad", compound(1.9 * 0.5 - 2.5 * 1.5)),
    ("not a very bad thing", compound((-2.5 - 0.293) * -0.74)),
    ("nothing here", 0.0),
    ("good?", compound(1.9)),
    ("good??", compound(1.9 + 2 * 0.18)),
    ("good????", compound(1.9 + 0.96)),
    ("least good", compound(1.9 * -0.74)),
    ("at least good", compound(1.9)),
    # phrases and "never so", "without doubt"
    ("kind of good", compound(1.9 - 0.293)),
    ("kind of a good", compound(1.9 - 0.293)),                       # a one-letter word is no token
    ("kind of the good", compound(1.9 - 0.293 * 0.95)),
    ("Sort, of GOOD stuff", compound(1.9 + 0.733 - 0.293)),
    ("kind good of", compound(1.9)),
    ("never good", compound(1.9 * -0.74)),
    ("never so good", compound((1.9 + 0.293) * 1.25)),
    ("never this good", compound(1.9 * 1.25)),
    ("never was so good", compound((1.9 + 0.293) * 1.25)),
    ("never was good", compound(1.9 * -0.74)),
    ("without doubt good", compound(1.9)),
    ("without any doubt good", compound(1.9)),
    ("without good", compound(1.9 * -0.74)),
    ("not without doubt good", compound(1.9 * -0.74)),
    ("kiss of death", compound(-1.5)),
    ("not the kiss of death", compound(-1.5 * -0.74)),
    ("very bad ass", compound(1.5 + 0.293)),                         # the idiom's value, not that of "bad"
    ("bad as such", compound(-2.5)),
    ("to die for but the bomb", compound(3 * 0.5 + 3 * 1.5)),
])
def test_lexicon_modifiers(spark, text, expected):
    from topicpulse.operators.lexicon import lexicon_scores
    posts = spark.createDataFrame([("p", text)], "post_id string, cleaned_text string")
    lex = spark.createDataFrame(LEX, "word string, valence double")
    r = lexicon_scores(posts, lex).collect()[0]
    assert r.compound == pytest.approx(expected, abs=1e-4)
    assert r.pos + r.neg + r.neu == pytest.approx(1.0, abs=2e-3)


def test_blank_text_defaults(spark):
    from topicpulse.plans.scoring import score_posts
    from topicpulse.sources.tables import keyword_stopwords
    rows = [("a", "", None), ("b", None, "   "), ("c", "", "http://only.example/url"), ("d", "Good", "stuff")]
    posts = spark.createDataFrame(rows, "post_id string, title string, content string") \
        .withColumn("topic", F.lit("t"))
    lex = spark.createDataFrame(LEX, "word string, valence double")
    out = {r.post_id: r for r in score_posts(posts, lex, keyword_stopwords(spark), [], "2024-01-31").collect()}
    for pid in "abc":
        r = out[pid]
        assert (r.sentiment_score, r.sentiment_label, r.confidence, list(r.keywords)) == (0.0, "neutral", 0.5, [])
    assert out["d"].sentiment_label == "positive" and out["d"].sentiment_e4 == round(compound(1.9) * 10000)
