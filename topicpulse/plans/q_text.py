"""Registered queries: the text layer."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import wordlists as W
from ..functions.labels import class_probs_score, short_text_default
from ..operators import aggregates as A
from ..operators.heavy import frequent_keywords, keyword_summary, merge_summaries
from ..operators.keywords import CONTRACTION, NOUN_RULES, by_post, derive_lemmas, irregular_nouns, keyword_rows, lemma_tokens, \
    post_keywords, \
    post_keywords_lemma, top_keywords
from ..operators.lexicon import lexicon_scores
from ..session import new_folder
from ..sources import tables as TB
from ..sources.testdata import comments_from_conversations, html_texts, logits_from_embeddings, \
    posts_from_documents
from .catalog import register
from .scoring import score_posts
from .sql import AVG_E4, STD_E4, with_


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(ws) -> str:
    return "[" + ", ".join(q(w) for w in ws) + "]"


WS, NOT_WS, WSI = T.WS, T.NOT_WS, T.WS_INNER
KW_STOP = sql_list(W.words(W.KEYWORD_STOPWORDS_TEXT))
EN_STOP = sql_list(W.words(W.ENGLISH_STOPWORDS_TEXT + " " + W.SITE_STOPWORDS_TEXT))


def collapse_sql(x: str) -> str:
    return f"trim(regexp_replace({x}, {q(WS + '+')}, ' ', 'g'))"


def strip_urls_sql(x: str) -> str:
    return collapse_sql(f"regexp_replace({x}, {q(T.URL)}, '', 'g')")


def preprocess_sql(x: str) -> str:
    y = f"lower({x})"
    y = f"regexp_replace({y}, {q(f'http{NOT_WS}+|www{NOT_WS}+|https{NOT_WS}+')}, '', 'g')"
    for pat in (rf"/r/{T.WORD}+", rf"/u/{T.WORD}+", rf"u/{T.WORD}+", rf"&{T.WORD}+;"):
        y = f"regexp_replace({y}, {q(pat)}, '', 'g')"
    y = f"regexp_replace({y}, {q(rf'[^\p{{L}}\p{{N}}_{WSI}!?.,' + chr(39) + r'\-]')}, '', 'g')"
    return f"coalesce({collapse_sql(y)}, '')"


DOCS = f"""
docs AS (
  SELECT CAST(doc_id AS VARCHAR) AS post_id, lang AS topic, source AS subreddit, text AS content,
         concat_ws(' ', '', coalesce(text, '')) AS full_text
  FROM documents),
clean AS (SELECT *, {strip_urls_sql('full_text')} AS cleaned FROM docs)
"""

KW_TOKENS = f"""
ktoks AS (
  SELECT post_id, list_filter(string_split({collapse_sql(
      f"regexp_replace(lower(cleaned), {q(rf'[^\p{{L}}\p{{N}}_{WSI}]')}, ' ', 'g')")}, ' '), lambda w: length(w) > 0) AS toks
  FROM clean),
ktok AS (SELECT post_id, unnest(toks) AS word, generate_subscripts(toks, 1) AS pos FROM ktoks)
"""

KEYWORDS = f"""
kcnt AS (
  SELECT post_id, word, count(*) AS cnt, min(pos) AS first_pos FROM ktok
  WHERE length(word) >= 4 AND NOT list_contains({KW_STOP}, word) GROUP BY 1, 2),
krk AS (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY cnt DESC, first_pos) AS rank FROM kcnt),
kw AS (SELECT post_id, list(word ORDER BY rank) AS kwl FROM krk WHERE rank <= 5 GROUP BY 1),
post_kw AS (SELECT c.post_id, c.topic, coalesce(kw.kwl, []) AS keywords FROM clean c LEFT JOIN kw USING (post_id))
"""


def _docs(spark, base):
    return posts_from_documents(spark, base)


def _clean_docs(spark, base):
    d = _docs(spark, base)
    return d.select("post_id", "topic", T.strip_urls(T.full_text("title", "content")).alias("cleaned_text"))


# ------------------------------------------------------------------ C1, C2, C3, B1
@register("full_text", with_(DOCS) + "SELECT post_id, full_text, CAST(length(full_text) AS INTEGER) AS n FROM docs")
def q_full_text(spark, base):
    d = _docs(spark, base).select("post_id", T.full_text("title", "content").alias("full_text"))
    return d.select("post_id", "full_text", F.length("full_text").alias("n"))


@register("strip_urls", f"""
SELECT page_id, {strip_urls_sql('html')} AS cleaned_text, substring({strip_urls_sql('html')}, 1, 500) AS display_text
FROM pages""")
def q_strip_urls(spark, base):
    h = html_texts(spark, base)
    return h.select("page_id", T.strip_urls("text").alias("cleaned_text"), T.display_text("text").alias("display_text"))


@register("preprocess", f"SELECT page_id, {preprocess_sql('html')} AS pre_text FROM pages")
def q_preprocess(spark, base):
    return html_texts(spark, base).select("page_id", T.preprocess("text").alias("pre_text"))


@register("normalise_text", f"""
SELECT CAST(doc_id AS VARCHAR) AS post_id, coalesce({collapse_sql('text')}, '') AS content,
       CAST(length(coalesce({collapse_sql('text')}, '')) AS INTEGER) AS n
FROM documents""")
def q_normalise_text(spark, base):
    d = _docs(spark, base).select("post_id", T.normalise_text("content").alias("content"))
    return d.select("post_id", "content", F.length("content").alias("n"))


@register("split_list", f"""
SELECT conv_id, turn,
       array_to_string(list_filter(list_transform(string_split(text, ','), lambda s: trim(s)), lambda s: length(s) > 0), '|')
         AS parts,
       CAST(length(list_filter(list_transform(string_split(text, ','), lambda s: trim(s)), lambda s: length(s) > 0))
         AS INTEGER) AS n_parts
FROM conversations""")
def q_split_list(spark, base):
    c = TB.read_table(spark, base, "conversations").select("conv_id", "turn", T.split_list("text").alias("p"))
    return c.select("conv_id", "turn", F.array_join("p", "|").alias("parts"), F.size("p").alias("n_parts"))


# ------------------------------------------------------------------------- C9
@register("class_probs_score", """
WITH e AS (SELECT vec_id, list_transform([0, 1, 2, 3, 4], lambda c: list_reduce(list_prepend(0.0::DOUBLE,
             list_transform(list_filter(embedding, lambda x, i: (i - 1) % 5 = c), lambda x: CAST(x AS DOUBLE))),
             lambda a, b: a + b)) AS logits FROM embeddings),
ex AS (SELECT vec_id, list_transform(logits, lambda x: exp(x - list_max(logits))) AS ex FROM e),
pr AS (SELECT vec_id, list_transform(ex, lambda x: x / list_reduce(ex, lambda a, b: a + b)) AS probs FROM ex),
sc AS (SELECT vec_id, probs,
              list_reduce(list_transform(probs, lambda p, i: p * [-1.0, -0.5, 0.0, 0.5, 1.0][i]), lambda a, b: a + b) AS s,
              list_max(probs) AS c FROM pr)
SELECT vec_id, round(s, 4) AS score, round(c, 4) AS confidence,
       CAST(list_position(probs, c) - 1 AS INTEGER) AS predicted_class,
       CASE WHEN s <= -0.6 THEN 'very_negative' WHEN s <= -0.2 THEN 'negative' WHEN s <= 0.2 THEN 'neutral'
            WHEN s <= 0.6 THEN 'positive' ELSE 'very_positive' END AS label
FROM sc""")
def q_class_probs_score(spark, base):
    return logits_from_embeddings(spark, base).select("vec_id", class_probs_score("logits").alias("r")) \
        .select("vec_id", "r.*")


@register("class_probs_short_texts", with_("t AS (SELECT conv_id, turn, split_part(text, ' ', 1) AS w FROM conversations)", f"""
pre AS (SELECT conv_id, turn, {preprocess_sql('w')} AS pre_text FROM t)""", """
lg AS (SELECT *, [CAST((length(pre_text) * k) % 7 AS DOUBLE) FOR k IN [1, 2, 3, 4, 5]] AS logits FROM pre)""", """
ex AS (SELECT *, list_transform(logits, lambda x: exp(x - list_max(logits))) AS ex FROM lg)""", """
pr AS (SELECT *, list_transform(ex, lambda x: x / list_reduce(ex, lambda a, b: a + b)) AS probs FROM ex)""", """
sc AS (SELECT *, list_max(probs) AS c,
              list_reduce(list_transform(probs, lambda p, i: p * [-1.0, -0.5, 0.0, 0.5, 1.0][i]), lambda a, b: a + b) AS s
       FROM pr)""") + """
SELECT conv_id, turn, CASE WHEN length(pre_text) < 3 THEN 0.0 ELSE round(s, 4) END AS score,
       CASE WHEN length(pre_text) < 3 THEN 0.0 ELSE round(c, 4) END AS confidence,
       CASE WHEN length(pre_text) >= 3 THEN CAST(list_position(probs, c) - 1 AS INTEGER) ELSE -1 END AS predicted_class,
       CASE WHEN length(pre_text) < 3 THEN 'neutral' WHEN s <= -0.6 THEN 'very_negative' WHEN s <= -0.2 THEN 'negative'
            WHEN s <= 0.2 THEN 'neutral' WHEN s <= 0.6 THEN 'positive' ELSE 'very_positive' END AS label
FROM sc""")
def q_class_probs_short_texts(spark, base):
    """C9 with C13's default: the first word of every turn, which often has under three characters, as a text of its own."""
    c = TB.read_table(spark, base, "conversations").select(
        "conv_id", "turn", T.preprocess(F.split_part("text", F.lit(" "), F.lit(1))).alias("pre_text"))
    logits = F.array(*[((F.length("pre_text") * k) % 7).cast("double") for k in range(1, 6)])
    return c.select("conv_id", "turn", short_text_default("pre_text", class_probs_score(logits)).alias("r")) \
        .select("conv_id", "turn", "r.*").withColumn("predicted_class", F.coalesce("predicted_class", F.lit(-1)))


# ------------------------------------------------------------------------ C10, D4, H2
@register("post_keywords", with_(DOCS, KW_TOKENS, KEYWORDS) +
          "SELECT post_id, array_to_string(keywords, ' ') AS keywords FROM post_kw")
def q_post_keywords(spark, base):
    kw = post_keywords(_clean_docs(spark, base), TB.keyword_stopwords(spark))
    return kw.select("post_id", F.array_join("keywords", " ").alias("keywords"))


@register("top_keywords", with_(DOCS, KW_TOKENS, KEYWORDS) + """
SELECT * FROM (
  SELECT topic, keyword, count(*) AS "count",
         CAST(row_number() OVER (PARTITION BY topic ORDER BY count(*) DESC, keyword) AS INTEGER) AS rank
  FROM (SELECT topic, unnest(keywords) AS keyword FROM post_kw) GROUP BY 1, 2)
WHERE rank <= 20""")
def q_top_keywords(spark, base):
    return top_keywords(post_keywords(_clean_docs(spark, base), TB.keyword_stopwords(spark), keep=("topic",)), 20)


# ------------------------------------------------------ D4, H2 from mergeable summaries
HEAVY = 64      # keywords a summary holds
SOURCE_KEYWORDS = """
skc AS (SELECT d.topic, d.subreddit, k.keyword, count(*) AS n
        FROM docs d JOIN (SELECT post_id, unnest(keywords) AS keyword FROM post_kw) k USING (post_id) GROUP BY 1, 2, 3)
"""
SUMMARIES = f"""
sr AS (SELECT *, row_number() OVER (PARTITION BY topic, subreddit ORDER BY n DESC, keyword) AS r FROM skc),
sl AS (SELECT topic, subreddit, coalesce(max(n) FILTER (r = {HEAVY + 1}), 0) AS less FROM sr GROUP BY 1, 2),
mc AS (SELECT topic, keyword, sum(n - less) AS n FROM sr JOIN sl USING (topic, subreddit)
       WHERE r <= {HEAVY} AND n > less GROUP BY 1, 2),
mr AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY n DESC, keyword) AS r FROM mc),
ml AS (SELECT topic, coalesce(max(n) FILTER (r = {HEAVY + 1}), 0) AS less FROM mr GROUP BY 1),
me AS (SELECT topic, ml.less, ml.less + sum(sl.less) AS error FROM ml JOIN sl USING (topic) GROUP BY 1, 2),
ms AS (SELECT topic, keyword, n - less AS n, error FROM mr JOIN me USING (topic) WHERE r <= {HEAVY} AND n > less)
"""


def _source_keywords(spark, base):
    d = _docs(spark, base).select("post_id", "topic", "subreddit",
                                  T.strip_urls(T.full_text("title", "content")).alias("cleaned_text"))
    kw = post_keywords(d, TB.keyword_stopwords(spark), keep=("topic", "subreddit"))
    # counts, totals and cuts are several readings: the texts are tokenised for none of them again
    path = new_folder(spark, "keywords")
    kw.write.parquet(path)
    return spark.read.parquet(path)


def _merged_summary(scored):
    """Summaries of every topic and source, merged to one of each topic."""
    by_source = keyword_summary(scored.withColumn("topic", F.concat_ws("|", "topic", "subreddit")), HEAVY)
    return merge_summaries(by_source.withColumn("topic", F.split_part("topic", F.lit("|"), F.lit(1))), HEAVY)


@register("frequent_keywords", with_(DOCS, KW_TOKENS, KEYWORDS, SOURCE_KEYWORDS, SUMMARIES) + """
SELECT topic, keyword, CAST(n AS BIGINT) AS least, CAST(n + error AS BIGINT) AS most,
       n >= beyond + error AS certain, CAST(r AS INTEGER) AS rank
FROM (SELECT *, coalesce(lead(n, 21 - CAST(r AS INTEGER)) OVER w, 0) AS beyond
      FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY n DESC, keyword) AS r FROM ms)
      WINDOW w AS (PARTITION BY topic ORDER BY r)) WHERE r <= 20""")
def q_frequent_keywords(spark, base):
    return frequent_keywords(_merged_summary(_source_keywords(spark, base)), 20)


@register("frequent_keywords_bounds", with_(DOCS, KW_TOKENS, KEYWORDS, SOURCE_KEYWORDS) + """
SELECT topic, keyword, CAST(sum(n) AS BIGINT) AS "count", true AS within, true AS bounded FROM skc GROUP BY 1, 2""")
def q_frequent_keywords_bounds(spark, base):
    """Every keyword's exact count against the merged summary: within its bounds, and the error as small as it is said to be."""
    scored = _source_keywords(spark, base)
    summary = _merged_summary(scored)
    exact = keyword_rows(scored.select("topic", "keywords")).groupBy("topic", "keyword").agg(
        F.count(F.lit(1)).alias("count"))
    errors = summary.where("keyword IS NULL").select("topic", "error", "total")
    least = summary.where("keyword IS NOT NULL").select("topic", "keyword", F.col("count").alias("least"))
    e = exact.join(errors, "topic", "left").join(least, ["topic", "keyword"], "left")
    low = F.coalesce("least", F.lit(0))
    return e.select("topic", "keyword", "count", F.col("count").between(low, low + F.col("error")).alias("within"),
                    (F.col("error") * (HEAVY + 1) <= F.col("total")).alias("bounded"))


# -------------------------------------------------------------------------- C11
LEMMA_RULES_SQL = "(VALUES " + ", ".join(f"({i}, {q(s)}, {q(r)})" for i, (s, r) in enumerate(NOUN_RULES)) + \
    ") r(rule, suf, rep)"
LEMMA_TOKENS = f"""
pre AS (SELECT post_id, {preprocess_sql('full_text')} AS pre_text FROM docs),
ltoks AS (
  SELECT post_id, list_filter(list_transform(string_split(regexp_replace(lower(pre_text), '[!?.,\\s]+', ' ', 'g'), ' '),
                                             lambda t: regexp_extract(t, {q(CONTRACTION)}, 1)),
                              lambda t: length(t) > 0) AS toks
  FROM pre),
ltok AS (SELECT post_id, unnest(toks) AS word, generate_subscripts(toks, 1) AS pos FROM ltoks),
vocab AS (SELECT DISTINCT word FROM ltok),
cand AS (
  SELECT v.word, r.rule, left(v.word, length(v.word) - length(r.suf)) || r.rep AS base
  FROM vocab v JOIN {LEMMA_RULES_SQL} ON suffix(v.word, r.suf) AND length(v.word) > length(r.suf)),
irregular AS (SELECT * FROM (VALUES {", ".join(f"({q(w)}, {q(b)})" for w, b in map(str.split, W.phrase_lines(W.IRREGULAR_NOUNS_TEXT)))}) x(word, base)),
lemmas AS (
  SELECT word, base FROM (
    SELECT word, arg_min(base, length(base) * 100 + rule) AS base FROM cand
    WHERE base IN (SELECT word FROM vocab) AND word NOT IN (SELECT word FROM irregular) GROUP BY word)
  WHERE length(base) < length(word)
  UNION ALL SELECT word, base FROM irregular WHERE word IN (SELECT word FROM vocab))
"""


@register("lemma_table", with_(DOCS, LEMMA_TOKENS) + "SELECT * FROM lemmas")
def q_lemma_table(spark, base):
    d = _docs(spark, base).select("post_id", T.preprocess(T.full_text("title", "content")).alias("pre_text"))
    return derive_lemmas(lemma_tokens(d).select("word"), irregular_nouns(spark))


@register("post_keywords_lemma", with_(DOCS, LEMMA_TOKENS) + f""",
lt AS (SELECT post_id, word, pos FROM ltok WHERE length(word) >= 3 AND NOT list_contains({EN_STOP}, word)),
lw AS (SELECT lt.post_id, lt.pos, coalesce(l.base, lt.word) AS word FROM lt LEFT JOIN lemmas l USING (word)),
lc AS (SELECT post_id, word, count(*) AS cnt, min(pos) AS first_pos FROM lw GROUP BY 1, 2),
lr AS (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY cnt DESC, first_pos) AS rank FROM lc),
lk AS (SELECT post_id, string_agg(word, ' ' ORDER BY rank) AS keywords FROM lr WHERE rank <= 10 GROUP BY 1)
SELECT d.post_id, coalesce(lk.keywords, '') AS keywords FROM docs d LEFT JOIN lk USING (post_id)""")
def q_post_keywords_lemma(spark, base):
    d = by_post(_docs(spark, base).select("post_id",
                                          T.preprocess(T.full_text("title", "content")).alias("pre_text")))
    kw = post_keywords_lemma(d, TB.english_stopwords(spark))
    return kw.select("post_id", F.array_join("keywords", " ").alias("keywords"))


# -------------------------------------------------------------------------- C12
@register("entities")
def q_entities(spark, base):
    stop = W.words(W.ENGLISH_STOPWORDS_TEXT + " " + W.SITE_STOPWORDS_TEXT)
    d = _docs(spark, base).select("post_id", T.full_text("title", "content").alias("t"))
    e = d.select("post_id", T.entities("t", stop).alias("entities"))
    return e.select("post_id", T.entities_flat("entities").alias("entities"), F.size("entities").alias("n"))


# ---------------------------------------------------------------------- C4, C13
@register("lexicon_score", None)
def q_lexicon_score(spark, base):
    d = _clean_docs(spark, base)
    return lexicon_scores(d, TB.seed_lexicon(spark))


def _scored_docs(spark, base):
    from ..operators.ingest import unify
    posts = unify(_docs(spark, base), comments_from_conversations(spark, base))
    stop = W.words(W.ENGLISH_STOPWORDS_TEXT + " " + W.SITE_STOPWORDS_TEXT)
    return score_posts(posts, TB.seed_lexicon(spark), TB.keyword_stopwords(spark), stop,
                       processed_at=TB.AS_OF)


@register("scored_posts")
def q_scored_posts(spark, base):
    s = _scored_docs(spark, base)
    return s.select("post_id", "topic", "is_comment", "sentiment_score", "sentiment_label", "confidence",
                    F.array_join("keywords", " ").alias("keywords"), F.length("cleaned_text").alias("cleaned_chars"),
                    F.length("display_text").alias("display_chars"))


# ---------------------------------------------------------- C4 oracle (SQL form)
def lexicon_sql(src: str, text: str, p=None) -> str:
    """SQL of ``lexicon_scores`` over CTE ``src`` with columns (post_id, ``text``); needs a
    ``lexicon(lc, valence)`` CTE. Produces CTE ``lex_scores``."""
    from ..operators.lexicon import EDGE_PUNCT, Params
    p = p or Params()
    up, down, neg = sql_list(p.boosters_up), sql_list(p.boosters_down), sql_list(p.negators)
    edge = q(EDGE_PUNCT)
    is_cap = "(x = upper(x) AND x <> lower(x))"

    def prev(k):
        return f"(CASE WHEN j - 1 - {k} >= 0 THEN lcs[j - {k}] END)"

    def b(k):
        return (f"(CASE WHEN j - {k} >= 1 AND ends[j - {k}].kind = 'boost' THEN ends[j - {k}].value "
                f"WHEN coalesce(list_contains({up}, {prev(k)}), false) THEN {p.boost_up}::DOUBLE "
                f"WHEN coalesce(list_contains({down}, {prev(k)}), false) THEN {p.boost_down}::DOUBLE "
                f"ELSE 0.0::DOUBLE END) * {p.decay[k - 1]}::DOUBLE")
    so = {k: f"coalesce(list_contains({sql_list(p.never_words)}, {prev(k)}), false)" for k in (1, 2)}
    doubt = {k: f"coalesce({prev(k)} = 'doubt', false)" for k in (1, 2)}
    beside = {2: (so[1], doubt[1]), 3: (f"({so[1]} OR {so[2]})", f"({doubt[1]} OR {doubt[2]})")}
    negated = f"coalesce(list_contains({neg}, {prev(1)}), false) OR coalesce(suffix({prev(1)}, 'n''t'), false)" + "".join(
        f" OR coalesce(list_contains({neg}, {prev(k)}) AND NOT ({prev(k)} = 'never' AND {beside[k][0]})"
        f" AND NOT ({prev(k)} = 'without' AND {beside[k][1]}), false)" for k in (2, 3))
    never = " OR ".join(f"coalesce({prev(k)} = 'never' AND {beside[k][0]}, false)" for k in (2, 3))
    # the longest phrase that begins at token i, and that which covers token i and begins first
    found = "CASE " + " ".join(
        "WHEN " + " AND ".join(f"lcs[i + {d}] = {q(w)}" for d, w in enumerate(x.split()))
        + f" THEN {{'kind': {q(kind)}, 'value': {value}::DOUBLE, 'size': {len(x.split())}}}"
        for x, kind, value in sorted(p.phrases, key=lambda x: -len(x[0].split()))) + " END"
    longest = max(len(x[0].split()) for x in p.phrases)
    cover = "CASE " + " ".join(
        f"WHEN i > {d} AND begins[i - {d}].size > {d} THEN {{'kind': begins[i - {d}].kind, 'value': begins[i - {d}].value, "
        f"'size': begins[i - {d}].size, 'last': begins[i - {d}].size = {d + 1}}}" for d in range(longest - 1, -1, -1)) + " END"
    return f"""
lt0 AS (
  SELECT post_id, least(length(regexp_replace({text}, '[^!]', '', 'g')), {p.exclamation_max}) * {p.exclamation}::DOUBLE
           + CASE WHEN length(regexp_replace({text}, '[^?]', '', 'g')) > 3 THEN {p.question_limit}::DOUBLE
                  WHEN length(regexp_replace({text}, '[^?]', '', 'g')) > 1
                  THEN length(regexp_replace({text}, '[^?]', '', 'g')) * {p.question}::DOUBLE ELSE 0.0::DOUBLE END AS bangs,
         list_filter(list_transform(string_split({text}, ' '), lambda t:
             CASE WHEN length(regexp_replace(t, {edge}, '', 'g')) > 2 THEN regexp_replace(t, {edge}, '', 'g') ELSE t END),
           lambda t: length(t) > 1) AS toks
  FROM {src}),
lt1 AS (
  SELECT post_id, bangs, toks, list_transform(toks, lambda x: lower(x)) AS lcs,
         len(list_filter(toks, lambda x: {is_cap})) > 0 AND len(list_filter(toks, lambda x: {is_cap})) < len(toks)
           AS cap_diff
  FROM lt0),
lt1a AS (SELECT *, list_transform(lcs, lambda x, i: {found}) AS begins FROM lt1),
lt1b AS (SELECT *, list_transform(begins, lambda x, i: {cover}) AS covers FROM lt1a),
lt2 AS (
  SELECT post_id, bangs, coalesce(list_position(lcs, 'but'), 0) AS but_at, cap_diff, toks, lcs, covers,
         list_transform(covers, lambda c: CASE WHEN c.last THEN c END) AS ends,
         list_transform(covers, lambda c, i: CASE WHEN c.kind = 'idiom' AND c.last THEN i - c.size + 1 ELSE i END) AS froms
  FROM lt1b),
lt3z AS (
  SELECT post_id, bangs, but_at, cap_diff, lcs, covers, ends, unnest(toks) AS x, unnest(froms) AS j,
         generate_subscripts(toks, 1) AS i
  FROM lt2),
lt3 AS (
  SELECT post_id, bangs, {{
      'pos': i, 'lc': lcs[i], 'cap': {is_cap} AND cap_diff,
      'boost': 0 + {b(1)} + {b(2)} + {b(3)},
      'negated': {negated},
      'never': {never},
      'idiom': CASE WHEN covers[i].kind = 'idiom' THEN CASE WHEN covers[i].last THEN covers[i].value ELSE 0.0::DOUBLE END END,
      'least': coalesce({prev(1)} = 'least' AND NOT coalesce({prev(2)} IN ('at', 'very'), false), false),
      'but_w': CASE WHEN but_at = 0 THEN 1.0::DOUBLE WHEN i < but_at THEN {p.but_before}::DOUBLE
                    WHEN i > but_at THEN {p.but_after}::DOUBLE ELSE 1.0::DOUBLE END}} AS t
  FROM lt3z),
lt4 AS (
  SELECT post_id, bangs, t.*, coalesce(t.idiom, lx.valence) AS valence,
         CAST(sign(coalesce(t.idiom, lx.valence)) AS DOUBLE) AS sg
  FROM lt3 LEFT JOIN lexicon lx ON lx.lc = t.lc),
lt5 AS (
  SELECT post_id, bangs,
         coalesce(CASE WHEN never THEN {p.never}::DOUBLE ELSE 1.0::DOUBLE END
                  * CASE WHEN least THEN {p.negation}::DOUBLE ELSE 1.0::DOUBLE END * (CASE WHEN negated
                        THEN (valence + CASE WHEN cap THEN sg * {p.caps}::DOUBLE ELSE 0.0 END + boost * sg) * {p.negation}::DOUBLE
                        ELSE valence + CASE WHEN cap THEN sg * {p.caps}::DOUBLE ELSE 0.0 END + boost * sg END) * but_w,
                  0.0) AS v
  FROM lt4),
lt6 AS (
  SELECT post_id, sum(v) AS s, sum(CASE WHEN v > 0 THEN v + 1 ELSE 0.0 END) AS pos_sum,
         sum(CASE WHEN v < 0 THEN v - 1 ELSE 0.0 END) AS neg_sum, count(*) FILTER (WHERE v = 0) AS neu_n,
         max(bangs) AS amp
  FROM lt5 GROUP BY post_id),
lt7 AS (
  SELECT post_id, s + CASE WHEN s > 0 THEN amp WHEN s < 0 THEN -amp ELSE 0.0 END AS s2,
         pos_sum + CASE WHEN pos_sum > abs(neg_sum) THEN amp ELSE 0.0 END AS ps,
         neg_sum - CASE WHEN pos_sum < abs(neg_sum) THEN amp ELSE 0.0 END AS ns, neu_n
  FROM lt6),
lex_scores AS (
  SELECT post_id, round(greatest(-1.0, least(1.0, s2 / sqrt(s2 * s2 + {p.alpha}::DOUBLE))), 4) AS compound,
         round(abs(ps / (ps + abs(ns) + neu_n)), 3) AS pos, round(abs(ns / (ps + abs(ns) + neu_n)), 3) AS neg,
         round(abs(CAST(neu_n AS DOUBLE) / (ps + abs(ns) + neu_n)), 3) AS neu
  FROM lt7)
"""


SEED_LEXICON_SQL = "lexicon AS (SELECT lower(w) AS lc, CAST(v AS DOUBLE) AS valence FROM (VALUES " + ", ".join(
    f"({q(w)}, {v})" for w, v in W.seed_lexicon()) + ") x(w, v))"
ORACLE_LEXICON = with_(DOCS, SEED_LEXICON_SQL, "dclean AS (SELECT post_id, cleaned FROM clean)",
                       lexicon_sql("dclean", "cleaned")) + "SELECT * FROM lex_scores"

#: The words of the test documents' prose as a dictionary, so that every rule meets many texts.
PROSE_LEXICON = [("that", 1.9), ("with", -1.3), ("are", 2.7), ("from", -2.5), ("dans", 0.8), ("avec", -0.4)]


def _prose_params():
    from ..operators.lexicon import Params
    return Params(
        negators=("and", "never", "without", "und"), boosters_up=("to", "so"), boosters_down=("is", "les"),
        never_words=("in", "so"), phrases=(
            ("of the", "boost", 0.293), ("on the", "boost", -0.293), ("in the", "idiom", 1.5), ("in the of", "idiom", -2.0),
            ("the of", "idiom", 0.7), ("de la", "idiom", -1.1), ("la de la", "boost", 0.1)))


PROSE_LEXICON_SQL = "lexicon AS (SELECT w AS lc, CAST(v AS DOUBLE) AS valence FROM (VALUES " + ", ".join(
    f"({q(w)}, {v})" for w, v in PROSE_LEXICON) + ") x(w, v))"


@register("lexicon_score_phrases", with_(DOCS, PROSE_LEXICON_SQL, "dclean AS (SELECT post_id, cleaned FROM clean)",
                                         lexicon_sql("dclean", "cleaned", _prose_params())) + "SELECT * FROM lex_scores")
def q_lexicon_score_phrases(spark, base):
    """C4 with a dictionary and phrases that do occur in the documents."""
    lexicon = spark.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(w).alias("word"), F.lit(v).alias("valence")) for w, v in PROSE_LEXICON])))
    return lexicon_scores(_clean_docs(spark, base), lexicon, _prose_params())


UNI_CLEAN = f"""
uposts AS (
  SELECT CAST(doc_id AS VARCHAR) AS post_id, lang AS topic, false AS is_comment, concat_ws(' ', '', coalesce(text, ''))
           AS full_text FROM documents
  UNION ALL
  SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR), CAST(NULL AS VARCHAR), true,
         concat_ws(' ', '', coalesce(text, '')) FROM conversations),
clean AS (SELECT *, {strip_urls_sql('full_text')} AS cleaned FROM uposts)
"""
ORACLE_SCORED = with_(UNI_CLEAN, SEED_LEXICON_SQL, "dclean AS (SELECT post_id, cleaned FROM clean)",
                      lexicon_sql("dclean", "cleaned"), KW_TOKENS, KEYWORDS) + """
SELECT c.post_id, c.topic, c.is_comment,
       CASE WHEN length(c.cleaned) = 0 THEN 0.0 ELSE coalesce(l.compound, 0.0) END AS sentiment_score,
       CASE WHEN (CASE WHEN length(c.cleaned) = 0 THEN 0.0 ELSE coalesce(l.compound, 0.0) END) >= 0.05 THEN 'positive'
            WHEN (CASE WHEN length(c.cleaned) = 0 THEN 0.0 ELSE coalesce(l.compound, 0.0) END) <= -0.05 THEN 'negative'
            ELSE 'neutral' END AS sentiment_label,
       round(CASE WHEN length(c.cleaned) = 0 THEN 0.5 ELSE coalesce(greatest(l.pos, l.neg, l.neu), 0.5) END, 4)
         AS confidence,
       CASE WHEN length(c.cleaned) = 0 THEN '' ELSE array_to_string(k.keywords, ' ') END AS keywords,
       CAST(length(c.cleaned) AS INTEGER) AS cleaned_chars,
       CAST(length(substring(c.cleaned, 1, 500)) AS INTEGER) AS display_chars
FROM clean c LEFT JOIN lex_scores l USING (post_id) LEFT JOIN post_kw k USING (post_id)"""

from .catalog import ORACLE as _ORACLE  # noqa: E402

_ORACLE["lexicon_score"] = ORACLE_LEXICON.strip()
_ORACLE["scored_posts"] = ORACLE_SCORED.strip()


def entities_sql(text: str) -> str:
    """SQL form of ``functions.text.entities`` for an engine whose ``\\b`` is ASCII-only:
    every non-word character is doubled so a consumed boundary character still leaves
    one for the next match; explicit boundary classes replace ``\\b``; the doubled
    whitespace inside a match is then halved."""
    nw = r"[^\p{L}\p{N}_]"
    doubled = f"regexp_replace(coalesce({text}, ''), {q('(' + nw + ')')}, '\\1\\1', 'g')"
    org = rf"(?:^|{nw})([A-Z][a-z]+(?:{WS}+[A-Z][a-z]+)*)(?:$|{nw})"
    halve = q(f"({WS}){WS}")
    orgs = (f"list_transform(regexp_extract_all({doubled}, {q(org)}, 1), "
            f"lambda m: regexp_replace(m, {halve}, '\\1', 'g'))")
    orgs = f"list_filter({orgs}, lambda m: length(m) > 2 AND NOT list_contains({EN_STOP}, lower(m)))"
    money = f"regexp_extract_all(coalesce({text}, ''), {q(T.MONEY_PATTERN)}, 0)"
    pct = f"regexp_extract_all(coalesce({text}, ''), {q(T.PERCENT_PATTERN)}, 0)"
    return (f"list_concat(list_transform({orgs}, lambda m: 'ORG_OR_PERSON:' || m), "
            f"list_transform({money}, lambda m: 'MONEY:' || m), list_transform({pct}, lambda m: 'PERCENT:' || m))")


_ORACLE["entities"] = (with_(DOCS) + f"""
SELECT post_id, array_to_string(e, '|') AS entities, CAST(len(e) AS INTEGER) AS n
FROM (SELECT post_id, {entities_sql('full_text')} AS e FROM docs)""").strip()


# ------------------------------------------------------ H2, H4 over scored documents
SDOCS = """
sdocs AS (
  SELECT c.post_id, c.topic, c.subreddit,
         CAST(round((CASE WHEN length(c.cleaned) = 0 THEN 0.0 ELSE coalesce(l.compound, 0.0) END) * 10000) AS BIGINT)
           AS sentiment_e4,
         CASE WHEN (CASE WHEN length(c.cleaned) = 0 THEN 0.0 ELSE coalesce(l.compound, 0.0) END) >= 0.05 THEN 'positive'
              WHEN (CASE WHEN length(c.cleaned) = 0 THEN 0.0 ELSE coalesce(l.compound, 0.0) END) <= -0.05 THEN 'negative'
              ELSE 'neutral' END AS sentiment_label,
         k.keywords
  FROM clean c LEFT JOIN lex_scores l USING (post_id) LEFT JOIN post_kw k USING (post_id))
"""
SCORED_DOCS_CTES = (DOCS, SEED_LEXICON_SQL, "dclean AS (SELECT post_id, cleaned FROM clean)",
                    lexicon_sql("dclean", "cleaned"), KW_TOKENS, KEYWORDS, SDOCS)


def scored_documents(spark, base):
    """Documents scored by the per-post plan (lexicon score, keywords, labels)."""
    stop = W.words(W.ENGLISH_STOPWORDS_TEXT + " " + W.SITE_STOPWORDS_TEXT)
    return score_posts(_docs(spark, base), TB.seed_lexicon(spark), TB.keyword_stopwords(spark), stop,
                       processed_at=TB.AS_OF, with_entities=False)


@register("word_cloud", with_(*SCORED_DOCS_CTES) + f"""
SELECT topic, word, count(*) AS "count", {AVG_E4.format(c='sentiment_e4')} AS avg_sentiment
FROM (SELECT topic, sentiment_e4, unnest(list_distinct(keywords)) AS word FROM sdocs) GROUP BY 1, 2""")
def q_word_cloud(spark, base):
    return A.word_cloud(scored_documents(spark, base))


@register("top_entities", with_(DOCS) + f"""
, found AS (SELECT topic, split_part(e, ':', 1) AS entity_type, substring(e, strpos(e, ':') + 1) AS entity
            FROM (SELECT topic, unnest({entities_sql('full_text')}) AS e FROM docs)),
counted AS (SELECT topic, entity_type, entity, count(*) AS "count" FROM found GROUP BY topic, entity_type, entity)
SELECT *, CAST(row_number() OVER (PARTITION BY topic ORDER BY "count" DESC, entity, entity_type) AS INTEGER) AS rank
FROM counted QUALIFY rank <= 10""")
def q_top_entities(spark, base):
    stop = W.words(W.ENGLISH_STOPWORDS_TEXT + " " + W.SITE_STOPWORDS_TEXT)
    d = _docs(spark, base).select("topic", T.entities(T.full_text("title", "content"), stop).alias("entities"))
    return A.top_entities(d, 10)


@register("nested_aggregates", with_(*SCORED_DOCS_CTES) + f"""
, agg AS (
  SELECT topic, {AVG_E4.format(c='sentiment_e4')} AS avg_sentiment, {STD_E4.format(c='sentiment_e4')} AS std_sentiment,
         count(*) AS total_posts,
         count(*) FILTER (WHERE sentiment_label = 'positive') AS positive_count,
         count(*) FILTER (WHERE sentiment_label = 'neutral') AS neutral_count,
         count(*) FILTER (WHERE sentiment_label = 'negative') AS negative_count
  FROM sdocs GROUP BY topic),
kc AS (
  SELECT topic, keyword, count(*) AS cnt FROM (SELECT topic, unnest(keywords) AS keyword FROM sdocs) GROUP BY 1, 2),
kr AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY cnt DESC, keyword) AS rank FROM kc),
tk AS (
  SELECT topic, string_agg(keyword, ',' ORDER BY rank) AS top_keywords,
         string_agg(CAST(cnt AS VARCHAR), ',' ORDER BY rank) AS top_keyword_counts
  FROM kr WHERE rank <= 10 GROUP BY topic),
src AS (
  SELECT topic, string_agg(subreddit, ',' ORDER BY subreddit) AS sources, CAST(sum(n) AS BIGINT) AS source_posts,
         string_agg(CAST(CAST(round(m * 1000000) AS BIGINT) AS VARCHAR), ',' ORDER BY subreddit) AS source_averages FROM (
    SELECT topic, subreddit, count(*) AS n, {AVG_E4.format(c='sentiment_e4')} AS m FROM sdocs GROUP BY 1, 2) GROUP BY topic)
SELECT a.topic, a.avg_sentiment, a.std_sentiment, s.source_averages, a.total_posts, t.top_keywords, t.top_keyword_counts,
       CAST(a.positive_count AS DOUBLE) / CAST(a.total_posts AS DOUBLE) AS dist_positive,
       CAST(a.neutral_count AS DOUBLE) / CAST(a.total_posts AS DOUBLE) AS dist_neutral,
       CAST(a.negative_count AS DOUBLE) / CAST(a.total_posts AS DOUBLE) AS dist_negative,
       s.sources, s.source_posts
FROM agg a LEFT JOIN tk t USING (topic) LEFT JOIN src s USING (topic)""")
def q_nested_aggregates(spark, base):
    sd = scored_documents(spark, base)
    # keywords don't depend on scores
    kw = post_keywords(_clean_docs(spark, base), TB.keyword_stopwords(spark), keep=("topic",))
    n = A.nested_aggregates(sd, top_keywords(kw, 20), 10)
    return n.select(
        "topic", "avg_sentiment", "std_sentiment",
        F.array_join(F.transform(
            F.array_sort(F.map_keys("subreddit_breakdown")),
            lambda k: F.round(F.element_at("subreddit_breakdown", k)["avg_sentiment"] * 1000000).cast("bigint").cast("string")),
            ",").alias("source_averages"), "total_posts",
        F.array_join(F.transform("top_keywords", lambda k: k["keyword"]), ",").alias("top_keywords"),
        F.array_join(F.transform("top_keywords", lambda k: k["count"].cast("string")), ",").alias("top_keyword_counts"),
        F.element_at("sentiment_distribution", F.lit("positive")).alias("dist_positive"),
        F.element_at("sentiment_distribution", F.lit("neutral")).alias("dist_neutral"),
        F.element_at("sentiment_distribution", F.lit("negative")).alias("dist_negative"),
        F.array_join(F.array_sort(F.map_keys("subreddit_breakdown")), ",").alias("sources"),
        F.aggregate(F.map_values("subreddit_breakdown"), F.lit(0).cast("bigint"),
                    lambda acc, v: acc + v["post_count"]).alias("source_posts"))
