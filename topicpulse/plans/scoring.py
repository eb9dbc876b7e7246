"""The per-post scoring plan (the work of the streaming job's scorer, as a DataFrame job).

posts -> full text (C1) -> cleaned text (C2) -> top-5 keywords (C10), entities (C12) and
whether it is blank, all in the post's row; lexicon score (C4) joined by post_id;
defaults for blank text (C13) and labels (C5).

Shuffles: the scores (a few numbers a post), and the posts with those of their columns
that the caller uses, once, for the join. The scores are its hashed side, so the
texts aren't sorted.
``post_id`` must be unique in ``posts`` (deduplicate first, B6/A13).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.keywords import post_keywords
from ..operators.lexicon import Params, lexicon_scores, score_with_defaults

ENTITY_TYPE = "array<struct<text:string,entity_type:string,confidence:double>>"


def score_posts(posts: DataFrame, lexicon: DataFrame, stopwords: DataFrame,
                entity_stopwords: list[str] | None = None, processed_at=None,
                params: Params | None = None, with_entities: bool = True) -> DataFrame:
    meta = [c for c in posts.columns if c not in ("post_id", "title", "content")]
    t = posts.where(F.col("post_id").isNotNull()).withColumn("_full", T.full_text("title", "content")) \
        .withColumn("cleaned_text", T.strip_urls(F.col("_full")))
    scores = lexicon_scores(t.select("post_id", "cleaned_text"), lexicon, params)
    blank = F.length("cleaned_text") == 0     # the cleaned text is trimmed
    t = post_keywords(t, stopwords, keep=(*meta, "title", "content", "_full", "cleaned_text")).withColumn(
        "keywords", F.when(blank, F.array().cast("array<string>")).otherwise(F.col("keywords")))
    t = t.withColumn("entities", T.entities(F.col("_full"), entity_stopwords or []) if with_entities
                     else F.array().cast(ENTITY_TYPE)).withColumn("_blank", blank)
    out = score_with_defaults(t, scores.hint("shuffle_hash"), blank=F.col("_blank")).select(
        "post_id", *meta, "title", "content", "cleaned_text", "sentiment_e4", "sentiment_score", "sentiment_label", "confidence",
        "keywords", "entities", F.substring("cleaned_text", 1, T.DISPLAY_CHARS).alias("display_text"))
    if "processed_at" not in out.columns:
        ts = F.current_timestamp() if processed_at is None else F.lit(processed_at).cast("timestamp")
        out = out.withColumn("processed_at", ts)
    return out
