"""Score labels and score arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .wordlists import CLASS_WEIGHTS, DISPLAY_LABELS5, LABELS5

E4 = 10_000  # scores are fixed-point integers in 1/10000


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_e4(score) -> Column:
    """Double score -> BIGINT in 1/10000 (round half up, as the stored 4-decimal score)."""
    return F.round(_c(score) * E4).cast("bigint")


def from_e4(e4) -> Column:
    return _c(e4).cast("double") / E4


def label3(score, pos: float = 0.05, neg: float = -0.05) -> Column:
    """>= pos positive, <= neg negative, else neutral; null stays null."""
    s = _c(score)
    return (F.when(s >= pos, "positive").when(s <= neg, "negative")
            .when(s.isNotNull(), "neutral"))


def label5(score) -> Column:
    """Upper bounds inclusive: <=-.6, <=-.2, <=.2, <=.6, else."""
    s = _c(score)
    vn, n, z, p, vp = LABELS5
    return (F.when(s <= -0.6, vn).when(s <= -0.2, n).when(s <= 0.2, z)
            .when(s <= 0.6, p).when(s.isNotNull(), vp))


def label5_display(score) -> Column:
    """Dashboard label: >.5, >.2, >-.2, >-.5, else (a missing score counts as 0)."""
    s = F.coalesce(_c(score), F.lit(0.0))
    vp, p, z, n, vn = DISPLAY_LABELS5
    return F.when(s > 0.5, vp).when(s > 0.2, p).when(s > -0.2, z).when(s > -0.5, n).otherwise(vn)


def polarity3(score, band: float = 0.2) -> Column:
    """> band positive, < -band negative, closed middle neutral; null in no bucket."""
    s = _c(score)
    return (F.when(s > band, "positive").when(s < -band, "negative")
            .when(s.isNotNull(), "neutral"))


def scale_0_100(score) -> Column:
    """C14: (s + 1) / 2 * 100."""
    return (_c(score) + 1) / 2 * 100


def bound(value: Column, then) -> Column:
    """``then(value)`` with ``value`` computed once, however often ``then`` uses it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def softmax(logits) -> Column:
    """Softmax of an array; the largest logit is taken off first, so no exponential overflows."""
    x = _c(logits)
    shares = lambda ex: bound(F.aggregate(ex, F.lit(0.0), lambda a, e: a + e),                       # noqa: E731
                              lambda total: F.transform(ex, lambda e: e / total))
    return bound(F.array_max(x), lambda most: bound(F.transform(x, lambda v: F.exp(v - most)), shares))


def short_text_default(pre_text, result) -> Column:
    """C13 for the class model: a preprocessed text of fewer than three characters is neutral with
    score and confidence 0 and no predicted class; otherwise ``result`` (``class_probs_score``)."""
    r = _c(result)
    none = F.struct(F.lit(0.0).alias("score"), F.lit(0.0).alias("confidence"),
                    F.lit(None).cast("int").alias("predicted_class"), F.lit(LABELS5[2]).alias("label"))
    return F.when(F.length(F.coalesce(_c(pre_text), F.lit(""))) < 3, none).otherwise(r)


def class_probs_score(logits, weights: list[float] = CLASS_WEIGHTS, digits: int = 4) -> Column:
    """5 class logits -> struct(score, confidence, predicted_class, label).

    score = sum(p_i * w_i) over the softmax; confidence = max p; class = argmax (0-based,
    first on ties); label by C6 on the unrounded score; score and confidence rounded.
    """
    w = F.array(*[F.lit(float(x)) for x in weights])

    def scored(probs):
        score = F.aggregate(F.zip_with(probs, w, lambda p, q: p * q), F.lit(0.0), lambda a, x: a + x)
        both = F.struct(score.alias("s"), F.array_max(probs).alias("c"))
        return bound(both, lambda b: F.struct(
            F.round(b["s"], digits).alias("score"), F.round(b["c"], digits).alias("confidence"),
            (F.array_position(probs, b["c"]) - 1).cast("int").alias("predicted_class"), label5(b["s"]).alias("label")))

    return bound(softmax(logits), scored)
