"""Record validation (A12) and uniqueness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.wordlists import LABELS5
from .ingest import dedupe


# fixed values: required fields and field types of the five stored tables
REQUIRED = {
    "posts": ["post_id", "topic", "timestamp"],
    "results": ["post_id", "topic", "sentiment_score", "timestamp"],
    "aggregates": ["topic", "period_start", "period_end"],
    "alerts": ["topic", "alert_type", "timestamp"],
    "topics": ["name", "subreddits", "active"],
}
TYPES = {
    "posts": {"post_id": "string", "topic": "string", "subreddit": "string", "title": "string", "content": "string",
              "author": "string", "score": "int", "num_comments": "int", "created_utc": "double", "timestamp": "date"},
    "results": {"post_id": "string", "topic": "string", "sentiment_score": "double", "sentiment_label": "string",
                "confidence": "double", "entities": "array", "keywords": "array", "timestamp": "date",
                "processed_at": "date"},
    "aggregates": {"topic": "string", "period_start": "date", "period_end": "date", "avg_sentiment": "double",
                   "total_posts": "int", "positive_count": "int", "negative_count": "int", "neutral_count": "int",
                   "top_keywords": "array", "top_entities": "array", "sentiment_distribution": "object"},
    "alerts": {"topic": "string", "alert_type": "string", "message": "string", "severity": "string",
               "sentiment_value": "double", "threshold": "double", "timestamp": "date", "acknowledged": "bool"},
    "topics": {"name": "string", "subreddits": "array", "keywords": "array", "active": "bool", "created_at": "date",
               "updated_at": "date"},
}
SPARK_TYPES = {"string": ("string",), "int": ("tinyint", "smallint", "int", "bigint"), "double": ("float", "double"),
               "date": ("timestamp", "timestamp_ntz", "date"), "bool": ("boolean",), "array": ("array",),
               "object": ("map", "struct")}


def between(c: str, lo: float, hi: float) -> Column:
    return F.col(c).isNull() | F.col(c).between(lo, hi)


def one_of(c: str, values: list[str]) -> Column:
    return F.col(c).isNull() | F.col(c).isin(values)


def table_rules(df: DataFrame, table: str) -> list[tuple[str, Column]]:
    """The rules of a stored table: required fields first, then field types. A missing column
    counts as null; a field of another type than the table's fails wherever it has a value."""
    kinds = {f.name: f.dataType.typeName() if f.dataType.typeName() in ("array", "map", "struct")
             else f.dataType.simpleString() for f in df.schema.fields}
    rules = [(f"{c}_required", F.col(c).isNotNull() if c in kinds else F.lit(False)) for c in REQUIRED[table]]
    return rules + [(f"{c}_type", F.lit(True) if kinds[c] in SPARK_TYPES[t] else F.col(c).isNull())
                    for c, t in TYPES[table].items() if c in kinds]


def range_rules(df: DataFrame) -> list[tuple[str, Column]]:
    """Rules beyond those of the tables, for callers who want them: scores, shares and labels in range."""
    known = {"sentiment_score": between("sentiment_score", -1.0, 1.0), "confidence": between("confidence", 0.0, 1.0),
             "avg_sentiment": between("avg_sentiment", -1.0, 1.0), "positive_pct": between("positive_pct", 0.0, 100.0),
             "negative_pct": between("negative_pct", 0.0, 100.0), "neutral_pct": between("neutral_pct", 0.0, 100.0),
             "sentiment_label": one_of("sentiment_label", LABELS5)}
    return [(f"{c}_range", cond) for c, cond in known.items() if c in df.columns]


def validate(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """Adds ``reasons`` (names of failed rules, in rule order) and ``valid``.
    A rule whose expression is null counts as failed."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(cond, F.lit(False)), F.lit(name))
                                       for name, cond in rules]))
    return df.withColumn("reasons", failed).withColumn("valid", F.size("reasons") == 0)


def observed(df: DataFrame, rules: list[tuple[str, Column]], name: str = "validation") -> tuple[DataFrame, Observation]:
    """``validate`` whose next action also counts: rows, valid rows and the failures of each rule, in the same pass.

    The observation has its values once an action on the frame is done; the first such action counts.
    """
    checked = validate(df, rules)
    seen = Observation(name)
    counts = [F.count_if(F.array_contains("reasons", rule)).alias(rule) for rule, _ in rules]
    return checked.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if("valid").alias("valid"), *counts), seen


def write_validated(df: DataFrame, rules: list[tuple[str, Column]], path: str) -> dict[str, int]:
    """Write accepted rows to ``path/valid=true`` and rejected ones, with their reasons, to the quarantine
    ``path/valid=false``, in one pass over ``df``; returns the counts gathered on the way."""
    checked, seen = observed(df, rules)
    checked.write.mode("overwrite").partitionBy("valid").parquet(path)
    return seen.get


def enforce_unique(df: DataFrame, key: str, order: list) -> DataFrame:
    """One row per ``key``, the first by ``order`` (ties by key: deterministic)."""
    return dedupe(df, key, order)
