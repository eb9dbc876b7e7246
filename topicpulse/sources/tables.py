"""Columnar sources: table reads, the look-back scan (A4), first non-empty source (A5),
and the small dictionary tables the text operators join against."""

from __future__ import annotations

import datetime as dt
import os
from collections.abc import Callable, Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import wordlists as W


def read_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(base, f"{name}.parquet"))


def as_timestamp(value) -> F.Column:
    """A Python datetime/ISO string as a TIMESTAMP literal (session time zone is UTC)."""
    if isinstance(value, str):
        return F.to_timestamp(F.lit(value))
    return F.lit(value).cast("timestamp")


def scan_lookback(df_or_path, spark: SparkSession | None = None, as_of=None,
                  hours: int = 24, ts_col: str = "processed_at") -> DataFrame:
    """A4: rows with ``ts_col >= as_of - hours``. A plain ``where`` so the predicate
    reaches the parquet reader (row-group skipping); on a table partitioned by day
    (``dt``) the implied ``dt >= date(cutoff)`` prunes whole partitions."""
    df = spark.read.parquet(df_or_path) if isinstance(df_or_path, str) else df_or_path
    cutoff = as_timestamp(as_of) - F.expr(f"INTERVAL {int(hours)} HOURS")
    out = df.where(F.col(ts_col) >= cutoff)
    if "dt" in df.columns:
        out = out.where(F.col("dt") >= F.to_date(cutoff))
    return out


def is_missing(e: AnalysisException) -> bool:
    """Whether a read failed as the path isn't there or holds no data file yet."""
    return e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def read_if_there(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table at ``path``, or None if there is none; other failures are raised."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if not is_missing(e):
            raise
        return None


def first_nonempty(candidates: Iterable[Callable[[], DataFrame | None]]) -> DataFrame | None:
    """A5: the first candidate source that loads and holds at least one row.

    Each candidate is a thunk so later sources are not even planned when an earlier
    one has data; ``isEmpty`` reads at most one row, never a full count.
    """
    for make in candidates:
        try:
            df = make()
        except AnalysisException as e:  # only a source that isn't there means "try the next"
            if not is_missing(e):
                raise
            df = None
        if df is not None and not df.isEmpty():
            return df
    return None


# ---------------------------------------------------------------- dictionaries
def words_df(spark: SparkSession, ws: list[str], col: str = "word") -> DataFrame:
    """A word list as a literal, whose size the optimizer knows (of a parallelised list it knows nothing)."""
    return spark.range(1).select(F.explode(F.array(*[F.lit(w) for w in ws])).alias(col))


def keyword_stopwords(spark: SparkSession) -> DataFrame:
    return words_df(spark, W.words(W.KEYWORD_STOPWORDS_TEXT))


def english_stopwords(spark: SparkSession) -> DataFrame:
    return words_df(spark, W.words(W.ENGLISH_STOPWORDS_TEXT + " " + W.SITE_STOPWORDS_TEXT))


def seed_lexicon(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(w).alias("word"), F.lit(float(v)).alias("valence")) for w, v in W.seed_lexicon()])))


def load_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """A valence lexicon file: ``word<TAB>mean[<TAB>...]`` per line (the published format)."""
    raw = spark.read.option("sep", "\t").option("quote", "\u0000").csv(path)
    return raw.select(F.col("_c0").alias("word"), F.col("_c1").cast("double").alias("valence")) \
              .where(F.col("valence").isNotNull())


AS_OF = dt.datetime(2024, 1, 31, 0, 0, 0)
