"""topicpulse: tone-of-text analytics for topic-grouped posts, built on Spark DataFrames.

Every operator is a function ``DataFrame -> DataFrame`` made of Spark expressions,
joins, aggregates and windows, so the same code serves batch tables and the
micro-batches of a Structured Streaming query.

Scores are carried twice: ``sentiment_score`` (DOUBLE, in [-1, 1]) and
``sentiment_e4`` (BIGINT, the score in units of 1/10000, which is the precision
the scorer rounds to). Aggregates sum the integer form, so averages are exact and
do not depend on how rows are spread over partitions.
"""

__version__ = "0.1.0"
