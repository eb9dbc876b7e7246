"""Registered queries: sources, sinks and ingest jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import ingest as I
from ..operators import validate as V
from ..sources import bus as B
from ..sources.tables import AS_OF, scan_lookback
from ..sources.testdata import comments_from_conversations, posts_from_documents, scored_from_events, \
    topics_from_documents
from ..functions.wordlists import DEFAULT_TOPICS
from ..session import new_folder
from ..streaming.sinks import id_store, insert_new_only, publish_views, read_view, upsert_latest
from .catalog import register
from .sql import AVG_E4, SCORED, TOPIC_AGG, with_

AS_OF_SQL = "TIMESTAMP '2024-01-31 00:00:00'"
SPLIT = "TIMESTAMP '2024-01-16 00:00:00'"
OVERLAP = "TIMESTAMP '2024-01-14 00:00:00'"
SPLIT_TS, OVERLAP_TS = "2024-01-16 00:00:00", "2024-01-14 00:00:00"


def _batches(spark, base):
    """Two crawl batches of the event posts that overlap by two days: batch 0 before
    the 16th, batch 1 from the 14th on (re-crawled posts appear in both)."""
    s = scored_from_events(spark, base)
    b0 = s.where(F.col("processed_at") < F.to_timestamp(F.lit(SPLIT_TS)))
    b1 = s.where(F.col("processed_at") >= F.to_timestamp(F.lit(OVERLAP_TS)))
    return b0, b1


# ------------------------------------------------------------------------- A2, A3
BUS_SQL = """
bus AS (
  SELECT topic || ':' || post_id AS kafka_key, processed_at AS kafka_timestamp,
         CASE WHEN topic = 'error' THEN NULL ELSE post_id END AS post_id,
         CASE WHEN topic = 'error' THEN NULL ELSE topic END AS topic,
         CASE WHEN topic = 'error' THEN NULL ELSE subreddit END AS subreddit,
         CASE WHEN topic = 'error' THEN NULL ELSE author END AS author,
         CASE WHEN topic = 'error' THEN NULL ELSE score END AS score,
         CASE WHEN topic = 'error' THEN NULL ELSE epoch_us(processed_at) / 1e6 END AS created_utc
  FROM scored)
"""


def bus_records(spark, base):
    """Bus records built from the event posts; records of type 'error' are cut after
    20 bytes, so they are not JSON (malformed input for the decoder)."""
    s = scored_from_events(spark, base).withColumn("created_utc", F.unix_micros("processed_at") / 1e6)
    enc = B.encode_records(s.select("post_id", "topic", "subreddit", "author", "score", "created_utc",
                                    "processed_at"), ["topic", "post_id"], "processed_at")
    bad = F.col("key").cast("string").startswith("error:")
    return enc.withColumn("value", F.when(bad, F.substring("value", 1, 20)).otherwise(F.col("value")))


@register("decode_posts", with_(SCORED, BUS_SQL) + """
SELECT kafka_key, post_id, topic, subreddit, author, CAST(score AS DOUBLE) AS score, created_utc, kafka_timestamp,
       post_id IS NOT NULL AND topic IS NOT NULL AS valid
FROM bus""")
def q_decode_posts(spark, base):
    d = B.decode_posts(bus_records(spark, base))
    return d.select("kafka_key", "post_id", "topic", "subreddit", "author", F.col("score").cast("double").alias("score"),
                    "created_utc", "kafka_timestamp", "valid")


@register("encode_posts", with_(SCORED) + """
SELECT topic || ':' || post_id AS key, post_id, topic, score, sentiment_e4 FROM scored""")
def q_encode_posts(spark, base):
    s = scored_from_events(spark, base).select("post_id", "topic", "score", "sentiment_e4", "processed_at")
    e = B.encode_posts(s)
    v = F.col("value").cast("string")
    return e.select(F.col("key").cast("string").alias("key"),
                    F.get_json_object(v, "$.post_id").alias("post_id"),
                    F.get_json_object(v, "$.topic").alias("topic"),
                    F.get_json_object(v, "$.score").cast("int").alias("score"),
                    F.get_json_object(v, "$.sentiment_e4").cast("bigint").alias("sentiment_e4"))


# ----------------------------------------------------------------------------- A4
@register("scan_lookback", with_(SCORED) + """
SELECT post_id, topic, sentiment_e4, processed_at FROM scored
WHERE processed_at >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 24 HOUR""")
def q_scan_lookback(spark, base):
    s = scored_from_events(spark, base)
    return scan_lookback(s, as_of=AS_OF, hours=24).select("post_id", "topic", "sentiment_e4", "processed_at")


# ------------------------------------------------------------------------- A7, A8
@register("insert_new_only", with_(SCORED) + f""",
b1 AS (SELECT * FROM scored WHERE processed_at >= {OVERLAP}
       UNION ALL SELECT * FROM scored WHERE processed_at >= {OVERLAP} AND topic = 'view'),
d1 AS (SELECT * FROM b1 QUALIFY row_number() OVER (PARTITION BY post_id ORDER BY processed_at, post_id) = 1)
SELECT post_id, topic, processed_at, processed_at AS "timestamp", CAST(1 AS BIGINT) AS batch_id FROM d1
WHERE post_id NOT IN (SELECT post_id FROM scored WHERE processed_at < {SPLIT})""")
def q_insert_new_only(spark, base):
    b0, b1 = _batches(spark, base)
    stored = b0.select("post_id", F.lit(0).cast("bigint").alias("batch_id"))
    incoming = b1.unionByName(b1.where(F.col("topic") == "view"))  # same ids twice inside the batch
    return insert_new_only(stored, incoming, 1).select("post_id", "topic", "processed_at", "timestamp", "batch_id")


@register("insert_new_only_bucketed", with_(SCORED) + f""",
b1 AS (SELECT * FROM scored WHERE processed_at >= {OVERLAP}
       UNION ALL SELECT * FROM scored WHERE processed_at >= {OVERLAP} AND topic = 'view'),
d1 AS (SELECT * FROM b1 QUALIFY row_number() OVER (PARTITION BY post_id ORDER BY processed_at, post_id) = 1)
SELECT post_id, topic, processed_at, CAST(1 AS BIGINT) AS batch_id FROM d1
WHERE post_id NOT IN (SELECT post_id FROM scored WHERE processed_at < {SPLIT})""")
def q_insert_new_only_bucketed(spark, base):
    """A7 against a store keyed by id bucket: only the buckets of the batch's ids are read."""
    from ..streaming.sinks import id_bucket
    b0, b1 = _batches(spark, base)
    stored = b0.select("post_id", id_bucket().alias("id_bucket"), F.lit(0).cast("bigint").alias("batch_id"))
    incoming = b1.unionByName(b1.where(F.col("topic") == "view"))
    return insert_new_only(stored, incoming, 1).select("post_id", "topic", "processed_at", "batch_id")


MICRO_BATCHES = 4


def _micro_batches(spark, base):
    """Crawl batches of the event posts, ten days each; each begins two days before the last one's end."""
    s = scored_from_events(spark, base)
    begin = lambda n: F.to_timestamp(F.lit("2024-01-01 00:00:00")) + F.expr(f"INTERVAL {8 * n} DAYS")
    return [s.where((F.col("processed_at") >= begin(n)) & (F.col("processed_at") < begin(n) + F.expr("INTERVAL 10 DAYS")))
            for n in range(MICRO_BATCHES)]


@register("id_store_batches", with_(SCORED) + f""",
slots AS (SELECT unnest(range({MICRO_BATCHES})) AS n)
SELECT post_id, min(n)::BIGINT AS batch_id FROM scored, slots
WHERE processed_at >= TIMESTAMP '2024-01-01 00:00:00' + to_days((8 * n)::INT)
  AND processed_at < TIMESTAMP '2024-01-11 00:00:00' + to_days((8 * n)::INT)
GROUP BY post_id""")
def q_id_store_batches(spark, base):
    """A7 through the id store: overlapping micro-batches, one of them replayed, with compaction between them."""
    store = id_store(spark, new_folder(spark, "id-store"), fanout=2)
    batches = _micro_batches(spark, base)
    for n, batch in enumerate([*batches, batches[-1]]):
        n = min(n, MICRO_BATCHES - 1)
        store.append(insert_new_only(store.read(), batch, n), n)
    return store.read().select("post_id", "batch_id")


@register("published_aggregates", with_(SCORED, TOPIC_AGG) + f"""
SELECT topic, avg_sentiment, total_posts, {AS_OF_SQL} AS period_end FROM topic_aggs""")
def q_published_aggregates(spark, base):
    """Topic aggregates published for half of the posts, then again for all; what readers see."""
    s, out = scored_from_events(spark, base), new_folder(spark, "views")
    for part in (s.where(F.col("processed_at") < F.to_timestamp(F.lit(SPLIT_TS))), s):
        publish_views({"topic_aggregates": A.topic_aggregates(part).withColumns({
            "period_start": F.lit(AS_OF).cast("timestamp") - F.expr("INTERVAL 30 DAYS"),
            "period_end": F.lit(AS_OF).cast("timestamp"), "created_at": F.lit(AS_OF).cast("timestamp")})}, out, AS_OF)
    return read_view(spark, out, "topic_aggregates").select("topic", "avg_sentiment", "total_posts", "period_end")


def _daily(df, created_shift: str):
    agg = A.topic_aggregates(df.withColumn("period_start", F.date_trunc("day", "processed_at")),
                             by=["topic", "period_start"])
    return agg.select("topic", "period_start", "total_posts", "avg_sentiment",
                      (F.col("period_start") + F.expr("INTERVAL 1 DAY") + F.expr(created_shift)).alias("created_at"))


@register("upsert_latest", with_(SCORED) + f""",
ex AS (SELECT topic, date_trunc('day', processed_at) AS period_start, count(*) AS total_posts,
              {AVG_E4.format(c='sentiment_e4')} AS avg_sentiment,
              date_trunc('day', processed_at) + INTERVAL 1 DAY AS created_at
       FROM scored GROUP BY 1, 2),
inc AS (SELECT topic, date_trunc('day', processed_at) AS period_start, count(*) AS total_posts,
               {AVG_E4.format(c='sentiment_e4')} AS avg_sentiment,
               date_trunc('day', processed_at) + INTERVAL 1 DAY + INTERVAL 1 HOUR AS created_at
        FROM scored WHERE processed_at >= TIMESTAMP '2024-01-16 06:00:00' GROUP BY 1, 2)
SELECT * FROM (SELECT * FROM ex UNION ALL SELECT * FROM inc)
QUALIFY row_number() OVER (PARTITION BY topic, period_start ORDER BY created_at DESC) = 1""")
def q_upsert_latest(spark, base):
    s = scored_from_events(spark, base)
    existing = _daily(s, "INTERVAL 0 HOURS")
    rerun = _daily(s.where(F.col("processed_at") >= F.to_timestamp(F.lit("2024-01-16 06:00:00"))), "INTERVAL 1 HOUR")
    return upsert_latest(existing, rerun, ["topic", "period_start"], "created_at")


# ------------------------------------------------------------------------ A12, A13
DOC_POSTS = """
uni AS (
  SELECT CAST(doc_id AS VARCHAR) AS post_id, lang AS topic, source AS subreddit, '' AS title, text AS content,
         '[deleted]' AS author, CAST(NULL AS INTEGER) AS score, 0 AS num_comments, CAST(NULL AS VARCHAR) AS url,
         CAST(NULL AS DOUBLE) AS created_utc, false AS is_comment, CAST(NULL AS VARCHAR) AS parent_id
  FROM documents
  UNION ALL
  SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR),
         '', text, coalesce(role, '[deleted]'), CAST(NULL AS INTEGER), 0, '', CAST(NULL AS DOUBLE), true,
         CAST(conv_id AS VARCHAR)
  FROM conversations)
"""


def _unified(spark, base):
    return I.unify(posts_from_documents(spark, base), comments_from_conversations(spark, base))


@register("unify", with_(DOC_POSTS) + "SELECT * FROM uni")
def q_unify(spark, base):
    return _unified(spark, base)


@register("validate_posts", with_(SCORED, BUS_SQL) + """
SELECT kafka_key, array_to_string(list_filter([CASE WHEN post_id IS NULL THEN 'post_id_required' END, CASE WHEN topic IS NULL THEN 'topic_required' END, CASE WHEN "timestamp" IS NULL THEN 'timestamp_required' END], lambda x: x IS NOT NULL), ',') AS reasons, post_id IS NOT NULL AND topic IS NOT NULL AS valid
FROM (SELECT *, kafka_timestamp AS "timestamp" FROM bus)""")
def q_validate_posts(spark, base):
    """Post rules over decoded bus records; the malformed ones have no id and no topic."""
    posts = B.decode_posts(bus_records(spark, base)).drop("valid").withColumn("timestamp", F.col("kafka_timestamp"))
    v = V.validate(posts, V.table_rules(posts, "posts"))
    return v.select("kafka_key", F.array_join("reasons", ",").alias("reasons"), "valid")


@register("validate_results", with_(SCORED) + """
SELECT post_id, array_to_string(list_filter([CASE WHEN post_id IS NULL THEN 'post_id_required' END, CASE WHEN topic IS NULL THEN 'topic_required' END, CASE WHEN sentiment_score IS NULL THEN 'sentiment_score_required' END, CASE WHEN "timestamp" IS NULL THEN 'timestamp_required' END], lambda x: x IS NOT NULL), ',') AS reasons,
       sentiment_score IS NOT NULL AND topic IS NOT NULL AS valid
FROM (SELECT post_id, topic, CASE WHEN topic <> 'error' THEN sentiment_score END AS sentiment_score,
             processed_at AS "timestamp" FROM scored)""")
def q_validate_results(spark, base):
    """Result rules over scored posts, of which those of type 'error' come without a score."""
    r = scored_from_events(spark, base).withColumn("timestamp", F.col("processed_at")).withColumn(
        "sentiment_score", F.when(F.col("topic") != "error", F.col("sentiment_score")))
    v = V.validate(r, V.table_rules(r, "results"))
    return v.select("post_id", F.array_join("reasons", ",").alias("reasons"), "valid")


@register("enforce_unique", with_(SCORED) + f"""
SELECT post_id, topic, batch FROM (
  SELECT post_id, topic, 0 AS batch FROM scored WHERE processed_at < {SPLIT}
  UNION ALL SELECT post_id, topic, 1 FROM scored WHERE processed_at >= {OVERLAP})
QUALIFY row_number() OVER (PARTITION BY post_id ORDER BY batch DESC) = 1""")
def q_enforce_unique(spark, base):
    """Unique post ids over two crawls that overlap; the later crawl's row stays."""
    b0, b1 = _batches(spark, base)
    both = b0.withColumn("batch", F.lit(0)).unionByName(b1.withColumn("batch", F.lit(1)))
    return V.enforce_unique(both, "post_id", [F.desc("batch")]).select("post_id", "topic", "batch")


# ------------------------------------------------------------------------- B4, B6, B7, B9
@register("cap_comments", """
SELECT * FROM (
  SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS comment_id, CAST(conv_id AS VARCHAR) AS post_id,
         CAST(turn AS INTEGER) AS position, role AS author,
         CASE WHEN length(text) % 5 = 0 THEN '' ELSE text END AS content
  FROM conversations)
QUALIFY row_number() OVER (PARTITION BY post_id ORDER BY position) <= 3 AND length(coalesce(content, '')) > 0""")
def q_cap_comments(spark, base):
    """First three comments of each post, of which every fifth length stands for a removed body."""
    c = comments_from_conversations(spark, base)
    c = c.withColumn("content", F.when(F.length("content") % 5 == 0, "").otherwise(F.col("content")))
    return I.cap_per_parent(c, 3)


@register("dedupe_posts", with_(SCORED) + f"""
SELECT post_id, topic, batch FROM (
  SELECT post_id, topic, 0 AS batch FROM scored WHERE processed_at < {SPLIT}
  UNION ALL SELECT post_id, topic, 1 FROM scored WHERE processed_at >= {OVERLAP})
QUALIFY row_number() OVER (PARTITION BY post_id ORDER BY batch, post_id) = 1""")
def q_dedupe_posts(spark, base):
    b0, b1 = _batches(spark, base)
    both = b0.select("post_id", "topic", F.lit(0).alias("batch")) \
        .unionByName(b1.select("post_id", "topic", F.lit(1).alias("batch")))
    return I.dedupe(both, "post_id", [F.col("batch")])


REGISTRY_SQL = """
cnts AS (SELECT lang AS name, source, count(*) AS n FROM documents GROUP BY 1, 2),
rtop AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY n DESC, source) AS rn FROM cnts),
reg0 AS (SELECT name, list(source ORDER BY rn) AS subreddits, sum(n) AS docs FROM rtop GROUP BY name),
registry AS (
  SELECT name, subreddits, CAST([] AS VARCHAR[]) AS keywords,
         row_number() OVER (ORDER BY docs, name DESC) > 1 AS active,
         TIMESTAMP '2024-01-31 00:00:00' - to_days(CAST(row_number() OVER (ORDER BY docs DESC, name) + 30 AS INTEGER))
           AS created_at,
         TIMESTAMP '2024-01-31 00:00:00' AS updated_at
  FROM reg0),
src_topic AS (
  SELECT subreddit, topic FROM (
    SELECT name AS topic, created_at, unnest(subreddits) AS subreddit, generate_subscripts(subreddits, 1) AS pos
    FROM registry WHERE active)
  QUALIFY row_number() OVER (PARTITION BY subreddit ORDER BY created_at, topic, pos) = 1)
"""


@register("topic_registry_derived", with_(REGISTRY_SQL) + """
SELECT name, array_to_string(subreddits, ',') AS subreddits, array_to_string(keywords, ',') AS keywords, active,
       created_at, updated_at FROM registry""")
def q_topic_registry_derived(spark, base):
    r = topics_from_documents(spark, base)
    return r.select("name", F.array_join("subreddits", ",").alias("subreddits"),
                    F.array_join("keywords", ",").alias("keywords"), "active", "created_at", "updated_at")


@register("assign_topics", with_(REGISTRY_SQL) + """
SELECT CAST(d.doc_id AS VARCHAR) AS post_id, d.source AS subreddit, s.topic
FROM documents d JOIN src_topic s ON d.source = s.subreddit""")
def q_assign_topics(spark, base):
    posts = posts_from_documents(spark, base).select("post_id", "subreddit")
    return I.assign_topics(posts, topics_from_documents(spark, base)).select("post_id", "subreddit", "topic")


@register("cap_per_source", with_(SCORED) + """
SELECT subreddit, post_id, score, rank FROM (
  SELECT subreddit, post_id, score, row_number() OVER (PARTITION BY subreddit ORDER BY score DESC, post_id) AS rank
  FROM scored) WHERE rank <= 25""")
def q_cap_per_source(spark, base):
    s = scored_from_events(spark, base)
    return I.cap_per_source(s, 25).select("subreddit", "post_id", "score", F.col("rank").cast("bigint").alias("rank"))


@register("first_nonempty", with_(SCORED) + """
SELECT post_id, topic, sentiment_e4, processed_at FROM scored
WHERE processed_at >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 24 HOUR""")
def q_first_nonempty(spark, base):
    """A5: a folder that isn't there, a window without rows, then the posts of the last day."""
    from ..sources.tables import first_nonempty
    s = scored_from_events(spark, base).select("post_id", "topic", "sentiment_e4", "processed_at")
    return first_nonempty([lambda: scan_lookback(f"{base}/no-such-table.parquet", spark, as_of=AS_OF),
                           lambda: scan_lookback(s, as_of="2034-01-31 00:00:00"),
                           lambda: scan_lookback(s, as_of=AS_OF)])


@register("active_topics", with_(REGISTRY_SQL) + """
SELECT 'registry' AS source, name, array_to_string(subreddits, ',') AS subreddits FROM registry WHERE active
UNION ALL SELECT 'defaults', name, subs FROM (VALUES """ + ", ".join(
    f"('{n}', '{','.join(subs)}')" for n, subs in DEFAULT_TOPICS) + """) d(name, subs)""")
def q_active_topics(spark, base):
    """Active topics of the registry, and those of the registry with all topics switched off."""
    reg = topics_from_documents(spark, base)
    off = reg.withColumn("active", F.col("active") & F.lit(False))
    parts = [I.active_topics(r).select(F.lit(n).alias("source"), "name", F.array_join("subreddits", ",").alias("subreddits"))
             for n, r in (("registry", reg), ("defaults", off))]
    return parts[0].unionByName(parts[1])
