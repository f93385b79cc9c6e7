"""Caches, rate limits and streams over the events, embeddings, documents and conversations tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern import views
from lectern.operators import cache, ingest, jumps, ordered, questions
from lectern.operators.capacity import cached as held_in_order
from lectern.plans.ingest import _CHUNKS
from lectern.plans.registry import query
from lectern.session import shared_folder
from lectern.sinks import tables
from lectern.streaming import jobs

HOUR = 3_600_000_000
DAY = 24 * HOUR

_TIMED = "timed AS (SELECT *, epoch_us(ts) AS us FROM events)"


def _timed(df):
    return df.withColumn("us", views.micros(F.col("ts")))


def _events(spark, folder):
    return _timed(views.table(spark, folder, "events"))


@query(
    "j6_exact_cache",
    f"""WITH {_TIMED}
SELECT r.event_id, CASE WHEN r.us - f.us <= {6 * HOUR} THEN f.value END AS value
FROM (FROM timed WHERE event_type <> 'purchase') r ASOF LEFT JOIN (FROM timed WHERE event_type = 'purchase') f
  ON r.props = f.props AND r.us > f.us""",
)
def exact_cache(spark, folder):
    """Purchases fill the cache under their props, the other events ask it."""
    events = _events(spark, folder).withColumnRenamed("props", "key")
    bought = F.col("event_type") == "purchase"
    asked = events.where(~bought).select("event_id", "key", "us")
    return cache.exact_hits(asked, events.where(bought).select("key", "us", "value"), 6 * HOUR).select("event_id", "value")


_VECTORS = f"""{_TIMED},
stamped AS (SELECT vec_id, concat('s', label % 3) AS subject, '' AS grade, us, embedding FROM embeddings JOIN timed ON event_id = vec_id)"""
_SEMANTIC = f"""{_VECTORS},
pairs AS (SELECT r.vec_id AS request_id, e.vec_id AS entry_id,
            round(list_cosine_similarity(CAST(r.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 12) AS score
          FROM stamped r JOIN stamped e ON r.subject = e.subject AND r.grade = e.grade AND r.us > e.us AND r.us - e.us <= {DAY}),
best AS (SELECT * FROM pairs WHERE score >= 0.3 QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY score DESC, entry_id) = 1)"""


def _stamped(spark, folder):
    events = _events(spark, folder).select(F.col("event_id").alias("vec_id"), "us")
    return views.table(spark, folder, "embeddings").join(events, "vec_id").select(
        "vec_id", F.concat(F.lit("s"), (F.col("label") % 3).cast("string")).alias("subject"), F.lit("").alias("grade"), "us", "embedding"
    )


@query("j3_semantic_cache", f"WITH {_SEMANTIC} SELECT request_id, entry_id, round(score, 6) AS score FROM best")
def semantic_cache(spark, folder):
    """Every vector asks the vectors stored in the day before it."""
    rows = _stamped(spark, folder)
    hits = cache.semantic_hits(
        rows.withColumnRenamed("vec_id", "request_id"), rows.withColumnRenamed("vec_id", "entry_id"), threshold=0.3, ttl=DAY
    )
    return hits.select("request_id", "entry_id", F.round("score", 6).alias("score"))


@query(
    "o9_cache_misses",
    f"WITH {_SEMANTIC} SELECT vec_id AS request_id FROM stamped WHERE vec_id NOT IN (SELECT request_id FROM best)",
)
def cache_misses(spark, folder):
    """The same look-up in hash blocks, then the requests left over."""
    asked = _stamped(spark, folder).withColumnRenamed("vec_id", "request_id")
    entries = _stamped(spark, folder).withColumnRenamed("vec_id", "entry_id")
    hits = cache.semantic_hits(asked, entries, threshold=0.3, ttl=DAY, probe_rows=100, item_rows=100)
    return cache.misses(asked, hits).select("request_id")


@query(
    "a13_cache_size",
    f"""WITH {_TIMED} SELECT count(*) AS size FROM (SELECT props, user_id, max(us) AS us FROM timed GROUP BY ALL)
WHERE (SELECT max(us) FROM timed) - us <= {DAY}""",
)
def cache_size(spark, folder):
    fills = _events(spark, folder).withColumn("key", F.concat_ws("|", "props", F.col("user_id").cast("string")))
    return cache.live_size(fills, fills.agg(F.max("us")).scalar(), DAY)


@query(
    "w5_r4_capacity",
    f"""WITH {_TIMED} SELECT props AS key, user_id, max(us) AS us FROM timed GROUP BY ALL ORDER BY us DESC, key, user_id LIMIT 100""",
)
def capacity(spark, folder):
    fills = _events(spark, folder).select(F.col("props").alias("key"), "user_id", "us")
    return cache.newest(fills, 100, ["key", "user_id"])


@query(
    "s10_w4_last_rows",
    "SELECT event_id, value FROM events WHERE value < 10 ORDER BY ts DESC, event_id DESC LIMIT 100",
)
def last_rows(spark, folder):
    low = views.table(spark, folder, "events").where("value < 10")
    return cache.last_rows(low, 100, ["ts", "event_id"]).select("event_id", "value")


@query(
    "w7_trailing_count",
    f"""WITH {_TIMED} SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY us RANGE BETWEEN {HOUR - 1} PRECEDING AND CURRENT ROW) AS recent FROM timed""",
)
def trailing_count(spark, folder):
    return ordered.trailing_count(_events(spark, folder), ["event_type"], "us", HOUR).select("event_id", "recent")


_LIMITED = f"""WITH RECURSIVE {_TIMED}, seq AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS n FROM timed),
walk AS (
  SELECT event_id, user_id, n, [us] AS kept, true AS accepted FROM seq WHERE n = 1
  UNION ALL
  SELECT event_id, user_id, n, CASE WHEN len(k) >= 3 THEN k ELSE list_append(k, us) END, len(k) < 3
  FROM (SELECT s.event_id, s.user_id, s.n, s.us, list_filter(w.kept, lambda t: s.us - t < {2 * DAY}) AS k
        FROM walk w JOIN seq s ON s.user_id = w.user_id AND s.n = w.n + 1))
SELECT event_id, accepted FROM walk"""


@query("r3_rate_limit", _LIMITED)
def rate_limit(spark, folder):
    """Three requests per user in two days."""
    out = ordered.rate_limited(_events(spark, folder), "user_id", "us", "event_id", 2 * DAY, 3)
    return out.select("event_id", "accepted")


def _stream(spark, folder, key):
    """What a keyed scan of the events needs, and no more: a micro-batch's rows of one key lie in one task's Python."""
    events = jobs.read_table_stream(spark, folder, "events")
    return _timed(events).select("event_id", key, "us", F.timestamp_micros("us").alias("ts"))


@query("r3_rate_limit_stream", _LIMITED)
def rate_limit_stream(spark, folder):
    limited = jobs.rate_limiter(_stream(spark, folder, "user_id"), "user_id", "us", "event_id", 2 * DAY, 3)
    path = shared_folder(spark, "limited")
    jobs.append_to(limited.select("event_id", "accepted"), path).awaitTermination()
    return spark.read.parquet(path)


_CACHED = f"""WITH RECURSIVE {_TIMED}, fills AS (
  SELECT event_type, min(us) AS us FROM timed GROUP BY 1
  UNION ALL SELECT f.event_type, min(t.us) FROM fills f JOIN timed t ON t.event_type = f.event_type AND t.us > f.us + {HOUR} GROUP BY 1)
SELECT event_id, NOT EXISTS (FROM fills f WHERE f.event_type = t.event_type AND f.us = t.us) AS hit FROM timed t"""


@query("r2_ttl_cache", _CACHED)
def ttl_cache(spark, folder):
    out = ordered.ttl_cached(_events(spark, folder), "event_type", "us", "event_id", HOUR)
    return out.select("event_id", "hit")


@query("r2_ttl_jumps", _CACHED)
def ttl_jumps(spark, folder):
    """The same cache by pointer doubling, in blocks that cut every key."""
    out = jumps.ttl_cached(_events(spark, folder), ["event_type"], "us", "event_id", HOUR, block_rows=1024)
    return out.select("event_id", "hit")


ROOM = 60

# A walk over each shard's requests with the held entries as a list in order of their fill.
_HELD = f"""WITH RECURSIVE {_TIMED}, seq AS (SELECT event_id, event_type, props, us, row_number() OVER (PARTITION BY event_type ORDER BY us, event_id) AS n FROM timed),
walk AS (
  SELECT event_id, event_type, n, [{{'k': props, 't': us}}] AS held, false AS hit, false AS expired, NULL::VARCHAR AS evicted FROM seq WHERE n = 1
  UNION ALL
  SELECT event_id, event_type, n, CASE WHEN hit THEN was ELSE list_append(CASE WHEN len(kept) >= {ROOM} THEN kept[2:] ELSE kept END, {{'k': props, 't': us}}) END,
         hit, NOT hit AND len(kept) < len(was), CASE WHEN NOT hit AND len(kept) >= {ROOM} THEN kept[1].k END
  FROM (SELECT s.*, w.held AS was, len(list_filter(w.held, lambda e: e.k = s.props AND s.us - e.t <= {3 * DAY})) > 0 AS hit,
               list_filter(w.held, lambda e: e.k <> s.props) AS kept
        FROM walk w JOIN seq s ON s.event_type = w.event_type AND s.n = w.n + 1))
SELECT event_id, hit, expired, evicted FROM walk"""


@query("r4_capacity_cache", _HELD)
def capacity_cache(spark, folder):
    """A cache per event type with room for 60 props, each good for three days."""
    out = held_in_order(_events(spark, folder), "event_type", "props", "us", "event_id", ROOM, 3 * DAY, block_rows=512)
    return out.select("event_id", "hit", "expired", "evicted")


@query("r2_ttl_cache_stream", _CACHED)
def ttl_cache_stream(spark, folder):
    cached = jobs.ttl_cache(_stream(spark, folder, "event_type"), "event_type", "us", "event_id", HOUR)
    path = shared_folder(spark, "cached")
    jobs.append_to(cached.select("event_id", "hit"), path).awaitTermination()
    return spark.read.parquet(path)


@query(
    "r1_attempt_counters",
    views.with_views("attempts") + """
SELECT user_id, subject, topic, concept, question, count(*) AS attempts, count(*) FILTER (WHERE correct) AS correct FROM attempts GROUP BY ALL""",
)
def attempt_counters(spark, folder):
    """The counters as a stream keeps them."""
    stream = views.attempts_of(jobs.read_table_stream(spark, folder, "events"))
    path = shared_folder(spark, "counters")
    jobs.attempt_counters(stream, path).awaitTermination()
    return tables.read_table(spark, path).drop("bucket")


@query(
    "r5_k7_k8_feedback",
    views.with_views("messy") + """
SELECT count(*) AS logged, count(*) FILTER (WHERE length(question) < 3) AS review FROM messy""",
)
def feedback(spark, folder):
    """Normalised questions appended as JSON; those under 0.7 also go to a review log."""
    turns = jobs.read_table_stream(spark, folder, "conversations")
    logs = questions.feedback_log(views.messy_of(turns))
    path, review = shared_folder(spark, "feedback"), shared_folder(spark, "review")
    jobs.feedback(logs, path, review).awaitTermination()
    schema = "original string, clean string, confidence double, intent string, notes array<string>"
    log = spark.read.schema(schema).json(path).agg(F.count(F.lit(1)).alias("logged"))
    kept = spark.read.schema(schema).json(review).agg(F.count(F.lit(1)).alias("review"))
    return log.select("logged", kept.scalar().alias("review"))


# The chunks of the corpus in which every other document has half its text.
_CHUNKS_AGAIN = _CHUNKS.replace("documents", "halved").replace("WITH RECURSIVE", """WITH RECURSIVE halved AS (
SELECT * REPLACE (CASE WHEN doc_id % 2 = 0 THEN substr(text, 1, length(text) // 2) ELSE text END AS text) FROM documents),""", 1)


@query(
    "r6_incremental_ingest",
    _CHUNKS_AGAIN + """
SELECT concat('neb_', lang, '_grade_', 8 + doc_id % 5) AS collection, doc_id, chunk_id, c.text FROM chunks c JOIN documents USING (doc_id)""",
)
def incremental_ingest(spark, folder):
    """The corpus streamed in twice; in the second run every other document has half its text, and fewer chunks."""
    path = shared_folder(spark, "ingested")
    half = F.substring(F.col("text"), F.lit(1), F.floor(F.length("text") / 2).cast("int"))
    for text in (F.col("text"), F.when(F.col("doc_id") % 2 == 0, half).otherwise(F.col("text"))):
        docs = views.corpus_of(jobs.read_table_stream(spark, folder, "documents")).withColumn("text", text)
        jobs.incremental_ingest(docs, path).awaitTermination()
    return tables.read_table(spark, path).select("collection", "doc_id", "chunk_id", "text")


_LATER = _SEMANTIC.replace("r.us > e.us", "r.vec_id % 2 = 1 AND e.vec_id % 2 = 0 AND r.us > e.us")


@query(
    "r7_semantic_stream",
    f"""WITH {_LATER}
SELECT vec_id AS request_id, entry_id, round(score, 6) AS score, entry_id IS NULL AS stored FROM stamped LEFT JOIN best ON request_id = vec_id""",
)
def semantic_stream(spark, folder):
    """From an empty cache: the vectors of even id all miss and are stored; those of odd id then ask for them."""
    entries, hits = shared_folder(spark, "entries"), shared_folder(spark, "hits")
    events = _events(spark, folder).select(F.col("event_id").alias("vec_id"), "us")
    for parity in (0, 1):
        stream = jobs.read_table_stream(spark, folder, "embeddings").join(events, "vec_id").where(F.col("vec_id") % 2 == parity).select(
            F.col("vec_id").alias("request_id"), F.concat(F.lit("s"), (F.col("label") % 3).cast("string")).alias("subject"),
            F.lit("").alias("grade"), "us", "embedding",
        )
        jobs.semantic_cache(stream, entries, hits, threshold=0.3, ttl=DAY).awaitTermination()
    found = spark.read.parquet(hits).select("request_id", "entry_id", F.round("score", 6).alias("score"), F.lit(False).alias("stored"))
    kept = spark.read.parquet(entries).select(
        F.col("entry_id").alias("request_id"), F.lit(None).cast("long").alias("entry_id"), F.lit(None).cast("double").alias("score"), F.lit(True).alias("stored"),
    )
    return found.unionByName(kept)


@query(
    "s4_feedback_scan",
    "SELECT event_type AS user_id, count(*) AS rows, count(*) FILTER (WHERE value < 20) AS low FROM events GROUP BY 1",
)
def feedback_scan(spark, folder):
    """A JSON-lines log with blank and broken lines, read back with the fixed schema."""
    from lectern.sources import logs

    path = shared_folder(spark, "log")
    rows = views.table(spark, folder, "events").select(F.to_json(F.struct(
        F.col("ts").cast("string").alias("timestamp"), F.col("event_type").alias("user_id"), F.col("props").alias("original"),
        (F.col("value") / 100).alias("confidence"),
    )).alias("value"))
    broken = views.table(spark, folder, "region").select(F.concat(F.lit("{"), "r_name").alias("value"))
    blank = views.table(spark, folder, "region").select(F.lit("").alias("value"))
    rows.union(broken).union(blank).write.text(path)
    good = logs.read_feedback(spark, path).where("corrupt IS NULL")
    return good.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("confidence") < 0.2).alias("low")
    )


@query(
    "a14_metric_summary",
    """
SELECT event_type AS metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS min, max(value) AS max FROM events GROUP BY 1""",
)
def metric_summary(spark, folder):
    from lectern.operators import summary

    out = summary.describe(views.table(spark, folder, "events"), "value", [F.col("event_type").alias("metric")])
    return out.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})
