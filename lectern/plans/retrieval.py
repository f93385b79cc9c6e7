"""Vector retrieval over the embeddings and documents tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern import views
from lectern.functions import vectors
from lectern.operators import ingest, inverted, layout, retrieval, store
from lectern.plans.registry import query
from lectern.session import shared_folder
from lectern.views import with_views

# Whole documents stand in the store, so the queries' context is longer than the default.
BUDGET = 20_000

_HITS = """
scored AS (
  SELECT q.query_id, s.collection, s.vec_id, s.text,
         round(list_cosine_similarity(CAST(q.query_embedding AS DOUBLE[]), CAST(s.embedding AS DOUBLE[])), 12) AS score
  FROM query_vectors q, store s),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, collection ORDER BY score DESC, vec_id) AS rank FROM scored),
hits AS (SELECT * FROM placed WHERE rank <= 2)"""

_RANKED = f"""{_HITS},
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, collection, vec_id) AS place
  FROM (SELECT *, round(score * 0.7 + 50 / 100.0 * 0.3, 12) AS final_score, 'External' AS source_type
        FROM hits WHERE length(trim(text)) >= 10))"""

_FITTED = f"""{_RANKED},
fitted AS (
  SELECT * FROM (SELECT *, sum(length(text)) OVER (PARTITION BY query_id ORDER BY place
                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running_length
                 FROM ranked WHERE final_score >= 0.35) WHERE running_length < {BUDGET})"""


def _six(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


@query(
    "j2_w1_top_hits",
    with_views("store", "query_vectors") + f", {_HITS} "
    "SELECT query_id, collection, vec_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM hits",
)
def top_hits(spark, folder):
    hits = retrieval.top_hits(views.query_vectors(spark, folder), views.vector_store(spark, folder))
    return hits.select("query_id", "collection", "vec_id", *_six("score"), "rank")


@query(
    "j2_l2_metric",
    with_views("store", "query_vectors") + """
SELECT query_id, collection, vec_id, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, collection ORDER BY score DESC, vec_id) AS rank FROM (
    SELECT q.query_id, s.collection, s.vec_id, round(1 - list_sum(list_transform(range(1, len(s.embedding) + 1),
        lambda i: power(CAST(q.query_embedding[i] AS DOUBLE) - CAST(s.embedding[i] AS DOUBLE), 2))), 12) AS score
    FROM query_vectors q, store s)) WHERE rank <= 2""",
)
def l2_hits(spark, folder):
    hits = retrieval.top_hits(
        views.query_vectors(spark, folder), views.vector_store(spark, folder), metric="l2"
    )
    return hits.select("query_id", "collection", "vec_id", *_six("score"))


@query(
    "j2_every_vector",
    """
WITH hits AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, collection ORDER BY score DESC, vec_id) AS rank FROM (
    SELECT q.vec_id AS query_id, concat('c', s.label) AS collection, s.vec_id,
           round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(s.embedding AS DOUBLE[])), 12) AS score
    FROM embeddings q, embeddings s))
SELECT query_id, collection, vec_id, round(score, 6) AS score FROM hits WHERE rank <= 2""",
)
def every_vector(spark, folder):
    """Each stored vector asks for its nearest two in every collection, in hash blocks of probes and items."""
    vecs = views.table(spark, folder, "embeddings")
    store = vecs.select("vec_id", F.concat(F.lit("c"), F.col("label").cast("string")).alias("collection"), "embedding")
    asked = vecs.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    hits = retrieval.top_hits(asked, store, probe_rows=200, item_rows=200)
    return hits.select("query_id", "collection", "vec_id", *_six("score"))


@query(
    "j2_inverted_exact",
    with_views("query_vectors") + """
SELECT query_id, vec_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
    SELECT q.query_id, s.vec_id, round(list_cosine_similarity(CAST(q.query_embedding AS DOUBLE[]), CAST(s.embedding AS DOUBLE[])), 12) AS score
    FROM query_vectors q, embeddings s)) WHERE rank <= 5""",
)
def inverted_exact(spark, folder):
    """The five nearest of all vectors by the inverted file, gone on with until the bound says that they are."""
    index = inverted.build(views.table(spark, folder, "embeddings").select("vec_id", "embedding"))
    hits = inverted.top_hits(views.query_vectors(spark, folder), index, 5, exact=True)
    return hits.select("query_id", "vec_id", *_six("score"), "rank")


@query("j2_inverted_chunks")
def inverted_chunks(spark, folder):
    """Every question's two nearest chunks in each collection that it may use, from the inverted file over all chunks."""
    asked, store, collections = _asked_chunks(spark, folder)
    index = inverted.build(store)
    chosen = retrieval.select_collections(asked, collections).join(asked.select("request_id", "embedding"), "request_id")
    queries = chosen.select(F.col("request_id").alias("query_id"), "collection", F.col("embedding").alias("query_embedding"))
    hits = inverted.top_hits(queries, index, 2, by="collection")
    return hits.select("query_id", "collection", "vec_id", *_six("score"), "rank")


def _asked_chunks(spark, folder):
    """Questions with subject, grade and embedding; chunks of the corpus with theirs; the collections there are."""
    corpus = views.corpus(spark, folder)
    chunks = layout.written(ingest.encode_chunks(ingest.chunk_documents(corpus.select("doc_id", "collection", "text"))), "chunks")
    store = chunks.select(F.xxhash64("doc_id", "chunk_id").alias("vec_id"), "collection", "embedding")
    turns = views.questions(spark, folder)
    languages = corpus.select("subject").distinct()
    one = turns.select(
        F.xxhash64("conv_id", "turn").alias("request_id"), "question", (8 + F.col("conv_id") % 5).cast("string").alias("grade"),
        (F.col("conv_id") % 4).alias("n"),
    )
    named = languages.withColumn("n", F.row_number().over(Window.orderBy("subject")).cast("long") - 1)  # one row per language
    asked = one.join(named, "n").withColumn("embedding", vectors.encoder_udf()(F.col("question")))
    return layout.written(asked, "asked"), store, corpus.select("collection")


@query(
    "s8_list_collections",
    with_views("store") + "SELECT DISTINCT collection FROM store",
)
def list_collections(spark, folder):
    return views.vector_store(spark, folder).select("collection").distinct()


@query(
    "s8_get_collection",
    with_views("store") + "SELECT vec_id, text FROM store WHERE collection = 'c3'",
)
def get_collection(spark, folder):
    return views.vector_store(spark, folder).where(F.col("collection") == "c3").select("vec_id", "text")


_REQUESTS = """
requests AS (SELECT doc_id AS request_id, CASE doc_id % 4 WHEN 0 THEN 'science' WHEN 1 THEN 'English'
                    WHEN 2 THEN lang ELSE 'history' END AS subject, 8 + doc_id % 7 AS grade FROM documents),
names AS (SELECT DISTINCT collection FROM corpus
          UNION SELECT CASE doc_id % 5 WHEN 0 THEN 'scienceqa' WHEN 1 THEN 'fineweb_edu' WHEN 2 THEN 'openstax_science'
                       WHEN 3 THEN 'khanacademy_pedagogy' ELSE 'gsm8k' END FROM documents)"""

_MAPPED = """VALUES ('science', 'openstax_science', 0), ('science', 'scienceqa', 1),
                    ('english', 'fineweb_edu', 0), ('english', 'khanacademy_pedagogy', 1)"""


def _laid_out(spark, folder):
    """The corpus as a store by collection."""
    path = shared_folder(spark, "store")
    store.write_store(views.corpus(spark, folder).select("doc_id", "collection", "text"), path)
    return path


@query("s8_folder_listing", with_views("corpus") + "SELECT DISTINCT collection FROM corpus")
def folder_listing(spark, folder):
    """The collections of the store by its folders."""
    return store.collections(spark, _laid_out(spark, folder))


@query(
    "o1_pruned_store",
    with_views("corpus") + """,
wanted AS (SELECT DISTINCT concat('neb_', lang, '_grade_', 8 + user_id % 3) AS collection FROM (SELECT DISTINCT user_id FROM events), (SELECT max(lang) AS lang FROM documents))
SELECT doc_id, collection, length(text) AS n FROM corpus SEMI JOIN wanted USING (collection)""",
)
def pruned_store(spark, folder):
    """The rows of the collections that the users' grades select in one language; the other folders are not read."""
    held = store.read_store(spark, _laid_out(spark, folder))
    lang = views.table(spark, folder, "documents").agg(F.max("lang")).scalar()
    grade = (8 + F.col("user_id") % 3).cast("string")
    asked = views.table(spark, folder, "events").select("user_id").distinct().select(F.concat(F.lit("neb_"), lang, F.lit("_grade_"), grade).alias("collection"))
    return store.selected_rows(held, asked).select("doc_id", "collection", F.length("text").cast("long").alias("n"))


@query(
    "p2_j10_select_collections",
    with_views("corpus") + f""", {_REQUESTS},
found AS (
  SELECT r.request_id, n.collection, 0 AS tier, 0 AS place FROM requests r JOIN names n
    ON contains(lower(n.collection), concat('neb_', replace(lower(r.subject), ' ', '_'), '_grade_', CAST(r.grade AS VARCHAR)))
  UNION ALL
  SELECT r.request_id, m.collection, 1, m.place FROM requests r
    JOIN ({_MAPPED}) m(subject, collection, place) ON lower(r.subject) = m.subject JOIN names n ON n.collection = m.collection),
every AS (
  SELECT * FROM found UNION ALL
  SELECT r.request_id, f.collection, 2, f.place FROM requests r,
    (VALUES ('khanacademy_pedagogy', 0), ('fineweb_edu', 1)) f(collection, place)
  WHERE r.request_id NOT IN (SELECT request_id FROM found) AND f.collection IN (SELECT collection FROM names))
SELECT request_id, collection, choice FROM (
  SELECT request_id, collection,
         CAST(row_number() OVER (PARTITION BY request_id ORDER BY tier, place, collection) AS INTEGER) AS choice FROM every)
WHERE choice <= 3""",
)
def select_collections(spark, folder):
    docs = views.table(spark, folder, "documents")
    n = F.col("doc_id")
    subject = F.when(n % 4 == 0, "science").when(n % 4 == 1, "English").when(n % 4 == 2, F.col("lang")).otherwise("history")
    requests = docs.select(n.alias("request_id"), subject.alias("subject"), (8 + n % 7).alias("grade"))
    extra = (
        F.when(n % 5 == 0, "scienceqa").when(n % 5 == 1, "fineweb_edu").when(n % 5 == 2, "openstax_science")
        .when(n % 5 == 3, "khanacademy_pedagogy").otherwise("gsm8k")
    )
    names = views.corpus(spark, folder).select("collection").union(docs.select(extra))
    return retrieval.select_collections(requests, names)


@query(
    "o1_search_selected",
    with_views("store", "query_vectors") + f""", {_HITS.replace('FROM query_vectors q, store s',
        "FROM query_vectors q, store s WHERE CAST(substr(s.collection, 2) AS INTEGER) IN "
        "(q.query_id % 10, (q.query_id + 3) % 10, (q.query_id + 7) % 10)")}
SELECT query_id, collection, vec_id, round(score, 6) AS score FROM hits""",
)
def search_selected(spark, folder):
    name = lambda n: F.concat(F.lit("c"), ((F.col("query_id") + n) % 10).cast("string"))
    asked = views.query_vectors(spark, folder).withColumn("collections", F.array(name(0), name(3), name(7)))
    hits = retrieval.top_hits(asked, views.vector_store(spark, folder), selected=True)
    return hits.select("query_id", "collection", "vec_id", *_six("score"))


@query(
    "t1_ranked_hits",
    with_views("store", "query_vectors") + f""", {_RANKED}
SELECT query_id, vec_id, round(final_score, 6) AS final_score, CAST(place AS INTEGER) AS place FROM ranked""",
)
def ranked_hits(spark, folder):
    store = views.vector_store(spark, folder)
    hits = retrieval.top_hits(views.query_vectors(spark, folder), store)
    return retrieval.rank_hits(retrieval.with_texts(hits, store), "collection").select("query_id", "vec_id", *_six("final_score"), "place")


@query(
    "w2_t3_context",
    with_views("store", "query_vectors") + f""", {_FITTED}
SELECT query_id, vec_id, collection, round(score, 6) AS original_score, round(final_score, 6) AS final_score, source_type,
       CAST(running_length AS BIGINT) AS running_length,
       CAST(row_number() OVER (PARTITION BY query_id ORDER BY source_type <> 'NEB', place) AS INTEGER) AS position, text
FROM fitted""",
)
def context(spark, folder):
    out = retrieval.retrieve_context(views.query_vectors(spark, folder), views.vector_store(spark, folder), budget=BUDGET)
    return out.select(
        "query_id", "vec_id", "collection", F.round("score", 6).alias("original_score"), *_six("final_score"),
        "source_type", "running_length", "position", "text",
    )


@query(
    "t2_t3_priority_order",
    with_views("corpus") + """, weighed AS (
  SELECT doc_id, source, CASE WHEN contains(lower(tag), 'neb') THEN 100 WHEN contains(lower(tag), 'openstax') THEN 70
       WHEN contains(lower(tag), 'khanacademy') THEN 65 WHEN contains(lower(tag), 'finemath') OR contains(lower(tag), 'gsm8k')
         OR contains(lower(tag), 'scienceqa') THEN 60 ELSE 50 END AS priority, grade, text
  FROM (SELECT *, concat(CASE doc_id % 6 WHEN 0 THEN 'NEB_' WHEN 1 THEN 'openstax_' WHEN 2 THEN 'KhanAcademy_' WHEN 3
        THEN 'gsm8k_' WHEN 4 THEN 'unknown' ELSE '' END, source) AS tag FROM corpus)),
scored AS (
  SELECT *, round((doc_id % 97) / 97.0 * 0.7 + priority / 100.0 * 0.3
        + CASE WHEN contains(text, CAST(grade AS VARCHAR)) THEN 0.1 ELSE 0 END, 12) AS final_score
  FROM weighed WHERE length(trim(text)) >= 10)
SELECT doc_id, CAST(priority AS INTEGER) AS priority, round(final_score, 6) AS final_score,
       CASE WHEN priority = 100 THEN 'NEB' ELSE 'External' END AS source_type,
       CAST(row_number() OVER (PARTITION BY doc_id // 20 ORDER BY priority <> 100, final_score DESC, doc_id) AS INTEGER) AS position
FROM scored WHERE final_score >= 0.35""",
)
def priority_order(spark, folder):
    """Metadata repair, weights, grade bonus and the primary-first order over the whole corpus."""
    n = F.col("doc_id")
    prefix = (
        F.when(n % 6 == 0, "NEB_").when(n % 6 == 1, "openstax_").when(n % 6 == 2, "KhanAcademy_")
        .when(n % 6 == 3, "gsm8k_").when(n % 6 == 4, "unknown").otherwise("")
    )
    hits = views.corpus(spark, folder).select(
        F.floor(n / 20).alias("query_id"), n.alias("vec_id"), F.lit("c").alias("collection"), "grade", "text",
        F.concat(prefix, "source").alias("source"), ((n % 97) / 97.0).alias("score"),
    )
    ranked = retrieval.rank_hits(hits, grade="grade", query_text="text")
    ordered = retrieval.primary_first(retrieval.above_floor(ranked))
    return ordered.select(
        F.col("vec_id").alias("doc_id"), retrieval.source_priority(F.col("source")).alias("priority"),
        *_six("final_score"), "source_type", "position",
    )


@query(
    "f39_metadata_repair",
    """
SELECT doc_id, source2 AS source, CASE WHEN type <> 'unknown' THEN type
       WHEN source2 IN ('openstax', 'khanacademy', 'fineweb_edu', 'finemath', 'scienceqa') THEN 'General Knowledge'
       ELSE 'Supplemental' END AS type
FROM (SELECT *, CASE WHEN lower(source) = 'unknown' OR source = '' THEN seed ELSE source END AS source2 FROM (
  SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Unknown' WHEN 1 THEN '' ELSE source END AS source,
         CASE doc_id % 2 WHEN 0 THEN 'openstax' ELSE lang END AS seed,
         CASE doc_id % 5 WHEN 0 THEN 'notes' ELSE 'unknown' END AS type FROM documents))""",
)
def metadata_repair(spark, folder):
    n = F.col("doc_id")
    hits = views.table(spark, folder, "documents").select(
        "doc_id",
        F.when(n % 3 == 0, "Unknown").when(n % 3 == 1, "").otherwise(F.col("source")).alias("source"),
        F.when(n % 2 == 0, "openstax").otherwise(F.col("lang")).alias("seed_data"),
        F.when(n % 5 == 0, "notes").when(n % 10 == 1, None).otherwise("unknown").alias("type"),
    )
    return retrieval.repair_metadata(hits).select("doc_id", "source", "type")


@query(
    "f27_f28_vector_math",
    """
SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine,
       round(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS dot,
       round(1 - list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def vector_math(spark, folder):
    a = views.table(spark, folder, "embeddings").select("vec_id", "embedding")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    pair = a.join(b, "vec_id")
    cosine = vectors.cosine(F.col("embedding"), F.col("other"))
    return pair.select(
        "vec_id", F.round(cosine, 6).alias("cosine"),
        F.round(vectors.dot(F.col("embedding"), F.col("other")), 6).alias("dot"),
        F.round(vectors.score_of_distance(cosine), 6).alias("score"),
    )


@query(
    "p6_p7_quality_filters",
    """
SELECT doc_id FROM documents WHERE length(trim(text)) >= 10 AND (doc_id % 100) / 100.0 >= 0.35""",
)
def quality_filters(spark, folder):
    docs = views.table(spark, folder, "documents").withColumn("final_score", F.col("doc_id") % 100 / 100.0)
    return retrieval.above_floor(docs.where(F.length(F.trim("text")) >= 10)).select("doc_id")
