"""Corpus ingest over the documents and pages tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern import views
from lectern.functions import chunking, vectors
from lectern.operators import ingest, progress
from lectern.plans.progress import _REPORT, _WITH
from lectern.plans.registry import query
from lectern.session import shared_folder
from lectern.sinks import tables
from lectern.sources import corpus
from lectern.sources import progress as saved
from lectern.views import with_views


@query(
    "s1_u4_corpus_scan",
    """
SELECT lang, count(*) AS documents, CAST(sum(length(text) + 1) AS BIGINT) AS chars FROM documents GROUP BY lang""",
)
def corpus_scan(spark, folder):
    """Documents written as text files below two roots, read back as whole files."""
    docs = views.table(spark, folder, "documents").select("lang", F.col("text").alias("value"))
    roots = []
    for names in (["en"], ["de", "es", "fr"]):
        root = shared_folder(spark, "corpus")
        docs.where(F.col("lang").isin(names)).write.partitionBy("lang").text(root)
        roots.append(root)
    files = corpus.read_corpus(spark, *roots)
    lang = F.regexp_extract("path", r"lang=(\w+)", 1)
    read = files.groupBy(lang.alias("lang")).agg(F.sum(F.length("text")).alias("chars"))
    n = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("documents"))
    return read.join(n, "lang").select("lang", "documents", "chars")


@query(
    "s2_density_routing",
    with_views("page_text") + """
SELECT doc_id, CAST(sum(CASE WHEN page_no < 3 THEN length(trim(text)) ELSE 0 END) AS BIGINT) AS text_chars,
       CASE WHEN sum(CASE WHEN page_no < 3 THEN length(trim(text)) ELSE 0 END) < 6000 THEN 'scanned' ELSE 'text' END AS kind
FROM page_text GROUP BY doc_id""",
)
def density_routing(spark, folder):
    return corpus.route_by_density(views.page_text(spark, folder), least=6000)


_FILES = """
files AS (SELECT doc_id, concat('/data/', CASE doc_id % 4 WHEN 0 THEN 'Grade_10/' WHEN 1 THEN 'class_9/' WHEN 2 THEN 'misc/' ELSE 'grade_8/' END,
    CASE doc_id % 3 WHEN 0 THEN 'NEB_' ELSE '' END, lang, CASE doc_id % 5 WHEN 0 THEN ' notes-' WHEN 1 THEN '_grade_10' ELSE '_' END,
    CAST(doc_id AS VARCHAR), '.txt') AS path FROM documents)"""


def _paths():
    n = F.col("doc_id")
    return F.concat(
        F.lit("/data/"),
        F.when(n % 4 == 0, "Grade_10/").when(n % 4 == 1, "class_9/").when(n % 4 == 2, "misc/").otherwise("grade_8/"),
        F.when(n % 3 == 0, "NEB_").otherwise(""), "lang",
        F.when(n % 5 == 0, " notes-").when(n % 5 == 1, "_grade_10").otherwise("_"), n.cast("string"), F.lit(".txt"),
    )


@query(
    "p1_path_metadata",
    f"""WITH {_FILES},
parts AS (SELECT doc_id, regexp_extract(lower(path), '(?:grade|class)_([0-9]+)', 1) AS g,
                 lower(regexp_replace(regexp_replace(split_part(path, '/', -1), '\\.[^.]*$', ''), '[^\\p{{L}}\\p{{N}}_]', '', 'g')) AS stem FROM files),
named AS (SELECT *, replace(CASE WHEN g <> '' THEN replace(stem, concat('_grade_', g), '') ELSE stem END, 'neb_', '') AS subject FROM parts)
SELECT doc_id, CASE WHEN g = '' THEN 'unknown' ELSE g END AS grade, subject,
       CASE WHEN g <> '' AND NOT contains(stem, concat('grade_', g)) THEN concat('neb_', subject, '_grade_', g)
            WHEN starts_with(stem, 'neb_') THEN stem ELSE concat('neb_', stem) END AS collection FROM named""",
)
def path_metadata(spark, folder):
    docs = views.table(spark, folder, "documents").withColumn("path", _paths())
    return docs.withColumns(corpus.path_metadata(F.col("path"))).select("doc_id", "grade", "subject", "collection")


@query(
    "f20_front_matter",
    """
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 2 = 0 THEN lang ELSE 'last: one' END AS title,
       CASE WHEN doc_id % 3 = 0 THEN NULL ELSE CAST(8 + doc_id % 5 AS VARCHAR) END AS grade,
       CASE WHEN doc_id % 3 = 0 THEN length(text) ELSE length(trim(text, concat(' ', chr(9), chr(10), chr(13)))) END AS body_chars
FROM documents""",
)
def front_matter(spark, folder):
    n = F.col("doc_id")
    head = F.concat(
        F.lit("---\ntitle: '"), "lang", F.lit("'\ngrade:  "), (8 + n % 5).cast("string"), F.lit("\nno colon\n"),
        F.when(n % 2 == 1, 'title: "last: one"\n').otherwise(""), F.lit("---\n\n"),
    )
    text = F.when(n % 3 == 0, F.col("text")).otherwise(F.concat(head, "text"))
    meta, body = chunking.front_matter(F.col("content"))
    return views.table(spark, folder, "documents").withColumn("content", text).select(
        "doc_id", F.try_element_at(meta, F.lit("title")).alias("title"), F.try_element_at(meta, F.lit("grade")).alias("grade"),
        F.length(body).cast("long").alias("body_chars"),
    )



_BLANK = "concat(' ', chr(9), chr(10), chr(13))"


def _spans(name: str, pattern: str) -> str:
    """Start and end of every match: lengths of the pieces between matches and of the matches, added up."""
    return f"""
{name}_parts AS (SELECT doc_id, text, regexp_split_to_array(text, '{pattern}') AS p, regexp_extract_all(text, '{pattern}') AS m FROM documents
                 WHERE regexp_matches(text, '{pattern}')),
{name}_rows AS (SELECT doc_id, text, unnest(m) AS m, unnest(p[1:len(m)]) AS p, unnest(range(1, len(m) + 1)) AS i FROM {name}_parts),
{name} AS (SELECT doc_id, text, z - length(m) AS a, z AS z FROM (
             SELECT *, CAST(sum(length(p) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS z FROM {name}_rows))"""


_CHUNKS = "WITH RECURSIVE" + ",".join([
    _spans("m1", r"(?s)\$\$.*?\$\$"), _spans("m2", r"\$[^\$]+?\$"), _spans("m3", r"(?s)\\\[.*?\\\]"), _spans("m4", r"\\\(.*?\\\)"),
    _spans("m5", r"[a-zA-Z]\s*[²³⁴⁵⁶⁷⁸⁹⁰₁₂₃₄₅₆₇₈₉₀\^]\s*[+\-=]"),
    _spans("c1", r"(?s)```.*?```"), _spans("c2", r"`[^`]+?`"), _spans("ends", r"[.!?]\s+"), _spans("gaps", r"\n\n+"),
]) + f""",
maths AS (SELECT doc_id, a, z FROM m1 UNION ALL SELECT doc_id, a, z FROM m2 UNION ALL SELECT doc_id, a, z FROM m3 UNION ALL SELECT doc_id, a, z FROM m4
  UNION ALL SELECT doc_id, a - length(regexp_extract(substr(text, 1, a), '[^.\\n?!]*$')),
                   z + length(regexp_extract(substr(text, z + 1), '^[^.\\n?!]*')) FROM m5),
flagged AS (SELECT *, CASE WHEN a <= max(z) OVER (PARTITION BY doc_id ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS f FROM maths),
numbered AS (SELECT *, sum(f) OVER (PARTITION BY doc_id ORDER BY a, z ROWS UNBOUNDED PRECEDING) AS island FROM flagged),
regions AS (SELECT doc_id, 'math' AS kind, min(a) AS a, max(z) AS z FROM numbered GROUP BY doc_id, island
  UNION ALL SELECT doc_id, 'code', a, z FROM c1 UNION ALL SELECT doc_id, 'code', a, z FROM c2),
guards AS (SELECT doc_id, list({{'a': a, 'z': z}} ORDER BY a, z) AS rs FROM regions GROUP BY doc_id),
stops AS (SELECT doc_id, list(DISTINCT b) AS bs FROM (SELECT doc_id, z AS b FROM ends UNION ALL SELECT doc_id, a FROM gaps) x
  WHERE NOT EXISTS (FROM regions r WHERE r.doc_id = x.doc_id AND x.b BETWEEN r.a AND r.z) GROUP BY doc_id),
texts AS (SELECT d.doc_id, d.text, length(d.text) AS n, coalesce(rs, []) AS rs, coalesce(bs, []) AS bs
  FROM documents d LEFT JOIN guards USING (doc_id) LEFT JOIN stops USING (doc_id)),
walk AS (
  SELECT doc_id, CAST(0 AS BIGINT) AS here, CAST(0 AS BIGINT) AS made, CAST(-1 AS BIGINT) AS last, false AS emit, CAST(0 AS BIGINT) AS s, CAST(0 AS BIGINT) AS e, '' AS piece, false AS done FROM texts
  UNION ALL
  SELECT doc_id, CASE WHEN fin THEN n WHEN onward > here THEN onward ELSE here + 256 END, made + CAST(emit AS BIGINT), newlast, emit, here, cut, piece, fin
  FROM (SELECT *, CASE WHEN cut - 51 > greatest(newlast, 0) THEN cut - 51 ELSE cut END AS onward
    FROM (SELECT *, fin OR length(piece) >= 100 AS emit, CASE WHEN fin OR length(piece) >= 100 THEN here ELSE last END AS newlast
      FROM (SELECT *, CASE WHEN fin THEN substr(text, here + 1) ELSE trim(substr(text, here + 1, cut - here), {_BLANK}) END AS piece
        FROM (SELECT *, CASE WHEN fin THEN n WHEN cut0 <> goal THEN cut0 WHEN sp > 0 AND goal - sp > here THEN goal - sp ELSE goal END AS cut
          FROM (SELECT *, strpos(reverse(substr(text, here + 1, goal - here)), ' ') AS sp,
                       coalesce(list_max(list_filter(bs, lambda b: b > here AND b <= goal)), goal) AS cut0
            FROM (SELECT *, coalesce(list_filter(rs, lambda r: r.a <= here + 512 AND here + 512 <= r.z)[1].z, here + 512) AS goal
              FROM (SELECT w.doc_id, w.here, w.made, w.last, t.text, t.n, t.rs, t.bs, w.here + 512 >= t.n OR t.n < 100 AS fin
                    FROM walk w JOIN texts t USING (doc_id) WHERE NOT w.done AND w.here < t.n)))))))),
chunks AS (SELECT doc_id, CAST(made - 1 AS INTEGER) AS chunk_id, CAST(s AS INTEGER) AS start_pos, CAST(e AS INTEGER) AS end_pos, piece AS text FROM walk WHERE emit)
"""


def _chunks(spark, folder):
    docs = views.corpus(spark, folder).select("doc_id", "collection", "source", "grade", "subject", "text")
    return ingest.chunk_documents(docs)


@query("f25_chunks", _CHUNKS + "SELECT * FROM chunks")
def chunks(spark, folder):
    return _chunks(spark, folder).select("doc_id", "chunk_id", "start_pos", "end_pos", "text")


@query(
    "f21_f22_regions",
    _CHUNKS + 'SELECT doc_id, kind, CAST(a AS INTEGER) AS "start", CAST(z AS INTEGER) AS "end" FROM regions',
)
def regions(spark, folder):
    docs = views.table(spark, folder, "documents")
    return docs.select("doc_id", F.explode(chunking.regions_of(F.col("text"))).alias("r")).select("doc_id", "r.*")


@query(
    "f21_f24_counts",
    r"""
SELECT doc_id, CAST(len(regexp_extract_all(text, '\$[^\$]+?\$')) AS INTEGER) AS formulas,
       CAST(len(regexp_extract_all(text, '[.!?]\s+')) AS INTEGER) AS sentences FROM documents""",
)
def region_counts(spark, folder):
    text = F.col("text")
    return views.table(spark, folder, "documents").select(
        "doc_id", F.regexp_count(text, F.lit(r"\$[^\$]+?\$")).alias("formulas"),
        chunking.sentence_count(text).alias("sentences"),
    )


@query(
    "f23_in_region",
    """
WITH spans AS (SELECT l_orderkey, date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS a, l_linenumber * 3 AS n FROM lineitem)
SELECT o_orderkey, CAST(coalesce(bool_or(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) + 30 BETWEEN a AND a + n), false) AS BOOLEAN) AS inside
FROM orders JOIN spans ON l_orderkey = o_orderkey GROUP BY o_orderkey""",
)
def position_in_region(spark, folder):
    """A position against the handful of spans of its own record."""
    day = lambda c: F.date_diff(F.col(c).cast("date"), F.lit("1992-01-01").cast("date"))
    spans = views.table(spark, folder, "lineitem").select(
        "l_orderkey", F.struct(day("l_shipdate").alias("start"), (day("l_shipdate") + F.col("l_linenumber") * 3).alias("end")).alias("r")
    )
    regions = spans.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list("r").alias("rs"))
    orders = views.table(spark, folder, "orders").select("o_orderkey", (day("o_orderdate") + 30).alias("p"))
    return orders.join(regions, "o_orderkey").select(
        "o_orderkey", chunking.in_region(F.col("p"), F.col("rs")).alias("inside")
    )


@query(
    "a18_merge_intervals",
    """
WITH spans AS (SELECT l_orderkey, date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS s,
                      date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) + CAST(l_quantity AS INTEGER) AS e FROM lineitem),
flagged AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY l_orderkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
            THEN 0 ELSE 1 END AS fresh FROM spans),
islands AS (SELECT *, sum(fresh) OVER (PARTITION BY l_orderkey ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM flagged)
SELECT l_orderkey, CAST(min(s) AS INTEGER) AS "start", CAST(max(e) AS INTEGER) AS "end" FROM islands GROUP BY l_orderkey, i""",
)
def merge_intervals(spark, folder):
    day = lambda c: F.date_diff(F.col(c).cast("date"), F.lit("1992-01-01").cast("date"))
    spans = views.table(spark, folder, "lineitem").select(
        "l_orderkey", day("l_shipdate").alias("start"), (day("l_shipdate") + F.col("l_quantity").cast("int")).alias("end")
    )
    return ingest.merge_intervals(spans, ["l_orderkey"])


@query(
    "a12_run_summary",
    _CHUNKS + """, held AS (SELECT doc_id FROM labels WHERE toxic = 1)
SELECT (SELECT count(*) FROM documents WHERE doc_id NOT IN (FROM held)) AS processed,
       (SELECT count(*) FROM chunks WHERE doc_id NOT IN (FROM held)) AS total_chunks,
       (SELECT count(*) FROM documents WHERE doc_id IN (FROM held)) AS failed""",
)
def run_summary(spark, folder):
    """Texts labelled toxic are withheld, so those documents fail."""
    held = views.table(spark, folder, "labels").where("toxic = 1").select("doc_id", F.lit(True).alias("held"))
    docs = views.table(spark, folder, "documents").select("doc_id", "text").join(held, "doc_id", "left")
    given = docs.select("doc_id", F.when(F.col("held").isNull(), F.col("text")).alias("text"))
    return ingest.run_summary(ingest.chunk_documents(given))


@query(
    "a11_chunks_per_collection",
    _CHUNKS + """
SELECT concat('neb_', lang, '_grade_', 8 + doc_id % 5) AS collection, count(*) AS chunks
FROM chunks JOIN documents USING (doc_id) GROUP BY 1""",
)
def per_collection(spark, folder):
    return ingest.chunks_per_collection(_chunks(spark, folder))


@query(
    "f26_embeddings",
    """
WITH tokens AS (SELECT conv_id, turn, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '')) AS t FROM conversations),
hashed AS (SELECT conv_id, turn, CAST(('0x' || substr(md5(t), 1, 8)) AS BIGINT) % 64 AS dim,
           CASE WHEN substr(md5(t), 9, 1) < '8' THEN 1 ELSE -1 END AS s FROM tokens),
summed AS (SELECT conv_id, turn, dim, sum(s) AS w FROM hashed GROUP BY ALL),
sized AS (SELECT *, sqrt(sum(w * w) OVER (PARTITION BY conv_id, turn)) AS n FROM summed)
SELECT conv_id, turn, CAST(dim AS INTEGER) AS dim, round(w / n, 4) AS weight FROM sized WHERE w <> 0""",
)
def embeddings(spark, folder):
    turns = views.table(spark, folder, "conversations").select("conv_id", "turn", "text")
    encoded = ingest.encode_chunks(turns, dim=64)
    return encoded.select("conv_id", "turn", F.posexplode("embedding").alias("dim", "w")).where("w <> 0").select(
        "conv_id", "turn", "dim", F.round(F.col("w").cast("double"), 4).alias("weight")
    )


@query(
    "s6_chunk_files",
    _CHUNKS + """
SELECT doc_id, chunk_id, text FROM chunks WHERE doc_id % 4 < 3""",
)
def chunk_files(spark, folder):
    """The chunks of every document in three shapes of stored chunk file; a fourth has no chunks."""
    chunks = ingest.chunk_documents(views.corpus(spark, folder).select("doc_id", "text")).where("text IS NOT NULL")
    # A file holds the chunks of one document.
    items = F.array_sort(F.collect_list(F.struct("chunk_id", "text")))
    files = chunks.groupBy("doc_id").agg(F.transform(items, lambda c: F.struct(c["text"].alias("text"), c["chunk_id"].alias("chunk_id"))).alias("items"))
    n = F.col("doc_id")
    as_list = F.to_json("items")
    content = (
        F.when(n % 4 == 0, as_list)
        .when(n % 4 == 1, F.to_json(F.struct(F.lit(1).alias("version"), F.col("items").alias("chunks"))))
        .when(n % 4 == 2, F.concat(F.lit('{"n": 3, "tags": ["a"], "parts": '), as_list, F.lit(', "more": [{"text": "no"}]}')))
        .otherwise(F.lit('{"n": 0, "tags": []}'))
    )
    return corpus.chunk_file_items(files.select("doc_id", content.alias("value"))).select("doc_id", "chunk_id", "text")


@query(
    "k2_chunk_files",
    _CHUNKS + """
SELECT doc_id, concat('doc', doc_id, '_chunk_', lpad(CAST(chunk_id AS VARCHAR), 3, '0'), '.txt') AS file_name,
       concat('# Chunk ', chunk_id, chr(10), '# Source: ', source, chr(10), '# Grade: ', 8 + doc_id % 5, chr(10), '# Subject: ', lang, chr(10),
              '# Chapter: unknown', chr(10), '# Position: ', start_pos, '-', end_pos, chr(10), chr(10), c.text) AS file_text
FROM chunks c JOIN documents USING (doc_id)""",
)
def headed_chunks(spark, folder):
    meta = F.create_map(
        F.lit("source_file"), "source", F.lit("grade"), F.col("grade").cast("string"), F.lit("subject"), "subject"
    )
    stem = F.concat(F.lit("doc"), F.col("doc_id").cast("string"))
    return ingest.chunk_file(_chunks(spark, folder), stem, meta).select("doc_id", "file_name", "file_text")


@query(
    "k1_w3_upsert",
    """
SELECT concat('neb_', lang, '_grade_', 8 + doc_id % 5, '_', doc_id, '_0') AS id, concat('neb_', lang, '_grade_', 8 + doc_id % 5) AS collection,
       CASE WHEN quality IS NULL THEN 1 ELSE 2 END AS version, CASE WHEN quality IS NULL THEN source ELSE concat('q', quality) END AS source
FROM documents LEFT JOIN labels USING (doc_id)""",
)
def upserted(spark, folder):
    """Every document is stored; then the labelled ones are written again, newer."""
    path = shared_folder(spark, "chunks")
    rows = views.corpus(spark, folder).withColumn("id", ingest.chunk_key(F.col("collection"), F.col("doc_id"), F.lit(0)))
    first = rows.select("id", "collection", F.lit(1).alias("version"), "source")
    second = rows.join(views.table(spark, folder, "labels"), "doc_id").select(
        "id", "collection", F.lit(2).alias("version"), F.concat(F.lit("q"), F.col("quality").cast("string")).alias("source")
    )
    for batch in (first, second):
        tables.upsert(batch, path, ["collection", "id"], ["version"], within=["collection"], buckets=2)
    return tables.read_table(spark, path).select("id", "collection", "version", "source")


@query(
    "k1_out_of_order",
    """
SELECT doc_id AS id, CAST(CASE WHEN doc_id % 3 = 0 THEN 9 WHEN doc_id % 2 = 0 THEN 5 ELSE 2 END AS INTEGER) AS seq,
       CASE WHEN doc_id % 3 = 0 THEN source WHEN doc_id % 2 = 0 THEN lang ELSE text END AS value FROM documents""",
)
def upserted_out_of_order(spark, folder):
    """Three batches whose order is not that of their arrival, each asking for another number of buckets."""
    path = shared_folder(spark, "ordered")
    docs = views.table(spark, folder, "documents")
    batches = [(5, "doc_id % 2 = 0", "lang"), (9, "doc_id % 3 = 0", "source"), (2, "true", "text")]
    for n, (seq, some, value) in enumerate(batches):
        rows = docs.where(some).select(F.col("doc_id").alias("id"), F.lit(seq).alias("seq"), F.col(value).alias("value"))
        tables.upsert(rows, path, ["id"], ["seq"], buckets=4 << n)
    return tables.read_table(spark, path).select("id", "seq", "value")


@query(
    "s7_progress_scan",
    with_views("attempts") + """
SELECT user_id, subject, topic, concept, question, count(*) AS attempts, count(*) FILTER (WHERE correct) AS correct
FROM attempts GROUP BY ALL""",
)
def progress_scan(spark, folder):
    """Counts nested into one JSON text per learner and taken apart again."""
    counts = progress.attempt_counts(views.attempts(spark, folder))
    texts = saved.export_progress(saved.nest_progress(counts))
    parsed = texts.select("user_id", F.from_json("json", saved.PROGRESS).alias("progress"))
    return saved.explode_progress(parsed)


@query(
    "k6_progress_store",
    with_views("attempts") + """
SELECT a.user_id, CAST(sum(1 + CAST(b.user_id IS NOT NULL AS INTEGER)) AS BIGINT) AS attempts,
       count(DISTINCT concat(subject, topic, concept, question)) AS questions
FROM attempts a LEFT JOIN (SELECT DISTINCT user_id FROM events WHERE value >= 150) b USING (user_id)
WHERE a.user_id NOT IN (SELECT user_id FROM events WHERE value >= 300) GROUP BY a.user_id""",
)
def progress_store(spark, folder):
    """Save every learner, import doubled attempts for some, reset those with one very large value."""
    path = shared_folder(spark, "progress")
    events = views.table(spark, folder, "events")
    counts = progress.attempt_counts(views.attempts(spark, folder))
    some = events.where("value >= 150").select("user_id").distinct()
    gone = events.where("value >= 300").select("user_id").distinct()
    saved.save_progress(saved.nest_progress(counts).withColumn("saved_at", F.lit(1)), path)
    doubled = counts.join(some, "user_id", "left_semi").withColumn("attempts", F.col("attempts") * 2)
    saved.import_progress(saved.export_progress(saved.nest_progress(doubled)).withColumn("saved_at", F.lit(2)), path)
    saved.reset_progress(gone.withColumn("saved_at", F.lit(3)), path)
    kept = saved.explode_progress(tables.read_table(spark, path))
    return kept.groupBy("user_id").agg(F.sum("attempts").alias("attempts"), F.count(F.lit(1)).alias("questions"))


def _reports(spark, folder):
    counts = progress.attempt_counts(views.attempts(spark, folder))
    return progress.student_report(counts, views.catalogue(spark, folder)), counts


_STUDENT = "user_id long, total_questions long, total_attempts long, total_correct long, mastered_questions long, weak_questions long"
_WEAK = "user_id long, subject string, topic string, concept string, question string, attempts long"


def _student_files(spark, folder):
    """The student report and its weak questions as CSV; returns where they lie."""
    reports, counts = _reports(spark, folder)
    path = shared_folder(spark, "report")
    tables.write_reports(reports, progress.weak_questions(counts, views.catalogue(spark, folder)), path)
    return path


@query("k4_student_report_files", _WITH + f",{_REPORT} SELECT * FROM report")
def report_files(spark, folder):
    return spark.read.schema(_STUDENT).option("header", True).csv(f"{_student_files(spark, folder)}/report")


@query(
    "k4_weak_question_files",
    _WITH + "SELECT user_id, subject, topic, concept, question, attempts FROM counts WHERE attempts >= 2 AND correct = 0",
)
def weak_question_files(spark, folder):
    return spark.read.schema(_WEAK).option("header", True).csv(f"{_student_files(spark, folder)}/weak")


def _class_files(spark, folder):
    """The class report, averages with two places, and its weak concepts as JSON; returns where they lie."""
    reports, counts = _reports(spark, folder)
    averages = ["average_mastered_questions", "average_total_correct"]
    told = progress.class_report(reports).withColumns({c: F.format_string("%.2f", c) for c in averages})
    weak = progress.class_weak_concepts(progress.weak_questions(counts, views.catalogue(spark, folder)), counts, share=0.15)
    path = shared_folder(spark, "class")
    tables.write_reports(told, weak, path, "json")
    return path


@query(
    "k5_class_report_files",
    _WITH + f""",{_REPORT}
SELECT count(*) AS total_students, printf('%.2f', avg(mastered_questions)) AS average_mastered_questions,
       printf('%.2f', avg(total_correct)) AS average_total_correct FROM report""",
)
def class_report_files(spark, folder):
    schema = "total_students long, average_mastered_questions string, average_total_correct string"
    return spark.read.schema(schema).json(f"{_class_files(spark, folder)}/report")


@query(
    "k5_weak_concept_files",
    _WITH + """
SELECT subject, topic, concept, count(*) AS questions, count(DISTINCT user_id) AS students FROM counts
WHERE attempts >= 2 AND correct = 0 GROUP BY ALL HAVING count(*) >= greatest(1, floor(0.15 * (SELECT count(DISTINCT user_id) FROM attempts)))""",
)
def weak_concept_files(spark, folder):
    schema = "subject string, topic string, concept string, questions long, students long"
    return spark.read.schema(schema).json(f"{_class_files(spark, folder)}/weak")


@query(
    "k3_embedding_table",
    _CHUNKS + """
SELECT concat('neb_', lang, '_grade_', 8 + doc_id % 5) AS collection, count(*) AS chunks, count(*) AS vectors FROM chunks c JOIN documents USING (doc_id) GROUP BY 1""",
)
def embedding_table(spark, folder):
    """Chunk, encode and store the corpus; every vector has length one, or is zero where its words cancel."""
    path = shared_folder(spark, "embedded")
    rows = ingest.encode_chunks(_chunks(spark, folder).withColumn(
        "id", ingest.chunk_key(F.col("collection"), F.col("doc_id"), F.col("chunk_id"))
    ))
    tables.upsert(
        rows.select("collection", "id", "doc_id", "text", "embedding"), path, ["collection", "id"], ["doc_id"],
        within=["collection"], buckets=2,
    )
    size = vectors.norm(F.col("embedding"))
    sound = (F.size("embedding") == 64) & ((F.abs(size - 1) < 1e-3) | (size == 0))
    return tables.read_table(spark, path).groupBy("collection").agg(
        F.count(F.lit(1)).alias("chunks"), F.count_if(sound).alias("vectors")
    )
