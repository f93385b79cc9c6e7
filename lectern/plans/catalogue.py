"""Keyword catalogue: the benchmark texts as entries, the conversations as questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern import lexicon, views
from lectern.functions import catalogue as cat
from lectern.functions.words import truncate_at_word
from lectern.operators import catalogue
from lectern.plans.questions import _sql_any, sql_words
from lectern.plans.registry import query
from lectern.sources import catalogue as source
from lectern.views import with_views

_STOP = ", ".join(f"'{w}'" for w in lexicon.TITLE_STOPWORDS)


def _sql_terms(expr: str) -> str:
    return (
        f"list_filter(regexp_split_to_array(lower({expr}), '[^\\p{{L}}\\p{{N}}_]+'), "
        f"lambda w: regexp_full_match(w, '[a-z]{{3,}}') AND NOT list_contains([{_STOP}], w))[1:5]"
    )


_SUBJECT = "CASE id % 3 WHEN 0 THEN 'Science' WHEN 1 THEN 'english' ELSE 'maths' END"
_ENTRIES = f"""shaped AS (
  SELECT id, title, CASE WHEN length(title) % 2 = 0 THEN 'process' ELSE 'structure' END AS type, lower({_SUBJECT}) AS subject,
         [8 + id % 5, 9 + id % 3] AS grades,
         CASE WHEN length(title) % 3 = 0 THEN list_transform({sql_words('title')}[6:12], lambda k: upper(replace(k, 'ß', 'ss'))) END AS given FROM entries),
known AS (SELECT *, list_distinct(list_concat(list_transform(coalesce(given, list_concat({_sql_terms('title')}, [type])), lambda k: lower(k)),
                                              {_sql_terms('title')})) AS terms FROM shaped)"""


def _entries(spark, folder):
    n = F.col("id")
    given = F.transform(F.slice(F.filter(F.split("title", r"\s+"), lambda w: w != ""), 6, 7), lambda k: F.upper(F.replace(k, F.lit("ß"), F.lit("ss"))))
    return views.keyword_entries(spark, folder).select(
        "id", "title", F.when(F.length("title") % 2 == 0, "process").otherwise("structure").alias("type"),
        F.when(n % 3 == 0, "Science").when(n % 3 == 1, "english").otherwise("maths").alias("subject"),
        F.array((8 + n % 5).cast("int"), (9 + n % 3).cast("int")).alias("grades"),
        F.when(F.length("title") % 3 == 0, given).alias("keywords"),
    )


_SCORED = """
pairs AS (SELECT conv_id, turn, id, len(list_intersect(q, terms)) AS m, len(q) AS n FROM asked, known WHERE {where}),
scored AS (SELECT *, least(1.0, m / n * CASE WHEN m >= 2 THEN 1.1 ELSE 1 END) AS confidence FROM pairs WHERE m > 0)
SELECT conv_id, turn, id, round(confidence, 6) AS confidence FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY confidence DESC, id) AS r FROM scored) WHERE r = 1 AND confidence >= 0.15"""


@query(
    "j4_f19_match",
    with_views("messy", "entries") + f", {_ENTRIES}, asked AS (SELECT conv_id, turn, list_distinct({_sql_terms('question')}) AS q FROM messy),"
    + _SCORED.format(where="true"),
)
def match(spark, folder):
    out = catalogue.match_questions(views.messy_questions(spark, folder), _entries(spark, folder), floor=0.15)
    return out.select("conv_id", "turn", "id", F.round("confidence", 6).alias("confidence"))


_WANTED = """asked AS (SELECT conv_id, turn, list_distinct({terms}) AS q,
  CASE turn % 4 WHEN 0 THEN 'SCIENCE' WHEN 1 THEN NULL WHEN 2 THEN 'english' ELSE 'latin' END AS s,
  CASE conv_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 3 ELSE 8 + conv_id % 5 END AS g FROM messy),
valid AS (SELECT *, CASE WHEN lower(s) IN (SELECT subject FROM known) THEN lower(s) END AS vs,
  CASE WHEN g IN (SELECT unnest(grades) FROM known) THEN g END AS vg FROM asked),
narrowed AS (SELECT * EXCLUDE (vs, vg), CASE WHEN ok THEN vs END AS vs, CASE WHEN ok THEN vg END AS vg FROM (
  SELECT *, EXISTS (FROM known k WHERE (vs IS NULL OR k.subject = vs) AND (vg IS NULL OR list_contains(k.grades, vg))) AS ok FROM valid))"""


@query(
    "j4_u2_match_filtered",
    with_views("messy", "entries") + f", {_ENTRIES}, " + _WANTED.format(terms=_sql_terms("question")) + ","
    + _SCORED.format(where="(vs IS NULL OR subject = vs) AND (vg IS NULL OR list_contains(grades, vg))").replace("FROM asked, known", "FROM narrowed, known"),
)
def match_filtered(spark, folder):
    t, n = F.col("turn"), F.col("conv_id")
    asked = views.messy_questions(spark, folder).withColumns({
        "subject": F.when(t % 4 == 0, "SCIENCE").when(t % 4 == 2, "english").when(t % 4 == 3, "latin"),
        "grade": F.when(n % 5 == 1, 3).when(n % 5 > 1, 8 + n % 5),
    })
    out = catalogue.match_questions(asked, _entries(spark, folder), floor=0.15)
    return out.select("conv_id", "turn", "id", F.round("confidence", 6).alias("confidence"))


@query(
    "f17_f18_u3_terms",
    with_views("entries") + f", {_ENTRIES} SELECT id, array_to_string(list_sort(terms), ' ') AS terms, array_to_string({_sql_terms('title')}, ' ') AS title_terms FROM known",
)
def terms(spark, folder):
    out = catalogue.normalise_entries(_entries(spark, folder))
    return out.select(
        "id", F.array_join(F.array_sort("terms"), " ").alias("terms"), F.array_join(cat.key_terms(F.col("title")), " ").alias("title_terms")
    )


@query(
    "f17_corpus_terms",
    f"SELECT doc_id, array_to_string({_sql_terms('text')}, ' ') AS terms FROM documents",
)
def corpus_terms(spark, folder):
    return views.table(spark, folder, "documents").select("doc_id", F.array_join(cat.key_terms(F.col("text")), " ").alias("terms"))


@query(
    "a16_subject_grade_index",
    with_views("entries") + f""", {_ENTRIES}
SELECT 'subject' AS kind, subject AS key, count(*) AS entries, min(id) AS first FROM known GROUP BY subject
UNION ALL SELECT 'grade', CAST(g AS VARCHAR), count(*), min(id) FROM (SELECT id, unnest(grades) AS g FROM known) GROUP BY g""",
)
def index(spark, folder):
    entries = catalogue.normalise_entries(_entries(spark, folder))
    count = [F.count(F.lit(1)).alias("entries"), F.min("id").alias("first")]
    s = catalogue.by_subject(entries).groupBy(F.lit("subject").alias("kind"), F.col("subject").alias("key")).agg(*count)
    g = catalogue.by_grade(entries).groupBy(F.lit("grade").alias("kind"), F.col("grade").cast("string").alias("key")).agg(*count)
    return s.union(g)


_TRIGGER = " ".join(f"WHEN contains(t, '{w}') THEN '{k}'" for w, k in lexicon.TRIGGER_WORDS)


@query(
    "j12_trigger_words",
    f"""
SELECT doc_id, CASE {_TRIGGER} END AS key FROM (
  SELECT doc_id, lower(concat(CASE doc_id % 5 WHEN 0 THEN 'an Electron and an ' WHEN 1 THEN 'Series Circuit ' WHEN 2 THEN 'the Triangle ' ELSE '' END, text)) AS t
  FROM documents)""",
)
def trigger_words(spark, folder):
    n = F.col("doc_id")
    head = F.when(n % 5 == 0, "an Electron and an ").when(n % 5 == 1, "Series Circuit ").when(n % 5 == 2, "the Triangle ").otherwise("")
    return views.table(spark, folder, "documents").select("doc_id", cat.trigger_key(F.concat(head, "text")).alias("key"))


@query(
    "s5_f18_catalogue_scan",
    """
SELECT concat(subject, '_item', item_id) AS id, subject, grades, title, kw FROM (
  SELECT item_id, text AS title, CASE item_id % 3 WHEN 0 THEN 'science' WHEN 1 THEN 'maths' ELSE 'folder' END AS subject,
         CASE item_id % 4 WHEN 0 THEN '10' WHEN 1 THEN '8,9' WHEN 2 THEN '11' ELSE '' END AS grades,
         CASE item_id % 2 WHEN 0 THEN 'alpha|two words' END AS kw FROM benchmark)""",
)
def catalogue_scan(spark, folder):
    """One file per item; every file exists twice and the later path wins. JSON text is YAML too."""
    n = F.col("item_id")
    head = F.concat(
        F.when(n % 3 == 0, '"subject": "Science", ').when(n % 3 == 1, '"subject": "MATHS", ').otherwise(""),
        F.when(n % 4 == 0, '"grade": 10, ').when(n % 4 == 1, '"grades": [8, "9", "x"], ').when(n % 4 == 2, '"grade": "all", ').otherwise(""),
    )
    entry = F.to_json(F.struct(
        F.col("text").alias("title"), F.lit("process").alias("type"),
        F.when(n % 2 == 0, F.array(F.lit("alpha"), F.lit("two words"))).alias("keywords"),
    ))
    value = F.concat(
        F.lit('{"metadata": {'), head, F.lit('"version": 1}, "diagrams": {"item'), n.cast("string"), F.lit('": '), entry,
        F.lit(', "note": "not an entry"}}'),
    )
    items = views.table(spark, folder, "benchmark")
    path = F.concat(F.lit("/db/Folder/grade_11_"), n.cast("string"))
    new = items.select(F.concat(path, F.lit("b.yaml")).alias("path"), value.alias("value"))
    old = items.select(F.concat(path, F.lit("a.yaml")).alias("path"), F.regexp_replace(value, '"title":"', '"title":"old ').alias("value"))
    bad = items.select(F.lit("/db/z.yaml").alias("path"), F.concat(F.lit("{["), "text").alias("value"))
    rows = source.parse_files(new.union(old).union(bad))
    return rows.select(
        "id", "subject", F.array_join(F.transform("grades", lambda g: g.cast("string")), ",").alias("grades"), "title",
        F.array_join("keywords", "|").alias("kw"),
    )


@query(
    "f34_display_names",
    r"""
SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda s: left(trim(regexp_replace(s, '\s*\([^)]+\)\s*$', '')), 30)), '|') AS steps,
       array_to_string(list_concat(['first', source, 'Kind'], list_transform(string_split(text, chr(10)), lambda s: s))[1:8], '|') AS children
FROM documents""",
)
def display_names(spark, folder):
    lines = F.split("text", "\n")
    mixed = F.concat(
        F.array(F.lit("first"), F.to_json(F.struct(F.col("source").alias("name"), F.lit(1).alias("x"))), F.lit('{"Kind": {"children": []}}')), lines
    )
    return views.table(spark, folder, "documents").select(
        "doc_id", F.array_join(cat.clean_steps(lines), "|").alias("steps"), F.array_join(cat.child_names(mixed), "|").alias("children")
    )


@query(
    "f37_truncate",
    f"""
WITH w AS (SELECT doc_id, text, {sql_words('text')} AS w FROM documents),
fits AS (SELECT *, len(list_filter(range(1, len(w) + 1), lambda n: list_sum(list_transform(w[1:n], lambda x: length(x) + 1)) <= 77)) AS n FROM w)
SELECT doc_id, CASE WHEN length(text) <= 80 THEN text WHEN n < len(w) THEN concat(array_to_string(w[1:n], ' '), '...')
       ELSE array_to_string(w, ' ') END AS short FROM fits""",
)
def truncated(spark, folder):
    return views.table(spark, folder, "documents").select("doc_id", truncate_at_word(F.col("text"), 80).alias("short"))


@query(
    "f38_templates",
    """
SELECT event_id, CASE event_type WHEN 'view' THEN 'compare_contrast' WHEN 'click' THEN 'flowchart' WHEN 'error' THEN 'structure'
       WHEN 'signup' THEN 'structure' ELSE 'flowchart' END AS template, event_type <> 'purchase' AS valid FROM events""",
)
def templates(spark, folder):
    kind = F.col("event_type")
    named = (
        F.when(kind == "view", "comparison").when(kind == "click", "Process").when(kind == "error", "HIERARCHY")
        .when(kind == "signup", "structure").otherwise(kind)
    )
    return views.table(spark, folder, "events").select(
        "event_id", cat.template_of(named).alias("template"), cat.is_concept_type(named).alias("valid")
    )
