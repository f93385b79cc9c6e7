"""Curricula made from the documents: a line is a topic, a sentence a subtopic, a clause a nested one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern import views
from lectern.functions.words import let, words
from lectern.operators import content_check, curriculum
from lectern.operators.layout import scratch, spread_small, written
from lectern.plans.questions import sql_words
from lectern.plans.registry import query
from lectern.session import shared_folder
from lectern.sinks import tables
from lectern.sources import curriculum as source
from lectern.views import with_views


def _files(spark, folder):
    """The curriculum files, made from the documents and stored."""
    return written(_made_files(spread_small(views.table(spark, folder, "documents"))), "curricula", codec="zstd")


def _made_files(documents):
    """(doc_id, path, value, flat) with value the JSON of one curriculum per document."""

    def concept(text):
        def shaped(w):
            question = F.struct(
                F.concat(text, F.lit("?")).alias("question"), F.slice(w, 1, 2).alias("acceptable_answers"),
                F.when(F.size(w) > 2, F.slice(w, -1, 1)).alias("hints"),
            )
            return F.struct(
                F.lower(F.coalesce(F.get(w, F.lit(0)), F.lit(""))).alias("name"), text.alias("summary"), w.alias("steps"),
                F.array(question).alias("questions"),
            )

        return let(words(text), shaped)

    def subtopic(text, j):
        clauses = text.contains(",")
        return F.struct(
            F.concat(F.lit("S"), j.cast("string")).alias("name"),
            F.when(~clauses, F.array(concept(text))).alias("concepts"),
            F.when(clauses, F.transform(F.split(text, ","), lambda c, k: F.struct(
                F.concat(F.lit("P"), k.cast("string")).alias("name"), F.array(concept(c)).alias("concepts")
            ))).alias("subtopics"),
        )

    topics = F.transform(F.split("text", "\n"), lambda line, i: F.struct(
        F.concat(F.lit("T"), i.cast("string")).alias("name"),
        F.transform(F.split(line, r"\. "), subtopic).alias("subtopics"),
    ))
    subject = F.concat("lang", F.lit("-"), F.col("doc_id").cast("string"))
    value = F.to_json(F.struct(
        subject.alias("subject"), (8 + F.col("doc_id") % 7).cast("string").alias("grade"), topics.alias("topics")
    ))
    path = F.concat(F.lit("/content/"), F.col("doc_id").cast("string"), F.lit(".json"))
    return documents.select("doc_id", path.alias("path"), value.alias("value"), F.lit(True).alias("flat"))


def _subjects(spark, folder):
    return source.load(_files(spark, folder))


def _flat(spark, folder):
    return curriculum.flatten_concepts(_subjects(spark, folder))


_TREE = f"""WITH lines AS (
  SELECT doc_id, lang, concat(lang, '-', doc_id) AS subject, unnest(l) AS line, unnest(range(len(l))) AS i
  FROM (SELECT *, string_split(text, chr(10)) AS l FROM documents)),
sentences AS (SELECT * EXCLUDE ss, unnest(ss) AS sentence, unnest(range(len(ss))) AS j FROM (SELECT *, string_split(line, '. ') AS ss FROM lines)),
clauses AS (SELECT * EXCLUDE cs, unnest(cs) AS clause, unnest(range(len(cs))) AS k FROM (SELECT *, string_split(sentence, ',') AS cs FROM sentences)),
flat AS (SELECT doc_id, subject, concat('T', i) AS topic, i, j, k, contains(sentence, ',') AS nested, clause AS summary,
  CASE WHEN contains(sentence, ',') THEN concat('S', j, '/P', k) ELSE concat('S', j) END AS path,
  CASE WHEN contains(sentence, ',') THEN concat_ws('.', i, 1, j, 1, k, 0, 0) ELSE concat_ws('.', i, 1, j, 0, 0) END AS ord,
  {sql_words('clause')} AS w FROM clauses),
named AS (SELECT *, lower(coalesce(w[1], '')) AS concept FROM flat)
"""


def _shown(df):
    return df.withColumns({"path": F.array_join("subtopic_path", "/"), "ord": F.array_join("ord", ".")})


@query("p22_flatten_concepts", _TREE + "SELECT subject, topic, path, ord, concept, summary FROM named")
def flatten(spark, folder):
    return _shown(_flat(spark, folder)).select("subject", "topic", "path", "ord", "concept", "summary")


LEVELS = 7


@query(
    "p22_deep_curriculum",
    f"""
SELECT doc_id, concat('c', n, '-', source) AS concept, array_to_string(list_transform(range(1, n + 1), lambda x: concat('l', x)), '/') AS path,
       md5(text) AS summary FROM documents, range(1, {LEVELS + 1}) t(n)""",
)
def deep_curriculum(spark, folder):
    """A curriculum per document with a concept on each of seven levels of subtopics."""
    node = None
    for n in range(LEVELS, 0, -1):
        own = F.struct(F.concat(F.lit(f"c{n}-"), "source").alias("name"), F.col("text").alias("summary"))
        fields = [F.lit(f"l{n}").alias("name"), F.array(own).alias("concepts")]
        node = F.struct(*fields, *([] if node is None else [F.array(node).alias("subtopics")]))
    topics = F.array(F.struct(F.lit("t").alias("name"), F.array(node).alias("subtopics")))
    content = F.to_json(F.struct(F.col("doc_id").cast("string").alias("subject"), F.lit("9").alias("grade"), topics.alias("topics")))
    files = views.table(spark, folder, "documents").select(
        F.format_string("/c/%d.json", "doc_id").alias("path"), content.alias("value"), F.lit(True).alias("flat")
    )
    return curriculum.flatten_concepts(source.load(files)).select(
        F.col("subject").cast("long").alias("doc_id"), "concept", F.array_join("subtopic_path", "/").alias("path"), F.md5("summary").alias("summary"),
    )


@query(
    "d1a_flat_questions",
    _TREE + """
SELECT subject, ord, concat(summary, '?') AS question, array_to_string(w[1:2], '|') AS answers,
       CASE WHEN len(w) > 2 THEN w[len(w)] END AS hint FROM named""",
)
def flat_questions(spark, folder):
    rows = curriculum.flatten_questions(_flat(spark, folder))
    return _shown(rows).select(
        "subject", "ord", "question", F.array_join("acceptable_answers", "|").alias("answers"),
        F.get("hints", F.lit(0)).alias("hint"),
    )


@query(
    "s3_load_curriculum",
    """
SELECT lang AS subject, grade, path, len(string_split(text, chr(10))) AS topics FROM (
  SELECT lang, CAST(8 + doc_id % 7 AS VARCHAR) AS grade, concat('/content/', doc_id, '.json') AS path, text,
         row_number() OVER (PARTITION BY lang ORDER BY concat('/content/', doc_id, '.json') DESC) AS n FROM documents) WHERE n = 1""",
)
def load_curriculum(spark, folder):
    """Files of one language claim the same subject: the last path wins. Broken files are skipped."""
    renamed = F.regexp_replace("value", r'^\{"subject":"(\w+)-\d+"', '{"subject":"$1"')
    good = _files(spark, folder).withColumn("value", renamed)
    broken = views.table(spark, folder, "benchmark").select(
        F.lit(-1).cast("long").alias("doc_id"), F.lit("/content/zzz.json").alias("path"),
        F.concat(F.lit("{"), "text").alias("value"), F.lit(True).alias("flat"),
    )
    out = source.load(good.unionByName(broken))
    return out.select("subject", "grade", "path", F.array_size("topics").cast("long").alias("topics"))


LOOKUP_PARTS = 8


@query(
    "p14_lookups",
    _TREE + """
, asked AS (SELECT DISTINCT subject, topic, concept FROM named WHERE k = 0)
SELECT subject, topic, concept, ord, concat(summary, '?') AS question FROM (
  SELECT n.*, row_number() OVER (PARTITION BY n.subject, n.topic, n.concept ORDER BY i, j, k) AS r FROM named n
  JOIN asked USING (subject, topic, concept)) WHERE r = 1""",
)
def lookups(spark, folder):
    """Every concept that opens a sentence, looked up by name with its first question."""
    keys, opening = ["subject", "topic", "concept"], F.coalesce(F.get("subtopic_path", F.lit(1)), F.lit("P0")) == "P0"
    part = F.pmod(F.xxhash64("subject"), F.lit(LOOKUP_PARTS)).cast("int")
    with scratch(spark):
        # Read three times: parsed once, and written without the columns and fields that no step asks for.
        with scratch(spark):
            questions = F.transform("questions", lambda q: F.struct(q["question"].alias("question")))
            flat = written(_flat(spark, folder).select(
                *keys, "ord", questions.alias("questions"), opening.alias("opening"), part.alias("part")
            ), "concepts", codec="zstd", by="part", keep=True)
        # A subject lies in one part; its shuffles go before those of the next part are made.
        parts = []
        for n in range(LOOKUP_PARTS):
            concepts = flat.where(F.col("part") == n).select(*keys, "ord", "questions")
            asked = flat.where((F.col("part") == n) & F.col("opening")).select(*keys).distinct()
            found = curriculum.lookup_concepts(concepts, asked)
            first = curriculum.lookup_question(concepts, asked.withColumn("question_no", F.lit(0)))
            answered = found.select(*keys, F.array_join("ord", ".").alias("ord")).join(first.select(*keys, "question"), keys)
            parts.append(written(answered, "lookups", codec="zstd", keep=True))
    return reduce(DataFrame.unionByName, parts)


@query(
    "p14_subjects_topics",
    _TREE + "SELECT subject, topic, count(*) AS concepts FROM named GROUP BY ALL",
)
def subjects_topics(spark, folder):
    return _flat(spark, folder).groupBy("subject", "topic").agg(F.count(F.lit(1)).alias("concepts"))


@query(
    "p15_concepts_at_path",
    _TREE + """
SELECT subject, topic, path AS at, ord, concept FROM named
UNION ALL SELECT subject, topic, '', ord, concept FROM named
UNION ALL SELECT subject, topic, concat('S', j), ord, concept FROM named WHERE nested""",
)
def at_path(spark, folder):
    """Every browse entry asks for the concepts at its path."""
    flat = written(_flat(spark, folder).select("subject", "topic", "concept", "subtopic_path", "ord"), "concepts")
    asked = curriculum.browse_entries(flat).select("subject", "topic", "path")
    out = curriculum.concepts_below_paths(flat, asked)
    return out.select("subject", "topic", F.array_join("path", "/").alias("at"), F.array_join("ord", ".").alias("ord"), "concept")


@query(
    "a17_f36_browse_entries",
    _TREE + """
SELECT DISTINCT subject, topic AS label FROM named
UNION ALL SELECT DISTINCT subject, concat(topic, ' > S', j) FROM named
UNION ALL SELECT DISTINCT subject, concat(topic, ' > S', j, ' > P', k) FROM named WHERE nested""",
)
def browse(spark, folder):
    return curriculum.browse_entries(_flat(spark, folder)).select("subject", "label")


@query(
    "a15_structure_profile",
    """
SELECT concat(lang, '-', doc_id) AS subject, CAST(len(l) AS INTEGER) AS topics, concat('T', i) AS topic, 0 AS direct_concepts,
       CAST(len(string_split(l[i + 1], '. ')) AS INTEGER) AS subtopics
FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS l, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)""",
)
def structure(spark, folder):
    return curriculum.structure_profile(_subjects(spark, folder)).select(
        "subject", "topics", "topic", "direct_concepts", "subtopics"
    )


@query(
    "p20_p21_violations",
    _TREE + """
, broken AS (
  SELECT concat(lang, '-', doc_id) AS subject, 'subject' AS rule FROM documents
  UNION ALL SELECT concat(lang, '-', doc_id), 'grade' FROM documents WHERE 8 + doc_id % 7 > 12
  UNION ALL SELECT subject, 'concept_name' FROM named WHERE concept = ''
  UNION ALL SELECT subject, 'concept_summary' FROM named WHERE trim(summary) = ''
  UNION ALL SELECT subject, 'steps_empty' FROM named WHERE len(w) = 0
  UNION ALL SELECT subject, 'answers_empty' FROM named WHERE len(w) = 0
  UNION ALL SELECT subject, 'question_fields' FROM named WHERE len(w) <= 2)
SELECT subject, rule, count(*) AS n FROM broken GROUP BY ALL""",
)
def violations(spark, folder):
    out = curriculum.violations(_subjects(spark, folder))
    return out.groupBy("subject", "rule").agg(F.count(F.lit(1)).alias("n"))


@query(
    "p20_strict_schema",
    r"""
WITH made AS (SELECT doc_id, 5 + doc_id % 4 AS depth, regexp_matches(text, '^\s*$') AS blank FROM documents WHERE text IS NOT NULL), leaves AS (FROM made WHERE doc_id % 6 <> 5), broken AS (
  SELECT doc_id, 'subject' AS rule FROM made UNION ALL SELECT doc_id, 'unknown_field' FROM made WHERE doc_id % 3 = 0
  UNION ALL SELECT doc_id, 'grade' FROM made WHERE doc_id % 15 > 12 OR doc_id % 15 = 0
  UNION ALL SELECT doc_id, 'wrong_type' FROM leaves WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 'concept_summary' FROM leaves WHERE blank
  UNION ALL SELECT doc_id, 'unknown_field' FROM leaves WHERE doc_id % 5 = 1 UNION ALL SELECT doc_id, 'hint_text' FROM leaves
  UNION ALL SELECT doc_id, 'question_fields' FROM leaves WHERE doc_id % 7 = 0 UNION ALL SELECT doc_id, 'subtopic_content' FROM made WHERE doc_id % 6 = 5)
SELECT doc_id, rule, count(*) AS n FROM broken GROUP BY ALL""",
)
def strict_schema(spark, folder):
    """Curricula five to eight subtopics deep around each document's text, with fields and types that the schema does not know."""
    n, quoted = F.col("doc_id"), F.to_json(F.struct(F.col("text").alias("summary")))
    part = lambda condition, text: F.when(condition, F.lit(text)).otherwise(F.lit(""))
    leaf = F.concat(
        F.lit('{"name": "leaf"'), part(n % 6 != 5, ', "concepts": ['),
        F.when(n % 6 != 5, F.concat(F.regexp_replace(quoted, r"\}$", ""), F.lit(', "name": "C", "steps": '), F.when(n % 2 == 0, "7").otherwise('["a"]'),
               part(n % 5 == 1, ', "colour": {"deep": [1]}'), F.lit(', "questions": [{"question": "q"'), part(n % 7 != 0, ', "acceptable_answers": ["a"]'),
               F.lit(', "hints": ["", "h"]}]}]'))).otherwise(F.lit("")), F.lit("}"),
    )
    depth = (n % 4 + 5).cast("int")
    nest = F.concat(F.repeat(F.lit('{"name": "s", "subtopics": ['), depth), leaf, F.repeat(F.lit("]}"), depth))
    value = F.concat(F.lit('{"subject": "none", "grade": '), (n % 15).cast("string"), part(n % 3 == 0, ', "author": "x"'), F.lit(', "topics": [{"name": "T", "subtopics": ['), nest, F.lit("]}]}"))
    files = views.table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", value.alias("value"))
    return content_check.violations(files).groupBy("doc_id", "rule").agg(F.count(F.lit(1)).alias("n"))


_BOOK = r"""WITH book AS (SELECT item_id, array_to_string(w[1:3], ' ') AS concept, text AS summary, string_split(text, '. ') AS steps
  FROM (SELECT *, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM benchmark)),
asked AS (SELECT concat('q', conv_id, '-', turn) AS query_id, lower(text) AS query FROM conversations WHERE role = 'user'
  UNION ALL SELECT concat('i', item_id, '-', n - 1), lower(steps[n]) FROM (SELECT *, unnest(range(1, len(steps) + 1)) AS n FROM book))"""


def _book(spark, folder):
    w = words(F.col("text"))
    return views.table(spark, folder, "benchmark").select(
        F.lit("book").alias("subject"), F.lit("items").alias("topic"), F.array(F.col("item_id").cast("int")).alias("ord"),
        F.array_join(F.slice(w, 1, 3), " ").alias("concept"), F.col("text").alias("summary"),
        F.split("text", r"\. ").alias("steps"), F.lit(None).cast(f"array<{source.QUESTION}>").alias("questions"),
    )


def _asked(spark, folder):
    """Every whole question, and every sentence of every item."""
    turns = views.questions(spark, folder).select(F.concat(F.lit("q"), "conv_id", F.lit("-"), "turn").alias("query_id"), F.col("question").alias("query"))
    items = views.table(spark, folder, "benchmark").select("item_id", F.posexplode(F.split("text", r"\. ")).alias("n", "query"))
    return turns.unionByName(items.select(F.concat(F.lit("i"), "item_id", F.lit("-"), "n").alias("query_id"), "query"))


@query(
    "j5_t6_word_search",
    _BOOK + r"""
SELECT query_id, place, concept FROM (
  SELECT query_id, concept, CAST(row_number() OVER (PARTITION BY query_id ORDER BY item_id) AS INTEGER) AS place
  FROM (SELECT *, list_filter(regexp_split_to_array(query, '\s+'), lambda x: x <> '') AS qs FROM asked), book
  WHERE len(qs) > 0 AND len(list_filter(list_concat([lower(concept), lower(summary)], list_transform(steps, lambda s: lower(s))), lambda t:
        len(list_filter(qs, lambda q: NOT contains(t, q))) = 0)) > 0) WHERE place <= 3""",
)
def word_search(spark, folder):
    """Whole questions and items by containment alone."""
    out = curriculum.search(_book(spark, folder), _asked(spark, folder), ratio=None)
    return out.select("query_id", "place", "concept")


@query("j5_t6_fuzzy_search")
def fuzzy_search(spark, folder):
    """Every whole item and question, their letters e lost, against names, summaries and steps."""
    asked = _asked(spark, folder).unionByName(
        views.table(spark, folder, "benchmark").select(F.concat(F.lit("w"), "item_id").alias("query_id"), F.col("text").alias("query"))
    )
    damaged = asked.withColumn("query", F.replace("query", F.lit("e"), F.lit("")))
    return curriculum.search(_book(spark, folder), damaged).select("query_id", "place", "concept")


@query("t7_f35_relevant_sentence")
def relevant(spark, folder):
    return curriculum.relevant_sentence(
        views.answers(spark, folder), ["conv_id", "turn"], "answer", "question"
    ).withColumn("ratio", F.round("ratio", 6))


@query(
    "k10_w6_versions",
    """
SELECT user_id, strftime(max(ts), '%Y%m%d_%H%M%S') AS version, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id""",
)
def versions(spark, folder):
    """Each event is a new version of its user's content, appended in two writes."""
    path = shared_folder(spark, "versions")
    rows = views.table(spark, folder, "events").select("user_id", F.col("ts").alias("version_ts"), "event_id", "value")
    small = F.col("value") < 20
    for part in (rows.where(small), rows.where(~small)):
        tables.append_version(part, path)
    current = tables.latest(tables.read_table(spark, path), ["user_id"], ["version_ts", "event_id"])
    return curriculum.with_content_version(current).select("user_id", "version", "value")


@query(
    "k11_suggestions",
    "SELECT event_type AS subject, user_id, count(*) AS suggestions FROM events GROUP BY ALL",
)
def suggestions(spark, folder):
    path = shared_folder(spark, "suggestions")
    rows = views.table(spark, folder, "events").select(F.col("event_type").alias("subject"), "user_id", "ts", "props")
    tables.append_version(rows, path, within=["subject"])
    return tables.read_table(spark, path).groupBy("subject", "user_id").agg(F.count(F.lit(1)).alias("suggestions"))


_EDITS = """
rows0 AS (SELECT subject, topic, topic AS subtopic, concept, question FROM catalogue),
edits AS (
  SELECT 'rt' || r_regionkey AS edit_id, 'remove' AS action, 'topic' AS level, CASE r_regionkey WHEN 0 THEN 'view' ELSE r_name END AS subject, 't1' AS topic,
         'x' AS subtopic, 'x' AS concept, 'x' AS question, '' AS payload FROM region
  UNION ALL SELECT 'rq' || n_nationkey, 'remove', 'question', 'click', 't0', 't0', concat('c', n_nationkey % 7), concat('q', n_nationkey % 10), '' FROM nation
  UNION ALL SELECT 'aq' || n_nationkey, 'add', 'question', 'error', 't1', 't1', concat('c', n_nationkey % 7), n_name, repeat('x', CAST(n_nationkey * 5000 AS INTEGER)) FROM nation)"""


def _edit_sets(spark, folder):
    lit = F.lit
    region, nation = (views.table(spark, folder, t) for t in ("region", "nation"))
    key = F.col("n_nationkey")
    concept = F.concat(lit("c"), (key % 7).cast("string"))
    topics = region.select(
        F.concat(lit("rt"), F.col("r_regionkey").cast("string")).alias("edit_id"), lit("remove").alias("action"), lit("topic").alias("level"),
        F.when(F.col("r_regionkey") == 0, "view").otherwise(F.col("r_name")).alias("subject"), lit("t1").alias("topic"),
        lit("x").alias("subtopic"), lit("x").alias("concept"), lit("x").alias("question"), lit("").alias("payload"),
    )
    gone = nation.select(
        F.concat(lit("rq"), key.cast("string")), lit("remove"), lit("question"), lit("click"), lit("t0"), lit("t0"), concept,
        F.concat(lit("q"), (key % 10).cast("string")), lit(""),
    )
    new = nation.select(
        F.concat(lit("aq"), key.cast("string")), lit("add"), lit("question"), lit("error"), lit("t1"), lit("t1"), concept,
        "n_name", F.repeat(lit("x"), (key * 5000).cast("int")),
    )
    rows = views.catalogue(spark, folder).withColumn("subtopic", F.col("topic"))
    return rows, topics.union(gone).union(new)


_KEPT = """
kept AS (SELECT * FROM rows0 r WHERE NOT EXISTS (FROM edits e WHERE e.action = 'remove' AND e.level = 'topic' AND e.subject = r.subject AND e.topic = r.topic)
  AND NOT EXISTS (FROM edits e WHERE e.action = 'remove' AND e.level = 'question' AND e.subject = r.subject AND e.topic = r.topic
                  AND e.subtopic = r.subtopic AND e.concept = r.concept AND e.question = r.question)),
added AS (SELECT *, length(payload) < 100000 AND EXISTS (FROM kept k WHERE k.subject = e.subject AND k.topic = e.topic AND k.subtopic = e.subtopic
          AND k.concept = e.concept) AS ok FROM edits e WHERE action = 'add')"""


@query(
    "k13_edited_rows",
    with_views("catalogue") + f",{_EDITS},{_KEPT} FROM kept UNION ALL SELECT subject, topic, subtopic, concept, question FROM added WHERE ok",
)
def edited_rows(spark, folder):
    return curriculum.apply_edits(*_edit_sets(spark, folder))[0]


@query(
    "k13_edit_effects",
    with_views("catalogue") + f""",{_EDITS},{_KEPT}
SELECT edit_id, rows, rows > 0 AS changed FROM (
  SELECT edit_id, (SELECT count(*) FROM rows0 r WHERE r.subject = e.subject AND r.topic = e.topic AND (e.level = 'topic' OR
     (r.subtopic = e.subtopic AND r.concept = e.concept AND r.question = e.question))) AS rows FROM edits e WHERE action = 'remove'
  UNION ALL SELECT edit_id, CAST(ok AS BIGINT) FROM added)""",
)
def edit_effects(spark, folder):
    return curriculum.apply_edits(*_edit_sets(spark, folder))[1]
