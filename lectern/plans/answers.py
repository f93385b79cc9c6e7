"""Answer quality over question and answer turns of the conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern import lexicon, views
from lectern.functions import answers
from lectern.operators import grading, retrieval
from lectern.plans.questions import EDGE, _sql_any, sql_words
from lectern.plans.registry import query
from lectern.plans.retrieval import BUDGET, _FITTED
from lectern.views import with_views

_LONG = f"list_distinct(list_filter(regexp_split_to_array(lower(said), '{EDGE}+'), lambda w: length(w) >= 5))"
_SAID = """told AS (SELECT conv_id, turn, question, CASE (conv_id + turn) % 4 WHEN 0 THEN concat(question, ' ', answer)
  WHEN 1 THEN concat(answer, ' I couldn''t find more') WHEN 2 THEN answer ELSE question END AS said,
  CASE WHEN (conv_id + turn) % 4 = 1 THEN [question, answer] WHEN turn = 0 THEN [question] ELSE [question, question] END AS context FROM answers)"""


def _told(spark, folder):
    kind = (F.col("conv_id") + F.col("turn")) % 4
    said = (
        F.when(kind == 0, F.concat("question", F.lit(" "), "answer")).when(kind == 1, F.concat("answer", F.lit(" I couldn't find more")))
        .when(kind == 2, F.col("answer")).otherwise(F.col("question"))
    )
    context = (
        F.when(kind == 1, F.array("question", "answer")).when(F.col("turn") == 0, F.array("question"))
        .otherwise(F.array("question", "question"))
    )
    return views.answers(spark, folder).select("conv_id", "turn", "question", said.alias("said"), context.alias("context"))


@query(
    "p18_grounding",
    with_views("answers") + f""", {_SAID},
terms AS (SELECT *, {_LONG} AS t, lower(array_to_string(context, ' ')) AS ctx, len({sql_words('said')}) AS n FROM told),
shares AS (SELECT *, len(list_filter(t, lambda w: contains(ctx, w))) / len(t) AS share FROM terms)
SELECT conv_id, turn, n < 5 OR len(t) = 0 OR (share >= 0.3 AND NOT {_sql_any('lower(said)', lexicon.FORBIDDEN_PHRASES)}) AS grounded,
  CASE WHEN n < 5 THEN 'Answer too short to validate' WHEN len(t) = 0 THEN 'No key terms to validate'
       WHEN share < 0.3 THEN concat('Low context overlap (', CAST(round_even(share * 100, 0) AS INTEGER), '%)')
       WHEN {_sql_any('lower(said)', lexicon.FORBIDDEN_PHRASES)} THEN 'Model admitted lack of knowledge' ELSE 'Grounded' END AS reason
FROM shares""",
)
def grounding(spark, folder):
    told = _told(spark, folder)
    return told.select("conv_id", "turn", answers.grounding(F.col("said"), F.col("context")).alias("g")).select("conv_id", "turn", "g.*")


@query(
    "p19_context_relevance",
    with_views("answers") + f"""
SELECT conv_id, turn, length(trim(answer)) >= 20 AND (len(f) >= 2 OR len(list_filter(f, lambda w: length(w) > 5)) > 0) AS relevant FROM (
  SELECT *, list_filter(list_distinct(list_filter({sql_words('lower(question)')}, lambda w: length(w) > 3)), lambda w: contains(lower(answer), w)) AS f FROM answers)""",
)
def relevance(spark, folder):
    return views.answers(spark, folder).select(
        "conv_id", "turn", answers.context_relevant(F.col("question"), F.col("answer")).alias("relevant")
    )


_OVERLAP = f"""
overlap AS (SELECT *, len(list_intersect(qw, list_distinct(list_transform({sql_words('said')}, lambda w: lower(w))))) AS common FROM (
  SELECT *, len({sql_words('said')}) AS n, list_distinct(list_transform(list_filter({sql_words('question')}, lambda w: length(w) > 3), lambda w: lower(w))) AS qw FROM told))"""


@query(
    "f29_f30_confidence",
    with_views("answers") + f""", {_SAID}, {_OVERLAP}
SELECT conv_id, turn, CAST(round(CASE WHEN n < 5 THEN 0.3 ELSE least(1.0, 0.5 + CASE WHEN n BETWEEN 50 AND 150 THEN 0.2
    WHEN n BETWEEN 30 AND 49 OR n BETWEEN 151 AND 200 THEN 0.1 ELSE 0 END + CASE WHEN len(qw) > 0 THEN common / len(qw) * 0.2 ELSE 0 END
    + coalesce(ms * 0.1, 0)) END, 6) AS DOUBLE) AS confidence,
  CAST(round(CASE WHEN n < 5 THEN 0.3 ELSE least(1.0, 0.5 + common / greatest(1, len(qw)) * 0.5) END, 6) AS DOUBLE) AS model_confidence
FROM (SELECT *, CASE WHEN turn > 0 THEN (conv_id % 10) / 10.0 END AS ms FROM overlap)""",
)
def confidence(spark, folder):
    mean = F.when(F.col("turn") > 0, F.col("conv_id") % 10 / 10.0)
    return _told(spark, folder).select(
        "conv_id", "turn",
        F.round(answers.answer_confidence(F.col("said"), F.col("question"), mean), 6).alias("confidence"),
        F.round(answers.model_confidence(F.col("said"), F.col("question")), 6).alias("model_confidence"),
    )


@query(
    "a10_mean_context_score",
    with_views("store", "query_vectors") + f", {_FITTED} SELECT query_id, round(avg(final_score), 6) AS mean_score, count(*) AS chunks FROM fitted GROUP BY query_id",
)
def mean_score(spark, folder):
    used = retrieval.retrieve_context(views.query_vectors(spark, folder), views.vector_store(spark, folder), budget=BUDGET)
    return used.groupBy("query_id").agg(
        F.round(F.avg("final_score"), 6).alias("mean_score"), F.count(F.lit(1)).alias("chunks")
    )


@query(
    "t9_joined_context",
    with_views("store", "query_vectors") + f""", {_FITTED},
ordered AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY source_type <> 'NEB', place) AS p FROM fitted)
SELECT query_id, left(string_agg(text, concat(chr(10), chr(10)) ORDER BY p) FILTER (WHERE p <= 2), 600) AS context FROM ordered GROUP BY query_id""",
)
def joined_context(spark, folder):
    used = retrieval.retrieve_context(views.query_vectors(spark, folder), views.vector_store(spark, folder), budget=BUDGET)
    # A query keeps at most two hits of each of its few collections.
    texts = F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda s: s["text"])
    return used.groupBy("query_id").agg(answers.joined_context(texts).alias("context"))


@query(
    "f31_clean_answer",
    with_views("answers") + r"""
, raw AS (SELECT conv_id, turn, concat(CASE turn % 4 WHEN 0 THEN ' A: ' WHEN 2 THEN 'q:' ELSE '' END, answer, CASE conv_id % 4 WHEN 0 THEN concat(chr(10), 'Q: more')
          WHEN 1 THEN ' Try this: it' WHEN 2 THEN ' Exercise: do' ELSE '' END) AS t FROM answers),
s1 AS (SELECT *, regexp_replace(regexp_replace(trim(t, concat(' ', chr(9), chr(10), chr(13))), '^(Q:|A:)\s*', '', 'i'), '\n(Q:|A:)\s*', chr(10), 'gi') AS u FROM raw),
s2 AS (SELECT *, regexp_replace(trim(split_part(split_part(u, 'Exercise:', 1), 'Try this:', 1), concat(' ', chr(9), chr(10), chr(13))), '\s+', ' ', 'g') AS v FROM s1)
SELECT conv_id, turn, CASE WHEN v <> '' AND NOT regexp_matches(v, '[.!?]$') THEN concat(v, '.') ELSE v END AS clean FROM s2""",
)
def cleaned(spark, folder):
    t, n = F.col("turn"), F.col("conv_id")
    raw = F.concat(
        F.when(t % 4 == 0, " A: ").when(t % 4 == 2, "q:").otherwise(""), "answer",
        F.when(n % 4 == 0, "\nQ: more").when(n % 4 == 1, " Try this: it").when(n % 4 == 2, " Exercise: do").otherwise(""),
    )
    return views.answers(spark, folder).select("conv_id", "turn", answers.clean_answer(raw).alias("clean"))


_HEAD = lexicon.ANSWER_INSTRUCTION.format(name=lexicon.ASSISTANT_NAME).replace("'", "''")


@query(
    "f32_prompt",
    f"""
SELECT doc_id, CASE WHEN c <> '' THEN concat('{_HEAD}', chr(10), 'Reference material:', chr(10),
    CASE WHEN length(c) > 850 THEN concat(regexp_replace(left(c, 850), '(?s)\\.[^.]*$', ''), '.') ELSE c END,
    chr(10), chr(10), 'Question: ', source, chr(10), 'Answer:') ELSE concat('{_HEAD}', chr(10), 'Question: ', source, chr(10), 'Answer:') END AS prompt
FROM (SELECT *, CASE WHEN lang = 'es' THEN '' ELSE trim(text, concat(' ', chr(9), chr(10), chr(13))) END AS c FROM documents)""",
)
def prompt(spark, folder):
    context = F.when(F.col("lang") != "es", F.col("text"))
    return views.table(spark, folder, "documents").select("doc_id", answers.build_prompt(F.col("source"), context).alias("prompt"))


@query(
    "f33_verdict",
    with_views("answers") + """
SELECT conv_id, turn, CASE turn % 8 WHEN 0 THEN true WHEN 2 THEN false ELSE conv_id % 2 = 0 END AS correct, trim(answer) AS explanation FROM answers""",
)
def verdict(spark, folder):
    t, a = F.col("turn"), F.trim("answer")
    reply = (
        F.when(t % 8 == 0, F.concat(F.lit("[CORRECT] Feedback:  "), a)).when(t % 8 == 2, F.concat(F.lit("Verdict: [incorrect] feedback: "), a))
        .when(t % 8 == 4, F.concat(F.lit("Verdict:[unsure]"), a)).otherwise(a)
    )
    given = F.when(F.col("conv_id") % 2 == 0, F.upper(F.lit("key"))).otherwise("other")
    out = answers.parse_verdict(reply, given, F.lit("Key"))
    return views.answers(spark, folder).select("conv_id", "turn", out.alias("v")).select("conv_id", "turn", "v.*")


@query("j14_grading")
def graded(spark, folder):
    """Every answer, damaged in some rows, against the answers given to its conversation."""
    kind = F.col("turn") % 6
    said = (
        F.when(kind == 0, F.upper("answer")).when(kind == 2, F.regexp_replace("answer", "[aeiou]", ""))
        .otherwise(F.regexp_replace("answer", " ", "  "))
    )
    rows = views.answers(spark, folder)
    attempts = rows.select("conv_id", "turn", "question", said.alias("answer"))
    key = rows.select("question", F.array("answer").alias("acceptable_answers"))
    return grading.grade(attempts, key).select("conv_id", "turn", "correct")


@query(
    "j14_exact_grading",
    with_views("attempts") + """
, key AS (SELECT DISTINCT subject, topic, concept FROM attempts WHERE correct)
SELECT event_id, EXISTS (FROM key k WHERE k.subject = a.subject AND k.concept = a.concept AND k.topic = a.topic) AS correct FROM attempts a""",
)
def exact_grading(spark, folder):
    """Answers are topic names, too short to be similar without being equal."""
    rows = views.attempts(spark, folder).withColumn("item", F.concat_ws("/", "subject", "concept"))
    attempts = rows.select("event_id", F.col("item").alias("question"), F.upper("topic").alias("answer"))
    key = rows.where("correct").groupBy(F.col("item").alias("question")).agg(F.collect_set("topic").alias("acceptable_answers"))
    return grading.grade(attempts, key).select("event_id", "correct")
