"""Progress and class analytics over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern import views
from lectern.operators import progress
from lectern.plans.registry import query
from lectern.views import with_views

_COUNTS = """
counts AS (SELECT user_id, subject, topic, concept, question, count(*) AS attempts,
                  count(*) FILTER (WHERE correct) AS correct FROM attempts GROUP BY ALL)"""
_WITH = with_views("attempts", "catalogue") + "," + _COUNTS
_REPORT = """
report AS (
  SELECT u.user_id, (SELECT count(*) FROM catalogue) AS total_questions,
         CAST(sum(coalesce(c.attempts, 0)) AS BIGINT) AS total_attempts, CAST(sum(coalesce(c.correct, 0)) AS BIGINT) AS total_correct,
         count(*) FILTER (WHERE c.correct >= 3) AS mastered_questions,
         count(*) FILTER (WHERE c.attempts >= 2 AND c.correct = 0) AS weak_questions
  FROM (SELECT DISTINCT user_id FROM attempts) u CROSS JOIN catalogue g
  LEFT JOIN counts c ON c.user_id = u.user_id AND c.subject = g.subject AND c.topic = g.topic
       AND c.concept = g.concept AND c.question = g.question
  GROUP BY u.user_id)"""


def _counts(spark, folder):
    return progress.attempt_counts(views.attempts(spark, folder))


@query("a1_attempt_counts", _WITH + "SELECT * FROM counts")
def attempt_counts(spark, folder):
    return _counts(spark, folder)


@query(
    "j1_catalogue_progress",
    _WITH + """
SELECT g.subject, g.topic, g.concept, g.question, c.user_id, coalesce(c.attempts, 0) AS attempts, coalesce(c.correct, 0) AS correct
FROM (FROM catalogue UNION SELECT r_name, 't0', 'c0', 'q0' FROM region) g LEFT JOIN counts c USING (subject, topic, concept, question)""",
)
def catalogue_progress(spark, folder):
    """Region names serve as subjects nobody has tried: they come out as 0/0."""
    untried = views.table(spark, folder, "region").select("r_name", F.lit("t0"), F.lit("c0"), F.lit("q0"))
    return progress.catalogue_progress(_counts(spark, folder), views.catalogue(spark, folder).union(untried))


@query(
    "j13_weak_questions",
    _WITH + "SELECT user_id, subject, topic, concept, question, attempts FROM counts WHERE attempts >= 2 AND correct = 0",
)
def weak_questions(spark, folder):
    return progress.weak_questions(_counts(spark, folder), views.catalogue(spark, folder))


@query("a2_student_report", _WITH + f",{_REPORT} SELECT * FROM report")
def student_report(spark, folder):
    return progress.student_report(_counts(spark, folder), views.catalogue(spark, folder))


@query(
    "a3_class_report",
    _WITH + f""",{_REPORT}
SELECT user_id % 7 AS class, count(*) AS total_students, round(avg(mastered_questions), 6) AS average_mastered_questions,
       round(avg(total_correct), 6) AS average_total_correct FROM report GROUP BY 1""",
)
def class_report(spark, folder):
    reports = student_report(spark, folder).withColumn("class", F.col("user_id") % 7)
    out = progress.class_report(reports, ["class"])
    rounded = {c: F.round(c, 6) for c in ("average_mastered_questions", "average_total_correct")}
    return out.withColumns(rounded)


@query(
    "a4_class_weak_concepts",
    _WITH + """
SELECT subject, topic, concept, count(*) AS questions, count(DISTINCT user_id) AS students FROM counts
WHERE attempts >= 2 AND correct = 0 GROUP BY ALL
HAVING count(*) >= greatest(1, floor(0.15 * (SELECT count(DISTINCT user_id) FROM attempts)))""",
)
def class_weak_concepts(spark, folder):
    attempts = views.attempts(spark, folder)
    return progress.class_weak_concepts(weak_questions(spark, folder), attempts, share=0.15)


@query(
    "a5_learner_summary",
    _WITH + """
SELECT user_id, count(*) AS total_questions, CAST(sum(attempts) AS BIGINT) AS total_attempts, CAST(sum(correct) AS BIGINT) AS total_correct,
       count(DISTINCT concat(subject, '/', topic, '/', concept)) FILTER (WHERE correct >= 3) AS mastered_concepts,
       count(*) FILTER (WHERE attempts >= 2 AND correct = 0) AS weak_questions
FROM counts GROUP BY user_id""",
)
def learner_summary(spark, folder):
    return progress.learner_summary(_counts(spark, folder))


@query(
    "a5_subject_summary",
    _WITH + """
SELECT user_id, subject, count(*) AS total, CAST(sum(correct) AS BIGINT) AS correct,
       count(*) FILTER (WHERE correct >= 3) AS mastered FROM counts GROUP BY ALL""",
)
def subject_summary(spark, folder):
    return progress.subject_summary(_counts(spark, folder))


_LEVELS = """
levels AS (
  SELECT user_id, subject, topic, concept, level, attempts, correct, score,
         CASE WHEN level = 'concept' AND attempts >= 5 THEN CASE WHEN score >= 80 THEN 'mastered' WHEN score < 50 THEN 'weak' END END AS band
  FROM (SELECT user_id, subject, topic, concept,
               CASE WHEN grouping(concept) = 0 THEN 'concept' WHEN grouping(subject) = 0 THEN 'subject' ELSE 'user' END AS level,
               CAST(sum(attempts) AS BIGINT) AS attempts, CAST(sum(correct) AS BIGINT) AS correct, sum(correct) / sum(attempts) * 100 AS score
        FROM counts GROUP BY GROUPING SETS ((user_id), (user_id, subject), (user_id, subject, topic, concept))))"""


@query(
    "a6_accuracy_mastery",
    _WITH + f",{_LEVELS} SELECT * REPLACE (round(score, 6) AS score) FROM levels",
)
def accuracy_mastery(spark, folder):
    return progress.accuracy_mastery(_counts(spark, folder)).withColumn("score", F.round("score", 6))


@query(
    "a6_advice",
    _WITH + f""",{_LEVELS}
SELECT user_id, CASE WHEN w IS NOT NULL THEN concat('Try reviewing: ', w) WHEN m THEN 'Great work! Try exploring a new subject.'
       ELSE 'Start by browsing subjects to begin your journey!' END AS advice
FROM (SELECT user_id, arg_min(concat(concept, ' (', topic, ')'), concat(subject, '/', topic, '/', concept)) FILTER (WHERE band = 'weak') AS w,
             coalesce(bool_or(band = 'mastered'), false) AS m FROM levels GROUP BY user_id)""",
)
def advice(spark, folder):
    return progress.advice(progress.accuracy_mastery(_counts(spark, folder)))


@query(
    "a7_concept_mastery",
    _WITH + """
SELECT user_id, subject, topic, concept, count(*) AS questions, count(*) FILTER (WHERE correct > 0) AS answered_right,
       CAST(floor(100 * count(*) FILTER (WHERE correct > 0) / count(*)) AS BIGINT) AS mastery FROM counts GROUP BY ALL""",
)
def concept_mastery(spark, folder):
    return progress.concept_mastery(_counts(spark, folder))


# Few learners master a whole concept here, so the threshold counts three right
# answers over questions merged to one per concept.
_MERGED = """
merged AS (SELECT user_id, subject, 't' AS topic, concept, concept AS question, count(*) AS attempts,
                  count(*) FILTER (WHERE correct) AS correct FROM attempts GROUP BY ALL),
items AS (SELECT DISTINCT subject, 't' AS topic, concept, question FROM merged)"""


def _merged(spark, folder):
    merged = views.attempts(spark, folder).withColumns({"topic": F.lit("t"), "question": F.col("concept")})
    counts = progress.attempt_counts(merged)
    return counts, counts.select("subject", "topic", "concept", "question").distinct()


@query(
    "j9_next_concept",
    with_views("attempts") + f""",{_MERGED}
SELECT user_id, split_part(c, '/', 1) AS subject, split_part(c, '/', 2) AS topic, split_part(c, '/', 3) AS concept FROM (
  SELECT u.user_id, min(concat(i.subject, '/', i.topic, '/', i.concept)) AS c
  FROM (SELECT DISTINCT user_id FROM merged) u CROSS JOIN items i
  LEFT JOIN merged m ON m.user_id = u.user_id AND m.subject = i.subject AND m.concept = i.concept
  WHERE coalesce(m.correct, 0) < 3 GROUP BY u.user_id)""",
)
def next_concept(spark, folder):
    return progress.next_concept(*_merged(spark, folder))


@query(
    "j9_next_tried_concept",
    with_views("attempts") + f""",{_MERGED}
SELECT user_id, split_part(c, '/', 1) AS subject, split_part(c, '/', 2) AS topic, split_part(c, '/', 3) AS concept FROM (
  SELECT user_id, min(concat(subject, '/', topic, '/', concept)) AS c FROM merged WHERE correct < 3 GROUP BY user_id)""",
)
def next_tried_concept(spark, folder):
    return progress.next_tried_concept(_merged(spark, folder)[0])
