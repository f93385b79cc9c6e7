"""Phrase mining over question logs built from the conversations table."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern import lexicon, views
from lectern.functions import gates
from lectern.operators import mining
from lectern.operators.layout import written
from lectern.plans.questions import _sql_any, _sql_match, sql_words
from lectern.plans.registry import query
from lectern.views import with_views

SEQ = ["conv_id", "turn"]

_LOW = with_views("messy") + f"""
, logs AS (SELECT conv_id, turn, question AS original, CASE WHEN conv_id % 11 = 0 THEN NULL ELSE (conv_id * 3 + turn) % 10 / 10.0 END AS confidence
         FROM messy),
low AS (SELECT *, lower(original) AS text FROM logs WHERE coalesce(confidence, 1.0) < 0.7),
tokens AS (SELECT {sql_words('text')} AS w FROM low),
sized AS (SELECT w, unnest([2, 3, 4]) AS n FROM tokens),
placed AS (SELECT w, n, unnest(range(1, len(w) - n + 2)) AS i FROM sized),
grams AS (SELECT array_to_string(w[i:i + n - 1], ' ') AS phrase FROM placed),
counts AS (SELECT phrase, count(*) AS frequency FROM grams WHERE length(phrase) > 5 GROUP BY phrase),
top AS (SELECT * FROM counts ORDER BY frequency DESC, phrase LIMIT 100)"""

_NOISE = f"({_sql_any('lower(phrase)', lexicon.NOISE_INDICATORS)} OR {_sql_match('lower(phrase)', lexicon.NOISE_PATTERNS)})"

_MINED = _LOW + f""",
noise AS (SELECT * FROM top WHERE frequency >= 3 AND {_NOISE}),
started AS (SELECT phrase, frequency, (SELECT count(*) FROM low WHERE starts_with(low.text, noise.phrase)) AS starts FROM noise),
mined AS (
  SELECT * FROM (SELECT phrase, frequency, CAST(round(least(1.0, 0.5 + CASE WHEN frequency > 50 THEN 0.2 WHEN frequency > 20 THEN 0.1 ELSE 0 END
      + CASE WHEN starts > frequency * 0.7 THEN 0.15 ELSE 0 END
      + CASE WHEN {_sql_any('phrase', lexicon.NOISE_INDICATORS)} THEN 0.15 ELSE 0 END), 2) AS DOUBLE) AS confidence FROM started)
  WHERE confidence >= 0.6),
examples AS (
  SELECT phrase, CAST(row_number() OVER (PARTITION BY phrase ORDER BY conv_id, turn) AS INTEGER) AS example, original
  FROM mined JOIN low ON contains(low.text, phrase) QUALIFY example <= 3)"""


def _logs(spark, folder):
    n = F.col("conv_id")
    confidence = F.when(n % 11 != 0, (n * 3 + F.col("turn")) % 10 / 10.0)
    return views.messy_questions(spark, folder).select(
        *SEQ, F.col("question").alias("original"), confidence.alias("confidence")
    )


@query("p11_low_confidence", _LOW + "SELECT conv_id, turn FROM low")
def low_confidence(spark, folder):
    return mining.low_confidence_logs(_logs(spark, folder)).select(*SEQ)


@query("a8_ngram_counts", _LOW + "SELECT * FROM counts")
def ngram_counts(spark, folder):
    return mining.ngram_counts(mining.low_confidence_logs(_logs(spark, folder)))


@query("t4_top_ngrams", _LOW + "SELECT * FROM top")
def top_ngrams(spark, folder):
    return mining.top_ngrams(ngram_counts(spark, folder))


@query("p16_noise_phrases", _LOW + f"SELECT phrase, frequency FROM counts WHERE {_NOISE}")
def noise_phrases(spark, folder):
    return ngram_counts(spark, folder).where(gates.is_noise_phrase(F.col("phrase")))


def _mined(spark, folder):
    return mining.mine_phrases(_logs(spark, folder), min_frequency=3)


@query("a9_t5_suggestions", _MINED + "SELECT * FROM mined")
def suggestions(spark, folder):
    return _mined(spark, folder).orderBy(F.desc(F.col("confidence") * F.col("frequency")), "phrase")


@query("t8_examples", _MINED + "SELECT phrase, example, original FROM examples")
def examples(spark, folder):
    return mining.phrase_examples(_logs(spark, folder), _mined(spark, folder), SEQ)


@query(
    "k9_pattern_report",
    _MINED + """
SELECT rank, phrase, concat('## ', rank, '. "', phrase, '"', chr(10), chr(10), '- **Frequency**: ', frequency, chr(10),
       '- **Confidence**: ', printf('%.2f', confidence), chr(10), '- **Examples**:', chr(10), ex) AS block
FROM (SELECT *, CAST(row_number() OVER (ORDER BY confidence * frequency DESC, phrase) AS INTEGER) AS rank FROM mined)
JOIN (SELECT phrase, string_agg(concat('  - "', original, '"'), chr(10) ORDER BY example) AS ex FROM examples GROUP BY phrase) USING (phrase)""",
)
def report(spark, folder):
    found = written(_mined(spark, folder), "mined")
    return mining.report_lines(found, mining.phrase_examples(_logs(spark, folder), found, SEQ))
