"""Question normalisation and gates over the conversations table."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern import lexicon, views
from lectern.functions import gates, normalise
from lectern.operators import asking, ingest, layout, questions
from lectern.plans.registry import query
from lectern.views import with_views

EDGE = r"[^\p{L}\p{N}_]"


def _sql_word(expr: str, word: str, to: str, flags: str = "gi") -> str:
    """Whole-word replacement; twice, as neighbours share an edge."""
    once = lambda e: f"regexp_replace({e}, '(^|{EDGE}){word}($|{EDGE})', '\\1{to}\\2', '{flags}')"
    return once(once(expr))


def _sql_any(expr: str, needles: list[str]) -> str:
    return "(" + " OR ".join("contains({}, '{}')".format(expr, n.replace("'", "''")) for n in needles) + ")"


def _sql_match(expr: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(f"regexp_matches({expr}, '{p}', 'i')" for p in patterns) + ")"


def sql_words(expr: str) -> str:
    return f"list_filter(regexp_split_to_array({expr}, '\\s+'), lambda w: w <> '')"


def _sql_formal(expr: str) -> str:
    for word in lexicon.STARTERS:
        expr = f"regexp_replace({expr}, '^{word}\\s+', '', 'i')"
    for short, full in lexicon.SLANG:
        expr = _sql_word(expr, short, full)
    for word in lexicon.FILLERS:
        expr = _sql_word(expr, word, "")
    for pattern in lexicon.POLITENESS:
        expr = f"regexp_replace({expr}, '{pattern}', '', 'i')"
    return f"trim(regexp_replace({expr}, '\\s+', ' ', 'g'))"


def _sql_case(expr: str) -> str:
    upper = lambda e: f"replace(upper({e}), 'ẞ', 'SS')"
    return (
        f"concat({upper(f'left({expr}, 1)')}, CASE WHEN {upper(expr)} = {expr} AND lower({expr}) <> {expr} "
        f"THEN lower(substr({expr}, 2)) ELSE substr({expr}, 2) END)"
    )


def _chain() -> str:
    steps = [
        "n0 AS (SELECT *, trim(question) AS raw FROM messy WHERE length(question) >= 3)",
        f"n1 AS (SELECT *, {_sql_formal('raw')} AS q1 FROM n0)",
    ]
    notes = ["CASE WHEN q1 <> raw THEN 'formalized' END"]
    last = "q1"
    for i, pattern in enumerate(lexicon.EXAM_NOISE):
        steps.append(
            f"x{i} AS (SELECT *, regexp_replace({last}, '{pattern}', '', 'gi') AS e{i}, "
            f"regexp_matches({last}, '{pattern}', 'i') AS h{i} FROM {'n1' if i == 0 else f'x{i - 1}'})"
        )
        notes.append(f"CASE WHEN h{i} THEN 'removed_regex' END")
        last = f"e{i}"
    steps.append(
        f"n2 AS (SELECT *, regexp_replace(trim(regexp_replace({last}, '\\s+', ' ', 'g')), '^[,:;\\-\\s]+', '') AS q2 "
        f"FROM x{len(lexicon.EXAM_NOISE) - 1})"
    )
    prev, last = "n2", "q2"
    for i, (short, full) in enumerate(lexicon.ABBREVIATIONS):
        steps.append(
            f"a{i} AS (SELECT *, {_sql_word(last, short, full, 'g')} AS b{i}, "
            f"regexp_matches({last}, '(^|{EDGE}){short}($|{EDGE})') AS g{i} FROM {prev})"
        )
        notes.append(f"CASE WHEN g{i} THEN 'expanded_abbrev' END")
        prev, last = f"a{i}", f"b{i}"
    notes.append("CASE WHEN caps THEN 'fixed_caps' END")
    asks = " OR ".join(f"starts_with(lower(q3), '{w}')" for w in lexicon.QUESTION_WORDS)
    steps += [
        f"n3 AS (SELECT *, upper({last}) = {last} AND lower({last}) <> {last} AS caps, {_sql_case(last)} AS q3 FROM {prev})",
        f"n4 AS (SELECT *, regexp_replace(CASE WHEN ({asks}) AND NOT ends_with(q3, '?') "
        "THEN concat(regexp_replace(q3, '[.!,;:]+$', ''), '?') ELSE q3 END, '\\?+', '?', 'g') AS q4 FROM n3)",
    ]
    rules = " ".join(
        f"WHEN {_sql_any('lower(q4)', need)} AND NOT contains(lower(q4), '{ctx}') THEN '{ctx}'"
        for ctx, need in lexicon.CONTEXT_RULES
    )
    steps.append(
        f"n5 AS (SELECT *, CASE WHEN len({sql_words('q4')}) <= 15 AND regexp_matches(q4, 'what happens\\s+(when|if)', 'i') "
        f"THEN CASE {rules} END END AS ctx FROM n4)"
    )
    steps.append(
        "n6 AS (SELECT *, CASE WHEN ctx IS NULL THEN q4 ELSE regexp_replace(q4, '^(.*?what happens)(\\s+(?:when|if))', "
        "concat('\\1 in a ', ctx, '\\2'), 'is') END AS clean FROM n5)"
    )
    notes.append("CASE WHEN ctx IS NOT NULL THEN 'expanded_context' END")
    intents = " ".join(f"WHEN {_sql_match('lower(clean)', ps)} THEN '{name}'" for name, ps in lexicon.INTENTS)
    steps.append(
        f"n7 AS (SELECT *, list_filter([{', '.join(notes)}], lambda n: n IS NOT NULL) AS notes, "
        f"CASE {intents} ELSE 'DESCRIBE' END AS intent FROM n6)"
    )
    steps.append(
        "normal AS (SELECT conv_id, turn, clean AS clean_question, intent, array_to_string(notes, '|') AS notes, "
        "CAST(round(greatest(0.5, least(1.0, 1.0 - CASE WHEN length(clean) / length(question) < 0.5 THEN 0.2 ELSE 0 END "
        "- CASE WHEN len(notes) > 5 THEN 0.15 WHEN len(notes) > 3 THEN 0.1 ELSE 0 END)), 2) AS DOUBLE) AS confidence FROM n7 "
        "UNION ALL SELECT conv_id, turn, coalesce(question, ''), 'UNKNOWN', 'fallback: Invalid input', 0.0 "
        "FROM messy WHERE length(question) < 3 OR question IS NULL)"
    )
    return with_views("messy") + ",\n" + ",\n".join(steps) + "\n"


_scaffolds = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in lexicon.SCAFFOLDS.items())


@query(
    "f15_normalise",
    _chain() + f"""
SELECT *, CASE WHEN intent <> 'UNKNOWN' THEN concat(CASE intent {_scaffolds} ELSE '{lexicon.DEFAULT_SCAFFOLD}' END, ' ', clean_question)
          END AS scaffolded_prompt FROM normal""",
)
def normalised(spark, folder):
    """The whole chain. No question here resembles a fuzzy phrase, so the SQL needs no ratio."""
    out = normalise.normalise_questions(views.messy_questions(spark, folder), scaffolding=True)
    return out.drop("question").withColumn("notes", F.array_join("notes", "|"))


@query(
    "f1_f4_formalise",
    with_views("messy") + f"SELECT conv_id, turn, {_sql_formal('trim(question)')} AS formal FROM messy",
)
def formal(spark, folder):
    q = normalise.strip(F.col("question"))
    return views.messy_questions(spark, folder).select("conv_id", "turn", normalise.formalise(q).alias("formal"))


@query(
    "f11_intent_counts",
    _chain() + "SELECT intent, count(*) AS n FROM normal GROUP BY intent",
)
def intent_counts(spark, folder):
    """Of the whole chain."""
    out = normalise.normalise_questions(views.messy_questions(spark, folder))
    return out.groupBy("intent").agg(F.count(F.lit(1)).alias("n"))


# The chain on the questions as they are; with a misspelt phrase put in before, only the note of its removal differs.
_PLAIN = _chain().replace(with_views("messy"), with_views("questions") + ", messy AS (SELECT conv_id, turn, question FROM questions)")


@query(
    "f6_fuzzy_removal",
    _PLAIN + """
SELECT conv_id, turn, clean_question, concat_ws('|', CASE WHEN starts_with(notes, 'formalized') THEN 'formalized' END, 'removed_fuzzy',
       nullif(regexp_replace(notes, '^formalized[|]?', ''), '')) AS notes FROM normal""",
)
def fuzzy_removal(spark, folder):
    """Questions with a misspelt exam phrase put in come out as if it had not been there."""
    typo = F.when(F.col("turn") % 4 == 0, "acording to the pasage ").otherwise("explain im brief ")
    asked = views.questions(spark, folder).withColumn("question", F.concat(typo, "question"))
    out = normalise.normalise_questions(asked)
    return out.select("conv_id", "turn", "clean_question", F.array_join("notes", "|").alias("notes"))


@query(
    "d7_answer_records",
    _chain() + f"""
SELECT m.conv_id * 1000 + m.turn AS request_id, CASE WHEN trim(question) = '' OR length(trim(question)) < 4 THEN 'edge_case' ELSE 'rag_response' END AS source,
       n.intent, n.clean_question, 0.0::DOUBLE AS confidence FROM messy m JOIN normal n USING (conv_id, turn)""",
)
def answer_records(spark, folder):
    """Every question through the whole flow against the chunked corpus, without a model and with an empty cache."""
    chunks = ingest.encode_chunks(ingest.chunk_documents(views.corpus(spark, folder).select("doc_id", "collection", "text")))
    store = chunks.select((F.col("doc_id") * 100_000 + F.col("chunk_id")).alias("vec_id"), "collection", "text", "embedding")
    asked = views.messy_questions(spark, folder).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"), "question", F.lit("en").alias("subject"),
        (8 + F.col("conv_id") % 5).cast("string").alias("grade"), F.lit(0).cast("long").alias("us"),
    )
    fills = spark.createDataFrame([], "key string, us long, value string")
    entries = spark.createDataFrame([], "entry_id long, subject string, grade string, us long, embedding array<float>, value string")
    out = asking.ask(asked, layout.written(store, "store"), views.corpus(spark, folder).select("collection"), fills, entries)
    return out.select("request_id", "source", "intent", "clean_question", "confidence")


_PHRASES = """
phrases AS (SELECT DISTINCT trim(lower(concat(w[1], ' ', w[2]))) AS phrase FROM
  (SELECT list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM benchmark)
  WHERE len(w) >= 2 UNION SELECT DISTINCT lower(lang) FROM documents)"""


def _dictionary(spark, folder):
    """The first two words of every benchmark text, and the language codes."""
    w = normalise.words(F.col("text"))
    openings = views.table(spark, folder, "benchmark").where(F.size(w) >= 2).select(
        F.array_join(F.slice(w, 1, 2), " ").alias("phrase")
    )
    return questions.learned_dictionary(openings, views.table(spark, folder, "documents").select(F.col("lang").alias("phrase")))


@query(
    "j7_learned_phrases",
    with_views("questions") + f""",{_PHRASES},
listed AS (SELECT list(phrase ORDER BY length(phrase) DESC, phrase) AS ps FROM phrases)
SELECT conv_id, turn, list_reduce(ps, lambda acc, p: regexp_replace(acc, regexp_escape(p), '', 'gi'), question) AS question
FROM questions, listed""",
)
def learned(spark, folder):
    with_phrases = questions.attach_learned(views.questions(spark, folder), _dictionary(spark, folder))
    return with_phrases.select(
        "conv_id", "turn", normalise.remove_learned(F.col("question"), F.col("learned"))["text"].alias("question")
    )


@query("k12_learned_dictionary", f"WITH {_PHRASES} SELECT phrase FROM phrases")
def dictionary(spark, folder):
    return _dictionary(spark, folder)


_KEYS = """
SELECT conv_id, turn, md5(trim(lower(question))) AS spell_key,
       md5(concat(trim(lower(question)), '|', lower('Science'), '|', CAST(turn % 3 AS VARCHAR))) AS answer_key FROM questions"""


@query("f16_cache_keys", with_views("questions") + _KEYS)
def cache_keys(spark, folder):
    q = F.col("question")
    return views.questions(spark, folder).select(
        "conv_id", "turn", normalise.spell_key(q).alias("spell_key"),
        normalise.answer_key(q, F.lit("Science"), (F.col("turn") % 3).cast("string")).alias("answer_key"),
    )


_P8 = f"""
CASE WHEN n < 5 THEN false
     WHEN regexp_matches(question, '^[A-D]\\)') OR regexp_matches(question, '^\\d+\\.') THEN false
     WHEN upper(question) = question AND lower(question) <> question THEN false
     WHEN regexp_matches(question, '[0-9]') OR regexp_matches(question, '[\\p{{L}}\\p{{N}}_]{{15}}') OR
          len(list_filter(range(1, length(question) - 2), lambda i: question[i] = question[i+1] AND question[i] = question[i+2]
                          AND question[i] = question[i+3] AND question[i] <> chr(10))) > 0 THEN true
     ELSE n > 10 END"""


@query(
    "p8_spell_gate",
    with_views("messy") + f"SELECT conv_id, turn, {_P8} AS check FROM (SELECT *, len({sql_words('question')}) AS n FROM messy)",
)
def spell_gate(spark, folder):
    return views.messy_questions(spark, folder).select(
        "conv_id", "turn", gates.needs_spell_check(F.col("question")).alias("check")
    )


_FIXES = """
fixes AS (SELECT md5(trim(lower(question))) AS key, max(concat('fixed ', question)) AS corrected
          FROM messy WHERE turn = 0 GROUP BY 1)"""


@query(
    "j11_spell_lookup",
    with_views("messy") + f""",{_FIXES}
SELECT conv_id, turn, coalesce(f.corrected, question) AS corrected, f.corrected IS NOT NULL AS spell_hit
FROM messy LEFT JOIN fixes f ON f.key = md5(trim(lower(question)))""",
)
def spell_lookup(spark, folder):
    return _corrected(spark, folder).drop("question")


def _corrected(spark, folder):
    asked = views.messy_questions(spark, folder)
    fixes = asked.where(F.col("turn") == 0).select(
        normalise.spell_key(F.col("question")).alias("key"), F.concat(F.lit("fixed "), "question").alias("corrected")
    )
    return questions.correct_spelling(asked, fixes)


@query(
    "a19_spell_cache_counts",
    with_views("messy") + f""",{_FIXES}
SELECT count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE NOT hit AND gate) AS misses FROM (
  SELECT f.corrected IS NOT NULL AS hit, {_P8} AS gate
  FROM (SELECT *, len({sql_words('question')}) AS n FROM messy) LEFT JOIN fixes f ON f.key = md5(trim(lower(question))))""",
)
def spell_counts(spark, folder):
    return questions.spell_cache_counts(_corrected(spark, folder))


_TURNS = """
turns AS (SELECT conv_id, turn, CASE (conv_id + turn) % 9 WHEN 0 THEN '  ' WHEN 1 THEN 'Hi ' WHEN 2 THEN ' Good Morning'
          WHEN 3 THEN 'THANKS' WHEN 4 THEN 'my bad' WHEN 5 THEN concat('what is ', text) WHEN 6 THEN concat('solve ', text)
          WHEN 7 THEN 'what loop ' ELSE text END AS question FROM conversations)"""


def _turns(spark, folder):
    kind, text = (F.col("conv_id") + F.col("turn")) % 9, F.col("text")
    made = (
        F.when(kind == 0, "  ").when(kind == 1, "Hi ").when(kind == 2, " Good Morning").when(kind == 3, "THANKS")
        .when(kind == 4, "my bad").when(kind == 5, F.concat(F.lit("what is "), text))
        .when(kind == 6, F.concat(F.lit("solve "), text)).when(kind == 7, "what loop ").otherwise(text)
    )
    return views.table(spark, folder, "conversations").select("conv_id", "turn", made.alias("question"))


@query(
    "p3_p4_routing",
    f"""WITH {_TURNS}, said AS (SELECT *, lower(trim(question)) AS s FROM turns)
SELECT conv_id, turn, CASE WHEN s = '' THEN '{lexicon.REPLY_BLANK}' WHEN length(s) < 4 THEN '{lexicon.REPLY_SHORT}'
  WHEN s IN ('hello', 'namaste', 'namaskar', 'good morning', 'good afternoon', 'good evening')
    THEN '{lexicon.REPLY_GREETING.format(name=lexicon.ASSISTANT_NAME)}'
  WHEN s IN ('thank you', 'thanks', 'dhanyabad') THEN '{lexicon.REPLY_GRATITUDE.replace("'", "''")}'
  WHEN s IN ('sorry', 'my bad', 'apologies') THEN '{lexicon.REPLY_APOLOGY.replace("'", "''")}' END AS reply,
  {_sql_any('lower(question)', lexicon.MATH_MARKS)} AS math FROM said""",
)
def routing(spark, folder):
    q = F.col("question")
    return _turns(spark, folder).select(
        "conv_id", "turn", gates.canned_reply(q).alias("reply"), gates.is_math_query(q).alias("math")
    )


@query(
    "p5_retrieval_gate",
    f"""WITH {_TURNS}, said AS (SELECT *, trim(lower(question)) AS s, len({sql_words('question')}) AS n FROM turns)
SELECT conv_id, turn, CASE WHEN length(trim(question)) < 5 THEN false WHEN {_sql_any('s', lexicon.CHITCHAT)} THEN false
  WHEN n < 4 AND NOT {_sql_any('s', lexicon.CURRICULUM_TERMS)} THEN false
  WHEN {_sql_any('s', lexicon.CURRICULUM_INDICATORS)} THEN true ELSE n > 10 END AS retrieve FROM said""",
)
def retrieval_gate(spark, folder):
    return _turns(spark, folder).select("conv_id", "turn", gates.should_retrieve(F.col("question")).alias("retrieve"))


def _sql_word_any(expr: str, words: str) -> str:
    return f"regexp_matches({expr}, '(^|{EDGE})({words})($|{EDGE})')"


_P9 = f"""NOT ({_sql_word_any('lower(question)', 'solve|calculate|compute|evaluate')} OR
  {_sql_word_any('lower(question)', 'formula|equation|algebra')} OR regexp_matches(lower(question), '[\\+\\-\\*\\/=]{{2,}}'))
  AND ({_sql_word_any('lower(question)', 'how|process|work|flow|step|stage|phase')} OR
  {_sql_word_any('lower(question)', 'structure|parts|components|hierarchy|layer')} OR
  {_sql_word_any('lower(question)', 'cycle|loop|path|sequence|order')} OR
  {_sql_word_any('lower(question)', 'compare|difference|relationship|types')})"""


@query(
    "p9_catalogue_gate",
    with_views("messy") + f", {_TURNS} SELECT conv_id, turn, {_P9} AS attempt FROM "
    "(SELECT conv_id, turn, question FROM messy UNION ALL SELECT conv_id, turn + 1000, question FROM turns)",
)
def catalogue_gate(spark, folder):
    asked = views.messy_questions(spark, folder).union(
        _turns(spark, folder).withColumn("turn", F.col("turn") + 1000)
    )
    return asked.select("conv_id", "turn", gates.may_match_catalogue(F.col("question")).alias("attempt"))


@query(
    "p10_show_gate",
    with_views("answers") + f"""
SELECT conv_id, turn, conf >= 0.3 AND {_sql_any('lower(q)', lexicon.SHOW_TRIGGERS)} AND len({sql_words('answer')}) > 25
       AND NOT {_sql_any('lower(q)', lexicon.FACTUAL_MARKS)} AS show
FROM (SELECT *, conv_id % 10 / 10.0 AS conf, concat(CASE conv_id % 4 WHEN 0 THEN 'Explain ' WHEN 1 THEN 'Describe what year '
      WHEN 2 THEN 'types of ' ELSE '' END, question) AS q FROM answers)""",
)
def show_gate(spark, folder):
    n = F.col("conv_id")
    head = F.when(n % 4 == 0, "Explain ").when(n % 4 == 1, "Describe what year ").when(n % 4 == 2, "types of ").otherwise("")
    return views.answers(spark, folder).select(
        "conv_id", "turn",
        gates.show_match(F.concat(head, "question"), F.col("answer"), n % 10 / 10.0).alias("show"),
    )


@query(
    "p17_confidence_bands",
    """
SELECT event_id, CASE WHEN c > 0.7 THEN 'high' WHEN c > 0.4 THEN 'medium' ELSE 'low' END AS band, c < 0.6 AS sources, c < 0.4 AS fallback
FROM (SELECT event_id, event_id % 101 / 100.0 AS c FROM events)""",
)
def confidence_bands(spark, folder):
    c = F.col("event_id") % 101 / 100.0
    return views.table(spark, folder, "events").select(
        "event_id", gates.confidence_band(c).alias("band"), gates.show_sources(c).alias("sources"),
        gates.offer_fallback(c).alias("fallback"),
    )


@query(
    "p12_p13_input_rules",
    """
SELECT doc_id, regexp_matches(name, '^[A-Za-z0-9_]{3,32}$') AS name_ok, length(text) < 2000 AS payload_ok FROM (
  SELECT doc_id, text, concat(CASE doc_id % 4 WHEN 0 THEN 'user_' WHEN 1 THEN 'a b' WHEN 2 THEN '' ELSE 'é' END,
         CAST(doc_id AS VARCHAR)) AS name FROM documents)""",
)
def input_rules(spark, folder):
    n = F.col("doc_id")
    name = F.concat(
        F.when(n % 4 == 0, "user_").when(n % 4 == 1, "a b").when(n % 4 == 2, "").otherwise("é"), n.cast("string")
    )
    return views.table(spark, folder, "documents").select(
        "doc_id", gates.valid_username(name).alias("name_ok"), gates.payload_fits(F.col("text"), 2000).alias("payload_ok")
    )
