from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from lectern import lexicon
from lectern.functions import gates, normalise, similarity
from lectern.operators import questions


def clean(spark, *texts, **options):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, question string")
    return normalise.normalise_questions(df, **options).orderBy("i").collect()


@pytest.mark.parametrize(
    "raw, expected, intent",
    [
        ("hey what is photosynthesis", "What is photosynthesis?", "DESCRIBE"),
        ("WHAT IS GRAVITY", "What is gravity?", "DESCRIBE"),
        ("why is the sky blue", "Why is the sky blue?", "WHY"),
        ("so like what happens when the switch is closed", "What happens in a electric circuit when the switch is closed?", "DESCRIBE"),
        ("What happens if mitochondria stop", "What happens in a cell if mitochondria stop?", "DESCRIBE"),
        ("i wanna know coz u basically said so", "I want to know because you said so", "DESCRIBE"),
        ("please explain the difference between AC and DC",
         "The difference between alternating current and direct current", "COMPARE"),
        ("With reference to the figure above, describe the heart", "Describe the heart", "DESCRIBE"),
        ("define osmosis", "Define osmosis", "DEFINE"),
        ("calculate the speed", "Calculate the speed", "SOLVE"),
        ("how does a pump work???", "How does a pump work?", "HOW"),
    ],
)
def test_chain(spark, raw, expected, intent):
    (row,) = clean(spark, raw)
    assert (row["clean_question"], row["intent"]) == (expected, intent)


def test_invalid_input_falls_back(spark):
    rows = clean(spark, None, "", "ab", "abc")
    assert [r["confidence"] for r in rows] == [0.0, 0.0, 0.0, 1.0]
    assert [r["intent"] for r in rows][:3] == ["UNKNOWN"] * 3
    assert rows[2]["clean_question"] == "ab" and rows[0]["clean_question"] == ""


def test_fuzzy_phrase_goes_and_is_noted(spark):
    (row,) = clean(spark, "acording to the pasage name the king")
    assert row["clean_question"] == "Name the king" and "removed_fuzzy" in row["notes"]


def test_fuzzy_matches_brute_force(spark, folder):
    texts = [r["text"] for r in spark.read.parquet(f"{folder}/conversations.parquet").where("role = 'user'").collect()]
    texts += ["explain im brief the moon", "tell acording to the passage", "x with reference to figure above y"]
    for text in texts:
        tokens = text.split()
        for phrase in lexicon.FUZZY_PHRASES:
            span = len(phrase.split())
            ratios = [
                SequenceMatcher(None, " ".join(t.lower() for t in tokens[i : i + span]), phrase).ratio()
                for i in range(len(tokens) - span + 1)
            ]
            top = max(ratios, default=0)
            expected = ratios.index(top) if top >= lexicon.FUZZY_THRESHOLD else -1
            assert similarity.best_window(tokens, phrase, lexicon.FUZZY_THRESHOLD) == expected
            likely = similarity.rows_with_likely_window([text.lower().split()], [phrase], lexicon.FUZZY_THRESHOLD)
            assert expected < 0 or likely == {0}


def test_native_phrase_filter_never_hides_a_match(spark):
    df = spark.createDataFrame([("explan in brif it",), ("acording to the pasage",), ("zzz",)], "q string")
    hit = similarity.may_hold_phrase(F.col("q"), lexicon.FUZZY_PHRASES, lexicon.FUZZY_THRESHOLD)
    assert [r[0] for r in df.select(hit).collect()] == [True, True, False]


def test_confidence_drops_for_short_results(spark):
    (row,) = clean(spark, "give reasons give reasons in your own words why")
    assert row["confidence"] < 1.0


def test_scaffold(spark):
    rows = clean(spark, "why do cats purr", "name a cat", scaffolding=True)
    assert rows[0]["scaffolded_prompt"] == "Explain the reason: Why do cats purr?"
    assert rows[1]["scaffolded_prompt"] == "Explain clearly: Name a cat"


def test_learned_phrases_longest_first(spark):
    asked = spark.createDataFrame([("ok sir please sir tell",)], "question string")
    words = spark.createDataFrame([("Please sir ",), ("sir",), (" ",)], "phrase string")
    df = questions.attach_learned(asked, questions.learned_dictionary(words))
    (row,) = normalise.normalise_questions(df, learned="learned").collect()
    assert row["clean_question"] == "Ok tell" and row["notes"].count("removed_learned") == 2


def test_regex_characters_in_learned_phrases(spark):
    asked = spark.createDataFrame([("what (a.b) is x",)], "question string")
    words = spark.createDataFrame([("(a.b)",)], "phrase string")
    df = questions.attach_learned(asked, questions.learned_dictionary(words))
    assert normalise.normalise_questions(df, learned="learned").first()["clean_question"] == "What is x?"


def removed(spark, asked, phrases, **options):
    table = spark.createDataFrame([(p,) for p in phrases], "phrase string")
    df = questions.attach_learned(spark.createDataFrame([(i, t) for i, t in enumerate(asked)], "i int, question string"), table)
    return [r[0] for r in df.orderBy("i").select(normalise.remove_learned(F.col("question"), F.col("learned"))["text"]).collect()]


def test_removal_that_closes_up_to_another_phrase(spark):
    phrases = ["xyz", "ab", "c", "bcd", "qqqq", "é ß", "😀!"]
    asked = ["axyzb", "AxYzB keep", "bxyzcd", None, "", "ab" * 40, "one É ß two", "hi 😀! a😀!b", "nothing of it", "axyxyzzb"]
    expected = []
    for text in asked:
        for p in sorted(phrases, key=lambda p: (-len(p), p)):
            at = text.lower().find(p) if text is not None else -1
            while at >= 0:
                text = text[:at] + text[at + len(p):]
                at = text.lower().find(p, at)
        expected.append(text)
    assert removed(spark, asked, phrases) == expected


def test_a_million_phrases(spark):
    many = spark.range(1_000_000).select(F.concat(F.lit("phrase "), F.hex("id"), F.lit(" end")).alias("phrase"))
    asked = spark.createDataFrame([(1, "So phrase 1F4 end tell"), (2, "phrase F423F end"), (3, "phrase F4240 end"), (4, None)], "i int, question string")
    rows = questions.attach_learned(asked, questions.learned_dictionary(many)).orderBy("i").collect()
    assert [r["learned"] for r in rows] == [["phrase 1f4 end"], ["phrase f423f end"], [], []]


def test_only_texts_with_the_rarest_letters_meet_a_phrase(spark):
    texts = spark.createDataFrame([(str(i), "the quick fox " + ("zzz jumps" if i == 7 else "jumps")) for i in range(50)], "key string, text string")
    phrases = spark.createDataFrame([("the zzz",), ("fox zzz",), ("zz",), ("fox j",)], "phrase string")
    assert {tuple(r) for r in questions.phrase_hits(texts, phrases).collect()} == {("7", "fox zzz"), ("7", "zz")} | {(str(i), "fox j") for i in range(50) if i != 7}


def test_learned_phrases_of_the_text_that_the_chain_has_made(spark):
    asked = spark.createDataFrame([("hey what can u tell sir",)], "question string")
    words = questions.learned_dictionary(spark.createDataFrame([("can you ",), ("sir",)], "phrase string"))
    (row,) = normalise.normalise_questions(asked, learned=questions.learned_from(words)).collect()
    assert row["clean_question"] == "What tell?" and row["notes"].count("removed_learned") == 2


@pytest.mark.parametrize(
    "text, expected",
    [
        ("too short here", False), ("A) one two three four five six", False), ("3. one two three four five", False),
        ("ALL CAPS ARE SKIPPED RIGHT HERE", False), ("what is h2o made of", True), ("an extraordinarylongword in this text", True),
        ("this is sooooo very good", True), ("only six plain words are here", False),
        ("this one has more than ten words in it so check it", True),
    ],
)
def test_spell_gate(spark, text, expected):
    df = spark.createDataFrame([(text,)], "q string")
    assert df.select(gates.needs_spell_check(F.col("q"))).first()[0] is expected


@pytest.mark.parametrize(
    "question, answer, confidence, expected",
    [
        ("Explain the water cycle", "word " * 30, 0.8, True), ("Explain the water cycle", "word " * 25, 0.8, False),
        ("Explain the water cycle", "word " * 30, 0.2, False), ("Describe what year it was", "word " * 30, 0.9, False),
        ("Name a colour", "word " * 30, 0.9, False),
    ],
)
def test_show_gate(spark, question, answer, confidence, expected):
    df = spark.createDataFrame([(question, answer, confidence)], "q string, a string, c double")
    assert df.select(gates.show_match(F.col("q"), F.col("a"), F.col("c"))).first()[0] is expected


def test_blank_and_null_turns_get_replies(spark):
    df = spark.createDataFrame([(None,), ("  ",), ("ok",), ("HELLO",), ("what is x",)], "q string")
    replies = [r[0] for r in df.select(gates.canned_reply(F.col("q"))).collect()]
    assert replies[0] == replies[1] == lexicon.REPLY_BLANK and replies[2] == lexicon.REPLY_SHORT
    assert replies[3].startswith("Namaste") and replies[4] is None
