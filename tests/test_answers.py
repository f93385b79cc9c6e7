import pytest
from pyspark.sql import functions as F

from lectern.functions import answers


def one(spark, expr, **cols):
    kinds = {str: "string", float: "double", list: "array<string>", int: "int"}
    schema = ", ".join(f"{k} {kinds[type(v)] if v is not None else 'string'}" for k, v in cols.items())
    return spark.createDataFrame([tuple(cols.values())], schema).select(expr).first()[0]


@pytest.mark.parametrize(
    "answer, context, grounded, reason",
    [
        ("", ["x"], False, "No answer or context"), ("something", [], False, "No answer or context"),
        ("too short here", ["x"], True, "Answer too short to validate"), ("a bb ccc dddd eee f", ["x"], True, "No key terms to validate"),
        ("plants convert light energy chemical", ["Plants convert light into chemical energy"], True, "Grounded"),
        ("quantum tunnelling happens through barriers plants", ["plants grow"], False, "Low context overlap (17%)"),
        ("plants convert energy but i couldn't find more", ["plants convert energy couldn"], False, "Model admitted lack of knowledge"),
    ],
)
def test_grounding(spark, answer, context, grounded, reason):
    row = one(spark, answers.grounding(F.col("a"), F.col("c")), a=answer, c=context)
    assert (row["grounded"], row["reason"]) == (grounded, reason)


def test_relevance(spark):
    check = lambda q, c: one(spark, answers.context_relevant(F.col("q"), F.col("c")), q=q, c=c)
    assert check("how do plants make food", "Green plants make their own food here")
    assert check("photosynthesis", "about photosynthesis in leaves") and not check("photosynthesis", "photosynthesis")
    assert not check("what does this mean", "an unrelated line of text")


def test_confidence_grows_with_overlap_and_context(spark):
    said = "word " * 60 + "plants food"
    low = one(spark, answers.answer_confidence(F.col("a"), F.col("q")), a=said, q="rocks minerals")
    high = one(spark, answers.answer_confidence(F.col("a"), F.col("q"), F.lit(0.8)), a=said, q="plants food")
    assert round(low, 6) == 0.7 and round(high, 6) == 0.98
    assert one(spark, answers.answer_confidence(F.col("a"), F.col("q")), a="too short", q="x") == 0.3
    assert one(spark, answers.model_confidence(F.col("a"), F.col("q")), a=said, q="plants rocks") == 0.75


def test_cleaning(spark):
    clean = lambda a: one(spark, answers.clean_answer(F.col("a")), a=a)
    assert clean(" A: It is  water\nQ: next") == "It is water next."
    assert clean("Done! Exercise: try") == "Done!" and clean("") == "" and clean(None) == ""


def test_prompt_cuts_context_at_a_full_stop(spark):
    text = "A sentence. " * 100
    prompt = one(spark, answers.build_prompt(F.col("q"), F.col("c")), q="Why?", c=text)
    body = prompt.split("Reference material:\n")[1].split("\n\nQuestion")[0]
    assert len(body) <= 851 and body.endswith("sentence.")
    assert "Reference material" not in one(spark, answers.build_prompt(F.col("q"), F.col("c")), q="Why?", c="  ")


@pytest.mark.parametrize(
    "reply, said, key, correct, text",
    [
        ("[CORRECT] Feedback: good", "a", "b", True, "good"), ("Verdict: [INCORRECT] Feedback: no", "a", "a", False, "no"),
        ("unclear", "Key", "key", True, "unclear"), ("unclear", "x", "key", False, "unclear"), ("unclear", "", "", False, "unclear"),
    ],
)
def test_verdict(spark, reply, said, key, correct, text):
    row = one(spark, answers.parse_verdict(F.col("r"), F.col("s"), F.col("k")), r=reply, s=said, k=key)
    assert (row["correct"], row["explanation"]) == (correct, text)


def test_joined_context(spark):
    assert one(spark, answers.joined_context(F.col("t")), t=["a" * 400, "b" * 400, "c"]) == "a" * 400 + "\n\n" + "b" * 198
