"""Content against its schema: unknown fields, wrong types, any depth."""

import json

from lectern.operators import content_check


def found(spark, *contents):
    files = spark.createDataFrame([(i, c if isinstance(c, str) else json.dumps(c)) for i, c in enumerate(contents)], "file int, value string")
    return sorted((r["file"], r["path"], r["rule"], r["message"]) for r in content_check.violations(files).collect())


def content(*subtopics, **more):
    return {"subject": "Science", "grade": 7, "topics": [{"name": "T", "subtopics": list(subtopics)}], **more}


GOOD = {"name": "C", "summary": "s", "steps": ["a"], "questions": [{"question": "q", "acceptable_answers": ["x"], "hints": ["h"]}]}


def test_sound_content_has_no_violation(spark):
    deep = {"name": "S", "concepts": [GOOD]}
    for _ in range(7):
        deep = {"name": "S", "subtopics": [deep]}
    assert found(spark, content(deep), content({"name": "S", "concepts": []}), {**content(), "grade": "12"}) == []


def test_unknown_fields_and_wrong_types_at_every_level(spark):
    bad = {"name": 5, "concepts": [{**GOOD, "colour": "red", "steps": "a", "questions": [{"question": "q", "acceptable_answers": [1, " "], "hints": [], "level": None}, 3]}], "note": {}}
    deep = bad
    for _ in range(7):
        deep = {"name": "S", "subtopics": [deep]}
    at = "Science > Topic 'T'" + " > Subtopic 'S'" * 7 + " > Subtopic '5'"
    concept = at + " > Concept 'C'"
    assert found(spark, content(deep, tags=[1])) == sorted([
        (0, "Science", "unknown_field", "field tags"), (0, at, "wrong_type", "name is integer, not string"), (0, at, "unknown_field", "field note"),
        (0, concept, "unknown_field", "field colour"), (0, concept, "wrong_type", "steps is string, not list"),
        (0, concept + " > Question 1", "unknown_field", "field level"), (0, concept + " > Question 1", "wrong_type", "1 of acceptable_answers not text"),
        (0, concept + " > Question 1", "answer_text", "answer is blank"), (0, concept + " > Question 1", "hints_empty", "no hint"),
        (0, concept + " > Question 2", "wrong_type", "a node is integer, not object"),
    ])


def test_missing_and_blank_fields(spark):
    rows = found(
        spark, {"subject": "Art", "grade": "13", "topics": [{"name": " "}]}, {}, "nonsense{", None, "[1]", content({"concepts": [{"name": ""}]}, {"name": "S"}), {**content(), "topics": {}},
    )
    by_file = {}
    for file, _, rule, _ in rows:
        by_file.setdefault(file, []).append(rule)
    assert {k: sorted(v) for k, v in by_file.items()} == {
        0: ["grade", "subject", "topic_fields", "topic_name"], 1: ["content_fields"], 2: ["not_json"], 3: ["wrong_type"], 4: ["wrong_type"],
        5: ["concept_fields", "concept_name", "subtopic_content", "subtopic_fields"], 6: ["wrong_type"],
    }
