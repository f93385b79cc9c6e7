import json
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from lectern.operators import curriculum, fuzzy, grading
from lectern.sources import curriculum as source


def concept(name, questions=("Q?",), steps=("first",), summary=None):
    return {
        "name": name, "summary": summary or f"About {name}", "steps": list(steps),
        "questions": [{"question": q, "acceptable_answers": [f"{q} yes"], "hints": ["h"]} for q in questions],
    }


TREE = {
    "subject": "Science", "grade": 10,
    "topics": [
        {"name": "Life", "concepts": [concept("Top")], "subtopics": [
            {"name": "Cells", "concepts": [concept("Cell"), concept("Wall", ["W1?", "W2?"])],
             "subtopics": [{"name": "Parts", "concepts": [concept("Nucleus")]}]},
            {"name": "Empty", "subtopics": []},
            {"name": "Later", "concepts": [concept("Cell", summary="a second cell")]},
        ]},
        {"name": "Force", "subtopics": [{"name": "Push", "concepts": [concept("Lever")]}]},
    ],
}


@pytest.fixture(scope="module")
def tree(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("content")
    (root / "science.json").write_text(json.dumps(TREE))
    (root / "zbad.json").write_text("{not json")
    (root / "Deep").mkdir()
    (root / "Deep" / "content.json").write_text(json.dumps({"subject": "x", "grade": "13", "topics": []}))
    (root / "Deep" / "other.json").write_text(json.dumps(TREE))
    return source.load(source.read_files(spark, str(root)))


@pytest.fixture(scope="module")
def flat(tree):
    return curriculum.flatten_concepts(tree)


def test_load_skips_bad_files_and_names_nested_ones_by_folder(tree):
    assert {r["subject"]: r["grade"] for r in tree.collect()} == {"Science": "10", "Deep": "13"}


def test_nested_file_wins_over_flat(spark):
    rows = [("/c/Science.json", json.dumps({"grade": 1, "topics": []}), True), ("/c/Science/content.json", json.dumps({"grade": 2, "topics": []}), False)]
    out = source.load(spark.createDataFrame(rows, "path string, value string, flat boolean")).collect()
    assert [(r["subject"], r["grade"]) for r in out] == [("Science", "2")]


def test_flatten_is_depth_first(flat):
    rows = flat.orderBy("subject", "ord").collect()
    assert [(r["topic"], "/".join(r["subtopic_path"]), r["concept"]) for r in rows] == [
        ("Life", "", "Top"), ("Life", "Cells", "Cell"), ("Life", "Cells", "Wall"), ("Life", "Cells/Parts", "Nucleus"),
        ("Life", "Later", "Cell"), ("Force", "Push", "Lever"),
    ]
    assert curriculum.flatten_questions(flat).count() == 7


def test_lookup_takes_the_first_and_checks_the_index(spark, flat):
    asked = spark.createDataFrame([("Science", "Life", "Cell", 0), ("Science", "Life", "Wall", 1), ("Science", "Life", "Wall", 2), ("Science", "x", "y", 0)],
                                  "subject string, topic string, concept string, question_no int")
    assert curriculum.lookup_concepts(flat, asked).where("concept = 'Cell'").first()["summary"] == "About Cell"
    found = {(r["concept"], r["question_no"]): r["question"] for r in curriculum.lookup_question(flat, asked).collect()}
    assert found == {("Cell", 0): "Q?", ("Wall", 1): "W2?"}


def test_paths_and_browse(flat):
    at = curriculum.concepts_at_path(flat, "Science", "Life", ["Cells"])
    assert sorted(r["concept"] for r in at.collect()) == ["Cell", "Nucleus", "Wall"]
    assert curriculum.concepts_at_path(flat, "Science", "Life").count() == 5
    labels = [r["label"] for r in curriculum.browse_entries(flat).orderBy("first", F.size("path")).collect()]
    assert labels == ["Life", "Life > Cells", "Life > Cells > Parts", "Life > Later", "Force", "Force > Push"]


def test_violations_name_path_and_rule(spark):
    bad = {"subject": "Art", "grade": "13", "topics": [
        {"name": "T", "subtopics": [{"concepts": [{"name": "C", "steps": ["", "ok"], "questions": [
            {"question": " ", "acceptable_answers": [], "hints": ["h", ""]}, {"question": "only"}]}]}, {"name": "S"}]},
        {"name": "U"},
    ]}
    files = spark.createDataFrame([("/c/a.json", json.dumps(bad), True)], "path string, value string, flat boolean")
    rules = sorted(r["rule"] for r in curriculum.violations(source.load(files)).collect())
    assert rules == sorted([
        "subject", "grade", "subtopic_name", "concept_fields", "step_text", "question_text", "answers_empty", "hint_text",
        "question_fields", "subtopic_content", "topic_fields",
    ])


def test_concepts_right_below_a_topic_are_checked(spark):
    bad = {"subject": "English", "grade": "1", "topics": [{"name": "T", "concepts": [{"name": " ", "summary": "", "steps": [], "questions": []}], "subtopics": []}]}
    files = spark.createDataFrame([("/c/a.json", json.dumps(bad), True)], "path string, value string, flat boolean")
    rules = {r["rule"] for r in curriculum.violations(source.load(files)).collect()}
    assert {"concept_name", "concept_summary", "steps_empty"} <= rules


def test_valid_content_has_no_violations(spark):
    good = {"subject": "English", "grade": "12", "topics": [{"name": "T", "subtopics": [{"name": "S", "concepts": [concept("C")]}]}]}
    files = spark.createDataFrame([("/c/a.json", json.dumps(good), True)], "path string, value string, flat boolean")
    assert curriculum.violations(source.load(files)).count() == 0


def test_content_is_checked_at_any_depth(spark):
    def nested(depth, leaf):
        for n in range(depth):
            leaf = {"name": f"n{n}", "subtopics": [leaf]}
        content = {"subject": "English", "grade": "1", "topics": [{"name": "T", "subtopics": [leaf]}]}
        return spark.createDataFrame([("/c/a.json", json.dumps(content), True)], "path string, value string, flat boolean")

    good = {"name": "leaf", "concepts": [concept("C")]}
    bad = {"name": " ", "concepts": [{**concept("C"), "steps": [], "colour": 1}], "subtopics": [{"name": "x"}]}
    for depth in (3, 5, 9):
        assert curriculum.violations(source.load(nested(depth, good))).count() == 0
        found = curriculum.violations(source.load(nested(depth, bad))).collect()
        rules = {r["rule"] for r in found}
        assert {"subtopic_name", "steps_empty", "subtopic_content"} <= rules and "too_deep" not in rules
        assert any(r["path"].startswith(f"English > Topic 'T' > Subtopic 'n{depth - 1}'") for r in found)


def test_flatten_goes_as_deep_as_the_content(spark):
    """Eleven levels, some without a name, some with two subtopics, against a recursive walk."""
    node = {"name": "leaf", "concepts": [concept("C0")]}
    for n in range(1, 11):
        side = {"name": f"side{n}", "concepts": [concept(f"S{n}")]}
        node = {"name": "" if n == 4 else f"n{n}", "concepts": [concept(f"C{n}"), concept(f"D{n}")], "subtopics": [side, node] if n % 3 == 0 else [node]}
    content = {"subject": "English", "grade": "1", "topics": [{"name": "T", "concepts": [concept("top")], "subtopics": [node]}]}

    def walk(node, path):
        for c in node.get("concepts") or []:
            yield c["name"], path
        for s in node.get("subtopics") or []:
            yield from walk(s, [*path, s["name"]] if s["name"] else path)

    files = spark.createDataFrame([("/c/a.json", json.dumps(content), True)], "path string, value string, flat boolean")
    expected = list(walk(content["topics"][0], []))
    for depth in (1, 4):
        rows = curriculum.flatten_concepts(source.load(files, depth=depth), depth=depth).orderBy("ord").collect()
        assert [(r["concept"], r["subtopic_path"]) for r in rows] == expected


def brute_search(rows, query, ratio):
    q = query.lower()
    out = []
    for r in rows:
        texts = [r["concept"], r["summary"], *r["steps"], *[t for x in r["questions"] for t in (x["question"], *x["acceptable_answers"])]]
        texts = [t.lower() for t in texts]
        if q.strip() and any(SequenceMatcher(None, q, t).ratio() > ratio or all(w in t for w in q.split()) for t in texts):
            out.append(r["concept"])
    return out[:3]


def test_search_matches_brute_force_in_both_layouts(spark, flat):
    rows = flat.orderBy("subject", "ord").collect()
    queries = ["nucleos", "About cell", "lever", "w1", "zzz", "", "wall about", "abot the cell", "q"]
    asked = spark.createDataFrame(list(enumerate(queries)), "query_id long, query string")
    for limits in ({}, {"probe_rows": 2, "item_rows": 2}):
        found = curriculum.search(flat, asked, **limits).orderBy("query_id", "place").collect()
        got = {i: [r["concept"] for r in found if r["query_id"] == i] for i in range(len(queries))}
        assert got == {i: brute_search(rows, q, 0.6) for i, q in enumerate(queries)}


def test_bounds_rule_out_pairs_and_lose_none():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgil mnoprst") for _ in range(rng.randint(2, 9))) for _ in range(60)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 30))) for _ in range(120)] + ["x" * 300, "é" * 40, "", "a"]
    queries = [t.replace("e", "") for t in texts[:40]] + ["".join(rng.sample(t, len(t))) for t in texts[40:60]] + ["x" * 250, "ab"]
    found, tried = fuzzy.over_ratio(queries, texts, 0.6)
    pairs = {(i, j) for i, q in enumerate(queries) for j, t in enumerate(texts) if SequenceMatcher(None, q, t).ratio() > 0.6}
    assert set(found) == pairs and len(found) == len(pairs)
    assert tried < 0.25 * len(queries) * len(texts)


@pytest.mark.parametrize("a, b, n", [("", "abc", 0), ("abc", "abc", 3), ("abcbdab", "bdcaba", 4), ("x" * 90, "x" * 70, 70), ("ab" * 50, "ba" * 50, 99)])
def test_subsequence(a, b, n):
    assert fuzzy.subsequence(a, b) == n


def test_fuzzy_search_at_every_length(spark):
    """Length classes lose no pair: texts of all lengths against queries of all lengths, with one letter."""
    texts = spark.createDataFrame([("a" * n,) for n in range(1, 60)], "text string")
    asked = spark.createDataFrame([("a" * n,) for n in range(1, 60)], "query string")
    got = {(len(r["query"]), len(r["text"])) for r in fuzzy.ratio_hits(asked, texts, 0.6).collect()}
    assert got == {(m, n) for m in range(1, 60) for n in range(1, 60) if 2 * min(m, n) / (m + n) > 0.6}


def test_word_hits_of_short_words_and_odd_texts(spark):
    texts = ["a cat sat", "at a", "", "b", "the cat", "é o", "o\u2003é cat"]
    asked = ["a at", "cat a", "b", "é", "at\u2003cat", "zz", " "]
    found = fuzzy.word_hits(spark.createDataFrame([(q,) for q in asked], "query string"), spark.createDataFrame([(t,) for t in texts], "text string"))
    expected = {(q, t) for q in asked for t in texts if q.split() and all(w in t for w in q.split())}
    assert {tuple(r) for r in found.collect()} == expected


def test_relevant_sentence_takes_the_first_best(spark):
    text = "Cells are small. Plants make food. Cells are small"
    df = spark.createDataFrame([(1, text, "Cells are small")], "id int, s string, q string")
    row = curriculum.relevant_sentence(df, ["id"], "s", "q").first()
    assert row["sentence"] == "Cells are small" and row["ratio"] == 1.0


def test_grading_matches_brute_force(spark):
    key = [("q1", ["Paris", "the city of Paris"]), ("q2", ["four"])]
    said = [("q1", "paris"), ("q1", "pariss"), ("q1", "London"), ("q1", "the city of pari"), ("q2", "fourr"), ("q2", "4"), ("q3", "x"), ("q2", None)]
    out = grading.grade(
        spark.createDataFrame([(i, *s) for i, s in enumerate(said)], "i int, question string, answer string"),
        spark.createDataFrame(key, "question string, acceptable_answers array<string>"),
    ).collect()
    accepted = dict(key)
    for r in out:
        answer = (said[r["i"]][1] or "\0").lower()
        keys = [k.lower() for k in accepted.get(said[r["i"]][0], [])]
        assert r["correct"] == any(answer == k or SequenceMatcher(None, answer, k).ratio() > 0.8 for k in keys)


def _tracked(monkeypatch, module):
    """The tables that a module writes, by purpose."""
    made, write = [], module.written
    monkeypatch.setattr(module, "written", lambda df, purpose: made.append(purpose) or write(df, purpose))
    return made


def test_load_keeps_files_of_one_path_and_files_without_a_name(spark):
    text = lambda **fields: json.dumps(fields | {"topics": [{"name": "T"}]})
    rows = [
        ("/c/a.json", text(subject="A", grade=1), True), ("/c/b.json", text(subject="A", grade=2), True),  # b wins A
        ("/c/d.json", text(subject="D", grade=3), True), ("/c/d.json", text(subject="E", grade=4), True),  # one path, two names
        ("/c/n.json", text(), True), ("/c/x.json", "{broken", True), (None, text(subject="N"), True),
        ("/c/g.json", text(subject="G", grade=5), True), ("/c/G/content.json", text(subject="z", grade=6), False),
        ("/c/b.json", "{broken", True),
    ]
    files = spark.createDataFrame(rows, "path string, value string, flat boolean")
    found = sorted((r["subject"], r["grade"] or "", r["path"]) for r in source.load(files).collect())
    assert found == sorted([
        ("A", "2", "/c/b.json"), ("A", "", "/c/b.json"), ("D", "3", "/c/d.json"), ("D", "4", "/c/d.json"), ("E", "3", "/c/d.json"),
        ("E", "4", "/c/d.json"), ("n", "", "/c/n.json"), ("G", "6", "/c/G/content.json"),
    ])


def test_load_neither_sorts_nor_shuffles_the_content(spark):
    rows = [(f"/c/{i}.json", json.dumps({"subject": f"S{i}", "grade": 1, "topics": []}), True) for i in range(20)]
    plan = source.load(spark.createDataFrame(rows, "path string, value string, flat boolean"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan


def test_violations_read_the_content_once(spark, tree, monkeypatch):
    made = _tracked(monkeypatch, curriculum)
    out = curriculum.violations(tree)
    assert made == ["violations"] and "from_json" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.count() > 0


@pytest.mark.parametrize("text", ["", " ", "  \n", " a ", "\né", "\u0085", None])
def test_blank_is_what_strip_leaves_empty(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(curriculum._blank(F.col("t")).alias("b"), (curriculum.strip(F.col("t")) == "").alias("s")).first()
    assert row["b"] == row["s"]


@pytest.mark.parametrize("name", ["p14_lookups", "p15_concepts_at_path"])
def test_concepts_asked_several_times_are_parsed_once(spark, tmp_path, name):
    from lectern import plans

    rows = [(1, "A b c. D, e\nF", "en", "web", 13), (2, "G h", "de", "web", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = plans.load()[0][name](spark, str(tmp_path))
    assert "from_json" not in out._jdf.queryExecution().optimizedPlan().toString() and out.count() > 0
