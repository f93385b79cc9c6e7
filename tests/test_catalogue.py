import json
import random

import pytest
from pyspark.sql import functions as F

from lectern.functions import catalogue as cat
from lectern.functions.words import truncate_at_word
from lectern.operators import catalogue
from lectern.sources import catalogue as source


def brute(questions, entries, floor=0.3):
    """Score every entry for every question."""
    stop = {"the", "for", "and", "vs", "a", "an", "of", "in", "on", "at", "to", "or"}
    terms = lambda t: [w for w in t.lower().split() if len(w) >= 3 and w.isalpha() and w not in stop][:5]
    out = {}
    for i, text, subject, grade in questions:
        pool = [e for e in entries
                if (grade is None or grade not in {g for x in entries for g in x[4]} or grade in e[4])
                and (subject is None or subject.lower() not in {x[3] for x in entries} or e[3] == subject.lower())]
        asked = set(terms(text))
        best = None
        for e in sorted(pool or entries):
            held = {k.lower() for k in (e[2] or [*terms(e[1]), "process"])} | set(terms(e[1]))
            m = len(asked & held)
            if m:
                score = min(1.0, m / len(asked) * (1.1 if m >= 2 else 1))
                if best is None or score > best[0]:
                    best = (score, e[0])
        if best and best[0] >= floor:
            out[i] = (best[1], round(best[0], 6))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_match_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    words = ["cell", "plant", "water", "cycle", "force", "light", "atom", "graph", "process", "the", "sun", "moon", "rock"]
    pick = lambda n: " ".join(rng.choices(words, k=n))
    entries = [(f"e{n:02d}", pick(rng.randint(1, 7)), rng.choice([None, rng.choices(words, k=3)]), rng.choice(["science", "maths"]),
                rng.sample([8, 9, 10], k=rng.randint(1, 2))) for n in range(25)]
    asked = [(n, pick(rng.randint(0, 8)), rng.choice([None, "Science", "maths", "art"]), rng.choice([None, 8, 9, 10, 3])) for n in range(60)]
    e = spark.createDataFrame(entries, "id string, title string, keywords array<string>, subject string, grades array<int>").withColumn("type", F.lit("process"))
    q = spark.createDataFrame(asked, "n int, question string, subject string, grade int")
    got = {r["n"]: (r["id"], round(r["confidence"], 6)) for r in catalogue.match_questions(q, e).collect()}
    assert got == brute(asked, entries)


def test_wide_entries_meet_only_the_sets_asked_for(spark):
    words = [f"{a}{b}{c}word" for a in "abcdef" for b in "uvwxyz" for c in "klmnop"]
    entries = spark.createDataFrame([(1, "big", words), (2, "small", words[:2])], "id int, title string, keywords array<string>")
    asked = spark.createDataFrame([(0, " ".join(words[3:8])), (1, " ".join(words[:2])), (2, " ".join(words[10:25]))], "n int, question string")
    got = {r["n"]: (r["id"], r["matches"]) for r in catalogue.match_questions(asked, entries).collect()}
    assert got == {0: (1, 5), 1: (1, 2), 2: (1, 5)}
    rest = spark.createDataFrame([(i, " ".join(words[i : i + 5])) for i in range(20)], "n int, question string")
    assert catalogue.match_questions(asked.union(rest), entries).count() == 23
    # What the index holds follows the questions, not the sets that 216 keywords could form.
    sets = asked.union(rest).select(F.array_sort(F.slice(F.split("question", " "), 1, 5)).alias("t")).select(F.explode(catalogue._subsets(F.col("t"))).alias("subset"))
    scoped = entries.select("id", F.col("keywords").alias("terms"), F.lit("").alias("subject"), F.lit(-1).alias("grade"))
    assert catalogue.subset_index(scoped, sets).count() == sets.distinct().count() < 31 * 23


def test_hot_keyword_folds_into_one_row(spark):
    entries = spark.range(500).select(F.col("id"), F.concat(F.lit("common "), F.when(F.col("id") == 77, "rare").otherwise("usual")).alias("title"))
    asked = spark.range(500).select("id", F.when(F.col("id") == 3, "common rare").otherwise("common other").alias("question")).withColumnRenamed("id", "n")
    got = {r["n"]: r["id"] for r in catalogue.match_questions(asked, entries).collect()}
    assert len(got) == 500 and got[3] == 77 and got[4] == 0


YAML = """
metadata:
  subject: "Science"
  grades: [8, "9", x]
diagrams:
  leaf:
    type: structure
    title: "Parts of a Leaf"
    children:
      - blade
      - name: stem
  bad: 3
  cycle:
    type: process
    title: Water Cycle
    keywords: [Rain, water cycle]
    steps: [Evaporation (slow), {name: Rain}]
"""


def test_yaml_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "grade_09.yaml").write_text(YAML)
    (tmp_path / "sub" / "_index.yaml").write_text(YAML)
    (tmp_path / "sub" / "broken.yml").write_text("{[")
    (tmp_path / "sub" / "plain_grade_11.yml").write_text("metadata: {grade: any}\ndiagrams:\n  one: {title: One}\n")
    rows = {r["id"]: r for r in source.parse_files(source.read_files(spark, str(tmp_path))).collect()}
    assert set(rows) == {"science_leaf", "science_cycle", "sub_one"}
    assert rows["science_leaf"]["grades"] == [8, 9] and rows["sub_one"]["grades"] == [11]
    assert rows["science_cycle"]["keywords"] == ["Rain", "water cycle"] and rows["science_leaf"]["keywords"] is None
    assert json.loads(rows["science_leaf"]["body"])["children"] == ["blade", {"name": "stem"}]


def test_entries_get_keywords(spark):
    df = spark.createDataFrame([(1, "Parts of a Leaf", None, "structure"), (2, "X", ["Own"], "process")], "id int, title string, keywords array<string>, type string")
    rows = {r["id"]: r for r in catalogue.normalise_entries(df).collect()}
    assert rows[1]["keywords"] == ["parts", "leaf", "structure"] and rows[2]["terms"] == ["own"]


def test_display_names(spark):
    steps = ["Evaporation of water (very slow)  ", '{"name": "Rain"}', '{"Cloud": {}}', "x" * 40]
    kids = ["a", '{"name": "b"}', '{"description": "d", "Mammals": {}}', '{"children": []}', *"efghij"]
    df = spark.createDataFrame([(steps, kids)], "s array<string>, k array<string>")
    row = df.select(cat.clean_steps(F.col("s")).alias("s"), cat.child_names(F.col("k")).alias("k"), cat.component_names(F.col("k")).alias("c")).first()
    assert row["s"] == ["Evaporation of water", "Rain", "Cloud", "x" * 30]
    assert row["k"] == ["a", "b", "Mammals", "e", "f", "g", "h", "i"] and row["c"] == ["a", "b", "e", "f", "g", "h", "i", "j"]


def test_structure_uses_children_as_components(spark):
    df = spark.createDataFrame([("structure", None, ["a"]), ("process", None, ["a"]), ("structure", ["b"], ["a"])], "t string, c array<string>, k array<string>")
    rows = df.select(cat.components_of(F.col("t"), F.col("c"), F.col("k"))).collect()
    assert [r[0] for r in rows] == [["a"], None, ["b"]]


def test_truncate(spark):
    df = spark.createDataFrame([("one two three four",), ("short",), ("abcdefghijklmnop qr",)], "t string")
    assert [r[0] for r in df.select(truncate_at_word(F.col("t"), 12)).collect()] == ["one two...", "short", "..."]
