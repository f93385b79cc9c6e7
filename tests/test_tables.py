"""Progress, mining, sinks, sources and streams on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from lectern.operators import asking, ingest, mining, progress, summary
from lectern.sinks import tables
from lectern.sources import corpus, logs
from lectern.sources import progress as saved
from lectern.streaming import jobs

COUNTS = "user_id long, subject string, topic string, concept string, question string, attempts long, correct long"


def test_reports_on_hand_counts(spark):
    catalogue = spark.createDataFrame([("s", "t", c, q) for c in ("c1", "c2") for q in ("q1", "q2")], "subject string, topic string, concept string, question string")
    counts = spark.createDataFrame([(1, "s", "t", "c1", "q1", 4, 3), (1, "s", "t", "c1", "q2", 3, 3), (1, "s", "t", "c2", "q1", 2, 0), (2, "s", "x", "c", "gone", 9, 9)], COUNTS)
    rows = {r["user_id"]: r.asDict() for r in progress.student_report(counts, catalogue).collect()}
    assert rows[1] == dict(user_id=1, total_questions=4, total_attempts=9, total_correct=6, mastered_questions=2, weak_questions=1)
    assert rows[2]["total_attempts"] == 0
    nxt = {r["user_id"]: r["concept"] for r in progress.next_concept(counts, catalogue).collect()}
    assert nxt == {1: "c2", 2: "c1"}
    assert [r["question"] for r in progress.weak_questions(counts, catalogue).collect()] == ["q1"]


def test_nobody_is_told_a_next_concept_when_all_is_mastered(spark):
    catalogue = spark.createDataFrame([("s", "t", "c", "q")], "subject string, topic string, concept string, question string")
    counts = spark.createDataFrame([(1, "s", "t", "c", "q", 3, 3)], COUNTS)
    assert progress.next_concept(counts, catalogue).count() == 0


def test_next_concept_against_brute_force(spark):
    catalogue = [(s, "t", f"c{i}", q) for s in "ab" for i in range(4) for q in ("x", "y")]
    done = {1: 3, 2: 8, 3: 0, 4: 5}
    rows = []
    for user, n in done.items():
        concepts = sorted({c[:3] for c in catalogue})
        for k in concepts[:n]:
            rows += [(user, *k, q, 3, 3) for q in ("x", "y")]
        rows += [(user, *concepts[-1], "x", 5, 5)]
    counts = spark.createDataFrame(rows, COUNTS).dropDuplicates(["user_id", "subject", "concept", "question"])
    out = {r["user_id"]: (r["subject"], r["concept"]) for r in progress.next_concept(counts, spark.createDataFrame(catalogue, "subject string, topic string, concept string, question string")).collect()}
    assert out == {1: ("a", "c3"), 3: ("a", "c0"), 4: ("b", "c1")}


def test_mining_bonuses_and_examples(spark):
    rows = [(i, f"please tell me about thing{i}", 0.5) for i in range(25)] + [(99, "please tell me now", 0.9), (100, None, None)]
    df = spark.createDataFrame(rows, "seq int, original string, confidence double")
    found = {r["phrase"]: r for r in mining.mine_phrases(df).collect()}
    assert found["please tell"]["frequency"] == 25 and found["please tell"]["confidence"] == 0.9
    assert found["tell me"]["confidence"] == 0.75 and "me about" not in found
    ex = mining.phrase_examples(df, mining.mine_phrases(df), ["seq"]).where("phrase = 'tell me'").orderBy("example").collect()
    assert [e["original"] for e in ex] == [f"please tell me about thing{i}" for i in range(3)]
    assert mining.mine_phrases(df, min_frequency=26).count() == 0


def test_upsert_replaces_inserts_and_keeps(spark, tmp_path):
    path = str(tmp_path / "t")
    make = lambda rows: spark.createDataFrame(rows, "c string, id string, seq int, v string")
    tables.upsert(make([("a", "1", 1, "old"), ("a", "2", 1, "keep"), ("b", "1", 1, "other")]), path, ["c", "id"], ["seq"], within=["c"], buckets=2)
    tables.upsert(make([("a", "1", 2, "x"), ("a", "1", 3, "new"), ("c", "9", 1, "add")]), path, ["c", "id"], ["seq"], within=["c"], buckets=2)
    rows = {(r["c"], r["id"]): r["v"] for r in tables.read_table(spark, path).collect()}
    assert rows == {("a", "1"): "new", ("a", "2"): "keep", ("b", "1"): "other", ("c", "9"): "add"}
    assert tables.read_table(spark, str(tmp_path / "none")) is None


def test_upsert_keeps_the_newest_and_its_bucket_count(spark, tmp_path):
    path = str(tmp_path / "t")
    make = lambda seq, ids, v: spark.createDataFrame([(str(i), seq, v) for i in ids], "id string, seq int, v string")
    tables.upsert(make(5, range(20), "five"), path, ["id"], ["seq"], buckets=2)
    tables.upsert(make(3, range(30), "three"), path, ["id"], ["seq"])
    tables.upsert(make(7, range(0, 30, 3), "seven"), path, ["id"], ["seq"], buckets=9)
    rows = tables.read_table(spark, path)
    expected = {str(i): "seven" if i % 3 == 0 else "five" if i < 20 else "three" for i in range(30)}
    assert {r["id"]: r["v"] for r in rows.collect()} == expected and rows.count() == 30
    assert rows.select("bucket").distinct().count() == 2
    again = str(tmp_path / "again")
    tables.rebucket(rows, again, ["id"], buckets=8)
    tables.upsert(make(9, [1], "nine"), again, ["id"], ["seq"])
    assert {r["id"]: r["v"] for r in tables.read_table(spark, again).collect()} == expected | {"1": "nine"}
    bare = str(tmp_path / "bare")
    make(1, [1], "x").write.parquet(bare)
    with pytest.raises(ValueError):
        tables.upsert(make(1, [1], "x"), bare, ["id"], ["seq"])


def test_ingest_again_replaces_all_chunks(spark, tmp_path):
    schema = "doc_id long, collection string, text string"
    path, word = str(tmp_path / "out"), "some words here. "

    def run(n, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in{n}"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / f"in{n}"))
        jobs.incremental_ingest(stream, path).awaitTermination()
        return {r["doc_id"]: r["n"] for r in tables.read_table(spark, path).groupBy("doc_id").agg(F.count("id").alias("n")).collect()}

    first = run(1, [(1, "a", word * 150), (2, "a", word * 150), (3, "b", word * 9), (4, "b", None)])
    assert first[1] > 3 and set(first) == {1, 2, 3}
    second = run(2, [(1, "a", word * 9), (1, "a", word * 9), (3, "b", ""), (2, "a", None)])
    assert second == {1: 1, 2: first[2]} or second == {1: 1, 2: first[2], 3: 1}
    failed = spark.read.parquet(f"{path}-failed").select("doc_id").collect()
    assert sorted(r["doc_id"] for r in failed) == [2, 4]


def test_stream_cache_starts_from_nothing_and_goes_on(spark, tmp_path):
    schema = "request_id long, subject string, grade string, us long, embedding array<float>"
    for n in range(2):
        spark.createDataFrame([(n, "s", "", 10 + n, [1.0, 0.1 * n])], schema).coalesce(1).write.parquet(str(tmp_path / f"in{n}"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / f"in{n}"))
        jobs.semantic_cache(stream, str(tmp_path / "entries"), str(tmp_path / "hits"), ttl=100).awaitTermination()
    assert [(r["request_id"], r["entry_id"]) for r in spark.read.parquet(str(tmp_path / "hits")).collect()] == [(1, 0)]
    assert [r["entry_id"] for r in spark.read.parquet(str(tmp_path / "entries")).collect()] == [0]


def test_progress_files_import_and_reset(spark, tmp_path):
    doc = {"Sci": {"T": {"C": {"questions": [{"question": "q", "attempts": 5, "correct": 0}]}}}}
    (tmp_path / "progress_Ann.json").write_text(json.dumps(doc))
    (tmp_path / "progress_Bob.json").write_text("{}")
    read = saved.read_progress(spark, str(tmp_path))
    assert saved.explode_progress(read).collect() == [("Ann", "Sci", "T", "C", "q", 5, 0)]
    path = str(tmp_path / "store")
    docs = spark.createDataFrame([("Ann", json.dumps(doc), 1), ("Eve", "not json", 1), ("Big", '{"a": {}, "b": "' + "x" * 100_000 + '"}', 1)], "user_id string, json string, saved_at int")
    assert sorted(r["user_id"] for r in saved.import_progress(docs, path).collect()) == ["Big", "Eve"]
    saved.reset_progress(spark.createDataFrame([("Ann", 2)], "user_id string, saved_at int"), path)
    assert saved.explode_progress(tables.read_table(spark, path)).count() == 0


def test_corpus_scan_and_path_metadata(spark, tmp_path):
    for name, text in (("grade_10/neb_science_grade_10.txt", "a"), ("class_9/Bio Notes.md", "b"), ("x/neb_maths.jsonl", "c"), ("x/skip.csv", "d"), ("x/blank.txt", " \n")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    df = corpus.read_corpus(spark, str(tmp_path)).withColumn("rel", F.regexp_extract("path", r"([^/]+/[^/]+)$", 1))
    rows = {r["text"]: r for r in df.withColumns(corpus.path_metadata(F.regexp_replace("rel", "%20", " "))).collect()}
    assert {t: (r["grade"], r["subject"], r["collection"]) for t, r in rows.items()} == {
        "a": ("10", "science", "neb_science_grade_10"), "b": ("9", "bionotes", "neb_bionotes_grade_9"), "c": ("unknown", "maths", "neb_maths"),
    }


@pytest.mark.parametrize("mode, expected", [("auto", ["scanned", "text"]), ("force", ["scanned"] * 2), ("never", ["text"] * 2)])
def test_density_modes(spark, mode, expected):
    pages = spark.createDataFrame([(1, 0, " a "), (1, 5, "x" * 500), (2, 0, "x" * 60), (2, 2, "x" * 40)], "doc_id int, page_no int, text string")
    assert [r["kind"] for r in corpus.route_by_density(pages, mode).orderBy("doc_id").collect()] == expected


def test_merge_intervals_touching(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 5, 7), (1, 9, 10), (1, 1, 2), (2, 3, 4)], "d int, start int, end int")
    assert sorted(tuple(r) for r in ingest.merge_intervals(df, ["d"]).collect()) == [(1, 0, 7), (1, 9, 10), (2, 3, 4)]


def test_metric_summary_of_no_samples_is_zero(spark):
    empty = spark.createDataFrame([], "ttft double, tokens long")
    assert [tuple(r)[1:] for r in summary.describe_samples(empty, ["ttft", "tokens"]).collect()] == [(0.0,) * 4] * 2


def test_counters_over_several_batches(spark, tmp_path):
    schema = "user_id long, subject string, topic string, concept string, question string, correct boolean"
    for n in range(3):
        rows = [(u, "s", "t", "c", f"q{q}", (u + q + n) % 2 == 0) for u in range(5) for q in range(3)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    jobs.attempt_counters(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    batch = progress.attempt_counts(spark.read.parquet(str(tmp_path / "in")))
    assert sorted(map(tuple, tables.read_table(spark, str(tmp_path / "out")).drop("bucket").collect())) == sorted(map(tuple, batch.collect()))


def test_feedback_side_output(spark, tmp_path):
    rows = [("a", 0.65), ("b", 0.7), ("c", None)]
    spark.createDataFrame(rows, "original string, confidence double").write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("original string, confidence double").json(str(tmp_path / "in"))
    jobs.feedback(stream, str(tmp_path / "log"), str(tmp_path / "low"), str(tmp_path / "cp")).awaitTermination()
    assert logs.read_feedback(spark, str(tmp_path / "log")).count() == 3
    assert [r["original"] for r in logs.read_feedback(spark, str(tmp_path / "low")).collect()] == ["a"]


def test_stream_cache_answers_later_batches(spark, tmp_path):
    schema = "request_id long, subject string, grade string, us long, embedding array<float>"
    for n in range(2):
        spark.createDataFrame([(n, "s", "", 10 + n, [1.0, 0.1 * n])], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seed = spark.createDataFrame([(9, "other", "", 1, [0.0, 1.0])], schema.replace("request_id", "entry_id"))
    seed.write.parquet(str(tmp_path / "entries/run=seed/batch=-1"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    jobs.semantic_cache(stream, str(tmp_path / "entries"), str(tmp_path / "hits"), ttl=100, checkpoint=str(tmp_path / "cp")).awaitTermination()
    assert [(r["request_id"], r["entry_id"]) for r in spark.read.parquet(str(tmp_path / "hits")).collect()] == [(1, 0)]


def test_ask_routes_every_question(spark):
    asked = spark.createDataFrame(
        [(1, "hello", "science", "10", 100), (2, "What is an atom made of", "science", "10", 100), (3, "stored question here", "science", "10", 100)],
        "request_id long, question string, subject string, grade string, us long",
    )
    chunks = ingest.encode_chunks(spark.createDataFrame(
        [(1, "neb_science_grade_10", "an atom is made of protons and neutrons"), (2, "scienceqa", "what is an atom made of? small parts"), (3, "zzz", "atom made of")],
        "vec_id long, collection string, text string"))
    names = chunks.select("collection")
    key = asking.prepare(asked).where("request_id = 3").first()["key"]
    fills = spark.createDataFrame([(key, 50, "kept answer")], "key string, us long, value string")
    entries = spark.createDataFrame([], "entry_id long, subject string, grade string, us long, embedding array<float>, value string")
    model = lambda: (lambda prompts: ["A: An atom is made of smaller parts called protons" for _ in prompts])
    rows = {r["request_id"]: r for r in asking.ask(asked, chunks, names, fills, entries, model).collect()}
    assert [rows[i]["source"] for i in (1, 2, 3)] == ["edge_case", "rag_response", "exact_cache"]
    assert rows[3]["answer"] == "kept answer" and rows[2]["answer"].startswith("An atom is made")
    assert set(rows[2]["sources"]) == {"neb_science_grade_10", "scienceqa"} and rows[2]["sources"][0].startswith("neb") and rows[2]["diagram"] == "atom"
    assert asking.ask(asked, chunks, names, fills, entries).where("request_id = 2").first()["confidence"] == 0.0
