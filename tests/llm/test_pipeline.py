"""The pipeline's stages on a small corpus with planted cases."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = np.random.default_rng(11)
    syllables = "ka lo mi ren tu fa es on".split()
    prose = lambda n: ["".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(n)]
    passage = prose(60)
    rows, labels = [], []
    for i in range(300):
        w = prose(int(rng.integers(20, 120)))
        if i % 5 == 0:
            w.insert(3, "grumblewort")
            labels.append((i, 0, 1))
        elif i % 5 == 1:
            labels.append((i, 1, 0))
        if i % 50 == 2:
            w += passage
        rows.append([i, " ".join(w)])
    rows += [[1000, rows[2][1]], [1001, rows[3][1] + " more"], [1002, None], [1003, ""], [None, "words without a number"]]
    folder = str(tmp_path_factory.mktemp("corpus"))
    docs = [(i, t, "en", f"s{(i or 0) % 3}", None if t is None else len(t)) for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, dict(map(tuple, rows[:-1])), passage


def test_stages(spark, corpus, tmp_path):
    folder, texts, passage = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(cp.STAGES):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = docs.collect()
        if name != "bpe":
            assert docs.columns == COLUMNS
    ids = {name: {r.doc_id for r in rows} for name, rows in kept.items()}
    toxic = {i for i, t in texts.items() if t and "grumblewort" in t}
    assert not toxic & ids["toxicity"] and len((set(texts) - toxic) - ids["toxicity"]) <= 0.02 * len(texts)
    assert ids["near_dedup"] == ids["toxicity"] - {1000, 1001}
    joined = " ".join(passage)
    assert sum(joined in (r.text or "") for r in kept["near_dedup"]) > 1
    assert sum(joined in (r.text or "") for r in kept["substring_dedup"]) == 1
    plain = {r.doc_id: r.text for r in kept["near_dedup"]}
    assert all(r.text == plain[r.doc_id] for r in kept["substring_dedup"] if joined not in (plain[r.doc_id] or ""))
    count = lambda rows: sum(len(re.findall(r"\S+", r.text or "")) for r in rows)
    assert abs(count(kept["mixing"]) / count(kept["substring_dedup"]) - 1.5) < 0.05
    assert len(kept["bpe"]) == len(kept["mixing"]) and all(r.n_tokens > 0 for r in kept["bpe"])


def test_run_gives_the_last_stage(spark, corpus):
    out = cp.run(spark, corpus[0])
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.where(F.col("n_tokens") > 0).count() > 200


def test_empty_corpus(spark, corpus, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{corpus[0]}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_rows_that_repeat_a_doc_id(spark):
    """Copies go and other texts stay, row by row, where rows share a doc_id or have none."""
    rng = np.random.default_rng(4)
    prose = lambda n: " ".join("".join(rng.choice("ka lo mi ren tu fa es on".split(), 4)) for _ in range(n))
    a, b, c, d, e = (prose(60) for _ in range(5))
    frame = lambda rows: spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    told = lambda df: sorted(((r.doc_id, r.text, r.n_chars) for r in df.collect()), key=str)
    wanted = lambda rows: sorted(((i, t, len(t)) for i, t in rows), key=str)

    rows = [(2, a), (2, a), (2, b), (1, b + " more"), (None, c), (None, c), (3, c), (None, d), (None, d), (2, e)]
    got = cp.drop_near_copies(spark, frame(rows).repartition(3), "")
    assert got.columns == COLUMNS and told(got) == wanted([(2, a), (1, b + " more"), (3, c), (None, d), (2, e)])

    p, q = prose(20), prose(20)
    rows = [(1, f"{a} {p}"), (2, f"{p} {b}"), (2, c), (2, p), (None, f"{d} {p}"), (None, f"{e} {q}"), (None, q)]
    got = cp.drop_repeated_passages(spark, frame(rows).repartition(3), "")
    left = told(got)
    assert got.columns == COLUMNS and set(wanted([(1, f"{a} {p}"), (2, b), (2, c), (None, d)])) <= set(left)
    assert sum(q in t for _, t, _ in left) == 1 and sum(e in t for _, t, _ in left) == 1 and len(left) in (5, 6)
