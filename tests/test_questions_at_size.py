"""Digests of a batch, block counts of both sides, and the test of a text's length."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.functions import chunking, vectors
from lectern.functions.words import strip
from lectern.operators import blocks, retrieval

ODD = ["", "a b a", "ß É İ x\x1cy", "日本 語" * 30, "w" * 55, "w" * 56, "v" * 300 + " end", "a\x85b c"]


def test_digests_are_those_of_md5():
    rng = np.random.default_rng(1)
    texts = [rng.bytes(n) for n in [*range(70), 200]] + [b"a\0", b"a\0\0", b""]
    assert [h.tobytes() for h in vectors.digest_heads(texts)] == [hashlib.md5(t).digest()[:8] for t in texts]
    assert vectors.digest_heads([]).shape == (0, 8)


@pytest.mark.parametrize("dim", [64, 7])
def test_hashed_texts_are_signed_bags_of_words(dim):
    wanted = np.zeros((len(ODD), dim))
    for row, text in zip(wanted, ODD):
        for token in text.lower().split():
            digest = hashlib.md5(token.encode()).hexdigest()
            row[int(digest[:8], 16) % dim] += 1.0 if int(digest[8], 16) < 8 else -1.0
    assert np.array_equal(vectors.hashing_encoder(dim)(ODD), wanted)


def test_a_token_that_comes_again_is_digested_once(monkeypatch):
    seen, heads = [], vectors.digest_heads
    monkeypatch.setattr(vectors, "digest_heads", lambda texts: seen.extend(texts) or heads(texts))
    vectors.hashing_encoder(8)(["a b a", "b c"] * 50)
    assert sorted(seen) == [b"a", b"b", b"c"]


def test_superscripts_are_found_in_texts_that_have_one():
    assert chunking.math_regions("so x ² + y. next") == [(0, 10)]
    assert chunking.math_regions("a^ = 3\nb") == [(0, 6)] and chunking.math_regions("plain + text = 1") == []


def test_items_are_not_copied_for_probes_that_fit_one_block(spark):
    probes = spark.range(100).select(F.col("id").alias("p"), F.lit("k").alias("key"))
    items = spark.range(8000).select(F.col("id").alias("i"), F.lit("k").alias("key"))

    def met(p, i):
        import pandas as pd

        return pd.DataFrame({"n": [len(p)], "m": [len(i)]})

    # 80 blocks of items are pairs enough: eight blocks of probes would copy every item eight times.
    pairs = blocks.cogroup_blocks(probes, items, met, "n long, m long", ["key"], 10, 10, 100).collect()
    assert sum(r["m"] for r in pairs) == 8000 and {r["n"] for r in pairs} == {100}
    whole = blocks.cogroup_blocks(probes.drop("key"), items.drop("key"), met, "n long, m long", [], 10, 10, 100).collect()
    assert sum(r["m"] for r in whole) == 8000


def test_a_text_of_ten_letters_is_told_without_a_strip(spark):
    texts = ["", " ", "123456789", "1234567890", " 123456789\n", "  1234567890  ", "a        b", "a       b", "\n\na\n\n\n\n\n\n\n\nb\n",
             "😀" * 9, "😀" * 10, "x" * 5000, " " * 5000 + "ab" + "\n" * 50, None, "12345678\u0085", "123456789\u00850"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(
        (F.length(strip(F.col("text"))) >= 10).alias("was"), F.col("text").rlike(retrieval.TEN_LONG).alias("now")
    ).collect()
    assert [r["now"] for r in rows] == [r["was"] for r in rows]


def test_best_rows_are_the_same_where_few_rows_of_a_tile_are_open(monkeypatch):
    rng = np.random.default_rng(2)
    monkeypatch.setattr(blocks, "TILE_ROWS", 16)
    monkeypatch.setattr(blocks, "TILE_COLUMNS", 32)
    q, c = rng.integers(-1, 2, (50, 4)).astype(float), rng.integers(-1, 2, (700, 4)).astype(float)
    ids = rng.permutation(len(c))
    q[3] = np.nan
    rows, cols, values = retrieval.best_per_group(q, c, ids, 2)
    whole = np.round(q @ c.T, retrieval.TIE_PLACES)
    assert list(zip(rows.tolist(), cols.tolist())) == [(i, int(j)) for i in range(50) for j in np.lexsort((ids, -whole[i]))[:2]]
