import pandas as pd
import pytest
from pyspark.sql import functions as F

from lectern.functions import chunking
from lectern.operators import ingest

TEXTS = {
    "short": "a" * 99,
    "edge": "b" * 100,
    "one": "c" * 512,
    "over": "d" * 513,
    "no spaces": "e" * 2000,
    "sentences": "One two three four five six seven. " * 60,
    "formula": "x" * 480 + " $" + "y+" * 60 + "$ tail. " + "more words here. " * 50,
    "code": "word " * 98 + "```" + "code line; " * 30 + "``` " + "after it. " * 80,
    "superscript": "Start here. " * 38 + "so x² + 5x + 6 = 0 holds for this long clause " * 3 + ". " + "end of it. " * 60,
    "paragraphs": ("para text goes on and on\n\n" * 50),
    "blank": "   ",
    "empty": "",
}


@pytest.mark.parametrize("name", TEXTS)
def test_chunks_are_slices_that_advance(name):
    text = TEXTS[name]
    chunks = chunking.cut_text(text)
    assert chunks and [c.chunk_id for c in chunks] == list(range(len(chunks)))
    for chunk in chunks[:-1]:
        assert chunk.text == text[chunk.start_pos : chunk.end_pos].strip() and len(chunk.text) >= 100
    assert chunks[-1].text == text[chunks[-1].start_pos :] and chunks[-1].end_pos == len(text)
    starts = [c.start_pos for c in chunks]
    assert starts == sorted(set(starts))


def test_short_text_is_left_alone():
    assert chunking.cut_text("  tiny ") == [chunking.Chunk(0, 0, 7, "  tiny ")]


def test_cut_waits_for_the_end_of_a_formula():
    text = TEXTS["formula"]
    (region,) = chunking.math_regions(text)
    first = chunking.cut_text(text)[0]
    assert not region[0] < first.end_pos < region[1]


def test_superscript_region_covers_its_clause():
    text = "Before. So E = mc² + k here! After"
    assert [text[a:b] for a, b in chunking.math_regions(text)] == [" So E = mc² + k here"]


def test_overlapping_formulas_merge():
    assert chunking.math_regions("a $$x$$ b \\(y\\) c") == [(2, 7), (10, 15)]


def test_first_region_at_matches_a_scan():
    spans = [(0, 5), (2, 20), (4, 6), (30, 31), (30, 40)]
    regions = chunking.Regions(spans)
    for position in range(45):
        scan = next((s for s in sorted(spans) if s[0] <= position <= s[1]), None)
        assert regions.first_at(position) == scan


def test_null_text_becomes_an_error_row(spark):
    docs = spark.createDataFrame([(1, None), (2, "fine")], "doc_id int, text string")
    rows = {r["doc_id"]: r for r in ingest.chunk_documents(docs).collect()}
    assert rows[1]["error"] == "no text" and rows[2]["text"] == "fine" and rows[2]["error"] is None
    assert ingest.failures(ingest.chunk_documents(docs)).collect()[0]["doc_id"] == 1


def test_front_matter(spark):
    text = "---\ntitle: \"A: b\"\ngrade: 10\ntitle: 'last'\nplain\n---\n body --- here "
    df = spark.createDataFrame([(text,), ("--- no end",), ("plain",)], "t string")
    meta, body = chunking.front_matter(F.col("t"))
    rows = df.select(meta.alias("m"), body.alias("b")).collect()
    assert rows[0]["m"] == {"grade": "10", "title": "last"} and rows[0]["b"] == "body --- here"
    assert rows[1]["m"] == {} and rows[1]["b"] == "--- no end" and rows[2]["b"] == "plain"


def test_a_batch_is_answered_in_pieces(spark, monkeypatch):
    texts = [None if i % 7 == 3 else "" if i % 7 == 5 else f"Sentence {i}. " * (i * 9) for i in range(40)]
    monkeypatch.setattr(chunking, "PIECE_CHARS", 3000)
    sizes = [chunking.CHUNK_SIZE, chunking.OVERLAP, chunking.MIN_CHUNK]
    pieces = list(chunking.cut_batches(iter([pd.Series(texts[:25], dtype=object), pd.Series(texts[25:], dtype=object)]), *sizes))
    assert len(pieces) > 10 and sum(map(len, pieces)) == 40
    for piece in pieces:
        assert sum(len(c["text"]) for made in piece if made for c in made) < 3000 + 2 * 40 * 9 * 12
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").coalesce(1)
    got = {r["i"]: r["c"] and [tuple(c) for c in r["c"]] for r in df.select("i", chunking.chunks_of(F.col("t")).alias("c")).collect()}
    assert got == {i: None if t is None else [tuple(c) for c in chunking.cut_text(t)] for i, t in enumerate(texts)}
