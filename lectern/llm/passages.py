"""Passages that repeat across documents, by level-wise doubling.

Level 1 looks at windows of half the wanted length (rounded up), and of those only
at the anchors: the window of least hash among those inside each wanted window.
Equal wanted windows have equal anchors, so a wanted window whose anchor occurs in
one document alone cannot repeat. A window repeated at one level is extended to
twice its length (at the first step, to the wanted length), and looked at again
only if its first and its last part were repeated; levels go on until nothing
repeats, or until the length that the caller asks for.

Documents are packed into pieces of about 2 MB, written once. Per level a piece
names each distinct window once, whatever the number of documents that share it,
and hands its hashes to the hash buckets; a bucket answers with the windows that
occur in several documents and the smallest document of each. The number of
buckets follows the size of the text, so a bucket and a piece each fit a task.

Windows are compared by 64-bit hashes. Defined results: a null text has no words;
a null doc_id neither starts a repeat nor loses words; rows that repeat a doc_id
are kept, and windows they share are no repeats. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.storage import stored
from lectern.llm.words import Words, pieces

BUCKET_BYTES = 2 << 20
ENTRIES = "bucket int, piece long, hashes binary, firsts binary, several binary"
ANSWERS = "piece long, hashes binary, firsts binary"


def pack(docs: DataFrame) -> DataFrame:
    """Documents in pieces: piece, doc_ids, sizes (bytes of each text), chars and the compressed texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        for n, batch in enumerate(pieces(batches)):
            texts = pc.fill_null(batch.column(1), "")
            raw = "".join(texts.to_pylist()).encode()
            yield pa.record_batch({
                "piece": pa.array([at + n], pa.int64()),
                "doc_ids": pa.array([batch.column(0).to_pylist()], pa.list_(pa.int64())),
                "sizes": pa.array([pc.binary_length(texts).to_pylist()], pa.list_(pa.int64())),
                "bytes": pa.array([len(raw)], pa.int64()),
                "packed": pa.array([pa.compress(raw, "zstd", asbytes=True)], pa.binary()),
            })

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "piece long, doc_ids array<long>, sizes array<long>, bytes long, packed binary"
    )


def unpack(piece: dict) -> tuple[list, np.ndarray, Words]:
    """Document ids, the ids with null as the largest number, and the words."""
    raw = pa.decompress(piece["packed"], piece["bytes"], "zstd", asbytes=True) if piece["bytes"] else b""
    at = np.concatenate([[0], np.cumsum(piece["sizes"])]).astype(np.int64)
    texts = pa.Array.from_buffers(pa.large_string(), len(piece["sizes"]), [None, pa.py_buffer(at), pa.py_buffer(raw)])
    ids = np.array([np.iinfo(np.int64).max if i is None else i for i in piece["doc_ids"]], np.int64)
    return piece["doc_ids"], ids, Words(texts)


def find(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Place of each value in a sorted table, -1 where it is missing."""
    if not len(table):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return np.where(table[at] == values, at, -1)


def anchors(words: Words, length: int, part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the windows of ``length`` words, the start of the anchor of each, and its hash."""
    start, _ = words.windows(length)
    small, _ = words.windows(part)
    if not len(start):
        return start, start, np.zeros(0, np.uint64)
    hashes = words.runs(small, part)
    place = np.full(len(words.start), -1)
    place[small] = np.arange(len(small))
    first = place[start]
    least, best = hashes[first], first
    for k in range(1, length - part + 1):
        now = hashes[first + k]
        less = now < least
        least, best = np.where(less, now, least), np.where(less, first + k, best)
    return start, small[best], least


def entries(piece: int, ids: np.ndarray, text: np.ndarray, hashes: np.ndarray, buckets: int) -> Iterator[dict]:
    """One entry per distinct window of a piece, by bucket: its smallest document, and whether it has others."""
    known = ids[text] != np.iinfo(np.int64).max
    hashes, docs = hashes[known], ids[text[known]]
    order = np.argsort(hashes, kind="stable")
    hashes, docs = hashes[order], docs[order]
    at = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]]) if len(hashes) else np.zeros(0, np.int64)
    if not len(at):
        return
    firsts, lasts = np.minimum.reduceat(docs, at), np.maximum.reduceat(docs, at)
    hashes, several = hashes[at], (firsts != lasts).astype(np.uint8)
    bucket = ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
    for i, j in zip(cut[:-1], cut[1:]):
        base = int(firsts[i:j].min())
        off = firsts[i:j] - base
        kind = np.uint16 if off.max() < 1 << 16 else np.uint32 if off.max() < 1 << 32 else np.int64
        yield {
            "bucket": int(bucket[i]), "piece": piece, "hashes": hashes[i:j].tobytes(),
            "firsts": base.to_bytes(8, "little", signed=True) + off.astype(kind).tobytes(), "several": np.packbits(several[i:j]).tobytes(),
        }


def answer(group: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket: for each piece, its windows that occur in several documents, and the smallest of these."""
    hashes = [np.frombuffer(h, np.uint64) for h in group["hashes"]]
    n = np.array([len(h) for h in hashes])
    firsts = []
    for raw, k in zip(group["firsts"], n):
        kind = {2: np.uint16, 4: np.uint32, 8: np.int64}[(len(raw) - 8) // k]
        firsts.append(int.from_bytes(raw[:8], "little", signed=True) + np.frombuffer(raw[8:], kind).astype(np.int64))
    several = np.concatenate([np.unpackbits(np.frombuffer(s, np.uint8))[:k] for s, k in zip(group["several"], n)])
    every, first = np.concatenate(hashes), np.concatenate(firsts)
    value, inverse = np.unique(every, return_inverse=True)
    least = np.full(len(value), np.iinfo(np.int64).max)
    np.minimum.at(least, inverse, first)
    most = np.full(len(value), np.iinfo(np.int64).min)
    np.maximum.at(most, inverse, first)
    repeated = least != most
    repeated[inverse[several.astype(bool)]] = True
    keep, cut = repeated[inverse], np.cumsum(n)
    out = []
    for piece, i, j in zip(group["piece"], np.r_[0, cut[:-1]], cut):
        k = keep[i:j]
        if k.any():
            out.append((piece, every[i:j][k].tobytes(), least[inverse[i:j][k]].tobytes()))
    return pd.DataFrame(out, columns=["piece", "hashes", "firsts"])


def gathered(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """A piece's answers from all buckets, sorted by hash."""
    hashes = np.frombuffer(b"".join(table.column("hashes").to_pylist()), np.uint64)
    firsts = np.frombuffer(b"".join(table.column("firsts").to_pylist()), np.int64)
    order = np.argsort(hashes)
    return hashes[order], firsts[order]


def _with_answers(packed: DataFrame, answers: DataFrame, fn: Callable[[dict, tuple], pa.Table], schema: str) -> DataFrame:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = gathered(right)
        return pa.concat_tables([fn(piece, found) for piece in left.to_pylist()]) if left.num_rows else _table([], schema)

    return packed.groupBy("piece").cogroup(answers.groupBy("piece")).applyInArrow(run, schema)


_KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}


def _table(rows: list[dict], schema: str) -> pa.Table:
    fields = [part.strip().split(" ") for part in schema.split(",")]
    return pa.Table.from_pylist(rows, schema=pa.schema([(name, _KINDS[kind]) for name, kind in fields]))


def repeats(packed: DataFrame, length: int, until: int | None = None) -> Iterator[tuple[int, DataFrame]]:
    """Length and answers of each level from ``length`` on, as long as windows repeat, up to ``until``."""
    total = packed.agg(F.sum("bytes")).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_BYTES))
    part = -(-length // 2)

    def anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in batch.to_pylist():
                _, ids, words = unpack(piece)
                _, at, least = anchors(words, length, part)
                at, where = np.unique(at, return_index=True)
                text = np.searchsorted(words.first, at, "right") - 1
                yield from _table(list(entries(piece["piece"], ids, text, least[where], buckets)), ENTRIES).to_batches()

    asked = packed.mapInArrow(anchored, ENTRIES)
    answers = stored(asked.groupBy("bucket").applyInPandas(answer, ANSWERS), "anchors")

    def wanted(piece: dict, found: tuple) -> pa.Table:
        _, ids, words = unpack(piece)
        start, _, least = anchors(words, length, part)
        start = start[find(found[0], least) >= 0]
        text = np.searchsorted(words.first, start, "right") - 1
        return _table(list(entries(piece["piece"], ids, text, words.runs(start, length), buckets)), ENTRIES)

    asked = _with_answers(packed, answers, wanted, ENTRIES)
    while True:
        answers = stored(asked.groupBy("bucket").applyInPandas(answer, ANSWERS), "windows")
        if not answers.limit(1).count():
            return
        yield length, answers
        if until is not None and 2 * length > until:
            return
        now = length

        def doubled(piece: dict, found: tuple, now: int = now) -> pa.Table:
            _, ids, words = unpack(piece)
            start, _ = words.windows(now)
            hit = np.zeros(len(words.start) + now, bool)
            hit[start[find(found[0], words.runs(start, now)) >= 0]] = True
            start, text = words.windows(2 * now)
            both = hit[start] & hit[start + now]
            start, text = start[both], text[both]
            return _table(list(entries(piece["piece"], ids, text, words.runs(start, 2 * now), buckets)), ENTRIES)

        asked = _with_answers(packed, answers, doubled, ENTRIES)
        length *= 2


def covered(words: Words, ids: np.ndarray, found: tuple, length: int) -> np.ndarray:
    """Which words lie in a window that also starts in a smaller document."""
    start, text = words.windows(length)
    at = find(found[0], words.runs(start, length))
    gone = start[(at >= 0) & (found[1][at] < ids[text]) & (ids[text] != np.iinfo(np.int64).max)] if len(found[0]) else start[:0]
    edge = np.zeros(len(words.start) + 1, np.int64)
    np.add.at(edge, gone, 1)
    np.add.at(edge, gone + length, -1)
    return np.cumsum(edge)[:-1] > 0


def kept_texts(words: Words, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the kept words of all texts, a space behind each, and where each text ends in them."""
    keep = ~gone
    start, size = words.start[keep], (words.end - words.start)[keep] + 1
    end = np.cumsum(size)
    source = np.repeat(start - (end - size), size) + np.arange(end[-1] if len(end) else 0)
    out = np.r_[words.data, np.uint8(32)][source]
    out[end - 1] = 32
    return out, np.r_[0, end][np.r_[0, np.cumsum(keep)][words.first]]


DEDUPED = "doc_id long, n_words long, n_removed long, text string"


def remove_repeats(docs: DataFrame, length: int = 13, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words joined by one space (``digest``: their SHA-256).

    Removes each word covered by a window of ``length`` words that also starts in
    a document with a smaller doc_id; windows are judged on the input.
    """
    packed = stored(pack(docs), "pieces")
    answers = next((a for _, a in repeats(packed, length, until=length)), packed.sparkSession.createDataFrame([], ANSWERS))

    def apply(piece: dict, found: tuple) -> pa.Table:
        given, ids, words = unpack(piece)
        gone = covered(words, ids, found, length)
        out, ends = kept_texts(words, gone)
        lost = np.diff(np.r_[0, np.cumsum(gone)][words.first])
        rows = []
        for i, doc in enumerate(given):
            text = out[ends[i]: max(ends[i], ends[i + 1] - 1)].tobytes()
            rows.append({
                "doc_id": doc, "n_words": int(words.counts[i]), "n_removed": int(lost[i]),
                "text": hashlib.sha256(text).hexdigest() if digest else text.decode(),
            })
        return _table(rows, DEDUPED)

    return _with_answers(packed, answers, apply, DEDUPED)


def longest_repeats(docs: DataFrame, length: int = 13) -> DataFrame:
    """(doc_id, words): the greatest of length, 2 * length, 4 * length, ... at which a window of the document repeats in another."""
    packed = stored(pack(docs), "pieces")
    found = None
    for level, answers in repeats(packed, length):

        def told(piece: dict, hits: tuple, level: int = level) -> pa.Table:
            given, _, words = unpack(piece)
            start, text = words.windows(level)
            some = np.unique(text[find(hits[0], words.runs(start, level)) >= 0])
            return _table([{"doc_id": given[i], "words": level} for i in some if given[i] is not None], "doc_id long, words long")

        here = _with_answers(packed, answers, told, "doc_id long, words long")
        found = here if found is None else found.unionByName(here)
    if found is None:
        return packed.sparkSession.createDataFrame([], "doc_id long, words long")
    return found.groupBy("doc_id").agg(F.max("words").alias("words"))


def op8_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{folder}/documents.parquet"), digest=True).withColumnRenamed("text", "kept_sha256")


ORACLE_SQL = r"""
WITH split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), words AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM split
), windows AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS run FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM split)
), firsts AS (
  SELECT run, min(doc_id) AS least FROM windows GROUP BY run
), gone AS (
  SELECT DISTINCT doc_id, i + k AS p FROM windows JOIN firsts USING (run), range(0, 13) t(k) WHERE least < doc_id
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
), lost AS (
  SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (doc_id) LEFT JOIN lost USING (doc_id)
"""
