"""Byte-level BPE by recursive DuckDB queries inside Spark tasks.

A text is cut by the vocabulary's pattern. Each distinct piece that is not itself a
token becomes rows of token positions that join the merge table; every step of the
recursion contracts the leftmost pair of least rank of each word, and a word leaves
when no pair is left. Long words contract in all their parts at once: a pair goes when it is
the least within the bytes that a token can span, so that what happens further off cannot
change it, and all places of a pair go together where no merge with the new token ranks before it.
The recursion of long words hands on its last state after some turns and starts anew, so memory is bounded by
the word and not by its turns.
Decoding joins ids with the vocabulary and concatenates in order of position.

A task works on pieces of about 2 MB of text. Words that it has met lately
are not encoded again: up to ``REMEMBER`` of them, then it starts anew; results do
not depend on that. The database and these words are given back when a task ends; a worker keeps the rank file and its
merge table.

Defined results: a null or empty text has no ids and decodes to the empty text;
texts that hold the strings of special tokens are ordinary text; repeated rows and
null doc_ids are kept; no rows give no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.words import pieces

LONG = 64
REMEMBER = 1 << 19
# Rows of a long word that a recursion may hold: so many turns are done in one query, then its last rows start the next.
TURN_ROWS = 1 << 20
SEARCHED = 1 << 22
# Nothing is written to the worker's folder: a task that needs more than its limit fails.
DUCKDB = {"threads": 1, "memory_limit": "512MB", "temp_directory": ""}

SHORT_WORDS = """
WITH RECURSIVE step(turn, word, ids) AS (
  SELECT 0, word, ids FROM start
  UNION ALL
  (WITH pairs AS (SELECT word, unnest(ids) AS a, unnest(ids[2:]) AS b, unnest(range(1, len(ids) + 1)) AS place FROM step),
        best AS (SELECT pairs.word, min((merges.id::BIGINT << 24) | place) AS k
                 FROM pairs JOIN merges ON merges.pair = (a::BIGINT << 24) | b GROUP BY pairs.word)
   SELECT turn + 1, step.word, ids[:(k & 16777215) - 1] || [(k >> 24)::INT] || ids[(k & 16777215) + 2:]
   FROM step JOIN best ON best.word = step.word)
), final AS (SELECT word, max(turn) AS turn FROM step GROUP BY word)
SELECT word, array_to_string(ids, ' ') AS ids FROM step JOIN final USING (word, turn)
"""

# Rows are linked: ``next`` is the place (first byte) of the following token. A pair goes if no pair of lower rank lies so
# near that a token grown from there could reach it; places further off cannot meet, since a token has at most $reach bytes.
# Of pairs that overlap, every second one counts, from the start of their run on. Only the last turn's rows leave the query.
LONG_WORDS = """
WITH RECURSIVE step(turn, word, place, next, id) AS (
  SELECT 0, word, place, next, id FROM held
  UNION ALL
  (WITH pairs AS (SELECT a.word, a.place, b.place AS second, b.next, merges.id, merges.alone
                  FROM step a JOIN step b ON b.place = a.next JOIN merges ON merges.pair = (a.id::BIGINT << 24) | b.id
                  WHERE a.turn < $turns),
        near AS (SELECT *, min(id) OVER w AS least, min(place) OVER (PARTITION BY word, id ORDER BY place RANGE BETWEEN $reach PRECEDING AND CURRENT ROW) AS earlier,
                        coalesce(lag(second) OVER o <> place OR lag(id) OVER o <> id, true) AS fresh, row_number() OVER o AS n
                 FROM pairs WINDOW w AS (PARTITION BY word ORDER BY place RANGE BETWEEN $reach PRECEDING AND $after FOLLOWING), o AS (PARTITION BY word ORDER BY place)),
        runs AS (SELECT *, max(CASE WHEN fresh THEN n END) OVER (PARTITION BY word ORDER BY place ROWS UNBOUNDED PRECEDING) AS run FROM near),
        open AS (SELECT *, first(id = least) OVER (PARTITION BY word, run ORDER BY place) AS led FROM runs),
        taken AS (SELECT word, place, second, next, id FROM open
                  WHERE id = least AND led AND CASE WHEN alone THEN n = run AND earlier = place ELSE (n - run) % 2 = 0 END)
   SELECT turn + 1, s.word, s.place, CASE WHEN t.place IS NULL THEN s.next ELSE t.next END, coalesce(t.id, s.id)
   FROM step s SEMI JOIN taken k ON k.word = s.word LEFT JOIN taken t ON t.place = s.place ANTI JOIN taken d ON d.second = s.place)
), final AS (SELECT word, max(turn) AS turn FROM step GROUP BY word)
SELECT turn, word, place, next, id FROM step JOIN final USING (word, turn)
"""

SPELT = "SELECT word, string_agg(id::VARCHAR, ' ' ORDER BY place) AS ids FROM done GROUP BY word"

DECODE = """
SELECT doc, unhex(string_agg(hex, '' ORDER BY place)) AS raw FROM tokens JOIN vocabulary USING (id) GROUP BY doc
"""


class Codec:
    """Encoder and decoder of one rank file, held by a Python worker. Leaving a ``with``, a task gives back its database and words."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.pattern = regex.compile(pattern)
        self.known: dict[str, str] = {}
        self.db = None
        self.bytes = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.tokens = sorted(self.ranks, key=len, reverse=True)
        found = [
            (a, b, rank) for token, rank in self.ranks.items() for k in range(1, len(token))
            if (a := self.ranks.get(token[:k])) is not None and (b := self.ranks.get(token[k:])) is not None
        ]
        a, b, rank = np.array(found, np.int64).reshape(-1, 3).T
        # ``alone``: a token that can merge on before its own rank, so its places must be taken one by one.
        least = np.full(max(self.ranks.values()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, a, rank)
        np.minimum.at(least, b, rank)
        self.merges = pa.table({"pair": a << 24 | b, "id": rank.astype(np.int32), "alone": least[rank] < rank})

    def __enter__(self) -> Codec:
        return self

    def __exit__(self, *_) -> None:
        if self.db is not None:
            self.db.close()
        self.db, self.known = None, {}

    def _open(self) -> duckdb.DuckDBPyConnection:
        db = duckdb.connect(config=DUCKDB)
        vocabulary = pa.table({"id": np.array(list(self.ranks.values()), np.int32), "hex": [t.hex() for t in self.ranks]})
        for name, rows in (("merges", self.merges), ("vocabulary", vocabulary)):
            db.register("given", rows)
            db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            db.unregister("given")
        return db

    def _ask(self, sql: str, name: str, rows: pa.Table) -> pa.Table:
        self.db = self.db or self._open()
        self.db.register(name, rows)
        out = self.db.sql(sql).to_arrow_table()
        self.db.unregister(name)
        return out

    def learn(self, words: set[str]) -> None:
        """Encodes words that are not known yet."""
        if len(self.known) + len(words) > REMEMBER:
            self.known.clear()
        short, long = [], []
        for word in words:
            raw = word.encode()
            rank = self.ranks.get(raw)
            if rank is not None:
                self.known[word] = str(rank)
            else:
                (short if len(raw) <= LONG else long).append((word, raw))
        for some, sql in ((short, SHORT_WORDS), (long, LONG_WORDS)):
            if not some:
                continue
            data = self.bytes[np.frombuffer(b"".join(raw for _, raw in some), np.uint8)]
            size = np.array([len(raw) for _, raw in some])
            end = np.cumsum(size)
            if sql is SHORT_WORDS:
                start = {"word": np.arange(len(some)), "ids": pa.ListArray.from_arrays(pa.array(np.r_[0, end], pa.int32()), pa.array(data))}
            else:
                last = np.zeros(len(data), bool)
                last[end - 1] = True
                start = {
                    "word": np.repeat(np.arange(len(some)), size), "place": np.arange(len(data)),
                    "next": pa.array(np.arange(1, len(data) + 1), mask=last), "id": data,
                }
            out = self._ask(sql, "start", pa.table(start)) if sql is SHORT_WORDS else self._contract(pa.table(start), self._reach(b"".join(raw for _, raw in some)))
            for word, ids in zip(out.column("word").to_pylist(), out.column("ids").to_pylist()):
                self.known[some[word][0]] = ids

    def _reach(self, raw: bytes) -> int:
        """Bytes of the longest token that words made of these bytes could grow; of shorter words, that they hold."""
        present = bytes(set(raw))
        return next(len(t) for t in self.tokens if not t.translate(None, present) and (len(raw) > SEARCHED or t in raw))

    def _contract(self, rows: pa.Table, reach: int) -> pa.Table:
        """Ids of long words from rows of (word, place, next, id), some turns a query."""
        done = []
        while rows.num_rows:
            turns = max(1, min(64, TURN_ROWS // rows.num_rows))
            sql = LONG_WORDS.replace("$turns", str(turns)).replace("$reach", str(reach)).replace("$after", str(2 * reach))
            out = self._ask(sql, "held", rows)
            ended = pc.less(out.column("turn"), turns)
            done.append(out.filter(ended).drop_columns(["turn"]))
            rows = out.filter(pc.invert(ended)).drop_columns(["turn"])
        return self._ask(SPELT, "done", pa.concat_tables(done))

    def encode(self, texts: list[str]) -> list[str]:
        """The ids of each text as decimal numbers joined by one space."""
        cut = [self.pattern.findall(text) for text in texts]
        new = set()
        for words in cut:
            new.update(words)
        missing = new - self.known.keys()
        if missing:
            if len(self.known) + len(missing) > REMEMBER:
                missing = new
            self.learn(missing)
        return [" ".join(map(self.known.__getitem__, words)) for words in cut]

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The bytes of each text, whose ids follow one another."""
        tokens = pa.table({"doc": np.repeat(np.arange(len(counts)), counts), "place": np.arange(len(ids)), "id": ids})
        out = self._ask(DECODE, "tokens", tokens)
        raw = [b""] * len(counts)
        for doc, data in zip(out.column("doc").to_pylist(), out.column("raw").to_pylist()):
            raw[doc] = data
        return raw


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def parsed(ids: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, and how many each has."""
    counts = np.array([i.count(" ") + 1 if i else 0 for i in ids], np.int64)
    return np.fromstring(" ".join(filter(None, ids)), np.int32, sep=" "), counts


def default_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def _texts(batch: pa.RecordBatch) -> list[str]:
    return pc.fill_null(batch.column(batch.schema.get_field_index("text")), "").to_pylist()


def _map(df: DataFrame, files: tuple[str, str], fn: Callable[[Codec, pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with codec(*files) as own:
            for batch in pieces(batches):
                yield fn(own, batch)

    return df.mapInArrow(run, schema)


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids): the ids of each whole text, as an array."""
    files = path or default_files()[0], pattern or default_files()[1]

    def run(own: Codec, batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, counts = parsed(own.encode(_texts(batch)))
        return pa.record_batch({
            "doc_id": batch.column(0), "n_tokens": pa.array(counts),
            "ids": pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(ids, pa.int32())),
        })

    return _map(docs.select(F.col("doc_id").cast("long"), "text"), files, run, "doc_id long, n_tokens long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, raw): the bytes that the ids of each row stand for."""
    files = path or default_files()[0], pattern or default_files()[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with codec(*files) as own:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    counts = pc.fill_null(pc.list_value_length(part.column(1)), 0).to_numpy(zero_copy_only=False)
                    ids = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int32)
                    yield pa.record_batch({"doc_id": part.column(0), "raw": pa.array(own.decode(ids, counts), pa.binary())})

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, raw binary")


def round_trip(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each whole text encoded, and its ids decoded, in one pass."""
    files = path or default_files()[0], pattern or default_files()[1]

    def run(own: Codec, batch: pa.RecordBatch) -> pa.RecordBatch:
        told = own.encode(_texts(batch))
        ids, counts = parsed(told)
        raw = own.decode(ids, counts)
        return pa.record_batch({
            "doc_id": batch.column(0), "n_tokens": pa.array(counts),
            "ids_sha256": pa.array([hashlib.sha256(i.encode()).hexdigest() for i in told], pa.string()),
            "decoded_sha256": pa.array([hashlib.sha256(r).hexdigest() for r in raw], pa.string()),
        })

    return _map(docs.select(F.col("doc_id").cast("long"), "text"), files, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{folder}/documents.parquet"))
