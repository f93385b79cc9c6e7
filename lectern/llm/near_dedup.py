"""Near-duplicate documents: banded MinHash, sequential Bayesian pruning, exact verification.

Equal shingle sets are one class, whatever the size of their group; everything
after that works on one representative per class. Bands of the signatures give
candidates. A candidate's signatures are compared a batch at a time, and it is
dropped as soon as the posterior probability of reaching the threshold falls
below ``miss``; what survives is checked on the full sets.

Buckets of up to ``SMALL`` classes give their pairs, at most a constant per class, to
a join. A larger one is compared inside tasks, a block of bounded bytes against
another, and hands on only links that join two components of what it has seen: a group
of thousands of near copies gives a chain of links, not its pairs. Components follow
from the links of all buckets, so no link that the bands show is lost.

Defined results: a null or empty text, or one of white space only, has an empty
set, links with nothing and is its own class. Rows that repeat a doc_id are kept;
a null doc_id is linked with nothing and kept. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.components import connected_components
from lectern.llm.storage import stored
from lectern.llm.words import Words, mix, pieces

SHINGLE = 5
BANDS, ROWS = 32, 6
HASHES = BANDS * ROWS
BATCH = 32
BLOCK_BYTES = 32 << 20
TEXT_BYTES = 512 << 10
SMALL = 32

_MULTIPLY = np.random.default_rng(77).integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(words: Words) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    starts, texts = words.windows(SHINGLE)
    hashes = words.runs(starts, SHINGLE)
    bounds = np.searchsorted(texts, np.arange(len(words.counts) + 1))
    short = np.flatnonzero((words.counts > 0) & (words.counts < SHINGLE))
    whole = dict(zip(short, words.runs(words.first[short], words.counts[short])))
    for i in range(len(words.counts)):
        yield np.array([whole[i]], np.uint64) if i in whole else np.unique(hashes[bounds[i]: bounds[i + 1]])


def signature(shingles: np.ndarray) -> np.ndarray:
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 512):
        np.minimum(least, (shingles[at: at + 512, None] * _MULTIPLY).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def fewest_matches(threshold: float, miss: float) -> np.ndarray:
    """By number of hashes compared: the fewest matches at which a pair is kept.

    With a uniform prior the posterior of the similarity after m matches of n is
    Beta(m + 1, n - m + 1), and P(similarity >= t) is the chance of at most m
    successes in n + 1 draws with probability t.
    """
    least = np.zeros(HASHES + 1, np.int64)
    for n in range(1, HASHES + 1):
        chance = np.array([1.0])
        for _ in range(n + 1):
            chance = np.convolve(chance, [1 - threshold, threshold])
        least[n] = np.searchsorted(np.cumsum(chance), miss)
    return least


def posterior_keeps(a: np.ndarray, b: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of the signatures survive, and their matches; dropped rows are compared no further."""
    alive, matches = np.arange(len(b)), np.zeros(len(b), np.int64)
    for at in range(0, HASHES, BATCH):
        mine = a[at: at + BATCH] if a.ndim == 1 else a[alive, at: at + BATCH]
        matches[alive] += (mine == b[alive, at: at + BATCH]).sum(axis=1)
        alive = alive[matches[alive] >= least[at + BATCH]]
        if not len(alive):
            break
    return alive, matches


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, digest of the set (null if empty) and MinHash signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, limit=TEXT_BYTES):
            sets = list(shingle_sets(Words(batch.column(1), lower=True)))
            yield pa.record_batch({
                "doc_id": batch.column(0),
                "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                "digest": pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                "sig": pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary()),
            })

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, digest binary, sig binary")


def band_members(reps: DataFrame) -> DataFrame:
    """(key, rep, m, bytes) for every band key that several classes share, with their number and the bytes of their sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.stack([np.frombuffer(s, np.uint32) for s in batch.column(2).to_pylist()])
            key = np.tile(np.arange(BANDS, dtype=np.uint64), (len(sig), 1))
            for r in range(ROWS):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, r::ROWS].astype(np.uint64))
            repeat = lambda c: pa.array(np.repeat(batch.column(c).to_numpy(zero_copy_only=False), BANDS))
            yield pa.record_batch({"key": pa.array(key.ravel().view(np.int64)), "rep": repeat(0), "n_shingles": repeat(1)})

    bands = reps.select("rep", "n_shingles", "sig").mapInArrow(run, "key long, rep long, n_shingles long")
    weight = F.sum(F.col("n_shingles") * 8 + 4 * HASHES)
    shared = bands.groupBy("key").agg(F.count(F.lit(1)).alias("m"), weight.alias("bytes")).where("m > 1")
    return bands.join(shared, "key")


def class_sets(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """The full shingle set of each of ``reps``, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, limit=TEXT_BYTES):
            sets = shingle_sets(Words(batch.column(1), lower=True))
            digest, packed = [], []
            for s in sets:
                packed.append(s.tobytes())
                digest.append(hashlib.blake2b(packed[-1], digest_size=16).digest())
            yield pa.record_batch({"rep": batch.column(0), "digest": pa.array(digest, pa.binary()), "shingles": pa.array(packed, pa.binary())})

    wanted = reps.select(F.col("rep").alias("doc_id"))
    own = docs.select(F.col("doc_id").cast("long"), "text").join(wanted, "doc_id", "left_semi")
    sets = own.mapInArrow(run, "rep long, digest binary, shingles binary")
    # Where a doc_id repeats, the text that stands for the class is the one with its digest.
    return sets.join(reps.select("rep", "digest"), ["rep", "digest"]).dropDuplicates(["rep"]).select("rep", "shingles")


def _pair_columns(pairs: DataFrame, of: DataFrame, columns: list[str]) -> DataFrame:
    for side in ("a", "b"):
        pairs = pairs.join(of.select(F.col("rep").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns]), side)
    return pairs


def verified(pairs: DataFrame, reps: DataFrame, sets: DataFrame, percent: int, miss: float) -> DataFrame:
    """The pairs (a, b) that are links: pruned by signatures in batches, then compared on full sets."""
    least = fewest_matches(percent / 100, miss)

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.stack([np.frombuffer(s, np.uint32) for s in batch.column(i).to_pylist()]) for i in (2, 3))
                alive, _ = posterior_keeps(a, b, least)
                yield batch.select([0, 1]).take(pa.array(alive))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                a, b = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    near = _pair_columns(pairs, reps, ["n_shingles", "sig"]).where(
        100 * F.least("n_shingles_a", "n_shingles_b") >= percent * F.greatest("n_shingles_a", "n_shingles_b")
    )
    near = near.select("a", "b", "sig_a", "sig_b").mapInArrow(prune, "a long, b long")
    return _pair_columns(near, sets, ["shingles"]).select("a", "b", "shingles_a", "shingles_b").mapInArrow(exact, "a long, b long")


def small_bucket_pairs(members: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) in buckets of up to ``SMALL`` members: at most a constant per member."""
    small = members.where(F.col("m") <= SMALL).select("key", "rep", "n_shingles")
    other = small.select("key", F.col("rep").alias("rep_b"), F.col("n_shingles").alias("n_b"))
    return small.join(other, "key").where("rep < rep_b").where(
        100 * F.least("n_shingles", "n_b") >= percent * F.greatest("n_shingles", "n_b")
    ).select(F.col("rep").alias("a"), F.col("rep_b").alias("b")).distinct()


def joining_links(asks: pd.DataFrame, rest: pd.DataFrame, percent: int, least: np.ndarray) -> list[tuple[int, int]]:
    """Links that join components: of each row of ``asks`` with the rows of ``rest``, the likeliest candidates first.

    Components grow as links are found, so rows that are joined already are not compared again.
    """
    sig = np.stack([np.frombuffer(s, np.uint32) for s in rest["sig"]])
    sets = [np.frombuffer(s, np.uint64) for s in rest["shingles"]]
    rep, size = (rest[c].to_numpy() for c in ("rep", "n_shingles"))
    # A row's label is the rep of its component that came first.
    label, label_asks = rep.copy(), asks["rep"].to_numpy().copy()
    found = []
    for k, (a, n, s, own) in enumerate(zip(asks["rep"], asks["n_shingles"], asks["sig"], asks["shingles"])):
        own = np.frombuffer(own, np.uint64)
        at = np.flatnonzero((label != label_asks[k]) & (100 * np.minimum(size, n) >= percent * np.maximum(size, n)))
        alive, matches = posterior_keeps(np.frombuffer(s, np.uint32), sig[at], least)
        todo = at[alive[np.argsort(-matches[alive], kind="stable")]]
        while len(todo):
            some, todo = todo[:32], todo[32:]
            every = np.concatenate([sets[b] for b in some])
            place = np.minimum(np.searchsorted(own, every), len(own) - 1)
            both = np.add.reduceat(own[place] == every, np.r_[0, np.cumsum(size[some])[:-1]], dtype=np.int64)
            for b in some[100 * both >= percent * (n + size[some] - both)]:
                if label[b] != label_asks[k]:
                    found.append((min(a, rep[b]), max(a, rep[b])))
                    gone, stays = label[b], label_asks[k]
                    label[label == gone] = stays
                    label_asks[label_asks == gone] = stays
            todo = todo[label[todo] != label_asks[k]]
    return found


def large_bucket_links(members: DataFrame, reps: DataFrame, sets: DataFrame, percent: int, miss: float) -> DataFrame:
    """Links (a, b) in larger buckets: blocks of bounded bytes, each against itself and those before it."""
    least = fewest_matches(percent / 100, miss)
    held = members.where(F.col("m") > SMALL).withColumn("n", F.ceil(F.col("bytes") / BLOCK_BYTES).cast("int"))
    held = held.withColumn("at", F.pmod(F.xxhash64("rep"), "n").cast("int")).join(reps.select("rep", "sig"), "rep").join(sets, "rep")
    # A row of block x asks in the groups (x, 0), ..., (x, x) and is asked in (x, x), ..., (n - 1, x).
    asks = F.transform(F.sequence(F.lit(0), F.col("at")), lambda j: F.struct(F.col("at").alias("i"), j.alias("j"), F.lit(True).alias("asks")))
    asked = F.transform(F.sequence(F.col("at"), F.col("n") - 1), lambda i: F.struct(i.alias("i"), F.col("at").alias("j"), F.lit(False).alias("asks")))
    rows = held.select("key", "rep", "n_shingles", "sig", "shingles", F.explode(F.concat(asks, asked)).alias("g")).select("*", "g.*").drop("g")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rep", ignore_index=True)
        left, right = group[group["asks"]], group[~group["asks"]]
        found = joining_links(left, right, percent, least) if len(left) and len(right) else []
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    return rows.groupBy("key", "i", "j").applyInPandas(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, percent: int = 85, miss: float = 1e-6) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of (doc_id, text).

    Links join documents with 100 * intersection >= percent * union of their sets of
    five-word shingles. A link at the threshold shares no band with probability below
    3e-7 at 85 percent; ``miss`` bounds the loss in pruning by posterior similarity.
    """
    sketch = stored(sketches(docs), "sketches")
    # One row per class; partial aggregation meets a large group of copies before the shuffle.
    reps = sketch.where("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest").agg(F.min(F.struct("doc_id", "n_shingles", "sig")).alias("r"))
    reps = stored(reps.select(F.col("r.doc_id").alias("rep"), F.col("r.n_shingles"), "digest", F.col("r.sig")), "classes")
    members = stored(band_members(reps), "bands")
    sets = stored(class_sets(docs, reps.join(members.select("rep").distinct(), "rep", "left_semi")), "sets")

    pairs = stored(small_bucket_pairs(members, percent), "pairs")
    links = verified(pairs, reps, sets, percent, miss).unionByName(large_bucket_links(members, reps, sets, percent, miss))
    labels = connected_components(links).select(F.col("node").alias("rep"), F.col("component").alias("label"))
    by_class = reps.join(labels, "rep", "left").select(F.col("digest").alias("d"), F.coalesce("label", "rep").alias("label"))
    joined = sketch.drop("sig").join(by_class, (F.col("digest") == F.col("d")) & F.col("doc_id").isNotNull(), "left")
    component = F.coalesce("label", "doc_id")
    return joined.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def op7_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{folder}/documents.parquet"))


ORACLE_SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
         WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM split
), shingles AS (
  SELECT doc_id, unnest(s) AS s FROM sets
), pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b WHERE 100 * n >= 85 * (len(x.s) + len(y.s) - n)
), sides AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reach(a, b) AS (
  SELECT a, b FROM sides UNION SELECT reach.a, sides.b FROM reach JOIN sides ON reach.b = sides.a
), least AS (
  SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a
)
SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, doc_id <= coalesce(m, doc_id) AS kept
FROM sets LEFT JOIN least USING (doc_id)
"""
