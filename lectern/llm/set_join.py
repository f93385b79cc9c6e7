"""Exact Jaccard self-join of documents by a token-group matrix.

Equal shingle sets are one class. Classes that may have a partner are put in groups of
similar sets, neighbours in the order of their MinHash keys, up to ``MEMBERS`` sets and ``GROUP_TOKENS`` tokens
each. A group's row holds the union of its tokens and a bit matrix that says which member has
which token. A set whose overlap with the union is below what any partner must share cannot
have one in that group; only groups that reach the bound are opened, and there the matrix gives
the exact overlap with every member at once.

Which groups a set has to look at follows from an order of all tokens, common ones last: a
pair at the threshold shares k tokens among the first n - ceil(t * n) + k of each set, for any k. So the
matrix is joined on those alone, and sets that share too few with all others together never reach it. How common a token is, is counted over all documents, in 2**32
buckets of its hash; the ``COMMON`` commonest buckets are ordered by their counts, all other
tokens by their hash. The order decides the work, not the result.

Links are wanted up to the components that they join: sets linked inside their group, to the first set
of their MinHash key, or to that of two further keys are one component, and only sets of different
components look for each other. A group of thousands of near copies is joined in
a pass over it, and its pairs are never listed.

Defined results: a null or empty text, or one of white space only, has an empty set, links with nothing and is
its own component. Rows that repeat a doc_id are kept and are one node, whatever their texts; a null doc_id is
linked with nothing and its component is null. Sets are of 64-bit shingle hashes. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.components import connected_components
from lectern.llm.near_dedup import shingle_sets
from lectern.llm.storage import stored
from lectern.llm.words import Words, pieces

MEMBERS, GROUP_TOKENS = 32, 1 << 16
COMMON, COMMON_LEAST = 1 << 16, 32
RANGE_BITS, PACK_TOKENS = 10, 1 << 22
BLOCK_BYTES = 16 << 20
KEYS = 3
MORE = 15

_MULTIPLY = np.random.default_rng(131).integers(0, 1 << 63, KEYS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LONGS, _INTS = pa.list_(pa.int64()), pa.list_(pa.int32())


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, hash of the text, size and digest of the set (null if empty) and its MinHash keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sets = list(shingle_sets(Words(batch.column(1), lower=True)))
            keys = [(s[None, :] * _MULTIPLY[:, None]).min(axis=1).view(np.int64) if len(s) else np.zeros(KEYS, np.int64) for s in sets]
            yield pa.record_batch({
                "doc_id": batch.column(0), "h": batch.column(2), "n": pa.array([len(s) for s in sets], pa.int64()),
                "digest": pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                **{f"k{i}": pa.array([k[i] for k in keys], pa.int64()) for i in range(KEYS)},
            })

    columns = ", ".join(f"k{i} long" for i in range(KEYS))
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("h"))
    return rows.mapInArrow(run, f"doc_id long, h long, n long, digest binary, {columns}")


def common_buckets(docs: DataFrame) -> np.ndarray:
    """The commonest token buckets, rarest first: at most ``COMMON``, counted over all documents.

    Buckets leave a task sorted and packed, one row per range of them, and are counted a range at a
    time in an array of fixed size, so that Spark moves few rows and no table of counts grows with the corpus.
    """
    width = 32 - RANGE_BITS
    edges = np.arange(1 << RANGE_BITS, dtype=np.uint64) << np.uint64(width)

    def pack(held: list[np.ndarray]) -> pa.RecordBatch:
        buckets = np.sort(np.concatenate([*held, np.zeros(0, np.uint32)]))
        cut = np.r_[np.searchsorted(buckets, edges.astype(np.uint32)), len(buckets)]
        some = np.flatnonzero(np.diff(cut))
        return pa.record_batch({
            "part": pa.array(some.astype(np.int32)), "packed": pa.array([buckets[cut[k]: cut[k + 1]].tobytes() for k in some], pa.binary()),
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in pieces(batches):
            for tokens in shingle_sets(Words(batch.column(0), lower=True)):
                held.append((tokens >> np.uint64(32)).astype(np.uint32))
                n += len(tokens)
            if n >= PACK_TOKENS:
                yield pack(held)
                held, n = [], 0
        yield pack(held)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, counts = None, np.zeros(1 << width, np.int64)

        def common() -> pa.RecordBatch:
            often = np.flatnonzero(counts >= COMMON_LEAST)
            often = often[np.argsort(-counts[often], kind="stable")[:COMMON]]
            bucket = (often.astype(np.uint64) | np.uint64((part or 0) << width)).astype(np.uint32).view(np.int32)
            return pa.record_batch({"bucket": pa.array(bucket), "c": pa.array(counts[often])})

        for batch in batches:
            for at, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                if at != part:
                    yield common()
                    part, counts[:] = at, 0
                own, times = np.unique(np.frombuffer(packed.as_buffer(), np.uint32) & np.uint32((1 << width) - 1), return_counts=True)
                counts[own] += times
        yield common()

    packed = docs.select("text").mapInArrow(run, "part int, packed binary").repartition("part").sortWithinPartitions("part")
    top = stored(packed.mapInArrow(counted, "bucket int, c long").orderBy(F.desc("c"), "bucket").limit(COMMON), "common")
    found = [r["bucket"] for r in top.orderBy(F.desc("c"), "bucket").collect()]
    return np.array(found[::-1], np.int32).view(np.uint32)


def prefix(tokens: np.ndarray, percent: int, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first n - ceil(t * n) + k of the sorted ``tokens``, common ones last; k is ``MORE`` percent of n, at least 1.

    ``common`` are the sorted common buckets and ``rank`` their places in the order.
    """
    count = len(tokens) - -(-percent * len(tokens) // 100) + max(1, MORE * len(tokens) // 100)
    bucket = (tokens >> np.uint64(32)).astype(np.uint32)
    place = np.searchsorted(common, bucket)
    late = np.zeros(len(tokens), bool)
    inside = place < len(common)
    late[inside] = common[place[inside]] == bucket[inside]
    first = tokens[~late][:count]
    if len(first) == count:
        return first
    rest = tokens[late]
    return np.r_[first, rest[np.argsort(rank[place[late]], kind="stable")][: count - len(first)]]


def prefixes(texts: DataFrame, percent: int, order: np.ndarray) -> DataFrame:
    """(token, cls, n): the prefix of each class's set."""
    rank = np.argsort(order, kind="stable")
    common = order[rank]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sets = list(shingle_sets(Words(batch.column(1), lower=True)))
            found = [prefix(s, percent, common, rank) for s in sets]
            sizes = [len(f) for f in found]
            yield pa.record_batch({
                "token": pa.array(np.concatenate(found).view(np.int64)),
                "cls": pa.array(np.repeat(batch.column(0).to_numpy(), sizes)),
                "n": pa.array(np.repeat([len(s) for s in sets], sizes), pa.int64()),
            })

    return texts.select("cls", "text").mapInArrow(run, "token long, cls long, n long")


def fewest(percent: int) -> Column:
    """Tokens that the prefix of a set of size n has to share with that of any partner, which has at least ceil(t * n) itself."""
    least = F.floor((F.col("n") * percent + 99) / 100)
    return F.greatest(F.floor(least * MORE / 100), F.lit(1))


def shared(rows: DataFrame, percent: int) -> DataFrame:
    """The rows (token, cls, n) whose token is also in the prefix of another class that is not too large or small for a link.

    A class with too few of them for any partner goes.
    """
    several = lambda df, *by: df.groupBy(*by).agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo < hi").select(*by)
    met = stored(rows.join(several(rows, "token"), "token"), "shared")
    # Sizes that fit are in the same class or in neighbouring ones; a row is put to the two pairs of classes that it belongs to.
    width = math.log(100 / percent) * (1 + 1e-9)
    size = F.floor(F.log(F.col("n").cast("double")) / width)
    put = met.withColumn("pair", F.explode(F.array(size, size + 1)))
    met = stored(put.join(several(put, "token", "pair"), ["token", "pair"]).select("token", "cls", "n").distinct(), "fitting")
    enough = met.groupBy("cls", "n").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= fewest(percent)).select("cls")
    return met.join(stored(enough, "enough"), "cls", "left_semi")


class Group:
    """The matrix of one group: the tokens of all members, and a row of bits for each."""

    def __init__(self, union: np.ndarray, bits: np.ndarray, sizes: np.ndarray):
        self.union, self.bits, self.sizes = union, bits, sizes

    @classmethod
    def of(cls, sets: list[np.ndarray]) -> Group:
        union, place = np.unique(np.concatenate(sets), return_inverse=True)
        sizes = np.array([len(s) for s in sets])
        bits = np.zeros((len(sets), len(union)), np.uint8)
        bits[np.repeat(np.arange(len(sets)), sizes), place] = 1
        return cls(union, bits, sizes)

    @classmethod
    def read(cls, row: dict) -> Group:
        union, sizes = np.frombuffer(row["union"], np.uint64), np.array(row["sizes"])
        bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8).reshape(len(sizes), -1), axis=1, count=len(union))
        return cls(union, bits, sizes)

    def packed(self) -> bytes:
        return np.packbits(self.bits, axis=1).tobytes()

    def member(self, at: int) -> np.ndarray:
        return self.union[self.bits[at].astype(bool)]

    def inside(self, percent: int) -> np.ndarray:
        """Whether members are linked with each other."""
        wide = self.bits.astype(np.float32)
        both = (wide @ wide.T).astype(np.int64)
        return 100 * both >= percent * (self.sizes[:, None] + self.sizes - both)

    def partners(self, tokens: np.ndarray, percent: int) -> np.ndarray:
        """The members linked with a set; the group is opened only if its union could hold a partner's share."""
        place = np.minimum(np.searchsorted(self.union, tokens), len(self.union) - 1)
        hit = place[self.union[place] == tokens]
        if 100 * len(hit) < percent * len(tokens):
            return np.zeros(0, np.int64)
        both = self.bits[:, hit].sum(axis=1, dtype=np.int64)
        return np.flatnonzero(100 * both >= percent * (len(tokens) + self.sizes - both))


def joining(linked: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links of a symmetric matrix that join its components, each once, and the component of each row."""
    label, out = np.arange(len(linked)), []
    for i, j in zip(*np.nonzero(np.triu(linked, 1))):
        if label[i] != label[j]:
            out.append((int(i), int(j)))
            label[label == label[j]] = label[i]
    return out, label


def linked_sets(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


GROUPS = "gid long, members array<long>, sizes array<int>, `union` binary, bits binary, labels array<long>, a array<long>, b array<long>"


def grouped(texts: DataFrame, percent: int) -> DataFrame:
    """One row per group, with the links found while it was made.

    Rows are range partitioned by their MinHash keys, so a hot key is cut by the next ones.
    A set is compared with its group, and with the first set of its key that the task has seen. ``labels`` says what is
    linked by that, as far as a task knows: by the first set of a key, else by a member.
    """
    keys = [f"k{i}" for i in range(KEYS)]
    sorted_rows = texts.select(*keys, "cls", "text").repartitionByRange(*keys, "cls").sortWithinPartitions(*keys, "cls")

    def row(held: list[tuple[int, np.ndarray]], heads: dict[int, int]) -> pa.RecordBatch:
        group = Group.of([s for _, s in held])
        names = [c for c, _ in held]
        inside, part = joining(group.inside(percent))
        links = [(h, c) for c, h in heads.items() if h != c] + [(names[i], names[j]) for i, j in inside]
        label = {p: c for p, c in zip(part[::-1], names[::-1])} | {p: heads[c] for p, c in zip(part, names) if c in heads}
        return pa.record_batch({
            "gid": pa.array([names[0]], pa.int64()), "members": pa.array([names], _LONGS), "sizes": pa.array([group.sizes.tolist()], _INTS),
            "union": pa.array([group.union.tobytes()], pa.binary()), "bits": pa.array([group.packed()], pa.binary()),
            "labels": pa.array([[label[p] for p in part]], _LONGS),
            "a": pa.array([[a for a, _ in links]], _LONGS), "b": pa.array([[b for _, b in links]], _LONGS),
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, heads, total, leader, last = [], {}, 0, (None, None, None), None
        for batch in batches:
            for piece in pieces([batch]):
                words = Words(piece.column(KEYS + 1), lower=True)
                for key, name, tokens in zip(piece.column(0).to_pylist(), piece.column(KEYS).to_pylist(), shingle_sets(words)):
                    if name == last:
                        continue  # a row that is there twice
                    if held and (len(held) == MEMBERS or total + len(tokens) > GROUP_TOKENS):
                        yield row(held, heads)
                        held, heads, total = [], {}, 0
                    if key != leader[0]:
                        leader = (key, name, tokens)
                        heads[name] = name
                    elif linked_sets(leader[2], tokens, percent):
                        heads[name] = leader[1]
                    held.append((name, tokens))
                    total, last = total + len(tokens), name
        if held:
            yield row(held, heads)

    return sorted_rows.mapInArrow(run, GROUPS)


def _pairs(groups: DataFrame) -> DataFrame:
    return groups.select(F.explode(F.arrays_zip("a", "b")).alias("l")).select("l.a", "l.b")


def opened(asks: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of each set with the members of a group: ``asks`` is (cls, own group, n, gid).

    A group's row is followed by the sets that ask in it, in blocks of bounded bytes: the matrix is
    unpacked once per block, and only one is held.
    """
    asks = stored(asks, "asks")
    # Both small tables are written, so that the groups are shuffled only where these are large.
    wanted = stored(asks.groupBy("own").agg(F.collect_set("cls").alias("wanted")), "wanted")  # at most as many as a group has members

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for given in batch.to_pylist():
                group, place = Group.read(given), {c: i for i, c in enumerate(given["members"])}
                yield pa.record_batch({
                    "cls": pa.array(given["wanted"], pa.int64()),
                    "tokens": pa.array([group.member(place[c]).tobytes() for c in given["wanted"]], pa.binary()),
                })

    matrix = groups.select("gid", "members", "sizes", "union", "bits")
    sets = matrix.join(wanted, F.col("gid") == F.col("own")).drop("own").mapInArrow(unpack, "cls long, tokens binary")
    blocks = stored(asks.groupBy("gid").agg(F.ceil(F.sum("n") * 8 / BLOCK_BYTES).cast("int").alias("blocks")), "blocks")
    queries = asks.join(sets, "cls").join(blocks, "gid").select(
        "gid", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int").alias("block"), F.lit(1).alias("kind"), "cls", "tokens",
        *[F.lit(None).cast(t).alias(c) for c, t in matrix.dtypes[1:]],
    )
    held = matrix.join(blocks, "gid").select(
        "gid", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("kind"),
        F.lit(None).cast("long").alias("cls"), F.lit(None).cast("binary").alias("tokens"), *[c for c in matrix.columns[1:]],
    )
    rows = held.unionByName(queries).repartition("gid", "block").sortWithinPartitions("gid", "block", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, members, label = None, [], None
        for batch in batches:
            found = []
            for given in batch.to_pylist():
                if given["kind"] == 0:
                    group, members = Group.read(given), given["members"]
                    label = np.arange(len(members))
                    continue
                partners = group.partners(np.frombuffer(given["tokens"], np.uint64), percent)
                # Members that an earlier set has joined need one link, not one each.
                _, some = np.unique(label[partners], return_index=True)
                found += [(given["cls"], members[m]) for m in partners[some] if members[m] != given["cls"]]
                if len(partners):
                    label[np.isin(label, label[partners])] = label[partners[0]]
            yield pa.record_batch({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return rows.mapInArrow(run, "a long, b long")


def _placed(classes: DataFrame, groups: DataFrame) -> DataFrame:
    """cls, gid, n and keys of every class in a group, with its group's label as its component."""
    where = groups.select("gid", F.explode(F.arrays_zip("members", "labels")).alias("m")).select("gid", F.col("m.members").alias("cls"), F.col("m.labels").alias("component"))
    return stored(where.join(classes.select("cls", "n", *[f"k{i}" for i in range(KEYS)]), "cls"), "placed")


def _joined(placed: DataFrame, links: DataFrame) -> DataFrame:
    """``placed`` with the components that ``links`` of classes join."""
    of = placed.select("cls", "component")
    ends = links.join(of.withColumnsRenamed({"cls": "a", "component": "x"}), "a").join(of.withColumnsRenamed({"cls": "b", "component": "y"}), "b")
    labels = connected_components(ends.select(F.col("x").alias("a"), F.col("y").alias("b"))).select(F.col("node").alias("component"), F.col("component").alias("whole"))
    rows = placed.join(labels, "component", "left").withColumn("component", F.coalesce("whole", "component")).drop("whole")
    return stored(rows, "placed")


def by_key(placed: DataFrame, key: str) -> DataFrame:
    """Asks of one set per component, in the group of the first set with its key."""
    first = placed.groupBy(key).agg(
        F.min(F.struct("cls", "gid", "component")).alias("f"), F.min("component").alias("lo"), F.max("component").alias("hi")
    ).where("lo < hi").select(key, "f.*").withColumnsRenamed({"cls": "c", "gid": "to", "component": "other"})
    met = placed.join(first, key).where("component <> other")
    return met.groupBy("component", "other").agg(F.min(F.struct("cls", "gid", "n", "to")).alias("m")).select(
        "m.cls", F.col("m.gid").alias("own"), "m.n", F.col("m.to").alias("gid")
    )


def by_matrix(postings: DataFrame, placed: DataFrame, percent: int) -> DataFrame:
    """Asks of every set in the later groups that share enough of its prefix tokens, hold sets of a fitting size and of another component."""
    rows = postings.join(placed.select("cls", "gid", "component"), "cls")
    several = rows.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("token")
    rows = stored(rows.join(several, "token"), "matrix-rows")
    matrix = rows.groupBy("token", F.col("gid").alias("to")).agg(
        F.min("n").alias("least"), F.max("n").alias("most"), F.min("component").alias("lo"), F.max("component").alias("hi")
    )
    fits = (100 * F.col("n") >= percent * F.col("least")) & (100 * F.col("most") >= percent * F.col("n"))
    # Members of one group have met; of two groups the sets of one ask in the other.
    other = (F.col("gid") < F.col("to")) & ((F.col("lo") != F.col("component")) | (F.col("hi") != F.col("component")))
    met = rows.join(matrix, "token").where(other & fits).select("token", "cls", F.col("gid").alias("own"), "n", F.col("to").alias("gid"))
    return met.groupBy("cls", "own", "n", "gid").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= fewest(percent)).drop("c")


def jaccard_components(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of (doc_id, text).

    Links join documents with 100 * intersection >= percent * union of their sets of five-word shingles.
    """
    sketch = stored(sketches(docs), "set-sketches")
    known = sketch.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    columns = ["n", *[f"k{i}" for i in range(KEYS)]]
    # One row per class; partial aggregation meets a large group of copies before the shuffle.
    classes = known.groupBy("digest").agg(F.min(F.struct("doc_id", "h", *columns)).alias("r")).select("digest", "r.*")
    classes = stored(classes.withColumn("cls", F.monotonically_increasing_id()), "set-classes")

    own = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("h"))
    texts = own.join(classes.drop("digest"), ["doc_id", "h"])
    rows = stored(prefixes(texts, percent, common_buckets(docs)), "prefixes")
    postings = stored(shared(rows, percent), "postings")
    maybe = stored(postings.select("cls").distinct(), "maybe")
    partnered = classes.join(maybe, "cls", "left_semi")
    groups = stored(grouped(own.join(partnered.drop("digest"), ["doc_id", "h"]), percent), "groups")

    links = stored(_pairs(groups), "links")
    placed = _placed(classes, groups)
    asks = by_key(placed, "k1")
    for i in range(2, KEYS):
        asks = asks.unionByName(by_key(placed, f"k{i}"))
    links = stored(links.unionByName(opened(asks.distinct(), groups, percent)), "links")
    placed = _joined(placed, links)
    found = opened(by_matrix(postings, placed, percent), groups, percent)

    # From classes to documents: the first doc_id of a class stands for it; a doc_id with several sets joins their classes.
    several = known.groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo <> hi").select("doc_id")
    name = classes.select("digest", F.col("doc_id").alias("rep"))
    twice = known.join(several, "doc_id", "left_semi").join(name, "digest").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    ends = classes.select("cls", F.col("doc_id").alias("rep"))
    named = links.unionByName(found).join(ends.withColumnsRenamed({"cls": "a", "rep": "x"}), "a").join(ends.withColumnsRenamed({"cls": "b", "rep": "y"}), "b")
    labels = connected_components(named.select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(twice))
    labels = labels.select(F.col("node").alias("rep"), F.col("component").alias("label"))
    by_class = name.join(labels, "rep", "left").select(F.col("digest").alias("d"), F.coalesce("label", "rep").alias("label"))
    joined = sketch.join(by_class, (F.col("digest") == F.col("d")) & F.col("doc_id").isNotNull(), "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("label", "doc_id").alias("component_id"))


def op13_set_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{folder}/documents.parquet"))


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
  SELECT a, b FROM pairs JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b WHERE 100 * n >= 80 * (len(x.s) + len(y.s) - n)
), sides AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reach(a, b) AS (
  SELECT a, b FROM sides UNION SELECT reach.a, sides.b FROM reach JOIN sides ON reach.b = sides.a
), least AS (
  SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a
)
SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id FROM sets LEFT JOIN least USING (doc_id)
"""
