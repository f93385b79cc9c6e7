"""Merkle manifest of a dataset: every row is a leaf, every group a tree, and the trees' roots make one more tree.

Levels are built from the leaves up and stored as node rows that name their parent and
hold the digests beside them in their run. A proof is a climb: a recursive query
starts at the leaves, meets the stored rows of its nodes at each step, hands on the
siblings and folds the digest that is claimed for the leaf. It ends where no node has a parent,
at the root.

A node's id is its level and its place: leaves are numbered over the whole table in the order
(group, key), so a tree owns a range of places on each level. Digests are kept as 32 bytes and
hashed as the concatenation of their lowercase hex texts.

Defined results: null fields count as ``-``; a null group is one group and comes first,
null keys come first in their group. Rows of one key are in the order of their digests, so equal
rows, which have equal digests, may swap places and results stay the same. A group of one
row is its own subroot, one group's subroot is the root. An empty table has no rows and no
root. Columns beyond those named are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.storage import stored
from lectern.operators.layout import number_rows

ARITY, STRIDE = 3, 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
# An id is level << 48 plus a place. The tree over the groups starts at a level that no other tree reaches.
LEVEL, TOP = 1 << 48, 1 << 10
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


def hex_text(digest: Column | str) -> Column:
    return F.lower(F.hex(digest))


def digest_of(*parts: Column) -> Column:
    """SHA-256 of the parts one after another; null parts are left out."""
    return F.unhex(F.sha2(F.concat_ws("", *parts), 256))


def leaf_digest(fields: list[Column]) -> Column:
    """Digest of a row: ``-`` for a null field, else its bytes in UTF-8 after their number and a colon."""
    texts = [f.cast("string") for f in fields]
    return digest_of(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts])


def node_id(level: int, place: Column) -> Column:
    return place + F.lit(level * LEVEL)


@dataclass
class Manifest:
    """``leaves``: the given rows with ``number`` (place of the leaf), ``first`` (the tree's first place), ``before`` and
    ``after`` (the leaf's siblings, left and right) and ``up`` (its parent, null at the root). ``nodes``: id, up, before and
    after of every other node but the root. ``trees``: group and first, size and subroot of every tree."""

    leaves: DataFrame
    nodes: DataFrame
    trees: DataFrame
    root: bytes | None


def _above(level: Column) -> Column:
    """The digests of the runs of an array of consecutive digests."""
    runs = F.sequence(F.lit(0), F.floor((F.size(level) - 1) / ARITY).cast("int"))
    return F.transform(runs, lambda r: F.unhex(F.sha2(F.array_join(F.transform(F.slice(level, r * ARITY + 1, ARITY), hex_text), ""), 256)))


def _beside(level: Column, at: Column, left: bool) -> Column:
    """The digests of a node's run that lie before or after it, one after another."""
    start = at - F.pmod(at, F.lit(ARITY))
    side = F.slice(level, start + 1, at - start) if left else F.slice(level, at + 2, start + ARITY - at - 1)
    return F.unhex(F.array_join(F.transform(side, F.hex), ""))


def _nodes(digests: Column, level: int, place: Column, above: Column) -> Column:
    """The node rows of consecutive digests; ``place`` is that of the first, ``above`` that of its parent."""

    def node(_: Column, i: Column) -> Column:
        parent = above + F.floor(i / ARITY).cast("long")
        return F.struct(
            node_id(level, place + i).alias("id"), node_id(level + 1, parent).alias("up"),
            _beside(digests, i, True).alias("before"), _beside(digests, i, False).alias("after"),
        )

    return F.transform(digests, node)


def _levels(bottom: DataFrame, base: int, purpose: str) -> tuple[list[DataFrame], DataFrame]:
    """Builds trees from ``bottom`` (first, place in the tree, size of the tree's level, digest).

    A pass builds ``STRIDE`` levels: the nodes below one node meet in one row, at most 27 digests, wherever their
    tree is hot. Returns per pass the rows of the nodes that have a parent, and (first, level, digest) of those without one.
    """
    span, linked, tops, level = ARITY**STRIDE, [], [], base
    while True:
        run = F.floor(F.col("place") / span).cast("long")
        digests = F.transform(F.array_sort(F.collect_list(F.struct("place", "digest"))), lambda s: s["digest"])
        rows = bottom.groupBy("first", "size", run.alias("run")).agg(digests.alias("d0"))
        nodes, ends = F.array().cast("array<struct<id:bigint,up:bigint,before:binary,after:binary>>"), []
        for k in range(STRIDE):
            wide = F.ceil(F.col("size") / ARITY**k)  # nodes of the whole tree on this level
            own = F.col(f"d{k}")
            rows = rows.withColumn(f"d{k + 1}", F.when(wide > 1, _above(own)))
            made = _nodes(own, level + k, F.col("first") + F.col("run") * (span // ARITY**k), F.col("first") + F.col("run") * (span // ARITY ** (k + 1)))
            nodes = F.concat(nodes, F.when(wide > 1, made).otherwise(F.array()))
            ends.append(F.when((wide == 1) & own.isNotNull(), F.struct(F.lit(level + k).alias("level"), own[0].alias("digest"))))
        further = F.col(f"d{STRIDE}")
        passed = F.when(further.isNotNull(), F.struct(F.col("run").alias("place"), F.ceil(F.col("size") / span).cast("long").alias("size"), further[0].alias("digest")))
        rows = stored(rows.select("first", nodes.alias("nodes"), F.coalesce(*ends).alias("top"), passed.alias("next")), f"{purpose}-levels")
        linked.append(rows.select(F.explode("nodes").alias("n")).select("n.*"))
        tops.append(rows.where("top IS NOT NULL").select("first", "top.*"))
        bottom, level = rows.where("next IS NOT NULL").select("first", "next.*"), level + STRIDE
        if not bottom.limit(1).count():
            break
    roots = tops[0]
    for more in tops[1:]:
        roots = roots.unionByName(more)
    return linked, stored(roots, f"{purpose}-roots")


def build(rows: DataFrame, group: str, key: str) -> Manifest:
    """The manifest of ``rows``: a ``digest`` per row, trees by ``group``, leaves in order of ``key`` and digest."""
    leaves = number_rows(rows, [F.col(group).asc_nulls_first(), F.col(key).asc_nulls_first(), F.col("digest")])
    trees = stored(leaves.groupBy(group).agg(F.min("number").alias("first"), F.count(F.lit(1)).alias("size")), "trees")
    of = trees.select(F.col(group).alias("_group"), "first", "size")
    leaves = stored(leaves.join(of, F.col(group).eqNullSafe(F.col("_group"))).drop("_group"), "leaves")
    bottom = leaves.select("first", (F.col("number") - F.col("first")).alias("place"), "size", "digest")
    linked, subroots = _levels(bottom, 0, "tree")

    # The subroots, in order of their trees' places, are the leaves of one more tree.
    count = subroots.count()
    placed = stored(number_rows(subroots, [F.col("first")], "place").withColumnRenamed("first", "tree"), "subroots")
    top = placed.select(F.lit(0).cast("long").alias("first"), "place", F.lit(count).cast("long").alias("size"), "digest")
    upper, last = _levels(top, TOP, "top")
    root = last.first()
    if upper:
        # A subroot's own id stands for its leaf in the upper tree.
        own = placed.select(node_id(TOP, F.col("place")).alias("id"), (F.col("level") * F.lit(LEVEL) + F.col("tree")).alias("own"))
        upper[0] = upper[0].join(own, "id", "left").select(F.coalesce("own", "id").alias("id"), "up", "before", "after")
    nodes = None
    for part in [*linked, *upper]:
        nodes = part if nodes is None else nodes.unionByName(part)
    if nodes is None:
        schema = "id long, up long, before binary, after binary"
        nodes = rows.sparkSession.createDataFrame([], schema)
    nodes = stored(nodes, "nodes")
    leaves = leaves.join(nodes.where(F.col("id") < LEVEL).withColumnRenamed("id", "number"), "number", "left")
    trees = trees.join(placed.select(F.col("tree").alias("first"), F.col("digest").alias("subroot")), "first")
    return Manifest(leaves, nodes.where(F.col("id") >= LEVEL), trees, bytes(root["digest"]) if root else None)


CLIMB = """
WITH RECURSIVE climb(number, step, node, siblings, digest) AS (
  SELECT number, 0, up, siblings, digest FROM {start}
  UNION ALL
  SELECT c.number, c.step + 1, n.up, concat(n.before, n.after),
         unhex(sha2(concat(lower(hex(n.before)), lower(hex(c.digest)), lower(hex(n.after))), 256))
  FROM climb c JOIN {nodes} n ON c.node = n.id
)
SELECT number, step, siblings, digest FROM climb
"""


def climbed(manifest: Manifest, claimed: str) -> DataFrame:
    """(number, proof, folded) for every leaf: the siblings from leaf to root, and the root that the digest in column ``claimed`` leads to.

    A step is one row per leaf: siblings go out with it rather than being carried along, and are put
    in order per leaf at the end.
    """
    spark = manifest.leaves.sparkSession
    own = F.when(F.col("up").isNull(), F.col(claimed)).otherwise(
        digest_of(hex_text("before"), hex_text(claimed), hex_text("after"))
    )
    start = manifest.leaves.select(
        "number", "up", F.coalesce(F.concat("before", "after"), F.lit(b"")).alias("siblings"), own.alias("digest")
    )
    names = {"start": "_lectern_climb_start", "nodes": "_lectern_climb_nodes"}
    stored(start, "climb-start").createOrReplaceTempView(names["start"])
    manifest.nodes.createOrReplaceTempView(names["nodes"])
    # The session's limit on rows of a recursion is for endless ones; this one ends at the root.
    before = spark.conf.get(ROW_LIMIT, None)
    spark.conf.set(ROW_LIMIT, "-1")
    try:
        steps = stored(spark.sql(CLIMB.format(**names)), "climb")
    finally:
        spark.conf.unset(ROW_LIMIT) if before is None else spark.conf.set(ROW_LIMIT, before)
        for name in names.values():
            spark.catalog.dropTempView(name)
    found = steps.groupBy("number").agg(
        F.array_sort(F.collect_list(F.struct("step", "siblings"))).alias("path"), F.max(F.struct("step", "digest")).alias("last"),
    )
    proof = F.array_join(F.transform("path", lambda s: hex_text(s["siblings"])), "")
    return found.select("number", proof.alias("proof"), F.col("last.digest").alias("folded"))


def op11_merkle(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    fields = {name: F.col(name) for name in FIELDS}
    tampered = leaf_digest([F.replace(c, F.lit("\n"), F.lit("")) if name == "text" else c for name, c in fields.items()])
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    rows = docs.select(
        "source", "doc_id", leaf_digest(list(fields.values())).alias("digest"),
        # Only where deleting changes the text is there a second digest to take.
        F.when(even & F.contains("text", F.lit("\n")), tampered).alias("changed"),
    )
    made = build(rows, "source", "doc_id")
    made.leaves = made.leaves.withColumn("claimed", F.coalesce("changed", "digest"))
    proofs = climbed(made, "claimed")
    leaves = made.leaves.select("number", "doc_id", "digest", "first").join(proofs, "number")
    out = leaves.join(made.trees.select("first", "subroot"), "first")
    root = F.lit(None if made.root is None else made.root.hex())
    return out.select(
        "doc_id", hex_text("digest").alias("leaf"), hex_text("subroot").alias("subroot"), root.alias("root"),
        F.sha2("proof", 256).alias("proof_sha256"), hex_text("folded").alias("folded_root"),
        (hex_text("folded") == root).alias("verified"),
    )


# CRC-32 bit by bit over the digits of doc_id; the levels of all trees at once; a path per leaf from level tables.
ORACLE_SQL = r"""
WITH RECURSIVE rows AS (
  SELECT doc_id, source, lang, n_chars, text,
    list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::UBIGINT)),
      lambda c, x: list_reduce(list_prepend(xor(c, x), list_transform(range(8), lambda i: i::UBIGINT)),
        lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END)) AS crc
  FROM documents
), texts AS (
  SELECT *, CASE WHEN xor(crc, 4294967295::UBIGINT) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS other FROM rows
), leaves AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i,
    sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(other) || ':' || other, '-')) AS bad
  FROM (SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source) || ':' || source, '-')
          || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') AS head FROM texts) t
), levels(source, lv, i, h, n) AS (
  SELECT source, 0, i, leaf, count(*) OVER (PARTITION BY source) FROM leaves
  UNION ALL
  SELECT source, lv + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM levels WHERE n > 1 GROUP BY source, lv, i // 3, n
), subroots AS (
  SELECT source, lv, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i FROM levels WHERE n = 1
), tops(lv, i, h, n) AS (
  SELECT 0, i, h, count(*) OVER () FROM subroots
  UNION ALL
  SELECT lv + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM tops WHERE n > 1 GROUP BY lv, i // 3, n
), sides AS (
  SELECT source, lv, x.i, coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (y.i < x.i), '') AS l, coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (y.i > x.i), '') AS r
  FROM (SELECT * FROM levels WHERE n > 1) x JOIN (SELECT source AS s, lv AS v, i, h FROM levels) y
    ON x.source IS NOT DISTINCT FROM y.s AND x.lv = y.v AND x.i // 3 = y.i // 3 GROUP BY source, lv, x.i
), top_sides AS (
  SELECT x.lv, x.i, coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (y.i < x.i), '') AS l, coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (y.i > x.i), '') AS r
  FROM (SELECT * FROM tops WHERE n > 1) x JOIN tops y ON x.lv = y.lv AND x.i // 3 = y.i // 3 GROUP BY x.lv, x.i
), below AS (
  SELECT doc_id, e.source, list({'l': l, 'r': r} ORDER BY lv) AS path
  FROM leaves e JOIN sides s ON e.source IS NOT DISTINCT FROM s.source AND s.i = e.i // (3 ** lv)::BIGINT GROUP BY doc_id, e.source
), above AS (
  SELECT source, list({'l': l, 'r': r} ORDER BY t.lv) AS path FROM subroots u JOIN top_sides t ON t.i = u.i // (3 ** t.lv)::BIGINT GROUP BY source
), proofs AS (
  SELECT e.doc_id, e.leaf, e.bad, u.h AS subroot, list_concat(coalesce(b.path, []), coalesce(a.path, [])) AS path
  FROM leaves e JOIN subroots u ON e.source IS NOT DISTINCT FROM u.source
  LEFT JOIN below b ON b.doc_id = e.doc_id LEFT JOIN above a ON a.source IS NOT DISTINCT FROM e.source
), folded AS (
  SELECT doc_id, leaf, subroot, (SELECT h FROM tops WHERE n = 1) AS root, sha256(list_reduce(list_prepend('', list_transform(path, lambda p: p.l || p.r)), lambda a, b: a || b)) AS proof_sha256,
    list_reduce(list_prepend({'l': bad, 'r': ''}, path), lambda a, p: {'l': sha256(p.l || a.l || p.r), 'r': ''}).l AS folded_root
  FROM proofs
)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""
