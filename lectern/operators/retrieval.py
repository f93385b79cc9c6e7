"""Vector retrieval for batches of questions: select, search, rank, fit."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern import lexicon
from lectern.operators import blocks, layout

TIE_PLACES = 12
#: At least ten letters from the first that is no space to the last; a text is read no further than that takes.
TEN_LONG = r"(?sU)\S.{8,}?\S"


def _unit(vectors: pd.Series) -> np.ndarray:
    block = np.asarray(np.stack(vectors.to_numpy()), dtype="float64")
    size = np.sqrt((block * block).sum(axis=1, keepdims=True))
    return np.divide(block, size, out=np.zeros_like(block), where=size > 0)


def _cosine(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Of unit vectors."""
    return q @ c.T


def _squared_l2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1.0 - ((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T))


def _plain(vectors: pd.Series) -> np.ndarray:
    return np.asarray(np.stack(vectors.to_numpy()), dtype="float64")


METRICS = {"cosine": (_unit, _cosine), "l2": (_plain, _squared_l2)}


def _first_k(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best entries of each row, best first, ties by id; not a number comes last."""
    order = np.lexsort((ids[cols], -values, rows))
    rows, cols, values = rows[order], cols[order], values[order]
    starts = np.r_[0, np.flatnonzero(np.diff(rows)) + 1] if len(rows) else np.array([], dtype=int)
    place = np.arange(len(rows)) - np.repeat(starts, np.diff(np.r_[starts, len(rows)]))
    return rows[place < k], cols[place < k], values[place < k]


def best_per_group(
    q: np.ndarray, c: np.ndarray, ids: np.ndarray, k: int, similarity: Callable[[np.ndarray, np.ndarray], np.ndarray] = _cosine
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers of ``q``, of ``c`` and scores of the k most similar of ``c`` to each of ``q``, ties by id.

    Works in tiles. What a row has found so far says what a later tile has to beat. Cosines are first looked at in
    single precision, whose error is bounded; only those that may be good enough are taken in double precision.
    """
    by_id = np.argsort(ids, kind="stable")
    c, ids = c[by_id], ids[by_id]
    rough = similarity is _cosine
    q1, c1 = (q.astype("float32"), c.astype("float32")) if rough else (q, c)
    margin = (q.shape[1] + 8) * 1.2e-7 if rough else 0.0
    out, edge, held = [], np.full(len(q), -np.inf), None
    for down, across in blocks.tiles(len(q), len(c)):
        if across.start == 0 and held is not None:
            out.append(held)
            held = None
        part, other = q[down], c[across]
        scores = similarity(q1[down], c1[across])
        if not rough:
            scores = np.round(scores, TIE_PLACES)
        limit = edge[down]
        if held is None and scores.shape[1] > 4 * k:
            known = np.where(np.isnan(scores), -np.inf, scores)
            limit = np.partition(known, scores.shape[1] - k, axis=1)[:, -k] - margin
        # Rows whose largest score is too small are left at once; not a number stays.
        floor = (limit - margin).astype(scores.dtype)
        floor = np.nextafter(floor, floor.dtype.type(-np.inf))
        open_ = np.flatnonzero(~(scores.max(axis=1) < floor))
        rows, cols = np.divmod(np.flatnonzero(~(scores[open_] < floor[open_, None])), scores.shape[1])
        rows = open_[rows]
        if not rough:
            values = scores[rows, cols]
        elif len(rows) > scores.size // 16:
            values = np.round(similarity(part, other)[rows, cols], TIE_PLACES)
        else:
            values = np.round(np.einsum("ij,ij->i", part[rows], other[cols]), TIE_PLACES)
        rows, cols = rows + down.start, cols + across.start
        # Columns come by id: one that only equals a row's k-th best so far does not take its place.
        better = ~(values <= edge[rows])
        rows, cols, values = rows[better], cols[better], values[better]
        if held is not None:
            rows, cols, values = (np.concatenate(pair) for pair in zip(held, (rows, cols, values)))
        held = _first_k(rows, cols, values, ids, k)
        if len(held[0]):  # what a full row has to beat from now on
            last = np.r_[np.flatnonzero(np.diff(held[0])), len(held[0]) - 1]
            full = np.bincount(held[0] - down.start, minlength=len(part))[held[0][last] - down.start] == k
            ends = held[2][last][full]
            edge[held[0][last][full]] = np.where(np.isnan(ends), -np.inf, ends)
    if held is not None:
        out.append(held)
    rows, cols, values = (np.concatenate(parts) for parts in zip(*out))
    return rows, by_id[cols], values


def top_hits(
    queries: DataFrame,
    chunks: DataFrame,
    k: int = lexicon.HITS_PER_COLLECTION,
    metric: str = "cosine",
    selected: bool = False,
    **limits: int,
) -> DataFrame:
    """J2 + W1: the k nearest chunks of each collection for each query.

    ``queries``: query_id, query_embedding and, when ``selected``, the array
    ``collections`` it may use (P2). ``chunks``: vec_id, collection, embedding.
    Returns query_id, collection, vec_id, score, rank.
    """
    read, similarity = METRICS[metric]

    def score(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        parts = []
        vectors = read(q["query_embedding"]) if len(q) else None
        for name, part in c.groupby("collection", sort=False):
            asks = (q["collection"] == name).to_numpy(bool) if selected else np.ones(len(q), bool)
            asked = q[asks]
            if not len(asked):
                continue
            ids = part["vec_id"].to_numpy()
            rows, cols, values = best_per_group(vectors[asks], read(part["embedding"]), ids, k, similarity)
            parts.append(
                pd.DataFrame(
                    {
                        "query_id": asked["query_id"].to_numpy()[rows],
                        "collection": name,
                        "vec_id": ids[cols],
                        "score": values,
                    }
                )
            )
        return pd.concat(parts) if parts else pd.DataFrame(columns=["query_id", "collection", "vec_id", "score"])

    def trim(found: pd.DataFrame) -> pd.DataFrame:
        ordered = found.sort_values(["query_id", "collection", "score", "vec_id"], ascending=[True, True, False, True])
        return ordered.groupby(["query_id", "collection"], sort=False).head(k)

    if selected:
        # The store is partitioned by collection: only selected ones are read.
        wanted = layout.written(queries.select(F.explode("collections").alias("collection")).distinct(), "wanted")
        chunks = chunks.join(wanted, "collection", "left_semi")
    # A question goes to the blocks of its collections alone, so a chunk is copied as often as they ask for it.
    own = [F.explode(F.array_distinct("collections")).alias("collection")] if selected else []
    partial = blocks.match_blocks(
        queries.select("query_id", "query_embedding", *own),
        chunks.select("vec_id", "collection", "embedding"),
        score,
        "query_id long, collection string, vec_id long, score double",
        keys=["collection"] if selected else [],
        trim=trim,
        grown=blocks.BLOCK_ROWS,
        **limits,
    )
    order = Window.partitionBy("query_id", "collection").orderBy(F.desc("score"), "vec_id")
    return partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def select_collections(requests: DataFrame, collections: DataFrame) -> DataFrame:
    """P2 + J10: up to three collections per (subject, grade) request.

    ``requests``: request_id, subject, grade. ``collections``: one row per name.
    Order: collections of the subject and grade by name, then the subject's
    general ones, then, only if none was found, the two fallbacks.
    """
    known = collections.select(F.col("collection")).distinct()
    asks = requests.select(
        "request_id",
        F.lower("subject").alias("subject"),
        F.concat(
            F.lit("neb_"), F.replace(F.lower("subject"), F.lit(" "), F.lit("_")),
            F.lit("_grade_"), F.col("grade").cast("string"),
        ).alias("_key"),
    )
    # "Name contains key" is an equi join: a name holds few keys, so list them.
    keyed = known.select(
        "collection",
        F.explode(
            F.array_distinct(F.flatten(F.transform(
                F.regexp_extract_all(F.lower("collection"), F.lit(r"(?=(neb_.*?_grade_\w*))")),
                lambda tail: F.transform(
                    F.sequence(F.lit(1), F.length(tail)), lambda n: F.substring(tail, F.lit(1), n)
                ),
            )))
        ).alias("_key"),
    ).where(F.col("_key").rlike("_grade_"))
    board = asks.join(keyed, "_key").select("request_id", "collection", F.lit(0).alias("tier"), F.lit(0).alias("place"))
    # The fixed subject table rides along as a literal map; no join needed for it.
    general = F.create_map(*[
        part for subject, names in lexicon.SUBJECT_COLLECTIONS
        for part in (F.lit(subject), F.array(*[F.lit(n) for n in names]))
    ])
    mapped = asks.select("request_id", F.lit(1).alias("tier"), F.posexplode(F.try_element_at(general, "subject")).alias("place", "collection"))
    mapped = mapped.join(known, "collection", "left_semi")
    found = board.unionByName(mapped)
    fallback = F.array(*[F.lit(n) for n in lexicon.FALLBACK_COLLECTIONS])
    rest = (
        asks.join(found.select("request_id").distinct(), "request_id", "left_anti")
        .select("request_id", F.lit(2).alias("tier"), F.posexplode(fallback).alias("place", "collection"))
        .join(known, "collection", "left_semi")
    )
    order = Window.partitionBy("request_id").orderBy("tier", "place", "collection")
    return (
        found.unionByName(rest)
        .withColumn("choice", F.row_number().over(order))
        .where(F.col("choice") <= lexicon.MAX_COLLECTIONS)
        .select("request_id", "collection", "choice")
    )


def source_priority(source: Column, table=lexicon.SOURCE_PRIORITY) -> Column:
    """T2"""
    weights = dict(table)
    lowered = F.lower(F.coalesce(source, F.lit("")))
    chosen = F.lit(weights["default"])
    for key, weight in reversed(table):
        chosen = F.when(lowered.contains(key), weight).otherwise(chosen)
    return chosen


def repair_metadata(hits: DataFrame) -> DataFrame:
    """fill an unknown source from seed_data, then an unknown type from the source."""
    source = F.coalesce(F.col("source"), F.lit("unknown"))
    blank = (F.lower(source) == "unknown") | (source == "")
    hits = hits.withColumn("source", F.when(blank, F.coalesce("seed_data", source)).otherwise(source))
    kind = F.when(F.col("source").isin(lexicon.GENERAL_SOURCES), "General Knowledge").otherwise("Supplemental")
    return hits.withColumn("type", F.when(F.coalesce("type", F.lit("unknown")) == "unknown", kind).otherwise(F.col("type")))


def rank_hits(
    hits: DataFrame,
    source: str = "source",
    grade: str | None = None,
    query_text: str | None = None,
    whole_word_grade: bool = False,
) -> DataFrame:
    """T1 (with P7 and T2): weighted score, source type and place per query.

    Ties go by collection and id. ``grade`` and ``query_text`` name columns; the
    bonus applies when the grade's digits occur anywhere in the query text, or
    only as a whole word when ``whole_word_grade``.
    """
    priority = source_priority(F.col(source))
    final = F.col("score") * 0.7 + priority / 100.0 * 0.3
    if grade and query_text:
        digits = F.col(grade).cast("string")
        if whole_word_grade:
            hit = F.rlike(F.col(query_text), F.concat(F.lit(r"\b"), digits, F.lit(r"\b")))
        else:
            hit = F.contains(F.col(query_text), digits)
        final = final + F.when(hit, 0.1).otherwise(0.0)
    kept = hits.where(F.col("text").rlike(TEN_LONG)).withColumns(
        {
            "final_score": F.round(final, TIE_PLACES),
            "source_type": F.when(priority == 100, "NEB").otherwise("External"),
        }
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("final_score"), "collection", "vec_id")
    return kept.withColumn("place", F.row_number().over(order))


def above_floor(hits: DataFrame, floor: float = lexicon.SCORE_FLOOR) -> DataFrame:
    """P6"""
    return hits.where(F.col("final_score") >= floor)


def fit_budget(hits: DataFrame, budget: int = lexicon.CONTEXT_BUDGET) -> DataFrame:
    """Ranked chunks while their running length stays below the budget.

    Lengths are positive, so "running length below budget" ends at the first
    overflow exactly like a loop that stops there.
    """
    running = (
        Window.partitionBy("query_id").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return hits.withColumn("running_length", F.sum(F.length("text")).over(running)).where(
        F.col("running_length") < budget
    )


def primary_first(hits: DataFrame) -> DataFrame:
    """Primary-source chunks first, order otherwise kept."""
    order = Window.partitionBy("query_id").orderBy(F.col("source_type") != "NEB", "place")
    return hits.withColumn("position", F.row_number().over(order))


def with_texts(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits with the other columns of their chunks, fetched for the few rows found."""
    return chunks.drop("embedding", "collection").join(layout.written(hits, "hits"), "vec_id")


def retrieve_context(
    queries: DataFrame, chunks: DataFrame, k: int = lexicon.HITS_PER_COLLECTION, budget: int = lexicon.CONTEXT_BUDGET,
    source: str = "collection", **options,
) -> DataFrame:
    """Search, rank, floor, budget and order in one go. Texts join the few hits only."""
    hits = top_hits(queries, chunks, k, **options)
    ranked = rank_hits(with_texts(hits, chunks), source)
    return primary_first(fit_budget(above_floor(ranked), budget))
