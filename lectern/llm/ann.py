"""Approximate nearest neighbours in learned partitions.

On a bounded sample a neighbour graph is built and cut into parts of equal size with
few edges between them; a small network learns to tell the part from the vector. It
routes every row of the table to one part, and a query to its most probable parts,
as many as are needed to hold a share of probability. That share is the least one
that reaches the wanted recall for sample rows the network did not learn from. Rows
of the chosen parts are ranked by their exact inner product with the query.

The sample has at most ``SAMPLE`` vectors, those of least hash, whatever the table's
size; the index holds every row. A part is met in blocks of bounded size, so a part
that holds a third of all rows is spread. Nearness, ties and results are exact among
the rows met.

Defined results: vectors that are null, zero or hold null or non-finite components
take no part, nor does a null vec_id; of repeated vec_ids one row stands; shorter
vectors end in zeros; fewer rows than k are all returned; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.storage import stored
from lectern.llm.vector_blocks import QUERIES, ROWS, best, clean, met, stacked, top_rows

SAMPLE, NEIGHBOURS, PARTS = 8192, 10, 64
HIDDEN = 128
RECALL = 0.96


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest others of each row by inner product."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), np.int64)
    for at in range(0, len(x), 1024):
        s = x[at: at + 1024] @ x.T
        s[np.arange(len(s)), at + np.arange(len(s))] = -np.inf
        out[at: at + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(graph: np.ndarray, parts: int, seed: int = 9) -> np.ndarray:
    """Parts of equal size, cut by halving: each half is one side of the median of a smooth vector on the graph."""
    rng = np.random.default_rng(seed)
    n, k = graph.shape
    a, b = np.repeat(np.arange(n), k), graph.ravel()
    part = np.zeros(n, np.int64)
    for _ in range(int(np.log2(parts))):
        inside = part[a] == part[b]
        i, j = np.r_[a[inside], b[inside]], np.r_[b[inside], a[inside]]
        degree = np.bincount(i, minlength=n) + 1.0
        size = np.maximum(np.bincount(part), 1)
        y = rng.normal(size=n)
        for _ in range(60):
            # Averaging over neighbours, without the part's mean, nears its smoothest non-constant vector.
            y = (np.bincount(i, y[j], n) + y) / degree
            y -= (np.bincount(part, y, len(size)) / size)[part]
            y /= np.sqrt(np.bincount(part, y * y, len(size)) / size + 1e-30)[part]
        order = np.lexsort((y, part))
        place = np.empty(n, np.int64)
        place[order] = np.arange(n) - np.repeat(np.r_[0, np.cumsum(size)[:-1]], size)
        part = part * 2 + (place * 2 >= size[part])
    return part


class Router:
    """Probability of each part for a vector: one hidden layer, and a softmax."""

    def __init__(self, width: int, parts: int, seed: int = 4):
        rng = np.random.default_rng(seed)
        self.w = [rng.normal(0, np.sqrt(2 / width), (width, HIDDEN)), rng.normal(0, np.sqrt(1 / HIDDEN), (HIDDEN, parts))]
        self.b = [np.zeros(HIDDEN), np.zeros(parts)]
        self.share, self.sizes = 1.0, np.zeros(parts, np.int64)

    def hidden(self, x: np.ndarray) -> np.ndarray:
        width = len(self.w[0])
        x = x[:, :width] if x.shape[1] >= width else np.pad(x, ((0, 0), (0, width - x.shape[1])))
        x = x * (np.sqrt(width) / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300))
        self._x = x
        return np.maximum(x @ self.w[0] + self.b[0], 0)

    def chances(self, x: np.ndarray) -> np.ndarray:
        z = self.hidden(x) @ self.w[1] + self.b[1]
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def learn(self, x: np.ndarray, target: np.ndarray, epochs: int = 40, batch: int = 256, rate: float = 2e-3, seed: int = 6) -> None:
        """Adam on the cross-entropy to the parts of a row and its neighbours."""
        rng = np.random.default_rng(seed)
        every = [*self.w, *self.b]
        m, v, t = [np.zeros_like(p) for p in every], [np.zeros_like(p) for p in every], 0
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                some = order[at: at + batch]
                h = self.hidden(x[some])
                z = h @ self.w[1] + self.b[1]
                e = np.exp(z - z.max(axis=1, keepdims=True))
                d = (e / e.sum(axis=1, keepdims=True) - target[some]) / len(some)
                dh = (d @ self.w[1].T) * (h > 0)
                t += 1
                for k, (p, g) in enumerate(zip(every, (self._x.T @ dh, h.T @ d, dh.sum(axis=0), d.sum(axis=0)))):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    p -= rate * (1 - epoch / epochs) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)

    def parts(self, x: np.ndarray) -> np.ndarray:
        return self.chances(x).argmax(axis=1)

    def probes(self, x: np.ndarray, k: int) -> list[np.ndarray]:
        """The most probable parts of each query that hold the share of probability, and at least k rows besides it."""
        chance = self.chances(x)
        order = np.argsort(-chance, axis=1, kind="stable")
        held = np.cumsum(np.take_along_axis(chance, order, 1), axis=1)
        rows = np.cumsum(self.sizes[order], axis=1)
        enough = (held >= self.share) & (rows > k)
        count = np.where(enough.any(axis=1), enough.argmax(axis=1) + 1, order.shape[1])
        return [o[:c] for o, c in zip(order, count)]


def fit(sample: np.ndarray, k: int, recall: float = RECALL, parts: int = PARTS) -> Router:
    """A router learned from three quarters of the sample; its share of probability comes from the rest."""
    parts = min(parts, 1 << max(0, int(np.log2(max(len(sample) // 32, 1)))))
    router = Router(sample.shape[1] if len(sample) else 1, parts)
    if parts == 1:
        return router
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    graph = neighbour_graph(sample, NEIGHBOURS)
    part = balanced_parts(graph, parts)
    target = np.zeros((len(sample), parts))
    np.add.at(target, (np.repeat(np.arange(len(sample)), graph.shape[1]), part[graph].ravel()), 0.5 / graph.shape[1])
    target[np.arange(len(sample)), part] += 0.5
    asks = np.arange(len(sample)) % 4 == 3
    router.learn(unit[~asks], target[~asks])
    near = neighbour_graph(sample, k)[asks]
    chance, at = router.chances(sample[asks]), router.parts(sample)
    order = np.argsort(-chance, axis=1, kind="stable")
    before = np.cumsum(np.take_along_axis(chance, order, 1), axis=1) - np.take_along_axis(chance, order, 1)
    ahead = np.empty_like(before)
    np.put_along_axis(ahead, order, before, axis=1)
    # A neighbour is found if the probability ahead of its part is below the share.
    needed = np.sort(np.take_along_axis(ahead, at[near], axis=1).ravel())
    router.share = float(min(1.0, needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))] + 1e-9))
    return router


def search_block(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> list[tuple]:
    x, ids, out = stacked(rows["embedding"]), rows["vec_id"].to_numpy(), []
    asked = stacked(queries["embedding"])
    width = min(x.shape[1], asked.shape[1])
    for at in range(0, len(asked), 256):
        for q_id, s in zip(queries["vec_id"][at: at + 256], asked[at: at + 256, :width] @ x[:, :width].T):
            other = np.flatnonzero(ids != q_id)
            keep = other[top_rows(s[other], ids[other], k)]
            out += [(q_id, ids[i], s[i]) for i in keep]
    return out


def nearest(vectors: DataFrame, is_query: Column, k: int, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of (vec_id, embedding) that ``is_query`` picks, against all others."""
    rows = clean(vectors).where(F.exists("embedding", lambda x: x != 0))
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()
    router = fit(stacked(chosen["embedding"]) if len(chosen) else np.zeros((0, 1)), k, recall)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.assign(part=router.parts(stacked(batch["embedding"])))

    index = stored(rows.mapInPandas(route, "vec_id long, embedding array<float>, part int"), "index")
    for r in index.groupBy("part").count().collect():  # at most PARTS rows
        router.sizes[r["part"]] = r["count"]
    blocks = np.maximum(-(-router.sizes // ROWS), 1)
    queries = index.where(is_query).select("vec_id", "embedding")
    query_blocks = max(1, -(-queries.count() // QUERIES))

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                probes = router.probes(stacked(batch["embedding"]), k)
                many = batch.iloc[np.repeat(np.arange(len(batch)), [len(p) for p in probes])]
                yield many.assign(part=np.concatenate(probes).astype("int32"))

    in_part = F.element_at(F.array(*[F.lit(int(b)) for b in blocks]), F.col("part") + 1)
    i, j = F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("int"), F.pmod(F.xxhash64("vec_id"), in_part).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    asked = queries.mapInPandas(probe, "vec_id long, embedding array<float>, part int")
    found = met(
        asked.withColumn("i", i).withColumn("j", every(in_part)),
        index.withColumn("j", j).withColumn("i", every(F.lit(query_blocks))),
        ["part", "i", "j"], lambda q, r: search_block(q, r, k), "double",
    )
    return best(found, k)


def op6_ann_top20(spark: SparkSession, folder: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{folder}/embeddings.parquet"), F.col("vec_id") % 20 == 0, 20)
