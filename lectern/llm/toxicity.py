"""Toxicity of documents from subword bags.

A word is a bag of its character n-grams (3 to 5 bytes, with marks at both ends),
each hashed to an embedding; the average of a bag goes into a linear softmax.
Embeddings and softmax are trained together in numpy: first on all words of the
sample by how often they come from toxic documents, then on documents, whose logit
is that of their most toxic word. A misspelling that was never seen shares most
n-grams, and so most of the vector, of the word it stands for.

Only the sample is bounded: at most ``SAMPLE`` labelled documents, those of least
hash. Scoring covers every word of every text in one pass without a shuffle: a
linear layer over an average is an average of one number per bucket, so tasks get
the buckets' numbers (1 MB), not the embeddings.

Defined results: a null or empty text is an empty bag with the score of the bias
alone; unlabelled rows and null labels are not learned from; of several labels the
greatest counts; without labels the bias is that of one toxic document in four; a
null doc_id is scored and not held out; repeated rows are kept, other columns ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.words import Words, pieces

SAMPLE = 8_000
WORD_BATCH, BLOCK = 1 << 15, 1 << 20
TEXT_BYTES = 512 << 10
BUCKETS_LOG2, DIM = 18, 8
GRAMS = (3, 4, 5)

_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


class Bags:
    """N-gram buckets of every word of some texts: ``bucket[first[w]:first[w + 1]]`` belong to word w."""

    def __init__(self, words: Words):
        data = words.data
        n = len(data)
        # Marks at the ends of a word are left out; a word of marks alone stays as it is.
        plain = ~_PUNCTUATION[data]
        following = np.minimum.accumulate(np.where(plain, np.arange(n), n)[::-1])[::-1] if n else np.zeros(0, np.int64)
        leading = np.maximum.accumulate(np.where(plain, np.arange(n), -1)) if n else np.zeros(0, np.int64)
        start, end = words.start, words.end
        bare = following[start] >= end if n else np.zeros(0, bool)
        self.start = np.where(bare, start, following[start]) if n else start
        self.end = np.where(bare, end, leading[end - 1] + 1) if n else end
        size = self.end - self.start + 2
        at = np.cumsum(size) - size
        total = int(size.sum())
        text = np.full(total + max(GRAMS), 62, np.uint64)
        inner = size - 2
        to = np.arange(int(inner.sum())) + np.repeat(at + 1 - (np.cumsum(inner) - inner), inner)
        text[to] = data[to - np.repeat(at + 1 - self.start, inner)]
        text[at] = 60
        left = np.repeat(at + size, size) - np.arange(total)
        key = text[:total].copy()
        bucket, order = [], []
        for k in range(1, max(GRAMS)):
            key |= text[k: total + k] << np.uint64(8 * k)
            if k + 1 in GRAMS:
                fits = np.flatnonzero(left >= k + 1)
                hashed = ((key[fits] + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKETS_LOG2)
                bucket.append(hashed.astype(np.int32))
                order.append(fits)
        self.bucket, self.place, self.at = bucket, order, at

    def scores(self, value: np.ndarray) -> np.ndarray:
        """Average of ``value`` over each word's buckets."""
        if not len(self.at):
            return np.zeros(0)
        total = np.zeros(len(self.at))
        count = np.zeros(len(self.at))
        for bucket, place in zip(self.bucket, self.place):
            cut = np.searchsorted(place, self.at)
            some = np.diff(np.r_[cut, len(place)]) > 0
            if some.any():
                total[some] += np.add.reduceat(value[bucket], cut[some])
            count += np.diff(np.r_[cut, len(place)])
        return total / np.maximum(count, 1)

    def flat(self) -> tuple[np.ndarray, np.ndarray]:
        """All buckets, and the word of each."""
        word = np.concatenate([np.searchsorted(self.at, p, "right") - 1 for p in self.place])
        return np.concatenate(self.bucket), word


def distinct_words(words: Words) -> Iterator[list[bytes]]:
    """The distinct words of each text, without marks at their ends."""
    bags, raw = Bags(words), words.data.tobytes()
    for i in range(len(words.counts)):
        lo, hi = words.first[i], words.first[i + 1]
        yield sorted({raw[s:e] for s, e in zip(bags.start[lo:hi].tolist(), bags.end[lo:hi].tolist())})


class Model:
    """One number per bucket, and the bias: all that scoring needs of embeddings and softmax."""

    def __init__(self, value: np.ndarray, bias: float):
        self.value, self.bias = value.astype(np.float32), float(bias)

    def scores(self, texts: pa.Array) -> np.ndarray:
        words = Words(texts, lower=True)
        word = Bags(words).scores(self.value)
        logit = np.zeros(len(words.counts))
        some = words.counts > 0
        if some.any():
            logit[some] = np.maximum.reduceat(word, words.first[:-1][some])
        return 1 / (1 + np.exp(-np.clip(logit + self.bias, -40, 40)))


class _Adagrad:
    def __init__(self, rate: float):
        self.rate, self.seen = rate, 1e-8

    def step(self, x: np.ndarray, slope: np.ndarray) -> None:
        self.seen = self.seen + slope * slope
        x -= self.rate * slope / np.sqrt(self.seen)


def prior_bias(y: np.ndarray) -> float:
    return float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 1.5)))


def blocks(first: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of items that together have about ``limit`` entries, at least one item each; item i has first[i]:first[i + 1]."""
    at = 0
    while at < len(first) - 1:
        to = max(at + 1, int(np.searchsorted(first, first[at] + limit, "right")) - 1)
        yield at, to
        at = to


def _tops(z: np.ndarray, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The largest logit among each document's words, and the first word that has it."""
    top, best = np.zeros(len(first) - 1), np.zeros(len(first) - 1, np.int64)
    for lo, hi in blocks(first):
        some, starts = ids[first[lo]: first[hi]], first[lo:hi] - first[lo]
        mine = z[some]
        top[lo:hi] = np.maximum.reduceat(mine, starts)
        at = np.flatnonzero(mine == np.repeat(top[lo:hi], np.diff(first[lo: hi + 1])))
        best[lo:hi] = some[at[np.searchsorted(at, starts)]]
    return top, best


class Grams:
    """Buckets of distinct words in compressed rows: ``bucket[first[w]:first[w + 1]]``; built a batch of words at a time."""

    def __init__(self, words: pa.Array):
        buckets, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for at in range(0, len(words), WORD_BATCH):
            some = words.slice(at, WORD_BATCH)
            bucket, word = Bags(Words(some.view(pa.large_string()))).flat()
            buckets.append(bucket[np.argsort(word, kind="stable")])
            sizes.append(np.bincount(word, minlength=len(some)))
        self.bucket = np.concatenate(buckets)
        self.first = np.r_[0, np.cumsum(np.concatenate(sizes))].astype(np.int64)
        there = np.zeros(1 << BUCKETS_LOG2, bool)
        there[self.bucket] = True
        self.touched = np.flatnonzero(there)
        place = np.zeros(1 << BUCKETS_LOG2, np.int32)
        place[self.touched] = np.arange(len(self.touched), dtype=np.int32)
        for lo in range(0, len(self.bucket), BLOCK):
            self.bucket[lo: lo + BLOCK] = place[self.bucket[lo: lo + BLOCK]]

    def kept(self, rng: np.random.Generator, drop: float) -> np.ndarray:
        """Which buckets a step uses."""
        keep = np.zeros(len(self.bucket), bool)
        for lo in range(0, len(keep), BLOCK):
            part = keep[lo: lo + BLOCK]
            part[:] = rng.random(len(part), np.float32) >= drop
        return keep

    def parts(self, keep: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """A block of words, its kept buckets, and the word of each as its place in the block."""
        for lo, hi in blocks(self.first):
            mine = keep[self.first[lo]: self.first[hi]]
            word = np.repeat(np.arange(hi - lo, dtype=np.int32), np.diff(self.first[lo: hi + 1]))
            yield lo, hi, self.bucket[self.first[lo]: self.first[hi]][mine], word[mine]


def train(y: np.ndarray, words: pa.Array, ids: np.ndarray, first: np.ndarray, word_steps: int = 12, document_steps: int = 50, drop: float = 0.4, seed: int = 3) -> Model:
    """Embeddings and softmax, trained together on documents given as the places of their distinct words, none of them empty.

    Each step leaves out a share of the n-grams, so no word hangs on a few of them
    and a word with some letters changed keeps enough. A step goes through words and
    documents in blocks: besides 5 bytes an n-gram and 4 a word of a document, memory
    does not grow with the sample.
    """
    bias0 = prior_bias(y)
    grams = Grams(words)
    n, touched = len(words), grams.touched
    rng = np.random.default_rng(seed)
    embedding = rng.normal(0, 0.05, (len(touched), DIM)).astype(np.float32)
    softmax = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32)
    bias = np.array([-bias0 / 2, bias0 / 2])
    steps = _Adagrad(0.3), _Adagrad(0.05), _Adagrad(0.05)

    def logits(keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logit of each word, and the share of each of its buckets."""
        value = embedding @ (softmax[:, 1] - softmax[:, 0])
        z, share = np.zeros(n), np.zeros(n)
        for lo, hi, b, w in grams.parts(keep):
            share[lo:hi] = 1 / np.maximum(np.bincount(w, minlength=hi - lo), 1)
            z[lo:hi] = np.bincount(w, value[b], hi - lo) * share[lo:hi]
        return z, share

    def learn(keep: np.ndarray, share: np.ndarray, residual: np.ndarray) -> None:
        """One step on all parameters; residual: per word, probability less label, weighted."""
        # The slope of an embedding is one number per bucket times the softmax weights.
        per = np.zeros(len(touched))
        for lo, hi, b, w in grams.parts(keep):
            mine = residual[lo:hi]
            used = mine[w] != 0
            if used.any():
                per += np.bincount(b[used], (mine * share[lo:hi])[w[used]], len(touched))
        slope = embedding.T @ per
        both = np.stack([-residual, residual]).sum(axis=1)
        steps[0].step(embedding, (per[:, None] * (softmax[:, 1] - softmax[:, 0])).astype(np.float32))
        steps[1].step(softmax, np.stack([-slope, slope], axis=1).astype(np.float32))
        steps[2].step(bias, both)

    def chance(z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z + bias[1] - bias[0], -40, 40)))

    seen, bad = np.zeros(n), np.zeros(n)
    for lo, hi in blocks(first):
        some = ids[first[lo]: first[hi]]
        seen += np.bincount(some, minlength=n)
        bad += np.bincount(some, np.repeat(y[lo:hi], np.diff(first[lo: hi + 1])), n)
    rate, weight = bad / seen, np.minimum(seen, 20) / len(y)
    for _ in range(word_steps):
        keep = grams.kept(rng, drop)
        z, share = logits(keep)
        learn(keep, share, (chance(z) - rate) * weight)
    for _ in range(document_steps):
        keep = grams.kept(rng, drop)
        z, share = logits(keep)
        top, best = _tops(z, ids, first)
        learn(keep, share, np.bincount(best, (chance(top) - y) / len(y), n))
    value = np.zeros(1 << BUCKETS_LOG2)
    value[touched] = embedding @ (softmax[:, 1] - softmax[:, 0])
    return Model(value, bias[1] - bias[0])


def _calibrated(model: Model, logit: np.ndarray, y: np.ndarray, bias: float) -> Model:
    """Scale and bias by logistic regression, drawn to scale 1 and the rate of the labels as if by one document each."""
    prior = np.array([1.0, bias])
    x = np.stack([logit, np.ones(len(y))], axis=1)

    def loss(at: np.ndarray) -> float:
        z = x @ at
        return float((np.logaddexp(0, z) - y * z).sum() + ((at - prior) ** 2).sum() / 2)

    at = prior
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -40, 40)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.eye(2), x.T @ (p - y) + (at - prior))
        size = 1.0
        while size > 1e-4 and loss(at - size * step) > loss(at):
            size /= 2
        at = at - size * step
    scale = max(at[0], 0.0)
    return Model(model.value * scale, at[1] if scale else bias)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


class Corpus:
    """The distinct words of the sample, and of each document the places of its words among them."""

    def __init__(self, words: pa.ChunkedArray):
        lists = pc.split_pattern(words.cast(pa.large_binary()), b"\n").combine_chunks()
        size = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        coded = pc.list_flatten(lists).dictionary_encode()
        self.words, self.ids = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        self.first = np.r_[0, np.cumsum(size)].astype(np.int64)

    def of(self, chosen: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Words, places and bounds of the documents ``chosen``."""
        size = np.diff(self.first)
        ids = self.ids[np.repeat(chosen, size)]
        there = np.zeros(len(self.words), bool)
        there[ids] = True
        place = (np.cumsum(there) - 1).astype(np.int32)
        return self.words.filter(pa.array(there)), place[ids], np.r_[0, np.cumsum(size[chosen])].astype(np.int64)


def _learn(rows: pa.Table) -> pa.Table:
    """A model of all documents, and the logits of each half by a model of the other; one after another, in one task."""
    y_all = rows.column("toxic").to_numpy() > 0
    bias = prior_bias(y_all)
    # A document without words is counted in the bias alone.
    rows = rows.filter(pc.greater(pc.binary_length(rows.column("words")), 0))
    y, half = (rows.column("toxic").to_numpy() > 0).astype(float), rows.column("half").to_numpy()
    texts = rows.column("words")
    corpus = Corpus(texts)

    def model_of(learn: np.ndarray) -> Model:
        if not learn.any():
            return Model(np.zeros(1 << BUCKETS_LOG2), bias)
        return train(y[learn], *corpus.of(learn))

    logit, label = [], []
    for k in (0, 1):
        judge = np.flatnonzero(half == k)
        if len(judge) and (half != k).any():
            other = model_of(half != k)
            found = texts.take(pa.array(judge)).cast(pa.large_binary()).combine_chunks()
            for at in range(0, len(found), 64):
                p = other.scores(found.slice(at, 64).view(pa.large_string()))
                logit += (np.log(p / (1 - p)) - other.bias).tolist()
            label += y[judge].tolist()
    model = _calibrated(model_of(np.ones(len(y), bool)), np.array(logit), np.array(label), bias)
    return pa.table({"value": pa.array([model.value.tobytes()]), "bias": [model.bias]})


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from at most ``sample`` labelled documents that are not held out.

    Scale and bias of the logit come from two models that each judge the half of the
    documents that the other learned from: with few labels the logits of unseen
    documents are the less certain. The bounded sample is learned from in one task.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long")).agg(F.max("toxic").cast("int").alias("toxic"))
    half = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).cast("int")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).withColumn("half", half)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, limit=TEXT_BYTES):
            found = [b"\n".join(w) for w in distinct_words(Words(batch.column(2), lower=True))]
            yield pa.record_batch({"toxic": batch.column(0), "half": batch.column(1), "words": pa.array(found, pa.binary())})

    # The sample is bounded, so its ids go to where the texts lie.
    rows = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), "doc_id")
    words = rows.select("toxic", "half", "text").mapInArrow(run, "toxic int, half int, words binary")
    learned = words.groupBy().applyInArrow(_learn, "value binary, bias double").collect()
    if not learned:
        return Model(np.zeros(1 << BUCKETS_LOG2), prior_bias(np.zeros(0)))
    return Model(np.frombuffer(learned[0]["value"], np.float32), learned[0]["bias"])


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """The rows with a column ``name`` for the score; it takes the place of one that is there."""
    docs = docs.drop(name)
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, limit=TEXT_BYTES):
            yield batch.append_column(name, pa.array(model.scores(batch.column(text))))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, `{name}` double")


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    scored = score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
