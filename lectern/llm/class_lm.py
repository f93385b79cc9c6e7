"""Class-based bigram language model in the manner of Brown, with exchange clustering.

P(text) is the product over its tokens of P(class | class before) * P(word | class);
a text begins and ends with the end token. Classes are found in two steps.

The frame: each of the ``UNITS`` commonest words is a unit, and all other words start in ``ENDINGS`` units by
their last two bytes. Exchange clustering moves units between classes as long as that raises the likelihood of the unit
bigrams, which are counted over all training texts; their table, of (UNITS +
ENDINGS + 1) ** 2 counts at most, is all that the driver sees of them.

The rest: every other word of the training texts, however rare, then goes to the class that its own bigrams, all of
them, make likeliest under the frame; ties go to the smaller class. Spark deals the words' neighbours by word and
each task settles the words it was dealt, first the listed words (below), then all others, which see the listed ones
in their new classes. The transitions are counted anew with the classes that all words ended in.
Only a word that no training text holds keeps the class of its ending: it has no bigrams.

Counts and classes cover every word of every training text and stay distributed. The
``LISTED`` commonest words (a bounded list) are looked up where the texts lie; each
other word meets its count and class by a join, and by a second one where two of them follow each other.

Smoothing: one is added to each count of a class's words and for one unseen word;
transitions are drawn to the classes' shares by one observation.

Defined results: a null text is empty and has the end token alone; a null doc_id is
not held out; repeated rows are kept and count; without training texts every word is
unseen and all classes are as likely. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.storage import stored
from lectern.llm.words import Words, pieces

UNITS, ENDINGS, CLASSES = 1024, 512, 64
LISTED = 65_536
TEXT_BYTES = 8 << 20


def word_strings(words: Words) -> pa.Array:
    """All words of the texts, in order."""
    size = words.end - words.start
    at = np.r_[0, np.cumsum(size)].astype(np.int64)
    inside = np.repeat(words.start - at[:-1], size) + np.arange(at[-1])
    return pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(at), pa.py_buffer(words.data[inside])])


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, limit=TEXT_BYTES):
            found = word_strings(Words(batch.column(0), lower=True)).value_counts()
            yield pa.record_batch({"word": found.field("values").cast(pa.string()), "n": found.field("counts")})

    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Units:
    """Unit of each word: its place among the listed words, or its ending. Unit UNITS is the end token.

    Endings come before the listed words past the UNITS commonest, whose units are the last.
    """

    def __init__(self, listed: list[str]):
        self.listed = pa.array(listed, pa.large_string())

    def of(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Place among the listed words (-1: not there) and unit of every word."""
        place = pc.fill_null(pc.index_in(word_strings(words), self.listed), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        return place, np.where(place < 0, endings(words), np.where(place < UNITS, place, place + ENDINGS + 1))

    def frame(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """The same, with the unit of the ending for all but the UNITS commonest."""
        place, unit = self.of(words)
        return place, np.where(unit < UNITS, unit, endings(words))


def endings(words: Words) -> np.ndarray:
    """The unit of each word's last two bytes."""
    last = words.data[words.end - 1].astype(np.int64)
    before = np.where(words.end - words.start > 1, words.data[np.maximum(words.end - 2, 0)], 0)
    return UNITS + 1 + (last * 31 + before * 17) % ENDINGS


def with_ends(words: Words, unit: np.ndarray, end: int = UNITS) -> tuple[np.ndarray, np.ndarray]:
    """Units of all texts with the end token behind each, and where each text begins."""
    first = words.first + np.arange(len(words.first))
    out = np.full(first[-1], end, np.int64)
    out[np.arange(len(unit)) + np.repeat(np.arange(len(words.counts)), words.counts)] = unit
    return out, first[:-1]


def before(units: np.ndarray, first: np.ndarray, end: int = UNITS) -> np.ndarray:
    """The unit before each; before a text stands the end token."""
    out = np.r_[end, units[:-1]]
    out[first[first < len(units)]] = end
    return out


def unit_bigrams(texts: DataFrame, units: Units) -> DataFrame:
    """(prev, next, n) over all texts, in units of the frame."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = UNITS + ENDINGS + 1
        for batch in pieces(batches, limit=TEXT_BYTES):
            words = Words(batch.column(0), lower=True)
            now, first = with_ends(words, units.frame(words)[1])
            pair, n = np.unique(before(now, first) * width + now, return_counts=True)
            yield pa.record_batch({"prev": pa.array(pair // width), "next": pa.array(pair % width), "n": pa.array(n)})

    return texts.mapInArrow(run, "prev long, next long, n long").groupBy("prev", "next").agg(F.sum("n").alias("n"))


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(bigrams: np.ndarray, classes: int = CLASSES, rounds: int = 12) -> np.ndarray:
    """Class of each unit, by exchange: each unit in turn goes to the class that makes the bigrams likeliest.

    The end token keeps a class of its own, the last. Ties go to the smaller class.
    """
    n = len(bigrams)
    total = bigrams.sum(axis=0) + bigrams.sum(axis=1)
    order = np.argsort(-total, kind="stable")
    order = order[order != UNITS]
    of = np.full(n, classes - 1)
    of[order] = np.arange(n - 1) % (classes - 1)
    own = np.diag(bigrams).astype(float)
    right, left = bigrams.astype(float), bigrams.T.astype(float).copy()
    np.fill_diagonal(right, 0)
    np.fill_diagonal(left, 0)
    table = np.zeros((classes, classes))
    np.add.at(table, (of[:, None], of[None, :]), bigrams)
    for _ in range(rounds):
        moved = 0
        for u in order:
            if not total[u]:
                continue
            a = of[u]
            after, prior = np.bincount(of, right[u], classes), np.bincount(of, left[u], classes)

            def shift(c: int, sign: int) -> None:
                table[c] += sign * after
                table[:, c] += sign * prior
                table[c, c] += sign * own[u]

            shift(a, -1)
            now = _f(table)
            rows, columns = table.sum(axis=1), table.sum(axis=0)
            d = np.diag(table)
            gain = (_f(table + after[None, :]) - now).sum(axis=1) + (_f(table + prior[:, None]) - now).sum(axis=0)
            gain += _f(d + after + prior + own[u]) + _f(d) - _f(d + after) - _f(d + prior)
            gain -= _f(rows + after.sum() + own[u]) - _f(rows) + _f(columns + prior.sum() + own[u]) - _f(columns)
            gain[classes - 1] = -np.inf
            best = int(np.argmax(gain))
            if gain[best] <= gain[a] + 1e-9 * max(1.0, abs(gain[a])):
                best = a
            moved += best != a
            of[u] = best
            shift(best, 1)
        if not moved:
            break
    return of


# A neighbour in one byte: its class, plus CLASSES if it is not listed, plus 2 * CLASSES if it stands behind.
SIDES = 4 * CLASSES


def neighbours(texts: DataFrame, units: Units, of: np.ndarray, listed: bool) -> DataFrame:
    """(word, sides) for the listed words past the UNITS commonest, or for all that are not listed.

    A row per piece of text that holds the word, two bytes per occurrence. ``of``: class of each
    unit; the listed words are still seen by their endings, the others see them with their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, limit=TEXT_BYTES):
            words = Words(batch.column(0), lower=True)
            place, unit = units.frame(words) if listed else units.of(words)
            now, first = with_ends(words, of[unit] + CLASSES * (place < 0), CLASSES - 1)
            left = before(now, first, CLASSES - 1)
            at = np.arange(len(unit)) + np.repeat(np.arange(len(words.counts)), words.counts)
            moving = np.flatnonzero(place >= UNITS if listed else place < 0)
            spelt = word_strings(words).take(pa.array(moving)).dictionary_encode()
            code = spelt.indices.to_numpy()
            at = at[moving][np.argsort(code, kind="stable")]
            sides = np.stack([left[at], 2 * CLASSES + now[at + 1]], axis=1).astype(np.uint8)
            ends = np.r_[0, 2 * np.cumsum(np.bincount(code, minlength=len(spelt.dictionary)))].astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(spelt.dictionary), [None, pa.py_buffer(ends), pa.py_buffer(sides)])
            yield pa.record_batch({"word": spelt.dictionary.cast(pa.string()), "sides": packed})

    return texts.mapInArrow(run, "word string, sides binary")


def settled(sides: DataFrame, likely: np.ndarray) -> DataFrame:
    """(word, n, class): for each word the class that its neighbours make likeliest. ``likely``: log10 by class of the neighbour, before and behind, and class.

    Rows without a word hold how often (n) a class has a neighbour, as class * SIDES + neighbour.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = np.zeros((CLASSES, SIDES), np.int64)

        def best(words: pa.Array, seen: np.ndarray) -> pa.RecordBatch:
            # Rounded, so that equal classes tie whatever the order of the sum.
            near = seen.reshape(-1, 2, 2, CLASSES).sum(axis=2).reshape(-1, 2 * CLASSES)
            chosen = np.argmax(np.round(near @ likely, 9), axis=1)
            order = np.argsort(chosen, kind="stable")
            at = np.flatnonzero(np.r_[True, np.diff(chosen[order]) > 0])
            met[chosen[order[at]]] += np.add.reduceat(seen[order], at)
            return pa.record_batch({"word": words, "n": pa.array(seen.sum(axis=1) // 2), "class": pa.array(chosen, pa.int64())})

        # Rows come in order of their word; the last word of a batch may go on in the next.
        last, held = None, None
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                words = part.column(0)
                new = np.r_[True, pc.not_equal(words[1:], words[:-1]).to_numpy(zero_copy_only=False)]
                group = np.cumsum(new) - 1
                size = pc.binary_length(part.column(1)).to_numpy()
                codes = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8)
                seen = np.bincount(np.repeat(group, size) * SIDES + codes, minlength=(group[-1] + 1) * SIDES).reshape(-1, SIDES)
                heads = words.take(pa.array(np.flatnonzero(new)))
                if last is not None:
                    if heads[0].as_py() == last:
                        seen[0] += held
                    else:
                        yield best(pa.array([last], pa.string()), held[None])
                if len(heads) > 1:
                    yield best(heads[:-1], seen[:-1])
                last, held = heads[-1].as_py(), seen[-1].copy()
        if last is not None:
            yield best(pa.array([last], pa.string()), held[None])
        some = np.flatnonzero(met)
        yield pa.record_batch({"word": pa.nulls(len(some), pa.string()), "n": pa.array(met.ravel()[some]), "class": pa.array(some, pa.int64())})

    return sides.repartition("word").sortWithinPartitions("word").mapInArrow(run, "word string, n long, class long")


def transitions(table: np.ndarray) -> np.ndarray:
    """log10 of P(class | class before), drawn to the classes' shares by one observation."""
    share = (table.sum(axis=0) + 1) / (table.sum() + len(table))
    return np.log10((table + share[None, :]) / (table.sum(axis=1) + 1)[:, None])


class Model:
    """What scoring needs where the texts lie: the listed words with counts, classes, and two tables of logarithms."""

    def __init__(self, units: Units, counts: np.ndarray, of: np.ndarray, step: np.ndarray | None, divisor: np.ndarray | None, ends: int):
        self.units, self.counts, self.of, self.step, self.divisor, self.ends = units, counts, of, step, divisor, ends


class Pairs:
    """The tokens of a piece of text with their classes, and which are not listed (cold)."""

    def __init__(self, words: Words, model: Model):
        self.place, unit = model.units.of(words)
        now, self.first = with_ends(words, unit)
        self.now, self.prior = model.of[now], model.of[before(now, self.first)]
        cold = np.flatnonzero(self.place < 0)
        spelt = word_strings(words).take(pa.array(cold)).dictionary_encode()
        self.names, code = spelt.dictionary.cast(pa.string()), np.full(len(self.place), -1, np.int64)
        code[cold] = spelt.indices.to_numpy()
        self.start = np.zeros(len(self.names), np.int64)
        self.start[code[cold]] = model.of[unit[cold]]
        self.code, _ = with_ends(words, code, -1)
        self.left = before(self.code, self.first, -1)
        self.listed = (self.code < 0) & (self.left < 0)

    def alone(self, group: np.ndarray) -> tuple[np.ndarray, dict[str, pa.Array]]:
        """Each different cold word of a group of tokens with the classes of its listed neighbours (null: cold), and times."""
        at = np.flatnonzero(self.code >= 0)
        near = np.where(self.left[at] < 0, self.prior[at], CLASSES), np.where(self.code[at + 1] < 0, self.now[at + 1], CLASSES)
        width = CLASSES + 1
        of, key, times = _tally(group[at], (self.code[at] * width + near[0]) * width + near[1])
        word, sides = key // width**2, (key // width % width, key % width)
        left, right = (pa.array(x, mask=x == CLASSES) for x in sides)
        return of, {"word": self.names.take(pa.array(word)), "c": pa.array(self.start[word]), "left": left, "right": right, "times": pa.array(times)}

    def together(self, group: np.ndarray | None = None) -> tuple[np.ndarray, dict[str, pa.Array]]:
        """Each different pair of cold words in a group of tokens, the classes of their endings, and times."""
        at, width = np.flatnonzero((self.code >= 0) & (self.left >= 0)), len(self.names)
        of, key, times = _tally(np.zeros(len(at), np.int64) if group is None else group[at], self.left[at] * width + self.code[at])
        out = {"times": pa.array(times)}
        for word, kind, which in (("word", "c", key // max(1, width)), ("next", "nc", key % max(1, width))):
            out |= {word: self.names.take(pa.array(which)), kind: pa.array(self.start[which])}
        return of, out


def _tally(group: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different (group, key) and how often each occurs."""
    if len(key) and (int(group.max()) + 1) * (int(key.max()) + 1) < 1 << 62:
        span = int(key.max()) + 1
        both, times = np.unique(group * span + key, return_counts=True)
        return both // span, both % span, times
    # Too large for one number: keys are numbered first.
    keys, which = np.unique(key, return_inverse=True)
    both, times = np.unique(group * max(1, len(keys)) + which, return_counts=True)
    return both // max(1, len(keys)), keys[both % max(1, len(keys))], times


def _classed(rows: DataFrame, table: DataFrame, word: str, kind: str, spread: Column | None = None) -> DataFrame:
    """The rows with the count ``n`` and the class of a cold word; one without a class keeps that of its ending.

    ``spread`` spreads rows without a word; it holds a space, as no word does.
    """
    known = table.select(F.col("word").alias("_w"), F.col("class").alias("_c"), F.col("n").alias("n"))
    key = F.col(word) if spread is None else F.coalesce(word, spread)
    return rows.drop("n").join(known, key == F.col("_w"), "left").withColumn(kind, F.coalesce("_c", kind)).drop("_w", "_c")


def class_bigrams(texts: DataFrame, model: Model, table: DataFrame) -> np.ndarray:
    """How often a class follows a class where both words are listed, or neither."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, limit=TEXT_BYTES):
            pairs = Pairs(Words(batch.column(0), lower=True), model)
            n = np.bincount(pairs.prior[pairs.listed] * CLASSES + pairs.now[pairs.listed], minlength=CLASSES**2)
            pair = np.flatnonzero(n)
            none = pa.nulls(len(pair), pa.string())
            yield pa.record_batch({"word": none, "c": pa.array(pair // CLASSES), "next": none, "nc": pa.array(pair % CLASSES), "times": pa.array(n[pair])})
            cold = pairs.together()[1]
            yield pa.record_batch({name: cold[name] for name in ("word", "c", "next", "nc", "times")})

    pairs = texts.mapInArrow(run, "word string, c long, next string, nc long, times long")
    spread = F.concat_ws(" ", F.lit(""), "c", "nc")
    met = _classed(_classed(pairs, table, "word", "c", spread), table, "next", "nc", spread)
    # Stored, small as it is: the shuffles behind it, of all pairs of words, then go with it.
    counted = stored(met.groupBy("c", "nc").agg(F.sum("times").alias("n")), "class-bigrams").toArrow()
    out = np.zeros((CLASSES, CLASSES), np.int64)
    out[counted.column("c").to_numpy(), counted.column("nc").to_numpy()] = counted.column("n").to_numpy()
    return out


def fit(texts: DataFrame) -> tuple[Model, DataFrame, int, int]:
    """The model, the table of words with their counts and classes, and the number of tokens and of distinct tokens."""
    spark = texts.sparkSession
    texts = texts.select(F.coalesce("text", F.lit("")).alias("text"))
    order = [F.desc("n"), F.col("word")]
    listed = stored(word_counts(texts).orderBy(*order).limit(LISTED), "word-counts").orderBy(*order).toArrow()
    words, counts = listed.column("word").to_pylist(), listed.column("n").to_numpy().astype(np.int64)
    units = Units(words)

    pairs = stored(unit_bigrams(texts, units), "unit-bigrams").toArrow()
    width = UNITS + ENDINGS + 1
    bigrams = np.zeros((width, width), np.int64)
    bigrams[pairs.column("prev").to_numpy(), pairs.column("next").to_numpy()] = pairs.column("n").to_numpy()
    of = exchange(bigrams)
    ends = int(bigrams[:, UNITS].sum())
    frame = np.zeros((CLASSES, CLASSES), np.int64)
    np.add.at(frame, (of[:, None], of[None, :]), bigrams)

    # What a class before and a class behind say for each class; that of the end token takes no words.
    step = transitions(frame)
    ahead = step - np.log10(frame.sum(axis=0) + 1)[None, :]
    likely = np.r_[ahead, step.T]
    likely[:, CLASSES - 1] = -1e9
    moved = stored(settled(neighbours(texts, units, of, listed=True), likely).where("word IS NOT NULL"), "listed-classes").toArrow()
    moved = dict(zip(moved.column("word").to_pylist(), moved.column("class").to_pylist()))
    of = np.r_[of, [moved[w] for w in words[UNITS:]]].astype(np.int64)
    own = np.r_[of[:UNITS], of[UNITS + ENDINGS + 1:]][: len(words)]
    common = spark.createDataFrame(pa.table({"word": pa.array(words, pa.string()), "n": pa.array(counts), "class": pa.array(own)}))
    rest = stored(settled(neighbours(texts, units, of, listed=False), likely).unionByName(common), "word-classes", codec="zstd")
    table = rest.where("word IS NOT NULL")
    model = Model(units, counts, of, None, None, ends)

    after = class_bigrams(texts, model, table)
    # Where a listed and a cold word meet, settling the cold one has counted it.
    for r in rest.where("word IS NULL").groupBy("class").agg(F.sum("n").alias("n")).collect():
        kind, near = divmod(r["class"], SIDES)
        if near % (2 * CLASSES) < CLASSES:
            after[(near, kind) if near < CLASSES else (kind, near - 2 * CLASSES)] += r["n"]
    kinds = np.zeros(CLASSES, np.int64)
    for r in table.groupBy("class").agg(F.count(F.lit(1)).alias("kinds")).collect():
        kinds[r["class"]] = r["kinds"]
    kinds[CLASSES - 1] = int(ends > 0)
    model.step = transitions(after)
    model.divisor = np.log10(after.sum(axis=0) + kinds + 1)
    return model, table, int(after.sum()), int(kinds.sum())


def score(docs: DataFrame, model: Model, counts: DataFrame, tokens: int, kinds: int) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score for each row of (doc_id, text)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    told = (
        "row long, doc_id long, n_tokens long, known long, top double, rest double, word string, c long, left long, right long, "
        "next string, nc long, times long"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        log_end = np.log10(m.ends + 1)
        log_count = np.log10(np.r_[m.counts, 0] + 1.0)
        for batch in pieces(batches, "text"):
            row = batch.column(0).to_numpy(zero_copy_only=False)
            words = Words(batch.column(2), lower=True)
            pairs = Pairs(words, m)
            steps = np.where(pairs.listed, m.step[pairs.prior, pairs.now] - m.divisor[pairs.now], 0.0)
            text = np.repeat(np.arange(len(row)), words.counts)
            n = len(row)
            # Place -1 reads the last entry, which is that of no count.
            top = np.bincount(text, log_count[pairs.place], n) + log_end
            known = np.bincount(text, pairs.place >= 0, n).astype(np.int64) + int(m.ends > 0)
            yield _rows(n, {
                "row": pa.array(row), "doc_id": batch.column(1), "n_tokens": pa.array(words.counts + 1), "known": pa.array(known),
                "top": pa.array(top), "rest": pa.array(np.add.reduceat(steps, pairs.first)),
            })
            group = np.repeat(np.arange(n), words.counts + 1)
            for of, cold in (pairs.alone(group), pairs.together(group)):
                if len(of):
                    yield _rows(len(of), {"row": pa.array(row[of])} | cold)

    kinds_of = {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}
    fields = [part.split(" ") for part in told.split(", ")]

    def _rows(n: int, given: dict[str, pa.Array]) -> pa.RecordBatch:
        return pa.record_batch({name: given[name].cast(kinds_of[kind]) if name in given else pa.nulls(n, kinds_of[kind]) for name, kind in fields})

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    told_rows = stored(rows.mapInArrow(run, told), "scored-words", codec="zstd")
    step = [(i * CLASSES + j, float(model.step[i, j] - model.divisor[j])) for i in range(CLASSES) for j in range(CLASSES)]
    step = F.broadcast(spark.createDataFrame(step, "_k long, _d double"))

    def stepped(rows: DataFrame, prev: str, now: str, name: str) -> DataFrame:
        return rows.join(step.withColumnRenamed("_d", name), F.col(prev) * CLASSES + F.col(now) == F.col("_k"), "left").drop("_k")

    none = F.lit(0.0)
    alone = _classed(told_rows.where("next IS NULL"), counts, "word", "c", F.concat(F.lit(" "), F.col("row").cast("string")))
    alone = stepped(stepped(alone, "left", "c", "_l"), "c", "right", "_r").select(
        "row", "doc_id", "n_tokens", F.coalesce("known", F.when(F.col("n") > 0, F.col("times")), F.lit(0)).alias("known"),
        F.coalesce(F.col("top"), F.col("times") * F.log10(F.col("n") + F.lit(1.0)), none).alias("top"),
        F.coalesce("rest", F.col("times") * (F.coalesce("_l", none) + F.coalesce("_r", none))).alias("rest"),
    )
    both = _classed(_classed(told_rows.where("next IS NOT NULL"), counts, "word", "c"), counts, "next", "nc")
    both = stepped(both, "c", "nc", "_b").select(
        "row", "doc_id", "n_tokens", F.lit(0).cast("long").alias("known"), none.alias("top"), (F.col("times") * F.col("_b")).alias("rest")
    )
    sums = alone.unionByName(both).groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.sum("n_tokens").alias("n_tokens"), F.sum("known").alias("n_known"), F.sum("top").alias("top"), F.sum("rest").alias("rest"),
    )
    return sums.select(
        "doc_id", "n_tokens", "n_known",
        (F.col("top") - F.col("n_tokens") * F.log10(F.lit(float(tokens + kinds + 1)))).alias("base_score"),
        (F.col("top") + F.col("rest")).alias("score"),
    )


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


def op2_class_lm(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    model, counts, tokens, kinds = fit(docs.where(~held_out(F.col("doc_id"))).select("text"))
    scored = score(docs, model, counts, tokens, kinds)
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known",
        F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )
