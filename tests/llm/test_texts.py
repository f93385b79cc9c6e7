"""Operators on documents against brute force."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from fixtures import WORD, lower, table, texts
from pyspark.sql import functions as F

from lectern.llm import bpe, class_lm, mixing, near_dedup, passages, toxicity
from lectern.llm.components import connected_components
from lectern.llm.storage import stored
from lectern.llm.words import Words


@pytest.fixture(scope="module")
def rows():
    return texts()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return table(spark, rows).repartition(3).cache()


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def crc(i):
    return zlib.crc32(str(i).encode())


def test_words_and_runs(rows):
    given = [t for _, t, _ in rows]
    words = Words(pa.array(given, pa.string()), lower=True)
    expected = [WORD.findall(lower(t or "")) for t in given]
    found = class_lm.word_strings(words).to_pylist()
    assert found == [w for ws in expected for w in ws] and words.counts.tolist() == list(map(len, expected))
    of = {}
    assert all(of.setdefault(w, h) == h for w, h in zip(found, words.hash.tolist())) and len(set(of.values())) == len(of)
    start, text = words.windows(3)
    runs = {}
    for s, h in zip(start, words.runs(start, 3).tolist()):
        assert runs.setdefault(tuple(found[s: s + 3]), h) == h
    assert len(set(runs.values())) == len(runs) and len(start) == sum(max(0, len(w) - 2) for w in expected)


def test_near_dedup(spark, docs, rows):
    sets = []
    for _, t, _ in rows:
        w = WORD.findall(lower(t or ""))
        sets.append(frozenset(tuple(w[k: k + 5]) for k in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else []))
    n = len(rows)
    up = list(range(n))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(n):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if rows[i][0] is not None and rows[j][0] is not None and both and 100 * both >= 85 * len(sets[i] | sets[j]):
                up[top(i)] = top(j)
    least = defaultdict(list)
    for i in range(n):
        least[top(i)].append(rows[i][0])
    expected = Counter()
    for i in range(n):
        c = None if rows[i][0] is None else min(least[top(i)])
        expected[(rows[i][0], len(sets[i]), c, c == rows[i][0])] += 1
    assert Counter(map(tuple, near_dedup.near_duplicates(docs).collect())) == expected
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("small", [1, 32])
def test_near_dedup_looks_between_components(spark, monkeypatch, small):
    """A bucket's leader links with neither of two texts that link with each other, in small and in large buckets."""
    base = [f"w{i}" for i in range(60)]
    some = [(1, base[:30] + [f"a{i}" for i in range(30)])] + [(10 + k, base[:58] + [f"z{k % 2}", "e"]) for k in range(8)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in some], "doc_id long, text string")
    monkeypatch.setattr(near_dedup, "SMALL", small)
    labels = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs).collect()}
    assert labels == {1: 1, **{10 + k: 10 for k in range(8)}}
    reps = near_dedup.sketches(docs).select(F.col("doc_id").alias("rep"), "n_shingles", "digest", "sig").cache()
    members = near_dedup.band_members(reps)
    sets = near_dedup.class_sets(docs, reps)
    for bytes_of_block in (1 << 20, 1500):
        monkeypatch.setattr(near_dedup, "BLOCK_BYTES", bytes_of_block)
        found = near_dedup.verified(near_dedup.small_bucket_pairs(members, 85), reps, sets, 85, 1e-6)
        found = found.unionByName(near_dedup.large_bucket_links(members, reps, sets, 85, 1e-6))
        labels = near_dedup.connected_components(found).collect()
        assert {(r.node, r.component) for r in labels} == {(k, 10) for k in range(10, 18)}


def test_joining_links_against_all_pairs():
    """Blocks of texts around the threshold come out in the components that all links give."""
    import pandas as pd

    rng = np.random.default_rng(4)
    core = rng.choice(1 << 60, 400, replace=False).astype(np.uint64)
    sets = [np.unique(np.where(rng.random(400) < rng.choice([0.02, 0.07, 0.12]), rng.integers(0, 1 << 60, 400), core).astype(np.uint64)) for _ in range(60)]
    rows = pd.DataFrame({
        "rep": np.arange(60), "n_shingles": [len(s) for s in sets],
        "sig": [near_dedup.signature(s).tobytes() for s in sets], "shingles": [s.tobytes() for s in sets],
    })
    links = near_dedup.joining_links(rows, rows, 85, near_dedup.fewest_matches(0.85, 1e-6))

    def components(edges):
        of = list(range(60))
        for a, b in edges:
            of = [of[min(a, b)] if x == of[max(a, b)] else x for x in of]
        return of

    every = [(a, b) for a in range(60) for b in range(a) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 85 * len(np.union1d(sets[a], sets[b]))]
    group = lambda of: {frozenset(i for i in range(60) if of[i] == c) for c in of}
    assert group(components(links)) == group(components(every)) and len(links) < 60 and len(every) > 100


def test_posterior_bound():
    least = near_dedup.fewest_matches(0.85, 1e-6)
    for n in (32, 96, 192):
        tail = [sum(math.comb(n + 1, k) * 0.85**k * 0.15 ** (n + 1 - k) for k in range(m + 1)) for m in range(n + 1)]
        assert tail[least[n]] >= 1e-6 and (least[n] == 0 or tail[least[n] - 1] < 1e-6)


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 6), (6, 5), (20, 20), (30, 31), (31, 30), (None, 4)] + [(100, k) for k in range(101, 160)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 7: 5, 8: 5, 9: 5, 30: 30, 31: 30, **{k: 100 for k in range(100, 160)}}


def test_substring_dedup(docs, rows):
    first = {}
    split = [WORD.findall(t or "") for _, t, _ in rows]
    for (i, _, _), w in zip(rows, split):
        for k in range(len(w) - 12):
            if i is not None:
                first[tuple(w[k: k + 13])] = min(i, first.get(tuple(w[k: k + 13]), i))
    expected = Counter()
    for (i, _, _), w in zip(rows, split):
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if i is not None and first[tuple(w[k: k + 13])] < i:
                gone[k: k + 13] = [True] * 13
        expected[(i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))] += 1
    assert Counter(map(tuple, passages.remove_repeats(docs).collect())) == expected
    told = Counter(map(tuple, passages.remove_repeats(docs, digest=True).collect()))
    assert told == Counter({(i, n, g, sha(t)): c for (i, n, g, t), c in expected.items()})
    assert passages.remove_repeats(docs.limit(0)).count() == 0
    # Levels double until nothing repeats.
    longest = {}
    length = 13
    while True:
        where = defaultdict(set)
        for (i, _, _), w in zip(rows, split):
            for k in range(len(w) - length + 1):
                if i is not None:
                    where[tuple(w[k: k + length])].add(i)
        again = {i for s in where.values() if len(s) > 1 for i in s}
        if not again:
            break
        longest.update(dict.fromkeys(again, length))
        length *= 2
    assert {r.doc_id: r.words for r in passages.longest_repeats(docs).collect()} == longest


def test_bpe(docs, rows):
    tiktoken = pytest.importorskip("tiktoken")
    path, pattern = bpe.default_files()
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    known = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    expected, plain = Counter(), Counter()
    for i, t, _ in rows:
        ids = known.encode_ordinary(t or "")
        expected[(i, len(ids), sha(" ".join(map(str, ids))), sha(t or ""))] += 1
        plain[(i, tuple(ids), t or "")] += 1
    assert Counter(map(tuple, bpe.round_trip(docs).collect())) == expected
    encoded = bpe.encode(docs)
    ids = Counter((r.doc_id, tuple(r.ids)) for r in encoded.collect())
    raw = Counter((r.doc_id, bytes(r.raw).decode()) for r in bpe.decode(encoded).collect())
    assert ids == Counter((i, x) for i, x, _ in plain.elements()) and raw == Counter((i, t) for i, _, t in plain.elements())
    assert bpe.round_trip(docs.limit(0)).count() == 0


def test_bpe_short_and_long_words_agree(monkeypatch):
    codec = bpe.Codec(*bpe.default_files())
    words = {"abcabcabcab", "aaaaaaaaaaa", "thethethe", "Überüber", "zxqzxqzxq", "0123456789"}
    codec.learn(words)
    short = dict(codec.known)
    codec.known.clear()
    monkeypatch.setattr(bpe, "LONG", 0)
    codec.learn(words)
    assert codec.known == short
    monkeypatch.setattr(bpe, "REMEMBER", 3)
    assert codec.encode(["abcabcabcab thethethe", "zxqzxqzxq"]) == bpe.Codec(*bpe.default_files()).encode(["abcabcabcab thethethe", "zxqzxqzxq"])


@pytest.mark.parametrize("turn_rows", [1 << 20, 1000])
def test_bpe_long_words(monkeypatch, tmp_path, turn_rows):
    """Words of every shape against a tokenizer library, also where a query does one turn and its rows start the next."""
    tiktoken = pytest.importorskip("tiktoken")
    path, pattern = bpe.default_files()
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    known = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    monkeypatch.setattr(bpe, "TURN_ROWS", turn_rows)
    monkeypatch.chdir(tmp_path)
    rng = np.random.default_rng(8)
    made = lambda letters, n: "".join(rng.choice(list(letters), n))
    words = [made(letters, n) for letters in ("abcdefghijklmnopqrstuvwxyz", "ab", "x", "etaoin", "あいう", "-=") for n in (65, 128, 700)]
    words += ["the" * 300, "".join(made("aeinrst", 5) * 9 for _ in range(9)), made("abcdefghijklmnopqrstuvwxyz", 20_000), "ab" * 5000]
    with bpe.Codec(path, pattern) as codec:
        assert codec.encode(words) == [" ".join(map(str, known.encode_ordinary(w))) for w in words]
    assert codec.db is None and not codec.known and not list(tmp_path.iterdir())


def test_mixing_of_one_hot_doc_id(spark, monkeypatch):
    """One doc_id, or none, in all rows: slices split them, and the mix is the same however often it is made."""
    monkeypatch.setattr(mixing, "SLICE", 50)
    monkeypatch.setattr(mixing, "TASK_SLOTS", 16)
    rows = [(None if k % 2 else 7, f"w{k} " * 40, f"s{k % 2}") for k in range(400)]
    docs = table(spark, rows).repartition(3).cache()
    got = mixing.mix_sizes(docs, block=4).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mix_sizes(docs, block=4).collect()))
    taken = defaultdict(int)
    for r in got:
        taken[r.source_size, r.target] += r.taken
        assert r.size == 40 and r.taken <= 80
    assert all(abs(n - target) < 100 for (_, target), n in taken.items()) and len(got) == 400


def test_mixing(spark, docs, rows):
    assert all((np.sort(mixing.permuted(np.arange(n), n, (1, 2))) == np.arange(n)).all() for n in (1, 2, 3, 17, 1000))
    got = mixing.mix_sizes(docs, block=4).collect()
    again = mixing.mix_sizes(docs.repartition(7), block=4).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again)) and len(got) == len(rows)
    sizes = [len(WORD.findall(t or "")) for _, t, _ in rows]
    total = defaultdict(int)
    for (_, _, s), n in zip(rows, sizes):
        total[s] += n
    names = sorted((s for s in total if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, free = {}, set(names)
    while True:
        left = 1.5 * sum(sizes) - sum(2 * total[s] for s in names if s not in free)
        target = {s: left * weight[s] / sum(weight[x] for x in free) if s in free else 2.0 * total[s] for s in names}
        over = {s for s in free if target[s] > 2 * total[s]}
        if not over:
            break
        free -= over
    source = defaultdict(set)
    for i, _, s in rows:
        source[i].add(s)
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        s = next(s for s in source[r.doc_id] if total[s] == r.source_size)
        assert r.target == pytest.approx(target[s])
        taken[s] += r.taken
    for s in names:
        assert abs(taken[s] - target[s]) <= 4 + 0.02 * target[s]
    mixed = mixing.mix_documents(docs, block=4).collect()
    assert sum(len(WORD.findall(r.text)) for r in mixed) == sum(taken.values())
    assert mixing.mix_documents(docs).columns == docs.columns
    assert mixing.mix_sizes(docs.limit(0)).count() == 0
    none = mixing.mix_sizes(spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")).collect()
    assert [tuple(r) for r in none] == [(1, 0, 0, 0.0, 0)]


def test_class_lm(docs, rows):
    tokens = [[*WORD.findall(lower(t or "")), 0] for _, t, _ in rows]
    counts = Counter()
    for (i, _, _), w in zip(rows, tokens):
        if i is None or crc(i) % 7 != 2:
            counts.update(w)
    n, v = sum(counts.values()), len(counts)
    train = docs.where(~class_lm.held_out(F.col("doc_id")))
    model, table, total, kinds = class_lm.fit(train)
    assert (total, kinds) == (n, v)
    got = class_lm.score(docs, model, table, total, kinds).collect()
    expected = Counter((i, len(w), sum(counts[x] > 0 for x in w), round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 6)) for (i, _, _), w in zip(rows, tokens))
    assert Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == expected
    # The model is a distribution: transitions of a class sum to one, and so do the words of a class and one unseen word.
    assert np.allclose((10**model.step).sum(axis=1), 1)
    per = defaultdict(float)
    units = model.units.of(Words(pa.array([" ".join(w for w in counts if w)])))[1]
    for w, u in zip([w for w in counts if w], units):
        per[model.of[u]] += (counts[w] + 1) / 10 ** model.divisor[model.of[u]]
    for c, share in per.items():
        assert share + 10 ** -model.divisor[c] == pytest.approx(1)
    empty = class_lm.fit(docs.limit(0))
    assert class_lm.score(docs.limit(0), *empty).count() == 0
    unseen = class_lm.score(docs, *empty).collect()
    assert all(r.n_known == 0 and math.isfinite(r.score) for r in unseen) and len(unseen) == len(rows)


def test_class_lm_rare_words_move(spark, monkeypatch):
    """A word past the commonest ones goes where its own bigrams put it, whatever its ending, listed or not."""
    common, rare, rng = class_lm.UNITS // 2, 300, random.Random(3)
    kinds = {"a": [f"a{i}x" for i in range(common)], "b": [f"b{i}x" for i in range(common)]}
    texts = [" ".join(rng.choice(kinds["ab"[k % 2]]) for k in range(200)) for _ in range(300)]
    # Both kinds of rare words have the same endings and counts; they differ in their neighbours alone.
    for i in range(rare):
        for _ in range(3):
            a, b = rng.choice(kinds["a"]), rng.choice(kinds["b"])
            texts.append(f"{a} v{i}q {a} {b} u{i}q {b} {a}")  # v stands for b, u for a
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    scores, seen = [], []
    for listed in (class_lm.LISTED, class_lm.UNITS + 100):
        monkeypatch.setattr(class_lm, "LISTED", listed)
        fitted = class_lm.fit(docs)
        probes = ["a1x v7q a2x b3x u8q b4x", "a1x u7q a2x b3x v8q b4x", "a1x v299q u298q b3x", "a1x u299q v298q b3x", "a1x v5q zzz u6q b1x"]
        got = class_lm.score(spark.createDataFrame(list(enumerate(probes)), "doc_id long, text string"), *fitted).collect()
        scores.append([r.score for r in sorted(got, key=lambda r: r.doc_id)])
        seen.append({r["word"]: (r["n"], r["class"]) for r in fitted[1].collect()})
        assert fitted[2:] == (sum(len(t.split()) + 1 for t in texts), len({w for t in texts for w in t.split()}) + 1)
        assert np.allclose((10 ** fitted[0].step).sum(axis=1), 1)
    assert seen[0] == seen[1] == {w: (n, seen[0][w][1]) for w, n in Counter(w for t in texts for w in t.split()).items()}
    u, v = (Counter(seen[0][f"{k}{i}q"][1] for i in range(rare)) for k in "uv")
    assert sum((u & v).values()) <= 5, (u, v)
    # Right places are likelier than wrong ones, and a bounded list changes no score.
    assert scores[0][0] > scores[0][1] + 2 and scores[0][2] > scores[0][3] + 1
    assert scores[0] == pytest.approx(scores[1], abs=1e-9)


def test_class_lm_gives_back_its_shuffles(spark, monkeypatch):
    """Fitting leaves no shuffle of words or pairs of words behind, only sums over classes."""
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(20_000)}" for _ in range(100)) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(class_lm, "LISTED", class_lm.UNITS + 100)
    jvm = spark._jvm

    def held():
        files = jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f.getName(): f.length() for f in jvm.scala.jdk.javaapi.CollectionConverters.asJava(files) if f.getName().startswith("shuffle_")}

    before = held()
    class_lm.fit(docs)
    assert sum(size for name, size in held().items() if name not in before) < 200_000


def test_stored_sends_batches_of_bounded_bytes(spark):
    """Texts of a megabyte reach Python some at a time, and the session's settings are as before."""

    def run(batches):
        for batch in batches:
            yield pa.record_batch({"rows": pa.array([batch.num_rows]), "bytes": pa.array([batch.nbytes])})

    before = dict(spark.conf.getAll)
    texts = spark.range(40, numPartitions=1).select(F.repeat(F.lit("ab cd ef "), 110_000).alias("text"))
    sizes = stored(texts.mapInArrow(run, "rows long, bytes long"), "sizes").collect()
    assert sum(r.rows for r in sizes) == 40 and max(r.bytes for r in sizes) <= 16 << 20
    assert dict(spark.conf.getAll) == before


def test_class_lm_tally():
    group, key = np.array([0, 0, 1, 1, 1]), np.array([5, 5, 7, 5, 7])
    for factor in (1, 1 << 59):  # the second does not fit one number with its group
        of, keys, times = class_lm._tally(group, key * factor)
        assert sorted(zip(of.tolist(), (keys // factor).tolist(), times.tolist())) == [(0, 5, 2), (1, 5, 1), (1, 7, 2)]
    assert all(len(x) == 0 for x in class_lm._tally(group[:0], key[:0]))


def test_exchange_finds_classes():
    """Units that follow each other in a cycle of three groups come out as three classes."""
    rng = np.random.default_rng(0)
    size = class_lm.UNITS + class_lm.ENDINGS + 1
    group = rng.integers(0, 3, 60)
    bigrams = np.zeros((size, size), np.int64)
    for a in range(60):
        for b in range(60):
            if group[b] == (group[a] + 1) % 3:
                bigrams[a, b] = rng.integers(20, 40)
    of = class_lm.exchange(bigrams, classes=4)
    assert all(len({of[u] for u in range(60) if group[u] == g}) == 1 for g in range(3)) and len(set(of[:60])) == 3


def test_toxicity_held_out(spark, docs):
    syllables = "ka lo mi ren tu fa es on".split()
    rng = np.random.default_rng(5)
    data, labels = [], []
    for i in range(500):
        w = ["".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(rng.integers(5, 80))]
        bad = i % 4 == 0
        if bad:
            w.insert(int(rng.integers(0, len(w))), str(rng.choice(["grumblewort", "Snarfblat!", "zogwitter,"])))
        data.append((i, " ".join(w)))
        labels.append((i, 1 if bad else 0))
    frame = spark.createDataFrame(data, "doc_id long, text string")
    known = spark.createDataFrame([*labels, (3, None), (None, 1), (4, 0)], "doc_id long, toxic int")
    model = toxicity.fit(frame, known)
    got = {r.doc_id: r.score for r in toxicity.score(frame, model).collect()}
    held = [i for i in range(500) if crc(i) % 5 == 0]
    assert sum((got[i] >= 0.5) == (i % 4 == 0) for i in held) >= 0.97 * len(held)
    # A misspelling that no document holds is nearer to the word than clean words are.
    odd, clean = model.scores(pa.array(["grumblew0rt", "kalomi rentu"]))
    assert odd > 5 * clean
    scored = toxicity.score(docs, model)
    assert scored.columns.count("score") == 1 and scored.count() == docs.count() and scored.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    nothing = toxicity.fit(docs.limit(0), known.limit(0))
    assert {round(r.score, 6) for r in toxicity.score(docs, nothing).collect()} == {0.25}


def test_toxicity_learns_from_the_whole_sample(spark):
    """A toxic word that only stands in the second half of the 8,000 documents of least hash is learned."""
    ids = spark.range(10_000).where(~toxicity.held_out(F.col("id"))).orderBy(F.xxhash64("id"), "id").limit(8_000)
    rng = np.random.default_rng(7)
    data, labels = [], []
    for rank, r in enumerate(ids.collect()):
        w = ["".join(rng.choice("ka lo mi ren tu fa es on".split(), 3)) for _ in range(6)]
        bad = rank % 10 == 0
        data.append((r.id, " ".join([*w, "zogwitter" if rank >= 4_000 else "grumblewort"] if bad else w)))
        labels.append((r.id, int(bad)))
    frame = spark.createDataFrame(data, "doc_id long, text string")
    model = toxicity.fit(frame, spark.createDataFrame(labels, "doc_id long, toxic int"))
    early, late, clean = model.scores(pa.array(["kalomi grumblewort", "kalomi zogwitter", "kalomi rentufa"]))
    assert early > 0.5 and late > 0.5 and clean < 0.5


def test_toxicity_in_blocks(monkeypatch):
    """Small blocks of words, n-grams and documents give the model of one block."""
    words = [b"kalo", b"rentu", b"grumblewort", b"fa", b"esonmi", b"\xc3\xbc7"]
    rng = np.random.default_rng(2)
    bags = [sorted({words[k] for k in rng.choice([0, 1, 3, 4, 5], 3)} | ({words[2]} if i % 3 == 0 else set())) for i in range(40)]
    texts = pa.chunked_array([pa.array([b"\n".join(b) for b in bags], pa.binary())])
    corpus = toxicity.Corpus(texts)
    assert [[corpus.words[j].as_py() for j in corpus.ids[a:b]] for a, b in zip(corpus.first, corpus.first[1:])] == bags
    y = (np.arange(40) % 3 == 0).astype(float)
    whole = toxicity.train(y, *corpus.of(np.ones(40, bool)))
    monkeypatch.setattr(toxicity, "WORD_BATCH", 2)
    monkeypatch.setattr(toxicity.blocks, "__defaults__", (5,))
    parts = toxicity.train(y, *corpus.of(np.ones(40, bool)))
    assert np.allclose(whole.value, parts.value, atol=1e-3) and abs(whole.bias - parts.bias) < 1e-3
