"""Merkle manifest, filter audit and set join against brute force."""

import hashlib
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from fixtures import WORD, lower, table, texts
from pyspark.sql import functions as F

from lectern.llm import filter_audit, merkle, set_join


@pytest.fixture(scope="module")
def rows():
    return texts()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return table(spark, rows).repartition(3).cache()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(*fields):
    return sha("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def climb(digests, tampered):
    """Root, and per leaf the siblings from left to right, level by level, with the root that its tampered digest leads to."""
    level, at = list(digests), list(range(len(digests)))
    paths, folded = [[] for _ in digests], list(tampered)
    while len(level) > 1:
        for k, i in enumerate(at):
            run = level[i // 3 * 3: i // 3 * 3 + 3]
            left, right = run[: i % 3], run[i % 3 + 1:]
            paths[k] += left + right
            folded[k] = sha("".join([*left, folded[k], *right]))
            at[k] = i // 3
        level = [sha("".join(level[i: i + 3])) for i in range(0, len(level), 3)]
    return level[0] if level else None, paths, folded


def manifest(rows):
    by_source = defaultdict(list)
    for i, t, s in rows:
        even = i is not None and zlib.crc32(str(i).encode()) % 2 == 0
        whole = leaf(i, s, "en", len(t or ""), t)
        changed = leaf(i, s, "en", len(t or ""), t.replace("\n", "") if t is not None and even else t)
        by_source[s].append(((i is not None, i or 0, whole), i, whole, changed))
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in sources:
        members = sorted(by_source[s])
        trees.append((members, *climb([m[2] for m in members], [m[3] for m in members])))
    out = []
    subroots = [t[1] for t in trees]
    for k, (members, subroot, paths, folded) in enumerate(trees):
        for member, path, own in zip(members, paths, folded):
            root, above, ends = climb(subroots, [own if j == k else d for j, d in enumerate(subroots)])
            out.append((member[1], member[2], subroot, root, sha("".join(path + above[k])), ends[k], ends[k] == root))
    return out


def merkle_rows(spark, rows, tmp_path):
    folder = str(tmp_path)
    table(spark, rows).repartition(3).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    found = merkle.op11_merkle(spark, folder).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return [tuple(r) for r in found.collect()]


def test_merkle_against_a_plain_climb(spark, rows, tmp_path):
    found = merkle_rows(spark, rows, tmp_path)
    expected = manifest(rows)
    assert Counter(found) == Counter(expected)
    assert {v for *_, v in found} == {True, False}


@pytest.mark.parametrize("sizes", [(1,), (3,), (4,), (1, 1), (10, 1, 3, 28)])
def test_merkle_shapes(spark, sizes, tmp_path):
    rows = [(100 * k + i, f"line {i}\nline {k}", f"s{k}") for k, n in enumerate(sizes) for i in range(n)]
    assert Counter(merkle_rows(spark, rows, tmp_path)) == Counter(manifest(rows))


def test_merkle_of_an_empty_table(spark, tmp_path):
    assert merkle_rows(spark, [], tmp_path) == []


def test_merkle_keeps_the_session_setting(spark, rows, tmp_path):
    before = spark.conf.get(merkle.ROW_LIMIT)
    merkle_rows(spark, rows[:5], tmp_path)
    assert spark.conf.get(merkle.ROW_LIMIT) == before


def failures(rows):
    """Per row: which of A to E it fails, with every text compared to those of smaller ids."""
    out = []
    for i, t, _ in rows:
        t = t or ""
        w = WORD.findall(t)
        copy = any(j is not None and i is not None and j < i and (u or "") == t for j, u, _ in rows)
        out.append((
            len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), any(c in "#$%&*|" for c in t), copy,
        ))
    return out


def audit(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    bad = {i for i, _, x in labels if x == 1 and i is not None}
    fails = failures(rows)
    out = {}
    for part in {s or "" for _, _, s in rows}:
        own = [(i, f) for (i, _, s), f in zip(rows, fails) if (s or "") == part]
        total = Counter()
        for order in permutations("ABCDE"):
            left = list(own)
            for step, x in enumerate(order, 1):
                k = "ABCDE".index(x)
                gone = [(i, f) for i, f in left if f[k]]
                before = sum(f[k] for _, f in own) - len(gone)
                left = [(i, f) for i, f in left if not f[k]]
                total[x] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), before, sum(f[k] and sum(f) == 1 for _, f in own), sum(i in good for i, _ in gone), sum(i in bad for i, _ in gone),
                ]
        for (p, order, step), values in out.items():
            if p == part:
                values.append(total[order[step - 1]])
    return {(*key, *values) for key, values in out.items()}


def labelled(spark, labels):
    return spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


LABELS = [(i, i % 2, (i + 1) % 3 % 2) for i in range(0, 215, 2)] + [(None, 1, 1), (1, None, 1), (1, 1, None), (1, 0, 0)]


def test_filter_audit_against_running_the_filters(spark, rows):
    extra = [(300, "A# b " * 150, None), (301, "A# b " * 150, ""), (302, " ".join(f"w{i}" for i in range(300)), "s0"), (303, "É à " + "word " * 300, "s1")]
    given = [*rows, *extra]
    marked = filter_audit.masks(table(spark, given).repartition(4))
    found = filter_audit.interactions(filter_audit.weights(marked, labelled(spark, LABELS))).collect()
    assert {tuple(r) for r in found} == audit(given, LABELS) and len(found) == 600 * len({s or "" for _, _, s in given})


def test_masks_of_long_and_odd_texts():
    given = ["", None, "a " * 2_000_000, "é" * 98 + "AB", "é" * 97 + "ABC", " ".join(f"w{i % 100}" for i in range(200)), "x y|", "\x1f \x0b"]
    found = filter_audit.text_mask(pa.array(given, pa.string()))
    expected = [sum(f << k for k, f in enumerate(fs[:4])) for fs in failures([(k, t, None) for k, t in enumerate(given)])]
    assert found.tolist() == expected


def test_filter_audit_of_nothing(spark):
    marked = filter_audit.masks(table(spark, []))
    assert filter_audit.interactions(filter_audit.weights(marked, labelled(spark, LABELS))).collect() == []
    places = np.argsort(np.array([[1, 0]]), axis=1).T
    assert filter_audit.removal_steps(np.array([0, 1, 2, 3]), places).tolist() == [[np.inf], [1], [0], [0]]


def sets_of(rows):
    for _, t, _ in rows:
        w = WORD.findall(lower(t or ""))
        yield frozenset(tuple(w[k: k + 5]) for k in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])


def components(rows, percent):
    sets = list(sets_of(rows))
    up = {i: i for i, _, _ in rows if i is not None}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for x, (i, _, _) in enumerate(rows):
        for y, (j, _, _) in enumerate(rows[:x]):
            both = len(sets[x] & sets[y])
            if i is not None and j is not None and both and 100 * both >= percent * len(sets[x] | sets[y]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return Counter((i, len(s), None if i is None else find(i)) for (i, _, _), s in zip(rows, sets))


@pytest.mark.parametrize("percent", [80, 60])
def test_set_join_against_all_pairs(spark, docs, rows, percent):
    found = set_join.jaccard_components(docs, percent).collect()
    assert Counter(tuple(r) for r in found) == components(rows, percent)


def chained(n=70):
    """Texts each like the next but not like those further on, so that a component spans several groups."""
    words = [f"w{i}" for i in range(400 + 8 * n)]
    return [(i, " ".join(words[8 * i: 8 * i + 100]), "s0") for i in range(n)] + [(1000 + i, " ".join([*words[:60], f"x{i}"]), "s1") for i in range(60)]


@pytest.mark.parametrize("members, common", [(32, 32), (2, 1 << 30), (3, 2)])
def test_set_join_in_small_groups(spark, monkeypatch, members, common):
    monkeypatch.setattr(set_join, "MEMBERS", members)
    monkeypatch.setattr(set_join, "COMMON_LEAST", common)
    monkeypatch.setattr(set_join, "BLOCK_BYTES", 2000)
    rows = chained() + [(2000, " ".join(f"w{i}" for i in range(8, 108)), None), (5, "another text that has the same id as one before", "s0")]
    found = set_join.jaccard_components(table(spark, rows).repartition(2), 80).collect()
    assert Counter(tuple(r) for r in found) == components(rows, 80)


def test_set_join_of_nothing(spark):
    assert set_join.jaccard_components(table(spark, [])).collect() == []
    assert {tuple(r) for r in set_join.jaccard_components(table(spark, [(1, None, "s"), (None, "a b c d e f", "s")])).collect()} == {(1, 0, 1), (None, 2, None)}


def test_a_closed_group_is_not_opened():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 1 << 63, 40, dtype=np.uint64)) for _ in range(4)]
    group = set_join.Group.of(sets)
    assert group.partners(sets[2], 80).tolist() == [2] and group.partners(sets[2][:33], 80).tolist() == [2]
    assert group.partners(sets[2][:31], 80).tolist() == []
    again = set_join.Group.read({"union": group.union.tobytes(), "bits": group.packed(), "sizes": group.sizes.tolist()})
    assert (again.bits == group.bits).all() and (again.member(1) == sets[1]).all()


def test_prefix_puts_common_tokens_last():
    tokens = np.sort(np.random.default_rng(3).integers(0, 1 << 63, 50, dtype=np.uint64))
    bucket = (tokens >> np.uint64(32)).astype(np.uint32)
    common = np.sort(bucket[:45])
    rank = np.arange(45)[::-1].copy()
    found = set_join.prefix(tokens, 80, common, rank)
    assert len(found) == 17 and set(found[:5]) == set(tokens[45:]) and (found[5:] == tokens[:45][::-1][:12]).all()
    assert (set_join.prefix(tokens, 80, np.zeros(0, np.uint32), np.zeros(0, int)) == tokens[:17]).all()
