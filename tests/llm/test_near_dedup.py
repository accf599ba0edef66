"""Near-duplicate components against brute force over all pairs."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from sievework.llm import near_dedup, queries


def shingle_set(text, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w)} if 0 < len(w) < words else {tuple(w[i : i + words]) for i in range(len(w) - words + 1)}


def brute(rows, words):
    """n_shingles and component of each row, all pairs that share a shingle being compared."""
    sets = [shingle_set(t, words) for _, t in rows]
    where, parent = defaultdict(list), list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    for i, s in enumerate(sets):
        for j, k in Counter(j for x in s for j in where[x] if j > i).items():
            if 100 * k >= 80 * (len(s) + len(sets[j]) - k):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, len(s), least[root(i)], d == least[root(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in queries.op3_near_dedup(spark, sf).collect())
    assert got == brute(rows, 4)


def test_blocks_chains_and_edges(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_CLASSES", 16)
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 1_500)
    rng, vocabulary = random.Random(3), [f"w{i}" for i in range(400)]
    base = [rng.choice(vocabulary) for _ in range(100)]
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A  b"), (6, "a b c d"), (7, "w " * 30_000)]
    rows += [(100 + i, " ".join(w if rng.random() > rng.choice([0.01, 0.03, 0.06]) else rng.choice(vocabulary) for w in base)) for i in range(120)]
    chain = base[:]
    for i in range(40):  # each is near the one before it only
        chain[(i * 3) % 100] = f"c{i}"
        rows.append((50 - i if i < 20 else 300 + i, " ".join(chain)))
    rows += [
        (500 + i, " ".join(base[:60] + [rng.choice(vocabulary) for _ in range(60)])) for i in range(60)
    ] + [(600, " ".join(base).upper()), (601, " ".join(base))]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, doc string").repartition(3)
    for words in (5,):
        got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(df, words=words).collect())
        assert got == brute(rows, words)
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e f"), (9, "a b c d e f"), (9, "a b c d e f")], "doc_id long, text string")
    assert sorted(
        (str(r["doc_id"]), r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(odd).collect()
    ) == [("9", 9, True), ("9", 9, True), ("None", 9, False)]


def texts_near(rng, base, k):
    """k texts that differ from base in one word each."""
    return [" ".join(base[:i] + [f"q{i}"] + base[i + 1 :]) for i in rng.sample(range(len(base)), k)]


def test_ids_with_several_texts_and_null_ids(spark):
    rng = random.Random(5)
    a, b, c = ([f"{x}{i}" for i in range(120)] for x in "abc")
    rows = [
        (9, " ".join(a)), (9, " ".join(b)), (9, None), (20, texts_near(rng, a, 1)[0]),
        (21, texts_near(rng, b, 1)[0]), (30, " ".join(c)), (None, texts_near(rng, c, 1)[0]), (None, "x y z"),
        (None, "x y z")
    ]
    got = sorted(
        (
            str(r["doc_id"]), r["n_shingles"], r["component_id"], r["kept"]
        ) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    )
    assert got == [
        ("20", 116, 9, False), ("21", 116, 9, False), ("30", 116, 30, True), ("9", 0, 9, True),
        ("9", 116, 9, True), ("9", 116, 9, True), ("None", 1, None, False), ("None", 1, None, False),
        ("None", 116, 30, False)
    ]
    kept = near_dedup.one_of_each(
        spark.createDataFrame([(*r, "clash", 1) for r in rows * 2], "doc_id long, text string, row string, maybe int")
    ).collect()
    assert Counter((r["doc_id"], (r["text"] or "")[:2]) for r in kept) == {(9, "a0"): 1, (9, "b0"): 1, (9, ""): 2, (30, "c0"): 1, (None, "x "): 1}
    assert all((r["row"], r["maybe"]) == ("clash", 1) for r in kept)


def test_groups_over_many_blocks(spark, monkeypatch):
    """A large group of near copies is linked through the heads of its parts; few rows are left to compare across blocks."""
    rng = random.Random(6)
    base, other = [f"a{i}" for i in range(150)], [f"b{i}" for i in range(150)]
    rows = [(i, t) for i, t in enumerate(texts_near(rng, base, 140) + texts_near(rng, other, 100))]
    want = brute(rows, 5)
    monkeypatch.setattr(near_dedup, "BLOCK_CLASSES", 8)
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 1_200)
    seen = []
    monkeypatch.setattr(near_dedup, "staged", lambda df, name, f=near_dedup.staged: (out := f(df, name), seen.append((name, out)))[0])
    got = sorted(
        (
            r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]
        ) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    )
    assert got == want
    assert [n for n, _ in seen].count("within") > 2 and all(out.count() <= 240 for n, out in seen if n == "across")


def test_sorted_chains_take_few_rounds(spark, monkeypatch):
    names = []
    monkeypatch.setattr(near_dedup, "staged", lambda df, name, f=near_dedup.staged: (names.append(name), f(df, name))[1])
    edges = [(i, i + 1) for i in range(1, 2_000)]
    got = {r["node"]: r["root"] for r in near_dedup.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == dict.fromkeys(range(1, 2_001), 1)
    assert names.count("hooks") == 1 and names.count("roots") <= 11
    names.clear()
    # small ids that meet through large ones only
    edges = [(i, 10_000 + i) for i in range(1, 1_000)] + [(i + 1, 10_000 + i) for i in range(1, 1_000)]
    got = {r["root"] for r in near_dedup.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {1} and names.count("hooks") <= 3


def test_posterior_bound_is_the_beta_tail():
    rng = np.random.default_rng(5)
    draws = rng.random(400_000)
    for n, m in near_dedup.least_matches(0.8, 0.01):
        hits = rng.binomial(n, draws)
        assert (draws[hits == m] >= 0.8).mean() == pytest.approx(0.01, abs=0.02) and (draws[hits == m - 2] >= 0.8).mean() < 0.02


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95), (200, 200)]
    got = {r["node"]: r["root"] for r in near_dedup.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 90: 90, 95: 90, 100: 90}
