"""Near duplicates, components and top-k search against brute force and odd input."""

import collections
import random
import re

import numpy as np
import pytest

from tracklake.llm import components, hamming, neardup

LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute(docs):
    sets = {i: shingles(t) for i, t in docs}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and sets[a] | sets[b]]
    root = roots(ids, links)
    return {i: (len(sets[i]), root[i], root[i] == i) for i in ids}


def corpus(seed):
    """Chains and stars of near copies around the threshold, exact copies, short and empty texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    passage = [word() for _ in range(40)]
    texts = ["", " ", "a b", "A b", "a b c d e", "a b c d e"]
    for _ in range(25):
        base = [word() for _ in range(rng.choice([3, 6, 12, 40, 200]))] + passage * rng.choice([0, 0, 1])
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 14)):
            copy = list(base if rng.random() < 0.7 else texts[-1].split())
            for _ in range(int(len(copy) * rng.choice([0, 0.01, 0.03, 0.04, 0.05, 0.07]))):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    return [(i * 7 % 1009, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("seed", "block_bytes"), [(0, 1 << 20), (1, 1 << 20), (2, 2000)])
def test_near_duplicates_match_brute_force(spark, seed, block_bytes):
    docs = corpus(seed)
    df = spark.createDataFrame([(i, t, False) for i, t in docs], "doc_id long, text string, kept boolean")
    got = neardup.near_duplicates(df, policy=neardup.NearDupPolicy(block_bytes=block_bytes))
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got.collect()} == brute(docs)


def test_near_duplicates_odd_input(spark, odd, none):
    got = neardup.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got}
    assert by[0].n_shingles == by[1].n_shingles == 0 and by[0].kept and by[1].kept
    assert (by[6].component_id, by[7].component_id, by[7].kept) == (6, 6, False)
    assert by[None].component_id is None and by[None].kept
    assert neardup.near_duplicates(none).count() == 0
    kept = neardup.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 1


def test_keep_one_row_of_each_group(spark):
    """Repeated rows, several texts of one id, null ids (copies of each other and of others), and texts without words."""
    base = [f"w{k}" for k in range(60)]
    near = [" ".join(base[:k] + ["changed"] + base[k + 1 :]) for k in (0, 59)]
    other, third = (" ".join(f"{c}{k}" for k in range(60)) for c in "xy")
    rows = [(5, " ".join(base), "b"), (5, " ".join(base), "a"), (5, " ".join(base), "a"), (7, near[0], "c"), (None, " ".join(base), "d"), (None, near[1], "e")]
    rows += [(7, other, "f"), (None, other, "g"), (None, third, "h"), (None, third, "h"), (None, third + " more", "i"), (9, "", "j"), (9, "", "j"), (10, "", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string").repartition(3)
    got = neardup.keep_one_row(df)
    assert got.columns == df.columns
    found = sorted((r.doc_id or 0, r.node) for r in got.collect())
    assert found[1:] == [(5, "a"), (7, "f"), (9, "j"), (10, "k")] and found[0] in [(0, "h"), (0, "i")]
    assert neardup.keep_one_row(df.where("false")).count() == 0


def test_one_text_in_a_third_of_all_rows(spark):
    rows = [(i, f"the same words stand in row after row here {i if i % 3 else ''} {i if i % 3 else ''} {i if i % 3 else ''}") for i in range(300)]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == 0 for i in range(0, 300, 3))


@pytest.mark.parametrize("seed", range(3))
def test_link_sets(seed):
    rng = np.random.default_rng(seed)
    sets = []
    for _ in range(20):
        base = rng.integers(0, 1 << 40, rng.integers(1, 60))
        for _ in range(rng.integers(1, 6)):
            keep = rng.random(len(base)) < rng.choice([0.8, 0.9, 1.0])
            sets.append(np.unique(np.concatenate([base[keep], rng.integers(0, 1 << 40, rng.integers(0, 5))])).astype(np.uint64))
    sets = [s if len(s) else np.array([1], np.uint64) for s in sets]
    node = rng.permutation(len(sets)) + 100
    links = [(int(node[a]), int(node[b])) for a in range(len(sets)) for b in range(a) for k in [len(np.intersect1d(sets[a], sets[b]))] if 100 * k >= 75 * (len(sets[a]) + len(sets[b]) - k)]
    got = neardup.link_sets(node, np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])]), 75)
    assert dict(zip(node.tolist(), got.tolist(), strict=True)) == roots(node.tolist(), links)


def test_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(70)] + [(300, k) for k in range(301, 340)] + [(5, 5), (7, 6)]
    df = spark.createDataFrame([*links, (None, 3)], "a long, b long")
    expected = {n: r for n, r in roots({x for p in links for x in p}, links).items() if any(n in p and p[0] != p[1] for p in links)}
    assert {r.node: r.root for r in components.connected_components(df).collect()} == expected
    assert components.connected_components(df.where("false")).count() == 0


def vectors(seed, n):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(5, 64))
    rows = [(i, [float(x) for x in centers[i % 5] + rng.normal(size=64) * rng.choice([0.01, 0.5, 2])]) for i in range(n)]
    return rows + [(n + k, rows[0][1]) for k in range(n // 3)]  # one code in a quarter of all rows


@pytest.mark.parametrize(("seed", "policy"), [(0, hamming.SearchPolicy()), (1, hamming.SearchPolicy(k=3, segments=8, first_radius=0))])
def test_top_k_matches_brute_force(spark, seed, policy):
    rows = vectors(seed, 300)
    odd = [(9000, None), (9001, []), (9002, [1.0, None] * 32), (None, rows[0][1]), (9050, [1.0] * 10), (3, rows[3][1])]
    df = spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<double>")
    codes = hamming.codes(df)
    got = collections.defaultdict(list)
    for r in hamming.top_k(codes, codes.where("id % 50 = 0"), policy).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r["distance"], r["id"]))
    signs = {i: np.array(v) > 0 for i, v in rows}
    for q in (i for i in signs if i % 50 == 0):
        assert got.pop(q) == sorted((int((signs[q] != s).sum()), i) for i, s in signs.items() if i != q)[: policy.k]
    assert not got


def test_top_k_small_tables(spark):
    few = hamming.codes(spark.createDataFrame([(0, [1.0] * 64), (1, [-1.0] * 64)], "vec_id long, embedding array<double>"))
    assert [tuple(r) for r in hamming.top_k(few, few.where("id = 0")).collect()] == [(0, 1, 1, 64)]
    assert hamming.top_k(few.where("false"), few).count() == 0
    assert hamming.top_k(few, few.where("false")).count() == 0


def test_every_radius_goes_through_the_segments(spark):
    """Codes far from each other and text ids: queries are finished by the bound or by the segments' full width."""
    rng = np.random.default_rng(7)
    rows = [(f"v{i:03d}", [float(x) for x in rng.normal(size=64)]) for i in range(40)]
    codes = hamming.codes(spark.createDataFrame(rows, "vec_id string, embedding array<double>"))
    signs = {i: np.array(v) > 0 for i, v in rows}
    for policy in (hamming.SearchPolicy(k=4, segments=8), hamming.SearchPolicy(k=60, segments=8, first_radius=3)):
        got = collections.defaultdict(list)
        for r in hamming.top_k(codes, codes.where("id in ('v003', 'v017')"), policy).orderBy("query_id", "rank").collect():
            got[r.query_id].append((r["distance"], r["id"]))
        for q in ("v003", "v017"):
            assert got[q] == sorted((int((signs[q] != s).sum()), i) for i, s in signs.items() if i != q)[: policy.k]


def test_longer_vectors_are_folded(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=150)]) for i in range(12)]
    got = {r.id: r.code for r in hamming.codes(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    for i, v in rows:
        total = [sum(v[j::64]) for j in range(64)]
        assert got[i] & (2**64 - 1) == sum(1 << j for j, x in enumerate(total) if x > 0)
