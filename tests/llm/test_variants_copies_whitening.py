"""Operators 11 to 13 against brute force, with nulls, ties, repeated rows, long texts, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tracklake.llm import exact, spelling, whitening


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def counted(rows, policy):
    words = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if policy.drop_every and h % policy.drop_every == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            words[run] += 1
    return {w: n for w, n in words.items() if len(w) >= policy.min_length and n >= policy.min_count}


def brute_variants(rows, policy):
    words = counted(rows, policy)
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {w: min((v for v in near[w] if words[v] >= policy.dominance * n), key=lambda v: (-words[v], v), default=None) for w, n in words.items()}
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, n, len(near[w]), form[w], words.get(form[w]), root))
    return out


def found_variants(frame, policy):
    got = [tuple(r) for r in spelling.variants(frame, policy).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_near_words_of_few_letters_are_all_found_once(spark):
    rng = random.Random(3)
    words = {"".join(rng.choice("abé") for _ in range(rng.choice([7, 7, 8, 8, 9, 10]))) for _ in range(900)}
    words |= {"a" * n for n in range(7, 14)} | {"ab" * n for n in range(4, 24)} | {"ab" * n + "a" for n in range(4, 24)}
    long = "".join(rng.choice("abcdefgh") for _ in range(90))
    words |= {long, long[1:], long[:-1], long[:40] + "z" + long[41:], long[:77] + long[78:], long + "h"}
    frame = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    pairs = [(r.a, r.b) for r in spelling.near_pairs(frame).collect()]
    assert len(pairs) == len(set(map(frozenset, pairs)))
    expected = {frozenset((a, b)) for a in words for b in words if a < b and one_edit(a, b)}
    assert set(map(frozenset, pairs)) == expected and len(expected) > 500


@pytest.mark.parametrize("drop_every", [31, 3, 0])
def test_forms_and_roots(spark, drop_every):
    rng = random.Random(drop_every)
    base = ["Grundlage", "ciudadano", "elevenths", "quarterly", "Überraschung", "señoritas"]
    rows = []
    for i in range(120):
        text = " ".join(rng.choice(base) for _ in range(60))
        if i % 9 == 0:
            text += " grundlagen grundlagenx Elevenths. eleventhz  eleventhzz"
        rows.append((i % 100, text))
    rows += [(None, "Quarterly quarterly"), (7, None), (8, ""), (9, "short words only"), (5, "ciudadano×ciudadano÷ciudadano")]
    frame = spark.createDataFrame([(*r, "w", 1, 2) for r in rows], "doc_id long, text string, word string, n long, key int")
    policy = spelling.SpellingPolicy(drop_every=drop_every)
    assert found_variants(frame, policy) == brute_variants(rows, policy)


def test_store_that_is_handed_on_and_pieces_give_the_same_counts(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, " ".join("".join(rng.choice("abc") for _ in range(8)) for _ in range(300))) for i in range(20)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    policy = spelling.SpellingPolicy(store=200)
    got = {r.word: r.n for r in spelling.vocabulary(frame, policy).collect()}
    assert got == counted(rows, policy)
    monkeypatch.setattr(spelling, "PIECE", 5)
    for _, text in rows:
        assert [w for piece in spelling.runs(text + "  ÀÉ Zé") for w in piece] == re.findall("[a-zÀ-ÿ]+", text + "  ÀÉ zé")


def test_odd_texts(spark, odd, none):
    policy = spelling.SpellingPolicy()
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert found_variants(odd, policy) == brute_variants(rows, policy)
    assert spelling.variants(none).collect() == []
    assert exact.exact_duplicates(none).collect() == []


def test_chain_of_forms(spark):
    words = [("abcdefg", 3), ("abcdefgh", 30), ("abcdefghi", 300), ("abcdefghij", 3000), ("zbcdefghij", 3000), ("bcdefgh", 31)]
    rows = [(0, " ".join(w for w, n in words for _ in range(n)))]
    policy = spelling.SpellingPolicy(drop_every=0)
    got = found_variants(spark.createDataFrame(rows, "doc_id long, text string"), policy)
    assert got == brute_variants(rows, policy)
    assert {r[5] for r in got if r[0] == "abcdefg"} == {"abcdefghij"}


def brute_copies(rows):
    groups = {}
    for i, text in rows:
        groups.setdefault(re.sub("[\x20\x09-\x0d]+", " ", text or ""), []).append(i)
    out = []
    for text, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i))
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, ids[0], len(ids), k == 0, sha) for k, i in enumerate(ids)]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("width", "bits"), [(4, 3), (40, 2), (1, 1), (300, 3)])
def test_copies_by_any_tree(spark, odd, width, bits):
    rng = random.Random(width)
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    rows += [(rng.randrange(500), "the hot text\tof a third") for _ in range(200)]
    rows += [(rng.randrange(300), rng.choice(["a b", "a  b", "a\n\r b ", " a b", "ab", "", " ", "\x0b", None])) for _ in range(400)]
    frame = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, kept int, run string").repartition(13)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(width))
    try:
        got = sorted((tuple(r) for r in exact.exact_duplicates(frame, exact.MergePolicy(fan_in_bits=bits)).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == brute_copies(rows)


def test_colliding_digests_stay_apart(spark, monkeypatch):
    """With one digest for all texts, length and SHA-256 alone tell them apart."""
    import pyspark.sql.functions as functions

    monkeypatch.setattr(functions, "xxhash64", lambda *_: functions.lit(5).cast("long"))
    rows = [(i, "same" if i % 3 else f"text {i % 10}") for i in range(60)]
    got = sorted((tuple(r) for r in exact.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == brute_copies(rows)


def test_identifiers_of_another_type(spark):
    frame = spark.createDataFrame([("b", "x y"), ("a", "x  y"), (None, "z")], "name string, body string")
    got = {r.name: (r.keep_id, r.kept) for r in exact.exact_duplicates(frame, id_col="name", text_col="body").collect()}
    assert got == {"b": ("a", False), "a": ("a", True), None: (None, True)}


def brute_whitening(vectors, k=4):
    x = np.array([np.floor(256 * np.asarray(v, float)).astype(np.int64) for v in vectors])
    distinct = np.unique(x, axis=0)
    n, sums = len(distinct), distinct.sum(0)
    centred = distinct - sums / n
    e, w = np.linalg.eigh(centred.T @ centred / n)
    e, w = e[::-1], w[:, ::-1]
    deviation = [sum((n * int(c) - int(s)) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
    return n, deviation, (x - sums / n) @ w[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


def test_whitening_matches_a_dense_solution(spark):
    rng = np.random.default_rng(1)
    vectors = (rng.standard_normal((700, 24)) @ np.diag(np.linspace(1, 0.2, 24)) + 0.3).astype(np.float32)
    rows = [(i, v.tolist(), "x", 1) for i, v in enumerate(vectors)] + [(900 + i, vectors[3].tolist(), None, None) for i in range(300)]
    odd = [None, [None] * 24, [float("nan")] + [0.0] * 23, [float("inf")] + [0.0] * 23, [1.0] * 23 + [None]]
    rows += [(2000 + i, v, None, None) for i, v in enumerate(odd)] + [(None, vectors[5].tolist(), None, None)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, x string, n int").repartition(7)
    got = whitening.whiten(frame).collect()
    kept = [r for r in rows if r[0] is None or r[0] < 2000]
    n, deviation, white, explained = brute_whitening([r[1] for r in kept])
    by = {(r.vec_id, r.component): r for r in got}
    assert len(got) == 4 * len(kept) and len(by) == len(got) and {r.n for r in got} == {n} == {700}
    for k in range(4):
        mine = np.array([by[r[0], k + 1].whitened for r in kept])
        sign = np.sign(mine @ white[:, k])
        assert np.abs(mine * sign - white[:, k]).max() < 1e-9
        assert abs(by[kept[0][0], k + 1].explained / explained[k] - 1) < 1e-12
    assert [by[r[0], 1].deviation for r in kept] == deviation
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-12


def basis_of(spark, x):
    frame = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    policy = whitening.WhiteningPolicy(scale=1)
    return whitening.fit(whitening.whole_numbers(frame, policy), policy)[0]


def test_equal_eigenvalues_and_low_rank(spark):
    cross = np.concatenate([np.eye(6), -np.eye(6)]) * 100
    basis = basis_of(spark, cross)
    assert np.allclose(basis.values, 100**2 / 6) and np.allclose(basis.components.T @ basis.components, np.eye(4))
    two = np.outer(np.arange(20), [3, 0, 0, 1, 0]) + np.outer(np.arange(20) % 3, [0, 5, 0, 0, 2])
    basis = basis_of(spark, two)
    assert len(basis.values) == 2 and np.allclose(basis.values, np.linalg.eigvalsh(np.cov(two.T, bias=True))[::-1][:2])
    # two equal largest values and a start that sees one of their directions alone would miss the other
    twin = np.concatenate([np.diag([50, 50, 9, 4, 2, 1]), -np.diag([50, 50, 9, 4, 2, 1])])
    assert np.allclose(basis_of(spark, twin).values, np.array([50, 50, 9, 4]) ** 2 / 6)


def test_stops_early_only_where_proven(spark):
    rng = np.random.default_rng(2)
    x = np.floor(rng.standard_normal((400, 40)) * np.concatenate([[90000, 50000, 20000, 9000], np.full(36, 3)]))
    basis = basis_of(spark, x)
    e = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1][:4]
    assert np.abs(basis.values / e - 1).max() < 1e-10


def test_tables_without_variance_and_vectors_of_unlike_lengths(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, []), (2, [])]):
        out = whitening.whiten(spark.createDataFrame(rows, schema))
        assert out.collect() == [] and out.columns[0] == "vec_id"
    rows = [(1, [1.0, 2.0, 3.0]), (2, [1.0]), (3, []), (4, [0.5, 9.0])]
    got = whitening.whiten(spark.createDataFrame(rows, schema)).collect()
    _, deviation, _, _ = brute_whitening([v + [0.0] * (3 - len(v)) for _, v in rows])
    assert {r.vec_id: r.deviation for r in got} == dict(zip([1, 2, 3, 4], deviation, strict=True))


def test_huge_entries(spark):
    rows = [(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [0.0, 3.0])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert {r.deviation for r in got if r.vec_id != 3} == {None} and all(np.isfinite(r.whitened) for r in got)
