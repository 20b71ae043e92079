"""Classifier, repetition rules, tokens, packing, license scan against brute force and odd input."""

import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tracklake.llm import classifier, licenses, packing, repetition, tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
LOWER = {c: c + 32 for c in range(65, 91)}


def texts(odd):
    return [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]


def by_text(df, odd):
    """Result rows keyed by id; rows of one id hold the same text here."""
    return {r["doc_id"]: r for r in df.collect()}


def repeat_words(w):
    count = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    return len({j for k in range(len(w) - 4) if count[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)})


def test_repetition_matches_brute_force(odd, none):
    got = by_text(repetition.repetition_quality(odd), odd)
    assert repetition.repetition_quality(odd).count() == odd.count()
    for i, t in texts(odd):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        seen, dup = set(), 0
        for line in (t or "").split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        rep = repeat_words(w)
        failed = len(w) < 10 or 100 * rep > 20 * len(w)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, rep, failed)
        assert not (r.base_failed and r.kept)
    assert repetition.repetition_quality(none).count() == 0
    assert repetition.keep_unrepetitive(odd).columns == odd.columns


def test_repeated_lines_are_rejected(spark):
    lines = [" ".join(f"w{k}x{j}" for j in range(12)) for k in range(8)]
    good, bad = "\n".join(lines), "\n".join([*lines[:3]] * 3)
    got = {r.doc_id: r.kept for r in repetition.repetition_quality(spark.createDataFrame([(1, good), (2, bad)], "doc_id long, text string")).collect()}
    assert got == {1: True, 2: False}


def test_tokens_equal_the_library(spark, odd, none):
    rng = np.random.default_rng(3)
    words = ["the", "Thétion", "x" * 70, "don't", "<|endoftext|>", "中文", "e\u0301a", "12,5", "...", "\u00a0", "\x1d"]
    more = ["".join(str(words[k]) + str(rng.choice([" ", "", "\n", "\t\t"])) for k in rng.integers(0, len(words), 400)) for _ in range(30)]
    docs = odd.select("doc_id", "text").union(spark.createDataFrame([(100 + i, t) for i, t in enumerate([*more, *more])], "doc_id long, text string"))
    t = Tokenizer.from_file(PATH)
    full = {(r.doc_id, r.ids): r for r in tokens.encode_decode(docs, PATH).collect()}
    assert len({k[0] for k in full}) == docs.select("doc_id").distinct().count()
    expected = {}
    for i, text in texts(docs):
        ids = t.encode(text or "", add_special_tokens=False).ids
        packed = np.array(ids, "<u4").tobytes()
        expected[i] = (len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest())
        assert full[(i, packed)].decoded == t.decode(ids, skip_special_tokens=False)
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in tokens.encode_decode(docs, PATH, keep=False).collect()} == expected
    assert tokens.encode_decode(none, PATH).count() == 0


def test_shared_chunks_are_encoded_once():
    store = tokens.ChunkStore(tokens.encoder(PATH))
    rng = np.random.default_rng(5)
    shared = " ".join("".join(rng.choice(list("abcdefg"), 6)) for _ in range(1500))
    docs = [f"{k} start {shared} end {k}" for k in range(20)]
    data = np.frombuffer("".join(docs).encode(), np.uint8)
    store.documents(data, np.concatenate([[0], np.cumsum([len(d) for d in docs])]))
    assert store.asked > 200 and store.encoded < store.asked / 5


def test_packing_is_whole_and_tight(spark, odd, none):
    out = packing.pack_documents(odd, PATH).collect()
    t = Tokenizer.from_file(PATH)
    held = collections.defaultdict(list)
    for r in out:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32) for r in out) == sorted(
        (i or -1, n, n * 2048, len(ids[n * 2048 : (n + 1) * 2048]), zlib.crc32(np.array(ids[n * 2048 : (n + 1) * 2048], "<u4").tobytes()))
        for i, text in texts(odd) for ids in [[*t.encode(text or "", add_special_tokens=False).ids, 0]] for n in range(-(-len(ids) // 2048))
    )
    assert packing.pack_documents(none, PATH).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(2048, (rng.lognormal(6.2, 1.1, 4000)).astype(int) + 1) if seed else np.full(999, 700)
    counts = dict(collections.Counter(lengths.tolist()))
    placed, fill = collections.Counter(), collections.defaultdict(list)
    for length, first, end, sequence, offset in packing.plan(counts, packing.PackingPolicy()):
        for k in range(end - first):
            fill[sequence + k].append((offset, length))
        placed[length] += end - first
    assert placed == counts
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    if seed:
        assert len(fill) <= 1.02 * -(-lengths.sum() // 2048) + 1
    else:
        assert len(fill) == 500  # two in each is the best there is


def test_licenses(spark, odd, none):
    notice = "x y\nLicensed under the Apache License, Version 2.0.\nAll rights reserved. (c)"
    docs = odd.select("doc_id", "text").union(spark.createDataFrame([(50, notice), (51, "Released under the MIT License."), (52, "apache license 3"), (53, "CC-BY cc by NC 4.0 GENERAL public license")], "doc_id long, text string"))
    got = by_text(licenses.scan_licenses(docs), docs)
    for i, t in texts(docs):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        places, labels = [], set()
        for phrase, label in licenses.PHRASES:
            p = phrase.split()
            at = [k for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    assert (got[50].labels, got[51].labels, got[52].labels) == ("apache-2.0,reserved", "mit", "")
    assert licenses.scan_licenses(none).count() == 0


def test_classifier_learns_and_covers_whole_texts(spark, odd, none):
    rng = np.random.default_rng(1)
    good = [" ".join("".join(rng.choice(list("aeionrst"), 5)) for _ in range(60)) for _ in range(150)]
    bad = [" ".join("".join(rng.choice(list("XQZ#%$"), 5)) for _ in range(60)) for _ in range(150)]
    docs = spark.createDataFrame([(i, t, 0.0) for i, t in enumerate(good + bad)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(0, 300, 2)] + [(1, None), (None, 1)], "doc_id long, quality int")
    policy = classifier.ClassifierPolicy(steps=60)
    model = classifier.fit(docs, labels, policy=policy)
    got = {r.doc_id: r for r in classifier.score(docs, model, policy=policy).collect()}
    assert np.mean([got[i].predicted == int(i < 150) for i in range(1, 300, 2)]) > 0.95
    long_tail = spark.createDataFrame([(0, good[0]), (1, good[0] + " " + " ".join(bad[:20]))], "doc_id long, text string")
    a, b = sorted(classifier.score(long_tail, model, policy=policy).collect())
    assert b.score < a.score
    rows = classifier.score(odd, model, policy=policy).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert classifier.score(none, model, policy=policy).count() == 0
    unlearnt = classifier.fit(none, labels.where("false"), policy=policy)
    assert {r.score for r in classifier.score(odd, unlearnt, policy=policy).collect()} == {0.5}
    assert classifier.keep_good(odd, model, policy=policy).columns == odd.columns
