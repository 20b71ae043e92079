"""Scores that depend on their text alone, and words that only their bytes tell apart."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tracklake.llm import _text, classifier, neardup, packing, repetition, tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
SWAP = {97: 98, 98: 97}


def thue_morse(bits):
    text = "a"
    for _ in range(bits):
        text += text.translate(SWAP)
    return text


@pytest.fixture(scope="module", params=[10, 11, 12, 13])
def twins(request):
    one = thue_morse(request.param)
    return one, one.translate(SWAP)


def column(texts):
    return _text.text_bytes(pa.array(texts))


def test_tokens_of_regular_words(spark, twins):
    a, b = twins
    texts = [f"{a} {b} {a}", b, a, f"{b}{a} x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    t = Tokenizer.from_file(PATH)
    ids = [t.encode(x, add_special_tokens=False).ids for x in texts]
    got = {r.doc_id: r.ids_sha256 for r in tokens.encode_decode(df, PATH, keep=False).collect()}
    assert got == {i: hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest() for i, x in enumerate(ids)}
    packed = {(r.doc_id, r.start): (r.length, r.ids_crc32) for r in packing.pack_documents(df, PATH).collect()}
    for i, x in enumerate(ids):
        whole = [*x, 0]
        for at in range(0, len(whole), 2048):
            assert packed.pop((i, at)) == (len(whole[at : at + 2048]), zlib.crc32(np.array(whole[at : at + 2048], "<u4").tobytes()))
    assert not packed


def test_equal_hashes_of_different_words_are_found_out(monkeypatch):
    monkeypatch.setattr(_text, "range_hashes", lambda data, start, end: (end - start).astype(np.uint64))
    words = tokens.WordEncoder(PATH)
    t = Tokenizer.from_file(PATH)
    for text in ("one two six", "ten one", "two"):
        ids, ends = words.encode(*column([text]))
        assert ids.tolist() == t.encode(text, add_special_tokens=False).ids and ends.tolist() == [0, len(ids)]


def test_sets_and_lines_of_regular_words(twins):
    a, b = twins
    value, first = neardup.shingle_sets(*column([a, b]), 5)
    assert first.tolist() == [0, 1, 2] and value[0] != value[1]
    found = repetition.measure_slice(*column([f"{a}\n{b}", f"{a}\n{a}"]), repetition.RepetitionPolicy())
    assert found["n_dup_lines"].tolist() == [0, 1]


def forward(text, m, p):
    """The network for one text, by loops."""
    data = list(text.encode())
    half = p.chunk // 2
    data += [256] * (max(1, -(-len(data) // half)) * half - len(data))
    at = [np.concatenate([m.table[x] for x in data[i : i + p.stride]]) for i in range(0, len(data), p.stride)]
    at.append(np.tile(m.table[256], p.stride))
    answers = np.array([x @ m.near + y @ m.far for x, y in zip(at, at[1:], strict=False)])
    per = half // p.stride
    chunks = [answers[i : i + 2 * per].max(0) for i in range(0, max(1, len(answers) - per), per)]
    live = np.maximum(np.array(chunks) + m.bias, 0)
    return 1 / (1 + np.exp(-(live.mean(0) @ m.mean_weight + live.max(0) @ m.max_weight + m.offset)))


@pytest.fixture(scope="module")
def network():
    rng = np.random.default_rng(2)
    texts = ["".join(chr(int(c)) for c in rng.integers(97, 123 if k % 2 else 110, int(rng.integers(0, 900)))) for k in range(60)] + ["", "a", "é" * 400]
    labels = np.array([k % 2 for k in range(len(texts))])
    return texts, labels, classifier.train(*column(texts), labels, classifier.ClassifierPolicy(steps=40))


def test_scores_depend_on_the_text_alone(network):
    texts, _, m = network
    p = classifier.ClassifierPolicy()
    together = classifier.score_slice(*column(texts), m, p)
    order = np.random.default_rng(4).permutation(len(texts))
    assert np.abs(classifier.score_slice(*column([texts[k] for k in order]), m, p) - together[order]).max() < 2e-6
    for text, score in zip(texts, together, strict=True):
        assert abs(classifier.score_slice(*column([text]), m, p)[0] - score) < 2e-6
        assert abs(forward(text, m, p) - score) < 1e-5


def test_windows_of_a_long_text(network, monkeypatch):
    texts, labels, m = network
    p = classifier.ClassifierPolicy()
    whole, slope = classifier.score_slice(*column(texts), m, p), classifier.gradients(*column(texts), labels, m, p)
    monkeypatch.setattr(classifier, "_WINDOW", 3)
    assert np.abs(classifier.score_slice(*column(texts), m, p) - whole).max() < 2e-6
    for k, v in classifier.gradients(*column(texts), labels, m, p).items():
        assert np.allclose(v, slope[k], atol=1e-5)


def test_gradients_are_slopes(network):
    texts, labels, m = network
    p = classifier.ClassifierPolicy()

    def loss():
        got = np.array([forward(t, m, p) for t in texts])
        return -np.mean(np.where(labels == 1, np.log(got), np.log(1 - got)))

    slope = classifier.gradients(*column(texts), labels, m, p)
    for name, at in (("table", (256, 1)), ("table", (100, 0)), ("near", (3, 5)), ("far", (9, 7)), ("bias", (2,)), ("max_weight", (4,)), ("mean_weight", (6,))):
        values = getattr(m, name)
        kept = values[at]
        values[at] = kept + 2e-3
        more = loss()
        values[at] = kept - 2e-3
        less = loss()
        values[at] = kept
        assert abs((more - less) / 4e-3 - slope[name][at]) < 0.05 * abs(slope[name][at]) + 2e-3


def brute_sequences(lengths):
    """Best-fit decreasing, piece by piece."""
    rooms = []
    for s in sorted(lengths, reverse=True):
        fits = [k for k, r in enumerate(rooms) if r >= s]
        if fits:
            k = min(fits, key=rooms.__getitem__)
            rooms[k] -= s
        else:
            rooms.append(2048 - s)
    return len(rooms)


@pytest.mark.parametrize("seed", range(3))
def test_few_sequences(seed):
    """Lengths like those of real texts: the count equals the lower bound or what best fit of single pieces needs."""
    rng = np.random.default_rng(seed)
    lengths = np.minimum(2048, rng.lognormal(6.3, 0.9, 1200).astype(int) + 1).tolist()
    counts = {s: lengths.count(s) for s in set(lengths)}
    rows = packing.plan(counts, packing.PackingPolicy())
    assert max(first + end - begin for _, begin, end, first, _ in rows) <= max(-(-sum(lengths) // 2048), brute_sequences(lengths))


def test_fullest_configuration_matches_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(60):
        sizes = sorted(rng.choice(np.arange(5, 60), 6, replace=False).tolist(), reverse=True)
        left = rng.integers(0, 4, 6).tolist()
        left[int(rng.integers(0, 6))] += 1
        got = packing._fullest(sizes, left, 100)
        lead = next(i for i, n in enumerate(left) if n)
        assert lead in got and all(got.count(i) <= left[i] for i in got)
        sums = {0}
        for i, s in enumerate(sizes):
            sums = {x + k * s for x in sums for k in range(left[i] - (i == lead) + 1)}
        assert sum(sizes[i] for i in got) == sizes[lead] + max(x for x in sums if x + sizes[lead] <= 100)
