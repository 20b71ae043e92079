"""Notices through the index against a search that tries every place, and layout cases of pages."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tracklake.llm import _text, licenses
from tracklake.llm.html_text import visible_text
from tracklake.llm.license_texts import NOTICES

POLICY = licenses.LicensePolicy()


def brute(words, index, vocabulary, texts):
    """(row, label) of every notice at every place, by loops."""
    out = set()
    for row, text in enumerate(texts):
        number = licenses._numbered(words(text), vocabulary).tolist()
        for label, notice, share, (begin, key) in zip(index.label, index.words, index.share, index.key, strict=True):
            places = [p for p in range(len(number) - len(key) + 1) if number[p : p + len(key)] == key.tolist()]
            for start in range(-len(notice), len(number)):
                if not any(abs(p - start - begin) <= POLICY.drift for p in places):
                    continue
                got = sum(s for k, (n, s) in enumerate(zip(notice.tolist(), share.tolist(), strict=True)) if n in number[max(0, start + k - POLICY.drift) : max(0, start + k + POLICY.drift + 1)])
                if got >= POLICY.agreement - 1e-9:
                    out.add((row, label))
                    break
    return out


def changed(text, rng, n, kind):
    w = text.split()
    for _ in range(n):
        at = int(rng.integers(0, len(w)))
        if kind == "insert":
            w.insert(at, "inserted")
        elif kind == "drop":
            w.pop(at)
        else:
            w[at] = "other"
    return " ".join(w)


@pytest.mark.parametrize("seed", range(3))
def test_index_loses_no_place(seed):
    rng = np.random.default_rng(seed)
    vocabulary = licenses._vocabulary(NOTICES)
    weight = rng.gamma(0.7, 2.0, len(vocabulary)) + 0.01
    index = licenses.NoticeIndex.of(NOTICES, vocabulary, weight, POLICY)
    texts = ["", "license license license software software", "the software is provided as is"]
    for n in NOTICES:
        for kind in ("insert", "drop", "change"):
            k = int(rng.integers(0, 5))
            texts.append(f"some words before {changed(n.words, rng, min(k, len(n.words.split()) - 4), kind)} and after")
    texts.append(" ".join(n.words for n in NOTICES))

    def words(text):
        data = np.frombuffer(text.encode(), np.uint8)
        return _text.words(data, np.array([0, len(data)]), _text.NOT_ALNUM, lower=True)

    w = _text.words(*_text.text_bytes(pa.array(texts)), _text.NOT_ALNUM, lower=True)
    number = licenses._numbered(w, vocabulary)
    got = {(r, index.label[k]) for r, k, _ in licenses.found_notices(number, w, index, POLICY)}
    assert got == brute(words, index, vocabulary, texts)
    assert {label for r, label in got if r == len(texts) - 1} == set(index.label)


@pytest.mark.parametrize("n", [n for n in NOTICES if len(n.words.split()) > 30], ids=lambda n: n.label)
def test_whole_texts_are_found_and_told_apart(spark, n):
    held = spark.createDataFrame([(1, f"x {n.words} y"), (2, "nothing of the kind")], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan_licenses(held).collect()}
    assert n.label in got[1].labels.split(",") and got[2].labels == "" and got[1].score == 1.0


@pytest.mark.parametrize(
    ("markup", "shown"),
    [
        ("<table><tr><td rowspan=2>Fruit<td>apple<td>1<tr><td>pear<td>2</table>", "Fruit  apple  1\n       pear   2"),
        ("<table><tr><td colspan=2>ab<td>c<tr><td>x<td>y<td rowspan=0>z<tr><td>1<td>2</table>", "ab    c\nx  y  z\n1  2"),
        ("<p>see <svg><defs><text>no</text></defs><text>A</text><text>B</text><title>no</title></svg>", "see\nA\nB"),
        ("<math><mi>x</mi><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac><annotation>no</annotation></math>", "x=1/2"),
        ("<div style='visibility:hidden'>no<b style='visibility: visible'>yes</b>no</div>", "yes"),
        ("<ol><li value=5>a<li>b</ol>", "5. a\n6. b"),
        ("<ol reversed><li>a<li>b</ol>", "2. a\n1. b"),
        ("<template>no<template>no</template>no</template>yes", "yes"),
        ("<a " + " ".join(f't{k}=">"' for k in range(100)) + ">x</a>", "x"),
        ('<b ">x', "x"),
        ("<td colspan=²>a", "a"),
        ("<ol start=" + "9" * 5000 + "><li>a</ol>", "1. a"),
        ("<xmp><b>x</xmp>y", "<b>x\n\ny"),
        ("<p hidden>no</p><p>a<!-- c -->b</p>", "ab"),
    ],
)
def test_layout_cases(markup, shown):
    assert visible_text(markup) == shown


@pytest.mark.parametrize("markup", [
    "<table>" + "<tr><td>" + "w" * 5000 + "<td>x" + "<tr><td>a<td>b" * 3000 + "</table>",
    "<table>" + "<tr><td colspan=1000>a<td>b" * 3000 + "<tr>" + "<td>cc" * 3000 + "</table>",
    "<table><tr>" + "<td>a" * 1000 + "<td>" + "x<br>" * 1000 + "</table>",
    '<b a="' * 30000 + ">", "<b a='x" + '<b a="' * 30000, "<td rowspan=9>" * 3000,
])
def test_text_is_bounded_by_the_page(markup):
    assert len(visible_text(markup)) < 60 * len(markup) + 1000


def looked_up(text, index, vocabulary, policy):
    data, off = _text.text_bytes(pa.array([text]))
    w = _text.words(data, off, _text.NOT_ALNUM, lower=True)
    number = licenses._numbered(w, vocabulary)
    tracemalloc.start()
    found = list(licenses.found_notices(number, w, index, policy))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return found, peak


def test_memory_does_not_grow_with_a_text_of_indexed_words():
    """Megabytes of words that many notices hold, alone and round a notice at every place against the stretches."""
    vocabulary, policy = licenses._vocabulary(licenses.NOTICES), licenses.LicensePolicy()
    index = licenses.NoticeIndex.of(licenses.NOTICES, vocabulary, np.ones(len(vocabulary)), policy)
    assert looked_up("software license " * 600_000, index, vocabulary, policy) == ([], pytest.approx(0, abs=60e6))
    whole = max(licenses.NOTICES, key=lambda n: len(n.words))
    for before in (0, licenses.STRETCH - 60, licenses.STRETCH - 1, licenses.STRETCH, 3 * licenses.STRETCH + 7):
        text = "software " * before + whole.words + " license" * 50_000
        found, peak = looked_up(text, index, vocabulary, policy)
        assert (0, licenses.NOTICES.index(whole), 1.0) in found and peak < 200e6
