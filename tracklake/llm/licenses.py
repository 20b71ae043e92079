"""License scans: fixed phrases, and known notices found through a positional index of rare words.

A first pass counts, over all files, in how many each word of the notices occurs; these counts (as many as the
notices have words) give inverse document frequencies. Of each notice the rarest words that together carry
``indexed`` of its weight are indexed: word, notice, position. Scanning looks up a file's words of the highest
frequencies' inverse, those that the index holds, and every posting proposes where its notice would begin. Postings are
intersected by that relative position, give or take ``drift`` words, so that insertions survive: only places at which so
much weight of indexed words meets as a good match can't do without are looked at whole. There each word of the notice
counts if the file has it within the drift; a notice is found if ``agreement`` of its weight does, and its mandatory key
phrase stands consecutively at that place. As ``indexed`` exceeds ``1 - agreement``, no good match escapes the index.
Notices whose key phrase the slice doesn't hold aren't looked up at all, the others only in stretches of words in which it
may end such a notice, so what is held at once is bounded by a stretch. All hashing and matching is numpy over Arrow slices.

Defined results: a null or empty text has no words, places or labels and score 0; repeated rows get equal results, ids
may be null or repeat; very long texts are slices of their own, of which a task holds some arrays as long as the text; ties in rarity are broken by position; an empty table
gives no rows; other columns of the input, whatever their names, aren't looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tracklake.llm import _text
from tracklake.llm.license_texts import NOTICES, Notice

#: Fixed phrases and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))


@dataclass(frozen=True)
class LicensePolicy:
    #: Share of a notice's weight that must agree.
    agreement: float = 0.75
    #: Share of a notice's weight whose words, the rarest, are indexed; over 1 - agreement.
    indexed: float = 0.5
    #: Words by which places in a file may shift against those in a notice.
    drift: int = 4


def _word_hashes(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return _text.words(data, np.array([0, len(data)]), _text.NOT_ALNUM, lower=True).hash


def _vocabulary(notices: tuple[Notice, ...]) -> np.ndarray:
    """Sorted hashes of all words of the phrases and notices."""
    return np.unique(np.concatenate([_word_hashes(t) for t in [p for p, _ in PHRASES] + [n.words for n in notices]]))


def _numbered(w: _text.Words, vocabulary: np.ndarray) -> np.ndarray:
    """Each word's number in the vocabulary, or -1."""
    place = np.minimum(np.searchsorted(vocabulary, w.hash), len(vocabulary) - 1)
    return np.where(vocabulary[place] == w.hash, place, -1)


def word_frequencies(docs: DataFrame, text_col: str = "text", notices: tuple[Notice, ...] = NOTICES) -> tuple[int, np.ndarray]:
    """Number of files, and of files with each word of the vocabulary: counted by tasks, summed by Spark."""
    vocabulary = _vocabulary(notices)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary) + 1, np.int64)
        for batch in batches:
            for _, _, data, off in _text.slices(batch.column(0)):
                w = _text.words(data, off, _text.NOT_ALNUM, lower=True)
                number = _numbered(w, vocabulary)
                held = number >= 0
                pair = np.unique(w.row[held] * len(vocabulary) + number[held])
                total[:-1] += np.bincount(pair % len(vocabulary), minlength=len(vocabulary))
                total[-1] += len(off) - 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["word", "files"])

    counts = docs.select(docs[text_col]).mapInArrow(run, "word long, files long").groupBy("word").sum("files").collect()
    out = np.zeros(len(vocabulary) + 1, np.int64)
    for word, files in counts:
        out[word] = files
    return int(out[-1]), out[:-1]


def _places(number: np.ndarray, row: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Words at which the wanted numbers stand consecutively in one row."""
    at = np.flatnonzero(number == wanted[0])
    for k in range(1, len(wanted)):
        at = at[at + k < len(number)]
        at = at[(number[at + k] == wanted[k]) & (row[at + k] == row[at])]
    return at


#: Words that are looked up in the index at once.
STRETCH = 4096


@dataclass
class NoticeIndex:
    """Notices as word numbers with shares of weight, and the postings of their rarest words, sorted by word."""

    label: list[str]
    words: list[np.ndarray]
    share: list[np.ndarray]
    key: list[tuple[int, np.ndarray]]  # where the key phrase begins, its words
    post_word: np.ndarray
    post_notice: np.ndarray
    post_place: np.ndarray
    post_share: np.ndarray

    @classmethod
    def of(cls, notices: tuple[Notice, ...], vocabulary: np.ndarray, weight: np.ndarray, policy: LicensePolicy) -> NoticeIndex:
        words = [np.searchsorted(vocabulary, _word_hashes(n.words)) for n in notices]
        share = [weight[x] / weight[x].sum() for x in words]
        keys = []
        for n, x in zip(notices, words, strict=True):
            key = np.searchsorted(vocabulary, _word_hashes(n.key))
            keys.append((next(k for k in range(len(x)) if np.array_equal(x[k : k + len(key)], key)), key))
        posts = []
        for number, (x, s) in enumerate(zip(words, share, strict=True)):
            order = np.argsort(-s, kind="stable")
            rarest = order[: int(np.searchsorted(np.cumsum(s[order]), policy.indexed)) + 1]
            posts.append(np.stack([x[rarest], np.full(len(rarest), number), rarest, s[rarest]]))
        all_ = np.concatenate(posts, axis=1)
        all_ = all_[:, np.argsort(all_[0], kind="stable")]
        return cls([n.label for n in notices], words, share, keys, *(all_[k].astype(np.int64) for k in range(3)), all_[3])

    def candidates(self, number: np.ndarray, row: np.ndarray, policy: LicensePolicy) -> tuple[np.ndarray, np.ndarray]:
        """(notice, word at which it would begin) wherever enough indexed weight meets, row by row; starts may lie before the slice."""
        known = np.flatnonzero(number >= 0)
        low, high = (np.searchsorted(self.post_word, number[known], side=s) for s in ("left", "right"))
        count = high - low
        ends = np.cumsum(count)
        post = np.repeat(low - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)
        at = np.repeat(known, count)
        notice, start, share, of = self.post_notice[post], at - self.post_place[post], self.post_share[post], row[at]
        if not len(at):
            return notice, start
        # a key for (row, notice, start) that keeps neighbouring starts next to each other
        gap, d = len(number) + 4096, policy.drift
        line = (of * len(self.label) + notice) * (gap + 8 * d) + start + 4096 // 2 + 2 * d
        order = np.argsort(line, kind="stable")
        line, share = line[order], np.concatenate([[0.0], np.cumsum(share[order])])
        tried = np.unique((line[:, None] + np.arange(-d, d + 1)).reshape(-1))
        weight = share[np.searchsorted(line, tried + d, side="right")] - share[np.searchsorted(line, tried - d, side="left")]
        good = tried[weight >= self.least(policy)]
        notice, start = (good // (gap + 8 * d)) % len(self.label), good % (gap + 8 * d) - 4096 // 2 - 2 * d
        return notice, start

    def only(self, notices: list[int]) -> NoticeIndex:
        """The index with the postings of these notices alone."""
        held = np.isin(self.post_notice, notices)
        return replace(self, post_word=self.post_word[held], post_notice=self.post_notice[held], post_place=self.post_place[held], post_share=self.post_share[held])

    def least(self, policy: LicensePolicy) -> float:
        """Indexed weight that a match of the wanted agreement holds at least."""
        return policy.agreement + policy.indexed - 1 - 1e-6

    def agreements(self, notice: int, start: np.ndarray, number: np.ndarray, first: np.ndarray, end: np.ndarray, policy: LicensePolicy) -> np.ndarray:
        """Share of a notice's weight that stands within the drift of its place, for each start in rows from first to end."""
        words = self.words[notice]
        got = np.zeros((len(start), len(words)), bool)
        for d in range(-policy.drift, policy.drift + 1):
            at = start[:, None] + np.arange(len(words)) + d
            inside = (at >= first[:, None]) & (at < end[:, None])
            got |= inside & (number[np.where(inside, at, 0)] == words)
        return got @ self.share[notice]


def found_notices(number: np.ndarray, w: _text.Words, index: NoticeIndex, policy: LicensePolicy) -> Iterator[tuple[int, int, float]]:
    """(row, notice, agreement) of the notices found in a slice.

    Only notices whose key phrase stands somewhere are looked up, and only where it does: a stretch of ``STRETCH`` words at
    a time, with what a notice that begins there may reach. So memory doesn't grow with the text, whatever its words.
    """
    phrase = {}
    for notice, (begin, key) in enumerate(index.key):
        if len(place := _places(number, w.row, key)):
            phrase[notice] = begin, place
    if not phrase:
        return
    index = index.only(list(phrase))
    stretches = [np.unique((place - begin)[:, None] + np.array([-policy.drift, policy.drift])) // STRETCH for begin, place in phrase.values()]
    reach = max(len(x) for x in index.words) + policy.drift
    for s in np.unique(np.concatenate(stretches)).tolist():
        low, high = max(s * STRETCH - policy.drift, 0), max((s + 1) * STRETCH + reach, 0)
        notices, starts = index.candidates(number[low:high], w.row[low:high], policy)
        starts = starts + low
        own = (starts >= s * STRETCH) & (starts < (s + 1) * STRETCH)
        notices, starts = notices[own], starts[own]
        for notice in np.unique(notices).tolist():
            begin, place = phrase[notice]
            start = starts[notices == notice]
            # the key phrase stands at its place, give or take the drift
            near = np.searchsorted(place, start + begin - policy.drift, side="left")
            here = place[np.minimum(near, len(place) - 1)]
            held = (near < len(place)) & (here <= start + begin + policy.drift)
            start, row = start[held], w.row[here[held]]
            for k in range(0, len(start), 4096):
                at, of = start[k : k + 4096], row[k : k + 4096]
                got = index.agreements(notice, at, number, w.first[of], w.first[of + 1], policy)
                for j in np.flatnonzero(got >= policy.agreement - 1e-9).tolist():
                    yield int(of[j]), notice, round(min(float(got[j]), 1.0), 9)


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", policy: LicensePolicy = LicensePolicy(), notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """Id, n_words, places of the fixed phrases, labels of phrases and of phrases and notices, best agreement of a notice found."""
    files, frequency = word_frequencies(docs, text_col, notices)
    vocabulary = _vocabulary(notices)
    index = NoticeIndex.of(notices, vocabulary, np.log((files + 1) / (frequency + 1)) + 1e-6, policy)
    phrases = [(np.searchsorted(vocabulary, _word_hashes(p)), label) for p, label in PHRASES]
    source = docs.select(docs[id_col], docs[text_col].alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, off in _text.slices(batch.column(1)):
                n = j - i
                w = _text.words(data, off, _text.NOT_ALNUM, lower=True)
                number = _numbered(w, vocabulary)
                base: list[set[str]] = [set() for _ in range(n)]
                more: list[set[str]] = [set() for _ in range(n)]
                found = [_places(number, w.row, words) for words, _ in phrases]
                for at, (_, label) in zip(found, phrases, strict=True):
                    for r in np.unique(w.row[at]).tolist():
                        base[r].add(label)
                place = np.concatenate(found)
                row, inside = w.row[place], place - w.first[w.row[place]]
                first, last = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
                np.minimum.at(first, row, inside)
                np.maximum.at(last, row, inside)
                score = np.zeros(n)
                for r, notice, agree in found_notices(number, w, index, policy):
                    more[r].add(index.label[notice])
                    score[r] = max(score[r], agree)
                none = last < 0
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, n),
                        pa.array(w.counts),
                        pa.array(np.bincount(row, minlength=n).astype(np.int64)),
                        pa.array(first, mask=none),
                        pa.array(last, mask=none),
                        pa.array([",".join(sorted(x)) for x in base]),
                        pa.array([",".join(sorted(x | y)) for x, y in zip(base, more, strict=True)]),
                        pa.array(score),
                    ],
                    [id_col, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
                )

    return source.mapInArrow(run, f"`{id_col}` {source.schema[0].dataType.simpleString()}, {SCHEMA}")
