"""Quality rules: how much of a text repeats inside itself.

Rolling hashes of the words' n-grams, for several lengths n, find n-grams that stand earlier in the same text;
the share of word characters that they cover, and the share inside repeated lines, decide. All hashing is numpy
over slices of an Arrow batch, a text is never split over tasks, and no row is shuffled.

Defined results: a null or empty text has 0 words and fails the base rule; repeated rows get equal results; of lines or
windows that tie the first is no repetition; a very long text makes a slice of its own, so a task holds some times
its length; an empty table gives no rows; null ids are kept; rows come back in any order; other columns of the input, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tracklake.llm import _text

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class RepetitionPolicy:
    """Largest share of word characters inside repeated n-grams (by n) and inside repeated lines.

    The first occurrence isn't counted as repeated. Shares are of the word characters of the whole text.
    """

    ngram_share: dict[int, float] = field(default_factory=lambda: {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10})
    line_share: float = 0.20
    min_words: int = 10
    max_repeat_percent: int = 20


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, top_share double, line_share double"
_NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "top_share", "line_share"]


def _repeated(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks: the value stands earlier in its row; it stands there twice or more. Positions must ascend."""
    key = _text.mix(row.astype(np.uint64)) ^ value
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    later, any_ = np.zeros(len(key), bool), np.zeros(len(key), bool)
    later[order[1:]] = same
    any_[order[1:]] = same
    any_[order[:-1]] |= same
    return later, any_


def _covered(n_words: int, at: np.ndarray, n: int) -> np.ndarray:
    """Words inside the n-word windows that begin at ``at``."""
    step = np.zeros(n_words + 1, np.int32)
    np.add.at(step, at, 1)
    np.add.at(step, at + n, -1)
    return np.cumsum(step[:-1]) > 0


def measure_slice(data: np.ndarray, off: np.ndarray, policy: RepetitionPolicy) -> dict[str, np.ndarray]:
    n = len(off) - 1
    w = _text.words(data, off, _text.BLANK)
    per_row = lambda rows, weight=None: np.bincount(rows, weight, n).astype(np.int64)[:n]
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    chars = lead[w.end] - lead[w.start]
    out = {"n_words": w.counts, "word_chars": per_row(w.row, chars)}
    sign = np.flatnonzero(_SYMBOL[data])
    out["n_symbols"] = per_row(np.searchsorted(off, sign, side="right") - 1)

    # lines, without those that have no word
    start, end = _text.runs(data != 10, off)
    held = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~_text.BLANK[data], out=held[1:])
    full = held[end] > held[start]
    start, end = start[full], end[full]
    row = np.searchsorted(off, start, side="right") - 1
    later, _ = _repeated(row, _text.range_hashes(data, start, end))
    out["n_dup_lines"] = per_row(row[later])
    word_line = np.searchsorted(start, w.start, side="right") - 1
    total = np.maximum(out["word_chars"], 1)
    out["line_share"] = per_row(w.row, chars * later[word_line]) / total if len(w.row) else np.zeros(n)

    out["n_repeat_words"], failed, top = np.zeros(n, np.int64), np.zeros(n, bool), np.zeros(n)
    at = None
    for size in sorted({5, *policy.ngram_share}):
        begin, value = _text.windows(w, size, at if size > 5 else None)
        later, any_ = _repeated(w.row[begin], value)
        if size == 5:
            out["n_repeat_words"] = per_row(w.row, _covered(len(w.row), begin[any_], 5))
        if size in policy.ngram_share:
            share = per_row(w.row, chars * _covered(len(w.row), begin[later], size)) / total
            failed |= share > policy.ngram_share[size]
            top = np.maximum(top, share)
        if size >= 5:
            at = begin[any_]  # a longer window that repeats begins with one of these
    out["top_share"] = top
    out["base_failed"] = (out["n_words"] < policy.min_words) | (100 * out["n_repeat_words"] > policy.max_repeat_percent * out["n_words"])
    out["kept"] = ~(out["base_failed"] | failed | (out["line_share"] > policy.line_share))
    return out


def measure_column(column: pa.Array, policy: RepetitionPolicy) -> list[pa.Array]:
    parts = [measure_slice(data, off, policy) for _, _, data, off in _text.slices(column)]
    return [pa.array(np.concatenate([p[k] for p in parts]) if parts else [], t) for k, t in zip(_NAMES, [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2, strict=True)]


def repetition_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", policy: RepetitionPolicy = RepetitionPolicy()) -> DataFrame:
    """Id, base measures, ``base_failed``, ``kept`` and the largest shares, one row per input row."""
    source = docs.select(docs[id_col], docs[text_col].alias("_text"))
    id_type = source.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *measure_column(batch.column(1), policy)], [id_col, *_NAMES])

    return source.mapInArrow(run, f"`{id_col}` {id_type}, {SCHEMA}")


def keep_unrepetitive(docs: DataFrame, text_col: str = "text", policy: RepetitionPolicy = RepetitionPolicy()) -> DataFrame:
    """The rows, with all their columns, that the rules keep."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(measure_column(batch.column(at), policy)[_NAMES.index("kept")])

    return docs.mapInArrow(run, docs.schema)
