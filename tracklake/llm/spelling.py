"""Spelling variants: words one edit apart, found by asymmetric q-chunks, and the much commoner form of each.

Words are maximal runs of letters; where the checksum of ``<doc_id>:<word>`` says so one letter is taken out
(``SpellingPolicy.drop_every``). The vocabulary is every distinct word of enough letters that occurs often enough.

Two words are near if one inserted, deleted or replaced code point makes one the other. The shorter of the two (of
equal length the smaller) is the chunk side, the other one the gram side. The chunk side is cut into two disjoint chunks;
a single edit leaves one of them as it was, so it stands in the gram side at the same place, or one place further if
that side is longer. So the gram side gives its grams of that length; only those at places that a chunk can have within
shift one can meet any, so the others aren't written. With halves for chunks, though, a bucket of common syllables would
meet all its words in pairs: 374 thousand words make 208 million. The rest, in which the edit must be, is therefore
cut into two chunks by the same rule, again and again while it has more than ``rest`` code points: what is left open in
a bucket is then two code points, so the alphabet bounds a bucket, whatever the data. Only words of over
``rest << depth`` (32) code points stop earlier, with all but a sixteenth of them in common. All chunks on the way are
one hash, an equi-join key. Pairs are verified by their edit distance; a pair counts in the one bucket that holds the
first code point in which the two differ, so nothing needs to be made distinct.

Words are counted in Python tasks, in a bounded store that is handed on when full; the rest is built-in functions.

Defined results: null and empty texts hold no words; a null doc_id counts as the empty string; repeated rows count again;
of equally common near words the smallest in code-point order is the form; an empty table gives no rows; very
long texts are read in pieces cut between words, so memory holds one text and the store; other columns of the input,
whatever their names, aren't looked at.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklake.llm._session import checkpointed


@dataclass(frozen=True)
class SpellingPolicy:
    #: Code points of a word at least, and occurrences at least.
    min_length: int = 7
    min_count: int = 2
    #: A form is so many times as common as the word at least.
    dominance: int = 10
    #: One letter goes where this divides the checksum; 0: nowhere.
    drop_every: int = 31
    #: Code points in which words of a bucket may differ, and how often a word is halved at most.
    rest: int = 2
    depth: int = 4
    #: Code points of the distinct words that a task holds before it hands their counts on.
    store: int = 4_000_000


PIECE = 1 << 20
_RUN = re.compile("[a-zÀ-ÿ]+")


def runs(text: str) -> Iterator[list[str]]:
    """The words of a text, piece by piece; only A-Z are lower-cased."""
    text = text.encode().lower().decode()
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text) and (inside := _RUN.match(text, end)):
            end = inside.end()
        yield _RUN.findall(text, at, end)
        at = end


def altered(word: str, head: int, drop_every: int) -> str:
    """The word, or the word without one letter; ``head``: checksum of what comes before it."""
    h = zlib.crc32(word.encode(), head)
    if not drop_every or h % drop_every:
        return word
    k = h % len(word)
    return word[:k] + word[k + 1 :]


def counter(policy: SpellingPolicy) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Arrow batches of (id, text) to batches of (word, n); a word may come several times."""

    def handed_on(store: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(store), pa.string()), pa.array(list(store.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store: Counter = Counter()
        size = 0
        for batch in batches:
            for i, text in zip(batch.column("id"), batch.column("text"), strict=True):
                head = zlib.crc32(f"{i.as_py()}:".encode())
                for found in runs(text.as_py()):
                    for word, n in Counter(found).items():
                        word = altered(word, head, policy.drop_every)
                        if len(word) >= policy.min_length:
                            size += len(word) * (word not in store)
                            store[word] += n
                    if size > policy.store:
                        yield handed_on(store)
                        store, size = Counter(), 0
        if store:
            yield handed_on(store)

    return run


def vocabulary(docs: DataFrame, policy: SpellingPolicy = SpellingPolicy(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the words of enough letters and occurrences."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    return rows.mapInArrow(counter(policy), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= policy.min_count)


def _halved(rows: DataFrame, shift: Column, policy: SpellingPolicy) -> DataFrame:
    """Each row twice if its open part ``lo`` to ``hi`` is long: once with the first half equal, once with the second.

    ``shift``: how much further the second half stands in this word. ``end`` is where the first difference may be at most.
    """
    cut = F.col("lo") + F.shiftright(F.col("hi") - F.col("lo"), 1)
    part = lambda a, b: F.substr("word", a + 1, b - a)
    first = F.struct(F.xxhash64("key", F.lit(1), part(F.col("lo"), cut)).alias("key"), cut.alias("lo"), F.col("hi"), F.col("end"))
    second = F.struct(F.xxhash64("key", F.lit(2), part(cut + shift, F.col("hi") + shift)).alias("key"), F.col("lo"), cut.alias("hi"), cut.alias("end"))
    as_is = F.struct("key", "lo", "hi", "end")
    kept = [c for c in rows.columns if c not in {"key", "lo", "hi", "end"}]
    return rows.select(*kept, F.inline(F.when(F.col("hi") - F.col("lo") > policy.rest, F.array(first, second)).otherwise(F.array(as_is))))


def chunk_keys(words: DataFrame, side: str, policy: SpellingPolicy = SpellingPolicy()) -> DataFrame:
    """(word, n, key, lo, end): the bucket keys of each word as the ``chunk`` or the ``gram`` side."""
    length = F.length("word")
    longer = F.col("longer")
    rows = words.select("word", "n", F.explode(F.array(F.lit(0), F.lit(1))).alias("longer"))
    rows = rows.withColumn("hi", length if side == "chunk" else length - longer)
    rows = rows.withColumns({"key": F.xxhash64("hi", "longer"), "lo": F.lit(0), "end": F.col("hi") + 1})
    for _ in range(policy.depth):
        rows = _halved(rows, F.lit(0) if side == "chunk" else longer, policy)
    return rows.select("word", "n", "key", "lo", "end")


def near_pairs(words: DataFrame, policy: SpellingPolicy = SpellingPolicy()) -> DataFrame:
    """(a, a_n, b, b_n): every two words that are one edit apart, once; a is the shorter or the smaller one."""
    chunks = chunk_keys(words, "chunk", policy).select("key", F.col("word").alias("a"), F.col("n").alias("a_n"), "lo", "end")
    grams = chunk_keys(words, "gram", policy).select("key", F.col("word").alias("b"), F.col("n").alias("b_n"))
    head = lambda w, k: F.substr(w, F.lit(1), F.col(k))
    ordered = (F.length("a") < F.length("b")) | (F.col("a") < F.col("b"))
    here = (head("a", "lo") == head("b", "lo")) & ((F.col("end") > F.length("a")) | (head("a", "end") != head("b", "end")))
    met = chunks.join(grams, "key").where(ordered & here & (F.levenshtein("a", "b", 1) == 1))
    return met.select("a", "a_n", "b", "b_n")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of each row (word, form). A form is many times as common, so a chain has at most 18 links; each round doubles what is followed."""
    known = checkpointed(forms.select("word", F.col("form").alias("root")))
    for _ in range(5):
        further = known.select(F.col("word").alias("root"), F.col("root").alias("further"))
        known = checkpointed(known.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if known.where("moved").isEmpty():
            break
        known = known.drop("moved")
    return known.select("word", "root")


def variants(docs: DataFrame, policy: SpellingPolicy = SpellingPolicy(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n, n_near, form, form_n, root: one row for each word of the vocabulary."""
    words = checkpointed(vocabulary(docs, policy, id_col, text_col))
    sides = lambda x, y: F.struct(F.col(x).alias("word"), F.col(f"{x}_n").alias("own"), F.col(y).alias("near"), F.col(f"{y}_n").alias("near_n"))
    both = F.array(sides("a", "b"), sides("b", "a"))
    near = near_pairs(words, policy).select(F.inline(both))
    dominant = F.when(F.col("near_n") >= policy.dominance * F.col("own"), F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form")))
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(dominant).alias("best"))
    best = checkpointed(best.select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n")))
    roots = _roots(best.where("form is not null"))
    out = words.join(best, "word", "left").join(roots, "word", "left")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))
