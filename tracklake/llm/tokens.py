"""BPE encoding and decoding with content-defined chunk reuse.

A text is cut into chunks where a rolling hash of its bytes says so, so a passage that several documents share is
cut alike in each of them and its chunks are encoded once by a Python worker: its store outlives tasks, is bounded, and
when it is full keeps the chunks that were asked for again. A cut may fall
inside a word, where the ids of the two chunks are not those of the whole text. The join is repaired: the bytes
from the last white space before the cut to the first one after it are encoded again, and the stretch grows over
further chunks until both ends stand on white space, where the tokenizer's own cutting into words (it drops white
space, and no word or normalisation reaches over it) makes the ids agree exactly with those of the whole text.

Files are named by path; a worker loads one once. Only tokenizers whose pre-tokenizer drops white space fit here,
which is checked on loading.

Defined results: null and empty texts have no ids and decode to an empty text; repeated rows get equal results, and
ids may be null or repeat; very long texts are cut like others; an empty table gives no rows; other columns of the input,
whatever their names, aren't looked at.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from tracklake.llm import _text

#: Bounds of what a Python worker keeps: words, parts of words, and bytes of chunks.
WORDS_KEPT = 400_000
PARTS_KEPT = 100_000
CHUNK_BYTES_KEPT = 16 << 20
#: A cut comes where the low bits of the rolling hash are all zero: every 512 bytes on average.
CUT_MASK = np.uint32(511)
_WINDOW = 16
#: The pre-tokenizer's pattern for which words of plain characters are cut here.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Visible ASCII and Latin letters that no composition changes and that lower-case to one character each; the rest goes to the library.
_LATIN = "\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017f"
_PLAIN = re.compile(f"[!-~{_LATIN}]*").fullmatch
_PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{_LATIN}]+|[0-9]|[^a-z0-9{_LATIN}]+").findall
_GEAR = np.random.default_rng(7).integers(0, 1 << 32, 256, dtype=np.uint32)


class WordEncoder:
    """Ids and decoded text of many byte strings at once.

    The words of a call are looked up by 64-bit hashes; each distinct one that isn't remembered from before is
    encoded, then ids are laid out by array operations. What is remembered is held in sorted arrays, up to a bound,
    with the words' bytes: these are compared, so words whose hashes are equal by chance are encoded one by one.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        split = (spec["pre_tokenizer"].get("pretokenizers") or [spec["pre_tokenizer"]])[0]
        if split.get("type") != "Split" or split.get("behavior") != "Removed" or spec["post_processor"] or spec["decoder"]:
            raise ValueError("a tokenizer that drops white space, without post-processor and decoder, is needed")
        self.tokenizer = Tokenizer.from_str(json.dumps(spec | {"truncation": None, "padding": None}))
        self.model = self.tokenizer.model
        pieces = [(self.tokenizer.id_to_token(i) or "").encode() for i in range(self.tokenizer.get_vocab_size())]
        self.piece_length = np.array([len(x) + 1 for x in pieces])
        self.piece_at = np.cumsum(self.piece_length) - self.piece_length
        self.piece_bytes = np.frombuffer(b"".join(b" " + x for x in pieces), np.uint8)
        alphabet = {b: chr(b) for r in (range(33, 127), range(161, 173), range(174, 256)) for b in r}
        odd = (b for b in range(256) if b not in alphabet)
        self.byte_level = alphabet | {b: chr(256 + k) for k, b in enumerate(odd)}
        self.parts: dict[str, list[int]] = {}
        markers = all(x["content"].startswith("<|") for x in spec["added_tokens"])
        self.plain = markers and split["pattern"].get("Regex") == _SPLIT and [x["type"] for x in spec["normalizer"]["normalizers"]] == ["NFC", "Replace", "Lowercase"]
        self._forget()

    def _forget(self) -> None:
        self.hash, self.at, self.length, self.again = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        self.pool, self.filled = np.zeros(1 << 16, np.uint32), 0
        self.word_at, self.word_size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.word_pool, self.word_filled = np.zeros(1 << 16, np.uint8), 0

    def _make_room(self, n: int) -> None:
        """Past the bound only words that came in more than one slice stay; if they are too many as well, none."""
        if len(self.hash) + n <= WORDS_KEPT:
            return
        keep = self.again
        if keep.sum() + n > WORDS_KEPT * 3 // 4:
            return self._forget()
        pool, ends = _gather(self.pool, self.at[keep], self.length[keep])
        self.hash, self.length, self.at, self.again = self.hash[keep], self.length[keep], ends[:-1], np.zeros(int(keep.sum()), bool)
        self.pool, self.filled = pool, len(pool)
        self.word_pool, ends = _gather(self.word_pool, self.word_at[keep], self.word_size[keep])
        self.word_at, self.word_size, self.word_filled = ends[:-1], self.word_size[keep], len(self.word_pool)

    def _encode(self, word: bytes) -> list[int]:
        text = word.decode("utf-8", "replace")
        if not self.plain or b"<|" in word or not (word.isascii() or _PLAIN(text)):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        found = _PARTS(text.lower())
        return self._part(found[0]) if len(found) == 1 else [i for part in found for i in self._part(part)]

    def _part(self, part: str) -> list[int]:
        if (got := self.parts.get(part)) is None:
            shown = part if part.isascii() and part.isprintable() else "".join([self.byte_level[b] for b in part.encode()])
            got = self.parts[part] = [x.id for x in self.model.tokenize(shown)]
        return got

    def _learn(self, hashes: np.ndarray, new: list[bytes]) -> None:
        if len(self.parts) > PARTS_KEPT:
            self.parts = {}
        found = list(map(self._encode, new))
        length = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.uint32, int(length.sum()))
        end = self.filled + len(flat)
        if end > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.filled], np.zeros(max(end, len(self.pool)), np.uint32)])
        self.pool[self.filled : end] = flat
        at = self.filled + np.cumsum(length) - length
        self.filled = end
        held = np.frombuffer(b"".join(new), np.uint8)
        size = np.fromiter(map(len, new), np.int64, len(new))
        word_at, end = self.word_filled + np.cumsum(size) - size, self.word_filled + len(held)
        if end > len(self.word_pool):
            self.word_pool = np.concatenate([self.word_pool[: self.word_filled], np.zeros(max(end, len(self.word_pool)), np.uint8)])
        self.word_pool[self.word_filled : end] = held
        self.word_filled = end
        place = np.searchsorted(self.hash, hashes)
        more = ((self.hash, hashes), (self.at, at), (self.length, length), (self.again, False), (self.word_at, word_at), (self.word_size, size))
        self.hash, self.at, self.length, self.again, self.word_at, self.word_size = (np.insert(a, place, b) for a, b in more)

    def _find(self, distinct: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of hashes among the known ones, and which are not known."""
        if not len(self.hash):
            return np.zeros(len(distinct), np.int64), np.ones(len(distinct), bool)
        place = np.minimum(np.searchsorted(self.hash, distinct), len(self.hash) - 1)
        return place, self.hash[place] != distinct

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the rows of a slice, one after another, and the n + 1 offsets of the rows among them."""
        w = _text.words(data, off, _text.BLANK)
        distinct, first, which = np.unique(w.hash, return_index=True, return_inverse=True)
        place, fresh = self._find(distinct)
        if fresh.any():
            self.again[place[~fresh]] = True
            self._make_room(int(fresh.sum()))
            place, fresh = self._find(distinct)
            raw, at = data.tobytes(), first[fresh]
            self._learn(distinct[fresh], [raw[i:j] for i, j in zip(w.start[at].tolist(), w.end[at].tolist(), strict=True)])
            place, _ = self._find(distinct)
        if not self._exact(data, w, first, which, place):
            return self._one_by_one(data, w)
        ids, ends = _gather(self.pool, self.at[place][which], self.length[place][which])
        return ids, ends[w.first]

    def _exact(self, data: np.ndarray, w: _text.Words, first: np.ndarray, which: np.ndarray, place: np.ndarray) -> bool:
        """Whether equal hashes stand for equal bytes, among the words of a slice and between them and the remembered ones."""
        start, end = w.start[first], w.end[first]
        if not _text.same_ranges(data, w.start, w.end, first[which]) or not np.array_equal(end - start, self.word_size[place]):
            return False
        return np.array_equal(_gather(data, start, end - start)[0], _gather(self.word_pool, self.word_at[place], self.word_size[place])[0])

    def _one_by_one(self, data: np.ndarray, w: _text.Words) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        found = [self._encode(raw[i:j]) for i, j in zip(w.start.tolist(), w.end.tolist(), strict=True)]
        ends = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int64)
        return np.fromiter(chain.from_iterable(found), np.uint32, int(ends[-1])), ends[w.first]

    def decode(self, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the decoded rows, each piece led by a space, and the rows' offsets: this tokenizer has no decoder, so decode() joins pieces by spaces."""
        text, ends = _gather(self.piece_bytes, self.piece_at[ids], self.piece_length[ids])
        return text, ends[off]


def _gather(pool: np.ndarray, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranges of the pool one after another, and the n + 1 offsets of the ranges in that."""
    ends = np.zeros(len(at) + 1, np.int64)
    np.cumsum(length, out=ends[1:])
    return pool[np.repeat(at - ends[:-1], length) + np.arange(ends[-1])], ends


@lru_cache(maxsize=4)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def cut_points(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Ends of the chunks of each row; ends of rows are among them."""
    if not len(data):
        return np.zeros(0, np.int64)
    gear = _GEAR[data]
    rolling = gear.copy()
    for k in range(1, _WINDOW):
        rolling[k:] += gear[:-k] << np.uint32(k)
    at = np.flatnonzero((rolling & (CUT_MASK << np.uint32(_WINDOW - 10))) == 0) + 1
    return np.unique(np.concatenate([at, off[1:][np.diff(off) > 0]]))


_SPACE = re.compile(rb"[ \t-\r]")


class ChunkStore:
    """Encoded chunks: the part of a word before the first white space, ids and text of the middle, the part of a word after the last."""

    def __init__(self, words: WordEncoder) -> None:
        self.words, self.kept, self.held = words, {}, 0
        self.again: set[bytes] = set()  # chunks that came in more than one call since the last clearance
        self.asked = self.encoded = 0

    def many(self, strings: list[bytes]) -> list[tuple[bytes, bytes]]:
        """Ids and decoded text of each of the strings, taken as whole texts."""
        off = np.zeros(len(strings) + 1, np.int64)
        np.cumsum([len(x) for x in strings], out=off[1:])
        ids, at = self.words.encode(np.frombuffer(b"".join(strings), np.uint8), off)
        text, shown = self.words.decode(ids, at)
        ids, text = ids.astype("<u4").tobytes(), text.tobytes()
        at, shown = (4 * at).tolist(), shown.tolist()
        return [(ids[at[k] : at[k + 1]], text[shown[k] + 1 : shown[k + 1]]) for k in range(len(strings))]

    def learn(self, chunks: list[bytes]) -> None:
        """Encodes the chunks that aren't kept, each once."""
        if self.held > CHUNK_BYTES_KEPT:
            self.kept = {x: self.kept[x] for x in self.again}
            self.held, self.again = sum(map(self._bytes, self.kept)), set()
            if self.held > CHUNK_BYTES_KEPT * 3 // 4:
                self.kept, self.held = {}, 0
        distinct = dict.fromkeys(chunks)
        new = [x for x in distinct if x not in self.kept]
        self.again.update(x for x in distinct if x in self.kept)
        self.asked += len(chunks)
        self.encoded += len(new)
        heads, tails, middles = [], [], []
        for x in new:
            head = x if not _SPACE.search(x) else b"" if _SPACE.match(x) else x.split(None, 1)[0]
            tail = b"" if head is x or _SPACE.match(x, len(x) - 1) else x.rsplit(None, 1)[-1]
            heads.append(head)
            tails.append(tail)
            middles.append(x[len(head) : len(x) - len(tail)])
        for x, head, tail, (ids, text) in zip(new, heads, tails, self.many(middles), strict=True):
            self.kept[x] = (head, None if head is x else ids, tail, text)
            self.held += self._bytes(x)

    def _bytes(self, chunk: bytes) -> int:
        _, ids, _, text = self.kept[chunk]
        return 2 * len(chunk) + len(ids or b"") + len(text) + 400

    def documents(self, data: np.ndarray, off: np.ndarray) -> list[tuple[bytes, bytes]]:
        """Ids and decoded text of each row of a slice: its chunks' own, and every join encoded anew."""
        raw, cuts = data.tobytes(), cut_points(data, off)
        starts = np.concatenate([[0], cuts[:-1]]).tolist() if len(cuts) else []
        chunks = [raw[i:j] for i, j in zip(starts, cuts.tolist(), strict=True)]
        self.learn(chunks)
        bounds = np.searchsorted(cuts, off, side="right").tolist()
        joins: list[bytes] = []
        out: list[list[int | tuple[bytes, bytes]]] = []  # per row: ids and text, or the number of a join
        for k in range(len(off) - 1):
            row: list[int | tuple[bytes, bytes]] = []
            open_: list[bytes] = []  # the stretch around a join that no white space has ended yet
            for chunk in [*chunks[bounds[k] : bounds[k + 1]], None]:
                head, ids, tail, text = self.kept[chunk] if chunk is not None else (b"", b"", b"", b"")
                if head:
                    open_.append(head)
                if ids is None:
                    continue
                if open_:
                    row.append(len(joins))
                    joins.append(b"".join(open_))
                    open_ = []
                if ids:
                    row.append((ids, text))
                if tail:
                    open_.append(tail)
            out.append(row)
        repaired = self.many(joins)
        whole = [[repaired[x] if isinstance(x, int) else x for x in row] for row in out]
        return [(b"".join([x for x, _ in row]), b" ".join([y for x, y in row if x])) for row in whole]


@lru_cache(maxsize=4)
def store_of(path: str) -> ChunkStore:
    """This worker's store; Spark's workers serve many tasks."""
    return ChunkStore(encoder(path))


SCHEMA = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def _selected(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    source = docs.select(docs[id_col], docs[text_col].alias("_text"))
    return source, source.schema[0].dataType.simpleString()


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep: bool = True) -> DataFrame:
    """Id, ``ids`` (binary, little-endian 32-bit) and ``decoded`` of each text, or with keep=False their digests."""
    source, id_type = _selected(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = store_of(path)
        for batch in batches:
            for i, j, data, off in _text.slices(batch.column(1)):
                got = store.documents(data, off)
                ident = batch.column(0).slice(i, j - i)
                if keep:
                    yield pa.RecordBatch.from_arrays([ident, pa.array([x for x, _ in got], pa.binary()), pa.array([y.decode("utf-8", "replace") for _, y in got], pa.string())], [id_col, "ids", "decoded"])
                else:
                    yield pa.RecordBatch.from_arrays(
                        [ident, pa.array([len(x) // 4 for x, _ in got], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x, _ in got]), pa.array([hashlib.sha256(y).hexdigest() for _, y in got])],
                        [id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
                    )

    return source.mapInArrow(run, f"`{id_col}` {id_type}, " + ("ids binary, decoded string" if keep else SCHEMA))
