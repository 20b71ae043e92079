"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are looked up in a learned embedding; learned filters over ``2 * stride`` bytes, at every
``stride`` bytes, run over the whole document. Their rectified answers are max-pooled inside chunks of ``chunk``
bytes that overlap by half; the mean and the largest of the chunks' values, over all chunks, combine to one logistic
score. No part of a text is left out, and a long text costs memory for one slice's answers only. What lies beyond a
text's end is a symbol of its own, never the next row, so a score depends on the text alone.

Training takes a bounded sample of labelled rows (``sample`` rows, those with the smallest hashes of their ids), whole
texts, to one task, which hands the driver the weights alone; scoring covers everything.

Defined results: a null or empty text is scored as a text of no bytes (one chunk of the end symbol); repeated rows get
equal scores (to 6 digits, in whatever batch and order they come); rows with a null label are not learned from; no label
at all gives 0.5 for every text; ties and very long texts are nothing special; other columns of the input, whatever
their names, are no inputs of the score; an empty table gives no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklake.llm import _text


@dataclass(frozen=True)
class ClassifierPolicy:
    embedding: int = 8
    filters: int = 32
    stride: int = 4
    #: Bytes of a chunk; the next one begins half a chunk later.
    chunk: int = 256
    #: Bound of the labelled rows that training sees.
    sample: int = 6000
    steps: int = 600
    batch: int = 32
    rate: float = 0.004
    seed: int = 11


@dataclass
class Model:
    table: np.ndarray  # 256 x embedding; a row of its own (256) for what is beyond the end
    near: np.ndarray  # stride * embedding x filters
    far: np.ndarray
    bias: np.ndarray
    mean_weight: np.ndarray
    max_weight: np.ndarray
    offset: float


#: Half chunks whose answers are held at once.
_WINDOW = 4096


def _padded(data: np.ndarray, off: np.ndarray, policy: ClassifierPolicy) -> tuple[np.ndarray, np.ndarray]:
    """Symbols with each row filled up (by 256) to whole half chunks and one stride more; half chunks of each row."""
    half, stride = policy.chunk // 2, policy.stride
    size = np.diff(off)
    halves = np.maximum(1, -(-size // half))
    begin = np.concatenate([[0], np.cumsum(halves * half)])
    out = np.full(begin[-1] + stride, 256, np.uint16)
    out[np.repeat(begin[:-1] - off[:-1], size) + np.arange(len(data))] = data
    return out, halves


def _windows(symbols: np.ndarray, ends: np.ndarray, model: Model, policy: ClassifierPolicy) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Runs of half chunks: which they are, their embedded strides and one more, and the last strides of rows among them."""
    half, per = policy.chunk // 2, policy.chunk // 2 // policy.stride
    for begin in range(0, len(ends), _WINDOW):
        stop = min(begin + _WINDOW, len(ends))
        strides = model.table[symbols[begin * half : stop * half + policy.stride]].reshape(-1, policy.stride * policy.embedding)
        yield slice(begin, stop), strides, (np.flatnonzero(ends[begin:stop]) + 1) * per - 1


def _lows(symbols: np.ndarray, ends: np.ndarray, model: Model, policy: ClassifierPolicy, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """The filters' largest answers in each half chunk and, if wanted, at which of its strides they are.

    Behind a row's last stride comes a stride of end symbols, whatever row is next.
    """
    per = policy.chunk // 2 // policy.stride
    low = np.empty((len(ends), policy.filters), np.float32)
    at = np.empty((len(ends), policy.filters), np.int8) if places else None
    end = np.tile(model.table[256], policy.stride) @ model.far
    for held, strides, last in _windows(symbols, ends, model, policy):
        beyond = strides[1:] @ model.far
        beyond[last] = end
        answers = (strides[:-1] @ model.near + beyond).reshape(-1, per, policy.filters)
        low[held] = answers.max(axis=1)
        if at is not None:
            at[held] = answers.argmax(axis=1)
    return low, at


def _chunks(halves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which halves end a row; first and second half of each chunk (a row of one half has one chunk of it alone); chunks of each row."""
    last = np.cumsum(halves) - 1
    ends = np.zeros(int(halves.sum()), bool)
    ends[last] = True
    first = ~ends
    first[last[halves == 1]] = True
    first = np.flatnonzero(first)
    return ends, first, np.where(ends[first], first, first + 1), np.maximum(halves - 1, 1)


def score_slice(data: np.ndarray, off: np.ndarray, model: Model, policy: ClassifierPolicy) -> np.ndarray:
    symbols, halves = _padded(data, off, policy)
    ends, first, second, chunks = _chunks(halves)
    low, _ = _lows(symbols, ends, model, policy)
    pooled = np.maximum(np.maximum(low[first], low[second]) + model.bias, 0)
    begin = np.cumsum(chunks) - chunks
    mean = np.add.reduceat(pooled, begin) / chunks[:, None]
    top = np.maximum.reduceat(pooled, begin)
    logit = mean @ model.mean_weight + top @ model.max_weight + model.offset
    # matrix products differ in their last bits with the batch's shape
    return np.round(1 / (1 + np.exp(-np.clip(logit.astype(np.float64), -30, 30))), 6)


def gradients(data: np.ndarray, off: np.ndarray, labels: np.ndarray, model: Model, policy: ClassifierPolicy) -> dict[str, np.ndarray]:
    """Of the mean logistic loss over whole texts, by the model's parts."""
    symbols, halves = _padded(data, off, policy)
    ends, first, second, chunks = _chunks(halves)
    low, at = _lows(symbols, ends, model, policy, places=True)
    chosen = np.where(low[first] >= low[second], first[:, None], second[:, None])
    live = np.maximum(np.maximum(low[first], low[second]) + model.bias, 0)
    begin, owner = np.cumsum(chunks) - chunks, np.repeat(np.arange(len(chunks)), chunks)
    mean, top = np.add.reduceat(live, begin) / chunks[:, None], np.maximum.reduceat(live, begin)
    logit = np.clip((mean @ model.mean_weight + top @ model.max_weight + model.offset).astype(np.float64), -30, 30)
    error = ((1 / (1 + np.exp(-logit)) - labels) / len(labels)).astype(np.float32)
    largest = live == top[owner]  # overlapping chunks often have the same largest answer
    ties = np.add.reduceat(largest.astype(np.float32), begin)
    back = (error / chunks)[owner, None] * model.mean_weight + np.where(largest, (error[:, None] * model.max_weight / ties)[owner], 0)
    back = np.where(live > 0, back, 0)
    # each half's answer came from one stride; a half serves one or two chunks
    filters = np.arange(policy.filters)
    of_half = np.bincount((chosen * policy.filters + filters).reshape(-1), back.reshape(-1), low.size).reshape(low.shape).astype(np.float32)
    end, per = np.tile(model.table[256], policy.stride), policy.chunk // 2 // policy.stride
    near, far, table = np.zeros_like(model.near), np.zeros_like(model.far), np.zeros((257, policy.embedding))
    for held, strides, last in _windows(symbols, ends, model, policy):
        grad = np.zeros((held.stop - held.start, per, policy.filters), np.float32)
        np.put_along_axis(grad, at[held].astype(np.int64)[:, None], of_half[held][:, None], axis=1)
        grad = grad.reshape(-1, policy.filters)
        near += strides[:-1].T @ grad
        moved = np.zeros_like(strides)
        moved[:-1] = grad @ model.near.T
        ended = grad[last].sum(0)
        grad[last] = 0
        far += strides[1:].T @ grad + np.outer(end, ended)
        moved[1:] += grad @ model.far.T
        table[256] += (model.far @ ended).reshape(policy.stride, policy.embedding).sum(0)
        moved, here = moved.reshape(-1, policy.embedding), symbols[held.start * per * policy.stride :][: strides.shape[0] * policy.stride]
        table += np.stack([np.bincount(here, moved[:, k], 257) for k in range(policy.embedding)], axis=1)
    return {"table": table, "near": near, "far": far, "bias": back.sum(0), "mean_weight": error @ mean, "max_weight": error @ top, "offset": error.sum()}


def train(data: np.ndarray, off: np.ndarray, labels: np.ndarray, policy: ClassifierPolicy = ClassifierPolicy()) -> Model:
    """Adam on the logistic loss over whole texts (bytes and the n + 1 offsets), both labels weighted alike in each batch."""
    rng = np.random.default_rng(policy.seed)
    width = policy.stride * policy.embedding
    f32 = lambda x: x.astype(np.float32)
    model = Model(f32(rng.normal(0, 0.5, (257, policy.embedding))), f32(rng.normal(0, width**-0.5, (width, policy.filters))), f32(rng.normal(0, width**-0.5, (width, policy.filters))), np.zeros(policy.filters, np.float32), f32(rng.normal(0, 0.1, policy.filters)), f32(rng.normal(0, 0.1, policy.filters)), 0.0)
    sides = [np.flatnonzero(labels == 0), np.flatnonzero(labels == 1)]
    if not len(sides[0]) or not len(sides[1]):
        model.mean_weight[:] = model.max_weight[:] = 0
        model.offset = 0.0 if not len(labels) else 5.0 if len(sides[1]) else -5.0
        return model
    names = ["table", "near", "far", "bias", "mean_weight", "max_weight", "offset"]
    first, second = ({k: np.zeros_like(getattr(model, k)) for k in names} for _ in range(2))
    for step in range(1, policy.steps + 1):
        chosen = np.concatenate([rng.choice(s, policy.batch // 2) for s in sides])
        texts = [data[off[r] : off[r + 1]] for r in chosen.tolist()]
        found = gradients(np.concatenate(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])]), labels[chosen], model, policy)
        rate = policy.rate * min(1.0, 2 * (1 - step / (policy.steps + 1)))
        for k in names:
            g = found[k] + 1e-4 * getattr(model, k)
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            moved = getattr(model, k) - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)
            setattr(model, k, np.float32(moved) if k == "offset" else f32(moved))
    return model


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", policy: ClassifierPolicy = ClassifierPolicy()) -> Model:
    """A model from at most ``policy.sample`` labelled rows: those whose ids have the smallest hashes, so rows of any place are as likely.

    One task trains on the sample's whole texts; what the driver gets are the weights.
    """
    chosen = (
        labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label")).where("_id is not null and _label in (0, 1)")
        .orderBy(F.xxhash64("_id"), "_id", "_label").limit(policy.sample)
    )
    # the sample is bounded by policy.sample rows, so it may be broadcast to the texts
    found = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id")
    digest = F.xxhash64("_text")
    rows = found.select("_text", F.col("_label").cast("long").alias("_label"), F.xxhash64("_id").alias("_key"), digest.alias("_digest")).orderBy("_key", "_digest", "_label").limit(policy.sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            sample = pa.Table.from_batches(held).combine_chunks()
            order = np.lexsort([sample.column(k).to_numpy() for k in (1, 3, 2)])
            data, off = _text.text_bytes(sample.column(0).take(pa.array(order)))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(data, off, sample.column(1).to_numpy()[order], policy))], pa.binary())], ["model"])

    # limit() leaves one partition
    got = rows.mapInArrow(run, "model binary").collect()
    return pickle.loads(got[0][0]) if got else train(np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(0, np.int64), policy)


def _scores(column: pa.Array, model: Model, policy: ClassifierPolicy) -> np.ndarray:
    parts = [score_slice(data, off, model, policy) for _, _, data, off in _text.slices(column)]
    return np.concatenate(parts) if parts else np.zeros(0)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", policy: ClassifierPolicy = ClassifierPolicy()) -> DataFrame:
    """Id, score and predicted (1 if the score is at least 0.5) of each text."""
    source = docs.select(docs[id_col], docs[text_col].alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _scores(batch.column(1), model, policy)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), pa.array((found >= 0.5).astype(np.int32))], [id_col, "score", "predicted"])

    return source.mapInArrow(run, f"`{id_col}` {source.schema[0].dataType.simpleString()}, score double, predicted int")


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", policy: ClassifierPolicy = ClassifierPolicy()) -> DataFrame:
    """The rows, with all their columns, that are predicted to be of label 1."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(batch.column(at), model, policy) >= 0.5))

    return docs.mapInArrow(run, docs.schema)
