"""Best-fit packing of documents into sequences of a fixed number of tokens, by linear grouping.

Every document becomes its ids and an end id; only one longer than a sequence is cut into full pieces and a rest.
What the plan needs of the corpus is the count of pieces by length, at most ``capacity`` rows, whatever the input.
On that histogram the driver

1. puts the large lengths (over a share of the capacity) into groups of equal cardinality and rounds each length up
   to the largest of its group,
2. fills sequences with configurations of those few sizes: the fullest that a knapsack over the sizes left finds for
   the largest one, as often as it goes,
3. puts the actual lengths in place of the rounded ones, which frees the room that rounding took,
4. places the small lengths, longest first, where the smallest sufficient room is left, and opens sequences for
   what finds none.

All this is done for a few numbers of groups and shares, of bounded work each, and the plan with the fewest sequences
stands. The steps work on ranges of equal pieces and equal sequences, so a plan has some thousand rows. Each piece
then finds its place by its number within its length, which comes from counts by (length, salt) and a numbering
inside each; a length that a third of all pieces share is spread over the salts. No group of pieces is gathered.

Defined results: a null or empty text is one piece with the end id alone; repeated rows are packed as often as they
occur; pieces of equal length are interchangeable and numbered by id, so ties don't change the number of sequences; a null
id is kept and packed like any other; a very long text is tokenised whole, in one task, and cut into full pieces; an
empty table gives no rows; other columns of the input, whatever their names, aren't looked at.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracklake.llm import _session, _text
from tracklake.llm.tokens import _selected, encoder


@dataclass(frozen=True)
class PackingPolicy:
    capacity: int = 2048
    end_id: int = 0
    #: Lengths over this share of the capacity are large; the best of the plans is taken.
    large_shares: tuple[float, ...] = (0.25, 0.4)
    #: Numbers of groups of equal cardinality that large lengths are rounded up in.
    groups: tuple[int, ...] = (128, 512, 2048)


def pieces(docs: DataFrame, path: str, policy: PackingPolicy, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, piece, start, length, ids_crc32 of every piece."""
    source, id_type = _selected(docs, id_col, text_col)
    end, step = policy.end_id.to_bytes(4, "little"), 4 * policy.capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path)
        for batch in batches:
            for i, j, data, off in _text.slices(batch.column(1)):
                flat, bounds = words.encode(data, off)
                raw, bounds = flat.astype("<u4").tobytes(), (4 * bounds).tolist()
                at, number, start, length, crc = [], [], [], [], []
                for k in range(j - i):
                    ids = raw[bounds[k] : bounds[k + 1]] + end
                    for n, begin in enumerate(range(0, len(ids), step)):
                        part = ids[begin : begin + step]
                        at.append(k)
                        number.append(n)
                        start.append(begin // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                ident = batch.column(0).slice(i, j - i).take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([ident, pa.array(number, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], [id_col, "piece", "start", "length", "ids_crc32"])

    return source.mapInArrow(run, f"`{id_col}` {id_type}, piece int, start long, length long, ids_crc32 long")


@dataclass
class _Run:
    """Equal sequences: the first one's number, how many, and the room left in each."""

    first: int
    count: int
    room: int


def _groups(counts: dict[int, int], sizes: list[int], n: int) -> list[list[int]]:
    """Large lengths, descending, in groups of about equal cardinality; a length is never split."""
    total, out, held = sum(counts[s] for s in sizes), [[]], 0
    for s in sizes:
        if out[-1] and held >= len(out) * total / n:
            out.append([])
        out[-1].append(s)
        held += counts[s]
    return [g for g in out if g]


def _fullest(sizes: list[int], left: list[int], capacity: int) -> list[int]:
    """Groups of the fullest configuration that holds the largest size left: a knapsack over all sums within the room.

    Bit k of a number says whether the sizes so far can sum up to k; the sums before each size lead back to a choice.
    """
    lead = next(i for i, n in enumerate(left) if n)
    room = capacity - sizes[lead]
    sums, within = 1, (1 << (room + 1)) - 1
    before: list[tuple[int, int]] = []
    for i in range(len(sizes) - 1, lead - 1, -1):  # larger sizes come last and are taken first on the way back
        s = sizes[i]
        for _ in range(min(left[i] - (i == lead), room // s)):
            before.append((i, sums))
            sums |= (sums << s) & within
    out, filled = [lead], sums.bit_length() - 1
    for i, held in reversed(before):
        if not held >> filled & 1:
            out.append(i)
            filled -= sizes[i]
    return out


def plan(counts: dict[int, int], policy: PackingPolicy) -> list[tuple[int, int, int, int, int]]:
    """The plan with the fewest sequences over the policy's sets of groups and shares (each of bounded work)."""
    plans = [grouped_plan(counts, policy, g, x) for g in policy.groups for x in policy.large_shares]
    return min(plans, key=lambda rows: max((s + b - a for _, a, b, s, _ in rows), default=0))


def grouped_plan(counts: dict[int, int], policy: PackingPolicy, n_groups: int, large_share: float) -> list[tuple[int, int, int, int, int]]:
    """(length, first number, end number, sequence of the first, offset): a piece's place by its number in its length."""
    capacity = policy.capacity
    out: list[tuple[int, int, int, int, int]] = []
    sequences = 0
    rooms: dict[int, list[_Run]] = {}

    def leave(run: _Run) -> None:
        if run.room:
            rooms.setdefault(run.room, []).append(run)

    # full pieces: a configuration of their own
    if full := counts.get(capacity, 0):
        out.append((capacity, 0, full, 0, 0))
        sequences = full
    large = sorted((s for s in counts if capacity * large_share < s < capacity), reverse=True)
    groups = _groups(counts, large, n_groups) if large else []
    size, left = [g[0] for g in groups], [sum(counts[s] for s in g) for g in groups]
    used = [0] * len(groups)
    ends: list[tuple[list[int], list[int]]] = []  # of each group: end numbers within the group, lengths
    for g in groups:
        at, marks = 0, []
        for s in g:
            at += counts[s]
            marks.append(at)
        ends.append((marks, g))
    while any(left):
        chosen = _fullest(size, left, capacity)
        need = {i: chosen.count(i) for i in chosen}
        times = min(left[i] // k for i, k in need.items())
        # a slot of the configuration takes the next ``times`` pieces of its group; actual lengths replace rounded ones
        slots, breaks = [], {0, times}
        for i in chosen:
            marks = ends[i][0]
            k = bisect.bisect_right(marks, used[i])
            while k < len(marks) and marks[k] < used[i] + times:
                breaks.add(marks[k] - used[i])
                k += 1
            slots.append((i, used[i]))
            used[i] += times
            left[i] -= times
        order = sorted(breaks)
        for a, b in zip(order, order[1:], strict=False):
            offset = 0
            for i, base in slots:
                marks, lengths = ends[i]
                k = bisect.bisect_right(marks, base + a)
                before = marks[k - 1] if k else 0
                out.append((lengths[k], base + a - before, base + b - before, sequences + a, offset))
                offset += lengths[k]
            leave(_Run(sequences + a, b - a, capacity - offset))
        sequences += times
    # small lengths, longest first, each into the smallest sufficient room
    for s in sorted((s for s in counts if s <= capacity * large_share), reverse=True):
        number, todo = 0, counts[s]
        while todo:
            room = min((r for r, runs in rooms.items() if r >= s and runs), default=None)
            if room is None:
                fit = capacity // s
                new = -(-todo // fit)
                leave(_Run(sequences, new, capacity))
                sequences += new
                continue
            run = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
            # as many in each as fit, while there are enough for all; else in as many sequences as needed
            each = min(room // s, max(1, todo // run.count))
            n = min(run.count, todo // each)
            for k in range(each):
                out.append((s, number, number + n, run.first, capacity - room + k * s))
                number += n
            todo -= n * each
            leave(_Run(run.first, n, room - each * s))
            if n < run.count:
                leave(_Run(run.first + n, run.count - n, room))
    return out


def packed(parts: DataFrame, policy: PackingPolicy, id_col: str = "doc_id") -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``. ``parts`` is read three times and must be stable."""
    spark = parts.sparkSession
    salts = max(64, _session.shuffle_partitions(spark))
    salted = parts.withColumn("_salt", F.pmod(F.xxhash64(id_col, "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    by_salt = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    base = by_salt.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    # at most ``capacity`` rows
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows = plan(counts, policy)
    places = spark.createDataFrame(rows, "_length long, _from long, _to long, _sequence long, _offset long")
    numbered = (
        salted.withColumn("_k", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(id_col, "piece", "ids_crc32")))
        .join(base, ["length", "_salt"])
        .withColumn("_number", F.col("_base") + F.col("_k") - 1)
    )
    # the plan's size depends on the capacity and the groups alone, so it may be broadcast
    return numbered.join(F.broadcast(places), (F.col("length") == F.col("_length")) & (F.col("_number") >= F.col("_from")) & (F.col("_number") < F.col("_to"))).select(
        id_col, "piece", "start", "length", "ids_crc32", (F.col("_sequence") + F.col("_number") - F.col("_from")).alias("sequence_id"), F.col("_offset").alias("offset")
    )


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", policy: PackingPolicy = PackingPolicy()) -> DataFrame:
    return packed(_session.checkpointed(pieces(docs, path, policy, id_col, text_col)), policy, id_col)
