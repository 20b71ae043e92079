"""Ordered streams: any files, any micro-batches and any Arrow parts give the rows of the batch twins; late rows are given back."""

import random
import time as clock
from types import SimpleNamespace

import pyarrow as pa
import pytest

from tracklake.operators import association, series
from tracklake.streaming import ordered, pairing
from tracklake.streaming.ordered import rocksdb_state

SECOND = 1_000_000_000
N = 40_000
SIDED = "segment_id string, side int, i long, t long"
END = 10**7 * SECOND


def run_stream(spark, folder, files, schema, make, per_batch=None):
    """The rows of a stream over the files (lists of rows), read in this order, ``per_batch`` at a time (all at once if None)."""
    for k, part in enumerate(files):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder / "in"))
        if per_batch:
            clock.sleep(0.05 if k else 0)
    source = spark.readStream.schema(schema)
    source = (source.option("maxFilesPerTrigger", per_batch) if per_batch else source).parquet(str(folder / "in"))
    name = f"out_{abs(hash(str(folder)))}"
    with rocksdb_state(spark):
        run = make(source).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(folder / "state")).start()
    assert run.awaitTermination(300)
    return spark.table(name)


def dealt(rows, way, beat):
    """One sorted file; four files of a time range each, mixed inside, in one batch or in four; rows dealt to four files at random."""
    if way == "sorted":
        return [[*rows, beat]], None
    if way == "random":
        mixed = random.Random(1).sample(rows, len(rows))
        return [mixed[k::4] for k in range(4)] + [[beat]], None
    step = -(-len(rows) // 4)
    parts = [random.Random(k).sample(rows[k * step : (k + 1) * step], len(rows[k * step : (k + 1) * step])) for k in range(4)]
    return [*parts, [beat]], 1 if way == "batches" else None


WAYS = ["sorted", "ranges", "batches", "random"]


def sided(seed):
    rng = random.Random(seed)
    rows = [("a", rng.randrange(2), i, t) for i, t in enumerate(sorted(rng.randrange(N * SECOND) for _ in range(N)))]
    rows += [("b", i % 2, i, i * SECOND) for i in range(0, 3000, 7)]
    return sorted(rows, key=lambda r: r[3])


@pytest.mark.parametrize("way", WAYS)
def test_one_to_one_of_a_long_recording(spark, tmp_path, way):
    rows = sided(2)
    files, per = dealt(rows, way, (None, None, None, END))
    got = run_stream(spark, tmp_path, files, SIDED, lambda s: pairing.one_to_one_stream(s, SECOND // 2, "200 seconds"), per)
    table = spark.createDataFrame(rows, SIDED)
    expected = association.one_to_one(table.where("side = 0"), table.where("side = 1"), SECOND // 2, time="t", index="i")
    assert sorted(map(tuple, got.collect())) == sorted((*r, None) for r in expected.select("segment_id", "i", "t", "sample_index", "residual_ns").collect())


@pytest.mark.parametrize("way", WAYS)
def test_nearest_of_a_long_recording(spark, tmp_path, way):
    rows = sided(3) + [("a", s, 90_000 + k, 77 * SECOND) for k, s in enumerate([0, 1, 1, 0])]  # ties in time
    rows.sort(key=lambda r: r[3])
    files, per = dealt(rows, way, (None, None, None, END))
    got = run_stream(spark, tmp_path, files, SIDED, lambda s: pairing.nearest_stream(s, SECOND // 2, "200 seconds"), per)
    table = spark.createDataFrame(rows, SIDED)
    expected = association.nearest(table.where("side = 0"), table.where("side = 1"), SECOND // 2, time="t", index="i").select("segment_id", "i", "t", "sample_index", "residual_ns")
    order = lambda r: (r[0], r[1])
    assert sorted(map(tuple, got.collect()), key=order) == sorted(((*r, None) for r in expected.collect()), key=order)


@pytest.mark.parametrize("way", WAYS)
def test_distance_samples_of_a_long_recording(spark, tmp_path, way):
    rng = random.Random(4)
    schema = "segment_id string, i long, t long, x double, y double, z double"
    rows, x = [], 0.0
    for i in range(N):
        x += rng.choice([0.125, 0.25, 0.5])
        rows.append(("a", i, i * SECOND, x, 0.0, 0.0))
    files, per = dealt(rows, way, (None, None, END, None, None, None))
    got = run_stream(spark, tmp_path, files, schema, lambda s: pairing.distance_sampled_stream(s, 25.0, "200 seconds"), per)
    expected = series.sample_by_distance(spark.createDataFrame(rows, schema), 25.0, series.ordered("segment_id", "t", "i"), "x", "y", "z")
    assert sorted(r.i for r in got.collect()) == sorted(r.i for r in expected.collect())


@pytest.mark.parametrize("way", WAYS)
def test_order_check_of_a_long_recording(spark, tmp_path, way):
    rng = random.Random(5)
    schema = "segment_id string, i long, t long, log_t long"
    rows = [("a", i, i * SECOND - rng.choice([0] * 20 + [3 * SECOND]), i * SECOND) for i in range(N)]
    files, per = dealt(rows, way, (None, None, 0, END))
    got = run_stream(spark, tmp_path, files, schema, lambda s: pairing.out_of_order_stream(s, "200 seconds"), per)
    newest, expected = -1, []
    for _, i, t, _ in rows:
        expected += [i] if t <= newest else []
        newest = max(newest, t)
    assert sorted(r.i for r in got.collect()) == expected and len(expected) > 1000


def test_late_rows_are_given_back_and_idle_keys_forgotten(spark, tmp_path):
    schema = "segment_id string, i long, t long, x double, y double, z double"
    at = lambda i, s, x: ("a", i, s * SECOND, x, 0.0, 0.0)
    files = [[at(1, 100, 0.0), at(2, 101, 0.6)], [at(3, 150, 1.2)], [at(4, 102, 9.0), at(5, 151, 2.4)], [at(6, 400, 2.5)], [("b", 7, 900 * SECOND, 0.0, 0.0, 0.0)], [("a", None, END, None, None, None)]]
    got = run_stream(spark, tmp_path, files, schema, lambda s: pairing.distance_sampled_stream(s, 1.0, "10 seconds", idle_ns=120 * SECOND), 1)
    assert sorted((r.i, r.problem or "") for r in got.collect()) == [(1, ""), (3, ""), (4, "late"), (5, ""), (6, ""), (7, "")]


def test_rows_wait_without_a_heartbeat_and_nulls_take_no_part(spark, tmp_path):
    rows = [("a", 0, 1, 5 * SECOND), ("a", 1, 2, 5 * SECOND), ("a", 0, None, 6 * SECOND), (None, 0, 4, 6 * SECOND), ("a", 1, 5, None), ("a", 0, 6, 60 * SECOND)]
    got = run_stream(spark, tmp_path, [rows], SIDED, lambda s: pairing.one_to_one_stream(s, SECOND, "10 seconds"))
    assert [tuple(r) for r in got.collect()] == [("a", 1, 5 * SECOND, 2, 0, None)]


def few(spark, tmp_path, rows, schema, make, beat):
    """Rows as three files in time order, read one a trigger, then a heartbeat."""
    files = [rows[k * len(rows) // 3 : (k + 1) * len(rows) // 3] for k in range(3)]
    return run_stream(spark, tmp_path, [*files, [beat]], schema, make, 1).where("problem is null").collect()


def test_streamed_pairs(spark, tmp_path):
    rng = random.Random(0)
    ref, smp = (sorted(rng.sample(range(3000), 60)) for _ in range(2))
    rows = sorted([("a", 0, i, t) for i, t in enumerate(ref)] + [("a", 1, i, t) for i, t in enumerate(smp)], key=lambda r: r[3])
    got = few(spark, tmp_path, rows, SIDED, lambda s: pairing.one_to_one_stream(s, 12), (None, None, None, END))
    expected, k = [], 0
    for i, t in enumerate(ref):
        while k < len(smp) and smp[k] < t - 12:
            k += 1
        if k < len(smp) and smp[k] <= t + 12:
            expected.append((i, k))
            k += 1
    assert sorted((r.i, r.sample_index) for r in got) == expected


def test_streamed_distance_sampler(spark, tmp_path):
    rows = [("a", i, i, 0.1 * i, 0.0, 0.0) for i in range(11)]
    schema = "segment_id string, i long, t long, x double, y double, z double"
    got = few(spark, tmp_path, rows, schema, lambda s: pairing.distance_sampled_stream(s, 0.15), (None, None, END, None, None, None))
    assert sorted(r.i for r in got) == [0, 2, 3, 5, 6, 8, 9]


def test_streamed_order_check(spark, tmp_path):
    rows = [("a", i, t, i) for i, t in enumerate([1, 3, 2, 5, 5, 9])]
    got = few(spark, tmp_path, rows, "segment_id string, i long, t long, log_t long", pairing.out_of_order_stream, (None, None, 0, END))
    assert sorted(r.i for r in got) == [2, 4]


def test_streamed_nearest(spark, tmp_path):
    rng = random.Random(5)
    ref, smp = (sorted(rng.sample(range(3000), 50)) for _ in range(2))
    rows = sorted([("a", 0, i, t) for i, t in enumerate(ref)] + [("a", 1, i, t) for i, t in enumerate(smp)], key=lambda r: r[3])
    got = few(spark, tmp_path, rows, SIDED, lambda s: pairing.nearest_stream(s, 40), (None, None, None, END))
    for r in got:
        j = min(range(50), key=lambda j: (abs(smp[j] - ref[r.i]), smp[j]))
        assert (r.sample_index, r.residual_ns) == ((j, smp[j] - ref[r.i]) if abs(smp[j] - ref[r.i]) <= 40 else (None, None))
    assert len(got) == 50


def test_nearest_takes_the_smallest_index_of_samples_at_one_time(spark, tmp_path):
    rows = [("a", 1, 3, 5 * SECOND), ("a", 1, 2, 5 * SECOND), ("a", 0, 9, 6 * SECOND), ("a", 1, 8, 8 * SECOND), ("a", 1, 7, 8 * SECOND)]
    got = run_stream(spark, tmp_path, [[*rows, (None, None, None, END)]], SIDED, lambda s: pairing.nearest_stream(s, 3 * SECOND))
    table = spark.createDataFrame(rows, SIDED)
    twin = association.nearest(table.where("side = 0"), table.where("side = 1"), 3 * SECOND, time="t", index="i")
    assert [r.sample_index for r in got.collect()] == [r.sample_index for r in twin.collect()] == [2]


class _State(dict):
    """A map state and value states of one bucket, and its timers."""

    def __init__(self):
        super().__init__()
        self.timers, self.most = [], 0

    def getMapState(self, *_):
        return self

    def getValueState(self, *_):
        held = []
        return SimpleNamespace(exists=lambda: bool(held), get=lambda: held[0], update=lambda v: held.__setitem__(slice(None), [v]), clear=held.clear)

    def updateValue(self, k, v):
        self[k] = v

    def getValue(self, k):
        return self[k]

    def removeKey(self, k):
        del self[k]

    def listTimers(self):
        return iter(self.timers)

    def registerTimer(self, at):
        self.timers.append(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


def test_rows_wait_as_blocks_and_are_walked_some_blocks_at_a_time(monkeypatch):
    monkeypatch.setattr(ordered, "_BLOCK", 50)
    monkeypatch.setattr(ordered, "_GATHERED", 1000)
    monkeypatch.setattr(ordered, "_SWEEP", 3)
    rng = random.Random(6)
    rows = [(0, rng.choice("ab"), rng.randrange(5000) * SECOND, False, i, i % 97) for i in range(5000)]
    batches = [pa.RecordBatch.from_pylist([dict(zip(("bucket", "key", "at", "beat", "i", "t"), r)) for r in rows[k : k + 300]]) for k in range(0, 5000, 300)]
    blocks = pa.Table.from_batches(list(ordered._blocks(iter(batches)))).to_pandas()
    assert len(blocks) < 150
    sizes = []
    walked = ordered.InOrder._walked
    monkeypatch.setattr(ordered.InOrder, "_walked", lambda self, held, walk: sizes.append(len(held)) or walked(self, held, walk))
    state = _State()
    one = ordered.InOrder(pairing.NotAfter(), ["at", "i", "t"], ["at", "i"], ["k", "i", "t", "problem"], {"i": "i", "t": "t"})
    one.init(state)
    at = lambda s: SimpleNamespace(getCurrentWatermarkInMs=lambda: s * 1000)
    assert not list(one.handleInputRows((0,), iter([blocks]), at(0)))
    got = []
    for s in (1234, 6000):
        gone, state.timers = state.timers[0], state.timers
        got += [r for f in one.handleExpiredTimer((0,), at(s), SimpleNamespace(getExpiryTimeInMs=lambda: gone)) for r in f[["k", "i"]].itertuples(index=False, name=None)]
        state.timers = [t for t in state.timers if t != gone]
    expected = []
    for k in "ab":
        newest = -1
        for _, _, _, _, i, t in sorted((r for r in rows if r[1] == k), key=lambda r: (r[2], r[4])):
            expected += [(k, i)] if t <= newest else []
            newest = max(newest, t)
    assert sorted(got) == sorted(expected) and not state and sum(sizes) == 5000 and max(sizes) < 1000
