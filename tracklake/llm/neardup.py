"""Near-duplicate groups: one-permutation hashing with optimal densification, banded buckets, star-shaped edges.

1. A task turns each text into its set of distinct 64-bit shingle hashes. One hash of each shingle picks a bin and
   a value; the smallest value of each bin is the signature. An empty bin takes the value of another bin, which a
   hash of (bin, attempt) chooses, so equal sets fill alike. Signatures give band keys and an 8-bit sketch.
2. Equal sets are one class from here on: copies never become pairs.
3. A bucket is a band key and a size class. Classes are a factor of 2.5 wide, and a set whose partners may be in the
   next one stands in both, so every pair of the wanted similarity has a class in common, and a text that is part of a
   much longer one doesn't meet it. In each bucket every class gets one edge to the bucket's smallest class: as many
   edges as rows, however large the bucket. Edges whose sketches agree on less than ``useful`` are dropped; components of
   the others are candidate clusters. A pair is lost only if the smallest class of every bucket that it shares, about
   twelve of them, is such a stranger; for that it must agree with one of the pair in four values of each, and a
   stranger that holds all of a text of its size class agrees on 30 % or more.
4. Inside a cluster links are exact: full sets, rarest shingles first, are looked up by the prefix that any set of
   the wanted similarity must share, and intersections are counted. Pairs that are connected already aren't tested,
   and no pair leaves the task, only each class's root. A cluster over ``block_bytes`` is dealt in bands of sizes, a
   factor of 4/3 wide, and a large band in blocks; only blocks of the same and of neighbouring bands can hold links, and
   meet in a task, two at a time. So a task's memory is bounded and no pair is left out.
5. Roots (joined again over blocks) give the components, and every row gets its class's; classes of very many rows are
   met by a broadcast of bounded size.

With the default bands two texts of similarity 0.75 miss all common buckets with a probability below 1e-5 for long
texts. Shingles and sets are told apart by 64-bit hashes.

Defined results: a text without words has an empty set and is linked with nothing; repeated rows get equal results;
very long texts are nothing special; an empty table gives no rows;
a row with a null id takes part (its text's digest stands for it) but names no component, which is null only if no row
of it has an id. Ids may repeat: ``near_duplicates`` names ids, so all rows of a component's id say kept; ``keep_one_row``
goes by id and text and keeps one row. Other columns of the input aren't looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklake.llm import _text
from tracklake.llm._session import checkpointed, hot_join
from tracklake.llm.components import connected_components


@dataclass(frozen=True)
class NearDupPolicy:
    words: int = 5
    percent: int = 75
    bands: int = 40
    rows: int = 4
    #: Edges below this estimated similarity form no cluster.
    useful: float = 0.25
    #: Width of a size class.
    size_class: float = 2.5
    block_bytes: int = 16 << 20


def shingle_sets(data: np.ndarray, off: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, ascending, one row after another, and the n + 1 offsets."""
    w = _text.words(data, off, _text.BLANK, lower=True)
    at, value = _text.windows(w, words)
    row = w.row[at]
    short = np.flatnonzero((w.counts > 0) & (w.counts < words))
    if len(short):
        whole = np.array([_text.sequence_hash(w.hash[w.first[r] : w.first[r + 1]]) for r in short.tolist()], np.uint64)
        row, value = np.concatenate([row, short]), np.concatenate([value, whole])
    order = np.argsort(value)
    order = order[np.argsort(row[order].astype(np.uint16), kind="stable")]  # a slice has at most 4096 rows
    row, value = row[order], value[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    row, value = row[fresh], value[fresh]
    first = np.zeros(len(off), np.int64)
    np.cumsum(np.bincount(row, minlength=len(off) - 1), out=first[1:])
    return value, first


def set_ids(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit id of each row's set (0 for an empty one)."""
    total = np.zeros(len(value) + 1, np.uint64)
    np.cumsum(_text.mix(value ^ np.uint64(0xA5A5F00D)), out=total[1:])
    size = np.diff(first).astype(np.uint64)
    return np.where(size > 0, _text.mix(total[first[1:]] - total[first[:-1]] + size * np.uint64(0x9E3779B97F4A7C15)), np.uint64(0)).view(np.int64)


def signatures(value: np.ndarray, first: np.ndarray, bins: int) -> np.ndarray:
    """Densified one-permutation signatures, n x bins of 32 bits; rows of empty sets are all zero."""
    n = len(first) - 1
    row = np.repeat(np.arange(n), np.diff(first))
    h = _text.mix(value ^ np.uint64(0x5DEECE66D))
    cell = row.astype(np.uint64) * np.uint64(bins) + (h >> np.uint64(32)) % np.uint64(bins)
    key = np.sort((cell << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF)))
    cell, low = (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    lead = np.ones(len(key), bool)
    lead[1:] = cell[1:] != cell[:-1]
    out, filled = np.zeros(n * bins, np.uint32), np.zeros(n * bins, bool)
    out[cell[lead]], filled[cell[lead]] = low[lead], True
    out, filled = out.reshape(n, bins), filled.reshape(n, bins)
    todo_row, todo_bin = np.nonzero(~filled & (np.diff(first) > 0)[:, None])
    attempt = 0
    while len(todo_row):
        attempt += 1
        other = _text.mix(todo_bin.astype(np.uint64) + np.uint64(attempt << 20)) % np.uint64(bins)
        if attempt > 8 * bins:  # with a bin or two filled, chance may take long; any fixed rule will do
            other = (todo_bin + attempt) % bins
        other = other.astype(np.int64)
        hit = filled[todo_row, other]
        out[todo_row[hit], todo_bin[hit]] = out[todo_row[hit], other[hit]]
        todo_row, todo_bin = todo_row[~hit], todo_bin[~hit]
    return out


def band_keys(signature: np.ndarray, policy: NearDupPolicy) -> np.ndarray:
    n = len(signature)
    cells = signature.reshape(n, policy.bands, policy.rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(policy.bands, dtype=np.uint64), (n, policy.bands)).copy()
    for k in range(policy.rows):
        key = _text.mix(key * np.uint64(0x9E3779B97F4A7C15) + cells[:, :, k] + np.uint64(1))
    return key.view(np.int64)


def _lists(flat: np.ndarray, first: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(flat))


def _signed(source: DataFrame, id_col: str, policy: NearDupPolicy) -> DataFrame:
    bins = policy.bands * policy.rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, off in _text.slices(batch.column(1)):
                value, first = shingle_sets(data, off, policy.words)
                empty = np.diff(first) == 0
                signature = signatures(value, first, bins)
                keys = band_keys(signature, policy)
                sketch = (signature & np.uint32(255)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        batch.column(2).slice(i, j - i),
                        pa.array(np.diff(first)),
                        pa.array(set_ids(value, first), mask=empty),
                        _lists(keys.reshape(-1), np.arange(j - i + 1) * policy.bands),
                        pa.array([x.tobytes() for x in sketch], pa.binary()),
                    ],
                    [id_col, "_digest", "n_shingles", "node", "bands", "sketch"],
                )

    return source.mapInArrow(run, f"`{id_col}` {source.schema[0].dataType.simpleString()}, _digest long, n_shingles long, node long, bands array<long>, sketch binary")


def _useful(edges: DataFrame, policy: NearDupPolicy) -> DataFrame:
    bins = policy.bands * policy.rows
    least = bins * (policy.useful + (1 - policy.useful) / 256)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, bins) for k in (2, 3))
            yield batch.select([0, 1]).filter(pa.array((x == y).sum(axis=1) >= least))

    return edges.mapInArrow(run, "a long, b long")


def link_sets(node: np.ndarray, flat: np.ndarray, first: np.ndarray, percent: int) -> np.ndarray:
    """Root (smallest node reachable) of each set of a cluster, by exact intersections."""
    n, size = len(node), np.diff(first)
    owner = np.repeat(np.arange(n), size)
    _, token, often = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(often), np.int64)
    rank[np.argsort(often, kind="stable")] = np.arange(len(often))
    token = rank[token]
    token = np.sort(owner * len(often) + token) - owner * len(often)  # rarest first in each set
    often = np.sort(often)
    prefix = size - (percent * size + 99) // 100 + 1
    position = np.arange(len(token)) - np.repeat(first[:-1], size)
    lead = (position < prefix[owner]) & (often[token] > 1)
    key = np.sort(token[lead] * n + owner[lead])
    post_token, post_owner = key // n, key % n
    lead_first = np.zeros(n + 1, np.int64)
    np.cumsum(np.bincount(owner[lead], minlength=n), out=lead_first[1:])
    lead_token = token[lead]
    begin = np.searchsorted(post_token, lead_token, side="left")
    end = np.searchsorted(key, lead_token * n + owner[lead], side="left")  # sets before this one
    label, mark = np.arange(n), np.zeros(len(often), bool)
    for x in range(n):
        a, b = lead_first[x], lead_first[x + 1]
        spans = [post_owner[i:j] for i, j in zip(begin[a:b].tolist(), end[a:b].tolist(), strict=True) if j > i]
        if not spans:
            continue
        found = np.unique(np.concatenate(spans))
        found = found[(label[found] != label[x]) & (100 * np.minimum(size[found], size[x]) >= percent * np.maximum(size[found], size[x]))]
        if not len(found):
            continue
        mark[token[first[x] : first[x + 1]]] = True
        ends = np.cumsum(size[found])
        at = np.repeat(first[:-1][found] - ends + size[found], size[found]) + np.arange(ends[-1])
        both = np.add.reduceat(mark[token[at]].astype(np.int64), ends - size[found])
        mark[token[first[x] : first[x + 1]]] = False
        for y in np.unique(label[found[100 * both >= percent * (size[found] + size[x] - both)]]).tolist():
            label[label == y] = label[x]
    root = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(root, label, node)
    return root[label]


def _first_row(id_col: str) -> Column:
    """The smallest (id, text digest) of a group; rows without an id come last."""
    return F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("_digest").alias("digest")))


def _components(docs: DataFrame, id_col: str, text_col: str, policy: NearDupPolicy) -> tuple[DataFrame, DataFrame]:
    """Rows (id, _digest, n_shingles, node, bands, sketch) and, for each node, its rows' number and the first row of its component."""
    source = docs.select(docs[id_col], docs[text_col].alias("_text"), F.xxhash64(docs[text_col]).alias("_digest"))
    rows = checkpointed(_signed(source, id_col, policy))
    classes = checkpointed(
        rows.where("node is not null").groupBy("node").agg(_first_row(id_col).alias("rep"), F.first("n_shingles").alias("n"), F.count("*").alias("held"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    )
    size = lambda n: F.floor(F.log(n) / F.log(F.lit(policy.size_class)))
    sized = classes.select("node", "bands", F.explode(F.array_distinct(F.array(size(F.col("n")), size(F.col("n") * (100.001 / policy.percent))))).alias("size"))
    bucket = sized.select("node", "size", F.explode("bands").alias("key")).select("node", F.xxhash64("key", "size").alias("key"))
    star = bucket.groupBy("key").agg(F.min("node").alias("center"), F.count("*").alias("held")).where("held > 1").select("key", "center")
    edges = bucket.join(star, "key").where("node <> center").select("center", "node").distinct()
    sketch = classes.select("node", "sketch")
    sketched = (
        edges.join(sketch.toDF("center", "x"), "center")
        .join(sketch.toDF("node", "y"), "node")
        .select(F.col("center").alias("a"), F.col("node").alias("b"), "x", "y")
    )
    clusters = connected_components(_useful(sketched, policy))

    member = checkpointed(clusters.withColumnRenamed("root", "cluster").join(classes.select("node", "rep", "n"), "node"))
    band = F.floor(F.log("n") / F.log(F.lit(100 / policy.percent)) + 1e-9).cast("int")
    whole = member.groupBy("cluster").agg(F.sum(8 * F.col("n")).alias("bytes")).where(F.col("bytes") > policy.block_bytes).select("cluster")
    blocks = F.ceil(F.sum(8 * F.col("n")) / F.lit(policy.block_bytes)).cast("int")
    large = checkpointed(member.withColumn("band", band).join(whole, "cluster", "left_semi").groupBy("cluster", "band").agg(blocks.alias("blocks")))
    near = large
    for name, step in (("below", 1), ("above", -1)):
        near = near.join(large.select("cluster", (F.col("band") + step).alias("band"), F.col("blocks").alias(name)), ["cluster", "band"], "left")
    member = member.withColumn("band", band).join(near, ["cluster", "band"], "left")
    member = member.select("node", "cluster", F.col("rep.id").alias(id_col), F.col("rep.digest").alias("_digest"), "band", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("blocks", "below", "above")))
    links = checkpointed(_linked(_member_sets(source, member, id_col, policy), policy))
    if not large.isEmpty():
        links = connected_components(links, "node", "root")

    rooted = checkpointed(classes.select("node", "rep", "held").join(links, "node", "left").select("node", "rep", "held", F.coalesce("root", "node").alias("root")))
    least = rooted.groupBy("root").agg(F.min("rep").alias("first"), F.count("*").alias("n"))
    return rows, checkpointed(hot_join(rooted, least.select("root", "first"), "root", least.select("root", "n")).select("node", "held", "first"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", policy: NearDupPolicy = NearDupPolicy()) -> DataFrame:
    """Id, n_shingles, component_id (smallest id reachable), kept: one row per input row."""
    rows, named = _components(docs, id_col, text_col, policy)
    rows = rows.select(F.col(id_col).alias("_id"), "n_shingles", "node")
    met = hot_join(rows.where("node is not null"), named.select("node", "first"), "node", named.select("node", F.col("held").alias("n")))
    found = met.select("_id", "n_shingles", F.col("first.id").alias("component_id")).unionByName(rows.where("node is null").select("_id", "n_shingles", F.col("_id").alias("component_id")))
    return found.select(F.col("_id").alias(id_col), "n_shingles", "component_id", F.col("_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _member_sets(source: DataFrame, member: DataFrame, id_col: str, policy: NearDupPolicy) -> DataFrame:
    """Full sets (binary, 64-bit hashes) of the classes' representatives, dealt to the tasks of their clusters."""
    carried = ["node", "cluster", "band", "blocks", "below", "above"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, off in _text.slices(batch.column(0)):
                value, first = shingle_sets(data, off, policy.words)
                part = batch.slice(i, j - i)
                raw, at = value.tobytes(), (8 * first).tolist()
                sets = pa.array([raw[at[k] : at[k + 1]] for k in range(j - i)], pa.binary())
                same = pa.array(set_ids(value, first) == np.array(part.column(1)))  # another text may have the same id
                yield pa.RecordBatch.from_arrays([*part.columns[1:], sets], [*carried, "shingles"]).filter(same)

    columns = ["_text", *carried]
    of_ids = source.join(member.where(F.col(id_col).isNotNull()).hint("shuffle_hash"), [id_col, "_digest"]).select(*columns)
    # without ids equal texts can't be told apart, and one of them will do
    texts = source.where(F.col(id_col).isNull()).groupBy("_digest").agg(F.first("_text").alias("_text"))
    others = texts.join(member.where(F.col(id_col).isNull()).hint("shuffle_hash"), "_digest").select(*columns)
    sets = of_ids.union(others).mapInArrow(run, "node long, cluster long, band int, blocks int, below int, above int, shingles binary")
    each = "transform(filter(sequence(0, {n}), x -> x < {n}), x -> struct({a} as s, {i} as i, {b} as t, {j} as j))"
    tasks = (
        each.format(n="blocks", a="band", i="least(x, own)", b="band", j="greatest(x, own)"),
        each.format(n="below", a="band - 1", i="x", b="band", j="own"),
        each.format(n="above", a="band", i="own", b="band + 1", j="x"),
    )
    task = F.expr(f"if(blocks = 0, array(struct(0 as s, 0 as i, 0 as t, 0 as j)), concat({', '.join(tasks)}))")
    own = F.coalesce(F.pmod(F.xxhash64("node"), F.when(F.col("blocks") > 0, F.col("blocks"))), F.lit(0)).cast("int")
    return sets.withColumn("own", own).select("node", "cluster", F.explode(task).alias("task"), "shingles")


def _linked(sets: DataFrame, policy: NearDupPolicy) -> DataFrame:
    percent = policy.percent

    def run(group: pa.Table) -> pa.Table:
        group = group.select(["node", "shingles"]).combine_chunks()
        node = group.column("node").to_numpy()
        node, at = np.unique(node, return_index=True)
        held = [x.as_py() for x in group.column("shingles").take(pa.array(at))]
        first = np.concatenate([[0], np.cumsum([len(x) // 8 for x in held])])
        root = link_sets(node, np.frombuffer(b"".join(held), np.uint64), first, percent)
        moved = root != node
        return pa.table({"node": node[moved], "root": root[moved]})

    return sets.groupBy("cluster", "task").applyInArrow(run, "node long, root long")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", policy: NearDupPolicy = NearDupPolicy()) -> DataFrame:
    """The rows, with all their columns, of one id of each group: every row of an id that is kept. See keep_one_row()."""
    kept = near_duplicates(docs, id_col, text_col, policy).where("kept").select(F.col(id_col).alias("_kept_id")).distinct()
    return docs.join(kept, docs[id_col].eqNullSafe(kept["_kept_id"]), "left_semi")


def keep_one_row(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", policy: NearDupPolicy = NearDupPolicy()) -> DataFrame:
    """One row of each group, with all its columns: the smallest id, text digest and, of rows equal in both, the smallest JSON.

    Texts without words are linked with nothing; of those only rows equal in id and text are one.
    """
    rows, named = _components(docs, id_col, text_col, policy)
    key = ["__near_id", "__near_digest"]
    least = named.select(F.col("first.id"), F.col("first.digest")).distinct().toDF(*key)
    empty = rows.where("node is null").select(id_col, "_digest").distinct().toDF(*key)
    twice = rows.select(id_col, "_digest").toDF(*key).groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key)
    chosen = checkpointed(least.union(empty))

    def joined(kind: str) -> DataFrame:
        """The chosen keys that stand in one row (left_anti) or in more (left_semi), and their rows."""
        same = [chosen[key[0]].eqNullSafe(twice[key[0]]), chosen[key[1]] == twice[key[1]]]
        keys = chosen.join(twice, same, kind)
        named = docs.withColumn("__near_row", F.xxhash64(docs[text_col]))
        return named.join(keys, [named[id_col].eqNullSafe(keys[key[0]]), named["__near_row"] == keys[key[1]]])

    whole = F.struct(*[docs[c] for c in docs.columns])
    one = joined("left_semi").groupBy(*key).agg(F.min_by(whole, F.to_json(whole)).alias("__near_whole"))
    return joined("left_anti").select(*docs.columns).union(one.select("__near_whole.*"))
