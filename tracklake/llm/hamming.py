"""Exact top-k search over binary codes by incremental multi-index hashing.

A vector's signs are its 64-bit code. Codes are cut into segments; the index of a segment is the table of codes by
segment value, a join key. A query looks up its own segment values and all that differ in few bits, then in one bit
more, and so on. After all segments have been searched up to radius r, every code not met differs in more than r bits
in each segment, so it is at least ``segments * (r + 1)`` bits away; a query is finished once its k-th verified distance
is below that. The radius grows until every query is finished, at a segment's full width at the latest, which covers
every code. So the result is exact whatever the data, and always by this way.

Each round is one equi-join of probes with codes on (segment, value). A code that several segments meet counts in the
first of them only, and one that an earlier radius has met doesn't count again, so nothing needs to be made distinct.
Of what a query meets, the k nearest go on, cut before the shuffle as well; finished queries ask no more. Of equal codes
only the k + 1 smallest ids are looked up (no other can be among the k nearest), so copies form no hot segment value;
one that many different codes share is split by Spark's skew join. Rounds are checkpointed.

Defined results: neighbours are ordered by distance, then by id; a query is no neighbour of itself; a vector that is
null, too short, or holds a null has no code: it is neither found nor has it neighbours; longer vectors are folded, each
place holds the sum of every 64th element; of rows with one id the smallest code stands; fewer than k other rows give as
many neighbours; an empty table gives no rows; ids may be of any type that has an order; other columns of the input,
whatever their names, aren't looked at.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklake.llm._session import checkpointed

BITS = 64


@dataclass(frozen=True)
class SearchPolicy:
    k: int = 10
    segments: int = 4
    #: The first round's radius; each later round adds one bit.
    first_radius: int = 2


def sign_code(vector: Column) -> Column:
    """The signs of 64 places, place i at bit i; null unless all elements are there."""
    folded = F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda j: F.aggregate(F.filter(vector, lambda _, i: i % BITS == j), F.lit(0.0), lambda a, x: a + x))
    places = F.when(F.size(vector) == BITS, vector.cast("array<double>")).when(F.size(vector) > BITS, folded)
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    bit = F.transform(places, lambda x, i: F.when(x.isNull(), None).when(x > 0, F.call_function("shiftleft", one, i)).otherwise(zero))
    return F.aggregate(bit, zero, lambda a, b: a.bitwiseXOR(b))


def codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, code), one row for each id that has a code."""
    found = vectors.select(F.col(id_col).alias("id"), sign_code(F.col(vector_col)).alias("code"))
    return found.where("id is not null and code is not null").groupBy("id").agg(F.min("code").alias("code"))


def segment(code: Column, s: int, policy: SearchPolicy) -> Column:
    width = BITS // policy.segments
    return F.shiftrightunsigned(code, s * width).bitwiseAND(F.lit((1 << width) - 1))


def _by_segment(rows: DataFrame, code: str, policy: SearchPolicy) -> DataFrame:
    """The rows once for each segment, with its number ``s`` and ``value``."""
    parts = F.array(*[F.struct(F.lit(s).alias("s"), segment(F.col(code), s, policy).alias("value")) for s in range(policy.segments)])
    return rows.select("*", F.inline(parts))


def masks(low: int, high: int, width: int) -> str:
    """SQL of an array of all numbers of ``width`` bits with low to high ones among them."""
    return f"array({', '.join(f'{x}L' for x in range(1 << width) if low <= x.bit_count() <= high)})"


def met_first(low: int, high: int, policy: SearchPolicy) -> Column:
    """Whether segment ``s`` is the first that differs in low to high bits, and none differs in fewer than low."""
    differs = [F.bit_count(segment(F.col("code").bitwiseXOR(F.col("query")), s, policy)) for s in range(policy.segments)]
    cases = [reduce(lambda a, b: a & b, [F.col("s") == s, *(d > high for d in differs[:s]), *(d >= low for d in differs[s + 1 :])]) for s in range(policy.segments)]
    return reduce(lambda a, b: a | b, cases)


def top_k(base: DataFrame, queries: DataFrame, policy: SearchPolicy = SearchPolicy()) -> DataFrame:
    """query_id, rank, id, distance: the k nearest rows of ``base`` to each of ``queries`` (both as from codes())."""
    width = BITS // policy.segments
    by_code = Window.partitionBy("code").orderBy("id")
    few = checkpointed(base.withColumn("_n", F.row_number().over(by_code)).where(F.col("_n") <= policy.k + 1).drop("_n"))
    index = _by_segment(few, "code", policy)
    open_ = checkpointed(queries.select(F.col("id").alias("query_id"), F.col("code").alias("query")))
    nearest = Window.partitionBy("query_id").orderBy("distance", "id")
    found, finished = None, []
    low, high = 0, policy.first_radius
    while True:
        # every mask changes each segment value to another one
        probes = _by_segment(open_, "query", policy).withColumn("mask", F.explode(F.expr(masks(low, high, width))))
        probes = probes.withColumn("value", F.col("value").bitwiseXOR(F.col("mask")))
        met = probes.join(index, ["s", "value"]).where(met_first(low, high, policy)).where("id <> query_id")
        met = met.select("query_id", "id", F.bit_count(F.col("code").bitwiseXOR(F.col("query"))).cast("int").alias("distance"))
        best = (met if found is None else found.unionByName(met)).withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= policy.k)
        best = checkpointed(best)
        sure = best.groupBy("query_id").agg(F.count("*").alias("n"), F.max("distance").alias("far")).where((F.col("n") == policy.k) & (F.col("far") < policy.segments * (high + 1))).select("query_id")
        left = open_.where("false") if high >= width else open_.join(sure, "query_id", "left_anti")
        open_ = checkpointed(left)
        finished.append(best.join(open_, "query_id", "left_anti"))
        if open_.isEmpty():
            return reduce(DataFrame.unionByName, finished).select("query_id", "rank", "id", "distance")
        found = best.join(open_, "query_id", "left_semi").drop("rank")
        low, high = high + 1, high + 1
