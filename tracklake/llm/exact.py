"""Exact dedup by a tree-merge of sorted digest runs.

Every partition of the input makes one run: its distinct texts as records of a 64-bit digest, with the smallest
identifier and the number of rows. Runs are numbered by ``rounds`` digits in base ``fan_in``. In round j the runs that
differ in digit j alone form a team and exchange records: each record goes to the member whose digit j is that of the
record's own place, the leading bits of its digest. After the last round every record is in the run of its place, and the
runs in order are the sorted digests of the table. In each round a run takes in sorted runs of its team's members
and merges them: records of one text become one, with the smallest identifier and the sum of the counts. A
record counts as the same text only if digest, SHA-256 and length in bytes all agree; so an identifier that is kept has
been verified at every level, and texts whose digests collide stay apart. A text that a third of all rows hold is one record a
run after the first step and meets at most ``fan_in`` of its own kind in a merge, so no round has a hot group.

The result goes back the same way: each level's records take the group of the record that they were merged into, at most
``fan_in`` for one, down to the rows. Every level is a checkpoint of digests and identifiers, not of texts; the text
is read once. The way is built-in functions alone: a shuffle by run, a sort, a sort-based aggregate, equi-joins.

Defined results: a null text counts as empty, and blank runs count as one space; identifiers may be of any type that has an
order; a null identifier comes after all others; of rows with one text and one identifier a single one stays; an empty table
gives no rows; very long texts are hashed whole; other columns of the input, whatever their names, aren't looked at.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklake.llm._session import checkpointed, shuffle_partitions

BLANKS = r"[\x20\x09-\x0D]+"
#: What makes two records one text; ``digest`` sorts, the others verify.
SAME = ("digest", "sha", "n_bytes")


@dataclass(frozen=True)
class MergePolicy:
    #: Bits of a digit: so many runs, as a power of two, are merged at once.
    fan_in_bits: int = 3


def normalised(text: Column) -> Column:
    """The text, null as empty, with one space for each run of blanks."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")


def digests(docs: DataFrame, rounds: int, policy: MergePolicy = MergePolicy(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(who, run, digest, sha, n_bytes): a row for each input row. ``who``: the identifier, in an order in which nulls are last, and a row number."""
    text = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("t"))
    who = F.struct(F.col("id").isNull().alias("last"), F.col("id"), F.monotonically_increasing_id().alias("row"))
    run = F.spark_partition_id().bitwiseAND(F.lit((1 << rounds * policy.fan_in_bits) - 1))
    return text.select(who.alias("who"), run.alias("run"), F.xxhash64("t").alias("digest"), F.unhex(F.sha2(F.col("t").cast("binary"), 256)).alias("sha"), F.octet_length("t").alias("n_bytes"))


def handed_to(j: int, rounds: int, policy: MergePolicy) -> Column:
    """The run that takes in a record in round j."""
    bits = policy.fan_in_bits
    place = F.shiftrightunsigned("digest", 64 - rounds * bits).cast("int")
    digit = ((1 << bits) - 1) << j * bits
    return F.col("run").bitwiseAND(F.lit(~digit)).bitwiseOR(place.bitwiseAND(F.lit(digit)))


def merged(records: DataFrame) -> DataFrame:
    """One record for each run and text: smallest ``who``, number of rows."""
    return records.groupBy("run", *SAME).agg(F.min("who").alias("who"), F.sum("n").alias("n"))


def exact_duplicates(docs: DataFrame, policy: MergePolicy = MergePolicy(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id (as ``id_col`` is named), keep_id, group_size, kept, text_sha256: one row for each input row."""
    width = shuffle_partitions(docs.sparkSession)
    rounds = max(1, math.ceil(math.log2(max(2, width)) / policy.fan_in_bits))
    rows = checkpointed(digests(docs, rounds, policy, id_col, text_col))
    # the aggregate before the shuffle makes each partition's own run
    levels = [checkpointed(merged(rows.withColumn("n", F.lit(1).cast("long"))))]
    for j in range(rounds):
        taken = levels[-1].withColumn("run", handed_to(j, rounds, policy)).repartition(width, "run")
        levels.append(checkpointed(merged(taken)))
    groups = levels[-1].select("run", *SAME, F.col("who").alias("keep"), F.col("n").alias("group_size"))
    for j in reversed(range(rounds)):
        below = levels[j].select(F.col("run").alias("below"), *SAME, handed_to(j, rounds, policy).alias("run"))
        groups = below.join(groups, ["run", *SAME]).select(F.col("below").alias("run"), *SAME, "keep", "group_size")
    out = rows.join(groups, ["run", *SAME])
    return out.select(F.col("who.id").alias(id_col), F.col("keep.id").alias("keep_id"), "group_size", (F.col("who.row") == F.col("keep.row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
