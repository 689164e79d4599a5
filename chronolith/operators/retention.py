"""Thinning of timelines by age, pins, ranges, chain checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.values import DAY, HOUR, WEEK, bucket

BLOCK_BITS = 18  # a block spans 2^18 consecutive sequences


def tiers(log: DataFrame, now: int) -> DataFrame:
    """Adds tier (all, hour, day, week) and bucket by the age of sealed_at; ages at a bound and below zero belong to the finer side."""
    age = F.lit(now) - F.col("sealed_at")
    tier = F.when(age <= DAY, "all").when(age <= 7 * DAY, "hour").when(age <= 90 * DAY, "day").otherwise("week")
    s = F.col("sealed_at")
    b = F.when(F.col("tier") == "hour", bucket(s, HOUR)).when(F.col("tier") == "day", bucket(s, DAY)).when(F.col("tier") == "week", bucket(s, WEEK))
    return log.withColumn("tier", tier).withColumn("bucket", b)


def retained(log: DataFrame, pins: DataFrame, now: int) -> DataFrame:
    """Rows of ``log(workspace, sequence, sealed_at, ...)`` that stay, with tier: all of the last day, pins, the head, and the newest of each bucket.

    The newest of a bucket is an aggregate, combined before its shuffle, not a sort.  Pinned rows take no part in buckets.
    """
    t = tiers(log, now).join(pins.select("workspace", "sequence", F.lit(True).alias("pinned")), ["workspace", "sequence"], "left")
    newest = F.struct("sealed_at", "sequence")
    best = t.where("pinned IS NULL AND tier <> 'all'").groupBy("workspace", "tier", "bucket").agg(F.max(newest).alias("n")).select("workspace", F.col("n.sequence").alias("sequence"))
    head = log.groupBy("workspace").agg(F.max("sequence").alias("sequence"))
    chosen = best.unionByName(head).distinct().withColumn("chosen", F.lit(True))
    return t.join(chosen, ["workspace", "sequence"], "left").where("tier = 'all' OR pinned OR chosen").drop("pinned", "chosen", "bucket")


def _block(order: str) -> Column:
    return F.shiftright(F.col(order).cast("long"), BLOCK_BITS)


def with_previous(log: DataFrame, keys: list[str], order: str, named: dict[str, str]) -> DataFrame:
    """Adds, by the new name in ``named``, columns of the row before in its key's order; null in a key's first row.

    A key's rows are dealt to blocks of consecutive orders, so that one that holds most of the log is many tasks'
    work; only a block's last row, one row a block, meets the other blocks of its key.
    """
    taken = F.struct(*(F.col(c).alias(n) for n, c in named.items()))
    blocks = [*keys, "_block"]
    rows = log.withColumn("_block", _block(order))
    ends = rows.groupBy(*blocks).agg(F.max_by(taken, order).alias("_end"))
    ends = ends.select(*blocks, F.lag("_end").over(W.partitionBy(*keys).orderBy("_block")).alias("_end"))
    inside = F.lag(taken).over(W.partitionBy(*blocks).orderBy(order))
    rows = rows.withColumn("_before", inside).join(ends, blocks, "left")
    before = F.coalesce("_before", "_end")
    return rows.select(*log.columns, *(before[n].alias(n) for n in named))


def running_sum(log: DataFrame, keys: list[str], order: str, value: str, name: str) -> DataFrame:
    """Adds the sum of ``value`` up to each row in its key's order: over blocks as ``with_previous``, and inside each."""
    blocks = [*keys, "_block"]
    rows = log.withColumn("_block", _block(order))
    upto = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    sums = rows.groupBy(*blocks).agg(F.sum(value).alias("_sum")).select(*blocks, F.sum("_sum").over(upto).alias("_earlier"))
    inside = F.sum(value).over(W.partitionBy(*blocks).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("_inside", inside).join(sums, blocks, "left")
    return rows.select(*log.columns, (F.col("_inside") + F.coalesce("_earlier", F.lit(0))).alias(name))


def ranges(rows: DataFrame) -> DataFrame:
    """Runs of consecutive sequences: workspace, first, last, n.

    Runs are made inside blocks; only those that reach an end of their block, two a block at most, are joined across blocks.
    """
    r = rows.select("workspace", "sequence", _block("sequence").alias("block"))
    island = F.col("sequence") - F.row_number().over(W.partitionBy("workspace", "block").orderBy("sequence"))
    parts = r.withColumn("island", island).groupBy("workspace", "block", "island").agg(F.min("sequence").alias("first"), F.max("sequence").alias("last"), F.count("*").alias("n"))
    # a run at an end of its block: the sequence on the other side belongs to the next block
    edge = (F.shiftright(F.col("first") - 1, BLOCK_BITS) != F.col("block")) | (F.shiftright(F.col("last") + 1, BLOCK_BITS) != F.col("block"))
    parts = parts.withColumn("edge", edge)
    by_first = W.partitionBy("workspace").orderBy("first")
    at_edges = parts.where("edge").withColumn("new", (~F.lag("last").over(by_first).eqNullSafe(F.col("first") - 1)).cast("int"))
    at_edges = at_edges.withColumn("run", F.sum("new").over(by_first.rowsBetween(W.unboundedPreceding, 0)))
    joined = at_edges.groupBy("workspace", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"))
    return parts.where("NOT edge").select("workspace", "first", "last", "n").unionByName(joined.drop("run"))


def chain_breaks(log: DataFrame) -> DataFrame:
    """Rows of ``log(workspace, sequence, previous, hash)`` that don't follow their predecessor: a sequence that doesn't grow, or a hash that isn't named."""
    prev = with_previous(log, ["workspace"], "position", {"before": "sequence", "named": "hash"})
    return prev.where("before IS NOT NULL AND (sequence <= before OR NOT (previous <=> named))").select("workspace", "sequence")


def without_repeats(log: DataFrame) -> DataFrame:
    """Rows whose snapshot differs from the one before."""
    return with_previous(log, ["workspace"], "sequence", {"before": "snapshot_id"}).where("NOT (snapshot_id <=> before)").drop("before")
