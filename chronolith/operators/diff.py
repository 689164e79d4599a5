"""Differences of two tree states, and plans made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import components

#: Fields that make two entries the same, by purpose; ``target`` of two directories counts in the strict sense only.
STRICT = ("kind", "target", "mode", "size", "mtime")
MERGE = ("kind", "target", "mode", "size")


def entry(side: str, fields: tuple[str, ...], ignore_directory_target: bool) -> Column:
    """An entry's fields as one struct, null if the side has no entry; directories may hide their target."""
    at = [F.when(F.col(f"{side}.kind") != "Directory", F.col(f"{side}.target")).alias(f) if f == "target" and ignore_directory_target else F.col(f"{side}.{f}") for f in fields]
    return F.when(F.col(f"{side}.kind").isNotNull(), F.struct(*at))


def paired(left: DataFrame, right: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """Full outer join of two states by path: path, l, r; of ``paths(path)`` alone if they are given.

    Each state is cut down to the paths before the join, so that few paths are sent to the states and no state is shuffled.
    """
    if paths is not None:
        left, right = left.join(paths, "path", "left_semi"), right.join(paths, "path", "left_semi")
    l = left.select("path", F.struct(*[c for c in left.columns if c != "path"]).alias("l"))  # noqa: E741
    r = right.select("path", F.struct(*[c for c in right.columns if c != "path"]).alias("r"))
    return l.join(r, "path", "full_outer")


def diff(left: DataFrame, right: DataFrame, fields: tuple[str, ...] = STRICT) -> DataFrame:
    """Changes from left to right: path, action (add, delete, modify), old_kind, new_kind.

    Directories that differ in their target alone are left out.
    """
    p = paired(left, right)
    changed = ~entry("l", fields, False).eqNullSafe(entry("r", fields, False))
    both_dirs = (F.col("l.kind") == "Directory") & (F.col("r.kind") == "Directory")
    target_only = both_dirs & entry("l", fields, True).eqNullSafe(entry("r", fields, True))
    action = F.when(F.col("l.kind").isNull(), "add").when(F.col("r.kind").isNull(), "delete").otherwise("modify")
    return p.where(changed & ~F.coalesce(target_only, F.lit(False))).select("path", action.alias("action"), F.col("l.kind").alias("old_kind"), F.col("r.kind").alias("new_kind"))


def rewind_plan(current: DataFrame, target: DataFrame) -> DataFrame:
    """What brings the current state to the target: path, action (restore, remove, replace), phase and rank to apply in.

    Directories are made first from the top, then files in byte order, removals
    last from the longest path.
    """
    d = diff(current, target)
    action = F.when(F.col("action") == "add", "restore").when(F.col("action") == "delete", "remove").otherwise("replace")
    phase = F.when(F.col("action") == "delete", 2).when(F.col("new_kind") == "Directory", 0).otherwise(1)
    d = d.select("path", action.alias("todo"), phase.alias("phase"), F.length("path").alias("len"))
    return d.select("path", F.col("todo").alias("action"), "phase", F.when(F.col("phase") == 2, -F.col("len")).otherwise(F.size(components(F.col("path")))).alias("rank"))


def verify(plan: DataFrame, actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Paths of a plan whose actual entry is not the expected one."""
    paths = plan.select("path")
    p = paths.join(paired(expected, actual, paths), "path", "left")
    return p.where(~entry("l", STRICT, False).eqNullSafe(entry("r", STRICT, False))).select("path")


def same_state(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two states has, with the side: empty if the states are equal."""
    columns = sorted(set(a.columns) & set(b.columns))
    left, right = a.select(columns), b.select(columns)
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))
