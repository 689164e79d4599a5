"""Scopes of forks: which paths a fork has changed against its base, kept up to date from what changed since its last head."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import radar_ignored
from ..functions.paths import with_ancestors
from ..sources.shared import shared_table
from .diff import paired

EXACT, SUBTREE = 0, 1
RELEVANT = ("source", "config-secret", "database", "lockfile")
#: Fields of an entry that count, beside its path: times don't, and of directories neither targets nor sizes.
DIRECTORY, SEMANTIC = ("kind", "mode", "class"), ("kind", "target", "mode", "size", "class")


def _is_dir(side: str) -> Column:
    return F.coalesce(F.col(f"{side}.kind") == "Directory", F.lit(False))


def _same(fields: tuple[str, ...]) -> Column:
    return F.struct(*(F.col(f"l.{f}") for f in fields)).eqNullSafe(F.struct(*(F.col(f"r.{f}") for f in fields)))


def visited(before: DataFrame, after: DataFrame) -> DataFrame:
    """``path`` of what a walk of two states meets: differences whose ancestors are directories on both sides.

    A directory that is new, gone or turned into something else is met itself; what is below it is not.
    """
    p = paired(before, after)
    every = [c for c in before.columns if c != "path"]
    present = F.col("l.kind").isNull() != F.col("r.kind").isNull()
    p = shared_table(p.where(present | ~_same(tuple(every))).select("path", (_is_dir("l") != _is_dir("r")).alias("broken")), "differences")
    broken = p.where("broken").select(F.col("path").alias("above"))
    below = with_ancestors(p.select("path")).join(broken, "above", "left_semi").select("path").distinct()
    return p.select("path").join(below, "path", "left_anti")


def recompute(base: DataFrame, head: DataFrame, paths: DataFrame) -> DataFrame:
    """Scopes of the given ``paths(path)``: path, scope (0: the path, 1: its subtree), action.

    States have path, kind, target, mode, size and class.  Directories on both sides make a scope if their own
    fields differ; a directory gone, or one side's only, stands for its subtree; an added
    directory is told by its relevant leaves, or by itself without any; other entries by add, modify, delete.
    Classes that are made again, and control paths, make no scope.
    """
    return _told(shared_table(paired(base, head, paths.select("path").where(~radar_ignored(F.col("path")))), "changed"), head)


def _told(p: DataFrame, head: DataFrame) -> DataFrame:
    """``recompute`` of paths with their entries in base and head: path, l, r."""
    left, right = F.col("l.kind").isNotNull(), F.col("r.kind").isNotNull()
    relevant = lambda side: F.coalesce(F.col(f"{side}.class").isin(*RELEVANT), F.lit(False))
    flip = left & right & (_is_dir("l") != _is_dir("r"))
    scope = (
        F.when(_is_dir("l") & _is_dir("r"), F.when(~_same(DIRECTORY) & relevant("r"), F.struct(F.lit(EXACT), F.lit("modify"))))
        .when(_is_dir("l") & ~right, F.when(relevant("l"), F.struct(F.lit(SUBTREE), F.lit("delete"))))
        .when(_is_dir("r") & ~left, F.lit(None))
        .when(flip, F.when(relevant("l") | relevant("r"), F.struct(F.lit(SUBTREE), F.lit("modify"))))
        .when(left & right, F.when(~_same(SEMANTIC) & (relevant("l") | relevant("r")), F.struct(F.lit(EXACT), F.lit("modify"))))
        .when(left, F.when(relevant("l"), F.struct(F.lit(EXACT), F.lit("delete"))))
        .when(right, F.when(relevant("r"), F.struct(F.lit(EXACT), F.lit("add"))))
    )
    own = p.select("path", scope.alias("s")).where("s IS NOT NULL").select("path", F.col("s.col1").alias("scope"), F.col("s.col2").alias("action"))
    added = p.where(_is_dir("r") & ~left).select(F.col("path").alias("above"), relevant("r").alias("relevant"))
    leaves = head.where((F.col("kind") != "Directory") & F.col("class").isin(*RELEVANT) & ~radar_ignored(F.col("path"))).select("path")
    told = shared_table(with_ancestors(leaves).join(added, "above").select("above", "path"), "leaves")
    bare = added.where("relevant").join(told, "above", "left_anti").select(F.col("above").alias("path"))
    new = told.select("path").unionByName(bare).select("path", F.lit(EXACT).alias("scope"), F.lit("add").alias("action"))
    return own.unionByName(new).distinct()


def observe(base: DataFrame, head: DataFrame, previous: DataFrame | None = None, stored: DataFrame | None = None) -> DataFrame:
    """Scopes of a head: path, scope, action.

    With the state of the previous head and the scopes ``stored`` for it, only paths
    that changed since are computed anew against the base; without, all that differ from the base.
    A path that is a directory in one of base and head alone takes its stored descendants with it;
    scopes below a directory that both lack, as it came and went between, stay until they are told anew.
    """
    paths = shared_table(visited(base if previous is None else previous, head), "visited")
    if previous is None or stored is None:
        return shared_table(recompute(base, head, paths), "scopes")
    both = shared_table(paths.join(paired(base, head, paths), "path", "left"), "changed")
    new = shared_table(_told(both.where(~radar_ignored(F.col("path"))), head), "scopes")
    at = both.select("path", (_is_dir("l") != _is_dir("r")).alias("structural"))
    kept = stored.join(at, "path", "left_anti")
    whole = at.where("structural").select(F.col("path").alias("above"))
    below = with_ancestors(kept.select("path")).join(whole, "above", "left_semi").select("path").distinct()
    kept = kept.join(below, "path", "left_anti").join(new, ["path", "scope"], "left_anti")
    return kept.select("path", "scope", "action").unionByName(new)
