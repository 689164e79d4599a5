"""Three-way merge: changes to take over, conflicts by kind, and suppression below conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import with_ancestors
from ..sources.shared import shared_table
from .diff import MERGE, entry

ENTRY = "struct<kind:string,target:string,mode:int,size:bigint>"


def _three(base: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """What differs between any two of the states, by path: kinds and which sides agree.  One shuffle, of the three sides together; written once."""
    entry_ = F.struct("kind", "target", "mode", "size")
    side = lambda df, n: df.select("path", *(entry_.alias(c) if c == n else F.lit(None).cast(ENTRY).alias(c) for c in "bot"))
    rows = side(base, "b").unionByName(side(ours, "o")).unionByName(side(theirs, "t"))
    j = rows.groupBy("path").agg(*(F.first(c, ignorenulls=True).alias(c) for c in "bot"))
    same = lambda x, y: entry(x, MERGE, True).eqNullSafe(entry(y, MERGE, True))
    j = j.select("path", *(F.col(f"{n}.kind").alias(f"{n}_kind") for n in "bot"), same("o", "t").alias("ot"), same("b", "o").alias("bo"), same("b", "t").alias("bt"))
    return shared_table(j.where("NOT (bo AND bt)"), "three-way")


def merge(base: DataFrame, ours: DataFrame, theirs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(changes: path, action; conflicts: path, kind).

    Entries are compared without times, directories without targets.  A
    directory that one side removed or turned into something else while the
    other changed anything below it is an ancestor conflict; all descendants are
    looked at.  Changes at and below conflicts are held back.  Prefix conditions
    are equi-joins on exploded ancestors.
    """
    j = _three(base, ours, theirs)
    live = j.where("NOT ot")
    changes = live.where("bo").select("path", F.when(F.col("t_kind").isNull(), "remove").otherwise("set").alias("action"))
    o, t, b = F.col("o_kind"), F.col("t_kind"), F.col("b_kind")
    kind = F.when(o.isNull() | t.isNull(), "delete_modify").when((o != t) | F.coalesce(b != o, F.lit(False)), "type").otherwise("modify_modify")
    direct = live.where("NOT bo AND NOT bt").select("path", kind.alias("kind"))
    is_dir = lambda c: F.coalesce(c == "Directory", F.lit(False))
    dirs = live.where(is_dir(b)).select("path", is_dir(o).alias("od"), is_dir(t).alias("td")).where("od <> td")
    below = with_ancestors(j.where("NOT bo OR NOT bt").select("path", "bo", "bt"))
    below = below.groupBy("above").agg(F.bool_or(~F.col("bo")).alias("ours_changed"), F.bool_or(~F.col("bt")).alias("theirs_changed"))
    hit = dirs.join(below, dirs["path"] == below["above"]).where("(td AND theirs_changed) OR (od AND ours_changed)")
    ancestor = hit.select("path", F.lit("ancestor").alias("kind")).join(direct, "path", "left_anti")
    conflicts = shared_table(direct.unionByName(ancestor), "conflicts")
    held = with_ancestors(changes, inclusive=True).join(conflicts.select(F.col("path").alias("above")), "above", "left_semi").select("path").distinct()
    return changes.join(held, "path", "left_anti"), conflicts
