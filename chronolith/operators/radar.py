"""Conflicts between forks: overlapping scopes, topmost paths, members, claims, and change events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import glob_column, literal_prefix, self_and_ancestors, with_ancestors
from ..functions.values import digest_id
from ..sources.shared import joined_side, shared_table


#: Forks of a label in one block: two blocks meet in one task, and a block of them stays in the join's memory (4,096 rows).
BLOCK = 3500
#: Pairs that a task makes, about, where there are more than tasks; and where there are few.
MOST_PAIRS, FEW_PAIRS = 32_000_000, 1_000_000
#: What a fork has for a label: an exact scope of that path, a subtree there, an exact scope there or below, a subtree below or above.
AT, TREE, LEAF, OTHER = 1, 2, 4, 8


def _has(flags: str, bit: int) -> Column:
    return F.col(flags).bitwiseAND(bit) != 0


def _extents(s: DataFrame) -> DataFrame:
    """A row for each path of scopes, with what decides who can meet whom there, over forks and never over pairs.

    first, final: least and greatest fork with an exact scope; low, high: with a subtree; exact, trees: their numbers;
    of subtrees also leaf: the least fork with an exact scope at or below; last: the greatest fork with any scope at, below, or with a
    subtree above; every: the number of scopes at or below. Ancestors are of paths, not of scopes.
    """
    exact, tree = F.when(F.col("scope") == 0, F.col("fork")), F.when(F.col("scope") == 1, F.col("fork"))
    at = s.groupBy("path").agg(
        F.min(exact).alias("first"), F.max(exact).alias("final"), F.min(tree).alias("low"), F.max(tree).alias("high"), F.max("fork").alias("top"),
        F.count(exact).alias("exact"), F.count(tree).alias("trees"), F.count("fork").alias("n"),
    )
    at = shared_table(at, "paths")
    trees = at.where("low IS NOT NULL")
    below = with_ancestors(at, inclusive=True).groupBy("above").agg(F.min("first").alias("leaf"), F.max("top").alias("last"), F.sum("n").alias("every"))
    below = below.join(trees.select(F.col("path").alias("above")), "above", "left_semi").withColumnRenamed("above", "path")
    over = with_ancestors(trees.select("path")).join(trees.select(F.col("path").alias("above"), F.col("high").alias("over"), F.col("trees").alias("more")), "above")
    over = over.groupBy("path").agg(F.max("over").alias("over"), F.sum("more").alias("more"))
    e = at.join(below, "path", "left").join(over, "path", "left").withColumn("last", F.greatest("last", "over")).withColumn("every", F.col("every") + F.coalesce("more", F.lit(0)))
    return shared_table(e.drop("top", "n", "over", "more"), "extents")


def _met(s: DataFrame, extents: DataFrame, labels: DataFrame) -> DataFrame:
    """What forks have for each of the labels, which are rows of ``extents``: path (the label), fork, flags, and the label's other columns.

    A path is led to its labels once, and its scopes, which stay where they are while such paths are few, follow by equality of paths.
    """
    label = labels.select(F.col("path").alias("label"), *(c for c in labels.columns if c != "path"))
    down = with_ancestors(extents.select("path"), alias="label", inclusive=True).join(label, "label").withColumn("place", F.when(F.col("path") == F.col("label"), 0).otherwise(1))
    down = down.where("place = 0 OR low IS NOT NULL")
    up = with_ancestors(label.where("low IS NOT NULL").withColumn("at", F.col("label")), "at", "path").drop("at")
    up = up.join(extents.where("low IS NOT NULL").select("path"), "path", "left_semi").withColumn("place", F.lit(2))
    met = s.join(joined_side(down.unionByName(up), "led"), "path").where("place < 2 OR scope = 1")
    flags = F.when(F.col("scope") == 1, F.when(F.col("place") == 0, TREE | OTHER).otherwise(OTHER)).otherwise(F.when(F.col("place") == 0, AT | LEAF).otherwise(LEAF))
    return met.withColumn("flags", flags).drop("path", "scope", "place").withColumnRenamed("label", "path")


def pairs(scopes: DataFrame) -> DataFrame:
    """``scopes(fork, path, scope)`` to labelled pairs of forks: path, left_id < right_id.

    Two exact scopes meet on equal paths, a subtree meets what is at or below it;
    the label is the subtree's path, of two subtrees that of the smaller fork.
    Each fork comes to a label once, with all it has there, so each pair is made once and no pair is shuffled:
    exact scopes meet one another, and subtrees meet all, in blocks of forks of a label.
    """
    s = shared_table(scopes.where("fork IS NOT NULL").select("fork", "path", "scope"), "scopes")
    e = _extents(s)
    labels = e.where("exact > 1 OR trees > 0")
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    labels = labels.select("path", "low", F.greatest(blocks("exact"), F.lit(1)).alias("exact"), F.when(F.col("trees") > 0, blocks("every")).alias("every"))
    made = e.agg(F.coalesce(F.sum(F.col("exact").cast("double") * F.col("exact") / 2 + F.coalesce(F.col("trees").cast("double") * F.col("every"), F.lit(0.0))), F.lit(0.0)).alias("n")).first().n
    tasks = max(min(int(s.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(made / FEW_PAIRS) + 1), int(made / MOST_PAIRS) + 1)
    key = ["path", "wide", "block"]
    own = F.when(_has("flags", AT | TREE), F.struct(F.lit(False).alias("wide"), F.col("exact").alias("blocks")))
    wide = F.when(F.col("every").isNotNull(), F.struct(F.lit(True).alias("wide"), F.col("every").alias("blocks")))
    m = _met(s, e, labels).select("path", "fork", "flags", F.inline(F.array_compact(F.array(own, wide))))
    m = m.withColumn("block", F.pmod(F.xxhash64("fork"), F.col("blocks")).cast("int")).repartition(tasks, *key)
    m = m.groupBy(*key, "blocks", "fork").agg(F.bit_or("flags").alias("flags")).where("wide OR (flags & 3) = 1")
    left = m.where("NOT wide OR (flags & 2) <> 0").withColumnRenamed("block", "from")
    left = left.withColumn("block", F.explode(F.sequence(F.when(F.col("wide"), 0).otherwise(F.col("from")), F.col("blocks") - 1)))
    left = left.select(*key, "from", F.col("fork").alias("a")).repartition(tasks, *key)
    right = m.select(*key, F.col("fork").alias("b"), (_has("flags", LEAF) & ~_has("flags", TREE)).alias("leaf"))
    j = left.join(right.hint("merge"), key).where("a < b OR (a > b AND CASE WHEN wide THEN leaf ELSE `from` < block END)")
    return j.select("path", F.least("a", "b").alias("left_id"), F.greatest("a", "b").alias("right_id"))


def members(scopes: DataFrame) -> DataFrame:
    """Topmost conflict paths and the forks of their pairs: path, fork.

    Whether a fork has a pair at a path is told by the least and greatest forks there, so pairs are not made:
    a path or a subtree that all forks change stays linear.
    """
    s = shared_table(scopes.select("fork", "path", "scope"), "scopes")
    return shared_table(_members(s, *_topmost(s)), "members")


def _topmost(s: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Extents of scopes that are written, and those of the topmost conflict paths."""
    e = _extents(s)
    hit = e.where("first < final OR low < last OR leaf < high")
    nested = with_ancestors(hit.select("path")).join(hit.select(F.col("path").alias("above")), "above", "left_semi").select("path").distinct()
    return e, shared_table(hit.join(nested, "path", "left_anti"), "topmost")


def _members(s: DataFrame, e: DataFrame, top: DataFrame, *more: str) -> DataFrame:
    """``members`` of scopes that are written, with their extents; ``more`` columns of the scopes stay with a member."""
    m = _met(s.select("fork", "path", "scope", *more), e, top)
    fork = F.col("fork")
    same = _has("flags", AT) & (F.col("first") < F.col("final"))
    tree = _has("flags", TREE) & (F.coalesce(fork < F.col("last"), F.lit(False)) | F.coalesce(F.col("leaf") < fork, F.lit(False)))
    met = (F.col("low") < fork) | (_has("flags", LEAF) & (fork < F.col("high")))
    paired = F.coalesce(same, F.lit(False)) | tree | F.coalesce(met, F.lit(False))
    return m.where(paired).select("path", "fork", *more).distinct()


def claim_states(paths: DataFrame, claims: DataFrame) -> DataFrame:
    """``paths(path)`` and ``claims(pattern, workspace)`` to path, claim_state by the number of workspaces that claim it.

    A pattern meets the paths below its literal leading components, by an equi-join on exploded ancestors
    (a pattern without any meets all paths); what meets is matched by its regular expression.
    """
    paths = paths.select("path").distinct()
    c = claims.select("pattern", "workspace").distinct()
    lead = literal_prefix(F.col("pattern"))
    c = c.select("workspace", F.array_join(lead, "/").alias("above"), glob_column(F.col("pattern")).alias("re"))
    under = paths.select("path", F.explode(F.concat(F.array(F.lit("")), self_and_ancestors(F.col("path")))).alias("above"))
    hit = under.join(c, "above").where(F.expr("path RLIKE re"))
    n = hit.groupBy("path").agg(F.countDistinct("workspace").alias("n"))
    state = F.when(F.col("n").isNull(), "unclaimed").when(F.col("n") == 1, "covered").otherwise("contested")
    return paths.join(n, "path", "left").select("path", state.alias("claim_state"))


def conflicts(scopes: DataFrame, claims: DataFrame, state: str | None = None) -> DataFrame:
    """Active conflicts: path, signature over members and their heads, claim_state, forks.

    With ``state``, a column of scopes whose values have no slash, the conflicts within each of its values, and that column:
    all are told in the same steps, for which paths have it as their first component.
    A head comes along with its scopes, so members meet no table of heads, unless a fork has several.
    """
    of = [state] if state else []
    first, rest = F.substring_index("path", "/", 1), F.expr("substring(path, instr(path, '/') + 1)")
    path = F.concat(F.col(state).cast("string"), F.lit("/"), F.col("path")) if state else F.col("path")
    s = shared_table(scopes.select("fork", "head", path.alias("path"), "scope", *of), "scopes")
    e, top = _topmost(s)
    m = _members(s, e, top, "head").where("fork IS NOT NULL")
    heads = s.groupBy(*of, "fork").agg(F.min("head").alias("a"), F.max("head").alias("b"), F.count("head").alias("n"), F.count("*").alias("all"))
    if not heads.where("a <> b OR (n > 0 AND n < all)").isEmpty():
        m = m.withColumns({c: first.cast(s.schema[c].dataType) for c in of}).drop("head").distinct()
        m = m.join(s.select(*of, "fork", "head").distinct(), [*of, "fork"])
    c = m.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("fork", "head"))).alias("m"))
    c = c.select("path", F.array_join(F.transform("m", lambda x: F.concat_ws("@", x["fork"].cast("string"), x["head"].cast("string"))), ",").alias("signature"), F.size("m").cast("long").alias("forks"))
    if state:
        c, top = (t.withColumns({state: first.cast(s.schema[state].dataType), "path": rest}) for t in (c, top))
    claimed = joined_side(claim_states(top, claims), "claimed")
    return shared_table(c.join(claimed, "path").select(*of, "path", "signature", "claim_state", "forks"), "conflicts")


def events(old: DataFrame, new: DataFrame, family: str, known: DataFrame | None = None) -> DataFrame:
    """Changes between two sets of conflicts: event_id, conflict_id, path, state, signature, claim_state.

    Opened, updated (signature or claims differ) or resolved; an event that the
    log ``known(event_id)`` has is not told again.
    """
    o = old.select("path", F.col("signature").alias("os"), F.col("claim_state").alias("oc"))
    n = new.select("path", F.col("signature").alias("ns"), F.col("claim_state").alias("nc"))
    j = o.join(n, "path", "full_outer").where("NOT (os <=> ns) OR NOT (oc <=> nc)")
    state = F.when(F.col("os").isNull(), "opened").when(F.col("ns").isNull(), "resolved").otherwise("updated")
    e = j.select("path", state.alias("state"), F.coalesce("ns", "os").alias("signature"), F.when(F.col("ns").isNull(), F.col("oc")).otherwise(F.col("nc")).alias("claim_state"))
    e = e.withColumn("conflict_id", digest_id("conflict", F.lit(family), F.col("path")))
    e = e.withColumn("event_id", digest_id("event", F.col("conflict_id"), F.col("state"), F.col("signature"), F.col("claim_state")))
    return e if known is None else e.join(known.select("event_id"), "event_id", "left_anti")
