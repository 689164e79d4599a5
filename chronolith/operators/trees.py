"""Directory trees: usage, roll-ups, Merkle identities, subtree removal."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import cache_class, depth_of, name_of, parent_of, with_ancestors
from ..sources.shared import shared_table


def usage(entries: DataFrame) -> DataFrame:
    """One row: counts by kind, bytes, and 512-byte blocks; the top directory counts."""
    is_ = lambda k: F.count_if(F.col("kind") == k)
    return entries.agg(
        is_("File").alias("files"), (is_("Directory") + 1).alias("directories"), is_("Symlink").alias("symlinks"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("logical_bytes"), F.coalesce(F.sum(F.ceil(F.col("size") / 512) * 512), F.lit(0)).cast("long").alias("physical_bytes"),
    )


def estimate(entries: DataFrame, rules: DataFrame) -> DataFrame:
    """One row: usage of the entries that ``rules(path)`` let a capture take, other kinds, the topmost subtrees that it leaves out, and the number of rules."""
    rules = rules.select("path").distinct()
    kept = without_subtrees(entries, rules)
    other = kept.agg(F.count_if(~F.col("kind").isin("File", "Directory", "Symlink")).alias("special_entries"))
    at_rules = entries.select("path").join(rules, "path", "left_semi").distinct()
    below = with_ancestors(at_rules).join(rules.select(F.col("path").alias("above")), "above", "left_semi").select("path").distinct()
    left_out = at_rules.join(below, "path", "left_anti").agg(F.count("*").alias("excluded_subtrees"))
    # each side is one row
    return usage(kept).crossJoin(other).crossJoin(left_out).crossJoin(rules.agg(F.count("*").alias("policy_rules")))


def rollup(files: DataFrame) -> DataFrame:
    """Totals of every directory over all that it holds: path, entries, bytes."""
    return with_ancestors(files).groupBy(F.col("above").alias("path")).agg(F.count("*").alias("entries"), F.sum("size").alias("bytes"))


def shrink_candidates(files: DataFrame) -> DataFrame:
    """Topmost directories that can be made again: path, cache_class, entries, bytes."""
    sums = rollup(files)
    manifests = files.where(name_of(F.col("path")) == "Cargo.toml").select(parent_of(F.col("path")).alias("home")).distinct().withColumn("manifest", F.lit(True))
    d = sums.withColumn("home", parent_of(F.col("path"))).join(manifests, "home", "left")
    d = d.select("path", cache_class(F.col("path"), F.coalesce("manifest", F.lit(False))).alias("cache_class"), "entries", "bytes").where("cache_class IS NOT NULL")
    nested = with_ancestors(d.select("path")).join(d.select(F.col("path").alias("above")), "above", "left_semi").select("path").distinct()
    return d.join(nested, "path", "left_anti")


def merkle(files: DataFrame) -> DataFrame:
    """Identity of every directory from its children's names, kinds and identities: path, tree_id, children.  The top is the empty path.

    Two aggregations a level from the deepest: children are digested in pages, by the first three digits of their names'
    digests, and pages in their order, so that no task holds the children of a large directory.  The number of levels is
    read off the paths.  Files are written once in the order of their depth, so a level reads its own pages of them, and
    each level is written, so that the plan of a level does not hold those below it.
    """
    nodes = files.select("path", F.col("kind"), F.col("target").alias("id"), depth_of(F.col("path")).alias("depth"))
    nodes = shared_table(nodes.sortWithinPartitions("depth"), "nodes")
    levels = nodes.agg(F.max("depth")).first()[0] or 0
    found: list[DataFrame] = []
    at = nodes.where(F.col("depth") == levels)
    for d in range(levels, 0, -1):
        name = name_of(F.col("path"))
        line = F.concat_ws("\t", name, F.col("kind"), F.col("id"))
        pages = at.groupBy(parent_of(F.col("path")).alias("path"), F.substring(F.sha2(name, 256), 1, 3).alias("page"))
        pages = pages.agg(F.sha2(F.array_join(F.sort_array(F.collect_list(line)), "\n"), 256).alias("digest"), F.count("*").alias("n"))
        in_order = F.transform(F.sort_array(F.collect_list(F.struct("page", "digest"))), lambda p: p["digest"])  # at most 4,096
        g = shared_table(pages.groupBy("path").agg(F.sha2(F.array_join(in_order, ""), 256).alias("id"), F.sum("n").alias("children")), "level")
        found.append(g)
        at = g.select("path", F.lit("Directory").alias("kind"), "id").unionByName(nodes.where(F.col("depth") == d - 1).select("path", "kind", "id"))
    return reduce(DataFrame.unionByName, found).select("path", F.col("id").alias("tree_id"), "children") if found else nodes.select("path", F.col("id").alias("tree_id"), F.lit(0).cast("long").alias("children")).limit(0)


def without_subtrees(entries: DataFrame, roots: DataFrame) -> DataFrame:
    """Entries that are neither in ``roots(path)`` nor below them."""
    gone = with_ancestors(entries.select("path"), inclusive=True).join(roots.select(F.col("path").alias("above")).distinct(), "above", "left_semi").select("path").distinct()
    return entries.join(gone, "path", "left_anti")


def only_subtrees(entries: DataFrame, roots: DataFrame) -> DataFrame:
    """Entries in ``roots(path)`` or below them; no roots select everything."""
    roots = roots.select(F.col("path").alias("above")).distinct()
    kept = with_ancestors(entries.select("path"), inclusive=True).join(roots, "above", "left_semi").select("path").distinct()
    return entries if roots.isEmpty() else entries.join(kept, "path", "left_semi")
