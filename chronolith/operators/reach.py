"""Reachability over object graphs: closure, class masks of marks, merge bases, bisection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import shared_table
from .retention import BLOCK_BITS

COMPACT = 8  # rounds after which what was seen becomes one table


def reach(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that ``roots(node)`` lead to along ``edges(src, dst)``, with the least number of steps: node, depth.

    A round joins the frontier only, and drops what was seen; rounds stop with an empty frontier, however deep the graph.
    """
    seen = shared_table(roots.select("node").distinct().withColumn("depth", F.lit(0)), "reach")
    frontier, k = seen, 0
    while True:
        k += 1
        step = frontier.select(F.col("node").alias("src")).join(edges.select("src", "dst"), "src").select(F.col("dst").alias("node")).distinct()
        frontier = shared_table(step.join(seen, "node", "left_anti").withColumn("depth", F.lit(k)), "reach")
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
        if k % COMPACT == 0:
            seen = shared_table(seen, "reach")


def marks(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """Bit masks from ``roots(node, mask)`` along ``edges(src, dst, class_bit)``: node, mask.

    A mask goes along an edge only if it holds the edge's class; masks that meet
    are united.  Only nodes whose mask grew go on, and a round writes these alone: what a node
    has is the union of its rows.  Rounds stop when no mask grew.
    """
    grown = shared_table(roots.groupBy("node").agg(F.bit_or("mask").alias("mask")), "marks")
    state, k = grown, 0
    while True:
        k += 1
        sent = grown.join(edges, grown["node"] == edges["src"]).where("mask & class_bit <> 0").groupBy(F.col("dst").alias("node")).agg(F.bit_or("mask").alias("got"))
        held = state.join(sent.select("node"), "node", "left_semi").groupBy("node").agg(F.bit_or("mask").alias("mask"))
        new = F.coalesce("mask", F.lit(0)).bitwiseOR(F.col("got"))
        grown = sent.join(held, "node", "left").where(~F.col("mask").eqNullSafe(new)).select("node", new.alias("mask"))
        grown = shared_table(grown, "marks")
        if grown.isEmpty():
            return state.groupBy("node").agg(F.bit_or("mask").alias("mask"))
        state = state.unionByName(grown)
        if k % COMPACT == 0:
            state = shared_table(state.groupBy("node").agg(F.bit_or("mask").alias("mask")), "marks")


def merge_base(parents: DataFrame, lineage: DataFrame, theirs: DataFrame) -> DataFrame:
    """The commit of ``lineage(node)`` that every way from ``theirs(node)`` meets first: one row, verdict (found, none, ambiguous) and node.

    A way ends at its first commit of the lineage, and no commit is visited twice, so cycles end too.
    """
    lineage = shared_table(lineage.select("node").distinct(), "lineage")
    frontier = shared_table(theirs.select("node").distinct(), "frontier")
    seen = frontier
    hits: list[DataFrame] = []
    k = 0
    while not frontier.isEmpty():
        k += 1
        hits.append(frontier.join(lineage, "node", "left_semi"))
        on = frontier.join(lineage, "node", "left_anti").join(parents, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        frontier = shared_table(on.join(seen, "node", "left_anti"), "frontier")
        seen = seen.unionByName(frontier)
        if k % COMPACT == 0:
            seen, hits = shared_table(seen, "seen"), [shared_table(reduce(DataFrame.unionByName, hits), "hits")]
    found = reduce(DataFrame.unionByName, hits) if hits else frontier
    n = found.distinct().agg(F.count("*").alias("n"), F.min("node").alias("node"))
    return n.select(F.when(F.col("n") == 0, "none").when(F.col("n") == 1, "found").otherwise("ambiguous").alias("verdict"), F.when(F.col("n") == 1, F.col("node")).alias("node"))


def bisect(checks: DataFrame) -> DataFrame:
    """``checks(workspace, sequence, good)`` to the first bad sequence after the last good one before any bad: workspace, last_good, first_bad, probes.

    For histories that turn bad once, with every answer at hand; ``probes`` is the number of answers that a search would ask for.
    """
    # inside blocks of sequences, then over their rows: a workspace may hold most of the answers
    block = F.shiftright(F.col("sequence").cast("long"), BLOCK_BITS)
    bad = F.min(F.when(~F.col("good"), F.col("sequence"))).over(W.partitionBy("workspace", "block"))
    rows = checks.select("workspace", "sequence", "good", block.alias("block")).withColumn("bad", bad)
    before = F.col("good") & (F.col("bad").isNull() | (F.col("sequence") < F.col("bad")))
    blocks = rows.groupBy("workspace", "block").agg(F.min("bad").alias("bad"), F.max(F.when(before, F.col("sequence"))).alias("good"), F.count("*").alias("n"))
    blocks = blocks.withColumn("first_bad", F.min("bad").over(W.partitionBy("workspace")))
    earlier = F.col("first_bad").isNull() | (F.col("block") <= F.shiftright(F.col("first_bad").cast("long"), BLOCK_BITS))
    a = blocks.groupBy("workspace").agg(F.max(F.when(earlier, F.col("good"))).alias("last_good"), F.max("first_bad").alias("first_bad"), F.sum("n").alias("n"))
    return a.select("workspace", "last_good", "first_bad", F.ceil(F.log2(F.col("n").cast("double"))).cast("long").alias("probes"))


def bisect_search(sequences: list[int], is_good) -> int | None:  # noqa: ANN001
    """First bad of ascending sequences by binary search with any predicate, remembered per sequence; None if the last is good.

    A first sequence that is bad already has nothing good before it, which is an error.
    """
    asked: dict[int, bool] = {}

    def good(i: int) -> bool:
        if i not in asked:
            asked[i] = bool(is_good(sequences[i]))
        return asked[i]

    if not sequences or good(len(sequences) - 1):
        return None
    lo, hi = -1, len(sequences) - 1
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if good(mid) else (lo, mid)
    if not hi:
        raise ValueError("the first sequence is bad")
    return sequences[hi]
