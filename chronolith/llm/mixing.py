"""Mixing sources to target weights by nested hash thresholds: histograms, no sort, no Python on the data.

A document's 32-bit hash is its place in its source.  Tokens are summed by
source and hash bucket; the running sum of a source's buckets meets the source's
budget in one boundary bucket, and only that one is split by further hash bits,
twice.  Documents below the threshold are taken, those above are not, and what
shares the last boundary place is cut to share what is left of the budget.
Growing budgets give nested choices.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import hot_join, materialize

WORD = r"[^\x20\x09-\x0D]+"
SHIFTS = ((22, 1024), (12, 1024), (0, 4096))  # hash bits of the three levels: shift, buckets


def word_count(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _place(doc_id: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long")


def _source_key(source: Column) -> Column:
    """A join key that isn't null, and keeps the order of code points with null last."""
    return F.coalesce(F.concat(F.lit("0"), source), F.lit("1"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """``sizes(key, source_size)``, one row a source, to key, source_size, target.

    Sources in the order of their keys weigh ``weights`` in turn and share the
    sum of all sizes; a target stops at ``cap`` times its source's size, and the
    excess goes to the others by weight.  The window holds one row a source.
    """
    order = W.orderBy("key")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")).cast("long")
    t = sizes.withColumn("weight", weight).withColumn("most", F.col("source_size") * cap)
    by_ratio = W.orderBy(F.col("most") / F.col("weight"), "key")
    upto = by_ratio.rowsBetween(W.unboundedPreceding, 0)
    everything = by_ratio.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    t = t.select(
        "key", "source_size", "weight", "most",
        F.sum("source_size").over(everything).alias("total"),
        (F.sum("most").over(upto) - F.col("most")).alias("before"),
        (F.sum("weight").over(everything) - F.sum("weight").over(upto) + F.col("weight")).alias("open"),
    )
    # in the order of most / weight, a source is capped if its share of what is left, by weight among the rest, reaches its cap
    t = t.withColumn("capped", F.col("most") * F.col("open") <= F.col("weight") * (F.col("total") - F.col("before")))
    t = t.withColumn("left", F.col("total") - F.sum(F.when(F.col("capped"), F.col("most")).otherwise(0)).over(everything))
    t = t.withColumn("free", F.sum(F.when(F.col("capped"), 0).otherwise(F.col("weight"))).over(everything))
    share = F.col("weight").cast("double") * F.col("left") / F.when(F.col("free") > 0, F.col("free"))
    return t.select("key", "source_size", F.when(F.col("capped"), F.col("most").cast("double")).otherwise(share).alias("target"))


def _boundary(hist: DataFrame, level: int) -> DataFrame:
    """``hist(key, b, words, extra)``: the row of each key in whose bucket the running sum of words passes ``extra``."""
    upto = W.partitionBy("key").orderBy("b").rowsBetween(W.unboundedPreceding, 0)
    run = hist.withColumn("upto", F.sum("words").over(upto)).withColumn("below", F.col("upto") - F.col("words"))
    run = run.where("below <= extra AND upto > extra")
    return run.select("key", F.col("b").alias(f"t{level}"), (F.col("extra") - F.col("below")).alias("extra"), F.col("words").alias("in_bucket"))


def mixed_takes(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """``docs(doc_id, source, text, ...)`` to one row per input row: doc_id, size, source_size, target, taken.

    ``size`` counts the words of the text (null: 0).  ``taken`` is the number of
    words that the mix takes, whole repeats counted: every document of a source
    as often as its budget holds the whole source, and once more below the
    source's threshold.  The sum over a source is its target, rounded, less one
    word at most for each row that shares the last boundary place.
    An empty table gives no rows; sources without words have target 0.
    Repeated rows share a place and are treated alike.
    """
    place = _place(F.col("doc_id"))
    rows = docs.select("doc_id", _source_key(F.col("source")).alias("key"), word_count(F.col("text")).alias("size"), place.alias("h"))
    rows = materialize(rows, "sizes")
    return _apply(rows, _thresholds(rows, weights, cap)).select("doc_id", "size", "source_size", "target", "taken")


def _level(k: int) -> Column:
    shift, n = SHIFTS[k]
    return F.shiftright("h", shift).bitwiseAND(n - 1)


def _thresholds(rows: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """One row for each source: its target, whole copies, and the three levels of its threshold."""
    hist = materialize(rows.groupBy("key", _level(0).alias("b")).agg(F.sum("size").alias("words"), F.count("*").alias("rows")), "histogram")
    t = targets(hist.groupBy("key").agg(F.sum("words").alias("source_size")), weights, cap)
    t = t.join(hist.groupBy("key").agg(F.sum("rows").alias("rows")), "key")
    budget = F.round("target").cast("long")
    copies = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    t = t.withColumn("copies", copies).withColumn("extra", F.when(F.col("source_size") > 0, budget - F.col("copies") * F.col("source_size")).otherwise(0))
    t = materialize(t, "targets")
    at = _boundary(hist.drop("rows").join(t.select("key", "extra"), "key"), 0)
    for k in (1, 2):
        keys = [f"t{i}" for i in range(k)]
        inside = rows.select("key", "size", *(_level(i).alias(f"t{i}") for i in range(k)), _level(k).alias("b"))
        hist = inside.join(at.drop("in_bucket"), ["key", *keys]).groupBy("key", *keys, "extra", "b").agg(F.sum("size").alias("words"))
        at = _boundary(hist, k).join(at.select("key", *keys), "key")
        at = materialize(at, f"threshold{k}")
    at = at.withColumnRenamed("extra", "left").select("key", *(f"t{i}" for i in range(3)), "left", "in_bucket")
    return materialize(t.drop("extra").join(at, "key", "left"), "thresholds")


def _apply(rows: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Adds source_size, target, taken to rows with key, size, h.

    Rows of large sources stay where they are and meet a copy of the few thresholds of these; the others are shuffled by source.
    """
    joined = hot_join(rows, thresholds, "key", n="rows")
    at = [_level(k) for k in range(3)]
    lower = reduce(lambda inner, k: (at[k] < F.col(f"t{k}")) | ((at[k] == F.col(f"t{k}")) & inner), (1, 0), at[2] < F.col("t2"))
    same = (at[0] == F.col("t0")) & (at[1] == F.col("t1")) & (at[2] == F.col("t2"))
    part = F.floor(F.col("size").cast("double") * F.col("left") / F.col("in_bucket")).cast("long")
    once = F.when(F.coalesce(lower, F.lit(False)), F.col("size")).when(F.coalesce(same, F.lit(False)), part).otherwise(0)
    return joined.withColumn("taken", F.col("copies") * F.col("size") + once)


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """The mix itself: rows of ``docs`` as often as taken, with all their columns; a document on the boundary is cut after its taken words.

    Rows that lose or gain nothing keep their text to the byte.  Documents without words take no part.  A column of ``docs`` named
    ``n_chars`` follows a cut text.
    """
    own = docs.select(F.struct(*docs.columns).alias("doc"), "doc_id", _source_key(F.col("source")).alias("key"), word_count(F.col("text")).alias("size"), _place(F.col("doc_id")).alias("h"))
    light = materialize(own.select("key", "size", "h"), "sizes")
    taken = _apply(own, _thresholds(light, weights, cap)).where("taken > 0")
    text = F.col("doc.text")
    # split after each word, so that white space before a kept word stays
    cut = F.array_join(F.slice(F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"), 1, F.greatest((F.col("taken") % F.col("size")).cast("int"), F.lit(1))), "")
    whole = F.array_repeat(text, (F.col("taken") / F.col("size")).cast("int"))
    texts = F.when(F.col("taken") % F.col("size") > 0, F.concat(whole, F.array(cut))).otherwise(whole)
    out = taken.select("doc", F.explode(texts).alias("text"))
    columns = [F.col("text") if c == "text" else F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col("doc").getField(c).alias(c) for c in docs.columns]
    return out.select(*columns)


#: The same rows in DuckDB, by a running sum over the whole hash.
ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, coalesce('0' || source, '1') AS key, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
  FROM documents),
src AS (SELECT key, sum(size)::BIGINT AS source_size FROM sized GROUP BY key),
wt AS (SELECT *, 3 * source_size AS most, CASE (row_number() OVER (ORDER BY key) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM src),
run AS (
  SELECT *, (sum(source_size) OVER ())::BIGINT AS total,
         (sum(most) OVER (ORDER BY most / weight, key ROWS UNBOUNDED PRECEDING) - most)::BIGINT AS before,
         (sum(weight) OVER (ORDER BY most / weight, key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS open
  FROM wt),
cap AS (SELECT *, most * open <= weight * (total - before) AS capped FROM run),
lft AS (
  SELECT *, (total - sum(CASE WHEN capped THEN most ELSE 0 END) OVER ())::BIGINT AS left_,
         (sum(CASE WHEN capped THEN 0 ELSE weight END) OVER ())::BIGINT AS free FROM cap),
tgt AS (SELECT key, source_size, CASE WHEN capped THEN most::DOUBLE ELSE weight::DOUBLE * left_ / free END AS target FROM lft),
bud AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(round(target)::BIGINT / source_size)::BIGINT ELSE 0 END AS copies FROM tgt),
ext AS (SELECT *, CASE WHEN source_size > 0 THEN round(target)::BIGINT - copies * source_size ELSE 0 END AS extra FROM bud),
place AS (SELECT key, h, sum(size)::BIGINT AS words FROM sized GROUP BY key, h),
upto AS (SELECT *, (sum(words) OVER (PARTITION BY key ORDER BY h))::BIGINT AS upto FROM place)
SELECT s.doc_id, s.size, e.source_size, e.target,
       (e.copies * s.size + CASE WHEN u.upto <= e.extra THEN s.size
                                 WHEN u.upto - u.words >= e.extra THEN 0
                                 ELSE floor(s.size::DOUBLE * (e.extra - (u.upto - u.words)) / u.words) END)::BIGINT AS taken
FROM sized s JOIN ext e USING (key) JOIN upto u ON u.key = s.key AND u.h = s.h
"""
