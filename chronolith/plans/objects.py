"""Queries over stored objects: chunks, sync, graphs, garbage, ancestry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import chunks as C
from ..operators import reach as G
from ..operators.retention import running_sum
from .model import CHUNKS_SQL, EDGES_SQL, chunks, edges, table

NOW = 1_706_659_200


def chunk_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return C.distinct_chunks(chunks(spark, sf))


def chunk_estimate(spark: SparkSession, sf: str) -> DataFrame:
    return C.estimate(chunks(spark, sf))


def chunk_grades(spark: SparkSession, sf: str) -> DataFrame:
    c = chunks(spark, sf)
    return C.grade(c, c.where("stored"))


def chunk_missing(spark: SparkSession, sf: str) -> DataFrame:
    c = chunks(spark, sf)
    g = C.grade(c, c.where("stored"))
    return g.groupBy("grade").agg(F.count("*").alias("blobs"), F.sum("missing").alias("missing"), F.sum("missing_bytes").alias("missing_bytes"))


def sync_push(spark: SparkSession, sf: str) -> DataFrame:
    c = chunks(spark, sf)
    return C.negotiate(c, c.where("stored")).groupBy("reused").agg(F.count("*").alias("n"), F.sum("len").alias("bytes"))


def sync_pull(spark: SparkSession, sf: str) -> DataFrame:
    """Objects of the remote's newest documents against the local store, by document: fetched and reused."""
    c = chunks(spark, sf)
    local = c.where("blob % 2 = 0").select("chunk_id").distinct().withColumn("have", F.lit(True))
    want = c.where("blob % 2 = 1").join(local, "chunk_id", "left")
    return want.groupBy("blob").agg(F.count_if(F.col("have").isNull()).alias("fetched"), F.count_if(F.col("have").isNotNull()).alias("reused"))


def _packed(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("pack"), F.col("o_orderkey").alias("id"), F.floor(F.col("o_totalprice") / 100).cast("long").alias("len"))
    size = F.col("len") + 82
    return running_sum(o.withColumn("size", size), ["pack"], "id", "size", "end").select("pack", "id", "len", (F.col("end") - size).alias("offset"))


def pack_stab(spark: SparkSession, sf: str) -> DataFrame:
    """Objects wholly before a position of their pack, and those that cross it."""
    at = F.lit(5000)
    end = F.col("offset") + F.col("len") + 4
    return _packed(spark, sf).groupBy("pack").agg(F.count_if(end <= at).alias("before"), F.count_if((F.col("offset") < at) & (end > at)).alias("crossing"))


def catalog_totals(spark: SparkSession, sf: str) -> DataFrame:
    return _packed(spark, sf).agg(F.count("*").alias("objects"), F.coalesce(F.sum("len"), F.lit(0)).alias("bytes"))


def graph_edges(spark: SparkSession, sf: str) -> DataFrame:
    return edges(spark, sf).distinct().groupBy(F.substring("src", 1, 1).alias("from_kind"), F.substring("dst", 1, 1).alias("to_kind"), "class_bit").agg(F.count("*").alias("n"))


def graph_closure(spark: SparkSession, sf: str) -> DataFrame:
    roots = table(spark, sf, "region").where("r_regionkey = 1").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"))
    return G.reach(roots, edges(spark, sf))


def _roots(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    sealed = F.lit(NOW) - (F.col("c_custkey") % 50) * V.DAY
    return c.where("c_custkey % 4 <> 1").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"), V.byte_mask(NOW, sealed, F.col("c_custkey") % 100 == 0).cast("int").alias("mask"))


def gc_marks(spark: SparkSession, sf: str) -> DataFrame:
    return G.marks(_roots(spark, sf), edges(spark, sf))


def gc_report(spark: SparkSession, sf: str) -> DataFrame:
    m = G.marks(_roots(spark, sf), edges(spark, sf)).select(F.col("node"), F.lit(True).alias("live"))
    o = table(spark, sf, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("node"), F.floor("o_totalprice").cast("long").alias("len"))
    j = o.join(m, "node", "left").select(F.coalesce("live", F.lit(False)).alias("live"), "len")
    return j.groupBy("live").agg(F.count("*").alias("objects"), F.sum("len").alias("payload"), (F.sum("len") + F.count("*") * 82).alias("projected"))


def gc_roots(spark: SparkSession, sf: str) -> DataFrame:
    """Roots by where they come from: retained customers, restores, incoming ones; one object may be several."""
    r = _roots(spark, sf).select("node", F.lit("retained").alias("origin"))
    c = table(spark, sf, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"), "c_custkey")
    more = c.where("c_custkey % 31 = 0").select("node", F.lit("restore").alias("origin")).unionByName(c.where("c_custkey % 37 = 0").select("node", F.lit("incoming").alias("origin")))
    return r.unionByName(more).groupBy("node").agg(F.count("*").alias("origins"), F.array_join(F.sort_array(F.collect_list("origin")), ",").alias("names"))


def _commits(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of conversations as commits; the first of every conversation hangs on a turn of the one before by sevens."""
    c = table(spark, sf, "conversations").select("conv_id", "turn")
    name = lambda a, b: F.concat_ws(":", a.cast("string"), b.cast("string"))
    first = c.groupBy("conv_id").agg(F.min("turn").alias("turn"))
    inner = c.alias("a").join(c.alias("b"), (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("a.turn") == F.col("b.turn") + 1)).select(name(F.col("a.conv_id"), F.col("a.turn")).alias("src"), name(F.col("b.conv_id"), F.col("b.turn")).alias("dst"))
    hang = first.where("conv_id % 7 <> 0").alias("f").join(first.alias("g"), F.col("g.conv_id") == F.col("f.conv_id") - F.col("f.conv_id") % 7)
    return inner.unionByName(hang.select(name(F.col("f.conv_id"), F.col("f.turn")).alias("src"), name(F.col("g.conv_id"), F.col("g.turn")).alias("dst")))


def merge_bases(spark: SparkSession, sf: str) -> DataFrame:
    c = _commits(spark, sf)
    tip = lambda k: table(spark, sf, "conversations").where(f"conv_id = {k}").groupBy("conv_id").agg(F.max("turn").alias("turn")).select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("node"))
    cases = [G.merge_base(c, G.reach(tip(a), c), tip(b)).select(F.lit(f"{a} {b}").alias("pair"), "verdict", "node") for a, b in ((8, 10), (8, 1))]
    return cases[0].unionByName(cases[1])


def bisect(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("workspace"), F.col("turn").alias("sequence"), (F.length("text") < 250).alias("good"))
    return G.bisect(c)


def cdc_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Content-defined chunks of whole texts, with bounds for texts of this size."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("blob"), F.col("text").cast("binary").alias("content"))
    return C.content_chunks(d, 256, 1024, 4096)


def fork_cost(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("workspace")).agg(F.count("*").alias("entries"), F.sum(F.floor("o_totalprice").cast("long")).alias("bytes"))
    return o.select("workspace", "entries", V.ceil_div(F.col("bytes"), 4096).alias("blocks"), F.greatest(F.lit(10).cast("long"), V.ceil_div(F.col("entries") * 15, 100)).alias("seconds"))


def fork_tier(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("fork")).agg(F.count_if(F.col("l_returnflag") == "A").alias("cloned"), F.count_if((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 49)).alias("copied"))
    return li.select("fork", "cloned", "copied", F.when(F.col("copied") == 0, "native-cow").when(F.col("cloned") == 0, "streaming-copy").otherwise("mixed").alias("tier"))


def hard_links(spark: SparkSession, sf: str) -> DataFrame:
    """Aliases of one file: entries beyond the first of each (device, number) with several."""
    li = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n")).where("n > 1")
    return li.groupBy("l_suppkey").agg(F.sum(F.col("n") - 1).alias("aliases"), F.count("*").alias("files"))


def sorted_attributes(spark: SparkSession, sf: str) -> DataFrame:
    """Attributes of an entry as one list in the order of names."""
    e = table(spark, sf, "events").select("user_id", "event_type", "event_id").groupBy("user_id", "event_type").agg(F.max("event_id").alias("v"))
    return e.groupBy("user_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("event_type", "v"))), lambda x: F.concat_ws("=", x["event_type"], x["v"].cast("string"))), ";").alias("attributes"))


_C = f"WITH {CHUNKS_SQL}"
_E = f"WITH RECURSIVE {EDGES_SQL.strip()}"
_STORE = "store AS (SELECT DISTINCT chunk_id FROM chunks WHERE stored)"
_GRADE = f"{_STORE}, g AS (SELECT blob, count(*) FILTER (s.chunk_id IS NULL) AS missing, coalesce(sum(len) FILTER (s.chunk_id IS NULL), 0)::BIGINT AS missing_bytes FROM chunks c LEFT JOIN store s USING (chunk_id) GROUP BY 1)"
_PACK = "packed AS (SELECT o_custkey AS pack, o_orderkey AS id, floor(o_totalprice / 100)::BIGINT AS len, coalesce(sum(floor(o_totalprice / 100)::BIGINT + 82) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM orders)"
_MASKS = f"""
roots AS (
  SELECT 'c' || c_custkey AS node, CASE WHEN c_custkey % 100 = 0 THEN 255 ELSE 71 + CASE WHEN c_custkey % 50 <= 30 THEN 32 ELSE 0 END + CASE WHEN c_custkey % 50 <= 3 THEN 24 ELSE 0 END + CASE WHEN c_custkey % 50 <= 1 THEN 128 ELSE 0 END END AS mask
  FROM customer WHERE c_custkey % 4 <> 1),
m AS (SELECT node, mask FROM roots UNION SELECT e.dst, m.mask FROM m JOIN edges e ON e.src = m.node AND (m.mask & e.class_bit) <> 0),
marks AS (SELECT node, bit_or(mask)::INT AS mask FROM m GROUP BY 1)"""
_COMMITS = """
firsts AS (SELECT conv_id, min(turn) AS turn FROM conversations GROUP BY 1),
parents AS (
  SELECT a.conv_id || ':' || a.turn AS src, b.conv_id || ':' || b.turn AS dst FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1
  UNION ALL SELECT f.conv_id || ':' || f.turn, g.conv_id || ':' || g.turn FROM firsts f JOIN firsts g ON g.conv_id = f.conv_id - f.conv_id % 7 WHERE f.conv_id % 7 <> 0)"""

QUERIES = {
    "chunk_dedup": (chunk_dedup, f"{_C} SELECT chunk_id, max(len) AS len, count(*) AS refs FROM chunks GROUP BY 1"),
    "chunk_estimate": (chunk_estimate, f"{_C} SELECT sum(refs)::BIGINT AS n_chunks, count(*) AS distinct_chunks, sum(len * refs)::BIGINT AS logical_bytes, sum(len)::BIGINT AS unique_bytes, sum(CASE WHEN present THEN len ELSE 0 END)::BIGINT AS held_bytes, sum(CASE WHEN present THEN 0 ELSE len END)::BIGINT AS projected_bytes FROM (SELECT chunk_id, max(len) AS len, bool_or(stored) AS present, count(*) AS refs FROM chunks GROUP BY 1)"),
    "chunk_grades": (chunk_grades, f"{_C}, {_GRADE} SELECT blob, CASE WHEN missing = 0 THEN 'exact' ELSE 'partial' END AS grade, missing, missing_bytes FROM g"),
    "chunk_missing": (chunk_missing, f"{_C}, {_GRADE} SELECT CASE WHEN missing = 0 THEN 'exact' ELSE 'partial' END AS grade, count(*) AS blobs, sum(missing)::BIGINT AS missing, sum(missing_bytes)::BIGINT AS missing_bytes FROM g GROUP BY 1"),
    "chunk_cdc": (cdc_chunks, None),
    "sync_push": (sync_push, f"{_C}, {_STORE} SELECT reused, count(*) AS n, sum(len)::BIGINT AS bytes FROM (SELECT chunk_id, max(len) AS len, chunk_id IN (SELECT chunk_id FROM store) AS reused FROM chunks GROUP BY 1) GROUP BY 1"),
    "sync_pull": (sync_pull, f"{_C}, have AS (SELECT DISTINCT chunk_id FROM chunks WHERE blob % 2 = 0) SELECT blob, count(*) FILTER (h.chunk_id IS NULL) AS fetched, count(h.chunk_id) AS reused FROM chunks c LEFT JOIN have h USING (chunk_id) WHERE blob % 2 = 1 GROUP BY 1"),
    "pack_stab": (pack_stab, f"WITH {_PACK} SELECT pack, count(*) FILTER (\"offset\" + len + 4 <= 5000) AS before, count(*) FILTER (\"offset\" < 5000 AND \"offset\" + len + 4 > 5000) AS crossing FROM packed GROUP BY 1"),
    "catalog_totals": (catalog_totals, f"WITH {_PACK} SELECT count(*) AS objects, sum(len)::BIGINT AS bytes FROM packed"),
    "graph_edges": (graph_edges, f"{_E} SELECT substr(src, 1, 1) AS from_kind, substr(dst, 1, 1) AS to_kind, class_bit, count(*) AS n FROM (SELECT DISTINCT * FROM edges) GROUP BY 1, 2, 3"),
    "graph_closure": (graph_closure, f"{_E}, w AS (SELECT 'r1' AS node, 0 AS depth UNION SELECT e.dst, w.depth + 1 FROM w JOIN edges e ON e.src = w.node) SELECT node, min(depth)::INT AS depth FROM w GROUP BY 1"),
    "gc_marks": (gc_marks, f"{_E}, {_MASKS} SELECT * FROM marks"),
    "gc_report": (gc_report, f"{_E}, {_MASKS} SELECT live, count(*) AS objects, sum(len)::BIGINT AS payload, (sum(len) + count(*) * 82)::BIGINT AS projected FROM (SELECT floor(o_totalprice)::BIGINT AS len, 'o' || o_orderkey IN (SELECT node FROM marks) AS live FROM orders) GROUP BY 1"),
    "gc_roots": (gc_roots, "SELECT node, count(*) AS origins, string_agg(origin, ',' ORDER BY origin) AS names FROM (SELECT 'c' || c_custkey AS node, 'retained' AS origin FROM customer WHERE c_custkey % 4 <> 1 UNION ALL SELECT 'c' || c_custkey, 'restore' FROM customer WHERE c_custkey % 31 = 0 UNION ALL SELECT 'c' || c_custkey, 'incoming' FROM customer WHERE c_custkey % 37 = 0) GROUP BY 1"),
    "graph_merge_base": (merge_bases, f"""WITH RECURSIVE {_COMMITS},
tips AS (SELECT conv_id, conv_id || ':' || max(turn) AS node FROM conversations GROUP BY 1),
a AS (SELECT node FROM tips WHERE conv_id = 8 UNION SELECT p.dst FROM a JOIN parents p ON p.src = a.node),
b AS (SELECT conv_id, node FROM tips WHERE conv_id IN (10, 1) UNION SELECT b.conv_id, p.dst FROM b JOIN parents p ON p.src = b.node WHERE b.node NOT IN (SELECT node FROM a)),
n AS (SELECT c AS conv_id, count(DISTINCT node) AS n, min(node) AS node FROM unnest([10, 1]) t(c) LEFT JOIN (SELECT * FROM b WHERE node IN (SELECT node FROM a)) h ON h.conv_id = c GROUP BY 1)
SELECT '8 ' || conv_id AS pair, CASE n WHEN 0 THEN 'none' WHEN 1 THEN 'found' ELSE 'ambiguous' END AS verdict, CASE WHEN n = 1 THEN node END AS node FROM n"""),
    "graph_bisect": (bisect, "SELECT workspace, max(CASE WHEN good AND (fb IS NULL OR sequence < fb) THEN sequence END) AS last_good, any_value(fb) AS first_bad, ceil(log2(count(*)))::BIGINT AS probes FROM (SELECT conv_id AS workspace, turn AS sequence, length(text) < 250 AS good, min(CASE WHEN length(text) >= 250 THEN turn END) OVER (PARTITION BY conv_id) AS fb FROM conversations) GROUP BY 1"),
    "fork_cost": (fork_cost, "SELECT workspace, entries, ceil(bytes / 4096.0)::BIGINT AS blocks, greatest(10, ceil(entries * 15 / 100.0))::BIGINT AS seconds FROM (SELECT o_custkey AS workspace, count(*) AS entries, sum(floor(o_totalprice)::BIGINT)::BIGINT AS bytes FROM orders GROUP BY 1)"),
    "fork_tier": (fork_tier, "SELECT fork, cloned, copied, CASE WHEN copied = 0 THEN 'native-cow' WHEN cloned = 0 THEN 'streaming-copy' ELSE 'mixed' END AS tier FROM (SELECT l_suppkey AS fork, count(*) FILTER (l_returnflag = 'A') AS cloned, count(*) FILTER (l_returnflag = 'R' AND l_quantity > 49) AS copied FROM lineitem GROUP BY 1)"),
    "tree_hard_links": (hard_links, "SELECT l_suppkey, sum(n - 1)::BIGINT AS aliases, count(*) AS files FROM (SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1"),
    "tree_sorted_attributes": (sorted_attributes, "SELECT user_id, string_agg(event_type || '=' || v, ';' ORDER BY event_type) AS attributes FROM (SELECT user_id, event_type, max(event_id) AS v FROM events GROUP BY 1, 2) GROUP BY 1"),
}
