"""Queries over what stores exchange and watch: bundles, self-writes, claims in force, upserts, enrichment, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import claims as C
from ..operators import logs
from .model import CHUNKS_SQL, TIMELINE_SQL, chunks, table, timeline

NOW = 1_706_659_200


def bundle_validation(spark: SparkSession, sf: str) -> DataFrame:
    """Records of an import against what is expected: unrelated, duplicate, damaged or missing objects, counted."""
    want = chunks(spark, sf).where("blob % 2 = 0").select("chunk_id").distinct()
    came = chunks(spark, sf).where("blob % 4 = 0 OR blob % 9 = 1").select("chunk_id", (F.col("ordinal") % 50 == 49).alias("damaged"))
    one = came.groupBy("chunk_id").agg(F.count("*").alias("n"), F.bool_or("damaged").alias("damaged"))
    j = want.withColumn("wanted", F.lit(True)).join(one, "chunk_id", "full_outer")
    verdict = F.when(F.col("n").isNull(), "missing").when(F.col("wanted").isNull(), "unrelated").when(F.col("damaged"), "damaged").when(F.col("n") > 1, "duplicate").otherwise("accepted")
    return j.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("objects"))


def self_writes(spark: SparkSession, sf: str) -> DataFrame:
    """Changes that are not the engine's own: those whose state is not the one that it wrote last."""
    t = timeline(spark, sf)
    own = t.where("kind = 'purchase'").groupBy("k").agg(F.max_by("snapshot_id", "sequence").alias("snapshot_id"))
    return t.join(own, ["k", "snapshot_id"], "left_anti").groupBy("kind").agg(F.count("*").alias("n"))


def claims_in_force(spark: SparkSession, sf: str) -> DataFrame:
    """Leases by owner and pattern that have not run out: a claim again changes nothing while one is in force, and begins a new one after it."""
    t = timeline(spark, sf).select(F.concat_ws("/", "kind", F.col("k").cast("string")).alias("key"), "workspace", "sequence", F.col("sealed_at").alias("at"), (86400 * (1 + F.col("k") % 3)).cast("long").alias("ttl"))
    return logs.last_leases(t).where(F.col("expires_at") > NOW).select(F.col("key").alias("pattern"), "workspace", "expires_at", F.col("begun").alias("claimed"))


def _held_claims(spark: SparkSession, sf: str) -> DataFrame:
    t = timeline(spark, sf).where("sequence % 7 = 0")
    third = F.when(F.col("sequence") % 3 == 0, "*").when(F.col("sequence") % 3 == 1, (F.col("sequence") % 5).cast("string"))
    pattern = F.when(F.col("sequence") % 350 == 0, F.concat("kind", F.lit("/**"))).otherwise(F.concat_ws("/", "kind", F.col("k").cast("string"), third))
    return t.select(F.col("sequence").alias("id"), pattern.alias("pattern"), F.concat(F.lit("o"), (F.col("workspace") % 4).cast("string")).alias("owner"), (F.col("workspace") % 3).alias("workspace"), F.col("sealed_at").alias("created_at"), (F.col("sealed_at") + 86400 * (1 + F.col("k") % 9)).alias("expires_at"))


def claim_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """What becomes of asks, against the claims in force: invalid, held already, blocked by an earlier claim, or granted."""
    t = timeline(spark, sf).where("sequence % 7 = 3")
    third = F.when(F.col("sequence") % 4 == 0, "?").when(F.col("sequence") % 4 != 1, (F.col("sequence") % 5).cast("string"))
    pattern = F.when(F.col("sequence") % 90 == 3, "**").when(F.col("sequence") % 95 == 3, "../x").otherwise(F.concat_ws("/", "kind", F.col("k").cast("string"), third))
    asks = t.select("sequence", pattern.alias("pattern"), F.concat(F.lit("o"), (F.col("workspace") % 4).cast("string")).alias("owner"), (F.col("workspace") % 3).alias("workspace"), (F.col("k") * 3600).cast("long").alias("ttl"))
    return C.verdicts(asks, _held_claims(spark, sf), NOW).select("sequence", "verdict", "claim_id", "expires_at")


def claims_released(spark: SparkSession, sf: str) -> DataFrame:
    """Claims after some were released by their id or pattern, and some of these put back."""
    held = _held_claims(spark, sf)
    asks = held.where("id % 5 = 0").select(F.when(F.col("id") % 2 == 0, F.col("id").cast("string")).otherwise(F.col("pattern")).alias("selector"), "owner", "workspace")
    claims = held.withColumn("id", F.col("id").cast("string"))
    gone = C.released(claims, asks)
    left = C.restored(claims.join(gone.select("id"), "id", "left_anti"), gone.where("created_at % 2 = 0"))
    return left.groupBy("owner", "workspace").agg(F.count("*").alias("claims"), F.sum(F.col("id").cast("long")).alias("checksum"))


def upserts(spark: SparkSession, sf: str) -> DataFrame:
    """A cache after a batch of new rows: the later write of each key stays."""
    t = timeline(spark, sf).select("workspace", "kind", "k", "sequence")
    old, new = t.where("sequence % 2 = 0"), t.where("sequence % 2 = 1 AND k % 5 <> 0")
    both = old.withColumn("batch", F.lit(0)).unionByName(new.withColumn("batch", F.lit(1)))
    return both.groupBy("workspace", "kind").agg(F.max_by(F.struct("k", "sequence"), F.struct("batch", "sequence")).alias("v")).select("workspace", "kind", "v.k", "v.sequence")


def fork_enrichment(spark: SparkSession, sf: str) -> DataFrame:
    """Forks with their last change and number of changes."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("fork"), "c_name", F.floor("c_acctbal").cast("long").alias("created_at"))
    t = timeline(spark, sf).groupBy(F.col("workspace").alias("fork")).agg(F.max("sealed_at").alias("updated_at"), F.count("*").alias("changes"))
    return c.join(t, "fork", "left").select("fork", F.col("c_name").alias("name"), "created_at", "updated_at", F.coalesce("changes", F.lit(0)).alias("changes"))


def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Order prices as samples of runs: least, upper median, p95 by rank, largest.  Ranks come from counts of whole values, not from a sort of rows."""
    from pyspark.sql import Window as W

    v = table(spark, sf, "orders").select("o_orderpriority", F.floor("o_totalprice").cast("long").alias("v")).groupBy("o_orderpriority", "v").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(W.partitionBy("o_orderpriority").orderBy("v"))
    v = v.withColumn("upto", upto).withColumn("total", F.sum("n").over(W.partitionBy("o_orderpriority")))
    at = lambda rank: F.min(F.when(F.col("upto") >= rank, F.col("v")))
    return v.groupBy(F.col("o_orderpriority").alias("scenario")).agg(
        F.sum("n").alias("samples"), F.min("v").alias("least"), at(F.floor(F.col("total") / 2) + 1).alias("median"), at(F.floor((F.col("total") * 95 + 99) / 100)).alias("p95"), F.max("v").alias("most")
    )


def decoded(spark: SparkSession, sf: str) -> DataFrame:
    """Percent-decoding of query values, and what cannot be decoded."""
    p = table(spark, sf, "pages").select("page_id", F.concat(F.replace(F.replace("url", F.lit("/"), F.lit("%2F")), F.lit(":"), F.lit("%3A")), F.lit("+x")).alias("raw"))
    return p.select("page_id", F.try_url_decode("raw").alias("decoded"))


def tails(spark: SparkSession, sf: str) -> DataFrame:
    """The last 64 characters of an output, and whether something was cut."""
    return table(spark, sf, "documents").select("doc_id", F.substring("text", -64, 64).alias("tail"), (F.length("text") > 64).alias("cut"))


def catalog_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Wanted (blob, ordinal) keys in the order given, with misses."""
    wanted = spark.range(0, 60).select(F.col("id").alias("place"), (F.col("id") * 3).alias("blob"), (F.col("id") % 4).cast("int").alias("ordinal"))
    return wanted.join(chunks(spark, sf), ["blob", "ordinal"], "left").select("place", "blob", "ordinal", "chunk_id", "len")


_T = f"WITH {TIMELINE_SQL}"
_C = f"WITH {CHUNKS_SQL}"
_HELD_SQL = """held AS (SELECT sequence AS id, CASE WHEN sequence % 350 = 0 THEN kind || '/**' ELSE kind || '/' || k || CASE sequence % 3 WHEN 0 THEN '/*' WHEN 1 THEN '/' || sequence % 5 ELSE '' END END AS pattern,
  CASE WHEN sequence % 350 = 0 THEN kind || '/' ELSE kind || '/' || k || CASE WHEN sequence % 3 = 1 THEN '/' || sequence % 5 ELSE '' END || '/' END AS lead, sequence % 350 = 0 OR sequence % 3 = 0 AS wild,
  'o' || workspace % 4 AS owner, workspace % 3 AS workspace, sealed_at AS created_at, sealed_at + 86400 * (1 + k % 9) AS expires_at FROM timeline WHERE sequence % 7 = 0)"""

QUERIES = {
    "bundle_validation": (bundle_validation, f"{_C}, w AS (SELECT DISTINCT chunk_id FROM chunks WHERE blob % 2 = 0), c AS (SELECT chunk_id, count(*) AS n, bool_or(ordinal % 50 = 49) AS damaged FROM chunks WHERE blob % 4 = 0 OR blob % 9 = 1 GROUP BY 1) SELECT CASE WHEN c.chunk_id IS NULL THEN 'missing' WHEN w.chunk_id IS NULL THEN 'unrelated' WHEN damaged THEN 'damaged' WHEN n > 1 THEN 'duplicate' ELSE 'accepted' END AS verdict, count(*) AS objects FROM w FULL JOIN c ON w.chunk_id = c.chunk_id GROUP BY 1"),
    "self_writes": (self_writes, f"{_T} SELECT kind, count(*) AS n FROM timeline t WHERE NOT EXISTS (SELECT 1 FROM (SELECT k, arg_max(snapshot_id, sequence) AS s FROM timeline WHERE kind = 'purchase' GROUP BY 1) o WHERE o.k = t.k AND o.s = t.snapshot_id) GROUP BY 1"),
    "claims_in_force": (claims_in_force, f"""WITH RECURSIVE {TIMELINE_SQL.strip()},
r AS (SELECT kind || '/' || k AS pattern, workspace, sealed_at AS t0, 86400 * (1 + k % 3) AS ttl, row_number() OVER (PARTITION BY kind, k, workspace ORDER BY sequence) AS i FROM timeline),
w AS (SELECT pattern, workspace, i, t0 + ttl AS expires_at, 1::BIGINT AS claimed FROM r WHERE i = 1
  UNION ALL SELECT r.pattern, r.workspace, r.i, CASE WHEN r.t0 >= w.expires_at THEN r.t0 + r.ttl ELSE w.expires_at END, CASE WHEN r.t0 >= w.expires_at THEN claimed + 1 ELSE claimed END
  FROM w JOIN r ON r.pattern = w.pattern AND r.workspace = w.workspace AND r.i = w.i + 1)
SELECT pattern, workspace, arg_max(expires_at, i) AS expires_at, arg_max(claimed, i) AS claimed FROM w GROUP BY 1, 2 HAVING arg_max(expires_at, i) > {NOW}"""),
    "claim_verdicts": (claim_verdicts, f"""{_T}, {_HELD_SQL},
a AS (SELECT sequence, CASE WHEN sequence % 90 = 3 THEN '**' WHEN sequence % 95 = 3 THEN '../x' ELSE kind || '/' || k || CASE sequence % 4 WHEN 0 THEN '/?' WHEN 1 THEN '' ELSE '/' || sequence % 5 END END AS pattern,
  CASE WHEN sequence % 90 = 3 THEN '' WHEN sequence % 95 = 3 THEN '../x/' ELSE kind || '/' || k || CASE WHEN sequence % 4 > 1 THEN '/' || sequence % 5 ELSE '' END || '/' END AS lead,
  sequence % 90 = 3 OR sequence % 95 <> 3 AND sequence % 4 = 0 AS wild, sequence % 90 <> 3 AND sequence % 95 = 3 AS bad, 'o' || workspace % 4 AS owner, workspace % 3 AS workspace, k * 3600 AS ttl FROM timeline WHERE sequence % 7 = 3),
live AS (SELECT * FROM held WHERE expires_at > {NOW}),
own AS (SELECT a.sequence, min(l.created_at * 1000000000 + l.id) AS c FROM a JOIN live l ON l.pattern = a.pattern AND l.owner = a.owner AND l.workspace = a.workspace GROUP BY 1),
blk AS (SELECT a.sequence, min(l.created_at * 1000000000 + l.id) AS c FROM a JOIN live l ON (l.owner <> a.owner OR l.workspace <> a.workspace)
  AND CASE WHEN a.wild OR l.wild THEN starts_with(a.lead, l.lead) OR starts_with(l.lead, a.lead) ELSE a.pattern = l.pattern END GROUP BY 1),
j AS (SELECT a.*, own.c AS oc, blk.c AS bc, CASE WHEN bad OR ttl < 1 OR ttl > 604800 THEN 'invalid' WHEN own.c IS NOT NULL THEN 'held' WHEN blk.c IS NOT NULL THEN 'blocked' ELSE 'granted' END AS verdict
  FROM a LEFT JOIN own USING (sequence) LEFT JOIN blk USING (sequence))
SELECT sequence, verdict, CASE verdict WHEN 'held' THEN oc % 1000000000 WHEN 'blocked' THEN bc % 1000000000 END AS claim_id,
  CASE verdict WHEN 'held' THEN (SELECT expires_at FROM held WHERE id = oc % 1000000000) WHEN 'granted' THEN {NOW} + ttl END AS expires_at FROM j"""),
    "claims_released": (claims_released, f"""{_T}, {_HELD_SQL}, s AS (SELECT * FROM held WHERE id % 5 = 0),
gone AS (SELECT id FROM held WHERE id % 10 = 0 OR EXISTS (SELECT 1 FROM s WHERE s.id % 2 = 1 AND s.pattern = held.pattern AND s.owner = held.owner AND s.workspace = held.workspace))
SELECT owner, workspace, count(*) AS claims, sum(id)::BIGINT AS checksum FROM held WHERE id NOT IN (SELECT id FROM gone) OR created_at % 2 = 0 GROUP BY 1, 2"""),
    "cache_upserts": (upserts, f"{_T} SELECT workspace, kind, k, sequence FROM (SELECT *, row_number() OVER (PARTITION BY workspace, kind ORDER BY sequence % 2 DESC, sequence DESC) AS rn FROM timeline WHERE sequence % 2 = 0 OR k % 5 <> 0) WHERE rn = 1"),
    "fork_enrichment": (fork_enrichment, f"{_T} SELECT c_custkey AS fork, c_name AS name, floor(c_acctbal)::BIGINT AS created_at, updated_at, coalesce(changes, 0) AS changes FROM customer LEFT JOIN (SELECT workspace, max(sealed_at) AS updated_at, count(*) AS changes FROM timeline GROUP BY 1) t ON t.workspace = c_custkey"),
    "run_summary": (run_summary, "SELECT scenario, count(*) AS samples, min(v) AS least, max(v) FILTER (rn = total // 2 + 1) AS median, max(v) FILTER (rn = (total * 95 + 99) // 100) AS p95, max(v) AS most FROM (SELECT o_orderpriority AS scenario, floor(o_totalprice)::BIGINT AS v, row_number() OVER (PARTITION BY o_orderpriority ORDER BY floor(o_totalprice)) AS rn, count(*) OVER (PARTITION BY o_orderpriority) AS total FROM orders) GROUP BY 1"),
    "url_decoded": (decoded, "SELECT page_id, url || ' x' AS decoded FROM pages"),
    "output_tails": (tails, "SELECT doc_id, right(text, 64) AS tail, length(text) > 64 AS cut FROM documents"),
    "catalog_lookup": (catalog_lookup, f"{_C} SELECT i AS place, i * 3 AS blob, (i % 4)::INT AS ordinal, c.chunk_id, c.len FROM range(60) r(i) LEFT JOIN chunks c ON c.blob = i * 3 AND c.ordinal = i % 4"),
}
