"""Queries over timelines: thinning, pins, ranges, checks, pages, masks, leases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import logs, retention
from .model import HISTORY_SQL, TIMELINE_SQL, long_history, table, timeline

NOW = 1_706_659_200  # 2024-01-31, within the timeline of events
LATER = 1_009_843_200  # 2002-01-01, after the long history
KEPT_EVENTS = 9_500
PINS = "sequence % 97 = 0"

_RETAINED_SQL = """
aged AS (SELECT *, {now} - sealed_at AS age, {pins} AS pinned FROM timeline),
tiered AS (
  SELECT *, CASE WHEN age <= 86400 THEN 'all' WHEN age <= 604800 THEN 'hour' WHEN age <= 7776000 THEN 'day' ELSE 'week' END AS tier,
         floor(sealed_at / CASE WHEN age <= 604800 THEN 3600.0 WHEN age <= 7776000 THEN 86400.0 ELSE 604800.0 END)::BIGINT AS bucket FROM aged),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY workspace, tier, bucket, pinned ORDER BY sealed_at DESC, sequence DESC) AS rn,
         max(sequence) OVER (PARTITION BY workspace) AS head FROM tiered),
retained AS (SELECT workspace, sequence, sealed_at, tier FROM ranked WHERE tier = 'all' OR pinned OR rn = 1 OR sequence = head)"""


def _pins(log: DataFrame) -> DataFrame:
    return log.where(PINS).select("workspace", "sequence")


def _kept(spark: SparkSession, sf: str) -> DataFrame:
    t = timeline(spark, sf)
    return retention.retained(t, _pins(t), NOW)


def retention_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _kept(spark, sf).groupBy("workspace", "tier").agg(F.count("*").alias("n"), F.max("sequence").alias("newest"))


def retention_rows(spark: SparkSession, sf: str) -> DataFrame:
    h = long_history(spark, sf)
    return retention.retained(h, _pins(h), LATER).select("workspace", "sequence", "sealed_at", "tier")


def retention_ranges(spark: SparkSession, sf: str) -> DataFrame:
    h = long_history(spark, sf).withColumn("workspace", F.col("workspace") % 3)
    return retention.ranges(retention.retained(h, _pins(h), LATER))


def retention_totals(spark: SparkSession, sf: str) -> DataFrame:
    t = timeline(spark, sf)
    kept = _kept(spark, sf).groupBy("workspace").agg(F.count("*").alias("retained"))
    return t.groupBy("workspace").agg(F.count("*").alias("total")).join(kept, "workspace", "left").select("workspace", "total", "retained", (F.col("total") - F.col("retained")).alias("thinned"))


def ranges_valid(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window as W

    r = retention.ranges(_kept(spark, sf))
    prev = F.lag("last").over(W.partitionBy("workspace").orderBy("first"))
    return r.withColumn("before", prev).groupBy("workspace").agg(F.count("*").alias("n_ranges"), F.count_if(F.col("before") >= F.col("first") - 1).alias("n_overlaps"))


def chain_breaks(spark: SparkSession, sf: str) -> DataFrame:
    t = timeline(spark, sf)
    # a log whose every 501st row names the wrong predecessor
    t = retention.with_previous(t, ["workspace"], "sequence", {"named": "snapshot_id"})
    log = t.select("workspace", F.col("sequence").alias("position"), "sequence", F.col("snapshot_id").alias("hash"), F.when(F.col("sequence") % 501 == 0, "?").otherwise(F.col("named")).alias("previous"))
    return retention.chain_breaks(log)


def skip_repeats(spark: SparkSession, sf: str) -> DataFrame:
    return retention.without_repeats(timeline(spark, sf)).groupBy("workspace").agg(F.count("*").alias("appended"), F.sum("sequence").alias("checksum"))


def timeline_recent(spark: SparkSession, sf: str) -> DataFrame:
    return logs.newest(timeline(spark, sf), 20).select("workspace", "sequence", "sealed_at", "kind")


def timeline_pins(spark: SparkSession, sf: str) -> DataFrame:
    t = timeline(spark, sf)
    pins = _pins(t).withColumn("pinned", F.lit(True))
    return t.join(pins, ["workspace", "sequence"], "left").groupBy("workspace", F.coalesce("pinned", F.lit(False)).alias("pinned")).agg(F.count("*").alias("n"), F.max("sealed_at").alias("newest"))


def recent_of_ranges(spark: SparkSession, sf: str) -> DataFrame:
    r = retention.ranges(_kept(spark, sf)).select(F.explode(F.sequence("first", "last")).alias("sequence"))
    return r.distinct().orderBy(F.col("sequence").desc()).limit(50)


def event_page(spark: SparkSession, sf: str) -> DataFrame:
    p = logs.page(timeline(spark, sf), 1000, 100)
    return p.select("sequence", "kind", V.cursor(F.lit("family"), F.col("sequence")).alias("cursor"))


def cursor_codec(spark: SparkSession, sf: str) -> DataFrame:
    t = timeline(spark, sf)
    c = F.concat(F.when(F.col("sequence") % 3 == 0, "other").otherwise("family"), F.lit(":"), F.when(F.col("sequence") % 5 == 0, "x").otherwise(F.col("sequence").cast("string")))
    return t.select("sequence", V.cursor_sequence(c, "family").alias("parsed"))


def cursor_state(spark: SparkSession, sf: str) -> DataFrame:
    """Whether cursors are found in a log that keeps the newest ``KEPT_EVENTS``: a cursor before the oldest of them has expired."""
    a = timeline(spark, sf).agg(F.min("sequence").alias("least"), F.max("sequence").alias("newest"))
    a = a.select(F.greatest("least", F.col("newest") - KEPT_EVENTS + 1).alias("oldest"), "newest")
    return a.select("oldest", "newest", F.explode(F.array(*(F.lit(x).cast("long") for x in (0, 400, 500, 501, 900, 10**9)))).alias("cursor")).select(
        "cursor", F.when(F.col("cursor") < F.col("oldest") - 1, "expired").when(F.col("cursor") > F.col("newest"), "unknown").otherwise("found").alias("state")
    )


def fork_updates(spark: SparkSession, sf: str) -> DataFrame:
    """What a follower gets with the first row's id, with one that the log never had, and without any."""
    import hashlib

    t = timeline(spark, sf).withColumn("snapshot_id", F.sha2(F.col("sequence").cast("string"), 256))
    at = t.agg(F.min("sequence")).first()[0] or 0
    cursors = {"first": hashlib.sha256(str(at).encode()).hexdigest(), "unknown": "no such id", "none": None}
    parts = [logs.updates_after(t, c, 5).select(F.lit(asked).alias("asked"), "sequence", "kind", "cursor_found") for asked, c in cursors.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def positional_get(spark: SparkSession, sf: str) -> DataFrame:
    t = timeline(spark, sf)
    wanted = spark.range(0, 400, 7).select(F.col("id").alias("sequence"))
    return t.join(F.broadcast(wanted), "sequence").select("sequence", "workspace", "kind")  # sixty literal rows


def last_match(spark: SparkSession, sf: str) -> DataFrame:
    return timeline(spark, sf).where("k % 2 = 0").groupBy("kind").agg(F.max_by("workspace", "sequence").alias("workspace"), F.max("sequence").alias("sequence"))


def byte_masks(spark: SparkSession, sf: str) -> DataFrame:
    t = timeline(spark, sf)
    exact = F.col("sequence") % 211 == 0
    return t.withColumn("mask", V.byte_mask(NOW, F.col("sealed_at"), exact).cast("int")).groupBy("mask").agg(F.count("*").alias("n"), F.min("sealed_at").alias("oldest"))


def budget_status(spark: SparkSession, sf: str) -> DataFrame:
    """Usage against both limits: the most a store may take, and the least that its disk keeps free."""
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("workspace")).agg(F.sum(F.floor("o_totalprice").cast("long")).alias("used"))
    budget, reserved = F.lit(1_500_000).cast("long"), F.lit(300_000).cast("long")
    used, available = F.col("used"), V.saturating_sub(F.lit(3_000_000).cast("long"), F.col("used") + F.col("workspace") % 7 * 250_000)
    over, below = V.saturating_sub(used, budget), V.saturating_sub(reserved, available)
    return o.select(
        "workspace", "used", over.alias("over"), V.saturating_sub(budget, used).alias("free"), (used > budget).alias("exceeded"), V.human_bytes(used).alias("shown"),
        available.alias("available"), below.alias("below_reserved"), ((over == 0) & (below == 0)).alias("satisfied"),
    )


def budget_backoff(spark: SparkSession, sf: str) -> DataFrame:
    """Tries to free space, by workspace, in a log of usage that a try may or may not bring down."""
    t = timeline(spark, sf).select("workspace", "sequence", (F.col("k") * 8).cast("long").alias("used"), F.col("sealed_at").alias("at"), (F.col("k") % 5 == 0).alias("satisfied"))
    return logs.pressure_tries(t, growth=64).groupBy("workspace").agg(F.count("*").alias("tries"), F.max("sequence").alias("last"))


def byte_sizes(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", (F.col("p_partkey") * F.col("p_partkey") * 997).alias("n"))
    unit = F.element_at(F.array(*map(F.lit, ("", "K", "MiB", "gb", "x"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return p.select("p_partkey", V.human_bytes(F.col("n")).alias("shown"), V.parse_bytes(F.concat((F.col("p_partkey") % 1000).cast("string"), unit)).alias("parsed"))


def digests(spark: SparkSession, sf: str) -> DataFrame:
    t = timeline(spark, sf)
    return t.select("sequence", V.object_id("snapshot", F.col("sequence")).alias("object_id"), V.digest_id("conflict", F.col("workspace"), F.col("kind")).alias("digest_id"))


def labels(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of turns, made and read back."""
    c = table(spark, sf, "conversations")
    label = F.concat_ws(" ", F.concat(F.lit("agent="), "role"), F.concat(F.lit("turn="), F.col("turn").cast("string")))
    c = c.withColumn("label", label)
    return c.select("conv_id", "turn", "label", F.regexp_extract("label", r"agent=(\S+)", 1).alias("agent"), F.regexp_extract("label", r"turn=(\d+)", 1).cast("long").alias("parsed_turn"))


def prefix_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """Snapshot prefixes: found by one id, ambiguous, unknown, or too short to try."""
    ids = timeline(spark, sf).select("snapshot_id").distinct()
    wanted = ids.select(F.substring("snapshot_id", 1, 8).alias("prefix")).unionByName(ids.select(F.substring("snapshot_id", 1, 5).alias("prefix"))).unionByName(ids.select(F.concat(F.lit("zz"), F.substring("snapshot_id", 1, 8)).alias("prefix"))).distinct()
    hit = ids.select("snapshot_id", F.substring("snapshot_id", 1, 8).alias("prefix")).groupBy("prefix").agg(F.count("*").alias("n"))
    j = wanted.join(hit, "prefix", "left")
    state = F.when(F.length("prefix") < 8, "too_short").when(F.col("n") == 1, "found").when(F.col("n") > 1, "ambiguous").otherwise("unknown")
    return j.select("prefix", state.alias("state"))


def kv_latest(spark: SparkSession, sf: str) -> DataFrame:
    t = timeline(spark, sf).select("workspace", "k", "sequence", "kind")
    return logs.latest_values(t, ["workspace", "k"], F.col("kind") == "error")


def _heads(spark: SparkSession, sf: str) -> DataFrame:
    """Root trees of a workspace and its remote, as numbers: of now, of the last sync, and of what the remote was built on."""
    t = timeline(spark, sf)
    at = lambda c: F.max(F.when(F.expr(c), F.col("k")))
    h = t.groupBy("workspace").agg(at("kind = 'click'").alias("local"), at("kind = 'signup'").alias("remote"), at("kind = 'view' AND sequence % 2 = 0").alias("base"), at("kind = 'click' AND sequence % 3 = 0").alias("synced_local"), at("kind = 'signup' AND sequence % 3 <> 0").alias("synced_remote"))
    never = F.col("workspace") % 5 == 0
    return h.select("workspace", "local", F.when(F.col("workspace") % 11 != 0, F.col("remote")).alias("remote"), "base", *(F.when(~never, F.col(c)).alias(c) for c in ("synced_local", "synced_remote")))


_HEADS_SQL = """
heads AS (
  SELECT workspace, max(k) FILTER (kind = 'click') AS local, CASE WHEN workspace % 11 <> 0 THEN max(k) FILTER (kind = 'signup') END AS remote, max(k) FILTER (kind = 'view' AND sequence % 2 = 0) AS base,
         CASE WHEN workspace % 5 <> 0 THEN max(k) FILTER (kind = 'click' AND sequence % 3 = 0) END AS synced_local, CASE WHEN workspace % 5 <> 0 THEN max(k) FILTER (kind = 'signup' AND sequence % 3 <> 0) END AS synced_remote
  FROM timeline GROUP BY workspace)"""


def sync_dispositions(spark: SparkSession, sf: str) -> DataFrame:
    h = _heads(spark, sf)
    return h.select("workspace", logs.sync_disposition(F.col("local"), F.col("remote"), F.col("base"), F.col("synced_local"), F.col("synced_remote"), F.col("workspace") % 7 == 0).alias("disposition"))


def follow_decisions(spark: SparkSession, sf: str) -> DataFrame:
    h = _heads(spark, sf)
    return h.select("workspace", logs.follow_decision(F.col("local"), F.col("remote"), F.col("synced_local"), F.col("synced_remote")).alias("decision"))


def leases(spark: SparkSession, sf: str) -> DataFrame:
    t = timeline(spark, sf)
    held = t.where("kind = 'signup'").groupBy("k").agg(F.max_by("workspace", "sequence").alias("owner"), (F.max("sealed_at") + 3600).alias("expires_at"))
    asks = t.where("kind = 'purchase'").select("sequence", "k", "workspace", (F.col("sequence") % 17 == 0).alias("takeover"))
    return asks.join(held, "k", "left").select("sequence", F.coalesce(logs.lease_allows(F.col("owner"), F.col("workspace"), F.col("expires_at"), NOW - 86400, F.col("takeover")), F.lit(False)).alias("allowed"))


_R = f"WITH {TIMELINE_SQL}, {_RETAINED_SQL.format(now=NOW, pins=PINS)}"
_H = f"WITH {HISTORY_SQL}, {_RETAINED_SQL.format(now=LATER, pins=PINS)}"
_H3 = f"WITH {HISTORY_SQL.replace('o_custkey AS', 'o_custkey % 3 AS')}, {_RETAINED_SQL.format(now=LATER, pins=PINS)}"
_T = f"WITH {TIMELINE_SQL}"
_RANGES = ", ranges AS (SELECT workspace, min(sequence) AS first, max(sequence) AS last, count(*) AS n FROM (SELECT workspace, sequence, sequence - row_number() OVER (PARTITION BY workspace ORDER BY sequence) AS g FROM retained) GROUP BY workspace, g)"

_SHOWN = "CASE WHEN {n} >= 1099511627776 THEN printf('%.1f TiB', {n} / 1099511627776.0) WHEN {n} >= 1073741824 THEN printf('%.1f GiB', {n} / 1073741824.0) WHEN {n} >= 1048576 THEN printf('%.1f MiB', {n} / 1048576.0) WHEN {n} >= 1024 THEN printf('%.1f KiB', {n} / 1024.0) ELSE {n} || ' B' END"

QUERIES = {
    "retention_counts": (retention_counts, f"{_R} SELECT workspace, tier, count(*) AS n, max(sequence) AS newest FROM retained GROUP BY 1, 2"),
    "retention_rows": (retention_rows, f"{_H} SELECT * FROM retained"),
    "retention_ranges": (retention_ranges, f"{_H3} {_RANGES} SELECT * FROM ranges"),
    "retention_totals": (retention_totals, f"{_R} SELECT workspace, total, retained, total - retained AS thinned FROM (SELECT workspace, count(*) AS total FROM timeline GROUP BY 1) LEFT JOIN (SELECT workspace, count(*) AS retained FROM retained GROUP BY 1) USING (workspace)"),
    "retention_ranges_valid": (ranges_valid, f"{_R} {_RANGES} SELECT workspace, count(*) AS n_ranges, count(*) FILTER (b >= first - 1) AS n_overlaps FROM (SELECT *, lag(last) OVER (PARTITION BY workspace ORDER BY first) AS b FROM ranges) GROUP BY 1"),
    "log_chain_breaks": (chain_breaks, f"{_T} SELECT workspace, sequence FROM timeline t WHERE sequence % 501 = 0 AND EXISTS (SELECT 1 FROM timeline u WHERE u.workspace = t.workspace AND u.sequence < t.sequence)"),
    "log_skip_repeats": (skip_repeats, f"{_T} SELECT workspace, count(*) AS appended, sum(sequence)::BIGINT AS checksum FROM (SELECT *, lag(snapshot_id) OVER (PARTITION BY workspace ORDER BY sequence) AS b FROM timeline) WHERE b IS DISTINCT FROM snapshot_id GROUP BY 1"),
    "timeline_recent": (timeline_recent, f"{_T} SELECT workspace, sequence, sealed_at, kind FROM timeline ORDER BY sequence DESC LIMIT 20"),
    "timeline_pins": (timeline_pins, f"{_T} SELECT workspace, {PINS} AS pinned, count(*) AS n, max(sealed_at) AS newest FROM timeline GROUP BY 1, 2"),
    "timeline_recent_of_ranges": (recent_of_ranges, f"{_R} SELECT DISTINCT sequence FROM retained ORDER BY 1 DESC LIMIT 50"),
    "log_event_page": (event_page, f"{_T} SELECT sequence, kind, 'family:' || sequence AS cursor FROM timeline WHERE sequence > 1000 ORDER BY sequence LIMIT 100"),
    "log_cursor_codec": (cursor_codec, f"{_T} SELECT sequence, CASE WHEN sequence % 3 <> 0 AND sequence % 5 <> 0 THEN sequence END AS parsed FROM timeline"),
    "log_cursor_state": (cursor_state, f"{_T}, b AS (SELECT greatest(min(sequence), max(sequence) - {KEPT_EVENTS} + 1) AS lo, max(sequence) AS hi FROM timeline) SELECT c::BIGINT AS cursor, CASE WHEN c < lo - 1 THEN 'expired' WHEN c > hi THEN 'unknown' ELSE 'found' END AS state FROM b, unnest([0, 400, 500, 501, 900, 1000000000]) AS t(c)"),
    "log_fork_updates": (fork_updates, f"""{_T}, r AS (SELECT *, row_number() OVER (ORDER BY sequence) AS up, row_number() OVER (ORDER BY sequence DESC) AS down FROM timeline)
SELECT 'first' AS asked, sequence, kind, true AS cursor_found FROM r WHERE up BETWEEN 2 AND 6 UNION ALL SELECT 'unknown', sequence, kind, false FROM r WHERE down <= 5 UNION ALL SELECT 'none', sequence, kind, true FROM r WHERE down = 1"""),
    "log_positional_get": (positional_get, f"{_T} SELECT sequence, workspace, kind FROM timeline WHERE sequence BETWEEN 0 AND 399 AND sequence % 7 = 0"),
    "log_last_match": (last_match, f"{_T} SELECT kind, arg_max(workspace, sequence) AS workspace, max(sequence) AS sequence FROM timeline WHERE k % 2 = 0 GROUP BY 1"),
    "gc_byte_masks": (byte_masks, f"{_T} SELECT (CASE WHEN sequence % 211 = 0 OR age < 0 THEN 255 ELSE 71 + CASE WHEN age <= 2592000 THEN 32 ELSE 0 END + CASE WHEN age <= 259200 THEN 24 ELSE 0 END + CASE WHEN age <= 86400 THEN 128 ELSE 0 END END)::INT AS mask, count(*) AS n, min(sealed_at) AS oldest FROM (SELECT *, {NOW} - sealed_at AS age FROM timeline) GROUP BY 1"),
    "budget_status": (budget_status, f"SELECT workspace, used, greatest(used - 1500000, 0) AS over, greatest(1500000 - used, 0) AS free, used > 1500000 AS exceeded, {_SHOWN.format(n='used')} AS shown, available, CASE WHEN available < 300000 THEN 300000 - available ELSE 0 END AS below_reserved, used <= 1500000 AND available >= 300000 AS satisfied FROM (SELECT *, greatest(3000000 - used - workspace % 7 * 250000, 0) AS available FROM (SELECT o_custkey AS workspace, sum(floor(o_totalprice)::BIGINT)::BIGINT AS used FROM orders GROUP BY 1))"),
    "budget_backoff": (budget_backoff, f"""WITH RECURSIVE {TIMELINE_SQL.strip()},
r AS (SELECT workspace, sequence, k * 8 AS used, sealed_at AS t0, k % 5 = 0 AS satisfied, row_number() OVER (PARTITION BY workspace ORDER BY sequence) AS i FROM timeline),
w AS (
  SELECT workspace, sequence, i, true AS tried, CASE WHEN NOT satisfied THEN used END AS lu, CASE WHEN NOT satisfied THEN t0 END AS la FROM r WHERE i = 1
  UNION ALL
  SELECT workspace, sequence, i, t, CASE WHEN NOT t THEN lu WHEN NOT satisfied THEN used END, CASE WHEN NOT t THEN la WHEN NOT satisfied THEN t0 END
  FROM (SELECT r.*, w.lu, w.la, (w.lu IS NULL OR r.used >= w.lu + 64 OR r.t0 - w.la >= 86400) AS t FROM w JOIN r ON r.workspace = w.workspace AND r.i = w.i + 1))
SELECT workspace, count(*) AS tries, max(sequence) AS last FROM w WHERE tried GROUP BY 1"""),
    "value_byte_sizes": (byte_sizes, f"SELECT p_partkey, {_SHOWN.format(n='n')} AS shown, CASE p_partkey % 5 WHEN 0 THEN m WHEN 1 THEN m * 1024 WHEN 2 THEN m * 1048576 WHEN 3 THEN m * 1073741824 END::BIGINT AS parsed FROM (SELECT p_partkey, p_partkey * p_partkey * 997 AS n, p_partkey % 1000 AS m FROM part)"),
    "value_digests": (digests, f"{_T} SELECT sequence, sha256('snapshot' || chr(0) || sequence) AS object_id, substr(sha256('conflict' || chr(0) || workspace || chr(0) || kind || chr(0)), 1, 32) AS digest_id FROM timeline"),
    "value_labels": (labels, "SELECT conv_id, turn, 'agent=' || role || ' turn=' || turn AS label, role AS agent, turn AS parsed_turn FROM conversations"),
    "value_prefix_resolution": (prefix_resolution, f"{_T}, ids AS (SELECT DISTINCT snapshot_id AS s FROM timeline), w AS (SELECT substr(s, 1, 8) AS prefix FROM ids UNION SELECT substr(s, 1, 5) FROM ids UNION SELECT 'zz' || substr(s, 1, 8) FROM ids) SELECT prefix, CASE WHEN length(prefix) < 8 THEN 'too_short' ELSE CASE (SELECT count(*) FROM ids WHERE starts_with(s, prefix)) WHEN 0 THEN 'unknown' WHEN 1 THEN 'found' ELSE 'ambiguous' END END AS state FROM w"),
    "kv_latest": (kv_latest, f"{_T} SELECT workspace, k, sequence, kind FROM (SELECT *, row_number() OVER (PARTITION BY workspace, k ORDER BY sequence DESC) AS rn FROM timeline) WHERE rn = 1 AND kind <> 'error'"),
    "sync_dispositions": (sync_dispositions, f"""{_T}, {_HEADS_SQL},
moves AS (SELECT *, base = local OR (base = synced_remote AND synced_local = local) AS onward FROM heads)
SELECT workspace, CASE WHEN local IS NOT DISTINCT FROM remote THEN 'up_to_date' WHEN onward THEN 'fast_forwarded' WHEN workspace % 7 = 0 THEN 'bootstrapped' ELSE 'diverged' END AS disposition FROM moves"""),
    "sync_follow_decisions": (follow_decisions, f"""{_T}, {_HEADS_SQL}
SELECT workspace, 'publish' AS decision FROM heads WHERE remote IS NULL
UNION ALL SELECT workspace, CASE WHEN local = remote THEN 'idle' ELSE 'pull' END FROM heads WHERE remote IS NOT NULL AND synced_remote IS NULL
UNION ALL SELECT workspace, CASE WHEN synced_remote <> remote THEN 'pull' WHEN synced_local IS NOT DISTINCT FROM local THEN 'idle' ELSE 'publish' END FROM heads WHERE remote IS NOT NULL AND synced_remote IS NOT NULL"""),
    "sync_leases": (leases, f"{_T} SELECT a.sequence, coalesce(h.owner IS NULL OR h.owner = a.workspace OR h.expires_at <= {NOW - 86400} OR a.sequence % 17 = 0, false) AS allowed FROM timeline a LEFT JOIN (SELECT k, arg_max(workspace, sequence) AS owner, max(sealed_at) + 3600 AS expires_at FROM timeline WHERE kind = 'signup' GROUP BY 1) h USING (k) WHERE a.kind = 'purchase'"),
}
