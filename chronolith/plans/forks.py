"""Queries over forks: scopes, pairs, conflicts, members, claims, events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators import radar as R
from .model import TIMELINE_SQL, dirty_scopes, dirty_scopes_by_phase, scopes_sql, timeline

FAMILY = "family"
CLAIMS = (("click/**", 1), ("click/3/*", 2), ("error/1/4", 1), ("error/?/5", 3), ("purchase/**", 4), ("view/*/7", 5), ("signup/2", 6))


def _claims(spark: SparkSession) -> DataFrame:
    rows = F.array(*(F.struct(F.lit(p).alias("pattern"), F.lit(w).alias("workspace")) for p, w in CLAIMS))
    return spark.range(0, 1, 1, 1).select(F.inline(rows))


def radar_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Every overlapping pair of forks: the result itself grows with the square of a path's forks; conflicts and members don't need it."""
    return R.pairs(dirty_scopes(spark, sf))


def radar_members(spark: SparkSession, sf: str) -> DataFrame:
    return R.members(dirty_scopes(spark, sf))


def radar_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    c = R.conflicts(dirty_scopes(spark, sf), _claims(spark))
    return c.select("path", F.sha2("signature", 256).alias("signature"), "claim_state", "forks")


def radar_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Conflicts of a fork, and the first twenty of their paths: by ranks, of which none beyond twenty is kept."""
    m = R.members(dirty_scopes(spark, sf))
    counts = m.groupBy("fork").agg(F.count("*").alias("conflicts"))
    first = m.withColumn("rank", F.row_number().over(W.partitionBy("fork").orderBy("path"))).where("rank <= 20")
    first = first.groupBy("fork").agg(F.array_join(F.sort_array(F.collect_list("path")), ",").alias("first_paths"))
    return counts.join(first, "fork").select("fork", "conflicts", "first_paths")


def radar_claim_states(spark: SparkSession, sf: str) -> DataFrame:
    return R.claim_states(dirty_scopes(spark, sf).select("path"), _claims(spark))


def _phases(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Conflicts of the earlier and of the later state, told together."""
    c = R.conflicts(dirty_scopes_by_phase(spark, sf), _claims(spark), "phase")
    old, new = (c.where(F.col("phase") == phase).drop("phase") for phase in (0, 1))
    return old, new


def radar_events(spark: SparkSession, sf: str) -> DataFrame:
    old, new = _phases(spark, sf)
    e = R.events(old, new, FAMILY)
    return e.select("path", "state", "claim_state", "conflict_id", "event_id")


def radar_events_again(spark: SparkSession, sf: str) -> DataFrame:
    """Telling the same changes again gives no event that the log has; opened ones are kept in it here."""
    old, new = _phases(spark, sf)
    e = R.events(old, new, FAMILY)
    return R.events(old, new, FAMILY, e.where("state = 'opened'")).groupBy("state").agg(F.count("*").alias("n"))


def radar_retained_forks(spark: SparkSession, sf: str) -> DataFrame:
    s = dirty_scopes(spark, sf)
    alive = timeline(spark, sf).where("kind = 'signup'").select(F.col("workspace").alias("fork")).distinct()
    return s.join(alive, "fork", "left_semi").groupBy("scope").agg(F.count("*").alias("n"), F.countDistinct("fork").alias("forks"))


def claim_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    """Claims of other workspaces that may overlap: two literal lists, compared by their literal prefixes."""
    kinds = timeline(spark, sf).select("kind", "k").distinct()
    c = kinds.select(F.concat_ws("/", "kind", "k", F.when(F.col("k") % 2 == 0, "*").otherwise("a")).alias("pattern"), (F.col("k") % 3).cast("long").alias("workspace"))
    held = _claims(spark).select(F.col("pattern").alias("other"), F.col("workspace").cast("long").alias("owner"))
    # the few claims that are held are literal rows
    hit = c.join(F.broadcast(held), F.col("workspace") != F.col("owner")).where(P.may_overlap(F.col("pattern"), F.col("other")))
    return hit.select("pattern", "workspace", "other", "owner")


_S = f"WITH {TIMELINE_SQL}, {scopes_sql()}"
_BOTH = f"WITH {TIMELINE_SQL}, {scopes_sql('s0', 0)}, {scopes_sql('s1', 1)}"


def _pairs_sql(scopes: str, name: str) -> str:
    """Every scope is spread over itself and the paths above it; forks that share an exact path, or a subtree's path, are a pair."""
    return f"""
up AS (
  SELECT fork, path AS own, scope, array_to_string(string_split(path, '/')[1 : unnest(range(1, len(string_split(path, '/')) + 1))], '/') AS above FROM {scopes}),
meets AS (
  SELECT above AS path, s.fork AS one, up.fork AS other, up.own, up.scope AS own_scope FROM up JOIN (SELECT fork, path FROM {scopes} WHERE scope = 1) s ON s.path = up.above WHERE s.fork <> up.fork),
{name} AS (
  SELECT CASE WHEN own_scope = 1 AND other < one THEN own ELSE path END AS path, least(one, other) AS left_id, greatest(one, other) AS right_id FROM meets
  UNION
  SELECT path, left_id, right_id FROM (
    SELECT path, unnest(forks) AS left_id, forks FROM (SELECT path, list_distinct(list(fork)) AS forks FROM {scopes} WHERE scope = 0 GROUP BY path)) g, unnest(g.forks) AS r(right_id)
  WHERE left_id < right_id)"""


def _members_sql(scopes: str, p: str) -> str:
    """Exact scopes by counting forks, the others by their pairs."""
    return f"""
{p}x AS (SELECT path, fork FROM {scopes} WHERE scope = 0 AND path IN (SELECT path FROM {scopes} WHERE scope = 0 GROUP BY path HAVING count(DISTINCT fork) > 1)),
{p}w AS (
  SELECT DISTINCT CASE WHEN d2.scope = 1 AND d2.fork < d1.fork THEN d2.path ELSE d1.path END AS path, d1.fork AS a, d2.fork AS b
  FROM {scopes} d1 JOIN {scopes} d2 ON d1.fork <> d2.fork AND d1.scope = 1 AND split_part(d1.path, '/', 1) = split_part(d2.path, '/', 1) AND split_part(d1.path, '/', 2) = split_part(d2.path, '/', 2)
  WHERE d2.path = d1.path OR starts_with(d2.path, d1.path || '/')),
{p}e AS (SELECT path, fork FROM {p}x UNION SELECT path, a FROM {p}w UNION SELECT path, b FROM {p}w),
{p}p AS (SELECT DISTINCT path FROM {p}e),
{p}m AS (SELECT * FROM {p}e WHERE path NOT IN (SELECT c.path FROM {p}p c JOIN {p}p o ON starts_with(c.path, o.path || '/')))"""


_CLAIM_SQL = """CASE (
  (split_part({p}, '/', 1) = 'click' AND contains({p}, '/') OR {p} = 'error/1/4')::INT + regexp_full_match({p}, 'click/3/[^/]*')::INT
  + regexp_full_match({p}, 'error/[^/]/5')::INT + starts_with({p}, 'purchase/')::INT + regexp_full_match({p}, 'view/[^/]*/7')::INT + ({p} = 'signup/2')::INT)
  WHEN 0 THEN 'unclaimed' WHEN 1 THEN 'covered' ELSE 'contested' END"""


def _conflicts_sql(scopes: str, p: str) -> str:
    return f"""{_members_sql(scopes, p)},
{p}c AS (
  SELECT m.path, string_agg(m.fork || '@' || h.head, ',' ORDER BY m.fork) AS signature, {_CLAIM_SQL.format(p='m.path')} AS claim_state, count(*) AS forks
  FROM {p}m m JOIN (SELECT DISTINCT fork, head FROM {scopes}) h USING (fork) GROUP BY m.path)"""


_EVENTS_SQL = f"""{_BOTH}, {_conflicts_sql('s0', 'o')}, {_conflicts_sql('s1', 'n')},
raw AS (
  SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'opened' WHEN n.path IS NULL THEN 'resolved' ELSE 'updated' END AS state,
         coalesce(n.signature, o.signature) AS signature, CASE WHEN n.path IS NULL THEN o.claim_state ELSE n.claim_state END AS claim_state
  FROM oc o FULL JOIN nc n ON o.path = n.path WHERE o.signature IS DISTINCT FROM n.signature OR o.claim_state IS DISTINCT FROM n.claim_state),
named AS (SELECT *, substr(sha256('conflict' || chr(0) || '{FAMILY}' || chr(0) || path || chr(0)), 1, 32) AS conflict_id FROM raw),
ev AS (SELECT *, substr(sha256('event' || chr(0) || conflict_id || chr(0) || state || chr(0) || signature || chr(0) || claim_state || chr(0)), 1, 32) AS event_id FROM named)"""

QUERIES = {
    "radar_pairs": (radar_pairs, f"{_S}, {_pairs_sql('scopes', 'pairs')} SELECT * FROM pairs"),
    "radar_members": (radar_members, f"{_S}, {_members_sql('scopes', 'x')} SELECT path, fork FROM xm"),
    "radar_conflicts": (radar_conflicts, f"{_S}, {_conflicts_sql('scopes', 'x')} SELECT path, sha256(signature) AS signature, claim_state, forks FROM xc"),
    "radar_summary": (radar_summary, f"{_S}, {_members_sql('scopes', 'x')} SELECT fork, count(*) AS conflicts, array_to_string(list_sort(list(path))[1:20], ',') AS first_paths FROM xm GROUP BY 1"),
    "radar_claim_states": (radar_claim_states, f"{_S} SELECT DISTINCT path, {_CLAIM_SQL.format(p='path')} AS claim_state FROM scopes"),
    "radar_events": (radar_events, f"{_EVENTS_SQL} SELECT path, state, claim_state, conflict_id, event_id FROM ev"),
    "radar_events_again": (radar_events_again, f"{_EVENTS_SQL} SELECT state, count(*) AS n FROM ev WHERE state <> 'opened' GROUP BY 1"),
    "radar_retained_forks": (radar_retained_forks, f"{_S} SELECT scope, count(*) AS n, count(DISTINCT fork) AS forks FROM scopes WHERE fork IN (SELECT workspace FROM timeline WHERE kind = 'signup') GROUP BY 1"),
    "claim_overlaps": (claim_overlaps, f"""WITH {TIMELINE_SQL}, c AS (SELECT DISTINCT kind, k, kind || '/' || k || '/' || CASE WHEN k % 2 = 0 THEN '*' ELSE 'a' END AS pattern, (k % 3)::BIGINT AS workspace FROM timeline),
h(other, owner, p1, p2, p3) AS (VALUES ('click/**', 1::BIGINT, 'click', NULL, NULL), ('click/3/*', 2, 'click', '3', NULL), ('error/1/4', 1, 'error', '1', '4'), ('error/?/5', 3, 'error', NULL, NULL), ('purchase/**', 4, 'purchase', NULL, NULL), ('view/*/7', 5, 'view', NULL, NULL), ('signup/2', 6, 'signup', '2', NULL))
SELECT pattern, workspace, other, owner FROM c JOIN h ON workspace <> owner AND p1 = kind AND coalesce(p2 = k::VARCHAR, true)
WHERE CASE WHEN k % 2 = 0 THEN true ELSE coalesce(p3 = 'a', true) AND other NOT IN ('signup/2') END"""),
}
