"""Queries over what a store is asked and told: scopes kept up to date, forks, lookups, bundles, compaction, pins, names, previews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import paths as P
from ..operators import chunks as C
from ..operators import diff as D
from ..operators import reach as G
from ..operators import scopes as S
from ..operators import store as T
from ..sources.shared import shared_folder, shared_table
from .model import CHUNKS_SQL, EDGES_SQL, PROJECT_DIRS, PROJECT_NAMES, chunks, edges, leaves, table, tree, tree_sql
from .states import RULES, _CLASS_SQL, _diff_sql, _in_rules, _qs

#: Which parts a state has, and the version of their content; p is the part's key.
HAS = {"base": "p % 5 <> 0", "prev": "p % 5 <> 0 OR p % 4 = 0", "head": "p % 6 <> 0 AND p % 17 <> 3"}
CHANGED = {"base": "0", "prev": "CASE WHEN p % 4 = 0 THEN 1 ELSE 0 END", "head": "CASE WHEN p % 3 = 0 THEN 1 ELSE 0 END"}
#: Parts whose file became a directory, with a file in it.
FLIPPED = {"base": "false", "prev": "p % 16 = 3", "head": "p % 8 = 3"}


def _state(spark: SparkSession, sf: str, side: str) -> DataFrame:
    """A project tree of a side: path, kind, target, mode, size, class."""
    pick = lambda xs, n: F.element_at(F.array(*map(F.lit, xs)), (F.col("p") % n + 1).cast("int"))
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("p"), F.col("p_size").cast("long").alias("size")).where(HAS[side])
    path = F.concat_ws("/", F.concat(F.lit("proj"), (F.col("p") % 7).cast("string")), pick(PROJECT_DIRS, len(PROJECT_DIRS)), F.concat(F.lit("d"), F.col("p").cast("string")), pick(PROJECT_NAMES, len(PROJECT_NAMES)))
    p = p.select("p", path.alias("path"), (F.col("size") + F.expr(CHANGED[side])).alias("size"), F.expr(FLIPPED[side]).alias("flipped"))
    files = p.select(F.when(F.col("flipped"), F.concat("path", F.lit("/inner.rs"))).otherwise(F.col("path")).alias("path"), "size")
    dirs = P.with_ancestors(files.select("path")).select(F.col("above").alias("path")).distinct()
    mode = F.when((F.lit(side) == "head") & (F.length("path") % 9 == 0), 448).otherwise(493)
    every = files.select("path", F.lit("File").alias("kind"), F.col("size").cast("string").alias("target"), F.lit(420).alias("mode"), "size").unionByName(
        dirs.select("path", F.lit("Directory").alias("kind"), F.lit(None).cast("string").alias("target"), mode.alias("mode"), F.lit(0).cast("long").alias("size"))
    )
    return every.withColumn("class", P.classify(F.col("path")))


def _states(spark: SparkSession, sf: str, *sides: str) -> list[DataFrame]:
    """States that several steps read: each is made and classified once, and written."""
    return [shared_table(_state(spark, sf, s), s) for s in sides]


def _state_sql(*sides: str) -> str:
    """The states as common table expressions {side}(path, kind, target, mode, size, class), without WITH."""
    out = []
    for s in sides:
        out.append(f"""
{s}_f AS (
  SELECT path || CASE WHEN {FLIPPED[s]} THEN '/inner.rs' ELSE '' END AS path, sz + ({CHANGED[s]}) AS size
  FROM (SELECT p_partkey AS p, p_size::BIGINT AS sz, 'proj' || (p_partkey % 7) || '/' || ([{_qs(PROJECT_DIRS)}])[p_partkey % {len(PROJECT_DIRS)} + 1] || '/d' || p_partkey || '/' || ([{_qs(PROJECT_NAMES)}])[p_partkey % {len(PROJECT_NAMES)} + 1] AS path FROM part) WHERE {HAS[s]}),
{s}_e AS (
  SELECT path, 'File' AS kind, size::VARCHAR AS target, 420 AS mode, size FROM {s}_f
  UNION ALL SELECT DISTINCT d, 'Directory', NULL, CASE WHEN '{s}' = 'head' AND length(d) % 9 = 0 THEN 448 ELSE 493 END, 0
  FROM (SELECT array_to_string(string_split(path, '/')[1 : unnest(range(1, len(string_split(path, '/'))))], '/') AS d FROM {s}_f))""")
    paths = " UNION ".join(f"SELECT path FROM {s}_e" for s in sides)
    out.append(f" paths AS ({paths})")
    out.append(_CLASS_SQL)
    out += [f" {s} AS (SELECT e.*, c.class FROM {s}_e e JOIN classed c USING (path))" for s in sides]
    return ",".join(out)


_RELEVANT = "('source', 'config-secret', 'database', 'lockfile')"


def _visited_sql(a: str, b: str, name: str) -> str:
    return f"""
{name}_j AS (
  SELECT coalesce(l.path, r.path) AS path, coalesce(l.kind = 'Directory', false) <> coalesce(r.kind = 'Directory', false) AS broken,
         l.path IS NULL OR r.path IS NULL OR l.kind <> r.kind OR l.mode <> r.mode OR l.size <> r.size OR l.class <> r.class OR l.target IS DISTINCT FROM r.target AS differs
  FROM {a} l FULL JOIN {b} r ON l.path = r.path),
{name} AS (SELECT path FROM {name}_j j WHERE differs AND NOT EXISTS (SELECT 1 FROM {name}_j x WHERE x.broken AND x.differs AND starts_with(j.path, x.path || '/')))"""


def _recompute_sql(paths: str, name: str) -> str:
    """The cases one by one, each from its own words."""
    return f"""
{name}_p AS (
  SELECT v.path, l.kind AS lk, r.kind AS rk, coalesce(l.class IN {_RELEVANT}, false) AS lr, coalesce(r.class IN {_RELEVANT}, false) AS rr, l.mode AS lm, r.mode AS rm, l.class AS lc, r.class AS rc, l.target AS lt, r.target AS rt, l.size AS ls, r.size AS rs
  FROM {paths} v LEFT JOIN base l ON l.path = v.path LEFT JOIN head r ON r.path = v.path WHERE NOT regexp_matches(v.path, '^\\.(git|chronolith)(/|$)')),
{name}_new AS (SELECT path, rr FROM {name}_p WHERE lk IS NULL AND rk = 'Directory'),
{name}_leaf AS (SELECT n.path AS above, h.path FROM {name}_new n JOIN head h ON starts_with(h.path, n.path || '/') WHERE h.kind <> 'Directory' AND h.class IN {_RELEVANT}),
{name} AS (
  SELECT path, 0 AS scope, 'modify' AS action FROM {name}_p WHERE lk = 'Directory' AND rk = 'Directory' AND (lm <> rm OR lc <> rc) AND rr
  UNION SELECT path, 1, 'delete' FROM {name}_p WHERE lk = 'Directory' AND rk IS NULL AND lr
  UNION SELECT path, 1, 'modify' FROM {name}_p WHERE lk IS NOT NULL AND rk IS NOT NULL AND (lk = 'Directory') <> (rk = 'Directory') AND (lr OR rr)
  UNION SELECT path, 0, 'modify' FROM {name}_p WHERE lk <> 'Directory' AND rk <> 'Directory' AND (lk <> rk OR lm <> rm OR lc <> rc OR lt <> rt OR ls <> rs) AND (lr OR rr)
  UNION SELECT path, 0, 'delete' FROM {name}_p WHERE lk <> 'Directory' AND rk IS NULL AND lr
  UNION SELECT path, 0, 'add' FROM {name}_p WHERE lk IS NULL AND rk <> 'Directory' AND rr
  UNION SELECT path, 0, 'add' FROM {name}_leaf
  UNION SELECT path, 0, 'add' FROM {name}_new WHERE rr AND path NOT IN (SELECT above FROM {name}_leaf))"""


def radar_scopes(spark: SparkSession, sf: str) -> DataFrame:
    return S.observe(*_states(spark, sf, "base", "head"))


def radar_observe(spark: SparkSession, sf: str) -> DataFrame:
    """Scopes of the head, from those of the head before and what changed since."""
    base, prev, head = _states(spark, sf, "base", "prev", "head")
    return S.observe(base, head, prev, S.observe(base, prev))


def _forks(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    d = c.select(
        F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.md5(F.col("c_custkey").cast("string"))).alias("fork_id"), F.col("c_name").alias("name"),
        F.sha2(F.col("c_nationkey").cast("string"), 256).alias("base_snapshot"), F.floor(F.col("c_acctbal") / 100).cast("long").alias("created_at"),
    )
    return T.with_fork_ids(d)


_FORKS_SQL = """
forks AS (
  SELECT CASE WHEN c_custkey % 3 = 0 THEN substr(sha256('legacy-fork' || chr(0) || c_name || chr(0) || sha256(c_nationkey::VARCHAR)), 1, 32) ELSE md5(c_custkey::VARCHAR) END AS fork_id,
         c_name AS name, floor(c_acctbal / 100)::BIGINT AS created_at FROM customer)"""


def fork_list(spark: SparkSession, sf: str) -> DataFrame:
    """The first page of forks: newest first, then by name."""
    return _forks(spark, sf).orderBy(*T.fork_order()).limit(100).select("fork_id", "name", "created_at")


def fork_lookup(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").where("c_custkey % 10 = 1")
    asked = c.select(F.col("c_name").alias("wanted")).unionByName(c.select(F.md5(F.col("c_custkey").cast("string")).alias("wanted"))).unionByName(c.select(F.concat(F.lit("no "), "c_name").alias("wanted")))
    return T.find_forks(_forks(spark, sf), asked)


def tree_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Entries of one state at the paths that another has changed, with misses."""
    base, ours = tree(spark, sf, "base"), tree(spark, sf, "ours")
    return T.entries_at(ours, D.diff(base, ours)).select("path", "found", "kind", "size")


def rewind_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Entries that a rewind needs, against a target that has lost some."""
    base, ours = tree(spark, sf, "base"), tree(spark, sf, "ours")
    return T.entries_for_plan(base.where("size % 10 <> 3"), D.rewind_plan(ours, base)).groupBy("action", "verdict").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


def snapshot_transition(spark: SparkSession, sf: str) -> DataFrame:
    base, ours = tree(spark, sf, "base"), tree(spark, sf, "ours")
    rules = [spark.createDataFrame([(r,) for r in rs], "path string") for rs in (RULES[:2], RULES[2:])]
    return T.transition(ours, base, *rules).groupBy("action", "new_kind").agg(F.count("*").alias("n"))


def captured_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Changed paths that a capture looks at, some of which are control state or excluded."""
    p = leaves(spark, sf, "base")
    changed = p.select(F.when(F.col("k") % 9 == 0, F.concat(F.lit(f"{N.CONTROL}/"), F.col("k").cast("string"))).otherwise(F.col("path")).alias("path"))
    kept = T.captured_paths(changed, spark.createDataFrame([(r,) for r in RULES], "path string"))
    return kept.groupBy(F.substring_index("path", "/", 1).alias("top")).agg(F.count("*").alias("n"))


def preview(spark: SparkSession, sf: str) -> DataFrame:
    plan = D.rewind_plan(tree(spark, sf, "ours"), tree(spark, sf, "base"))
    return T.preview_digest(plan, "rewind", "target", "current")


def _objects(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("node"), F.floor("o_totalprice").cast("long").alias("len"))
    return o.select(F.sha2("node", 256).alias("id"), "node", "len")


def bundle_export(spark: SparkSession, sf: str) -> DataFrame:
    """What a bundle of the objects below one customer holds, read back from where it was written."""
    roots = table(spark, sf, "customer").where("c_custkey % 7 = 3").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"))
    reached = G.reach(roots, edges(spark, sf)).where("node LIKE 'o%'").select("node")
    folder = shared_folder(spark, "bundle")
    n = T.export_bundle(reached, _objects(spark, sf).select(F.col("node").alias("id"), "len"), folder)
    return spark.read.parquet(folder).agg(F.count("*").alias("objects"), F.sum("len").alias("bytes"), F.min("id").alias("first")).withColumn("counted", F.lit(n).cast("long"))


def gc_compact(spark: SparkSession, sf: str) -> DataFrame:
    """Where live objects lie after compaction, as the published version of the catalog tells."""
    objects = _objects(spark, sf)
    live = objects.where("len % 3 <> 0").select(F.col("id").alias("node"))
    folder = shared_folder(spark, "catalog")
    T.publish(objects.select("id", "len", F.lit(0).cast("long").alias("offset")), folder, "pack")
    T.publish(T.compacted(objects, live), folder, "pack")
    return T.published(spark, folder, "pack")


def pins_after(spark: SparkSession, sf: str) -> DataFrame:
    """Pins after some more are asked for and some are taken back; only whole snapshots can be pinned."""
    c = chunks(spark, sf)
    grades = C.grade(c, c.where("stored")).select(F.col("blob").alias("sequence"), "grade")
    d = table(spark, sf, "documents").select((F.col("doc_id") % 5).alias("workspace"), F.col("doc_id").alias("sequence"))
    after, refused = T.pin(d.where("sequence % 20 = 0"), d.where("sequence % 4 = 0").unionByName(d.where("sequence % 8 = 0")), grades)
    after = T.unpin(after, d.where("sequence % 12 = 0"))
    return after.groupBy("workspace").agg(F.count("*").alias("n")).withColumn("what", F.lit("pinned")).unionByName(refused.groupBy("workspace").agg(F.count("*").alias("n")).withColumn("what", F.lit("refused")))


def name_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """One made-up name for each part, as a pattern, an owner, a rule, a fork and a remote head."""
    k, n = F.col("p_partkey"), F.col("p_name")
    made = F.when(k % 11 == 0, F.concat(F.lit("/"), n)).when(k % 13 == 0, "").when(k % 17 == 0, F.concat(n, F.lit("\u0007"))).when(k % 19 == 0, F.repeat(n, 120)).when(k % 23 == 0, F.concat(n, F.lit("/../x"))).when(k % 29 == 0, F.lit(".git/x")).when(k % 31 == 0, F.lit("..")).when(k % 37 == 0, F.lit("a//b")).otherwise(F.concat(F.lit("n"), k.cast("string")))
    p = table(spark, sf, "part").select("p_partkey", made.alias("name"))
    c = F.col("name")
    v = p.select(N.pattern_verdict(c).alias("pattern"), N.owner_verdict(c).alias("owner"), N.rule_verdict(c).alias("rule"), N.fork_name_verdict(c).alias("fork"), N.ref_verdict(c).alias("ref"))
    return v.groupBy("pattern", "owner", "rule", "fork", "ref").agg(F.count("*").alias("n"))


def name_ids(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    text = F.when(k % 3 == 0, F.upper(F.sha2(k.cast("string"), 256))).when(k % 3 == 1, F.md5(k.cast("string"))).otherwise(F.sha2(k.cast("string"), 256))
    return p.select("p_partkey", N.parsed_id(text).alias("id"), N.keyed_id("secret", "remote-id", k).alias("remote_id"), N.trigger_name(k % 20).alias("trigger"), N.subtree_intersects(F.concat(F.lit("a"), (k % 4).cast("string")), ("a1/b", "a2")).alias("intersects"))


def control_sets(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    top = F.element_at(F.array(*map(F.lit, (".git", N.CONTROL, f"{N.CONTROL}/policy", ".github", "src"))), (k % 5 + 1).cast("int"))
    c = table(spark, sf, "part").select(F.when(k % 2 == 0, top).otherwise(F.concat(top, F.lit("/x"))).alias("path"))
    return c.groupBy("path").agg(F.count("*").alias("n")).select("path", "n", N.merge_allowed(F.col("path")).alias("merged"), N.radar_ignored(F.col("path")).alias("ignored"), N.is_identity(F.col("path")).alias("identity"))


def dirty_order(spark: SparkSession, sf: str) -> DataFrame:
    """Directories that a change makes dirty, in the order in which they are hashed: deepest first, then by descending path; a page of them."""
    changed = D.diff(tree(spark, sf, "base"), tree(spark, sf, "ours")).where("coalesce(new_kind, old_kind) <> 'Directory'")
    dirs = P.with_ancestors(changed.select("path")).select(F.col("above").alias("path")).distinct().withColumn("depth", P.depth_of(F.col("path")))
    return dirs.orderBy(F.col("depth").desc(), F.col("path").desc()).limit(200)


def claim_order(spark: SparkSession, sf: str) -> DataFrame:
    """Claims as they are listed, by pattern, owner and id, and where each came in: by creation and id."""
    from pyspark.sql import Window as W

    c = table(spark, sf, "orders").select(F.concat(F.col("o_orderpriority"), F.lit("/**")).alias("pattern"), (F.col("o_custkey") % 50).alias("owner"), F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 7).alias("created_at"))
    c = c.withColumn("came", F.row_number().over(W.partitionBy("owner").orderBy("created_at", "id")))
    return c.orderBy("pattern", "owner", "id").limit(300).select("pattern", "owner", "id", "came")


def tree_pages(spark: SparkSession, sf: str) -> DataFrame:
    t = leaves(spark, sf, "base").select(P.parent_of(F.col("path")).alias("dir"), P.name_of(F.col("path")).alias("name"), (F.octet_length(P.name_of(F.col("path"))) + 100).cast("long").alias("size"))
    return T.pages(t, 1000)


_BO = f"WITH {tree_sql('base', 'ours')}"
_PLAN = f"{_BO}, {_diff_sql('ours', 'base')}, plan AS (SELECT path, CASE action WHEN 'add' THEN 'restore' WHEN 'delete' THEN 'remove' ELSE 'replace' END AS action FROM d)"
_MADE = """(SELECT p_partkey AS k, CASE WHEN p_partkey % 11 = 0 THEN '/' || p_name WHEN p_partkey % 13 = 0 THEN '' WHEN p_partkey % 17 = 0 THEN p_name || chr(7) WHEN p_partkey % 19 = 0 THEN repeat(p_name, 120)
  WHEN p_partkey % 23 = 0 THEN p_name || '/../x' WHEN p_partkey % 29 = 0 THEN '.git/x' WHEN p_partkey % 31 = 0 THEN '..' WHEN p_partkey % 37 = 0 THEN 'a//b' ELSE 'n' || p_partkey END AS s FROM part)"""
_UNSAFE = "len(list_filter(string_split(s, '/'), lambda c: c IN ('', '.', '..'))) > 0"
_OBJ = "objects AS (SELECT sha256('o' || o_orderkey) AS id, 'o' || o_orderkey AS node, floor(o_totalprice)::BIGINT AS len FROM orders)"

QUERIES = {
    "radar_scopes": (radar_scopes, f"WITH {_state_sql('base', 'head')}, {_visited_sql('base', 'head', 'v')}, {_recompute_sql('v', 'n')} SELECT path, scope, action FROM n"),
    "radar_observe": (radar_observe, f"""WITH {_state_sql('base', 'prev', 'head')}, {_visited_sql('base', 'prev', 'v0')}, {_recompute_sql('v0', 's0').replace('JOIN head ', 'JOIN prev ')}, {_visited_sql('prev', 'head', 'v1')}, {_recompute_sql('v1', 'n1')},
seen AS (SELECT v.path, coalesce(l.kind = 'Directory', false) <> coalesce(r.kind = 'Directory', false) AS whole FROM v1 v LEFT JOIN base l ON l.path = v.path LEFT JOIN head r ON r.path = v.path)
SELECT path, scope, action FROM n1
UNION ALL SELECT path, scope, action FROM s0 s WHERE NOT EXISTS (SELECT 1 FROM seen a WHERE a.path = s.path OR a.whole AND starts_with(s.path, a.path || '/')) AND NOT EXISTS (SELECT 1 FROM n1 n WHERE n.path = s.path AND n.scope = s.scope)"""),
    "fork_list": (fork_list, f"WITH {_FORKS_SQL} SELECT * FROM forks ORDER BY created_at DESC, name LIMIT 100"),
    "fork_lookup": (fork_lookup, f"WITH {_FORKS_SQL}, a AS (SELECT unnest([c_name, md5(c_custkey::VARCHAR), 'no ' || c_name]) AS wanted FROM customer WHERE c_custkey % 10 = 1) SELECT wanted, fork_id, name FROM a LEFT JOIN forks f ON f.name = wanted OR f.fork_id = wanted"),
    "tree_lookup": (tree_lookup, f"{_BO}, {_diff_sql('base', 'ours')} SELECT path, o.path IS NOT NULL AS found, o.kind, o.size FROM d LEFT JOIN ours o USING (path)"),
    "rewind_entries": (rewind_entries, f"{_PLAN} SELECT action, CASE WHEN b.path IS NULL THEN 'missing' ELSE 'present' END AS verdict, count(*) AS n, sum(size)::BIGINT AS bytes FROM plan LEFT JOIN (SELECT * FROM base WHERE size % 10 <> 3) b USING (path) WHERE action <> 'remove' GROUP BY 1, 2"),
    "snapshot_transition": (snapshot_transition, f"{_BO}, {_diff_sql('ours', 'base')} SELECT action, new_kind, count(*) AS n FROM d WHERE NOT {_in_rules(RULES)} GROUP BY 1, 2"),
    "captured_changes": (captured_changes, f"WITH {tree_sql('base', dirs=False)} SELECT p AS top, count(*) AS n FROM base_files WHERE k % 9 <> 0 AND NOT {_in_rules(RULES)} GROUP BY 1"),
    "preview_digest": (preview, f"{_PLAN}, parts AS (SELECT substr(sha256(path), 1, 4) AS part, sha256(string_agg(action || chr(0) || path, chr(10) ORDER BY action || chr(0) || path)) AS digest, count(*) AS n FROM plan GROUP BY 1) SELECT sha256('rewind' || chr(0) || 'target' || chr(0) || 'current' || chr(0) || string_agg(digest, '' ORDER BY part)) AS digest, sum(n)::BIGINT AS changes FROM parts"),
    "bundle_export": (bundle_export, "SELECT count(*) AS objects, sum(floor(o_totalprice)::BIGINT)::BIGINT AS bytes, min('o' || o_orderkey) AS first, count(*) AS counted FROM orders WHERE o_custkey % 7 = 3"),
    "gc_compact": (gc_compact, f'WITH {_OBJ} SELECT id, len, (sum(len + 82) OVER (ORDER BY id) - len - 82)::BIGINT AS "offset" FROM objects WHERE len % 3 <> 0'),
    "pins_after": (pins_after, f"""WITH {CHUNKS_SQL}, store AS (SELECT DISTINCT chunk_id FROM chunks WHERE stored), g AS (SELECT blob, bool_and(chunk_id IN (SELECT chunk_id FROM store)) AS exact FROM chunks GROUP BY 1),
p AS (SELECT doc_id % 5 AS workspace, doc_id, doc_id % 20 = 0 AS was, doc_id % 4 = 0 AS asked, doc_id % 12 = 0 AS back, coalesce(exact, false) AS exact FROM documents LEFT JOIN g ON blob = doc_id)
SELECT workspace, count(*) AS n, 'pinned' AS what FROM p WHERE (was OR asked AND exact) AND NOT back GROUP BY 1 UNION ALL SELECT workspace, count(*), 'refused' FROM p WHERE asked AND NOT exact GROUP BY 1"""),
    "name_verdicts": (name_verdicts, f"""SELECT CASE WHEN s = '' THEN 'empty' WHEN strlen(s) > 1024 THEN 'too_long' WHEN starts_with(s, '/') THEN 'absolute' WHEN contains(s, chr(7)) THEN 'control' WHEN {_UNSAFE} THEN 'unsafe_component' ELSE 'valid' END AS pattern,
CASE WHEN s = '' THEN 'empty' WHEN strlen(s) > 256 THEN 'too_long' WHEN contains(s, chr(7)) THEN 'control' ELSE 'valid' END AS owner,
CASE WHEN s = '' THEN 'empty' WHEN starts_with(s, '/') THEN 'absolute' WHEN {_UNSAFE} THEN 'unsafe_component' WHEN s = '.git' OR starts_with(s, '.git/') THEN 'control_state' ELSE 'valid' END AS rule,
CASE WHEN s = '' THEN 'empty' WHEN strlen(s) > 96 THEN 'too_long' WHEN NOT regexp_full_match(s, '[A-Za-z0-9._-]+') THEN 'character' WHEN s IN ('.', '..') THEN 'dots' ELSE 'valid' END AS fork,
CASE WHEN s = '' THEN 'empty' WHEN strlen(s) > 256 THEN 'too_long' WHEN NOT regexp_full_match(s, '[A-Za-z0-9._/-]+') THEN 'character' WHEN starts_with(s, '/') OR ends_with(s, '/') THEN 'slash' WHEN {_UNSAFE} THEN 'unsafe_component' ELSE 'valid' END AS ref, count(*) AS n
FROM {_MADE} GROUP BY 1, 2, 3, 4, 5"""),
    "name_ids": (name_ids, f"SELECT p_partkey, CASE WHEN p_partkey % 3 <> 1 THEN sha256(p_partkey::VARCHAR) END AS id, sha256('secret' || chr(0) || 'remote-id' || chr(0) || p_partkey) AS remote_id, ([{_qs(N.TRIGGERS)}])[p_partkey % 20 + 1] AS trigger, p_partkey % 4 IN (1, 2) AS intersects FROM part"),
    "control_sets": (control_sets, "SELECT s AS path, count(*) AS n, s NOT IN ('.chronolith', '.git') AND NOT starts_with(s, '.git/') AS merged, regexp_matches(s, '^\\.(git|chronolith)(/|$)') AS ignored, regexp_matches(s, '^\\.chronolith(/|$)') AS identity FROM (SELECT (['.git', '.chronolith', '.chronolith/policy', '.github', 'src'])[p_partkey % 5 + 1] || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE '/x' END AS s FROM part) GROUP BY 1"),
    "dirty_order": (dirty_order, f"{_BO}, {_diff_sql('base', 'ours')}, u AS (SELECT DISTINCT array_to_string(string_split(path, '/')[1 : unnest(range(1, len(string_split(path, '/'))))], '/') AS path FROM d WHERE coalesce(new_kind, old_kind) <> 'Directory') SELECT path, len(string_split(path, '/'))::INT AS depth FROM u ORDER BY 2 DESC, 1 DESC LIMIT 200"),
    "claim_order": (claim_order, "SELECT o_orderpriority || '/**' AS pattern, o_custkey % 50 AS owner, o_orderkey AS id, (row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey % 7, o_orderkey))::INT AS came FROM orders ORDER BY 1, 2, 3 LIMIT 300"),
    "tree_pages": (tree_pages, f"""WITH RECURSIVE {tree_sql('base', dirs=False).strip()},
c AS (SELECT p || '/' || st || '/' || c AS dir, strlen(k::VARCHAR) + 100 AS size, row_number() OVER (PARTITION BY p, st, c ORDER BY k::VARCHAR) AS i FROM base_files),
w AS (SELECT dir, i, 0 AS page, size AS used FROM c WHERE i = 1 UNION ALL SELECT c.dir, c.i, CASE WHEN w.used + c.size > 1000 THEN w.page + 1 ELSE w.page END, CASE WHEN w.used + c.size > 1000 THEN c.size ELSE w.used + c.size END FROM w JOIN c ON c.dir = w.dir AND c.i = w.i + 1)
SELECT dir, page, count(*) AS entries, max(used)::BIGINT AS bytes FROM w GROUP BY 1, 2"""),
}
