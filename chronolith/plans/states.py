"""Queries over tree states: paths, diffs, merges, usage, roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators import diff as D
from ..operators import merge as M
from ..operators import trees as T
from ..operators.retention import with_previous
from .model import PATHS_SQL, leaves, project_paths, table, tree, tree_sql

RULES = ("1-URGENT/F", "2-HIGH/O/7", "5-LOW", "3-MEDIUM/P/1")
SELECTION = ("1-URGENT", "2-HIGH/F/3")
GLOBS = ("proj*/src/**", "**/*.py", "proj?/.git/*/main.rs", "proj[0-2]/**", "proj[!0-2]/docs/**", "proj1/*", "**/[ab].*")


def _rules(spark: SparkSession, rules: tuple[str, ...]) -> DataFrame:
    return spark.createDataFrame([(r,) for r in rules], "path string")


def path_ancestors(spark: SparkSession, sf: str) -> DataFrame:
    files = leaves(spark, sf, "base")
    return P.with_ancestors(files).groupBy(F.col("above").alias("dir")).agg(F.count("*").alias("files")).select("dir", "files", P.depth_of(F.col("dir")).alias("depth"), P.parent_of(F.col("dir")).alias("parent"))


def path_classes(spark: SparkSession, sf: str) -> DataFrame:
    p = project_paths(spark, sf).withColumn("class", P.classify(F.col("path")))
    return p.groupBy("class").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).select("class", "n", "bytes", P.recovery_route(F.col("class")).alias("route"), P.class_bit(F.col("class")).alias("bit"))


def path_globs(spark: SparkSession, sf: str) -> DataFrame:
    """One scan: a count for each pattern, then a row for each."""
    counts = project_paths(spark, sf).agg(*(F.count_if(F.col("path").rlike(P.glob_to_regex(g))).alias(f"n{i}") for i, g in enumerate(GLOBS)))
    rows = F.array(*(F.struct(F.lit(g).alias("pattern"), F.col(f"n{i}").alias("n")) for i, g in enumerate(GLOBS)))
    return counts.select(F.inline(rows))


def path_policy(spark: SparkSession, sf: str) -> DataFrame:
    """Entries that no exclusion rule holds back, by kind; rules are few and sorted out by equi-join on ancestors."""
    kept = T.without_subtrees(tree(spark, sf, "base"), _rules(spark, RULES))
    return kept.groupBy("kind").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


def path_selection(spark: SparkSession, sf: str) -> DataFrame:
    return T.only_subtrees(tree(spark, sf, "base"), _rules(spark, SELECTION)).select("path", "kind", "size")


def path_control(spark: SparkSession, sf: str) -> DataFrame:
    """Paths that merges, radar and captures leave out, and classes that count for conflicts."""
    p = project_paths(spark, sf).withColumn("class", P.classify(F.col("path")))
    relevant = F.col("class").isin("source", "config-secret", "database", "lockfile")
    return p.groupBy("class", relevant.alias("relevant"), F.array_contains(P.components(F.col("path")), ".git").alias("control")).agg(F.count("*").alias("n"))


def path_urls(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("url")
    tail = F.regexp_replace(u, r"^[a-z]+://[^/]+", "")
    return table(spark, sf, "pages").select(
        "page_id", F.regexp_extract(u, r"^([a-z]+)://", 1).alias("scheme"), F.regexp_extract(u, r"^[a-z]+://([^/?#]+)", 1).alias("host"),
        F.regexp_extract(tail, r"^([^?#]*)", 1).alias("path"), F.regexp_extract(tail, r"\?([^#]*)", 1).alias("query"),
    )


def path_valid(spark: SparkSession, sf: str) -> DataFrame:
    """Relative paths without empty, . or .. components, told with the reason if not."""
    bad = F.when(F.col("k") % 5 == 0, F.concat(F.lit("/"), "path")).when(F.col("k") % 7 == 0, F.concat("path", F.lit("/../x"))).when(F.col("k") % 11 == 0, F.replace("path", F.lit("/"), F.lit("//"))).when(F.col("k") % 13 == 0, "").otherwise(F.col("path"))
    p = leaves(spark, sf, "base").select("k", bad.alias("path"))
    parts = P.components(F.col("path"))
    why = F.when(F.col("path") == "", "empty").when(F.startswith("path", F.lit("/")), "absolute").when(F.arrays_overlap(parts, F.array(F.lit("."), F.lit(".."))), "dots").when(F.array_contains(parts, ""), "empty_component").otherwise("valid")
    return p.groupBy(why.alias("verdict")).agg(F.count("*").alias("n"))


def diff_rows(spark: SparkSession, sf: str) -> DataFrame:
    return D.diff(tree(spark, sf, "base"), tree(spark, sf, "ours"))


def diff_semantic(spark: SparkSession, sf: str) -> DataFrame:
    return D.diff(tree(spark, sf, "base"), tree(spark, sf, "ours"), D.MERGE).groupBy("action", "old_kind", "new_kind").agg(F.count("*").alias("n"))


def diff_order(spark: SparkSession, sf: str) -> DataFrame:
    """Depth-first place and byte-order place of changed paths; the places are of a report, not of the data."""
    d = D.diff(tree(spark, sf, "base"), tree(spark, sf, "theirs")).where("action = 'delete' AND old_kind = 'File'").withColumn("dir", P.parent_of(F.col("path")))
    w = W.partitionBy("dir")
    return d.select("path", F.row_number().over(w.orderBy(P.components(F.col("path")))).alias("tree_place"), F.row_number().over(w.orderBy(F.col("path").cast("binary"))).alias("byte_place"))


def rewind(spark: SparkSession, sf: str) -> DataFrame:
    return D.rewind_plan(tree(spark, sf, "ours"), tree(spark, sf, "base"))


def rewind_verify(spark: SparkSession, sf: str) -> DataFrame:
    base, ours = tree(spark, sf, "base"), tree(spark, sf, "ours")
    return D.verify(D.rewind_plan(ours, base), ours.where("size % 10 <> 0"), ours)


def merge_changes(spark: SparkSession, sf: str) -> DataFrame:
    return M.merge(*(tree(spark, sf, s) for s in ("base", "ours", "theirs")))[0]


def merge_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return M.merge(*(tree(spark, sf, s) for s in ("base", "ours", "theirs")))[1]


def merge_summary(spark: SparkSession, sf: str) -> DataFrame:
    changes, conflicts = M.merge(*(tree(spark, sf, s) for s in ("base", "ours", "theirs")))
    return changes.groupBy(F.col("action").alias("what")).agg(F.count("*").alias("n")).unionByName(conflicts.groupBy(F.col("kind").alias("what")).agg(F.count("*").alias("n")))


def tree_usage(spark: SparkSession, sf: str) -> DataFrame:
    return T.usage(tree(spark, sf, "theirs"))


def tree_estimate(spark: SparkSession, sf: str) -> DataFrame:
    """What a capture would take, under rules of which some lie below others and some name nothing."""
    rules = spark.createDataFrame([(r,) for r in (*RULES, "1-URGENT/F/7", "5-LOW/O", "none/such")], "path string")
    return T.estimate(tree(spark, sf, "theirs"), rules)


def tree_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return T.rollup(leaves(spark, sf, "ours"))


def tree_merkle(spark: SparkSession, sf: str) -> DataFrame:
    return T.merkle(leaves(spark, sf, "base"))


def tree_shrink(spark: SparkSession, sf: str) -> DataFrame:
    return T.shrink_candidates(project_paths(spark, sf).select("path", "size"))


def tree_remove(spark: SparkSession, sf: str) -> DataFrame:
    return T.without_subtrees(tree(spark, sf, "ours"), _rules(spark, SELECTION)).groupBy("kind").agg(F.count("*").alias("n"))


def tree_children(spark: SparkSession, sf: str) -> DataFrame:
    t = tree(spark, sf, "base").where(P.parent_of(F.col("path")) == "1-URGENT/F")
    return t.where("path > '1-URGENT/F/3'").orderBy(F.col("path").cast("binary")).limit(25).select("path", "kind")


def tree_same(spark: SparkSession, sf: str) -> DataFrame:
    return D.same_state(tree(spark, sf, "base").drop("mtime"), tree(spark, sf, "ours").drop("mtime")).groupBy("side", "kind").agg(F.count("*").alias("n"))


def tree_sorted_unique(spark: SparkSession, sf: str) -> DataFrame:
    """Names of a directory in the order in which they were pushed: those that don't follow the one before are faults."""
    t = leaves(spark, sf, "base").select("k", P.parent_of(F.col("path")).alias("parent"), F.when(F.col("k") % 10 == 0, "same").otherwise(P.name_of(F.col("path"))).alias("name"))
    t = with_previous(t, ["parent"], "k", {"before": "name"})
    return t.groupBy("parent").agg(F.count("*").alias("entries"), F.count_if(F.col("before") >= F.col("name")).alias("out_of_order"))


def tree_cache_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Files whose cached metadata still holds, beside those that changed or are new."""
    cache = leaves(spark, sf, "base").select("path", "kind", "mode", "size", "mtime", F.lit(True).alias("cached"))
    now = leaves(spark, sf, "ours")
    hit = now.join(cache, ["path", "kind", "mode", "size", "mtime"], "left").select("path", F.coalesce("cached", F.lit(False)).alias("hit"), "size")
    return hit.groupBy("hit").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


def tree_clone_eligible(spark: SparkSession, sf: str) -> DataFrame:
    base, ours = tree(spark, sf, "base"), tree(spark, sf, "ours")
    return ours.join(D.diff(base, ours).select("path"), "path", "left_anti").groupBy("kind").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


_EQ = lambda x, y, fs, hide: " AND ".join(
    (f"(CASE WHEN {x}.kind <> 'Directory' THEN {x}.target END) IS NOT DISTINCT FROM (CASE WHEN {y}.kind <> 'Directory' THEN {y}.target END)" if f == "target" and hide else f"{x}.{f} IS NOT DISTINCT FROM {y}.{f}") for f in fs
)


def _diff_sql(left: str, right: str, fields: tuple[str, ...] = D.STRICT) -> str:
    return f"""
d AS (
  SELECT coalesce(l.path, r.path) AS path, CASE WHEN l.path IS NULL THEN 'add' WHEN r.path IS NULL THEN 'delete' ELSE 'modify' END AS action, l.kind AS old_kind, r.kind AS new_kind
  FROM {left} l FULL JOIN {right} r ON l.path = r.path
  WHERE NOT ({_EQ('l', 'r', fields, False)} AND l.path IS NOT NULL AND r.path IS NOT NULL)
    AND NOT coalesce(l.kind = 'Directory' AND r.kind = 'Directory' AND {_EQ('l', 'r', fields, True)}, false))"""


_MERGE_SQL = f"""
j AS (
  SELECT coalesce(b.path, o.path, t.path) AS path, b.kind AS bk, o.kind AS ok, t.kind AS tk,
         ((o.path IS NULL) = (t.path IS NULL)) AND {_EQ('o', 't', D.MERGE, True)} AS ot,
         ((b.path IS NULL) = (o.path IS NULL)) AND {_EQ('b', 'o', D.MERGE, True)} AS bo,
         ((b.path IS NULL) = (t.path IS NULL)) AND {_EQ('b', 't', D.MERGE, True)} AS bt
  FROM base b FULL JOIN ours o ON b.path = o.path FULL JOIN theirs t ON t.path = coalesce(b.path, o.path)),
raw AS (SELECT path, CASE WHEN tk IS NULL THEN 'remove' ELSE 'set' END AS action FROM j WHERE NOT ot AND bo),
direct AS (
  SELECT path, CASE WHEN ok IS NULL OR tk IS NULL THEN 'delete_modify' WHEN ok <> tk OR coalesce(bk <> ok, false) THEN 'type' ELSE 'modify_modify' END AS kind
  FROM j WHERE NOT ot AND NOT bo AND NOT bt),
moved AS (SELECT path, bo, bt FROM j WHERE NOT bo OR NOT bt),
anc AS (
  SELECT d.path FROM j d WHERE d.bk = 'Directory' AND NOT d.ot AND coalesce(d.ok = 'Directory', false) <> coalesce(d.tk = 'Directory', false)
    AND EXISTS (SELECT 1 FROM moved m WHERE starts_with(m.path, d.path || '/') AND CASE WHEN coalesce(d.tk = 'Directory', false) THEN NOT m.bt ELSE NOT m.bo END)),
conflicts AS (SELECT * FROM direct UNION ALL SELECT path, 'ancestor' FROM anc WHERE path NOT IN (SELECT path FROM direct)),
changes AS (
  SELECT * FROM raw r WHERE NOT EXISTS (SELECT 1 FROM conflicts c WHERE c.path IN (r.path, regexp_replace(r.path, '/[^/]*$', ''), regexp_replace(r.path, '/[^/]*/[^/]*$', ''), regexp_replace(r.path, '/[^/]*/[^/]*/[^/]*$', ''))))"""

_B, _BO, _BOT = (f"WITH {tree_sql(*s)}" for s in (("base",), ("base", "ours"), ("base", "ours", "theirs")))
_F = f"WITH {tree_sql('base', dirs=False)}"
_in_rules = lambda rules, p="path": "(" + " OR ".join(f"{p} = '{r}' OR starts_with({p}, '{r}/')" for r in rules) + ")"
_comps = "string_split(path, '/')"
_qs = lambda xs: ", ".join(f"'{x}'" for x in xs)
_ends = lambda xs: "(" + " OR ".join(f"ends_with(name, '{x}')" for x in xs) + ")"
_any = lambda xs: f"list_has_any(comps, [{_qs(xs)}])"
_CLASS_SQL = f"""
classed AS (
  SELECT *, CASE WHEN {_any(P.VCS)} THEN 'vcs-meta'
    WHEN {_any(P.SECRET_DIRS)} OR name IN ({_qs(P.SECRET_NAMES)}) OR starts_with(name, '.env.') OR {_ends(P.SECRET_ENDS)} THEN 'config-secret'
    WHEN name IN ({_qs(P.LOCKFILES)}) THEN 'lockfile' WHEN {_ends(P.DATABASE_ENDS)} THEN 'database'
    WHEN {_any(P.DEPENDENCY_DIRS)} OR contains(array_to_string(comps, '/') || '/', 'site-packages/') THEN 'dependency'
    WHEN {_any(P.BUILD_DIRS)} OR {_ends(P.BUILD_ENDS)} THEN 'build-output'
    WHEN {_any(P.SCRATCH_DIRS)} OR starts_with(name, '.#') OR {_ends(P.SCRATCH_ENDS)} THEN 'scratch' ELSE 'source' END AS class
  FROM (SELECT *, string_split(path, '/') AS comps, string_split(path, '/')[-1] AS name FROM paths))"""
_NAME = "regexp_extract(path, '[^/]*$')"
_LINE = f"{_NAME} || chr(9) || kind || chr(9) || id"
_lvl = lambda n, src: f"""p{n} AS (SELECT regexp_replace(path, '/?[^/]*$', '') AS path, sha256({_NAME})[:3] AS page, sha256(string_agg({_LINE}, chr(10) ORDER BY {_LINE})) AS digest, count(*) AS n FROM {src} GROUP BY 1, 2),
m{n} AS (SELECT path, 'Directory' AS kind, sha256(string_agg(digest, '' ORDER BY page)) AS id, sum(n)::BIGINT AS children FROM p{n} GROUP BY 1)"""  # noqa: E731

QUERIES = {
    "path_ancestors": (path_ancestors, f"{_F} SELECT d AS dir, count(*) AS files, len(string_split(d, '/'))::INT AS depth, CASE WHEN contains(d, '/') THEN regexp_replace(d, '/[^/]*$', '') ELSE '' END AS parent FROM (SELECT unnest([p, p || '/' || st, p || '/' || st || '/' || c]) AS d FROM base_files) GROUP BY 1"),
    "path_classes": (path_classes, f"WITH {PATHS_SQL}, {_CLASS_SQL} SELECT class, count(*) AS n, sum(size)::BIGINT AS bytes, CASE WHEN class IN ('dependency', 'build-output', 'scratch') THEN 'regenerate-or-fetch' WHEN class = 'database' THEN 'replica-or-database-backup' ELSE 'replica-or-none' END AS route, CASE class WHEN 'source' THEN 1 WHEN 'vcs-meta' THEN 2 WHEN 'config-secret' THEN 4 WHEN 'dependency' THEN 8 WHEN 'build-output' THEN 16 WHEN 'database' THEN 32 WHEN 'lockfile' THEN 64 ELSE 128 END AS bit FROM classed GROUP BY 1"),
    "path_globs": (path_globs, f"WITH {PATHS_SQL}, q AS (SELECT path, string_split(path, '/') AS c FROM paths) SELECT * FROM (SELECT 'proj*/src/**' AS pattern, count(*) FILTER (c[2] = 'src') AS n FROM q UNION ALL SELECT '**/*.py', count(*) FILTER (ends_with(path, '.py')) FROM q UNION ALL SELECT 'proj?/.git/*/main.rs', count(*) FILTER (c[2] = '.git' AND c[4] = 'main.rs') FROM q UNION ALL SELECT 'proj[0-2]/**', count(*) FILTER (c[1] IN ('proj0', 'proj1', 'proj2')) FROM q UNION ALL SELECT 'proj[!0-2]/docs/**', count(*) FILTER (c[1] NOT IN ('proj0', 'proj1', 'proj2') AND c[2] = 'docs') FROM q UNION ALL SELECT 'proj1/*', 0 UNION ALL SELECT '**/[ab].*', count(*) FILTER (c[4] IN ('a.o', 'b.pyc')) FROM q)"),
    "path_policy": (path_policy, f"{_B} SELECT kind, count(*) AS n, sum(size)::BIGINT AS bytes FROM base WHERE NOT {_in_rules(RULES)} GROUP BY 1"),
    "path_selection": (path_selection, f"{_B} SELECT path, kind, size FROM base WHERE {_in_rules(SELECTION)}"),
    "path_control": (path_control, f"WITH {PATHS_SQL}, {_CLASS_SQL} SELECT class, class IN ('source', 'config-secret', 'database', 'lockfile') AS relevant, list_contains(comps, '.git') AS control, count(*) AS n FROM classed GROUP BY 1, 2, 3"),
    "path_urls": (path_urls, r"SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(regexp_replace(url, '^[a-z]+://[^/]+', ''), '^([^?#]*)', 1) AS path, regexp_extract(url, '\?([^#]*)', 1) AS query FROM pages"),
    "path_valid": (path_valid, f"{_F} SELECT CASE WHEN k % 5 = 0 THEN 'absolute' WHEN k % 7 = 0 THEN 'dots' WHEN k % 11 = 0 THEN 'empty_component' WHEN k % 13 = 0 THEN 'empty' ELSE 'valid' END AS verdict, count(*) AS n FROM base_files GROUP BY 1"),
    "diff_rows": (diff_rows, f"{_BO}, {_diff_sql('base', 'ours')} SELECT * FROM d"),
    "diff_semantic": (diff_semantic, f"{_BO}, {_diff_sql('base', 'ours', D.MERGE)} SELECT action, old_kind, new_kind, count(*) AS n FROM d GROUP BY 1, 2, 3"),
    "diff_order": (diff_order, f"WITH {tree_sql('base', 'theirs')}, {_diff_sql('base', 'theirs')} SELECT path, (row_number() OVER (PARTITION BY regexp_replace(path, '/[^/]*$', '') ORDER BY {_comps}))::INT AS tree_place, (row_number() OVER (PARTITION BY regexp_replace(path, '/[^/]*$', '') ORDER BY encode(path)))::INT AS byte_place FROM d WHERE action = 'delete' AND old_kind = 'File'"),
    "rewind_plan": (rewind, f"{_BO}, {_diff_sql('ours', 'base')} SELECT path, CASE action WHEN 'add' THEN 'restore' WHEN 'delete' THEN 'remove' ELSE 'replace' END AS action, CASE WHEN action = 'delete' THEN 2 WHEN new_kind = 'Directory' THEN 0 ELSE 1 END AS phase, (CASE WHEN action = 'delete' THEN -length(path) ELSE len({_comps}) END)::INT AS rank FROM d"),
    "rewind_verify": (rewind_verify, f"{_BO}, {_diff_sql('ours', 'base')} SELECT d.path FROM d JOIN ours USING (path) WHERE size % 10 = 0"),
    "merge_changes": (merge_changes, f"{_BOT}, {_MERGE_SQL} SELECT * FROM changes"),
    "merge_conflicts": (merge_conflicts, f"{_BOT}, {_MERGE_SQL} SELECT * FROM conflicts"),
    "merge_summary": (merge_summary, f"{_BOT}, {_MERGE_SQL} SELECT action AS what, count(*) AS n FROM changes GROUP BY 1 UNION ALL SELECT kind, count(*) FROM conflicts GROUP BY 1"),
    "tree_usage": (tree_usage, f"WITH {tree_sql('theirs')} SELECT count(*) FILTER (kind = 'File') AS files, count(*) FILTER (kind = 'Directory') + 1 AS directories, count(*) FILTER (kind = 'Symlink') AS symlinks, sum(size)::BIGINT AS logical_bytes, sum(ceil(size / 512.0) * 512)::BIGINT AS physical_bytes FROM theirs"),
    "tree_estimate": (tree_estimate, f"""WITH {tree_sql('theirs')} SELECT count(*) FILTER (kind = 'File') AS files, count(*) FILTER (kind = 'Directory') + 1 AS directories, count(*) FILTER (kind = 'Symlink') AS symlinks, sum(size)::BIGINT AS logical_bytes, sum(ceil(size / 512.0) * 512)::BIGINT AS physical_bytes,
0 AS special_entries, (SELECT count(*) FROM theirs WHERE path IN ({_qs(RULES)})) AS excluded_subtrees, {len(RULES) + 3} AS policy_rules FROM theirs WHERE NOT {_in_rules(RULES)}"""),
    "tree_rollup": (tree_rollup, f"WITH {tree_sql('ours', dirs=False)} SELECT d AS path, count(*) AS entries, sum(size)::BIGINT AS bytes FROM (SELECT unnest([p, p || '/' || st, p || '/' || st || '/' || c]) AS d, size FROM ours_files) GROUP BY 1"),
    "tree_merkle": (tree_merkle, f"{_F}, m4 AS (SELECT path, kind, target AS id FROM base_files), {_lvl(3, 'm4')}, {_lvl(2, 'm3')}, {_lvl(1, 'm2')}, {_lvl(0, 'm1')} SELECT path, id AS tree_id, children FROM m3 UNION ALL SELECT path, id, children FROM m2 UNION ALL SELECT path, id, children FROM m1 UNION ALL SELECT path, id, children FROM m0"),
    "tree_shrink": (tree_shrink, f"WITH {PATHS_SQL}, up AS (SELECT unnest([string_split(path, '/')[1], string_split(path, '/')[1] || '/' || string_split(path, '/')[2], string_split(path, '/')[1] || '/' || string_split(path, '/')[2] || '/' || string_split(path, '/')[3]]) AS path, size FROM paths), s AS (SELECT path, count(*) AS entries, sum(size)::BIGINT AS bytes, string_split(path, '/')[-1] AS name FROM up GROUP BY 1) SELECT path, CASE WHEN name = 'node_modules' THEN 'javascript_dependencies' WHEN name IN ('.next', '.nuxt', '.parcel-cache', '.turbo', '.vite') THEN 'frontend_cache' WHEN name IN ('.venv', 'venv', '__pycache__') THEN 'python_cache' ELSE 'rust_build_cache' END AS cache_class, entries, bytes FROM s WHERE name IN ('node_modules', '.next', '.nuxt', '.parcel-cache', '.turbo', '.vite', '.venv', 'venv', '__pycache__') OR name = 'target' AND regexp_replace(path, '/[^/]*$', '') || '/Cargo.toml' IN (SELECT path FROM paths)"),
    "tree_remove": (tree_remove, f"WITH {tree_sql('ours')} SELECT kind, count(*) AS n FROM ours WHERE NOT {_in_rules(SELECTION)} GROUP BY 1"),
    "tree_children": (tree_children, f"{_B} SELECT path, kind FROM base WHERE regexp_replace(path, '/[^/]*$', '') = '1-URGENT/F' AND path > '1-URGENT/F/3' ORDER BY path LIMIT 25"),
    "tree_same": (tree_same, f"{_BO}, l AS (SELECT kind, mode, path, size, target FROM base), r AS (SELECT kind, mode, path, size, target FROM ours) SELECT 'left' AS side, kind, count(*) AS n FROM (SELECT * FROM l EXCEPT ALL SELECT * FROM r) GROUP BY 2 UNION ALL SELECT 'right', kind, count(*) FROM (SELECT * FROM r EXCEPT ALL SELECT * FROM l) GROUP BY 2"),
    "tree_sorted_unique": (tree_sorted_unique, f"{_F}, n AS (SELECT p || '/' || st || '/' || c AS parent, k, row_number() OVER (PARTITION BY p, st, c ORDER BY k) AS i, CASE WHEN k % 10 = 0 THEN 'same' ELSE k::VARCHAR END AS name FROM base_files) SELECT a.parent, count(*) AS entries, count(*) FILTER (b.name >= a.name) AS out_of_order FROM n a LEFT JOIN n b ON b.parent = a.parent AND b.i = a.i - 1 GROUP BY 1"),
    "tree_cache_hits": (tree_cache_hits, f"WITH {tree_sql('base', 'ours', dirs=False)} SELECT hit, count(*) AS n, sum(size)::BIGINT AS bytes FROM (SELECT o.size, b.path IS NOT NULL AS hit FROM ours_files o LEFT JOIN base_files b ON o.path = b.path AND o.size = b.size AND o.mtime = b.mtime AND o.kind = b.kind) GROUP BY 1"),
    "tree_clone_eligible": (tree_clone_eligible, f"{_BO}, {_diff_sql('base', 'ours')} SELECT kind, count(*) AS n, sum(size)::BIGINT AS bytes FROM ours WHERE path NOT IN (SELECT path FROM d) GROUP BY 1"),
}
