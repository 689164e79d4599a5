"""Path expressions: ancestors, depth, selection, content classes, glob patterns. All are built-in expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Content classes in the order of their bits, and the names that decide them.
CLASSES = ("source", "vcs-meta", "config-secret", "dependency", "build-output", "database", "lockfile", "scratch")
VCS = (".git", ".jj")
SECRET_DIRS = (".ssh", ".gnupg")
SECRET_NAMES = (".env", "id_rsa", "id_ed25519", "id_ecdsa")
SECRET_ENDS = (".pem", ".key", ".p12", ".pfx")
LOCKFILES = ("Cargo.lock", "package-lock.json", "pnpm-lock.yaml", "yarn.lock", "bun.lock", "bun.lockb", "poetry.lock", "Pipfile.lock", "go.sum", "composer.lock", "Gemfile.lock")
DATABASE_ENDS = (".sqlite", ".sqlite3", ".db", ".sqlite-wal", ".sqlite-shm", ".sqlite3-wal", ".sqlite3-shm", ".db-wal", ".db-shm")
DEPENDENCY_DIRS = ("node_modules", ".venv", "venv", "vendor", ".pnpm")
BUILD_DIRS = ("target", "dist", "build", ".next", ".nuxt", ".turbo", ".parcel-cache", "coverage", "out")
BUILD_ENDS = (".o", ".obj", ".class", ".pyc")
SCRATCH_DIRS = ("tmp", "temp", "logs", "log", ".cache", "__pycache__")
SCRATCH_ENDS = (".log", ".tmp", ".swp", ".swo", "~")
CACHE_CLASSES = {
    "node_modules": "javascript_dependencies", ".next": "frontend_cache", ".nuxt": "frontend_cache", ".parcel-cache": "frontend_cache",
    ".turbo": "frontend_cache", ".vite": "frontend_cache", ".venv": "python_cache", "venv": "python_cache", "__pycache__": "python_cache",
}


def components(path: Column) -> Column:
    return F.split(path, "/")


def name_of(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_of(path: Column) -> Column:
    """The directory that holds a path; empty at the top."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def depth_of(path: Column) -> Column:
    return F.size(components(path))


def ancestors(path: Column) -> Column:
    """All directories above a path, from the top; none for a path at the top."""
    parts = components(path)
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))


def self_and_ancestors(path: Column) -> Column:
    parts = components(path)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def with_ancestors(df: DataFrame, path: str = "path", alias: str = "above", inclusive: bool = False) -> DataFrame:
    """A row for each ancestor: it turns prefix joins into equi-joins, at the price of a path's depth."""
    return df.withColumn(alias, F.explode((self_and_ancestors if inclusive else ancestors)(F.col(path))))


def is_descendant(path: Column, ancestor: Column) -> Column:
    return F.startswith(path, F.concat(ancestor, F.lit("/")))


def _under(parts: Column, names: tuple[str, ...]) -> Column:
    return F.arrays_overlap(parts, F.array(*map(F.lit, names)))


def _ends(name: Column, ends: tuple[str, ...]) -> Column:
    return name.rlike("(" + "|".join(map(re.escape, ends)) + ")$")


def classify(path: Column) -> Column:
    """Content class by the first rule that holds; an empty path is source."""
    parts = F.filter(components(path), lambda c: c != "")
    name = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))
    return (
        F.when(_under(parts, VCS), "vcs-meta")
        .when(_under(parts, SECRET_DIRS) | name.isin(*SECRET_NAMES) | F.startswith(name, F.lit(".env.")) | _ends(name, SECRET_ENDS), "config-secret")
        .when(name.isin(*LOCKFILES), "lockfile")
        .when(_ends(name, DATABASE_ENDS), "database")
        .when(_under(parts, DEPENDENCY_DIRS) | F.exists(parts, lambda c: F.endswith(c, F.lit("site-packages"))), "dependency")
        .when(_under(parts, BUILD_DIRS) | _ends(name, BUILD_ENDS), "build-output")
        .when(_under(parts, SCRATCH_DIRS) | F.startswith(name, F.lit(".#")) | _ends(name, SCRATCH_ENDS), "scratch")
        .otherwise("source")
    )


def class_bit(content_class: Column) -> Column:
    return F.element_at(F.create_map(*(x for i, c in enumerate(CLASSES) for x in (F.lit(c), F.lit(1 << i)))), content_class)


def recovery_route(content_class: Column) -> Column:
    return (
        F.when(content_class.isin("dependency", "build-output", "scratch"), "regenerate-or-fetch")
        .when(content_class == "database", "replica-or-database-backup")
        .otherwise("replica-or-none")
    )


def cache_class(path: Column, sibling_manifest: Column) -> Column:
    """Class of a directory that can be made again; ``target`` only beside a build manifest."""
    name = name_of(path)
    known = F.element_at(F.create_map(*(F.lit(x) for kv in CACHE_CLASSES.items() for x in kv)), name)
    return F.coalesce(known, F.when((name == "target") & sibling_manifest, "rust_build_cache"))


def _class_end(pattern: str, at: int) -> int | None:
    """Where the class that begins at ``at`` ends; None if it is empty or open, and the bracket stands for itself."""
    begin = at + 1 + (pattern[at + 1 : at + 2] in ("!", "^"))
    end = pattern.find("]", begin)
    return end if end > begin else None


def _class_regex(body: str) -> str:
    negated, items, i = body[0] in "!^", [], 0
    body = body[1:] if negated else body
    while i < len(body):
        if body[i + 1 : i + 2] == "-" and i + 2 < len(body):
            if body[i] <= body[i + 2]:  # a range that runs backwards holds nothing
                items.append(f"\\x{{{ord(body[i]):x}}}-\\x{{{ord(body[i + 2]):x}}}")
            i += 3
        else:
            items.append(f"\\x{{{ord(body[i]):x}}}")
            i += 1
    if not items:
        return "[^/]" if negated else "(?!)"
    return f"(?!/)[{'^' * negated}{''.join(items)}]"


def glob_to_regex(pattern: str) -> str:
    """A glob as a regular expression of the JVM: ``*`` and ``?`` stay in a component, ``**`` crosses, ``[!a]`` negates, an open or empty ``[`` is itself."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[" and (end := _class_end(pattern, i)) is not None:
            out.append(_class_regex(pattern[i + 1 : end]))
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return "(?s)^" + "".join(out) + "$"


def _code_point(char: Column) -> Column:
    return F.concat(F.lit("\\x{"), F.lower(F.hex(F.ascii(char))), F.lit("}"))


def _class_column(token: Column) -> Column:
    """``_class_regex`` of a bracket with what it holds."""
    negated = token.rlike(r"^\[[!^]")
    body = F.regexp_extract(token, r"(?s)^\[[!^]?(.*)\]$", 1)
    low, high = lambda i: F.substring(i, 1, 1), lambda i: F.substring(i, 3, 1)
    item = lambda i: F.when(F.length(i) == 1, _code_point(i)).when(low(i) <= high(i), F.concat(_code_point(low(i)), F.lit("-"), _code_point(high(i)))).otherwise("")
    items = F.array_join(F.transform(F.regexp_extract_all(body, F.lit("(?s)(.-.|.)"), 1), item), "")
    some = F.concat(F.lit("(?!/)["), F.when(negated, "^").otherwise(""), items, F.lit("]"))
    return F.when(items != "", some).when(negated, "[^/]").otherwise("(?!)")


def glob_column(pattern: Column) -> Column:
    """``glob_to_regex`` of a column, by built-in expressions: no task starts Python for a few patterns."""
    tokens = F.regexp_extract_all(pattern, F.lit(r"(?s)(\*\*|\[[!^]?+[^\]]+\]|.)"), 1)
    one = lambda c: F.when(c == "**", ".*").when(c == "*", "[^/]*").when(c == "?", "[^/]").when(F.length(c) > 1, _class_column(c)).otherwise(_code_point(c))
    return F.concat(F.lit("(?s)^"), F.array_join(F.transform(tokens, one), ""), F.lit("$"))


def literal_prefix(pattern: Column) -> Column:
    """Leading components without wildcards."""
    parts = components(pattern)
    first = F.array_position(F.transform(parts, lambda c: c.rlike(r"[*?\[]")), True)
    return F.when(first == 0, parts).otherwise(F.slice(parts, 1, F.greatest(first - 1, F.lit(0)).cast("int")))


def may_overlap(a: Column, b: Column) -> Column:
    """Whether two patterns may match one path: literals by equality, else one literal prefix leads the other."""
    wild = lambda p: p.rlike(r"[*?\[]")
    pa, pb = literal_prefix(a), literal_prefix(b)
    n = F.least(F.size(pa), F.size(pb))
    lead = F.when(n == 0, True).otherwise(F.slice(pa, 1, F.greatest(n, F.lit(1))) == F.slice(pb, 1, F.greatest(n, F.lit(1))))
    return F.when(~wild(a) & ~wild(b), a == b).otherwise(lead)
