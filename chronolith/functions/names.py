"""Names and identities: verdicts of validators, control paths, ids in hexadecimal, keyed ids, trigger names.

Validators tell what is wrong with a row, or ``valid``; a null is ``empty``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CONTROL = ".chronolith"  # the engine's own directory in a workspace
POLICY = f"{CONTROL}/policy"

# Bounds of names, and why snapshots are taken.
MOST_PATTERN, MOST_OWNER, MOST_FORK_NAME, MOST_REF = 1024, 256, 96, 256
TRIGGERS = (
    "initial", "manual", "watcher", "pre_rewind", "fork_base", "agent_run", "merge_source", "pre_merge",
    "merge", "sync_local", "sync_push", "sync_pull", "inspection", "claim", "release", "coord",
)


def _rules(text: Column, *rules: tuple[Column, str]) -> Column:
    out = F.when(text.isNull() | (text == ""), "empty")
    for broken, verdict in rules:
        out = out.when(broken, verdict)
    return out.otherwise("valid")


def _unsafe(text: Column) -> Column:
    """Whether a component is empty, ``.`` or ``..``."""
    return text.rlike(r"(^|/)\.{0,2}(/|$)")


def pattern_verdict(text: Column) -> Column:
    """A claim's pattern: relative, of bounded length, without control characters and unsafe components."""
    return _rules(text, (F.octet_length(text) > MOST_PATTERN, "too_long"), (F.startswith(text, F.lit("/")), "absolute"), (text.rlike(r"\p{Cntrl}"), "control"), (_unsafe(text), "unsafe_component"))


def owner_verdict(text: Column) -> Column:
    return _rules(text, (F.octet_length(text) > MOST_OWNER, "too_long"), (text.rlike(r"\p{Cntrl}"), "control"))


def rule_verdict(text: Column) -> Column:
    """A capture rule: a relative subtree that is no control state."""
    top = F.substring_index(text, "/", 1)
    return _rules(text, (F.startswith(text, F.lit("/")), "absolute"), (F.instr(text, "\0") > 0, "control"), (_unsafe(text), "unsafe_component"), (top.isin(".git", CONTROL) | (text == POLICY), "control_state"))


def family_verdict(text: Column) -> Column:
    return _rules(text, (~text.rlike("^[0-9a-fA-F]{32}$"), "invalid"))


def fork_name_verdict(text: Column) -> Column:
    return _rules(text, (F.octet_length(text) > MOST_FORK_NAME, "too_long"), (~text.rlike("^[A-Za-z0-9._-]+$"), "character"), (text.isin(".", ".."), "dots"))


def ref_verdict(text: Column) -> Column:
    """A remote head's name, which becomes part of storage keys: no way out of its folder."""
    return _rules(text, (F.octet_length(text) > MOST_REF, "too_long"), (~text.rlike("^[A-Za-z0-9._/-]+$"), "character"), (F.startswith(text, F.lit("/")) | F.endswith(text, F.lit("/")), "slash"), (_unsafe(text), "unsafe_component"))


def at_or_below(path: Column, top: str) -> Column:
    return (path == top) | F.startswith(path, F.lit(f"{top}/"))


def merge_allowed(path: Column) -> Column:
    """Paths that merges look at: all but version control and the control directory itself; what is in the latter is merged."""
    return ~((path == CONTROL) | at_or_below(path, ".git"))


def radar_ignored(path: Column) -> Column:
    """Paths that make no conflict: version control and all control state."""
    return at_or_below(path, CONTROL) | at_or_below(path, ".git")


def is_identity(path: Column) -> Column:
    """Paths that say which workspace this is; captures of changes leave them out."""
    return at_or_below(path, CONTROL)


def parsed_id(text: Column) -> Column:
    """An id of 32 bytes in hexadecimal, in lower case; null if it is none."""
    return F.when(text.rlike("^[0-9a-fA-F]{64}$"), F.lower(text))


def lossy_text(content: Column) -> Column:
    """Text of bytes; what is no UTF-8 becomes replacement characters."""
    return F.make_valid_utf8(content.cast("string"))


def keyed_id(key: str, domain: str, value: Column, length: int = 64) -> Column:
    """A digest that only holders of the key can tell: ids and namespaces on remotes."""
    return F.substring(F.sha2(F.concat(F.lit(f"{key}\0{domain}\0"), value.cast("string")), 256), 1, length)


def legacy_fork_id(name: Column, base_snapshot: Column) -> Column:
    """The id of a fork that was described before forks had ids: sixteen bytes over its name and base."""
    return F.substring(F.sha2(F.concat(F.lit("legacy-fork\0"), name, F.lit("\0"), base_snapshot), 256), 1, 32)


def trigger_name(number: Column) -> Column:
    """Name of a snapshot trigger by its number from 0; null for others."""
    return F.get(F.array(*map(F.lit, TRIGGERS)), number.cast("int"))


def subtree_intersects(path: Column, selections: tuple[str, ...]) -> Column:
    """Whether a path lies at or below a selection, or a selection at or below the path; no selections select everything."""
    if not selections:
        return F.lit(True)
    meets = [at_or_below(path, s) | F.startswith(F.lit(f"{s}/"), F.concat(path, F.lit("/"))) for s in selections]
    out = meets[0]
    for m in meets[1:]:
        out = out | m
    return out
