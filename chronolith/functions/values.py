"""Scalar values: digests, byte sizes, cursors, masks, saturating arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import CLASSES

DAY, HOUR, WEEK = 86_400, 3_600, 604_800
UNITS = ("B", "KiB", "MiB", "GiB", "TiB")  # fixed values
SUFFIXES = {"": 0, "b": 0, "k": 1, "kb": 1, "kib": 1, "m": 2, "mb": 2, "mib": 2, "g": 3, "gb": 3, "gib": 3, "t": 4, "tb": 4, "tib": 4}  # fixed values


def object_id(kind: str, content: Column) -> Column:
    """Identity of an object: digest of its kind and content."""
    return F.sha2(F.concat(F.lit(f"{kind}\0"), content.cast("string")), 256)


def digest_id(domain: str, *parts: Column) -> Column:
    """Sixteen bytes in hexadecimal over a domain and parts, each ended by a zero byte."""
    return F.substring(F.sha2(F.concat(F.lit(f"{domain}\0"), *(x for p in parts for x in (p.cast("string"), F.lit("\0")))), 256), 1, 32)


def human_bytes(n: Column) -> Column:
    """Binary units with one decimal from KiB on."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for i, u in list(enumerate(UNITS))[1:]:
        out = F.when(n >= 1024**i, F.concat(F.format_string("%.1f", F.bround(n.cast("double") / 1024**i, 1)), F.lit(f" {u}"))).otherwise(out)
    return out


def parse_bytes(text: Column) -> Column:
    """Bytes of a number with an optional unit, base 1024; null if it is neither, or more than a long holds."""
    t = F.trim(text)
    digits = F.regexp_extract(t, r"^(\d*)", 1)
    suffix = F.lower(F.trim(F.substring(t, F.length(digits) + 1, F.length(t))))
    factor = F.element_at(F.create_map(*(F.lit(x) for s, k in SUFFIXES.items() for x in (s, 1024**k))), suffix)
    return F.try_multiply(digits.try_cast("long"), factor.cast("long"))


def bucket(seconds: Column, width: int) -> Column:
    """Floor division, also below zero."""
    return F.floor(seconds / F.lit(width)).cast("long")


def saturating_sub(a: Column, b: Column) -> Column:
    return F.greatest(a - b, F.lit(0))


def saturating_add(a: Column, b: Column) -> Column:
    """The sum, or the greatest long where that is too small."""
    return F.coalesce(F.try_add(a.cast("long"), b.cast("long")), F.when(a.isNotNull() & b.isNotNull(), F.lit(2**63 - 1)))


def ceil_div(a: Column, n: int) -> Column:
    return F.floor((a + F.lit(n - 1)) / F.lit(n)).cast("long")


def byte_mask(now: int, sealed_at: Column, exact: Column) -> Column:
    """Content classes whose bytes a snapshot of this age keeps, as bits; all of them for an exact root or one from the future."""
    age = F.lit(now) - sealed_at
    # fixed values: how many days the bytes of a class are kept
    bit = {c: 1 << i for i, c in enumerate(CLASSES)}
    mask = F.lit(bit["source"] | bit["vcs-meta"] | bit["config-secret"] | bit["lockfile"])
    for days, names in ((30, ("database",)), (3, ("dependency", "build-output")), (1, ("scratch",))):
        mask = mask + F.when(age <= days * DAY, sum(bit[n] for n in names)).otherwise(0)
    return F.when(exact | (age < 0), (1 << len(CLASSES)) - 1).otherwise(mask)


def cursor(family: Column, sequence: Column) -> Column:
    return F.concat(family, F.lit(":"), sequence.cast("string"))


def cursor_sequence(text: Column, family: str) -> Column:
    """The sequence of a cursor of this family, after its last colon; null for other families and for what is no cursor."""
    tail = F.substring_index(text, ":", -1)
    own = text == F.concat(F.lit(f"{family}:"), tail)
    return F.when(own & tail.rlike(r"^\+?\d+$"), tail.try_cast("long"))
