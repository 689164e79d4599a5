"""Claims on paths: verdicts on asks, expiry, release and restoration, over ``claims(id, pattern, owner, workspace, created_at, expires_at)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.names import owner_verdict, pattern_verdict
from ..functions.paths import literal_prefix, self_and_ancestors

LONGEST = 7 * 86_400  # fixed value: seconds that a claim may last
HOLDER = ("owner", "workspace")


def active(claims: DataFrame, now: int) -> DataFrame:
    """Claims that have not run out."""
    return claims.where(F.col("expires_at") > now)


def _spread(df: DataFrame) -> DataFrame:
    """A row for each literal directory at or above a pattern, the top as the empty text: above, whether it is the whole literal part (at), whether the pattern has wildcards (wild)."""
    lead = literal_prefix(F.col("pattern"))
    above = F.concat(F.array(F.lit("")), F.when(F.size(lead) > 0, self_and_ancestors(F.array_join(lead, "/"))).otherwise(F.array().cast("array<string>")))
    s = df.withColumn("above", F.explode(above)).withColumn("wild", F.col("pattern").rlike(r"[*?\[]"))
    return s.withColumn("at", F.col("above") == F.array_join(lead, "/"))


def _blockers(asks: DataFrame, held: DataFrame) -> DataFrame:
    """For each asked pattern and holder the earliest claim of somebody else that may match one of its paths.

    Two patterns may meet if the literal part of one is at or above that of the other, two literal ones if they are equal.
    Of all claims that meet a directory in the same way only the earliest two holders' matter to anyone, so no ask meets more.
    """
    kinds = ["above", "wild", "at"]
    claim = F.min(F.struct("created_at", "id", "expires_at")).alias("claim")
    first = _spread(held).groupBy(*kinds, *HOLDER).agg(claim)
    first = first.withColumn("rank", F.row_number().over(W.partitionBy(*kinds).orderBy("claim"))).where("rank <= 2")
    first = first.select("above", *(F.col(c).alias(f"held_{c}") for c in ("wild", "at", *HOLDER)), "claim")
    spread = _spread(asks.select("pattern", *HOLDER).distinct())
    top = F.col("above") == ""
    # the top directory meets every ask: eight rows at most, so they are copied
    met = spread.where(~top).join(first.where(~top), "above").unionByName(spread.where(top).join(F.broadcast(first.where(top)), "above"))
    meets = F.when(F.col("wild") | F.col("held_wild"), F.col("at") | F.col("held_at")).otherwise(F.col("at") & F.col("held_at"))
    other = (F.col("owner") != F.col("held_owner")) | (F.col("workspace") != F.col("held_workspace"))
    return met.where(meets & other).groupBy("pattern", *HOLDER).agg(F.min("claim").alias("claim")).select("pattern", *HOLDER, F.col("claim.id").alias("blocker"))


def verdicts(asks: DataFrame, claims: DataFrame, now: int) -> DataFrame:
    """``asks(pattern, owner, workspace, ttl, ...)`` with verdict, claim_id and expires_at, each judged against the claims in force now.

    ``invalid`` (pattern, owner or time to live), ``held`` (the holder has this claim already, which an ask doesn't prolong; its id),
    ``blocked`` (by the earliest overlapping claim of another holder; its id), or ``granted`` (until now and its time to live).
    """
    key = ["pattern", *HOLDER]
    held = active(claims, now)
    own = held.groupBy(*key).agg(F.min(F.struct("created_at", "id", "expires_at")).alias("own"))
    j = asks.join(own, key, "left").join(_blockers(asks, held), key, "left")
    ttl = F.col("ttl")
    valid = (pattern_verdict(F.col("pattern")) == "valid") & (owner_verdict(F.col("owner")) == "valid") & F.coalesce(ttl.between(1, LONGEST), F.lit(False))
    verdict = F.when(~valid, "invalid").when(F.col("own").isNotNull(), "held").when(F.col("blocker").isNotNull(), "blocked").otherwise("granted")
    j = j.withColumn("verdict", verdict)
    v = F.col("verdict")
    claim_id = F.when(v == "held", F.col("own.id")).when(v == "blocked", F.col("blocker"))
    expires: Column = F.when(v == "held", F.col("own.expires_at")).when(v == "granted", F.lit(now).cast("long") + ttl)
    return j.select(*asks.columns, "verdict", claim_id.alias("claim_id"), expires.alias("expires_at"))


def released(claims: DataFrame, asks: DataFrame) -> DataFrame:
    """Claims that ``asks(selector, owner, workspace)`` let go: a holder's own, by id or by pattern."""
    selectors = F.explode(F.array(F.col("id").cast("string"), F.col("pattern")))
    hit = claims.select("id", *HOLDER, selectors.alias("selector")).join(asks.select("selector", *HOLDER), ["selector", *HOLDER], "left_semi").select("id")
    return claims.join(hit.distinct(), "id", "left_semi")


def restored(claims: DataFrame, saved: DataFrame) -> DataFrame:
    """Claims with those of ``saved`` put back; a saved one takes the place of one with its id."""
    return claims.join(saved.select("id"), "id", "left_anti").unionByName(saved.select(*claims.columns))
