"""Append-only logs: pages by key, cursors, latest values, leases, sync decisions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def page(log: DataFrame, after: int, limit: int, key: str = "sequence") -> DataFrame:
    """The next ``limit`` rows after a key, by key: a top-k, not a sort of the log."""
    return log.where(F.col(key) > after).orderBy(key).limit(limit)


def newest(log: DataFrame, limit: int, key: str = "sequence") -> DataFrame:
    return log.orderBy(F.col(key).desc()).limit(limit)


def updates_after(log: DataFrame, cursor_id: str | None, limit: int) -> DataFrame:
    """``log(sequence, snapshot_id, ...)``: rows after the last row with this id, oldest first up to ``limit``; for an unknown id the newest ``limit``, without one the head only.

    Adds cursor_found.
    """
    if cursor_id is None:
        return newest(log, 1).withColumn("cursor_found", F.lit(True))
    at = log.where(F.col("snapshot_id") == cursor_id).agg(F.max("sequence")).first()[0]  # one number
    if at is None:
        return newest(log, limit).withColumn("cursor_found", F.lit(False))
    return page(log, at, limit).withColumn("cursor_found", F.lit(True))


def latest_values(log: DataFrame, keys: list[str], tombstone: Column, order: str = "sequence") -> DataFrame:
    """Last row of every key, without keys whose last row is a tombstone."""
    rest = [c for c in log.columns if c not in keys]
    last = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("v"))
    return last.select(*keys, "v.*").where(~tombstone)


def sync_disposition(local: Column, remote: Column, base: Column, prior_local: Column, prior_remote: Column, bootstrap: Column) -> Column:
    """What a pull does, by root trees: up_to_date, fast_forwarded, bootstrapped or diverged.

    ``base`` is the tree that the remote snapshot was built on, ``prior_*`` the trees of the last sync (null before the first).
    """
    forward = (base == local) | ((base == prior_remote) & (prior_local == local))
    return F.when(local.eqNullSafe(remote), "up_to_date").when(F.coalesce(forward, F.lit(False)), "fast_forwarded").when(bootstrap, "bootstrapped").otherwise("diverged")


def follow_decision(local: Column, remote: Column, synced_local: Column, synced_remote: Column) -> Column:
    """What a follower does next, by root trees: publish to an empty remote or one that stayed, idle if neither side moved, else pull, which judges for itself."""
    first = synced_remote.isNull()
    idle = (~first & (synced_remote == remote) & synced_local.eqNullSafe(local)) | (first & (local == remote))
    return F.when(remote.isNull(), "publish").when(F.coalesce(idle, F.lit(False)), "idle").when(F.coalesce(synced_remote == remote, F.lit(False)), "publish").otherwise("pull")


RETRY_GROWTH, RETRY_AFTER = 64 << 20, 86_400  # fixed values: bytes and seconds


def pressure_tries(log: DataFrame, growth: int = RETRY_GROWTH, after: int = RETRY_AFTER) -> DataFrame:
    """``log(workspace, sequence, used, at, satisfied)`` to the rows where freeing space is tried: workspace, sequence.

    The last try that did not satisfy is remembered; the next comes with ``growth`` more bytes than it saw or ``after`` seconds later.
    A try that satisfies is forgotten.  Rows depend on each other in their order, so they come sorted by workspace, and a task keeps one try.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at: object = None
        last: tuple[int, int] | None = None
        for pdf in batches:
            out = []
            for w, s, used, when, satisfied in zip(*(pdf[c].tolist() for c in ("workspace", "sequence", "used", "at", "satisfied")), strict=True):
                if w != at:
                    at, last = w, None
                if last is None or used >= last[0] + growth or when - last[1] >= after:
                    out.append((w, s))
                    last = None if satisfied else (used, when)
            yield pd.DataFrame(out, columns=["workspace", "sequence"]).astype("int64")

    rows = log.select("workspace", "sequence", "used", "at", "satisfied").repartition("workspace").sortWithinPartitions("workspace", "sequence")
    return rows.mapInPandas(walk, "workspace long, sequence long")


def last_leases(log: DataFrame) -> DataFrame:
    """``log(key, workspace, sequence, at, ttl)`` of asks to each holder's last lease: key, workspace, expires_at, begun (how many leases it had).

    A lease is not prolonged by asking again; an ask at its end or later begins the next.  Asks depend on each other in
    their order, so they come sorted by holder, and a task keeps one lease.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["key", "workspace", "expires_at", "begun"]
        now: list | None = None
        for pdf in batches:
            out = []
            for key, w, at, ttl in zip(*(pdf[c].tolist() for c in ("key", "workspace", "at", "ttl")), strict=True):
                if now is None or now[:2] != [key, w]:
                    if now is not None:
                        out.append(tuple(now))
                    now = [key, w, at + ttl, 1]
                elif at >= now[2]:
                    now[2:] = [at + ttl, now[3] + 1]
            yield pd.DataFrame(out, columns=names)
        if now is not None:
            yield pd.DataFrame([tuple(now)], columns=names)

    asks = log.select("key", "workspace", "sequence", "at", "ttl").repartition("key", "workspace").sortWithinPartitions("key", "workspace", "sequence")
    return asks.mapInPandas(walk, "key string, workspace long, expires_at long, begun long")


def lease_allows(owner: Column, asks: Column, expires_at: Column, now: int, takeover: Column) -> Column:
    """A writer lease lets its owner in, and others when it is free, has expired or is taken over."""
    return owner.isNull() | (owner == asks) | (expires_at <= now) | takeover
