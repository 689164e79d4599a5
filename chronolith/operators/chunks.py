"""Chunks: content-defined boundaries, deduplication, estimates, and what is missing where."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SMALLEST, AVERAGE, LARGEST = 64 * 1024, 256 * 1024, 1024 * 1024
_GEAR = np.random.default_rng(9).integers(0, 2**64, 256, dtype=np.uint64)


def boundaries(data: bytes, smallest: int = SMALLEST, average: int = AVERAGE, largest: int = LARGEST) -> list[int]:
    """Ends of content-defined chunks.

    A shifting hash of the last bytes, stricter before the average length than
    after it (one bit in twice the average, then in half of it), so that boundaries
    find back after an insertion.  The hash sums a table's values of the last 64
    bytes, each shifted by its distance; it depends on these alone, so six additions
    of shifted copies make it for all bytes at once.  Boundaries are this engine's own.
    """
    x = _GEAR[np.frombuffer(data, dtype=np.uint8)]
    bits = max(average.bit_length() - 1, 2)
    h = x
    for k in (1, 2, 4, 8, 16, 32):
        if k < len(h):
            h = np.concatenate((h[:k], h[k:] + (h[:-k] << np.uint64(k))))
    top = h >> np.uint64(64 - bits - 1)
    strict, loose = np.flatnonzero(top == 0), np.flatnonzero((top >> np.uint64(2)) == 0)
    ends, start = [], 0
    while start < len(x):
        limit = min(start + largest, len(x))
        middle = min(start + average, limit)
        i = np.searchsorted(strict, start + smallest)
        end = int(strict[i]) + 1 if i < len(strict) and strict[i] < middle else 0
        if not end:
            i = np.searchsorted(loose, max(middle, start + smallest))
            end = int(loose[i]) + 1 if i < len(loose) and loose[i] < limit else limit
        ends.append(end)
        start = end
    return ends


def content_chunks(blobs: DataFrame, smallest: int = SMALLEST, average: int = AVERAGE, largest: int = LARGEST) -> DataFrame:
    """``blobs(blob, content)`` to blob, ordinal, start, len, chunk_id; null content has no chunks."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blob, ordinal, start, size, digest = [], [], [], [], []
            for r in range(len(batch)):
                content = batch.column(1)[r].as_buffer()  # null is no buffer
                if content is None:
                    continue
                data, at = memoryview(content), 0
                for k, end in enumerate(boundaries(data, smallest, average, largest)):
                    blob.append(r)
                    ordinal.append(k)
                    start.append(at)
                    size.append(end - at)
                    digest.append(hashlib.sha256(data[at:end]).hexdigest())
                    at = end
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(blob, pa.int64())), pa.array(ordinal, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(digest, pa.string())],
                names=["blob", "ordinal", "start", "len", "chunk_id"],
            )

    return blobs.select("blob", "content").mapInArrow(cut, "blob long, ordinal int, start long, len long, chunk_id string")


def distinct_chunks(chunks: DataFrame) -> DataFrame:
    """One row for each content: chunk_id, len, refs."""
    return chunks.groupBy("chunk_id").agg(F.max("len").alias("len"), F.count("*").alias("refs"))


def estimate(chunks: DataFrame) -> DataFrame:
    """One row: chunks, distinct chunks, bytes, bytes held already, and bytes that storing would add."""
    one = chunks.groupBy("chunk_id").agg(F.max("len").alias("len"), F.bool_or("stored").alias("present"), F.count("*").alias("refs"))
    return one.agg(
        F.sum("refs").alias("n_chunks"), F.count("*").alias("distinct_chunks"), F.sum(F.col("len") * F.col("refs")).alias("logical_bytes"),
        F.sum("len").alias("unique_bytes"), F.sum(F.when(F.col("present"), F.col("len")).otherwise(0)).alias("held_bytes"),
        F.sum(F.when(~F.col("present"), F.col("len")).otherwise(0)).alias("projected_bytes"),
    )


def grade(chunks: DataFrame, store: DataFrame) -> DataFrame:
    """Per blob whether all its chunks are in ``store(chunk_id)``: blob, grade (exact, partial), missing, missing_bytes."""
    lost = chunks.select("chunk_id").distinct().join(store.select("chunk_id").distinct(), "chunk_id", "left_anti").withColumn("lost", F.lit(1))
    j = chunks.join(lost, "chunk_id", "left").groupBy("blob").agg(F.count("lost").alias("missing"), F.sum(F.when(F.col("lost").isNotNull(), F.col("len")).otherwise(0)).alias("missing_bytes"))
    return j.select("blob", F.when(F.col("missing") == 0, "exact").otherwise("partial").alias("grade"), "missing", "missing_bytes")


def negotiate(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Distinct ids of ``local(chunk_id, len)`` against the ids that a remote has: chunk_id, len, reused."""
    have = remote.select("chunk_id").distinct().withColumn("have", F.lit(True))
    return distinct_chunks(local).join(have, "chunk_id", "left").select("chunk_id", "len", F.coalesce("have", F.lit(False)).alias("reused"))
