"""Packing token sequences: a configuration linear program over the length histogram, then exact placement.

The histogram of piece lengths (at most ``capacity`` numbers, whatever the
corpus) goes to the driver.  Multiplicative weights solve the configuration LP
over the real lengths: every length has a weight that falls as it is covered,
a knapsack by dynamic programming prices configurations, one that holds each of
the longest uncovered lengths, and a step is taken along each.  Rounding takes
whole copies of the configurations, then single copies of what was cut off as
far as pieces last; what is left over is packed by best fit, all on counts.  The
result is a table of patterns whose size depends on the capacity alone.  Pieces
are numbered within their length by two counts (per bucket, then across buckets)
and find their place by binary search.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import materialize
from .tokens import encoder

CAPACITY, END = 4096, 1
COLUMNS = 256  # configurations that are taken from one pricing
RATE, SHARE = 0.05, 0.25  # how fast a covered length loses weight, and the share of its demand that a step covers at most
LONG = 0.05  # how much more a token of the longest piece weighs at first than one of the shortest, so that short pieces last
#: Per cent of the sequences from rounding, of the emptiest and of those of the shortest pieces, that are dissolved and packed
#: with the rest by best fit: as few as let the plan meet the bound, or else those with the fewest sequences.
GIVEN_BACK = (6, 3), (12, 8), (24, 16)
BUCKET_ROWS = 50_000


def knapsack(sizes: np.ndarray, values: np.ndarray, capacity: int) -> np.ndarray:
    """Most value of an unbounded knapsack, for every capacity up to this one; ``sizes`` ascend and are at least 1."""
    best = np.zeros(capacity + 1)
    upto = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for c in range(int(sizes[0]), capacity + 1):
        best[c] = max(best[c - 1], (values[: upto[c]] + best[c - sizes[: upto[c]]]).max())
    return best


def configuration(seed: int, sizes: np.ndarray, values: np.ndarray, best: np.ndarray, left: np.ndarray) -> dict[int, int]:
    """Items of a sequence of most value that holds item ``seed`` and no more of an item than is left."""
    counts, room, left = {seed: 1}, len(best) - 1 - int(sizes[seed]), left.copy()
    left[seed] -= 1
    while room >= sizes[0]:
        k = int(np.searchsorted(sizes, room, side="right"))
        worth = np.where(left[:k] > 0, values[:k] + best[room - sizes[:k]], -1.0)
        i = int(worth.argmax())
        if worth[i] < 0:
            break
        n = max(1, min(int(left[i]), room // int(sizes[i])) // 4)  # of a short item several at once
        counts[i] = counts.get(i, 0) + n
        left[i] -= n
        room -= n * int(sizes[i])
    return counts


def solve(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[list[tuple[dict[int, int], float]], float]:
    """The covering LP by multiplicative weights: ((items of a sequence, number of such sequences), ...) and a lower bound of its value.

    The bound is the greatest of the dual solutions that sizes and prices make: values
    divided by the most that one sequence can hold.
    """
    left, bound, used = demand.astype(np.float64), float(sizes @ demand) / capacity, {}
    weight = sizes * (1.0 + LONG * sizes / capacity)
    while left.max(initial=0.0) > 1e-6:
        values = np.where(left > 1e-6, weight * np.exp(RATE * (left / demand - 1.0)), 0.0)
        open_ = np.flatnonzero(values)
        s, v = sizes[open_], values[open_]
        best = knapsack(s, v, capacity)
        bound = max(bound, float(v @ demand[open_] / best[capacity]))
        for k in range(len(open_) - 1, max(-1, len(open_) - 1 - COLUMNS), -1):
            stock = np.ceil(left[open_] - 1e-6).astype(np.int64)
            if stock[k] < 1:
                continue
            config = configuration(k, s, v, best, stock)
            at, n = open_[list(config)], np.array(list(config.values()))
            step = float(min((left[at] / n).min(), max(SHARE * (demand[at] / n).min(), 1.0)))
            left[at] = np.maximum(left[at] - step * n, 0.0)
            key = tuple(sorted(zip(at.tolist(), n.tolist(), strict=True)))
            used[key] = used.get(key, 0.0) + step
    return [(dict(key), x) for key, x in used.items()], bound


class Stock:
    """Numbers of pieces left, by length."""

    def __init__(self, counts: dict[int, int]):
        self.left = {n: c for n, c in counts.items() if c}
        self.order = sorted(self.left)

    def longest(self, most: int) -> int | None:
        i = bisect_right(self.order, most) - 1
        return self.order[i] if i >= 0 else None

    def take(self, length: int, n: int) -> None:
        self.left[length] -= n
        if not self.left[length]:
            del self.left[length]
            self.order.pop(bisect_right(self.order, length) - 1)

    def put(self, length: int, n: int) -> None:
        if length not in self.left:
            insort(self.order, length)
        self.left[length] = self.left.get(length, 0) + n


@dataclass(frozen=True)
class Plan:
    """(lengths in a sequence, number of such sequences), the LP's lower bound, and how many sequences come from rounding and from best fit."""

    sequences: list[tuple[list[int], int]]
    bound: float
    rounded: int
    remainder: int

    def __len__(self) -> int:
        return self.rounded + self.remainder


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Sequences that hold every piece of the histogram exactly once."""
    counts = {n: c for n, c in histogram.items() if n < capacity and c}
    sizes = np.array(sorted(counts), dtype=np.int64)
    columns, bound = solve(sizes, np.array([counts[n] for n in sizes.tolist()], dtype=np.float64), capacity) if counts else ([], 0.0)
    best: Plan | None = None
    for shares in GIVEN_BACK:
        found = _rounded(counts, columns, bound, sizes, shares, capacity)
        if best is None or len(found) < len(best):
            best = found
        if len(best) <= np.ceil(bound - 1e-6):
            break
    full = histogram.get(capacity, 0)
    return Plan([([capacity], full)] * bool(full) + best.sequences, bound + full, best.rounded + full, best.remainder)


def _rounded(counts: dict[int, int], columns: list[tuple[dict[int, int], float]], bound: float, sizes: np.ndarray, shares: tuple[int, int], capacity: int) -> Plan:
    """Whole copies of the LP's configurations, single copies of what rounding cut off, and best fit for what is left and given back."""
    out: list[tuple[list[int], int]] = []
    stock, heads = Stock(counts), []

    def take(config: dict[int, int], copies: int) -> None:
        m = min(copies, *(stock.left.get(int(sizes[i]), 0) // n for i, n in config.items()))
        if m:
            for i, n in config.items():
                stock.take(int(sizes[i]), m * n)
            heads.append(([int(sizes[i]) for i, n in config.items() for _ in range(n)], m))

    for config, x in columns:
        take(config, int(x + 1e-6))
    for config, x in sorted(columns, key=lambda c: int(c[1] + 1e-6) - c[1]):
        if x - int(x + 1e-6) > 1e-6:
            take(config, 1)

    def fill(lengths: list[int], m: int) -> None:
        """Best fit: the longest piece left that fits, copy by copy but on counts."""
        todo = [(lengths, m, capacity - sum(lengths))]
        while todo:
            own, m, slack = todo.pop()
            n = stock.longest(slack)
            if n is None:
                out.append((own, m))
                continue
            k = min(m, stock.left[n])
            repeat = max(1, min(slack // n, stock.left[n] // m)) if k == m else 1
            stock.take(n, k * repeat)
            if k < m:
                todo.append((own, m - k, slack))
            todo.append((own + [n] * repeat, k, slack - n * repeat))

    made = sum(m for _, m in heads)
    for rank, share in zip((lambda h: sum(h[0]), lambda h: -len(h[0])), shares, strict=True):
        heads.sort(key=rank, reverse=True)
        back = -(-made * share // 100)
        while back > 0 and heads:
            lengths, m = heads.pop()
            gone = min(m, back)
            for n in lengths:
                stock.put(n, gone)
            if gone < m:
                heads.append((lengths, m - gone))
            back -= gone
    for lengths, m in sorted(heads, key=lambda h: sum(h[0])):
        fill(lengths, m)
    rounded = sum(m for _, m in out)
    while stock.order:
        n = stock.order[-1]
        m = max(1, stock.left[n] // (capacity // n))
        stock.take(n, m)
        fill([n], m)
    return Plan(out, bound, rounded, sum(m for _, m in out) - rounded)


def _piece_batches(batches: Iterator[pa.RecordBatch], tokenizer: str, capacity: int) -> Iterator[pa.RecordBatch]:
    enc, end = encoder(tokenizer), np.array([END], dtype="<u4").tobytes()
    for batch in batches:
        ids, piece, start, length, crc = [], [], [], [], []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data = memoryview(enc.ids(text.as_py() or "") + end)
            for p, at in enumerate(range(0, len(data), 4 * capacity)):
                part = data[at : at + 4 * capacity]
                ids.append(doc_id)
                piece.append(p)
                start.append(at // 4)
                length.append(len(part) // 4)
                crc.append(zlib.crc32(part))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
            names=["doc_id", "piece", "start", "length", "ids_crc32"],
        )


def _place_batches(batches: Iterator[pa.RecordBatch], slots: tuple[np.ndarray, ...], first_of: np.ndarray) -> Iterator[pa.RecordBatch]:
    begin, sequence, offset = slots
    for batch in batches:
        at = first_of[np.asarray(batch.column("length"))] + np.asarray(batch.column("rank"))
        slot = np.searchsorted(begin, at, side="right") - 1
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:5], pa.array(sequence[slot] + at - begin[slot]), pa.array(offset[slot])],
            names=[*batch.schema.names[:5], "sequence_id", "offset"],
        )


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """``docs(doc_id, text, ...)`` to one row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its token ids, without special tokens, and then id 1; a null
    or empty text is that id alone.  Only a document longer than ``capacity`` is
    cut, into pieces of ``capacity`` and a last one.  Every piece lies in one
    sequence of at most ``capacity`` tokens, and the pieces of a sequence stand
    without gaps.  Repeated rows are pieces of their own; which of several equal
    rows takes which place is not told apart.  No rows make no sequences.
    """
    pieces = docs.select("doc_id", "text").mapInArrow(lambda it: _piece_batches(it, tokenizer, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long")
    pieces = materialize(pieces, "pieces")
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    total = sum(histogram.values())
    by_length: dict[int, list[tuple[int, int, int]]] = {}
    sequences = 0
    for lengths, m in plan(histogram, capacity).sequences:
        offset = 0
        for n in lengths:
            by_length.setdefault(n, []).append((m, sequences, offset))
            offset += n
        sequences += m
    first_of, rows, at = np.zeros(capacity + 1, dtype=np.int64), [], 0
    for n in sorted(by_length):
        first_of[n] = at
        for m, sequence, offset in by_length[n]:
            rows.append((at, sequence, offset))
            at += m
    assert at == total, "the plan must hold every piece"
    slots = tuple(np.array(x, dtype=np.int64) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, dtype=np.int64),) * 3

    buckets = 32 + total // BUCKET_ROWS
    # equal rows would share a bucket by their hash: where they lie in the table spreads them; which of them takes which place is not told apart
    pieces = pieces.withColumn("spread", F.monotonically_increasing_id())
    spread = materialize(pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "spread"), F.lit(buckets))).drop("spread"), "dealt")
    before = spread.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = before.withColumn("before", F.sum("n").over(W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)) - F.col("n"))
    own = F.row_number().over(W.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = spread.withColumn("own", own).join(before.select("length", "bucket", "before"), ["length", "bucket"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("own") - 1).alias("rank"))
    return ranked.mapInArrow(
        lambda it: _place_batches(it, slots, first_of),
        "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )
