"""Near-equal lines by deletion neighbourhoods; the earliest stays.

Two lines are the same if their words (``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased)
are.  They are near if one edit (a unit inserted, left out or replaced) turns one
into the other.  The unit is the word in lines of ``MIN_WORDS`` words and more,
and the character, of the words joined by single spaces, in lines of at most
``CHAR_WORDS`` words and at least ``MIN_CHARS`` characters; so words that are
joined or split, and scripts without spaces, are covered where words are few.

1. One pass gives each line a hash and ``PARTS`` keys, each of the line without
   one of its parts: by the pigeonhole principle near lines share one.  Lines
   that share none, nearly all, have no near line.
2. The others emit their deletion neighbourhood as hashed keys: every way to
   leave out one unit, inside the part outside which they share all, with and without the
   place.  Equal keys with the place are a replaced unit; a key without the place
   that equals a whole line is a unit left out or inserted.
3. Per key only the least place is kept, so lines with many near ones never pair
   up with each other.  The pair of a line and its earliest near one is verified on the texts.

Hashes of stretches and of lines less one unit come from prefix sums of
value * BASE**place, so a line costs memory in proportion to its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from .scratch import hot_join, materialize
from .words import mix, power_tables, slices, word_hashes

MIN_WORDS, MIN_CHARS, CHAR_WORDS = 5, 20, 16
WORDS, CHARS = 0, 1  # units
REPLACED, LONGER, SHORTER = 0, 1, 2
PARTS = 4
STEP = 1 << 16  # neighbours that are made at a time
_U = np.uint64
_A, _B, _C = (_U(x) for x in (0x8CB92BA72F3D8DD7, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_UNIT = (_U(0x27D4EB2F165667C5), _U(0x85EBCA77C2B2AE63))


def class_of(n: np.ndarray) -> np.ndarray:
    """A length that lines of n units and of a few more have in common; they are cut into parts by it."""
    step = np.maximum(4, 2 ** (np.frexp(np.maximum(n, 1).astype(np.float64))[1] - 1).astype(np.int64) // 16)
    return np.maximum(n, 0) // step * step


def part(m: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Units before part j of a line of class m, and units after it."""
    return m * j // PARTS, m - m * (j + 1) // PARTS


class Sequences:
    """Lines as sequences of unit hashes, with the hashes of their stretches."""

    def __init__(self, unit: int, values: np.ndarray, n: np.ndarray):
        self.salt, self.unit, self.n = _UNIT[unit], unit, n
        self.end = np.cumsum(n)
        self.start = self.end - n
        up, self.down = power_tables(len(values) + 1)
        self.total = np.concatenate(([_U(0)], np.cumsum(values * up[: len(values)], dtype=np.uint64)))

    def stretch(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return (self.total[hi] - self.total[lo]) * self.down[lo]

    def closed(self, h: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        return mix(h + np.asarray(n).astype(np.uint64) * _C + self.salt)

    def whole(self) -> np.ndarray:
        return self.closed(self.stretch(self.start, self.end), self.n)

    def part_keys(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(line, key): for every part of chosen lines the hash of what is outside it, in the class of their own length and, if it differs, of one unit less.

        A line meets lines of its length and shorter ones in these, longer ones in its own class alone.
        The three lowest bits of a key tell the unit and the part.
        """
        own, less = class_of(self.n[at]), class_of(self.n[at] - 1)
        two = at[own != less]
        line, m = np.concatenate((at, two)), np.concatenate((own, less[own != less]))
        start, end = self.start[line], self.end[line]
        keys = []
        for j in range(PARTS):
            before, after = part(m, j)
            h = self.stretch(start, start + before) * _A + self.stretch(end - after, end) * _B
            keys.append(self.closed(h, m) & ~_U(7) | _U(PARTS * self.unit + j))
        return np.tile(line, PARTS), np.concatenate(keys)

    def neighbourhood(self, k: int, shared: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place, hash) of line k with one unit left out, inside the parts (bits of ``shared``) outside which all is shared; some at a time."""
        s, e, n = int(self.start[k]), int(self.end[k]), int(self.n[k])
        inside = np.zeros(n, dtype=bool)
        for j in range(PARTS):
            if shared >> j & 1:
                for m in {int(class_of(np.int64(n))), int(class_of(np.int64(n - 1)))}:
                    before, after = part(m, j)
                    inside[before : n - after] = True
        places = np.flatnonzero(inside)
        for at in range(0, len(places), STEP):
            i = places[at : at + STEP]
            h = (self.total[s + i] - self.total[s]) * self.down[s] + (self.total[e] - self.total[s + i + 1]) * self.down[s + 1]
            yield i, self.closed(h, n - 1)


def characters(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the characters of lines whose words are joined by one space, A-Z lower-cased, and their number in each line."""
    lines = lines.cast(pa.large_string())
    offsets = np.frombuffer(lines.buffers()[1], dtype=np.int64)[lines.offset : lines.offset + len(lines) + 1]
    data = np.frombuffer(lines.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    code = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype=np.uint32)
    begin = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets - offsets[0]]
    line = np.repeat(np.arange(len(lines)), np.diff(begin))
    solid = (code != 0x20) & ((code < 0x09) | (code > 0x0D))
    before = np.concatenate(([0], np.cumsum(solid)))
    joint = ~solid & (before[:-1] > before[begin[:-1]][line])  # white space after a word of its line
    joint[:-1] &= solid[1:] & (line[1:] == line[:-1])
    joint[-1:] = False
    code = np.where(solid, code, 0x20)
    code[(code >= ord("A")) & (code <= ord("Z"))] += 32
    keep = solid | joint
    return mix((code[keep].astype(np.uint64) + _U(1)) * _A), np.bincount(line[keep], minlength=len(lines))


def _line_arrays(text: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """For every line of a column of texts: its row, its number from 0, and the line."""
    parts = pc.split_pattern(text.cast(pa.large_string()), "\n")
    row = np.asarray(pc.list_parent_indices(parts)).astype(np.int64)
    start = np.searchsorted(row, np.arange(len(text)))
    return row, np.arange(len(row)) - start[row], parts.flatten()


def _sequences(lines: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[tuple[Sequences, np.ndarray]]]]:
    """(first line, words of each, line hashes, sequences of each unit with the lines that have them) of successive stretches of lines."""
    for first, last, w, n in word_hashes(lines):
        start = np.cumsum(n) - n
        place = (np.arange(len(w)) - np.repeat(start, n)).astype(np.uint64)
        total = np.concatenate(([_U(0)], np.cumsum(mix(w * _A + place * _B), dtype=np.uint64)))
        whole = mix(total[start + n] - total[start] + n.astype(np.uint64) * _C)
        found = [(Sequences(WORDS, w, n), np.arange(last - first)[n >= MIN_WORDS])]
        few = np.flatnonzero((n > 0) & (n <= CHAR_WORDS))
        if len(few):
            by_character = Sequences(CHARS, *characters(lines.take(pa.array(first + few))))
            at = np.zeros(last - first, dtype=np.int64)
            at[few] = np.arange(len(few))
            found.append((by_character, few[by_character.n >= MIN_CHARS]))
            by_character.at, by_character.lines = at, few
        yield first, n, whole, found


def _line_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text_key, text) to a row for each line with words: doc_id, text_key, line, hash, keys."""
    for batch in slices(batches):
        row, number, lines = _line_arrays(batch.column(2))
        for first, n, whole, found in _sequences(lines):
            of, keys = [], []
            for seq, own in found:
                line, key = seq.part_keys(own if seq.unit == WORDS else seq.at[own])
                of.append(line if seq.unit == WORDS else seq.lines[line])
                keys.append(key)
            of, keys = np.concatenate(of), np.concatenate(keys)
            has = np.flatnonzero(n > 0)
            order = np.argsort(of, kind="stable")
            offsets = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(n))[has]))).astype(np.int32)
            r = pa.array(row[first + has])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(r), batch.column(1).take(r), pa.array(number[first + has].astype(np.int32)), pa.array(whole[has].view(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[order].view(np.int64)))],
                names=["doc_id", "text_key", "line", "hash", "keys"],
            )


def _variant_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts (doc_id, text_key, text, chosen lines with what they share) to neighbourhood rows; the text of a line goes with one row of its own."""
    for batch in batches:
        if not len(batch):
            continue
        row, _, lines = _line_arrays(batch.column(2))
        chosen, of = batch.column(3).flatten(), np.asarray(pc.list_parent_indices(batch.column(3))).astype(np.int64)
        number, shared, hashes = (np.asarray(chosen.field(c)) for c in ("line", "shared", "hash"))
        lines = lines.take(pa.array(np.searchsorted(row, of) + number))
        for key, role, source, words in _neighbours(lines, shared, hashes):
            at = pa.array(of[source])
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(role.astype(np.int32)), batch.column(0).take(at), batch.column(1).take(at), pa.array(number[source].astype(np.int32)), pa.array(hashes[source]), words],
                names=["key", "role", "doc_id", "text_key", "line", "hash", "words"],
            )


def _neighbours(lines: pa.Array, shared: np.ndarray, hashes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
    key, role, source, size = [], [], [], 0

    def rows() -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        r, s = np.concatenate(role), np.concatenate(source)
        own = pa.array(np.where(r == SHORTER, s, -1), mask=r != SHORTER)  # null takes no text
        return np.concatenate(key), r, s, lines.take(own).cast(pa.string())

    for first, n, _, found in _sequences(lines):
        for seq, own in found:
            whole = seq.whole()
            for k in own.tolist():
                bits = int(shared[first + k]) >> (PARTS * seq.unit) & (1 << PARTS) - 1
                if not bits:
                    continue
                at = k if seq.unit == WORDS else int(seq.at[k])
                key.append(whole[at : at + 1])
                role.append(np.array([SHORTER]))
                source.append(np.array([first + k]))
                for i, v in seq.neighbourhood(at, bits):
                    key += [mix(v ^ ((i + 1).astype(np.uint64) * _B)), v]
                    role += [np.full(len(i), REPLACED), np.full(len(i), LONGER)]
                    source.append(np.full(2 * len(i), first + k))
                    size += 2 * len(i)
                    if size >= STEP:
                        yield rows()
                        key, role, source, size = [], [], [], 0
    if key:
        yield rows()


_VARIANTS = "key long, role int, doc_id long, text_key long, line int, hash long, words string"
_LOWER = {ord("A") + i: ord("a") + i for i in range(26)}
_SPACES = dict.fromkeys(range(0x09, 0x0E), " ")


def _one_edit(x: list[str] | str, y: list[str] | str) -> bool:
    if len(x) > len(y):
        x, y = y, x
    if len(y) - len(x) > 1:
        return False
    i = 0
    while i < len(x) and x[i] == y[i]:
        i += 1
    return x[i + (len(x) == len(y)) :] == y[i + 1 :]


def near_lines(a: str, b: str) -> bool:
    """Whether one edit turns one line into the other, or none: of a word if both have enough words, of a character if both have few words."""
    x, y = ([w.translate(_LOWER) for w in s.translate(_SPACES).split(" ") if w] for s in (a, b))
    if min(len(x), len(y)) >= MIN_WORDS and _one_edit(x, y):
        return True
    s, t = " ".join(x), " ".join(y)
    return max(len(x), len(y)) <= CHAR_WORDS and min(len(s), len(t)) >= MIN_CHARS and _one_edit(s, t)


@F.pandas_udf(BooleanType())
def _verified(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([near_lines(x, y) for x, y in zip(a, b, strict=True)], dtype=bool)


def _places(docs: DataFrame) -> DataFrame:
    """The places (doc_id, text_key, line) of the lines to drop."""
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    lines = materialize(texts.mapInArrow(_line_batches, "doc_id long, text_key long, line int, hash long, keys array<long>"), "lines")
    firsts = lines.groupBy("hash").agg(F.min(F.struct("doc_id", "text_key", "line", "keys")).alias("f")).select("hash", "f.*")
    firsts = materialize(firsts, "firsts")
    # a repeated line is one whose place is not the first of its hash: the place is part of the key, so common lines spread
    drops = lines.select("doc_id", "text_key", "line", "hash").join(firsts, ["hash", "doc_id", "text_key", "line"], "left_anti").select("doc_id", "text_key", "line")

    keyed = firsts.select("hash", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("hash").alias("a"), F.max("hash").alias("b"), F.count("*").alias("n")).where("a <> b").select("key", "n")
    met = hot_join(keyed, materialize(shared, "shared-parts"), "key", "left_semi")
    bits = F.expr("bit_or(shiftleft(1, cast(key & 7 AS int)))")
    chosen = materialize(firsts.drop("keys").join(met.groupBy("hash").agg(bits.alias("shared")), "hash"), "chosen")
    per_text = chosen.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list(F.struct("line", "shared", "hash"))).alias("chosen"))
    # whole texts are shuffled and not sorted: the lists of their lines are the hashed side
    side = materialize(per_text, "chosen-by-text").hint("shuffle_hash")
    variants = materialize(texts.join(side, ["doc_id", "text_key"]).select("doc_id", "text_key", "text", "chosen").mapInArrow(_variant_batches, _VARIANTS), "variants")

    own = F.struct("doc_id", "text_key", "line")
    at = variants.select("key", "role", F.struct("doc_id", "text_key", "line", "hash").alias("f"))
    least = at.groupBy("key").agg(F.count("*").alias("n"), *(F.min(F.when(F.col("role") == r, F.col("f"))).alias(f"least{r}") for r in (REPLACED, LONGER, SHORTER))).where("n > 1")
    partner = F.when(F.col("role") == REPLACED, F.col(f"least{REPLACED}")).when(F.col("role") == LONGER, F.col(f"least{SHORTER}")).otherwise(F.col(f"least{LONGER}"))
    before = hot_join(at, materialize(least, "least"), "key").select(F.struct("f.doc_id", "f.text_key", "f.line").alias("own"), F.col("f.hash").alias("hash"), partner.alias("p"))
    before = before.where(F.struct("p.doc_id", "p.text_key", "p.line") < F.col("own")).groupBy("own", "hash").agg(F.min("p").alias("p"))
    before = materialize(before.select("own", "hash", F.col("p.hash").alias("other")), "before")
    words = variants.where(F.col("role") == SHORTER).groupBy("hash").agg(F.min("words").alias("words"))
    many = before.groupBy("other").agg(F.count("*").alias("n")).join(words.select(F.col("hash").alias("other"), F.col("words").alias("other_words")), "other")
    pairs = hot_join(before.join(words, "hash"), materialize(many, "partners"), "other")
    near = pairs.where(_verified("words", "other_words")).select("own.*")
    return materialize(drops.union(near).distinct(), "drops")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with later lines dropped from ``text``, and two more columns: n_lines, n_dropped.

    A line is dropped if an equal line, or the first line of some near text, stands
    earlier in the order of (doc_id, line number), whether that one stays or not.
    Lines without words always stay.  Every row stays, if all its lines go with an
    empty text; null texts stay null with n_lines 0, an empty text is one line.
    Rows without a doc_id are passed through, and drop nothing elsewhere.  Equal rows are treated
    alike; rows that share a doc_id with other texts are told apart by the text.
    Very long lines cost memory in proportion to their length.  An empty table gives no rows.
    A column of ``docs`` named ``n_chars`` follows the text; columns named n_lines or n_dropped
    give way to the new ones; others are left alone, whatever their names.
    """
    drops = _places(docs)
    per_text = materialize(drops.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list("line")).alias("gone")), "gone")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.col("doc_id"), F.xxhash64("text").alias("text_key"))
    rows = rows.join(per_text.hint("shuffle_hash"), ["doc_id", "text_key"], "left")
    text, changed = F.col("doc.text"), F.col("gone").isNotNull()
    rows = rows.select("doc", "gone", F.when(changed, F.split(text, "\n")).alias("parts"))
    # what lies between one dropped line and the next, one slice each
    bounds = F.concat(F.array(F.lit(-1)), F.col("gone"), F.array(F.size("parts")))
    between = F.transform(F.slice(bounds, 2, F.size("gone") + 1), lambda b, i: F.slice("parts", F.get(bounds, i) + 2, b - F.get(bounds, i) - 1))
    kept = F.array_join(F.flatten(between), "\n")
    rows = rows.select("doc", "gone", F.when(changed, kept).otherwise(text).alias("text"))
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return rows.select(
        *(
            F.col("text") if c == "text"
            else F.when(changed, F.length("text").cast(docs.schema[c].dataType)).otherwise(F.col("doc").getField(c)).alias(c) if c == "n_chars"
            else F.col("doc").getField(c).alias(c)
            for c in names
        ),
        F.when(text.isNull(), 0).otherwise(1 + F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )


#: The same rows in DuckDB: all ways to leave out a word, or a character, of all lines that have such neighbours.
ORACLE_SQL = rf"""
WITH raw AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents),
ln AS (
  SELECT doc_id, u.i - 1 AS line, u.l AS line_text,
         list_filter(regexp_split_to_array(translate(u.l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM raw, unnest(list_zip(range(1, len(parts) + 1), parts)) AS t(u0), (SELECT u0[1] AS i, u0[2] AS l) AS u),
keyed AS (SELECT *, array_to_string(words, ' ') AS h, len(words) AS n FROM ln),
firsts AS (SELECT h, min((doc_id, line)) AS f, any_value(words) AS words, any_value(n) AS n FROM keyed WHERE n > 0 GROUP BY h),
whole AS (
  SELECT h, f, 'w' AS unit FROM firsts WHERE n >= {MIN_WORDS}
  UNION ALL SELECT h, f, 'c' FROM firsts WHERE n <= {CHAR_WORDS} AND length(h) >= {MIN_CHARS}),
v AS (
  SELECT h, f, 'w' AS unit, i AS pos, array_to_string(list_concat(words[1 : i - 1], words[i + 1 :]), ' ') AS vh
  FROM (SELECT h, f, words, unnest(range(1, n + 1)) AS i FROM firsts WHERE n >= {MIN_WORDS})
  UNION ALL
  SELECT h, f, 'c', i, left(h, i - 1) || substr(h, i + 1)
  FROM (SELECT h, f, unnest(range(1, length(h) + 1)) AS i FROM firsts WHERE n <= {CHAR_WORDS} AND length(h) >= {MIN_CHARS})),
beaten AS (
  SELECT DISTINCT a.h FROM v a JOIN (SELECT vh, pos, unit, min(f) AS f FROM v GROUP BY vh, pos, unit) b ON a.vh = b.vh AND a.pos = b.pos AND a.unit = b.unit AND b.f < a.f
  UNION SELECT a.h FROM v a JOIN whole b ON a.vh = b.h AND a.unit = b.unit AND b.f < a.f
  UNION SELECT b.h FROM v a JOIN whole b ON a.vh = b.h AND a.unit = b.unit AND a.f < b.f),
state AS (
  SELECT k.*, k.n > 0 AND ((k.doc_id, k.line) <> f.f OR b.h IS NOT NULL) AS gone
  FROM keyed k LEFT JOIN firsts f ON k.h = f.h AND k.n > 0 LEFT JOIN beaten b ON k.h = b.h AND k.n > 0)
SELECT doc_id, coalesce(string_agg(line_text, chr(10) ORDER BY line) FILTER (NOT gone), '') AS text,
       count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped
FROM state GROUP BY doc_id
"""
