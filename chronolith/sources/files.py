"""Sources and sinks: directory captures, policy files, record packs, NDJSON."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import classify

SQLITE_MAGIC = b"SQLite format 3\0"  # fixed value
RECORD = struct.Struct(">4sBI")  # mark, kind, payload length; the payload and 32 bytes of its digest follow
MARK = b"CRPK"


def capture(spark: SparkSession, folder: str) -> DataFrame:
    """Files below a folder: path (relative), size, mtime, content digest, class, whether it is a SQLite database.

    Spark lists no names that begin with a dot or an underscore.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    base = folder.split("://")[-1].rstrip("/")
    path = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/+", "/"), f"^.*?{base}/", "")
    return raw.select(
        path.alias("path"), F.col("length").alias("size"), F.unix_seconds("modificationTime").alias("mtime"), F.sha2("content", 256).alias("target"),
        classify(path).alias("class"), (F.substring("content", 1, 16) == F.lit(SQLITE_MAGIC)).alias("is_sqlite"),
    )


def policy_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules of ``exclude <subtree>`` lines, sorted out: comments, blank lines and repeats go; what is no rule is an invalid row."""
    t = spark.read.text(path).select(F.trim(F.regexp_replace("value", "#.*$", "")).alias("line")).where("line <> ''")
    rule = F.regexp_extract("line", r"^exclude\s+(\S+)$", 1)
    clean = F.regexp_replace(rule, "/+$", "")
    bad = (clean == "") | F.startswith(clean, F.lit("/")) | clean.rlike(r"(^|/)\.\.?(/|$)")
    return t.select(F.when(~bad, clean).alias("path"), F.when(bad, F.col("line")).alias("invalid")).distinct()


def write_ndjson(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def read_ndjson(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of the schema, and a column ``_corrupt`` with lines that aren't of it.

    Lines are read as text and parsed by an expression, so the corrupt column can be asked for by itself.
    """
    row = F.from_json("value", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return spark.read.text(path).where("trim(value) <> ''").select(row.alias("row")).select("row.*")


def pack_records(records: list[tuple[int, bytes]]) -> bytes:
    return b"".join(RECORD.pack(MARK, kind, len(data)) + data + hashlib.sha256(bytes([kind]) + data).digest() for kind, data in records)


def scan_pack(data: bytes) -> tuple[list[tuple[int, int, int, str]], int]:
    """(offset, kind, length, id) of the whole records from the start, and where a torn or damaged tail begins."""
    at, out = 0, []
    while at + RECORD.size <= len(data):
        mark, kind, n = RECORD.unpack_from(data, at)
        end = at + RECORD.size + n + 32
        if mark != MARK or end > len(data):
            break
        digest = hashlib.sha256(bytes([kind]) + data[at + RECORD.size : end - 32]).digest()
        if digest != data[end - 32 : end]:
            break
        out.append((at, kind, n, digest.hex()))
        at = end
    return out, at


def recover_packs(spark: SparkSession, folder: str) -> DataFrame:
    """Records of all packs in a folder: pack, offset, kind, len, id, and the length that holds whole records (valid_to)."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                found, end = scan_pack(bytes(content))
                rows += [(path.rsplit("/", 1)[-1], *r, end) for r in found] or [(path.rsplit("/", 1)[-1], None, None, None, None, end)]
            yield pd.DataFrame(rows, columns=["pack", "offset", "kind", "len", "id", "valid_to"]).astype({"offset": "Int64", "kind": "Int32", "len": "Int64"})

    raw = spark.read.format("binaryFile").load(folder).select("path", "content")
    return raw.mapInPandas(scan, "pack string, offset long, kind int, len long, id string, valid_to long")
