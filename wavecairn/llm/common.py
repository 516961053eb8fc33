"""What the operators share: reading rows, shared-folder tables, and byte kernels in numpy.

Every operator takes a DataFrame with the columns ``doc_id`` and ``text`` and ignores all others, so
extra columns never clash with working columns.
"""

from __future__ import annotations

import functools
import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """The two columns that operators work on, with a null text kept as null."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def packed(docs: DataFrame) -> DataFrame:
    """All columns as one, named row, so that working columns clash with none of theirs, whatever their names."""
    return docs.select(F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias("row"))


def unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs again."""
    return rows.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, set here only where it is unset and all run on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.conf.get("spark.master", "").split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="wavecairn-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Writes df to the shared folder, in partitions of `by`, and reads it again: cuts lineage and outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    # the table replaces the plan, so its shuffle files can go when it is written
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        (writer.partitionBy(by) if by else writer).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def kept(view: DataFrame, table: DataFrame) -> DataFrame:
    """A view of a stored table, to be removed as that is."""
    view._stored_at = table._stored_at
    return view


def dropped(table: DataFrame) -> None:
    """Removes a stored table that is read no more."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table._stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Keys that hold more than this share of all rows (1 / HOT) are joined by broadcast.
HOT = 1000


def met(each: DataFrame, groups: DataFrame, key: str, total: int) -> DataFrame:
    """each joined with groups(key, times, ...), times being the rows of each with that key, of `total`.

    Frequent keys go by broadcast: HOT rows at most, since they hold a HOT-th of all rows each. Only the others are exchanged, so no task
    gathers the rows of one key. `groups` is read twice and should be stored.
    """
    frequent = F.col("times") * HOT > total
    hot = F.broadcast(groups.where(frequent))
    rest = each.join(F.broadcast(groups.where(frequent).select(key)), key, "left_anti")
    return each.join(hot, key).unionByName(rest.join(groups.where(~frequent), key))


def crc_mod(column, n: int):
    """crc32 of the id's decimal text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit(""))) % n


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def text_key(text: str | None) -> str:
    """The digest by which equal texts are known; Spark's sha2 of the text gives the same."""
    return "null" if text is None else sha(text.encode())[:32]


# ---- UTF-8 columns as one byte array -------------------------------------------------------------


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column in a row, and n+1 offsets. Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def blocks(offsets: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes each; a longer row stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


# ---- words ---------------------------------------------------------------------------------------

_rng = np.random.default_rng(20240611)
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C15
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@functools.cache
def powers(n: int, base: int = _BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.ones(n, U64)
    k = 1
    while k < n:
        m = min(k, n - k)
        out[k : k + m] = out[:m] * U64(pow(base, k, 2**64))
        k += m
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits (the splitmix64 finaliser's constants)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of each row: 64-bit hash (A-Z lowered), first byte, length, and n+1 offsets by row."""
    n = len(data)
    if not n:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~SEPARATOR[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][(offsets[:-1] < n)]
    first[heads] = inside[heads]
    start = np.flatnonzero(first)
    place = np.flatnonzero(inside)
    at = np.searchsorted(place, start)
    length = np.diff(np.append(at, len(place)))
    within = np.arange(len(place), dtype=np.int64) - np.repeat(at, length)
    code = BYTE_CODE[LOWER[data[place]]]
    table = powers(1 << 16)
    if len(within) and within.max() >= 1 << 16:
        code = mix(code + (within >> 16).astype(U64))
        within &= 0xFFFF
    code = code * table[within]
    hashed = mix(np.add.reduceat(code, at) + length.astype(U64)) if len(at) else np.zeros(0, U64)
    return hashed, start, length, np.searchsorted(start, offsets)


def shingles(hashed: np.ndarray, by_row: np.ndarray, size: int) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its runs of `size` words; of all words when there are fewer."""
    out = []
    if len(hashed) >= size:
        run = np.zeros(len(hashed) - size + 1, U64)
        for k in range(size):
            run = run * U64(0xD6E8FEB86659FD93) + hashed[k : len(hashed) - size + 1 + k]
        run = mix(run)
    for lo, hi in zip(by_row[:-1].tolist(), by_row[1:].tolist(), strict=True):
        if hi - lo >= size:
            out.append(np.unique(run[lo : hi - size + 1]))
        elif hi > lo:
            one = np.zeros(1, U64)
            for h in hashed[lo:hi]:
                one = one * U64(0xD6E8FEB86659FD93) + h
            out.append(mix(one + U64(hi - lo)))
        else:
            out.append(np.zeros(0, U64))
    return out
