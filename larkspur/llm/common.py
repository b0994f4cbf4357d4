"""Shared helpers: text batches and vectorised word hashing.

Operators cut lineage with larkspur.session.staged, a Parquet table below
``spark.checkpoint.dir``, the folder that driver and executors share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.session import staged as staged

CHUNK_BYTES = 1 << 20  # text bytes that one vectorised step looks at
BROADCAST_ROWS = 2_000_000  # narrow rows (id only) that may be broadcast

_MULT = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MULT, -1, 1 << 64)
_C1 = np.uint64(0xFF51AFD7ED558CCD)
_C2 = np.uint64(0xC4CEB9FE1A85EC53)
_WORD_FACTORS = [0x9FB21C651E98DF25, 0xA24BAED4963EE407, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD]

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def lean(spark: SparkSession) -> None:
    """Small Arrow batches: a Python worker holds a few copies of a batch, whatever the length of the texts.

    These two settings stay changed in the caller's session: a lazy result runs under what is set when it runs.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def keep_rows_of(df: DataFrame, ids: DataFrame, key: str, how: str = "left_semi", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Semi or anti join with a narrow table of ids: broadcast when it is counted and small, shuffled beyond that."""
    small = ids.limit(limit + 1).count() <= limit
    return df.join(F.broadcast(ids) if small else ids, key, how)


def quoted(column: str) -> str:
    """A column's name as an identifier, whatever its characters."""
    return f"`{column.replace('`', '``')}`"


def without_rows(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = BROADCAST_ROWS) -> DataFrame:
    """docs without the rows of gone(doc_id, copy), an id, null or not, and the hash of a text; broadcast when it is counted and small."""
    gone = gone.select(F.col("doc_id").alias("_id"), F.col("copy").alias("_copy")).distinct()
    small = gone.limit(limit + 1).count() <= limit
    rows = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row"), F.col(quoted(id_col)).cast("long").alias("id"), F.xxhash64(F.col(quoted(text_col)).cast("string")).alias("copy"))
    left = rows.join(F.broadcast(gone) if small else gone, F.col("id").eqNullSafe(F.col("_id")) & (F.col("copy") == F.col("_copy")), "left_anti")
    return left.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h *= _C1
    h ^= h >> np.uint64(29)
    h *= _C2
    h ^= h >> np.uint64(32)
    return h


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the multiplier and of its inverse, modulo 2**64."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, CHUNK_BYTES + (CHUNK_BYTES >> 2))
        for key, base in (("up", _MULT), ("down", _INV)):
            x = np.full(size, base, dtype=np.uint64)
            x[0] = 1
            _powers[key] = np.cumprod(x, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums: entry i covers the bytes before i. See span_hash."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    up, _ = powers(len(data))
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes [start, end), the same wherever they stand."""
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


def text_chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a batch into runs of rows of about `limit` text bytes: (first row, end row, bytes, offsets). Null is empty."""
    col = batch.column(batch.schema.get_field_index(column))
    n = len(col)
    if not n:
        return
    col = col.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    _, at, data = col.buffers()
    offsets = np.frombuffer(at, dtype=np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1))
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def words_of(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, a run of bytes outside `space` (`[^\\x20\\x09-\\x0D]+`), and the words before each document's start (length: documents + 1)."""
    solid = np.zeros(len(data) + 1, dtype=bool)
    solid[:-1] = ~space[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    cut = offsets[:-1]
    first[cut] = solid[cut]
    cut = cut[cut > 0] - 1
    last[cut] = solid[cut]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the words with A-Z in lower case."""
    return span_hash(prefix_hash(LOWER[data]), start, end)


def shingles(words: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words of each document in order, and their bounds. A shorter document that has words gives one hash of all of them."""
    counts = np.diff(bounds)
    total = len(words)
    whole = np.zeros(max(0, total - size + 1), dtype=np.uint64)
    for k in range(size):
        whole += words[k : k + len(whole)] * np.uint64(_WORD_FACTORS[k])
    whole = mix(whole)
    made = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    out_bounds = np.concatenate([[0], np.cumsum(made)])
    long = counts >= size
    starts = np.repeat(bounds[:-1][long] - out_bounds[:-1][long], made[long])
    out = np.zeros(out_bounds[-1], dtype=np.uint64)
    at = np.repeat(long, made)
    out[at] = whole[starts + np.flatnonzero(at)]
    for d in np.flatnonzero((counts > 0) & ~long):
        h = sum(int(words[bounds[d] + k]) * _WORD_FACTORS[k] for k in range(counts[d])) + int(counts[d]) * 0x632BE59BD9B4E019
        out[out_bounds[d]] = mix(np.array([h % (1 << 64)], dtype=np.uint64))[0]
    return out, out_bounds


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each document."""
    start, end, bounds = words_of(data, offsets)
    found, cuts = shingles(word_hashes(data, start, end), bounds, size)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield np.unique(found[a:b])


def text_bytes(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a list of str, bytes or None."""
    raw = [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else (t or b"") for t in texts]
    return np.frombuffer(b"".join(raw), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw], dtype=np.int64)]).astype(np.int64)
