"""Shared helpers: Arrow text access and word hashing on bytes."""

from __future__ import annotations

import gc
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import stored  # noqa: F401

#: Bytes of text that one vectorised step handles; temporaries take about 40 times as much.
BLOCK = 1 << 19
U = np.uint64


def read(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def if_small(table: DataFrame, most: int = 20_000) -> DataFrame:
    """A stored table marked for broadcast only if it has at most `most` rows; else left to a shuffle join."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


def over_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[dict]]], schema: str) -> DataFrame:
    """mapInArrow where make() builds a task's function once; that function yields column dicts."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    fields = _parse_datatype_string(schema)
    assert isinstance(fields, StructType)
    arrow = to_arrow_schema(fields)

    def run(batches):
        fresh()
        f = make()
        for batch in batches:
            for out in f(batch):
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, type=t.type) for x, t in ((out[t.name], t) for t in arrow)], schema=arrow)

    return df.mapInArrow(run, fields)


def arrow_iter_udf(run: Callable[[Iterator[pa.Array]], Iterator[pa.Array]], schema: str):
    """An Arrow UDF over a task's batches; other columns of the row stay in the JVM."""

    def f(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        fresh()
        yield from run(batches)

    f.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(f, schema)


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; null counts as empty."""
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type)
    n, bufs = len(col), col.buffers()
    if not n or bufs[1] is None:
        return np.empty(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(bufs[1], np.int64 if wide else np.int32, n + 1, col.offset * (8 if wide else 4)).astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.empty(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def slices(offs: np.ndarray, most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most `most` bytes together, or one longer row."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield i, j
        i = j


def _table(inside) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(inside)] = True
    return t


#: Byte tables. Bytes of 128 and above always belong to a word, so bytes and code points agree.
WHITE = _table([0x20, *range(0x09, 0x0E)])
NOT_ALNUM = _table([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)
HEAD = (np.arange(256) & 0xC0) != 0x80  # bytes that begin a code point

_BASE = 0x9E3779B97F4A7C15
RAND = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse. They are kept with the interpreter: functions travel with
    their module's globals, so every task has its own copy of those and would compute the table anew."""
    kept = sys.__dict__.setdefault("_clinmill_powers", [np.ones(1, U), np.ones(1, U)])
    if len(kept[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, U)
            p[0] = 1
            kept[k] = np.multiply.accumulate(p)
    return kept[0], kept[1]


def fresh() -> None:
    """Free what earlier tasks of this worker have left: their functions and globals refer to each other, so
    only the collector frees them. Arrow then takes memory from the system allocator, which gives it back."""
    pa.set_memory_pool(pa.system_memory_pool())
    gc.collect()


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def words(data: np.ndarray, offs: np.ndarray, sep: np.ndarray = WHITE, fold: np.ndarray = SAME) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, start, end) of each word of the rows; start and end are byte positions in data.

    A word's 64-bit hash is a polynomial over its folded bytes, taken from running sums, so the
    cost is a few numpy passes. Long rows are handled in pieces cut at separators.
    """
    n, at, parts = len(data), 0, []
    begins = np.zeros(n + 1, bool)
    begins[offs] = True
    while at < n:
        end = min(n, at + BLOCK)
        while end < n and not begins[end]:
            cut = np.flatnonzero(sep[data[end : end + 4096]] | begins[end : end + 4096][: len(data[end : end + 4096])])
            if len(cut):
                end += int(cut[0])
                break
            end = min(n, end + 4096)
        b = data[at:end]
        inside = ~sep[b]
        edge = begins[at : end + 1]
        first = inside.copy()
        first[1:] &= ~inside[:-1] | edge[1:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | edge[1:-1]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        p, q = powers(len(b) + 1)
        c = np.zeros(len(b) + 1, U)
        np.cumsum(RAND[fold[b]] * p[: len(b)], out=c[1:])
        parts.append((mix((c[e] - c[s]) * q[s]), s + at, e + at))
        at = end
    if not parts:
        z = np.empty(0, np.int64)
        return np.empty(0, U), z, z, z
    h, s, e = (np.concatenate(x) for x in zip(*parts, strict=True))
    return h, np.searchsorted(offs, s, "right") - 1, s, e


def hash_words(text: str, sep: np.ndarray = NOT_ALNUM, fold: np.ndarray = FOLD) -> np.ndarray:
    b = np.frombuffer(text.encode(), np.uint8)
    return words(b, np.array([0, len(b)]), sep, fold)[0]


def ngrams(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of first word) of each run of n words that lies within a row."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, U), np.empty(0, np.int64)
    g = h[:m].copy()
    for k in range(1, n):
        g = g * U(0xD6E8FEB86659FD93) + h[k : k + m]
    at = np.flatnonzero(row[:m] == row[n - 1 :])
    return mix(g[at]), at


def sha256_hex(col):
    return F.sha2(F.encode(col, "UTF-8"), 256)
