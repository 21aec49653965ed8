"""Product codes of vectors by exact integer k-means over Hilbert-sorted blocks.

Each task keeps its vectors in chunks. For each part position the chunk's part vectors are sorted along a Hilbert
curve and cut into flat blocks of a few that lie close together; a block stores its min/max box and its sum. In a
round, the distances between a box and the codebook's entries bound those of all its rows: an entry whose least
distance is above another's greatest, or that another beats all over the box, is nearest to none of them. What is
left is the block's shortlist. A shortlist of one takes the block by its sum; the others are settled by integer
distances to the shortlist only. Chunks are written once and read in each round; only counts and sums by entry leave
a task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, if_small
from .vectors import stored, usable

SCALE = 256
#: Vectors of a chunk, rows of a block, bits of a coordinate on the curve, distances that a kernel holds at once.
CHUNK, BLOCK, BITS, AT_ONCE = 16384, 16, 8, 1 << 20


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of points (n, w) with coordinates of `bits` bits; bits * w is at most 63.

    Axes are turned into the curve's bits from the coarsest level down: at each level a set bit inverts the lower
    bits of the first axis, a clear one swaps them with the first axis'; Gray code orders the cells of a level."""
    a = [c.astype(np.int64) for c in x.T]
    level = 1 << (bits - 1)
    while level > 1:
        low = level - 1
        for k in range(len(a)):
            turned = (a[k] & level) != 0
            swap = np.where(turned, 0, (a[0] ^ a[k]) & low)
            a[0] = a[0] ^ np.where(turned, low, swap)
            a[k] = a[k] ^ swap if k else a[0]
        level >>= 1
    for k in range(1, len(a)):
        a[k] = a[k] ^ a[k - 1]
    turn = np.zeros(len(x), np.int64)
    level = 1 << (bits - 1)
    while level > 1:
        turn ^= np.where((a[-1] & level) != 0, level - 1, 0)
        level >>= 1
    key = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for c in a:
            key = (key << 1) | (((c ^ turn) >> b) & 1)
    return key


def curve_order(x: np.ndarray) -> np.ndarray:
    """Order of integer points (n, w) along the curve; of many axes only the first that fit are used."""
    x = x[:, :63]
    bits = max(1, min(BITS, 63 // x.shape[1]))
    x = x - x.min(0)
    shift = max(0, int(x.max()).bit_length() - bits)
    return np.argsort(hilbert(x >> shift, bits), kind="stable")


def shortlists(lo: np.ndarray, hi: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """(blocks, entries): whether an entry can be nearest, or tie for it, to a point of the block's box.

    An entry is out if its least distance to the box is above the greatest of another, or if it is farther than the
    entry of the smallest greatest distance all over the box: the difference of both squared distances is linear, so
    its least value over the box is exact."""
    near, far = np.zeros((2, len(lo), len(entries)), np.int64)
    for d in range(entries.shape[1]):
        below, above = entries[:, d] - hi[:, d, None], lo[:, d, None] - entries[:, d]  # how far outside the box
        near += np.maximum(np.maximum(below, above), 0) ** 2
        far += np.maximum(np.abs(below), np.abs(above)) ** 2
    best = far.argmin(1)
    least = (entries**2).sum(1) - (entries[best] ** 2).sum(1)[:, None]
    for d in range(entries.shape[1]):
        step = 2 * (entries[:, d] - entries[best, d, None])
        least -= np.maximum(step * lo[:, d, None], step * hi[:, d, None])
    return (near <= far.min(1, keepdims=True)) & (least <= 0)


def nearest(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry of each block that goes as a whole, else -1; entry of each row): exact, ties to the lower index.

    x holds the rows of the blocks in order, BLOCK each but for the last."""
    short = shortlists(lo, hi, entries)
    size = short.sum(1)
    whole = np.where(size == 1, short.argmax(1), -1)
    out = np.repeat(whole, BLOCK)[: len(x)]
    listed = np.argsort(~short, axis=1, kind="stable")  # shortlisted entries first, in their order
    rows = np.minimum(np.arange(len(lo) * BLOCK), len(x) - 1).reshape(len(lo), BLOCK)
    width = 2
    while width < 2 * len(entries):
        some = np.flatnonzero((size > width // 2) & (size <= width) & (size > 1))
        w = min(width, len(entries))
        for i in range(0, len(some), step := max(1, AT_ONCE // (BLOCK * w))):
            at = some[i : i + step]
            # short of `w`, the first entry is repeated: it comes later than itself, so ties are not changed
            cand = np.where(np.arange(w) < size[at, None], listed[at, :w], listed[at, :1])
            d = np.zeros((len(at), BLOCK, w), np.int64)
            for k in range(x.shape[1]):
                d += (x[rows[at], k][:, :, None] - entries[cand, k][:, None, :]) ** 2
            pick = np.take_along_axis(cand, d.argmin(2), 1)
            good = rows[at] == np.arange(len(lo) * BLOCK).reshape(len(lo), BLOCK)[at]
            out[rows[at][good]] = pick[good]
        width *= 2
    return whole, out


def _chunks(parts: int, length: int, types: pa.Schema):
    """Rows to chunks: (ids, labels, n, order, data, lo, hi, total), the last five as bytes."""
    width = length // parts

    def pack(table: pa.Table) -> pa.RecordBatch:
        flat = table["__v"].combine_chunks()
        v = np.floor(SCALE * flat.flatten().to_numpy(zero_copy_only=False)).reshape(-1, parts, width)
        if len(v) and 4 * np.abs(v).max() ** 2 * width >= 1 << 62:
            raise ValueError("vectors are too large for exact distances in 64 bits")
        v = v.astype(np.int64)
        orders, data, lo, hi, total = [], [], [], [], []
        cut = np.arange(0, len(v), BLOCK)
        for p in range(parts):
            o = curve_order(v[:, p])
            x = v[o, p]
            orders.append(o)
            data.append(x)
            lo.append(np.minimum.reduceat(x, cut))
            hi.append(np.maximum.reduceat(x, cut))
            total.append(np.add.reduceat(x, cut))
        kind = np.int16 if np.abs(v).max() < 1 << 15 else np.int64
        row = [table["id"].combine_chunks(), table["label"].combine_chunks()]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), c) for c in row]
        blobs = [pa.array([np.stack(z).astype(t).tobytes()], pa.binary()) for z, t in ((orders, np.uint16), (data, kind), (lo, kind), (hi, kind), (total, np.int64))]
        return pa.RecordBatch.from_arrays([*lists, pa.array([len(v)], pa.int32()), *blobs], schema=types)

    def run(batches):
        fresh()
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += len(b)
            if n >= CHUNK:
                t = pa.Table.from_batches(held)
                while n >= CHUNK:
                    yield pack(t.slice(0, CHUNK))
                    t = t.slice(CHUNK)
                    n = len(t)
                held = t.to_batches()
        if n:
            yield pack(pa.Table.from_batches(held))

    return run


def _each(batch: pa.RecordBatch, parts: int, width: int):
    """The chunks of a batch: (row, n, order, data, lo, hi, total)."""
    for r in range(len(batch)):
        n = batch["n"][r].as_py()
        raw = {c: batch[c][r].as_buffer() for c in ("order", "data", "lo", "hi", "total")}
        kind = np.int16 if raw["data"].size == n * parts * width * 2 else np.int64
        data = np.frombuffer(raw["data"], kind).reshape(parts, n, width).astype(np.int64)
        box = [np.frombuffer(raw[c], t).reshape(parts, -1, width).astype(np.int64) for c, t in (("lo", kind), ("hi", kind), ("total", np.int64))]
        yield r, n, np.frombuffer(raw["order"], np.uint16).reshape(parts, n), data, *box


def _sums(books: np.ndarray, types: pa.Schema):
    """Counts and sums of each entry's parts over a task."""
    parts, size, width = books.shape

    def run(batches):
        fresh()
        count, total = np.zeros((parts, size), np.int64), np.zeros((parts, size, width), np.int64)
        for b in batches:
            for _, n, _, data, lo, hi, sums in _each(b, parts, width):
                rows = np.minimum(BLOCK, n - BLOCK * np.arange(lo.shape[1]))
                for p in range(parts):
                    whole, pick = nearest(data[p], lo[p], hi[p], books[p])
                    took = whole >= 0
                    np.add.at(count[p], whole[took], rows[took])
                    np.add.at(total[p], whole[took], sums[p][took])
                    single = ~np.repeat(took, BLOCK)[:n]
                    np.add.at(count[p], pick[single], 1)
                    np.add.at(total[p], pick[single], data[p][single])
        part, entry = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry]), pa.array(list(total[part, entry]), pa.list_(pa.int64()))], schema=types)

    return run


def _codes(books: np.ndarray, types: pa.Schema):
    parts, _, width = books.shape

    def run(batches):
        fresh()
        for b in batches:
            for r, n, order, data, lo, hi, _ in _each(b, parts, width):
                code, error = np.zeros((n, parts), np.uint8), np.zeros(n, np.int64)
                for p in range(parts):
                    _, pick = nearest(data[p], lo[p], hi[p], books[p])
                    code[order[p], p] = pick
                    error[order[p]] += ((data[p] - books[p][pick]) ** 2).sum(1)
                ids, labels = (b[c].slice(r, 1).flatten() for c in ("ids", "labels"))
                hexed = code.tobytes().hex()
                text = [hexed[2 * parts * k : 2 * parts * (k + 1)] for k in range(n)]
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(text), pa.array(error)], schema=types)

    return run


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def fit_and_encode(vectors: DataFrame, parts: int = 16, size: int = 64, rounds: int = 2, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, np.ndarray]:
    """(codes, books): a row (id_col, label, code, error) per row that takes part (see vectors.usable), and the
    final codebooks (parts, entries, width) of integers.

    A component x is the integer floor(256 x). Codebooks begin as the parts of the `size` rows of smallest id (equal
    ids: smallest vector; null ids come last; fewer rows: fewer entries). A round assigns every part to its nearest
    entry, ties to the lower index, and moves entries to floor(sum / count); unused ones stay. The vectors' length must
    be a multiple of `parts`, and `size` at most 256. Repeated rows count each.

    The driver holds the codebooks, whose size the parameters give. Sums are whole numbers, so results don't depend on
    how rows are dealt."""
    if not 1 <= size <= 256:
        raise ValueError("a code has two hex digits: size is 1 to 256")
    rows, length = usable(vectors, vector, [F.col(id_col).alias("id"), F.col(label).alias("label")])
    if length % parts:
        raise ValueError(f"vectors of {length} components can't be cut into {parts} equal parts")
    width = length // parts
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("id", "label")}
    first = rows.orderBy(F.col("id").asc_nulls_last(), "__v").limit(size).collect() if length else []
    books = np.floor(SCALE * np.array([x["__v"] for x in first], float).reshape(len(first), parts, width)).astype(np.int64).transpose(1, 0, 2)
    out = f"id {kinds['id']}, label {kinds['label']}, code string, error long"
    if not first:
        return rows.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).where("false"), books
    chunk = f"ids array<{kinds['id']}>, labels array<{kinds['label']}>, n int, order binary, data binary, lo binary, hi binary, total binary"
    chunks = stored(rows.mapInArrow(_chunks(parts, length, _arrow(chunk)), chunk))
    sums = "part int, entry int, n long, sums array<long>"
    for _ in range(rounds):
        partial = chunks.mapInArrow(_sums(books, _arrow(sums)), sums)
        moved = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(width)))
        books = books.copy()
        for x in moved.collect():
            books[x["part"], x["entry"]] = [x[f"s{k}"] // x["n"] for k in range(width)]
    return chunks.mapInArrow(_codes(books, _arrow(out)), out), books


def books_text(books: np.ndarray) -> str:
    """All entries' components in decimal, by part, entry and position, joined by commas."""
    return ",".join(map(str, books.ravel().tolist()))


def code_report(vectors: DataFrame, **how) -> DataFrame:
    """One row per row that takes part: vec_id, code, error, label_error, codebooks_sha256.

    Codes and errors are those of fit_and_encode; label_error is the error summed over equal labels, nulls together.
    An empty table gives no rows; other columns are ignored."""
    codes, books = fit_and_encode(vectors, **how)
    codes = stored(codes)
    by_label = if_small(stored(codes.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error"))))
    out = codes.join(by_label, codes["label"].eqNullSafe(by_label["__label"]))
    return out.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(hashlib.sha256(books_text(books).encode()).hexdigest()).alias("codebooks_sha256"))


def _assign(name: str, book: str) -> str:
    return f"""{name} AS (SELECT v.r, v.p, min(((v.x1-c.x1)*(v.x1-c.x1)+(v.x2-c.x2)*(v.x2-c.x2)+(v.x3-c.x3)*(v.x3-c.x3)+(v.x4-c.x4)*(v.x4-c.x4))*64+c.e) AS k
  FROM cut v JOIN {book} c ON v.p = c.p GROUP BY v.r, v.p)"""


def _move(name: str, took: str, book: str) -> str:
    mean = ", ".join(f"CAST(floor(CAST(sum(v.x{k}) AS DOUBLE)/count(*)) AS BIGINT) AS x{k}" for k in (1, 2, 3, 4))
    return f"""{name} AS (SELECT c.p, c.e, {", ".join(f"coalesce(m.x{k}, c.x{k}) AS x{k}" for k in (1, 2, 3, 4))} FROM {book} c LEFT JOIN
  (SELECT v.p, t.k % 64 AS e, {mean} FROM cut v JOIN {took} t ON v.r = t.r AND v.p = t.p GROUP BY v.p, t.k % 64) m ON m.p = c.p AND m.e = c.e)"""


#: DuckDB, for the given table's vectors of 64 components.
ORACLE_SQL = f"""
WITH whole AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cut AS (SELECT r, p, v[4*p+1] AS x1, v[4*p+2] AS x2, v[4*p+3] AS x3, v[4*p+4] AS x4 FROM whole, range(16) t(p)),
b0 AS (SELECT p, r - 1 AS e, x1, x2, x3, x4 FROM cut WHERE r <= 64),
{_assign("a1", "b0")},
{_move("b1", "a1", "b0")},
{_assign("a2", "b1")},
{_move("b2", "a2", "b1")},
{_assign("a3", "b2")},
coded AS (SELECT r, string_agg(printf('%02x', k % 64), '' ORDER BY p) AS code, CAST(sum(k // 64) AS BIGINT) AS error FROM a3 GROUP BY r),
books AS (SELECT sha256(string_agg(x1 || ',' || x2 || ',' || x3 || ',' || x4, ',' ORDER BY p, e)) AS h FROM b2)
SELECT w.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY w.label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM whole w JOIN coded c ON w.r = c.r, books
"""
