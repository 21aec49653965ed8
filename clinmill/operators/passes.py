"""Sums over all rows of a table of feature vectors, taken in tasks and added up: what the fits below iterate.

Fits read their rows in every pass, so these are folded and packed once: rows that agree become one row that weighs as
many, and thousands of rows lie side by side in a block, which a pass reads without a step per row."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored

#: Entries of a block (and so of the rows that a task compares at a time), and entries up to which all blocks go to one task.
ENTRIES, ALONE = 1 << 18, 1 << 19
#: Width up to which sparse vectors are taken as dense ones.
NARROW = 32


class Rows:
    """A batch of feature vectors, dense or sparse, with a last column of ones."""

    def __init__(self, pdf: pd.DataFrame, width: int):
        self.n, self.width = len(pdf), width
        index = pdf["xi"]
        self.full = np.stack(pdf["xv"].to_numpy()) if self.n and index.isna().all() else None
        if self.full is None:
            cols = [np.arange(len(v)) if i is None else np.asarray(i, np.int64) for i, v in zip(index, pdf["xv"], strict=True)]
            self.row = np.repeat(np.arange(self.n), [len(c) for c in cols])
            self.col = np.concatenate([*cols, np.empty(0, np.int64)]).astype(np.int64)
            self.val = np.concatenate([*pdf["xv"], np.empty(0)]).astype(float)

    @classmethod
    def block(cls, x, width: int) -> Rows:
        """The rows of a block of packed."""
        out = cls.__new__(cls)
        size, out.n, out.width = np.frombuffer(x.size, np.int32), x.rows, width
        val = np.frombuffer(x.val, float)
        out.full = None if len(size) else val.reshape(out.n, width)
        if len(size):
            out.row, out.col, out.val = np.repeat(np.arange(out.n), size), np.frombuffer(x.col, np.int32).astype(np.int64), val
        return out

    def dot(self, w: np.ndarray) -> np.ndarray:
        """(rows, k) products with coefficients (width + 1, k)."""
        if self.full is not None:
            return self.full @ w[:-1] + w[-1]
        out = np.tile(w[-1], (self.n, 1))
        if len(self.val):
            at, first = np.unique(self.row, return_index=True)
            out[at] += np.add.reduceat(self.val[:, None] * w[self.col], first)
        return out

    def tdot(self, r: np.ndarray) -> np.ndarray:
        """(width + 1, k): products of the columns with residuals (rows, k)."""
        out = np.zeros((self.width + 1, r.shape[1]))
        out[-1] = r.sum(0)
        if self.full is not None:
            out[:-1] = self.full.T @ r
        elif len(self.val):
            order = np.argsort(self.col, kind="stable")
            at, first = np.unique(self.col[order], return_index=True)
            out[at] = np.add.reduceat(self.val[order, None] * r[self.row[order]], first)
        return out

    def dense(self) -> np.ndarray:
        out = np.zeros((self.n, self.width + 1))
        out[:, -1] = 1.0
        if self.full is not None:
            out[:, :-1] = self.full
        else:
            out[self.row, self.col] = self.val
        return out


def vectors(df: DataFrame, features: str, *keep: str) -> DataFrame:
    """df with the vector column as its indices `xi` (null if dense) and values `xv`."""
    x = F.unwrap_udt(features)
    return df.select(*keep, x["size"].alias("xn"), x["indices"].alias("xi"), x["values"].alias("xv"))


def matrix(batch: pa.RecordBatch) -> np.ndarray | None:
    """The vectors of an Arrow batch with (xn, xi, xv) as rows of a matrix; None if they are of several widths, or sparse
    and wide."""
    at, size = batch.column("xi"), batch.column("xv").value_lengths().to_numpy(zero_copy_only=False)
    val = batch.column("xv").flatten().to_numpy(zero_copy_only=False)
    if at.null_count == len(at):
        return val.reshape(len(size), size[0]) if len(size) and (size == size[0]).all() else None
    sparse = at.is_valid().to_numpy(zero_copy_only=False)
    width = np.where(sparse, batch.column("xn").to_numpy(zero_copy_only=False), size)
    if (width != width[0]).any() or width[0] > NARROW:
        return None
    row, col = np.repeat(np.arange(len(size)), size), np.arange(len(val)) - np.repeat(np.cumsum(size) - size, size)
    col[sparse[row]] = at.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(size), int(width[0])))
    out[row, col] = val
    return out


def _folded(x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different rows of a matrix, by their bytes, and the sums of their weights."""
    x = np.ascontiguousarray(x)
    _, first, of = np.unique(x.view(np.dtype((np.void, x.shape[1] * 8))).ravel(), return_index=True, return_inverse=True)
    return x[first], np.bincount(of.ravel(), n, len(first))


def packed(rows: DataFrame) -> tuple[DataFrame, int]:
    """Rows (xn, xi, xv, y array<double>, n double) as stored blocks (rows, width, entries, size, col, val, ysize, y, n), and
    the width of the vectors.

    A task adds up the weights n of rows that agree in everything else among those that it holds, ENTRIES entries or
    one row. Vectors are flat: of dense ones only `val` is filled, sparse ones have their sizes and columns too. Dense and
    narrow ones are folded as matrices, a batch at a time; the others row by row."""

    def block(kept: dict, wide: int) -> pd.DataFrame:
        index, value, y = zip(*kept, strict=True)
        v, t = [np.frombuffer(b, float) for b in value], [np.frombuffer(b, float) for b in y]
        dense = all(i is None for i in index) and len({len(a) for a in v}) == 1
        i = [] if dense else [np.arange(len(a), dtype=np.int32) if b is None else np.frombuffer(b, np.int32) for a, b in zip(v, index, strict=True)]
        size = [] if dense else [len(a) for a in v]
        raw = lambda a, kind: np.asarray(a, kind).tobytes()
        one = {"rows": len(v), "width": wide, "entries": sum(map(len, v)) + sum(map(len, t)) + len(v), "size": raw(size, np.int32), "col": b"".join(a.tobytes() for a in i), "val": b"".join(value)}
        return pd.DataFrame([one | {"ysize": raw([len(a) for a in t], np.int32), "y": b"".join(y), "n": raw(list(kept.values()), float)}])

    def flat(x: np.ndarray, n: np.ndarray, d: int) -> pd.DataFrame:
        """A block of rows of a matrix: d entries of a vector, the number of y, and y."""
        size = x[:, d].astype(np.int32)
        y = x[:, d + 1 :][np.arange(x.shape[1] - d - 1) < size[:, None]]
        one = {"rows": len(x), "width": d, "entries": len(x) * (d + 1) + len(y), "size": b"", "col": b"", "val": x[:, :d].tobytes()}
        return pd.DataFrame([one | {"ysize": size.tobytes(), "y": y.tobytes(), "n": n.tobytes()}])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        kept: dict[tuple, float] = {}
        entries = wide = d = 0
        full, weight = np.empty((0, 1)), np.empty(0)
        for batch in batches:
            if not batch.num_rows:
                continue
            if (x := matrix(batch)) is not None and x.shape[1]:
                size, y = batch.column("y").value_lengths().to_numpy(zero_copy_only=False), batch.column("y").flatten().to_numpy(zero_copy_only=False)
                if x.shape[1] != d and len(full):
                    yield flat(full, weight, d)
                    full, weight = np.empty((0, 1)), np.empty(0)
                d = x.shape[1]
                most = max(int(size.max()), full.shape[1] - d - 1, 0)
                new = np.zeros((len(full) + len(x), d + 1 + most))
                new[: len(full), : full.shape[1]] = full
                mine = new[len(full) :]
                mine[:, :d], mine[:, d] = x, size
                mine[:, d + 1 :][np.arange(most) < size[:, None]] = y
                full, weight = _folded(new, np.concatenate([weight, batch.column("n").to_numpy(zero_copy_only=False)]))
                step = max(1, ENTRIES // full.shape[1])
                while len(full) >= step:
                    yield flat(full[:step], weight[:step], d)
                    full, weight = full[step:], weight[step:]
                continue
            pdf = batch.to_pandas()
            wide = max(wide, int(pdf["xn"].fillna(pdf["xv"].map(len)).max()))
            for i, v, y, n in zip(pdf["xi"], pdf["xv"], pdf["y"], pdf["n"], strict=True):
                key = None if i is None else np.asarray(i, np.int32).tobytes(), np.asarray(v, float).tobytes(), np.asarray(y, float).tobytes()
                if key in kept:
                    kept[key] += n
                    continue
                kept[key] = n
                entries += len(v) + len(y) + 1
                if entries >= ENTRIES:
                    yield block(kept, wide)
                    kept, entries = {}, 0
        if len(full):
            yield flat(full, weight, d)
        if kept:
            yield block(kept, wide)

    def out_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("rows", pa.int32()), ("width", pa.int32()), ("entries", pa.int64()), *((c, pa.binary()) for c in ("size", "col", "val", "ysize", "y", "n"))])
        for pdf in run(batches):
            yield pa.RecordBatch.from_pandas(pdf, schema=kinds, preserve_index=False)

    out = stored(rows.select("xn", "xi", "xv", "y", "n").mapInArrow(out_of, "rows int, width int, entries long, size binary, col binary, val binary, ysize binary, y binary, n binary"))
    head = out.agg(F.sum("entries").alias("e"), F.max("width").alias("d")).first()
    return out.coalesce(1) if (head["e"] or 0) <= ALONE else out, head["d"] or 0


def opened(pdf: pd.DataFrame, width: int) -> Iterator[tuple[Rows, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each block its rows, the row and value of every entry of y, and the weights."""
    for x in pdf.itertuples(index=False):
        yield Rows.block(x, width), np.repeat(np.arange(x.rows), np.frombuffer(x.ysize, np.int32)), np.frombuffer(x.y, float), np.frombuffer(x.n, float)


def summed(rows: DataFrame, step: Callable[[pd.DataFrame], np.ndarray], size: int) -> np.ndarray:
    """The sum over all batches of rows of step(batch), an array of `size` numbers; a task sends one such array."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size)
        for pdf in batches:
            total += step(pdf)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"k": at.astype(np.int32), "s": total[at]})

    out = np.zeros(size)
    got = rows.mapInPandas(run, "k int, s double").groupBy("k").agg(F.sum("s").alias("s")).toPandas()
    out[got["k"].to_numpy()] = got["s"].to_numpy()
    return out
