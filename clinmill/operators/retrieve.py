"""Exact top-k retrieval by vectors, by weighted terms, or by a blend of both, in blocks of rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import spread, stored
from .features import tfidf_fit, tfidf_transform
from .graph import components

#: Rows of a block on either side; terms whose columns are multiplied at once.
BLOCK, WIDTH = 512, 4096
#: Reference rows of an index block, query rows that visit it together, and terms that either holds at most.
INDEX, VISIT, POSTINGS = 16384, 4096, 1 << 21
#: Terms that more than a FIRST-th of an index block's rows hold are multiplied as a matrix, the SHORT most frequent of them at most,
#: for so many queries at once.
FIRST, SHORT, ASKED = 16, 512, 256
#: Parts of either side at which there are tasks enough, so that parts may grow, and how often their rows at most.
SPREAD, GROWN = 8, 8
#: References, and terms of all of them, up to which every task gets the whole side.
FEW, HELD = 2_000, 1 << 20
#: Terms of texts that every task and the driver hold at most.
HOT = 1 << 18
#: Pivots at most (the driver compares them with each other), and what rounding of angles may cost a bound.
PIVOTS, SLACK = 1024, 1e-6


def with_terms(rows: DataFrame, weights: DataFrame, key: str) -> DataFrame:
    """rows with terms and weights (arrays) from (row_id, term, w); rows without terms get empty arrays."""
    t = weights.groupBy(F.col("row_id").alias(key)).agg(F.collect_list(F.struct(F.xxhash64("term").alias("t"), F.col("w").cast("double").alias("w"))).alias("x"))
    out = rows.join(t, key, "left")
    return out.select(*rows.columns, F.coalesce("x.t", F.array().cast("array<bigint>")).alias("terms"), F.coalesce("x.w", F.array().cast("array<double>")).alias("weights"))


def _matrix(vecs: pd.Series, width: int) -> np.ndarray:
    """Unit rows; a null vector is a row of zeros."""
    m = np.zeros((len(vecs), width))
    for k, v in enumerate(vecs):
        if v is not None and len(v):
            m[k, : len(v)] = v
    return m / np.maximum(np.sqrt((m * m).sum(1, keepdims=True)), 1e-300)


def _lexical(a: pd.DataFrame, b: pd.DataFrame) -> np.ndarray:
    """Inner products of sparse rows: the terms that both sides hold become columns, WIDTH at a time."""

    def flat(x: pd.DataFrame):
        n = [len(t) for t in x["terms"]]
        return np.repeat(np.arange(len(x)), n), np.concatenate([np.asarray(t, np.int64) for t in x["terms"]] or [np.empty(0, np.int64)]), np.concatenate([np.asarray(w, float) for w in x["weights"]] or [np.empty(0)])

    (ra, ta, wa), (rb, tb, wb) = flat(a), flat(b)
    both = np.intersect1d(ta, tb)

    def side(r, t, w):
        c = np.searchsorted(both, t)
        ok = (c < len(both)) & (both[np.minimum(c, max(len(both) - 1, 0))] == t) if len(both) else np.zeros(len(t), bool)
        order = np.argsort(c[ok], kind="stable")
        return r[ok][order], c[ok][order], w[ok][order]

    return _product(side(ra, ta, wa), side(rb, tb, wb), len(a), len(b), len(both))


def _product(a: tuple, b: tuple, m: int, n: int, width: int) -> np.ndarray:
    """Inner products of m and n sparse rows, each side (rows, columns, weights) in the order of the columns."""
    out = np.zeros((m, n))
    for lo in range(0, width, WIDTH):
        x, y = np.zeros((m, min(WIDTH, width - lo))), np.zeros((n, min(WIDTH, width - lo)))
        for d, (r, c, w) in ((x, a), (y, b)):
            i, j = np.searchsorted(c, (lo, lo + WIDTH))
            d[r[i:j], c[i:j] - lo] = w[i:j]
        out += x @ y.T
    return out


def _top(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of each row's k largest scores; of equal ones the first column."""
    best = np.argsort(-s, axis=1, kind="stable")[:, :k]
    return np.repeat(np.arange(len(s)), best.shape[1]), best.ravel()


def _best(k: int, alpha: float):
    def f(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(r):
            return pd.DataFrame({"qid": q["qid"][:0], "rid": r["rid"][:0], "score": np.empty(0)})
        r = r.sort_values("rid", kind="stable").reset_index(drop=True)
        s = np.zeros((len(q), len(r)))
        if alpha > 0:
            width = max((len(v) for side in (q, r) for v in side["vec"] if v is not None), default=1)
            s += alpha * (_matrix(q["vec"], width) @ _matrix(r["vec"], width).T)
        if alpha < 1:
            s += (1 - alpha) * _lexical(q, r)
        s = np.round(s, 9)
        rows, best = _top(s, k)  # of equal scores the smallest rid
        return pd.DataFrame({"qid": q["qid"].to_numpy()[rows], "rid": r["rid"].to_numpy()[best], "score": s[rows, best]})

    return f


def block_topk(queries: DataFrame, refs: DataFrame, k: int, alpha: float) -> DataFrame:
    """(qid, rid, score, rank): the k references of the largest alpha * cosine + (1 - alpha) * term product.

    queries are (qid, vec, terms, weights) and refs (rid, vec, terms, weights); a side that alpha leaves out may
    lack its columns. Every query is scored against every reference, in pairs of hashed blocks of about BLOCK
    rows that each keep k a query; the lists of a query meet by a window. Ties go to the smallest rid."""
    cols = (["vec"] if alpha > 0 else []) + (["terms", "weights"] if alpha < 1 else [])
    nq, nr = (max(1, -(-d.count() // BLOCK)) for d in (queries, refs))
    cut = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    others = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.select("qid", *cols, cut("qid", nq).alias("a")).select("*", others(nr).alias("b"))
    r = refs.select("rid", *cols, cut("rid", nr).alias("b")).select("*", others(nq).alias("a"))
    kinds = {n: d.schema[n].dataType.simpleString() for d, n in ((queries, "qid"), (refs, "rid"))}
    s = q.groupBy("a", "b").cogroup(r.groupBy("a", "b")).applyInPandas(_best(k, alpha), f"qid {kinds['qid']}, rid {kinds['rid']}, score double")
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "rid")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


class Index:
    """An inverted index of a block of reference rows: postings by term, terms by row, and a matrix of the frequent terms."""

    def __init__(self, rids: np.ndarray, terms: list[np.ndarray], weights: list[np.ndarray]):
        order = np.argsort(rids, kind="stable")
        size = np.array([len(terms[k]) for k in order], np.int64)
        flat = lambda x, kind: np.concatenate([np.asarray(x[k], kind) for k in order] or [np.empty(0, kind)])
        self._set(rids[order], *_by_term(size, flat(terms, np.int64), flat(weights, float)))

    @classmethod
    def of(cls, *parts: np.ndarray) -> Index:
        """From rids in their order, terms, and by term the places of its postings, rows and weights."""
        index = cls.__new__(cls)
        index._set(*parts)
        return index

    def _set(self, rids: np.ndarray, terms: np.ndarray, at: np.ndarray, rows: np.ndarray, weights: np.ndarray) -> None:
        self.rids, self.terms, self.at, self.rows, self.weights = rids, terms, at.astype(np.int64), rows.astype(np.int64), weights
        n, size = len(rids), np.diff(self.at)
        order = np.argsort(rows, kind="stable")
        self.own, self.w = np.repeat(np.arange(len(terms), dtype=np.int32), size)[order], weights[order]
        self.row_at = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=n))))
        often = np.flatnonzero(size * FIRST > n)
        often = often[np.argsort(-size[often], kind="stable")[:SHORT]]
        self.column = np.full(len(terms), -1)  # of the matrix
        self.column[often] = np.arange(len(often))
        self.matrix = np.zeros((len(often), n), np.float32)
        at = _ranges(self.at[often], size[often])
        self.matrix[np.repeat(np.arange(len(often)), size[often]), rows[at]] = weights[at]
        self.slack = (len(often) + 2) * 2.0**-23 * math.sqrt(float(np.bincount(rows[at], weights[at] ** 2).max())) if len(often) else 0.0
        self.dense = np.zeros(len(terms))

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of the k largest products of at least `least`, ties to the smallest rid."""
        c = np.searchsorted(self.terms, terms)
        c[c == len(self.terms)] = 0
        own = self.terms[c] == terms if len(self.terms) else np.zeros(len(terms), bool)
        return next(self.tops([(c[own], weights[own])], k, least))

    def tops(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, least: float = 0.0):
        """best of each of some queries (places of terms, weights). Frequent terms are multiplied as a matrix of single precision, rare ones summed
        from their postings; rows that the k best may be among, by what rounding can cost, are then summed over their own terms."""
        for lo in range(0, len(queries), ASKED):
            some = queries[lo : lo + ASKED]
            asked = np.zeros((len(some), len(self.matrix)), np.float32)
            for x, (c, w) in zip(asked, some, strict=True):
                col = self.column[c]
                x[col[col >= 0]] = w[col >= 0]
            for x, s, (c, w) in zip(asked, asked @ self.matrix, some, strict=True):
                yield self._top(c, w, s, k, least - 1e-9 - 2 * self.slack * math.sqrt(float(x @ x)), 1e-9 + 2 * self.slack * math.sqrt(float(x @ x)))

    def _top(self, c: np.ndarray, w: np.ndarray, score: np.ndarray, k: int, least: float, slack: float) -> tuple[np.ndarray, np.ndarray]:
        rare = self.column[c] < 0
        a, size = self.at[c[rare]], self.at[c[rare] + 1] - self.at[c[rare]]
        at = _ranges(a, size)
        score = score + np.bincount(self.rows[at], np.repeat(w[rare], size) * self.weights[at], len(self.rids))
        if len(score) > k:
            least = max(least, float(np.partition(score, -k)[-k]) - slack)
        met = np.flatnonzero((score > 0) & (score >= least))
        self.dense[c] = w
        size = self.row_at[met + 1] - self.row_at[met]
        at = _ranges(self.row_at[met], size)
        exact = np.bincount(np.repeat(np.arange(len(met)), size), self.w[at] * self.dense[self.own[at]], len(met))
        self.dense[c] = 0
        exact = np.round(exact, 9)
        order = np.argsort(-exact, kind="stable")[:k]
        order = order[exact[order] > 0]
        return met[order], exact[order]


def _ranges(lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of ranges that begin at lo, one after the other."""
    return np.arange(size.sum()) + np.repeat(lo - np.concatenate(([0], np.cumsum(size)[:-1])), size) if len(lo) else np.empty(0, np.int64)


def _by_term(size: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows of `size` terms as postings: terms, places by term, rows and weights."""
    own, of = np.unique(terms, return_inverse=True)
    by = np.argsort(of, kind="stable")
    at = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(own)))))
    row = np.repeat(np.arange(len(size)), size)[by]
    return own, at, row.astype(np.uint16 if len(size) < 1 << 16 else np.int64), weights[by]


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and all values of an Arrow column of lists."""
    return pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False), column.flatten().to_numpy(zero_copy_only=False)


def _given(b: pa.RecordBatch):
    size, terms = _lists(b.column("terms"))
    return b.column("id"), size, terms, _lists(b.column("weights"))[1]


def _known(terms: np.ndarray, idf: np.ndarray):
    """Rows of Arrow batches (id, terms), a term as often as it occurs: sublinear frequencies times idf, each row of length 1. Other terms
    than the sorted `terms` come weighed, as lists t and w, if at all."""

    def f(b: pa.RecordBatch):
        size, t = _lists(b.column("terms"))
        row, c, w, _ = _counted(size, t, terms, idf)
        t = terms[c]
        if "t" in b.schema.names:
            more, other = _lists(b.column("t"))
            row = np.concatenate((row, np.repeat(np.arange(len(size)), more)))
            by = np.argsort(row, kind="stable")
            row, t, w = row[by], np.concatenate((t, other))[by], np.concatenate((w, _lists(b.column("w"))[1]))[by]
        return b.column("id"), np.bincount(row, minlength=len(size)), t, w / np.sqrt(np.bincount(row, w * w, len(size)))[row]

    return f


def _counted(size: np.ndarray, t: np.ndarray, terms: np.ndarray, idf: np.ndarray):
    """(rows, places, weights) of the known terms of rows, in the order of rows, and whether each of t is known."""
    row = np.repeat(np.arange(len(size)), size)
    c = np.searchsorted(terms, t)
    ok = terms[np.minimum(c, len(terms) - 1)] == t if len(terms) else np.zeros(len(t), bool)
    at, tf = np.unique(row[ok] * max(1, len(terms)) + c[ok], return_counts=True)
    row, c = np.divmod(at, max(1, len(terms)))
    return row, c, (1 + np.log(tf)) * idf[c], ok


def _blocks(rows, most: int, by_term: bool):
    """Blocks of Arrow batches, one a row: ids, and as bytes the terms and either their postings or the terms of each row."""

    def block(ids: pa.Array, size: np.ndarray, t: np.ndarray, w: np.ndarray) -> pa.RecordBatch:
        if by_term:  # of equal scores the smallest id comes first
            order = pc.array_sort_indices(ids).to_numpy()
            at = _ranges((np.cumsum(size) - size)[order], size[order])
            ids, size, t, w = ids.take(pa.array(order)), size[order], t[at], w[at]
            parts = _by_term(size, t, w)
        else:
            own, of = np.unique(t, return_inverse=True)
            parts = own, size.astype(np.int64), of.astype(np.int32), w
        held = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        return pa.RecordBatch.from_arrays([held, *(pa.array([x.tobytes()], pa.binary()) for x in parts)], names=["ids", "terms", "at", "rows", "weights"])

    def f(batches):
        held, n = [], [0, 0]
        whole = lambda: block(pa.concat_arrays([x[0] for x in held]), *(np.concatenate([x[k] for x in held]) for k in (1, 2, 3)))
        for b in batches:
            ids, size, t, w = rows(b)
            end = np.concatenate(([0], np.cumsum(size)))
            lo = 0
            while lo < len(ids):  # as many rows as still fit, one at least
                hi = min(len(ids), lo + most - n[0], int(np.searchsorted(end, end[lo] + POSTINGS - n[1], "right")) - 1)
                hi = max(hi, lo + (not held))
                if hi > lo:
                    held.append((ids.slice(lo, hi - lo), size[lo:hi], t[end[lo] : end[hi]], w[end[lo] : end[hi]]))
                    n = [n[0] + hi - lo, n[1] + int(end[hi] - end[lo])]
                lo = hi
                if lo < len(ids):
                    yield whole()
                    held, n = [], [0, 0]
        if held:
            yield whole()

    return f


def _visits(k: int):
    """Top lists of Arrow batches of pairs of a block of references and one of queries."""

    def f(batches):
        last, index = None, None
        for b in batches:
            for x in range(b.num_rows):
                raw = lambda name, kind, x=x, b=b: np.frombuffer(b.column(name)[x].as_buffer(), kind)
                rids = b.column("rids")[x].values
                if last is None or not last.equals(rids):  # pairs of a block of references follow each other
                    last = rids
                    index = Index.of(np.arange(len(rids)), raw("r_terms", np.int64), raw("r_at", np.int64), raw("r_rows", np.uint16 if len(rids) < 1 << 16 else np.int64), raw("r_weights", float))
                own, size, of, w = raw("terms", np.int64), raw("at", np.int64), raw("rows", np.int32), raw("weights", float)
                c = np.searchsorted(index.terms, own)
                c[c == len(index.terms)] = 0
                c = np.where(index.terms[c] == own, c, -1)[of] if len(index.terms) else np.full(len(of), -1)
                end = np.concatenate(([0], np.cumsum(size)))
                asked = [(x[x >= 0], v[x >= 0]) for x, v in ((c[i:j], w[i:j]) for i, j in zip(end[:-1], end[1:], strict=True))]
                out = [(np.full(len(rows), q), rows, scores) for q, (rows, scores) in enumerate(index.tops(asked, k))]
                at, rows, scores = (np.concatenate([o[j] for o in out]) for j in range(3))
                yield pa.RecordBatch.from_arrays([b.column("ids")[x].values.take(pa.array(at.astype(np.int64))), rids.take(pa.array(rows.astype(np.int64))), pa.array(scores.astype(float))], names=["qid", "rid", "score"])

    return f


def _search(queries: DataFrame, refs: DataFrame, k: int, of=(_given, _given)) -> DataFrame:
    """(qid, rid, score, rank) of rows (id, ...) that `of` weighs. Both sides are written once as blocks; each pair of blocks meets in a task
    that reads them there, so pairs are neither shuffled nor copied, and a block of references keeps k a query."""
    spark = queries.sparkSession
    kind = [d.schema["id"].dataType.simpleString() for d in (queries, refs)]
    block = lambda d, f, most, t: stored(d.mapInArrow(_blocks(f, most, t), f"ids array<{d.schema['id'].dataType.simpleString()}>, terms binary, at binary, rows binary, weights binary"))
    q, r = block(queries, of[0], VISIT, False), block(refs, of[1], min(INDEX, (1 << 16) - 1), True)
    r = r.select(F.col("ids").alias("rids"), *(F.col(c).alias(f"r_{c}") for c in ("terms", "at", "rows", "weights")))
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "1")  # a pair at a time in memory
    try:
        s = stored(r.hint("shuffle_replicate_nl").crossJoin(q).mapInArrow(_visits(k), f"qid {kind[0]}, rid {kind[1]}, score double"))
    finally:
        spark.conf.set(name, before)
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "rid")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _parts(n: int, size: int) -> int:
    """Parts that n rows are cut into: of `size` rows while these are few, then of up to GROWN times as many."""
    return max(1, min(-(-n // size), SPREAD), -(-n // (GROWN * size)))


def sparse_topk(queries: DataFrame, refs: DataFrame, k: int) -> DataFrame:
    """(qid, rid, score, rank): the k references of the largest positive products of weighted terms, exact.

    queries are (qid, term, w) and refs (rid, term, w), a row per term, weights above 0. Ties, to nine decimals, go to
    the smallest rid. Blocks of about INDEX references form inverted indexes, which blocks of VISIT queries visit (_search)."""

    def rows(d: DataFrame, key: str, size: int) -> DataFrame:
        d = stored(d.where(f"w > 0 and {key} is not null").select(F.col(key).alias("id"), F.xxhash64("term").alias("t"), F.col("w").cast("double").alias("w")))
        d = d.repartition(_parts(d.select("id").distinct().count(), size), "id").groupBy("id").agg(F.collect_list(F.struct("t", "w")).alias("x"))
        return d.select("id", F.col("x.t").alias("terms"), F.col("x.w").alias("weights"))

    return _search(rows(queries, "qid", VISIT), rows(refs, "rid", INDEX), k)


def texts_topk(docs: DataFrame, terms: Column, refs: Column, queries: Column, k: int, min_df: int) -> DataFrame:
    """sparse_topk of texts by the terms that each holds, weighed by the references' idf (terms in at least min_df of them), each row of
    length 1. docs are (id, ...), `terms` a text's array of terms, refs and queries say by id which rows are which. Texts of
    one id count as one, in which a term occurs as often as texts hold it.

    Texts are read once, into hashes of their terms. The HOT most frequent terms at most go to every task; only the rare others are
    exchanged, to be weighed."""
    hashed = F.transform(F.array_distinct(F.filter(terms, lambda t: t != "")), lambda t: F.xxhash64(t))
    d = docs.where(F.col("id").isNotNull())
    shared = d.groupBy(F.col("id").alias("__i")).agg(F.count("*").alias("n")).where("n > 1").select("__i")
    if shared.isEmpty():
        d = d.select("id", hashed.alias("terms"))
    else:
        same, d = F.col("id") == F.col("__i"), d.withColumn("terms", hashed).select("id", "terms")
        d = d.join(shared, same, "left_anti").unionByName(d.join(shared, same, "left_semi").groupBy("id").agg(F.flatten(F.collect_list("terms")).alias("terms")))
    d = stored(d.where("size(terms) > 0").withColumns({"r": refs, "q": queries}).where("r or q"))
    n = d.where("r").count()
    df = d.where("r").select(F.explode(F.array_distinct("terms")).alias("t")).groupBy("t").agg(F.count("*").alias("df")).where(F.col("df") >= min_df)
    df = stored(df.select("t", "df", (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1).alias("idf")))
    size = df.groupBy("df").agg(F.count("*").alias("n")).withColumn("m", F.sum("n").over(Window.orderBy(F.desc("df"))))  # a row for each frequency
    least = size.where(F.col("m") <= HOT).agg(F.min("df")).first()[0]
    more = df.where(F.col("df") < least) if least is not None else df
    hot = (df.where(F.col("df") >= least) if least is not None else df.limit(0)).select("t", "idf").toPandas().sort_values("t")  # of HOT terms at most
    known, idf = hot["t"].to_numpy(np.int64), hot["idf"].to_numpy(float)
    of = _known(known, idf)
    rows = d.select("id", "r", "q", "terms")
    if not more.isEmpty():

        def others(batches):
            for b in batches:
                size, t = _lists(b.column("terms"))
                ok = _counted(size, t, known, idf)[3]
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(np.repeat(np.arange(len(size)), size)[~ok])), pa.array(t[~ok])], names=["id", "t"])

        rare = d.mapInArrow(others, f"id {d.schema['id'].dataType.simpleString()}, t bigint").join(more.select("t", "idf").hint("merge"), "t")
        rare = rare.groupBy("id", "t", "idf").agg(F.count("*").alias("tf")).select("id", F.struct("t", ((1 + F.log("tf")) * F.col("idf")).alias("w")).alias("x"))
        rare = stored(rare.groupBy("id").agg(F.collect_list("x").alias("x")))
        rows = rows.join(rare.hint("merge"), "id", "left").select("id", "r", "q", "terms", F.col("x.t").alias("t"), F.col("x.w").alias("w"))
    side = lambda c: rows.where(c).drop("r", "q")
    return _search(side("q"), side("r"), k, (of, of))


def _celled(side: DataFrame, key: str, pivot: np.ndarray) -> DataFrame:
    """side (key, vec) with the nearest pivot `cell` (-1 for a vector that is null or zero) and the `angle` to it."""
    kind = side.schema[key].dataType.simpleString()

    def near(batches):
        for pdf in batches:
            u = _matrix(pdf["vec"], pivot.shape[1])
            cos = u @ pivot.T
            c = cos.argmax(1)
            some = (u != 0).any(1)
            angle = np.arccos(np.clip(cos[np.arange(len(u)), c], -1, 1))
            yield pdf.assign(cell=np.where(some, c, -1).astype("int32"), angle=np.where(some, angle, 0.0))

    return stored(side.select(key, F.col("vec").cast("array<double>").alias("vec")).mapInPandas(near, f"{key} {kind}, vec array<double>, cell int, angle double"))


def _meet(q: DataFrame, r: DataFrame, pairs: list[tuple[int, int]], parts: tuple[dict, dict], k: int) -> DataFrame:
    """Top lists of the pairs of cells, each cut into blocks of about BLOCK rows on either side."""
    data = [(a, b, parts[0][a], parts[1][b]) for a, b in pairs]
    left, right = (q.sparkSession.createDataFrame(data, "a int, b int, nq int, nr int") for _ in range(2))
    block = lambda key, n: F.pmod(F.xxhash64(key), F.col(n).cast("long")).cast("int")
    others = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    x = q.join(left, q["cell"] == left["a"]).select("qid", "vec", "a", "b", block("qid", "nq").alias("i"), others("nr").alias("j"))
    y = r.join(right, r["cell"] == right["b"]).select("rid", "vec", "a", "b", block("rid", "nr").alias("j"), others("nq").alias("i"))
    kinds = {n: d.schema[n].dataType.simpleString() for d, n in ((q, "qid"), (r, "rid"))}
    at = ("a", "b", "i", "j")
    return x.groupBy(*at).cogroup(y.groupBy(*at)).applyInPandas(_best(k, 1.0), f"qid {kinds['qid']}, rid {kinds['rid']}, score double")


def pivot_topk(queries: DataFrame, refs: DataFrame, k: int) -> tuple[DataFrame, float]:
    """((qid, rid, score, rank), share of pairs of cells that were skipped): the k references of the largest cosine, exact,
    as block_topk gives them.

    Every vector belongs to the cell of its nearest pivot (references of the smallest hashes, one for BLOCK rows, at most
    PIVOTS). By the triangle inequality on angles, no vectors of two cells are nearer than their pivots less both cells'
    radii. Queries meet the nearest cells that hold k references first; the worst k-th score of a query cell
    then rules out the cells that can't reach it. Null and zero vectors, whose cosine is 0, have a cell of their own."""
    n = refs.count()
    base = refs.where("vec is not null").orderBy(F.xxhash64("rid"), "rid").limit(min(PIVOTS, max(1, -(-n // BLOCK)))).select("vec").toPandas()
    width = max((len(v) for v in base["vec"]), default=0)
    pivot = _matrix(base["vec"], width)
    pivot = pivot[(pivot != 0).any(1)]
    if not len(pivot):
        return block_topk(queries, refs, k, 1.0), 0.0
    q, r = _celled(queries, "qid", pivot), _celled(refs, "rid", pivot)
    size = lambda d: {x["cell"]: (x["n"], x["far"]) for x in d.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("far")).collect()}
    qs, rs = size(q), size(r)
    parts = tuple({c: -(-m // BLOCK) for c, (m, _) in d.items()} for d in (qs, rs))
    between = np.arccos(np.clip(pivot @ pivot.T, -1, 1))
    gap = lambda a, b: math.pi / 2 if min(a, b) < 0 else max(0.0, between[a, b] - qs[a][1] - rs[b][1])
    first = []
    for a in qs:
        left = k
        for b in sorted(rs, key=lambda b, a=a: (between[a, b] if min(a, b) >= 0 else math.pi / 2, b)):
            if left <= 0:
                break
            first.append((a, b))
            left -= rs[b][0]
    one = stored(_meet(q, r, first, parts, k))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "rid")
    kth = one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select("qid", "score")
    worst = {x["cell"]: x["least"] for x in q.select("qid", "cell").join(kth, "qid").groupBy("cell").agg(F.min("score").alias("least")).collect()}
    done = set(first)
    more = [(a, b) for a in qs for b in rs if (a, b) not in done and math.cos(gap(a, b)) + SLACK >= worst.get(a, -2.0)]
    s = one.unionByName(_meet(q, r, more, parts, k)) if more else one
    out = s.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return out, 1 - (len(first) + len(more)) / max(1, len(qs) * len(rs))


def hybrid_topk(queries: DataFrame, refs: DataFrame, k: int = 5, alpha: float = 0.5) -> DataFrame:
    """Semantic and lexical similarity in one score; see block_topk."""
    return block_topk(queries, refs, k, alpha)


def _few(refs: pd.DataFrame, idf: pd.DataFrame, k: int, alpha: float):
    """Top lists of Arrow batches of (qid, vec, terms) against all of refs (rid, vec, terms, weights), BLOCK rows at a time."""
    refs, idf = refs.sort_values("rid", kind="stable"), idf.sort_values("t")
    terms, idf = idf["t"].to_numpy(), idf["idf"].to_numpy()
    size = [len(t) for t in refs["terms"]]
    col = np.searchsorted(terms, np.concatenate([np.asarray(t, np.int64) for t in refs["terms"]]))
    by = np.argsort(col, kind="stable")
    right = np.repeat(np.arange(len(refs)), size)[by], col[by], np.concatenate([np.asarray(w, float) for w in refs["weights"]])[by]
    rid, vecs = refs["rid"].to_numpy(), refs["vec"]
    most = max((len(v) for v in vecs if v is not None), default=1)

    def weighed(held: pa.Array):
        """Rows by column of the terms that a reference has, weighed as tfidf_transform does."""
        t = held.flatten().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(held)), held.value_lengths().to_numpy(zero_copy_only=False))
        c = np.searchsorted(terms, t)
        ok = terms[np.minimum(c, len(terms) - 1)] == t if len(terms) else np.zeros(len(t), bool)
        at, tf = np.unique(c[ok] * len(held) + row[ok], return_counts=True)
        c, row = np.divmod(at, len(held))
        w = (1 + np.log(tf)) * idf[c]
        return row, c, w / np.sqrt(np.bincount(row, w * w, len(held)))[row]

    def f(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, BLOCK):
                b = whole.slice(lo, BLOCK)
                vec = b.column("vec").to_pandas()
                width = max((len(v) for v in vec if v is not None), default=most)
                s = alpha * (_matrix(vec, max(width, most)) @ _matrix(vecs, max(width, most)).T)
                s += (1 - alpha) * _product(weighed(b.column("terms")), right, b.num_rows, len(rid), len(terms))
                s = np.round(s, 9)
                rows, best = _top(s, k)
                rank = np.tile(np.arange(1, min(k, len(rid)) + 1, dtype="int32"), b.num_rows)
                yield pa.RecordBatch.from_arrays([b.column("qid").take(pa.array(rows)), pa.array(rid[best]), pa.array(s[rows, best]), pa.array(rank)], names=["qid", "rid", "score", "rank"])

    return f


def text_topk(queries: DataFrame, refs: DataFrame, terms: Column, k: int = 5, alpha: float = 0.5) -> DataFrame:
    """hybrid_topk of texts: queries are (qid, vec, text), refs (rid, vec, text), `terms` is a text's array of terms. Terms are
    weighed by the references' idf; texts of one id count as one.

    References of a checked size go to every task, where a query's terms are counted and scored in its own row: terms are
    neither exploded nor exchanged. Queries whose id is null or not unique, and queries of more references, meet in blocks."""

    def exploded(d: DataFrame, key: str) -> DataFrame:
        return d.select(F.col(key).alias("row_id"), F.explode(terms).alias("term"))

    idf = tfidf_fit(exploded(refs, "rid"))
    weights = tfidf_transform(exploded(refs, "rid"), idf)
    blocks = lambda q: hybrid_topk(with_terms(q.select("qid", "vec"), tfidf_transform(exploded(q, "qid"), idf), "qid"), r, k, alpha)
    r = with_terms(refs.select("rid", "vec"), weights, "rid")
    if refs.limit(FEW + 1).count() > FEW or weights.limit(HELD + 1).count() > HELD:
        return blocks(queries)
    r = stored(r)
    side = r.toPandas()
    if not len(side):
        return blocks(queries)
    kinds = {n: d.schema[n].dataType.simpleString() for d, n in ((queries, "qid"), (refs, "rid"))}
    shared = queries.groupBy(F.col("qid").alias("__q")).agg(F.count("*").alias("n")).where("n > 1 or __q is null").select("__q")
    same = F.col("qid").eqNullSafe(F.col("__q"))
    some = not shared.isEmpty()
    own = queries.join(shared, same, "left_anti") if some else queries
    held = F.coalesce(F.transform(terms, lambda t: F.xxhash64(t)), F.array().cast("array<bigint>"))
    own = spread(own, "qid", piece=1 << 20).select("qid", "vec", held.alias("terms"))
    known = idf.select(F.xxhash64("term").alias("t"), "idf").toPandas()  # of HELD terms at most
    out = own.mapInArrow(_few(side, known, k, alpha), f"qid {kinds['qid']}, rid {kinds['rid']}, score double, rank int")
    return out.unionByName(blocks(queries.join(shared, same, "left_semi"))) if some else out


def _forest(tau: float):
    def f(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        x = pd.concat([a, b], ignore_index=True).drop_duplicates("id")
        ids, rows = x["id"].to_numpy(), []
        width = max((len(v) for v in x["vec"] if v is not None), default=1)
        m = _matrix(x["vec"], width)
        near = np.round(m @ m.T, 9) >= tau
        seen = np.zeros(len(ids), bool)
        for k in range(len(ids)):
            if seen[k]:
                continue
            front, seen[k] = np.array([k]), True
            while len(front):
                front = np.flatnonzero(near[front].any(0) & ~seen)
                seen[front] = True
                rows += [(ids[k], ids[j]) for j in front.tolist()]
        return pd.DataFrame(rows, columns=["src", "dst"])

    return f


def similarity_groups(rows: DataFrame, tau: float) -> DataFrame:
    """(id, comp) for rows (id, vec): single-link groups of cosine tau and more, comp their smallest id.

    Pairs of hashed blocks meet in a task, which returns a spanning forest of the links in it, never pairs."""
    n = max(1, -(-rows.count() // BLOCK))
    kind = rows.schema["id"].dataType.simpleString()
    part = rows.select("id", "vec", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("p"))
    both = part.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("o"))
    both = both.select("id", "vec", F.least("p", "o").alias("a"), F.greatest("p", "o").alias("b"), (F.col("p") <= F.col("o")).alias("left"))
    edge = both.where("left").groupBy("a", "b").cogroup(both.where("not left").groupBy("a", "b")).applyInPandas(_forest(tau), f"src {kind}, dst {kind}")
    group = components(edge)
    return rows.select("id").join(group, "id", "left").select("id", F.coalesce("comp", "id").alias("comp"))
