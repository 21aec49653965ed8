"""N-gram Jaccard self-join by MinHash banding, with every candidate verified on its full n-gram set."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import U, mix, ngrams, over_batches, slices, stored, utf8, words

#: Documents of one verification block; two blocks meet in a task.
SIDE = 256


def bands_for(threshold: float, recall: float, most: int = 128) -> tuple[int, int]:
    """(bands, rows): the largest number of rows a band, and then the fewest bands, for which a pair
    at the threshold meets in some band with at least the wanted recall within `most` hashes."""
    for rows in range(16, 0, -1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows <= most:
            return bands, rows
    raise ValueError("no banding reaches that recall")


def _shingles(data, offs, n):
    """Hash and row of each n-gram; a row of fewer than n words has one gram of all its words."""
    h, row, _, _ = words(data, offs)
    g, at = ngrams(h, row, n)
    r = row[at]
    count = np.bincount(row, minlength=len(offs) - 1)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        first = np.searchsorted(row, short)
        s = np.zeros(len(short), U)
        for k in range(n - 1):
            w = h[np.minimum(first + k, len(h) - 1)]
            s = np.where(k < count[short], mix(s * U(31) + w), s)
        g, r = np.concatenate((g, s)), np.concatenate((r, short))
        order = np.argsort(r, kind="stable")
        g, r = g[order], r[order]
    return g, r, count


def _signer(n: int, bands: int, rows: int):
    def make():
        rng = np.random.default_rng(7)
        mul = rng.integers(0, 1 << 63, bands * rows, dtype=U) * U(2) + U(1)
        add = rng.integers(0, 1 << 63, bands * rows, dtype=U)

        def f(batch):
            data, offs = utf8(batch["text"])
            for i, j in slices(offs):
                part, o = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                g, r, count = _shingles(part, o, n)
                have, starts = np.unique(r, return_index=True)
                sig = np.empty((len(have), bands * rows), U)
                for k in range(bands * rows if len(have) else 0):
                    sig[:, k] = np.minimum.reduceat(g * mul[k] + add[k], starts)
                keys = np.zeros((len(have), bands), U)
                for k in range(rows):
                    keys = mix(keys + sig[:, k::rows][:, :bands] + U(k))
                keys = mix(keys + np.arange(bands, dtype=U)).view(np.int64)
                out = [None] * (j - i)
                for x, row in zip(have.tolist(), keys.tolist(), strict=True):
                    out[x] = row
                raw = part.tobytes()
                yield {
                    "doc_id": batch["doc_id"].slice(i, j - i),
                    "digest": [hashlib.md5(raw[o[k] : o[k + 1]]).digest() for k in range(j - i)],
                    "bands": out,
                }

        return f

    return make


def _setter(n: int):
    def make():
        def f(batch):
            data, offs = utf8(batch["text"])
            for i, j in slices(offs):
                g, r, _ = _shingles(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], n)
                cut = np.searchsorted(r, np.arange(j - i + 1))
                raw = data[offs[i] : offs[j]].tobytes()
                o = offs[i : j + 1] - offs[i]
                yield {"id": batch["doc_id"].slice(i, j - i), "digest": [hashlib.md5(raw[o[k] : o[k + 1]]).digest() for k in range(j - i)], "grams": [np.unique(g[cut[k] : cut[k + 1]]).tobytes() for k in range(j - i)]}

        return f

    return make


def linked(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Boolean matrix of which sets reach the Jaccard threshold, exactly.

    Only grams that two of the sets share can add to an intersection, so those become columns of a
    0/1 matrix, a few thousand at a time, and a matrix product counts all intersections.
    """
    m, sizes = len(sets), np.array([len(s) for s in sets])
    gram, who = np.concatenate(sets), np.repeat(np.arange(m), sizes)
    order = np.argsort(gram, kind="stable")
    gram, who = gram[order], who[order]
    new = np.ones(len(gram), bool)
    new[1:] = gram[1:] != gram[:-1]
    col = np.cumsum(new) - 1
    shared = np.bincount(col)[col] > 1
    who, col = who[shared], col[shared]
    _, col = np.unique(col, return_inverse=True)
    both = np.zeros((m, m), np.float64)
    width = max(256, (1 << 21) // max(m, 1))
    for lo in range(0, int(col.max()) + 1 if len(col) else 0, width):
        a, b = np.searchsorted(col, (lo, lo + width))
        x = np.zeros((m, width), np.float32)
        x[who[a:b], col[a:b] - lo] = 1
        both += x @ x.T
    union = sizes[:, None] + sizes[None, :] - both
    out = both >= threshold * union - 1e-9
    np.fill_diagonal(out, False)
    return out


def _verifier(threshold: float):
    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for _, part in pdf.groupby("comp", sort=False):
            side = part["side"].to_numpy()
            hit = linked([np.frombuffer(x, U) for x in part["grams"]], threshold)
            if side[0]:
                hit &= side[:, None] != side[None, :]  # two different blocks: pairs inside one are another task's
            ids, degree = part["id"].to_numpy(), hit.sum(1)
            # a forest of the links is enough for components; degrees carry the counts
            seen = np.zeros(len(ids), bool)
            up = ids.copy()
            for k in range(len(ids)):
                if seen[k] or not degree[k]:
                    continue
                front, seen[k] = np.array([k]), True
                while len(front):
                    reach = hit[front] & ~seen
                    new = np.flatnonzero(reach.any(0))
                    up[new] = ids[front[reach[:, new].argmax(0)]]
                    seen[new] = True
                    front = new
            rows += [(a, b, int(c)) for a, b, c in zip(ids.tolist(), up.tolist(), degree, strict=True) if c]
        return pd.DataFrame(rows, columns=["id", "up", "links"])

    return f


def jaccard_classes(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.999, side: int = SIDE) -> DataFrame:
    """One row per doc_id: class_id (smallest doc_id of its class), copy_of (smallest doc_id with
    the same text), n_copies, and n_links (different texts whose n-gram Jaccard with it is at least
    `threshold`).

    Exact copies meet by digest first, so a text takes part once however often it is repeated.
    Bands then give candidates; candidate components are cut into blocks of `side` texts, and every
    pair of blocks of a component is one task that counts all links between the two on full n-gram
    sets and returns degrees and a spanning forest, never pairs. A group of copies therefore costs
    one row per text and block, not one per pair.

    Null text counts as empty; empty texts are copies of each other and have no links. Texts of
    fewer than n words are one gram of all words. Rows without doc_id are left out; rows that
    repeat a doc_id are one document (the text of the smallest MD5). doc_id keeps its type, whole numbers or
    text. Components are followed until they settle, however long their chains. Other columns are ignored.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("doc_id is not null")
    key = docs.schema["doc_id"].dataType.simpleString()
    count, rows = bands_for(threshold, recall)
    signed = over_batches(docs, _signer(n, count, rows), f"doc_id {key}, digest binary, bands array<long>")
    one = signed.groupBy("doc_id").agg(F.min_by(F.struct("digest", "bands"), "digest").alias("s")).select("doc_id", "s.*")
    one = stored(one)
    heads = one.groupBy("digest").agg(F.min("doc_id").alias("id"), F.count("*").alias("n_copies"), F.min_by("bands", "doc_id").alias("bands"))
    heads = stored(heads)
    member = one.select("doc_id", "digest").join(heads.select("digest", "id", "n_copies"), "digest").select("doc_id", "id", "n_copies")

    band = heads.where("bands is not null").select("id", F.explode("bands").alias("band"))
    low = band.groupBy("band").agg(F.min("id").alias("low"), F.count("*").alias("c")).where("c > 1").select("band", "low")
    maybe = components(band.join(low, "band").where("id <> low").select(F.col("id").alias("src"), F.col("low").alias("dst")))
    # serial numbers inside a component without sorting it in one task: hash blocks of about `side`
    size = maybe.groupBy("comp").agg(F.count("*").alias("size"))
    parts = F.ceil(F.col("size") / F.lit(side)).cast("int")
    place = maybe.join(size, "comp").select("id", "comp", parts.alias("parts"), F.pmod(F.xxhash64("id"), parts.cast("long")).cast("int").alias("part"))
    place = stored(place)
    total = place.where("parts = 1").count()
    text = docs.join(place.select(F.col("id").alias("doc_id")).hint("shuffle_hash"), "doc_id", "left_semi")
    # rows that repeat a doc_id give several sets: one of the document's own digest is used
    sets = over_batches(text, _setter(n), f"id {key}, digest binary, grams binary")
    own = place.join(heads.select("id", "digest"), "id")
    held = own.join(sets, ["id", "digest"]).groupBy("id", "comp", "parts", "part").agg(F.first("grams").alias("grams"))
    lone = held.where("parts = 1").select("id", "comp", "grams", F.lit(0).alias("side"), F.concat(F.lit("s"), F.pmod(F.xxhash64("comp"), F.lit(max(1, total // side)))).alias("task"))
    wide = held.where("parts > 1").select("id", "comp", "grams", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    wide = wide.select("id", "comp", "grams", F.when(F.col("part") == F.col("other"), 0).when(F.col("part") < F.col("other"), 1).otherwise(2).alias("side"), F.concat_ws(":", F.lit("w"), "comp", F.least("part", "other"), F.greatest("part", "other")).alias("task"))
    found = stored(lone.unionByName(wide).groupBy("task").applyInPandas(_verifier(threshold), f"id {key}, up {key}, links long"))

    links = found.groupBy("id").agg(F.sum("links").alias("n_links"))
    comp = components(found.where("id <> up").select(F.col("id").alias("src"), F.col("up").alias("dst")))
    low = member.join(comp, "id", "left").select("doc_id", F.coalesce("comp", "id").alias("class_id"), F.col("id").alias("copy_of"), "n_copies", "id")
    return low.join(links, "id", "left").select("doc_id", "class_id", "copy_of", "n_copies", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def keep_one(docs: DataFrame, **kw) -> DataFrame:
    """The rows of docs that stay when one document of each class stays: the one with the smallest
    doc_id. Of rows that share it, the one whose text is that of the class stays (smallest MD5, then
    smallest hash of the row), once; rows without doc_id stay as they are."""
    cls = jaccard_classes(docs, **kw).where("doc_id = class_id").select(F.col("doc_id").alias("__id"))
    some = docs.where("doc_id is not null")
    some = some.join(cls.hint("shuffle_hash"), some["doc_id"] == cls["__id"], "left_semi")
    plain = [c for c, t in docs.dtypes if "map<" not in t and "variant" not in t]
    first = F.min_by(F.struct(*docs.columns), F.struct(F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))), F.xxhash64(*plain)))
    one = some.groupBy("doc_id").agg(first.alias("__row")).select("__row.*")
    return one.unionByName(docs.where("doc_id is null"))
