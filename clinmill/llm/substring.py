"""Substring dedup: content-defined chunks by a gear rolling hash, deduplicated by digest."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import HEAD, RAND, U, if_small, mix, over_batches, powers, slices, stored, utf8

#: Bits 11 to 15 of the hash decide a cut, so a cut depends on the 16 bytes before it alone.
LOOK, CUT_MASK, SPACING, LONGEST = 16, 0x1F << 11, 12, 256
_GEAR = np.random.default_rng(11).integers(0, 1 << 32, 256, dtype=np.uint32)


def cuts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sorted chunk starts of the rows, row starts included.

    The gear hash h = 2h + gear[byte] over the last 16 bytes is summed by doubling. A position cuts
    if the masked bits are zero and no other such position lies in the SPACING bytes before it; so
    cuts depend on nearby bytes only, and an insertion shifts no later cut. Runs without a cut are
    split every LONGEST bytes.
    """
    h = _GEAR[data]
    step = 1
    while step < LOOK:
        h[step:] += h[:-step] << np.uint32(step)
        step *= 2
    c = np.flatnonzero((h & np.uint32(CUT_MASK)) == 0) + 1
    row = np.searchsorted(offs, c, "right") - 1
    c = c[(c - offs[np.minimum(row, len(offs) - 1)] >= LOOK) & (c < len(data))]
    if len(c):
        c = c[np.concatenate(([True], np.diff(c) >= SPACING))]
    starts = offs[:-1][offs[1:] > offs[:-1]]
    c = np.union1d(starts, c)
    if not len(c):
        return c
    gap = np.diff(np.append(c, len(data)))
    more = (gap - 1) // LONGEST
    if more.any():
        at = np.repeat(c, more) + LONGEST * (np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1)
        c = np.union1d(c, at)
    return c


def _digests(data: np.ndarray, c: np.ndarray) -> np.ndarray:
    """64-bit digest of each chunk from running polynomial sums, as words() does for words."""
    p, q = powers(len(data) + 1)
    s = np.zeros(len(data) + 1, U)
    np.cumsum(RAND[data] * p[: len(data)], out=s[1:])
    e = np.append(c[1:], len(data))
    return mix((s[e] - s[c]) * q[c] + (e - c).astype(U))


def _chunker():
    def f(batch):
        data, offs = utf8(batch["text"])
        ids = batch["doc_id"].to_numpy(zero_copy_only=False)
        for i, j in slices(offs, 1 << 21):
            part, o = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            c = cuts(part, o)
            if not len(c):
                continue
            chars = np.concatenate(([0], np.cumsum(HEAD[part])))
            row = np.searchsorted(o, c, "right") - 1
            # rows of no bytes share their offset with the next: take the row that holds the byte
            e = np.append(c[1:], len(part))
            base = chars[o[row]]
            index = np.arange(len(c)) - np.searchsorted(row, row)
            yield {
                "doc_id": ids[i + row],
                "digest": _digests(part, c).view(np.int64),
                "chunk": index.astype(np.int32),
                "c_from": (chars[c] - base).astype(np.int32),
                "c_to": (chars[e] - base).astype(np.int32),
            }

    return f


#: A digest in more than one of so many chunks is hot: there are at most so many, in twice so many parts.
HOT = 5_000


def _held_twice(chunk: DataFrame) -> DataFrame:
    """chunk without digest, with `low`, the smallest doc_id that holds the digest; only where another holds it too.

    Holders are counted with partial sums, so a digest of any frequency meets as a row per task. To bring
    its smallest holder back, a hot digest is split by a hash of its rows into parts as large as a digest that
    is just not hot; the table of the hot ones has at most HOT rows and is broadcast."""
    held = stored(chunk.groupBy("digest").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")).where("low <> high").drop("high"))
    total = held.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    held = held.withColumn("parts", F.ceil(F.col("n") * HOT / F.lit(max(total, 1))).cast("int"))
    hot = F.broadcast(held.where("parts > 1").select("digest", "parts"))
    part = F.pmod(F.xxhash64("doc_id", "chunk"), F.coalesce("parts", F.lit(1)).cast("long")).cast("int")
    low = held.select("digest", "low", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return chunk.join(hot, "digest", "left").withColumn("part", part).drop("parts").join(low, ["digest", "part"]).drop("digest", "part")


def _once(docs: DataFrame) -> DataFrame:
    """(doc_id, text), one row per doc_id: of rows that share one, the text of the smallest MD5.

    Ids are counted without reading texts; only the rows of repeated ids are grouped, with partial results in each task."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("doc_id is not null")
    twice = stored(docs.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__id")))
    if not twice.limit(1).count():
        return docs
    twice = if_small(twice)
    some = docs.join(twice, docs["doc_id"] == twice["__id"], "left_semi")
    digest = F.md5(F.coalesce("text", F.lit("")))
    low = some.groupBy("doc_id").agg(F.min(digest).alias("__low")).withColumnRenamed("doc_id", "__id")
    # the text of the smallest digest in all of these rows, so any of them is the same
    some = some.join(low, (F.col("doc_id") == F.col("__id")) & (digest == F.col("__low"))).groupBy("doc_id").agg(F.first("text").alias("text"))
    return docs.join(twice, docs["doc_id"] == twice["__id"], "left_anti").unionByName(some)


def repeated_passages(docs: DataFrame, min_chars: int = 150) -> DataFrame:
    """Rows (doc_id, c_from, c_to, n_chunks, first_doc, n_later): maximal runs of chunks that also
    occur in another document, of at least min_chars code points; c_from and c_to are code points,
    first_doc the smallest doc_id that holds a chunk of the run, n_later the code points of chunks
    whose first holder is another document (what a dedup removes).

    Each chunk's smallest and largest holder are found by digest, and chunks of one document only go
    no further. No digest meets in one task, not even one that every text holds. Null text counts as
    empty; empty texts have no chunk. Rows without doc_id are left out; a repeated doc_id is one
    document (the text of the smallest MD5, once), so repetition inside it is not reported. doc_id keeps its type.
    Other columns are ignored.
    """
    docs = _once(docs)
    own = docs.schema["doc_id"].dataType.simpleString()
    chunk = _held_twice(over_batches(docs, _chunker, f"doc_id {own}, digest long, chunk int, c_from int, c_to int"))
    doc = Window.partitionBy("doc_id").orderBy("chunk", "c_from")
    run = chunk.withColumn("__new", F.coalesce((F.col("c_from") > F.lag("c_to").over(doc)).cast("int"), F.lit(0)))
    run = run.withColumn("__run", F.sum("__new").over(doc.rowsBetween(Window.unboundedPreceding, 0)))
    later = F.sum(F.when(F.col("low") < F.col("doc_id"), F.col("c_to") - F.col("c_from")).otherwise(0))
    out = run.groupBy("doc_id", "__run").agg(F.min("c_from").alias("c_from"), F.max("c_to").alias("c_to"), F.count("*").alias("n_chunks"), F.min("low").alias("first_doc"), later.cast("long").alias("n_later"))
    return out.where(F.col("c_to") - F.col("c_from") >= min_chars).drop("__run")


def without_repeats(docs: DataFrame, min_chars: int = 150) -> DataFrame:
    """docs with the passages cut out of text that an earlier document (smaller doc_id) holds; the
    rows without doc_id or repeats are unchanged, and so are those of a repeated doc_id whose text isn't the document's."""
    runs = repeated_passages(docs, min_chars).where("first_doc < doc_id and n_later >= 1")
    cut = runs.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("c_from", "c_to"))).alias("__cut")).withColumnRenamed("doc_id", "__id")
    digest = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))
    cut = cut.join(_once(docs).select(F.col("doc_id").alias("__id"), digest.alias("__of")), "__id")

    @F.pandas_udf("string")
    def strip(text: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, ss in zip(text, spans, strict=True):
            if ss is not None and t is not None:
                for s in reversed(list(ss)):
                    t = t[: s["c_from"]] + t[s["c_to"] :]
            out.append(t)
        return pd.Series(out)

    return docs.join(cut, (docs["doc_id"] == cut["__id"]) & (digest == cut["__of"]), "left").withColumn("text", strip("text", "__cut")).drop("__cut", "__id", "__of")

