"""Benchmark decontamination by spaced-seed hashing with substitution-tolerant verification."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FOLD, NOT_ALNUM, U, hash_words, mix, over_batches, slices, stored, utf8, words

#: Fixed masks over token positions; 0 positions are ignored, so a changed token there still hits.
#: The last two pass by every fourth and every fifth token.
MASKS = ("1110110110111", "1101011100111011", "111100101101111", "11101110111011", "11110111101111")
#: Bits of the largest membership filter: 64 MB, whatever the size of the benchmark.
MOST_BITS = 29


def seeds(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first token) of every spaced seed that lies within a row."""
    keys, ats = [], []
    for k, mask in enumerate(MASKS):
        m = len(h) - len(mask) + 1
        if m <= 0:
            continue
        g = np.full(m, 1 + k, U)
        for x, bit in enumerate(mask):
            if bit == "1":
                g = g * U(0xD6E8FEB86659FD93) + h[x : x + m]
        at = np.flatnonzero(row[:m] == row[len(mask) - 1 :])
        keys.append(mix(g[at]))
        ats.append(at)
    if not keys:
        return np.empty(0, U), np.empty(0, np.int64)
    return np.concatenate(keys), np.concatenate(ats)


def _bench(batch):
    ids, of, keys, at = [], [], [], []
    for item, digest, text in zip(batch["item_id"].to_pylist(), batch["of"].to_pylist(), batch["text"].to_pylist(), strict=True):
        h = hash_words(text or "")
        k, a = seeds(h, np.zeros(len(h), np.int64))
        ids += [item] * len(k)
        of += [digest] * len(k)
        keys += k.view(np.int64).tolist()
        at += a.tolist()
    yield {"item_id": ids, "of": of, "key": keys, "item_at": at}


def _filter_bits(keys: DataFrame) -> np.ndarray:
    """A bitmap with two bits for each of the benchmark's seeds (their top and their low bits), merged in
    the cluster: at most 2**MOST_BITS bits reach the driver however large the benchmark is. A full
    map only lets more rows through to the join."""
    n = keys.select("key").distinct().count()
    bits = int(min(MOST_BITS, max(16, np.ceil(np.log2(max(n, 1) * 1024)))))
    slots = F.array(F.shiftrightunsigned("key", 64 - bits), F.col("key").bitwiseAND(F.lit((1 << bits) - 1)))
    one = keys.select(F.explode(slots).alias("slot"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("slot").bitwiseAND(F.lit(63)).cast("int"))
    rows = one.groupBy(F.shiftright("slot", 6).alias("w")).agg(F.bit_or(bit).alias("b")).toPandas()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[rows["w"].to_numpy()] = rows["b"].to_numpy()
    return out.view(U)


def _in_bits(table: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Positions of keys whose two bits are set."""
    bits = (len(table) * 64).bit_length() - 1
    get = lambda slot: (table[(slot >> U(6)).astype(np.int64)] >> (slot & U(63))) & U(1)
    first = np.flatnonzero(get(key >> U(64 - bits)))
    return first[np.flatnonzero(get(key[first] & U((1 << bits) - 1)))]


def _scan(bitmap):
    def make():
        table = bitmap.value

        def f(batch):
            data, offs = utf8(batch["text"])
            ids = batch["doc_id"].to_pylist()
            for i, j in slices(offs):
                h, row, _, _ = words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], NOT_ALNUM, FOLD)
                key, at = seeds(h, row)
                hit = _in_bits(table, key)
                if not len(hit):
                    continue
                hit = hit[np.argsort(at[hit], kind="stable")]
                key, at = key[hit].view(np.int64), at[hit]
                first = np.append(np.flatnonzero(np.diff(row[at], prepend=-1)), len(at))
                out = {k: [] for k in ("doc_id", "seg", "tokens", "keys", "ats")}
                for a, b in zip(first[:-1], first[1:], strict=True):
                    r = row[at[a]]
                    lo, hi = np.searchsorted(row, (r, r + 1))
                    t = h[lo:hi].tobytes()
                    out["doc_id"].append(ids[i + r])
                    out["seg"].append(hashlib.md5(t).digest())
                    out["tokens"].append(t)
                    out["keys"].append(key[a:b].tolist())
                    out["ats"].append((at[a:b] - lo).tolist())
                yield out

        return f

    return make


def overlap(doc: np.ndarray, item: np.ndarray, shift: int, penalty: float = 2.0) -> tuple[int, int, int]:
    """(tokens equal, start in item, end in item) of the best ungapped overlap on one diagonal, where
    an equal token scores 1 and a substituted one costs `penalty`."""
    lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
    if hi <= lo:
        return 0, 0, 0
    same = item[lo:hi] == doc[lo + shift : hi + shift]
    run = np.concatenate(([0.0], np.cumsum(np.where(same, 1.0, -penalty))))
    floor = np.minimum.accumulate(run)
    end = int((run - floor).argmax())
    start = int(run[: end + 1].argmin())
    return int(same[start:end].sum()), lo + start, lo + end


def contaminated(docs: DataFrame, benchmark: DataFrame, min_tokens: int = 16, min_share: float = 0.5) -> DataFrame:
    """Rows (doc_id, item_id, n_equal, item_from, item_to, n_item, doc_at): overlaps of a document
    with a benchmark item whose equal tokens number at least min_tokens (or the whole of a shorter item
    of 13 tokens or more) and at least min_share of the item.

    Tokens are runs of letters and digits, ASCII case folded. Every spaced seed of every document
    is looked up in a bounded bitmap of the benchmark's seeds; the few that pass, false positives
    included, are joined with the benchmark by hash. An overlap is verified over the whole item and the whole
    document, however long, once per distinct text, so copies cost one row each; of equal ones the first counts.
    Null texts count as empty; rows without doc_id or item_id are left out; repeated rows give one row. All texts of
    an item_id are looked for, and the best overlap of any of them is its row. Ids keep their types. Items under 13 tokens have no seed and match
    nothing. An empty benchmark gives no rows. Other columns are ignored.
    """
    sc = docs.sparkSession.sparkContext
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("doc_id is not null")
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text")).where("item_id is not null").distinct().withColumn("of", F.md5(F.coalesce("text", F.lit(""))))
    own, item = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    keys = stored(over_batches(items, lambda: _bench, f"item_id {item}, of string, key long, item_at int"))
    bitmap = sc.broadcast(_filter_bits(keys))
    seg = stored(over_batches(docs, _scan(bitmap), f"doc_id {own}, seg binary, tokens binary, keys array<long>, ats array<int>"))
    one = seg.groupBy("seg").agg(F.first("tokens").alias("tokens"), F.first("keys").alias("keys"), F.first("ats").alias("ats"))
    hit = one.select("seg", F.explode(F.arrays_zip("keys", "ats")).alias("z")).select("seg", F.col("z.keys").alias("key"), F.col("z.ats").alias("at"))
    cand = hit.join(keys, "key").groupBy("seg", "item_id", "of").agg(F.collect_set(F.col("at") - F.col("item_at")).alias("shifts"))

    @F.pandas_udf("n_equal int, item_from int, item_to int, n_item int, doc_at int")
    def verify(tokens: pd.Series, lo: pd.Series, shifts: pd.Series, text: pd.Series) -> pd.DataFrame:
        rows = []
        for t, at, ss, x in zip(tokens, lo, shifts, text, strict=True):
            d, it = np.frombuffer(t, U), hash_words(x or "")
            n, to, a, b = max((n, -a - int(s), a, b) for s in ss for n, a, b in [overlap(d, it, int(s) - at)])
            rows.append((n, a, b, len(it), -to))
        return pd.DataFrame(rows, columns=["n_equal", "item_from", "item_to", "n_item", "doc_at"])

    # only the tokens that the item can lie on, of 8 bytes each; an item has fewer tokens than bytes
    lo = F.greatest(F.lit(0), F.array_min("shifts"))
    reach = F.array_max("shifts") + F.octet_length("text") - lo
    pairs = cand.join(one.select("seg", "tokens"), "seg").join(items, ["item_id", "of"]).withColumn("lo", lo)
    seen = pairs.select("seg", "item_id", verify(F.substring("tokens", 8 * F.col("lo") + 1, 8 * reach), "lo", "shifts", "text").alias("v")).select("seg", "item_id", "v.*")
    seen = seen.where((F.col("n_equal") >= F.least(F.lit(min_tokens), F.greatest(F.lit(13), F.col("n_item")))) & (F.col("n_equal") >= min_share * F.col("n_item")))
    out = seg.select("doc_id", "seg").join(seen, "seg")
    best = F.max_by(F.struct("n_equal", "item_from", "item_to", "n_item", "doc_at"), F.struct("n_equal", -F.col("doc_at")))
    return out.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.*")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """The rows of docs that share no passage with the benchmark; rows without doc_id stay."""
    bad = contaminated(docs, benchmark, **kw).select(F.col("doc_id").alias("__bad")).distinct()
    return docs.join(bad, docs["doc_id"] == bad["__bad"], "left_anti")
