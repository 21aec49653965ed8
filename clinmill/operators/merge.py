"""Merging corpora whose ids collide: namespaced ids, proofs, and what the merge adds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import spread


def merge_corpora(frames: dict[str, DataFrame], offsets: dict[str, int], ids: list[str]) -> DataFrame:
    """Union with a corpus tag; every id column moves to its corpus's block."""
    unknown = set(frames) - set(offsets)
    if unknown:
        raise ValueError(f"no id block for {sorted(unknown)}")
    cols = next(iter(frames.values())).columns
    for name, df in frames.items():
        if df.columns != cols:
            raise ValueError(f"columns of {name} differ: {set(df.columns) ^ set(cols)}")
    parts = [df.withColumn("corpus", F.lit(k)).withColumns({f"src_{c}": F.col(c) for c in ids} | {c: F.col(c) + F.lit(offsets[k]) for c in ids}) for k, df in frames.items()]
    return reduce(DataFrame.unionByName, parts)


def id_collisions(frames: dict[str, DataFrame], key: str) -> DataFrame:
    """Ids in two or more corpora, and rows that a plain union would fuse."""
    u = reduce(DataFrame.unionByName, (df.select(key).withColumn("corpus", F.lit(k)) for k, df in frames.items()))
    per = u.groupBy(key).agg(F.countDistinct("corpus").alias("k"), F.count("*").alias("n")).where("k > 1")
    return per.agg(F.count("*").alias("n_ids"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"))


def numbered(df: DataFrame, group: str, key: str, new: str, most: int = 1 << 17) -> DataFrame:
    """df with `new`: 1, 2, ... by key inside each group. Keys are cut at approximate quantiles into ranges of about `most` rows,
    which are counted, so a task ranks ranges and never a whole group."""
    from pyspark.ml.feature import Bucketizer

    n = df.count()
    k = min(max(1, -(-n // most)), 4096)
    ends = df.agg(F.percentile_approx(key, [i / k for i in range(1, k)], max(10_000, 20 * k)).alias("q")).first()["q"] if k > 1 else []
    inf, d = float("inf"), df.withColumns({"__k": F.col(key).cast("double"), "__b": F.lit(0.0)})
    if ends:
        d = Bucketizer(splits=[-inf, *sorted({float(x) for x in ends}), inf], inputCol="__k", outputCol="__b", handleInvalid="keep").transform(d.drop("__b"))
    d = d.drop("__k").withColumn("__b", F.col("__b").cast("int"))  # doubles as keys would be dealt out a second time
    c = d.groupBy(group, "__b").agg(F.count("*").alias("__n"))
    c = c.select(F.col(group).alias("__g"), F.col("__b").alias("__c"), F.coalesce(F.sum("__n").over(Window.partitionBy(group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))  # over ranges
    d = spread(d, group, "__b").withColumn("__r", F.row_number().over(Window.partitionBy(group, "__b").orderBy(key)))
    j = d.join(F.broadcast(c), F.col(group).eqNullSafe(F.col("__g")) & F.col("__b").eqNullSafe(F.col("__c")))
    return j.select(*df.columns, (F.col("__r") + F.col("__before")).cast("long").alias(new))


def verify_ids(frames: dict[str, DataFrame], merged: DataFrame, key: str, offsets: dict[str, int], children: dict[str, tuple[dict[str, DataFrame], DataFrame]] | None = None) -> DataFrame:
    """(check, passed, detail), one row per proof obligation.

    Sources, slices and children meet once by source id, the merged rows and their children once by merged id, each in
    partitions of a fixed size; every check is a sum over these, multisets being compared by counts of equal rows."""
    kids = list((children or {}).items())
    cols, kid = next(iter(frames.values())).columns, [f"__c{i}" for i in range(len(kids))]
    flags = ["__s", "__m", *kid]
    flag = lambda df, on: df.select("*", *(F.lit(int(f == on)).cast("long").alias(f) for f in flags))
    kind = {x: merged.schema[f"src_{x}" if f"src_{x}" in merged.columns else x].dataType for x in cols}
    col, null = F.col, F.lit(None)
    total = lambda test, x: F.coalesce(F.sum(F.when(test, x)), F.lit(0).cast("long"))

    parts = [flag(df.select(F.lit(c).alias("corpus"), *cols), "__s") for c, df in frames.items()]
    parts.append(flag(merged.select("corpus", *(col(f"src_{x}" if f"src_{x}" in merged.columns else x).alias(x) for x in cols)), "__m"))
    parts += [flag(p.select(F.lit(c).alias("corpus"), *(col(x) if x == key else null.cast(kind[x]).alias(x) for x in cols)), f) for f, (_, (own, _)) in zip(kid, kids, strict=True) for c, p in own.items()]
    same = spread(reduce(DataFrame.unionByName, parts), key).groupBy("corpus", *cols).agg(*(F.sum(f).alias(f) for f in flags))
    each = same.groupBy(key, "corpus").agg(*(F.sum(f).alias(f) for f in flags), F.sum(F.abs(col("__s") - col("__m"))).alias("__d"))
    slices = {c: f"__slice{i}" for i, c in enumerate(frames)}
    known = (col("__s") > 0) & col(key).isNotNull()
    per = each.groupBy(key).agg(
        F.count_if(col("__s") > 0).alias("__k"), F.sum("__m").alias("__back"), F.count_if(col("__m") > 0).alias("__pairs"), F.sum(F.abs(col("__s") - col("__m"))).alias("__lost"),
        *(total(col("corpus") == c, col("__d")).alias(x) for c, x in slices.items()), *(total(known, col(f)).alias(f"{f}a") for f in kid),
    )
    add = lambda x: F.coalesce(F.sum(x), F.lit(0).cast("long")).alias(x)
    one = per.agg(F.count_if(col("__k") > 1).alias("__ids"), add("__back"), add("__pairs"), add("__lost"), *(add(x) for x in slices.values()), *(add(f"{f}a") for f in kid))

    parts = [flag(merged.select(key, "corpus"), "__m"), *(flag(child.select(key, "corpus"), f) for f, (_, (_, child)) in zip(kid, kids, strict=True))]
    each = spread(reduce(DataFrame.unionByName, parts), key).groupBy(key, "corpus").agg(*(F.sum(f).alias(f) for f in flags))
    tagged = col("corpus").isNotNull()
    per = each.groupBy(key).agg(
        F.sum("__m").alias("__n"), F.count_if(tagged & (col("__m") > 0)).alias("__k"), total(tagged, col("__m")).alias("__t"),
        *(x for f in kid for x in (F.sum(f).alias(f"{f}n"), total(tagged, col(f)).alias(f"{f}t"), total(tagged, col(f) * col("__m")).alias(f"{f}e"))),
    )
    real = col(key).isNotNull()
    two = per.agg(
        add("__n"), F.count_if(real & (col("__n") > 0)).alias("__ids2"), F.count_if(col("__k") > 1).alias("__cross"),
        *(x for f in kid for x in (total(real, col(f"{f}t") * col("__t") - col(f"{f}e")).alias(f"{f}moved"), total(real & (col("__n") > 0), col(f"{f}n")).alias(f"{f}b"))),
    )
    block = merged.groupBy("corpus").agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
    gap = block.withColumn("before", F.lag("hi").over(Window.orderBy("lo"))).agg(F.count_if(col("before") >= col("lo")).alias("__over"))  # a row per corpus
    rows = []
    put = lambda name, detail, ok=None: rows.append(F.struct(F.lit(name).alias("check"), (detail == 0 if ok is None else ok).alias("passed"), detail.cast("string").alias("detail")))
    put("collision_is_real", col("__ids"), col("__ids") > 0)
    put("merged_id_unique", col("__n") - col("__ids2"))
    put("bijection", col("__back") - col("__pairs"))
    put("source_ids_round_trip", col("__lost"))
    put("blocks_disjoint", col("__over"))
    put("no_id_crosses_corpora", col("__cross"))
    for f, (name, _) in zip(kid, kids, strict=True):
        put(f"no_child_re_parented_{name}", col(f"{f}moved"))
        put(f"resolution_{name}", col(f"{f}a") - col(f"{f}b"))
    for c, x in slices.items():
        put(f"slice_equals_source_{c}", col(x))
    return one.join(F.broadcast(two)).join(F.broadcast(gap)).select(F.explode(F.array(*rows)).alias("x")).select("x.*")  # of one row each


def require(report: DataFrame) -> None:
    """Raise if a check of the report failed."""
    bad = [f"{r['check']}: {r['detail']}" for r in report.where("not passed").limit(50).collect()]
    if bad:
        raise ValueError("; ".join(bad))


def category_shift(df: DataFrame, corpus: str, label: str, a: str, b: str) -> DataFrame:
    """Share of each label in two corpora and the difference, largest first."""
    n = df.where(F.col(corpus).isin(a, b)).groupBy(corpus, label).agg(F.count("*").alias("n"))
    s = n.withColumn("s", F.col("n") / F.sum("n").over(Window.partitionBy(corpus)))
    p = s.groupBy(label).agg(F.coalesce(F.max(F.when(F.col(corpus) == a, F.col("s"))), F.lit(0.0)).alias("share_a"), F.coalesce(F.max(F.when(F.col(corpus) == b, F.col("s"))), F.lit(0.0)).alias("share_b"))
    return p.withColumn("delta", F.col("share_b") - F.col("share_a")).orderBy(F.desc(F.abs("delta")), label)


def new_labels(df: DataFrame, corpus: str, label: str, a: str, b: str) -> DataFrame:
    """Labels that only corpus b has, with their rows."""
    only = df.where(F.col(corpus) == b).join(df.where(F.col(corpus) == a).select(label).distinct(), label, "left_anti")
    return only.groupBy(label).agg(F.count("*").alias("n"))


def strata_moves(before: DataFrame, after: DataFrame, label: str, stratum) -> DataFrame:
    """Labels by (stratum before, stratum after), from two (label, freq) tables."""
    a, b = before.select(label, F.col("freq").alias("fa")), after.select(label, F.col("freq").alias("fb"))
    j = a.join(b, label, "full_outer").select(stratum(F.coalesce("fa", F.lit(0))).alias("before"), stratum(F.coalesce("fb", F.lit(0))).alias("after"))
    return j.groupBy("before", "after").agg(F.count("*").alias("n"))


def corpus_totals(enc: DataFrame, rx: DataFrame, key: str) -> DataFrame:
    n = rx.groupBy(key).agg(F.count("*").alias("__n"), F.collect_set("label").alias("__l"))
    j = enc.join(n, key, "left")
    labels = j.select("corpus", F.explode("__l").alias("l")).distinct().groupBy("corpus").agg(F.count("*").alias("n_labels"))
    t = j.groupBy("corpus").agg(F.count("*").alias("encounters"), F.countDistinct("uid").alias("patients"), F.coalesce(F.sum("__n"), F.lit(0)).alias("orders"), F.avg(F.col("__n").isNull().cast("double")).alias("zero_drug"), F.avg((F.trim("note") != "").cast("double")).alias("with_text"), F.countDistinct("site").alias("sites"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    return t.join(labels, "corpus", "left")


def split_counts(enc: DataFrame) -> DataFrame:
    return enc.groupBy("corpus").pivot("split", ["train", "val", "test"]).agg(F.count(F.lit(1))).fillna(0)


def text_coverage(enc: DataFrame, text: str, tokens) -> DataFrame:
    t = enc.select("corpus", F.length(F.trim(text)).alias("chars"), tokens.alias("tok"))
    vocab = t.select("corpus", F.explode("tok").alias("w")).distinct().groupBy("corpus").agg(F.count("*").alias("vocabulary"))
    return t.groupBy("corpus").agg(F.count_if(F.col("chars") > 0).alias("with_text"), F.avg("chars").alias("mean_chars"), F.sum(F.size("tok")).alias("tokens")).join(vocab, "corpus", "left")
