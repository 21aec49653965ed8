"""Text-representation ablation: the same model over several ways to normalise notes, on shared gold."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.clean import prf
from ..sources.scratch import stored
from .metrics import bootstrap, delta_stats, pairs, row_counts
from .models import fit_ovr, score_ovr
from .vocab import stratum

#: Arms: how a note becomes terms.
ARMS: dict[str, Callable[[str], Column]] = {
    "raw": lambda c: F.split(F.trim(F.lower(F.coalesce(F.col(c), F.lit("")))), r"\s+"),
    "normalised": T.tokenize,
    "glossary": lambda c: T.tokenize(T.expand_glossary(c)),
    "joined": lambda c: T.tokenize_joined(T.expand_glossary(c, "joined")),
    "orthography": lambda c: T.tokenize(T.orthography(T.expand_glossary(c))),
    "segmented": lambda c: T.segmented_terms(T.segment(c)),
}


def arm_predictions(kinds: DataFrame, terms: Callable[[str], Column], labels: list[str], thr: float = 0.5, min_df: int = 2, most: int = 1 << 18) -> DataFrame:
    """(row_id, label) predicted for the test kinds of (row_id, split, text, labels, n) by one-vs-rest models on TF-IDF terms
    of the train kinds; a kind counts as the n rows it stands for."""
    x = stored(kinds.select("row_id", "split", "n", "labels", F.filter(F.coalesce(terms("text"), F.array().cast("array<string>")), lambda t: t != "").alias("terms")))
    train = x.where("split = 'train'")
    rows = train.agg(F.sum("n").alias("n")).first()["n"] or 0
    each = train.select("row_id", "n", F.explode("terms").alias("term")).groupBy("row_id", "n", "term").agg(F.count("*").alias("k"))
    freq = each.groupBy("term").agg(F.sum("n").alias("df"), F.sum(F.col("n") * F.col("k")).alias("cf")).where(F.col("df") >= min_df)
    vocab = freq.orderBy(F.desc("cf"), "term").limit(most).collect()  # as CountVectorizer bounds it
    tf = CountVectorizerModel.from_vocabulary([v["term"] for v in vocab], inputCol="terms", outputCol="tf")
    idf = ElementwiseProduct(scalingVec=Vectors.dense([math.log((rows + 1) / (v["df"] + 1)) for v in vocab]), inputCol="tf", outputCol="features")
    f = stored(idf.transform(tf.transform(x)).select("row_id", "split", "n", "labels", "features"))
    train, gold = f.where("split = 'train'"), f.select("row_id", F.explode("labels").alias("label"))
    return score_ovr(fit_ovr(train, gold, labels, weight="n"), f.where("split = 'test'")).where(F.col("p") >= thr).select("row_id", "label")


def ablation(notes: DataFrame, text: str, gold: DataFrame, labels: list[str], arms: dict[str, Callable[[str], Column]] = ARMS, base: str = "raw", n_boot: int = 1000, seed: int = 0, **kw) -> DataFrame:
    """One row per arm: micro_f1, head, mid and tail F1 (labels by train frequency), and the paired difference to the
    base arm over the same bootstrap resamples (delta, lo95, hi95, p_better).

    Rows of one split that agree in text and labels can't be told apart, so they are one kind of row with their number n;
    models, scores and resamples run on kinds. Every arm is scored on the same kinds; counts per kind are stored,
    so no model runs twice."""
    of = gold.groupBy("row_id").agg(F.sort_array(F.collect_list("label")).alias("labels"))
    rows = notes.where("split in ('train', 'test')").select("row_id", "split", F.col(text).alias("text")).join(of, "row_id", "left")
    kinds = rows.groupBy("split", "text", F.coalesce("labels", F.array().cast("array<string>")).alias("labels")).agg(F.count("*").alias("n"))
    kinds = stored(kinds.withColumn("row_id", F.monotonically_increasing_id()))
    test = stored(kinds.where("split = 'test'").select("row_id", "n", F.array_distinct("labels").alias("labels")))
    truth = test.select("row_id", F.explode("labels").alias("label"))
    freq = kinds.where("split = 'train'").select("n", F.explode("labels").alias("label")).groupBy("label").agg(F.sum("n").alias("n"))
    band = gold.select("label").distinct().join(freq, "label", "left").select("label", stratum(F.coalesce("n", F.lit(0))).alias("band"))
    counts = by_band = None
    for name, terms in arms.items():
        pred = stored(arm_predictions(kinds, terms, labels, **kw))
        c = row_counts(truth, pred, test).join(test.select("row_id", "n"), "row_id").withColumn("arm", F.lit(name))
        p = pairs(truth, pred).join(test.select("row_id", "n"), "row_id")
        one = lambda x: F.sum(F.col("n") * x)
        b = p.join(band, "label").groupBy("band").agg(one(F.col("g") * F.col("h")).alias("tp"), one(F.col("h")).alias("n_pred"), one(F.col("g")).alias("n_gold")).select(F.lit(name).alias("arm"), "band", prf("tp", "n_pred", "n_gold")["f1"].alias("f1"))
        counts = c if counts is None else counts.unionByName(c)
        by_band = b if by_band is None else by_band.unionByName(b)
    counts = stored(counts)
    total = counts.groupBy("arm").agg(*(F.sum(F.col("n") * F.col(x)).alias(x) for x in ("tp", "n_pred", "n_gold"))).select("arm", prf("tp", "n_pred", "n_gold")["f1"].alias("micro_f1"))
    bands = by_band.groupBy("arm").pivot("band", ["head", "mid", "tail"]).agg(F.first("f1"))
    rep = stored(bootstrap(counts, ["arm"], n_boot, seed, weight="n"))
    ref, deltas = rep.where(F.col("arm") == base), None
    for name in arms:
        d = delta_stats(rep.where(F.col("arm") == name), ref, "micro_f1").withColumn("arm", F.lit(name))
        deltas = d if deltas is None else deltas.unionByName(d)
    return total.join(bands, "arm", "left").join(deltas, "arm")
