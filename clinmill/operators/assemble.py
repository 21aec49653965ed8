"""Assembling encounters and orders from relations, and the joins that later steps share."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clean import cosine
from ..sources.scratch import if_small
from .retrieve import block_topk, hybrid_topk, pivot_topk, sparse_topk, text_topk, texts_topk, with_terms  # noqa: F401


def build_encounter_extract(rx: DataFrame, visit: DataFrame, on: str, dims: list[tuple[DataFrame, str]]) -> DataFrame:
    """Encounters with their visit (inner) and dimensions (left); Spark broadcasts the small ones."""
    out = rx.join(visit, on)
    for dim, key in dims:
        out = out.join(dim, key, "left")
    return out


def build_order_extract(orders: DataFrame, parent: DataFrame, on: str, dims: list[tuple[DataFrame, str]]) -> DataFrame:
    out = orders.join(parent, on, "left_semi")
    for dim, key in dims:
        out = out.join(dim, key, "left")
    return out


def build_link_extract(link: DataFrame, parent: DataFrame, on: str, template: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """Links of known parents with their template text, trimmed and cut."""
    out = link.join(parent.select(on), on, "left_semi").join(template, key, "left")
    return out.withColumn(text, F.substring(F.trim(F.coalesce(text, F.lit(""))), 1, width))


def build_cc_extract(link: DataFrame, names: DataFrame, key: str, parent: str, name: str) -> DataFrame:
    """Complaints with the name of their parent group, by joining the names twice."""
    a, b = names.alias("a"), names.select(F.col(key).alias("__pk"), F.col(name).alias("group_name")).alias("b")
    return link.join(a, key).join(b, F.col(f"a.{parent}") == F.col("b.__pk"), "left").drop("__pk")


def map_join(df: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Left join to a map held as a table; the optimiser broadcasts it while it is small."""
    return df.join(dim, key, "left")


def semi(df: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    return df.join(keys, on, "left_semi")


def anti(df: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    return df.join(keys, on, "left_anti")


def join_first(df: DataFrame, right: DataFrame, key: str, *order) -> DataFrame:
    """Left join to the first right row of each key."""
    first = right.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__r = 1").drop("__r")
    return df.join(first, key, "left")


def visit_rank(enc: DataFrame, uid: str, when: str, pid: str) -> DataFrame:
    return enc.withColumn("rn", F.row_number().over(Window.partitionBy(uid).orderBy(when, pid)))


def visit_features(enc: DataFrame, outcome: str) -> DataFrame:
    """visit_idx, first_visit, days_since_prev and the previous visit's outcome."""
    w = Window.partitionBy("uid").orderBy("visit", "pid")
    idx = F.row_number().over(w) - 1
    return enc.withColumns({"visit_idx": idx, "first_visit": (idx == 0).cast("int"), "days_since_prev": F.date_diff("visit", F.lag("visit").over(w)), "prev_outcome": F.lag(outcome).over(w)})


def carryover_jaccard(enc: DataFrame, rx: DataFrame, item: str) -> DataFrame:
    """Jaccard of the item sets of each visit and the patient's visit before it; no self-join."""
    sets = rx.groupBy("pid").agg(F.collect_set(item).alias("s"))
    w = Window.partitionBy("uid").orderBy("visit", "pid")
    v = enc.join(sets, "pid").withColumn("p", F.lag("s").over(w)).where("p is not null")
    return v.select("pid", F.try_divide(F.size(F.array_intersect("s", "p")), F.size(F.array_union("s", "p"))).alias("jaccard"))


def prior_visits(enc: DataFrame, k: int = 4) -> DataFrame:
    """Up to k latest visits strictly before each visit; visits on one date don't see each other."""
    w = Window.partitionBy("uid").orderBy(F.unix_date("visit").cast("long")).rangeBetween(Window.unboundedPreceding, -1)
    prior = F.array_sort(F.collect_list(F.struct(F.unix_date("visit").alias("d"), "pid")).over(w))
    return enc.select("pid", prior.alias("a")).select("pid", F.transform(F.slice("a", F.greatest(F.size("a") - k + 1, F.lit(1)), k), lambda x: x["pid"]).alias("prior"))


def calendar(enc: DataFrame, when: str) -> DataFrame:
    """Month, its circle, season, weekday (Monday 0) and days since the first train visit."""
    start = enc.where("split = 'train'").agg(F.min(when).alias("__start"))
    m = F.month(when)
    season = F.when(m.isin(12, 1, 2), "winter").when(m.isin(3, 4, 5), "summer").when(m.isin(6, 7, 8, 9), "monsoon").otherwise("autumn")
    return enc.join(F.broadcast(start)).withColumns({"month": m, "month_sin": F.sin(2 * F.pi() * m / 12), "month_cos": F.cos(2 * F.pi() * m / 12), "season": season, "weekday": F.weekday(when), "days_since_start": F.date_diff(when, "__start")}).drop("__start")


def fuzzy_token_join(tokens: DataFrame, vocab: DataFrame, budget) -> DataFrame:
    """(token, word, dist): words of the same first letter within the token's edit budget.

    Lengths are exploded by the budget, so the join is by (first letter, length) and not by all pairs."""
    t = tokens.select("token", F.substring("token", 1, 1).alias("c"), F.length("token").alias("n"), budget.alias("b")).where("b > 0")
    t = t.select("token", "c", "b", F.explode(F.sequence(F.col("n") - F.col("b"), F.col("n") + F.col("b"))).alias("n"))
    v = vocab.select("word", *[c for c in vocab.columns if c != "word"], F.substring("word", 1, 1).alias("c"), F.length("word").alias("n"))
    return t.join(v, ["c", "n"]).withColumn("dist", F.levenshtein("token", "word")).where("dist <= b and token <> word").drop("c", "n", "b")


def resolve_names(gen: DataFrame, formulary: DataFrame) -> DataFrame:
    """(name, id, how): exact alphanumeric key, else the same six first characters and a length within three."""
    key = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")
    g = gen.select("name").distinct().withColumn("k", key("name"))
    f = formulary.select("id", key(F.col("drug_name")).alias("fk"))
    exact = g.join(f.groupBy("fk").agg(F.min("id").alias("id")), g["k"] == F.col("fk")).select("name", "id", F.lit("exact").alias("how"))
    rest = g.join(exact, "name", "left_anti").where(F.length("k") >= 6).withColumn("p", F.substring("k", 1, 6))
    # a frequent prefix has a row for each length, not for each name
    short = f.groupBy(F.substring("fk", 1, 6).alias("p"), F.length("fk").alias("n")).agg(F.min("id").alias("id"))
    near = rest.join(short, "p").where(F.abs(F.length("k") - F.col("n")) <= 3)
    return exact.unionByName(near.groupBy("name").agg(F.min("id").alias("id")).withColumn("how", F.lit("prefix")))


def cosine_topk(queries: DataFrame, refs: DataFrame, k: int) -> DataFrame:
    """(qid, rid, score, rank): the k nearest references of each query.

    A reference table of a checked size is broadcast; a larger one is searched by cells that the triangle inequality
    can't rule out (pivot_topk)."""
    small = if_small(refs.select("rid", F.col("vec").alias("r")), 2_000)
    if small is None:
        return pivot_topk(queries, refs, k)[0]
    scored = queries.select("qid", F.col("vec").alias("q")).join(small).select("qid", "rid", F.round(cosine("q", "r"), 9).alias("score"))
    best = scored.groupBy("qid").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "rid"))), 1, k).alias("b"))  # of at most 2,000
    return best.select("qid", F.posexplode("b").alias("i", "x")).select("qid", "x.rid", (-F.col("x.s")).alias("score"), (F.col("i") + 1).alias("rank"))


def knn_label_vote(train: DataFrame, test: DataFrame, gold: DataFrame, k: int = 5, votes: int = 2) -> DataFrame:
    """(row_id, label, votes): labels that at least `votes` of a row's k nearest train rows have.

    train and test are (row_id, term, w) with L2-normed weights; neighbours come from an inverted index over all
    terms (sparse_topk)."""
    side = lambda d, name: d.select(F.col("row_id").alias(name), "term", "w")
    return label_vote(sparse_topk(side(test, "qid"), side(train, "rid"), k), gold, votes)


def label_vote(top: DataFrame, gold: DataFrame, votes: int = 2) -> DataFrame:
    """(row_id, label, votes): labels that at least `votes` of a row's neighbours (qid, rid) have."""
    return top.join(gold, top["rid"] == gold["row_id"]).groupBy(F.col("qid").alias("row_id"), "label").agg(F.count("*").alias("votes")).where(F.col("votes") >= votes)


def coder_agreement(a: DataFrame, b: DataFrame, key: str, code: str) -> DataFrame:
    j = a.select(key, F.col(code).alias("x")).join(b.select(key, F.col(code).alias("y")), key)
    return j.agg(F.count("*").alias("n"), F.avg((F.col("x") == F.col("y")).cast("double")).alias("exact"), F.avg((F.left("x", F.lit(1)) == F.left("y", F.lit(1))).cast("double")).alias("chapter"))


def benchmark_join(cohort: DataFrame, ref: DataFrame, key: str) -> DataFrame:
    """Cohort rates beside the latest value of a reference table (key, year, value)."""
    latest = ref.groupBy(key).agg(F.max_by("value", "year").alias("reference"), F.max("year").alias("ref_year"))
    return cohort.join(latest, key).withColumn("delta", F.col("rate") - F.col("reference"))
