"""A blinded annotation study: packets, assignment and scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clean import hash_rank, wilson


def vitals_block(cols: dict[str, tuple[str, str]]):
    """array<struct<label, value, unit>> of the measured vitals, from {column: (label, unit)}."""
    items = [F.when(F.col(c).isNotNull(), F.struct(F.lit(label).alias("label"), F.format_string("%.1f", F.col(c).cast("double")).alias("value"), F.lit(unit).alias("unit"))) for c, (label, unit) in cols.items()]
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def rx_lines(rx: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """(key, lines): each encounter's orders as structs, in order."""
    return rx.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *fields))).alias("lines"))


def blind_pairs(pairs: DataFrame, key: str, seed: int) -> tuple[DataFrame, DataFrame]:
    """Packets (ann_id, option1, option2) and the key that tells which is which, kept apart."""
    coin = hash_rank(seed, key) % 2 == 0
    j = pairs.withColumn("ann_id", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))))
    packet = j.select("ann_id", F.when(coin, F.col("model")).otherwise(F.col("historical")).alias("option1"), F.when(coin, F.col("historical")).otherwise(F.col("model")).alias("option2"))
    truth = j.select("ann_id", key, F.when(coin, "model").otherwise("historical").alias("option1_is"), F.when(coin, "historical").otherwise("model").alias("option2_is"))
    return packet, truth


def assign(items: DataFrame, key: str, n_annotators: int, overlap: float, seed: int) -> DataFrame:
    """(key, annotator): the first share in hash order goes to everyone, the rest round robin."""
    n = items.agg(F.floor(F.count("*") * overlap).alias("__n"))
    r = items.select(key, F.row_number().over(Window.orderBy(hash_rank(seed, key), key)).alias("__r")).join(F.broadcast(n))  # a study's items
    who = F.when(F.col("__r") <= F.col("__n"), F.sequence(F.lit(0), F.lit(n_annotators - 1))).otherwise(F.array(F.pmod(F.col("__r") - F.col("__n") - 1, F.lit(n_annotators)).cast("int")))
    return r.select(key, F.explode(who).alias("annotator"))


def packet_checks(truth: DataFrame) -> DataFrame:
    return truth.groupBy("option1_is").agg(F.count("*").alias("n"))


def icd_accuracy(ann: DataFrame, by: str) -> DataFrame:
    """Per tier: items, exact and chapter accuracy of the model's code, share codable; from (tier, code, model)."""
    c = F.col("code").isNotNull()
    return ann.groupBy(by).agg(F.count("*").alias("n"), F.avg(F.when(c, (F.col("code") == F.col("model")).cast("double"))).alias("exact"), F.avg(F.when(c, (F.left("code", F.lit(1)) == F.left("model", F.lit(1))).cast("double"))).alias("chapter"), F.avg(c.cast("double")).alias("codable"))


def unblind(ann: DataFrame, truth: DataFrame) -> DataFrame:
    """Answers with the preference as model, historical or the answer itself."""
    j = ann.join(truth, "ann_id")
    return j.withColumn("winner", F.when(F.col("preference") == "1", F.col("option1_is")).when(F.col("preference") == "2", F.col("option2_is")).otherwise(F.col("preference")))


def preference(unblinded: DataFrame, margin: float = 0.40) -> DataFrame:
    """Counts, win rate without ties, its interval, and non-inferiority at the lower bound."""
    k = lambda v: F.count_if(F.col("winner") == v)
    c = unblinded.agg(k("model").alias("model"), k("historical").alias("historical"), k("equal").alias("equal"), k("both_bad").alias("both_bad"))
    w = wilson("model", F.col("model") + F.col("historical"))
    return c.select("*", F.try_divide("model", F.col("model") + F.col("historical")).alias("win_rate"), w["lo"].alias("lo"), w["hi"].alias("hi"), (w["lo"] > margin).alias("non_inferior"))


def safety(unblinded: DataFrame) -> DataFrame:
    """Unsafe rate per source, from the safety answers of both options."""
    long = unblinded.select(F.explode(F.array(F.struct(F.col("option1_is").alias("source"), F.col("safety1").alias("s")), F.struct(F.col("option2_is").alias("source"), F.col("safety2").alias("s")))).alias("x")).select("x.*").where("s is not null")
    c = long.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("s") == "unsafe").alias("unsafe"))
    w = wilson("unsafe", "n")
    return c.select("source", "n", "unsafe", w["lo"].alias("lo"), w["hi"].alias("hi"))


def kappa(a: DataFrame, b: DataFrame, key: str, field: str, least: int = 10) -> DataFrame:
    """(n, agreement, kappa) on items both answered; null under `least` pairs."""
    t = lambda c: F.nullif(F.upper(F.trim(F.coalesce(c, F.lit("")))), F.lit(""))
    j = a.select(key, t(field).alias("x")).join(b.select(key, t(field).alias("y")), key).where("x is not null and y is not null")
    m = lambda c: j.groupBy(F.col(c).alias("v")).agg(F.count("*").alias(f"n_{c}"))
    chance = m("x").join(m("y"), "v").agg(F.coalesce(F.sum(F.col("n_x") * F.col("n_y")), F.lit(0)).alias("pe"))
    s = j.agg(F.count("*").alias("n"), F.avg((F.col("x") == F.col("y")).cast("double")).alias("po")).join(F.broadcast(chance))
    pe = F.col("pe") / (F.col("n") * F.col("n"))
    ok = F.col("n") >= least
    return s.select("n", F.when(ok, F.col("po")).alias("agreement"), F.when(ok & (pe < 1), (F.col("po") - pe) / (1 - pe)).alias("kappa"))
