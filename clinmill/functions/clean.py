"""Column expressions that repair and classify scalar fields; null is missing, never NaN."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .constants import AGE_BANDS, CONTINUOUS_DAYS, DURATION_BUCKETS, DURATION_UNITS, ICD_CHAPTERS, VITAL_RANGES


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def num(c) -> Column:
    """Number, or null where the text is none."""
    return _c(c).try_cast("double")


def ts(c) -> Column:
    """Timestamp, or null where the text is none."""
    return F.try_to_timestamp(_c(c))


def clip_ranges(df: DataFrame, ranges: dict[str, tuple[float, float]] = VITAL_RANGES) -> DataFrame:
    """Values outside a closed plausible range become null, in one projection."""
    return df.withColumns({c: F.when(F.col(c).between(lo, hi), F.col(c)) for c, (lo, hi) in ranges.items() if c in df.columns})


def harmonise_glucose(c) -> Column:
    """mmol/L (20 and less) to mg/dL."""
    return F.when(_c(c) <= 20, _c(c) * 18.0).otherwise(_c(c))


def harmonise_temperature(c) -> Column:
    """Celsius (30 to 45) to Fahrenheit."""
    return F.when(_c(c).between(30, 45), _c(c) * 9 / 5 + 32).otherwise(_c(c))


def age_years(visit, born) -> Column:
    """Years by calendar year; outside 0 to 110 null."""
    a = (F.year(_c(visit)) - F.year(_c(born))).cast("double")
    return F.when(a.between(0, 110), a)


def norm_sex(c) -> Column:
    s = F.substring(F.upper(F.trim(_c(c))), 1, 1)
    return F.when(s.isin("M", "F"), s)


def smoker_flag(c) -> Column:
    return F.coalesce((F.lower(F.trim(_c(c))) == "yes").cast("int"), F.lit(0))


def default_na(c, upper: bool = False) -> Column:
    s = F.trim(F.coalesce(_c(c), F.lit("NA")))
    return F.upper(s) if upper else s


def age_band(c) -> Column:
    """Index of the right-closed band, null outside."""
    a = _c(c)
    out = F.when(a <= -1, None)
    for k, hi in enumerate(AGE_BANDS):
        out = out.when(a <= hi, k)
    return out


def missing_panel(df: DataFrame, cols: list[str]) -> DataFrame:
    """miss_<col> bits, n_measured and frac_measured."""
    n = sum((F.col(c).isNotNull().cast("int") for c in cols[1:]), F.col(cols[0]).isNotNull().cast("int"))
    return df.withColumns({f"miss_{c}": F.col(c).isNull().cast("int") for c in cols} | {"n_measured": n, "frac_measured": n / len(cols)})


def bp_derived(sys, dia) -> dict[str, Column]:
    s, d = _c(sys), _c(dia)
    return {"map": d + (s - d) / 3.0, "pulse_pressure": s - d}


def bp_category(sys, dia) -> dict[str, Column]:
    """0 normal to 3 hypertensive and a flag, where both readings are there."""
    s, d = _c(sys), _c(dia)
    both = s.isNotNull() & d.isNotNull()
    cat = F.when(both & ((s >= 140) | (d >= 90)), 3).when(both & ((s >= 130) | (d >= 80)), 2).when(both & (s >= 120), 1).when(both, 0)
    return {"bp_cat": cat, "hypertensive": F.when(both, (cat == 3).cast("int"))}


def bmi_category_asian(c) -> Column:
    b = _c(c)
    return F.when(b >= 27.5, 3).when(b >= 23, 2).when(b >= 18.5, 1).when(b.isNotNull(), 0)


def bsa(height, weight) -> Column:
    return F.sqrt(_c(height) * _c(weight) / 3600.0)


def whr_risk(whr, sex) -> Column:
    return F.when(_c(whr).isNotNull(), (_c(whr) > F.when(_c(sex) == "M", 0.90).otherwise(0.85)).cast("int"))


def glucose_category(glucose, kind) -> dict[str, Column]:
    """0, 1, 2 and the ratio to the threshold of the assay that was run."""
    g, fasting = _c(glucose), _c(kind) == "FBS"
    hi, mid = F.when(fasting, 126.0).otherwise(200.0), F.when(fasting, 100.0).otherwise(140.0)
    return {"glucose_cat": F.when(g >= hi, 2).when(g >= mid, 1).when(g.isNotNull(), 0), "glucose_ratio": g / hi}


def anaemia(hb, sex) -> dict[str, Column]:
    limit = F.when(_c(sex) == "M", 13.0).otherwise(12.0)
    return {"anaemic": F.when(_c(hb).isNotNull(), (_c(hb) < limit).cast("int")), "hb_deficit": limit - _c(hb)}


def tri_state(c, test) -> Column:
    """1 or 0 where measured, else null."""
    return F.when(_c(c).isNotNull(), test(_c(c)).cast("int"))


def vital_flags() -> dict[str, Column]:
    return {
        "fever": tri_state("temperature", lambda c: c >= 100.4),
        "hypoxic": tri_state("oxygen_of_blood", lambda c: c < 94),
        "tachycardic": tri_state("pulse_rate", lambda c: c > 100),
        "bradycardic": tri_state("pulse_rate", lambda c: c < 60),
        "chol_high": tri_state("cholesterol", lambda c: c >= 200),
    }


def uric_high(uric, sex) -> Column:
    limit = F.when(_c(sex) == "M", 7.0).otherwise(6.0)
    return F.when(_c(uric).isNotNull(), (_c(uric) > limit).cast("int"))


def ncd_flags(df: DataFrame) -> DataFrame:
    """Fourteen flags of non-communicable disease; a flag without its measurement is null, and
    multimorbid is 0 when nothing was measured."""
    f = lambda c: c.cast("double")
    s, d, g, k = F.col("bp_sys"), F.col("bp_dia"), F.col("blood_glucose"), F.col("glucose_type")
    yes = lambda c: F.coalesce(c, F.lit(False))
    seen = s.isNotNull() | d.isNotNull()
    fasting = yes(F.upper(k).startswith("FBS"))
    hi, mid = F.when(fasting, 126.0).otherwise(200.0), F.when(fasting, 100.0).otherwise(140.0)
    out = {
        "hypertension_who": F.when(seen, f(yes(s >= 140) | yes(d >= 90))),
        "hypertension_stage2": F.when(seen, f(yes(s >= 160) | yes(d >= 100))),
        "diabetes_range": F.when(g.isNotNull(), f(g >= hi)),
        "prediabetes_range": F.when(g.isNotNull(), f((g >= mid) & (g < hi))),
        "overweight_asian": tri_state("bmi", lambda c: c >= 23).cast("double"),
        "obese_asian": tri_state("bmi", lambda c: c >= 27.5).cast("double"),
        "overweight_who": tri_state("bmi", lambda c: c >= 25).cast("double"),
        "obese_who": tri_state("bmi", lambda c: c >= 30).cast("double"),
        "underweight": tri_state("bmi", lambda c: c < 18.5).cast("double"),
        "anaemia_who": tri_state("blood_hemoglobin", lambda c: c < F.when(F.col("sex") == "M", 13.0).otherwise(12.0)).cast("double"),
        "hypoxaemia": tri_state("oxygen_of_blood", lambda c: c < 94).cast("double"),
        "tachycardia": tri_state("pulse_rate", lambda c: c > 100).cast("double"),
    }
    df = df.withColumns(out)
    core = ["hypertension_who", "diabetes_range", "obese_asian"]
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in core[1:]), F.coalesce(F.col(core[0]), F.lit(0.0)))
    df = df.withColumn("ncd_count", F.when(F.coalesce(*core).isNotNull(), total))
    return df.withColumn("ncd_multimorbid", f(F.coalesce(F.col("ncd_count") >= 2, F.lit(False))))


def slug(c) -> Column:
    """ASCII fold, lower, everything but letters and digits to single underscores."""
    s = F.translate(F.lower(_c(c)), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    return F.regexp_replace(F.regexp_replace(s, "[^a-z0-9]+", "_"), "^_+|_+$", "")


def duration_qty(c) -> Column:
    """First number of a text, if above 0 and at most 365; Bengali digits count as digits."""
    t = F.translate(_c(c), "০১২৩৪৫৬৭৮৯", "0123456789")
    v = F.regexp_extract(t, r"\d+(?:\.\d+)?", 0).try_cast("double")
    return F.when((v > 0) & (v <= 365), v)


def duration_days(qty, unit) -> Column:
    u = default_na(unit)
    out = F.when(u == "Cont.", CONTINUOUS_DAYS)
    for name, k in DURATION_UNITS.items():
        out = out.when(u == name, _c(qty) * k)
    return out


def duration_bucket(days) -> Column:
    d = _c(days)
    out = F.when(d.isNull() | (d <= 0), "NA")
    for hi, name in DURATION_BUCKETS:
        out = out.when(d <= hi, name)
    return out.otherwise("NA")


def canon_dose(c) -> Column:
    """1-0-1 and 1 + 0 + 1 become 1+0+1; other doses are lower-cased."""
    t = F.trim(F.regexp_replace(F.lower(F.coalesce(_c(c), F.lit(""))), r"\s+", " "))
    parts = F.filter(F.split(t, r"\s*[+\-]\s*"), lambda x: x != "")
    return F.when(t.rlike(r"^[\d/\s+\-]+$"), F.array_join(parts, "+")).otherwise(t)


def icd_chapter(c) -> Column:
    code = F.upper(F.trim(_c(c)))
    head = F.substring(code, 1, 3)
    out = F.when(~head.rlike(r"^[A-Z][0-9]{2}$"), None)
    for lo, hi, name in ICD_CHAPTERS:
        out = out.when(head.between(lo, hi), name)
    return F.when(_c(c).isNotNull(), out.otherwise("other"))


def zscore_clip(c, mean, sd, limit: float = 6.0) -> Column:
    """Standardised and clipped; 0 where missing."""
    z = (_c(c) - _c(mean)) / _c(sd)
    return F.coalesce(F.greatest(F.least(z, F.lit(limit)), F.lit(-limit)), F.lit(0.0))


def logit(p, eps: float = 1e-6) -> Column:
    q = F.greatest(F.least(_c(p), F.lit(1 - eps)), F.lit(eps))
    return F.log(q / (1 - q))


def sigmoid(x) -> Column:
    return 1 / (1 + F.exp(-_c(x)))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def l2(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b) -> Column:
    return F.try_divide(dot(a, b), l2(a) * l2(b))


def prf(tp, n_pred, n_gold) -> dict[str, Column]:
    """Precision, recall and F1; 0 where undefined."""
    p = F.coalesce(F.try_divide(_c(tp).cast("double"), _c(n_pred)), F.lit(0.0))
    r = F.coalesce(F.try_divide(_c(tp).cast("double"), _c(n_gold)), F.lit(0.0))
    return {"precision": p, "recall": r, "f1": F.coalesce(F.try_divide(2.0 * _c(tp), _c(n_pred) + _c(n_gold)), F.lit(0.0))}


def wilson(k, n, z: float = 1.96) -> dict[str, Column]:
    """Wilson score interval; (0, 0) without trials."""
    k, n = _c(k).cast("double"), _c(n).cast("double")
    p = F.try_divide(k, n)
    mid = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z / (1 + z * z / n) * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return {"lo": F.when(n > 0, mid - half).otherwise(0.0), "hi": F.when(n > 0, mid + half).otherwise(0.0)}


def hash_rank(seed: int, *cols) -> Column:
    """Eight hex digits of md5 as a number: the same order in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *(_c(c).cast("string") for c in cols))), 1, 8), 16, 10).cast("bigint")


def pad(arr, n: int, fill) -> Column:
    """Cut or fill an array to length n."""
    a = F.slice(_c(arr), 1, n)
    return F.concat(a, F.array_repeat(F.lit(fill), F.greatest(F.lit(n) - F.size(a), F.lit(0))))


def parse_loose_json(c, schema: str) -> Column:
    """JSON, or the stretch from the first to the last brace of a reply that is not JSON as a whole."""
    whole = F.from_json(_c(c), schema, {"mode": "PERMISSIVE"})
    inner = F.from_json(F.regexp_extract(_c(c), r"(?s)\{.*\}", 0), schema)
    return F.when(F.trim(_c(c)).startswith("{"), whole).otherwise(inner)
