"""Exact quantiles against numpy, with few values held in one place."""

import numpy as np
import pytest

from clinmill.operators import select


@pytest.fixture
def tight(monkeypatch):
    monkeypatch.setattr(select, "CUTS", 4)
    monkeypatch.setattr(select, "FEW", 3)


P = [0.0, 0.025, 0.25, 0.5, 0.51, 0.9, 0.975, 1.0]


def frame(spark, *cols):
    names = [f"c{k}" for k in range(len(cols))]
    return spark.createDataFrame([tuple(None if x is None else float(x) for x in r) for r in zip(*cols, strict=True)], ", ".join(f"{c} double" for c in names)), names


def test_equal_to_numpy(spark, tight):
    r = np.random.default_rng(1)
    n = 700
    cols = [r.normal(size=n), np.exp(r.normal(size=n) * 20), r.integers(0, 3, n), np.where(r.random(n) < 0.9, 0.0, r.normal(size=n)), np.full(n, 7.5), r.normal(size=n) * 1e-310]
    df, names = frame(spark, *cols)
    got = select.quantiles(df.repartition(3), dict.fromkeys(names, P))
    for c, x in zip(names, cols, strict=True):
        assert got[c] == pytest.approx(np.quantile(np.asarray(x, float), P).tolist(), rel=1e-12, abs=0), c


def test_nulls_infinities_and_empty_columns(spark, tight):
    inf = float("inf")
    x = [None, float("nan"), inf, -inf, 1.0, 2.0, 3.0, 1.7e308, -1.7e308, inf, 4.0, 5.0]
    df, _ = frame(spark, x, [None] * 12, [3.0] + [None] * 11)
    got = select.quantiles(df, {"c0": [0.0, 0.5, 1.0], "c1": [0.5], "c2": [0.1, 0.9]})
    assert got == {"c0": [-inf, 3.5, inf], "c1": [None], "c2": [3.0, 3.0]}
    assert select.quantiles(df.limit(0), {"c0": [0.5]}) == {"c0": [None]}
    assert select.quantiles(df, {}) == {}


def test_same_as_the_builtin(spark):
    df = spark.range(20_000).selectExpr("cast(pmod(xxhash64(id), 100003) as double) / 7 as v", "pmod(id, 5) as w")
    p = [0.001, 0.5, 0.77, 0.999]
    want = df.selectExpr(*(f"percentile({c}, array({','.join(map(str, p))})) as {c}" for c in ("v", "w"))).first()
    assert select.quantiles(df, {"v": p, "w": p}) == {"v": want["v"], "w": want["w"]}
