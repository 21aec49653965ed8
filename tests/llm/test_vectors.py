"""Operators on vectors against plain versions that compare everything with everything."""

import hashlib

import numpy as np
import pytest

from clinmill.llm import vector_codes, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, id string, code string, n long"


@pytest.fixture(scope="module")
def make(spark):
    def f(rows, schema=SCHEMA):
        return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], lab, "x", "y", 1) for i, v, lab in rows], schema)

    return f


def some(n, seed, d=32, spread=0.2):
    r = np.random.default_rng(seed)
    centre = r.normal(size=(5, d)) * 0.3
    return [(k, (centre[k % 5] + r.normal(size=d) * spread).astype(np.float32).tolist(), None if k % 7 == 0 else k % 3) for k in range(n)]


def plain_codes(rows, parts=16, size=64, rounds=2):
    """The definition with all distances."""
    rows = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    rows.sort(key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    v = np.floor(256 * np.array([np.float32(x[1]) for x in rows], float)).astype(int)
    w = v.shape[1] // parts
    books = [[v[k, p * w : p * w + w] for k in range(min(size, len(v)))] for p in range(parts)]

    def assign():
        d = np.array([[[((x[p * w : p * w + w] - e) ** 2).sum() for e in books[p]] for p in range(parts)] for x in v])
        return d.argmin(2), d.min(2)

    for _ in range(rounds):
        to, _ = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = v[to[:, p] == e, p * w : p * w + w]
                if len(mine):
                    books[p][e] = mine.sum(0) // len(mine)
    to, d = assign()
    error = d.sum(1)
    by = {}
    for (_, _, lab), e in zip(rows, error, strict=True):
        by[lab] = by.get(lab, 0) + int(e)
    text = ",".join(str(int(x)) for p in books for e in p for x in e)
    digest = hashlib.sha256(text.encode()).hexdigest()
    return sorted((i is None, i or 0, "".join(f"{c:02x}" for c in t), int(e), by[lab], digest) for (i, _, lab), t, e in zip(rows, to, error, strict=True))


def codes(df):
    return sorted((x.vec_id is None, x.vec_id or 0, x.code, x.error, x.label_error, x.codebooks_sha256) for x in df.collect())


def test_codes_equal_all_distances(make):
    rows = some(300, 1)
    assert codes(vector_codes.code_report(make(rows).repartition(5))) == plain_codes(rows)


def test_codes_of_odd_rows(make):
    """Bad vectors, other lengths, repeated rows and ids, ids without a value, equal codebook entries, ties."""
    bad = [(900, None, 1), (901, [None] * 32, 1), (902, [float("nan")] * 32, 1), (903, [float("inf")] + [0.0] * 31, 2), (904, [0.5] * 16, 2), (905, [], 2)]
    r = np.random.default_rng(4)
    coarse = [(k, (r.integers(-2, 3, 32) / 256).tolist(), k % 2) for k in range(120)]  # many equal parts and ties
    rows = coarse + coarse[:10] + [(5, [0.25] * 32, None), (5, [0.1] * 32, None), (None, [0.3] * 32, None)]
    got = vector_codes.code_report(make(rows + bad).repartition(3))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert codes(got) == plain_codes(rows)


def test_codes_of_few_and_no_rows(make):
    rows = some(3, 2)
    assert codes(vector_codes.code_report(make(rows))) == plain_codes(rows)
    assert vector_codes.code_report(make(rows).limit(0)).count() == 0
    with pytest.raises(ValueError):
        vector_codes.code_report(make([(1, [0.5] * 30, 1)]))


def test_large_components_and_chunks(make, monkeypatch):
    rows = [(k, (np.array(v) * 500).astype(np.float32).tolist(), lab) for k, v, lab in some(400, 3)]
    monkeypatch.setattr(vector_codes, "CHUNK", 96)
    assert codes(vector_codes.code_report(make(rows).repartition(2))) == plain_codes(rows)


def test_curve_visits_neighbours():
    for bits, w in ((3, 2), (2, 3), (2, 4)):
        side = np.arange(1 << bits)
        x = np.stack(np.meshgrid(*[side] * w, indexing="ij"), -1).reshape(-1, w)
        key = vector_codes.hilbert(x, bits)
        assert sorted(key) == list(range(len(x)))
        assert (np.abs(np.diff(x[np.argsort(key)], axis=0)).sum(1) == 1).all()


def test_shortlists_hold_the_nearest_and_are_short():
    r = np.random.default_rng(6)
    x = (r.normal(size=(4096, 4)) * 30).astype(np.int64)
    x = x[vector_codes.curve_order(x)]
    entries = x[r.choice(len(x), 64, replace=False)]
    cut = np.arange(0, len(x), vector_codes.BLOCK)
    lo, hi = np.minimum.reduceat(x, cut), np.maximum.reduceat(x, cut)
    d = ((x[:, None] - entries) ** 2).sum(2)
    short = vector_codes.shortlists(lo, hi, entries)
    best = d == d.min(1, keepdims=True)
    assert not (best & ~np.repeat(short, vector_codes.BLOCK, 0)).any()
    assert short.sum(1).mean() < 32
    assert (vector_codes.nearest(x, lo, hi, entries)[1] == d.argmin(1)).all()


# ---- whitening


def known(values, seed):
    """A symmetric matrix in extended precision with these eigenvalues, and its vectors."""
    r = np.random.default_rng(seed)
    q = r.normal(size=(len(values), len(values))).astype(np.longdouble)
    for _ in range(3):  # Gram and Schmidt, repeated until orthogonal
        for k in range(len(values)):
            q[:, k] -= q[:, :k] @ (q[:, :k].T @ q[:, k])
            q[:, k] /= np.sqrt((q[:, k] ** 2).sum())
    a = (q * np.array(values, np.longdouble)) @ q.T
    return (a + a.T) / 2, q


@pytest.mark.parametrize("values", [[9, 7, 4, 2, 1], [5, 5 - 1e-6, 5 - 3e-6, 1, 1e-3, 1e-3 - 1e-8], [1 + 1e-7, 1] + [0.5] * 3, list(np.linspace(3, 1, 40))])
def test_vectors_to_double_precision(values):
    """Errors stay within what the matrix's own rounding in extended precision leaves open over the gap."""
    a, q = known(values, 1)
    e, x = whitening.eigen(a)
    assert np.abs(e - np.sort(np.array(values, float))[::-1]).max() < 1e-15 * max(values)
    gaps = [min([abs(v - w) for w in values if w != v]) for v in values]
    for k in np.argsort(-np.array(values, float), kind="stable"):
        if values.count(values[k]) == 1 and gaps[k] > 0:
            at = int(np.argmax(np.abs(q[:, k].astype(float) @ x)))
            sign = np.sign(float(q[:, k] @ x[:, at]))
            assert np.abs(x[:, at] * sign - q[:, k].astype(float)).max() < 4e-16 + 4 * np.finfo(np.longdouble).eps * max(values) / gaps[k], values[k]
    assert np.abs(x.T @ x - np.eye(len(values))).max() < 1e-15


def test_float32_alone_is_not_enough_but_refined_is():
    """Eigenvalues that float32 can't tell apart, in a matrix that is the identity to float32."""
    a = np.array([[1, 1e-10], [1e-10, 1]], np.longdouble)
    e, x = whitening.eigen(a)
    assert np.allclose(np.abs(x), np.sqrt(0.5), atol=1e-9) and abs(e[0] - e[1] - 2e-10) < 1e-15
    assert (whitening.eigen(np.zeros((3, 3), np.longdouble))[0] == 0).all()
    assert np.allclose(whitening.eigen(np.eye(4, dtype=np.longdouble))[0], 1)


def plain_whitening(rows, components=8):
    rows = [(i, v) for i, v, *_ in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    x = np.floor(1024 * np.array([np.float32(v) for _, v in rows], float)).astype(object).astype(int) + 100_000
    n, s = len(x), [int(t) for t in x.sum(0)]
    dev = [sum((n * int(a) - b) ** 2 for a, b in zip(r, s, strict=True)) for r in x]
    c = x - np.array(s) / n
    v = c.T @ c / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    return n, dev, c @ u / np.sqrt(e), e / np.trace(v)


def test_whitening_equals_numpy(make):
    rows = [(k, (np.array(v) * np.linspace(1, 3, 32)).tolist(), 1) for k, v, _ in some(500, 9)]
    bad = [(900, None, 1), (901, [None] * 32, 1), (902, [float("nan")] * 32, 1), (903, [float("-inf")] + [0.0] * 31, 2), (904, [0.5] * 16, 2), (905, [], 2)]
    got = whitening.whitened(make(rows + bad).repartition(5))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    n, dev, white, share = plain_whitening(rows)
    found = {(x.vec_id, x.component): x for x in got.collect()}
    assert set(found) == {(k, c) for k in range(500) for c in range(1, 9)}
    w = np.array([[found[k, c].whitened for c in range(1, 9)] for k in range(500)])
    w *= np.sign((w * white).sum(0))
    assert np.abs(w - white).max() < 1e-9
    for k in range(500):
        x = found[k, 3]
        assert (x.n, x.deviation) == (n, dev[k]) and x.explained == pytest.approx(share[2], rel=1e-9)
    assert 0 <= x.identity_error < 1e-9 and len({y.identity_error for y in found.values()}) == 1


def test_whitening_does_not_depend_on_how_rows_are_dealt(make):
    rows = some(200, 5)
    one, two = (sorted((x.vec_id, x.component, x.deviation, x.explained, x.whitened) for x in whitening.whitened(make(rows).repartition(k)).collect()) for k in (1, 6))
    assert [x[:4] for x in one] == [x[:4] for x in two]  # the fit is the same to the last bit
    assert np.allclose([x[4] for x in one], [x[4] for x in two], rtol=0, atol=1e-14)


def test_whitening_of_odd_rows(make):
    assert whitening.whitened(make(some(3, 1)).limit(0)).count() == 0
    one = whitening.whitened(make([(7, [0.5, 0.25], 1)])).collect()
    assert [(x.component, x.n, x.deviation, x.whitened, x.explained, x.identity_error) for x in sorted(one, key=lambda x: x.component)] == [(1, 1, 0, None, None, None), (2, 1, 0, None, None, None)]
    flat = [(k, [float(k), 2.0 * k, 1.0], 1) for k in range(4)] + [(3, [3.0, 6.0, 1.0], 1), (None, [1.0, 2.0, 1.0], 1)]  # rank 1, repeats, no id
    got = whitening.whitened(make(flat)).collect()
    assert len(got) == 18 and sum(x.vec_id is None for x in got) == 3 and sum(x.vec_id == 3 for x in got) == 6
    assert all((x.whitened is None) == (x.component > 1) for x in got)
    assert got[0].identity_error < 1e-12


def test_large_entries_stay_exact(make):
    rows = [(k, [float(2**20 * (k - 3)), 1e9 * (k % 2), 0.5 * k], 1) for k in range(8)]
    n, dev, white, _ = plain_whitening(rows)
    got = {(x.vec_id, x.component): x for x in whitening.whitened(make(rows)).collect()}
    w = np.array([[got[k, c].whitened for c in (1, 2)] for k in range(8)])
    w *= np.sign((w * white[:, :2]).sum(0))
    assert np.abs(w - white[:, :2]).max() < 1e-9
    assert [got[k, 1].deviation for k in range(8)] == [x if x < 2**63 else None for x in dev]
