"""Whitening against a library's eigenvectors, and its rows against exact integers."""

import numpy as np
import pytest

from gleanery.llm import whitening as wh


def matrices():
    r = np.random.default_rng(3)
    for n in (1, 2, 3, 5, 17, 64):
        m = r.standard_normal((3 * n + 1, n)) * np.linspace(1, 9, n)
        yield m.T @ m
    q, _ = np.linalg.qr(r.standard_normal((12, 12)))
    yield q @ np.diag([5, 5, 5, 4.9999999999, 2, 1, 1, 1, 0, 0, 0, 0]) @ q.T
    yield np.diag([3.0, 3.0, 1.0, 7.0, 7.0])
    yield np.eye(6)
    yield np.ones((8, 8)) * 1e18
    yield np.zeros((4, 4))


@pytest.mark.parametrize("m", list(matrices()))
def test_leading_components(m):
    values, vectors = wh.leading_components(m, 4)
    k, scale = min(4, len(m)), max(np.abs(m).max(), 1e-300)
    assert np.allclose(values / scale, np.linalg.eigvalsh(m)[::-1][:k] / scale, atol=1e-13)
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-12
    assert np.abs(m @ vectors - vectors * values).max() < 1e-12 * scale * max(1, len(m))


def test_tridiagonal_and_sturm_counts():
    m = list(matrices())[5]
    d, o, q = wh.tridiagonal(m)
    t = np.diag(d) + np.diag(o, 1) + np.diag(o, -1)
    assert np.abs(q.T @ m @ q - t).max() < 1e-10 * np.abs(m).max()
    values = np.linalg.eigvalsh(m)
    for i in (0, 5, 63):
        assert wh.count_below(d, o, values[i] * 1.0001) == i + 1


def test_moments_join_exactly():
    x = np.random.default_rng(1).integers(-(1 << 50), 1 << 50, (50, 3))
    whole = wh.Moments.of(x)
    joined = wh.Moments.none(3)
    for part in np.split(x, [0, 1, 17, 30]):
        if len(part):
            joined = joined.add(wh.Moments.of(part))
    assert whole.sums == joined.sums == [sum(map(int, c)) for c in x.T]
    assert np.allclose(whole.products, joined.products, rtol=1e-12)


def frame(spark, rows, extra=""):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", *([extra] if extra else []))


def test_rows(spark):
    r = np.random.default_rng(8)
    base = (r.standard_normal((300, 6)) * [4, 3, 2, 1, .5, .25] + 1).astype(np.float32)
    base = np.concatenate([base, np.repeat(base[:1], 150, axis=0), base[5:9]])
    rows = [(i, [float(c) for c in v], 0) for i, v in enumerate(base)]
    bad = [(900, None, 0), (901, [1.0, None, 1.0, 1.0, 1.0, 1.0], 0), (902, [float("nan")] * 6, 0), (903, [float("inf")] + [0.0] * 5, 0), (904, [], 0), (905, [1.0] * 5, 0)]
    got = wh.whiten(frame(spark, rows + bad, "'x' as x").repartition(7).selectExpr("*", "1 as component", "2 as n", "'y' as vector")).collect()
    x = np.floor(256 * base.astype(np.float64)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - fit.mean(axis=0)
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:4], vectors[:, ::-1][:, :4]
    assert len(got) == 4 * len(base) and {g["vec_id"] for g in got} == set(range(len(base)))
    want = (x - sums / n) @ vectors / np.sqrt(values)
    signs = {}
    for g in got:
        i, c = g["vec_id"], g["component"] - 1
        assert g["n"] == n and g["deviation"] == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[i], sums))
        assert abs(g["explained"] - values[c] / np.trace(cov)) < 1e-12 and g["identity_error"] < 1e-10
        if abs(want[i, c]) > 1e-3:
            sign = signs.setdefault(c, np.sign(want[i, c]) * np.sign(g["whitened"]))
            assert abs(g["whitened"] - sign * want[i, c]) < 1e-9


def test_few_vectors_and_empty_tables(spark):
    assert wh.whiten(frame(spark, [])).collect() == []
    assert wh.whiten(frame(spark, [(1, None, 0), (2, [float("nan")], 0)])).collect() == []
    assert wh.whiten(frame(spark, [(1, [1.0, 2.0], 0)] * 3)).collect() == []
    two = wh.whiten(frame(spark, [(1, [0.0, 2.0], 0), (2, [0.0, 4.0], 0), (2, [0.0, 4.0], 0)])).collect()
    assert sorted((r["vec_id"], r["component"], r["deviation"], round(abs(r["whitened"]), 9), round(r["explained"], 9)) for r in two) == [
        (1, 1, 512 ** 2, 1.0, 1.0), (2, 1, 512 ** 2, 1.0, 1.0), (2, 1, 512 ** 2, 1.0, 1.0)]


def test_deviation_beyond_a_long():
    x = np.array([[3, -4], [1 << 40, 5]])
    assert wh.deviations(x, 10, [1, 2]) == [29 ** 2 + 42 ** 2, None]
    assert wh.deviations(x[:1], 1 << 30, [7, 0]) == [None if (v := (3 * (1 << 30) - 7) ** 2 + (4 << 30) ** 2) >= 1 << 63 else v]
