"""Whitening against the covariance made in exact integers."""

import math
import random

import numpy as np
import pytest

from lectern.llm import whitening
from lectern.llm.queries import op11_whitening


def exact(rows):
    """x, n, S and the covariance (times n^3) of the vectors that count, in Python's integers."""
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(1024 * float(c)) + 100_000 for c in v] for _, v in good]
    n, s = len(x), [sum(col) for col in zip(*x, strict=True)]
    d = np.array([[n * a - b for a, b in zip(r, s, strict=True)] for r in x], object)
    return [i for i, _ in good], n, d, (d.T @ d).astype(float) / float(n) ** 3


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", 0.5) for i, v in rows], "vec_id long, embedding array<float>, n string, whitened double").repartition(3)


def vectors(count, dim, seed=11, spread=None):
    rng = np.random.default_rng(seed)
    values = rng.standard_normal((count, dim)) * (0.2 if spread is None else spread) + rng.standard_normal(dim)
    return [(i, np.float32(v).tolist()) for i, v in enumerate(values)]


CASES = {
    "flat": vectors(300, 64),
    "steep": vectors(200, 40, spread=0.5 ** np.arange(40) + 0.01),
    "few dimensions": vectors(50, 5),
    "some that don't vary": [(i, v[:6] + [0.25] * 6) for i, v in vectors(60, 6)],
    "odd rows": [*vectors(40, 12), (7, [0.5] * 12), (7, [0.5] * 12), (None, [0.1] * 12), (90, None), (91, [None] + [0.0] * 11), (92, [math.nan] * 12), (93, [math.inf] * 12)],
    "large": [(i, [float(np.float32(c * 1e9)) for c in v]) for i, v in vectors(30, 9)],
}


@pytest.mark.parametrize("case", CASES)
def test_components_and_rows_are_those_of_the_exact_covariance(spark, case):
    rows = CASES[case]
    ids, n, d, v = exact(rows)
    values, ways = np.linalg.eigh(v)
    values, ways = values[::-1], ways[:, ::-1]
    many = min(8, sum(values > 1e-12 * values[0]))
    model = whitening.fit(table(spark, rows))
    assert model.n == n and model.components.shape == (v.shape[0], many) and model.passes <= math.ceil(v.shape[0] / 16)
    assert np.abs(v @ model.components - model.components * model.eigenvalues).max() <= 1e-11 * values[0]
    assert np.allclose(model.eigenvalues, values[:many], rtol=1e-10)
    assert np.allclose(np.abs((model.components * ways[:, :many]).sum(axis=0)), 1, atol=1e-8)
    got = whitening.whiten(table(spark, rows), model).collect()
    assert len(got) == n * many and {r.n for r in got} == {n} and {r.component for r in got} == set(range(1, many + 1))
    squares = [int(s) if s < 2**63 else None for s in (d**2).sum(axis=1)]
    assert sorted(str((r.vec_id, r.deviation)) for r in got if r.component == 1) == sorted(str(p) for p in zip(ids, squares, strict=True))
    white = (d.astype(float) / n) @ model.components / np.sqrt(model.eigenvalues)
    want = sorted((str(i), k + 1, w) for i, row in zip(ids, white.tolist(), strict=True) for k, w in enumerate(row))
    have = sorted((str(r.vec_id), r.component, r.whitened) for r in got)
    assert [w[:2] for w in want] == [h[:2] for h in have] and np.allclose([w[2] for w in want], [h[2] for h in have], atol=1e-9)
    assert all(r.explained == pytest.approx(values[r.component - 1] / np.trace(v), rel=1e-9) for r in got)
    error = np.abs(white.T @ white / n - np.eye(many)).max()
    assert {r.identity_error for r in got} == {model.identity_error} and abs(model.identity_error - error) < 1e-9 and error < 1e-9


def test_spaces_that_start_again_are_certified_too(spark, monkeypatch):
    monkeypatch.setattr(whitening, "MOST_BASIS", 40)
    rows = vectors(400, 120, spread=0.97 ** np.arange(120))
    _, _, _, v = exact(rows)
    model = whitening.fit(table(spark, rows), k=4)
    assert np.abs(v @ model.components - model.components * model.eigenvalues).max() <= 1e-11 * model.eigenvalues[0]
    assert np.allclose(model.eigenvalues, np.linalg.eigvalsh(v)[::-1][:4], rtol=1e-10)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [math.nan])], [(1, [0.5, 0.25])], [(1, [0.5]), (2, [0.5])]])
def test_nothing_to_whiten_gives_no_rows(spark, rows):
    df = table(spark, rows)
    assert whitening.whiten(df, whitening.fit(df)).count() == 0


def test_vectors_of_another_length_are_left_out(spark):
    rows = [*vectors(20, 4), (100, [0.5] * 3), (101, [])]
    random.Random(1).shuffle(rows)
    df = table(spark, rows)
    got = whitening.whiten(df, whitening.fit(df)).collect()
    assert {r.vec_id for r in got} == set(range(20)) and {r.n for r in got} == {20}


def test_the_query_reads_the_table(spark, tmp_path):
    table(spark, CASES["odd rows"]).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = op11_whitening(spark, str(tmp_path)).collect()
    assert len(got) == 43 * 8 and got[0].identity_error < 1e-9
