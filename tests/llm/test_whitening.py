"""Spectrum slicing and whitening against numpy's eigenvectors, edge cases."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest

from terrahaz.llm import whitening
from terrahaz.llm.spectrum import Slices, count_above, leading

SCHEMA = "vec_id long, embedding array<float>, label int, x array<int>, component string, n int"


def test_counts():
    rng = np.random.default_rng(3)
    for _ in range(300):
        a = rng.standard_normal((rng.integers(1, 12),) * 2)
        a, shift = a + a.T, rng.standard_normal() * 3
        assert count_above(a, shift) == (np.linalg.eigvalsh(a) > shift).sum()


@pytest.mark.parametrize("spectrum", [np.geomspace(1, 1e-6, 40), np.linspace(3, 1, 25), np.full(20, 3.0), [5, 5, 5, 2, 2, 1, 0, 0],
                                      [1, 1 + 1e-15, 1e-9, 1e-12], [7], [1, 1 - 1e-7, 1 - 2e-7, .5]])
def test_leading_eigenvectors(spectrum):
    spectrum = np.array(spectrum, float)
    q, _ = np.linalg.qr(np.random.default_rng(4).standard_normal((len(spectrum),) * 2))
    v = (q * spectrum) @ q.T
    v = (v + v.T) / 2
    values, vectors = leading(v, 16)
    assert len(values) == min(16, (spectrum > 1e-14).sum())
    assert np.abs(values - np.sort(spectrum)[::-1][:len(values)]).max() < 1e-14 * len(v) * spectrum.max()
    assert np.abs(v @ vectors - vectors * values).max() < 1e-13 * spectrum.max()
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12


def test_intervals_hold_one_eigenvalue():
    slices = Slices(np.diag([4.0, 3.0, 2.0, 1.0]))
    for _ in range(6):
        slices.halve(2)
    low, high = slices.around(2)
    assert low < 3 <= high and slices.known[low] == 2 and slices.known[high] == 1


def plain(rows, components=16):
    """vec_id -> (deviation, whitened, explained) by numpy over exact sums."""
    good = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    distinct = sorted({tuple(x) for _, x in good})
    n, d = len(distinct), len(distinct[0])
    sums = [sum(x[i] for x in distinct) for i in range(d)]
    z = np.array([[float(Fraction(n * x[i] - sums[i], n)) for i in range(d)] for x in distinct])
    v = z.T @ z / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    out = {}
    for i, x in good:
        centred = np.array([float(Fraction(n * c - s, n)) for c, s in zip(x, sums, strict=True)])
        out[i] = (sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True)), centred @ vectors / np.sqrt(values), values / np.trace(v))
    return n, out


def check(got, rows, components=16):
    n, want = plain(rows, components)
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], {})[r["component"]] = r
    assert set(by) == set(want)
    signs = None
    for i, (deviation, whitened, explained) in sorted(want.items()):
        own = [by[i][k + 1] for k in range(len(whitened))]
        assert len(by[i]) == len(whitened) and {(r["n"], r["deviation"]) for r in own} == {(n, deviation)}
        z = np.array([r["whitened"] for r in own])
        if signs is None:
            signs = np.sign(z * whitened)
        assert np.abs(z - signs * whitened).max() < 1e-9
        assert np.abs(np.array([r["explained"] for r in own]) / explained - 1).max() < 1e-9
        assert all(r["identity_error"] < 1e-9 for r in own)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(7)
    base = rng.standard_normal((300, 20)) * np.linspace(2, .1, 20) + 1e-3 * np.arange(20)
    out = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(base)]
    out += [(1000 + i, out[5][1]) for i in range(100)]  # copies count once in the fit
    return out


def test_against_numpy(spark, rows):
    bad = [(2000, None), (2001, []), (2002, [1.0] * 19 + [None]), (2003, [float("nan")] + [0.0] * 19), (2004, [float("inf")] * 20),
           (2005, [1.0, 2.0]), (2006, [1e30] + [0.0] * 19)]
    docs = spark.createDataFrame([(i, v, 1, [1], "c", 5) for i, v in rows + bad], SCHEMA).repartition(5)
    check(whitening.whiten(docs).collect(), rows)
    assert whitening.whiten(docs, 3).where("vec_id = 7").count() == 3


def test_few_dimensions_and_rank(spark):
    rows = [(i, [float(i), float(2 * i), 5.0]) for i in range(10)]
    out = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(out) == 10 and {r["component"] for r in out} == {1} and abs(out[0]["explained"] - 1) < 1e-12


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, [1.0, 2.0])]])
def test_nothing_to_whiten(spark, rows):
    out = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert out.count() == 0 and out.columns[:2] == ["vec_id", "component"]


def test_great_values_stay_exact():
    y = np.array([[2 ** 40, -3], [2 ** 40 - 1, 5]])
    cross = -3 * 2 ** 40 + 5 * (2 ** 40 - 1)
    assert whitening.exact_products(y).tolist() == [[2 ** 80 + (2 ** 40 - 1) ** 2, cross], [cross, 34]]
    w = whitening.Whitener(10 ** 9, [0, 0], np.ones(1), np.ones((2, 1)), 1.0)
    assert w.deviation(np.array([[10, 0], [0, 0]])) == [None, 0]


def test_great_entries(spark):
    rows = [(i, [float(i % 7) * 1e12, float(i % 5) * 1e9 + i]) for i in range(40)]
    out = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(out) == 80 and max(r["identity_error"] for r in out) < 1e-6


def test_query(spark):
    source = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding").collect()
    check(whitening.op12_embedding_whitening(spark, "/root/testdata/sf0.001").collect(), [tuple(r) for r in source])
