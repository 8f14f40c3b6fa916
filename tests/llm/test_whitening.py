"""Bidiagonalisation against a dense eigendecomposition."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterline.llm import queries as Q
from meterline.llm import whitening as W


def plain(vectors, leading):
    """n, sums, covariance and its leading eigenpairs, of distinct whole-number vectors."""
    x = np.array(sorted(set(vectors)), np.int64)
    n, s = len(x), x.sum(axis=0)
    c = x - s / n
    v = c.T @ c / n
    e, q = np.linalg.eigh(v)
    return n, s, v, e[::-1][:leading], q[:, ::-1][:, :leading]


def check(rows, got, leading=4):
    """All of the query's columns against a plain version."""
    used = {i: tuple(math.floor(256 * float(np.float64(c))) for c in v) for i, v in rows}
    n, s, v, e, q = plain(used.values(), leading)
    assert len(got) == len(used) * min(leading, len(s))
    signs = {}
    for r in got:
        x = used[r.vec_id]
        far = sum((n * int(a) - int(b)) ** 2 for a, b in zip(x, s))
        k = r.component - 1
        want = float((np.array(x) - s / n) @ q[:, k] / math.sqrt(e[k]))
        sign = signs.setdefault(k, math.copysign(1, want) * math.copysign(1, r.whitened) if abs(want) > 1e-6 else None)
        assert r.n == n and r.deviation == far
        if sign is not None:
            assert abs(r.whitened * sign - want) < 1e-8 * max(1, abs(want)), (r, want)
        assert abs(r.explained - e[k] / np.trace(v)) <= 1e-10 * r.explained and r.identity_error < 1e-10
    assert len({(r.vec_id, r.component) for r in got}) == len(got)


def test_query_on_the_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect() if r.embedding is not None and all(c is not None and math.isfinite(c) for c in r.embedding)]
    check(rows, Q.op13_whitening(spark, sf).collect())


@pytest.mark.parametrize("d,n", [(3, 40), (30, 400), (12, 9)])
def test_spectra(spark, d, n):
    """Falling spectra, and fewer rows than dimensions."""
    rng = np.random.default_rng(d)
    x = rng.standard_normal((n, d)) * (20.0 ** -np.arange(d).clip(0, 6)) * 50
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    got = W.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)).collect()
    used = [tuple(math.floor(256 * c) for c in v) for _, v in rows]
    e = plain(used, 4)[3]
    if (e > 1e-9 * e[0]).all():
        check(rows, got)


def test_edges(spark):
    schema = "vec_id long, embedding array<float>, x string, n int"
    rows = [(1, [1.0, 2.0], "a", 1), (2, [1.0, 2.0], "a", 1), (2, [3.0, -0.0], None, None), (3, None, "a", 1), (4, [1.0, None], "a", 1), (5, [float("nan"), 1.0], "a", 1)]
    rows += [(6, [float("inf"), 1.0], "a", 1), (7, [], "a", 1), (8, [1.0, 2.0, 3.0], "a", 1), (None, [5.0, 5.5], "a", 1)]
    got = W.whitened(spark.createDataFrame(rows, schema)).collect()
    assert sorted({(r.vec_id is None, r.vec_id or 0) for r in got}) == [(False, 1), (False, 2), (True, 0)]
    assert len(got) == 8 and {r.component for r in got} == {1, 2} and {r.n for r in got} == {3}
    one = W.whitened(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")).collect()
    assert {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one} == {(1, 0, None, 0.0, 0.0)}
    assert W.whitened(spark.createDataFrame([], schema)).count() == 0
    line = W.whitened(spark.createDataFrame([(i, [float(i), 2.0 * i, 7.0]) for i in range(9)], "vec_id long, embedding array<float>"))
    flat = {(r.component, r.whitened is None) for r in line.collect()}
    assert flat == {(1, False), (2, True), (3, True)}
    shares = {r.component: r.explained for r in line.select("component", F.round("explained", 9).alias("explained")).distinct().collect()}
    assert shares == {1: 1.0, 2: 0.0, 3: 0.0}


def test_repeated_rows_count_once_in_the_fit(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((60, 5))
    rows = [(i, [float(c) for c in v]) for i, v in enumerate([*x, *[x[0]] * 500])]
    check(rows, W.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
