"""Ranks, order statistics and nearest marks against sorting everything."""

import numpy as np
import pytest

from axonloom.operators import aggregates as A
from axonloom.operators import joins as J
from axonloom.operators import ranks


@pytest.fixture(scope="module")
def data():
    g = np.random.default_rng(11)
    return {0: np.round(g.normal(0, 5, 700), 1), 1: np.full(50, 3.0), 2: g.exponential(1e9, 301), 3: np.array([4.0]), 4: np.array([-1e300, 0.0, 5e-324, 1e300])}


@pytest.fixture(scope="module")
def rows(spark, data):
    return spark.createDataFrame([(k, i, float(x)) for k, v in data.items() for i, x in enumerate(v)], "k int, i int, x double").repartition(3)


def test_order_statistics(spark, rows, data, monkeypatch):
    monkeypatch.setattr(ranks, "BINS", 7)  # few: bounds are narrowed many times
    wanted = [(k, r) for k, v in data.items() for r in {0, len(v) // 3, len(v) - 1, len(v) + 5}]
    got = {(r.k, r["rank"]): r.value for r in ranks.order_statistics(rows, ["k"], "x", spark.createDataFrame(wanted, "k int, rank int")).collect()}
    assert got == {(k, r): np.sort(data[k])[r] for k, r in wanted if r < len(data[k])}


def test_quantiles_and_deviations(rows, data):
    got = {r.k: (r.a, r.b) for r in ranks.quantiles(rows.where("k < 4"), ["k"], "x", {"a": 0.5, "b": 0.9}).collect()}
    assert got == {k: (pytest.approx(np.quantile(v, 0.5)), pytest.approx(np.quantile(v, 0.9))) for k, v in data.items() if k < 4}
    whole = ranks.quantiles(rows.where("k = 0"), [], "x", {"m": 0.5}).collect()
    assert [r.m for r in whole] == [pytest.approx(np.median(data[0]))] and ranks.quantiles(rows.where("false"), ["k"], "x", {"m": 0.5}).collect() == []
    mad = {r.k: r.sd for r in A.robust_sd(rows.where("k < 4"), ["k"], "x").collect()}
    assert mad == {k: pytest.approx(1.4826 * np.median(np.abs(v - np.median(v)))) for k, v in data.items() if k < 4}
    iqr = {r.k: r.sd for r in A.robust_sd(rows.where("k < 4"), ["k"], "x", "iqr").collect()}
    assert iqr == {k: pytest.approx(0.7413 * (np.quantile(v, 0.75) - np.quantile(v, 0.25))) for k, v in data.items() if k < 4}


def test_ranks(spark, rows, data):
    got = {(r.k, r.i): r.rank_ for r in ranks.ranked(rows, ["k"], "x", ["i"], "rank_").collect()}
    want = {(k, int(i)): n for k, v in data.items() for n, i in enumerate(np.lexsort((np.arange(len(v)), v)))}
    assert got == want
    holed = spark.createDataFrame([(1, None), (1, 2.0), (1, None)], "k int, x double")
    assert sorted(((r.x is None), r["rank"]) for r in ranks.ranked(holed, ["k"], "x").collect()) == [(False, 2), (True, 0), (True, 1)]


def test_nearest_marks_in_buckets(spark):
    g = np.random.default_rng(12)
    points, marks = [(int(k), int(t)) for k, t in g.integers([0, 0], [3, 5000], (300, 2))], [(int(k), int(t)) for k, t in g.integers([0, 0], [2, 5000], (12, 2))]
    p, m = (spark.createDataFrame(x, "k int, t_us bigint") for x in (points, marks))
    plain = lambda k, t: min((abs(t - u) for j, u in marks if j == k), default=None)
    for bucket in (None, 100, 10_000):
        got = sorted(((r.k, r.t_us), r.gap_us) for r in J.nearest_gap(p, m, ["k"], bucket=bucket).collect())
        assert got == sorted(((k, t), plain(k, t)) for k, t in points)
