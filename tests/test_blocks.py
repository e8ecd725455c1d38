"""Pairs by blocks: what leaves a task, odd arrays, and clusters without a table of pairs."""

import time

import numpy as np
import pytest

from axonloom.operators import blocks as B
from axonloom.operators import greedy as G
from axonloom.operators import joins as J
from axonloom.operators import merging as M


def plan_above_tasks(df):
    """The part of the plan that rows from the block tasks pass."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan
    return plan[: plan.index("MapInArrow")]


def vectors(spark, n, seed, size=8):
    x = np.random.default_rng(seed).normal(size=(n, size))
    return x, spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(x)], "cell_id bigint, v array<double>, class int")


def arrays(spark, n, seed):
    g = np.random.default_rng(seed)
    base = g.normal(size=(4, 24)).cumsum(1)[g.integers(0, 4, n)] + g.normal(0, 0.05, (n, 24))
    rows = [(i, base[i].tolist(), base[i, :20].tolist(), base[i, :10].tolist(), base[i, 3:9].tolist(), None if i % 5 == 0 else g.normal(size=4).tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "cell_id bigint, ei array<double>, masked array<double>, wave array<double>, sta array<double>, isi array<double>")


def test_candidate_pairs_are_not_shuffled(spark):
    df = arrays(spark, 40, 1)
    pairs = M.measured(df, more=["sta", "isi"], extra="isi > 0.6 or sta > 0.1")
    above = plan_above_tasks(pairs)
    assert "Exchange" not in above and "Join" not in above
    assert pairs.count() > 20


def test_arrays_of_other_sizes_and_missing_ones_correlate_0(spark):
    x = np.random.default_rng(3).normal(size=12).cumsum().tolist()
    rows = [(1, x, x, x, x[:4]), (2, x, x, x, x[:5]), (3, x, x, x, None), (4, x, x, x, x[:4]), (5, x, x, x, [0.1] * 4), (6, x, x, x, [])]
    df = spark.createDataFrame(rows, "cell_id bigint, ei array<double>, masked array<double>, wave array<double>, isi array<double>")
    got = {(r.a, r.b): r.isi for r in M.measured(df, more=["isi"]).collect()}
    assert len(got) == 15 and got.pop((1, 4)) == pytest.approx(1) and set(got.values()) == {0.0}


def test_clusters_without_pairs_equal_those_of_pairs(spark, monkeypatch):
    x, df = vectors(spark, 120, 5)
    pairs = J.correlated_pairs(df.select("cell_id", "v", "class"), 0.35, keys=["class"])
    want = {tuple(r) for r in G.clusters(pairs, ["class"]).select("class", "head", "member").collect()}
    units = df.select("class", "cell_id", "v")
    near = lambda xs, ys: ys[0] @ xs[0].T >= 0.35
    scaled = lambda side, m: [B.unit_rows(*m[0])]
    for first, part, fall in ((1_000, 20_000, 0.1), (7, 30, 0.0), (7, 30, 0.9)):
        for name, value in (("FIRST", first), ("PART", part), ("FALL", fall)):
            monkeypatch.setattr(G, name, value)
        got = {tuple(r) for r in G.clusters_of(units, ["class"], ["v"], scaled, near).select("class", "head", "member").collect()}
        assert got == want and want
    assert G.clusters_of(units.where("cell_id < 0"), ["class"], ["v"], scaled, near).collect() == []


def test_merge_clusters_equal_those_of_candidates(spark, monkeypatch):
    df = arrays(spark, 60, 2)
    pairs = M.measured(df, more=["sta", "isi"], extra="isi > 0.6 or sta > 0.1")
    want = sorted(tuple(r) for r in G.clusters(pairs, []).collect())
    monkeypatch.setattr(G, "FIRST", 9)
    assert sorted(tuple(r) for r in M.measured_clusters(df, {"sta": 0.1, "isi": 0.6}).collect()) == want and len(want) > 10


@pytest.mark.parametrize("name", ["complete_map", "refractory_test", "evaluated_merges"])
def test_merge_queries_make_no_pairs(spark, sf, monkeypatch, name):
    from axonloom.plans import units

    def refused(*_, **__):
        raise AssertionError("a table of pairs")

    for module in (J, M, G):
        monkeypatch.setattr(module, "block_pairs", refused, raising=False)
    assert getattr(units, name)(spark, sf).count() > 0


def test_nearest_gap_goes_through_a_key_once(spark):
    from pyspark.sql import functions as F

    points = spark.range(60_000).select(F.lit(1).alias("k"), (F.col("id") * 7).alias("t_us"))
    marks = spark.range(30_000).select(F.lit(1).alias("k"), (F.col("id") * 14 + 3).alias("t_us"))
    began = time.time()
    got = J.nearest_gap(points, marks, ["k"], bucket=1_000_000).groupBy("gap_us").count().collect()
    assert {r.gap_us: r["count"] for r in got} == {3: 30_000, 4: 30_000}
    assert time.time() - began < 30


def test_greedy_clusters_make_no_pairs(spark, sf, monkeypatch):
    from axonloom.plans import units

    monkeypatch.delattr(J, "correlated_pairs")
    assert units.greedy_clusters(spark, sf).count() > 0


def test_blocks_grow_with_the_vectors(spark):
    df = spark.range(40_000).selectExpr("id as cell_id", "array_repeat(0D, 64) as v")
    assert J.block_count([df], []) == (8, 1)
    assert J.block_count([df.selectExpr("cell_id", "array_repeat(0D, 640) as v")], [])[0] == 13


def test_shifted_images_are_compared_in_one_pass(spark, sf):
    from axonloom.plans import signals, units

    for pairs in (signals.shifted_correlation(spark, sf), units.hexagonal_matches(spark, sf)):
        above = plan_above_tasks(pairs)
        assert "Exchange" not in above and "Union" not in above and "Aggregate" not in above
