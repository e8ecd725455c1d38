"""Hand-computed cases and invariants."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from axonloom.functions import scalars as S
from axonloom.operators import aggregates as A
from axonloom.operators import clustering as C
from axonloom.operators import fields as R
from axonloom.operators import joins as J
from axonloom.operators import merging as M
from axonloom.operators import ordered as O
from axonloom.operators import stimulus as X


def train(spark, **cells):
    return spark.createDataFrame([(int(c[1:]), int(t)) for c, ts in cells.items() for t in ts], "cell_id bigint, t_us bigint")


def test_tuning_index(spark):
    df = spark.createDataFrame([(1, 0, 4.0), (1, 90, 1.0), (1, 180, 0.0), (1, 270, 1.0), (2, 0, 0.0)], "cell_id int, angle int, rate double")
    got = {r.cell_id: r for r in A.tuning_index(df, ["cell_id"], "angle", "rate").collect()}
    assert got[1].dsi == pytest.approx(4 / 6) and got[1].osi == pytest.approx(2 / 6) and got[1].preferred == 0
    assert (got[2].dsi, got[2].osi) == (0, 0)


def test_crosscorrelogram_counts_and_probability(spark):
    df = train(spark, c1=[0, 10], c2=[0, 1, 12]).withColumn("file", F.lit(0))
    got = {r.bin: (r.n, r.value) for r in A.crosscorrelogram(df, ["file"], 5, 1, "probability").collect()}
    assert {k: n for k, (n, _) in got.items()} == {0: 1, 1: 1, 2: 1}
    assert sum(p for _, p in got.values()) == pytest.approx(1)


def test_crossings_and_intervals(spark):
    df = spark.createDataFrame([(0, i, x) for i, x in enumerate([0.0, 0.0, 5.0, 5.0, 0.0])], "cell_id int, i int, x double")
    assert [r.i for r in O.crossings(df, ["cell_id"], ["i"], "x", 3.0).collect()] == [1]
    assert [r.i for r in O.crossings(df, ["cell_id"], ["i"], "x", 3.0, up=False).collect()] == [3]
    got = [r.isi for r in O.intervals(train(spark, c1=[0, 1, 3, 8]), ["cell_id"]).orderBy("t_us").collect()]
    assert got == [None, 1, 2, 5]


def test_refractory_and_contamination(spark):
    h = spark.createDataFrame([(1, b, f) for b, f in enumerate([0.1, 0.2, 0.3, 0.4])], "cell_id int, bin int, fraction double")
    assert A.refractory_percent(h, ["cell_id"], 3).first().refractory == pytest.approx(60)
    assert A.refractory_percent(h, ["cell_id"], 4).first().refractory == pytest.approx(100)
    r = A.contamination(train(spark, c1=[0, 5, 100]), ["cell_id"], 2, 10, 1000).first()
    assert (r.n, r.nb) == (3, 1) and r.contamination == pytest.approx(1 * 1000 / (8 * 9))


def test_split_by_file_and_gap_segments(spark):
    files = spark.createDataFrame([(1, 10), (2, 20)], "file int, n bigint")
    got = sorted((r.file, r.t_in_file) for r in J.split_by_file(train(spark, c1=[0, 9, 10, 29]), files, 10).collect())
    assert got == [(1, 0), (1, 9), (2, 0), (2, 19)]
    got = sorted((r.start, r.end) for r in O.gap_segments(train(spark, c1=[0, 100, 200, 5000, 5100]), ["cell_id"], "t_us", 2000).collect())
    assert got == [(0, 200), (5000, 5100)]


def test_neuron_id_and_ranges(spark):
    one = spark.range(1).select(S.neuron_id(F.lit(3), F.lit(4)).alias("n")).withColumn("e", S.electrode_of(F.col("n"))).withColumn("c", S.cluster_of(F.col("n")))
    assert tuple(one.first()) == (35, 3, 4)
    spec = spark.createDataFrame([("0-10,34-36",)], "spec string").select(S.expanded_ranges("spec").alias("f")).first().f
    assert spec == [f"data{i:03d}" for i in [*range(11), 34, 35, 36]]


def test_merged_trains_and_thinning(spark):
    points = train(spark, c1=[100, 200], c2=[101, 150])
    merges = spark.createDataFrame([(1, 2)], "head bigint, member bigint")
    assert sorted(r.t_us for r in M.merged_trains(merges, points, 2).collect()) == [100, 150, 200]
    got = O.every_kth(train(spark, c1=range(10)), ["cell_id"], 3)
    assert sorted(r.t_us for r in got.collect()) == [0, 3, 6, 9]
    assert sorted(r.t_us for r in O.thinned_by_gap(train(spark, c1=[0, 3, 5, 9, 10]), ["cell_id"], "t_us", 5).collect()) == [0, 5, 10]


def test_polygon(spark):
    v = spark.createDataFrame([(1, i, float(x), float(y)) for i, (x, y) in enumerate([(0, 0), (2, 0), (2, 2), (0, 2)])], "k int, i int, x double, y double")
    r = S.polygon_properties(v, "k").first()
    assert (r.area, r.cx, r.cy) == (4, 1, 1)


def test_triggered_average(spark):
    frames = spark.createDataFrame([(0, i, [float(v)]) for i, v in enumerate([1, 2, 3, 4])], "epoch_id bigint, frame int, pixels array<float>")
    counts = spark.createDataFrame([(0, 7, 1, 1), (0, 7, 3, 1)], "epoch_id bigint, cell_id bigint, frame int, n bigint")
    assert {r.lag: r.value for r in X.triggered_average(counts, frames, 2).collect()} == {0: 3.0, 1: 2.0}
    flat = frames.withColumn("pixels", F.transform("pixels", lambda x: (x * 0 + 2).cast("float")))
    assert {r.value for r in X.triggered_average(counts, flat, 2).collect()} == {2.0}


def test_band_pairs_brute_force(spark):
    g = np.random.default_rng(0)
    t = g.integers(-500, 500, 200)
    df = spark.createDataFrame([(1, int(x), i) for i, x in enumerate(t)], "k int, t_us bigint, id int")
    got = J.band_pairs(df, df, 13, ["k"]).count()
    assert got == int((np.abs(t[:, None] - t[None]) <= 13).sum())


def test_correlated_pairs_brute_force(spark):
    g = np.random.default_rng(1)
    v = g.normal(size=(40, 12))
    v[5] = v[6] + 0.01
    v[7] = 0
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "cell_id bigint, v array<double>")
    got = {(r.a, r.b): r.r for r in J.correlated_pairs(df, 0.3, blocks=3).collect()}
    with np.errstate(invalid="ignore"):
        c = np.nan_to_num(np.corrcoef(v))
    want = {(i, j): c[i, j] for i in range(40) for j in range(i + 1, 40) if c[i, j] >= 0.3}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)


def test_snippets_over_chunk_borders(spark):
    x = list(range(100))
    chunks = spark.createDataFrame([(1, k, x[k * 10 : k * 10 + 10]) for k in range(10)], "e int, chunk bigint, data array<int>")
    events = spark.createDataFrame([(1, 9), (1, 45), (1, 1), (1, 98)], "e int, t bigint")
    got = {r.t: r.snippet for r in J.chunk_snippets(events, chunks, 3, 4, 10, ["e"]).collect()}
    assert got == {9: list(range(6, 14)), 45: list(range(42, 50))}


def test_fir_over_chunks(spark):
    x, taps = np.arange(50.0), [0.5, 0.25, 0.25]
    df = spark.createDataFrame([(1, k, x[k * 7 : k * 7 + 7].tolist()) for k in range(8)], "e int, chunk bigint, data array<double>")
    got = np.concatenate([r.data for r in O.fir_filtered(df, ["e"], taps).orderBy("chunk").collect()])
    assert np.allclose(got, np.convolve(x, taps)[:50])


def test_smoothing_keeps_the_sum(spark):
    df = spark.createDataFrame([(1, b, float(b % 5)) for b in range(40)], "c int, bin bigint, x double")
    got = [r.smooth for r in O.smoothed(df, ["c"], 40, O.gaussian_taps(2.0, 9)).collect()]
    assert len(got) == 40 and sum(got) == pytest.approx(sum(b % 5 for b in range(40)))


def test_nearest_gap_and_last_mark(spark):
    points, marks = train(spark, c1=[5, 20, 41], c2=[7]), train(spark, c1=[0, 20, 40])
    assert {(r.cell_id, r.t_us): r.gap_us for r in J.nearest_gap(points, marks, ["cell_id"]).collect()} == {(1, 5): 5, (1, 20): 0, (1, 41): 1, (2, 7): None}
    assert {(r.cell_id, r.t_us): r.mark_us for r in J.last_mark(points, marks, ["cell_id"]).collect()} == {(1, 5): 0, (1, 20): 20, (1, 41): 40, (2, 7): None}


def test_helpers():
    x = np.concatenate([np.random.default_rng(3).normal(m, 0.3, (300, 2)) for m in (0, 5)])
    w, mu, _, _ = C.mixture(x, np.array([[0.0, 0.0], [4.0, 4.0]]))
    assert np.allclose(sorted(mu[:, 0]), [0, 5], atol=0.1) and np.allclose(w, 0.5, atol=0.05)
    assert R.polygon_area(R.hull(np.array([[0, 0], [2, 0], [2, 2], [0, 2], [1, 1]]))) == 4
    assert sorted(R.islands(np.array([[1, 1, 0], [0, 0, 1]], bool))) == [1, 2]
    assert R.chi2_survival(np.array([16.919]), 9)[0] == pytest.approx(0.05, abs=1e-4)
    assert R.chi2_survival(np.array([5.991]), 2)[0] == pytest.approx(0.05, abs=1e-4)


def test_buckets_change_nothing(spark):
    g = np.random.default_rng(6)
    points = spark.createDataFrame([(int(c), int(t), i) for i, (c, t) in enumerate(zip(g.integers(0, 3, 300), g.integers(-400, 400, 300)))], "cell_id bigint, t_us bigint, id int")
    marks = points.where("id % 7 = 0").select("cell_id", "t_us").distinct()
    rows = lambda df: sorted(map(repr, df.select(*sorted(df.columns)).collect()))
    assert rows(O.intervals(points, ["cell_id"], tie=["id"])) == rows(O.intervals(points, ["cell_id"], tie=["id"], bucket=23))
    assert rows(J.last_mark(points, marks, ["cell_id"])) == rows(J.last_mark(points, marks, ["cell_id"], bucket=23))


def test_correlogram_bins_exact_differences(spark):
    """Bins are wider than the resolution: times floored to bins first would give bin 0 twice and no -1."""
    df = spark.createDataFrame([("f", 1, 0), ("f", 1, 10), ("f", 2, 1), ("f", 2, 8), ("f", 2, 15)], "file string, cell_id int, t_us bigint")
    rows = A.crosscorrelogram(df, ["file"], 2, 2, "correlation").collect()
    want = {}
    for x in (0, 10):
        for y in (1, 8, 15):
            if -5 <= y - x < 5:
                b = int((y - x + 4 + 1) / 2) - 2
                want[b] = want.get(b, 0) + 1
    assert {r.bin: r.n for r in rows} == want == {1: 1, -1: 1}
    down = ((2 - 4 / 16) * (3 - 9 / 16)) ** 0.5
    assert all(abs(r.value - (1 - 6 / 16) / down) < 1e-9 for r in rows)


def test_a_far_spike_makes_a_good_merge(spark):
    points = spark.createDataFrame([(1, 0), (1, 100), (2, 1), (2, 101), (3, 1), (3, 500)], "cell_id int, t_us bigint")
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "a int, b int")
    got = {r.b: (round(r.fraction, 3), r.ok) for r in M.refractory_test(pairs, points, 10, 0.1).collect()}
    assert got == {2: (0.667, False), 3: (0.333, True)}  # 500 lies far from every spike of cell 1


def test_filter_over_short_and_missing_chunks(spark):
    trace = [float(x) for x in range(1, 9)]
    rows = [(0, trace[:1]), (1, trace[1:2]), (2, trace[2:5]), (4, trace[5:])]
    got = {r.chunk: r.data for r in O.fir_filtered(spark.createDataFrame(rows, "chunk int, data array<double>").withColumn("k", F.lit(1)), ["k"], [1.0, 10.0, 100.0]).collect()}
    whole = [sum(h * trace[i - j] for j, h in enumerate([1, 10, 100]) if i >= j) for i in range(5)]
    assert got[0] + got[1] + got[2] == whole and got[4] == [6.0, 67.0, 678.0]  # chunk 3 is missing: zeros before chunk 4


def test_averages_go_by_frame_numbers(spark):
    frames = spark.createDataFrame([(1, 0, [1.0]), (1, 1, [2.0]), (1, 3, [4.0])], "epoch_id int, frame bigint, pixels array<double>")
    counts = spark.createDataFrame([(1, 7, 3, 2)], "epoch_id int, cell_id bigint, frame bigint, n bigint")
    got = {(r.lag, r.total, r.n) for r in X.triggered_sums(counts, frames, 4).collect()}
    assert got == {(0, 8.0, 2.0), (1, 0.0, 0.0), (2, 4.0, 2.0), (3, 2.0, 2.0)}
