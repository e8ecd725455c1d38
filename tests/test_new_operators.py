"""Byte ranges of recordings, wide cells, gratings, hexagonal shifts, regions, rounds of sums and the online harmonic."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from axonloom.operators import joins as J
from axonloom.operators import merging as M
from axonloom.operators import regions as E
from axonloom.operators import rounds as Q
from axonloom.operators import stimulus as X
from axonloom.sources import files, recordings
from axonloom.streaming import live


@pytest.fixture(scope="module")
def samples():
    g = np.random.default_rng(0)
    x = g.integers(-2048, 2048, (103, 5)).astype(np.int16)
    x[:, 0] = g.integers(-30_000, 30_000, 103)
    return x


@pytest.mark.parametrize("split", [1, 30, 100, 10_000])
def test_byte_ranges_equal_one_task(spark, tmp_path, samples, split):
    path = tmp_path / "r.bin"
    path.write_bytes(b"header" + recordings.packed(samples) + b"xyz")  # a torn last row is left out
    df = recordings.read_recordings(spark, str(path), 5, header=6, chunk=10, split=split * recordings.row_bytes(5))
    assert df.rdd.getNumPartitions() == -(-103 // (10 * max(1, split // 10)))
    got = sorted(((r.electrode, r.chunk), r.data) for r in df.collect())
    assert got == sorted(((r.electrode, r.chunk), r.data) for r in files.read_recording(spark, str(path), 5, header=6, chunk=10).collect())
    assert dict(got)[3, 10] == samples[100:, 3].tolist()
    some = recordings.read_recordings(spark, str(path), 5, header=6, chunk=10, electrodes=[4, 0]).collect()
    assert {r.electrode for r in some} == {0, 4} and len(some) == 22


def test_packing_clips_and_writes_again(spark, tmp_path, samples):
    wide = samples.astype(int)
    wide[0, 1:] = [5000, -5000, 2047, -2048]
    rows = spark.createDataFrame([("a", i, x) for i, x in enumerate(wide.tolist())], "recording string, i bigint, samples array<int>")
    for _ in range(2):
        made = recordings.write_recordings(rows, str(tmp_path / "w"), 5, 40).collect()
    assert sorted((r.file, r.n) for r in made) == [("a-000000.bin", 40), ("a-000001.bin", 40), ("a-000002.bin", 23)]
    got = {(r.file, r.electrode): r.data for r in recordings.read_recordings(spark, str(tmp_path / "w"), 5, chunk=100).collect()}
    assert got["a-000000.bin", 1][0] == 2047 and got["a-000000.bin", 2][0] == -2048 and got["a-000002.bin", 4] == wide[80:, 4].tolist()


def test_wide_cells_replace_their_partitions(spark, tmp_path):
    schema = "rate double, label string, hist array<double>"
    rows = "experiment string, cell_id int, name string, value string, values array<double>"
    path = str(tmp_path / "cells")
    files.write_cells(spark.createDataFrame([("e1", 1, "rate", "2.5", None), ("e1", 1, "hist", None, [1.0, 2.0]), ("e2", 1, "label", "x", None)], rows), path, schema)
    files.write_cells(spark.createDataFrame([("e1", 7, "rate", "9", None)], rows), path, schema)
    got = {(r.experiment, r.cell_id): (r.rate, r.label, r.hist) for r in spark.read.parquet(path).collect()}
    assert got == {("e1", 7): (9.0, None, None), ("e2", 1): (None, "x", None)}
    with pytest.raises(ValueError):
        files.wide(spark.createDataFrame([("e1", 1, "other", "1", None)], rows), schema)


def test_grating_windows(spark):
    marks = spark.createDataFrame([("f", 0, t) for t in (0, 100, 200, 300, 400)] + [("f", 1, t) for t in (1000, 1100, 1200)], "file string, run int, t_us bigint")
    runs = spark.createDataFrame([("f", 0, 1.0, 2.0, 90.0), ("f", 1, 1.0, 2.0, 0.0)], "file string, run int, spatial double, temporal double, direction double")
    points = spark.createDataFrame([("f", 5, t) for t in (50, 100, 250, 299, 300, 1100, 1150)], "file string, cell_id int, t_us bigint")
    counts = X.grating_counts(points, marks, runs, 1000)
    assert [(r.cell_id, r.direction, r.n) for r in counts.collect()] == [(5, 90.0, 3)]  # [100, 300); run 1 has no window
    assert {(r.direction, r.rate) for r in X.grating_table(counts).collect()} == {(90.0, 3.0), (None, 3.0)}


def test_hexagonal_shifts_and_matches(spark):
    places = [(r * 4 + c, c * 2.0 + r, r * 3**0.5) for r in range(4) for c in range(4)]
    df = spark.createDataFrame(places, "electrode int, x double, y double")
    got = {(r.shift, r.electrode): r.moved for r in E.hexagonal_shifts(df).collect()}
    xy = np.array([p[1:] for p in places])
    steps = [(0, 0), (-2, 0), (2, 0), (1, 3**0.5), (1, -(3**0.5)), (-1, 3**0.5), (-1, -(3**0.5))]
    want = {}
    for s, d in enumerate(steps):
        for i in range(16):
            gap = np.hypot(*(xy[i] - xy - d).T)
            if gap.min() < 2 / 6:
                want[s, i] = int(gap.argmin())
    assert got == want
    g = np.random.default_rng(1)
    one = g.normal(size=(5, 16, 3))
    two = g.normal(size=(5, 16, 3))
    for (s, i), m in want.items():
        if s == 3:
            two[2, m] = one[4, i]  # the image of cell 4, one step over
    frame = lambda x: spark.createDataFrame([(c, e, x[c, e].tolist()) for c in range(5) for e in range(16)], "cell_id bigint, electrode int, wave array<double>")
    found = {(r.a, r.b): (r.r, r["shift"]) for r in E.shifted_correlation(frame(one), frame(two), df, 0.2).collect()}
    best = {}
    for a in range(5):
        for b in range(5):
            rs = [np.corrcoef(one[a, [i for t, i in sorted(want) if t == s]].ravel(), two[b, [want[s, i] for t, i in sorted(want) if t == s]].ravel())[0, 1] for s in range(7)]
            if max(rs) >= 0.2:
                best[a, b] = (pytest.approx(max(rs)), int(np.argmax(rs)))
    assert found == best and found[4, 2] == (pytest.approx(1.0), 3)


def test_points_in_rotated_ellipses(spark):
    g = np.random.default_rng(4)
    points, fields = g.uniform(-20, 20, (400, 2)), [(i, *g.uniform(-15, 15, 2), *g.uniform(0.5, 9, 2), g.uniform(-3, 3)) for i in range(12)]
    p = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)], "i int, x double, y double")
    e = spark.createDataFrame([tuple(map(float, f)) for f in fields], "f double, x0 double, y0 double, a double, b double, alpha double")
    want = set()
    for f, x0, y0, a, b, t in fields:
        dx, dy = points[:, 0] - x0, points[:, 1] - y0
        for i in np.flatnonzero(((dx * np.cos(t) + dy * np.sin(t)) / a) ** 2 + ((dx * np.sin(t) - dy * np.cos(t)) / b) ** 2 <= 1):
            want.add((int(i), float(f)))
    for cell in (1.0, 7.0):
        got = [(r.i, r.f) for r in E.points_in_ellipses(p, e, cell).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    pixels = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 9.0, 9.0), (2, 5, 9.0, 9.0), (3, 6, 1.0, 1.0)], "cell_id int, pix int, x double, y double")
    own = spark.createDataFrame([(1, 0.0, 0.0, 2.0, 1.0, 0.3), (2, 0.0, 0.0, 2.0, 1.0, 0.3)], "cell_id int, x0 double, y0 double, a double, b double, alpha double")
    assert sorted((r.cell_id, r.pix) for r in E.pixels_of_fields(pixels, own).collect()) == [(1, 0), (2, 5), (3, 6)]


def plain_sigma(v):
    n = s = q = mean = 0.0
    sd, passes = np.inf, 0
    while True:
        inside = v[np.abs(v - mean) < 3 * sd]
        n, s, q, passes = n + len(inside), s + inside.sum(), q + (inside**2).sum(), passes + 1
        mean, new = s / n, np.sqrt(max((q - s * s / n) / (n - 1), 0))
        if abs(sd - new) <= 0.01:
            return new, passes
        sd = new


def test_clipped_sigma_equals_one_pass_over_a_key(spark):
    g = np.random.default_rng(6)
    data = {k: np.round(g.normal(k, 3 + k, 500), 1) for k in range(3)}
    data[1][:40] += 200
    rows = spark.createDataFrame([(k, float(x)) for k, v in data.items() for x in v] + [(9, None)], "e int, x double")
    got = {r.e: (r.sigma, r.passes) for r in Q.clipped_sigma(rows, "e", "x").collect()}
    assert got == {k: (pytest.approx(s), n) for k, (s, n) in ((k, plain_sigma(v)) for k, v in data.items())}
    assert Q.clipped_sigma(rows.where("false"), "e", "x").collect() == []


def test_two_means_and_dips(spark):
    g = np.random.default_rng(7)
    apart = np.concatenate([g.normal(0, 1, (200, 2)), g.normal(8, 1, (150, 2))])
    rows = [(1, x.tolist()) for x in apart] + [(2, x.tolist()) for x in g.normal(0, 1, (400, 2))] + [(3, [0.0, 0.0])] * 10 + [(4, [1.0, 1.0])] * 400
    df = spark.createDataFrame(rows, "e int, p array<double>")
    c = {r.e: sorted([r.c0, r.c1]) for r in Q.two_means(df.where("e = 1"), "e").collect()}
    low, high = apart[apart.sum(1) < 8], apart[apart.sum(1) >= 8]
    assert np.allclose(c[1], [low.mean(0), high.mean(0)])
    score = {r.e: r.score for r in Q.bimodal(df, "e").collect()}
    assert set(score) == {1, 2, 4} and score[1] > 0.9 and score[2] < 0.6 and score[4] == 0.0


def test_measured_candidates(spark):
    g = np.random.default_rng(8)
    base = g.normal(size=(6, 40)).cumsum(1)
    base[1], base[2] = base[0] + 0.001, base[0] + g.normal(0, 0.3, 40)
    wave = g.normal(size=(6, 10))
    wave[1] = wave[0]
    rows = [(i, base[i].tolist(), base[i].tolist(), wave[i].tolist(), None if i == 1 else [1.0, 2.0, i * 1.0]) for i in range(6)]
    df = spark.createDataFrame(rows, "cell_id bigint, ei array<double>, masked array<double>, wave array<double>, isi array<double>")
    got = {(r.a, r.b): r.isi for r in M.measured(df, more=["isi"]).collect()}
    c, w = np.corrcoef(base), np.corrcoef(wave)
    want = {(a, b) for a in range(6) for b in range(a + 1, 6) if any(c[a, b] > x and c[a, b] > y and w[a, b] > z for x, y, z in M.THRESHOLDS)}
    assert set(got) == want and got[0, 1] == 0.0
    assert M.measured(df, extra="isi > 0.6", more=["isi"]).collect() == []


def test_blocks_follow_the_count(spark, monkeypatch):
    g = np.random.default_rng(9)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(g.normal(size=(30, 6)))], "cell_id bigint, v array<double>")
    whole = {(r.a, r.b) for r in J.correlated_pairs(df, 0.3).collect()}
    monkeypatch.setattr(J, "BLOCK_ROWS", 7)
    assert {(r.a, r.b) for r in J.correlated_pairs(df, 0.3).collect()} == whole


def test_epochs_cut_over_batches_equal_whole_ones(spark, tmp_path):
    schema = "cell_id int, contrast int, epoch int, bin int, n double"
    rows = [(c, e % 2, e, b, float((c + 1) * (b % 4 == 0) + e)) for c in range(10) for e in range(4) for b in range(8)]
    marks = [(c, e % 2, e, None, 0.0) for c in range(10) for e in range(4)]
    early = [r for r in rows if (r[2] * 8 + r[3]) % 3 == 0]
    late = [r for r in rows if (r[2] * 8 + r[3]) % 3 == 1]
    last = [r for r in rows if (r[2] * 8 + r[3]) % 3 == 2]
    for part in (early, late + [m for m in marks if m[2] == 9], last + marks[:20], marks[20:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "s"))
    seen = []
    sink = lambda f1, top: seen.append(({(r.cell_id, r.contrast): r.f1 for r in f1.collect()}, [r.cell_id for r in top.collect()]))
    live.online_f1(files.stream_of_chunks(spark, str(tmp_path / "s"), schema), 8, str(tmp_path / "out"), sink).awaitTermination(180)
    angle = F.col("bin") * (2 * np.pi / 8)
    closed = spark.createDataFrame(rows, schema).groupBy("cell_id", "contrast", "epoch").agg(F.sum(F.col("n") * F.cos(angle)).alias("re"), F.sum(F.col("n") * F.sin(angle)).alias("im"))
    want = {(r.cell_id, r.contrast): pytest.approx(r.f1) for r in live.contrast_f1(closed, 8).collect()}
    assert seen[-1][0] == want and len(seen) == 2 and len(seen[-1][1]) == 1 and len(seen[0][0]) == 10


def test_threshold_skips_falling_noise():
    from axonloom.operators import fields as R

    image = np.zeros((12, 12))
    image[3:9, 3:9] = 0.3  # a field, with a peak
    image[5:7, 5:7] = 1.0
    assert 0.125 <= R.best_threshold(image) <= 0.3
    noisy = image.copy()
    noisy[::2, ::2] = np.maximum(noisy[::2, ::2], 0.14)  # single pixels just over the lowest thresholds
    t = R.best_threshold(noisy)
    assert 0.14 < t <= 0.3 and R.THRESHOLDS[0] == pytest.approx(0.125) and R.THRESHOLDS[-1] == pytest.approx(0.7)
    assert R.SMOOTHING.sum() == pytest.approx(1)


@pytest.mark.parametrize("span", [3, 7, 1_000])
def test_frame_blocks_change_nothing(spark, monkeypatch, span):
    monkeypatch.setattr(X, "FRAME_BLOCK", span)
    g = np.random.default_rng(3)
    shown = {e: {int(f): g.normal(size=2) for f in g.choice(40, 30, replace=False)} for e in range(2)}
    shown[1][1_000_000] = np.ones(2)  # a stray frame number
    counts = [(e, c, int(f), int(n)) for e in range(2) for c in range(3) for f, n in zip(g.choice(45, 12, replace=False), g.integers(1, 4, 12))]
    frames = spark.createDataFrame([(e, f, v.tolist()) for e, fs in shown.items() for f, v in fs.items()], "epoch_id int, frame bigint, pixels array<double>")
    got = {(r.cell_id, r.lag, r.pix): (r.total, r.n) for r in X.triggered_sums(spark.createDataFrame(counts, "epoch_id int, cell_id bigint, frame bigint, n bigint"), frames, 3).collect() if r.n}
    want = {}
    for e, c, f, n in counts:
        for lag in range(3):
            if f in shown[e] and f - lag in shown[e]:
                for p in range(2):
                    total, k = want.get((c, lag, p), (0.0, 0.0))
                    want[c, lag, p] = (total + n * shown[e][f - lag][p], k + n)
    assert got == {k: pytest.approx(v) for k, v in want.items()}
