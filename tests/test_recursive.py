"""Recursive filters and detection over chunks against one pass over the whole trace."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from axonloom.operators import recursive as V
from plain import plain_filter, plain_spikes


def chunked(spark, traces, size):
    rows = [(e, k, x[k * size : (k + 1) * size].tolist()) for e, x in traces.items() for k in range(-(-len(x) // size))]
    return spark.createDataFrame(rows, "e int, chunk bigint, data array<double>").repartition(3)


def joined(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r.chunk):
        out.setdefault(r.e, []).extend(r.data)
    return out


@pytest.fixture(scope="module")
def traces():
    g = np.random.default_rng(3)
    return {1: g.normal(10, 3, 2300).cumsum() % 50, 2: g.normal(0, 1, 7), 3: g.normal(100, 20, 1000)}


@pytest.mark.parametrize("design", [V.butterworth(2, 0.05, 1.0), V.butterworth(3, 60.0, 1000.0, high=True), V.bessel(4, 0.1, 1.0), V.smoothing(0.03)])
@pytest.mark.parametrize("size, span", [(500, 512), (100, 4), (3, 8)])
def test_filters_are_the_same_over_chunks(spark, traces, design, size, span, monkeypatch):
    if size == 3 and design[0] != V.smoothing(0.03)[0]:
        pytest.skip("one design is enough for the smallest chunks")
    monkeypatch.setattr(V, "SPAN", span)  # small: maps are composed in several levels
    got = joined(V.filtered(chunked(spark, traces, size), ["e"], *design))
    for e, x in traces.items():
        assert np.allclose(got[e], plain_filter(*design, x), atol=1e-8)


def test_settled_start_and_missing_chunks(spark, traces):
    b, a = V.butterworth(2, 0.1, 1.0)
    x = traces[3]
    f = V.Filter(b, a)
    df = chunked(spark, {3: x}, 100)
    got = joined(V.filtered(df, ["e"], b, a, settle=150))[3]
    assert np.allclose(got, plain_filter(b, a, x, f.steady(x[:150].mean())))
    holed = V.filtered(df.where("chunk <> 4"), ["e"], b, a).collect()
    parts = {r.chunk: r.data for r in holed}
    assert np.allclose(parts[5], plain_filter(b, a, x[500:600])) and np.allclose(parts[3], plain_filter(b, a, x[:400])[300:])


def test_zero_phase_equals_two_plain_passes(spark, traces):
    b, a = V.butterworth(2, 0.05, 1.0)
    f, pad = V.Filter(b, a), 9
    for size in (2, 100, 4000):
        got = joined(V.zero_phase(chunked(spark, traces, size) if size > 2 else chunked(spark, {2: traces[2], 4: traces[1][:60]}, 2), ["e"], b, a))
        for e, y in got.items():
            x = traces[1][:60] if e == 4 else traces[e]
            n = min(pad, len(x) - 1)
            wide = np.concatenate([2 * x[0] - x[n:0:-1], x, 2 * x[-1] - x[-2 : -n - 2 : -1]])
            once = plain_filter(b, a, wide, f.steady(wide[0]))[::-1]
            twice = plain_filter(b, a, once, f.steady(once[0]))[::-1]
            assert np.allclose(y, twice[n : n + len(x)], atol=1e-8)


def gain(b, a, at, rate):
    z = np.exp(-2j * np.pi * at / rate)
    return abs(np.polyval(b[::-1], z) / np.polyval(a[::-1], z))


def test_designs():
    for order in (1, 2, 5):
        b, a = V.butterworth(order, 100.0, 1000.0)
        assert gain(b, a, 0, 1000) == pytest.approx(1) and gain(b, a, 100, 1000) == pytest.approx(0.5**0.5) and gain(b, a, 400, 1000) < 0.2
        b, a = V.butterworth(order, 100.0, 1000.0, high=True)
        assert gain(b, a, 500, 1000) == pytest.approx(1) and gain(b, a, 100, 1000) == pytest.approx(0.5**0.5) and gain(b, a, 0, 1000) == pytest.approx(0, abs=1e-9)
    # a published value: second order at a quarter of the Nyquist rate
    assert V.butterworth(2, 0.25, 2.0)[1] == pytest.approx([1, -0.9428090415820634, 0.3333333333333333])
    b, a = V.bessel(4, 100.0, 1000.0)
    assert gain(b, a, 0, 1000) == pytest.approx(1) and np.all(np.diff([gain(b, a, f, 1000) for f in range(0, 500, 10)]) < 0) and np.all(np.abs(np.roots(a)) < 1)
    taps = V.windowed_sinc(100, 200.0, 20_000.0, high=True)
    assert len(taps) == 101 and sum(taps) == pytest.approx(0, abs=1e-12) and taps == pytest.approx(taps[::-1])
    assert gain(taps, [1], 10_000, 20_000) == pytest.approx(1, abs=0.01) and gain(taps, [1], 20, 20_000) < 0.05


def test_detection_is_the_same_for_every_chunk_size(spark):
    g = np.random.default_rng(2)
    x = g.normal(0, 4, 4000)
    x[[500, 999, 1001, 1700, 1999, 2000, 3999]] -= 40
    x[2497:2520] -= 60  # too wide, over a border
    x[2519] -= 60  # its peak
    x[2522] -= 80  # right after it
    for settle in (1, 700):
        want = plain_spikes(x, 0.02, 9.0, 4, 6, settle)
        assert len(want) > 20 and not any(p == 2522 for p, _ in want)
        for size in (5, 500, 4000):
            got = V.detected_spikes(chunked(spark, {1: x}, size), ["e"], 0.02, 9.0, 4, 6, settle).collect()
            assert sorted(r.t for r in got) == [p for p, _ in want]
            assert np.allclose([r.amplitude for r in sorted(got, key=lambda r: r.t)], [m for _, m in want])


def test_empty_traces(spark):
    df = spark.createDataFrame([], "e int, chunk bigint, data array<double>")
    assert V.filtered(df, ["e"], *V.smoothing(0.1)).collect() == [] and V.detected_spikes(df, ["e"], 0.1, 1.0, 1, 1).collect() == []
    assert V.zero_phase(df, ["e"], *V.smoothing(0.1)).collect() == []
    one = spark.createDataFrame([(1, 0, [5.0])], "e int, chunk bigint, data array<double>")
    assert [r.data for r in V.filtered(one, ["e"], *V.smoothing(0.1), settle=1).collect()] == [pytest.approx([5.0])]
