"""Correlograms and coincidences by blocks of cells against all pairs, and rounds of losers."""

import random

import pytest

from axonloom.operators import aggregates as A
from axonloom.operators import greedy as G

FIELDS = "file int, cell_id bigint, t_us bigint"


def trains(seed, cells=9, spikes=260):
    rnd = random.Random(seed)
    return [(rnd.randrange(2), rnd.randrange(cells) * 3, rnd.randrange(-600, 600)) for _ in range(spikes)]


def lags(rows, bins, width):
    out = {}
    for f, a, t in rows:
        for g, b, s in rows:
            if f == g and a < b and -(2 * bins + 1) * width <= 2 * (s - t) < (2 * bins + 1) * width:
                key = f, a, b, (2 * (s - t) + width) // (2 * width)
                out[key] = out.get(key, 0) + 1
    return out


@pytest.mark.parametrize("limits", [{}, {"LEAST_SPIKES": 20}, {"LEAST_SPIKES": 20, "TILE": 50}, {"BLOCK_SPIKES": 3}])
def test_lags_by_blocks_equal_all_pairs(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(A, name, value)
    rows = trains(4)
    df = spark.createDataFrame([*rows, (None, 1, 5), (1, None, 5), (1, 3, None)], FIELDS)
    want = lags(rows, 2, 7)
    got = A.crosscorrelogram(df, ["file"], 2, 7).collect()
    assert {(r.file, r.a, r.b, r.bin): r.n for r in got} == want and len(got) == len(want) > 100
    total = {}
    for (f, a, b, _), n in want.items():
        total[f, a, b] = total.get((f, a, b), 0) + n
    got = A.crosscorrelogram(df, ["file"], 2, 7, "probability").collect()
    assert all(r.value == pytest.approx(want[r.file, r.a, r.b, r.bin] / total[r.file, r.a, r.b]) for r in got) and len(got) == len(want)
    size = {}
    for f, c, _ in rows:
        size[f, c] = size.get((f, c), 0) + 1
    best = {}
    for f, a, b, bin in want:
        for s in (bin - 1, bin):
            best[f, a, b] = max(best.get((f, a, b), 0), sum(want.get((f, a, b, s + k), 0) for k in range(2)))
    least = 0.12
    got = {(r.file, r.a, r.b): (r.n_a, r.n_b, r.p) for r in A.coincidence(df.dropna(), ["file"], 2, 7, 2, least=least).collect()}
    share = {k: (size[k[0], k[1]], size[k[0], k[2]], pytest.approx(n / min(size[k[0], k[1]], size[k[0], k[2]]))) for k, n in best.items()}
    assert got == {k: v for k, v in share.items() if best[k] / min(v[:2]) >= least} and 0 < len(got) < len(share)


@pytest.mark.parametrize("name", ["crosscorrelogram", "ccg_probability", "ccg_correlation", "coincidence"])
def test_pairs_of_spikes_are_not_shuffled(spark, sf, name):
    from axonloom.plans import responses

    plan = getattr(responses, name)(spark, sf)._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("MapInArrow")]
    assert "Exchange" not in above and "Join" not in above


def test_a_cell_wins_all_its_pairs_in_a_round(spark, monkeypatch):
    rows = [(0, b, 9, 1) for b in range(1, 40)]
    cuts, cut = [], G.cut
    monkeypatch.setattr(G, "cut", lambda df: cuts.append(1) or cut(df))
    gone = G.losers(spark.createDataFrame(rows, "a bigint, b bigint, n_a int, n_b int"), [])
    assert sorted(r.cell_id for r in gone.collect()) == list(range(1, 40)) and len(cuts) <= 4
