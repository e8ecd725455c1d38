"""Counts, histograms, correlograms, condition means, tuning and other per-cell statistics.

All are grouped sums over long tables, so partial aggregation runs before each shuffle. Dense results (zero bins) are
filled from a grid of keys and bins at the very end."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from axonloom.operators.blocks import TILE, streamed
from axonloom.operators.joins import band_pairs, last_mark
from axonloom.operators.ordered import intervals
from axonloom.operators.ranks import quantiles, ranked
from axonloom.session import cut
from axonloom.tables import floor_div

# ---- counts and bins


def counted(points: DataFrame, keys: Sequence[str], least: int = 0) -> DataFrame:
    """(keys, n) of groups with at least ``least`` rows."""
    return points.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def binned(points: DataFrame, keys: Sequence[str], width: int, t: str = "t_rel_us") -> DataFrame:
    """(keys, bin, n): regular bins of integer time."""
    return points.groupBy(*keys, floor_div(t, width).alias("bin")).agg(F.count("*").alias("n"))


def binned_by_edges(points: DataFrame, edges: DataFrame, keys: Sequence[str], by: Sequence[str], t: str, bucket: int | None = None) -> DataFrame:
    """(by, keys, bin, n) over an edge table (keys, bin, lo, hi): half-open bins, the last of each key closed. With
    ``bucket``, a bin goes to the stretches of ``t`` that it touches and a point meets the bins of its own stretch only,
    not all of its key."""
    e = edges.withColumn("_last", F.col("bin") == F.max("bin").over(W.partitionBy(*keys)))
    if bucket:
        e = e.withColumn("_b", F.explode(F.sequence(F.floor(F.col("lo") / bucket), F.floor(F.col("hi") / bucket))))
        near = points.withColumn("_b", F.floor(F.col(t) / bucket)).join(e, [*keys, "_b"])
    else:
        near = points.join(e, list(keys))
    inside = (F.col(t) >= F.col("lo")) & ((F.col(t) < F.col("hi")) | (F.col("_last") & (F.col(t) == F.col("hi"))))
    return near.where(inside).groupBy(*by, *keys, "bin").agg(F.count("*").alias("n"))


def dense(sparse: DataFrame, groups: DataFrame, n_bins: int, value: str = "n", bin: str = "bin") -> DataFrame:
    """All bins 0..n-1 of every group, zeros where nothing was counted."""
    grid = groups.withColumn(bin, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_bins - 1).cast("bigint"))))
    return grid.join(sparse, [*groups.columns, bin], "left").withColumn(value, F.coalesce(value, F.lit(0)))


def frame_counts(points: DataFrame, frames: DataFrame, keys: Sequence[str], cells: Sequence[str], n_frames: int, stride: int = 1, t: str = "t_us") -> DataFrame:
    """(cells, keys, frame, n): counts between consecutive frame times, ``stride`` equal parts a frame, for frames
    0..n-1 (later ones trimmed, missing ones zero). Frames: (keys, frame, t); the last frame closes the one before."""
    w = W.partitionBy(*keys).orderBy("frame")
    edges = frames.withColumn("_next", F.lead(t).over(w)).where("_next is not null and frame < " + str(n_frames))
    marks = edges.select(*keys, t)
    seen = last_mark(points, marks, keys, t)
    at = seen.join(edges.select(*keys, F.col(t).alias("mark_us"), "frame", "_next"), [*keys, "mark_us"])
    inside = at.where((F.col(t) < F.col("_next")) | ((F.col("frame") == n_frames - 1) & (F.col(t) == F.col("_next"))))
    part = F.least(F.floor((F.col(t) - F.col("mark_us")) * stride / (F.col("_next") - F.col("mark_us"))), F.lit(stride - 1))
    sparse = inside.groupBy(*cells, *keys, (F.col("frame") * stride + part).cast("bigint").alias("frame")).agg(F.count("*").alias("n"))
    groups = points.select(*cells, *keys).distinct()
    return dense(sparse, groups, n_frames * stride, bin="frame")


def best_matches(pairs: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(a, b, score): each a's b with the largest weighted mean of several correlations (ties: smaller b)."""
    total = sum(weights.values())
    score = sum((F.col(c) * w for c, w in weights.items()), F.lit(0.0)) / total
    best = pairs.withColumn("score", score).groupBy("a").agg(F.max(F.struct("score", (-F.col("b")).alias("nb"))).alias("m"))
    return best.select("a", (-F.col("m.nb")).alias("b"), F.col("m.score").alias("score"))


def data_size(epochs: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """Epochs and the largest number of bins per key."""
    return epochs.groupBy(*keys).agg(F.count("*").alias("n_epochs"), F.max(F.ceil(F.col("dur_us") / width)).alias("max_bins"))


def condition_means(counts: DataFrame, epochs: DataFrame, conditions: Sequence[str], keys: Sequence[str], epoch: str = "epoch_id", cells: str = "cell_id") -> DataFrame:
    """Mean and population deviation per (cell, condition, bin) of sparse counts: sums over what was counted, divided
    by the condition's number of epochs, so zero bins needn't exist."""
    per = epochs.groupBy(*conditions).agg(F.countDistinct(epoch).alias("n_epochs"))
    sums = counts.groupBy(cells, *conditions, *keys).agg(F.sum("n").alias("_s"), F.sum(F.col("n") * F.col("n")).alias("_q"))
    mean = F.col("_s") / F.col("n_epochs")
    spread = F.sqrt(F.greatest(F.col("_q") / F.col("n_epochs") - mean * mean, F.lit(0.0)))
    return sums.join(per, list(conditions)).select(cells, *conditions, *keys, mean.alias("mean"), spread.alias("sd"), "n_epochs")


def tuning_index(responses: DataFrame, keys: Sequence[str], angle_deg: str, rate: str) -> DataFrame:
    """Direction and orientation selectivity: |sum w e^(ik angle)| / sum w for k = 1, 2, and the preferred angle in
    degrees (0..360); 0 where all responses are 0."""
    a = F.radians(angle_deg)
    w = F.col(rate)
    sums = responses.groupBy(*keys).agg(*(F.sum(w * f(a * k)).alias(f"_{n}{k}") for k in (1, 2) for n, f in (("c", F.cos), ("s", F.sin))), F.sum(w).alias("_w"))
    index = lambda k: F.when(F.col("_w") > 0, F.sqrt(F.col(f"_c{k}") ** 2 + F.col(f"_s{k}") ** 2) / F.col("_w")).otherwise(0.0)
    angle = F.pmod(F.round(F.degrees(F.atan2("_s1", "_c1")), 6) + 360.0, F.lit(360.0))
    return sums.select(*keys, index(1).alias("dsi"), index(2).alias("osi"), F.when(index(1) > 1e-9, angle).otherwise(0.0).alias("preferred"))


def harmonics(bins: DataFrame, keys: Sequence[str], n: int, ks: Sequence[int], x: str = "x", bin: str = "bin", demean: bool = False) -> DataFrame:
    """Amplitudes 2/n |FFT_k| of a series of n bins (missing bins are 0), as f<k>, and the mean."""
    b = F.col(bin) * (2 * 3.141592653589793 / n)
    value = F.col(x)
    sums = bins.groupBy(*keys).agg(F.sum(value).alias("_x"), *(F.sum(value * f(b * k)).alias(f"_{m}{k}") for k in ks for m, f in (("c", F.cos), ("s", F.sin))))
    return sums.select(*keys, (F.col("_x") / n).alias("mean"), *((F.sqrt(F.col(f"_c{k}") ** 2 + F.col(f"_s{k}") ** 2) * (2.0 / n)).alias(f"f{k}") for k in ks))


def folded(points: DataFrame, keys: Sequence[str], period: int, width: int, t: str = "t_us", origin: int = 0) -> DataFrame:
    """(keys, bin, n): counts by phase in a period."""
    phase = F.pmod(F.col(t) - origin, F.lit(period))
    return points.groupBy(*keys, floor_div(phase, width).alias("bin")).agg(F.count("*").alias("n"))


# ---- intervals and correlograms


def isi_histogram(points: DataFrame, keys: Sequence[str], width: int, bins: int, normalise: str = "in_range", tie: Sequence[str] = (), bucket: int | None = None, within: Sequence[str] = ()) -> DataFrame:
    """(cell keys, bin, n, fraction): interval counts below bins * width. ``normalise``: 'in_range' divides by the
    counts in range, 'all' by all intervals. Intervals don't lead from one value of the columns ``within`` (epochs) to
    another; those of all values are pooled."""
    rows = intervals(points, [*keys, *within], tie=tie, bucket=bucket).where("isi is not null").withColumn("bin", floor_div("isi", width))
    inside = F.col("bin") < bins
    counts = rows.groupBy(*keys, F.when(inside, F.col("bin")).alias("bin")).agg(F.count("*").alias("n"))
    w = W.partitionBy(*keys)
    total = F.sum(F.when(F.col("bin").isNotNull() | F.lit(normalise == "all"), F.col("n"))).over(w)
    return counts.withColumn("_t", total).where("bin is not null").withColumn("fraction", F.col("n") / F.col("_t")).drop("_t")


def refractory_percent(histogram: DataFrame, keys: Sequence[str], bins: int) -> DataFrame:
    """100 times the share of intervals in the first bins."""
    return histogram.groupBy(*keys).agg((100 * F.sum(F.when(F.col("bin") < bins, F.col("fraction")).otherwise(0.0))).alias("refractory"))


def autocorrelogram(points: DataFrame, keys: Sequence[str], lag: int, width: int, distinct_bins: int | None = None) -> DataFrame:
    """(keys, bin, n): later minus earlier time of all pairs of one cell, 0 < dt < lag. ``distinct_bins``: times are
    first cut to bins of that width, each counted once."""
    p = points.select(*keys, "t_us")
    if distinct_bins:
        p = p.select(*keys, (floor_div("t_us", distinct_bins) * distinct_bins).alias("t_us")).distinct()
    pairs = band_pairs(p, p, lag, keys).where((F.col("dt") > 0) & (F.col("dt") < lag))
    return pairs.groupBy(*keys, floor_div("dt", width).alias("bin")).agg(F.count("*").alias("n"))


def normalised(histogram: DataFrame, keys: Sequence[str], x: str = "n") -> DataFrame:
    """With ``unit``: the histogram at length 1."""
    return histogram.withColumn("unit", F.col(x) / F.sqrt(F.sum(F.col(x) * F.col(x)).over(W.partitionBy(*keys))))


def contamination(points: DataFrame, keys: Sequence[str], lo: int, hi: int, total: int) -> DataFrame:
    """(keys, n, nb, contamination): pairs with lo <= dt < hi times the recording's length over (hi - lo) n^2."""
    n = points.groupBy(*keys).agg(F.count("*").alias("n"))
    p = points.select(*keys, "t_us")
    nb = band_pairs(p, p, hi, keys).where((F.col("dt") >= lo) & (F.col("dt") < hi)).groupBy(*keys).agg(F.count("*").alias("nb"))
    out = n.join(nb, list(keys), "left").withColumn("nb", F.coalesce("nb", F.lit(0)))
    return out.withColumn("contamination", F.col("nb") * float(total) / (float(hi - lo) * F.col("n") * F.col("n")))


def crosscorrelogram(points: DataFrame, keys: Sequence[str], lag_bins: int, width: int, normalise: str | None = None, cells: DataFrame | None = None, unit: int = 1) -> DataFrame:
    """(keys, a, b, bin, n[, value]) for cells a < b of the same keys. Times are counted per ``unit`` (the recording's
    resolution) before pairing; differences are exact in units and binned afterwards, to the nearest multiple of
    ``width`` (halves go up): bin -lag_bins..lag_bins. ``probability`` divides by the pair's sum; ``correlation`` is
    (n - n1 n2 / T) / sqrt((n1 - n1^2 / T) (n2 - n2^2 / T)) with T the units from the pair's first spike to its last
    (null where that is 0). Lags of (b, a) are those of (a, b) mirrored."""
    p = points if cells is None else points.join(cells, "cell_id", "left_semi")
    u = _counted_times(p, keys, unit)
    wide, reach = width // unit, (2 * lag_bins + 1) * (width // unit)  # reach: twice the largest difference
    blocks, count = _spike_blocks(u, keys)
    if blocks:

        def finish(h: np.ndarray, x: tuple, y: tuple, place: np.ndarray) -> tuple:
            at = np.nonzero(h)
            n = h[at]
            columns = [at[2] - lag_bins, n]
            if normalise == "probability":
                columns.append(n / h.sum(2)[at[:2]])
            if normalise == "correlation":
                n1, n2 = x[0][at[1]].astype(float), y[0][at[0]].astype(float)
                span = np.maximum(x[2][at[1]], y[2][at[0]]) - np.minimum(x[1][at[1]], y[1][at[0]]) + 1.0
                power = (n1 - n1 * n1 / span) * (n2 - n2 * n2 / span)
                columns.append(pa.array((n - n1 * n2 / span) / np.sqrt(np.where(power > 0, power, 1.0)), mask=~(power > 0)))
            return at[:2], columns

        return _lagged(u, keys, blocks, count, lag_bins, wide, finish, {"bin": "bigint", "n": "bigint"} | ({"value": "double"} if normalise else {}))
    pairs = band_pairs(u, u, max(-(-reach // 2), 1), keys).where((F.col("cell_id") < F.col("cell_id_r")) & (2 * F.col("dt") >= -reach) & (2 * F.col("dt") < reach))
    out = pairs.groupBy(*keys, F.col("cell_id").alias("a"), F.col("cell_id_r").alias("b"), floor_div(2 * F.col("dt") + wide, 2 * wide).alias("bin")).agg(F.sum(F.col("m") * F.col("m_r")).alias("n"))
    if normalise == "probability":
        return out.withColumn("value", F.col("n") / F.sum("n").over(W.partitionBy(*keys, "a", "b")))
    if normalise == "correlation":
        sizes = u.groupBy(*keys, "cell_id").agg(F.sum("m").cast("double").alias("_n"), F.min("t_us").alias("_lo"), F.max("t_us").alias("_hi"))
        of = lambda cell, i: sizes.select(*keys, F.col("cell_id").alias(cell), *(F.col(c).alias(f"{c}{i}") for c in ("_n", "_lo", "_hi")))
        out = out.join(of("a", 1), [*keys, "a"]).join(of("b", 2), [*keys, "b"])
        n1, n2, span = F.col("_n1"), F.col("_n2"), (F.greatest("_hi1", "_hi2") - F.least("_lo1", "_lo2") + 1).cast("double")
        spread = F.sqrt((n1 - n1 * n1 / span) * (n2 - n2 * n2 / span))
        value = F.when(spread > 0, (F.col("n") - n1 * n2 / span) / spread)
        return out.withColumn("value", value).drop("_n1", "_n2", "_lo1", "_lo2", "_hi1", "_hi2")
    return out


#: Spikes of a block of cells, and those of a block of a smaller recording, which is cut into SPREAD of them at most.
BLOCK_SPIKES = 1 << 20
LEAST_SPIKES = 20_000
SPREAD = 8


def _counted_times(points: DataFrame, keys: Sequence[str], unit: int) -> DataFrame:
    """(keys, cell_id, t_us in units, m): how many spikes a cell has at a time."""
    known = points.dropna(subset=[*keys, "cell_id", "t_us"])
    return cut(known.groupBy(*keys, "cell_id", floor_div("t_us", unit).alias("t_us")).agg(F.count("*").alias("m")))


def _spike_blocks(u: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
    """(blocks of cells, number of keys); no blocks if a cell alone has more spikes than a block."""
    per = u.groupBy(*keys, "cell_id").agg(F.count("*").alias("n")).groupBy(*keys).agg(F.sum("n").alias("n"), F.max("n").alias("most"))
    n, most, count = (x or 0 for x in per.agg(F.max("n"), F.max("most"), F.count("*")).first())
    return 0 if most > BLOCK_SPIKES else max(1, -(-n // BLOCK_SPIKES), min(-(-n // LEAST_SPIKES), SPREAD)), count


def _lagged(u: DataFrame, keys: Sequence[str], blocks: int, count: int, lag_bins: int, wide: int, finish: Callable, values: dict[str, str]) -> DataFrame:
    """(keys, a, b, values): where two blocks of cells meet, the lags of all their pairs are counted cell by cell, and
    ``finish(counts (passing, held, lag bin), held sizes, passing sizes, place)`` gives (passing, held) places and columns.
    Sizes are (spikes, first, last time) a cell; held cells before a passing one's ``place`` have smaller ids. Pairs of
    spikes never leave a task."""
    keys, bins, reach = list(keys), 2 * lag_bins + 1, (2 * lag_bins + 1) * wide
    dealt = u.withColumn("_at", F.pmod(F.xxhash64("cell_id"), F.lit(blocks)).cast("int"))
    columns, here = [*keys, "cell_id", "t_us", "m"], F.col("_at")
    held = dealt.withColumn("_j", F.explode(F.sequence(here, F.lit(blocks - 1)))).select(*columns, here.alias("_i"), "_j")
    passing = dealt.withColumn("_i", F.explode(F.sequence(F.lit(0), here))).select(*columns, "_i", here.alias("_j"))
    types = dict(u.dtypes)
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), f"a {types['cell_id']}", f"b {types['cell_id']}", *(f"{c} {t}" for c, t in values.items())])

    def numbers(rows) -> tuple:
        ids, t, m = (rows.column(c) for c in ("cell_id", "t_us", "m"))
        return tuple(c.to_numpy() if isinstance(rows, pa.Table) else c.to_numpy(zero_copy_only=False) for c in (ids, t, m))

    def cells_of(ids: np.ndarray, t: np.ndarray, m: np.ndarray) -> tuple:
        """(cells, code a spike, times, counts, sizes), spikes in order of time."""
        order = np.argsort(t, kind="stable")
        cells, code = np.unique(ids[order], return_inverse=True)
        t, m = t[order], m[order]
        first = np.unique(code, return_index=True)[1]
        last = len(code) - 1 - np.unique(code[::-1], return_index=True)[1]
        return cells, code, t, m, (np.bincount(code, m, len(cells)).astype(np.int64), t[first], t[last])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """Spikes of whole cells."""
        kept = None
        for batch in batches:
            now = numbers(batch)
            now = now if kept is None else tuple(map(np.concatenate, zip(kept, now)))
            at = int(np.argmax(now[0] == now[0][-1]))
            if at:
                yield tuple(x[:at] for x in now)
            kept = tuple(x[at:] for x in now)
        if kept is not None:
            yield kept

    def counted_lags(x: tuple, y: tuple, place: np.ndarray, same: bool) -> np.ndarray:
        cells, code, t, m, *_ = x
        others, own, at, n, _ = y
        lo, hi = np.searchsorted(t, at - reach // 2, "left"), np.searchsorted(t, at + reach // 2, "right")
        many = hi - lo
        ends, once = np.cumsum(many), bool((m == 1).all() and (n == 1).all())
        out = np.zeros(len(others) * len(cells) * bins, np.int64)
        start = 0
        while start < len(at):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + TILE, "right")))
            k = many[start:stop]
            which = np.repeat(np.arange(start, stop), k)
            spike = np.repeat(lo[start:stop] - (np.cumsum(k) - k), k) + np.arange(k.sum())
            c, o = code[spike], own[which]
            before = c < place[o]  # the held cell's id is the smaller one
            d = np.where(before, at[which] - t[spike], t[spike] - at[which])
            ok = (2 * d >= -reach) & (2 * d < reach) & (before if same else True)
            bin = (o * len(cells) + c) * bins + (2 * d + wide) // (2 * wide) + lag_bins
            got = np.bincount(bin[ok], None if once else (m[spike] * n[which])[ok], len(out))
            out += got if once else np.rint(got).astype(np.int64)
            start = stop
        return out.reshape(len(others), len(cells), bins)

    def meet(group: tuple, x: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, TILE // (len(x[0]) * bins))
        for ids, t, m in whole(batches):
            starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            cuts = [*starts[::step].tolist(), len(ids)]
            for lo, hi in zip(cuts, cuts[1:]):
                y = cells_of(ids[lo:hi], t[lo:hi], m[lo:hi])
                place = np.searchsorted(x[0], y[0])
                (q, p), made = finish(counted_lags(x, y, place, group[-2] == group[-1]), x[4], y[4], place)
                if len(p):
                    before, own, other = p < place[q], x[0][p], y[0][q]
                    named = [pa.repeat(pa.scalar(group[k], x[5][c]), len(p)) for k, c in enumerate(keys)]
                    ends = [pa.array(np.where(before, *pair), x[5]["cell_id"]) for pair in ((own, other), (other, own))]
                    yield pa.RecordBatch.from_arrays([*named, *ends, *map(pa.array, made)], names=[*keys, "a", "b", *values])

    tasks = count * blocks * (blocks + 1) // 2
    hold = lambda _, rows: (*cells_of(*numbers(rows)), {c: rows.schema.field(c).type for c in [*keys, "cell_id"]})
    return streamed(held, passing, [*keys, "_i", "_j"], hold, meet, schema, tasks, ["cell_id"])


def consecutive_correlogram(points: DataFrame, keys: Sequence[str], lag_bins: int, width: int, tie: Sequence[str] = ()) -> DataFrame:
    """(keys, bin, n, probability): intervals of consecutive points only, bins 0..lag_bins."""
    rows = intervals(points, keys, tie=tie).where("isi is not null").withColumn("bin", floor_div("isi", width)).where(F.col("bin") <= lag_bins)
    counts = rows.groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    return counts.withColumn("probability", F.col("n") / F.sum("n").over(W.partitionBy(*keys)))


def consecutive_correlation(points: DataFrame, keys: Sequence[str], lag_bins: int, width: int, unit: int = 1, tie: Sequence[str] = ()) -> DataFrame:
    """(keys, bin, n, value): the same counts of all bins 0..lag_bins, of intervals up to lag_bins * width, less the mean
    k * k / T and over k - k * k / T, with k one less than the points and T from the first to the last but one, plus one;
    times in ``unit``. Keys with fewer than two points are missing."""
    rows = intervals(points.withColumn("t_us", floor_div("t_us", unit)), keys, tie=tie).where("isi is not null")
    k = F.col("_k").cast("double")
    per = rows.groupBy(*keys).agg(F.count("*").alias("_k"), (F.max(F.col("t_us") - F.col("isi")) - F.min(F.col("t_us") - F.col("isi")) + 1).alias("_t"))
    dense = per.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(lag_bins).cast("bigint"))))
    counts = rows.where(F.col("isi") <= lag_bins * width).groupBy(*keys, floor_div("isi", width).alias("bin")).agg(F.count("*").alias("n"))
    mean = k * k / F.col("_t")
    return dense.join(counts, [*keys, "bin"], "left").select(*keys, "bin", F.coalesce("n", F.lit(0)).alias("n"), ((F.coalesce("n", F.lit(0)) - mean) / F.nullif(k - mean, F.lit(0.0))).alias("value"))


def coincidence(points: DataFrame, keys: Sequence[str], lag_bins: int, width: int, moving: int, unit: int = 1, least: float = 0.0) -> DataFrame:
    """(keys, a, b, n_a, n_b, p): the largest sum of ``moving`` neighbouring lag bins over the smaller train's size, for
    pairs where it is at least ``least``."""
    u = _counted_times(points, keys, unit)
    blocks, count = _spike_blocks(u, keys)
    if blocks:

        def finish(h: np.ndarray, x: tuple, y: tuple, place: np.ndarray) -> tuple:
            # a bin counts in the windows that start up to moving - 1 before it
            sums = np.cumsum(np.pad(h, ((0, 0), (0, 0), (moving, moving - 1))), 2)
            best = (sums[:, :, moving:] - sums[:, :, :-moving]).max(2)
            q, p = at = np.nonzero((best > 0) & (best >= least * np.minimum(x[0], y[0][:, None]) * (1 - 1e-9)))
            before, own, other = p < place[q], x[0][p], y[0][q]
            return at, [np.where(before, own, other), np.where(before, other, own), best[at] / np.minimum(own, other)]

        found = _lagged(u, keys, blocks, count, lag_bins, width // unit, finish, {"n_a": "bigint", "n_b": "bigint", "p": "double"})
        return found.where(F.col("p") >= least)
    ccg = crosscorrelogram(points, keys, lag_bins, width, unit=unit)
    starts = ccg.withColumn("s", F.explode(F.sequence(F.col("bin") - (moving - 1), F.col("bin")))).groupBy(*keys, "a", "b", "s").agg(F.sum("n").alias("w"))
    best = starts.groupBy(*keys, "a", "b").agg(F.max("w").alias("w"))
    sizes = points.groupBy(*keys, "cell_id").agg(F.count("*").alias("_n"))
    a = sizes.withColumnRenamed("cell_id", "a").withColumnRenamed("_n", "n_a")
    b = sizes.withColumnRenamed("cell_id", "b").withColumnRenamed("_n", "n_b")
    return best.join(a, [*keys, "a"]).join(b, [*keys, "b"]).withColumn("p", F.col("w") / F.least("n_a", "n_b")).select(*keys, "a", "b", "n_a", "n_b", "p").where(F.col("p") >= least)


# ---- vectors in long form


def pearson(pairs: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """(keys, r) over rows where both are known; 0 without spread."""
    ok = F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y)
    rows = pairs.where(ok)
    n, sx, sy = F.count("*"), F.sum(x), F.sum(y)
    sxy, sxx, syy = F.sum(F.col(x) * F.col(y)), F.sum(F.col(x) * F.col(x)), F.sum(F.col(y) * F.col(y))
    down = F.sqrt((n * sxx - sx * sx) * (n * syy - sy * sy))
    return rows.groupBy(*keys).agg(F.when(down > 0, (n * sxy - sx * sy) / down).otherwise(0.0).alias("r"))


def cosine(pairs: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """(keys, c): sum xy / sqrt(sum x^2 sum y^2); 0 without length."""
    down = F.sqrt(F.sum(F.col(x) * F.col(x)) * F.sum(F.col(y) * F.col(y)))
    return pairs.groupBy(*keys).agg(F.when(down > 0, F.sum(F.col(x) * F.col(y)) / down).otherwise(0.0).alias("c"))


def array_energy(wave: str | Column, mean: bool = True) -> Column:
    """Mean (or sum) of squares of an array."""
    w = F.col(wave) if isinstance(wave, str) else wave
    total = F.aggregate(w, F.lit(0.0), lambda s, x: s + x * x)
    return total / F.size(w) if mean else total


def mean_waves(waves: DataFrame, keys: Sequence[str], wave: str = "wave") -> DataFrame:
    """(keys, k, mean, error, n): mean of each sample over waves, error sqrt((sum v^2 - n m^2) / n)."""
    long = waves.select(*keys, F.posexplode(wave).alias("k", "v"))
    return long.groupBy(*keys, "k").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("error"), F.count("*").alias("n"))


def loud(waves: DataFrame, noise: DataFrame, k: float) -> DataFrame:
    """``waves`` (electrode, wave, ...) whose trough is deeper than ``k`` times the noise (electrode, noise)."""
    return waves.join(noise, "electrode").where(F.abs(F.array_min("wave")) > k * F.col("noise"))


def peak_scaled(rows: DataFrame, keys: Sequence[str], value: str = "value", middle: float | None = None) -> DataFrame:
    """``value`` over the key's largest magnitude, 0 where that is 0. With a ``middle``, what is above or below it is scaled
    so and halved about it."""
    x = F.col(value) - F.lit(middle or 0.0)
    scaled = F.coalesce(x / F.nullif(F.max(F.abs(x)).over(W.partitionBy(*keys)), F.lit(0.0)), F.lit(0.0))
    return rows.withColumn(value, scaled if middle is None else scaled / 2 + middle)


def period_means(points: DataFrame, keys: Sequence[str], period: int, width: int, t: str = "t_us") -> DataFrame:
    """(keys, bin, mean): points a period by phase, over the periods from time 0 to the last one with a point."""
    periods = points.groupBy(*keys).agg((F.max(floor_div(t, period)) + 1).alias("_n"))
    return folded(points, keys, period, width, t).join(periods, list(keys)).select(*keys, "bin", (F.col("n") / F.col("_n")).alias("mean"))


def weighted_merge(rows: DataFrame, keys: Sequence[str], value: str, weight: str, error: str | None = None) -> DataFrame:
    """(keys, value, weight[, error]): weighted mean; errors as root of the weighted mean square."""
    w = F.col(weight)
    out = [(F.sum(w * F.col(value)) / F.sum(w)).alias(value), F.sum(w).alias(weight)]
    if error:
        out.append(F.sqrt(F.sum(w * F.col(error) ** 2) / F.sum(w)).alias(error))
    return rows.groupBy(*keys).agg(*out)


def robust_sd(rows: DataFrame, keys: Sequence[str], x: str, method: str = "mad") -> DataFrame:
    """(keys, sd): 1.4826 MAD, 0.7413 IQR, or the sample deviation."""
    if method == "sd":
        return rows.groupBy(*keys).agg(F.stddev_samp(x).alias("sd"))
    rows = rows.where(F.col(x).isNotNull())
    if method == "iqr":
        q = quantiles(rows, keys, x, {"_hi": 0.75, "_lo": 0.25})
        return q.select(*keys, ((F.col("_hi") - F.col("_lo")) * 0.7413).alias("sd"))
    mid = cut(quantiles(rows, keys, x, {"_m": 0.5}))
    off = rows.join(mid, list(keys)).select(*keys, F.abs(F.col(x) - F.col("_m")).alias("_x"))
    return quantiles(off, keys, "_x", {"_mad": 0.5}).select(*keys, (F.col("_mad") * 1.4826).alias("sd"))


def class_averages(rows: DataFrame, by: str, scalars: Sequence[str] = (), array: str | None = None) -> DataFrame:
    """Means with their standard error per class; of an array column, per element."""
    if array:
        long = rows.select(by, F.posexplode(array).alias("k", "v"))
        return long.groupBy(by, "k").agg(F.avg("v").alias("mean"), (F.stddev_samp("v") / F.sqrt(F.count("v"))).alias("error"))
    return rows.groupBy(by).agg(*(e for c in scalars for e in (F.avg(c).alias(c), (F.stddev_samp(c) / F.sqrt(F.count(c))).alias(f"{c}_error"))))


def equal_count_bins(rows: DataFrame, keys: Sequence[str], x: str, y: str, bins: int, tie: Sequence[str] = ()) -> DataFrame:
    """(keys, bin, x, y): rows sorted by x in bins of n div bins, the remainder dropped, with both means."""
    sizes = rows.groupBy(*keys).agg(F.floor(F.count("*") / bins).alias("_k")).where("_k > 0")
    rows = ranked(rows, keys, x, tie, "_p").join(sizes, list(keys))
    rows = rows.withColumn("bin", F.floor(F.col("_p") / F.col("_k"))).where(F.col("bin") < bins)
    return rows.groupBy(*keys, "bin").agg(F.avg(x).alias("x"), F.avg(y).alias("y"))


def equal_width_bins(rows: DataFrame, keys: Sequence[str], x: str, y: str, lo: float, hi: float, bins: int) -> DataFrame:
    """(keys, bin, n, x, y) over [lo, hi)."""
    b = F.floor((F.col(x) - lo) / ((hi - lo) / bins))
    return rows.withColumn("bin", b).where((F.col("bin") >= 0) & (F.col("bin") < bins)).groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.avg(x).alias("x"), F.avg(y).alias("y"))


def mosaic_spacing(cells: DataFrame, by: str) -> DataFrame:
    """(class, mean, sd, n) of 2 d / (s_i + s_j), s = sqrt(sx sy), over pairs i < j of a class with finite sizes."""
    a = cells.select(by, "cell_id", "x", "y", F.sqrt(F.col("sx") * F.col("sy")).alias("s"))
    b = a.select(by, *(F.col(c).alias(f"{c}_r") for c in ("cell_id", "x", "y", "s")))
    d = 2 * F.sqrt((F.col("x") - F.col("x_r")) ** 2 + (F.col("y") - F.col("y_r")) ** 2) / (F.col("s") + F.col("s_r"))
    return a.join(b, by).where("cell_id < cell_id_r").groupBy(by).agg(F.avg(d).alias("mean"), F.stddev_samp(d).alias("sd"), F.count("*").alias("n"))


def trigger_periods(triggers: DataFrame, keys: Sequence[str], nominal: float, frames: int, tie: Sequence[str] = ()) -> DataFrame:
    """(keys, refresh, dropped): mean step per frame of normal steps, and frames lost in longer ones."""
    rows = intervals(triggers, keys, tie=tie).where("isi is not null")
    many = F.round(F.col("isi") / nominal)
    return rows.groupBy(*keys).agg((F.avg(F.when(many == 1, F.col("isi"))) / frames).alias("refresh"), F.sum(F.greatest(many - 1, F.lit(0.0)) * frames).cast("bigint").alias("dropped"))


def selectivity(p: DataFrame, keys: Sequence[str] = ("target", "electrode", "amp", "other")) -> DataFrame:
    """(target, value): max over electrodes of the min over other cells of the max over amplitudes of
    p (1 - p_other), for rows (target, electrode, amp, other, p, p_other)."""
    target, electrode, _, other = keys
    one = p.groupBy(target, electrode, other).agg(F.max(F.col("p") * (1 - F.col("p_other"))).alias("v"))
    two = one.groupBy(target, electrode).agg(F.min("v").alias("v"))
    return two.groupBy(target).agg(F.max("v").alias("value"))


def rate_by_current(rows: DataFrame, keys: Sequence[str], g: str, n: str, refresh_ms: float, width: float = 0.05, limit: float = 10.0) -> DataFrame:
    """(keys, bin, rate, error): spikes per frame of each generator bin: 1000/refresh x/y and
    1000/refresh sqrt(x (x + y) / y^3) for x spikes in y frames."""
    b = F.floor((F.col(g) + limit) / width)
    sums = rows.where(F.abs(g) < limit).groupBy(*keys, b.alias("bin")).agg(F.sum(n).alias("x"), F.count("*").alias("y"))
    k = 1000.0 / refresh_ms
    return sums.select(*keys, "bin", (k * F.col("x") / F.col("y")).alias("rate"), (k * F.sqrt(F.col("x") * (F.col("x") + F.col("y")) / F.col("y") ** 3)).alias("error"))
