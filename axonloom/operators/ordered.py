"""Signal logic over ordered rows: intervals, crossings, gaps, extrema, repair, smoothing, detection."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from axonloom.tables import floor_div


def _w(keys: Sequence[str], order: Sequence[str]):
    return W.partitionBy(*keys).orderBy(*order)


def intervals(points: DataFrame, keys: Sequence[str], t: str = "t_us", tie: Sequence[str] = (), bucket: int | None = None) -> DataFrame:
    """With ``isi``: time since the previous point (null for the first). With ``bucket``, rows are sorted within time
    buckets only, so that a key with a large share of the rows isn't one task's; a bucket's first point takes the
    last time of the bucket before from a small table."""
    if bucket is None:
        return points.withColumn("isi", F.col(t) - F.lag(t).over(_w(keys, [t, *tie])))
    rows = points.withColumn("_b", floor_div(t, bucket))
    ends = rows.groupBy(*keys, "_b").agg(F.max(t).alias("_end"))
    before = ends.select(*keys, "_b", F.lag("_end").over(_w(keys, ["_b"])).alias("_prev"))
    rows = rows.withColumn("_lag", F.lag(t).over(_w([*keys, "_b"], [t, *tie]))).join(before, [*keys, "_b"])
    return rows.withColumn("isi", F.col(t) - F.coalesce("_lag", "_prev")).select(*points.columns, "isi")


def crossings(signal: DataFrame, keys: Sequence[str], order: Sequence[str], x: str, threshold: float, up: bool = True) -> DataFrame:
    """Rows just before the signal crosses the threshold upwards (x < th <= next) or downwards (x >= th > next)."""
    after = F.lead(x).over(_w(keys, order))
    hit = (F.col(x) < threshold) & (after >= threshold) if up else (F.col(x) >= threshold) & (after < threshold)
    return signal.withColumn("_hit", hit).where("_hit").drop("_hit")


def gap_segments(events: DataFrame, keys: Sequence[str], t: str, gap: int) -> DataFrame:
    """(keys, start, end, n): runs of events whose steps are all below ``gap``."""
    w = _w(keys, [t])
    new = F.coalesce((F.col(t) - F.lag(t).over(w) >= gap).cast("int"), F.lit(0))
    runs = events.withColumn("_new", new).withColumn("segment", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "segment").agg(F.min(t).alias("start"), F.max(t).alias("end"), F.count("*").alias("n"))


def extrema(signal: DataFrame, keys: Sequence[str], order: Sequence[str], x: str) -> DataFrame:
    """Rows where the first difference changes sign, with ``kind`` 'max' or 'min'."""
    w = _w(keys, order)
    back, ahead = F.col(x) - F.lag(x).over(w), F.lead(x).over(w) - F.col(x)
    kind = F.when((back > 0) & (ahead < 0), "max").when((back < 0) & (ahead > 0), "min")
    return signal.withColumn("kind", kind).where("kind is not null")


def repaired_frames(frames: DataFrame, keys: Sequence[str], t: str, nominal: float, tolerance: float) -> DataFrame:
    """Frame times with single long steps (up to twice nominal, not dropped frames) shortened and short ones
    stretched to nominal, as ``t_fixed``; two passes over the steps."""
    w = _w(keys, [t])
    step = F.coalesce(F.col(t) - F.lag(t).over(w), F.lit(0.0))
    long = (F.col("_s") > nominal * (1 + tolerance)) & (F.col("_s") < nominal * 1.5)
    short = (F.col("_s") > 0) & (F.col("_s") < nominal * (1 - tolerance))
    one = frames.withColumn("_s", step).withColumn("_s", F.when(long, nominal).otherwise(F.col("_s")))
    two = one.withColumn("_s", F.when(short, nominal).otherwise(F.col("_s")))
    first = F.first(t).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return two.withColumn("t_fixed", first + F.sum("_s").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_s")


def thinned_by_gap(events: DataFrame, keys: Sequence[str], t: str, least: int) -> DataFrame:
    """Greedy: the first event, then each next at least ``least`` after the last kept. A recurrence, so one ordered
    pass per key over its times only."""

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(t, kind="stable")
        times, keep, last = pdf[t].to_numpy(), [], None
        for i, now in enumerate(times):
            if last is None or now - last >= least:
                keep.append(i)
                last = now
        return pdf.iloc[keep]

    cols = [*keys, t]
    types = dict(events.dtypes)
    return events.select(*cols).groupBy(*keys).applyInPandas(walk, ", ".join(f"{c} {types[c]}" for c in cols))


def upsampled(frames: DataFrame, keys: Sequence[str], t: str, parts: int) -> DataFrame:
    """Frame times with ``parts`` - 1 linear interpolations up to the next: (keys, frame, sub, t_sub)."""
    ahead = F.lead(t).over(_w(keys, [t]))
    rows = frames.withColumn("_n", ahead).withColumn("sub", F.explode(F.when(F.col("_n").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(parts - 1)))))
    return rows.withColumn("t_sub", F.col(t) + F.coalesce((F.col("_n") - F.col(t)) * F.col("sub") / parts, F.lit(0.0))).drop("_n")


def gaussian_taps(sigma_bins: float, taps: int = 39) -> list[float]:
    x = np.arange(taps) - taps // 2
    k = np.exp(-0.5 * (x / sigma_bins) ** 2)
    return (k / k.sum()).tolist()


def smoothed(psth: DataFrame, keys: Sequence[str], n_bins: int, taps: Sequence[float], x: str = "x", bin: str = "bin") -> DataFrame:
    """Dense bins 0..n-1 convolved with the taps, borders reflected: each bin is sent to where it counts, by an
    explode over the taps and a sum, so partial sums run before the shuffle."""
    half = len(taps) // 2
    kernel = F.array(*(F.struct(F.lit(j - half).alias("d"), F.lit(float(k)).alias("k")) for j, k in enumerate(taps)))
    # target o takes source reflect(o + d): invert by listing, for source b, the targets whose reflected index is b
    b, n = F.col(bin), F.lit(n_bins)
    spread = psth.withColumn("_k", F.explode(kernel)).withColumn("_o", F.explode(F.array_distinct(F.array(b - F.col("_k.d"), -1 - b - F.col("_k.d"), 2 * n - 1 - b - F.col("_k.d")))))
    inside = spread.where((F.col("_o") >= 0) & (F.col("_o") < n))
    return inside.groupBy(*keys, F.col("_o").alias(bin)).agg(F.sum(F.col(x) * F.col("_k.k")).alias("smooth"))


def isolated(points: DataFrame, keys: Sequence[str], left: int, right: int, t: str = "t_us", tie: Sequence[str] = ()) -> DataFrame:
    """Points with no other closer than ``left`` before or ``right`` after (exclusive)."""
    w = _w(keys, [t, *tie])
    back, ahead = F.col(t) - F.lag(t).over(w), F.lead(t).over(w) - F.col(t)
    ok = F.coalesce(back > left, F.lit(True)) & F.coalesce(ahead > right, F.lit(True))
    return points.withColumn("_ok", ok).where("_ok").drop("_ok")


def every_kth(points: DataFrame, keys: Sequence[str], wanted: int, t: str = "t_us", tie: Sequence[str] = ()) -> DataFrame:
    """Every k-th point, k = max(1, n div wanted)."""
    k = F.greatest(F.lit(1), F.floor(F.count("*").over(W.partitionBy(*keys)) / wanted))
    place = F.row_number().over(_w(keys, [t, *tie])) - 1
    return points.withColumn("_p", place).withColumn("_k", k).where("_p % _k = 0").drop("_p", "_k")


def fir_filtered(chunks: DataFrame, keys: Sequence[str], taps: Sequence[float]) -> DataFrame:
    """Causal FIR filter of chunked traces (keys, chunk, data): each chunk takes the last samples before it along as
    overlap, by a window over as many chunks as hold them, and is convolved alone (overlap-save). The trace starts on
    zeros, and again after a missing chunk."""
    k = len(taps) - 1
    inner = chunks.select(F.size("data").alias("n"), (F.lead("chunk").over(_w(keys, ["chunk"])) == F.col("chunk") + 1).alias("on")).where("on")
    shortest = inner.agg(F.min("n")).first()[0] or 1
    reach = min(k, -(-k // shortest))  # chunks that hold k samples, whatever their sizes
    end = F.struct("chunk", F.slice(F.col("data").cast("array<double>"), F.greatest(F.size("data") - k + 1, F.lit(1)), F.lit(k)).alias("data"))
    past = F.collect_list(end).over(_w(keys, ["chunk"]).rowsBetween(-reach, -1))
    near = F.filter("_past", lambda x, i: x["chunk"] == F.col("chunk") - F.size("_past") + i)  # those without a gap up to here
    lead = F.concat(F.array_repeat(F.lit(0.0), k), F.flatten(F.transform(near, lambda x: x["data"])))
    rows = chunks.withColumn("_past", past).withColumn("_tail", F.slice(lead, -k, k)).drop("_past") if k else chunks.withColumn("_tail", F.array().cast("array<double>"))
    h = np.asarray(taps, float)

    def run(batches):
        for pdf in batches:
            out = []
            for data, tail in zip(pdf.data, pdf._tail):
                x = np.asarray(data, float)
                out.append(np.convolve(np.concatenate([np.asarray(tail, float), x]), h)[k : k + len(x)])
            yield pdf.drop(columns="_tail").assign(data=out)

    types = dict(chunks.dtypes)
    return rows.mapInPandas(run, ", ".join(f"`{c}` {'array<double>' if c == 'data' else types[c]}" for c in chunks.columns))


def downsampled(frames: DataFrame, keys: Sequence[str], factor: int, means: Sequence[str] = (), sums: Sequence[str] = (), frame: str = "frame") -> DataFrame:
    """Groups of ``factor`` frames: mean or sum of each column; an incomplete last group goes."""
    group = F.floor(F.col(frame) / factor)
    out = frames.groupBy(*keys, group.alias(frame)).agg(*(F.avg(c).alias(c) for c in means), *(F.sum(c).alias(c) for c in sums), F.count("*").alias("_n"))
    return out.where(F.col("_n") == factor).drop("_n")


def every_nth_pulse(pulses: DataFrame, keys: Sequence[str], t: str, n: int = 4) -> DataFrame:
    """Every n-th pulse from the first, as frames numbered from 0."""
    place = F.row_number().over(_w(keys, [t])) - 1
    return pulses.withColumn("_p", place).where(F.col("_p") % n == 0).withColumn("frame", F.floor(F.col("_p") / n)).drop("_p")


def checked_frames(frames: DataFrame, keys: Sequence[str], t: str, fastest: float, nominal: float) -> DataFrame:
    """(keys, frame, t): the measured frames where their mean rate is at most ``fastest``, else a nominal grid from the
    first one."""
    n = F.count("*").alias("n")
    per = frames.groupBy(*keys).agg(F.min(t).alias("a"), F.max(t).alias("b"), n).withColumn("rate", (F.col("n") - 1) / (F.col("b") - F.col("a")))
    good = per.where(F.col("rate") <= fastest).select(*keys)
    kept = frames.join(good, list(keys), "left_semi").withColumn("frame", F.row_number().over(_w(keys, [t])) - 1).select(*keys, "frame", F.col(t).cast("double").alias(t))
    grid = per.where(~F.coalesce(F.col("rate") <= fastest, F.lit(False))).withColumn("frame", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))))
    return kept.unionByName(grid.select(*keys, "frame", (F.col("a") + F.col("frame") / nominal).cast("double").alias(t)))


def ranked(rows: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "rank") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(_w(keys, order)))


def pulse_epochs(signal: DataFrame, keys: Sequence[str], i: str, x: str, threshold: float) -> DataFrame:
    """(keys, start, end): stretches of a marker channel below ``threshold``: from the sample after a fall through it to the
    sample after the next rise. A stretch that the trace begins or ends in isn't one. Crossings are paired over crossings
    alone, so borders of blocks lose none."""
    ends = [crossings(signal, keys, [i], x, threshold, up).select(*keys, (F.col(i) + 1).alias("start"), F.lit(up).alias("_up")) for up in (False, True)]
    w = _w(keys, ["start"])
    rows = ends[0].unionByName(ends[1]).withColumn("end", F.lead("start").over(w))
    return rows.where("not _up and `end` is not null").drop("_up")


def in_order(rows: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """(keys, name): a key's rows as an array of structs of the columns ``order``, sorted by them."""
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order))).alias(name))
