"""Receptive-field features from spike-triggered averages in long form (cell_id, lag, pix, value)."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def significant_pixels(sta: DataFrame, depth: int, threshold: float) -> DataFrame:
    """(cell_id, pix, z): variance over the first half of the lags against mean and deviation, over pixels, of the
    variance over the second half."""
    early = F.when(F.col("lag") < depth / 2, F.col("value"))
    late = F.when(F.col("lag") >= depth / 2, F.col("value"))
    v = sta.groupBy("cell_id", "pix").agg(F.var_pop(early).alias("a"), F.var_pop(late).alias("b"))
    base = v.groupBy("cell_id").agg(F.avg("b").alias("m"), F.stddev_pop("b").alias("s"))
    return v.join(base, "cell_id").withColumn("z", (F.col("a") - F.col("m")) / F.nullif(F.col("s"), F.lit(0.0))).where(F.col("z") >= threshold).select("cell_id", "pix", "z")


def top_pixels(sta: DataFrame, depth: int, n: int) -> DataFrame:
    """The n pixels of a cell with the largest variance over the first half of the lags."""
    v = sta.where(F.col("lag") < depth / 2).groupBy("cell_id", "pix").agg(F.var_pop("value").alias("variance"))
    return v.withColumn("rank", F.row_number().over(W.partitionBy("cell_id").orderBy(F.desc("variance"), "pix"))).where(F.col("rank") <= n)


def time_course(sta: DataFrame, pixels: DataFrame) -> DataFrame:
    """(cell_id, lag, tc): sum over the given pixels, at unit length per cell."""
    tc = sta.join(pixels.select("cell_id", "pix"), ["cell_id", "pix"], "left_semi").groupBy("cell_id", "lag").agg(F.sum("value").alias("tc"))
    norm = F.sqrt(F.sum(F.col("tc") * F.col("tc")).over(W.partitionBy("cell_id")))
    return tc.withColumn("tc", F.when(norm > 0, F.col("tc") / norm).otherwise(0.0))


def color_courses(sta: DataFrame, pixels: DataFrame) -> DataFrame:
    """(cell_id, color, lag, tc): sums over the given pixels for each colour, over the largest norm of a cell's colours."""
    tc = sta.join(pixels.select("cell_id", "pix"), ["cell_id", "pix"], "left_semi").groupBy("cell_id", "color", "lag").agg(F.sum("value").alias("tc"))
    norms = tc.groupBy("cell_id", "color").agg(F.sqrt(F.sum(F.col("tc") * F.col("tc"))).alias("l2")).groupBy("cell_id").agg(F.max("l2").alias("l2"))
    return tc.join(norms, "cell_id").withColumn("tc", F.coalesce(F.col("tc") / F.nullif("l2", F.lit(0.0)), F.lit(0.0))).drop("l2")


def spatial_map(sta: DataFrame, course: DataFrame) -> DataFrame:
    """(cell_id, pix, value): the average projected on the time course."""
    return sta.join(course, ["cell_id", "lag"]).groupBy("cell_id", "pix").agg(F.sum(F.col("value") * F.col("tc")).alias("value"))


def _per_cell(df: DataFrame, f, schema: str) -> DataFrame:
    """One small array per cell (lags x pixels) to one helper call."""
    return df.groupBy("cell_id").applyInPandas(f, schema)


def _grid(pdf: pd.DataFrame) -> np.ndarray:
    return pdf.pivot_table(index="lag", columns="pix", values="value", fill_value=0.0, aggfunc="sum").to_numpy()


def without_slow(sta: DataFrame, rate: float, cutoff: float) -> DataFrame:
    """(cell_id, lag, pix, value) without temporal frequencies up to ``cutoff``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        g = pdf.pivot_table(index="lag", columns="pix", values="value", fill_value=0.0, aggfunc="sum")
        f = np.fft.fft(g.to_numpy(), axis=0)
        f[np.abs(np.fft.fftfreq(len(g), 1 / rate)) <= cutoff] = 0
        out = pd.DataFrame(np.fft.ifft(f, axis=0).real, index=g.index, columns=g.columns).stack().rename("value").reset_index()
        return out.assign(cell_id=pdf.cell_id.iloc[0])[["cell_id", "lag", "pix", "value"]]

    return _per_cell(sta, run, "cell_id bigint, lag int, pix int, value double")


def separable(sta: DataFrame) -> DataFrame:
    """(cell_id, time, space, r): first singular vectors (sign: time's largest entry positive) and how well their
    product fits."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        g = _grid(pdf)
        u, s, v = np.linalg.svd(g, full_matrices=False)
        time, space = u[:, 0], v[0] * s[0]
        sign = 1.0 if time[np.abs(time).argmax()] >= 0 else -1.0
        fit = np.outer(time, space).ravel()
        r = float(np.corrcoef(fit, g.ravel())[0, 1]) if fit.std() > 0 and g.std() > 0 else 0.0
        return pd.DataFrame({"cell_id": [pdf.cell_id.iloc[0]], "time": [(time * sign).tolist()], "space": [(space * sign).tolist()], "r": [r]})

    return _per_cell(sta, run, "cell_id bigint, time array<double>, space array<double>, r double")


def chi2_survival(x: np.ndarray, k: int) -> np.ndarray:
    """P(chi-square with k degrees > x), closed form."""
    out = np.array([math.erfc(math.sqrt(max(v, 0) / 2)) for v in np.ravel(x)]) if k % 2 else np.zeros(np.size(x))
    half = np.maximum(np.ravel(x), 0) / 2
    term = np.exp(-half) * (np.sqrt(half) / math.gamma(1.5) if k % 2 else 1.0)
    for j in range((k - 1) // 2 if k % 2 else k // 2):
        out = out + term
        term = term * half / (j + (1.5 if k % 2 else 1.0))
    return np.clip(out, 0, 1)


def chi2_pixels(sta: DataFrame, frames: Sequence[int], noise: Sequence[int], level: float = 0.05) -> DataFrame:
    """(cell_id, pix, p): sum over frames of (value / noise)^2, noise being 1.4826 MAD over the noise lags; kept where
    p < level / pixels."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        g = pdf.pivot_table(index="lag", columns="pix", values="value", fill_value=0.0, aggfunc="sum")
        quiet = g.loc[g.index.isin(noise)].to_numpy()
        sd = 1.4826 * np.median(np.abs(quiet - np.median(quiet))) or np.inf
        p = chi2_survival(((g.loc[g.index.isin(frames)].to_numpy() / sd) ** 2).sum(axis=0), len(frames))
        out = pd.DataFrame({"cell_id": pdf.cell_id.iloc[0], "pix": g.columns.to_numpy(), "p": p})
        return out[out.p < level / g.shape[1]]

    return _per_cell(sta, run, "cell_id bigint, pix int, p double")


def islands(mask: np.ndarray) -> np.ndarray:
    """Areas of the 4-connected parts of a mask."""
    seen, areas = np.zeros(mask.shape, bool), []
    for start in zip(*np.nonzero(mask)):
        if seen[start]:
            continue
        stack, area = [start], 0
        seen[start] = True
        while stack:
            y, x = stack.pop()
            area += 1
            for b in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                if 0 <= b[0] < mask.shape[0] and 0 <= b[1] < mask.shape[1] and mask[b] and not seen[b]:
                    seen[b] = True
                    stack.append(b)
        areas.append(area)
    return np.array(areas, int)


#: Thresholds that are tried (logarithmic steps between two shares of the maximum), and the weights that
#: smooth five neighbouring results by a cubic.
THRESHOLDS = np.geomspace(0.125, 0.7, 20)
SMOOTHING = np.array([-3, 12, 17, 12, -3]) / 35


def best_threshold(image: np.ndarray, thresholds: np.ndarray = THRESHOLDS) -> float:
    """The threshold (share of the maximum) with the largest mean island, after smoothing over thresholds, from the first
    one on at which the mean island grows: low ones that only lose noise don't count."""
    share = image / (np.nanmax(image) or 1.0)
    share = np.nan_to_num(share, nan=0.0, posinf=0.0, neginf=0.0)
    found = [islands(share >= t) for t in thresholds]
    mean = np.array([f.mean() if len(f) else 0.0 for f in found])
    grows = np.flatnonzero(np.diff(mean) > 0)
    start = int(grows[0]) + 1 if len(grows) else 0
    smooth = np.convolve(np.pad(mean, 2, "edge"), SMOOTHING, "valid")
    return float(thresholds[start + int(smooth[start:].argmax())])


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise, by the monotone chain."""
    pts = sorted(set(map(tuple, points.tolist())))
    if len(pts) < 3:
        return np.array(pts, float)

    def half(seq):
        out: list = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(pts) + half(pts[::-1]), float)


def polygon_area(p: np.ndarray) -> float:
    if len(p) < 3:
        return 0.0
    x, y = p[:, 0], p[:, 1]
    return float(abs((x * np.roll(y, -1) - y * np.roll(x, -1)).sum()) / 2)


def field_shape(maps: DataFrame, width: int) -> DataFrame:
    """(cell_id, threshold, area, x, y, sx, sy, angle): hull area above the best threshold; centre, deviations and
    orientation by the moments of the map above it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        image = np.zeros((int(pdf.pix.max()) // width + 1, width))
        image[pdf.pix.to_numpy() // width, pdf.pix.to_numpy() % width] = pdf.value
        image = np.abs(image)
        t = best_threshold(image)
        y, x = np.nonzero(image >= t * (image.max() or 1.0))
        w = image[y, x]
        w = w / w.sum() if w.sum() > 0 else np.full(len(w), 1 / max(1, len(w)))
        mx, my = float((w * x).sum()), float((w * y).sum())
        c = np.array([[(w * (x - mx) ** 2).sum(), (w * (x - mx) * (y - my)).sum()], [0, (w * (y - my) ** 2).sum()]])
        c[1, 0] = c[0, 1]
        values, vectors = np.linalg.eigh(c)
        sd = np.sqrt(np.maximum(values, 0.25))
        area = polygon_area(hull(np.stack([x, y], 1)))
        return pd.DataFrame({"cell_id": [pdf.cell_id.iloc[0]], "threshold": [t], "area": [area], "x": [mx], "y": [my], "sx": [float(sd[1])], "sy": [float(sd[0])], "angle": [float(np.degrees(np.arctan2(vectors[1, 1], vectors[0, 1])) % 180)]})

    return _per_cell(maps, run, "cell_id bigint, threshold double, area double, x double, y double, sx double, sy double, angle double")


def field_size(shapes: DataFrame, stixel: float, micron: float) -> DataFrame:
    """With ``size``: 2 sqrt(sx sy) in microns."""
    return shapes.withColumn("size", F.sqrt(F.col("sx") * F.col("sy")) * stixel * micron * 2)


def axon_speed(ei: DataFrame, least_amplitude: float) -> DataFrame:
    """(cell_id, speed, n): slope of distance from the soma against delay over electrodes later than the soma whose
    amplitude is large enough. Rows: (cell_id, electrode, x, y, amplitude, delay); the soma is the largest."""
    soma = ei.groupBy("cell_id").agg(F.max_by(F.struct("x", "y", "delay"), F.struct("amplitude", -F.col("electrode"))).alias("s"))
    d = F.sqrt((F.col("x") - F.col("s.x")) ** 2 + (F.col("y") - F.col("s.y")) ** 2)
    rows = ei.join(soma, "cell_id").where((F.col("delay") > F.col("s.delay")) & (F.col("amplitude") >= least_amplitude))
    return rows.groupBy("cell_id").agg(F.regr_slope(d, (F.col("delay") - F.col("s.delay")).cast("double")).alias("speed"), F.count("*").alias("n"))


def conduction_velocity(ei: DataFrame, top: int = 10, least_delay: float = 1.0) -> DataFrame:
    """(cell_id, velocity): amplitude-weighted mean of distance / delay over the ``top`` electrode pairs (by summed
    amplitude) whose delays differ by more than ``least_delay``."""
    a = ei.select("cell_id", *(F.col(c).alias(f"{c}1") for c in ("electrode", "x", "y", "amplitude", "delay")))
    b = ei.select("cell_id", *(F.col(c).alias(f"{c}2") for c in ("electrode", "x", "y", "amplitude", "delay")))
    dt = F.abs(F.col("delay1") - F.col("delay2"))
    w = F.col("amplitude1") + F.col("amplitude2")
    d = F.sqrt((F.col("x1") - F.col("x2")) ** 2 + (F.col("y1") - F.col("y2")) ** 2)
    pairs = a.join(b, "cell_id").where("electrode1 < electrode2").where(dt > least_delay).select("cell_id", "electrode1", "electrode2", w.alias("w"), (d / dt).alias("v"))
    rank = F.row_number().over(W.partitionBy("cell_id").orderBy(F.desc("w"), "electrode1", "electrode2"))
    return pairs.withColumn("r", rank).where(F.col("r") <= top).groupBy("cell_id").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("velocity"))


def direction_profile(ei: DataFrame, sectors: int = 30, least: float = 300.0) -> DataFrame:
    """(cell_id, sector, amplitude): mean amplitude by direction from the soma, over electrodes farther than
    ``least``; sectors count from the strongest."""
    soma = ei.groupBy("cell_id").agg(F.max_by(F.struct("x", "y"), F.struct("amplitude", -F.col("electrode"))).alias("s"))
    dx, dy = F.col("x") - F.col("s.x"), F.col("y") - F.col("s.y")
    far = ei.join(soma, "cell_id").where(F.sqrt(dx**2 + dy**2) > least)
    sector = F.floor(F.pmod(F.degrees(F.atan2(dy, dx)) + 360.0, F.lit(360.0)) / (360.0 / sectors))
    rows = far.groupBy("cell_id", sector.alias("sector")).agg(F.avg("amplitude").alias("amplitude"))
    peak = rows.groupBy("cell_id").agg(F.max_by("sector", F.struct("amplitude", -F.col("sector"))).alias("p"))
    return rows.join(peak, "cell_id").select("cell_id", F.pmod(F.col("sector") - F.col("p"), F.lit(sectors)).alias("sector"), "amplitude")
