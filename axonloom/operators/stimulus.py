"""Stimulus replay and spike-triggered statistics.

Frames are arrays of pixels and stay so: counts and frames of a block of an epoch meet once (cogrouped), a matrix product
gives partial sums per (cell, lag), and only those are shuffled and added."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from axonloom.operators.joins import interval_join
from axonloom.tables import floor_div

#: Frames of an epoch that a task holds at once.
FRAME_BLOCK = 1_024


def noise_frames(epochs: DataFrame, pixels: int, stride: int = 1, kind: str = "binary", repeat: int = 0, density: float = 0.1) -> DataFrame:
    """(epoch_id, frame, pixels): noise of each epoch's seed, n_frames long, every image shown ``stride`` frames.
    ``binary`` is -1 or 1, ``sparse`` is 0 but for a share of -1 and 1; the last ``repeat`` images of an epoch come
    from one seed that all epochs share."""

    def images(seed: int, n: int) -> np.ndarray:
        g = np.random.RandomState(seed)
        sign = g.randint(0, 2, (n, pixels)) * 2 - 1
        return (sign if kind == "binary" else sign * (g.random_sample((n, pixels)) < density)).astype(np.float32)

    def play(batches):
        for pdf in batches:
            for e, seed, n in zip(pdf.epoch_id, pdf.seed, pdf.n_frames):
                count = -(-int(n) // stride)
                own = images(int(seed), max(0, count - repeat))
                shown = np.concatenate([own, images(1, min(repeat, count))])
                yield pd.DataFrame({"epoch_id": int(e), "frame": np.arange(int(n), dtype=np.int32), "pixels": [shown[f // stride] for f in range(int(n))]})

    return epochs.select("epoch_id", "seed", "n_frames").mapInPandas(play, "epoch_id bigint, frame int, pixels array<float>")


def triggered_sums(counts: DataFrame, frames: DataFrame, depth: int, power: int = 1) -> DataFrame:
    """(cell_id, lag, total, n): sum over spikes of the frame ``lag`` before (to a power), and those spikes.
    ``counts``: (epoch_id, cell_id, frame, n); spikes before frame ``lag`` don't count for it. An epoch is cut into blocks
    of ``FRAME_BLOCK`` frames, each with the ``depth`` - 1 frames before it, so a task holds one block, however long the
    epoch and wherever stray frame numbers lie."""
    span = max(FRAME_BLOCK, depth)

    def block(c: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        if c.empty or f.empty:
            return pd.DataFrame({"cell_id": [], "lag": [], "total": [], "n": []}, dtype=object)
        lo, length = int(f.frame.min()), int(f.frame.max() - f.frame.min()) + 1
        place = f.frame.to_numpy(np.int64) - lo  # rows follow the frame numbers; missing frames show nothing
        shown, there = np.zeros((length, len(f.pixels.iloc[0]))), np.zeros(length)
        shown[place], there[place] = np.stack(f.pixels.to_numpy()).astype(float) ** power, 1.0
        cells, row = np.unique(c.cell_id.to_numpy(), return_inverse=True)
        weight, at = np.zeros((len(cells), length)), c.frame.to_numpy(np.int64) - lo
        inside = (at >= 0) & (at < length)
        np.add.at(weight, (row[inside], at[inside]), c.n.to_numpy(float)[inside])
        weight *= there
        out = []
        for lag in range(depth):
            w, end = weight[:, lag:], max(length - lag, 0)
            total, n = w @ shown[:end], w @ there[:end]
            out += [(int(x), lag, total[i].tolist(), float(n[i])) for i, x in enumerate(cells)]
        return pd.DataFrame(out, columns=["cell_id", "lag", "total", "n"])

    # both sides may stem from one table: fresh names keep their columns apart
    counts = counts.select(*(F.col(c).alias(c) for c in ("epoch_id", "cell_id", "frame", "n")))
    frames = frames.select(*(F.col(c).alias(c) for c in ("epoch_id", "frame", "pixels")))
    own = floor_div("frame", span)
    counts = counts.withColumn("block", own)
    # the last frames of a block are also the lead of the next one
    frames = frames.withColumn("block", F.explode(F.array_distinct(F.array(own, floor_div(F.col("frame") + (depth - 1), span)))))
    partial = counts.groupBy("epoch_id", "block").cogroup(frames.groupBy("epoch_id", "block")).applyInPandas(block, "cell_id bigint, lag int, total array<double>, n double")
    long = partial.select("cell_id", "lag", "n", F.posexplode("total").alias("pix", "v"))
    return long.groupBy("cell_id", "lag", "pix").agg(F.sum("v").alias("total"), F.sum("n").alias("n"))


def triggered_average(counts: DataFrame, frames: DataFrame, depth: int) -> DataFrame:
    """(cell_id, lag, pix, value): spike-weighted mean of what was shown."""
    return triggered_sums(counts, frames, depth).where("n > 0").select("cell_id", "lag", "pix", (F.col("total") / F.col("n")).alias("value"))


def triggered_second_moment(counts: DataFrame, frames: DataFrame, depth: int) -> DataFrame:
    """(cell_id, lag, pix, value): sum of squares over spikes - 1."""
    return triggered_sums(counts, frames, depth, 2).where("n > 1").select("cell_id", "lag", "pix", (F.col("total") / (F.col("n") - 1)).alias("value"))


def generator_signal(averages: DataFrame, frames: DataFrame, depth: int) -> DataFrame:
    """(cell_id, epoch_id, frame, g): sum over lags and pixels of average x shown. ``averages``: (cell_id, lag,
    pixels). Frames with fewer than ``depth`` - 1 before them use what there is."""
    lagged = frames.withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(depth - 1)))).withColumn("at", F.col("frame") + F.col("lag"))
    joined = lagged.join(averages.withColumnRenamed("pixels", "w"), "lag")
    dot = F.aggregate(F.zip_with("pixels", "w", lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    last = frames.groupBy("epoch_id").agg(F.max("frame").alias("last"))
    sums = joined.groupBy("cell_id", "epoch_id", F.col("at").alias("frame")).agg(F.sum(dot).alias("g"))
    return sums.join(last, "epoch_id").where(F.col("frame") <= F.col("last")).drop("last")


def channel_averages(rows: DataFrame, channels: int, achromatic: int) -> DataFrame:
    """(cell_id, lag, color, value): sums over the denominators that each channel has; the last channel counts only
    spikes under non-achromatic stimuli. Rows: (cell_id, lag, color, n, v, kind)."""
    counts = F.when((F.col("color") == channels - 1) & (F.col("kind") == achromatic), 0).otherwise(F.col("n"))
    return rows.groupBy("cell_id", "lag", "color").agg((F.sum(counts * F.col("v")) / F.nullif(F.sum(counts), F.lit(0))).alias("value"))


def grating_counts(spikes: DataFrame, marks: DataFrame, runs: DataFrame, bucket_us: int) -> DataFrame:
    """(cell_id, spatial, temporal, direction, n): spikes of each run from its second mark up to its second-last one,
    summed over the runs of a condition. ``marks``: (file, run, t_us); ``runs``: (file, run, spatial, temporal, direction).
    Marks are ranked from both ends; a run with fewer than four marks, or none between, has no window. Conditions of a cell
    without spikes are missing."""
    up, down = (W.partitionBy("file", "run").orderBy(order) for order in (F.asc("t_us"), F.desc("t_us")))
    ends = marks.select("file", "run", "t_us", F.row_number().over(up).alias("_up"), F.row_number().over(down).alias("_down")).groupBy("file", "run")
    windows = ends.agg(F.max(F.when(F.col("_up") == 2, F.col("t_us"))).alias("start_us"), F.max(F.when(F.col("_down") == 2, F.col("t_us"))).alias("_end"))
    windows = windows.withColumn("dur_us", F.col("_end") - F.col("start_us")).where("dur_us > 0").join(runs, ["file", "run"])
    inside = interval_join(spikes.select("file", "cell_id", "t_us"), windows.drop("_end"), bucket_us, ["file"])
    return inside.groupBy("cell_id", "spatial", "temporal", "direction").agg(F.count("*").alias("n"))


def grating_table(counts: DataFrame) -> DataFrame:
    """``counts`` and, with direction null, their mean over the directions of a cell and condition."""
    means = counts.groupBy("cell_id", "spatial", "temporal").agg(F.avg("n").alias("rate"))
    return counts.withColumn("rate", F.col("n").cast("double")).drop("n").unionByName(means.withColumn("direction", F.lit(None).cast(dict(counts.dtypes)["direction"])))
