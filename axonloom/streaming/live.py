"""Live counterparts: windows with watermarks, sessions, and per-electrode state. All take and return streaming (or
batch) DataFrames with ``ts`` (timestamp), ``electrode`` and ``amplitude``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axonloom.operators.recursive import NO_PEAK


def window_counts(spikes: DataFrame, width: str, late: str = "0 seconds") -> DataFrame:
    """(start, electrode, n, max_amplitude) per tumbling window."""
    w = F.window("ts", width)
    return spikes.withWatermark("ts", late).groupBy(w.alias("w"), "electrode").agg(F.count("*").alias("n"), F.max("amplitude").alias("max_amplitude")).select(F.col("w.start").alias("start"), "electrode", "n", "max_amplitude")


def window_rates(spikes: DataFrame, width: str, seconds: float, electrodes: int, late: str = "0 seconds") -> DataFrame:
    """(start, rate, mean_amplitude): means over all ``electrodes`` of each one's spikes a second and of each one's mean
    amplitude (0 for silent ones)."""
    each = spikes.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "electrode").agg(F.count("*").alias("n"), F.avg("amplitude").alias("m"))
    rows = each.groupBy(F.window(F.window_time("w"), width).alias("v")).agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    return rows.select(F.col("v.start").alias("start"), (F.col("n") / (seconds * electrodes)).alias("rate"), (F.col("m") / electrodes).alias("mean_amplitude"))


def window_levels(samples: DataFrame, width: str = "1 second", late: str = "0 seconds") -> DataFrame:
    """(start, electrode, mean, sigma)."""
    w = F.window("ts", width)
    return samples.withWatermark("ts", late).groupBy(w.alias("w"), "electrode").agg(F.avg("amplitude").alias("mean"), F.stddev_pop("amplitude").alias("sigma")).select(F.col("w.start").alias("start"), "electrode", "mean", "sigma")


def ordered_release(spikes: DataFrame, hold: str, slot: str) -> DataFrame:
    """(start, spikes): spikes leave in slots of event time once ``hold`` has passed, each slot in time order; later
    ones are dropped. The last slots leave when a closing row moves the watermark on."""
    w = F.window("ts", slot)
    rows = spikes.withWatermark("ts", hold).groupBy(w.alias("w")).agg(F.array_sort(F.collect_list(F.struct("ts", "electrode", "amplitude"))).alias("spikes"))
    return rows.select(F.col("w.start").alias("start"), "spikes")


def trigger_sessions(triggers: DataFrame, gap: str, late: str = "0 seconds") -> DataFrame:
    """(start, end, n): runs of triggers without a gap."""
    rows = triggers.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n"), F.max("ts").alias("end"))
    return rows.select(F.col("s.start").alias("start"), "end", "n")


def trigger_periods(triggers: DataFrame, key: str = "electrode") -> DataFrame:
    """(key, ts, period_us, longest_us): steps between triggers in arrival batches, with the longest so far; state is
    the last time and the longest step."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, longest = state.get if state.exists else (-1, 0)
        rows = []
        for t in sorted(t for b in batches for t in b.ts.astype("int64") // 1000):
            if last >= 0:
                longest = max(longest, int(t - last))
                rows.append((k[0], pd.Timestamp(int(t), unit="us"), int(t - last), longest))
            last = int(t)
        state.update((last, longest))
        yield pd.DataFrame(rows, columns=[key, "ts", "period_us", "longest_us"])

    kind = dict(triggers.dtypes)[key]
    return triggers.select(key, F.col("ts")).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, ts timestamp, period_us bigint, longest_us bigint", "last bigint, longest bigint", "append", "NoTimeout")


def detect(x: np.ndarray, alpha: float, threshold: float, state: dict) -> list[tuple[int, int, int, float]]:
    """Stretches over the threshold that end in ``x``, as (start, end, peak, amplitude): the mean moves first and the
    signal is taken from it then. ``state`` (mean, at, open) goes on."""
    found, mean, run = [], state["mean"], state["open"]
    for at, v in enumerate(x.tolist(), state["at"]):
        mean += alpha * (v - mean)
        amp = mean - v
        if amp > threshold:
            if run is None:
                run = [at, at, amp]
            elif amp > run[2]:
                run[1:] = at, amp
        elif run is not None:
            found.append((run[0], at, run[1], run[2]))
            run = None
    state.update(mean=mean, at=state["at"] + len(x), open=run)
    return found


def live_spikes(chunks: DataFrame, alpha: float, threshold: float, refractory: int, longest: int, key: str = "electrode", settle: int = 1) -> DataFrame:
    """(key, t, amplitude) from chunk rows (key, chunk, data) in order of chunk, by the rule of
    ``recursive.detected_spikes``; state carries the running mean, an open stretch and the last peak, so spikes may span
    chunks. The mean starts at that of the first ``settle`` samples of the first chunk."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        mean, at, start, peak, amp, last = state.get if state.exists else (float("nan"), 0, -1, -1, 0.0, NO_PEAK)
        rows = []
        parts = [(c, d) for b in batches for c, d in zip(b.chunk, b.data)]
        for _, data in sorted(parts, key=lambda x: x[0]):
            x = np.asarray(data, float)
            if not len(x):
                continue
            s = {"mean": float(x[:settle].mean()) if np.isnan(mean) else mean, "at": at, "open": [start, peak, amp] if start >= 0 else None}
            found = detect(x, alpha, threshold, s)
            mean, at = s["mean"], s["at"]
            start, peak, amp = s["open"] or (-1, -1, 0.0)
            for a, e, p, m in found:
                if e - a <= longest and p - last > refractory:
                    rows.append((k[0], p, m))
                last = p
        state.update((mean, at, int(start), int(peak), float(amp), int(last)))
        yield pd.DataFrame(rows, columns=[key, "t", "amplitude"])

    kind = dict(chunks.dtypes)[key]
    return chunks.select(key, "chunk", "data").groupBy(key).applyInPandasWithState(step, f"{key} {kind}, t bigint, amplitude double", "mean double, at bigint, start bigint, peak bigint, amp double, last bigint", "append", "NoTimeout")


def epoch_sums(counts: DataFrame, n: int) -> DataFrame:
    """(cell_id, contrast, epoch, re, im) of finished epochs, from a stream of rows (cell_id, contrast, epoch, bin, n). The
    state of an epoch is its Fourier sum at one cycle in ``n`` bins; a row without a bin says that the epoch is over: what
    came up to its batch is given out and the state goes. Rows may come in any order and number of batches before it."""
    keys = ["cell_id", "contrast", "epoch"]
    types = dict(counts.dtypes)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        re, im = state.get if state.exists else (0.0, 0.0)
        over = False
        for pdf in batches:
            over |= bool(pdf["bin"].isna().any())
            held = pdf.dropna(subset=["bin"])
            angle = held["bin"].to_numpy(float) * (2 * np.pi / n)
            re, im = re + float((held["n"] * np.cos(angle)).sum()), im + float((held["n"] * np.sin(angle)).sum())
        if over:
            if state.exists:
                state.remove()
            yield pd.DataFrame([(*key, re, im)], columns=[*keys, "re", "im"])
        else:
            state.update((re, im))

    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", re double, im double"
    return counts.select(*keys, "bin", "n").groupBy(*keys).applyInPandasWithState(step, schema, "re double, im double", "append", "NoTimeout")


def contrast_f1(closed: DataFrame, n: int) -> DataFrame:
    """(cell_id, contrast, f1): amplitude at one cycle in ``n`` bins of the mean over the finished epochs."""
    sums = closed.groupBy("cell_id", "contrast").agg(F.avg("re").alias("re"), F.avg("im").alias("im"))
    return sums.select("cell_id", "contrast", (F.sqrt(F.col("re") ** 2 + F.col("im") ** 2) * (2.0 / n)).alias("f1"))


def online_f1(counts: DataFrame, n: int, path: str, sink, share: float = 0.1):
    """Starts a query that calls ``sink(f1, leaders)`` as epochs finish: the first harmonic per cell and contrast over all
    epochs finished so far, and the cells with the largest mean of it. Finished epochs are kept under ``path`` by batch, so
    a batch that runs again replaces what it wrote."""
    from axonloom.operators.clustering import top_share

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={number}")
        closed = df.sparkSession.read.schema(df.schema).parquet(f"{path}/batch=*")
        f1 = contrast_f1(closed, n)
        if not df.isEmpty():
            sink(f1, top_share(f1.groupBy("cell_id").agg(F.avg("f1").alias("f1")), "f1", share))

    return epoch_sums(counts, n).writeStream.foreachBatch(batch).trigger(availableNow=True).start()
