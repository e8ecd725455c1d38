"""Recursive filters, and the spike detector built on one, over chunked traces.

A recursive filter moves a small state from sample to sample. Over a chunk of n samples that is an affine map: the state
at the end is M^n times the one at the start, plus what the chunk gives from rest. So each chunk is reduced to (n, state
from rest) on its own, the maps are composed in order (an exclusive prefix in levels of ``SPAN`` chunks, each group one
small task), and every chunk is filtered from its exact starting state: chunk borders leave no trace in the result, and
no task sees more than a chunk's samples. A missing chunk starts a new trace.

Chunks are rows (keys, chunk, data); ``chunk`` counts up by one along a trace."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cached_property
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from axonloom.session import cut

#: Chunk maps that one task composes, and samples that one matrix product covers.
SPAN, BLOCK = 512, 64
#: Time of the peak before the first, in samples.
NO_PEAK = -1000


# ---- designs


def _digital(poles: np.ndarray, cutoff: float, rate: float, high: bool) -> tuple[list[float], list[float]]:
    """(b, a) from the poles of an analogue low-pass at 1 rad/s, by the bilinear transform with prewarped cutoff."""
    warped = 2 * rate * np.tan(np.pi * cutoff / rate)
    s = warped / poles if high else warped * poles
    z = (2 * rate + s) / (2 * rate - s)
    a = np.poly(z).real
    b = np.poly(np.full(len(poles), 1.0 if high else -1.0)).real
    at = -1.0 if high else 1.0
    return (b * np.polyval(a, at) / np.polyval(b, at)).tolist(), a.tolist()


def butterworth(order: int, cutoff: float, rate: float, high: bool = False) -> tuple[list[float], list[float]]:
    """(b, a) of a Butterworth low-pass (or high-pass) with its -3 dB point at ``cutoff``."""
    return _digital(np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order)), cutoff, rate, high)


def bessel(order: int, cutoff: float, rate: float) -> tuple[list[float], list[float]]:
    """(b, a) of a Bessel low-pass whose phase at ``cutoff`` is that of a Butterworth filter of the same order."""
    poly = [factorial(2 * order - k) / (2 ** (order - k) * factorial(k) * factorial(order - k)) for k in range(order, -1, -1)]
    return _digital(np.roots(poly) / poly[-1] ** (1 / order), cutoff, rate, False)


def smoothing(alpha: float) -> tuple[list[float], list[float]]:
    """(b, a) of the exponential mean m += alpha * (x - m)."""
    return [alpha], [1.0, alpha - 1.0]


def windowed_sinc(order: int, cutoff: float, rate: float, high: bool = False) -> list[float]:
    """Linear-phase FIR taps (``order`` even) of a Hamming-windowed sinc; a high-pass is a pulse less the low-pass."""
    k = np.arange(order + 1) - order // 2
    taps = np.sinc(2 * cutoff / rate * k) * np.hamming(order + 1)
    taps /= taps.sum()
    return ((k == 0) - taps if high else taps).tolist()


# ---- one filter


class Filter:
    """State-space form of b, a (transposed direct form II): y = C z + D x, z' = M z + B x."""

    def __init__(self, b: Sequence[float], a: Sequence[float]):
        p = max(len(a), len(b)) - 1
        b, a = (np.concatenate([np.asarray(v, float), np.zeros(p + 1 - len(v))]) / a[0] for v in (b, a))
        self.p, self.d = p, b[0]
        self.m = np.eye(p, k=1)
        self.m[:, 0] -= a[1:]
        self.b = b[1:] - a[1:] * b[0]

    @cached_property
    def products(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For a block of samples: response, read-out of the starting state, and what reaches the state after it."""
        states, reads = [self.b], [np.eye(self.p)[0]]
        for _ in range(BLOCK - 1):
            states.append(self.m @ states[-1])
            reads.append(reads[-1] @ self.m)
        pulse = np.array([self.d, *(s[0] for s in states[:-1])])
        response = np.array([np.concatenate([np.zeros(k), pulse[: BLOCK - k]]) for k in range(BLOCK)])
        return response, np.array(reads), np.array(states[::-1])

    def run(self, x: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(y, state after): whole blocks by matrix products, the state stepped from block to block."""
        response, reads, reach = self.products
        out, whole = [], len(x) // BLOCK * BLOCK
        for part, size in ((x[:whole].reshape(-1, BLOCK), BLOCK), (x[whole:][None], len(x) - whole)):
            if not part.size:
                continue
            step, gains = self.power(size), part @ reach[BLOCK - size :]
            starts = np.empty((len(part), self.p))
            for i, gain in enumerate(gains):
                starts[i] = z
                z = step @ z + gain
            out.append((part @ response[:size, :size] + starts @ reads[:size].T).ravel())
        return np.concatenate(out) if out else np.zeros(0), z

    def power(self, n: int) -> np.ndarray:
        return np.linalg.matrix_power(self.m, int(n))

    def steady(self, value: float) -> np.ndarray:
        """State after a constant input that has lasted."""
        return np.linalg.solve(np.eye(self.p) - self.m, self.b * value)


# ---- the scan over chunks


def _types(df: DataFrame, columns: Sequence[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"`{c}` {kinds[c]}" for c in columns)


def _sized(chunks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, chunk, trace, offset, size): the first of the chunks that lead to this one without a gap, and where this one
    begins. Small rows without samples."""
    order = W.partitionBy(*keys).orderBy("chunk")
    rows = chunks.select(*keys, F.col("chunk").cast("bigint").alias("chunk"), F.size("data").cast("bigint").alias("size"))
    rows = rows.withColumn("_island", F.col("chunk") - F.row_number().over(order))
    rows = rows.withColumn("trace", F.min("chunk").over(W.partitionBy(*keys, "_island"))).drop("_island")
    before = W.partitionBy(*keys, "trace").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0)))


def _prefix(maps: DataFrame, keys: Sequence[str], f: Filter, levels: int) -> DataFrame:
    """(keys, place, n, z): the map of all rows of a key before ``place``, from maps (keys, place, n, z)."""
    rows = maps.withColumn("_up", F.floor(F.col("place") / SPAN))
    schema = f"{_types(maps, keys)}, place bigint, n bigint, z array<double>, _up bigint, _n bigint, _z array<double>"

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        n, z, before = 0, np.zeros(f.p), []
        for size, state in zip(pdf["n"], pdf["z"]):
            before.append((n, z))
            n, z = n + size, f.power(size) @ z + np.asarray(state, float)
        last = np.arange(len(pdf)) == len(pdf) - 1  # the last row carries the whole group's map
        return pdf[[*keys, "place"]].assign(n=[b[0] for b in before], z=[b[1] for b in before], _up=pdf["_up"], _n=np.where(last, n, -1), _z=[z if x else [] for x in last])

    inner = rows.groupBy(*keys, "_up").applyInPandas(compose, schema)
    if levels <= 1:
        return inner.select(*keys, "place", "n", "z")
    totals = inner.where("_n >= 0").select(*keys, F.col("_up").alias("place"), F.col("_n").alias("n"), F.col("_z").alias("z"))
    outer = _prefix(totals, keys, f, levels - 1).select(*keys, F.col("place").alias("_up"), F.col("n").alias("_n0"), F.col("z").alias("_z0"))
    both = inner.select(*keys, "place", "n", "z", "_up").join(outer, [*keys, "_up"])

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            z = [f.power(n) @ np.asarray(z0, float) + np.asarray(z, float) for n, z, z0 in zip(pdf["n"], pdf["z"], pdf["_z0"])]
            yield pdf[[*keys, "place"]].assign(n=pdf["n"] + pdf["_n0"], z=z)

    return both.mapInPandas(joined, f"{_types(maps, keys)}, place bigint, n bigint, z array<double>")


def _stated(chunks: DataFrame, keys: Sequence[str], f: Filter, settle: int) -> DataFrame:
    """``chunks`` (keys, chunk, data) with trace, offset and ``state``, the filter's state before each one. The filter
    starts at rest, or as if the mean of the first ``settle`` samples had lasted forever."""
    sized = cut(_sized(chunks, keys))
    rows = chunks.withColumn("chunk", F.col("chunk").cast("bigint")).join(sized.drop("size"), [*keys, "chunk"])

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            z = [f.run(np.asarray(x, float), np.zeros(f.p))[1] for x in pdf["data"]]
            yield pdf[[*keys, "trace"]].assign(place=pdf["chunk"] - pdf["trace"], n=[len(x) for x in pdf["data"]], z=z)

    maps = rows.select(*keys, "trace", "chunk", "data").mapInPandas(reduce, f"{_types(rows, [*keys, 'trace'])}, place bigint, n bigint, z array<double>")
    most = sized.agg(F.max(F.col("chunk") - F.col("trace"))).first()[0] or 0
    levels = 1
    while most >= SPAN**levels:
        levels += 1
    before = _prefix(maps, [*keys, "trace"], f, levels).select(*keys, "trace", (F.col("place") + F.col("trace")).alias("chunk"), F.col("n").alias("_n"), F.col("z").alias("_z"))
    out = rows.join(cut(before), [*keys, "trace", "chunk"])
    if settle:
        head = F.slice(F.col("data").cast("array<double>"), F.lit(1), (settle - F.col("offset")).cast("int"))
        first = rows.where(F.col("offset") < settle).groupBy(*keys, "trace").agg((F.sum(F.aggregate(head, F.lit(0.0), lambda s, x: s + x)) / F.sum(F.size(head))).alias("_value"))
        out = out.join(first, [*keys, "trace"])
    else:
        out = out.withColumn("_value", F.lit(0.0))

    def states(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            z = [f.power(n) @ f.steady(v) + np.asarray(z, float) for n, v, z in zip(pdf["_n"], pdf["_value"], pdf["_z"])]
            yield pdf.drop(columns=["_n", "_z", "_value"]).assign(state=z)

    columns = [*chunks.columns, "trace", "offset"]
    return out.select(*columns, "_n", "_z", "_value").mapInPandas(states, f"{_types(out, columns)}, state array<double>")


def filtered(chunks: DataFrame, keys: Sequence[str], b: Sequence[float], a: Sequence[float], settle: int = 0) -> DataFrame:
    """``chunks`` with ``data`` filtered by the recursion of b, a."""
    f = Filter(b, a)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            y = [f.run(np.asarray(x, float), np.asarray(z, float))[0] for x, z in zip(pdf["data"], pdf["state"])]
            yield pdf.drop(columns="state").assign(data=y)

    rows = _stated(chunks, keys, f, settle).select(*chunks.columns, "state")
    return rows.mapInPandas(run, ", ".join(f"`{c}` {'array<double>' if c == 'data' else t}" for c, t in rows.dtypes if c != "state"))


def zero_phase(chunks: DataFrame, keys: Sequence[str], b: Sequence[float], a: Sequence[float]) -> DataFrame:
    """``chunks`` filtered forwards, then backwards, so that nothing is delayed. Each trace is continued at both ends by
    three filter lengths (or what it has) of its own samples turned about the end point, and starts settled."""
    pad = 3 * max(len(a), len(b))
    types = dict(chunks.dtypes)
    sized = cut(_sized(chunks, keys))
    rows = chunks.withColumn("chunk", F.col("chunk").cast("bigint")).withColumn("data", F.col("data").cast("array<double>")).join(sized, [*keys, "chunk"])
    total = F.sum("size").over(W.partitionBy(*keys, "trace"))
    whole = sized.select(*keys, "chunk", "trace", total.alias("_total"))
    rows = rows.join(whole, [*keys, "chunk", "trace"]).withColumn("_pad", F.least(F.lit(pad), F.col("_total") - 1).cast("int"))
    left = F.col("_total") - F.col("offset") - F.col("size")  # samples after the chunk

    def ends(near: Column, part: Column) -> DataFrame:
        found = rows.where(near).groupBy(*keys, "trace").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", part.alias("x")))), lambda r: r["x"])).alias("_x"))
        return found

    turned = lambda x, end: F.transform(F.reverse(x), lambda v: 2 * end - v)
    head = ends(F.col("offset") <= pad, F.slice("data", F.lit(1), F.least(F.col("size"), pad + 1 - F.col("offset")).cast("int"))).withColumnRenamed("_x", "_head")
    tail = ends(left <= pad, F.slice("data", -F.least(F.col("size"), pad + 1 - left).cast("int"), F.least(F.col("size"), pad + 1 - left).cast("int"))).withColumnRenamed("_x", "_tail")
    rows = rows.join(head, [*keys, "trace"]).join(tail, [*keys, "trace"])
    none = F.array().cast("array<double>")
    first, last = F.col("offset") == 0, left == 0
    lead = F.when(first, turned(F.slice("_head", F.lit(2), F.col("_pad")), F.get("_head", F.lit(0)))).otherwise(none)
    trail = F.when(last, turned(F.slice("_tail", F.size("_tail") - F.col("_pad"), F.col("_pad")), F.element_at("_tail", -1))).otherwise(none)
    wide = rows.select(*keys, "chunk", F.concat(lead, "data", trail).alias("data"), F.size(lead).alias("_lead"), F.size("data").alias("_size"))
    there = cut(filtered(wide, keys, b, a, settle=1))
    back = there.select(*keys, (-F.col("chunk")).alias("chunk"), F.reverse("data").alias("data"), "_lead", "_size")
    out = filtered(back, keys, b, a, settle=1)
    data = F.slice(F.reverse("data"), F.col("_lead") + 1, F.col("_size"))
    rest = [c for c in chunks.columns if c not in (*keys, "chunk", "data")]
    got = out.select(*keys, (-F.col("chunk")).cast(types["chunk"]).alias("chunk"), data.alias("data"))
    return got.join(chunks.select(*keys, "chunk", *rest), [*keys, "chunk"]).select(*chunks.columns)


# ---- spikes


def above(amplitude: np.ndarray, threshold: float) -> Iterator[tuple[int, int, int, float]]:
    """(start, end, peak, amplitude) of the stretches over the threshold, ``end`` exclusive; the first of equal peaks."""
    over = np.concatenate([[False], amplitude > threshold, [False]])
    edges = np.flatnonzero(over[1:] != over[:-1]).tolist()
    for s, e in zip(edges[::2], edges[1::2]):
        peak = s + int(amplitude[s:e].argmax())
        yield s, e, peak, float(amplitude[peak])


def detected_spikes(chunks: DataFrame, keys: Sequence[str], alpha: float, threshold: float, refractory: int, longest: int, settle: int = 1) -> DataFrame:
    """(keys, t, amplitude) of spikes in chunked traces, ``t`` in samples from the start of the trace. The running mean
    moves by ``alpha`` towards each sample before it is taken from it; it starts at the mean of the first ``settle``
    samples. A stretch of amplitudes (mean less signal) over the threshold is a spike at its largest one, if that is more
    than ``refractory`` samples after the peak of the stretch before, whether that was a spike or not, and the stretch
    has at most ``longest`` samples. A stretch that the trace's end cuts off isn't one.

    Chunks are scanned on their own from the exact mean. Stretches that touch a chunk's border are put together by an
    ordered pass over those alone; the peak before a chunk's first is carried by one over chunks."""
    f = Filter(*smoothing(alpha))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                x = np.asarray(r["data"], float)
                y, _ = f.run(x, np.asarray(r["state"], float))
                lead = [r[c] for c in (*keys, "trace", "chunk")]
                out += [(*lead, r["offset"] + s, r["offset"] + e, r["offset"] + p, m, s == 0 or e == len(x)) for s, e, p, m in above(y - x, threshold)]
            yield pd.DataFrame(out, columns=[*keys, "trace", "chunk", "start", "end", "peak", "amplitude", "border"])

    rows = _stated(chunks.select(*keys, "chunk", "data"), keys, f, settle)
    where = [*keys, "trace"]
    found = rows.mapInPandas(scan, f"{_types(rows, [*where, 'chunk'])}, start bigint, end bigint, peak bigint, amplitude double, border boolean")
    inner, border = found.where("not border").drop("border"), found.where("border").drop("border")
    order = W.partitionBy(*where).orderBy("start")
    new = F.coalesce((F.lag("end").over(order) < F.col("start")).cast("int"), F.lit(1))
    joined = border.withColumn("_new", new).withColumn("_run", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    joined = joined.groupBy(*where, "_run").agg(F.min("chunk").alias("chunk"), F.min("start").alias("start"), F.max("end").alias("end"), F.max(F.struct("amplitude", (-F.col("peak")).alias("p"))).alias("top"))
    joined = joined.select(*where, "chunk", "start", "end", (-F.col("top.p")).alias("peak"), F.col("top.amplitude").alias("amplitude"))
    ends = _sized(chunks, keys).groupBy(*where).agg(F.max(F.col("offset") + F.col("size")).alias("_stop"))
    runs = inner.unionByName(joined).join(ends, where).where(F.col("end") < F.col("_stop"))
    last = runs.groupBy(*where, "chunk").agg(F.max("peak").alias("_last"))
    carried = last.select(*where, "chunk", F.lag("_last").over(W.partitionBy(*where).orderBy("chunk")).alias("_carried"))
    before = F.coalesce(F.lag("peak").over(W.partitionBy(*where, "chunk").orderBy("start")), "_carried", F.lit(NO_PEAK))
    kept = runs.join(carried, [*where, "chunk"]).withColumn("_before", before)
    good = (F.col("peak") - F.col("_before") > refractory) & (F.col("end") - F.col("start") <= longest)
    return kept.where(good).select(*keys, F.col("peak").alias("t"), "amplitude")
