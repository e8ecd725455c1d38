"""Joins on time and space: intervals, backward as-of, bands, shifts, nearest, neighbours.

Range predicates are turned into equi-joins on coarse time buckets with an exact filter after them, so they shuffle on
(keys, bucket): a busy key is spread over its buckets, and AQE splits what is still skewed."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from axonloom.operators.blocks import block_pairs, unit_rows
from axonloom.tables import floor_div


def interval_join(points: DataFrame, windows: DataFrame, bucket_us: int, keys: Sequence[str] = (), t: str = "t_us") -> DataFrame:
    """Points inside [start_us, start_us + dur_us), with t_rel_us. Windows are repeated per bucket they touch; points
    aren't."""
    last = floor_div(F.col("start_us") + F.col("dur_us") - 1, bucket_us)
    wide = windows.where("dur_us > 0").withColumn("_b", F.explode(F.sequence(floor_div("start_us", bucket_us), last)))
    near = points.withColumn("_b", floor_div(t, bucket_us)).join(wide, [*keys, "_b"])
    inside = (F.col(t) >= F.col("start_us")) & (F.col(t) < F.col("start_us") + F.col("dur_us"))
    return near.where(inside).withColumn("t_rel_us", F.col(t) - F.col("start_us")).drop("_b")


def cumulative_offsets(files: DataFrame, length: str, order: str, keys: Sequence[str] = ()) -> DataFrame:
    """``files`` with ``offset``: the lengths of all files before, in order (per keys, one recording each)."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return files.withColumn("offset", F.coalesce(F.sum(length).over(w), F.lit(0)))


def split_by_file(points: DataFrame, files: DataFrame, bucket: int, length: str = "n", order: str = "file", t: str = "t_us") -> DataFrame:
    """Concatenated points back to (file, time in the file)."""
    spans = cumulative_offsets(files, length, order).select(order, F.col("offset").alias("start_us"), F.col(length).alias("dur_us"))
    return interval_join(points.drop(order), spans, bucket, t=t).withColumnRenamed("t_rel_us", "t_in_file").drop("start_us", "dur_us")


def concatenated(points: DataFrame, gap: int, file: str = "file", t: str = "t_us") -> DataFrame:
    """Files one after the other per recording: each starts ``gap`` after the last point of all before it."""
    ends = points.groupBy(file).agg((F.max(t) + gap).alias("n"))
    starts = cumulative_offsets(ends, "n", file).select(file, "offset")
    return points.join(starts, file).withColumn("t_concat", F.col(t) + F.col("offset")).drop("offset")


def concatenated_by_length(points: DataFrame, files: DataFrame, length: str, file: str = "file", t: str = "t_us") -> DataFrame:
    """The same with the files' exact lengths."""
    return points.join(cumulative_offsets(files, length, file).select(file, "offset"), file).withColumn("t_concat", F.col(t) + F.col("offset")).drop("offset")


def last_mark(points: DataFrame, marks: DataFrame, keys: Sequence[str], t: str = "t_us", bucket: int | None = None) -> DataFrame:
    """Backward as-of join: each point with ``mark_us``, the last mark at or before it (ties go to the mark), and
    ``mark_no``, that mark's number from 1; null and 0 before the first. With ``bucket``, rows are ordered within time
    buckets only; what came before a bucket is read from a small table of its marks."""
    both = points.withColumn("_kind", F.lit(1)).unionByName(marks.select(*keys, t).withColumn("_kind", F.lit(0)), allowMissingColumns=True)
    by = list(keys)
    if bucket is not None:
        both = both.withColumn("_b", floor_div(t, bucket))
        by = [*keys, "_b"]
    w = W.partitionBy(*by).orderBy(t, "_kind").rowsBetween(W.unboundedPreceding, 0)
    is_mark = F.col("_kind") == 0
    seen = both.select("*", F.last(F.when(is_mark, F.col(t)), ignorenulls=True).over(w).alias("mark_us"), F.sum(is_mark.cast("int")).over(w).alias("mark_no"))
    seen = seen.where("_kind = 1").drop("_kind")
    if bucket is None:
        return seen
    held = both.groupBy(*by).agg(F.max(F.when(is_mark, F.col(t))).alias("_last"), F.sum(is_mark.cast("int")).alias("_n"))
    past = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    before = held.select(*by, F.max("_last").over(past).alias("_last"), F.coalesce(F.sum("_n").over(past), F.lit(0)).alias("_n"))
    joined = seen.join(before, by)
    return joined.withColumn("mark_us", F.coalesce("mark_us", "_last")).withColumn("mark_no", F.col("mark_no") + F.col("_n")).drop("_b", "_last", "_n")


def nearest_gap(points: DataFrame, marks: DataFrame, keys: Sequence[str], t: str = "t_us", bucket: int | None = None) -> DataFrame:
    """Each point with ``gap_us``, the distance to the nearest mark either side (null without marks). With ``bucket``, rows
    are ordered within time buckets only, and the nearest marks of the buckets before and after come from a small table
    with a row a bucket."""
    both = points.withColumn("_kind", F.lit(1)).unionByName(marks.select(*keys, t).withColumn("_kind", F.lit(0)), allowMissingColumns=True)
    both = both.withColumn("_b", floor_div(t, bucket) if bucket else F.lit(0))
    mark, part = F.when(F.col("_kind") == 0, F.col(t)), W.partitionBy(*keys, "_b")
    back = F.last(mark, ignorenulls=True).over(part.orderBy(t, "_kind").rowsBetween(W.unboundedPreceding, 0))
    # backwards too, as a frame to the end is gone through again for every row
    ahead = F.last(mark, ignorenulls=True).over(part.orderBy(F.desc(t), "_kind").rowsBetween(W.unboundedPreceding, 0))
    near = both.withColumn("_p", back).withColumn("_n", ahead).where("_kind = 1")
    if bucket:
        ends = both.groupBy(*keys, "_b").agg(F.max(mark).alias("_hi"), F.min(mark).alias("_lo"))
        past = lambda order: W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
        carried = ends.select(*keys, "_b", F.last("_hi", ignorenulls=True).over(past(F.col("_b"))).alias("_cp"), F.last("_lo", ignorenulls=True).over(past(F.desc("_b"))).alias("_cn"))
        near = near.join(carried, [*keys, "_b"]).withColumns({"_p": F.coalesce("_p", "_cp"), "_n": F.coalesce("_n", "_cn")}).drop("_cp", "_cn")
    return near.withColumn("gap_us", F.least(F.col(t) - F.col("_p"), F.col("_n") - F.col(t))).drop("_kind", "_p", "_n", "_b")


def band_pairs(left: DataFrame, right: DataFrame, lag: int, keys: Sequence[str], t: str = "t_us") -> DataFrame:
    """Pairs with abs(right time - left time) <= lag on equal keys, with ``dt``. Buckets are as wide as the lag, so a
    point meets three of them; the smaller side should be ``left``, whose rows are repeated. Right columns get ``_r``."""
    near = left.withColumn("_b", F.explode(F.array(*(floor_div(t, lag) + d for d in (-1, 0, 1)))))
    other = right.select(*(F.col(c).alias(c if c in keys else f"{c}_r") for c in right.columns)).withColumn("_b", floor_div(f"{t}_r", lag))
    pairs = near.join(other, [*keys, "_b"]).withColumn("dt", F.col(f"{t}_r") - F.col(t)).drop("_b")
    return pairs.where(F.abs("dt") <= lag)


def shifted_join(counts: DataFrame, frames: DataFrame, depth: int, keys: Sequence[str], frame: str = "frame") -> DataFrame:
    """Counts at a frame with what was shown ``lag`` frames before, lag 0 to depth - 1."""
    lagged = counts.withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(depth - 1)))).withColumnRenamed(frame, "_at")
    lagged = lagged.withColumn(frame, F.col("_at") - F.col("lag"))
    return lagged.join(frames, [*keys, frame]).drop("_at")


def neighbours(electrodes: DataFrame, radius: float, cell: float | None = None) -> DataFrame:
    """(electrode, neighbour, distance) closer than ``radius``: a join on square grid cells and their neighbours."""
    size = cell or radius
    gx, gy = F.floor(F.col("x") / size), F.floor(F.col("y") / size)
    here = electrodes.select("electrode", "x", "y", gx.alias("gx"), gy.alias("gy"))
    steps = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)))
    wide = here.withColumn("s", F.explode(steps)).select("electrode", "x", "y", (F.col("gx") + F.col("s.a")).alias("gx"), (F.col("gy") + F.col("s.b")).alias("gy"))
    other = here.select(F.col("electrode").alias("neighbour"), F.col("x").alias("x2"), F.col("y").alias("y2"), "gx", "gy")
    d = F.hypot(F.col("x") - F.col("x2"), F.col("y") - F.col("y2"))
    return wide.join(other, ["gx", "gy"]).where("electrode <> neighbour").withColumn("distance", d).where(F.col("distance") < radius).select("electrode", "neighbour", "distance")


def nearest_object(points: DataFrame, objects: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each point with the distance to the nearest object of its keys (few objects a key)."""
    d = F.hypot(F.col("x") - F.col("ox"), F.col("y") - F.col("oy"))
    return points.join(objects, list(keys)).groupBy(*points.columns).agg(F.min(d).alias("distance"))


def with_default(rows: DataFrame, labels: DataFrame, key: str, column: str, default: object) -> DataFrame:
    """Left join of a label, ``default`` where there is none."""
    return rows.join(labels.select(key, column), key, "left").withColumn(column, F.coalesce(F.col(column), F.lit(default)))


#: Numbers of a block of a correlation product (16 MB): what a task holds of one side. Smaller sides are cut into as
#: many blocks of BLOCK_ROWS vectors as make work for a cluster, SPREAD at most, as each block is another copy of the rows.
BLOCK_VALUES = 1 << 21
BLOCK_ROWS = 2_000
SPREAD = 8


def block_count(sides: Sequence[DataFrame], keys: Sequence[str], arrays: Sequence[str] = ("v",)) -> tuple[int, int]:
    """(blocks a side, number of keys) for the largest key of any side."""
    found = []
    for df in sides:
        width = sum((F.greatest(F.size(c), F.lit(0)) for c in arrays), F.lit(0))
        n = df.groupBy(*keys).agg(F.count("*").alias("n"), F.max(width).alias("w")).agg(F.max("n"), F.max("w"), F.count("*")).first()
        found.append([x or 0 for x in n])
    largest, wide, count = (max(x) for x in zip(*found))
    rows = max(1, BLOCK_VALUES // max(wide, 1))
    return max(1, -(-largest // rows), min(-(-largest // BLOCK_ROWS), SPREAD)), count


def correlated_pairs(vectors: DataFrame, least: float, keys: Sequence[str] = (), blocks: int | None = None, right: DataFrame | None = None, centred: bool = True, name: str = "r", views: Sequence[tuple[Sequence[int], Sequence[int]]] | None = None) -> DataFrame:
    """(a, b, r) with Pearson correlation (or cosine, if not ``centred``) of at least ``least``; pairs a < b of one
    side, or all a of ``vectors`` with b of ``right``. Vectors are dealt into hash blocks and scaled once a block; a task
    holds one block and the other streams past it in tiles of a matrix product, so only pairs over the limit leave it.
    Unless ``blocks`` is given, their number follows ``BLOCK_VALUES`` and the largest key. A vector without spread
    correlates 0. ``views`` are pairs of places in the vectors of either side: of a ``vectors`` and a ``right`` row the
    largest correlation of any view is taken, with ``view``, the first that has it."""
    keys = list(keys)
    count = 1
    if blocks is None or keys:
        fitting, count = block_count([vectors, *([] if right is None else [right])], keys)
        blocks = blocks or fitting

    def prepare(side: int, matrices: list) -> list[np.ndarray]:
        x, sizes = matrices[0]
        if len(set(sizes.tolist())) > 1:
            raise ValueError(f"vectors of {sizes.min()} and of {sizes.max()} numbers")
        return [unit_rows(part, np.full(len(x), part.shape[1]), centred) for part in ([x] if views is None else [x[:, list(v[side])] for v in views])]

    def compare(xs: list[np.ndarray], ys: list[np.ndarray]) -> tuple:
        r = ys[0] @ xs[0].T
        if views is None:
            q, p = np.nonzero(r >= least)
            return p, q, [r[q, p]]
        best = np.zeros(r.shape, np.int32)
        for k in range(1, len(xs)):
            other = ys[k] @ xs[k].T
            more = other > r
            r[more], best[more] = other[more], k
        q, p = np.nonzero(r >= least)
        return p, q, [r[q, p], best[q, p]]

    return block_pairs(vectors, right, keys, blocks, ["v"], prepare, compare, {name: "double"} | ({} if views is None else {"view": "int"}), count)


def chunk_snippets(events: DataFrame, chunks: DataFrame, left: int, right: int, size: int, keys: Sequence[str]) -> DataFrame:
    """Samples [t - left, t + right] around each event from chunked traces (keys, chunk, data): an event meets the
    chunks that its window touches, each gives its slice, and the slices are put together in order."""
    a, b = F.col("t") - left, F.col("t") + right
    near = events.withColumn("chunk", F.explode(F.sequence(floor_div(a, size), floor_div(b, size))))
    met = near.join(chunks, [*keys, "chunk"])
    lo = F.greatest(a - F.col("chunk") * size, F.lit(0))
    hi = F.least(b - F.col("chunk") * size, F.lit(size - 1))
    part = F.slice("data", (lo + 1).cast("int"), (hi - lo + 1).cast("int"))
    parts = met.groupBy(*events.columns).agg(F.array_sort(F.collect_list(F.struct("chunk", part.alias("p")))).alias("_p"))
    joined = parts.withColumn("snippet", F.flatten(F.transform("_p", lambda x: x["p"]))).drop("_p")
    return joined.where(F.size("snippet") == left + right + 1)


def aligned(cells: DataFrame, parameters: DataFrame, keys: Sequence[str], scale: dict[str, float] | None = None) -> DataFrame:
    """``cells`` with the columns of ``parameters`` (one row a key), 0 where a cell has none; columns named in ``scale`` are
    multiplied."""
    extra = [c for c in parameters.columns if c not in keys]
    out = cells.join(parameters, list(keys), "left")
    return out.select(*cells.columns, *((F.coalesce(F.col(c), F.lit(0)) * (scale or {})[c] if c in (scale or {}) else F.coalesce(F.col(c), F.lit(0))).alias(c) for c in extra))
