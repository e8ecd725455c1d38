"""Exact ranks and order statistics of keys that may hold a large share of all rows.

``order_statistics`` never sorts: it counts a key's values in bins between bounds, keeps the bin that holds the wanted
rank with its own smallest and largest value as the new bounds, and counts again, until bounds meet. ``ranked`` deals
rows to ranges between approximate quantiles, numbers them inside each range and adds the sizes of the ranges before;
equal values share a range, so a value that very many rows have is one task's."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from axonloom.operators.rounds import _few
from axonloom.session import cut

#: Bins of a round, and ranges of a ranking.
BINS, RANGES = 256, 64


def order_statistics(rows: DataFrame, keys: Sequence[str], x: str, wanted: DataFrame) -> DataFrame:
    """(keys, rank, value): the value at each ``wanted`` (keys, rank), ranks from 0 by size. Values must not be null or
    NaN; ranks that a key doesn't have are missing."""
    names = [f"_k{i}" for i in range(len(keys))]
    values = rows.select(*(F.col(k).alias(n) for k, n in zip(keys, names)), F.col(x).cast("double").alias("_x"))
    ends = values.groupBy(*names).agg(F.min("_x").alias("lo"), F.max("_x").alias("hi"), F.count("*").alias("_n"))
    ask = wanted.select(*(F.col(k).alias(n) for k, n in zip(keys, names)), F.col("rank").cast("bigint").alias("rank")).distinct()
    joined = ask.join(ends, names) if names else ask.join(F.broadcast(ends))  # without keys ``ends`` is one row
    state = cut(joined.where("rank >= 0 and rank < _n").select(*names, "rank", F.col("rank").alias("r"), "lo", "hi"))
    done = []
    while True:
        met = F.col("lo") >= F.col("hi")
        done.append(state.where(met).select(*names, "rank", F.col("lo").alias("value")))
        state = state.where(~met)
        left = state.count()
        if not left:
            break
        inside = values.join(_few(state, left), names) if names else values.join(_few(state, left))
        inside = inside.where((F.col("_x") >= F.col("lo")) & (F.col("_x") <= F.col("hi")))
        scale = F.when(F.greatest(F.abs("lo"), F.abs("hi")) > 1e300, 0.25).otherwise(1.0)  # so that no difference overflows
        share = (F.col("_x") * scale - F.col("lo") * scale) / (F.col("hi") * scale - F.col("lo") * scale)
        bins = inside.groupBy(*names, "rank", "r", F.least(F.floor(share * BINS), F.lit(BINS - 1)).alias("bin")).agg(F.count("*").alias("n"), F.min("_x").alias("lo"), F.max("_x").alias("hi"))
        upto = F.sum("n").over(W.partitionBy(*names, "rank").orderBy("bin"))
        bins = bins.withColumn("_upto", upto).where((F.col("_upto") - F.col("n") <= F.col("r")) & (F.col("r") < F.col("_upto")))
        state = cut(bins.select(*names, "rank", (F.col("r") - F.col("_upto") + F.col("n")).alias("r"), "lo", "hi"))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select(*(F.col(n).alias(k) for n, k in zip(names, keys)), "rank", "value")


def quantiles(rows: DataFrame, keys: Sequence[str], x: str, shares: dict[str, float]) -> DataFrame:
    """(keys, a column for each name of ``shares``): exact quantiles, interpolated between the two nearest values."""
    rows = rows.where(F.col(x).isNotNull())
    sizes = cut(rows.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 0"))
    place = lambda q: (F.col("_n") - 1) * F.lit(float(q))
    ranks = F.explode(F.array_distinct(F.array(*(f(place(q)).cast("bigint") for q in shares.values() for f in (F.floor, F.ceil)))))
    found = order_statistics(rows, keys, x, sizes.select(*keys, ranks.alias("rank")))
    held = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("_m"))
    out = sizes.join(held, list(keys)) if keys else sizes.join(F.broadcast(held))

    def value(q: float):
        low, high = (F.col("_m")[f(place(q)).cast("bigint")] for f in (F.floor, F.ceil))
        return low + (high - low) * (place(q) - F.floor(place(q)))

    return out.select(*keys, *(value(q).alias(name) for name, q in shares.items()))


def ranked(rows: DataFrame, keys: Sequence[str], x: str, tie: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """``rows`` with ``name``, the place in the key by ``x``, then ``tie``, from 0. Null ``x`` come first."""
    edges = rows.groupBy(*keys).agg(F.percentile_approx(F.col(x).cast("double"), [i / RANGES for i in range(1, RANGES)], 2_000).alias("_edges"))
    edges = cut(edges)
    dealt = rows.join(_few(edges, edges.count()), list(keys)) if keys else rows.join(F.broadcast(edges))
    at = F.when(F.col(x).isNull(), -1).otherwise(F.size(F.filter("_edges", lambda e: e < F.col(x).cast("double"))))
    dealt = dealt.withColumn("_range", at).drop("_edges")
    before = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    sizes = dealt.groupBy(*keys, "_range").agg(F.count("*").alias("_n")).select(*keys, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_skip"))
    inside = F.row_number().over(W.partitionBy(*keys, "_range").orderBy(x, *tie)) - 1
    return dealt.withColumn(name, inside).join(sizes, [*keys, "_range"]).withColumn(name, F.col(name) + F.col("_skip")).select(*rows.columns, name)
