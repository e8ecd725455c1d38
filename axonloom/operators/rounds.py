"""Iterative fits as rounds of grouped sums: a small table of parameters, a row a key, is joined to the rows, the rows are
summed, and keys whose parameters stay leave the rounds. Rows never gather by key, whatever their number; each round
shuffles partial sums. The parameter table is broadcast while it is proven small."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axonloom.session import cut

#: Keys whose parameters are broadcast.
BROADCAST_KEYS = 100_000
#: Turns of two means after which a key is taken as it is (two sides that swap a tied row forever).
TURNS = 100


def _few(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_KEYS else df


def _small(df: DataFrame) -> DataFrame:
    return _few(df, df.limit(BROADCAST_KEYS + 1).count())


def clipped_sigma(samples: DataFrame, key: str, x: str, sigmas: float = 3.0, least_change: float = 0.01) -> DataFrame:
    """(key, sigma, passes): deviation (n - 1) of samples closer than ``sigmas`` of it to the mean, repeated until it
    changes by ``least_change`` or less. Sums of earlier passes are kept, as in the procedure this follows, so the first
    pass takes all samples and each further one adds those inside."""
    # equal samples are counted first: recorded ones have few values
    rows = cut(samples.select(key, F.col(x).cast("double").alias("_x")).where("_x is not null").groupBy(key, "_x").agg(F.count("*").alias("_m")))
    state = cut(rows.select(key).distinct().select(key, F.lit(0.0).alias("mean"), F.lit(None).cast("double").alias("sd"), *(F.lit(0.0).alias(c) for c in "nsq"), F.lit(0).alias("passes")))
    done, left = [], state.count()
    while left:
        inside = F.col("sd").isNull() | (F.abs(F.col("_x") - F.col("mean")) < sigmas * F.col("sd"))
        sums = rows.join(_few(state.select(key, "mean", "sd"), left), key).where(inside).groupBy(key).agg(F.sum("_m").alias("_n"), F.sum(F.col("_x") * F.col("_m")).alias("_s"), F.sum(F.col("_x") * F.col("_x") * F.col("_m")).alias("_q"))
        added = [(F.col(c) + F.coalesce(f"_{c}", F.lit(0.0))).alias(c) for c in "nsq"]
        new = state.join(sums, key, "left").select(key, F.col("sd").alias("_last"), *added, (F.col("passes") + 1).alias("passes"))
        var = (F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1)
        new = new.select("*", (F.col("s") / F.col("n")).alias("mean"), F.sqrt(F.greatest(F.when(F.col("n") > 1, var).otherwise(0.0), F.lit(0.0))).alias("sd"))
        new = cut(new.withColumn("_stays", F.coalesce(F.abs(F.col("sd") - F.col("_last")) <= least_change, F.lit(False))))
        done.append(new.where("_stays").select(key, F.col("sd").alias("sigma"), "passes"))
        state = new.where("not _stays").select(key, "mean", "sd", "n", "s", "q", "passes")
        left = state.count()
    out = samples.select(key).limit(0).select(key, F.lit(0.0).alias("sigma"), F.lit(0).alias("passes"))
    for part in done:
        out = out.unionByName(part)
    return out


def _distance(p: str, c: str):
    return F.aggregate(F.zip_with(p, c, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def two_means(points: DataFrame, key: str) -> DataFrame:
    """(key, c0, c1): two means of the points ``p`` (arrays of one length), begun at the point farthest from the mean and
    the one farthest from that, and moved until no point changes sides."""
    first = points.select(F.size("p").alias("d")).first()
    dims = first.d if first else 0
    mean = lambda when: F.array(*(F.avg(F.when(when, F.get("p", F.lit(i)))) for i in range(dims))).cast("array<double>")
    rows = points.select(key, F.col("p").cast("array<double>").alias("p"))
    start = rows.groupBy(key).agg(mean(F.lit(True)).alias("m"))
    for name, origin in (("c0", "m"), ("c1", "c0")):
        far = rows.join(_small(start.select(key, F.col(origin).alias("_o"))), key).groupBy(key).agg(F.max(F.struct(_distance("p", "_o").alias("d"), "p")).alias("far"))
        start = cut(start.join(far, key).select(*start.columns, F.col("far.p").alias(name)))
    now, done = start.select(key, "c0", "c1"), []
    for turn in range(TURNS):
        if now.isEmpty():
            break
        near = _distance("p", "c0") <= _distance("p", "c1")
        moved = rows.join(_small(now), key).withColumn("_near", near).groupBy(key).agg(mean(F.col("_near")).alias("n0"), mean(~F.col("_near")).alias("n1"), F.first("c0").alias("c0"), F.first("c1").alias("c1"))
        kept = lambda n, c: F.when(F.get(n, F.lit(0)).isNotNull(), F.col(n)).otherwise(F.col(c)).alias(c)
        moved = moved.withColumn("_stays", ((F.get("n0", F.lit(0)).isNull()) | (_distance("n0", "c0") < 1e-18)) & ((F.get("n1", F.lit(0)).isNull()) | (_distance("n1", "c1") < 1e-18)))
        moved = cut(moved.select(key, kept("n0", "c0"), kept("n1", "c1"), "_stays"))
        stays = F.col("_stays") | F.lit(turn == TURNS - 1)
        done.append(moved.where(stays).drop("_stays"))
        now = moved.where(~stays).drop("_stays")
    out = start.select(key, "c0", "c1").limit(0)
    for part in done:
        out = out.unionByName(part)
    return out


def bimodal(points: DataFrame, key: str, least: int = 300, bins: int = 30) -> DataFrame:
    """(key, score): depth of the dip between the two modes of a signed projection on the line of two means, for keys
    with enough points; 1 is two separate modes. Tasks hold the ``bins`` counts of a key, never its points."""
    big = points.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(key)
    rows = points.join(_small(cut(big)), key, "left_semi").select(key, F.col("p").cast("array<double>").alias("p"))
    line = two_means(rows, key)
    middle = F.zip_with("c0", "c1", lambda x, y: (x + y) / 2)
    around = F.zip_with("p", middle, lambda x, m: x - m)
    along = F.aggregate(F.zip_with(around, F.zip_with("c1", "c0", lambda x, y: x - y), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    placed = rows.join(_small(line), key).select(key, along.alias("t"))
    ends = placed.groupBy(key).agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    bin_ = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("t") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).otherwise(bins // 2)
    counts = placed.join(_small(cut(ends)), key).groupBy(key, bin_.alias("bin")).agg(F.count("*").alias("n"))

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        n = np.zeros(bins)
        n[pdf["bin"].to_numpy(int)] = pdf["n"]
        n, half = np.convolve(n, np.ones(3) / 3, "same"), bins // 2
        a, b = int(n[:half].argmax()), half + int(n[half:].argmax())
        dip, peak = n[a : b + 1].min(), min(n[a], n[b])
        return pd.DataFrame({key: [pdf[key].iloc[0]], "score": [float(1 - dip / peak) if peak > 0 else 0.0]})

    return counts.groupBy(key).applyInPandas(score, f"{key} {dict(points.dtypes)[key]}, score double")
