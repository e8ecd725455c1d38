"""Cell typing (one row per cell) and spike clustering (one mixture per electrode)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axonloom.operators.ranks import ranked

#: Class names that separation doesn't look at.
EXCLUDED = ["out", "Axons", "Duplicates", "contaminated", "mismapped", "Weak", "DS", "lost"]


def quality_flags(cells: DataFrame, snr: float = 2.0, refractory: float = 0.2, count: int = 300) -> DataFrame:
    """With ``flag``: -1 low signal to noise (wins over the rest), -2 bad (refractory or too few spikes), else 0."""
    bad = (F.col("refractory") > refractory) | (F.col("n") < count)
    return cells.withColumn("flag", F.when(F.col("snr") < snr, -1).when(bad, -2).otherwise(0))


def class_names(cells: DataFrame, amacrine: int = 100) -> DataFrame:
    """Text of a flag and cluster number; clusters from number ``amacrine`` on are those of amacrine cells."""
    number = F.col("cluster") + 1
    kind = F.when(number < amacrine, "All/good/RGC/nc").otherwise("All/good/Amacrine/nc")
    return cells.withColumn("class", F.when(F.col("flag") == -2, "All/Crap").when(F.col("flag") == -1, "All/good/lowSNR").otherwise(F.concat(kind, number.cast("string"))))


def principal_components(cells: DataFrame, share: float = 0.9, most: int = 10) -> tuple[DataFrame, list[float]]:
    """``cells`` with ``pc``: as many components of ``v`` as explain ``share``, each with the sign that makes its mean
    loading positive, scaled by their common deviation; and the explained shares."""
    rows = cells.withColumn("_v", array_to_vector("v"))
    mean = np.array([r[0] for r in cells.select(F.posexplode("v").alias("k", "x")).groupBy("k").agg(F.avg("x").alias("m")).orderBy("k").select("m").collect()])
    model = PCA(k=min(most, len(mean)), inputCol="_v", outputCol="_p").fit(rows)
    explained = model.explainedVariance.toArray()
    k = int(min(np.searchsorted(np.cumsum(explained), share) + 1, len(explained)))
    loads = model.pc.toArray()[:, :k]
    loads = loads * np.where(loads.mean(axis=0) < 0, -1, 1)
    columns = [F.array(*map(F.lit, (loads[:, j]).tolist())) for j in range(k)]
    dots = F.array(*(F.aggregate(F.zip_with("v", c, lambda x, y: x * y), F.lit(-float(mean @ loads[:, j])), lambda s, x: s + x) for j, c in enumerate(columns)))
    out = cells.withColumn("pc", dots)
    sd = out.select(F.explode("pc").alias("x")).agg(F.stddev_pop("x")).first()[0] or 1.0
    return out.withColumn("pc", F.transform("pc", lambda x: x / sd)), explained[:k].tolist()


def polarity(cells: DataFrame) -> DataFrame:
    """With ``polarity`` from the signs of the first two components."""
    p, q = F.get("pc", F.lit(0)), F.coalesce(F.get("pc", F.lit(1)), F.lit(0.0))
    return cells.withColumn("polarity", F.when(q.between(-0.1, 0.1) & (F.abs(p) < 0.1), "blue").when(p < 0, "off").otherwise("on"))


def elbow(cells: DataFrame, most: int, share: float = 0.9, seed: int = 1) -> tuple[int, list[float]]:
    """Smallest k whose cumulative fall of inertia reaches ``share``, with the inertias for k = 1..most."""
    rows = cells.select(array_to_vector("pc").alias("features"))
    costs = [float(KMeans(k=k, seed=seed).fit(rows).summary.trainingCost) for k in range(2, most + 1)]
    one = rows.select(vector_to_array("features").alias("f")).select(F.posexplode("f").alias("k", "x")).groupBy("k").agg((F.var_pop("x") * F.count("x")).alias("c")).agg(F.sum("c")).first()[0]
    costs = [float(one or 0.0), *costs]
    fall = np.array(costs) - min(costs)
    reached = np.cumsum(fall) / (fall.sum() or 1.0)
    return int(np.argmax(reached > share)) + 1, costs


def clustered(cells: DataFrame, k: int, seed: int = 1) -> DataFrame:
    """With ``cluster`` by k-means on ``pc``."""
    model = KMeans(k=k, seed=seed, featuresCol="_f", predictionCol="cluster").fit(cells.withColumn("_f", array_to_vector("pc")))
    return model.transform(cells.withColumn("_f", array_to_vector("pc"))).drop("_f")


def class_separation(cells: DataFrame, features: Sequence[str], excluded: Sequence[str] = EXCLUDED, least: int = 3) -> DataFrame:
    """(a, b, separation) of class pairs: distance of means after whitening by the pooled covariance, over the spread
    along it. Means and covariances are grouped sums; only one small row per class meets in the helper."""
    n = len(features)
    stats = (
        cells.where(~F.col("class").isin(list(excluded)))
        .groupBy("class")
        .agg(F.count("*").alias("n"), F.array(*(F.avg(f) for f in features)).alias("m"), F.array(*(F.covar_samp(f, g) for f in features for g in features)).alias("c"))
        .where(F.col("n") >= least)
    )
    a, b = stats, stats.select(*(F.col(c).alias(f"{c}2") for c in stats.columns))

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                c1, c2 = (np.array(x, float).reshape(n, n) for x in (r.c, r.c2))
                pooled = ((r.n - 1) * c1 + (r.n2 - 1) * c2) / (r.n + r.n2 - 2)
                w, v = np.linalg.eigh(pooled)
                white = v @ np.diag(1 / np.sqrt(np.maximum(w, 1e-12))) @ v.T
                d = white @ (np.array(r.m, float) - np.array(r.m2, float))
                size = float(np.linalg.norm(d))
                u = d / size if size else d
                spread = float(u @ white @ c1 @ white @ u + u @ white @ c2 @ white @ u)
                out.append((r[0], r[4], size / np.sqrt(spread) if spread > 0 else 0.0))
            yield pd.DataFrame(out, columns=["a", "b", "separation"])

    kind = dict(cells.dtypes)["class"]
    return a.join(b, F.col("class") < F.col("class2")).mapInPandas(run, f"a {kind}, b {kind}, separation double")


# ---- spike clustering: one group is an electrode, its spikes bounded by every_kth before the shuffle


def covariances(snippets: DataFrame, key: str = "electrode") -> DataFrame:
    """(key, i, j, cov) of snippet arrays ``v``: partial outer sums per batch, added by group."""

    def partial(batches):
        for pdf in batches:
            out = []
            for k, g in pdf.groupby(key):
                x = np.stack(g.v.to_numpy()).astype(float)
                out.append((k, float(len(x)), x.sum(0).tolist(), (x.T @ x).ravel().tolist()))
            yield pd.DataFrame(out, columns=[key, "n", "s", "o"])

    kind = dict(snippets.dtypes)[key]
    parts = snippets.select(key, "v").mapInPandas(partial, f"{key} {kind}, n double, s array<double>, o array<double>")
    counts = parts.groupBy(key).agg(F.sum("n").alias("n"))
    sums = parts.select(key, F.posexplode("s").alias("i", "x")).groupBy(key, "i").agg(F.sum("x").alias("s"))
    outer = parts.withColumn("d", F.size("s")).select(key, "d", F.posexplode("o").alias("p", "x")).groupBy(key, "d", "p").agg(F.sum("x").alias("o"))
    outer = outer.select(key, F.floor(F.col("p") / F.col("d")).cast("int").alias("i"), (F.col("p") % F.col("d")).alias("j"), "o")
    si, sj = sums, sums.select(key, F.col("i").alias("j"), F.col("s").alias("s2"))
    n = F.col("n")
    return outer.join(si, [key, "i"]).join(sj, [key, "j"]).join(counts, key).where("n > 1").select(key, "i", "j", ((F.col("o") - F.col("s") * F.col("s2") / n) / (n - 1)).alias("cov"))


def _matrix(pdf: pd.DataFrame, column: str) -> np.ndarray:
    n = int(pdf.i.max()) + 1
    m = np.zeros((n, n))
    m[pdf.i, pdf.j] = pdf[column]
    return m


def whitened(signal: DataFrame, noise: DataFrame, key: str = "electrode") -> DataFrame:
    """(key, i, j, cov): W C W with W the inverse root of the noise covariance."""
    both = signal.join(noise.withColumnRenamed("cov", "noise"), [key, "i", "j"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        c, n = _matrix(pdf, "cov"), _matrix(pdf, "noise")
        w, v = np.linalg.eigh(n)
        root = v @ np.diag(1 / np.sqrt(np.maximum(w, 1e-9))) @ v.T
        out = root @ c @ root
        return pdf.assign(cov=out[pdf.i, pdf.j])[[key, "i", "j", "cov"]]

    return both.groupBy(key).applyInPandas(run, f"{key} {dict(signal.dtypes)[key]}, i int, j int, cov double")


def eigenvectors(cov: DataFrame, dims: int, key: str = "electrode") -> DataFrame:
    """(key, d, value, vector) of the largest components; signs make the largest entry positive."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        w, v = np.linalg.eigh(_matrix(pdf, "cov"))
        rows = []
        for d, k in enumerate(np.argsort(-w)[:dims]):
            x = v[:, k] * (1 if v[np.abs(v[:, k]).argmax(), k] > 0 else -1)
            rows.append((pdf[key].iloc[0], d, float(w[k]), x.tolist()))
        return pd.DataFrame(rows, columns=[key, "d", "value", "vector"])

    return cov.groupBy(key).applyInPandas(run, f"{key} {dict(cov.dtypes)[key]}, d int, value double, vector array<double>")


def projected(snippets: DataFrame, vectors: DataFrame, key: str = "electrode") -> DataFrame:
    """Snippets with ``p``: their projections on the electrode's components."""
    basis = vectors.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "vector"))), lambda x: x["vector"]).alias("basis"))
    dot = F.transform("basis", lambda b: F.aggregate(F.zip_with("v", b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x))
    return snippets.join(basis, key).withColumn("p", dot).drop("basis")


def _density_seeds(x: np.ndarray, bins: int, significance: float, most: int) -> np.ndarray:
    lo, hi = x.min(0), x.max(0)
    cell = np.minimum(((x - lo) / np.maximum(hi - lo, 1e-12) * bins).astype(int), bins - 1)
    at, n = np.unique(cell, axis=0, return_counts=True)
    order, seeds = np.argsort(-n, kind="stable"), []
    for i in order:
        if n[i] < significance * n.mean() or len(seeds) >= most:
            break
        if all(np.abs(at[i] - at[j]).max() > 2 for j in seeds):
            seeds.append(i)
    seeds = seeds or [order[0]]
    return lo + (at[seeds] + 0.5) / bins * (hi - lo)


def mixture(x: np.ndarray, seeds: np.ndarray, rounds: int = 200, least_gain: float = 1e-6) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Diagonal Gaussians by EM: weights, means, variances, log-likelihood per row."""
    k, var = len(seeds), np.tile(x.var(0) + 1e-6, (len(seeds), 1))
    w, mu, last = np.full(k, 1 / k), seeds.astype(float), -np.inf
    for _ in range(rounds):
        log = np.log(w) - 0.5 * (((x[:, None] - mu) ** 2 / var).sum(2) + np.log(2 * np.pi * var).sum(1))
        top = log.max(1, keepdims=True)
        p = np.exp(log - top)
        now = float((top[:, 0] + np.log(p.sum(1))).mean())
        p /= p.sum(1, keepdims=True)
        n = np.maximum(p.sum(0), 1e-9)
        w, mu = n / len(x), (p.T @ x) / n[:, None]
        var = np.maximum((p.T @ (x * x)) / n[:, None] - mu**2, 1e-6)
        if now - last < least_gain:
            break
        last = now
    return w, mu, var, now


def fitted_mixtures(points: DataFrame, bins: int = 30, significance: float = 2.0, most: int = 6, cap: int = 20_000, key: str = "electrode") -> DataFrame:
    """(key, k, weight, mean, variance): a mixture per electrode on at most about ``cap`` of its spikes (a stated
    sample of the fit; ``assigned`` maps all spikes), started from the densest cells of an N-D histogram."""
    n = points.groupBy(key).agg(F.count("*").alias("_n"))
    part = points.join(n, key).where(F.pmod(F.xxhash64(*points.columns), F.lit(1 << 20)) < F.lit(float(cap) * (1 << 20)) / F.col("_n")).select(key, "p")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf.p.to_numpy()).astype(float)
        w, mu, var, _ = mixture(x, _density_seeds(x, bins, significance, most))
        return pd.DataFrame([(pdf[key].iloc[0], k, float(w[k]), mu[k].tolist(), var[k].tolist()) for k in range(len(w))], columns=[key, "k", "weight", "mean", "variance"])

    return part.groupBy(key).applyInPandas(run, f"{key} {dict(points.dtypes)[key]}, k int, weight double, mean array<double>, variance array<double>")


def assigned(points: DataFrame, models: DataFrame, key: str = "electrode") -> DataFrame:
    """Points with ``cluster``, the component of the largest posterior; one model row per electrode, so no fan-out."""
    table = models.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("k", "weight", "mean", "variance"))).alias("m"))

    def density(c):
        z = F.zip_with(F.zip_with("p", c["mean"], lambda x, y: (x - y) * (x - y)), c["variance"], lambda d, v: d / v + F.log(v))
        return F.struct((F.log(c["weight"]) - 0.5 * F.aggregate(z, F.lit(0.0), lambda s, x: s + x)).alias("l"), (-c["k"]).alias("k"))

    return points.join(table, key).withColumn("cluster", -F.array_max(F.transform("m", density))["k"]).drop("m")


def noise_events(points: DataFrame, keys: Sequence[str], length: int, per_key: int, void: int, seed: int = 1) -> DataFrame:
    """Random times at least ``void`` from every point of their key; reproducible from the seed and the key."""
    from axonloom.operators.joins import nearest_gap

    tries = points.select(*keys).distinct().withColumn("try", F.explode(F.sequence(F.lit(0), F.lit(per_key - 1))))
    t = F.pmod(F.xxhash64(F.lit(seed), *keys, "try"), F.lit(length))
    return nearest_gap(tries.withColumn("t_us", t), points, keys, bucket=max(1, length // 64)).where(F.col("gap_us") >= void).drop("gap_us")


def top_share(cells: DataFrame, x: str, share: float, keys: Sequence[str] = ()) -> DataFrame:
    """The int(n * share) largest rows by ``x`` (ties: smaller id), of each key with their rank; without keys by a
    distributed sort."""
    if not keys:
        return cells.orderBy(F.desc(x), "cell_id").limit(int(cells.count() * share))
    sizes = cells.groupBy(*keys).agg(F.floor(F.count("*") * share).alias("_n"))
    rows = ranked(cells.withColumn("_x", -F.col(x)), keys, "_x", ["cell_id"]).drop("_x").withColumn("rank", F.col("rank") + 1)
    return rows.join(sizes, list(keys)).where(F.col("rank") <= F.col("_n")).select(*cells.columns, "rank")
