"""Queries: epochs, counts, condition means, tuning, intervals, correlograms and other response statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from axonloom.functions import scalars as S
from axonloom.operators import aggregates as A
from axonloom.operators import joins as J
from axonloom.operators import stimulus as X
from axonloom.operators import ordered as O
from axonloom.plans.registry import query
from axonloom.tables import DAY_US, HOUR_US, epochs, floor_div, spikes, table, triggers, vectors, waveforms, with_sql

H = HOUR_US


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def in_epochs(spark: SparkSession, d: str) -> DataFrame:
    return J.interval_join(spikes(spark, d), epochs(spark), DAY_US, ["file"])


_IN = with_sql("spikes", "epochs") + ", j as (select s.*, e.epoch_id, e.start_us, e.orientation, e.contrast, s.t_us - e.start_us as t_rel_us from spikes s join epochs e on s.file = e.file and s.t_us >= e.start_us and s.t_us < e.start_us + e.dur_us)"
_ISI = with_sql("spikes") + ", i as (select *, t_us - lag(t_us) over (partition by cell_id order by t_us, event_id) as isi from spikes)"


@query(_IN + """, c as (select cell_id, orientation, count(*) as n from j group by all), m as (select orientation, count(*) as k from epochs group by all),
r as (select cell_id, orientation, n / k as w from c join m using (orientation)),
s as (select cell_id, sum(w) as w, sum(w * cos(radians(orientation))) as c1, sum(w * sin(radians(orientation))) as s1, sum(w * cos(radians(orientation * 2))) as c2, sum(w * sin(radians(orientation * 2))) as s2 from r group by cell_id)
select cell_id, round(sqrt(c1 * c1 + s1 * s1) / w, 6) as dsi, round(sqrt(c2 * c2 + s2 * s2) / w, 6) as osi,
  case when sqrt(c1 * c1 + s1 * s1) / w > 1e-9 then (round(degrees(atan2(s1, c1)), 6) + 360) % 360 else 0 end as preferred from s""")
def tuning_index(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: interval join, counts, condition means, direction and orientation selectivity of each cell."""
    counts = A.counted(in_epochs(spark, d), ["cell_id", "epoch_id", "orientation"])
    means = A.condition_means(counts, epochs(spark), ["orientation"], [])
    found = A.tuning_index(means, ["cell_id"], "orientation", "mean")
    return found.select("cell_id", r6("dsi").alias("dsi"), r6("osi").alias("osi"), r6("preferred").alias("preferred"))


@query(_IN + " select cell_id, epoch_id, t_rel_us // 21600000000 as bin, count(*) as n from j group by all")
def epoch_bins(spark: SparkSession, d: str) -> DataFrame:
    return A.binned(in_epochs(spark, d), ["cell_id", "epoch_id"], 6 * H)


@query(_IN + """, e2 as (select c as contrast, b as bin, b * (5 + c) * 3600000000 as lo, (b + 1) * (5 + c) * 3600000000 as hi from range(3) t(c), range(4) u(b))
select cell_id, j.contrast, bin, count(*) as n from j join e2 on j.contrast = e2.contrast and t_rel_us >= lo and (t_rel_us < hi or (bin = 3 and t_rel_us = hi)) group by all""")
def edge_bins(spark: SparkSession, d: str) -> DataFrame:
    """Bins from an edge table, the last one closed."""
    edges = epochs(spark).select("contrast").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("_w", (F.col("contrast") + 5) * H)
    edges = edges.select("contrast", "bin", (F.col("bin") * F.col("_w")).alias("lo"), ((F.col("bin") + 1) * F.col("_w")).alias("hi"))
    return A.binned_by_edges(in_epochs(spark, d), edges, ["contrast"], ["cell_id"], "t_rel_us", 6 * H)


@query(_IN + """, n as (select cell_id, t_rel_us // 21600000000 as bin, count(*) as n from j group by all)
select c.cell_id, b as bin, coalesce(n, 0) as n from (select distinct cell_id from spikes) c cross join range(4) t(b) left join n on n.cell_id = c.cell_id and n.bin = b""")
def dense_bins(spark: SparkSession, d: str) -> DataFrame:
    sparse = A.binned(in_epochs(spark, d), ["cell_id"], 6 * H)
    return A.dense(sparse, spikes(spark, d).select("cell_id").distinct(), 4)


@query(_IN + " select orientation, count(distinct epoch_id) as n_epochs, 4::bigint as max_bins from j group by all")
def data_size(spark: SparkSession, d: str) -> DataFrame:
    seen = in_epochs(spark, d).select("epoch_id", "orientation", "dur_us").distinct()
    return A.data_size(seen, ["orientation"], 6 * H)


@query(_IN + """, n as (select cell_id, contrast, epoch_id, t_rel_us // 21600000000 as bin, count(*) as n from j group by all), k as (select contrast, count(*) as k from epochs group by all)
select cell_id, contrast, bin, round(sum(n) / any_value(k), 6) as mean, round(sqrt(greatest(sum(n * n) / any_value(k) - (sum(n) / any_value(k)) * (sum(n) / any_value(k)), 0)), 6) as sd, any_value(k) as n_epochs from n join k using (contrast) group by cell_id, contrast, bin""")
def condition_means(spark: SparkSession, d: str) -> DataFrame:
    counts = A.binned(in_epochs(spark, d), ["cell_id", "contrast", "epoch_id"], 6 * H)
    found = A.condition_means(counts, epochs(spark), ["contrast"], ["bin"])
    return found.select("cell_id", "contrast", "bin", r6("mean").alias("mean"), r6("sd").alias("sd"), "n_epochs")


@query(_IN + """, k as (select contrast, count(*) as k from epochs group by all)
select cell_id, contrast, round(sum(case when t_rel_us between 21600000000 and 64799999999 then 1 else 0 end) / any_value(k) / 12, 6) as rate, round(sum(case when t_rel_us < 21600000000 then 1 else 0 end) / any_value(k) / 6, 6) as spontaneous
from j join k using (contrast) group by cell_id, contrast""")
def stimulus_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rates an hour in the stimulus window and before it."""
    per = epochs(spark).groupBy("contrast").agg(F.count("*").alias("k"))
    t = F.col("t_rel_us")
    sums = in_epochs(spark, d).groupBy("cell_id", "contrast").agg(F.sum(((t >= 6 * H) & (t < 18 * H)).cast("int")).alias("a"), F.sum((t < 6 * H).cast("int")).alias("b"))
    return sums.join(per, "contrast").select("cell_id", "contrast", r6(F.col("a") / F.col("k") / 12).alias("rate"), r6(F.col("b") / F.col("k") / 6).alias("spontaneous"))


@query(_IN + """, a as (select *, (cell_id % 7) * cos(radians(orientation)) + (cell_id % 5) * sin(radians(orientation)) + 12 as hour from j)
select cell_id, orientation, count(*) as n from a where t_rel_us / 3600000000 - hour >= -1 and t_rel_us / 3600000000 - hour < 4 group by all""")
def bar_aligned(spark: SparkSession, d: str) -> DataFrame:
    """Spikes around the time the bar crosses each cell's centre."""
    arrival = S.bar_arrival(F.col("cell_id") % 7, F.col("cell_id") % 5, F.col("orientation"), F.lit(1.0), 12.0)
    rows = in_epochs(spark, d).withColumn("_d", F.col("t_rel_us") / H - arrival)
    return rows.where("_d >= -1 and _d < 4").groupBy("cell_id", "orientation").agg(F.count("*").alias("n"))


@query(_ISI + " select event_id, coalesce(isi, -1) as isi from i")
def isi(spark: SparkSession, d: str) -> DataFrame:
    return O.intervals(spikes(spark, d), ["cell_id"], tie=["event_id"], bucket=7 * DAY_US).select("event_id", F.coalesce("isi", F.lit(-1)).alias("isi"))


_HIST = """, h as (select cell_id, case when isi // 3600000000 < 24 then isi // 3600000000 end as bin, count(*) as n from i where isi is not null group by all)"""


@query(_ISI + _HIST + " select cell_id, bin, n, round(n / sum(n) over (partition by cell_id), 6) as fraction from h where bin is not null")
def isi_histogram(spark: SparkSession, d: str) -> DataFrame:
    return A.isi_histogram(spikes(spark, d), ["cell_id"], H, 24, tie=["event_id"], bucket=7 * DAY_US).withColumn("fraction", r6("fraction"))


@query(_ISI + _HIST + " select * from (select cell_id, bin, n, round(n / sum(n) over (partition by cell_id), 6) as fraction from h) where bin is not null")
def isi_histogram_all(spark: SparkSession, d: str) -> DataFrame:
    return A.isi_histogram(spikes(spark, d), ["cell_id"], H, 24, "all", tie=["event_id"], bucket=7 * DAY_US).withColumn("fraction", r6("fraction"))


@query(_IN + """, i as (select cell_id, t_us - lag(t_us) over (partition by cell_id, epoch_id order by t_us, event_id) as isi from j),
h as (select cell_id, isi // 3600000000 as bin, count(*) as n from i where isi // 3600000000 < 24 group by all) select cell_id, bin, n, round(n / sum(n) over (partition by cell_id), 6) as fraction from h""")
def isi_histogram_epochs(spark: SparkSession, d: str) -> DataFrame:
    """Intervals inside epochs, pooled over the epochs of a cell."""
    return A.isi_histogram(in_epochs(spark, d), ["cell_id"], H, 24, tie=["event_id"], within=["epoch_id"]).withColumn("fraction", r6("fraction"))


@query(_ISI + _HIST + ", f as (select cell_id, bin, n / sum(n) over (partition by cell_id) as fraction from h where bin is not null) select cell_id, round(100 * sum(case when bin < 3 then fraction else 0 end), 6) as refractory from f group by cell_id")
def refractory_percent(spark: SparkSession, d: str) -> DataFrame:
    h = A.isi_histogram(spikes(spark, d), ["cell_id"], H, 24, tie=["event_id"], bucket=7 * DAY_US)
    return A.refractory_percent(h, ["cell_id"], 3).withColumn("refractory", r6("refractory"))


@query(with_sql("spikes") + " select a.cell_id, (b.t_us - a.t_us) // 3600000000 as bin, count(*) as n from spikes a join spikes b on a.cell_id = b.cell_id and b.t_us > a.t_us and b.t_us - a.t_us < 36000000000 group by all")
def autocorrelogram(spark: SparkSession, d: str) -> DataFrame:
    return A.autocorrelogram(spikes(spark, d), ["cell_id"], 10 * H, H)


@query(with_sql("spikes") + """, u as (select distinct cell_id, t_us // 3600000000 as h from spikes), n as (select a.cell_id, b.h - a.h as bin, count(*) as n from u a join u b on a.cell_id = b.cell_id and b.h > a.h and b.h - a.h < 10 group by all)
select cell_id, bin, n, round(n / sqrt(sum(n * n) over (partition by cell_id)), 6) as unit from n""")
def acf_unit(spark: SparkSession, d: str) -> DataFrame:
    acf = A.autocorrelogram(spikes(spark, d), ["cell_id"], 10 * H, H, distinct_bins=H)
    return A.normalised(acf, ["cell_id"]).withColumn("unit", r6("unit"))


@query(with_sql("spikes") + """, n as (select cell_id, count(*) as n from spikes group by all), b as (select a.cell_id, count(*) as nb from spikes a join spikes b on a.cell_id = b.cell_id and b.t_us - a.t_us >= 1800000000 and b.t_us - a.t_us < 7200000000 group by all)
select cell_id, n, coalesce(nb, 0) as nb, round(coalesce(nb, 0) * 2592000000000.0 / (5400000000.0 * n * n), 6) as contamination from n left join b using (cell_id)""")
def contamination(spark: SparkSession, d: str) -> DataFrame:
    return A.contamination(spikes(spark, d), ["cell_id"], H // 2, 2 * H, 30 * DAY_US).withColumn("contamination", r6("contamination"))


# lags in ms, binned to the nearest ten minutes after subtraction; up to 3 bins and a half either side
_CCG = with_sql("spikes") + """, u as (select cell_id, file, t_us // 1000 as h, count(*) as m from spikes group by all),
c as (select a.file, a.cell_id as a, b.cell_id as b, floor((b.h - a.h + 2100000) / 600000)::bigint - 3 as bin, sum(a.m * b.m)::bigint as n
      from u a join u b on a.file = b.file and a.cell_id < b.cell_id and b.h - a.h >= -2100000 and b.h - a.h < 2100000 group by all)"""


@query(_CCG + " select * from c")
def crosscorrelogram(spark: SparkSession, d: str) -> DataFrame:
    return A.crosscorrelogram(spikes(spark, d), ["file"], 3, H // 6, unit=1_000)


@query(_CCG + " select *, round(n / sum(n) over (partition by file, a, b), 6) as value from c")
def ccg_probability(spark: SparkSession, d: str) -> DataFrame:
    return A.crosscorrelogram(spikes(spark, d), ["file"], 3, H // 6, "probability", unit=1_000).withColumn("value", r6("value"))


@query(_CCG + """, s as (select file, cell_id, count(*)::double as k, min(t_us // 1000) as lo, max(t_us // 1000) as hi from spikes group by all),
p as (select c.*, x.k as n1, y.k as n2, (greatest(x.hi, y.hi) - least(x.lo, y.lo) + 1)::double as span from c join s x on x.file = c.file and x.cell_id = a join s y on y.file = c.file and y.cell_id = b)
select file, a, b, bin, n, case when (n1 - n1 * n1 / span) * (n2 - n2 * n2 / span) > 0 then round((n - n1 * n2 / span) / sqrt((n1 - n1 * n1 / span) * (n2 - n2 * n2 / span)), 6) end as value from p""")
def ccg_correlation(spark: SparkSession, d: str) -> DataFrame:
    return A.crosscorrelogram(spikes(spark, d), ["file"], 3, H // 6, "correlation", unit=1_000).withColumn("value", r6("value"))


@query(_ISI + ", h as (select cell_id, isi // 3600000000 as bin, count(*) as n from i where isi // 3600000000 <= 20 group by all) select *, round(n / sum(n) over (partition by cell_id), 6) as probability from h")
def isi_correlogram(spark: SparkSession, d: str) -> DataFrame:
    return A.consecutive_correlogram(spikes(spark, d), ["cell_id"], 20, H, tie=["event_id"]).withColumn("probability", r6("probability"))


@query(with_sql("spikes") + """, i as (select cell_id, t_us // 1000 as t, lag(t_us // 1000) over (partition by cell_id order by t_us // 1000, event_id) as p from spikes),
k as (select cell_id, count(*) as k, max(p) - min(p) + 1 as t from i where p is not null group by cell_id),
c as (select cell_id, (t - p) // 3600000 as bin, count(*) as n from i where t - p <= 72000000 group by all)
select k.cell_id, b as bin, coalesce(n, 0) as n, round((coalesce(n, 0) - k::double * k / t) / nullif(k - k::double * k / t, 0), 6) as value from k cross join range(21) r(b) left join c on c.cell_id = k.cell_id and c.bin = b""")
def isi_correlation(spark: SparkSession, d: str) -> DataFrame:
    """The consecutive correlogram less its mean, in units of its deviation."""
    return A.consecutive_correlation(spikes(spark, d), ["cell_id"], 20, H // 1000, 1_000, tie=["event_id"]).withColumn("value", r6("value"))


@query(_CCG + """, w as (select file, a, b, s, sum(n) as w from (select *, unnest(range(bin - 1, bin + 1)) as s from c) group by all), m as (select file, a, b, max(w) as w from w group by all), s as (select file, cell_id, count(*) as k from spikes group by all)
select m.file, a, b, x.k as n_a, y.k as n_b, round(w / least(x.k, y.k), 6) as p from m join s x on x.file = m.file and x.cell_id = a join s y on y.file = m.file and y.cell_id = b""")
def coincidence(spark: SparkSession, d: str) -> DataFrame:
    return A.coincidence(spikes(spark, d), ["file"], 3, H // 6, 2, unit=1_000).withColumn("p", r6("p"))


@query(with_sql("spikes") + " select cell_id, count(*) as n from spikes group by all having count(*) >= 40")
def active_cells(spark: SparkSession, d: str) -> DataFrame:
    return A.counted(spikes(spark, d), ["cell_id"], 40)


@query(with_sql("spikes") + " select channel, (t_us % 86400000000) // 3600000000 as bin, round(count(*) / 30.0, 6) as rate from spikes group by all")
def flash_response(spark: SparkSession, d: str) -> DataFrame:
    """Counts by phase of the day over the number of days."""
    return A.folded(spikes(spark, d), ["channel"], DAY_US, H).select("channel", "bin", r6(F.col("n") / 30.0).alias("rate"))


_HARM = """, b as (select {k}, (t_rel_us // 3600000000) as bin, count(*) as n from j group by all),
s as (select {k}, sum(n) / 24 as m, {sums} from b group by all)"""
_SUMS = ", ".join(f"sum(n * {f}(2 * pi() * bin * {k} / 24)) as {f[0]}{k}" for k in (1, 2) for f in ("cos", "sin"))


@query(_IN + _HARM.format(k="cell_id, contrast", sums=_SUMS) + " select cell_id, contrast, round(m, 6) as mean, round(sqrt(c1 * c1 + s1 * s1) / 12, 6) as f1, round(sqrt(c2 * c2 + s2 * s2) / 12, 6) as f2 from s")
def cycle_f1(spark: SparkSession, d: str) -> DataFrame:
    """First and second harmonic of the daily cycle per contrast."""
    bins = A.binned(in_epochs(spark, d), ["cell_id", "contrast"], H)
    h = A.harmonics(bins, ["cell_id", "contrast"], 24, [1, 2], "n")
    return h.select("cell_id", "contrast", *(r6(c).alias(c) for c in ("mean", "f1", "f2")))


@query(_IN + _HARM.format(k="cell_id, orientation", sums=_SUMS) + ", h as (select cell_id, max(sqrt(c1 * c1 + s1 * s1) / 12) as f1, avg(sqrt(c2 * c2 + s2 * s2) / 12) as f2 from s group by cell_id) select cell_id, round(f1, 6) as f1, round(f2, 6) as f2, round(case when f1 > 1e-9 then f2 / f1 else 0 end, 6) as nonlinearity from h")
def nonlinearity_index(spark: SparkSession, d: str) -> DataFrame:
    """Reversing gratings: F1 as the largest, F2 as the mean over phases (here orientations)."""
    bins = A.binned(in_epochs(spark, d), ["cell_id", "orientation"], H)
    h = A.harmonics(bins, ["cell_id", "orientation"], 24, [1, 2], "n").groupBy("cell_id").agg(F.max("f1").alias("f1"), F.avg("f2").alias("f2"))
    return h.select("cell_id", r6("f1").alias("f1"), r6("f2").alias("f2"), r6(F.when(F.col("f1") > 1e-9, F.col("f2") / F.col("f1")).otherwise(0.0)).alias("nonlinearity"))


@query(_IN + " select coalesce(cell_id, -1) as cell_id, coalesce(contrast, -1) as contrast, coalesce(orientation, -1) as orientation, count(*) as n, count(distinct epoch_id) as runs from j group by rollup (cell_id, contrast, orientation)")
def grating_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Counts by condition with subtotals."""
    rows = in_epochs(spark, d).rollup("cell_id", "contrast", "orientation").agg(F.count("*").alias("n"), F.countDistinct("epoch_id").alias("runs"))
    return rows.fillna(-1, ["cell_id", "contrast", "orientation"])


@query(with_sql("spikes", "epochs") + """, m as (select s.file, epoch_id as run, t_us, row_number() over (partition by s.file, epoch_id order by t_us) as u, row_number() over (partition by s.file, epoch_id order by t_us desc) as d
  from spikes s join epochs e on s.file = e.file and t_us >= start_us and t_us < start_us + dur_us where channel = 'signup'),
w as (select file, run, max(case when u = 2 then t_us end) as a, max(case when d = 2 then t_us end) as b from m group by all having b > a),
c as (select s.cell_id, run % 3 as spatial, run % 2 as temporal, (run % 8 * 45)::double as direction, count(*) as n from w join spikes s on s.file = w.file and s.t_us >= a and s.t_us < b group by all)
select cell_id, spatial, temporal, direction, n::double as rate from c union all select cell_id, spatial, temporal, null, round(avg(n), 6) from c group by all""")
def grating_rates(spark: SparkSession, d: str) -> DataFrame:
    """Spikes between the second and the second-last mark of each run, by condition, with the mean over directions."""
    marks = J.interval_join(spikes(spark, d).where("channel = 'signup'"), epochs(spark), DAY_US, ["file"]).select("file", F.col("epoch_id").alias("run"), "t_us")
    run = F.col("epoch_id")
    runs = epochs(spark).select("file", run.alias("run"), (run % 3).alias("spatial"), (run % 2).alias("temporal"), F.col("orientation").cast("double").alias("direction"))
    return X.grating_table(X.grating_counts(spikes(spark, d), marks, runs, 6 * H)).withColumn("rate", r6("rate"))


@query(_IN + ", c as (select cell_id, log2(1 + orientation / 45) as x, count(*) as n from j group by all), m as (select cell_id, sum(n * x) / sum(n) as m, sum(n * x * x) / sum(n) as q from c group by all) select cell_id, round(m, 6) as mean, round(sqrt(greatest(q - m * m, 0)), 6) as rms from m")
def log_tuning(spark: SparkSession, d: str) -> DataFrame:
    """Spike-weighted mean and deviation on a log axis."""
    x = F.log2(1 + F.col("orientation") / 45)
    c = in_epochs(spark, d).groupBy("cell_id", x.alias("x")).agg(F.count("*").alias("n"))
    m = c.groupBy("cell_id").agg((F.sum(F.col("n") * F.col("x")) / F.sum("n")).alias("m"), (F.sum(F.col("n") * F.col("x") ** 2) / F.sum("n")).alias("q"))
    return m.select("cell_id", r6("m").alias("mean"), r6(F.sqrt(F.greatest(F.col("q") - F.col("m") ** 2, F.lit(0.0)))).alias("rms"))


@query(with_sql("vectors") + " select class, round(avg(v[1]), 6) as x, round(stddev_samp(v[1]) / sqrt(count(*)), 6) as x_error from vectors group by class")
def class_means(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d).select("class", F.get("v", F.lit(0)).alias("x"))
    return A.class_averages(rows, "class", ["x"]).select("class", r6("x").alias("x"), r6("x_error").alias("x_error"))


@query(with_sql("vectors") + ", l as (select class, unnest(range(64))::int as k, unnest(v) as v from vectors) select class, k, round(avg(v), 6) as mean, round(stddev_samp(v) / sqrt(count(*)), 6) as error from l group by all")
def class_mean_arrays(spark: SparkSession, d: str) -> DataFrame:
    found = A.class_averages(vectors(spark, d), "class", array="v")
    return found.select("class", "k", r6("mean").alias("mean"), r6("error").alias("error"))


@query("select c as cell_id, b as bin, coalesce(round(avg(n), 6), 0) as mean from (select distinct user_id as c from events) cross join range(5) t(b) left join (select user_id, least(floor(value / 20), 4)::bigint as bin, value as n from events) e on e.user_id = c and e.bin = b group by all")
def distance_bins(spark: SparkSession, d: str) -> DataFrame:
    """Means by distance bin, the last taking the overflow, empty ones 0."""
    s = spikes(spark, d)
    rows = s.groupBy("cell_id", F.least(F.floor(F.col("amplitude") / 20), F.lit(4)).alias("bin")).agg(F.avg("amplitude").alias("mean"))
    return A.dense(rows, s.select("cell_id").distinct(), 5, "mean").withColumn("mean", r6("mean"))


@query(with_sql("vectors") + """, m as (select cell_id, class, v[1] as x, v[2] as y, sqrt(abs(v[3]) * abs(v[4])) as s from vectors)
select a.class, round(avg(2 * sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) / (a.s + b.s)), 6) as mean, round(stddev_samp(2 * sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) / (a.s + b.s)), 6) as sd, count(*) as n from m a join m b on a.class = b.class and a.cell_id < b.cell_id group by a.class""")
def mosaic_spacing(spark: SparkSession, d: str) -> DataFrame:
    v = lambda i: F.get("v", F.lit(i))
    cells = vectors(spark, d).select("cell_id", "class", v(0).alias("x"), v(1).alias("y"), F.abs(v(2)).alias("sx"), F.abs(v(3)).alias("sy"))
    return A.mosaic_spacing(cells, "class").select("class", r6("mean").alias("mean"), r6("sd").alias("sd"), "n")


@query(with_sql("spikes") + ", k as (select channel, count(distinct cell_id) as k from spikes group by all) select channel, t_us // 86400000000 as bin, round(count(*) / (24.0 * any_value(k)), 6) as rate from spikes join k using (channel) group by all")
def population_rate(spark: SparkSession, d: str) -> DataFrame:
    s = spikes(spark, d)
    cells = s.groupBy("channel").agg(F.countDistinct("cell_id").alias("k"))
    return A.binned(s, ["channel"], DAY_US, "t_us").join(cells, "channel").select("channel", "bin", r6(F.col("n") / (24.0 * F.col("k"))).alias("rate"))


@query(with_sql("spikes") + """, i as (select cell_id, t_us - lag(t_us) over (partition by cell_id order by t_us, event_id) as isi from spikes where channel = 'signup'), m as (select *, round(isi / 86400000000) as many from i where isi is not null)
select cell_id, coalesce(round(avg(case when many = 1 then isi end) / 100, 1), -1) as refresh, sum(greatest(many - 1, 0) * 100)::bigint as dropped from m group by cell_id""")
def trigger_periods(spark: SparkSession, d: str) -> DataFrame:
    return A.trigger_periods(triggers(spark, d), ["cell_id"], DAY_US, 100, tie=["event_id"]).withColumn("refresh", F.coalesce(F.round("refresh", 1), F.lit(-1.0)))


@query(_ISI + " select cell_id, round(3600000000 / avg(isi), 6) as rate from i where isi < 72000000000 group by cell_id")
def mean_frame_rate(spark: SparkSession, d: str) -> DataFrame:
    rows = O.intervals(spikes(spark, d), ["cell_id"], tie=["event_id"]).where(F.col("isi") < 20 * H)
    return rows.groupBy("cell_id").agg(r6(H / F.avg("isi")).alias("rate"))


@query("select o_orderstatus as grp, o_orderpriority as protocol, count(*) as files, min(o_orderkey) as first_file, sum(o_custkey)::bigint as checksum from orders group by rollup (o_orderstatus, o_orderpriority)")
def experiment_summary(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderstatus").alias("grp"), F.col("o_orderpriority").alias("protocol"), "o_orderkey", "o_custkey")
    return o.rollup("grp", "protocol").agg(F.count("*").alias("files"), F.min("o_orderkey").alias("first_file"), F.sum("o_custkey").alias("checksum"))


@query(_IN + """, n as (select cell_id, epoch_id % 5 as image, epoch_id, t_rel_us // 21600000000 as bin, count(*) as n from j group by all)
select cell_id, image, bin, round(sum(n) / 6.0, 6) as mean, round(sqrt(greatest(sum(n * n) / 6.0 - (sum(n) / 6.0) ** 2, 0)), 6) as sd from n group by all""")
def image_means(spark: SparkSession, d: str) -> DataFrame:
    """Image = place in the repeated sequence of five."""
    counts = A.binned(in_epochs(spark, d).withColumn("image", F.col("epoch_id") % 5), ["cell_id", "image", "epoch_id"], 6 * H)
    found = A.condition_means(counts, epochs(spark).withColumn("image", F.col("epoch_id") % 5), ["image"], ["bin"])
    return found.select("cell_id", "image", "bin", r6("mean").alias("mean"), r6("sd").alias("sd"))


@query(with_sql("waveforms") + ", e as (select class, electrode, list_sum(list_transform(wave, lambda x: x * x)) / 8 as energy, cell_id % 7 + 1 as n from waveforms) select class, electrode, round(sum(n * energy) / sum(n), 6) as energy, sum(n)::bigint as n, round(sqrt(sum(n * energy * energy) / sum(n)), 6) as error from e group by all")
def merged_images(spark: SparkSession, d: str) -> DataFrame:
    """Weighted merge of electrode energies over the cells of a class."""
    rows = waveforms(spark, d).select("class", "electrode", A.array_energy("wave").alias("energy"), A.array_energy("wave").alias("error"), (F.col("cell_id") % 7 + 1).alias("n"))
    found = A.weighted_merge(rows, ["class", "electrode"], "energy", "n", "error")
    return found.select("class", "electrode", r6("energy").alias("energy"), "n", r6("error").alias("error"))


@query(with_sql("spikes") + """, n as (select channel, t_us // 86400000000 % 3 as e, t_us % 86400000000 // 21600000000 as a, count(*) as n from spikes group by all), p as (select channel, e, a, n / sum(n) over (partition by channel) as p from n),
q as (select x.channel as target, x.e, y.channel as other, max(x.p * (1 - y.p)) as v from p x join p y on x.e = y.e and x.a = y.a and x.channel <> y.channel group by all), m as (select target, e, min(v) as v from q group by all) select target, round(max(v), 6) as value from m group by target""")
def selectivity(spark: SparkSession, d: str) -> DataFrame:
    s = spikes(spark, d)
    n = s.groupBy("channel", (floor_div("t_us", DAY_US) % 3).alias("electrode"), floor_div(F.pmod("t_us", F.lit(DAY_US)), 6 * H).alias("amp")).agg(F.count("*").alias("n"))
    p = n.join(n.groupBy("channel").agg(F.sum("n").alias("t")), "channel").select("channel", "electrode", "amp", (F.col("n") / F.col("t")).alias("p"))
    other = p.select(F.col("channel").alias("other"), "electrode", "amp", F.col("p").alias("p_other"))
    rows = p.withColumnRenamed("channel", "target").join(other, ["electrode", "amp"]).where("target <> other")
    return A.selectivity(rows).select("target", r6("value").alias("value"))


@query("with m as (select event_type, median(value) as m from events group by all) select event_type as channel, round(median(abs(value - m)) * 1.4826, 6) as sd from events join m using (event_type) group by all")
def robust_sd(spark: SparkSession, d: str) -> DataFrame:
    return A.robust_sd(spikes(spark, d), ["channel"], "amplitude").withColumn("sd", r6("sd"))


@query("select event_type as channel, round((quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) * 0.7413, 6) as sd from events group by all")
def robust_sd_iqr(spark: SparkSession, d: str) -> DataFrame:
    return A.robust_sd(spikes(spark, d), ["channel"], "amplitude", "iqr").withColumn("sd", r6("sd"))


@query(_ISI + " select cell_id, round(coalesce(case when isfinite(corr(isi / 1e9, amplitude)) then corr(isi / 1e9, amplitude) end, 0), 6) as r from i where isi is not null group by cell_id")
def isi_amplitude_r(spark: SparkSession, d: str) -> DataFrame:
    rows = O.intervals(spikes(spark, d), ["cell_id"], tie=["event_id"]).withColumn("x", F.col("isi") / 1e9)
    return A.pearson(rows, ["cell_id"], "x", "amplitude").withColumn("r", r6("r"))


@query(with_sql("vectors") + ", l as (select cell_id, class, unnest(range(64)) as k, unnest(v) as x from vectors), m as (select class, k, avg(x) as y from l group by all) select cell_id, round(sum(x * y) / sqrt(sum(x * x) * sum(y * y)), 6) as c from l join m using (class, k) group by cell_id")
def class_cosine(spark: SparkSession, d: str) -> DataFrame:
    """Cosine of each cell's electrical image with its class mean."""
    long = vectors(spark, d).select("cell_id", "class", F.posexplode("v").alias("k", "x"))
    rows = long.join(long.groupBy("class", "k").agg(F.avg("x").alias("y")), ["class", "k"])
    return A.cosine(rows, ["cell_id"], "x", "y").withColumn("c", r6("c"))


@query(with_sql("spikes") + ", r as (select channel, amplitude, t_us % 86400000000 / 3600000000 as y, row_number() over (partition by channel order by amplitude, event_id) - 1 as p, count(*) over (partition by channel) // 10 as k from spikes) select channel, p // k as bin, round(avg(amplitude), 6) as x, round(avg(y), 6) as y from r where p // k < 10 group by all")
def nonlinearity_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = spikes(spark, d).withColumn("y", F.pmod("t_us", F.lit(DAY_US)) / H)
    found = A.equal_count_bins(rows, ["channel"], "amplitude", "y", 10, ["event_id"])
    return found.select("channel", "bin", r6("x").alias("x"), r6("y").alias("y"))


@query(with_sql("spikes") + " select channel, floor(amplitude / 10)::bigint as bin, count(*) as n, round(avg(amplitude), 6) as x, round(avg(t_us % 86400000000 / 3600000000), 6) as y from spikes where amplitude >= 0 and amplitude < 100 group by all")
def nonlinearity_widths(spark: SparkSession, d: str) -> DataFrame:
    rows = spikes(spark, d).withColumn("y", F.pmod("t_us", F.lit(DAY_US)) / H)
    found = A.equal_width_bins(rows, ["channel"], "amplitude", "y", 0.0, 100.0, 10)
    return found.select("channel", "bin", "n", r6("x").alias("x"), r6("y").alias("y"))


@query("""with r as (select event_type as channel, value / 25 - 5 as g, user_id % 3 as n from events), s as (select channel, floor((g + 10) / 0.05)::bigint as bin, sum(n) as x, count(*) as y from r where abs(g) < 10 group by all)
select channel, bin, round(100.0 * x / y, 6) as rate, round(100.0 * sqrt(x * (x + y) / power(y, 3)), 6) as error from s""")
def rate_by_current(spark: SparkSession, d: str) -> DataFrame:
    rows = spikes(spark, d).select("channel", (F.col("amplitude") / 25 - 5).alias("g"), (F.col("cell_id") % 3).alias("n"))
    found = A.rate_by_current(rows, ["channel"], "g", "n", 10.0)
    return found.select("channel", "bin", r6("rate").alias("rate"), r6("error").alias("error"))


_MARK = with_sql("spikes") + ", g as (select event_id, cell_id, t_us from spikes where channel = 'signup'), m as (select s.*, (select max(g.t_us) from g where g.cell_id = s.cell_id and g.t_us <= s.t_us) as mark_us, (select count(*) from g where g.cell_id = s.cell_id and g.t_us <= s.t_us) as mark_no from spikes s)"


@query(_MARK + " select event_id, coalesce(mark_us, -1) as mark_us, mark_no from m")
def last_trigger(spark: SparkSession, d: str) -> DataFrame:
    return J.last_mark(spikes(spark, d), triggers(spark, d), ["cell_id"], bucket=7 * DAY_US).select("event_id", F.coalesce("mark_us", F.lit(-1)).alias("mark_us"), F.coalesce("mark_no", F.lit(0)).alias("mark_no"))


@query(_MARK + ", r as (select cell_id, count(*) as runs from g group by all) select cell_id, (t_us - mark_us) // 21600000000 as bin, round(count(*) / any_value(runs), 6) as rate from m join r using (cell_id) where mark_us is not null and t_us - mark_us < 86400000000 group by all")
def run_psth(spark: SparkSession, d: str) -> DataFrame:
    """Spikes after each run's trigger, per run."""
    marks = triggers(spark, d)
    rows = J.last_mark(spikes(spark, d), marks, ["cell_id"], bucket=7 * DAY_US).withColumn("dt", F.col("t_us") - F.col("mark_us")).where(F.col("dt") < DAY_US)
    runs = marks.groupBy("cell_id").agg(F.count("*").alias("runs"))
    return A.binned(rows, ["cell_id"], 6 * H, "dt").join(runs, "cell_id").select("cell_id", "bin", r6(F.col("n") / F.col("runs")).alias("rate"))


@query(with_sql("spikes") + """, b as (select channel, t_us // 43200000000 as bin, count(*) as n from spikes group by all), k as (select k from range(26, 35) t(k)),
h as (select channel, k, sqrt(sum(n * cos(2 * pi() * bin * k / 60)) ** 2 + sum(n * sin(2 * pi() * bin * k / 60)) ** 2) / 30 as f from b, k group by all) select channel, round(max(f), 6) as amplitude from h group by channel""")
def population_harmonic(spark: SparkSession, d: str) -> DataFrame:
    """The largest amplitude around one frequency of the class's rate."""
    ks = list(range(26, 35))
    h = A.harmonics(A.binned(spikes(spark, d), ["channel"], 12 * H, "t_us"), ["channel"], 60, ks, "n")
    return h.select("channel", r6(F.greatest(*(f"f{k}" for k in ks))).alias("amplitude"))


@query(with_sql("waveforms") + " select cell_id, electrode, round(list_sum(list_transform(wave, lambda x: x * x)) / 8, 6) as energy from waveforms")
def image_energy(spark: SparkSession, d: str) -> DataFrame:
    return waveforms(spark, d).select("cell_id", "electrode", r6(A.array_energy("wave")).alias("energy"))


@query(with_sql("waveforms") + ", l as (select class, electrode, unnest(range(8))::int as k, unnest(wave) as v from waveforms) select class, electrode, k, round(avg(v), 6) as mean, round(stddev_pop(v), 6) as error, count(*) as n from l group by all")
def mean_waves(spark: SparkSession, d: str) -> DataFrame:
    found = A.mean_waves(waveforms(spark, d), ["class", "electrode"])
    return found.select("class", "electrode", "k", r6("mean").alias("mean"), r6("error").alias("error"), "n")
