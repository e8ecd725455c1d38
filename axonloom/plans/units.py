"""Queries: duplicate units, triggered averages and receptive fields, cell types, mixtures, live windows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from axonloom.functions import scalars as S
from axonloom.functions.listeners import array_correlation, ordered_aggregate
from axonloom.operators import aggregates as A
from axonloom.operators import clustering as C
from axonloom.operators import fields as R
from axonloom.operators import greedy as G
from axonloom.operators import joins as J
from axonloom.operators import merging as M
from axonloom.operators import ordered as O
from axonloom.operators import recursive as V
from axonloom.operators import regions as E
from axonloom.operators import rounds as Q
from axonloom.operators import stimulus as X
from axonloom.plans.registry import query
from axonloom.plans.responses import r6
from axonloom.plans.signals import _UNIT
from axonloom.streaming import live
from axonloom.tables import DAY_US, HOUR_US, floor_div, spikes, table, vectors, waveforms, with_sql

H = HOUR_US

# ---- duplicates


def _corr(x: str, y: str) -> str:
    """Pearson correlation of two lists in SQL; 0 without spread or without one of them."""
    c = lambda v: f"list_transform({v}, lambda z: z - list_avg({v}))"
    power = f"sqrt(list_inner_product({c(x)}, {c(x)}) * list_inner_product({c(y)}, {c(y)}))"
    return f"coalesce(case when {power} > 0 then list_inner_product({c(x)}, {c(y)}) / {power} else 0.0 end, 0.0)"


# images are running sums of running sums of the vectors, masked ones leave out what is below half of the peak, waves are the first part
_MEASURES = with_sql("spikes", "vectors").removeprefix("with ") + f""",
i as (select cell_id, t_us - lag(t_us) over (partition by cell_id order by t_us, event_id) as isi from spikes), h as (select cell_id, isi // 3600000000 as bin, count(*) as n from i where isi // 3600000000 < 24 group by all),
hist as (select c.cell_id, list(coalesce(h.n, 0)::double order by k) as isi from (select distinct cell_id, k from h cross join range(24) t(k)) c left join h on h.cell_id = c.cell_id and h.bin = k group by c.cell_id),
once as (select cell_id, v as sta, list_transform(range(1, len(v) + 1), lambda j: list_sum(v[1:j])) as s from vectors), image as (select cell_id, sta, list_transform(range(1, len(s) + 1), lambda j: list_sum(s[1:j])) as ei from once),
arrays as materialized (select cell_id, sta, ei, list_transform(ei, lambda x: case when abs(x) >= 0.5 * list_max(list_transform(ei, lambda y: abs(y))) then x else 0.0 end) as masked, ei[1:16] as wave, isi from image left join hist using (cell_id)),
unit as materialized (select *, list_transform(ei, lambda x: x - list_avg(ei)) as c from arrays),
near as materialized (select x.cell_id as a, y.cell_id as b, list_inner_product(x.c, y.c) / sqrt(list_inner_product(x.c, x.c) * list_inner_product(y.c, y.c)) as ei from unit x join unit y on x.cell_id < y.cell_id
  where list_inner_product(x.c, y.c) / sqrt(list_inner_product(x.c, x.c) * list_inner_product(y.c, y.c)) >= 0.92),
measured as (select a, b, near.ei, {_corr("x.masked", "y.masked")} as masked, {_corr("x.wave", "y.wave")} as wave, {_corr("x.sta", "y.sta")} as sta, {_corr("x.isi", "y.isi")} as isi from near join arrays x on x.cell_id = a join arrays y on y.cell_id = b),
candidates as materialized (select * from measured where ({" or ".join(f"(ei > {x} and masked > {y} and wave > {z})" for x, y, z in M.THRESHOLDS)}) and (isi > 0.6 or sta > 0.1))"""


def _arrays(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    running = lambda v: F.aggregate(v, F.array().cast("array<double>"), lambda s, x: F.concat(s, F.array(F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0.0)) + x)))
    top = F.array_max(F.transform("ei", lambda x: F.abs(x)))
    image = v.select("cell_id", F.col("v").alias("sta"), running("v").alias("s")).select("cell_id", "sta", running("s").alias("ei")).withColumn("top", top)
    masked = F.transform("ei", lambda x: F.when(F.abs(x) >= 0.5 * F.col("top"), x).otherwise(0.0))
    bins = A.isi_histogram(spikes(spark, d), ["cell_id"], H, 24, tie=["event_id"], bucket=7 * DAY_US).groupBy("cell_id").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"))
    hist = bins.select("cell_id", F.transform(F.sequence(F.lit(0), F.lit(23)), lambda k: F.coalesce(F.try_element_at("m", k.cast("bigint")), F.lit(0)).cast("double")).alias("isi"))
    return image.select("cell_id", "sta", "ei", masked.alias("masked"), F.slice("ei", 1, 16).alias("wave")).join(hist, "cell_id", "left")


#: Limits of intervals and averages, either of which a candidate pair is over.
AGREE = {"sta": 0.1, "isi": 0.6}


@query("with " + _MEASURES + " select a, b, round(ei, 6) as ei, round(masked, 6) as masked, round(wave, 6) as wave, round(sta, 6) as sta, round(isi, 6) as isi from candidates")
def merge_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Pairs over one of several rows of three limits (image, masked image, wave) whose intervals or averages agree."""
    pairs = M.measured(_arrays(spark, d), extra=" or ".join(f"{c} > {t}" for c, t in AGREE.items()), more=list(AGREE))
    return pairs.select("a", "b", *(r6(c).alias(c) for c in ("ei", "masked", "wave", "sta", "isi")))


def _clustered(pairs: str, key: str = "1") -> str:
    """Greedy clusters in SQL: heads (key, head, own) of pairs (a, b), walked cell by cell."""
    return f"""edges as (select {key} as key, a, b from {pairs} union select {key}, b, a from {pairs}),
walk as materialized (select key, a, list(b order by b) as bs, row_number() over (partition by key order by a) as i from edges group by key, a),
heads as (select distinct key, 0::bigint as i, []::bigint[] as used, null::bigint as head, []::bigint[] as own from walk
      union all select heads.key, w.i, case when takes then list_concat(used, list_append(free, w.a)) else used end, case when takes then w.a end, free
      from heads join walk w on w.key = heads.key and w.i = heads.i + 1, lateral (select list_filter(w.bs, lambda x: not list_contains(used, x)) as free), lateral (select not list_contains(used, w.a) and len(free) > 0 as takes))"""


@query("with recursive " + _UNIT.removeprefix("with ") + ", p as (select a.class, a.cell_id as a, b.cell_id as b from u a join u b on a.class = b.class and a.cell_id < b.cell_id where list_inner_product(a.v, b.v) >= 0.3), " + _clustered("p", "class") + " select key as class, head, unnest(own) as member from heads where head is not null")
def greedy_clusters(spark: SparkSession, d: str) -> DataFrame:
    return G.correlated_clusters(vectors(spark, d), 0.3, ["class"])


_PAIR = "recursive " + _MEASURES + ", active as (select a, b from candidates where a in (select cell_id from spikes) and b in (select cell_id from spikes)), " + _clustered("active") + ", m as (select head, unnest(own) as member from heads where head is not null)"


def _merges(spark: SparkSession, d: str) -> DataFrame:
    """Greedy clusters of the candidate pairs whose cells have spikes."""
    cells = spikes(spark, d).select("cell_id").distinct()
    return M.measured_clusters(_arrays(spark, d).join(cells, "cell_id", "left_semi"), AGREE)


_TRAIN = "with " + _PAIR + ", t as (select head as a, member as b, cell_id, t_us from m join spikes on cell_id in (head, member)), gaps as (select a, b, t_us - lag(t_us) over (partition by a, b order by t_us, cell_id) as isi from t), f as (select a, b, avg(case when isi < 3600000000 then 1.0 else 0.0 end) as fraction from gaps where isi is not null group by all)"
# pairs of a dominant cell a and a candidate b, some spike of which no spike of a is near
_FAR = ", far as (select distinct a, b from {pairs} join spikes s on s.cell_id = b where not exists (select 1 from spikes h where h.cell_id = a and abs(h.t_us - s.t_us) <= 3600000000))"


@query(_TRAIN + _FAR.format(pairs="f") + " select a, b, round(fraction, 6) as fraction, fraction < 0.15 or (a, b) in (select (a, b) from far) as ok from f")
def refractory_test(spark: SparkSession, d: str) -> DataFrame:
    pairs = _merges(spark, d).select(F.col("head").alias("a"), F.col("member").alias("b"))
    return M.refractory_test(pairs, spikes(spark, d), H, 0.15, 7 * DAY_US).withColumn("fraction", r6("fraction"))


@query("with " + _PAIR + " select head, t_us, cell_id as source from (select distinct head from m) join spikes on cell_id = head union all select head, s.t_us, s.cell_id from m join spikes s on s.cell_id = member where not exists (select 1 from spikes h where h.cell_id = head and abs(h.t_us - s.t_us) <= 3600000000)")
def merged_trains(spark: SparkSession, d: str) -> DataFrame:
    return M.merged_trains(_merges(spark, d), spikes(spark, d).select("cell_id", "t_us"), H, 7 * DAY_US)


@query("with " + _PAIR + " select member as cell_id, head as unit from m union all select distinct user_id, user_id from events where user_id not in (select member from m)")
def complete_map(spark: SparkSession, d: str) -> DataFrame:
    return M.complete_map(spikes(spark, d).select("cell_id").distinct(), _merges(spark, d))


# the most active cell of a cluster against each of the others
_RANKED = """, n as (select cell_id, count(*) as n from spikes group by all), g as (select head, member as c from m union select head, head from m),
rk as (select head, c, row_number() over (partition by head order by n desc, c) as k from g join n on n.cell_id = c), r as (select x.c as a, y.c as b from rk x join rk y on x.head = y.head and x.k = 1 and y.k > 1),
t as (select a, b, cell_id, t_us from r join spikes on cell_id in (a, b)), gaps as (select a, b, t_us - lag(t_us) over (partition by a, b order by t_us, cell_id) as isi from t),
f as (select a, b, avg(case when isi < 3600000000 then 1.0 else 0.0 end) as fraction from gaps where isi is not null group by all)"""


@query("with " + _PAIR + _RANKED + _FAR.format(pairs="r") + " select a as head, b as member from f where fraction < 0.15 or (a, b) in (select (a, b) from far)")
def evaluated_merges(spark: SparkSession, d: str) -> DataFrame:
    return M.evaluated(_merges(spark, d), spikes(spark, d).select("cell_id", "t_us"), H, 0.15, 7 * DAY_US)


@query("with recursive " + with_sql("spikes").removeprefix("with ") + """, enough as (select file, cell_id, count(*) as n from spikes group by all having count(*) >= 10),
back as (select file, a.cell_id, count(*) as nb from spikes a join spikes b using (file, cell_id) where b.t_us - a.t_us >= 1800000000 and b.t_us - a.t_us < 7200000000 group by all),
pure as materialized (select file, cell_id, n from enough left join back using (file, cell_id) where coalesce(nb, 0) * 864000000000.0 / (5400000000.0 * n * n) < 8.0),
u as (select file, cell_id, t_us // 1000 as h, count(*) as m from spikes join pure using (file, cell_id) group by all),
c as (select a.file, a.cell_id as a, b.cell_id as b, floor((b.h - a.h + 2100000) / 600000)::bigint - 3 as bin, sum(a.m * b.m)::bigint as n from u a join u b on a.file = b.file and a.cell_id < b.cell_id and b.h - a.h >= -2100000 and b.h - a.h < 2100000 group by all),
w as (select file, a, b, s, sum(n) as w from (select *, unnest(range(bin - 1, bin + 1)) as s from c) group by all),
hits as (select x.file, a, b, x.n as n_a, y.n as n_b, max(w) as w from w join pure x on x.file = w.file and x.cell_id = a join pure y on y.file = w.file and y.cell_id = b group by all),
e as materialized (select *, row_number() over (partition by file order by a, b) as i from hits where w / least(n_a, n_b) >= 0.15),
walk as (select distinct file, 0::bigint as i, []::bigint[] as gone from e
         union all select walk.file, e.i, case when list_contains(gone, e.a) or list_contains(gone, e.b) then gone else list_append(gone, case when n_a < n_b then e.a else e.b end) end from walk join e on e.file = walk.file and e.i = walk.i + 1)
select file, cell_id, n from pure where not exists (select 1 from walk where walk.file = pure.file and list_contains(walk.gone, pure.cell_id))""")
def cleaned_cells(spark: SparkSession, d: str) -> DataFrame:
    """The cleaning cascade per file."""
    return M.cleaned(spikes(spark, d), ["file"], 10, H // 2, 2 * H, 10 * DAY_US, 8.0, 3, H // 6, 2, 0.15, unit=1_000)


@query(_UNIT + """, p as (select a.cell_id as source, b.cell_id as target from u a, u b where a.cell_id % 2 = 0 and b.cell_id % 2 = 1 and list_inner_product(a.v, b.v) >= 0.4), k as (select target, min('class/' || class) as class from p join vectors on vectors.cell_id = source group by target)
select cell_id, coalesce(k.class, 'All/unmatched') as class from vectors left join k on target = cell_id where cell_id % 2 = 1""")
def transferred_classes(spark: SparkSession, d: str) -> DataFrame:
    """Labels of one recording (even ids) to another (odd ids) by correlation."""
    v = vectors(spark, d)
    one, two = v.where("cell_id % 2 = 0"), v.where("cell_id % 2 = 1")
    matches = J.correlated_pairs(one, 0.4, right=two).select(F.col("a").alias("source"), F.col("b").alias("target"))
    classes = one.select("cell_id", F.concat(F.lit("class/"), F.col("class").cast("string")).alias("class"))
    return M.transferred_classes(matches, classes, two.select("cell_id"))


# ---- triggered averages: epochs are days, frames hours, pixels the channels' counts in the hour

_STA = with_sql("spikes") + """, n as (select t_us // 86400000000 as epoch_id, t_us % 86400000000 // 3600000000 as frame, channel, count(*) as x from spikes group by all), fr as (select distinct epoch_id, frame from n), hours as (select distinct epoch_id, h as frame from n cross join range(24) t(h)), pix as (select epoch_id, frame, p, coalesce(x, 0) as x from hours cross join (values (0, 'click'), (1, 'error'), (2, 'purchase'), (3, 'signup'), (4, 'view')) c(p, channel) left join n using (epoch_id, frame, channel)),
k as (select t_us // 86400000000 as epoch_id, t_us % 86400000000 // 3600000000 as frame, channel as cell, count(*) as n from spikes where amplitude > 30 group by all),
j as (select cell, lag, p, k.n, x from k cross join range(4) l(lag) join pix on pix.epoch_id = k.epoch_id and pix.frame = k.frame - lag)"""
_CHANNELS = ["click", "error", "purchase", "signup", "view"]


def _frames(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = spikes(spark, d).withColumn("epoch_id", floor_div("t_us", DAY_US)).withColumn("frame", floor_div(F.pmod("t_us", F.lit(DAY_US)), H).cast("int"))
    counts = [F.sum((F.col("channel") == c).cast("float")).cast("float") for c in _CHANNELS]
    frames = s.groupBy("epoch_id", "frame").agg(F.array(*counts).alias("pixels"))
    cell = F.array_position(F.array(*map(F.lit, _CHANNELS)), F.col("channel")) - 1
    shown = s.where("amplitude > 30").groupBy("epoch_id", "frame", cell.alias("cell_id")).agg(F.count("*").alias("n"))
    return shown, frames


@query(_STA + ", c as (select unnest(range(5)) as cell_id, unnest(['click', 'error', 'purchase', 'signup', 'view']) as cell) select cell_id, lag::int as lag, p::int as pix, round(sum(n * x) / sum(n), 6) as value from j join c using (cell) group by all")
def triggered_average(spark: SparkSession, d: str) -> DataFrame:
    return X.triggered_average(*_complete(spark, d), 4).select("cell_id", "lag", "pix", r6("value").alias("value"))


def _complete(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Counts and frames with every hour of a day, so that a lag is a place."""
    counts, frames = _frames(spark, d)
    grid = frames.select("epoch_id").distinct().withColumn("frame", F.explode(F.sequence(F.lit(0), F.lit(23))))
    none = F.array(*(F.lit(0.0).cast("float") for _ in _CHANNELS))
    return counts, grid.join(frames, ["epoch_id", "frame"], "left").withColumn("pixels", F.coalesce("pixels", none))


@query(_STA + ", c as (select unnest(range(5)) as cell_id, unnest(['click', 'error', 'purchase', 'signup', 'view']) as cell) select cell_id, lag::int as lag, p::int as pix, round(sum(n * x * x) / (sum(n) - 1), 6) as value from j join c using (cell) group by all")
def triggered_second_moment(spark: SparkSession, d: str) -> DataFrame:
    return X.triggered_second_moment(*_complete(spark, d), 4).select("cell_id", "lag", "pix", r6("value").alias("value"))


@query(_STA + " select epoch_id, k.frame::int as frame, lag::int as lag, sum(k.n)::bigint as n from k cross join range(4) l(lag) join fr using (epoch_id) where fr.frame = k.frame - lag group by all")
def shifted_join(spark: SparkSession, d: str) -> DataFrame:
    counts, frames = _frames(spark, d)
    rows = J.shifted_join(counts.withColumn("at", F.col("frame")), frames.select("epoch_id", "frame"), 4, ["epoch_id"])
    return rows.groupBy("epoch_id", F.col("at").alias("frame"), "lag").agg(F.sum("n").alias("n"))


@query(_STA + """, w as (select 0 as cell_id, lag, p, (lag + 1) * 0.1 + p * 0.01 as w from range(4) l(lag), range(5) q(p)), g as (select pix.epoch_id, pix.frame + lag as frame, sum(x * w) as g from pix join w using (p) group by all)
select epoch_id, frame::int as frame, round(g, 5) as g from g where frame <= 23""")
def generator_signal(spark: SparkSession, d: str) -> DataFrame:
    _, frames = _complete(spark, d)
    kernel = frames.where("frame < 4").select(F.col("frame").alias("lag")).distinct()
    kernel = kernel.select(F.lit(0).alias("cell_id"), "lag", F.transform(F.sequence(F.lit(0), F.lit(4)), lambda p: (F.col("lag") + 1) * 0.1 + p * 0.01).alias("pixels"))
    hours = frames.select("epoch_id", "frame", "pixels")
    return X.generator_signal(kernel, hours, 4).select("epoch_id", "frame", F.round("g", 5).alias("g"))


@query("select event_type as kind, user_id % 3 as color, round(sum((case when user_id % 3 = 2 and event_type = 'view' then 0 else 1 end) * value) / nullif(sum(case when user_id % 3 = 2 and event_type = 'view' then 0 else 1 end), 0), 6) as value from events where not (user_id % 3 = 2 and event_type = 'view') group by all")
def channel_averages(spark: SparkSession, d: str) -> DataFrame:
    rows = spikes(spark, d).select(F.col("channel").alias("cell_id"), F.lit(0).alias("lag"), (F.col("cell_id") % 3).alias("color"), F.lit(1).alias("n"), F.col("amplitude").alias("v"), (F.col("channel") == "view").cast("int").alias("kind"))
    return X.channel_averages(rows, 3, 1).where("value is not null").select(F.col("cell_id").alias("kind"), "color", r6("value").alias("value"))


# ---- receptive fields: lags and pixels of an image are its samples and electrodes

_LONG = with_sql("waveforms") + ", sta as (select cell_id, electrode as pix, unnest(range(8)) as lag, unnest(wave) as value from waveforms)"


def _sta(spark: SparkSession, d: str) -> DataFrame:
    return waveforms(spark, d).select("cell_id", F.col("electrode").alias("pix"), F.posexplode("wave").alias("lag", "value"))


_SIGN = ", v as (select cell_id, pix, var_pop(case when lag < 4 then value end) as a, var_pop(case when lag >= 4 then value end) as b from sta group by all), base as (select cell_id, avg(b) as m, stddev_pop(b) as s from v group by all), sig as (select cell_id, pix, (a - m) / s as z from v join base using (cell_id) where (a - m) / s >= 1)"
_TC = ", t as (select cell_id, lag, sum(value) as tc from sta semi join sig using (cell_id, pix) group by all), tc as (select cell_id, lag, tc / sqrt(sum(tc * tc) over (partition by cell_id)) as tc from t)"


@query(_LONG + _SIGN + " select cell_id, pix, round(z, 5) as z from sig")
def significant_pixels(spark: SparkSession, d: str) -> DataFrame:
    return R.significant_pixels(_sta(spark, d), 8, 1.0).select("cell_id", "pix", F.round("z", 5).alias("z"))


@query(_LONG + _SIGN + _TC + " select cell_id, lag::int as lag, round(tc, 5) as tc from tc")
def time_course(spark: SparkSession, d: str) -> DataFrame:
    s = _sta(spark, d)
    return R.time_course(s, R.significant_pixels(s, 8, 1.0)).select("cell_id", "lag", F.round("tc", 5).alias("tc"))


@query(_LONG + _SIGN + _TC + " select cell_id, pix, round(sum(value * tc), 5) as value from sta join tc using (cell_id, lag) group by all")
def spatial_map(spark: SparkSession, d: str) -> DataFrame:
    s = _sta(spark, d)
    return R.spatial_map(s, R.time_course(s, R.significant_pixels(s, 8, 1.0))).select("cell_id", "pix", F.round("value", 5).alias("value"))


@query(_LONG + " select cell_id, pix, lag::int as lag, round(value / max(abs(value)) over (partition by cell_id), 6) as unit from sta")
def unit_peak(spark: SparkSession, d: str) -> DataFrame:
    return S.unit_peak(_sta(spark, d), ["cell_id"], "value").select("cell_id", "pix", "lag", r6("unit").alias("unit"))


@query(_LONG + " select cell_id, pix, lag::int as lag, round(value - avg(value) over (partition by cell_id, pix), 5) as value from sta")
def without_slow(spark: SparkSession, d: str) -> DataFrame:
    """Only the zero frequency lies under the cutoff here, so the mean goes."""
    s = _sta(spark, d).withColumn("cell_id", F.col("cell_id").cast("bigint"))
    return R.without_slow(s, 8.0, 0.5).select("cell_id", "pix", "lag", F.round("value", 5).alias("value"))


@query()
def separable(spark: SparkSession, d: str) -> DataFrame:
    return R.separable(_sta(spark, d)).select("cell_id", F.size("time").alias("n_time"), F.size("space").alias("n_space"), F.round("r", 4).alias("r"))


@query()
def chi2_pixels(spark: SparkSession, d: str) -> DataFrame:
    return R.chi2_pixels(_sta(spark, d), [0, 1, 2], [4, 5, 6, 7], 0.5).withColumn("p", r6("p"))


@query()
def field_shapes(spark: SparkSession, d: str) -> DataFrame:
    maps = vectors(spark, d).select("cell_id", F.posexplode("v").alias("pix", "value"))
    return R.field_size(R.field_shape(maps, 8), 2.0, 3.8).select("cell_id", *(F.round(c, 5).alias(c) for c in ("threshold", "area", "x", "y", "sx", "sy", "size")))


_EI = with_sql("waveforms") + ", ei as (select cell_id, electrode, (electrode % 4) * 60.0 as x, (electrode // 4) * 60.0 as y, list_max(list_transform(wave, lambda a: abs(a))) as amplitude, list_position(list_transform(wave, lambda a: abs(a)), list_max(list_transform(wave, lambda a: abs(a)))) - 1 as delay from waveforms), soma as (select cell_id, arg_max(x, amplitude) as sx, arg_max(y, amplitude) as sy, arg_max(delay, amplitude) as sd from ei group by all)"


def _ei(spark: SparkSession, d: str) -> DataFrame:
    w = waveforms(spark, d).withColumn("a", F.transform("wave", lambda x: F.abs(x)))
    return w.select("cell_id", "electrode", (F.col("electrode") % 4 * 60.0).alias("x"), (F.floor(F.col("electrode") / 4) * 60.0).alias("y"), F.array_max("a").alias("amplitude"), (F.array_position("a", F.array_max("a")) - 1).alias("delay"))


@query(_EI + " select cell_id, case when count(distinct delay) > 1 then round(regr_slope(sqrt((x - sx) ** 2 + (y - sy) ** 2), delay - sd), 5) else 0 end as speed, count(*) as n from ei join soma using (cell_id) where delay > sd and amplitude >= 0.1 group by cell_id")
def axon_speed(spark: SparkSession, d: str) -> DataFrame:
    return R.axon_speed(_ei(spark, d), 0.1).select("cell_id", F.coalesce(F.round(F.nanvl("speed", F.lit(0.0)), 5), F.lit(0.0)).alias("speed"), "n")


@query(_EI + ", p as (select a.cell_id, a.amplitude + b.amplitude as w, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) / abs(a.delay - b.delay) as v, row_number() over (partition by a.cell_id order by a.amplitude + b.amplitude desc, a.electrode, b.electrode) as r from ei a join ei b on a.cell_id = b.cell_id and a.electrode < b.electrode and abs(a.delay - b.delay) > 1) select cell_id, round(sum(w * v) / sum(w), 5) as velocity from p where r <= 10 group by cell_id")
def conduction_velocity(spark: SparkSession, d: str) -> DataFrame:
    return R.conduction_velocity(_ei(spark, d)).select("cell_id", F.round("velocity", 5).alias("velocity"))


@query(_EI + """, f as (select cell_id, floor(((degrees(atan2(y - sy, x - sx)) + 360) % 360) / 12)::bigint as s, avg(amplitude) as a from ei join soma using (cell_id) where sqrt((x - sx) ** 2 + (y - sy) ** 2) > 70 group by all), p as (select cell_id, arg_max(s, a) as p from f group by all)
select cell_id, (s - p + 30) % 30 as sector, round(a, 6) as amplitude from f join p using (cell_id)""")
def direction_profile(spark: SparkSession, d: str) -> DataFrame:
    return R.direction_profile(_ei(spark, d), 30, 70.0).withColumn("amplitude", r6("amplitude"))


# ---- cell types


@query(_LONG + ", n as (select vec_id as cell_id, vec_id % 13 * 40 as n, vec_id % 17 / 60.0 as refractory, vec_id % 7 / 1.5 as snr, label * 12 as cluster from embeddings) select cell_id, case when snr < 2 then 'All/good/lowSNR' when refractory > 0.2 or n < 300 then 'All/Crap' when cluster + 1 < 100 then 'All/good/RGC/nc' || (cluster + 1) else 'All/good/Amacrine/nc' || (cluster + 1) end as class from n")
def quality_classes(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("cell_id")
    cells = vectors(spark, d).select("cell_id", (i % 13 * 40).alias("n"), (i % 17 / 60.0).alias("refractory"), (i % 7 / 1.5).alias("snr"), (F.col("class") * 12).alias("cluster"))
    return C.class_names(C.quality_flags(cells)).select("cell_id", "class")


@query()
def cell_types(spark: SparkSession, d: str) -> DataFrame:
    """Principal components, polarity, elbow and k-means of all cells."""
    pcs, _ = C.principal_components(vectors(spark, d), 0.5)
    k, _ = C.elbow(pcs, 6)
    return C.clustered(C.polarity(pcs), max(2, k)).select("cell_id", "polarity", "cluster")


@query()
def class_separation(spark: SparkSession, d: str) -> DataFrame:
    cells = vectors(spark, d).select("cell_id", F.concat(F.lit("c"), F.col("class").cast("string")).alias("class"), *(F.get("v", F.lit(i)).alias(f"f{i}") for i in range(4)))
    return C.class_separation(cells, [f"f{i}" for i in range(4)]).withColumn("separation", F.round("separation", 5))


# ---- mixtures: snippets are waves, electrodes their places


def _snippets(spark: SparkSession, d: str) -> DataFrame:
    return waveforms(spark, d).select("cell_id", "electrode", F.col("wave").alias("v"))


@query(with_sql("waveforms") + ", l as (select cell_id, electrode, unnest(range(8)) as i, unnest(wave) as v from waveforms) select a.electrode, a.i::int as i, b.i::int as j, round(covar_samp(a.v, b.v), 6) as cov from l a join l b using (cell_id, electrode) group by all")
def covariances(spark: SparkSession, d: str) -> DataFrame:
    return C.covariances(_snippets(spark, d)).select("electrode", "i", "j", r6("cov").alias("cov"))


@query()
def spike_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Whitened covariance, components, projections, mixtures and assignment, end to end."""
    s = _snippets(spark, d)
    noise = C.covariances(s.withColumn("v", F.transform("v", lambda x: x * 0.5)))
    basis = C.eigenvectors(C.whitened(C.covariances(s), noise), 3)
    points = C.projected(s, basis)
    return C.assigned(points, C.fitted_mixtures(points, bins=6, most=3)).select("cell_id", "electrode", "cluster")


@query()
def bimodal_units(spark: SparkSession, d: str) -> DataFrame:
    rows = spikes(spark, d).select("channel", F.array("amplitude", (F.pmod("t_us", F.lit(DAY_US)) / H).alias("h")).alias("p"))
    return Q.bimodal(rows, "channel", 100).withColumn("score", r6("score"))


@query("with recursive " + with_sql("spikes").removeprefix("with ") + """, l as materialized (select channel, list(amplitude::double) as xs from spikes group by channel),
r as (select channel, 0 as passes, 0.0::double as mean, 1e300::double as sd, 1e301::double as last, 0::bigint as n, 0.0::double as s, 0.0::double as q from l
      union all select channel, passes + 1, s2 / n2, sqrt(greatest((q2 - s2 * s2 / n2) / (n2 - 1), 0)), sd, n2, s2, q2
      from (select r.*, list_filter(xs, lambda x: abs(x - r.mean) < 3 * r.sd) as inside from r join l using (channel) where abs(r.sd - r.last) > 0.01),
           lateral (select n + len(inside) as n2, s + list_sum(inside) as s2, q + list_sum(list_transform(inside, lambda x: x * x)) as q2))
select channel, round(arg_max(sd, passes), 6) as sigma, max(passes) as passes from r group by channel""")
def clipped_sigma(spark: SparkSession, d: str) -> DataFrame:
    return Q.clipped_sigma(spikes(spark, d), "channel", "amplitude").withColumn("sigma", r6("sigma"))


@query()
def noise_events(spark: SparkSession, d: str) -> DataFrame:
    return C.noise_events(spikes(spark, d).select("cell_id", "t_us"), ["cell_id"], 30 * DAY_US, 20, 3 * H).select("cell_id", "t_us")


def _trace(spark: SparkSession, d: str, size: int) -> DataFrame:
    """Traces in chunks of ``size`` samples: one per channel, in event order."""
    rows = O.ranked(spikes(spark, d), ["channel"], ["event_id"], "k").select("channel", "amplitude", (F.col("k") - 1).alias("k"))
    held = F.transform(F.array_sort(F.collect_list(F.struct("k", "amplitude"))), lambda x: x["amplitude"])
    return rows.groupBy("channel", floor_div("k", size).alias("chunk")).agg(held.alias("data"))


_TRACE = "recursive " + with_sql("spikes").removeprefix("with ") + ", t as materialized (select channel, amplitude as x, row_number() over (partition by channel order by event_id) - 1 as k from spikes)"


@query(f"""with {_TRACE},
s as (select channel, avg(-x) as mean from t where k < 50 group by channel),
m as (select channel, -1::bigint as k, mean, 0.0::double as amp from s
      union all select m.channel, t.k, m.mean + 0.05 * (-t.x - m.mean), m.mean + 0.05 * (-t.x - m.mean) + t.x from m join t on t.channel = m.channel and t.k = m.k + 1),
o as (select channel, k, amp, k - row_number() over (partition by channel order by k) as run from m where k >= 0 and amp > 30),
r as (select channel, run, min(k) as a, max(k) + 1 as e, arg_max(k, (amp, -k)) as peak, max(amp) as amp from o group by channel, run),
p as (select *, coalesce(lag(peak) over (partition by channel order by a), -1000) as before from r where e <= (select max(k) from t where t.channel = r.channel))
select channel, peak as t, round(amp, 6) as amplitude from p where peak - before > 2 and e - a <= 3""")
def detected_spikes(spark: SparkSession, d: str) -> DataFrame:
    """Negative peaks against an exponential mean, in chunked traces."""
    chunks = _trace(spark, d, 200).withColumn("data", F.transform("data", lambda x: -x))
    return V.detected_spikes(chunks, ["channel"], 0.05, 30.0, 2, 3, 50).withColumn("amplitude", r6("amplitude"))


_B, _A = V.butterworth(2, 0.05, 1.0)


@query(f"""with {_TRACE},
f as (select channel, -1::bigint as k, 0.0::double as x1, 0.0::double as x2, 0.0::double as y, 0.0::double as y2 from t group by channel
      union all select f.channel, t.k, t.x, f.x1, {_B[0]} * t.x + {_B[1]} * f.x1 + {_B[2]} * f.x2 - ({_A[1]}) * f.y - ({_A[2]}) * f.y2, f.y from f join t on t.channel = f.channel and t.k = f.k + 1)
select channel, k // 100 as chunk, round(sum(y), 5) as total, round(max(y), 5) as top from f where k >= 0 group by all""")
def low_passed(spark: SparkSession, d: str) -> DataFrame:
    """Sum and largest sample, a chunk, of traces behind a recursive low-pass that starts at rest."""
    out = V.filtered(_trace(spark, d, 100), ["channel"], _B, _A)
    return out.select("channel", "chunk", F.round(F.aggregate("data", F.lit(0.0), lambda s, x: s + x), 5).alias("total"), F.round(F.array_max("data"), 5).alias("top"))


_TAPS = V.windowed_sinc(100, 0.1, 1.0, high=True)


@query(with_sql("spikes") + f""", t as (select channel, amplitude as x, row_number() over (partition by channel order by event_id) - 1 as k from spikes),
l as (select channel, list(x order by k) as xs from t group by channel)
select channel, k // 100 as chunk, round(sum(y), 5) as total, round(max(y), 5) as top
from (select channel, k, list_sum(list_transform(range(least(k, 100) + 1), lambda j: ({_TAPS})[j + 1] * xs[k - j + 1])) as y from t join l using (channel)) group by all""")
def high_passed(spark: SparkSession, d: str) -> DataFrame:
    """Sum and largest sample, a chunk, of traces behind a high-pass of order 100 designed from its cutoff."""
    out = O.fir_filtered(_trace(spark, d, 100), ["channel"], _TAPS)
    return out.select("channel", "chunk", F.round(F.aggregate("data", F.lit(0.0), lambda s, x: s + x), 5).alias("total"), F.round(F.array_max("data"), 5).alias("top"))


@query()
def zero_phase(spark: SparkSession, d: str) -> DataFrame:
    """The same low-pass run forwards and backwards; tests hold it against one pass over the whole trace."""
    out = V.zero_phase(_trace(spark, d, 100), ["channel"], _B, _A)
    return out.select("channel", "chunk", F.round(F.aggregate("data", F.lit(0.0), lambda s, x: s + x), 5).alias("total"), F.round(F.array_max("data"), 5).alias("top"))


_HEX = with_sql("waveforms").removeprefix("with ") + """, el as (select e as electrode, e % 4 + 0.5 * (e // 4) as x, e // 4 * sqrt(0.75) as y from range(8) t(e)),
st as (select * from (values (0, 0.0, 0.0), (1, -1.0, 0.0), (2, 1.0, 0.0), (3, 0.5, sqrt(0.75)), (4, 0.5, -sqrt(0.75)), (5, -0.5, sqrt(0.75)), (6, -0.5, -sqrt(0.75))) v(shift, dx, dy)),
sh as (select shift, a.electrode, arg_min(b.electrode, (a.x - b.x - dx) ** 2 + (a.y - b.y - dy) ** 2) as moved from el a, el b, st where sqrt((a.x - b.x - dx) ** 2 + (a.y - b.y - dy) ** 2) < 1.0 / 6 group by all)"""


def _hexagons(spark: SparkSession) -> DataFrame:
    e = F.col("electrode")
    row = F.floor(e / 4)
    return spark.range(8).select(F.col("id").cast("int").alias("electrode")).select("electrode", (e % 4 + row * 0.5).alias("x"), (row * 0.75**0.5).alias("y"))


@query("with " + _HEX + """, p as (select w.cell_id, sh.shift, flatten(list(w.wave order by sh.electrode)) as v from waveforms w join sh on sh.electrode = w.electrode where w.class < 5 group by all),
q as (select w.cell_id, sh.shift, flatten(list(w.wave order by sh.electrode)) as v from waveforms w join sh on sh.moved = w.electrode where w.class >= 5 group by all),
pc as (select cell_id, shift, list_transform(v, lambda z: z - list_avg(v)) as v from p), qc as (select cell_id, shift, list_transform(v, lambda z: z - list_avg(v)) as v from q),
pu as materialized (select cell_id, shift, list_transform(v, lambda z: z / sqrt(list_inner_product(v, v))) as v from pc), qu as materialized (select cell_id, shift, list_transform(v, lambda z: z / sqrt(list_inner_product(v, v))) as v from qc),
r as (select pu.cell_id as a, qu.cell_id as b, shift, list_inner_product(pu.v, qu.v) as r from pu join qu using (shift))
select a, b, round(max(r), 6) as r, arg_max(shift, (r, -shift)) as shift from r where r >= 0.45 group by all""")
def hexagonal_matches(spark: SparkSession, d: str) -> DataFrame:
    """Cells of one set of classes and of another, by the largest image correlation over seven positions of the array."""
    w = waveforms(spark, d)
    one, two = w.where("class < 5"), w.where("class >= 5")
    return E.shifted_correlation(one, two, _hexagons(spark), 0.45).withColumn("r", r6("r"))


@query(_LONG + _SIGN + """, e as (select cell_id, 1.5 + 4 * v[1] as x0, 0.5 + 2 * v[2] as y0, 0.8 + 4 * abs(v[3]) as a, 0.4 + 3 * abs(v[4]) as b, 8 * v[5] as alpha from (select vec_id as cell_id, embedding::double[] as v from embeddings)),
p as (select sig.cell_id, pix, ((pix % 4 - x0) * cos(alpha) + (pix // 4 - y0) * sin(alpha)) / a as u, ((pix // 4 - y0) * cos(alpha) - (pix % 4 - x0) * sin(alpha)) / b as w from sig join e using (cell_id)),
i as (select cell_id, pix from p where u * u + w * w <= 1)
select cell_id, pix from i union all select cell_id, pix from sig where cell_id not in (select cell_id from i)""")
def pixels_of_fields(spark: SparkSession, d: str) -> DataFrame:
    """Significant pixels inside each cell's ellipse."""
    pixels = R.significant_pixels(_sta(spark, d), 8, 1.0).select("cell_id", "pix", (F.col("pix") % 4).alias("x"), F.floor(F.col("pix") / 4).alias("y"))
    part = lambda i: F.get("v", F.lit(i))
    ellipses = vectors(spark, d).select(
        "cell_id", (1.5 + 4 * part(0)).alias("x0"), (0.5 + 2 * part(1)).alias("y0"), (0.8 + 4 * F.abs(part(2))).alias("a"), (0.4 + 3 * F.abs(part(3))).alias("b"), (8 * part(4)).alias("alpha")
    )
    return E.pixels_of_fields(pixels, ellipses, 2.0)


@query(with_sql("spikes") + """, c as (select cell_id, t_us // 86400000000 as epoch, t_us // 86400000000 % 3 as contrast, t_us % 86400000000 // 10800000000 as bin, count(*) as n from spikes group by all),
s as (select cell_id, contrast, epoch, sum(n * cos(bin * 2 * pi() / 8)) as re, sum(n * sin(bin * 2 * pi() / 8)) as im from c group by all)
select cell_id, contrast, round(sqrt(avg(re) ** 2 + avg(im) ** 2) * 0.25, 6) as f1 from s group by all""")
def online_harmonics(spark: SparkSession, d: str) -> DataFrame:
    """First harmonics over finished epochs, as the stream gives them once all epochs are over."""
    s = spikes(spark, d)
    epoch = floor_div("t_us", DAY_US)
    counts = s.groupBy("cell_id", epoch.alias("epoch"), (epoch % 3).alias("contrast"), floor_div(F.pmod("t_us", F.lit(DAY_US)), 3 * H).alias("bin")).agg(F.count("*").alias("n"))
    angle = F.col("bin") * (2 * np.pi / 8)
    closed = counts.groupBy("cell_id", "contrast", "epoch").agg(F.sum(F.col("n") * F.cos(angle)).alias("re"), F.sum(F.col("n") * F.sin(angle)).alias("im"))
    return live.contrast_f1(closed, 8).withColumn("f1", r6("f1"))


# ---- live windows over the whole table (their batch twins; tests run them as streams)


def _live(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("electrode"), F.col("value").alias("amplitude"), "event_id")


def _start(c: str = "start"):
    return F.col(c).cast("timestamp_ntz").alias("start")


@query("select time_bucket(interval '6 hours', ts) as start, event_type as electrode, count(*) as n, max(value) as max_amplitude from events group by all")
def window_counts(spark: SparkSession, d: str) -> DataFrame:
    return live.window_counts(_live(spark, d), "6 hours").select(_start(), "electrode", "n", "max_amplitude")


@query("""with e as (select time_bucket(interval '6 hours', ts) as start, event_type, count(*) as n, avg(value) as m from events group by all)
select start, round(sum(n) / (21600.0 * 5), 9) as rate, round(sum(m) / 5, 6) as mean_amplitude from e group by start""")
def window_rates(spark: SparkSession, d: str) -> DataFrame:
    return live.window_rates(_live(spark, d), "6 hours", 21600.0, 5).select(_start(), F.round("rate", 9).alias("rate"), r6("mean_amplitude").alias("mean_amplitude"))


@query("select time_bucket(interval '1 day', ts) as start, event_type as electrode, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as sigma from events group by all")
def window_levels(spark: SparkSession, d: str) -> DataFrame:
    return live.window_levels(_live(spark, d), "1 day").select(_start(), "electrode", r6("mean").alias("mean"), r6("sigma").alias("sigma"))


@query("with s as (select ts, event_id, case when ts - lag(ts) over (order by ts, event_id) >= interval '40 minutes' then 1 else 0 end as g from events where event_type = 'signup'), r as (select *, sum(g) over (order by ts, event_id) as k from s) select min(ts) as start, max(ts) as last, count(*) as n from r group by k")
def trigger_sessions(spark: SparkSession, d: str) -> DataFrame:
    rows = live.trigger_sessions(_live(spark, d).where("electrode = 'signup'"), "40 minutes")
    return rows.select(_start(), F.col("end").cast("timestamp_ntz").alias("last"), "n")


@query("select time_bucket(interval '1 hour', ts) as start, count(*) as n, arg_min(event_id, ts) as first_id, arg_max(event_id, ts) as last_id from events group by all")
def ordered_release(spark: SparkSession, d: str) -> DataFrame:
    rows = live.ordered_release(_live(spark, d).withColumn("electrode", F.col("event_id")), "3 milliseconds", "1 hour")
    return rows.select(_start(), F.size("spikes").cast("bigint").alias("n"), F.get("spikes", F.lit(0))["electrode"].alias("first_id"), F.element_at("spikes", -1)["electrode"].alias("last_id"))


# ---- a registry of calculators over the per-cell table

CALCULATORS = S.Calculators()


@CALCULATORS.register("rate")
def _rate(cells: DataFrame):
    return {"": F.round(F.col("n") / 30.0, 6)}


@CALCULATORS.register("amplitude")
def _amplitude(cells: DataFrame):
    return {"mean": r6(F.col("s") / F.col("n")), "large": F.col("top") > 200}


@query("select user_id as cell_id, round(count(*) / 30.0, 6) as rate, round(sum(value) / count(*), 6) as amplitude_mean, max(value) > 200 as amplitude_large from events group by all")
def calculated_columns(spark: SparkSession, d: str) -> DataFrame:
    cells = spikes(spark, d).groupBy("cell_id").agg(F.count("*").alias("n"), F.sum("amplitude").alias("s"), F.max("amplitude").alias("top"))
    return CALCULATORS.run(cells).drop("n", "s", "top")


@query()
def noise_replay(spark: SparkSession, d: str) -> DataFrame:
    """Replayed noise of each day's seed, averaged before the spikes of each channel."""
    counts, _ = _frames(spark, d)
    days = counts.groupBy("epoch_id").agg(F.sum("n").cast("int").alias("seed")).withColumn("n_frames", F.lit(24))
    return X.triggered_average(counts, X.noise_frames(days, 16), 3).withColumn("value", r6("value"))


@query(with_sql("spikes") + """, g as (select cell_id, t_us, row_number() over (partition by cell_id order by t_us) - 1 as frame from spikes where channel = 'signup'), e as (select *, lead(t_us) over (partition by cell_id order by frame) as nx from g),
n as (select e.cell_id, e.frame * 2 + least(floor((s.t_us - e.t_us) * 2.0 / (nx - e.t_us)), 1)::bigint as frame, count(*) as n from e join spikes s on s.cell_id = e.cell_id and s.t_us >= e.t_us and (s.t_us < nx or (e.frame = 4 and s.t_us = nx)) where nx is not null and e.frame < 5 group by all)
select c.cell_id, f as frame, coalesce(n, 0) as n from (select distinct cell_id from spikes) c cross join range(10) t(f) left join n on n.cell_id = c.cell_id and n.frame = f""")
def frame_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts between triggers as frames, two parts each, the first five."""
    s = spikes(spark, d)
    frames = O.ranked(s.where("channel = 'signup'").select("cell_id", "t_us"), ["cell_id"], ["t_us"], "frame").withColumn("frame", F.col("frame") - 1)
    return A.frame_counts(s.select("cell_id", "t_us"), frames, ["cell_id"], [], 5, 2)


@query(_UNIT + """, p as (select a.cell_id as a, b.cell_id as b, list_inner_product(a.v, b.v) as r, 1 - abs(a.class - b.class) / 10.0 as k from u a, u b where a.cell_id % 2 = 0 and b.cell_id % 2 = 1 and list_inner_product(a.v, b.v) >= 0.2),
q as (select *, (3 * r + k) / 4 as score from p) select a, arg_max(b, score) as b, round(max(score), 6) as score from q group by a""")
def best_matches(spark: SparkSession, d: str) -> DataFrame:
    """Best match by a weighted mean of two measures."""
    v = vectors(spark, d)
    pairs = J.correlated_pairs(v.where("cell_id % 2 = 0"), 0.2, right=v.where("cell_id % 2 = 1"))
    pairs = pairs.join(v.select(F.col("cell_id").alias("a"), F.col("class").alias("ca")), "a").join(v.select(F.col("cell_id").alias("b"), F.col("class").alias("cb")), "b")
    found = A.best_matches(pairs.withColumn("k", 1 - F.abs(F.col("ca") - F.col("cb")) / 10.0), {"r": 3.0, "k": 1.0})
    return found.withColumn("score", r6("score"))


@query("select p_partkey, p_type || '-' || p_size as label, 'data' || lpad((p_partkey % 1000)::varchar, 3, '0') as file from part")
def renamed_files(spark: SparkSession, d: str) -> DataFrame:
    """Labels without their UUID, data files by their number."""
    p = table(spark, d, "part").withColumn("l", F.concat_ws("-", "p_type", F.col("p_size").cast("string"), F.lit("0a1b-22-33-44-55ff")))
    p = p.withColumn("f", F.concat(F.lit("/raw/d12/rec"), (F.col("p_partkey") % 1000).cast("string"), F.lit(".bin")))
    return p.select("p_partkey", S.without_uuid("l").alias("label"), S.data_file_name("f").alias("file"))


@query("select user_id + 1 as cell_id, count(*) as n from events where user_id in (select vec_id from embeddings where label < 5) group by all")
def good_cells(spark: SparkSession, d: str) -> DataFrame:
    labels = vectors(spark, d).select(F.col("cell_id").alias("cluster_id"), F.when(F.col("class") < 5, "good").otherwise("mua").alias("label"))
    return S.good_cells(spikes(spark, d).withColumnRenamed("cell_id", "cluster_id"), labels).groupBy("cell_id").agg(F.count("*").alias("n"))


@query(with_sql("spikes") + ", i as (select channel, abs(amplitude - lag(amplitude) over (partition by channel order by t_us)) as step from spikes) select channel, round(sum(step), 4) as total from i group by channel")
def listener_totals(spark: SparkSession, d: str) -> DataFrame:
    """A user aggregate over each channel's ordered events: the sum of absolute steps, by days and then in all."""
    s = spikes(spark, d).withColumn("day", floor_div("t_us", DAY_US))
    walk = ordered_aggregate(lambda t, x: np.abs(np.diff(x)).sum())
    ends = s.groupBy("channel", "day").agg(F.min_by("amplitude", "t_us").alias("a"), F.max_by("amplitude", "t_us").alias("z"))
    gap = F.abs(F.col("a") - F.lag("z").over(Window.partitionBy("channel").orderBy("day")))
    between = ends.withColumn("gap", gap).groupBy("channel").agg(F.sum("gap").alias("gap"))
    inside = s.groupBy("channel", "day").agg(walk("t_us", "amplitude").alias("x")).groupBy("channel").agg(F.sum("x").alias("x"))
    return inside.join(between, "channel").select("channel", F.round(F.col("x") + F.coalesce("gap", F.lit(0.0)), 4).alias("total"))


@query(_UNIT + " select a.cell_id, round(list_inner_product(a.v, b.v), 6) as r from u a join u b on b.cell_id = a.cell_id + 1")
def neighbour_correlation(spark: SparkSession, d: str) -> DataFrame:
    """Correlation of consecutive cells' vectors by the vectorised pair function."""
    v = vectors(spark, d).select("cell_id", "v")
    after = v.select((F.col("cell_id") - 1).alias("cell_id"), F.col("v").alias("w"))
    return v.join(after, "cell_id").select("cell_id", r6(array_correlation("v", "w")).alias("r"))


@query(with_sql("spikes") + """, n as (select cell_id, t_us % 86400000000 // 10800000000 as k, count(*) as n from spikes group by all),
s as (select cell_id, sum(n) as w, sum(n * cos(radians(45 * k))) as c, sum(n * sin(radians(45 * k))) as s, sum(n * cos(radians(90 * k))) as c2, sum(n * sin(radians(90 * k))) as s2 from n group by cell_id)
select cell_id, round(sqrt(c * c + s * s) / w, 6) as ds, round(sqrt(c2 * c2 + s2 * s2) / w, 6) as os from s""")
def direction_harmonics(spark: SparkSession, d: str) -> DataFrame:
    """Direction and orientation vectors as harmonics 1 and 2 over 0 of eight direction bins."""
    s = spikes(spark, d)
    bins = s.groupBy("cell_id", floor_div(F.pmod("t_us", F.lit(DAY_US)), 3 * H).alias("bin")).agg(F.count("*").alias("n"))
    h = A.harmonics(bins, ["cell_id"], 8, [1, 2], "n")
    return h.select("cell_id", r6(F.col("f1") / 2 / F.col("mean")).alias("ds"), r6(F.col("f2") / 2 / F.col("mean")).alias("os"))
