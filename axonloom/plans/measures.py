"""Queries: masked and filtered similarities, colours, leaders, aligned parameters, ordered trees, paired marks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axonloom.functions import scalars as S
from axonloom.operators import aggregates as A
from axonloom.operators import clustering as C
from axonloom.operators import fields as R
from axonloom.operators import joins as J
from axonloom.operators import ordered as O
from axonloom.plans.registry import query
from axonloom.plans.responses import r6
from axonloom.streaming import live
from axonloom.tables import DAY_US, HOUR_US, floor_div, spikes, table, vectors, waveforms, with_sql

H = HOUR_US
_WAVES = with_sql("waveforms")


@query(_WAVES + """, e as (select cell_id, electrode, class, list_sum(list_transform(wave, lambda x: x * x)) as p, wave from waveforms), r as (select *, row_number() over (partition by cell_id order by p desc, electrode) as k from e),
l as (select cell_id, class, electrode, k, unnest(range(8)) as i, unnest(wave) as x from r), m as (select class, electrode, i, avg(x) as y from l group by all)
select cell_id, round(sum(x * y) / sqrt(sum(x * x) * sum(y * y)), 6) as c from l join m using (class, electrode, i) where k > 2 group by cell_id""")
def masked_cosine(spark: SparkSession, d: str) -> DataFrame:
    """Cosine of each image with its class mean, without the cell's two strongest electrodes."""
    w = waveforms(spark, d)
    long = w.select("cell_id", "class", "electrode", F.posexplode("wave").alias("i", "x"))
    rows = long.join(long.groupBy("class", "electrode", "i").agg(F.avg("x").alias("y")), ["class", "electrode", "i"])
    power = w.select("cell_id", "electrode", (-A.array_energy("wave", mean=False)).alias("np"))
    top = O.ranked(power, ["cell_id"], ["np", "electrode"], "k").where("k <= 2").select("cell_id", "electrode")
    return A.cosine(rows.join(top, ["cell_id", "electrode"], "left_anti"), ["cell_id"], "x", "y").withColumn("c", r6("c"))


@query(_WAVES + """, l as (select electrode, unnest(wave) as x from waveforms), n as (select electrode, stddev_samp(x) as noise from l group by electrode)
select cell_id, count(*) as electrodes, round(sum(list_sum(list_transform(wave, lambda x: x * x))), 6) as power from waveforms join n using (electrode) where abs(list_min(wave)) > 1.8 * noise group by cell_id""")
def loud_power(spark: SparkSession, d: str) -> DataFrame:
    """Power of each image over the electrodes whose trough exceeds a multiple of the electrode's noise."""
    w = waveforms(spark, d)
    noise = w.select("electrode", F.explode("wave").alias("x")).groupBy("electrode").agg(F.stddev_samp("x").alias("noise"))
    return A.loud(w, noise, 1.8).groupBy("cell_id").agg(F.count("*").alias("electrodes"), r6(F.sum(A.array_energy("wave", mean=False))).alias("power"))


@query(_WAVES + """, l as (select class, electrode, unnest(range(8)) as lag, unnest(wave) as x, cell_id % 7 + 1 as n from waveforms), m as (select class, electrode, lag, sum(n * x) / sum(n) as x from l group by all)
select class as unit, electrode as pix, lag::int as lag, round(x / max(abs(x)) over (partition by class), 6) as value from m""")
def merged_averages(spark: SparkSession, d: str) -> DataFrame:
    """Averages of merged cells (a class each), weighted by spikes, over their largest magnitude."""
    long = waveforms(spark, d).select(F.col("class").alias("unit"), F.col("electrode").alias("pix"), F.posexplode("wave").alias("lag", "value"), (F.col("cell_id") % 7 + 1).alias("n"))
    merged = A.weighted_merge(long, ["unit", "pix", "lag"], "value", "n").drop("n")
    return A.peak_scaled(merged, ["unit"]).withColumn("value", r6("value"))


@query(with_sql("spikes") + """, c as (select cell_id, t_us // 86400000000 as epoch, t_us // 86400000000 % 3 as contrast, t_us % 86400000000 // 10800000000 as bin, count(*) as n from spikes group by all),
s as (select cell_id, contrast, epoch, sum(n * cos(bin * 2 * pi() / 8)) as re, sum(n * sin(bin * 2 * pi() / 8)) as im from c group by all), f as (select cell_id, contrast, sqrt(avg(re) ** 2 + avg(im) ** 2) * 0.25 as f1 from s group by all),
m as (select cell_id, row_number() over (order by avg(f1) desc, cell_id) as rank, count(*) over () as k from f group by cell_id)
select share, contrast, round(avg(f1), 6) as f1, count(*) as cells from f join m using (cell_id) cross join (values (0.1), (0.3)) v(share) where rank <= floor(k * share) group by all""")
def leading_harmonics(spark: SparkSession, d: str) -> DataFrame:
    """Mean first harmonic per contrast over the cells that lead by their mean over contrasts."""
    epoch = floor_div("t_us", DAY_US)
    counts = spikes(spark, d).groupBy("cell_id", epoch.alias("epoch"), (epoch % 3).alias("contrast"), floor_div(F.pmod("t_us", F.lit(DAY_US)), 3 * H).alias("bin")).agg(F.count("*").alias("n"))
    angle = F.col("bin") * (2 * np.pi / 8)
    f1 = live.contrast_f1(counts.groupBy("cell_id", "contrast", "epoch").agg(F.sum(F.col("n") * F.cos(angle)).alias("re"), F.sum(F.col("n") * F.sin(angle)).alias("im")), 8)
    mean = f1.groupBy("cell_id").agg(F.avg("f1").alias("m"))
    parts = [f1.join(C.top_share(mean, "m", share).select("cell_id"), "cell_id", "left_semi").withColumn("share", F.lit(share)) for share in (0.1, 0.3)]
    return parts[0].unionByName(parts[1]).groupBy("share", "contrast").agg(r6(F.avg("f1")).alias("f1"), F.count("*").alias("cells"))


@query("""with c as (select distinct user_id as cell_id from events union select vec_id + 100000 from embeddings where vec_id < 20)
select c.cell_id, round(coalesce(embedding[1]::double, 0) * 30, 6) as x0, round(coalesce(embedding[2]::double, 0) * 30, 6) as y0, coalesce(label, 0)::int as kind from c left join embeddings on vec_id = cell_id""")
def aligned_parameters(spark: SparkSession, d: str) -> DataFrame:
    """Field parameters aligned to the cells of a recording: zeros for cells without, lengths scaled."""
    cells = spikes(spark, d).select("cell_id").distinct().unionByName(vectors(spark, d).where("cell_id < 20").select((F.col("cell_id") + 100_000).alias("cell_id")))
    fields = vectors(spark, d).select("cell_id", F.get("v", F.lit(0)).alias("x0"), F.get("v", F.lit(1)).alias("y0"), F.col("class").cast("int").alias("kind"))
    out = J.aligned(cells, fields, ["cell_id"], scale={"x0": 30.0, "y0": 30.0})
    return out.select("cell_id", r6("x0").alias("x0"), r6("y0").alias("y0"), "kind")


@query(_WAVES + """, l as (select cell_id, electrode % 2 as color, electrode // 2 as pix, unnest(range(8)) as lag, unnest(wave) as x from waveforms),
g as (select cell_id, pix, var_pop(x) as s from l group by all), top as (select cell_id, pix from (select *, row_number() over (partition by cell_id order by s desc, pix) as k from g) where k <= 2),
t as (select cell_id, color, lag, sum(x) as tc from l semi join top using (cell_id, pix) group by all), n as (select cell_id, max(l2) as l2 from (select cell_id, color, sqrt(sum(tc * tc)) as l2 from t group by all) group by cell_id)
select cell_id, color, lag::int as lag, round(tc / l2, 6) as tc from t join n using (cell_id)""")
def color_courses(spark: SparkSession, d: str) -> DataFrame:
    """Time courses per colour over a cell's chosen pixels, over the largest norm of its colours."""
    e = F.col("electrode")
    long = waveforms(spark, d).select("cell_id", (e % 2).alias("color"), floor_div("electrode", 2).alias("pix"), F.posexplode("wave").alias("lag", "value"))
    spread = long.groupBy("cell_id", "pix").agg((-F.var_pop("value")).alias("s"))
    top = O.ranked(spread, ["cell_id"], ["s", "pix"], "k").where("k <= 2")
    return R.color_courses(long, top).withColumn("tc", r6("tc"))


@query(_WAVES + """, l as (select cell_id, electrode as pix, unnest(range(8)) as lag, unnest(wave) as x from waveforms)
select cell_id, pix, lag::int as lag, round((x * 0.4 + 0.6 - 0.5) / max(abs(x * 0.4 + 0.6 - 0.5)) over (partition by cell_id) / 2 + 0.5, 6) as value from l""")
def centred_averages(spark: SparkSession, d: str) -> DataFrame:
    """Averages of intensities between 0 and 1, spread about the middle grey so that the largest step reaches 0 or 1."""
    long = waveforms(spark, d).select("cell_id", F.col("electrode").alias("pix"), F.posexplode("wave").alias("lag", "x")).select("cell_id", "pix", "lag", (F.col("x") * 0.4 + 0.6).alias("value"))
    return A.peak_scaled(long, ["cell_id"], middle=0.5).withColumn("value", r6("value"))


@query("""with v as (select user_id as cell_id, value as x, (event_id % 97)::double as y from events)
select cell_id, round(coalesce(degrees(atan(regr_slope(y, x))), 0), 6) as orientation from v group by cell_id""")
def polygon_orientation(spark: SparkSession, d: str) -> DataFrame:
    """Angle of the line fitted to a polygon's vertices."""
    rows = spikes(spark, d).select("cell_id", F.col("amplitude").alias("x"), (F.col("event_id") % 97).cast("double").alias("y"))
    return S.polygon_orientation(rows, "cell_id").withColumn("orientation", r6("orientation"))


@query(with_sql("spikes") + """, r as (select channel, amplitude as x, row_number() over (partition by channel order by event_id) as i from spikes), n as (select channel, i, x, lead(x) over (partition by channel order by i) as nx from r),
e as (select channel, i + 1 as i, 'start' as kind from n where x >= 20 and nx < 20 union all select channel, i + 1, 'end' from n where x < 20 and nx >= 20), o as (select *, lead(i) over (partition by channel order by i) as next_i, lead(kind) over (partition by channel order by i) as next_kind from e)
select channel, i as start, next_i as "end" from o where kind = 'start' and next_kind = 'end'""")
def pulse_epochs(spark: SparkSession, d: str) -> DataFrame:
    """Stretches below a threshold, each from its first sample to the first one after it."""
    rows = O.ranked(spikes(spark, d), ["channel"], ["event_id"], "i").select("channel", "i", F.col("amplitude").alias("x"))
    return O.pulse_epochs(rows, ["channel"], "i", "x", 20.0)


@query("""select o_custkey as grp, string_agg(o_orderkey || ':' || lines, ' ' order by o_orderdate, o_orderkey) as blocks
from (select o_custkey, o_orderkey, o_orderdate, string_agg(l_linenumber::varchar, ',' order by l_shipdate, l_linenumber) as lines from orders join lineitem on l_orderkey = o_orderkey group by all) group by o_custkey""")
def ordered_trees(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of a group, and their epochs, in order of their start times."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate", "l_linenumber")
    epochs = O.in_order(lines, ["o_orderkey"], ["l_shipdate", "l_linenumber"], "epochs")
    blocks = table(spark, d, "orders").join(epochs, "o_orderkey").withColumn("lines", F.array_join(F.transform("epochs", lambda e: e["l_linenumber"].cast("string")), ","))
    out = O.in_order(blocks.select("o_custkey", "o_orderdate", "o_orderkey", "lines"), ["o_custkey"], ["o_orderdate", "o_orderkey", "lines"], "blocks")
    return out.select(F.col("o_custkey").alias("grp"), F.array_join(F.transform("blocks", lambda b: F.concat_ws(":", b["o_orderkey"].cast("string"), b["lines"])), " ").alias("blocks"))


@query("""select o_custkey as grp, o_orderstatus as protocol, count(*) as n, string_agg(o_orderkey::varchar, ' ' order by o_orderkey) as files from orders group by all
union all select o_custkey, null, count(*), null from orders group by o_custkey""")
def file_summary(spark: SparkSession, d: str) -> DataFrame:
    """Sorted files of each group and protocol, with the number of files of the group."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("grp"), F.col("o_orderstatus").alias("protocol"), "o_orderkey")
    each = O.in_order(o, ["grp", "protocol"], ["o_orderkey"], "f")
    each = each.select("grp", "protocol", F.size("f").cast("bigint").alias("n"), F.array_join(F.transform("f", lambda x: x["o_orderkey"].cast("string")), " ").alias("files"))
    totals = o.groupBy("grp").agg(F.count("*").alias("n")).select("grp", F.lit(None).cast("string").alias("protocol"), "n", F.lit(None).cast("string").alias("files"))
    return each.unionByName(totals)


@query(with_sql("spikes") + """, p as (select channel, max(t_us // 86400000000) + 1 as n from spikes group by channel), c as (select channel, t_us % 86400000000 // 10800000000 as bin, count(*) as k from spikes group by all)
select channel, bin, round(k / n, 6) as mean from c join p using (channel)""")
def period_means(spark: SparkSession, d: str) -> DataFrame:
    """Spikes of one period, as the mean over the periods of a channel."""
    return A.period_means(spikes(spark, d), ["channel"], DAY_US, 3 * H).withColumn("mean", r6("mean"))
