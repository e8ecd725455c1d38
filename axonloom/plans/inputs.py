"""Queries over the readers and sinks: Spark writes what the tables give in the outside format to the shared folder, and
the reader under test reads it back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axonloom.operators import ordered as O
from axonloom.plans.registry import query
from axonloom.session import ensure_checkpoint_dir
from axonloom.sources import files, recordings
from axonloom.tables import spikes, table, with_sql


def _folder(spark: SparkSession, name: str) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4()}"


_CHANNELS = ["click", "error", "purchase", "signup"]


@query(with_sql("spikes") + """, r as (select file, row_number() over (partition by file order by event_id) - 1 as i, event_id, channel, amplitude from spikes),
s as (select file, i, e as electrode, case when e = 0 then event_id % 30000 when list_position(['click', 'error', 'purchase', 'signup'], channel) = e then least(floor(amplitude)::int * 10, 2047) else 0 end as x from r cross join range(5) t(e))
select file::varchar as recording, electrode::smallint as electrode, i // 250 as chunk, count(*) as n, sum(x)::bigint as total, max(x)::int as top from s where electrode in (0, 2, 3) group by all""")
def packed_samples(spark: SparkSession, d: str) -> DataFrame:
    """Recordings packed to files of 1,000 samples and read back in byte ranges of two chunks, three of five channels."""
    rows = O.ranked(spikes(spark, d), ["file"], ["event_id"], "k")
    values = [F.when(F.col("channel") == c, F.floor("amplitude").cast("int") * 10).otherwise(0) for c in _CHANNELS]
    samples = rows.select(F.col("file").cast("string").alias("recording"), (F.col("k") - 1).alias("i"), F.array((F.col("event_id") % 30_000).cast("int"), *values).alias("samples"))
    path = _folder(spark, "recordings")
    recordings.write_recordings(samples, path, 5, 1_000, b"head").write.format("noop").mode("overwrite").save()
    got = recordings.read_recordings(spark, path, 5, header=4, chunk=250, split=2 * 250 * recordings.row_bytes(5), electrodes=[0, 2, 3])
    part = F.regexp_extract("file", r"-(\d+)\.bin", 1).cast("bigint")
    long = got.select(F.regexp_extract("file", "^(.*)-", 1).alias("recording"), "electrode", (part * 4 + F.col("chunk")).alias("chunk"), F.explode("data").alias("x"))
    return long.groupBy("recording", "electrode", "chunk").agg(F.count("*").alias("n"), F.sum("x").alias("total"), F.max("x").cast("int").alias("top"))


@query(with_sql("spikes") + """, c as (select file, cell_id, count(*) as n, avg(amplitude) as mean_amplitude, mode(channel) as top, max(amplitude) as largest from spikes group by all),
h as (select file, cell_id, list(n order by channel) as per_channel from (select s.file, s.cell_id, ch as channel, coalesce(k.n, 0)::double as n from (select distinct file, cell_id from spikes) s cross join (values ('click'), ('error'), ('purchase'), ('signup'), ('view')) v(ch)
  left join (select file, cell_id, channel, count(*) as n from spikes group by all) k on k.file = s.file and k.cell_id = s.cell_id and k.channel = ch) group by file, cell_id)
select c.file as experiment, c.cell_id, n, round(mean_amplitude, 6) as mean_amplitude, case when n > 30 then 'busy' end as label, h.per_channel[1] as clicks, list_sum(h.per_channel)::bigint as total from c join h using (file, cell_id)""")
def cell_table(spark: SparkSession, d: str) -> DataFrame:
    """Calculators' long results written as one wide row a cell under a declared schema, twice, and read back."""
    s = spikes(spark, d)
    cells = s.groupBy(F.col("file").alias("experiment"), "cell_id").agg(F.count("*").alias("n"), F.round(F.avg("amplitude"), 6).alias("m"), *(F.count(F.when(F.col("channel") == c, 1)).cast("double").alias(c) for c in [*_CHANNELS, "view"]))
    no_list, no_text = F.lit(None).cast("array<double>"), F.lit(None).cast("string")
    entry = lambda name, value=no_text, values=no_list: F.struct(F.lit(name).alias("name"), value.alias("value"), values.alias("values"))
    results = F.array(
        entry("n", F.col("n").cast("string")), entry("mean_amplitude", F.col("m").cast("string")), entry("label", F.when(F.col("n") > 30, "busy")), entry("per_channel", values=F.array(*_CHANNELS, "view"))
    )
    long = cells.select("experiment", "cell_id", F.explode(results).alias("r")).select("experiment", "cell_id", "r.*")
    path = _folder(spark, "cells")
    for _ in range(2):  # a run that is repeated replaces its partitions
        files.write_cells(long, path, "n bigint, mean_amplitude double, label string, per_channel array<double>")
    got = spark.read.parquet(path)
    total = F.aggregate("per_channel", F.lit(0.0), lambda a, x: a + x).cast("bigint")
    return got.select(F.col("experiment").cast("bigint").alias("experiment"), "cell_id", "n", "mean_amplitude", "label", F.get("per_channel", F.lit(0)).alias("clicks"), total.alias("total"))


@query("""with l as (select o_custkey % 5 as e, o_custkey as cell, o_orderkey as g, l_linenumber as epoch, l_quantity::int as quantity from orders left join lineitem on l_orderkey = o_orderkey where o_orderstatus <> 'P'),
c as (select distinct o_custkey % 5 as e, o_custkey as cell from orders where o_orderstatus <> 'P')
select 'e' || l.e as experiment, 'group' || g as group_label, 'cell' || coalesce(c.cell, -1) as cell_label, coalesce(epoch, -1)::bigint as start_ticks, coalesce(quantity, -1)::int as quantity
from l left join c on c.e = l.e and c.cell = case when g % 7 = 0 then l.cell + 5 else l.cell end""")
def source_cells(spark: SparkSession, d: str) -> DataFrame:
    """Experiment trees (orders as groups, their lines as epochs) flattened, each group joined with the cell its source
    names, which may be another one than that it hangs under, or none."""
    orders = table(spark, d, "orders").where("o_orderstatus <> 'P'")
    none = F.create_map().cast("map<string,string>")
    epoch = F.struct(F.lit("epoch").alias("label"), F.col("l_linenumber").cast("bigint").alias("start_ticks"), F.create_map(F.lit("quantity"), F.col("l_quantity").cast("int").cast("string")).alias("parameters"))
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(epoch).alias("epochs"))
    rows = orders.join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    uuid_of = lambda cell: F.concat(F.lit("u"), cell.cast("string"))
    source = uuid_of(F.when(F.col("o_orderkey") % 7 == 0, F.col("o_custkey") + 5).otherwise(F.col("o_custkey")))
    block = F.array(F.struct(F.lit("f").alias("dataFile"), none.alias("parameters"), F.col("epochs")))
    group = F.struct(F.concat(F.lit("group"), F.col("o_orderkey").cast("string")).alias("label"), F.lit("p").alias("protocol"), source.alias("source"), block.alias("blocks"))
    cells = rows.groupBy("o_custkey").agg(F.collect_list(group).alias("groups"))
    cell = F.struct(uuid_of(F.col("o_custkey")).alias("uuid"), F.concat(F.lit("cell"), F.col("o_custkey").cast("string")).alias("label"), "groups")
    # an experiment's tree comes in documents of a cell each, as a whole one may not fit a row
    trees = cells.select(F.concat(F.lit("e"), (F.col("o_custkey") % 5).cast("string")).alias("experiment"), F.array(cell).alias("cells"))
    animals = F.array(F.struct(F.lit("a").alias("label"), F.array(F.struct(F.lit("p").alias("label"), F.col("cells"))).alias("preparations")))
    flat = files.with_source_cells(files.flattened(trees.select("experiment", animals.alias("animals"))))
    quantity = F.try_element_at("parameters", F.lit("quantity")).cast("int")
    return flat.select("experiment", "group_label", F.coalesce("source_label", F.lit("cell-1")).alias("cell_label"), F.coalesce("start_ticks", F.lit(-1)).alias("start_ticks"), F.coalesce(quantity, F.lit(-1)).alias("quantity"))


@query("select vec_id::int as cell_id, 'All/' || (case when label % 2 = 0 then 'on' else 'off' end) || '/type' || label as class, 3 as depth from embeddings")
def class_files(spark: SparkSession, d: str) -> DataFrame:
    """Class labels written as lines of text and read back."""
    v = table(spark, d, "embeddings")
    label = F.concat(F.lit("All/"), F.when(F.col("label") % 2 == 0, "on").otherwise("off"), F.lit("/type"), F.col("label").cast("string"))
    path = _folder(spark, "classes")
    files.write_classes(v.select(F.col("vec_id").alias("cell_id"), label.alias("class")), path)
    return files.read_classes(spark, path).select("cell_id", "class", F.size("parts").alias("depth"))
