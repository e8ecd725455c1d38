"""Canonical tables (spikes, epochs, triggers, samples, waveforms) and their binding to stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US
#: Recording length of the bound tables.
DAYS = 30


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def floor_div(x: Column | str, by: int | Column) -> Column:
    """Integer division that rounds down for negative numbers too."""
    x, by = (F.col(x) if isinstance(x, str) else x), (F.lit(by) if isinstance(by, int) else by)
    return F.floor((x - F.pmod(x, by)) / by)


def spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, cell_id, t_us (since the recording began), channel, amplitude, file (ten days each)."""
    t = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)")
    rows = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("cell_id"), t.alias("t_us"), F.col("event_type").alias("channel"), F.col("value").alias("amplitude"))
    return rows.withColumn("file", floor_div("t_us", 10 * DAY_US))


def epochs(spark: SparkSession, days: int = DAYS) -> DataFrame:
    """epoch_id, file, start_us, dur_us, orientation, contrast: one epoch a day."""
    i = F.col("epoch_id")
    return spark.range(days).select(
        F.col("id").alias("epoch_id")
    ).select("epoch_id", floor_div(i, 10).alias("file"), (i * DAY_US).alias("start_us"), F.lit(DAY_US).alias("dur_us"), (i % 8 * 45).alias("orientation"), (i % 3).alias("contrast"))


def triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell_id, t_us, event_id of trigger pulses."""
    return spikes(spark, sf_dir).where("channel = 'signup'").select("event_id", "cell_id", "t_us")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell_id, i (place in the trace), t_us, x of ordered signals."""
    return spikes(spark, sf_dir).select("cell_id", F.col("event_id").alias("i"), "t_us", F.col("amplitude").alias("x"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell_id, v (64 doubles), class."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("cell_id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").alias("class"))


def waveforms(spark: SparkSession, sf_dir: str, electrodes: int = 8) -> DataFrame:
    """cell_id, electrode, wave (samples on that electrode), class."""
    long = vectors(spark, sf_dir).select("*", F.explode(F.sequence(F.lit(0), F.lit(electrodes - 1))).alias("electrode"))
    n = F.size("v") / electrodes
    return long.select("cell_id", "electrode", F.slice("v", (F.col("electrode") * n + 1).cast("int"), n.cast("int")).alias("wave"), "class")


#: The same tables in DuckDB's SQL, for the oracles.
SQL = {
    "spikes": "spikes as (select event_id, user_id as cell_id, epoch_us(ts) - 1704067200000000 as t_us, event_type as channel, value as amplitude, (epoch_us(ts) - 1704067200000000) // 864000000000 as file from events)",
    "epochs": "epochs as (select i as epoch_id, i // 10 as file, i * 86400000000 as start_us, 86400000000 as dur_us, i % 8 * 45 as orientation, i % 3 as contrast from range(30) t(i))",
    "vectors": "vectors as (select vec_id as cell_id, embedding::double[] as v, label as class from embeddings)",
    "waveforms": "waveforms as (select vec_id as cell_id, e as electrode, (embedding::double[])[e * 8 + 1:e * 8 + 8] as wave, label as class from embeddings, range(8) t(e))",
}


def with_sql(*names: str) -> str:
    return "with " + ", ".join(SQL[n] for n in names)
