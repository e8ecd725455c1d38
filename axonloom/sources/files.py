"""Readers and writers: experiment JSON, sorter output, labels, packed recordings, result tables."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_EPOCH = T.StructType([T.StructField("label", T.StringType()), T.StructField("start_ticks", T.LongType()), T.StructField("parameters", T.MapType(T.StringType(), T.StringType()))])
_BLOCK = T.StructType([T.StructField("dataFile", T.StringType()), T.StructField("parameters", T.MapType(T.StringType(), T.StringType())), T.StructField("epochs", T.ArrayType(_EPOCH))])
_GROUP = T.StructType([T.StructField("label", T.StringType()), T.StructField("protocol", T.StringType()), T.StructField("source", T.StringType()), T.StructField("blocks", T.ArrayType(_BLOCK))])
_CELL = T.StructType([T.StructField("uuid", T.StringType()), T.StructField("label", T.StringType()), T.StructField("groups", T.ArrayType(_GROUP))])
_PREP = T.StructType([T.StructField("label", T.StringType()), T.StructField("cells", T.ArrayType(_CELL))])
_ANIMAL = T.StructType([T.StructField("label", T.StringType()), T.StructField("preparations", T.ArrayType(_PREP))])
EXPERIMENT = T.StructType([T.StructField("experiment", T.StringType()), T.StructField("animals", T.ArrayType(_ANIMAL))])


def read_experiments(spark: SparkSession, path: str) -> DataFrame:
    """Experiment trees, one JSON document a file."""
    return spark.read.schema(EXPERIMENT).json(path, multiLine=True)


def flattened(experiments: DataFrame) -> DataFrame:
    """One row per epoch with its ancestors; parents without children keep a row. Epoch parameters win over the
    block's."""
    rows = experiments
    for parent, child in (("animals", "_a"), ("_a.preparations", "_p"), ("_p.cells", "_c"), ("_c.groups", "_g"), ("_g.blocks", "_b"), ("_b.epochs", "_e")):
        rows = rows.withColumn(child, F.explode_outer(parent))
    return rows.select(
        "experiment", F.col("_a.label").alias("animal"), F.col("_p.label").alias("preparation"), F.col("_c.uuid").alias("cell_uuid"), F.col("_c.label").alias("cell_label"), F.col("_g.label").alias("group_label"), F.col("_g.source").alias("source"),
        F.col("_g.protocol").alias("protocol"), F.col("_b.dataFile").alias("data_file"), F.col("_e.label").alias("epoch"), F.col("_e.start_ticks").alias("start_ticks"),
        merged_parameters("_b.parameters", "_e.parameters").alias("parameters"),
    )


def with_source_cells(flat: DataFrame) -> DataFrame:
    """``flat`` rows with ``source_label``: the label of the cell of the same experiment whose uuid the group names as its
    source, wherever in the tree it is; null if there is none. Cells are few rows beside epochs."""
    cells = flat.where("cell_uuid is not null").groupBy("experiment", F.col("cell_uuid").alias("source")).agg(F.min("cell_label").alias("source_label"))
    return flat.join(cells, ["experiment", "source"], "left")


def merged_parameters(block: str, epoch: str):
    """Both maps as one with sorted keys, the second winning."""
    none = F.create_map().cast("map<string,string>")
    b, e = F.coalesce(F.col(block), none), F.coalesce(F.col(epoch), none)
    own = F.map_filter(b, lambda k, v: ~F.map_contains_key(e, k))
    return F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(own, e))))


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """(file, i, value) of .npy vectors; a file is one task's, as the format can't be split."""

    def run(batches):
        for pdf in batches:
            for name, content in zip(pdf.path, pdf.content):
                v = np.load(io.BytesIO(content)).ravel()
                for at in range(0, len(v), 1 << 18):
                    part = v[at : at + (1 << 18)]
                    yield pd.DataFrame({"file": name, "i": np.arange(at, at + len(part)), "value": part.astype(np.int64)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, i bigint, value bigint")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """cluster_id, label of a tab-separated file with a header."""
    return spark.read.csv(path, sep="\t", header=True, schema="cluster_id int, label string")


def unpack_12bit(data: bytes, channels: int) -> np.ndarray:
    """Samples x channels: channel 0 as big-endian 16 bits, then pairs of 12-bit values in three bytes, less 2048."""
    pairs = (channels - 1) // 2
    row = 2 + 3 * pairs
    raw = np.frombuffer(data, np.uint8)[: len(data) // row * row].reshape(-1, row).astype(np.int32)
    out = np.empty((len(raw), 1 + 2 * pairs), np.int16)
    out[:, 0] = ((raw[:, 0] << 8) | raw[:, 1]).astype(np.uint16).view(np.int16)
    a, b, c = (raw[:, 2 + k :: 3] for k in range(3))
    out[:, 1::2] = ((a << 4) | (b >> 4)) - 2048
    out[:, 2::2] = (((b & 15) << 8) | c) - 2048
    return out


def read_recording(spark: SparkSession, path: str, channels: int, header: int = 0, chunk: int = 20_000) -> DataFrame:
    """(file, electrode, chunk, data) of packed recordings kept as files of bounded size (recorders roll them over)."""

    def run(batches):
        for pdf in batches:
            for name, content in zip(pdf.path, pdf.content):
                x = unpack_12bit(bytes(content)[header:], channels)
                for k in range(-(-len(x) // chunk)):
                    part = x[k * chunk : (k + 1) * chunk]
                    yield pd.DataFrame({"file": name, "electrode": np.arange(x.shape[1], dtype=np.int16), "chunk": k, "data": [part[:, e] for e in range(x.shape[1])]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, electrode smallint, chunk bigint, data array<smallint>")


def read_joined_lengths(spark: SparkSession, path: str) -> DataFrame:
    """(file, n): lengths of the recordings that were joined, in order."""
    return spark.read.csv(path, schema="file string, n bigint")


def read_classes(spark: SparkSession, path: str) -> DataFrame:
    """cell_id, class, and the class path's parts, of lines '<id>  <class>'."""
    parts = F.split(F.trim("value"), r"\s+", 2)
    return spark.read.text(path).where("trim(value) <> ''").select(F.get(parts, F.lit(0)).cast("int").alias("cell_id"), F.get(parts, F.lit(1)).alias("class")).withColumn("parts", F.split("class", "/"))


def write_classes(classes: DataFrame, path: str) -> None:
    classes.select(F.concat_ws("  ", F.col("cell_id").cast("string"), "class").alias("value")).write.mode("overwrite").text(path)


def write_results(rows: DataFrame, path: str, by: tuple[str, ...] = ("experiment", "algorithm")) -> None:
    """A results table partitioned on disk."""
    rows.write.mode("overwrite").partitionBy(*by).parquet(path)


def stream_of_chunks(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """Chunk rows as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def write_cells(rows: DataFrame, path: str, schema: str, by: str = "experiment") -> None:
    """One wide row a cell, from calculators' long results (``by``, cell_id, name, value as string or array): each column
    of the declared ``schema`` takes the value of its name in its type, null without one; names that aren't declared are
    refused. Only the partitions that the rows touch are replaced, so a run can be repeated."""
    wide(rows, schema, by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def wide(rows: DataFrame, schema: str, by: str = "experiment") -> DataFrame:
    """(by, cell_id, declared columns) of long results (by, cell_id, name, value, values): scalars are in ``value``
    (string), arrays in ``values`` (doubles). Of several values of one name the largest is kept."""
    fields = T.StructType.fromDDL(schema).fields
    unknown = rows.where(~F.col("name").isin([f.name for f in fields])).limit(1).collect()
    if unknown:
        raise ValueError(f"no column for {unknown[0]['name']}")
    take = lambda f: F.max(F.when(F.col("name") == f.name, F.col("values" if isinstance(f.dataType, T.ArrayType) else "value"))).cast(f.dataType).alias(f.name)
    return rows.groupBy(by, "cell_id").agg(*map(take, fields))
