"""Packed recordings as a Spark data source: one file is read by many tasks.

A recording is a header and rows of fixed length: channel 0 as big-endian 16 bits, then pairs of 12-bit values in three
bytes each. Partitions are byte ranges that begin at whole chunks, so tasks need nothing of each other, and a range is
decoded chunk by chunk: a task holds one chunk's bytes. Only the wanted electrodes are unpacked (an option, as Spark
passes filters to such sources only where a setting that is off by default allows it).

Options: path (a file, or a folder of .bin files, on any file system that Arrow opens), channels, header (bytes), chunk
(samples), split (bytes of a partition, at least a chunk) and electrodes (comma-separated; default all)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, electrode smallint, chunk bigint, data array<smallint>"
_ARROW = pa.schema([("file", pa.string()), ("electrode", pa.int16()), ("chunk", pa.int64()), ("data", pa.list_(pa.int16()))])
#: Bytes of a partition unless the option says otherwise.
SPLIT = 128 << 20


def row_bytes(channels: int) -> int:
    return 2 + 3 * ((channels - 1) // 2)


def unpacked(rows: np.ndarray, electrode: int) -> np.ndarray:
    """One electrode's samples of rows of packed bytes."""
    if electrode == 0:
        return np.ascontiguousarray(rows[:, :2]).view(">i2")[:, 0].astype(np.int16)
    first = 2 + 3 * ((electrode - 1) // 2)
    x, y, z = (rows[:, first + i].astype(np.int16) for i in range(3))
    return ((x << 4 | y >> 4) if electrode % 2 else ((y & 15) << 8 | z)) - 2048


def packed(samples: np.ndarray) -> bytes:
    """Rows (samples x channels, an odd number of them) as packed bytes; 12-bit values are clipped to what they hold."""
    out = np.empty((len(samples), row_bytes(samples.shape[1])), np.uint8)
    out[:, :2] = samples[:, :1].astype(">i2").view(np.uint8)
    values = np.clip(samples[:, 1:].astype(np.int32) + 2048, 0, 4095)
    a, b = values[:, ::2], values[:, 1::2]
    out[:, 2::3], out[:, 3::3], out[:, 4::3] = a >> 4, (a & 15) << 4 | b >> 8, b & 255
    return out.tobytes()


class ByteRange(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


class RecordingReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.channels, self.header = int(options["channels"]), int(options.get("header", 0))
        self.chunk, self.split = int(options.get("chunk", 20_000)), int(options.get("split", SPLIT))
        wanted = options.get("electrodes")
        self.electrodes = sorted({int(e) for e in wanted.split(",")}) if wanted else list(range(self.channels))

    def partitions(self) -> Sequence[InputPartition]:
        store, root = fs.FileSystem.from_uri(self.path)
        info = store.get_file_info(root)
        files = [info] if info.is_file else sorted((f for f in store.get_file_info(fs.FileSelector(root)) if f.is_file and f.path.endswith(".bin")), key=lambda f: f.path)
        row = row_bytes(self.channels)
        step = row * self.chunk * max(1, self.split // (row * self.chunk))
        out = []
        for f in files:
            end = self.header + (f.size - self.header) // row * row
            out += [ByteRange(f.path, at, min(end, at + step)) for at in range(self.header, end, step)]
        return out

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(self.path)
        row = row_bytes(self.channels)
        size = row * self.chunk
        name = partition.path.rpartition("/")[2]
        with store.open_input_file(partition.path) as f:
            for at in range(partition.start, partition.stop, size):
                rows = np.frombuffer(f.read_at(min(size, partition.stop - at), at), np.uint8).reshape(-1, row)
                for e in self.electrodes:  # one electrode's list at a time
                    data = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), pa.array(unpacked(rows, e)))
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([e], pa.int16()), pa.array([(at - self.header) // size], pa.int64()), data], schema=_ARROW)


class Recordings(DataSource):
    @classmethod
    def name(cls) -> str:
        return "packed_recording"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RecordingReader:
        return RecordingReader(self.options)


def read_recordings(spark: SparkSession, path: str, channels: int, header: int = 0, chunk: int = 20_000, split: int = SPLIT, electrodes: Sequence[int] | None = None) -> DataFrame:
    """(file, electrode, chunk, data) of one packed recording or a folder of them, in byte ranges."""
    spark.dataSource.register(Recordings)
    reader = spark.read.format("packed_recording").options(channels=channels, header=header, chunk=chunk, split=split)
    if electrodes is not None:
        reader = reader.option("electrodes", ",".join(map(str, electrodes)))
    return reader.load(path)


def write_recordings(rows: DataFrame, path: str, channels: int, rows_a_file: int, header: bytes = b"") -> DataFrame:
    """(file, n): packs rows (recording, i, samples) into files <recording>-<part>.bin of ``rows_a_file`` samples, each
    by one task; a task that runs again writes the same file again. Lazy: files are there once it has run."""

    def run(key: tuple, pdf):
        import pandas as pd

        store, root = fs.FileSystem.from_uri(path)
        pdf = pdf.sort_values("i")
        name = f"{key[0]}-{key[1]:06d}.bin"
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/{name}") as f:
            f.write(header + packed(np.stack(pdf["samples"].to_numpy()).reshape(len(pdf), channels)))
        return pd.DataFrame({"file": [name], "n": [len(pdf)]})

    part = F.floor(F.col("i") / rows_a_file)
    return rows.select("recording", part.alias("part"), "i", "samples").groupBy("recording", "part").applyInPandas(run, "file string, n bigint")
