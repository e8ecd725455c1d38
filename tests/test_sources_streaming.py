"""Round trips of the readers, and the live operators run as streams against their batch results."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from axonloom.sources import files
from axonloom.streaming import live
from plain import plain_spikes


def test_experiment_tree(spark, tmp_path):
    tree = {"experiment": "e1", "animals": [{"label": "a", "preparations": [{"label": "p", "cells": [{"uuid": "u", "label": "c", "groups": [
        {"label": "g", "protocol": "bar", "source": "u", "blocks": [{"dataFile": "/x/data001/f", "parameters": {"k": "1", "z": "9"}, "epochs": [{"label": "e", "start_ticks": 5, "parameters": {"k": "2"}}]}]}]}]}]}]}
    (tmp_path / "e.json").write_text(json.dumps(tree, indent=1))
    (tmp_path / "f.json").write_text(json.dumps({"experiment": "e2", "animals": []}))
    got = {r.experiment: r for r in files.flattened(files.read_experiments(spark, str(tmp_path))).collect()}
    assert got["e1"].parameters == {"k": "2", "z": "9"} and got["e1"].cell_uuid == "u" and got["e2"].animal is None


def test_arrays_labels_classes(spark, tmp_path):
    np.save(tmp_path / "spike_times.npy", np.array([3, 1, 2]))
    assert [r.value for r in files.read_arrays(spark, str(tmp_path / "*.npy")).orderBy("i").collect()] == [3, 1, 2]
    (tmp_path / "l.tsv").write_text("cluster_id\tgroup\n0\tgood\n1\tmua\n")
    assert [tuple(r) for r in files.read_labels(spark, str(tmp_path / "l.tsv")).collect()] == [(0, "good"), (1, "mua")]
    classes = spark.createDataFrame([(1, "All/on/parasol"), (2, "All/off")], "cell_id int, class string")
    files.write_classes(classes, str(tmp_path / "c"))
    got = {r.cell_id: r.parts for r in files.read_classes(spark, str(tmp_path / "c")).collect()}
    assert got == {1: ["All", "on", "parasol"], 2: ["All", "off"]}
    (tmp_path / "joined.csv").write_text("a,10\nb,20\n")
    assert [tuple(r) for r in files.read_joined_lengths(spark, str(tmp_path / "joined.csv")).collect()] == [("a", 10), ("b", 20)]


def test_packed_recording(spark, tmp_path):
    g = np.random.default_rng(0)
    x = g.integers(-2048, 2048, (25, 5)).astype(np.int16)
    body = bytearray()
    for row in x:
        body += int(row[0]).to_bytes(2, "big", signed=True)
        for a, b in zip(row[1::2].tolist(), row[2::2].tolist()):
            a, b = a + 2048, b + 2048
            body += bytes([a >> 4, (a & 15) << 4 | b >> 8, b & 255])
    (tmp_path / "r.bin").write_bytes(b"head" + bytes(body))
    got = files.read_recording(spark, str(tmp_path / "r.bin"), 5, header=4, chunk=10)
    back = {(r.electrode, r.chunk): r.data for r in got.collect()}
    assert all(back[e, k] == x[k * 10 : k * 10 + 10, e].tolist() for e in range(5) for k in range(3))


def test_results_are_partitioned(spark, tmp_path):
    files.write_results(spark.createDataFrame([("e", "a", 1)], "experiment string, algorithm string, x int"), str(tmp_path / "r"))
    assert (tmp_path / "r/experiment=e/algorithm=a").exists()


@pytest.fixture(scope="module")
def arrivals(spark, tmp_path_factory):
    """Events in several files, in order of time."""
    path = tmp_path_factory.mktemp("arrivals")
    rows = spark.createDataFrame([(i * 700, f"e{i % 3}", float(i % 11)) for i in range(90)], "ms bigint, electrode string, amplitude double")
    rows = rows.select(F.timestamp_millis("ms").alias("ts"), "electrode", "amplitude")
    for k in range(3):
        rows.where((F.col("ts") >= F.timestamp_seconds(F.lit(k * 21))) & (F.col("ts") < F.timestamp_seconds(F.lit((k + 1) * 21)))).coalesce(1).write.mode("append").parquet(str(path))
    return rows, str(path)


def run(df, mode="append"):
    q = df.writeStream.format("memory").queryName("out").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table("out").collect()


def stream(spark, path):
    return files.stream_of_chunks(spark, path, "ts timestamp, electrode string, amplitude double")


def test_windows_as_a_stream(spark, arrivals):
    rows, path = arrivals
    plain = lambda rows: {tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows}
    for f in (lambda d: live.window_counts(d, "10 seconds"), lambda d: live.window_levels(d, "10 seconds")):
        assert plain(run(f(stream(spark, path)), "complete")) == plain(f(rows).collect())


def test_rates_weigh_electrodes_equally(spark, arrivals):
    """Two aggregations, one on the other: closed windows leave in append mode."""
    rows, path = arrivals
    plain = lambda rows: {tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows}
    want, got = (plain(x) for x in (live.window_rates(rows, "10 seconds", 10.0, 3).collect(), run(live.window_rates(stream(spark, path), "10 seconds", 10.0, 3))))
    assert got <= want and len(want) - 1 <= len(got) + 1
    one = spark.createDataFrame([("2024-01-01 00:00:01", "a", 1.0), ("2024-01-01 00:00:02", "a", 3.0), ("2024-01-01 00:00:03", "b", 10.0)], "ts string, electrode string, amplitude double").withColumn("ts", F.col("ts").cast("timestamp"))
    assert [(r.rate, r.mean_amplitude) for r in live.window_rates(one, "10 seconds", 10.0, 4).collect()] == [(3 / 40, 3.0)]  # (2 + 10 + 0 + 0) / 4


def test_ordered_release_drops_nothing_in_order(spark, arrivals):
    rows, path = arrivals
    got = run(live.ordered_release(stream(spark, path), "1 second", "5 seconds"))
    want = {r.start: [tuple(x) for x in r.spikes] for r in live.ordered_release(rows, "1 second", "5 seconds").collect()}
    assert got and all([tuple(x) for x in r.spikes] == want[r.start] for r in got)


def test_sessions_and_periods(spark, arrivals):
    rows, path = arrivals
    assert live.trigger_sessions(rows, "1 second").count() == 1
    got = run(live.trigger_periods(stream(spark, path)))
    assert len(got) == 87 and {r.longest_us for r in got} <= {2_100_000}


def test_live_spikes_match_batch(spark, tmp_path):
    g = np.random.default_rng(5)
    x = g.normal(0, 1, 600)
    x[[100, 199, 200, 450]] -= 30
    for k in range(3):
        spark.createDataFrame([(1, k, x[k * 200 : k * 200 + 200].tolist())], "electrode int, chunk bigint, data array<double>").coalesce(1).write.mode("append").parquet(str(tmp_path / "s"))
    got = sorted(r.t for r in run(live.live_spikes(files.stream_of_chunks(spark, str(tmp_path / "s"), "electrode int, chunk bigint, data array<double>", 10), 0.02, 10.0, 5, 50)))
    assert got == [t for t, _ in plain_spikes(x, 0.02, 10.0, 5, 50)]
