"""Streams give what batches give, and the store keeps each step once."""

import random

import pytest
from pyspark.sql import functions as F

from tidemill.operators import ingest
from tidemill.schema import DataSource
from tidemill.streaming import readings

T0 = 1_000_000_000
SCHEMA = "series string, ts long, v string, seq long"


def made(seed, kind):
    rng = random.Random(seed)
    rows, seq = [], 0
    for s in ("a", "b", "c"):
        t, c = T0 + rng.randrange(50), 0
        for _ in range(60):
            t += rng.choice([1, 3, 5, 10, 17, 30, 95])
            c += rng.randrange(100)
            v = None if rng.random() < 0.1 else str(c if kind in ("COUNTER", "DERIVE") else round(rng.uniform(-5, 5), 2))
            rows.append((s, t - (40 if rng.random() < 0.1 else 0), v, seq))
            seq += 1
    return rows


def drain(spark, tmp_path, frames, plan, name):
    folder = tmp_path / "in"
    for i, f in enumerate(frames):
        f.coalesce(1).write.mode("append").parquet(f"{folder}/{i:03d}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))
    q = plan(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


@pytest.mark.parametrize("kind", ["GAUGE", "COUNTER", "DERIVE", "ABSOLUTE"])
def test_stream_equals_batch(spark, tmp_path, kind):
    rows = made(7, kind)
    source = DataSource("v", kind, 40, -4 if kind == "GAUGE" else None, 50)
    whole = spark.createDataFrame(rows, SCHEMA)
    want = {(r["series"], r["ts"]): r["v"] for r in ingest.pdps(whole, source, 10, order="seq").collect()}
    frames = [spark.createDataFrame(rows[k : k + 45], SCHEMA) for k in range(0, len(rows), 45)]
    got = drain(spark, tmp_path, frames, lambda s: readings.pdps(s, source, 10, order="seq"), f"steps_{kind}").collect()
    assert len(got) == len(want) and {(r["series"], r["ts"]) for r in got} == set(want)
    assert {(r["series"], r["ts"]) for r in got if r["v"] is None} == {k for k, v in want.items() if v is None}
    for r in got:
        assert r["v"] is None or r["v"] == pytest.approx(want[r["series"], r["ts"]], rel=1e-9), r


def test_late_readings_are_refused(spark, tmp_path):
    rows = [("a", T0 + t, "1", i) for i, t in enumerate([10, 20, 20, 5, 30])]
    out = drain(spark, tmp_path, [spark.createDataFrame(rows[:3], SCHEMA), spark.createDataFrame(rows[3:], SCHEMA)], lambda s: readings.newest_only(s, order="seq"), "told")
    assert sorted((r["ts"] - T0, r["accepted"]) for r in out.collect()) == [(5, False), (10, True), (20, False), (20, True), (30, True)]


def test_arguments(spark):
    lines = spark.createDataFrame([("100:1:2",), ("N:U:3",), ("-5:4:5",), ("7:1",), ("x:1:2",)], "line string")
    got = sorted((r["ts"], r["ds"], r["v"]) for r in readings.arguments(lines, ["a", "b", "c"], ["c", "a"], now=1000).collect())
    assert got == [(100, "a", "2"), (100, "b", None), (100, "c", "1"), (995, "a", "5"), (995, "b", None), (995, "c", "4"), (1000, "a", "3"), (1000, "b", None), (1000, "c", None)]
    assert readings.at_time("20030102 13:00@5:6", 0) == "1041512400:5:6"
    with pytest.raises(ValueError):
        readings.arguments(lines, ["a"], ["z"])


def test_requests_count_once(spark, tmp_path):
    rows = [("a", T0, "1", 1), ("a", T0, "1", 1), ("a", T0 + 10, "2", 2)]
    plan = lambda s: readings.once(s.withColumn("accepted_at", F.timestamp_seconds("ts")).withColumn("request_id", F.col("seq")))
    out = drain(spark, tmp_path, [spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(rows[:1], SCHEMA)], plan, "requests")
    assert sorted(r["seq"] for r in out.collect()) == [1, 2]


def test_store(spark, tmp_path):
    folder = tmp_path / "in"
    spark.createDataFrame([(s, T0 + 10 * k, str(k), k) for s in "ab" for k in range(6)], SCHEMA).write.parquet(str(folder / "0"))
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(str(folder))
    store = readings.Store(spark, str(tmp_path / "rows"), str(tmp_path / "ck"))
    store.suspend("b")
    store.start(readings.pdps(stream, DataSource("v", "GAUGE", 100), 10))
    assert {r["series"] for r in store.flush().collect()} == {"a"} and store.pending().count() == 5
    store.resume()
    assert store.rows().groupBy("series").count().where("count = 5").count() == 2 and store.pending().count() == 0
    store.suspend("b")
    store.forget("b")
    # a store that is opened again knows its commands
    again = readings.Store(spark, str(tmp_path / "rows"), str(tmp_path / "ck"))
    assert again.suspended == {"b"} and again.pending().count() == 0
    store.resume("b")
    assert {r["series"] for r in store.rows().collect()} == {"a"} and store.stats()["suspended"] == 0
    store.stop()
