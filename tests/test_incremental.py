"""Imports that break off, epochs that are tried twice, counters that expire."""

import pytest
from pyspark.sql import functions as F

from tessera.sources import batches
from tessera.sources.files import Folder
from tessera.streaming import expiry, refresh


def test_a_broken_import_goes_on_without_loss_or_repeat(spark, tmp_path):
    rows = [(i // 3, f"r{i}") for i in range(500)] + [(None, "null")]
    source, target = spark.createDataFrame(rows, "k long, v string").repartition(3), str(tmp_path / "t")
    assert batches.committed(spark, target, "s1") is None
    calls = []

    def broken(df):
        calls.append(df.count())
        if len(calls) == 3:
            df.write.parquet(f"{target}/s1/batch=2")  # half a batch is there, but not its marker
            raise RuntimeError("killed")
        return df

    with pytest.raises(RuntimeError):
        batches.import_batches(source, target, "k", "s1", 100, broken)
    assert not batches.is_complete(spark, target, "s1")
    held = batches.committed(spark, target, "s1")
    assert held.count() == sum(calls[:2]) and {r.batch for r in held.select("batch").distinct().collect()} == {0, 1}
    again = batches.import_batches(source, target, "k", "s1", 7, lambda df: df)  # the ranges are those of the first try
    assert again == {"ranges": again["ranges"], "committed": again["ranges"] - 2, "skipped": 2} and again["ranges"] == 6
    assert batches.is_complete(spark, target, "s1")
    assert sorted(map(repr, (tuple(r)[:2] for r in batches.committed(spark, target, "s1").collect()))) == sorted(map(repr, rows))
    assert batches.import_batches(source, target, "k", "s1", 100)["committed"] == 0
    per_key = batches.committed(spark, target, "s1").groupBy("k").agg(F.countDistinct("batch").alias("n"))
    assert per_key.where("n > 1").isEmpty()
    assert batches.import_batches(source, target, "k", "s2", 1000) == {"ranges": 1, "committed": 1, "skipped": 0}
    batches.import_batches(source.where("false"), target, "v", "s3", 10)
    assert batches.committed(spark, target, "s3").count() == 0 and batches.is_complete(spark, target, "s3")
    text = batches.import_batches(source, target, "v", "s4", 100)
    assert text["ranges"] > 3 and batches.committed(spark, target, "s4").count() == len(rows)


def test_an_epoch_counts_once_however_often_it_is_tried(spark, tmp_path):
    target = str(tmp_path / "t")
    values = {"now": [(1, 10), (2, 20), (3, 30)]}

    def totals(dirty):
        return spark.createDataFrame(values["now"], "k long, v long").join(dirty, "k", "left_semi")

    def live():
        return sorted((r.k, r.v) for r in refresh.current(spark, target, ["k"]).collect())

    def epoch(n, keys, every=4):
        refresh.write_epoch(spark.createDataFrame([(k,) for k in keys], "k long"), n, ["k"], totals, target, every)

    assert refresh.current(spark, target, ["k"]) is None
    epoch(0, [1, 2, 2, None])
    assert live() == [(1, 10), (2, 20)]
    values["now"] = [(1, 11), (1, 12), (3, 33)]
    epoch(1, [1, 3])
    assert live() == [(1, 11), (1, 12), (2, 20), (3, 33)]
    # the epoch's rows are written, its marker is not: readers still see the state before it, and a new try replaces them
    Folder(spark, target).delete("marks/1")
    assert live() == [(1, 10), (2, 20)]
    epoch(1, [1, 3])
    epoch(1, [1, 3])
    assert live() == [(1, 11), (1, 12), (2, 20), (3, 33)]
    epoch(2, [2])  # recomputed to nothing
    assert live() == [(1, 11), (1, 12), (3, 33)]
    values["now"] = [(3, 34)]
    epoch(3, [3])  # writes all live rows
    home = Folder(spark, target)
    assert live() == [(1, 11), (1, 12), (3, 34)] and home.names("marks") == ["3"] and home.names("rows") == ["epoch=3"]
    epoch(3, [3])
    values["now"] = [(2, 5)]
    epoch(4, [2, 1])
    assert live() == [(2, 5), (3, 34)]


def test_a_target_belongs_to_one_checkpoint(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "0.json").write_text('{"k": 1}\n')
    start = lambda c: refresh.refresh_changed(spark.readStream.schema("k long").json(str(tmp_path / "in")), ["k"], lambda d: d.withColumn("v", F.lit(1)), str(tmp_path / "t"), str(tmp_path / c))
    start("c1").awaitTermination(120)
    with pytest.raises(ValueError, match="belongs to"):
        start("c2")
    assert [(r.k, r.v, r.epoch) for r in refresh.current(spark, str(tmp_path / "t"), ["k"]).collect()] == [(1, 1, 0)]


def test_counters_expire_a_day_after_their_window(spark, tmp_path):
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        (tmp_path / "in").mkdir()
        batch = [
            ["a,2024-01-01 00:00:10", "a,2024-01-01 00:00:20", "b,2024-01-01 05:00:00", "a,2024-01-01 01:00:00"],
            ["a,2024-01-01 00:30:00"],  # late, within a day
            ["c,2024-01-02 00:30:00"],  # the first hour is over a day old now
            ["a,2024-01-01 00:40:00", "c,2024-01-02 00:40:00"],  # too late for the first window
            ["d,2024-01-04 00:00:00"],
            ["d,2024-01-04 00:00:01"],
        ]
        import os

        for i, rows in enumerate(batch):
            (tmp_path / "in" / f"{i}.csv").write_text("\n".join(rows))
            os.utime(tmp_path / "in" / f"{i}.csv", (1_700_000_000 + 10 * i,) * 2)
        stream = spark.readStream.schema("k string, ts timestamp").option("maxFilesPerTrigger", 1).csv(str(tmp_path / "in"))
        out = expiry.expiring_counters(stream, "k", "ts", 3600, 2)
        seen = []
        q = out.writeStream.foreachBatch(lambda df, n: seen.extend((n, r.k, str(r.window_start), r.n, r.rejected, r.what) for r in df.collect())).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(240)
        assert q.exception() is None
        counted = [s[1:] for s in seen if s[5] == "counted"]
        assert ("a", "2024-01-01 00:00:00", 3, True, "counted") in counted and ("c", "2024-01-02 00:00:00", 2, False, "counted") in counted
        assert max(s[2] for s in counted if s[0] == "a" and s[1] == "2024-01-01 00:00:00") == 3  # the one too late is not counted
        gone = sorted((s[1], s[2], s[3]) for s in seen if s[5] == "expired")
        assert gone == [("a", "2024-01-01 00:00:00", 3), ("a", "2024-01-01 01:00:00", 1), ("b", "2024-01-01 05:00:00", 1), ("c", "2024-01-02 00:00:00", 2)]
        left = spark.read.format("statestore").option("stateVarName", "counts").load(str(tmp_path / "c"))
        assert [r.key["k"] if "k" in r.key.asDict() else tuple(r.key)[0] for r in left.select("key").collect()] == ["d"]
        table = spark.read.schema("k string, ts timestamp").csv(str(tmp_path / "in"))
        assert [(r.k, r.n) for r in expiry.live_counters(table, "k", "ts", 3600, 2).collect()] == [("d", 2)]
    finally:
        spark.conf.set(provider, before)
