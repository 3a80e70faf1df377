"""Array files and streams."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import array as A
from tessera.sources import npy
from tessera.streaming.windows import arrayterator, running_sum, windowed_statistics


def values(a):
    return np.array(a.tolist())


@pytest.mark.parametrize("kind", ["?", "i1", "<i4", "<i8", "u1", "u2", "u4", "<f4", "<f8", ">f8", "f2"])
def test_npy_read(spark, tmp_path, kind):
    x = np.arange(24).reshape(2, 3, 4).astype(kind)
    np.save(tmp_path / "x.npy", x)
    got = npy.load(spark, f"{tmp_path}/x.npy", cells=7)
    assert got.shape == x.shape and got.cells.rdd.getNumPartitions() == 4
    np.testing.assert_array_equal(values(got).astype(float), x.astype(float))


def test_npy_orders_and_special_types(spark, tmp_path):
    x = np.asfortranarray(np.arange(12.0).reshape(3, 4))
    np.save(tmp_path / "f.npy", x)
    np.testing.assert_array_equal(values(npy.load(spark, f"{tmp_path}/f.npy")), x)
    np.save(tmp_path / "u.npy", np.array([2**64 - 1], np.uint64))
    assert int(npy.load(spark, f"{tmp_path}/u.npy").item()) == 2**64 - 1
    np.save(tmp_path / "c.npy", np.array([1 + 2j]))
    assert npy.load(spark, f"{tmp_path}/c.npy").item()["im"] == 2
    np.save(tmp_path / "s.npy", np.array(["ab", "ç"]))
    assert npy.load(spark, f"{tmp_path}/s.npy").tolist() == ["ab", "ç"]
    np.save(tmp_path / "z.npy", np.float64(3.5))
    assert npy.load(spark, f"{tmp_path}/z.npy").item() == 3.5
    np.save(tmp_path / "o.npy", np.array([None]), allow_pickle=True)
    with pytest.raises(Exception, match="Object arrays"):
        npy.load(spark, f"{tmp_path}/o.npy")


def test_npy_write(spark, tmp_path):
    a = A.reshape(A.arange(spark, 20).map(lambda v: v.cast("double")), (4, 5))
    npy.save(a, f"{tmp_path}/a.npy")
    np.testing.assert_array_equal(np.load(tmp_path / "a.npy"), np.arange(20.0).reshape(4, 5))
    assert npy.save_parts(a, f"{tmp_path}/parts", cells=6) == 4
    files = sorted((tmp_path / "parts").iterdir())
    np.testing.assert_array_equal(np.concatenate([np.load(f) for f in files]), np.arange(20.0))
    for compressed in (False, True):
        npy.savez(f"{tmp_path}/z.npz", compressed, first=a, second=a.map(lambda v: v * 2))
        with np.load(tmp_path / "z.npz") as told:
            np.testing.assert_array_equal(told["second"], np.arange(20.0).reshape(4, 5) * 2)
        assert npy.names(f"{tmp_path}/z.npz") == ["first", "second"]
        np.testing.assert_array_equal(values(npy.load(spark, f"{tmp_path}/z.npz", member="second")), np.arange(20.0).reshape(4, 5) * 2)


def test_raw(spark, tmp_path):
    np.arange(10, dtype="<i4").tofile(tmp_path / "raw.bin")
    assert npy.frombuffer(spark, f"{tmp_path}/raw.bin", "int32", 3, 8).tolist() == [2, 3, 4]
    assert npy.memmap(spark, f"{tmp_path}/raw.bin", "int32", (2, 5)).tolist() == np.arange(10).reshape(2, 5).tolist()


def test_streams(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    for k in range(3):
        events.where(F.col("event_id") % 3 == k).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    query = running_sum(stream, "event_type", "event_id", "value").writeStream.format("memory").queryName("sums").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start()
    query.awaitTermination()
    last = {r.event_type: r.t for r in spark.table("sums").groupBy("event_type").agg(F.max_by("total", F.struct(F.col("event_id") % 3, "event_id")).alias("t")).collect()}
    want = {r.event_type: r.s for r in events.groupBy("event_type").agg(F.sum("value").alias("s")).collect()}
    assert set(last) == set(want) and all(abs(spark.table("sums").where(F.col("event_type") == k).count() - events.where(F.col("event_type") == k).count()) == 0 for k in want)
    windows = windowed_statistics(stream, "ts", "event_type", "value").writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start()
    windows.awaitTermination()
    batch = windowed_statistics(events, "ts", "event_type", "value")
    assert spark.table("windows").count() == batch.count() and spark.table("windows").agg(F.sum("n")).first()[0] == events.count()
    assert sum(len(rows) for rows in arrayterator(events, 300)) == events.count()
