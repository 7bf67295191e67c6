"""Numbered events, late subscribers, restarts after a crash, and newer runs that cancel older ones."""

import pytest
from pyspark.errors import StreamingQueryException

from triagelake.streaming import live

SCHEMA = "conv_id long, turn long, unit_id string"


def arrive(spark, path, number, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/f{number}")


def turns(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(path))


@pytest.mark.parametrize("crash_at", [0, 1])
def test_a_crash_between_write_and_commit(spark, tmp_path, crash_at):
    source, log, checkpoint = (str(tmp_path / n) for n in ("in", "log", "state"))
    for i in range(3):  # units 0 and 1 come in every file
        arrive(spark, source, i, [(u % 2, u, f"u{u}") for u in (0, 1, 10 + i, 20 + i)])

    def crash(number):
        if number == crash_at:
            raise RuntimeError("killed")

    job = lambda: live.once(turns(spark, source))
    with pytest.raises(StreamingQueryException):
        live.start_log(job(), log, checkpoint, available=True, after_batch=crash).awaitTermination()
    live.start_log(job(), log, checkpoint, available=True).awaitTermination()
    found = [r["unit_id"] for r in live.subscribe(spark, log).collect()]
    assert sorted(found) == sorted({"u0", "u1", *(f"u{10 * k + i}" for k in (1, 2) for i in range(3))})


def test_numbers_go_on_and_late_subscribers_get_everything(spark, tmp_path):
    source, log, checkpoint = (str(tmp_path / n) for n in ("in", "log", "state"))
    run = lambda: live.start_log(live.sequenced(turns(spark, source), "conv_id", ["turn"]), log, checkpoint, available=True).awaitTermination()
    arrive(spark, source, 0, [(7, 2, "b"), (7, 1, "a"), (8, 1, "x")])
    run()
    early = live.subscribe(spark, log)
    assert {(r["conv_id"], r["seq"], r["unit_id"]) for r in early.collect()} == {(7, 1, "a"), (7, 2, "b"), (8, 1, "x")}
    known = spark.createDataFrame([(r["conv_id"], r["seq"]) for r in early.groupBy("conv_id").agg({"seq": "max"}).withColumnRenamed("max(seq)", "seq").collect()], "conv_id long, seq long")
    arrive(spark, source, 1, [(7, 4, "d"), (7, 3, "c"), (9, 1, "y")])
    run()
    assert {(r["conv_id"], r["seq"], r["unit_id"]) for r in live.subscribe(spark, log, known).collect()} == {(7, 3, "c"), (7, 4, "d"), (9, 1, "y")}
    assert [r["unit_id"] for r in live.subscribe(spark, log).filter("conv_id = 7").orderBy("seq").collect()] == ["a", "b", "c", "d"]


def test_a_new_run_cancels_older_ones(spark, tmp_path):
    source = str(tmp_path / "in")
    arrive(spark, source, 0, [(1, 1, "a")])
    start = lambda n: live.start_log(turns(spark, source), str(tmp_path / f"log{n}"), str(tmp_path / f"state{n}"), name="run")
    first, second = start(1), start(2)
    assert not first.isActive and second.isActive
    second.processAllAvailable()
    assert live.cancel(spark, "run") == 1 and live.cancel(spark, "run") == 0
    assert live.subscribe(spark, str(tmp_path / "log2")).count() == 1
