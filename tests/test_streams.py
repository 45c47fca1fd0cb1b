from marlstone.streaming import incremental as S
from pyspark.sql import functions as F


def test_resume_from_a_checkpoint_counts_rows_once(spark, tmp_path):
    spark.range(10).write.parquet(f"{tmp_path}/in")
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    for more in (0, 5):
        if more:
            spark.range(more).write.mode("append").parquet(f"{tmp_path}/in")
        q = spark.readStream.schema(schema).parquet(f"{tmp_path}/in").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 15


def test_minimum_freezes_after_calibration(spark, tmp_path):
    df = spark.createDataFrame([("a", 5.0), ("a", 3.0), ("a", 4.0), ("b", 1.0)], "t string, v double")
    df.coalesce(1).write.parquet(f"{tmp_path}/1")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/1")
    got = {r.task: r for r in S.run_to_end(S.calibrated_minimum(stream, "t", "v", 2), ["task"]).collect()}
    assert (got["a"].nadir, got["a"].frozen, got["b"].frozen) == (3.0, True, False)


def test_masked_totals_stream(spark, tmp_path):
    spark.createDataFrame([("a", 1.0), ("a", None)], "k string, v double").write.parquet(f"{tmp_path}/x/t.parquet")
    stream = spark.readStream.schema("k string, v double").parquet(f"{tmp_path}/x/t.parquet")
    assert [tuple(r) for r in S.run_to_end(S.masked_totals(stream, ["k"], F.col("v")), ["k"]).collect()] == [("a", 1.0, 1)]


def land(spark, folder, k, rows):
    spark.createDataFrame(rows, "task string, ts timestamp_ntz, v double").coalesce(1).write.parquet(f"{folder}/{k}.parquet")


def states(spark, tmp_path):
    stream = spark.readStream.schema("task string, ts timestamp_ntz, v double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*.parquet")
    with S.rocksdb_state(spark):
        rows = S.run_to_end(S.expiring_minimum(stream, "task", "ts", "v", 2, 7200, "1 minute"), ["task"], f"{tmp_path}/out")
    return {r.task: (r.seen, r.nadir, r.frozen, r.expired) for r in rows.collect()}


def at(hour, minute=0):
    import datetime

    return datetime.datetime(2024, 1, 1 + hour // 24, hour % 24, minute)


def test_state_expires_and_a_restart_keeps_frozen_minima(spark, tmp_path):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    land(spark, f"{tmp_path}/in", 0, [("a", at(0), 5.0), ("a", at(0, 20), 3.0), ("a", at(0, 10), 4.0), ("b", at(0), 1.0), ("c", at(0), 9.0), (None, at(0), 0.0), ("a", None, 0.0), ("a", at(0), None)])
    assert states(spark, tmp_path) == {"a": (3, 4.0, True, False), "b": (1, 1.0, False, False), "c": (1, 9.0, False, False)}  # in order of time 5 and 4 come first
    land(spark, f"{tmp_path}/in", 1, [("a", at(1), 2.0), ("c", at(1), 8.0), ("c", at(1, 1), 1.0)])
    assert states(spark, tmp_path) == {"a": (4, 4.0, True, False), "b": (1, 1.0, False, False), "c": (3, 8.0, True, False)}  # a restart: a stays frozen
    land(spark, f"{tmp_path}/in", 2, [("a", at(2, 30), 0.5)])
    assert states(spark, tmp_path)["b"] == (1, 1.0, False, True)  # idle for two hours
    land(spark, f"{tmp_path}/in", 3, [("b", at(3), 7.0), ("c", at(4), 6.0), ("late", at(0), 1.0)])
    got = states(spark, tmp_path)
    assert got["b"] == (1, 7.0, False, False) and got["a"][:2] == (5, 4.0) and "late" not in got  # b begins anew; behind the watermark
    assert got["c"] == (1, 6.0, False, False)  # idle for more than two hours, whether its timer had fired or not
    assert spark.conf.get(name, None) == before
    # the state store has active tasks alone: after two idle hours for all but one, one is left
    land(spark, f"{tmp_path}/in", 4, [("z", at(9), 1.0)])
    got = states(spark, tmp_path)
    assert {k for k, v in got.items() if not v[3]} == {"z"}
    held = spark.read.format("statestore").option("stateVarName", "held").load(f"{tmp_path}/out/state")
    assert [r.key.task for r in held.collect()] == ["z"]


def test_weighting_state_goes_on_from_its_checkpoint(spark, tmp_path):
    """Any cut of the shards into runs and micro-batches gives the same, and what one pass over all rows gives."""
    import math
    import random

    rng = random.Random(3)
    rows = [(t, k, i, rng.random() + 0.1) for k in range(9) for i, t in enumerate("abcab") if (t, k) not in (("c", 2), ("a", 5))]

    def run(name, cuts, parts):
        for n, (first, end) in enumerate(zip(cuts, cuts[1:], strict=False)):
            for k in range(first, end):
                own = [r for r in rows if r[1] == k]
                for j in range(parts):
                    spark.createDataFrame(own[j::parts], "t string, k int, i int, x double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}/in")
            stream = spark.readStream.schema("t string, k int, i int, x double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}/in")
            with S.rocksdb_state(spark):
                out = S.run_to_end(S.nadir_ratios(stream, "t", "k", "i", "x", 2, 3), ["task", "shard"], f"{tmp_path}/{name}/out")
        return {(r.task, r.shard): (r.phase, r.n, r.nadir and round(r.nadir, 9), round(r.total, 9)) for r in out.collect()}

    want = {}
    for t in "abc":
        nadir = None
        for k in range(9):
            x = [r[3] for r in rows if r[:2] == (t, k)]
            phase = "warm-up" if k < 2 else "calibration" if k in (2, 5, 8) else "weighted"
            if x:
                total = sum(math.log(v / nadir + 1e-10) for v in x) if phase == "weighted" and nadir else 0.0
                want[t, k] = (phase, len(x), nadir and round(nadir, 9), round(total, 9))
            if phase == "calibration" and x:
                nadir = sum(x) / len(x)
    assert run("one", [0, 9], 1) == want
    assert run("cut", [0, 1, 3, 6, 9], 2) == want


def test_a_table_of_many_files_makes_no_more_micro_batches(spark, tmp_path, monkeypatch):
    from marlstone.plans import roundtrips

    rows = spark.range(3000).selectExpr("id as event_id", "'a' as event_type", "1.0D as value")
    rows.repartition(12).write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(roundtrips, "scratch_folder", lambda spark: f"{tmp_path}/scratch")
    monkeypatch.setattr(roundtrips.S, "run_to_end", lambda stream, keys, folder: spark.createDataFrame([("a", 0.0, 0)], "event_type string, total double, n long"))
    spark.conf.set("spark.sql.files.openCostInBytes", str(64 << 20))  # a task a file
    try:
        roundtrips.resumed_stream(spark, str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(spark.read.parquet(f"{tmp_path}/scratch/in").inputFiles()) == 12  # four for each third
