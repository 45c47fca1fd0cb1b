"""Incremental counterparts: metrics that grow with a stream, and a calibrate-then-freeze state."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_folder


def file_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """STM-01: Parquet files one after another, as a rotating shard loop."""
    folder, _, name = path.rpartition("/")
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", name).parquet(folder)


def masked_totals(stream: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """STM-02: sums and counts per key over all that has come."""
    return stream.groupBy(*keys).agg(F.sum(value).alias("total"), F.count(value).alias("n"))


def windowed_totals(stream: DataFrame, ts: str, late: str, width: str, keys: list[str], value: Column) -> DataFrame:
    """STM-02, T19: the same in event-time windows, late data dropped after the watermark."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(F.window(ts, width).alias("w"), *keys).agg(F.sum(value).alias("total"), F.count(value).alias("n"))


def run_to_end(stream: DataFrame, keys: list[str], folder: str | None = None) -> DataFrame:
    """STM-03: processes what is there and returns the last row of each key.

    The query runs in update mode, so that a watermark lets finished windows leave the state, and each batch writes the rows it
    changed below folder; a batch that runs again overwrites its own. With a folder given before, it goes on from where it stopped."""
    folder = folder or scratch_folder(stream.sparkSession)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    rows = stream.sparkSession.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{folder}/out")
    rest = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_last")).select(*keys, *[F.col("_last")[c].alias(c) for c in rest])


def calibrated_minimum(stream: DataFrame, task: str, value: str, calibration: int) -> DataFrame:
    """STM-05: for each task, the running minimum of its first calibration values, frozen from then on:
    task, seen, nadir, frozen, one row a task and micro-batch."""
    import pandas as pd

    out = T.StructType([T.StructField("task", T.StringType()), T.StructField("seen", T.LongType()), T.StructField("nadir", T.DoubleType()), T.StructField("frozen", T.BooleanType())])
    state = T.StructType([T.StructField("seen", T.LongType()), T.StructField("nadir", T.DoubleType())])

    def step(key, frames, held):
        seen, nadir = held.get if held.exists else (0, float("inf"))
        for frame in frames:
            for v in frame[value]:
                if seen < calibration:
                    nadir = min(nadir, float(v))
                seen += 1
        held.update((seen, nadir))
        yield pd.DataFrame([(key[0], seen, nadir, seen >= calibration)], columns=["task", "seen", "nadir", "frozen"])

    named = stream.select(F.col(task).cast("string").alias("task"), F.col(value).cast("double").alias(value))
    return named.groupBy("task").applyInPandasWithState(step, out, state, "update", "NoTimeout")


# ----------------------------------------------------------------- state that expires
@contextmanager
def rocksdb_state(spark: SparkSession):
    """Streams started inside keep their state in RocksDB, which state with timers needs; the setting is restored."""
    name, old = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if old is None else spark.conf.set(name, old)


def expiring_minimum(stream: DataFrame, task: str, ts: str, value: str, calibration: int, idle_seconds: int, late: str) -> DataFrame:
    """STM-05: the minimum of each task's first calibration values in order of time, frozen from then on, as a state that expires:
    task, seen, nadir, frozen, expired, one row a task and micro-batch that changes it.

    A task without a value for idle_seconds of event time begins anew with its next one, whichever batch that comes in. A timer
    deletes its state (and reports it as expired) once the watermark, late behind the newest value, has passed that time, so that the
    state holds active tasks only. Start it inside rocksdb_state; null tasks, times and values are left out, values
    behind the watermark are dropped. The values that one micro-batch has of one task are sorted in memory. A task has one timer, which is not
    moved with each value but set anew when it goes off too early, as calls to the state store are what a task costs."""
    from pyspark.sql import Row
    from pyspark.sql.streaming import StatefulProcessor

    idle = idle_seconds * 1000

    class Calibrated(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.held = handle.getValueState("held", "seen long, nadir double, last long")

        def handleInputRows(self, key, rows, timerValues):
            held = self.held.get()
            seen, nadir, last = held or (0, float("inf"), None)
            for at, v in sorted((r.at, r.v) for r in rows):
                if last is not None and at - last > idle:
                    seen, nadir = 0, float("inf")
                if seen < calibration:
                    nadir = min(nadir, v)
                seen, last = seen + 1, at if last is None else max(last, at)
            self.held.update((seen, nadir, last))
            if held is None:
                self.handle.registerTimer(last + idle)
            yield self.row(key, seen, nadir, False)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            seen, nadir, last = self.held.get()
            if last + idle > timerValues.getCurrentWatermarkInMs():
                self.handle.registerTimer(last + idle)
                return
            self.held.clear()
            yield self.row(key, seen, nadir, True)

        @staticmethod
        def row(key, seen, nadir, expired):
            return Row(task=key[0], seen=seen, nadir=nadir, frozen=seen >= calibration, expired=expired)

        def close(self):
            pass

    timed = stream.select(F.col(task).cast("string").alias("task"), F.col(ts).cast("timestamp").alias("ts"), F.col(value).cast("double").alias("v")).where("task is not null and ts is not null and v is not null")
    rows = timed.withWatermark("ts", late).withColumn("at", F.unix_millis("ts"))
    return rows.groupBy("task").transformWithState(Calibrated(), "task string, seen long, nadir double, frozen boolean, expired boolean", "update", "EventTime")


def nadir_ratios(stream: DataFrame, task: str, shard: str, step: str, loss: str, warmup: int, refresh: int = 0, eps: float = 1e-10) -> DataFrame:
    """STM-03, STM-05: the state of a task weighting as it goes through the shards of a run: task, shard, phase, n, nadir, total, one row
    for each task and shard that a micro-batch changes, with all that was seen of it.

    Before shard warmup the phase is warm-up. Shard warmup, and then every refresh-th one (0: none), calibrates: the mean loss of a
    calibration is the task's nadir in the shards after it, until the next calibration has ended. There total is the sum of
    log(loss / nadir + eps), what the smooth maximum of losses is made of. Shards must arrive in order, each in any number of
    micro-batches; the sums, the nadir and whether a calibration is pending are in the stream's checkpoint, so a run goes on where it
    stopped. Start it inside rocksdb_state; null tasks, shards and losses are left out. The losses that one micro-batch has of one task are
    held as numbers of 8 bytes and added up by numpy."""
    import numpy as np
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    names = ["task", "shard", "phase", "n", "nadir", "total"]

    def calibrates(k: int) -> bool:
        return k == warmup or (refresh > 0 and k > warmup and (k - warmup) % refresh == 0)

    class Weighted(StatefulProcessor):
        def init(self, handle):
            self.held = handle.getValueState("run", "shard int, n long, total double, sum double, count long, nadir double")

        def handleInputRows(self, key, rows, timerValues):
            at, n, total, mean_sum, count, nadir = self.held.get() if self.held.exists() else (None, 0, 0.0, 0.0, 0, None)
            out, parts = {}, {}
            for frame in rows:
                shards, losses = frame["shard"].to_numpy(), frame["loss"].to_numpy()
                for k in np.unique(shards):
                    parts.setdefault(int(k), []).append(losses[shards == k])
            for k in sorted(parts):
                x = np.sort(np.concatenate(parts.pop(k)))  # sums do not depend on how rows arrived
                if k != at:
                    if at is not None and calibrates(at) and count:
                        nadir = mean_sum / count  # the calibration that was pending has ended
                    at, n, total = k, 0, 0.0
                    if calibrates(k):
                        mean_sum, count = 0.0, 0
                n += len(x)
                if calibrates(k):
                    mean_sum, count = mean_sum + float(x.sum()), count + len(x)
                elif k > warmup and nadir is not None:
                    with np.errstate(divide="raise", invalid="raise"):  # a loss below 0 is an error
                        total += float(np.log(x / nadir + eps).sum())
                phase = "warm-up" if k < warmup else "calibration" if calibrates(k) else "weighted"
                out[k] = (key[0], k, phase, n, None if phase == "warm-up" else nadir, total)
            self.held.update((at, n, total, mean_sum, count, nadir))
            yield pd.DataFrame(list(out.values()), columns=names).astype({"nadir": "float64", "total": "float64"})

        def close(self):
            pass

    rows = stream.select(F.col(task).cast("string").alias("task"), F.col(shard).cast("int").alias("shard"), F.col(step).cast("long").alias("step"), F.col(loss).cast("double").alias("loss"))
    known = rows.where("task is not null and shard is not null and step is not null and loss is not null").drop("step")
    return known.groupBy("task").transformWithStateInPandas(Weighted(), "task string, shard int, phase string, n long, nadir double, total double", "update", "None")
