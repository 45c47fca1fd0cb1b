"""Row maps that may fail: a value or an error for each row, never a failed stage."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from . import heads


def fallible_map(df: DataFrame, column: str, fn: Callable, result: str, seconds: float | None = None) -> DataFrame:
    """UDF-01..06: adds value (of type result) and error for fn of the column; null input gives neither.
    seconds: a limit for each row, kept by an alarm in the worker."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StringType, StructField, StructType

    value = df.sparkSession.createDataFrame([], f"value {result}").schema.fields[0]
    schema = StructType([*df.schema.fields, value, StructField("error", StringType())])
    arrow, at = to_arrow_schema(schema), df.columns.index(column)

    def run(batches):
        import signal

        def late(*_):
            raise TimeoutError(f"took more than {seconds} s")

        if seconds:
            signal.signal(signal.SIGALRM, late)
        for batch in batches:
            values, errors = [], []
            for x in batch[at].to_pylist():
                v = e = None
                if x is not None:
                    try:
                        if seconds:
                            signal.setitimer(signal.ITIMER_REAL, seconds)
                        v = fn(x)
                    except Exception as problem:  # noqa: BLE001  any failure of a row is data
                        e = f"{type(problem).__name__}: {problem}"[:300]
                    finally:
                        if seconds:
                            signal.setitimer(signal.ITIMER_REAL, 0)
                values.append(v)
                errors.append(e)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, arrow.field("value").type), pa.array(errors, pa.string())], schema=arrow)

    return df.mapInArrow(run, schema)


def once_per_key(df: DataFrame, key: str, fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """§4.1 caching: fn over the distinct keys, joined back."""
    return df.join(fn(df.select(key).where(F.col(key).isNotNull()).distinct()), key, "left")


CHILDREN = 8  # processes of a task at most: so many of its rows may hang at the same time
PATIENCE = 0.02  # seconds after which a row that has not answered no longer holds up the next


class Children:
    """Processes that call functions for a task, one row each at a time, and are replaced when their time is up or they have died.

    They are forks of one process, which is started by running Python and has one thread, not of the worker with its threads; it
    kills and replaces them and goes, with all of them, when the worker does. A row that answers at once is followed by the next in the
    same process; while rows hang, the next ones go on in up to CHILDREN others."""

    MAIN = "import pickle, sys; pickle.loads(sys.stdin.buffer.read())()"

    def __init__(self, functions: list[Callable], seconds: float):
        import selectors
        import socket
        import subprocess
        import sys
        from functools import partial

        from pyspark import cloudpickle

        self.steps, self.seconds, self.waiting = len(functions), seconds, selectors.DefaultSelector()
        self.sockets, self.buffers, self.idle, self.starting, self.busy = {}, {}, [], set(), {}
        self.control, theirs = socket.socketpair()
        self.process = subprocess.Popen([sys.executable, "-c", self.MAIN], stdin=subprocess.PIPE, pass_fds=[theirs.fileno()], env=self.environment())
        self.process.stdin.write(cloudpickle.dumps(partial(serve, theirs.fileno(), functions)))
        self.process.stdin.close()
        theirs.close()
        if not self.control.recv(1):  # ready: starting up is not a step's time
            raise RuntimeError("the process of the steps did not start")

    @staticmethod
    def environment() -> dict:
        import os
        import sys

        return os.environ | {"PYTHONPATH": os.pathsep.join(p for p in sys.path if p)}

    def start(self, slot: int) -> None:
        """A new process in a slot; the one that was there is killed."""
        import selectors
        import socket

        if slot in self.sockets:
            self.waiting.unregister(self.sockets[slot])
            self.sockets[slot].close()
        ours, theirs = socket.socketpair()
        socket.send_fds(self.control, [bytes([slot])], [theirs.fileno()])
        theirs.close()
        self.sockets[slot], self.buffers[slot] = ours, b""
        self.waiting.register(ours, selectors.EVENT_READ, slot)
        self.starting.add(slot)

    def received(self, slot: int) -> bytes | None:
        """The message of a slot if it is complete, None if not; EOFError if the process has died."""
        try:
            part = self.sockets[slot].recv(1 << 16)
        except ConnectionError:
            part = b""
        if not part:
            raise EOFError
        self.buffers[slot] += part
        n = int.from_bytes(self.buffers[slot][:8], "little")
        return self.buffers[slot][8:] if len(self.buffers[slot]) >= 8 + n and len(self.buffers[slot]) >= 8 else None

    def run(self, values: list) -> list[tuple]:
        """For each value, null apart: the first result of a step, the step's place and no error, or the errors of all steps."""
        import pickle
        import time
        from collections import deque

        out: list[tuple] = [(None, None, None)] * len(values)
        todo = deque((i, 0, ()) for i, x in enumerate(values) if x is not None)

        def failed(slot: int, error: str) -> None:
            i, k, errors, _ = self.busy.pop(slot)
            errors = (*errors, error[:200])
            if k + 1 < self.steps:
                todo.appendleft((i, k + 1, errors))
            else:
                out[i] = (None, None, "; ".join(errors))

        while todo or self.busy:
            now = time.monotonic()
            next_at = max((since for *_, since in self.busy.values()), default=-PATIENCE) + PATIENCE
            if todo and now >= next_at:
                if self.idle:
                    slot = self.idle.pop()
                    i, k, errors = todo.popleft()
                    data = pickle.dumps((k, values[i]))
                    self.busy[slot] = (i, k, errors, now)
                    try:
                        self.sockets[slot].sendall(len(data).to_bytes(8, "little") + data)
                    except ConnectionError:
                        failed(slot, "RuntimeError: the process died")
                        self.start(slot)
                    continue
                if not self.starting and len(self.sockets) < CHILDREN:
                    self.start(len(self.sockets))
            ends = [since + self.seconds for *_, since in self.busy.values()] + ([next_at] if todo and now < next_at else [])
            for key, _ in self.waiting.select(max(0.0, min(ends) - now) if ends else None):
                slot = key.data
                try:
                    if (answer := self.received(slot)) is None:
                        continue
                except EOFError:
                    if slot in self.busy:
                        failed(slot, "RuntimeError: the process died")
                    elif slot in self.starting:
                        raise RuntimeError("the process of the steps died") from None
                    else:
                        self.idle.remove(slot)
                    self.start(slot)
                    continue
                self.buffers[slot] = b""
                if slot in self.starting:
                    self.starting.remove(slot)
                else:
                    value, error = pickle.loads(answer)
                    if error:
                        failed(slot, f"RuntimeError: {error}")
                    else:
                        i, k, *_ = self.busy.pop(slot)
                        out[i] = (value, k, None)
                self.idle.append(slot)
            now = time.monotonic()
            for slot in [s for s, (*_, since) in self.busy.items() if now >= since + self.seconds]:
                failed(slot, f"TimeoutError: killed after {self.seconds} s")
                self.start(slot)
        return out

    def close(self) -> None:
        self.control.close()  # tells the process to kill the others and go
        for x in self.sockets.values():
            x.close()
        self.waiting.close()
        self.process.wait()


def serve(control: int, functions: list[Callable]) -> None:
    """The process that Children starts: for each slot named it kills the process there and forks another, which calls functions.
    What functions print goes to the worker's error output."""
    import os
    import pickle
    import signal
    import socket

    os.dup2(2, 1)
    channel, held = socket.socket(fileno=control), {}
    channel.sendall(b"r")

    def work(fd: int) -> None:
        channel.close()
        with socket.socket(fileno=fd) as s, s.makefile("rwb") as stream:

            def send(x) -> None:
                data = pickle.dumps(x)
                stream.write(len(data).to_bytes(8, "little") + data)
                stream.flush()

            send(None)
            while n := stream.read(8):
                k, x = pickle.loads(stream.read(int.from_bytes(n, "little")))
                try:
                    answer = (functions[k](x), None)
                    pickle.dumps(answer)
                except Exception as problem:  # noqa: BLE001  any failure of a step is data
                    answer = (None, f"{type(problem).__name__}: {problem}")
                send(answer)

    def end(pid: int) -> None:
        os.kill(pid, signal.SIGKILL)  # not yet waited for, so the number is still its own
        os.waitpid(pid, 0)

    while True:
        name, fds, *_ = socket.recv_fds(channel, 1, 1)
        if not name:
            break
        if name in held:
            end(held.pop(name))
        if (pid := os.fork()) == 0:
            try:
                work(fds[0])
            finally:
                os._exit(1)
        held[name] = pid
        os.close(fds[0])
    for pid in held.values():
        end(pid)


def fallback_map(df: DataFrame, column: str, steps: list[Callable], result: str, seconds: float | None = None) -> DataFrame:
    """UDF-03, UDF-06: adds value, step (the place of the first step that did not fail) and error (of all steps, where all
    failed). With seconds, steps run in child processes of the task that are killed when their time is up, and started anew, so that
    code which ignores signals cannot hold a task; rows that hang wait beside each other, and rows are dealt evenly to as many tasks as there are
    cores, as a small file of them may hold hours of waiting. Null input gives nulls."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import IntegerType, StringType, StructField, StructType

    value = df.sparkSession.createDataFrame([], f"value {result}").schema.fields[0]
    schema = StructType([*df.schema.fields, value, StructField("step", IntegerType()), StructField("error", StringType())])
    arrow, at = to_arrow_schema(schema), df.columns.index(column)

    def run(batches):
        children = Children(steps, seconds) if seconds else None
        try:
            for batch in batches:
                values = batch[at].to_pylist()
                out = children.run(values) if children else [tried(x) for x in values]
                v, k, e = zip(*out, strict=True) if out else ((), (), ())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(v, arrow.field("value").type), pa.array(k, pa.int32()), pa.array(e, pa.string())], schema=arrow)
        finally:
            if children:
                children.close()

    def tried(x) -> tuple:
        errors = []
        for k, fn in enumerate(steps if x is not None else []):
            try:
                return fn(x), k, None
            except Exception as problem:  # noqa: BLE001
                errors.append(f"{type(problem).__name__}: {problem}"[:200])
        return None, None, "; ".join(errors) if errors else None

    if seconds:
        df = df.repartition(df.sparkSession.sparkContext.defaultParallelism)
    return df.mapInArrow(run, schema)


def least_squares(sums, seed: int):
    """A model for fit_predict: linear with an intercept; the seed is not needed."""
    import numpy as np

    return heads.ridge_weights(sums, np.zeros(1))[0]


def fit_predict(df: DataFrame, task: str, x: str, y: str, test: str, fit: Callable, width: int, members: int = 1) -> DataFrame:
    """UDA-01..03: task, y and prediction of the test rows. In each task fit(sums, seed) learns a linear model (weights, the intercept
    first) of width features from the other rows with a label, its target standardised (a deviation below 1e-8 counts as 1); predictions of
    members, which differ by seed, are averaged. A task without training rows has null predictions. sums are those of products of (1, features, target)
    over all rows of a task, added up by any number of Spark's tasks: no task's rows ever meet in one place."""
    import numpy as np

    key = F.coalesce(F.concat(F.lit("="), F.col(task).cast("string")), F.lit(""))  # rows with a null task are a task
    rows = df.select(F.col(task).alias("task"), F.col(x).alias("x"), F.col(y).cast("double").alias("y"), F.coalesce(F.col(test), F.lit(False)).alias("test"), key.alias("_task"))
    train = rows.where(~F.col("test") & F.col("y").isNotNull() & ~F.isnan("y"))
    std = F.stddev_pop("y")
    scale = written(train.groupBy("_task").agg(F.avg("y").alias("_mean"), F.when(std < 1e-8, 1.0).otherwise(std).alias("_std")))
    standard = train.join(scale, "_task").select("_task", "x", ((F.col("y") - F.col("_mean")) / F.col("_std")).alias("y"), F.lit(0).alias("_fold"))
    shift = heads.centers(standard, "_task", "x", "y", width)
    center = np.array(shift)

    def solve(batches):
        for batch in batches:
            weights = []
            for m in batch.column(1).to_pylist():
                sums = heads.matrix(m, (width + 2) ** 2).reshape(width + 2, width + 2)
                w = np.mean([fit(sums, seed) for seed in range(members)], axis=0)
                w[0] += center[-1] - w[1:] @ center[:-1]
                weights.append(w.tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(weights, pa.list_(pa.float64()))], ["_task", "weights"])

    sums = heads.moments(standard, "_task", "x", "y", "_fold", width, shift)
    models = written(sums.select(F.col("task").alias("_task"), "m").mapInArrow(solve, "_task string, weights array<double>").join(scale, "_task"))
    guess = heads.linear(F.col("x"), F.col("weights")) * F.col("_std") + F.col("_mean")
    return rows.where("test").join(models, "_task", "left").select("task", "y", guess.alias("prediction"))


def per_task(df: DataFrame, task: str, fn: Callable, schema: str) -> DataFrame:
    """UDA-01..03: any fit and predict per task; fn takes and returns a pandas frame. Tasks must fit a worker."""
    return df.groupBy(task).applyInPandas(fn, schema)


def expand_ngrams(df: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """UDT-01: one row for each n-word window: key, pos, ngram."""
    words = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")
    k = F.size("_w") - (n - 1)
    grams = F.transform(F.when(k > 0, F.sequence(F.lit(0), k - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.array_join(F.slice("_w", i + 1, n), " "))
    return df.select(key, words.alias("_w")).select(key, F.posexplode(grams).alias("pos", "ngram"))
