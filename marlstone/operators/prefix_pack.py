"""Greedy budget packing as a parallel prefix: an ordered group of any size, without a fold over its rows.

What a stretch of rows does to packing is a function of one number, the fill of the batch that is open when the stretch begins: it
says where the first new batch starts, and from there every next start is a jump that depends on the rows alone. Rows are
dealt by ranges of the order. Each task takes its rows block by block, finds the jumps by binary search in prefix sums, follows them
by doubling, and composes the blocks' functions; blocks are written with the function up to them. Folding the functions of the
ranges, one row a range, gives the fill at the start of each; then every block is numbered by itself. A function
has as many pieces as small rows go into a batch, and one that meets a new group is constant."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from ..session import written
from .ragged import changes

FULL = float("inf")  # the fill of "no batch is open": any row starts one
FIELDS = "high double, shift double, lower array<double>, used array<double>, count array<bigint>, fresh boolean"


class Fill:
    """From the fill where a range begins to (fill, batches started) at some place in it.

    Up to high, no batch starts and the fill grows by shift (high < 0: never so); above, piece k takes those beyond lower[k]. fresh: a new
    group has begun, so the result does not depend on the fill and counts the batches of that group."""

    def __init__(self, high, shift, lower, used, count, fresh):
        self.high, self.shift, self.fresh = high, shift, fresh
        self.lower, self.used, self.count = np.asarray(lower, float), np.asarray(used, float), np.asarray(count, np.int64)

    @classmethod
    def none(cls, budget: float) -> Fill:
        return cls(float(budget), 0.0, [budget], [FULL], [0], False)

    def at(self, fill: float) -> tuple[float, int]:
        if fill <= self.high:
            return fill + self.shift, 0
        k = np.searchsorted(self.lower, fill, side="left") - 1
        return float(self.used[k]), int(self.count[k])

    def then(self, block: Block) -> Fill:
        if block.forced.any():
            f = np.flatnonzero(block.forced)[-1]
            return Fill(-1.0, 0.0, [-1.0], [block.used[f]], [block.count[f]], True)
        j = block.entry(self.used)
        stays = j == block.n
        j0 = np.minimum(j, block.n - 1)
        used = np.where(stays, self.used + block.total, block.used[j0])
        count = self.count + np.where(stays, 0, block.count[j0])
        lower, high = self.lower, -1.0
        if self.high >= 0:
            k = np.arange(min(block.oversized, block.n - 1) + 1)
            low = np.where(k < block.oversized, block.budget - block.prefix[k] - self.shift, -1.0)
            top = np.minimum(self.high, np.r_[self.high, low[:-1]])
            k = k[(top >= 0) & (top > low)][::-1]
            lower = np.r_[np.maximum(low[k], -1.0), lower]
            used, count = np.r_[block.used[k], used], np.r_[block.count[k], count]
            if block.oversized == block.n:
                high = min(self.high, block.budget - block.total - self.shift)
        new = np.r_[True, (used[1:] != used[:-1]) | (count[1:] != count[:-1])]  # pieces that have become one
        return Fill(high if high >= 0 else -1.0, self.shift + block.total, lower[new], used[new], count[new], self.fresh)


class Block:
    """Rows in order. forced: rows that begin a group. used, count: what a batch that starts at a row leaves open at the end, and how
    many batches start from there on."""

    def __init__(self, sizes: np.ndarray, forced: np.ndarray, budget: float):
        n = self.n = len(sizes)
        self.budget, self.forced = float(budget), forced
        self.prefix = np.cumsum(sizes, dtype=float)
        self.total = self.prefix[-1]
        before = self.prefix - sizes
        over = sizes >= budget
        stops = np.flatnonzero(over | forced)
        following = np.r_[stops, n][np.searchsorted(stops, np.arange(n), side="right")]
        self.next = np.minimum(np.searchsorted(self.prefix, before + budget, side="right"), following)
        self.next[over] = np.flatnonzero(over) + 1
        self.oversized = int(np.flatnonzero(over)[0]) if over.any() else n
        jump, count, last = np.r_[self.next, n], np.r_[np.ones(n, np.int64), 0], np.arange(n + 1)
        while (jump[:n] < n).any():  # twice as far each time
            count, last = count + count[jump], np.where(jump < n, last[jump], last)
            jump = jump[jump]
        self.count, ends = count[:n], last[:n]
        self.used = np.where(over[ends], FULL, self.total - before[ends])

    def entry(self, fill):
        """The row at which the first batch starts (n: none) if the open batch holds fill."""
        fill = np.asarray(fill, float)
        j = np.minimum(np.searchsorted(self.prefix, self.budget - fill, side="right"), self.oversized)
        return np.where(np.isinf(fill), 0, j)

    def batches(self, fill: float, base: int) -> np.ndarray:
        """The batch of each row in its group, if base batches were started before in the group that is open."""
        starts = np.zeros(self.n, bool)
        for at in [int(self.entry(fill)), *np.flatnonzero(self.forced)]:
            while at < self.n and not starts[at]:
                starts[at] = True
                at = int(self.next[at])
        c = np.cumsum(starts)
        heads = np.flatnonzero(self.forced)
        out = base + c - 1
        if len(heads):
            which = np.searchsorted(heads, np.arange(self.n), side="right") - 1
            out = np.where(which >= 0, c - c[heads[which]], out)
        return out


def prefix_pack(df: DataFrame, order: list[str], size: str, budget: int, group: str | None = None, ranges: int | None = None) -> DataFrame:
    """WIN-09, T22: adds batch (0, 1, ... in each group) as batching.budget_pack does: in order, a row that would overflow the open batch
    starts a new one; a row of at least budget stands alone. A null size is 0. Groups may be of any size: rows are dealt by
    ranges of (group, order), which should tell rows apart, over ranges partitions (as many as a shuffle has)."""
    spark = df.sparkSession
    columns = df.columns
    keyed = df.withColumn("_group", F.col(group) if group else F.lit(0))
    inner = StructType(keyed.schema.fields)
    kind = inner["_group"].dataType.simpleString()
    head = f"_range int, _block int, _new boolean, _first {kind}, _last {kind}, _end boolean, {FIELDS}"
    schema = StructType([*StructType.fromDDL(head).fields, StructField("_rows", ArrayType(inner))])
    arrow = to_arrow_schema(schema)
    rows_type = arrow.field("_rows").type
    at_group, at_size = len(columns), columns.index(size)

    def sizes_of(column: pa.Array) -> np.ndarray:
        return np.asarray(column.cast(pa.float64()).fill_null(0))

    def fields_of(f: Fill) -> list:
        return [[f.high], [f.shift], [f.lower.tolist()], [f.used.tolist()], [f.count.tolist()], [f.fresh]]

    def blocks(batches):
        from pyspark import TaskContext

        place, k, fill, last = TaskContext.get().partitionId(), 0, Fill.none(budget), None
        first = None
        for batch in batches:
            if not batch.num_rows:
                continue
            forced = changes(batch.column(at_group), last)
            block = Block(sizes_of(batch.column(at_size)), forced, budget)
            names = [f.name for f in rows_type.value_type]
            rows = pa.StructArray.from_arrays([c.cast(f.type) for c, f in zip(batch.columns, rows_type.value_type, strict=True)], names=names)
            listed = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), rows)
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip([[place], [k], [bool(forced[0])], [None], [None], [False], *fields_of(fill)], arrow, strict=False)] + [listed.cast(rows_type)], schema=arrow)
            first = first or [batch.column(at_group)[0].as_py()]
            last = [batch.column(at_group)[-1].as_py()]
            fill, k = fill.then(block), k + 1
        if first:  # the whole range
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip([[place], [k], [False], first, last, [True], *fields_of(fill), [None]], arrow, strict=True)], schema=arrow)

    by = ["_group", *order]
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    store = written(keyed.repartitionByRange(n, *by).sortWithinPartitions(*by).mapInArrow(blocks, schema))

    entries_schema = StructType.fromDDL("_range int, _fill double, _base bigint")

    def fold(batches):
        fill, base, last = FULL, 0, None
        for batch in batches:
            t, out = batch.to_pydict(), []
            for i, place in enumerate(t["_range"]):
                if last is None or last[0] != t["_first"][i]:
                    fill, base = FULL, 0
                out.append((place, fill, base))
                f = Fill(*(t[c][i] for c in ("high", "shift", "lower", "used", "count", "fresh")))
                fill, count = f.at(fill)
                base, last = count + (0 if f.fresh else base), [t["_last"][i]]
            yield pa.RecordBatch.from_arrays([pa.array(c, a.type) for c, a in zip(zip(*out, strict=True), to_arrow_schema(entries_schema), strict=True)], schema=to_arrow_schema(entries_schema))

    # one row a range
    ends = store.where("_end").select("_range", "_first", "_last", "high", "shift", "lower", "used", "count", "fresh")
    entries = written(ends.repartition(1).sortWithinPartitions("_range").mapInArrow(fold, entries_schema))

    result = StructType([*df.schema.fields]).add("batch", LongType())
    result_arrow = to_arrow_schema(result)

    def number(batches):
        for batch in batches:
            t = {c: batch.column(c) for c in batch.schema.names}
            for i in range(batch.num_rows):
                f = Fill(*(t[c][i].as_py() for c in ("high", "shift", "lower", "used", "count", "fresh")))
                fill, count = f.at(t["_fill"][i].as_py())
                base = count + (0 if f.fresh else t["_base"][i].as_py())
                rows = t["_rows"][i].values
                own = [rows.field(c) for c in range(len(columns))]
                forced = changes(rows.field(at_group), None)
                forced[0] = t["_new"][i].as_py()
                numbers = Block(sizes_of(own[at_size]), forced, budget).batches(fill, base)
                yield pa.RecordBatch.from_arrays([*[c.cast(f.type) for c, f in zip(own, result_arrow, strict=False)], pa.array(numbers, pa.int64())], schema=result_arrow)

    placed = store.where("not _end").join(F.broadcast(entries), "_range")
    return placed.select("_new", "high", "shift", "lower", "used", "count", "fresh", "_rows", "_fill", "_base").mapInArrow(number, result)
