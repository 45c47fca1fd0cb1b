"""Filter interaction audit: what each filter removes in every order of the filters.

Each document becomes a mask of the filters that it fails; all that follows needs only the number of documents of each
mask, part and label. One aggregate by part gives these cells. The orders are then visited by adjacent transpositions
(the plain changes of Steinhaus, Johnson and Trotter): a swap of two neighbours moves the documents that fail both, and
no earlier filter, from one of the two steps to the other, and leaves all other steps alone. Shapley sums grow along the walk.

Filters are native conditions of the text, and one may be "identical to the text of a smaller id anywhere". That one
needs the least id of each text: rows go out as digests of 128 bits, copies are counted before they are shuffled, and
the rows that are left of one text are at most one for each part and label.

Null texts are empty texts, null parts the empty part. A null id sorts after all others, has no label, and is not smaller
than another null id; rows that repeat an id are rows of their own, none smaller than the other. Labels that repeat
an id count if any row has them. An empty table has no parts and gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACES, let, split_words

MOST_FILTERS = 7  # 5,040 orders; the result has one row for each part, order and step
PARTS = 64  # parts whose walk is done side by side


def text_conditions(text: Column) -> dict[str, Column]:
    """The filters of the audit query: name to the condition under which a text fails."""
    text = F.coalesce(text, F.lit(""))
    words = split_words(text, SPACES)
    few = let(words, lambda w: F.struct((F.size(w) < 200).alias("a"), (100 * F.size(F.array_distinct(w)) < 50 * F.size(w)).alias("b")))
    capitals = F.char_length(text) - F.char_length(F.regexp_replace(text, "[A-Z]+", ""))
    return {"A": few["a"], "B": few["b"], "C": 100 * capitals > 2 * F.char_length(text), "D": text.rlike("[#$%&*|]")}


def plain_changes(n: int) -> list[int]:
    """The neighbours (place and the next) to swap, one after another, to visit all orders of n things."""
    if n < 2:
        return []
    inner, out = plain_changes(n - 1), []
    for k in range(len(inner) + 1):
        out += range(n - 1) if k % 2 else range(n - 2, -1, -1)
        out += [inner[k] + 1 - k % 2] if k < len(inner) else []
    return out


def walk(cells: np.ndarray, n: int):
    """Yields (order, removed, before) for each order of n filters, then returns the Shapley sums by filter.

    cells: counts by mask in the first axis, other axes free. removed and before: by step, what the step removes and the
    bits of the steps ahead of it. The arrays are changed in place by the next step of the walk."""
    masks = np.arange(1 << n)
    order, before = list(range(n)), [(1 << k) - 1 for k in range(n)]
    removed = [cells[(masks & before[k] == 0) & (masks >> k & 1 == 1)].sum(0) for k in range(n)]
    shapley = np.zeros((n, *cells.shape[1:]), cells.dtype)
    for at in [None, *plain_changes(n)]:
        if at is not None:
            a, b = order[at], order[at + 1]
            both = 1 << a | 1 << b
            moved = cells[(masks & before[at] == 0) & (masks & both == both)].sum(0)
            order[at], order[at + 1] = b, a
            removed[at], removed[at + 1] = removed[at + 1] + moved, removed[at] - moved
            before[at + 1] = before[at] | 1 << b
        for k, f in enumerate(order):
            shapley[f] += removed[k]
        yield order, removed, before
    return shapley


def _report(names: list[str], flags: list[str]):
    """Rows of the audit from one row a part with its cells."""
    n, wide = len(names), 1 + len(flags)
    fields = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", *flags, "shapley"]
    kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * (len(fields) - 3)]
    schema = pa.schema(list(zip(fields, kinds, strict=True)))

    def some(batch: pa.RecordBatch) -> pa.RecordBatch:
        cells = np.zeros((1 << n, batch.num_rows, wide), np.int64)
        lists = batch.column(1)
        of = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
        cell = lists.flatten()
        mask = cell.field("_mask").to_numpy(zero_copy_only=False)
        for k, name in enumerate(["_n", *flags]):
            cells[mask, of, k] = cell.field(name).to_numpy(zero_copy_only=False)
        total, fails = cells.sum(0)[:, 0], [cells[np.arange(1 << n) >> f & 1 == 1].sum(0)[:, 0] for f in range(n)]
        orders, steps, numbers, filters = [], [], [], []
        visits = walk(cells, n)
        try:
            while True:
                order, removed, _ = next(visits)
                kept = total
                for k, f in enumerate(order):
                    gone = removed[k]
                    kept = kept - gone[:, 0]
                    orders.append("".join(names[x] for x in order))
                    steps.append(k + 1)
                    filters.append(f)
                    numbers.append(np.stack([kept, gone[:, 0], fails[f] - gone[:, 0], cells[1 << f][:, 0], *[gone[:, j] for j in range(1, wide)]]))
        except StopIteration as end:
            shapley = end.value
        table = np.stack(numbers)  # place in the walk, measure, part
        parts = batch.num_rows
        sums = np.stack([shapley[f][:, 0] for f in filters])
        columns = [batch.column(0).take(pa.array(np.tile(np.arange(parts), len(orders)))), pa.array(np.repeat(np.array(orders, object), parts)), pa.array(np.repeat(np.array(steps, np.int32), parts))]
        columns += [pa.array(table[:, j].ravel()) for j in range(table.shape[1])] + [pa.array(sums.ravel())]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, PARTS):
                yield some(batch.slice(at, PARTS))

    spark = "part string, filter_order string, step int, " + ", ".join(f"`{f}` long" for f in fields[3:])
    return run, spark


def cells_of(df: DataFrame, conditions: dict[str, Column], duplicates: str | None, labels: DataFrame, flags: dict[str, Column], key: str, text: str, part: str) -> DataFrame:
    """_part, _mask, _n and for each flag the number of documents that have it; bits of the mask in order of conditions, then duplicates."""
    mask = sum((F.when(c, F.lit(1 << k)).otherwise(0) for k, c in enumerate(conditions.values())), F.lit(0))
    digest = F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))) if duplicates else F.lit(None).cast("binary")
    # a null id finds no label, so it is dealt by its text
    slim = df.select(F.col(key).alias("_id"), digest.alias("_h"), mask.cast("int").alias("_mask"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("_part"))
    slim = slim.withColumn("_to", F.when(F.col("_id").isNotNull(), F.xxhash64("_id")).otherwise(F.xxhash64("_h", "_part", "_mask")))
    rows = slim.groupBy("_to", "_id", "_h", "_part", "_mask").agg(F.count("*").alias("_n"))
    own = labels.select(F.col(key).alias("_id"), *[F.coalesce(c, F.lit(False)).cast("int").alias(f) for f, c in flags.items()]).where("_id is not null")
    marked = own.groupBy("_id").agg(*[F.max(f).alias(f) for f in flags]).withColumn("_to", F.xxhash64("_id")) if flags else None
    rows = rows.join(marked, ["_to", "_id"], "left").fillna(0, list(flags)) if flags else rows
    if duplicates:
        place = F.struct(F.col("_id").isNull().alias("last"), F.col("_id").alias("id"))
        copies = rows.groupBy("_h", "_part", "_mask", *flags).agg(F.sum("_n").alias("_n"), F.min(F.struct(place.alias("place"), F.col("_n").alias("c"))).alias("least"))
        least = F.min("least.place").over(W.partitionBy("_h"))
        first = F.when(F.col("least.place").eqNullSafe(least), F.col("least.c")).otherwise(0)
        split = copies.withColumn("_first", first)
        bit = 1 << len(conditions)
        both = F.array(F.struct(F.col("_mask"), F.col("_first").alias("_n")), F.struct((F.col("_mask") + bit).alias("_mask"), (F.col("_n") - F.col("_first")).alias("_n")))
        rows = split.select("_part", *flags, F.explode(both).alias("b")).select("_part", *flags, "b._mask", "b._n").where("_n > 0")
    return rows.groupBy("_part", "_mask").agg(F.sum("_n").alias("_n"), *[F.sum(F.col(f) * F.col("_n")).alias(f) for f in flags])


def filter_audit(df: DataFrame, conditions: dict[str, Column], labels: DataFrame, flags: dict[str, Column], duplicates: str | None = None, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, one column for each flag (documents removed by the
    step that have it), shapley: for each part, order of the filters and step.

    conditions: one-letter name to failure condition over df; duplicates: the name of the filter "same text as a
    smaller id", last in the alphabet of orders; flags: name to condition over labels, which has the same key."""
    names = [*conditions, *([duplicates] if duplicates else [])]
    if taken := set(flags) & {"part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "shapley"}:
        raise ValueError(f"columns of the result cannot be flags: {', '.join(sorted(taken))}")
    if len(names) > MOST_FILTERS:
        raise ValueError(f"{len(names)} filters have too many orders, {MOST_FILTERS} at most")
    cells = cells_of(df, conditions, duplicates, labels, flags, key, text, part)
    # at most one row for each mask meets in a part
    parts = cells.groupBy("_part").agg(F.collect_list(F.struct("_mask", "_n", *flags)).alias("cells"))
    run, schema = _report(names, list(flags))
    return parts.mapInArrow(run, schema)
