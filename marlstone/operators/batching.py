"""Batches and multi-source samples."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ragged import row_numbers


def budget_pack(df: DataFrame, group: str, order: list[str], size: str, budget: int) -> DataFrame:
    """WIN-09, T22: greedy batches in order within each group; adds batch (0, 1, ...).

    A row of at least budget flushes the open batch and stands alone; otherwise a row that would
    overflow opens a new batch. The fold is sequential in a group, so groups must be shards of bounded size (of
    ragged.fixed_ranges, say) and not a column that may hold a third of all rows."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import LongType, StructType

    schema = StructType([*df.schema.fields]).add("batch", LongType())
    arrow = to_arrow_schema(schema)

    def run(table):
        table = table.sort_by([(c, "ascending") for c in order])
        batch, used, out = -1, None, []
        for n in table[size].to_pylist():
            n = n or 0
            if n >= budget:
                batch, used = batch + 1, None
            elif used is None or used + n > budget:
                batch, used = batch + 1, n
            else:
                used += n
            out.append(batch)
        return pa.Table.from_arrays([*table.columns, pa.array(out, pa.int64())], schema=arrow)

    return df.groupBy(group).applyInArrow(run, schema)


def stripe(batches: DataFrame, world: int) -> DataFrame:
    """WIN-10: batch numbers 0..n-1 dealt over ranks; the first batches are repeated until all ranks have as many."""
    n = batches.agg(F.count("*")).first()[0]
    pad = -n % world if n else 0
    extra = batches.where(F.col("batch") < pad).withColumn("slot", F.col("batch") + n)
    if n < pad:  # fewer batches than padding: cycle
        times = F.explode(F.expr(f"sequence({n} + batch, {n + pad - 1}, {n})"))
        extra = batches.where(F.col("batch") < pad).select("*", times.alias("slot"))
    return batches.withColumn("slot", F.col("batch")).unionByName(extra).withColumn("rank", (F.col("slot") % world).cast("long")).withColumn("step", F.floor(F.col("slot") / world))


def cycle_batches(df: DataFrame, key: str, batch_size: int, n_batches: int, seed: int) -> DataFrame:
    """WIN-11, T24: n_batches of batch_size ids, cycling over seeded permutations of the pool, one a epoch."""
    n = df.count()
    epochs = -(-batch_size * n_batches // n) if n else 0
    pool = df.select(key).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max(epochs - 1, 0))))) if n else df.select(key).withColumn("epoch", F.lit(0))
    order = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}-"), F.col("epoch").cast("string")))
    # epochs follow each other and are as long as the pool, so one numbering of all of them serves
    numbered = row_numbers(pool.withColumn("_order", order), ["epoch", "_order", key], name="_at").drop("_order").where(F.col("_at") < batch_size * n_batches)
    return numbered.select(key, "epoch", F.floor(F.col("_at") / batch_size).alias("batch"), (F.col("_at") % batch_size).alias("slot"))


def zip_cycling(main: DataFrame, other: DataFrame, n_other: int) -> DataFrame:
    """JOI-16: each main batch with one batch of the other source, which starts again when it is used up."""
    return main.withColumn("other_batch", F.col("batch") % n_other).join(other.withColumnRenamed("batch", "other_batch"), "other_batch")


def outer_union(sources: dict[str, DataFrame], main: str) -> DataFrame:
    """SET-05, T20: union by name with nulls for absent columns, the main source first, the others in order of name; adds source and source_order."""
    names = [main, *sorted(k for k in sources if k != main)]
    parts = [sources[k].select("*", F.lit(k).alias("source"), F.lit(i).alias("source_order")) for i, k in enumerate(names)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def epoch_total(df: DataFrame, size: str, steps: int, order: str) -> DataFrame:
    """AGG-23: total size seen in steps items when the list is cycled in order: q whole rounds and the first r."""
    numbered = row_numbers(df, order, name="_rn").withColumn("_rn", F.col("_rn") + 1)
    total = numbered.agg(F.count("*").alias("n"), F.sum(size).alias("s"))
    q, r = F.floor(F.lit(steps) / F.col("n")), F.lit(steps) % F.col("n")
    return numbered.crossJoin(F.broadcast(total)).groupBy().agg((F.max(q) * F.max("s") + F.coalesce(F.sum(F.when(F.col("_rn") <= r, F.col(size))), F.lit(0))).alias("total"))
