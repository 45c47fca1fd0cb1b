"""Ragged arrays, offsets and order without a single-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import written


def prefix_sum(df: DataFrame, order: str | list[str | Column], value: Column, name: str, ties: list[str] | None = None, inclusive: bool = False, ranges: int | None = None) -> DataFrame:
    """WIN-02: running sum of value in order (then ties), exclusive unless said.

    Rows are dealt once by ranges of the order, as many as there are shuffle partitions, and summed up in each task as they
    stream through; the sums of ranges, one a task, are added to them. Rows equal in order and ties follow in any order."""
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import IntegerType, StructField, StructType

    spark = df.sparkSession
    valued = df.withColumn("_value", value)
    kind = "double" if dict(valued.dtypes)["_value"] in ("double", "float") else "long"
    valued = valued.withColumn("_value", F.col("_value").cast(kind))
    schema = StructType([*valued.schema.fields, StructField("_own", valued.schema["_value"].dataType), StructField("_range", IntegerType())])
    arrow = to_arrow_schema(schema)
    at = valued.columns.index("_value")

    def add(batches):
        place, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            v = np.asarray(batch[at].fill_null(0))
            run = np.cumsum(v) + total
            total = run[-1] if len(run) else total
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(run if inclusive else run - v), pa.array(np.full(len(v), place, np.int32))], schema=arrow)

    by = [*([order] if isinstance(order, str) else order), *(ties or [])]
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = written(valued.repartitionByRange(n, *by).sortWithinPartitions(*by).mapInArrow(add, schema))
    sums = rows.groupBy("_range").agg(F.sum("_value").alias("_s"))
    # one row a range
    before = sums.select("_range", F.coalesce(F.sum("_s").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + F.col("_own")).drop("_range", "_value", "_own", "_before")


def changes(values, before: list | None):
    """Where a value differs from the one before it, nulls being equal; before: a list of the value ahead of the first, None without any."""
    import numpy as np

    codes = values.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    out = np.r_[False, codes[1:] != codes[:-1]]
    out[0] = before is not None and values[0].as_py() != before[0]
    return out


def running_counts(counted: DataFrame, keys: list[str], value: str | Column, columns: list[str]) -> DataFrame:
    """Adds upto_<c> for each of columns: its sum over the rows of the same keys up to and with this one, in order of value, which
    no two rows of a key share. A key may hold any share of the rows: rows are dealt by ranges of (keys, value) and summed up in each task
    from where a key begins; only the key that a range begins with can have come before, and what it had is added from one row a range."""
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StructField, StructType

    spark = counted.sparkSession
    longs = counted.withColumns({c: F.coalesce(F.col(c).cast("long"), F.lit(0)) for c in columns})
    fields = [StructField(f.name, f.dataType) for f in longs.schema.fields]
    schema = StructType([*fields, *[StructField(f"upto_{c}", LongType()) for c in columns], StructField("_range", IntegerType()), StructField("_head", BooleanType()), StructField("_sums", ArrayType(LongType()))])
    arrow = to_arrow_schema(schema)
    at_keys, at = [longs.columns.index(k) for k in keys], [longs.columns.index(c) for c in columns]

    def summary(place: int, key: list, head: bool, sums: list | None) -> pa.RecordBatch:
        """The first key of a range (sums None), or the last one with its sums; head: the range has no other."""
        row = [None] * len(fields)
        for i, k in zip(at_keys, key, strict=True):
            row[i] = k
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip([*row, *[None] * len(columns), place, head, sums if sums is not None else []], arrow, strict=True)], schema=arrow)

    def add(batches):
        place, key, sums, alone = TaskContext.get().partitionId(), None, np.zeros(len(columns), np.int64), True
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.zeros(batch.num_rows, bool)
            for j, i in enumerate(at_keys):
                new |= changes(batch.column(i), None if key is None else [key[j]])
            if key is None:
                yield summary(place, [batch.column(i)[0].as_py() for i in at_keys], False, None)
            starts = np.flatnonzero(new)
            which = np.searchsorted(starts, np.arange(batch.num_rows), side="right") - 1  # -1: goes on with the key held
            upto = []
            for c, i in enumerate(at):
                v = np.asarray(batch.column(i))
                run = np.cumsum(v)
                before = np.r_[(run - v)[starts], -sums[c]][which]  # the last entry is that of which == -1
                upto.append(run - before)
            head = (which == -1) & alone
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, upto), pa.array(np.full(batch.num_rows, place, np.int32)), pa.array(head), pa.nulls(batch.num_rows, arrow.field("_sums").type)], schema=arrow)
            key, sums, alone = [batch.column(i)[-1].as_py() for i in at_keys], np.array([u[-1] for u in upto], np.int64), alone and not len(starts)
        if key is not None:
            yield summary(place, key, alone, sums.tolist())

    by = [*keys, value]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = written(longs.repartitionByRange(n, *by).sortWithinPartitions(*by).mapInArrow(add, schema))

    carry_schema = StructType([StructField("_range", IntegerType()), StructField("_carry", ArrayType(LongType()))])
    carry_arrow = to_arrow_schema(carry_schema)

    def fold(batches):
        last, have = None, [0] * len(columns)
        for batch in batches:
            t, out = batch.to_pydict(), []
            for i, place in enumerate(t["_range"]):
                key, sums = [t[k][i] for k in keys], t["_sums"][i]
                if not sums:  # a range begins
                    have = have if last == key else [0] * len(columns)
                    out.append((place, have))
                else:
                    have = [a + b for a, b in zip(have, sums, strict=True)] if t["_head"][i] else sums
                last = key
            places, carried = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(places, pa.int32()), pa.array(carried, pa.list_(pa.int64()))], schema=carry_arrow)

    # two rows a range: its first key, then its last
    ends = rows.where("_sums is not null").select(*keys, "_range", "_head", "_sums").repartition(1).sortWithinPartitions("_range", F.size("_sums"))
    carry = ends.mapInArrow(fold, carry_schema)
    found = rows.where("_sums is null").join(F.broadcast(carry), "_range")
    more = lambda i: F.when(F.col("_head"), F.get("_carry", F.lit(i))).otherwise(0)
    return found.withColumns({f"upto_{c}": F.col(f"upto_{c}") + more(i) for i, c in enumerate(columns)}).drop("_range", "_head", "_sums", "_carry")


def row_numbers(df: DataFrame, order: str | list[str | Column], ties: list[str] | None = None, name: str = "rn") -> DataFrame:
    """SRT-06, SRT-07: 0, 1, 2, ... in order."""
    return prefix_sum(df, order, F.lit(1), name, ties)


def chunks(df: DataFrame, order: str, n: int, ties: list[str] | None = None) -> DataFrame:
    """WIN-06: n balanced contiguous chunks, the first (rows mod n) one longer."""
    rows = row_numbers(df, order, ties, "_rn")
    total = df.count()
    q, r = divmod(total, n)
    long = r * (q + 1)
    small = F.lit(r) + ((F.col("_rn") - long) / F.lit(max(q, 1))).cast("long")
    return rows.withColumn("chunk", F.when(F.col("_rn") < long, (F.col("_rn") / (q + 1)).cast("long")).otherwise(small)).drop("_rn")


def fixed_ranges(df: DataFrame, order: str, size: int, ties: list[str] | None = None) -> DataFrame:
    """WIN-07: contiguous ranges of size rows, the last shorter."""
    return row_numbers(df, order, ties, "_rn").withColumn("part", F.floor(F.col("_rn") / size)).drop("_rn")


def group_shards(df: DataFrame, shard: str, every: int) -> DataFrame:
    """WIN-08: every so many consecutive shards become one group."""
    numbered = row_numbers(df.select(shard).distinct(), shard, name="_r")
    return df.join(numbered, shard).withColumn("grp", F.floor(F.col("_r") / every)).drop("_r")


def offsets(nodes: DataFrame, graph: str) -> DataFrame:
    """WIN-02, AGG-23, GRA-09: graph, n_nodes, node_ptr (exclusive prefix sum in order of graph)."""
    sizes = nodes.groupBy(graph).agg(F.count("*").alias("n_nodes"))
    return prefix_sum(sizes, graph, F.col("n_nodes"), "node_ptr")


def rebase(edges: DataFrame, ptr: DataFrame, graph: str) -> DataFrame:
    """PRJ-07, GRA-09: local src and dst to global ids."""
    return edges.join(ptr.select(graph, "node_ptr"), graph).withColumn("src_global", F.col("src") + F.col("node_ptr")).withColumn("dst_global", F.col("dst") + F.col("node_ptr")).drop("node_ptr")


def localise(edges: DataFrame, ptr: DataFrame, graph: str) -> DataFrame:
    """PRJ-07: the inverse of rebase."""
    return edges.join(ptr.select(graph, "node_ptr"), graph).withColumn("src", F.col("src_global") - F.col("node_ptr")).withColumn("dst", F.col("dst_global") - F.col("node_ptr")).drop("node_ptr", "src_global", "dst_global")


def align(values: Column, mask: Column) -> Column:
    """JOI-17: values onto the positions where mask is true, nulls elsewhere; as they are if already as
    long as the mask; all null if they fit neither."""
    n = F.size(mask)
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    before = lambda i: F.size(F.filter(F.slice(mask, 1, i + 1), lambda m: m)) - 1
    spread = F.transform(places, lambda i: F.when(F.get(mask, i), F.get(values, before(i))))
    hits = F.size(F.filter(mask, lambda m: m))
    return F.when(F.size(values) == hits, spread).when(F.size(values) == n, values).otherwise(F.transform(places, lambda i: F.get(values, F.lit(-1))))


def prefix_subset(df: DataFrame, order: str, ratio: float) -> DataFrame:
    """SRT-06: the first int(n ratio) rows, at least one."""
    n = max(1, int(df.count() * ratio))
    return row_numbers(df, order, name="_rn").where(F.col("_rn") < n).drop("_rn")
