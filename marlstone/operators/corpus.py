"""Corpus preparation: de-duplication, exclusion of benchmark keys, enrichment, split and shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import bucket, seeded_order


def keep_first(df: DataFrame, keys: list[str], order: list[str], copies: str | None = None) -> DataFrame:
    """WIN-01, FIL-01: one row per non-null key, the least by order; copies: a column for how many rows had the key.

    An aggregate of a struct, not a window: copies shrink before the shuffle, so a key that holds
    a third of all rows costs one row a task. order should end in a unique column (T4)."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    present = df.where(F.expr(" and ".join(f"`{k}` is not null" for k in keys)))
    best = present.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("_best"), *([F.count("*").alias(copies)] if copies else []))
    return best.select(*[F.col(c) if c in keys else F.col("_best")[c].alias(c) for c in df.columns], *([copies] if copies else []))


def pick_columns(df: DataFrame, keys: list[str], columns: list[str], by: Column) -> DataFrame:
    """AGG-01: each column's value at the least content hash among the rows where it is not null (T2)."""
    h = df.where(F.expr(" and ".join(f"`{k}` is not null" for k in keys))).withColumn("_h", by)
    return h.groupBy(*keys).agg(*[F.expr(f"min_by(`{c}`, _h) filter (where `{c}` is not null)").alias(c) for c in columns])


def pick_rows(df: DataFrame, keys: list[str], columns: list[str], by: Column) -> DataFrame:
    """AGG-01, row-consistent: all columns from the row with the least content hash."""
    h = df.where(F.expr(" and ".join(f"`{k}` is not null" for k in keys))).withColumn("_h", by)
    best = h.groupBy(*keys).agg(F.min_by(F.struct(*columns), "_h").alias("_row"))
    return best.select(*keys, *[F.col("_row")[c].alias(c) for c in columns])


def key_set(df: DataFrame, column: str, name: str = "key") -> DataFrame:
    """SRC-03, SRC-11: distinct non-null keys."""
    return df.select(F.col(column).alias(name)).where(F.col(name).isNotNull()).distinct()


def drop_listed(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """JOI-01: rows whose key is not listed; null keys stay. Spark broadcasts the list only below its size threshold."""
    return df.join(keys.toDF(column), column, "left_anti")


def only_listed(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """JOI-04: rows whose key is listed."""
    return df.join(keys.toDF(column), column, "left_semi")


def flag_listed(df: DataFrame, keys: DataFrame, column: str, flag: str = "listed") -> DataFrame:
    """JOI-03: adds whether the key is listed."""
    marked = keys.toDF(column).withColumn(flag, F.lit(True))
    return df.join(marked, column, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def route(df: DataFrame, keys: DataFrame, column: str, fraction: float, seed: int, shards: int) -> DataFrame:
    """JOI-03, STR-02, T12, T25: adds is_val (listed, or the seeded hash falls below the truncated percentage) and shard_id (0 for validation)."""
    percent = int(fraction * 100)
    flagged = flag_listed(df, keys, column, "_listed")
    val = F.col("_listed") | (bucket(100, column, F.lit(str(seed))) < percent)
    return flagged.withColumn("is_val", val).withColumn("shard_id", F.when(F.col("is_val"), 0).otherwise(bucket(shards, column))).drop("_listed")


def enrich(df: DataFrame, extra: DataFrame, on: str, needed: list[str] | None = None) -> DataFrame:
    """JOI-02, FIL-02: left join; with needed, only the rows where all those columns are present."""
    out = df.join(extra, on, "left")
    return out.where(F.expr(" and ".join(f"`{c}` is not null" for c in needed))) if needed else out


def assign_shard(df: DataFrame, column: str, shards: int) -> DataFrame:
    """PRJ-01: adds shard_id."""
    return df.withColumn("shard_id", bucket(shards, column))


def shuffled_in_shard(df: DataFrame, key: str, seed: int, shard: str = "shard_id") -> DataFrame:
    """SRT-01: physical order for writing: one partition a shard, rows in seeded order."""
    return df.repartition(shard).sortWithinPartitions(shard, seeded_order(key, seed), key)


def shard_counts(df: DataFrame, shard: str = "shard_id") -> DataFrame:
    """AGG-04."""
    return df.groupBy(shard).agg(F.count("*").alias("n"))


def counts(df: DataFrame, conditions: dict[str, Column], distinct: dict[str, str] | None = None) -> DataFrame:
    """AGG-02, AGG-03: one row of counts under conditions and exact distinct counts, in one pass."""
    aggs = [F.count_if(c).alias(n) for n, c in conditions.items()]
    aggs += [F.countDistinct(c).alias(n) for n, c in (distinct or {}).items()]
    return df.agg(F.count("*").alias("n_rows"), *aggs)


def remaining(df: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    """SET-03, FIL-17: what is not done yet."""
    return df.join(done.select(*on).distinct(), on, "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """JOI-12, SNK-13: rows of new replace rows of old with the same key and add the others."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def merge_keep_first(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """SET-02: union in order of parts; the first part that has a key wins, its rows by all columns."""
    tagged = [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
    union = tagged[0]
    for t in tagged[1:]:
        union = union.unionByName(t)
    return keep_first(union, keys, ["_part"] + [c for c in parts[0].columns if c not in keys]).select(*parts[0].columns)


def overriding_merge(base: DataFrame, over: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """JOI-11: full outer merge; a row of over replaces the row of base."""
    b = base.select(*keys, F.struct(*values).alias("_b"))
    o = over.select(*keys, F.struct(*values).alias("_o"))
    return b.join(o, keys, "full").select(*keys, *[F.coalesce(F.col("_o"), F.col("_b"))[v].alias(v) for v in values])


def first_present(df: DataFrame, fallback: DataFrame, on: str, value: str) -> DataFrame:
    """JOI-05, JOI-13: the own value, else the fallback's."""
    f = fallback.select(on, F.col(value).alias("_f"))
    return df.join(f, on, "left").withColumn(value, F.coalesce(value, "_f")).drop("_f")


def lookup(df: DataFrame, table: DataFrame, on: str, value: str, default: Column) -> DataFrame:
    """JOI-06, JOI-07, JOI-08: left lookup in order of df, with found (validity) and default for misses."""
    t = table.select(on, F.col(value).alias("_v"))
    return df.join(t, on, "left").withColumn("found", F.col("_v").isNotNull()).withColumn(value, F.coalesce("_v", default)).drop("_v")


def cached(df: DataFrame, cache: DataFrame, on: str, value: str, compute, zero: Column) -> DataFrame:
    """JOI-08: value of each row from the cache; of keys that it lacks, computed once by compute(distinct keys), which may
    leave some out; zero for those. Adds origin: cache, computed or zero."""
    hits = df.join(cache.select(on, F.col(value).alias("_c")), on, "left")
    missing = hits.where(F.col("_c").isNull() & F.col(on).isNotNull()).select(on).distinct()
    made = compute(missing).select(on, F.col(value).alias("_m"))
    both = hits.join(made, on, "left")
    origin = F.when(F.col("_c").isNotNull(), "cache").when(F.col("_m").isNotNull(), "computed").otherwise("zero")
    return both.withColumn("origin", origin).withColumn(value, F.coalesce("_c", "_m", zero)).drop("_c", "_m")


def least_by(df: DataFrame, key: str, energy: str, columns: list[str]) -> DataFrame:
    """SRT-05: the columns of the row with the least energy of each key; of equals the least row."""
    best = df.where(F.col(energy).isNotNull()).groupBy(key).agg(F.min(F.struct(energy, *columns)).alias("_b"))
    return best.select(key, *[F.col("_b")[c].alias(c) for c in (energy, *columns)])
