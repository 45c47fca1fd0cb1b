"""Feature coding, task registries, packed arrays and reduction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import encode
from .ragged import row_numbers


def code_columns(df: DataFrame, vocabularies: dict[str, list[str]], keep: list[str]) -> DataFrame:
    """GRA-08, ARR-02: keep, and codes: each vocabulary column's place, unknown is the vocabulary's length."""
    return df.select(*keep, F.array(*[encode(F.col(c).cast("string"), v).cast("short") for c, v in vocabularies.items()]).alias("codes"))


def with_dimension(df: DataFrame, dim: DataFrame, on: str, columns: list[str], default: float = 0.0) -> DataFrame:
    """GRA-08, JOI-15, SRC-18: columns of a small dimension by key, gaps as default."""
    d = dim.select(on, *columns)
    return df.join(d, on, "left").withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(default)) for c in columns})


def fill_sentinel(x: Column, real: Column, fill: Column, sentinel: float = 0.0) -> Column:
    """FIL-15: the sentinel becomes fill on real rows only."""
    return F.when((x == sentinel) & real, fill).otherwise(x)


def has_edges(edges: Column) -> Column:
    """FIL-18."""
    return F.size(edges) > 0


def complete_rows(df: DataFrame, columns: list[str], keys: DataFrame, on: str) -> DataFrame:
    """FIL-13: rows without gaps whose key is listed."""
    return df.dropna(subset=columns).join(keys, on, "left_semi")


#: Fixed values, EXT-01: loss to metric, outputs and whether higher is better.
LOSSES = {"huber": ("mae", 1, False), "log_huber": ("mae", 1, False), "log_ratio_squared": ("mae", 1, False), "beta_nll": ("mae", 2, False), "ordinal": ("acc", 1, True), "focal": ("auroc", 1, True)}


def task_registry(spark: SparkSession, losses: dict[str, str], exclude_losses: tuple[str, ...] = (), exclude_infixes: tuple[str, ...] = ()) -> DataFrame:
    """EXT-05, FIL-09: task, loss, metric, n_outputs, higher_is_better of the tasks that are not excluded; unknown losses raise ValueError."""
    if unknown := sorted(set(losses.values()) - set(LOSSES)):
        raise ValueError(f"unknown losses: {', '.join(unknown)}")
    rows = [(t, loss, *LOSSES[loss]) for t, loss in losses.items() if loss not in exclude_losses and not any(f"_{x}_" in t for x in exclude_infixes)]
    return spark.createDataFrame(rows, "task string, loss string, metric string, n_outputs int, higher_is_better boolean")


def register(tasks: DataFrame, exclude_losses: tuple[str, ...] = (), exclude_infixes: tuple[str, ...] = (), task: str = "task", loss: str = "loss") -> DataFrame:
    """EXT-01, EXT-05, FIL-09: the same from a table of any number of tasks and losses; a row with an unknown loss fails the query."""
    known = F.create_map(*[c for k, (metric, n, higher) in LOSSES.items() for c in (F.lit(k), F.struct(F.lit(metric).alias("metric"), F.lit(n).alias("n_outputs"), F.lit(higher).alias("higher_is_better")))])
    named = tasks.select(F.col(task).alias("task"), F.col(loss).alias("loss"))
    dropped = reduce(lambda a, b: a | b, [F.contains("task", F.lit(f"_{x}_")) for x in exclude_infixes], F.col("loss").isin(list(exclude_losses)))
    entry = F.coalesce(F.try_element_at(known, F.col("loss")), F.raise_error(F.concat(F.lit("unknown loss: "), F.col("loss"))))
    return named.where(~F.coalesce(dropped, F.lit(False))).select("task", "loss", entry.alias("e")).select("task", "loss", "e.*")


def expand_assays(registry: DataFrame, assays: DataFrame, prefix: str, name: str = "assay") -> DataFrame:
    """EXT-05: adds a task prefix/name for each assay of a table, with its place in order of name as assay_idx."""
    numbered = row_numbers(assays.select(F.col(name).alias("_name")).where("_name is not null").distinct(), "_name", name="assay_idx")
    metric, n, higher = LOSSES["focal"]
    more = numbered.select(F.concat(F.lit(f"{prefix}/"), F.col("_name")).alias("task"), F.lit("focal").alias("loss"), F.lit(metric).alias("metric"), F.lit(n).alias("n_outputs"), F.lit(higher).alias("higher_is_better"), F.col("assay_idx").cast("int").alias("assay_idx"))
    return registry.unionByName(more, allowMissingColumns=True)


def group_assays(registry: DataFrame, prefix: str, names: list[str], expand: bool) -> DataFrame:
    """EXT-05: adds one task for a source's assays, or one for each (prefix/name, with assay_idx)."""
    spark = registry.sparkSession
    rows = [(f"{prefix}/{n}", "focal", "auroc", 1, True, i) for i, n in enumerate(names)] if expand else [(prefix, "focal", "auroc", len(names), True, None)]
    more = spark.createDataFrame(rows, "task string, loss string, metric string, n_outputs int, higher_is_better boolean, assay_idx int")
    return registry.unionByName(more, allowMissingColumns=True)


def outputs_by_size(registry: DataFrame) -> DataFrame:
    """AGG-32: tasks of each direction and number of outputs, in order of name."""
    return registry.groupBy("higher_is_better", "n_outputs").agg(F.sort_array(F.collect_list("task")).alias("tasks"))


def pack_shard(nodes: DataFrame, shard: str, graph: str, order: list[str], value: str) -> DataFrame:
    """GRA-09, SNK-05: one row a shard: graphs, node_ptr (a leading 0) and the values of all nodes end to end.
    A shard is as large as its writer chose; shards are the unit of packing."""
    per = nodes.groupBy(shard, graph).agg(F.sort_array(F.collect_list(F.struct(*order, value))).alias("v"))
    one = per.select(shard, F.struct(F.col(graph).alias("g"), F.transform("v", lambda x: x[value]).alias("v")).alias("x")).groupBy(shard).agg(F.sort_array(F.collect_list("x")).alias("x"))
    sizes = F.transform("x", lambda g: F.size(g["v"]))
    ptr = F.aggregate(sizes, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
    return one.select(shard, F.transform("x", lambda g: g["g"]).alias("graphs"), ptr.alias("node_ptr"), F.flatten(F.transform("x", lambda g: g["v"])).alias("values"))


def unpack_shard(packed: DataFrame, shard: str) -> DataFrame:
    """GRA-09: shard, graph, node, value again."""
    each = packed.select(shard, "node_ptr", "values", F.posexplode("graphs").alias("i", "graph"))
    own = F.slice("values", F.get("node_ptr", F.col("i")) + 1, F.get("node_ptr", F.col("i") + 1) - F.get("node_ptr", F.col("i")))
    return each.select(shard, "graph", F.posexplode(own).alias("node", "value"))


def principal_components(df: DataFrame, column: str, keep: float | int, name: str = "components") -> DataFrame:
    """ARR-06: centred projection onto the first components: their number, or as many as explain the share keep.

    The covariance is one distributed pass; only it (features squared) reaches the driver."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    d = len(df.select(column).where(F.col(column).isNotNull()).first()[0])
    v = df.withColumn("_v", array_to_vector(F.transform(column, lambda x: x.cast("double"))))
    v = StandardScaler(withMean=True, withStd=False, inputCol="_v", outputCol="_c").fit(v).transform(v)
    k = min(keep, max(1, min(df.count(), d) - 1)) if isinstance(keep, int) else d
    model = PCA(k=k, inputCol="_c", outputCol="_p").fit(v)
    if not isinstance(keep, int):
        share, k = 0.0, 0
        for x in model.explainedVariance:
            share, k = share + float(x), k + 1
            if share >= keep:
                break
    return model.transform(v).withColumn(name, F.slice(vector_to_array("_p"), 1, k)).drop("_v", "_c", "_p")
