"""Every query by name, with the SQL that states the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import corpus, evaluation, graphs, registry, roundtrips, samples, streams  # noqa: F401  importing registers


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Corpus preparation in miniature: de-duplicate, route listed keys, enrich, shard, count."""
    return registry.QUERIES["corpus_preparation"](spark, folder)


def queries() -> dict:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
