"""What the jobs share: settings, the canonical key of a text, command lines, logs and kept Spark settings."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from jobs.texts import keys_of
from marlstone.session import session

log = logging.getLogger("jobs")


def canonical_key(text: Column) -> Column:
    """The digest of the text in lower case (A-Z) with single spaces between words, by which texts are the same; null for a text without a word."""

    @F.arrow_udf(StringType())
    def key(x: pa.Array) -> pa.Array:
        return keys_of(x)

    return key.asNondeterministic()(text)  # else Spark makes a key twice where rows without one are filtered out


def settings_of(given: dict, defaults: dict) -> dict:
    """defaults overridden by given; an unknown or ill-typed setting is an error."""
    for k, v in given.items():
        if k not in defaults:
            raise ValueError(f"unknown setting {k}")
        if not isinstance(v, type(defaults[k])) and not (isinstance(defaults[k], float) and isinstance(v, int)):
            raise ValueError(f"{k} must be a {type(defaults[k]).__name__}")
    return defaults | given


@contextmanager
def kept_settings(spark: SparkSession, **changed: str):
    """Spark settings for the time of a job (keys use _ for .), restored afterwards whatever happens."""
    names = {"spark.sql.unionOutputPartitioning": "false", "spark.sql.execution.arrow.maxBytesPerBatch": "16m"} | {k.replace("_", "."): v for k, v in changed.items()}
    old = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def report(table: DataFrame, path: str, what: str, columns: dict[str, Column] | None = None) -> dict:
    """Rows (and other counts) of a table as it was written to path, logged."""
    row = table.agg(F.count("*").alias("rows"), *[c.alias(k) for k, c in (columns or {}).items()]).first().asDict()
    log.info("wrote %s to %s: %s", what, path, ", ".join(f"{k} {v}" for k, v in row.items()))
    return row


def command_line(description: str, paths: dict[str, str], defaults: dict, run: Callable[..., DataFrame], argv: list[str] | None = None) -> None:
    """Parses path arguments and the configuration file, starts a session, runs and stops it."""
    parser = argparse.ArgumentParser(description=description)
    for name, text in paths.items():
        parser.add_argument(f"--{name}", required=True, help=text)
    parser.add_argument("--config", help="JSON file of settings, read with Spark; those left out keep their defaults: " + json.dumps(defaults))
    parser.add_argument("--master", help="Spark master, where spark-submit has not set one")
    args = vars(parser.parse_args(argv))
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = session(args.pop("master"))
    try:
        config = args.pop("config")
        given = json.loads("\n".join(r[0] for r in spark.read.text(config, wholetext=True).collect())) if config else {}
        run(spark, **args, settings=given)
    finally:
        spark.stop()
