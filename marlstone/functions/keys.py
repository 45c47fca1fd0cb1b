"""Portable keys, missing values and text helpers: the same in Spark and in any SQL engine with md5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash32(*parts: Column | str) -> Column:
    """STR-02: the first 32 bits of the md5 of the parts' text, as a non-negative number; null parts count as ''."""
    text = F.concat(*[F.coalesce(F.col(p) if isinstance(p, str) else p, F.lit("")).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def bucket(n: int, *parts: Column | str) -> Column:
    """STR-02, PRJ-01: hash shard 0..n-1."""
    return (hash32(*parts) % n).cast("int")


def seeded_order(key: Column | str, seed: int) -> Column:
    """SRT-01, SRT-08: a reproducible pseudo-random sort key."""
    return F.md5(F.concat((F.col(key) if isinstance(key, str) else key).cast("string"), F.lit(str(seed))))


def missing_to_null(x: Column) -> Column:
    """T6, FIL-08: NaN is a missing value."""
    return F.when(~F.isnan(x), x)


def finite(x: Column) -> Column:
    """AGG-14, ARR-05: null for NaN and infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def zero_padded(number: Column, count: int) -> Column:
    """STR-04: shard number at least three digits wide."""
    width = max(3, len(str(count - 1)))
    return F.when(F.length(number.cast("string")) < width, F.lpad(number.cast("string"), width, "0")).otherwise(number.cast("string"))


def shard_of_path(path: Column) -> Column:
    """STR-03, SRC-20: the digits before the suffix of a shard file, null without."""
    return F.nullif(F.regexp_extract(path, r"(\d+)\.[A-Za-z]+$", 1), F.lit("")).cast("int")


def number_or(x: Column, default: float) -> Column:
    """SRC-18: a table gap ('-', blank, text) becomes default."""
    return F.coalesce(x.try_cast("double"), F.lit(default))


def truthy(x: Column) -> Column:
    """STR-09: yes/no words as boolean, null for anything else."""
    w = F.lower(F.trim(x))
    return F.when(w.isin("true", "t", "yes", "y", "1"), True).when(w.isin("false", "f", "no", "n", "0"), False)


def parse_list(x: Column) -> Column:
    """STR-05: 'a, b,,c' to [a, b, c]."""
    return F.filter(F.transform(F.split(x, ","), lambda p: F.trim(p)), lambda p: p != "")


def parse_pairs(x: Column) -> Column:
    """STR-05: 'k:v,k:v' to a map of doubles."""
    return F.transform_values(F.str_to_map(x, F.lit(","), F.lit(":")), lambda _, v: F.trim(v).try_cast("double"))


def display_name(method: Column, exact: dict[str, str], prefixes: tuple[str, ...], suffixes: tuple[str, ...]) -> Column:
    """STR-06: exact names first; else a prefix and a suffix go, and words are capitalised."""
    short = F.regexp_replace(method, "^(" + "|".join(prefixes) + ")", "") if prefixes else method
    short = F.regexp_replace(short, "(" + "|".join(suffixes) + ")$", "") if suffixes else short
    out = F.initcap(F.translate(short, "_-", "  "))
    for k, v in exact.items():
        out = F.when(method == k, F.lit(v)).otherwise(out)
    return out


def mean_std_text(mean: Column, std: Column, digits: int = 3) -> Column:
    """STR-08: 'mean +/- std', the mean alone without a deviation, '-' without a mean."""
    text = lambda x: F.format_string(f"%.{digits}f", F.round(x, digits))
    return F.when(mean.isNull(), "-").when(std.isNull(), text(mean)).otherwise(F.concat(text(mean), F.lit(" +/- "), text(std)))


def signed_text(x: Column, digits: int = 3) -> Column:
    """STR-08: a difference with its sign."""
    return F.format_string(f"%+.{digits}f", x)


def colour_of(method: Column, colours: dict[str, str], default: str) -> Column:
    """STR-07: the colour of the first name that the method contains, without regard to case."""
    return F.coalesce(*[F.when(F.contains(F.lower(method), F.lit(k.lower())), F.lit(v)) for k, v in colours.items()], F.lit(default))


def quoted(x: Column) -> Column:
    """STR-07: an SQL string literal, quotes doubled."""
    return F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("''")), F.lit("'"))
