"""Benchmark decontamination by winnowing, in DataFrame expressions only.

A window is WINDOW consecutive words of a benchmark item (a shorter item is one window). Of the
K-word grams inside a window the one with the least hash is its fingerprint (the leftmost of
equals). A document keeps the least gram of every run of grams as long as the shortest window
holds, so whatever window it shares, it has kept that window's fingerprint: every shared span of
a window's length is found. Fingerprints are joined, each match is extended to the windows it may
stand for, and the words decide. Windows shorter than K words are fingerprints as a whole.

The benchmark's fingerprints are broadcast only if there are at most BROADCAST_ROWS of them; a
larger benchmark is joined by shuffle, which AQE splits where a fingerprint is frequent. A
fingerprint joins its few distinct places within windows, not the items that share it.

Null and empty texts have no words and are never contaminated; null item ids are not listed;
null document ids are kept as they are; rows that repeat an id are judged row by row, and rows
that repeat wholly give as many rows. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, lower_ascii, materialize, split_words

WINDOW, K = 10, 5
BROADCAST_ROWS = 1_000_000  # three integers each
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
POSITION = (1 << 31) - 1


def item_words(text: Column) -> Column:
    return split_words(lower_ascii(F.coalesce(text.cast("string"), F.lit(""))), SEPARATORS)


def _steps(n: Column) -> Column:
    """0 .. n-1, or nothing."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _grams(words: Column, k: int) -> Column:
    """31 bits of hash and 31 of position for each k-word gram, as one number: order is by hash, then place."""

    def keyed(h: Column) -> Column:
        hashed = lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)])
        return F.transform(_steps(F.size(words) - (k - 1)), lambda i: F.shiftleft(F.shiftrightunsigned(hashed(i), 33), 31) + i)

    return let(F.transform(words, lambda w: F.xxhash64(w)), keyed)


def _kept(words: Column, k: int, run: int) -> Column:
    """The grams that are least in some run of consecutive grams."""
    least = lambda g: F.transform(_steps(F.size(g) - (run - 1)), lambda i: F.array_min(F.slice(g, i + 1, run)))
    return _grams(words, k) if run == 1 else let(_grams(words, k), lambda g: F.array_distinct(least(g)))


def _windows(items: DataFrame, item_key: str, item_text: str, window: int) -> DataFrame:
    """Distinct windows: w (words joined by a space), n (their number), k, print, place, item (one row for each that has it)."""
    words = items.select(F.col(item_key).cast("string").alias("item"), item_words(F.col(item_text)).alias("words")).where("size(words) > 0")
    n = F.size("words")
    each = F.when(n < window, F.array("words")).otherwise(F.transform(_steps(n - (window - 1)), lambda i: F.slice("words", i + 1, window)))
    distinct = words.select("item", F.explode(each).alias("words")).distinct()
    least = F.when(n < K, F.array_min(F.array(*[F.when(n == k, F.get(_grams(F.col("words"), k), F.lit(0))) for k in range(1, K)]))).otherwise(F.array_min(_grams(F.col("words"), K)))
    return distinct.select(F.array_join("words", " ").alias("w"), n.alias("n"), F.least(n, F.lit(K)).alias("k"), least.alias("key"), "item").select("w", "n", "k", F.shiftright("key", 31).alias("print"), F.col("key").bitwiseAND(F.lit(POSITION)).cast("int").alias("place"), "item")


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """key, text_hash (xxhash64 of the text, which tells rows that repeat an id apart), n_words, n_hit (words in windows of
    items), n_items, items (their ids as sorted strings), contaminated."""
    windows = materialize(_windows(items, item_key, item_text, window))
    lengths = [r.n for r in windows.select("n").distinct().collect()]  # at most window of them
    places = windows.select("k", "print", "place", "n").distinct()
    if windows.count() <= BROADCAST_ROWS:
        places = F.broadcast(places)
    words = docs.select(F.col(key).alias("id"), item_words(F.col(text)).alias("words"))
    tagged = lambda k, run: F.transform(_kept(F.col("words"), k, run), lambda g: F.struct(F.lit(k).alias("k"), g.alias("key")))
    passes = [tagged(n, 1) for n in sorted(lengths) if n < K]
    passes += [tagged(K, min(n for n in lengths if n >= K) - K + 1)] if any(n >= K for n in lengths) else []
    none = F.array().cast("array<struct<k:int,key:bigint>>")
    prints = words.select("id", F.explode(F.concat(none, *passes)).alias("g")).select("id", "g.k", F.shiftright("g.key", 31).alias("print"), F.col("g.key").bitwiseAND(F.lit(POSITION)).cast("int").alias("at"))
    starts = prints.join(places, ["k", "print"]).select("id", F.struct((F.col("at") - F.col("place")).alias("start"), "n").alias("c"))
    maybe = starts.where("c.start >= 0").groupBy("id").agg(F.collect_set("c").alias("cs"))

    joined = docs.select(F.col(key).alias("id"), F.col(text).alias("t")).join(maybe.withColumnRenamed("id", "other"), F.col("id").eqNullSafe(F.col("other")), "left")
    fits = F.filter("cs", lambda c: c["start"] + c["n"] <= F.size("words"))
    spans = F.transform(fits, lambda c: F.struct(c["start"].alias("start"), c["n"].alias("n"), F.array_join(F.slice("words", c["start"] + 1, c["n"]), " ").alias("w")))
    rows = joined.select("id", F.xxhash64("t").alias("t"), item_words(F.col("t")).alias("words"), "cs").select("id", "t", F.size("words").alias("n_words"), F.when(F.size("cs") > 0, spans).alias("spans"))
    # a row without spans gets a word list that no window has, and no two rows the same
    nothing = F.concat(F.lit(" "), F.xxhash64("id", "t").cast("string"))
    each = rows.select("id", "t", "n_words", F.posexplode_outer("spans").alias("p", "s")).select("id", "t", "n_words", (F.coalesce("p", F.lit(0)) == 0).cast("int").alias("first"), F.col("s.start").alias("start"), F.col("s.n").alias("n"), F.coalesce("s.w", nothing).alias("w"))
    known = windows.select("w").distinct().withColumn("v", F.xxhash64("w"))
    found = each.join(known, "w", "left")
    hit = F.when(F.col("v").isNotNull(), F.struct("start", "n"))
    by_row = materialize(found.groupBy("id", "t", "n_words").agg(F.sum("first").alias("copies"), F.collect_set(hit).alias("hits"), F.collect_set("v").alias("vs")))
    # the items of the windows of each contaminated row, as rows until the last step
    row = ["id", "t", "n_words"]
    named = by_row.where("size(vs) > 0").select(*row, F.explode("vs").alias("v")).join(windows.select(F.xxhash64("w").alias("v"), "item"), "v").where("item is not null")
    listed = named.groupBy(*row).agg(F.sort_array(F.collect_set("item")).alias("items"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in row]
    dirty = by_row.where("size(vs) > 0").alias("a").join(listed.alias("b"), same[0] & same[1] & same[2], "left").select("a.*", "b.items")
    rest = by_row.where("size(vs) = 0").withColumn("items", F.lit(None).cast("array<string>"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["n"] - 1)))))
    items = F.coalesce("items", F.array().cast("array<string>"))
    out = dirty.union(rest).select("id", "t", F.col("n_words").cast("long").alias("n_words"), covered.cast("long").alias("n_hit"), items.alias("items"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("c"))
    return out.select(F.col("id").alias(key), F.col("t").alias("text_hash"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", (F.col("n_hit") > 0).alias("contaminated"))
