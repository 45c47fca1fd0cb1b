"""Best-fit packing of documents into bins of CAPACITY tokens, under conflicts.

A bin never holds two pieces of one source or of one cluster of duplicates; near_duplicates gives
the clusters of near copies (five-word shingles, 0.8, as in the Jaccard join). A document longer than
a bin is cut: its full pieces fill bins of their own, its rest is packed. Pieces are taken longest
first (equals in order of key) and each goes to the tightest compatible bin: open bins are ordered
by residual in a tree whose nodes hold the intersection of the source and cluster bitmaps below
them, so the search for the successor of a length skips whole subtrees that conflict and goes on
until it meets a compatible bin; of equal residuals the oldest bin is taken.

Documents are dealt by hash over shards of about SHARD_ROWS rows, whatever their source or
cluster, and shards are packed independently, so a hot source or cluster is spread evenly; rows that are alike are counted and
dealt copy by copy. What shards lose is at their ends: bins that no later piece came to fill. The pieces of all bins
filled less than OPEN are therefore packed once more, in shards of their own.

The query and the pipeline count white-space words: n_tokens is words there, so their bins of
CAPACITY do not fit a context of 2,048 model tokens.

Null and empty lengths have no piece: they get one row without a bin. A null source or cluster
conflicts with nothing. Rows that repeat are packed row by row. Only the named columns are read.
"""

from __future__ import annotations

import bisect
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, words_for_text
from .jaccard_join import jaccard_components

CAPACITY = 2048
SHARD_ROWS = 4096
OPEN = 0.95  # share of a bin's capacity below which its pieces are packed again
SCHEMA = "doc_id long, piece int, n_tokens long, shard int, bin int, start long, source long, cluster long, fill long"


class Bins:
    """Open bins by residual."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.capacity = capacity
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins of each residual, oldest first
        self.sources = [-1] * (2 * self.size)  # intersections; -1: nothing below
        self.clusters = [-1] * (2 * self.size)
        self.own: list[list[int]] = []  # source and cluster bitmap of each bin

    def _set(self, residual: int) -> None:
        s = c = -1
        for b in self.at[residual]:
            s &= self.own[b][0]
            c &= self.own[b][1]
        node = self.size + residual
        while node and (self.sources[node] != s or self.clusters[node] != c):
            self.sources[node], self.clusters[node] = s, c
            node >>= 1
            if node:
                s = self.sources[2 * node] & self.sources[2 * node + 1]
                c = self.clusters[2 * node] & self.clusters[2 * node + 1]

    def _find(self, n: int, source: int, cluster: int) -> tuple[int, int] | None:
        stack = [(1, 0, self.size)]
        while stack:
            node, low, width = stack.pop()
            s, c = self.sources[node], self.clusters[node]
            if low + width <= n or s == -1 or s & source or c & cluster:
                continue
            if width == 1:
                for b in self.at[low]:
                    if not (self.own[b][0] & source or self.own[b][1] & cluster):
                        return low, b
                continue
            half = width // 2
            stack.append((2 * node + 1, low + half, half))
            stack.append((2 * node, low, half))
        return None

    def add(self, n: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, start) of a piece of n tokens; source and cluster: one bit each or 0."""
        if found := self._find(n, source, cluster):
            residual, b = found
            self.at[residual].remove(b)
            self._set(residual)
        else:
            residual, b = self.capacity, len(self.own)
            self.own.append([0, 0])
        self.own[b][0] |= source
        self.own[b][1] |= cluster
        bisect.insort(self.at[residual - n], b)
        self._set(residual - n)
        return b, self.capacity - residual


def pack_rows(rows: list[dict], capacity: int) -> list[dict]:
    """rows: id, n, source, cluster of one shard (and piece, the number of the first piece); one dict a piece, with the fill of its bin."""
    order = sorted(rows, key=lambda r: (r["id"] is None, r["id"] or 0, r.get("piece") or 0, r["n"] or 0, str(r["source"]), r["cluster"] or 0))
    bits: dict[tuple, int] = {}
    for kind in ("source", "cluster"):
        seen = Counter(r[kind] for r in order if r[kind] is not None and (r["n"] or 0) % capacity)
        repeated = [v for v, n in seen.items() if n > 1]  # what occurs once conflicts with nothing
        bits |= {(kind, v): 1 << j for j, v in enumerate(repeated)}
    out, rest, full = [], [], []
    for r in order:
        n, first = r["n"] or 0, r.get("piece") or 0
        full += [(r, first + k) for k in range(n // capacity)]
        if n % capacity:
            rest.append((-(n % capacity), len(rest), first + n // capacity, r))
        elif not n:
            out.append({"doc_id": r["id"], "piece": first, "n_tokens": 0, "bin": None, "start": None, "source": r["source"], "cluster": r["cluster"], "fill": None})
    bins = Bins(capacity)
    placed = []
    for minus, _, piece, r in sorted(rest, key=lambda x: x[:2]):
        b, start = bins.add(-minus, bits.get(("source", r["source"]), 0), bits.get(("cluster", r["cluster"]), 0))
        placed.append({"doc_id": r["id"], "piece": piece, "n_tokens": -minus, "bin": b, "start": start, "source": r["source"], "cluster": r["cluster"]})
    fill = Counter()
    for x in placed:
        fill[x["bin"]] += x["n_tokens"]
    out += [x | {"fill": fill[x["bin"]]} for x in placed]
    for b, (r, piece) in enumerate(full, len(bins.own)):
        out.append({"doc_id": r["id"], "piece": piece, "n_tokens": capacity, "bin": b, "start": 0, "source": r["source"], "cluster": r["cluster"], "fill": capacity})
    return out


def near_duplicates(df: DataFrame, text: str = "text", words: str | None = None) -> DataFrame:
    """All columns of df and cluster: one value for all texts that Jaccard links reach (equal texts included); null for null.
    words: a column for the number of the text's words, which then takes the place of the text."""
    keyed = df.withColumn("cluster", F.when(F.col(text).isNotNull(), F.xxhash64(text)))
    groups = jaccard_components(keyed.select("cluster", text), "cluster", text)
    # only texts that hang on another one are joined; the others are their own cluster
    moved = groups.where("component_id <> cluster").groupBy("cluster").agg(F.min("component_id").alias("_root"))
    rows = keyed if words is None else words_for_text(keyed, text, words)
    return rows.join(moved, "cluster", "left").withColumn("cluster", F.coalesce("_root", "cluster")).select(*[f"`{c}`" for c in rows.columns if c != "cluster"], "cluster")


def best_fit(df: DataFrame, length: Column, source: Column, cluster: Column, key: str = "doc_id", capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """key, piece, n_tokens, shard, bin (unique within its shard), start (offset in the bin)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    item = df.select(F.col(key).cast("long").alias("id"), F.coalesce(length, F.lit(0)).cast("long").alias("n"), F.when(source.isNotNull(), F.xxhash64(source)).alias("source"), F.when(cluster.isNotNull(), F.xxhash64(cluster)).alias("cluster"))
    alike = item.groupBy("id", "n", "source", "cluster").agg(F.count("*").alias("copies"))
    items = materialize(alike.select("id", "n", "source", "cluster", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")))
    arrow = to_arrow_schema(df.sparkSession.createDataFrame([], SCHEMA).schema)

    def packed(rows: DataFrame, by: list[str], base: int) -> tuple[DataFrame, int]:
        """rows dealt by a hash over shards that are numbered from base; and how many there are."""
        shards = max(1, -(-rows.count() // shard_rows))

        def run(k, table):
            shard = base + k[0].as_py()
            return pa.Table.from_pylist([r | {"shard": shard} for r in pack_rows(table.to_pylist(), capacity)], arrow)

        return rows.withColumn("_shard", F.pmod(F.xxhash64(*by), F.lit(shards)).cast("int")).groupBy("_shard").applyInArrow(run, SCHEMA), shards

    first, shards = packed(items, ["id", "n", "cluster", "copy"], 0)
    if shards > 1:
        first = materialize(first)
        again = F.coalesce(F.col("fill") < OPEN * capacity, F.lit(False))
        loose = first.where(again).select(F.col("doc_id").alias("id"), "piece", F.col("n_tokens").alias("n"), "source", "cluster", "shard", "bin")
        second, _ = packed(loose, ["id", "piece", "shard", "bin"], shards)
        first = first.where(~again).unionByName(second)
    return first.drop("source", "cluster", "fill").withColumnRenamed("doc_id", key)
