"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's set is its distinct shingles of SHINGLE lower-cased words (a shorter text is one
shingle). Two documents link if 100 * intersection >= PERCENT * union. The result is the size of
each set and the least id that links reach.

Shingles are ordered by document frequency, rare first. If x and y link, then for any l their
l-prefixes, the first |x| - ceil(0.8 |x|) + l shingles of each, share l shingles. Each document
lengthens its prefix, from l = 1 to DEEPEST, if that lowers the estimated cost: the postings its
prefix reads plus the price of verifying its candidates, of which there are about as many as the
l-th largest posting is long (postings that go together are nested). A pair is verified if it shares
min(l_x, l_y) shingles of the prefixes of that depth.

Shingles that no other document has match nothing, so a pair needs enough others on both sides.
Equal sets are one class from the start, so copies are counted once. Prefix shingles with equal postings
(the shingles of a passage that some texts share) are one token group: a class has one row a group, with the
number of its shingles there at each depth, so a shared passage costs one row a pair and not one a
shingle. What two classes share of a group is at most the lesser of their numbers; candidates are the
pairs whose sum over groups reaches min(l_x, l_y), no fewer than the pairs that share as many shingles.
No row carries a text's shingles along, so rows are linear in the texts' lengths.

Before the exact join, a star round links each class with one pivot per token group, the class with the fewest
shingles of its own (the likely source of near copies). Later candidates are only pairs of different components,
generated from the members outside the component that holds most of a group's posting. The star round also
leaves each member's overlap with the pivot: what x and y share is at most the lesser overlap plus the lesser
rest, which rules most others out. A large group of near copies therefore costs about one pair a member,
and no link between components is lost: every remaining pair is still verified.

Null and empty texts have empty sets and link with nothing; null ids are never a component's id
unless all its ids are null; rows that repeat an id share its component. Only the named columns
are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import ASK, Block, answer, bundle, by_owner, join_blocks, map_blocks, owners_for, to_blocks, unbundle
from .common import materialize, pack, pack_sorted, ranked, release, unpack, unpack_sorted, window_hash
from .components import components

SHINGLE, PERCENT = 5, 80
DEEPEST = 8
CELL = np.uint64(24)  # frequencies are kept for the leading 40 bits
SHORT = np.uint64(16)  # verification compares 48 bits
MOST = 65535
CARRY = 32  # token groups of a class up to which its rows name all of them; a class with more is paired group by group


class _Shingles:
    """Distinct (document, shingle) of a block, by document, then hash; keys: ascending distinct shingles."""

    def __init__(self, block: Block):
        hashes, counts = block.hashes(), block.counts
        inside = np.where(counts >= SHINGLE, counts - SHINGLE + 1, 0)
        first = np.repeat(block.starts - (np.cumsum(inside) - inside), inside)
        parts = [(np.repeat(np.arange(len(counts)), inside), window_hash(hashes, first + np.arange(inside.sum()), SHINGLE))]
        for n in range(1, SHINGLE):
            own = np.flatnonzero(counts == n)
            parts.append((own, window_hash(hashes, block.starts[own], n, 100 + n)))
        doc, h = (np.concatenate(x) for x in zip(*parts, strict=True))
        place, self.keys = ranked(h)
        pairs = np.sort((doc.astype(np.uint64) << np.uint64(32)) | place.astype(np.uint64))
        new = np.ones(len(pairs), bool)
        new[1:] = pairs[1:] != pairs[:-1]
        pairs = pairs[new]
        self.doc, self.code = (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
        self.n = np.bincount(self.doc, minlength=len(counts))


def _ask(owners: int):
    def ask(block: Block) -> Iterator[dict]:
        s = _Shingles(block)
        counts = np.bincount(s.code, minlength=len(s.keys))
        for owner, part in by_owner(s.keys, owners):
            yield {"owner": owner, "block": block.block, "kind": 1, "data": bundle(pack_sorted(s.keys[part] >> CELL), pack(counts[part]))}

    return ask


def _frequencies(owner: int, rows: list[dict]) -> Iterator[dict]:
    parts = [unbundle(r["data"]) for r in rows]
    cells = [unpack_sorted(c) for c, _ in parts]
    codes, distinct = pd.factorize(np.concatenate(cells))
    total = np.bincount(codes, np.concatenate([unpack(n) for _, n in parts]).astype(float), len(distinct))
    at = 0
    for r, c in zip(rows, cells, strict=True):
        yield {"block": r["block"], "kind": 1, "owner": owner, "data": pack(np.minimum(total[codes[at : at + len(c)]], MOST).astype(np.uint64))}
        at += len(c)


def needed(n: int) -> int:
    """The least overlap of a set of n with any set it links to."""
    return (PERCENT * n + 99) // 100


def prefix_depth(frequency: np.ndarray, n: int) -> int:
    """The l whose prefix costs least; frequency: of all shingles in order, rare first."""
    deepest = min(DEEPEST, needed(n))
    ends = n - needed(n) + np.arange(1, deepest + 1)
    read = np.cumsum(frequency - 1)[ends - 1].astype(float)
    found = [np.sort(frequency[:e] - 1)[-depth] for depth, e in enumerate(ends, 1)]
    return 1 + int(np.argmin(read + n * np.array(found, float)))


SETS = "doc_id long, n long, shared long, set binary, live binary, tokens array<bigint>, levels array<int>, depth int"


def _sets(owners: int):
    def make(block: Block, got: dict) -> Iterator[dict]:
        s = _Shingles(block)
        slices = by_owner(s.keys, owners)
        df = np.concatenate([unpack(got[1, o]) for o, _ in slices]).astype(np.int64)[s.code] if slices else np.empty(0, np.int64)
        ends = np.cumsum(s.n)
        seen = set()
        for i, n, end in zip(block.ids, s.n.tolist(), ends.tolist(), strict=True):
            own = slice(end - n, end)
            row = {"doc_id": i, "n": n, "shared": None, "set": None, "live": None, "tokens": None, "levels": None, "depth": None}
            if n and (df[own] > 1).sum() >= needed(n):
                h, f = s.keys[s.code[own]], df[own]
                row["set"] = xxhash.xxh3_128_digest(h.tobytes())
                if row["set"] not in seen:
                    seen.add(row["set"])
                    row["shared"] = int((f > 1).sum())
                    row["live"] = pack_sorted(h[f > 1] >> SHORT)
                    rare = np.argsort(f.astype(np.uint16), kind="stable")  # frequencies stop at MOST
                    depth = prefix_depth(f[rare], n)
                    prefix = rare[: n - needed(n) + depth]
                    level = np.maximum(1, np.arange(len(prefix)) - (n - needed(n)) + 1)
                    live = f[prefix] > 1
                    row |= {"tokens": h[prefix][live].view(np.int64).tolist(), "levels": level[live].tolist(), "depth": depth}
            yield row

    return make


def _overlaps(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """a, b, both (shared shingles) and linked of pairs of class keys."""
    side = lambda x: classes.select(F.col("set").alias(x), F.col("n").alias(f"n{x}"), F.col("live").alias(f"live{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count, linked = [], []
            for nx, sx, ny, sy in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True):
                both = len(np.intersect1d(unpack_sorted(sx), unpack_sorted(sy), assume_unique=True))
                count.append(both)
                linked.append(100 * both >= PERCENT * (nx + ny - both))
            yield pa.RecordBatch.from_arrays([batch[0], batch[1], pa.array(count, pa.int64()), pa.array(linked, pa.bool_())], ["a", "b", "both", "linked"])

    sized = pairs.join(side("b"), "b").join(side("a"), "a")
    return sized.select("a", "b", "na", "livea", "nb", "liveb").mapInArrow(run, "a binary, b binary, both long, linked boolean")


def _may_link(n: str, shared: str, m: str, other: str):
    """The least overlap of sets of n and m is within what each shares with any other set."""
    return (100 + PERCENT) * F.least(shared, other) >= PERCENT * (F.col(n) + F.col(m))


def _contract(rows: DataFrame, comps: DataFrame) -> DataFrame:
    """rows with comp replaced by the root of its component."""
    return rows.join(comps.withColumnRenamed("node", "comp"), "comp", "left").withColumn("comp", F.coalesce("root", "comp")).drop("root")


def _between(links: DataFrame, rows: DataFrame) -> DataFrame:
    """Links of classes as links of their components so far."""
    known = rows.select("set", "comp").distinct()
    a = links.join(known.toDF("a", "ca"), "a").join(known.toDF("b", "cb"), "b")
    return a.select(F.col("ca").alias("a"), F.col("cb").alias("b"))


def _token_groups(rows: DataFrame) -> DataFrame:
    """group, set, n, shared, depth, upto: one row for each class and group of its prefix shingles; upto has four bits a
    depth: how many of them are of a level up to it, as far as it matters. rows: set, n, shared, depth, token, level.

    Shingles are grouped by the number and two exclusive sums of hashes of the classes in their postings; were two
    postings taken for one, there would be more candidates, not fewer links."""
    h = lambda salt: F.bit_xor(F.xxhash64("set", F.lit(salt)))
    postings = rows.groupBy("token").agg(F.count("*").alias("k"), h(1).alias("x"), h(2).alias("y")).where("k > 1").select("token", F.xxhash64("k", "x", "y").alias("group"))
    upto = sum((F.shiftleft(F.least(F.count_if(F.col("level") <= depth), F.lit(DEEPEST)), 4 * (depth - 1)) for depth in range(1, DEEPEST + 1)), F.lit(0).cast("long"))
    return rows.join(postings, "token").groupBy("group", "set", "n", "shared", "depth").agg(upto.alias("upto"))


def _at_depth(upto: Column, depth: Column) -> Column:
    """The four bits of a depth."""
    return F.call_function("shiftright", upto, 4 * (depth - 1)).bitwiseAND(F.lit(15))


def _pivots(groups: DataFrame) -> DataFrame:
    """group, pivot (a), na, sa."""
    by = F.struct((F.col("n") - F.col("shared")).alias("own"), "set", "n", "shared")
    return groups.groupBy("group").agg(F.min(by).alias("p")).select("group", "p.set", "p.n", "p.shared").toDF("group", "a", "na", "sa")


def _star_pairs(groups: DataFrame, pivots: DataFrame) -> DataFrame:
    """Each class with the pivots of its token groups."""
    return groups.join(pivots, "group").where((F.col("set") != F.col("a")) & _may_link("n", "shared", "na", "sa")).select("a", F.col("set").alias("b")).distinct()


def _cross_pairs(groups: DataFrame, pivots: DataFrame, seen: DataFrame) -> DataFrame:
    """The pairs of different components that share enough prefix shingles and may share enough of all."""
    held = groups.groupBy("group", "comp").count().groupBy("group").agg(F.max_by("comp", F.struct("count", "comp")).alias("major"), F.count("*").alias("k")).where("k > 1").drop("k")
    live = groups.join(held, "group").join(pivots.select("group", F.col("a").alias("pivot")), "group")
    live = live.join(seen.select(F.col("a").alias("pivot"), F.col("b").alias("set"), "both"), ["pivot", "set"], "left")
    is_pivot = F.col("set") == F.col("pivot")
    near, rest = F.when(is_pivot, F.col("shared")).otherwise(F.coalesce("both", "shared")), F.when(is_pivot, 0).otherwise(F.coalesce(F.col("shared") - F.col("both"), F.col("shared")))
    # a class of few groups carries them all, so that a pair is made once, at the first group that both have
    few = groups.groupBy("set").count().where(F.col("count") <= CARRY).select("set")
    every = groups.join(few, "set").groupBy("set").agg(F.sort_array(F.collect_list(F.struct("group", "upto"))).alias("e"))
    every = every.select("set", F.transform("e", lambda x: x["group"]).alias("gs"), F.transform("e", lambda x: x["upto"]).alias("us"))
    live = live.select("group", "set", "comp", "n", "shared", "depth", "upto", "major", near.alias("near"), rest.alias("rest"))
    live = materialize(live.join(every, "set", "left"))
    side = lambda x: [F.col(c).alias(f"{c}_{x}") for c in ("set", "comp", "n", "shared", "depth", "upto", "near", "rest", "gs", "us")]
    left = live.where("comp <> major").select("group", *side("a"))
    right = live.select(F.col("group").alias("group_b"), *side("b"), (F.col("comp") == F.col("major")).alias("main"))
    once = (F.col("comp_a") != F.col("comp_b")) & (F.col("main") | (F.col("set_a") < F.col("set_b")))
    enough = (100 + PERCENT) * (F.least("near_a", "near_b") + F.least("rest_a", "rest_b")) >= PERCENT * (F.col("n_a") + F.col("n_b"))
    depth = F.least("depth_a", "depth_b")
    carried = F.col("gs_a").isNotNull() & F.col("gs_b").isNotNull()

    def shared(i: Column) -> Column:
        at = F.array_position("gs_b", F.get("gs_a", i)).cast("int")
        return F.when(at > 0, F.least(_at_depth(F.get("us_a", i), depth), _at_depth(F.get("us_b", at - 1), depth))).otherwise(0)

    # a pair whose groups are all known is judged here and now, any other by the sum over its groups
    known = F.aggregate(F.sequence(F.lit(0), F.size("gs_a") - 1), F.lit(0).cast("long"), lambda total, i: total + shared(i))
    first = F.get(F.array_intersect("gs_a", "gs_b"), F.lit(0)) == F.col("group")
    here = F.when(carried, first & (known >= depth)).otherwise(F.least(_at_depth(F.col("upto_a"), depth), _at_depth(F.col("upto_b"), depth)) > 0)
    found = left.join(right, (F.col("group") == F.col("group_b")) & once & _may_link("n_a", "shared_a", "n_b", "shared_b") & enough & here)
    common = F.when(carried, depth).otherwise(F.least(_at_depth(F.col("upto_a"), depth), _at_depth(F.col("upto_b"), depth)))
    pairs = found.select(F.least("set_a", "set_b").alias("a"), F.greatest("set_a", "set_b").alias("b"), depth.alias("depth"), common.alias("common"))
    return pairs.groupBy("a", "b").agg(F.sum("common").alias("common"), F.min("depth").alias("depth")).where("common >= depth").select("a", "b")


def jaccard_components(df: DataFrame, key: str = "doc_id", text: str = "text", block_bytes: int | None = None) -> DataFrame:
    """key, n_shingles, component_id."""
    spark = df.sparkSession
    blocks = materialize(to_blocks(df, key, text, lower=True, block_bytes=block_bytes))
    owners = owners_for(blocks)
    counted = materialize(answer(map_blocks(blocks, _ask(owners), ASK), _frequencies))
    release(spark)
    sets = materialize(join_blocks(blocks, counted, _sets(owners), SETS))
    release(spark, blocks, counted)
    classes = materialize(sets.where("live is not null").drop("doc_id").dropDuplicates(["set"]))
    rows = classes.select("set", "n", "shared", "depth", F.explode(F.arrays_zip("tokens", "levels")).alias("t")).select("set", "n", "shared", "depth", F.col("t.tokens").alias("token"), F.col("t.levels").alias("level"))
    groups = materialize(_token_groups(rows))
    pivots = materialize(_pivots(groups))
    stars = materialize(_overlaps(_star_pairs(groups, pivots), classes))
    comps = components(stars.where("linked"))
    placed = materialize(_contract(groups.withColumn("comp", F.col("set")), comps))
    release(spark, groups)
    crossing = materialize(_overlaps(_cross_pairs(placed, pivots, stars), classes))
    joined = components(_between(crossing.where("linked"), placed))
    ids = sets.select(F.col("doc_id").alias(key), F.col("n").alias("n_shingles"), "set")
    # documents without a class link with nothing: they skip the joins, where their nulls would meet in one task
    alone = ids.where("set is null").select(key, "n_shingles", F.col(key).alias("component_id"))
    members = ids.where("set is not null").withColumn("comp", F.col("set"))
    members = materialize(_contract(_contract(members, comps), joined))
    release(spark, classes, pivots, stars, placed, crossing)
    least = materialize(members.groupBy("comp").agg(F.min(key).alias("component_id")))
    return alone.union(members.join(least, "comp").select(key, "n_shingles", "component_id"))
