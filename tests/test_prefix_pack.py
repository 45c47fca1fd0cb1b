"""Packing as a parallel prefix against the sequential rule."""

import random

import numpy as np
import pytest
from marlstone.operators import prefix_pack as P


def by_hand(sizes, budget, used=None, batch=-1):
    out = []
    for n in sizes:
        n = n or 0
        if n >= budget:
            batch, used = batch + 1, None
        elif used is None or used + n > budget:
            batch, used = batch + 1, n
        else:
            used += n
        out.append(batch)
    return out, used, batch


def test_functions_of_blocks_compose():
    """Any fill at the start gives what the rule gives, after each block."""
    rng = random.Random(1)
    for _ in range(300):
        budget = rng.randrange(2, 40)
        sizes = [rng.choice([0, 1, 2, 3, rng.randrange(budget + 5)]) for _ in range(rng.randrange(1, 60))]
        fill, at = P.Fill.none(budget), 0
        while at < len(sizes):
            end = at + rng.randrange(1, 20)
            part = np.array(sizes[at:end], float)
            block = P.Block(part, np.zeros(len(part), bool), budget)
            for used in [None, *range(budget)]:
                want, left, batch = by_hand(sizes[:at], budget, used, 0)
                got = fill.at(P.FULL if used is None else used)
                assert got == ((P.FULL if left is None else left), batch), (sizes, budget, used)
                assert block.batches(got[0], got[1] + 1).tolist() == by_hand(sizes[at:end], budget, left, batch)[0]
            fill, at = fill.then(block), end
        assert len(fill.lower) <= budget + 1


@pytest.mark.parametrize("seed,ranges", [(1, 1), (2, 3), (3, 7), (4, 40)])
def test_packing_equals_the_rule(spark, seed, ranges):
    rng = random.Random(seed)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rng.choice([1, 7, 50]))
    try:
        rows, want = [], {}
        for g, n in (("a", 400), ("b", 3), (None, 60), ("c", 1), ("d", 90)):
            sizes = [rng.choice([None, 0, 1, 5, rng.randrange(130)]) for _ in range(n)]
            rows += [(g, i, s, "text") for i, s in enumerate(sizes)]
            want |= {(g, i): b for i, b in enumerate(by_hand(sizes, 100)[0])}
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, "g string, i int, n int, other string").repartition(5)
        got = P.prefix_pack(df, ["i"], "n", 100, "g", ranges)
        assert got.columns == ["g", "i", "n", "other", "batch"]
        assert {(r.g, r.i): r.batch for r in got.collect()} == want
        one = {r.i: r.batch for r in P.prefix_pack(df.where("g = 'a'"), ["i"], "n", 100, ranges=ranges).collect()}
        assert one == {i: b for (g, i), b in want.items() if g == "a"}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_packing_of_nothing_and_of_equal_rows(spark):
    df = spark.createDataFrame([], "i int, n int")
    assert P.prefix_pack(df, ["i"], "n", 10).count() == 0
    df = spark.range(1000).selectExpr("id as i", "3 as n")
    assert {r.i: r.batch for r in P.prefix_pack(df, ["i"], "n", 10).collect()} == {i: i // 3 for i in range(1000)}
