"""Edge cases and identities of the operators."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.functions import keys, numeric
from marlstone.operators import batching, compare, corpus, fallible, features, graph, labels, metrics, ragged, significance, weighting
from marlstone.sources import sinks, tables


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


# ----------------------------------------------------------------- corpus
def test_keep_first_is_stable_under_order_and_drops_null_keys(spark):
    data = [("a", 3, None), ("a", 1, "x"), (None, 0, "y"), ("b", 2, "z"), ("a", 1, "x")]
    df = spark.createDataFrame(data, "k string, i int, v string")
    want = [("a", 1, "x"), ("b", 2, "z")]
    assert rows(corpus.keep_first(df, ["k"], ["i"])) == want
    assert rows(corpus.keep_first(df.orderBy(F.desc("i")), ["k"], ["i"])) == want
    assert corpus.keep_first(df.limit(0), ["k"], ["i"]).count() == 0


def test_pick_columns_mixes_rows_and_pick_rows_does_not(spark):
    df = spark.createDataFrame([("a", 1, None, 10), ("a", 2, "x", 20)], "k string, h int, u string, v int")
    assert rows(corpus.pick_columns(df, ["k"], ["u", "v"], F.col("h"))) == [("a", "x", 10)]
    assert rows(corpus.pick_rows(df, ["k"], ["u", "v"], F.col("h"))) == [("a", None, 10)]


def test_drop_route_and_counts_conserve_rows(spark):
    df = spark.createDataFrame([(f"k{i}",) for i in range(200)] + [(None,)], "k string")
    listed = spark.createDataFrame([("k1",), ("k2",), ("nope",)], "key string")
    assert corpus.drop_listed(df, listed, "k").count() + corpus.only_listed(df, listed, "k").count() == 201
    r = corpus.route(df, listed, "k", 0.2, 1, 5)
    assert r.where("is_val and shard_id <> 0").count() == 0 and r.where("k in ('k1', 'k2') and not is_val").count() == 0
    assert 10 < r.where("is_val").count() < 90
    assert corpus.shard_counts(corpus.assign_shard(df, "k", 7)).agg(F.sum("n")).first()[0] == 201


def test_upsert_and_merges(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    assert rows(corpus.upsert(old, new, ["k"])) == [(1, "a"), (2, "B"), (3, "C")]
    assert rows(corpus.upsert(corpus.upsert(old, new, ["k"]), new, ["k"])) == [(1, "a"), (2, "B"), (3, "C")]
    assert rows(corpus.merge_keep_first([old, new], ["k"])) == [(1, "a"), (2, "b"), (3, "C")]
    assert rows(corpus.overriding_merge(old, new, ["k"], ["v"])) == [(1, "a"), (2, "B"), (3, "C")]


# ----------------------------------------------------------------- labels
def test_thresholds_and_reasons(spark):
    cases = [("enough", 41, 63), ("just", 40, 60), ("no_negative", 700, 12), ("no_positive", 39, 61), ("small", 50, 49), ("none", 3, 2)]
    stats = spark.createDataFrame([(t, p + n, p, n) for t, p, n in cases], "task string, n_valid int, n_pos int, n_neg int")
    out = labels.filter_tasks(stats, 40, 45, 100)
    assert {r.task for r in out.where("kept").collect()} == {"enough", "just"}
    assert out.where("task = 'none'").first().drop_reason == "n_pos=3<40;n_neg=2<45;n_valid=5<100"
    assert dict(map(tuple, labels.reason_histogram(out).collect())) == {"n_pos": 2, "n_neg": 2, "n_valid": 2}
    with pytest.raises(ValueError):
        labels.filter_tasks(stats, 10**6, 1, 1, least_kept=1)


def test_wide_and_melted_statistics_agree_with_nan_and_null(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1.0, nan, None), (0.0, nan, None), (nan, 1.0, None), (None, 2.0, None)], "a double, b double, c double")
    wide, long = labels.task_stats_wide(df, ["a", "b", "c"]), labels.task_stats(labels.melt(df, [], ["a", "b", "c"]))
    assert rows(wide) == rows(long) == [("a", 2, 1, 1, 2, 0.5), ("b", 1, 1, 0, 3, 1.0), ("c", 0, 0, 0, 4, 0.0)]


def test_floor_quantiles(spark):
    rng = np.random.default_rng(0)
    values = rng.integers(0, 20, 101).tolist() + [None]
    df = spark.createDataFrame([("g", v) for v in values] + [("one", 5)], "g string, v int")
    s = sorted(v for v in values if v is not None)
    want = [("g", s[0], s[int(0.25 * 100)], s[int(0.9 * 100)], s[-1]), ("one", 5, 5, 5, 5)]
    assert rows(labels.floor_quantiles(df, "g", "v", [0.25, 0.9])) == want


# ----------------------------------------------------------------- ragged and batches
@pytest.mark.parametrize("n,ranges", [(0, 4), (1, 4), (100, 1), (100, 7)])
def test_prefix_sums_equal_running_sums(spark, n, ranges):
    rng = np.random.default_rng(n)
    data = [(int(i), int(rng.integers(0, 9))) for i in rng.permutation(n)]
    df = spark.createDataFrame(data, "i long, v long")
    got = {r.i: r.s for r in ragged.prefix_sum(df, "i", F.col("v"), "s", ranges=ranges).collect()}
    total, want = 0, {}
    for i, v in sorted(data):
        want[i] = total
        total += v
    assert got == want


def test_chunks_differ_by_one_and_cover_all(spark):
    got = ragged.chunks(spark.range(23).withColumnRenamed("id", "i"), "i", 5).groupBy("chunk").count().orderBy("chunk").collect()
    assert [r["count"] for r in got] == [5, 5, 5, 4, 4]


def test_rebasing_edges_and_back(spark):
    nodes = spark.createDataFrame([(g, n) for g, k in ((1, 3), (2, 1), (5, 2)) for n in range(k)], "g long, n int")
    ptr = ragged.offsets(nodes, "g")
    assert rows(ptr) == [(1, 3, 0), (2, 1, 3), (5, 2, 4)]
    edges = spark.createDataFrame([(1, 0, 2), (5, 1, 0)], "g long, src long, dst long")
    assert rows(ragged.localise(ragged.rebase(edges, ptr, "g").drop("src", "dst"), ptr, "g").select("g", "src", "dst")) == rows(edges)


def test_alignment_cases(spark):
    mask = F.array(F.lit(False), F.lit(True), F.lit(True))
    assert one(spark, ragged.align(F.array(F.lit(7), F.lit(8)), mask)) == [None, 7, 8]
    assert one(spark, ragged.align(F.array(F.lit(7), F.lit(8), F.lit(9)), mask)) == [7, 8, 9]
    assert one(spark, ragged.align(F.array(F.lit(7)), mask)) == [None, None, None]


def test_budget_packing_rules(spark):
    df = spark.createDataFrame([("g", i, n) for i, n in enumerate([3, 7, 1, 10, 2, 25, 4, 4, 4, None])], "g string, i int, n int")
    got = [r.batch for r in batching.budget_pack(df, "g", ["i"], "n", 10).orderBy("i").collect()]
    assert got == [0, 0, 1, 2, 3, 4, 5, 5, 6, 6]


@pytest.mark.parametrize("n,world", [(0, 4), (1, 4), (2, 5), (8, 4), (9, 4)])
def test_striping_pads_cyclically(spark, n, world):
    df = spark.range(n).select(F.col("id").alias("batch"))
    got = batching.stripe(df, world).collect()
    slots = sorted((r.slot, r.batch) for r in got)
    assert slots == [(s, s % n) for s in range(-(-n // world) * world)] if n else slots == []


def test_cycling_batches(spark):
    df = spark.range(10).select(F.col("id").alias("k"))
    got = batching.cycle_batches(df, "k", 4, 20, 3).collect()
    assert len(got) == 80 and {r.batch for r in got} == set(range(20))
    first = sorted(r.k for r in got if r.epoch == 0)
    assert first == list(range(10))
    assert sorted(map(tuple, got)) == sorted(map(tuple, batching.cycle_batches(df, "k", 4, 20, 3).collect()))


def test_outer_union_order_and_padding(spark):
    a, b, c = (spark.createDataFrame([(i,)] * n, f"{name} int") for i, (n, name) in enumerate([(2, "x"), (1, "y"), (4, "z")]))
    out = batching.outer_union({"main": a, "other": b, "assay": c}, "main").collect()
    assert [(r.source_order, r.source) for r in out] == [(0, "main")] * 2 + [(1, "assay")] * 4 + [(2, "other")]
    assert all((r.x is None) == (r.source != "main") for r in out)


# ----------------------------------------------------------------- metrics and losses
def test_focal_without_focus_is_cross_entropy(spark):
    for y, x in ((1.0, 0.3), (0.0, -2.0), (1.0, 40.0), (0.0, 40.0)):
        a = one(spark, numeric.focal(F.lit(y), F.lit(x), 0.0, None))
        b = one(spark, numeric.bce_with_logits(F.lit(y), F.lit(x)))
        assert a == pytest.approx(b) and b == pytest.approx(max(x, 0) - x * y + math.log1p(math.exp(-abs(x))))


def test_masked_metrics_merge_and_give_zero_without_rows(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", None, 9.0), ("b", None, 1.0), ("a", 5.0, 1.0)], "k string, y double, p double")
    m = metrics.METRICS["mae"]
    assert rows(m.of(df, ["k"], F.col("y"), F.col("p"))) == [("a", 2, 2.5), ("b", 0, 0.0)]
    parts = [m.partial(df.where(c), ["k"], F.col("y"), F.col("p")) for c in ("p > 1.5", "p <= 1.5")]
    assert rows(m.finish(m.merge(parts[0].union(parts[1]), ["k"]))) == [("a", 2, 2.5), ("b", 0, 0.0)]


def test_auroc_of_perfect_random_and_unscorable_tasks(spark):
    rng = np.random.default_rng(1)
    data = [("perfect", i % 2, float(i % 2) + i / 1000) for i in range(100)] + [("random", int(rng.random() < 0.5), float(rng.random())) for _ in range(400)] + [("negative", 0, 0.5)] * 9 + [("ties", i % 2, 1.0) for i in range(10)]
    got = {r.t: r.auroc for r in metrics.auroc(spark.createDataFrame(data, "t string, y int, s double"), ["t"], "y", "s").collect()}
    assert got["perfect"] == 1.0 and 0.35 < got["random"] < 0.65 and got["negative"] is None and got["ties"] == 0.5
    assert metrics.mean_auroc(spark.createDataFrame([("n", 0, 1.0)], "t string, y int, s double"), ["t"], "y", "s").first()[0] == 0.0


def test_masked_graphs_count_in_the_mean(spark):
    df = spark.createDataFrame([(1, 4.0), (1, 2.0), (2, None), (2, None)], "g int, e double")
    r = metrics.per_graph_mean(df, "g", F.col("e")).first()
    assert (r.loss, r.graphs) == (1.5, 2)


# ----------------------------------------------------------------- comparison
def test_seed_deviation_and_single_seed(spark):
    facts = spark.createDataFrame([("m", "1", "t", 0.5), ("m", "2", "t", 0.6), ("n", "1", "t", 0.7), ("m", "_meta", "t", 9.0), ("_x", "1", "t", 1.0), ("n", "2", "t", float("nan"))], "method string, seed string, task string, value double")
    got = {r.method: r for r in compare.seed_aggregate(compare.valid_facts(facts), ["method", "task"]).collect()}
    assert got["m"].mean == pytest.approx(0.55) and got["m"].std == pytest.approx(math.sqrt(0.005)) and got["n"].std == 0.0 and set(got) == {"m", "n"}


def test_step_up_rule(spark):
    p = [0.001, 0.006, 0.039, 0.041, 0.042, 0.06, 0.074, 0.205, 0.212, 0.216, 0.222, 0.251, 0.269, 0.275, 0.34, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(p)], "i int, p double")
    assert {r.i for r in compare.benjamini_hochberg(df).where("rejected").collect()} == {0, 1}
    assert {r.i for r in compare.bonferroni(df).where("rejected").collect()} == {0}
    assert compare.benjamini_hochberg(df.limit(0)).count() == 0


@pytest.mark.parametrize("q,k,df,p", [(3.578, 3, 20, 0.05), (4.232, 4, 10, 0.0545), (3.151, 2, 10, 0.05), (4.327, 4, 10, 0.05), (5.270, 3, 10, 0.01), (3.314, 3, 10**6, 0.05), (3.685, 5, 120, 0.0736)])
def test_studentised_range_against_tables(q, k, df, p):
    assert significance.studentised_range_sf(q, k, df) == pytest.approx(p, abs=0.006)


def range_by_hand(q, k, df):
    """The tail by sums over fine grids."""
    import numpy as np

    h = 1 / 400
    x = np.arange(1, int(4 / h)) * h  # roots of the deviation
    s = x * x
    f = 2 * x * np.exp(math.log(2) + df / 2 * math.log(df / 2) - math.lgamma(df / 2) + (df - 1) * np.log(s) - df * s * s / 2)
    z = np.arange(-9, 9, 1 / 32)
    phi = lambda v: 0.5 * (1 + np.vectorize(math.erf)(v / math.sqrt(2)))
    inside = phi(z)[None, :] - phi(z[None, :] - np.minimum(q * s, 40)[:, None])
    tail = 1 - k * (np.exp(-z * z / 2) / math.sqrt(2 * math.pi) / 32 * np.maximum(inside, 0) ** (k - 1)).sum(1)
    return (f * tail).sum() * h


def test_native_range_tail(spark):
    cases = [(q, k, df) for q in (0.02, 0.7, 2.5, 4.2, 9.0) for k in (2, 3, 7, 40) for df in (3.0, 6.5, 19.5, 20.0, 36.0)]
    odd = [(None, 3, 5.0), (1.0, None, 5.0), (1.0, 3, None), (float("nan"), 3, 5.0), (1.0, 3, 0.5), (1.0, 1, 5.0), (0.0, 3, 5.0), (1e9, 3, 5.0), (1e4, 3, 1.0)]
    df = spark.createDataFrame(cases + odd, "q double, k int, df double")
    got = {(r.q, r.k, r.df): r.p for r in significance.range_p_values(df, "q", "df", "k").collect()}
    for q, k, d in cases:
        assert got[q, k, d] == pytest.approx(range_by_hand(q, k, d), abs=1e-7)
        if k == 2:
            assert got[q, k, d] == pytest.approx(significance.t_two_sided(q / math.sqrt(2), d), abs=1e-8)
    assert [got[c] for c in odd if c[0] is None or c[0] == c[0]] == [None, None, None, None, 1.0, 1.0, pytest.approx(0.0, abs=1e-30), pytest.approx(1.35e-4, rel=0.1)]
    for x in (0.5, 1.0, 7.3, 500.0):
        assert spark.range(1).select(significance.log_gamma(F.lit(x))).first()[0] == pytest.approx(math.lgamma(x), abs=1e-11)


@pytest.mark.parametrize("t,df,p", [(2.228, 10, 0.05), (12.706, 1, 0.05), (1.96, 10**6, 0.05), (0.0, 5, 1.0), (4.032, 5, 0.01)])
def test_student_t_against_tables(t, df, p):
    assert significance.t_two_sided(t, df) == pytest.approx(p, abs=2e-4)


def test_two_means_range_equals_t():
    assert significance.studentised_range_sf(2.5 * math.sqrt(2), 2, 12) == pytest.approx(significance.t_two_sided(2.5, 12), abs=1e-6)


def test_markdown(spark):
    df = spark.createDataFrame([("a", "x", "1"), ("b", "y", "2")], "r string, c string, v string")
    assert compare.markdown(df, "r", "c", "v") == "| r | x | y |\n|---|---|---|\n| a | 1 | - |\n| b | - | 2 |\n"


# ----------------------------------------------------------------- graphs
def test_symmetric_edges_leave_virtual_ones(spark):
    e = spark.createDataFrame([(0, 1, "real"), (1, 2, "virtual")], "src int, dst int, kind string")
    assert rows(graph.symmetrise(e, F.col("kind") == "real")) == [(0, 1, "real"), (1, 0, "real"), (1, 2, "virtual")]


def test_walks_sum_to_one_and_agree_with_numpy(spark):
    nodes = spark.createDataFrame([(1, i) for i in range(4)] + [(2, 0)], "g long, node long")
    edges = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 2, 0)], "g long, src long, dst long")
    t = graph.transition(nodes, edges, "g")
    p = graph.walk_powers(t, "g", 3)
    assert all(r[0] == pytest.approx(1) for r in p.groupBy("g", "k", "i").agg(F.sum("p")).select("sum(p)").collect())
    own = {(r.g, r.node, r.k): r.p for r in graph.rrwp_nodes(p, t, "g").collect()}
    nested = spark.createDataFrame([(1, 4, [0, 1, 2], [1, 2, 0]), (2, 1, [], [])], "g long, n int, src array<int>, dst array<int>")
    for r in graph.rrwp_per_graph(nested, "g", 3).collect():
        for node, walk in enumerate(r.node_walk):
            assert walk == pytest.approx([own[r.g, node, k] for k in (1, 2, 3)])
    assert graph.rrwp_per_graph(nested, "g", 2, "zero").where("g = 2").first().node_walk == [[0.0, 0.0]]


def test_softmax_sums_to_one(spark):
    df = spark.createDataFrame([("a", 1000.0), ("a", 1001.0), ("b", -5.0)], "s string, x double")
    got = graph.segment_softmax(df, ["s"], "x").groupBy("s").agg(F.sum("weight").alias("w"), F.max("weight").alias("m")).collect()
    assert all(r.w == pytest.approx(1) for r in got) and {round(r.m, 4) for r in got} == {0.7311, 1.0}


def test_kabsch_recovers_a_rotation(spark):
    rng = np.random.default_rng(2)
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    a = rng.normal(size=(20, 3))
    b = a @ q.T + [5, -3, 7]
    df = spark.createDataFrame([(1, *map(float, x), *map(float, y)) for x, y in zip(a, b)], "g int, x double, y double, z double, u double, v double, w double")
    r = graph.kabsch(graph.centroid_covariance(df, "g", list("xyz"), list("uvw"), F.lit(1.0)), "g", list("xyz"), list("uvw")).first().rotation
    rotation = np.array(r).reshape(3, 3)
    assert np.allclose(rotation, q, atol=1e-8) and np.linalg.det(rotation) == pytest.approx(1)


def test_penalty_is_zero_for_one_row(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    assert graph.off_diagonal_penalty(df, ["a", "b"]).first()[0] == 0.0


# ----------------------------------------------------------------- maps, sources, sinks
def test_fallible_rows_and_time_limit(spark):
    def slow(x):
        import time

        if x == "slow":
            time.sleep(5)
        return int(x)

    df = spark.createDataFrame([("1",), ("x",), (None,), ("slow",)], "s string")
    got = {r.s: (r.value, (r.error or "")[:12]) for r in fallible.fallible_map(df, "s", slow, "int", 0.3).collect()}
    assert got == {"1": (1, ""), "x": (None, "ValueError: "), None: (None, ""), "slow": (None, "TimeoutError")}


def test_per_task_and_once_per_key(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "t string, y double")
    got = fallible.per_task(df, "t", lambda g: g.assign(mean=g.y.mean())[["t", "mean"]].head(1), "t string, mean double")
    assert rows(got) == [("a", 2.0), ("b", 5.0)]
    cached = fallible.once_per_key(df, "t", lambda k: k.withColumn("n", F.length("t")))
    assert cached.count() == 3


def test_text_functions(spark):
    assert one(spark, keys.shard_of_path(F.lit("/x/part_0042.parquet"))) == 42 and one(spark, keys.shard_of_path(F.lit("none"))) is None
    assert one(spark, keys.zero_padded(F.lit(7), 10)) == "007" and one(spark, keys.zero_padded(F.lit(12), 20000)) == "00012"
    assert one(spark, keys.parse_list(F.lit(" a, b,,c "))) == ["a", "b", "c"] and one(spark, keys.parse_pairs(F.lit("a:1,b:2.5"))) == {"a": 1.0, "b": 2.5}
    assert one(spark, keys.truthy(F.lit("Yes"))) is True and one(spark, keys.truthy(F.lit("?"))) is None
    assert one(spark, keys.signed_text(F.lit(0.5))) == "+0.500" and one(spark, keys.number_or(F.lit("-"), 0.0)) == 0.0
    assert one(spark, numeric.encode(F.lit("?"), ["a", "b"])) == 2 and one(spark, numeric.encode(F.lit(None).cast("string"), ["a", "b"])) == 2
    assert one(spark, numeric.ema(F.array(F.lit(1.0), F.lit(2.0)), 0.5)) == 1.5


def test_sources_and_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(f"k{i}", i % 3, float(i)) for i in range(30)], "k string, shard_id int, v double")
    sinks.write_shards(df, f"{tmp_path}/shards", "k", seed=1)
    assert rows(spark.read.parquet(f"{tmp_path}/shards").select("k", "shard_id", "v")) == rows(df)
    sinks.write_split(df.withColumn("is_val", F.col("v") > 20), f"{tmp_path}/split", "k")
    assert spark.read.parquet(f"{tmp_path}/split").where("is_val = 'true'").count() == 9
    sinks.write_rows_per_file(df.coalesce(1), f"{tmp_path}/rows", 7)
    assert len(spark.read.parquet(f"{tmp_path}/rows").inputFiles()) == 5
    assert tables.discover(spark, f"{tmp_path}/shards").count() == 30
    with pytest.raises(Exception):
        tables.discover(spark, f"{tmp_path}/shards", "*.none").count()
    assert sinks.write_manifest(df.agg(F.count("*").alias("n")), f"{tmp_path}/m.json", seed=1) == {"n": 30, "seed": 1}
    assert json.load(open(f"{tmp_path}/m.json")) == {"n": 30, "seed": 1}
    sinks.write_json_sorted(df.where("v < 3"), f"{tmp_path}/s.json", "k")
    assert [r["k"] for r in json.load(open(f"{tmp_path}/s.json"))] == ["k0", "k1", "k2"]
    for v in (1.0, 2.0):
        sinks.upsert_parquet(spark, f"{tmp_path}/u", spark.createDataFrame([("a", v)], "k string, v double"), ["k"])
    assert rows(sinks.read_upserted(spark, f"{tmp_path}/u")) == [("a", 2.0)]
    sinks.write_with_quarantine(spark.createDataFrame([(1, None), (2, "bad")], "i int, error string"), f"{tmp_path}/good", f"{tmp_path}/bad")
    assert spark.read.parquet(f"{tmp_path}/good").count() == spark.read.parquet(f"{tmp_path}/bad").count() == 1
    with pytest.raises(KeyError):
        tables.require(df, ["k", "missing"])
    assert tables.label_columns(df, "v") == ["v"]
    sinks.merge_shards(spark, [f"{tmp_path}/shards/shard_id={i}" for i in range(3)], f"{tmp_path}/merged", 1)
    assert spark.read.parquet(f"{tmp_path}/merged").count() == 30


def test_result_files_in_both_layouts(spark, tmp_path):
    cube = {"1": {"t": {"rmse": 0.5}}, "2": {"t": {"rmse": 0.6}}}
    (tmp_path / "flat").mkdir()
    (tmp_path / "flat/a.json").write_text(json.dumps(cube))
    (tmp_path / "flat/_b.json").write_text(json.dumps(cube))
    (tmp_path / "flat/c.json").write_text("not json")
    (tmp_path / "deep/m").mkdir(parents=True)
    (tmp_path / "deep/m/results.json").write_text(json.dumps(cube))
    for layout, method in (("flat", "a"), ("deep", "m")):
        assert rows(tables.result_files(spark, f"{tmp_path}/{layout}")) == [(method, "1", "t", "rmse", 0.5), (method, "2", "t", "rmse", 0.6)]
    (tmp_path / "none").mkdir()
    assert tables.result_files(spark, f"{tmp_path}/none").count() == 0
    (tmp_path / "dim.json").write_text('{"a": 1, "b": {"x": 2}}')
    assert rows(tables.json_dimension(spark, f"{tmp_path}/dim.json")) == [("a", "1"), ("b", '{"x": 2}')]
    (tmp_path / "keys.txt").write_text("k1\n\n k2 \n")
    assert rows(tables.keys_file(spark, f"{tmp_path}/keys.txt")) == [("k1",), ("k2",)]


def test_last_shard_is_validation(spark, tmp_path):
    spark.range(4).coalesce(1).write.parquet(f"{tmp_path}/a")
    import glob
    import os

    (tmp_path / "s").mkdir()
    part = glob.glob(f"{tmp_path}/a/*.parquet")[0]
    for i in (0, 9, 10):
        os.link(part, f"{tmp_path}/s/shard_{i:03}.parquet")
    train, val = tables.split_last(tables.shards(spark, f"{tmp_path}/s"))
    assert train.count() == 8 and {r.shard for r in val.collect()} == {10}


def test_records_and_array_files(spark, tmp_path):
    (tmp_path / "s.txt").write_text("a\nx\n$$$$\nb\ny\n$$$$\na\nz\n$$$$\n")
    r = tables.text_records(spark, f"{tmp_path}/s.txt", "$$$$")
    assert rows(tables.grouped_records(r, F.substring_index("record", "\n", 1))) == [("a", ["a\nx", "a\nz"]), ("b", ["b\ny"])]
    np.save(tmp_path / "m.npy", np.arange(6.0).reshape(3, 2))
    assert rows(tables.array_files(spark, f"{tmp_path}/*.npy")) == [("m.npy", 0, [0.0, 1.0]), ("m.npy", 1, [2.0, 3.0]), ("m.npy", 2, [4.0, 5.0])]


def test_registry_of_tasks(spark):
    losses = {"gap_cation_1": "huber", "gap": "huber", "p": "beta_nll", "o": "ordinal"}
    r = features.task_registry(spark, losses, ("beta_nll",), ("cation",))
    assert rows(r.select("task")) == [("gap",), ("o",)]
    with pytest.raises(ValueError):
        features.task_registry(spark, {"x": "none"})
    wide, each = (features.group_assays(r, "set", ["a", "b"], e) for e in (False, True))
    assert wide.where("task = 'set'").first().n_outputs == 2 and each.where("task like 'set/%'").count() == 2
    assert {tuple(x.tasks) for x in features.outputs_by_size(r).collect()} == {("gap",), ("o",)}


def test_weights_of_a_step_sum_to_one(spark):
    df = spark.createDataFrame([(s, t, float(1 + i), -0.5, 1.0) for s in (0, 1) for i, t in enumerate("abc")], "step int, task string, loss double, scale double, nadir double")
    for name in ("equal", "random", "uncertainty", "chebyshev"):
        w = weighting.WEIGHTINGS[name](df, "step", "task", "loss").groupBy("step").agg(F.sum("weight").alias("w")).collect()
        assert all(r.w == pytest.approx(1) for r in w)
    assert one(spark, weighting.ramped(F.lit(5), 11, 1.0, 0.0)) == pytest.approx(0.5) and one(spark, weighting.ramped(F.lit(0), 1, 1.0, 0.3)) == pytest.approx(0.3)


def test_components_by_explained_share(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 2)) @ rng.normal(size=(2, 5)) + rng.normal(size=(60, 5)) * 1e-6
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "i int, v array<double>")
    got = np.array([r.components for r in features.principal_components(df, "v", 0.999).orderBy("i").collect()])
    _, s, _ = np.linalg.svd(x - x.mean(0))
    assert got.shape == (60, 2) and np.allclose((got**2).sum(0), s[:2] ** 2, rtol=1e-6)
    assert len(features.principal_components(df, "v", 3).first().components) == 3


def test_complete_rows_and_sentinels(spark):
    df = spark.createDataFrame([("a", 0.0), ("b", None), ("c", 2.0)], "k string, v double")
    assert rows(features.complete_rows(df, ["v"], spark.createDataFrame([("a",), ("b",)], "k string"), "k")) == [("a", 0.0)]
    assert one(spark, features.fill_sentinel(F.lit(0.0), F.lit(True), F.lit(9.0))) == 9.0 and one(spark, features.has_edges(F.array())) is False


def test_steps_that_hang_or_die_are_killed(spark):
    import os
    import time

    def hang(x):
        if x == 1:
            time.sleep(60)
        if x == 2:
            os._exit(3)
        return x * 10

    def last(x):
        if x == 2:
            raise ValueError("not two")
        return x * 100

    got = fallible.fallback_map(spark.createDataFrame([(1,), (2,), (3,), (None,)], "x long"), "x", [hang, last], "bigint", seconds=1.5).collect()
    by = {r.x: r for r in got}
    assert (by[1].value, by[1].step) == (100, 1) and (by[3].value, by[3].step) == (30, 0)
    assert by[2].value is None and "died" in by[2].error and "not two" in by[2].error
    assert by[None].value is None and by[None].error is None


def test_edge_tables_are_not_broadcast(spark):
    """Exploded edges look as small as their rows to Spark: joins with them go without a copy in the driver."""
    nodes = spark.range(50).selectExpr("'g' as g", "id as src")
    edges = nodes.selectExpr("g", "src", "explode(array(src + 1, src + 4)) as dst")
    bonds = nodes.where("src % 5 = 3").selectExpr("g", "src", "src + 1 as dst", "'E' as kind", "src - 1 as s_src", "src + 2 as s_dst")
    for df in (graph.without_real(graph.across_double(bonds, edges, "g"), edges, "g"), graph.virtual_edges(edges.select("g", "src", (edges.dst + 1).alias("dst")), edges, "g")):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
        assert df.count() > 0


def test_rows_that_hang_wait_beside_each_other(spark):
    """Thirty rows of one partition that take their whole second, and two that die: one after another they would take half a minute."""
    import os
    import time

    def hang(x):
        if x < 30:
            time.sleep(60)
        if x < 32:
            os._exit(3)
        return x * 10

    df = spark.range(100).coalesce(1).withColumnRenamed("id", "x")
    start = time.monotonic()
    got = {r.x: (r.value, r.step, r.error) for r in fallible.fallback_map(df, "x", [hang, lambda x: -x], "bigint", seconds=1.0).collect()}
    assert time.monotonic() - start < 20
    assert got == {x: (-x, 1, None) if x < 32 else (10 * x, 0, None) for x in range(100)}


def test_win_rules_where_the_second_best_differs(spark):
    """The best is not apart from c, though the second best is: c is still on top. A method that lacks a task loses it."""
    s = spark.createDataFrame([("t", m, v) for m, v in (("a", 3.0), ("b", 2.0), ("c", 1.0))], "task string, method string, mean double")
    pairs = spark.createDataFrame([("t", "a", "b", 3.0, 2.0, False), ("t", "a", "c", 3.0, 1.0, False), ("t", "b", "c", 2.0, 1.0, True)], "task string, method_a string, method_b string, mean_a double, mean_b double, rejected boolean")
    assert {r.method: r.top_rank for r in compare.top_ranks(pairs, s, F.lit(True)).collect()} == {"a": 1, "b": 1, "c": 1}
    assert rows(compare.pair_wins(pairs, F.lit(True)).select("method", "other", "wins", "ties")) == [("a", "b", 0, 1), ("a", "c", 0, 1), ("b", "a", 0, 1), ("b", "c", 1, 0), ("c", "a", 0, 1)]
    scores = spark.createDataFrame([("t1", "a", 1.0), ("t2", "a", 1.0), ("t1", "b", 0.9995)], "task string, method string, v double")
    assert {r.method: (r.win_percent, r.n_tasks) for r in compare.win_percent(scores, "task", F.col("v")).collect()} == {"a": (100.0, 2), "b": (50.0, 2)}
    with pytest.raises(ValueError):
        compare.significant(pairs, "other")


def test_a_lost_pointer_finds_the_newest_table(spark, tmp_path):
    import os

    for v in (1.0, 2.0, 3.0):
        sinks.upsert_parquet(spark, f"{tmp_path}/u", spark.createDataFrame([("a", v)], "k string, v double"), ["k"])
    os.remove(f"{tmp_path}/u/current.txt")
    assert rows(sinks.read_upserted(spark, f"{tmp_path}/u")) == [("a", 3.0)]
    with pytest.raises(FileNotFoundError):
        sinks.read_upserted(spark, f"{tmp_path}/none")


def test_running_counts_of_one_hot_key(spark):
    df = spark.createDataFrame([("a", i, i % 3) for i in range(50)] + [("b", 0, 2), (None, 1, 4)], "k string, v long, c long")
    got = {(r.k, r.v): r.upto_c for r in ragged.running_counts(df, ["k"], "v", ["c"]).collect()}
    total, want = 0, {("b", 0): 2, (None, 1): 4}
    for i in range(50):
        total += i % 3
        want["a", i] = total
    assert got == want
