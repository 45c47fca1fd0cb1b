"""The attention layer against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.operators import attention as A

H, D = 2, 3


def by_hand(nodes, edges, mix, edge_values, scaler, clamp):
    q, k, v = ({n: np.array(x[j]) for *n_, x in [(0, 0)] for n, x in nodes.items()} for j in range(3))
    out = {}
    for n in nodes:
        incoming = [e for e in edges if e[0] == n[0] and e[2] == n[1] and e[3] == n[2]]
        h = n[2]
        logits, scores, values = [], [], []
        for g, src, _, _, ew, eb, bias in incoming:
            p = q[n] * k[g, src, h] * np.array(ew)
            s = np.sign(p) * np.sqrt(np.abs(p) + 1e-9)
            s = (s if clamp is None else np.clip(s, -clamp, clamp)) + eb
            x = s @ mix[h] / np.sqrt(D) + bias
            logits.append(x if clamp is None else np.clip(x, -clamp, clamp))
            scores.append(s)
            values.append(v[g, src, h])
        if incoming:
            w = np.exp(np.array(logits) - max(logits))
            w /= w.sum()
            m = w @ np.array(values) + np.array(edge_values[h]) @ (w @ np.array(scores))
        else:
            m = np.zeros(D)
        c = np.array(scaler[h])
        out[n] = (len(incoming), m * c[:, 0] + m * np.log1p(len(incoming)) * c[:, 1])
    return out


@pytest.mark.parametrize("clamp", [5.0, 0.5, None])
def test_attention_equals_numpy(spark, clamp):
    rng = np.random.default_rng(3)
    nodes = {(g, n, h): [rng.normal(size=D).tolist() for _ in range(3)] for g in (1, 2) for n in range(6) for h in range(H)}
    ends = {(1, int(s), int(d)) for s, d in rng.integers(0, 5, (12, 2))} | {(2, s, 0) for s in range(6)} | {(2, 0, 1)}  # node 5 of graph 1 stands alone, node 0 of graph 2 gets all
    edges = [(g, s, d, h, (3 * rng.normal(size=D)).tolist(), rng.normal(size=D).tolist(), float(rng.normal())) for g, s, d in sorted(ends) for h in range(H)]
    mix, values, scaler = rng.normal(size=(H, D)).tolist(), rng.normal(size=(H, D, D)).tolist(), rng.normal(size=(H, D, 2)).tolist()
    n = spark.createDataFrame([(*key, *x) for key, x in nodes.items()], "graph int, node int, head int, q array<double>, k array<double>, v array<double>")
    e = spark.createDataFrame(edges, "graph int, src int, dst int, head int, ew array<double>, eb array<double>, bias double")
    got = {(r.graph, r.node, r.head): (r.degree, r.out) for r in A.attention(e, n, "graph", mix, values, scaler, clamp).collect()}
    want = by_hand(nodes, edges, mix, values, scaler, clamp)
    assert got.keys() == want.keys() and (1, 5, 0) in got
    for key, (degree, out) in want.items():
        assert got[key][0] == degree and np.allclose(got[key][1], out, atol=1e-9)


def test_a_bounded_mix_shuffles_sums_alone(spark):
    """With a clamp there is one aggregate and no join above the two gathers."""
    n = spark.createDataFrame([(1, 0, 0, [1.0], [1.0], [1.0])], "graph int, node int, head int, q array<double>, k array<double>, v array<double>")
    e = spark.createDataFrame([(1, 0, 0, 0, [1.0], [0.0], 0.0)], "graph int, src int, dst int, head int, ew array<double>, eb array<double>, bias double")
    plan = A.attention(e, n, "graph", [[1.0]], [[[1.0]]], [[[1.0, 0.0]]], 5.0)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 2 and plan.count("Aggregate [") == 1


def test_pool_and_joined_heads(spark):
    rows = [("a", 0, 800.0, [1.0, 2.0]), ("a", 0, 801.0, [3.0, 4.0]), ("a", 1, -900.0, [5.0, 6.0]), ("b", 0, None, [7.0, 8.0]), ("b", 1, 0.0, [9.0, 10.0])]
    df = spark.createDataFrame(rows, "g string, head int, x double, v array<double>")
    got = {r.g: r.v for r in A.joined_heads(A.attention_pool(df, "g", F.col("x"), "v", 2), ["g"], "v", 2).collect()}
    w = 1 / (1 + np.exp(1))
    assert np.allclose(got["a"], [w + 3 * (1 - w), 2 * w + 4 * (1 - w), 5, 6]) and got["b"] == [0, 0, 9, 10]
