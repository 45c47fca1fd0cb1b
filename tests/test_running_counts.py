"""Running sums by key over ranges of the order."""

import random

import pytest
from marlstone.operators.ragged import running_counts
from pyspark.sql import functions as F


@pytest.mark.parametrize("parts,batch", [(1, 1), (4, 3), (9, 1000), (40, 2)])
def test_running_counts_equal_sums(spark, parts, batch):
    rng = random.Random(parts)
    rows = [(k, x, v, rng.randrange(5), rng.choice([0, 1, None])) for k, x, n in (("a", 1, 90), ("a", None, 3), (None, 1, 1), ("b", 2, 25), ("c", 2, 1)) for v in rng.sample(range(1000), n)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, x int, v int, c int, p int")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
        up = {(r.k, r.x, r.v): (r.upto_c, r.upto_p) for r in running_counts(df, ["k", "x"], "v", ["c", "p"]).collect()}
        down = {(r.k, r.x, r.v): r.upto_c for r in running_counts(df, ["k", "x"], F.desc("v"), ["c"]).collect()}
        alone = {r.v: r.upto_c for r in running_counts(df.where("k = 'a' and x = 1"), [], "v", ["c"]).collect()}
        assert running_counts(df.where("false"), ["k"], "v", ["c"]).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for k, x, v, _, _ in rows:
        own = [r for r in rows if r[:2] == (k, x)]
        assert up[k, x, v] == (sum(r[3] for r in own if r[2] <= v), sum(r[4] or 0 for r in own if r[2] <= v))
        assert down[k, x, v] == sum(r[3] for r in own if r[2] >= v)
        if (k, x) == ("a", 1):
            assert alone[v] == up[k, x, v][0]
    assert len(up) == len(rows)
