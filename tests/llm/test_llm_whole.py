"""What the queries and stages once left out."""

import random
from collections import Counter

import corpus_pipeline
from test_llm_operators import lines_left

from marlstone.llm import common, queries


def test_the_pipeline_leaves_no_repeated_line_however_short(spark, tmp_path):
    nine, seven = "a line of nine words that is not long", "Licensed under the Apache License, Version 2.0."
    rows = [(i, "\n".join([seven, f"own line {i}", nine, "Les.", f"more {i}", "Les."])) for i in range(12)] + [(20, "Les."), (21, None)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n_chars int")
    left = corpus_pipeline.drop_repeated_lines(spark, docs, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.text or "", r.n_chars or 0) for r in left) == sorted((i, t, len(t)) for i, n, gone, t in lines_left(rows, 1) if not n or gone < n)
    kept = [x for r in left for x in (r.text or "").split("\n")]
    assert all(kept.count(x) == 1 for x in (nine, seven, "Les."))


def test_near_copies_never_share_a_bin(spark, tmp_path):
    base = [[f"w{k}_{j}" for j in range(100)] for k in range(5)]
    rows = [(20 * k + i, " ".join([*base[k][:i], "changed", *base[k][i + 1 :]]) if i < 2 else " ".join(base[k]), f"s{i}") for k in range(5) for i in range(4)] + [(200, None, "s9"), (201, "", "s9")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op2_packing(spark, str(tmp_path)).collect()
    placed = [(r.shard, r.bin, r.doc_id // 20) for r in got if r.bin is not None]
    assert len(placed) == 20 == len(set(placed))
    assert sorted((r.doc_id, r.n_tokens) for r in got) == sorted((i, len((t or "").split())) for i, t, _ in rows)


def test_rows_of_the_pipeline_are_judged_by_themselves(spark, tmp_path):
    """Two classes of labels, a contaminated null id, repeated ids with other texts, repeated rows."""
    rng = random.Random(5)
    calm = ["river", "stone", "cloud", "meadow", "paper", "window", "garden", "simple", "quiet", "letter"]
    own = lambda n: " ".join(rng.choice(calm) + "abcdefghij"[rng.randrange(10)] for _ in range(n))
    rows = [(i, own(rng.randrange(20, 90)) + (" you grumblatt and zorgvuk!" if i % 5 == 0 else "")) for i in range(300)]
    item = " ".join(f"item{x}" for x in "abcdefghijklmnopqrst")
    rows += [(None, f"{own(30)} {item}"), (None, own(30)), (7, f"{own(30)} {item}"), (1000, rows[3][1]), (3, own(30)), (1, rows[1][1]), (None, rows[2][1]), (None, None), (None, None), (4, " ")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    left = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    toxic = [(i, t) for i, t in rows if "zorgvuk" in (t or "")]
    want = Counter(rows) - Counter(toxic)
    assert Counter((r.doc_id, r.text) for r in left.collect()) == want

    left = corpus_pipeline.keep_one_of_each_group(spark, spark.createDataFrame(left.collect(), docs.schema), str(tmp_path))
    want = Counter(set(want)) - Counter([(1000, rows[3][1]), (None, rows[2][1])]) + Counter([(None, None)])
    assert Counter((r.doc_id, r.text) for r in left.collect()) == want

    left = corpus_pipeline.drop_contaminated(spark, spark.createDataFrame(left.collect(), docs.schema), str(tmp_path))
    assert Counter((r.doc_id, r.text) for r in left.collect()) == Counter({r: n for r, n in want.items() if item not in (r[1] or "")})


def test_a_run_leaves_only_the_tables_of_its_result(spark, tmp_path):
    texts = [" ".join(f"w{k}_{j}" for j in range(60)) for k in range(5)]
    spark.createDataFrame([(i, texts[i % 5], "en", "s", 9) for i in range(12)], "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "not there")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    before = common.held()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 5
    assert len(common.held() - before) <= 2
