"""Both jobs against plain Python, run again, run over growing input, cut short, and from the command line."""

import glob
import hashlib
import json
import os
import random
import re
import shutil
import subprocess
import sys
from pathlib import Path

import pyarrow as pa
import pytest
from jobs import corpus_intake, texts, training_shards
from jobs import queries as job_queries
from jobs.common import canonical_key, kept_settings, settings_of
from marlstone.operators import corpus as corpus_operators

SPACE = re.compile(r"[\x20\x09-\x0D]+")
LOW = {c: c + 32 for c in range(65, 91)}
ROWS = "doc_id long, text string, lang string, source string"


def md5(x):
    return hashlib.md5(x.encode()).hexdigest()


def plain(text):
    return SPACE.sub(" ", (text or "").translate(LOW)).strip(" ")


def bucket(n, x):
    return int(md5(x)[:8], 16) % n


def documents(seed, n=80):
    rng = random.Random(seed)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(rng.randrange(1, 40))) for _ in range(n)]
    rows = [(i, rng.choice(texts), rng.choice(["en", "de", None]), rng.choice(["s", "t"])) for i in range(n)]
    rows += [(i + n, rng.choice(rows)[1].upper().replace(" ", " \n\t"), "en", "u") for i in range(10)]
    return [*rows, (n + 50, None, "en", "s"), (n + 51, " \n", "en", "s"), (None, "no id", "en", "s"), rows[3], rows[3], (rows[4][0], "another text of one id", "en", "s"), (n + 52, "É À é", "fr", None)]


def least(rows):
    """Key to the row that stays."""
    out = {}
    for r in rows:
        if r[0] is not None and (p := plain(r[1])):
            place = (r[0], md5(r[1]), r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")
            if md5(p) not in out or place < out[md5(p)][0]:
                out[md5(p)] = (place, r)
    return {k: r for k, (_, r) in out.items()}


# ----------------------------------------------------------------- texts
ODD = ["", " \t", None, "a", "A\tB  c\r\n", "".join(map(chr, range(1, 600))), "\x00 \x00\x00 \x1c a\x85b\xa0c", "É é ẞ K k", "x" * 50 + " Y " + "x" * 49 + " y", "12345678 1234567 123456789 " * 9, "w" * 3000 + " a b c", " ".join(map(str, range(2000))), "a b a b b a"]


def test_keys_are_those_of_the_plain_texts(spark):
    want = [md5(plain(t)) if plain(t) else None for t in ODD]
    assert texts.keys_of(pa.array(ODD)).to_pylist() == want and texts.keys_of(pa.array(ODD, pa.large_string())[3:]).to_pylist() == want[3:]
    assert texts.keys_of(pa.array([b"\xff A"], pa.binary()).view(pa.string())).to_pylist() == [hashlib.md5(b"\xff a").hexdigest()]
    got = spark.createDataFrame(list(enumerate(ODD)), "i int, text string").select("i", canonical_key("text").alias("key"))
    assert [r.key for r in got.sort("i").collect()] == want


@pytest.mark.parametrize("n", [1, 2, 3, 10])
@pytest.mark.parametrize("piece", [1, 100, 4 << 20])
def test_runs_are_alike_just_where_their_words_are(spark, monkeypatch, n, piece):
    monkeypatch.setattr(texts, "PIECE", piece)
    batch = pa.record_batch({"doc_id": pa.array(range(2 * len(ODD))), "text": pa.array(ODD + ODD)})
    got = [(r["doc_id"], r["run"]) for part in (batch, batch.slice(3), batch.slice(0, 0)) for b in texts.run_batches(["doc_id"], n)([part]) for r in b.to_pylist()]
    words = [(i, plain(t).split(" ")) for part in (0, 3) for i, t in list(enumerate(ODD + ODD))[part:] if plain(t)]
    want = [(i, tuple(w[k : k + n])) for i, w in words for k in range(len(w) - n + 1)]
    assert [i for i, _ in got] == [i for i, _ in want]
    assert len({(w, h) for (_, w), (_, h) in zip(want, got, strict=True)}) == len({w for _, w in want}) == len({h for _, h in got})


def test_a_text_is_gone_through_once_for_its_key_and_once_for_its_runs(spark, tmp_path):
    """keys were made three times a text, in the filter and in the result, and runs word by word in lambdas."""
    paths = tables(spark, tmp_path, documents(1), [], ["never"])
    docs = spark.read.parquet(paths["documents"])
    keyed = docs.select("doc_id", canonical_key(docs.text).alias("key"))
    plan = corpus_operators.keep_first(keyed, ["key"], ["doc_id"], "copies")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "regexp_replace" not in plan and "translate" not in plan
    plan = training_shards.windows(docs, ["doc_id"], 10)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "lambda" not in plan and "regexp_replace" not in plan


# ----------------------------------------------------------------- training shards
def shards_by_hand(rows, labels, items, s):
    runs = {tuple(w[i : i + s["overlap_words"]]) for t in items for w in [plain(t).split()] for i in range(len(w) - s["overlap_words"] + 1)}
    whole = {plain(t) for t in items}
    shares = {i for i, t, *_ in rows for w in [plain(t).split()] if any(tuple(w[k : k + s["overlap_words"]]) in runs for k in range(len(w)))}
    best = {}
    for i, q, x in labels:
        old = best.get(i, (None, None))
        best[i] = tuple(max((v for v in pair if v is not None), default=None) for pair in zip(old, (q, x), strict=True))
    out = []
    for key, r in least(rows).items():
        overlap = plain(r[1]) in whole or r[0] in shares
        val = overlap or bucket(100, key + str(s["seed"])) < int(s["val_fraction"] * 100)
        out.append((r[0], key, r[2], r[3], r[1], overlap, "val" if val else "train", bucket(s["val_shards"] if val else s["train_shards"], key), *best.get(r[0], (None, None))))
    kept = set()
    for k in (0, 1):
        for lang in {r[2] for r in out}:
            y = [r[8 + k] for r in out if r[6] == "train" and (r[2] or "") == (lang or "")]
            if y.count(1) >= s["min_pos"] and y.count(0) >= s["min_neg"] and y.count(0) + y.count(1) >= s["min_valid"]:
                kept.add((k, lang or ""))
    return sorted((r[:8] + tuple(r[8 + k] if (k, r[2] or "") in kept else None for k in (0, 1)) for r in out), key=str), kept


def tables(spark, folder, rows, labels, items):
    spark.createDataFrame(rows, ROWS).write.parquet(f"{folder}/documents")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels")
    spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string").write.parquet(f"{folder}/benchmark")
    return {k: f"{folder}/{k}" for k in ("documents", "labels", "benchmark")}


def test_training_shards_equal_plain_python_and_rerun_alike(spark, tmp_path):
    rows, rng = documents(1), random.Random(2)
    labels = [(r[0], rng.choice([0, 1, None]), rng.choice([0, 0, 1, None])) for r in rows if rng.random() < 0.8] + [(None, 1, 1), (rows[3][0], 1, None)]
    long = max((r[1] for r in rows if r[1]), key=len)
    items = ["x " + " ".join(plain(long).split()[2:9]).upper(), rows[5][1].upper(), None, "", "never"]
    s = training_shards.DEFAULTS | {"overlap_words": 6, "train_shards": 3, "files_per_shard": 2, "min_pos": 4}
    given = {"overlap_words": 6, "train_shards": 3, "files_per_shard": 2, "min_pos": 4}
    paths, out = tables(spark, tmp_path, rows, labels, items), f"{tmp_path}/out"
    want, kept = shards_by_hand(rows, labels, items, s)
    columns = ["doc_id", "key", "lang", "source", "text", "overlap", "split", "shard_id", "quality", "toxic"]
    for again in range(2):
        got = training_shards.run(spark, **paths, out=out, settings=given)
        assert sorted((tuple(r) for r in got.select(columns).collect()), key=str) == want
        assert any(r[5] for r in want) and not all(r[5] for r in want) and kept and len(kept) < 8
        tasks = [json.loads(x) for f in glob.glob(f"{out}/tasks/*.json") for x in open(f)]
        assert {(("quality", "toxic").index(t["task"].split("/")[0]), t["task"].split("/")[1]) for t in tasks if t["kept"]} == kept
        manifest = [json.loads(x) for f in glob.glob(f"{out}/manifest/*.json") for x in open(f)]
        assert manifest[0]["rows_read"] == len(rows) and manifest[0]["rows"] == len(want) and manifest[0]["rows_without_id_or_words"] == 3
        if not again:  # what a run that was cut short, or an older one, left behind
            shutil.copytree(f"{out}/data/split=train", f"{out}/data/split=old")
    assert not os.path.exists(f"{out}/data/split=old")


def test_shards_are_in_seeded_order_whatever_the_files(spark, tmp_path):
    rows = [(i, f"text number {i}", "en", "s") for i in range(300)]
    paths = tables(spark, tmp_path, rows, [], [])
    training_shards.run(spark, **paths, out=f"{tmp_path}/out", settings={"train_shards": 2})
    for file in glob.glob(f"{tmp_path}/out/data/*/*/*.parquet"):
        keys = [r.key for r in spark.read.parquet(file).collect()]
        assert keys == sorted(keys, key=lambda k: md5(k + "7"))
    assert len(glob.glob(f"{tmp_path}/out/data/split=train/shard_id=*/*.parquet")) == 2


def test_training_shards_of_nothing(spark, tmp_path):
    paths = tables(spark, tmp_path, [], [], [])
    assert training_shards.run(spark, **paths, out=f"{tmp_path}/out").count() == 0


# ----------------------------------------------------------------- intake
def land(spark, folder, name, rows, old=False):
    """A new file in the landing folder; old: with a time stamp of years ago."""
    part = f"{folder}-part-{name}"
    spark.createDataFrame(rows, ROWS).coalesce(1).write.parquet(part)
    os.makedirs(folder, exist_ok=True)
    to = f"{folder}/{name}.parquet"
    shutil.copy(glob.glob(f"{part}/*.parquet")[0], to)
    if old:
        os.utime(to, (1e9, 1e9))


def corpus(df):
    return sorted((tuple(r) for r in df.select("doc_id", "key", "lang", "source", "text", "shard_id").collect()), key=str)


def log_of(out, batch):
    return [json.loads(x) for f in glob.glob(f"{out}/log/batch={batch}/*.json") for x in open(f)][0]


def by_hand(arrivals, items, seen=None):
    """The corpus after batches of rows, and how many each added."""
    seen, added = dict(seen or {}), []
    gone = {md5(plain(t)) for t in items if plain(t)}
    for rows in arrivals:
        new = {k: r for k, r in least(rows).items() if k not in gone and k not in seen}
        seen |= new
        added.append(len(new))
    return sorted(((r[0], k, r[2], r[3], r[1], bucket(8, k)) for k, r in seen.items()), key=str), added


def intake(spark, tmp_path, **settings):
    return corpus_intake.run(spark, f"{tmp_path}/in", f"{tmp_path}/benchmark", f"{tmp_path}/out", f"{tmp_path}/cp", settings)


def test_intake_takes_only_what_is_new(spark, tmp_path):
    first, second, third = documents(3), documents(4), documents(5, 30)
    items = [first[7][1].upper(), None, ""]
    spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark")
    land(spark, f"{tmp_path}/in", "1", first)
    got = intake(spark, tmp_path)
    want, added = by_hand([first], items)
    assert corpus(got) == want and log_of(f"{tmp_path}/out", 0) == {"read": len(first), "without_id_or_words": 3, "added": added[0]}
    before = {f: os.path.getmtime(f) for f in glob.glob(f"{tmp_path}/out/**/*.parquet", recursive=True)}
    assert corpus(intake(spark, tmp_path)) == want  # nothing new, nothing written
    assert before == {f: os.path.getmtime(f) for f in glob.glob(f"{tmp_path}/out/**/*.parquet", recursive=True)}

    land(spark, f"{tmp_path}/in", "2", second + first[:20])
    land(spark, f"{tmp_path}/in", "0-late", third, old=True)
    got = intake(spark, tmp_path)
    want, added = by_hand([first, second + first[:20] + third], items)
    assert corpus(got) == want and log_of(f"{tmp_path}/out", 1)["read"] == len(second) + 20 + len(third) and log_of(f"{tmp_path}/out", 1)["added"] == added[1]
    assert before.items() <= {f: os.path.getmtime(f) for f in glob.glob(f"{tmp_path}/out/**/*.parquet", recursive=True)}.items()
    assert got.groupBy("key").count().where("count > 1").count() == 0


def test_intake_batch_that_was_cut_short_is_repeated_alike(spark, tmp_path):
    first, second = documents(6), documents(7)
    spark.createDataFrame([(1, "never")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark")
    land(spark, f"{tmp_path}/in", "1", first)
    intake(spark, tmp_path)
    land(spark, f"{tmp_path}/in", "2", second)
    want = corpus(intake(spark, tmp_path))
    for f in (f"{tmp_path}/cp/commits/1", f"{tmp_path}/cp/commits/.1.crc"):  # the stream forgets that batch 1 ended; its folders are half there
        os.remove(f)
    shutil.rmtree(f"{tmp_path}/out/corpus/batch=1")
    assert corpus(intake(spark, tmp_path)) == want == by_hand([first, second], [])[0]


def test_intake_by_bounded_batches_keeps_the_same_texts(spark, tmp_path):
    parts = [documents(k, 25) for k in range(4)]
    spark.createDataFrame([(1, "never")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark")
    for k, rows in enumerate(parts):
        land(spark, f"{tmp_path}/in", str(k), rows)
    got = intake(spark, tmp_path, max_files=1)
    assert {r.key for r in got.collect()} == set(least([r for p in parts for r in p])) and got.select("batch").distinct().count() == 4


# ----------------------------------------------------------------- both
def test_settings_are_checked_and_spark_is_left_as_it_was(spark):
    with pytest.raises(ValueError):
        settings_of({"shard": 3}, corpus_intake.DEFAULTS)
    with pytest.raises(ValueError):
        settings_of({"shards": "3"}, corpus_intake.DEFAULTS)
    assert settings_of({"val_fraction": 0}, training_shards.DEFAULTS)["val_fraction"] == 0
    old = spark.conf.get("spark.sql.unionOutputPartitioning", None)
    with pytest.raises(KeyError), kept_settings(spark, spark_sql_shuffle_partitions="3"):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "3"
        raise KeyError
    assert spark.conf.get("spark.sql.unionOutputPartitioning", None) == old and spark.conf.get("spark.sql.shuffle.partitions") == "4"


def test_given_settings_are_the_defaults():
    """The configuration files show every setting at its default."""
    here = Path(training_shards.__file__).parent
    assert json.loads((here / "training_shards.json").read_text()) == training_shards.DEFAULTS
    assert json.loads((here / "corpus_intake.json").read_text()) == corpus_intake.DEFAULTS


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables here")
@pytest.mark.parametrize("name", sorted(job_queries.QUERIES))
def test_job_queries(spark, name):
    from compare import connect, same

    same(job_queries.QUERIES[name](spark, "/root/testdata/sf0.001"), connect("/root/testdata/sf0.001"), job_queries.SQL[name])


def test_command_line(spark, tmp_path):
    spark.createDataFrame([(1, "never")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark")
    land(spark, f"{tmp_path}/in", "1", documents(8, 20))
    Path(tmp_path, "c.json").write_text('{"shards": 2}')
    call = [sys.executable, "-m", "jobs.corpus_intake", "--documents", f"{tmp_path}/in", "--benchmark", f"{tmp_path}/benchmark", "--out", f"{tmp_path}/out", "--checkpoint", f"{tmp_path}/cp", "--config", f"{tmp_path}/c.json", "--master", "local[2]"]
    done = subprocess.run(call, cwd=Path(corpus_intake.__file__).parent.parent, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr
    assert "rows in 1 batches that are new" in done.stderr
    assert {r.shard_id for r in corpus_intake.corpus_of(spark, f"{tmp_path}/out").collect()} == {0, 1}
