"""Filter audit and license scan against brute force."""

import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from corpus import documents
from pyspark.sql import functions as F

from marlstone.llm import filter_audit, license_scan, license_templates

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
LOW = {c: c + 32 for c in range(65, 91)}


# ----------------------------------------------------------------- 11
def fails(text):
    t = text or ""
    w = SPACE.findall(t)
    return {
        "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w),
        "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": any(c in "#$%&*|" for c in t),
    }


def audited(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, x in labels if x == 1}
    least = {}
    for i, t, _ in rows:
        place = (i is None, i or 0)
        least[t or ""] = min(least.get(t or "", place), place)
    marked = [(s or "", {k for k, v in (fails(t) | {"E": (i is None, i or 0) > least[t or ""]}).items() if v}, i in good and i is not None, i in toxic and i is not None) for i, t, s in rows]
    out, shapley = [], Counter()
    for part in {s for s, *_ in marked}:
        docs = [x[1:] for x in marked if x[0] == part]
        for order in itertools.permutations("ABCDE"):
            left = docs
            for k, f in enumerate(order):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                shapley[part, f] += len(gone)
                failing = sum(f in d[0] for d in docs)
                out.append((part, "".join(order), k + 1, len(left), len(gone), failing - len(gone), sum(d[0] == {f} for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone)))
    return Counter((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


def test_audit_equals_brute_force(spark):
    rng = random.Random(11)
    rows = []
    for i, t in documents(11):
        t = t if t is None or rng.random() < 0.6 else t.upper() if rng.random() < 0.3 else t + rng.choice([" #", " 5% &", " a" * 300, " " + " ".join(map(str, range(250)))])
        rows.append((i, t, rng.choice(["s", "s", "s", "r", "", None])))
    rows += [(rng.choice([7, 8, None, 900]), rows[4][1], "r") for _ in range(8)] + [(1000, None, "s"), (1001, "", None), (None, "only null ids", "s"), (None, "only null ids", "s"), (None, "only null ids", "r")]
    labels = [(rng.choice(rows)[0], rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(60)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, mask int, n int")
    given = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    flags = {"good_lost": F.col("quality") == 1, "toxic_lost": F.col("toxic") == 1}
    got = filter_audit.filter_audit(df, filter_audit.text_conditions(F.col("text")), given, flags, duplicates="E")
    assert Counter(tuple(r) for r in got.collect()) == audited(rows, labels)


def test_audit_of_nothing_of_few_filters_and_of_too_many(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    conditions = filter_audit.text_conditions(F.col("text"))
    assert filter_audit.filter_audit(empty, conditions, labels, {}, duplicates="E").count() == 0
    df = spark.createDataFrame([(1, "x # y", None), (2, "x", "s")], "doc_id long, text string, source string")
    got = filter_audit.filter_audit(df, {"A": conditions["A"], "D": conditions["D"]}, labels, {"good": F.col("quality") == 1})
    assert {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good, r.shapley) for r in got.collect()} == {
        ("", "AD", 1): (0, 1, 0, 0, 0, 1), ("", "AD", 2): (0, 0, 1, 0, 0, 1), ("", "DA", 1): (0, 1, 0, 0, 0, 1), ("", "DA", 2): (0, 0, 1, 0, 0, 1),
        ("s", "AD", 1): (0, 1, 0, 1, 0, 2), ("s", "AD", 2): (0, 0, 0, 0, 0, 0), ("s", "DA", 1): (1, 0, 0, 0, 0, 0), ("s", "DA", 2): (0, 1, 0, 1, 0, 2),
    }
    with pytest.raises(ValueError):
        filter_audit.filter_audit(df, {c: F.lit(True) for c in "ABCDEFGH"}, labels, {})
    with pytest.raises(ValueError):
        filter_audit.filter_audit(df, {"A": F.lit(True)}, labels, {"kept": F.col("quality") == 1})


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6])
def test_every_order_is_one_swap_from_the_last(n):
    rng = np.random.default_rng(n)
    cells, seen, last = rng.integers(0, 9, (1 << n, 2)), set(), None
    masks = np.arange(1 << n)
    for order, removed, before in filter_audit.walk(cells, n):
        assert last is None or sum(a != b for a, b in zip(order, last, strict=True)) == 2
        last = list(order)
        seen.add(tuple(order))
        for k, f in enumerate(order):
            ahead = sum(1 << x for x in order[:k])
            assert before[k] == ahead
            assert (removed[k] == cells[(masks & ahead == 0) & (masks >> f & 1 == 1)].sum(0)).all()
    assert seen == set(itertools.permutations(range(n)))


# ----------------------------------------------------------------- 12
def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def searched(text, templates):
    """(labels, share) by regular expressions."""
    joined = "".join(w + " " for w in words(text))
    found, best = set(), 0.0
    for label, markup in templates:
        for tree, share in license_scan.sections(license_scan.parse(markup)):
            if re.search("(?:^| )" + license_scan.pattern(tree), joined):
                best = max(best, share)
                found |= {label} if share == 1 else set()
    return found, best


def made_up(rng, depth=0):
    parts = [rng.choice("abc")] if depth == 0 else []
    for _ in range(rng.randrange(1, 6)):
        kind = rng.randrange(8)
        if kind == 0 and depth < 2:
            parts.append(f"<<beginOptional>>{made_up(rng, depth + 1)}<<endOptional>>")
        elif kind == 1:
            a = rng.randrange(3)
            parts.append(f'<<var;name="x";original="y";match=".{{{a},{a + rng.randrange(4)}}}">>')
        elif kind == 2:
            parts.append('<<var;name="x";original="y";match="' + "|".join(" ".join(rng.choices("abc", k=rng.randrange(1, 3))) for _ in range(2)) + '">>')
        else:
            parts.append(rng.choice("abc"))
        if rng.random() < 0.3 and depth == 0:
            parts.append("\n")
    return " ".join(parts)


def test_automaton_accepts_what_the_regular_expression_does():
    rng, hits = random.Random(12), 0
    for _ in range(400):
        templates = [(str(k), made_up(rng)) for k in range(3)]
        text = " ".join(rng.choices("abc", weights=[4, 3, 1], k=rng.randrange(40)))
        machine, label = license_scan.compile_templates(templates, {})
        n, marks, share = license_scan.read(machine, text.encode(), piece=rng.choice([1, 7, 1000]))
        want, best = searched(text, templates)
        assert n == len(words(text)) and {label[k] for k, _, _ in marks} == want and max(share.values(), default=0.0) == best, (templates, text)
        for k, a, b in marks:
            assert re.fullmatch(license_scan.pattern(license_scan.parse(templates[k][1])), "".join(w + " " for w in words(text)[a:b]))
        hits += len(want)
    assert hits > 100


def whole(markup, rng):
    """A text of a template: optional regions in or out, replaceable ones by their original."""
    text = re.sub(r'<<var;name="[^"]*";original="([^"]*)";[^>]*>>', r"\1", markup)
    return re.sub(r"<<beginOptional>>(.*?)<<endOptional>>", lambda m: m[1] if rng.random() < 0.5 else "", text, flags=re.S)


def test_scan_of_documents(spark):
    rng = random.Random(5)
    rows = [(i, t) for i, t in documents(5)]
    for i, (_, markup) in enumerate(license_templates.TEMPLATES):
        text = whole(markup, rng)
        broken = words(text)
        broken[len(broken) // 2] = "not"
        rows += [(500 + i, f"Before. {text.upper()} And\nafter."), (600 + i, " ".join(broken)), (700 + i, " ".join(broken[: len(broken) // 2]))]
    rows += [(800, "MIT License, mit-license; the Apache LICENSE. mit mit license general  public license"), (801, "mit"), (802, None), (None, "Released under the MIT License."), (None, "Released under the MIT License."), (803, "permission is hereby granted " * 20_000)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, labels string, n_words int")
    got = license_scan.scan(df).collect()
    assert len(got) == len(rows)
    by_text = {i: t for i, t in rows if i is not None and i >= 500}
    for r in got:
        if r.doc_id is None or r.doc_id < 500:
            continue
        w, base, at = words(by_text[r.doc_id]), set(), []
        for phrase, label in license_templates.PHRASES.items():
            p = phrase.split()
            here = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            at += here
            base |= {label} if here else set()
        found, best = searched(by_text[r.doc_id], license_templates.TEMPLATES)
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min(at, default=None), max(at, default=None))
        assert (r.base_labels, r.labels, r.score) == (sorted(base), sorted(base | found), best)
        assert {s.label for s in r.spans} == found
    for i, (label, _) in enumerate(license_templates.TEMPLATES):
        assert label in {x for r in got if r.doc_id == 500 + i for x in r.labels}
    assert Counter((r.n_base, tuple(r.labels), r.score) for r in got if r.doc_id is None)[1, ("mit",), 1.0] == 2
    assert license_scan.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("bad", ["<<beginOptional>>x", "x <<endOptional>>", "<<beginOptional>>x<<endOptional>>", '<<var;name="a";original="b";match=".{1,2}">> x', ""])
def test_markup_that_is_refused(bad):
    with pytest.raises(ValueError):
        license_scan.compile_templates([("x", bad)], {})
