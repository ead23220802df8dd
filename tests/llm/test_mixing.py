import random
import re
import time
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from xylem.llm import common, mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes):
    """{source: size} -> {source: target}, by capping again and again."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    total, capped = Fraction(sum(sizes.values())), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        weights = sum(w for s, w in weight.items() if s not in capped)
        target = {s: Fraction(3 * sizes[s]) if s in capped else rest * w / weights for s, w in weight.items()}
        over = {s for s in order if s not in capped and target[s] > 3 * sizes[s]}
        if not over:
            return target
        capped |= over


def rows_of(df):
    return mixing.mix(df).collect()


@pytest.mark.parametrize("seed", [1, 2])
def test_sources_meet_their_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {"a": 400, "b": 30, "c": 1, None: 60, "é": 900, "z": 15, **{f"t{k}": 4 for k in range(9)}}
    rows = []
    for source, n in sizes.items():
        words = [7] * n if str(source).startswith("t") else [int(rng.lognormvariate(3, 1.2)) for _ in range(n)]
        rows += [(len(rows) + i, "w " * k, source) for i, k in enumerate(words)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = rows_of(df)
    total, taken, most, target = Counter(), Counter(), defaultdict(int), {}
    source_of = {d: s for d, _, s in rows}
    for r in out:
        s = source_of[r.doc_id]
        total[s] += r.size
        taken[s] += r.taken
        most[s] = max(most[s], r.size)
        target[s] = r.target
        assert r.taken % max(r.size, 1) == 0 and r.taken <= 3 * r.size
    assert {r.doc_id: r["size"] for r in out} == {d: len(WORD.findall(t)) for d, t, _ in rows}
    assert all(r.source_size == total[source_of[r.doc_id]] for r in out)
    want = brute_targets(total)
    for s in sizes:
        assert target[s] == pytest.approx(float(want[s]))
        assert abs(taken[s] - target[s]) <= most[s] / 2 + 1
        if sizes[s] >= 30:
            assert abs(taken[s] - target[s]) <= max(0.01 * target[s], 4)
    again = rows_of(df.repartition(7))
    assert sorted((r.doc_id, r.taken) for r in out) == sorted((r.doc_id, r.taken) for r in again)


def test_chances_are_fair(spark):
    """Over many sources alike, a document's copies average to its fraction (but for the last of a source, which is rounded)."""
    rows = [(k * 10 + i, "w " * (i + 1), f"s{k:04d}") for k in range(900) for i in range(10)]
    out = rows_of(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    got = defaultdict(list)
    for r in out:
        if r.target / r.source_size < 1:
            got[r.size].append(r.taken / r.size)
    assert all(abs(sum(v) / len(v) - 0.5) < 0.13 for size, v in got.items() if size > 1) and len(got) == 10


def test_null_and_repeated_ids_keep_what_was_drawn(spark):
    rows = [(None if i % 3 == 0 else 5 if i % 3 == 1 else i, f"w{i} " + "w " * (i % 7), "ab"[i % 2]) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    drawn, taken, words = Counter(), Counter(), Counter()
    for r in mixing.mix(df).collect():
        drawn[r.doc_id] += r.copies
        words[r.source] = r.target
    out = mixing.mixed(df).collect()
    assert Counter(r.doc_id for r in out) == +drawn and drawn[None] > 0
    for r in out:
        taken[r.source] += len(WORD.findall(r.text))
    assert all(abs(taken[s] - words[s]) <= 7 / 2 + 1 for s in words) and max(Counter(r.text for r in out).values()) <= 3


def test_odd_rows(spark, odd_docs, no_docs):
    out = rows_of(odd_docs)
    assert len(out) == odd_docs.count() and rows_of(no_docs) == []
    assert all(r.taken == 0 for r in out if r.size == 0)
    nothing = spark.createDataFrame([(1, None, "a"), (2, "", "b")], "doc_id long, text string, source string")
    assert [(r.target, r.taken) for r in rows_of(nothing)] == [(0.0, 0)] * 2
    mixed = mixing.mixed(odd_docs)
    assert mixed.columns == odd_docs.columns
    copies = Counter(r.doc_id for r in mixed.collect())
    for r in out:
        if r.doc_id not in (7, None):
            assert copies[r.doc_id] == r.copies
    assert mixing.mixed(no_docs).collect() == []


def test_sources_of_the_tables_meet_their_targets_within_a_hundredth(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    taken, target = Counter(), {}
    for r in rows_of(docs):
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert len(target) == 20 and all(abs(taken[s] - t) <= 0.01 * t for s, t in target.items())


def test_a_hot_group_of_rows_alike_is_split(spark):
    """Tens of thousands of rows without an id and of one size, all of one source, take seconds and meet the target."""
    df = spark.range(40_000).selectExpr("cast(null as long) doc_id", "'w w w' text", "if(id % 10 = 0, 'a', 'b') source")
    began = time.time()
    out = mixing.mix(df).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.count("*").alias("n"), F.max("copies").alias("most")).collect()
    assert time.time() - began < 60 and sum(r.n for r in out) == 40_000
    assert all(abs(r.taken - r.target) <= 3 and r.most <= 3 for r in out)


def test_giants_and_clashing_names(spark):
    rows = [(i, "w " * n, "a", 1, 2, 3, 4) for i, n in enumerate([4000, 3000, *[10] * 800])] + [(1000 + i, "w " * 60, "b", 1, 2, 3, 4) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, row int, copies int, row_ int, Copies_ int")
    taken, target = Counter(), {}
    for r in rows_of(df):
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - t) <= 60 for s, t in target.items())
    out = mixing.mixed(df)
    assert out.columns == df.columns and {tuple(r)[3:] for r in out.collect()} == {(1, 2, 3, 4)}


def test_plans_have_no_python(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plans = []
    write = mixing.save
    try:
        for module in (mixing, common):
            module.save = lambda d, name: (plans.append(d._jdf.queryExecution().executedPlan().toString()), write(d, name))[1]
        mixing.mixed(df)
        mixing.mix(df)
    finally:
        mixing.save = common.save = write
    assert len(plans) > 6 and not any(word in plan for plan in plans for word in ("Python", "Pandas", "Arrow"))
