import itertools
import math
import zlib
from collections import defaultdict

import numpy as np
import pytest

from xylem.llm import sharding


@pytest.mark.parametrize(("dims", "bits"), [(2, 3), (3, 2), (4, 2), (2, 1), (1, 4)])
def test_curve_visits_each_cell_by_steps_of_one(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    index = sharding.hilbert_index(cells, bits)
    assert sorted(index) == list(range(len(cells)))
    path = cells[np.argsort(index)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def check(rows, source, shards=16):
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in rows) == sorted((str(d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in source)
    slots = defaultdict(list)
    for r in rows:
        assert r.law == "rows" and r.grown_shard is None and 0 <= r.shard < shards
        slots[r.shard].append(r)
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in slots.values())
    counts = [len(slots[s]) for s in range(shards)]
    assert not rows or max(counts) - min(counts) <= 1
    order = [r for s in range(shards) for r in sorted(slots[s], key=lambda r: r.slot)]
    assert all(a.curve <= b.curve for a, b in zip(order, order[1:]))


def test_shards(spark, odd_docs, no_docs):
    check(sharding.hilbert_shards(odd_docs).collect(), [(r.doc_id, r.text) for r in odd_docs.collect()])
    assert sharding.hilbert_shards(no_docs).collect() == []
    docs = spark.range(1003).selectExpr("id as doc_id", "repeat('a ', cast(id % 97 as int)) as text", "case when id % 3 = 0 then 'en' else 'fr' end as lang", "concat('s', id % 7) as source")
    rows = sharding.hilbert_shards(docs.repartition(5)).collect()
    check(rows, [(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(map(tuple, rows)) == sorted(map(tuple, sharding.hilbert_shards(docs).collect()))


def test_files_prune(spark, tmp_path):
    docs = spark.range(2000).selectExpr("id as doc_id", "repeat('a', cast(id * 37 % 501 as int)) as text", "concat('l', id * 11 % 8) as lang", "concat('s', id * 7 % 8) as source")
    sharding.write_shards(docs, str(tmp_path / "out"))
    read = spark.read.parquet(str(tmp_path / "out"))
    assert read.count() == 2000
    spans = read.groupBy("shard").agg({"lang": "count"}).count()
    touched = read.where("lang = 'l1' and source = 's1'").select("shard").distinct().count()
    assert spans == 16 and touched <= 8


def test_places_against_brute_force(spark):
    """Cells from the raw metadata, by loops: string cuts by runs of equal weight, numbers by their quantiles; sources alike in their first letters are parted."""
    rng = np.random.default_rng(4)
    rows = [(i, "é" * int(rng.integers(0, 400)) if i % 50 else None, [None, "en", "de", "fr"][int(rng.integers(4))], f"https://host.example/{int(rng.integers(60)):03d}") for i in range(1500)]
    out = sharding.hilbert_shards(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    n, cells = len(rows), []
    for k in (2, 3):
        known = sorted(r[k] for r in rows if r[k] is not None)
        first = {}
        for at, v in enumerate(known):
            if at == 0 or known[at - 1] != v:
                first.setdefault(at * 31 // len(known), v)
        cells.append([sum(c <= r[k] for c in first.values()) if r[k] is not None else 0 for r in rows])
    assert len(set(cells[1])) > 25
    logs = [math.log2(len((r[1] or "").encode()) + 1) for r in rows]
    cuts = {sorted(logs)[max(0, math.ceil(k / 32 * n) - 1)] for k in range(1, 32)}
    cells.append([sum(c < x for c in cuts) for x in logs])
    want = sharding.hilbert_index(np.array(cells).T, sharding.BITS)
    assert [r.curve for r in sorted(out, key=lambda r: r.doc_id)] == want.tolist()
    check(out, [(r[0], r[1]) for r in rows])


def test_rows_are_written_as_they_are(spark, odd_docs, tmp_path):
    docs = odd_docs.selectExpr("*", "7 as shard", "8 as slot", "9 as Shard_")
    name = sharding.write_shards(docs, str(tmp_path / "out"))
    read = spark.read.parquet(str(tmp_path / "out"))
    assert name == "shard__" and read.columns == [*docs.columns, name]
    assert sorted(map(str, read.drop(name).collect())) == sorted(map(str, docs.collect()))
