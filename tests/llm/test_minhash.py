import random
import re

import numpy as np
import pyarrow as pa
import pytest

from xylem.llm import minhash
from xylem.llm.common import Powers, connected_components, group_starts, small_pairs, whole_groups

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def shingles(text):
    w = WORD.findall((text or "").translate(UPPER))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    """Components of (id, text) by comparing everything with everything."""
    sets = {}
    for d, t in rows:
        if d is not None:
            sets.setdefault(d, []).append(shingles(t))
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            for s in sets[a]:
                for t in sets[b]:
                    both = len(s & t)
                    if both and 100 * both >= 75 * (len(s) + len(t) - both):
                        x, y = root(a), root(b)
                        up[max(x, y)] = min(x, y)
    return {d: root(d) for d in ids}


def edited(rng, words, k):
    out = list(words)
    for _ in range(k):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


def found(df):
    return {r.doc_id: r for r in df.collect()}


def test_families_match_brute_force(spark):
    rng = random.Random(1)
    rows, n = [], 0
    for _ in range(12):
        base = [f"v{rng.randrange(300)}" for _ in range(rng.randrange(30, 200))]
        for _ in range(rng.randrange(1, 25)):
            rows.append((n := n + 1, edited(rng, base, rng.randrange(0, 1 + len(base) // 20))))
    rows += [(n + 1, "A b c"), (n + 2, "a B c"), (n + 3, "a b"), (n + 4, "a b"), (n + 5, "ÀB c"), (n + 6, "àb c")]
    rng.shuffle(rows)
    got = found(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    want = brute(rows)
    assert {d: r.component_id for d, r in got.items()} == want
    assert all(r.n_shingles == len(shingles(dict(rows)[d])) and r.kept == (d == want[d]) for d, r in got.items())


@pytest.mark.parametrize("small", [0, 48])
def test_large_group_in_small_blocks(spark, monkeypatch, small):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    monkeypatch.setattr(minhash, "SMALL", small)
    rng = random.Random(2)
    base = [f"v{i}" for i in range(120)]
    rows = [(i, edited(rng, base, rng.randrange(2, 12))) for i in range(150)]
    got = found(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {d: r.component_id for d, r in got.items()} == brute(rows)


def test_odd_rows(spark, odd_docs, no_docs):
    out = minhash.near_duplicates(odd_docs).collect()
    assert len(out) == odd_docs.count()
    by = {r.doc_id: r for r in out}
    assert by[1].n_shingles == by[2].n_shingles == by[3].n_shingles == 0 and by[1].component_id == 1 and by[2].kept
    assert {by[k].component_id for k in (5, 6, 7)} == {5} and by[9].component_id == 8
    assert by[None].component_id is None and by[None].kept
    assert minhash.near_duplicates(no_docs).collect() == []
    kept = minhash.deduplicate(odd_docs)
    assert kept.columns == odd_docs.columns
    assert {r.doc_id for r in kept.collect()} == {1, 2, 3, None, 5, 8, 10, 11, 12}


def test_low_bits_estimate_similarity():
    rng = np.random.default_rng(1)
    for shared in (100, 500, 900):
        common, a, b = (rng.integers(0, 2**64, k, dtype=np.uint64) for k in (shared, 1000 - shared, 1000 - shared))
        sig = [minhash.packed(minhash.minima(np.concatenate([common, x]))) for x in (a, b)]
        true = shared / (2000 - shared)
        assert abs(minhash.estimates(*sig) - true) < 0.15


def test_sets_do_not_hang_on_batches():
    texts = ["one two three four five six", None, "x " * 50, "a", "é b c d e f g"]
    whole = [x.tolist() for x in minhash.text_sets(pa.array(texts, pa.string()), Powers())]
    alone = [next(minhash.text_sets(pa.array([t], pa.string()), Powers())).tolist() for t in texts]
    sliced = [x.tolist() for x in minhash.text_sets(pa.array(["junk", *texts], pa.string())[1:], Powers())]
    assert whole == alone == sliced


@pytest.mark.parametrize("links", [[], [(1, 2)], [(i, i + 1) for i in range(40)], [(9, 3), (3, 9), (9, 9), (4, 3), (7, 8)], [(i, 0) for i in range(1, 30)] + [(100, 29), (101, 100)]])
def test_components(spark, links):
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {x for e in links for x in e if e[0] != e[1]}
    up = {x: x for x in nodes}
    for _ in nodes:
        for a, b in links:
            if a != b:
                up[a] = up[b] = min(up[a], up[b])
    assert got == up


def test_groups_are_whole_and_pairs_complete():
    rng = random.Random(3)
    key = sorted(rng.randrange(40) for _ in range(300))
    cross = [k % 2 == 0 for k in key]
    side = [rng.randrange(2) if c else 0 for c in cross]
    rows = sorted(zip(key, side, range(300)))
    batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows]) for k in range(3)], ["key", "side", "id"])
    cuts = sorted({0, 300, *(rng.randrange(300) for _ in range(25))})
    parts = [batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:])] + [batch.slice(0, 0)]
    seen, pairs = set(), []
    for got in whole_groups(iter(parts), ("key",)):
        k, s, ids = (got.column(c).to_numpy() for c in ("key", "side", "id"))
        assert seen.isdisjoint(k.tolist())
        seen |= set(k.tolist())
        starts, ends = group_starts(k)
        for i, j, g in small_pairs(starts, ends, s, k % 2 == 0, 7):
            assert (k[i] == k[j]).all() and (starts[g] <= i).all() and (i < ends[g]).all()
            pairs += [frozenset((x, y)) for x, y in zip(ids[i].tolist(), ids[j].tolist())]
    want = {frozenset((a, b)) for ka, sa, a in rows for kb, sb, b in rows if ka == kb and a < b and (ka % 2 or sa != sb)}
    assert len(pairs) == len(set(pairs)) and set(pairs) == want
