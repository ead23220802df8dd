import random

import numpy as np
import pytest

from xylem.llm import contamination as c

ITEM = "item_id long, text string"


def distance(a, b):
    """Least edits between a and any stretch of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def edited(rng, words, k):
    out = list(words)
    for _ in range(k):
        i = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[i] = f"z{rng.randrange(999)}"
        elif kind == 1:
            del out[i]
        else:
            out.insert(i, f"y{rng.randrange(999)}")
    return out


def fixture(rng, edits):
    items = [[f"w{rng.randrange(400)}" for _ in range(rng.randrange(15, 58))] for _ in range(20)]
    docs, planted = [], set()
    for d in range(120):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(0, 300))]
        if d % 2:
            k = rng.randrange(len(items))
            at = rng.randrange(len(words) + 1)
            words[at:at] = edited(rng, items[k], int(edits * len(items[k])))
            planted.add((d, k))
        docs.append((d, " ".join(words).capitalize()))
    return items, docs, planted


def run(spark, docs, items):
    return c.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w).upper()) for i, w in enumerate(items)], ITEM)).collect()


def test_exact_and_edited_passages(spark):
    rng = random.Random(6)
    for edits, least in ((0, 1.0), (0.05, 0.98), (0.1, 0.95)):
        items, docs, planted = fixture(rng, edits)
        words = {d: t.lower().split() for d, t in docs}
        want = {(d, i): k for d in words for i, w in enumerate(items) if (k := distance(w, words[d])) <= c.MOST_EDITS * len(w)}
        assert planted <= set(want)
        got = {(r.doc_id, r.item_id): r for r in run(spark, docs, items)}
        assert set(got) <= set(want)
        assert len(got) >= least * len(want)
        for key, r in got.items():
            assert r.distance >= want[key] and r.n_words == len(items[key[1]])
            assert distance(items[key[1]], words[key[0]][r.start_word : r.end_word]) <= r.distance
            if edits == 0:
                assert words[key[0]][r.start_word : r.end_word] == items[key[1]]


def test_passes_give_the_same(spark, monkeypatch):
    items, docs, _ = fixture(random.Random(8), 0.05)
    rows = lambda: sorted(tuple(r) for r in run(spark, docs, items))
    whole = rows()
    monkeypatch.setattr(c, "PASS_WORDS", 200)
    assert rows() == whole


def test_edit_distance():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(1, 12))] for _ in range(2))
        assert c.edit_distance(np.array(a, np.uint64), np.array(b, np.uint64))[0] == distance(a, b)


def test_short_items_and_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "naïve"), (4, "w1 w2"), (None, "id at all here my"), (5, "same text for two of us now")], ITEM)
    got = {(r.doc_id, r.item_id) for r in c.contaminated(odd_docs, items).collect()}
    assert {(10, 3), (None, None), (5, 5), (6, 5), (7, 5)} <= got and not {1, 2, 3, 12} & {d for d, _ in got}
    assert c.contaminated(no_docs, items).collect() == [] and c.contaminated(odd_docs, items.limit(0)).collect() == []
    kept = c.decontaminated(odd_docs, items)
    assert kept.columns == odd_docs.columns and {r.doc_id for r in kept.collect()} == {1, 2, 3, 11, 12} | {8, 9} - {d for d, _ in got}


@pytest.mark.parametrize("n", [1, 4, 15, 24, 31, 48, 49, 63, 97, 127, 200, 255, 400, 511, 512])
def test_recall_at_all_lengths_up_to_the_threshold(n):
    """Passages with 0 to 20 % of their words edited at random, amid other words: at least 0.9 are found at each length and share."""
    rng = random.Random(n)
    items = [np.array([rng.randrange(1, 5000) for _ in range(n)], np.uint64) * np.uint64(0x9E3779B97F4A7C15) for _ in range(30)]
    table = c.index(list(enumerate(items)))
    filters = {size: np.unpackbits(run[3]).astype(bool) for size, run in table["runs"].items()}
    for share in (0, 0.05, 0.1, 0.15, 0.2):
        texts = []
        for item in items:
            words = [rng.randrange(1, 5000) * 0x9E3779B97F4A7C15 % 2**64 for _ in range(2 * n + 20)]
            place = item.tolist()
            for _ in range(int(share * n)):
                i, kind = rng.randrange(len(place)), rng.randrange(3)
                place[i : i + (kind != 1)] = [] if kind == 2 else [rng.randrange(1 << 62)]
            at = rng.randrange(len(words))
            texts.append(np.array([int(w) for w in words[:at]] + place + [int(w) for w in words[at:]], np.uint64))
        before = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        found = {(r, i) for r, i, *_ in c._found(np.concatenate(texts), before, table, filters)}
        assert sum((k, k) in found for k in range(30)) >= 27, share
        every = np.arange(before[-1])
        if n <= 63:  # where windows begin leaves out nothing that windows at every word find
            kept = {tuple(x[:2]) for x in c._candidates(np.concatenate(texts), before, every, table).tolist()} & {(k, k) for k in range(30)}
            assert {(k, k) for k in range(30) if (k, k) in found} <= kept


@pytest.mark.parametrize("n", [1, 5, 15, 20, 63, 511])
def test_some_run_of_words_is_untouched(n):
    rng = random.Random(n)
    size = c.untouched(n)
    for _ in range(300):
        words = [f"w{i}" for i in range(n)]
        out = edited(rng, words, c.most_edits(n))
        runs = {tuple(words[i : i + size]) for i in range(n - size + 1)}
        assert any(tuple(out[i : i + size]) in runs for i in range(len(out) - size + 1))


def test_equal_items_are_found_each_and_shared_passages_too(spark):
    item = " ".join(f"w{i}" for i in range(30))
    items = spark.createDataFrame([(k, item if k < 50 else item + f" x{k}") for k in range(60)], ITEM)
    got = c.contaminated(spark.createDataFrame([(1, "a b " + item + " c d")], "doc_id long, text string"), items).collect()
    assert sorted(r.item_id for r in got) == list(range(60)) and {r.distance for r in got} == {0, 1}
