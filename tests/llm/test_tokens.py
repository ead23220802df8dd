import random
from collections import defaultdict

import pytest

from xylem.llm import tokens


@pytest.fixture(scope="module")
def plain():
    return tokens.encoding()


TEXTS = ["", " ", "  ", "a", " a", "a ", "a b", "a  b", "a   b", "a \nb", "a\n b", "a\n \nb", "a\n ", "\n", "it's 'twas  I'd", "x  y", "a\t b \t c", "é ü ß 你好 世界", "1 22 333 !!  ??", "a\x1c b \x85 c"]


def check_encoding(encoder, plain, texts):
    import pyarrow as pa

    ids, begin = encoder.encode(pa.array(texts, pa.string()))
    assert len(begin) == len(texts) + 1
    for text, a, b in zip(texts, begin, begin[1:]):
        assert ids[a:b].tolist() == plain.encode_ordinary(text or "") + [tokens.END_ID], repr(text)


def test_segments_encode_as_whole_texts(plain):
    rng = random.Random(4)
    encoder = tokens.Encoder()
    alphabet = ["a", "the", " ", " ", "\n", "\t", "é", "9", "'s", ".", "\u00a0", "\u3000", "\u2003", "\u0085", "\u1680", "“", "\x1c", "\r", "你", "Zq", "🙂"]
    check_encoding(encoder, plain, TEXTS + [None] + ["".join(rng.choices(alphabet, k=rng.randrange(40))) for _ in range(6000)])
    check_encoding(encoder, plain, [])
    check_encoding(encoder, plain, ["", None])
    check_encoding(encoder, plain, ["x" * 5000 + " " * 300 + "\n" * 300 + "y" * 5000])


def test_long_texts_are_cut_without_changing_their_ids(plain, monkeypatch):
    rng, encoder = random.Random(1), tokens.Encoder()
    alphabet = ["a", "the", " ", " ", "\n", "\t", "é", "9", "'s", ".", "\u00a0", "\u3000", "\r", "你", "Zq"]
    for most in (1, 5, 30):
        monkeypatch.setattr(tokens, "CHUNK_BYTES", most)
        check_encoding(encoder, plain, TEXTS + ["".join(rng.choices(alphabet, k=rng.randrange(60))) for _ in range(2000)])
    text = "ab c" * 50
    assert "".join(tokens.pieces(text)) == text and max(map(len, tokens.pieces(text))) <= 30


def brute_pack(lengths, capacity):
    rows = []
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        room = [(capacity - sum(lengths[i] for i in r), r) for r in rows]
        fit = [x for x in room if x[0] >= lengths[k]]
        if fit:
            min(fit, key=lambda x: x[0])[1].append(k)
        else:
            rows.append([k])
    return rows


@pytest.mark.parametrize("seed", range(20))
def test_packing_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 7, 16, 100])
    lengths = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(0, 80))]
    got = tokens.pack(lengths, capacity)
    assert sorted(k for r in got for k in r) == list(range(len(lengths)))
    fill = lambda rows: sorted(sorted(lengths[k] for k in r) for r in rows)
    assert len(got) == len(brute_pack(lengths, capacity))
    assert sorted(map(sum, fill(got))) == sorted(map(sum, fill(brute_pack(lengths, capacity))))


def check_round_trip(rows, want, plain, row_tokens):
    got = defaultdict(list)
    for r in rows:
        assert len(r["ids"]) == len(r["positions"]) == 2 * r["n_rows"] * row_tokens
        assert sum(r["n_segments"]) == len(r["doc_ids"]) == len(r["doc_starts"]) and len(r["cu_seqlens"]) == len(r["doc_ids"]) + r["n_rows"]
        assert sum(len(ids) for *_, ids in tokens.unpack(r)) == r["n_tokens"]
        import numpy as np

        places, cut = np.frombuffer(r["positions"], "<u2").reshape(r["n_rows"], -1), 0
        for i, n in enumerate(r["n_segments"]):
            ends = r["cu_seqlens"][cut : cut + n + 1]
            cut += n + 1
            assert ends[0] == 0 and all(places[i, a:b].tolist() == list(range(b - a)) for a, b in zip(ends, ends[1:]))
        for doc, at, ids in tokens.unpack(r):
            got[doc].append((at, ids))
    whole = {d: sum((ids for _, ids in sorted(p)), []) for d, p in got.items()}
    assert whole == {d: plain.encode_ordinary(t or "") + [tokens.END_ID] for d, t in want.items()}


def test_round_trip(spark, plain):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices(["the", "ab", "zyx", "é", "\n", ""], k=int(rng.paretovariate(0.7)) % 3000))) for i in range(300)]
    packed = tokens.packed_tokens(spark.createDataFrame(rows, "doc_id long, text string"), row_tokens=64, group_tokens=2000, matrix_rows=5)
    out = packed.collect()
    check_round_trip(out, dict(rows), plain, 64)
    assert len({r.pack_group for r in out}) > 3
    fill = sum(r.n_tokens for r in out) / sum(r.n_rows * 64 for r in out)
    assert fill > 0.95


def test_odd_rows(spark, odd_docs, no_docs, plain, tmp_path):
    assert tokens.packed_tokens(no_docs).collect() == []
    out = tokens.packed_tokens(odd_docs)
    tokens.write_matrices(out, str(tmp_path / "packed"))
    read = spark.read.parquet(str(tmp_path / "packed")).collect()
    once = {r.doc_id: r.text for r in odd_docs.collect() if r.doc_id != 7}
    docs = [d for r in read for d, at, _ in tokens.unpack(r) if at == 0]
    assert docs.count(7) == 2 and len(docs) == 13
    check_round_trip(tokens.packed_tokens(odd_docs.where("doc_id is null or doc_id <> 7")).collect(), once, plain, tokens.ROW_TOKENS)


def test_a_hot_row_and_a_long_text_are_spread(spark):
    row = spark.range(3000).selectExpr("cast(null as long) doc_id", "repeat('one two three ', 5) text")
    sizes = [r["n"] for r in tokens.packed_tokens(row, row_tokens=64, group_tokens=2000).groupBy("pack_group").agg({"n_tokens": "sum"}).withColumnRenamed("sum(n_tokens)", "n").collect()]
    assert len(sizes) > 10 and max(sizes) < 3 * sum(sizes) / len(sizes)
    long = spark.createDataFrame([(1, "alpha beta gamma " * 30_000)], "doc_id long, text string")
    sizes = [r["n"] for r in tokens.packed_tokens(long, row_tokens=64, group_tokens=2000).groupBy("pack_group").agg({"n_tokens": "sum"}).withColumnRenamed("sum(n_tokens)", "n").collect()]
    assert len(sizes) > 10 and max(sizes) < 3 * sum(sizes) / len(sizes)
