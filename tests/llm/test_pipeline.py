"""The stages one by one against plain Python, on whole tables, and run() against the stages."""

import random
import string
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from test_contamination import distance
from test_minhash import brute
from test_mixing import WORD, brute_targets
from xylem.llm import contamination, language, minhash, tokens
from xylem.llm.common import save, shared_dir

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage was given and what it returned."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = save(stage(spark, docs, SF), "stage")
        out.append((name, docs, after))
        docs = after
    return out


def pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_order_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "MinHash near-dedup", "benchmark decontamination", "mixing sources to target weights", "token-ID / binary output"]
    assert all(after.columns == COLUMNS for *_, after in stages[:4])


def test_language_keeps_clean_documents(stages):
    _, before, after = stages[0]
    kept = {r.doc_id for r in after.collect()}
    lost = [t for d, t in pairs(before) if d not in kept]
    assert len(kept) >= 0.97 * before.count()
    assert {d for d, t in pairs(before) if not any(map(str.isalpha, t or ""))}.isdisjoint(kept) and all(len(t or "") < 100 for t in lost)


@pytest.mark.parametrize("taught", [("de", "es", "fr"), ("en", "es", "fr"), ("en",)])
def test_untaught_languages_and_junk_are_rejected(spark, taught):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) >= 100")
    rng = random.Random(5)
    junk = [(10**6 + i, " ".join("".join(rng.choices(string.ascii_lowercase, k=rng.randint(2, 10))) for _ in range(60))) for i in range(50)]
    noise = spark.createDataFrame(junk, "doc_id long, text string").selectExpr("doc_id", "text", "cast(null as string) lang", "'x' source", "cast(length(text) as long) n_chars")
    given = docs.withColumn("lang", F.when(F.col("lang").isin(*taught), F.col("lang"))).unionByName(noise.select(*docs.columns))
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, given, "").select("doc_id").collect()}
    rows = docs.select("doc_id", "lang").collect()
    own, other = ({r.doc_id for r in rows if (r.lang in taught) == x} for x in (True, False))
    assert len(own & kept) >= 0.97 * len(own) and len(other & kept) <= 0.05 * len(other) and max(kept) < 10**6


def test_near_duplicates_leave_one_of_each_group(stages):
    _, before, after = stages[1]
    root = brute(pairs(before))
    assert sorted(r.doc_id for r in after.collect()) == sorted({d for d in root if root[d] == d})


def test_no_benchmark_item_is_left(spark, stages):
    _, before, after = stages[2]
    items = [(r.text or "").lower().split() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {d for d, t in pairs(before) for i in items if i and distance(i, (t or "").lower().split()) <= int(contamination.MOST_EDITS * len(i))}
    assert bad and {d for d, _ in pairs(after)} == {d for d, _ in pairs(before)} - bad


def test_rows_are_met_alike_at_every_size(spark):
    """What grows with the documents is not broadcast where it happens to be small."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for stage in (corpus_pipeline.near_dedup, corpus_pipeline.mix_sources):
        plan = stage(spark, docs, SF)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_sources_are_mixed(stages):
    _, before, after = stages[3]
    rows, copies = before.collect(), Counter(r.doc_id for r in after.collect())
    size = {r.doc_id: len(WORD.findall(r.text or "")) for r in rows}
    total, taken, most = Counter(), Counter(), Counter()
    for r in rows:
        total[r.source] += size[r.doc_id]
        taken[r.source] += size[r.doc_id] * copies[r.doc_id]
        most[r.source] = max(most[r.source], size[r.doc_id])
    assert all(abs(taken[s] - t) <= most[s] / 2 + 1 for s, t in brute_targets(total).items()) and max(copies.values()) <= 3


def test_tokens_come_back(stages):
    _, before, packed = stages[4]
    plain, want = tokens.encoding(), Counter()
    for d, t in pairs(before):
        ids = plain.encode_ordinary(t or "") + [tokens.END_ID]
        want[d, len(ids), sum(ids)] += 1
    got, pieces = Counter(), {}
    for r in packed.collect():
        for doc, at, ids in tokens.unpack(r):
            pieces.setdefault(doc, []).append((at, len(ids), sum(ids)))
    for doc, parts in pieces.items():
        copies = sum(at == 0 for at, *_ in parts)
        got[doc, sum(n for _, n, _ in parts) // copies, sum(s for *_, s in parts) // copies] += copies
    assert got == want


def test_run_applies_the_stages(spark, stages):
    """The same pieces, however they are dealt to rows; and of all tables of a run only its result is left."""
    def contents(packed):
        return Counter((doc, at, tuple(ids)) for r in packed.collect() for doc, at, ids in tokens.unpack(r))

    root = Path(shared_dir(spark).removeprefix("file://")) / "xylem"
    before = set(root.iterdir())
    out = corpus_pipeline.run(spark, SF)
    assert [p.name for p in set(root.iterdir()) - before] == [Path(out.saved_path).name]
    assert contents(out) == contents(stages[4][2])


def test_stages_take_odd_and_empty_tables(spark, odd_docs, no_docs):
    for docs in (odd_docs.select(*COLUMNS), no_docs):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = save(stage(spark, docs, SF), "stage")
            assert k == 4 or docs.columns == COLUMNS


def test_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {f"op{n}_" for n in range(1, 11)} == {x.split("_")[0] + "_" for x in names if x.startswith("op")} and "pipeline" in names
    assert corpus_pipeline.ORACLE_SQL is None and language.UNKNOWN == "und" and minhash.SHINGLE == 5
