"""From raw documents to packed token ids: the stages, in order, over a folder of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from xylem.llm import contamination, language, minhash, mixing, tokens
from xylem.llm.common import discard, save, temporary

#: A text whose likeliest language has a smaller share than this is rejected, as is one without letters.
LEAST_SHARE = 0.3
#: So is one with a smaller share of its letters in known words than this part of what the language leads to expect.
#: With one to three languages taught, 99.5 % of their unseen texts stand above 0.5 and 95 % of the others' below 0.38 (sf0.01, sf0.1).
LEAST_KNOWN = 0.43


def small_batches(spark: SparkSession) -> None:
    """Holds what goes to and from Python at once to 4 MB a task, since texts may be long and several tasks share an executor."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach."""
    small_batches(spark)
    return language.in_known_language(docs, language.fit(docs), LEAST_SHARE, LEAST_KNOWN)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates."""
    small_batches(spark)
    return minhash.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    small_batches(spark)
    return contamination.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's weight takes it."""
    small_batches(spark)
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, packed."""
    small_batches(spark)
    return tokens.packed_tokens(docs)


STAGES = [("language ID", language_id), ("MinHash near-dedup", near_dedup), ("benchmark decontamination", decontamination), ("mixing sources to target weights", mix_sources), ("token-ID / binary output", pack)]

#: No stage but the mix could be said in SQL, so the whole is tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to documents, each one's result written and read again. A stage's tables are deleted when the next has read them; only the last one's result stays.

    Stages take null, empty and very long texts, null and repeated ids, ties, repeated rows and empty tables as their
    operators state; all but the last return the columns they were given, and extra ones, whatever their names.
    """
    docs, held = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with temporary() as made:
            docs = save(stage(spark, docs, sf_dir), name.replace(" ", "_").replace("/", "_").lower())
            made.remove(docs)
        if held is not None:
            discard(held)
        held = docs
    return docs
