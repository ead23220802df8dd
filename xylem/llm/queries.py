"""The queries of this subpackage: one for each operator, over its whole table, and DuckDB SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from xylem.llm import contamination, language, minhash, mixing, secrets, sharding, tokens, toxicity, urls, vectors


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(k: int) -> Column:
    """crc32 of the id as text, modulo k."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % k


def op1_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of each document; labels of the fold 1 are held out. Nulls and ties as in toxicity.fit and score; a null id is not held out."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(_fold(3) != 1))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", F.coalesce(_fold(3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def _captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages with a fetch date by their number; the tables hold none."""
    return _table(spark, sf_dir, "pages").select("page_id", "url", F.expr("date_add(date'2024-01-01', cast(pmod(page_id, 365) as int))").alias("fetched"))


def _list_entries(captures: DataFrame) -> DataFrame:
    """Three lists: fixed spam domains, hosts and host paths by a hash of the host; the tables hold none."""
    spark = captures.sparkSession
    fixed = spark.sql(
        """select * from values ('spam', 'cheap-pills.example.com', 'add', date'2024-02-01'), ('spam', 'adult-x.example.net', 'add', date'2024-01-15'),
        ('spam', 'adult-x.example.net', 'remove', date'2024-06-01'), ('spam', 'adult-x.example.net', 'add', date'2024-09-01'), ('spam', 'free-bets.example.com', 'add', date'2024-03-10')
        as t(list, key, action, listed)"""
    )
    hosts = captures.select(urls.host_of(F.col("url")).alias("host")).where("host is not null").distinct().withColumn("h", F.conv(F.substring(F.md5("host"), 1, 6), 16, 10).cast("int"))
    day = lambda n: F.expr(f"date_add(date'2024-01-01', {n})")
    entry = lambda of, key, action, when: F.struct(F.lit(of).alias("list"), key.alias("key"), F.lit(action).alias("action"), when.alias("listed"))
    host = F.col("host")
    made = F.array(
        F.when(F.expr("h % 4 = 0"), entry("hosts", host, "add", day("h % 200"))),
        F.when(F.expr("h % 8 = 0"), entry("hosts", host, "remove", day("h % 200 + 45"))),
        F.when(F.expr("h % 16 = 0"), entry("hosts", host, "add", day("h % 200 + 120"))),
        F.when(F.expr("h % 5 = 0"), entry("paths", F.concat(host, F.lit("/en")), "add", day("h % 100"))),
    )
    return fixed.unionByName(hosts.select(F.explode(made).alias("e")).where("e is not null").select("e.*"))


def op2_temporal_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged by the lists that hold on its day (see urls.judge for nulls, ties and empty tables)."""
    captures = _captures(spark, sf_dir)
    return urls.judge(captures, _list_entries(captures))


OP2_SQL = r"""
with captures as (
  select row_number() over () as rowid_, page_id, url, date '2024-01-01' + cast(page_id % 365 as int) as fetched,
         nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)), '') as host,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+/([^/?#]+)', 1) as segment from pages),
hosts as (select host, cast(('0x' || substr(md5(host), 1, 6)) as int) as h from (select distinct host from captures where host is not null)),
entries as (
  select * from (values ('spam', 'cheap-pills.example.com', 'add', date '2024-02-01'), ('spam', 'adult-x.example.net', 'add', date '2024-01-15'),
    ('spam', 'adult-x.example.net', 'remove', date '2024-06-01'), ('spam', 'adult-x.example.net', 'add', date '2024-09-01'), ('spam', 'free-bets.example.com', 'add', date '2024-03-10')) t(list, key, action, listed)
  union all select 'hosts', host, 'add', date '2024-01-01' + h % 200 from hosts where h % 4 = 0
  union all select 'hosts', host, 'remove', date '2024-01-01' + (h % 200 + 45) from hosts where h % 8 = 0
  union all select 'hosts', host, 'add', date '2024-01-01' + (h % 200 + 120) from hosts where h % 16 = 0
  union all select 'paths', host || '/en', 'add', date '2024-01-01' + h % 100 from hosts where h % 5 = 0),
valid as (
  select * from (select list, key, action, listed as valid_from, lead(listed) over (partition by list, key order by listed, action) as valid_to from (select distinct * from entries))
  where action = 'add' and (valid_to is null or valid_to > valid_from)),
keys as (
  select rowid_, array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.') as key
  from captures, unnest(generate_series(1, len(string_split(host, '.')))) g(i) where host is not null
  union all select rowid_, host || '/' || segment from captures where host is not null and segment <> ''),
met as (
  select c.rowid_, v.list, v.key, v.valid_from from captures c join keys k using (rowid_) join valid v on v.key = k.key and v.valid_from <= c.fetched and (v.valid_to is null or c.fetched < v.valid_to)),
best as (select *, row_number() over (partition by rowid_ order by length(key) desc, key desc, list desc, valid_from desc) as nth, count(*) over (partition by rowid_) as n from met)
select c.page_id, c.host, c.fetched, cast(b.n is not null as int) as blocked, coalesce(b.n, 0) as n_entries, b.list, b.key, b.valid_from
from captures c left join (select * from best where nth = 1) b using (rowid_)
"""


def op3_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a document holds, with its place and edits (see contamination.contaminated)."""
    return contamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' token ids, packed in matrices (see tokens.packed_tokens and MATRIX)."""
    return tokens.packed_tokens(_table(spark, sf_dir, "documents"))


def op5_token_efficiency_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, hash and spans of each document's secrets (see secrets.find_secrets); a null text is empty."""
    return secrets.digest(secrets.find_secrets(_table(spark, sf_dir, "documents")))


def op6_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of each document along the curve (see sharding.hilbert_shards)."""
    return sharding.hilbert_shards(_table(spark, sf_dir, "documents"))


def op7_pstable_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of each vector (see vectors.near_vectors)."""
    return vectors.near_vectors(_table(spark, sf_dir, "embeddings"))


def op8_word_first_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each document; texts of the fold 2 teach nothing. Nulls and ties as in language.identify; a null id is not held out."""
    docs = _table(spark, sf_dir, "documents")
    found = language.identify(docs, language.fit(docs.where(_fold(4) != 2)))
    return found.select("doc_id", F.coalesce(_fold(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op9_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size, component and whether it is kept of each document (see minhash.near_duplicates)."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, target and words taken of each document (see mixing.mix)."""
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


QUERIES = {
    f.__name__: f
    for f in (op1_compression_toxicity, op2_temporal_url_filter, op3_cgk_decontamination, op4_best_fit_packing, op5_token_efficiency_secrets, op6_hilbert_shards, op7_pstable_vectors, op8_word_first_language, op9_bbit_minhash, op10_pivotal_mix)
}
ORACLE_SQL = {"op2_temporal_url_filter": OP2_SQL}
