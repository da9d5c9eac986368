"""The registered queries of the corpus operators, over whole tables."""

from __future__ import annotations

from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession, functions as F

from netspark.llm import byte_bpe, chunkprint, impactsearch, langid, packing, quality, sharding, simhash, toxicity, urlfilter

RULES = {
    "com/": "allow",
    "example.com/en/": "block",
    "www.example.com/en/": "allow",
    "net/es/": "block",
    "net/fr/": "block",
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle_words=4, bits=4)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    ratings = labels.select("doc_id", quality.rating(F.col("quality"), F.col("toxic")).alias("grade"))
    return quality.grade_documents(docs, quality.learn(docs, ratings))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunkprint.print_edits(_table(spark, sf_dir, "documents"))


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(_table(spark, sf_dir, "pages"), RULES)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.learn(docs, _table(spark, sf_dir, "labels")))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_size(_table(spark, sf_dir, "documents"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impactsearch.top_k(_table(spark, sf_dir, "embeddings"), k=5, query_every=50)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.learn(docs))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_digests(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_packing, op3_quality, op4_fingerprints, op5_urls, op6_toxicity, op7_sharding, op8_topk, op9_language, op10_bpe)}

ORACLE_SQL = {
    "op8_topk": """
        WITH scaled AS (
            SELECT vec_id, row_number() OVER () AS own, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
        ),
        scored AS (
            SELECT q.own, q.vec_id AS query_id, c.vec_id AS vec_id,
                   CAST(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
            FROM scaled q JOIN scaled c ON c.own <> q.own AND len(c.v) = len(q.v)
            WHERE q.vec_id % 50 = 0
        ),
        ranked AS (
            SELECT *, row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id) AS rank FROM scored
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
    """,
}
