"""Queries of this subpackage by name, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ._store import documents


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .secret_scan import redacted, scan

    found = scan(documents(spark, sf_dir).select("doc_id", "text", "source"))
    secrets = F.array_join(F.array_sort(F.array_distinct(F.transform("findings", lambda c: c["secret"]))), " ")
    return found.select("doc_id", "n_candidates", F.size("findings").alias("n_secrets"), secrets.alias("secrets"), F.sha2(F.coalesce(redacted(), F.lit("")), 256).alias("redacted_sha256"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .substring_dedup import repeats

    return repeats(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .sentencepiece_codec import decode, encode

    path = tokenizer_file("piece_bpe_32k.model")
    back = decode(encode(documents(spark, sf_dir), path), path)
    return back.select("doc_id", "n_ids", "ids_crc32", F.sha2("text", 256).alias("decoded_sha256"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_classifier import classify, train

    docs = documents(spark, sf_dir)
    return classify(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .suffix_dedup import suffix_dedup

    return suffix_dedup(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_scoring import score_corpus

    return score_corpus(documents(spark, sf_dir))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import near_duplicates

    return near_duplicates(documents(spark, sf_dir))


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk_search import topk

    return topk(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    return quality_rules(documents(spark, sf_dir))


def queries() -> dict:
    return {f.__name__: f for f in (op1_packing, op2_secret_scan, op3_substring_dedup, op4_sentencepiece, op5_quality_classifier, op6_suffix_dedup, op7_lm_scoring, op8_jaccard_join, op9_topk_search, op10_quality_rules)}


ORACLE = {
    "op9_topk_search": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
            FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
        ), r AS (
            SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
