"""The registered query of every operator in this subpackage, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    return quality(spark, _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


#: Target shares of the domains that op2 and the pipeline mix to.
LANGUAGE_TARGETS = {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}


def labelled_languages(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The labelled table of the mix: languages of the documents that have labels."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").alias("domain")).join(known, "doc_id", "left_semi")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    docs = _read(spark, sf_dir, "documents")
    labelled = labelled_languages(docs, _read(spark, sf_dir, "labels"))
    return mix(spark, docs, labelled, LANGUAGE_TARGETS)


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    return top_k(spark, _read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_dedup

    return near_dedup(spark, _read(spark, sf_dir, "documents"))


def op5_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import materialise
    from .scratch import Scratch

    shards = Scratch(spark, "token-shards").path("shards")
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return materialise(spark, _read(spark, sf_dir, "documents"), vocabulary, shards, end=50256)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    return shard(spark, _read(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import token_counts

    return token_counts(spark, _read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(spark, _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op9_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .segmentation import segment

    out = segment(spark, _read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", "n_pieces", "scores", "ids_crc32", "decodes", "exact")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(spark, _read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality": op1_quality,
    "op2_mixing": op2_mixing,
    "op3_exact_top_k": op3_exact_top_k,
    "op4_near_dedup": op4_near_dedup,
    "op5_token_binary": op5_token_binary,
    "op6_sharding": op6_sharding,
    "op7_token_counts": op7_token_counts,
    "op8_toxicity": op8_toxicity,
    "op9_segmentation": op9_segmentation,
    "op10_exact_dedup": op10_exact_dedup,
}

ORACLES = {
    "op3_exact_top_k": """
        WITH x AS (
            SELECT vec_id, unnest(embedding)::DOUBLE AS e, generate_subscripts(embedding, 1) AS i
            FROM embeddings
        ), bad AS (
            SELECT DISTINCT vec_id FROM x WHERE e IS NULL OR NOT isfinite(e)
        ), v AS (
            SELECT vec_id, i, CAST(floor(e * 1024) AS BIGINT) AS e FROM x
            WHERE vec_id NOT IN (SELECT vec_id FROM bad)
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(sum(q.e * c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON q.i = c.i AND q.vec_id <> c.vec_id
            WHERE q.vec_id % 100 = 0 GROUP BY 1, 2
        ), r AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
                   vec_id, score
            FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
    """,
    "op4_near_dedup": r"""
        WITH RECURSIVE t AS (
            SELECT doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ), l AS (
            SELECT doc_id, CASE WHEN len(w) >= 3
                    THEN list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)])
                WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
            FROM t
        ), u AS (SELECT doc_id, len(s) AS n, unnest(s) AS s FROM l),
        pairs AS (
            SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.s = b.s AND a.doc_id < b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
        ), links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
        reach AS (SELECT doc_id, doc_id AS other FROM l UNION SELECT r.doc_id, k.b FROM reach r JOIN links k ON r.other = k.a),
        c AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
        SELECT doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept FROM l JOIN c USING (doc_id)
    """,
    "op10_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(text) AS text_sha256
        FROM d WINDOW g AS (PARTITION BY text)
    """,
}
