"""A training-data pipeline over ``documents``: five stages, each reading what the last one wrote.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.exact_dedup import keep_one
from lattica.llm.mixing import resample
from lattica.llm.near_dedup import near_dedup
from lattica.llm.quality import keep_good
from lattica.llm.queries import LANGUAGE_TARGETS, labelled_languages
from lattica.llm.scratch import Scratch
from lattica.llm.segmentation import segment


def _quoted(name: str) -> str:
    """A column's name as Spark reads it whole, dots and backticks included."""
    return "`" + name.replace("`", "``") + "`"


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; the others are unchanged."""
    return keep_good(spark, docs, _labels(spark, sf_dir))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    return keep_one(spark, docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicate documents (five-word shingles, similarity 0.8 or more) the smallest id stays."""
    gone = near_dedup(spark, docs, width=5, percent=80).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[docs[_quoted(name)] for name in docs.columns])


def mix_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated at rates that bring the languages' tokens to the target shares.

    The token total is the least at which no language shrinks, so every document
    stays and those of scarce languages are repeated.
    """
    labelled = labelled_languages(docs, _labels(spark, sf_dir))
    return resample(spark, docs, labelled, LANGUAGE_TARGETS, total="grow")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of the n best segmentations of every text, with scores and whether they decode to its bytes."""
    import public_tokenizers

    return segment(spark, docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality classifier", drop_low_quality),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_languages),
    ("sentencepiece", encode),
]

#: The classifier, the mix and the segmentation have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written as Parquet and read again by the next."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.table(name.replace(" ", "-"), stage(spark, docs, sf_dir))
    return docs
