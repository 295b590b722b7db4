"""A target that the rates cannot reach is reported."""

import pytest
from pyspark.sql import functions as F

from lattica.llm.mixing import mix, resample


def test_missed_target_is_reported(spark):
    docs = spark.createDataFrame([(i, f"the same words in every text {i % 2}") for i in range(20)], "doc_id long, text string")
    labelled = docs.select("doc_id", F.lit("en").alias("domain"))
    with pytest.warns(UserWarning, match="off target"):
        out = mix(spark, docs, labelled.limit(0), {"en": 9, "fr": 1})
    assert out.first().residual > 0.1
    with pytest.warns(UserWarning, match="off target"):
        resample(spark, docs, labelled.limit(0), {"en": 9, "fr": 1})
