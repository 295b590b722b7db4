"""The near-copy stage returns every column of its input, however it is named."""

import corpus_pipeline


def test_near_copies_keep_oddly_named_columns(spark):
    text = " ".join(f"word{i}" for i in range(200))
    rows = [(2, text, "x", "p"), (1, text + " more", "y", "q"), (3, None, "z", None), (4, "", None, "s"), (5, "quite another text of a few words", "w", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string, `c``d` string")
    got = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(tuple(r) for r in got.collect()) == sorted((r for r in rows if r[0] != 2), key=lambda r: r[0])
