"""Queries that cover their whole tables."""

from pyspark.sql import functions as F

from lattica import queries as own

from test_oracle import SF


def test_unwind_returns_every_line(spark):
    lines = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.size(F.split("text", "\n")).alias("n"))
    got = own.QUERIES["unwind_index"](spark, SF).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    assert lines.filter("n > 3").count() > 0
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, lines.filter("n > 0").collect()))


def test_densify_covers_every_buyer(spark):
    events = spark.read.parquet(f"{SF}/events.parquet").filter("event_type = 'purchase'")
    users, days = events.agg(F.count_distinct("user_id"), F.date_diff(F.max("ts"), F.min("ts")) + 1).first()
    got = own.QUERIES["densify_daily"](spark, SF).agg(F.count_distinct("u"), F.count(F.lit(1)), F.sum("n")).first()
    assert users > 5 and tuple(got) == (users, users * days, events.count())


def test_changes_meet_the_whole_table(spark):
    customers = spark.read.parquet(f"{SF}/customer.parquet")
    n, gone = customers.count(), customers.filter("c_acctbal < 0 and c_mktsegment <> 'BUILDING'").count()
    got = own.QUERIES["cdc_apply"](spark, SF).agg(F.count_if(F.col("_id") < 0), F.count_if(F.col("_id") >= 0)).first()
    assert gone and tuple(got) == (n, n - gone)
