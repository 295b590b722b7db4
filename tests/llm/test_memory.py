"""Python workers are kept for later stages, so they must not keep what a stage took."""

import subprocess
import sys

SCRIPT = """
import os
import pyarrow as pa
from pyspark.sql import SparkSession
import public_tokenizers
from lattica.llm.quality import keep_good
from lattica.llm.segmentation import segment

spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()

def resident(batches):
    for _ in batches:
        pass
    with open("/proc/self/statm") as f:
        yield pa.RecordBatch.from_pydict({"pid": [os.getpid()], "mb": [int(f.read().split()[1]) * 4096 / 1e6]})

def measure():
    return spark.range(1, numPartitions=1).mapInArrow(resident, "pid long, mb double").collect()[0]

first = measure()
docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").limit(3000)
labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
for out in (keep_good(spark, docs, labels), segment(spark, docs, public_tokenizers.path("piece_bpe_32k.model"))):
    out.write.format("noop").mode("overwrite").save()
last = measure()
print("grown", first.pid == last.pid, last.mb - first.mb)
"""


def test_workers_give_their_memory_back():
    done = subprocess.run([sys.executable, "-c", SCRIPT], capture_output=True, text=True, timeout=300)
    same, grown = done.stdout.split("grown ")[1].split()
    assert same == "True" and float(grown) < 180, grown
