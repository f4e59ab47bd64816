"""Tables that operators write on the way."""

import glob
import os
import tempfile
import time

from pyspark.sql import functions as F

from quillon.llm._batches import CLEANUP_SETTING, shared_folder, written


def shuffle_files(spark):
    top = spark.conf.get("spark.local.dir", None) or os.environ.get("SPARK_LOCAL_DIRS") or tempfile.gettempdir()
    return set(glob.glob(f"{top}/**/blockmgr-*/*/shuffle_*", recursive=True))


def test_written_leaves_no_shuffle_files(spark):
    before, own = shuffle_files(spark), spark.conf.get(CLEANUP_SETTING)
    rows = spark.range(1000).repartition(7).groupBy((F.col("id") % 10).alias("k")).agg(F.count("*").alias("n"))
    got = written(rows, f"{shared_folder(spark)}/t")
    for _ in range(50):
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left
    assert spark.conf.get(CLEANUP_SETTING) == own
    assert {r["n"] for r in got.collect()} == {100}
