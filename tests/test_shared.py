import time

from factree.sources import shared
from pyspark.sql import functions as F


def shuffle_files(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = manager.getAllFiles()
    names = (files.apply(k).getName() for k in range(files.size()))
    return {n for n in names if n.startswith("shuffle_")}


def test_a_written_table_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    rows = spark.range(20_000).withColumn("k", F.pmod(F.xxhash64("id"), F.lit(500)))
    sums = rows.repartition("k").groupBy("k").agg(F.sum("id").alias("n"))
    setting = spark.conf.get(shared.CLEANUP)
    out = shared.scratch(spark, rows.join(sums.hint("merge"), "k"), "sums")
    end = time.time() + 20
    while (left := shuffle_files(spark) - before) and time.time() < end:
        time.sleep(0.2)
    assert not left and spark.conf.get(shared.CLEANUP) == setting
    assert out.count() == 20_000 and sums.count() == 500 and rows.join(sums, "k").count() == 20_000
    shared.release(out)
