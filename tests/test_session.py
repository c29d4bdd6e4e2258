"""What the session helpers leave behind."""

import time

from pyspark.sql import functions as F

from quire.session import CLEANUP, Scratch


def shuffle_files(spark) -> set[str]:
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for name in (files.apply(i).getName() for i in range(files.size())) if name.startswith("shuffle_")}


def test_saved_and_kept_tables_leave_no_shuffle_files(spark):
    before, setting = shuffle_files(spark), spark.conf.get(CLEANUP)
    rows = spark.range(1000).withColumn("key", F.xxhash64("id"))
    with Scratch(spark) as s:
        planned = rows.repartition(4, "key").groupBy(F.col("key") % 7).count()  # planned under the session's own setting
        assert len(s.save(planned, "saved").collect()) == len(s.keep(planned).collect()) == 13
        for _ in range(50):  # files go in the background
            if not shuffle_files(spark) - before:
                break
            time.sleep(0.1)
        assert not shuffle_files(spark) - before
    assert spark.conf.get(CLEANUP) == setting
