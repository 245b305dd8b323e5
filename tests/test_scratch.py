"""Scratch tables and their sweeping."""

import time
from pathlib import Path

from pyspark.sql import functions as F

from logloom.scratch import CLEANUP, _shuffles_deleted, discard, materialize, swept


def held(table):
    return Path(table._scratch.removeprefix("file:").replace("//", "/", 1)).exists()


def test_swept(spark):
    outside = materialize(spark.range(3), "a")
    with swept() as outer:
        lost = materialize(spark.range(4), "b")
        with swept() as inner:
            gone, passed = materialize(lost, "c"), materialize(lost.where("id > 1"), "d")
            inner.append(passed)
        assert held(lost) and held(passed) and not held(gone)
        stays = materialize(passed, "e")
        outer.append(stays)
    assert not held(lost) and not held(passed)
    assert held(outside) and outside.count() == 3 and stays.count() == 2
    for table in (outside, stays, lost):
        discard(table)
    assert not held(outside) and not held(stays)


def test_swept_after_failure(spark):
    written = []
    try:
        with swept():
            written.append(materialize(spark.range(3), "a"))
            raise ValueError
    except ValueError:
        assert not held(written[0])


def shuffle_files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {p for d in found for p in Path(d.getPath()).rglob("shuffle_*")}


def test_shuffles_deleted(spark):
    """What was shuffled for a table goes once it is written, without the driver's garbage collection."""
    df = spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count()
    before, setting = shuffle_files(spark), spark.conf.get(CLEANUP, None)
    seen = []
    for _ in range(2):
        table = materialize(df, "a")
        for _ in range(50):
            if not (left := shuffle_files(spark) - before):
                break
            time.sleep(0.1)
        seen.append(len(left))
        assert table.count() == 10
        before |= shuffle_files(spark)  # of the count
        discard(table)
    assert seen == [0, 0] and spark.conf.get(CLEANUP, None) == setting
    # a caller's own runs of the same plan keep what they shuffled
    assert len(df.collect()) == 10 and shuffle_files(spark) - before and len(df.collect()) == 10


def test_setting_restored(spark):
    """Also after a failed write and beside another one that is under way."""
    setting = spark.conf.get(CLEANUP, None)
    with _shuffles_deleted(spark):
        try:
            materialize(spark.range(3).select(F.raise_error(F.lit("x")).cast("long")), "a")
        except Exception:
            assert spark.conf.get(CLEANUP) == "true"
    assert spark.conf.get(CLEANUP, None) == setting
