"""Row numbers of hot keys, and what staging leaves."""

from pyspark.sql import functions as F

from weirflow.plans import order


def test_row_numbers_of_hot_keys_are_those_of_a_window(spark, monkeypatch):
    df = spark.range(3000).select((F.col("id") % 7 == 0).cast("int").alias("k"), F.when(F.col("id") % 5 > 0, F.col("id") % 3).alias("j"), F.xxhash64("id").alias("at"))
    want = sorted(map(str, order.row_numbers(df, ["k", "j"], ["at"]).select("k", "j", "at", "_n").collect()))
    monkeypatch.setattr(order, "HOT", 10)
    assert sorted(map(str, order.row_numbers(df, ["k", "j"], ["at"]).select("k", "j", "at", "_n").collect())) == want


def test_staged_rows_lie_in_a_folder_of_the_application(spark):
    folder = order.own_folder(spark)
    assert spark.sparkContext.applicationId in folder and order.staged(spark.range(3)).inputFiles()[0].startswith(folder.replace("file://", "file:").replace("file:", "file://", 1))
