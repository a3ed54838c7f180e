"""Samples that can be drawn again, and batches by length."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F


def placed(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table with each row's place in file order: its place in the file and the rows of the files before."""
    rows = spark.read.parquet(path).select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    files = rows.groupBy("__file").agg(F.count("*").alias("n"))
    before = files.select("__file", (F.sum("n").over(W.orderBy("__file")) - F.col("n")).alias("before"))  # a row for each file
    return rows.join(F.broadcast(before), "__file").withColumn("__place", F.col("before") + F.col("__row")).drop("before", "__file", "__row")


def systematic_sample(spark: SparkSession, path: str, size: int) -> DataFrame:
    """Every n-th row in file order, n the number of rows over ``size``, up to ``size`` rows."""
    rows = placed(spark, path)
    step = max(1, rows.count() // size)
    return rows.where((F.col("__place") % step == 0) & (F.col("__place") < step * size)).drop("__place")


def seeded_sample(df: DataFrame, size: int, seed: int, key: str) -> DataFrame:
    """``size`` rows in the order of a seeded hash of the key: the same at every run and partitioning."""
    return df.withColumn("__at", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))).orderBy("__at", key).limit(size).drop("__at")


def length_bucket(length: Column, bounds: tuple[int, ...] = (64, 128, 256, 512)) -> Column:
    """The smallest bound that is not under the length; the largest for longer ones."""
    low, top = sorted(bounds), max(bounds)
    return reduce(lambda c, b: F.when(length <= b, b).otherwise(c), reversed(low[:-1]), F.lit(top))


def by_length(df: DataFrame, length: Column, bounds: tuple[int, ...] = (64, 128, 256, 512), tasks: int = 8) -> DataFrame:
    """Rows dealt by bucket and a salt, ascending in length, for batches that pad little; column ``bucket`` is added."""
    rows = df.withColumns({"bucket": length_bucket(length, bounds), "__n": length, "__salt": F.pmod(F.xxhash64(*df.columns), F.lit(tasks))})
    return rows.repartition("bucket", "__salt").sortWithinPartitions("bucket", "__n").drop("__n", "__salt")
