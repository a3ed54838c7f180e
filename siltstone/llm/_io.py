"""Work tables in the folder that all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from siltstone.session import map_texts, work_path  # noqa: F401


def free_name(name: str, columns: list[str]) -> str:
    """``name``, longer where a column has it already."""
    while name.lower() in (c.lower() for c in columns):
        name += "_"
    return name


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends here, and an
    executor that is lost takes nothing with it."""
    spark = df.sparkSession
    path = work_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._work_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete work tables that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_work_path", None)
        if path:
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def nth_values(values: DataFrame, ranks: list[int]) -> list[float]:
    """The values at ``ranks`` (from 0) of the only column of ``values`` in ascending order, exactly: counted in bins of
    1/10,000, then each value of the bins that hold a rank."""
    v = F.col(values.columns[0])
    bins = sorted((r["b"], r["k"]) for r in values.groupBy(F.floor(v * 10_000).alias("b")).agg(F.count("*").alias("k")).collect())
    out, before = {}, 0
    for b, k in bins:
        some = [r for r in ranks if before <= r < before + k]
        at = before
        if some:
            for x, times in sorted(tuple(r) for r in values.where(F.floor(v * 10_000) == b).groupBy(v).agg(F.count("*")).collect()):
                out |= {r: x for r in some if at <= r < at + times}
                at += times
        before += k
    return [out[r] for r in ranks]
