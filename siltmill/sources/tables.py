"""Named Parquet tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table `name` of the folder: one Parquet file or a folder of files."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Bytes of files up to which an input may be spread by a shuffle.
SMALL = 64 * 1024 * 1024


def spread(df: DataFrame) -> DataFrame:
    """A small input (at most SMALL bytes by its files) in as many partitions as there are cores: it may lie in one row group, which no setting of the
    reader divides. A larger one is left as the files are split (spark.sql.files.maxPartitionBytes), so its texts are never shuffled."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if size <= SMALL and df.rdd.getNumPartitions() < cores else df
