"""Intermediate tables in the shared folder the cluster names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def work_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; a temporary one only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="seamline-"))
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/seamline/{uuid.uuid4().hex}"


def written(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Write `df` once and read it back.

    Cuts the lineage so that lost executors cost a re-read and not a re-run,
    pins results that two later jobs must agree on, and gives the planner a
    true size: a small written table is broadcast by Spark's own threshold, a
    large one is not.
    """
    spark = df.sparkSession
    target = folder or work_folder(spark)
    df.write.mode("errorifexists").parquet(target)
    return spark.read.schema(df.schema).parquet(target)


def discard(table: DataFrame) -> None:
    """Deletes the files of a written table that was read for the last time."""
    spark = table.sparkSession
    for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(table: DataFrame, key: str) -> DataFrame:
    """Deal a table of fewer files than cores out by `key`.

    Larger tables keep the partitions of their scan and are not shuffled.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores, key) if len(table.inputFiles()) < cores else table


def literal_rows(spark: SparkSession, schema: str, *rows: dict) -> DataFrame:
    """A few rows of literals, or none; missing values are null."""
    fields = T.StructType.fromDDL(schema)

    def literal(row: dict, field: T.StructField):
        return F.lit(row.get(field.name)).cast(field.dataType).alias(field.name)

    made = [spark.range(1).select(*[literal(row, f) for f in fields]) for row in rows]
    made = made or [spark.range(0).select(*[literal({}, f) for f in fields])]
    result = made[0]
    for more in made[1:]:
        result = result.unionAll(more)
    return result.coalesce(1)
