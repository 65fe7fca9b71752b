"""Shared helpers: the shared folder of the session, written intermediate tables, document columns."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WHITE = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share: ``spark.checkpoint.dir``. Where it is unset, a new temporary one in local mode, an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="clausework-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/clausework/{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and reread it: cuts lineage and survives lost executors."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def least_rows(df: DataFrame, key: str, order: list[str], k: int, groups: int = 64) -> DataFrame:
    """The ``k`` rows of each key that come first by ``order``, in two steps: within ``groups`` groups of tasks, then among at most ``groups * k`` rows, so that no key is gathered whole."""
    salted = df.withColumn("_salt", F.spark_partition_id() % groups)
    for by in ([key, "_salt"], [key]):
        salted = salted.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= k).drop("_n")
    return salted.drop("_salt")


def only_columns(names: list[str], prefix: str = "_c") -> list[str]:
    """Stand-ins for column names, numbered, so that no column of a table clashes with those that a stage adds."""
    return [f"{prefix}{i}" for i in range(len(names))]


def ranked(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``df`` with ``pos`` (place in its group, from 0, null first) and ``n`` (rows of the group).

    Rows are range-sorted, counted by (group, range) and numbered from the sums of the ranges before, so no group is gathered in one task.
    """
    by = [*group, *order]
    spread = materialise(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_at", 33)), "ranked")
    counts = spread.groupBy(*group, "_range").agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*group)
    starts = counts.select(
        *[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)],
        F.col("_range").alias("_r"),
        (F.sum("_rows").over(before.orderBy("_range")) - F.col("_rows") - F.col("_first")).alias("_shift"),
        F.sum("_rows").over(before).alias("n"),
    )
    same = F.col("_range") == F.col("_r")
    for i, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    return spread.join(starts, same).withColumn("pos", F.col("_at") + F.col("_shift")).select(*df.columns, "pos", "n")
