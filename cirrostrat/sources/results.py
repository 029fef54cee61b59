"""Results as partitioned Parquet, with resumption."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_sweep(rows: DataFrame, path: str, *, mode_name: str, members: int, truth: int) -> None:
    """Rows of a sweep or of a single observation under mode, ne and tm; what was there for these is replaced."""
    tagged = rows.withColumns({"mode": F.lit(mode_name), "ne": F.lit(members), "tm": F.lit(truth)})
    tagged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("mode", "ne", "tm").parquet(path)


def write_reference(rows: DataFrame, path: str) -> None:
    """Written once: kept if it is there."""
    rows.write.mode("ignore").parquet(path)


def write_analysis(rows: DataFrame, path: str, combo_id: int) -> None:
    rows.withColumn("combo_id", F.lit(combo_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("combo_id").parquet(path)


def write_zones(fields: DataFrame, path: str) -> None:
    """Analysed zones by combination; what was there for these combinations is replaced. Zones of an observation lie
    together in a file, and a combination with very many is several files."""
    fields.repartition("combo_id", F.pmod(F.xxhash64("obs_id"), F.lit(64))).sortWithinPartitions("combo_id", "obs_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("combo_id").parquet(path)


def unfinished(spark: SparkSession, combos: DataFrame, path: str) -> DataFrame:
    """Combinations without a result in path."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return combos
    return combos.join(spark.read.parquet(path).select("combo_id").distinct(), "combo_id", "left_anti")


def copy_config(spark: SparkSession, config: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(config, indent=1, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def collect_chunks(spark: SparkSession, *paths: str) -> DataFrame:
    """All chunks of results as one table; columns are matched by name."""
    return spark.read.option("mergeSchema", "true").parquet(*paths)


def read_fields(spark: SparkSession, path: str, combo_id: int | None = None) -> DataFrame:
    """Stored analyses as rows: a point, the variable and its value, for all combinations or one."""
    from ..schema import POINT, VARIABLES

    stored = spark.read.parquet(path)
    if combo_id is not None:
        stored = stored.where(F.col("combo_id") == combo_id)
    keys = [c for c in (*POINT, "m", "combo_id") if c in stored.columns]
    if "var" in stored.columns:  # means are rows already
        return stored
    return stored.unpivot(keys, [c for c in VARIABLES if c in stored.columns], "var", "value")
