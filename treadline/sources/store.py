"""The table store: Parquet tables keyed by trial, spread over a fixed number of buckets.

A folder per trial would mean millions of tiny files beside a few huge ones. Rows are placed by a hash bucket of the
trial instead and sorted by trial inside the files, so that reading one trial touches one folder and few row groups.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = "2.0"
BUCKETS = 256
# Tables of a trial and of a print store, with the columns that identify a row.
TABLES = {
    "trial": ("trial_id",), "body_roi": ("trial_id", "frame"), "cycle": ("trial_id", "cycle_id"),
    "cycle_frame": ("trial_id", "cycle_id", "frame"), "print": ("trial_id", "print_id"), "print_frame": ("trial_id", "print_id", "frame"),
    "pose2d": ("trial_id", "camera", "frame", "joint"), "pose3d": ("trial_id", "frame", "joint"), "metric": ("trial_id", "limb", "metric"),
    "calibration": ("trial_id", "camera"),
}


def _bucket(trial: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(trial.cast("string")), F.lit(buckets)).cast("int")


def write_table(df: DataFrame, root: str, table: str, mode: str = "overwrite", buckets: int = BUCKETS) -> None:
    """Write one table of the store. Rows are spread by their whole key, so a long trial is written by many tasks."""
    key = TABLES[table]
    d = df.withColumn("schema_version", F.lit(SCHEMA_VERSION)).withColumn("bucket", _bucket(F.col("trial_id"), buckets))
    (d.repartition("bucket", F.pmod(F.xxhash64(*key), F.lit(8))).sortWithinPartitions("bucket", *key)
     .write.mode(mode).partitionBy("bucket").option("compression", "zstd").parquet(f"{root}/{table}"))


def write_store(tables: dict[str, DataFrame], root: str, mode: str = "overwrite", buckets: int = BUCKETS) -> None:
    for name, df in tables.items():
        write_table(df, root, name, mode, buckets)


def read_table(spark: SparkSession, root: str, table: str, trials: Sequence[str] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Read a table, or some trials of it (bucket folders and row groups are pruned). Another major version is an error."""
    d = spark.read.parquet(f"{root}/{table}")
    if trials is not None:
        wanted = list(trials)
        kind = dict(d.dtypes)["trial_id"]
        ids = [F.lit(t).cast(kind) for t in wanted]
        rows = spark.range(1).select(F.explode(F.array(*[_bucket(i, buckets) for i in ids])).alias("b")).distinct().collect()
        d = d.where(F.col("bucket").isin([r["b"] for r in rows]) & F.col("trial_id").isin(wanted))
    major = SCHEMA_VERSION.split(".")[0]
    same = F.split("schema_version", r"\.")[0] == major
    checked = F.when(same, F.col("schema_version")).otherwise(F.raise_error(F.lit("store written by another major version")).cast("string"))
    return d.withColumn("schema_version", checked).drop("bucket")


def check_joint_count(pose: DataFrame, keys: Sequence[str], joints: int) -> DataFrame:
    """Frames whose number of distinct joints is not the expected one; empty for a well-formed table."""
    return (pose.groupBy(*keys).agg(F.count_distinct("joint").alias("n_joints"), F.count(F.lit(1)).alias("n_rows"))
            .where((F.col("n_joints") != joints) | (F.col("n_rows") != joints)))


def print_positions(spark: SparkSession, root: str) -> DataFrame:
    """The flat index of all prints: only these columns are read."""
    return spark.read.parquet(f"{root}/print").select("trial_id", "print_id", "touchdown_frame", "liftoff_frame", "peak_centroid_x_mm", "peak_centroid_y_mm")
