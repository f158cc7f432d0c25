"""Published model versions.

A version is a folder of its own that nothing is written over. Its manifest (one Parquet row per entry) names what
belongs to it and is written last, so a version without a whole manifest is not there for readers: a job that dies
while it saves leaves the newest complete version in place. ``latest`` finds that version in any process.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST, CODES = "manifest", "codes"


def publish(spark: SparkSession, path: str, entries: dict[str, str]) -> None:
    """Write the manifest of the version in ``path``; all that it names has to be there."""
    rows = [(k, str(v)) for k, v in {**entries, "published": datetime.now(timezone.utc).isoformat(timespec="microseconds")}.items()]
    spark.createDataFrame(rows, "entry string, value string").coalesce(1).write.mode("overwrite").parquet(f"{path}/{MANIFEST}")


def versions(spark: SparkSession, folder: str) -> list[str]:
    """The complete versions in a folder."""
    sc = spark.sparkContext
    pattern = sc._jvm.org.apache.hadoop.fs.Path(f"{folder}/*/{MANIFEST}/_SUCCESS")
    found = pattern.getFileSystem(sc._jsc.hadoopConfiguration()).globStatus(pattern) or []
    return [s.getPath().getParent().getParent().toString() for s in found]


def manifest(spark: SparkSession, path: str) -> dict[str, str]:
    return {r["entry"]: r["value"] for r in spark.read.parquet(f"{path}/{MANIFEST}").collect()}


def latest(spark: SparkSession, folder: str) -> tuple[str, dict[str, str]] | None:
    """Path and manifest of the version published last, if there is a complete one."""
    found = [(manifest(spark, path), path) for path in versions(spark, folder)]
    entries, path = max(found, key=lambda v: (v[0]["published"], v[1]), default=(None, None))
    return None if path is None else (path, entries)


def save_codes(codes: DataFrame, path: str) -> None:
    """the category codes (column, label, code) of a version."""
    codes.select("column", "label", F.col("code").cast("int").alias("code")).coalesce(1).write.mode("overwrite").parquet(f"{path}/{CODES}")


def load_codes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{CODES}")
