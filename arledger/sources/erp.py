"""ERP export readers (declared schemas, never inferred) and report sinks.

Raw exports are read with every column as text (``schemas.RAW_SCHEMAS``) so the validator can
report non-numeric values; the normalisers type them. Quoted fields may contain commas, quotes are
escaped by doubling. Exports have one record per line, so large files are split among tasks;
``multi_line``, which every reader takes, reads line breaks inside quotes (as narratives have them), one task per file.

Records that don't have the export's fields (an open quote, a short or long row) don't become rows in silence:
``read_quarantined`` keeps them apart as text. ``read_raw_tables`` keeps their text in a column, for which the quality
report has a rule; ``load_raw_data`` leaves them out and writes them to a side table if it is given a path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import normalize
from ..operators.quality import RECORD
from ..session import stored
from .schemas import RAW_SCHEMAS


def read_raw(spark: SparkSession, path: str, dataset: str, multi_line: bool = False, header: bool = True, malformed: bool = False) -> DataFrame:
    """One raw export with its declared (all-text) schema; empty fields are NULL. ``malformed`` adds the column ``RECORD``
    with the text of records that don't fit (all fields are then parsed, whichever are read)."""
    schema = RAW_SCHEMAS[dataset]
    reader = spark.read.option("header", header).option("multiLine", multi_line).option("escape", '"').option("mode", "PERMISSIVE")
    if not malformed:
        return reader.schema(schema).csv(path)
    schema = T.StructType([*schema.fields, T.StructField(RECORD, T.StringType())])
    return reader.schema(schema).option("columnNameOfCorruptRecord", RECORD).option("columnPruning", False).csv(path)


def read_quarantined(spark: SparkSession, path: str, dataset: str, multi_line: bool = False, header: bool = True) -> tuple[DataFrame, DataFrame]:
    """The export's good rows, and (dataset, record) of its malformed records. The file is parsed once and stored."""
    rows = stored(read_raw(spark, path, dataset, multi_line, header, malformed=True), f"raw-{dataset}")
    bad = F.col(RECORD).isNotNull()
    return rows.where(~bad).drop(RECORD), rows.where(bad).select(F.lit(dataset).alias("dataset"), F.col(RECORD).alias("record"))


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or pattern names a file or folder, in whatever file system it is."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(sc._jsc.hadoopConfiguration()).globStatus(at)
    return found is not None and len(found) > 0


def read_raw_optional(spark: SparkSession, path: str, dataset: str, multi_line: bool = False, malformed: bool = False) -> DataFrame | None:
    """Like :func:`read_raw`, but a missing file gives None (reported as a failed rule). Only
    the absence of the path counts; any other fault is raised."""
    return read_raw(spark, path, dataset, multi_line, malformed=malformed) if path_exists(spark, path) else None


def read_raw_tables(spark: SparkSession, paths: dict[str, str], multi_line: bool = False, malformed: bool = True) -> dict[str, DataFrame | None]:
    """The four raw tables for ``quality.validate_all`` (absent files map to None), with the text of malformed
    records."""
    return {name: read_raw_optional(spark, path, name, multi_line, malformed) for name, path in paths.items()}


def load_raw_data(spark: SparkSession, customer_path: str, invoice_path: str, gl_path: str, multi_line: bool = False, quarantine_path: str | None = None):
    """Customers (N1), invoices (N3-N5) and GL (N6), normalised, without malformed records; these are written to
    ``quarantine_path`` (Parquet: dataset, record)."""
    paths = {"customer_master": customer_path, "invoice_history": invoice_path, "gl_cash_positions": gl_path}
    good, bad = {}, None
    for name, path in paths.items():
        good[name], records = read_quarantined(spark, path, name, multi_line)
        bad = records if bad is None else bad.unionByName(records)
    if quarantine_path is not None:
        bad.write.mode("overwrite").parquet(quarantine_path)
    return normalize.customer_master(good["customer_master"]), normalize.invoice_history(good["invoice_history"]), normalize.gl_cash(good["gl_cash_positions"])


def write_feature_store(split_df: DataFrame, path: str) -> None:
    """One Parquet table partitioned by split (train / test): partition pruning replaces the
    separate train and test files."""
    split_df.write.mode("overwrite").partitionBy("split").parquet(path)


def load_splits(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Train and test as filtered scans of the split-partitioned table."""
    df = spark.read.parquet(path)
    return df.where(F.col("split") == "train").drop("split"), df.where(F.col("split") == "test").drop("split")


def _csv(df: DataFrame, path: str, files: int | None) -> None:
    """CSV with a header; ``files`` merges the output (a report of a few rows) into so many."""
    df = df if files is None else df.coalesce(files)
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_risk_report(report: DataFrame, path: str, files: int | None = None) -> None:
    """The risk report as CSV with a header; the array column is dropped; narratives are
    quoted multi-line text."""
    _csv(report.drop("SHAP_VALUES"), path, files)


FLAGGED_COLS = ["BELNR", "KUNNR", "INDUSTRY", "REGION", "DMBTR", "FAEDT", "LATE_PROB", "RISK_LABEL"]


def write_flagged_invoices(queue: DataFrame, path: str, files: int | None = None) -> None:
    """Flagged-invoice export (invoice, customer, segments, amount, due date, prob, label)."""
    _csv(queue.select(*FLAGGED_COLS), path, files)
