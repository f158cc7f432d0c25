"""Session helpers: a local session for tests and benches, and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import hashlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "arledger") -> SparkSession:
    """Session for tests and single-machine runs. On a cluster, use the session you are given."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("ARLEDGER_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Scratch folders of local sessions without a configured one, by application.
_LOCAL_DIRS: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the setting must name a shared folder (HDFS/object store). Only a local-mode
    session without the setting (tests) gets a fresh scratch folder of its own, which is remembered
    here (the setting itself can't be changed at run time).
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or _LOCAL_DIRS.get(sc.applicationId)
    if not path:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder before running on a cluster")
        path = _LOCAL_DIRS[sc.applicationId] = tempfile.mkdtemp(prefix="arledger-ckpt-", dir="/tmp")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def digest(text: str) -> str:
    """Short stable name for a key (the same in every process, unlike ``hash``)."""
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def tables_dir(spark: SparkSession) -> str:
    """This application's own folder for intermediate tables under the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/arledger-tables/{spark.sparkContext.applicationId}"


def models_dir(spark: SparkSession, kind: str, key: str) -> str:
    """Folder of the saved models of one kind and data directory, one sub-folder per application
    (the same path in every process, so a later one can load them; never written over)."""
    return f"{checkpoint_dir(spark).rstrip('/')}/arledger-models/{kind}-{digest(key)}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new folder of this application and return a scan of it (cut lineage: every
    reader sees the same rows, and a lost executor re-reads files)."""
    path = f"{tables_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    drop_at_exit(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_MATERIALIZED: dict[tuple, DataFrame] = {}


def materialize(df, name: str, key: str = "", spark: SparkSession | None = None) -> DataFrame:
    """Write a DataFrame once per session as Parquet under the shared checkpoint folder and
    return a scan of it (lineage cut; later reads get column pruning and filter pushdown; a
    lost executor re-reads files instead of recomputing upstream shuffles).

    ``df`` may be a zero-argument callable building the DataFrame: it is only called when the
    table is not yet written in this session (plan construction itself costs analysis time).
    """
    if spark is None:
        spark = df.sparkSession if isinstance(df, DataFrame) else SparkSession.getActiveSession()
    memo_key = (spark.sparkContext.applicationId, name, key)
    scan = _MATERIALIZED.get(memo_key)
    if scan is None:
        frame = df() if callable(df) and not isinstance(df, DataFrame) else df
        scan = _MATERIALIZED[memo_key] = stored(frame, f"{name}-{digest(key)}")
    return scan


_TO_DROP: set[str] = set()


def drop_at_exit(spark: SparkSession) -> None:
    """Remove this application's intermediate tables when the driver ends."""
    app = spark.sparkContext.applicationId
    if app not in _TO_DROP:
        _TO_DROP.add(app)
        atexit.register(_drop_if_alive, spark)


def _drop_if_alive(spark: SparkSession) -> None:
    if spark.sparkContext._jsc is not None:
        drop_tables(spark)


def drop_tables(spark: SparkSession) -> None:
    """Remove this application's intermediate tables (also done when the driver ends)."""
    app = spark.sparkContext.applicationId
    for k in [k for k in _MATERIALIZED if k[0] == app]:
        del _MATERIALIZED[k]
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(tables_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
