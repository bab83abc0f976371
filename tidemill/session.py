"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

_fallback_roots: dict[str, str] = {}


def build_session(app_name: str = "tidemill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library is tested with.

    A cluster session made elsewhere works as well: no operator relies on a
    setting made here.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only where the session names none and runs on this machine alone, as in tests, a temporary
    folder is made; a cluster whose machines could not see it is refused.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    app = spark.sparkContext.applicationId
    if app not in _fallback_roots:
        _fallback_roots[app] = tempfile.mkdtemp(prefix="tidemill-")
        spark.sparkContext.setCheckpointDir(os.path.join(_fallback_roots[app], "checkpoints"))
    return _fallback_roots[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path nobody has used yet below the scratch folder."""
    return f"{scratch_root(spark)}/tidemill/{label}-{uuid.uuid4().hex}"


def scratch_database(spark: SparkSession, name: str = "tidemill_scratch") -> str:
    """A database whose tables live below the scratch folder."""
    spark.sql(
        f"CREATE DATABASE IF NOT EXISTS {name} LOCATION '{scratch_path(spark, name)}'"
    )
    return name


def delete_folder(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@dataclass(frozen=True)
class Materialized:
    """Rows written below the scratch folder, with their number."""

    rows: DataFrame
    count: int
    path: str

    def drop(self) -> None:
        delete_folder(self.rows.sparkSession, self.path)


def materialize(df: DataFrame, label: str) -> Materialized:
    """Cut the lineage of ``df``: write it once, go on from the files.

    The files outlive lost executors, carry their size for the planner, and
    the rows are counted while they are written.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    seen = Observation(f"rows_{uuid.uuid4().hex}")
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    return Materialized(spark.read.schema(df.schema).parquet(path), seen.get["rows"], path)
