"""Session defaults and the one place that decides where lineage is cut."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_made: dict[str, SparkSession] = {}


def build_session(app: str = "mnemospark", cpus: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; on a cluster the submitter's own session is used as it is."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("MNEMO_DRIVER_MEMORY", "12g"))
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir.

    Where that is unset a local session gets a folder of its own; on a cluster it is an
    error, for a folder of the driver's machine is not seen by the executors.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d
    master = spark.conf.get("spark.master", "local")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors share; the master is {master}")
    _own.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="mnemospark-"))
    return _own["dir"]


def new_table_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses. It is deleted when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not _own.get("at_exit"):
        _own["at_exit"] = str(atexit.register(release_all))
    _made[path] = spark
    return path


def materialize(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write df as a table in the shared folder and return the table: it survives the loss of any executor."""
    spark = df.sparkSession
    path = new_table_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._own_table = path
    return out


def release(df: DataFrame) -> None:
    """Delete the table that `materialize` made for df. For steps that are over: nothing may read it later."""
    path = getattr(df, "_own_table", None)
    if path and path in _made:
        delete_path(_made.pop(path), path)


def release_all() -> None:
    """Delete every table this driver made; those of a session that has ended already are left to the cluster."""
    for path, spark in list(_made.items()):
        try:
            delete_path(spark, path)
        except Exception:  # noqa: BLE001 - the session is gone
            break
    _made.clear()


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    p, fs = _hadoop(spark, path)
    return fs.exists(p)


def delete_path(spark: SparkSession, path: str) -> bool:
    """Delete a folder and all in it, on any file system that Hadoop knows."""
    p, fs = _hadoop(spark, path)
    return fs.delete(p, True)


def move_path(spark: SparkSession, old: str, new: str) -> None:
    p, fs = _hadoop(spark, old)
    if not fs.rename(p, _hadoop(spark, new)[0]):
        raise OSError(f"{old} could not be moved to {new}")
