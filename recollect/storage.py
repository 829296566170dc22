"""Shared-folder storage: materialised tables, small control files, atomic commits.

Everything an executor may need again lives below the folder named by
``spark.checkpoint.dir``; a private temporary folder is used only where that
setting is missing and the master is local (tests, notebooks).
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOTS: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """Folder that all executors share, from ``spark.checkpoint.dir``."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    app = sc.applicationId
    if app not in _LOCAL_ROOTS:
        known = sc._jsc.sc().getCheckpointDir()
        if known.isDefined():
            _LOCAL_ROOTS[app] = known.get().rstrip("/")
        elif sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
            _LOCAL_ROOTS[app] = "file://" + tempfile.mkdtemp(prefix="recollect-")
            sc.setCheckpointDir(_LOCAL_ROOTS[app])
            _delete_on_exit(spark, _LOCAL_ROOTS[app])
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _LOCAL_ROOTS[app]


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _delete_on_exit(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.deleteOnExit(p)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; removed when the application ends."""
    path = f"{shared_root(spark)}/recollect/{name}-{uuid.uuid4().hex}"
    _delete_on_exit(spark, path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet to the shared folder and read it back.

    Unlike ``checkpoint()`` the copy is compressed and later reads prune columns.
    An executor lost afterwards loses nothing.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_text(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file atomically: written aside, then renamed; False if the name is taken."""
    fs, p = _fs(spark, path)
    if fs.exists(p):
        return False
    aside = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(aside, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    if fs.rename(aside, p):
        return True
    fs.delete(aside, False)
    return False


def read_text(spark: SparkSession, path: str) -> str:
    """Whole text of a small control file."""
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or a folder with all below it."""
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names directly below ``path``; empty if it does not exist."""
    fs, p = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
