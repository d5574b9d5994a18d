"""What a session shares with its executors: this package, and tables written on the way."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``, deleted when the driver ends. Only on a local master,
    where that is unset, a local one is chosen."""
    sc = spark.sparkContext
    if sc.applicationId not in _FOLDERS:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            root = os.path.join(tempfile.gettempdir(), "checkpoints", "strataq")
        path = sc._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{uuid.uuid4().hex}")
        files = path.getFileSystem(sc._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _FOLDERS[sc.applicationId] = path.toString()
    return _FOLDERS[sc.applicationId]


def scratch(spark: SparkSession) -> str:
    """A new folder name in the shared folder."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Send the package's modules to the Python workers, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    top = Path(__file__).resolve().parent.parent
    if not top.is_dir():  # already run from an archive
        return
    path = os.path.join(tempfile.mkdtemp(), f"{top.name}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    sc.addPyFile(path)
