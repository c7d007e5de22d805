"""Materialised steps in the folder that all executors share, and code shipping."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once per application, whatever the driver's working folder is."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="strada-"), f"{os.path.basename(top)}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for d, _, names in os.walk(top):
            for n in names:
                if n.endswith(".py"):
                    z.write(os.path.join(d, n), os.path.relpath(os.path.join(d, n), os.path.dirname(top)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def work_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset and all runs on one machine, below a new temporary folder."""
    ship(spark)
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="strada-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/strada-{uuid.uuid4().hex}"


@contextmanager
def opened(path: str):
    """A binary file to read, with seek(): a plain path or file: from here, any other scheme through pyarrow's file systems."""
    at = urlparse(path)
    if at.scheme in ("", "file"):
        with open(at.path if at.scheme else path, "rb") as f:
            yield f
    else:
        from pyarrow import fs

        system, name = fs.FileSystem.from_uri(path)
        with system.open_input_file(name) as f:
            yield f


def materialize(df: DataFrame, path: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage ends there, and lost executors lose nothing."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
