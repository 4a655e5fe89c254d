"""Session helpers shared by the operators and by the driver contract."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ensure_importable(spark: SparkSession) -> None:
    """Let Python workers import this package when it is not installed on the executors' path."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, which tests leave unset."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="brisa-")
        atexit.register(shutil.rmtree, folder, True)
        found = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


#: Lists that new scratch folders are added to (see ``collecting``).
_COLLECTING: list[list["Scratch"]] = []


@contextmanager
def collecting() -> Iterator[None]:
    """Closes, at the end, every scratch folder opened inside: for eager steps whose result is written."""
    opened: list[Scratch] = []
    _COLLECTING.append(opened)
    try:
        yield
    finally:
        _COLLECTING.remove(opened)
        for scratch in opened:
            scratch.close()


class Scratch:
    """Tables written to the shared folder, so that a lost executor costs only its own tasks.

    ``put`` runs a plan once and gives back a scan of what it wrote; ``drop`` deletes tables whose
    last reader has run. What a returned, lazy DataFrame reads stays until ``close``, at the latest
    until the driver's JVM ends, which deletes the folder.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/brisa-{uuid.uuid4().hex}"
        fs, path = _fs(spark, self.root)
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        for opened in _COLLECTING:
            opened.append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def put(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        df.write.mode("overwrite").option("compression", codec).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            fs, path = _fs(self.spark, self.path(name))
            fs.delete(path, True)

    def close(self) -> None:
        fs, path = _fs(self.spark, self.root)
        fs.delete(path, True)
