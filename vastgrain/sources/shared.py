"""Tables in the folder that all executors share: lineage is cut, and what is read twice is computed once."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Only a local session may go without; it gets a temporary folder."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="vastgrain-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path there, deleted when the driver ends."""
    path = f"{shared_folder(spark)}/vastgrain/{name}-{uuid.uuid4().hex}"
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return path


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """``df``, written once and read back."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Store:
    """Files and folders below a path in any store that Spark reads: sizes, moves, deletes, and small texts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.system = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.system.mkdirs(self._at(""))

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def of(self, name: str) -> str:
        """The path of a name, as Spark takes it."""
        return f"{self.path}/{name}"

    def exists(self, name: str) -> bool:
        return self.system.exists(self._at(name))

    def size(self, name: str) -> int:
        """Bytes of all files below."""
        return self.system.getContentSummary(self._at(name)).getLength()

    def move(self, name: str, to: str) -> None:
        if not self.system.rename(self._at(name), self._at(to)):
            raise OSError(f"{self.of(name)} can't be moved to {to}")

    def delete(self, name: str) -> None:
        self.system.delete(self._at(name), True)

    def write(self, name: str, text: str) -> None:
        """A small text, written whole and then moved into place."""
        out = self.system.create(self._at(name + ".part"), True)
        out.write(bytearray(text.encode()))
        out.close()
        self.delete(name)
        self.move(name + ".part", name)

    def read(self, name: str) -> str:
        stream = self.system.open(self._at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
