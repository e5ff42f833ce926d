"""Tables written to the cluster's shared folder and read again: they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_root: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset (tests on one machine) a temporary one."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local_root:
        _local_root.append(tempfile.mkdtemp(prefix="kinweave-"))
    return f"file://{_local_root[0]}"


class Scratch:
    """They stay until drop() is called or the folder is cleared with the application."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/kinweave/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
        self.count = 0

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str | None = None, but: tuple[str, ...] = ()) -> None:
        """Delete the tables of that name, or all; those named in `but` stay."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        root = jvm.org.apache.hadoop.fs.Path(self.root)
        fs = root.getFileSystem(conf)
        for status in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{self.root}/*")) or []:
            path = status.getPath()
            own = path.getName().split("-", 1)[1]
            if own not in but and name in (None, own):
                fs.delete(path, True)
