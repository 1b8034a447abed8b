"""Tables in the folder that driver and executors share: they cut a lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; set here only where it is unset and everything runs on one machine."""
    conf = spark.sparkContext.getConf()
    base = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if not base:
        master = conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


#: Folders that this driver has named, and may delete.
_made: list[str] = []


def fresh_dir(spark: SparkSession, name: str) -> str:
    _made.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def clear_written(spark: SparkSession, since: int = 0) -> int:
    """Deletes the folders that fresh_dir has named, from the since-th on, and returns how many; call it once results are written elsewhere."""
    store = spark.sparkContext._jvm.org.apache.hadoop.fs
    gone = 0
    while len(_made) > since:
        at = store.Path(_made.pop())
        gone += bool(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True))
    return gone


def named_so_far() -> int:
    """A mark for clear_written's since."""
    return len(_made)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder."""
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)
