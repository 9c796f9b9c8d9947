"""Tables that cut lineage: written to the folder all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of this session's operator calls, with the session that made each.
_roots: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a local one only where none is set and all tasks run in this machine's one JVM (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="seamline-")
        atexit.register(shutil.rmtree, path, True)
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> None:
    """Remove the tables of all operator calls so far. Results that were not read or written before can't be read any more."""
    for root in [r for r, owner in _roots.items() if owner is spark]:
        _delete(spark, root)
        del _roots[root]


def _release_all() -> None:
    for spark in list(_roots.values()):
        try:
            release(spark)
        except Exception:  # noqa: BLE001  the JVM may be gone; the folder's own cleaning is left
            return


atexit.register(_release_all)


class Workspace:
    """Written tables of one operator call. A table survives lost executors, as a checkpoint does,
    but stays columnar, compressed and prunable. Tables that a result still reads stay until release() or the end of the driver's program."""

    def __init__(self, spark: SparkSession, owner: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/seamline/{owner}-{uuid.uuid4().hex}"
        _roots[self.root] = spark

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Remove tables that no plan reads any more."""
        for name in names:
            _delete(self.spark, f"{self.root}/{name}")
