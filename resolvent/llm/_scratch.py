"""Tables cut out of the lineage, in the folder that all executors share.

Spark names that folder in ``spark.checkpoint.dir``.  A written table survives
lost executors, which ``localCheckpoint`` does not.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of an Arrow batch between the JVM and Python; whichever is reached first ends it.
#: Rows may hold long texts or sets.  Set in the session where it says nothing, since results are lazy and run later.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8MB"}
_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where it is unset (local tests)."""
    said = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if said:
        return said.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="resolvent-")
        atexit.register(shutil.rmtree, _own["dir"], ignore_errors=True)
    return "file://" + _own["dir"]


class Scratch:
    """Writes intermediate tables as Parquet and reads them again."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        self.n = 0
        for key, value in BATCH.items():
            if spark.conf.get(key, None) is None:
                spark.conf.set(key, value)

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def cut(self, df: DataFrame, name: str = "t") -> DataFrame:
        """``df`` written and read again."""
        to = self.path(name)
        df.write.parquet(to)
        out = self.spark.read.schema(df.schema).parquet(to)
        self.paths[id(out)] = to
        return out

    def forget(self, df: DataFrame) -> None:
        """Delete a table that no later step reads."""
        if to := self.paths.pop(id(df), None):
            p = self.spark._jvm.org.apache.hadoop.fs.Path(to)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
