"""The session settings that all operators assume, and steps that outlive executors."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "tallgrass", **conf: str) -> SparkSession:
    """UTC, adaptive execution, and maps whose later keys win (right-biased merges)."""
    fixed = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    }
    return SparkSession.builder.appName(app).config(map=fixed | {k.replace("__", "."): v for k, v in conf.items()}).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only a local master may have it unset; a temporary folder is set then."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tallgrass-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """``df``, computed and written to the shared folder: later steps don't depend on executors that made it."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


class Steps:
    """Tables between the steps of an operator, as compressed Parquet in the shared folder. What isn't dropped is removed when the driver ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        atexit.register(self.close)

    def put(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._paths = [path]
        return out

    def union(self, tables: list[DataFrame]) -> DataFrame:
        """Tables of ``put`` as one."""
        paths = [p for t in tables for p in t._paths]
        out = self.spark.read.schema(tables[0].schema).parquet(*paths)
        out._paths = paths
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Frees tables that no later step reads, and the shuffle files of steps that are done: Spark removes those when the driver's garbage is collected."""
        for path in [p for t in tables for p in t._paths]:
            self._delete(path)
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def close(self) -> None:
        try:
            self._delete(self.root)
        except Exception as e:  # the JVM may be gone by now; the folder is temporary anyway
            if self.spark.sparkContext._jsc is not None and "Connection" not in str(e):
                raise

    def _delete(self, path: str) -> None:
        sc = self.spark.sparkContext
        if sc._jsc is not None:
            at = sc._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
