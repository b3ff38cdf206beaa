"""A collection of vectors by key: a table in versions, of which a manifest names the one that counts.

    <path>/data/<version>-<unique>/bucket=<n>/...   rows of the buckets that a version rewrote
    <path>/manifest/version=<n>/...                 one row for each bucket: where its rows are

A write puts the buckets that its keys fall into under a new folder and then commits a manifest that points to them and, for all other buckets, to where they were.
Until that file is there readers see the version before; what a write that broke off has left is never read. Two writers that start from one
version can't both commit it: the second fails and may try again.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import uuid5
from ..operators.matching import valid_vectors
from ..session import kept

#: Fixed value: the name space of points.
NAMESPACE_POINTS = "7e19dbd65e8f4c9d9e89589f0d75c001"
MANIFEST = "bucket int, folder string, size int, distance string, buckets int, batch long"


class SizeMismatch(ValueError):
    """The collection holds vectors of another size."""


class Collection:
    """Rows of ``columns`` (DDL) beside point_id, key and vector, kept by key."""

    def __init__(self, spark: SparkSession, path: str, columns: str = ""):
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = "point_id string, key string, vector array<double>" + (f", {columns}" if columns else "")

    def version(self) -> tuple[int, list] | None:
        """The last committed version and its manifest's rows, or None where there is no collection."""
        try:
            every = self.spark.read.schema(f"{MANIFEST}, version long").option("basePath", f"{self.path}/manifest").json(f"{self.path}/manifest")
            rows = every.where(F.col("version") == every.agg(F.max("version")).first()[0]).collect()  # a row for each bucket
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return None
            raise
        return (rows[0].version, rows) if rows else None

    def ensure(self, size: int, *, recreate: bool = False, buckets: int = 64) -> None:
        """Makes the collection for vectors of ``size`` numbers under cosine. One that is there stays if its size is the same, is refused if not, and
        is emptied, as a new version, if it is to be made again."""
        if size <= 0:
            raise ValueError(f"vectors of {size} numbers")
        found = self.version()
        if found and not recreate:
            if found[1][0]["size"] != size:
                raise SizeMismatch(f"{self.path} holds vectors of {found[1][0]['size']} numbers, not {size}; make it again for another model")
            return
        self._commit((found[0] if found else 0) + 1, [(b, None, size, "cosine", buckets, None) for b in range(buckets)])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of the last or a given version."""
        if version is None:
            found = self.version()
            rows = found[1] if found else []
        else:
            rows = self.spark.read.schema(MANIFEST).json(f"{self.path}/manifest/version={version}").collect()
        return self._rows(rows)

    def _rows(self, manifest: list) -> DataFrame:
        places = [f"{self.path}/data/{r.folder}/bucket={r.bucket}" for r in manifest if r.folder]
        reader = self.spark.read.schema(self.schema)
        return reader.parquet(*places) if places else self.spark.createDataFrame([], self.schema)

    def holds(self, batch: int) -> bool:
        """Whether a numbered batch, or a later one, was written."""
        found = self.version()
        return bool(found) and found[1][0]["batch"] is not None and batch <= found[1][0]["batch"]

    def upsert(self, rows: DataFrame, *, order: str | None = None, batch: int | None = None) -> bool:
        """Writes rows (key, vector, further columns) by key; of rows that share one the last in ``order`` counts, without an order any.

        A row whose key is blank or whose vector is absent, of another size or no number makes the whole write fail, before anything is visible. A numbered ``batch`` that was
        written before is left out; then, and where there are no rows, the answer is False.
        """
        found = self.version()
        if found is None:
            raise ValueError(f"there is no collection at {self.path}")
        number, manifest = found
        head = manifest[0]
        if batch is not None and head["batch"] is not None and batch <= head["batch"]:
            return False
        names = [c.split(" ")[0] for c in self.schema.split(", ")]
        new = rows.withColumn("key", F.col("key").cast("string")).withColumn("point_id", uuid5(F.col("key"), NAMESPACE_POINTS)).withColumn("vector", F.col("vector").cast("array<double>"))
        last = F.max_by(F.struct(*names[2:]), F.col(order) if order else F.lit(1))
        new = new.groupBy("point_id", "key").agg(last.alias("last"), F.count_if(F.coalesce(F.trim("key"), F.lit("")) == "").alias("blank")).select("point_id", "key", "last.*", "blank")
        bucket = F.pmod(F.xxhash64("point_id"), F.lit(head["buckets"])).cast("int")
        new = kept(valid_vectors(new, "vector", head["size"]).withColumn("bucket", bucket))
        first = F.first(F.when(F.expr("fault is not null or blank > 0"), F.struct("key", "fault")), ignorenulls=True)
        wrong, touched = new.agg(first, F.collect_set("bucket")).first()  # no more buckets than there are
        if wrong:
            raise (SizeMismatch if wrong.fault == "size" else ValueError)(f"key {wrong.key!r}: {wrong.fault or 'blank'}")
        if not touched and batch is None:
            return False
        folder = f"{number + 1}-{uuid.uuid4().hex}"
        if touched:
            old = self._rows([r for r in manifest if r.bucket in touched]).join(new.select("point_id"), "point_id", "left_anti").withColumn("bucket", bucket)
            # a bucket's rows go to one writer; the number of buckets says how many write
            merged = old.select(*names, "bucket").unionByName(new.select(*names, "bucket")).repartition(len(touched), "bucket")
            merged.write.partitionBy("bucket").parquet(f"{self.path}/data/{folder}")
        self._commit(number + 1, [(r.bucket, folder if r.bucket in touched else r.folder, r["size"], r.distance, r.buckets, batch if batch is not None else r.batch) for r in manifest])
        return bool(touched)

    def _commit(self, version: int, manifest: list[tuple]) -> None:
        """One file, renamed into place when it is whole; a version that is there already is an error."""
        self.spark.createDataFrame(manifest, MANIFEST).coalesce(1).write.mode("errorifexists").json(f"{self.path}/manifest/version={version}")
