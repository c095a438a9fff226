"""Tables of which a batch rewrites only the buckets it touches.

Rows lie in one folder per hash bucket of a key that is unique in the table. An upsert reads the buckets that the
batch has keys in, folds them, and puts them back by dynamic partition overwrite; all other files stay as they are.
The number of buckets is fixed when the table is laid out, so that a bucket is a file or a few.

An upsert has a name, such as the number of its micro-batch. What it folds is written beside the table and marked
before a bucket is replaced, so an upsert that is run again after a failure copies what was folded before and
doesn't fold its own result a second time.

Defined results: rows without a key share a bucket; a batch without rows changes nothing; columns besides those of
the table are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from fleetsight.session import prepare
from fleetsight.sources.tables import empty

BUCKETS = 64


class BucketTable:
    def __init__(self, spark: SparkSession, folder: str, name: str, key: str = "id", buckets: int = BUCKETS) -> None:
        self.spark, self.key, self.buckets = prepare(spark), key, buckets
        self.path, self.staged, self.mark = f"{folder}/{name}", f"{folder}/_staged/{name}", f"{folder}/_staged/{name}-of"
        self.schema = empty(spark, name).schema
        self.placed_schema = StructType([*self.schema.fields, StructField("bucket", IntegerType())])
        # So that a table without rows can be read.
        self._placed(empty(spark, name)).write.mode("append").partitionBy("bucket").parquet(self.path)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int")

    def _placed(self, rows: DataFrame) -> DataFrame:
        return rows.select(*self.schema.names, self._bucket().alias("bucket"))

    def _files(self, path: str) -> DataFrame:
        return self.spark.read.schema(self.placed_schema).parquet(path)

    def read(self) -> DataFrame:
        return self._files(self.path).select(*self.schema.names)

    def touched(self, keys: DataFrame) -> list[int]:
        """The buckets of the keys: ``buckets`` numbers at most."""
        return sorted(row["bucket"] for row in keys.select(self._bucket().alias("bucket")).distinct().collect())

    def read_buckets(self, numbers: list[int]) -> DataFrame:
        """Rows of some buckets; the files of others aren't read."""
        return self._files(self.path).filter(F.col("bucket").isin(numbers)).select(*self.schema.names)

    def _is_staged(self, run: str) -> bool:
        try:
            return not self.spark.read.schema("run string").parquet(self.mark).filter(F.col("run") == run).isEmpty()
        except AnalysisException:
            return False

    def upsert(self, keys: DataFrame, fold: Callable[[DataFrame], DataFrame], run: str) -> None:
        """The buckets of ``keys`` hold what ``fold`` makes of their rows. ``fold`` returns rows of these buckets only."""
        if not self._is_staged(run):
            numbers = self.touched(keys)
            if not numbers:
                return
            folded = self._placed(fold(self.read_buckets(numbers))).repartition("bucket")
            folded.write.mode("overwrite").partitionBy("bucket").parquet(self.staged)
            self.spark.range(1).coalesce(1).select(F.lit(run).alias("run")).write.mode("overwrite").parquet(self.mark)
        writer = self._files(self.staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("bucket").parquet(self.path)
