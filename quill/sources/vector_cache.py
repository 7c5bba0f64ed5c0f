"""Vectors of texts by digest and model, stored in buckets of the digest, so that a lookup never moves the stored side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quill.sources.shared import checkpoint

SCHEMA = "digest string, vec array<float>, model string"
#: Buckets of a new cache: as many as shuffle partitions at least, or a lookup's plan may prefer to move both sides.
BUCKETS = 64


class VectorCache:
    """A bucketed table of the catalog. A digest that is put twice at once may be there twice; lookups give one."""

    def __init__(self, spark: SparkSession, table: str, buckets: int | None = None):
        self.spark, self.table = spark, table
        if not spark.catalog.tableExists(table):
            n = buckets or max(BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")))
            spark.createDataFrame([], SCHEMA).write.bucketBy(n, "digest").sortBy("digest").saveAsTable(table)

    def _of(self, model: str) -> DataFrame:
        return self.spark.read.table(self.table).where(F.col("model") == model).select("digest", "vec")

    def lookup(self, digests: DataFrame, model: str) -> DataFrame:
        """(digest, vec) of those of the digests (column digest) that are there; null digests are not."""
        wanted = digests.select("digest").where(F.col("digest").isNotNull()).distinct()
        return self._of(model).join(wanted, "digest", "left_semi").groupBy("digest").agg(F.first("vec").alias("vec"))

    def put(self, vectors: DataFrame, model: str) -> int:
        """Add vectors (digest, vec) whose digests are new, one each; how many. A second call adds none."""
        rows = vectors.where(F.col("digest").isNotNull() & F.col("vec").isNotNull()).groupBy("digest").agg(F.min("vec").alias("vec"))
        rows = checkpoint(rows.join(self._of(model).select("digest"), "digest", "left_anti").select("digest", F.col("vec").cast("array<float>").alias("vec"), F.lit(model).alias("model")))
        rows.write.mode("append").insertInto(self.table)
        self.spark.catalog.refreshTable(self.table)
        return rows.count()
