"""A table of rows by key that is merged into: the newest row of each key stays.

Rows stand in folders by a hash of their key. A merge rewrites the folders that have new
rows and leaves all others as they are, so its cost follows what came in, and a folder
that is rewritten has no more files than its rows need. What is to be written is settled
in a staging folder first: if a merge is cut off, the same merge can be run again, and
merging the same rows twice changes nothing.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scratch import settled

BUCKETS = 64
#: Rows of a file, about.
FILE_ROWS = 500_000


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


def create(spark: SparkSession, path: str, key: str = "id", order: str = "seq", buckets: int = BUCKETS) -> None:
    """Set down a store's key, the column that tells newer rows, and its number of folders; they can't be changed later."""
    spark.createDataFrame([(key, order, buckets)], "key string, `order` string, buckets int").coalesce(1).write.mode("overwrite").json(f"{path}/_store")


def _facts(spark: SparkSession, path: str) -> tuple[str, str, int]:
    row = spark.read.schema("key string, `order` string, buckets int").json(f"{path}/_store").first()
    return row["key"], row["order"], row["buckets"]


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{path}/rows")
    except AnalysisException as none:
        if "PATH_NOT_FOUND" in str(none) or "UNABLE_TO_INFER_SCHEMA" in str(none):
            return None
        raise


def read(spark: SparkSession, path: str) -> DataFrame:
    """The store's rows, one for each key."""
    rows = _stored(spark, path)
    if rows is None:
        raise FileNotFoundError(f"nothing was merged into {path} yet")
    return rows.drop("bucket")


def merge(rows: DataFrame, path: str) -> int:
    """Merge rows into a store: of each key the row of largest order stays, the new one where even. Rows without key are left out.

    Columns are the store's; the first merge sets them. Returns how many folders were rewritten.
    """
    spark = rows.sparkSession
    key, order, buckets = _facts(spark, path)
    new = rows.where(F.col(key).isNotNull()).withColumn("bucket", _bucket(key, buckets)).withColumn("__new", F.lit(1))
    new = settled(_newest(new, key, order), "merge")
    touched = sorted(r.bucket for r in new.select("bucket").distinct().collect())  # as many as there are folders at most
    if not touched:
        return 0
    old = _stored(spark, path)
    if old is not None:
        # a filter on the folders' column: other folders aren't read
        kept = old.where(F.col("bucket").isin(touched)).withColumn("__new", F.lit(0))
        new = _newest(new.unionByName(kept), key, order)
    out = settled(new.drop("__new"), "merged")
    files = out.groupBy("bucket").agg(F.ceil(F.count("*") / FILE_ROWS).alias("__files"))
    dealt = out.join(F.broadcast(files), "bucket").withColumn("__file", F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("file")), "__files"))  # a row for each folder
    dealt.repartition("bucket", "__file").drop("__file", "__files").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{path}/rows")
    return len(touched)


def _newest(rows: DataFrame, key: str, order: str) -> DataFrame:
    others = [c for c in rows.columns if c not in (key, "bucket")]
    best = F.max_by(F.struct(*others), F.struct(F.col(order), F.col("__new"), F.to_json(F.struct(*[c for c in others if c != "__new"]))))
    return rows.groupBy("bucket", key).agg(best.alias("__r")).select("bucket", key, "__r.*")
