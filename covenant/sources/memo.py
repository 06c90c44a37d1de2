"""Results of searches that were made before: a table by stable key, with an age and a number of entries that it holds at most."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.scratch import settled
from . import store

#: Seconds that an entry counts, and entries that are kept.
TTL, ENTRIES = 600, 256


def key(method: str, question: Column, where: str, k: int) -> Column:
    return t.stable_key(F.lit(method), question, F.lit(where), F.lit(str(k)))


def create(spark: SparkSession, path: str) -> None:
    store.create(spark, path, "key", "at", 16)


def _entries(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return store.read(spark, path)
    except FileNotFoundError:
        return None


def remembered(asked: DataFrame, search: Callable[[DataFrame], DataFrame], path: str, now: float, method: str, k: int, where: str = "", ttl: int = TTL, entries: int = ENTRIES) -> tuple[DataFrame, int]:
    """search(asked) (qid, rank, id, score) and how many questions had to be searched: those whose result isn't known or is too old.

    asked: qid, question. A result that is used again is as new as one that was searched. What is older than ttl
    seconds, or beyond the newest entries, is no longer counted as known.
    """
    spark = asked.sparkSession
    keyed = asked.select(F.col("qid").cast("bigint").alias("qid"), "question", key(method, F.col("question"), where, k).alias("key"))
    known = _entries(spark, path)
    if known is None:
        known = spark.createDataFrame([], "key string, at double, searched double, hits array<struct<rank:bigint,id:string,score:double>>")
    known = known.where(F.col("searched") > now - ttl).orderBy(F.desc("at"), "key").limit(entries)
    known = settled(known.join(keyed.select("key").distinct(), "key", "left_semi"), "known")
    new = settled(keyed.join(known, "key", "left_anti"), "unknown")
    searched = new.count()
    if searched:
        hits = search(new.select("qid", "question")).select(F.col("qid").cast("bigint").alias("qid"), F.col("rank").cast("bigint").alias("rank"), F.col("id").cast("string").alias("id"), F.col("score").cast("double").alias("score"))
        lists = hits.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("hits"))
        none = F.array().cast("array<struct<rank:bigint,id:string,score:double>>")
        rows = new.join(lists, "qid", "left").groupBy("key").agg(F.first("hits").alias("hits"))
        known = known.unionByName(settled(rows.select("key", F.lit(float(now)).alias("at"), F.lit(float(now)).alias("searched"), F.coalesce("hits", none).alias("hits")), "searched"))
    store.merge(known.withColumn("at", F.lit(float(now))), path)
    return keyed.join(known, "key").select("qid", F.explode("hits").alias("h")).select("qid", "h.*"), searched
