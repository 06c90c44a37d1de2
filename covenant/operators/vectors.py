"""Vector operators: scores, exact top-k, maximal marginal relevance, upserts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors that go to tasks at a time; more are dealt out in blocks.
QUERY_BLOCK = 2_000
#: Vectors, and queries of a block, that a task holds against each other at a time: so many scores are in memory, whatever the tables' sizes.
VECTOR_ROWS, QUERY_ROWS = 4_096, 128


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def clamped(d: Column) -> Column:
    """Similarity held to 0..1; NaN is 0."""
    return F.when(F.isnan(d), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(d, F.lit(1.0))))


def from_distance(d: Column, hold: bool = True) -> Column:
    return 1 / (1 + (F.greatest(d, F.lit(0.0)) if hold else d))


def unit(v: Column) -> Column:
    norm = F.sqrt(dot(v, v)) + F.lit(1e-12)
    return F.transform(v, lambda x: x.cast("double") / norm)


def top_k(queries: DataFrame, vectors: DataFrame, k: int, where: Column | None = None, key: str = "vec_id", group: str | None = None) -> DataFrame:
    """qid, key, (group,) score, rank of each query's k best by inner product, in each group if there is one; ties by key.

    queries: qid (bigint), qvec; a stated set, which is searched for in blocks of QUERY_BLOCK. where filters before the
    search. Tasks multiply blocks and pass on the k best of VECTOR_ROWS vectors; these are cut again before the shuffle.
    """
    rows = vectors if where is None else vectors.where(where)
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    own = F.pmod(F.xxhash64("qid"), F.lit(blocks))
    found = reduce(DataFrame.unionByName, (_best_of_block(queries.where(own == b), rows, k, key, group) for b in range(blocks)))
    names = [key, group] if group else [key]
    scored = found.select("qid", *names, F.round("score", 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("qid", *names[1:]).orderBy(F.desc("score"), key))
    return scored.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= k)


def _best_of_block(queries: DataFrame, rows: DataFrame, k: int, key: str, group: str | None) -> DataFrame:
    asked = queries.select(F.col("qid").cast("bigint").alias("qid"), F.col("qvec").cast("array<double>").alias("qvec")).toPandas()
    qids, matrix = asked["qid"].to_numpy("int64"), np.stack(asked["qvec"]).T if len(asked) else np.empty((0, 0))
    names = [key, group] if group else [key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch]).sort_by(key) if len(qids) else pa.Table.from_batches([batch.slice(0, 0)])
            for value in pc.unique(table[group]).to_pylist() if group else [None]:
                part = table.filter(pc.equal(table[group], value)) if group else table
                for at in range(0, part.num_rows, VECTOR_ROWS):
                    some = part.slice(at, VECTOR_ROWS).combine_chunks()
                    held = np.stack(some["embedding"].to_numpy(zero_copy_only=False)).astype("float64")
                    for q in range(0, len(qids), QUERY_ROWS):
                        scores = held @ matrix[:, q : q + QUERY_ROWS]
                        # rows are in order of their key, and the sort keeps that order where scores are even
                        best = np.argsort(-np.round(scores, 6), axis=0, kind="stable")[:k]
                        picked = some.select(names).take(pa.array(best.T.ravel()))
                        out = [pa.array(np.repeat(qids[q : q + QUERY_ROWS], len(best))), *(picked[c].combine_chunks() for c in names), pa.array(np.take_along_axis(scores, best, 0).T.ravel())]
                        yield pa.RecordBatch.from_arrays(out, names=["qid", *names, "score"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names)
    return rows.select(*names, "embedding").where("embedding is not null").mapInArrow(run, f"qid bigint, {kinds}, score double")


def _pick(vectors: np.ndarray, query: np.ndarray, k: int, weight: float) -> list[int]:
    v = vectors / (np.linalg.norm(vectors, axis=1, keepdims=True) + 1e-12)
    q = query / (np.linalg.norm(query) + 1e-12)
    relevance, chosen, nearest = v @ q, [], None
    while len(chosen) < min(k, len(v)):
        score = relevance if nearest is None else weight * relevance - (1 - weight) * nearest
        score = np.where(np.isin(np.arange(len(v)), chosen), -np.inf, score)
        best = int(np.argmax(score))
        chosen.append(best)
        near = v @ v[best]
        nearest = near if nearest is None else np.maximum(nearest, near)
    return chosen


def mmr(pool: DataFrame, k: int, weight: float = 0.7, legacy_bound: bool = False) -> DataFrame:
    """qid, vec_id, pick: maximal marginal relevance over each query's pool (qid, qvec, vec_id, embedding, rank).

    A pool of at most k passes unchanged. legacy_bound stops at half the pool.
    """

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        want = min(k, -(-len(pdf) // 2)) if legacy_bound else k
        if len(pdf) <= want:
            order = range(len(pdf))
        else:
            order = _pick(np.stack(pdf["embedding"]).astype("float64"), np.asarray(pdf["qvec"].iloc[0], "float64"), want, weight)
        rows = pdf.iloc[list(order)]
        return pd.DataFrame({"qid": rows["qid"], "vec_id": rows["vec_id"], "pick": np.arange(1, len(rows) + 1)})

    return pool.groupBy("qid").applyInPandas(choose, "qid bigint, vec_id bigint, pick bigint")


def latest(rows: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """Upsert: the last row of each key."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return rows.withColumn("__nth", nth).where("__nth = 1").drop("__nth")
