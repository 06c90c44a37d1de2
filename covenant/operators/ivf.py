"""An inverted-file index over vectors: a coarse quantiser, a cell for each vector, search in the nearest cells.

The quantiser is fitted on a bounded sample (SAMPLE_ROWS vectors, the first by a hash of
their keys); every vector gets a cell. Components are held as integers of a fixed scale
while centres are fitted, so sums are exact and an index is the same however its rows
were partitioned. Search finds each query's nprobe nearest cells and joins on cells.
Cells and a cell's queries are cut into blocks, so that a large cell is dealt out to
several tasks and no pair of rows is ever put out. With as many probes as cells the
search is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Vectors that the quantiser is fitted on, at most.
SAMPLE_ROWS = 65_536
#: Centres are fitted on floor(SCALE * x).
SCALE = 1 << 16
#: Vectors and queries of a block.
BLOCK_ROWS, QUERY_ROWS = 1_024, 256
METRICS = ("IP", "COSINE", "L2")


@dataclass(frozen=True)
class Index:
    """centres by cell (a row each, at most nlist), the metric, and rows (cell, key, embedding and what else the vectors have)."""

    centres: np.ndarray
    metric: str
    key: str
    rows: DataFrame

    @property
    def nlist(self) -> int:
        return len(self.centres)


def _stacked(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _unit(x: np.ndarray, metric: str) -> np.ndarray:
    return x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-12) if metric == "COSINE" else x


def _fixed(x: np.ndarray, metric: str) -> np.ndarray:
    return np.floor(_unit(x, metric) * SCALE).astype(np.int64)


def _apart(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of integer rows, exact up to 2**53."""
    x, c = x.astype(np.float64), centres.astype(np.float64)
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None]


def fit(vectors: DataFrame, nlist: int, key: str = "vec_id", rounds: int = 2, metric: str = "IP", sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Centres of at most nlist cells: the first vectors by MD5 of their keys, moved to the mean of their sample vectors a few times."""
    order = F.md5(F.col(key).cast("string").cast("binary"))
    sample = vectors.where(f"embedding is not null and {key} is not null").orderBy(order, key).limit(sample_rows).select("embedding")
    first = vectors.where(f"embedding is not null and {key} is not null").orderBy(order, key).limit(nlist).select("embedding").collect()
    centres = _fixed(np.array([r.embedding for r in first], np.float64) if first else np.empty((0, 0)), metric)

    def moved(centres: np.ndarray) -> np.ndarray:
        size = centres.shape[1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(centres), size + 1), np.int64)
            for batch in batches:
                if batch.num_rows:
                    x = _fixed(_stacked(batch["embedding"]), metric)
                    np.add.at(total, _apart(x, centres).argmin(axis=1), np.hstack([x, np.ones((len(x), 1), np.int64)]))
            cell, at = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(at), pa.array(total[cell, at])], names=["cell", "at", "n"])

        total = np.zeros((len(centres), size + 1), np.int64)
        for r in sample.mapInArrow(run, "cell bigint, at bigint, n bigint").groupBy("cell", "at").agg(F.sum("n").alias("n")).collect():
            total[r.cell, r.at] = r.n
        out, some = centres.copy(), total[:, size] > 0
        out[some] = total[some, :size] // total[some, size:]
        return out

    for _ in range(rounds if len(centres) else 0):
        centres = moved(centres)
    return centres


def build(vectors: DataFrame, nlist: int, key: str = "vec_id", rounds: int = 2, metric: str = "IP", sample_rows: int = SAMPLE_ROWS) -> Index:
    """Every vector with its cell. Vectors that are null have none."""
    if metric not in METRICS:
        raise ValueError(f"metric is one of {', '.join(METRICS)}")
    centres = fit(vectors, nlist, key, rounds, metric, sample_rows)
    there = vectors.where("embedding is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell = _apart(_fixed(_stacked(batch["embedding"]), metric), centres).argmin(axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(cell), *batch.columns], names=["cell", *batch.schema.names])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in there.schema)
    return Index(centres, metric, key, there.mapInArrow(run, f"cell int, {kinds}"))


def save(index: Index, path: str) -> None:
    """Rows in a folder for each cell, so that a search reads the cells it looks at, and the centres beside them."""
    spark = index.rows.sparkSession
    index.rows.repartition("cell", F.pmod(F.xxhash64(index.key), F.lit(8))).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
    facts = [(k, c.tolist(), index.metric, index.key) for k, c in enumerate(index.centres)]
    spark.createDataFrame(facts, "cell int, centre array<bigint>, metric string, key string").write.mode("overwrite").parquet(f"{path}/centres")


def load(spark: SparkSession, path: str) -> Index:
    """The index as it was saved; its metric and key come with it."""
    facts = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()
    return Index(np.array([r.centre for r in facts], np.int64), facts[0].metric, facts[0].key, spark.read.parquet(f"{path}/rows"))


def probes(index: Index, queries: DataFrame, nprobe: int) -> DataFrame:
    """qid, qvec, cell: the cells nearest to each query, ties to the smaller cell."""
    centres, metric = index.centres, index.metric

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and len(centres):
                near = np.argsort(_apart(_fixed(_stacked(batch["qvec"]), metric), centres), axis=1, kind="stable")[:, :nprobe]
                own = np.repeat(np.arange(batch.num_rows), near.shape[1])
                yield pa.RecordBatch.from_arrays([batch["qid"].take(pa.array(own)), batch["qvec"].take(pa.array(own)), pa.array(near.ravel().astype(np.int32))], names=["qid", "qvec", "cell"])

    rows = queries.where("qvec is not null").select(F.col("qid").cast("bigint").alias("qid"), F.col("qvec").cast("array<double>").alias("qvec"))
    return rows.mapInArrow(run, "qid bigint, qvec array<double>, cell int")


def _blocks(rows: DataFrame, name: str, vector: str, size: int, prefix: str) -> DataFrame:
    """cell and arrays of at most about `size` rows of a cell each: large cells are cut by a hash of the rows' names."""
    counts = rows.groupBy("cell").agg(F.ceil(F.count("*") / size).cast("int").alias("__parts"))
    dealt = rows.join(counts, "cell").withColumn("__part", F.pmod(F.xxhash64(name), F.col("__parts")))
    return dealt.groupBy("cell", "__part").agg(F.collect_list(F.struct(F.col(name).alias("name"), F.col(vector).cast("array<double>").alias("vec"))).alias("s")).select(
        "cell", F.col("s.name").alias(f"{prefix}names"), F.flatten("s.vec").alias(f"{prefix}data")
    )


def search(index: Index, queries: DataFrame, k: int, nprobe: int) -> DataFrame:
    """qid, key, score, rank: each query's k best among the vectors of its nprobe nearest cells; ties by key.

    The score is the inner product, the cosine, or for L2 the distance with its sign turned.
    """
    metric, key = index.metric, index.key
    asked = _blocks(probes(index, queries, min(nprobe, max(1, index.nlist))), "qid", "qvec", QUERY_ROWS, "q_")
    looked = index.rows.select("cell", key, "embedding").join(F.broadcast(asked.select("cell").distinct()), "cell", "left_semi")  # at most nlist rows
    held = _blocks(looked, key, "embedding", BLOCK_ROWS, "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                qids, names = (batch[c][i].values for c in ("q_names", "names"))
                q, x = (_unit(batch[c][i].values.to_numpy(zero_copy_only=False).reshape(len(n), -1), metric) for c, n in (("q_data", qids), ("data", names)))
                scores = q @ x.T
                if metric == "L2":
                    scores = -np.sqrt(np.maximum(0, (q * q).sum(axis=1)[:, None] - 2 * scores + (x * x).sum(axis=1)[None]))
                scores = np.round(scores, 6)
                best = np.lexsort((np.broadcast_to(np.argsort(np.argsort(names.to_numpy(zero_copy_only=False))), scores.shape), -scores), axis=1)[:, :k]
                own = np.repeat(np.arange(len(qids)), best.shape[1])
                yield pa.RecordBatch.from_arrays([qids.take(pa.array(own)), names.take(pa.array(best.ravel())), pa.array(scores[own, best.ravel()])], names=["qid", key, "score"])

    kind = index.rows.schema[key].dataType.simpleString()
    found = asked.join(held, "cell").select("q_names", "q_data", "names", "data").mapInArrow(run, f"qid bigint, {key} {kind}, score double")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), key))
    return found.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame, key: str = "vec_id") -> DataFrame:
    """recall: the share of the exact search's (qid, key) that was found."""
    both = exact.select("qid", key).join(found.select("qid", key, F.lit(1).alias("hit")), ["qid", key], "left")
    return both.agg(F.round(F.count("hit") / F.count("*"), 6).alias("recall"))
