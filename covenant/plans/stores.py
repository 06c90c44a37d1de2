"""Queries over what is stored: an index of vectors, a store that is merged into, metadata filters."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from ..functions import where
from ..operators import enrich, ivf, vectors
from ..sources import corpus, store
from .registry import _searches, _topk_sql, query

# --- Inverted-file index -----------------------------------------------------------------------------------------------

NLIST, NPROBE, ROUNDS = 16, 12, 2
_FIT = f"""WITH f AS MATERIALIZED (SELECT vec_id, embedding, list_transform(embedding, lambda x: floor({ivf.SCALE} * x::double)::bigint) AS v FROM embeddings),
  s AS (SELECT *, row_number() OVER (ORDER BY md5(vec_id::varchar), vec_id) AS nr FROM f), c0 AS MATERIALIZED (SELECT nr - 1 AS cell, v AS c FROM s WHERE nr <= {NLIST})"""
_APART = "list_sum(list_transform(list_zip(v, c), lambda z: ((z[1] - z[2]) * (z[1] - z[2]))::hugeint))"


def _near(rows: str, centres: str, n: int) -> str:
    """rows with the n nearest centres each, in nr."""
    return f"SELECT * FROM (SELECT r.*, cell, row_number() OVER (PARTITION BY vec_id ORDER BY {_APART}, cell) AS place FROM {rows} r, {centres}) WHERE place <= {n}"


def _round(k: int) -> str:
    return f"""n{k} AS MATERIALIZED ({_near(f'(SELECT vec_id, v FROM s WHERE nr <= {ivf.SAMPLE_ROWS})', f'c{k}', 1)}),
  t{k} AS (SELECT cell, dim, sum(x)::bigint AS total, count(*) AS n FROM (SELECT cell, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS dim FROM n{k}) GROUP BY 1, 2),
  m{k} AS (SELECT cell, list((total - ((total % n) + n) % n) // n ORDER BY dim) AS m FROM t{k} GROUP BY 1),
  c{k + 1} AS MATERIALIZED (SELECT cell, coalesce(m, c) AS c FROM c{k} LEFT JOIN m{k} USING (cell))"""


_IVF = ",\n  ".join([
    _FIT, *[_round(k) for k in range(ROUNDS)], f"w AS MATERIALIZED ({_near('(SELECT vec_id, v, embedding FROM f)', f'c{ROUNDS}', 1)})",
    f"p AS ({_near('(SELECT vec_id, v, embedding FROM f WHERE vec_id % 50 = 0)', f'c{ROUNDS}', NPROBE)})",
    """r AS (SELECT p.vec_id AS qid, w.vec_id, round(list_inner_product(p.embedding::double[], w.embedding::double[]), 6) AS score FROM p JOIN w USING (cell)),
  hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM r) WHERE rank <= 10)""",
])


@query(_IVF + " SELECT qid, vec_id, score, rank FROM hits")
def vec_ivf_topk(spark, sf_dir):
    """Ten best of each query in its nearest cells."""
    asked, rows = _searches(spark, sf_dir)
    return ivf.search(ivf.build(rows, NLIST, rounds=ROUNDS), asked, 10, NPROBE)


@query(_IVF + f""", e AS ({_topk_sql(10)}) SELECT round(count(h.qid) / count(*)::double, 6) AS recall FROM e LEFT JOIN hits h USING (qid, vec_id)""")
def vec_ivf_recall(spark, sf_dir):
    """What share of the exact search's ten best the index finds, over all queries."""
    asked, rows = _searches(spark, sf_dir)
    return ivf.recall(ivf.search(ivf.build(rows, NLIST, rounds=ROUNDS), asked, 10, NPROBE), vectors.top_k(asked, rows, 10))


# --- Store that is merged into -----------------------------------------------------------------------------------------


def _folder(spark, name: str) -> str:
    """A new folder where driver and executors see it."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.gettempdir()}"
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("""SELECT id, total, seq FROM (SELECT 'c' || o_custkey AS id, o_totalprice AS total, o_orderkey AS seq, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS nr FROM orders) WHERE nr = 1""")
def upsert_merge(spark, sf_dir):
    """Each customer's last order, by merging three overlapping deliveries, the last one twice."""
    orders = corpus.table(spark, sf_dir, "orders")
    rows = orders.select(F.concat(F.lit("c"), "o_custkey").alias("id"), F.col("o_totalprice").alias("total"), F.col("o_orderkey").alias("seq"))
    path = _folder(spark, "store")
    store.create(spark, path, buckets=16)
    for part in ("seq % 3 <> 0", "seq % 3 <> 1", "seq % 2 = 0", "seq % 2 = 0"):
        store.merge(rows.where(part), path)
    return store.read(spark, path)


# --- Metadata filters --------------------------------------------------------------------------------------------------

WHERE = {"$and": [{"label": {"$in": [1, 2, 3, 4]}}, {"$or": [{"page": {"$gte": 12}}, {"kind": "odd"}]}, {"draft": {"$ne": True}}, {"$not": {"page": 3}}]}


@query(_topk_sql(8, "b.label IN (1, 2, 3, 4) AND (b.vec_id % 20 >= 12 OR b.vec_id % 2 = 1) AND b.vec_id % 5 <> 0 AND b.vec_id % 20 <> 3"))
def vec_where_topk(spark, sf_dir):
    """A nested filter over each vector's JSON metadata, before the search."""
    asked, rows = _searches(spark, sf_dir)
    v = F.col("vec_id")
    facts = F.struct(F.col("label"), (v % 20).alias("page"), F.when(v % 2 == 1, "odd").otherwise("even").alias("kind"), F.when(v % 5 == 0, True).alias("draft"))
    held = rows.withColumn("metadata", enrich.metadata_map(F.to_json(facts)))
    return vectors.top_k(asked, held, 8, where.compiled(WHERE, where.in_map(F.col("metadata"))))


_FILTER = {"$or": [{"event_type": {"$in": ["click", "view"]}}, {"value": {"$gt": 50}}], "user_id": {"$lt": 500}}


@query("SELECT event_type, count(*) AS n, round(sum(value::decimal(38, 6))::double, 4) AS total FROM events WHERE (event_type IN ('click', 'view') OR value > 50) AND user_id < 500 GROUP BY event_type")
def where_columns(spark, sf_dir):
    """The same kind of filter over columns, where the scan takes it."""
    events = corpus.table(spark, sf_dir, "events")
    fields = where.in_columns(event_type=F.col("event_type"), value=F.col("value"), user_id=F.col("user_id"))
    rows = events.where(where.compiled(_FILTER, fields))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum(F.col("value").cast("decimal(38,6)")).cast("double"), 4).alias("total"))
