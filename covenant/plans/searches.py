"""Retrieval pipelines as queries, with their SQL: the canned questions over chunks made from embeddings and contracts.

There is no encoder without a model, so a text's vector is that of the embedding whose number is an MD5 of the text,
modulo their count: the same in both engines.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vocab
from ..operators import retrieval
from ..sources import corpus
from .registry import _ALIAS, _ASK, _BASE, _EXPAND, _any, _ordered_sql, _q, _tok, _TOLD, query

_COLLECTIONS = "list_extract(['main', 'entities', 'clauses'], (e.vec_id % 3 + 1)::int)"
_CHUNKS = f"""con AS ({corpus.CONTRACTS_DUCKDB}),
  ch AS (SELECT e.vec_id, e.embedding, {_COLLECTIONS} AS collection, 'doc' || (e.vec_id // 3 % 40) AS doc_id,
    'doc' || (e.vec_id // 3 % 40) || '_' || (e.vec_id // 3) || list_extract(['', '_entities', '_clause'], (e.vec_id % 3 + 1)::int) AS id,
    coalesce(c.text, '') AS text, 'Section ' || e.label AS header, list_extract(['rent', 'term', 'security', 'general'], (e.label % 4 + 1)::int) AS clause_type,
    coalesce(c.kind = 0, false) AS has_party, coalesce(c.kind = 4, false) AS has_dates, coalesce(c.kind = 2, false) AS has_amounts, coalesce(c.kind = 1, false) AS has_companies,
    CASE e.vec_id % 3 WHEN 1 THEN 'entities' WHEN 2 THEN 'clause' ELSE 'main' END AS search_type, NULL::int AS priority
  FROM embeddings e LEFT JOIN con c ON c.doc_id = e.vec_id)"""


def chunks(spark, sf_dir):
    rows = corpus.table(spark, sf_dir, "embeddings")
    v, base = F.col("vec_id"), F.floor(F.col("vec_id") / 3)
    pick = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), (v % 3 + 1).cast("int"))
    clause = F.element_at(F.array(*map(F.lit, ("rent", "term", "security", "general"))), F.col("label") % 4 + 1)
    held = lambda k: F.coalesce(F.col("kind") == k, F.lit(False))
    docs = corpus.contracts(spark, sf_dir).withColumnRenamed("doc_id", "vec_id")
    return rows.join(docs, "vec_id", "left").select(
        "embedding", pick("main", "entities", "clauses").alias("collection"), F.concat(F.lit("doc"), base % 40).alias("doc_id"), F.concat(F.lit("doc"), base % 40, F.lit("_"), base, pick("", "_entities", "_clause")).alias("id"),
        F.coalesce("text", F.lit("")).alias("text"), F.concat(F.lit("Section "), "label").alias("header"), clause.alias("clause_type"), held(0).alias("has_party"), held(4).alias("has_dates"),
        held(2).alias("has_amounts"), held(1).alias("has_companies"), pick("main", "entities", "clause").alias("search_type"), F.lit(None).cast("int").alias("priority"),
    )


def encoder(spark, sf_dir):
    rows = corpus.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("__v"), F.col("embedding").alias("vec"))
    n = rows.count()
    number = F.conv(F.substring(F.md5(F.col("text").cast("binary")), 1, 8), 16, 10).cast("bigint") % n
    return lambda asked: asked.withColumn("__v", number).join(rows, "__v").drop("__v")


def _parts(spark, sf_dir):
    return corpus.questions(spark), encoder(spark, sf_dir), chunks(spark, sf_dir)


# --- SQL ---------------------------------------------------------------------------------------------------------------


def _variants(parts: list[str], most: int | None, source: str, name: str) -> str:
    """A table (qid, n, variant) of the expansions of source (qid, question)."""
    sql = _ordered_sql(parts, most)[len(_ASK) :].replace(" FROM q", f" FROM {source}")
    return f"{name} AS ({sql})"


def _hits(variants: str, name: str, k: int) -> str:
    """Each variant's k best of each collection, boosted by the variant."""
    low = "lower(variant)"
    boost = f"""least(0.12::double, 0.02::double * len(list_intersect({_tok('variant')}, list_concat({_tok('text')}, {_tok('header')}))))
      + CASE WHEN {_any(low, vocab.FINANCIAL_WORDS)} AND clause_type IN ('rent', 'financial', 'security') THEN 0.06::double ELSE 0 END
      + CASE WHEN {_any(low, vocab.TEMPORAL_WORDS)} AND (clause_type = 'term' OR has_dates) THEN 0.06::double ELSE 0 END + CASE WHEN {_any(low, vocab.ENTITY_WORDS)} AND has_party THEN 0.07::double ELSE 0 END
      + CASE WHEN priority = 1 THEN 0.03::double ELSE 0 END"""
    return f"""{name}_v AS (SELECT v.*, e.embedding AS vec FROM {variants} v JOIN embeddings e ON e.vec_id = ('0x' || substr(md5(variant), 1, 8))::bigint % (SELECT count(*) FROM embeddings)),
  {name}_r AS (SELECT qid, n, variant, ch.* EXCLUDE (embedding), round(list_inner_product(vec::double[], embedding::double[]), 6) AS raw FROM {name}_v, ch),
  {name}_k AS (SELECT *, row_number() OVER (PARTITION BY qid, n, collection ORDER BY raw DESC, id) AS nr, CASE collection WHEN 'main' THEN 0 WHEN 'entities' THEN 1 ELSE 2 END AS place FROM {name}_r),
  {name} AS (SELECT *, {_BASE} AS base_id, round(least(1.0::double, greatest(0.0::double, least(raw, 1.0::double)) + {boost}), 6) AS score FROM {name}_k WHERE nr <= {k})"""


def _first(rows: str, key: str, name: str, k: int | None = None, order: str = "stage, n, place, id") -> str:
    """The best row of each key, ranked in rk; the first k."""
    head = f" WHERE rk <= {k}" if k else ""
    return f"""{name}_o AS (SELECT *, row_number() OVER (PARTITION BY qid, {key} ORDER BY score DESC, {order}) AS once FROM {rows}),
  {name}_a AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, {order}) AS rk FROM {name}_o WHERE once = 1), {name} AS (SELECT * EXCLUDE (once) FROM {name}_a{head})"""


_SIDED = "(collection = 'main' AND nr <= 8) OR (collection <> 'main' AND nr <= 4)"


def _comprehensive(source: str, name: str, k: int) -> str:
    return ",\n  ".join([_variants(_EXPAND, 10, source, f"{name}_x"), _hits(f"{name}_x", f"{name}_h", 8), f"{name}_s AS (SELECT *, 1 AS stage FROM {name}_h WHERE {_SIDED})", _first(f"{name}_s", "id", name, k)])


def _entities(source: str, name: str, k: int) -> str:
    prompts = ["question", "'entities and parties: ' || question", "'companies and parties: ' || question", "'lessor and lessee: ' || question"]
    sided = f"(collection = 'main' AND nr <= {k}) OR (collection = 'entities' AND nr <= {2 * k})"
    return ",\n  ".join([_variants(prompts, None, source, f"{name}_x"), _hits(f"{name}_x", f"{name}_h", 2 * k), f"{name}_s AS (SELECT *, 1 AS stage FROM {name}_h WHERE {sided})", _first(f"{name}_s", "id", name, k)])


_HEAD = _ASK.rstrip() + ", " + _CHUNKS + ",\n  "


@query(_HEAD + _comprehensive("q", "c", 12) + " SELECT qid, rk AS rank, id, score FROM c")
def comprehensive_search(spark, sf_dir):
    return retrieval.comprehensive(*_parts(spark, sf_dir), 12).select("qid", "rank", "id", "score")


@query(_HEAD + _entities("q", "c", 8) + " SELECT qid, rk AS rank, id, score FROM c")
def entity_search(spark, sf_dir):
    return retrieval.entities_focused(*_parts(spark, sf_dir), 8).select("qid", "rank", "id", "score")


def _hybrid(k: int) -> str:
    most = max(k, 8)
    return _HEAD + ",\n  ".join([
        _variants(_EXPAND, 10, "q", "x"), _hits("x", "h", most),
        f"""s AS (SELECT h.*, 0 AS stage FROM h JOIN q USING (qid) WHERE collection = 'entities' AND n <= 4 AND nr <= {most} AND {_any('lower(question)', vocab.ENTITY_WORDS)}
          UNION ALL SELECT *, 1 FROM h WHERE (collection = 'main' AND nr <= 8) OR (collection = 'clauses' AND nr <= 4))""",
        _first("s", "base_id", "m"),
        f"need AS (SELECT qid, {max(k, 6)} - count(*) AS need FROM m GROUP BY qid)",
        """e AS (SELECT h.*, need, row_number() OVER (PARTITION BY qid, base_id ORDER BY n, score DESC, id) AS once FROM h JOIN need USING (qid)
          WHERE collection = 'main' AND nr <= need AND NOT EXISTS (SELECT 1 FROM m WHERE m.qid = h.qid AND m.base_id = h.base_id))""",
        "t AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY n, score DESC, id) AS turn FROM e WHERE once = 1)",
        "a AS (SELECT * EXCLUDE (rk) FROM m UNION ALL SELECT * EXCLUDE (need, once, turn), 2 AS stage FROM t WHERE turn <= need)",
        _first("a", "base_id", "f"),
        f"d AS (SELECT *, count(*) OVER (PARTITION BY qid) AS all_n, row_number() OVER (PARTITION BY qid, doc_id, header, clause_type ORDER BY rk) AS g FROM f)",
        f"p AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rk) AS rank FROM d WHERE all_n <= {2 * k} OR g <= 2)",
    ]) + f" SELECT qid, rank, id, score FROM p WHERE rank <= {k}"


@query(_hybrid(12))
def hybrid_search(spark, sf_dir):
    return retrieval.hybrid(*_parts(spark, sf_dir), 12).select("qid", "rank", "id", "score")


@query(_hybrid(90))
def hybrid_search_topped_up(spark, sf_dir):
    """With more hits wanted than the variants bring, so that main fills up."""
    return retrieval.hybrid(*_parts(spark, sf_dir), 90).select("qid", "rank", "id", "score")


# older search: the first variant to find an id gives its score
_OLD = ["question"] + [
    f"CASE WHEN contains(lower(question), {_q(key)}) AND NOT contains(lower(question), {_q(a)}) THEN replace(lower(question), {_q(key)}, {_q(a)}) END" for key, alts in vocab.OLD_SYNONYMS.items() for a in alts
]
_OLD += ["'entities and parties: ' || question", "'contract details: ' || question", "CASE WHEN NOT ends_with(question, '?') THEN question || '?' END"]
_LISTS = "NOT contains(lower(question), 'how many') AND (contains(lower(question), 'companies') OR contains(lower(question), 'parties'))"
_OLD += [f"CASE WHEN {_LISTS} THEN '{p} ' || question END" for p in ("how many", "list all", "count of")]


@query(_ordered_sql(_OLD, None, _TOLD))
def query_expand_legacy(spark, sf_dir):
    from ..operators import analyze
    from .registry import _numbered

    return _numbered(corpus.asked(spark, sf_dir).select("qid", analyze.expanded_old(F.col("question")).alias("v")))


def _found(source: str, collection: str, name: str, k: int) -> str:
    return f"""{name}_k AS (SELECT *, row_number() OVER (PARTITION BY qid, n ORDER BY raw DESC, id) AS nr FROM {source}_r WHERE collection = '{collection}'),
  {name}_o AS (SELECT *, row_number() OVER (PARTITION BY qid, id ORDER BY n) AS once FROM {name}_k WHERE nr <= {min(2 * k, 100)}),
  {name}_s AS (SELECT *, round(1 / (1 + greatest(1 - raw, 0.0::double)), 6) AS old FROM {name}_o WHERE once = 1),
  {name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY old DESC, n, id) AS rk FROM {name}_s) WHERE rk <= {k})"""


_WHO = ["company", "companies", "party", "parties", "who", "lessor", "lessee"]
_ASKS = _any("low", ["company", "companies", "parties", "who", "lessor", "lessee"])
_COUNTS = _any("low", ["how many", "count", "number", "list"])
_INTENT_BOOST = (
    f"CASE WHEN {_ASKS} AND has_party THEN 0.3::double ELSE 0 END + CASE WHEN {_ASKS} AND search_type = 'entities' THEN 0.2::double ELSE 0 END"
    f" + CASE WHEN {_COUNTS} AND {_any('lower(text)', ['entities', 'parties'])} THEN 0.25::double ELSE 0 END + CASE WHEN {_COUNTS} AND has_companies THEN 0.2::double ELSE 0 END"
    + "".join(f" + CASE WHEN contains(low, '{w}') AND clause_type = '{w}' THEN 0.3::double ELSE 0 END + CASE WHEN contains(low, '{w}') AND contains(lower(text), '{w}') THEN 0.1::double ELSE 0 END" for w in ("rent", "term", "maintenance", "security", "termination"))
)


@query(_HEAD + ",\n  ".join([_variants(_OLD, None, "q", "x"), _hits("x", "h", 1), _found("h", "main", "m", 24), _found("h", "entities", "e", 12), _found("h", "clauses", "c", 12)])
       + f""", u AS (SELECT *, 0 AS place FROM m UNION ALL SELECT *, 1 FROM e UNION ALL SELECT *, 2 FROM c),
  j AS (SELECT u.*, lower(question) AS low FROM u JOIN q USING (qid) WHERE collection <> 'entities' OR {_any('lower(question)', _WHO)}),
  b AS (SELECT *, round(least(1.0::double, old + {_INTENT_BOOST}), 6) AS score FROM j)
  SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, -old, place, id) AS rank, id, score FROM b""".replace("-old", "-(-old)").replace("-(-old)", "-old"))
def legacy_candidates(spark, sf_dir):
    """The older pipeline before it is thinned: every candidate with its boosted score."""
    return retrieval.old_candidates(*_parts(spark, sf_dir), 12).select("qid", "rank", "id", "score")


@query()
def legacy_comprehensive(spark, sf_dir):
    return retrieval.old_comprehensive(*_parts(spark, sf_dir), 12)


@query()
def legacy_search(spark, sf_dir):
    return retrieval.legacy(*_parts(spark, sf_dir), 8)


_OLD_PROMPTS = ["question", "'companies and parties: ' || question", "'entities mentioned: ' || question", "'lessor and lessee: ' || question"]


@query(_HEAD + ",\n  ".join([_variants(_OLD_PROMPTS, None, "q", "x"), _hits("x", "h", 1), _found("h", "entities", "e", 16), _found("h", "main", "m", 8)])
       + " SELECT * FROM (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY old DESC, collection, id) AS rank, id, old AS score FROM (SELECT * FROM e UNION ALL SELECT * FROM m)) WHERE rank <= 8")
def legacy_entity_search(spark, sf_dir):
    return retrieval.old_entities(*_parts(spark, sf_dir), 8).select("qid", "rank", "id", "score")


_RERANK = (
    f"CASE WHEN priority = 1 THEN 0.05::double ELSE 0 END + CASE WHEN {_any('low', vocab.RERANK_MONEY)} AND clause_type IN ('rent', 'financial', 'security') THEN 0.05::double ELSE 0 END + CASE WHEN {_any('low', vocab.RERANK_MONEY)} AND has_amounts THEN 0.05::double ELSE 0 END"
    f" + CASE WHEN {_any('low', vocab.RERANK_TERM)} AND clause_type = 'term' THEN 0.05::double ELSE 0 END + CASE WHEN {_any('low', vocab.RERANK_TERM)} AND has_dates THEN 0.05::double ELSE 0 END"
    f" + CASE WHEN {_any('low', _WHO)} AND has_party THEN 0.06::double ELSE 0 END + CASE WHEN {_any('low', _WHO)} AND search_type = 'entities' THEN 0.04::double ELSE 0 END"
)


def _reranked(rows: str, name: str) -> str:
    return f"""{name}_j AS (SELECT r.* EXCLUDE (score), r.score AS was, lower(question) AS low, count(*) OVER (PARTITION BY qid) AS all_n FROM {rows} r JOIN q USING (qid)),
  {name}_b AS (SELECT *, CASE WHEN all_n > 3 THEN round(least(1.0::double, was + {_RERANK}), 6) ELSE was END AS score FROM {name}_j),
  {name} AS (SELECT * EXCLUDE (was, low, all_n, rk), row_number() OVER (PARTITION BY qid ORDER BY score DESC, rk) AS rk FROM {name}_b)"""


def _missing(ranked: str, name: str) -> str:
    (_, dated, date_queries), (_, paid, money_queries) = vocab.MISSING
    lists = f"""list_concat(CASE WHEN {_any('lower(question)', dated)} AND NOT dates THEN [{', '.join(map(_q, date_queries))}] ELSE [] END, CASE WHEN {_any('lower(question)', paid)} AND NOT amounts THEN [{', '.join(map(_q, money_queries))}] ELSE [] END)"""
    return f"""{name}_s AS (SELECT qid, bool_or(has_dates) AS dates, bool_or(has_amounts) AS amounts FROM {ranked} WHERE rk <= 8 GROUP BY qid),
  {name}_l AS (SELECT qid, {lists} AS more FROM {name}_s JOIN q USING (qid)), {name} AS (SELECT qid, unnest(range(1, len(more) + 1)) AS n, unnest(more) AS question FROM {name}_l)"""


@query(_HEAD + ",\n  ".join([_comprehensive("q", "c", 12), _reranked("c", "r")]) + " SELECT qid, rk AS rank, id, score FROM r")
def llm_free_rerank(spark, sf_dir):
    asked, encode, rows = _parts(spark, sf_dir)
    return retrieval.reranked(retrieval.comprehensive(asked, encode, rows, 12), asked).select("qid", "rank", "id", "score")


@query(_HEAD + ",\n  ".join([_comprehensive("q", "c", 3), _missing("c", "m")]) + " SELECT qid, n, question FROM m")
def missing_information(spark, sf_dir):
    asked, encode, rows = _parts(spark, sf_dir)
    return retrieval.missing(asked, retrieval.comprehensive(asked, encode, rows, 3))


_GATE = f"({_any('lower(question)', ['compan', 'part', 'who'])} OR {_any('lower(question)', vocab.HEURISTIC_INTENTS[0][1])})"


def _enterprise(k: int) -> str:
    return _HEAD + ",\n  ".join([
        f"ge AS (SELECT * FROM q WHERE {_GATE})", _entities("ge", "en", max(4, k // 2)),
        _variants(_ALIAS, None, "q", "al"), "sub AS (SELECT qid * 100 + n AS qid, variant AS question FROM al WHERE n <= 6)", _comprehensive("sub", "cb", max(6, k // 3)),
        "u AS (SELECT qid, id, base_id, score, rk, 0::bigint AS turn, clause_type, has_party, has_dates, has_amounts, search_type, priority FROM en UNION ALL SELECT qid // 100, id, base_id, score, rk, (qid % 100)::bigint, clause_type, has_party, has_dates, has_amounts, search_type, priority FROM cb)",
        "u2 AS (SELECT * RENAME (rk AS old_rank) FROM u)", _first("u2", "base_id", "top", 2 * k, "turn, old_rank, id"), _reranked("top", "rr"), f"fin AS (SELECT * FROM rr WHERE rk <= {k})",
        _missing("fin", "mi"), "sub2 AS (SELECT qid * 100 + n AS qid, question FROM mi WHERE n <= 3)", _comprehensive("sub2", "cf", max(4, k // 4)),
        "fo AS (SELECT qid // 100 AS qid, (qid % 100)::bigint AS turn, rk AS old_rank, id, base_id, score FROM cf WHERE NOT EXISTS (SELECT 1 FROM fin WHERE fin.qid = cf.qid // 100 AND fin.id = cf.id))",
        "al2 AS (SELECT qid, (-1)::bigint AS turn, rk AS old_rank, id, base_id, score FROM fin UNION ALL SELECT * FROM fo)", _first("al2", "base_id", "res", k, "turn, old_rank, id"),
    ]) + " SELECT qid, rk AS rank, id, score FROM res"


@query(_enterprise(15))
def enterprise_search(spark, sf_dir):
    return retrieval.enterprise(*_parts(spark, sf_dir), 15).select("qid", "rank", "id", "score")


@query(_HEAD + ",\n  ".join([_comprehensive("q", "c", 6), "c2 AS (SELECT * RENAME (rk AS old_rank) FROM c)", _first("c2", "base_id", "m", 12, "old_rank, id")]) + " SELECT qid, rk AS rank, id, score FROM m")
def multi_hop_search(spark, sf_dir):
    return retrieval.multi_hop(*_parts(spark, sf_dir), 12).select("qid", "rank", "id", "score")




@query(_HEAD + ",\n  ".join([
    _comprehensive("q", "c", 6), _missing("c", "mi"), "sub AS (SELECT qid * 100 + n AS qid, question FROM mi)", _comprehensive("sub", "cf", 6),
    "u AS (SELECT qid, id, base_id, score, 0 AS hop, 1 AS turn, rk AS old_rank FROM c UNION ALL SELECT qid // 100, id, base_id, score, 1, qid % 100, rk FROM cf)", _first("u", "base_id", "m", 12, "hop, turn, old_rank, id"),
]) + " SELECT qid, rk AS rank, id, score FROM m")
def multi_hop_followed(spark, sf_dir):
    """Hops that ask on for what the hits before have missing; the third hop would repeat the second's searches and isn't made."""
    return retrieval.multi_hop(*_parts(spark, sf_dir), 12, follow=retrieval.missing).select("qid", "rank", "id", "score")
