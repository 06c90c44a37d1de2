"""Retrieval pipelines over three collections (main, entities, clauses), for all questions at once.

asked: qid, question. encode turns (.., text) rows into rows with vec, their vectors: an encoder of your own. chunks:
id, collection, embedding, text, header, clause_type, search_type, has_party, has_dates, has_amounts, has_companies,
priority. Where scores are even, the order is that of the search: seeds first, then by variant, collection and id.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions import vocab
from ..functions.scratch import settled
from . import analyze, ranking, vectors

Encoder = Callable[[DataFrame], DataFrame]
#: Hits a variant brings from main and from the other collections; hits at least; variants that seed from entities.
K_MAIN, K_SIDE, LEAST, SEEDS = 8, 4, 6, 4
#: Variants of a question, and sub-questions, that its search keys have room for; more are an error.
_MOST, _SUBS = 1_000, 100
ORDER = ["stage", "n", "place", "id"]


def _key(qid: str, n: str, room: int) -> Column:
    """One number for a question and its n-th part; an error where n has no room, rather than another question's key."""
    fits = (F.col(n) >= 0) & (F.col(n) < room)
    return F.when(fits, F.col(qid) * room + F.col(n)).otherwise(F.raise_error(F.lit(f"a question has {room} parts or more"))).cast("bigint")


def variants(asked: DataFrame, array: Column, encode: Encoder) -> DataFrame:
    """qid, n, text, vec of each question's variants, numbered from 1."""
    rows = asked.select("qid", F.posexplode(array).alias("p", "text")).select("qid", (F.col("p") + 1).cast("bigint").alias("n"), "text")
    return encode(rows)


def searched(rows: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """qid, n, text, collection, place, id, raw, rank and the chunks' columns: each variant's k best in each collection."""
    keys = rows.select(_key("qid", "n", _MOST).alias("qid"), F.col("vec").alias("qvec"))
    hits = vectors.top_k(keys, chunks, k, key="id", group="collection").select(
        F.floor(F.col("qid") / _MOST).cast("bigint").alias("qid"), F.pmod("qid", F.lit(_MOST)).alias("n"), "collection", "id", F.col("score").alias("raw"), "rank"
    )
    place = F.when(F.col("collection") == "main", 0).when(F.col("collection") == "entities", 1).otherwise(2)
    asked = rows.select(F.col("qid").cast("bigint").alias("qid"), "n", F.col("text").alias("variant"))
    return hits.join(chunks.drop("embedding"), ["collection", "id"]).join(asked, ["qid", "n"]).withColumn("place", place)


def boosted(hits: DataFrame, question: str = "variant") -> DataFrame:
    """score: the clamped inner product and the boosts of the variant that found the hit."""
    c = F.col
    boost = ranking.hybrid_boost(c(question), c("text"), c("header"), c("clause_type"), c("has_dates"), c("has_party"), c("priority"))
    return hits.withColumn("score", ranking.capped(vectors.clamped(c("raw")), boost))


def _first(rows: DataFrame, key: str, k: int | None = None, order: list[str] = ORDER) -> DataFrame:
    """The best row of each key, ranked; the first k."""
    best = [F.desc("score"), *order]
    once = rows.withColumn("__n", F.row_number().over(Window.partitionBy("qid", key).orderBy(*best))).where("__n = 1")
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*best)).cast("bigint")).drop("__n")
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def _sides(hits: DataFrame, main: int, entities: int, clauses: int) -> DataFrame:
    return hits.where(F.col("rank") <= F.when(F.col("collection") == "main", main).when(F.col("collection") == "entities", entities).otherwise(clauses))


def comprehensive(asked: DataFrame, encode: Encoder, chunks: DataFrame, k: int = 12) -> DataFrame:
    """Every variant against all three collections; the k best ids."""
    rows = variants(asked, analyze.expanded(F.col("question")), encode)
    hits = _sides(searched(rows, chunks, K_MAIN), K_MAIN, K_SIDE, K_SIDE)
    return _first(boosted(hits).withColumn("stage", F.lit(1)), "id", k)


def entities_focused(asked: DataFrame, encode: Encoder, chunks: DataFrame, k: int = 8) -> DataFrame:
    """Four prompts against entities (2k each) and main (k each); the k best ids."""
    rows = variants(asked, analyze.filled(vocab.ENTITY_PROMPTS, F.col("question")), encode)
    hits = _sides(searched(rows, chunks.where("collection <> 'clauses'"), 2 * k), k, 2 * k, 0)
    return _first(boosted(hits).withColumn("stage", F.lit(1)), "id", k)


def hybrid(asked: DataFrame, encode: Encoder, chunks: DataFrame, k: int = 12) -> DataFrame:
    """The model-free pipeline: entity seeds, all variants against main and clauses, one hit per base id, top-up, diversity.

    Each variant's boosts are applied before hits are merged, so a base id keeps its best score over all variants.
    """
    least = max(k, LEAST)
    rows = variants(asked, analyze.expanded(F.col("question")), encode)
    hits = boosted(searched(rows, chunks, max(least, K_MAIN))).withColumn("base_id", t.base_id(F.col("id")))
    wants_entities = t.any_of(F.lower("question"), vocab.ENTITY_WORDS)
    asks = asked.select(F.col("qid").cast("bigint").alias("qid"), wants_entities.alias("asks"))
    seeds = hits.where((F.col("collection") == "entities") & (F.col("n") <= SEEDS) & (F.col("rank") <= max(k, K_MAIN))).join(F.broadcast(asks), "qid").where("asks").drop("asks")
    cover = _sides(hits.where("collection <> 'entities'"), K_MAIN, 0, K_SIDE)
    merged = _first(seeds.withColumn("stage", F.lit(0)).unionByName(cover.withColumn("stage", F.lit(1))), "base_id")
    # what is missing is filled up from main: variant by variant, the best first, new base ids only
    count = merged.groupBy("qid").agg((least - F.count("*")).alias("need"))
    extra = hits.where("collection = 'main'").join(count, "qid").where("rank <= need").join(merged.select("qid", "base_id"), ["qid", "base_id"], "left_anti")
    turn = [F.col("n"), F.desc("score"), F.col("id")]
    extra = extra.withColumn("__n", F.row_number().over(Window.partitionBy("qid", "base_id").orderBy(*turn))).where("__n = 1")
    extra = extra.withColumn("__n", F.row_number().over(Window.partitionBy("qid").orderBy(*turn))).where("__n <= need").drop("__n", "need")
    final = _first(merged.unionByName(extra.withColumn("stage", F.lit(2))), "base_id")
    return _head(ranking.diverse(final, 2 * k, ["doc_id", "header", "clause_type"]), k)


def _head(ranked: DataFrame, k: int) -> DataFrame:
    """The first k rows of each question, ranked anew."""
    again = F.row_number().over(Window.partitionBy("qid").orderBy("rank"))
    return ranked.withColumn("rank", again.cast("bigint")).where(F.col("rank") <= k)


def found_first(rows: DataFrame, chunks: DataFrame, collection: str, k: int) -> DataFrame:
    """The older search: each variant brings min(2k, 100) hits, the first to find an id gives its score; the k best."""
    hits = searched(rows, chunks.where(F.col("collection") == collection), min(2 * k, 100))
    once = hits.withColumn("__n", F.row_number().over(Window.partitionBy("qid", "id").orderBy("n"))).where("__n = 1").drop("__n")
    scored = once.withColumn("score", F.round(vectors.from_distance(1 - F.col("raw")), 6)).withColumn("stage", F.lit(1))
    return _first(scored, "id", k)


def old_candidates(asked: DataFrame, encode: Encoder, chunks: DataFrame, k: int = 12) -> DataFrame:
    """The older pipeline up to its rerank: main (2k), entities (k) if the question asks for them, clauses (k), boosts by intent."""
    rows = variants(asked, analyze.expanded_old(F.col("question")), encode)
    low = F.lower("question")
    gate = asked.select(F.col("qid").cast("bigint").alias("qid"), "question", t.any_of(low, vocab.PARTY_WORDS).alias("asks"))
    main, entities, clauses = (found_first(rows, chunks, c, n) for c, n in (("main", 2 * k), ("entities", k), ("clauses", k)))
    all_hits = main.unionByName(entities).unionByName(clauses).join(F.broadcast(gate), "qid").where("asks or collection <> 'entities'")
    c = F.col
    boost = ranking.intent_boost(c("question"), c("text"), c("clause_type"), c("has_party"), c("has_companies"), c("search_type"))
    # even scores stay in the order of the scores before
    before = all_hits.withColumn("before", -c("score")).withColumn("score", ranking.capped(c("score"), boost))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "before", "place", "id"))
    return before.withColumn("rank", rank.cast("bigint")).drop("asks", "before")


def old_comprehensive(asked: DataFrame, encode: Encoder, chunks: DataFrame, k: int = 12, weight: float = 0.7) -> DataFrame:
    """qid, id, pick: old_candidates() thinned by maximal marginal relevance over the best max(50, 4k)."""
    pool = old_candidates(asked, encode, chunks, k).where(F.col("rank") <= max(50, 4 * k)).select("qid", "collection", "id", "rank")
    own = encode(asked.select("qid", F.col("question").alias("text"))).select(F.col("qid").cast("bigint").alias("qid"), F.col("vec").alias("qvec"))
    numbered = pool.join(chunks.select("collection", "id", "embedding"), ["collection", "id"]).join(F.broadcast(own), "qid").withColumn("vec_id", F.col("rank"))
    picked = vectors.mmr(numbered.select("qid", "qvec", "vec_id", "embedding", "rank"), k, weight)
    return picked.withColumnRenamed("vec_id", "rank").join(pool, ["qid", "rank"]).select("qid", "id", "pick")


def old_entities(asked: DataFrame, encode: Encoder, chunks: DataFrame, k: int = 8) -> DataFrame:
    """The older entity search: four prompts against entities (2k) and main (k); the k best."""
    rows = variants(asked, analyze.filled(vocab.OLD_ENTITY_PROMPTS, F.col("question")), encode)
    both = found_first(rows, chunks, "entities", 2 * k).unionByName(found_first(rows, chunks, "main", k))
    order = [F.desc("score"), F.col("collection"), F.col("id")]
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order)).cast("bigint")).where(F.col("rank") <= k)


def legacy(asked: DataFrame, encode: Encoder, chunks: DataFrame, k: int = 8, pool: int = 40) -> DataFrame:
    """qid, id, pick: one search, thinned by maximal marginal relevance with the older bound."""
    own = encode(asked.select("qid", F.col("question").alias("text"), F.lit(1).cast("bigint").alias("n")))
    hits = searched(own, chunks.where("collection = 'main'"), max(k, pool)).join(chunks.select("collection", "id", "embedding"), ["collection", "id"])
    vecs = own.select(F.col("qid").cast("bigint").alias("qid"), F.col("vec").alias("qvec"))
    numbered = hits.join(F.broadcast(vecs), "qid").withColumn("vec_id", F.col("rank"))
    picked = vectors.mmr(numbered.select("qid", "qvec", "vec_id", "embedding", "rank"), k, 0.6, legacy_bound=True)
    return picked.withColumnRenamed("vec_id", "rank").join(hits.select("qid", "rank", "id"), ["qid", "rank"]).select("qid", "id", "pick")


def reranked(hits: DataFrame, asked: DataFrame) -> DataFrame:
    """Ranked hits with the metadata boosts, ranked again; up to three of a question stay as they are."""
    c = F.col
    boost = ranking.rerank_boost(c("question"), c("clause_type"), c("has_amounts"), c("has_dates"), c("has_party"), c("search_type"), c("priority"))
    n = F.count("*").over(Window.partitionBy("qid"))
    rows = hits.join(F.broadcast(asked.select(c("qid").cast("bigint").alias("qid"), "question")), "qid")
    rows = rows.withColumn("score", F.when(n > 3, ranking.capped(c("score"), boost)).otherwise(c("score"))).drop("question")
    again = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "rank"))
    return rows.withColumn("rank", again.cast("bigint"))


def missing(asked: DataFrame, ranked: DataFrame) -> DataFrame:
    """qid, n, question: what to search for next, where the first eight hits have no dates or amounts that the question asks for."""
    seen = ranked.where("rank <= 8").groupBy("qid").agg(F.max("has_dates").alias("dates"), F.max("has_amounts").alias("amounts"))
    low = F.lower("question")
    none = F.array().cast("array<string>")
    lists = [F.when(t.any_of(low, words) & ~F.coalesce(name, F.lit(False)), F.array(*map(F.lit, more))).otherwise(none) for name, words, more in vocab.MISSING]
    rows = asked.select(F.col("qid").cast("bigint").alias("qid"), "question").join(seen, "qid")
    rows = rows.select("qid", F.posexplode(F.array_distinct(F.concat(*lists))).alias("n", "question"))
    return rows.select("qid", (F.col("n") + 1).cast("bigint").alias("n"), "question")


def _parts(rows: DataFrame, most: int) -> DataFrame:
    """Sub-questions (qid, n, question) as questions of their own."""
    return rows.where(F.col("n") <= most).select(_key("qid", "n", _SUBS).alias("qid"), "question")


def _whole(hits: DataFrame) -> DataFrame:
    """Hits of sub-questions as hits of their question; turn tells the sub-questions apart."""
    return hits.withColumn("turn", F.pmod("qid", F.lit(_SUBS))).withColumn("qid", F.floor(F.col("qid") / _SUBS).cast("bigint"))


def enterprise(asked: DataFrame, encode: Encoder, chunks: DataFrame, k: int = 15) -> DataFrame:
    """The comprehensive pipeline without a model: entity hits where asked for, six alias queries, rerank, follow-ups, the k best base ids."""
    question = F.col("question")
    low = F.lower(question)
    gate = (analyze.listed_intent(question, vocab.HEURISTIC_INTENTS, "comprehensive_summary") == "entity_search") | low.rlike("compan|part|who")
    queries = asked.select("qid", F.posexplode(analyze.with_aliases(question)).alias("p", "question")).select("qid", (F.col("p") + 1).alias("n"), "question")
    entities = entities_focused(asked.where(gate), encode, chunks, max(4, k // 2)).withColumn("turn", F.lit(0).cast("bigint"))
    batch = _whole(comprehensive(_parts(queries, 6), encode, chunks, max(6, k // 3)))
    order = ["turn", "rank", "id"]
    merged = entities.unionByName(batch).withColumn("base_id", t.base_id(F.col("id")))
    top = reranked(_first(merged, "base_id", 2 * k, order), asked)
    final = top.where(F.col("rank") <= k).withColumn("turn", F.lit(-1).cast("bigint"))
    follow = _whole(comprehensive(_parts(missing(asked, final), 3), encode, chunks, max(4, k // 4))).join(final.select("qid", "id"), ["qid", "id"], "left_anti")
    follow = follow.withColumn("base_id", t.base_id(F.col("id")))
    return _first(final.unionByName(follow), "base_id", k, order)


#: What to search for after a hop: from the questions (qid, question) and the hop's ranked hits, rows of qid, n, question.
FollowUps = Callable[[DataFrame, DataFrame], DataFrame]


def multi_hop(asked: DataFrame, encode: Encoder, chunks: DataFrame, k: int = 12, follow: FollowUps | None = None, max_hops: int = 3) -> DataFrame:
    """Search, ask on from what was found, search again: the k best base ids over all hops.

    follow gives a question's next searches; without it there is one hop. A search that was
    made before for the question isn't made again, and a hop that finds nothing is the last.
    Each hop's hits and searches are settled, so a later hop doesn't search the earlier ones anew.
    """
    each = max(4, k // 2)
    questions = asked.select(F.col("qid").cast("bigint").alias("qid"), "question")
    wanted = questions.select("qid", F.lit(1).cast("bigint").alias("n"), "question")
    done = found = None
    for hop in range(max_hops):
        nth = F.row_number().over(Window.partitionBy("qid").orderBy("n"))
        once = wanted.groupBy("qid", "question").agg(F.min("n").alias("n"))
        fresh = once if done is None else once.join(done, ["qid", "question"], "left_anti")
        fresh = settled(fresh.withColumn("n", nth.cast("bigint")), "hop-searches")
        if fresh.isEmpty():
            break
        hits = settled(_whole(comprehensive(_parts(fresh, _SUBS), encode, chunks, each)).withColumn("hop", F.lit(hop)), "hop-hits")
        if hits.isEmpty():
            break
        found = hits if found is None else found.unionByName(hits)
        if follow is None or hop == max_hops - 1:
            break
        done = fresh.select("qid", "question") if done is None else done.unionByName(fresh.select("qid", "question"))
        wanted = follow(questions, _first(hits, "id", None, ["turn", "rank", "id"]))
    if found is None:
        found = comprehensive(asked, encode, chunks, each).withColumns({"turn": F.lit(1).cast("bigint"), "hop": F.lit(0)})
    return _first(found.withColumn("base_id", t.base_id(F.col("id"))), "base_id", k, ["hop", "turn", "rank", "id"])


def fixed_questions(spark: SparkSession, encode: Encoder, chunks: DataFrame, only: str | None = None) -> DataFrame:
    """The hits of the questions that are always the same, or of the one of that name, by the strategy that their analysis gives."""
    asked = spark.createDataFrame([(n, *x) for n, x in enumerate(vocab.FIXED_QUESTIONS) if only in (None, x[0])], "qid bigint, helper string, question string, k int")
    facts = asked.select("*", *[v.alias(c) for c, v in analyze.quick_analysis(F.col("question")).items()])
    method = analyze.strategy(F.col("intent"), F.col("specificity"), F.col("aggregates"))["method"]
    found = []
    for r in facts.select("qid", "k", method.alias("method")).collect():  # a few constants
        search = comprehensive if r.method == "comprehensive" else entities_focused
        found.append(search(asked.where(F.col("qid") == r.qid).select("qid", "question"), encode, chunks, r.k))
    return reduce(DataFrame.unionByName, found).join(asked.select("qid", "helper"), "qid")
