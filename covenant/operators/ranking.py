"""Boosts, deduplication, diversity and budgets over ranked hits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions import vocab


def hybrid_boost(question: Column, text: Column, header: Column, clause: Column, has_dates: Column, has_party: Column, priority: Column, overlap: Column | None = None) -> Column:
    """overlap: how many tokens question and text share, if it is known already."""
    low = F.lower(question)
    if overlap is None:
        overlap = F.size(F.array_intersect(t.tokens(question), F.array_union(t.tokens(text), t.tokens(header))))
    total = F.least(F.lit(0.12), F.lit(0.02) * overlap)
    total += F.when(t.any_of(low, vocab.FINANCIAL_WORDS) & clause.isin("rent", "financial", "security"), 0.06).otherwise(0.0)
    total += F.when(t.any_of(low, vocab.TEMPORAL_WORDS) & ((clause == "term") | has_dates), 0.06).otherwise(0.0)
    total += F.when(t.any_of(low, vocab.ENTITY_WORDS) & has_party, 0.07).otherwise(0.0)
    return total + F.when(priority == 1, 0.03).otherwise(0.0)


def intent_boost(question: Column, text: Column, clause: Column, has_party: Column, has_companies: Column, search_type: Column) -> Column:
    low, body = F.lower(question), F.lower(text)
    asks = t.any_of(low, ["company", "companies", "parties", "who", "lessor", "lessee"])
    counts = t.any_of(low, ["how many", "count", "number", "list"])
    total = F.when(asks & has_party, 0.3).otherwise(0.0) + F.when(asks & (search_type == "entities"), 0.2).otherwise(0.0)
    total += F.when(counts & t.any_of(body, ["entities", "parties"]), 0.25).otherwise(0.0) + F.when(counts & has_companies, 0.2).otherwise(0.0)
    for word in ("rent", "term", "maintenance", "security", "termination"):
        asked = low.contains(word)
        total += F.when(asked & (clause == word), 0.3).otherwise(0.0) + F.when(asked & body.contains(word), 0.1).otherwise(0.0)
    return total


def rerank_boost(question: Column, clause: Column, has_amounts: Column, has_dates: Column, has_party: Column, search_type: Column, priority: Column) -> Column:
    """The metadata boosts that stand in for a model's order."""
    low = F.lower(question)
    money, term, party = (t.any_of(low, w) for w in (vocab.RERANK_MONEY, vocab.RERANK_TERM, vocab.PARTY_WORDS))
    add = lambda test, x: F.when(test, x).otherwise(0.0)
    total = add(priority == 1, 0.05) + add(money & clause.isin("rent", "financial", "security"), 0.05) + add(money & has_amounts, 0.05)
    total += add(term & (clause == "term"), 0.05) + add(term & has_dates, 0.05)
    return total + add(party & has_party, 0.06) + add(party & (search_type == "entities"), 0.04)


def capped(score: Column, boost: Column) -> Column:
    return F.round(F.least(F.lit(1.0), score + boost), 6)


def first_per_base(hits: DataFrame, key: str = "qid") -> DataFrame:
    """The best hit of each base id: by score, then seq."""
    nth = F.row_number().over(Window.partitionBy(key, "base_id").orderBy(F.desc("score"), "seq"))
    return hits.withColumn("base_id", t.base_id(F.col("id"))).withColumn("__nth", nth).where("__nth = 1").drop("__nth")


def diverse(hits: DataFrame, want: int, group: list[str], most: int = 2, key: str = "qid") -> DataFrame:
    """At most so many hits of a group in rank order, want in all; untouched if there are no more than want."""
    of_group = Window.partitionBy(key, *group).orderBy("rank")
    n = F.count("*").over(Window.partitionBy(key))
    kept = hits.withColumn("__n", n).withColumn("__g", F.row_number().over(of_group)).where((F.col("__n") <= want) | (F.col("__g") <= most))
    nth = F.row_number().over(Window.partitionBy(key).orderBy("rank"))
    return kept.withColumn("__nth", nth).where(F.col("__nth") <= want).drop("__n", "__g", "__nth")


def within_budget(rows: DataFrame, cost: Column, budget: Column | int, partition: list[str], order: list[str]) -> DataFrame:
    """The longest prefix whose running cost stays within a budget (costs are positive)."""
    running = F.sum(cost).over(Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("used", running.cast("bigint")).where(F.col("used") <= budget)


def pack_by_document(hits: DataFrame, budget: int) -> DataFrame:
    """Budget shared by all documents of a question: a piece that doesn't fit ends only its own document.

    hits: qid, doc_id, doc_rank, page_start, chunk_index, piece. One question's hits are
    bounded by the search's k, so a group is small.
    """

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_rank", "page_start", "chunk_index"])
        total, closed, kept = 0, set(), []
        for row in pdf.itertuples():
            if row.doc_id in closed:
                continue
            if total + len(row.piece) > budget:
                closed.add(row.doc_id)
                continue
            total += len(row.piece)
            kept.append((row.qid, row.doc_id, row.chunk_index, total))
        return pd.DataFrame(kept, columns=["qid", "doc_id", "chunk_index", "used"])

    return hits.groupBy("qid").applyInPandas(pack, "qid bigint, doc_id string, chunk_index bigint, used bigint")


def stamp(doc: Column, clause: Column, header: Column, first: Column, last: Column, search_type: Column) -> Column:
    pages = F.concat(F.lit("p."), first, F.when(last != first, F.concat(F.lit("-"), last)).otherwise(F.lit("")))
    inner = F.concat_ws(" :: ", doc, F.concat(F.lit("("), F.nullif(clause, F.lit("")), F.lit(")")), F.nullif(header, F.lit("")), pages, F.concat(F.lit("["), search_type, F.lit("]")))
    return F.concat(F.lit("["), inner, F.lit("]"))


def confidence(rows: Column, mean: Column, asks_company: Column, companies: Column, asks_amount: Column, amounts: Column) -> Column:
    total = F.least(rows / 10.0, F.lit(0.3)) + 0.4 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), mean))
    total += F.when(asks_company & companies, 0.2).otherwise(0.0) + F.when(asks_amount & amounts, 0.2).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), total), 6)


def answer_confidence(answer: Column) -> Column:
    score = F.lit(1.0)
    for phrase in vocab.HEDGES:
        score = score * F.when(F.lower(answer).contains(phrase), 0.8).otherwise(1.0)
    score = score * F.when(t.word_count(answer) < 20, 0.9).otherwise(1.0)
    cited = F.size(F.regexp_extract_all(answer, F.lit(r"\[[\w\s\.-]+\s+p\.\d+[-\d]*\]"), F.lit(0)))
    return F.round(F.least(F.lit(1.0), score + 0.1 * cited), 2)
