"""Answers from hits without a model: entity sets, tables, context, confidence, fixed replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions import vocab
from . import analyze, ranking

#: What is found in texts where metadata has none.
_PATTERNS = {"amounts": (vocab.MONEY, 0), "dates": (vocab.PLAIN_DATE, 0), "companies": (vocab.COMPANY, 1)}
#: Kinds that a chunk's metadata lists, joined by ";", under this name and "_extracted".
LISTED = ("companies", "people", "amounts", "dates", "locations")
#: Of each answer intent: what it lists, the table's heads, what a row says, the answer without rows.
_TABLES = {
    "entities": ("companies", "Company Name", "Role", "Unknown", "No companies identified in the retrieved sections."),
    "financial": ("amounts", "Amount", "Purpose / Note", "amount", "No financial amounts identified in the retrieved sections."),
    "dates": ("dates", "Date", "Type / Note", "date", "No dates identified in the retrieved sections."),
}
NO_SUMMARY = "Found relevant sections, but could not summarize with the local model."


def entity_sets(hits: DataFrame) -> DataFrame:
    """qid, what, found: sorted distinct entities of each question's hits, from their metadata.

    hits: qid, lessor, lessee and <kind>_extracted, lists joined by ";". Lessors and lessees are companies as well.
    """
    split = lambda c: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ";"), t.strip), lambda x: x != "")
    lists = {k: split(F.col(f"{k}_extracted")) for k in LISTED}
    lists["companies"] = F.concat(lists["companies"], F.filter(F.array("lessor", "lessee"), lambda x: F.coalesce(x, F.lit("")) != ""))
    every = F.array(*[F.struct(F.lit(k).alias("what"), v.alias("values")) for k, v in lists.items()])
    rows = hits.select("qid", F.explode(every).alias("e")).select("qid", "e.what", F.explode("e.values").alias("value"))
    return rows.groupBy("qid", "what").agg(F.array_sort(F.collect_set("value")).alias("found"))


def text_sets(hits: DataFrame) -> DataFrame:
    """qid, what, found: sorted distinct amounts, dates and companies in the texts of each question's hits (qid, text)."""
    every = F.array(*[F.struct(F.lit(what).alias("what"), F.regexp_extract_all("text", F.lit(p), F.lit(g)).alias("values")) for what, (p, g) in _PATTERNS.items()])
    rows = hits.select("qid", F.explode(every).alias("e")).select("qid", "e.what", F.explode("e.values").alias("value"))
    return rows.groupBy("qid", "what").agg(F.array_sort(F.collect_set(t.strip(F.col("value")))).alias("found"))


def company_rows(hits: DataFrame) -> DataFrame:
    """qid, name, role: companies of each question's hits (qid, rank, text, metadata), from their metadata or, without any, their texts.

    The role is that of the last hit whose lessor or lessee holds the name; in one hit lessee goes over lessor.
    """
    listed = entity_sets(hits).where("what = 'companies'").select("qid", "found")
    plain = text_sets(hits).where("what = 'companies'").select("qid", "found").join(listed, "qid", "left_anti")
    names = listed.unionByName(plain).select("qid", F.explode("found").alias("name"))
    holds = lambda c: F.coalesce(F.lower(c).contains(F.lower("name")), F.lit(False))
    role = F.when(holds("lessee"), "Lessee").when(holds("lessor"), "Lessor")
    found = names.join(hits.select("qid", "rank", "lessor", "lessee"), "qid")  # a question has as many hits as its search brings
    return found.groupBy("qid", "name").agg(F.coalesce(F.max_by(role, F.when(role.isNotNull(), F.col("rank"))), F.lit("Unknown")).alias("role"))


def table(rows: Column, head: str, second: str) -> Column:
    """A Markdown table of an array of (value, note)."""
    lines = F.transform(rows, lambda r: F.concat(F.lit("| "), r["value"], F.lit(" | "), r["note"], F.lit(" |")))
    return F.concat(F.lit(f"| {head} | {second} |\n| --- | --- |\n"), F.array_join(lines, "\n"))


def tables(asked: DataFrame, hits: DataFrame) -> DataFrame:
    """qid, intent, answer: a table of what the question asks for, from its hits, or a fixed sentence."""
    intents = asked.select(F.col("qid").cast("bigint").alias("qid"), analyze.listed_intent(F.col("question"), vocab.ANSWER_INTENTS, "summary").alias("intent"))
    wanted = F.lit(None).cast("string")
    for intent, (what, *_) in _TABLES.items():
        wanted = F.when(F.col("intent") == intent, what).otherwise(wanted)
    notes = {what: says for _, (what, _, _, says, _) in _TABLES.items()}
    plain = text_sets(hits).where("what <> 'companies'").select("qid", "what", F.explode("found").alias("value"))
    plain = plain.select("qid", "what", "value", F.when(F.col("what") == "amounts", notes["amounts"]).otherwise(notes["dates"]).alias("note"))
    companies = company_rows(hits).select("qid", F.lit("companies").alias("what"), F.col("name").alias("value"), F.col("role").alias("note"))
    lists = plain.unionByName(companies).groupBy("qid", "what").agg(F.array_sort(F.collect_list(F.struct("value", "note"))).alias("rows"))
    rows = intents.withColumn("what", wanted).join(lists, ["qid", "what"], "left")
    answer = F.lit(NO_SUMMARY)
    for intent, (_, head, second, _, none) in _TABLES.items():
        answer = F.when(F.col("intent") == intent, F.coalesce(table(F.col("rows"), head, second), F.lit(none))).otherwise(answer)
    return rows.select("qid", "intent", answer.alias("answer"))


def context(hits: DataFrame, most: int = 10) -> DataFrame:
    """qid, context: the first hits (qid, rank, header, clause_type, text), each under its stamp."""
    clause = F.when(F.col("clause_type") != "general", F.concat(F.lit("["), "clause_type", F.lit("]")))
    part = F.concat(F.lit("["), F.concat_ws(" :: ", "header", clause), F.lit("]\n"), "text")
    ordered = F.array_sort(F.collect_list(F.struct("rank", part.alias("part"))))
    return hits.where(F.col("rank") <= most).groupBy("qid").agg(F.array_join(F.transform(ordered, lambda x: x["part"]), "\n\n---\n\n").alias("context"))


def plain_reply(asked: DataFrame, hits: DataFrame) -> DataFrame:
    """qid, answer: what is said where nothing is generated."""
    counts = hits.groupBy("qid").agg(F.count("*").alias("n"))
    found = F.concat(F.lit("Found "), "n", F.lit(" relevant sections (generation disabled)."))
    return asked.select(F.col("qid").cast("bigint").alias("qid")).join(counts, "qid", "left").select("qid", F.coalesce(found, F.lit("No relevant information found in the document to answer your question.")).alias("answer"))


def confidence(asked: DataFrame, hits: DataFrame) -> DataFrame:
    """qid, hits, confidence of each question that has hits."""
    rows = hits.join(F.broadcast(asked.select(F.col("qid").cast("bigint").alias("qid"), F.lower("question").alias("low"))), "qid")
    value = ranking.confidence(F.count("*"), F.avg("score"), F.max(F.col("low").contains("compan")), F.max(F.col("has_companies") | F.col("has_party")), F.max(F.col("low").contains("amount")), F.max("has_amounts"))
    return rows.groupBy("qid").agg(F.count("*").alias("hits"), value.alias("confidence"))
