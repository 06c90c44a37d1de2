"""Question analysis and expansion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions import vocab


def intent(question: Column) -> Column:
    """The intent whose patterns match most often; the first wins ties."""
    names, groups = zip(*vocab.INTENT_PATTERNS, strict=True)
    return t.best_named(t.once(t.ascii_words(question), lambda words: t.matches(words, groups)), names, "general")


def listed_intent(question: Column, lists: list, default: str) -> Column:
    low = t.lower(question)
    return t.first_of([(t.any_of(low, words), name) for name, words in lists], default)


def question_type(question: Column) -> Column:
    return t.once(t.ascii_words(question), lambda words: t.first_of([(t.any_match(words, p), name) for name, p in vocab.QUESTION_TYPES], "general"))


def aggregates(question: Column) -> Column:
    return t.any_match(t.ascii_words(question), vocab.AGGREGATION)


def kinds_asked(question: Column) -> Column:
    """Entity kinds of interest, as an array in order."""
    asked = lambda words: F.array(*[F.when(t.any_match(words, p), F.lit(name)) for name, p in vocab.ENTITY_KINDS])
    return F.filter(t.once(t.ascii_words(question), asked), lambda x: x.isNotNull())


def keywords(question: Column) -> Column:
    words = F.transform(F.regexp_extract_all(question, F.lit(r"\w+"), F.lit(0)), lambda w: F.lower(w))
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(vocab.STOP_WORDS))))


def specificity(question: Column) -> Column:
    total = F.least(t.word_count(question) / 20.0, F.lit(0.3)) + 0.1 * F.size(kinds_asked(question))
    total += 0.1 * F.size(F.array_intersect(keywords(question), F.array(*map(F.lit, vocab.SPECIFIC_WORDS))))
    total += F.when(t.any_match(t.ascii_words(question), [r"\b(?:\d+|specific|exact|particular)\b"]), 0.2).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), total), 6)


def collections(intent_name: Column) -> Column:
    def chosen(name: Column) -> Column:
        out = F.lit(",".join(vocab.COLLECTIONS["general"]))
        for one, preferred in vocab.COLLECTIONS.items():
            out = F.when(name == one, F.lit(",".join(preferred))).otherwise(out)
        return out

    return t.once(intent_name, chosen)


def expanded(question: Column, most: int = 10) -> Column:
    """The question, synonym swaps and role prompts: distinct, in order, at most so many."""
    q = t.trim(question)
    low = t.lower(q)
    swaps = [F.when(low.contains(key), F.replace(low, F.lit(key), F.lit(a))) for key, alts in vocab.SYNONYMS.items() for a in alts]
    roles = [F.concat(F.lit(p), q) for p in ("entities and parties: ", "contract details: ", "clause references: ")] + [F.concat(q, F.lit("?"))]
    lists = ~low.contains("how many") & t.any_of(low, ["companies", "company", "parties"])
    more = [F.when(lists, F.concat(F.lit(p), q)) for p in ("how many ", "list all ", "count of ")]
    return F.slice(F.array_distinct(F.filter(F.array(q, *swaps, *roles, *more), lambda x: x.isNotNull())), 1, most)


def with_aliases(question: Column) -> Column:
    """The question and its alias swaps, in both directions, distinct and in order."""
    low = t.lower(question)
    out = [question]
    for canonical, alts in vocab.ALIASES.items():
        has = low.contains(canonical)
        for a in alts:
            out += [F.when(has, F.replace(low, F.lit(canonical), F.lit(a))), F.when(has, F.concat(low, F.lit(f" {a}")))]
        for a in alts:
            out += [F.when(~has & low.contains(a), F.replace(low, F.lit(a), F.lit(canonical))), F.when(~has & low.contains(a), F.concat(low, F.lit(f" {canonical}")))]
    return F.array_distinct(F.filter(F.array(*out), lambda x: x.isNotNull()))


def expanded_old(question: Column) -> Column:
    """The older expansion: synonyms that the question hasn't got, two role prompts; no limit."""
    low = t.lower(question)
    swaps = [F.when(low.contains(key) & ~low.contains(a), F.replace(low, F.lit(key), F.lit(a))) for key, alts in vocab.OLD_SYNONYMS.items() for a in alts]
    roles = [F.concat(F.lit(p), question) for p in ("entities and parties: ", "contract details: ")] + [F.when(~question.endswith("?"), F.concat(question, F.lit("?")))]
    lists = ~low.contains("how many") & (low.contains("companies") | low.contains("parties"))
    more = [F.when(lists, F.concat(F.lit(p), question)) for p in ("how many ", "list all ", "count of ")]
    return F.array_distinct(F.filter(F.array(question, *swaps, *roles, *more), lambda x: x.isNotNull()))


def filled(templates: list[str], question: Column) -> Column:
    """An array of the templates with the question in place of {}."""
    return F.array(*[F.replace(F.lit(x), F.lit("{}"), question) if "{}" in x else F.lit(x) for x in templates])


def expanded_by_intent(question: Column, kind: Column | None = None, kinds: Column | None = None) -> Column:
    """The analyser's expansion by intent and kinds of entity, sorted (it has no order of its own). kind, kinds: these two, if they are known."""
    none = F.array().cast("array<string>")

    def parts(kind: Column, kinds: Column) -> Column:
        out = [F.array(question)]
        out += [F.when(kind == name, filled(xs, question)).otherwise(none) for name, xs in vocab.INTENT_EXPANSIONS.items()]
        out += [F.when(F.array_contains(kinds, name), filled(xs, question)).otherwise(none) for name, xs in vocab.KIND_EXPANSIONS.items()]
        out += [F.when(~question.endswith("?"), F.array(F.concat(question, F.lit("?")))).otherwise(none)]
        return F.array_sort(F.array_distinct(F.concat(*out)))

    if kind is not None and kinds is not None:
        return parts(kind, kinds)
    return t.once(intent(question), lambda kind: t.once(kinds_asked(question), lambda kinds: parts(kind, kinds)))


def analysis(question: Column) -> Column:
    """The analyser's eight fields as one struct."""
    fields = lambda kind, kinds: F.struct(
        kind.alias("intent"), F.array_join(kinds, ",").alias("kinds"), F.array_join(keywords(question), ",").alias("keywords"), question_type(question).alias("question_type"),
        specificity(question).alias("specificity"), aggregates(question).alias("aggregates"), collections(kind).alias("collections"), expanded_by_intent(question, kind, kinds).alias("variants"),
    )
    return t.once(intent(question), lambda kind: t.once(kinds_asked(question), lambda kinds: fields(kind, kinds)))


def quick_analysis(question: Column) -> dict[str, Column]:
    """The fields of the quick analysis by word lists."""
    low = t.lower(question)
    kinds = F.filter(F.array(*[F.when(t.any_of(low, words), F.lit(name)) for name, words in vocab.QUICK_KINDS]), lambda x: x.isNotNull())
    asks = F.when(low.startswith("how many"), "count").when(low.startswith("who"), "who").when(low.startswith("what"), "what").otherwise("general")
    name = listed_intent(question, vocab.QUICK_INTENTS, "general")
    return {
        "intent": name, "kinds": F.array_join(kinds, ","), "question_type": asks, "aggregates": asks == "count",
        "specificity": F.when(F.size(kinds) > 0, 0.7).otherwise(0.3), "collections": F.when(name.isin("entity_count", "entity_identification"), "entities,main").otherwise("main"),
    }


def strategy(name: Column, specific: Column, aggregates: Column) -> dict[str, Column]:
    """How to retrieve, by the analysis' fields; later rules go over earlier ones."""
    entities, money = name.isin("entity_count", "entity_identification"), name == "financial"
    weight = F.when(aggregates, 0.8).when(specific > 0.7, 0.4).when(entities, 0.7).when(money, 0.5).otherwise(0.6)
    return {
        "method": F.when(aggregates | ~entities, "comprehensive").otherwise("entity_focused"), "use_entities": entities | aggregates, "use_clauses": money,
        "expand": ~(specific > 0.7), "mmr_weight": weight, "rerank": F.lit(True),
    }


def valid_filter(where: dict | None) -> dict:
    """A metadata filter as given; anything that is none, or only an API's placeholder, is empty."""
    return {} if not isinstance(where, dict) or "additionalProp1" in where else where
