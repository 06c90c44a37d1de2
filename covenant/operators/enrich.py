"""Document and clause types, parties, metadata, entities, routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions import vocab
from ..sources.corpus import dealt


def doc_type(text: Column, name: Column) -> Column:
    """The type with most of its phrases in the text and, twice, in the file's name, weighted."""
    kinds, groups = [kind for kind, _, _ in vocab.DOC_TYPES], [phrases for _, _, phrases in vocab.DOC_TYPES]
    weights = F.array(*[F.lit(float(weight)) for _, weight, _ in vocab.DOC_TYPES])
    found = F.zip_with(t.totals(F.lower(text), groups), t.totals(F.lower(name), groups), lambda x, y: x + 2 * y)
    return t.best_named(F.zip_with(found, weights, lambda n, w: n * w), kinds, "lease")


def clause_type(text: Column, doc: Column) -> Column:
    """The clause with most of its phrases in the text, among those of the document's type; an unknown type is taken for the first, lease."""
    low = F.lower(text)
    best = {kind: t.best_named(t.totals(low, list(names.values())), list(names), "general") for kind, names in vocab.CLAUSES.items()}
    out = best["lease"]
    for kind, value in best.items():
        if kind != "lease":
            out = F.when(doc == kind, value).otherwise(out)
    return out


def party(text: Column, words: str, endings: str) -> Column:
    name = rf"([A-Z][A-Za-z\s&]+(?:{endings}))"
    return t.strip(t.found(text, rf"(?:{words})[^\n]*?{name}", flags="(?id)"))


def roles_named(text: Column, kind: Column) -> dict[str, Column]:
    """Each role's party, by document type."""
    out: dict[str, Column] = {}
    for doc, roles in vocab.PARTY_ROLES.items():
        for role, words, endings in roles:
            value = F.when(kind == doc, party(text, words, endings))
            out[role] = F.coalesce(out[role], value) if role in out else value
    return out


def parties(text: Column, kind: Column, none: Column | None = None) -> dict[str, Column]:
    """Each role's party, by document type; without any, the two of a BETWEEN ... AND ... . none: whether there is none, if it is known already."""
    named = roles_named(text, kind)
    side = lambda k: t.strip(F.regexp_extract(text, "(?isd)" + vocab.BETWEEN, k))
    name = rf"([A-Z][A-Za-z\s&]+(?:{vocab.BETWEEN_ENDINGS}))"
    none = F.coalesce(*named.values()).isNull() if none is None else none
    return named | {f"party_{k}": F.when(none, t.strip(t.found(side(k), name, flags=""))) for k in (1, 2)}


def with_parties(docs: DataFrame, text: str = "text", kind: str = "doc_type") -> DataFrame:
    """docs with a column for each of parties(): roles first, so that no pattern is tried again to see whether there is none."""
    named = roles_named(F.col(text), F.col(kind))
    sides = parties(F.col(text), F.col(kind), F.coalesce(*named).isNull())
    return docs.withColumns(named).withColumns({k: v for k, v in sides.items() if k not in named})


def field(text: Column, name: str, kind: Column) -> Column:
    """A metadata field; those of one document type are null for others."""
    doc, pattern = next((d, p) for n, d, p in vocab.FIELDS if n == name)
    value = t.strip(t.found(text, pattern))
    return value if doc is None else F.when(kind == doc, value)


#: Date formats that are tried in order; commas are optional.
DATE_FORMATS = ["MMMM d yyyy", "MMM d yyyy"]


def dated(text: Column, name: str) -> Column:
    """A date field as yyyy-MM-dd; null if it is no date. "Sept" is read as September."""
    raw = F.replace(t.found(text, f"(?:{dict(vocab.DATE_FIELDS)[name]}){vocab.DATE_TAIL}"), F.lit(","), F.lit(" "))
    words = F.initcap(F.regexp_replace(F.regexp_replace(raw, r"\s+", " "), r"(?i)^sept ", "Sep "))
    return t.once(words, lambda x: F.date_format(F.coalesce(*[F.try_to_date(x, f) for f in DATE_FORMATS]), "yyyy-MM-dd"))


def term(text: Column, kind: Column) -> Column:
    pattern = r"(?:term|period)\s+of\s+(\d+)\s+(years?|months?)"
    found = F.concat_ws(" ", t.found(text, pattern), t.found(text, pattern, 2))
    return F.when(kind == "lease", F.nullif(found, F.lit("")))


#: Characters of the pieces by which a name is looked for in a party: enough to tell numbered names apart, of which few share a piece.
PIECE = 8


def entities(text: Column, kind: str) -> Column:
    """Sorted distinct entities of a kind as an array."""
    flags = "" if kind in vocab.CASED_KINDS else "(?i)"
    patterns = vocab.ENTITY_PATTERNS[kind]
    if kind == "companies":
        # where no name begins at a word, none begins at the words after it in the same run, which is passed over (and found empty)
        patterns = [rf"{p}|\b[A-Z]{run}+" for p, run in zip(patterns, vocab.COMPANY_RUNS, strict=True)]
    values = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(flags + p), F.lit(1)) for p in patterns]))
    values = F.transform(values, lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", "")))
    if kind == "companies":
        values = F.filter(values, lambda x: (F.length(x) > 5) & ~F.lower(x).rlike("^(?:the|a|an) "))
    if kind == "addresses":
        values = F.filter(values, lambda x: F.length(x) > 10)
    if kind == "people":
        values = F.filter(values, lambda x: x.rlike(r"\S\s+\S"))
    return F.array_sort(F.array_distinct(values))


def target_collection(search_type: Column, clause: Column) -> Column:
    return (
        F.when(search_type.isin("entities", "clauses"), search_type)
        .when((F.coalesce(clause, F.lit("")) != "") & (clause != "general"), F.lit("clauses"))
        .otherwise(F.lit("main"))
    )


def fan_out(chunks: DataFrame) -> DataFrame:
    """Main, entity and clause rows of each chunk: collection, id, text, search_type.

    chunks: id, text, rich (what main embeds), header, doc_type, clause_type, entity_text (null: no entity, no row).
    """
    clause_text = F.concat(F.lit("CLAUSE TYPE: "), "clause_type", F.lit("\nDOCUMENT TYPE: "), "doc_type", F.lit("\n"), "header", F.lit("\n\n"), "text")
    row = lambda name, key, text, kind: F.struct(F.lit(name).alias("collection"), key.alias("id"), text.alias("text"), F.lit(kind).cast("string").alias("search_type"))
    rows = F.array(
        row("main", F.col("id"), F.col("rich"), None),
        F.when(F.col("entity_text").isNotNull(), row("entities", F.concat("id", F.lit("_entities")), F.col("entity_text"), "entities")),
        row("clauses", F.concat("id", F.lit("_clause")), clause_text, "clause"),
    )
    return chunks.select(F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("r")).select("r.*")


def rich_text(text: Column, header: Column, doc: Column, clause: Column, found: dict[str, Column], address: Column, area: Column, date: Column) -> Column:
    """What is embedded for a chunk: its context lines, then its text. found: arrays of entities; only up to five are listed."""
    line = lambda label, value: F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{label}: "), value))
    lists = [F.when(F.size(v).between(1, 5), F.concat(F.lit(f"{k.upper()}: "), F.array_join(v, ", "))) for k, v in found.items()]
    lines = [line("DOCUMENT TYPE", doc), line("CLAUSE TYPE", clause), line("SECTION", t.strip(header)), *lists, line("PROPERTY", address), F.concat(line("AREA", area), F.lit(" sq ft")), line("DATE", date)]
    return F.concat(F.concat_ws("\n", *lines), F.lit("\n\nCONTENT:\n"), text)


def simple_text(text: Column, header: Column, lessor: Column, lessee: Column, date: Column, term_duration: Column, clause: Column) -> Column:
    """What the older ingest embeds: header, text and a few fields."""
    line = lambda label, value: F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{label}: "), value))
    fields = [line("LESSOR", lessor), line("LESSEE", lessee), line("EFFECTIVE DATE", date), line("TERM", term_duration), line("CLAUSE", clause)]
    return F.concat_ws("\n", F.nullif(t.strip(header), F.lit("")), F.nullif(text, F.lit("")), *fields)


def entity_text(text: Column, found: dict[str, Column]) -> Column:
    """The text of a chunk's row in the entity collection; null if it has no entity."""
    lines = [F.when(F.size(v) > 0, F.concat(F.lit(f"{k.upper()}: "), F.array_join(v, ", "), F.lit("\n"))) for k, v in found.items()]
    listed = F.concat_ws("", *lines)
    return F.when(listed != "", F.concat(F.lit("ENTITIES FOUND:\n"), listed, F.lit("\nCONTEXT:\n"), text))


def sanitised(metadata: Column) -> Column:
    """A map of variants as a map of strings: lists joined by "; ", null kept."""
    text = lambda v: F.when(F.schema_of_variant(v).startswith("ARRAY"), F.array_join(F.try_variant_get(v, "$", "array<string>"), "; ")).otherwise(F.try_variant_get(v, "$", "string"))
    return F.transform_values(metadata, lambda _, v: text(v))


def metadata_map(raw: Column) -> Column:
    """Metadata as a map of variants; anything but a JSON object is an empty map."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(raw), "$", "map<string,variant>"), F.from_json(F.lit("{}"), "map<string,variant>"))


def _pieces(value: Column, size: Column) -> Column:
    """The distinct runs of so many characters of a value."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(value) - size + 1), lambda k: F.substr(value, k, size)))


def holding(names: DataFrame, parties: DataFrame) -> DataFrame:
    """name, party: which parties hold which names (name, low), whatever their case and length.

    Names and parties meet where they share a piece of PIECE characters (all of a shorter
    name): for each name the one of its pieces that fewest parties have, so that words
    which most parties have in common pair nothing. Each pair is then compared whole.
    Pieces are far more than the tables they come from, which Spark's sizes don't show, so
    both sides are shuffled, and parties are dealt out before they are cut.
    """
    size = lambda c: F.least(F.lit(PIECE), F.length(c)).cast("int")
    known = names.where("low <> ''").select("name", "low", F.explode(_pieces(F.col("low"), size("low"))).alias("piece"))
    lengths = [r.n for r in known.select(size("low").alias("n")).distinct().collect()]  # PIECE rows at most
    cut = F.array_distinct(F.flatten(F.array(*[F.when(F.length("party") >= n, _pieces(F.col("party"), F.lit(n))).otherwise(F.array().cast("array<string>")) for n in sorted(lengths)])))
    parties = dealt(parties, "party")
    held = parties.select("party", F.explode(cut).alias("piece")) if lengths else parties.select("party", F.lit("").alias("piece")).where("false")
    rare = known.hint("merge").join(held.groupBy("piece").agg(F.count("*").alias("n")), "piece").groupBy("name", "low").agg(F.min_by("piece", F.struct("n", "piece")).alias("piece"))
    return rare.hint("merge").join(held, "piece").where(F.col("party").contains(F.col("low"))).select("name", "party")


def roles(names: DataFrame, documents: DataFrame) -> DataFrame:
    """name, role, docs: how many documents' lessor or lessee holds each name, and its role in the last of them.

    documents: doc_id, lessor, lessee. Names that stand in both of a document are its lessee.
    """
    sides = F.explode(F.array(F.struct(F.lit("Lessor").alias("role"), F.lower("lessor").alias("party")), F.struct(F.lit("Lessee").alias("role"), F.lower("lessee").alias("party"))))
    held = documents.select("doc_id", sides.alias("s")).select("doc_id", "s.*").where("party is not null")
    pairs = holding(names.select("name", F.lower("name").alias("low")), held.select("party").distinct())
    # which names a document has is known without pairing its parties: lessee goes over lessor
    hits = held.hint("merge").join(pairs, "party").groupBy("name", "doc_id").agg(F.min("role").alias("role"))
    return hits.groupBy("name").agg(F.max_by("role", "doc_id").alias("role"), F.count("*").alias("docs"))
