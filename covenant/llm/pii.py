"""Personal data: base patterns, and information-theoretic sanitisation around them.

The base patterns find email addresses, IP addresses, card and phone numbers. Each
value is a protected entity c. Terms near its mentions may reveal it even after it
is replaced. How strongly a term t does is estimated over the corpus: with document
frequencies df and the documents n(c,t) in which t stands near c,

    PMI(c;t) = log2( (n(c,t) - DISCOUNT) * N / (df(c) * df(t)) ),    IC(c) = log2( N / df(c) ).

The discount takes most from pairs seen once, so that an entity of one document has
terms that disclose it as well, but only very rare ones. A term with PMI > ALPHA * IC
discloses the entity. It is generalised to a shorter stem followed by ``*`` if the stem
discloses less than the threshold, else removed. This holds for each document that mentions the entity, wherever the term
stands in it.

Null and empty texts have no spans. Repeated rows are documents of their own: they
count in the frequencies. Null doc_ids are scanned for base kinds. An empty table
gives an empty result. Only doc_id and text are read (sanitise() keeps all columns).
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import BROADCAST_BYTES, sliced, small_or_shuffled, written

KINDS = ("email", "ip", "card", "phone", "term")
#: Words on either side of a mention that are its context.
CONTEXT = 6
ALPHA = 0.8
#: Taken off each count of documents that show an entity and a term together.
DISCOUNT = 0.5
#: Letters that a generalised term keeps.
STEM = 3
#: Bytes that a term is taken to need in a table that may be broadcast.
TERM_BYTES = 64

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only begin where a run of digits does: the last one took all digits before it.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^ \t-\r]+")
#: A term: letters and their marks. Both engines look for it by the same classes, so that no script is left out.
TERM = r"[\p{L}\p{M}]{4,}"
_TERM = regex.compile(TERM)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from each @ so that long runs cost no squares."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _at_most_255(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end), by start, then kind."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(map(_at_most_255, m[0].split("."))):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_DIGIT.findall(m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def _near(text: str, spans: list[tuple[int, int, int]], width: int = CONTEXT) -> Iterator[tuple[str, set[str]]]:
    """Each entity with the terms around its mentions (lower case, at least four letters)."""
    near: dict[str, set[str]] = {}
    words = [m.span() for m in _WORD.finditer(text)]
    starts, ends = [a for a, _ in words], [b for _, b in words]

    # Each word is looked through once, however many mentions stand near or in it.
    @cache
    def marks(k: int) -> tuple[int, int]:
        """The first and last digit or @ of a word."""
        a, b = words[k]
        found = [at for at in range(a, b) if text[at].isdigit() or text[at] == "@"]
        return (found[0], found[-1]) if found else (b, -1)

    @cache
    def terms(a: int, b: int) -> list[str]:
        return [t.lower() for t in _TERM.findall(text[a:b])]

    for start, _, end in spans:
        own = near.setdefault(text[start:end], set())
        i, j = bisect_left(starts, start), bisect_right(ends, end)
        before = ((k, starts[k], min(ends[k], start)) for k in range(max(0, i - width), i))
        after = ((k, max(starts[k], end), ends[k]) for k in range(j, min(len(words), j + width)))
        for k, a, b in (*before, *after):
            first, last = marks(k)
            if first >= b or last < a:
                own.update(terms(a, b))
    yield from near.items()


def contexts(docs: DataFrame, width: int = CONTEXT) -> DataFrame:
    """doc_id, entity (a digest), term: one row per term near a mention; term '' stands for the mention itself.

    A document with a mention also has a row with entity '' for each term anywhere in it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                if text and doc_id is not None and (spans := base_spans(text)):
                    for entity, terms in _near(text, spans, width):
                        digest = hashlib.blake2b(entity.encode("utf-8", "replace"), digest_size=12).hexdigest()
                        rows += [(doc_id, digest, term) for term in ("", *sorted(terms))]
                    rows += [(doc_id, "", term) for term in sorted({t.lower() for t in _TERM.findall(text)})]
            ids, entities, terms = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(entities, pa.string()), pa.array(terms, pa.string())], names=["doc_id", "entity", "term"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, entity string, term string")


def frequencies(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """term, df: in how many documents each wanted term (or stem*) stands, over whole texts.

    wanted is broadcast if its counted rows are few; otherwise all terms are counted,
    then joined. Tasks sum up before the shuffle either way.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)))
    stems = F.array_distinct(F.transform(words, lambda w: F.concat(F.substring(w, 1, STEM), F.lit("*"))))
    terms = docs.select(F.explode(F.concat(words, stems)).alias("term"))
    if (rows := wanted.count()) * TERM_BYTES <= BROADCAST_BYTES:
        return terms.join(small_or_shuffled(wanted, rows, TERM_BYTES), "term").groupBy("term").agg(F.count("*").alias("df"))
    return terms.groupBy("term").agg(F.count("*").alias("df")).join(wanted, "term")


def disclosing(docs: DataFrame, alpha: float = ALPHA, discount: float = DISCOUNT) -> DataFrame:
    """doc_id, terms: the document's (term, shown) pairs that disclose an entity it mentions; shown replaces the term ('' removes).

    A document's terms are looked up, not an entity's, so that nobody's terms are listed in one row:
    a document's list is never longer than its text. As PMI > ALPHA * IC means that more than
    (df(c) / N) ** (1 - ALPHA) of a term's documents show it near the entity, a term has few entities.
    """
    near = written(contexts(docs), "contexts")
    n = docs.count()
    mentions = near.where("entity <> '' and term = ''")
    frequent = mentions.groupBy("entity").agg(F.count("*").alias("df_c"))
    stem = F.concat(F.substring("term", 1, STEM), F.lit("*"))
    terms = near.where("entity <> '' and term <> ''")
    pairs = terms.groupBy("entity", "term").agg(F.count("*").alias("n_ct"))
    pairs = written(pairs.join(frequent, "entity").withColumn("stem", stem), "together")
    stems = terms.select("doc_id", "entity", stem.alias("stem")).distinct().groupBy("entity", "stem").agg(F.count("*").alias("n_cs"))
    wanted = written(pairs.select("term").union(pairs.select("stem")).distinct(), "wanted")
    df = written(frequencies(docs, wanted), "frequencies")
    pmi = lambda both, of: F.log2((F.col(both) - F.lit(discount)) * F.lit(float(n)) / (F.col("df_c") * F.col(of)))
    most = F.lit(alpha) * F.log2(F.lit(float(n)) / F.col("df_c"))
    judged = (
        pairs.join(df.withColumnRenamed("df", "df_t"), "term")
        .where((pmi("n_ct", "df_t") > most) & (most > 0))
        .join(df.select(F.col("term").alias("stem"), F.col("df").alias("df_s")), "stem")
        .join(stems, ["entity", "stem"])
        .select("entity", "term", F.when(pmi("n_cs", "df_s") <= most, F.col("stem")).otherwise(F.lit("")).alias("shown"))
    )
    judged = written(judged, "judged")
    standing = near.where("entity = ''").select("doc_id", "term").distinct()
    found = standing.join(small_or_shuffled(judged, judged.count(), TERM_BYTES), "term")
    hits = found.join(mentions.select("doc_id", "entity"), ["doc_id", "entity"], "left_semi")
    return hits.groupBy("doc_id").agg(F.collect_set(F.struct("term", "shown")).alias("terms"))


def _marks(docs: DataFrame, alpha: float, discount: float) -> DataFrame:
    """docs with the column __terms: disclosing terms and what is shown."""
    marked = disclosing(docs, alpha, discount).select(F.col("doc_id").alias("__id"), F.col("terms").alias("__terms"))
    marked = written(marked, "marked")
    terms = marked.agg(F.sum(F.size("__terms") + 1)).first()[0] or 0
    return docs.join(small_or_shuffled(marked, terms, TERM_BYTES), F.col("doc_id").cast("bigint") == F.col("__id"), "left").drop("__id")


def _shown(terms: list[dict] | None) -> dict[str, str]:
    """What is shown for each term; of several, the first in order."""
    out: dict[str, str] = {}
    for pair in terms or ():
        out[pair["term"]] = min(pair["shown"], out.get(pair["term"], pair["shown"]))
    return out


def term_spans(text: str, spans: list[tuple[int, int, int]], terms: dict[str, str]) -> list[tuple[int, int, int]]:
    """Spans of disclosing terms that lie in no base span."""
    out = []
    taken = [(a, b) for a, _, b in spans]
    at = reach = 0
    for m in _TERM.finditer(text):
        while at < len(taken) and taken[at][0] < m.end():
            reach = max(reach, taken[at][1])
            at += 1
        if m.start() >= reach and m[0].lower() in terms:
            out.append((m.start(), 4, m.end()))
    return out


def scan(docs: DataFrame, alpha: float = ALPHA, discount: float = DISCOUNT) -> DataFrame:
    """doc_id, counts of the base kinds, base (listed), spans (listed), n_terms."""
    schema = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base string, spans string, n_terms bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = []
            for doc_id, text, terms in zip(*(batch[k].to_pylist() for k in ("doc_id", "text", "__terms")), strict=True):
                spans = base_spans(text) if text else []
                added = term_spans(text, spans, _shown(terms)) if terms and text else []
                counts = [sum(kind == k for _, kind, _ in spans) for k in range(4)]
                rows.append((doc_id, *counts, listed(spans), listed(sorted([*spans, *added])), len(added)))
            kinds = (*[pa.int64()] * 5, pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    marked = _marks(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), alpha, discount)
    return marked.select("doc_id", "text", "__terms").mapInArrow(run, schema)


def sanitise(docs: DataFrame, alpha: float = ALPHA, discount: float = DISCOUNT) -> DataFrame:
    """docs with base spans replaced by <KIND>, disclosing terms generalised or removed."""
    names, schema = docs.columns, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out = []
            for text, terms in zip(batch["text"].to_pylist(), batch["__terms"].to_pylist(), strict=True):
                if text:
                    shown = _shown(terms)
                    spans = base_spans(text)
                    parts, at = [], 0
                    for start, kind, end in sorted([*spans, *term_spans(text, spans, shown)]):
                        if start >= at:
                            parts += [text[at:start], f"<{KINDS[kind].upper()}>" if kind < 4 else shown[text[start:end].lower()]]
                        at = max(at, end)
                    text = "".join([*parts, text[at:]])
                out.append(text)
            columns = [pa.array(out, pa.string()) if k == "text" else batch[k] for k in names]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return _marks(docs, alpha, discount).mapInArrow(run, schema)
