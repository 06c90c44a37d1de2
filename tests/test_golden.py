"""Hand-derived cases of the sequential algorithms."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from covenant.functions import text as t
from covenant.functions import vocab
from covenant.operators import analyze, cascade, chunking, enrich, ranking, vectors
from covenant.sources import corpus
from covenant.streaming import ingest


def merged(spark, rows):
    chunks = spark.createDataFrame([(1, k + 1, kind, n, f"h{k + 1}") for k, (kind, n) in enumerate(rows)], "doc_id bigint, pos bigint, type string, word_count bigint, header string")
    return sorted((r.first, r.last, r.type, r.word_count, r.header) for r in chunking.merge_small(chunks).collect())


def test_pair_merge(spark):
    got = merged(spark, [("section", n) for n in (5, 5, 5, 100, 5, 5)])
    assert [x[:2] for x in got] == [(1, 2), (3, 4), (5, 6)]


def test_types_that_merge(spark):
    assert merged(spark, [("preamble", 5), ("section", 9)]) == [(1, 2, "preamble", 14, "h1 & h2")]
    assert len(merged(spark, [("section", 5), ("preamble", 5)])) == 2
    assert len(merged(spark, [("article", 5), ("subsection", 5)])) == 1 and len(merged(spark, [("subsection", 5), ("section", 5)])) == 2
    assert len(merged(spark, [("critical_exhibit", 5), ("critical_exhibit", 5)])) == 2 and len(merged(spark, [("section", 5), ("gap_between", 5)])) == 2
    assert len(merged(spark, [("section", 29), ("section", 91)])) == 2 and len(merged(spark, [("section", 29), ("section", 90)])) == 1


def headings(spark, *lines):
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "k int, line string")
    kind, header = chunking.heading(F.col("line"))
    return [tuple(r) for r in rows.orderBy("k").select(kind, header).collect()]


def test_headings(spark):
    got = headings(spark, "ARTICLE 1", "Article 2: Rent", "IV. Term", "Section 2.1 Area", "7)", "(a) Fees", "GENERAL CONDITIONS", "Notices:", "Payment Schedule", "Rent is due monthly.", "12 is a number.", "plain words here", "")
    assert got == [
        ("article", "ARTICLE 1"), ("article", "ARTICLE 2 - Rent"), ("section", "IV - Term"), ("section", "Section 2.1 - Area"), ("section", "Section 7"), ("subsection", "(a) Fees"),
        ("section", "GENERAL CONDITIONS"), ("section", "Notices"), ("section", "Payment Schedule"), ("section", "Rent is due monthly"), ("section", "Section 12 - is a number"), (None, None), (None, None),
    ]


def test_parties_by_type_and_between(spark):
    rows = [
        ("lease", "Landlord: Acme Holdings LLC\nTenant: Beta Stores Inc. x"), ("management", "The Management Company Gamma Care Limited runs it"), ("financing", "the bank First Credit Union lends; debtor Delta Works Corp. owes"),
        ("purchase", "Landlord Acme Holdings LLC"), ("development", "made BETWEEN Old Town Trust of the one part AND New Town Bank (both)"),
    ]
    docs = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, kind string, text string")
    found = enrich.parties(F.col("text"), F.col("kind"))
    got = [{k: v for k, v in r.asDict().items() if v is not None and k != "k"} for r in docs.select("k", *[v.alias(n) for n, v in found.items()]).orderBy("k").collect()]
    assert got == [
        {"lessor": "Acme Holdings LLC", "lessee": "Beta Stores Inc."}, {"manager": "Gamma Care Limited"}, {"lender": "First Credit Union", "borrower": "Delta Works Corp."}, {}, {"party_1": "Old Town Trust", "party_2": "New Town Bank"},
    ]


def test_legal_references(spark):
    docs = spark.createDataFrame([("Clause 5 and Section 2, Paragraph 1.3, Art. 9",)], "text string")
    assert docs.select(enrich.entities(F.col("text"), "legal_refs")).first()[0] == ["Art. 9", "Clause 5", "Paragraph 1.3", "Section 2"]


def test_dates_of_several_forms(spark):
    rows = ["dated March 3, 2001", "signing date Sept 4 2002", "effective as of Dec 1 2003", "executed on no date", "effective Foo 12, 2001"]
    docs = spark.createDataFrame([(k, x) for k, x in enumerate(rows)], "k int, text string")
    assert [r[0] for r in docs.orderBy("k").select(enrich.dated(F.col("text"), "effective_date")).collect()] == ["2001-03-03", "2002-09-04", "2003-12-01", None, None]


def test_company_roles(spark):
    docs = spark.createDataFrame([(1, "Acme Holdings LLC", "Beta Stores Inc."), (2, "The Beta Stores Inc. Group", None), (3, "x", "y")], "doc_id int, lessor string, lessee string")
    names = spark.createDataFrame([("Beta Stores",), ("Acme Holdings LLC",), ("acme holdings",)], "name string")
    assert sorted(map(tuple, enrich.roles(names, docs).collect())) == [("Acme Holdings LLC", "Lessor", 1), ("Beta Stores", "Lessor", 2), ("acme holdings", "Lessor", 1)]


def test_filters_and_fixed_fields(spark):
    assert analyze.valid_filter(None) == {} and analyze.valid_filter({"additionalProp1": {}}) == {} and analyze.valid_filter("x") == {} and analyze.valid_filter({"a": 1}) == {"a": 1}
    pattern, groups = t.named_groups(r"(?P<lease>A\(\d+)-(?:x|(y))(?P<num>\d)")
    assert pattern == r"(A\(\d+)-(?:x|(y))(\d)" and groups == {"lease": 1, "num": 3}
    row = spark.range(1).select(corpus.cik10(F.lit("CIK 320193")).alias("a"), corpus.cik10(F.lit("12345678901")).alias("b"), corpus.filing_folder("u", F.lit("0000320193"), F.lit("1-2-3")).alias("c")).first()
    assert tuple(row) == ("0000320193", "12345678901", "u/320193/123")


def test_counted_phrases(spark):
    phrases = ["rent", "rental", "monthly rent", "rental agreement", "area"]
    text = "monthly rental agreement, rent and arearea"
    want = sum(text.count(p) for p in phrases)
    assert spark.createDataFrame([(text,)], "x string").select(t.counted(F.col("x"), phrases)).first()[0] == want == 6


def test_diversity_keeps_all_when_few(spark):
    hits = spark.createDataFrame([(1, k, "d", "h") for k in range(1, 6)], "qid int, rank int, doc string, header string")
    assert ranking.diverse(hits, 2, ["doc", "header"]).count() == 2
    assert ranking.diverse(hits, 5, ["doc", "header"]).count() == 5


def test_gaps(spark):
    ranges = spark.createDataFrame([(1, a, b) for a, b in ((10, 50), (40, 80), (120, 200), (90, 90), (95, 91))] + [(2, 5, 5)], "doc_id int, start bigint, end bigint")
    docs = spark.createDataFrame([(1, "x" * 225 + " " * 35), (2, "y" * 99)], "doc_id int, text string")
    assert sorted((r.gap_start, r.gap_end, r.gap_type, len(r.text)) for r in chunking.gaps(ranges, docs).collect()) == [(80, 120, "between", 40), (200, 260, "trailing", 25)]


def test_mmr_bounds_and_first_pick(spark):
    pool = spark.createDataFrame([(1, [1.0, 0.0], k, [1.0, k / 10], k + 1) for k in range(10)], "qid bigint, qvec array<double>, vec_id bigint, embedding array<double>, rank bigint")
    assert vectors.mmr(pool, 8, legacy_bound=True).count() == 5
    got = vectors.mmr(pool, 8).collect()
    assert len(got) == 8 and min(got, key=lambda r: r.pick).vec_id == 0


def test_snapped_windows_cover():
    text = "One sentence here. " * 300
    spans = list(chunking.snap(text, 1200, 400))
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(a < c <= b for (a, b), (c, _) in zip(spans, spans[1:], strict=False))


def test_clamp_of_nan(spark):
    assert spark.range(1).select(vectors.clamped(F.lit(float("nan")))).first()[0] == 0


def test_toc_needs_space_after_page_number(spark):
    pages = spark.createDataFrame([(1, "1. Rent ..... 12\n2. Term ..... 14\n\n3. Use .... 15")], "doc_id int, text string")
    assert [(r.number, r.title, r.page) for r in chunking.toc_entries(pages).collect()] == [("2", "Term", 14)]


def test_toc_entry_types_and_order(spark):
    text = 'ARTICLE 3 - Use....9\n\nExhibit "B" Map\n\n1. Rent ..... 2\n\n1. RENT ..... 7\n\nSchedule of Exhibits ..... 8\n\n'
    got = [(r.n, r.number, r.title, r.page, r.type) for r in chunking.toc_entries(spark.createDataFrame([(1, text)], "doc_id int, text string")).orderBy("n").collect()]
    assert got == [(1, "B", "Map", 0, "exhibit"), (2, "1", "Rent", 2, "section"), (3, "", "Schedule of Exhibits", 8, "exhibit"), (4, "", "ARTICLE 3 - Use", 9, "article"), (5, "3", "Use", 9, "article")]


def chunks_of(spark, *pages):
    rows = spark.createDataFrame([(1, k, p) for k, p in enumerate(pages, 1)], "doc_id bigint, page_no bigint, text string")
    return sorted(cascade.cascade(rows).collect(), key=lambda r: r.chunk_index)


WORDS = " ".join(f"w{k}" for k in range(40))


def test_cascade_by_table_of_contents(spark):
    toc = "Table of Contents\n1. Rent ..... 2 \n\n2. Term ..... 2 \n\n3. Notices ..... 3 \n\n"
    got = chunks_of(spark, toc, f"1. Rent\n{WORDS}\n2. Term\n{WORDS} {WORDS} {WORDS}", f"{WORDS}\n3. Notices\n{WORDS} {WORDS}")
    # every entry is found first in the table itself, so the last one's chunk takes the whole body
    assert {r.strategy for r in got} <= {"toc_based", "structure_based", "structure_based_with_gap_recovery"}
    assert [r.id for r in got] == [f"1_{k}" for k in range(len(got))] and {r.total_chunks for r in got} == {len(got)}


def test_cascade_by_headings_with_gaps(spark):
    body = f"{WORDS}\nARTICLE 1 - RENT\n{WORDS}\nARTICLE 2\nextraordinarily-long-two wordsthatgoonandon\nARTICLE 3 - END\n{WORDS}"
    got = chunks_of(spark, body)
    assert {r.strategy for r in got} == {"structure_based"}
    assert [(r.chunk_type, r.header) for r in got] == [("preamble", "DOCUMENT_START"), ("article", "ARTICLE 1 - RENT"), ("article", "ARTICLE 2 & ARTICLE 3 - END")]
    assert got[1].content.startswith("ARTICLE 1") and body[got[1].start : got[1].end].strip() == got[1].content and got[0].coverage > 0.95
    short = f"{WORDS}\n{WORDS}\nARTICLE 1 - unquestionablylongtitle\nARTICLE 2 - END\n{WORDS}\nARTICLE 3 - MORE\n{WORDS}"
    dropped = chunks_of(spark, short.replace("ARTICLE 1 - unquestionablylongtitle", "Unquestionablylongtitle:"))
    assert ("gap_between", "Unquestionablylongtitle:") in {(r.chunk_type, r.content) for r in dropped} and {r.strategy for r in dropped} == {"structure_based_with_gap_recovery"}


def test_cascade_windows_for_few_chunks(spark):
    got = chunks_of(spark, "a plain text of words " * 120)
    assert {r.strategy for r in got} == {"few_chunks"} and {r.chunk_type for r in got} == {"comprehensive_window"} and {(r.page_start, r.page_end) for r in got} == {(1, 1)}
    assert [(r.start, r.end) for r in got] == list(chunking.snap("a plain text of words " * 120, 1200, 400))


def plain_critical(text):
    """Matches in order of pattern and place, widened to line ends; kept unless more than half is covered by one that was kept."""
    import re

    kept = []
    for kind, pattern in vocab.CRITICAL:
        for m in re.finditer(pattern, text, re.M | re.S):
            a, b = max(0, m.start() - 500), min(len(text), m.end() + 1000)
            a = max(text.rfind("\n", 0, a + 1), text.rfind("\f", 0, a + 1), 0)
            ends = [x for x in (text.find("\n", b), text.find("\f", b)) if x >= 0]
            b = min(ends, default=len(text))
            if len(text[a:b].strip()) > 50 and not any(min(b, y) - max(a, x) > 0.5 * max(1, b - a) for x, y, _ in kept):
                kept.append((a, b, f"critical_{kind}"))
    return kept


def test_critical_passages(spark):
    filler = "\n".join(" ".join(f"w{j}x{k}" for k in range(12)) for j in range(120))
    text = f"{filler}\nIN WITNESS WHEREOF we sign\nSignature Page\n{filler}\nbetween us and\nthem (both) Exhibit A-1\f{filler}\nDefinitions: none\n{filler} recital"
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, start bigint, end bigint")
    got = [(r.start, r.end, r.type) for r in cascade.new_critical(cascade.critical(docs), none).orderBy("k").collect()]
    assert got == plain_critical(text) and len(got) >= 3
    cover = spark.createDataFrame([(1, 0, got[0][1])], "doc_id bigint, start bigint, end bigint")
    assert got[0] not in [(r.start, r.end, r.type) for r in cascade.new_critical(cascade.critical(docs), cover).collect()]


def test_pages_from_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one|two Page 2 of 9|")
    (tmp_path / "broken.pdf").write_bytes(b"!")

    def decode(content):
        if content == b"!":
            raise ValueError
        return [x or None for x in content.decode().split("|")]

    assert sorted(map(tuple, corpus.pdf_pages(spark, str(tmp_path), decode).collect())) == [("a", 1, "one"), ("a", 2, "two"), ("a", 3, "")]


def test_conversation_tables(spark, tmp_path):
    corpus.add_messages(spark, str(tmp_path), spark.createDataFrame([(1, "user", "x" * 9, 1.0)], "conv_id int, role string, content string, created_at double"))
    for text, at in (("old", 1.0), ("new", 2.0)):
        corpus.set_summaries(str(tmp_path), spark.createDataFrame([(1, text, at)], "conv_id int, summary string, updated_at double"))
    assert spark.read.parquet(f"{tmp_path}/messages").first().tokens == 2 and [r.summary for r in corpus.summaries(spark, str(tmp_path)).collect()] == ["new"]


def test_more_queries_than_a_block(spark):
    rng = np.random.default_rng(1)
    vectors_ = [(k, [float(x) for x in rng.normal(size=4)]) for k in range(60)]
    rows = spark.createDataFrame(vectors_, "vec_id bigint, embedding array<double>")
    asked = rows.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    want = {q: [k for _, k in sorted((-round(float(np.dot(a, b)), 6), k) for k, b in vectors_)[:3]] for q, a in vectors_}
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(vectors, "QUERY_BLOCK", 7)
        patch.setattr(vectors, "VECTOR_ROWS", 5)
        got = vectors.top_k(asked, rows, 3).collect()
    assert {q: [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.qid == q] for q in want} == want


def test_jsonl_source(spark, tmp_path):
    lines = [json.dumps({"id": "a", "text": "x"}), "", "not json", json.dumps({"chunk_id": "b", "content": "y"}), json.dumps({"text": "z"})]
    (tmp_path / "doc.jsonl").write_text("\n".join(lines))
    assert sorted((r.id, r.text) for r in corpus.jsonl_chunks(spark, str(tmp_path)).collect()) == [("a", "x"), ("b", "y"), ("doc_2", "z")]


def test_chunk_writer_round_trip(spark, tmp_path):
    chunks = spark.createDataFrame([("d1", "d1_0", "a\0b", "{}")], "doc_id string, id string, content string, metadata string")
    corpus.write_chunks(chunks, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first().content == "ab"


def test_filings_are_cut_to_the_shortest_array(spark):
    recent = {"accessionNumber": ["1", "2"], "form": ["10-K", "8-K"], "filingDate": ["2020-01-01", "2020-02-01"], "reportDate": ["2019-12-31"], "primaryDocument": ["a.htm"]}
    df = spark.read.json(spark.sparkContext.parallelize([json.dumps({"filings": {"recent": recent}})]))
    assert [r.accessionNumber for r in corpus.recent_filings(df).collect()] == ["1"]


def test_streaming_upsert(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "table")
    source.mkdir()
    for k, text in enumerate(("old", "new")):
        (source / f"{k}.jsonl").write_text(json.dumps({"id": "a", "text": text, "metadata": "{}"}))
        ingest.ingest(spark, str(source), target, str(tmp_path / "checkpoint")).awaitTermination()
    assert [r.text for r in ingest.read_latest(spark, target).collect()] == ["new"]
