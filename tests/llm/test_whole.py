"""Operators do the whole job where a bound once cut it short."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from covenant.llm import mixing, pii, quality, queries, secrets
from covenant.llm._common import FOLDED, word_hashes


def plain_count(doc_id, rate):
    """Sum of draws at most DRAW_RATE each, in plain Python."""
    draws, total = int(np.ceil(rate / mixing.DRAW_RATE)), 0
    for k in range(draws):
        name = f"{mixing.SEED}:{doc_id}" + (f":{k}" if k else "")
        u = int(hashlib.md5(name.encode()).hexdigest()[:13], 16) / 2**52
        n, p = 0, np.exp(-rate / draws)
        c = p
        while c <= u:
            n += 1
            p *= rate / draws / n
            c += p
        total += n
    return total


def test_mixing_meets_weights_of_tiny_sources(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 10, "tiny").otherwise("large").alias("source"))
    out = mixing.replicate(docs)
    share = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(share["tiny"] - 10_000) < 500 and abs(share["large"] - 10_000) < 500
    got = {r.doc_id: (r.n, r.copies) for r in out.where("source = 'tiny'").groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("copy").alias("copies")).collect()}
    assert got == {k: (n, n) for k in range(10) if (n := plain_count(k, 1000.0))}


def test_pii_terms_go_wherever_they_stand(spark):
    far = "one two three four five six seven eight nine ten"
    rows = [(k, f"ordinary words zanzibar joe.smith@mail.example.com after these words {k}") for k in range(5)]
    rows += [(5, f"joe.smith@mail.example.com {far} then Zanzibar again"), (6, f"words about zanzibar {far} without the address")]
    rows += [(k, "ordinary words before and after these words again") for k in range(7, 80)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = {r.doc_id: r for r in pii.scan(docs).collect()}
    at = rows[5][1].index("Zanzibar")
    assert all("term:15:23" in out[k].spans for k in range(5)) and f"term:{at}:{at + 8}" in out[5].spans
    assert out[6].n_terms == 0 and all(out[k].spans == "" for k in range(7, 80))
    assert "anzibar" not in pii.sanitise(docs).where("doc_id = 5").first().text


def test_pii_context_has_no_limit_of_characters():
    text = f"Zanzibar {'x' * 500} joe@mail.example.com {'y' * 500} Timbuktu a b c d Marrakesh beyond"
    [(_, terms)] = pii._near(text, pii.base_spans(text))
    assert {"zanzibar", "timbuktu", "x" * 500, "y" * 500} <= terms and "beyond" not in terms and "marrakesh" not in terms
    glued = "clean" + ",a@b.cd" * 20_000 + ",clean2 later"
    assert len(list(pii._near(glued, pii.base_spans(glued)))) >= 1


def test_pii_terms_of_every_script(spark):
    for word in ("अन्तर्राष्ट्रीय", "cafe\u0301teria", "Zürichsee"):
        rows = [(k, f"ordinary words {word} joe.smith@mail.example.com after these words {k}") for k in range(5)]
        rows += [(k, "ordinary words before and after these words again") for k in range(5, 80)]
        out = {r.doc_id: r.spans for r in pii.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
        assert all(f"term:15:{15 + len(word)}" in out[k] for k in range(5)) and all(out[k] == "" for k in range(5, 80))


def plain_disclosing(texts):
    """(doc_id, term, shown) by counting everything in plain Python."""
    n, near, df, terms = len(texts), Counter(), Counter(), {}
    df_c, near_stems, mentioned = Counter(), Counter(), {}
    for k, text in texts.items():
        terms[k] = {t.lower() for t in re.findall(r"[^\W\d_]{4,}", text or "")}
        df.update(terms[k])
        df.update({t[:3] + "*" for t in terms[k]})
        mentioned[k] = dict(pii._near(text, pii.base_spans(text))) if text else {}
        for c, own in mentioned[k].items():
            df_c[c] += 1
            near.update((c, t) for t in own)
            near_stems.update({(c, t[:3] + "*") for t in own})
    out, bits = set(), lambda both, c, of: math.log2((both - 0.5) * n / (df_c[c] * of))
    for k, own in mentioned.items():
        for c in own:
            most = 0.8 * math.log2(n / df_c[c])
            for t in terms[k]:
                if (c, t) in near and bits(near[c, t], c, df[t]) > most > 0:
                    stem = t[:3] + "*"
                    out.add((k, t, stem if bits(near_stems[c, stem], c, df[stem]) <= most else ""))
    return out


def test_pii_terms_match_a_plain_version(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null")
    want = plain_disclosing({r.doc_id: r.text for r in docs.collect()})
    got = {(r.doc_id, t.term, t.shown) for r in pii.disclosing(docs).collect() for t in r.terms}
    assert got == want and len({k for k, _, _ in want}) > 8


def test_pii_rare_name_by_an_address_of_one_document(spark):
    rows = [(0, "call zanzibar of the office joe.smith@mail.example.com before these words")]
    rows += [(k, f"call the office before these words again about other matters {k}") for k in range(1, 400)]
    out = {r.doc_id: r.spans for r in pii.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert "term:5:13" in out[0] and "term:0:4" not in out[0] and all(out[k] == "" for k in range(1, 400))


def test_pii_shared_address_with_many_terms(spark):
    # each mention's own rare word is marked in its document, and no list holds the words of all
    rows = [(k, f"call {'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}{'uvwxyzabcd'[k // 100]}zzq joe.smith@mail.example.com") for k in range(300)]
    rows += [(k, "call the office before these words again") for k in range(300, 1200)]
    out = {r.doc_id: r for r in pii.scan(spark.createDataFrame(rows, "doc_id bigint, text string"), alpha=0.4).collect()}
    assert all(out[k].n_terms == 1 for k in range(300)) and all(out[k].n_terms == 0 for k in range(300, 1200))


def test_quality_scores_match_a_plain_version(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labelled = queries.trusted_ids(spark, sf_dir)
    sample = quality.sampled(labelled).collect()
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert {r.doc_id for r in sample if r.good} == {k for k, v in labels.items() if v == (1, 0)}
    assert {r.doc_id for r in sample if not r.good} == {k for k, v in labels.items() if v[0] == 0}
    assert all(r.held_out for r in sample if not r.good) and 0.1 < np.mean([r.held_out for r in sample if r.good]) < 0.3
    fitted = {r.doc_id for r in sample if not r.held_out}
    texts = {r.doc_id: r.text for r in docs.collect() if r.text}
    size = quality.cells_for(sum(len(t.encode()) for t in texts.values()))
    cells = {k: quality._buckets(word_hashes([t.encode()], FOLDED)[0][0], size).tolist() for k, t in texts.items()}
    raw, good = Counter(), Counter()
    for k, own in cells.items():
        raw.update(own)
        good.update(own if k in fitted else ())
    n, m = raw.total() + size, good.total() + size
    scores, rows = {}, quality.judge(docs, labelled).where("n_words > 0").collect()
    for r in rows:
        own = cells[r.doc_id]
        scores[r.doc_id] = sum(math.log((good[c] + 1) / m) - math.log((raw[c] + 1) / n) for c in own) / len(own)
        assert abs(r.score - scores[r.doc_id]) < 1e-5
    passed = {r.doc_id for r in rows if not r.base_failed}
    of = lambda kind: [scores[r.doc_id] for r in sample if r.held_out and r.good == kind and r.doc_id in passed]
    least = quality.between(of(True), of(False))
    assert all(r.kept == (not r.base_failed and scores[r.doc_id] >= least) for r in rows if abs(scores[r.doc_id] - least) > 1e-5)


def test_quality_threshold():
    assert quality.between([], [1.0]) == -math.inf
    assert quality.between([1.0, 2.0, 3.0], []) == 0.0
    assert quality.between([0.0, 1.0], [-2.0, -1.0]) == -0.5
    # one bad document in twenty that scores among the good ones doesn't cost a good one in a hundred
    assert quality.between([x / 100 for x in range(100)], [0.005] + [-1.0] * 19) == -0.5
    # where most bad ones score like the lowest of many good ones, that good one goes
    assert 0.0 < quality.between([0.0, *[1 + x / 1000 for x in range(999)]], [0.1] * 9 + [-1.0]) < 1.0


def test_quality_cells_follow_the_corpus():
    sizes = [quality.cells_for(x) for x in (0, 10**6, 10**8, 10**10, 10**14)]
    assert sizes == sorted(sizes) and sizes[0] == 1024 and sizes[-1] == 1 << 25


def test_markov_spans_match_a_plain_version(spark):
    random = np.random.default_rng(11)
    made = [(10**9 + k, f"see {''.join(random.choice(list(secrets.ALPHABET), 24))} and an_ordinary_identifier_name here") for k in range(40)]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame(made, "doc_id bigint, text string"))
    labelled = secrets.samples(docs)
    model = secrets.train(labelled)
    counts = {label: Counter() for label in ("random", "ordinary")}
    for r in labelled.collect():
        counts[r.label].update(a + b for a, b in zip(r.value, r.value[1:], strict=False) if a in secrets.ALPHABET and b in secrets.ALPHABET)
    size = len(secrets.ALPHABET)

    def log(label, a, b):
        return math.log((counts[label][a + b] + 0.5) / (sum(counts[label][a + c] for c in secrets.ALPHABET) + 0.5 * size))

    for pair in ("aB", "th", "9x", "--"):
        at = secrets.ALPHABET.index(pair[0]) * size + secrets.ALPHABET.index(pair[1])
        assert abs(model[at] - (log("random", *pair) - log("ordinary", *pair))) < 1e-3
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = 0
    for r in secrets.scan(docs, model).collect():
        base = [(s.start, s.end) for s in r.spans if s.kind < 3]
        want = []
        for m in re.finditer(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}", texts[r.doc_id] or ""):
            token = m[0]
            gain = sum(model[secrets.ALPHABET.index(a) * size + secrets.ALPHABET.index(b)] for a, b in zip(token, token[1:], strict=False)) / (len(token) - 1)
            if re.search("[A-Za-z]", token) and gain >= secrets.THRESHOLD and not any(a < m.end() and m.start() < b for a, b in base):
                want.append((m.start(), m.end()))
        assert sorted((s.start, s.end) for s in r.spans if s.kind == 3) == want
        found += len(want)
    assert found
