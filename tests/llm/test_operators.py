"""The corpus operators against plain versions, and their edge cases."""

import hashlib
import importlib
import itertools
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from covenant.llm import avi, jaccard, langid, licenses, mixing, packing, pii, quality, queries, secrets, urls
from covenant.llm._common import EXACT, word_hashes

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, kept string"
CARD = "4539578763621486"


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, blank, very long, ties, repeated rows and clashing names."""
    long = "word " * 20_000 + "x" * 300_000
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n", "en", "a", 3), (4, long, "en", "a", len(long)), (5, "same text here now ok", "fr", "b", 21), (5, "same text here now ok", "fr", "b", 21), (6, "same text here now ok", "fr", "b", 21), (None, "no id at all", None, "b", 12)]
    return spark.createDataFrame([(*r, 0.5, "x") for r in rows], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def tokenizer():
    return queries.tokenizer_path()


def test_every_operator_takes_odd_and_empty_tables(spark, odd, empty, sf_dir):
    trusted = spark.createDataFrame([(5,), (None,)], "doc_id bigint")
    for docs in (odd, empty):
        n = docs.count()
        ids = docs.where("doc_id is not null").select("doc_id").distinct().count()
        assert pii.scan(docs).count() == n
        assert set(pii.sanitise(docs).columns) == set(docs.columns)
        assert quality.judge(docs, trusted).count() == n
        assert quality.keep(docs, trusted).columns == docs.columns
        assert langid.predict(docs, langid.train(docs.select("text", "lang"))).count() == n
        assert avi.round_trip(docs).count() == n
        assert mixing.replicate(docs).columns[: len(docs.columns)] == docs.columns
        assert packing.pack(docs, tokenizer()).select("sequence_id").distinct().count() <= max(n, 1) * 400
        assert jaccard.components(docs).count() == ids
        assert jaccard.deduplicate(docs).columns == docs.columns
        assert licenses.scan(docs).count() == 0
        model = secrets.train(secrets.samples(docs))
        assert secrets.scan(docs, model).count() == n
        assert secrets.redact(docs, model).columns == docs.columns
    pages = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (2, "", "y"), (3, "a://H.NET/de/81?q#f", "z"), (4, "no scheme", None), (None, "x://", "")], "page_id bigint, url string, rule string")
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")
    got = [tuple(r) for r in urls.judge(pages, rules).where("page_id >= 3").orderBy("page_id").collect()]
    assert got == [(3, "h.net", "/de/81", "net/de/", "block"), (4, "", "", None, "allow")]
    assert urls.judge(pages, rules).count() == 6 and urls.judge(pages.limit(0), rules).count() == 0


def plain_pii(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([ -]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        total = sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(d[::-1]))
        if 14 <= len(d) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][ ().0-9-]+[0-9]", text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_pii_base_spans(spark, sf_dir, texts):
    more = ["a@b.c_d@e.f+1@@x@y.z.", "1.2.3.4.5.6.7.8 300.1.1.1 0255.1.1.1", f"{CARD[:4]}-{CARD[4:8]} {CARD[8:]}+1 (988) 555-2485", "é" * 5 + "x@y.zz +12345678901234567"]
    for text in [*texts.values(), *more]:
        assert pii.base_spans(text) == plain_pii(text)
    got = {r.doc_id: r.base for r in pii.scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()}
    assert got == {k: pii.listed(plain_pii(v)) for k, v in texts.items()}


def test_pii_terms_that_reveal_an_entity(spark):
    rows = [(k, f"ordinary words before zanzibar joe.smith@mail.example.com after these words {k}") for k in range(5)] + [(k, "ordinary words before and after these words again") for k in range(5, 80)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = {r.doc_id: r for r in pii.scan(docs).collect()}
    assert all("term:22:30" in out[k].spans for k in range(5)) and all(out[k].spans == "" for k in range(5, 80))
    clean = pii.sanitise(docs).where("doc_id = 0").first().text
    assert "<EMAIL>" in clean and "zanzibar" not in clean and "ordinary" in clean


def plain_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    times = Counter(grams)
    inside = {k + j for k, g in enumerate(grams) if times[g] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


def test_quality_base_counts(spark, sf_dir, texts):
    rows = queries.op2_quality(spark, sf_dir).collect()
    for r in rows:
        n, chars, symbols, dup, repeated = plain_quality(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == (n, chars, symbols, dup)
        assert repeated == r.n_repeat_words
        assert r.base_failed == (n < 50 or 100 * r.n_repeat_words > 50 * n)
        assert not (r.base_failed and r.kept)


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_quality_tells_labelled_documents_apart(spark, size):
    sf_dir = f"/root/testdata/{size}"
    held = quality.sampled(queries.trusted_ids(spark, sf_dir)).where("good and held_out").select("doc_id", "held_out")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").join(held, "doc_id", "left")
    rows = queries.op2_quality(spark, sf_dir).join(labels, "doc_id").where("not base_failed").collect()
    good, bad = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert np.mean(good) > 0.995 and np.mean([r.kept for r in rows if r.held_out]) > 0.98 and np.mean(bad) < 0.05


def test_language_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = queries.op3_language(spark, sf_dir).where("held_out").join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97


def plain_code_length(training, text):
    """Code length of text by a tree kept as dictionaries, byte by byte."""
    tree = {}
    for t in training:
        line = bytes(3) + t
        for at in range(3, len(line)):
            for k in range(4):
                tree.setdefault(line[at - k : at], Counter())[line[at]] += 1
    total, line = 0.0, bytes(3) + text
    for at in range(3, len(line)):
        for k in (3, 2, 1, 0):
            if own := tree.get(line[at - k : at]):
                whole = own.total() + len(own)
                if n := own[line[at]]:
                    total -= np.log2(n / whole)
                    break
                total -= np.log2(len(own) / whole)
        else:
            total += 8
    return total


def test_language_code_lengths_match_plain_trees(spark):
    rows = [("the cat sat on the mat\0 and the dog", "en"), ("le chat est sur le tapis é", "fr"), ("un chien dort", "fr"), ("", "fr"), (None, "fr"), ("no lang", None)]
    model = langid.train(spark.createDataFrame(rows, "text string, lang string"))
    asked = [b"the chat", "é tapis zzz".encode(), b"a", b"cat\0", b"on the mat and " * 50]
    assert model.langs == ["en", "fr"]
    want = [[plain_code_length([t.encode() for t, x in rows if t and x == lang], raw) for lang in model.langs] for raw in asked]
    assert np.allclose(model.lengths(asked), want, rtol=1e-5)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(langid, "CHUNK", 7)
        assert np.allclose(model.lengths(asked), want, rtol=1e-5)


def test_language_keeps_small_languages(spark):
    rows = [(f"words of the large language number {k}", "large") for k in range(300)] + [("qzx", "tiny")]
    docs = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id bigint, text string, lang string")
    assert langid.sample(docs, 100).groupBy("lang").count().where("lang = 'tiny'").first()["count"] == 1
    assert 50 < langid.sample(docs, 100).count() < 160
    model = langid.train(docs)
    assert model.langs == ["large", "tiny"]
    got = langid.predict(spark.createDataFrame([(1, "qzx qzx"), (2, "the words"), (3, "12"), (4, None)], "doc_id bigint, text string"), model).collect()
    assert [r.lang_pred for r in sorted(got)] == ["tiny", "large", "und", "und"]


def test_avi_round_trip(spark, sf_dir, texts):
    for r in queries.op4_avi(spark, sf_dir).collect():
        raw = texts[r.doc_id].encode()
        data = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))
    noise = [np.random.default_rng(k).integers(0, 256, 64 * (k + 1) * 37, dtype=np.uint8).tobytes() for k in range(4)]
    for data, (levels, _, _) in zip(noise, avi.read_clips(avi.encode(noise)), strict=True):
        assert b"".join(x.tobytes() for x in levels)[: len(data)] == data


def test_avi_pixels_and_shots(spark):
    data = bytes([10] * 4096 * 3 + [200] * 4096 * 2)
    file = avi.encode([data])[0]
    frame = avi.read_avi(file)["frames"][0]
    image = avi.pixels(avi.decode_all([frame])[0], 512, 512)
    assert image.shape == (512, 512) and (image == 10).all()
    files = spark.createDataFrame([(1, file), (2, None), (3, b"RIFFxxxxAVI broken")], "k int, content binary")
    got = [(r.k, r.clip, r.first_frame, r.n_frames) for r in avi.clips(files, "k").orderBy("clip").collect()]
    assert got == [(1, 0, 0, 3), (1, 1, 3, 2)]


def test_avi_decodes_ac_coefficients():
    ac_bits, ac_symbols = (0, 2, 1, *[0] * 13), (0x00, 0x02, 0xF0)
    codes_dc, codes_ac = avi.codes(avi.DC_BITS, tuple(range(12))), avi.codes(ac_bits, ac_symbols)
    bits = f"{codes_dc[3][0]:0{codes_dc[3][1]}b}" + "101" + f"{codes_ac[2][0]:0{codes_ac[2][1]}b}" + "11" + f"{codes_ac[0][0]:0{codes_ac[0][1]}b}"
    bits += "1" * (-len(bits) % 8)
    scan = bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8))
    seg = avi._segment
    image = b"\xff\xd8" + seg(0xDB, b"\0" + bytes([2]) * 64) + seg(0xC0, bytes([8, 0, 8, 0, 8, 1, 1, 0x11, 0])) + seg(0xC4, b"\0" + bytes(avi.DC_BITS) + bytes(range(12))) + seg(0xC4, b"\x10" + bytes(ac_bits) + bytes(ac_symbols)) + seg(0xDA, bytes([1, 1, 0, 0, 63, 0])) + scan + b"\xff\xd9"
    assert avi.decode_all([image])[0][0, :3].tolist() == [10, 6, 0]


def colour_frame(luma, chroma, tables=True):
    """A 4:2:0 image of 32x16: DC levels of eight brightness blocks in their order of units, of two blocks of each colour, and one AC value."""
    table = {k: avi.codes(bits, tuple(symbols)) for k, (bits, symbols) in avi.STANDARD_TABLES.items()}
    bits, last = "", [0, 0, 0]

    def block(part, level, ac):
        nonlocal bits
        number = int(part > 0)
        diff, last[part] = level - last[part], level
        size = abs(diff).bit_length()
        code, length = table[number][size]
        bits += f"{code:0{length}b}" + (f"{diff if diff > 0 else diff + (1 << size) - 1:0{size}b}" if size else "")
        for symbol in ([0x02] if ac else []) + [0x00]:
            code, length = table[16 + number][symbol]
            bits += f"{code:0{length}b}" + ("11" if symbol else "")

    for unit in range(2):
        for k in range(4):
            block(0, luma[4 * unit + k], k == 1)
        block(1, chroma[unit], False)
        block(2, -chroma[unit], False)
    bits += "1" * (-len(bits) % 8)
    scan = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0")
    seg = avi._segment
    dht = b"".join(seg(0xC4, bytes([k]) + bytes(b) + s) for k, (b, s) in avi.STANDARD_TABLES.items()) if tables else b""
    frame = seg(0xC0, bytes([8, 0, 16, 0, 32, 3, 1, 0x22, 0, 2, 0x11, 1, 3, 0x11, 1]))
    return b"\xff\xd8" + seg(0xDB, b"\0" + bytes([8]) * 64) + seg(0xDB, b"\1" + bytes([3]) * 64) + frame + dht + seg(0xDA, bytes([3, 1, 0, 2, 0x11, 3, 0x11, 0, 63, 0])) + scan + b"\xff\xd9"


def test_avi_decodes_colour_frames_and_standard_tables(spark):
    luma, chroma = [5, 6, -7, 40, 9, 10, 11, -128], [3, -20]
    for tables in (True, False):
        [coefficients] = avi.decode_all([colour_frame(luma, chroma, tables)])
        # two units beside each other, each two blocks wide: rows of blocks go through both
        assert coefficients[:, 0].tolist() == [8 * x for x in (5, 6, 9, 10, -7, 40, 11, -128)]
        assert coefficients[:, 1].tolist() == [0, 24, 0, 24, 0, 0, 0, 0]
        assert avi.pixels(coefficients, 32, 16).shape == (16, 32)
    dark, light = colour_frame([-100] * 8, chroma, False), colour_frame([90] * 8, chroma, False)
    file = avi.write_avi([dark] * 5 + [light] * 5, 32, 16)
    files = spark.createDataFrame([(1, bytearray(file), "x"), (2, None, "y"), (3, bytearray(b"no"), "z")], "k int, content binary, clip string")
    assert [(r.k, r.clip, r.first_frame, r.n_frames) for r in avi.clips(files, "k").orderBy("clip").collect()] == [(1, 0, 0, 5), (1, 1, 5, 5)]


def test_mixing_rates_and_copies(spark, sf_dir):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, "small").otherwise("large").alias("source"))
    out = mixing.replicate(docs)
    share = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(share["small"] - 10_000) < 700 and abs(share["large"] - 10_000) < 500
    again = mixing.replicate(docs.repartition(7)).groupBy("doc_id").count().exceptAll(out.groupBy("doc_id").count())
    assert again.count() == 0
    u, rate, k, p = 0.93, 2.5, 0, np.exp(-2.5)
    total = p
    while total <= u:
        k += 1
        p *= rate / k
        total += p
    assert spark.range(1).select(mixing.poisson(F.lit(u), F.lit(rate))).first()[0] == k


def test_packing_is_a_packing(spark, sf_dir, texts):
    encode = packing.Encoder(tokenizer())
    plain = encode.tokenizer
    rows = queries.op6_packing(spark, sf_dir).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for doc_id, text in texts.items():
        ids = np.array([*plain.encode(text, add_special_tokens=False).ids, 0], "<u4")
        got = sorted(by_doc[doc_id], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in got] == [(k, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [0, *itertools.accumulate(r.length for r in own)][:-1]
        assert sum(r.length for r in own) <= 2048
    assert len(by_sequence) == packing.lower_bound({n: sum(r.length == n for r in rows) for n in {r.length for r in rows}})


def test_bin_completion_beats_best_fit():
    counts = {6: 1, 5: 2, 4: 1, 3: 3, 2: 2}
    assert sum(t for t, _ in packing.bin_completion(counts, 11)) == packing.lower_bound(counts, 11)
    random = np.random.default_rng(1)
    for _ in range(30):
        counts = {int(k): int(random.integers(1, 4)) for k in random.choice(np.arange(1, 40), 12, replace=False)}
        best = packing.bin_completion(counts, 50, 500)
        assert all(sum(k * v for k, v in f.items()) <= 50 for _, f in best)
        assert {k: sum(t * f.get(k, 0) for t, f in best) for k in counts} == counts
        assert packing.lower_bound(counts, 50) <= sum(t for t, _ in best) <= sum(t for t, _ in packing.best_fit(counts, 50))


def test_odd_texts_are_tokenised_whole():
    encode = packing.Encoder(tokenizer())
    for text in ("a\u00a0b\u2003c", "İSTANBUL ΣΊΣΥΦΟΣ", "x\x1cy <|endoftext|> z", "e\u0301te\u0301 ½² don't", "漢字 and 😂emoji", "ǅ ŉ ÀÉÎ"):
        assert np.frombuffer(encode([text])[0], "<u4").tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids


def plain_components(texts):
    sets = {}
    for k, text in texts.items():
        words = (text or "").translate({c: c + 32 for c in range(65, 91)})
        words = re.findall(r"[^\x20\x09-\x0D]+", words)
        sets[k] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    label = {k: k for k in texts}

    def top(k):
        while label[k] != k:
            k = label[k]
        return k

    for a, b in itertools.combinations(sorted(texts), 2):
        inter = len(sets[a] & sets[b])
        if inter and 100 * inter >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((top(a), top(b)))
            label[y] = x
    return {k: (len(sets[k]), top(k)) for k in texts}


def test_jaccard_components(spark):
    random = np.random.default_rng(5)
    vocabulary = [f"w{k}" for k in range(400)]
    base = [[str(x) for x in random.choice(vocabulary, n)] for n in (6, 8, 9, 15, 20, 40, 60, 120)]
    texts = {}
    for words in base:
        for _ in range(14):
            own = list(words)
            for _ in range(int(random.integers(0, 1 + len(words) // 20 + 1))):
                own[int(random.integers(len(own)))] = str(random.choice(vocabulary))
            if random.random() < 0.4:
                own = own[: -int(random.integers(1, 2 + len(own) // 12))]
            texts[len(texts)] = " ".join(own)
    texts |= {1000: "One two", 1001: "one TWO", 1002: "", 1003: None, 1004: "\t\n"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    want = plain_components(texts)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components(docs).collect()} == want
    heads = {r.doc_id for r in jaccard.deduplicate(docs).collect()}
    assert heads == {k for k, (_, c) in want.items() if k == c}
    # more star rounds before the last one with every list dealt out and all shingles frequent; no small sets and few frequent shingles
    for changed in ({"EASY": 0, "SHARE_ROWS": 2, "FREQUENT_LEAST": 1}, {"MOST_SMALL": 0, "FREQUENT_MOST": 3}):
        with pytest.MonkeyPatch.context() as patch:
            for name, value in changed.items():
                patch.setattr(jaccard, name, value)
            assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components(docs).collect()} == want


def test_jaccard_near_copies_and_shared_passages(spark):
    """A chain of near copies, and documents that mostly consist of one passage but don't link."""
    base = [f"b{k}" for k in range(100)]
    texts = {k: " ".join([*base[: 100 - 2 * k], *(f"n{k}x{j}" for j in range(2 * k))]) for k in range(12)}
    passage = [f"p{k}" for k in range(60)]
    texts |= {100 + k: " ".join([*passage, *(f"o{k}x{j}" for j in range(18 + k % 3))]) for k in range(40)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components(docs).collect()} == plain_components(texts)


def test_jaccard_repeated_ids(spark):
    a, b = "one two three four five six seven", "zero other words that are here now"
    docs = spark.createDataFrame([(1, b), (1, a), (2, b), (3, a), (3, a), (None, a)], "doc_id bigint, text string")
    assert sorted(map(tuple, jaccard.components(docs).collect())) == [(1, 3, 1), (2, 3, 2), (3, 3, 1)]
    assert sorted(((r.doc_id or 0), r.text) for r in jaccard.deduplicate(docs).collect()) == [(0, a), (1, a), (2, b)]


def test_shingle_frequencies(spark, sf_dir, texts):
    from covenant.llm._common import shingle_sets

    want = Counter(x >> 16 for s in shingle_sets([(t or "").encode() for t in texts.values()]) for x in set(s.tolist()))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.shingle: r.n for r in jaccard.frequencies(docs, 3).collect()}
    assert got == {k: n for k, n in want.items() if n >= 3}


def test_connected_long_chain(spark):
    edges = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.label for r in jaccard.connected(edges).collect()} == {0}


def plain_shingles(text):
    edge = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
    words = [w.strip(edge) or w for w in re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))]
    return [tuple(words[k : k + 5]) for k in range(len(words) - 4)]


def plain_licenses(text, templates, percent=80):
    """Templates of whose distinct shingles so many stand in some stretch of the text of twice the template's length."""
    own = plain_shingles(text)
    out = set()
    for name, template in templates.items():
        want = plain_shingles(template)
        size = 2 * len(want)
        if want and any(100 * len(set(want) & set(own[k : k + size])) >= percent * len(set(want)) for k in range(max(1, len(own) - size + 1))):
            out.add(name)
    return out


def test_licenses_are_found_with_edits(spark):
    notices = licenses.notices()
    grant = notices["MIT-grant"]
    words = grant.split()
    edited = " ".join([*words[:10], "XX", *words[11:]])
    rows = [(1, f"before it é {grant} and after"), (2, "Licensed under the Apache License, Version 2.0."), (3, "filler " * 30 + "RELEASED under the MIT license! more"), (4, "nothing to see here at all"), (5, f"long tail {edited} " + "z " * 50)]
    got = {(r.doc_id, r.license): r for r in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string"), percent=65).collect()}  # the edit leaves 11 of 16 shingles
    assert set(got) == {(1, "MIT-grant"), (2, "Apache-2.0-line"), (3, "MIT-line"), (5, "MIT-grant")}
    hit = got[1, "MIT-grant"]
    assert rows[0][1][hit.start : hit.end] == grant and hit.containment == 1.0


def test_licenses_recall_on_edited_full_texts(spark):
    """Copies with words changed here and there, in the middle of other words, against plain containment."""
    random = np.random.default_rng(3)
    notices = licenses.notices()
    texts = {}
    for k, (name, text) in enumerate(sorted(notices.items())):
        for copy in range(2):
            words = text.split()
            for at in random.choice(len(words), len(words) // 30, replace=False):
                words[at] = f"edit{at}"
            around = [f"w{x}" for x in random.integers(0, 500, 60)]
            texts[2 * k + copy] = " ".join([*around[: 20 + copy], *words, *around[20:]])
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(licenses, "STRETCH", 3_000)
        got = {(r.doc_id, r.license) for r in licenses.scan(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()}
    want = {(k, name) for k, text in texts.items() for name in plain_licenses(text, {n: t for n, t in notices.items() if len(t) < 4_000 or n == sorted(notices)[k // 2]})}
    assert len(want) > 60 and len(got & want) >= 0.99 * len(want)
    small = {n for n, t in notices.items() if len(t) < 4_000}
    assert {x for x in got - want if x[1] in small} == set()


def plain_windows(found, catalogue):
    """Windows that share a band with a template, from the minima of every window of every length class."""
    hashed = catalogue._hashed(found)
    own = [np.minimum.reduce(catalogue._hashed(s), axis=1) for s in catalogue.shingles]
    rows, out = catalogue.rows, set()
    for width, one in catalogue.classes.items():
        if 100 * len(found) < 80 * one["least"]:
            continue
        size = min(len(found), width + one["step"] - 1)
        for start in np.minimum(np.arange(0, max(1, len(found) - size + one["step"]), one["step"]), len(found) - size):
            least = hashed[:, start : start + size].min(axis=1)
            for k in {int(x) for x in one["members"].ravel()}:
                if any((least[b : b + rows] == own[k][b : b + rows]).all() for b in range(0, len(least), rows)):
                    out.add((k, int(start), int(start) + size))
    return out


@pytest.mark.parametrize("bands, rows", [(8, 1), (4, 2)])
def test_license_bands_only_of_windows_with_an_anchor(bands, rows):
    """The windows of bands of all, from bands of those that can be a template's."""
    notices = licenses.notices()
    catalogue = licenses.Catalogue(notices, bands, rows)
    filler = " ".join(f"w{x}" for x in np.random.default_rng(5).integers(0, 500, 3_000))
    grant, bsd = notices["MIT-grant"], notices["GPL-1"].split()
    texts = [filler, f"{filler} {grant} {filler}", f"{grant} {filler} {' '.join(bsd[:900])} x {' '.join(bsd[901:])} {grant}"]
    made = []
    inner = catalogue._bands
    catalogue._bands = lambda signature: made.append(signature.shape[1]) or inner(signature)
    for text, most in zip(texts, (0, 100, None), strict=True):
        found = licenses._windows([text.encode()])[0]
        made.clear()
        got = catalogue.retrieved(found)
        assert got == plain_windows(found, catalogue) and bool(got) == (text != filler)
        assert most is None or sum(made) <= most


def test_license_ends_are_dropped_in_one_pass():
    """A template many times over: a hit is dropped by its count, not by counting all the others anew."""
    template = licenses._windows([licenses.notices()["MPL-2.0"].encode()])[0]
    found = np.tile(template, 4)
    size = len(template)
    sorts = []
    with pytest.MonkeyPatch.context() as patch:
        inner = np.unique
        patch.setattr(np, "unique", lambda *a, **k: sorts.append(1) or inner(*a, **k))
        [(first, end, share)] = licenses.verified(found, template, [(size, 2 * size + size // 8)])
    assert share == 1.0 and end - first == 2 * size and len(sorts) < 10


def test_license_windows_are_verified_together():
    """Windows of a template that overlap are looked up once, with the result of each on its own."""
    template = licenses._windows([licenses.notices()["MPL-2.0"].encode()])[0]
    other = np.arange(1, 5_001, dtype=np.uint64)
    size = len(template)
    far = 30 * size
    found = np.concatenate([other, template, other, template[: size // 2], np.arange(far, dtype=np.uint64), template])
    spans = [(start, start + size) for start in range(0, len(found) - size + 1, size // 8)]
    looked = []
    with pytest.MonkeyPatch.context() as patch:
        inner = np.flatnonzero
        patch.setattr(np, "flatnonzero", lambda x: looked.append(len(x)) or inner(x))
        got = list(licenses.verified(found, template, spans))
    assert sum(looked) <= len(found)
    assert got == [hit for span in spans for hit in licenses.verified(found, template, [span])]
    assert {(a, b) for a, b, share in got if share == 1.0} == {(5_000, 5_000 + size), (len(found) - size, len(found))}


def test_license_catalogue_in_parts(spark):
    made = {f"t{k:04}": " ".join(f"{k}x{j}" for j in range(12)) for k in range(6_000)}
    docs = spark.createDataFrame([(1, f"a b c {made['t0007']} d"), (2, made["t5999"]), (3, "a b c d e f")], "doc_id bigint, text string")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(licenses, "PART_SHINGLES", 30_000)
        assert {(r.doc_id, r.license) for r in licenses.scan(docs, made).collect()} == {(1, "t0007"), (2, "t5999")}


def test_licenses_match_plain_search(spark, sf_dir, texts):
    got = {(r.doc_id, r.license) for r in queries.op8_licenses(spark, sf_dir).collect()}
    small = {n: t for n, t in licenses.notices().items() if len(t) < 1_200}
    assert {x for x in got if x[1] in small} == {(k, n) for k, t in texts.items() for n in plain_licenses(t, small)}


def plain_secrets(text):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_secret_base_spans_and_redaction(spark, sf_dir, texts):
    more = {-1: "é API_KEY = 'abc.def' passwd:12345 token=\"" + "a1" * 15 + "\" AKIA" + "Q7" * 9 + " tail", -2: "secret=secret=abcdefgh0123456789abcdef01 x", -3: "password: ghp_16C7e42F292c6912E7710c838347Ae178B4a"}
    docs = spark.createDataFrame([*texts.items(), *more.items()], "doc_id bigint, text string")
    for r in secrets.scan(docs, [0.0] * 66 * 66).select("doc_id", secrets.listed(F.col("spans")).alias("spans")).collect():
        assert r.spans == plain_secrets({**texts, **more}[r.doc_id])
    clean = secrets.redact(docs.where("doc_id = -1"), [0.0] * 66 * 66).first().text
    assert clean.startswith("é <SECRET>' passwd:12345 <SECRET>") and clean.endswith(" <SECRET> tail")


def test_markov_models_tell_random_from_ordinary(spark):
    model = secrets.train(secrets.samples(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")))
    rows = [("ghp_16C7e42F292c6912E7710c838347Ae178B4a", True), ("thisisanordinaryidentifier", False), ("getUserAccountByIdentifier", False), ("eyJhbGciOiJIUzI1NiIsInR5cCI6", True)]
    docs = spark.createDataFrame([(k, f"x {w} y") for k, (w, _) in enumerate(rows)], "doc_id bigint, text string")
    assert {r.doc_id: bool(r.spans) for r in secrets.scan(docs, model).collect()} == {k: hit for k, (_, hit) in enumerate(rows)}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, sf_dir, name):
    db = duckdb.connect()
    for table in ("documents", "pages", "conversations", "embeddings"):
        db.sql(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    a, b = queries.queries()[name](spark, sf_dir).toPandas(), db.sql(queries.oracle_sql()[name]).df()
    columns = sorted(a.columns)
    assert sorted(map(str, a[columns].astype(str).values.tolist())) == sorted(map(str, b[columns].astype(str).values.tolist()))


def test_word_hashes_split_as_bytes_do(texts):
    raw = [t.encode() for t in texts.values()] + [b"", b" ", b"a" * 3_000_000 + b" b", b"x y " * 700_000]
    assert [h.shape[1] for h in word_hashes(raw, EXACT)] == [len(t.split()) for t in raw]


def test_pipeline(spark, sf_dir):
    pipeline = importlib.import_module("corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = pipeline.quality_rules(spark, docs, sf_dir)
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in queries.op2_quality(spark, sf_dir).where("kept").collect()}
    heads = pipeline.near_duplicates(spark, kept, sf_dir)
    want = plain_components({r.doc_id: r.text for r in kept.collect()})
    assert sorted(r.doc_id for r in heads.collect()) == sorted(k for k, (_, c) in want.items() if k == c)
    clean = pipeline.secret_scan(spark, heads, sf_dir)
    assert clean.columns == docs.columns and all(plain_secrets(r.text) == "" for r in clean.collect())
    assert pipeline.run(spark, sf_dir).count() > 0


def test_pipeline_stages_take_odd_and_empty_tables(spark, odd, empty, sf_dir):
    pipeline = importlib.import_module("corpus_pipeline")
    for docs in (odd, empty):
        ids = sorted(r.doc_id for r in docs.where("doc_id is not null").select("doc_id").distinct().collect())
        for name, stage in pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf_dir)
            assert out.columns == pipeline.COLUMNS
            rows = out.collect()
            if name == "quality rules":
                assert rows == []  # too short, or one word again and again
            if name == "n-gram Jaccard join":
                assert sorted(r.doc_id for r in rows if r.doc_id is not None) == [k for k in ids if k != 6]  # 6 repeats 5
                assert len(rows) == (len(ids) if ids else 0)  # and the row without id stays
            if name == "secret scan":
                assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in docs.select("doc_id").collect())
        packed = pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
        assert {r.doc_id for r in packed} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_mixing_draws_rows_without_id_by_their_texts(spark):
    docs = spark.range(2_000).select(F.lit(None).cast("bigint").alias("doc_id"), F.col("id").cast("string").alias("text"), F.lit("a").alias("source"), F.lit("own").alias("copy"))
    out = mixing.replicate(docs)
    copies = {r.text: (r.n, r.n_copies) for r in out.groupBy("text", "n_copies").agg(F.count("*").alias("n")).collect()}
    assert 1_000 < len(copies) < 1_500 and all(n == m for n, m in copies.values()) and out.schema["copy"].dataType.simpleString() == "int"


def test_packing_reports_its_gap():
    counts = {7: 3, 5: 3, 4: 2}
    patterns = packing.bin_completion(counts, 12)
    assert packing.gap(counts, patterns, 12) == 0 and sum(t for t, _ in patterns) == 4
