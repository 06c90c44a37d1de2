"""The store, the index, filters, hops, HTTP and file sources, stage metrics, dates, memo, and chat memory on a stream."""

import datetime
import json
import threading
from collections import defaultdict
from http.server import BaseHTTPRequestHandler, HTTPServer
from pathlib import Path

import numpy as np
import pytest
from dateutil import parser
from pyspark.sql import functions as F

from covenant.functions import dates, stages, where
from covenant.operators import enrich, ivf, retrieval, vectors
from covenant.plans import registry, searches  # registry first, as it takes the others in
from covenant.sources import chunk_files, corpus, http_json, memo, store
from covenant.streaming import ingest, memory


def files(path):
    return {p.relative_to(path): (p.stat().st_mtime_ns, p.read_bytes()) for p in Path(path).rglob("part-*.parquet") if "_store" not in str(p)}


def test_merge_keeps_the_newest_and_leaves_other_folders(spark, tmp_path):
    path = f"{tmp_path}/store"
    store.create(spark, path, buckets=8)
    frame = lambda rows: spark.createDataFrame(rows, "id string, seq bigint, text string")
    with pytest.raises(FileNotFoundError):
        store.read(spark, path)
    assert store.merge(frame([]), path) == 0
    first = [(f"k{i}", i % 3, f"one {i}") for i in range(200)]
    assert store.merge(frame([*first, (None, 1, "no key"), ("k5", 9, "newest"), ("k5", 9, "newer text wins ties")]), path) == 8
    before = files(f"{path}/rows")
    assert store.merge(frame([("k7", 50, "two"), ("k8", -1, "too old")]), path) <= 2
    after = files(f"{path}/rows")
    same = [k for k in before if after.get(k) == before[k]]
    folders = {k.parts[0] for k in before} - {k.parts[0] for k in same}
    assert len(folders) <= 2 and len(same) >= len(before) - sum(k.parts[0] in folders for k in before)
    got = {r.id: (r.seq, r.text) for r in store.read(spark, path).collect()}
    want = {k: (s, x) for k, s, x in first} | {"k5": (9, "newest"), "k7": (50, "two")}
    assert got == want
    store.merge(frame([("k7", 50, "two")]), path)
    assert {r.id: (r.seq, r.text) for r in store.read(spark, path).collect()} == want


def test_stream_merges_by_id(spark, tmp_path):
    (tmp_path / "in").mkdir()
    run = lambda: ingest.ingest(spark, f"{tmp_path}/in", f"{tmp_path}/table", f"{tmp_path}/check", 4).awaitTermination()
    (tmp_path / "in/a.jsonl").write_text("\n".join(json.dumps({"id": k, "text": f"old {k}", "metadata": "{}"}) for k in ("x", "y")))
    run()
    (tmp_path / "in/b.jsonl").write_text(json.dumps({"id": "y", "text": "new y", "metadata": "{}"}) + "\n" + json.dumps({"text": "no id"}))
    run()
    run()
    assert {r.id: r.text for r in ingest.read_latest(spark, f"{tmp_path}/table").collect()} == {"x": "old x", "y": "new y"}


@pytest.mark.parametrize("metric", ivf.METRICS)
def test_index_finds_what_an_exact_search_finds(spark, tmp_path, metric):
    random = np.random.default_rng(1)
    centres = random.normal(size=(20, 16))
    rows = [(k, (centres[k % 20] + 0.2 * random.normal(size=16)).tolist()) for k in range(1_000)] + [(2_000, None)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    asked = frame.where("vec_id % 40 = 0 and embedding is not null").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    ivf.save(ivf.build(frame, 12, metric=metric), f"{tmp_path}/index")
    index = ivf.load(spark, f"{tmp_path}/index")
    assert index.metric == metric and index.nlist == 12 and index.rows.count() == 1_000
    x = {k: np.array(v) for k, v in rows if v}
    unit = {k: v / (np.linalg.norm(v) + 1e-12) for k, v in x.items()}
    score = {"IP": lambda a, b: x[a] @ x[b], "COSINE": lambda a, b: unit[a] @ unit[b], "L2": lambda a, b: -np.linalg.norm(x[a] - x[b])}[metric]
    want = {(q, b) for q in range(0, 1_000, 40) for _, b in sorted((-round(score(q, b), 6), b) for b in x)[:5]}
    exact = ivf.search(index, asked, 5, 12)
    assert {(r.qid, r.vec_id) for r in exact.collect()} == want
    few = ivf.search(index, asked, 5, 6)
    assert ivf.recall(few, exact).first().recall >= 0.9
    assert "cell" in few._jdf.queryExecution().executedPlan().toString()


def test_index_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id bigint, embedding array<double>")
    index = ivf.build(none, 4)
    assert not ivf.search(index, none.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec")), 5, 2).count()
    with pytest.raises(ValueError):
        ivf.build(none, 4, metric="HAMMING")


def plain_where(filter_, row):
    for name, value in (filter_ or {}).items():
        if name in ("$and", "$or"):
            fits = (all if name == "$and" else any)(plain_where(f, row) for f in value)
        elif name == "$not":
            fits = not plain_where(value, row)
        else:
            tests, has = value if isinstance(value, dict) else {"$eq": value}, row.get(name)
            like = lambda v, has=has: has is not None and isinstance(has, bool) == isinstance(v, bool) and isinstance(has, str) == isinstance(v, str)
            ops = {"$eq": lambda v: has == v, "$ne": lambda v: has != v, "$gt": lambda v: has > v, "$gte": lambda v: has >= v, "$lt": lambda v: has < v, "$lte": lambda v: has <= v, "$contains": lambda v: v in has}  # noqa: B023
            fits = True
            for test, v in tests.items():
                if test in ("$in", "$nin"):
                    one = any(like(x) and has == x for x in v) == (test == "$in")
                else:
                    one = ops[test](v) if like(v) else test == "$ne"
                fits = fits and one
        if not fits:
            return False
    return True


def test_filters_match_a_plain_version(spark):
    rows = [{"label": k % 4, "name": f"n{k % 3}", "open": k % 2 == 0} | ({"page": k / 2} if k % 5 else {}) for k in range(40)] + [{}, {"label": "text"}]
    frame = spark.createDataFrame([(k, json.dumps(r)) for k, r in enumerate(rows)], "id int, raw string").withColumn("m", enrich.metadata_map(F.col("raw")))
    filters = [
        None, {}, {"label": 2}, {"label": {"$ne": 2}}, {"page": {"$gt": 3, "$lte": 9}}, {"name": {"$in": ["n1", "n2"]}}, {"name": {"$nin": ["n1"]}}, {"open": True},
        {"$or": [{"label": 1}, {"$and": [{"name": "n0"}, {"page": {"$lt": 8}}]}]}, {"$not": {"page": {"$gte": 1}}}, {"name": {"$contains": "2"}, "label": {"$gte": 1}},
    ]
    for one in filters:
        got = {r.id for r in frame.where(where.compiled(one, where.in_map(F.col("m")))).collect()}
        assert got == {k for k, r in enumerate(rows) if plain_where(one, r)}, one
    for bad in ({"$xor": []}, {"a": {"$like": 1}}, {"$and": {}}, {"a": {"$in": 3}}, {"a": [1]}):
        with pytest.raises(ValueError):
            where.compiled(bad, where.in_map(F.col("m")))


def test_filters_go_below_the_search(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    fields = where.in_columns(label=F.col("label"))
    plan = vectors.top_k(rows.limit(3).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec")), rows, 3, where.compiled({"label": {"$gt": 3}}, fields))
    assert "GreaterThan(label" in plan._jdf.queryExecution().executedPlan().toString()


class Flaky(BaseHTTPRequestHandler):
    tried: dict = defaultdict(int)

    def do_GET(self):
        self.tried[self.path] += 1
        status = 404 if self.path == "/none" else 503 if self.path.startswith("/late") and self.tried[self.path] < 3 else 429 if self.path == "/never" else 200
        body = json.dumps({"filings": {"recent": {"accessionNumber": ["a", "b"], "form": ["10-K", "8-K"], "filingDate": ["2020-01-01", "2020-02-01"], "reportDate": [], "primaryDocument": ["p", "q"]}}}).encode()
        self.send_response(status)
        self.end_headers()
        self.wfile.write(body if status == 200 else b"")

    def log_message(self, *args):
        pass


def test_http_source_tries_again(spark):
    server = HTTPServer(("127.0.0.1", 0), Flaky)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    quick = {"pause": "0", "backoff": "0.01", "partitions": "2", "retries": "3", "timeout": "10"}
    got = {r.url: r for r in http_json.read(spark, [f"{at}/late1", f"{at}/late2", f"{at}/now"], **quick).collect()}
    assert all(r.status == 200 for r in got.values()) and len(got) == 3
    recent = "struct<" + ",".join(f"{c}:array<string>" for c in ("accessionNumber", "form", "filingDate", "reportDate", "primaryDocument")) + ">"
    rows = http_json.read(spark, [f"{at}/now"], **quick).select(F.from_json("body", f"filings struct<recent:{recent}>").alias("j")).select("j.filings")
    assert [(r.form, r.filingDate) for r in corpus.recent_filings(rows).collect()] == [("10-K", "2020-01-01"), ("8-K", "2020-02-01")]
    kept = {r.url.rsplit("/")[-1]: (r.status, r.body) for r in http_json.read(spark, [f"{at}/none", f"{at}/never"], onError="keep", **quick).collect()}
    assert kept == {"none": (404, None), "never": (429, None)}
    with pytest.raises(Exception, match="404"):
        http_json.read(spark, [f"{at}/none"], **quick).collect()
    server.shutdown()


def test_one_file_for_each_document(spark, tmp_path):
    rows = [(d, f"{d}_{k}", f"text {k} é\0 \"q\"", json.dumps({"page": k})) for d in ("a", "b") for k in range(30)]
    frame = spark.createDataFrame(rows, "doc_id string, id string, content string, metadata string")
    order = F.regexp_extract("id", r"(\d+)$", 1).cast("bigint")
    chunk_files.write(frame, f"{tmp_path}/out", order)
    want = {d: "".join(json.dumps({"id": i, "content": c.replace("\0", ""), "metadata": json.loads(m)}, ensure_ascii=False, separators=(",", ":")).replace('"page":', '"page": ') + "\n" for x, i, c, m in rows if x == d) for d in "ab"}
    read = lambda: {p.stem: p.read_text() for p in Path(tmp_path, "out").iterdir()}
    assert read() == want
    chunk_files.write(frame.where("doc_id = 'b'").limit(1).withColumn("content", F.lit("new")), f"{tmp_path}/out", order)
    assert read()["a"] == want["a"] and json.loads(read()["b"])["content"] == "new"
    before = read()
    with pytest.raises(Exception, match="broken"):
        chunk_files.write(frame.withColumn("content", F.when(F.col("id") == "b_20", F.raise_error(F.lit("broken"))).otherwise(F.col("content"))), f"{tmp_path}/out", order)
    assert read() == before
    assert corpus.jsonl_chunks(spark, f"{tmp_path}/out").count() == 31


def test_stage_metrics_equal_counts(spark, sf_dir):
    docs = corpus.table(spark, sf_dir, "documents")
    run = stages.Stages("test")
    with run.stage("windows"):
        seen = run.observed(docs, "documents", "text", "doc_id")
        out = run.observed(seen.where(F.length("text") > 500), "long", "text")
        n = out.count()
    with pytest.raises(ZeroDivisionError), run.stage("broken"):
        1 / 0
    with run.stage("windows"):
        run.observed(docs.limit(5), "long", "text").count()
    first = docs.agg(F.count("*"), F.sum(F.length("text")), F.count_distinct("doc_id")).first()
    counts = run.counts()
    assert (counts["documents"]["rows"], counts["documents"]["characters"]) == first[:2] and abs(counts["documents"]["documents"] - first[2]) <= 0.03 * first[2]
    assert counts["long"]["rows"] == n + 5 and set(run.ms) == {"windows", "broken"} and run.done() >= run.ms["windows"]


def test_lax_dates(spark):
    values = ["March 3, 2001", "Mar 3 2001", "3 March 2001", "2001-03-03", "3/4/2001", "Sept 3, 2001", "Sept. 3rd, 2001", "3rd of May 2001", "03.05.2001", "25/12/2001", "May 2001", "no date", "", None, "Sat, 3 Mar 2001 10:00", "99/99/9999"]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values * 3)], "k int, v string")
    got = {r.k: r.d for r in dates.with_date(rows, "v", "d").collect()}

    def want(v):
        try:
            return parser.parse(v, default=datetime.datetime(2000, 1, 1)).date()
        except (ValueError, TypeError, OverflowError):
            return None

    assert got == {k: want(v) for k, v in enumerate(values * 3)}
    plan = dates.with_date(rows, "v", "d")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.index("Union") < plan.index("MapInArrow")


def parts(spark, sf_dir):
    assert "multi_hop_followed" in registry.queries()
    return searches._parts(spark, sf_dir)


def test_hops_ask_on_until_nothing_is_new(spark, sf_dir):
    asked, encode, rows = parts(spark, sf_dir)
    asked = asked.limit(3)
    calls = []

    def follow(questions, hits):
        calls.append(1)
        return questions.select("qid", F.explode(F.array(F.lit(1), F.lit(2))).alias("n")).withColumn("n", F.col("n").cast("bigint")).select("qid", "n", F.concat(F.lit("more "), F.least(F.col("n"), F.lit(len(calls)))).alias("question"))

    got = retrieval.multi_hop(asked, encode, rows, 40, follow).select("qid", "rank", "id", "score").collect()
    assert len(calls) == 2
    by_base = {}
    texts = [(r.qid, 0, 0, r.question) for r in asked.collect()] + [(q.qid, h, 1, t) for q in asked.collect() for h, t in ((1, "more 1"), (2, "more 2"))]
    for qid, hop, turn, text in texts:
        one = spark.createDataFrame([(1, text)], "qid bigint, question string")
        for r in retrieval.comprehensive(one, encode, rows, 20).collect():
            base = r.id.replace("_entities", "").replace("_clause", "")
            key = (-r.score, hop, turn, r["rank"], r.id)
            by_base[qid, base] = min(by_base.get((qid, base), key), key)
    for qid in {r.qid for r in got}:
        ordered = [k[-1] for k in sorted(v for (q, _), v in by_base.items() if q == qid)][:40]
        assert [r.id for r in sorted((r for r in got if r.qid == qid), key=lambda r: r["rank"])] == ordered
    alone = retrieval.multi_hop(asked, encode, rows, 12).select("qid", "rank", "id").collect()
    assert sorted(alone) == sorted(retrieval.multi_hop(asked, encode, rows, 12, lambda q, h: q.where("false").select("qid", F.lit(1).cast("bigint").alias("n"), "question")).select("qid", "rank", "id").collect())


def test_too_many_parts_are_an_error(spark, sf_dir):
    asked, encode, rows = parts(spark, sf_dir)
    many = asked.limit(1).select("qid", F.explode(F.sequence(F.lit(1), F.lit(120))).alias("n"), "question")
    with pytest.raises(Exception, match="parts or more"):
        retrieval._parts(many, 1_000).collect()


def test_memo_searches_only_what_is_missing(spark, tmp_path):
    path = f"{tmp_path}/memo"
    memo.create(spark, path)
    asked = spark.createDataFrame([(k, f"question {k}") for k in range(5)], "qid bigint, question string")

    def search(rows):
        return rows.where("qid <> 4").select("qid", F.explode(F.sequence(F.lit(1), F.lit(2))).alias("rank"), F.lit("x").alias("id"), (F.col("qid") / 10).alias("score"))

    ask = lambda rows, now, k=2, **more: memo.remembered(rows, search, path, now, "hybrid", k, **more)
    first, n = ask(asked, 1_000)
    want = sorted(map(tuple, search(asked).collect()))
    assert n == 5 and sorted(map(tuple, first.collect())) == want
    again, n = ask(asked, 1_100)
    assert n == 0 and sorted(map(tuple, again.collect())) == want
    assert ask(asked.where("qid < 2"), 1_100, k=3)[1] == 2  # another k is another result
    assert ask(asked, 1_601)[1] == 5  # too old, though used since
    assert ask(asked.where("qid = 1"), 1_610)[1] == 0
    assert ask(asked, 1_620, entries=1)[1] == 4  # only the newest is kept


def test_chat_memory_on_a_stream(spark, sf_dir, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    rows = corpus.table(spark, sf_dir, "conversations")
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")

    def run():
        q = memory.remembered(source, 120).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        q.awaitTermination()

    rows.where("turn < 2").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    rows.where("turn >= 2").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run()  # from the checkpoint, as after a restart
    got = sorted((r.conv_id, r.turn, r.turns, r.used, r.in_budget, r.summary_due) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    totals, want = defaultdict(lambda: [0, 0]), []
    for r in sorted(rows.collect(), key=lambda r: (r.conv_id, r.turn)):
        own = totals[r.conv_id]
        own[0], own[1] = own[0] + 1, own[1] + max(1, len(r.text) // 4)
        want.append((r.conv_id, r.turn, own[0], own[1], own[1] <= 120, own[0] >= memory.SUMMARY_TURNS))
    assert got == want
