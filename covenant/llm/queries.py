"""One registered query per operator, over the whole of its table, and their SQL where SQL can express them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import avi, jaccard, langid, licenses, lloyd, mixing, packing, pii, quality, repair, secrets, topk, urls

TOKENIZER = "word_bpe_49k.json"

#: host, path and verdict of the fixed URL rules.
URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "block"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = TOKENIZER) -> str:
    return importlib.import_module("public_tokenizers").path(name)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans", "n_terms")


def trusted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: good and not toxic ones (good), and those of low quality (not good)."""
    return table(spark, sf_dir, "labels").where("quality = 0 or toxic = 0").select("doc_id", (F.col("quality") == 1).alias("good"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"), trusted_ids(spark, sf_dir))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    model = langid.train(docs.where(~held_out).select("text", "lang"))
    return langid.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_avi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return avi.round_trip(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.replicate(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(table(spark, sf_dir, "documents"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs, secrets.train(secrets.samples(docs)))
    base = F.filter("spans", lambda s: s["kind"] < 3)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("bigint")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"),
    )


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judge(table(spark, sf_dir, "pages"), rules)


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(repair.damaged(table(spark, sf_dir, "conversations")))


def op12_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return topk.top_k(vectors.where("id % 20 = 0"), vectors, 20)


def op13_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd.cluster(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pii, op2_quality, op3_language, op4_avi, op5_mixing, op6_packing, op7_jaccard, op8_licenses, op9_secrets, op10_urls, op11_repair, op12_topk, op13_lloyd)}


_OP5 = """
WITH RECURSIVE counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
means AS (SELECT source, (SELECT sum(n) FROM counts)::double * 1.0::double / (SELECT count(*) FROM counts)::double / n::double AS mean FROM counts),
rates AS (SELECT source, greatest(1, ceil(mean / 64.0::double))::int AS draws, mean / greatest(1, ceil(mean / 64.0::double)) AS rate FROM means),
sums AS (
  SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS c FROM rates
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM sums WHERE k < 192),
shares AS (SELECT source, list(c ORDER BY k) AS cs FROM sums GROUP BY source),
named AS (SELECT *, coalesce(doc_id::varchar, md5(text), '') AS doc FROM documents),
drawn AS (
  SELECT d.*, s.cs, list_transform(range(0, r.draws), lambda j:
    ('0x' || substr(md5('mix-1:' || d.doc || CASE WHEN j > 0 THEN ':' || j ELSE '' END), 1, 13))::bigint / 4503599627370496.0::double) AS us
  FROM named d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source JOIN shares s ON d.source IS NOT DISTINCT FROM s.source),
counted AS (SELECT *, list_sum(list_transform(us, lambda u: len(list_filter(cs, lambda c: c <= u))))::int AS n_copies FROM drawn),
copied AS (SELECT *, unnest(range(0, n_copies))::int AS copy FROM counted WHERE n_copies > 0)
SELECT doc_id, text, lang, source, n_chars, copy, n_copies, ('0x' || substr(md5('mix-1:' || doc || ':' || copy || ':key'), 1, 15))::bigint AS shuffle_key FROM copied
"""

_OP7 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
shingled AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words),
sizes AS (SELECT doc_id, len(s)::bigint AS n FROM shingled),
items AS (SELECT doc_id, hash(unnest(s)) AS h FROM shingled),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_have
  FROM items a JOIN items b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM shared JOIN sizes m ON m.doc_id = x JOIN sizes n ON n.doc_id = y
  WHERE 100 * both_have >= 80 * (m.n + n.n - both_have)),
edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (
  SELECT doc_id, doc_id AS other FROM sizes
  UNION
  SELECT r.doc_id, e.y FROM reach r JOIN edges e ON r.other = e.x)
SELECT s.doc_id, s.n AS n_shingles, min(r.other) AS component_id FROM sizes s JOIN reach r USING (doc_id) GROUP BY 1, 2
"""

_OP10 = r"""
WITH rules(r_host, r_path, r_verdict) AS (VALUES
  ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'),
  ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
parts AS (
  SELECT page_id, url,
    CASE WHEN strpos(coalesce(url, ''), '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
cut AS (SELECT page_id, regexp_extract(rest, '^([^/?#]*)([^?#]*)', ['h', 'p']) AS x FROM parts),
seen AS (SELECT row_number() OVER () AS k, page_id, translate(x.h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, x.p AS path FROM cut),
hits AS (
  SELECT k, r_host || r_path AS rule, r_verdict,
    row_number() OVER (PARTITION BY k ORDER BY length(r_host || r_path) DESC, length(r_host) DESC) AS nr
  FROM seen JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path))
SELECT page_id, host, path, rule, coalesce(r_verdict, 'allow') AS verdict
FROM seen LEFT JOIN (SELECT * FROM hits WHERE nr = 1) h USING (k)
"""



def _with(key: str, cost: str | int, edit: str) -> str:
    """A key (ten digits of cost, then the audit) after another edit; null stays null."""
    return f"(printf('%010d', left({key}, 10)::bigint + {cost}) || substr({key}, 11) || '{edit}')"


def _closed(e: list[str]) -> str:
    """Keys of the four states after any inserts, from those before."""
    user = f"least({e[2]}, {_with(e[0], 3, 'I')}, {_with(e[1], 3, 'I')})"
    return f"{e[0]} AS k0, {e[1]} AS k1, least({user}, {_with(e[3], 3, 'I')}) AS k2, least({e[3]}, {_with(user, 3, 'I')}) AS k3"


_EDITS = {
    "e0": _with("k0", 4, "D"),
    "e1": f"least({_with('k1', 4, 'D')}, CASE WHEN free AND initial = 's' THEN {_with('k0', 'more', 'K')} END)",
    "e2": f"least({_with('k2', 4, 'D')}, CASE WHEN free AND initial = 'u' THEN {_with('least(k0, k1, k3)', 'more', 'K')} END, CASE WHEN free THEN {_with('least(k0, k1, k3)', '3 + more', 'R')} END)",
    "e3": f"least({_with('k3', 4, 'D')}, CASE WHEN free AND initial = 'a' THEN {_with('k2', 'more', 'K')} END, CASE WHEN free THEN {_with('k2', '3 + more', 'R')} END)",
}

_OP11 = rf"""
WITH RECURSIVE named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda c: ascii(c)::bigint) AS codes
  FROM conversations),
fated AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::bigint, codes), lambda acc, code:
    list_reduce(list_prepend(xor(acc, code), range(8)), lambda v, bit: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::bigint) ELSE v >> 1 END)), 4294967295::bigint) % 20 AS fate
  FROM named),
damaged AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
    CASE fate WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE fate WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM fated),
ordered AS (
  SELECT *, left(role, 1) AS initial,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body
  FROM damaged),
judged AS (
  SELECT *, CASE WHEN body = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair
  FROM ordered),
steps AS (SELECT *, fault NOT IN ('blank', 'duplicate') AS free, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS more FROM judged),
conv AS (
  SELECT c.conv_id, count(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN judged j ON c.conv_id IS NOT DISTINCT FROM j.conv_id GROUP BY 1),
keys AS (
  SELECT conv_id, 0::bigint AS i, {_closed(["'0000000000'", "NULL::varchar", "NULL::varchar", "NULL::varchar"])} FROM conv
  UNION ALL
  SELECT conv_id, i, {_closed(["e0", "e1", "e2", "e3"])}
  FROM (SELECT k.conv_id, s.i, {", ".join(f"{x} AS {name}" for name, x in _EDITS.items())}
    FROM keys k JOIN steps s ON k.conv_id IS NOT DISTINCT FROM s.conv_id AND s.i = k.i + 1)),
best AS (
  SELECT c.*, left(least(k0, k3), 10)::bigint AS cost, substr(least(k0, k3), 11) AS audit
  FROM conv c JOIN keys k ON c.conv_id IS NOT DISTINCT FROM k.conv_id AND k.i = c.n),
edits AS (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS p FROM best),
placed AS (
  SELECT conv_id, p, substr(audit, p, 1) AS edit, length(replace(left(audit, p), 'I', '')) AS i, length(replace(left(audit, p), 'D', '')) AS place FROM edits),
kept AS (
  SELECT p.*, s.role, s.text, max(CASE WHEN place = 1 AND edit = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY p.conv_id) AS system
  FROM placed p LEFT JOIN steps s ON p.conv_id IS NOT DISTINCT FROM s.conv_id AND p.i = s.i AND p.edit <> 'I' WHERE edit <> 'D'),
lines AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY p) AS repaired
  FROM kept GROUP BY 1)
SELECT b.conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM best b LEFT JOIN lines l ON b.conv_id IS NOT DISTINCT FROM l.conv_id
"""

_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::double))) = 0"

_OP12 = f"""
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) AS v FROM embeddings WHERE vec_id IS NOT NULL AND {_FINITE}),
queries AS (SELECT vec_id AS query_id, min(v) AS q FROM whole WHERE vec_id % 20 = 0 GROUP BY 1),
scored AS (
  SELECT query_id, vec_id, list_sum(list_transform(list_zip(q, v), lambda z: z[1] * z[2]))::bigint AS score
  FROM queries JOIN whole ON query_id <> vec_id AND len(q) = len(v)),
ranked AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::int AS rank, vec_id, score FROM scored)
SELECT * FROM ranked WHERE rank <= 20
"""


def _lloyd_round(k: int) -> str:
    return f"""
near{k} AS MATERIALIZED (
  SELECT nr, vec_id, v, min({{'distance': distance, 'cluster': cluster}}) AS best
  FROM (SELECT nr, vec_id, v, cluster, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint AS distance FROM vectors, centroids{k})
  GROUP BY nr, vec_id, v),
sums{k} AS (
  SELECT cluster, dim, sum(x)::bigint AS total, count(*) AS n
  FROM (SELECT best.cluster AS cluster, unnest(v) AS x, unnest(range(1, 65)) AS dim FROM near{k}) GROUP BY 1, 2),
means{k} AS (SELECT cluster, list((total - ((total % n) + n) % n) // n ORDER BY dim) AS c FROM sums{k} GROUP BY 1),
centroids{k + 1} AS MATERIALIZED (SELECT cluster, coalesce(m.c, o.c) AS c FROM centroids{k} o LEFT JOIN means{k} m USING (cluster))"""


_OP13 = f"""
WITH vectors AS MATERIALIZED (
  SELECT row_number() OVER () AS nr, vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) AS v FROM embeddings WHERE len(embedding) = 64 AND {_FINITE}),
centroids0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('3:' || coalesce(vec_id::varchar, '')), v) - 1 AS cluster, v AS c FROM vectors ORDER BY 1 LIMIT 8),
{", ".join(_lloyd_round(k) for k in range(11))}
SELECT vec_id, best.cluster::int AS cluster, best.distance AS distance, (sum(best.distance) OVER (PARTITION BY best.cluster))::bigint AS cluster_inertia,
  (sum(best.distance) OVER ())::bigint AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM near10 JOIN centroids10 ON best.cluster = cluster
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_mixing": _OP5, "op7_jaccard": _OP7, "op10_urls": _OP10, "op11_repair": _OP11, "op12_topk": _OP12, "op13_lloyd": _OP13}
