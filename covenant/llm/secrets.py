"""Secret scans with DataFrame functions only.

Three base patterns (assignments, access keys, hex strings), and identifier-like
tokens told from ordinary ones by two character Markov models: one of random strings,
one of ordinary identifiers, compared by log-likelihood ratio. Both are trained from
labelled samples: what the base patterns find is random, and so are strings that are
drawn from several alphabets by a hash; the words of documents without a find are
ordinary.

Offsets are code points. A pattern's matches and the text between them alternate, so
running sums of their lengths give the offsets. Null and empty texts have no spans;
repeated rows are scanned alike; an empty table gives an empty result. Without
labelled samples the models are even and add nothing. scan() reads only doc_id and
text; redact() keeps all columns.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the base patterns.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
KINDS = ("assign", "access", "hex", "markov")

#: The models' characters; everything else ends a token.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+"
LEAST_TOKEN = 16
#: What any text with such a token, an access key or a hex string matches.
RUN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16}"
#: Labelled samples: at most so many random strings and so many ordinary words, first by hash.
RANDOM_ROWS = 20_000
#: Random strings that are drawn, of all alphabets together, and their characters.
DRAWN_ROWS, DRAWN_CHARS = 20_000, 40
ORDINARY_ROWS = 40_000
#: Documents whose words are ordinary samples.
ORDINARY_DOCS = 1_000
#: A token is a secret if the ratio is this high in nats a transition. Ordinary names lie below 0.
THRESHOLD = 0.5
PLACEHOLDER = "<SECRET>"


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def spans_of(text: Column, pattern: str, group: int, least: int, kind: int, maybe: Column) -> Column:
    """array<struct<start, kind, end, value>> of pattern's matches whose group has at least so many characters.

    maybe: a cheaper test that holds for any text with such a match.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    parts = F.arrays_zip(F.transform(F.split(text, pattern), lambda x: F.length(x)).alias("gap"), found.alias("whole"), values.alias("value"))
    empty = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,value:string>>")

    def step(state: Column, part: Column) -> Column:
        start = state["at"] + part["gap"]
        end = start + F.length(part["whole"])
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), part["value"].alias("value"))
        fits = part["whole"].isNotNull() & (F.length(part["value"]) >= least)
        return F.struct(
            F.coalesce(end, start).alias("at"),
            F.when(fits, F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"),
        )

    walked = F.aggregate(parts, F.struct(F.lit(0).cast("bigint").alias("at"), empty.alias("spans")), step, lambda s: s["spans"])
    return F.when(maybe, walked).otherwise(empty)


def with_base(docs: DataFrame) -> DataFrame:
    """docs with __text (never null), __run (whether it has a run as long as a token) and __base, its base spans in order."""
    text, run = F.col("__text"), F.col("__run")
    out = docs.withColumn("__text", _text()).withColumn("__run", F.col("__text").rlike(RUN))
    # words that any assignment has; plain searches cost far less than the pattern
    lower = F.lower(text)
    named = lower.contains("passw") | lower.contains("secret") | lower.contains("token") | lower.contains("api")
    spans = F.concat(
        spans_of(text, ASSIGN, 2, LEAST_ASSIGN, 0, named & text.rlike(ASSIGN)),
        spans_of(text, ACCESS, 0, LEAST_ACCESS, 1, run & text.contains("AKIA") & text.rlike("AKIA[A-Z0-9]{16}")),
        spans_of(text, HEX, 0, LEAST_HEX, 2, run & text.rlike("(?<![0-9a-f])[0-9a-f]{24}")),
    )
    return out.withColumn("__base", F.array_sort(spans))


def drawn(spark: SparkSession, rows: int = DRAWN_ROWS) -> DataFrame:
    """value: random strings of base64, URL-safe base64, letters and digits, capitals and digits, and hex, by a hash of their number."""
    seed = F.sha2(F.concat(F.lit("random-"), F.col("id")), 512)
    full = F.base64(F.unhex(seed))
    letters = F.translate(full, "+/=", "")
    by_kind = [full, F.translate(full, "+/", "-_"), letters, F.upper(letters), seed]
    return spark.range(rows).select(F.substring(F.element_at(F.array(*by_kind), (F.col("id") % len(by_kind) + 1).cast("int")), 1, DRAWN_CHARS).alias("value"))


def samples(docs: DataFrame) -> DataFrame:
    """label ('random' or 'ordinary') and value of the bounded training sample."""
    finds = with_base(docs.select("text")).select(F.explode("__base").alias("span"))
    random = finds.select(F.col("span.value").alias("value")).distinct().orderBy(F.xxhash64("value"), "value").limit(RANDOM_ROWS)
    ids = docs.select("doc_id").where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(ORDINARY_DOCS).distinct()
    chosen = with_base(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi")).where(F.size("__base") == 0)
    words = chosen.select(F.explode(F.regexp_extract_all(F.col("__text"), F.lit("[A-Za-z][A-Za-z0-9_-]{3,}"), F.lit(0))).alias("value")).distinct()
    ordinary = words.orderBy(F.xxhash64("value"), "value").limit(ORDINARY_ROWS)
    random = random.union(drawn(docs.sparkSession))
    return random.select(F.lit("random").alias("label"), "value").union(ordinary.select(F.lit("ordinary").alias("label"), "value"))


def train(labelled: DataFrame) -> list[float]:
    """Log ratio of each transition, random over ordinary, by 66 * first + second character of ALPHABET."""
    n = len(ALPHABET)
    # characters next to each other; the last one has none after it and falls out below
    chars = F.split("value", "")
    pairs = labelled.select("label", F.explode(F.zip_with(chars, F.slice(chars, F.lit(2), F.greatest(F.size(chars), F.lit(1))), lambda a, b: F.concat(a, b))).alias("pair"))
    counts = {label: [[0] * n for _ in range(n)] for label in ("random", "ordinary")}
    place = {c: k for k, c in enumerate(ALPHABET)}
    # at most 2 * 66 * 66 rows
    for row in pairs.where(F.col("pair").rlike("^[A-Za-z0-9+/_-]{2}$")).groupBy("label", "pair").count().collect():
        counts[row.label][place[row.pair[0]]][place[row.pair[1]]] = row["count"]
    if not all(any(map(any, table)) for table in counts.values()):
        return [0.0] * (n * n)
    log = {label: [[math.log((x + 0.5) / (sum(row) + 0.5 * n)) for x in row] for row in table] for label, table in counts.items()}
    return [round(a - b, 4) for r, o in zip(log["random"], log["ordinary"], strict=True) for a, b in zip(r, o, strict=True)]


def ratio(value: Column, model: list[float]) -> Column:
    """Mean log-likelihood ratio a transition of a token; one walk over its characters, however long it is."""
    table = F.split(F.lit(" ".join(f"{x:g}" for x in model)), " ").cast("array<double>")  # folded to a literal

    def step(state: Column, char: Column) -> Column:
        place = F.position(char, F.lit(ALPHABET)) - 1
        gain = F.when(state["last"] >= 0, F.element_at(table, state["last"] * len(ALPHABET) + place + 1)).otherwise(0.0)
        return F.struct(place.alias("last"), (state["sum"] + gain).alias("sum"))

    chars = F.filter(F.split(value, ""), lambda c: c != "")
    return F.aggregate(chars, F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum")), step, lambda s: s["sum"]) / (F.length(value) - 1)


def with_spans(docs: DataFrame, model: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """docs with __spans: base spans, and tokens the models take for random that overlap none of them."""
    # digits alone are numbers, which are no identifiers of either kind
    fresh = lambda t: t["value"].rlike("[A-Za-z]") & ~F.exists("__base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))
    tokens = spans_of(F.col("__text"), TOKEN, 0, LEAST_TOKEN, 3, F.col("__run"))
    out = with_base(docs).withColumn("__new", F.filter(tokens, lambda t: fresh(t) & (ratio(t["value"], model) >= threshold)))
    return out.withColumn("__spans", F.array_sort(F.concat("__base", "__new"))).drop("__run", "__base", "__new", "__text")


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def scan(docs: DataFrame, model: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and spans (start, kind number in KINDS, end, value) of every document."""
    return with_spans(docs.select("doc_id", "text"), model, threshold).select("doc_id", F.col("__spans").alias("spans"))


def redact(docs: DataFrame, model: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """docs with every span's text replaced by a placeholder, and n_chars, if there, set anew. Overlaps are one."""
    def step(state: Column, s: Column) -> Column:
        # what lies between the last replaced character and this span; a span inside the last one only moves the end
        fresh = s["start"] >= state["at"]
        between = F.substr(F.col("text"), (state["at"] + 1).cast("int"), F.greatest(F.lit(0), s["start"] - state["at"]).cast("int"))
        return F.struct(
            F.greatest(state["at"], s["end"]).alias("at"),
            F.when(fresh, F.concat(state["out"], between, F.lit(PLACEHOLDER))).otherwise(state["out"]).alias("out"),
        )

    begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    rest = lambda s: F.concat(s["out"], F.substr(F.col("text"), (s["at"] + 1).cast("int"), F.lit(2**31 - 1)))
    clean = F.when(F.size("__spans") > 0, F.aggregate("__spans", begin, step, rest)).otherwise(F.col("text"))
    out = with_spans(docs, model, threshold).withColumn("text", clean).drop("__spans")
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
