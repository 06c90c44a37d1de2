"""Mixing sources to target weights by Poisson replication.

Every document is repeated by a Poisson count whose mean is its source's target
rate. The count is the inverse of the Poisson distribution at a uniform number that
comes from a hash of seed and doc_id: the same at each run, however the rows are
dealt out. Where a rate is above DRAW_RATE, the count is the sum of independent draws
of equal rates at most that large, which is Poisson of the whole rate. The copies are then dealt out by hash and sorted within their partition
by another, which is a random order of the whole. A row without doc_id is drawn by its
text's MD5; a null source is a source of its own; a source without a target weight gets
none of the output (rate 0); rows that repeat get the same count; an empty table
gives an empty result. All columns of docs are kept; the added ones are copy,
n_copies and shuffle_key (existing columns of these names are replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import small_or_shuffled, written

SEED = "mix-1"
#: Rate of one draw at most: exp(-rate) and the terms of poisson() are exact enough up to here.
DRAW_RATE = 64.0
_TERMS = 192
#: Bytes that a source's name is taken to need where the rates may be broadcast.
SOURCE_BYTES = 64
#: Shares that each source's rows are dealt out to where there are too many sources to broadcast.
SHARES = 32


def uniform(seed: str, *columns: Column) -> Column:
    """A number in [0, 1) from 52 bits of an MD5."""
    texts = [F.coalesce(c.cast("string"), F.lit("")) for c in columns]
    digest = F.md5(F.concat_ws(":", F.lit(seed), *texts).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def rates(docs: DataFrame, targets: DataFrame | None = None, total: float | None = None) -> DataFrame:
    """source, n_docs, rate: how often a document of each source is to appear on average.

    targets: source, weight; none: all sources weigh the same. total: rows wanted
    (none: as many as docs has).
    """
    counts = docs.groupBy("source").agg(F.count("*").alias("n_docs"))
    sums = counts if targets is None else counts.join(targets.select(F.col("source").alias("to"), "weight"), F.col("source").eqNullSafe(F.col("to")), "left").drop("to")
    weight = F.lit(1.0) if targets is None else F.coalesce(F.col("weight").cast("double"), F.lit(0.0))
    sums = sums.withColumn("w", weight)
    whole = sums.agg(F.sum("w").alias("w_all"), F.sum("n_docs").alias("n_all")).first()
    wanted = float(total if total is not None else whole.n_all or 0)
    w_all = float(whole.w_all or 1.0)
    rate = F.lit(wanted) * F.col("w") / F.lit(w_all) / F.col("n_docs")
    return sums.select("source", "n_docs", rate.alias("rate"))


def poisson(u: Column, rate: Column) -> Column:
    """The least k whose Poisson distribution function exceeds u; rate is at most DRAW_RATE."""
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.lit(0).alias("k"))

    def step(s: Column, i: Column) -> Column:
        p = s["p"] * rate / i
        more = s["c"] <= u
        return F.struct(
            F.when(more, p).otherwise(s["p"]).alias("p"),
            F.when(more, s["c"] + p).otherwise(s["c"]).alias("c"),
            F.when(more, i).otherwise(s["k"]).alias("k"),
        )

    last = F.greatest(F.lit(8), F.ceil(rate * 2 + 24)).cast("int")
    return F.aggregate(F.sequence(F.lit(1), F.least(F.lit(_TERMS), last)), start, step, lambda s: s["k"])


def shuffle_key(seed: str, doc: Column, copy: Column) -> Column:
    """60 bits of an MD5."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), doc, copy.cast("string"), F.lit("key")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def _with_rates(docs: DataFrame, table: DataFrame) -> DataFrame:
    """Each row with its source's rate. Few sources are broadcast; with many, a source's rows go to SHARES tasks."""
    table = written(table, "rates")
    sources = table.count()
    few = small_or_shuffled(table, sources, SOURCE_BYTES)
    same = F.col("source").eqNullSafe(F.col("__source"))
    if few is not table:
        return docs.join(few, same)
    dealt = docs.withColumn("__share", F.pmod(F.xxhash64("__doc"), F.lit(SHARES)))
    copies = table.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    return dealt.join(copies, same & (F.col("__share") == F.col("__part"))).drop("__share", "__part")


def replicate(docs: DataFrame, targets: DataFrame | None = None, total: float | None = None, seed: str = SEED) -> DataFrame:
    """The rows of docs, each as often as its Poisson count says, globally shuffled."""
    draws = F.greatest(F.lit(1), F.ceil(F.col("rate") / DRAW_RATE)).cast("int")
    table = rates(docs, targets, total).select(F.col("source").alias("__source"), (F.col("rate") / draws).alias("__rate"), draws.alias("__draws"))
    held = [c for c in docs.columns if c not in ("copy", "n_copies", "shuffle_key")]
    own = [F.md5(F.col("text").cast("binary"))] if "text" in held else []
    named = docs.select(*held).withColumn("__doc", F.coalesce(F.col("doc_id").cast("string"), *own, F.lit("")))
    drawn = _with_rates(named, table)
    first = F.array(uniform(seed, F.col("__doc")))
    more = F.transform(F.sequence(F.lit(1), F.col("__draws") - 1), lambda k: uniform(seed, F.col("__doc"), k))
    drawn = drawn.withColumn("__u", F.when(F.col("__draws") > 1, F.concat(first, more)).otherwise(first))
    # the lambda's u is a value: the steps of poisson() look at it again and again
    count = F.aggregate("__u", F.lit(0), lambda n, u: n + poisson(u, F.col("__rate")).cast("int"))
    drawn = drawn.withColumn("n_copies", count).where("n_copies > 0")
    copies = drawn.select(*held, "__doc", "n_copies", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1)).alias("copy"))
    keyed = copies.withColumn("shuffle_key", shuffle_key(seed, F.col("__doc"), F.col("copy"))).drop("__doc")
    return keyed.repartition("shuffle_key").sortWithinPartitions("shuffle_key", "doc_id", "copy").select(*held, "copy", "n_copies", "shuffle_key")
