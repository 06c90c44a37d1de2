"""Quality rules: base counts, and a hashed n-gram log-likelihood ratio.

Two multinomials over hashed word n-grams are estimated: one from trusted target
documents, one from the whole raw corpus. A document's score is the mean log ratio
of its n-grams, so length doesn't matter, and every document is held against the
same threshold. A document without words scores 0 and fails the base rule.

Both the number of hash cells and the threshold follow the corpus. Cells grow with the
square root of its bytes, about as distinct n-grams do. Every fifth trusted document is
left out of the target multinomial; the threshold is set on the scores of these and of
the documents known to be bad, which a larger corpus shifts as it does all others.
Where no trusted document is held out, nothing is rejected but by the base rules.

Null and empty texts count as texts without words; repeated rows are judged alike;
an empty table gives an empty result. Only the named columns of an input are read,
so further columns and their names don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import EXACT, FOLDED, mixed, sliced, windows, word_hashes

#: The multinomials have the next power of two above this times the square root of all texts' bytes as cells.
CELLS_PER_ROOT = 2.0
#: At most this many labelled documents of either kind are used, first by hash of their id.
LABELLED_ROWS = 20_000
#: One in so many trusted documents is held out for the threshold.
HELD_OUT = 5
#: A rejected share of the held-out trusted documents costs so many times the same share of kept bad ones.
REJECTION_COST = 10
#: Rows of a batch of counts.
COUNT_ROWS = 1 << 16
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
SYMBOLS = b"#*$%&|<>"
NO_WORD_CHARS = bytes([32, *range(9, 14), *range(0x80, 0xC0)])

SCORED = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
    "n_repeat_words bigint, score double"
)


def _buckets(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of a text's single words and word pairs."""
    grams = np.concatenate([mixed(hashes), windows(hashes, 2)])
    return (grams % np.uint64(buckets)).astype(np.int64)


def _raw(batch: pa.RecordBatch) -> list[bytes]:
    return [text.encode("utf-8", "replace") if text else b"" for text in batch["text"].to_pylist()]


def cells_for(size: int) -> int:
    """Cells of the multinomials of a corpus of so many bytes."""
    return 1 << math.ceil(math.log2(max(1024.0, CELLS_PER_ROOT * math.sqrt(size))))


def _counts(buckets: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, buckets), np.int64)
        waiting: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])

        def add() -> None:
            for k, some in enumerate(waiting):
                if some:
                    total[k] += np.bincount(np.concatenate(some), minlength=buckets)
                    some.clear()

        size = 0
        for batch in sliced(batches):
            for found, trusted in zip(word_hashes(_raw(batch), FOLDED), batch["trusted"].to_pylist(), strict=True):
                if found.size:
                    waiting[0].append(_buckets(found[0], buckets))
                    size += len(waiting[0][-1])
                    if trusted:
                        waiting[1].append(waiting[0][-1])
            if size >= max(buckets, COUNT_ROWS):  # so that adding costs no more than hashing
                add()
                size = 0
        add()
        at = np.flatnonzero(total[0])
        for first in range(0, len(at), COUNT_ROWS):
            part = at[first : first + COUNT_ROWS]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[0][part]), pa.array(total[1][part])], names=["bucket", "raw", "target"])

    return count


def sampled(labelled: DataFrame, rows: int = LABELLED_ROWS) -> DataFrame:
    """doc_id, good, held_out of a bounded number of labelled documents: trusted ones that are fitted or held out, and bad ones.

    labelled: doc_id of trusted documents; a column good, where there is one, is false for bad ones.
    A document labelled both ways is bad.
    """
    good = F.coalesce(F.col("good").cast("boolean"), F.lit(False)) if "good" in labelled.columns else F.lit(True)
    ids = labelled.where("doc_id is not null").select("doc_id", good.alias("good")).groupBy("doc_id").agg(F.min("good").alias("good"))
    first = lambda some: some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    held_out = ~F.col("good") | (F.pmod(F.xxhash64("doc_id", F.lit("held out")), F.lit(HELD_OUT)) == 0)
    return first(ids.where("good")).unionByName(first(ids.where("not good"))).withColumn("held_out", held_out)


def weights(docs: DataFrame, sample: DataFrame) -> np.ndarray:
    """Log ratio of every cell: target over raw, both smoothed by one count.

    sample: sampled(); its trusted documents that aren't held out are the target. The raw
    counts cover every document. Tasks sum up before the shuffle; one row for each cell
    comes to the driver, which grows with the square root of the corpus.
    """
    buckets = cells_for(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    ids = sample.where("not held_out").select("doc_id", F.lit(True).alias("trusted"))
    marked = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left").select("text", "trusted")
    counted = marked.mapInArrow(_counts(buckets), "bucket bigint, raw bigint, target bigint")
    sums = counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    both = np.zeros((2, buckets))
    both[:, sums["bucket"].to_numpy()] = sums["raw"].to_numpy(), sums["target"].to_numpy()
    if not both[1].any():
        return np.zeros(buckets, np.float32)
    smooth = np.log(both + 1) - np.log(both.sum(axis=1, keepdims=True) + buckets)
    return (smooth[1] - smooth[0]).astype(np.float32)


def between(good: list[float], bad: list[float]) -> float:
    """The threshold with the least cost: REJECTION_COST times the share of good scores below it, and the share of bad ones above.

    It is midway between two neighbouring scores (of equally cheap places, the lowest). Without bad scores it is
    as far below the lowest good one as that is below the median; without good ones it rejects nothing.
    """
    if not good:
        return -math.inf
    g, b = np.sort(good), np.sort(bad)
    if not len(b):
        return float(2 * g[0] - np.median(g))
    every = np.unique(np.concatenate([g, b]))
    places = np.concatenate([[every[0] - 1.0], (every[1:] + every[:-1]) / 2, [every[-1] + 1.0]])
    cost = REJECTION_COST * np.searchsorted(g, places, "left") / len(g) + 1 - np.searchsorted(b, places, "left") / len(b)
    return float(places[int(np.argmin(cost))])


def fit(docs: DataFrame, labelled: DataFrame, rows: int = LABELLED_ROWS) -> tuple[np.ndarray, float]:
    """Weights of the cells and the threshold, from all documents and at most 2 * rows labelled ones (see sampled)."""
    sample = sampled(labelled, rows)
    ratio = weights(docs, sample)
    held = F.broadcast(sample.where("held_out").select("doc_id", "good"))
    scored = score(docs.select("doc_id", "text").join(held, "doc_id", "left_semi"), ratio).where(~_base_failed())
    # rows with one doc_id are one labelled document
    found = scored.groupBy("doc_id").agg(F.min("score").alias("score")).join(held, "doc_id").collect()
    return ratio, between([r.score for r in found if r.good], [r.score for r in found if not r.good])


def _measure(raw: bytes, hashes: np.ndarray, ratio: np.ndarray) -> tuple:
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    exact, folded = hashes
    if not len(exact):
        return 0, 0, symbols, 0, 0, 0.0
    lines = [line for line in raw.split(b"\n") if line and not line.isspace()]
    grams = windows(exact, 3)
    repeated = 0
    ordered = np.sort(grams)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if len(again):
        twice = np.isin(grams, again)
        inside = np.zeros(len(exact), bool)
        for k in range(3):
            inside[k : k + len(twice)] |= twice
        repeated = int(inside.sum())
    return (
        len(exact),
        # code points: every byte but white space and the later bytes of a character
        len(raw.translate(None, NO_WORD_CHARS)),
        symbols,
        len(lines) - len(set(lines)),
        repeated,
        float(ratio[_buckets(folded, len(ratio))].mean(dtype=np.float64)),
    )


def score(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """Base counts and score of every document; ratio comes from weights()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            raw = _raw(batch)
            rows = [_measure(x, h, ratio) for x, h in zip(raw, word_hashes(raw, EXACT, FOLDED), strict=True)]
            columns = [pa.array(x, pa.float64() if k == 5 else pa.int64()) for k, x in enumerate(zip(*rows, strict=True))]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns], names=[x.split()[0] for x in SCORED.split(", ")])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, SCORED)


def _base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))


def judge(docs: DataFrame, labelled: DataFrame, threshold: float | None = None) -> DataFrame:
    """One row per document: base counts, base_failed, kept and score. threshold: in place of the fitted one."""
    ratio, fitted = fit(docs, labelled)
    least = fitted if threshold is None else threshold
    return (
        score(docs, ratio)
        .withColumn("base_failed", _base_failed())
        .withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(least)))
    )


def keep(docs: DataFrame, labelled: DataFrame, threshold: float | None = None) -> DataFrame:
    """The rows of docs, with all their columns, that judge() keeps. The texts aren't shuffled."""
    ratio, fitted = fit(docs, labelled)
    least = fitted if threshold is None else threshold
    table = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            kept, raw = [], _raw(batch)
            for x, h in zip(raw, word_hashes(raw, EXACT, FOLDED), strict=True):
                n_words, _, _, _, repeated, value = _measure(x, h, ratio)
                kept.append(n_words >= MIN_WORDS and 100 * repeated <= MAX_REPEATED_PERCENT * n_words and value >= least)
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, table)
