"""Language identification by prediction by partial matching (PPM).

For every language a tree of byte contexts up to ORDER long holds how often each byte
followed. A byte that a context has seen costs -log2 of its share; one that it hasn't
costs the escape and is then coded in the next shorter context (method C: the escape
weighs as much as the number of distinct bytes seen), down to equal shares of all
bytes. The statistics are frozen, so the exact code length of a byte after its context
is a fixed number; a text's code length is a sum over all its bytes. The shortest wins,
ties go to the first name. The score is the winner's share if every language's
probability is 2 ** -code length.

A language's tree is fitted on all grams of about LABELLED_ROWS of its labelled
documents (all, if there are no more), chosen by a hash of the text, so that texts that
repeat are in or out together. No gram and no language is left out.

Null texts and texts without a letter are ``und`` with score 0; so is every text if
there is nothing to learn from. Empty texts have no letter. Repeated rows are judged
alike (and count again in training); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import sliced, small_or_shuffled, written

#: Bytes of the longest context.
ORDER = 3
#: Labelled documents that a language is learned from, about; this bounds a language's part of the model.
LABELLED_ROWS = 20_000
#: Bytes that a task sums up or scores at a time.
CHUNK = 1 << 22

PREDICTED = "doc_id bigint, lang_pred string, score double"


def _grams(parts: list[bytes]) -> np.ndarray:
    """Every byte of parts with the ORDER bytes before it, as one number; each part begins with its first byte's context."""
    line = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint32)
    grams = (line[:-3] << 24) | (line[1:-2] << 16) | (line[2:-1] << 8) | line[3:]
    keep = np.ones(len(line), bool)
    for start in np.cumsum([0, *(len(x) for x in parts[:-1])]):
        keep[start : start + ORDER] = False
    return grams[keep[3:]]


def sample(labelled: DataFrame, rows: int = LABELLED_ROWS) -> DataFrame:
    """text, lang of about so many labelled documents of each language, chosen by a hash of the text."""
    known = labelled.where("text is not null and lang is not null").select("text", "lang")
    sizes = written(known.groupBy(F.col("lang").alias("__lang")).agg(F.count("*").alias("__n")), "languages")
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 32)) / F.lit(float(1 << 32))
    return known.join(small_or_shuffled(sizes, sizes.count(), 64), F.col("lang") == F.col("__lang")).where(place * F.col("__n") < rows).select("text", "lang")


def counts(labelled: DataFrame) -> DataFrame:
    """lang, gram, n: how often each gram of ORDER + 1 bytes (as a number) stands in the whole labelled texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def add(lang: str, texts: list[bytes]) -> None:
            new, n = np.unique(_grams([bytes(ORDER) + t for t in texts]), return_counts=True)
            old, m = held.get(lang, (np.empty(0, np.uint32), np.empty(0, np.int64)))
            both, at = np.unique(np.concatenate([old, new]), return_inverse=True)
            held[lang] = both, np.bincount(at, np.concatenate([m, n]), len(both)).astype(np.int64)

        waiting: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}
        for batch in sliced(batches):
            for text, lang in zip(batch["text"].to_pylist(), batch["lang"].to_pylist(), strict=True):
                if text:
                    waiting.setdefault(lang, []).append(raw := text.encode("utf-8", "replace"))
                    sizes[lang] = sizes.get(lang, 0) + len(raw)
                    if sizes[lang] > CHUNK:
                        add(lang, waiting.pop(lang))
                        sizes[lang] = 0
        for lang, texts in waiting.items():
            add(lang, texts)
        for lang, (grams, n) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    rows = labelled.where("text is not null and lang is not null").select("text", "lang").mapInArrow(run, "lang string, gram bigint, n bigint")
    return rows.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Tree:
    """One language's costs in bits. Level k: grams of k + 1 bytes and their costs, contexts of k bytes and their escapes; all sorted."""

    grams: list[np.ndarray]
    costs: list[np.ndarray]
    contexts: list[np.ndarray]
    escapes: list[np.ndarray]

    def bits(self, grams: np.ndarray) -> np.ndarray:
        """The code length of each gram's last byte after the bytes before it."""
        out = np.full(len(grams), 8.0)
        for k in range(ORDER + 1):
            key = grams & np.uint32((1 << 8 * (k + 1)) - 1)
            seen, escape = _look_up(self.contexts[k], self.escapes[k], key >> np.uint32(8))
            found, cost = _look_up(self.grams[k], self.costs[k], key)
            # a context that the language never saw is no reason to pay for leaving it
            out = np.where(found, cost, np.where(seen, escape + out, out))
        return out


def _look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return keys[at] == wanted, values[at]


def grow(grams: np.ndarray, n: np.ndarray) -> Tree:
    """A language's tree from the counts of its longest grams; shorter ones are sums of those."""
    tree = Tree([], [], [], [])
    for k in range(ORDER + 1):
        key, at = np.unique(grams.astype(np.uint32) & np.uint32((1 << 8 * (k + 1)) - 1), return_inverse=True)
        times = np.bincount(at, n, len(key))
        context, of = np.unique(key >> np.uint32(8), return_inverse=True)
        total, kinds = np.bincount(of, times, len(context)), np.bincount(of, minlength=len(context))
        tree.grams.append(key)
        tree.costs.append(np.log2((total + kinds)[of] / times).astype(np.float32))
        tree.contexts.append(context)
        tree.escapes.append(np.log2((total + kinds) / kinds).astype(np.float32))
    return tree


@dataclass
class Model:
    langs: list[str]
    trees: list[Tree]

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each text in each language; long texts are summed up in parts."""
        out = np.zeros((len(texts), len(self.langs)))
        owners: list[int] = []
        parts: list[bytes] = []
        size = 0
        for k, text in enumerate(texts):
            for at in range(0, len(text), CHUNK):
                owners.append(k)
                parts.append(text[max(0, at - ORDER) : at].rjust(ORDER, b"\0") + text[at : at + CHUNK])
                size += len(parts[-1])
                if size >= CHUNK:
                    self._add(out, owners, parts)
                    owners, parts, size = [], [], 0
        if parts:
            self._add(out, owners, parts)
        return out

    def _add(self, out: np.ndarray, owners: list[int], parts: list[bytes]) -> None:
        distinct, at = np.unique(_grams(parts), return_inverse=True)
        firsts = np.cumsum([0, *(len(x) - ORDER for x in parts[:-1])])
        for k, tree in enumerate(self.trees):
            np.add.at(out[:, k], owners, np.add.reduceat(tree.bits(distinct)[at], firsts))


def train(labelled: DataFrame) -> Model | None:
    """The model of labelled's whole texts; None if there are none. Trees are grown in tasks, one for each language."""
    kinds = ("grams", "costs", "contexts", "escapes")

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        tree = grow(rows["gram"].to_numpy(), rows["n"].to_numpy())
        return pa.table({"lang": pa.array([key[0].as_py()], pa.string())} | {k: pa.array([[x.tobytes() for x in getattr(tree, k)]], pa.list_(pa.binary())) for k in kinds})

    grown = counts(sample(labelled)).groupBy("lang").applyInArrow(run, "lang string, " + ", ".join(f"{k} array<binary>" for k in kinds))
    types = (np.uint32, np.float32, np.uint32, np.float32)
    found = {r.lang: Tree(*([np.frombuffer(bytes(x), t) for x in r[k]] for k, t in zip(kinds, types, strict=True))) for r in grown.collect()}
    return Model(sorted(found), [found[k] for k in sorted(found)]) if found else None


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score of every document. Reads only doc_id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = batch["text"].to_pylist()
            names, scores = ["und"] * len(texts), [0.0] * len(texts)
            at = [k for k, t in enumerate(texts) if model and t and any(map(str.isalpha, t))]
            if at:
                bits = model.lengths([texts[k].encode("utf-8", "replace") for k in at])
                best = bits.argmin(axis=1)
                share = 1 / np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000)).sum(axis=1)
                for k, b, p in zip(at, best, share, strict=True):
                    names[k], scores[k] = model.langs[b], float(p)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, PREDICTED)
