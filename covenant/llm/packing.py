"""Best-fit packing of tokenised documents by bin completion.

Documents longer than a sequence are cut; every piece then has a length of at most
``capacity``. How many pieces there are of each length is a table of at most
``capacity`` rows whatever the corpus, so the branch-and-bound runs on these counts:
it gives patterns (how many pieces of which lengths fill a sequence, and how often).
Bin packing has no quick exact way, so the search stops after MAX_NODES nodes with the best
packing so far; gap() says how many sequences it may be from the best one, and pack() logs it.
Pieces are numbered within their length on Spark and look up their place in the
patterns. Null and empty texts give one piece: the closing id alone. Repeated rows
are packed each on their own; an empty table gives an empty result. Only doc_id and
text are read.
"""

from __future__ import annotations

import bisect
import json
import logging
import os
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import sliced, written

log = logging.getLogger(__name__)

CAPACITY = 2048
#: Search nodes of the branch-and-bound before the best packing so far is taken.
MAX_NODES = 4_000
#: Undominated fillings of a node that are put in order, fullest first, before the next ones are looked for.
SORTED_FILLINGS = 8
#: Steps of a node's enumeration at most.
STEPS = 200
#: Distinct words whose ids a task remembers.
CACHED_TOKENS = 250_000
#: Distinct letter runs of such words; they are only looked up for a word that isn't remembered.
CACHED_RUNS = 50_000
#: Pieces that are numbered together in one group, on average.
GROUP_ROWS = 20_000

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, salt int"
#: White space besides space, tab and line ends, and what might join across it: such texts are encoded whole.
_OTHER_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f\u3000\ufeff]")
#: Outside visible ASCII and Latin letters whose lower case is one letter: such parts are encoded whole.
_NOT_LATIN = re.compile("[^!-~\u00a1-\u00ac\u00ae-\u012f\u0131-\u0148\u014a-\u017e]")


@cache
def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it is visible, else one from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in visible)
    return {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(others)}


class Encoder:
    """Ids of texts as little-endian uint32 bytes.

    The tokenizer drops white space and never joins over it, so the ids of the parts
    between white space are remembered and put together. A new part of Latin letters
    goes through the tokenizer's own steps (its pattern, then its model), and their
    results for letter runs are remembered as well; any other part, and any tokenizer
    with other steps, is encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.words: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {}
        steps = json.loads(self.tokenizer.to_str())
        normal = [x["type"] for x in (steps["normalizer"] or {}).get("normalizers", [])]
        before = (steps["pre_tokenizer"] or {}).get("pretokenizers", [])
        spaces = [x for x in (steps["normalizer"] or {}).get("normalizers", []) if x["type"] == "Replace"]
        # what is replaced must be white space by a space, which the parts between white space can't hold
        only_space = all(x["content"] == " " and x["pattern"] == {"Regex": "\\s+"} for x in spaces)
        known = only_space and normal == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in before] == ["Split", "ByteLevel"] and not before[1]["add_prefix_space"]
        self.pattern = regex.compile(before[0]["pattern"]["Regex"]) if known else None

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _run(self, run: str) -> bytes:
        letters = run if run.isascii() else run.encode().decode("latin-1").translate(_byte_letters())
        ids = [t.id for t in self.tokenizer.model.tokenize(letters)]
        found = self.runs[run] = struct.pack(f"<{len(ids)}I", *ids)
        return found

    def _word(self, word: str) -> bytes:
        if self.pattern and not _NOT_LATIN.search(word):
            runs = self.runs
            parts = self.pattern.findall(unicodedata.normalize("NFC", word).lower())
            return b"".join([runs.get(x) or self._run(x) for x in parts])
        return self._ids(word)

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.words) > CACHED_TOKENS:
            self.words.clear()
        if len(self.runs) > CACHED_RUNS:
            self.runs.clear()
        words, out = self.words, []
        for text in texts:
            if _OTHER_SPACE.search(text):
                out.append(self._ids(text))
                continue
            parts = text.split()
            for w in parts:
                if w not in words:
                    words[w] = self._word(w)
            out.append(b"".join([words[w] for w in parts]))
        return out


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Tokenise whole texts, close each with end_id and cut at capacity tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(tokenizer)
        closing = np.array([end_id], "<u4").tobytes()
        row = 0
        for batch in sliced(batches):
            out = []
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), encode([t or "" for t in batch["text"].to_pylist()]), strict=True):
                ids += closing
                step = 4 * capacity
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    row += 1
                    out.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), row * 40503 & 0x3FFFFFFF))
            columns = zip(*out, strict=True)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, kind) for x, kind in zip(columns, kinds, strict=True)],
                names=[x.split()[0] for x in PIECES.split(", ")],
            )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, PIECES)


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """Best-fit decreasing on counts of lengths: (times, {length: pieces}) patterns. The first incumbent."""
    left = {k: v for k, v in counts.items() if v}
    patterns = []
    while left:
        lengths = sorted(left)
        filling: dict[int, int] = {}
        room = capacity
        while True:
            at = bisect.bisect_right(lengths, room)
            while at and filling.get(lengths[at - 1], 0) >= left[lengths[at - 1]]:
                at -= 1
            if not at:
                break
            length = lengths[at - 1]
            most = min(room // length, left[length] - filling.get(length, 0))
            filling[length] = filling.get(length, 0) + most
            room -= most * length
        times = min(left[k] // v for k, v in filling.items())
        patterns.append((times, filling))
        for k, v in filling.items():
            left[k] -= v * times
            if not left[k]:
                del left[k]
    return patterns


def fillings(left: dict[int, int], lengths: list[int], capacity: int = CAPACITY, steps: int = STEPS) -> Iterator[dict[int, int]]:
    """Undominated ways to complete a sequence around the longest piece, as they are asked for.

    lengths: those of left, rising. A filling dominates another if the other's pieces can be
    put into its pieces' places. A perfect fill by one piece dominates every other; otherwise
    a filling is left out if another piece still fits, or a longer one in place of one of its own.
    """
    first, room = lengths[-1], capacity - lengths[-1]
    have = lambda k: left[k] - (k == first)
    if room == 0:
        yield {first: 1}
        return
    if left.get(room, 0) and have(room):
        yield {first: 2} if room == first else {first: 1, room: 1}
        return
    spent = 0

    def extend(space: int, below: int, chosen: tuple[tuple[int, int], ...]) -> Iterator[tuple[int, tuple]]:
        nonlocal spent
        for k in range(min(below, bisect.bisect_right(lengths, space)) - 1, -1, -1):
            spent += 1
            if spent > steps:
                return
            length = lengths[k]
            for n in range(min(have(length), space // length), 0, -1):
                yield from extend(space - n * length, k, (*chosen, (length, n)))
        used = dict(chosen)
        free = lambda k: have(k) - used.get(k, 0)
        for k in lengths:
            if k > space:
                break
            if free(k):
                return
        for x in used:
            up = bisect.bisect_right(lengths, x)
            if up < len(lengths) and lengths[up] - x <= space and free(lengths[up]):
                return
        yield space, chosen

    found = extend(room, len(lengths), ())
    while some := list(islice(found, SORTED_FILLINGS)):
        for _, chosen in sorted(some):
            filling = {first: 1}
            for length, n in chosen:
                filling[length] = filling.get(length, 0) + n
            yield filling


def lower_bound(counts: dict[int, int], capacity: int = CAPACITY) -> int:
    """Sequences needed at least: by the sum, and by pieces over half a sequence."""
    total = sum(k * v for k, v in counts.items())
    return max(-(-total // capacity), sum(v for k, v in counts.items() if 2 * k > capacity))


def gap(counts: dict[int, int], patterns: list[tuple[int, dict[int, int]]], capacity: int = CAPACITY) -> int:
    """Sequences of a packing beyond the lower bound: how far it may be from the best at most."""
    return sum(t for t, _ in patterns) - lower_bound(counts, capacity)


def bin_completion(counts: dict[int, int], capacity: int = CAPACITY, max_nodes: int = MAX_NODES) -> list[tuple[int, dict[int, int]]]:
    """Patterns with as few sequences as the search finds; best-fit is the incumbent.

    Depth first: the longest remaining piece is completed by each undominated filling,
    applied as often as the counts allow, then once. A branch is pruned once its waste
    exceeds what a packing better than the incumbent can afford. Counts are changed on
    the way down and set back on the way up.
    """
    left = {int(k): int(v) for k, v in counts.items() if v}
    best = best_fit(left, capacity)
    used, least = sum(t for t, _ in best), lower_bound(left, capacity)
    lengths = sorted(left)
    total, big = sum(k * v for k, v in left.items()), sum(v for k, v in left.items() if 2 * k > capacity)
    path: list[tuple[int, dict[int, int]]] = []
    bins = nodes = 0

    def put(times: int, filling: dict[int, int]) -> None:
        nonlocal total, big, bins
        bins += times
        for k, v in filling.items():
            before = left.get(k, 0)
            now = left[k] = before - times * v
            total -= k * times * v
            big -= times * v if 2 * k > capacity else 0
            if not now:
                del left[k]
                del lengths[bisect.bisect_left(lengths, k)]
            elif not before:
                bisect.insort(lengths, k)

    def choices() -> Iterator[tuple[int, dict[int, int]]]:
        for filling in fillings(left, lengths, capacity):
            most = min(left[k] // v for k, v in filling.items())
            yield most, filling
            if most > 1:
                yield 1, filling

    frames = [choices()] if left else []
    while frames and used > least and nodes < max_nodes:
        choice = next(frames[-1], None)
        if choice is None:
            frames.pop()
            if path:
                times, filling = path.pop()
                put(-times, filling)
            continue
        nodes += 1
        put(*choice)
        path.append(choice)
        if bins + max(-(-total // capacity), big) < used and left:
            frames.append(choices())
            continue
        if not left and bins < used:
            best, used = list(path), bins
        times, filling = path.pop()
        put(-times, filling)
    return best


def _plan(patterns: list[tuple[int, dict[int, int]]]) -> dict[str, np.ndarray]:
    """For every (length, first rank): first sequence, pieces a sequence, offset; sorted for look-up."""
    rows, sequence, ranks = [], 0, {}
    for times, filling in patterns:
        offset = 0
        for length in sorted(filling, reverse=True):
            each = filling[length]
            rows.append((length, ranks.get(length, 0), sequence, each, offset))
            ranks[length] = ranks.get(length, 0) + times * each
            offset += length * each
        sequence += times
    rows.sort()
    table = np.array(rows or [(0, 0, 0, 1, 0)], np.int64)
    return {"key": (table[:, 0] << 44) + table[:, 1], "rank": table[:, 1], "sequence": table[:, 2], "each": table[:, 3], "offset": table[:, 4]}


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece.

    The pieces (without their ids) are written to the shared folder once; their
    lengths are counted, ranked within (length, group) and placed.
    """
    cut = written(pieces(docs, tokenizer, capacity), "pieces")
    counts = {row.length: row["count"] for row in cut.groupBy("length").count().collect()}
    patterns = bin_completion(counts, capacity)
    log.info("%d pieces in %d sequences, %d more than the lower bound", sum(counts.values()), sum(t for t, _ in patterns), gap(counts, patterns, capacity))
    plan = _plan(patterns)
    groups = max(8, -(-sum(counts.values()) // GROUP_ROWS))
    cut = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "salt"), F.lit(groups)).cast("int"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = (
        cut.groupBy("length", "salt").agg(F.count("*").alias("rows"))
        .select("length", "salt", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"))
    )
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = cut.withColumn("rank", F.row_number().over(inside)).join(firsts, ["length", "salt"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch[k].to_numpy(zero_copy_only=False).astype(np.int64) for k in ("length", "rank"))
            at = np.searchsorted(plan["key"], (length << 44) + rank, "right") - 1
            along = rank - plan["rank"][at]
            each = plan["each"][at]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(
                [*(batch[k] for k in names), pa.array(plan["sequence"][at] + along // each), pa.array(plan["offset"][at] + along % each * length)],
                names=[*names, "sequence_id", "offset"],
            )

    return ranked.select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("rank") - 1).cast("bigint").alias("rank")
    ).mapInArrow(place, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
