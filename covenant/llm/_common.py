"""Helpers that several operators of this subpackage share.

Words are maximal runs of bytes other than space and 0x09-0x0D, the bytes at which
``bytes.split()`` splits, so texts are handled as UTF-8 inside tasks.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are hashed at a time.
LINE_BYTES = 1 << 18
#: Rows and, about, bytes of an Arrow batch that are turned into Python objects at a time.
SLICE_ROWS = 256
SLICE_BYTES = 2 << 20
#: A table of at most this many bytes may be broadcast, by its counted rows; larger ones are joined by shuffle.
BROADCAST_BYTES = 32 << 20
#: Bytes that a value of such a table is taken to need.
VALUE_BYTES = 16

_P1 = np.uint64(0x9E3779B97F4A7C15)
_P2 = np.uint64(0xBF58476D1CE4E5B9)
_S1 = np.uint64(29)
_S2 = np.uint64(32)
_BREAK = re.compile(rb"[ \t-\r]")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set and all run on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isEmpty():
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="covenant-"))
            known = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = known.get()
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_or_shuffled(df: DataFrame, rows: int, value_bytes: int = VALUE_BYTES) -> DataFrame:
    """Mark df for broadcast if its counted rows are within BROADCAST_BYTES; otherwise leave the join to the shuffle."""
    return F.broadcast(df) if rows * len(df.columns) * value_bytes <= BROADCAST_BYTES else df


def sliced(batches: Iterable, rows: int = SLICE_ROWS) -> Iterator:
    """Record batches cut into slices, so that only a few texts are Python objects at once."""
    for batch in batches:
        step = max(1, min(rows, SLICE_BYTES * batch.num_rows // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
        del batch
        pa.default_memory_pool().release_unused()


_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LETTER = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)
_UPPER = np.arange(256)
_UPPER[65:91] += 32
#: Values of bytes in a word's hash: as they are, and with A-Z as a-z.
EXACT, FOLDED = _LETTER, _LETTER[_UPPER]


@cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    base = int(_P1)
    both = []
    for x in (base, pow(base, -1, 1 << 64)):
        row = np.full(size, x, np.uint64)
        row[0] = 1
        both.append(np.multiply.accumulate(row))
    return both[0], both[1]


def _line_hashes(raw: bytes, tables: tuple[np.ndarray, ...], edges: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a line's words by each table, and where the words start."""
    line = np.frombuffer(raw, np.uint8)
    turn = np.diff(_SPACE[line].view(np.int8), prepend=1, append=1)
    starts, ends = np.flatnonzero(turn == -1), np.flatnonzero(turn == 1)
    first, last = starts, ends
    if edges is not None and len(starts):
        inner = np.flatnonzero(~edges[line])
        if len(inner):
            a = inner[np.minimum(np.searchsorted(inner, starts), len(inner) - 1)]
            b = inner[np.maximum(np.searchsorted(inner, ends) - 1, 0)] + 1
            some = (a >= starts) & (a < ends)
            first, last = np.where(some, a, starts), np.where(some, b, ends)
    power, inverse = _powers(1 << max(16, int(len(line) + 1).bit_length()))
    out = np.empty((len(tables), len(starts)), np.uint64)
    for k, table in enumerate(tables):
        total = np.zeros(len(line) + 1, np.uint64)
        np.cumsum(table[line] * power[: len(line)], out=total[1:])
        out[k] = mixed((total[last] - total[first]) * inverse[first] + (last - first).astype(np.uint64) * _P2)
    return out, starts


def word_hashes(texts: list[bytes], *tables: np.ndarray, edges: np.ndarray | None = None) -> list[np.ndarray]:
    """For each text an array (tables x words) of 64-bit word hashes; edges marks bytes that are cut off a word's ends.

    Texts are put together into lines of about LINE_BYTES, longer ones cut at white
    space, and each line's hashes come from sums of powers over all its bytes at once.
    """
    out: list[list[np.ndarray]] = [[] for _ in texts]
    line: list[bytes] = []
    owners: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal line, owners, size
        found, starts = _line_hashes(b" ".join(line), tables, edges)
        cuts = np.searchsorted(starts, np.cumsum([len(x) + 1 for x in line])[:-1])
        for k, part in zip(owners, np.split(found, cuts, axis=1), strict=True):
            out[k].append(part)
        line, owners, size = [], [], 0

    for k, text in enumerate(texts):
        at = 0
        while at < len(text):
            end = min(len(text), at + LINE_BYTES)
            if end < len(text) and (found := _BREAK.search(text, end)):
                end = found.start()
            elif end < len(text):
                end = len(text)
            line.append(text[at:end])
            owners.append(k)
            size += end - at
            at = end
            if size >= LINE_BYTES:
                flush()
    if line:
        flush()
    none = np.empty((len(tables), 0), np.uint64)
    return [np.concatenate(x, axis=1) if len(x) > 1 else x[0] if x else none for x in out]


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective scrambling of uint64 values."""
    values = (values ^ (values >> _S2)) * _P2
    return values ^ (values >> _S1)


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of every run of width consecutive words, in order."""
    if len(hashes) < width:
        return np.empty(0, np.uint64)
    last = len(hashes) - width + 1
    out = mixed(hashes[:last] + np.uint64(width))
    for k in range(1, width):
        out = mixed(out * _P1 + hashes[k : last + k])
    return out


def shingle_sets(texts: list[bytes], width: int = 5) -> list[np.ndarray]:
    """Each text's sorted distinct width-word shingles, A-Z as a-z; a shorter sequence is one shingle, no word gives none."""
    return [np.unique(windows(h[0], min(width, h.shape[1]))) if h.shape[1] else h[0] for h in word_hashes(texts, FOLDED)]
