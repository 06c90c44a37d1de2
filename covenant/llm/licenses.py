"""License scans: MinHash bands over overlapping windows, verified by exact shingle containment.

Templates are cut into 5-word shingles. Texts are looked at in windows of about a
template's length, each starting a few words after the last; a window's MinHash bands
are held against the templates'. Window and step are such that a whole copy of a
template fills most of some window. With BANDS bands of ROWS hashes, a window as
similar as s shares a band with probability 1 - (1 - s**ROWS)**BANDS: 0.9993 at 0.6,
which is what a copy at the threshold reaches in its best window at worst, and over
0.999997 at 0.8. With one hash a band, any window whose least shingle is one of a
template's eight is verified, which is one pass over its shingles. A window's minimum can
only be a template's where the window holds that shingle: these shingles (anchors) are
looked up in every text first, and bands are made of the windows that hold one of their
class, which gives the same windows as bands of all. What the bands retrieve is then
verified: a match is a stretch of the text that holds at least CONTAINMENT percent of the
template's distinct shingles.

The templates are the full license texts and the standard notices in license_texts/;
others can be given as a mapping. A catalogue of any size is dealt with in parts of
PART_SHINGLES, each held against all texts; a long text is looked at in stretches that
overlap by a window.

Words are compared with A-Z lower-cased and without ASCII punctuation at their ends.
Null and empty texts, and texts of fewer than five words, match nothing; repeated rows
are scanned alike; an empty table gives an empty result, an empty catalogue too. A
template of fewer than five words never matches. Where stretches of one template
overlap, the one that holds most stays (of those the shortest, then the first); templates
are independent of each other, in order of place and name. Only doc_id and text are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache, reduce
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import FOLDED, mixed, sliced, windows, word_hashes

WIDTH = 5
BANDS, ROWS = 8, 1
CONTAINMENT = 80
#: Shingles of the templates that go to a task at once.
PART_SHINGLES = 2_000_000
#: Shingles of a text that are hashed at once.
STRETCH = 200_000
TEXTS = Path(__file__).parent / "license_texts"


@cache
def notices() -> dict[str, str]:
    """The bundled templates by name: a full text for each file, and the sections of notices.txt."""
    out = {f.stem: f.read_text("utf-8", "replace") for f in TEXTS.glob("*.txt") if f.stem != "notices"}
    for section in (TEXTS / "notices.txt").read_text("utf-8").split("## ")[1:]:
        name, _, text = section.partition("\n")
        out[name] = text.strip()
    return out


_WORD = re.compile(rb"[^ \t-\r]+")
_EDGES = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

MATCHES = "doc_id bigint, license string, first_word bigint, n_words bigint, start bigint, end bigint, containment double"


# a word of punctuation alone stays as it is, so that positions stay those of the text
_CUT = np.zeros(256, bool)
_CUT[list(_EDGES)] = True


def _windows(texts: list[bytes]) -> list[np.ndarray]:
    return [windows(h[0], WIDTH) for h in word_hashes(texts, FOLDED, edges=_CUT)]


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are among the known ones, which are sorted and not none."""
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


class Catalogue:
    """Shingles, anchors (what makes a band's minimum) and band keys of the templates, by length class."""

    def __init__(self, templates: dict[str, str], bands: int = BANDS, rows: int = ROWS):
        rng = np.random.default_rng(20240607)
        self.rows, self.bands = rows, bands
        self.salts = rng.integers(1, 1 << 63, bands * rows, dtype=np.uint64) | np.uint64(1)
        self.names = sorted(templates)
        self.shingles = _windows([templates[k].encode() for k in self.names])
        self.classes: dict[int, dict[str, np.ndarray]] = {}
        for k, own in enumerate(self.shingles):
            if len(own):
                # templates of nearly one length share their windows
                width = int(np.ceil(1.15 ** np.ceil(np.log(len(own)) / np.log(1.15)))) if len(own) > 1 else 1
                self.classes.setdefault(width, {"members": []})["members"].append(k)
        for width, one in self.classes.items():
            members = np.array(one["members"])
            anchors = np.array([self.shingles[k][self._hashed(self.shingles[k]).argmin(axis=1)] for k in members])
            keys = np.array([self._bands(mixed(own * self.salts)[:, None])[:, 0] for own in anchors])
            order = np.argsort(keys, axis=0, kind="stable")
            least = min(len(np.unique(self.shingles[k])) for k in members)
            one |= {"step": max(1, width // 8), "keys": np.take_along_axis(keys, order, 0), "members": members[order], "least": least, "anchors": np.unique(anchors)}
        self.anchors = np.unique(np.concatenate([one["anchors"] for one in self.classes.values()])) if self.classes else np.empty(0, np.uint64)

    def _hashed(self, found: np.ndarray) -> np.ndarray:
        return mixed(found[None, :] * self.salts[:, None])

    def _bands(self, signature: np.ndarray) -> np.ndarray:
        """bands x windows keys from (bands * rows) x windows minima."""
        out = signature[:: self.rows]
        for r in range(1, self.rows):
            out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + signature[r :: self.rows])
        return out

    def retrieved(self, found: np.ndarray, percent: int = CONTAINMENT) -> set[tuple[int, int, int]]:
        """(template, first shingle, end) of windows that share a band with a template."""
        # a text with fewer shingles than a copy needs holds none
        classes = [(w, self.classes[w]) for w in sorted(self.classes) if 100 * len(found) >= percent * self.classes[w]["least"]]
        if not classes:
            return set()
        overlap = classes[-1][0] + classes[-1][1]["step"]
        out = set()
        for base in range(0, len(found), STRETCH):
            out |= {(k, base + a, base + b) for k, a, b in self._stretch(found[base : base + STRETCH + overlap], classes)}
        return out

    def _stretch(self, found: np.ndarray, classes: list[tuple[int, dict]]) -> Iterator[tuple[int, int, int]]:
        near = np.flatnonzero(_among(found, self.anchors))
        if not len(near):
            return
        minima, reach = self._hashed(found), 1
        for width, one in classes:
            held = near[_among(found[near], one["anchors"])]
            if not len(held):
                continue
            step = one["step"]
            # a window holds a whole copy wherever it starts
            size = min(len(found), width + step - 1)
            while reach < size:  # minima over growing stretches, from one class to the next
                by = min(reach, size - reach)
                minima = np.minimum(minima[:, :-by], minima[:, by:])
                reach += by
            starts = np.minimum(np.arange(0, max(1, len(found) - size + step), step), minima.shape[1] - 1)
            starts = starts[np.searchsorted(held, starts + size) > np.searchsorted(held, starts)]
            keys = self._bands(minima[:, starts])
            for band in range(self.bands):
                own = one["keys"][:, band]
                low, high = np.searchsorted(own, keys[band], "left"), np.searchsorted(own, keys[band], "right")
                for w in np.flatnonzero(high > low):
                    for member in one["members"][low[w] : high[w], band]:
                        yield int(member), int(starts[w]), int(starts[w]) + size


def verified(found: np.ndarray, template: np.ndarray, spans: list[tuple[int, int]], percent: int = CONTAINMENT) -> Iterator[tuple[int, int, float]]:
    """(first shingle, end, containment) of the template's shingles in and around each window that holds enough; windows in order of their starts."""
    known, margin = np.unique(template), len(template) // 2
    around = [(max(0, first - margin), min(len(found), end + margin)) for first, end in spans]
    at = 0
    while at < len(around):
        # what overlaps is looked up together, and left together if all of it holds too little
        (start, stop), upto = around[at], at + 1
        while upto < len(around) and around[upto][0] < stop:
            stop, upto = max(stop, around[upto][1]), upto + 1
        which = np.minimum(np.searchsorted(known, found[start:stop]), len(known) - 1)
        where = np.flatnonzero(known[which] == found[start:stop])
        which, where = which[where], where + start
        if len(where) and 100 * np.count_nonzero(np.bincount(which)) >= percent * len(known):
            for a, b in dict.fromkeys(around[at:upto]):
                low, high = np.searchsorted(where, (a, b))
                if hit := _trimmed(where[low:high], which[low:high], len(template), len(known), percent):
                    yield hit
        at = upto


def _trimmed(where: np.ndarray, which: np.ndarray, size: int, distinct: int, percent: int) -> tuple[int, int, float] | None:
    """The stretch of hits at places where, of shingles which, if they hold enough of the template's distinct ones."""
    left = np.bincount(which)
    held = int(np.count_nonzero(left))
    if not len(where) or 100 * held < percent * distinct:
        return None
    # drop far hits at the ends that the containment doesn't need
    low, high = 0, len(where) - 1
    while low < high and where[high] - where[low] >= 2 * size:
        drop_last = where[high] - where[high - 1] >= where[low + 1] - where[low]
        dropped = which[high if drop_last else low]
        if left[dropped] == 1:
            break
        left[dropped] -= 1
        low, high = (low, high - 1) if drop_last else (low + 1, high)
    return int(where[low]), int(where[high]) + 1, held / distinct


def matches(found: np.ndarray, catalogue: Catalogue, percent: int = CONTAINMENT) -> list[tuple[int, int, int, float]]:
    """(template, first shingle, end, containment), the best of those that overlap with one template."""
    out: list[tuple[int, int, int, float]] = []
    spans: dict[int, list[tuple[int, int]]] = {}
    for member, first, end in sorted(catalogue.retrieved(found, percent)):
        spans.setdefault(member, []).append((first, end))
    for member, near in spans.items():
        own = verified(found, catalogue.shingles[member], near, percent)
        taken: list[tuple[int, int]] = []
        for a, b, share in sorted(own, key=lambda x: (-x[2], x[1] - x[0], x[0])):
            if all(b <= x or y <= a for x, y in taken):
                taken.append((a, b))
                out.append((member, a, b, share))
    return sorted(out, key=lambda x: (x[1], x[0], x[2]))


def _parts(templates: dict[str, str]) -> Iterator[dict[str, str]]:
    """The templates in groups of about PART_SHINGLES words."""
    part, size = {}, 0
    for name in sorted(templates):
        part[name] = templates[name]
        size += len(templates[name].split())
        if size >= PART_SHINGLES:
            yield part
            part, size = {}, 0
    if part:
        yield part


def scan(docs: DataFrame, templates: dict[str, str] | None = None, percent: int = CONTAINMENT) -> DataFrame:
    """MATCHES' columns: one row for each stretch of a text that holds a template. start and end are code points."""
    parts = list(_parts(notices() if templates is None else templates)) or [{}]
    return reduce(DataFrame.unionByName, (_scan(docs, Catalogue(part), percent) for part in parts))


def _scan(docs: DataFrame, catalogue: Catalogue, percent: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in MATCHES.split(", ")]
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
        for batch in sliced(batches):
            rows = []
            texts = [t.encode("utf-8", "replace") if t else b"" for t in batch["text"].to_pylist()]
            for doc_id, raw, found in zip(batch["doc_id"].to_pylist(), texts, _windows(texts), strict=True):
                if not len(found) or not catalogue.classes:
                    continue
                places = None
                for member, a, b, share in matches(found, catalogue, percent):
                    places = places or [m.span() for m in _WORD.finditer(raw)]
                    start, end = places[a][0], places[b + WIDTH - 2][1]
                    chars = len(raw[:start].decode("utf-8", "replace"))
                    rows.append((doc_id, catalogue.names[member], a, b - a + WIDTH - 1, chars, chars + len(raw[start:end].decode("utf-8", "replace")), share))
            columns = zip(*rows, strict=True) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, MATCHES)
