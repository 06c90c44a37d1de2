"""N-gram Jaccard join: a size-aware heavy-light similarity join of 5-word shingle sets.

Equal sets are one class, kept once. All shingles have one global order: those that
stand in several documents come last, rarest first, the others are ordered by hash.
Two sets that reach the similarity share at least one shingle of their prefixes in
this order, and two of prefixes that are longer by one. So

* small sets (up to a boundary) enumerate the 2-subsets of their longer prefix, and
  meet where they share a subset;
* large sets are found by scanning the inverted lists of single prefix shingles;
  small sets whose size comes near the boundary stand in these lists as well.

The boundary is the one of least estimated cost. Where two sets meet first, so many
shingles must be left in both that they can still reach the similarity; meetings that
leave too few are dropped before any text is looked at. Lists with many near copies
would still make pairs by the square. Components are therefore found in rounds: in
each list only one hub is compared with the others, components are merged, and the
next round looks only at lists that still hold several components. A last round
compares all pairs of a list that are still in different components, so that no link
is missed.

Nulls, empty texts and texts without words have no shingles and link with nothing.
A text of fewer than five words is one shingle. Repeated rows with one doc_id are one
document; if their texts differ, the smallest of them is the document's text. A null
doc_id gets no row in the result of components() (it can't be named by an id), and
deduplicate() keeps its rows. An empty table gives an empty result. Only doc_id and
text are read, so other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import shingle_sets, sliced, small_or_shuffled, written

#: Link: 100 * intersection >= PERCENT * union.
PERCENT = 80
WIDTH = 5
#: Sets above this size are large whatever the cost.
MOST_SMALL = 64
#: A shingle is frequent if it stands in so many documents.
FREQUENT_LEAST = 8
#: Frequent shingles that are told apart by their counts, the most frequent ones; this bounds what is sent to tasks and never changes the result.
FREQUENT_MOST = 300_000
#: Shingles are counted by their upper bits.
COUNTED_BITS = 48
#: Shingles that a task holds before it passes their counts on.
COUNTED_HELD = 400_000
#: Characters of text whose shingles are counted in one group.
GROUP_CHARS = 1_000_000
#: Star rounds go on while the last one would look at more pairs than so many times the rows of its lists.
EASY = 200
#: A list's rows beyond this are dealt out to several tasks, as are pairs of one document.
SHARE_ROWS = 2_000

SETS = "doc_id bigint, n_shingles bigint, k1 bigint, k2 bigint, prefix array<bigint>"


def least_overlap(n: int, percent: int = PERCENT) -> int:
    """Shingles that a set of n must share with any set it links with."""
    return -(-percent * n // 100)


def _sets(batch: pa.RecordBatch, column: str = "text") -> list[np.ndarray]:
    return shingle_sets([text.encode("utf-8", "replace") if text else b"" for text in batch[column].to_pylist()], WIDTH)


def frequencies(docs: DataFrame, least: int) -> DataFrame:
    """shingle (its upper COUNTED_BITS), n: all shingles that stand in at least so many documents.

    Tasks sum up what they hold and pass it on by ranges of shingles, each range one row
    of sorted differences, whose upper bytes are mostly 0 and shrink in the shuffle.
    """
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = max(0, int(chars // GROUP_CHARS).bit_length())
    shift = np.uint64(COUNTED_BITS - bits)

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(held) >> np.uint64(64 - COUNTED_BITS), return_counts=True)
        ranges = values >> shift
        cuts = np.flatnonzero(ranges[1:] != ranges[:-1]) + 1
        steps = [np.diff(x, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes() for x in np.split(values, cuts)]
        times = [x.astype("<u4").tobytes() for x in np.split(counts, cuts)]
        firsts = ranges[np.concatenate([[0], cuts])].view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(firsts), pa.array(steps, pa.binary()), pa.array(times, pa.binary())], names=["range", "steps", "times"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in sliced(batches):
            for found in _sets(batch):
                held.append(found)
                size += len(found)
            if size > COUNTED_HELD:
                yield flush(held)
                held, size = [], 0
        if size:
            yield flush(held)

    def add(group: pa.Table) -> pa.Table:
        values = [np.cumsum(np.frombuffer(x, np.uint8).reshape(8, -1).T.copy().view(np.uint64).ravel(), dtype=np.uint64) for x in group["steps"].to_pylist()]
        counts = [np.frombuffer(x, "<u4") for x in group["times"].to_pylist()]
        both, where = np.unique(np.concatenate(values), return_inverse=True)
        total = np.bincount(where, np.concatenate(counts), len(both)).astype(np.int64)
        often = total >= least
        return pa.table({"shingle": both[often].view(np.int64), "n": total[often]})

    parts = docs.select("text").mapInArrow(run, "range bigint, steps binary, times binary")
    return parts.groupBy("range").applyInArrow(add, "shingle bigint, n bigint")


def frequent(docs: DataFrame) -> np.ndarray:
    """Frequent shingles (upper bits), rarest first. They only shape the order of shingles, never the result."""
    rows = frequencies(docs, FREQUENT_LEAST).orderBy(F.desc("n"), "shingle").limit(FREQUENT_MOST).collect()
    return np.array([r.shingle for r in rows[::-1]], np.int64).view(np.uint64)


def sets(docs: DataFrame, often: np.ndarray) -> DataFrame:
    """Per document: size, 128-bit key and prefix of its shingle set in the global order."""
    by_hash = np.argsort(often)
    sorted_often, ranks = often[by_hash], by_hash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sizes, firsts, seconds, prefixes = [], [], [], []
            for found in _sets(batch):
                n = len(found)
                key = xxhash.xxh3_128_intdigest(found.tobytes())
                sizes.append(n)
                firsts.append((key >> 64) - (1 << 63))
                seconds.append((key & (1 << 64) - 1) - (1 << 63))
                length = min(n, n - least_overlap(n) + 1 + (n <= MOST_SMALL))
                if n and len(sorted_often):
                    upper = found >> np.uint64(64 - COUNTED_BITS)
                    at = np.searchsorted(sorted_often, upper)
                    at[at == len(sorted_often)] = 0
                    is_often = sorted_often[at] == upper
                    rare = found[~is_often]
                    if len(rare) < length:
                        rest = found[is_often][np.argsort(ranks[at[is_often]], kind="stable")]
                        rare = np.concatenate([rare, rest])
                    found = rare
                prefixes.append(found[:length].view(np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(prefixes)))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(firsts, pa.int64()), pa.array(seconds, pa.int64()), lists],
                names=[x.split()[0] for x in SETS.split(", ")],
            )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null").mapInArrow(run, SETS)


def boundary(sizes: dict[int, int], list_rows: float = 4.0, percent: int = PERCENT) -> int:
    """The largest size of a small set, by estimated cost.

    sizes: number of sets by size, up to MOST_SMALL. A small set costs the rows of its
    2-subsets, and its single shingles again if it can reach a large set. A set in the
    inverted lists costs its rows, and as many comparisons as the lists are long.
    """

    def cost(b: int) -> float:
        total = 0.0
        for n, count in sizes.items():
            p = n - least_overlap(n, percent) + 1
            scan = p * (1 + list_rows)
            if n > b:
                total += count * scan
            else:
                total += count * (min(n, p + 1) * (min(n, p + 1) - 1) / 2 * 1.5 + (scan if 100 * n >= percent * (b + 1) else 0))
        return total

    return min(range(MOST_SMALL + 1), key=lambda b: (cost(b), b))


def postings(classes: DataFrame, b: int, percent: int = PERCENT) -> DataFrame:
    """key, rep, size: rows of the inverted lists and of the subsets.

    size holds the set's size n and how many of its shingles are left from here on,
    this one included (for a subset, from its second one on and one more), in one
    number: the largest shuffle moves these rows.
    """
    n = F.col("n")
    p = n - F.ceil(n * percent / F.lit(100)) + 1
    # sets of up to three shingles only link with equal sets
    large = classes.where((n > 3) & (100 * n >= percent * (b + 1))).select(
        "rep", "n", F.posexplode(F.slice("prefix", F.lit(1), p.cast("int"))).alias("pos", "key")
    )
    pair = lambda x, y: F.xxhash64(F.least(x, y), F.greatest(x, y), F.lit(2))
    subsets = F.flatten(F.transform("prefix", lambda y, k: F.transform(F.slice("prefix", F.lit(1), k), lambda x: F.struct((k - 1).alias("pos"), pair(x, y).alias("key")))))
    small = classes.where((n > 3) & (n <= b)).select("rep", "n", F.explode(subsets).alias("s")).select("rep", "n", "s.pos", "s.key")
    rows = large.select("key", "rep", "n", "pos").unionByName(small.select("key", "rep", "n", "pos"))
    return rows.select("key", "rep", (n * _SIZES + n - F.col("pos")).alias("size"))


_SIZES = 1 << 28


def _may_link(p: Column, q: Column, percent: int = PERCENT) -> Column:
    """Whether two sets that first meet here can reach the similarity, by their sizes and what is left of both."""
    n, m = F.floor(p / _SIZES), F.floor(q / _SIZES)
    least = F.ceil(percent * (n + m) / F.lit(100 + percent))
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (F.least(p % _SIZES, q % _SIZES) >= least)


def _shares(rows: Column) -> Column:
    return F.ceil(rows / SHARE_ROWS).cast("int")


def _with_text(pairs: DataFrame, docs: DataFrame, name: str, other: str, text: str) -> DataFrame:
    """The text of document `name` brought to each pair; pairs of one document are dealt out, with a copy of the text for each share."""
    counts = written(pairs.groupBy(name).agg(_shares(F.count("*")).alias("shares")), "ids")
    few = small_or_shuffled(counts, counts.count())
    texts = docs.select(F.col("doc_id").cast("bigint").alias(name), F.col("text").alias(text)).join(few, name)
    texts = texts.select(name, text, F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    dealt = pairs.join(few, name).withColumn("share", F.pmod(F.xxhash64(other), "shares").cast("int")).drop("shares")
    return dealt.join(texts, [name, "share"]).drop("share")


def linked(docs: DataFrame, pairs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those of the pairs (a, b of doc_ids) whose exact shingle sets reach the similarity.

    The two texts are brought to each pair: they are a third as large as their sets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            keep, known = [], {}
            for column in ("left", "right"):
                for text in batch[column].to_pylist():
                    known.setdefault(text, len(known))
            sets = shingle_sets([t.encode("utf-8", "replace") for t in known], WIDTH)
            for left, right in zip(batch["left"].to_pylist(), batch["right"].to_pylist(), strict=True):
                x, y = sets[known[left]], sets[known[right]]
                # both are distinct: what stands twice in the two together is in both
                both = np.sort(np.concatenate([x, y]), kind="stable")
                inter = int((both[1:] == both[:-1]).sum())
                keep.append(100 * inter >= percent * (len(x) + len(y) - inter))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = _with_text(_with_text(pairs, docs, "b", "a", "right"), docs, "a", "b", "left")
    return both.select("a", "b", "left", "right").mapInArrow(run, "a bigint, b bigint")


def connected(edges: DataFrame) -> DataFrame:
    """id, label of all ends of edges (a, b): label is the smallest id reachable.

    Every round takes the smallest label around each id, then follows the label's own
    label; each round is a table in the shared folder. Rounds grow with the logarithm
    of a component's width.
    """
    edges = edges.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b")).where("a <> b")
    both = written(edges.union(edges.select("b", "a")).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.min("a")).alias("label")), "labels")
    rows = labels.count()
    while True:
        old = small_or_shuffled(labels, rows)
        around = both.join(old.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        # an id's neighbourhood also pulls its old label down, so that whole trees move at once
        nearer = around.join(old, "id").select("id", "label", F.least("label", "near").alias("new"))
        pulled = nearer.select("id", "new").union(nearer.where("new < label").select(F.col("label").alias("id"), "new"))
        lowest = pulled.groupBy("id").agg(F.min("new").alias("new"))
        up = old.select(F.col("id").alias("new"), F.col("label").alias("upper"))
        jumped = lowest.join(up, "new", "left").select("id", F.least("new", F.coalesce("upper", "new")).alias("label"))
        now = written(jumped, "labels")
        changed = now.join(old.withColumnRenamed("label", "old"), "id").where("label <> old").limit(1).count()
        labels = now
        if not changed:
            return labels


def _merged(labels: DataFrame | None, edges: DataFrame) -> DataFrame:
    """Labels after edges are added to what labels already says."""
    return connected(edges if labels is None else edges.unionByName(labels.select(F.col("id").alias("a"), F.col("label").alias("b"))))


def _distinct(x: str, y: str, rows: DataFrame) -> DataFrame:
    """Distinct (a, b), a < b, of the ids in two columns."""
    return rows.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def _open(lists: DataFrame, labels: DataFrame | None, turn: int) -> DataFrame:
    """The rows of lists that hold several components, with their labels, the list's rows and its hub.

    The first hub is a set with few shingles that are rarer than the list's own, as an
    original has that all others were copied from; later ones go by a hash, so that
    lists of the same sets have the same hub.
    """
    if labels is None:
        known = lists.withColumn("label", F.col("rep"))
    else:
        known = lists.join(small_or_shuffled(labels.withColumnRenamed("id", "rep"), labels.count()), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    order = F.xxhash64("rep", F.lit(turn))
    if turn == 0:
        order = F.struct(F.floor(F.col("size") / _SIZES) - F.col("size") % _SIZES, order)
    w = Window.partitionBy("key")
    known = known.withColumns({
        "rows": F.count("*").over(w), "low": F.min("label").over(w), "high": F.max("label").over(w),
        "hub": F.min_by(F.struct("rep", "size", "label"), order).over(w),
    })
    return written(known.where("low < high").drop("low", "high"), "open")


def links(docs: DataFrame, classes: DataFrame, b: int) -> DataFrame | None:
    """id, label over class representatives that link with another class; None if there is none."""
    several = F.count("*").over(Window.partitionBy("key"))
    lists = written(postings(classes, b).withColumn("rows", several).where("rows > 1").drop("rows"), "lists")
    labels = tried = None
    turn, fruitful = 0, True
    while True:
        rows = _open(lists, labels, turn)
        others = rows.where(F.col("label") != F.col("hub.label"))
        stats = others.agg(F.sum("rows").alias("pairs"), F.count("*").alias("rows")).first()
        if not stats.rows:
            return labels
        last = turn > 0 and (not fruitful or stats.pairs <= EASY * stats.rows)
        if last:
            # whatever two components a list holds, a row of one of them isn't of the hub's; each pair comes up once a list
            share = F.pmod(F.xxhash64("rep"), _shares(F.col("rows"))).cast("int")
            x = others.select("key", share.alias("share"), F.col("rep").alias("x"), F.col("size").alias("p"), F.col("label").alias("one"), F.col("hub.label").alias("main"))
            y = rows.select(F.col("key").alias("list"), F.explode(F.sequence(F.lit(0), _shares(F.col("rows")) - 1)).alias("part"), F.col("rep").alias("y"), F.col("size").alias("q"), F.col("label").alias("two"))
            met = (F.col("key") == F.col("list")) & (F.col("share") == F.col("part")) & (F.col("one") != F.col("two")) & ((F.col("two") == F.col("main")) | (F.col("x") < F.col("y")))
            found = _distinct("x", "y", x.join(y, met & _may_link(F.col("p"), F.col("q"))))
        else:
            found = _distinct("rep", "hub.rep", others.where(_may_link(F.col("size"), F.col("hub.size"))))
        new = written(found if tried is None else found.join(tried, ["a", "b"], "left_anti"), "pairs")
        looked = new.count()
        if looked:
            edges = written(linked(docs, new), "links")
            many = edges.count()
            if many:
                labels = _merged(labels, edges)
            fruitful = 20 * many > looked
        else:
            fruitful = False
        if last:
            return labels
        tried = new if tried is None else tried.union(new)
        lists, turn = rows.select("key", "rep", "size"), turn + 1


def _same_text(docs: DataFrame, found: DataFrame) -> bool:
    """Whether all rows of one doc_id have the same set."""
    return not found.groupBy("doc_id").agg(F.min(F.struct("k1", "k2")).alias("a"), F.max(F.struct("k1", "k2")).alias("b")).where("a <> b").limit(1).count()


def components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every document that has an id."""
    documents = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null")
    often = frequent(documents)
    found = written(sets(documents, often), "prefixes")
    if not _same_text(documents, found):
        documents = written(documents.groupBy("doc_id").agg(F.min("text").alias("text")), "documents")
        found = written(sets(documents, often), "prefixes")
    key = ["n_shingles", "k1", "k2"]
    full = found.where("n_shingles > 0")
    classes = full.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.first("prefix").alias("prefix"))
    classes = written(classes.select("rep", F.col("n_shingles").alias("n"), "k1", "k2", "prefix"), "classes")
    sizes = {r.n: r["count"] for r in classes.where(f"n <= {MOST_SMALL}").groupBy("n").count().collect()}
    labels = links(documents, classes.select("rep", "n", "prefix"), boundary(sizes))
    member = classes.select("rep", F.col("n").alias("n_shingles"), "k1", "k2")
    if labels is not None:
        member = member.join(small_or_shuffled(labels.withColumnRenamed("id", "rep"), labels.count()), "rep", "left").select(F.coalesce("label", "rep").alias("rep"), *key)
    out = full.select("doc_id", *key).distinct().join(member, key).select("doc_id", "n_shingles", F.col("rep").alias("component_id"))
    empty = found.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")).distinct()
    return out.unionByName(empty)


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of docs whose document is the smallest id of its component, one row each (the smallest text's, then any)."""
    names = docs.columns
    found = written(components(docs).where("doc_id = component_id").select(F.col("doc_id").alias("__head")), "heads")
    heads = found.count()
    kept = docs.join(small_or_shuffled(found, heads), F.col("doc_id").cast("bigint") == F.col("__head"), "left_semi")
    if kept.select("doc_id").count() > heads:
        nth = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.asc_nulls_first("text")))
        kept = kept.withColumn("__nth", nth).where("__nth = 1").select(*names)
    return kept.unionByName(docs.where("doc_id is null"))
