"""Conversation repair, exact top-k and dual-tree clustering against plain versions, and their edge cases."""

import hashlib
import itertools
import math
import zlib
from collections import defaultdict

import numpy as np
import pytest

from covenant.llm import lloyd, repair, topk

CONV = "conv_id bigint, turn bigint, role string, text string, copies string, mark int"
VEC = "id bigint, vector array<double>, score double, x string"


def plain_damage(rows):
    for conv, turn, role, text in rows:
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        if fate == 0:
            continue
        text = "" if fate == 1 else text.translate({ord(c): None for c in ".!?"}) if fate == 2 else text
        for _ in range(1 + (fate == 3)):
            yield conv, turn, "user" if fate == 4 else role, text


def plain_repair(rows):
    """Every cheapest edit by brute force: least (cost, audit, result) of all positions and states, by repeated relaxation."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    seen, faults = set(), []
    for _, _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [r[1] for r in rows if r[1] is not None]
    grammar = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
    best = {(0, 0): (0, "", ())}
    while True:
        new = dict(best)
        for (i, q), (cost, audit, out) in best.items():
            options = [((i, to), (cost + 3, audit + "I", (*out, f"{'user' if x == 'u' else 'assistant'}:"))) for x, to in grammar[q].items() if x != "s"]
            if i < len(rows):
                _, _, role, text = rows[i]
                options.append(((i + 1, q), (cost + 4, audit + "D", out)))
                if faults[i] not in ("blank", "duplicate"):
                    more = 3 * (faults[i] == "truncated")
                    if role[:1] in grammar[q]:
                        options.append(((i + 1, grammar[q][role[:1]]), (cost + more, audit + "K", (*out, f"{role}:{text}"))))
                    options += [((i + 1, to), (cost + 3 + more, audit + "R", (*out, f"{'user' if x == 'u' else 'assistant'}:{text}"))) for x, to in grammar[q].items() if x != "s"]
            for node, value in options:
                if node not in new or value < new[node]:
                    new[node] = value
        if new == best:
            break
        best = new
    cost, audit, out = min(best[k] for k in [(len(rows), 0), (len(rows), 3)] if k in best)
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def some_conversations(n, seed=3):
    random = np.random.default_rng(seed)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "u"], ["Fine.", "what", "Oh?", "", " \t", None, "é!", "Fine.", "no end "]
    rows = []
    for conv in range(n):
        turn = 0
        for _ in range(random.integers(1, 9)):
            turn += int(random.integers(0, 3))
            rows.append((conv, None if random.random() < 0.1 else turn, roles[random.integers(len(roles))], texts[random.integers(len(texts))]))
    return rows


def by_conversation(rows, damaged):
    own = {r[0]: [] for r in rows}
    for r in damaged:
        own[r[0]].append(r)
    return {k: plain_repair(v) for k, v in own.items()}


def test_repairs_match_a_plain_version(spark):
    rows = [*some_conversations(60), (None, 1, "user", "Hi."), (None, None, None, None), (1000, 1, "user", "x" * 500_000), (1000, 1, "user", "x" * 500_000)]
    frame = spark.createDataFrame([(*r, "clash", 7) for r in rows], CONV)
    got = {r.conv_id: tuple(r)[1:] for r in repair.repair(repair.damaged(frame)).collect()}
    assert got == by_conversation(rows, plain_damage(rows))
    assert not repair.repair(repair.damaged(frame.where("false"))).count()


@pytest.mark.parametrize("size", [1, 2, 3])
def test_windows_do_not_change_repairs(monkeypatch, size):
    monkeypatch.setattr(repair, "WINDOW_ROWS", size)
    rows = [(c, t, r or " ", x or " ") for c, t, r, x in some_conversations(40, 8)]
    for conv, own in itertools.groupby(rows, lambda r: r[0]):
        ordered = sorted(own, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        first, stream = {}, []
        for r in ordered:
            turn = first.setdefault(r[2:], r[1])
            mark = hashlib.md5(r[3].encode()).digest()
            if turn != r[1] and not any(s[1:3] == r[1:3] and s[4] == mark for s in stream):
                at = next((k for k, s in enumerate(stream) if s[1:3] == r[1:3]), len(stream))
                stream.insert(at, (*r[:3], None, mark, 0))
            stream.append((*r, None, 1))
        [(name, *found)] = repair.mended(stream)
        assert name == conv and tuple(found) == plain_repair(ordered)


def test_a_long_conversation_takes_little_memory():
    import tracemalloc

    rows = ((1, k, "user" if k % 3 else "assistant", f"{k} " + "word " * 200 + ".", None, 1) for k in range(6_000))
    tracemalloc.start()
    [(_, *found)] = repair.mended(rows)
    assert tracemalloc.get_traced_memory()[1] < 12 << 20  # the rows' texts are 6 MB, keys of nodes the rest
    tracemalloc.stop()
    assert found[5] == found[6].count("R") * 3 + found[6].count("I") * 3 + found[6].count("D") * 4


def plain_top_k(rows, k, scale):
    fit = [(i, np.array([math.floor(scale * x) for x in v])) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asked = {}
    for i, v in fit:
        if i % 20 == 0 and (i not in asked or v.tolist() < asked[i].tolist()):
            asked[i] = v
    out = []
    for q, v in asked.items():
        scores = sorted((-int(v @ c), i) for i, c in fit if i != q and len(c) == len(v))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("scale", [1, 64, 1 << 16])
def test_top_k_matches_a_plain_version(spark, scale):
    random = np.random.default_rng(scale)
    rows = [(k, random.normal(size=8).round(int(random.integers(0, 3))).tolist()) for k in range(700)]
    rows += [(k, rows[5][1]) for k in range(700, 900)]  # ties that are more than k
    rows += [(40, [0.5] * 8), (41, [0.5] * 8), (41, [0.5] * 8), (None, [1.0] * 8), (901, None), (902, [None] + [1.0] * 7), (903, [math.nan] * 8), (904, [math.inf] * 8)]
    rows += [(920, []), (921, []), (940, [1.0, 2.0]), (941, [3.0, 4.0]), (960, [1.0] * 3)]
    frame = spark.createDataFrame([(*r, 0.1, "x") for r in rows], VEC)
    got = sorted(map(tuple, topk.top_k(frame.where("id % 20 = 0"), frame, 20, scale).collect()))
    assert got == plain_top_k(rows, 20, scale)
    assert not topk.top_k(frame.where("false"), frame, 20).count() and not topk.top_k(frame.where("id % 20 = 0"), frame.where("false"), 20).count()


def plain_lloyd(rows, k, rounds, size, scale):
    kept = [(i, np.array([math.floor(scale * x) for x in v], object)) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest(), v.tolist()) for i, v in kept)
    centroids = [np.array(v, object) for _, v in named[:k]]

    def nearest(v):
        return min((int(((v - c) ** 2).sum()), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[nearest(v)[1]].append(v)
        for n, vs in own.items():
            centroids[n] = np.array([x // len(vs) for x in sum(vs)], object)
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    sums = defaultdict(int)
    for _, n, d in found:
        sums[n] += d
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, n, d, sums[n], sum(sums.values()), hashes[n]) for i, n, d in found), key=str)


@pytest.mark.parametrize("few", [False, True])
def test_clusters_match_a_plain_version(spark, few):
    random = np.random.default_rng(2)
    centres = random.normal(size=(12, 64))
    rows = [(k, (centres[k % 12] + random.normal(size=64) * 0.02).round(4).tolist()) for k in range(5 if few else 400)]
    rows += [(7, rows[0][1]), (7, rows[0][1]), (None, rows[1][1]), (500, None), (501, [0.1] * 63), (502, [math.nan] * 64), (503, [None] * 64), (504, [0.1] * 65), (505, [])]
    frame = spark.createDataFrame([(*r, 0.1, "x") for r in rows], VEC)
    got = sorted(map(tuple, lloyd.cluster(frame).collect()), key=str)
    assert got == plain_lloyd(rows, 8, 10, 64, 1024)
    assert not lloyd.cluster(frame.where("false")).count()


def test_trees_keep_their_bounds_and_prune():
    random = np.random.default_rng(4)
    centres = random.integers(-9_000, 9_000, (16, 64))
    points = centres[random.integers(0, 16, 2_000)] + random.integers(-90, 90, (2_000, 64))
    points[100:140] = points[100]
    tree, order = lloyd.cover_tree(points)
    points = points[order]
    for node in range(len(tree.centre)):
        own = points[tree.first[node] : tree.last[node]]
        away = np.sqrt(((own - points[tree.centre[node]]) ** 2).sum(axis=1))
        assert tree.first[node] <= tree.centre[node] < tree.last[node] and away.max() <= tree.radius[node]
        children = tree.children(node)
        if children:
            assert tree.centre[children[0]] == tree.centre[node]
            assert sum(tree.last[c] - tree.first[c] for c in children) == len(own)
            net = points[tree.centre[children]].astype(float)
            apart = np.sqrt(((net[:, None] - net[None]) ** 2).sum(axis=2))[~np.eye(len(net), dtype=bool)]
            assert apart.min() > tree.radius[children].max() - 0.1
    for goals in (centres[:8], points[:3], np.repeat(points[:2], 3, axis=0), np.array([[10] * 64, [-10] * 64])):
        labels, subtrees, counts = lloyd.assign(tree, points, goals)
        assert (labels == lloyd.distances(points, goals).argmin(axis=1)).all()
    labels, subtrees, counts = lloyd.assign(tree, points, centres[:8])
    assert len(subtrees) and counts["compared"] < 0.7 * len(points) * 8
