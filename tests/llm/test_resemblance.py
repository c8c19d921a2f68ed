"""Resembling texts against brute force, with blocks far smaller than the families."""

import random

import numpy as np
import pytest

from tidemark.llm import resemblance, simhash
from tidemark.llm.common import texts
from tidemark.llm.components import connected_components


def family(rng, words, copies, changes):
    text = [rng.choice(words) for _ in range(120)]
    out = []
    for _ in range(copies):
        changed = list(text)
        for at in rng.sample(range(len(changed)), rng.randint(0, changes)):
            changed[at] = f"own{rng.random()}"
        out.append(" ".join(changed))
    return out


def test_shared_counts():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 6000, n).astype(np.uint64)) for n in (0, 1, 50, 4000, 5000, 30)]
    got = resemblance.shared_counts(sets[:4], sets[2:])
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[2:]] for a in sets[:4]]


@pytest.mark.parametrize("block", [8, 1024])
def test_components_equal_all_pairs(spark, block):
    rng = random.Random(block)
    words = [f"w{k}" for k in range(400)]
    rows = family(rng, words, 90, 9) + family(rng, words, 40, 3) + [" ".join(rng.choices(words, k=30)) for _ in range(20)] + ["", "one", "one", "one two"]
    rows += rows[:5]
    df = texts(spark.createDataFrame(list(enumerate(rows)) + [(None, rows[0]), (None, None)], "doc_id long, text string").repartition(5))
    marked = simhash.fingerprints(df, banded=True)
    edges = resemblance.resembling(df, marked, 0.8, block=block)
    group = {r.node: r.component for r in connected_components(edges).collect()}
    prints = {r.doc_id: r.fp for r in marked.collect() if r.doc_id is not None}
    sets = [resemblance.shingle_set(t) for t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if len(sets[i]) and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) or prints[i] == prints[j]:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    mine, want = [group.get(prints[k], prints[k]) for k in range(len(rows))], [root(k) for k in range(len(rows))]
    assert len(set(zip(mine, want))) == len(set(mine)) == len(set(want))
    assert 24 < len(set(want)) < 110
    assert resemblance.resembling(df.limit(0), marked.limit(0), 0.8).count() == 0


def _joined(edges, nodes):
    up = {v: v for v in nodes}

    def root(v):
        while up[v] != v:
            v = up[v]
        return v

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return {v: root(v) for v in nodes}


@pytest.mark.parametrize("seed", range(4))
def test_joining_pairs_join_what_all_pairs_join_and_repeat_nothing(seed):
    rng = np.random.default_rng(seed)
    base = [rng.integers(0, 1 << 63, 40, dtype=np.uint64) for _ in range(6)]
    sets = [np.unique(np.concatenate([base[k % 6][: 40 - k % 5], rng.integers(0, 1 << 63, k % 4, dtype=np.uint64)])) for k in range(60)]
    names = rng.permutation(1000)[:60].astype(np.int64)
    earlier = {int(n): int(names[k - k % 3]) for k, n in enumerate(names)}  # groups that an earlier pass has joined
    for cut in (None, 25):
        left, right = (sets, sets) if cut is None else (sets[:cut], sets[cut:])
        sides = (names, names) if cut is None else (names[:cut], names[cut:])
        groups = tuple(np.array([earlier[int(n)] if cut else int(n) for n in side]) for side in sides)
        start = [] if cut is None else list(earlier.items())
        alike = [
            (int(n), int(m))
            for n, a in zip(sides[0], left)
            for m, b in zip(sides[1], right)
            if len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b))
        ]
        got = resemblance.joining_pairs(left, right, sides, groups, 0.8)
        assert set(got) <= set(alike)
        nodes = [int(n) for n in names]
        assert _joined(start + got, nodes) == _joined(start + alike, nodes)
        assert len(got) == len(set(_joined(start, nodes).values())) - len(set(_joined(start + alike, nodes).values()))
