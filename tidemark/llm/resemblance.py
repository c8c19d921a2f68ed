"""Texts that resemble each other: Jaccard similarity of their five-word shingles, compared exactly within families.

Bands of minima say which texts may be alike; texts that bands connect, directly or through others, are a
family. Every text goes to its family once. A family is compared in blocks of bounded size: a block counts the
shingles that its members share as one product of matrices, and hands on only edges that join what was apart. Families of
several blocks are compared block against block in a second pass, but blocks that the first pass has joined into one
group need no comparison. Pairs never become rows.

Defined cases: texts without words resemble nothing; fewer words than a shingle form one shingle; copies of a text are
compared once; an empty table gives no edges.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import drop_scratch, materialise, shuffle_partitions
from tidemark.llm.components import connected_components

_BANDS, _ROWS = 32, 5  # a pair at Jaccard 0.8 shares no band with probability (1 - 0.8**5)**32 = 3e-6
_RNG = np.random.default_rng(17)
_MIX = _RNG.integers(0, 1 << 63, (2, _BANDS * _ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLD = _RNG.integers(0, 1 << 63, (_BANDS, _ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_COLUMNS = 4096


def shingle_set(text: str, width: int = 5) -> np.ndarray:
    """The distinct hashes (unsigned 64-bit) of all runs of ``width`` words; a shorter text is one run, none without words."""
    from xxhash import xxh64_digest

    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    line, width = b" ".join(words), min(width, len(words))
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    return np.unique(np.frombuffer(b"".join([xxh64_digest(line[a : b - 1]) for a, b in zip(starts, ends[width - 1 :])]), dtype=">u8").astype(np.uint64))


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """One key a band of minima, as signed integers; sets that are alike share some."""
    least = np.full(_BANDS * _ROWS, ~np.uint64(0))
    for at in range(0, len(shingles), 2048):
        least = np.minimum(least, (shingles[at : at + 2048, None] * _MIX[0] + _MIX[1]).min(0))
    folded = ((least >> np.uint64(7)).reshape(_BANDS, _ROWS) * _FOLD).sum(1, dtype=np.uint64)
    return (folded ^ (folded >> np.uint64(29))).view(np.int64)


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many shingles each of ``left`` shares with each of ``right``, by products of 0/1 matrices a few columns at a time."""
    (x, i), (y, j) = [(np.concatenate(s), np.repeat(np.arange(len(s)), [len(x) for x in s])) for s in (left, right)]
    columns = np.unique(x) if left is right else np.intersect1d(x, y)
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    for at in range(0, len(columns), _COLUMNS):
        some = columns[at : at + _COLUMNS]
        dense = []
        for values, owners, n in ((x, i, len(left)), (y, j, len(right)))[: 1 if left is right else 2]:
            place = np.minimum(np.searchsorted(some, values), len(some) - 1)
            here = some[place] == values
            matrix = np.zeros((n, len(some)), dtype=np.float32)
            matrix[owners[here], place[here]] = 1
            dense.append(matrix)
        out += dense[0] @ dense[-1].T
    return out


def joining_pairs(left: list[np.ndarray], right: list[np.ndarray], names: tuple[np.ndarray, np.ndarray], groups: tuple[np.ndarray, np.ndarray], jaccard: float) -> list[tuple[int, int]]:
    """(name, name) of pairs at ``jaccard`` or more that join two groups; pairs of one group, or of what earlier pairs have joined, are left out."""
    both = shared_counts(left, right)
    total = np.array([len(s) for s in left])[:, None] + np.array([len(s) for s in right])[None, :]
    alike = both >= jaccard * (total - both) - 1e-6
    del both, total
    # one label a group; a row of the matrix at a time, so that what is held does not grow with the number of pairs
    labels, place = np.unique(np.concatenate(groups), return_inverse=True)
    label, own, other = np.arange(len(labels)), place[: len(left)], place[len(left) :]
    out = []
    for a in range(len(left)):
        near = np.flatnonzero(alike[a])
        mine = label[own[a]]
        apart, first = np.unique(label[other[near]], return_index=True)
        for there, b in zip(apart.tolist(), near[first].tolist()):
            if there != mine:
                label[label == there] = mine
                out.append((int(names[0][a]), int(names[1][b])))
    return out


def families(marked: DataFrame) -> DataFrame:
    """t, family: texts that bands connect, directly or through others. ``marked``: t, keys (array of long, null without words)."""
    spots = materialise(marked.select("t", F.posexplode("keys").alias("band", "key")).distinct(), "bands")
    buckets = spots.groupBy("band", "key").agg(F.min("t").alias("lead"), F.max("t").alias("last")).filter("lead < last").drop("last")
    edges = spots.join(buckets, ["band", "key"]).select(F.col("lead").alias("a"), F.col("t").alias("b"))
    found = connected_components(edges, "families").select(F.col("node").alias("t"), F.col("component").alias("family"))
    found = materialise(found, "families")
    drop_scratch(spots)
    return found


def resembling(docs: DataFrame, marked: DataFrame, jaccard: float, width: int = 5, block: int = 1024, block_chars: int = 1 << 23) -> DataFrame:
    """a, b: fingerprints of texts with a Jaccard similarity of ``jaccard`` or more; enough edges to join everything that is alike.

    ``docs``: doc_id, text (no nulls); ``marked``: doc_id, t (hash of the text), fp, keys, one row each.
    """
    groups, parts = families(marked), shuffle_partitions(docs.sparkSession)
    # of copies the one with the least id is read; a null id counts as the least
    place = F.coalesce("doc_id", F.lit(-(1 << 63))).alias("place")
    one = marked.select("t", "fp", place).groupBy("t").agg(F.min("place").alias("place"), F.min("fp").alias("fp")).join(groups, "t")
    held = docs.select("text", F.xxhash64("text").alias("t"), place).join(one, ["t", "place"]).dropDuplicates(["t"])
    held = materialise(held.select("t", "fp", "family", "text"), "held")
    sizes = held.groupBy("family").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).filter("n > 1")
    slots = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("chars") / block_chars)).cast("long")
    cut = materialise(held.join(sizes.select("family", slots.alias("slots")), "family").withColumn("slot", F.pmod(F.xxhash64("t", "fp"), "slots")), "blocks")

    def within(rows: list[pd.DataFrame]) -> list[tuple[int, int]]:
        rows = pd.concat(rows).drop_duplicates("t")
        sets, names = [shingle_set(x, width) for x in rows["text"]], rows["fp"].to_numpy(dtype=np.int64)
        return joining_pairs(sets, sets, (names, names), (names, names), jaccard)

    def across(rows: list[pd.DataFrame]) -> list[tuple[int, int]]:
        rows = pd.concat(rows)
        sides = [rows[rows["side"] == k] for k in (0, 1)]
        if not all(map(len, sides)):
            return []
        sets = [[shingle_set(x, width) for x in side["text"]] for side in sides]
        return joining_pairs(*sets, tuple(s["fp"].to_numpy(dtype=np.int64) for s in sides), tuple(s["part"].to_numpy(dtype=np.int64) for s in sides), jaccard)

    def grouped(work, *by: str):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            last, rows = None, []
            for batch in batches:
                keys = list(zip(*(batch[c] for c in by)))
                starts = [k for k in range(len(keys)) if not k or keys[k] != keys[k - 1]]
                for a, b in zip(starts, [*starts[1:], len(keys)]):
                    if keys[a] != last and rows:
                        yield edges(work(rows))
                        rows = []
                    last = keys[a]
                    rows.append(batch.iloc[a:b])
            if rows:
                yield edges(work(rows))

        return run

    def edges(found: list[tuple[int, int]]) -> pd.DataFrame:
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    dealt = cut.select("family", "slot", "t", "fp", "text").repartition(parts, "family", "slot").sortWithinPartitions("family", "slot")
    first = materialise(dealt.mapInPandas(grouped(within, "family", "slot"), "a long, b long"), "alike")

    # families of several blocks: members regrouped by what has been joined so far; large groups get blocks of their own
    wide = cut.filter("slots > 1")
    if not wide.take(1):
        return first
    joined = connected_components(first, "alike")
    wide = wide.join(joined, F.col("fp") == F.col("node"), "left").select("family", "slots", "slot", "t", "fp", "text", F.coalesce("component", "fp").alias("part"))
    large = wide.groupBy("family", "part").agg(F.count("*").alias("m")).filter(F.col("m") >= block // 8).select("family", "part", F.lit(True).alias("large"))
    wide = wide.join(large, ["family", "part"], "left").withColumn("whole", F.when(F.col("large"), F.col("part")))
    wide = materialise(wide.withColumn("cell", F.xxhash64("whole", "slot")).drop("large"), "wide")
    cells = wide.select("family", "cell", "whole").distinct()
    other = cells.select("family", F.col("cell").alias("right"), F.col("whole").alias("other"))
    pairs = cells.withColumnRenamed("cell", "left").join(other, "family").filter("left <= right AND NOT coalesce(whole = other, false)")
    tiles = pairs.select("family", "left", "right", F.explode(F.array(F.struct(F.col("left").alias("cell"), F.lit(0).alias("side")), F.struct(F.col("right").alias("cell"), F.lit(1).alias("side")))).alias("c"))
    dealt = wide.join(tiles.select("family", "left", "right", "c.cell", "c.side"), ["family", "cell"]).select("family", "left", "right", "side", "t", "fp", "part", "text")
    dealt = dealt.repartition(parts, "family", "left", "right").sortWithinPartitions("family", "left", "right")
    second = materialise(dealt.mapInPandas(grouped(across, "family", "left", "right"), "a long, b long"), "alike")
    return first.unionByName(second)
