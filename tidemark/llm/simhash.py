"""SimHash near-duplicates through a Gray-order hierarchical index.

Distinct fingerprints are sorted by Gray rank, so that neighbours share long
runs of leading bits. The upper part of the index is a tree of bit prefixes whose leaves
hold about equally many fingerprints; it has a bounded number of nodes and every
task gets a copy. A fingerprint walks it with its accumulated differences and
visits just those leaves (its own, and later ones in Gray order) that can still
hold a link. A leaf is one group of rows: its fingerprints, in Gray order, are
grouped again and again; a node keeps the bits all below it share, children
only those not already in their parent, and a search prunes a whole group once
the differences on the way down exceed the limit.

The search is exact: every pair within the limit lies in some visited leaf. Copies
collapse to one fingerprint before anything is shuffled by it; where rows meet their group again, those of a
fingerprint that holds a large share of all rows are dealt to many tasks.

Defined cases: null text is empty; a text without words has fingerprint zero and
links like any other; fewer words than a shingle form one shingle; repeated rows
each get their row; a null doc_id keeps its row and never names a component unless
all of it are null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import resemblance
from tidemark.llm.common import hot_keys, join_spread, materialise, shuffle_partitions, texts
from tidemark.llm.components import connected_components

_BITS_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_COLUMN = (np.arange(8) * 256)[None, :]


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a whole text, as a signed integer."""
    from xxhash import xxh64_digest

    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    line, width = b" ".join(words), min(shingle, len(words))
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    n, counts = len(words) - width + 1, np.zeros((8, 8), dtype=np.int64)
    for at in range(0, n, 65_536):
        upto = min(n, at + 65_536)
        raw = b"".join([xxh64_digest(line[a : b - 1], seed) for a, b in zip(starts[at:upto], ends[at + width - 1 : upto + width - 1])])
        counts += np.bincount((np.frombuffer(raw, dtype=np.uint8).reshape(-1, 8) + _COLUMN).ravel(), minlength=2048).reshape(8, 256) @ _BITS_OF_BYTE
    return int.from_bytes(np.packbits((2 * counts > n).ravel()).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", banded: bool = False) -> DataFrame:
    """doc_id, fp (signed long) of every whole text, and t, the hash of the text as it is; with ``banded`` keys besides, the bands of its five-word shingles."""

    def keys_of(text: str) -> np.ndarray | None:
        shingles = resemblance.shingle_set(text)
        return resemblance.band_keys(shingles) if len(shingles) else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "fp": np.array([fingerprint(t, shingle, seed) for t in batch["text"]], dtype=np.int64), "t": batch["t"]})
            yield out.assign(keys=[keys_of(t) for t in batch["text"]]) if banded else out

    return texts(docs, id_col, text_col).withColumn("t", F.xxhash64("text")).mapInPandas(run, "doc_id long, fp long, t long" + ", keys array<long>" * banded)


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """The place of each 64-bit pattern in the Gray sequence. Its leading bits depend on the pattern's leading bits alone."""
    rank = fp.astype(np.uint64)
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank ^ (rank >> np.uint64(shift))
    return rank


class PrefixTree:
    """The upper index: leaves are (depth, prefix); ``number`` is a leaf's place in Gray order."""

    def __init__(self, leaves: list[tuple[int, int]]):
        keys = [(int(gray_rank(np.array([p << (64 - d) if d else 0], dtype=np.uint64))[0]) >> (64 - d) << (64 - d) if d else 0) for d, p in leaves]
        order = sorted(range(len(leaves)), key=keys.__getitem__)
        self.leaf_number = {leaves[k]: n for n, k in enumerate(order)}
        self.nodes: list[list[int]] = [[-1, -1, -1]]  # child by bit, leaf number
        for (depth, prefix), number in self.leaf_number.items():
            at = 0
            for level in range(depth):
                bit = prefix >> (depth - 1 - level) & 1
                if self.nodes[at][bit] < 0:
                    self.nodes[at][bit] = len(self.nodes)
                    self.nodes.append([-1, -1, -1])
                at = self.nodes[at][bit]
            self.nodes[at][2] = number
        self.table = np.array(self.nodes, dtype=np.int64)

    def visits(self, fps: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the fingerprint, leaf, whether it is its own leaf) of every leaf that may hold a link, its own and later ones."""
        who, at, diff = np.arange(len(fps)), np.zeros(len(fps), dtype=np.int64), np.zeros(len(fps), dtype=np.int64)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for level in range(65):
            leaf = self.table[at, 2]
            done = leaf >= 0
            found.append((who[done], leaf[done], diff[done] == 0))
            who, at, diff = who[~done], at[~done], diff[~done]
            if not len(who):
                break
            bit = (fps[who] >> np.uint64(63 - level) & np.uint64(1)).astype(np.int64)
            same, other = self.table[at, bit], self.table[at, 1 - bit]
            stay, cross = same >= 0, (other >= 0) & (diff < limit)
            who, at, diff = np.concatenate([who[stay], who[cross]]), np.concatenate([same[stay], other[cross]]), np.concatenate([diff[stay], diff[cross] + 1])
        who, leaf, own = map(np.concatenate, zip(*found))
        home = np.zeros(len(fps), dtype=np.int64)
        home[who[own]] = leaf[own]
        later = leaf >= home[who]
        return who[later], leaf[later], own[later]


def prefix_leaves(fps: DataFrame, leaf_rows: int) -> list[tuple[int, int]]:
    """Leaves (depth, prefix) of the upper index with ``leaf_rows`` fingerprints each at most, split where they are dense.

    A round counts prefixes at a depth that gives some four per expected leaf, so
    each of these counts brings at most about 4 n / leaf_rows rows to the driver; the caller's
    ``leaf_rows`` bounds that by a constant.
    """
    leaves: list[tuple[int, int]] = []
    heavy, depth = {0: fps.count()}, 0
    while heavy:
        if depth == 64 or max(heavy.values()) <= leaf_rows:
            return leaves + [(depth, p) for p in heavy]
        deeper = min(64, depth + max(1, int(max(heavy.values()) / leaf_rows).bit_length() + 1))
        prefix = lambda d: F.shiftrightunsigned("fp", 64 - d) if d else F.lit(0).cast("long")
        inside = fps if not depth else fps.join(F.broadcast(fps.sparkSession.createDataFrame([(p,) for p in heavy], "above long")), prefix(depth) == F.col("above"), "left_semi")
        counts = {r["prefix"] & ((1 << deeper) - 1): r["count"] for r in inside.groupBy(prefix(deeper).alias("prefix")).count().collect()}
        tree = [dict() for _ in range(deeper + 1)]
        tree[deeper] = counts
        for level in range(deeper - 1, depth - 1, -1):
            for p, n in tree[level + 1].items():
                tree[level][p >> 1] = tree[level].get(p >> 1, 0) + n
        heavy_next: dict[int, int] = {}
        open_nodes = list(tree[depth])
        for level in range(depth, deeper + 1):
            nxt = []
            for p in open_nodes:
                n = tree[level][p]
                if n <= leaf_rows:
                    leaves.append((level, p))
                elif level == deeper:
                    heavy_next[p] = n
                else:
                    nxt += [c for c in (2 * p, 2 * p + 1) if c in tree[level + 1]]
            open_nodes = nxt
        heavy, depth = heavy_next, deeper
    return leaves


class GrayIndex:
    """The lower index over one leaf: groups of ``fan`` neighbours in Gray order, shared bits factored upwards."""

    def __init__(self, fps: np.ndarray, fan: int = 8):
        self.fps, self.fan = fps[np.argsort(gray_rank(fps), kind="stable")], fan
        ones, zeros = self.fps, ~self.fps
        mask, levels = np.full(len(fps), ~np.uint64(0)), [[self.fps, None]]
        while len(ones) > 1:
            starts = np.arange(0, len(ones), fan)
            ones, zeros = np.bitwise_and.reduceat(ones, starts), np.bitwise_and.reduceat(zeros, starts)
            shared = ones | zeros
            levels[-1][1] = mask & ~np.repeat(shared, fan)[: len(mask)]
            mask = shared
            levels.append([ones, None])
        levels[-1][1] = mask
        self.levels = levels

    def search(self, queries: np.ndarray, limit: int, block: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, stored fingerprint) of every pair within ``limit`` differing bits, a block of queries at a time."""
        if not len(self.fps):
            return
        for at in range(0, len(queries), block):
            q = queries[at : at + block]
            pattern, mask = self.levels[-1]
            who, node = np.arange(len(q)), np.zeros(len(q), dtype=np.int64)
            diff = np.bitwise_count((q ^ pattern[0]) & mask[0]).astype(np.int64)
            keep = diff <= limit
            who, node, diff = who[keep], node[keep], diff[keep]
            for pattern, mask in self.levels[-2::-1]:
                child = (node[:, None] * self.fan + np.arange(self.fan)).ravel()
                who, diff = np.repeat(who, self.fan), np.repeat(diff, self.fan)
                real = child < len(pattern)
                child, who, diff = child[real], who[real], diff[real]
                diff = diff + np.bitwise_count((q[who] ^ pattern[child]) & mask[child])
                keep = diff <= limit
                who, node, diff = who[keep], child[keep], diff[keep]
            yield q[who], self.fps[node]


class _Forest:
    """Union-find over what one leaf has found: only edges that join two trees are handed on."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (p := up.setdefault(x, x)) != x:
            up[x] = up[p]
            x = up[x]
        return x

    def join(self, pairs: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
        out = []
        for a, b in pairs:
            x, y = self.root(a), self.root(b)
            if x != y:
                self.up[max(x, y)] = min(x, y)
                out.append((a, b))
        return out


def links(fps: DataFrame, limit: int = 2, leaf_rows: int = 1024, most_leaves: int = 4096) -> DataFrame:
    """a, b (signed longs): edges between the distinct ``fp`` values that join everything within ``limit`` bits, directly or through others."""
    n = fps.count()
    tree = fps.sparkSession.sparkContext.broadcast(PrefixTree(prefix_leaves(fps, max(leaf_rows, n // most_leaves)) or [(0, 0)]))

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = batch["fp"].to_numpy(dtype=np.int64)
            who, leaf, own = tree.value.visits(values.view(np.uint64), limit)
            yield pd.DataFrame({"leaf": leaf.astype(np.int32), "visitor": ~own, "fp": values[who]})

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        leaf, homes, index, forest = None, [], None, _Forest()
        for batch in batches:
            number, visitor, values = batch["leaf"].to_numpy(), batch["visitor"].to_numpy(), batch["fp"].to_numpy(dtype=np.int64).view(np.uint64)
            cuts = np.flatnonzero(np.diff(number) | np.diff(visitor.astype(np.int8))) + 1
            for a, b in zip([0, *cuts], [*cuts, len(number)]):
                if number[a] != leaf:
                    yield from found(homes, forest)
                    leaf, homes, index, forest = number[a], [], None, _Forest()
                if not visitor[a]:
                    homes.append(values[a:b])
                    continue
                if index is None:
                    yield from found(homes, forest)
                    index, homes = GrayIndex(np.concatenate(homes)) if homes else GrayIndex(values[:0]), []
                yield from pairs(index, values[a:b], forest, False)
        yield from found(homes, forest)

    def found(homes: list, forest: _Forest) -> Iterator[pd.DataFrame]:
        if homes:
            values = np.concatenate(homes)
            yield from pairs(GrayIndex(values), values, forest, True)

    def pairs(index: GrayIndex, queries: np.ndarray, forest: _Forest, own: bool) -> Iterator[pd.DataFrame]:
        for a, b in index.search(queries, limit):
            if own:
                a, b = a[a < b], b[a < b]
            joined = forest.join(zip(a.view(np.int64).tolist(), b.view(np.int64).tolist()))
            if joined:
                yield pd.DataFrame(joined, columns=["a", "b"])

    routed = fps.select("fp").mapInPandas(route, "leaf int, visitor boolean, fp long")
    dealt = routed.repartition(shuffle_partitions(fps.sparkSession), "leaf").sortWithinPartitions("leaf", "visitor")
    return dealt.mapInPandas(search, "a long, b long")


def _rooted(docs: DataFrame, limit: int, shingle: int, seed: int, id_col: str, text_col: str, jaccard: float | None) -> tuple[DataFrame, DataFrame]:
    """The fingerprints of all rows; and fp, least (doc_id), n (rows), root (a fingerprint that names the group) of the distinct ones."""
    marked = materialise(fingerprints(docs, shingle, seed, id_col, text_col, jaccard is not None), "fingerprints")
    distinct = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct")
    edges = links(distinct, limit)
    if jaccard is not None:
        edges = edges.unionByName(resemblance.resembling(texts(docs, id_col, text_col), marked, jaccard))
    groups = connected_components(edges, "simhash")
    rooted = distinct.join(groups, distinct["fp"] == groups["node"], "left").select("fp", "least", "n", F.coalesce("component", "fp").alias("root"))
    return marked, materialise(rooted, "rooted")


def near_duplicates(docs: DataFrame, limit: int = 2, shingle: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", jaccard: float | None = None) -> DataFrame:
    """doc_id, fp, component_id: the least doc_id that links of at most ``limit`` differing bits reach.

    With ``jaccard`` texts that resemble each other so much in their five-word shingles are linked besides.
    """
    marked, rooted = _rooted(docs, limit, shingle, seed, id_col, text_col, jaccard)
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n_fps"))
    by_fp = join_spread(rooted.select("fp", "root"), named.drop("n_fps"), "root", hot_keys(named, "root", "n_fps"), ["fp"]).select("fp", "component_id")
    rows = join_spread(marked.select("doc_id", "fp", "t"), by_fp, "fp", hot_keys(rooted, "fp", "n"), ["doc_id", "t"])
    return rows.select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, limit: int = 2, shingle: int = 3, seed: int = 42, jaccard: float | None = None) -> DataFrame:
    """One row of each group: the one with the least doc_id (null ids come last), then the least hash of its text.

    Rows are told apart by id and text: one id may stand on several texts. Of rows alike in both one stays.
    """
    marked, rooted = _rooted(docs, limit, shingle, seed, "doc_id", "text", jaccard)
    rows = join_spread(marked.select("doc_id", "fp", "t"), rooted.select("fp", "root"), "fp", hot_keys(rooted, "fp", "n"), ["doc_id", "t"])
    best = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")).alias("best")).select(F.col("best.doc_id").alias("_kept_id"), F.col("best.t").alias("_kept_text"))
    place = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(-(1 << 63)))
    hashed = docs.withColumn("_kept_text", F.xxhash64(F.coalesce("text", F.lit("")))).withColumn("_null_id", F.col("doc_id").isNull()).withColumn("_kept_id", place("doc_id"))
    best = best.withColumn("_null_id", F.col("_kept_id").isNull()).withColumn("_kept_id", place("_kept_id"))
    keys = ["_kept_id", "_kept_text", "_null_id"]
    return hashed.join(best, keys, "left_semi").dropDuplicates(keys).drop(*keys)
