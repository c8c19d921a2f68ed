"""Approximate nearest neighbours: inverted lists scanned with adaptive dimension sampling.

Vectors are rotated at random, so that a few leading coordinates estimate a whole distance without bias. Within each
probed list candidates are kept in column blocks; after every block a hypothesis test against the best
distances so far abandons those whose partial distance is already significantly too large
(``partial > bound * d / D * (1 + significance / sqrt(d))**2`` on squares). Survivors get their exact distance on the original vectors.

The index (centroids, and how many lists to probe for ``recall``) is fitted on ``fit_rows`` vectors at most, picked by a hash
of their id; every row is assigned to a list. Large lists are cut into blocks of about ``block_rows`` rows,
and a query goes to all blocks of the lists it probes, so a list that holds a third of all rows is shared by many tasks.
A query's threshold is its k-th distance within the fitting sample, an upper bound of the true one. Where the scan finds fewer than k,
sampled neighbours fill up the rows (unless ``fill`` is off); they never stand in for what the scan has missed.

Defined cases: see ``usable_vectors``; a query's own row is never its neighbour; fewer candidates than k give fewer rows;
ties go to the smaller vec_id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import materialise, shuffle_partitions
from tidemark.llm.vectors import rotation, stacked, usable_vectors


@dataclass(frozen=True)
class ListIndex:
    """What every task needs; its size depends on ``fit_rows`` and ``lists``, not on the table."""

    turn: np.ndarray
    centroids: np.ndarray  # rotated
    sample: np.ndarray  # as given
    sample_ids: np.ndarray
    probes: int

    def nearest_sampled(self, v: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places in the sample and exact distances of the k nearest of it (infinite where there are fewer)."""
        d = squared_distances(v, self.sample)
        d[ids[:, None] == self.sample_ids[None, :]] = np.inf
        k = min(k, d.shape[1])
        at = np.argpartition(d, k - 1, axis=1)[:, :k]
        exact = np.sqrt(((self.sample[at] - v[:, None, :]) ** 2).sum(2))
        return at, np.where(np.isinf(np.take_along_axis(d, at, axis=1)), np.inf, exact)

    def nearest_lists(self, rotated: np.ndarray, n: int) -> np.ndarray:
        d = (self.centroids**2).sum(1)[None, :] - 2 * rotated @ self.centroids.T
        n = min(n, d.shape[1])
        return np.argpartition(d, n - 1, axis=1)[:, :n] if n < d.shape[1] else np.tile(np.arange(d.shape[1]), (len(d), 1))


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(0, (a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * a @ b.T)


def _k_means(x: np.ndarray, lists: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(rounds):
        near = np.concatenate([np.argmin(squared_distances(x[k : k + 4096], centres), axis=1) for k in range(0, len(x), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(centres))
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def fit(vectors: DataFrame, n: int, k: int, recall: float = 0.97, fit_rows: int = 8192, most_lists: int = 1024, trials: int = 256, seed: int = 11) -> ListIndex:
    """Centroids by k-means on the sample, and the number of probes that finds ``recall`` of the sample's own neighbours."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(fit_rows).toPandas()
    dimensions = len(rows["v"].iloc[0])
    turn = rotation(dimensions, dimensions, seed)
    given = stacked(rows["v"], dimensions)
    x = given @ turn
    centres = _k_means(x, max(1, min(most_lists, int(n**0.5), len(x) // 8 or 1)))
    asked = x[:trials]
    d = squared_distances(asked, x)
    d[np.arange(len(asked)), np.arange(len(asked))] = np.inf
    true = np.argsort(d, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
    own = np.concatenate([np.argmin(squared_distances(x[s : s + 4096], centres), axis=1) for s in range(0, len(x), 4096)])
    order = np.argsort(squared_distances(asked, centres), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(centres))[None, :], axis=1)
    ranks = np.sort(np.take_along_axis(place, own[true], axis=1).ravel()) if true.size else np.zeros(1, dtype=int)
    probes = int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))))]) + 1
    return ListIndex(turn, centres, given, rows["vec_id"].to_numpy(), probes)


def scan(queries: np.ndarray, bounds: np.ndarray, candidates: np.ndarray, width: int, significance: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, candidate) pairs that no test abandons: partial squared distances grow by a column block at a time."""
    dimensions = queries.shape[1]

    def limit(upto: int) -> np.ndarray:
        return bounds * (1 + 1e-9) if upto == dimensions else bounds * upto / dimensions * (1 + significance / upto**0.5) ** 2

    upto = min(dimensions, width)
    first = squared_distances(queries[:, :upto], candidates[:, :upto])
    who, which = np.nonzero(first <= limit(upto)[:, None] + 1e-12)
    partial = first[who, which]
    for at in range(upto, dimensions, width):
        upto = min(dimensions, at + width)
        gap = candidates[which, at:upto] - queries[who, at:upto]
        partial = partial + np.einsum("ij,ij->i", gap, gap)
        keep = partial <= limit(upto)[who] + 1e-12
        who, which, partial = who[keep], which[keep], partial[keep]
    return who, which


def search(table: DataFrame, is_query: Column, k: int = 10, recall: float = 0.97, block_rows: int = 8192, width: int = 16, significance: float = 2.1, id_col: str = "vec_id", vector_col: str = "embedding", fill: bool = True) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (Euclidean distance in double precision on the original vectors).

    ``is_query`` is a predicate over ``vec_id``. Queries and all rows meet list block by list block, never as a whole.
    """
    spark = table.sparkSession
    vectors = materialise(usable_vectors(table, id_col, vector_col), "vectors")
    n = vectors.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], schema)
    index = fit(vectors, n, k, recall)
    shared, lists = spark.sparkContext.broadcast(index), len(index.centroids)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = stacked(batch["v"], len(shared.value.turn)) @ shared.value.turn
            yield pd.DataFrame({"list": shared.value.nearest_lists(x, 1)[:, 0].astype(np.int32), "vec_id": batch["vec_id"], "v": batch["v"]})

    placed = materialise(vectors.mapInPandas(assign, "list int, vec_id long, v array<double>"), "lists")
    # one row a list
    sizes = {r["list"]: r["count"] for r in placed.groupBy("list").count().collect()}
    parts = np.array([max(1, -(-sizes.get(i, 0) // block_rows)) for i in range(lists)])
    first = np.concatenate([[0], np.cumsum(parts)])
    many = spark.sparkContext.broadcast((parts, first))

    def deal_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts, first = many.value
            at, ids = batch["list"].to_numpy(), batch["vec_id"].to_numpy()
            mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            yield pd.DataFrame({"block": first[at] + (mixed % parts[at].astype(np.uint64)).astype(np.int64), "asks": False, "vec_id": ids, "v": batch["v"], "bound": 0.0})

    def deal_queries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, (parts, first) = shared.value, many.value
        for batch in batches:
            x = stacked(batch["v"], len(index.turn)) @ index.turn
            _, exact = index.nearest_sampled(stacked(batch["v"], len(index.turn)), batch["vec_id"].to_numpy(), k)
            bound = exact.max(1) ** 2 if exact.shape[1] == k else np.full(len(x), np.inf)
            for row, probed in enumerate(index.nearest_lists(x, index.probes)):
                blocks = np.concatenate([np.arange(first[p], first[p] + parts[p]) for p in probed])
                yield pd.DataFrame({"block": blocks, "asks": True, "vec_id": batch["vec_id"].iloc[row], "v": [batch["v"].iloc[row]] * len(blocks), "bound": bound[row]})

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turn = shared.value.turn
        block, held = None, []
        ids = original = rotated = None
        for batch in batches:
            numbers, asks = batch["block"].to_numpy(), batch["asks"].to_numpy()
            cuts = np.flatnonzero(np.diff(numbers) | np.diff(asks.astype(np.int8))) + 1
            for a, b in zip([0, *cuts], [*cuts, len(batch)]):
                if numbers[a] != block:
                    block, held, rotated = numbers[a], [], None
                if not asks[a]:
                    held.append((batch["vec_id"].to_numpy()[a:b], stacked(batch["v"].iloc[a:b], len(turn))))
                    continue
                if not held:
                    continue
                if rotated is None:
                    ids, original = np.concatenate([i for i, _ in held]), np.concatenate([v for _, v in held])
                    rotated = original @ turn
                asked, goals = stacked(batch["v"].iloc[a:b], len(turn)), batch["vec_id"].to_numpy()[a:b]
                step = max(1, 2_000_000 // len(ids))
                for c in range(0, len(asked), step):
                    who, which = scan(asked[c : c + step] @ turn, batch["bound"].to_numpy()[a:b][c : c + step], rotated, width, significance)
                    other = ids[which] != goals[c:][who]
                    who, which = who[other], which[other]
                    exact = np.sqrt(((original[which] - asked[c:][who]) ** 2).sum(1))
                    order = np.lexsort((ids[which], exact, who))
                    who, which, exact = who[order], which[order], exact[order]
                    starts = np.flatnonzero(np.diff(who, prepend=-1))
                    best = np.arange(len(who)) - np.repeat(starts, np.diff([*starts, len(who)])) < k
                    yield pd.DataFrame({"query_id": goals[c:][who[best]], "vec_id": ids[which[best]], "score": exact[best]})

    def near_sample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = shared.value
        for batch in batches:
            ids = batch["vec_id"].to_numpy()
            at, exact = index.nearest_sampled(stacked(batch["v"], len(index.turn)), ids, k)
            real = np.isfinite(exact).ravel()
            yield pd.DataFrame({"query_id": np.repeat(ids, at.shape[1])[real], "vec_id": index.sample_ids[at.ravel()[real]], "score": exact.ravel()[real]})

    rows = placed.mapInPandas(deal_rows, "block long, asks boolean, vec_id long, v array<double>, bound double")
    asked = vectors.filter(is_query).select("vec_id", "v")
    queries = asked.mapInPandas(deal_queries, "block long, asks boolean, vec_id long, v array<double>, bound double")
    dealt = rows.unionByName(queries).repartition(shuffle_partitions(spark), "block").sortWithinPartitions("block", "asks")
    hits = "query_id long, vec_id long, score double"
    scanned = dealt.mapInPandas(meet, hits).withColumn("filler", F.lit(0))
    if fill:
        scanned = scanned.unionByName(asked.mapInPandas(near_sample, hits).withColumn("filler", F.lit(1)))
    found = scanned.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"), F.min("filler").alias("filler"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("filler", "score", "vec_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("place", place).filter(F.col("place") <= k).withColumn("rank", rank).select("query_id", "rank", "vec_id", "score")
