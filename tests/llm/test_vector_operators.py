"""Vector operators against brute force."""

import inspect
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import ann, embedding_dedup
from tidemark.llm.vectors import rotation

BAD = [(9001, None), (9002, [0.0] * 8), (9003, [1.0] * 7 + [None]), (9004, [math.nan] * 8), (9005, [math.inf] + [1.0] * 7), (9006, [1.0, 2.0]), (None, [1.0] * 8)]


def frame(spark, x, extra=()):
    rows = [(int(k), [float(v) for v in r], "clash", 0) for k, r in enumerate(x)] + [(k, v, "clash", 0) for k, v in extra]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, v string, block int").repartition(3)


def grouped_vectors(seed, n=400, d=8, groups=((60, 0.002), (40, 0.03), (30, 0.12))):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * rng.uniform(0.5, 3, (n, 1))
    at = 0
    for size, noise in groups:
        c = rng.normal(size=d)
        x[at : at + size] = c / np.linalg.norm(c) + rng.normal(size=(size, d)) * noise
        at += size
    x[at : at + 5] = x[at]
    return x[rng.permutation(n)]


def test_search(spark):
    x = np.random.default_rng(0).normal(size=(3000, 16))
    got = {}
    for r in ann.search(frame(spark, x), F.col("vec_id") % 100 == 0, k=10).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert len(got) == 30
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        found.sort()
        assert [r for r, *_ in found] == list(range(1, 11)) and all(s == pytest.approx(d[v], rel=1e-12) for _, v, s in found)
        assert [(s, v) for _, v, s in found] == sorted((s, v) for _, v, s in found)
        hits += len({v for _, v, _ in found} & set(np.argsort(d)[:10].tolist()))
    assert hits >= 0.9 * 300


def test_scan_alone_finds_neighbours_beyond_the_sample(spark):
    x = np.random.default_rng(1).normal(size=(10_000, 16))
    table = frame(spark, x)
    hits = 0
    for r in ann.search(table, F.col("vec_id") % 200 == 0, k=10, fill=False).groupBy("query_id").agg(F.collect_list("vec_id").alias("ids")).collect():
        d = ((x - x[r.query_id]) ** 2).sum(1)
        d[r.query_id] = np.inf
        hits += len(set(r.ids) & set(np.argsort(d)[:10].tolist()))
    print("recall of the scan alone", hits / 500)
    assert hits >= 0.9 * 500


def test_search_edges(spark):
    x = np.ones((4, 8))
    rows = ann.search(frame(spark, x, BAD), F.col("vec_id") == 0, k=10).collect()
    assert [(r["rank"], r.vec_id, r.score) for r in sorted(rows, key=lambda r: r["rank"])] == [(1, 1, 0.0), (2, 2, 0.0), (3, 3, 0.0)]
    assert ann.search(frame(spark, x[:0]), F.col("vec_id") == 0).count() == 0


def brute(x, cosine):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= cosine
    np.fill_diagonal(near, False)
    label = np.arange(len(x))
    while True:
        new = np.where(near, label[None, :], len(x)).min(1)
        new = np.minimum(label, new)
        if (new == label).all():
            return near.sum(1), label
        label = new


@pytest.mark.parametrize("seed", range(3))
def test_dedup_equals_brute_force(spark, seed):
    x = grouped_vectors(seed)
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(frame(spark, x, BAD), 0.95, miss=1e-6, crowd=6, block=16).collect()}
    links, label = brute(x, 0.95)
    assert len(got) == len(x) + 6
    assert [got[k].n_links for k in range(len(x))] == links.tolist()
    assert [got[k].component_id for k in range(len(x))] == label.tolist()
    assert all(got[k].n_links == 0 and got[k].component_id == k and got[k].kept for k, _ in BAD if k)


def test_dedup_tiles_of_crowded_buckets(spark):
    x = grouped_vectors(7, groups=((200, 0.12),))
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(frame(spark, x), 0.95, miss=1e-6, most_in_bucket=16).collect()}
    assert [got[k] for k in range(len(x))] == brute(x, 0.95)[0].tolist()


@pytest.mark.parametrize("n", [80_000, 100_000_000])
def test_bands_keep_their_miss_rate_at_every_size(n):
    miss = inspect.signature(embedding_dedup.near_duplicates).parameters["miss"].default
    bands, rng = embedding_dedup.band_plan(n, 64, 0.95, miss, 5), np.random.default_rng(2)
    x, y = rng.normal(size=(2, 20_000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y -= np.einsum("ij,ij->i", x, y)[:, None] * x
    y = 0.95 * x + math.sqrt(1 - 0.95**2) * y / np.linalg.norm(y, axis=1)[:, None]
    missed = np.ones(len(x), dtype=bool)
    for planes in bands:
        missed &= ((x @ planes.T >= 0) != (y @ planes.T >= 0)).any(1)
    assert missed.sum() <= 1


@pytest.mark.parametrize("seed", range(2))
def test_dedup_equals_brute_force_as_in_production(spark, seed):
    x = grouped_vectors(seed + 20, n=1500, d=16, groups=((200, 0.09), (60, 0.06), (40, 0.002)))
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(frame(spark, x)).collect()}
    links, label = brute(x, 0.95)
    assert [got[k].n_links for k in range(len(x))] == links.tolist()
    assert [got[k].component_id for k in range(len(x))] == label.tolist()


def test_dedup_empty(spark):
    assert embedding_dedup.near_duplicates(frame(spark, np.ones((0, 8)))).count() == 0
    assert embedding_dedup.near_duplicates(frame(spark, np.ones((0, 8)), BAD[:2])).count() == 2


def test_code_estimates_are_unbiased_and_bounded():
    rng, d = np.random.default_rng(1), 24
    x, y = rng.normal(size=(2, d))
    x, y = x / np.linalg.norm(x), y / np.linalg.norm(y)
    estimates, inside = [], 0
    for seed in range(400):
        codes = embedding_dedup.Codes(d, 128, seed)
        packed, factor = codes.encode(x[None])
        estimates.append(float(codes.corners(packed)[0] @ y / factor[0]))
        inside += x @ y <= codes.upper_bounds(packed, factor, y[None], 4.0)[0, 0]
    assert np.mean(estimates) == pytest.approx(float(x @ y), abs=0.02) and inside >= 399


def test_rotation_is_orthonormal():
    r = rotation(64, 24, 3)
    assert np.allclose(r.T @ r, np.eye(24))
