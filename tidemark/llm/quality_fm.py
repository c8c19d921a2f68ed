"""Quality classifier: a factorisation machine over hashed words, structure statistics and length metadata.

The score of a text is sigmoid(w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j). The pair term is
half of (sum v_i x_i)^2 - sum (v_i x_i)^2 per factor, so scoring is linear in the number of active
features. Words are hashed into ``buckets`` and weighted by log frequency to unit length; every
statistic is cut at its training quantiles and becomes one active feature.

Fitting takes at most ``fit_rows`` labelled documents (a documented bound), reduced to sparse vectors where they lie;
scoring takes whole texts, all rows. Labels, language, source and id are no features.

Defined cases: null text is empty and is scored like any other; without any usable label, or with one
class only, the score is the share of label 1 (0.5 with none); repeated rows score alike; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import crc_mod, small_batches, texts
from tidemark.llm.labelled import labelled_sample

_ROOM = 300_000
_CLASSES = np.zeros(256, dtype=np.uint8)  # 0 other punctuation
_CLASSES[list(range(97, 123))] = 1
_CLASSES[list(range(65, 91))] = 2
_CLASSES[list(range(48, 58))] = 3
_CLASSES[[9, 11, 12, 13, 32]] = 4
_CLASSES[10] = 5
_CLASSES[[33, 35, 36, 37, 38, 42, 43, 60, 61, 62, 64, 94, 95, 123, 124, 125, 126]] = 6
_CLASSES[128:] = 7
STATISTICS = ("log_bytes", "log_words", "word_length", "lines_per_word", "upper", "digits", "symbols", "punctuation", "not_ascii", "distinct_words", "distinct_lines", "symbol_words", "shouted_words", "top_word")


class _Buckets(dict):
    """word -> bucket, remembered per worker within a bound."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, word: str) -> int:
        at = crc32(word.strip(".,;:!?\"'()").encode("utf-8", "replace")) % self.buckets
        if len(self) >= _ROOM:
            self.clear()
        if len(word) <= 64:
            self[word] = at
        return at


_buckets: dict[int, _Buckets] = {}


def statistics(text: str, words: list[str]) -> list[float]:
    """The structure statistics of one whole text, as named in STATISTICS."""
    counts = np.zeros(8, dtype=np.int64)
    raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    for at in range(0, len(raw), 1 << 20):
        counts += np.bincount(_CLASSES[raw[at : at + (1 << 20)]], minlength=8)
    n, letters = max(1, len(raw)), max(1, int(counts[1] + counts[2] + counts[7]))
    many, lines = max(1, len(words)), text.split("\n")
    distinct = Counter(words)
    marked = sum(1 for w in words if not w[-1].isalnum() and w[-1] not in ".,")
    shouted = sum(map(str.isupper, words))
    top = max(distinct.values(), default=0) / many
    return [math.log1p(len(raw)), math.log1p(len(words)), letters / many, len(lines) / many, counts[2] / letters, counts[3] / n, counts[6] / n, counts[0] / n, counts[7] / n, len(distinct) / many, len(set(lines)) / len(lines), marked / many, shouted / many, top]


def word_features(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and weights (unit length) of the words of a text."""
    known = _buckets.setdefault(buckets, _Buckets(buckets))
    at, counts = np.unique(np.fromiter(map(known.__getitem__, words), dtype=np.int32, count=len(words)), return_counts=True)
    weights = np.log1p(counts)
    return at, weights / (math.sqrt(float(weights @ weights)) or 1.0)


@dataclass(frozen=True)
class FactorisationMachine:
    """Parameters; ``edges`` cuts each statistic into bins whose features follow the word buckets."""

    buckets: int
    edges: np.ndarray  # (statistics, cuts)
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def features(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        words = text.lower().split()
        at, x = word_features(words, self.buckets)
        bins = binned(np.array(statistics(text, text.split())), self.edges)
        return np.concatenate([at, self.buckets + bins]), np.concatenate([x, np.ones(len(bins))])

    def raw_score(self, at: np.ndarray, x: np.ndarray) -> float:
        v = self.factors[at] * x[:, None]
        total = v.sum(0)
        return self.bias + float(self.linear[at] @ x) + 0.5 * float(total @ total - (v * v).sum())

    def score(self, text: str) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.raw_score(*self.features(text))))))


def binned(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    cuts = edges.shape[1]
    return np.arange(len(values)) * (cuts + 1) + (values[:, None] > edges).sum(1)


def fit(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]], buckets: int, factors: int = 8, epochs: int = 5, rate: float = 0.15, penalty: float = 2e-4, seed: int = 7, bins: int = 8) -> FactorisationMachine:
    """Adagrad on log loss over ``rows`` of (word buckets, weights, statistics, label)."""
    labels = np.array([r[3] for r in rows], dtype=float)
    share = float(labels.mean()) if len(labels) else 0.5
    stats = np.array([r[2] for r in rows]) if rows else np.zeros((1, len(STATISTICS)))
    edges = np.quantile(stats, np.linspace(0, 1, bins + 1)[1:-1], axis=0).T
    size = buckets + len(STATISTICS) * bins
    rng = np.random.default_rng(seed)
    w, v = np.zeros(size), rng.normal(0, 0.02, (size, factors))
    if share in (0.0, 1.0) or not len(labels):
        return FactorisationMachine(buckets, edges, 20.0 * (2 * share - 1), w, v * 0)
    bias, gw, gv, gb = math.log(share / (1 - share)), np.full(size, 1e-6), np.full((size, factors), 1e-6), 1e-6
    items = [(np.concatenate([at, buckets + binned(s, edges)]), np.concatenate([x, np.ones(len(STATISTICS))])) for at, x, s, _ in rows]
    for _ in range(epochs):
        order = rng.permutation(len(items))
        for k in range(0, len(order), 64):
            batch = order[k : k + 64]
            at, x = np.concatenate([items[i][0] for i in batch]), np.concatenate([items[i][1] for i in batch])
            starts = np.concatenate([[0], np.cumsum([len(items[i][0]) for i in batch])])[:-1]
            lengths = np.diff([*starts, len(at)])
            vx = v[at] * x[:, None]
            total = np.add.reduceat(vx, starts)
            raw = bias + np.add.reduceat(w[at] * x, starts) + 0.5 * ((total**2).sum(1) - np.add.reduceat((vx**2).sum(1), starts))
            error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[batch]) / len(batch)
            each = np.repeat(error, lengths) * x
            ids, where = np.unique(at, return_inverse=True)
            dw = np.bincount(where, weights=each, minlength=len(ids)) + penalty * w[ids]
            slope = each[:, None] * (np.repeat(total, lengths, axis=0) - vx)
            dv = np.stack([np.bincount(where, weights=slope[:, f], minlength=len(ids)) for f in range(factors)], axis=1) + penalty * v[ids]
            gw[ids] += dw**2
            gv[ids] += dv**2
            w[ids] -= rate * dw / np.sqrt(gw[ids])
            v[ids] -= 0.3 * rate * dv / np.sqrt(gv[ids])
            gb += error.sum() ** 2
            bias -= rate * error.sum() / math.sqrt(gb)
    return FactorisationMachine(buckets, edges, bias, w, v)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", learn: Column | None = None, fit_rows: int = 3000, buckets: int = 1 << 14) -> FactorisationMachine:
    """Fit on at most ``fit_rows`` labelled documents."""
    sample = labelled_sample(docs, labels, label, F.lit(True) if learn is None else learn, fit_rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(*word_features(t.lower().split(), buckets), statistics(t, t.split())) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "at": [a for a, *_ in found], "x": [x.astype(np.float32) for _, x, _ in found], "s": [s for *_, s in found], "label": batch["label"]})

    rows = sample.mapInPandas(run, "doc_id long, at array<int>, x array<float>, s array<double>, label int").toPandas().sort_values("doc_id")
    return fit([(np.asarray(r.at, dtype=np.int64), np.asarray(r.x, dtype=float), np.asarray(r.s), int(r.label)) for r in rows.itertuples()], buckets)


def score(docs: DataFrame, model: FactorisationMachine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1; higher: label 1 likelier) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "score": [shared.value.score(t) for t in batch["text"]]})

    return texts(docs, id_col, text_col).mapInPandas(run, "doc_id long, score double")


def accepted(docs: DataFrame, model: FactorisationMachine, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores ``threshold`` or more."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(text: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(t) for t in text], dtype=float)

    return docs.filter(scored(F.coalesce(F.col(text_col), F.lit(""))) >= threshold)


def learn_fold(mod: int = 5, held_out: int = 0) -> Column:
    return crc_mod(F.col("doc_id"), mod) != held_out
