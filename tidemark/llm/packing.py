"""Sequence packing by lexical retrieval.

A hash sample of documents gives a tree of hyperplanes over sketches of BM25 weights (signed random
projections of a document's weighted terms). All documents are tokenised once and placed by that tree, and below its leaves by further
random hyperplanes, so that documents with the same heavy terms stand together; runs of this order are the shards. Document
frequencies of all token ids are counted over the whole corpus. Every shard builds its own BM25
inverted index and packs itself: a seed document opens a window, the index returns the unused neighbours of the
seed (whole documents are the queries), best first, and they fill the window greedily. The neighbour that reaches the
end is cut there; what is left of it seeds the next window. Where no unused neighbour shares a query term, the
next unused document in the shard's order follows. The last window of a shard is cut into powers of two, so no sequence needs padding.

The sample only draws borders: every document is placed, indexed, searched and packed. Ids are shuffled once, by ranges of the order, which Spark balances even
where copies share a place. A shard's memory is bounded by ``shard_tokens`` and ``shard_docs``, plus one document.

Defined cases: null or empty texts hold the end id alone; very long texts are cut over several windows; repeated rows are
packed each; ties in score go to the earlier row of the shard; an empty table
gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import drop_scratch, materialise, texts
from tidemark.llm.word_tokens import tokenised, word_tokens

PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
DIGESTS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def term_counts(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids, ascending, and how often each occurs; 16-bit ids are sorted by radix."""
    if not len(ids):
        return ids, np.zeros(0, dtype=np.int64)
    ids = np.sort(ids, kind="stable")
    at = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    return ids[at], np.diff(np.append(at, len(ids)))


def all_term_counts(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``term_counts`` of many documents by one sort: document, distinct id (ascending within the document) and how often it occurs there."""
    lengths = np.array([len(ids) for ids in docs], dtype=np.int64)
    if not lengths.sum():
        return (np.zeros(0, dtype=np.int64),) * 3
    ids = np.concatenate(docs)
    word, shift = (np.uint32, 16) if ids.itemsize == 2 and len(docs) <= 1 << 16 else (np.uint64, 32)
    keys = np.repeat(np.arange(len(docs), dtype=word) << word(shift), lengths)
    keys |= ids
    keys.sort()
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    first = keys[at]
    return (first >> word(shift)).astype(np.int64), (first & word((1 << shift) - 1)).astype(np.int64), np.diff(at, append=len(keys))


def document_frequencies(tokens: DataFrame) -> dict[int, int]:
    """In how many documents each token id occurs. As many entries as the vocabulary has ids at most."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for raw, width in zip(batch["ids"], batch["width"]):
                seen, _ = term_counts(np.frombuffer(raw, dtype=f"<u{width}"))
                if len(seen) and seen[-1] >= len(total):
                    total = np.concatenate([total, np.zeros(int(seen[-1]) + 1 - len(total), dtype=np.int64)])
                total[seen] += 1
        terms = np.flatnonzero(total)
        if len(terms):
            yield pd.DataFrame({"term": terms, "n": total[terms]})

    return _collected(tokens.select("ids", "width").mapInPandas(count, "term long, n long"))


def noted_frequencies(tokens: DataFrame) -> dict[int, int]:
    """``document_frequencies`` from the counts that ``placed_tokens`` has noted in ``seen``, without the ids."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for raw in batch["seen"]:
                total = _added(total, np.frombuffer(raw, dtype="<u4"))
        terms = np.flatnonzero(total)
        if len(terms):
            yield pd.DataFrame({"term": terms, "n": total[terms]})

    return _collected(tokens.filter(F.col("seen").isNotNull()).select("seen").mapInPandas(add, "term long, n long"))


def _added(total: np.ndarray, more: np.ndarray) -> np.ndarray:
    """The sum of two arrays of counts by id, the shorter one taken to end in zeros."""
    if len(more) > len(total):
        total = np.concatenate([total, np.zeros(len(more) - len(total), dtype=np.int64)])
    total[: len(more)] += more
    return total


def _collected(partial: DataFrame) -> dict[int, int]:
    return {row.term: row.n for row in partial.groupBy("term").agg(F.sum("n").alias("n")).collect()}


class ShardIndex:
    """BM25 postings of one shard, impact stored per posting; documents that are used leave it."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean_length: float, query_terms: int | None = None, k1: float = 1.2, b: float = 0.75):
        owner, term, counts = all_term_counts(docs)
        lengths = np.array([len(ids) for ids in docs], dtype=np.int64)
        tf = counts * (k1 + 1) / (counts + (k1 * (1 - b + b * lengths / mean_length))[owner])
        impact = idf[term] * tf
        self.doc_at = np.searchsorted(owner, np.arange(len(docs) + 1)).tolist()
        self.query_terms, self.unused = query_terms, np.ones(len(docs), dtype=bool)
        #: the ids that occur; inside the index a term is its place among them
        self.terms = np.flatnonzero(np.bincount(term))
        local = np.zeros(len(idf), dtype=np.int64)
        local[self.terms] = np.arange(len(self.terms))
        term = local[term]
        self.doc_terms, self.doc_impacts = term, impact
        order = np.argsort(term.astype(np.uint16) if len(self.terms) <= 1 << 16 else term, kind="stable")
        self._post(term[order], owner[order], impact[order], np.arange(len(docs)))

    def _post(self, term: np.ndarray, owner: np.ndarray, impact: np.ndarray, rows: np.ndarray) -> None:
        """Postings of the documents ``rows`` (sorted by term): lists of rare terms, a row over all documents for each frequent one."""
        self.rows, self.postings = rows, (term, owner, impact)
        n = np.bincount(term, minlength=len(self.terms))
        self.starts = np.cumsum(n) - n
        frequent = (n * 6 >= len(rows)) & (n > 0)
        self.listed, self.frequent = np.where(frequent, 0, n), np.where(frequent, np.cumsum(frequent) - 1, -1)
        self.dense = np.zeros((int(frequent.sum()), len(rows)))
        for row, a, b in zip(self.dense, self.starts[frequent].tolist(), (self.starts + n)[frequent].tolist()):
            row[owner[a:b]] = impact[a:b]
        # what frequent terms give each whole document as a query: one product for all
        self.shared = (self.dense != 0).astype(np.float64).T @ self.dense if self.query_terms is None else None
        self.place = {k: at for at, k in enumerate(rows.tolist())}

    def _compact(self) -> None:
        """Take used documents out of the postings."""
        term, owner, impact = self.postings
        stays = self.unused[self.rows]
        place = np.cumsum(stays) - 1
        keep = stays[owner]
        self._post(term[keep], place[owner[keep]], impact[keep], self.rows[stays])

    def _query(self, number: int) -> np.ndarray:
        first, end = self.doc_at[number : number + 2]
        terms, impacts = self.doc_terms[first:end], self.doc_impacts[first:end]
        if self.query_terms is not None and len(terms) > self.query_terms:
            terms = terms[np.argpartition(-impacts, self.query_terms)[: self.query_terms]]
        return terms

    def query(self, number: int) -> np.ndarray:
        """The query of a seed: all of its terms, or its ``query_terms`` terms of largest impact."""
        return self.terms[self._query(number)]

    def scores(self, number: int) -> np.ndarray:
        """The BM25 score of each of ``self.rows`` for the query of ``number``."""
        terms, place = self._query(number), self.place.get(number)
        if self.shared is not None and place is not None:
            scores = self.shared[place].copy()
        else:
            frequent = self.frequent[terms]
            scores = self.dense[frequent[frequent >= 0]].sum(0)
        n = self.listed[terms]
        ends = np.cumsum(n)
        if len(ends) and ends[-1]:
            at = np.repeat(self.starts[terms] - ends + n, n)
            at += np.arange(len(at))
            _, owner, impact = self.postings
            scores += np.bincount(owner[at], weights=impact[at], minlength=len(scores))
        return scores

    def neighbours(self, number: int, first: int = 32) -> Iterator[int]:
        """Unused documents that share a query term with the seed, best score first, ties to the earlier row.

        The ``first`` best are sorted at once, the others only if someone asks for them.
        """
        rows, scores = self.rows, self.scores(number)
        if 2 * np.count_nonzero(self.unused[rows]) < len(rows):
            self._compact()
        found = np.flatnonzero((scores > 0) & self.unused[rows])
        least = -np.partition(-scores[found], first)[first] if len(found) > first else -1.0
        for some in (found[scores[found] > least], found[scores[found] <= least]):
            yield from rows[some[np.lexsort((some, -scores[some]))]].tolist()


def pack_shard(docs: list[np.ndarray], idf: np.ndarray, mean_length: float, window: int, query_terms: int | None = None) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece of one shard."""
    index = ShardIndex(docs, idf, mean_length, query_terms)
    sequence, room, waiting, ahead = 0, window, [], iter(())
    next_row, left = 0, sum(map(len, docs))
    pieces: list[tuple[int, int, int, int, int]] = []
    current, at, seed = None, 0, None
    while left:
        if current is None:
            current = next((k for k in ahead if index.unused[k]), None)
            if current is None:
                while not index.unused[next_row]:
                    next_row += 1
                current = next_row
            at = 0
            index.unused[current] = False
        if room == window and seed is None:
            seed = current
            ahead = index.neighbours(seed)
        n = min(room, len(docs[current]) - at)
        pieces.append((current, at, n, sequence, window - room))
        at, room, left = at + n, room - n, left - n
        if at == len(docs[current]):
            current = None
        if not room:
            yield from pieces
            pieces, sequence, room, seed = [], sequence + 1, window, None
    yield from _powers(pieces, window - room, sequence)


def _powers(pieces: list, total: int, sequence: int) -> Iterator[tuple[int, int, int, int, int]]:
    """The last window, cut into sequences whose lengths are powers of two."""
    room, offset = 1 << max(0, total.bit_length() - 1), 0
    for doc, at, n, *_ in pieces:
        while n:
            part = min(n, room - offset)
            yield doc, at, part, sequence, offset
            at, n, offset, total = at + part, n - part, offset + part, total - part
            if offset == room:
                sequence, offset, room = sequence + 1, 0, 1 << max(0, total.bit_length() - 1)


class PlaceTree:
    """Where a document stands in the order that shards are cut from: a sign for each hyperplane on its way down the tree, then signs of random ones."""

    FINE = 24

    def __init__(self, idf: np.ndarray, mean_length: float, dimensions: int = 64, seed: int = 23):
        self.idf, self.mean_length, self.dimensions, self.seed = idf, mean_length, dimensions, seed
        self.planes: list[tuple[np.ndarray, np.ndarray]] = []  # directions and thresholds of each level
        self._signs = None

    def __getstate__(self):
        return self.__dict__ | {"_signs": None}

    def sketch(self, ids: np.ndarray) -> np.ndarray:
        return self.sketches([ids], *all_term_counts([ids]))[0]

    def sketches(self, docs: list[np.ndarray], owner: np.ndarray, term: np.ndarray, counts: np.ndarray, k1: float = 1.2, b: float = 0.75) -> np.ndarray:
        """The sketch of each of ``docs``, given their ``all_term_counts``."""
        if self._signs is None:
            self._signs = np.random.default_rng(self.seed).choice(np.array([-1, 1], dtype=np.float32), (len(self.idf), self.dimensions))
        known = term < len(self.idf)  # not the ids that the sample does not have
        owner, term, counts = owner[known], term[known], counts[known]
        lengths = np.array([len(ids) for ids in docs], dtype=np.int64)
        weights = (self.idf[term] * counts * (k1 + 1) / (counts + (k1 * (1 - b + b * lengths / self.mean_length))[owner])).astype(np.float32)
        out = np.zeros((len(docs), self.dimensions), dtype=np.float32)
        ends = np.searchsorted(owner, np.arange(len(docs) + 1)).tolist()
        for number, (first, end) in enumerate(zip(ends, ends[1:])):
            sum_ = weights[first:end] @ self._signs.take(term[first:end], axis=0)
            out[number] = sum_ / max(1e-9, float(np.sqrt(sum_ @ sum_)))
        return out

    def fit(self, sketches: np.ndarray, depth: int) -> None:
        """Halve the sample ``depth`` times: each half of a node along the line between the means of two groups in it."""
        node, rng = np.zeros(len(sketches), dtype=np.int64), np.random.default_rng(self.seed + 1)
        for level in range(depth):
            directions, thresholds = np.zeros((1 << level, self.dimensions), dtype=np.float32), np.zeros(1 << level, dtype=np.float32)
            bit = np.zeros(len(sketches), dtype=np.int64)
            for k in range(1 << level):
                x = sketches[node == k]
                if len(x) < 8:
                    continue
                a, b = x[rng.choice(len(x), 2, replace=False)]
                for _ in range(6):
                    near = x @ (b - a) > ((b * b).sum() - (a * a).sum()) / 2
                    if near.all() or not near.any():
                        break
                    a, b = x[~near].mean(0), x[near].mean(0)
                directions[k], thresholds[k] = b - a, np.median(x @ (b - a))
                bit[node == k] = x @ directions[k] > thresholds[k]
            self.planes.append((directions, thresholds))
            node = node * 2 + bit

    def places(self, sketches: np.ndarray) -> np.ndarray:
        """The place of each sketch, a non-negative integer: neighbours in order share the first signs."""
        node = np.zeros(len(sketches), dtype=np.int64)
        for directions, thresholds in self.planes:
            node = node * 2 + (np.einsum("ij,ij->i", sketches, directions[node]) > thresholds[node])
        fine = np.random.default_rng(self.seed + 2).normal(size=(self.dimensions, self.FINE)).astype(np.float32)
        return (node << self.FINE) + (sketches @ fine > 0) @ (np.int64(1) << np.arange(self.FINE, dtype=np.int64)[::-1])


def _weights(frequencies: dict[int, int], n_docs: int) -> np.ndarray:
    df = np.zeros(1 + max(frequencies, default=0))
    df[list(frequencies)] = list(frequencies.values())
    return np.log1p((n_docs - df + 0.5) / (df + 0.5))


def _totals(tokens: DataFrame) -> tuple[int, float]:
    """Documents and their mean length in ids."""
    n, total = tokens.agg(F.count("*"), F.sum(F.length("ids") / F.col("width"))).first()
    return n, (total or 1) / max(1, n)


def fit_places(docs: DataFrame, vocabulary: str, end_id: int, shard_docs: int, fit_docs: int, most_leaves: int = 1024) -> PlaceTree:
    """The tree from about ``fit_docs`` documents, picked by a hash of their id and text; at most ``most_leaves`` leaves of some ``shard_docs`` documents."""
    n = docs.count()
    share = F.pmod(F.xxhash64("doc_id", "text", F.lit(7)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, fit_docs / max(1, n)))
    tokens = materialise(tokenised(docs.filter(share), vocabulary, end_id).drop("part"), "sample")
    n_sample, mean_length = _totals(tokens)
    tree = PlaceTree(_weights(document_frequencies(tokens), n_sample), mean_length)
    depth = int(np.ceil(np.log2(max(1, min(most_leaves, n / shard_docs)))))
    if depth and n_sample >= 64:
        shared = docs.sparkSession.sparkContext.broadcast(tree)

        def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame({"doc_id": batch["doc_id"], "s": [shared.value.sketch(np.frombuffer(r, dtype=f"<u{w}")) for r, w in zip(batch["ids"], batch["width"])]})

        # some fit_docs rows of 64 numbers
        rows = tokens.mapInPandas(sketch, "doc_id long, s array<float>").toPandas().sort_values("doc_id", kind="stable")
        tree.fit(np.stack(rows["s"].to_numpy()).astype(np.float32), depth)
    drop_scratch(tokens)
    return tree


def placed_tokens(docs: DataFrame, vocabulary: str, end_id: int, tree: PlaceTree) -> DataFrame:
    """doc_id, ids, width and place of every document; the last row of a task notes in ``seen`` in how many of its documents each id occurs (unsigned 32-bit, by id)."""
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, tree))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary, tree = shared.value
        words = word_tokens(vocabulary)
        end = np.array([end_id], dtype=words.dtype).tobytes()
        held, seen = None, np.zeros(0, dtype=np.int64)
        for batch in batches:
            if not len(batch):
                continue
            if held is not None:
                yield held
            raw = [words.ids(text) + end for text in batch["text"]]
            ids = [np.frombuffer(r, dtype=words.dtype) for r in raw]
            counted = all_term_counts(ids)
            seen = _added(seen, np.bincount(counted[1]))
            held = pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "ids": raw, "width": np.int32(words.dtype.itemsize), "place": tree.places(tree.sketches(ids, *counted)), "seen": None})
        if held is not None:
            held["seen"] = [None] * (len(held) - 1) + [seen.astype("<u4").tobytes()]
            yield held

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, ids binary, width int, place long, seen binary")


def pack(docs: DataFrame, vocabulary: str, end_id: int, window: int = 2048, query_terms: int | None = None, shard_tokens: int = 1 << 22, shard_docs: int = 2048, fit_docs: int = 4096, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Pack all documents. Returns pieces with their ids (little-endian unsigned 32-bit), or with the crc32 of those where ``digests``.

    Sequence ids are the partition and the sequence within it; the token table is written to the shared
    folder first, so a recomputed task reads the same rows and gives the same ids.
    """
    rows = texts(docs, id_col, text_col)
    tree = fit_places(rows, vocabulary, end_id, shard_docs, fit_docs)
    tokens = materialise(placed_tokens(rows, vocabulary, end_id, tree), "tokens")
    n_docs, mean_length = _totals(tokens)
    idf = tokens.sparkSession.sparkContext.broadcast(_weights(noted_frequencies(tokens), n_docs))

    def shard(rows: list, first: int) -> tuple[pd.DataFrame, int]:
        docs = [np.frombuffer(raw, dtype=f"<u{width}") for _, raw, width in rows]
        out, last = [], first - 1
        for doc, start, n, sequence, offset in pack_shard(docs, idf.value, mean_length, window, query_terms):
            raw = docs[doc][start : start + n].astype("<u4").tobytes()
            last = first + sequence
            out.append((rows[doc][0], start, n, zlib.crc32(raw) if digests else raw, len(docs[doc]), last, offset))
        columns = ["doc_id", "start", "length", "ids_crc32" if digests else "ids", "doc_tokens", "sequence_id", "offset"]
        return pd.DataFrame(out, columns=columns).astype({"doc_id": "Int64"})[[c.split()[0] for c in (DIGESTS if digests else PIECES).split(", ")]], last + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, rows, held = TaskContext.get().partitionId() << 36, [], 0
        for batch in batches:
            for doc, raw, width in zip(batch["doc_id"].astype("Int64"), batch["ids"], batch["width"]):
                rows.append((doc, raw, width))
                held += len(raw) // width
                if held >= shard_tokens or len(rows) >= shard_docs:
                    out, first = shard(rows, first)
                    yield out
                    rows, held = [], 0
        if rows:
            yield shard(rows, first)[0]

    order = ["place", "tie", "doc_id", "ids"]
    dealt = tokens.withColumn("tie", F.xxhash64("doc_id")).repartitionByRange(max(1, -(-n_docs // shard_docs)), "place", "tie").sortWithinPartitions(*order)
    return dealt.select("doc_id", "ids", "width").mapInPandas(run, DIGESTS if digests else PIECES)
