"""Language identification by bit-sliced Bloom filters of byte n-grams.

One table of slots; slot s holds a word whose bit L says that some n-gram of language L was hashed there. The
conjunction of an n-gram's slots is the set of all languages that (may) contain it, found in one lookup for all
languages at once. Over a text each language counts its n-grams; the count is corrected for the filter's
false positives, which follow from how full the language's slice is, and the largest decides.

Fitting takes about ``fit_rows_per_language`` documents a language (a documented bound, picked by a hash of the
id); the table has ``slots`` entries whatever the corpus. Prediction reads whole texts. Language, source and id are no inputs.

Defined cases: null texts and texts without a letter give ``und`` with score 0; a text whose n-grams are all unknown gets the most
frequent language with score 1 / languages; ties go to the more frequent, then the first by name; without training
rows everything is ``und``; very long texts are read whole, a block at a time; repeated rows predict alike; an empty table gives no rows;
other columns are ignored. Languages beyond 64 take further mask words; more than ``MOST_LANGUAGES`` distinct values are an error, as the column then is no language.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import crc_mod, texts

#: Fixed odd multipliers of the slot hashes.
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
_TO_BLANK = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
MOST_LANGUAGES = 4096
_LETTER = re.compile(r"[^\W\d_]")


def grams(text: str) -> Iterator[np.ndarray]:
    """Byte 4-grams of the lower-cased text, everything but letters blanked, a block at a time."""
    raw = np.frombuffer(b" " + text.lower().encode("utf-8", "replace").translate(_TO_BLANK) + b" ", dtype=np.uint8)
    for at in range(0, len(raw) - 3, 1 << 20):
        b = raw[at : at + (1 << 20) + 3].astype(np.uint32)
        g = b[:-3] | b[1:-2] << np.uint32(8) | b[2:-1] << np.uint32(16) | b[3:] << np.uint32(24)
        yield g[(g & np.uint32(0xFFFF)) != np.uint32(0x2020)]


def slots_of(g: np.ndarray, bits: int) -> list[np.ndarray]:
    wide = g.astype(np.uint64) + np.uint64(1)
    return [(wide * np.uint64(m)) >> np.uint64(64 - bits) for m in MULTIPLIERS]


@dataclass(frozen=True)
class LanguageFilters:
    languages: tuple[str, ...]  # most frequent first
    bits: int
    table: np.ndarray  # a row of slots for every 64 languages (one such row may stand alone)
    false_rate: np.ndarray

    def hits(self, text: str) -> tuple[np.ndarray, int]:
        """Per language how many n-grams of the text its slice claims, and how many there are."""
        sums, n = np.zeros(len(self.languages)), 0
        for g in grams(text):
            a, b, c = slots_of(g, self.bits)
            n += len(g)
            for word, slots in enumerate(np.atleast_2d(self.table)):
                mask = slots[a] & slots[b] & slots[c]
                for k in range(64 * word, min(len(self.languages), 64 * word + 64)):
                    sums[k] += np.count_nonzero(mask & np.uint64(1 << k % 64))
        return sums, n

    def predict(self, text: str) -> tuple[str, float]:
        if not self.languages or not _LETTER.search(text):
            return "und", 0.0
        sums, n = self.hits(text)
        true = np.maximum(0, (sums - n * self.false_rate) / (1 - self.false_rate))
        if not n or not true.max() > 0:
            return self.languages[0], 1 / len(self.languages)
        best = int(np.argmax(true))
        # what speaks for the best beyond what all share
        apart = true - true.min() if len(true) > 1 else true
        return self.languages[best], float(np.clip(apart[best] / max(apart.sum(), 1e-12), 0, 1))


def train(docs: DataFrame, learn: Column | None = None, fit_rows_per_language: int = 600, slots: int = 1 << 18, least: int = 3, lang_col: str = "lang") -> LanguageFilters:
    """Fill the filters from documents with a language; n-grams seen fewer than ``least`` times in a language are left out."""
    spark = docs.sparkSession
    usable = docs.filter(F.col(lang_col).isNotNull() & (F.lit(True) if learn is None else learn))
    counts = sorted(((r["count"], r["lang"]) for r in usable.groupBy(F.col(lang_col).alias("lang")).count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES + 1).collect()), key=lambda x: (-x[0], x[1]))
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    bits, names = slots.bit_length() - 1, [name for _, name in counts]
    table, false_rate = np.zeros((max(1, -(-len(names) // 64)), slots), dtype=np.uint64), np.zeros(len(names))
    if not names:
        return LanguageFilters((), bits, table, false_rate)
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003
    # one row a language, MOST_LANGUAGES at most
    wanted = F.broadcast(spark.createDataFrame([(name, k, min(1.0, fit_rows_per_language / n)) for k, (n, name) in enumerate(counts)], "lang string, k int, share double"))
    sample = usable.select(F.col("doc_id"), F.col(lang_col).alias("lang"), F.coalesce("text", F.lit("")).alias("text")).join(wanted, "lang").filter(F.coalesce(chance, F.lit(1.0)) < F.col("share")).select("k", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[np.ndarray]] = {}
        seen: dict[int, dict] = {}
        for batch in batches:
            for k, text in zip(batch["k"], batch["text"]):
                for g in grams(text):
                    ids, n = np.unique(g, return_counts=True)
                    into = seen.setdefault(int(k), {})
                    for i, m in zip(ids.tolist(), n.tolist()):
                        into[i] = into.get(i, 0) + m
                    if len(into) > 1 << 19:
                        yield pd.DataFrame({"k": int(k), "gram": list(into), "n": list(into.values())})
                        seen[int(k)] = {}
        for k, into in seen.items():
            if into:
                yield pd.DataFrame({"k": k, "gram": list(into), "n": list(into.values())})

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = np.zeros(table.shape, dtype=np.uint64)
        for batch in batches:
            k = batch["k"].to_numpy(dtype=np.int64)
            masks = np.uint64(1) << (k % 64).astype(np.uint64)
            for at in slots_of(batch["gram"].to_numpy(dtype=np.uint64), bits):
                np.bitwise_or.at(own, (k // 64, at.astype(np.int64)), masks)
        word, at = np.nonzero(own)
        if len(at):
            yield pd.DataFrame({"word": word, "slot": at, "mask": own[word, at].view(np.int64)})

    known = sample.mapInPandas(count, "k int, gram long, n long").groupBy("k", "gram").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    filled = known.select("k", "gram").mapInPandas(place, "word long, slot long, mask long").groupBy("word", "slot").agg(F.bit_or("mask").alias("mask")).toPandas()
    table[filled["word"].to_numpy(dtype=np.int64), filled["slot"].to_numpy(dtype=np.int64)] = filled["mask"].to_numpy(dtype=np.int64).view(np.uint64)
    for k in range(len(names)):
        false_rate[k] = min(0.99, np.count_nonzero(table[k // 64] & np.uint64(1 << k % 64)) / slots) ** len(MULTIPLIERS)
    return LanguageFilters(tuple(names), bits, table, false_rate)


def predict(docs: DataFrame, filters: LanguageFilters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [shared.value.predict(t) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "lang_pred": [a for a, _ in found], "score": [b for _, b in found]})

    return texts(docs, id_col, text_col).mapInPandas(run, "doc_id long, lang_pred string, score double")


def learn_fold(mod: int = 4, held_out: int = 2) -> Column:
    return crc_mod(F.col("doc_id"), mod) != held_out
