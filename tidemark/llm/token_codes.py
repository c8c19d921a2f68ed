"""Token-id files of directly addressable codes.

Each id is cut into chunks of ``chunk_bits`` bits, lowest first. Level k holds
the k-th chunk of every id that has one; a bitmap beside it says which of its
entries continue at level k + 1, and a directory holds the number of set bits
before each 512-bit block. Token i is found by one rank query a level, without
decoding anything else.

On disk a token file is a folder: ``segments`` (Parquet rows, each a run of whole
documents with its payload) and ``manifest`` (ids before each part). Parquet
carries the segments so that any file system Spark can write to will do, and a
lost task is simply written again. Ids run in ascending doc_id order through parts,
segments and documents.

Defined cases: null text is an empty document (only the end id); null doc_ids come
first; repeated doc_ids stay separate documents, ordered by their ids; an
empty table gives an empty file. Columns other than id and text are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import shuffle_partitions, small_batches, texts
from tidemark.llm.word_tokens import tokenised

_BLOCK = 512
SEGMENTS = "part int, segment int, start_in_part long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, payload binary"


def pack_levels(ids: np.ndarray, chunk_bits: int = 8) -> bytes:
    """The codes of ``ids`` (any unsigned integers below 2**32)."""
    rest, mask, levels = ids.astype(np.uint32), np.uint32((1 << chunk_bits) - 1), []
    while len(rest) or not levels:
        chunk, rest = rest & mask, rest >> np.uint32(chunk_bits)
        goes_on = rest > 0
        padded = np.zeros(-(-len(chunk) // _BLOCK) * _BLOCK, dtype=np.uint8)
        padded[: len(chunk)] = goes_on
        before = np.concatenate([[0], np.cumsum(padded.reshape(-1, _BLOCK).sum(1, dtype=np.int64))[:-1]]) if len(padded) else np.zeros(0)
        body = chunk.astype(np.uint8) if chunk_bits == 8 else np.packbits(((chunk[:, None] >> np.arange(chunk_bits, dtype=np.uint32)) & 1).astype(np.uint8))
        levels.append((len(chunk), body.tobytes(), np.packbits(padded).tobytes(), before.astype("<u4").tobytes()))
        rest = rest[goes_on]
        if not len(rest):
            break
    head = struct.pack("<BB", chunk_bits, len(levels)) + b"".join(struct.pack("<Q", n) for n, *_ in levels)
    return head + b"".join(part for _, *parts in levels for part in parts)


class Levels:
    """A view of one payload; nothing is decoded when it is opened."""

    def __init__(self, payload: bytes):
        self.bits, n_levels = struct.unpack_from("<BB", payload)
        counts = struct.unpack_from(f"<{n_levels}Q", payload, 2)
        raw, at, self.levels = np.frombuffer(payload, dtype=np.uint8), 2 + 8 * n_levels, []
        for n in counts:
            blocks, parts = -(-n // _BLOCK), []
            for length in (-(-n * self.bits // 8), blocks * _BLOCK // 8, 4 * blocks):
                parts.append(raw[at : at + length])
                at += length
            self.levels.append((n, parts[0], parts[1], parts[2].copy().view("<u4")))

    def __len__(self) -> int:
        return self.levels[0][0]

    def _chunk(self, level: int, at: int) -> int:
        _, body, _, _ = self.levels[level]
        if self.bits == 8:
            return int(body[at])
        bits = np.unpackbits(body[at * self.bits // 8 : ((at + 1) * self.bits + 7) // 8])[at * self.bits % 8 :][: self.bits]
        return int(bits @ (1 << np.arange(self.bits)))

    def __getitem__(self, at: int) -> int:
        """Token ``at`` by rank queries alone."""
        if not 0 <= at < len(self):
            raise IndexError(at)
        value = 0
        for level, (_, _, bitmap, before) in enumerate(self.levels):
            value |= self._chunk(level, at) << (level * self.bits)
            if not bitmap[at // 8] >> (7 - at % 8) & 1:
                break
            block = at // _BLOCK
            inside = np.unpackbits(bitmap[block * _BLOCK // 8 : at // 8 + 1])[: at - block * _BLOCK]
            at = int(before[block]) + int(inside.sum())
        return value

    def all(self) -> np.ndarray:
        """Every id, as unsigned 32-bit integers."""
        values = np.zeros(len(self), dtype=np.uint32)
        where = np.arange(len(self))
        for level, (n, body, bitmap, _) in enumerate(self.levels):
            chunk = body if self.bits == 8 else np.unpackbits(body)[: n * self.bits].reshape(n, self.bits) @ (1 << np.arange(self.bits, dtype=np.uint32))
            values[where] |= chunk.astype(np.uint32) << np.uint32(level * self.bits)
            where = where[np.unpackbits(bitmap)[:n].astype(bool)]
        return values


def _cuts(docs: DataFrame, parts: int) -> list[int]:
    """Ascending doc_ids that cut the table into about equal parts; at most ``parts - 1`` of them."""
    if parts < 2:
        return []
    found = docs.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], 100 * parts)).first()[0] or []
    return sorted(set(found))


def write_token_codes(docs: DataFrame, path: str, vocabulary: str, end_id: int | None, chunk_bits: int = 8, segment_tokens: int = 1 << 16, docs_per_part: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode the texts of ``docs`` and write them at ``path`` in ascending doc_id order.

    One shuffle: texts are tokenised where they are read, then their ids move to
    the part of their doc_id and are sorted there. The cuts between parts come
    from a pass over the id column alone.
    """
    spark = docs.sparkSession
    cuts = _cuts(docs.select(F.col(id_col).cast("long").alias("doc_id")), max(shuffle_partitions(spark), -(-docs.count() // docs_per_part)))
    placed = tokenised(texts(docs, id_col, text_col), vocabulary, end_id, cuts)
    # every part is a partition of its own, so no task holds more than one
    placed = placed.repartitionById(len(cuts) + 1, "part").sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "ids")
    # payloads are long rows: look at the page size after every few of them, so that a writer holds little
    writer = placed.mapInPandas(_segments(chunk_bits, segment_tokens), SEGMENTS).write
    writer.options(**{"parquet.page.size.row.check.min": "4", "parquet.block.size": str(16 << 20)}).parquet(f"{path}/segments")
    written = spark.read.schema(SEGMENTS).parquet(f"{path}/segments")
    # as many rows as parts, whatever the size of the corpus within them
    sizes = written.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    base, rows = 0, []
    for part, n in sizes:
        rows.append((part, base))
        base += n
    spark.createDataFrame(rows, "part int, base long").coalesce(1).write.parquet(f"{path}/manifest")


def _segments(chunk_bits: int, segment_tokens: int):
    def close(part: int, number: int, start: int, docs: list) -> pd.DataFrame:
        ids = np.concatenate([np.frombuffer(raw, dtype="<u2" if width == 2 else "<u4").astype(np.uint32) for _, raw, width in docs])
        row = {"part": part, "segment": number, "start_in_part": start, "n_tokens": len(ids)}
        row |= {"doc_ids": [None if pd.isna(d) else int(d) for d, *_ in docs], "doc_tokens": [len(raw) // width for _, raw, width in docs]}
        return pd.DataFrame([row | {"payload": pack_levels(ids, chunk_bits)}])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, number, start, size, docs = None, 0, 0, 0, []
        for batch in batches:
            for row_part, doc, raw, width in zip(batch["part"], batch["doc_id"], batch["ids"], batch["width"]):
                if docs and (row_part != part or size >= segment_tokens):
                    yield close(part, number, start, docs)
                    number, start, size, docs = number + 1, start + size, 0, []
                if row_part != part:
                    part, number, start = row_part, 0, 0
                docs.append((doc, raw, width))
                size += len(raw) // width
        if docs:
            yield close(part, number, start, docs)

    return run


def open_segments(spark: SparkSession, path: str) -> DataFrame:
    """The segments of a token file with ``start``: ids of the whole file before each."""
    small_batches(spark)
    manifest = spark.read.schema("part int, base long").parquet(f"{path}/manifest")
    segments = spark.read.schema(SEGMENTS).parquet(f"{path}/segments")
    return segments.join(F.broadcast(manifest), "part").withColumn("start", F.col("base") + F.col("start_in_part"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Every document of a token file: doc_id, start, ids (array of long)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for doc, start, ids in _walk(batches):
            yield pd.DataFrame({"doc_id": [doc], "start": [start], "ids": [ids.astype(np.int64)]})

    return open_segments(spark, path).select("start", "doc_ids", "doc_tokens", "payload").mapInPandas(run, "doc_id long, start long, ids array<long>")


def document_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document of a token file: doc_id, start, n_tokens, ids_crc32 of its ids as little-endian 32-bit integers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = []
        for doc, start, ids in _walk(batches):
            rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
            if len(rows) == 10_000:
                yield _digest_frame(rows)
                rows = []
        if rows:
            yield _digest_frame(rows)

    return open_segments(spark, path).select("start", "doc_ids", "doc_tokens", "payload").mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _digest_frame(rows: list) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"]).astype({"doc_id": "Int64"})


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    for batch in batches:
        for start, docs, lengths, payload in zip(batch["start"], batch["doc_ids"], batch["doc_tokens"], batch["payload"]):
            ids, at = Levels(payload).all(), 0
            for doc, n in zip(docs, lengths):
                yield None if doc is None or doc != doc else int(doc), int(start) + at, ids[at : at + n]
                at += n


def tokens_at(spark: SparkSession, path: str, positions: DataFrame) -> DataFrame:
    """Random access: for ``positions`` (position long) the token there, by rank queries in the one segment that holds it.

    Positions outside the file give no row. The directory of segments (two integers each) is joined by range; only segments that are asked for are opened.
    """
    segments = open_segments(spark, path).select("part", "segment", "start", "n_tokens", "payload")
    width = segments.agg(F.max("n_tokens")).first()[0] or 1
    spans = segments.select("*", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("start") + F.col("n_tokens") - 1) / width))).alias("cell"))
    asked = positions.select(F.col("position").cast("long")).withColumn("cell", F.floor(F.col("position") / width))
    inside = (F.col("position") >= F.col("start")) & (F.col("position") < F.col("start") + F.col("n_tokens"))
    found = asked.join(spans.select("cell", "part", "segment", "start", "n_tokens"), "cell").filter(inside)
    held = found.groupBy("part", "segment").agg(F.collect_list(F.col("position") - F.col("start")).alias("offsets"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start, offsets, payload in zip(batch["start"], batch["offsets"], batch["payload"]):
                levels = Levels(payload)
                yield pd.DataFrame({"position": [int(start) + int(k) for k in offsets], "token": [levels[int(k)] for k in offsets]})

    return segments.join(held, ["part", "segment"]).select("start", "offsets", "payload").mapInPandas(run, "position long, token long")
