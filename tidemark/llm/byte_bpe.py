"""Byte-level BPE: overlapping chunk encoding and byte-wise decoding.

Texts are cut into chunks that overlap, and the chunks are rows of their own: each is pre-tokenised by whichever task has it, from wherever it
happens to start, and its pieces are merged there. What the pattern matches from a position on depends on the text from
there alone, so two neighbours that share one boundary inside their overlap agree from it on. The first shared boundary is the stitch; left of
it the earlier chunk's pieces count, right of it the later one's. The ids of a document are those of its stitched pieces, in order. Where
an overlap holds no shared boundary (one run of letters longer than the overlap, say) the document is
pre-tokenised from its start, so the result never depends on chunk or overlap sizes.

A document of one chunk has nothing to stitch and is finished where it is; the chunks of longer ones are spread over all tasks and meet again by document.

Defined cases: null text is empty and has no ids; very long texts are many chunks; ids come back in any row order; repeated rows (ids too) each get a row;
ties do not arise; an empty table gives an empty table; columns other than id and text are left out, whatever their names;
decoding joins the bytes of the ids, so ids that split a character decode to its raw bytes, and null ids decode to none.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import shuffle_partitions, texts

#: No match of the pattern depends on more characters after its end than this.
LOOK_AHEAD = 3
_open: dict[int, "ByteBpe"] = {}


def read_ranks(path: str) -> bytes:
    """The rank file as it is; its size does not depend on the corpus."""
    with open(path, "rb") as f:
        return f.read()


#: What one chunk has: the ends of its pieces in the text, how many ids each piece has, and the ids.
Chunk = tuple[np.ndarray, np.ndarray, np.ndarray]


class ByteBpe(dict):
    """piece -> its ids, remembered within a bound; unknown pieces are merged by tiktoken."""

    ROOM = 300_000

    def __init__(self, rank_file: bytes, pattern: str):
        import regex
        import tiktoken

        super().__init__()
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines())}
        self.pattern = regex.compile(pattern)
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.piece_bytes = {rank: piece for piece, rank in ranks.items()}
        #: how ids travel between tasks
        self.narrow = np.dtype("<u2" if max(self.piece_bytes, default=0) < 1 << 16 else "<u4")

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.encoding._encode_single_piece(piece), dtype="<u4").tobytes()
        if len(piece) <= 64:
            if len(self) >= self.ROOM:
                self.clear()
            self[piece] = ids
        return ids

    def whole(self, text: str) -> np.ndarray:
        """The ids of a text, pre-tokenised from its start."""
        return np.frombuffer(b"".join([self[m.group()] for m in self.pattern.finditer(text)]), dtype="<u4")

    def chunk(self, text: str, start: int, last: bool) -> Chunk:
        """A chunk that begins at ``start``, without pieces so near its end that more text could change them (unless it is the last)."""
        found = [(m.end(), self[m.group()]) for m in self.pattern.finditer(text)]
        while not last and found and found[-1][0] > len(text) - LOOK_AHEAD:
            found.pop()
        ends = np.array([e for e, _ in found], dtype=np.int64) + start
        return ends, np.array([len(i) // 4 for _, i in found], dtype=np.int64), np.frombuffer(b"".join([i for _, i in found]), dtype="<u4")

    def joined(self, text: str, chunk: int, overlap: int) -> Chunk:
        """All pieces of ``text``, from chunks encoded one by one."""
        parts = [(start, self.chunk(part, start, start + len(part) == len(text))) for start, part in cut(text, chunk, overlap)]
        return stitch(parts, len(text)) or self.chunk(text, 0, True)

    def stitched(self, text: str, chunk: int, overlap: int) -> list[int]:
        return self.joined(text, chunk, overlap)[0].tolist()

    def encode(self, text: str, chunk: int, overlap: int) -> list[int]:
        return self.joined(text, chunk, overlap)[2].tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.piece_bytes.__getitem__, ids))


def cut(text: str, chunk: int, overlap: int) -> Iterator[tuple[int, str]]:
    """(start, text) of the chunks: each reaches ``overlap`` characters into the next, the last to the end."""
    for start in range(0, max(1, len(text) - overlap), chunk):
        yield start, text[start : start + chunk + overlap]


def stitch(parts: list[tuple[int, Chunk]], length: int) -> Chunk | None:
    """One chunk from neighbours in order, cut where they first share a boundary; None where some share none."""
    taken: list[Chunk] = []
    ends, sizes, ids = parts[0][1]
    for start, (next_ends, next_sizes, next_ids) in parts[1:]:
        inside = ends[np.searchsorted(ends, start) :]
        shared = inside[(inside == start) | np.isin(inside, next_ends)]
        if not len(shared):
            return None
        k, j = np.searchsorted(ends, shared[0], side="right"), np.searchsorted(next_ends, shared[0], side="right")
        taken.append((ends[:k], sizes[:k], ids[: sizes[:k].sum()]))
        ends, sizes, ids = next_ends[j:], next_sizes[j:], next_ids[next_sizes[:j].sum() :]
    taken.append((ends, sizes, ids))
    out = tuple(map(np.concatenate, zip(*taken)))
    return out if not length or len(out[0]) and out[0][-1] == length else None


def byte_bpe(rank_file: bytes, pattern: str) -> ByteBpe:
    key = hash((rank_file, pattern))
    if key not in _open:
        _open[key] = ByteBpe(rank_file, pattern)
    return _open[key]


def _encoded(docs: DataFrame, rank_file: bytes, pattern: str, chunk_chars: int, overlap_chars: int, id_col: str, text_col: str, finish: Callable[[ByteBpe, np.ndarray], tuple], columns: str) -> DataFrame:
    """doc_id and what ``finish`` makes of each document's ids."""
    shared, parts = docs.sparkSession.sparkContext.broadcast((rank_file, pattern)), shuffle_partitions(docs.sparkSession)
    names, rows = [c.split()[0] for c in columns.split(", ")], texts(docs, id_col, text_col)
    one_chunk = F.length("text") <= chunk_chars + overlap_chars

    def framed(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["doc_id", *names]).astype({"doc_id": "Int64"})

    def alone(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = byte_bpe(*shared.value)
        for batch in batches:
            for at in range(0, len(batch), 256):
                some = batch.iloc[at : at + 256]
                yield framed([(doc, *finish(bpe, bpe.whole(text))) for doc, text in zip(some["doc_id"].astype("Int64"), some["text"])])

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc, row, text in zip(batch["doc_id"].astype("Int64"), batch["row"], batch["text"]):
                for start, part in cut(text, chunk_chars, overlap_chars):
                    yield pd.DataFrame({"doc_id": pd.array([doc], dtype="Int64"), "row": row, "start": start, "length": len(text), "text": part})

    def encode_chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = byte_bpe(*shared.value)
        for batch in batches:
            made = [bpe.chunk(text, start, start + len(text) == length) for text, start, length in zip(batch["text"], batch["start"], batch["length"])]
            lengths = [np.diff(ends, prepend=start).astype("<u4").tobytes() for (ends, _, _), start in zip(made, batch["start"])]
            yield batch.assign(doc_id=batch["doc_id"].astype("Int64"), lengths=lengths, sizes=[n.astype("<u4").tobytes() for _, n, _ in made], ids=[i.astype(bpe.narrow).tobytes() for _, _, i in made])

    def join_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe, held = byte_bpe(*shared.value), []

        def document() -> pd.DataFrame:
            wide = lambda raw: np.frombuffer(raw, dtype="<u4").astype(np.int64)
            chunks = [(start, (start + np.cumsum(wide(e)), wide(n), np.frombuffer(i, dtype=bpe.narrow).astype("<u4"))) for _, _, start, _, _, e, n, i in held]
            whole = stitch(chunks, held[0][3])
            ids = whole[2] if whole else bpe.whole("".join([text[:chunk_chars] for *_, text, _, _, _ in held[:-1]]) + held[-1][4])
            return framed([(held[0][0], *finish(bpe, ids))])

        for batch in batches:
            for values in zip(batch["doc_id"].astype("Int64"), *(batch[c] for c in ("row", "start", "length", "text", "lengths", "sizes", "ids"))):
                if held and held[0][1] != values[1]:
                    yield document()
                    held.clear()
                held.append(values)
        if held:
            yield document()

    # rows are told apart by their place in the table, as ids may repeat
    long = rows.withColumn("row", F.monotonically_increasing_id()).filter(~one_chunk)
    chunk_row = "doc_id long, row long, start long, length long, text string"
    chunks = long.mapInPandas(cut_up, chunk_row).repartition(parts, "row", "start").mapInPandas(encode_chunks, chunk_row + ", lengths binary, sizes binary, ids binary")
    joined = chunks.repartition(parts, "row").sortWithinPartitions("row", "start").mapInPandas(join_up, f"doc_id long, {columns}")
    return rows.filter(one_chunk).mapInPandas(alone, f"doc_id long, {columns}").unionByName(joined)


def encode(docs: DataFrame, rank_file: bytes, pattern: str, chunk_chars: int = 16_384, overlap_chars: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int): the ids of each whole text, every match of ``pattern`` merged separately."""
    return _encoded(docs, rank_file, pattern, chunk_chars, overlap_chars, id_col, text_col, lambda bpe, ids: (ids.astype(np.int32),), "ids array<int>")


def decode(encoded: DataFrame, rank_file: bytes, pattern: str) -> DataFrame:
    """doc_id, bytes: the raw bytes of ``ids``, joined."""
    shared = encoded.sparkSession.sparkContext.broadcast((rank_file, pattern))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = byte_bpe(*shared.value)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "bytes": [bpe.decode([] if ids is None else ids.tolist()) for ids in batch["ids"]]})

    return encoded.select("doc_id", "ids").mapInPandas(run, "doc_id long, bytes binary")


def round_trip_digests(docs: DataFrame, rank_file: bytes, pattern: str, chunk_chars: int = 16_384, overlap_chars: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, then decode the ids: doc_id, n_tokens, ids_sha256 (of decimal ids joined by commas), decoded_sha256."""

    def digests(bpe: ByteBpe, ids: np.ndarray) -> tuple[int, str, str]:
        listed = ids.tolist()
        return len(listed), hashlib.sha256(",".join(map(str, listed)).encode()).hexdigest(), hashlib.sha256(bpe.decode(listed)).hexdigest()

    return _encoded(docs, rank_file, pattern, chunk_chars, overlap_chars, id_col, text_col, digests, "n_tokens long, ids_sha256 string, decoded_sha256 string")
