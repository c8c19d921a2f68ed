"""Tokenise whole texts with a vocabulary of the ``tokenizers`` library, each distinct word only once per worker.

The vocabularies served here drop white space and never merge across it, so the
ids of a text are the ids of its white-space separated words in order. Each
Python worker keeps the ids of the words it has met, up to a bound; words of
letters alone go straight to the library's merges. Commas and full stops that touch no other mark are words of their
own, so that a word is remembered once and not again with each of them. Texts that hold the string of a special token go to the library whole,
which makes it that token's id, as it does by itself.

Defined cases: null texts are empty and give ``end_id`` alone; very long texts are encoded whole; repeated rows give the same ids; an
empty table gives no rows; columns other than doc_id and text are left out.
"""

from __future__ import annotations

import codecs
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Beyond U+024F, or with these separators, Python and the library may disagree on case, composition or white space.
_UNUSUAL = re.compile("[^\x00-\x1b\x20-\x84\x86-ɏ]")
_ROOM = 500_000
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Words on which the short way must agree with the whole one before it is used.
_PROBES = ("a", "the", "straße", "été", "unbelievable", "niño", "zzzzqqqq", "ärger")


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write bytes with: printable Latin-1 stays, the rest follows from U+0100 on."""
    stays = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    moved = [b for b in range(256) if b not in set(stays)]
    return {b: chr(b) for b in stays} | {b: chr(256 + k) for k, b in enumerate(moved)}


_LETTERS = "".join(_byte_letters()[b] for b in range(256))


def _kind(letter: str) -> str:
    """``!`` unusual, ``.`` comma or full stop, ``a`` letter, digit or blank, ``#`` any other mark (and ``?``, which stands for letters beyond Latin-1)."""
    if _UNUSUAL.match(letter):
        return "!"
    if letter in ",.":
        return "."
    return "a" if letter.isspace() or unicodedata.category(letter)[0] in "LN" else "#"


_KINDS = "".join(_kind(chr(b)) for b in range(256)).encode()
#: Under this pattern of pre-tokens, marks in a row are one, and marks beside letters, digits or blanks are apart from them.
_MARKS_APART = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_open: dict[int, "WordTokens"] = {}


class WordTokens(dict):
    """word -> its ids as bytes; unknown words are encoded by the library on first use."""

    def __init__(self, vocabulary: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        #: What the library cuts out of a text before anything else, as one id each; compared without case, for some match the normalised text.
        self.special = [x["content"].lower() for x in json.loads(vocabulary).get("added_tokens", [])]
        self.dtype = np.dtype("u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "u4")
        self.merges, self.turned_away = self.tokenizer.model, 0
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.by_word = self._words_stand_alone(vocabulary)
        self.short_way = self.by_word and all(self._merge(w) == self._encode(w) for w in _PROBES)
        self.marks_apart = self.short_way and json.loads(vocabulary)["pre_tokenizer"]["pretokenizers"][0]["pattern"].get("Regex") == _MARKS_APART

    @staticmethod
    def _words_stand_alone(vocabulary: str) -> bool:
        """True where the pre-tokeniser removes white space, lower-cases, and so splits at every blank."""
        parts = json.loads(vocabulary)
        steps = (parts.get("pre_tokenizer") or {}).get("pretokenizers", [])
        cases = (parts.get("normalizer") or {}).get("normalizers", [])
        split = steps and steps[0].get("type") == "Split" and steps[0].get("behavior") == "Removed" and steps[0].get("invert")
        return bool(split and any(x.get("type") == "Lowercase" for x in cases) and all(r"\s" not in re.sub(r"\[\^[^\]]*\]", "", x["pattern"]["Regex"]) for x in steps[:1]))

    def _encode(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _merge(self, word: str) -> bytes:
        """The ids of one word of lower-case letters, without normaliser and pre-tokeniser."""
        letters = word if word.isascii() else codecs.charmap_decode(word.encode(), "strict", _LETTERS)[0]
        return array(self.code, [t.id for t in self.merges.tokenize(letters)]).tobytes()

    def __missing__(self, word: str) -> bytes:
        if not self.short_way:
            ids = self._encode(word)
        elif word.isalpha():
            ids = self._merge(word)
        else:  # letters and then marks are two pre-tokens
            stem = word.rstrip(_MARKS)
            ids = self[stem] + self[word[len(stem) :]] if len(stem) < len(word) and stem.isalpha() else self._encode(word)
        if len(self) < _ROOM:
            if len(word) <= 64:
                self[word] = ids
        else:
            self.turned_away += 1
            if self.turned_away > 4 * _ROOM:  # other words have become frequent
                self.turned_away = 0
                self.clear()
        return ids

    def ids(self, text: str) -> bytes:
        """All ids of ``text`` as little-endian bytes of ``self.dtype``."""
        lowered = text.lower()
        try:
            kinds = text.encode("latin-1").translate(_KINDS)
            unusual = b"!" in kinds
        except UnicodeEncodeError:
            kinds = text.encode("latin-1", "replace").translate(_KINDS)
            unusual = _UNUSUAL.search(text) is not None
        if not self.by_word or unusual or any(s in lowered for s in self.special):
            return self._encode(text)
        if self.marks_apart and not (b".." in kinds or b".#" in kinds or b"#." in kinds):
            lowered = lowered.replace(",", " , ").replace(".", " . ")
        return b"".join(map(self.__getitem__, lowered.split()))


def word_tokens(vocabulary: str) -> WordTokens:
    """The worker's own instance for this vocabulary (the JSON text of its file)."""
    key = hash(vocabulary)
    if key not in _open:
        _open[key] = WordTokens(vocabulary)
    return _open[key]


def read_vocabulary(path: str) -> str:
    """The vocabulary's JSON text; its size does not depend on the corpus, so it may be broadcast."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def tokenised(docs: DataFrame, vocabulary: str, end_id: int | None, cuts: list[int] | None = None) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, ``ids`` (binary, 2 or 4 bytes an id), ``width`` (bytes an id) and ``part`` (how many of ``cuts`` are at or below doc_id; null ids: 0).

    Every text is encoded whole, without adding special tokens; ``end_id`` (if any) is appended.
    """
    bounds = np.array(cuts or [], dtype=np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = word_tokens(shared.value)
        end = b"" if end_id is None else np.array([end_id], dtype=words.dtype).tobytes()
        for batch in batches:
            ids = [words.ids(text) + end for text in batch["text"]]
            doc_id = batch["doc_id"].astype("Int64")
            part = np.searchsorted(bounds, doc_id.fillna(np.iinfo(np.int64).min).to_numpy(dtype=np.int64), side="right").astype(np.int32)
            yield pd.DataFrame({"doc_id": doc_id, "ids": ids, "width": np.int32(words.dtype.itemsize), "part": part})

    return docs.select("doc_id", "text").mapInPandas(encode, "doc_id long, ids binary, width int, part int")
