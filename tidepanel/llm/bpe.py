"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

The encoding of every prefix of a piece ends in exactly one token. `Encoder`
stores that token per prefix: among the vocabulary entries that are suffixes of
the prefix (found by one automaton pass) it is the longest whose pair with the
last token of the shorter prefix survives the merges. Following the stored
tokens back from the end gives the ids. A piece costs a pass over its bytes
times the few entries that end at each, however often merges would interleave.

Texts are cut into pieces first, as the vocabulary file prescribes. Pieces
repeat a lot, so each Python worker remembers the ids of those it has met, up to
`REMEMBERED` of them, then forgets all and goes on. A word is remembered once, with
or without the blank before it, and idle workers keep what they remember.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterator
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import map_batches

REMEMBERED = 200_000
LONG_TEXT = 1 << 22
# Fixed values of the byte-level format: the piece pattern, and the bytes that stand for themselves.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: A blank next to other white space; texts without one may be cut at every blank.
CROWDED = regex.compile(r" \s|\s ")
#: From here on, releases of Unicode differ in which code points are letters or numbers.
SETTLED = regex.compile("[\\x00-\\u052F\\u2010-\\u2027\\u20A0-\\u20BF]*+")
#: A word of nothing but these is one piece.
LETTERS = regex.compile("[A-Za-z\\u00C0-\\u00D6\\u00D8-\\u00F6\\u00F8-\\u024F]++").fullmatch


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Remembered(dict):
    """A bounded memo over `make`."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[key] = self.make(key)
        return value


class Encoder:
    """Encodes and decodes with one vocabulary file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        spare = iter(range(256, 512))
        letters = {chr(b if b in PRINTABLE else next(spare)): b for b in range(256)}
        as_bytes = lambda token: bytes(letters[c] for c in token)
        vocab = spec["model"]["vocab"]
        self.ids = {as_bytes(token): number for token, number in vocab.items()}
        self.bytes_of = {number: token for token, number in self.ids.items()}
        self.lengths = {number: len(token) for token, number in self.ids.items()}
        self.merged: dict[tuple[int, int], int] = {}  # a pair of tokens: when it merges
        self.made: dict[int, tuple[int, int, int]] = {}  # a token: when it is made, of which pair
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b = vocab[left], vocab[right]
            self.merged[a, b] = rank
            self.made.setdefault(vocab[left + right], (rank, a, b))
        self.suffixes = ahocorasick.Automaton()
        for token, number in self.ids.items():
            self.suffixes.add_word(token.decode("latin-1"), (len(token), number))
        self.suffixes.make_automaton()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {number: text.encode() for text, number in self.special.items()}
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.pattern = regex.compile(PIECE)
        self.splitter = Tokenizer.from_file(path).pre_tokenizer
        self.edges: tuple[dict, dict] = ({}, {})
        self.compatible = Remembered(self._compatible)
        self.piece_ids = Remembered(lambda piece: packed(self.encode_piece(piece.encode())))
        self.word_ids = Remembered(self._join)
        self.spaced_ids = Remembered(lambda word: packed(self.encode_piece(b" " + word.encode())) if LETTERS(word) else self._join(" " + word))

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """Tokens at a token's left (0) or right (1) end, outermost first, each with the time that it merges away."""
        found = self.edges[side].get(token)
        if found is None:
            found, at, until = [], token, float("inf")
            while True:
                found.append((at, until))
                if at not in self.made:
                    break
                until, *pair = self.made[at]
                at = pair[side]
            self.edges[side][token] = found
        return found

    def _compatible(self, pair: int) -> bool:
        """Whether two tokens side by side stay apart: no pair that meets at their border ever merges first.

        Of equal times the left one goes first: a border pair loses against a
        merge inside the left token, and wins against one inside the right.
        """
        left, right = self._edge(pair >> 32, 1), self._edge(pair & 0xFFFFFFFF, 0)
        i, j = len(left) - 1, len(right) - 1
        while True:
            (a, a_until), (b, b_until) = left[i], right[j]
            when = self.merged.get((a, b))
            if when is not None and when < a_until and when <= b_until:
                return False
            if i == 0 and j == 0:
                return True
            if a_until <= b_until:
                i -= 1
            else:
                j -= 1

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one piece: the last token of every prefix, then back from the end."""
        at = len(piece) - 1
        last = [-1] * (at + 2)  # by the position of a prefix's final byte; the empty prefix is at -1
        done, compatible = -1, self.compatible
        for end, (length, token) in self.suffixes.iter(piece.decode("latin-1")):
            if done != end and (end < length or compatible[last[end - length] << 32 | token]):
                last[end] = token
                done = end
        ids, lengths = [], self.lengths
        while at >= 0:
            token = last[at]
            ids.append(token)
            at -= lengths[token]
        ids.reverse()
        return ids

    def pieces(self, text: str) -> Iterator[str]:
        if SETTLED.fullmatch(text):
            return (m[0] for m in self.pattern.finditer(text))
        return (text[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(text))

    def _join(self, text: str) -> bytes:
        return b"".join([self.piece_ids[p] for p in self.pieces(text)])

    def _plain(self, text: str) -> Iterator[bytes]:
        if not text:
            return
        if CROWDED.search(text):
            pieces = self.pieces(text)
            while part := [self.piece_ids[p] for p in islice(pieces, LONG_TEXT)]:
                yield b"".join(part)
            return
        first, *rest = text.split(" ")
        yield self.word_ids[first]
        yield b"".join(map(self.spaced_ids.__getitem__, rest))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        out = []
        for part in self.cut_special.split(text) if self.cut_special else [text]:
            if part in self.special:
                out.append(self.special[part].to_bytes(4, "little"))
            else:
                out.extend(self._plain(part))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text of the ids; bytes that are no UTF-8 become U+FFFD."""
        numbers = np.frombuffer(ids, "<u4").tolist()
        return b"".join(map(self.bytes_of.__getitem__, numbers)).decode("utf-8", "replace")


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Every row of (doc_id, text) with `ids` (array of int), encoded whole.

    A null text is empty and has no ids; a null doc_id and repeated rows stay as
    they are; other columns are left behind. Rows are independent: no shuffle.
    """
    path = path or vocabulary_path()

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = encoder(path)
        ids = [np.frombuffer(codec.encode(text or ""), "<u4").astype(np.int32) for text in batch["text"].to_pylist()]
        return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return map_batches(docs.select("doc_id", "text"), each, f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """Every row of (doc_id, ids) with the `text` of its ids; null ids give an empty text."""
    path = path or vocabulary_path()

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = encoder(path)
        texts = [codec.decode(np.array(ids or [], "<u4").tobytes()) for ids in batch["ids"].to_pylist()]
        return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], ["doc_id", "text"])

    return map_batches(encoded.select("doc_id", "ids"), each, f"doc_id {dict(encoded.dtypes)['doc_id']}, text string")


def round_trip(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), and `ids` if asked, of every document, encoded and decoded in one pass.

    The digests cover the ids as little-endian unsigned 32-bit integers and the
    decoded text in UTF-8. Nulls and repeats as in `encode`.
    """
    path = path or vocabulary_path()

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = encoder(path)
        counts, coded, back, listed = [], [], [], []
        for value in batch["text"]:
            ids = codec.encode(value.as_py() or "")
            counts.append(len(ids) // 4)
            coded.append(hashlib.sha256(ids).hexdigest())
            back.append(hashlib.sha256(codec.decode(ids).encode()).hexdigest())
            if with_ids:
                listed.append(np.frombuffer(ids, "<u4").astype(np.int32))
        columns = {"doc_id": batch["doc_id"], "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(coded, pa.string()),
                   "decoded_sha256": pa.array(back, pa.string())}
        if with_ids:
            columns["ids"] = pa.array(listed, pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), each,
                       "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
