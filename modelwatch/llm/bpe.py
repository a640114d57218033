"""Byte-level BPE: a backtracking encoder over Aho-Corasick matches, and a decoder over an offset table.

A tokenizer file is given by its path; each Python worker loads it once.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import partial

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType
from tokenizers import pre_tokenizers

from modelwatch.llm.common import append_columns, held

#: The byte-level pre-token pattern, here for letters and numbers below U+0250.
_BELOW = [chr(c) for c in range(0x250)]
_LETTER = re.escape("".join(c for c in _BELOW if c.isalpha()))
_NUMBER = re.escape("".join(c for c in _BELOW if c.isnumeric() and not c.isalpha()))
PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^\s{_LETTER}{_NUMBER}]+|\s+(?!\S)|\s+")
_UNUSUAL = re.compile(r"[^\x00-\x1b\x20-ɏ]")
_BEFORE_SPACE = re.compile(r" (?!\S)")
_SPLIT = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
#: Entries of a worker's tables of encoded strings. A full table becomes the old one, and what is asked for again moves over.
CACHED = 100_000


def byte_letters() -> dict[str, int]:
    """Byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        raw = lambda piece: bytes(letters[c] for c in piece)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.tokens = [b""] * size
        for piece, i in vocab.items():
            self.tokens[i] = piece.encode() if piece in self.special else raw(piece)
        for piece, i in self.special.items():
            self.tokens[i] = piece.encode()
        # pairs: what two neighbours merge into, and when; parts: how a token was last put together
        self.rank = np.full(size, -1, np.int64).tolist()
        self.pairs: dict[tuple[int, int], int] = {}
        self.parts: list[tuple[int, int] | None] = [None] * size
        for rank, (a, b) in enumerate(tuple(m.split(" ")) if isinstance(m, str) else m for m in spec["model"]["merges"]):
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self.pairs[left, right] = whole
            self.parts[whole], self.rank[whole] = (left, right), rank
        known = {t: i for i, t in enumerate(self.tokens) if t and self.parts[i] or len(t) == 1}
        self.shorter = [-1] * size  # the longest token that is a proper prefix
        for t, i in known.items():
            self.shorter[i] = next((known[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in known), -1)
        self.matcher = ahocorasick.Automaton()
        for t, i in known.items():
            self.matcher.add_word(t.decode("latin-1"), (len(t), i))
        self.matcher.make_automaton()
        self.offsets = np.cumsum([0, *map(len, self.tokens)])
        self.blob = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") \
            if self.special else None
        self.fits: dict[tuple[int, int], bool] = {}
        self.piece = _Kept(lambda piece: np.array(self.ids(piece.encode()), "<u4").tobytes())
        self.alone = _Kept(self.chunk)
        self.later = _Kept(lambda word: self.chunk(" " + word))

    def compatible(self, left: int, right: int) -> bool:
        """Whether BPE leaves these neighbours apart: no merge across their border comes before the
        merges that built them."""
        if (known := self.fits.get((left, right))) is not None:
            return known
        a, b, ok = left, right, True
        limit = len(self.pairs)  # a border merge of this rank or later comes too late
        while True:
            whole = self.pairs.get((a, b))
            if whole is not None and self.rank[whole] < limit:
                ok = False
                break
            ra, rb = self.rank[a], self.rank[b]
            if ra < 0 and rb < 0:
                break
            if ra > rb:  # undo the later merge; of equal ones the right was done last
                a, limit = self.parts[a][1], ra
            else:
                b, limit = self.parts[b][0], rb + 1
        if len(self.fits) >= 2 * CACHED:
            self.fits.clear()
        self.fits[left, right] = ok
        return ok

    def ids(self, piece: bytes) -> list[int]:
        """Token ids of one pre-token, as merging in rank order gives them."""
        n = len(piece)
        longest, size = [-1] * n, [0] * n
        for end, (length, token) in self.matcher.iter(piece.decode("latin-1")):
            start = end - length + 1
            if length > size[start]:
                longest[start], size[start] = token, length
        out: list[int] = []
        dead = bytearray(n + 1)  # places from which no valid rest was found
        at, token = 0, longest[0] if n else -1
        while at < n:
            last = out[-1] if out else -1
            while token >= 0:
                end = at + len(self.tokens[token])
                if not dead[end] and (last < 0 or self.compatible(last, token)):
                    break
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
            else:
                dead[at] = 1
                token = out.pop()
                at -= len(self.tokens[token])
                token = self.shorter[token]
        return out

    def pieces(self, text: str) -> list[str]:
        if not _UNUSUAL.search(text):
            return PIECES.findall(text)
        return [text[a:b] for _, (a, b) in _SPLIT.pre_tokenize_str(text)]

    def chunk(self, text: str) -> bytes:
        return b"".join(map(self.piece.__getitem__, self.pieces(text)))

    def _plain(self, text: str) -> bytes:
        """Ids of a text without special strings. A pre-token starts at every space before a word, so words
        are looked up one by one; texts with other runs of white space are split whole."""
        if not text:
            return b""
        if _BEFORE_SPACE.search(text):
            return self.chunk(text)
        head, *rest = text.split(" ")
        return (self.alone[head] if head else b"") + b"".join(map(self.later.__getitem__, rest))

    def encode(self, text: str) -> np.ndarray:
        """Ids (uint32) of a whole text; special strings in it become their tokens."""
        if self.specials is None:
            data = self._plain(text)
        else:
            parts = self.specials.split(text)
            data = b"".join(np.uint32(self.special[p]).tobytes() if i % 2 else self._plain(p) for i, p in enumerate(parts))
        for table in (self.piece, self.later, self.alone):
            table.trim()
        return np.frombuffer(data, "<u4")

    def decode(self, ids: np.ndarray) -> str:
        """Text of the ids; bytes that are not UTF-8 become U+FFFD."""
        start = self.offsets[ids]
        length = self.offsets[ids.astype(np.int64) + 1] - start
        ends = np.cumsum(length)
        if not len(ends):
            return ""
        at = np.arange(ends[-1]) + np.repeat(start - ends + length, length)
        return self.blob[at].tobytes().decode("utf-8", "replace")


class _Kept(dict):
    """Encoded strings, made when first seen; at most two generations of ``CACHED`` short ones stay."""

    def __init__(self, make):
        self.make, self.old = make, {}

    def __missing__(self, text: str) -> bytes:
        data = self.old.get(text)
        if data is None:
            data = self.make(text)
        if len(text) <= 64:
            self[text] = data
        return data

    def trim(self) -> None:
        if len(self) > CACHED:
            self.old = dict(self)
            self.clear()


def load(path: str) -> Codec:
    """The codec of a file, kept by the process."""
    return held(("bpe", path), lambda: Codec(path))


def _digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _round_trip(path: str):
    codec = load(path)

    def work(texts: list[str]) -> list[list]:
        ids = [codec.encode(t) for t in texts]
        back = [codec.decode(i).encode() for i in ids]
        return [list(map(len, ids)), [_digest(i.tobytes()) for i in ids], list(map(_digest, back))]

    return work


def _encode(path: str):
    codec = load(path)

    def work(texts: list[str]) -> list[list]:
        ids = [codec.encode(t) for t in texts]
        return [[i.astype(np.int32) for i in ids], [codec.decode(i) == t for i, t in zip(ids, texts)]]

    return work


def encode(docs: DataFrame, path: str, keep: list[str] | None = None) -> DataFrame:
    """Append ``ids`` (array of int) for each whole text, and ``lossless``: whether decoding them gives the text back.

    Null and empty texts give no ids; columns with these names give way. The result has one row per input row, in
    place: no shuffle."""
    return append_columns(docs, partial(_encode, path), [StructField("ids", ArrayType(IntegerType())),
                                                         StructField("lossless", BooleanType())], keep, as_bytes=False)


def _decode(batches, path: str):
    codec = load(path)
    for batch in batches:
        i = batch.schema.get_field_index("ids")
        texts = [codec.decode(np.asarray(x or [], np.uint32)) for x in batch.column(i).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Append ``decoded`` (string) made from ``ids``; null ids give an empty text."""
    rows = encoded.drop("decoded")
    return rows.mapInArrow(partial(_decode, path=path), StructType([*rows.schema.fields, StructField("decoded", StringType())]))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids (little-endian uint32) and of the text decoded from them.

    Null texts are empty; repeated rows and null doc_ids stay rows of their own; an empty table gives no rows.
    """
    fields = [StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()),
              StructField("decoded_sha256", StringType())]
    return append_columns(docs, partial(_round_trip, path), fields, keep=["doc_id"], as_bytes=False)
