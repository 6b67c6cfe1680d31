"""Byte-level BPE: encoding with offsets and decoding, in Arrow batches around the tokenizers library.

A text is split by the pre-tokenisation pattern; the merges never cross those matches, so each distinct match is
encoded once per worker by the library's merge model and looked up afterwards.  The byte-to-character table of
byte-level vocabularies is rebuilt from its rule; reversing it turns each id into bytes.  Tokens may end inside a
UTF-8 character: bytes are joined before they are decoded, and offsets give the characters a token touches.
"""

from __future__ import annotations

import hashlib
import re
import struct
import sys
import types
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")

#: Unicode White_Space, written out: libraries differ on the four separators U+001C to U+001F.
SPACE = "\t-\r \x85\xa0  -     　"
PIECES = regex.compile(public_tokenizers.PATTERN.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]")
                       .replace(r"\s", f"[{SPACE}]"))
#: The same pattern for texts of ASCII only, for the faster library.
ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")

#: Distinct pieces a worker remembers before it starts anew; bounds its memory to about 350 MB.
REMEMBERED = 1_400_000


def byte_characters() -> dict[str, int]:
    """Character -> byte: printable Latin-1 bytes stand for themselves, the others for U+0100 and up, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Known(dict):
    """Piece -> ids as little-endian 32-bit integers; what is not known yet is encoded when it is asked for.

    A piece is one pre-token, so the library's merge model gets it directly, its bytes written as their characters.
    """

    def __init__(self, tokenizer):
        super().__init__()
        self.merge = tokenizer.model.tokenize
        self.characters = {b: c for c, b in byte_characters().items()}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        tokens = self.merge(piece.encode().decode("latin-1").translate(self.characters))
        ids = self[piece] = struct.pack(f"<{len(tokens)}i", *[t.id for t in tokens])
        return ids


class Codec:
    """One vocabulary in one worker process."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.encode_special_tokens = True
        table = byte_characters()
        words = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(words.values()) + 1)
        for word, k in words.items():
            self.bytes[k] = bytes(table[c] for c in word) if all(c in table for c in word) else word.encode()
        self.lengths = np.array([len(b) for b in self.bytes])
        self.decimal = [str(k) for k in range(len(self.bytes))]
        self.known = Known(self.tokenizer)
        self.added = {t.content: np.array([k], "<i4").tobytes() for k, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.of_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    @classmethod
    def here(cls, vocabulary: str) -> Codec:
        """The worker's codec, kept from task to task."""
        kept = sys.modules.setdefault("_codecs_of_this_worker", types.ModuleType("_codecs_of_this_worker")).__dict__
        if vocabulary not in kept:
            import os

            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            kept[vocabulary] = cls(vocabulary)
        return kept[vocabulary]

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers; equal texts of a call are encoded once."""
        ids_of, done = self.known.__getitem__, {}
        for t in texts:
            if t not in done:
                done[t] = b"".join(map(ids_of, (ASCII_PIECES if t.isascii() else PIECES).findall(t)))
        return [done[t] for t in texts]

    def encode_with_added(self, texts: Iterable[str]) -> list[bytes]:
        """As ``encode``, but the vocabulary's added tokens, written out in a text, get their own ids."""
        out = self.encode(texts)
        for k, t in enumerate(texts):
            if self.of_added and self.of_added.search(t):
                parts = self.of_added.split(t)  # every other one is an added token
                out[k] = b"".join(b for pair in zip(self.encode(parts[::2]), [*map(self.added.get, parts[1::2]), b""]) for b in pair)
        return out

    def decode(self, ids: bytes) -> bytes:
        table = self.bytes
        return b"".join([table[i] for i in np.frombuffer(ids, "<i4").tolist()])

    def offsets(self, text: str, ids: bytes) -> tuple[np.ndarray, np.ndarray]:
        """First character of each token and the end after its last; characters split between tokens count for each."""
        data = np.frombuffer(text.encode(), np.uint8)
        of_byte = np.cumsum((data & 0xC0) != 0x80) - 1  # byte -> character
        ends = np.cumsum(self.lengths[np.frombuffer(ids, "<i4")])
        starts = np.concatenate([[0], ends[:-1]])[: len(ends)]
        return (of_byte[starts], of_byte[ends - 1] + 1) if len(ends) else (ends, ends)


def slices(column: pa.Array, limit: int = 2_000_000) -> Iterator[tuple[int, list[str]]]:
    """``(first row, texts)`` of a batch in parts of about ``limit`` characters; nulls are empty texts."""
    part, size, first = [], 0, 0
    for k, value in enumerate(column):
        text = value.as_py() or ""
        part.append(text)
        size += len(text)
        if size >= limit:
            yield first, part
            part, size, first = [], 0, k + 1
    if part:
        yield first, part


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, text_col: str = "text") -> DataFrame:
    """``doc_id, ids, starts, ends`` per row: token ids and the characters each token covers.

    Null texts are empty and give empty lists; ids may repeat or be null; other columns are not read; an empty
    table gives an empty result.
    """
    kind = "doc_id long, ids array<int>, starts array<int>, ends array<int>"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.here(vocabulary)
        for batch in batches:
            for first, texts in slices(batch.column(1)):
                ids = codec.encode(texts)
                where = [codec.offsets(t, i) for t, i in zip(texts, ids)]
                lists = [[np.frombuffer(i, "<i4") for i in ids], [w[0] for w in where], [w[1] for w in where]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(texts)), *(pa.array(x, pa.list_(pa.int32())) for x in lists)],
                    ["doc_id", "ids", "starts", "ends"])

    return _input(docs, text_col).mapInArrow(run, kind)


def decode(tokens: DataFrame, vocabulary: str = VOCABULARY, ids_col: str = "ids") -> DataFrame:
    """``doc_id, data, text`` per row: the bytes of the ids and their text (invalid UTF-8 as U+FFFD); null ids are empty."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.here(vocabulary)
        for batch in batches:
            data = [codec.decode(np.array(v.as_py() or [], "<i4").tobytes()) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(data, pa.binary()), pa.array([d.decode("utf-8", "replace") for d in data])],
                ["doc_id", "data", "text"])

    return tokens.select(F.col("doc_id").cast("long"), F.col(ids_col)).mapInArrow(run, "doc_id long, data binary, text string")


def round_trip(docs: DataFrame, vocabulary: str = VOCABULARY, text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: digests of what ``encode`` gives and of those ids decoded.

    Both directions run in one Arrow pass, so that ids of the whole corpus do not travel between processes.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.here(vocabulary)
        for batch in batches:
            for first, texts in slices(batch.column(1)):
                n, ids_sha, data_sha = [], [], []
                for ids in codec.encode(texts):
                    numbers = np.frombuffer(ids, "<i4").tolist()
                    n.append(len(numbers))
                    ids_sha.append(hashlib.sha256(" ".join([codec.decimal[i] for i in numbers]).encode()).hexdigest())
                    data_sha.append(hashlib.sha256(codec.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(texts)), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(data_sha)],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _input(docs, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _input(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), C.text_or_empty(text_col).alias("text"))
