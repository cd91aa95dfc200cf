"""Byte-pair encoding and decoding with a public vocabulary of word pieces.

A text is cut at special tokens, normalised (NFC, lower case), cut into words by the
vocabulary's pattern, and each word's bytes are merged: a priority queue holds the merge
ranks of neighbouring symbols, the symbols form a doubly linked list, and entries whose
symbols have changed meanwhile are skipped.  Decoding looks the ids up and joins the
vocabulary's strings.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, bounded_batches, utf8

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
#: Words whose ids a worker remembers: as many lately met ones, and as many before them.
REMEMBER = 150_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


def _merged(symbols: list[int], ranks: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    n = len(symbols)
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    queue = []

    def offer(i: int, j: int) -> None:
        if (found := ranks.get((symbols[i], symbols[j]))) is not None:
            heapq.heappush(queue, (found[0], i, j, symbols[i], symbols[j], found[1]))

    for i in range(n - 1):
        offer(i, i + 1)
    while queue:
        _, i, j, left, right, new = heapq.heappop(queue)
        if symbols[i] != left or symbols[j] != right or after[i] != j:
            continue  # stale
        symbols[i], symbols[j] = new, -1
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
            offer(i, after[j])
        if before[i] >= 0:
            offer(before[i], i)
    return [s for s in symbols if s >= 0]


class Tokenizer:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, vocab = spec["model"], spec["model"]["vocab"]
        end = model["end_of_word_suffix"] or ""
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        letters = byte_letters()
        self.inner = [vocab[c] for c in letters]
        self.last = [vocab[c + end] for c in letters]
        self.ranks = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(model["merges"])}
        self.strings = {i: s for s, i in (vocab | special).items()}
        self.special = special
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True)) + ")")
        self.split = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def word(self, word: str) -> bytes:
        if (out := self.older.get(word)) is None:
            data = word.encode()
            ids = _merged([*(self.inner[b] for b in data[:-1]), self.last[data[-1]]], self.ranks)
            out = np.array(ids, "<u4").tobytes()
        self.known[word] = out
        return out

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        parts: list[bytes] = []
        if len(self.known) >= REMEMBER:
            self.known, self.older = {}, self.known
        for piece in self.cut.split(text):
            if piece in self.special:
                parts.append(self.special[piece].to_bytes(4, "little"))
            elif piece:
                # lower case letter by letter: a last sigma is not special
                words = self.split.findall(unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower())
                known, make = self.known, self.word
                parts.extend([known[w] if w in known else make(w) for w in words])
        return b"".join(parts)

    def decode(self, ids: bytes) -> str:
        strings = self.strings
        return " ".join([strings[i] for i in np.frombuffer(ids, "<u4").tolist()])


_loaded: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    """The tokenizer of ``path``, loaded once for a worker."""
    if path not in _loaded:
        _loaded[path] = Tokenizer(path)
    return _loaded[path]


_IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))])
_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _input(docs: DataFrame) -> DataFrame:
    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, ids for each row of ``docs``.

    Null and empty texts have no ids; texts of any length are encoded whole; equal texts
    have equal ids; a null doc_id stays null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(vocabulary)
        for batch in batches:
            ids = [np.frombuffer(own.encode(t.decode()), "<u4").astype(np.int64) for t in utf8(batch.column("text"))]
            yield batch_of(_IDS, batch.column("doc_id"), ids)

    return _input(docs).mapInArrow(run, "doc_id long, ids array<long>")


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, text from doc_id, ids: the vocabulary's strings, joined by spaces.

    Null and unknown ids are passed over, as the library does with unknown ones; null and empty lists are
    empty texts; a null doc_id stays null; repeated rows are decoded alike; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(vocabulary)
        schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
        for batch in batches:
            texts = [own.decode(np.array([i for i in ids or () if i in own.strings], "<u4").tobytes()) for ids in batch.column("ids").to_pylist()]
            yield batch_of(schema, batch.column("doc_id"), texts)

    encoded = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<long>").alias("ids"))
    return encoded.mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: each text encoded, and its ids decoded.

    Rows as for :func:`encode`; one pass, without ids moving between processes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(vocabulary)
        for batch in batches:
            ids = [own.encode(t.decode()) for t in utf8(batch.column("text"))]
            digests = [hashlib.sha256(x).hexdigest() for x in ids]
            texts = [hashlib.sha256(own.decode(x).encode()).hexdigest() for x in ids]
            yield batch_of(_DIGEST, batch.column("doc_id"), [len(x) // 4 for x in ids], digests, texts)

    return _input(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
