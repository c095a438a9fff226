"""Byte-level BPE with a public vocabulary: merge rounds over many words at once.

Texts are cut by the vocabulary's added tokens and the byte-level pattern. The distinct new words of a
chunk lie as symbols in one flat array. Each round looks all neighbouring pairs up by binary search over
the sorted pair keys, takes every word's lowest rank and merges all its places (every other one where a
symbol pairs with itself); words without a pair left drop out. Words once encoded are kept by the worker
until ``WORDS_KEPT``, then it starts afresh. Decoding gathers the ids' bytes.

Defined results: a null text counts as empty and has no ids; an added token's string in a text becomes its
id; repeated rows come out repeated.
"""

from __future__ import annotations

import hashlib
import json
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetsight.llm.flat import CHUNK_BYTES

# Fixed value: the published pattern of byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WORDS_KEPT = 400_000
_NEVER = np.iinfo(np.int64).max
_SYMBOL_BITS = np.uint64(20)


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte: itself if it prints in Latin-1, else the next from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [byte for byte in range(256) if byte not in set(plain)]
    return {chr(byte): byte for byte in plain} | {chr(0x100 + k): byte for k, byte in enumerate(other)}


class Ragged:
    """Sequences of different lengths in one flat array."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        self.flat, self.sizes = flat, sizes
        self.starts = np.cumsum(sizes) - sizes

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The chosen sequences one after the other, and their sizes."""
        sizes = self.sizes[which]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if ends.size else 0
        return self.flat[np.arange(total) + np.repeat(self.starts[which] - (ends - sizes), sizes)], sizes


class Tables:
    """What a tokenizer file says, as arrays; small enough to travel with the tasks."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        added = {token["content"]: token["id"] for token in spec["added_tokens"]}
        size = max([*vocab.values(), *added.values()]) + 1
        spelled = [b""] * size
        for token, number in vocab.items():
            spelled[number] = bytes(letters[letter] for letter in token)
        for token, number in added.items():
            spelled[number] = token.encode()
        self.added = added
        self.first = np.array([vocab[letter] for letter, _ in sorted(letters.items(), key=lambda x: x[1])], dtype=np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([(vocab[a] << int(_SYMBOL_BITS)) | vocab[b] for a, b in merges], dtype=np.uint64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        self.bytes = self._ragged(spelled)
        self.digits = self._ragged([b"%d," % number for number in range(size)])

    @staticmethod
    def _ragged(parts: list[bytes]) -> Ragged:
        return Ragged(np.frombuffer(b"".join(parts), np.uint8), np.array([len(part) for part in parts]))

    def merge(self, words: Sequence[bytes]) -> Ragged:
        """Ids of each word."""
        sizes = np.array([len(word) for word in words], dtype=np.int64)
        symbols = self.first[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(sizes.size), sizes)
        done_symbols, done_owner = [], []
        while symbols.size:
            same = owner[1:] == owner[:-1]
            key = (symbols[:-1].astype(np.uint64) << _SYMBOL_BITS) | symbols[1:].astype(np.uint64)
            at = np.minimum(np.searchsorted(self.keys, key), self.keys.size - 1)
            rank = np.full(symbols.size, _NEVER)
            rank[:-1] = np.where(same & (self.keys[at] == key), self.ranks[at], _NEVER)
            begin = np.flatnonzero(np.diff(owner, prepend=-1))
            lowest = np.repeat(np.minimum.reduceat(rank, begin), np.diff(np.append(begin, owner.size)))
            over = lowest == _NEVER
            done_symbols.append(symbols[over])
            done_owner.append(owner[over])
            symbols, owner, rank, lowest = symbols[~over], owner[~over], rank[~over], lowest[~over]
            places = np.flatnonzero(rank == lowest)
            # Overlapping places are a symbol paired with itself: of such a run every other one merges.
            run = np.flatnonzero(np.diff(places, prepend=-2) != 1)
            within = np.arange(places.size) - np.repeat(run, np.diff(np.append(run, places.size)))
            places = places[within % 2 == 0]
            symbols[places] = self.made[rank[places]]
            keep = np.ones(symbols.size, dtype=bool)
            keep[places + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        if not done_owner:
            return Ragged(symbols, np.zeros(len(words), dtype=np.int64))
        owner = np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        return Ragged(np.concatenate(done_symbols)[order], np.bincount(owner, minlength=len(words)))


class Encoder:
    """Encodes chunks of texts; words seen before are looked up."""

    def __init__(self, tables: Tables) -> None:
        import regex

        self.tables = tables
        self.find = regex.compile(PATTERN).findall
        self.cut = regex.compile("|".join(map(regex.escape, sorted(tables.added, key=len, reverse=True)))).split if tables.added else None
        self.mark = regex.compile("|".join(map(regex.escape, sorted(tables.added, key=len, reverse=True)))).findall if tables.added else None
        self.reset()

    def reset(self) -> None:
        self.codes: defaultdict[str, int] = defaultdict()
        self.codes.default_factory = self.codes.__len__  # a new word gets the next number
        self.known = Ragged(np.zeros(0, np.int64), np.zeros(0, np.int64))
        for token, number in self.tables.added.items():
            self.codes["\0" + token]
            self.known = Ragged(np.append(self.known.flat, number), np.append(self.known.sizes, 1))

    def words(self, text: str) -> list[str]:
        """Words of a text; an added token has a mark before it that no word of the pattern joins to it."""
        if self.cut is None or not any(token in text for token in self.tables.added):
            return self.find(text)
        out: list[str] = []
        marks = [*self.mark(text), None]
        for piece, token in zip(self.cut(text), marks):
            out.extend(self.find(piece))
            if token is not None:
                out.append("\0" + token)
        return out

    def encode(self, texts: Sequence[str]) -> Ragged:
        if len(self.codes) > WORDS_KEPT:
            self.reset()
        codes, old, numbers, counts = self.codes, len(self.codes), [], []
        for text in texts:
            words = self.words(text)
            numbers.append(np.array([codes[word] for word in words], dtype=np.int64))
            counts.append(len(words))
        if len(codes) > old:
            new = list(islice(codes, old, None))
            made = self.tables.merge([word.encode() for word in new])
            self.known = Ragged(np.append(self.known.flat, made.flat), np.append(self.known.sizes, made.sizes))
        flat, sizes = self.known.take(np.concatenate(numbers) if numbers else np.zeros(0, np.int64))
        edges = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]
        return Ragged(flat, np.diff(edges))

    def decode(self, ids: np.ndarray) -> str:
        data, _ = self.tables.bytes.take(ids)
        return data.tobytes().decode("utf-8", "replace")

    def id_text(self, ids: np.ndarray) -> bytes:
        data, _ = self.tables.digits.take(ids)
        return data[:-1].tobytes()


def _texts_at_once(texts: Sequence[str | None]) -> Iterator[list[str]]:
    held, size = [], 0
    for text in texts:
        held.append(text or "")
        size += len(held[-1])
        if size >= CHUNK_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _runner(tables: Tables, with_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tables)
        for batch in batches:
            names, at = batch.schema.names, 0
            for texts in _texts_at_once(batch.column("text").to_pylist()):
                found = encoder.encode(texts)
                counts, digests, decoded = [], [], []
                for start, size in zip(found.starts.tolist(), found.sizes.tolist()):
                    ids = found.flat[start : start + size]
                    counts.append(size)
                    digests.append(hashlib.sha256(encoder.id_text(ids)).hexdigest())
                    decoded.append(hashlib.sha256(encoder.decode(ids).encode()).hexdigest())
                piece = batch.slice(at, len(texts))
                at += len(texts)
                columns = [piece.column(k) for k, name in enumerate(names) if name != "text"]
                labels = [name for name in names if name != "text"] + ["n_tokens", "ids_sha256", "decoded_sha256"]
                columns += [pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
                if with_ids:
                    edges = np.append(found.starts, found.flat.size).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(edges), pa.array(found.flat.astype(np.int32))))
                    labels.append("ids")
                yield pa.RecordBatch.from_arrays(columns, labels)

    return run


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``, with ``with_ids`` also ``ids array<int>``.

    Ids are those of the tokenizers library with the file at ``path`` (read by the driver) and without
    special tokens added; ``ids_sha256`` is of the decimal ids joined by commas, ``decoded_sha256`` of the
    text decoded from the ids.
    """
    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return chosen.mapInArrow(_runner(Tables(path), with_ids), schema)
