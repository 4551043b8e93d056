"""Encoding of a corpus with a public byte-level BPE vocabulary by content-defined chunk reuse (problem 7)."""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Where the vocabulary lies; a parameter of every operator here.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public pre-tokenizer pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Code points that the rolling hash looks at, and the average number between two cuts (a power of two).
HASH_WINDOW, CHUNK_AVERAGE = 24, 1024
#: Code points of distinct chunks that a worker remembers before it starts anew.
MEMO_CHARS = 16_000_000

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))


class Encoder:
    """Encodes texts exactly as the vocabulary's library does, remembering the chunks it has seen."""

    def __init__(self, path: str = VOCABULARY):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        self._encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self._sizes[i] = len(token)
        self._memo: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        self._held = 0
        self._powers = self._inverses = np.ones(1, np.uint64)
        self._classes = np.zeros(0x110000, np.int8)
        self._known = np.zeros(0x110000, bool)

    def _class(self, points: np.ndarray) -> np.ndarray:
        """1 letter, 2 number, 3 white space, 4 other, 0 unassigned here."""
        if not self._known[points].all():
            for p in np.unique(points[~self._known[points]]):
                c = chr(p)
                kind = unicodedata.category(c)
                self._classes[p] = 3 if c.isspace() else {"L": 1, "N": 2}.get(kind[0], 0 if kind == "Cn" else 4)
                self._known[p] = True
        return self._classes[points]

    def _rolling(self, points: np.ndarray) -> np.ndarray:
        """Hash of the HASH_WINDOW code points before each cut position from HASH_WINDOW to the end."""
        n = len(points)
        if len(self._powers) < n + 1:
            size = max(n + 1, 2 * len(self._powers))
            self._powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, _BASE)]))
            self._inverses = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, _BASE_INVERSE)]))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((points.astype(np.uint64) + np.uint64(1)) * self._powers[:n])])
        h = (sums[HASH_WINDOW:] - sums[:-HASH_WINDOW]) * self._inverses[: n + 1 - HASH_WINDOW]
        return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)

    def cuts(self, points: np.ndarray) -> np.ndarray:
        """Positions inside the text at which its content says to cut."""
        if len(points) <= HASH_WINDOW:
            return np.zeros(0, np.int64)
        at = np.flatnonzero(self._rolling(points)[:-1] >> np.uint64(64 - CHUNK_AVERAGE.bit_length() + 1) == 0)
        return at + HASH_WINDOW

    def _chunk(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a chunk and the byte at which each ends, from memory if the chunk was seen before."""
        found = self._memo.get(text)
        if found is None:
            ids = np.array(self._encode(text), np.int32)
            found = ids, np.cumsum(self._sizes[ids])
            if self._held > MEMO_CHARS:
                self._memo.clear()
                self._held = 0
            self._memo[text] = found
            self._held += len(text)
        return found

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a text; none for null and the empty text. Strings that look like special tokens are plain text."""
        if not text:
            return np.zeros(0, np.int32)
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        cuts = self.cuts(points)
        if not len(cuts):
            return self._chunk(text)[0]
        kinds = self._class(points)
        before, after = kinds[:-1], kinds[1:]
        # where a pre-token ends whatever surrounds it: before white space, and where letters or numbers stop
        firm = np.flatnonzero((after != 0) & (before != 0) & (before != 3) & ((after == 3) | ((before != after) & (before != 4)))) + 1
        at_byte = np.concatenate([[0], np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))])
        edges = [0, *cuts.tolist(), len(points)]
        chunks = [self._chunk(text[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
        return self._joined(text, edges, chunks, firm, at_byte)

    def _joined(self, text: str, edges: list[int], chunks: list, firm: np.ndarray, at_byte: np.ndarray) -> np.ndarray:
        """Chunk ids with every join repaired: the text around it is encoded anew, from a place where the left chunk's
        tokens agree with firm boundaries to one where the right chunk's do."""
        out, done, i = [], 0, 0  # done: code points whose ids are in out; chunk i holds the next one
        while i < len(chunks):
            start, end = edges[i], edges[i + 1]
            ids, ends = chunks[i]
            if i == len(chunks) - 1:
                out.append(ids[self._index(ends, at_byte[done] - at_byte[start]) :])
                break
            # the last firm place of this chunk that is a token boundary too; none: all of it is encoded anew
            k, low, keep = int(np.searchsorted(firm, end, "right")) - 1, done, self._index(ends, at_byte[done] - at_byte[start])
            first = keep
            while k >= 0 and firm[k] > done:
                place = self._index(ends, at_byte[firm[k]] - at_byte[start])
                if place is not None and firm[k] <= end:
                    low, keep = int(firm[k]), place
                    break
                k -= 1
            out.append(ids[first:keep])
            # forward to the first firm place at which a later chunk's tokens agree, or the end of the text
            k, j, high, place = int(np.searchsorted(firm, end, "left")), i + 1, len(text), None
            while k < len(firm):
                while edges[j + 1] <= firm[k] and j + 1 < len(chunks):
                    j += 1
                place = self._index(chunks[j][1], at_byte[firm[k]] - at_byte[edges[j]])
                if place is not None:
                    high = int(firm[k])
                    break
                k += 1
            if low < high:
                out.append(np.array(self._encode(text[low:high]), np.int32))
            if place is None:
                break
            done, i = high, j
        return np.concatenate(out) if out else np.zeros(0, np.int32)

    @staticmethod
    def _index(ends: np.ndarray, byte: int) -> int | None:
        """Tokens of a chunk that end by a byte of it, if one ends just there."""
        if byte == 0:
            return 0
        k = int(np.searchsorted(ends, byte))
        return k + 1 if k < len(ends) and ends[k] == byte else None


@cache
def encoder(path: str = VOCABULARY) -> Encoder:
    """The encoder of this Python worker."""
    return Encoder(path)


def encode_documents(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id and ids (array of int) of every document, one row each; null and empty texts give an empty array.

    No shuffle: each worker encodes a chunk once, however many of its documents share it, and memory of chunks is bounded.
    Only doc_id and text are read, so other columns can't clash; repeated doc_id come out as often as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            ids = [own.encode(t) for t in batch.column(1).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            values = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            arrays = [batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "ids"])

    key = documents.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", key), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return documents.select("doc_id", "text").mapInArrow(run, schema)


def token_counts(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id and n_tokens (0 for null and empty texts) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            sizes = pa.array([len(own.encode(t)) for t in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes], names=["doc_id", "n_tokens"])

    key = documents.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", key), T.StructField("n_tokens", T.LongType())])
    return documents.select("doc_id", "text").mapInArrow(run, schema)
