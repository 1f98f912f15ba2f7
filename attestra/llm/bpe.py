"""Byte-level BPE with forced boundaries: encoding and decoding."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm.rows import only

#: The byte-level alphabet's printable ranges, and the pre-tokenizer's pattern.
PRINTABLE = ((0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF))
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same on texts of ASCII characters alone, for the standard library's engine, which is faster.
ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)
#: Characters of text whose new words are encoded together.
TOGETHER = 1 << 20
#: Encoded pre-tokens that a worker remembers. It saves work and changes no result.
REMEMBERED = 1 << 16
#: Fragments up to this length are merged without a heap.
SHORT, NO_MERGE = 32, 1 << 30
#: Ids are below 1 << ID_BITS.
ID_BITS, GONE = 24, -1


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary file."""
    plain = [b for low, high in PRINTABLE for b in range(low, high + 1)]
    rest = sorted(set(range(256)) - set(plain))
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tables of one byte-level BPE file: ids, merge ranks, and the byte pairs that no token holds."""

    def __init__(self, file_text: str):
        spec = json.loads(file_text)
        to_byte = byte_alphabet()
        self.id_of = {bytes(to_byte[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        #: Merge ranks by pair of ids, the left one in the high bits; and the id that each rank gives.
        self.rank: dict[int, int] = {}
        self.merged: list[int] = []
        for r, merge in enumerate(spec["model"]["merges"]):
            left, right = (bytes(to_byte[c] for c in part) for part in (merge if isinstance(merge, list) else merge.split(" ")))
            self.rank[self.id_of[left] << ID_BITS | self.id_of[right]] = r
            self.merged.append(self.id_of[left + right])
        self.of_byte = [self.id_of[bytes([b])] for b in range(256)]
        self.bytes_of: dict[int, bytes] = {i: token for token, i in self.id_of.items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of.update({i: content.encode() for content, i in self.added.items()})
        #: inside[a * 256 + b] is 1 if some token has byte b right after byte a.
        inside = bytearray(1 << 16)
        for token in self.id_of:
            for a, b in zip(token, token[1:], strict=False):
                inside[a << 8 | b] = 1
        self.inside = bytes(inside)
        #: The same tables as arrays, for many fragments at a time; pairs are sorted.
        self._inside = np.frombuffer(self.inside, np.uint8).astype(bool)
        self._of_byte = np.array(self.of_byte, np.int64)
        self._merged = np.array(self.merged, np.int64)
        pairs = np.fromiter(self.rank, np.int64, len(self.rank))
        order = np.argsort(pairs)
        self._pairs, self._ranks = pairs[order], np.fromiter(self.rank.values(), np.int64, len(self.rank))[order]

    def fragments(self, word: bytes) -> Iterator[bytes]:
        """Cut at every byte pair that occurs inside no token: no merge can ever cross it."""
        start, inside = 0, self.inside
        for i in range(1, len(word)):
            if not inside[word[i - 1] << 8 | word[i]]:
                yield word[start:i]
                start = i
        yield word[start:]

    def ids_of_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word, which has one character at least: all words are cut and merged together, fragments of a length at a time."""
        data = [word.encode() for word in words]
        text = np.frombuffer(b"".join(data), np.uint8)
        ends = np.cumsum([len(d) for d in data])
        starts = np.concatenate([[0], ends[:-1]])
        new = np.ones(len(text), bool)
        new[1:] = ~self._inside[text[:-1].astype(np.int64) << 8 | text[1:]]
        new[starts] = True
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(text)))
        part = self._of_byte[text]
        for n in np.unique(size).tolist():
            if 1 < n <= SHORT:
                at = first[size == n][:, None] + np.arange(n)
                part[at] = self._merge_many(part[at])
        for low, n in zip(first[size > SHORT].tolist(), size[size > SHORT].tolist(), strict=True):
            ids = self.merge(text[low : low + n].tobytes())
            part[low : low + n] = ids + [GONE] * (n - len(ids))
        kept = part != GONE
        cuts = np.concatenate([[0], 4 * np.cumsum(np.add.reduceat(kept, starts, dtype=np.int64))]).tolist()
        out = part[kept].astype("<u4").tobytes()
        return [out[low:high] for low, high in pairwise(cuts)]

    def _rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = left << ID_BITS | right
        if not len(self._pairs):
            return np.full(pair.shape, NO_MERGE)
        at = np.minimum(np.searchsorted(self._pairs, pair), len(self._pairs) - 1)
        return np.where(self._pairs[at] == pair, self._ranks[at], NO_MERGE)

    def _merge_many(self, part: np.ndarray) -> np.ndarray:
        """``merge`` of fragments of one length, a row of byte ids each; what is merged away is GONE, at the end of the row."""
        out = np.full(part.shape, GONE)
        where, ranks = np.arange(len(part)), self._rank_of(part[:, :-1], part[:, 1:])
        while ranks.shape[1]:
            at = ranks.argmin(axis=1)  # the leftmost of the least
            least = ranks[np.arange(len(part)), at]
            live = least < NO_MERGE
            if not live.all():
                out[where[~live], : part.shape[1]] = part[~live]
                where, part, ranks, at, least = where[live], part[live], ranks[live], at[live], least[live]
            row, width = np.arange(len(part)), part.shape[1]
            part[row, at] = new = self._merged[least]
            keep = np.ones(part.shape, bool)
            keep[row, at + 1] = False
            part = part[keep].reshape(len(row), width - 1)
            keep = np.ones(ranks.shape, bool)
            keep[row, at] = False
            ranks = ranks[keep].reshape(len(row), width - 2)
            to = np.flatnonzero(at < width - 2)
            ranks[to, at[to]] = self._rank_of(new[to], part[to, at[to] + 1])
            to = np.flatnonzero(at > 0)
            ranks[to, at[to] - 1] = self._rank_of(part[to, at[to] - 1], new[to])
        out[where, : part.shape[1]] = part
        return out

    def merge(self, fragment: bytes) -> list[int]:
        """Ids of one fragment: the lowest-ranked pair is merged first, the leftmost on a tie.

        In a long fragment the pairs wait in a heap and the parts are a linked list, which costs n log n.
        """
        if len(fragment) <= SHORT:
            return self._merge_short(fragment)
        part = [self.of_byte[b] for b in fragment]
        n, rank = len(part), self.rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, part[i], part[i + 1]) for i in range(n - 1) if (r := rank.get(part[i] << ID_BITS | part[i + 1])) is not None]
        heapify(heap)
        while heap:
            r, i, left, right = heappop(heap)
            j = after[i]
            if part[i] != left or j >= n or part[j] != right:
                continue  # one of them has been merged meanwhile
            part[i], part[j] = self.merged[r], GONE
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get(part[i] << ID_BITS | part[k])) is not None:
                    heappush(heap, (r, i, part[i], part[k]))
            if (h := before[i]) >= 0 and (r := rank.get(part[h] << ID_BITS | part[i])) is not None:
                heappush(heap, (r, h, part[h], part[i]))
        return [p for p in part if p != GONE]

    def _merge_short(self, fragment: bytes) -> list[int]:
        """The same by looking at all pairs each time."""
        of_byte, rank = self.of_byte, self.rank.get
        part = [of_byte[b] for b in fragment]
        ranks = [rank(a << ID_BITS | b, NO_MERGE) for a, b in pairwise(part)]
        while ranks and (least := min(ranks)) < NO_MERGE:
            i = ranks.index(least)
            part[i] = new = self.merged[least]
            del part[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank(new << ID_BITS | part[i + 1], NO_MERGE)
            if i:
                ranks[i - 1] = rank(part[i - 1] << ID_BITS | new, NO_MERGE)
        return part


class Remembered(dict):
    """Values by key. Of the keys, those asked for lately stay: when REMEMBERED are held, they become the old ones, and the old
    ones before go."""

    def __init__(self, compute: Callable[[list], list]):
        super().__init__()
        self.compute, self.old = compute, {}

    def values_of(self, keys: set) -> dict:
        """The value of each key; those that are not held are computed together."""
        found, new = {}, []
        for key in keys:
            value = self.get(key)
            if value is None:
                value = self.old.get(key)
                if value is None:
                    new.append(key)
                    continue
                self._keep(key, value)
            found[key] = value
        for key, value in zip(new, self.compute(new) if new else (), strict=True):
            self._keep(key, value)
            found[key] = value
        return found

    def _keep(self, key, value) -> None:
        if len(key) <= 64:
            if len(self) >= REMEMBERED:
                self.old = dict(self)
                self.clear()
            self[key] = value


class Codec:
    """Encodes and decodes texts; ids are little-endian unsigned 32-bit integers in one byte string."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.words = regex.compile(PATTERN)
        added = sorted(vocabulary.added, key=len, reverse=True)
        self.added = regex.compile("(" + "|".join(map(regex.escape, added)) + ")") if added else None
        self.of_words = Remembered(vocabulary.ids_of_words)

    def _cut(self, text: str) -> list[list[str] | bytes]:
        """Pre-tokens of the text between added tokens, and the ids of these."""
        out = []
        for i, part in enumerate(self.added.split(text) if self.added else (text,)):
            if i % 2:
                out.append(self.vocabulary.added[part].to_bytes(4, "little"))
            else:
                out.append((ASCII_WORDS if part.isascii() else self.words).findall(part))
        return out

    def encode(self, text: str) -> bytes:
        return next(self.encode_all([text]))

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Texts in turn; the new words of about TOGETHER characters are encoded at a time."""
        held, size = [], 0
        for text in texts:
            held.append(self._cut(text))
            size += len(text)
            if size >= TOGETHER:
                yield from self._encoded(held)
                held, size = [], 0
        yield from self._encoded(held)

    def _encoded(self, cut: list[list[list[str] | bytes]]) -> Iterator[bytes]:
        ids = self.of_words.values_of({word for parts in cut for part in parts if not isinstance(part, bytes) for word in part})
        for parts in cut:
            yield b"".join([part if isinstance(part, bytes) else b"".join(map(ids.__getitem__, part)) for part in parts])

    def decode(self, ids: bytes) -> str:
        of = self.vocabulary.bytes_of
        return b"".join(map(of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_vocabularies: dict[str, Vocabulary] = {}


def _codec(shipped: Broadcast) -> Codec:
    """A codec for one task. The worker keeps the vocabulary, but not the words that a task remembers."""
    text = shipped.value
    key = hashlib.sha256(text.encode()).hexdigest()
    if key not in _vocabularies:
        _vocabularies[key] = Vocabulary(text)
    return Codec(_vocabularies[key])


def ship(spark: SparkSession, path: str) -> Broadcast:
    """Read a vocabulary file on the driver and send it along: its size does not depend on the data."""
    with open(path, encoding="utf-8") as file:
        return spark.sparkContext.broadcast(file.read())


def encode(docs: DataFrame, path: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, n_tokens, ids)`` per row; ``ids`` are little-endian unsigned 32-bit integers.

    Whole texts, null counting as empty; an empty text has no tokens. Added tokens of the file are matched
    in the text first. A text is cut into pre-tokens, these at byte pairs that no vocabulary token holds, and
    the fragments are encoded each on its own. Rows stay where they are, repeated rows too; other columns are
    not read.
    """
    shipped = ship(docs.sparkSession, path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shipped)
        for batch in batches:
            ids = list(codec.encode_all(t or "" for t in batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                names=[id_column, "n_tokens", "ids"],
            )

    rows = only(docs, id_column, text)
    kind = rows.schema[id_column].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_column}` {kind}, n_tokens bigint, ids binary")


def decode(encoded: DataFrame, path: str, id_column: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``(id, text)`` per row of ``encode``; bytes that are not UTF-8 become replacement characters."""
    shipped = ship(encoded.sparkSession, path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shipped)
        for batch in batches:
            texts = [codec.decode(x or b"") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_column, "text"])

    rows = only(encoded, id_column, ids)
    kind = rows.schema[id_column].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_column}` {kind}, text string")


def round_trip(docs: DataFrame, path: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, n_tokens, ids, decoded)``: both directions in one pass over the rows."""
    shipped = ship(docs.sparkSession, path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shipped)
        for batch in batches:
            ids = list(codec.encode_all(t or "" for t in batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()),
                    pa.array([codec.decode(x) for x in ids], pa.string()),
                ],
                names=[id_column, "n_tokens", "ids", "decoded"],
            )

    rows = only(docs, id_column, text)
    kind = rows.schema[id_column].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_column}` {kind}, n_tokens bigint, ids binary, decoded string")


def digests(coded: DataFrame, id_column: str = "doc_id", *, keep_ids: bool = False) -> DataFrame:
    """The rows of ``round_trip`` with SHA-256 of the ids and of the decoded text."""
    return coded.select(
        id_column, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), *(["ids"] if keep_ids else []),
    )
