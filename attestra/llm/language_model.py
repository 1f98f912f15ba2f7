"""N-gram language model in an Elias-Fano trie, counted from the corpus and searched through memory-mapped levels.

The trie is cut into shards by the first word. Level 1 of a shard lists its words; level k lists, for every entry of level
k - 1, the words that follow it. A following word is named by its rank among the followers of the shorter context (that
is without the first word), so its numbers are small. Starts of the followers and the followers themselves are monotone
sequences.
"""

from __future__ import annotations

import ctypes
import re
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from functools import wraps
from typing import Any, NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestra.llm.elias_fano import EliasFano, make_folder, pack, read_arrays, unpack, write_arrays
from attestra.llm.rows import only
from attestra.session import shared_folder

#: Documents whose remainder this is are held out of training.
FOLDS, HELD_OUT = 7, 2
#: Logarithms on their way to a shard are whole numbers of this part of a decade, of so many bits.
FINE, FINE_BITS = 128, 11
#: How many low bits a context's followers have; one value says that it has no followers.
SHIFT_BITS, NO_FOLLOWERS = 6, 63
#: The shards' files of a level lie in so many folders.
FOLDERS = 1000

SPACE = re.compile(rb"[\x20\x09-\x0D]")
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True

#: Words are known by 96 bits of a hash. Short ones are hashed many at a time: two sums over a word's bytes, in which a byte counts a random
#: number times a power of another for its place. Longer words have a hash function of their own.
SHORT = 64
_RANDOM = np.random.default_rng(2001).integers(1, 1 << 63, (2, 257), np.uint64) * np.uint64(2) + np.uint64(1)
BYTES = _RANDOM[:, :256]
PLACES = np.cumprod(np.repeat(_RANDOM[:, 256:], SHORT, axis=1), axis=1)


@contextmanager
def _keeping_memory() -> Iterator[None]:
    """While a task makes and frees arrays all the time, it keeps their memory; at its end the system gets it back.

    Sessions tell the C library to map large blocks one by one (``session.prepare``); here that would cost as much as the work itself.
    """
    try:
        library = ctypes.CDLL(None)
        set_option, trim = library.mallopt, library.malloc_trim
    except (OSError, AttributeError):
        yield
        return
    set_option(MMAP_THRESHOLD, 32 << 20)
    set_option(TRIM_THRESHOLD, 256 << 20)
    try:
        yield
    finally:
        set_option(MMAP_THRESHOLD, 1 << 20)
        set_option(TRIM_THRESHOLD, 1 << 20)
        trim(0)


def _in_kept_memory(run: Callable) -> Callable:
    """A task's generator that runs in kept memory."""
    @wraps(run)
    def kept(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _keeping_memory():
            yield from run(batches)

    return kept


class Words(NamedTuple):
    key: np.ndarray
    check: np.ndarray


def _whole(word: bytes) -> tuple[int, int]:
    digest = xxhash.xxh3_128_digest(word)
    return int.from_bytes(digest[:8], "big"), int.from_bytes(digest[8:12], "big")


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def words_of(text: bytes) -> tuple[Words, np.ndarray]:
    """The words of a text and where they start. ASCII letters are lower-cased, and only ASCII blanks part words."""
    lower = text.lower()
    letters = np.frombuffer(lower, np.uint8)
    inner = ~BLANK[letters]
    edge = np.flatnonzero(inner[1:] != inner[:-1]) + 1
    if len(letters) and inner[0]:
        edge = np.concatenate([[0], edge])
    if len(letters) and inner[-1]:
        edge = np.concatenate([edge, [len(letters)]])
    starts, sizes = edge[::2], edge[1::2] - edge[::2]
    if not len(starts):
        return Words(np.zeros(0, np.uint64), np.zeros(0, np.uint32)), starts
    letters = letters[inner]
    first = np.cumsum(sizes) - sizes
    place = np.minimum(np.arange(len(letters), dtype=np.int32) - np.repeat(first.astype(np.int32), sizes), SHORT - 1)
    key, check = (_mixed(np.add.reduceat(BYTES[i][letters] * PLACES[i][place], first)) for i in (0, 1))
    check = (check >> np.uint64(32)).astype(np.uint32)
    for i in np.flatnonzero(sizes > SHORT):
        key[i], check[i] = _whole(lower[starts[i] : starts[i] + sizes[i]])
    return Words(key, check), starts


#: Fixed values of the C library.
TRIM_THRESHOLD, MMAP_THRESHOLD = -1, -3

#: What stands before the first and after the last word. Words hold no blanks.
START, END = (Words(np.array([k], np.uint64), np.array([c], np.uint32)) for k, c in (_whole(b"  "), _whole(b" ")))

#: What blocks send to the shards: counted words, and counted n-grams of a level as a monotone sequence.
_WORDS = {"shard": pa.int64(), "key": pa.binary(), "check": pa.binary(), "counts": pa.binary(), "more": pa.binary()}
_FOLLOWERS = {
    "file": pa.int64(), "bits": pa.int64(), "n": pa.int64(), "width": pa.int64(), "low": pa.binary(), "high": pa.binary(),
    "counts": pa.binary(), "more": pa.binary(), "code": pa.binary(),
}


def _ddl(kinds: dict[str, pa.DataType]) -> str:
    return ", ".join(f"{name} {'bigint' if kind == pa.int64() else 'binary'}" for name, kind in kinds.items())


def _batch(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds))


class Settings(NamedTuple):
    order: int = 3
    #: How many occurrences the shorter context's distribution counts for, from level 2 on.
    strengths: tuple[float, ...] = (1000.0, 5.0)
    #: Bytes of text for each shard of the trie.
    shard_bytes: int = 16 << 20
    #: Tokens that are looked up together, and the bytes of a text that are cut into words at a time.
    block: int = 1 << 20
    span: int = 1 << 20
    #: Followers of a context that occurs more often are dealt over several files, at most 2 ** parts - 1.
    split: int = 1 << 21
    parts: int = 16
    #: Probabilities are stored as one of 2 ** probability_bits levels.
    probability_bits: int = 10

    def strength(self, depth: int) -> float:
        return self.strengths[min(depth - 2, len(self.strengths) - 1)]


class Model(NamedTuple):
    settings: Settings
    folder: str
    shards: int
    n_tokens: int
    n_words: int

    def path(self, level: int, file: int) -> str:
        shard = file >> self.settings.parts * (level - 1)
        return f"{self.folder}/level{level}/{shard % FOLDERS}/{file}"


def is_held_out(key: Any) -> bool:
    return zlib.crc32(_name(key).encode()) % FOLDS == HELD_OUT


def _name(key: Any) -> str:
    return "null" if key is None else str(key)


# -- blocks of tokens ------------------------------------------------------------------------------------


class Block:
    """Tokens of several texts, or of a part of one, as numbers of the block's own vocabulary.

    Every segment starts with the tokens before it: the start mark, or the end of the part before.
    """

    def __init__(self) -> None:
        self.parts: list[Words] = []
        self.sizes: list[int] = []
        self.before: list[int] = []
        self.opened: list[bool] = []
        self.closed: list[bool] = []
        self.size = 0

    def begin(self, history: Words, opened: bool) -> None:
        self.sizes.append(0)
        self.before.append(len(history.key))
        self.opened.append(opened)
        self.closed.append(False)
        self.add(history)

    def add(self, words: Words) -> None:
        self.parts.append(words)
        self.sizes[-1] += len(words.key)
        self.size += len(words.key)

    def end(self) -> None:
        self.add(END)
        self.closed[-1] = True

    def last(self, n: int) -> Words:
        """The last words of the open segment."""
        n = min(n, self.sizes[-1])
        return Words(*(np.concatenate(c)[-n:] for c in zip(*self.parts, strict=True)))

    def freeze(self) -> None:
        key, check = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        self.parts = []
        self.tokens, keys = pd.factorize(key)
        checks = np.empty(len(keys), np.uint32)
        checks[self.tokens] = check
        if (checks[self.tokens] != check).any():  # words that share a key
            both = np.rec.fromarrays([key, check], names="key,check")
            pairs, self.tokens = np.unique(both, return_inverse=True)
            keys, checks = pairs["key"], pairs["check"]
        self.words = Words(keys, checks)
        sizes = np.array(self.sizes)
        self.segment = np.repeat(np.arange(len(sizes)), sizes)
        #: How many tokens of its segment lie before each token.
        self.depth = np.arange(len(self.tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.fresh = self.depth >= np.repeat(np.array(self.before), sizes)


def _pieces(body: bytes, span: int) -> Iterator[bytes]:
    """A long text in pieces that end between words."""
    low = 0
    while low < len(body):
        cut = SPACE.search(body, low + span) if low + span < len(body) else None
        high = cut.start() if cut else len(body)
        yield body[low:high]
        low = high


def _together(texts: Iterable[bytes | None], span: int) -> Iterator[list[bytes]]:
    """Short texts in lists of about a span, each long one in a list of its own."""
    held, size = [], 0
    for body in texts:
        body = body or b""
        held.append(body)
        size += len(body) + 1
        if size >= span:
            yield held
            held, size = [], 0
    if held:
        yield held


def blocks(texts: Iterable[bytes | None], settings: Settings) -> Iterator[Block]:
    """Blocks of about ``settings.block`` tokens; a text's segments lie in one block or in consecutive ones."""
    block = Block()
    for bodies in _together(texts, settings.span):
        *short, last = bodies
        words, starts = words_of(b"\n".join(short))
        ends = np.searchsorted(starts, np.cumsum([len(body) + 1 for body in short])).tolist()
        for low, high in zip([0, *ends], ends):
            block.begin(START, True)
            block.add(Words(words.key[low:high], words.check[low:high]))
            block.end()
            if block.size >= settings.block:
                yield block
                block = Block()
        block.begin(START, True)
        for piece in _pieces(last, settings.span):
            block.add(words_of(piece)[0])
            if block.size >= settings.block:
                history = block.last(settings.order - 1)
                yield block
                block = Block()
                block.begin(history, False)
        block.end()
        if block.size >= settings.block:
            yield block
            block = Block()
    if block.size:
        yield block


def _batches(batches: Iterable[pa.RecordBatch], training: bool) -> Iterator[tuple[Any, bytes | None]]:
    for batch in batches:
        for key, body in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            if not training or not is_held_out(key):
                yield key, body


def _training_blocks(batches: Iterable[pa.RecordBatch], settings: Settings) -> Iterator[Block]:
    for block in blocks((body for _, body in _batches(batches, True)), settings):
        block.freeze()
        yield block


# -- level 1: words -----------------------------------------------------------------------------------------


def _shard_slices(where: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """``(value, rows)`` for every distinct value."""
    order = np.argsort(where, kind="stable")
    values, starts = np.unique(where[order], return_index=True)
    for value, rows in zip(values.tolist(), np.split(order, starts[1:]), strict=True):
        yield value, rows


def _count_words(docs: DataFrame, model: Model) -> Model:
    """Write level 1 and return the model with its totals."""
    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _training_blocks(batches, model.settings):
            counted = block.fresh | ((block.depth == 0) & np.repeat(np.array(block.opened), block.sizes))
            n = np.bincount(block.tokens[counted], minlength=len(block.words.key))
            used = np.flatnonzero(n)
            key, check, n = block.words.key[used], block.words.check[used], n[used]
            shard = (key % np.uint64(model.shards)).astype(np.int64)
            yield _batch([
                (number, key[at].astype("<u8").tobytes(), check[at].astype("<u4").tobytes(), *_short_counts(n[at]))
                for number, at in _shard_slices(shard)
            ], _WORDS)

    def write(rows: pd.DataFrame) -> pd.DataFrame:
        key = np.concatenate([np.frombuffer(r, "<u8") for r in rows["key"]])
        check = np.concatenate([np.frombuffer(r, "<u4") for r in rows["check"]])
        n = np.concatenate([_long_counts(a, b) for a, b in zip(rows["counts"], rows["more"], strict=True)])
        order_ = np.lexsort((check, key))
        key, check, n = key[order_], check[order_], n[order_]
        first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (check[1:] != check[:-1])]))
        n = np.add.reduceat(n, first)
        key, check = key[first], check[first]
        shard = int(rows["shard"].iloc[0])
        write_arrays(model.path(1, shard), {"key": key, "check": check, **_counts("count", n)})
        real = ~((key == START.key) & (check == START.check))
        return pd.DataFrame({"words": [int(real.sum())], "tokens": [int(n[real].sum())]})

    found = docs.mapInArrow(_in_kept_memory(emit), _ddl(_WORDS))
    found = found.groupBy("shard").applyInPandas(write, "words long, tokens long")
    total = found.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t"), F.coalesce(F.sum("words"), F.lit(0)).alias("w")).collect()[0]
    return model._replace(n_tokens=total.t, n_words=total.w)


def _short_counts(n: np.ndarray) -> tuple[bytes, bytes]:
    """Counts as bytes, and those of 255 and more once again as longs."""
    return np.minimum(n, 255).astype(np.uint8).tobytes(), n[n >= 255].astype("<i8").tobytes()


def _long_counts(low: bytes, high: bytes) -> np.ndarray:
    n = np.frombuffer(low, np.uint8).astype(np.int64)
    n[n == 255] = np.frombuffer(high, "<i8")
    return n


def _counts(name: str, n: np.ndarray) -> dict[str, np.ndarray]:
    """Counts as ranks among the file's distinct counts, packed."""
    values, ranks = np.unique(n, return_inverse=True)
    width = max(len(values) - 1, 0).bit_length()
    return {f"{name}.values": values.astype(np.int64), f"{name}.ranks": pack(ranks, width)}


def _count_at(arrays: dict[str, np.ndarray], name: str, at: np.ndarray) -> np.ndarray:
    values = arrays[f"{name}.values"]
    return values[unpack(arrays[f"{name}.ranks"], max(len(values) - 1, 0).bit_length(), at)]


def word_counts(model: Model, number: np.ndarray) -> np.ndarray:
    """How often the words of these numbers occur."""
    n = np.zeros(len(number), np.int64)
    for shard, rows in _shard_slices(number % model.shards):
        n[rows] = _count_at(read_arrays(model.path(1, shard)), "count", number[rows] // model.shards)
    return n


class Level(NamedTuple):
    """For each token of a block: the entry of the n-gram that ends there, and the token's probability.

    ``file`` is -1 where the n-gram is not in the model. ``rank`` tells the token among the followers of its context.
    """

    file: np.ndarray
    at: np.ndarray
    rank: np.ndarray
    count: np.ndarray
    log10: np.ndarray


def word_level(model: Model, block: Block) -> Level:
    key, check = block.words
    shard = (key % np.uint64(model.shards)).astype(np.int64)
    at, n = np.full(len(key), -1), np.zeros(len(key), np.int64)
    for number, rows in _shard_slices(shard):
        arrays = read_arrays(model.path(1, number))
        if arrays is None:
            continue
        rows = rows[np.argsort(key[rows], kind="stable")]
        known, wanted = arrays["key"], key[rows]
        place = np.searchsorted(known, wanted)
        # keys that several words share are told apart by the check
        while True:
            near = np.minimum(place, len(known) - 1)
            next_ = (place < len(known)) & (known[near] == wanted) & (arrays["check"][near] < check[rows])
            if not next_.any():
                break
            place = place + next_
        hit = (place < len(known)) & (known[near] == wanted) & (arrays["check"][near] == check[rows])
        at[rows[hit]] = place[hit]
        n[rows[hit]] = _count_at(arrays, "count", place[hit])
    log10 = np.log10((n + 1) / (model.n_tokens + model.n_words + 1))
    return Level(*(v[block.tokens] for v in (np.where(at < 0, -1, shard), at, at * model.shards + shard, n, log10)))


# -- deeper levels ------------------------------------------------------------------------------------------


class Followers(NamedTuple):
    """N-grams of a block that may be in the next level, each once: ``inverse`` leads from tokens to them."""

    tokens: np.ndarray
    inverse: np.ndarray
    file: np.ndarray
    parent: np.ndarray
    rank: np.ndarray
    first: np.ndarray  # a token of each


def _parts(n: np.ndarray, settings: Settings) -> np.ndarray:
    """Over how many files the followers of a context are dealt, by its count."""
    parts = np.ones(len(n), np.int64)
    large = np.flatnonzero(n > settings.split)
    parts[large] = np.minimum(-(-n[large] // settings.split), (1 << settings.parts) - 1)
    return parts


def followers(level: Level, tokens: np.ndarray, settings: Settings) -> Followers:
    parent = tokens - 1
    rank, parts = level.rank[tokens], _parts(level.count[parent], settings)
    file = level.file[parent] << settings.parts
    dealt = np.flatnonzero(parts > 1)
    file[dealt] |= 1 + rank[dealt] % parts[dealt]
    rank[dealt] //= parts[dealt]
    number, names = pd.factorize(file)
    bits = [max(int(c.max()) if len(c) else 0, 1).bit_length() for c in (number, level.at[parent], rank)]
    if sum(bits) < 64:
        key = (number << (bits[1] + bits[2])) | (level.at[parent] << bits[2]) | rank
        order = np.argsort(key)
        key = key[order]
        new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    else:
        order = np.lexsort((rank, level.at[parent], number))
        columns = np.stack([number, level.at[parent], rank])[:, order]
        new = np.concatenate([[True], (columns[:, 1:] != columns[:, :-1]).any(axis=0)])
    first = order[new]
    inverse = np.empty(len(order), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return Followers(tokens, inverse, file[first], level.at[parent][first], rank[first], tokens[first])


def _follower(file: np.ndarray | int, rank: np.ndarray, n: np.ndarray, settings: Settings) -> np.ndarray:
    """A follower's rank among all of its context's, from its rank in its file; ``n`` is the context's count."""
    parts = _parts(n, settings)
    return np.where(parts > 1, rank * parts + (file & ((1 << settings.parts) - 1)) - 1, rank)


def _with_followers(block: Block, level: Level, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens whose context is an entry of the level, and those of them whose shorter n-gram is one too."""
    here = level.file >= 0
    known = block.depth >= depth
    known[1:] &= here[:-1]
    return np.flatnonzero(known), np.flatnonzero(known & here)


def _each_once(at: np.ndarray, *look_up: Callable[[np.ndarray], np.ndarray]) -> list[np.ndarray]:
    """What is found at sorted positions; repeated positions are looked up once."""
    new = np.concatenate([[True], at[1:] != at[:-1]]) if len(at) else np.zeros(0, bool)
    heads, inverse = at[new], np.cumsum(new) - 1
    return [found(heads)[inverse] for found in look_up]


def next_level(model: Model, block: Block, level: Level, depth: int) -> Level:
    """Level ``depth`` from the one before it: the longer n-gram where the trie has it, else the shorter one at a discount."""
    settings, last = model.settings, depth == model.settings.order
    known, tokens = _with_followers(block, level, depth - 1)
    log10 = level.log10.copy()
    weight = settings.strength(depth)
    log10[known] += np.log10(weight / (level.count[known - 1] + weight))
    wanted = followers(level, tokens, settings)
    size = len(wanted.file)
    file, at, rank, n, found = np.full(size, -1), np.full(size, -1), np.full(size, -1), np.zeros(size, np.int64), np.zeros(size)
    cuts = np.flatnonzero(wanted.file[1:] != wanted.file[:-1]) + 1
    for rows in np.split(np.arange(size), cuts) if size else ():
        number = int(wanted.file[rows[0]])
        arrays = read_arrays(model.path(depth, number))
        if arrays is None:
            continue
        limit, = arrays["limit"].tolist()
        rows = rows[wanted.rank[rows] < limit]
        bucket, shift = _each_once(wanted.parent[rows], EliasFano.from_arrays(arrays, "base").get, lambda at: unpack(arrays["shift"], SHIFT_BITS, at))
        rows, bucket, shift = rows[shift < NO_FOLLOWERS], bucket[shift < NO_FOLLOWERS], shift[shift < NO_FOLLOWERS]
        rank_ = wanted.rank[rows]
        place, hit = EliasFano.from_arrays(arrays, "follower").successors_in(bucket + (rank_ >> shift), rank_ & ((1 << shift) - 1))
        rows, place = rows[hit], place[hit]
        file[rows], at[rows] = number, place
        found[rows] = arrays["log10"][unpack(arrays["code"], settings.probability_bits, place)]
        if not last:
            n[rows] = _count_at(arrays, "count", place)
            rank[rows] = place - _each_once(wanted.parent[rows], EliasFano.from_arrays(arrays, "start").get)[0]
    if not last:  # ranks in several files of one context
        rank = _follower(wanted.file, rank, level.count[wanted.first - 1], settings)
    hit = file[wanted.inverse] >= 0
    to, of = tokens[hit], wanted.inverse[hit]
    if last:
        log10[to] = found[of]
        return level._replace(log10=log10)
    out = Level(*(np.full(len(block.tokens), fill) for fill in (-1, -1, -1, 0)), log10)
    out.file[to], out.at[to], out.rank[to], out.count[to], log10[to] = file[of], at[of], rank[of], n[of], found[of]
    return out


def _count_followers(docs: DataFrame, model: Model, depth: int) -> None:
    """Count the n-grams of a level and write its files."""
    settings = model.settings

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _training_blocks(batches, settings):
            level = word_level(model, block)
            for d in range(2, depth):
                level = next_level(model, block, level, d)
            _, tokens = _with_followers(block, level, depth - 1)
            found = followers(level, tokens[block.fresh[tokens]], settings)
            n = np.bincount(found.inverse, minlength=len(found.file))
            codes = np.minimum(np.round(-FINE * level.log10[found.first]), (1 << FINE_BITS) - 1).astype(np.int64)
            out: list[tuple] = []
            cuts = np.flatnonzero(found.file[1:] != found.file[:-1]) + 1
            for rows in np.split(np.arange(len(n)), cuts) if len(n) else ():
                bits = int(found.rank[rows].max()).bit_length()
                keys = EliasFano.of((found.parent[rows] << bits) | found.rank[rows])
                out.append((
                    int(found.file[rows[0]]), bits, keys.n, keys.width, keys.low.tobytes(), keys.high.tobytes(),
                    *_short_counts(n[rows]), pack(codes[rows], FINE_BITS).tobytes() if depth > 2 else b"",
                ))
            yield _batch(out, _FOLLOWERS)

    def write(rows: pd.DataFrame) -> pd.DataFrame:
        file = int(rows["file"].iloc[0])
        above = read_arrays(model.path(depth - 1, file >> settings.parts))
        keys = []
        top = int(rows["bits"].max())
        for r in rows.itertuples():
            key = EliasFano(r.n, r.width, np.frombuffer(r.low, "<u8"), np.frombuffer(r.high, "<u8"), np.zeros(0)).all()
            keys.append(((key >> r.bits) << top) | (key & ((1 << r.bits) - 1)))
        key = np.concatenate(keys)
        n = np.concatenate([_long_counts(a, b) for a, b in zip(rows["counts"], rows["more"], strict=True)])
        order_ = np.argsort(key)
        key, n = key[order_], n[order_]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        key, n = key[first], np.add.reduceat(n, first)
        parent, rank = key >> top, key & ((1 << top) - 1)
        if depth > 2:
            codes = [unpack(np.frombuffer(c, "<u8"), FINE_BITS, np.arange(m)) for c, m in zip(rows["code"], rows["n"], strict=True)]
            shorter = 10.0 ** (np.concatenate(codes)[order_][first] / -FINE)
        else:
            shorter = (word_counts(model, _follower(file, rank, _count_at(above, "count", parent), settings)) + 1) / (
                model.n_tokens + model.n_words + 1)
        n_parents = len(above["key"]) if depth == 2 else int(above["follower.shape"][0])
        start = np.searchsorted(parent, np.arange(n_parents + 1))
        # A context with n followers has between n and 2 n buckets for them, so buckets are small also where contexts differ in size.
        size, limit = np.diff(start), int(rank.max()) + 1
        shift = np.maximum(np.floor(np.log2(limit / np.maximum(size, 1))), 0).astype(np.int64)
        base = np.concatenate([[0], np.cumsum(np.where(size > 0, (limit - 1 >> shift) + 1, 0))[:-1]])
        of = shift[parent]
        follower = EliasFano.of_parts(base[parent] + (rank >> of), rank & ((1 << of) - 1), int(of.max()))
        weight, total = settings.strength(depth), _count_at(above, "count", parent)
        p = (n + weight * shorter) / (total + weight)
        write_arrays(
            model.path(depth, file),
            {"limit": np.array([limit]), **EliasFano.of(base).arrays("base"), **follower.arrays("follower"),
             "shift": pack(np.where(size > 0, shift, NO_FOLLOWERS), SHIFT_BITS), **_probabilities(p, settings.probability_bits),
             **({} if depth == settings.order else EliasFano.of(start).arrays("start") | _counts("count", n))},
        )
        return pd.DataFrame({"entries": [len(n)]})

    docs.mapInArrow(_in_kept_memory(emit), _ddl(_FOLLOWERS)).groupBy("file").applyInPandas(write, "entries long").agg(F.sum("entries")).collect()


def _probabilities(p: np.ndarray, bits: int) -> dict[str, np.ndarray]:
    """Probabilities as levels of equal ratio; a level stands for the mean of those it holds."""
    log10 = np.log10(p)
    low, high = log10.min(), log10.max()
    size = (1 << bits) - 1
    code = np.round((log10 - low) / max(high - low, 1e-9) * size).astype(np.int64)
    n = np.bincount(code, minlength=size + 1)
    mean = np.bincount(code, p, minlength=size + 1) / np.maximum(n, 1)
    return {"log10": np.log10(np.where(n, mean, 1.0)), "code": pack(code, bits)}


# -- the model as a whole -------------------------------------------------------------------------------------


def _columns(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    return only(docs, id_column, text).toDF("id", "text")


def train(docs: DataFrame, id_column: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> Model:
    """Count all n-grams up to ``settings.order`` of the documents that are not held out, and write the trie level by level.

    Each level is counted in one pass: a task counts the n-grams of a block of tokens, and their shard merges the blocks' counts,
    smooths them (a context's distribution is drawn towards the shorter context's, the more so the less often it
    occurs) and writes its file to the shared folder. No n-gram is left out. A file holds about as many tokens as
    ``settings.shard_bytes`` of text; the followers of a more frequent context are dealt over several files, which needs
    no total of their own as it is the context's count. Files have fixed names and contents, so a task may run again.
    """
    rows = _columns(docs, id_column, text)
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).collect()[0][0]
    shards, order = max(1, -(-size // settings.shard_bytes)), settings.order
    if shards.bit_length() + settings.parts * (order - 1) > 62:
        raise ValueError(f"order {order} is too high for {shards} shards")
    folder = f"{shared_folder(docs.sparkSession)}/language-model-{uuid.uuid4().hex}"
    for level in range(1, order + 1):
        for part in range(min(FOLDERS, shards)):
            make_folder(f"{folder}/level{level}/{part}")
    model = _count_words(rows, Model(settings, folder, shards, 0, 0))
    for depth in range(2, order + 1):
        _count_followers(rows, model, depth)
    return model


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` per row, of whole texts.

    A text is its words and one end. ``base_score`` sums log10 (c + 1) / (N + V + 1) of its tokens; ``score`` the model's log10
    probabilities. A null text counts as empty and a null id as ``null``. Repeated rows are scored alike, and a very
    long text in parts that know the tokens before them. Other columns are not read; nothing is shuffled. A block's
    distinct n-grams are looked up file by file in sorted order, each at most once.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[Any] = []
        kinds: list[pa.DataType] = []

        def texts() -> Iterator[bytes | None]:
            for batch in batches:
                kinds[:] = [batch.column(0).type]
                for key, body in _batches([batch], False):
                    keys.append(key)
                    yield body

        carried = np.zeros(4)
        for block in blocks(texts(), model.settings):
            block.freeze()
            level = word_level(model, block)
            fresh, where = block.fresh, block.segment[block.fresh]
            size = len(block.sizes)
            sums = [np.bincount(where, minlength=size), np.bincount(where, level.count[fresh] > 0, minlength=size),
                    np.bincount(where, level.log10[fresh], minlength=size)]
            for depth in range(2, model.settings.order + 1):
                level = next_level(model, block, level, depth)
            sums = np.stack([*sums, np.bincount(where, level.log10[fresh], minlength=size)])
            sums[:, 0] += carried
            carried = np.zeros(4) if block.closed[-1] else sums[:, -1].copy()
            done = np.flatnonzero(block.closed)
            ids, keys[: len(done)] = keys[: len(done)], []
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, kinds[0]), pa.array([is_held_out(k) for k in ids], pa.bool_()), pa.array(sums[0, done].astype(np.int64)),
                 pa.array(sums[1, done].astype(np.int64)), pa.array([model.n_tokens] * len(done), pa.int64()),
                 pa.array(sums[2, done]), pa.array(sums[3, done])],
                names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    rows = _columns(docs, id_column, text)
    schema = T.StructType([
        rows.schema["id"], T.StructField("held_out", T.BooleanType()), *[T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")],
        *[T.StructField(c, T.DoubleType()) for c in ("base_score", "score")],
    ])
    return rows.mapInArrow(_in_kept_memory(run), schema).withColumnRenamed("id", id_column)

