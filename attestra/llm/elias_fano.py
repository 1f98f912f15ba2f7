"""Elias-Fano sequences and packed arrays that are searched where they lie, in memory-mapped files."""

from __future__ import annotations

import json
import mmap
import uuid

import numpy as np
from pyarrow import fs

MAGIC = b"efseq001"
#: Numbers that are packed at a time, a multiple of 64.
CHUNK = 1 << 16
#: Numbers of a bucket that are compared one by one.
STEPS = 6


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """Whole numbers of ``width`` bits each, one after the other, in 64-bit words with a spare one behind."""
    out = np.zeros((len(values) * width + 63) // 64 + 1, "<u8")
    for low in range(0, len(values) if width else 0, CHUNK):
        part = np.ascontiguousarray(values[low : low + CHUNK], "<u8") & np.uint64((1 << width) - 1)
        shift = (np.arange(len(part)) * width & 63).astype(np.uint64)
        # The first number that starts in each word; the last one may go on in the next word.
        first = -(-64 * np.arange((len(part) * width + 63) // 64) // width)
        first = first[first < len(part)]
        last = np.append(first[1:], len(part)) - 1
        at, size = low * width // 64, len(first)
        out[at : at + size] |= np.bitwise_or.reduceat(part << shift, first)
        out[at + 1 : at + 1 + size] |= (part[last] >> np.uint64(1)) >> (np.uint64(63) - shift[last])
    return out


def unpack(words: np.ndarray, width: int, at: np.ndarray) -> np.ndarray:
    """The packed numbers at the given positions."""
    if not width:
        return np.zeros(len(at), np.int64)
    # In place: new arrays cost as much as the look-ups.
    bit = at * width
    word = bit >> 6
    bit &= 63
    shift = bit.view(np.uint64)
    value = words.take(word)
    value >>= shift
    word += 1
    high = words.take(word)
    high <<= np.uint64(1)
    high <<= np.uint64(63) - shift
    value |= high
    value &= np.uint64((1 << width) - 1)
    return value.view(np.int64)


_BYTES = np.uint64(0x0101010101010101)
_TOPS = np.uint64(0x8080808080808080)
#: Position of the set bit of a rank in a byte.
_IN_BYTE = np.array([([i for i in range(8) if byte >> i & 1] + [0] * 8)[:8] for byte in range(256)], np.int64).ravel()


def _select(word: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Position of the set bit that has ``rank`` set bits before it in its word.

    The set bits of every byte and those before it are summed in the word itself; the bytes whose sum is not above the
    rank are passed over, and a table has the position in the byte.
    """
    u = np.uint64
    sums = word - ((word >> u(1)) & u(0x5555555555555555))
    sums = (sums & u(0x3333333333333333)) + ((sums >> u(2)) & u(0x3333333333333333))
    sums = ((sums + (sums >> u(4))) & u(0x0F0F0F0F0F0F0F0F)) * _BYTES
    rank = rank.astype(u)
    shift = (((((rank * _BYTES) | _TOPS) - sums) & _TOPS) >> u(7)) * _BYTES >> u(53) & u(0x78)
    rank -= (sums << u(8)) >> shift & u(0xFF)
    return shift.astype(np.int64) + _IN_BYTE[((word >> shift & u(0xFF)) << u(3) | rank).astype(np.int64)]


class EliasFano:
    """A non-decreasing sequence of whole numbers: low bits packed, high bits in unary, and zeros counted per word."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, zeros: np.ndarray):
        self.n, self.width, self.low, self.high, self.zeros = n, width, low, high, zeros
        self._ones: np.ndarray | None = None

    @staticmethod
    def of(values: np.ndarray) -> EliasFano:
        n, limit = len(values), int(values[-1]) + 1 if len(values) else 1
        width = max(0, (limit // max(n, 1)).bit_length() - 1)
        return EliasFano.of_parts(values >> width, values & ((1 << width) - 1), width)

    @staticmethod
    def of_parts(high: np.ndarray, low: np.ndarray, width: int) -> EliasFano:
        """A sequence of numbers (bucket, rest); buckets may be of different sizes."""
        n = len(high)
        bits = np.zeros(((n + int(high[-1] if n else 0) + 1) + 63) // 64 * 64, np.uint8)
        bits[high + np.arange(n)] = 1
        words = np.packbits(bits, bitorder="little").view("<u8")
        ones = np.cumsum(np.bitwise_count(words), dtype=np.int64)
        zeros = (64 * np.arange(len(words)) - np.concatenate([[0], ones[:-1]])).astype(np.uint32 if len(bits) < 1 << 32 else np.int64)
        return EliasFano(n, width, pack(low, width), words, zeros)

    def arrays(self, name: str) -> dict[str, np.ndarray]:
        shape = np.array([self.n, self.width], np.int64)
        return {f"{name}.shape": shape, f"{name}.low": self.low, f"{name}.high": self.high, f"{name}.zeros": self.zeros}

    @staticmethod
    def from_arrays(arrays: dict[str, np.ndarray], name: str) -> EliasFano:
        n, width = arrays[f"{name}.shape"].tolist()
        return EliasFano(n, width, *(arrays[f"{name}.{part}"] for part in ("low", "high", "zeros")))

    def all(self) -> np.ndarray:
        """Every number, in one pass over the bits."""
        at = np.arange(self.n)
        high = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little")) - at
        return (high << self.width) | unpack(self.low, self.width, at)

    def get(self, at: np.ndarray) -> np.ndarray:
        """The numbers at the given positions."""
        if self._ones is None:
            self._ones = 64 * np.arange(len(self.zeros)) - self.zeros
        word = np.searchsorted(self._ones, at, "right") - 1
        high = 64 * word + _select(self.high[word], at - self._ones[word]) - at
        return (high << self.width) | unpack(self.low, self.width, at)

    def successors(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Position of the first number not below each value, and whether it equals it."""
        return self.successors_in(values >> self.width, values & ((1 << self.width) - 1))

    def successors_in(self, high: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for values given as (bucket, rest).

        A bucket starts behind a zero; its numbers are compared from there on, a few one by one and those of a large bucket by
        halving it.
        """
        n_zeros = 64 * len(self.high) - self.n
        first, equal = np.full(len(high), self.n), np.zeros(len(high), bool)
        open_ = np.flatnonzero(high < n_zeros)
        high, wanted = high[open_], wanted[open_]
        at = np.where(high > 0, self._before_zero(high - 1), 0)
        first[open_] = at
        for _ in range(STEPS):
            bit = at + high
            inside = np.flatnonzero((self.high[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1))
            open_, at, high, wanted = open_[inside], at[inside], high[inside], wanted[inside]
            low = unpack(self.low, self.width, at)
            equal[open_] = low == wanted
            below = np.flatnonzero(low < wanted)
            open_, at, high, wanted = open_[below], at[below] + 1, high[below], wanted[below]
            first[open_] = at
            if not len(open_):
                return first, equal
        end = self._before_zero(high)
        last, going = end.copy(), np.flatnonzero(at < end)
        while len(going):
            middle = (at[going] + last[going]) >> 1
            below = unpack(self.low, self.width, middle) < wanted[going]
            at[going] = np.where(below, middle + 1, at[going])
            last[going] = np.where(below, last[going], middle)
            going = going[at[going] < last[going]]
        first[open_] = at
        hit = np.flatnonzero(at < end)
        equal[open_[hit]] = unpack(self.low, self.width, at[hit]) == wanted[hit]
        return first, equal

    def _before_zero(self, zero: np.ndarray) -> np.ndarray:
        """How many numbers lie before the given zero of the high bits."""
        zero = np.maximum(zero, 0)  # of no use where there is none before
        word = np.searchsorted(self.zeros, zero, "right") - 1
        return 64 * word + _select(~self.high[word], zero - self.zeros[word]) - zero


def write_arrays(path: str, arrays: dict[str, np.ndarray]) -> None:
    """Arrays in one file. It appears whole under its name, also where several attempts of a task write it."""
    header, offset = {}, 0
    for name, array in arrays.items():
        header[name] = (array.dtype.str, len(array), offset)
        offset += (array.nbytes + 7) // 8 * 8
    text = json.dumps(header).encode()
    text += b" " * (-len(text) % 8)
    where, at = _file(path)
    part = f"{at}.{uuid.uuid4().hex}"
    with where.open_output_stream(part) as out:
        out.write(MAGIC + len(text).to_bytes(8, "little") + text)
        for array in arrays.values():
            out.write(np.ascontiguousarray(array).tobytes() + b"\0" * (-array.nbytes % 8))
    where.move(part, at)


def read_arrays(path: str) -> dict[str, np.ndarray] | None:
    """The arrays of a file, mapped into memory where its system allows it; nothing if there is no such file."""
    where, at = _file(path)
    try:
        if isinstance(where, fs.LocalFileSystem):
            with open(at, "rb") as file:
                data = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        else:
            with where.open_input_file(at) as file:
                data = file.read()
    except FileNotFoundError:
        return None
    if bytes(data[:8]) != MAGIC:
        raise ValueError(f"{path} is no array file")
    start = 16 + int.from_bytes(data[8:16], "little")
    header = json.loads(bytes(data[16:start]))
    return {name: np.frombuffer(data, kind, n, start + offset) for name, (kind, n, offset) in header.items()}


def make_folder(path: str) -> None:
    where, at = _file(path)
    where.create_dir(at, recursive=True)


def _file(path: str) -> tuple[fs.FileSystem, str]:
    if ":" in path.split("/", 1)[0]:
        if path.startswith("file:"):
            return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path
