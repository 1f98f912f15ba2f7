"""Fill-in-middle transformation with content-defined chunks whose counts are remembered."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestra.llm.rows import only

#: Marks of the three parts.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Shares in per cent: rows that are transformed at all, and of these the ones in suffix-prefix-middle order.
RATE, SPM_RATE = 90, 20
#: A chunk ends where the rolling hash of the last WINDOW bytes has CUT_BITS zeros in front, within these sizes.
WINDOW, CUT_BITS = 16, 10
SMALLEST, LARGEST = 256, 8192
#: The hash is computed over so many bytes at a time.
SPAN = 1 << 20
#: Bytes of chunks a worker remembers. Beyond them it starts anew; results do not depend on it.
REMEMBERED = 32 << 20

#: A random 32-bit value per byte.
GEAR = np.array([int.from_bytes(hashlib.sha256(bytes([b])).digest()[:4], "big") for b in range(256)], np.uint32)


class Summary(NamedTuple):
    """What a chunk tells without being read again; summaries of neighbours combine."""

    points: int  # code points that start in it
    marked: bool  # holds a mark
    head: bytes  # its first and last two bytes, for marks across a border
    tail: bytes


def summarise(chunk: bytes) -> Summary:
    """Summary of a chunk of UTF-8, which may begin and end inside a code point."""
    points = len(chunk) - int(np.count_nonzero((np.frombuffer(chunk, np.uint8) & 0xC0) == 0x80))
    return Summary(points, _marked(chunk), chunk[:2], chunk[-2:])


def _marked(text: bytes) -> bool:
    return any(mark.encode() in text for mark in (PREFIX, SUFFIX, MIDDLE))


def chunk_ends(text: bytes) -> Iterator[int]:
    """Ends of the chunks of a text. They depend on the bytes nearby, so equal passages get equal chunks."""
    start = 0
    for at in _hash_cuts(text):
        while at - start > LARGEST:
            start += LARGEST
            yield start
        if at - start >= SMALLEST:
            start = at
            yield start
    while len(text) - start > LARGEST:
        start += LARGEST
        yield start
    if start < len(text):
        yield len(text)


def _hash_cuts(text: bytes) -> Iterator[int]:
    """Places after which the hash of the last WINDOW bytes begins with zeros."""
    for low in range(0, len(text), SPAN):
        first = max(0, low - WINDOW + 1)
        h = GEAR[np.frombuffer(text, np.uint8, min(low + SPAN, len(text)) - first, first)]
        step = 1
        while step < WINDOW:  # the hash of 2 * step bytes from two of step bytes
            h[step:] += h[:-step] << np.uint32(step)
            step *= 2
        yield from (np.flatnonzero(h[low - first :] >> np.uint32(32 - CUT_BITS) == 0) + low + 1).tolist()


class Chunks:
    """Chunk summaries by content: a hash finds the chunk, and its bytes are compared before it counts as known."""

    def __init__(self) -> None:
        self.known: dict[bytes, Summary] = {}
        self.size = 0

    def of(self, chunk: bytes) -> Summary:
        found = self.known.get(chunk)
        if found is None:
            found = summarise(chunk)
            if self.size > REMEMBERED:
                self.known.clear()
                self.size = 0
            self.known[chunk] = found
            self.size += len(chunk)
        return found


class Layout:
    """A text's chunks: the code points before each of them, and whether any mark is in the text."""

    def __init__(self, text: bytes, chunks: Chunks):
        self.text, self.starts, self.before = text, [0], [0]
        self.marked, tail = False, b""
        for end in chunk_ends(text):
            chunk = text[self.starts[-1] : end]
            s = chunks.of(chunk)
            self.marked = self.marked or s.marked or _marked(tail + s.head)
            tail = s.tail if len(chunk) > 1 else (tail + s.tail)[-2:]
            self.starts.append(end)
            self.before.append(self.before[-1] + s.points)
        self.points = self.before[-1]

    def byte_of(self, point: int) -> int:
        """Byte at which a code point starts; the text's length for the one after the last."""
        if point >= self.points:
            return len(self.text)
        chunk = int(np.searchsorted(self.before, point, "right")) - 1
        low, high = self.starts[chunk], self.starts[chunk + 1]
        leads = np.flatnonzero((np.frombuffer(self.text, np.uint8, high - low, low) & 0xC0) != 0x80)
        return low + int(leads[point - self.before[chunk]])


def draws(seed: str, key: str) -> list[int]:
    """Four whole numbers below 2**32 that depend on the seed and the key alone."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12)]


def transform(text: bytes, key: str, chunks: Chunks, seed: str = "1", rate: int = RATE, spm_rate: int = SPM_RATE) -> tuple:
    """``(n, form, prefix code points, middle code points, output)``."""
    layout = Layout(text, chunks)
    h1, h2, h3, h4 = draws(seed, key)
    n = layout.points
    if not n or layout.marked or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    i, j = layout.byte_of(a), layout.byte_of(b)
    prefix, middle, suffix = text[:i], text[i:j], text[j:]
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    if h4 % 100 < spm_rate:
        return n, "spm", a, b - a, b"".join((s, suffix, p, prefix, m, middle))
    return n, "psm", a, b - a, b"".join((p, prefix, s, suffix, m, middle))


def fill_in_middle(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", *, seed: str = "1", rate: int = RATE, spm_rate: int = SPM_RATE
) -> DataFrame:
    """``(id, n, form, prefix_chars, middle_chars, output)`` per row, of whole texts.

    ``n`` counts code points. A text is cut at two places drawn from its id, and the parts are put in the order of ``form``: plain
    (the text as it is), psm or spm. Texts that are null, empty or hold a mark are plain; a null text counts as empty, a null id
    as ``null``. Repeated rows get equal results. Nothing is shuffled, rows stay where they are, and other columns are not read.

    Texts are cut into content-defined chunks. A worker remembers the summaries of chunks it has met, so passages that many texts
    share are counted and searched once per worker; the sums of the chunks' counts say which chunk a cut falls into.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = Chunks()
        for batch in batches:
            rows = [
                transform(body or b"", "null" if key is None else str(key), chunks, seed, rate, spm_rate)
                for key, body in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True)
            ]
            n, form, prefix, middle, output = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()),
                 pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())],
                names=["id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    rows = only(docs, id_column, text).toDF("id", "text")
    long, string = T.LongType(), T.StringType()
    schema = T.StructType([
        rows.schema["id"], T.StructField("n", long), T.StructField("form", string), T.StructField("prefix_chars", long),
        T.StructField("middle_chars", long), T.StructField("output", string),
    ])
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_column)


def restored(output: Column, form: Column) -> Column:
    """The text a transformed one was made from."""
    parts = F.split(output, "|".join(map(re.escape, (PREFIX, SUFFIX, MIDDLE))), -1)
    first, second, middle = (F.get(parts, F.lit(i)) for i in (1, 2, 3))
    return F.when(form == "psm", F.concat(first, middle, second)).when(form == "spm", F.concat(second, middle, first)).otherwise(output)
