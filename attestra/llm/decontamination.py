"""Benchmark decontamination over a distributed positional inverted index."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.llm.rows import only, text_bytes, with_row
from attestra.session import cut_lineage, stored

WINDOW = 13
#: A segment of the index is closed after so many bytes of text; a document is never cut.
SEGMENT_BYTES = 2 << 20
#: Test items are searched in blocks of so many bytes of text, which bounds what is sent to the tasks.
BLOCK_BYTES = 8 << 20
#: A proximity match has so many of a window's rarest terms that the index holds (all, if the item has fewer words),
#: each so many words off its place at most.
NEAR_TERMS, SLACK = 5, 3
#: A document is contaminated if one word in so many, or more, is hit.
SHARE = 20

_SEPARATORS = bytes(b for b in range(128) if not chr(b).isalnum())
_LOWER = bytes.maketrans(bytes(range(65, 91)) + _SEPARATORS, bytes(range(97, 123)) + b" " * len(_SEPARATORS))


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) runs of ASCII letters, digits and non-ASCII characters."""
    return text.translate(_LOWER).split()


# --- the index ------------------------------------------------------------------------------------


def _segment(docs: list[list[bytes]]) -> dict:
    """Postings of some documents: terms, list lengths, and positions as differences.

    Positions run through the segment, with one left free after each document, so that no phrase
    crosses from one to the next.
    """
    lengths = np.array([len(d) for d in docs], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    tokens = [w for d in docs for w in d]
    if not tokens:
        return {"starts": starts, "terms": b"", "counts": b"", "positions": b""}
    encoded = pa.array(tokens, pa.binary()).dictionary_encode()
    codes = encoded.indices.to_numpy()
    places = np.arange(len(tokens)) + np.repeat(np.arange(len(docs)), lengths)
    positions = places[np.argsort(codes, kind="stable")].astype("<u4")
    return {
        "starts": starts, "terms": b" ".join(encoded.dictionary.to_pylist()),
        "counts": np.bincount(codes).astype("<u4").tobytes(), "positions": np.diff(positions, prepend=np.uint32(0)).tobytes(),
    }


def build_index(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The positional inverted index of whole texts, in the shared folder: a row per segment.

    ``segment``; ``ids``, ``n_words`` and ``starts`` of its documents in order; ``terms`` (joined by a
    space), ``counts`` and ``positions`` (little-endian unsigned 32-bit; positions as differences). Each
    task indexes the documents it reads, so building needs no shuffle, and a frequent word's postings
    are spread over all segments. Null texts have no words; repeated rows are documents of their own.
    """
    rows = only(docs, id_column, text).toDF("id", "_text").select("id", text_bytes("_text").alias("_text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[pa.Array] = []
        found: list[list[bytes]] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal size
            made = _segment(found)
            chunk = pa.concat_arrays(ids)
            one = pa.RecordBatch.from_arrays(
                [
                    pa.array([uuid.uuid4().hex]), pa.ListArray.from_arrays([0, len(chunk)], chunk),
                    pa.array([[len(d) for d in found]], pa.list_(pa.int32())),
                    pa.array([made["starts"].tolist()], pa.list_(pa.int32())),
                    *[pa.array([made[n]], pa.binary()) for n in ("terms", "counts", "positions")],
                ],
                names=["segment", "ids", "n_words", "starts", "terms", "counts", "positions"],
            )
            ids.clear()
            found.clear()
            size = 0
            return one

        for batch in batches:
            first = 0
            for i, body in enumerate(batch.column(1).to_pylist()):
                found.append(words_of(body))
                size += len(body) + 8
                if size >= SEGMENT_BYTES:
                    ids.append(batch.column(0).slice(first, i + 1 - first))
                    first = i + 1
                    yield close()
            ids.append(batch.column(0).slice(first))
        if found:
            yield close()

    schema = f"segment string, ids array<{kind}>, n_words array<int>, starts array<int>, terms binary, counts binary, positions binary"
    return stored(rows.mapInArrow(run, schema), "postings")


# --- the search -----------------------------------------------------------------------------------


@dataclass
class Items:
    """A block of test items: the words of each as numbers, and the words behind the numbers."""

    ids: list[str] = field(default_factory=list)
    words: list[np.ndarray] = field(default_factory=list)
    number: dict[bytes, int] = field(default_factory=dict)
    #: Per item and window: the places of its rarest terms in the whole index, rarest first; -1: too few are there.
    rarest: list[np.ndarray] = field(default_factory=list)

    def add(self, item_id: str, text: bytes) -> None:
        found = [self.number.setdefault(w, len(self.number)) for w in words_of(text)]
        if found:
            self.ids.append(item_id)
            self.words.append(np.array(found, np.int32))

    def rank(self, lengths: np.ndarray) -> None:
        """Set ``rarest`` by the terms' list lengths in the whole index, so that it is the same for every segment."""
        for words in self.words:
            windows = np.lib.stride_tricks.sliding_window_view(words, min(WINDOW, len(words)))
            n = min(NEAR_TERMS, windows.shape[1])
            held = lengths[windows]
            order = np.argsort(np.where(held, held, np.iinfo(np.int64).max), axis=1, kind="stable")[:, :n]
            self.rarest.append(np.where((held > 0).sum(axis=1, keepdims=True) >= n, order, -1))


class Segment:
    """Postings of the test terms in one segment."""

    def __init__(self, terms: bytes, counts: bytes, positions: bytes, starts: list[int], n_words: list[int], items: Items):
        lengths = np.frombuffer(counts, "<u4").astype(np.int64)
        places = np.cumsum(np.frombuffer(positions, "<u4"), dtype=np.uint32).astype(np.int64)
        ends = np.cumsum(lengths)
        self.starts = np.array(starts, np.int64)
        self.ends = self.starts + np.array(n_words, np.int64)
        length = int(starts[-1] + n_words[-1] + 1) if starts else 0
        self.postings: list[np.ndarray] = [places[:0]] * len(items.number)
        #: The test term at each position; -1: another one, or none.
        self.term_at = np.full(length + WINDOW, -1, np.int32)
        number = items.number
        for i, term in enumerate(terms.split(b" ") if terms else ()):
            if (n := number.get(term)) is not None:
                self.postings[n] = places[ends[i] - lengths[i] : ends[i]]
                self.term_at[self.postings[n]] = n
        self.lengths = np.array([len(p) for p in self.postings], np.int64)

    def phrase(self, window: np.ndarray) -> np.ndarray:
        """First positions of exact occurrences: offset-adjusted lists, from the rarest term on."""
        order = np.argsort(self.lengths[window], kind="stable")
        starts = self.postings[window[order[0]]] - order[0]
        for i in order[1:3]:
            if not len(starts):
                return starts
            other = self.postings[window[i]] - i
            at = np.minimum(np.searchsorted(other, starts), len(other) - 1)
            starts = starts[other[at] == starts]
        starts = starts[starts >= 0]
        if len(starts):
            starts = starts[(self.term_at[starts[:, None] + np.arange(len(window))] == window).all(axis=1)]
        return starts

    def near(self, window: np.ndarray, rarest: np.ndarray) -> np.ndarray:
        """Positions of the rarest term where the next rarest are all at their places, give or take SLACK."""
        found = self.postings[window[rarest[0]]]
        doc = np.searchsorted(self.starts, found, side="right")
        for i in rarest[1:]:
            if not len(found):
                return found
            other = self.postings[window[i]]
            wanted = found - rarest[0] + i
            low = np.searchsorted(other, np.maximum(wanted - SLACK, self.starts[doc - 1]))
            inside = low < np.searchsorted(other, np.minimum(wanted + SLACK, self.ends[doc - 1]), side="right")
            found, doc = found[inside], doc[inside]
        return found

    def search(self, items: Items) -> Iterator[tuple[int, str, list[tuple[int, int]], bool]]:
        """``(document, item, exact spans, near)`` with spans in words of the document."""
        for item_id, words, rarest in zip(items.ids, items.words, items.rarest, strict=True):
            n = min(WINDOW, len(words))
            absent = np.concatenate([[0], np.cumsum(self.lengths[words] == 0)])
            exact: dict[int, list[tuple[int, int]]] = {}
            near: set[int] = set()
            for w in np.flatnonzero(absent[n:] == absent[: len(words) - n + 1]):
                window = words[w : w + n]
                starts = self.phrase(window)
                for doc, start in zip(self._doc(starts), starts.tolist(), strict=True):
                    first = start - int(self.starts[doc])
                    spans = exact.setdefault(doc, [])
                    if spans and spans[-1][0] <= first <= spans[-1][1]:
                        spans[-1] = (spans[-1][0], max(spans[-1][1], first + n))
                    else:
                        spans.append((first, first + n))
            windows = np.lib.stride_tricks.sliding_window_view(words, n)
            here = (self.lengths[np.take_along_axis(windows, rarest, axis=1)] > 0).all(axis=1) & (rarest[:, 0] >= 0)
            for w in np.flatnonzero(here):
                near.update(self._doc(self.near(windows[w], rarest[w])))
            for doc in exact.keys() | near:
                yield doc, item_id, exact.get(doc, []), doc in near and doc not in exact

    def _doc(self, positions: np.ndarray) -> list[int]:
        return (np.searchsorted(self.starts, positions, side="right") - 1).tolist()


def _list_lengths(index: DataFrame, items: Items) -> np.ndarray:
    """The length of each test term's list in the whole index; a task gives one row per term it has."""
    shipped = index.sparkSession.sparkContext.broadcast(items.number)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shipped.value
        total = np.zeros(len(number), np.int64)
        for batch in batches:
            for terms, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lengths = np.frombuffer(counts, "<u4")
                at = [(i, number[t]) for i, t in enumerate(terms.split(b" ") if terms else ()) if t in number]
                if at:
                    i, n = np.array(at).T
                    total[n] += lengths[i]
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(total[found], pa.int64())], names=["term", "n"])

    lengths = np.zeros(len(items.number), np.int64)
    for term, n in index.select("terms", "counts").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n")).collect():
        lengths[term] = n
    shipped.unpersist()
    return lengths


HITS = "segment string, doc int, item string, spans array<struct<start: int, until: int>>, near boolean"


def _item_blocks(benchmark: DataFrame, id_column: str, text: str) -> Iterator[Items]:
    """The stated test items, block by block: no more than one block is on the driver or sent out."""
    block, size = Items(), 0
    for row in only(benchmark, id_column, text).toLocalIterator():
        body = (row[1] or "").encode()
        block.add("null" if row[0] is None else str(row[0]), body)
        size += len(body)
        if size >= BLOCK_BYTES:
            yield block
            block, size = Items(), 0
    yield block


def search(index: DataFrame, benchmark: DataFrame, id_column: str = "item_id", text: str = "text") -> DataFrame:
    """Matches of test items in the index (HITS): a row per document and item, with exact spans of words.

    Every WINDOW consecutive words of an item are looked up, or all of its words if it has fewer. The
    offset-adjusted lists of a window's rarest terms in the segment are intersected, and what is left is compared word
    by word. A document with no exact match has ``near`` set where the NEAR_TERMS rarest terms of a window are
    all found within SLACK words of their places: the rarest of those that the whole index holds, so matches do
    not depend on which documents share a segment. Test items are gone through in blocks, each against all
    segments; segments are searched where they are read.
    """
    found = None
    for items in _item_blocks(benchmark, id_column, text):
        items.rank(_list_lengths(index, items))
        shipped = index.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterable[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            schema = pa.schema([
                ("segment", pa.string()), ("doc", pa.int32()), ("item", pa.string()),
                ("spans", pa.list_(pa.struct([("start", pa.int32()), ("until", pa.int32())]))), ("near", pa.bool_()),
            ])
            for batch in batches:
                for row in range(batch.num_rows):
                    segment, starts, n_words, *lists = (c[row].as_py() for c in batch.columns)
                    part = Segment(*lists, starts, n_words, shipped.value)
                    rows = [
                        {"segment": segment, "doc": d, "item": i, "spans": [{"start": s, "until": u} for s, u in spans], "near": near}
                        for d, i, spans, near in part.search(shipped.value)
                    ]
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

        part = index.select("segment", "starts", "n_words", "terms", "counts", "positions").mapInArrow(run, HITS)
        found = part if found is None else found.unionByName(part)
    return cut_lineage(found)


def _covered(spans: Column) -> Column:
    """Words inside any of the spans."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("until"))
    step = lambda acc, x: F.struct(
        (acc["n"] + F.greatest(F.lit(0), x["until"] - F.greatest(x["start"], acc["until"]))).alias("n"),
        F.greatest(acc["until"], x["until"]).alias("until"),
    )
    return F.aggregate(F.array_sort(spans), start, step, lambda acc: acc["n"])


def contamination(index: DataFrame, hits: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """One row per indexed document: what was hit, by which items, and the verdict.

    ``n_hit`` counts words inside any occurrence of a window; ``items`` are sorted as texts (an item without
    an id as "null"); ``near_items`` counts proximity matches. No hit gives zeros and an empty list.
    """
    docs = index.select("segment", F.posexplode(F.arrays_zip("ids", "n_words")).alias("doc", "_d"))
    docs = docs.select("segment", "doc", F.col("_d.ids").alias("id"), F.col("_d.n_words").cast("long").alias("n_words"))
    exact = F.when(F.size("spans") > 0, F.col("item"))
    per_doc = hits.groupBy("segment", "doc").agg(
        F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.collect_set(exact)).alias("items"),
        F.count_distinct(F.when(F.col("near"), F.col("item"))).alias("near_items"),
    )
    none = F.array().cast("array<string>")
    joined = docs.join(per_doc, ["segment", "doc"], "left").select(
        F.col("id").alias(id_column), "n_words", F.coalesce(_covered(F.col("spans")), F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", none).alias("items"), F.coalesce("near_items", F.lit(0)).cast("long").alias("near_items"),
        "segment", "doc",
    )
    return joined.withColumn("contaminated", (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    keyed, row = with_row(docs)
    index = build_index(keyed, row, text)
    clean = contamination(index, search(index, benchmark), row).filter("NOT contaminated").select(row)
    return keyed.join(clean, row, "left_semi").drop(row)
