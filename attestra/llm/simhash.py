"""SimHash near-duplicates through an inverted index on byte positions."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestra.llm.components import components
from attestra.llm.rows import only, text_bytes, with_row
from attestra.session import cut_lineage

SHINGLE = 3
SEED = 42
#: Two fingerprints are linked at so many differing bits, so at least POSITIONS - MAX_BITS bytes agree.
MAX_BITS = 2
POSITIONS = 8
#: Posting lists longer than this are not paired entry by entry; see ``links``.
LONG_LIST = 64
BLOCK = 1 << 15


def fingerprint_of(text: bytes, size: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of lower-cased word shingles, repeats included; no words: 0."""
    words = text.lower().split()  # of bytes: A-Z, and white space \x20 \x09-\x0D
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    stops = (ends - 1).tolist()
    last = max(len(words) - size, 0)
    spans = list(zip(starts[: last + 1], stops[min(size, len(words)) - 1 :], strict=True))
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(spans), BLOCK):
        hashes = np.array([digest(joined[s:e], SEED) for s, e in spans[at : at + BLOCK]], ">u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(spans))
    return int(bits.view(">i8")[0])


@F.pandas_udf(T.LongType())
def _fingerprint(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in texts:
        yield pd.Series([fingerprint_of(t) for t in part], dtype="int64")


def fingerprint(text: str = "text") -> Column:
    return _fingerprint(text_bytes(text))


def _byte(value: Column, position: int) -> Column:
    return F.shiftrightunsigned(value, 8 * position).bitwiseAND(F.lit(255))


def shared_bytes(a: Column, b: Column) -> Column:
    """Tally of the byte positions at which two fingerprints agree."""
    tally = F.lit(0)
    for p in range(POSITIONS):
        tally = tally + (_byte(a, p) == _byte(b, p)).cast("int")
    return tally


def posting_masks() -> list[int]:
    """Which positions each family of posting lists is keyed by.

    Positions fall into MAX_BITS + 2 blocks. MAX_BITS differing bits touch at most MAX_BITS of them, so
    any linked pair agrees on two whole blocks at least, and meets in the list of those two blocks.
    """
    blocks = np.array_split(np.arange(POSITIONS), MAX_BITS + 2)
    masks = []
    for left, right in combinations(blocks, 2):
        mask = sum(0xFF << (8 * int(p)) for p in (*left, *right))
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return masks


def links(fingerprints: DataFrame, column: str = "fingerprint") -> DataFrame:
    """``(a, b)`` links that join all fingerprints within MAX_BITS bits, directly or in steps.

    ``fingerprints`` holds distinct values. The index has a posting for each value under every list of
    ``posting_masks``: the list's family and the bytes at its four positions, so lists stay short as the
    table grows. Entries of a list are paired, the positional bytes they share are tallied, pairs under
    the guaranteed minimum of POSITIONS - MAX_BITS go, and the rest are verified bit by bit.

    A list longer than LONG_LIST (a large group of near copies) would give pairs by the square of its
    length. Its entries are posted under themselves and their 64 one-bit neighbours instead: two values
    differ by at most two bits exactly if they meet there. Such a list has 65 entries at most, and each is
    linked to the smallest. No link is lost either way.
    """
    one = fingerprints.select(F.col(column).alias("fp"))
    families = F.array(*[
        F.struct(F.lit(i).alias("family"), F.col("fp").bitwiseAND(F.lit(m)).alias("bytes"))
        for i, m in enumerate(posting_masks())
    ])
    postings = one.select("fp", F.explode(families).alias("k")).select("fp", "k.family", "k.bytes")
    lengths = postings.groupBy("family", "bytes").agg(F.count(F.lit(1)).alias("length")).filter("length > 1")
    met = cut_lineage(postings.join(lengths, ["family", "bytes"]))
    short = met.filter(F.col("length") <= LONG_LIST)
    left = short.select("family", "bytes", F.col("fp").alias("a"))
    right = short.select("family", "bytes", F.col("fp").alias("b"))
    a, b = F.col("a"), F.col("b")
    pairs = (
        left.join(right, ["family", "bytes"])
        .filter((a < b) & (shared_bytes(a, b) >= POSITIONS - MAX_BITS) & (F.bit_count(a.bitwiseXOR(b)) <= MAX_BITS))
        .select("a", "b")
    )
    flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit((1 << i) - (1 << 64) if i == 63 else 1 << i)) for i in range(64)])
    near = met.filter(F.col("length") > LONG_LIST).select("fp").distinct().select("fp", F.explode(flips).alias("at"))
    stars = near.groupBy("at").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1).select(
        F.array_min("fps").alias("a"), F.explode("fps").alias("b")
    )
    return pairs.unionByName(stars.filter("a != b"))


def fingerprint_components(fingerprinted: DataFrame) -> DataFrame:
    """``(fingerprint, root)``: the components of all distinct fingerprints that have a link."""
    distinct = fingerprinted.select("fingerprint").distinct()
    found = components(links(distinct))
    return found.select(F.col("node").alias("fingerprint"), "root")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, fingerprint, component_id)`` per row: the smallest id reachable over links.

    Fingerprints of SHINGLE-word shingles (shorter texts: the whole sequence; null, empty and blank
    texts: 0) are linked at MAX_BITS differing bits or fewer. Equal texts and equal fingerprints are one
    node, however many rows have them. Repeated rows stay rows. Rows without an id take part, and get
    null only if no row of their component has one. Other columns are not read.
    """
    rows = cut_lineage(
        only(docs, id_column, text).select(F.col(f"`{id_column}`").alias("id"), fingerprint(f"`{text}`").alias("fingerprint"))
    )
    roots = fingerprint_components(rows)
    smallest = rows.groupBy("fingerprint").agg(F.min("id").alias("least"))
    rooted = cut_lineage(smallest.join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint")))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = rooted.join(least, "root").select("fingerprint", "component_id")
    return rows.join(of, "fingerprint").select(F.col("id").alias(id_column), "fingerprint", "component_id")


def hex_digits(fingerprint: Column) -> Column:
    """A signed 64-bit value as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


#: Near copies: shingles of so many words, at this Jaccard similarity or more.
NEAR_SHINGLE, SIMILARITY = 5, 0.8
#: Their fingerprints have so many 64-bit words. Binary vectors of Jaccard similarity s have the cosine 2s / (1 + s), so
#: bits differ at a rate of acos(2s / (1 + s)) / pi: 0.152 for 0.8. Pairs are candidates up to 0.18, for the spread of draws.
NEAR_WORDS = 4
NEAR_BITS = int(64 * NEAR_WORDS * 0.18)
NEAR_POSITIONS = 8 * NEAR_WORDS
#: Posting lists are keyed by so many positional bytes, in so many families; a candidate shares this many bytes in all.
NEAR_KEY, NEAR_FAMILIES, NEAR_SHARED = 3, 192, 3
WIDE = [f"w{i}" for i in range(NEAR_WORDS)]
#: Entries of a list are near if a 64-bit word apart from the key differs in so many bits at most. Of pairs at a similarity of 0.8 some one in
#: 25,000 differs in more (each meets in several families, with other words), of strangers with even bits all but one in 120.
SKETCH_BITS = 22


def _mixed(hashes: np.ndarray) -> np.ndarray:
    """NEAR_WORDS independent hashes of each 64-bit hash, as a row of bytes."""
    step = np.uint64(0x9E3779B97F4A7C15)
    z = hashes[:, None] + step * np.arange(1, NEAR_WORDS + 1, dtype=np.uint64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z ^ (z >> np.uint64(31))).view(np.uint8)


def shingle_set(text: bytes, size: int = NEAR_SHINGLE) -> np.ndarray:
    """Hashes of the distinct lower-cased shingles; fewer words: of the whole sequence; none: empty."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    return np.fromiter({digest(b" ".join(words[i : i + size]), SEED) for i in range(max(len(words) - size, 0) + 1)}, np.uint64)


@F.pandas_udf(T.ArrayType(T.LongType()))
def _shingle_set(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in texts:
        yield pd.Series([shingle_set(t).view(np.int64) for t in part], dtype=object)


def wide_fingerprint_of(text: bytes, size: int = NEAR_SHINGLE) -> np.ndarray:
    """SimHash of NEAR_WORDS signed words over the distinct lower-cased shingles; no words: zeros."""
    hashes = shingle_set(text, size)
    if not len(hashes):
        return np.zeros(NEAR_WORDS, np.int64)
    counts = np.zeros(64 * NEAR_WORDS, np.int64)
    for at in range(0, len(hashes), 255):  # so many ones fit into a byte
        counts += np.unpackbits(_mixed(hashes[at : at + 255]), axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(hashes)).view(np.int64)


@F.pandas_udf(T.StructType([T.StructField(w, T.LongType()) for w in WIDE]))
def _wide_fingerprint(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for part in texts:
        values = np.array([wide_fingerprint_of(t) for t in part], np.int64).reshape(-1, NEAR_WORDS)
        yield pd.DataFrame(values, columns=WIDE)


_wide_fingerprint = _wide_fingerprint.asNondeterministic()


def near_families() -> np.ndarray:
    """The byte positions of each family of posting lists, spread over all positions by a fixed seed."""
    rng = np.random.default_rng(SEED)
    chosen: dict[tuple[int, ...], None] = {}
    while len(chosen) < NEAR_FAMILIES:
        chosen[tuple(sorted(rng.choice(NEAR_POSITIONS, NEAR_KEY, replace=False).tolist()))] = None
    return np.array(list(chosen))


def _postings(nodes: DataFrame) -> DataFrame:
    """``(key, node, sketch)`` for each node and family; the sketch is a word of the fingerprint that holds no byte of the key."""
    families = near_families()
    free = np.array([min(set(range(NEAR_WORDS)) - {p // 8 for p in family}) for family in families.tolist()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                node, *words = (c.to_numpy().astype(np.int64) for c in batch.slice(low, 512).columns)
                wide = np.column_stack(words)
                positional = wide.view(np.uint8).reshape(-1, NEAR_POSITIONS).astype(np.int64)
                key = np.broadcast_to(np.arange(len(families), dtype=np.int64), (len(wide), len(families)))
                for column in families.T:
                    key = key << 8 | positional[:, column]
                columns = key.ravel(), np.repeat(node, len(families)), wide[:, free].ravel()
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "node", "sketch"])

    return nodes.select("node", *WIDE).mapInArrow(run, "key bigint, node bigint, sketch bigint")


def _sublists(key: np.ndarray, node: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(key, pivot, node)`` of the entries that are near another one of their list, in one sublist with it.

    Entries come sorted by key and node. A list longer than LONG_LIST is one sublist as it is.
    """
    if not len(key):
        return key, node, node
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(first, len(key)))
    used = np.repeat(size > 1, size)
    first = np.repeat(first, size)[used]
    key, node, sketch, pivot, size = key[used], node[used], sketch[used], node[first], np.repeat(size, size)[used]
    short = np.flatnonzero(size <= LONG_LIST)
    k, x = key[short], sketch[short].view(np.uint64)
    left, right = [], []
    for step in range(1, int(size[short].max(initial=1))):
        at = np.flatnonzero(k[step:] == k[:-step])
        at = at[np.bitwise_count(x[at] ^ x[at + step]) <= SKETCH_BITS]
        left.append(at)
        right.append(at + step)
    label = np.arange(len(short))
    if left:
        a, b = np.concatenate(left), np.concatenate(right)
        while True:
            least = np.minimum(label[a], label[b])
            if (label[a] == least).all() and (label[b] == least).all():
                break
            np.minimum.at(label, a, least)
            np.minimum.at(label, b, least)
        pivot[short] = node[short][label]
        kept = size > LONG_LIST
        kept[short[a]] = kept[short[b]] = True
    else:
        kept = size > LONG_LIST
    return key[kept], pivot[kept], node[kept]


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_sublists`` of sorted postings. A list that goes on in the next batch waits for it, but for one that is long already."""
    held = [np.zeros(0, np.int64)] * 3
    running = None  # key and pivot of a long list of which the beginning is out already
    for batch in batches:
        key, node, sketch = (np.concatenate([h, c.to_numpy()]) for h, c in zip(held, batch.columns, strict=True))
        if not len(key):
            continue
        out = []
        if running:
            n = int(np.searchsorted(key, running[0], "right"))
            out.append((key[:n], np.full(n, running[1]), node[:n]))
            key, node, sketch = key[n:], node[n:], sketch[n:]
        if len(key):
            running = None
            last = int(np.searchsorted(key, key[-1]))
            if len(key) - last > LONG_LIST:
                running = key[-1], node[last]
                out.append((key[last:], np.full(len(key) - last, node[last]), node[last:]))
            out.append(_sublists(key[:last], node[:last], sketch[:last]))
            held = [np.zeros(0, np.int64)] * 3 if running else [key[last:], node[last:], sketch[last:]]
        for part in out:
            if len(part[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in part], names=["key", "pivot", "node"])
    part = _sublists(*held)
    if len(part[0]):
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in part], names=["key", "pivot", "node"])


def near_lists(nodes: DataFrame) -> DataFrame:
    """``(key, pivot, node)``: the posting lists of the index, parted into sublists of entries near one another.

    Strangers meet in lists of three bytes by chance, the more so the larger the table. An entry whose sketch is within SKETCH_BITS
    of no other one in its list is left out there, so what goes on grows with the near copies and not with the square of the
    table. A sublist holds what such steps join, and its pivot is its smallest node. Lists are found and parted in sorted order.
    """
    return _postings(nodes).repartition("key").sortWithinPartitions("key", "node").mapInArrow(_met, "key bigint, pivot bigint, node bigint")


def _candidates(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(a, b, bits)`` of the pairs that share enough positional bytes and differ in few enough bits."""
    sides = [nodes.select(F.col("node").alias(side), *[F.col(w).alias(f"{side}{w}") for w in WIDE]) for side in "ab"]
    held = pairs.distinct().join(sides[0], "a").join(sides[1], "b")
    shared = sum((shared_bytes(F.col(f"a{w}"), F.col(f"b{w}")) for w in WIDE), F.lit(0))
    bits = sum((F.bit_count(F.col(f"a{w}").bitwiseXOR(F.col(f"b{w}"))) for w in WIDE), F.lit(0))
    return held.filter(shared >= NEAR_SHARED).select("a", "b", bits.alias("bits")).filter(F.col("bits") <= NEAR_BITS)


def _similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The ``(a, b)`` pairs whose shingles are similar enough; ``texts`` is ``(node, text)``, read for these nodes only."""
    pairs = cut_lineage(pairs.select("a", "b"))
    used = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = cut_lineage(texts.join(used, "node", "left_semi").select("node", _shingle_set(text_bytes("text")).alias("held")))
    both = (
        pairs.join(sets.select(F.col("node").alias("a"), F.col("held").alias("_a")), "a")
        .join(sets.select(F.col("node").alias("b"), F.col("held").alias("_b")), "b")
        .select("a", "b", F.size("_a").alias("na"), F.size("_b").alias("nb"), F.size(F.array_intersect("_a", "_b")).alias("n"))
    )
    return both.filter(F.col("n") >= SIMILARITY * (F.col("na") + F.col("nb") - F.col("n"))).select("a", "b")


def near_links(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """``(a, b)`` links that join the near copies among ``nodes``, directly or in steps.

    ``nodes`` has a distinct whole number ``node`` for each distinct wide fingerprint, ``texts`` a ``text`` for each.
    The index posts a fingerprint under the NEAR_KEY positional bytes of each family, and lists are parted into sublists
    of near entries (see ``near_lists``). First every entry is compared with the smallest of each of its sublists and
    verified against the nearest of these, which joins nearly all of a group of near copies, however large. Then entries
    of a sublist that are in different components by now are compared, so a sublist costs its length times its stragglers,
    not its square. No pair that is near in a list is lost: one that is not compared is joined already. Every link
    is verified on all shingles.
    """
    met = cut_lineage(near_lists(nodes))
    to_pivot = _candidates(met.filter("node != pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")), nodes)
    nearest = to_pivot.groupBy("b").agg(F.min(F.struct("bits", "a")).alias("best")).select("best.a", "b")
    stars = cut_lineage(_similar(nearest, texts))
    rooted = met.join(components(stars), "node", "left").select("key", "pivot", "node", F.coalesce("root", "node").alias("root"))
    several = rooted.groupBy("key", "pivot").agg(F.min("root").alias("_first"), F.max("root").alias("_last")).filter("_first != _last")
    left = cut_lineage(rooted.join(several.select("key", "pivot"), ["key", "pivot"]))
    right = left.select("key", "pivot", F.col("node").alias("b"), F.col("root").alias("_root"))
    rest = left.join(right, ["key", "pivot"]).filter("root < _root").select(F.col("node").alias("a"), "b")
    return stars.unionByName(_similar(_candidates(rest, nodes), texts))


def keep_one(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near copies, with all its columns: the one with the smallest id.

    Near copies are texts whose distinct five-word shingles (shorter texts: the whole sequence) have a Jaccard
    similarity of 0.8 or more; candidates come from 256-bit SimHash fingerprints (see ``near_links``). At this
    similarity no byte is guaranteed to agree, so the minimum of shared bytes is a likely one, and the index
    finds a share of the pairs that rises with similarity; a test holds it against brute force.
    Null, empty and blank texts have the fingerprint zero and are one group. Of rows with the smallest id, the
    first stored one stays; a row without an id stays only if no row of its group has one. ``docs`` must be a
    stored table (see ``with_row``). Other columns are not read and may have any name.
    """
    keyed, row = with_row(docs)
    rows = keyed.select(
        F.col(row).alias("row"), F.col(f"`{id_column}`").alias("id"), _wide_fingerprint(text_bytes(f"`{text}`")).alias("wide")
    ).select("row", "id", "wide.*")
    nodes = cut_lineage(
        rows.groupBy(*WIDE).agg(F.min("row").alias("node"), F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("first"))
    )
    texts = keyed.select(F.col(row).alias("node"), F.col(f"`{text}`").alias("text"))
    roots = components(near_links(nodes, texts))
    kept = (
        nodes.join(roots, "node", "left")
        .groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
        .select(F.col("first.row").alias(row))
    )
    return keyed.join(cut_lineage(kept), row, "left_semi").drop(row)
