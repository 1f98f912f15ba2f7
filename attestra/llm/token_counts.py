"""Token counts under a unigram model: one forward pass per shared prefix of all pre-tokens."""

from __future__ import annotations

import base64
import math
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm.rows import only

#: Fixed value: the pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Log-probabilities follow Zipf's law over the vocabulary's ranks, rounded to whole units, so ties are exact.
SHIFT, UNITS = 2.7, 1 << 16
#: Pre-tokens whose counts a worker takes along to its next batch. It saves work and changes no result.
REMEMBERED = 1 << 17


def piece_scores(file_text: str) -> dict[bytes, int]:
    """Score of each piece of a rank file (lines of base64 and rank): its log-probability in UNITS."""
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file_text.splitlines() if line)}
    total = math.log(sum(1 / (r + SHIFT) for r in ranks.values()))
    return {piece: round(UNITS * (-math.log(r + SHIFT) - total)) for piece, r in ranks.items()}


class Trie:
    """Distinct pre-tokens as paths of bytes; each node has its prefix's best forward score.

    A node's state is ``(score, tokens)`` of its prefix's best segmentation: the highest score, then the
    fewest tokens. It depends on the prefix alone, so pre-tokens that share a prefix share it. Terminal
    nodes give a pre-token's count.
    """

    def __init__(self, scores: dict[bytes, int]):
        self.scores = scores
        self.longest = max(map(len, scores))

    def counts(self, words: Iterable[bytes]) -> dict[bytes, int]:
        """Token count of every distinct word.

        The words are visited in sorted order, which is the trie's depth-first order, so only the states of
        the current path are held: a step back to the shared prefix, then on along the new suffix.
        """
        found: dict[bytes, int] = {}
        path: list[tuple[int, int]] = [(0, 0)]
        before = b""
        for word in sorted(set(words)):
            shared, limit = 0, min(len(before), len(word))
            while shared < limit and before[shared] == word[shared]:
                shared += 1
            del path[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                path.append(self._state(word, end, path))
            found[word] = -path[len(word)][1]
            before = word
        return found

    def _state(self, word: bytes, end: int, path: list[tuple[int, int]]) -> tuple[int, int]:
        """Best state of ``word[:end]``; tokens are held negative, so the larger pair is the better."""
        scores, best = self.scores, None
        for start in range(max(0, end - self.longest), end):
            piece = scores.get(word[start:end])
            if piece is not None:
                score, tokens = path[start]
                state = (score + piece, tokens - 1)
                if best is None or state > best:
                    best = state
        if best is None:
            raise ValueError(f"the vocabulary lacks byte {word[end - 1]}")
        return best


_models: dict[int, tuple[Trie, dict[bytes, int]]] = {}


def _model(shipped: Broadcast) -> tuple[Trie, dict[bytes, int]]:
    key = hash(shipped.value)
    if key not in _models:
        _models[key] = (Trie(piece_scores(shipped.value)), {})
    return _models[key]


def count_tokens(docs: DataFrame, path: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, n_pretokens, n_tokens)`` per row, of whole texts.

    A text is cut into pre-tokens, and a pre-token's count is that of its best segmentation into pieces of the
    vocabulary (the highest score, then the fewest pieces). Null and empty texts have none. The distinct
    pre-tokens of each batch that are not known yet go through the trie; nothing is shuffled and rows stay
    where they are. Repeated rows are counted alike; other columns are not read. The vocabulary file is read
    by the driver; its size does not depend on the data.
    """
    spark: SparkSession = docs.sparkSession
    with open(path, encoding="utf-8") as file:
        shipped = spark.sparkContext.broadcast(file.read())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, known = _model(shipped)
        words = regex.compile(PATTERN)
        for batch in batches:
            tallies = [Counter(words.findall(body or "")) for body in batch.column(1).to_pylist()]
            new = {w: w.encode() for tally in tallies for w in tally if w not in known}
            counted = trie.counts(new.values())
            known.update((w, counted[b]) for w, b in new.items())
            n_pretokens = [sum(tally.values()) for tally in tallies]
            n_tokens = [sum(n * known[w] for w, n in tally.items()) for tally in tallies]
            if len(known) > REMEMBERED:
                known.clear()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_pretokens, pa.int64()), pa.array(n_tokens, pa.int64())],
                names=[id_column, "n_pretokens", "n_tokens"],
            )

    rows = only(docs, id_column, text)
    kind = rows.schema[id_column].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_column}` {kind}, n_pretokens bigint, n_tokens bigint")


def totals(counted: DataFrame) -> DataFrame:
    """Sums over all rows of ``count_tokens``."""
    return counted.agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("n_pretokens").alias("n_pretokens"), F.sum("n_tokens").alias("n_tokens")
    )
