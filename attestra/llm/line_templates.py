"""Line dedup by a log-template tree: lines of recurring templates are dropped."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestra.llm.rows import free_name, only, text_bytes, with_row
from attestra.session import cut_lineage, stored

#: Depth of the tree below the token count: so many leading tokens.
LEADING = 3
#: The rest of a line is compared in so many fields; so many of a leaf's fields must not vary.
FIELDS, SIMILARITY = 8, 0.75
WILDCARD = b"<*>"


@dataclass(frozen=True)
class Recurrence:
    """When a template recurs: in ``min_docs`` documents; one of fewer than ``short`` tokens in ``short_docs``.

    Lines of fewer than ``min_tokens`` tokens are not looked at. ``Recurrence(1, 2, 0, 2)`` makes no
    difference between short and long lines: any line with a word recurs with two documents.
    """

    min_tokens: int = 3
    min_docs: int = 2
    short: int = 8
    short_docs: int = 10

    def reached(self, docs: str) -> str:
        return f"{docs} >= CASE WHEN tokens < {self.short} THEN {self.short_docs} ELSE {self.min_docs} END"


RECURRENCE = Recurrence()
_variable = re.compile(rb"[0-9@]|://").search


def masked(token: bytes) -> bytes:
    """Tokens that look variable (with a digit, an address or a link) become the wildcard."""
    return WILDCARD if _variable(token) else token


def _long(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data) - (1 << 63)


def line_of(line: bytes, min_tokens: int = RECURRENCE.min_tokens) -> tuple[int, int, int, int, list[int], list[int]] | None:
    """``(tokens, leaf, template, rest, heads, fields)`` of a line, or None if it is too short.

    The leaf is the tree's path: token count, then the masked leading tokens. The template is the whole
    masked line, the rest is the token count and all but the leading tokens. ``heads`` are hashes of the
    leading tokens, ``fields`` those of the masked tokens that follow, in FIELDS even stretches (a token each,
    if there are no more).
    """
    tokens = line.split()
    n = len(tokens)
    if n < max(min_tokens, 1):
        return None
    if _variable(line):
        tokens = [masked(t) for t in tokens]
    head, rest = tokens[:LEADING], tokens[LEADING:]
    count = b"%d " % n
    cuts = range(len(rest) + 1) if len(rest) <= FIELDS else [len(rest) * i // FIELDS for i in range(FIELDS + 1)]
    short = lambda part: xxhash.xxh32_intdigest(b" ".join(part)) - (1 << 31)
    return (
        n, _long(count + b" ".join(head)), _long(b" ".join(tokens)), _long(count + b" ".join(rest)),
        [short([t]) for t in head], [short(rest[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)],
    )


def _lines(docs: DataFrame, row: str, id_column: str, text: str, min_tokens: int) -> DataFrame:
    """A row per line with a template: where it is, its place in the tree, its leading tokens and its fields.

    ``template_first`` marks a template's first line in the document.
    """
    names = [*(f"h{i}" for i in range(LEADING)), *(f"f{i}" for i in range(FIELDS))]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row_id, doc_id, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                templates: set[int] = set()
                for number, line in enumerate(body.split(b"\n")):
                    if (found := line_of(line, min_tokens)) is None:
                        continue
                    n, leaf, template, rest, heads, fields = found
                    out.append((
                        row_id, doc_id, number, n, leaf, template, rest, template not in templates,
                        len(fields), *heads, *[0] * (LEADING - len(heads)), *fields, *[0] * (FIELDS - len(fields)),
                    ))
                    templates.add(template)
            if out:
                columns = list(zip(*out, strict=True))
                kinds = [
                    pa.int64(), pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 3, pa.bool_(),
                    *[pa.int32()] * (1 + LEADING + FIELDS),
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                    names=["row", "doc", "line", "tokens", "leaf", "template", "rest", "template_first", "n_fields", *names],
                )

    rows = only(docs, row, id_column, text).toDF("row", "doc", "_text").select("row", "doc", text_bytes("_text").alias("_text"))
    schema = (
        "row bigint, doc bigint, line int, tokens int, leaf bigint, template bigint, rest bigint, "
        "template_first boolean, n_fields int, " + ", ".join(f"{n} int" for n in names)
    )
    return stored(rows.mapInArrow(run, schema), "lines")


def _field_keys() -> Column:
    """A line's keys: a hash of its leaf with each choice of as many fields as must be equal; null if it must have all."""
    keys = None
    for k in range(1, FIELDS + 1):
        equal = math.ceil(SIMILARITY * k)
        if equal < k:
            made = F.array(*[F.xxhash64("leaf", F.lit(i), *[f"f{j}" for j in c]) for i, c in enumerate(combinations(range(k), equal))])
            at = F.col("n_fields") == k
            keys = F.when(at, made) if keys is None else keys.when(at, made)
    return keys


def _head_keys() -> Column:
    """A line's keys by the paths on which one leading token is a wildcard: a hash of the others with the rest."""
    return F.array(*[
        F.xxhash64("rest", F.lit(-1 - i), *[f"h{j}" for j in range(LEADING) if j != i]) for i in range(LEADING)
    ])


def _met(lines: DataFrame, part: str, keys: Column) -> DataFrame:
    """``(row, line, doc, tokens, key)`` of the lines whose ``part`` several documents have in several templates.

    Other lines have no line to agree with, or are found by their whole template.
    """
    shared = (
        lines.groupBy(part)
        .agg(F.min("doc").alias("_first"), F.max("doc").alias("_last"), F.min("template").alias("_t0"), F.max("template").alias("_t1"))
        .filter("_first != _last AND _t0 != _t1").select(part)
    )
    return lines.join(shared, part).select("row", "line", "doc", "tokens", F.explode(keys).alias("key"))


def _lines_alike(lines: DataFrame, when: Recurrence) -> DataFrame:
    """``(row, line)`` of lines that agree in enough with lines of other documents, the first of which is not theirs.

    A leaf has as many templates as there are choices of equal fields that recur, so lines that fit none
    of them spoil none; and a line is on the paths, too, on which one of its leading tokens is a wildcard and
    all the rest is as it stands. Keys are aggregated to a row for each document and then to one each, so no
    pairs are made.
    """
    # Three of at least four places agree on a path with a wildcard, as many as in a leaf.
    headed = lines.filter("n_fields > 0")
    # A line's keys share all their other columns: in columns they take a fraction of what rows take.
    keyed = stored(_met(lines, "leaf", _field_keys()).unionByName(_met(headed, "rest", _head_keys())), "line-keys")
    several = (
        keyed.groupBy("key", "row").agg(F.first("doc").alias("doc"), F.first("tokens").alias("tokens"))
        .groupBy("key").agg(F.count(F.lit(1)).alias("docs"), F.min("doc").alias("key_doc"), F.max("doc").alias("_last"), F.first("tokens").alias("tokens"))
        .filter(when.reached("docs")).filter("key_doc != _last").select("key", "key_doc")
    )
    return keyed.join(cut_lineage(several), "key").filter("doc != key_doc").select("row", "line")


def recurring_lines(lines: DataFrame, when: Recurrence = RECURRENCE) -> DataFrame:
    """``(row, line)`` of the lines to drop.

    Templates are aggregated to a row each, so one that a large part of all documents holds is combined
    before the shuffle; the join back streams the lines against one row per template. Lines that are not
    equal when masked meet by what they agree in: see ``_lines_alike``.
    """
    # Lines without an id are of one document, which comes first.
    lines = lines.withColumn("doc", F.coalesce("doc", F.lit(-(1 << 63))))
    several = (
        lines.groupBy("template")
        .agg(F.count_if("template_first").alias("docs"), F.min("doc").alias("template_doc"), F.max("doc").alias("_last"), F.first("tokens").alias("tokens"))
        .filter(when.reached("docs")).filter("template_doc != _last").select("template", "template_doc")
    )
    by_template = lines.select("row", "line", "doc", "template").join(cut_lineage(several), "template").filter("doc != template_doc")
    return by_template.select("row", "line").unionByName(_lines_alike(lines, when))


@F.pandas_udf(T.StringType())
def _without(bodies: pd.Series, dropped: pd.Series) -> pd.Series:
    """Texts without the numbered lines; no numbers: as they are."""
    out = []
    for body, numbers in zip(bodies, dropped, strict=True):
        if body is not None and numbers is not None:
            gone = set(numbers.tolist())
            body = "\n".join(x for i, x in enumerate(body.split("\n")) if i not in gone)
        out.append(body)
    return pd.Series(out, dtype=object)


# Evaluated once, also where its result is filtered: a second copy would take a second worker per task.
_without = _without.asNondeterministic()


def drop_recurring_lines(docs: DataFrame, id_column: str = "doc_id", text: str = "text", when: Recurrence = RECURRENCE) -> DataFrame:
    """``docs`` with recurring lines taken out of ``text``, and counts ``n_lines`` and ``n_dropped``.

    A line's template comes from a tree of fixed depth: its token count, then its leading tokens. Tokens that
    look variable are wildcards throughout. In a leaf, lines that agree in six of eight fields (three quarters)
    have a template, as many as there are such groups; a name among the leading tokens is a wildcard if all the
    rest agrees. A template that recurs across documents (``when``) is kept in the document with the smallest id
    and dropped everywhere else, so what is repeated stays once. Rows that share an id, or have none, are one
    document: their lines alone never make a template recur. Lines are parted by line feeds; blank lines stay.
    Rows and other columns stay; null texts stay null. ``n_lines`` counts the lines before.

    ``docs`` must be a stored table with whole numbers as ids (see ``with_row``).
    """
    keyed, row = with_row(docs)
    lines = _lines(keyed, row, id_column, text, when.min_tokens)
    taken = [*keyed.columns]
    drop, n_lines, n_dropped = (free_name(taken, c) for c in ("_drop", "n_lines", "n_dropped"))
    drops = recurring_lines(lines, when).groupBy(F.col("row").alias(row)).agg(F.collect_set("line").alias(drop))
    joined = keyed.join(drops, row, "left")
    body = F.col(f"`{text}`")
    lines_of = F.length(body) - F.length(F.replace(body, F.lit("\n"), F.lit(""))) + 1
    return joined.select(
        *[(_without(body, F.col(drop)) if c == text else F.col(f"`{c}`")).alias(c) for c in docs.columns],
        F.coalesce(lines_of, F.lit(0)).cast("long").alias(n_lines),
        F.coalesce(F.array_size(drop), F.lit(0)).cast("long").alias(n_dropped),
    )


def keep_new_text(docs: DataFrame, id_column: str = "doc_id", text: str = "text", length: str = "n_chars") -> DataFrame:
    """``docs`` without recurring lines, and without the documents that had words and have none left.

    ``length`` is set to the characters of a text that has changed, if there is such a column.
    """
    found = drop_recurring_lines(docs, id_column, text)
    n_dropped = F.col(found.columns[-1])
    body = F.col(f"`{text}`")
    kept = found.filter((n_dropped == 0) | F.coalesce(body.rlike(r"\S"), F.lit(True)))
    changed = F.when(n_dropped > 0, F.length(body).cast(docs.schema[length].dataType)).otherwise(F.col(f"`{length}`")) if length in docs.columns else None
    return kept.select(*[changed.alias(c) if c == length else F.col(f"`{c}`") for c in docs.columns])
