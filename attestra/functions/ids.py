"""Identifiers: grammar, numbering format and keys derived from other ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestra.schemas import DOUBLE_ID_KINDS, SENTINEL_NUMBER, SINGLE_ID_KINDS, TEMPLATE_SUFFIX


def as_column(value: str | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def _grammar(prefix: str | Column) -> Column:
    """Regex of all valid ids. ``prefix`` is one literal or a column (one prefix per project)."""
    p = as_column(prefix)
    return F.concat(
        F.lit(rf"^(?:(?:{'|'.join(DOUBLE_ID_KINDS)})-"), p, F.lit(r"-\d+-\d+"),
        F.lit(rf"|(?:{'|'.join(SINGLE_ID_KINDS)})-"), p, F.lit(r"-\d+"),
        F.lit("|PROJECT-"), p, F.lit(")$"),
    )


def is_valid_id(id_: Column, prefix: str | Column) -> Column:
    return F.coalesce(F.rlike(F.trim(id_), _grammar(prefix)), F.lit(False))


def id_type(id_: Column, prefix: str | Column) -> Column:
    """Leading word of a valid id, null for anything else."""
    return F.when(is_valid_id(id_, prefix), F.substring_index(F.trim(id_), "-", 1))


def id_problem(id_: Column, prefix: str | Column) -> Column:
    """``empty``, ``malformed`` (known kind, wrong form), ``unknown`` or null for a valid id."""
    text = F.trim(id_)
    kinds = (*DOUBLE_ID_KINDS, *SINGLE_ID_KINDS, "PROJECT")
    known = F.substring_index(text, "-", 1).isin(*kinds) | text.startswith("PROJECT")
    return (
        F.when(id_.isNull() | (text == ""), "empty")
        .when(is_valid_id(id_, prefix), F.lit(None))
        .when(known, "malformed")
        .otherwise("unknown")
    )


def is_template(id_: Column) -> Column:
    """Template rows are dropped by every reader."""
    return F.coalesce(id_.endswith(TEMPLATE_SUFFIX), F.lit(False))


def parent_requirement(ac_id: Column) -> Column:
    """Requirement a criterion belongs to by its own id, null if the id has another form."""
    form = r"^AC-([a-zA-Z0-9_-]+)-(\d+)-(\d+)$"
    return F.when(ac_id.rlike(form), F.regexp_replace(ac_id, form, "REQ-$1-$2"))


def numbered_id(kind: str, prefix: str | Column, number: Column) -> Column:
    return F.format_string(f"{kind}-%s-%03d", as_column(prefix), number)


def id_number(id_: Column, kind: str, prefix: str | Column) -> Column:
    """Trailing number of an id of this kind and prefix, null for other ids."""
    mine = F.startswith(id_, F.concat(F.lit(f"{kind}-"), as_column(prefix), F.lit("-")))
    return F.when(mine, F.regexp_extract(id_, r"-(\d+)$", 1).try_cast("bigint"))


def sentinel_evidence(prefix: str | Column) -> Column:
    """The id that stands for "no real evidence"."""
    return numbered_id("EVIDENCE", prefix, F.lit(SENTINEL_NUMBER))


def decision_key(category: Column, target: Column, *, compat: bool = False) -> Column:
    """Id of a pending decision.

    ``compat`` gives the four-digit id of older decision logs: a 32-bit ``h * 31 + c`` hash cut to
    its first four hex digits. It has 65,536 values, so different targets collide and one decision
    hides another item; the default is a 64-bit hash.
    """
    key = F.concat_ws(":", category, target)
    if not compat:
        return F.concat(F.lit("DEC-"), F.lpad(F.hex(F.xxhash64(key)), 16, "0"))
    mask = F.lit(0xFFFFFFFF).cast("bigint")
    chars = F.filter(F.split(key, ""), lambda c: c != "")
    code = F.aggregate(
        chars, F.lit(0).cast("bigint"), lambda h, c: (h * 31 + F.ascii(c)).bitwiseAND(mask)
    )
    digits = F.hex(code)
    padded = F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits)
    return F.concat(F.lit("DEC-"), F.substring(padded, 1, 4))
