"""Text expressions: references, paths, titles, time stamps, declarations inside texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestra.functions.ids import as_column


def without_fragment(ref: Column) -> Column:
    """``src/a.py#L1-L9`` -> ``src/a.py``."""
    return F.substring_index(ref, "#", 1)


def file_of(ref: Column) -> Column:
    """File a reference points to, without line range and test node."""
    return F.substring_index(without_fragment(ref), "::", 1)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Last suffix of the file name with its dot, empty for none and for dot files."""
    return F.regexp_extract(path, r"[^/](\.[^./]+)$", 1)


def relative_path(path: Column, root: Column) -> Column:
    """Path below ``root`` as a relative path, any other path unchanged."""
    base = F.regexp_replace(root, "/+$", "")
    below = F.startswith(path, F.concat(base, F.lit("/")))
    return (
        F.when(below, F.substr(path, F.length(base) + 2)).when(path == base, ".").otherwise(path)
    )


def clean_title(title: Column) -> Column:
    """Title without leading and trailing colons (ASCII and full width) and spaces."""
    return F.regexp_replace(title, r"(?U)^[\s:：]+|[\s:：]+$", "")


def lines(text: Column) -> Column:
    return F.split(text, r"\r\n|\n|\r")


def covered_ids(text: Column, prefix: str | Column) -> Column:
    """Criterion and requirement ids on the lines that say "covers", upper case, first seen first."""
    pattern = F.concat(
        F.lit(r"(?i)\b(AC-"), as_column(prefix), F.lit(r"-\d+-\d+|REQ-"), as_column(prefix), F.lit(r"-\d+)\b")
    )
    saying = F.filter(lines(text), lambda line: F.lower(line).contains("covers"))
    found = F.transform(saying, lambda line: F.regexp_extract_all(F.upper(line), pattern, F.lit(1)))
    return F.coalesce(F.array_distinct(F.flatten(found)), F.array().cast("array<string>"))


def parse_timestamp(text: Column) -> Column:
    """ISO-8601 text as a timestamp; no zone means UTC, anything unreadable is null."""
    zoned = F.regexp_replace(text, "[zZ]$", "+00:00")
    complete = (
        F.when(zoned.rlike(r"[+-]\d{2}:?\d{2}$"), zoned)
        .when(zoned.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(zoned, F.lit("T00:00:00+00:00")))
        .otherwise(F.concat(zoned, F.lit("+00:00")))
    )
    return F.try_to_timestamp(complete)


def iso_timestamp(moment: Column) -> Column:
    """UTC rendering with microseconds; the session time zone must be UTC."""
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def first_sentence(text: Column) -> Column:
    return F.when(F.instr(text, "。") > 1, F.substring_index(text, "。", 1)).otherwise(text)


def clip(text: Column, length: int = 80) -> Column:
    return F.substring(text, 1, length)


def fill(template: str | Column, **values: Column) -> Column:
    """``{name}`` placeholders replaced; a null value leaves the empty string."""
    out = as_column(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def hint_level(hint: Column, level: Column) -> Column:
    """Text of one level of a ``map<level, text>``, else of level 1, else empty."""
    return F.coalesce(F.try_element_at(hint, level), F.try_element_at(hint, F.lit("level1")), F.lit(""))


# Words in a criterion's title that call for a kind of test.
SCENARIO_WORDS = {
    "invalid_input": ("无效", "错误", "invalid", "error"),
    "empty_input": ("空", "empty"),
    "valid_input": ("正常", "valid", "正确"),
}


def test_scenarios(title: Column) -> Column:
    """Kinds of test a criterion's title asks for; ``default`` where it names none."""
    tags = []
    for tag, words in SCENARIO_WORDS.items():
        hit = F.lit(False)
        for word in words:
            hit = hit | F.contains(title, F.lit(word))
        tags.append(F.when(hit, F.lit(tag)))
    found = F.array_compact(F.array(*tags))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("default")))

