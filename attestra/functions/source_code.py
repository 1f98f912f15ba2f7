"""Imports of Python sources, as the interpreter sees them.

One regular expression is the lexer: from a place in code it takes a string, a comment, a continued line, line breaks or an import
statement as a whole, and passes over everything else. What is inside a string or a comment is therefore never
read as code. All repetitions are possessive, so a string of any length takes no stack. One aggregate goes over the
lexer's tokens, counts lines and gathers the imports.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"(?:[ \t\f]|\\\n)"
NAME = rf"\w++(?:{BLANK}*+\.{BLANK}*+\w++)*+"
ALIAS = rf"(?:{BLANK}++as\b{BLANK}++\w++)?+"
PLAIN = rf"import\b{BLANK}++{NAME}{ALIAS}(?:{BLANK}*+,{BLANK}*+{NAME}{ALIAS})*+"
FROM = rf"from\b(?:{BLANK}|\.)*+({NAME}){BLANK}*+\bimport\b"
#: A statement starts a line or follows a semicolon or the colon of a compound statement.
LEAD = rf"(?:^|[;:]){BLANK}*+"


def _string(quote: str) -> str:
    """A string up to its quotes; the end of its line (or of the text, if it is a long one) ends an open string."""
    if len(quote) == 3:
        return rf"{quote}(?:[^{quote[0]}\\]++|\\[\s\S]|{quote[0]}(?!{quote[:2]}))*+(?:{quote})?+"
    return rf"{quote}(?:[^{quote}\\\n]++|\\[\s\S])*+{quote}?+"


FLAGS = "(?mdU)"
TOKEN = FLAGS + "|".join([
    rf"{LEAD}(?:{PLAIN}|{FROM})", *map(_string, ('"""', "'''", '"', "'")), r"#[^\n]*+", r"\\\n", r"\n++",
])
#: The same in front of a token.
HEAD = rf"{FLAGS}\A[;:]?+{BLANK}*+"
IMPORT = rf"{HEAD}(?:import|from)\b"


def line_breaks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def tokens(source: Column) -> Column:
    """Strings, comments, line breaks and import statements of a source, in order."""
    unix = F.regexp_replace(F.regexp_replace(source, "^\ufeff", ""), "\r\n?", "\n")
    return F.regexp_extract_all(unix, F.lit(TOKEN), F.lit(0))


def _modules(token: Column) -> Column:
    """Modules an import statement names. A relative import without a module name has none."""
    flat = F.regexp_replace(token, r"\\\n", " ")
    plain = F.transform(
        F.split(F.regexp_extract(flat, r"\bimport\b([\s\S]*)", 1), ","),
        lambda name: F.regexp_replace(F.regexp_replace(name, r"(?U)\s+as\s+\w+\s*$", ""), r"\s", ""),
    )
    source = F.regexp_replace(F.regexp_extract(flat, r"(?s)\bfrom\b[\s.]*(.*?)\s*\bimport$", 1), r"\s", "")
    return F.when(flat.rlike(rf"{HEAD}from\b"), F.array(source)).otherwise(plain)


def import_lines(source: Column) -> Column:
    """Imports of a Python source as ``array<struct<imported_module, lineno>>``, in order.

    Imports in strings, docstrings and comments do not count; continued lines, several statements in a line,
    aliases, relative imports and lists in brackets do, with the line of the statement's keyword. Strings
    inside the braces of a formatted string may use its own quotes only where that does not unbalance
    them. A source that is no valid Python is read as far as it can be, and a null one has no imports.
    """
    none = F.array().cast("array<struct<imported_module:string,lineno:int>>")
    start = F.struct(F.lit(1).alias("line"), none.alias("found"))

    def step(state: Column, token: Column) -> Column:
        keyword = state["line"] + line_breaks(F.regexp_extract(token, HEAD, 0))
        found = F.when(
            token.rlike(IMPORT),
            F.concat(state["found"], F.transform(_modules(token), lambda m: F.struct(m.alias("imported_module"), keyword.cast("int").alias("lineno")))),
        ).otherwise(state["found"])
        return F.struct((state["line"] + line_breaks(token)).cast("int").alias("line"), found.alias("found"))

    telling = F.filter(tokens(source), lambda t: t.contains("\n") | t.rlike(IMPORT))
    return F.coalesce(F.aggregate(telling, start, step, lambda state: state["found"]), none)
