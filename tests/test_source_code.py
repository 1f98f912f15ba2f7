from __future__ import annotations

import ast
import random

import pytest
from pyspark.sql import functions as F

from attestra.functions import source_code

FORMS = [
    "import a", "import a.b as c, d", "from x import y", "from . import z", "from .m import (a,\n   b)", "from .. q import r as s",
    "'''import no\n'''", 'x = "import no"', "# import no 'q", "y = 'it\\'s'", "import e, \\\n  f", "z = [1,\n 2, 'x\\\n import no']",
    '"""a "quoted" \'x\'\nimport no """; import yes', "if 1: import g", "def f():\n    '''doc\n    import no'''\n    import h\n    from i.j import k as l",
    "def g():\n  yield from g()", "import naïve, größe . b", 'w = r"\\\\"; import k', "f'''{x}\nimport no'''", "import a;import b ;from c import(d)",
    "if z:\\\n  import cont", "from t import (  # 'quote\n  u)\nimportant = 1", "\\\nimport os", "class A: from v . w import t",
]


def by_interpreter(source):
    found = []
    for node in ast.walk(ast.parse(source)):
        if isinstance(node, ast.Import):
            found += [(name.name, node.lineno) for name in node.names]
        elif isinstance(node, ast.ImportFrom) and node.module:
            found.append((node.module, node.lineno))
    return sorted(found)


def imports(spark, sources):
    df = spark.createDataFrame(list(enumerate(sources)), "i int, s string").select("i", source_code.import_lines(F.col("s")).alias("f"))
    found = {r.i: sorted((x.imported_module, x.lineno) for x in r.f) for r in df.collect()}
    return [found[i] for i in range(len(sources))]


def test_equal_to_the_interpreter(spark):
    rng = random.Random(1)
    sources = FORMS + ["\n".join(rng.choice(FORMS) for _ in range(rng.randrange(2, 14))) + "\n" for _ in range(200)]
    assert imports(spark, sources) == [by_interpreter(s) for s in sources]


@pytest.mark.parametrize("ends", ["\r\n", "\r"])
def test_line_ends(spark, ends):
    source = "\n".join(FORMS)
    assert imports(spark, [source.replace("\n", ends)]) == [by_interpreter(source)]


def test_long_strings_and_broken_sources(spark):
    long = "'''" + "a\\'b\n" * 100_000 + "'''\nimport deep\n"
    assert imports(spark, [long, "x = '" + "ab" * 200_000 + "'\nimport deep", None, "", "\ufeffimport os"]) == [
        by_interpreter(long), [("deep", 2)], [], [], [("os", 1)],
    ]
    # no valid Python: read as far as it goes
    assert imports(spark, ["import a\n'''open\nimport b\n", "x = 'open\nimport c\n", "please import d\n"]) == [[("a", 1)], [("c", 2)], []]
