from __future__ import annotations

import random

import pytest

from attestra.operators import affixes, compliance
from tests.conftest import rows_of


def brute(wanted, known):
    out = set()
    for scope, text in set(wanted):
        near = [(o, i) for s, t, o, i in known if s == scope and t and text and (text.endswith(t) or t.endswith(text))]
        if near:
            out.add((scope, text, *min(near, key=lambda e: (e[0] is not None, e[0] or 0, e[1]))))
    return out


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_equals_brute_force(spark, ranges):
    rng = random.Random(ranges)
    text = lambda: "".join(rng.choices("ab/é", [5, 3, 1, 1], k=rng.randrange(0, 9)))
    chain = ["a" * n for n in range(1, 60)]
    scopes = ["hot", "hot", "p", None]
    wanted = [(rng.choice(scopes[:3]), text()) for _ in range(250)] + [("hot", t) for t in chain[::2]] + [("q", "a"), ("q", None)]
    known = [(rng.choice(scopes[:3]), text(), rng.choice([None, *range(9)]), f"E{i}") for i in range(250)]
    known += [("hot", t, 100 - i, f"C{i}") for i, t in enumerate(chain[1::2])] + [("hot", None, 1, "null")]
    out = affixes.first_by_suffix(
        spark.createDataFrame(wanted, "project_id string, text string"),
        spark.createDataFrame(known, "project_id string, text string, ord int, id string"), ranges=ranges,
    )
    assert rows_of(out, "project_id", "text", "ord", "id") == brute([w for w in wanted if w[1] is not None], [k for k in known if k[1] is not None])


def test_one_text_ends_everything(spark):
    """Its answers come from every range."""
    known = [(f"{i:04}/src/a.py", 5000 - i, f"E{i}") for i in range(3000)]
    wanted = [("a.py",), ("src/a.py",), ("0042/src/a.py",), ("x/0042/src/a.py",), ("b.py",)]
    out = affixes.first_by_suffix(
        spark.createDataFrame(wanted, "text string"), spark.createDataFrame(known, "text string, ord int, id string"), ranges=16, scope=(),
    )
    assert rows_of(out, "text", "id") == {("a.py", "E2999"), ("src/a.py", "E2999"), ("0042/src/a.py", "E42"), ("x/0042/src/a.py", "E42")}


def test_no_rows(spark):
    empty = spark.createDataFrame([], "project_id string, text string")
    assert affixes.first_by_suffix(empty, spark.createDataFrame([("p", "a", 1, "E")], "project_id string, text string, ord int, id string")).collect() == []
    assert affixes.first_by_suffix(empty, spark.createDataFrame([], "project_id string, text string, ord int, id string")).collect() == []


def test_plan_has_no_nested_loop(spark):
    path = spark.createDataFrame([(f"/r/{i}.py",) for i in range(50)], "path string")
    evidence = spark.createDataFrame([(f"{i}.py", f"E{i}", i) for i in range(50)], "source_path string, evidence_id string, ord int")
    out = compliance.evidence_for_paths(path, evidence, scope=())
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert out.count() == 50
