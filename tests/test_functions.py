"""Column functions: ids, texts, times, statuses, hashes."""

import datetime as dt
import hashlib

from pyspark.sql import functions as F

from attestra.functions import hashing, ids, source_code, status, text as tx
from tests.conftest import rows_of


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_id_grammar(spark):
    cases = {
        "AC-P-1-2": ("AC", None), "DOD-P-1-2": ("DOD", None), "REQ-P-1": ("REQ", None), "PROJECT-P": ("PROJECT", None), " TASK-P-7 ": ("TASK", None),
        "AC-P-1": (None, "malformed"), "REQ-Q-1": (None, "malformed"), "PROJECTX": (None, "malformed"), "REQ": (None, "malformed"),
        "DOC-P-1": (None, "unknown"), "": (None, "empty"), "  ": (None, "empty"), None: (None, "empty"), "REQ-P-1x": (None, "malformed"),
    }
    df = spark.createDataFrame([(k, "P") for k in cases], "id string, prefix string")
    for prefix in ("P", F.col("prefix")):
        got = df.select("id", ids.id_type(F.col("id"), prefix), ids.id_problem(F.col("id"), prefix)).collect()
        assert {r[0]: (r[1], r[2]) for r in got} == cases


def test_parent_number_and_template(spark):
    assert values(spark, [("AC-A_b-1-2",), ("AC-1",), (None,)], "a string", ids.parent_requirement(F.col("a"))) == ["REQ-A_b-1", None, None]
    assert values(spark, [("RISK-P-012",), ("RISK-Q-5",), ("x",)], "a string", ids.id_number(F.col("a"), "RISK", "P")) == [12, None, None]
    assert values(spark, [("CLAIM-P-9999",), ("CLAIM-P-1",), (None,)], "a string", ids.is_template(F.col("a"))) == [True, False, False]
    assert values(spark, [(7,), (1234,)], "a int", ids.numbered_id("EVIDENCE", "P", F.col("a"))) == ["EVIDENCE-P-007", "EVIDENCE-P-1234"]


def test_decision_keys(spark):
    def legacy(category, target):
        h = 0
        for ch in f"{category}:{target}":
            h = (h * 31 + ord(ch)) & 0xFFFFFFFF
        return f"DEC-{h:04X}"[:8]

    cases = [("uncovered_ac", "AC-P-1-1"), ("a", ""), ("", ""), ("stale_debt", "需求"), ("x" * 40, "y" * 40)]
    got = values(spark, cases, "c string, t string", ids.decision_key(F.col("c"), F.col("t"), compat=True))
    assert got == [legacy(*c) for c in cases]
    wide = values(spark, [("uncovered_ac", str(i)) for i in range(2000)], "c string, t string", ids.decision_key(F.col("c"), F.col("t")))
    assert len(set(wide)) == 2000


def test_paths(spark):
    refs = [("src/a.py#L1-L2",), ("t/a.py::test_x",), ("t/a.py::test_x#L1",), ("a",), ("",)]
    assert values(spark, refs, "a string", tx.file_of(F.col("a"))) == ["src/a.py", "t/a.py", "t/a.py", "a", ""]
    names = [("a.py",), ("d.x/b",), (".bashrc",), ("a.tar.gz",), ("d/.env.py",), ("",)]
    assert values(spark, names, "a string", tx.extension(F.col("a"))) == [".py", "", "", ".gz", ".py", ""]
    roots = [("/r/a/b", "/r"), ("/r/a/b", "/r/"), ("/rx/a", "/r"), ("/r", "/r"), ("rel/a", "/r")]
    assert values(spark, roots, "a string, r string", tx.relative_path(F.col("a"), F.col("r"))) == ["a/b", "a/b", "/rx/a", ".", "rel/a"]


def test_covers_titles_and_sentences(spark):
    doc = "Checks login.\nCovers: ac-p-1-2, REQ-P-3 and AC-P-1-2\nAC-P-9-9 elsewhere\r\nthis covers xAC-P-1-1 REQ-Q-1"
    assert values(spark, [(doc,), (None,), ("",)], "a string", tx.covered_ids(F.col("a"), "P")) == [["AC-P-1-2", "REQ-P-3"], [], []]
    assert values(spark, [(" ： :Login: ：",), ("a:b",), ("::",)], "a string", tx.clean_title(F.col("a"))) == ["Login", "a:b", ""]
    assert values(spark, [("一。二。",), ("abc",), ("。x",)], "a string", tx.first_sentence(F.col("a"))) == ["一", "abc", "。x"]
    assert values(spark, [(5, None)], "a int, b string", tx.fill("{x}-{y}-{z}", x=F.col("a"), y=F.col("b"))) == ["5--{z}"]
    hints = [({"level1": "one", "level3": "three"}, "level3"), ({"level1": "one"}, "level3"), ({}, "level1"), (None, "level1")]
    assert values(spark, hints, "h map<string,string>, l string", tx.hint_level(F.col("h"), F.col("l"))) == ["three", "one", "", ""]
    titles = [("valid login",), ("invalid input",), ("空值",), ("other",), (None,)]
    assert values(spark, titles, "a string", tx.test_scenarios(F.col("a"))) == [["valid_input"], ["invalid_input", "valid_input"], ["empty_input"], ["default"], ["default"]]


def test_times(spark):
    utc = dt.datetime(2024, 1, 2, 3, 4, 5)
    stamps = [("2024-01-02T03:04:05Z",), ("2024-01-02T05:04:05+02:00",), ("2024-01-02T03:04:05",), ("2024-01-02",), ("soon",), ("",), (None,)]
    got = values(spark, stamps, "a string", tx.iso_timestamp(tx.parse_timestamp(F.col("a"))))
    assert got == ["2024-01-02T03:04:05.000000Z"] * 3 + ["2024-01-02T00:00:00.000000Z", None, None, None]
    as_of = F.lit("2024-03-01 12:00:00").cast("timestamp")
    at = [("2024-01-31 12:00:00",), ("2024-01-30 12:00:00",), ("2024-01-30 12:00:01",), ("2023-01-01 00:00:00",), (None,)]
    stale = values(spark, at, "a string", status.is_stale_acceptance(F.col("a").cast("timestamp"), as_of))
    assert stale == [False, True, False, True, False]  # 30 days, 31 days, just under 31
    assert utc.year == 2024


def test_statuses(spark):
    task = [("todo",), ("in_progress",), ("blocked",), ("done",), ("cancelled",), (None,)]
    assert values(spark, task, "a string", status.task_evidence_status(F.col("a"))) == ["missing", "partial", "blocked", "covered", "unclear", "unclear"]
    runs = [("test", 0), ("test", 1), ("test", 2), ("test", 5), ("test", 3), ("lint", 2), ("type_check", 2), ("security", 9)]
    got = values(spark, runs, "c string, e int", status.exit_outcome(F.col("c"), F.col("e")))
    assert [g and (g.status, g.error_code) for g in got] == [
        None, None, ("skipped", "tool_usage_error"), ("skipped", "tool_no_tests_collected"), ("blocked", "tool_execution_failed"),
        ("blocked", "tool_execution_failed"), ("skipped", "tool_usage_error"), ("blocked", "tool_execution_failed")]


def test_hashes(spark):
    df = spark.createDataFrame([("C1", "n", None, "old"), ("C1", "n", "later", None), ("C1", "m", None, None)], "claim_id string, notes string, claimed_ts string, content_hash string")
    a, b, c = [r.content_hash for r in hashing.with_content_hash(df).collect()]
    assert a == b != c and len(a) == 16
    swapped = df.select("notes", "content_hash", "claim_id", "claimed_ts")
    assert rows_of(hashing.with_content_hash(swapped), "content_hash") == {(a,), (c,)}
    assert values(spark, [(b"abc",)], "a binary", hashing.file_hash(F.col("a"))) == [hashlib.sha256(b"abc").hexdigest()]
    same = values(spark, [('{"b": 1, "a": [1, 2]}',), ('{"a":[1,2],"b":1}',), ("{",)], "a string", hashing.canonical_json(F.col("a")))
    assert same[0] == same[1] and same[2] is None


def test_imports(spark):
    source = "import os, a.b as c\nfrom x.y import z\nfrom . import q\nfrom .rel import w\n  import late\nimportant = 1\n# import no\nfrom x import (a,\n"
    (found,) = values(spark, [(source,)], "a string", source_code.import_lines(F.col("a")))
    assert [(f.imported_module, f.lineno) for f in found] == [("os", 1), ("a.b", 1), ("x.y", 2), ("rel", 4), ("late", 5), ("x", 8)]
