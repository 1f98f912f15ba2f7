"""Impact of a change, revision deltas, drift, upserts."""

import datetime as dt


from attestra.functions.hashing import with_content_hash
from attestra.operators import delta, impact
from attestra.plans.queries import REGISTRY
from tests.conftest import list_of, rows_of


def test_three_hops(table):
    out = impact.affected_items(
        table("path string", ["a.py"]),
        table("claim_id string, related_task string", [("C1", "T1"), ("C2", "T2")]),
        table("claim_id string, ref string", [("C1", "a.py#L1"), ("C1", "b.py"), ("C2", "b.py")]),
        table("task_id string, item_type string, item_id string", [("T1", "requirement", "R1"), ("T1", "ac", "A1"), ("T2", "ac", "A2")]),
    )
    assert rows_of(out, "item_type", "item_id") == {("claim", "C1"), ("task", "T1"), ("requirement", "R1"), ("ac", "A1")}


def test_stale_marking(table):
    gap = table("item_type string, item_id string", [("claim", "C1"), ("claim", "C2"), ("ac", "A1"), ("requirement", "R9"), ("other", "x")])
    affected = table("item_type string, item_id string", [("claim", "C1"), ("ac", "A1")])
    changed = table("path string", ["a.py"])
    marked = impact.mark_stale_gaps(gap, affected, changed)
    assert rows_of(marked.filter("stale"), "item_id") == {("C2",), ("R9",)}
    assert impact.active(marked).count() == 3
    # Without changed files everything is analysed.
    assert impact.mark_stale_gaps(gap, affected.filter("false"), changed.filter("false")).filter("stale").count() == 0
    risk = table("risk_id string, claim_id string", [("R1", "C1"), ("R2", "C9"), ("R3", None)])
    stale = impact.mark_stale_risks(risk, affected, changed)
    assert rows_of(stale.filter("stale"), "risk_id") == {("R2",)}
    assert rows_of(impact.stale_counts(stale), "n_stale", "n_total") == {(1, 3)}


def test_change_scope(table):
    rows = table("risk_id string, claim_id string", [("R1", "C1"), ("R2", "C2"), (None, None)])
    affected = table("item_id string", ["C1"])
    tagged = impact.tag_current(rows, affected, ["risk_id", "claim_id"])
    assert rows_of(tagged, "risk_id", "change_scope") == {("R1", "current"), ("R2", "pre_existing"), (None, "pre_existing")}
    assert rows_of(impact.tag_current(rows, None, ["risk_id"]), "change_scope") == {("all",)}
    # An empty set that was given means nothing is current; a project without changes is analysed whole.
    assert rows_of(impact.tag_current(rows, affected.filter("false"), ["risk_id"]), "change_scope") == {("pre_existing",)}
    calm = impact.tag_current(rows, affected, ["claim_id"], changed=table("path string", []))
    assert rows_of(calm, "change_scope") == {("all",)}


def claims(table, rows):
    return with_content_hash(table("claim_id string, code_refs array<string>, notes string, ord bigint", rows))


def test_claim_and_keyed_delta(table):
    head = claims(table, [("C1", ["a"], None, 1), ("C2", ["b"], "x", 2)])
    staged = claims(table, [("C1", ["a"], None, 9), ("C2", ["b"], "y", 2), ("C3", ["c"], None, 3), ("CLAIM-P-9999", ["d"], None, 4)])
    assert rows_of(delta.active_claims(staged, head), "claim_id") == {("C2",), ("C3",)}
    assert rows_of(delta.keyed_delta(staged, head, key="claim_id"), "claim_id", "change") == {
        ("C2", "modified"), ("C3", "new"), ("CLAIM-P-9999", "new")}
    assert delta.active_claims(staged, head.filter("false")).count() == 3


def test_rule_diff(table):
    schema = "section string, rule_id string, body_hash string"
    out = delta.rule_diff(table(schema, [("s", "1", "a"), ("s", "2", "a"), ("s", "3", "a")]), table(schema, [("s", "1", "a"), ("s", "2", "b"), ("s", "4", "a")]))
    assert rows_of(out, "action", "path") == {("modify", "s.2"), ("delete", "s.3"), ("add", "s.4")}


def test_document_diff(table):
    base = '{"a": {"b": 1, "c": {"d": [1, 2]}}, "rules": [{"rule_id": "r1", "x": 1, "y": 2}, {"rule_id": "r2"}], "gone": true, "o": {}}'
    same = '{"rules": [{"y": 2, "x": 1, "rule_id": "r1"}, {"rule_id": "r2"}], "gone": true,\n "a": {"c": {"d": [1, 2]}, "b": 1}, "o": {}}'
    other = '{"a": {"b": 2, "c": {"d": [1, 3]}}, "rules": [{"rule_id": "r1", "x": 9, "y": 2}, {"rule_id": "r3"}], "new": null, "o": {}}'
    docs = table("text string", [base])
    assert delta.document_diff(docs, table("text string", [same])).count() == 0
    out = delta.document_diff(docs, table("text string", [other]))
    assert rows_of(out, "path", "rule_id", "action") == {
        ("a.b", None, "modify"), ("a.c.d", None, "modify"), ("rules.r1", "r1", "modify"), ("rules.r2", "r2", "delete"),
        ("rules.r3", "r3", "add"), ("gone", None, "delete"), ("new", None, "add")}


DIFFERENCES = {
    "type": ('{"a":"1"}', '{"a":1}', {("a", None, "modify")}),
    "text that looks like an object": ('{"s":"{\\"k\\":1}"}', '{"s":{"k":1}}', {("s", None, "modify")}),
    "dot in a key": ('{"a.b":1}', '{"a":{"b":1}}', {("a.b", None, "delete"), ("a", None, "add")}),
    "empty list": ('{"rules":[]}', '{"rules":[{"rule_id":"R1"}]}', {("rules.R1", "R1", "add")}),
    "emptied object": ('{"n":{"p":1}}', '{"n":{}}', {("n.p", None, "delete")}),
    "subtree": ('{}', '{"t":{"u":{"v":1},"w":[1]}}', {("t", None, "add")}),
    "repeated id": ('{"r":[{"rule_id":"A","x":1},{"rule_id":"A","x":2}]}', '{"r":[{"rule_id":"A","x":2}]}', set()),
    "other id key": ('{"r":[{"rule_id":"R1"}]}', '{"r":[{"gate_id":"R1"}]}', {("r", None, "modify")}),
    "deep": ('{"a":{"b":{"c":{"d":{"e":{"f":{"g":{"h":{"i":1,"j":2}}}}}}}}}', '{"a":{"b":{"c":{"d":{"e":{"f":{"g":{"h":{"i":1,"j":3}}}}}}}}}', {("a.b.c.d.e.f.g.h.j", None, "modify")}),
    "id types": ('{"r":[{"rule_id":1}]}', '{"r":[{"rule_id":"1"}]}', {("r.1", "1", "add"), ("r.1", "1", "delete")}),
    "null": ('{"a":null}', '{"a":null}', set()),
    "null against nothing": ('{"a":null}', '{}', {("a", None, "delete")}),
    "list order": ('{"l":[1,2]}', '{"l":[2,1]}', {("l", None, "modify")}),
    "mixed list": ('{"l":[{"rule_id":"a"},1]}', '{"l":[{"rule_id":"a"},2]}', {("l", None, "modify")}),
    "not an object": ('[1]', '{"a":1}', {("", None, "modify")}),
    "broken": ('{"a":', '{"a":1}', {("a", None, "add")}),
}


def test_repeated_keys_and_deep_documents(spark):
    deep = '{"a":' * 130 + "%d" + "}" * 130
    pairs = [('{"a":1,"a":2}', '{"a":2}'), ('{"a":1,"a":2}', '{"a":1}'), ('{"b":{"k":1,"k":{"x":3}}}', '{"b":{"k":{"x":4}}}'), (deep % 1, deep % 2)]
    sides = [spark.createDataFrame([(i, p[n]) for i, p in enumerate(pairs)], "project_id int, text string") for n in (0, 1)]
    found = rows_of(delta.document_diff(*sides), "project_id", "path", "action")
    assert found == {(1, "a", "modify"), (2, "b.k.x", "modify"), (3, ".".join(["a"] * 130), "modify")}


def test_structural_differences(spark):
    sides = [spark.createDataFrame([(name, case[i]) for name, case in DIFFERENCES.items()], "project_id string, text string") for i in (0, 1)]
    found = rows_of(delta.document_diff(*sides), "project_id", "path", "rule_id", "action")
    assert found == {(name, *row) for name, case in DIFFERENCES.items() for row in case[2]}


def test_repeated_rules_do_not_differ(table):
    schema = "section string, rule_id string, body_hash string, ord bigint"
    rules = table(schema, [("s", "1", "a", 1), ("s", "1", "b", 2)])
    assert delta.rule_diff(rules, rules).count() == 0
    assert rows_of(delta.rule_diff(rules, table(schema, [("s", "1", "a", 5), ("s", "1", "c", 4)])), "action") == {("modify",)}


CONFIG = ("architecture_constraints_hash string, prd_hash string, finalize_git_commit string, finalize_constraints_path string, "
          "language string, validation_tools array<string>")


def test_baseline_drift(spark):
    config = spark.createDataFrame(
        [("none", "h", "q", "c", "p", "py", []), ("unset", None, None, None, None, None, []), ("bare", "x", "p", None, "p", "py", []),
         ("lost", "x", "p", "c", "p", "py", []), ("format", "x", "p", "c", "p", "py", []), ("changed", "x", "p", "c", "p", "py", [])],
        f"project_id string, {CONFIG}")
    manifest = spark.createDataFrame(
        [(p, k, v) for p in ("none", "unset", "bare", "lost", "format", "changed") for k, v in (("architecture_constraints", "h"), ("prd", "p"))],
        "project_id string, file_key string, sha256 string")
    diff = spark.createDataFrame([("changed",), ("changed",), ("none",)], "project_id string")
    baseline = spark.createDataFrame([("format",), ("changed",), ("none",)], "project_id string")
    drift = delta.baseline_drift(config, manifest, diff, baseline)
    assert rows_of(drift, "project_id", "drift", "n_changes", "requirements_drift") == {
        ("none", "none", 0, True), ("unset", "none", 0, False), ("bare", "no_metadata", 0, False), ("lost", "no_baseline", 0, False),
        ("format", "format_only", 0, False), ("changed", "changed", 2, False)}
    assert delta.drift_risks(drift).count() == 4
    assert list_of(delta.drift_gaps(drift), "project_id", "item_type") == [("changed", "architecture_constraints_changed")]
    log = spark.createDataFrame([("changed", "docs/architecture_change_log.md")], "project_id string, path string")
    assert rows_of(delta.undocumented_changes(drift, log), "project_id") == {("lost",)}
    assert rows_of(delta.undocumented_changes(drift, log.filter("false")), "project_id") == {("lost",), ("changed",)}


def test_lock_baseline(spark):
    config = spark.createDataFrame(
        [("new", None, None, None, None, None, None), ("same", "h", "p", "c", "p", "py", ["test", "lint"]),
         ("late", "x", "p", "c", "p", "py", ["lint", "test"]), ("moved", "h", "p", "c", "p", "js", []), ("tools", "h", "p", "c", "p", "py", ["lint"])],
        f"project_id string, {CONFIG}")
    names = ("new", "same", "late", "moved", "tools", "nolang", "unknown")
    proposal = spark.createDataFrame(
        [(n, {"nolang": None, "unknown": "go"}.get(n, "py"), ["py", "js"], ["lint", "test"], "h", "p") for n in names],
        "project_id string, language string, tool_languages array<string>, tools array<string>, rules_hash string, prd_hash string")
    late = spark.createDataFrame([("late",)], "project_id string")
    out = delta.lock_baseline(config, proposal, late)
    assert rows_of(out, "project_id", "outcome") == {
        ("new", "locked"), ("same", "unchanged"), ("late", "undocumented_change"), ("moved", "language_conflict"),
        ("tools", "locked"), ("nolang", "language_missing"), ("unknown", "language_unknown")}
    assert out.filter("project_id = 'late'").first().architecture_constraints_hash == "x"


def test_acceptance(table):
    rule = table("rule_id string, accepted_by string, accepted_at timestamp", [("r1", None, None), ("r2", "old", dt.datetime(2020, 1, 1)), ("r3", "", None)])
    req = table("rule_id string, accepted_by string, accepted_at timestamp",
                [("r1", "b", dt.datetime(2021, 1, 2)), ("r1", "a", dt.datetime(2021, 1, 1)), ("r2", "new", dt.datetime(2022, 1, 1)), ("r9", "x", None)])
    out = delta.accept_rules(rule, req)
    assert rows_of(out, "rule_id", "accepted_by") == {("r1", "a"), ("r2", "old"), ("r3", None)}
    assert rows_of(delta.accept_rules(out, req), "rule_id", "accepted_by") == {("r1", "a"), ("r2", "old"), ("r3", None)}
    assert rows_of(delta.unknown_acceptances(rule, req), "rule_id") == {("r9",)}


def test_reuse_and_carry_over(table):
    day = lambda d: dt.datetime(2024, 1, d)
    schema = "source_path string, source_type string, status string"
    new = table(schema, [("a.py", "test", "new"), ("b.py", "test", "new"), ("c.py", "test", "new")])
    old = table(schema, [("a.py#L1", "test", "old"), ("b.py", "test", "old"), ("d.py", "test", "old")])
    files = table("path string, modified_at timestamp", [("a.py", day(1)), ("b.py", day(3)), ("c.py", day(1))])
    out = delta.reuse_or_regenerate(new, old, files, table("scan_time timestamp", [(day(3),)]))
    assert rows_of(out, "source_path", "status") == {("a.py#L1", "old"), ("b.py", "new"), ("c.py", "new")}

    old = table(f"{schema}, tool_category string", [
        ("a.py", "test", "x", None), ("z.py", "test", "x", None), ("z.py", "tool", "x", "coverage"), ("y.py", "tool", "x", "lint"), ("y.py", "task", "x", None)])
    carried = delta.carry_over(old, new)
    assert rows_of(carried, "source_path", "source_type", "carried_over") == {("z.py", "test", True), ("z.py", "tool", True)}


def test_drift_is_computed_once(spark, tmp_path):
    """Three kinds of findings read it; their union ran the joins of all of them in each of its tasks."""
    spark.createDataFrame(
        [(i, 3 + i % 3, float(i * 1000 - 2000), "BUILDING") for i in range(10)],
        "c_custkey long, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame(
        [(i % 10, "F", 1000.0 * i * i) for i in range(30)], "o_custkey long, o_orderstatus string, o_totalprice double"
    ).write.parquet(f"{tmp_path}/orders.parquet")
    out = REGISTRY["drift_findings"](spark, str(tmp_path))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("c_acctbal") == 0 and plan.count("Join") <= 1
    assert out.count() > 0


def test_hashes_of_a_manifest_by_key(spark):
    """Other keys do not count, a repeated key counts with its greatest hash, a project without a manifest has not drifted."""
    config = spark.createDataFrame(
        [(p, "x", "p", "c", "p", "py", []) for p in ("both", "rules", "other", "gone")], f"project_id string, {CONFIG}")
    manifest = spark.createDataFrame(
        [("both", "architecture_constraints", "a"), ("both", "architecture_constraints", "x"), ("both", "prd", None), ("both", "prd", "p"),
         ("rules", "architecture_constraints", "a"), ("other", "notes", "z"), (None, "prd", "q")],
        "project_id string, file_key string, sha256 string")
    drift = delta.baseline_drift(config, manifest)
    assert rows_of(drift, "project_id", "drift", "requirements_drift") == {
        ("both", "none", False), ("rules", "format_only", False), ("other", "none", False), ("gone", "none", False)}
