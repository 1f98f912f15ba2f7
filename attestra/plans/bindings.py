"""Governance entities bound to the sample tables.

The sample tables are a sales schema, so each entity is bound to the table whose shape and size
relations fit it: projects are nations, tasks customers, claims and requirements orders, evidence
links line items, files and rules parts, human decisions events. Every binding is a projection of
whole tables. Keys of the sample tables are unique across projects, so most queries join on them alone
(``scope=()``) and the project is a plain column; evidence is reduced per key before it meets a project.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.session import prepare, split_finely


def text_id(prefix: str, key: str | Column) -> Column:
    return F.concat(F.lit(prefix), (F.col(key) if isinstance(key, str) else key).cast("string"))


def module_file(partkey: str | Column) -> Column:
    """Source file of a part."""
    return F.concat(text_id("src/", partkey), F.lit(".py"))


def size_file(number: Column) -> Column:
    """Test file shared by all parts of one size."""
    return text_id("S", number.cast("int"))


def priority_of(order_priority: str) -> Column:
    level = F.substring(order_priority, 1, 1)
    return (
        F.when(level.isin("1", "2"), "must").when(level == "3", "should").when(level == "5", "could").otherwise("unclear")
    )


class Bound:
    """Entities over one folder of sample tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        prepare(spark)
        split_finely(spark)
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def order_project(self) -> DataFrame:
        """Orders with the project of their customer."""
        customer = self.table("customer").select(
            F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("project_id")
        )
        return self.table("orders").join(customer, "o_custkey")

    # -- requirements, criteria and their covers ---------------------------------------------------

    @cached_property
    def requirement(self) -> DataFrame:
        return self.order_project.select(
            "project_id", F.col("o_orderkey").alias("req_id"), F.col("o_orderstatus").alias("title"),
            priority_of("o_orderpriority").alias("priority"), F.col("o_orderkey").alias("ord"),
        )

    @cached_property
    def criterion(self) -> DataFrame:
        return self.order_project.select(
            "project_id", F.col("o_orderkey").alias("ac_id"), priority_of("o_orderpriority").alias("priority"),
            (F.col("o_totalprice") >= 250000).alias("is_testing_required"), F.col("o_orderkey").alias("ord"),
        )

    def line_cover(self, *, rejected: str) -> DataFrame:
        """Line items as evidence covering their order; ``rejected`` is the status of returned lines."""
        flag = F.col("l_returnflag")
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("item_id"),
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("evidence_id"),
            F.when(flag == "A", "covered").when(flag == "N", "partial").otherwise(rejected).alias("status"),
            F.when(F.col("l_linestatus") == "F", "test").otherwise("task").alias("source_type"),
        )

    @cached_property
    def task_cover(self) -> DataFrame:
        """Every line item taken as task evidence."""
        return self.line_cover(rejected="unclear").withColumn("source_type", F.lit("task"))

    @cached_property
    def test_cover(self) -> DataFrame:
        return self.line_cover(rejected="violated")

    # -- claims and the evidence they cite -----------------------------------------------------------

    @cached_property
    def claim(self) -> DataFrame:
        status = F.col("o_orderstatus")
        return self.table("orders").select(
            text_id("C", "o_orderkey").alias("claim_id"), text_id("K", "o_custkey").alias("related_task"),
            F.when(status == "F", "covered").when(status == "O", "partial").otherwise("compliant").alias("claimed_status"),
            F.col("o_orderkey").alias("ord"), "o_orderdate", "o_totalprice",
        )

    @cached_property
    def evidence_ref(self) -> DataFrame:
        """Citations: by evidence id, node id, the claim itself, or a shared path."""
        flag, line = F.col("l_returnflag"), F.col("l_linestatus")
        ref = (
            F.when(flag == "A", text_id("E", "l_partkey"))
            .when(flag == "N", text_id("N", "l_partkey"))
            .when(line == "O", text_id("C", "l_orderkey"))
            .otherwise(text_id("S", "l_suppkey"))
        )
        return self.table("lineitem").select(
            text_id("C", "l_orderkey").alias("claim_id"), ref.alias("ref"), F.col("l_linenumber").alias("pos")
        )

    @cached_property
    def test_ref(self) -> DataFrame:
        return self.table("lineitem").filter(F.col("l_linestatus") == "F").select(
            text_id("C", "l_orderkey").alias("claim_id"),
            F.concat(size_file(F.col("l_quantity")), F.lit("#L1-L9")).alias("ref"),
            F.col("l_linenumber").alias("pos"),
        )

    @cached_property
    def part_evidence(self) -> DataFrame:
        """Parts as evidence: economy parts are tests, the others tool runs."""
        brand = F.col("p_brand")
        status = (
            F.when(brand == "Brand#1", "violated").when(brand.isin("Brand#2", "Brand#3"), "unclear")
            .when(F.col("p_type") == "ECONOMY", "covered").otherwise("compliant")
        )
        is_test = F.col("p_type") == "ECONOMY"
        return self.table("part").select(
            text_id("E", "p_partkey").alias("evidence_id"),
            F.when(is_test, "test").otherwise("tool").alias("source_type"),
            size_file(F.col("p_size")).alias("source_path"),
            F.when(is_test, text_id("N", "p_partkey")).alias("nodeid"),
            F.lit(None).cast("string").alias("task_id"), status.alias("status"), F.col("p_partkey").alias("ord"),
            "p_size",
        )

    @cached_property
    def task_evidence(self) -> DataFrame:
        """Customers as task evidence; the machinery segment has no tasks."""
        return self.table("customer").filter(F.col("c_mktsegment") != "MACHINERY").select(
            text_id("T", "c_custkey").alias("evidence_id"), F.lit("task").alias("source_type"),
            F.lit("docs/task_list.json").alias("source_path"), F.lit(None).cast("string").alias("nodeid"),
            text_id("K", "c_custkey").alias("task_id"),
            F.when(F.col("c_acctbal") < 0, "partial").otherwise("covered").alias("status"),
            F.col("c_custkey").alias("ord"), "c_nationkey", "c_mktsegment",
        )

    @cached_property
    def claim_evidence(self) -> DataFrame:
        return self.part_evidence.drop("p_size").unionByName(self.task_evidence.drop("c_nationkey", "c_mktsegment"))

    @cached_property
    def claim_cover(self) -> DataFrame:
        """Tasks cover their nation's and segment's criterion, tests that of the nation with their size."""
        tasks = self.task_evidence.select(
            F.explode(F.array(text_id("AC-N", "c_nationkey"), text_id("AC-S", "c_mktsegment"))).alias("item_id"),
            "evidence_id", "source_type", "source_path", "status",
        )
        tests = self.part_evidence.filter(F.col("source_type") == "test").select(
            text_id("AC-N", "p_size").alias("item_id"), "evidence_id", "source_type", "source_path", "status"
        )
        return tasks.unionByName(tests)

    # -- files and changes -----------------------------------------------------------------------------

    @cached_property
    def changed_file(self) -> DataFrame:
        """The change touches the files of five brands."""
        brands = ["Brand#1", "Brand#2", "Brand#3", "Brand#4", "Brand#5"]
        return self.table("part").filter(F.col("p_brand").isin(brands)).select(module_file("p_partkey").alias("path"))

    @cached_property
    def file_ref(self) -> DataFrame:
        """Every line item is a code or test reference of its order's claim to its part's file."""
        fragment = F.when(F.col("l_linestatus") == "F", F.lit("#L1")).otherwise(F.lit(""))
        return self.table("lineitem").select(
            text_id("C", "l_orderkey").alias("claim_id"),
            F.when(F.col("l_returnflag") == "R", "test").otherwise("code").alias("kind"),
            F.concat(module_file("l_partkey"), fragment).alias("ref"), F.col("l_linenumber").alias("pos"),
        )

    @cached_property
    def orders_snapshots(self) -> tuple[DataFrame, DataFrame]:
        """Claims of the last revision and of the staged one, in which urgent claims were reopened."""
        def claims(status: Column) -> DataFrame:
            return self.table("orders").select(
                F.col("o_orderkey").alias("claim_id"), "o_custkey", status.alias("o_orderstatus"), "o_totalprice", "o_orderdate",
                F.col("o_orderkey").alias("ord"),
            )

        before = F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp")
        reopened = F.when(F.col("o_orderpriority") == "1-URGENT", "X").otherwise(F.col("o_orderstatus"))
        return claims(F.col("o_orderstatus")).filter(before), claims(reopened)

    # -- decisions -----------------------------------------------------------------------------------------

    @cached_property
    def decision(self) -> DataFrame:
        """Purchases accept a risk, sign-ups complete an item; other events are other actions."""
        kind = F.col("event_type")
        return self.table("events").select(
            F.col("event_id").alias("decision_id"), F.col("user_id"),
            F.when(kind == "purchase", "accept_risk").when(kind == "signup", "mark_complete").otherwise(kind).alias("action"),
            F.get_json_object("props", "$.k").alias("targetId"),
        )

    # -- rules ---------------------------------------------------------------------------------------------

    @cached_property
    def rule(self) -> DataFrame:
        """Parts as rules: the brand is the project, the type the section."""
        kind = F.col("p_type")
        section = (
            F.when(kind == "ECONOMY", "dependency_rules").when(kind == "LARGE", "quality_gates")
            .when(kind == "MEDIUM", "storage_rules").when(kind == "PROMO", "security_rules")
            .when(kind == "SMALL", "forbidden_patterns").otherwise("other_section")
        )
        return self.table("part").select(
            F.col("p_brand").alias("project_id"), section.alias("section"), text_id("RULE-", "p_partkey").alias("rule_id"),
            F.col("p_name").alias("title"), F.when(F.col("p_size") <= 40, "must").otherwise("should").alias("severity"),
            F.when(F.col("p_size") <= 25, "manual").otherwise("machine").alias("verification_method"),
            F.when(F.col("p_retailprice") < 960, "lead").alias("accepted_by"),
            F.when(F.col("p_retailprice") < 950, F.expr("timestamp'2001-01-01 00:00:00' + make_interval(0,0,0,p_size)"))
            .alias("accepted_at"),
            F.array(text_id("MOD-", "p_size")).alias("related_modules"),
            F.when(F.col("p_type") == "SMALL", "check").alias("checker"),
            F.lit(None).cast("string").alias("verification_command"), F.col("p_partkey").alias("ord"),
        )

    @cached_property
    def nation_module(self) -> DataFrame:
        """Nations as modules: they may call nations of their region, and must not call the next one."""
        nation = self.table("nation")
        peers = nation.groupBy("n_regionkey").agg(F.array_sort(F.collect_set("n_nationkey")).alias("allowed_to_call"))
        return nation.join(peers, "n_regionkey").select(
            F.col("n_nationkey").alias("module_id"), F.col("n_name").alias("name"), "allowed_to_call",
            F.array(F.col("n_nationkey") + 1).alias("forbidden_to_call"), F.col("n_nationkey").cast("bigint").alias("ord"),
        )

    @cached_property
    def nation_edge(self) -> DataFrame:
        """Line counts from the customer's nation to the supplier's."""
        orders = self.order_project.select(F.col("o_orderkey").alias("l_orderkey"), F.col("project_id").alias("from_module"))
        supplier = self.table("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("to_module"))
        # Lines are counted per order and supplier before they meet the nations.
        lines = self.table("lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"))
        return (
            lines.join(supplier, "l_suppkey").join(orders, "l_orderkey")
            .groupBy("from_module", "to_module").agg(F.sum("n").alias("n_lines"))
        )
