"""The decision log as a stream: requests arrive as JSON files, complete ones are appended with ids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from attestra.schemas import TABLES
from attestra.session import cut_lineage
from attestra.sources.ledgers import invalid_decisions, new_decisions


def request_stream(spark: SparkSession, path: str) -> DataFrame:
    """Decision requests as they arrive."""
    return spark.readStream.schema(T.DataType.fromDDL(TABLES["decision"])).json(path)


#: A request that comes again within this time of its first arrival is the same one.
REPEAT_WINDOW = "30 days"


def without_repeats(requests: DataFrame, window: str = REPEAT_WINDOW) -> DataFrame:
    """Each request once: one that is sent again within ``window``, in the same batch or a later one, is left out.

    Requests are the same if all their fields are. The state holds a key per request of the window and lies in the query's checkpoint, so
    a restart forgets nothing. The time that counts is that of arrival: no request is ever too late, whatever its own time stamp
    says, and after the window a repeated one counts as a new decision.
    """
    return (
        requests.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", window)
        .dropDuplicatesWithinWatermark(requests.columns).drop("_arrived")
    )


def repeats(query: StreamingQuery) -> dict[str, int]:
    """Over the query's last batches: requests left out as repeated, rows that came too late (none should), keys held."""
    totals = {"repeated": 0, "late": 0, "held": 0}
    for progress in query.recentProgress:
        for state in progress.stateOperators:
            totals["repeated"] += int(state.customMetrics.get("numDroppedDuplicateRows", 0))
            totals["late"] += state.numRowsDroppedByWatermark
            totals["held"] = state.numRowsTotal
    return totals


LAST = "project_id string, decision_id bigint, batch bigint"


def append_requests(requests: DataFrame, log_path: str, rejected_path: str) -> Callable[[DataFrame, int], None]:
    """Batch writer. Each batch owns one folder, so a repeated batch replaces itself and adds nothing.

    Beside the log, every batch leaves the last id of each project. The next batch goes on from there, so
    it reads a row per project and never the log.
    """
    spark, last_path = requests.sparkSession, f"{log_path}-last"
    log_schema = T.StructType([*T.DataType.fromDDL(TABLES["decision"]).fields, T.StructField("batch", T.LongType())])

    def table(path: str, schema, batch_id: int) -> DataFrame:
        return spark.read.schema(schema).option("ignoreMissingFiles", "true").parquet(path).filter(F.col("batch") == batch_id)

    def put(rows: DataFrame, path: str, batch_id: int) -> None:
        rows.withColumn("batch", F.lit(batch_id).cast("bigint")).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("batch").parquet(path)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = cut_lineage(batch)  # read several times; the stream's state is gone through once
        before = table(last_path, LAST, batch_id - 1).drop("batch")
        put(new_decisions(batch, before), log_path, batch_id)
        put(invalid_decisions(batch), rejected_path, batch_id)
        written = table(log_path, log_schema, batch_id).select("project_id", "decision_id")
        put(before.unionByName(written).groupBy("project_id").agg(F.max("decision_id").alias("decision_id")), last_path, batch_id)

    return write


def start(
    spark: SparkSession, request_path: str, log_path: str, rejected_path: str, checkpoint: str, *, repeat_window: str = REPEAT_WINDOW
) -> StreamingQuery:
    """Append all requests present to the log, each once, then stop. ``checkpoint`` is a folder all executors share."""
    log = T.StructType([*T.DataType.fromDDL(TABLES["decision"]).fields, T.StructField("batch", T.LongType())])
    for schema, path in ((log, log_path), (LAST, f"{log_path}-last")):
        spark.createDataFrame([], schema).write.mode("append").partitionBy("batch").parquet(path)
    requests = request_stream(spark, request_path)
    return (
        without_repeats(requests, repeat_window).writeStream.foreachBatch(append_requests(requests, log_path, rejected_path))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
