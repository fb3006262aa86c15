"""The two stored tables of one agent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SESSIONS = (
    "id string, model string, started_at double, ended_at double, message_count bigint, input_tokens bigint, "
    "output_tokens bigint, cache_read_tokens bigint, cache_write_tokens bigint, reasoning_tokens bigint, title string"
)
MESSAGES = (
    "id bigint, session_id string, role string, content string, tool_call_id string, tool_calls string, "
    "tool_name string, timestamp double, reasoning string"
)


def hermes_tables(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Exported tables: `<root>/sessions` and `<root>/messages` in Parquet."""
    return (
        spark.read.schema(SESSIONS).parquet(f"{root}/sessions"),
        spark.read.schema(MESSAGES).parquet(f"{root}/messages"),
    )


def hermes_jdbc(spark: SparkSession, url: str, **options: str) -> tuple[DataFrame, DataFrame]:
    """The same tables through JDBC; the driver's jar must be on the class path."""

    def read(name: str) -> DataFrame:
        return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()

    return read("sessions"), read("messages")
