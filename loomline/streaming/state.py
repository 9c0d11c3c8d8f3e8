"""What all stateful streams share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_states(grouped, processor: StatefulProcessor, schema: str, time_mode: str) -> DataFrame:
    """transformWithState in append mode; such state needs the RocksDB store, so the session is set to it."""
    made = grouped.transformWithStateInPandas(processor, schema, "Append", time_mode)
    made.sparkSession.conf.set(PROVIDER, ROCKS)
    return made
