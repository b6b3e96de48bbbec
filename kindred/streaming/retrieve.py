"""Reference records as a stream: each batch meets the stored index and appends its candidates; the checkpoint makes a restart go on where it stopped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from kindred.functions import text as X
from kindred.operators import retrieve
from kindred.plans.presets import IndexConfig


def start(stream: DataFrame, idx: dict[str, DataFrame], out: str, checkpoint: str, config: IndexConfig | None = None) -> StreamingQuery:
    """stream: reference records (entity_id, business_name, business_address, country, source). A batch that is run again overwrites its own folder."""

    def batch(df: DataFrame, number: int) -> None:
        found = retrieve.retrieved(X.represented(df), idx, config)
        found.drop("qn", "qa", "tn", "ta").write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
