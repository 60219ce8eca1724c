"""Matching of samples that arrive continuously, an extension.

Rows are independent of each other, so each micro-batch goes through the same plan as a
table; the terms are static.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from taxoflow.plans.pipeline import Resources, map_samples


def match_stream(stream: DataFrame, resources: Resources, out: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Write matched micro-batches of ``stream(sample_id, sample_desc)`` to Parquet below ``out``.

    A batch that is run again after a failure overwrites its own folder, so each sample comes once.
    """

    def write(batch: DataFrame, number: int) -> None:
        keyed = batch.withColumn("row_key", F.monotonically_increasing_id())
        map_samples(keyed, resources).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
