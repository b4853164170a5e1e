"""Incremental ingest: new files of raw prices through the gates into the warehouse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.quality import GAP_DAYS, with_reason
from ..schemas import PRICES
from ..sources.warehouse import Warehouse


def gate_batch(warehouse: Warehouse, batch: DataFrame) -> None:
    """Gate a batch of days after the stored ones. The runs of jumps begin after a day without one, so a run's worth of stored raw days is read again."""
    first = batch.agg(F.min("date")).first()[0]
    if first is None:
        return
    before = warehouse.load_prices().where((F.col("date") < F.lit(first)) & (F.col("date") >= F.date_sub(F.lit(first), GAP_DAYS)))
    told = with_reason(before.unionByName(batch)).where(F.col("date") >= F.lit(first))
    warehouse.write_quarantine(told.where("reason IS NOT NULL"))
    warehouse.write_prices(told.where("reason IS NULL").drop("reason"))


def start(spark: SparkSession, source: str, warehouse: Warehouse, checkpoint: str) -> StreamingQuery:
    """Every new file under ``source`` once, then stop; ``checkpoint`` keeps what was read."""
    raw = spark.readStream.schema(PRICES).parquet(source)
    return raw.writeStream.foreachBatch(lambda batch, _: gate_batch(warehouse, batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
