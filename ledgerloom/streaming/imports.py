"""Streaming import of statement rows: recognised once, appended once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.functions.text import transaction_hash
from ledgerloom.operators.changes import append_new

ROWS = "account_id long, txn_date date, txn_time string, amount_paise long, narration string, arrived_at timestamp"


def incoming(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Rows of Parquet files as they land, with their identity."""
    rows = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return rows.withColumn("import_hash", transaction_hash(*(F.col(c) for c in ("account_id", "txn_date", "txn_time", "amount_paise", "narration"))))


def first_arrivals(rows: DataFrame, delay: str = "7 days") -> DataFrame:
    """Rows whose identity has not been seen within the delay; state is bounded by it."""
    return rows.withWatermark("arrived_at", delay).dropDuplicatesWithinWatermark(["import_hash"])


def daily_totals(rows: DataFrame, delay: str = "1 day") -> DataFrame:
    """Money in and out by account and day of arrival, closed when late rows can no longer come."""
    amount = F.col("amount_paise")
    return rows.withWatermark("arrived_at", delay).groupBy(F.window("arrived_at", "1 day"), "account_id").agg(
        F.sum(F.when(amount > 0, amount).otherwise(0)).alias("in_paise"), F.sum(F.when(amount < 0, -amount).otherwise(0)).alias("out_paise"), F.count("*").alias("rows")
    )


def append_to(rows: DataFrame, table_path: str, checkpoint: str) -> StreamingQuery:
    """Append new identities to a Parquet table; a batch that is run again adds nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        path = f"{table_path}/batch={batch_id}"
        try:
            current = spark.read.parquet(table_path).where(F.col("batch") != batch_id).select("import_hash")
        except Exception as missing:  # the first batch has no table to read
            if "PATH_NOT_FOUND" not in str(missing) and "UNABLE_TO_INFER_SCHEMA" not in str(missing):
                raise
            current = batch.select("import_hash").limit(0)
        append_new(current, batch, "import_hash", [F.col("arrived_at")]).write.mode("overwrite").parquet(path)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
