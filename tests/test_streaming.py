from pyspark.sql import functions as F

from ledgerloom.streaming import imports


def test_rows_are_appended_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, None, None, -5, "a"), (1, None, None, -5, "a"), (1, None, None, 7, "b")], "account_id long, txn_date date, txn_time string, amount_paise long, narration string")
    rows = rows.withColumn("txn_date", F.lit("2024-01-01").cast("date")).withColumn("arrived_at", F.lit("2024-01-02 03:04:05").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "in/a"))
    stream = imports.incoming(spark, str(tmp_path / "in/*"))
    for _ in range(2):  # the second run finds nothing new
        imports.append_to(stream, str(tmp_path / "table"), str(tmp_path / "cp")).awaitTermination()
    rows.write.parquet(str(tmp_path / "in/b"))
    imports.append_to(stream, str(tmp_path / "table"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.amount_paise for r in spark.read.parquet(str(tmp_path / "table")).collect()) == [-5, 7]
