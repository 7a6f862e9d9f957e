"""Statements that land: new rows once, and the same pairs as a full run for the touched accounts."""

import pytest
from pyspark.sql import functions as F

from ledgerloom import queries
from ledgerloom.operators import landing, rules, transfers
from ledgerloom.plans.ledger import Ledger


def test_pairs_equal_a_full_run(spark, sf_dir, tmp_path):
    l = Ledger(spark, sf_dir)
    landed = queries._landed_statements(l)
    landed.inserted.write.parquet(str(tmp_path / "new"))
    new = spark.read.parquet(str(tmp_path / "new"))
    own = l.accounts.groupBy("bank").agg(F.max("id").alias("account_id")).select("account_id")
    late = l.transactions.where(f"id < {queries.MIRROR} and day(txn_date) > 15").join(own, "account_id", "left_semi").select("id")
    ledger = l.transactions.join(late, "id", "left_anti").select(*l.transactions.columns)
    now = ledger.unionByName(new.select(*ledger.columns))
    now.write.parquet(str(tmp_path / "now"))
    now = spark.read.parquet(str(tmp_path / "now"))
    every = transfers.detect(now, queries._keywords(l), queries._locked(l)).collect()
    ours = {r.id for r in now.join(own, "account_id", "left_semi").select("id").collect()}
    wanted = sorted(map(str, (r for r in every if r.debit_id in ours or r.credit_id in ours)))
    got = sorted(map(str, landed.transfers.select(*every[0].__fields__).collect()))
    assert wanted and got == wanted
    assert new.count() == new.select("id").distinct().count() > 0


def test_a_stream_lands_once(spark, tmp_path):
    accounts = spark.createDataFrame([(1, "a"), (2, "b")], "id long, bank string")
    ledger = spark.createDataFrame([], "id long, account_id long, statement_id long, statement_seq long, txn_date date, amount_paise long, type string, narration string, transfer_status string, transfer_group_id long, bank_balance_paise long")
    keywords, locked = spark.createDataFrame([], "account_id long, keyword string, kind string"), spark.createDataFrame([], "id long")
    rows = [("f", "a", 1, "2024-01-01", -500, "x", -500), ("f", "a", 2, "2024-01-02", -500, "x2", -1000), ("f", "a", 3, "2024-01-01", -500, "x", None), ("g", "b", 1, "2024-01-02", 500, "y", 500), ("h", "zzz", 1, "2024-01-02", 1, "y", 1)]
    parsed = spark.createDataFrame(rows, "file string, bank string, statement_seq int, txn_date string, amount_paise long, narration string, bank_balance_paise long").withColumn("txn_date", F.col("txn_date").cast("date"))
    parsed.where("file <> 'g'").coalesce(1).write.parquet(str(tmp_path / "in/1"))
    kept, seen = str(tmp_path / "ledger"), []
    ledger.write.parquet(kept)

    def write(out, _):
        out.inserted.write.mode("append").parquet(kept)
        seen.append(({(r.file, r.account_id, r.parsed, r.inserted, r.skipped) for r in out.files.collect()}, {r.account_id for r in out.reconciled.collect()}, [(r.debit_id, r.credit_id) for r in out.transfers.collect()]))

    def run():
        stream = spark.readStream.schema(parsed.schema).parquet(str(tmp_path / "in/*"))
        land = landing.each_batch(accounts, lambda: spark.read.parquet(kept), keywords, lambda: locked, write)
        stream.writeStream.foreachBatch(land).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()

    run()
    parsed.where("file = 'g'").coalesce(1).write.parquet(str(tmp_path / "in/2"))
    run()
    assert seen[0] == ({("f", 1, 3, 2, 1), ("h", None, 1, 0, 0)}, {1}, [])
    assert seen[1][0] == {("g", 2, 1, 1, 0)} and seen[1][1] == {2} and len(seen[1][2]) == 1
    assert spark.read.parquet(kept).count() == 3


def test_conditions_are_checked(spark):
    good = '{"field": "narration", "op": "contains", "value": "x"}'
    texts = [
        f"[{good}]", "[]", "{}", "nothing", f"[{good}, 3]", '[{"field": "x", "op": "contains", "value": "x"}]', '[{"field": "narration", "op": "like", "value": "x"}]', '[{"field": "narration", "op": "gt", "value": "x"}]',
        '[{"field": "narration", "op": "equals", "value": " "}]', '[{"field": "amount_paise", "op": "gt", "value": "5"}]', '[{"field": "amount_paise", "op": "gt", "value": 5.5}]', '[{"field": "amount_paise", "op": "gt", "value": -5}]',
        '[{"field": "txn_date", "op": "lt", "value": "2026-06-31"}]', '[{"field": "txn_date", "op": "lt", "value": "2026-06-30"}]', '[{"field": "amount_paise", "op": "gt"}]', '[{"op": "gt", "value": 1}]',
    ]
    out = {r.id: (r.place, r.problem) for r in rules.condition_problems(spark.createDataFrame(list(enumerate(texts)), "id int, conditions string")).collect()}
    assert out == {
        1: (None, "empty"), 2: (None, "not_a_list"), 3: (None, "not_a_list"), 4: (1, "not_an_object"), 5: (0, "unknown_field"), 6: (0, "unknown_op"), 7: (0, "op_not_for_field"), 8: (0, "bad_value"), 9: (0, "bad_value"), 10: (0, "bad_value"),
        12: (0, "bad_value"), 14: (0, "bad_value"), 15: (0, "unknown_field"),
    }


@pytest.mark.parametrize("name", ["src6_land", "min6_covered"])
def test_registered(name):
    assert name in queries.ORACLES
