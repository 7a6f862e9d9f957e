import datetime

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.operators import graph, items, mining, queue, receipts, rules, shared
from ledgerloom.plans import ledger as plans
from ledgerloom.plans.ledger import RULES, Ledger

DAY = datetime.date(2024, 1, 2)


def test_group_key(spark):
    names = ["Café  Trip", "a\tb\x85c", " | x||Y | ", "Z" * 63 + " tail", "", None]
    got = spark.createDataFrame([(n, x) for n, x in enumerate(names)], "n int, x string").select("n", shared.group_key(F.col("x")).alias("k")).orderBy("n").collect()
    assert [r.k for r in got] == ["café trip", "abc", "x y", "z" * 63, "", None]


def test_plan_of_an_export(spark):
    each = [("f", "Tea ", "food", -300, "expense"), ("f", "tea", "food", 300, "expense"), ("f", "Cab", "ride", -200, "expense"), ("f", "Gift", "none", -100, "expense"), ("f", "Other", "new", 0, "expense"), ("f", "Back", "new", -5, "payment"), ("g", "lost", "food", -1, "expense")]
    rows = spark.createDataFrame([(f, DAY, d, c, "INR", 600, {"me": n, "you": -n}, n, k) for f, d, c, n, k in each], "file string, date date, description string, category string, currency string, cost_paise long, nets map<string,long>, net_paise long, kind string")
    plan = shared.import_plan(rows, spark.createDataFrame([("f", "Goa\t2024")], "file string, group string"), spark.createDataFrame([("food", 7), ("none", None)], "source_category string, category_id long"))
    refs = [r.external_ref for r in plan.evidence.orderBy("net_paise").collect()]
    assert len(refs) == 6 and refs[0] == "goa2024|2024-01-02|tea|600" == refs[-1]
    assert [(r.category_id, r.amount_paise) for r in plan.consumption.collect()] == [(7, -300)]
    assert sorted((r.source_category, r.amount_paise) for r in plan.unclassified.collect()) == [("none", -100), ("ride", -200)]
    assert [r.source_category for r in plan.unmapped.collect()] == ["ride"]
    assert plan.stats.collect()[0].asDict() == {"group": "goa2024", "paid": 1, "owed_by_me": 3, "not_mine": 1, "payments": 1}
    assert '"nets_paise":{"me":-300,"you":300}' in plan.evidence.where("net_paise = -300").collect()[0].payload
    empty = shared.import_plan(rows.limit(0), spark.createDataFrame([("f", "x")], "file string, group string"), spark.createDataFrame([], "source_category string, category_id long"))
    assert empty.evidence.count() == empty.stats.count() == empty.unmapped.count() == 0


def test_outlook(spark):
    counts = spark.createDataFrame([(1, 10, 2, 1, 3, 1), (2, 1, 0, 0, 3, 0), (3, 0, 0, 0, 0, 0)], "id int, total long, queued long, running long, done long, failed long")
    got = {r.id: (r.remaining_seconds, r.settled, r.fraction_done) for r in queue.outlook(counts, F.lit(7)).collect()}
    assert got == {1: (21, False, 0.4), 2: (0, True, 1.0), 3: (0, True, 0.0)}
    for none in (None, 0):
        assert {r.remaining_seconds for r in queue.outlook(counts, F.lit(none).cast("long")).collect()} == {None}


def test_beats_renew_within_the_lease(spark):
    at = lambda minute: datetime.datetime(2024, 1, 1, 0, minute)
    jobs = spark.createDataFrame([(1, "running", at(0)), (2, "queued", None), (3, "running", at(0))], "id long, state string, claimed_at timestamp")
    beats = spark.createDataFrame([(1, at(2)), (1, at(5)), (1, at(6)), (2, at(1)), (3, at(6)), (3, at(0)), (None, at(1))], "id long, at timestamp")
    assert [(r.id, r.claimed_at) for r in queue.heartbeat(jobs, beats).collect()] == [(1, at(5))]


def test_views(spark):
    rows = spark.createDataFrame([(False, 1, "existing"), (False, None, "create"), (True, 2, "create_and_propose"), (True, 2, "link"), (None, None, None)], "needs_input boolean, category_id long, decision string")
    assert receipts.view_counts(rows, receipts.PRODUCT_VIEWS).collect()[0].asDict() == {"needs": 4, "existing": 1, "create": 2, "nocat": 2, "all": 5}
    orders = spark.createDataFrame([(True, "ambiguous"), (False, "matched"), (False, None)], "needs_attention boolean, outcome string")
    assert receipts.view_counts(orders, receipts.ORDER_VIEWS).collect()[0].asDict() == {"needs": 1, "matched": 1, "ambiguous": 1, "unmatched": 1, "all": 3}
    with pytest.raises(ValueError):
        receipts.in_view("other", receipts.ORDER_VIEWS)


def test_views_are_held_once(spark, sf_dir):
    """Views made of a held one read it and not the tables again; a rule's outcome is not repeated in the filters on it."""
    plain = Ledger(spark, sf_dir)
    held = plain.once("base")
    assert sorted(held.transactions.collect(), key=str) == sorted(plain.transactions.collect(), key=str)
    assert not any("lineitem" in f for f in held.transactions.unionByName(held.transactions).inputFiles() + held.allocations.inputFiles())
    change = rules.apply_rules(held.transactions, held.allocations, [rules.rule_of(r) for r in RULES])
    assert all("regexp_replace" not in part._jdf.queryExecution().optimizedPlan().toString() for part in (change.inserts, change.deletes))


def test_tokens_meet_each_narration_once(spark, monkeypatch):
    seen = []
    meet = mining.occurrences
    monkeypatch.setattr(mining, "occurrences", lambda rows, wanted: seen.append(rows.count()) or meet(rows, wanted))
    ledger = spark.createDataFrame([(i, 100, f"pos-{100000 + i}-corner shop" if i % 2 else "corner cafe") for i in range(40)], "id long, amount_paise long, narration string")
    allocations = spark.createDataFrame([(1, 100, 5), (2, 100, 6), (3, 40, 5)], "transaction_id long, amount_paise long, category_id long")
    found = {r.token: (r.hits, r.ledger_hits, r.explained_hits, r.spread) for r in mining.candidates(ledger, allocations).collect()}
    assert found["corner"] == (38, 40, 3, 2) and found["corner shop"] == (19, 20, 2, 1) and found["cafe"] == (19, 20, 1, 1)
    shown = spark.createDataFrame([("shop",)], "token string")
    assert tuple(mining.covered(shown, ledger, allocations).first()) == (38, 40, 19)
    assert seen == [2, 2]


def test_staged_products_in_parts_of_lines(spark, monkeypatch):
    monkeypatch.setattr(items, "PART_LINES", 3)
    lines = spark.createDataFrame([(e, i, "goods", 10) for e in range(5) for i in (1, 2, 2)], "evidence_id long, item_id long, kind string, amount_paise long")
    found = items.staged_products(lines, spark.createDataFrame([(1, "a"), (2, "b")], "id long, label string"))
    assert sorted(map(tuple, found.collect())) == [(1, "a", 5, 50, 5, "0,1,2,3,4"), (2, "b", 10, 100, 5, "0,1,2,3,4")]
    assert "RepartitionByExpression [item_id" in found._jdf.queryExecution().optimizedPlan().toString()


def test_artifacts_in_parts_of_lines_and_summed_once(spark, sf_dir, monkeypatch):
    wanted = sorted(Ledger(spark, sf_dir).artifacts.collect(), key=str)
    monkeypatch.setattr(plans, "PART_LINES", 500)
    l = Ledger(spark, sf_dir)
    parts = -(-l.table("lineitem").count() // 500)
    assert l.artifacts.rdd.getNumPartitions() == parts and sorted(l.artifacts.collect(), key=str) == wanted
    plan = receipts.staged_summary(l.artifacts, l.aliases, l.items)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list") == 1 and "RepartitionByExpression [l_orderkey" in plan


def test_merges_do_not_go_through_the_driver(spark, monkeypatch):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    seen, keep = [], graph.checkpointed
    monkeypatch.setattr(graph, "checkpointed", lambda df: seen.append(plan(df)) or keep(df))
    monkeypatch.setattr(items, "FEW_MOVES", 1)
    known = spark.createDataFrame([(i, f"i{i}", i) for i in range(5)], "id long, label string, category_id long")
    aliases = spark.createDataFrame([(2, "s", "sku", "2")], "item_id long, source_type string, alias_kind string, alias_value string")
    lines = spark.createDataFrame([(k, i) for k, i in enumerate([2, None, 4, None])], "line long, item_id long")
    merged = items.merge_many(spark.createDataFrame([(1, 2), (2, 3)], "keep long, drop long"), known, aliases, lines, spark.createDataFrame([(0, 4), (0, 3)], "lo_item_id long, hi_item_id long"))
    assert len(seen) > 2 and not any("Broadcast" in x for x in [*seen, *map(plan, merged)])
    assert sorted(map(tuple, merged[2].collect())) == [(0, 1), (1, None), (2, 4), (3, None)]


def test_lines_that_print_the_same_are_decided_once(spark, monkeypatch):
    seen, by_alias = [], items.by_alias
    monkeypatch.setattr(items, "by_alias", lambda rows, aliases: seen.append((rows.count(), by_alias(rows, aliases))) or seen[-1][1])
    catalogue = spark.createDataFrame([(i, f"blue steel bolt {'xy'[i % 2]}") for i in range(1, 15)] + [(20, "red ring")], "id long, label string")
    aliases = spark.createDataFrame([(20, "s", "sku", "20")], "item_id long, source_type string, alias_kind string, alias_value string")
    each = [("20", "ring, red"), (None, "Blue steel bolt x"), (None, "Blue steel bolt x"), ("20", "ring, red"), (None, None), (None, None)]
    lines = spark.createDataFrame([(k, "s", *x) for k, x in enumerate(each)], "line_id int, source_type string, sku string, name string")
    found = sorted((r.line_id, r.decision, r.item_id, r.confidence) for r in items.resolve(lines, aliases, catalogue).collect())
    assert found == [(0, "existing", 20, 100), (1, "create_and_propose", 2, 0), (2, "create_and_propose", 2, 0), (3, "existing", 20, 100), (4, "create", None, 100), (5, "create", None, 100)]
    assert seen[0][0] == 3 and "Broadcast" not in seen[0][1]._jdf.queryExecution().executedPlan().toString()


def test_best_items_are_among_the_best_classes(spark):
    words = ("steel", "bolts", "rings", "blues")
    labels = [(i, f"{words[i % 4]} {words[i * 7 % 3]}") for i in range(1, 60)]
    found = items.candidates(spark.createDataFrame([("blues bolts",), ("steel rings",)], "name string"), spark.createDataFrame(labels, "id long, label string"))
    pairs = spark.createDataFrame([(n, i, x) for n in ("blues bolts", "steel rings") for i, x in labels], "name string, item_id long, label string")
    near = pairs.select("name", "item_id", text.similarity(text.trigrams(F.col("name")), text.trigrams(F.col("label"))).alias("similarity")).where("similarity >= 30").collect()
    for name in ("blues bolts", "steel rings"):
        best = sorted((-r.similarity, r.item_id) for r in near if r.name == name)[:5]
        assert [(-r.similarity, r.item_id) for r in found.where(F.col("name") == name).orderBy("place").collect()] == best and len(best) == 5
    tasks = found._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [left" in tasks
