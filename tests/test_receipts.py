"""Receipts and item sightings on small fixtures."""

import datetime

from pyspark.sql import functions as F

from ledgerloom.operators import items, receipts

DAY = datetime.date(2024, 1, 5)


def record(lines, total=None, ref="A-1", stated=None):
    own = sum(x[4] for x in lines)
    return (ref, DAY, own if total is None else total, [("I1", own if stated is None else stated, lines)])


def answers(spark, rows):
    return spark.createDataFrame(rows, f"artifact_id long, is_invoice boolean, is_credit_note boolean, merchant string, markdown string, record {receipts.RECORD}")


GOODS = [("Blue Steel Bolt Long Box", None, "goods", 2, 12345), ("Delivery fee", None, "fee", 0, 500)]
PAGE = "TAX INVOICE\nblue  steel | bolt long\nbox 123.45\nDelivery-fee 5.00 total 128.45"


def test_answers_fail_at_the_first_thing_that_is_wrong(spark):
    cases = [
        ("ok", True, False, PAGE, record(GOODS)), ("not_an_invoice", False, True, PAGE, record(GOODS)), ("not_an_invoice", None, False, PAGE, None), ("credit_note", True, True, PAGE, record(GOODS)),
        ("schema_violation", True, False, PAGE, None), ("schema_violation", True, False, PAGE, record([])), ("schema_violation", True, False, PAGE, record(GOODS, ref=" ")),
        ("does_not_reconcile", True, False, PAGE, record(GOODS, total=12846)), ("does_not_reconcile", True, False, PAGE, record(GOODS, stated=1)),
        ("hallucinated_lines", True, False, PAGE, record([*GOODS, ("Red bolt", None, "goods", 1, 1)])), ("hallucinated_lines", True, False, None, record(GOODS)),
        ("hallucinated_lines", True, False, PAGE, record([("!!", None, "goods", 1, 1)])), ("ok", True, False, PAGE, record([("blue steel bolt long and some more", None, "goods", 1, 12845)])),
    ]
    frame = answers(spark, [(i, a, b, "m", page, rec) for i, (_, a, b, page, rec) in enumerate(cases)])
    got = {r.artifact_id: r for r in receipts.check_answers(frame).collect()}
    assert [got[i].verdict for i in range(len(cases))] == [c[0] for c in cases]
    assert not got[0].low_coverage and not got[0].no_quantity


def test_unclaimed_amounts_and_quantities_only_warn(spark):
    page = "pen 1.00\n" + "\n".join(f"other {i}.50" for i in range(2, 8)) + " 1,00,000.25"
    frame = answers(spark, [(1, True, False, "m", page, record([("pen", None, "goods", 0, 100)])), (2, True, False, "m", "pen without amounts", record([("pen", None, "goods", None, 100)]))])
    got = {r.artifact_id: tuple(r)[1:] for r in receipts.check_answers(frame).collect()}
    assert got == {1: ("ok", True, True), 2: ("ok", False, False)}


def test_landing_names_the_source_and_refuses_duplicates(spark):
    rows = [(i, True, False, "The Shop, Ltd.", "order number " + PAGE if i == 1 else PAGE, record(GOODS, ref=f"A-{i}")) for i in range(1, 7)]
    files = spark.createDataFrame([(1, "application/pdf", "failed"), (2, "application/pdf", "failed"), (3, "application/pdf", "parsed"), (4, "image/png", "failed"), (5, "application/pdf", "failed")], "id long, mime string, parse_status string")
    known = spark.createDataFrame([("the-shop-ltd", "A-5")], "source_type string, external_ref string")
    got = {r.artifact_id: (r.outcome, r.source_type) for r in receipts.land_answers(answers(spark, rows), files, known).collect()}
    assert got == {1: ("staged", "marketplace"), 2: ("staged", "the-shop-ltd"), 3: ("duplicate_order", None), 4: ("unreadable_mime", None), 5: ("duplicate_order", None), 6: ("corrupt", None)}


CATALOGUE = [(1, "blue steel bolt long head", 7), (2, "green rubber garden hose", None)]


def tables(spark):
    known = spark.createDataFrame(CATALOGUE, "id long, label string, category_id long")
    aliases = spark.createDataFrame([(2, "shop", "sku", "S2"), (2, "shop", "name", "hose")], "item_id long, source_type string, alias_kind string, alias_value string")
    return known, aliases


def test_worklist_asks_where_an_item_or_a_row_is_doubtful(spark):
    known, aliases = tables(spark)
    one = [("Green hose", "S2", "goods", 1, 300), ("Delivery", None, "fee", 1, 50)]
    files = spark.createDataFrame(
        [(1, "shop", "staged", record(one, ref="A")), (2, "shop", "staged", record([("Blue steel bolt long head", None, "goods", 1, 900)], ref="B")), (3, "shop", "staged", record([("hose", None, "goods", 1, 10)], ref="C")), (4, "shop", "failed", None)],
        f"id long, source_type string, parse_status string, record {receipts.RECORD}",
    )
    bank = spark.createDataFrame([(10, -350, DAY, "x"), (11, -10, DAY, "x"), (12, -10, DAY, "y")], "id long, amount_paise long, txn_date date, narration string")
    got = {r.artifact_id: r for r in receipts.staged_orders(files, aliases, known, bank).collect()}
    assert {k: (r.outcome, r.transaction_id, r.needs_attention) for k, r in got.items()} == {1: ("matched", 10, False), 2: ("none", None, True), 3: ("ambiguous", None, True)}
    assert [(x.decision, x.item_id, x.category_id) for x in got[1].lines] == [("existing", 2, None), ("fee", None, None)]
    assert [(x.decision, x.item_id, x.category_id) for x in got[2].lines] == [("link", 1, 7)]
    assert receipts.staged_summary(files, aliases, known).first().asDict() == {"staged": 3, "held": 1, "total_paise": 1260, "uncategorised_lines": 3}
    products = receipts.product_worklist(receipts.staged_products(files), aliases, known)
    assert [(r.key, r.decision, r.orders) for r in products.collect()] == [("shop:name:blue steel bolt long head", "link", ["B"]), ("shop:S2", "existing", ["A"]), ("shop:name:hose", "existing", ["C"])]
    assert [r.key for r in receipts.product_worklist(receipts.staged_products(files), aliases, known, search=" RUBBER ").collect()] == ["shop:S2", "shop:name:hose"]
    assert [r.key for r in receipts.product_worklist(receipts.staged_products(files), aliases, known, asking=True).collect()] == ["shop:name:blue steel bolt long head"]
    nothing = files.where("false")
    assert receipts.staged_orders(nothing, aliases, known, bank).count() == 0
    assert receipts.staged_summary(nothing, aliases, known).first().asDict() == {"staged": 0, "held": 0, "total_paise": 0, "uncategorised_lines": 0}


def test_sightings_make_each_new_product_once(spark):
    known, aliases = tables(spark)
    rows = [
        ("1", "shop", "S2", "Hose, green"), ("2", "shop", "N1", "Wooden ladder tall"), ("3", "shop", None, "wooden LADDER tall"), ("4", "shop", "N1", "Ladder made of wood"), ("5", "other", None, "wooden ladder tall"),
        ("6", "shop", None, "Blue steel bolt long head"), ("7", "shop", None, "!!"), ("8", "shop", None, "hose"),
    ]
    lines = spark.createDataFrame(rows, "line_id string, source_type string, sku string, name string")
    new, given, placed = items.record_sightings(lines, aliases, known)
    assert sorted(map(tuple, new.collect())) == [(3, "Wooden ladder tall"), (4, "wooden ladder tall")]
    assert {r.line_id: r.item_id for r in placed.collect()} == {"1": 2, "2": 3, "3": 3, "4": 3, "5": 4, "6": 1, "8": 2}
    assert {(r.source_type, r.alias_kind, r.alias_value): r.item_id for r in given.collect()} == {
        ("shop", "name", "hose green"): 2, ("shop", "sku", "N1"): 3, ("shop", "name", "wooden ladder tall"): 3, ("shop", "name", "ladder made of wood"): 3, ("other", "name", "wooden ladder tall"): 4,
        ("shop", "name", "blue steel bolt long head"): 1,
    }
    assert items.record_sightings(lines.where("false"), aliases, known)[0].count() == 0


def test_backfill_is_netted_and_settles(spark, sf_dir, tmp_path):
    """After links and rules are committed, the same links and rules change nothing."""
    from ledgerloom import queries
    from ledgerloom.operators import evidence
    from ledgerloom.plans.ledger import Ledger

    def kept(rows, name):
        rows.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    l = Ledger(spark, sf_dir)
    txns, before = kept(l.transactions, "txns"), kept(l.allocations, "before")
    links, change = queries._applied(l)
    links = kept(links, "links")
    both = evidence.backfilled(change, links, txns, before, queries.ALL_RULES)
    came, went = kept(both.inserts, "in"), kept(both.deletes, "out")
    assert came.where("source = 'rule'").count() and went.where("source = 'evidence'").count()
    fresh = came.withColumn("id", F.monotonically_increasing_id() + (1 << 50)).select(*before.columns)
    after = kept(before.join(went.select("id"), "id", "left_anti").select(*before.columns).unionByName(fresh), "after")
    categories = l.evidence.where("id % 5 <> 0").select(F.col("id").alias("evidence_id"), (F.col("id") % 3 + 1).alias("category_id"))
    again, second = evidence.apply_links(links, l.evidence, txns, after, categories, shared_category=9)
    settled = evidence.backfilled(second, kept(again, "again"), txns, after, queries.ALL_RULES)
    assert settled.inserts.isEmpty() and settled.deletes.isEmpty()


def test_change_sets_compose(spark):
    from ledgerloom.operators.changes import ChangeSet, compose

    rows = lambda x: spark.createDataFrame(x, "id long, a long, b string")
    first = ChangeSet(rows([(None, 1, "x"), (None, 1, "x"), (None, 2, None)]), rows([(7, 3, "z"), (8, 4, None)]))
    second = ChangeSet(rows([(None, 4, None), (None, 5, "n")]), rows([(None, 1, "x"), (9, 6, "q")]))
    both = compose(first, second, ["a", "b"])
    assert sorted((r.a, r.b or "") for r in both.inserts.collect()) == [(1, "x"), (2, ""), (5, "n")]
    assert sorted(r.id for r in both.deletes.collect()) == [7, 9]


def test_overrides_and_hand_links_are_backfilled(spark, sf_dir, tmp_path):
    from ledgerloom import queries
    from ledgerloom.operators import receipts, rules
    from ledgerloom.plans.ledger import Ledger

    l = Ledger(spark, sf_dir)
    wanted = l.evidence.where("id % 7 = 3").select(F.col("id").alias("evidence_id"), F.col("id").alias("transaction_id"))
    fallback = rules.Rule(50, "rest", (rules.Condition("amount_paise", "lt", 0),), category_id=99)
    checked, links, change = receipts.relink_and_backfill(wanted, l.evidence, l.lines, l.items, l.evidence_transactions, l.transactions, l.allocations, [fallback])
    good = {r.evidence_id for r in checked.where("verdict = 'ok'").collect()}
    assert good == {r.evidence_id for r in links.inserts.collect()}
    change.inserts.write.parquet(str(tmp_path / "in"))
    changed = spark.read.parquet(str(tmp_path / "in"))
    assert changed.where("source = 'rule' and category_id <> 99").isEmpty() and changed.where("source = 'evidence'").count()
    after = l.allocations.join(change.deletes.select("id"), "id", "left_anti").select(*l.allocations.columns).unionByName(changed)
    whole = after.groupBy("transaction_id").agg(F.sum("amount_paise").alias("s"), F.max((F.col("source") == "user").cast("int")).alias("u")).join(links.inserts.select("transaction_id"), "transaction_id", "left_semi")
    rows = whole.join(l.transactions.select(F.col("id").alias("transaction_id"), "amount_paise"), "transaction_id")
    assert rows.where("u = 0 and s <> amount_paise").isEmpty(), "the rules fill what lines leave"

    picked = receipts.record_lines(receipts.staged(l.artifacts)).where("kind = 'goods'").select("artifact_id", "line_index").limit(3)
    chosen = picked.withColumn("item_id", F.lit(1).cast("long"))
    known = l.evidence.where("source_type = 'invoice'")
    resolved = receipts.record_lines(receipts.staged(l.artifacts)).select("artifact_id", "line_index", F.lit(2).cast("long").alias("item_id"))
    landing = receipts.confirm_and_explain(l.artifacts, resolved, known, l.lines, l.items, l.evidence_transactions, l.transactions, l.allocations, [], overrides=chosen)
    assert landing.lines.inserts.where("item_id = 1").count() == 3
