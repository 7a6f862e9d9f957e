"""Golden cases and comparisons with slow versions, on small frames."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.operators import changes, evidence, items, mining, reconcile, rules, shared, transfers
from ledgerloom.operators.predicates import LedgerFilter, iso_date, positive_id
from ledgerloom.sources import invoices, statements

TXN = "id long, account_id long, statement_id long, statement_seq long, txn_date date, amount_paise long, type string, narration string, transfer_status string, transfer_group_id long, bank_balance_paise long"


def value(spark, f, x, kind="string"):
    return spark.createDataFrame([(x,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("given", "wanted"),
    [
        ("UPI-Debit-123456789012-BLINKIT-HDFC-blinkit", "upi debit blinkit hdfc blinkit"),
        ("POS card ending 1234", "pos card ending 1234"),
        ("ref 123456 paid", "ref paid"),
        ("ref 12345 paid", "ref 12345 paid"),
        (None, ""),
    ],
)
def test_normalise(spark, given, wanted):
    assert value(spark, text.normalise, given) == wanted


def test_references(spark):
    assert value(spark, text.references, "UPI-XXXXXXXXXXXX0000-BANK0000002-100000000001-UPI SEND MONEY") == ["100000000001"]
    assert value(spark, text.references, "a123456789012 1234567890123 12345678901") == []
    assert value(spark, text.references, None) == []


@pytest.mark.parametrize(
    ("given", "wanted"),
    [("4000.00", 400000), ("0.01", 1), ("-580.50", -58050), ("1,234.56", 123456), ("1.5", 150), (" ", None), ("₹100", None), ("1.234", None), ("1e3", None), ("1,23.00", None)],
)
def test_to_paise(spark, given, wanted):
    assert value(spark, text.to_paise, given) == wanted


def test_similarity(spark):
    row = spark.createDataFrame([("cat", "cats")], "a string, b string").select(text.similarity(text.trigrams(F.col("a")), text.trigrams(F.col("b"))).alias("s")).first()
    assert row.s == 50


def test_filters_refuse():
    for bad in ({"date_from": "2026-06-31"}, {"date_from": "2024-02-02", "date_to": "2024-01-01"}, {"limit": 501}, {"source": "x"}):
        with pytest.raises(ValueError):
            LedgerFilter(**bad)
    assert positive_id(" ") is None and positive_id(["1"]) is None and positive_id("12") == 12
    with pytest.raises(ValueError):
        positive_id("-1")
    assert iso_date("2024-02-29").day == 29


def random_ledger(spark, seed, n=60):
    rng = random.Random(seed)
    rows, run = [], {}
    for i in range(n):
        account, amount = rng.randint(1, 3), rng.choice([-5, -3, 3, 5, 8]) * 100
        run[account] = run.get(account, 0) + amount
        stated = run[account] + (rng.choice([0, 0, 0, 50])) if rng.random() < 0.7 else None
        rows.append((i, account, 1, i, f"2024-01-{1 + i * 27 // n:02d}", amount, "opening_balance" if i < 2 else "regular", None, None, None, stated))
    return rows, spark.createDataFrame(rows, TXN.replace("txn_date date", "txn_date string")).withColumn("txn_date", F.to_date("txn_date"))


@pytest.mark.parametrize("seed", range(4))
def test_balance_walk(spark, seed):
    rows, frame = random_ledger(spark, seed)
    wanted = set()
    for account in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == account]
        opened, balance = any(r[6] == "opening_balance" for r in own), 0
        first = True
        for r in own:
            balance += r[5]
            if r[10] is not None:
                if balance != r[10] and not (first and not opened):
                    wanted.add((account, r[0], balance, r[10]))
                balance, first = r[10], False
    got = {(r.account_id, r.transaction_id, r.expected_paise, r.stated_paise) for r in reconcile.discrepancies(frame).collect()}
    assert got == wanted


@pytest.mark.parametrize("seed", range(3))
def test_nearest_credit(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.randint(1, 3), None, None, f"2024-01-{rng.randint(1, 9):02d}", rng.choice([-200, -100, 100, 200]), "regular", None, None, None, None) for i in range(50)]
    frame = spark.createDataFrame(rows, TXN.replace("txn_date date", "txn_date string")).withColumn("txn_date", F.to_date("txn_date"))
    taken, wanted = set(), set()
    for debit in sorted((r for r in rows if r[5] < 0), key=lambda r: (r[1], r[0])):
        near = [(abs(int(c[4][-2:]) - int(debit[4][-2:])), c[0]) for c in rows if c[5] == -debit[5] and c[1] != debit[1] and c[0] not in taken]
        near = [x for x in near if x[0] <= 2]
        if near:
            taken.add(min(near)[1])
            wanted.add((debit[0], min(near)[1]))
    assert {(r.debit_id, r.credit_id) for r in transfers.amount_date_pass(frame).collect()} == wanted


def test_reference_on_three_rows_pairs_nothing(spark):
    n = "pay 100000000001"
    rows = [(i, i, None, None, "2024-01-01", a, "regular", n, None, None, None) for i, a in ((1, -5), (2, 5), (3, 5))]
    frame = spark.createDataFrame(rows, TXN.replace("txn_date date", "txn_date string")).withColumn("txn_date", F.to_date("txn_date"))
    assert transfers.by_reference(frame).count() == 0
    assert transfers.by_reference(frame.where("id < 3")).count() == 2


def test_rules_fail_closed_and_converge(spark, sf_dir):
    from ledgerloom.plans.ledger import RULES, Ledger

    ledger = Ledger(spark, sf_dir)
    frame = ledger.transactions
    for bad in (rules.Condition("narration", "gt", "x"), rules.Condition("amount_paise", "lt", "5"), rules.Condition("narration", "contains", "--"), rules.Condition("nothing", "equals", "x"), rules.Condition("txn_date", "gt", "2024-02-31")):
        assert frame.where(rules.Rule(1, "x", (bad,)).column()).count() == 0
    assert frame.where(rules.Rule(1, "x", ()).column()).count() == 0
    known = [rules.rule_of(r) for r in RULES]
    change = rules.apply_rules(frame, ledger.allocations, known)
    after = change.commit(ledger.allocations, ["transaction_id", "source"])
    again = rules.apply_rules(frame, after, known).counters().first()
    assert (again.created, again.removed) == (0, 0)


def test_split_sums_exactly(spark):
    rows = [("a", 1, 0, 7), ("a", 2, 0, 7), ("b", 1, 1, -10), ("b", 2, 1, -10), ("b", 3, 1, -10), ("c", 1, 1000, 6000), ("c", 2, 5000, 6000)]
    out = evidence.split_proportionally(spark.createDataFrame(rows, "k string, p int, w long, t long"), "k", "p", "w", "t").collect()
    got = {k: [r.share for r in sorted(out, key=lambda r: r.p) if r.k == k] for k in "abc"}
    assert got == {"a": [3, 4], "b": [-3, -3, -4], "c": [1000, 5000]}


@pytest.mark.parametrize(
    ("given", "wanted"),
    [
        ("Pouch Curd, 400 G | B0ABCDEFG1 ( B0ABCDEFG1 )", "Pouch Curd, 400 G"),
        ("Cola Zero(PET Bottle) (HSN-22029990)", "Cola Zero(PET Bottle)"),
        ("Curd\nHSN:04039090", "Curd"),
        ("", ""),
    ],
)
def test_merchant_noise(spark, given, wanted):
    assert value(spark, text.without_merchant_noise, given) == wanted


def test_variants(spark):
    names = [
        ("acme zero sugar mix hundred cola", "acme zero sugar mix hundred lemon", None), ("a b c d e", "e d c b a a", None), ("amul butter", "amul cheese", "little_in_common"),
        ("acme smart phone pro max 15", "acme smart phone pro max 16", "bare_number"), ("a b c d e f g", "a b c d e x y", "many_words"), (None, "a", "little_in_common"), (None, None, None),
    ]
    frame = spark.createDataFrame(names, "a string, b string, wanted string")
    for r in frame.select("wanted", text.variant_difference(F.col("a"), F.col("b")).alias("v")).collect():
        assert (r.v.same_product, r.v.reason) == (r.wanted is None, r.wanted)


def test_candidates_against_a_slow_version(spark):
    """Words inside words, pairs across dropped short words, repeated texts, nulls and a rule that claims all hits."""
    texts = ["amazonpay groceries in bulk", "amazon groceries bulk", "the amazon groceries", "myamazon groceriesx", "amazon in bulk", "amazon in bulk", "amazon in bulk", None, "", "milk 123 milk", "milk milk", "quartz lamp"] * 2
    rows = [(i, 1, -100, "regular", t) for i, t in enumerate(texts)]
    ledger = spark.createDataFrame(rows, "id long, account_id long, amount_paise long, type string, narration string")
    allocated = {1: (-100, 7), 2: (-40, 8), 3: (-100, 7), 13: (-100, 9)}
    allocations = spark.createDataFrame([(k, a, c) for k, (a, c) in allocated.items()], "transaction_id long, amount_paise long, category_id long")
    known = [rules.Rule(1, "milk", (rules.Condition("narration", "contains", "milk"),))]
    got = {r.token: r for r in mining.candidates(ledger, allocations, known, min_hits=2).collect()}

    open_ = {i for i in range(len(texts)) if allocated.get(i, (0, 0))[0] != -100}
    tokens = {}
    for r in ledger.select("id", mining.tokens(F.col("narration")).alias("t")).collect():
        for token in r.t if r.id in open_ else ():
            tokens.setdefault(token, set()).add(r.id)
    wanted = {}
    for token, ids in tokens.items():
        hits = {i for i, t in enumerate(texts) if t and token in t}
        if len(ids) >= 2 and len(hits & open_) >= 2:
            used = [allocated[i][1] for i in sorted(hits) if i in allocated]
            wanted[token] = (len(hits & open_), len(hits), len(used), len(set(used)), "milk" if all("milk" in texts[i] for i in hits & open_) else None)
    assert {t: (r.hits, r.ledger_hits, r.explained_hits, r.spread, r.collides_with) for t, r in got.items()} == wanted
    assert "amazon bulk" in tokens and "amazon bulk" not in got and got["amazon"].ledger_hits > len(tokens["amazon"])
    assert [(d.category_id, d["count"]) for d in got["amazon"].spread_detail] == [(7, 2), (8, 1), (9, 1)]
    shown = [r.token for r in mining.report(ledger, allocations, known, min_hits=2).collect()]
    assert {"milk", "milk milk", "lamp"} <= set(shown) and not {"quartz", "quartz lamp"} & set(shown)


def test_mining(spark):
    rows = [(i, 1, None, None, "2024-01-01", -5, "regular", f"UPI-{n}-xyz", None, None, None) for i, n in enumerate(["EATCLUB", "EATCLUB", "EATCLUB", "OTHER"])]
    frame = spark.createDataFrame(rows, TXN.replace("txn_date date", "txn_date string"))
    assert {r.token: r.support for r in mining.support(frame).collect()}["eatclub"] == 3
    assert value(spark, mining.merchant_hint, "AMAZON INDIA RETAIL PVT").startswith("amazon")


def test_change_sets(spark):
    now = spark.createDataFrame([(1, "a")], "id long, k string")
    new = spark.createDataFrame([(2, "a"), (3, "b"), (4, "b")], "id long, k string")
    assert [tuple(r) for r in changes.append_new(now, new, "k", [F.col("id")]).select("id", "k").collect()] == [(3, "b")]
    assert sorted(tuple(r) for r in changes.upsert(now, new, ["k"], [F.col("id")]).collect()) == [(2, "a"), (4, "b")]
    assert sorted(r.id for r in changes.next_ids(now, new.select("k"), [F.col("k")]).collect()) == [2, 3, 4]


def test_shared_validation(spark):
    rows = [(1, "2024-01-02", "10.00", ["5.00", "-5.00"]), (2, "2024-02-31", "10.00", ["5.00", "-5.00"]), (3, "2024-01-02", "0", ["0", "0"]), (4, "2024-01-02", "10.00", ["5.00", "-4.00"]), (5, "2024-01-02", "1.00", ["x", "1"])]
    out = {r.line: r.errors for r in shared.validate(spark.createDataFrame(rows, "line int, date string, cost string, nets array<string>"), 2).collect()}
    assert out == {1: "", 2: "bad_date", 3: "bad_cost", 4: "unbalanced", 5: "bad_net,unbalanced"}
    assert value(spark, shared.group_key, "  Trip|to Å  ") == "trip to å"


def test_statement_files(spark, tmp_path):
    (tmp_path / "s.csv").write_text('﻿Some bank\nDate,Narration,Withdrawal Amt.,Deposit Amt.,Closing Balance\n01/02/24,"Shop, one",10.50,,"1,000.00"\n02/02/24,Pay,,"2,000.00","3,000.00"\ntotal,,1,2,3\n')
    out = statements.read_statements(spark, str(tmp_path / "s.csv")).orderBy("statement_seq").collect()
    assert [(str(r.txn_date), r.narration, r.amount_paise, r.bank_balance_paise) for r in out] == [("2024-02-01", "Shop, one", -1050, 100000), ("2024-02-02", "Pay", 200000, 300000)]


def test_invoice_lines(spark):
    page = (0, 1.0, 1.0, "Tax Invoice\nInvoice Number: IN-7", [[["Description", "Qty", "Total Amount"], ["Blue pen\nShipping Charges", "1", "10.00\n5.50"], ["TOTAL:", "", "15.50"]]])
    frame = spark.createDataFrame([("f", 1, 1, [page])], "file string, " + invoices.DOCUMENT)
    out = invoices.invoice_lines(frame).orderBy("line_index").collect()
    assert [(r.invoice_number, r.description, r.kind, r.amount_paise) for r in out] == [("IN-7", "Blue pen", "goods", 1000), ("IN-7", "Shipping Charges", "fee", 550)]
    stated = spark.createDataFrame([("f", "IN-7", 1550), ("f", "IN-8", 1)], "file string, invoice_number string, total_paise long")
    assert [r.invoice_number for r in invoices.unreconciled(invoices.invoice_lines(frame), stated).collect()] == ["IN-8"]


def test_catalogue_candidates_are_complete(spark, sf_dir):
    from ledgerloom.plans.ledger import Ledger

    catalogue = Ledger(spark, sf_dir).items
    wanted = catalogue.select(F.regexp_extract("label", "^([a-z]+ [a-z]+)", 1).alias("name")).distinct()
    got = {(r.name, r.item_id, r.similarity) for r in items.candidates(wanted, catalogue).collect() if r.place == 1}
    every = wanted.crossJoin(items.canon_index(catalogue)).withColumn("s", text.similarity(text.trigrams(text.canonical_name(F.col("name"))), F.col("grams")))
    best = {}
    for r in every.collect():
        best[r.name] = max(best.get(r.name, (0, 0)), (r.s, -r.item_id))
    assert got == {(n, -i, s) for n, (s, i) in best.items() if s >= items.LEAST_SIMILARITY}


@pytest.mark.parametrize(
    ("given", "canon", "attributes"),
    [
        ("Coke Zero (PET Bottle) 4 x 100g combo of 3 (HSN-22029990) 500 gms", "coke zero 4 x", {"size": "500 gms", "pack": "pet bottle", "pack_of": "3"}),
        ("Acme Mix | 3g Glucose | 50g | Cola", "acme mix glucose cola", {"size": "50 g"}),
        ("Blue\u200b Pen Set of 4, 12 pieces\nHSN:04039090", "blue pen", {"pack_of": "4"}),
        ("Milk TetraPak 1.5 Litre", "milk", {"size": "1.5 litre", "pack": "tetrapak"}),
        ("Curd Pouch, 400 G | B0ABCDEFG1 ( B0ABCDEFG1 )", "curd", {"size": "400 g", "pack": "pouch"}),
        ("Phone 15", "phone 15", {}),
        (None, None, None),
    ],
)
def test_variants_leave_the_name(spark, given, canon, attributes):
    assert value(spark, text.canonical_name, given) == canon
    assert (value(spark, text.variant_attributes, given) or {}) == (attributes or {})


def test_sku_conflicts(spark):
    """A candidate with a SKU of the source is strong only as a variant; two strong ones, or an unexplained one, are proposed."""
    catalogue = spark.createDataFrame([(1, "acme electrolyte drink mix zero sugar veg cola"), (2, "extraordinarily blue steel bolt"), (3, "red steel bolt xx"), (4, "red steel bolt xx")], "id long, label string")
    aliases = spark.createDataFrame([(1, "shop", "sku", "A1"), (2, "shop", "sku", "B1")], "item_id long, source_type string, alias_kind string, alias_value string")
    rows = [
        (1, "shop", "A2", "acme electrolyte drink mix zero sugar veg colas"), (2, "shop", "B2", "extraordinarily blue steel bolts"), (3, "mall", "B2", "extraordinarily blue steel bolts"), (4, "shop", None, "extraordinarily blue steel bolts"), (5, "shop", "C", "red steel bolt xx"),
        (6, "shop", "A1", "anything"), (7, "shop", "Z", "something else"), (8, "shop", "B9", "extraordinarily blue steel bolt"),
    ]
    out = items.resolve(spark.createDataFrame(rows, "line_id int, source_type string, sku string, name string"), aliases, catalogue)
    got = {r.line_id: (r.decision, r.item_id) for r in out.collect()}
    assert got == {1: ("link", 1), 2: ("create_and_propose", 2), 3: ("link", 2), 4: ("create_and_propose", 2), 5: ("create_and_propose", 3), 6: ("existing", 1), 7: ("create", None), 8: ("link", 2)}
    assert {r.line_id: r.confidence for r in out.collect() if r.line_id in (6, 7, 8)} == {6: 100, 7: 100, 8: 100}


def test_merges_in_bulk(spark):
    frames = {
        "items": ([(i, f"i{i}", None if i in (1, 4) else i * 10) for i in range(1, 10)], "id long, label string, category_id long"),
        "aliases": ([(1, "s", "name", "x"), (2, "s", "name", "x"), (2, "s", "sku", "2"), (3, "s", "name", "x"), (9, "s", "sku", "9")], "item_id long, source_type string, alias_kind string, alias_value string"),
        "lines": ([(k, i) for k, i in enumerate([1, 2, 3, 4, 5, 6, 9, None])], "line long, item_id long"),
        "proposals": ([(1, 2), (1, 9), (5, 9), (7, 9), (8, 9)], "lo_item_id long, hi_item_id long"),
    }
    tables = {name: spark.createDataFrame(*x) for name, x in frames.items()}
    merge = lambda pairs: items.merge_many(spark.createDataFrame(pairs, "keep long, drop long"), **tables)
    # a chain that is given twice, a cycle, and a pair
    kept, aliases, lines, proposals = merge([(1, 2), (1, 2), (2, 3), (4, 5), (5, 6), (6, 4), (8, 7)])
    assert sorted((r.id, r.category_id) for r in kept.collect()) == [(1, 20), (4, 50), (8, 80), (9, 90)]
    assert sorted(map(tuple, aliases.collect())) == [(1, "s", "name", "x"), (1, "s", "sku", "2"), (9, "s", "sku", "9")]
    assert [r.item_id for r in lines.orderBy("line").collect()] == [1, 1, 1, 4, 4, 4, 9, None]
    assert sorted(map(tuple, proposals.collect())) == [(1, 9), (8, 9)]
    for bad in ([(1, 1)], [(1, 77)]):
        with pytest.raises(ValueError):
            merge(bad)
    assert merge([])[0].count() == 9
    chosen = spark.createDataFrame([(1, 5), (2, None), (3, 7), (3, 7)], "id long, category_id long")
    assert sorted((r.id, r.category_id) for r in items.set_categories(tables["items"], chosen).collect())[:3] == [(1, 5), (2, None), (3, 7)]


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    from ledgerloom.operators.graph import components

    rng = random.Random(seed)
    pairs = [(rng.randrange(80), rng.randrange(80)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(70)] + [(None, 3), (5, 5)]
    label = {x: x for p in pairs if None not in p for x in p}
    for _ in label:
        for a, b in pairs:
            if a is not None and b is not None:
                label[a] = label[b] = min(label[a], label[b])
    assert {r.node: r.component for r in components(spark.createDataFrame(pairs, "x long, y long"), "x", "y").collect()} == label
