"""The queries of the ledger operators, by name, each with its DuckDB oracle where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions import records, text
from ledgerloom.operators import changes, editing, evidence, items, landing, mining, predicates, queue, receipts, reconcile, redaction, reports, rules, shared, steps, transfers
from ledgerloom.plans.ledger import MIRROR, RULES, Ledger
from ledgerloom.plans.oracle_views import sql
from ledgerloom.sources import exports, statements

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

NOW = "2024-01-20 00:00:00"
ALL_RULES = [rules.rule_of(r) for r in RULES]


def query(name: str, oracle: str | None = None):
    """Register a function of a ledger; whole numbers come out as longs, as in the oracles."""

    def register(f: Callable[[Ledger], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(Ledger(spark, sf_dir))
            return out.select(*(F.col(c.name).cast("long").alias(c.name) if isinstance(c.dataType, (T.IntegerType, T.ShortType)) else F.col(c.name) for c in out.schema.fields))

        QUERIES[name] = run
        if oracle:
            ORACLES[name] = sql(oracle)
        return f

    return register


# Reports

SPEND_SUMS = ", ".join(f"CAST(coalesce(sum(al.amount_paise) FILTER (al.source = '{s}'), 0) AS BIGINT) AS {s}_paise" for s in ("user", "rule", "evidence"))
BY_CATEGORY = f"""SELECT c.id AS category_id, c.name AS category, p.name AS parent, {SPEND_SUMS}, CAST(sum(al.amount_paise) AS BIGINT) AS total_paise,
    count(DISTINCT t.id) AS transactions, CAST(sum(abs(al.amount_paise)) AS BIGINT) AS moved_paise
    FROM allocations al JOIN spend t ON t.id = al.transaction_id JOIN categories c ON c.id = al.category_id LEFT JOIN categories p ON p.id = c.parent_id GROUP BY c.id, c.name, p.name"""


@query("agg1_by_category", BY_CATEGORY)
def _(l: Ledger) -> DataFrame:
    return reports.by_category(l.transactions, l.allocations, l.categories)


@query(
    "agg2_totals",
    """WITH x AS (SELECT amount_paise, abs(amount_paise - coalesce(explained, 0)) AS left_open FROM spend LEFT JOIN explained ON id = transaction_id)
    SELECT CAST(coalesce(sum(-amount_paise) FILTER (amount_paise < 0), 0) AS BIGINT) AS out_paise, CAST(coalesce(sum(amount_paise) FILTER (amount_paise > 0), 0) AS BIGINT) AS in_paise,
    CAST(coalesce(sum(left_open), 0) AS BIGINT) AS unexplained_paise, CAST(coalesce(sum(left_open) FILTER (amount_paise < 0), 0) AS BIGINT) AS unexplained_out_paise,
    CAST(coalesce(sum(left_open) FILTER (amount_paise > 0), 0) AS BIGINT) AS unexplained_in_paise, count(*) AS transactions FROM x""",
)
def _(l: Ledger) -> DataFrame:
    return reports.totals(l.transactions, l.allocations)


@query(
    "agg3_by_rule",
    """WITH x AS (SELECT coalesce(al.rule_id, al.confirmed_from_rule_id) AS r, al.rule_id AS own, t.id, t.txn_date, al.amount_paise FROM allocations al JOIN spend t ON t.id = al.transaction_id)
    SELECT CAST(rules.id AS BIGINT) AS rule_id, name, enabled, CAST(priority AS BIGINT) AS priority, count(x.id) AS allocations, count(DISTINCT x.id) AS transactions, CAST(coalesce(sum(abs(amount_paise)), 0) AS BIGINT) AS moved_paise,
    CAST(coalesce(sum(amount_paise), 0) AS BIGINT) AS net_paise, count(x.own) AS provisional, count(x.id) - count(x.own) AS confirmed, min(txn_date) AS first_seen, max(txn_date) AS last_seen
    FROM rules LEFT JOIN x ON x.r = rules.id GROUP BY rules.id, name, enabled, priority""",
)
def _(l: Ledger) -> DataFrame:
    return reports.by_rule(l.transactions, l.allocations, l.rules)


@query(
    "agg4_summary",
    """WITH r AS (SELECT transaction_id, sum(abs(amount_paise)) AS p FROM allocations WHERE source = 'rule' GROUP BY transaction_id),
    x AS (SELECT t.amount_paise, coalesce(explained, 0) AS e, coalesce(p, 0) AS p, type <> 'opening_balance' AND type <> 'transfer' AND transfer_status IS DISTINCT FROM 'resolved' AS gate
    FROM transactions t LEFT JOIN explained ON id = explained.transaction_id LEFT JOIN r ON id = r.transaction_id)
    SELECT CAST(sum(amount_paise) AS BIGINT) AS net_paise, CAST(sum(abs(amount_paise - e)) FILTER (gate) AS BIGINT) AS unexplained_paise, count(*) FILTER (gate AND amount_paise <> e) AS unexplained_transactions,
    CAST(sum(p) FILTER (gate) AS BIGINT) AS provisional_paise FROM x""",
)
def _(l: Ledger) -> DataFrame:
    return reports.summary(l.transactions, l.allocations)


BY_MONTH = """WITH s AS (SELECT transaction_id, sum(amount_paise) AS e, coalesce(sum(amount_paise) FILTER (source = 'rule'), 0) AS r, coalesce(sum(amount_paise) FILTER (source = 'user'), 0) AS u,
    coalesce(sum(amount_paise) FILTER (source = 'evidence'), 0) AS v FROM allocations GROUP BY transaction_id)
    SELECT strftime(txn_date, '%Y-%m') AS month, CAST(sum(-amount_paise) AS BIGINT) AS out_paise, CAST(coalesce(sum(-r), 0) AS BIGINT) AS provisional_paise, CAST(coalesce(sum(-u), 0) AS BIGINT) AS confirmed_paise,
    CAST(coalesce(sum(-v), 0) AS BIGINT) AS evidence_paise, CAST(sum(abs(amount_paise - coalesce(e, 0))) AS BIGINT) AS unexplained_paise, count(*) AS debits
    FROM spend LEFT JOIN s ON id = transaction_id WHERE amount_paise < 0 GROUP BY 1"""


@query("agg5_by_month", BY_MONTH)
def _(l: Ledger) -> DataFrame:
    return reports.by_month(l.transactions, l.allocations)


@query(
    "agg6_consumption",
    """SELECT r.category_id, c.name AS category, p.name AS parent, CAST(sum(-amount_paise) AS BIGINT) AS consumed_paise, count(*) AS entries
    FROM consumption_rows r JOIN categories c ON c.id = r.category_id LEFT JOIN categories p ON p.id = c.parent_id GROUP BY r.category_id, c.name, p.name""",
)
def _(l: Ledger) -> DataFrame:
    return reports.consumption_by_category(reports.consumption_rows(l.transactions, l.allocations, l.consumption, l.categories), l.categories)


SIDE = """SELECT CAST(coalesce(sum(-amount_paise) FILTER (origin = 'paid_for_you'), 0) AS BIGINT) AS paid_for_you_paise,
    CAST(coalesce(sum(amount_paise) FILTER (origin <> 'paid_for_you' AND amount_paise > 0), 0) AS BIGINT) AS received_paise, CAST(sum(-amount_paise) AS BIGINT) AS consumed_paise FROM consumption_rows"""
MONEY = """SELECT CAST(sum(-amount_paise) AS BIGINT) AS money_out_paise, CAST(sum(-(amount_paise - coalesce(explained, 0))) AS BIGINT) AS unexplained_paise, CAST(coalesce(sum(-f.fronted), 0) AS BIGINT) AS fronted_paise
    FROM spend t LEFT JOIN explained ON explained.transaction_id = t.id LEFT JOIN (SELECT al.transaction_id, sum(al.amount_paise) AS fronted FROM allocations al JOIN categories c ON c.id = al.category_id
    LEFT JOIN categories p ON p.id = c.parent_id WHERE c.excluded_from_spend OR coalesce(p.excluded_from_spend, false) GROUP BY al.transaction_id) f ON f.transaction_id = t.id WHERE t.amount_paise < 0"""


def _side(l: Ledger) -> DataFrame:
    return reports.side_terms(reports.consumption_rows(l.transactions, l.allocations, l.consumption, l.categories))


@query("agg7_side_terms", SIDE)
def _(l: Ledger) -> DataFrame:
    return _side(l)


@query("agg8_money_terms", MONEY)
def _(l: Ledger) -> DataFrame:
    return reports.money_terms(l.transactions, l.allocations, l.categories)


@query(
    "agg9_unclassified",
    "SELECT CAST(coalesce(sum(value_paise), 0) AS BIGINT) AS unclassified_paise, count(*) AS records FROM purchases LEFT JOIN source_map ON word = source_category WHERE category_id IS NULL",
)
def _(l: Ledger) -> DataFrame:
    return reports.unclassified(l.purchases, l.source_map)


@query(
    "agg10_unaccounted",
    f"WITH side AS ({SIDE}), money AS ({MONEY}) SELECT consumed_paise, consumed_paise - (money_out_paise - unexplained_paise - fronted_paise + paid_for_you_paise - received_paise) AS unaccounted_paise FROM side, money",
)
def _(l: Ledger) -> DataFrame:
    return reports.unaccounted(reports.money_terms(l.transactions, l.allocations, l.categories), _side(l))


@query(
    "agg11_balances",
    """SELECT a.id, a.name, a.bank, CAST(coalesce(sum(t.amount_paise), 0) AS BIGINT) AS balance_paise, count(t.id) AS transactions FROM accounts a LEFT JOIN transactions t ON t.account_id = a.id GROUP BY a.id, a.name, a.bank""",
)
def _(l: Ledger) -> DataFrame:
    return reports.balances(l.accounts, l.transactions)


@query(
    "agg12_transfer_counts",
    """SELECT transfer_status, count(DISTINCT coalesce('g:' || CAST(transfer_group_id AS VARCHAR), 'txn:' || CAST(id AS VARCHAR))) AS transfers, count(*) AS legs FROM transactions WHERE transfer_status IS NOT NULL GROUP BY transfer_status""",
)
def _(l: Ledger) -> DataFrame:
    return reports.transfer_counts(l.transactions)


VOCABULARY = """WITH w AS (SELECT word FROM purchases UNION SELECT source_category FROM source_map), u AS (SELECT word, count(*) AS n, sum(value_paise) AS v FROM purchases GROUP BY word)
    SELECT w.word, coalesce(n, 0) AS records, CAST(coalesce(v, 0) AS BIGINT) AS value_paise, CAST(category_id AS BIGINT) AS category_id, m.source_category IS NOT NULL AS mapped
    FROM w LEFT JOIN u ON u.word = w.word LEFT JOIN source_map m ON m.source_category = w.word"""


@query("agg13_set2_vocabulary", VOCABULARY)
def _(l: Ledger) -> DataFrame:
    return shared.vocabulary(l.purchases, l.source_map)


@query(
    "agg18_median",
    """SELECT CASE WHEN m > 0 THEN m END AS median_seconds FROM (SELECT CAST(round(quantile_cont(epoch(finished_at)::BIGINT - epoch(created_at)::BIGINT, 0.5)) AS BIGINT) AS m
    FROM (SELECT date_trunc('second', finished_at) AS finished_at, date_trunc('second', created_at) AS created_at FROM jobs WHERE state = 'done'))""",
)
def _(l: Ledger) -> DataFrame:
    return queue.median_seconds(l.jobs)


@query(
    "agg19_progress",
    """SELECT batch_id, count(*) AS total, count(*) FILTER (state = 'queued') AS queued, count(*) FILTER (state = 'running') AS running, count(*) FILTER (state = 'done') AS done, count(*) FILTER (state = 'failed') AS failed,
    count(*) FILTER (state IN ('done', 'failed')) * 1000 // count(*) AS done_permille FROM jobs GROUP BY batch_id""",
)
def _(l: Ledger) -> DataFrame:
    return queue.progress(l.jobs)


@query(
    "agg21_nested_allocations",
    """SELECT t.id, coalesce(string_agg(al.source || ':' || CAST(al.amount_paise AS VARCHAR), ',' ORDER BY al.source, al.amount_paise), '') AS slices FROM transactions t LEFT JOIN allocations al ON al.transaction_id = t.id GROUP BY t.id""",
)
def _(l: Ledger) -> DataFrame:
    nested = l.allocations.groupBy(F.col("transaction_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("source", "amount_paise"))).alias("s"))
    slices = F.transform("s", lambda x: F.concat(x["source"], F.lit(":"), x["amount_paise"].cast("string")))
    return l.transactions.select("id").join(nested, "id", "left").select("id", F.coalesce(F.array_join(slices, ","), F.lit("")).alias("slices"))


@query(
    "agg22_category_names_by_rule",
    """SELECT al.rule_id, string_agg(DISTINCT c.name, ',' ORDER BY c.name) AS names FROM allocations al JOIN categories c ON c.id = al.category_id WHERE al.rule_id IS NOT NULL GROUP BY al.rule_id""",
)
def _(l: Ledger) -> DataFrame:
    rows = l.allocations.where("rule_id is not null").join(l.categories.select(F.col("id").alias("category_id"), "name"), "category_id")
    return rows.groupBy("rule_id").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"))


@query(
    "agg23_month_trend",
    f"""WITH m AS (SELECT month, out_paise, lag(out_paise) OVER (ORDER BY month) AS prev FROM ({BY_MONTH.replace("WITH s AS", "WITH s2 AS").replace("LEFT JOIN s ON", "LEFT JOIN s2 ON")}))
    SELECT month, out_paise, out_paise - prev AS delta_paise, CASE WHEN prev <> 0 THEN CAST(floor((out_paise - prev) * 1000 / abs(prev) + 0.5) AS BIGINT) END AS change_permille FROM m""",
)
def _(l: Ledger) -> DataFrame:
    return reports.month_trend(reports.by_month(l.transactions, l.allocations))


@query(
    "agg23_compare_periods",
    """SELECT CAST(coalesce(sum(-amount_paise) FILTER (txn_date >= DATE '1998-01-01'), 0) AS BIGINT) AS now_paise, CAST(coalesce(sum(-amount_paise) FILTER (txn_date < DATE '1998-01-01'), 0) AS BIGINT) AS before_paise
    FROM spend WHERE amount_paise < 0 AND txn_date BETWEEN DATE '1997-10-03' AND DATE '1998-03-31'""",
)
def _(l: Ledger) -> DataFrame:
    return reports.compare_periods(l.transactions, "1998-01-01", "1998-03-31")


@query(
    "agg24_parent_rollup",
    f"""WITH b AS ({BY_CATEGORY}) SELECT coalesce(c.parent_id, c.id) AS root_id, CAST(sum(total_paise) AS BIGINT) AS total_paise, CAST(sum(transactions) AS BIGINT) AS transactions, count(*) AS categories
    FROM b JOIN categories c ON c.id = b.category_id GROUP BY 1""",
)
def _(l: Ledger) -> DataFrame:
    return reports.rollup_parents(reports.by_category(l.transactions, l.allocations, l.categories), l.categories)


@query("set1_consumption_rows", "SELECT * FROM consumption_rows")
def _(l: Ledger) -> DataFrame:
    return reports.consumption_rows(l.transactions, l.allocations, l.consumption, l.categories)


@query(
    "cat1_jn5_category_usage",
    """SELECT c.id, c.name, c.parent_id, p.name AS parent, c.excluded_from_spend, (SELECT count(*) FROM allocations a WHERE a.category_id = c.id) AS allocations, (SELECT count(*) FROM rules r WHERE r.category_id = c.id) AS rules,
    (SELECT count(*) FROM items i WHERE i.category_id = c.id) AS items FROM categories c LEFT JOIN categories p ON p.id = c.parent_id""",
)
def _(l: Ledger) -> DataFrame:
    return reports.category_usage(l.categories, l.allocations, l.rules, l.items)


# Filters, listings and pages


@query("flt1_spend", "SELECT id, amount_paise FROM spend")
def _(l: Ledger) -> DataFrame:
    return l.transactions.where(predicates.explainable_spend()).select("id", "amount_paise")


def _filtered(name: str, where: str, **options) -> None:
    @query(name, f"SELECT id, account_id, txn_date, amount_paise FROM transactions t WHERE {where}")
    def _(l: Ledger) -> DataFrame:
        return predicates.LedgerFilter(**options).apply(l.transactions, l.allocations, l.categories).select("id", "account_id", "txn_date", "amount_paise")


_OF = "EXISTS (SELECT 1 FROM allocations al WHERE al.transaction_id = t.id AND"
_filtered("flt2_date_range", "txn_date BETWEEN DATE '1996-02-01' AND DATE '1996-05-31'", date_from="1996-02-01", date_to="1996-05-31")
_filtered("flt3_account", "account_id = 7", account_id=7)
_filtered("flt4_category_family", f"{_OF} al.category_id IN (SELECT id FROM categories WHERE id = 2 OR parent_id = 2))", category_id=2)
_filtered("flt5_rule_owned", f"{_OF} al.rule_id = 4)", rule_id=4)
_filtered("flt6_provenance", f"{_OF} al.source = 'evidence')", source="evidence")
_filtered("flt7_unexplained", "amount_paise <> coalesce((SELECT explained FROM explained e WHERE e.transaction_id = t.id), 0)", source="unexplained")
_filtered("flt8_search", "contains(lower(narration), '0-blue')", search="0-BLUE")
_filtered("flt9_direction", "amount_paise > 0", direction="in")
_filtered("flt10_spend_only", "type NOT IN ('opening_balance', 'transfer') AND transfer_status IS DISTINCT FROM 'resolved' AND account_id = 3", spend_only=True, account_id=3)
_filtered("flt17_ids", "id IN (5, 6, 7, 100, 250)", ids=(5, 6, 7, 100, 250))


@query("flt14_sibling_clash", "SELECT id, name FROM categories WHERE parent_id IS NOT DISTINCT FROM 3 AND lower(name) = 'brand#3'")
def _(l: Ledger) -> DataFrame:
    return predicates.sibling_clash(l.categories, "BRAND#3", 3).select("id", "name")


@query("flt15_unlinked", "SELECT id, source_type FROM evidence e WHERE NOT EXISTS (SELECT 1 FROM evidence_transactions x WHERE x.evidence_id = e.id)")
def _(l: Ledger) -> DataFrame:
    return predicates.unlinked(l.evidence, l.evidence_transactions).select("id", "source_type")


@query("flt16_open_leg", "SELECT id, transfer_status FROM transactions WHERE transfer_status IS DISTINCT FROM 'resolved' AND transfer_status IS DISTINCT FROM 'rejected'")
def _(l: Ledger) -> DataFrame:
    return l.transactions.where(predicates.open_leg()).select("id", "transfer_status")


@query("flt18_items_like", "SELECT id, label FROM items WHERE lower(label) LIKE '%b_ue%brand#1%'")
def _(l: Ledger) -> DataFrame:
    return predicates.like_items(l.items, "b_ue%brand#1").select("id", "label")


PAGE = "ORDER BY txn_date DESC, account_id, statement_id NULLS LAST, statement_seq NULLS LAST, id LIMIT 100 OFFSET 100"


@query("srt1_ledger_page", f"SELECT id, account_id, txn_date FROM transactions {PAGE}")
def _(l: Ledger) -> DataFrame:
    order = (F.desc("txn_date"), "account_id", F.col("statement_id").asc_nulls_last(), F.col("statement_seq").asc_nulls_last(), "id")
    return l.transactions.orderBy(*order).select("id", "account_id", "txn_date").offset(100).limit(100)


@query("srt2_near", "SELECT id, txn_date FROM transactions ORDER BY abs(txn_date - DATE '1997-06-15'), id LIMIT 50")
def _(l: Ledger) -> DataFrame:
    return l.transactions.orderBy(text.day_gap(F.col("txn_date"), F.lit("1997-06-15").cast("date")), "id").select("id", "txn_date").limit(50)


@query(
    "srt4_transfer_page",
    """WITH x AS (SELECT *, coalesce('g:' || CAST(transfer_group_id AS VARCHAR), 'txn:' || CAST(id AS VARCHAR)) AS key FROM transactions WHERE transfer_status IS NOT NULL),
    g AS (SELECT key, min(txn_date) AS first_date FROM x GROUP BY key ORDER BY first_date DESC, key DESC LIMIT 40) SELECT x.key, first_date, id, account_id, amount_paise, txn_date, transfer_status FROM x JOIN g ON g.key = x.key""",
)
def _(l: Ledger) -> DataFrame:
    return transfers.page(l.transactions, limit=40)


ENTRIES = "ORDER BY consumed_on DESC, transaction_id DESC NULLS LAST, evidence_id DESC NULLS FIRST LIMIT 80"


@query("srt5_win1_entries", f"SELECT origin, transaction_id, evidence_id, amount_paise, (SELECT count(*) FROM consumption_rows) AS total FROM consumption_rows {ENTRIES}")
def _(l: Ledger) -> DataFrame:
    rows = reports.consumption_rows(l.transactions, l.allocations, l.consumption, l.categories)
    total = rows.agg(F.count("*").alias("total"))
    top = rows.orderBy(F.desc("consumed_on"), F.desc_nulls_last("transaction_id"), F.desc_nulls_first("evidence_id")).limit(80)
    return top.crossJoin(total).select("origin", "transaction_id", "evidence_id", "amount_paise", "total")


# Reconciliation

POINTS = """SELECT s.*, row_number() OVER w = 1 AND o.account_id IS NULL AS anchor, CASE WHEN row_number() OVER w = 1 AND o.account_id IS NULL THEN bank_balance_paise WHEN row_number() OVER w = 1 THEN run
    ELSE lag(bank_balance_paise) OVER w + run - lag(run) OVER w END AS expected_paise, row_number() OVER (PARTITION BY s.account_id ORDER BY txn_date DESC, statement_id DESC NULLS FIRST, statement_seq DESC NULLS FIRST, id DESC) AS from_end
    FROM stated s LEFT JOIN (SELECT DISTINCT account_id FROM transactions WHERE type = 'opening_balance') o ON o.account_id = s.account_id WHERE bank_balance_paise IS NOT NULL
    WINDOW w AS (PARTITION BY s.account_id ORDER BY txn_date, statement_id NULLS LAST, statement_seq NULLS LAST, id)"""
RECONCILE = f"""WITH pts AS ({POINTS}), per AS (SELECT account_id, count(*) AS n, count(*) FILTER (expected_paise <> bank_balance_paise) AS bad, max(bank_balance_paise - run) FILTER (anchor) AS implied,
    max(bank_balance_paise - run) FILTER (from_end = 1) AS last FROM pts GROUP BY account_id), al AS (SELECT account_id, sum(amount_paise) AS balance, max(CAST(type = 'opening_balance' AS INTEGER)) AS opened FROM transactions GROUP BY account_id)
    SELECT al.account_id, CAST(balance AS BIGINT) AS balance_paise, coalesce(n, 0) AS checkpoints, coalesce(bad, 0) AS discrepancies, implied AS implied_opening_paise, last - coalesce(implied, 0) AS total_difference_paise,
    CASE WHEN opened = 1 THEN 'opening_balance_row' WHEN n > 0 THEN 'first_stated_balance' ELSE 'none' END AS opening_anchor, coalesce(n, 0) > 0 AS verifiable, coalesce(bad, 0) = 0 AS reconciled
    FROM al LEFT JOIN per ON per.account_id = al.account_id"""


@query("win3_reconcile", RECONCILE)
def _(l: Ledger) -> DataFrame:
    return reconcile.reconcile(l.stated)


@query(
    "win3_discrepancies",
    f"""WITH pts AS ({POINTS}) SELECT account_id, id AS transaction_id, txn_date, expected_paise, bank_balance_paise AS stated_paise, bank_balance_paise - expected_paise AS difference_paise FROM pts WHERE expected_paise <> bank_balance_paise""",
)
def _(l: Ledger) -> DataFrame:
    return reconcile.discrepancies(l.stated)


@query("win3_anomalies", f"WITH rec AS ({RECONCILE.replace('WITH pts', 'WITH pts2').replace('FROM pts ', 'FROM pts2 ')}) SELECT * FROM rec WHERE verifiable AND NOT reconciled")
def _(l: Ledger) -> DataFrame:
    return reconcile.anomalies(l.stated)


@query(
    "win6_self_check",
    """WITH x AS (SELECT account_id, statement_id, id, lag(bank_balance_paise) OVER (PARTITION BY account_id, statement_id ORDER BY txn_date, statement_seq NULLS LAST, id) AS previous_paise, amount_paise, bank_balance_paise
    FROM stated WHERE statement_id IS NOT NULL) SELECT * FROM x WHERE previous_paise + amount_paise <> bank_balance_paise""",
)
def _(l: Ledger) -> DataFrame:
    return reconcile.self_check(l.stated)


# Rules

NORMAL = "trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(narration, '')), '[-/*_.:,#|]+', ' ', 'g'), '[0-9]{6,}', ' ', 'g'), '\\s+', ' ', 'g'))"
WINNER = f"""CASE WHEN contains({NORMAL}, 'blue') AND contains({NORMAL}, 'bolt') THEN 2 WHEN contains({NORMAL}, 'ring') AND txn_date > DATE '1999-01-01' THEN 5 WHEN contains({NORMAL}, 'anvil') THEN 1
    WHEN contains({NORMAL}, 'gear') OR amount_paise < -45000000 THEN 3 WHEN amount_paise > 30000000 THEN 6 END"""


@query("rul1_normalise", f"SELECT id, {NORMAL} AS normal FROM transactions")
def _(l: Ledger) -> DataFrame:
    return l.transactions.select("id", text.normalise(F.col("narration")).alias("normal"))


@query("rul5_winner", f"SELECT id, CAST({WINNER} AS BIGINT) AS rule_id FROM transactions")
def _(l: Ledger) -> DataFrame:
    return l.transactions.select("id", rules.winner(ALL_RULES).alias("rule_id"))


OUTCOME = f"""WITH per AS (SELECT transaction_id, max(CAST(source = 'user' AS INTEGER)) AS u, sum(CASE WHEN source <> 'rule' THEN amount_paise ELSE 0 END) AS kept, count(*) FILTER (source = 'rule') AS n,
    max(rule_id) FILTER (source = 'rule') AS r, max(category_id) FILTER (source = 'rule') AS c, max(amount_paise) FILTER (source = 'rule') AS a FROM allocations GROUP BY transaction_id),
    x AS (SELECT t.id, coalesce(u, 0) = 1 AS locked, amount_paise - coalesce(kept, 0) AS remainder, coalesce(n, 0) AS n, r, c, a, {WINNER} AS w FROM transactions t LEFT JOIN per ON per.transaction_id = t.id),
    y AS (SELECT *, CASE w WHEN 1 THEN 1001 WHEN 2 THEN 2002 WHEN 3 THEN 3003 WHEN 5 THEN 5005 WHEN 6 THEN 6006 END AS wc FROM x)
    SELECT id, CAST(remainder AS BIGINT) AS remainder, CAST(w AS BIGINT) AS rule_id, CASE WHEN locked THEN 'locked' WHEN w IS NOT NULL AND remainder <> 0 AND n = 1 AND r = w AND c = wc AND a = remainder THEN 'unchanged'
    WHEN w IS NOT NULL AND remainder <> 0 AND n > 0 THEN 'replace' WHEN w IS NOT NULL AND remainder <> 0 THEN 'create' WHEN n > 0 THEN 'remove' ELSE 'none' END AS action FROM y"""


@query("rul7_apply", OUTCOME)
def _(l: Ledger) -> DataFrame:
    return rules.outcome(l.transactions, l.allocations, ALL_RULES).select("id", "remainder", "rule_id", "action")


@query("rul7_counters", f"SELECT count(*) FILTER (action IN ('create', 'replace')) AS created, count(*) FILTER (action IN ('replace', 'remove')) AS removed FROM ({OUTCOME})")
def _(l: Ledger) -> DataFrame:
    l = l.once("base")
    return rules.apply_rules(l.transactions, l.allocations, ALL_RULES).counters()


@query(
    "rul9_preview",
    f"""WITH per AS (SELECT transaction_id, max(CAST(source = 'user' AS INTEGER)) AS u, sum(CASE WHEN source <> 'rule' THEN amount_paise ELSE 0 END) AS kept FROM allocations GROUP BY transaction_id)
    SELECT id, amount_paise, coalesce(u, 0) = 1 AS user_locked, amount_paise - coalesce(kept, 0) <> 0 AS would_explain FROM transactions t LEFT JOIN per ON per.transaction_id = t.id WHERE contains({NORMAL}, 'widget') AND amount_paise < -1000000""",
)
def _(l: Ledger) -> DataFrame:
    rule = rules.Rule(99, "unsaved", (rules.Condition("narration", "contains", "WIDGET"), rules.Condition("amount_paise", "lt", -1000000)))
    return rules.preview(l.transactions, l.allocations, rule)


@query(
    "rul11_confirm",
    """SELECT id, CASE WHEN source = 'rule' AND id % 4 = 0 THEN 'user' ELSE source END AS source, CASE WHEN source = 'rule' AND id % 4 = 0 THEN rule_id ELSE confirmed_from_rule_id END AS confirmed_from_rule_id,
    CASE WHEN NOT (source = 'rule' AND id % 4 = 0) THEN rule_id END AS rule_id FROM allocations""",
)
def _(l: Ledger) -> DataFrame:
    return rules.confirm(l.allocations, l.transactions.where("id % 4 = 0").select("id")).select("id", "source", "confirmed_from_rule_id", "rule_id")


@query(
    "rul12_manual",
    """SELECT t.id AS transaction_id, t.id % 9 <> 1 AND t.amount_paise <> 0 AND t.id % 9 <> 2 AS ok FROM transactions t WHERE t.id % 3 < 3 AND abs(t.amount_paise) > 10""",
)
def _(l: Ledger) -> DataFrame:
    k, a = F.col("id"), F.col("amount_paise")
    wanted = l.transactions.where(F.abs(a) > 10).select(k.alias("transaction_id"), F.explode(F.array(F.expr("amount_paise div 2"), F.when(k % 9 == 1, -a).when(k % 9 == 2, a).otherwise(F.expr("amount_paise div 3")))).alias("amount_paise"))
    return rules.valid_manual(wanted, l.transactions)


#: Each order's lines as slices by category of the row that is numbered like it: their sums are over it, under it, or of the other sign.
REQUESTED = "(SELECT l.evidence_id AS transaction_id, i.category_id, CAST(-sum(l.amount_paise) AS BIGINT) AS amount_paise FROM lines l JOIN items i ON i.id = l.item_id GROUP BY l.evidence_id, i.category_id)"
JUDGED = f"""(SELECT r.transaction_id, CASE WHEN bool_or(r.category_id IS NULL) THEN 'no_category' WHEN min(t.id) IS NULL THEN 'no_such_transaction' WHEN min(t.amount_paise) > 0 THEN 'other_sign' WHEN abs(sum(r.amount_paise)) > abs(min(t.amount_paise)) THEN 'too_much' ELSE 'ok' END AS verdict,
    CAST(min(t.amount_paise) - sum(r.amount_paise) AS BIGINT) AS left_over FROM {REQUESTED} r LEFT JOIN transactions t ON t.id = r.transaction_id GROUP BY r.transaction_id)"""


def _manual(l: Ledger):
    priced = l.lines.join(l.items.select(F.col("id").alias("item_id"), "category_id"), "item_id")
    requested = priced.groupBy(F.col("evidence_id").alias("transaction_id"), "category_id").agg((-F.sum("amount_paise")).alias("amount_paise"))
    return rules.replace_manual(requested, l.transactions, l.categories, l.allocations)


@query("rul12_verdicts", f"SELECT transaction_id, verdict, CASE WHEN verdict = 'ok' THEN left_over END AS unexplained_paise FROM {JUDGED}")
def _(l: Ledger) -> DataFrame:
    return _manual(l)[0]


@query(
    "rul12_replace",
    f"""SELECT 'in' AS what, transaction_id, category_id, amount_paise, 'user' AS source FROM {REQUESTED} WHERE transaction_id IN (SELECT transaction_id FROM {JUDGED} WHERE verdict = 'ok')
    UNION ALL SELECT 'out', transaction_id, category_id, amount_paise, source FROM allocations WHERE transaction_id IN (SELECT transaction_id FROM {JUDGED} WHERE verdict = 'ok')""",
)
def _(l: Ledger) -> DataFrame:
    return _flat(_manual(l)[1]).drop("rule_id", "evidence_id")


# Mining


@query("min3_hint_words", f"SELECT id, len(list_filter(string_split({NORMAL}, ' '), lambda w: length(w) > 2 AND NOT regexp_matches(w, '^[0-9]+$'))) AS words FROM transactions")
def _(l: Ledger) -> DataFrame:
    return l.transactions.select("id", F.size(mining.words(F.col("narration"))).alias("words"))


NOISE_SQL = ", ".join(f"'{w}'" for w in mining.NOISE)
MERCHANT = f"list_filter(string_split({NORMAL}, ' '), lambda w: length(w) > 2 AND NOT regexp_matches(w, '^[0-9]+$') AND w NOT IN ({NOISE_SQL}) AND NOT regexp_matches(w, '^[a-z]{{4}}0') AND NOT w LIKE '@%')"


@query("min3_hint", f"SELECT id, array_to_string(list_filter(x, lambda w, i: list_position(x, w) = i), ' ') AS hint FROM (SELECT id, {MERCHANT} AS x FROM transactions)")
def _(l: Ledger) -> DataFrame:
    return l.transactions.select("id", mining.merchant_hint(F.col("narration")).alias("hint"))


NOISY = f"(w IN ({NOISE_SQL}) OR w LIKE '@%' OR regexp_matches(w, '^([^@]{{0,2}}|[0-9]+)@') OR regexp_matches(w, '^[a-z]{{4}}0'))"
MINED = f"""texts AS (SELECT t.id, {NORMAL} AS normal, t.amount_paise <> coalesce(explained, 0) AS open, t.amount_paise, t.txn_date, t.narration
        FROM spend t LEFT JOIN explained e ON e.transaction_id = t.id),
    parts_of AS (SELECT id, unnest(x) AS w, unnest(range(len(x))) AS i FROM (SELECT id, list_filter(string_split(normal, ' '), lambda w: length(w) > 2 AND NOT regexp_matches(w, '^[0-9]+$')) AS x FROM texts WHERE open)),
    marked AS (SELECT *, {NOISY} AS noise FROM parts_of),
    tokened AS (SELECT id, w AS token FROM marked WHERE NOT noise UNION SELECT a.id, a.w || ' ' || b.w FROM marked a JOIN marked b ON b.id = a.id AND b.i = a.i + 1 WHERE NOT (a.noise AND b.noise)),
    wanted AS (SELECT token, count(*) AS support FROM tokened GROUP BY token HAVING count(*) >= 3),
    met AS (SELECT token, x.* FROM wanted JOIN texts x ON contains(normal, token)),
    per_category AS (SELECT token, category_id, count(*) AS n, row_number() OVER (PARTITION BY token ORDER BY count(*) DESC, category_id) AS place
        FROM met JOIN (SELECT DISTINCT transaction_id, category_id FROM allocations) a ON a.transaction_id = met.id GROUP BY token, category_id),
    spreads AS (SELECT token, count(*) AS spread, string_agg(category_id || ':' || n, ',' ORDER BY place) FILTER (place <= 4) AS detail FROM per_category GROUP BY token),
    hit AS (SELECT token, count(*) FILTER (open) AS hits, count(*) AS ledger_hits, count(*) FILTER (id IN (SELECT transaction_id FROM allocations)) AS explained_hits,
        bool_and(contains(normal, 'anvil')) FILTER (open) AS anvils, bool_and(contains(normal, 'bolt')) FILTER (open) AS bolts, string_agg(id, ',' ORDER BY id) FILTER (open) AS ids FROM met GROUP BY token HAVING count(*) FILTER (open) >= 3),
    mined AS (SELECT hit.token, hits, ledger_hits, CAST(round(ledger_hits * 1000.0 / (SELECT count(*) FROM texts)) AS BIGINT) AS breadth_permille, explained_hits, coalesce(spread, 0) AS spread, coalesce(detail, '') AS spread_detail,
        CASE WHEN anvils THEN 'all anvils' WHEN bolts THEN 'all bolts' END AS collides_with, CAST(len(string_split(hit.token, ' ')) AS BIGINT) AS words, ids FROM hit LEFT JOIN spreads ON spreads.token = hit.token)"""
MINING_RULES = [rules.Rule(i, f"all {word}s", (rules.Condition("narration", "contains", word),)) for i, word in enumerate(("anvil", "bolt"))]


def _mined(found: DataFrame) -> DataFrame:
    detail = F.array_join(F.transform(F.coalesce("spread_detail", F.array().cast("array<struct<category_id:bigint,count:bigint>>")), lambda d: F.concat_ws(":", d["category_id"].cast("string"), d["count"].cast("string"))), ",")
    return found.withColumn("breadth_permille", F.round(F.col("breadth") * 1000).cast("long")).withColumn("spread_detail", detail).drop("breadth")


@query("min2_token_support", f"WITH {MINED} SELECT token, support FROM wanted")
def _(l: Ledger) -> DataFrame:
    return mining.support(predicates.unexplained(l.transactions.where(predicates.explainable_spend()), l.allocations))


@query("min4_candidates", f"WITH {MINED} SELECT * EXCLUDE (ids) FROM mined")
def _(l: Ledger) -> DataFrame:
    return _mined(mining.candidates(l.transactions.where(predicates.explainable_spend()), l.allocations, MINING_RULES))


@query(
    "min5_same_rows",
    f"""WITH {MINED}, sets AS (SELECT token, count(*) AS hits, string_agg(id, ',' ORDER BY id) AS ids FROM tokened GROUP BY token),
    kept AS (SELECT *, row_number() OVER (PARTITION BY ids ORDER BY len(string_split(token, ' ')), token) AS place FROM sets) SELECT token, hits FROM kept WHERE place = 1""",
)
def _(l: Ledger) -> DataFrame:
    open_ = predicates.unexplained(l.transactions.where(predicates.explainable_spend()), l.allocations)
    return mining.same_rows(open_.select("id", F.explode(mining.tokens(F.col("narration"))).alias("token")))


@query(
    "min6_report",
    f"""WITH {MINED}, kept AS (SELECT *, row_number() OVER (PARTITION BY ids ORDER BY words, token) AS place FROM mined) SELECT * EXCLUDE (ids, place) FROM kept WHERE place = 1 ORDER BY spread, hits DESC, token LIMIT 40""",
)
def _(l: Ledger) -> DataFrame:
    return _mined(mining.report(l.transactions.where(predicates.explainable_spend()), l.allocations, MINING_RULES))


@query(
    "min6_covered",
    f"""WITH {MINED}, kept AS (SELECT *, row_number() OVER (PARTITION BY ids ORDER BY words, token) AS place FROM mined), top AS (SELECT * FROM kept WHERE place = 1 ORDER BY spread, hits DESC, token LIMIT 40),
    s AS (SELECT t.id, amount_paise <> coalesce(e.explained, 0) AS open, {NORMAL} AS normal FROM spend t LEFT JOIN (SELECT transaction_id, sum(amount_paise) AS explained FROM allocations GROUP BY transaction_id) e ON t.id = e.transaction_id)
    SELECT count(*) FILTER (open) AS unexplained, count(*) AS ledger, count(*) FILTER (open AND EXISTS (SELECT 1 FROM top WHERE contains(normal, top.token))) AS covered FROM s""",
)
def _(l: Ledger) -> DataFrame:
    """How many unexplained rows the candidates that are shown claim between them."""
    ledger = l.transactions.where(predicates.explainable_spend())
    return mining.covered(mining.report(ledger, l.allocations, MINING_RULES), ledger, l.allocations)


# Transfers

REFS = "list_filter(string_split_regex(coalesce(narration, ''), '[^0-9A-Za-z]+'), lambda w: regexp_matches(w, '^[0-9]{12}$'))"


@query("trf1_references", f"SELECT id, array_to_string({REFS}, ',') AS refs FROM transactions")
def _(l: Ledger) -> DataFrame:
    return l.transactions.select("id", F.array_join(text.references(F.col("narration")), ",").alias("refs"))


REF_PAIRS = f"""WITH r AS (SELECT id, account_id, amount_paise, txn_date, unnest({REFS}) AS ref FROM transactions WHERE type <> 'opening_balance' AND transfer_status IS DISTINCT FROM 'resolved' AND transfer_status IS DISTINCT FROM 'rejected'),
    two AS (SELECT ref FROM r GROUP BY ref HAVING count(DISTINCT id) = 2)
    SELECT a.id, b.id AS partner_id, a.ref AS reference, a.amount_paise FROM r a JOIN two ON two.ref = a.ref JOIN r b ON b.ref = a.ref AND b.id <> a.id WHERE a.account_id <> b.account_id AND a.amount_paise = -b.amount_paise AND abs(a.txn_date - b.txn_date) <= 2"""


@query("trf3_pairs", REF_PAIRS)
def _(l: Ledger) -> DataFrame:
    return transfers.by_reference(l.transactions.where(predicates.open_leg() & (F.col("type") != "opening_balance"))).select("id", "partner_id", "reference", "amount_paise")


LOCKED = "SELECT transaction_id FROM allocations WHERE source = 'user'"


@query(
    "trf4_reference_pass",
    f"""WITH p AS ({REF_PAIRS.replace('WITH r AS', 'WITH r2 AS').replace('FROM r ', 'FROM r2 ').replace('JOIN r b', 'JOIN r2 b')})
    SELECT id AS debit_id, partner_id AS credit_id, CASE WHEN id IN ({LOCKED}) OR partner_id IN ({LOCKED}) THEN 'suspected' ELSE 'resolved' END AS status, 'reference' AS evidence FROM p WHERE amount_paise < 0""",
)
def _(l: Ledger) -> DataFrame:
    return transfers.reference_pass(l.transactions, _locked(l))


def _locked(l: Ledger) -> DataFrame:
    return l.allocations.where("source = 'user'").select(F.col("transaction_id").alias("id"))


def _keywords(l: Ledger) -> DataFrame:
    """Each account answers to a product name in narrations; a third of the names are too weak to count."""
    rows = l.accounts.select(F.col("id").alias("account_id"), F.lower("name").alias("keyword"), F.when(F.col("id") % 3 == 0, "name").otherwise("upi_handle").alias("kind"))
    return rows.withColumn("keyword", F.when(F.col("account_id") == 2, "anvil-brand#2").when(F.col("account_id") == 4, "bolt-brand#1").otherwise(F.col("keyword")))


@query("trf5_keyword_pass")
def _(l: Ledger) -> DataFrame:
    l = l.once("base")
    return transfers.keyword_pass(l.transactions, _keywords(l), _locked(l))


@query("trf6_amount_date_pass")
def _(l: Ledger) -> DataFrame:
    return transfers.amount_date_pass(l.transactions)


@query("trf7_detect")
def _(l: Ledger) -> DataFrame:
    l = l.once("base")
    return transfers.detect(l.transactions, _keywords(l), _locked(l))


@query("trf9_reject_group", "SELECT id, CASE WHEN transfer_group_id = 79 THEN 'rejected' ELSE transfer_status END AS transfer_status FROM transactions WHERE transfer_group_id IS NOT NULL")
def _(l: Ledger) -> DataFrame:
    return transfers.decide(l.transactions, 79, "rejected").where("transfer_group_id is not null").select("id", "transfer_status")


# Evidence

CASH = "CASE WHEN kind = 'expense' AND my_net_paise > 0 THEN -cost_paise WHEN kind = 'payment' AND my_net_paise <> 0 THEN -my_net_paise END"
EXPECTED = f"(SELECT *, {CASH} AS expected_paise FROM evidence WHERE {CASH} IS NOT NULL)"


#: Words of the merchants' narrations; shared expenses have none.
TOKENS = {"invoice": ("ring", "bolt", "gear", "widget")}
TOLD = f"AND (e.source_type <> 'invoice' OR {' OR '.join(f"contains(lower(t.narration), '{w}')" for w in TOKENS['invoice'])})"


def _pairs(days: int, source: str = EXPECTED, told: str = "") -> str:
    return f"(SELECT e.id AS evidence_id, e.evidence_date, t.id AS transaction_id, abs(e.evidence_date - t.txn_date) AS gap FROM {source} e JOIN transactions t ON t.amount_paise = e.expected_paise AND abs(e.evidence_date - t.txn_date) <= {days} {told})"


def _match(source: str = EXPECTED, told: str = "") -> str:
    return f"""(SELECT e.id AS evidence_id, CASE WHEN n = 1 THEN 'matched' WHEN n > 1 THEN 'ambiguous' ELSE 'none' END AS outcome, CASE WHEN n = 1 THEN one END AS transaction_id
    FROM {source} e LEFT JOIN (SELECT evidence_id, count(*) AS n, min(transaction_id) AS one FROM {_pairs(3, source, told)} GROUP BY evidence_id) h ON h.evidence_id = e.id)"""


UNLINKED = f"(SELECT * FROM {EXPECTED} WHERE id NOT IN (SELECT evidence_id FROM evidence_transactions))"
ALLOCATED = "(SELECT transaction_id, max(CAST(source = 'user' AS INTEGER)) AS u, count(*) FILTER (source = 'evidence') AS n, max(evidence_id) AS c, count(*) FILTER (source = 'rule') AS d FROM allocations GROUP BY transaction_id)"
VERDICT = "CASE WHEN coalesce(a.n, 0) > 1 OR (coalesce(a.n, 0) = 1 AND a.c IS DISTINCT FROM m.evidence_id) THEN 'blocked_by_evidence' WHEN coalesce(a.u, 0) = 1 THEN 'blocked_by_user' ELSE 'write' END"


@query("evd1_expected_cash", f"SELECT id, {CASH} AS expected_paise FROM evidence")
def _(l: Ledger) -> DataFrame:
    return l.evidence.select("id", evidence.expected_cash(F.col("kind"), F.col("cost_paise"), F.col("my_net_paise")).alias("expected_paise"))


@query("evd3_match", f"SELECT * FROM {_match()}")
def _(l: Ledger) -> DataFrame:
    return evidence.match(l.evidence, l.transactions)


@query("evd4_near", f"SELECT evidence_id, transaction_id, gap, row_number() OVER (PARTITION BY evidence_id ORDER BY gap, transaction_id) AS place FROM {_pairs(10, told=TOLD)} WHERE gap > 3")
def _(l: Ledger) -> DataFrame:
    return evidence.near_misses(l.evidence, l.transactions, TOKENS)


@query(
    "evd5_split",
    """WITH x AS (SELECT l.evidence_id, line_index, cost_paise, amount_paise AS w, sum(amount_paise) OVER (PARTITION BY l.evidence_id) AS s, row_number() OVER (PARTITION BY l.evidence_id ORDER BY line_index DESC) AS back FROM lines l JOIN evidence e ON e.id = l.evidence_id),
    y AS (SELECT *, CAST(CAST(cost_paise AS HUGEINT) * w // s AS BIGINT) AS share FROM x)
    SELECT evidence_id, line_index, CAST(CASE WHEN back = 1 THEN cost_paise - coalesce(sum(share) FILTER (back > 1) OVER (PARTITION BY evidence_id), 0) ELSE share END AS BIGINT) AS share FROM y""",
)
def _(l: Ledger) -> DataFrame:
    rows = l.lines.join(l.evidence.select(F.col("id").alias("evidence_id"), "cost_paise"), "evidence_id")
    return evidence.split_proportionally(rows, "evidence_id", "line_index", "amount_paise", "cost_paise").select("evidence_id", "line_index", "share")


@query(
    "evd6_precedence",
    f"SELECT m.evidence_id, m.transaction_id, {VERDICT} AS verdict, CASE WHEN {VERDICT} = 'write' THEN coalesce(a.d, 0) ELSE 0 END AS displaced FROM {_match()} m LEFT JOIN {ALLOCATED} a ON a.transaction_id = m.transaction_id WHERE m.outcome = 'matched'",
)
def _(l: Ledger) -> DataFrame:
    found = evidence.match(l.evidence, l.transactions).where("outcome = 'matched'")
    return evidence.precedence(found.select("evidence_id", "transaction_id"), l.allocations)


@query(
    "evd7_claim",
    """SELECT t.id, CASE WHEN max(CAST(source = 'evidence' AS INTEGER)) = 1 THEN 'refused' WHEN max(CAST(source = 'user' AS INTEGER)) = 1 THEN 'yours' WHEN max(CAST(source = 'rule' AS INTEGER)) = 1 THEN 'replaces' ELSE 'free' END AS claim
    FROM transactions t LEFT JOIN allocations al ON al.transaction_id = t.id GROUP BY t.id""",
)
def _(l: Ledger) -> DataFrame:
    return evidence.claim_labels(l.transactions, l.allocations)


WORKLIST = f"""WITH m AS (SELECT * FROM {_match(UNLINKED, TOLD)} WHERE outcome <> 'none'), b AS (SELECT m.evidence_id FROM m LEFT JOIN {ALLOCATED} a ON a.transaction_id = m.transaction_id WHERE m.outcome = 'matched' AND {VERDICT} <> 'write'),
    n AS (SELECT DISTINCT evidence_id FROM {_pairs(10, UNLINKED, TOLD)} WHERE gap > 3)
    SELECT e.id AS evidence_id, source_type, evidence_date, expected_paise, CASE WHEN e.id IN (SELECT evidence_id FROM evidence_transactions) THEN 'matched' WHEN e.id IN (SELECT evidence_id FROM b) THEN 'conflicted'
    WHEN e.id IN (SELECT evidence_id FROM m) THEN 'proposed' WHEN e.id IN (SELECT evidence_id FROM n) THEN 'near' ELSE 'unmatched' END AS state FROM {EXPECTED} e"""


def _worklist(l: Ledger) -> DataFrame:
    return evidence.worklist(l.evidence, l.evidence_transactions, l.transactions, l.allocations, TOKENS)


@query("evd8_worklist", WORKLIST)
def _(l: Ledger) -> DataFrame:
    return _worklist(l)


@query(
    "agg14_batches",
    f"""SELECT source_type, count(*) AS records, {", ".join(f"count(*) FILTER (state = '{s}') AS {s}" for s in ("matched", "conflicted", "proposed", "near", "unmatched"))}, max(evidence_date) AS latest FROM ({WORKLIST}) GROUP BY source_type""",
)
def _(l: Ledger) -> DataFrame:
    return evidence.batches(_worklist(l))


@query(
    "evd10_sweep",
    f"""WITH judged AS (SELECT m.evidence_id, m.transaction_id, evidence_date, {VERDICT} AS verdict FROM {_match(UNLINKED, TOLD)} m JOIN evidence e ON e.id = m.evidence_id LEFT JOIN {ALLOCATED} a ON a.transaction_id = m.transaction_id WHERE m.outcome = 'matched')
    SELECT evidence_id, transaction_id, CASE WHEN verdict = 'write' AND row_number() OVER (PARTITION BY transaction_id, verdict ORDER BY evidence_date, evidence_id) = 1 THEN 'linked' ELSE 'conflicted' END AS result FROM judged""",
)
def _(l: Ledger) -> DataFrame:
    return evidence.sweep(l.evidence, l.evidence_transactions, l.transactions, l.allocations, TOKENS)


def _applied(l: Ledger):
    """Every record linked to its own row and, where there is one, to the mirrored row of it."""
    ids = l.evidence.select(F.col("id").alias("evidence_id"), F.explode(F.array(F.col("id"), F.col("id") + 1000000000000)).alias("transaction_id"))
    wanted = ids.join(l.transactions.select(F.col("id").alias("transaction_id")), "transaction_id")
    categories = l.evidence.where("id % 5 <> 0").select(F.col("id").alias("evidence_id"), (F.col("id") % 3 + 1).alias("category_id"))
    return evidence.apply_links(wanted, l.evidence, l.transactions, l.allocations, categories, shared_category=9)


LINKABLE = f"""w AS (SELECT e.id AS evidence_id, t.id AS transaction_id, t.amount_paise FROM evidence e JOIN transactions t ON t.id = e.id OR t.id = e.id + 1000000000000),
    allowed AS (SELECT *, min(CAST(verdict = 'write' AS INTEGER)) OVER (PARTITION BY evidence_id) AS good FROM (SELECT m.*, {VERDICT} AS verdict FROM w m LEFT JOIN {ALLOCATED} a ON a.transaction_id = m.transaction_id))"""


@query(
    "evd9_apply",
    f"""WITH {LINKABLE}, e AS (SELECT id, kind, my_net_paise AS net, abs(CASE WHEN kind = 'payment' THEN {CASH} ELSE cost_paise END) AS total FROM evidence WHERE {CASH} IS NOT NULL),
    x AS (SELECT evidence_id, transaction_id, kind, net, total, abs(amount_paise) AS wt, sum(abs(amount_paise)) OVER (PARTITION BY evidence_id) AS wts, row_number() OVER (PARTITION BY evidence_id ORDER BY transaction_id DESC) AS back
        FROM allowed JOIN e ON e.id = evidence_id WHERE good = 1),
    y AS (SELECT *, least(total, wts) AS cap, CAST(CAST(least(total, wts) AS HUGEINT) * wt // wts AS BIGINT) AS part FROM x),
    z AS (SELECT *, CASE WHEN back > 1 THEN part ELSE cap - coalesce(sum(part) FILTER (back > 1) OVER (PARTITION BY evidence_id), 0) END AS share FROM y),
    s AS (SELECT *, CASE WHEN kind = 'payment' THEN share ELSE CAST(share AS HUGEINT) * net // total END AS others FROM z)
    SELECT evidence_id, transaction_id, CAST(9 AS BIGINT) AS category_id, CAST(-others AS BIGINT) AS amount_paise FROM s WHERE others <> 0
    UNION ALL SELECT evidence_id, transaction_id, evidence_id % 3 + 1, CAST(others - share AS BIGINT) FROM s WHERE share <> others AND evidence_id % 5 <> 0""",
)
def _(l: Ledger) -> DataFrame:
    return _applied(l)[1].inserts.select("evidence_id", "transaction_id", "category_id", "amount_paise")


@query("evd9_displaced", f"WITH {LINKABLE} SELECT transaction_id, amount_paise, category_id FROM allocations WHERE source = 'rule' AND transaction_id IN (SELECT transaction_id FROM allowed WHERE good = 1)")
def _(l: Ledger) -> DataFrame:
    return _applied(l)[1].deletes.where("source = 'rule'").select("transaction_id", "amount_paise", "category_id")


def _flat(change: changes.ChangeSet) -> DataFrame:
    columns = ("transaction_id", "category_id", "amount_paise", "source", "rule_id", "evidence_id")
    return change.inserts.select(F.lit("in").alias("what"), *columns).unionByName(change.deletes.select(F.lit("out").alias("what"), *columns))


EVD9 = ORACLES["evd9_apply"]
WANTED_RULE = f"CASE {WINNER} WHEN 1 THEN 1001 WHEN 2 THEN 2002 WHEN 3 THEN 3003 WHEN 5 THEN 5005 WHEN 6 THEN 6006 END"


@query(
    "evd9_backfill",
    f"""WITH written AS ({EVD9}), good AS (WITH {LINKABLE} SELECT DISTINCT evidence_id, transaction_id FROM allowed JOIN {EXPECTED} x ON x.id = evidence_id WHERE good = 1),
    gone AS (SELECT * FROM allocations WHERE (source = 'rule' AND transaction_id IN (SELECT transaction_id FROM (WITH {LINKABLE} SELECT transaction_id FROM allowed WHERE good = 1))) OR (source = 'evidence' AND evidence_id IN (SELECT evidence_id FROM (WITH {LINKABLE} SELECT evidence_id FROM allowed WHERE good = 1)))),
    touched AS (WITH {LINKABLE} SELECT DISTINCT transaction_id FROM allowed WHERE good = 1),
    kept AS (SELECT transaction_id, sum(amount_paise) AS s FROM (SELECT transaction_id, amount_paise FROM allocations WHERE id NOT IN (SELECT id FROM gone) UNION ALL SELECT transaction_id, amount_paise FROM written) GROUP BY transaction_id),
    made AS (SELECT t.id AS transaction_id, CAST({WANTED_RULE} AS BIGINT) AS category_id, CAST(amount_paise - coalesce(s, 0) AS BIGINT) AS amount_paise, CAST({WINNER} AS BIGINT) AS rule_id FROM transactions t JOIN touched ON touched.transaction_id = t.id LEFT JOIN kept ON kept.transaction_id = t.id WHERE {WINNER} IS NOT NULL AND amount_paise <> coalesce(s, 0)),
    alike AS (SELECT transaction_id FROM made JOIN gone USING (transaction_id, category_id, amount_paise, rule_id) WHERE source = 'rule')
    SELECT 'in' AS what, transaction_id, category_id, amount_paise, 'evidence' AS source, CAST(NULL AS BIGINT) AS rule_id, evidence_id FROM written
    UNION ALL SELECT 'in', transaction_id, category_id, amount_paise, 'rule', rule_id, NULL FROM made WHERE transaction_id NOT IN (SELECT transaction_id FROM alike)
    UNION ALL SELECT 'out', transaction_id, category_id, amount_paise, source, rule_id, evidence_id FROM gone WHERE source = 'evidence' OR transaction_id NOT IN (SELECT transaction_id FROM alike)""",
)
def _(l: Ledger) -> DataFrame:
    l = l.once("base")
    links, change = _applied(l)
    return _flat(evidence.backfilled(change, links, l.transactions, l.allocations, ALL_RULES))


@query(
    "evd11_backfill",
    f"""WITH gone AS (SELECT * FROM evidence_transactions WHERE evidence_id % 2 = 0), lost AS (SELECT * FROM allocations WHERE source = 'evidence' AND evidence_id IN (SELECT evidence_id FROM gone)),
    per AS (SELECT transaction_id, sum(amount_paise) FILTER (source <> 'rule') AS s, max(CAST(source = 'user' AS INTEGER)) AS u, count(*) FILTER (source = 'rule') AS n, max(amount_paise) FILTER (source = 'rule') AS a, max(category_id) FILTER (source = 'rule') AS c, max(rule_id) AS r FROM allocations WHERE id NOT IN (SELECT id FROM lost) GROUP BY transaction_id),
    x AS (SELECT t.id AS transaction_id, CAST({WANTED_RULE} AS BIGINT) AS category_id, CAST(amount_paise - coalesce(s, 0) AS BIGINT) AS amount_paise, CAST({WINNER} AS BIGINT) AS rule_id, coalesce(n, 0) AS n, a, c, r FROM transactions t JOIN gone ON gone.transaction_id = t.id LEFT JOIN per ON per.transaction_id = t.id WHERE coalesce(u, 0) = 0),
    y AS (SELECT *, rule_id IS NOT NULL AND amount_paise <> 0 AS wanted, n = 1 AND a = amount_paise AND c = category_id AND r = rule_id AS same FROM x)
    SELECT 'out' AS what, transaction_id, category_id, amount_paise, source, rule_id, evidence_id FROM lost
    UNION ALL SELECT 'in', transaction_id, category_id, amount_paise, 'rule', rule_id, NULL FROM y WHERE wanted AND same IS NOT TRUE
    UNION ALL SELECT 'out', transaction_id, category_id, amount_paise, source, rule_id, evidence_id FROM allocations WHERE source = 'rule' AND transaction_id IN (SELECT transaction_id FROM y WHERE n > 0 AND NOT (wanted AND same))""",
)
def _(l: Ledger) -> DataFrame:
    gone = l.evidence_transactions.where("evidence_id % 2 = 0")
    return _flat(evidence.unlink_and_backfill(gone, l.evidence_transactions, l.transactions, l.allocations, ALL_RULES)[1])


@query(
    "evd14_rematch",
    f"""WITH m AS (SELECT m.*, e.evidence_date, {VERDICT} AS verdict FROM {_match(UNLINKED, TOLD)} m JOIN evidence e ON e.id = m.evidence_id LEFT JOIN {ALLOCATED} a ON a.transaction_id = m.transaction_id WHERE source_type = 'invoice'),
    r AS (SELECT *, CASE WHEN outcome <> 'matched' THEN outcome WHEN verdict = 'write' AND row_number() OVER (PARTITION BY outcome, transaction_id, verdict ORDER BY evidence_date, evidence_id) = 1 THEN 'linked' ELSE 'conflicted' END AS result FROM m)
    SELECT 'invoice' AS source_type, true AS ran, CAST(NULL AS VARCHAR) AS skipped, count(*) FILTER (result = 'linked') AS linked, count(*) FILTER (result = 'conflicted') AS conflicted, count(*) FILTER (result = 'ambiguous') AS ambiguous, count(*) FILTER (result = 'none') AS unmatched FROM r
    UNION ALL SELECT 'shared', false, 'no owner is set', 0, 0, 0, 0""",
)
def _(l: Ledger) -> DataFrame:
    sources = [evidence.Source("invoice", TOKENS["invoice"]), evidence.Source("shared", unavailable="no owner is set")]
    return evidence.rematch(sources, l.evidence, l.evidence_transactions, l.transactions, l.allocations)[1]


@query("evd11_unlink", "SELECT id FROM allocations WHERE source = 'evidence' AND evidence_id IN (SELECT evidence_id FROM evidence_transactions WHERE evidence_id % 2 = 0)")
def _(l: Ledger) -> DataFrame:
    return evidence.unlink(l.evidence_transactions.where("evidence_id % 2 = 0"), l.evidence_transactions, l.allocations)[1].deletes.select("id")


@query(
    "evd12_lines",
    """WITH d AS (SELECT evidence_id, category_id, sum(l.amount_paise) AS amount FROM lines l JOIN items i ON i.id = l.item_id WHERE kind = 'goods' AND category_id IS NOT NULL GROUP BY evidence_id, category_id),
    c AS (SELECT *, sum(amount) OVER (PARTITION BY evidence_id ORDER BY category_id) AS e FROM d),
    t AS (SELECT x.evidence_id, x.transaction_id, t.amount_paise, sum(abs(t.amount_paise)) OVER (PARTITION BY x.evidence_id ORDER BY x.transaction_id) AS e FROM evidence_transactions x JOIN transactions t ON t.id = x.transaction_id)
    SELECT c.evidence_id, t.transaction_id, c.category_id, CAST((least(c.e, t.e) - greatest(c.e - c.amount, t.e - abs(t.amount_paise))) * sign(t.amount_paise) AS BIGINT) AS amount_paise FROM c JOIN t ON t.evidence_id = c.evidence_id
    WHERE least(c.e, t.e) - greatest(c.e - c.amount, t.e - abs(t.amount_paise)) > 0""",
)
def _(l: Ledger) -> DataFrame:
    return evidence.line_allocations(l.lines, l.items, l.evidence_transactions, l.transactions)


@query("utl9_gate", "SELECT e.id, cost_paise, CAST(s AS BIGINT) AS lines_paise FROM evidence e JOIN (SELECT evidence_id, sum(amount_paise) AS s FROM lines GROUP BY evidence_id) ON evidence_id = e.id WHERE s <> cost_paise")
def _(l: Ledger) -> DataFrame:
    return evidence.gate(l.lines, l.evidence)


# Shared expenses


@query("shr1_to_paise", "SELECT o_orderkey AS id, CAST(round(o_totalprice * 100) AS BIGINT) AS paise FROM orders")
def _(l: Ledger) -> DataFrame:
    return l.table("orders").select(F.col("o_orderkey").alias("id"), text.to_paise(F.format_number("o_totalprice", 2)).alias("paise"))


@query(
    "shr2_validate",
    """SELECT event_id AS line, array_to_string(list_filter([CASE WHEN day(ts) > 27 THEN 'bad_date' END, CASE WHEN minute(ts) % 7 = 0 OR round(value * 100) <= 0 THEN 'bad_cost' END, CASE WHEN minute(ts) % 6 = 5 THEN 'bad_net' END,
        CASE WHEN minute(ts) % 6 = 5 OR minute(ts) % 5 = 1 THEN 'unbalanced' END, CASE WHEN minute(ts) % 7 <> 0 AND round(value * 100) < 300 THEN 'share_over_cost' END], lambda x: x IS NOT NULL), ',') AS errors
    FROM events WHERE event_type = 'purchase'""",
)
def _(l: Ledger) -> DataFrame:
    at = F.minute("ts")
    rows = l.table("events").where("event_type = 'purchase'").select(
        F.col("event_id").alias("line"), F.when(F.day("ts") > 27, "2024-02-31").otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("date"), F.when(at % 7 == 0, "1,23.00").otherwise(F.format_number("value", 2)).alias("cost"),
        F.array(F.lit("3.00"), F.when(at % 6 == 5, "1e3").when(at % 5 == 1, "-2.97").otherwise("-3.00")).alias("nets"),
    )
    return shared.validate(rows, people=2)


@query(
    "src7_exports",
    """SELECT user_id AS file, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS seq, CAST(ts AS DATE) AS date, 'Item "' || event_id || '", ' || word || chr(10) || 'x' AS description, value_paise AS cost_paise, -((value_paise + 1) // 2) AS net_paise,
    CASE WHEN word = 'w0' THEN 'payment' ELSE 'expense' END AS kind FROM (SELECT *, min(value_paise) OVER (PARTITION BY user_id) AS least FROM purchases) WHERE least > 0""",
)
def _(l: Ledger) -> DataFrame:
    """Each buyer's purchases written as an export, with quoted commas, quotes and line ends, and read again."""
    quote = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    amount = lambda c: quote(F.format_number((c / 100).cast("decimal(20,2)"), 2))
    rows, net = l.purchases, F.floor(-F.col("value_paise") / 2)
    cells = (F.date_format("ts", "yyyy-MM-dd"), quote(F.concat(F.lit('Item "'), F.col("event_id").cast("string"), F.lit('", '), F.col("word"), F.lit("\nx"))), F.when(F.col("word") == "w0", "Payment").otherwise(F.col("word")), amount(F.col("value_paise")), F.lit("INR"), amount(net), amount(-net))
    line = rows.select("user_id", F.struct("event_id", F.concat(F.concat_ws(",", *cells), F.lit("\r\n")).alias("text")).alias("line"))
    head = F.lit('Date,Description,Category,Cost,Currency,Me,"You, both"\r\n')
    files = line.groupBy(F.col("user_id").alias("file")).agg(F.concat(head, F.array_join(F.transform(F.array_sort(F.collect_list("line")), lambda x: x["text"]), "")).alias("value"))
    return exports.parse_exports(files, "Me").rows.select("file", "seq", "date", "description", "cost_paise", "net_paise", "kind")


@query(
    "src5_pages",
    """SELECT account_id AS file, row_number() OVER (PARTITION BY account_id ORDER BY statement_id, statement_seq, id) AS statement_seq, make_date(2000 + year(txn_date) % 100, month(txn_date), day(txn_date)) AS txn_date, replace(narration, '-', ' ') || ' #' || id AS narration, 'R' || id AS ref, amount_paise
    FROM transactions WHERE statement_id IS NOT NULL AND narration IS NOT NULL""",
)
def _(l: Ledger) -> DataFrame:
    """Statements printed as words at places, two rows a transaction, and read again."""
    place = F.row_number().over(Window.partitionBy("account_id", "statement_id").orderBy("statement_seq", "id"))
    rows = l.transactions.where("statement_id is not null and narration is not null").withColumn("top", place * 20.0)
    word = lambda down, x, text: F.struct((F.col("top") + down).alias("top"), x.cast("double").alias("x0"), text.alias("text"))
    sign = F.when(F.col("amount_paise") < 0, "-₹").otherwise("₹")
    printed = F.concat(sign, F.format_number((F.abs("amount_paise") / 100).cast("decimal(20,2)"), 2))
    month = F.element_at(F.array(*map(F.lit, statements.MONTHS)), F.month("txn_date"))
    fixed = [word(0.5, F.lit(30), F.day("txn_date").cast("string")), word(0, F.lit(45), month), word(1, F.lit(60), F.concat(F.lit("'"), F.date_format("txn_date", "yy"))), word(0, F.lit(284), F.concat(F.lit("R"), F.col("id").cast("string"))), word(2.5, F.lit(442), printed), word(8, F.lit(92), F.concat(F.lit("#"), F.col("id").cast("string")))]
    details = F.transform(F.split("narration", "-"), lambda w, i: word(1.5, 92 + i * 10, w))
    words = rows.select(F.col("account_id").alias("file"), F.col("statement_id").alias("page"), F.explode(F.concat(F.array(*fixed), details)).alias("w")).select("file", "page", "w.*")
    return statements.page_transactions(words).select("file", "statement_seq", "txn_date", "narration", "ref", "amount_paise")


@query(
    "shr4_plan",
    """SELECT event_id, word, CAST(category_id AS BIGINT) AS category_id, CASE WHEN category_id IS NOT NULL THEN 'consumed' WHEN source_category IS NULL THEN 'unmapped' ELSE 'unclassified' END AS fate FROM purchases LEFT JOIN source_map ON word = source_category""",
)
def _(l: Ledger) -> DataFrame:
    return shared.plan(l.purchases, l.source_map)


@query(
    "shr5_stale",
    """SELECT c.evidence_id, c.category_id, CAST(m.category_id AS BIGINT) AS now FROM consumption c LEFT JOIN purchases p ON p.event_id = c.evidence_id LEFT JOIN (SELECT * FROM source_map WHERE source_category <> 'w1' UNION ALL SELECT 'w1', 4) m ON m.source_category = p.word
    WHERE c.category_id IS DISTINCT FROM m.category_id""",
)
def _(l: Ledger) -> DataFrame:
    remapped = l.source_map.withColumn("category_id", F.when(F.col("source_category") == "w1", F.lit(4).cast("long")).otherwise(F.col("category_id")))
    return shared.stale(l.consumption, l.purchases, remapped)


# Catalogue


def canon_sql(x: str) -> str:
    """A canonical product name in DuckDB's own patterns."""
    out = f"regexp_replace(regexp_replace({x}, '\\bhsn\\s*[:-]\\s*[0-9]{{4,8}}\\b', ' ', 'gi'), '\\(\\s*hsn[-:\\s]*[0-9]{{4,8}}\\s*\\)', ' ', 'gi')"
    out = f"lower(regexp_replace(regexp_replace({out}, '\\|\\s*b0[a-z0-9]{{8}}\\s*\\(?[^)]*\\)?\\s*$', ' ', 'i'), '\\bB0[A-Z0-9]{{8}}\\b', ' ', 'g'))"
    for words in (
        "\\b\\d+(\\.\\d+)?\\s*(grams?|gms?|g|kgs?|mg|ml|litres?|liters?|ltrs?|l)\\b", "\\b(set|pack|pair|combo)\\s+of\\s+\\d+\\b", "\\b\\d+\\s*[x×]\\s*\\d+(\\.\\d+)?\\s*(gm?|ml|kg|l)\\b",
        "\\b\\d+\\s*(pieces|pcs?|count|unit|units|tablets|tablet|capsules|capsule|sachets|sachet)\\b", "\\b(pet bottle|tetra ?pak|bottle|pouch|can|jar|tin|box|carton|sachet|packet|refill)\\b",
    ):
        out = f"regexp_replace({out}, '{words}', ' ', 'g')"
    return f"trim(regexp_replace({out}, '[^a-z0-9]+', ' ', 'g'))"


@query("itm2_canonical", f"SELECT item_id, {canon_sql('name')} AS canon FROM printed_names")
def _(l: Ledger) -> DataFrame:
    return l.printed.select("item_id", text.canonical_name(F.col("name")).alias("canon"))


CANON = "trim(regexp_replace(lower('acme hydration zero sugar mix ' || label), '[^a-z0-9]+', ' ', 'g'))"


@query(
    "itm4_variants",
    f"""WITH w AS (SELECT id, list_distinct(string_split({CANON}, ' ')) AS x FROM items), p AS (SELECT a.id, len(list_filter(a.x, lambda t: NOT list_contains(b.x, t))) AS lost, len(list_filter(b.x, lambda t: NOT list_contains(a.x, t))) AS won,
    len(list_filter(a.x, lambda t: list_contains(b.x, t))) AS shared, len(list_filter(list_concat(list_filter(a.x, lambda t: NOT list_contains(b.x, t)), list_filter(b.x, lambda t: NOT list_contains(a.x, t))), lambda t: regexp_matches(t, '^[0-9]+$'))) > 0 AS bare FROM w a JOIN w b ON b.id = a.id + 1)
    SELECT id, CASE WHEN lost + won = 0 THEN 'same' WHEN lost > 1 OR won > 1 THEN 'many_words' WHEN shared < 5 THEN 'little_in_common' WHEN bare THEN 'bare_number' ELSE 'same' END AS verdict FROM p""",
)
def _(l: Ledger) -> DataFrame:
    named = l.items.select("id", text.canonical_name(F.concat(F.lit("acme hydration zero sugar mix "), F.col("label"))).alias("a"))
    both = named.join(named.select((F.col("id") - 1).alias("id"), F.col("a").alias("b")), "id")
    return both.select("id", F.coalesce(text.variant_difference(F.col("a"), F.col("b"))["reason"], F.lit("same")).alias("verdict"))


@query(
    "itm3_attributes",
    """WITH f AS (SELECT item_id, lower(name) AS low, regexp_extract_all(lower(name), '\\b\\d+(?:\\.\\d+)?\\s*(?:kgs|ml|litres|g)\\b') AS sizes FROM printed_names)
    SELECT item_id, CASE WHEN len(sizes) > 0 THEN regexp_replace(sizes[-1], '([0-9])\\s*([a-z]+)$', '\\1 \\2') END AS size, nullif(regexp_extract(low, 'pet bottle|tetra pak|refill'), '') AS pack, nullif(regexp_extract(low, '(pack|combo) of (\\d+)', 2), '') AS pack_of FROM f""",
)
def _(l: Ledger) -> DataFrame:
    found = text.variant_attributes(F.col("name"))
    return l.printed.select("item_id", *(found[k].alias(k) for k in ("size", "pack", "pack_of")))


@query("jn12_lines_by_alias", "SELECT l.evidence_id, l.line_index, a.item_id FROM lines l JOIN aliases a ON a.alias_value = CAST(l.item_id AS VARCHAR)")
def _(l: Ledger) -> DataFrame:
    lines = l.lines.where("item_id is not null").select("evidence_id", "line_index", F.col("item_id").cast("string").alias("alias_value"))
    return lines.join(l.aliases.select("alias_value", "item_id"), "alias_value").select("evidence_id", "line_index", "item_id")


GRAMS = "(SELECT id, p_name, list_distinct(flatten(list_transform(string_split(n, ' '), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))) AS g FROM"


@query(
    "itm5_trigram",
    f"""WITH a AS {GRAMS} (SELECT min(p_partkey) AS id, p_name, p_name AS n FROM part GROUP BY p_name)), s AS (SELECT a.p_name AS name, b.p_name AS other, len(list_intersect(a.g, b.g)) AS i, len(list_distinct(list_concat(a.g, b.g))) AS u FROM a, a b)
    SELECT name, other, CAST(floor((i * 200 + u) / (u * 2)) AS BIGINT) AS similarity FROM s WHERE floor((i * 200 + u) / (u * 2)) >= 30""",
)
def _(l: Ledger) -> DataFrame:
    names = l.table("part").select(F.col("p_name").alias("canon")).distinct().withColumn("grams", text.trigrams(F.col("canon")))
    return items.similar(names, names).select(F.col("left").alias("name"), F.col("right").alias("other"), "similarity")


@query(
    "itm6_resolve",
    f"""WITH l AS (SELECT l.evidence_id || '-' || line_index AS line_id, l.item_id AS sku, name FROM lines l JOIN printed_names USING (item_id)),
    w AS (SELECT DISTINCT name, {canon_sql('name')} AS canon FROM l WHERE sku % 4 = 0), i AS (SELECT id, {canon_sql('label')} AS canon FROM items),
    g AS (SELECT canon, list_distinct(flatten(list_transform(string_split(canon, ' '), lambda w: list_transform(range(1, length(w) + 2), lambda k: substr('  ' || w || ' ', k, 3))))) AS g, string_split(canon, ' ') AS words FROM (SELECT canon FROM w UNION SELECT canon FROM i)),
    s AS (SELECT a.canon AS a, b.canon AS b, len(list_intersect(a.g, b.g)) AS n, len(list_distinct(list_concat(a.g, b.g))) AS u, len(list_filter(list_distinct(a.words), lambda t: NOT list_contains(b.words, t))) AS lost, len(list_filter(list_distinct(b.words), lambda t: NOT list_contains(a.words, t))) AS won,
        len(list_intersect(a.words, b.words)) AS shared, len(list_filter(list_concat(list_filter(a.words, lambda t: NOT list_contains(b.words, t)), list_filter(b.words, lambda t: NOT list_contains(a.words, t))), lambda t: regexp_full_match(t, '[0-9]+'))) AS bare
        FROM (SELECT * FROM g WHERE canon IN (SELECT canon FROM w)) a, (SELECT * FROM g WHERE canon IN (SELECT canon FROM i)) b),
    v AS (SELECT a, b, CAST(floor((n * 200 + u) / (u * 2)) AS BIGINT) AS sim, lost + won = 0 OR (lost <= 1 AND won <= 1 AND shared >= 5 AND bare = 0) AS variant FROM s),
    t AS (SELECT w.name, i.id, sim, variant OR i.id % 4 = 0 AS able, row_number() OVER (PARTITION BY w.name ORDER BY sim DESC, i.id) AS place FROM w JOIN v ON v.a = w.canon JOIN i ON i.canon = v.b WHERE sim >= 30 QUALIFY place <= 5),
    b AS (SELECT name, count(*) FILTER (sim >= 88 AND able) AS strong, min(id) FILTER (sim >= 88 AND able) AS one, min(sim) FILTER (sim >= 88 AND able) AS one_sim, max(sim) AS top, arg_min(id, place) AS top_item FROM t GROUP BY name)
    SELECT line_id, CASE WHEN sku % 4 <> 0 THEN 'existing' WHEN strong = 1 THEN 'link' WHEN top >= 55 THEN 'create_and_propose' ELSE 'create' END AS decision, CASE WHEN sku % 4 <> 0 THEN sku WHEN strong = 1 THEN one WHEN top >= 55 THEN top_item END AS item_id,
    CAST(CASE WHEN sku % 4 <> 0 THEN 100 WHEN strong = 1 THEN one_sim WHEN top >= 55 THEN 100 - top ELSE 100 END AS BIGINT) AS confidence FROM l LEFT JOIN b USING (name)""",
)
def _(l: Ledger) -> DataFrame:
    lines = l.lines.where("item_id is not null").join(l.printed.hint("merge"), "item_id")
    rows = lines.select(F.concat_ws("-", F.col("evidence_id").cast("string"), F.col("line_index").cast("string")).alias("line_id"), F.lit("invoice").alias("source_type"), F.col("item_id").cast("string").alias("sku"), "name")
    return items.resolve(rows, l.aliases, l.items)


@query(
    "itm8_merge_many",
    """WITH g AS (SELECT id, label, category_id, min(id) OVER (PARTITION BY label) AS keeper FROM items), a AS (SELECT item_id, alias_kind, alias_value FROM aliases UNION ALL SELECT id, 'name', label FROM items),
    c AS (SELECT keeper, arg_min(category_id, id) FILTER (category_id IS NOT NULL) AS adopted, max(category_id) FILTER (id = keeper) AS own FROM g GROUP BY keeper),
    n AS (SELECT keeper, count(DISTINCT (alias_kind, alias_value)) AS aliases FROM a JOIN g ON g.id = a.item_id GROUP BY keeper), l AS (SELECT keeper, count(*) AS lines FROM lines JOIN g ON g.id = lines.item_id GROUP BY keeper),
    p AS (SELECT x.id AS lo, count(*) AS proposals FROM g x JOIN g y ON y.id = x.id + 1 WHERE x.keeper = x.id AND y.keeper = y.id GROUP BY x.id)
    SELECT c.keeper AS id, coalesce(own, adopted) AS category_id, coalesce(aliases, 0) AS aliases, coalesce(lines, 0) AS lines, coalesce(proposals, 0) AS proposals FROM c LEFT JOIN n USING (keeper) LEFT JOIN l USING (keeper) LEFT JOIN p ON p.lo = c.keeper""",
)
def _(l: Ledger) -> DataFrame:
    """Every item is merged into the one before it with its label, a chain for each label."""
    before = F.lag("id").over(Window.partitionBy("label").orderBy("id"))
    pairs = l.items.select(before.alias("keep"), F.col("id").alias("drop")).where("keep is not null")
    names = l.items.select(F.col("id").alias("item_id"), F.lit("invoice").alias("source_type"), F.lit("name").alias("alias_kind"), F.col("label").alias("alias_value"))
    asked = l.items.select(F.col("id").alias("lo_item_id")).join(l.items.select((F.col("id") - 1).alias("lo_item_id"), F.col("id").alias("hi_item_id")), "lo_item_id")
    kept, aliases, lines, proposals = items.merge_many(pairs, l.items, l.aliases.unionByName(names), l.lines, asked)
    out = kept.select("id", "category_id")
    for name, rows, column in (("aliases", aliases, "item_id"), ("lines", lines.where("item_id is not null"), "item_id"), ("proposals", proposals, "lo_item_id")):
        out = out.join(rows.groupBy(F.col(column).alias("id")).agg(F.count("*").alias(name)), "id", "left")
    return out.fillna(0, ["aliases", "lines", "proposals"])


@query(
    "agg16_staged_products",
    """WITH g AS (SELECT l.*, label FROM lines l JOIN items i ON i.id = l.item_id WHERE kind = 'goods'), o AS (SELECT item_id, evidence_id, row_number() OVER (PARTITION BY item_id ORDER BY evidence_id) AS k FROM (SELECT DISTINCT item_id, evidence_id FROM g))
    SELECT g.item_id, max(label) AS label, count(*) AS lines, CAST(sum(amount_paise) AS BIGINT) AS amount_paise, count(DISTINCT evidence_id) AS in_orders,
    (SELECT string_agg(CAST(evidence_id AS VARCHAR), ',' ORDER BY evidence_id) FROM o WHERE o.item_id = g.item_id AND k <= 8) AS orders FROM g GROUP BY g.item_id""",
)
def _(l: Ledger) -> DataFrame:
    return items.staged_products(l.lines, l.items)


@query(
    "agg17_item_stats",
    """SELECT i.id, i.category_id, coalesce(s.n, 0) AS times_seen, CAST(coalesce(s.v, 0) AS BIGINT) AS spent_paise, coalesce(a.n, 0) AS aliases FROM items i LEFT JOIN (SELECT item_id, count(*) AS n, sum(amount_paise) AS v FROM lines WHERE item_id IS NOT NULL GROUP BY item_id) s ON s.item_id = i.id
    LEFT JOIN (SELECT item_id, count(*) AS n FROM aliases GROUP BY item_id) a ON a.item_id = i.id""",
)
def _(l: Ledger) -> DataFrame:
    return items.item_stats(l.items, l.lines, l.aliases)


# Queue


@query("stm1_enqueue", "SELECT DISTINCT event_id % 700 AS artifact_id FROM events WHERE event_id % 700 NOT IN (SELECT artifact_id FROM jobs WHERE state IN ('queued', 'running'))")
def _(l: Ledger) -> DataFrame:
    return queue.enqueue(l.jobs, l.table("events").select((F.col("event_id") % 700).alias("artifact_id")))


@query(
    "stm2_claim",
    f"SELECT id, batch_id, CAST(attempts + 1 AS BIGINT) AS attempts, 'running' AS state, TIMESTAMP '{NOW}' AS claimed_at FROM jobs WHERE state = 'queued' AND batch_id % 3 <> 0 ORDER BY created_at, id LIMIT 10",
)
def _(l: Ledger) -> DataFrame:
    batches = l.jobs.select("batch_id").distinct().withColumn("consented_at", F.when(F.col("batch_id") % 3 != 0, queue.at("2024-01-01 00:00:00")))
    return queue.claim(l.jobs, batches, NOW, 10).withColumn("claimed_at", F.col("claimed_at").cast("timestamp_ntz"))


@query("stm3_reclaim", f"SELECT id, CASE WHEN attempts < 3 THEN 'queued' ELSE 'failed' END AS state, CAST(attempts AS BIGINT) AS attempts FROM jobs WHERE state = 'running' AND claimed_at < TIMESTAMP '{NOW}' - INTERVAL 5 MINUTE")
def _(l: Ledger) -> DataFrame:
    return queue.reclaim(l.jobs, NOW)


@query("stm4_retry", "SELECT id, CASE WHEN error_kind = 'timeout' AND attempts < 3 THEN 'queued' ELSE 'failed' END AS state FROM jobs WHERE state = 'failed'")
def _(l: Ledger) -> DataFrame:
    return queue.retry(l.jobs)


@query("stm5_settle", "SELECT batch_id, count(*) AS jobs FROM jobs WHERE batch_id NOT IN (SELECT batch_id FROM jobs WHERE state IN ('queued', 'running')) GROUP BY batch_id")
def _(l: Ledger) -> DataFrame:
    return queue.settled(l.jobs).select("batch_id", "jobs")


@query(
    "jn14_latest_failure",
    "SELECT artifact_id, arg_max(id, (finished_at, id)) AS job_id, arg_max(error_kind, (finished_at, id)) AS error_kind, count(*) AS failures FROM jobs WHERE state = 'failed' GROUP BY artifact_id",
)
def _(l: Ledger) -> DataFrame:
    return queue.latest_failure(l.jobs).select("artifact_id", "job_id", "error_kind", "failures")


# Writes and invariants


@query("utl3_hash", "SELECT id, sha256(CAST(account_id AS VARCHAR) || '|' || CAST(txn_date AS VARCHAR) || '||' || CAST(amount_paise AS VARCHAR) || '|' || coalesce(narration, '')) AS hash FROM transactions")
def _(l: Ledger) -> DataFrame:
    none = F.lit(None).cast("string")
    return l.transactions.select("id", text.transaction_hash(F.col("account_id"), F.col("txn_date"), none, F.col("amount_paise"), F.col("narration")).alias("hash"))


@query(
    "snk1_append_new",
    "SELECT min(id) AS id, narration FROM transactions WHERE narration IS NOT NULL AND narration NOT IN (SELECT narration FROM transactions WHERE id % 3 = 0 AND narration IS NOT NULL) GROUP BY narration",
)
def _(l: Ledger) -> DataFrame:
    rows = l.transactions.where("narration is not null").select("id", "narration")
    return changes.append_new(rows.where("id % 3 = 0"), rows, "narration", [F.col("id")])


@query("snk2_upsert", "SELECT external_ref, CASE WHEN id % 2 = 0 THEN cost_paise + 7 ELSE cost_paise END AS cost_paise FROM evidence")
def _(l: Ledger) -> DataFrame:
    rows = l.evidence.select("id", "source_type", "external_ref", "cost_paise")
    incoming = rows.where("id % 2 = 0")
    twice = incoming.withColumn("n", F.lit(1)).unionByName(incoming.withColumn("cost_paise", F.col("cost_paise") + 7).withColumn("n", F.lit(2)))
    merged = changes.upsert(rows.withColumn("n", F.lit(0)), twice, ["source_type", "external_ref"], [F.col("n")])
    return merged.select("external_ref", "cost_paise")


@query("snk3_replace_scope", "SELECT id, CASE WHEN evidence_id % 2 = 0 THEN amount_paise * 2 ELSE amount_paise END AS amount_paise FROM consumption")
def _(l: Ledger) -> DataFrame:
    scope = l.consumption.where("evidence_id % 2 = 0")
    fresh = scope.withColumn("amount_paise", F.col("amount_paise") * 2)
    return changes.replace_scope(l.consumption, scope, ["evidence_id"], fresh).select("id", "amount_paise")


@query("snk11_ids", "SELECT id AS old_id, (SELECT max(id) FROM categories) + row_number() OVER (ORDER BY id) AS id FROM items")
def _(l: Ledger) -> DataFrame:
    return changes.next_ids(l.categories, l.items.select(F.col("id").alias("old_id")), [F.col("old_id")]).select("old_id", "id")


@query(
    "utl10_assertions",
    """SELECT 'over_allocated' AS assertion, (SELECT count(*) FROM (SELECT transaction_id, sum(abs(amount_paise)) AS s FROM allocations GROUP BY transaction_id) x JOIN transactions t ON t.id = transaction_id WHERE s > abs(amount_paise)) AS broken
    UNION ALL SELECT 'allocation_of_nothing', (SELECT count(*) FROM allocations WHERE amount_paise = 0) UNION ALL SELECT 'allocation_without_transaction', 0 UNION ALL SELECT 'allocation_without_category', (SELECT count(*) FROM allocations WHERE category_id NOT IN (SELECT id FROM categories))
    UNION ALL SELECT 'rule_without_rule_id', 0 UNION ALL SELECT 'confirmed_but_not_user', 0 UNION ALL SELECT 'repeated_transaction', (SELECT count(*) FROM (SELECT id FROM transactions GROUP BY id HAVING count(*) > 1)) UNION ALL SELECT 'three_levels', 0""",
)
def _(l: Ledger) -> DataFrame:
    return changes.violations(l.transactions, l.allocations, l.categories)


# Edits

EDITED = """SELECT id AS edit_id, CASE WHEN id % 9 <> 0 THEN id END AS id, CASE WHEN id % 5 = 0 THEN '  ' WHEN id % 11 = 0 THEN repeat(name, 12) ELSE ' ' || upper(name) || CASE WHEN id % 3 = 0 THEN ' new ' ELSE '' END END AS name,
    CASE WHEN id % 7 = 0 THEN id WHEN id % 13 = 0 THEN -5 WHEN id % 17 = 0 THEN id - 1 WHEN id % 4 = 0 THEN NULL WHEN id % 19 = 0 THEN 1 ELSE parent_id END AS parent_id FROM categories"""


def _edited_categories(l: Ledger) -> DataFrame:
    k = F.col("id")
    name = F.when(k % 5 == 0, "  ").when(k % 11 == 0, F.repeat("name", 12)).otherwise(F.concat(F.lit(" "), F.upper("name"), F.when(k % 3 == 0, " new ").otherwise("")))
    parent = F.when(k % 7 == 0, k).when(k % 13 == 0, -5).when(k % 17 == 0, k - 1).when(k % 4 == 0, None).when(k % 19 == 0, 1).otherwise(F.col("parent_id")).cast("long")
    return l.categories.select(k.alias("edit_id"), F.when(k % 9 != 0, k).alias("id"), name.alias("name"), parent.alias("parent_id"))


CHECKED = f"""SELECT edit_id, id, trim(name) AS name, parent_id, CASE WHEN trim(name) = '' THEN 'empty_name' WHEN length(trim(name)) > 60 THEN 'long_name' WHEN parent_id = id THEN 'own_parent'
    WHEN parent_id IS NOT NULL AND parent_id NOT IN (SELECT id FROM categories) THEN 'no_such_parent' WHEN parent_id IN (SELECT id FROM categories WHERE parent_id IS NOT NULL) THEN 'two_levels'
    WHEN parent_id IS NOT NULL AND id IN (SELECT parent_id FROM categories WHERE parent_id IS NOT NULL) THEN 'has_children'
    WHEN EXISTS (SELECT 1 FROM categories c WHERE c.parent_id IS NOT DISTINCT FROM e.parent_id AND lower(c.name) = lower(trim(e.name)) AND c.id IS DISTINCT FROM e.id) THEN 'name_taken' ELSE 'ok' END AS verdict FROM ({EDITED}) e"""


@query("cat2_validate", CHECKED)
def _(l: Ledger) -> DataFrame:
    return editing.check_categories(_edited_categories(l), l.categories)


@query("cat3_save", f"SELECT c.id, coalesce(e.name, c.name) AS name, CASE WHEN e.id IS NULL THEN c.parent_id ELSE e.parent_id END AS parent_id FROM categories c LEFT JOIN (SELECT * FROM ({CHECKED}) WHERE verdict = 'ok' AND id IS NOT NULL) e ON e.id = c.id")
def _(l: Ledger) -> DataFrame:
    checked = editing.check_categories(_edited_categories(l), l.categories)
    return editing.save_categories(checked, l.categories).commit(l.categories, ["id"]).select("id", "name", "parent_id")


def _removals(l: Ledger) -> DataFrame:
    k = F.col("id")
    target = F.when(k % 3 == 0, k).when(k % 3 == 1, F.when(k % 2 == 0, 1).otherwise(-7)).cast("long")
    return editing.check_removals(l.categories.select("id", target.alias("reassign_to")), l.categories, l.allocations, l.rules)


REMOVALS = """SELECT w.id, reassign_to, CASE WHEN reassign_to = w.id THEN 'same_category' WHEN w.id IN (SELECT parent_id FROM categories WHERE parent_id IS NOT NULL) THEN 'has_children'
    WHEN coalesce(a, 0) + coalesce(r, 0) > 0 AND reassign_to IS NULL THEN 'in_use' WHEN reassign_to IS NOT NULL AND reassign_to NOT IN (SELECT id FROM categories) THEN 'no_such_target' ELSE 'ok' END AS verdict,
    coalesce(a, 0) AS allocations, coalesce(r, 0) AS rules FROM (SELECT id, CASE id % 3 WHEN 0 THEN id WHEN 1 THEN CASE WHEN id % 2 = 0 THEN 1 ELSE -7 END END AS reassign_to FROM categories) w
    LEFT JOIN (SELECT category_id, count(*) AS a FROM allocations GROUP BY 1) x ON x.category_id = w.id LEFT JOIN (SELECT category_id, count(*) AS r FROM rules GROUP BY 1) y ON y.category_id = w.id"""


@query(
    "cat4_referenced",
    f"""SELECT id, CASE WHEN verdict = 'ok' AND id IN (SELECT category_id FROM items WHERE category_id IS NOT NULL UNION SELECT category_id FROM consumption UNION SELECT category_id FROM source_map WHERE category_id IS NOT NULL) THEN 'referenced' ELSE verdict END AS verdict
    FROM ({REMOVALS})""",
)
def _(l: Ledger) -> DataFrame:
    k = F.col("id")
    target = F.when(k % 3 == 0, k).when(k % 3 == 1, F.when(k % 2 == 0, 1).otherwise(-7)).cast("long")
    return editing.check_removals(l.categories.select("id", target.alias("reassign_to")), l.categories, l.allocations, l.rules, (l.items, l.consumption, l.source_map)).select("id", "verdict")


@query("cat4_remove", f"SELECT id, name FROM categories WHERE id NOT IN (SELECT id FROM ({REMOVALS}) WHERE verdict = 'ok')")
def _(l: Ledger) -> DataFrame:
    return editing.remove_categories(l.categories, _removals(l)).commit(l.categories, ["id"]).select("id", "name")


@query("cat4_delete", REMOVALS)
def _(l: Ledger) -> DataFrame:
    return _removals(l)


@query("cat4_reassign", f"SELECT a.id, coalesce(reassign_to, category_id) AS category_id FROM allocations a LEFT JOIN (SELECT * FROM ({REMOVALS}) WHERE verdict = 'ok') w ON w.id = category_id")
def _(l: Ledger) -> DataFrame:
    return editing.reassign(l.allocations, _removals(l)).commit(l.allocations, ["id"]).select("id", "category_id")


@query(
    "rul8_edit",
    """SELECT CAST(r.id AS BIGINT) AS rule_id, r.id % 3 <> 1 AS reapply_needed, CASE WHEN r.id % 3 <> 1 THEN coalesce(n, 0) ELSE 0 END AS allocations_removed
    FROM rules r LEFT JOIN (SELECT rule_id, count(*) AS n FROM allocations WHERE source = 'rule' GROUP BY 1) x ON x.rule_id = r.id""",
)
def _(l: Ledger) -> DataFrame:
    k = F.col("id")
    edited = l.rules.where(k % 3 != 2).withColumn("name", F.upper("name")).withColumn("priority", F.when(k % 3 == 0, 99).otherwise(F.col("priority")))
    return editing.edit_rules(l.rules, edited, l.allocations)[0]


LINKED = """SELECT id AS leg, id + 1000000000000 AS partner, CASE WHEN id % 100 = 0 THEN 'resolved' ELSE 'suspected' END AS status FROM transactions WHERE id % 50 = 0 AND id < 1000000000000"""
ENDS = f"SELECT leg AS id, partner AS other, status, leg AS new_group FROM ({LINKED}) UNION ALL SELECT partner, leg, status, leg FROM ({LINKED})"
AFTER = f"""SELECT t.id, CASE WHEN e.id IS NULL THEN NULL ELSE e.status END AS transfer_status, e.new_group AS transfer_group_id, o.account_id AS counterparty_account_id, t.account_id
    FROM transactions t LEFT JOIN ({ENDS}) e ON e.id = t.id LEFT JOIN transactions o ON o.id = e.other
    WHERE e.id IS NOT NULL OR t.transfer_group_id IN (SELECT transfer_group_id FROM transactions JOIN ({ENDS}) e2 USING (id) WHERE transfer_status IN ('suspected', 'pending') AND transfer_group_id IS NOT NULL)"""


def _linked(l: Ledger):
    legs = l.transactions.where("id % 50 = 0 and id < 1000000000000").select(F.col("id").alias("leg"), (F.col("id") + 1_000_000_000_000).alias("partner"), F.when(F.col("id") % 100 == 0, "resolved").otherwise("suspected").alias("status"))
    return editing.link_transfers(l.transactions, l.allocations, legs)


@query("trf8_link", f"SELECT id, transfer_status, transfer_group_id, counterparty_account_id FROM ({AFTER})")
def _(l: Ledger) -> DataFrame:
    return _linked(l)[0].inserts.select("id", "transfer_status", "transfer_group_id", "counterparty_account_id")


@query("trf8_swept", "SELECT id FROM allocations WHERE source = 'rule' AND transaction_id % 100 = 0")
def _(l: Ledger) -> DataFrame:
    return _linked(l)[1].deletes.select("id")


@query("jn16_counterparts", f"SELECT x.id, a.name AS account_name, c.name AS counterparty_name FROM ({AFTER}) x JOIN accounts a ON a.id = x.account_id LEFT JOIN accounts c ON c.id = x.counterparty_account_id")
def _(l: Ledger) -> DataFrame:
    return editing.with_counterparts(_linked(l)[0].inserts, l.accounts).select("id", "account_name", "counterparty_name")


MERCHANTS = {"invoice": ("anvil", "bolt", "gear")}
SAYS = "lower(coalesce(narration, '')) LIKE '%anvil%' OR lower(coalesce(narration, '')) LIKE '%bolt%' OR lower(coalesce(narration, '')) LIKE '%gear%'"


@query("evd2_merchants", f"SELECT id, {SAYS} AS invoice, true AS shared FROM transactions")
def _(l: Ledger) -> DataFrame:
    return l.transactions.select("id", *(evidence.identifies(F.col("narration"), F.lit(s), MERCHANTS).alias(s) for s in ("invoice", "shared")))


@query(
    "evd3_merchant_match",
    f"""WITH x AS (SELECT id AS evidence_id, source_type, evidence_date, CASE WHEN kind = 'expense' AND my_net_paise > 0 THEN -cost_paise WHEN kind = 'payment' AND my_net_paise <> 0 THEN -my_net_paise END AS wanted FROM evidence),
    h AS (SELECT evidence_id, count(*) AS n, min(t.id) AS one FROM x JOIN transactions t ON t.amount_paise = wanted AND abs(date_diff('day', evidence_date, t.txn_date)) <= 3 AND (source_type <> 'invoice' OR {SAYS}) GROUP BY 1)
    SELECT x.evidence_id, CASE WHEN n = 1 THEN 'matched' WHEN n > 1 THEN 'ambiguous' ELSE 'none' END AS outcome, CASE WHEN n = 1 THEN one END AS transaction_id FROM x LEFT JOIN h USING (evidence_id) WHERE wanted IS NOT NULL""",
)
def _(l: Ledger) -> DataFrame:
    return evidence.match(l.evidence, l.transactions, MERCHANTS)


@query(
    "snk8_artifacts",
    """WITH incoming AS (SELECT page_id AS id, sha256(html) AS content_hash, strlen(html) AS byte_size FROM pages WHERE html IS NOT NULL UNION ALL SELECT page_id + 1000000, sha256(html), strlen(html) FROM pages WHERE html IS NOT NULL AND page_id % 3 = 0),
    stored AS (SELECT content_hash, min(page_id - 5000000) AS known FROM (SELECT page_id, sha256(html) AS content_hash FROM pages WHERE html IS NOT NULL AND page_id % 4 = 0) GROUP BY 1)
    SELECT id, content_hash, CAST(byte_size AS BIGINT) AS byte_size, coalesce(known, first) AS stored_id, known IS NOT NULL OR id <> first AS duplicate
    FROM incoming JOIN (SELECT content_hash, min(id) AS first FROM incoming GROUP BY 1) f USING (content_hash) LEFT JOIN stored USING (content_hash)""",
)
def _(l: Ledger) -> DataFrame:
    pages = l.table("pages").where("html is not null").select(F.col("page_id").alias("id"), F.col("html").cast("binary").alias("bytes"))
    stored = pages.where("id % 4 = 0").select((F.col("id") - 5_000_000).alias("id"), F.sha2("bytes", 256).alias("content_hash"))
    again = pages.where("id % 3 = 0").withColumn("id", F.col("id") + 1_000_000)
    return editing.store_artifacts(stored, pages.unionByName(again))[1]


@query(
    "snk5_rebuild",
    """SELECT id, evidence_id, category_id, amount_paise FROM consumption WHERE evidence_id NOT IN (SELECT event_id FROM purchases WHERE word = 'w1')
    UNION ALL SELECT event_id, event_id, 7, -value_paise FROM purchases WHERE word = 'w1' AND value_paise <> 0""",
)
def _(l: Ledger) -> DataFrame:
    expenses = l.purchases.select(F.col("event_id").alias("id"), F.col("event_id").alias("evidence_id"), (-F.col("value_paise")).alias("amount_paise"), F.to_date("ts").alias("consumed_on"), F.lit("evidence").alias("source"), "word")
    change = editing.replace_mapping(l.consumption, expenses, "w1", 7)
    return change.commit(l.consumption, ["evidence_id"]).select("id", "evidence_id", "category_id", "amount_paise")


@query(
    "utl2_import_errors",
    """SELECT id AS row, concat_ws(',', CASE WHEN id % 5 = 0 THEN 'amount_not_whole' WHEN id % 7 = 0 THEN 'amount_zero' END, CASE WHEN id % 6 = 0 THEN 'bad_date' END, CASE WHEN id % 11 = 0 THEN 'bad_type' END, CASE WHEN id % 13 = 0 THEN 'balance_not_whole' END) AS errors
    FROM transactions WHERE id % 5 = 0 OR id % 7 = 0 OR id % 6 = 0 OR id % 11 = 0 OR id % 13 = 0""",
)
def _(l: Ledger) -> DataFrame:
    k, a = F.col("id"), F.col("amount_paise").cast("string")
    raw = l.transactions.select(
        k.alias("row"), F.when(k % 5 == 0, F.concat(a, F.lit(".5"))).when(k % 7 == 0, "0").otherwise(a).alias("amount_paise"), F.when(k % 6 == 0, "2024-13-40").otherwise(F.col("txn_date").cast("string")).alias("txn_date"),
        F.when(k % 11 == 0, "odd").otherwise(F.col("type")).alias("type"), F.when(k % 13 == 0, "x").when(k % 2 == 0, a).alias("bank_balance_paise"),
    )
    return editing.import_errors(raw)


@query(
    "rcp7_names",
    """WITH g AS (SELECT evidence_id, list(p_name ORDER BY line_index) AS names FROM lines JOIN parts ON p_partkey = item_id WHERE kind <> 'fee' GROUP BY 1)
    SELECT e.id AS evidence_id, CASE WHEN names IS NULL THEN source_type || ' order ' || external_ref WHEN len(names) = 1 THEN names[1] ELSE names[1] || ' + ' || CAST(len(names) - 1 AS VARCHAR) || ' more' END AS short, array_to_string(names, chr(10)) AS full
    FROM evidence e LEFT JOIN g ON g.evidence_id = e.id""",
)
def _(l: Ledger) -> DataFrame:
    named = l.lines.join(l.parts.select(F.col("p_partkey").alias("item_id"), F.concat("p_name", F.lit(" | A1 (2)")).alias("description")), "item_id", "left")
    return editing.display_names(l.evidence, named)


@query("srt8_tree", "SELECT c.id, c.name, p.name AS parent FROM categories c LEFT JOIN categories p ON p.id = c.parent_id")
def _(l: Ledger) -> DataFrame:
    return editing.tree_order(l.categories).select("id", "name", "parent")


@query("srt6_items", "SELECT i.id, coalesce(n, 0) AS times_seen FROM items i LEFT JOIN (SELECT item_id, count(*) AS n FROM lines WHERE item_id IS NOT NULL GROUP BY 1) x ON x.item_id = i.id ORDER BY times_seen DESC, i.id DESC LIMIT 100")
def _(l: Ledger) -> DataFrame:
    return editing.most_seen(l.items, l.lines, 100).select("id", "times_seen")


@query("jn18_proposals", "SELECT lo.id AS lo_item_id, hi.id AS hi_item_id, lo.label AS lo_label, hi.label AS hi_label FROM items lo JOIN items hi ON hi.id = lo.id + 1 WHERE lo.id % 10 = 0")
def _(l: Ledger) -> DataFrame:
    pairs = l.items.where("id % 10 = 0").select(F.col("id").alias("lo_item_id"), (F.col("id") + 1).alias("hi_item_id"))
    return editing.proposals_named(pairs, l.items).select("lo_item_id", "hi_item_id", "lo_label", "hi_label")


@query(
    "jn19_sku_conflicts",
    """SELECT p_partkey AS item_id, EXISTS (SELECT 1 FROM aliases a WHERE a.item_id = p_partkey AND a.alias_kind = 'sku' AND a.source_type = 'invoice' AND p_partkey % 6 <> 0 AND a.alias_value <> CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey AS VARCHAR) ELSE 'x' END) AS conflicting_sku FROM parts""",
)
def _(l: Ledger) -> DataFrame:
    k = F.col("p_partkey")
    lines = l.parts.select(k.alias("item_id"), F.lit("invoice").alias("source_type"), F.when(k % 6 == 0, None).when(k % 2 == 0, k.cast("string")).otherwise("x").alias("sku"))
    return editing.sku_conflicts(lines, l.aliases).select("item_id", "conflicting_sku")


@query("agg25_tally", """WITH c AS (SELECT t.id, t.amount_paise, max(source = 'evidence') AS e, max(source = 'user') AS u, max(source = 'rule') AS r FROM transactions t LEFT JOIN allocations a ON a.transaction_id = t.id WHERE t.id % 4 = 0 GROUP BY 1, 2)
    SELECT count(*) AS picked, CAST(sum(abs(amount_paise)) AS BIGINT) AS picked_paise, count(*) FILTER (NOT coalesce(e, false) AND NOT coalesce(u, false) AND NOT coalesce(r, false)) AS free,
    count(*) FILTER (coalesce(u, false) AND NOT coalesce(e, false)) AS yours, count(*) FILTER (coalesce(r, false) AND NOT coalesce(e, false) AND NOT coalesce(u, false)) AS replaces, count(*) FILTER (coalesce(e, false)) AS refused FROM c""")
def _(l: Ledger) -> DataFrame:
    return editing.selection_tally(l.transactions.where("id % 4 = 0"), evidence.claim_labels(l.transactions, l.allocations))


@query("flt13_account", "SELECT account_id, origin, CAST(sum(amount_paise) AS BIGINT) AS total_paise, count(*) AS n FROM consumption_rows WHERE account_id = 3 GROUP BY 1, 2")
def _(l: Ledger) -> DataFrame:
    rows = reports.consumption_rows(l.transactions, l.allocations, l.consumption, l.categories)
    return rows.where("account_id = 3").groupBy("account_id", "origin").agg(F.sum("amount_paise").alias("total_paise"), F.count("*").alias("n"))


# Receipts


@query(
    "rcp2_summary",
    """SELECT (SELECT count(*) FROM files WHERE parse_status = 'staged') AS staged, (SELECT count(*) FROM files WHERE parse_status IN ('failed', 'unsupported')) AS held,
    (SELECT CAST(sum(total) AS BIGINT) FROM files WHERE parse_status = 'staged') AS total_paise,
    (SELECT count(*) FROM printed p LEFT JOIN aliases a ON a.alias_value = p.sku LEFT JOIN items i ON i.id = a.item_id WHERE kind = 'goods' AND i.category_id IS NULL) AS uncategorised_lines""",
)
def _(l: Ledger) -> DataFrame:
    return receipts.staged_summary(l.artifacts, l.aliases, l.items)


@query(
    "rcp2_worklist",
    """SELECT f.id AS artifact_id, CAST(f.total AS BIGINT) AS total_paise, n.lines, n.fees, n.by_sku, CASE WHEN h.hits = 1 THEN 'matched' WHEN h.hits > 1 THEN 'ambiguous' ELSE 'none' END AS outcome, CASE WHEN h.hits = 1 THEN h.one END AS transaction_id
    FROM files f JOIN (SELECT evidence_id, count(*) AS lines, count(*) FILTER (kind = 'fee') AS fees, count(*) FILTER (alias_value IS NOT NULL) AS by_sku FROM printed LEFT JOIN aliases ON alias_value = sku GROUP BY evidence_id) n ON n.evidence_id = f.id
    LEFT JOIN (SELECT x.id, count(*) AS hits, min(t.id) AS one FROM files x JOIN transactions t ON t.amount_paise = -x.total AND abs(date_diff('day', t.txn_date, x.day)) <= 3 GROUP BY x.id) h ON h.id = f.id WHERE f.parse_status = 'staged'""",
)
def _(l: Ledger) -> DataFrame:
    l = l.once("base", "artifacts")
    rows = receipts.staged_orders(l.artifacts, l.aliases, l.items, l.transactions)
    count = lambda decision: F.size(F.filter("lines", lambda r: r["decision"] == decision))
    return rows.select("artifact_id", "total_paise", F.size("lines").alias("lines"), count("fee").alias("fees"), count("existing").alias("by_sku"), "outcome", "transaction_id")


PRODUCT = "'invoice:' || coalesce(sku, 'name:' || trim(regexp_replace(lower(description), '[^a-z0-9]+', ' ', 'g')))"


@query(
    "rcp3_products",
    f"""WITH g AS (SELECT *, {PRODUCT} AS key FROM printed WHERE kind <> 'fee'), o AS (SELECT key, external_ref, row_number() OVER (PARTITION BY key ORDER BY external_ref) AS k FROM (SELECT DISTINCT key, external_ref FROM g))
    SELECT key, min(sku) AS sku, min(description) AS description, count(*) AS lines, CAST(sum(amount_paise) AS BIGINT) AS amount_paise, (SELECT string_agg(external_ref, ',' ORDER BY external_ref) FROM o WHERE o.key = g.key AND k <= 8) AS orders FROM g GROUP BY key""",
)
def _(l: Ledger) -> DataFrame:
    return receipts.staged_products(l.artifacts).select("key", "sku", "description", "lines", "amount_paise", F.array_join("orders", ",").alias("orders"))


@query("rcp3_worklist")
def _(l: Ledger) -> DataFrame:
    return receipts.product_worklist(receipts.staged_products(l.artifacts), l.aliases, l.items).select("key", "lines", "amount_paise", "decision", "item_id", "needs_input")


def _landed(l: Ledger):
    known = l.evidence.where("source_type = 'invoice'")
    resolved = receipts.record_lines(receipts.staged(l.artifacts)).select("artifact_id", "line_index", F.col("sku").cast("long").alias("item_id"))
    return known, receipts.confirm(l.artifacts, resolved, known, l.lines)


@query(
    "rcp4_evidence",
    """SELECT f.id AS artifact, e.id IS NOT NULL AS known, CAST(f.total AS BIGINT) AS cost_paise, f.day AS evidence_date, 'invoice order ORD-' || f.id AS description FROM files f LEFT JOIN evidence e ON e.external_ref = 'ORD-' || f.id AND e.source_type = 'invoice' WHERE f.parse_status = 'staged'""",
)
def _(l: Ledger) -> DataFrame:
    known, (rows, _) = _landed(l)
    marked = rows.inserts.join(known.select("id", F.lit(True).alias("known")), "id", "left")
    return marked.select(F.regexp_extract("external_ref", "[0-9]+", 0).cast("long").alias("artifact"), F.coalesce("known", F.lit(False)).alias("known"), "cost_paise", "evidence_date", "description")


@query(
    "rcp4_lines",
    """SELECT 'new' AS what, kind, count(*) AS n, count(sku) AS items, CAST(sum(amount_paise) AS BIGINT) AS amount_paise FROM printed GROUP BY kind
    UNION ALL SELECT 'old', kind, count(*), count(item_id), CAST(sum(amount_paise) AS BIGINT) FROM printed WHERE evidence_id IN (SELECT id FROM evidence WHERE source_type = 'invoice') GROUP BY kind""",
)
def _(l: Ledger) -> DataFrame:
    _, (_, lines) = _landed(l)
    both = lines.inserts.withColumn("what", F.lit("new")).unionByName(lines.deletes.withColumn("what", F.lit("old")))
    return both.groupBy("what", "kind").agg(F.count("*").alias("n"), F.count("item_id").alias("items"), F.sum("amount_paise").alias("amount_paise"))


@query(
    "rcp4_confirm",
    """WITH paid AS (SELECT id, CAST(-total AS BIGINT) AS amount_paise, day + CAST(id // 5 % 5 AS INTEGER) AS txn_date FROM files WHERE parse_status = 'staged'),
    m AS (SELECT f.id AS artifact, min(f.day) AS day, min(p.id) AS row FROM files f JOIN paid p ON p.amount_paise = -f.total AND abs(f.day - p.txn_date) <= 3 WHERE f.parse_status = 'staged' GROUP BY f.id HAVING count(*) = 1),
    u AS (SELECT row, arg_min(artifact, (day, artifact % 2, artifact)) AS artifact FROM m GROUP BY row),
    d AS (SELECT u.row, i.category_id, CAST(sum(p.amount_paise) AS BIGINT) AS a FROM u JOIN printed p ON p.evidence_id = u.artifact JOIN items i ON i.id = CAST(p.sku AS BIGINT) WHERE kind = 'goods' AND i.category_id IS NOT NULL GROUP BY u.row, i.category_id),
    r AS (SELECT u.row, min(paid.amount_paise) AS whole, CAST(min(paid.amount_paise) + coalesce(sum(d.a), 0) AS BIGINT) AS rest FROM u JOIN paid ON paid.id = u.row LEFT JOIN d ON d.row = u.row GROUP BY u.row),
    w AS (SELECT *, rest <> 0 AND whole < -20000000 AS wanted, row % 2 = 0 AND rest = whole AS same FROM r)
    SELECT 'in' AS what, row AS transaction_id, category_id, -a AS amount_paise, 'evidence' AS source, CAST(NULL AS BIGINT) AS rule_id FROM d
    UNION ALL SELECT 'in', row, 77, rest, 'rule', 21 FROM w WHERE wanted AND NOT same UNION ALL SELECT 'out', row, 77, whole, 'rule', 21 FROM w WHERE row % 2 = 0 AND NOT (wanted AND same)""",
)
def _(l: Ledger) -> DataFrame:
    """All staged orders land on rows that paid them some days later, half of which a rule had explained."""
    l = l.once("base", "lines", "artifacts")
    k = F.col("id")
    paid = receipts.staged(l.artifacts).select(
        k, F.lit(1).cast("long").alias("account_id"), F.date_add("record.order_date", (F.floor(k / 5) % 5).cast("int")).alias("txn_date"), (-F.col("record.total_paise")).alias("amount_paise"), F.lit("regular").alias("type"), F.lit("paid").alias("narration")
    )
    none = F.lit(None).cast("long")
    before = paid.where("id % 2 = 0").select(
        k, k.alias("transaction_id"), "amount_paise", F.lit(77).cast("long").alias("category_id"), F.lit("0.80").cast("decimal(3,2)").alias("confidence"), F.lit("rule").alias("source"), F.lit(21).cast("long").alias("rule_id"), none.alias("evidence_id"), none.alias("confirmed_from_rule_id")
    )
    known = l.evidence.where("source_type = 'invoice'")
    resolved = receipts.record_lines(receipts.staged(l.artifacts)).select("artifact_id", "line_index", F.col("sku").cast("long").alias("item_id"))
    large = rules.Rule(21, "large", (rules.Condition("amount_paise", "lt", -20000000),), category_id=77)
    lines = l.lines.join(known.select(F.col("id").alias("evidence_id")), "evidence_id", "left_semi").select(*l.lines.columns)
    landing = receipts.confirm_and_explain(l.artifacts, resolved, known, lines, l.items, l.evidence_transactions, paid, before, [large])
    return _flat(landing.allocations).drop("evidence_id")


@query(
    "rcp5_confirmable",
    "SELECT o_orderkey * 2 AS artifact_id, CASE WHEN f.id IS NULL THEN 'error' WHEN parse_status = 'staged' THEN 'land' ELSE 'skip' END AS verdict FROM orders LEFT JOIN files f ON f.id = o_orderkey * 2",
)
def _(l: Ledger) -> DataFrame:
    return receipts.confirmable(l.table("orders").select((F.col("o_orderkey") * 2).alias("artifact_id")), l.artifacts)


PICKED = "(SELECT id AS evidence_id, CASE WHEN id % 5 = 0 THEN NULL WHEN id % 11 = 10 THEN id + 1 WHEN id % 13 = 0 THEN -id ELSE id END AS transaction_id FROM evidence UNION ALL SELECT -1, 1)"


def _picked(l: Ledger) -> DataFrame:
    k = F.col("id")
    row = F.when(k % 5 == 0, None).when(k % 11 == 10, k + 1).when(k % 13 == 0, -k).otherwise(k)
    return l.evidence.select(k.alias("evidence_id"), row.alias("transaction_id")).unionByName(l.spark.createDataFrame([(-1, 1)], "evidence_id long, transaction_id long"))


@query(
    "rcp6_check_links",
    f"""SELECT p.evidence_id, CASE WHEN p.evidence_id < 0 THEN 'no_such_receipt' WHEN p.transaction_id IS NULL THEN 'no_transaction' WHEN t.id IS NULL THEN 'no_such_row' WHEN t.amount_paise >= 0 THEN 'not_a_debit'
    WHEN EXISTS (SELECT 1 FROM allocations a WHERE a.transaction_id = p.transaction_id AND a.source = 'evidence' AND a.evidence_id <> p.evidence_id) THEN 'other_order' ELSE 'ok' END AS verdict FROM {PICKED} p LEFT JOIN transactions t ON t.id = p.transaction_id""",
)
def _(l: Ledger) -> DataFrame:
    return receipts.check_links(_picked(l), l.evidence, l.transactions, l.allocations)


@query(
    "rcp6_relink",
    """SELECT e.evidence_id AS old_row, CASE WHEN EXISTS (SELECT 1 FROM allocations a WHERE a.transaction_id = t.id AND a.source = 'evidence' AND a.evidence_id <> e.evidence_id) OR t.amount_paise >= 0 THEN false ELSE true END AS freed
    FROM evidence_transactions e JOIN transactions t ON t.id = e.transaction_id + 1""",
)
def _(l: Ledger) -> DataFrame:
    wanted = l.evidence_transactions.select("evidence_id", (F.col("transaction_id") + 1).alias("transaction_id")).join(l.transactions.select(F.col("id").alias("transaction_id")), "transaction_id")
    _, freed = receipts.relink(wanted, receipts.check_links(wanted, l.evidence, l.transactions, l.allocations), l.evidence_transactions)
    return wanted.select(F.col("evidence_id").alias("old_row")).join(freed.select(F.col("transaction_id").alias("old_row"), F.lit(True).alias("freed")), "old_row", "left").select("old_row", F.coalesce("freed", F.lit(False)).alias("freed"))


@query("rcp8_list", "SELECT id, mime, parse_status FROM files WHERE parse_status = 'failed' ORDER BY day DESC, id DESC LIMIT 50 OFFSET 20")
def _(l: Ledger) -> DataFrame:
    return receipts.list_artifacts(l.artifacts, 50, 20, "failed").select("id", "mime", "parse_status")


@query(
    "rcp8_status",
    "SELECT id, CASE WHEN id % 2 = 0 THEN 'pending' ELSE 'staged' END AS parse_status, CASE WHEN id % 3 = 0 THEN 'market' ELSE 'invoice' END AS source_type, id % 2 <> 0 AS timed FROM files WHERE parse_status IN ('failed', 'unsupported')",
)
def _(l: Ledger) -> DataFrame:
    k, none = F.col("id"), F.lit(None).cast("string")
    held = l.artifacts.where(F.col("parse_status").isin(*receipts.HELD))
    updates = held.select("id", F.when(k % 2 == 0, "pending").otherwise("staged").alias("status"), F.when(k % 3 == 0, "market").alias("new_source"), none.alias("new_ref"), none.alias("error"))
    return receipts.set_status(held, updates, NOW).inserts.select("id", "parse_status", "source_type", F.col("parsed_at").isNotNull().alias("timed"))


@query(
    "rcp9_candidates",
    """SELECT id AS artifact_id, parse_status, (SELECT arg_max(error_kind, (finished_at, j.id)) FROM jobs j WHERE j.artifact_id = f.id AND state = 'failed') AS last_error, NOT EXISTS (SELECT 1 FROM jobs j WHERE j.artifact_id = f.id AND state = 'failed') AS fresh
    FROM files f WHERE mime = 'application/pdf' AND parse_status IN ('failed', 'unsupported') AND id NOT IN (SELECT artifact_id FROM jobs WHERE state IN ('queued', 'running'))""",
)
def _(l: Ledger) -> DataFrame:
    return receipts.reading_candidates(l.artifacts, l.jobs)


@query(
    "rcp9_estimate",
    """WITH c AS (SELECT id, EXISTS (SELECT 1 FROM jobs j WHERE j.artifact_id = f.id AND state = 'failed') AS tried FROM files f WHERE mime = 'application/pdf' AND parse_status IN ('failed', 'unsupported') AND id NOT IN (SELECT artifact_id FROM jobs WHERE state IN ('queued', 'running'))),
    m AS (SELECT CAST(round(quantile_cont(epoch(finished_at) - epoch(created_at), 0.5)) AS BIGINT) AS s FROM jobs WHERE state = 'done'), n AS (SELECT count(*) AS total, count(*) FILTER (NOT tried) AS fresh FROM c)
    SELECT total, fresh, total - fresh AS retryable, CASE WHEN s > 0 THEN s END AS median_seconds, CAST(fresh * CASE WHEN s > 0 THEN s END AS BIGINT) AS estimate_seconds FROM n, m""",
)
def _(l: Ledger) -> DataFrame:
    return receipts.reading_estimate(receipts.reading_candidates(l.artifacts, l.jobs), l.jobs)


def _answers(l: Ledger) -> DataFrame:
    """Readings of the staged documents, some of them wrong in one way each."""
    k, record = F.col("id"), F.col("record")
    named = F.array_join(F.transform(record["invoices"][0]["lines"], lambda r: F.concat(F.upper(r["description"]), F.lit("  "), F.format_number(r["amount_paise"] / 100, 2))), "\n")
    page = F.concat(F.lit("Tax invoice, order number\n"), F.when(k % 11 == 3, F.lit("nothing else")).otherwise(named))
    total = F.when(k % 13 == 1, record["total_paise"] + 1).otherwise(record["total_paise"])
    return receipts.staged(l.artifacts).select(
        k.alias("artifact_id"), (k % 17 != 2).alias("is_invoice"), (k % 19 == 4).alias("is_credit_note"), page.alias("markdown"), F.when(k % 3 == 0, "The Shop, Ltd.").otherwise("invoice").alias("merchant"),
        record.withField("total_paise", total).withField("external_ref", F.when(k % 23 == 5, F.lit(" ")).otherwise(record["external_ref"])).alias("record"),
    )


VERDICT = "CASE WHEN id % 17 = 2 THEN 'not_an_invoice' WHEN id % 19 = 4 THEN 'credit_note' WHEN id % 23 = 5 THEN 'schema_violation' WHEN id % 13 = 1 THEN 'does_not_reconcile' WHEN id % 11 = 3 THEN 'hallucinated_lines' ELSE 'ok' END"


@query(
    "utl7_answers",
    f"""SELECT id AS artifact_id, {VERDICT} AS verdict, false AS low_coverage, {VERDICT} = 'ok' AND (SELECT max(line_index) FROM lines l WHERE l.evidence_id = f.id) = 0 AS no_quantity FROM files f WHERE parse_status = 'staged'""",
)
def _(l: Ledger) -> DataFrame:
    return receipts.check_answers(_answers(l))


@query(
    "rcp10_land",
    f"""SELECT artifact_id, CASE WHEN outcome = 'ok' AND e.id IS NOT NULL THEN 'duplicate_order' WHEN outcome = 'ok' THEN 'staged' ELSE outcome END AS outcome FROM (SELECT id AS artifact_id, CASE WHEN id % 7 = 0 THEN 'unreadable_mime' ELSE {VERDICT} END AS outcome FROM files WHERE parse_status = 'staged') x
    LEFT JOIN evidence e ON e.external_ref = 'ORD-' || artifact_id AND e.source_type = 'invoice'""",
)
def _(l: Ledger) -> DataFrame:
    known = l.evidence.where("source_type = 'invoice'").withColumn("source_type", F.lit("marketplace"))
    return receipts.land_answers(_answers(l), l.artifacts, known).select("artifact_id", "outcome")


@query(
    "itm7_alias",
    """WITH n AS (SELECT id AS item_id, canon FROM (SELECT id, trim(regexp_replace(lower(label), '[^a-z0-9]+', ' ', 'g')) AS canon, row_number() OVER (PARTITION BY trim(regexp_replace(lower(label), '[^a-z0-9]+', ' ', 'g')) ORDER BY id) AS k FROM items) WHERE k = 1)
    SELECT i.id AS line_id, coalesce(a.item_id, n.item_id) AS alias_item, CASE WHEN a.item_id IS NOT NULL THEN 'sku' ELSE 'name' END AS via FROM items i LEFT JOIN aliases a ON i.id % 2 = 0 AND a.alias_value = CAST(i.id AS VARCHAR) JOIN n ON n.canon = trim(regexp_replace(lower(i.label), '[^a-z0-9]+', ' ', 'g'))""",
)
def _(l: Ledger) -> DataFrame:
    k = F.col("id")
    names = l.items.select("id", text.canonical_name(F.col("label")).alias("alias_value")).groupBy("alias_value").agg(F.min("id").alias("item_id"))
    known = l.aliases.unionByName(names.select("item_id", F.lit("invoice").alias("source_type"), F.lit("name").alias("alias_kind"), "alias_value"))
    lines = l.items.select(k.alias("line_id"), F.lit("invoice").alias("source_type"), F.when(k % 2 == 0, k.cast("string")).alias("sku"), F.upper("label").alias("name"))
    return items.by_alias(lines, known).select("line_id", "alias_item", "via")


@query(
    "evd13_touched",
    "SELECT DISTINCT x.evidence_id, x.transaction_id FROM evidence_transactions x JOIN lines l ON l.evidence_id = x.evidence_id WHERE l.item_id % 3 = 1",
)
def _(l: Ledger) -> DataFrame:
    return evidence.touched_by_items(l.items.where("id % 3 = 1").select(F.col("id").alias("item_id")), l.lines, l.evidence_transactions)


@query(
    "evd13_rederive",
    """WITH o AS (SELECT DISTINCT l.evidence_id FROM lines l JOIN evidence_transactions x ON x.evidence_id = l.evidence_id WHERE item_id % 3 = 1)
    SELECT id, category_id, amount_paise FROM allocations WHERE (source = 'evidence' AND evidence_id IN (SELECT evidence_id FROM o)) OR (source = 'rule' AND transaction_id IN (SELECT x.transaction_id FROM evidence_transactions x JOIN o ON o.evidence_id = x.evidence_id
    JOIN transactions t ON t.id = x.transaction_id WHERE t.amount_paise <> 0 AND EXISTS (SELECT 1 FROM lines l JOIN items i ON i.id = l.item_id WHERE l.evidence_id = x.evidence_id AND i.category_id IS NOT NULL AND l.kind = 'goods')
    AND NOT EXISTS (SELECT 1 FROM allocations a WHERE a.transaction_id = x.transaction_id AND (a.source = 'user' OR (a.source = 'evidence' AND a.evidence_id NOT IN (SELECT evidence_id FROM o))))))""",
)
def _(l: Ledger) -> DataFrame:
    changed = l.items.where("id % 3 = 1").select(F.col("id").alias("item_id"))
    change, _ = evidence.rederive(changed, l.lines, l.items, l.evidence_transactions, l.transactions, l.allocations)
    return change.deletes.select("id", "category_id", "amount_paise")


# Stored records as JSON text, ordered steps, trees


@query(
    "jsn1_record_lines",
    "SELECT evidence_id AS id, CAST(line_index AS BIGINT) AS place, description, sku, kind, amount_paise FROM printed",
)
def _(l: Ledger) -> DataFrame:
    """The lines of each stored record, spread from its JSON text; one in seven texts is cut short and gives none."""
    rows = receipts.staged(l.artifacts).select("id", F.to_json("record").alias("payload"))
    whole = rows.unionByName(rows.select((-F.col("id")).alias("id"), F.expr("left(payload, length(payload) - 1)").alias("payload")))
    fields = {"description": ("$.description", "string"), "sku": ("$.sku", "string"), "kind": ("$.kind", "string"), "amount_paise": ("$.amount_paise", "long")}
    return records.elements(whole, "payload", "$.invoices[0].lines", fields).drop("payload")


@query(
    "jsn2_props",
    """SELECT event_type, count(*) AS texts, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total, count(*) FILTER (CAST(json_extract(props, '$.k') AS BIGINT) % 2 = 0) AS marked FROM events GROUP BY event_type""",
)
def _(l: Ledger) -> DataFrame:
    """Properties merged with a mark for even values, then read for the mark."""
    value = records.field(records.parsed(F.col("props")), "$.k", "long")
    marked = l.table("events").withColumn("props", F.when(value % 2 == 0, records.merged(F.col("props"), F.lit('{"even": null}'))).otherwise(F.col("props")))
    record = records.parsed(F.col("props"))
    return marked.groupBy("event_type").agg(F.count("props").alias("texts"), F.sum(records.field(record, "$.k", "long")).alias("total"), F.count(F.when(records.has_key(record, "even"), 1)).alias("marked"))


@query("snk9_tree", "SELECT p.name AS parent, c.name, count(*) OVER () AS made, c.parent_id IS NULL AS root FROM categories c LEFT JOIN categories p ON p.id = c.parent_id WHERE coalesce(p.name, c.name) <> (SELECT min(p_type) FROM part)")
def _(l: Ledger) -> DataFrame:
    """The category tree from types and brands alone, beside the first type, which is there already."""
    parts = l.table("part").select("p_type", "p_brand").distinct()
    none = F.array().cast("array<struct<name: string>>")
    nodes = parts.select(F.col("p_type").alias("name"), none.alias("parents")).unionByName(parts.select(F.col("p_brand").alias("name"), F.array(F.struct(F.col("p_type").alias("name"))).alias("parents")))
    named = l.categories.select("id", "parent_id", "name")
    there = named.where("id = 1 or parent_id = 1")
    made = steps.insert_tree(nodes, there, ["name"])
    every = made.unionByName(there)
    parents = every.select(F.col("id").alias("parent_id"), F.col("name").alias("parent"))
    out = made.join(parents, "parent_id", "left").select("parent", "name", F.col("parent_id").isNull().alias("root"))
    return out.join(out.agg(F.count("*").alias("made")), F.lit(True))


@query(
    "snk12_steps",
    """SELECT id, amount_paise, category_id, source, CASE WHEN source = 'user' THEN NULL WHEN source = 'rule' AND rule_id = 4 THEN 3 ELSE rule_id END AS rule_id FROM allocations WHERE abs(amount_paise) >= 1000000""",
)
def _(l: Ledger) -> DataFrame:
    """Three backfills of allocations, two of them applied at first and the third later; a further run is empty."""

    def rewrite(table: str, column: str, value):
        def change(now):
            rows = now[table].withColumn("_new", value)
            moved = rows.where(~F.col("_new").eqNullSafe(F.col(column)))
            return {table: changes.ChangeSet(moved.withColumn(column, F.col("_new")).select(*now[table].columns), moved.select(*now[table].columns))}

        return change

    def small(now):
        rows = now["allocations"]
        return {"allocations": changes.ChangeSet(rows.where("false"), rows.where("abs(amount_paise) < 1000000"))}

    every = [
        steps.Step("001_rules", "rule 4 becomes 3", rewrite("allocations", "rule_id", F.when((F.col("source") == "rule") & (F.col("rule_id") == 4), F.lit(3).cast("long")).otherwise(F.col("rule_id")))),
        steps.Step("002_small", "slices under 10000 go", small), steps.Step("003_users", "users have no rule", rewrite("allocations", "rule_id", F.when(F.col("source") != "user", F.col("rule_id")))),
    ]
    keys, tables, applied = {"allocations": ["id"]}, {"allocations": l.allocations}, steps.no_steps(l.spark)
    for upto in (2, 3, 3):
        tables, applied, _ = steps.run_steps(tables, applied, every[:upto], keys)
    return tables["allocations"].select("id", "amount_paise", "category_id", "source", "rule_id")


def _landed_statements(l: Ledger) -> landing.Landed:
    """Statements of each bank's last account land again on a ledger that lacks what they say of the second half of each month."""
    last = l.accounts.groupBy("bank").agg(F.max("id").alias("account_id"))
    own = l.transactions.where(f"id < {MIRROR}").join(last, "account_id")
    parsed = own.select(F.concat(F.lit("file-"), F.col("bank")).alias("file"), "bank", F.row_number().over(Window.partitionBy("account_id").orderBy("txn_date", "id")).alias("statement_seq"), "txn_date", "amount_paise", "narration", F.lit(None).cast("long").alias("bank_balance_paise"))
    late = own.where("day(txn_date) > 15").select("id")
    ledger = l.transactions.join(late, "id", "left_anti").select(*l.transactions.columns).withColumn("bank_balance_paise", F.lit(None).cast("long"))
    return landing.land(parsed, l.accounts, ledger, _keywords(l), _locked(l))


@query(
    "src6_land",
    f"""WITH last AS (SELECT bank, max(id) AS account_id FROM accounts GROUP BY bank), own AS (SELECT t.*, bank FROM transactions t JOIN last USING (account_id) WHERE id < {MIRROR}),
    kept AS (SELECT account_id, txn_date, amount_paise, narration FROM transactions WHERE account_id IN (SELECT account_id FROM last) AND id NOT IN (SELECT id FROM own WHERE day(txn_date) > 15)),
    fresh AS (SELECT DISTINCT account_id, txn_date, amount_paise, coalesce(narration, '') AS narration FROM own EXCEPT SELECT account_id, txn_date, amount_paise, coalesce(narration, '') FROM kept),
    b AS (SELECT account_id, sum(amount_paise) AS balance FROM (SELECT account_id, amount_paise FROM kept UNION ALL SELECT account_id, amount_paise FROM fresh) GROUP BY account_id)
    SELECT 'file-' || bank AS file, account_id, count(*) AS parsed, (SELECT count(*) FROM fresh f WHERE f.account_id = own.account_id) AS inserted, count(*) - (SELECT count(*) FROM fresh f WHERE f.account_id = own.account_id) AS skipped,
    CAST((SELECT balance FROM b WHERE b.account_id = own.account_id) AS BIGINT) AS balance_paise FROM own GROUP BY bank, account_id""",
)
def _(l: Ledger) -> DataFrame:
    landed = _landed_statements(l.once("base"))
    return landed.files.join(landed.reconciled.select("account_id", "balance_paise"), "account_id")


@query(
    "utl11_redaction",
    """WITH l AS (SELECT *, 'IN' || lpad(CAST(coalesce(item_id, 0) AS VARCHAR), 6, '0') AS invoice FROM lines),
    firsts AS (SELECT evidence_id, invoice, row_number() OVER (PARTITION BY evidence_id ORDER BY min(line_index)) AS n FROM l GROUP BY evidence_id, invoice)
    SELECT evidence_id, string_agg('Name : Test Customer' || chr(10) || 'Order Id : 404-0000001-0000001' || chr(10) || 'Invoice Number : TTD1-9900' || lpad(CAST(n AS VARCHAR), 2, '0') || chr(10) || 'Total ' || amount_paise || chr(10) ||
    'Billing Address : 1 Example Road, Example Locality, Example City' || chr(10) || '[redacted]' || chr(10) || chr(10) || 'PAN No: AAPCA6346P [redacted]' || CASE WHEN kind = 'fee' THEN ' see order ' || (evidence_id + 1000000) ELSE '' END, chr(12) ORDER BY line_index) AS text,
    CASE WHEN bool_or(kind = 'fee') THEN CAST(max(evidence_id) + 1000000 AS VARCHAR) ELSE '' END AS leaks FROM l JOIN firsts USING (evidence_id, invoice) GROUP BY evidence_id""",
)
def _(l: Ledger) -> DataFrame:
    """Each order's invoices as printed pages, one a line, redacted; a fee's page names the order again without a label."""
    who, order = F.concat(F.lit("Customer "), F.col("evidence_id").cast("string")), (F.col("evidence_id") + 1000000).cast("string")
    number, more = F.lpad(F.coalesce("item_id", F.lit(0)).cast("string"), 6, "0"), F.when(F.col("kind") == "fee", F.concat(F.lit(" see order "), order)).otherwise("")
    # Whole pages would be sorted and spilled with the lines of an order; what all its pages say is put around the rest after that.
    rest = F.struct("line_index", F.concat(number, F.lit("\nTotal "), F.col("amount_paise").cast("string")).alias("invoice"), more.alias("more"))
    orders = l.lines.select("evidence_id", rest.alias("rest")).groupBy("evidence_id").agg(F.sort_array(F.collect_list("rest")).alias("rest"))
    head, tail = F.concat(F.lit("Name : "), who, F.lit("\nOrder Id : "), order, F.lit("\nInvoice Number : IN")), F.concat(F.lit("\nBilling Address :\n"), who, F.lit("\n\nPAN No: AAPCA6346P "), F.lower(who))
    orders = orders.withColumn("head", head).withColumn("tail", tail)
    pages = F.transform("rest", lambda r: F.concat(F.col("head"), r["invoice"], F.col("tail"), r["more"]))
    documents = orders.select("evidence_id", pages.alias("parts"), F.array(who).alias("forbidden"))
    return redaction.redact(documents).select("evidence_id", F.array_join("parts", "\f").alias("text"), F.array_join("leaks", ",").alias("leaks"))


@query(
    "stm3_heartbeat",
    """SELECT r.id, max(b.ts) AS claimed_at FROM jobs r JOIN (SELECT user_id, ts FROM events WHERE event_type IN ('click', 'purchase')) b ON b.user_id = r.batch_id
    WHERE r.state = 'running' AND b.ts > r.claimed_at AND b.ts <= r.claimed_at + INTERVAL 5 MINUTE GROUP BY r.id""",
)
def _(l: Ledger) -> DataFrame:
    """What a user did while a job of theirs ran counts as its worker's beats."""
    acts = l.table("events").where("event_type in ('click', 'purchase')").select(F.col("user_id").alias("batch_id"), F.col("ts").alias("at"))
    beats = l.jobs.where("state = 'running'").select("id", "batch_id").join(acts, "batch_id").select("id", "at")
    return queue.heartbeat(l.jobs, beats)


# Shared-expense exports to plans

GROUPED = """WITH r AS (SELECT *, 'café nr ' || user_id || 'x' AS g, 'item ' || word || ' b' AS says, CASE WHEN minute(ts) < 20 THEN value_paise // 2 WHEN minute(ts) < 30 THEN 0 ELSE -(value_paise // 2) END AS net,
    CASE WHEN event_id % 9 = 0 THEN 'payment' ELSE 'expense' END AS kind FROM purchases), s AS (SELECT *, g || '|' || CAST(CAST(ts AS DATE) AS VARCHAR) || '|' || says || '|' || value_paise AS ref FROM r)"""


def _import_plan(l: Ledger) -> shared.ImportPlan:
    """Each buyer's purchases as the rows of an export; groups and descriptions are written untidily."""
    net = F.when(F.minute("ts") < 20, F.expr("value_paise div 2")).when(F.minute("ts") < 30, 0).otherwise(F.expr("-(value_paise div 2)"))
    rows = l.purchases.select(
        F.col("user_id").cast("string").alias("file"), F.to_date("ts").alias("date"), F.concat(F.lit("  Item  "), "word", F.lit("\n\u00a0B ")).alias("description"), F.col("word").alias("category"), F.lit("INR").alias("currency"),
        F.col("value_paise").alias("cost_paise"), F.create_map(F.lit("me"), net).alias("nets"), net.alias("net_paise"), F.when(F.col("event_id") % 9 == 0, "payment").otherwise("expense").alias("kind"),
    )
    groups = rows.select("file").distinct().select("file", F.concat(F.lit(" Cafe\u0301 |  NR "), "file", F.lit("\tX ")).alias("group"))
    return shared.import_plan(rows, groups, l.source_map)


@query("shr3_external_ref", f"{GROUPED} SELECT g AS \"group\", ref AS external_ref, value_paise AS cost_paise, net AS net_paise, kind FROM s")
def _(l: Ledger) -> DataFrame:
    return _import_plan(l).evidence.select("group", "external_ref", "cost_paise", "net_paise", "kind")


@query(
    "shr4_import",
    f"""{GROUPED} SELECT CASE WHEN category_id IS NULL THEN 'unclassified' ELSE 'consumption' END AS part, ref AS external_ref, CAST(category_id AS BIGINT) AS category_id, net AS amount_paise
    FROM s LEFT JOIN source_map ON word = source_category WHERE net < 0 AND kind = 'expense'
    UNION ALL SELECT DISTINCT 'unmapped', word, NULL::BIGINT, NULL::BIGINT FROM s WHERE net < 0 AND kind = 'expense' AND word NOT IN (SELECT source_category FROM source_map)""",
)
def _(l: Ledger) -> DataFrame:
    plan, none = _import_plan(l), F.lit(None).cast("long")
    rows = plan.consumption.select(F.lit("consumption").alias("part"), "external_ref", "category_id", "amount_paise")
    rows = rows.unionByName(plan.unclassified.select(F.lit("unclassified").alias("part"), "external_ref", none.alias("category_id"), "amount_paise"))
    return rows.unionByName(plan.unmapped.select(F.lit("unmapped").alias("part"), F.col("source_category").alias("external_ref"), none.alias("category_id"), none.alias("amount_paise")))


@query(
    "shr4_stats",
    f"""{GROUPED} SELECT g AS "group", count(*) FILTER (kind = 'payment') AS payments, count(*) FILTER (kind <> 'payment' AND net > 0) AS paid, count(*) FILTER (kind <> 'payment' AND net = 0) AS not_mine,
    count(*) FILTER (kind <> 'payment' AND net < 0) AS owed_by_me FROM s GROUP BY g""",
)
def _(l: Ledger) -> DataFrame:
    return _import_plan(l).stats


@query(
    "jn15_vocabulary",
    f"""{GROUPED}, seen AS (SELECT word, count(*) AS records, count(*) FILTER (net < 0 AND kind = 'expense') AS consumed_records, sum(-net) FILTER (net < 0 AND kind = 'expense') AS consumed_paise FROM s GROUP BY word)
    SELECT coalesce(word, m.source_category) AS source_category, CAST(category_id AS BIGINT) AS category_id, c.name AS category, p.name AS parent, m.source_category IS NOT NULL AS decided, coalesce(records, 0) AS records,
    coalesce(consumed_records, 0) AS consumed_records, CAST(coalesce(consumed_paise, 0) AS BIGINT) AS consumed_paise
    FROM seen FULL JOIN (SELECT * FROM source_map UNION ALL SELECT 'never', (SELECT max(id) FROM categories)) m ON m.source_category = word LEFT JOIN categories c ON c.id = category_id LEFT JOIN categories p ON p.id = c.parent_id""",
)
def _(l: Ledger) -> DataFrame:
    leaf = l.categories.agg(F.max("id").alias("category_id")).select(F.lit("never").alias("source_category"), "category_id")
    return shared.vocabulary_worklist(_import_plan(l).evidence, l.source_map.unionByName(leaf), l.categories)


# Progress of batches, and views

BATCHES = """WITH b AS (SELECT batch_id, count(*) FILTER (attempts > 0) AS total, min(created_at) AS created_at, CASE WHEN count(*) FILTER (state IN ('queued', 'running')) = 0 THEN max(finished_at) END AS finished_at, bool_or(artifact_id < 100) AS consented FROM jobs GROUP BY batch_id),
    p AS (SELECT batch_id, count(*) FILTER (state = 'queued') AS queued, count(*) FILTER (state = 'running') AS running, count(*) FILTER (state = 'done') AS done, count(*) FILTER (state = 'failed') AS failed FROM jobs GROUP BY batch_id)"""


def _batches(l: Ledger) -> DataFrame:
    """Batches as their jobs tell them; the total counts jobs that were tried."""
    done = F.when(F.count_if(F.col("state").isin(*queue.OUTSTANDING)) == 0, F.max("finished_at"))
    return l.jobs.groupBy("batch_id").agg(
        F.lit("invoices").alias("kind"), F.count_if(F.col("attempts") > 0).alias("total"), F.min("created_at").alias("created_at"), F.min(F.when(F.col("artifact_id") < 100, F.col("created_at"))).alias("consented_at"), done.alias("finished_at"),
    )


@query(
    "agg19_active_batches",
    f"""{BATCHES} SELECT batch_id, 'invoices' AS kind, total, queued, running, done, failed, consented, finished_at IS NOT NULL AS finished, created_at FROM b JOIN p USING (batch_id)
    WHERE finished_at IS NULL OR finished_at > TIMESTAMP '{NOW}' - INTERVAL 1 HOUR ORDER BY created_at DESC, batch_id LIMIT 10""",
)
def _(l: Ledger) -> DataFrame:
    return queue.active_batches(_batches(l), l.jobs, NOW)


@query(
    "agg20_outlook",
    f"""{BATCHES}, m AS (SELECT CAST(round(quantile_cont(epoch(date_trunc('second', finished_at))::BIGINT - epoch(date_trunc('second', created_at))::BIGINT, 0.5)) AS BIGINT) AS s FROM jobs WHERE state = 'done')
    SELECT batch_id, CAST(CASE WHEN s > 0 THEN (queued + running) * s END AS BIGINT) AS remaining_seconds, queued + running = 0 AS settled, least(1.0::DOUBLE, (done + failed)::DOUBLE / greatest(total, done + failed, 1)) AS fraction_done FROM b JOIN p USING (batch_id), m""",
)
def _(l: Ledger) -> DataFrame:
    counts = queue.progress(l.jobs).drop("total").join(_batches(l).select("batch_id", "total"), "batch_id")
    return queue.outlook(counts, queue.median_seconds(l.jobs).scalar()).select("batch_id", "remaining_seconds", "settled", "fraction_done")


@query(
    "agg24_usage_rollup",
    """WITH u AS (SELECT c.id, c.name, c.parent_id, (SELECT count(*) FROM allocations a WHERE a.category_id = c.id) AS allocations, (SELECT count(*) FROM rules r WHERE r.category_id = c.id) AS rules FROM categories c),
    r AS (SELECT p.id, p.name, CAST(p.allocations + coalesce((SELECT sum(k.allocations) FROM u k WHERE k.parent_id = p.id), 0) AS BIGINT) AS allocations, CAST(p.rules + coalesce((SELECT sum(k.rules) FROM u k WHERE k.parent_id = p.id), 0) AS BIGINT) AS rules FROM u p WHERE parent_id IS NULL)
    SELECT *, greatest(1, max(allocations) OVER ()) AS scale FROM r""",
)
def _(l: Ledger) -> DataFrame:
    return reports.usage_rollup(reports.category_usage(l.categories, l.allocations, l.rules, l.items))


@query(
    "flt19_order_views",
    """WITH h AS (SELECT f.id, count(t.id) AS hits FROM files f LEFT JOIN transactions t ON t.amount_paise = -f.total AND abs(date_diff('day', t.txn_date, f.day)) <= 3 WHERE f.parse_status = 'staged' GROUP BY f.id)
    SELECT count(*) FILTER (hits = 1) AS matched, count(*) FILTER (hits > 1) AS ambiguous, count(*) FILTER (hits = 0) AS unmatched, count(*) AS "all" FROM h""",
)
def _(l: Ledger) -> DataFrame:
    return receipts.view_counts(receipts.staged_orders(l.artifacts, l.aliases, l.items, l.transactions), receipts.ORDER_VIEWS).drop("needs")


@query("flt19_product_views")
def _(l: Ledger) -> DataFrame:
    return receipts.view_counts(receipts.product_worklist(receipts.staged_products(l.artifacts), l.aliases, l.items), receipts.PRODUCT_VIEWS)
