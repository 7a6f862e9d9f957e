"""The views of ``plans.ledger`` as SQL, for the DuckDB oracles."""

from __future__ import annotations

import re

VIEWS = {
    "accounts": "SELECT CAST(n_nationkey + 1 AS BIGINT) AS id, n_name AS name, r_name AS bank FROM nation JOIN region ON n_regionkey = r_regionkey",
    "kinds": "SELECT p_type, CAST(dense_rank() OVER (ORDER BY p_type) AS BIGINT) AS rnk FROM (SELECT DISTINCT p_type FROM part)",
    "parts": "SELECT p_partkey, p_name, p_brand, p.p_type, rnk, rnk * 1000 + CAST(substr(p_brand, 7) AS BIGINT) AS leaf FROM part p JOIN kinds k ON p.p_type = k.p_type",
    "categories": """SELECT rnk AS id, p_type AS name, CAST(NULL AS BIGINT) AS parent_id, rnk % 5 = 0 AS excluded_from_spend FROM kinds
        UNION ALL SELECT DISTINCT leaf, p_brand, rnk, leaf % 1000 = 7 FROM parts""",
    "base": """SELECT o_orderkey AS id, CAST(c_nationkey + 1 AS BIGINT) AS account_id, CAST(o_orderdate AS DATE) AS txn_date,
        CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE -1 END * CAST(round(o_totalprice * 100) AS BIGINT) AS amount_paise,
        coalesce(p_name, 'cash') AS part_name, coalesce(p_brand, 'none') AS brand, coalesce(leaf, 1) AS leaf
        FROM orders JOIN customer ON o_custkey = c_custkey
        LEFT JOIN (SELECT l_orderkey, min(l_partkey) AS pk FROM lineitem GROUP BY l_orderkey) f ON f.l_orderkey = o_orderkey
        LEFT JOIN parts ON pk = p_partkey""",
    "transactions": """SELECT id, account_id, CASE WHEN id % 13 <> 0 THEN CAST(year(txn_date) * 100 + month(txn_date) AS BIGINT) END AS statement_id, id % 1000 AS statement_seq, txn_date, amount_paise,
        CASE WHEN id % 97 = 0 THEN 'opening_balance' WHEN id % 89 = 0 THEN 'transfer' ELSE 'regular' END AS type,
        CASE WHEN id % 41 <> 0 THEN 'UPI-Debit-' || lpad(CAST(id AS VARCHAR), 12, '0') || '-' || upper(part_name) || '-' || brand END AS narration,
        CASE WHEN id % 89 = 0 THEN 'resolved' WHEN id % 79 = 0 THEN 'suspected' WHEN id % 83 = 0 THEN 'rejected' WHEN id % 71 = 0 THEN 'pending' END AS transfer_status,
        CASE WHEN id % 89 = 0 OR id % 79 = 0 THEN id // 2 END AS transfer_group_id FROM base
        UNION ALL SELECT id + 1000000000000, account_id % 25 + 1, NULL, NULL, CAST(txn_date + CAST(id % 4 AS INTEGER) AS DATE), -amount_paise, 'regular',
        'UPI-Debit-' || lpad(CAST(id AS VARCHAR), 12, '0') || '-' || upper(part_name) || '-' || brand, NULL, NULL FROM base WHERE id % 50 = 0""",
    "runs": """SELECT *, CAST(sum(amount_paise) OVER (PARTITION BY account_id ORDER BY txn_date, statement_id NULLS LAST, statement_seq NULLS LAST, id
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS run FROM transactions""",
    "stated": "SELECT * EXCLUDE (run), CASE WHEN id % 16 <> 0 THEN run + CASE WHEN id % 500 = 0 THEN 12345 ELSE 0 END END AS bank_balance_paise, run FROM runs",
    "allocations": """SELECT id, id AS transaction_id, CASE WHEN id % 2 = 0 THEN amount_paise ELSE amount_paise // 2 END AS amount_paise, leaf AS category_id, source,
        CASE WHEN source = 'rule' THEN id % 6 + 1 END AS rule_id, CASE WHEN source = 'evidence' THEN id END AS evidence_id,
        CASE WHEN source = 'user' AND id % 14 = 0 THEN id % 6 + 1 END AS confirmed_from_rule_id
        FROM (SELECT *, CASE WHEN id % 7 = 0 THEN 'user' WHEN id % 3 = 0 THEN 'rule' WHEN id % 11 = 0 THEN 'evidence' END AS source FROM base) WHERE source IS NOT NULL""",
    "rules": """SELECT * FROM (VALUES (1, 'anvils', 1001, 10, true), (2, 'blue bolts', 2002, 20, true), (3, 'gears or large', 3003, 10, true), (4, 'switched off', 4004, 90, false),
        (5, 'late rings', 5005, 10, true), (6, 'incoming', 6006, 5, true)) r(id, name, category_id, priority, enabled)""",
    "evidence": """SELECT id, CASE WHEN id % 2 = 0 THEN 'invoice' ELSE 'shared' END AS source_type, 'ORD-' || CAST(id AS VARCHAR) AS external_ref, CAST(txn_date + CAST(id % 7 AS INTEGER) AS DATE) AS evidence_date,
        abs(amount_paise) AS cost_paise, CASE WHEN id % 3 = 0 THEN abs(amount_paise) WHEN id % 3 = 1 THEN -(abs(amount_paise) // 2) ELSE 0 END AS my_net_paise,
        CASE WHEN id % 4 = 0 THEN 'payment' ELSE 'expense' END AS kind, part_name AS description FROM base""",
    "evidence_transactions": "SELECT id AS evidence_id, id AS transaction_id FROM base WHERE id % 55 = 0",
    "lines": """SELECT l_orderkey AS evidence_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) - 1 AS line_index,
        CASE WHEN l_tax <> 0 THEN l_partkey END AS item_id, CASE WHEN l_tax <> 0 THEN 'goods' ELSE 'fee' END AS kind, CAST(round(l_extendedprice * 100) AS BIGINT) AS amount_paise FROM lineitem""",
    "items": "SELECT p_partkey AS id, p_name || ' ' || lower(p_brand) AS label, CASE WHEN p_partkey % 3 <> 0 THEN leaf END AS category_id FROM parts",
    "printed_names": """SELECT p_partkey AS item_id, CASE WHEN p_size > 25 THEN p_size || ' g doses, ' ELSE '' END || array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') || ' ' || p_brand ||
        CASE WHEN contains(p_name, 'widget') THEN ' Refill ' || p_size || ' tablets HSN: 04039090' WHEN contains(p_name, 'anvil') THEN ' combo of ' || p_size || ' - ' || cents || ' litres | B0ABCDEFG1 ( B0ABCDEFG1 )' WHEN contains(p_name, 'gear') THEN ' Tetra Pak 4 x ' || p_size || 'g'
        WHEN contains(p_name, 'bolt') THEN ' Pack of ' || p_size || ', ' || cents || '.5kgs (HSN-22029990)' WHEN contains(p_name, 'ring') THEN ' (PET Bottle) ' || p_size || ' ML' ELSE '' END AS name FROM (SELECT *, CAST(round(p_retailprice * 100) AS BIGINT) % 1000 AS cents FROM part)""",
    "aliases": "SELECT p_partkey AS item_id, 'invoice' AS source_type, 'sku' AS alias_kind, CAST(p_partkey AS VARCHAR) AS alias_value FROM parts WHERE p_partkey % 4 <> 0",
    "files": """SELECT evidence_id AS id, CASE WHEN evidence_id % 7 = 0 THEN 'image/png' ELSE 'application/pdf' END AS mime, DATE '2024-01-01' + CAST(evidence_id % 90 AS INTEGER) AS day, sum(amount_paise) AS total,
        CASE evidence_id % 5 WHEN 0 THEN 'unsupported' WHEN 1 THEN 'failed' WHEN 2 THEN 'parsed' ELSE 'staged' END AS parse_status FROM lines GROUP BY evidence_id""",
    "printed": """SELECT evidence_id, line_index, kind, amount_paise, item_id, 'ORD-' || evidence_id AS external_ref, CASE WHEN kind = 'goods' THEN p_name ELSE 'Delivery fee' END AS description,
        CASE WHEN kind = 'goods' AND item_id % 2 = 0 THEN CAST(item_id AS VARCHAR) END AS sku FROM lines LEFT JOIN part ON p_partkey = item_id WHERE evidence_id % 5 > 2""",
    "purchases": "SELECT event_id, user_id, ts, CAST(round(value * 100) AS BIGINT) AS value_paise, 'w' || CAST(hour(ts) // 4 AS VARCHAR) AS word FROM events WHERE event_type = 'purchase'",
    "source_map": "SELECT * FROM (VALUES ('w0', 1), ('w1', 2), ('w2', 3), ('w3', NULL), ('w4', 4)) m(source_category, category_id)",
    "consumption": """SELECT event_id AS id, event_id AS evidence_id, CAST(category_id AS BIGINT) AS category_id, -value_paise AS amount_paise, CAST(ts AS DATE) AS consumed_on, 'evidence' AS source
        FROM purchases JOIN source_map ON word = source_category WHERE category_id IS NOT NULL AND value_paise <> 0""",
    "jobs": """SELECT event_id AS id, event_id % 500 AS artifact_id, user_id AS batch_id, state, CAST(event_id % 4 AS INTEGER) AS attempts, ts AS created_at, CASE WHEN state = 'running' THEN ts END AS claimed_at,
        CASE WHEN state IN ('done', 'failed') THEN ts + CAST(event_id % 90 AS INTEGER) * INTERVAL 1 SECOND END AS finished_at, CASE WHEN state = 'failed' THEN CASE WHEN event_id % 2 = 0 THEN 'timeout' ELSE 'not_an_invoice' END END AS error_kind
        FROM (SELECT *, CASE event_type WHEN 'view' THEN 'queued' WHEN 'signup' THEN 'running' WHEN 'error' THEN 'failed' ELSE 'done' END AS state FROM events)""",
    "spend": "SELECT * FROM transactions WHERE type <> 'opening_balance' AND type <> 'transfer' AND transfer_status IS DISTINCT FROM 'resolved'",
    "explained": "SELECT transaction_id, CAST(sum(amount_paise) AS BIGINT) AS explained FROM allocations GROUP BY transaction_id",
    "consumption_rows": """SELECT al.id, 'allocation' AS origin, t.id AS transaction_id, CAST(NULL AS BIGINT) AS evidence_id, t.account_id, al.category_id, al.amount_paise, t.txn_date AS consumed_on, al.source
        FROM allocations al JOIN spend t ON t.id = al.transaction_id JOIN categories c ON c.id = al.category_id LEFT JOIN categories p ON p.id = c.parent_id
        WHERE NOT c.excluded_from_spend AND NOT coalesce(p.excluded_from_spend, false)
        UNION ALL SELECT id, 'paid_for_you', NULL, evidence_id, NULL, category_id, amount_paise, consumed_on, source FROM consumption""",
}


def sql(query: str) -> str:
    """``query`` with the views it needs, and those they need, in front."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\b(?:FROM|JOIN)\s+([a-z_]+)", text):
            if name in VIEWS and name not in needed:
                visit(VIEWS[name])
                if name not in needed:
                    needed.append(name)

    visit(query)
    if not needed:
        return query
    views = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in needed)
    return f"WITH {views},\n{query[5:].lstrip()}" if query.upper().startswith("WITH ") else f"WITH {views}\n{query}"
