"""Receipts from reading to landing: answer checks, the staged worklist, confirming, linking, reading again.

An artifact is a stored file: ``id, created_at, mime, source_type, parse_status, record``.
What was read from it is one nested column (``RECORD``), so a check of a document
is an expression over its own row; only what meets the catalogue or the ledger is
exploded. All operators take many artifacts at once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import canonical_name, merchant_slug
from ledgerloom.operators import evidence as matching
from ledgerloom.operators import queue
from ledgerloom.operators.changes import ChangeSet, next_ids
from ledgerloom.operators.items import resolve
from ledgerloom.operators.rules import Rule
from ledgerloom.session import checkpointed
from ledgerloom.sources.invoices import template

LINE = "struct<description:string,sku:string,kind:string,qty:int,amount_paise:bigint>"
RECORD = f"struct<external_ref:string,order_date:date,total_paise:bigint,invoices:array<struct<invoice_number:string,total_paise:bigint,lines:array<{LINE}>>>>"
#: The share of printed amounts that lines should claim, the words that ground a long description, statuses and sizes.
LEAST_COVERAGE, GROUND_WORDS = 0.3, 4
HELD = ("unsupported", "failed")
ORDER_REFS = 8
#: Decisions that a person should look at.
ASKS = ("link", "create_and_propose")


def _lines(record: Column) -> Column:
    return F.flatten(F.transform(record["invoices"], lambda i: i["lines"]))


def _sum(rows: Column, field: str) -> Column:
    return F.aggregate(rows, F.lit(0).cast("long"), lambda s, r: s + F.coalesce(r[field], F.lit(0)))


def _plain(text: Column) -> Column:
    low = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[\u200b-\u200d\ufeff]", "")
    return F.trim(F.regexp_replace(low, "[^a-z0-9]+", " "))


def _grounded(description: Column, page: Column) -> Column:
    """Whether a description stands on the page; of a long one the first words are enough."""
    wanted = _plain(description)
    words = F.split(wanted, " ")
    start = F.array_join(F.slice(words, 1, GROUND_WORDS), " ")
    return (wanted != "") & (page.contains(wanted) | ((F.size(words) >= GROUND_WORDS) & page.contains(start)))


def coverage(record: Column, markdown: Column) -> Column:
    """Share of the amounts printed in a document that its record claims; null if none is printed."""
    printed = F.regexp_extract_all(markdown, F.lit(r"\b(?:[0-9]{1,3}(?:,[0-9]{2,3})*|[0-9]+)\.[0-9]{2}\b"), F.lit(0))
    paise = F.filter(F.transform(printed, lambda p: (F.regexp_replace(p, ",", "").try_cast("decimal(38,2)") * 100).cast("long")), lambda p: p > 0)
    amounts = F.concat(F.transform(_lines(record), lambda r: F.abs(r["amount_paise"])), F.transform(record["invoices"], lambda i: F.abs(i["total_paise"])), F.array(F.abs(record["total_paise"])))
    return F.when(F.size(paise) > 0, F.size(F.filter(paise, lambda p: F.array_contains(F.array_compact(amounts), p))) / F.size(paise))


def answer_verdict(record: Column, is_invoice: Column, is_credit_note: Column, markdown: Column) -> Column:
    """What a model's reading of a document is worth: ``ok`` or the first thing that is wrong.

    In this order: no invoice, a credit note, something missing, sums that differ
    by anything at all, lines that the document does not print.
    """
    invoices, lines = record["invoices"], _lines(record)
    missing = (F.trim(F.coalesce(record["external_ref"], F.lit(""))) == "") | (F.coalesce(F.size(invoices), F.lit(0)) < 1) | (F.coalesce(F.size(lines), F.lit(0)) < 1) | (F.coalesce(record["total_paise"], F.lit(0)) == 0)
    off = F.exists(invoices, lambda i: ~_sum(i["lines"], "amount_paise").eqNullSafe(i["total_paise"])) | (_sum(invoices, "total_paise") != record["total_paise"])
    page = _plain(markdown)
    return (
        F.when(~F.coalesce(is_invoice, F.lit(False)), "not_an_invoice").when(F.coalesce(is_credit_note, F.lit(False)), "credit_note").when(missing, "schema_violation")
        .when(off, "does_not_reconcile").when(F.exists(lines, lambda r: ~_grounded(r["description"], page)), "hallucinated_lines").otherwise("ok")
    )


def check_answers(answers: DataFrame) -> DataFrame:
    """``artifact_id, verdict, low_coverage, no_quantity``; the last two only warn.

    ``answers``: artifact_id, is_invoice, is_credit_note, markdown, record.
    """
    record = F.col("record")
    low = F.coalesce(coverage(record, F.col("markdown")) < LEAST_COVERAGE, F.lit(False))
    none = F.forall(_lines(record), lambda r: r["qty"] == 0)
    verdict = answer_verdict(record, F.col("is_invoice"), F.col("is_credit_note"), F.col("markdown"))
    rows = answers.withColumn("verdict", verdict)
    good = F.col("verdict") == "ok"
    return rows.select("artifact_id", "verdict", (good & low).alias("low_coverage"), (good & F.coalesce(none, F.lit(False))).alias("no_quantity"))


def land_answers(answers: DataFrame, artifacts: DataFrame, evidence: DataFrame) -> DataFrame:
    """``artifact_id, outcome, source_type, external_ref`` of readings: ``staged``, or why not.

    ``answers`` also has ``merchant``. A template that recognises the document
    names its source; else the merchant's words do. An order that has landed, and
    a file that a person landed meanwhile, are duplicates.
    """
    known = artifacts.select(F.col("id").alias("artifact_id"), "mime", "parse_status")
    source = F.coalesce(template(F.lower("markdown")), merchant_slug(F.col("merchant")))
    rows = answers.join(known, "artifact_id", "left").withColumn("source_type", source).withColumn("external_ref", F.col("record.external_ref"))
    landed = evidence.where("external_ref is not null").select("source_type", "external_ref", F.lit(True).alias("landed")).distinct()
    rows = rows.join(landed, ["source_type", "external_ref"], "left")
    verdict = answer_verdict(F.col("record"), F.col("is_invoice"), F.col("is_credit_note"), F.col("markdown"))
    outcome = (
        F.when(F.col("parse_status").isNull(), "corrupt").when(F.col("parse_status") == "parsed", "duplicate_order").when(~F.col("mime").eqNullSafe("application/pdf"), "unreadable_mime")
        .when(verdict != "ok", verdict).when(F.col("landed"), "duplicate_order").otherwise("staged")
    )
    rows = rows.withColumn("outcome", outcome)
    staged = F.col("outcome") == "staged"
    return rows.select("artifact_id", "outcome", F.when(staged, F.col("source_type")).alias("source_type"), F.when(staged, F.col("external_ref")).alias("external_ref"))


def staged(artifacts: DataFrame) -> DataFrame:
    return artifacts.where("parse_status = 'staged' and record is not null")


def record_lines(artifacts: DataFrame) -> DataFrame:
    """``artifact_id, source_type, external_ref, line_index`` and the fields of every line, over all invoices of a record."""
    rows = artifacts.select(F.col("id").alias("artifact_id"), "source_type", F.col("record.external_ref").alias("external_ref"), F.posexplode(_lines(F.col("record"))).alias("line_index", "line"))
    return rows.select("artifact_id", "source_type", "external_ref", "line_index", "line.*")


def resolved_lines(artifacts: DataFrame, aliases: DataFrame, items: DataFrame) -> DataFrame:
    """``record_lines`` with the decision on each (``fee`` for fees), its item and that item's category."""
    rows = record_lines(artifacts).withColumn("line_id", F.concat_ws("-", F.col("artifact_id").cast("string"), F.col("line_index").cast("string")))
    goods = rows.where("kind <> 'fee'")
    found = resolve(goods.select("line_id", "source_type", "sku", F.col("description").alias("name")), aliases, items)
    found = found.withColumn("item_id", F.when(F.col("decision").isin("existing", "link"), F.col("item_id")))
    categories = items.select(F.col("id").alias("item_id"), "category_id")
    return rows.join(found.join(categories, "item_id", "left"), "line_id", "left").withColumn("decision", F.coalesce("decision", F.lit("fee"))).drop("line_id")


def staged_orders(artifacts: DataFrame, aliases: DataFrame, items: DataFrame, candidates: DataFrame, tokens: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """The worklist, nothing written: each staged order with its bank row, its lines and whether a person must look.

    ``candidates``: the bank rows that may have paid. A proposed item or an ambiguous row needs attention.
    """
    orders = staged(artifacts)
    lines = resolved_lines(orders, aliases, items).withColumn("needs_input", F.col("decision").isin(*ASKS))
    each = F.struct("line_index", "kind", "description", "amount_paise", "decision", "item_id", "category_id", "needs_input")
    nested = lines.groupBy("artifact_id").agg(F.sort_array(F.collect_list(each)).alias("lines"), F.max("needs_input").alias("asks"))
    total = F.col("record.total_paise")
    wanted = orders.select("id", "source_type", F.col("record.order_date").alias("evidence_date"), F.lit("expense").alias("kind"), total.alias("cost_paise"), F.lit(1).alias("my_net_paise"))
    found = matching.match(wanted, candidates, tokens).withColumnRenamed("evidence_id", "artifact_id")
    rows = orders.select(F.col("id").alias("artifact_id"), "source_type", "record.external_ref", "record.order_date", total.alias("total_paise"), F.size("record.invoices").alias("invoice_count"))
    rows = rows.join(nested, "artifact_id", "left").join(found, "artifact_id", "left")
    attention = F.coalesce("asks", F.lit(False)) | F.coalesce(F.col("outcome") == "ambiguous", F.lit(False))
    return rows.withColumn("needs_attention", attention).drop("asks")


def staged_summary(artifacts: DataFrame, aliases: DataFrame, items: DataFrame) -> DataFrame:
    """One row: staged and held artifacts, the staged total, and goods lines without a categorised item."""
    skus = aliases.where("alias_kind = 'sku'").join(items.where("category_id is not null").select(F.col("id").alias("item_id")), "item_id").select("source_type", F.col("alias_value").alias("sku")).distinct()
    is_held, is_staged = F.col("parse_status").isin(*HELD).cast("long"), (F.col("parse_status") == "staged").cast("long")
    none, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    row = lambda sku, *values: F.struct(sku.alias("sku"), *(v.alias(c) for v, c in zip(values, ("staged", "held", "total_paise", "lines"), strict=True)))
    # A row for the artifact and one for each goods line, summed by SKU before they meet the catalogue: artifacts are read once, and lines without a SKU do not meet in one task.
    goods = F.when(F.col("parse_status") == "staged", F.filter(_lines(F.col("record")), lambda r: r["kind"] == "goods"))
    own = F.array(row(F.lit(None).cast("string"), is_staged, is_held, is_staged * F.col("record.total_paise"), none))
    rows = artifacts.select("source_type", F.explode(F.concat(own, F.coalesce(F.transform(goods, lambda r: row(r["sku"], none, none, none, one)), F.array()))).alias("row"))
    sums = rows.select("source_type", "row.*").groupBy("source_type", "sku").agg(*(F.sum(c).alias(c) for c in ("staged", "held", "total_paise", "lines")))
    known = sums.join(skus.withColumn("known", F.lit(True)), ["source_type", "sku"], "left").withColumn("uncategorised_lines", F.when(F.col("known").isNull(), F.col("lines")))
    return known.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("staged", "held", "total_paise", "uncategorised_lines")))


def product_key() -> Column:
    return F.concat(F.col("source_type"), F.lit(":"), F.coalesce("sku", F.concat(F.lit("name:"), canonical_name(F.col("description")))))


def staged_products(artifacts: DataFrame) -> DataFrame:
    """Goods lines by product: source and sku, or source and canonical name; the longest description names it.

    ``orders`` has the first eight order references in order.
    """
    lines = record_lines(staged(artifacts)).where("kind <> 'fee'").withColumn("key", product_key())
    place = F.row_number().over(Window.partitionBy("key").orderBy("external_ref"))
    refs = lines.select("key", "external_ref").distinct().withColumn("_n", place).where(F.col("_n") <= ORDER_REFS)
    refs = refs.groupBy("key").agg(F.sort_array(F.collect_list("external_ref")).alias("orders"))
    longest = F.min_by("description", F.struct(-F.length("description"), "description"))
    rows = lines.groupBy("key").agg(F.min("source_type").alias("source_type"), F.min("sku").alias("sku"), longest.alias("description"), F.count("*").alias("lines"), F.sum("amount_paise").alias("amount_paise"))
    return rows.join(refs, "key", "left")


def product_worklist(products: DataFrame, aliases: DataFrame, items: DataFrame, search: str | None = None, asking: bool = False) -> DataFrame:
    """Staged products with the decision on each, resolved once; most lines first, then most money, then by key."""
    wanted = products.select(F.col("key").alias("line_id"), "source_type", "sku", F.col("description").alias("name"))
    found = resolve(wanted, aliases, items).withColumnRenamed("line_id", "key").withColumn("item_id", F.when(F.col("decision").isin("existing", "link"), F.col("item_id")))
    rows = products.join(found, "key").join(items.select(F.col("id").alias("item_id"), F.col("label").alias("item_name"), "category_id"), "item_id", "left")
    rows = rows.withColumn("needs_input", F.col("decision").isin(*ASKS))
    if asking:
        rows = rows.where("needs_input")
    if search and search.strip():
        needle = search.strip().lower()
        rows = rows.where(F.lower(F.concat_ws("\n", "description", "item_name", "sku")).contains(needle))
    return rows.orderBy(F.desc("lines"), F.desc("amount_paise"), "key")


#: The views of staged products and orders; a row belongs to as many as it satisfies.
PRODUCT_VIEWS = {"needs": "needs_input or category_id is null", "existing": "decision = 'existing'", "create": "decision in ('create', 'create_and_propose')", "nocat": "category_id is null", "all": "true"}
ORDER_VIEWS = {"needs": "needs_attention", "matched": "outcome = 'matched'", "ambiguous": "outcome = 'ambiguous'", "unmatched": "coalesce(outcome, 'none') = 'none'", "all": "true"}


def in_view(view: str, views: dict[str, str]) -> Column:
    if view not in views:
        raise ValueError(f"no view {view!r}")
    return F.coalesce(F.expr(views[view]), F.lit(False))


def view_counts(rows: DataFrame, views: dict[str, str]) -> DataFrame:
    """One row: how many rows each view has, in one pass; a chip's count and its list share the condition."""
    return rows.agg(*(F.count_if(in_view(v, views)).alias(v) for v in views))


def confirmable(wanted: DataFrame, artifacts: DataFrame) -> DataFrame:
    """``artifact_id, verdict`` of artifacts to confirm: ``land``, ``skip`` (not staged, as after a second click) or ``error``."""
    known = artifacts.select(F.col("id").alias("artifact_id"), "parse_status", F.col("record").isNotNull().alias("read"))
    rows = wanted.select("artifact_id").distinct().join(known, "artifact_id", "left")
    ready = (F.col("parse_status") == "staged") & F.col("read")
    return rows.select("artifact_id", F.when(F.col("read").isNull(), "error").when(ready, "land").otherwise("skip").alias("verdict"))


def confirm(artifacts: DataFrame, resolved: DataFrame, evidence: DataFrame, lines: DataFrame) -> tuple[ChangeSet, ChangeSet]:
    """The change sets of evidence and of its lines when staged orders land.

    ``resolved``: artifact_id, line_index, item_id (with new items' ids). An order
    that is known by source and reference keeps its id; its lines are written
    anew. Of artifacts with one order the last by id lands.
    """
    order = ["source_type", "external_ref"]
    record = F.col("record")
    last = Window.partitionBy(*order).orderBy(F.desc("artifact_id"))
    rows = staged(artifacts).select(F.col("id").alias("artifact_id"), "source_type", record["external_ref"].alias("external_ref"), record["order_date"].alias("evidence_date"), record["total_paise"].alias("cost_paise"))
    rows = rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
    known = evidence.where("external_ref is not null").groupBy(*order).agg(F.min("id").alias("id"))
    rows = rows.join(known, order, "left")
    fresh = next_ids(evidence, rows.where("id is null").drop("id"), [F.col("artifact_id")])
    rows = rows.where("id is not null").unionByName(fresh)
    text = F.concat_ws(" ", "source_type", F.lit("order"), "external_ref")
    renewed = {"my_net_paise": F.col("cost_paise"), "kind": F.lit("expense"), "description": text}
    columns = [renewed[c].alias(c) if c in renewed else F.col(c) for c in evidence.columns]
    old = evidence.join(rows.select("id"), "id", "left_semi").select(*evidence.columns)
    own = record_lines(staged(artifacts)).select("artifact_id", "line_index", "kind", "amount_paise")
    own = own.join(rows.select("artifact_id", F.col("id").alias("evidence_id")), "artifact_id").join(resolved.select("artifact_id", "line_index", "item_id"), ["artifact_id", "line_index"], "left")
    own = own.withColumn("item_id", F.when(F.col("kind") != "fee", F.col("item_id")))
    gone = lines.join(old.select(F.col("id").alias("evidence_id")), "evidence_id", "left_semi").select(*lines.columns)
    return ChangeSet(rows.select(*columns), old), ChangeSet(own.select(*lines.columns), gone)


@dataclass(frozen=True)
class Landing:
    """What confirming orders writes: evidence, lines, links and allocations."""

    evidence: ChangeSet
    lines: ChangeSet
    links: ChangeSet
    allocations: ChangeSet


def confirm_and_explain(artifacts: DataFrame, resolved: DataFrame, evidence: DataFrame, lines: DataFrame, items: DataFrame, links: DataFrame, txns: DataFrame, allocations: DataFrame, rules: list[Rule], overrides: DataFrame | None = None, tokens: dict[str, tuple[str, ...]] | None = None) -> Landing:
    """Land staged orders, match them to their rows, write their lines there, and let the rules fill what is left.

    ``overrides`` (artifact_id, line_index, item_id) are a person's choices and win over ``resolved``. An order that has links keeps them;
    another is linked if exactly one row fits, and the first order by date and id gets a contested row. Rows that a
    person or another order explains are not written to.
    """
    if overrides is not None:
        chosen = overrides.select("artifact_id", "line_index", F.col("item_id").alias("_item"), F.lit(True).alias("_chosen"))
        both = resolved.select("artifact_id", "line_index", "item_id").join(chosen, ["artifact_id", "line_index"], "full")
        resolved = both.select("artifact_id", "line_index", F.when(F.col("_chosen"), F.col("_item")).otherwise(F.col("item_id")).alias("item_id"))
    records, goods = confirm(artifacts, resolved, evidence, lines)
    landed = records.inserts.select("id", "source_type", "evidence_date", F.lit("expense").alias("kind"), "cost_paise", F.col("cost_paise").alias("my_net_paise"))
    landed = checkpointed(landed)
    standing = links.join(landed.select(F.col("id").alias("evidence_id")), "evidence_id", "left_semi")
    swept = matching.sweep(landed, standing, txns, allocations, tokens).where("result = 'linked'")
    fresh = checkpointed(swept.select("evidence_id", "transaction_id"))
    every = standing.select("evidence_id", "transaction_id").unionByName(fresh)
    now = lines.join(goods.deletes.select("evidence_id").distinct(), "evidence_id", "left_anti").select(*lines.columns).unionByName(goods.inserts.select(*lines.columns))
    derived = matching.derive(landed.select(F.col("id").alias("evidence_id")), now, items, every, txns, allocations)
    return Landing(records, goods, ChangeSet(fresh, links.where("false")), matching.backfilled(derived, every, txns, allocations, rules))


def check_links(wanted: DataFrame, evidence: DataFrame, transactions: DataFrame, allocations: DataFrame) -> DataFrame:
    """``evidence_id, verdict`` of hand-made links (evidence_id, transaction_id), judged record by record.

    A receipt must exist, its rows too; they are debits, and no other order explains them.
    """
    rows = wanted.select("evidence_id", "transaction_id").distinct()
    rows = rows.join(evidence.select(F.col("id").alias("evidence_id"), F.lit(True).alias("known")), "evidence_id", "left")
    rows = rows.join(transactions.select(F.col("id").alias("transaction_id"), F.col("amount_paise").alias("paid")), "transaction_id", "left")
    claims = allocations.where("source = 'evidence'").groupBy("transaction_id").agg(F.min("evidence_id").alias("lo"), F.max("evidence_id").alias("hi"))
    rows = rows.join(claims, "transaction_id", "left")
    other = F.coalesce((F.col("lo") != F.col("evidence_id")) | (F.col("hi") != F.col("evidence_id")), F.lit(False))
    judged = rows.groupBy("evidence_id").agg(
        F.max("known").alias("known"), F.count("transaction_id").alias("picked"), F.count(F.when(F.col("transaction_id").isNotNull() & F.col("paid").isNull(), 1)).alias("lost"),
        F.count(F.when(F.col("paid") >= 0, 1)).alias("credits"), F.count(F.when(other, 1)).alias("taken"),
    )
    verdict = F.when(F.col("known").isNull(), "no_such_receipt").when(F.col("picked") == 0, "no_transaction").when(F.col("lost") > 0, "no_such_row").when(F.col("credits") > 0, "not_a_debit").when(F.col("taken") > 0, "other_order").otherwise("ok")
    return judged.select("evidence_id", verdict.alias("verdict"))


def relink(wanted: DataFrame, checked: DataFrame, links: DataFrame) -> tuple[ChangeSet, DataFrame]:
    """The change set of links, and the rows (``transaction_id``) that they free for the rules to fill."""
    good = checked.where("verdict = 'ok'").select("evidence_id")
    fresh = wanted.join(good, "evidence_id", "left_semi").select(*links.columns).distinct()
    old = links.join(good, "evidence_id", "left_semi").select(*links.columns)
    freed = old.join(fresh, ["evidence_id", "transaction_id"], "left_anti").select("transaction_id").distinct()
    return ChangeSet(fresh, old), freed


def relink_and_backfill(wanted: DataFrame, evidence: DataFrame, lines: DataFrame, items: DataFrame, links: DataFrame, txns: DataFrame, allocations: DataFrame, rules: list[Rule]) -> tuple[DataFrame, ChangeSet, ChangeSet]:
    """Hand-made links judged and written: the verdicts, and the change sets of links and of allocations.

    The receipts' lines go to the new rows; the rules fill what is left of those and of the rows that were freed.
    """
    checked = check_links(wanted, evidence, txns, allocations)
    change, freed = relink(wanted, checked, links)
    orders = checked.where("verdict = 'ok'").select("evidence_id")
    derived = matching.derive(orders, lines, items, change.inserts, txns, allocations)
    touched = change.inserts.select("transaction_id").unionByName(freed)
    return checked, change, matching.backfilled(derived, touched, txns, allocations, rules)


def list_artifacts(artifacts: DataFrame, limit: int, offset: int = 0, status: str | None = None) -> DataFrame:
    """A page of artifacts without their contents, newest first."""
    rows = artifacts.where(F.col("parse_status") == status) if status else artifacts
    return rows.drop("bytes", "record").orderBy(F.desc("created_at"), F.desc("id")).offset(offset).limit(limit)


def set_status(artifacts: DataFrame, updates: DataFrame, now: str) -> ChangeSet:
    """New statuses (``id, status, new_source, new_ref, error``); sources and references stay where the update has none.

    The error is the update's own; ``pending`` has no time of parsing.
    """
    rows = artifacts.join(updates, "id")
    renewed = {
        "parse_status": F.col("status"), "source_type": F.coalesce("new_source", "source_type"), "external_ref": F.coalesce("new_ref", "external_ref"), "parse_error": F.col("error"),
        "parsed_at": F.when(F.col("status") != "pending", queue.at(now)),
    }
    return ChangeSet(rows.select(*(renewed[c].alias(c) if c in renewed else F.col(c) for c in artifacts.columns)), rows.select(*(F.col(c) for c in artifacts.columns)))


def reading_candidates(artifacts: DataFrame, jobs: DataFrame) -> DataFrame:
    """Held PDF files that no job works on: ``artifact_id, parse_status, last_error, fresh`` (never failed a reading)."""
    busy = jobs.where(F.col("state").isin(*queue.OUTSTANDING)).select(F.col("artifact_id").alias("id"))
    rows = artifacts.where((F.col("mime") == "application/pdf") & F.col("parse_status").isin(*HELD)).join(busy, "id", "left_anti")
    failed = queue.latest_failure(jobs).select(F.col("artifact_id").alias("id"), F.col("error_kind").alias("last_error"), F.lit(True).alias("tried"))
    return rows.join(failed, "id", "left").select(F.col("id").alias("artifact_id"), "parse_status", "last_error", F.col("tried").isNull().alias("fresh"))


def reading_estimate(candidates: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row: candidates, fresh and retryable ones, the median of a job and how long the fresh ones take (null without one)."""
    none = F.lit(None).cast("long")
    parts = candidates.select(F.lit(1).cast("long").alias("total"), F.col("fresh").cast("long").alias("fresh"), none.alias("median_seconds"))
    parts = parts.unionByName(queue.median_seconds(jobs).select(none.alias("total"), none.alias("fresh"), "median_seconds"))
    row = parts.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("total"), F.coalesce(F.sum("fresh"), F.lit(0)).alias("fresh"), F.max("median_seconds").alias("median_seconds"))
    return row.withColumn("retryable", F.col("total") - F.col("fresh")).withColumn("estimate_seconds", F.col("fresh") * F.col("median_seconds"))
