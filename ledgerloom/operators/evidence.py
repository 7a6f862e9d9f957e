"""External evidence matched to bank rows: expected cash, matching, splitting, precedence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import day_gap
from ledgerloom.operators.changes import ChangeSet, compose
from ledgerloom.operators.rules import Rule, apply_rules
from ledgerloom.session import checkpointed

MATCH_DAYS = 3
NEAR_DAYS = 10


def expected_cash(kind: Column, cost: Column, net: Column) -> Column:
    """The bank amount a record implies: own payment of an expense, or a settlement; null if none."""
    return F.when((kind == "expense") & (net > 0), -cost).when((kind == "payment") & (net != 0), -net)


def expected(evidence: DataFrame) -> DataFrame:
    rows = evidence.withColumn("expected_paise", expected_cash(F.col("kind"), F.col("cost_paise"), F.col("my_net_paise")))
    return rows.where("expected_paise is not null")


def identifies(narration: Column, source: Column, tokens: dict[str, tuple[str, ...]]) -> Column:
    """Whether a narration can be a payment to a source: any of its tokens stands in it.

    A source without tokens has no signal, so everything passes; a source with
    tokens never fits a row without words.
    """
    text = F.trim(F.regexp_replace(F.lower(F.regexp_replace(F.coalesce(narration, F.lit("")), "[\u200b-\u200d\ufeff]", "")), r"\s+", " "))
    out = F.lit(True)
    for name, own in tokens.items():
        found = F.lit(False)
        for token in own:
            found = found | text.contains(token)
        out = F.when(source == name, found).otherwise(out)
    return out


def pairs(evidence: DataFrame, txns: DataFrame, most_days: int, tokens: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Records and rows of the same amount at most ``most_days`` apart, and of the same merchant if ``tokens`` tell.

    An equi-join on amount and a bucket of days: each record looks into the
    buckets before and after its own, so an amount that is common stays apart by date.
    """
    width = most_days + 1
    bucket = lambda day: F.floor(F.unix_date(day) / width)
    rows = txns.select(F.col("id").alias("transaction_id"), F.col("amount_paise").alias("expected_paise"), "txn_date", "narration", bucket(F.col("txn_date")).alias("bucket"))
    own = bucket(F.col("evidence_date"))
    wanted = expected(evidence).select(F.col("id").alias("evidence_id"), "source_type", "evidence_date", "expected_paise", F.explode(F.array(own - 1, own, own + 1)).alias("bucket"))
    found = wanted.join(rows, ["expected_paise", "bucket"]).withColumn("gap", day_gap(F.col("evidence_date"), F.col("txn_date"))).where(F.col("gap") <= most_days)
    return found.where(identifies(F.col("narration"), F.col("source_type"), tokens or {})).drop("bucket", "narration", "source_type")


def match(evidence: DataFrame, txns: DataFrame, tokens: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """``evidence_id, outcome, transaction_id``: matched only if exactly one row fits."""
    hits = pairs(evidence, txns, MATCH_DAYS, tokens).groupBy("evidence_id").agg(F.count("*").alias("n"), F.min("transaction_id").alias("one"))
    rows = expected(evidence).select(F.col("id").alias("evidence_id")).join(hits, "evidence_id", "left")
    return rows.select("evidence_id", F.when(F.col("n") == 1, "matched").when(F.col("n") > 1, "ambiguous").otherwise("none").alias("outcome"), F.when(F.col("n") == 1, F.col("one")).alias("transaction_id"))


def near_misses(evidence: DataFrame, txns: DataFrame, tokens: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Rows of the right amount, and merchant, that are a little too far away, nearest first."""
    rows = pairs(evidence, txns, NEAR_DAYS, tokens).where(F.col("gap") > MATCH_DAYS)
    place = F.row_number().over(Window.partitionBy("evidence_id").orderBy("gap", "transaction_id"))
    return rows.select("evidence_id", "transaction_id", "gap", place.alias("place"))


def split_proportionally(parts: DataFrame, key: str, place: str, weight: str, total: str) -> DataFrame:
    """``share`` of each part: truncated by weight, the last takes the rest; equal shares on no weight.

    Products are taken as decimals, so they never overflow.
    """
    group = Window.partitionBy(key)
    rows = parts.withColumn("_w", F.abs(F.col(weight)).cast("decimal(38,0)")).withColumn("_all", F.sum("_w").over(group)).withColumn("_n", F.count("*").over(group))
    weighted = F.expr(f"cast(cast(`{total}` as decimal(19,0)) * cast(if(_all = 0, 1, _w) as decimal(19,0)) div cast(if(_all = 0, _n, _all) as decimal(19,0)) as bigint)")
    last = F.row_number().over(group.orderBy(F.col(place).desc())) == 1
    rows = rows.withColumn("_share", weighted).withColumn("_last", last)
    rest = F.col(total) - F.sum(F.when(~F.col("_last"), F.col("_share")).otherwise(0)).over(group)
    return rows.withColumn("share", F.when(F.col("_last"), rest).otherwise(F.col("_share"))).drop("_w", "_all", "_n", "_share", "_last")


def precedence(wanted: DataFrame, allocations: DataFrame) -> DataFrame:
    """``evidence_id, transaction_id, verdict, displaced``: who may write to a row.

    The user's own allocations block an automatic match, other evidence blocks
    any; rule allocations are displaced.
    """
    per = allocations.groupBy("transaction_id").agg(
        F.max((F.col("source") == "user").cast("int")).alias("authored"), F.count(F.when(F.col("source") == "evidence", 1)).alias("claims"), F.max("evidence_id").alias("claimant"), F.count(F.when(F.col("source") == "rule", 1)).alias("displaced")
    )
    rows = wanted.join(per, "transaction_id", "left")
    other = (F.coalesce("claims", F.lit(0)) > 1) | ((F.coalesce("claims", F.lit(0)) == 1) & ~F.col("claimant").eqNullSafe(F.col("evidence_id")))
    verdict = F.when(other, "blocked_by_evidence").when(F.coalesce("authored", F.lit(0)) == 1, "blocked_by_user").otherwise("write")
    return rows.select("evidence_id", "transaction_id", verdict.alias("verdict"), F.when(verdict == "write", F.coalesce("displaced", F.lit(0))).otherwise(0).alias("displaced"))


def apply_links(wanted: DataFrame, evidence: DataFrame, txns: DataFrame, allocations: DataFrame, categories: DataFrame, shared_category: int) -> tuple[DataFrame, ChangeSet]:
    """What linking records to rows writes: the links that may be written, and the change set of allocations.

    ``wanted``: evidence_id, transaction_id. A record is written only if every row of it may be. At most its
    total, and at most what its rows hold, is split over them by amount. A settlement goes to
    ``shared_category``; of an expense the others' part goes there and the rest to the record's own
    category (``categories``: evidence_id, category_id; what a person chose before what a map says), if it has one. The
    record's former allocations and rule allocations on the rows go; see ``backfilled`` for what the rules then fill.
    """
    judged = precedence(wanted.distinct(), allocations).withColumn("all_write", F.min((F.col("verdict") == "write").cast("int")).over(Window.partitionBy("evidence_id")))
    links = judged.where("all_write = 1").select("evidence_id", "transaction_id")
    total = F.abs(F.when(F.col("kind") == "payment", F.col("expected_paise")).otherwise(F.col("cost_paise")))
    records = expected(evidence).select(F.col("id").alias("evidence_id"), "kind", "my_net_paise", total.alias("total"))
    rows = links.join(txns.select(F.col("id").alias("transaction_id"), "amount_paise"), "transaction_id").join(records, "evidence_id")
    rows = rows.withColumn("cap", -F.least("total", F.sum(F.abs("amount_paise")).over(Window.partitionBy("evidence_id"))))
    rows = split_proportionally(rows, "evidence_id", "transaction_id", "amount_paise", "cap").join(categories.select("evidence_id", "category_id"), "evidence_id", "left")
    others = F.expr("if(total = 0, 0L, cast(cast(share as decimal(19,0)) * cast(my_net_paise as decimal(19,0)) div cast(if(total = 0, 1L, total) as decimal(19,0)) as bigint))")
    rows = rows.withColumn("others", F.when(F.col("kind") == "payment", F.col("share")).otherwise(others))
    parts = F.array(F.struct(F.lit(shared_category).cast("long").alias("category_id"), F.col("others").alias("part")), F.struct(F.col("category_id").cast("long").alias("category_id"), (F.col("share") - F.col("others")).alias("part")))
    fresh = rows.select("evidence_id", "transaction_id", F.explode(parts).alias("p")).where("p.category_id is not null and p.part <> 0")
    fresh = fresh.select("transaction_id", "evidence_id", F.col("p.category_id").alias("category_id"), F.col("p.part").alias("amount_paise"))
    displaced = allocations.where("source = 'rule'").join(links.select("transaction_id"), "transaction_id", "left_semi")
    former = allocations.where("source = 'evidence'").join(links.select("evidence_id").distinct(), "evidence_id", "left_semi")
    return links, ChangeSet(as_allocations(fresh, allocations), displaced.select(*allocations.columns).unionByName(former.select(*allocations.columns)))


def as_allocations(fresh: DataFrame, allocations: DataFrame) -> DataFrame:
    """Evidence slices (``transaction_id, evidence_id, category_id, amount_paise``) as rows of ``allocations``, without ids yet."""
    known = {"confidence": F.lit("1.00"), "source": F.lit("evidence"), **{c: F.col(c) for c in fresh.columns}}
    types = dict(allocations.dtypes)
    return fresh.select(*(known.get(c, F.lit(None)).cast(types[c]).alias(c) for c in allocations.columns))


def backfilled(change: ChangeSet, touched: DataFrame, txns: DataFrame, allocations: DataFrame, rules: list[Rule]) -> ChangeSet:
    """``change`` and what the rules then do to the ``touched`` rows (``transaction_id``), as one change set.

    The rules see the touched rows as they stand after the change. A rule slice
    that goes and comes back alike is in neither part, and so is anything else, so a second
    application of the same is empty. The change is checkpointed, since it is read several times.
    """
    change = ChangeSet(checkpointed(change.inserts), checkpointed(change.deletes))
    rows = checkpointed(touched.select("transaction_id").distinct())
    standing = allocations.join(rows, "transaction_id", "left_semi").select(*allocations.columns)
    after = standing.join(change.deletes.select("id"), "id", "left_anti").select(*allocations.columns).unionByName(change.inserts.join(rows, "transaction_id", "left_semi").select(*allocations.columns))
    scope = txns.join(rows.withColumnRenamed("transaction_id", "id"), "id", "left_semi").select(*txns.columns)
    second = apply_rules(scope, after, rules)
    brought = second.inserts.select(*(F.col(c).cast(t).alias(c) for c, t in allocations.dtypes))
    return compose(change, ChangeSet(brought, second.deletes.select(*allocations.columns)), [c for c in allocations.columns if c != "id"])


def unlink(gone: DataFrame, links: DataFrame, allocations: DataFrame) -> tuple[ChangeSet, ChangeSet]:
    """The change sets of links and of allocations when the links of records (``evidence_id``) are taken back."""
    lost = links.join(gone.select("evidence_id").distinct(), "evidence_id", "left_semi").select(*links.columns)
    swept = allocations.where("source = 'evidence'").join(gone.select("evidence_id").distinct(), "evidence_id", "left_semi").select(*allocations.columns)
    return ChangeSet(links.where("false"), lost), ChangeSet(allocations.where("false"), swept)


def unlink_and_backfill(gone: DataFrame, links: DataFrame, txns: DataFrame, allocations: DataFrame, rules: list[Rule]) -> tuple[ChangeSet, ChangeSet]:
    """As ``unlink``, and the rules fill the rows that are free again."""
    lost, swept = unlink(gone, links, allocations)
    return lost, backfilled(swept, lost.deletes, txns, allocations, rules)


def claim_labels(txns: DataFrame, allocations: DataFrame) -> DataFrame:
    """How a row looks to a new record: free, yours, replaces or refused."""
    per = allocations.groupBy(F.col("transaction_id").alias("id")).agg(*(F.max((F.col("source") == s).cast("int")).alias(s) for s in ("user", "rule", "evidence")))
    rows = txns.join(per, "id", "left")
    label = F.when(F.col("evidence") == 1, "refused").when(F.col("user") == 1, "yours").when(F.col("rule") == 1, "replaces").otherwise("free")
    return rows.select("id", label.alias("claim"))


def worklist(evidence: DataFrame, links: DataFrame, txns: DataFrame, allocations: DataFrame, tokens: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Every record that implies cash with its state: matched, conflicted, near or unmatched."""
    rows = expected(evidence).select(F.col("id").alias("evidence_id"), "source_type", "evidence_date", "expected_paise")
    linked = links.groupBy("evidence_id").agg(F.count("*").alias("linked"))
    open_ = evidence.join(links.select(F.col("evidence_id").alias("id")), "id", "left_anti")
    found = match(open_, txns, tokens).where("outcome <> 'none'").select("evidence_id", "outcome", "transaction_id")
    blocked = precedence(found.where("outcome = 'matched'").select("evidence_id", "transaction_id"), allocations).where("verdict <> 'write'").select("evidence_id", F.lit(True).alias("blocked"))
    near = near_misses(open_, txns, tokens).groupBy("evidence_id").agg(F.count("*").alias("near"))
    out = rows.join(linked, "evidence_id", "left").join(found.select("evidence_id", "outcome"), "evidence_id", "left").join(blocked, "evidence_id", "left").join(near, "evidence_id", "left")
    state = F.when(F.col("linked") > 0, "matched").when(F.coalesce("blocked", F.lit(False)), "conflicted").when(F.col("outcome").isNotNull(), "proposed").when(F.col("near") > 0, "near").otherwise("unmatched")
    return out.select("evidence_id", "source_type", "evidence_date", "expected_paise", state.alias("state"))


def batches(worked: DataFrame) -> DataFrame:
    """Records by source and state."""
    states = ("matched", "conflicted", "proposed", "near", "unmatched")
    return worked.groupBy("source_type").agg(F.count("*").alias("records"), *(F.count(F.when(F.col("state") == s, 1)).alias(s) for s in states), F.max("evidence_date").alias("latest"))


def sweep(evidence: DataFrame, links: DataFrame, txns: DataFrame, allocations: DataFrame, tokens: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Match all unlinked records at once: the first by date and id gets a contested row.

    Only records that may write compete for a row; the others are conflicted.
    """
    open_ = evidence.join(links.select(F.col("evidence_id").alias("id")), "id", "left_anti")
    found = match(open_, txns, tokens).where("outcome = 'matched'").join(evidence.select(F.col("id").alias("evidence_id"), "evidence_date"), "evidence_id")
    judged = found.join(precedence(found.select("evidence_id", "transaction_id"), allocations), ["evidence_id", "transaction_id"])
    order = Window.partitionBy("transaction_id", "verdict").orderBy("evidence_date", "evidence_id")
    first = (F.col("verdict") == "write") & (F.row_number().over(order) == 1)
    return judged.select("evidence_id", "transaction_id", F.when(first, "linked").otherwise("conflicted").alias("result"))


def line_allocations(lines: DataFrame, items: DataFrame, links: DataFrame, txns: DataFrame) -> DataFrame:
    """Goods by category poured into the linked rows: the overlap of two running sums.

    Categories fill rows in order of category and row; each share has its row's sign.
    """
    priced = lines.where("kind = 'goods'").join(items.where("category_id is not null").select(F.col("id").alias("item_id"), "category_id"), "item_id")
    demand = priced.groupBy("evidence_id", "category_id").agg(F.sum("amount_paise").alias("amount"))
    rows = links.join(txns.select(F.col("id").alias("transaction_id"), "amount_paise"), "transaction_id").withColumn("amount", F.abs("amount_paise"))

    def running(frame: DataFrame, by: str, name: str) -> DataFrame:
        order = Window.partitionBy("evidence_id").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
        return frame.withColumn(f"{name}_end", F.sum("amount").over(order)).withColumn(f"{name}_start", F.col(f"{name}_end") - F.col("amount")).drop("amount")

    both = running(demand, "category_id", "c").join(running(rows, "transaction_id", "t"), "evidence_id")
    share = F.least("c_end", "t_end") - F.greatest("c_start", "t_start")
    return both.withColumn("share", share).where("share > 0").select("evidence_id", "transaction_id", "category_id", (F.col("share") * F.signum("amount_paise").cast("long")).alias("amount_paise"))


def gate(lines: DataFrame, evidence: DataFrame) -> DataFrame:
    """Orders whose lines do not add up to the stated cost, without tolerance."""
    sums = lines.groupBy(F.col("evidence_id").alias("id")).agg(F.sum("amount_paise").alias("lines_paise"))
    return evidence.join(sums, "id").where("lines_paise <> cost_paise").select("id", "cost_paise", "lines_paise")


def touched_by_items(changed: DataFrame, lines: DataFrame, links: DataFrame) -> DataFrame:
    """``evidence_id, transaction_id`` of every linked order with a line of the changed items (``item_id``)."""
    orders = lines.join(changed.select("item_id"), "item_id", "left_semi").select("evidence_id").distinct()
    return links.join(orders, "evidence_id", "left_semi").select("evidence_id", "transaction_id").distinct()


def derive(orders: DataFrame, lines: DataFrame, items: DataFrame, links: DataFrame, txns: DataFrame, allocations: DataFrame) -> ChangeSet:
    """The change set that writes the lines of ``orders`` (``evidence_id``) anew to the rows they are linked to.

    Rows that a person or another order explains keep that; rule slices go.
    """
    own = orders.select("evidence_id").distinct()
    derived = line_allocations(lines.join(own, "evidence_id", "left_semi"), items, links.join(own, "evidence_id", "left_semi"), txns)
    mine = allocations.where("source = 'evidence'").join(own, "evidence_id", "left_semi").select(*allocations.columns)
    left = allocations.join(mine.select("id"), "id", "left_anti")
    blocked = left.where("source in ('user', 'evidence')").select("transaction_id")
    fresh = derived.join(blocked, "transaction_id", "left_anti")
    displaced = left.where("source = 'rule'").join(fresh.select("transaction_id"), "transaction_id", "left_semi")
    return ChangeSet(as_allocations(fresh, allocations), mine.unionByName(displaced.select(*allocations.columns)))


def rederive(changed: DataFrame, lines: DataFrame, items: DataFrame, links: DataFrame, txns: DataFrame, allocations: DataFrame) -> tuple[ChangeSet, DataFrame]:
    """Orders with changed items (``item_id``) derived anew: the change set of their allocations, and the rows for ``backfilled``, once each."""
    touched = touched_by_items(changed, lines, links)
    return derive(touched, lines, items, links, txns, allocations), touched.select("transaction_id").distinct()


@dataclass(frozen=True)
class Source:
    """A kind of evidence: the tokens of its merchant, and what keeps it from being matched now (None: nothing)."""

    name: str
    tokens: tuple[str, ...] = ()
    unavailable: str | None = None


def rematch(sources: list[Source], evidence: DataFrame, links: DataFrame, txns: DataFrame, allocations: DataFrame, only: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Match the unlinked records of the sources (or of one) again: ``evidence_id, transaction_id, result``, and a summary by source.

    The summary has ``source_type, ran, skipped, linked, conflicted, ambiguous, unmatched``. Links that stand are not decided again,
    so a second run finds nothing more. An unknown source is an error.
    """
    if only is not None and only not in {s.name for s in sources}:
        raise ValueError(f"unknown source {only!r}")
    chosen = [s for s in sources if only in (None, s.name)]
    able = [s.name for s in chosen if s.unavailable is None]
    tokens = {s.name: s.tokens for s in chosen if s.tokens}
    own = evidence.where(F.col("source_type").isin(able))
    swept = sweep(own, links, txns, allocations, tokens)
    open_ = own.join(links.select(F.col("evidence_id").alias("id")), "id", "left_anti")
    outcomes = match(open_, txns, tokens).join(swept.select("evidence_id", "result"), "evidence_id", "left").join(own.select(F.col("id").alias("evidence_id"), "source_type"), "evidence_id")
    count = lambda test: F.count(F.when(test, 1))
    per = outcomes.groupBy("source_type").agg(count(F.col("result") == "linked").alias("linked"), count(F.col("result") == "conflicted").alias("conflicted"), count(F.col("outcome") == "ambiguous").alias("ambiguous"), count(F.col("outcome") == "none").alias("unmatched"))
    stated = evidence.sparkSession.createDataFrame([(s.name, s.unavailable is None, s.unavailable) for s in chosen], "source_type string, ran boolean, skipped string")
    return swept, stated.join(per, "source_type", "left").fillna(0, ["linked", "conflicted", "ambiguous", "unmatched"])
