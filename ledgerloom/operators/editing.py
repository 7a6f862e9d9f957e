"""Edits of categories, rules, transfers, artifacts and imports, as checks of many edits at once and change sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.changes import ChangeSet

#: The longest name of a category, and the types that an import may give.
NAME_CHARS = 60
IMPORT_TYPES = ("regular", "transfer", "opening_balance")


def _first_error(*cases: tuple[Column, str]) -> Column:
    """The first error whose condition holds, else ``ok``."""
    out = F.lit("ok")
    for broken, error in reversed(cases):
        out = F.when(F.coalesce(broken, F.lit(False)), error).otherwise(out)
    return out


def check_categories(edits: DataFrame, categories: DataFrame) -> DataFrame:
    """``edit_id, id, name, parent_id, verdict`` for edits (``id`` null: a new category).

    Names are trimmed, not empty and at most 60 characters; a tree has two
    levels; a name may stand once below a parent, whatever its case.
    """
    parents = categories.select(F.col("id").alias("parent_id"), F.lit(True).alias("known"), F.col("parent_id").isNotNull().alias("nested"))
    kids = categories.where("parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("kids"))
    place = F.concat_ws("|", F.coalesce(F.col("parent_id").cast("string"), F.lit("top")), F.lower("name")).alias("place")
    taken = categories.select(place, "id").groupBy("place").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"))
    rows = edits.withColumn("name", F.trim("name")).join(parents, "parent_id", "left").join(kids, "id", "left")
    rows = rows.withColumn("place", place).join(taken, "place", "left")
    inner = F.col("parent_id").isNotNull()
    clash = F.col("first_id").isNotNull() & ~(F.col("first_id").eqNullSafe(F.col("id")) & F.col("last_id").eqNullSafe(F.col("id")))
    verdict = _first_error(
        (F.coalesce("name", F.lit("")) == "", "empty_name"), (F.length("name") > NAME_CHARS, "long_name"), (F.col("parent_id") == F.col("id"), "own_parent"), (inner & F.col("known").isNull(), "no_such_parent"),
        (inner & F.col("nested"), "two_levels"), (inner & (F.col("kids") > 0), "has_children"), (clash, "name_taken"),
    )
    return rows.select("edit_id", "id", "name", "parent_id", verdict.alias("verdict"))


def save_categories(checked: DataFrame, categories: DataFrame) -> ChangeSet:
    """The change set of the edits that are ``ok`` and have an id; other columns stay."""
    good = checked.where("verdict = 'ok' and id is not null").select("id", F.col("name").alias("new_name"), F.col("parent_id").alias("new_parent"))
    rows = categories.join(good, "id")
    columns = [F.col("new_name").alias(c) if c == "name" else F.col("new_parent").alias(c) if c == "parent_id" else F.col(c) for c in categories.columns]
    return ChangeSet(rows.select(*columns), rows.select(*categories.columns))


def check_removals(wanted: DataFrame, categories: DataFrame, allocations: DataFrame, rules: DataFrame, referring: tuple[DataFrame, ...] = ()) -> DataFrame:
    """``id, reassign_to, verdict, allocations, rules`` for categories to delete; those in use need a ``reassign_to``.

    Allocations and rules can be moved. Rows of ``referring`` tables (items, consumption, the map of source words) are not
    moved, so a category that one of them names cannot go.
    """
    known = categories.select("id", F.lit(True).alias("known"))
    kids = categories.where("parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("kids"))
    used = [df.groupBy(F.col("category_id").alias("id")).agg(F.count("*").alias(name)) for df, name in ((allocations, "allocations"), (rules, "rules"))]
    rows = wanted.join(known, "id", "left").join(kids, "id", "left").join(used[0], "id", "left").join(used[1], "id", "left")
    rows = rows.join(known.select(F.col("id").alias("reassign_to"), F.lit(True).alias("target")), "reassign_to", "left").na.fill(0, ["allocations", "rules"])
    named = categories.where("false").select("id")
    for table in referring:
        named = named.unionByName(table.where("category_id is not null").select(F.col("category_id").cast("long").alias("id")))
    rows = rows.join(named.distinct().withColumn("referenced", F.lit(True)), "id", "left")
    verdict = _first_error(
        (F.col("reassign_to") == F.col("id"), "same_category"), (F.col("known").isNull(), "no_such_category"), (F.col("kids") > 0, "has_children"),
        ((F.col("allocations") + F.col("rules") > 0) & F.col("reassign_to").isNull(), "in_use"), (F.col("reassign_to").isNotNull() & F.col("target").isNull(), "no_such_target"),
        (F.col("referenced").isNotNull(), "referenced"),
    )
    return rows.select("id", "reassign_to", verdict.alias("verdict"), "allocations", "rules")


def reassign(rows: DataFrame, removals: DataFrame) -> ChangeSet:
    """The change set that moves ``rows`` (allocations or rules) out of the categories that go."""
    moves = removals.where("verdict = 'ok' and reassign_to is not null").select(F.col("id").alias("category_id"), "reassign_to")
    hit = rows.join(moves, "category_id")
    return ChangeSet(hit.select(*(F.col("reassign_to").alias(c) if c == "category_id" else F.col(c) for c in rows.columns)), hit.select(*rows.columns))


def remove_categories(categories: DataFrame, removals: DataFrame) -> ChangeSet:
    """The change set that deletes the categories whose removal is ``ok``; ``reassign`` moves their allocations and rules first."""
    return ChangeSet(categories.where("false"), categories.join(removals.where("verdict = 'ok'").select("id"), "id", "left_semi").select(*categories.columns))


def edit_rules(current: DataFrame, edited: DataFrame, allocations: DataFrame) -> tuple[DataFrame, ChangeSet]:
    """What each edit asks for, and the sweep of the slices that the old rules made.

    A new name changes nothing that a rule matches; any other change, and a rule
    that is gone, sweeps its allocations. ``rule_id, reapply_needed, allocations_removed``.
    """
    matching = [c for c in current.columns if c not in ("id", "name")]
    marks = [df.select(F.col("id").alias("rule_id"), F.struct(*matching).alias(name)) for df, name in ((current, "old"), (edited, "new"))]
    rows = marks[0].join(marks[1], "rule_id", "left").select("rule_id", (~F.col("old").eqNullSafe(F.col("new"))).alias("reapply_needed"))
    swept = allocations.where("source = 'rule'").join(rows.where("reapply_needed").select("rule_id"), "rule_id", "left_semi").select(*allocations.columns)
    removed = swept.groupBy("rule_id").agg(F.count("*").alias("allocations_removed"))
    return rows.join(removed, "rule_id", "left").na.fill(0, ["allocations_removed"]), ChangeSet(allocations.where("false"), swept)


def link_transfers(transactions: DataFrame, allocations: DataFrame, pairs: DataFrame) -> tuple[ChangeSet, ChangeSet]:
    """Link pairs (``leg, partner, status``), after weaker proposals on either leg are released with their whole group.

    Only ``suspected`` and ``pending`` are released; a ``resolved`` link sweeps
    the rule allocations of its legs. Changed transactions carry
    ``counterparty_account_id``; a group is numbered by its smaller leg.
    """
    accounts = transactions.select("id", "account_id")
    group = F.least("leg", "partner")
    ends = pairs.select(F.col("leg").alias("id"), F.col("partner").alias("other"), "status", group.alias("new_group")).unionByName(pairs.select(F.col("partner").alias("id"), F.col("leg").alias("other"), "status", group.alias("new_group")))
    ends = ends.join(accounts.select(F.col("id").alias("other"), F.col("account_id").alias("new_account")), "other")
    weak = transactions.where("transfer_status in ('suspected', 'pending')").join(ends.select("id"), "id", "left_semi")
    groups = weak.where("transfer_group_id is not null").select("transfer_group_id").distinct()
    released = transactions.join(groups, "transfer_group_id", "left_semi").select("id").unionByName(weak.select("id")).distinct()
    touched = released.join(ends, "id", "full").join(transactions, "id")
    renewed = {"transfer_status": F.col("status"), "transfer_group_id": F.col("new_group")}
    fresh = touched.select(*(renewed[c].alias(c) if c in renewed else F.col(c) for c in transactions.columns), F.col("new_account").alias("counterparty_account_id"))
    old = touched.select(*transactions.columns, F.lit(None).cast("long").alias("counterparty_account_id"))
    swept = allocations.where("source = 'rule'").join(ends.where("status = 'resolved'").select(F.col("id").alias("transaction_id")), "transaction_id", "left_semi").select(*allocations.columns)
    return ChangeSet(fresh, old), ChangeSet(allocations.where("false"), swept)


def with_counterparts(linked: DataFrame, accounts: DataFrame) -> DataFrame:
    """Linked rows with the names of their account and of their counterpart's, if they have one."""
    own = accounts.select(F.col("id").alias("account_id"), F.col("name").alias("account_name"))
    other = accounts.select(F.col("id").alias("counterparty_account_id"), F.col("name").alias("counterparty_name"))
    return linked.join(own, "account_id").join(other, "counterparty_account_id", "left")


def store_artifacts(stored: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Content-addressed storage: the rows to insert, and ``incoming`` with the id that holds its bytes.

    ``stored``: id, content_hash. ``incoming``: id, bytes. A hash that is stored,
    or came in with a smaller id, makes a row a duplicate.
    """
    hashed = incoming.withColumn("content_hash", F.sha2("bytes", 256)).withColumn("byte_size", F.length("bytes").cast("long"))
    first = hashed.groupBy("content_hash").agg(F.min("id").alias("first_id"))
    known = stored.groupBy("content_hash").agg(F.min("id").alias("known_id"))
    rows = hashed.join(first, "content_hash").join(known, "content_hash", "left")
    holder = F.coalesce("known_id", "first_id")
    told = rows.select("id", "content_hash", "byte_size", holder.alias("stored_id"), (F.col("known_id").isNotNull() | (F.col("id") != F.col("first_id"))).alias("duplicate"))
    return rows.where("known_id is null and id = first_id").select("id", "content_hash", "byte_size", "bytes"), told


def import_errors(rows: DataFrame) -> DataFrame:
    """``row, errors`` of raw import rows (strings): amount, date, type and stated balance, each checked."""
    amount, balance = F.col("amount_paise"), F.col("bank_balance_paise")
    whole = r"^[+-]?[0-9]{1,18}$"
    errors = F.array(
        F.when(~F.coalesce(amount.rlike(whole), F.lit(False)), "amount_not_whole").when(amount.try_cast("long") == 0, "amount_zero"),
        F.when(F.try_to_timestamp("txn_date", F.lit("yyyy-MM-dd")).isNull(), "bad_date"),
        F.when(~F.coalesce(F.col("type").isin(*IMPORT_TYPES), F.lit(False)), "bad_type"),
        F.when(balance.isNotNull() & ~balance.rlike(whole), "balance_not_whole"),
    )
    return rows.select("row", F.array_join(F.array_compact(errors), ",").alias("errors")).where("errors <> ''")


def display_names(evidence: DataFrame, lines: DataFrame) -> DataFrame:
    """``evidence_id, short, full``: the first goods line and how many more; the names without what follows ``|``, ``(`` or a line's end.

    ``lines``: evidence_id, line_index, kind, description.
    """
    name = F.trim(F.split_part(F.regexp_replace("description", r"[(\n]", "|"), F.lit("|"), F.lit(1)))
    goods = lines.where("kind <> 'fee' and description is not null").groupBy("evidence_id").agg(F.array_sort(F.collect_list(F.struct("line_index", name.alias("name")))).alias("all"))
    rows = evidence.select(F.col("id").alias("evidence_id"), "source_type", "external_ref").join(goods, "evidence_id", "left")
    names, size = F.col("all.name"), F.coalesce(F.size("all"), F.lit(0))
    order = F.trim(F.concat_ws(" ", "source_type", F.lit("order"), F.coalesce("external_ref", F.lit(""))))
    short = F.when(F.col("all").isNull(), order).when(size == 1, names[0]).otherwise(F.concat(names[0], F.lit(" + "), (size - 1).cast("string"), F.lit(" more")))
    return rows.select("evidence_id", short.alias("short"), F.array_join(names, "\n").alias("full"))


def tree_order(categories: DataFrame) -> DataFrame:
    """Categories with their parent's name in tree order: each parent, then its children by name."""
    parents = categories.select(F.col("id").alias("parent_id"), F.col("name").alias("parent"))
    return categories.join(parents, "parent_id", "left").orderBy(F.coalesce("parent", "name"), F.col("parent").asc_nulls_first(), "name", "id")


def sku_conflicts(lines: DataFrame, aliases: DataFrame) -> DataFrame:
    """``lines`` (item_id, source_type, sku) with ``conflicting_sku``: the item already has another sku of that source."""
    seen = aliases.where("alias_kind = 'sku'").groupBy("item_id", "source_type").agg(F.min("alias_value").alias("lo"), F.max("alias_value").alias("hi"))
    other = F.col("lo").isNotNull() & F.col("sku").isNotNull() & ~((F.col("lo") == F.col("sku")) & (F.col("hi") == F.col("sku")))
    return lines.join(seen, ["item_id", "source_type"], "left").select(*lines.columns, other.alias("conflicting_sku"))


def proposals_named(proposals: DataFrame, items: DataFrame) -> DataFrame:
    """Merge proposals (lo_item_id, hi_item_id) with both labels."""
    sides = [items.select(F.col("id").alias(f"{side}_item_id"), F.col("label").alias(f"{side}_label")) for side in ("lo", "hi")]
    return proposals.join(sides[0], "lo_item_id").join(sides[1], "hi_item_id")


def selection_tally(picked: DataFrame, claims: DataFrame) -> DataFrame:
    """One row: how many rows are picked, their absolute sum, and how many have each claim label."""
    rows = picked.join(claims, "id")
    labels = ("free", "yours", "replaces", "refused")
    return rows.agg(F.count("*").alias("picked"), F.coalesce(F.sum(F.abs("amount_paise")), F.lit(0)).alias("picked_paise"), *(F.count(F.when(F.col("claim") == c, 1)).alias(c) for c in labels))


def most_seen(items: DataFrame, lines: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` items seen most often; later ids first among equals."""
    seen = lines.where("item_id is not null").groupBy(F.col("item_id").alias("id")).agg(F.count("*").alias("times_seen"))
    return items.join(seen, "id", "left").na.fill(0, ["times_seen"]).orderBy(F.desc("times_seen"), F.desc("id")).limit(limit)


def replace_mapping(consumption: DataFrame, expenses: DataFrame, word: str, category_id: int | None) -> ChangeSet:
    """Consumption anew for one source word: its old rows go; rows of the new category come, if there is one.

    ``expenses``: consumption columns without a category, and ``word``.
    """
    own = expenses.where((F.col("word") == word) & (F.col("amount_paise") != 0))
    gone = consumption.join(own.select("evidence_id"), "evidence_id", "left_semi").select(*consumption.columns)
    fresh = own.where(F.lit(category_id is not None)).withColumn("category_id", F.lit(category_id).cast("long")).select(*consumption.columns)
    return ChangeSet(fresh, gone)
