"""The product catalogue: lines resolved by alias, then by trigram similarity."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import canonical_name, similarity, trigrams, variant_difference
from ledgerloom.operators.changes import next_ids
from ledgerloom.operators.graph import components
from ledgerloom.session import checkpointed, held

LINK, PROPOSE, CANDIDATES = 88, 55, 5
#: Pairs below this are no candidates at all.
LEAST_SIMILARITY = 30
#: Lines of a part, about.
PART_LINES = 250_000
#: Names of a part, about, that are compared with the catalogue.
PART_NAMES = 250
#: Merged items that may be sent to every task.
FEW_MOVES = 10_000


def canon_index(items: DataFrame) -> DataFrame:
    """``item_id, canon, grams``."""
    return items.select(F.col("id").alias("item_id"), canonical_name(F.col("label")).alias("canon")).withColumn("grams", trigrams(F.col("canon")))


def similar(left: DataFrame, right: DataFrame) -> DataFrame:
    """``left, right, similarity`` of all texts of two frames (``canon, grams``) at LEAST_SIMILARITY hundredths or more.

    Two texts meet on a prefix of their trigrams in order of rarity, long enough that every such pair meets.
    """
    # Parts by the number of texts: the few bytes of a text say nothing of its many pairs.
    parts = max(left.sparkSession.sparkContext.defaultParallelism, math.ceil(left.count() / PART_NAMES))
    counts = right.select(F.explode("grams").alias("g")).groupBy("g").agg(F.count("*").alias("df"))
    meet = _prefix(left, counts, "left", parts).join(_prefix(right, counts, "right"), "g").select("left", "right").distinct()
    a = left.select(F.col("canon").alias("left"), F.col("grams").alias("x"))
    b = right.select(F.col("canon").alias("right"), F.col("grams").alias("y"))
    return meet.join(a, "left").join(b, "right").withColumn("similarity", similarity(F.col("x"), F.col("y"))).where(F.col("similarity") >= LEAST_SIMILARITY).select("left", "right", "similarity")


def candidates(wanted: DataFrame, items: DataFrame) -> DataFrame:
    """The best items for each distinct name: ``name, item_id, similarity, place``.

    Names are compared once however many lines bear them, and names and items as
    classes of equal canonical forms, so a common product is one row here.
    """
    named = held(wanted.select("name").distinct().withColumn("canon", canonical_name(F.col("name"))))
    left = named.select("canon").distinct().withColumn("grams", trigrams(F.col("canon")))
    # The first items of a class are among the first of its labels, and the best items among those of the best classes.
    index = held(canon_index(_first(items.select("id", "label"), "label", "id")))
    scored = similar(left, index.select("canon", "grams").distinct())
    order = Window.partitionBy("left").orderBy(F.desc("similarity"), "item_id")
    best_items = _first(index.select(F.col("canon").alias("right"), "item_id"), "right", "item_id")
    classes = scored.join(best_items.groupBy("right").agg(F.min("item_id").alias("item_id")), "right").withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= CANDIDATES).select("left", "right", "similarity")
    top = classes.join(best_items, "right").withColumn("place", F.row_number().over(order)).where(F.col("place") <= CANDIDATES)
    return named.join(top.withColumnRenamed("left", "canon"), "canon").select("name", "item_id", "similarity", "place")


def _first(rows: DataFrame, by: str, order: str) -> DataFrame:
    """The first CANDIDATES rows of each ``by``."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("_k") <= CANDIDATES).drop("_k")


def _prefix(rows: DataFrame, counts: DataFrame, name: str, parts: int | None = None) -> DataFrame:
    """The rarest trigrams of each canon: all but as many as any good partner must share, and one."""
    each = rows.select(F.col("canon").alias(name), F.size("grams").alias("n"), F.explode("grams").alias("g")).join(counts, "g", "left")
    if parts:
        each = each.repartition(parts, name)
    place = F.row_number().over(Window.partitionBy(name).orderBy(F.coalesce("df", F.lit(0)), "g"))
    # half a hundredth may have been rounded up
    needed = F.ceil(F.col("n") * (LEAST_SIMILARITY - 0.5) / 100)
    return each.withColumn("place", place).where(F.col("place") <= F.col("n") - needed + 1).select(name, "g")


def by_alias(lines: DataFrame, aliases: DataFrame) -> DataFrame:
    """``lines`` (line_id, source_type, sku, name) with ``alias_item`` and ``via``: the SKU's item, else the canonical name's."""
    known = {k: aliases.where(F.col("alias_kind") == k).select("source_type", F.col("alias_value").alias(c), F.col("item_id").alias(f"_{k}")).hint("merge") for k, c in (("sku", "sku"), ("name", "canon"))}
    rows = lines.withColumn("canon", canonical_name(F.col("name"))).join(known["sku"], ["source_type", "sku"], "left").join(known["name"], ["source_type", "canon"], "left")
    via = F.when(F.col("_sku").isNotNull(), "sku").when(F.col("_name").isNotNull(), "name")
    return rows.withColumn("alias_item", F.coalesce("_sku", "_name")).withColumn("via", via).drop("_sku", "_name", "canon")


def resolve(lines: DataFrame, aliases: DataFrame, items: DataFrame) -> DataFrame:
    """``line_id, decision, item_id, confidence``: by alias (SKU, then name), by one strong name, a proposal, or a new item.

    ``lines``: line_id, source_type, sku, name. A candidate that already has a SKU of the line's
    source is another variant at best (its own SKU would have been an alias): it is strong
    only if the two names differ as variants of one product do. Exactly one strong candidate links; two say that the
    catalogue repeats itself. ``confidence``: 100 for an alias or without a near name, the similarity of a
    link, and what the nearest proposal leaves of 100. Lines that print the same are decided
    once; neither they nor the catalogue go through the driver.
    """
    printed = ["source_type", "sku", "name"]
    rows = by_alias(held(lines.select(*printed).distinct()), aliases)
    open_ = held(rows.where("alias_item is null").select("name", "source_type").distinct())
    sold = aliases.where("alias_kind = 'sku'").select("source_type", "item_id").distinct().withColumn("sold", F.lit(True))
    near = candidates(open_, items).join(open_, "name").join(sold.hint("merge"), ["source_type", "item_id"], "left")
    near = near.join(items.select(F.col("id").alias("item_id"), "label").hint("merge"), "item_id")
    variant = variant_difference(canonical_name(F.col("name")), canonical_name(F.col("label")))["same_product"]
    strong = (F.col("similarity") >= LINK) & (F.col("sold").isNull() | variant)
    best = near.groupBy("name", "source_type").agg(
        F.count(F.when(strong, 1)).alias("strong"), F.min_by(F.when(strong, F.struct("item_id", "similarity")), F.when(strong, F.col("place"))).alias("one"),
        F.max("similarity").alias("top"), F.min_by("item_id", "place").alias("top_item"),
    )
    out = rows.join(best, ["name", "source_type"], "left")
    old, link, near_name = F.col("alias_item").isNotNull(), F.col("strong") == 1, F.col("top") >= PROPOSE
    decision = F.when(old, "existing").when(link, "link").when(near_name, "create_and_propose").otherwise("create")
    item = F.when(old, F.col("alias_item")).when(link, F.col("one.item_id")).when(near_name, F.col("top_item"))
    confidence = F.when(old, 100).when(link, F.col("one.similarity")).when(near_name, 100 - F.col("top")).otherwise(100)
    decided = out.select(*(F.col(c).alias(f"_{c}") for c in printed), decision.alias("decision"), item.alias("item_id"), confidence.cast("int").alias("confidence"))
    same = F.lit(True)
    for c in printed:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    return lines.select("line_id", *printed).join(decided.hint("merge"), same, "left").select("line_id", "decision", "item_id", "confidence")


def record_sightings(lines: DataFrame, aliases: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New items (``id, label``), new aliases, and ``line_id, item_id`` for lines that land together.

    Lines that resolve to nothing known make one new item for each canonical
    name of a source; a line follows the name under which its SKU came first (by
    line_id). New items of one batch are compared with the catalogue, not with
    each other. A line whose name has no letter or digit gets no item. An alias
    that is taken stays where it points; of two lines the first by id gives it.
    """
    rows = lines.withColumn("canon", canonical_name(F.col("name"))).where("canon <> ''")
    found = rows.join(resolve(rows.select("line_id", "source_type", "sku", "name"), aliases, items), "line_id")
    old = F.col("decision").isin("existing", "link")
    fresh = found.where(~old)
    leads = fresh.where("sku is not null").groupBy("source_type", "sku").agg(F.min_by("canon", "line_id").alias("lead"))
    fresh = fresh.join(leads, ["source_type", "sku"], "left").withColumn("lead", F.coalesce("lead", "canon"))
    made = fresh.groupBy("source_type", "lead").agg(F.min(F.struct("line_id", F.trim("name").alias("label"))).alias("first"))
    made = next_ids(items.select("id"), made.select("source_type", "lead", "first.line_id", "first.label"), [F.col("line_id")])
    placed = fresh.join(made.select("source_type", "lead", "id"), ["source_type", "lead"]).select("line_id", F.col("id").alias("item_id"))
    placed = found.where(old).select("line_id", "item_id").unionByName(placed)
    named = rows.join(placed, "line_id")
    stack = F.explode(F.array(*(F.struct(F.lit(k).alias("alias_kind"), F.col(c).alias("alias_value")) for k, c in (("sku", "sku"), ("name", "canon"))))).alias("a")
    key = ["source_type", "alias_kind", "alias_value"]
    given = named.select("line_id", "item_id", "source_type", stack).select("line_id", "item_id", "source_type", "a.*").where("alias_value is not null")
    given = given.groupBy(*key).agg(F.min_by("item_id", "line_id").alias("item_id")).join(aliases.select(*key), key, "left_anti")
    return made.select("id", "label"), given, placed


def item_stats(items: DataFrame, lines: DataFrame, aliases: DataFrame) -> DataFrame:
    """``times_seen`` and ``aliases`` of each item."""
    seen = lines.where("item_id is not null").groupBy(F.col("item_id").alias("id")).agg(F.count("*").alias("times_seen"), F.sum("amount_paise").alias("spent_paise"))
    known = aliases.groupBy(F.col("item_id").alias("id")).agg(F.count("*").alias("aliases"))
    return items.join(seen, "id", "left").join(known, "id", "left").fillna(0, ["times_seen", "spent_paise", "aliases"]).select("id", "category_id", "times_seen", "spent_paise", "aliases")


def staged_products(lines: DataFrame, items: DataFrame) -> DataFrame:
    """Goods lines grouped by product: how often, for how much, in which orders (the first eight)."""
    # Parts by the number of lines, and no text beside them: what a task sorts does not grow with the table.
    goods = lines.where("kind = 'goods'").select("item_id", "evidence_id", "amount_paise")
    parts = max(lines.sparkSession.sparkContext.defaultParallelism, math.ceil(goods.count() / PART_LINES))
    labels = items.groupBy(F.col("id").alias("item_id")).agg(F.max("label").alias("label"))
    rows = goods.repartition(parts, "item_id").join(items.select(F.col("id").alias("item_id")), "item_id")
    each = rows.groupBy("item_id", "evidence_id").agg(F.count("*").alias("lines"), F.sum("amount_paise").alias("amount_paise"))
    first = each.select("item_id", "evidence_id").withColumn("_n", F.row_number().over(Window.partitionBy("item_id").orderBy("evidence_id"))).where("_n <= 8")
    some = first.groupBy("item_id").agg(F.array_join(F.sort_array(F.collect_list("evidence_id")), ",").alias("orders"))
    return each.groupBy("item_id").agg(F.sum("lines").alias("lines"), F.sum("amount_paise").alias("amount_paise"), F.count("evidence_id").alias("in_orders")).join(some, "item_id").join(labels, "item_id").select("item_id", "label", "lines", "amount_paise", "in_orders", "orders")


def merge_many(pairs: DataFrame, items: DataFrame, aliases: DataFrame, lines: DataFrame, proposals: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Items, aliases, lines and proposals after all merges of ``pairs`` (``keep, drop``) at once.

    Pairs form groups, so chains and cycles end in one item: the group's smallest
    that is kept by some pair and dropped by none, or else its smallest. The keeper
    takes a category only if it has none (that of its first merged item that has one); of aliases that now
    coincide the keeper's stays, or the first by item; lines follow; proposals
    between two items of a group, or of a merged item, are gone. Unknown items
    and an item with itself are an error.
    """
    known = items.select("id")
    asked = pairs.select(F.col("keep").cast("long"), F.col("drop").cast("long")).distinct()
    wrong = asked.where("keep = drop").select("keep").unionByName(asked.select(F.explode(F.array("keep", "drop")).alias("keep")).join(known.withColumnRenamed("id", "keep"), "keep", "left_anti"))
    if not wrong.isEmpty():
        raise ValueError("merges need two different items that exist")
    groups = components(asked, "keep", "drop")
    roles = groups.join(asked.select(F.col("drop").alias("node"), F.lit(True).alias("dropped")).distinct(), "node", "left")
    ends = roles.groupBy("component").agg(F.coalesce(F.min(F.when(F.col("dropped").isNull(), F.col("node"))), F.min("node")).alias("keeper"))
    moves = groups.join(ends, "component").where("node <> keeper").select(F.col("node").alias("item"), "keeper")

    moves = checkpointed(moves)
    # Few moves go to every task; many, as a catalogue's size allows, do not go through the driver.
    moves = moves.hint("broadcast" if moves.count() <= FEW_MOVES else "merge")

    def follow(rows: DataFrame, column: str) -> DataFrame:
        """``rows`` with ``_to``; those without an item stay out of the join, where they would meet in one task."""
        to = moves.select(F.col("item").alias(column), F.col("keeper").alias("_to"))
        return rows.where(F.col(column).isNotNull()).join(to, column, "left").unionByName(rows.where(F.col(column).isNull()).withColumn("_to", F.lit(None).cast("long")))

    adopted = items.join(moves, items["id"] == moves["item"]).where("category_id is not null").groupBy("keeper").agg(F.min_by("category_id", "id").alias("_category"))
    kept = items.join(moves.select(F.col("item").alias("id")), "id", "left_anti").join(adopted.withColumnRenamed("keeper", "id"), "id", "left")
    kept = kept.withColumn("category_id", F.coalesce("category_id", "_category")).select(*items.columns)

    key = ["source_type", "alias_kind", "alias_value"]
    moved = follow(aliases, "item_id").withColumn("_old", F.col("item_id")).withColumn("item_id", F.coalesce("_to", "item_id"))
    first = F.row_number().over(Window.partitionBy(*key, "item_id").orderBy(F.col("_to").isNotNull(), "_old"))
    moved = moved.withColumn("_n", first).where("_n = 1").select(*aliases.columns)
    placed = follow(lines, "item_id").withColumn("item_id", F.coalesce("_to", "item_id")).select(*lines.columns)
    gone = moves.select("item")
    asking = proposals.join(gone.withColumnRenamed("item", "lo_item_id"), "lo_item_id", "left_anti").join(gone.withColumnRenamed("item", "hi_item_id"), "hi_item_id", "left_anti")
    return kept, moved, placed, asking.select(*proposals.columns)


def set_categories(items: DataFrame, chosen: DataFrame) -> DataFrame:
    """``items`` with the categories of ``chosen`` (``id, category_id``; null clears), the last of repeated ids by category winning."""
    wanted = chosen.groupBy("id").agg(F.max(F.struct("category_id")).alias("_c"))
    return items.join(wanted, "id", "left").withColumn("category_id", F.when(F.col("_c").isNotNull(), F.col("_c.category_id")).otherwise(F.col("category_id"))).select(*items.columns)
