"""The rule language compiled to columns, and the converging application of rules."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import normalise
from ledgerloom.operators.changes import ChangeSet
from ledgerloom.session import held

#: Operators by field, and the kind of value they take.
VOCABULARY = {"narration": (("contains", "equals"), "string"), "amount_paise": (("equals", "lt", "gt"), "number"), "txn_date": (("equals", "lt", "gt"), "string")}


@dataclass(frozen=True)
class Condition:
    field: str
    op: str
    value: str | int

    def column(self, normal: Column | None = None) -> Column:
        """True where it holds; anything it does not know matches nothing. ``normal``: a column with the normal narration, if there is one."""
        ops, kind = VOCABULARY.get(self.field, ((), ""))
        number = isinstance(self.value, int) and not isinstance(self.value, bool)
        if self.op not in ops or number != (kind == "number"):
            return F.lit(False)
        if self.field == "narration":
            needle = _normal(self.value)
            if not needle:
                return F.lit(False)
            text = normalise(F.col("narration")) if normal is None else normal
            return text.contains(needle) if self.op == "contains" else text == needle
        value = F.lit(self.value) if number else F.lit(self.value).try_cast("date")
        column = F.col(self.field)
        test = {"equals": column == value, "lt": column < value, "gt": column > value}[self.op]
        return F.coalesce(test, F.lit(False))


def _normal(text: str) -> str:
    import re

    out = re.sub(r"[0-9]{6,}", " ", re.sub(r"[-/*_.:,#|]+", " ", text.lower()))
    return re.sub(r"\s+", " ", out).strip()


@dataclass(frozen=True)
class Rule:
    id: int
    name: str
    conditions: tuple[Condition, ...]
    mode: str = "all"
    category_id: int | None = None
    priority: int = 0
    enabled: bool = True

    def __post_init__(self):
        if self.mode not in ("all", "any"):
            raise ValueError("mode must be 'all' or 'any'")

    def column(self, normal: Column | None = None) -> Column:
        tests = [c.column(normal) for c in self.conditions]
        if not tests:
            return F.lit(False)
        return reduce(lambda a, b: a & b if self.mode == "all" else a | b, tests)

    def order(self) -> tuple[int, int, int]:
        """Priority first, then the more specific, then the older."""
        return (-self.priority, -(len(self.conditions) if self.mode == "all" else 1), self.id)


def rule_of(row: tuple) -> Rule:
    """A rule from ``(id, name, ((field, op, value, kind), ...), mode, category, priority, enabled)``."""
    i, name, conditions, mode, category, priority, enabled = row
    return Rule(i, name, tuple(Condition(f, o, int(v) if k == "number" else v) for f, o, v, k in conditions), mode, category, priority, enabled)


def condition_problems(rules: DataFrame) -> DataFrame:
    """``id, place, problem`` of the first bad condition of each rule (``id, conditions`` as JSON text); good rules give no row.

    ``place`` is null if the conditions as a whole are wrong: no list, or an empty
    one, which would match every row. Amounts are whole numbers, narrations are not blank, dates real.
    """
    records = F.try_variant_get(F.try_parse_json(F.col("conditions")), "$", "array<variant>")
    rows = rules.select("id", records.alias("all"))
    whole = F.when(F.col("all").isNull(), "not_a_list").when(F.size("all") == 0, "empty")
    each = rows.select("id", F.posexplode("all").alias("place", "c"))
    text = lambda key: F.when(F.schema_of_variant(F.try_variant_get("c", f"$.{key}", "variant")) == "STRING", F.try_variant_get("c", f"$.{key}", "string"))
    kind = F.coalesce(F.schema_of_variant(F.try_variant_get("c", "$.value", "variant")), F.lit("VOID"))
    field, op, value = text("field"), text("op"), text("value")
    known, ops, kinds = F.lit(False), F.lit(False), F.lit(False)
    for name, (allowed, _) in VOCABULARY.items():
        known, ops = known | field.eqNullSafe(name), ops | (field.eqNullSafe(name) & op.isin(*allowed))
    date = F.coalesce(value.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.try_to_date(value, "yyyy-MM-dd").isNotNull(), F.lit(False))
    number = F.try_variant_get("c", "$.value", "double")
    whole_number = (kind == "BIGINT") | (kind.startswith("DECIMAL") | (kind == "DOUBLE")) & (number == F.floor(number))
    kinds = F.when(field == "narration", F.coalesce(F.trim(value) != "", F.lit(False))).when(field == "amount_paise", whole_number).otherwise(date)
    every_op = sorted({o for allowed, _ in VOCABULARY.values() for o in allowed})
    problem = (
        F.when(~F.schema_of_variant("c").startswith("OBJECT"), "not_an_object").when(~known, "unknown_field").when(~F.coalesce(op.isin(*every_op), F.lit(False)), "unknown_op").when(~F.coalesce(ops, F.lit(False)), "op_not_for_field").when(~kinds, "bad_value")
    )
    first = each.withColumn("problem", problem).where("problem is not null").groupBy("id").agg(F.min(F.struct("place", "problem")).alias("p"))
    return rows.where(whole.isNotNull()).select("id", F.lit(None).cast("int").alias("place"), whole.alias("problem")).unionByName(first.select("id", "p.place", "p.problem"))


def winner(rules: list[Rule], normal: Column | None = None) -> Column:
    """The winning enabled rule's id as one ordered CASE; null if none matches."""
    out = F.lit(None)
    for rule in sorted((r for r in rules if r.enabled), key=Rule.order, reverse=True):
        out = F.when(rule.column(normal), F.lit(rule.id)).otherwise(out)
    return out.cast("long")


def state(txns: DataFrame, allocations: DataFrame) -> DataFrame:
    """``txns`` with what their allocations amount to: locked, kept by others than rules, rule rows."""
    per = allocations.groupBy(F.col("transaction_id").alias("id")).agg(
        F.max((F.col("source") == "user").cast("int")).alias("_user"), F.sum(F.when(F.col("source") != "rule", F.col("amount_paise")).otherwise(0)).alias("_kept"),
        F.count(F.when(F.col("source") == "rule", 1)).alias("rule_rows"),
        F.max(F.when(F.col("source") == "rule", F.struct("category_id", "amount_paise", "rule_id"))).alias("_rule"),
    )
    rows = txns.join(per, "id", "left")
    return rows.select(*txns.columns, (F.coalesce("_user", F.lit(0)) == 1).alias("locked"), (F.col("amount_paise") - F.coalesce("_kept", F.lit(0))).alias("remainder"), F.coalesce("rule_rows", F.lit(0)).alias("rule_rows"), F.col("_rule").alias("rule_row"))


def outcome(txns: DataFrame, allocations: DataFrame, rules: list[Rule]) -> DataFrame:
    """What a run would do to each transaction: locked, unchanged, create, replace, remove or none."""
    usable = [r for r in rules if r.category_id is not None]
    # The narration is made normal once a row, however many conditions read it.
    rows = state(txns, allocations).withColumn("_normal", normalise(F.col("narration"))).withColumn("rule_id", winner(usable, F.col("_normal"))).drop("_normal")
    category = F.coalesce(F.lit(None).cast("long"), *(F.when(F.col("rule_id") == r.id, F.lit(r.category_id).cast("long")) for r in usable))
    rows = rows.withColumn("category_id", category)
    wanted = F.col("rule_id").isNotNull() & (F.col("remainder") != 0)
    same = (F.col("rule_rows") == 1) & F.col("rule_row").eqNullSafe(F.struct("category_id", F.col("remainder").alias("amount_paise"), "rule_id"))
    action = F.when(F.col("locked"), "locked").when(wanted & same, "unchanged").when(wanted & (F.col("rule_rows") > 0), "replace").when(wanted, "create").when(F.col("rule_rows") > 0, "remove").otherwise("none")
    return rows.withColumn("action", action)


def apply_rules(txns: DataFrame, allocations: DataFrame, rules: list[Rule]) -> ChangeSet:
    """Bring the rule allocations of ``txns`` in line with the rules; a second run changes nothing.

    Inserted rows have no id yet; see ``changes.next_ids``. Outcomes are held, since both parts read them, and a filter
    on the action would otherwise be pushed to the rows and repeat the rules' expressions there.
    """
    rows = held(outcome(txns, allocations, rules).select("id", "remainder", "category_id", "rule_id", "action"))
    none = F.lit(None).cast("long")
    inserts = rows.where("action in ('create', 'replace')").select(
        none.alias("id"), F.col("id").alias("transaction_id"), F.col("remainder").alias("amount_paise"), "category_id", F.lit("0.80").cast("decimal(3,2)").alias("confidence"), F.lit("rule").alias("source"), "rule_id",
        none.alias("evidence_id"), none.alias("confirmed_from_rule_id"),
    )
    changed = rows.where("action in ('replace', 'remove')").select(F.col("id").alias("transaction_id"))
    return ChangeSet(inserts, allocations.where("source = 'rule'").join(changed, "transaction_id", "left_semi"))


def preview(txns: DataFrame, allocations: DataFrame, rule: Rule) -> DataFrame:
    """What an unsaved rule matches: ``user_locked`` and whether it ``would_explain``."""
    rows = state(txns, allocations).where(rule.column())
    return rows.select("id", "amount_paise", F.col("locked").alias("user_locked"), ((F.col("remainder") != 0)).alias("would_explain"))


def confirm(allocations: DataFrame, ids: DataFrame) -> DataFrame:
    """Rule allocations of the given transactions become the user's own."""
    chosen = ids.select(F.col("id").alias("transaction_id"), F.lit(True).alias("_chosen"))
    rows = allocations.join(chosen, "transaction_id", "left")
    hit = F.coalesce("_chosen", F.lit(False)) & (F.col("source") == "rule")
    fresh = {
        "source": F.when(hit, "user").otherwise(F.col("source")), "confidence": F.when(hit, F.lit("1.00").cast("decimal(3,2)")).otherwise(F.col("confidence")),
        "confirmed_from_rule_id": F.when(hit, F.col("rule_id")).otherwise(F.col("confirmed_from_rule_id")), "rule_id": F.when(~hit, F.col("rule_id")),
    }
    return rows.select(*(fresh[c].alias(c) if c in fresh else F.col(c) for c in allocations.columns))


def valid_manual(requested: DataFrame, txns: DataFrame) -> DataFrame:
    """``transaction_id, ok``: same sign as the transaction, none zero, and not more than it in all."""
    rows = requested.join(txns.select(F.col("id").alias("transaction_id"), F.col("amount_paise").alias("whole")), "transaction_id")
    fits = F.sum(F.abs("amount_paise")) <= F.first(F.abs("whole"))
    signs = F.min(((F.signum("amount_paise") == F.signum("whole")) & (F.col("amount_paise") != 0)).cast("int")) == 1
    return rows.groupBy("transaction_id").agg((fits & signs).alias("ok"))


def replace_manual(requested: DataFrame, txns: DataFrame, categories: DataFrame, allocations: DataFrame) -> tuple[DataFrame, ChangeSet]:
    """Hand-made allocations that replace all others of their transactions: ``transaction_id, verdict, unexplained_paise``, and the change set.

    ``requested``: transaction_id, amount_paise, category_id. A transaction is written as a whole or not at all: amounts are not
    zero and have its sign, categories exist, and the sum is at most its amount.
    """
    rows = requested.join(txns.select(F.col("id").alias("transaction_id"), F.col("amount_paise").alias("whole")), "transaction_id", "left")
    rows = rows.join(categories.select(F.col("id").alias("category_id"), F.lit(True).alias("known")), "category_id", "left")
    some = lambda test: F.max(F.coalesce(test, F.lit(False)).cast("int")) == 1
    judged = rows.groupBy("transaction_id").agg(
        F.max("whole").alias("whole"), F.coalesce(F.sum("amount_paise"), F.lit(0)).alias("total"), some(F.col("amount_paise").isNull() | (F.col("amount_paise") == 0)).alias("empty"),
        some(F.col("category_id").isNull()).alias("uncategorised"), some(F.col("known").isNull()).alias("strange"), some(F.signum("amount_paise") != F.signum("whole")).alias("turned"),
    )
    verdict = (
        F.when(F.col("empty"), "bad_amount").when(F.col("uncategorised"), "no_category").when(F.col("whole").isNull(), "no_such_transaction").when(F.col("strange"), "no_such_category").when(F.col("turned"), "other_sign")
        .when(F.abs("total") > F.abs("whole"), "too_much").otherwise("ok")
    )
    judged = judged.withColumn("verdict", verdict)
    good = judged.where("verdict = 'ok'").select("transaction_id")
    written = requested.join(good, "transaction_id", "left_semi").select("transaction_id", "amount_paise", "category_id")
    given = {"confidence": F.lit("1.00"), "source": F.lit("user"), **{c: F.col(c) for c in written.columns}}
    inserts = written.select(*(given.get(c, F.lit(None)).cast(t).alias(c) for c, t in allocations.dtypes))
    gone = allocations.join(good, "transaction_id", "left_semi").select(*allocations.columns)
    return judged.select("transaction_id", "verdict", F.when(F.col("verdict") == "ok", F.col("whole") - F.col("total")).alias("unexplained_paise")), ChangeSet(inserts, gone)
