"""Shared-expense exports: files to checked rows, balances, errors and warnings.

A file with any error gives no rows. Files are independent of each other and are
what the work is dealt by; a file is one row until its lines are apart.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import to_paise
from ledgerloom.sources.quoted import rows_of, stripped

#: The columns before the persons', the word of settlements, and the footer's description.
COLUMNS = ("Date", "Description", "Category", "Cost", "Currency")
PAYMENT, FOOTER = "payment", "total balance"


@dataclass(frozen=True)
class Exports:
    """``rows``: file, seq, line, date, description, category, currency, cost_paise, nets (person to paise), net_paise, kind.

    ``balances``: file, person, balance_paise. ``errors`` and ``warnings``: file, line (null: the file), what, who.
    """

    rows: DataFrame
    balances: DataFrame
    errors: DataFrame
    warnings: DataFrame


def read_exports(spark: SparkSession, path: str, me: str) -> Exports:
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return parse_exports(files, me)


def _first_problem(checks: list[tuple[str, Column]]) -> Column:
    out = F.lit(None).cast("string")
    for name, wrong in reversed(checks):
        out = F.when(F.coalesce(wrong, F.lit(True)), name).otherwise(out)
    return out


def parse_exports(files: DataFrame, me: str) -> Exports:
    """``files``: file, value (the text). ``me``: the owner's person column, by its exact name.

    A file is refused as a whole if a quote stays open, it is empty, its first
    columns are others, it has no persons, one twice, or not the owner. A row is
    refused for the first of: another number of columns, a date that is none, no
    currency, a cost that is no positive amount, a share that is no amount, shares that
    do not cancel out (to a paisa a person), a share over the cost. Blank cells keep
    their place; persons may be any number.
    """
    cut = files.select("file", rows_of(F.col("value")).alias("rows"))
    every = cut.select("file", F.posexplode_outer("rows").alias("at", "cells")).select("file", (F.col("at") + 1).alias("line"), F.transform("cells", stripped).alias("cells"))
    lines = every.where(F.exists("cells", lambda c: c != ""))
    heads = lines.groupBy("file").agg(F.min_by("cells", "line").alias("head"), F.min("line").alias("head_line"), F.max("line").alias("last_line"))
    people = F.filter(F.slice("head", len(COLUMNS) + 1, F.greatest(F.size("head"), F.lit(1))), lambda p: p != "")
    heads = heads.withColumn("people", people)
    own = cut.select("file", F.col("rows").isNull().alias("open")).join(heads, "file", "left")
    repeated = F.size("people") != F.size(F.array_distinct("people"))
    problem = F.when(F.col("open"), "truncated").when(F.col("head").isNull(), "empty")
    problem = problem.when(~F.slice("head", 1, len(COLUMNS)).eqNullSafe(F.array(*map(F.lit, COLUMNS))), "other_columns").when(F.size("people") == 0, "no_people").when(repeated, "person_twice")
    own = own.withColumn("what", problem.when(~F.array_contains("people", me.strip()), "owner_missing"))
    files_wrong = own.where("what is not null").select("file", F.lit(None).cast("int").alias("line"), "what", F.lit(None).cast("string").alias("who"))

    able = own.where("what is null").select("file", "head", "people", "head_line", "last_line")
    body = lines.join(able, "file").where("line > head_line")
    whole = F.size("cells") == F.size("head")
    cell = lambda k: F.get("cells", F.lit(k))
    nets = F.transform(F.slice("cells", len(COLUMNS) + 1, F.size("people")), to_paise)
    body = body.select("file", "line", "people", "last_line", "cells", whole.alias("whole"), (whole & (F.lower(cell(1)) == FOOTER)).alias("footer"), to_paise(cell(3)).alias("cost_paise"), nets.alias("nets"))
    body = body.withColumn("footers", F.sum(F.col("footer").cast("int")).over(Window.partitionBy("file").orderBy("line")))

    total = F.aggregate("nets", F.lit(0).cast("long"), lambda s, n: s + n)
    date = F.when(cell(0).rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(cell(0), "yyyy-MM-dd"))
    checks = [
        ("columns", ~F.col("whole")), ("second_footer", F.col("footer") & (F.col("footers") > 1)), ("bad_date", ~F.col("footer") & date.isNull()), ("no_currency", ~F.col("footer") & (cell(4) == "")),
        ("bad_cost", ~F.col("footer") & ~F.coalesce(F.col("cost_paise") > 0, F.lit(False))), ("bad_share", ~F.col("footer") & F.exists("nets", lambda n: n.isNull())),
        ("unbalanced", ~F.col("footer") & (F.abs(total) > F.size("people"))), ("share_over_cost", ~F.col("footer") & F.exists("nets", lambda n: F.abs(n) > F.col("cost_paise"))),
    ]
    judged = body.withColumn("what", _first_problem(checks))
    lines_wrong = judged.where("what is not null").select("file", "line", "what", F.lit(None).cast("string").alias("who"))
    stated = judged.where("footer and what is null").select("file", "line", "last_line", F.explode(F.arrays_zip("people", "nets")).alias("b")).select("file", "line", "last_line", F.col("b.people").alias("person"), F.col("b.nets").alias("balance_paise"))
    balances_wrong = stated.where("balance_paise is null").select("file", "line", F.lit("bad_balance").alias("what"), F.col("person").alias("who"))
    errors = files_wrong.unionByName(lines_wrong).unionByName(balances_wrong)

    good = able.select("file").join(errors.select("file"), "file", "left_anti")
    kept = judged.where("not footer").join(good, "file")
    kept = kept.withColumn("net_of", F.when(F.size("nets") == F.size("people"), F.col("nets")).otherwise(F.transform("people", lambda p: F.lit(None).cast("long"))))  # rows of other widths are in refused files
    kept = kept.withColumn("seq", F.row_number().over(Window.partitionBy("file").orderBy("line")))
    rows = kept.select(
        "file", "seq", "line", date.alias("date"), cell(1).alias("description"), cell(2).alias("category"), cell(4).alias("currency"), "cost_paise", F.map_from_arrays("people", "net_of").alias("nets"),
        F.when(F.lower(cell(2)) == PAYMENT, "payment").otherwise("expense").alias("kind"),
    )
    rows = rows.withColumn("net_paise", F.try_element_at("nets", F.lit(me.strip())))
    balances = stated.join(good, "file")
    return Exports(rows, balances.select("file", "person", "balance_paise"), errors, _warnings(rows, balances, good))


def _warnings(rows: DataFrame, balances: DataFrame, good: DataFrame) -> DataFrame:
    """What is usable but worth a look: footers that are missing, misplaced or do not add up, mixed currencies, no rows."""
    sums = rows.select("file", F.explode("nets").alias("person", "net")).groupBy("file", "person").agg(F.sum("net").alias("summed"))
    off = balances.join(sums, ["file", "person"], "left").where(F.coalesce("summed", F.lit(0)) != F.col("balance_paise"))
    per_file = good.join(balances.groupBy("file").agg(F.min("line").alias("footer_line"), F.max("last_line").alias("last_line")), "file", "left").join(rows.groupBy("file").agg(F.count_distinct("currency").alias("currencies")), "file", "left")
    none = F.lit(None).cast("string")
    found = F.array_compact(F.array(
        F.when(F.col("footer_line").isNull(), "no_footer"), F.when(F.col("footer_line") < F.col("last_line"), "footer_not_last"), F.when(F.col("currencies") > 1, "mixed_currencies"), F.when(F.col("currencies").isNull(), "no_rows"),
    ))
    return off.select("file", F.lit("sum_differs").alias("what"), F.col("person").alias("who")).unionByName(per_file.select("file", F.explode(found).alias("what"), none.alias("who")))
