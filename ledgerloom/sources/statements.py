"""Bank statements from text files, and from the words of printed pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.sources.quoted import rows_of

#: The header cells by which a statement's bank is known.
LAYOUTS = {
    "two_column": ("Date", "Narration", "Withdrawal Amt.", "Deposit Amt.", "Closing Balance"),
    "dated_time": ("Transaction Date", "Description", "Debit", "Credit", "Balance"),
}


def money(text: Column, rounding: str = "half_even") -> Column:
    """Paise of a statement cell; blank and dashes are null. ``rounding``: half_even or truncate."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(text), r"(?i)\s*(cr|dr)$", ""), ",", "")
    value = plain.try_cast("decimal(30,6)") * 100
    return (F.bround(value) if rounding == "half_even" else F.when(value < 0, F.ceil(value)).otherwise(F.floor(value))).cast("long")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, place, cells``: the rows of CSV statements in order, each file on its own; none of a file with an open quote.

    A file is read whole, since its rows mean nothing without its header; files
    are what a statement import distributes over.
    """
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    rows = whole.select("file", F.posexplode(rows_of(F.col("value"))).alias("place", "cells"))
    return rows.where(F.exists("cells", lambda c: F.trim(c) != ""))


def read_statements(spark: SparkSession, path: str) -> DataFrame:
    """``file, statement_seq, txn_date, txn_time, narration, amount_paise, bank_balance_paise`` of either layout.

    Rows before the header and rows whose first cell is no date are skipped;
    the amount is the deposit, or the withdrawal with its sign turned.
    """
    rows = lines(spark, path)
    known = F.lit(None).cast("string")
    for name, header in LAYOUTS.items():
        known = F.when(F.array_contains("cells", header[0]) & F.array_contains("cells", header[2]), name).otherwise(known)
    heads = rows.withColumn("layout", known).where("layout is not null").groupBy("file").agg(F.min(F.struct("place", "layout", "cells")).alias("h"))
    rows = rows.join(heads, "file").where(F.col("place") > F.col("h.place"))

    def cell(k: int) -> Column:
        at = F.lit(None).cast("int")
        for name, header in LAYOUTS.items():
            at = F.when(F.col("h.layout") == name, F.array_position("h.cells", header[k]).cast("int")).otherwise(at)
        return F.when(at > 0, F.try_element_at("cells", at))

    first = F.trim(cell(0))
    date = F.coalesce(F.try_to_date(F.when(first.rlike(r"^\d{2}/\d{2}/\d{2}$"), first), "dd/MM/yy"), F.try_to_date(F.regexp_extract(first, r"^(\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd"))
    time = F.regexp_extract(first, r"(\d{2}:\d{2}:\d{2})$", 1)
    out, in_ = money(cell(2)), money(cell(3))
    parsed = rows.select("file", "place", date.alias("txn_date"), F.when(time != "", time).alias("txn_time"), cell(1).alias("narration"), F.coalesce(F.when(in_ != 0, in_), -out).alias("amount_paise"), money(cell(4)).alias("bank_balance_paise"))
    parsed = parsed.where("txn_date is not null and amount_paise is not null")
    return parsed.withColumn("statement_seq", F.row_number().over(Window.partitionBy("file").orderBy("place"))).drop("place")


#: Where the columns of a printed statement begin, and the months' names.
COLUMN_STARTS = {"date": float("-inf"), "details": 80.0, "ref": 280.0, "amount": 420.0, "balance": 500.0}
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def page_rows(words: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """``file, page, row, words``: the visual rows of pages, each with its words (``top, x0, text``) from left to right.

    ``words``: file, page, top, x0, text. Downwards, a word belongs to the row
    whose first word is at most ``tolerance`` above it, so rows do not chain. A word further than that below the word
    before it always starts a row, so what is held at once is a stretch of a page without such a gap.
    """
    words = words.select("file", "page", F.col("top").cast("double").alias("top"), F.col("x0").cast("double").alias("x0"), "text")
    downwards = Window.partitionBy("file", "page").orderBy("top", "x0", "text")
    gap = F.coalesce(F.col("top") - F.lag("top").over(downwards) > tolerance, F.lit(True))
    cut = words.withColumn("gap", gap.cast("int")).withColumn("stretch", F.sum("gap").over(downwards.rowsBetween(Window.unboundedPreceding, 0)))
    stretches = cut.groupBy("file", "page", "stretch").agg(F.array_sort(F.collect_list(F.struct("top", "x0", "text"))).alias("words"))
    begin = F.struct(F.lit(None).cast("double").alias("anchor"), F.array().cast("array<int>").alias("starts"))

    def step(s: Column, w: Column, i: Column) -> Column:
        new = s["anchor"].isNull() | (w["top"] - s["anchor"] > tolerance)
        return F.struct(F.when(new, w["top"]).otherwise(s["anchor"]).alias("anchor"), F.when(new, F.concat(s["starts"], F.array(i))).otherwise(s["starts"]).alias("starts"))

    placed = F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    starts = stretches.withColumn("starts", F.aggregate(placed, begin, lambda s, x: step(s, x["w"], x["i"]), lambda s: s["starts"]))
    ends = F.transform("starts", lambda at, i: F.struct(at.alias("at"), F.coalesce(F.get("starts", i + 1), F.size("words")).alias("end")))
    own = F.transform(ends, lambda r: F.slice("words", r["at"] + 1, r["end"] - r["at"]))
    rows = starts.select("file", "page", "stretch", F.posexplode(own).alias("place", "words"))
    row = F.row_number().over(Window.partitionBy("file", "page").orderBy("stretch", "place")) - 1
    by_x = F.array_sort("words", lambda a, b: F.when(a["x0"] < b["x0"], -1).when(a["x0"] > b["x0"], 1).otherwise(0))
    return rows.select("file", "page", row.alias("row"), by_x.alias("words"))


def _printed_paise(text: Column) -> Column:
    """Paise of a printed amount: a minus sign before it, a currency sign and grouping anywhere."""
    digits = F.translate(F.trim(text), "-₹,", "")
    value = F.floor(F.trim(digits).try_cast("decimal(30,6)") * 100).cast("long")
    return F.when(F.trim(text).startswith("-"), -value).otherwise(value)


def page_transactions(words: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """``file, statement_seq, txn_date, narration, ref, amount_paise, bank_balance_paise, type`` from the words of statements.

    A transaction starts at a row that leads, in the date column, with a day's
    number and then a month and a two-digit year. Its further words belong to columns by where they begin. Rows that
    lead in the details column continue the narration of the last start, also on the next page; other
    rows are headings. Of several words in one column the last counts.
    """
    rows = page_rows(words, tolerance)
    word = lambda k, field: F.get("words", F.lit(k))[field]

    def within(w: Column, name: str) -> Column:
        names = list(COLUMN_STARTS)
        ends = [*list(COLUMN_STARTS.values())[1:], float("inf")]
        k = names.index(name)
        return (w["x0"] >= COLUMN_STARTS[name]) & (w["x0"] < ends[k])

    month = F.array_position(F.array(*map(F.lit, MONTHS)), word(1, "text")).cast("int")
    starts = (F.size("words") >= 3) & (word(0, "x0") < COLUMN_STARTS["details"]) & word(0, "text").rlike("^[0-9]{1,2}$") & (month > 0)
    rows = rows.withColumn("starts", F.coalesce(starts, F.lit(False))).withColumn("continues", ~F.col("starts") & within(F.get("words", F.lit(0)), "details"))
    order = Window.partitionBy("file").orderBy("page", "row")
    rows = rows.where("starts or continues").withColumn("seq", F.sum(F.col("starts").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("seq > 0")
    own = F.when(F.col("starts"), F.slice("words", 4, F.greatest(F.size("words") - 3, F.lit(0)))).otherwise(F.col("words"))
    of = lambda name: F.transform(F.filter(own, lambda w: within(w, name)), lambda w: w["text"])
    last = lambda name: F.when(F.col("starts"), F.try_element_at(of(name), F.lit(-1)))
    year = F.regexp_extract(word(2, "text"), "^'?([0-9]{2})$", 1)
    date = F.when(F.col("starts"), F.try_to_date(F.concat_ws("-", F.concat(F.lit("20"), year), F.lpad(month.cast("string"), 2, "0"), F.lpad(word(0, "text"), 2, "0")), "yyyy-MM-dd"))
    parts = rows.select("file", "seq", "page", "row", date.alias("txn_date"), of("details").alias("details"), last("ref").alias("ref"), _printed_paise(last("amount")).alias("amount"), _printed_paise(last("balance")).alias("balance"))
    details = F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("page", "row", "details"))), lambda p: p["details"])), " ")
    out = parts.groupBy("file", "seq").agg(F.max("txn_date").alias("txn_date"), details.alias("narration"), F.max("ref").alias("ref"), F.max("amount").alias("amount_paise"), F.max("balance").alias("bank_balance_paise"))
    return out.select("file", F.col("seq").cast("int").alias("statement_seq"), "txn_date", "narration", "ref", "amount_paise", "bank_balance_paise", F.lit("regular").alias("type"))


def balance_breaks(transactions: DataFrame) -> DataFrame:
    """Rows whose stated balance is not the one before plus their amount; rows without a balance, or after one, are not compared."""
    before = F.lag("bank_balance_paise").over(Window.partitionBy("file").orderBy("statement_seq"))
    rows = transactions.withColumn("expected_paise", before + F.col("amount_paise"))
    return rows.where(F.col("expected_paise") != F.col("bank_balance_paise")).select("file", "statement_seq", "expected_paise", "bank_balance_paise")
