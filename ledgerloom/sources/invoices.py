"""Invoices from extracted documents: pages with text and tables, kept as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DOCUMENT = "page_count int, char_count int, pages array<struct<index:int,width:double,height:double,text:string,tables:array<array<array<string>>>>>"

#: Words that claim a document for a template.
TEMPLATES = {"marketplace": ("tax invoice", "order number"), "grocery": ("tax invoice", "order id")}


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``file, page_count, char_count, pages`` of extracted-document JSON files."""
    return spark.read.schema(DOCUMENT).json(path, multiLine=True).withColumn("file", F.input_file_name())


def full_text(pages: Column) -> Column:
    return F.lower(F.array_join(F.transform(pages, lambda p: F.coalesce(p["text"], F.lit(""))), "\n"))


def template(text: Column) -> Column:
    """The one template whose words are all there; two claims or none give null."""
    claims = [F.when(F.lit(True) if not words else _all(text, words), name) for name, words in TEMPLATES.items()]
    found = F.array_compact(F.array(*claims))
    return F.when(F.size(found) == 1, F.element_at(found, 1))


def _all(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for w in words:
        out = out & text.contains(w)
    return out


def status(pages: Column) -> Column:
    """What to do with a document: failed, unsupported (and why) or staged."""
    text = full_text(pages)
    return F.when(pages.isNull() | (F.trim(text) == ""), "failed").when(text.contains("credit note"), "unsupported_credit_note").when(~text.contains("invoice"), "unsupported_not_an_invoice").when(template(text).isNull(), "unsupported_no_template").otherwise("staged")


def amount(text: Column) -> Column:
    """Paise of a printed amount, half to even; currency signs and grouping are ignored."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^0-9.\-]", "")
    return F.bround(plain.try_cast("decimal(30,6)") * 100).cast("long")


def invoice_lines(documents: DataFrame) -> DataFrame:
    """``file, line_index, invoice_number, description, qty, kind, amount_paise`` of all tables.

    Columns are found by their headings; a cell that holds several amounts, one a
    printed line, is as many lines; an invoice number holds for the pages after it
    until the next one.
    """
    pages = documents.select("file", F.posexplode("pages").alias("page", "p"))
    number = F.regexp_extract("p.text", r"(?i)invoice (?:number|no)\.?\s*:?\s*([A-Z0-9-]+)", 1)
    ahead = Window.partitionBy("file").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    pages = pages.withColumn("invoice_number", F.last(F.when(number != "", number), ignorenulls=True).over(ahead))
    tables = pages.select("file", "page", "invoice_number", F.posexplode("p.tables").alias("table", "rows"))
    heads = F.transform(F.element_at("rows", 1), lambda c: F.lower(F.trim(F.coalesce(c, F.lit("")))))
    rows = tables.withColumn("heads", heads).select("file", "page", "table", "invoice_number", "heads", F.posexplode("rows").alias("row", "cells")).where("row > 0")

    def column(*names: str) -> Column:
        at = F.coalesce(*(F.when(F.array_position("heads", n) > 0, F.array_position("heads", n)) for n in names)).cast("int")
        return F.when(at.isNotNull(), F.try_element_at("cells", at))

    totals = F.split(F.coalesce(column("total amount", "total", "amount"), F.lit("")), "\n")
    names = F.split(F.coalesce(column("description", "item", "product"), F.lit("")), "\n")
    each = rows.select("file", "page", "table", "row", "invoice_number", names.alias("names"), column("qty", "quantity").alias("qty"), F.posexplode(totals).alias("part", "total"))
    each = each.withColumn("description", F.trim(F.coalesce(F.when(F.size("names") > F.col("part"), F.get("names", F.col("part"))), F.get("names", F.lit(0))))).withColumn("amount_paise", amount(F.col("total")))
    each = each.where("amount_paise is not null and lower(description) not like 'total%'")
    place = F.row_number().over(Window.partitionBy("file").orderBy("page", "table", "row", "part")) - 1
    fee = F.lower("description").rlike(r"\b(shipping|delivery|handling|convenience|packaging) ?(charge|charges|fee|fees)?\b")
    return each.select("file", place.alias("line_index"), "invoice_number", "description", F.regexp_extract(F.coalesce("qty", F.lit("1")), "([0-9]+)", 1).try_cast("int").alias("qty"), F.when(fee, "fee").otherwise("goods").alias("kind"), "amount_paise")


def unreconciled(lines: DataFrame, stated: DataFrame) -> DataFrame:
    """Invoices whose lines do not add up to the stated total, without tolerance.

    ``stated``: file, invoice_number, total_paise.
    """
    sums = lines.groupBy("file", "invoice_number").agg(F.sum("amount_paise").alias("lines_paise"))
    return stated.join(sums, ["file", "invoice_number"], "left").where(~F.col("lines_paise").eqNullSafe(F.col("total_paise")))
