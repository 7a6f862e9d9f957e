"""Bank statements in spreadsheet files.

Spark reads the files as bytes, so they may lie wherever Spark can read; a task
unpacks one file at a time and gives the cells of its active sheet as text with
their kind. What the cells mean is said in expressions.
"""

from __future__ import annotations

import datetime
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CELL = "struct<kind: string, text: string>"
#: The header cells that tell a bank's layout, and the places of date, narration, reference, debit, credit and balance.
LAYOUTS = {
    "hdfc": (("Date", "Narration", "Chq./Ref.No.", "Withdrawal Amt.", "Deposit Amt.", "Closing Balance"), (0, 1, 2, 4, 5, 6)),
    "indian_bank": (("Txn Date", "Description", "Debit Amount", "Credit Amount", "Balance"), (0, 1, 2, 3, 4, 5)),
}
#: The numbers of the built-in date formats of a workbook.
_DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _tree(archive: zipfile.ZipFile, name: str):
    return ElementTree.fromstring(archive.read(name)) if name in archive.namelist() else None


def _strings(archive: zipfile.ZipFile) -> list[str]:
    root = _tree(archive, "xl/sharedStrings.xml")
    skip = lambda item: {id(t) for r in item.iter() if _local(r.tag) == "rPh" for t in r.iter()}  # noqa: E731  readings of kanji are no text
    return [] if root is None else ["".join(t.text or "" for t in item.iter() if _local(t.tag) == "t" and id(t) not in skip(item)) for item in root if _local(item.tag) == "si"]


def _dated_styles(archive: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles that show a date."""
    root = _tree(archive, "xl/styles.xml")
    if root is None:
        return set()
    own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in root.iter() if _local(f.tag) == "numFmt"}
    bare = lambda code: re.sub(r'"[^"]*"|\\.|\[(?!h|m|s)[^\]]*\]', "", code.lower())
    dated = lambda n: n in _DATE_FORMATS or bool(re.search("[dmhys]", bare(own.get(n, "")).replace("general", "")))
    formats = next((x for x in root if _local(x.tag) == "cellXfs"), [])
    return {i for i, f in enumerate(formats) if dated(int(f.get("numFmtId", 0)))}


def _active_sheet(archive: zipfile.ZipFile) -> tuple[str, bool]:
    """The name of the active sheet's part, and whether dates count from 1904."""
    book = _tree(archive, "xl/workbook.xml")
    sheets = [s for s in book.iter() if _local(s.tag) == "sheet"]
    view = next((v for v in book.iter() if _local(v.tag) == "workbookView"), None)
    active = int(view.get("activeTab", 0)) if view is not None else 0
    wanted = next(v for k, v in sheets[min(active, len(sheets) - 1)].items() if _local(k) == "id" and "}" in k)
    target = next(r.get("Target") for r in _tree(archive, "xl/_rels/workbook.xml.rels") if r.get("Id") == wanted)
    flags = next((p for p in book.iter() if _local(p.tag) == "workbookPr"), None)
    return (target.lstrip("/") if target.startswith("/") else f"xl/{target}"), flags is not None and flags.get("date1904") in ("1", "true")


def _column(reference: str) -> int:
    out = 0
    for c in re.match("[A-Z]+", reference)[0]:
        out = 26 * out + ord(c) - 64
    return out - 1


def sheet_rows(content: bytes) -> Iterator[tuple[int, list[tuple[str, str] | None]]]:
    """(row number, cells) of the active sheet; a cell is its kind (string, number, date or bool) and text, or None."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        strings, dated = _strings(archive), _dated_styles(archive)
        part, late = _active_sheet(archive)
        start = datetime.datetime(1904, 1, 1) if late else datetime.datetime(1899, 12, 30)
        number = 0
        with archive.open(part) as stream:
            for _, row in ElementTree.iterparse(stream):
                if _local(row.tag) != "row":
                    continue
                number = int(row.get("r", number + 1))
                cells: list[tuple[str, str] | None] = []
                for cell in row:
                    at = _column(cell.get("r")) if cell.get("r") else len(cells)
                    cells += [None] * (at - len(cells) + 1)
                    kind, value = cell.get("t", "n"), next((v.text for v in cell if _local(v.tag) == "v"), None)
                    if kind == "inlineStr":
                        cells[at] = ("string", "".join(t.text or "" for t in cell.iter() if _local(t.tag) == "t"))
                    elif value is None:
                        continue
                    elif kind == "s":
                        cells[at] = ("string", strings[int(value)])
                    elif kind in ("str", "e"):
                        cells[at] = ("string", value)
                    elif kind == "b":
                        cells[at] = ("bool", value)
                    elif kind == "d":
                        cells[at] = ("date", value[:19])
                    elif int(cell.get("s", 0)) in dated:
                        cells[at] = ("date", (start + datetime.timedelta(days=float(value))).isoformat(timespec="seconds"))
                    else:
                        cells[at] = ("number", value if re.fullmatch("-?[0-9]+", value) else repr(float(value)))
                yield number, cells
                row.clear()


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string())]))

    def batch(file, rows):
        cells = [[c and {"kind": c[0], "text": c[1]} for c in own] for _, own in rows]
        return pa.RecordBatch.from_arrays([pa.array([file] * len(rows)), pa.array([n for n, _ in rows], pa.int32()), pa.array(cells, kind), pa.nulls(len(rows), pa.string())], ["file", "place", "cells", "error"])

    for files in batches:
        for file, content in zip(files.column(0).to_pylist(), files.column(1), strict=True):
            rows = []
            try:
                for row in sheet_rows(content.as_py()):
                    rows.append(row)
                    if len(rows) == 2000:
                        yield batch(file, rows)
                        rows = []
                if rows:
                    yield batch(file, rows)
            except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, StopIteration, IndexError, ValueError, AttributeError) as why:
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([None], pa.int32()), pa.array([None], kind), pa.array([f"{type(why).__name__}: {why}"])], ["file", "place", "cells", "error"])


def sheets(spark: SparkSession, path: str) -> DataFrame:
    """``file, place, cells, error``: the rows of the active sheets; a file that is no workbook gives one row with an error."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_unpack, f"file string, place int, cells array<{CELL}>, error string")


def cell_paise(cell: Column) -> Column:
    """Paise of an amount cell, half to even: a number, or digits in a text, where DR at its end turns the sign; null if there are none."""
    digits = F.regexp_replace(cell["text"], "[^0-9.]", "")
    sign = F.when(F.upper(F.trim(cell["text"])).endswith("DR"), -1).otherwise(1)
    rounded = lambda x: F.bround(x.try_cast("decimal(38,9)") * 100).cast("long")
    return F.when(cell["kind"] == "number", rounded(cell["text"])).otherwise(sign * rounded(digits))


def read_statement_sheets(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``file, bank, statement_seq, txn_date, amount_paise, narration, ref, bank_balance_paise, type`` of both layouts; and refused files (``file, error``).

    A file's bank is known by the first row with all its header cells, whatever the
    case. Rows count after that row if they lead with a date: DD/MM/YY as text, or a date
    cell. The amount is the credit, or the debit with its sign turned.
    """
    rows = sheets(spark, path)
    shown = F.transform(F.filter("cells", lambda c: c.isNotNull()), lambda c: F.lower(F.trim(c["text"])))
    bank = F.lit(None).cast("string")
    for name, (header, _) in reversed(LAYOUTS.items()):
        bank = F.when(F.size(F.array_except(F.array(*(F.lit(h.lower()) for h in header)), shown)) == 0, name).otherwise(bank)
    names = list(LAYOUTS)
    heads = rows.withColumn("bank", bank).where("bank is not null").groupBy("file").agg(F.min(F.struct(F.array_position(F.array(*map(F.lit, names)), F.col("bank")).alias("k"), "place", "bank")).alias("h"))
    heads = heads.select("file", F.col("h.place").alias("head_place"), "h.bank")
    broken = rows.where("error is not null").select("file", "error")
    refused = rows.select("file").distinct().join(heads, "file", "left_anti").join(broken, "file", "left").select("file", F.coalesce("error", F.lit("no known header row")).alias("error"))

    def cell(k: int) -> Column:
        out = F.lit(None)
        for name, (_, places) in LAYOUTS.items():
            out = F.when(F.col("bank") == name, F.get("cells", F.lit(places[k]))).otherwise(out)
        return out

    body = rows.join(heads, "file").where("place > head_place")
    lead = F.trim(cell(0)["text"])
    century = F.when(F.substring(lead, 7, 2) >= "69", "19").otherwise("20")
    written = F.when(lead.rlike("^[0-9]{2}/[0-9]{2}/[0-9]{2}$"), F.try_to_date(F.concat(F.substring(lead, 1, 6), century, F.substring(lead, 7, 2)), "dd/MM/yyyy"))
    date = F.when((F.col("bank") == "hdfc"), written).when(cell(0)["kind"] == "date", F.substring(lead, 1, 10).try_cast("date"))
    text = lambda k: F.when(cell(k)["text"] != "", cell(k)["text"])
    out = body.select("file", "bank", "place", date.alias("txn_date"), F.coalesce(cell_paise(cell(4)), -cell_paise(cell(3))).alias("amount_paise"), cell(1)["text"].alias("narration"), text(2).alias("ref"), cell_paise(cell(5)).alias("bank_balance_paise"), F.lit("regular").alias("type"))
    out = out.where("txn_date is not null").withColumn("statement_seq", F.row_number().over(Window.partitionBy("file").orderBy("place")))
    return out.drop("place"), refused
