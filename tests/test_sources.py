"""Statement files, printed pages, spreadsheets and exports against plain readers."""

import datetime
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from ledgerloom.sources import exports, quoted, sheets, statements


def plain_rows(text):
    """Character by character."""
    text = text.removeprefix("﻿")
    rows, row, cell, inside, i = [], [], "", False, 0
    while i < len(text):
        c = text[i]
        if inside:
            if c == '"' and text[i + 1 : i + 2] == '"':
                cell, i = cell + '"', i + 1
            elif c == '"':
                inside = False
            else:
                cell += c
        elif c == '"':
            inside = True
        elif c == ",":
            row, cell = [*row, cell], ""
        elif c == "\n":
            rows, row, cell = [*rows, [*row, cell]], [], ""
        elif c != "\r":
            cell += c
        i += 1
    if inside:
        return None
    return [*rows, [*row, cell]] if cell or row else rows


def test_quotes_are_carried_through_a_text(spark):
    rng = random.Random(3)
    texts = ["", "\n", '""', '"a""b",c', '""""', 'a"b,c"d\r\n"x\r\ny",', '﻿a,b\n"open', '"abc""', "a,b,\n\n,c", '"a"",b'] + ["".join(rng.choice('ab,"\n\r" ') for _ in range(rng.randrange(25))) for _ in range(400)]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, value string")
    for r in frame.select("i", quoted.rows_of(F.col("value")).alias("rows")).collect():
        assert r.rows == plain_rows(texts[r.i]), repr(texts[r.i])
    long = 'x,"' + '""' * 100_000 + '"\n'
    assert spark.createDataFrame([(long,)], "value string").select(quoted.rows_of(F.col("value")).alias("rows")).first().rows == [["x", '"' * 100_000]]


HEAD = "Date,Description,Category,Cost,Currency,"


def parse(spark, texts, me="Ann"):
    return exports.parse_exports(spark.createDataFrame(list(texts.items()), "file string, value string"), me)


def test_export_rows_and_balances(spark, tmp_path):
    text = '﻿' + HEAD + 'Ann, Bob ,Cy\r\n\r\n2024-01-01,"Dinner, ""late""\nand cab",Food,"1,000.00",INR,500.00,-250.00,-250.00\r\n2024-01-02,Paid back,Payment,250.00,INR,-250.00,250.00,0\r\n , , , , , , ,\r\n2024-01-03,Total balance, , , ,250.00,0.00,-250.00\r\n'
    (tmp_path / "x.csv").write_text(text, newline="")
    out = exports.read_exports(spark, str(tmp_path / "x.csv"), "Ann")
    rows = out.rows.orderBy("seq").collect()
    assert [(r.seq, r.line, str(r.date), r.description, r.cost_paise, r.nets, r.net_paise, r.kind) for r in rows] == [
        (1, 3, "2024-01-01", 'Dinner, "late"\nand cab', 100_000, {"Ann": 50_000, "Bob": -25_000, "Cy": -25_000}, 50_000, "expense"), (2, 4, "2024-01-02", "Paid back", 25_000, {"Ann": -25_000, "Bob": 25_000, "Cy": 0}, -25_000, "payment"),
    ]
    assert {(r.person, r.balance_paise) for r in out.balances.collect()} == {("Ann", 25_000), ("Bob", 0), ("Cy", -25_000)}
    assert out.errors.count() == out.warnings.count() == 0


def test_exports_are_refused_whole(spark):
    many = [f"p{i}" for i in range(1500)]
    texts = {
        "open": HEAD + 'Ann,Bob\n2024-01-01,"x', "empty": " \n,,\n", "other": "Date,Narration\n", "nobody": HEAD + "\n", "twice": HEAD + "Ann,Bob,Bob\n", "not me": HEAD + "Bob\n",
        "rows": HEAD + "Ann,Bob\n2024-02-30,a,b,1,INR,1,-1\n2024-01-01,a,b,1,INR,1\n2024-01-01,a,b,1,,1,-1\n2024-01-01,a,b,0,INR,0,0\n2024-01-01,a,b,10,INR,,-5\n2024-01-01,a,b,10,INR,5,-4\n2024-01-01,a,b,10,INR,11,-11\n2024-01-01,Total Balance,,,,1,x\n2024-01-01,total balance,,,,1,1\n",
        "blank": HEAD + "Ann,Bob\n2024-01-01,a,b,10,INR,5.00,-5.00\n,Total balance,,,,6.00,-5.00\n2024-01-02,a,b,1.00,USD,1.00,-1.00\n", "none": HEAD + "Ann\n",
        "wide": HEAD + "Ann," + ",".join(many) + "\n2024-01-01,a,b,2000,INR," + ",".join(["1500", *["-1"] * 1500]) + "\n",
    }
    out = parse(spark, texts)
    wrong = sorted((r.file, r.line, r.what, r.who) for r in out.errors.where("line is null").collect())
    assert wrong == [(f, None, w, None) for f, w in (("empty", "empty"), ("nobody", "no_people"), ("not me", "owner_missing"), ("open", "truncated"), ("other", "other_columns"), ("twice", "person_twice"))]
    assert [(r.line, r.what, r.who) for r in out.errors.where("line is not null").orderBy("line").collect()] == [
        (2, "bad_date", None), (3, "columns", None), (4, "no_currency", None), (5, "bad_cost", None), (6, "bad_share", None), (7, "unbalanced", None), (8, "share_over_cost", None), (9, "bad_balance", "Bob"), (10, "second_footer", None),
    ]
    assert {(r.file, r.description, len(r.nets)) for r in out.rows.collect()} == {("blank", "a", 2), ("wide", "a", 1501)}
    assert sorted((r.file, r.what, r.who or "") for r in out.warnings.collect()) == [("blank", "footer_not_last", ""), ("blank", "mixed_currencies", ""), ("blank", "sum_differs", "Bob"), ("none", "no_footer", ""), ("none", "no_rows", ""), ("wide", "no_footer", "")]


def plain_transactions(words, tolerance=3.0):
    """Row by row over the words of one file: (page, top, x0, text)."""
    months = list(statements.MONTHS)
    column = lambda x: "date" if x < 80 else "details" if x < 280 else "ref" if x < 420 else "amount" if x < 500 else "balance"
    money = lambda t: (-1 if t.startswith("-") else 1) * int(round(float(t.replace("-", "").replace("₹", "").replace(",", "")) * 100))
    out = []
    for page in sorted({w[0] for w in words}):
        rows = []
        for _, top, x0, text in sorted(w for w in words if w[0] == page):
            if rows and top - rows[-1][0] <= tolerance:
                rows[-1][1].append((x0, text))
            else:
                rows.append((top, [(x0, text)]))
        for _, row in rows:
            row.sort(key=lambda w: w[0])
            if len(row) >= 3 and row[0][0] < 80 and row[0][1].isdigit() and len(row[0][1]) <= 2 and row[1][1] in months:
                out.append({"date": datetime.date(2000 + int(row[2][1].lstrip("'")), months.index(row[1][1]) + 1, int(row[0][1])), "details": [], "ref": None, "amount": None, "balance": None})
                for x0, text in row[3:]:
                    c = column(x0)
                    if c == "details":
                        out[-1]["details"].append(text)
                    elif c == "ref":
                        out[-1]["ref"] = text
                    elif c in ("amount", "balance"):
                        out[-1][c] = money(text)
            elif out and column(row[0][0]) == "details":
                out[-1]["details"] += [t for x, t in row if column(x) == "details"]
    return [(i, t["date"], " ".join(t["details"]), t["ref"], t["amount"], t["balance"]) for i, t in enumerate(out, 1)]


@pytest.mark.parametrize("seed", (1, 2))
def test_printed_pages(spark, seed):
    rng, words = random.Random(seed), []
    for page in range(4):
        top = 5.0
        words.append((page, top, 32.0, "DATE"))
        for _ in range(12):
            top += rng.choice([2.0, 4.0, 6.0, 20.0])
            shift = lambda: rng.choice([0.0, 0.5, 1.5, 2.9, 3.0])  # noqa: B023, E731
            if rng.random() < 0.5:
                words += [(page, top + shift(), x, t) for x, t in ((30.0, str(rng.randrange(1, 29))), (45.0, rng.choice(statements.MONTHS)), (60.0, "'24"))]
                words += [(page, top + shift(), 442.0, rng.choice(["-₹1,099", "₹11,721.37", "-0.29"])), (page, top, 535.0, "₹5.5"), (page, top, 290.0, f"R{rng.randrange(99)}")]
            for k in range(rng.randrange(3)):
                words.append((page, top + shift(), 92.0 + 20 * k, rng.choice("abc")))
            if rng.random() < 0.2:
                words.append((page, top + shift(), 300.0, "aside"))
    words = [w for i, w in enumerate(words) if (w[1], w[2]) not in {(x[1], x[2]) for x in words[:i] if x[0] == w[0]}]
    wanted = plain_transactions(words)
    frame = spark.createDataFrame([("f", *w) for w in words], "file string, page int, top double, x0 double, text string").repartition(3)
    out = statements.page_transactions(frame).orderBy("statement_seq").collect()
    assert [(r.statement_seq, r.txn_date, r.narration, r.ref, r.amount_paise, r.bank_balance_paise) for r in out] == wanted


def test_rows_of_words_do_not_chain(spark):
    frame = spark.createDataFrame([("f", 1, float(t), 1.0, str(t)) for t in (0, 2, 4, 6, 8)], "file string, page int, top double, x0 double, text string")
    assert [[w.text for w in r.words] for r in statements.page_rows(frame).orderBy("row").collect()] == [["0", "2"], ["4", "6"], ["8"]]
    rows = spark.createDataFrame([("f", 1, 100, 100), ("f", 2, 50, 150), ("f", 3, 1, 1), ("f", 4, 1, None)], "file string, statement_seq int, amount_paise long, bank_balance_paise long")
    assert [tuple(r) for r in statements.balance_breaks(rows).collect()] == [("f", 3, 151, 1)]


def workbook(path, rows, active=0, late=False):
    """The least that a spreadsheet program writes: strings are shared, dates are styled numbers."""
    strings, body = [], []
    for r, row in enumerate(rows, 1):
        cells = []
        for c, v in enumerate(row):
            at = f"{'ABCDEFGHIJ'[c]}{r}"
            if isinstance(v, datetime.datetime):
                cells.append(f'<c r="{at}" s="1"><v>{(v - datetime.datetime(1904, 1, 1) if late else v - datetime.datetime(1899, 12, 30)) / datetime.timedelta(days=1)}</v></c>')
            elif isinstance(v, str):
                strings.append(v)
                cells.append(f'<c r="{at}" t="s"><v>{len(strings) - 1}</v></c>')
            elif v is not None:
                cells.append(f'<c r="{at}"><v>{v}</v></c>')
        body.append(f'<row r="{r}">{"".join(cells)}</row>')
    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    text = lambda s: s.replace("&", "&amp;").replace("<", "&lt;")
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {space}><workbookPr date1904="{int(late)}"/><bookViews><workbookView activeTab="{active}"/></bookViews><sheets><sheet name="a" sheetId="1" r:id="r1"/><sheet name="b" sheetId="2" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/s1.xml"/><Relationship Id="r2" Target="/xl/worksheets/s2.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet {space}><numFmts><numFmt numFmtId="164" formatCode="dd/mm/yyyy"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/></cellXfs></styleSheet>')
        z.writestr("xl/sharedStrings.xml", f"<sst {space}>{''.join(f'<si><r><t>{text(s[:3])}</t></r><r><t>{text(s[3:])}</t></r></si>' for s in strings)}</sst>")
        for k in (0, 1):
            z.writestr(f"xl/worksheets/s{k + 1}.xml", f"<worksheet {space}><sheetData>{''.join(body) if k == active else ''}</sheetData></worksheet>")


def test_pages_of_any_length_are_not_held_at_once(spark):
    frame = spark.createDataFrame([("f", 1, 10.0 * i + down, x, f"{i}{text}") for i in range(300) for down, x, text in ((0.0, 5.0, "b"), (2.0, 1.0, "a"))], "file string, page int, top double, x0 double, text string")
    rows = statements.page_rows(frame)
    assert [[w.text for w in r.words] for r in rows.orderBy("row").collect()] == [[f"{i}a", f"{i}b"] for i in range(300)]
    # Words are gathered by stretches between gaps, never by pages.
    assert "stretch" in next(line for line in rows._jdf.queryExecution().optimizedPlan().toString().splitlines() if "collect_list" in line)


def test_statement_sheets(spark, tmp_path):
    workbook(tmp_path / "h.xlsx", [["Some Bank"], ["date", "Narration", "Chq./Ref.No.", "Value Dt", "Withdrawal Amt.", "Deposit Amt.", "Closing Balance"], ["********"], ["01/02/24", "Shop <one>", "0001", "01/02/24", 10.5, None, 1000], ["02/02/98", "Pay", None, None, None, "2,000.005", "3,000.00"], ["Total", None, None, None, 5, 5, 5]])
    when = datetime.datetime(2024, 3, 1)
    header = ["Txn Date", "Description", "Cheque No", "Debit Amount", "Credit Amount", "Balance"]
    workbook(tmp_path / "i.xlsx", [header, [when, "Cash", None, 37.62, None, "962.380 CR"], [when, "Fee", 12, "1.00", " ", "5.00 DR"], ["01/03/24", "no date cell", None, 1, None, 1]], active=1)
    workbook(tmp_path / "late.xlsx", [header, [when, "x", None, None, 1.005e-05, 7]], late=True)
    workbook(tmp_path / "odd.xlsx", [["a", "b"]])
    (tmp_path / "broken.xlsx").write_bytes(b"PK nothing")
    rows, refused = sheets.read_statement_sheets(spark, str(tmp_path))
    got = {}
    for r in rows.orderBy("file", "statement_seq").collect():
        got.setdefault((r.file.rpartition("/")[2], r.bank), []).append((r.statement_seq, str(r.txn_date), r.amount_paise, r.narration, r.ref, r.bank_balance_paise))
    assert got == {
        ("h.xlsx", "hdfc"): [(1, "2024-02-01", -1050, "Shop <one>", "0001", 100_000), (2, "1998-02-02", 200_000, "Pay", None, 300_000)],
        ("i.xlsx", "indian_bank"): [(1, "2024-03-01", -3762, "Cash", None, 96_238), (2, "2024-03-01", -100, "Fee", "12", -500)],
        ("late.xlsx", "indian_bank"): [(1, "2024-03-01", 0, "x", None, 700)],
    }
    assert {r.file.rpartition("/")[2]: r.error.split(":")[0] for r in refused.collect()} == {"odd.xlsx": "no known header row", "broken.xlsx": "BadZipFile"}
