"""Sources on small invented inputs: CSV headers, workbook, JSON payloads."""

import io
import os
import tempfile
import zipfile

import pytest
from pyspark.sql import functions as F

from shipfold.operators import changes as C
from shipfold.operators import fold as FO
from shipfold.profiles import IMPORT_CONFIRM, PICKUP_REPORT
from shipfold.sources import csv as CSV
from shipfold.sources import json as J
from shipfold.sources import workbook as WB


def _write(tmp, name, text):
    p = os.path.join(tmp, name)
    with open(p, "w", encoding="utf-8") as fh:
        fh.write(text)
    return p


def test_csv_headers_aliases_and_blanks(spark):
    tmp = tempfile.mkdtemp()
    # same header twice (first wins); two aliases of one column (last wins,
    # blank -> absent); unknown header; inner double space does not match.
    p = _write(tmp, "a.csv",
               "M#,Status,M#,Customer,HAWB Customer,Dest  Cs,Mystery,ETA\n"
               "900-1 ,New,900-9,ACME,,x,zz,2030-01-05 08:00:00\n"
               "nan,New,,ACME,B,x,zz,\n"
               "900-2,N/A,,ACME,BETA,y,zz,NA\n")
    rows = CSV.csv_upload_rows(spark, [p], IMPORT_CONFIRM).orderBy("line_no").collect()
    assert [r["line_no"] for r in rows] == [1, 2, 3]
    assert rows[0]["fields"] == {"mawb": "900-1 ", "status": "New", "eta": "2030-01-05 08:00:00"}
    assert rows[2]["fields"] == {"mawb": "900-2", "hawb_customer": "BETA"}
    df = spark.createDataFrame([(r["fields"], r["line_no"]) for r in rows],
                               "fields map<string,string>, line_no long")
    ch, rej = C.upload_changes(df, IMPORT_CONFIRM, F.col("line_no"), F.current_timestamp())
    assert rej.count() == 1
    cur = {r["key"]: r for r in FO.fold(ch, IMPORT_CONFIRM.value_columns).collect()}
    assert set(cur) == {"900-1", "900-2"}
    assert cur["900-1"]["bot_status"] == "pending" and cur["900-1"]["hawb_customer"] is None


def test_csv_missing_key_column_and_file_gate(spark):
    tmp = tempfile.mkdtemp()
    p = _write(tmp, "b.csv", "Shipper,Owner\nS,O\n")
    rows = CSV.csv_upload_rows(spark, [p], PICKUP_REPORT).collect()
    assert rows[0]["has_key_column"] is False and rows[0]["fields"] is None
    with pytest.raises(ValueError):
        CSV.read_csv_cells(spark, [os.path.join(tmp, "c.txt")])


def test_csv_line_numbers_across_splits(spark):
    tmp = tempfile.mkdtemp()
    body = "".join(f"k{i},v{i}\n" for i in range(20000))
    p = _write(tmp, "big.csv", "B/L No,Notes\n" + body)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        cells = CSV.read_csv_cells(spark, [p])
        got = cells.select("line_no", F.col("cells")[0].alias("k")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 20001
    assert all(r["k"] == ("B/L No" if r["line_no"] == 0 else f"k{r['line_no'] - 1}") for r in got)


def _xlsx(rows):
    shared, idx = [], {}

    def sref(v):
        if v not in idx:
            idx[v] = len(shared)
            shared.append(v)
        return idx[v]

    sheet_rows = []
    for r, row in enumerate(rows, 1):
        cells = []
        for c, v in enumerate(row):
            if v is None:
                continue
            ref = f"{chr(65 + c)}{r}"
            if isinstance(v, (int, float)):
                cells.append(f'<c r="{ref}"><v>{v}</v></c>')
            else:
                cells.append(f'<c r="{ref}" t="s"><v>{sref(v)}</v></c>')
        sheet_rows.append(f'<row r="{r}">{"".join(cells)}</row>')
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rns = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} {rns}><sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels",
                   '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                   '<Relationship Id="rId1" Target="worksheets/sheet1.xml" Type="x"/></Relationships>')
        z.writestr("xl/sharedStrings.xml",
                   f'<sst {ns}>' + "".join(f"<si><t>{s}</t></si>" for s in shared) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData>{"".join(sheet_rows)}</sheetData></worksheet>')
    return buf.getvalue()


def test_workbook_upload(spark):
    tmp = tempfile.mkdtemp()
    p = os.path.join(tmp, "u.xlsx")
    with open(p, "wb") as fh:
        fh.write(_xlsx([["B/L", "Total Cartons", "Notes"], ["BL1", 12, None], ["BL2", None, "N/A"]]))
    cells = WB.read_workbook_cells(spark, [p])
    rows = CSV.upload_rows_from_cells(cells, PICKUP_REPORT).orderBy("line_no").collect()
    assert [r["fields"] for r in rows] == [{"bl_no": "BL1", "total_cartons": "12"}, {"bl_no": "BL2"}]


def test_embedded_array_missing_and_bad(spark):
    df = spark.createDataFrame([
        ("  var X = [\n    {\"mno\": \"1\", \"eta\": null}\n  ];",),
        ("var Y = [];",),
        ("  var X = [ broken\n  ];",),
    ], "t string")
    got = [r[0] for r in df.select(J.embedded_array("t", "X").alias("a")).collect()]
    assert got[0] == [{"mno": "1", "eta": None}] and got[1] == [] and got[2] == []


def test_flat_batch_validation(spark):
    df = spark.createDataFrame([
        ('{"mawbs": [" a ", "", "b"], "field": " ATA ", "value": "2030-01-01 10:00:00"}',),
        ('{"mawbs": ["a"], "field": "eta", "value": "x"}',),
        ('{"mawbs": ["a"], "field": "atd", "value": ""}',),
        ('{"mawbs": ["  "], "field": "atd", "value": "x"}',),
    ], "p string")
    reasons = [r[0] for r in df.select(J.flat_batch_reject_reason(J.flat_batch("p"))).collect()]
    assert reasons == [None, "field must be 'atd' or 'ata'", "value is required", "mawbs is required"]
    rows = J.explode_flat_batch(df, "p").collect()
    assert [(r["pos"], r["key"], r["result"]) for r in rows] == [
        (0, "a", {"ata": "2030-01-01 10:00:00"}), (1, "b", {"ata": "2030-01-01 10:00:00"})]


def test_bulk_json_keeps_absent_vs_null(spark):
    df = spark.createDataFrame([('[{"mawb": "1", "eta": null, "wt": 5}, {"eta": "x"}]',)], "p string")
    rows = J.explode_rows(df, "p").collect()
    assert rows[0]["fields"] == {"mawb": "1", "eta": None, "wt": "5"}
    assert rows[1]["fields"] == {"eta": "x"}


def test_csv_byte_order_mark_and_quotes(spark):
    tmp = tempfile.mkdtemp()
    p = os.path.join(tmp, "bom.csv")
    with open(p, "wb") as fh:
        fh.write('﻿M#,OP Remarks\n900-1,"late, ""held"" at gate"\n'.encode("utf-8"))
    rows = CSV.csv_upload_rows(spark, [p], IMPORT_CONFIRM).collect()
    assert rows[0]["fields"] == {"mawb": "900-1", "op_remarks": 'late, "held" at gate'}


def test_csv_header_after_blank_lines_and_quoted_header(spark):
    # Lines that are empty after trimming control characters are skipped by
    # the reader, so the header is the first other line; a quoted header cell
    # keeps its comma. Line numbers count records, as the reader gives them.
    tmp = tempfile.mkdtemp()
    _write(tmp, "a.csv", "\n  \t\n\"M#\",\"OP, Remarks\",ETA\n900-1,x,2030-01-01 00:00:00\n\n900-2,y,\n")
    _write(tmp, "b.csv", "ETA,M#\n2031-01-01 00:00:00,900-3\n")
    rows = CSV.csv_upload_rows(spark, [tmp], IMPORT_CONFIRM).orderBy("file_index", "line_no").collect()
    got = [(r["file_index"], r["line_no"], r["fields"]) for r in rows]
    assert got == [
        (0, 1, {"mawb": "900-1", "eta": "2030-01-01 00:00:00"}),
        (0, 2, {"mawb": "900-2"}),
        (1, 1, {"mawb": "900-3", "eta": "2031-01-01 00:00:00"}),
    ]
    files, spanning = CSV.file_table(spark, [tmp])
    assert CSV.header_width(files) == 3 and spanning == []


def test_csv_quoted_line_breaks(spark):
    """A cell with line breaks, doubled quotes and separators stays one cell; its file's records are put together."""
    tmp = tempfile.mkdtemp()
    _write(tmp, "a [1].csv", '\nM#,"Add\nress",Address,Operator\n1,x,"12 ""Old"" Road\nTown, North\n\n",2024\n \n2,,"",5" pipe\n')
    _write(tmp, "b.csv", "M#,Address\n3,plain\n")
    rows = CSV.csv_upload_rows(spark, [tmp], IMPORT_CONFIRM).orderBy("row_index").collect()
    assert [(r["file_index"], r["line_no"], r["row_index"], r["fields"]) for r in rows] == [
        (0, 1, 1, {"mawb": "1", "address": '12 "Old" Road\nTown, North\n\n', "operator": "2024"}),
        (0, 2, 2, {"mawb": "2", "operator": '5" pipe'}),
        (1, 1, 4, {"mawb": "3", "address": "plain"})]
    whole = CSV.csv_upload_rows(spark, [tmp], IMPORT_CONFIRM, multiLine=True).orderBy("row_index").collect()
    assert [r["fields"] for r in whole] == [r["fields"] for r in rows]


def test_csv_wide_rows_refuse_their_file(spark):
    """A row wider than its own file's header, even by an empty cell, refuses that file alone."""
    tmp = tempfile.mkdtemp()
    _write(tmp, "fine.csv", "M#,ETA,Status\n1,a,New\n2\n")
    _write(tmp, "wide.csv", "M#,ETA\n3,c\n4,c,EXTRA,EXTRA2\n")
    _write(tmp, "blank.csv", "M#,ETA\n5,c,\n")
    _write(tmp, "spans.csv", 'M#,ETA\n6,"c\nd",x\n')
    _write(tmp, "quoted.csv", 'M#,ETA\n7,"c,""d"",e"\n')
    _write(tmp, "nokey.csv", "ETA\nx\n")
    rows, refused = CSV.csv_upload(spark, [tmp], IMPORT_CONFIRM)
    kept = {r["fields"]["mawb"]: r["fields"] for r in rows.filter("refused IS NULL").collect()}
    assert set(kept) == {"1", "2", "7"} and kept["7"]["eta"] == 'c,"d",e'
    why = {os.path.basename(r["file_path"]): r["reason"] for r in refused.collect()}
    assert set(why) == {"wide.csv", "blank.csv", "spans.csv", "nokey.csv"}
    assert why["wide.csv"] == CSV.WIDER_ROW + " (4 cells, header 2)" and why["nokey.csv"] == CSV.NO_KEY_COLUMN
    cells = CSV.read_csv_cells(spark, [tmp]).filter("line_no > 0").collect()
    assert sorted(r["cells"][0] for r in cells) == ["1", "2", "7", "x"]


def test_record_shape(spark):
    """Cells and open quotes of a line, against the standard library's reader."""
    import csv
    lines = ['a,b', '', ',', '"a,b",c', '"a""b,c"",""d",e', '"open, x', 'a"b,c"d,e', '"",""', '"a"', 'x,"y', '""",",z', '""""']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "i int, t string")
    for r in df.select("t", CSV.record_shape(F.col("t")).alias("s")).collect():
        want = next(csv.reader([r["t"] + "\n"]), []) or [""]
        assert r["s"]["cells"] == len(want), r
        assert r["s"]["open"] == want[-1].endswith("\n"), r


def test_repeated_keys_and_malformed_bodies(spark):
    """A key given twice keeps its last value; a body that does not parse is refused whole, with a reason."""
    df = spark.createDataFrame([(1, '[{"mawb":"1","eta":"a","eta":"b"}]'), (2, '[{"mawb":"2"},{"mawb":'), (3, "nonsense"), (4, None),
                                (5, "[]")], "id int, p string")
    rows = J.explode_rows(df, "p", "id").collect()
    assert [(r.id, r.fields) for r in rows] == [(1, {"mawb": "1", "eta": "b"})]
    assert sorted((r.id, r.reason) for r in J.json_rejects(df, "p", "id").collect()) == [(2, J.MALFORMED), (3, J.MALFORMED)]
    nested = spark.createDataFrame([(1, '{"items":[{"mawb":"1","result":{"atd":"x","atd":"y"}}]}'), (2, "{"), (3, "{}")], "id int, p string")
    assert [(r.id, r.result) for r in J.explode_nested_batch(nested, "p", "id").collect()] == [(1, {"atd": "y"})]
    assert sorted(r.id for r in J.nested_batch_rejects(nested, "p", "id").collect()) == [2, 3]


def test_column_names_match_without_case(spark):
    from pyspark.sql import functions as F
    from shipfold.operators import changes as C
    from shipfold.profiles import IMPORT_CONFIRM
    df = spark.createDataFrame([(1, {"mawb": "1", "Status": "New"}), (2, {"mawb": "2", "status": "a", "STATUS": "b", "id": "7"}),
                                (3, {"mawb": "3", "nope": "x"})], "n int, fields map<string,string>")
    ch, _ = C.bulk_changes(df, IMPORT_CONFIRM, F.col("n"), F.lit("2030-01-01 00:00:00"), apply_defaults=False)
    valid, errors = C.unknown_column_split(ch, IMPORT_CONFIRM)
    got = {r.key: r.fields for r in valid.collect()}
    assert got["1"]["status"] == "New" and set(got) == {"1", "2"} and got["2"]["status"] in ("a", "b") and "STATUS" not in got["2"]
    assert [r.error for r in errors.collect()] == ["no such column: nope"]


def test_interleaved_repeated_label(spark):
    """Labels A, B, A of one column: B first appears last, so B wins."""
    from shipfold.operators import normalise as N
    cells = spark.createDataFrame([(1, 0, 0, "M#", "k"), (1, 0, 1, "A", "a1"), (1, 0, 2, "B", "b"), (1, 0, 3, "A", "a2")],
                                  "page_id int, row_no int, col_no int, label string, value string")
    got = N.label_map(cells, {"m#": "mawb", "a": "x", "b": "x"}, "mawb").first()
    assert got["fields"] == {"mawb": "k", "x": "b"}


def _bytes(tmp, name, data):
    with open(os.path.join(tmp, name), "wb") as fh:
        fh.write(data)


def test_csv_records_across_splits_are_byte_for_byte(spark):
    """Random cells with quotes, separators and all line ends, cut into many splits, against the standard library."""
    import csv
    import random
    rnd = random.Random(4)
    tmp, want = tempfile.mkdtemp(), {}
    for f, end in enumerate(("\n", "\r\n")):
        rows = [["M#", "Notes", "Op,\n erator"]]
        for k in range(1500):
            text = "".join(rnd.choice(['a', 'b"', '""', ',', '\n', '\r\n', '\n\n', ' ', 'é', 'x' * 40]) for _ in range(rnd.randrange(9)))
            rows.append([f"{f}-{k}", text, rnd.choice(["", 'q"', "n\n", "z"])])
        rows.insert(700, ["giant", "line\n" * 4000, '"'])  # one record over several splits
        out = io.StringIO()
        writer = csv.writer(out, lineterminator=end)
        for k, r in enumerate(rows):
            writer.writerow(r)
            if k % 50 == 0:
                out.write(end + " \t" + end)  # blank lines between records
        _bytes(tmp, f"f{f}.csv", out.getvalue().encode())
        want[f] = rows
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        scan = CSV._scan(spark, [tmp], {})
        assert scan.base.select("file_path").distinct().count() == 2
        got = CSV.read_csv_cells(spark, [tmp]).orderBy("row_index").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["row_index"] for r in got] == list(range(len(got)))
    for f, rows in want.items():
        mine = [r["raw_cells"] for r in got if r["file_index"] == f]
        assert mine == rows


def test_csv_unclosed_and_empty_files_are_refused(spark):
    tmp = tempfile.mkdtemp()
    _write(tmp, "open.csv", 'M#,Notes\n1,"never closed\n2,x\n')
    _write(tmp, "fine.csv", 'M#,Notes\n3,"closed\n"\n')
    _bytes(tmp, "blank.csv", b"\n \r\n")
    rows, refused = CSV.csv_upload(spark, [tmp], IMPORT_CONFIRM)
    assert {r["fields"]["mawb"] for r in rows.filter("refused IS NULL").collect()} == {"3"}
    why = {os.path.basename(r["file_path"]): r["reason"] for r in refused.collect()}
    assert why == {"open.csv": CSV.UNCLOSED, "blank.csv": CSV.EMPTY}


def test_csv_other_encodings_and_comments(spark):
    tmp = tempfile.mkdtemp()
    _bytes(tmp, "a.csv", 'M#,OP Remarks\n# "no cell\n1,"é\r\nü"\n'.encode("latin-1"))
    rows = CSV.csv_upload_rows(spark, [tmp], IMPORT_CONFIRM, encoding="ISO-8859-1", comment="#").collect()
    assert [r["fields"] for r in rows] == [{"mawb": "1", "op_remarks": "é\r\nü"}]
    with pytest.raises(ValueError):
        CSV.csv_upload_rows(spark, [tmp], IMPORT_CONFIRM, encoding="UTF-16")


def test_json_arrays_in_splits_equal_the_one_task_reader(spark):
    """Files of one line and of many, cut into many splits; braces, quotes and escapes inside strings."""
    import json
    import random
    from shipfold.sources.json_records import read_json_arrays
    rnd = random.Random(5)
    bits = ["}", "{", "]", "[", '"', "\\", "\\\\\"", ",", "a", "é ", "\n", "},{", '"}', " "]
    text = lambda: "".join(rnd.choice(bits) for _ in range(rnd.randrange(12)))
    tmp = tempfile.mkdtemp()
    for f, indent in enumerate((None, 2, None)):
        rows = [{"mawb": f"{f}-{k}", text(): text(), "n": rnd.choice([None, 1.5, True, {"x": [text(), {}]}, [], [{"a": text()}]])}
                for k in range(800)]
        rows[400]["long"] = "x}\"{" * 3000
        rows[401] = {}
        _write(tmp, f"f{f}.json", json.dumps(rows, indent=indent, ensure_ascii=bool(f)))
    _write(tmp, "empty.json", " [ ]\n")
    want = sorted((r["file_path"], r["pos"], sorted(r["fields"].items(), key=str)) for r in J.read_json_array_files(spark, tmp).collect())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert spark.read.option("lineSep", "}").text(f"{tmp}/f0.json").rdd.getNumPartitions() > 5
        rows, refused = read_json_arrays(spark, tmp)
        got = sorted((r["file_path"], r["pos"], sorted(r["fields"].items(), key=str)) for r in rows.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == want and len(got) == 2400 and refused.count() == 0


def test_json_files_that_are_no_array_of_objects_are_refused(spark):
    from shipfold.sources.json_records import read_json_arrays
    bodies = {"object": '{"a": 1}', "open": '[{"a": 1}', "string": '[{"a": "1}]', "comma": '[{"a": 1} {"b": 2}]', "number": "[1, 2]",
              "mixed": '[1, {"a": 1}]', "after": '[{"a": 1}] x', "two": '[{"a": 1}][{"a": 1}]', "nested": '[[{"a": 1}]]',
              "twice": '[{"a": 1},, {"b": 2}]', "bad": '[{"a": }]', "text": "nonsense", "brace": '[{"a": 1}}', "null": "null"}
    tmp = tempfile.mkdtemp()
    for name, body in bodies.items():
        _write(tmp, f"{name}.json", body)
    _write(tmp, "good.json", '\n[\n{"a": 1} , {"a": null}\n]\n')
    rows, refused = read_json_arrays(spark, tmp)
    assert [(os.path.basename(r["file_path"]), r["pos"], r["fields"]) for r in rows.orderBy("pos").collect()] == [
        ("good.json", 0, {"a": "1"}), ("good.json", 1, {"a": None})]
    assert {os.path.basename(r["file_path"])[:-5]: r["reason"] for r in refused.collect()} == dict.fromkeys(bodies, J.MALFORMED)


_X = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def _styled(sheet, styles="", strings="", properties=""):
    """A workbook from the raw XML of its parts."""
    data = _xlsx([["x"]])
    buf = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(data)) as old, zipfile.ZipFile(buf, "w") as z:
        z.writestr("xl/workbook.xml", old.read("xl/workbook.xml").decode().replace("<sheets>", properties + "<sheets>"))
        z.writestr("xl/_rels/workbook.xml.rels", old.read("xl/_rels/workbook.xml.rels"))
        z.writestr("xl/styles.xml", f"<styleSheet {_X}>{styles}</styleSheet>")
        z.writestr("xl/sharedStrings.xml", f"<sst {_X}>{strings}</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {_X}><sheetData>{sheet}</sheetData></worksheet>")
    return buf.getvalue()


def test_workbook_dates_numbers_and_gaps():
    styles = ('<numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd hh:mm"/><numFmt numFmtId="165" formatCode="[Red]0.00 &quot;days&quot;"/>'
              '<numFmt numFmtId="166" formatCode="[hh]:mm:ss"/></numFmts><cellXfs>' + "".join(
                  f'<xf numFmtId="{n}"/>' for n in (0, 14, 164, 165, 21, 166, 22)) + "</cellXfs>")
    cell = lambda ref, v, s: f'<c r="{ref}" s="{s}"><v>{v}</v></c>'
    sheet = ('<row r="1"><c r="A1" t="inlineStr"><is><r><t>M</t></r><r><t>#</t></r></is></c><c r="C1" t="s"><v>0</v></c></row>'
             '<row r="3">' + cell("A3", "45292", 1) + cell("B3", "45292.354166666664", 2) + cell("C3", "45292", 3)
             + cell("D3", "0.354166666666667", 4) + cell("E3", "1.5", 5) + cell("F3", "45292.99999999999", 6) + cell("G3", "59", 1)
             + cell("H3", "61", 1) + "</row>"
             '<row r="4">' + cell("A4", "12.0", 0) + cell("B4", "0.10000000000000001", 0) + cell("C4", "1E3", 0)
             + '<c r="D4" t="e"><v>#N/A</v></c><c r="E4" t="b"><v>1</v></c><c r="F4" t="str"><v>f</v></c>'
             + cell("G4", "1e12", 1) + "</row><row r=\"9\"><c r=\"A9\" s=\"1\"/></row>")
    strings = "<si><t>ETA</t><rPh><t>guide</t></rPh></si>"
    assert list(WB.sheet_rows(_styled(sheet, styles, strings))) == [
        ["M#", None, "ETA"], [],
        ["2024-01-01 00:00:00", "2024-01-01 08:30:00", "45292", "08:30:00", "1 day, 12:00:00", "2024-01-02 00:00:00",
         "1900-02-28 00:00:00", "1900-03-01 00:00:00"],
        ["12", "0.1", "1000", None, "True", "f", "1000000000000"]]
    old = list(WB.sheet_rows(_styled('<row r="1">' + cell("A1", "1", 1) + "</row>", styles, properties='<workbookPr date1904="1"/>')))
    assert old == [["1904-01-02 00:00:00"]]


def test_workbooks_that_cannot_be_read_are_refused_alone(spark):
    tmp = tempfile.mkdtemp()
    good = _xlsx([["B/L", "Total Cartons"], ["BL1", 12]])
    _bytes(tmp, "good.xlsx", good)
    _bytes(tmp, "noise.xlsx", b"no archive")
    _bytes(tmp, "cut.xlsx", good[:200])
    _bytes(tmp, "sheet.xlsx", _styled("<row r='1'><c r='A1'><v>x"))
    _bytes(tmp, "empty.xlsx", _styled(""))
    _bytes(tmp, "nokey.xlsx", _xlsx([["Shipper"], ["S"]]))
    names = ("good", "noise", "cut", "sheet", "empty", "nokey")
    cells = WB.read_workbook_cells(spark, [os.path.join(tmp, f"{n}.xlsx") for n in names]).cache()
    rows, refused = CSV.cells_upload(cells, PICKUP_REPORT)
    assert [r["fields"] for r in rows.filter("refused IS NULL").collect()] == [{"bl_no": "BL1", "total_cartons": "12"}]
    assert {os.path.basename(r["file_path"])[:-5]: r["reason"] for r in refused.collect()} == {
        "noise": WB.UNREADABLE, "cut": WB.UNREADABLE, "sheet": WB.UNREADABLE, "empty": WB.NO_ROWS, "nokey": CSV.NO_KEY_COLUMN}


def test_csv_texts_are_never_sorted_for_the_table_of_files(spark, monkeypatch):
    """Headers are picked by number; no aggregate holds a text, which would sort all lines by file."""
    root = tempfile.mkdtemp()
    for k in range(3):
        with open(f"{root}/f{k}.csv", "w") as f:
            f.write(f"\n  \nM#,H{k}\n" + "".join(f"{k}-{i},x\n" for i in range(200)))
    with open(f"{root}/g.csv", "w") as f:
        f.write("\nM#,Note\n" + "".join(f'g-{i},"a\nb, {i}"\n' for i in range(200)))
    plans, write = [], type(spark.range(1).write).parquet

    def parquet(self, path, *a, **b):
        plans.append(self._df._jdf.queryExecution().executedPlan().toString())
        return write(self, path, *a, **b)

    monkeypatch.setattr(type(spark.range(1).write), "parquet", parquet)
    files, spanning = CSV.file_table(spark, [root])
    _, more = CSV._record_files(spark, [f"{root}/g.csv"], {})
    plans.append(more._jdf.queryExecution().executedPlan().toString())
    assert not [p for p in plans if "SortAggregate" in p]
    heads = {r.file_path[-6:]: (r.line, r.cells, r.widest, r.spans) for r in files.collect()}
    assert heads == {**{f"f{k}.csv": (f"M#,H{k}", 2, 2, False) for k in range(3)}, "/g.csv": ("M#,Note", 2, 2, True)}
    assert len(spanning) == 1 and spanning[0].endswith("g.csv")
    assert [tuple(r)[1:] for r in more.collect()] == [("M#,Note", 2, 2, False)]


def test_records_of_a_split_are_found_in_runs_of_lines(spark, monkeypatch):
    """Runs cut a split anywhere, also inside quoted cells; the records are the same."""
    from shipfold.sources import csv_records as R
    root = tempfile.mkdtemp()
    want = ["M#,Note"] + [f'{i},"a{i}\n\n""b"", {i}\nc"' if i % 3 else f"{i},plain" for i in range(300)]
    with open(f"{root}/x.csv", "w") as f:
        f.write("\n".join(want) + "\n")
    for bits in (2, 5):
        monkeypatch.setattr(R, "RUN_BITS", bits)
        records, files = R.read_records(spark, [root], {})
        assert [r.text for r in records.orderBy("record").collect()] == want
        assert [r.unclosed for r in files.collect()] == [False]
