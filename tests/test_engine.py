"""The engine's operators on small frames and folders, and parity queries against DuckDB."""

import datetime as dt
import io
import math
import struct
import zipfile
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from gridloom.cli import main
from gridloom.functions import clean
from gridloom.functions.natural import chinese_number, natural_key
from gridloom.operators import auto, schema
from gridloom.operators.aggregate import normalize_agg_func, subtotals, summarize
from gridloom.operators.dedup import deduplicate
from gridloom.operators.extract import build_table, detect_header_row
from gridloom.operators.notes import count_cells, empty_columns, missing_columns
from gridloom.operators.pivot import pivot_summarize
from gridloom.plans import queries
from gridloom.plans.config import TaskSpec
from gridloom.plans.issues import Issues
from gridloom.plans.pipeline import plan_tables, remap, run
from gridloom.sinks.xlsx import rendered, safe_filename, safe_sheet_title, sheet, write_xlsx
from gridloom.sources import biff, xlsb
from gridloom.sources.grid import date_text, is_date_format
from gridloom.sources.workbook import count_files, decode_csv, grids, read_folder

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents".split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("<NA>", "NaT"):
        return "NULL"
    return repr(float(v)) if isinstance(v, (int, float)) or type(v).__module__ == "numpy" else str(v)


@pytest.mark.parametrize("name", list(queries.queries()))
def test_parity(spark, duck, name):
    got, want = queries.queries()[name](spark, SF).toPandas(), duck.sql(queries.oracle_sql()[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    table = lambda d: sorted(tuple(map(_norm, r)) for r in d[cols].itertuples(index=False))
    assert table(got) == table(want)


def values(spark, column, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [(r["v"], r["err"]) for r in df.select("i", column(F.col("t")).alias("x")).select("i", "x.v", "x.err").orderBy("i").collect()]


def test_numbers(spark):
    texts = ["1,234.5", "￥64.00", "65元", "(26.00)", "12%", "１２", "8 瓶", "3.5kg", ' ="007" ', "-", "无", "N/A", None, "很多", "5千克", "约52元", "#DIV/0!", "1_000", "nan", "inf"]
    got = values(spark, clean.to_number, texts)
    assert [v for v, _ in got][:9] == [1234.5, 64.0, 65.0, -26.0, 0.12, 12.0, 8.0, 3.5, 7.0]
    assert all(x == (None, None) for x in got[9:13])
    assert all(v is None and e for v, e in got[13:])


def test_dates(spark):
    texts = ["2026-03-05", "2026/3/5", "2026.3.5", "2026年3月5日", "20260305", "46086", "2026-03-05 08:30", "3月5日", "2026-13-45", "12", "x", "无"]
    got = values(spark, lambda c: clean.to_date(c, F.lit(2026)), texts)
    day = dt.datetime(2026, 3, 5)
    assert [v for v, _ in got][:8] == [day] * 6 + [dt.datetime(2026, 3, 5, 8, 30), day]
    assert got[8] == (None, clean.ERR_BAD_YMD) and got[9] == (None, clean.ERR_SMALL) and got[10] == (None, clean.ERR_NOT_DATE) and got[11] == (None, None)
    assert values(spark, clean.to_date, ["9.30"]) == [(None, clean.ERR_NO_YEAR)]


def test_natural_order():
    assert sorted(["10号", "2号", "一百店", "二店", "a"], key=natural_key) == ["2号", "二店", "10号", "一百店", "a"]
    assert [chinese_number(x) for x in ("十", "一二", "二百零五", "三千")] == [10, 2, 205, 3000]


def test_mapping():
    store = schema.AliasStore()
    assert schema.suggest("QTY", store).target == "数量" and schema.suggest("单价/元", store).status == "待确认"
    assert schema.suggest("金额（元）", store).status == "自动" and schema.suggest("会员卡号", store).status == "未匹配"
    found, conflicts = schema.suggest_for_columns(["金额", "销售额", "备注"], store, {"备注": ""})
    assert [s.target for s in found] == ["金额", None, None] and conflicts and found[2].status == "忽略"
    assert schema.resolve(found) == ["金额", "销售额", None]
    with pytest.raises(ValueError):
        store.learn_role("x", "boss")


def test_learned_aliases(tmp_path):
    path = str(tmp_path / "a.json")
    store = schema.AliasStore(path)
    store.learn("会员卡号", "卡号")
    store.save()
    assert schema.suggest("会员卡号", schema.AliasStore(path)).target == "卡号"


def test_summaries(spark):
    df = spark.createDataFrame([("B", 1.0, "x"), ("A", 2.5, None), (None, None, "y"), ("A", 1.0, "x"), ("A10", 4.0, "x"), ("A2", 0.0, "x")], "k string, v double, p string")
    got = [tuple(r) for r in summarize(df, ["k"], [("v", "求和"), ("v", "平均"), ("p", "计数")]).collect()]
    assert got == [("A", 3.5, 1.75, 1), ("A2", 0.0, 0.0, 1), ("A10", 4.0, 4.0, 1), ("B", 1.0, 1.0, 1), ("(空)", 0.0, None, 1), ("总计", 8.5, 1.7, 5)]
    p = pivot_summarize(df, ["k"], "p", [("v", "求和")])
    assert p.columns == ["k", "x", "y", "(空)", "合计"]
    rows = {r["k"]: tuple(r)[1:] for r in p.collect()}
    assert rows["A"] == (1.0, None, 2.5, 3.5) and rows["(空)"] == (None, 0.0, None, 0.0) and rows["总计"] == (6.0, 0.0, 2.5, 8.5)
    assert {tuple(r) for r in subtotals(df, "p", [("v", "求和"), ("v", "平均")]).collect()} == {("x", "小计", 6.0), ("y", "小计", 0.0), ("(空)", "小计", 2.5)}
    assert normalize_agg_func("AVG") == "平均" and normalize_agg_func("中位数") is None
    assert summarize(df.limit(0), [], []).collect()[0]["记录数"] == 0


def test_dedup(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "b", 1.0), (4, "a", 0.0), (5, "b", 1.0)], "o int, k string, v double")
    marked = {r["o"]: (r["is_duplicate"], r["first_place"] and r["first_place"]["o"]) for r in deduplicate(df, "mark", [], ["o"]).collect()}
    assert marked == {1: (False, None), 2: (True, 1), 3: (False, None), 4: (False, None), 5: (True, 3)}
    assert {r["o"] for r in deduplicate(df, "drop", ["k"], ["o"]).collect()} == {1, 3}
    assert deduplicate(df, "off", [], ["o"]).count() == 5


def test_auto(spark):
    df = spark.createDataFrame([(1, "A", "c1", "Nut", 2.0, 1.0), (2, "B", "c1", "nut", 3.0, 1.0), (3, "A", "c2", "Bolt", 1.0, 9.0), (4, "A", "c1", "nut", 1.0, 1.0)], "o int, `门店` string, `商品编码` string, `商品` string, `数量` double, `单价` double")
    store = schema.AliasStore()
    plan = auto.make_plan(df, store.roles(), store.types())
    assert plan == auto.AutoPlan("商品编码", ["商品"], ["门店"], [("数量", "求和")])
    assert [tuple(r) for r in auto.summarize_auto(df, plan, ["o"]).orderBy("数量").collect()] == [("c2", "Bolt", 1, 1.0), ("c1", "nut", 2, 6.0), ("总计", None, 2, 7.0)]
    assert auto.looks_like_rate("单价") and not auto.looks_like_rate("总价")


def test_tables_from_grids():
    grid = [["月报", None, None, None], ["日期", "门店", "数量", "金额"], ["2026-1-1", "A", "1", "2"], [None] * 4, ["金额", "数量", "门店", "日期"], ["9", "8", "B", "2026-1-2"], ["1", None, None, "合计"], ["备注文字", None, None, None]]
    assert detect_header_row(grid) == 1
    out = list(build_table(grid))
    assert [c for k, _, c, _ in out if k == "row"] == [["2026-1-1", "A", "1", "2"], ["2026-1-2", "B", "8", "9"]]
    assert [n.split("|")[1] for k, _, _, n in out if k == "issue"] == ["表头识别", "表头识别", "跳过合计行", "跳过说明行"]


def test_encodings():
    assert decode_csv("门店".encode("gbk")) == "门店" and decode_csv("门店".encode("utf-8-sig")) == "门店" and decode_csv("café".encode("cp1252")) == "café"


@pytest.fixture
def folder(tmp_path):
    f = tmp_path / "in"
    f.mkdir()
    write_xlsx(str(f / "a.xlsx"), [("销售", ["日期", "门店", "商品编码", "数量", "金额"], [[dt.date(2026, 1, 2), "A", "007", 1, 2.5], [dt.date(2026, 1, 3), "B", "008", 2, 5.0], ["合计", None, None, 3, 7.5]])])
    (f / "b.csv").write_bytes("业务日期,店铺,货号,QTY,销售额\n2026/1/2,A,007,1,2.5元\n1月5日,C,009,很多,4\n".encode("gbk"))
    (f / "空.csv").write_bytes(b"")
    (f / "bad.xlsx").write_bytes(b"not a zip")
    (f / "~$a.xlsx").write_bytes(b"x")
    (f / "说明.txt").write_text("x")
    return f


def test_end_to_end(spark, folder, tmp_path):
    spec = TaskSpec(input_folder=str(folder), output_dir=str(tmp_path / "out"), group_by=["门店"], aggregations=[("金额", "求和"), ("数量", "求和")], split_by="门店")
    r = run(spark, spec, now=dt.datetime(2026, 2, 1))
    detail = [x.asDict() for x in r.detail.collect()]
    assert [(d["日期"].date().isoformat(), d["门店"], d["商品编码"], d["数量"], d["金额"], d["来源文件"], d["原始行号"]) for d in detail] == [("2026-01-02", "A", "007", 1.0, 2.5, "a.xlsx", 2), ("2026-01-03", "B", "008", 2.0, 5.0, "a.xlsx", 3), ("2026-01-02", "A", "007", 1.0, 2.5, "b.csv", 2), ("2026-01-05", "C", "009", None, 4.0, "b.csv", 3)]
    assert [tuple(x) for x in r.summary.collect()] == [("A", 5.0, 2.0), ("B", 5.0, 2.0), ("C", 4.0, 0.0), ("总计", 14.0, 4.0)]
    kinds = [x["问题类型"] for x in r.issues.collect()]
    assert sorted(set(kinds)) == sorted(["文件读取失败", "数值无法转换", "日期补全年份", "空文件/空Sheet", "重复记录", "跳过合计行"])
    with open(r.output_path, "rb") as f:
        sheets = dict(grids("x.xlsx", f.read()))
    assert list(sheets) == ["汇总", "A", "B", "C", "明细", "问题清单"] and len(sheets["明细"]) == 5 and sheets["A"][-1][1] == "小计"


def test_split_files_and_drop(spark, folder, tmp_path):
    spec = TaskSpec(input_folder=str(folder), output_dir=str(tmp_path / "o"), output_name="r", split_by="门店", split_mode="file", dedup_mode="drop")
    r = run(spark, spec)
    assert r.detail.count() == 3 and len(r.outputs) == 3 and all(o.startswith(str(tmp_path / "o" / "r_按门店拆分")) for o in r.outputs)
    assert r.auto_plan.key == "商品编码"


def test_cells_keep_their_kinds(spark, tmp_path):
    f = tmp_path / "in"
    f.mkdir()
    header = ["日期", "门店", "商品编码", "数量", "层"]
    rows = [[dt.date(2026, 1, 2), "A", "007", 5, 1], [12.5, "A", "12", dt.date(2026, 1, 3), 2], ["3月5日", "B", 12, True, 3], [20260304, "B", "008", "7箱", 4]]
    write_xlsx(str(f / "a.xlsx"), [("S", header, rows)])
    r = run(spark, TaskSpec(input_folder=str(f)), now=dt.datetime(2026, 2, 1), export=False)
    got = [(x["日期"] and x["日期"].date().isoformat(), x["商品编码"], x["数量"], x["层"]) for x in r.detail.collect()]
    assert got == [("2026-01-02", "007", 5.0, 1.0), (None, "12", None, 2.0), ("2026-03-05", "012", None, 3.0), ("2026-03-04", "008", 7.0, 4.0)]
    said = {(x["行号"], x["说明"].split("，该")[0]) for x in r.issues.collect() if x["严重程度"] == "错误"}
    assert said == {(3, clean.ERR_SMALL_CELL), (3, clean.ERR_NUMBER_DATE), (4, clean.ERR_NUMBER_BOOL)}
    assert [x[0] for x in values(spark, lambda c: clean.to_code(c, F.lit("d")), ["2026-01-02"])] == [None]


def test_rendered_rows_are_what_values_give(spark, tmp_path):
    kinds = "a string, b long, c double, d timestamp_ntz, e boolean, f decimal(9,2), g date"
    rows = [("x<\x01&\x02", 1, 2.5, dt.datetime(2026, 1, 2, 3, 4, 5), True, Decimal("1.50"), dt.date(2026, 1, 2)), (None,) * 7, (" 字 ", -7, float("nan"), dt.datetime(1899, 1, 1), False, None, None)]
    df = spark.createDataFrame(rows, kinds)
    for name, given in (("a", rows), ("b", sheet("S", df)[2]), ("c", sheet("S", df.limit(0))[2])):
        write_xlsx(str(tmp_path / f"{name}.xlsx"), [("S", df.columns, given)])
    read = {n: dict(grids("x.xlsx", (tmp_path / f"{n}.xlsx").read_bytes()))["S"] for n in "abc"}
    assert read["a"] == read["b"] and len(read["b"]) == 4 and len(read["c"]) == 1
    many = spark.range(1500).selectExpr("id AS x", "CAST(id AS string) AS y").orderBy(F.desc("x"))
    assert [r.split("<v>")[1].split("<")[0] for r in rendered(many)] == [str(1499 - i) for i in range(1500)]


def test_release_frees_what_a_run_stored(spark, folder, tmp_path):
    r = run(spark, TaskSpec(input_folder=str(folder), output_dir=str(tmp_path / "o")))
    assert r.stored and all(df.is_cached for df in r.stored)
    r.release()
    assert not any(df.is_cached for df in r.stored) and r.detail.count() == 4


def test_missing_folder_and_counts(spark, folder, tmp_path):
    r = run(spark, TaskSpec(input_folder=str(tmp_path / "gone")))
    assert [(x["严重程度"], x["问题类型"]) for x in r.issues.collect()] == [("错误", "文件读取失败")] and r.detail.count() == 0 and r.summary.count() == 1 and r.output_path is None
    assert count_files(spark, str(folder)) == 4
    tables = plan_tables(spark, TaskSpec(input_folder=str(folder)), schema.AliasStore(), Issues())
    again = remap(tables, schema.AliasStore(), {"金额": "总额", "销售额": "总额"})
    assert {s.target for _, _, _, found in again.plans for s in found if s.status == "手动"} == {"总额"}


def test_dropped_rows_are_logged(spark, folder):
    r = run(spark, TaskSpec(input_folder=str(folder), dedup_mode="drop"), export=False)
    said = [(x["文件"], x["行号"], x["说明"]) for x in r.issues.collect() if x["问题类型"] == "重复记录已删除"]
    assert said == [("b.csv", 2, "按全部列与 a.xlsx 第 2 行重复，已从明细和汇总中删除")]


def test_roles_and_types():
    store = schema.AliasStore()
    store.learn_role("商品编码", "none")
    assert "商品编码" not in store.roles()
    assert schema.column_types(["x"], store, {}, [("x", "sum")]) == {"x": "number"}
    assert [schema.similarity(a, b) for a, b in (("", "x"), ("ab", "ab"), ("单价(元)", "单价"), ("单价/元", "单价"))] == [0.0, 100.0, 95.0, 85.0]


def test_columns_of_skipped_rows_are_empty():
    grid = [["日期", "门店", "数量", None, "金额"], ["2026-1-1", "A", "1", None, "2"], ["合计", None, None, "9", "2"]]
    out = list(build_table(grid))
    assert next(c for k, _, c, _ in out if k == "header") == ["日期", "门店", "数量", "金额"]


def test_cli(spark, folder, tmp_path):
    out = str(tmp_path / "z.xlsx")
    assert main(["-i", str(folder), "-g", "门店", "-a", "金额：求和", "-o", out, "--save-config", str(tmp_path / "t.json")]) == 0
    assert TaskSpec.load(str(tmp_path / "t.json")).aggregations == [("金额", "求和")]
    assert main(["-g", "x"]) == 2


def test_folder_filter(spark, folder):
    assert {r["file"] for r in read_folder(spark, str(folder), excluded=("b.csv|*",)).select("file").distinct().collect()} == {"a.xlsx", "空.csv", "bad.xlsx"}


def test_names():
    taken = set()
    assert [safe_sheet_title(t, taken) for t in ("a/b", "A_B", "x" * 40)] == ["a_b", "A_B_2", "x" * 31]
    assert safe_filename("con", set()) == "_con"


def compound(stream):
    """A compound file with one Workbook stream of at least 4096 bytes."""
    stream += bytes(-len(stream) % 512 + (4096 if len(stream) < 4096 else 0))
    n = len(stream) // 512
    fat = [0xFFFFFFFD, 0xFFFFFFFE, *range(3, n + 2), 0xFFFFFFFE]
    fat += [0xFFFFFFFF] * (128 - len(fat))
    entry = lambda name, kind, start, size: (name + "\0").encode("utf-16-le").ljust(64, b"\0") + struct.pack("<HBB", 2 * len(name) + 2, kind, 1) + bytes(48) + struct.pack("<IQ", start, size)
    head = biff.MAGIC + bytes(16) + struct.pack("<5H", 62, 3, 0xFFFE, 9, 6) + bytes(6) + struct.pack("<9I", 0, 1, 1, 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0) + struct.pack("<109I", 0, *[0xFFFFFFFF] * 108)
    return head + struct.pack("<128I", *fat) + (entry("Root Entry", 5, 0xFFFFFFFE, 0) + entry("Workbook", 2, 2, len(stream))).ljust(512, b"\0") + stream


def old_workbook():
    rec = lambda kind, body=b"": struct.pack("<HH", kind, len(body)) + body
    text = lambda t: struct.pack("<HB", len(t), 1) + t.encode("utf-16-le")
    words = ["日期", "门店", "数量", "金额", "一店"]
    body = b"".join(text(w) for w in words)
    cut = len(b"".join(text(w) for w in words[:4])) + 3 + 2  # within the last word
    globals_ = [rec(0x809, bytes(16)), rec(0x22, b"\0\0"), rec(0x41E, struct.pack("<H", 170) + text("[h]:mm\"d\"")), rec(0xE0, struct.pack("<HH", 0, 0) + bytes(16)), rec(0xE0, struct.pack("<HH", 0, 14) + bytes(16)), rec(0xFC, struct.pack("<II", 5, 5) + body[:cut]), rec(0x3C, b"\x01" + body[cut:])]
    sheet_head = lambda at: rec(0x85, struct.pack("<IBBBB", at, 0, 0, 2, 1) + "明细".encode("utf-16-le"))
    at = len(b"".join(globals_)) + len(sheet_head(0)) + len(rec(0x0A))
    cell = lambda r, c, xf=0: struct.pack("<3H", r, c, xf)
    sheet = [rec(0x809, bytes(16)), *(rec(0xFD, cell(0, i) + struct.pack("<I", i)) for i in range(4)), rec(0x203, cell(1, 0, 1) + struct.pack("<d", 46297)), rec(0xFD, cell(1, 1) + struct.pack("<I", 4)), rec(0xBD, struct.pack("<HH", 1, 2) + struct.pack("<HIHI", 0, 3 << 2 | 2, 0, 1250 << 2 | 3) + struct.pack("<H", 3)), rec(0x205, cell(2, 2) + b"\x07\x01"), rec(0x06, cell(2, 3) + b"\0" * 6 + b"\xff\xff" + bytes(8)), rec(0x207, text("算")), rec(0x27E, cell(2, 0) + struct.pack("<I", (-2 << 2 | 2) & 0xFFFFFFFF)), rec(0xE5, struct.pack("<5H", 1, 1, 2, 1, 1)), rec(0x0A)]
    return compound(b"".join([*globals_, sheet_head(at), rec(0x0A), *sheet]))


BOTH = [["日期", "门店", "数量", "金额"], ["2026-10-02", "一店", "3", "12.5"], ["-2", "一店", "#DIV/0!", "算"]]


def test_old_workbook():
    assert list(grids("a.xls", old_workbook())) == [("明细", BOTH)]
    with pytest.raises(ValueError):
        biff.workbook_stream(b"x" * 600)


def binary_workbook():
    def rec(kind, body=b""):
        number = lambda n: bytes([n]) if n < 128 else bytes([n & 127 | 128, n >> 7])
        return number(kind) + number(len(body)) + body

    text = lambda t: struct.pack("<I", len(t)) + t.encode("utf-16-le")
    cell = lambda kind, c, body, style=0: rec(kind, struct.pack("<II", c, style) + body)
    row = lambda r: rec(0, struct.pack("<I", r) + bytes(13))
    rels = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.bin"/></Relationships>'
    sheet = [row(0), *(cell(7, i, struct.pack("<I", i)) for i in range(4)), row(1), cell(5, 0, struct.pack("<d", 46297), 1), cell(6, 1, text("一店")), cell(2, 2, struct.pack("<I", 3 << 2 | 2)), cell(9, 3, struct.pack("<d", 12.5)), row(2), cell(2, 0, struct.pack("<I", (-2 << 2 | 2) & 0xFFFFFFFF)), cell(3, 2, b"\x07"), cell(8, 3, text("算")), rec(176, struct.pack("<4I", 1, 2, 1, 1))]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.bin", rec(153, bytes(4)) + rec(156, bytes(8) + text("r1") + text("明细")))
        z.writestr("xl/_rels/workbook.bin.rels", rels)
        z.writestr("xl/sharedStrings.bin", b"".join(rec(19, b"\0" + text(t)) for t in BOTH[0]))
        z.writestr("xl/styles.bin", rec(617) + rec(47, struct.pack("<HH", 0, 0)) + rec(47, struct.pack("<HH", 0, 14)) + rec(618))
        z.writestr("xl/worksheets/sheet1.bin", b"".join(sheet))
    return out.getvalue()


def test_binary_workbook():
    assert list(grids("a.xlsb", binary_workbook())) == [("明细", BOTH)]
    assert list(xlsb.records(bytes([0x9C, 0x01, 0x02, 7, 8]))) == [(156, b"\x07\x08")]


def test_date_cells():
    assert [date_text(x) for x in (46297, 46297.5, 0.25)] == ["2026-10-02", "2026-10-02 12:00:00", "06:00:00"] and date_text(1, True) == "1904-01-02"
    assert is_date_format("yyyy/m/d") and is_date_format("[h]:mm") and not is_date_format('0.00"day"') and not is_date_format("[Red]0")


def test_notes(spark):
    assert missing_columns({"a": {"x", "y"}, "b": {"x", "y"}, "c": {"x"}, "d": {"x"}}, {"a", "b", "c"}, ["x", "y"]) == {"c": ["y"], "d": ["y"]}
    assert missing_columns({}, set(), ["x"]) == {} and missing_columns({"a": set()}, set(), ["x"]) == {}
    df = spark.createDataFrame([("a", None, 1.0), ("a", None, None), (None, None, 2.0)], "k string, m double, v double")
    assert {tuple(r) for r in count_cells(df, ["k"], {"m": F.col("m").isNull(), "v": F.col("v").isNull()}).collect()} == {("a", "m", 2), ("a", "v", 1), (None, "m", 1)}
    assert empty_columns(df, ["m", "v", "gone"]) == ["m"] and empty_columns(df.limit(0), ["m"]) == [] and empty_columns(df, ["gone"]) == []


def test_notes_of_a_folder(spark, tmp_path):
    f = tmp_path / "in"
    f.mkdir()
    (f / "a.csv").write_text("日期,门店,数量,金额\n2026/1/2,A,1,2\n1月5日,A,,3\n", encoding="utf-8")
    (f / "b.csv").write_text("日期,门店,数量,金额\n2026/1/3,B,2,2\n", encoding="utf-8")
    (f / "c.csv").write_text("日期,门店,数量\n2026/1/3,C,2\n", encoding="utf-8")
    (f / "d.xls").write_bytes(old_workbook())
    (f / "e.xlsb").write_bytes(binary_workbook())
    r = run(spark, TaskSpec(input_folder=str(f), group_by=["数量"], aggregations=[("金额", "求和"), ("数量", "求和")]), now=dt.datetime(2026, 2, 1), export=False)
    found = {(x["问题类型"], x["文件"], x["行号"], x["列名"], x["说明"]) for x in r.issues.collect()}
    assert ("缺少列", "c.csv", 1, "", "该 Sheet 缺少列：金额（明细中留空）") in found
    assert ("空值", "a.csv", 1, "数量", "有 1 个空值（未填写，如未盘点），汇总时不按 0 计算") in found
    assert ("日期补全年份", "a.csv", 1, "日期", "有 1 个日期没写年份（如 9.30、9月30日），已按 2026 年处理") in found
    assert any(k == "汇总设置" and c == "数量" for k, _, _, c, _ in found) and not any(k == "空值" and p == "c.csv" for k, p, *_ in found)
    assert {x["来源文件"] for x in r.detail.collect()} == {"a.csv", "b.csv", "c.csv", "d.xls", "e.xlsb"}
