"""The consolidation plan: folder to detail table, issue log, summary and workbook."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.clean import clean_value, is_month_day, with_year
from gridloom.operators import auto
from gridloom.operators.aggregate import check_aggs, normalize_agg_func, subtotals, summarize
from gridloom.operators.dedup import LINEAGE, deduplicate
from gridloom.operators.notes import count_cells, empty_columns, missing_columns
from gridloom.operators.pivot import pivot_summarize, split_values
from gridloom.operators.repair import FILE_NAMED, pad_codes, rename_by_file
from gridloom.operators.schema import AliasStore, column_order, column_types, resolve, suggest_for_columns
from gridloom.plans.config import TaskSpec
from gridloom.plans.issues import COLUMNS, ERROR, INFO, WARNING, Issues, in_order
from gridloom.sinks.xlsx import rendered, safe_filename, sheet, write_xlsx
from gridloom.sources.workbook import folder_exists, read_folder

FILE, SHEET, ROW = LINEAGE
ORD = "_sheet_ord"
ORDER = [FILE, ORD, ROW]
#: Tables of one row a sheet are broadcast up to so many sheets.
BROADCAST_SHEETS = 20_000


@dataclass
class RunResult:
    detail: DataFrame | None = None
    summary: DataFrame | None = None
    issues: DataFrame | None = None
    output_path: str | None = None
    auto_plan: auto.AutoPlan | None = None
    outputs: list[str] = field(default_factory=list)
    stored: list[DataFrame] = field(default_factory=list)

    def release(self) -> None:
        """Free what the run has stored; its frames stay valid and are computed anew."""
        for df in self.stored:
            df.unpersist()


@dataclass
class Tables:
    """The bronze frame and, from its few header rows, what each sheet's positions are called."""

    bronze: DataFrame
    plans: list[tuple[str, str, list[str], list]]  # file, sheet, headers, suggestions
    header_rows: dict[tuple[str, str], int]


def plan_tables(spark: SparkSession, spec: TaskSpec, store: AliasStore, issues: Issues) -> Tables:
    bronze = read_folder(spark, spec.input_folder, spec.recursive, tuple(spec.excluded), spec.header_rows).persist()
    plans, header_rows = [], {}
    for r in bronze.where("kind = 'header'").orderBy("file", "sheet_ord").collect():  # one row a sheet
        found, conflicts = suggest_for_columns(r["cells"], store, spec.column_mapping)
        plans.append((r["file"], r["sheet"], r["cells"], found))
        header_rows[r["file"], r["sheet"]] = r["row_no"]
        for c in conflicts:
            issues.add(WARNING, r["file"], r["sheet"], kind="表头映射冲突", message=c)
    notes = bronze.where("kind = 'issue'").withColumn("n", F.split("note", r"\|", 3))
    issues.add_frame(notes.select(F.col("n")[0].alias(COLUMNS[0]), F.col("file").alias(COLUMNS[1]), F.col("sheet").alias(COLUMNS[2]), F.col("row_no").alias(COLUMNS[3]), F.lit("").alias(COLUMNS[4]), F.col("n")[1].alias(COLUMNS[5]), F.lit(None).alias(COLUMNS[6]), F.col("n")[2].alias(COLUMNS[7])))
    return Tables(bronze, plans, header_rows)


def remap(tables: Tables, store: AliasStore, mapping: dict[str, str | None]) -> Tables:
    """The same tables with suggestions by another mapping; no file is read again."""
    return Tables(tables.bronze, [(file, name, headers, suggest_for_columns(headers, store, mapping)[0]) for file, name, headers, _ in tables.plans], tables.header_rows)


def _admit(tables: Tables, spec: TaskSpec, store: AliasStore, issues: Issues) -> list[tuple[str, str, list[str], list[str | None]]]:
    """Sheets that take part; where any has a canonical column, sheets without one are left out."""
    hits = lambda found: any(s.target in store.columns and s.status in ("自动", "手动", "待确认") for s in found)
    some = any(hits(p[3]) for p in tables.plans)
    out = []
    for file, name, headers, found in tables.plans:
        if some and not hits(found):
            issues.add(WARNING, file, name, kind="未识别到标准列", message="没有标准列，已跳过")
            continue
        for s in found:
            if s.status == "待确认":
                issues.add(WARNING, file, name, column=s.source, kind="表头待确认", message=f"可能是“{s.target}”（{s.score}）")
            elif s.status == "未匹配":
                issues.add(INFO, file, name, column=s.source, kind="表头未匹配", message="保留原表头" if spec.keep_unmatched else "未保留")
        out.append((file, name, headers, resolve(found, spec.accept_pending, spec.keep_unmatched)))
    return out


def build_detail(spark: SparkSession, spec: TaskSpec, store: AliasStore, issues: Issues, today: dt.date, stored: list[DataFrame]) -> tuple[DataFrame, dict[str, str], dict[str, list[str]]]:
    """The cleaned, typed detail with lineage; types and source headers by column. ``stored`` gets the persisted frames."""
    tables = plan_tables(spark, spec, store, issues)
    admitted = _admit(tables, spec, store, issues)
    columns = column_order([t for p in admitted for t in p[3] if t], store)
    types = column_types(columns, store, spec.column_types, spec.aggregations)
    sources = {c: sorted({h for _, _, hs, ts in admitted for h, t in zip(hs, ts) if t == c}) for c in columns}
    _note_missing(tables, admitted, [c for c in columns if c in store.columns], issues)
    places = [(f, s, tables.header_rows[f, s], [next((i for i, t in enumerate(ts) if t == c), -1) for c in columns], [next((h for h, t in zip(hs, ts) if t == c), c) for c in columns]) for f, s, hs, ts in admitted]
    plan = spark.createDataFrame(places, "file string, sheet string, header_row int, at array<int>, heads array<string>")
    few = len(places) <= BROADCAST_SHEETS
    raw = tables.bronze.where("kind = 'row'").join(F.broadcast(plan) if few else plan, ["file", "sheet"])
    cell = {c: F.get("cells", F.get("at", F.lit(i))) for i, c in enumerate(columns)}
    raw = raw.select(F.col("file").alias(FILE), F.col("sheet").alias(SHEET), F.col("row_no").alias(ROW), F.col("sheet_ord").alias(ORD), "header_row", "at", "heads", *(cell[c].alias(f"r{i}") for i, c in enumerate(columns)), *(F.coalesce(F.nullif(F.substring("note", F.get("at", F.lit(i)) + 1, F.lit(1)), F.lit("")), F.lit("t")).alias(f"k{i}") for i in range(len(columns))))
    dates = [i for i, c in enumerate(columns) if types[c] == "date"]
    cleaned = raw.select("*", *(clean_value(F.col(f"r{i}"), types[c], None, F.col(f"k{i}")).alias(f"c{i}") for i, c in enumerate(columns))).persist()
    stored += [tables.bronze, cleaned]
    if dates:
        cleaned = _with_year(cleaned, dates, today, few).withColumns({f"c{i}": with_year(F.col(f"r{i}"), F.col(f"c{i}"), F.col("_year")) for i in dates})
    loose = [i for i, c in enumerate(columns) if types[c] == "auto"]
    # A column without a type whose cells are all numbers is one of numbers.
    numbers = cleaned.agg(*(x for i in loose for x in (F.count(f"c{i}.v").alias(f"a{i}"), F.count_if(F.col(f"c{i}.v").isNotNull() & (F.col(f"k{i}") == "n")).alias(f"n{i}")))).first() if loose else {}
    numeric = {i for i in loose if numbers[f"a{i}"] and numbers[f"a{i}"] == numbers[f"n{i}"]}
    _note_cells(cleaned, columns, dates, spec, issues)
    wrong = [F.struct(F.get("heads", F.lit(i)).alias("head"), F.lit(c).alias("target"), F.col(f"r{i}").alias("value"), F.col(f"c{i}.err").alias("err"), F.lit({"date": "日期无法识别", "code": "编码无法识别"}.get(types[c], "数值无法转换")).alias("kind")) for i, c in enumerate(columns)]
    if wrong:
        bad = cleaned.select(FILE, SHEET, ROW, F.explode(F.filter(F.array(*wrong), lambda x: x["err"].isNotNull())).alias("x"))
        label = F.when(F.col("x.head") == F.col("x.target"), F.col("x.head")).otherwise(F.concat("x.head", F.lit("（→"), "x.target", F.lit("）")))
        issues.add_frame(bad.select(F.lit(ERROR).alias(COLUMNS[0]), F.col(FILE).alias(COLUMNS[1]), F.col(SHEET).alias(COLUMNS[2]), F.col(ROW).alias(COLUMNS[3]), label.alias(COLUMNS[4]), F.col("x.kind").alias(COLUMNS[5]), F.col("x.value").alias(COLUMNS[6]), F.concat("x.err", F.lit("，该单元格在明细中留空")).alias(COLUMNS[7])))
    detail = cleaned.select(*((F.col(f"c{i}.v").try_cast("double") if i in numeric else F.col(f"c{i}.v")).alias(c) for i, c in enumerate(columns)), *LINEAGE, ORD, *(F.col(f"k{i}").alias(f"_kind{i}") for i, c in enumerate(columns) if types[c] == "code"))
    for i, c in enumerate(columns):
        if types[c] == "code":
            detail = pad_codes(detail.withColumn("_num", F.col(f"_kind{i}") == "n"), c, "_num", ORDER)
            padded = detail.where("padded").groupBy(FILE, SHEET).agg(F.count(F.lit(1)).alias("n"))
            issues.add_frame(padded.select(F.lit(INFO).alias(COLUMNS[0]), F.col(FILE).alias(COLUMNS[1]), F.col(SHEET).alias(COLUMNS[2]), F.lit(None).alias(COLUMNS[3]), F.lit(c).alias(COLUMNS[4]), F.lit("编码已补齐").alias(COLUMNS[5]), F.lit(None).alias(COLUMNS[6]), F.concat(F.lit("补齐前导零 "), "n", F.lit(" 处")).alias(COLUMNS[7])))
            detail = detail.drop("_num", "padded", f"_kind{i}")
    stem = F.regexp_replace(F.element_at(F.split(FILE, "/"), -1), r"\.[^.]*$", "")
    for c in (c for c in FILE_NAMED if c in columns):
        detail = rename_by_file(detail.withColumn("_st", stem), c, "_st", spec.name_from_file).persist()  # the log reads its flags too
        stored.append(detail)
        hit = detail.where("renamed").groupBy(FILE, SHEET).agg(F.count(F.lit(1)).alias("n"))
        issues.add_frame(hit.select(F.lit(WARNING).alias(COLUMNS[0]), F.col(FILE).alias(COLUMNS[1]), F.col(SHEET).alias(COLUMNS[2]), F.lit(None).alias(COLUMNS[3]), F.lit(c).alias(COLUMNS[4]), F.lit("文件名与内容不一致").alias(COLUMNS[5]), F.lit(None).alias(COLUMNS[6]), F.lit("内容与另一文件同名").alias(COLUMNS[7])))
        detail = detail.drop("_st", "renamed")
    return detail, types, sources


def _note_missing(tables: Tables, admitted: list, standard: list[str], issues: Issues) -> None:
    with_rows = {(r["file"], r["sheet"]) for r in tables.bronze.where("kind = 'row'").select("file", "sheet").distinct().collect()}  # one row a sheet
    for (file, name), gone in missing_columns({(f, s): set(filter(None, ts)) for f, s, _, ts in admitted}, with_rows, standard).items():
        issues.add(INFO, file, name, tables.header_rows[file, name], kind="缺少列", message=f"该 Sheet 缺少列：{'、'.join(gone)}（明细中留空）")


def _note_cells(cleaned: DataFrame, columns: list[str], dates: list[int], spec: TaskSpec, issues: Issues) -> None:
    """Counts of empty cells of summed or averaged columns, and of dates that got their year from elsewhere, for each sheet and column it has."""
    measured = {c for c, f in spec.aggregations if normalize_agg_func(f) in ("求和", "平均")}
    empty = {str(i): (F.get("at", F.lit(i)) >= 0) & F.col(f"c{i}.v").isNull() & F.col(f"c{i}.err").isNull() for i, c in enumerate(columns) if c in measured}
    no_year = {str(i): F.col(f"c{i}.v").isNotNull() & is_month_day(F.col(f"r{i}")) & (F.col(f"k{i}") == "t") for i in dates}
    year = F.col("_year").cast("string") if dates else F.lit(None)
    for flags, kind, words in ((empty, "空值", (" 个空值（未填写，如未盘点），汇总时不按 0 计算",)), (no_year, "日期补全年份", (" 个日期没写年份（如 9.30、9月30日），已按 ", year, " 年处理"))):
        if flags:
            found = count_cells(cleaned, [FILE, SHEET, "header_row", "heads", *(["_year"] if flags is no_year else [])], flags)
            text = F.concat(F.lit("有 "), F.col("n").cast("string"), *(F.lit(w) if isinstance(w, str) else w for w in words))
            issues.add_frame(found.select(F.lit(INFO).alias(COLUMNS[0]), F.col(FILE).alias(COLUMNS[1]), F.col(SHEET).alias(COLUMNS[2]), F.col("header_row").alias(COLUMNS[3]), F.get("heads", F.col("column").cast("int")).alias(COLUMNS[4]), F.lit(kind).alias(COLUMNS[5]), F.lit(None).alias(COLUMNS[6]), text.alias(COLUMNS[7])))


def _note_settings(spec: TaskSpec, detail: DataFrame, types: dict[str, str], issues: Issues) -> None:
    for c in empty_columns(detail, [c for c, _ in spec.aggregations]):
        issues.add(WARNING, column=c, kind="汇总设置", message=f"汇总列“{c}”在所有数据中都是空的，汇总结果为 0 或空；请检查是否选错了汇总列（例如盘点表通常汇总“账面数量”“实盘数量”）")
    for c in spec.group_by:
        if types.get(c) == "number":
            issues.add(WARNING, column=c, kind="汇总设置", message=f"分组列“{c}”是数值列，按它分组通常没有意义；数值列一般放在“汇总列”里求和")


def _with_year(cleaned: DataFrame, dates: list[int], today: dt.date, few: bool) -> DataFrame:
    """_year for dates without one: the sheet's most frequent year, else everyone's, else today's; first seen wins ties."""
    place = F.struct(*(F.col(o) for o in ORDER))
    full = reduce(DataFrame.unionByName, [cleaned.select(FILE, SHEET, place.alias("p"), F.year(f"c{i}.v").alias("y")) for i in dates]).where("y IS NOT NULL")
    votes = full.groupBy(FILE, SHEET, "y").agg((-F.count(F.lit(1))).alias("c"), F.min("p").alias("p"))
    by_sheet = votes.groupBy(FILE, SHEET).agg(F.min_by("y", F.struct("c", "p")).alias("_own"))
    world = votes.groupBy("y").agg(F.sum("c").alias("c"), F.min("p").alias("p")).agg(F.min_by("y", F.struct("c", "p")).alias("y")).first()
    return cleaned.join(F.broadcast(by_sheet) if few else by_sheet, [FILE, SHEET], "left").withColumn("_year", F.coalesce("_own", F.lit(world["y"] if world and world["y"] else today.year))).drop("_own")


def make_summary(spec: TaskSpec, detail: DataFrame, types: dict, sources: dict, store: AliasStore, issues: Issues) -> tuple[DataFrame, auto.AutoPlan | None, list]:
    aggs = check_aggs(detail, spec.aggregations, issues)
    plan = None
    if not aggs:
        plan = auto.make_plan(detail, {c: r for c, r in store.roles().items() if c in detail.columns}, types, (), sources)
        aggs = [(c, f) for c, f in plan.measures if c not in (*spec.group_by, spec.pivot_column)]
    if spec.pivot_column:
        return pivot_summarize(detail, spec.group_by, spec.pivot_column, aggs, issues), plan, aggs
    if spec.group_by:
        return summarize(detail, spec.group_by, aggs, issues, add_count=spec.add_count_column), plan, aggs
    plan = plan or auto.make_plan(detail, {c: r for c, r in store.roles().items() if c in detail.columns}, types, aggs, sources)
    return auto.summarize_auto(detail, plan, ORDER), plan, aggs


def run(spark: SparkSession, spec: TaskSpec, store: AliasStore | None = None, now: dt.datetime | None = None, export: bool = True) -> RunResult:
    """Read, map, clean, repair, de-duplicate, summarise; export if asked. Failures to write are issues."""
    store, issues, now = store or AliasStore(), Issues(), now or dt.datetime.now()
    if not folder_exists(spark, spec.input_folder):
        issues.add(ERROR, kind="文件读取失败", message=f"输入文件夹不存在：{spec.input_folder}")
        nothing = spark.createDataFrame([], f"`{FILE}` string, `{SHEET}` string, `{ROW}` int")
        return RunResult(nothing, summarize(nothing, [], []), issues.frame(spark))
    stored: list[DataFrame] = []
    detail, types, sources = build_detail(spark, spec, store, issues, now.date(), stored)
    marked = deduplicate(detail, "off" if spec.dedup_mode == "off" else "mark", spec.dedup_columns, ORDER, issues).persist()
    stored.append(marked)
    if spec.dedup_mode != "off":
        again, drop = marked.where("is_duplicate"), spec.dedup_mode == "drop"
        used = [c for c in spec.dedup_columns if c in detail.columns]
        by, kind, tail = "、".join(used) or "全部列", "重复记录已删除" if drop else "重复记录", " 行重复，已从明细和汇总中删除" if drop else " 行重复（已保留，仍计入汇总）"
        issues.add_frame(again.select(F.lit(WARNING).alias(COLUMNS[0]), F.col(FILE).alias(COLUMNS[1]), F.col(SHEET).alias(COLUMNS[2]), F.col(ROW).alias(COLUMNS[3]), F.lit("").alias(COLUMNS[4]), F.lit(kind).alias(COLUMNS[5]), F.lit(None).alias(COLUMNS[6]), F.concat(F.lit(f"按{by}与 "), f"first_place.`{FILE}`", F.lit(" 第 "), f"first_place.`{ROW}`", F.lit(tail)).alias(COLUMNS[7])))
        marked = (marked.where("NOT is_duplicate") if drop else marked).drop("is_duplicate", "first_place")
    _note_settings(spec, marked, types, issues)
    summary, plan, aggs = make_summary(spec, marked, types, sources, store, issues)
    shown = marked.orderBy(*ORDER).drop(ORD)
    result = RunResult(shown, summary, None, None, plan, stored=stored)
    if export:
        path = spec.output_path(f"汇总结果_{now:%Y%m%d_%H%M%S}.xlsx")
        values = split_values(marked, spec.split_by, issues) if spec.split_by else None
        extra = []
        for v, label in values or []:
            part = marked.where(F.col(f"`{spec.split_by}`").eqNullSafe(F.lit(v)))
            if spec.split_mode == "sheet":
                rows = part.orderBy(*ORDER).drop(ORD)
                extra.append((label, rows.columns, _with_subtotal(rows, part, spec.split_by, aggs)))
            else:
                result.outputs.append(_split_file(path, spec, part, label, aggs, issues, {o.lower() for o in result.outputs}))
        log = issues.frame(spark, ordered=False).persist()  # the sort reads it twice
        stored.append(log)
        try:
            write_xlsx(path, [sheet("汇总", summary), *extra, sheet("明细", shown), sheet("问题清单", in_order(log))])
            result.output_path = path
        except OSError as e:
            issues.add(ERROR, path, kind="文件读取失败", message=f"无法写入：{e}")
    result.issues = issues.frame(spark)
    return result


def _with_subtotal(rows: DataFrame, part: DataFrame, by: str, aggs: list):
    yield from rendered(rows)
    total = subtotals(part, by, aggs).first()
    if total is not None:
        sums = total.asDict()
        yield ["小计" if c == by else sums.get(c) for c in rows.columns]


def _split_file(path: str, spec: TaskSpec, part: DataFrame, label: str, aggs: list, issues: Issues, taken: set[str]) -> str:
    folder = f"{path[: -len('.xlsx')]}_按{spec.split_by}拆分"
    groups = [g for g in spec.group_by if g != spec.split_by] or [spec.split_by]
    pivoted = spec.pivot_column and spec.pivot_column != spec.split_by
    summary = pivot_summarize(part, groups, spec.pivot_column, aggs, Issues()) if pivoted else summarize(part, groups, aggs, Issues())
    out = f"{folder}/{safe_filename(label, {t.rpartition('/')[2].removesuffix('.xlsx') for t in taken})}.xlsx"
    write_xlsx(out, [sheet("汇总", summary), sheet("明细", part.orderBy(*ORDER).drop(ORD))])
    return out
