"""Queries over the driver's tables for each operator, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import clean
from gridloom.functions.natural import natural_key_udf
from gridloom.operators import auto, schema
from gridloom.operators.aggregate import subtotals, summarize
from gridloom.operators.dedup import deduplicate
from gridloom.operators.extract import build_table
from gridloom.operators.notes import count_cells
from gridloom.operators.pivot import pivot_summarize, split_values
from gridloom.operators.repair import dominant_year, pad_codes, rename_by_file
from gridloom.operators.union import union_mapped
from gridloom.plans.issues import Issues


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _round(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(f"`{c}`", 2) for c in columns})


def summarize_sum_total(spark, sf):
    return _round(summarize(_t(spark, sf, "lineitem"), ["l_returnflag"], [("l_extendedprice", "求和")], add_count=True, ordered=False), "l_extendedprice(求和)")


def summarize_multi_group(spark, sf):
    return _round(summarize(_t(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], [("l_quantity", "sum"), ("l_discount", "mean")], ordered=False), "l_quantity(求和)", "l_discount(平均)")


def summarize_all_funcs(spark, sf):
    aggs = [("value", f) for f in ("求和", "计数", "平均", "最大", "最小")]
    return _round(summarize(_t(spark, sf, "events"), ["event_type"], aggs, ordered=False), "value(求和)", "value(平均)", "value(最大)", "value(最小)")


def summarize_date_max(spark, sf):
    out = summarize(_t(spark, sf, "orders"), ["o_orderstatus"], [("o_orderdate", "最大"), ("o_orderdate", "最小")], ordered=False)
    return out.select("o_orderstatus", F.date_format("`o_orderdate(最大)`", "yyyy-MM-dd").alias("last"), F.date_format("`o_orderdate(最小)`", "yyyy-MM-dd").alias("first"))


def summarize_null_group(spark, sf):
    orders = _t(spark, sf, "orders").withColumn("o_orderpriority", F.expr("nullif(o_orderpriority, '1-URGENT')"))
    return _round(summarize(orders, ["o_orderpriority"], [("o_totalprice", "求和")], ordered=False), "o_totalprice(求和)")


def summarize_no_group(spark, sf):
    return _round(summarize(_t(spark, sf, "orders"), [], [("o_totalprice", "求和")]), "o_totalprice(求和)")


def summarize_count_only(spark, sf):
    return summarize(_t(spark, sf, "customer"), ["c_mktsegment"], [], ordered=False)


def summarize_empty_measure(spark, sf):
    orders = _t(spark, sf, "orders").withColumn("m", F.lit(None).cast("double"))
    return summarize(orders, ["o_orderstatus"], [("m", "求和"), ("m", "平均"), ("m", "最大")], ordered=False)


def summarize_bad_requests(spark, sf):
    return summarize(_t(spark, sf, "customer"), ["nowhere", "c_mktsegment"], [("c_acctbal", "中位数"), ("gone", "求和")], Issues(), ordered=False)


def pivot_single(spark, sf):
    return _round(pivot_summarize(_t(spark, sf, "lineitem"), ["l_returnflag"], "l_linestatus", [("l_extendedprice", "求和")], ordered=False), "F", "O", "合计")


def pivot_multi(spark, sf):
    out = pivot_summarize(_t(spark, sf, "lineitem"), ["l_returnflag"], "l_linestatus", [("l_quantity", "求和"), ("l_tax", "最大")], ordered=False)
    return _round(out, *(c for c in out.columns if c != "l_returnflag"))


def pivot_count(spark, sf):
    return pivot_summarize(_t(spark, sf, "orders"), ["o_orderpriority"], "o_orderstatus", [], ordered=False)


def pivot_no_group(spark, sf):
    return _round(pivot_summarize(_t(spark, sf, "orders"), [], "o_orderstatus", [("o_totalprice", "求和")]), "F", "O", "P", "合计")


def pivot_avg_margins(spark, sf):
    return _round(pivot_summarize(_t(spark, sf, "lineitem"), ["l_returnflag"], "l_linestatus", [("l_quantity", "平均")], ordered=False), "F", "O", "合计")


def _ordered_lines(spark, sf):
    return _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")


ORDER = ["l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]


def dedup_mark_keys(spark, sf):
    d = deduplicate(_ordered_lines(spark, sf), "mark", ["l_orderkey", "l_linenumber"], ORDER)
    return d.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("is_duplicate").cast("int").alias("dup"), F.col("first_place.l_partkey").alias("first_part"))


def dedup_drop_keys(spark, sf):
    return deduplicate(_ordered_lines(spark, sf), "drop", ["l_orderkey", "l_linenumber"], ORDER).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def dedup_drop_all(spark, sf):
    docs = _t(spark, sf, "documents").select("doc_id", "text", "lang")
    return deduplicate(docs, "drop", ["text"], ["doc_id"]).select("doc_id", "lang")


def split_subtotals(spark, sf):
    return _round(subtotals(_t(spark, sf, "orders"), "o_orderstatus", [("o_totalprice", "求和"), ("o_custkey", "计数")]), "o_totalprice")


def auto_summary_key_entity(spark, sf):
    lines = _t(spark, sf, "lineitem").where("l_partkey IS NOT NULL")
    plan = auto.AutoPlan("l_partkey", [], ["l_suppkey"], [("l_quantity", "求和"), ("l_extendedprice", "求和")])
    return _round(auto.summarize_auto(lines, plan, ["l_orderkey", "l_linenumber"]), "l_quantity", "l_extendedprice")


def auto_name_vote(spark, sf):
    return auto.summarize_auto(_t(spark, sf, "orders"), auto.AutoPlan("o_custkey", ["o_orderpriority"], [], []), ["o_orderkey"])


def auto_plan(spark, sf):
    types = {"l_partkey": "code", "l_quantity": "number", "l_discount": "number", "l_returnflag": "text"}
    plan = auto.make_plan(_t(spark, sf, "lineitem"), {"l_discount": "rate"}, types)
    return _round(auto.summarize_auto(_t(spark, sf, "lineitem"), plan, ["l_orderkey"]), "l_quantity")


_DIRTY_NUMBER = """CASE l_linenumber % 5
 WHEN 0 THEN concat(format_number(l_extendedprice, 2), '元') WHEN 1 THEN concat('￥', cast(cast(l_extendedprice as decimal(20,2)) as string))
 WHEN 2 THEN concat('(', cast(cast(l_extendedprice as decimal(20,2)) as string), ')') WHEN 3 THEN concat(translate(cast(cast(l_extendedprice as decimal(20,2)) as string), '0123456789', '０１２３４５６７８９'), 'kg')
 ELSE '约12元' END"""


def clean_number_roundtrip(spark, sf):
    d = _t(spark, sf, "lineitem").withColumn("n", clean.to_number(F.expr(_DIRTY_NUMBER)))
    return d.select("l_orderkey", "l_linenumber", "l_partkey", F.round("n.v", 2).alias("v"), F.when(F.col("n.err").isNotNull(), 1).otherwise(0).alias("bad"))


_DIRTY_DATE = """CASE o_orderkey % 6 WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') WHEN 1 THEN date_format(o_orderdate, 'yyyy年M月d日') WHEN 2 THEN date_format(o_orderdate, 'yyyyMMdd')
 WHEN 3 THEN date_format(o_orderdate, 'yyyy/M/d') WHEN 4 THEN cast(datediff(o_orderdate, DATE'1899-12-30') as string) ELSE date_format(o_orderdate, 'yyyy.MM.dd 08:30:00') END"""


def clean_date_roundtrip(spark, sf):
    d = _t(spark, sf, "orders").withColumn("d", clean.to_date(F.expr(_DIRTY_DATE)))
    return d.select("o_orderkey", F.date_format("d.v", "yyyy-MM-dd").alias("day"), F.date_format("d.v", "HH:mm").alias("hour"))


def clean_number_cells(spark, sf):
    """Amounts as cells of each kind: text, number, date, boolean."""
    cells = _t(spark, sf, "orders").selectExpr("o_orderkey", "CASE o_orderkey % 4 WHEN 0 THEN concat(cast(o_orderkey as string), '元') WHEN 1 THEN cast(o_orderkey as string) WHEN 2 THEN '2026-01-02' ELSE 'True' END AS c", "substr('tndb', cast(o_orderkey % 4 as int) + 1, 1) AS k")
    return cells.withColumn("n", clean.to_number(F.col("c"), F.col("k"))).select("o_orderkey", F.col("n.v").alias("v"), F.col("n.err").alias("err"))


def clean_date_cells(spark, sf):
    """Dates as cells of each kind; number cells are day numbers or eight digits, never month and day."""
    text = "CASE o_orderkey % 5 WHEN 0 THEN '9.30' WHEN 1 THEN '12.5' WHEN 2 THEN date_format(o_orderdate, 'yyyyMMdd') WHEN 3 THEN cast(datediff(o_orderdate, DATE'1899-12-30') as string) ELSE '06:00:00' END AS c"
    cells = _t(spark, sf, "orders").selectExpr("o_orderkey", text, "substr('tnnnm', cast(o_orderkey % 5 as int) + 1, 1) AS k")
    return cells.withColumn("d", clean.to_date(F.col("c"), F.lit(2024), F.col("k"))).select("o_orderkey", F.date_format("d.v", "yyyy-MM-dd").alias("day"), F.col("d.err").alias("err"))


def typed_columns(spark, sf):
    """Types of columns by dictionary, override and summed column, whatever name the function goes by."""
    types = schema.column_types(["金额", "x", "y", "z", "日期"], schema.AliasStore(), {"z": "code"}, [("x", "mean"), ("y", "计数")])
    return spark.createDataFrame(sorted(types.items()), "name string, type string")


def drop_repeats_log(spark, sf):
    """What is dropped as a repeat, with the place of the row that stays."""
    d = deduplicate(_t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus"), "mark", ["l_orderkey", "l_returnflag", "l_linestatus"], ["l_linenumber"])
    return d.where("is_duplicate").groupBy("l_orderkey", F.col("first_place.l_linenumber").alias("first_line")).agg(F.count(F.lit(1)).alias("n"))


def clean_code(spark, sf):
    return _t(spark, sf, "part").select("p_partkey", clean.to_code(F.concat(F.lit("  ="), F.lit('"'), F.lower("p_brand"), F.lit(" x"), F.lit('"')))["v"].alias("code"))


def clean_text(spark, sf):
    return _t(spark, sf, "customer").select("c_custkey", clean.to_text(F.expr("if(c_custkey % 3 = 0, ' N/A ', concat('  ', c_name, '　'))"))["v"].alias("name"))


def pad_codes_width(spark, sf):
    codes = _t(spark, sf, "part").selectExpr("p_partkey", "if(p_partkey % 2 = 0, lpad(cast(p_partkey as string), 7, '0'), cast(p_partkey as string)) AS code", "p_partkey % 2 = 1 AS is_number")
    return pad_codes(codes, "code", "is_number", ["p_partkey"]).select("p_partkey", "code")


def union_mapped_headers(spark, sf):
    lines = _t(spark, sf, "lineitem")
    parts = [
        lines.where("l_linenumber = 1").selectExpr("l_orderkey AS `单号`", "l_quantity AS `数量`", "l_extendedprice AS `金额`"),
        lines.where("l_linenumber = 2").selectExpr("l_extendedprice AS `Amount`", "l_quantity AS `QTY`", "l_orderkey AS `订单号`"),
        lines.where("l_linenumber >= 3").selectExpr("l_orderkey AS `单据编号`", "l_extendedprice AS `金额（元）`"),
    ]
    return union_mapped(parts, schema.AliasStore()).select(F.col("单号").alias("order_id"), F.col("数量").alias("qty"), F.col("金额").alias("amount"))


def year_vote(spark, sf):
    return dominant_year(_t(spark, sf, "orders"), "o_orderdate", ["o_orderstatus"], ["o_orderkey"])


def natural_sort_rank(spark, sf):
    names = _t(spark, sf, "supplier").selectExpr("s_suppkey", "concat('仓', cast(s_suppkey as string), '号') AS name")
    from pyspark.sql import Window

    return names.withColumn("rank", F.row_number().over(Window.orderBy(natural_key_udf("name")))).select("s_suppkey", "rank")


def issues_counts(spark, sf):
    issues = Issues()
    e = _t(spark, sf, "events").withColumn("n", clean.to_number(F.expr("if(event_id % 10 = 0, '很多', cast(event_id as string))")))
    issues.add_frame(e.where("n.err IS NOT NULL").selectExpr("'错误' AS `严重程度`", "'events' AS `文件`", "'' AS `Sheet`", "cast(event_id as int) AS `行号`", "'value' AS `列名`", "'数值无法转换' AS `问题类型`", "'很多' AS `原始值`", "n.err AS `说明`"))
    issues.add("警告", "events", kind="汇总设置", message="x")
    return issues.counts(spark).select(F.col("严重程度").alias("severity"), "n")


def note_empty_cells(spark, sf):
    """Empty cells of two measures for each slice."""
    lines = _t(spark, sf, "lineitem").selectExpr("l_returnflag", "l_shipdate", "nullif(l_discount, 0) AS l_discount", "nullif(l_tax, 0) AS l_tax")
    return count_cells(lines, ["l_returnflag"], {c: F.col(c).isNull() for c in ("l_discount", "l_tax")})


def extract_tables(spark, sf):
    """Suppliers as grids, one a nation, with a title, a repeated header, a total row and a note; the tables' rows come back."""
    grids = _t(spark, sf, "supplier").groupBy("s_nationkey").agg(F.sort_array(F.collect_list(F.struct("s_suppkey", "s_name"))).alias("rows"))

    def parse(frames):
        import pandas as pd

        for frame in frames:
            out = []
            for nation, rows in zip(frame["s_nationkey"], frame["rows"]):
                cells = [[str(r["s_suppkey"]), r["s_name"], "x", None] for r in rows]
                half = len(cells) // 2
                grid = [["名单", None, None, None], ["编码", "名称", "备注", "空"], *cells[:half], ["名称", "编码", "备注", "空"], *([b, a, c, d] for a, b, c, d in cells[half:]), ["1", "合计", None, None], ["制表人甲", None, None, None]]
                out += [(nation, int(c[0]), c[1]) for kind, _, c, _ in build_table(grid) if kind == "row"]
            yield pd.DataFrame(out, columns=["nation", "suppkey", "name"]).astype({"nation": "int32", "suppkey": "int64"})

    return grids.mapInPandas(parse, "nation int, suppkey long, name string")


def split_partitions(spark, sf):
    parts = split_values(_t(spark, sf, "orders").withColumn("o_orderstatus", F.expr("nullif(o_orderstatus, 'P')")), "o_orderstatus")
    return spark.createDataFrame([(k, label) for k, (_, label) in enumerate(parts)], "place int, label string")


def rename_files(spark, sf):
    """Customers of segments as files that hold one name each; where that is another file's, the own one replaces it."""
    files = _t(spark, sf, "customer").selectExpr("c_custkey", "c_mktsegment AS stem", "if(c_mktsegment = 'BUILDING', 'MACHINERY', if(c_mktsegment = 'FURNITURE', 'ELSEWHERE', c_mktsegment)) AS name")
    return rename_by_file(files, "name", "stem").select("c_custkey", "name", F.col("renamed").cast("int").alias("renamed"))


def distinct_values(spark, sf):
    """Distinct business rows: duplicates dropped over all columns but the lineage."""
    rows = _t(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_orderkey").alias("原始行号"))
    return deduplicate(rows, "drop", [], ["原始行号"]).select("l_returnflag", "l_linestatus")


def consolidate_flagship(spark, sf):
    """Three differently headed slices, mapped, cleaned, de-duplicated and summarised with a grand total."""
    lines = _t(spark, sf, "lineitem").withColumn("dirty", F.expr("concat(format_number(l_extendedprice, 2), '元')"))
    parts = [
        lines.where("l_linenumber % 3 = 0").selectExpr("l_returnflag AS `类别`", "dirty AS `金额`", "l_orderkey AS `单号`", "l_linenumber AS `行`"),
        lines.where("l_linenumber % 3 = 1").selectExpr("dirty AS `Total Amount`", "l_orderkey AS `订单编号`", "l_returnflag AS `分类`", "l_linenumber AS `行`"),
        lines.where("l_linenumber % 3 = 2").selectExpr("l_orderkey AS `流水号`", "l_returnflag AS `品类`", "dirty AS `销售额`", "l_linenumber AS `行`"),
    ]
    detail = union_mapped(parts, schema.AliasStore()).withColumn("金额", clean.to_number(F.col("金额"))["v"])
    kept = deduplicate(detail, "drop", ["单号", "行"], ["金额", "类别"])
    out = summarize(kept, ["类别"], [("金额", "求和")], add_count=True, ordered=False)
    return out.select(F.col("类别").alias("flag"), F.round("`金额(求和)`", 2).alias("amount"), F.col("记录数").alias("n"))


def queries() -> dict:
    names = [summarize_sum_total, summarize_multi_group, summarize_all_funcs, summarize_date_max, summarize_null_group, summarize_no_group, summarize_count_only, summarize_empty_measure, summarize_bad_requests, pivot_single, pivot_multi, pivot_count, pivot_no_group, pivot_avg_margins, dedup_mark_keys, dedup_drop_keys, dedup_drop_all, split_subtotals, auto_summary_key_entity, auto_name_vote, auto_plan, clean_number_roundtrip, clean_date_roundtrip, clean_number_cells, clean_date_cells, typed_columns, drop_repeats_log, clean_code, clean_text, pad_codes_width, union_mapped_headers, year_vote, natural_sort_rank, issues_counts, note_empty_cells, extract_tables, split_partitions, rename_files, distinct_values, consolidate_flagship]
    return {f.__name__: f for f in names}


def _total(key: str) -> str:
    return f"CASE WHEN grouping({key}) = 1 THEN '总计' ELSE coalesce({key}, '(空)') END AS {key}"


def oracle_sql() -> dict[str, str]:
    lines = "SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS rn, first_value(l_partkey) OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS fp FROM lineitem"
    return {
        "summarize_sum_total": f'SELECT {_total("l_returnflag")}, round(sum(l_extendedprice), 2) AS "l_extendedprice(求和)", count(*) AS "记录数" FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), ())',
        "summarize_multi_group": f"""SELECT {_total("l_returnflag")}, CASE WHEN grouping(l_returnflag) = 1 THEN '' ELSE l_linestatus END AS l_linestatus, round(sum(l_quantity), 2) AS "l_quantity(求和)", round(avg(l_discount), 2) AS "l_discount(平均)" FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), ())""",
        "summarize_all_funcs": f'SELECT {_total("event_type")}, round(sum(value), 2) AS "value(求和)", count(value) AS "value(计数)", round(avg(value), 2) AS "value(平均)", round(max(value), 2) AS "value(最大)", round(min(value), 2) AS "value(最小)" FROM events GROUP BY GROUPING SETS ((event_type), ())',
        "summarize_date_max": f"SELECT {_total('o_orderstatus')}, strftime(max(o_orderdate), '%Y-%m-%d') AS last, strftime(min(o_orderdate), '%Y-%m-%d') AS first FROM orders GROUP BY GROUPING SETS ((o_orderstatus), ())",
        "summarize_null_group": f"WITH o AS (SELECT nullif(o_orderpriority, '1-URGENT') AS o_orderpriority, o_totalprice FROM orders) SELECT {_total('o_orderpriority')}, round(sum(o_totalprice), 2) AS \"o_totalprice(求和)\" FROM o GROUP BY GROUPING SETS ((o_orderpriority), ())",
        "summarize_no_group": "SELECT '总计' AS \"项目\", round(sum(o_totalprice), 2) AS \"o_totalprice(求和)\" FROM orders",
        "summarize_count_only": f'SELECT {_total("c_mktsegment")}, count(*) AS "记录数" FROM customer GROUP BY GROUPING SETS ((c_mktsegment), ())',
        "summarize_bad_requests": f'SELECT {_total("c_mktsegment")}, count(*) AS "记录数" FROM customer GROUP BY GROUPING SETS ((c_mktsegment), ())',
        "summarize_empty_measure": f'SELECT {_total("o_orderstatus")}, CAST(0 AS DOUBLE) AS "m(求和)", CAST(NULL AS DOUBLE) AS "m(平均)", CAST(NULL AS DOUBLE) AS "m(最大)" FROM orders GROUP BY GROUPING SETS ((o_orderstatus), ())',
        "pivot_single": f'SELECT {_total("l_returnflag")}, round(sum(l_extendedprice) FILTER (WHERE l_linestatus = \'F\'), 2) AS "F", round(sum(l_extendedprice) FILTER (WHERE l_linestatus = \'O\'), 2) AS "O", round(sum(l_extendedprice), 2) AS "合计" FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), ())',
        "pivot_multi": f"""SELECT {_total("l_returnflag")}, {", ".join(f'''round(sum(l_quantity) FILTER (WHERE l_linestatus = '{k}'), 2) AS "{k}·l_quantity(求和)", round(max(l_tax) FILTER (WHERE l_linestatus = '{k}'), 2) AS "{k}·l_tax(最大)"''' for k in "FO")}, round(sum(l_quantity), 2) AS "合计·l_quantity(求和)", round(max(l_tax), 2) AS "合计·l_tax(最大)" FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), ())""",
        "pivot_count": f"""SELECT {_total("o_orderpriority")}, {", ".join(f'''nullif(count(*) FILTER (WHERE o_orderstatus = '{k}'), 0) AS "{k}"''' for k in "FOP")}, count(*) AS "合计" FROM orders GROUP BY GROUPING SETS ((o_orderpriority), ())""",
        "pivot_no_group": """SELECT '总计' AS "项目", """ + ", ".join(f"""round(sum(o_totalprice) FILTER (WHERE o_orderstatus = '{k}'), 2) AS "{k}\"""" for k in "FOP") + ', round(sum(o_totalprice), 2) AS "合计" FROM orders',
        "pivot_avg_margins": f"""SELECT {_total("l_returnflag")}, {", ".join(f'''round(avg(l_quantity) FILTER (WHERE l_linestatus = '{k}'), 2) AS "{k}"''' for k in "FO")}, round(avg(l_quantity), 2) AS "合计" FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), ())""",
        "dedup_mark_keys": f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(rn > 1 AS INTEGER) AS dup, CASE WHEN rn > 1 THEN fp END AS first_part FROM ({lines})",
        "dedup_drop_keys": f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM ({lines}) WHERE rn = 1",
        "dedup_drop_all": "SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1",
        "split_subtotals": "SELECT coalesce(o_orderstatus, '(空)') AS o_orderstatus, '小计' AS row_label, round(sum(o_totalprice), 2) AS o_totalprice, count(o_custkey) AS o_custkey FROM orders GROUP BY o_orderstatus",
        "auto_summary_key_entity": "SELECT CASE WHEN grouping(l_partkey) = 1 THEN '总计' ELSE CAST(l_partkey AS VARCHAR) END AS l_partkey, count(DISTINCT l_suppkey) AS \"出现l_suppkey数\", round(sum(l_quantity), 2) AS l_quantity, round(sum(l_extendedprice), 2) AS l_extendedprice FROM lineitem WHERE l_partkey IS NOT NULL GROUP BY GROUPING SETS ((l_partkey), ())",
        "auto_name_vote": "WITH v AS (SELECT o_custkey, o_orderpriority, count(*) AS n, min(o_orderkey) AS p FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, p) AS r FROM v) SELECT CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderpriority FROM b WHERE r = 1 UNION ALL SELECT '总计', NULL",
        "auto_plan": "SELECT CASE WHEN grouping(l_partkey) = 1 THEN '总计' ELSE CAST(l_partkey AS VARCHAR) END AS l_partkey, round(sum(l_quantity), 2) AS l_quantity FROM lineitem GROUP BY GROUPING SETS ((l_partkey), ())",
        "clean_number_roundtrip": "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 5 = 4 THEN NULL WHEN l_linenumber % 5 = 2 THEN -round(l_extendedprice, 2) ELSE round(l_extendedprice, 2) END AS v, CAST(l_linenumber % 5 = 4 AS INTEGER) AS bad FROM lineitem",
        "clean_date_roundtrip": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, CASE WHEN o_orderkey % 6 = 5 THEN '08:30' ELSE '00:00' END AS hour FROM orders",
        "clean_number_cells": f"SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 2 THEN CAST(o_orderkey AS DOUBLE) END AS v, CASE o_orderkey % 4 WHEN 2 THEN '{clean.ERR_NUMBER_DATE}' WHEN 3 THEN '{clean.ERR_NUMBER_BOOL}' END AS err FROM orders",
        "clean_date_cells": f"SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '2024-09-30' WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 3 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day, CASE o_orderkey % 5 WHEN 1 THEN '{clean.ERR_SMALL_CELL}' WHEN 4 THEN '{clean.ERR_DATE_TIME}' END AS err FROM orders",
        "typed_columns": "SELECT * FROM (VALUES ('金额', 'number'), ('x', 'number'), ('y', 'auto'), ('z', 'code'), ('日期', 'date')) v(name, type)",
        "drop_repeats_log": "WITH f AS (SELECT l_orderkey, l_linenumber, min(l_linenumber) OVER (PARTITION BY l_orderkey, l_returnflag, l_linestatus) AS first_line FROM lineitem) SELECT l_orderkey, first_line, count(*) AS n FROM f WHERE l_linenumber > first_line GROUP BY ALL",
        "clean_code": "SELECT p_partkey, upper(replace(p_brand, ' ', '')) || 'X' AS code FROM part",
        "clean_text": "SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS name FROM customer",
        "pad_codes_width": "SELECT p_partkey, lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS code FROM part",
        "union_mapped_headers": "SELECT CAST(l_orderkey AS BIGINT) AS order_id, CASE WHEN l_linenumber < 3 THEN l_quantity END AS qty, l_extendedprice AS amount FROM lineitem",
        "year_vote": "WITH v AS (SELECT o_orderstatus, CAST(year(o_orderdate) AS INTEGER) AS y, count(*) AS n, min(o_orderkey) AS p FROM orders GROUP BY ALL) SELECT o_orderstatus, y AS year FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY n DESC, p) AS r FROM v) WHERE r = 1",
        "natural_sort_rank": "SELECT s_suppkey, CAST(row_number() OVER (ORDER BY s_suppkey) AS INTEGER) AS rank FROM supplier",
        "issues_counts": "SELECT '错误' AS severity, count(*) AS n FROM events WHERE event_id % 10 = 0 UNION ALL SELECT '警告', 1",
        "note_empty_cells": """SELECT l_returnflag, 'l_discount' AS "column", count(*) AS n FROM lineitem WHERE l_discount = 0 GROUP BY ALL UNION ALL SELECT l_returnflag, 'l_tax', count(*) FROM lineitem WHERE l_tax = 0 GROUP BY ALL""",
        "extract_tables": "SELECT s_nationkey AS nation, s_suppkey AS suppkey, s_name AS name FROM supplier",
        "split_partitions": "SELECT CAST(row_number() OVER (ORDER BY s NULLS LAST) - 1 AS INTEGER) AS place, coalesce(s, '(空)') AS label FROM (SELECT DISTINCT nullif(o_orderstatus, 'P') AS s FROM orders)",
        "rename_files": "SELECT c_custkey, CASE WHEN c_mktsegment = 'FURNITURE' THEN 'ELSEWHERE' ELSE c_mktsegment END AS name, CAST(c_mktsegment = 'BUILDING' AS INTEGER) AS renamed FROM customer",
        "distinct_values": "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem",
        "consolidate_flagship": "WITH k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY round(l_extendedprice, 2), l_returnflag) AS rn FROM lineitem) WHERE rn = 1) SELECT CASE WHEN grouping(l_returnflag) = 1 THEN '总计' ELSE l_returnflag END AS flag, round(sum(round(l_extendedprice, 2)), 2) AS amount, count(*) AS n FROM k GROUP BY GROUPING SETS ((l_returnflag), ())",
    }
