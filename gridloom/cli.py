"""Command line: build a task from flags over an optional JSON file, run it, print counts."""

from __future__ import annotations

import argparse
import re
import sys

from gridloom.operators.aggregate import normalize_agg_func
from gridloom.operators.schema import AliasStore
from gridloom.plans.config import TaskSpec


def _list(text: str) -> list[str]:
    return [x.strip() for x in re.split("[,，]", text) if x.strip()]


def _pair(text: str) -> tuple[str, str]:
    a, _, b = text.replace("：", ":").rpartition(":") if ":" in text.replace("：", ":") else (text, "", "求和")
    return a.strip(), b.strip()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gridloom")
    p.add_argument("-i", "--input")
    p.add_argument("-r", "--recursive", action="store_true")
    p.add_argument("-c", "--config")
    p.add_argument("--save-config")
    p.add_argument("-g", "--group-by", type=_list, action="extend")
    p.add_argument("-s", "--sum", type=_list, action="extend", default=[])
    p.add_argument("-a", "--agg", action="append", default=[])
    p.add_argument("--count-column", action="store_true")
    p.add_argument("--pivot")
    p.add_argument("--split")
    p.add_argument("--split-mode", choices=("sheet", "file"))
    p.add_argument("--role", action="append", default=[])
    p.add_argument("--keep-name-in-table", action="store_true")
    p.add_argument("--dedup", choices=("off", "mark", "drop"))
    p.add_argument("--dedup-cols", type=_list, action="extend")
    p.add_argument("-m", "--map", action="append", default=[])
    p.add_argument("--type", action="append", default=[])
    p.add_argument("--header-row", action="append", default=[])
    p.add_argument("--exclude", action="append", default=[])
    p.add_argument("--strict-mapping", action="store_true")
    p.add_argument("--drop-unmatched", action="store_true")
    p.add_argument("-o", "--output")
    p.add_argument("--alias-file")
    p.add_argument("--learn", action="append", default=[])
    p.add_argument("--show-mapping", action="store_true")
    return p


def spec_from_args(a: argparse.Namespace) -> TaskSpec:
    spec = TaskSpec.load(a.config) if a.config else TaskSpec()
    spec.input_folder = a.input or spec.input_folder
    spec.recursive |= a.recursive
    spec.group_by = a.group_by if a.group_by is not None else spec.group_by
    aggs = [(c, "求和") for c in a.sum] + [_pair(x) for x in a.agg]
    spec.aggregations = aggs or spec.aggregations
    spec.add_count_column |= a.count_column
    spec.pivot_column, spec.split_by, spec.split_mode = a.pivot or spec.pivot_column, a.split or spec.split_by, a.split_mode or spec.split_mode
    spec.name_from_file &= not a.keep_name_in_table
    spec.dedup_mode, spec.dedup_columns = a.dedup or spec.dedup_mode, a.dedup_cols if a.dedup_cols is not None else spec.dedup_columns
    spec.column_mapping |= dict(x.partition("=")[::2] for x in a.map)
    spec.column_types |= dict(x.partition("=")[::2] for x in a.type)
    spec.header_rows |= {k: int(v) for k, v in (x.rsplit("=", 1) for x in a.header_row)}
    spec.excluded += a.exclude
    spec.accept_pending &= not a.strict_mapping
    spec.keep_unmatched &= not a.drop_unmatched
    if a.output:
        folder, _, name = a.output.rpartition("/")
        spec.output_dir, spec.output_name = (folder, name) if name.lower().endswith(".xlsx") else (a.output, spec.output_name)
    return spec


def main(argv: list[str] | None = None) -> int:
    """0: done; 1: nothing written; 2: the task is wrong."""
    try:
        a = parser().parse_args(argv)
        spec = spec_from_args(a)
        if not spec.input_folder or any(normalize_agg_func(f) is None for _, f in spec.aggregations):
            raise ValueError("an input folder and known functions are needed")
        store = AliasStore(a.alias_file)
        for x in a.role:
            store.learn_role(*x.partition("=")[::2])
        for x in a.learn:
            store.learn(*x.partition("=")[::2])
        if (a.learn or a.role) and a.alias_file:
            store.save()
        if a.save_config:
            spec.save(a.save_config)
    except (OSError, ValueError) as e:
        print(e, file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    from gridloom.plans.issues import Issues
    from gridloom.plans.pipeline import plan_tables, run

    spark = SparkSession.builder.appName("gridloom").getOrCreate()
    if a.show_mapping:
        for file, sheet, _, found in plan_tables(spark, spec, store, Issues()).plans:
            for s in found:
                print(file, sheet, s.source, s.target or "-", s.score, s.status, sep="\t")
        return 0
    result = run(spark, spec, store)
    for r in result.issues.groupBy("严重程度").count().collect():
        print(r[0], r[1])
    print(result.output_path or "-")
    return 0 if result.output_path else 1


if __name__ == "__main__":
    sys.exit(main())
