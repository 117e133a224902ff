"""The task specification: what the command line and JSON files say."""

from __future__ import annotations

import dataclasses
import json
import os
import tempfile
from dataclasses import dataclass, field


@dataclass
class TaskSpec:
    input_folder: str = ""
    recursive: bool = False
    excluded: list[str] = field(default_factory=list)
    header_rows: dict[str, int] = field(default_factory=dict)
    column_mapping: dict[str, str] = field(default_factory=dict)
    column_types: dict[str, str] = field(default_factory=dict)
    accept_pending: bool = True
    keep_unmatched: bool = True
    group_by: list[str] = field(default_factory=list)
    aggregations: list[tuple[str, str]] = field(default_factory=list)
    add_count_column: bool = False
    pivot_column: str = ""
    split_by: str = ""
    split_mode: str = "sheet"
    name_from_file: bool = True
    dedup_mode: str = "mark"
    dedup_columns: list[str] = field(default_factory=list)
    output_dir: str = ""
    output_name: str = ""
    version: int = 1

    @classmethod
    def from_dict(cls, data: dict) -> TaskSpec:
        """Unknown keys are ignored; aggregations may be {column: function} or a list of pairs or of objects."""
        known = {f.name for f in dataclasses.fields(cls)}
        d = {k: v for k, v in data.items() if k in known}
        aggs = d.get("aggregations", [])
        pairs = aggs.items() if isinstance(aggs, dict) else [(a["column"], a["func"]) if isinstance(a, dict) else tuple(a) for a in aggs]
        return cls(**d | {"aggregations": [tuple(p) for p in pairs]})

    @classmethod
    def load(cls, path: str) -> TaskSpec:
        with open(path, encoding="utf-8-sig") as f:
            return cls.from_dict(json.load(f))

    def save(self, path: str) -> None:
        folder = os.path.dirname(os.path.abspath(path))
        fd, tmp = tempfile.mkstemp(dir=folder, suffix=".tmp")
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            json.dump(dataclasses.asdict(self), f, ensure_ascii=False, indent=2)
        os.replace(tmp, path)

    def output_path(self, default_name: str) -> str:
        name = self.output_name or default_name
        name = name if name.lower().endswith(".xlsx") else name + ".xlsx"
        return os.path.join(self.output_dir or self.input_folder or ".", name)
