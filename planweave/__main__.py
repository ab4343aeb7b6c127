"""`python -m planweave parse FILE` and `compare BEFORE AFTER`, each with -o FILE: JSON of an export or of a comparison.

Both put one document together in the driver; comparisons that do not fit there
are written by planweave.compare.Comparison.write().
"""

from __future__ import annotations

import argparse
import json
import sys
from collections import defaultdict

from pyspark.sql import Row, SparkSession

from planweave.compare import compare_files
from planweave.operators.normalize import ACTIVITY, CALENDAR, PROJECT, RELATIONSHIP, WBS, last_wins, normalize
from planweave.sources.xer import parse


def _plain(row: Row | None, columns: dict[str, str], src: str | None = "source_record") -> dict | None:
    if row is None:
        return None
    out = {c: row[c] for c in columns}
    if "extras" in row.__fields__ and row.extras:
        out |= row.extras
    if src:
        out[src] = row.src and row.src.asDict()
    return out


def export_document(spark: SparkSession, path: str) -> dict:
    """An export as one nested document: projects with their breakdown as trees and edges with both their activities, unknown tables, diagnostics."""
    raw = parse(spark, path)
    own = normalize(raw)
    found = {r.activity_id: r for r in last_wins(own.activities.where("activity_id <> ''"), ["activity_id"], "act_seq").collect()}
    parts: dict[str, dict] = {name: defaultdict(list) for name in ("wbs", "activities", "relationships", "calendars")}
    for name, seq in (("wbs", "wbs_seq"), ("activities", "act_seq"), ("relationships", "rel_seq"), ("calendars", "cal_seq")):
        for r in getattr(own, name).orderBy(seq).collect():
            parts[name][r.project_id].append(r)
    projects = []
    for p in own.projects.orderBy("project_seq").collect():
        nodes = [(r, _plain(r, WBS, None) | {"children": []}) for r in parts["wbs"][p.project_id]]
        by_id = {r.wbs_id: node for r, node in nodes if r.wbs_id}
        roots = []
        for r, node in nodes:
            above = by_id.get(r.parent_wbs_id)
            (roots if above is None or above is node else above["children"]).append(node)
        activities = [_plain(r, ACTIVITY) | {"is_milestone": r.is_milestone} for r in parts["activities"][p.project_id]]
        edges = [
            _plain(r, RELATIONSHIP) | {"resolved": r.resolved, "predecessor": _plain(found.get(r.predecessor_id), ACTIVITY), "successor": _plain(found.get(r.successor_id), ACTIVITY)}
            for r in parts["relationships"][p.project_id]
        ]
        calendars = [_plain(r, CALENDAR, None) for r in parts["calendars"][p.project_id]]
        projects.append({"metadata": _plain(p, PROJECT), "wbs": roots, "activities": activities, "relationships": edges, "calendars": calendars})
    unknown: dict[str, list] = defaultdict(list)
    for r in raw.unknown_tables.orderBy("table", "rec_idx").collect():
        unknown[r.table].append(r.rec)
    said = [{"line_number": r.line_number, "message": r.message, "raw_line": r.raw_line} for r in raw.diagnostics.orderBy("line_number").collect()]
    return {"projects": projects, "unknown_tables": unknown, "diagnostics": said}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="planweave")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, files in (("parse", ["source"]), ("compare", ["before", "after"])):
        one = commands.add_parser(name)
        for f in files:
            one.add_argument(f)
        one.add_argument("-o", "--output")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.config("spark.ui.showConsoleProgress", "false").getOrCreate()
    found = export_document(spark, args.source) if args.command == "parse" else compare_files(spark, args.before, args.after)
    text = json.dumps(found, indent=2, ensure_ascii=False) + "\n"
    if args.output:
        with open(args.output, "w", encoding="utf-8") as out:
            out.write(text)
    else:
        sys.stdout.write(text)
    return 0


if __name__ == "__main__":
    sys.exit(main())
