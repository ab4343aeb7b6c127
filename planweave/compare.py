"""Whole comparisons of schedule exports: from files, bytes or normalized schedules to tables and the nested report."""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planweave.operators import evidence, report
from planweave.operators.edges import compare_edges
from planweave.operators.graph import MAX_PATHS, MAX_TRAVERSALS, edges_of, nodes_of
from planweave.operators.impact import impact_paths, impacts, path_evidence
from planweave.operators.normalize import Schedules, key_of, last_wins, normalize
from planweave.operators.reconcile import MatchConfig, compare_activities
from planweave.sources import xer
from planweave.storage import stash, written


@dataclass
class Source:
    """What a report says of a side: id, name and number of projects; the encoding is never told."""

    source_id: str
    source_name: str | None = None
    encoding: str | None = None
    project_count: int | None = None


@dataclass
class Comparison:
    """The tables of a comparison; texts() and json() nest them."""

    projects: DataFrame
    changes: DataFrame
    edge_changes: DataFrame
    impacts: DataFrame
    paths: DataFrame
    metadata: DataFrame
    unresolved: DataFrame
    uncertain: DataFrame
    warnings: DataFrame
    evidence: DataFrame
    records: DataFrame

    def texts(self, every_edge: bool = True) -> DataFrame:
        """(project_id, report): the nested report of each project as a JSON text."""
        return report.project_reports(
            self.projects, self.changes, self.edge_changes, self.impacts, self.warnings, self.metadata, self.paths, self.unresolved, self.records, every_edge
        )

    def write(self, folder: str, before: Source, after: Source, every_edge: bool = True) -> None:
        """Projects, evidence and the envelope as folders of JSON lines; nothing but the envelope passes through the driver."""
        spark = self.projects.sparkSession
        self.texts(every_edge).select(F.col("report").alias("value")).write.text(f"{folder}/projects")
        self.evidence.write.option("ignoreNullFields", "false").json(f"{folder}/evidence")
        head = {"schema_version": report.SCHEMA_VERSION, "comparison": {"before": vars(before), "after": vars(after)}, "warnings": []}
        spark.createDataFrame([(json.dumps(head, ensure_ascii=False),)], "value string").coalesce(1).write.text(f"{folder}/comparison")

    def json(self, before: Source, after: Source, every_edge: bool = True) -> dict:
        """The whole report as one document in the driver, for exports that fit there; write() is for others."""
        rows = self.texts(every_edge).orderBy(F.coalesce("project_id", F.lit(""))).collect()
        projects = [{k: v for k, v in json.loads(r.report).items() if k != "schema_version"} for r in rows]
        names = ["side", "table", "line_number", "fields", "values", "raw_line"]
        found = {r.evidence_id: {n: list(r[n]) if n in ("fields", "values") else r[n] for n in names} for r in self.evidence.orderBy("evidence_id").collect()}
        head = {"schema_version": report.SCHEMA_VERSION, "comparison": {"before": vars(before), "after": vars(after)}}
        return {**head, "projects": projects, "warnings": [], "evidence": found}


def compare_schedules(
    before: Schedules, after: Schedules, config: MatchConfig = MatchConfig(), max_paths: int = MAX_PATHS, max_traversals: int = MAX_TRAVERSALS, include_uncertain: bool = False
) -> Comparison:
    """All tables of a comparison. Entities need src columns; what several tables are made from is written to the shared folder once."""
    b_act, a_act, b_rel, a_rel = (written(x, "side") for x in (before.activities, after.activities, before.relationships, after.relationships))
    b_pro, a_pro = written(before.projects, "side"), written(after.projects, "side")
    projects = stash(report.align_projects(b_pro, a_pro), "projects")
    changes = stash(compare_activities(b_act, a_act, b_rel, a_rel, config), "changes")
    edge_changes = stash(compare_edges(report.matched_only(b_rel, projects).drop("pk"), report.matched_only(a_rel, projects).drop("pk"), changes), "edge-changes")
    told = stash(impacts(changes, b_act, a_act, b_rel, a_rel, include_uncertain, max_paths, max_traversals), "impacts")
    nodes, edges = [], []
    for side, act, rel in (("before", b_act, b_rel), ("after", a_act, a_rel)):
        known = last_wins(act.where("activity_id <> ''"), ["project_id", "activity_id"], "act_seq")
        nodes.append(known.select(F.lit(side).alias("side"), "project_id", F.col("activity_id").alias("id"), evidence.ref(side, F.col("src")).alias("evidence_id")).where("evidence_id is not null"))
        own = edges_of(rel, nodes_of(act)).where("traversable").select("pk", "p", "s", "rel_seq")
        ids = rel.select(key_of("project_id").alias("pk"), "project_id", "rel_seq", evidence.ref(side, F.col("src")).alias("evidence_id")).where("evidence_id is not null")
        edges.append(own.join(ids, ["pk", "rel_seq"]).select(F.lit(side).alias("side"), "project_id", "p", "s", "rel_seq", "evidence_id"))
    records = [last_wins(p, ["project_id"], "project_seq").select("project_id", F.lit(side == "after").alias("later"), evidence.ref(side, F.col("src")).alias("evidence_id")) for side, p in (("before", b_pro), ("after", a_pro))]
    return Comparison(
        projects, changes, edge_changes, told,
        path_evidence(impact_paths(told), nodes[0].unionByName(nodes[1]), edges[0].unionByName(edges[1])),
        report.activity_metadata(projects, changes, b_act, a_act, before.wbs, after.wbs),
        report.unresolved(projects, b_rel, a_rel),
        report.uncertain_matches(changes),
        report.warnings(b_pro, a_pro, changes, b_act, a_act, b_rel, a_rel, told),
        report.evidence_of(projects, [b_pro, b_act, b_rel], [a_pro, a_act, a_rel]),
        records[0].unionByName(records[1]),
    )


def _compare(spark: SparkSession, before: bytes, after: bytes, names: tuple[str | None, str | None], checked: bool, **limits) -> dict:
    sides, sources = [], []
    for data, name in zip((before, after), names, strict=True):
        exports = xer.parse(spark, data)
        one = normalize(xer.validate(exports) if checked else exports)
        sides.append(one)
        count = one.projects.select(key_of("project_id")).distinct().count()
        if checked and not count:
            raise xer.InvalidExport("an export without projects")
        sources.append(Source(hashlib.sha256(data).hexdigest(), name, None, count))
    return compare_schedules(*sides, **limits).json(*sources)


def compare_bytes(spark: SparkSession, before: bytes, after: bytes, before_name: str | None = None, after_name: str | None = None, **limits) -> dict:
    """The report of two exports in memory; empty input and input without projects is an error."""
    if not before or not after:
        raise xer.InvalidExport("an empty export")
    return _compare(spark, before, after, (before_name, after_name), True, **limits)


def compare_files(spark: SparkSession, before: str | os.PathLike, after: str | os.PathLike, max_bytes: int | None = None, **limits) -> dict:
    """The report of two files, by any path that Spark can read."""
    data = [bytes(xer.read_files(spark, os.fspath(p), max_bytes=max_bytes).first().content) for p in (before, after)]
    return _compare(spark, *data, tuple(os.path.basename(os.fspath(p).rstrip("/")) for p in (before, after)), False, **limits)


def reconcile_exports(before: Schedules, after: Schedules, config: MatchConfig = MatchConfig()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Matches of all projects that both sides have, those that are uncertain, and the projects that one side has (project_id, status)."""
    changes = stash(compare_activities(before.activities, after.activities, before.relationships, after.relationships, config), "changes")
    alone = report.align_projects(before.projects, after.projects).where("status <> 'MATCHED'").select("project_id", "status")
    return changes, changes.where("status = 'UNCERTAIN'"), alone


def reconcile(before: Schedules, after: Schedules, config: MatchConfig = MatchConfig()) -> DataFrame:
    """Matches of two versions of one project; several projects on a side, or different ones, are an error."""
    ids = []
    for side in (before, after):
        found = side.projects.select("project_id").distinct().limit(2).collect()
        if len(found) != 1:
            raise ValueError("reconcile() takes exports of one project; reconcile_exports() takes more")
        ids.append(found[0].project_id)
    if ids[0] != ids[1]:
        raise ValueError(f"two versions of one project are needed, not {ids[0]!r} and {ids[1]!r}")
    return compare_activities(before.activities, after.activities, before.relationships, after.relationships, config)
