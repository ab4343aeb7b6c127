"""Typed entities from raw records: projects, work breakdown, activities, relationships, calendars.

All cells stay strings. Order columns (*_seq) are line numbers: they stand for
the order of the file where later rows win or ties are broken by place.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planweave.functions.text import is_milestone
from planweave.sources.xer import Exports
from planweave.storage import in_lying, stash, written

#: Entity column <- raw column.
PROJECT = {"project_id": "proj_id", "short_name": "proj_short_name", "name": "proj_name", "planned_start": "plan_start_date", "planned_finish": "plan_end_date", "calendar_id": "clndr_id"}
WBS = {"wbs_id": "wbs_id", "project_id": "proj_id", "parent_wbs_id": "parent_wbs_id", "short_name": "wbs_short_name", "name": "wbs_name"}
ACTIVITY = {
    "activity_id": "task_id", "project_id": "proj_id", "wbs_id": "wbs_id", "code": "task_code", "name": "task_name", "status": "status_code", "task_type": "task_type",
    "total_float_hours": "total_float_hr_cnt", "critical_flag": "critical_flag", "target_start": "target_start_date", "target_finish": "target_end_date",
    "actual_start": "act_start_date", "actual_finish": "act_end_date", "remaining_duration_hours": "remain_drtn_hr_cnt",
}
RELATIONSHIP = {"predecessor_id": "pred_task_id", "successor_id": "task_id", "relationship_type": "pred_type", "lag_hours": "lag_hr_cnt"}
CALENDAR = {"calendar_id": "clndr_id", "name": "clndr_name", "calendar_type": "clndr_type", "is_default": "default_flag"}

#: What a null takes in joins where nulls are equal; no cell holds it.
NONE = "\0"


def key_of(column: str | Column) -> Column:
    """A column whose nulls equal each other in an equi-join, which keeps hash joins and their partitioning simple; that of tables in buckets as it is, as they hold no null project."""
    if isinstance(column, str) and column == "project_id" and in_lying():
        return F.col(column)
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(NONE))


def _typed(rows: DataFrame, columns: dict[str, str]) -> list[Column]:
    return [F.try_element_at("rec", F.lit(raw)).alias(name) for name, raw in columns.items()]


def _src() -> Column:
    return F.struct("table", "fields", "values", "line_number", "raw_line").alias("src")


def extras(columns: dict[str, str]) -> Column:
    return F.map_filter("rec", lambda k, v: ~k.isin(*columns.values())).alias("extras")


def last_wins(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Of rows with equal keys (nulls equal), the one with the highest seq."""
    order = Window.partitionBy(*keys).orderBy(F.desc(seq))
    return df.withColumn("__rank", F.row_number().over(order)).where("__rank = 1").drop("__rank")


@dataclass
class Schedules:
    """Entities of many exports, by source_id and project_id."""

    projects: DataFrame
    wbs: DataFrame
    activities: DataFrame
    relationships: DataFrame
    calendars: DataFrame


def projects_of(raw: DataFrame, wbs: DataFrame, activities: DataFrame, calendars: DataFrame, sources: DataFrame) -> DataFrame:
    """Declared projects (the last row of an id, at its first place) and those that others name.

    Without declared projects an export that has breakdown nodes, activities or
    calendars first gets a project without id.
    """
    of_id = Window.partitionBy("source_id", "project_id")
    declared = raw.withColumn("__first", F.min("project_seq").over(of_id))
    declared = last_wins(declared, ["source_id", "project_id"], "project_seq").withColumn("project_seq", F.col("__first")).drop("__first")
    named = wbs.select("source_id", "project_id", F.col("wbs_seq").alias("at"), F.lit(1).alias("phase")).unionByName(activities.select("source_id", "project_id", F.col("act_seq").alias("at"), F.lit(2).alias("phase")))
    loose = named.select("source_id").unionByName(calendars.select("source_id")).distinct().join(raw.select("source_id"), "source_id", "left_anti")
    named = named.unionByName(loose.select("source_id", F.lit(None).cast("string").alias("project_id"), F.lit(0).alias("at"), F.lit(0).alias("phase")))
    named = named.groupBy("source_id", "project_id").agg(F.min(F.struct("phase", "at")).alias("p"))
    known = declared.select("source_id", key_of("project_id").alias("pk"))
    more = named.withColumn("pk", key_of("project_id")).join(known, ["source_id", "pk"], "left_anti")
    # Later than every declared project of the file.
    more = more.select("source_id", "project_id", (F.lit(1 << 40) * (F.col("p.phase") + 1) + F.col("p.at")).alias("project_seq"))
    return declared.unionByName(more, allowMissingColumns=True)


def resolve_relationships(raw: DataFrame, activities: DataFrame, projects: DataFrame) -> DataFrame:
    """raw with resolved and project_id: the successor's project, else that without id, else the first, else none.

    Activities are looked up over all projects of an export; of equal ids the last counts.
    """
    known = last_wins(activities.where("activity_id <> ''"), ["source_id", "activity_id"], "act_seq")
    order = projects.groupBy("source_id").agg(F.min_by("project_id", "project_seq").alias("first_project"), F.bool_or(F.col("project_id").isNull()).alias("has_none"))
    succ = known.select("source_id", F.col("activity_id").alias("successor_id"), F.struct(F.col("project_id").alias("id")).alias("succ"))
    pred = known.select("source_id", F.col("activity_id").alias("predecessor_id"), F.lit(True).alias("pred"))
    met = raw.join(succ, ["source_id", "successor_id"], "left").join(pred, ["source_id", "predecessor_id"], "left").join(order, "source_id", "left")
    lost = F.when(F.col("has_none"), F.lit(None)).otherwise(F.col("first_project"))
    met = met.withColumn("project_id", F.when(F.col("succ").isNotNull(), F.col("succ.id")).otherwise(lost))
    return met.withColumn("resolved", F.col("succ").isNotNull() & F.col("pred").isNotNull()).drop("succ", "pred", "first_project", "has_none")


def share_calendars(raw: DataFrame, projects: DataFrame) -> DataFrame:
    """Every calendar of an export belongs to all its projects; an equi-join by export, as a cross join has it."""
    return raw.join(projects.select("source_id", "project_id"), "source_id")


def normalize(exports: Exports) -> Schedules:
    """Entities of exports. Records are written first, so that files are parsed once and not for every entity."""
    exports = replace(exports, records=written(exports.records, "records"), sources=written(exports.sources, "sources"))
    def seq(name: str) -> Column:
        return F.col("line_number").cast("long").alias(name)

    raw_projects = exports.table("PROJECT").select("source_id", seq("project_seq"), *_typed(exports.records, PROJECT), _src())
    wbs = exports.table("PROJWBS").select("source_id", seq("wbs_seq"), *_typed(exports.records, WBS), extras(WBS))
    activities = exports.table("TASK").select("source_id", seq("act_seq"), *_typed(exports.records, ACTIVITY), extras(ACTIVITY), _src())
    activities = activities.withColumn("is_milestone", is_milestone(F.col("task_type")))
    edges = exports.table("TASKPRED").select("source_id", seq("rel_seq"), *_typed(exports.records, RELATIONSHIP), _src())
    calendars = exports.table("CALENDAR").select("source_id", seq("cal_seq"), *_typed(exports.records, CALENDAR))
    projects = projects_of(raw_projects, wbs, activities, calendars, exports.sources)
    relationships = resolve_relationships(edges, activities, projects)
    alone = relationships.select("source_id").distinct().join(projects.select("source_id"), "source_id", "left_anti")
    projects = projects.unionByName(alone.withColumn("project_seq", F.lit(0).cast("long")), allowMissingColumns=True)
    projects = written(projects, "projects")
    return Schedules(projects, wbs, activities, written(relationships, "relationships"), share_calendars(calendars, projects))


def wbs_tree(wbs: DataFrame, keys: list[str]) -> DataFrame:
    """Nodes that hang on a root, with depth, path of ids, places (the path of wbs_seq) and is_root; nodes in a cycle of parents hang on none.

    A node without parent, with an unknown one or with itself as parent is a
    root. Of nodes with one id, the last is the parent of those that name it.
    One level is added at a time, what its parents' level leads to, until a level
    is empty; levels are written, so that the plan of the next one stays small.
    """
    target = last_wins(wbs.where("wbs_id <> ''"), [*keys, "wbs_id"], "wbs_seq").select(*keys, F.col("wbs_id").alias("parent_wbs_id"), F.col("wbs_seq").alias("parent_seq"))
    same = [F.col(f"w.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys]
    linked = wbs.alias("w").join(target.alias("t"), [*same, F.col("w.parent_wbs_id") == F.col("t.parent_wbs_id")], "left").select("w.*", "parent_seq")
    linked = stash(linked.withColumn("parent_seq", F.when(F.col("parent_seq") != F.col("wbs_seq"), F.col("parent_seq"))), "wbs")
    level = linked.where("parent_seq is null").withColumns({"depth": F.lit(0), "path": F.array("wbs_id"), "places": F.array("wbs_seq"), "is_root": F.lit(True)})
    out = level
    rest = linked.where("parent_seq is not null")
    while True:
        above = level.select(*keys, F.col("wbs_seq").alias("parent_seq"), (F.col("depth") + 1).alias("depth"), F.col("path").alias("above"), F.col("places").alias("over"))
        same = [F.col(f"r.{k}").eqNullSafe(F.col(f"a.{k}")) for k in keys]
        level = rest.alias("r").join(above.alias("a"), [*same, F.col("r.parent_seq") == F.col("a.parent_seq")]).select(
            "r.*", "a.depth", F.concat("a.above", F.array("r.wbs_id")).alias("path"), F.concat("a.over", F.array("r.wbs_seq")).alias("places"), F.lit(False).alias("is_root")
        )
        level = stash(level, "wbs-level")
        if level.isEmpty():
            return out.drop("parent_seq")
        out = out.unionByName(level)


def wbs_names(wbs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, wbs_id, wbs_name) of nodes that hang on a root and have a name; of equal ids the last in the order of a walk from the roots."""
    tree = wbs_tree(wbs, keys)
    # A walk from the roots takes siblings in the order of the file: the places along the way order its nodes.
    known = tree.where("wbs_id <> '' and name <> ''")
    return known.groupBy(*keys, "wbs_id").agg(F.max_by("name", F.col("places")).alias("wbs_name"))
