"""Report assembly: project alignment, metadata, warnings, summaries and the nested report.

Every part of a report is a table of its own first. The nested report of a
project is a JSON text that is put together from them: a large project is one
long row there, and nowhere else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planweave.functions.text import is_milestone
from planweave.operators import evidence
from planweave.operators.graph import cyclic_projects, edges_of, nodes_of
from planweave.operators.normalize import NONE, key_of, last_wins, wbs_names

SCHEMA_VERSION = "1.1"
READABLE_VERSIONS = ("1.0", "1.1")
#: Warnings in the order of a report.
WARNINGS = (
    ("UNCERTAIN_MATCHES", "Some activity identities were uncertain and excluded from impact analysis."),
    ("MISSING_PROJECT_METADATA", "Project ID or name is missing"),
    ("UNRESOLVED_RELATIONSHIP", "Unresolved relationships limit graph analysis"),
    ("CYCLE_DETECTED", "Cycle detected in {side} dependency graph"),
    ("TRAVERSAL_LIMIT_REACHED", "Graph traversal limit reached"),
    ("PATH_LIMIT_REACHED", "Graph path limit reached"),
    ("PROJECT_ADDED", "Project is added"),
    ("PROJECT_DELETED", "Project is deleted"),
)
#: Fixed value: why a relationship is unresolved.
UNRESOLVED = "predecessor or successor activity is not present in the normalized project"
SIDES = evidence.SIDES


def align_projects(before: DataFrame, after: DataFrame) -> DataFrame:
    """(project_id, status, before_name, after_name): projects of either side by id; a null id is one too."""
    b = before.groupBy(key_of("project_id").alias("pk")).agg(F.lit(True).alias("b"), F.max_by("name", "project_seq").alias("before_name"))
    a = after.groupBy(key_of("project_id").alias("pk")).agg(F.lit(True).alias("a"), F.max_by("name", "project_seq").alias("after_name"))
    status = F.when(F.col("b").isNull(), "ADDED").when(F.col("a").isNull(), "DELETED").otherwise("MATCHED")
    return b.join(a, "pk", "full").select(F.nullif("pk", F.lit(NONE)).alias("project_id"), status.alias("status"), "before_name", "after_name")


def matched_only(df: DataFrame, projects: DataFrame) -> DataFrame:
    """Rows of df, with pk, of projects that both sides have. projects is the result of align_projects()."""
    known = projects.where("status = 'MATCHED'").select(key_of("project_id").alias("pk"))
    return df.withColumn("pk", key_of("project_id")).join(known, "pk", "left_semi")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def _ref(df: DataFrame, side: str) -> Column:
    """The evidence id of df's rows, null where they carry no records."""
    return (evidence.ref(side, F.col("src")) if "src" in df.columns else F.lit(None).cast("string")).alias("evidence_id")


def match_order(changes: DataFrame) -> Column:
    """The order of a project's matches: by stage, then additions, then deletions, each by id and place."""
    stage = F.when(F.col("stage") == "id", 0).when(F.col("stage") == "wbs_name", 1).when(F.col("stage") == "fuzzy", 2).when(F.col("status") == "ADDED", 3).otherwise(4)
    return F.struct(stage.alias("stage"), F.coalesce("before_activity_id", "after_activity_id", F.lit("")).alias("id"), F.coalesce("b_seq", "a_seq").alias("seq"))


def activity_metadata(projects: DataFrame, changes: DataFrame, before_act: DataFrame, after_act: DataFrame, before_wbs: DataFrame, after_wbs: DataFrame) -> DataFrame:
    """A row for every activity of both sides of matched projects: what it is, how it changed and what it is on the other side.

    Columns: project_id, side, activity_id, name, wbs_id, wbs_name, is_milestone,
    milestone_type, status, change_status, counterpart_activity_id, confidence,
    evidence_id. Of equal ids on a side the last counts, of several matches too.
    """
    parts = []
    for side, other, activities, wbs in (("before", "after", before_act, before_wbs), ("after", "before", after_act, after_wbs)):
        own = last_wins(matched_only(activities, projects).where("activity_id <> ''"), ["pk", "activity_id"], "act_seq")
        names = wbs_names(wbs, ["project_id"]).select(key_of("project_id").alias("pk"), "wbs_id", "wbs_name")
        match = changes.where(F.col(f"{side}_activity_id") != "").groupBy(key_of("project_id").alias("pk"), F.col(f"{side}_activity_id").alias("activity_id"))
        match = match.agg(F.max_by(F.struct("status", F.col(f"{other}_activity_id").alias("other"), "confidence"), match_order(changes)).alias("m"))
        own = own.select(
            "pk", "activity_id", "name", "wbs_id", "status", F.col("task_type").alias("milestone_type"), is_milestone(F.col("task_type")).alias("is_milestone"), _ref(activities, side)
        )
        met = own.join(names, ["pk", "wbs_id"], "left").join(match, ["pk", "activity_id"], "left")
        parts.append(
            met.select(
                F.nullif("pk", F.lit(NONE)).alias("project_id"), F.lit(side).alias("side"), "activity_id", "name", "wbs_id", "wbs_name", "is_milestone", "milestone_type", "status",
                F.col("m.status").alias("change_status"), F.col("m.other").alias("counterpart_activity_id"), F.col("m.confidence").alias("confidence"), "evidence_id",
            )
        )
    return _union(parts)


def unresolved(projects: DataFrame, before_rel: DataFrame, after_rel: DataFrame) -> DataFrame:
    """(project_id, side, rel_seq, predecessor_id, successor_id, relationship_type, lag_hours, reason, evidence_id) of unresolved edges of matched projects."""
    return _union(
        [
            matched_only(rel.where("not resolved"), projects).select(
                "project_id", F.lit(side).alias("side"), "rel_seq", "predecessor_id", "successor_id", "relationship_type", "lag_hours", F.lit(UNRESOLVED).alias("reason"), _ref(rel, side)
            )
            for side, rel in zip(SIDES, (before_rel, after_rel), strict=True)
        ]
    )


def uncertain_matches(changes: DataFrame) -> DataFrame:
    """(project_id, before_activity_id, after_activity_id, confidence, before_evidence, after_evidence) of matches that impact analysis leaves out."""
    ids = change_refs(changes)
    return ids.where("status = 'UNCERTAIN'").select("project_id", "before_activity_id", "after_activity_id", "confidence", "before_evidence", "after_evidence")


def change_refs(changes: DataFrame) -> DataFrame:
    """changes with before_evidence and after_evidence in place of the raw records."""
    none = F.lit(None).cast("string")
    ids = {f"{s}_evidence": evidence.ref(s, F.col(f"{s}_src")) if f"{s}_src" in changes.columns else none for s in SIDES}
    return changes.withColumns(ids).drop("before_src", "after_src")


def edge_refs(edge_changes: DataFrame) -> DataFrame:
    """edge_changes with before_evidence and after_evidence."""
    none = F.lit(None).cast("string")
    raw = "src" in edge_changes.schema["before"].dataType.names
    return edge_changes.withColumns({f"{s}_evidence": evidence.ref(s, F.col(f"{s}.src")) if raw else none for s in SIDES})


def evidence_of(projects: DataFrame, before: list[DataFrame], after: list[DataFrame]) -> DataFrame:
    """The records that reports refer to: of all projects, and what belongs to matched ones. before, after: projects, activities, relationships, with src."""
    parts = []
    for side, (own, *others) in zip(SIDES, (before, after), strict=True):
        parts.append(last_wins(own, ["project_id"], "project_seq").select(F.lit(side).alias("side"), "src"))
        parts += [matched_only(df, projects).select(F.lit(side).alias("side"), "src") for df in others]
    return _union([evidence.register(df, side) for side in SIDES for df in [_union([p.where(F.col("side") == side).select("src") for p in parts])]])


def warnings(
    before: DataFrame, after: DataFrame, changes: DataFrame, before_act: DataFrame, after_act: DataFrame, before_rel: DataFrame, after_rel: DataFrame, impacts: DataFrame | None = None,
    lost: DataFrame | None = None,
) -> DataFrame:
    """(project_id, warn_seq, code, severity, message, evidence_ids); unresolved edges of the before side are told twice, as the report lists both sides. lost: unresolved(), if it is made already."""
    projects = align_projects(before, after).withColumn("pk", key_of("project_id"))
    matched = projects.where("status = 'MATCHED'").select("pk")
    parts: list[DataFrame] = []
    none = F.array().cast("array<string>")

    def say(rows: DataFrame, code: str, side: str = "", plus: int = 0, ids: Column = none) -> None:
        k, message = next((i, m) for i, (c, m) in enumerate(WARNINGS) if c == code)
        parts.append(
            rows.select(
                "pk", F.lit(10 * k + plus).alias("warn_seq"), F.lit(code).alias("code"), F.lit("WARNING").alias("severity"), F.lit(message.format(side=side)).alias("message"), ids.alias("evidence_ids")
            )
        )

    keyed = lambda df: df.withColumn("pk", key_of("project_id")).select("pk").distinct().join(matched, "pk", "left_semi")
    say(keyed(changes.where("status = 'UNCERTAIN'")), "UNCERTAIN_MATCHES")
    no_id = (F.col("pk") == NONE) | (F.col("pk") == "")
    for plus, side in enumerate(SIDES):
        nameless = F.col(f"{side}_name").isNull() | (F.col(f"{side}_name") == "")
        say(projects.where((F.col("status") == "MATCHED") & (no_id | nameless)), "MISSING_PROJECT_METADATA", plus=plus)
    lost = (unresolved(projects.drop("pk"), before_rel, after_rel) if lost is None else lost).withColumn("pk", key_of("project_id"))
    for plus, sides in enumerate((("before",), SIDES)):
        listed = lost.where(F.col("side").isin(*sides)).groupBy("pk").agg(F.array_sort(F.collect_list(F.struct((F.col("side") == "after").alias("later"), "rel_seq", "evidence_id"))).alias("x"))
        say(listed, "UNRESOLVED_RELATIONSHIP", plus=plus, ids=F.array_compact(F.transform("x", lambda x: x["evidence_id"])))
    for plus, (side, act, rel) in enumerate((("before", before_act, before_rel), ("after", after_act, after_rel))):
        say(cyclic_projects(edges_of(rel, nodes_of(act))).join(matched, "pk", "left_semi"), "CYCLE_DETECTED", side, plus)
    if impacts is not None:
        say(keyed(impacts.where("traversal_limited")), "TRAVERSAL_LIMIT_REACHED")
        say(keyed(impacts.where("path_limited")), "PATH_LIMIT_REACHED")
    for status, side, own in (("ADDED", "after", after), ("DELETED", "before", before)):
        rows = projects.where(F.col("status") == status)
        if "src" in own.columns:
            known = last_wins(own, ["project_id"], "project_seq").select(key_of("project_id").alias("pk"), _ref(own, side))
            say(rows.join(known, "pk", "left"), f"PROJECT_{status}", ids=F.array_compact(F.array("evidence_id")))
        else:
            say(rows, f"PROJECT_{status}")
    return _union(parts).withColumn("project_id", F.nullif("pk", F.lit(NONE))).drop("pk")


def summary(projects: DataFrame, changes: DataFrame, edge_changes: DataFrame, warned: DataFrame | None = None, records: DataFrame | None = None) -> DataFrame:
    """One row of counts, each taken by itself and joined as a single row: projects, activity_changes, relationship_changes, and warnings and evidence if given."""
    parts = {"projects": projects, "activity_changes": changes, "relationship_changes": edge_changes, "warnings": warned, "evidence": records}
    rows = [df.agg(F.count(F.lit(1)).alias(name)) for name, df in parts.items() if df is not None]
    out = rows[0]
    for more in rows[1:]:
        out = out.crossJoin(more)
    return out


def counts_by(rows: DataFrame, *columns: str) -> DataFrame:
    """How many rows have each status, severity or what columns are named."""
    return rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def search(activities: DataFrame, wanted: str, *columns: str) -> DataFrame:
    """Activities whose name or id, or what columns are named, holds the text, in any case."""
    return activities.where(F.lower(F.concat_ws(" ", *(columns or ("name", "activity_id")))).contains(wanted.lower()))


def changed_first(changes: DataFrame, k: int) -> DataFrame:
    """The first k changes of each project, unchanged ones last."""
    order = Window.partitionBy("project_id").orderBy((F.col("status") == "UNCHANGED").cast("int"), F.coalesce("b_seq", "a_seq"), "status")
    return changes.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= k).drop("__rank")


def first_change(changes: DataFrame) -> DataFrame:
    """The first change of each project in the order of its matches that is none of UNCHANGED, else its first one."""
    order = Window.partitionBy(key_of("project_id")).orderBy((F.col("status") == "UNCHANGED").cast("int"), match_order(changes))
    return changes.withColumn("__rank", F.row_number().over(order)).where("__rank = 1").drop("__rank")


def display_name(fields: Column, values: Column, changes: Column, activity_id: Column) -> Column:
    """An activity's label: its task_name cell, else a changed field that names something, else its id."""
    at = F.array_position(fields, F.lit("task_name"))
    cell = F.when(at > 0, F.nullif(F.get(values, (at - 1).cast("int")), F.lit("")))
    named = F.map_values(F.map_filter(changes, lambda k, v: k.rlike("(?i)(^|_)(name|description|title)($|_)")))
    return F.coalesce(cell, F.get(named, F.lit(0))["after"], F.get(named, F.lit(0))["before"], activity_id)


def change_labels(changes: DataFrame) -> DataFrame:
    """changes with `label`: the name in the before record, else in the after one, else a changed name, else an id."""
    one = lambda side: (F.col(f"{side}_src.fields"), F.col(f"{side}_src.values"))
    ids = F.coalesce("after_activity_id", "before_activity_id")
    known = F.create_map().cast("map<string,struct<before:string,after:string>>")
    named = F.coalesce("field_changes", known)
    own = [display_name(*one(side), known, F.lit(None).cast("string")) for side in SIDES] if "before_src" in changes.columns else []
    none = F.lit(None).cast("array<string>")
    return changes.withColumn("label", F.coalesce(*own, display_name(none, none, named, ids)))


def edge_lookup(edge_changes: DataFrame) -> DataFrame:
    """(project_id, predecessor_id, successor_id, status, occurrence): for each pair of named ends the last change, as a list by pair shows it."""
    named = edge_changes.where("predecessor_id is not null and successor_id is not null")
    last = named.groupBy("project_id", "predecessor_id", "successor_id").agg(F.max_by(F.struct("status", "occurrence"), "occurrence").alias("x"))
    return last.select("project_id", "predecessor_id", "successor_id", "x.status", "x.occurrence")


def readable(reports: DataFrame) -> DataFrame:
    """Reports (schema_version, report as JSON text or not given) of a version that can be read and with the parts that are needed."""
    known = reports.where(F.col("schema_version").isin(*READABLE_VERSIONS))
    if "report" not in reports.columns:
        return known
    parts = F.from_json("report", "struct<projects:array<string>,evidence:map<string,string>>")
    return known.where(parts["projects"].isNotNull() & parts["evidence"].isNotNull())


# ---- the nested report -------------------------------------------------


def _json(*columns: str | Column) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def _refs(*names: str) -> Column:
    return evidence.refs(*map(F.col, names)).alias("evidence_refs")


def _text(value: Column) -> Column:
    """A JSON string."""
    return F.regexp_replace(F.to_json(F.array(value)), r"^\[|\]$", "")


def _repr(value: Column) -> Column:
    """How a key's part is written where edge changes are put in order: in quotes, null as None."""
    plain = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    double = value.contains("'") & ~value.contains('"')
    return F.when(value.isNull(), "None").when(double, F.concat(F.lit('"'), plain, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(plain, F.lit("'"), F.lit("\\'")), F.lit("'")))


def _evidence(value: Column) -> Column:
    return F.struct(value.alias("evidence_id"))


def _path_json(path: Column, nodes: Column, edges: Column) -> Column:
    """The JSON of a path from its ids, the references of its activities by id, and those of its edges; `side` is the path's."""
    known = F.map_from_entries(F.transform(F.array_distinct(path), lambda x: F.struct(x.alias("key"), F.concat("side", F.lit(":"), x).alias("value"))))
    return _json(path.alias("activity_ids"), known.alias("node_metadata_refs"), nodes.alias("node_evidence_refs"), edges.alias("edge_evidence_refs"))


def _changed(entries: Column) -> Column:
    return F.transform(F.map_entries(entries), lambda e: F.concat(_text(e["key"]), F.lit(":"), F.to_json(e["value"], {"ignoreNullFields": "false"})))


def edge_texts(edge_changes: DataFrame) -> DataFrame:
    """(pk, o, text, ends): the JSON of every edge change, its order in the report, and its ends."""

    def identity(side: str) -> Column:
        same = F.struct("predecessor_id", "successor_id", F.col(f"{side}.relationship_type").alias("relationship_type"), F.col(f"{side}.lag_hours").alias("lag_hours"), "occurrence")
        return F.when(F.col(side).isNotNull(), same).alias(f"identity_{side}")

    order = F.struct(F.concat(F.lit("("), _repr(F.col("predecessor_id")), F.lit(", "), _repr(F.col("successor_id")), F.lit(")")).alias("key"), F.col("occurrence").alias("n"))
    text = _json("status", identity("before"), identity("after"), "ambiguous", _refs("before_evidence", "after_evidence"))
    ends = F.array_distinct(F.array("predecessor_id", "successor_id"))
    return edge_refs(edge_changes).select(key_of("project_id").alias("pk"), order.alias("o"), text.alias("text"), ends.alias("ends"))


def project_reports(
    projects: DataFrame, changes: DataFrame, edge_changes: DataFrame, impacts: DataFrame, warned: DataFrame,
    metadata: DataFrame | None = None, paths: DataFrame | None = None, lost: DataFrame | None = None, records: DataFrame | None = None, every_edge: bool = True,
) -> DataFrame:
    """(project_id, report): a JSON text for each project, its lists in the order of the report.

    Added and deleted projects have warnings and evidence only. With every_edge an
    impact has all edge changes of the project, as the contract's first reader
    expects; their text is made once for a project and repeated only where the
    report is put together. Without it an impact has those that touch its source.
    metadata: activity_metadata(); paths: path_evidence(), where impacts don't have
    the records of their paths themselves; lost: unresolved(); records: project_id,
    later, evidence_id of the projects' own records. What is not given is empty.
    """

    def listed(df: DataFrame, name: str, keys: list[str] = ["pk"]) -> DataFrame:
        """df (keys, o, text) as one text per key: the texts in the order of o, with commas."""
        rows = df.select(*keys, F.struct("o", "text").alias("x")).groupBy(*keys).agg(F.array_sort(F.collect_list("x")).alias("x"))
        return rows.select(*keys, F.array_join(F.transform("x", lambda x: x["text"]), ",").alias(name))

    def keyed(df: DataFrame, order: Column, text: Column, *more: str | Column) -> DataFrame:
        return df.select(key_of("project_id").alias("pk"), order.alias("o"), text.alias("text"), *more)

    def inside(text: Column, name: str, value: Column) -> Column:
        """A JSON object with one more member at its end."""
        return F.concat(F.substring(text, F.lit(1), F.length(text) - 1), F.lit(f',"{name}":'), value, F.lit("}"))

    known = change_refs(changes)
    fields = F.coalesce(F.concat(_changed(F.col("field_changes")), _changed(F.col("set_changes"))), F.array())
    told = inside(_json("before_activity_id", "after_activity_id", "status", "confidence"), "changes", F.concat(F.lit("{"), F.array_join(fields, ","), F.lit("}")))
    told = inside(told, "evidence_refs", F.to_json(_refs("before_evidence", "after_evidence")))
    parts = [listed(keyed(known, match_order(known), told), "activity_changes")]
    edges = edge_texts(edge_changes)
    parts.append(listed(edges.select("pk", "o", "text"), "relationship_changes"))
    sure = known.where("status = 'UNCERTAIN'")
    parts.append(listed(keyed(sure, match_order(sure), _json("before_activity_id", "after_activity_id", "confidence", _refs("before_evidence", "after_evidence"))), "uncertain"))

    source = ["pk", "side", "source_activity"]
    if "path_nodes" in impacts.columns:
        nodes = lambda p: F.filter(F.arrays_zip(p["paths"].alias("id"), p["path_nodes"].alias("e")), lambda x: x["e"].isNotNull())
        told = lambda p: F.map_from_entries(F.array_sort(F.transform(nodes(p), lambda x: F.struct(x["id"].alias("key"), _evidence(x["e"]).alias("value")))))
        path_text = lambda p: _path_json(p["paths"], told(p), F.transform(p["path_edges"], _evidence))
        of_paths = None
    elif paths is not None:
        text = _path_json(F.col("path"), F.transform_values("node_evidence", lambda k, v: _evidence(v)), F.transform("edge_evidence", _evidence))
        of_paths = listed(keyed(paths, F.col("ordinal"), text, "side", "source_activity"), "paths", source)
    else:
        text = _json(F.col("x").alias("activity_ids"))
        of_paths = listed(keyed(impacts.select("project_id", "side", "source_activity", F.posexplode("paths").alias("n", "x")), F.col("n"), text, "side", "source_activity"), "paths", source)
    near = edges.select("pk", "o", "text", F.explode("ends").alias("source_activity"))
    milestones = F.transform("downstream_milestones", lambda m: F.struct(m.alias("activity_id"), F.lit(None).cast("string").alias("name"), F.array().cast("array<struct<evidence_id:string>>").alias("evidence_refs")))
    text = _json("source_activity", "change_status", "confidence", "downstream_activity_count", F.col("changed_downstream").alias("changed_downstream_activities"), milestones.alias("downstream_milestones"))
    head = F.concat(F.substring(text, F.lit(1), F.length(text) - 1), F.lit(',"relationship_changes":['))
    tail = F.concat(F.lit('],"paths":['), F.coalesce("paths_text", F.lit("")), F.lit('],"evidence_refs":[],"uncertain":'), F.col("uncertain").cast("string"), F.lit("}"))
    placed = F.struct("change_status", "source_activity")
    rows = impacts.withColumn("pk", key_of("project_id"))
    if of_paths is None:
        rows = rows.withColumn("paths_text", F.array_join(F.transform(F.arrays_zip("paths", "path_nodes", "path_edges"), path_text), ",")).drop("paths", "path_nodes", "path_edges")
    else:
        rows = rows.drop("paths").join(of_paths.withColumnRenamed("paths", "paths_text"), source, "left")
    if not every_edge:
        rows = rows.join(listed(near, "edges", ["pk", "source_activity"]), ["pk", "source_activity"], "left")
    order = known.select(key_of("project_id").alias("pk"), F.when(F.col("status") == "DELETED", F.col("before_activity_id")).otherwise(F.col("after_activity_id")).alias("source_activity"), F.col("status").alias("change_status"), match_order(known).alias("m"))
    order = order.groupBy("pk", "source_activity", "change_status").agg(F.min("m").alias("m"))
    rows = rows.join(order, ["pk", "source_activity", "change_status"], "left")
    whole = head if every_edge else F.concat(head, F.coalesce("edges", F.lit("")), tail)
    of_impacts = rows.select("pk", F.struct(F.struct("m", placed.alias("p")).alias("o"), whole.alias("head"), *[tail.alias("tail")] * every_edge).alias("x"))
    of_impacts = of_impacts.groupBy("pk").agg(F.array_sort(F.collect_list("x")).alias("impacts"))
    parts.append(of_impacts if every_edge else of_impacts.select("pk", F.array_join(F.transform("impacts", lambda x: x["head"]), ",").alias("impacts")))
    severity = _json("code", "severity", "message", F.when(F.col("code") != "UNCERTAIN_MATCHES", F.col("project_id")).alias("project_id"), F.array().cast("array<string>").alias("activity_ids"), F.transform("evidence_ids", lambda x: F.struct(x.alias("evidence_id"))).alias("evidence_refs"))
    parts.append(listed(keyed(warned, F.col("warn_seq"), severity), "warnings"))
    if metadata is not None:
        name = F.concat("side", F.lit(":"), "activity_id")
        text = _json("side", "activity_id", "name", "wbs_id", "wbs_name", "is_milestone", "milestone_type", "status", "change_status", "counterpart_activity_id", "confidence", _refs("evidence_id"))
        parts.append(listed(keyed(metadata, F.struct((F.col("side") == "after").alias("later"), "activity_id"), F.concat(_text(name), F.lit(":"), text)), "activity_metadata"))
    if lost is not None:
        text = _json("predecessor_id", "successor_id", "relationship_type", "lag_hours", "reason", _refs("evidence_id"))
        parts.append(listed(keyed(lost, F.struct((F.col("side") == "after").alias("later"), "rel_seq"), text), "unresolved_relationships"))
    if records is not None:
        parts.append(listed(keyed(records.where("evidence_id is not null"), F.struct("later"), _json("evidence_id")), "evidence_refs"))

    out = projects.withColumn("pk", key_of("project_id"))
    for p in parts:
        out = out.join(p, "pk", "left")
    if every_edge:
        repeated = F.coalesce("relationship_changes", F.lit(""))
        out = out.withColumn("impacts", F.array_join(F.transform("impacts", lambda x: F.concat(x["head"], repeated, x["tail"])), ","))
    # Put together in one go: a project's text is long, and adding to its end would copy it each time.
    part = lambda name, ends: F.concat(F.lit(ends[0]), F.coalesce(name, F.lit("")) if name in out.columns else F.lit(""), F.lit(ends[1]))
    head = _json(F.lit(SCHEMA_VERSION).alias("schema_version"), "project_id", "status")
    members = [(name, part(name, "{}" if name == "activity_metadata" else "[]")) for name in ("activity_changes", "activity_metadata", "relationship_changes", "impacts")]
    members.append(("uncertainty", F.coalesce(F.concat(F.lit('{"matches":['), "uncertain", F.lit('],"excluded_from_impact":true}')), F.lit("null"))))
    members += [(name, part(name, "[]")) for name in ("unresolved_relationships", "evidence_refs", "warnings")]
    text = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), *[x for name, value in members for x in (F.lit(f',"{name}":'), value)], F.lit("}"))
    return out.select("project_id", text.alias("report"))
