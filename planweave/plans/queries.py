"""The registered queries of the schedule engine, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planweave.functions.text import normal_name, relationship_label, relationship_type
from planweave.operators import evidence, graph, impact, reconcile, report
from planweave.operators.edges import compare_edges
from planweave.operators.impact import impacts
from planweave.operators.normalize import NONE, last_wins, normalize, share_calendars, wbs_tree
from planweave.operators.normalize import resolve_relationships as resolved
from planweave.plans import schedule
from planweave.sources import xer

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None, schedules: bool = True):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = f"WITH RECURSIVE {schedule.SQL.strip()}, {sql.strip()}" if schedules else sql.strip()
        return f

    return add


def _acts(spark: SparkSession, d: str, share: int | None = None) -> tuple[DataFrame, DataFrame]:
    return schedule.activities(spark, d, "before", share), schedule.activities(spark, d, "after", share)


def _rels(spark: SparkSession, d: str, share: int | None = None) -> tuple[DataFrame, DataFrame]:
    return schedule.relationships(spark, d, "before", share), schedule.relationships(spark, d, "after", share)


def _edges(spark: SparkSession, d: str, share: int | None = None) -> tuple[DataFrame, DataFrame]:
    return schedule.edges(spark, d, "before", share), schedule.edges(spark, d, "after", share)


def _ways(spark: SparkSession, d: str, share: int | None = None) -> tuple[DataFrame, DataFrame]:
    """What graphs are walked by: the edges as they are where their ends can be activities of their own project only, which the walk sees, else with what they resolve to."""
    return _edges(spark, d, share) if schedule.apart(spark, d) else _rels(spark, d, share)


def _projects(spark: SparkSession, d: str, share: int | None = None) -> tuple[DataFrame, DataFrame]:
    return schedule.projects(spark, d, "before", share), schedule.projects(spark, d, "after", share)


def _changes(spark: SparkSession, d: str, share: int, fuzzy: bool = False) -> DataFrame:
    """The comparison of a share's projects, which many queries start from; where there is one share, it is written once in a session."""
    return schedule.part(spark, d, f"changes-{fuzzy}", share, lambda: reconcile.compare_activities(*_acts(spark, d, share), *_edges(spark, d, share), fuzzy=fuzzy))


def _shared(f: Callable[[SparkSession, str, int], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A query over the tables from what it gives for a share of the projects."""

    @wraps(f)
    def whole(spark, d):
        return schedule.in_shares(spark, d, f.__name__, lambda share: f(spark, d, share))

    return whole


def _summed(spark: SparkSession, d: str, name: str, counts: Callable[[int], DataFrame]) -> DataFrame:
    """Counts of all projects, of which counts() gives those of a share; the last column is added up."""
    out = schedule.in_shares(spark, d, name, counts)
    *by, n = out.columns
    return out.groupBy(*by).agg(F.sum(n).alias(n)) if schedule.shares(spark, d) > 1 else out


#: Stages 1 and 2 and what they leave, for the SQL side.
MATCH = """
b_last AS (SELECT * FROM b_act QUALIFY row_number() OVER (PARTITION BY project_id, activity_id ORDER BY act_seq DESC) = 1),
a_last AS (SELECT * FROM a_act QUALIFY row_number() OVER (PARTITION BY project_id, activity_id ORDER BY act_seq DESC) = 1),
m1 AS MATERIALIZED (SELECT b.project_id, b.act_seq AS b_seq, a.act_seq AS a_seq FROM b_last b JOIN a_last a USING (project_id, activity_id)),
b_left AS MATERIALIZED (SELECT * FROM b_act WHERE (project_id, act_seq) NOT IN (SELECT (project_id, b_seq) FROM m1)),
a_left AS MATERIALIZED (SELECT * FROM a_act WHERE (project_id, act_seq) NOT IN (SELECT (project_id, a_seq) FROM m1)),
m2 AS MATERIALIZED (SELECT b.project_id, b.act_seq AS b_seq, a.act_seq AS a_seq
  FROM (SELECT * FROM b_left QUALIFY row_number() OVER (PARTITION BY project_id, wbs_id, lower(name) ORDER BY activity_id, name, act_seq) = 1) b
  JOIN (SELECT project_id, wbs_id, lower(name) AS nn, max(act_seq) AS act_seq FROM a_left GROUP BY ALL HAVING count(*) = 1) a ON b.project_id = a.project_id AND b.wbs_id = a.wbs_id AND lower(b.name) = a.nn),
m AS MATERIALIZED (SELECT *, 'id' AS stage, 1.0::DOUBLE AS confidence FROM m1 UNION ALL SELECT *, 'wbs_name', 0.98::DOUBLE FROM m2)
"""
NEAR = """
b_near AS MATERIALIZED (SELECT project_id, id, list_sort(list(DISTINCT p) FILTER (p IS NOT NULL)) AS preds, list_sort(list(DISTINCT s) FILTER (s IS NOT NULL)) AS succs FROM (
  SELECT project_id, successor_id AS id, predecessor_id AS p, NULL AS s FROM b_rel UNION ALL SELECT project_id, predecessor_id, NULL, successor_id FROM b_rel) GROUP BY ALL),
a_near AS MATERIALIZED (SELECT project_id, id, list_sort(list(DISTINCT p) FILTER (p IS NOT NULL)) AS preds, list_sort(list(DISTINCT s) FILTER (s IS NOT NULL)) AS succs FROM (
  SELECT project_id, successor_id AS id, predecessor_id AS p, NULL AS s FROM a_rel UNION ALL SELECT project_id, predecessor_id, NULL, successor_id FROM a_rel) GROUP BY ALL)
"""
CHANGES = f"""{MATCH.strip()}, {NEAR.strip()},
ids AS MATERIALIZED (SELECT m.project_id, b.activity_id AS id, max_by(a.activity_id, m.b_seq) AS nid FROM m JOIN b_act b ON m.project_id = b.project_id AND b_seq = b.act_seq
  JOIN a_act a ON m.project_id = a.project_id AND a_seq = a.act_seq GROUP BY ALL),
moved AS MATERIALIZED (SELECT n.project_id, n.id,
  (SELECT list_sort(list(DISTINCT coalesce(nid, x))) FROM (SELECT unnest(n.preds) AS x) LEFT JOIN ids ON ids.project_id = n.project_id AND ids.id = x) AS preds,
  (SELECT list_sort(list(DISTINCT coalesce(nid, x))) FROM (SELECT unnest(n.succs) AS x) LEFT JOIN ids ON ids.project_id = n.project_id AND ids.id = x) AS succs FROM b_near n),
pairs AS MATERIALIZED (SELECT m.project_id, b.activity_id AS before_activity_id, a.activity_id AS after_activity_id, stage, confidence, b_seq, a_seq,
  concat_ws(',', CASE WHEN b.code IS DISTINCT FROM a.code THEN 'code' END, CASE WHEN b.name IS DISTINCT FROM a.name THEN 'name' END, CASE WHEN b.status IS DISTINCT FROM a.status THEN 'status' END,
    CASE WHEN b.target_start IS DISTINCT FROM a.target_start THEN 'start_date' END, CASE WHEN b.target_finish IS DISTINCT FROM a.target_finish THEN 'finish_date' END,
    CASE WHEN b.dur IS DISTINCT FROM a.dur THEN 'duration_hours' END, CASE WHEN b.wbs_id IS DISTINCT FROM a.wbs_id THEN 'wbs_id' END) AS fields,
  concat_ws(',', CASE WHEN coalesce(bn.preds, []) IS DISTINCT FROM coalesce(an.preds, []) THEN 'predecessors' END, CASE WHEN coalesce(bn.succs, []) IS DISTINCT FROM coalesce(an.succs, []) THEN 'successors' END) AS sets
  FROM m JOIN b_act b ON m.project_id = b.project_id AND b_seq = b.act_seq JOIN a_act a ON m.project_id = a.project_id AND a_seq = a.act_seq
  LEFT JOIN moved bn ON bn.project_id = m.project_id AND bn.id = b.activity_id LEFT JOIN a_near an ON an.project_id = m.project_id AND an.id = a.activity_id),
shared AS (SELECT project_id FROM b_act INTERSECT SELECT project_id FROM a_act),
changes AS MATERIALIZED (SELECT project_id, before_activity_id, after_activity_id, stage, CASE WHEN fields = '' AND sets = '' THEN 'UNCHANGED' ELSE 'MODIFIED' END AS status, confidence, fields, sets, b_seq, a_seq FROM pairs
  UNION ALL SELECT project_id, NULL, activity_id, NULL, 'ADDED', 1.0, NULL, NULL, NULL, act_seq FROM a_act WHERE project_id IN (FROM shared) AND (project_id, act_seq) NOT IN (SELECT (project_id, a_seq) FROM m)
  UNION ALL SELECT project_id, activity_id, NULL, NULL, 'DELETED', 1.0, NULL, NULL, act_seq, NULL FROM b_act WHERE project_id IN (FROM shared) AND (project_id, act_seq) NOT IN (SELECT (project_id, b_seq) FROM m))
"""

# ---- identity ----------------------------------------------------------


@_query(f"{MATCH.strip()} SELECT * FROM m1")
def match_exact_id(spark, d):
    return reconcile.exact_matches(*_acts(spark, d)).withColumnRenamed("pk", "project_id")


@_query(f"{MATCH.strip()} SELECT project_id, act_seq, activity_id FROM b_left")
def residual_before(spark, d):
    b, a = _acts(spark, d)
    return reconcile.residual(b, reconcile.exact_matches(b, a), "b_seq").select("project_id", "act_seq", "activity_id")


@_query(f"{MATCH.strip()} SELECT project_id, act_seq, activity_id FROM a_left")
def residual_after(spark, d):
    b, a = _acts(spark, d)
    return reconcile.residual(a, reconcile.exact_matches(b, a), "a_seq").select("project_id", "act_seq", "activity_id")


@_query(f"{MATCH.strip()} SELECT * FROM m2")
def match_wbs_name(spark, d):
    b, a = _acts(spark, d)
    m = reconcile.exact_matches(b, a)
    return reconcile.wbs_name_matches(reconcile.residual(b, m, "b_seq"), reconcile.residual(a, m, "a_seq")).withColumnRenamed("pk", "project_id")


def _rest(spark, d) -> tuple[DataFrame, DataFrame]:
    key = lambda name: (spark.sparkContext.applicationId, d, name)
    if key("rest-b") not in schedule._HELD:
        _, _, b, a = reconcile.residuals(*_acts(spark, d), *_rels(spark, d))
        schedule._HELD[key("rest-b")], schedule._HELD[key("rest-a")] = b, a
    return schedule._HELD[key("rest-b")], schedule._HELD[key("rest-a")]


FUZZY = f"""{MATCH.strip()}, {NEAR.strip()},
br AS MATERIALIZED (SELECT x.*, coalesce(preds, []) AS preds, coalesce(succs, []) AS succs,
  coalesce((SELECT list(DISTINCT lower(y.name)) FROM b_act y WHERE y.project_id = x.project_id AND list_contains(list_concat(preds, succs), y.activity_id)), []) AS names
  FROM b_left x LEFT JOIN b_near n ON n.project_id = x.project_id AND n.id = x.activity_id WHERE (x.project_id, act_seq) NOT IN (SELECT (project_id, b_seq) FROM m2)),
ar AS MATERIALIZED (SELECT x.*, coalesce(preds, []) AS preds, coalesce(succs, []) AS succs,
  coalesce((SELECT list(DISTINCT lower(y.name)) FROM a_act y WHERE y.project_id = x.project_id AND list_contains(list_concat(preds, succs), y.activity_id)), []) AS names
  FROM a_left x LEFT JOIN a_near n ON n.project_id = x.project_id AND n.id = x.activity_id WHERE (x.project_id, act_seq) NOT IN (SELECT (project_id, a_seq) FROM m2)),
cand AS MATERIALIZED (SELECT b.project_id, b.act_seq AS b_seq, a.act_seq AS a_seq, lower(b.name) AS bn, lower(a.name) AS an,
  CASE WHEN b.code = a.code THEN 15 ELSE 0 END + CASE WHEN b.wbs_id = a.wbs_id THEN 15 ELSE 0 END + CASE WHEN b.target_start = a.target_start THEN 5 ELSE 0 END + CASE WHEN b.target_finish = a.target_finish THEN 5 ELSE 0 END
  + CASE WHEN b.dur = a.dur THEN 5 ELSE 0 END + CASE WHEN list_has_any(b.preds, a.preds) THEN 10 ELSE 0 END + CASE WHEN list_has_any(b.succs, a.succs) THEN 10 ELSE 0 END
  + CASE WHEN list_has_any(b.names, a.names) THEN 10 ELSE 0 END AS ctx FROM br b JOIN ar a USING (project_id))
"""


@_query(f"""{FUZZY.strip()} SELECT project_id, b_seq, a_seq, CAST(ctx AS BIGINT) AS context_hundredths FROM cand
  WHERE ctx > 0 AND 0.7 * (2.0 * least(length(bn), length(an)) / (length(bn) + length(an))) + ctx / 100.0 >= 0.7 - 1e-9""")
def fuzzy_candidates(spark, d):
    """Pairs that can be accepted or be rivals, by their context and the lengths of their names."""
    pairs = reconcile.scored_pairs(*_rest(spark, d), reconcile.MatchConfig())
    return pairs.select(F.col("pk").alias("project_id"), "b_seq", "a_seq", F.round(F.col("context") * 100).cast("long").alias("context_hundredths"))


#: The name ratio in SQL: the longest common stretch, the first of them in either name, then the same on both its sides.
_LONGEST = """list_sort(flatten(list_transform(range(1, length({a}) + 1), lambda i: list_transform(range(1, length({b}) + 1), lambda j:
  {{'k': len(list_filter(range(1, least(length({a}) - i, length({b}) - j) + 2), lambda k: substr({a}, i, k) = substr({b}, j, k))), 'i': -i, 'j': -j}}))), 'DESC')[1]"""
SCORES = f"""{FUZZY.strip()},
sg AS (SELECT project_id, b_seq, a_seq, bn AS x, an AS y, {_LONGEST.format(a="bn", b="an")} AS m FROM cand WHERE ctx > 0 AND 0.7 * (2.0 * least(length(bn), length(an)) / (length(bn) + length(an))) + ctx / 100.0 >= 0.7 - 1e-9
  UNION ALL SELECT project_id, b_seq, a_seq, p.x, p.y, {_LONGEST.format(a="p.x", b="p.y")} FROM (SELECT project_id, b_seq, a_seq, unnest([{{'x': substr(x, 1, -m.i - 1), 'y': substr(y, 1, -m.j - 1)}}, {{'x': substr(x, -m.i + m.k), 'y': substr(y, -m.j + m.k)}}]) AS p
    FROM sg WHERE m.k > 0) WHERE p.x <> '' AND p.y <> ''),
sc AS MATERIALIZED (SELECT c.project_id, c.b_seq, c.a_seq, least(1.0, 0.7::DOUBLE * (2.0::DOUBLE * t.m / (length(bn) + length(an))) + ctx / 100.0::DOUBLE) AS score FROM cand c
  JOIN (SELECT project_id, b_seq, a_seq, sum(m.k) AS m FROM sg GROUP BY ALL) t ON t.project_id = c.project_id AND t.b_seq = c.b_seq AND t.a_seq = c.a_seq),
od_ AS MATERIALIZED (SELECT s.project_id, s.b_seq, row_number() OVER (PARTITION BY s.project_id ORDER BY b.activity_id, b.name, s.b_seq) AS r, rivals FROM
  (SELECT project_id, b_seq, list({{'s': score, 'a': a_seq}} ORDER BY score DESC, a_seq) AS rivals FROM sc GROUP BY ALL) s JOIN b_act b ON b.project_id = s.project_id AND b.act_seq = s.b_seq),
gr AS (SELECT project_id, 0::BIGINT AS r, []::BIGINT[] AS taken, NULL::BIGINT AS b_seq, NULL::BIGINT AS a_seq, NULL::DOUBLE AS score, NULL::BOOLEAN AS uncertain FROM (SELECT DISTINCT project_id FROM od_)
  UNION ALL SELECT project_id, r, CASE WHEN free[1].s >= 0.78 THEN list_append(taken, free[1].a) ELSE taken END, b_seq, CASE WHEN free[1].s >= 0.78 THEN free[1].a END, free[1].s, len(free) > 1 AND free[1].s - free[2].s < 0.08
    FROM (SELECT g.project_id, o.r, g.taken, o.b_seq, list_filter(o.rivals, lambda z: NOT list_contains(g.taken, z.a)) AS free FROM gr g JOIN od_ o ON o.project_id = g.project_id AND o.r = g.r + 1)),
m3 AS MATERIALIZED (SELECT project_id, b_seq, a_seq, score, uncertain FROM gr WHERE a_seq IS NOT NULL)
"""


@_query(f"{SCORES.strip()} SELECT project_id, b_seq, a_seq, CAST(round(score * 1000000) AS BIGINT) AS score_millionths FROM sc")
def fuzzy_scores(spark, d):
    s = reconcile.fuzzy_scores(*_rest(spark, d), reconcile.MatchConfig())
    return s.select(F.col("pk").alias("project_id"), "b_seq", "a_seq", F.round(F.col("score") * 1_000_000).cast("long").alias("score_millionths"))


@_query(f"{SCORES.strip()} SELECT project_id, b_seq, a_seq, round(score, 9) AS score, uncertain FROM m3")
def fuzzy_greedy(spark, d):
    b, a = _rest(spark, d)
    config = reconcile.MatchConfig()
    found = reconcile.fuzzy_matches(b, a, reconcile.fuzzy_scores(b, a, config), config)
    return found.withColumn("score", F.round("score", 9)).withColumnRenamed("pk", "project_id")


@_query(f"{CHANGES.strip()} SELECT project_id, before_activity_id, after_activity_id, stage, status, CAST(confidence AS DOUBLE) AS confidence FROM changes")
@_shared
def activity_changes(spark, d, share):
    return _changes(spark, d, share).select("project_id", "before_activity_id", "after_activity_id", "stage", "status", "confidence")


#: The comparison with all three stages: the third one's matches come in, and what is uncertain or a mere rename is told apart.
CHANGES_FUZZY = (
    CHANGES.strip().removeprefix(MATCH.strip()).removeprefix(f", {NEAR.strip()}")
    .replace(" FROM m ", " FROM m_all m ").replace("(SELECT (project_id, a_seq) FROM m)", "(SELECT (project_id, a_seq) FROM m_all)").replace("(SELECT (project_id, b_seq) FROM m)", "(SELECT (project_id, b_seq) FROM m_all)")
    .replace("stage, confidence, b_seq, a_seq,", "stage, confidence, uncertain, b.name IS DISTINCT FROM a.name AS renamed, b_seq, a_seq,")
    .replace("CASE WHEN fields = '' AND sets = ''", "CASE WHEN uncertain THEN 'UNCERTAIN' WHEN stage = 'fuzzy' AND renamed AND fields = 'name' AND sets = '' THEN 'POSSIBLE_RENAME' WHEN fields = '' AND sets = ''")
)
ALL_STAGES = f"""{SCORES.strip()}, m_all AS MATERIALIZED (SELECT *, false AS uncertain FROM m UNION ALL SELECT project_id, b_seq, a_seq, 'fuzzy', round(score, 4), uncertain FROM m3){CHANGES_FUZZY}"""


@_query(f"""{ALL_STAGES} SELECT project_id, before_activity_id, after_activity_id, stage, status, confidence, array_to_string(list_sort(string_split(fields, ',')), ',') AS fields FROM changes""")
@_shared
def activity_changes_fuzzy(spark, d, share):
    c = _changes(spark, d, share, fuzzy=True)
    return c.select("project_id", "before_activity_id", "after_activity_id", "stage", "status", "confidence", F.array_join(F.array_sort(F.map_keys("field_changes")), ",").alias("fields"))


@_query(f"{CHANGES.strip()} SELECT status, stage, count(*) AS n FROM changes GROUP BY ALL")
def status_counts(spark, d):
    return _summed(spark, d, "status_counts", lambda share: report.counts_by(_changes(spark, d, share), "status", "stage"))


@_query(f"""{CHANGES.strip()} SELECT project_id, before_activity_id, after_activity_id, b_seq, list_sort(string_split(fields, ','))::VARCHAR AS fields FROM changes WHERE fields <> ''""")
@_shared
def field_changes(spark, d, share):
    c = _changes(spark, d, share).where(F.size("field_changes") > 0)
    return c.select("project_id", "before_activity_id", "after_activity_id", "b_seq", F.concat(F.lit("["), F.array_join(F.array_sort(F.map_keys("field_changes")), ", "), F.lit("]")).alias("fields"))


@_query(f"{CHANGES.strip()} SELECT project_id, before_activity_id, after_activity_id, b_seq, sets FROM changes WHERE sets <> ''")
@_shared
def neighbour_changes(spark, d, share):
    c = _changes(spark, d, share).where(F.size("set_changes") > 0)
    return c.select("project_id", "before_activity_id", "after_activity_id", "b_seq", F.array_join(F.array_sort(F.map_keys("set_changes")), ",").alias("sets"))


@_query(f"{CHANGES.strip()} SELECT project_id, after_activity_id FROM changes WHERE status = 'ADDED'")
@_shared
def activities_added(spark, d, share):
    return _changes(spark, d, share).where("status = 'ADDED'").select("project_id", "after_activity_id")


@_query(f"{CHANGES.strip()} SELECT project_id, before_activity_id, b_seq FROM changes WHERE status = 'DELETED'")
@_shared
def activities_deleted(spark, d, share):
    return _changes(spark, d, share).where("status = 'DELETED'").select("project_id", "before_activity_id", "b_seq")


# ---- edges -------------------------------------------------------------

EDGES = f"""{CHANGES.strip()},
eo AS (SELECT r.project_id, p.nid AS p, s.nid AS s, relationship_type AS ty, lag_hours AS la, rel_seq, 0 AS side FROM b_rel r LEFT JOIN ids p ON p.project_id = r.project_id AND p.id = predecessor_id
  LEFT JOIN ids s ON s.project_id = r.project_id AND s.id = successor_id),
ea AS MATERIALIZED (SELECT * FROM eo UNION ALL SELECT project_id, predecessor_id, successor_id, relationship_type, lag_hours, rel_seq, 1 FROM a_rel),
eg AS MATERIALIZED (SELECT *, count(*) FILTER (side = 1) OVER w = 1 AND count(*) FILTER (side = 0) OVER w >= 1 AND row_number() OVER (PARTITION BY project_id, p, s, ty, la, side ORDER BY rel_seq) = 1 AS ex
  FROM ea WINDOW w AS (PARTITION BY project_id, p, s, ty, la)),
ex AS (SELECT project_id, p, s, 'UNCHANGED' AS status, false AS ambiguous, 0 AS phase, ty AS o1, la AS o2, min(rel_seq) FILTER (side = 0) AS o3, 0 AS n FROM eg WHERE ex GROUP BY ALL),
er AS (SELECT *, row_number() OVER (PARTITION BY project_id, p, s, side ORDER BY ty, la, rel_seq) AS n FROM eg WHERE NOT ex),
ek AS (SELECT project_id, p, s, greatest(count(*) FILTER (side = 0), count(*) FILTER (side = 1)) > 1 AS ambiguous FROM er GROUP BY ALL),
ep AS (SELECT project_id, p, s, n, bool_or(side = 0) AS old, bool_or(side = 1) AS new FROM er GROUP BY ALL),
e_all AS (SELECT * FROM ex UNION ALL SELECT ep.project_id, ep.p, ep.s, CASE WHEN old AND new THEN CASE WHEN ambiguous THEN 'UNCERTAIN' ELSE 'MODIFIED' END WHEN old THEN 'DELETED' ELSE 'ADDED' END, ambiguous,
  CASE WHEN old AND new THEN 1 WHEN old THEN 2 ELSE 3 END, '', '', 0, n FROM ep JOIN ek ON ep.project_id = ek.project_id AND ep.p IS NOT DISTINCT FROM ek.p AND ep.s IS NOT DISTINCT FROM ek.s),
edge_changes AS MATERIALIZED (SELECT project_id, p AS predecessor_id, s AS successor_id, status, ambiguous,
  CAST(row_number() OVER (PARTITION BY project_id, p, s ORDER BY phase, o1, o2, o3, n) - 1 AS INTEGER) AS occurrence FROM e_all)
"""


def _edge_changes(spark, d, share: int, once: bool = False) -> DataFrame:
    """The edge changes of a share's projects; once: they are read once, so of large tables they aren't written, and what isn't asked of them isn't made."""
    made = lambda: compare_edges(*_edges(spark, d, share), _changes(spark, d, share))
    return made() if once and schedule.shares(spark, d) > 1 else schedule.part(spark, d, "edge-changes", share, made)


@_query(f"{EDGES.strip()} SELECT * FROM edge_changes")
@_shared
def edge_diff(spark, d, share):
    return _edge_changes(spark, d, share).select("project_id", "predecessor_id", "successor_id", "status", "ambiguous", "occurrence")


@_query(f"{EDGES.strip()} SELECT status, ambiguous, count(*) AS n FROM edge_changes GROUP BY ALL")
def edge_diff_counts(spark, d):
    return _summed(spark, d, "edge_diff_counts", lambda share: report.counts_by(_edge_changes(spark, d, share), "status", "ambiguous"))


@_query("x AS (SELECT 1) SELECT project_id, rel_seq, predecessor_id, successor_id FROM a_rel WHERE NOT resolved")
def unresolved_relationships(spark, d):
    return schedule.relationships(spark, d, "after").where("not resolved").select("project_id", "rel_seq", "predecessor_id", "successor_id")


@_query("""x AS (SELECT 1) SELECT project_id, rel_seq, CASE WHEN relationship_type LIKE 'PR\\_%' ESCAPE '\\' THEN substr(relationship_type, 4) ELSE relationship_type END || ' ' || lag_hours || 'h' AS label FROM a_rel""")
def relationship_labels(spark, d):
    r = schedule.relationships(spark, d, "after")
    return r.select("project_id", "rel_seq", relationship_label(F.col("relationship_type"), F.col("lag_hours")).alias("label"))


# ---- graph -------------------------------------------------------------

GRAPH = """
nd AS MATERIALIZED (SELECT * FROM a_act QUALIFY row_number() OVER (PARTITION BY project_id, activity_id ORDER BY act_seq DESC) = 1),
ge AS MATERIALIZED (SELECT r.project_id, predecessor_id AS p, successor_id AS s FROM a_rel r JOIN nd x ON x.project_id = r.project_id AND x.activity_id = predecessor_id
  JOIN nd y ON y.project_id = r.project_id AND y.activity_id = successor_id WHERE resolved)
"""


def _graph(spark, d, share: int | None = None) -> tuple[DataFrame, DataFrame]:
    nodes = graph.nodes_of(schedule.activities(spark, d, "after", share))
    return nodes, graph.edges_of(schedule.relationships(spark, d, "after", share), nodes)


@_query(f"{GRAPH.strip()} SELECT project_id, p AS id, string_agg(s, ',' ORDER BY s) AS near FROM ge GROUP BY ALL")
def immediate_successors(spark, d):
    return graph.immediate(_graph(spark, d)[1]).select(F.col("pk").alias("project_id"), "id", F.array_join("near", ",").alias("near"))


@_query(f"{GRAPH.strip()} SELECT project_id, s AS id, string_agg(p, ',' ORDER BY p) AS near FROM ge GROUP BY ALL")
def immediate_predecessors(spark, d):
    return graph.immediate(_graph(spark, d)[1], outgoing=False).select(F.col("pk").alias("project_id"), "id", F.array_join("near", ",").alias("near"))


@_query(f"""{GRAPH.strip()}, lab AS (SELECT project_id, activity_id AS id, activity_id AS o FROM nd UNION SELECT l.project_id, e.b, l.o FROM lab l
  JOIN (SELECT project_id, p AS a, s AS b FROM ge UNION SELECT project_id, s, p FROM ge) e ON e.project_id = l.project_id AND e.a = l.id)
  SELECT project_id, id, min(o) AS component FROM lab GROUP BY ALL""")
@_shared
def connected_components(spark, d, share):
    nodes, edges = _graph(spark, d, share)
    return graph.components(nodes, edges).withColumnRenamed("pk", "project_id")


@_query(f"""{GRAPH.strip()}, fwd AS (SELECT DISTINCT project_id, p AS o, s AS id FROM ge UNION SELECT f.project_id, f.o, ge.s FROM fwd f JOIN ge ON ge.project_id = f.project_id AND ge.p = f.id)
  SELECT DISTINCT project_id FROM fwd WHERE o = id""")
def has_cycle(spark, d):
    return graph.cyclic_projects(_graph(spark, d)[1]).withColumnRenamed("pk", "project_id")


@_query()
def cycle_paths(spark, d):
    return graph.cycle_paths(_graph(spark, d)[1]).select(F.col("pk").alias("project_id"), F.array_join("cycle", ">").alias("cycle"))


def _turns(spark, d) -> tuple[DataFrame, DataFrame]:
    """Conversations as chains: turns are nodes, and each leads to the next and, from even ones, to the one after it."""
    t = spark.read.parquet(f"{d}/conversations.parquet").select(F.col("conv_id").cast("string").alias("pk"), F.col("turn").cast("string").alias("id"), "turn").distinct()
    by_turn = t.select("pk", F.col("id").alias("s"), F.col("turn").alias("next"))
    steps = t.withColumn("step", F.explode(F.when(F.col("turn") % 2 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    edges = steps.select("pk", F.col("id").alias("p"), (F.col("turn") + F.col("step")).alias("next")).join(by_turn, ["pk", "next"]).select("pk", "p", "s", F.lit(True).alias("traversable"))
    return t.select("pk", "id", F.lit(False).alias("milestone")), edges


TURNS = """
WITH RECURSIVE tn AS (SELECT DISTINCT CAST(conv_id AS VARCHAR) AS c, turn FROM conversations),
te AS (SELECT a.c, CAST(a.turn AS VARCHAR) AS p, CAST(b.turn AS VARCHAR) AS s FROM tn a JOIN tn b ON a.c = b.c AND (b.turn = a.turn + 1 OR (a.turn % 2 = 0 AND b.turn = a.turn + 2))),
rc AS (SELECT c, p AS source, s AS node FROM te UNION SELECT rc.c, source, te.s FROM rc JOIN te ON te.c = rc.c AND te.p = node)
"""


@_query(f"{TURNS.strip()} SELECT c AS conversation, source, node FROM rc", schedules=False)
def reachability_pairs(spark, d):
    nodes, edges = _turns(spark, d)
    return graph.reachable(edges, nodes).withColumnRenamed("pk", "conversation")


@_query(f"{TURNS.strip()} SELECT c AS conversation, source, count(*) AS n FROM rc GROUP BY ALL", schedules=False)
def downstream_counts(spark, d):
    nodes, edges = _turns(spark, d)
    return graph.reachable(edges, nodes).groupBy(F.col("pk").alias("conversation"), "source").agg(F.count(F.lit(1)).alias("n"))


@_query(f"{TURNS.strip()} SELECT c AS conversation, node AS source, count(*) AS n FROM rc GROUP BY ALL", schedules=False)
def upstream_counts(spark, d):
    nodes, edges = _turns(spark, d)
    return graph.reachable(edges, nodes, outgoing=False).groupBy(F.col("pk").alias("conversation"), "source").agg(F.count(F.lit(1)).alias("n"))


@_query(f"""{TURNS.strip()} SELECT t.c AS conversation, t.id AS source, coalesce(sum(deg), 0) > 6 AS truncated FROM (SELECT c, CAST(turn AS VARCHAR) AS id FROM tn) t
  LEFT JOIN (SELECT c, source, node FROM rc UNION SELECT c, p, p FROM te) r ON r.c = t.c AND r.source = t.id LEFT JOIN (SELECT c, p, count(*) AS deg FROM te GROUP BY ALL) g ON g.c = r.c AND g.p = r.node GROUP BY ALL""", schedules=False)
def traversal_limit_flags(spark, d):
    """Whether a walk would look at more than 6 edges: the edges that leave the source and what it reaches."""
    nodes, edges = _turns(spark, d)
    return graph.walk_limits(edges, graph.reachable(edges, nodes), nodes, 6).select(F.col("pk").alias("conversation"), "source", "truncated")


@_query(f"""{TURNS.strip()}, pt AS (SELECT c, p AS source, s AS node, [p, s] AS path FROM te UNION ALL SELECT pt.c, source, te.s, list_append(path, te.s) FROM pt JOIN te ON te.c = pt.c AND te.p = node WHERE NOT list_contains(path, te.s)),
  la AS (SELECT c, CAST(max(turn) AS VARCHAR) AS z FROM tn GROUP BY c) SELECT pt.c AS conversation, source, array_to_string(path, '>') AS path FROM pt JOIN la ON la.c = pt.c AND node = z""", schedules=False)
def simple_paths(spark, d):
    """All simple paths to the last turn of a conversation."""
    nodes, edges = _turns(spark, d)
    last = nodes.groupBy("pk").agg(F.max(F.col("id").cast("long")).cast("string").alias("z"))
    marked = nodes.join(last, "pk").select("pk", "id", (F.col("id") == F.col("z")).alias("milestone"))
    return graph.milestone_paths(marked, edges).select(F.col("pk").alias("conversation"), "source", F.array_join("path", ">").alias("path"))


@_query(f"""{GRAPH.strip()}, pt AS (SELECT project_id, activity_id AS source, activity_id AS node, [activity_id] AS path FROM nd UNION ALL SELECT pt.project_id, source, ge.s, list_append(path, ge.s) FROM pt
  JOIN ge ON ge.project_id = pt.project_id AND ge.p = node WHERE NOT list_contains(path, ge.s) AND len(path) < 3)
  SELECT project_id, source, node, count(*) AS n FROM pt WHERE len(path) = 3 GROUP BY ALL""")
def two_step_paths(spark, d):
    """How many simple paths of two edges lead from one activity to another."""
    edges = _graph(spark, d)[1].where("traversable").select("pk", "p", "s")
    met = edges.alias("a").join(edges.alias("b"), (F.col("a.pk") == F.col("b.pk")) & (F.col("a.s") == F.col("b.p")))
    met = met.where("a.p <> b.s and a.p <> a.s and b.p <> b.s")
    return met.groupBy(F.col("a.pk").alias("project_id"), F.col("a.p").alias("source"), F.col("b.s").alias("node")).agg(F.count(F.lit(1)).alias("n"))


FORWARD = f"""{GRAPH.strip()}, g1 AS MATERIALIZED (SELECT DISTINCT * FROM ge),
  fw AS (SELECT project_id, p AS source, s AS node FROM g1 WHERE p <> s UNION SELECT f.project_id, source, s FROM fw f JOIN g1 ON g1.project_id = f.project_id AND g1.p = node WHERE s <> source)"""


def _walked(found: DataFrame) -> DataFrame:
    return found.select(F.col("pk").alias("project_id"), "source", F.size("activities").cast("long").alias("n"), "truncated")


@_query(f"{FORWARD}, c AS (SELECT project_id, source, count(*) AS n FROM fw GROUP BY ALL) SELECT nd.project_id, activity_id AS source, coalesce(n, 0) AS n, false AS truncated FROM nd LEFT JOIN c ON c.project_id = nd.project_id AND source = activity_id")
def downstream_walks(spark, d):
    """What every activity leads to, and whether its walk was cut."""
    nodes, edges = _graph(spark, d)
    return _walked(graph.walks(nodes, edges, nodes))


@_query(f"{FORWARD}, c AS (SELECT project_id, node, count(*) AS n FROM fw GROUP BY ALL) SELECT nd.project_id, activity_id AS source, coalesce(n, 0) AS n, false AS truncated FROM nd LEFT JOIN c ON c.project_id = nd.project_id AND node = activity_id")
def upstream_walks(spark, d):
    nodes, edges = _graph(spark, d)
    return _walked(graph.walks(nodes, edges, nodes, outgoing=False))


@_query(f"{GRAPH.strip()} SELECT project_id, p, s, count(*) AS n FROM ge GROUP BY ALL HAVING count(*) > 1")
def parallel_edges(spark, d):
    """Pairs of activities with several edges between them."""
    found = graph.edges_between(_graph(spark, d)[1], F.col("p"), F.col("s"))
    return report.counts_by(found, F.col("pk").alias("project_id"), "p", "s").where("n > 1")


@_query("""kn AS (SELECT * FROM b_act QUALIFY row_number() OVER (PARTITION BY activity_id ORDER BY act_seq DESC) = 1), fp AS (SELECT 'P' || min(c_custkey) AS first FROM customer WHERE c_custkey % 19 <> 4)
  SELECT rel_seq, coalesce(s.project_id, first) AS project_id, s.activity_id IS NOT NULL AND p.activity_id IS NOT NULL AS resolved FROM b_edge CROSS JOIN fp
  LEFT JOIN kn s ON s.activity_id = successor_id LEFT JOIN kn p ON p.activity_id = predecessor_id""")
def resolve_relationships(spark, d):
    """Edges as an export has them, with the project they fall to."""
    here = F.lit("before").alias("source_id")
    activities = schedule.activities(spark, d, "before").select(here, "project_id", "activity_id", "act_seq")
    projects = schedule.projects(spark, d, "before").select(here, "project_id", "project_seq")
    return resolved(schedule.raw_edges(spark, d, "before"), activities, projects).select("rel_seq", "project_id", "resolved")


# ---- impact ------------------------------------------------------------

IMPACT = f"""{CHANGES.strip()}, {GRAPH.strip()},
bn_ AS MATERIALIZED (SELECT * FROM b_act QUALIFY row_number() OVER (PARTITION BY project_id, activity_id ORDER BY act_seq DESC) = 1),
be_ AS MATERIALIZED (SELECT r.project_id, predecessor_id AS p, successor_id AS s FROM b_rel r JOIN bn_ x ON x.project_id = r.project_id AND x.activity_id = predecessor_id JOIN bn_ y ON y.project_id = r.project_id AND y.activity_id = successor_id WHERE resolved),
g2 AS MATERIALIZED (SELECT DISTINCT 'a' AS side, * FROM ge UNION SELECT DISTINCT 'b', * FROM be_),
src AS MATERIALIZED (SELECT DISTINCT CASE WHEN status = 'DELETED' THEN 'b' ELSE 'a' END AS side, project_id, CASE WHEN status = 'DELETED' THEN before_activity_id ELSE after_activity_id END AS id FROM changes WHERE status <> 'UNCHANGED'),
rch AS (SELECT side, project_id, id AS source, id AS node FROM src UNION SELECT r.side, r.project_id, source, s FROM rch r JOIN g2 ON g2.side = r.side AND g2.project_id = r.project_id AND g2.p = node),
down AS MATERIALIZED (SELECT * FROM rch WHERE source <> node)
"""


def _impacts(spark, d, share: int, once: bool = False) -> DataFrame:
    """The impacts of a share's projects; once: they are read once, so of large tables they aren't written."""
    made = lambda: impacts(_changes(spark, d, share), *_acts(spark, d, share), *_ways(spark, d, share))
    return made() if once and schedule.shares(spark, d) > 1 else schedule.part(spark, d, "impacts", share, made)


@_query(f"""{IMPACT.strip()}, dc AS (SELECT down.side, down.project_id, source, count(*) AS n, count(*) FILTER (c.id IS NOT NULL) AS ch FROM down LEFT JOIN src c ON c.side = down.side AND c.project_id = down.project_id AND c.id = node GROUP BY down.side, down.project_id, source),
  st AS (SELECT CASE WHEN status = 'DELETED' THEN 'b' ELSE 'a' END AS side, project_id, CASE WHEN status = 'DELETED' THEN before_activity_id ELSE after_activity_id END AS id, status FROM changes WHERE status <> 'UNCHANGED')
  SELECT st.project_id, st.id AS source_activity, status AS change_status, coalesce(n, 0) AS downstream_activity_count, CAST(coalesce(ch, 0) AS INTEGER) AS changed_downstream FROM st
  LEFT JOIN dc ON dc.side = st.side AND dc.project_id = st.project_id AND dc.source = st.id""")
@_shared
def impact_summary(spark, d, share):
    i = _impacts(spark, d, share, once=True)
    return i.select("project_id", "source_activity", "change_status", "downstream_activity_count", F.size("changed_downstream").alias("changed_downstream"))


@_query(f"""{IMPACT.strip()}, ml AS (SELECT 'a' AS side, project_id, activity_id FROM nd WHERE task_type = 'TT_FinMile' UNION ALL SELECT 'b', project_id, activity_id FROM bn_ WHERE task_type = 'TT_FinMile')
  SELECT DISTINCT down.project_id, source AS source_activity, node AS milestone FROM down JOIN ml ON ml.side = down.side AND ml.project_id = down.project_id AND ml.activity_id = node""")
@_shared
def downstream_milestones(spark, d, share):
    i = _impacts(spark, d, share, once=True)
    return i.select("project_id", "source_activity", F.explode("downstream_milestones").alias("milestone")).distinct()


PATHS = f"""{IMPACT.strip()}, ml AS (SELECT 'a' AS side, project_id, activity_id FROM nd WHERE task_type = 'TT_FinMile' UNION ALL SELECT 'b', project_id, activity_id FROM bn_ WHERE task_type = 'TT_FinMile'),
  gm AS MATERIALIZED (SELECT 'a' AS side, * FROM ge UNION ALL SELECT 'b', * FROM be_),
  wk AS (SELECT side, project_id, id AS source, id AS node, [id] AS path FROM src UNION ALL SELECT w.side, w.project_id, source, s, list_append(path, s) FROM wk w
    JOIN gm ON gm.side = w.side AND gm.project_id = w.project_id AND gm.p = node WHERE NOT list_contains(path, s)),
  ip AS MATERIALIZED (SELECT CASE wk.side WHEN 'a' THEN 'after' ELSE 'before' END AS side, wk.project_id, source AS source_activity, node AS milestone_id,
    CAST(row_number() OVER (PARTITION BY wk.side, wk.project_id, source ORDER BY node, path) - 1 AS INTEGER) AS ordinal, path
    FROM wk JOIN ml ON ml.side = wk.side AND ml.project_id = wk.project_id AND ml.activity_id = node WHERE source <> node)"""


@_query(f"{PATHS} SELECT project_id, side, source_activity, milestone_id, ordinal, array_to_string(path, '>') AS path FROM ip")
@_shared
def impact_paths(spark, d, share):
    return impact.impact_paths(_impacts(spark, d, share, once=True)).withColumn("path", F.array_join("path", ">"))


@_query(f"""{EDGES.strip()}, st AS (SELECT DISTINCT project_id, CASE WHEN status = 'DELETED' THEN before_activity_id ELSE after_activity_id END AS id FROM changes WHERE status <> 'UNCHANGED')
  SELECT st.project_id, id AS source_activity, status, count(*) AS n FROM st JOIN edge_changes e ON e.project_id = st.project_id AND (predecessor_id = id OR successor_id = id) GROUP BY ALL""")
@_shared
def impact_edge_changes(spark, d, share):
    """How many edge changes of each status name a changed activity as an end."""
    changes = _changes(spark, d, share)
    source = impact.impact_sources(changes).select(F.nullif("pk", F.lit(NONE)).alias("project_id"), F.col("id").alias("source_activity"))
    return report.counts_by(impact.touching(source, _edge_changes(spark, d, share, once=True)), "project_id", "source_activity", "status")


# ---- projects, breakdown, calendars ------------------------------------

PROJECTS = """
pb AS (SELECT 'P' || c_custkey AS project_id, CASE WHEN c_custkey % 23 <> 5 THEN c_name END AS name FROM customer WHERE c_custkey % 19 <> 4),
pa AS (SELECT 'P' || c_custkey AS project_id, CASE WHEN c_custkey % 23 <> 5 THEN c_name END AS name FROM customer WHERE c_custkey % 17 <> 3)
"""


@_query(f"WITH {PROJECTS.strip()} SELECT project_id, CASE WHEN a.project_id IS NULL THEN 'DELETED' WHEN b.project_id IS NULL THEN 'ADDED' ELSE 'MATCHED' END AS status FROM pb b FULL JOIN pa a USING (project_id)", schedules=False)
def project_alignment(spark, d):
    return report.align_projects(schedule.projects(spark, d, "before"), schedule.projects(spark, d, "after")).select("project_id", "status")


@_query(f"WITH {PROJECTS.strip()} SELECT project_id, 'DELETED' AS status FROM pb WHERE project_id NOT IN (SELECT project_id FROM pa) UNION ALL SELECT project_id, 'ADDED' FROM pa WHERE project_id NOT IN (SELECT project_id FROM pb)", schedules=False)
def unmatched_projects(spark, d):
    return report.align_projects(schedule.projects(spark, d, "before"), schedule.projects(spark, d, "after")).where("status <> 'MATCHED'").select("project_id", "status")


WBS = """
WITH RECURSIVE wn AS (SELECT 'R' || r_regionkey AS id, NULL AS parent FROM region
  UNION ALL SELECT 'N' || n_nationkey, CASE WHEN n_nationkey % 7 = 6 THEN 'N' || n_nationkey ELSE 'R' || n_regionkey END FROM nation
  UNION ALL SELECT 'P' || c_custkey, 'N' || c_nationkey FROM customer UNION ALL SELECT 'O' || o_orderkey, CASE WHEN o_orderkey % 29 = 0 THEN 'P-' ELSE 'P' || o_custkey END FROM orders),
tr AS (SELECT id, 0 AS depth, id AS path FROM wn WHERE parent IS NULL OR parent = id OR parent NOT IN (SELECT id FROM wn) UNION ALL SELECT wn.id, depth + 1, path || '/' || wn.id FROM tr JOIN wn ON wn.parent = tr.id AND wn.parent <> wn.id)
"""


@_query(f"{WBS.strip()} SELECT id AS wbs_id, CAST(depth AS INTEGER) AS depth, path FROM tr", schedules=False)
def wbs_tree_depth(spark, d):
    tree = wbs_tree(schedule.wbs(spark, d), [])
    return tree.select("wbs_id", "depth", F.array_join("path", "/").alias("path"))


@_query(f"{WBS.strip()} SELECT id AS wbs_id FROM tr WHERE depth = 0", schedules=False)
def wbs_roots(spark, d):
    return wbs_tree(schedule.wbs(spark, d), []).where("is_root").select("wbs_id")


@_query("SELECT 'K' || r_regionkey AS calendar_id, 'P' || n_nationkey AS project_id, r_name AS name FROM region CROSS JOIN nation", schedules=False)
def calendar_sharing(spark, d):
    calendars = spark.read.parquet(f"{d}/region.parquet").select(F.lit("x").alias("source_id"), F.concat(F.lit("K"), "r_regionkey").alias("calendar_id"), F.col("r_name").alias("name"))
    own = spark.read.parquet(f"{d}/nation.parquet").select(F.lit("x").alias("source_id"), F.concat(F.lit("P"), "n_nationkey").alias("project_id"))
    return share_calendars(calendars, own).select("calendar_id", "project_id", "name")


# ---- exports -----------------------------------------------------------


def _exports(spark, d) -> xer.Exports:
    """An export per project, with a short, a long and two broken lines at fixed residues, and a table that is not known."""
    a = schedule.activities(spark, d, "before").where("activity_id <> ''")
    k = F.col("act_seq")
    cells = F.concat_ws("\t", F.lit("%R"), "activity_id", "project_id", "wbs_id", "code", "name", "status")
    line = F.when(k % 103 == 0, cells).when(k % 107 == 0, F.concat(cells, F.lit("\t"), "target_finish", F.lit("\tzz\tyy"))).otherwise(F.concat(cells, F.lit("\t"), "target_finish"))
    line = F.when(k % 109 == 0, F.concat(line, F.lit("\ngarbage"))).when(k % 113 == 0, F.concat(line, F.lit("\r\n\r\n%Q\tq"))).otherwise(line)
    rows = a.select("project_id", "act_seq", line.alias("line")).groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("act_seq", "line"))).alias("x"))
    text = F.concat(
        F.lit("%T\tPROJECT\n%F\tproj_id\tproj_name\n%R\t"), "project_id", F.lit("\tname of "), "project_id",
        F.lit("\n%T\ttask \n%F\ttask_id\tproj_id\twbs_id\ttask_code\ttask_name\tstatus_code\tfinish_hint\n"), F.array_join(F.transform("x", lambda r: r["line"]), "\n"),
        F.lit("\n%T\tVENDOR\n%F\tfoo\tbar\n%R\t"), "project_id", F.lit("\t\n%E\n"),
    )
    return xer.parse_text(rows.select(F.col("project_id").alias("source_id"), text.alias("text")))


@_query("""x AS (SELECT 1) SELECT project_id AS source_id, activity_id AS task_id, wbs_id, name AS task_name, CASE WHEN act_seq % 103 <> 0 THEN target_finish END AS finish_hint,
  CASE WHEN act_seq % 107 = 0 AND act_seq % 103 <> 0 THEN 'zz' || chr(9) || 'yy' END AS extra, CAST(row_number() OVER (PARTITION BY project_id ORDER BY act_seq) - 1 AS INTEGER) AS rec_idx FROM b_act""")
def xer_roundtrip_tasks(spark, d):
    t = _exports(spark, d).table("TASK")
    cell = lambda c: F.try_element_at("rec", F.lit(c)).alias(c)
    return t.select("source_id", cell("task_id"), cell("wbs_id"), cell("task_name"), cell("finish_hint"), "extra", "rec_idx")


@_query("""ln AS (SELECT project_id, act_seq, row_number() OVER w + 5 + coalesce(sum(CASE WHEN act_seq % 109 = 0 THEN 1 WHEN act_seq % 113 = 0 THEN 2 ELSE 0 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line FROM b_act WINDOW w AS (PARTITION BY project_id ORDER BY act_seq))
  SELECT project_id AS source_id, CAST(line AS INTEGER) AS line_number, 'record has fewer values than declared fields' AS message FROM ln WHERE act_seq % 103 = 0
  UNION ALL SELECT project_id, CAST(line AS INTEGER), 'record has more values than declared fields' FROM ln WHERE act_seq % 107 = 0 AND act_seq % 103 <> 0
  UNION ALL SELECT project_id, CAST(line + 1 AS INTEGER), 'malformed non-XER record' FROM ln WHERE act_seq % 109 = 0
  UNION ALL SELECT project_id, CAST(line + 2 AS INTEGER), 'unknown control record %Q' FROM ln WHERE act_seq % 113 = 0 AND act_seq % 109 <> 0""")
def xer_diagnostics(spark, d):
    return _exports(spark, d).diagnostics.select("source_id", "line_number", "message")


@_query("x AS (SELECT 1) SELECT DISTINCT project_id AS source_id, 'VENDOR' AS \"table\", project_id AS foo, NULL::VARCHAR AS bar FROM b_act")
def raw_unknown_tables(spark, d):
    return _exports(spark, d).unknown_tables.select("source_id", "table", F.try_element_at("rec", F.lit("foo")).alias("foo"), F.try_element_at("rec", F.lit("bar")).alias("bar"))


@_query("x AS (SELECT 1) SELECT project_id, activity_id, CASE WHEN act_seq % 103 <> 0 THEN target_finish END AS finish_hint FROM b_act")
def extras_projection(spark, d):
    a = normalize(_exports(spark, d)).activities
    return a.select("project_id", "activity_id", F.try_element_at("extras", F.lit("finish_hint")).alias("finish_hint"))


@_query("x AS (SELECT 1) SELECT project_id, 'name of ' || project_id AS name, count(*) AS n_activities FROM b_act GROUP BY ALL")
def project_normalize(spark, d):
    n = normalize(_exports(spark, d))
    return n.activities.groupBy("project_id").agg(F.count(F.lit(1)).alias("n_activities")).join(n.projects.select("project_id", "name"), "project_id")


# ---- evidence and report -----------------------------------------------


def _evidence_rows(spark, d, side: str) -> DataFrame:
    a = schedule.activities(spark, d, side)
    values = F.array("activity_id", "name", "status")
    src = F.struct(F.lit("TASK").alias("table"), F.array(*map(F.lit, ("task_id", "task_name", "status_code"))).alias("fields"), values.alias("values"), F.col("act_seq").cast("int").alias("line_number"), F.concat(F.lit("%R\t"), F.array_join(values, "\t")).alias("raw_line"))
    return a.select("project_id", "act_seq", "activity_id", src.alias("src"))


EVIDENCE = """ev AS (SELECT side, project_id, act_seq, activity_id, 'ev_' || substr(sha256('{"fields":["task_id","task_name","status_code"],"line_number":' || CAST(act_seq AS INTEGER) || ',"raw_line":"%R\\t' || activity_id || '\\t' || name || '\\t' || status
  || '","side":"' || side || '","table":"TASK","values":["' || activity_id || '","' || name || '","' || status || '"]}'), 1, 12) AS evidence_id
  FROM (SELECT 'before' AS side, * FROM b_act UNION ALL SELECT 'after', * FROM a_act))"""


@_query(f"{EVIDENCE} SELECT side, project_id, act_seq, evidence_id FROM ev")
def evidence_ids(spark, d):
    out = None
    for side in evidence.SIDES:
        rows = _evidence_rows(spark, d, side).select(F.lit(side).alias("side"), "project_id", "act_seq", evidence.evidence_id(F.lit(side), F.col("src")).alias("evidence_id"))
        out = rows if out is None else out.unionByName(rows)
    return out


@_query(f"{EVIDENCE} SELECT side, count(DISTINCT evidence_id) AS n FROM ev GROUP BY side")
def evidence_dedup(spark, d):
    out = None
    for side in evidence.SIDES:
        rows = _evidence_rows(spark, d, side)
        rows = evidence.register(rows.unionByName(rows), side).groupBy("side").agg(F.count(F.lit(1)).alias("n"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _recorded(spark, d, share: int | None = None) -> tuple[tuple[DataFrame, ...], tuple[DataFrame, ...]]:
    """Activities, edges and projects of both versions with raw records, which are put together when they are read."""
    return tuple(tuple(schedule.with_records(made(spark, d, side, share)) for made in (schedule.activities, schedule.relationships, schedule.projects)) for side in ("before", "after"))


def _order_names(activities: DataFrame) -> DataFrame:
    """The breakdown nodes that activities belong to: orders, with the names that they go by."""
    number = F.substring("wbs_id", 2, 20)
    return activities.select("project_id", "wbs_id").distinct().select("project_id", "wbs_id", F.lit(None).cast("string").alias("parent_wbs_id"), F.concat(F.lit("order "), number).alias("name"), number.cast("long").alias("wbs_seq"))


def _recorded_changes(spark, d, share: int, fuzzy: bool = False) -> DataFrame:
    sides = [tuple(map(schedule.with_records, x)) for x in (_acts(spark, d, share), _edges(spark, d, share))]
    return schedule.part(spark, d, f"changes-src-{fuzzy}", share, lambda: reconcile.compare_activities(*sides[0], *sides[1], fuzzy=fuzzy))


EDGE_EVIDENCE = """'ev_' || substr(sha256('{"fields":["task_id","pred_task_id","pred_type","lag_hr_cnt"],"line_number":' || rel_seq || ',"raw_line":"%R\\t' || successor_id || '\\t' || predecessor_id || '\\t' || relationship_type || '\\t' || lag_hours
  || '","side":"' || side || '","table":"TASKPRED","values":["' || successor_id || '","' || predecessor_id || '","' || relationship_type || '","' || lag_hours || '"]}'), 1, 12)"""


@_query(f"""{CHANGES.strip()}, {EVIDENCE} SELECT c.project_id, before_activity_id, after_activity_id, coalesce(b_seq, a_seq) AS seq, b.evidence_id AS before_evidence, a.evidence_id AS after_evidence, coalesce(x.name, y.name) AS label FROM changes c
  LEFT JOIN ev b ON b.side = 'before' AND b.project_id = c.project_id AND b.act_seq = b_seq LEFT JOIN ev a ON a.side = 'after' AND a.project_id = c.project_id AND a.act_seq = a_seq
  LEFT JOIN b_act x ON x.project_id = c.project_id AND x.act_seq = b_seq LEFT JOIN a_act y ON y.project_id = c.project_id AND y.act_seq = a_seq""")
@_shared
def change_evidence(spark, d, share):
    """The records behind every change, and the name it goes by."""
    c = report.change_refs(report.change_labels(_recorded_changes(spark, d, share)))
    return c.select("project_id", "before_activity_id", "after_activity_id", F.coalesce("b_seq", "a_seq").alias("seq"), "before_evidence", "after_evidence", "label")


@_query(f"""{CHANGES.strip()}, {EVIDENCE}, {PROJECTS.strip()}, both_ AS (SELECT project_id FROM pb INTERSECT SELECT project_id FROM pa),
  ac AS (SELECT 'before' AS side, * FROM b_act UNION ALL SELECT 'after', * FROM a_act), la AS (SELECT * FROM ac WHERE project_id IN (FROM both_) QUALIFY row_number() OVER (PARTITION BY side, project_id, activity_id ORDER BY act_seq DESC) = 1),
  ch AS (SELECT side, project_id, CASE side WHEN 'before' THEN before_activity_id ELSE after_activity_id END AS id, CASE side WHEN 'before' THEN after_activity_id ELSE before_activity_id END AS other, status, confidence,
    row_number() OVER (PARTITION BY side, project_id, id ORDER BY CASE stage WHEN 'id' THEN 0 WHEN 'wbs_name' THEN 1 ELSE CASE status WHEN 'ADDED' THEN 3 ELSE 4 END END DESC, coalesce(before_activity_id, after_activity_id) DESC, coalesce(b_seq, a_seq) DESC) AS r
    FROM changes CROSS JOIN (VALUES ('before'), ('after')) v(side))
  SELECT la.side, la.project_id, la.activity_id, la.name, la.wbs_id, 'order ' || substr(la.wbs_id, 2) AS wbs_name, la.task_type = 'TT_FinMile' AS is_milestone, la.status, ch.status AS change_status, other AS counterpart_activity_id, confidence, evidence_id
  FROM la JOIN ev ON ev.side = la.side AND ev.project_id = la.project_id AND ev.act_seq = la.act_seq LEFT JOIN ch ON ch.side = la.side AND ch.project_id = la.project_id AND ch.id = la.activity_id AND r = 1""")
@_shared
def activity_metadata(spark, d, share):
    (b, _, bp), (a, _, ap) = _recorded(spark, d, share)
    found = report.activity_metadata(report.align_projects(bp, ap), _changes(spark, d, share), b, a, *map(_order_names, (b, a)))
    return found.drop("milestone_type")


@_query(f"""{PROJECTS.strip()}, un AS (SELECT 'before' AS side, * FROM b_rel WHERE NOT resolved UNION ALL SELECT 'after', * FROM a_rel WHERE NOT resolved)
  SELECT side, project_id, rel_seq, predecessor_id, successor_id, relationship_type, lag_hours, {EDGE_EVIDENCE} AS evidence_id FROM un WHERE project_id IN (SELECT project_id FROM pb INTERSECT SELECT project_id FROM pa)""")
def unresolved_evidence(spark, d):
    (_, br, bp), (_, ar, ap) = _recorded(spark, d)
    return report.unresolved(report.align_projects(bp, ap), br, ar).drop("reason")


@_query(f"""{PATHS}, {EVIDENCE}, re AS (SELECT 'before' AS side, * FROM b_rel UNION ALL SELECT 'after', * FROM a_rel), ee AS MATERIALIZED (SELECT side, project_id, predecessor_id AS p, successor_id AS s, rel_seq, {EDGE_EVIDENCE} AS evidence_id FROM re WHERE resolved),
  en AS MATERIALIZED (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY side, project_id, activity_id ORDER BY act_seq DESC) = 1),
  hp AS MATERIALIZED (SELECT side, project_id, source_activity, ordinal, unnest(path) AS id, generate_subscripts(path, 1) AS hop, path FROM ip),
  pn AS (SELECT hp.side, hp.project_id, source_activity, ordinal, string_agg(evidence_id, ',' ORDER BY hop) AS nodes FROM hp JOIN en ON en.side = hp.side AND en.project_id = hp.project_id AND en.activity_id = id GROUP BY ALL),
  pe AS (SELECT hp.side, hp.project_id, source_activity, ordinal, string_agg(evidence_id, ',' ORDER BY hop, rel_seq) AS edges FROM hp JOIN ee ON ee.side = hp.side AND ee.project_id = hp.project_id AND ee.p = id AND ee.s = path[hop + 1] GROUP BY ALL)
  SELECT side, project_id, source_activity, ordinal, nodes, edges FROM pn JOIN pe USING (side, project_id, source_activity, ordinal)""")
@_shared
def path_evidence(spark, d, share):
    """The records of the activities and edges along every path to a milestone."""
    sides = [tuple(map(schedule.with_records, x)) for x in (_acts(spark, d, share), _ways(spark, d, share))]
    found = impact.paths_with_records(impacts(_changes(spark, d, share), *sides[0], *sides[1], records=True))
    return found.select("side", "project_id", "source_activity", "ordinal", F.array_join("nodes", ",").alias("nodes"), F.array_join("edges", ",").alias("edges"))


@_query(f"""{CHANGES.strip()} SELECT project_id, before_activity_id, after_activity_id, status FROM changes QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY status = 'UNCHANGED',
  CASE stage WHEN 'id' THEN 0 WHEN 'wbs_name' THEN 1 ELSE CASE status WHEN 'ADDED' THEN 3 ELSE 4 END END, coalesce(before_activity_id, after_activity_id), coalesce(b_seq, a_seq)) = 1""")
@_shared
def first_change(spark, d, share):
    return report.first_change(_changes(spark, d, share)).select("project_id", "before_activity_id", "after_activity_id", "status")


@_query(f"{EDGES.strip()} SELECT project_id, predecessor_id, successor_id, status, occurrence FROM edge_changes WHERE predecessor_id IS NOT NULL AND successor_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY project_id, predecessor_id, successor_id ORDER BY occurrence DESC) = 1")
@_shared
def edge_lookup(spark, d, share):
    return report.edge_lookup(_edge_changes(spark, d, share))


@_query(f"""{EDGES.strip()}, {PROJECTS.strip()}, {GRAPH.strip()}, {IMPACT[IMPACT.index("bn_ AS"):IMPACT.index("g2 AS")].strip()} fwa AS (SELECT DISTINCT project_id, p AS o, s AS id FROM ge UNION SELECT f.project_id, f.o, ge.s FROM fwa f JOIN ge ON ge.project_id = f.project_id AND ge.p = f.id),
  both_ AS (SELECT project_id, pb.name AS bname, pa.name AS aname FROM pb JOIN pa USING (project_id))
  SELECT project_id, 'MISSING_PROJECT_METADATA' AS code, count(*) AS n FROM (SELECT project_id FROM both_ WHERE bname IS NULL UNION ALL SELECT project_id FROM both_ WHERE aname IS NULL) GROUP BY ALL
  UNION ALL SELECT project_id, 'UNRESOLVED_RELATIONSHIP', CAST(bool_or(side = 0) AS INTEGER) + 1 FROM (SELECT project_id, 0 AS side FROM b_rel WHERE NOT resolved UNION ALL SELECT project_id, 1 FROM a_rel WHERE NOT resolved) WHERE project_id IN (SELECT project_id FROM both_) GROUP BY ALL
  UNION ALL SELECT project_id, 'CYCLE_DETECTED', count(DISTINCT project_id) FROM fwa WHERE o = id AND project_id IN (SELECT project_id FROM both_) GROUP BY ALL
  UNION ALL SELECT project_id, 'PROJECT_DELETED', 1 FROM pb WHERE project_id NOT IN (SELECT project_id FROM pa) UNION ALL SELECT project_id, 'PROJECT_ADDED', 1 FROM pa WHERE project_id NOT IN (SELECT project_id FROM pb)""")
@_shared
def warning_counts(spark, d, share):
    w = report.warnings(*_projects(spark, d, share), _changes(spark, d, share), *_acts(spark, d, share), *_rels(spark, d, share))
    return w.groupBy("project_id", "code").agg(F.count(F.lit(1)).alias("n"))


@_query(f"""{EDGES.strip()}, {PROJECTS.strip()} SELECT (SELECT count(*) FROM (SELECT project_id FROM pb UNION SELECT project_id FROM pa)) AS projects, (SELECT count(*) FROM changes) AS activity_changes, (SELECT count(*) FROM edge_changes) AS relationship_changes""")
def report_summary_counts(spark, d):
    def counted(share: int) -> DataFrame:
        return report.summary(report.align_projects(*_projects(spark, d, share)), _changes(spark, d, share), _edge_changes(spark, d, share))

    out = schedule.in_shares(spark, d, "report_summary_counts", counted)
    return out.agg(*[F.sum(c).alias(c) for c in out.columns])


@_query("x AS (SELECT 1) SELECT project_id, activity_id, name FROM a_act WHERE contains(lower(concat_ws(' ', name, activity_id)), 'insp')")
def activity_search(spark, d):
    return report.search(schedule.activities(spark, d, "after"), "INSP").select("project_id", "activity_id", "name")


@_query(f"{CHANGES.strip()} SELECT project_id, before_activity_id, after_activity_id, status FROM changes QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY status = 'UNCHANGED', coalesce(b_seq, a_seq), status) <= 8")
@_shared
def changed_first_topk(spark, d, share):
    return report.changed_first(_changes(spark, d, share), 8).select("project_id", "before_activity_id", "after_activity_id", "status")


@_query("SELECT p_partkey, lower(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))) AS name FROM part", schedules=False)
def name_normalize(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    return p.select("p_partkey", normal_name(F.concat(F.lit("  "), F.upper("p_name"), F.lit("\t "))).alias("name"))


@_query("x AS (SELECT 1) SELECT project_id, rel_seq, substr(relationship_type, 4) AS type FROM b_rel")
def relationship_types(spark, d):
    r = schedule.relationships(spark, d, "before")
    return r.select("project_id", "rel_seq", relationship_type(F.col("relationship_type")).alias("type"))


@_query("x AS (SELECT 1) SELECT project_id, activity_id, act_seq FROM b_act QUALIFY row_number() OVER (PARTITION BY project_id, activity_id ORDER BY act_seq DESC) = 1")
def last_duplicate_wins(spark, d):
    return last_wins(schedule.activities(spark, d, "before"), ["project_id", "activity_id"], "act_seq").select("project_id", "activity_id", "act_seq")


@_query()
@_shared
def report_json(spark, d, share):
    """The nested report of every project, as JSON text; the tests hold its parts against small cases."""
    (b, br, bp), (a, ar, ap) = _recorded(spark, d, share)
    ends, ways = (tuple(map(schedule.with_records, made(spark, d, share))) for made in (_edges, _ways))
    changes = _recorded_changes(spark, d, share, fuzzy=True)
    edges = schedule.part(spark, d, "edge-changes-src", share, lambda: compare_edges(*ends, changes))
    told = schedule.part(spark, d, "impacts-fuzzy-src", share, lambda: impacts(changes, b, a, *ways, records=True))
    aligned = report.align_projects(bp, ap)
    lost = schedule.part(spark, d, "lost-src", share, lambda: report.unresolved(aligned, br, ar))
    warned = report.warnings(bp, ap, changes, b, a, br, ar, told, lost)
    metadata = report.activity_metadata(aligned, changes, b, a, *map(_order_names, (b, a)))
    records = [last_wins(p, ["project_id"], "project_seq").select("project_id", F.lit(side == "after").alias("later"), evidence.ref(side, F.col("src")).alias("evidence_id")) for side, p in zip(evidence.SIDES, (bp, ap), strict=True)]
    return report.project_reports(aligned, changes, edges, told, warned, metadata, None, lost, records[0].unionByName(records[1]), every_edge=True)
