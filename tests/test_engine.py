"""The schedule engine on small exports: formats, identity, edges, graph, impact, evidence."""

import hashlib
import json
import random
from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from planweave import __main__ as command
from planweave import compare as comparing
from planweave.functions.text import is_milestone, normal_name, relationship_label, relationship_type, rounded
from planweave.operators import evidence, graph, impact, reconcile, report
from planweave.operators.edges import compare_edges
from planweave.operators.impact import impacts, touching
from planweave.operators.normalize import normalize, wbs_names, wbs_tree
from planweave.sources import xer


def export(tasks, edges, project="P1", name="Project one", more=""):
    lines = [f"%T\tPROJECT\n%F\tproj_id\tproj_name\n%R\t{project}\t{name}"] if project else []
    lines += ["%T\tTASK", "%F\ttask_id\tproj_id\twbs_id\ttask_name\ttask_type\ttarget_start_date\ttarget_end_date\tremain_drtn_hr_cnt\ttask_code"]
    lines += ["%R\t" + "\t".join(map(str, (t[0], project or "", *t[1:]))) for t in tasks]
    lines += ["%T\tTASKPRED", "%F\ttask_id\tpred_task_id\tpred_type\tlag_hr_cnt"]
    lines += ["%R\t" + "\t".join(map(str, e)) for e in edges]
    return ("\n".join(lines) + "\n" + more + "%E\n").encode()


def task(i, name="", wbs="W", kind="TT_Task", start="2026-01-01", finish="2026-01-02", hours="8", code=""):
    return (i, wbs, name or f"Activity {i}", kind, start, finish, hours, code)


@pytest.fixture(scope="module")
def compare(spark):
    def run(before, after, **kw):
        b, a = normalize(xer.parse_bytes(spark, {"b": before})), normalize(xer.parse_bytes(spark, {"a": after}))
        changes = reconcile.compare_activities(b.activities, a.activities, b.relationships, a.relationships, **kw)
        return b, a, changes

    return run


def read_lines(text):
    """A loop over lines, to hold the windows against."""
    tables, said, table, fields, found = {}, [], None, None, []
    for n, line in enumerate(text.splitlines(), 1):
        if not line:
            continue
        cells = line.split("\t")
        mark = cells[0].lstrip("﻿")
        if mark == "%T":
            table = fields = None
            if len(cells) == 2 and cells[1].strip():
                table = cells[1].strip().upper()
                tables[table] = []
            else:
                said.append((n, xer.BAD_TABLE))
        elif mark == "%F":
            if table is None:
                said.append((n, xer.FIELDS_WITHOUT_TABLE))
            elif len(cells) < 2:
                said.append((n, xer.BAD_FIELDS))
            else:
                fields = cells[1:]
        elif mark == "%R":
            if table is None or not fields:
                said.append((n, xer.RECORD_WITHOUT_FIELDS))
                continue
            values = cells[1:]
            if len(values) > len(fields):
                said.append((n, xer.LONG_RECORD))
            if len(values) < len(fields):
                said.append((n, xer.SHORT_RECORD))
            row = {f: (values[i] or None) if i < len(values) else None for i, f in enumerate(fields)}
            extra = "\t".join(values[len(fields) :]) if len(values) > len(fields) else None
            tables[table].append((n, row, extra, fields, values))
        elif mark == "%E":
            table = fields = None
        else:
            said.append((n, xer.UNKNOWN_CONTROL + mark if mark.startswith("%") else xer.BAD_LINE))
    return tables, said


def test_parser_is_the_loop(spark):
    r = random.Random(5)
    parts = ["%T\tTASK", "%T\t task ", "%T", "%T\tX\tY", "%F\ta\tb", "%F\ta\ta\tb", "%F", "%R\t1\t2", "%R\t1", "%R\t1\t\t3\t4", "%R", "%E", "%Q", "junk", " ", "", "﻿%T\tB", "%R\té\tü"]
    ends = ["\n", "\r\n", "\r", "\x0b", "\x1e", "\x85", " "]
    files = {f"f{i}": "".join(r.choice(parts) + r.choice(ends) for _ in range(r.randint(0, 25))) for i in range(150)}
    got = xer.parse_text(spark.createDataFrame(list(files.items()), "source_id string, text string"))
    rows = [(x.source_id, x.table, x.rec_idx, x.line_number, dict(x.rec), x.extra, list(x.fields), list(x["values"])) for x in got.records.collect()]
    said = [(x.source_id, x.line_number, x.message) for x in got.diagnostics.collect()]
    want_rows, want_said = [], []
    for k, text in files.items():
        tables, d = read_lines(text)
        want_rows += [(k, t, i, *x) for t, own in tables.items() for i, x in enumerate(own)]
        want_said += [(k, *x) for x in d]
    assert sorted(rows, key=str) == sorted(want_rows, key=str)
    assert sorted(said) == sorted(want_said)


def test_charsets():
    assert xer.decode_bytes("é".encode()) == "é"
    assert xer.decode_bytes(b"\xef\xbb\xbfx") == "x"
    assert xer.decode_bytes(b"\xe9\x80") == "é€"
    assert xer.decode_bytes(b"\xe9\x81") == "é\x81"


def test_missing_file_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        xer.read_exports(spark, str(tmp_path / "none.xer"))
    (tmp_path / "a.xer").write_bytes(export([task("A")], []))
    assert xer.read_exports(spark, str(tmp_path)).table("TASK").count() == 1


def test_normalize(spark):
    text = "%T\tCALENDAR\n%F\tclndr_id\n%R\tC1\n%T\tTASKPRED\n%F\ttask_id\tpred_task_id\n%R\tA\tB\n%R\tZ\tA\n%T\tTASK\n%F\ttask_id\tproj_id\tcustom\n%R\tA\tP1\tx\n%R\tB\tP2\t\n%T\tPROJECT\n%F\tproj_id\tproj_name\n%R\tP1\told\n%R\tP0\tzero\n%R\tP1\tnew\n"
    n = normalize(xer.parse_text(spark.createDataFrame([("s", text)], "source_id string, text string")))
    projects = [(p.project_id, p.name) for p in n.projects.orderBy("project_seq").collect()]
    assert projects == [("P1", "new"), ("P0", "zero"), ("P2", None)]
    assert [(r.successor_id, r.project_id, r.resolved) for r in n.relationships.orderBy("rel_seq").collect()] == [("A", "P1", True), ("Z", "P1", False)]
    assert n.calendars.count() == 3
    assert {r.activity_id: dict(r.extras) for r in n.activities.collect()} == {"A": {"custom": "x"}, "B": {"custom": None}}
    alone = normalize(xer.parse_text(spark.createDataFrame([("s", "%T\tTASKPRED\n%F\ttask_id\tpred_task_id\n%R\tA\tB\n")], "source_id string, text string")))
    assert [p.project_id for p in alone.projects.collect()] == [None] and alone.relationships.first().resolved is False
    loose = normalize(xer.parse_text(spark.createDataFrame([("s", "%T\tTASK\n%F\ttask_id\tproj_id\n%R\tA\tP\n")], "source_id string, text string")))
    assert [p.project_id for p in loose.projects.orderBy("project_seq").collect()] == [None, "P"]


def test_breakdown_tree(spark):
    rows = [("P", "r", None, 1), ("P", "a", "r", 2), ("P", "b", "a", 3), ("P", "x", "y", 4), ("P", "y", "x", 5), ("P", "o", "gone", 6), ("P", "s", "s", 7)]
    tree = wbs_tree(spark.createDataFrame(rows, "project_id string, wbs_id string, parent_wbs_id string, wbs_seq long"), ["project_id"])
    assert {(t.wbs_id, t.depth, "/".join(t.path)) for t in tree.collect()} == {("r", 0, "r"), ("a", 1, "r/a"), ("b", 2, "r/a/b"), ("o", 0, "o"), ("s", 0, "s")}


def test_names_and_types(spark):
    names = ["  Straße\t ONE\x1c ", "Σίσυφος ΟΔΟΣ", None, "ﬁne İ", " a ", "Ꭰꭰ"]
    import re

    got = [r.n for r in spark.createDataFrame([(i, x) for i, x in enumerate(names)], "i int, x string").orderBy("i").select(normal_name(F.col("x")).alias("n")).collect()]
    assert got == [re.sub(r"\s+", " ", (x or "").strip().casefold()) for x in names]
    kinds = spark.createDataFrame([("pr_fs", "TT_Mile", None), ("PR_XX", "tt_finmile", "8"), (None, None, None)], "r string, t string, l string")
    assert [tuple(r) for r in kinds.select(relationship_type(F.col("r")), is_milestone(F.col("t")), relationship_label(F.col("r"), F.col("l"))).collect()] == [
        ("FS", True, "pr_fs 0h"), ("PR_XX", True, "XX 8h"), ("", False, " 0h")
    ]
    assert spark.range(1).select(rounded(F.lit(2.67495))).first()[0] == round(2.67495, 4)


def test_changes_of_a_matched_activity(compare):
    """Of four activities one stays, one moves in three ways and gets another successor, one goes and one comes."""
    b = export([task("survey"), task("dig", wbs="pit"), task("shore", name="Shore the pit walls")], [("dig", "survey", "PR_SS", 4), ("shore", "dig", "PR_FS", 0)])
    a = export([task("survey"), task("dig", wbs="trench", finish="2027-03-09", hours="31"), task("pave", name="Lay kerb stones")], [("dig", "survey", "PR_SS", 4), ("pave", "dig", "PR_FS", 0)])
    bs, as_, changes = compare(b, a)
    got = {(c.before_activity_id, c.after_activity_id): c for c in changes.collect()}
    assert {k: c.status for k, c in got.items()} == {("survey", "survey"): "UNCHANGED", ("dig", "dig"): "MODIFIED", (None, "pave"): "ADDED", ("shore", None): "DELETED"}
    dig = got["dig", "dig"]
    assert {k: (v.before, v.after) for k, v in dig.field_changes.items()} == {"wbs_id": ("pit", "trench"), "finish_date": ("2026-01-02", "2027-03-09"), "duration_hours": ("8", "31")}
    assert {k: (v.before, v.after) for k, v in dig.set_changes.items()} == {"successors": (["shore"], ["pave"])}
    edges = {(e.status, e.predecessor_id, e.successor_id) for e in compare_edges(bs.relationships, as_.relationships, changes).collect()}
    assert edges == {("UNCHANGED", "survey", "dig"), ("ADDED", "dig", "pave"), ("DELETED", "dig", None)}
    found = impacts(changes, bs.activities, as_.activities, bs.relationships, as_.relationships)
    told = {(i.source_activity, i.change_status, i.downstream_activity_count, tuple(i.changed_downstream)) for i in found.collect()}
    assert told == {("dig", "MODIFIED", 1, ("pave",)), ("pave", "ADDED", 0, ()), ("shore", "DELETED", 0, ())}
    near = {(e.source_activity, e.status) for e in touching(found, compare_edges(bs.relationships, as_.relationships, changes)).collect()}
    assert near == {("dig", "UNCHANGED"), ("dig", "ADDED"), ("dig", "DELETED"), ("pave", "ADDED")}


def test_stages_and_doubt(compare):
    dates = dict(start="2031-05-02", finish="2031-05-20", hours="64")
    _, _, c = compare(export([task("q7", "Hang curtain wall", **dates)], []), export([task("r7", "Hang the curtain wall", **dates)], []))
    assert [(r.status, r.stage, r.confidence > 0.78) for r in c.collect()] == [("POSSIBLE_RENAME", "fuzzy", True)]
    _, _, c = compare(export([task("q8", "Weld seam")], []), export([task("r8", "Weld seam 1"), task("r9", "Weld seam 2")], []))
    assert sorted((r.status, r.before_activity_id) for r in c.collect()) == [("ADDED", None), ("UNCERTAIN", "q8")]
    # One name twice on the before side: the first by id is matched, the other one is gone.
    _, _, c = compare(export([task("q2", "Grout"), task("q1", " grout ")], []), export([task("r1", "GROUT", finish="2040-01-01")], []))
    assert {(r.before_activity_id, r.after_activity_id, r.stage) for r in c.collect()} == {("q1", "r1", "wbs_name"), ("q2", None, None)}
    # An equal id counts more than anything else.
    _, _, c = compare(export([task("q3", "Paint")], []), export([task("q3", "Demolish"), task("r3", "Paint", wbs="other")], []))
    assert {(r.before_activity_id, r.after_activity_id, r.status) for r in c.collect()} == {("q3", "q3", "MODIFIED"), (None, "r3", "ADDED")}


def test_greedy_is_the_loop(spark):
    r = random.Random(7)
    words = ["pour", "base", "wall", "roof", "test", "pump", "north", "south"]
    config = reconcile.MatchConfig()
    rows_b, rows_a = [], []
    for p in range(240):
        for side, rows in (("b", rows_b), ("a", rows_a)):
            for k in range(r.randint(0, 7)):
                name = " ".join(r.choices(words, k=r.randint(1, 3)))
                rows.append((f"P{p}", k, f"{side}{k}", r.choice(["W1", "W2"]), r.choice(["c1", "c2", None]), name, r.choice(["1", "2"]), r.choice(["3", None]), "8"))
    schema = "pk string, act_seq long, activity_id string, wbs_id string, code string, name string, target_start string, target_finish string, remaining_duration_hours string"
    empty = F.array().cast("array<string>")
    frame = lambda rows: spark.createDataFrame(rows, schema).withColumns({"preds": empty, "succs": empty, "near_names": empty})
    b, a = frame(rows_b), frame(rows_a)
    got = {(x.pk, x.b_seq, x.a_seq, round(x.score, 9), x.uncertain) for x in reconcile.fuzzy_matches(b, a, reconcile.fuzzy_scores(b, a, config), config).collect()}
    want = set()
    weights = ((4, 0.15), (3, 0.15), (6, 0.05), (7, 0.05), (8, 0.05))
    for p in {x[0] for x in rows_b}:
        left = [x for x in rows_a if x[0] == p]
        for x in sorted((x for x in rows_b if x[0] == p), key=lambda x: (x[2], x[5])):
            scored = sorted(((min(1.0, 0.7 * SequenceMatcher(None, x[5], y[5]).ratio() + sum(w for i, w in weights if x[i] and x[i] == y[i])), y) for y in left), key=lambda s: -s[0])
            if scored and scored[0][0] >= config.threshold:
                want.add((p, x[1], scored[0][1][1], round(scored[0][0], 9), len(scored) > 1 and scored[0][0] - scored[1][0] < config.margin))
                left.remove(scored[0][1])
    assert got == want and len(want) > 60


def test_only_what_has_no_match_by_id_is_written(spark, monkeypatch):
    """A comparison of many equal activities writes no more on the way than those that their ids leave over."""
    kind = "project_id string, activity_id string, act_seq long, wbs_id string, code string, name string, status string, target_start string, target_finish string, actual_start string, actual_finish string, remaining_duration_hours string"
    rel = "project_id string, rel_seq long, predecessor_id string, successor_id string, relationship_type string, lag_hours string"
    row = lambda i, seq, name: ("P", i, seq, "W", "C", name, "S", "d", "e", None, None, "8")
    base = [row(f"A{k}", k, f"name {k}") for k in range(200)]
    # A5 is there twice, so its first row falls to the second stage; A7 has a new id, and an edge that follows it there.
    before = [*base, row("A5", 500, "again")]
    after = [row("B7", 7, "name 7") if r[1] == "A7" else r for r in base if r[1] != "A9"]
    edges = [("P", k, f"A{k}", f"A{k + 1}", "PR_FS", "0") for k in range(0, 20, 2)]
    moved = [tuple("B7" if x == "A7" else x for x in e) for e in edges]
    written, plain = [], reconcile.stash
    monkeypatch.setattr(reconcile, "stash", lambda df, name, *a, **k: written.append(plain(df, name, *a, **k)) or written[-1])
    sides = [reconcile.written(spark.createDataFrame(x, t), "given") for x, t in ((before, kind), (after, kind), (edges, rel), (moved, rel))]
    monkeypatch.setattr(reconcile, "written", lambda df, name: df)
    rows = reconcile.compare_activities(*sides, fuzzy=False).collect()
    assert sum(df.count() for df in written[4:]) <= 12
    told = {(r.before_activity_id, r.after_activity_id): (r.stage, r.status, sorted(r.set_changes or ())) for r in rows if r.status != "UNCHANGED" or r.stage != "id"}
    assert told == {
        ("A7", "B7"): ("wbs_name", "UNCHANGED", []), ("A5", None): (None, "DELETED", []), ("A9", None): (None, "DELETED", []), ("A5", "A5"): ("id", "MODIFIED", []),
    }
    assert len(rows) == 201


def test_edge_multiset_is_the_loop(spark):
    r = random.Random(8)
    edge = lambda p: (f"P{p}", r.choice(["A", "B", "C"]), r.choice(["A", "B", None]), r.choice(["FS", "SS", None]), r.choice(["0", "8", ""]))
    sides = [[edge(p) for p in range(60) for _ in range(r.randint(0, 5))] for _ in range(2)]
    schema = "project_id string, rel_seq long, predecessor_id string, successor_id string, relationship_type string, lag_hours string"
    frames = [spark.createDataFrame([(e[0], i, *e[1:]) for i, e in enumerate(own)], schema) for own in sides]
    matches = spark.createDataFrame([(f"P{p}", x, x, "UNCHANGED", 1) for p in range(60) for x in "AB"], "project_id string, before_activity_id string, after_activity_id string, status string, b_seq long")
    got = sorted(((c.project_id, str(c.predecessor_id), str(c.successor_id), c.occurrence, c.status, c.ambiguous, c.before and c.before.rel_seq, c.after and c.after.rel_seq) for c in compare_edges(*frames, matches).collect()), key=str)
    same = {"A": "A", "B": "B"}
    groups = {}
    for side, own in enumerate(sides):
        for i, (p, u, v, t, lag) in enumerate(own):
            key = (p, same.get(u), same.get(v)) if side == 0 else (p, u, v)
            groups.setdefault(key, ([], []))[side].append((t or "", lag or "", i, (t, lag)))
    want = []
    for (p, u, v), (old, new) in groups.items():
        old, new, out = sorted(old), sorted(new), []
        for x in list(old):
            fits = [y for y in new if y[3] == x[3]]
            if len(fits) == 1:
                old.remove(x)
                new.remove(fits[0])
                out.append(("UNCHANGED", False, x[2], fits[0][2]))
        unsure = len(old) > 1 or len(new) > 1
        for k in range(max(len(old), len(new))):
            x, y = (old[k][2] if k < len(old) else None), (new[k][2] if k < len(new) else None)
            out.append(("DELETED" if y is None else "ADDED" if x is None else "UNCERTAIN" if unsure else "MODIFIED", unsure, x, y))
        want += [(p, str(u), str(v), n, s, m, x, y) for n, (s, m, x, y) in enumerate(out)]
    assert got == sorted(want, key=str)


@pytest.mark.parametrize("config", [reconcile.MatchConfig(), reconcile.MatchConfig(0.9, 0.01), reconcile.MatchConfig(0.72, 0.2)])
def test_candidates_hold_every_pair_that_matters(spark, config):
    """All pairs of a project by brute force, with names of many lengths and every kind of signal."""
    r = random.Random(11)
    schema = "pk string, act_seq long, activity_id string, wbs_id string, code string, name string, target_start string, target_finish string, remaining_duration_hours string, preds array<string>, succs array<string>, near_names array<string>"
    some = lambda values: [x for x in values if r.random() < 0.15]
    one = lambda p, k: (f"P{p}", k, f"i{k}", r.choice(["W", "V", "", None]), r.choice(["c", "d", "e", None]), "".join(r.choices("ab ", k=r.choice([0, 3, 9, 9, 10, 14]))).strip() or None,
                        r.choice("12345"), r.choice(["1", "2", None]), r.choice("123"), some("xyz"), some("uvw"), some(["n m", ""]))
    b, a = ([one(p, k) for p in range(12) for k in range(12)] for _ in range(2))
    frame = lambda rows: spark.createDataFrame(rows, schema)
    got = {(x.pk, x.b_seq, x.a_seq): x.score for x in reconcile.fuzzy_scores(frame(b), frame(a), config).collect()}
    want = {}
    for x in b:
        for y in a:
            if x[0] == y[0]:
                context = sum(w for i, w in ((4, 0.15), (3, 0.15), (6, 0.05), (7, 0.05), (8, 0.05)) if x[i] and x[i] == y[i]) + sum(0.1 for i in (9, 10, 11) if set(x[i]) & set(y[i]))
                name = lambda v: " ".join((v or "").split())
                score = min(1.0, 0.7 * SequenceMatcher(None, name(x[5]), name(y[5])).ratio() + context)
                if score >= config.threshold - config.margin + 1e-9 and (context or config.threshold - config.margin < 0.7 - 1e-9):
                    want[x[0], x[1], y[1]] = score
    assert want.items() and set(want) <= set(got) and all(abs(got[k] - v) < 1e-9 for k, v in want.items())


edges_of_graph = st.lists(st.tuples(st.sampled_from("ABCDEF"), st.sampled_from("ABCDEF")), max_size=10)


@settings(max_examples=100, deadline=None)
@given(edges_of_graph)
def test_walks(edges):
    walker = graph.Walker(edges, {"E", "F"})
    near = {}
    for p, s in edges:
        near.setdefault(p, []).append(s)

    def all_paths(path, target):
        if path[-1] == target:
            return [path]
        return [x for s in sorted(near.get(path[-1], [])) if s not in path for x in all_paths([*path, s], target)]

    assert walker.paths("A", "F")[0] == all_paths(["A"], "F")
    reached, todo = set(), ["A"]
    while todo:
        for s in near.get(todo.pop(), []):
            if s not in reached and s != "A":
                reached.add(s)
                todo.append(s)
    found, limited = walker.downstream("A")
    assert set(found) == reached and len(found) == len(reached) and not limited
    looked = sum(len(near.get(x, [])) for x in reached | {"A"})
    assert graph.Walker(edges, set(), max_traversals=max(0, looked - 1)).downstream("A")[1] == (looked > 0)


def test_graph_operators(spark):
    r = random.Random(9)
    rows = [(f"P{p}", str(r.randrange(6)), str(r.randrange(6)), i, True) for i, p in enumerate(p for p in range(12) for _ in range(r.randint(1, 7)))]
    edges = spark.createDataFrame(rows, "pk string, p string, s string, rel_seq long, traversable boolean")
    nodes = spark.createDataFrame([(f"P{p}", str(n), n == 5) for p in range(12) for n in range(6)], "pk string, id string, milestone boolean")
    reach = {(x.pk, x.source, x.node) for x in graph.reachable(edges, nodes).collect()}
    comp = {(x.pk, x.id): x.component for x in graph.components(nodes, edges).collect()}
    cyclic = {x.pk for x in graph.cyclic_projects(edges).collect()}
    assert {x.pk for x in graph.cyclic_projects(edges, edges_per_task=2).collect()} == cyclic
    seen = {(x.pk, x.source): x for x in graph.walks(nodes, edges, nodes).collect()}
    back = {(x.pk, x.source): x for x in graph.walks(nodes, edges, nodes, outgoing=False).collect()}
    limits = {(x.pk, x.source): x for x in graph.walk_limits(edges, graph.reachable(edges, nodes), nodes, 3).collect()}
    found_cycles = [(x.pk, tuple(x.cycle)) for x in graph.cycle_paths(edges).collect()]
    listed = {pk for pk, _ in found_cycles}
    want_cycles = []
    for p in {x[0] for x in rows}:  # the same walk by recursion, for every project
        own, done = [(a, b) for k, a, b, *_ in rows if k == p], set()

        def visit(path):
            for a, b in own:  # by place
                if a == path[-1]:
                    if b in path:
                        want_cycles.append((p, (*path[path.index(b) :], b)))  # noqa: B023
                    elif b not in done:  # noqa: B023
                        visit([*path, b])
            done.add(path[-1])  # noqa: B023

        for root in sorted({x for e in own for x in e}):
            if root not in done:
                visit([root])
    assert sorted(found_cycles) == sorted(want_cycles)
    for p in range(12):
        own = [(a, b) for k, a, b, *_ in rows if k == f"P{p}"]
        walker = graph.Walker(own, set())
        both = graph.Walker(own + [(b, a) for a, b in own], set())
        for n in map(str, range(6)):
            assert {x for k, s, x in reach if (k, s) == (f"P{p}", n)} == set(walker.downstream(n)[0])
            assert comp[f"P{p}", n] == min([n, *both.downstream(n)[0]])
            found, cut, cycles = walker.visit(n)
            assert (seen[f"P{p}", n].activities, seen[f"P{p}", n].truncated, seen[f"P{p}", n].cycles) == (found, cut, cycles)
            assert all(c[-1] in c[:-1] and c[0] == n and all(e in own for e in zip(c, c[1:])) for c in cycles)
            assert set(back[f"P{p}", n].activities) == set(graph.Walker([(b, a) for a, b in own], set()).downstream(n)[0])
            looked = sum(1 for a, _ in own if a == n or a in found)
            assert (limits[f"P{p}", n].looked, limits[f"P{p}", n].truncated) == (looked, looked > 3)
        has = any(a == b or a in walker.downstream(b)[0] for a, b in own)
        assert (f"P{p}" in cyclic) == has == (f"P{p}" in listed)


def test_long_chains_and_stars(spark):
    """A chain of 70 nodes in a circle, one that is open, and a node with many edges."""
    ring = [("ring", f"{i:02}", f"{(i + 1) % 70:02}", i, True) for i in range(70)]
    line = [("line", f"{i:02}", f"{i + 1:02}", i, True) for i in range(70)]
    star = [("star", "hub", f"{i:03}", i, True) for i in range(300)]
    edges = spark.createDataFrame(ring + line + star, "pk string, p string, s string, rel_seq long, traversable boolean")
    nodes = edges.select("pk", F.col("p").alias("id")).union(edges.select("pk", F.col("s").alias("id"))).distinct()
    for most in (1, 1000):
        assert [r.pk for r in graph.cyclic_projects(edges, edges_per_task=most).collect()] == ["ring"]
    assert {(r.pk, r.component) for r in graph.components(nodes, edges).collect()} == {("ring", "00"), ("line", "00"), ("star", "000")}
    assert [len(r.cycle) for r in graph.cycle_paths(edges).collect()] == [71]


def test_deep_breakdown_tree(spark):
    rows = [("P", f"n{i}", f"n{i - 1}" if i else None, i, f"level {i}") for i in range(70)]
    frame = spark.createDataFrame(rows, "project_id string, wbs_id string, parent_wbs_id string, wbs_seq long, name string")
    assert {(t.wbs_id, t.depth) for t in wbs_tree(frame, ["project_id"]).select("wbs_id", "depth").collect()} == {(f"n{i}", i) for i in range(70)}


def test_names_of_breakdown_nodes(spark):
    """Of two nodes with one id, that counts which a walk from the roots comes to last: here the earlier row, under a later root."""
    rows = [("P", "r2", None, 5, "second"), ("P", "x", "r2", 1, "under the second"), ("P", "r1", None, 4, "first"), ("P", "x", "r1", 3, "under the first"), ("P", "o", "p", 6, "loop"), ("P", "p", "o", 7, "loop")]
    frame = spark.createDataFrame(rows, "project_id string, wbs_id string, parent_wbs_id string, wbs_seq long, name string")
    assert {(r.wbs_id, r.wbs_name) for r in wbs_names(frame, ["project_id"]).collect()} == {("r1", "first"), ("r2", "second"), ("x", "under the second")}


def test_milestone_paths_and_limits(compare):
    """Two ways round lead from the changed activity to a milestone."""
    tasks = [task("cast"), task("strip"), task("cure"), task("load"), task("handover", kind="TT_FinMile")]
    edges = [("strip", "cast", "PR_FS", 0), ("cure", "cast", "PR_FS", 0), ("load", "strip", "PR_FS", 0), ("load", "cure", "PR_FS", 0), ("handover", "load", "PR_FS", 0)]
    b, a, changes = compare(export(tasks, edges), export([task("cast", finish="2027-01-01"), *tasks[1:]], edges))
    rels = (b.relationships, a.relationships)
    one = impacts(changes, b.activities, a.activities, *rels).collect()
    assert [(i.source_activity, i.downstream_activity_count, i.downstream_milestones, i.paths, i.traversal_limited, i.path_limited) for i in one] == [
        ("cast", 4, ["handover"], [["cast", "cure", "load", "handover"], ["cast", "strip", "load", "handover"]], False, False)
    ]
    assert impacts(changes, b.activities, a.activities, *rels, max_traversals=0).first().traversal_limited
    assert impacts(changes, b.activities, a.activities, *rels, max_paths=1).first().path_limited


def test_warnings_and_report(spark, compare):
    tasks, edges = [task("u"), task("v")], [("v", "u", "PR_FS", 0), ("u", "v", "PR_FS", 0), ("lost", "u", "PR_FS", 0)]
    b, a, changes = compare(export(tasks, edges), export(tasks, edges, name=""))
    rels = (b.relationships, a.relationships)
    warned = report.warnings(b.projects, a.projects, changes, b.activities, a.activities, *rels)
    rows = warned.orderBy("warn_seq").collect()
    assert [w.code for w in rows] == ["MISSING_PROJECT_METADATA", "UNRESOLVED_RELATIONSHIP", "UNRESOLVED_RELATIONSHIP", "CYCLE_DETECTED", "CYCLE_DETECTED"]
    assert [len(w.evidence_ids) for w in rows] == [0, 1, 2, 0, 0]
    aligned = report.align_projects(b.projects, a.projects)
    told = report.project_reports(aligned, changes, compare_edges(*rels, changes), impacts(changes, b.activities, a.activities, *rels), warned).collect()
    body = json.loads(told[0].report)
    assert body["schema_version"] == "1.1" and body["status"] == "MATCHED" and len(body["activity_changes"]) == 2 and len(body["warnings"]) == 5


#: The contract of a report, part by part: fixed values.
CONTRACT = {
    "report": {"schema_version", "comparison", "projects", "warnings", "evidence"},
    "source": {"source_id", "source_name", "encoding", "project_count"},
    "project": {"project_id", "status", "activity_changes", "activity_metadata", "relationship_changes", "impacts", "uncertainty", "unresolved_relationships", "evidence_refs", "warnings"},
    "change": {"before_activity_id", "after_activity_id", "status", "confidence", "changes", "evidence_refs"},
    "metadata": {"side", "activity_id", "name", "wbs_id", "wbs_name", "is_milestone", "milestone_type", "status", "change_status", "counterpart_activity_id", "confidence", "evidence_refs"},
    "edge": {"status", "identity_before", "identity_after", "ambiguous", "evidence_refs"},
    "identity": {"predecessor_id", "successor_id", "relationship_type", "lag_hours", "occurrence"},
    "impact": {"source_activity", "change_status", "confidence", "downstream_activity_count", "changed_downstream_activities", "downstream_milestones", "relationship_changes", "paths", "evidence_refs", "uncertain"},
    "path": {"activity_ids", "node_metadata_refs", "node_evidence_refs", "edge_evidence_refs"},
    "lost": {"predecessor_id", "successor_id", "relationship_type", "lag_hours", "reason", "evidence_refs"},
    "warning": {"code", "severity", "message", "project_id", "activity_ids", "evidence_refs"},
    "evidence": {"side", "table", "line_number", "fields", "values", "raw_line"},
}


def _references(value):
    if isinstance(value, dict):
        if set(value) == {"evidence_id"}:
            yield value["evidence_id"]
        for x in value.values():
            yield from _references(x)
    elif isinstance(value, list):
        for x in value:
            yield from _references(x)


@pytest.fixture(scope="module")
def bridge():
    """Two versions of a small bridge: a slip that reaches the opening, a pier that is renamed in doubt, edges that double and get lost."""
    wbs = "%T\tPROJWBS\n%F\twbs_id\tproj_id\tparent_wbs_id\twbs_name\n%R\tW\tP1\t\tBridge\n%R\tdeck\tP1\tW\tDeck\n"
    before = [task("pile"), task("pier", "Cast pier"), task("deck", wbs="deck"), task("open", 'Opening "day" é', kind="TT_FinMile")]
    after = [task("pile", finish="2029-09-09"), task("pierA", "Cast pier 1"), task("pierB", "Cast pier 2"), task("deck", wbs="deck"), task("open", 'Opening "day" é', kind="TT_FinMile")]
    ways = [("deck", "pile", "PR_FS", 0), ("deck", "pile", "PR_SS", 8), ("open", "deck", "PR_FS", 0), ("gone", "deck", "PR_FS", 0)]
    more = "%T\tPROJECT\n%F\tproj_id\tproj_name\n%R\tP1\tProject one\n%R\tP0\tOther\n"
    return export(before, ways, more=wbs), export(after, [*ways, ("deck", "pierA", "PR_FS", 0)], more=wbs + more)


def test_whole_report(spark, bridge):
    got = comparing.compare_bytes(spark, *bridge, "v1.xer", "v2.xer")
    assert set(got) == CONTRACT["report"] and got["schema_version"] == "1.1" and got["warnings"] == []
    assert set(got["comparison"]["before"]) == CONTRACT["source"]
    assert got["comparison"]["after"] == {"source_id": hashlib.sha256(bridge[1]).hexdigest(), "source_name": "v2.xer", "encoding": None, "project_count": 2}
    added, one = got["projects"]
    assert (added["project_id"], added["status"], [w["code"] for w in added["warnings"]], len(added["evidence_refs"])) == ("P0", "ADDED", ["PROJECT_ADDED"], 1)
    assert added["activity_changes"] == [] and added["uncertainty"] is None and added["activity_metadata"] == {}
    parts = {"project": [added, one], "change": one["activity_changes"], "metadata": one["activity_metadata"].values(), "edge": one["relationship_changes"], "impact": one["impacts"], "lost": one["unresolved_relationships"],
             "warning": one["warnings"], "path": [p for i in one["impacts"] for p in i["paths"]], "evidence": got["evidence"].values(), "identity": [e["identity_after"] for e in one["relationship_changes"] if e["identity_after"]]}
    for name, rows in parts.items():
        assert rows and all(set(r) == CONTRACT[name] for r in rows), name
    assert [(c["before_activity_id"], c["after_activity_id"], c["status"], c["changes"]) for c in one["activity_changes"]] == [
        ("deck", "deck", "MODIFIED", {"predecessors": {"before": ["pile"], "after": ["pierA", "pile"]}}), ("open", "open", "UNCHANGED", {}),
        ("pile", "pile", "MODIFIED", {"finish_date": {"before": "2026-01-02", "after": "2029-09-09"}}), ("pier", "pierA", "UNCERTAIN", one["activity_changes"][3]["changes"]), (None, "pierB", "ADDED", {}),
    ]
    assert set(one["activity_changes"][3]["changes"]) == {"name", "successors"}
    assert [(m["before_activity_id"], m["after_activity_id"]) for m in one["uncertainty"]["matches"]] == [("pier", "pierA")] and one["uncertainty"]["excluded_from_impact"] is True
    # An uncertain match keeps added activities out of the impacts.
    assert [(i["source_activity"], i["downstream_activity_count"], i["changed_downstream_activities"], [m["activity_id"] for m in i["downstream_milestones"]]) for i in one["impacts"]] == [
        ("deck", 1, [], ["open"]), ("pile", 2, ["deck"], ["open"])
    ]
    path = one["impacts"][1]["paths"][0]
    assert path["activity_ids"] == ["pile", "deck", "open"] and path["node_metadata_refs"] == {n: f"after:{n}" for n in path["activity_ids"]}
    assert len(path["edge_evidence_refs"]) == 3 and set(path["node_evidence_refs"]) == set(path["activity_ids"]) and len(one["impacts"][1]["paths"]) == 2
    assert one["impacts"][0]["relationship_changes"] == one["relationship_changes"]
    meta = one["activity_metadata"]
    assert [k for k in meta] == sorted(k for k in meta if k.startswith("before")) + sorted(k for k in meta if k.startswith("after"))
    assert (meta["after:deck"]["wbs_name"], meta["before:open"]["name"], meta["before:open"]["is_milestone"], meta["before:pier"]["counterpart_activity_id"]) == ("Deck", 'Opening "day" é', True, "pierA")
    assert [w["code"] for w in one["warnings"]] == ["UNCERTAIN_MATCHES", "UNRESOLVED_RELATIONSHIP", "UNRESOLVED_RELATIONSHIP"] and one["warnings"][0]["project_id"] is None
    used = set(_references(got["projects"]))
    assert used and used <= set(got["evidence"])
    # Of either side: the activities, edges and the project; and the project that was added.
    assert len(got["evidence"]) == (4 + 4 + 1) + (5 + 5 + 1) + 1
    again = comparing.compare_bytes(spark, *bridge, "v1.xer", "v2.xer")
    assert json.dumps(again) == json.dumps(got)


def test_comparison_of_files_and_command(spark, bridge, tmp_path, capsys):
    paths = [tmp_path / "a.xer", tmp_path / "b.xer"]
    for p, data in zip(paths, bridge, strict=True):
        p.write_bytes(data)
    got = comparing.compare_files(spark, *paths)
    assert got["projects"] == comparing.compare_bytes(spark, *bridge)["projects"] and got["comparison"]["before"]["source_name"] == "a.xer"
    assert command.main(["compare", str(paths[0]), str(paths[1]), "-o", str(tmp_path / "out.json")]) == 0
    assert json.loads((tmp_path / "out.json").read_text()) == got and "é" in (tmp_path / "out.json").read_text()
    assert command.main(["parse", str(paths[1])]) == 0
    parsed = json.loads(capsys.readouterr().out)
    assert [p["metadata"]["project_id"] for p in parsed["projects"]] == ["P1", "P0"]
    first = parsed["projects"][0]
    assert first["wbs"][0]["children"][0]["name"] == "Deck" and len(first["activities"]) == 5
    assert [r["successor"] and r["successor"]["activity_id"] for r in first["relationships"]] == ["deck", "deck", "open", None, "deck"]


def test_limits_reach_the_report(spark, bridge):
    codes = lambda **limits: [w["code"] for w in comparing.compare_bytes(spark, *bridge, **limits)["projects"][1]["warnings"]]
    assert "TRAVERSAL_LIMIT_REACHED" in codes(max_traversals=0) and codes(max_paths=1)[-1] == "PATH_LIMIT_REACHED"


def test_input_that_is_no_export(spark, tmp_path):
    good = export([task("A")], [])
    for bad in (b"", b"hello", b"%T\tTASK\n%F\ttask_id\n%R\tA\n"):
        with pytest.raises(xer.InvalidExport):
            comparing.compare_bytes(spark, good, bad)
    (tmp_path / "large.xer").write_bytes(good)
    with pytest.raises(xer.InvalidExport, match="larger"):
        xer.read_exports(spark, str(tmp_path), max_bytes=10)
    files = spark.createDataFrame([("a.XER", 5), ("b.txt", 5), ("c.xer", 26 << 20), ("d.xer", 0)], "path string, length long")
    assert [r.refused for r in xer.uploadable(files).orderBy("path").collect()] == [None, "not an .xer file", "too large", "empty"]
    assert xer.parse(spark, good).table("TASK").count() == xer.parse(spark, good.decode()).table("TASK").count() == xer.parse(spark, tmp_path / "large.xer").table("TASK").count() == 1


def test_one_project_at_a_time(spark):
    side = lambda *ids: normalize(xer.parse(spark, b"".join(export([task(f"A{i}")], [], project=i) for i in ids)))
    assert comparing.reconcile(side("P1"), side("P1")).count() == 1
    with pytest.raises(ValueError, match="two versions"):
        comparing.reconcile(side("P1"), side("P2"))
    two = normalize(xer.parse(spark, "%T\tPROJECT\n%F\tproj_id\n%R\tP1\n%R\tP2\n%T\tTASK\n%F\ttask_id\tproj_id\n%R\tA\tP1\n%R\tB\tP2\n"))
    with pytest.raises(ValueError, match="one project"):
        comparing.reconcile(two, side("P1"))
    matches, unsure, alone = comparing.reconcile_exports(two, side("P1"))
    assert {(m.before_activity_id, m.after_activity_id) for m in matches.collect()} == {("A", None), (None, "AP1")}
    assert unsure.isEmpty() and [tuple(r) for r in alone.collect()] == [("P2", "DELETED")]


def test_lookups_of_a_viewer(spark, bridge):
    b, a = (normalize(xer.parse(spark, x)) for x in bridge)
    changes = reconcile.compare_activities(b.activities, a.activities, b.relationships, a.relationships)
    first = {c.project_id: (c.before_activity_id, c.status) for c in report.first_change(changes).collect()}
    assert first == {"P1": ("deck", "MODIFIED")}
    labels = {(c.before_activity_id, c.after_activity_id): c.label for c in report.change_labels(changes).collect()}
    assert labels["pier", "pierA"] == "Cast pier" and labels[None, "pierB"] == "Cast pier 2"
    bare = {(c.before_activity_id, c.after_activity_id): c.label for c in report.change_labels(changes.drop("before_src", "after_src")).collect()}
    assert bare["pier", "pierA"] == "Cast pier 1" and bare["pile", "pile"] == "pile"
    edges = compare_edges(b.relationships, a.relationships, changes)
    last = {(e.predecessor_id, e.successor_id): (e.status, e.occurrence) for e in report.edge_lookup(edges).collect()}
    assert last["pile", "deck"] == ("UNCHANGED", 1) and last["pierA", "deck"] == ("ADDED", 0)
    assert {(r.status, r.n) for r in report.counts_by(edges, "status").collect()} == {("UNCHANGED", 3), ("ADDED", 2), ("DELETED", 1)}
    texts = spark.createDataFrame([("1.1", '{"projects":[],"evidence":{}}'), ("1.0", '{"projects":[{"a":1}],"evidence":{"x":{}}}'), ("0.9", '{"projects":[],"evidence":{}}'), ("1.1", '{"projects":[]}'), ("1.1", "x")], "schema_version string, report string")
    assert report.readable(texts).count() == 2


def test_evidence(spark):
    raw = export([task("A", 'Quote " tab é \U0001f600')], [])
    rows = xer.parse_bytes(spark, {"s": raw}).table("TASK").select(F.struct("table", "fields", "values", "line_number", "raw_line").alias("src"))
    ids = set()
    for side in evidence.SIDES:
        got = evidence.register(rows.unionByName(rows), side).collect()
        assert len(got) == 1
        s = rows.first().src
        body = json.dumps({"fields": s.fields, "line_number": s.line_number, "raw_line": s.raw_line, "side": side, "table": s.table, "values": s["values"]}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        assert got[0].evidence_id == "ev_" + hashlib.sha256(body.encode()).hexdigest()[:12]
        ids.add(got[0].evidence_id)
    assert len(ids) == 2
    with pytest.raises(ValueError):
        evidence.register(rows, "left")
    with pytest.raises(KeyError):
        evidence.resolve(evidence.register(rows, "before"), "ev_none")


def test_components_in_tasks_are_those_by_joins(spark):
    r = random.Random(12)
    rows = [(f"P{p}", *(f"n{r.randrange(12)}" for _ in "ps"), True) for p in range(30) for _ in range(r.randint(0, 10))]
    edges = spark.createDataFrame(rows, "pk string, p string, s string, traversable boolean")
    nodes = spark.createDataFrame([(f"P{p}", f"n{i}") for p in range(30) for i in range(12)], "pk string, id string")
    want = {}
    for p in range(30):
        own = {f"n{i}": f"n{i}" for i in range(12)}
        for _ in own:
            for pk, x, y, _ in rows:
                if pk == f"P{p}":
                    own[x] = own[y] = min(own[x], own[y])
        want |= {(f"P{p}", i): c for i, c in own.items()}
    for most in (5, graph.EDGES_PER_TASK):
        assert {(c.pk, c.id): c.component for c in graph.components(nodes, edges, most).collect()} == want


def test_shares_give_what_the_whole_gives(spark, monkeypatch, tmp_path):
    """Projects dealt to shares are compared as all at once, and what a share writes on its way goes with it."""
    from planweave import storage
    from planweave.plans import schedule
    from planweave.plans.queries import QUERIES

    names, d, got = ("activity_changes", "status_counts"), "/root/testdata/sf0.001", []
    for lines in (1_000_000, 4_000):
        monkeypatch.setattr(storage, "shared_dir", lambda spark, at=lines: f"file://{tmp_path}/{at}")
        monkeypatch.setattr(schedule, "LINES_A_SHARE", lines)
        schedule.forget()
        got.append([sorted((tuple(r) for r in QUERIES[n](spark, d).collect()), key=str) for n in names])
    assert schedule.shares(spark, d) > 1 and got[0] == got[1]
    left = {p.name.rpartition("-")[0] for p in (tmp_path / "4000").iterdir()}
    assert left == {"planweave-lines", "planweave-activity_changes", "planweave-status_counts"}
    schedule.forget()


def test_lines_are_dealt_out_a_few_shares_at_a_time(spark, monkeypatch, tmp_path):
    """The more shares, the more turns, so that a turn shuffles lines of about three shares' worth, not a third of all."""
    import duckdb

    from planweave.plans import schedule

    db = duckdb.connect()
    for name, sql in (
        ("lineitem", "SELECT i // 3 AS l_orderkey, i % 3 AS l_linenumber, i % 5 AS l_partkey, 1::BIGINT AS l_suppkey, 2.0 AS l_extendedprice, 3.0 AS l_quantity, 'O' AS l_linestatus, TIMESTAMP '2026-01-01' AS l_shipdate FROM range(90) r(i)"),
        ("orders", "SELECT i AS o_orderkey, i % 7 AS o_custkey, TIMESTAMP '2026-01-01' AS o_orderdate FROM range(30) r(i)"),
        ("part", "SELECT i AS p_partkey, 'part ' || i AS p_name FROM range(5) r(i)"),
    ):
        db.execute(f"COPY ({sql}) TO '{tmp_path}/{name}.parquet'")
    turns, put = [], schedule.put
    monkeypatch.setattr(schedule, "put", lambda df, path, *more: (turns.append(path), put(df, path, *more)))
    monkeypatch.setattr(schedule, "LINES_A_SHARE", 6)
    schedule.forget()
    lines = schedule._lines(spark, str(tmp_path))
    assert schedule.shares(spark, str(tmp_path)) == 16 and len(turns) == 6
    assert sorted((r.k, r.m, r.p_name) for r in lines.collect()) == [(i // 3 * 100 + i % 3 + 1, 3, f"part {i % 5}") for i in range(90)]
    schedule.forget()


def test_large_tables_are_compared_where_they_lie(spark, monkeypatch, tmp_path):
    """Lines are dealt out by project once: no step of a comparison shuffles by project again, and lines without a project are compared too."""
    import duckdb

    from planweave import storage
    from planweave.plans import schedule
    from planweave.plans.queries import QUERIES

    db = duckdb.connect()
    for name, sql in (
        ("lineitem", "SELECT i // 3 AS l_orderkey, i % 3 AS l_linenumber, i % 5 AS l_partkey, 1::BIGINT AS l_suppkey, 2.0 AS l_extendedprice, 3.0 AS l_quantity, 'O' AS l_linestatus, TIMESTAMP '2026-01-01' AS l_shipdate FROM range(900) r(i)"),
        ("orders", "SELECT i AS o_orderkey, nullif(i % 7, 3) AS o_custkey, TIMESTAMP '2026-01-01' AS o_orderdate FROM range(300) r(i)"),
        ("part", "SELECT i AS p_partkey, 'part ' || i AS p_name FROM range(5) r(i)"),
        ("customer", "SELECT i AS c_custkey, 'customer ' || i AS c_name FROM range(7) r(i) WHERE i <> 3"),
    ):
        db.execute(f"COPY ({sql}) TO '{tmp_path}/{name}.parquet'")
    got, moved, put = [], {}, storage.put

    def seen(df, path, *a, **k):
        df.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        plan = df._jdf.queryExecution().executedPlan().toString()
        df.sparkSession.conf.unset("spark.sql.requireAllClusterKeysForCoPartition")
        if k.get("buckets"):
            moved[path.split("-")[1]] = plan.count("Exchange hashpartitioning")
        put(df, path, *a, **k)

    monkeypatch.setattr(storage, "put", seen)
    for lines in (1_000_000, 400):
        monkeypatch.setattr(schedule, "LINES_A_SHARE", lines)
        schedule.forget()
        got.append(sorted((tuple(r) for r in QUERIES["activity_changes"](spark, str(tmp_path)).collect()), key=str))
    assert got[0] == got[1] and any(r[0] is None for r in got[0])
    assert moved == {"left": 0, "later": 0, "pairs": 0, "ids": 0, "changes": 0}
    schedule.forget()


def test_impacts_of_large_tables_are_written_for_several_readers_only(spark, monkeypatch):
    from planweave import storage
    from planweave.plans import schedule
    from planweave.plans.queries import QUERIES

    names, put = [], storage.put
    monkeypatch.setattr(storage, "put", lambda df, path, *a, **k: (names.append(path.split("planweave-")[1].split("-")[0]), put(df, path, *a, **k)))
    monkeypatch.setattr(schedule, "LINES_A_SHARE", 4_000)
    schedule.forget()
    assert QUERIES["impact_summary"](spark, "/root/testdata/sf0.001").count() > 1000
    assert "changes" in names and "impacts" not in names
    schedule.forget()


def test_edge_changes_of_sources_need_no_walk(spark, monkeypatch):
    """Projects of large tables are compared once, no graph is walked for the ends of edges, and the rows are those of small tables."""
    from planweave import storage
    from planweave.plans import schedule
    from planweave.plans.queries import QUERIES

    d, got, names, put = "/root/testdata/sf0.001", [], [], storage.put
    monkeypatch.setattr(storage, "put", lambda df, path, *a, **k: (names.append(path.split("planweave-")[1].split("-")[0]), put(df, path, *a, **k)))
    for lines in (1_000_000, 4_000):
        monkeypatch.setattr(schedule, "LINES_A_SHARE", lines)
        schedule.forget()
        names.clear()
        got.append(sorted((tuple(r) for r in QUERIES["impact_edge_changes"](spark, d).collect()), key=str))
        assert names.count("changes") == 1 and "impacts" not in names
    assert got[0] == got[1] and len(got[0]) > 1000 and "edge" not in names
    schedule.forget()


def test_paths_come_with_their_records(spark, bridge, compare):
    """What a walk says of the records along its paths is what joins find; edges that lead to no activity count for neither."""
    b, a, changes = compare(*bridge)
    rels = (b.relationships, a.relationships)
    paths = impact.paths_with_records(impacts(changes, b.activities, a.activities, *rels, records=True, include_uncertain=True)).collect()
    loose = impact.paths_with_records(impacts(changes, b.activities, a.activities, *[r.drop("resolved") for r in rels], records=True, include_uncertain=True))
    assert sorted(loose.collect()) == sorted(paths)
    ids = {side: {r.activity_id: r.e for r in s.activities.select("activity_id", evidence.ref(side, F.col("src")).alias("e")).collect()} for side, s in (("before", b), ("after", a))}
    ways = {side: [tuple(r) for r in s.relationships.orderBy("rel_seq").select("predecessor_id", "successor_id", evidence.ref(side, F.col("src"))).collect()] for side, s in (("before", b), ("after", a))}
    assert {tuple(p.path) for p in paths} >= {("pile", "deck", "open")} and max(len(p.edges) for p in paths) == 3
    for p in paths:
        assert p.nodes == [ids[p.side][x] for x in p.path]
        assert p.edges == [e for hop in zip(p.path, p.path[1:]) for u, v, e in ways[p.side] if (u, v) == hop]


def test_path_evidence_of_large_tables_is_found_in_the_walk(spark, monkeypatch):
    from planweave import storage
    from planweave.plans import schedule
    from planweave.plans.queries import QUERIES

    got, names, put = [], [], storage.put
    monkeypatch.setattr(storage, "put", lambda df, path, *a, **k: (names.append(path.split("planweave-")[1].split("-")[0]), put(df, path, *a, **k)))
    for lines in (1_000_000, 4_000):
        monkeypatch.setattr(schedule, "LINES_A_SHARE", lines)
        schedule.forget()
        names.clear()
        got.append(sorted((tuple(r) for r in QUERIES["path_evidence"](spark, "/root/testdata/sf0.001").collect()), key=str))
        assert "impacts" not in names and "relationships" not in names
    assert got[0] == got[1] and len(got[0]) > 500
    schedule.forget()


def test_reports_of_the_query_are_whole(spark):
    """report_json has all parts of a report: metadata, records of projects and paths, and of every impact all edge changes of its project."""
    from planweave.plans import schedule
    from planweave.plans.queries import QUERIES

    schedule.forget()
    whole = [p for p in (json.loads(r.report) for r in QUERIES["report_json"](spark, "/root/testdata/sf0.001").collect()) if p["status"] == "MATCHED" and p["activity_changes"]]
    impacts_ = [(p, i) for p in whole for i in p["impacts"]]
    paths = [(p, x) for p, i in impacts_ for x in i["paths"]]
    assert len(impacts_) > 1000 and len(paths) > 500
    assert all(len(p["evidence_refs"]) == 2 for p in whole)
    for p in whole:
        named = {f"{side}:{c[f'{side}_activity_id']}" for c in p["activity_changes"] for side in ("before", "after") if c[f"{side}_activity_id"]}
        assert named == set(p["activity_metadata"]) and all(set(m) == CONTRACT["metadata"] and m["evidence_refs"] for m in p["activity_metadata"].values())
    assert all(i["relationship_changes"] == p["relationship_changes"] for p, i in impacts_)
    for p, x in paths:
        ids = x["activity_ids"]
        assert set(x) == CONTRACT["path"] and set(x["node_metadata_refs"].values()) <= set(p["activity_metadata"]) and len(x["edge_evidence_refs"]) >= len(ids) - 1
        assert set(x["node_metadata_refs"]) == set(ids) and all(x["node_evidence_refs"][k] in p["activity_metadata"][ref]["evidence_refs"] for k, ref in x["node_metadata_refs"].items())
    schedule.forget()


def test_pairs_keep_only_what_differs(spark):
    """What is dealt out and sorted once activities are paired holds no whole rows."""
    row = {c: "x" for c in reconcile.COMPARED.values()} | {"activity_id": "1", "act_seq": 1}
    kind = "struct<" + ",".join(f"{c}:{'long' if c == 'act_seq' else 'string'}" for c in row) + ">"
    pairs = spark.createDataFrame([("P", "id", 1.0, False, row, row | {"name": "y", "act_seq": 2})], f"pk string, stage string, confidence double, uncertain boolean, b {kind}, a {kind}")
    got = reconcile._told_apart(pairs, raw=False)
    assert not [f.name for f in got.schema if f.dataType.typeName() == "struct"]
    r = got.first()
    assert (r.before_activity_id, r.b_seq, r.a_seq, r.renamed, dict(r.field_changes)) == ("1", 1, 2, True, {"name": ("x", "y")})


def test_synthetic_export(spark):
    n = normalize(xer.parse_text(xer.synthetic_export(spark, 50)))
    assert n.activities.count() == 50 and n.relationships.where("resolved").count() == 49 + 48 + 47


def test_registry():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "activity_changes" in entry.queries()
