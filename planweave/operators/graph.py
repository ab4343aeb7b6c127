"""The dependency graph of each project: neighbours, reachability, paths, components, cycles.

Edges count where both ends are activities of the same project. Reachability,
components and cycle detection are loops of joins over all projects at once;
each round is written to the shared folder and read again, so that neither
lineage nor size estimates grow with the rounds. Bounded walks, whose result
depends on the order in which edges are visited, run on one project's edges in
a task; where every source is walked, a project's sources are split.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planweave.functions.text import is_milestone, relationship_type
from planweave.operators.normalize import key_of, last_wins
from planweave.storage import discard, stash

MAX_PATHS = 10_000
MAX_TRAVERSALS = 100_000
#: Sources that one task walks from in one project's graph.
SOURCES_PER_TASK = 1000
#: Edges of a project up to which one task looks for cycles.
EDGES_PER_TASK = 1_000_000


def by_key(df: DataFrame, keys: list[str], order: list[str | Column], walk: Callable[[tuple, list[dict]], Iterator[dict]], schema: str) -> DataFrame:
    """walk(key, rows) over the rows of each key, in order.

    Rows arrive sorted and in batches, so that a task with many small keys pays
    for its rows only, not for its keys.
    """
    spark = df.sparkSession
    arrow = spark.createDataFrame([], schema)
    names = arrow.columns
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = to_arrow_schema(arrow.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        now: tuple | None = None
        out: list[dict] = []

        def close() -> None:
            if now is not None:
                out.extend(walk(now, held))

        def pack() -> pa.RecordBatch:
            rows = [[r[n] for r in out] for n in names]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(rows, kind, strict=True)], schema=kind)

        for batch in batches:
            given = batch.schema.names
            columns = [c.to_numpy(zero_copy_only=False).tolist() if pa.types.is_string(c.type) else c.to_pylist() for c in batch.columns]
            for key, values in zip(zip(*(columns[given.index(k)] for k in keys), strict=True), zip(*columns, strict=True), strict=True):
                row = dict(zip(given, values, strict=True))
                if key != now:
                    close()
                    now, held = key, []
                    if len(out) >= 4096:
                        yield pack()
                held.append(row)
        close()
        while out:
            rest = out[4096:]
            del out[4096:]
            yield pack()
            out.extend(rest)

    # A window has rows dealt out by their keys only where they aren't yet, and sorted.
    placed = df.withColumn("__at", F.row_number().over(Window.partitionBy(*keys).orderBy(*(order or keys))))
    return placed.mapInArrow(run, schema)


def nodes_of(activities: DataFrame) -> DataFrame:
    """(pk, id, milestone): activities with an id; of equal ids the last counts."""
    known = last_wins(activities.where("activity_id <> ''"), ["project_id", "activity_id"], "act_seq")
    return known.select(key_of("project_id").alias("pk"), F.col("activity_id").alias("id"), is_milestone(F.col("task_type")).alias("milestone"))


def edges_of(relationships: DataFrame, nodes: DataFrame) -> DataFrame:
    """(pk, p, s, type, lag, rel_seq, traversable) of edges with both ends named; parallel edges stay."""
    named = relationships.where("predecessor_id <> '' and successor_id <> ''").select(
        key_of("project_id").alias("pk"), F.col("predecessor_id").alias("p"), F.col("successor_id").alias("s"),
        relationship_type(F.col("relationship_type")).alias("type"), F.col("lag_hours").alias("lag"), "rel_seq", "resolved",
    )
    for end in ("p", "s"):
        known = nodes.select("pk", F.col("id").alias(end), F.lit(True).alias(f"has_{end}"))
        named = named.join(known, ["pk", end], "left")
    met = F.col("resolved") & F.coalesce("has_p", F.lit(False)) & F.coalesce("has_s", F.lit(False))
    return named.withColumn("traversable", met).drop("has_p", "has_s", "resolved")


def immediate(edges: DataFrame, outgoing: bool = True) -> DataFrame:
    """(pk, id, near): sorted neighbours, parallel edges repeated."""
    here, there = ("p", "s") if outgoing else ("s", "p")
    return edges.where("traversable").groupBy("pk", F.col(here).alias("id")).agg(F.array_sort(F.collect_list(there)).alias("near"))


def edges_between(edges: DataFrame, p: str | Column, s: str | Column) -> DataFrame:
    """All parallel edges from p to s that can be walked."""
    return edges.where((F.col("p") == p) & (F.col("s") == s) & F.col("traversable"))


def reachable(edges: DataFrame, sources: DataFrame, outgoing: bool = True) -> DataFrame:
    """(pk, source, node): every node that a source (pk, id) reaches, itself left out.

    Each round walks one edge from what the last round found new, until nothing
    new is found; rounds are as many as the longest shortest way.
    """
    here, there = ("p", "s") if outgoing else ("s", "p")
    step = stash(edges.where("traversable").select("pk", F.col(here).alias("node"), F.col(there).alias("next")).distinct(), "steps")
    new = sources.select("pk", F.col("id").alias("source"), F.col("id").alias("node")).distinct()
    found: list[DataFrame] = []
    while True:
        more = new.join(step, ["pk", "node"]).select("pk", "source", F.col("next").alias("node")).where("source <> node").distinct()
        for k in found:
            more = more.join(k, ["pk", "source", "node"], "left_anti")
        new = stash(more, "reached")
        if new.isEmpty():
            break
        found.append(new)
        if len(found) == 8:  # few files to hold the next rounds against
            whole = found[0]
            for k in found[1:]:
                whole = whole.unionByName(k)
            whole = stash(whole, "reached")
            for k in found[:-1]:
                discard(k)
            found = [whole]
    out = new
    for k in found:
        out = out.unionByName(k)
    return out


def walk_limits(edges: DataFrame, reached: DataFrame, sources: DataFrame, max_traversals: int = MAX_TRAVERSALS) -> DataFrame:
    """(pk, source, looked, truncated): the edges that a walk from each source (pk, id) looks at, and whether they are too many.

    A walk looks once at every edge that leaves the source or what it reaches.
    reached is the result of reachable() for these sources.
    """
    here = F.col("p").alias("node")
    degree = edges.where("traversable").groupBy("pk", here).agg(F.count(F.lit(1)).alias("deg"))
    own = sources.select("pk", F.col("id").alias("source"), F.col("id").alias("node")).distinct()
    looked = F.coalesce(F.sum("deg"), F.lit(0)).alias("looked")
    out = own.unionByName(reached).join(degree, ["pk", "node"], "left").groupBy("pk", "source").agg(looked)
    return out.withColumn("truncated", F.col("looked") > max_traversals)


def walks(nodes: DataFrame, edges: DataFrame, sources: DataFrame, outgoing: bool = True, max_traversals: int = MAX_TRAVERSALS) -> DataFrame:
    """(pk, source, activities, truncated, cycles): what each source (pk, id) leads to, in the order of a depth-first walk.

    truncated: more edges were to be looked at than max_traversals. cycles: the
    ways from the source that end at a node of the same way. A project's sources
    are split among tasks, each of which gets the project's edges.
    """
    sources = sources.select("pk", "id").distinct().join(nodes.select("pk", "id"), ["pk", "id"], "left_semi")
    start, finish = ("p", "s") if outgoing else ("s", "p")
    rows = _split(sources.select("pk", F.lit("source").alias("kind"), F.col("id").alias("a"), F.lit(None).cast("string").alias("b")), [
        edges.where("traversable").select("pk", F.lit("edge").alias("kind"), F.col(start).alias("a"), F.col(finish).alias("b"))
    ], ["pk"])

    def walk(key: tuple, own: list[dict]) -> Iterator[dict]:
        walker = Walker([(r["a"], r["b"]) for r in own if r["kind"] == "edge"], set(), max_traversals=max_traversals)
        for r in own:
            if r["kind"] == "source":
                found, cut, cycles = walker.visit(r["a"])
                yield {"pk": key[0], "source": r["a"], "activities": found, "truncated": cut, "cycles": cycles}

    return by_key(rows, ["pk", "share"], ["kind", "a"], walk, "pk string, source string, activities array<string>, truncated boolean, cycles array<array<string>>")


def _split(sources: DataFrame, others: list[DataFrame], keys: list[str]) -> DataFrame:
    """Rows of others for every share of the sources of their key, and the sources of each share; a share has about SOURCES_PER_TASK sources."""
    shares = sources.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / SOURCES_PER_TASK).cast("int").alias("shares"))
    out = sources.join(shares, keys).withColumn("share", F.pmod(F.hash("a"), F.col("shares"))).drop("shares")
    for df in others:
        met = df.join(shares, keys).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")
        out = out.unionByName(met, allowMissingColumns=True)
    return out


def components(nodes: DataFrame, edges: DataFrame, edges_per_task: int = EDGES_PER_TASK) -> DataFrame:
    """(pk, id, component): weak components by their smallest id; a node without edges is its own.

    Projects of up to edges_per_task edges are settled one by one in tasks, larger
    ones by joins over all their edges.
    """
    ends = edges.where("traversable").select("pk", F.least("p", "s").alias("a"), F.greatest("p", "s").alias("b"))
    links = stash(ends.where("a < b").distinct(), "components")
    large = links.groupBy("pk").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > edges_per_task).select("pk")
    some = not large.isEmpty()

    def settle(key: tuple, rows: list[dict]) -> Iterator[dict]:
        above: dict[str, str] = {}

        def least(x: str) -> str:
            top = x
            while (up := above.get(top, top)) != top:
                top = up
            while x != top:
                x, above[x] = above.get(x, x), top
            return top

        for r in rows:
            a, b = least(r["a"]), least(r["b"])
            if a != b:
                above[max(a, b)] = min(a, b)
        for x in list(above):
            yield {"pk": key[0], "id": x, "component": least(x)}

    known = by_key(links.join(large, "pk", "left_anti") if some else links, ["pk"], [], settle, "pk string, id string, component string")
    if some:
        known = known.unionByName(_components(links.join(large, "pk", "left_semi")))
    return nodes.select("pk", "id").join(known, ["pk", "id"], "left").select("pk", "id", F.coalesce("component", "id").alias("component"))


def _components(links: DataFrame) -> DataFrame:
    """(pk, id, component) of every node that is not the smallest one of its component, by joins over links (pk, a, b), a smaller than b.

    Stars, from a larger id b to a smaller one a: in turn, every b goes over to
    the smallest neighbour of its a, then b and its other smaller neighbours link
    to the smallest of them. Neither adds edges, and minima are taken by partial
    aggregation, so that a node with very many edges is no group in one task.
    Every round merges each star with a neighbouring one, so it ends by itself.
    """
    now = stash(links, "components")
    while True:
        least = now.groupBy("pk", "b").agg(F.min("a").alias("m"))
        over = now.join(least.select("pk", F.col("b").alias("a"), "m"), ["pk", "a"], "left").select("pk", F.coalesce("m", "a").alias("a"), "b").distinct()
        least = over.groupBy("pk", "b").agg(F.min("a").alias("m"))
        others = over.join(least, ["pk", "b"]).where("a <> m").select("pk", F.col("m").alias("a"), F.col("a").alias("b"))
        new = stash(others.unionByName(least.select("pk", F.col("m").alias("a"), "b")).distinct(), "components")
        discard(now)
        now = new
        # Settled when every larger node has one edge and no smaller one has a smaller neighbour.
        twice = now.groupBy("pk", "b").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("pk", "b")
        chained = now.select("pk", F.col("a").alias("b")).join(now.select("pk", "b"), ["pk", "b"], "left_semi")
        if twice.unionByName(chained).isEmpty():
            break
    return now.select("pk", F.col("b").alias("id"), F.col("a").alias("component"))


def cyclic_projects(edges: DataFrame, edges_per_task: int = EDGES_PER_TASK) -> DataFrame:
    """(pk) of projects with a cycle: edges that no edge leads to, or that lead to none, are taken away until none is left to take.

    Projects of up to edges_per_task edges are settled one by one in tasks, larger
    ones by joins over all their edges.
    """
    ways = stash(edges.where("traversable").select("pk", "p", "s").distinct(), "cyclic")
    large = ways.groupBy("pk").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > edges_per_task).select("pk")

    def peel(key: tuple, rows: list[dict]) -> Iterator[dict]:
        near, into = defaultdict(list), Counter()
        for r in rows:
            near[r["p"]].append(r["s"])
            into[r["s"]] += 1
        free = [p for p in near if not into[p]]
        left = len(rows)
        while free:
            for s in near.get(free.pop(), ()):
                left -= 1
                into[s] -= 1
                if not into[s]:
                    free.append(s)
        if left:
            yield {"pk": key[0]}

    found = by_key(ways.join(large, "pk", "left_anti"), ["pk"], [], peel, "pk string")
    return found if large.isEmpty() else found.unionByName(_cyclic(ways.join(large, "pk", "left_semi")))


def _cyclic(ways: DataFrame) -> DataFrame:
    """cyclic_projects() by joins. Besides the ends, links of chains are taken out, so that rounds are few however long the chains.

    A node with one edge in and one out gives way to an edge past it; of
    neighbours in a chain, a toss decides who. A cycle shrinks to an edge from a
    node to itself, which stays.
    """
    left, now, turn = stash(ways, "cyclic"), -1, 0
    while True:
        turn += 1
        ends = left.select("pk", F.col("p").alias("id"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(left.select("pk", F.col("s").alias("id"), F.lit(0).alias("out"), F.lit(1).alias("in")))
        degree = ends.groupBy("pk", "id").agg(F.sum("out").alias("out"), F.sum("in").alias("in"))
        link = (F.col("in") == 1) & (F.col("out") == 1) & (F.pmod(F.xxhash64("pk", "id", F.lit(turn)), F.lit(2)) == 0)
        of = lambda end: degree.select("pk", F.col("id").alias(end), F.col("in" if end == "p" else "out").alias(f"n_{end}"), link.alias(f"link_{end}"))  # noqa: E731, B023
        kept = stash(left.join(of("p"), ["pk", "p"]).join(of("s"), ["pk", "s"]).where("n_p > 0 and n_s > 0").select("pk", "p", "s", "link_p", "link_s"), "cyclic")
        whole, now = now if turn > 1 else left.count(), kept.count()
        if now == whole:  # every edge has one before and one behind it
            return kept.select("pk").distinct()
        past = kept.where("link_s and not link_p").select("pk", F.col("p").alias("before"), F.col("s").alias("p"))
        met = kept.where("not (link_s and not link_p)").join(past, ["pk", "p"], "left").select("pk", F.coalesce("before", "p").alias("p"), "s").distinct()
        new = stash(met, "cyclic")
        discard(left)
        discard(kept)
        left, now = new, new.count()


def cycle_paths(edges: DataFrame) -> DataFrame:
    """(pk, cycle): one cycle for each edge back to a node of the current depth-first path, nodes by id, edges by place.

    Only edges of projects that have a cycle are walked; projects are found by a
    loop over all at once.
    """

    def walk(key: tuple, rows: list[dict]) -> Iterator[dict]:
        near: dict[str, list[str]] = defaultdict(list)
        for r in rows:
            near[r["p"]].append(r["s"])
        done: set[str] = set()
        for root in sorted({r[end] for r in rows for end in ("p", "s")}):
            if root in done:
                continue
            path, place, ways = [root], {root: 0}, [iter(near.get(root, ()))]
            while ways:
                nxt = next(ways[-1], None)
                if nxt is None:
                    ways.pop()
                    last = path.pop()
                    del place[last]
                    done.add(last)
                elif nxt in place:
                    yield {"pk": key[0], "cycle": path[place[nxt] :] + [nxt]}
                elif nxt not in done:
                    place[nxt] = len(path)
                    path.append(nxt)
                    ways.append(iter(near.get(nxt, ())))

    usable = edges.where("traversable").select("pk", "p", "s", "rel_seq").join(cyclic_projects(edges), "pk", "left_semi")
    return by_key(usable, ["pk"], ["rel_seq"], walk, "pk string, cycle array<string>")


class Walker:
    """Bounded walks in one project's graph; the order of visits is part of the result when a bound is hit."""

    def __init__(self, edges: list[tuple[str, str]], milestones: set[str], max_paths: int = MAX_PATHS, max_traversals: int = MAX_TRAVERSALS) -> None:
        self.near: dict[str, list[str]] = defaultdict(list)
        self.back: dict[str, list[str]] = defaultdict(list)
        for p, s in sorted(edges):
            self.near[p].append(s)
            self.back[s].append(p)
        self.milestones, self.max_paths, self.max_traversals = milestones, max_paths, max_traversals

    def visit(self, source: str) -> tuple[list[str], bool, list[list[str]]]:
        """What the source reaches, whether more edges were to be looked at than allowed, and the ways that end at a node of their own."""
        branch: dict[str, tuple[str, ...]] = {source: (source,)}
        order, cycles, stack, looked = [], [], [source], 0
        while stack:
            here = stack.pop()
            trail = branch[here]
            for nxt in reversed(self.near.get(here, ())):
                looked += 1
                if looked > self.max_traversals:
                    return order, True, cycles
                if nxt in trail:
                    cycles.append([*trail, nxt])
                elif nxt not in branch:
                    branch[nxt] = (*trail, nxt)
                    order.append(nxt)
                    stack.append(nxt)
        return order, False, cycles

    def downstream(self, source: str) -> tuple[list[str], bool]:
        """What the source reaches, and whether more edges were to be looked at than allowed."""
        seen, order, stack, looked = {source}, [], [source], 0
        while stack:
            for nxt in reversed(self.near.get(stack.pop(), ())):
                looked += 1
                if looked > self.max_traversals:
                    return order, True
                if nxt not in seen:
                    seen.add(nxt)
                    order.append(nxt)
                    stack.append(nxt)
        return order, False

    def paths(self, source: str, target: str) -> tuple[list[list[str]], bool]:
        """All simple paths, by ascending ids, parallel edges repeated; and whether a bound was reached."""
        out: list[list[str]] = []
        looked, path, on_path = 0, [source], {source}
        if source == target:
            return ([[source]] if self.max_paths > 0 and self.max_traversals > 0 else []), 1 >= self.max_paths or self.max_traversals <= 0
        ways = [iter(self.near.get(source, ()))] if self.max_paths > 0 and self.max_traversals > 0 else []
        while ways:
            nxt = next(ways[-1], None)
            if nxt is None:
                ways.pop()
                on_path.discard(path.pop())
                continue
            looked += 1
            if nxt in on_path or len(out) >= self.max_paths or looked >= self.max_traversals:
                continue
            if nxt == target:
                out.append([*path, nxt])
                continue
            path.append(nxt)
            on_path.add(nxt)
            ways.append(iter(self.near.get(nxt, ())))
        return out, len(out) >= self.max_paths or looked >= self.max_traversals

    def to_milestones(self, source: str, reached: set[str] | None = None) -> tuple[list[list[str]], bool | None]:
        """Paths to every other milestone by id, cut at the most paths; and whether the last search reached a bound, if there was one.

        reached: all that the source reaches, if known. Looking for a milestone
        that it does not reach finds nothing, but may use up the bound on edges,
        which is told of the last milestone only; so the others are passed over.
        """
        out: list[list[str]] = []
        last = None
        wanted = [m for m in sorted(self.milestones) if m != source]
        for k, m in enumerate(wanted):
            if reached is not None and m not in reached and k + 1 < len(wanted):
                continue
            found, last = self.paths(source, m)
            out += found
            if len(out) >= self.max_paths:
                return out[: self.max_paths], last
        return out, last


def milestone_paths(nodes: DataFrame, edges: DataFrame, max_paths: int = MAX_PATHS, max_traversals: int = MAX_TRAVERSALS) -> DataFrame:
    """(pk, source, milestone, path) from every node to every milestone; a project's sources are split among tasks."""
    none = F.lit(None).cast("string").alias("b")
    rows = _split(
        nodes.select("pk", F.lit("source").alias("kind"), F.col("id").alias("a"), none),
        [
            nodes.where("milestone").select("pk", F.lit("milestone").alias("kind"), F.col("id").alias("a"), none),
            edges.where("traversable").select("pk", F.lit("edge").alias("kind"), F.col("p").alias("a"), F.col("s").alias("b")),
        ],
        ["pk"],
    )

    def walk(key: tuple, own: list[dict]) -> Iterator[dict]:
        walker = Walker([(r["a"], r["b"]) for r in own if r["kind"] == "edge"], {r["a"] for r in own if r["kind"] == "milestone"}, max_paths, max_traversals)
        for r in own if walker.milestones else ():
            if r["kind"] == "source":
                found, cut = walker.downstream(r["a"])
                for path in walker.to_milestones(r["a"], None if cut else set(found))[0]:
                    yield {"pk": key[0], "source": r["a"], "milestone": path[-1], "path": path}

    return by_key(rows, ["pk", "share"], ["kind", "a"], walk, "pk string, source string, milestone string, path array<string>")
