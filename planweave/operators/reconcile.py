"""Identity of activities between two versions of a project, and what changed.

Three stages, each on what the one before left over: equal ids; equal breakdown
node and normalized name, if only one candidate has them; and a conservative
similarity with explicit uncertainty. Candidates of the third stage come from
equi-joins on every signal that can lift a pair over the threshold, so no
stage forms all pairs of a project.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, groupby
from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planweave.functions.text import normal_name, rounded, similarity
from planweave.operators.graph import by_key
from planweave.operators.normalize import NONE, key_of
from planweave.storage import dealt, stash, written

#: Change name <- activity column.
COMPARED = {
    "code": "code", "name": "name", "wbs_id": "wbs_id", "status": "status", "start_date": "target_start", "finish_date": "target_finish",
    "actual_start": "actual_start", "actual_finish": "actual_finish", "duration_hours": "remaining_duration_hours",
}
NAME_WEIGHT = 0.70
#: Weight of each signal of context.
SAME = {"code": 0.15, "wbs_id": 0.15, "target_start": 0.05, "target_finish": 0.05, "remaining_duration_hours": 0.05}
SHARED = {"preds": 0.10, "succs": 0.10, "near_names": 0.10}
#: Signals that many activities of a project have in common; alone they demand names that are nearly equal.
COMMON = ("target_start", "target_finish", "remaining_duration_hours")


@dataclass(frozen=True)
class MatchConfig:
    threshold: float = 0.78
    margin: float = 0.08


def exact_matches(before: DataFrame, after: DataFrame) -> DataFrame:
    """(pk, b_seq, a_seq): activities of equal id; of equal ids on a side the last counts."""
    def side(df: DataFrame, seq: str) -> DataFrame:
        known = dealt(df.where("activity_id <> ''").select(key_of("project_id").alias("pk"), "activity_id", "act_seq"))
        return known.groupBy("pk", "activity_id").agg(F.max("act_seq").alias(seq))

    return side(before, "b_seq").join(side(after, "a_seq"), ["pk", "activity_id"]).select("pk", "b_seq", "a_seq")


def residual(activities: DataFrame, matches: DataFrame, seq: str) -> DataFrame:
    """Activities that no match has used; by place, so that earlier ones of a repeated id stay."""
    used = dealt(matches.select("pk", F.col(seq).alias("act_seq")))
    return dealt(activities.withColumn("pk", key_of("project_id"))).join(used, ["pk", "act_seq"], "left_anti")


def wbs_name_matches(before: DataFrame, after: DataFrame) -> DataFrame:
    """(pk, b_seq, a_seq) from residuals: equal node (nulls equal) and normalized name, and only one after has them.

    Of several befores the first by id and name is matched.
    """
    def keyed(df: DataFrame) -> DataFrame:
        return df.select("pk", key_of("wbs_id").alias("wk"), normal_name(F.col("name")).alias("nk"), "activity_id", "name", "act_seq")

    order = Window.partitionBy("pk", "wk", "nk").orderBy(F.coalesce("activity_id", F.lit("")), F.coalesce("name", F.lit("")), "act_seq")
    first = keyed(before).withColumn("r", F.row_number().over(order)).where("r = 1").select("pk", "wk", "nk", F.col("act_seq").alias("b_seq"))
    single = keyed(after).groupBy("pk", "wk", "nk").agg(F.count(F.lit(1)).alias("n"), F.max("act_seq").alias("a_seq")).where("n = 1")
    return first.join(single, ["pk", "wk", "nk"]).select("pk", "b_seq", "a_seq")


def neighbours(relationships: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(pk, ak, preds, succs): sorted sets of neighbouring ids of every id that an edge names, from all edges; a null id is a key too.

    ids (pk, id, to): neighbours go by the id `to` where there is one.
    """
    ends = dealt(relationships.select(key_of("project_id").alias("pk"), "predecessor_id", "successor_id", F.col("predecessor_id").alias("p"), F.col("successor_id").alias("s")))
    for end in ("p", "s") if ids is not None else ():
        ends = ends.join(ids.select("pk", F.col("id").alias(end), F.col("to").alias(f"to_{end}")), ["pk", end], "left").withColumn(end, F.coalesce(f"to_{end}", end))
    none = F.lit(None).cast("string")
    into = F.when(F.col("predecessor_id") != "", F.struct(key_of("successor_id").alias("ak"), F.col("p"), none.alias("s")))
    out = F.when(F.col("successor_id") != "", F.struct(key_of("predecessor_id").alias("ak"), none.alias("p"), F.col("s")))
    return ends.select("pk", F.inline(F.array_compact(F.array(into, out)))).groupBy("pk", "ak").agg(F.array_sort(F.collect_set("p")).alias("preds"), F.array_sort(F.collect_set("s")).alias("succs"))


def with_neighbours(activities: DataFrame, near: DataFrame) -> DataFrame:
    """activities (with pk) and their preds and succs; no neighbours are an empty set."""
    met = activities.withColumn("ak", key_of("activity_id")).join(near, ["pk", "ak"], "left").drop("ak")
    empty = F.array().cast("array<string>")
    return met.withColumns({"preds": F.coalesce("preds", empty), "succs": F.coalesce("succs", empty)})


def _with_near_names(activities: DataFrame, every: DataFrame) -> DataFrame:
    """activities with near_names: the normalized names of all neighbours that the project has."""
    names = every.where("activity_id <> ''").select(key_of("project_id").alias("pk"), F.col("activity_id").alias("id"), normal_name(F.col("name")).alias("nn"))
    met = activities.select("pk", "act_seq", F.explode(F.array_union("preds", "succs")).alias("id")).join(names, ["pk", "id"])
    met = met.groupBy("pk", "act_seq").agg(F.collect_set("nn").alias("near_names"))
    return activities.join(met, ["pk", "act_seq"], "left").withColumn("near_names", F.coalesce("near_names", F.array().cast("array<string>")))


def _size_class(length: Column, least_ratio: float) -> Column:
    """A class of name lengths: names that can have a ratio of least_ratio are in one class or in neighbouring ones."""
    shorter = least_ratio / (2 - least_ratio)  # of the longer one's length
    return F.when(length == 0, -9).otherwise(F.floor(F.log(length.cast("double")) / -log(shorter) + 1e-9)).cast("long")


def fuzzy_candidates(before: DataFrame, after: DataFrame, config: MatchConfig) -> DataFrame:
    """(pk, b_seq, a_seq): every pair that can be accepted or count as a rival, and others that share a signal.

    A pair whose score stays below threshold less margin is neither. Pairs meet in
    equi-joins: on each signal that lifts them far, and on each combination of the
    common ones together with a class of name lengths, as pairs that share no
    other signal need the more alike names the fewer of these they share. Where
    the configuration lets pairs without any signal matter, lengths alone are the key.
    """
    least = config.threshold - config.margin
    keys: list[tuple[str, list[Column], float | None]] = [(c, [F.when(F.col(c) != "", F.col(c))], None) for c in SAME if c not in COMMON]
    for n in range(1 if least >= NAME_WEIGHT - 1e-9 else 0, len(COMMON) + 1):
        for own in combinations(COMMON, n):
            ratio = (least - sum(SAME[c] for c in own) - 1e-9) / NAME_WEIGHT
            keys.append(("+".join(own), [F.when(F.col(c) != "", F.col(c)) for c in own], ratio if ratio > 0.05 else None))

    def tagged(c: str) -> Column:
        return F.transform(c, lambda x: F.concat(F.lit(f"{c}\0"), x))

    def signals(df: DataFrame, seq: str, spread: bool) -> DataFrame:
        size = F.char_length(normal_name(F.col("name")))
        found = []
        for name, values, ratio in keys:
            key = F.concat(F.lit(f"{name}\0"), *[x for v in values for x in (v, F.lit("\0"))])
            if ratio is None:
                found.append(F.array(key))
            else:
                near = (-1, 0, 1) if spread else (0,)
                found.append(F.array(*[F.concat(key, (_size_class(size, min(ratio, 0.999)) + d).cast("string")) for d in near]))
        found += [tagged(c) for c in SHARED]
        return df.select("pk", F.col("act_seq").alias(seq), F.explode(F.array_compact(F.array_distinct(F.flatten(F.array(*found))))).alias("signal"))

    return signals(before, "b_seq", True).join(signals(after, "a_seq", False), ["pk", "signal"]).select("pk", "b_seq", "a_seq").distinct()


def _context() -> Column:
    score = F.lit(0.0)
    for c, w in SAME.items():
        score = score + F.when((F.col(f"b.{c}") != "") & (F.col(f"b.{c}") == F.col(f"a.{c}")), w).otherwise(0.0)
    for c, w in SHARED.items():
        score = score + F.when(F.arrays_overlap(f"b.{c}", f"a.{c}"), w).otherwise(0.0)
    return score


def scored_pairs(before: DataFrame, after: DataFrame, config: MatchConfig) -> DataFrame:
    """(pk, b_seq, a_seq, bn, an, context): candidates that can matter by their context and the lengths of their names."""
    pairs = fuzzy_candidates(before, after, config).alias("p")
    met = pairs.join(before.alias("b"), (F.col("p.pk") == F.col("b.pk")) & (F.col("b_seq") == F.col("b.act_seq"))).join(
        after.alias("a"), (F.col("p.pk") == F.col("a.pk")) & (F.col("a_seq") == F.col("a.act_seq"))
    )
    met = met.select("p.pk", "b_seq", "a_seq", normal_name(F.col("b.name")).alias("bn"), normal_name(F.col("a.name")).alias("an"), _context().alias("context"))
    total = F.char_length("bn") + F.char_length("an")
    bound = F.when(total == 0, 1.0).otherwise(2 * F.least(F.char_length("bn"), F.char_length("an")) / total)
    return met.where(NAME_WEIGHT * bound + F.col("context") >= config.threshold - config.margin - 1e-9)


def fuzzy_scores(before: DataFrame, after: DataFrame, config: MatchConfig) -> DataFrame:
    """(pk, b_seq, a_seq, score) of candidates that can matter."""
    return scored_pairs(before, after, config).select("pk", "b_seq", "a_seq", similarity(F.col("bn"), F.col("an"), F.col("context")).alias("score"))


def fuzzy_matches(before: DataFrame, after: DataFrame, scores: DataFrame, config: MatchConfig) -> DataFrame:
    """(pk, b_seq, a_seq, score, uncertain): one before after the other takes its best after that is left.

    What a before takes is gone for those behind it, so a project's candidates
    are settled in sequence, in one task; they are few, since the two stages
    before and the score bound have taken the rest, and they pass through in
    order without being held together.
    """
    order = before.select("pk", F.col("act_seq").alias("b_seq"), F.coalesce("activity_id", F.lit("")).alias("o1"), F.coalesce("name", F.lit("")).alias("o2"))
    ranked = scores.join(order, ["pk", "b_seq"])
    threshold, margin = config.threshold, config.margin

    def settle(key: tuple, rows: list[dict]) -> Iterator[dict]:
        taken: set[int] = set()
        for b, mine in groupby(rows, key=lambda r: r["b_seq"]):
            left = [r for r in mine if r["a_seq"] not in taken]
            if left and left[0]["score"] >= threshold:
                taken.add(left[0]["a_seq"])
                rival = len(left) > 1 and left[0]["score"] - left[1]["score"] < margin
                yield {"pk": key[0], "b_seq": b, "a_seq": left[0]["a_seq"], "score": left[0]["score"], "uncertain": rival}

    return by_key(ranked, ["pk"], ["o1", "o2", "b_seq", F.desc("score"), "a_seq"], settle, "pk string, b_seq long, a_seq long, score double, uncertain boolean")


def residuals(before: DataFrame, after: DataFrame, before_rel: DataFrame, after_rel: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Matches of the first and the second stage, and what both leave of either side, with neighbours and their names."""
    # Written, as each is used several times by the next ones: as plans they would double with every use.
    exact = stash(exact_matches(before, after), "exact")
    b1, a1 = stash(residual(before, exact, "b_seq"), "left"), stash(residual(after, exact, "a_seq"), "left")
    named = stash(wbs_name_matches(b1, a1), "named")
    return exact, named, _unnamed(b1, named, "b_seq", before_rel, before), _unnamed(a1, named, "a_seq", after_rel, after)


def _unnamed(left: DataFrame, named: DataFrame, seq: str, rel: DataFrame, every: DataFrame) -> DataFrame:
    """What the second stage leaves of a side, with neighbours and their names."""
    own = left.join(named.select("pk", F.col(seq).alias("act_seq")), ["pk", "act_seq"], "left_anti")
    return stash(_with_near_names(with_neighbours(own, neighbours(rel)), every), "rest", key="pk")


def match_pairs(before: DataFrame, after: DataFrame, before_rel: DataFrame, after_rel: DataFrame, config: MatchConfig = MatchConfig(), fuzzy: bool = True) -> DataFrame:
    """(pk, b_seq, a_seq, stage, confidence, uncertain) of all three stages."""
    if fuzzy:
        exact, named, b2, a2 = residuals(before, after, before_rel, after_rel)
    else:
        exact = stash(exact_matches(before, after), "exact")
        named = wbs_name_matches(residual(before, exact, "b_seq"), residual(after, exact, "a_seq"))
    out = exact.withColumns({"stage": F.lit("id"), "confidence": F.lit(1.0), "uncertain": F.lit(False)}).unionByName(
        named.withColumns({"stage": F.lit("wbs_name"), "confidence": F.lit(0.98), "uncertain": F.lit(False)})
    )
    if not fuzzy:
        return out
    found = fuzzy_matches(b2, a2, fuzzy_scores(b2, a2, config), config)
    return out.unionByName(found.select("pk", "b_seq", "a_seq", F.lit("fuzzy").alias("stage"), rounded(F.col("score")).alias("confidence"), "uncertain"))


def field_changes(b: str = "b", a: str = "a") -> Column:
    """Map of the compared fields that differ, nulls equal: name -> before, after."""
    pairs = [F.struct(F.lit(n).alias("key"), F.struct(F.col(f"{b}.{c}").alias("before"), F.col(f"{a}.{c}").alias("after")).alias("value")) for n, c in COMPARED.items()]
    differ = F.lit(False)
    for c in COMPARED.values():
        differ = differ | ~F.col(f"{b}.{c}").eqNullSafe(F.col(f"{a}.{c}"))
    found = F.map_from_entries(F.filter(F.array(*pairs), lambda x: ~x["value"]["before"].eqNullSafe(x["value"]["after"])))
    return F.when(differ, found).otherwise(F.create_map().cast("map<string,struct<before:string,after:string>>"))  # most are alike


def compare_activities(before: DataFrame, after: DataFrame, before_rel: DataFrame, after_rel: DataFrame, config: MatchConfig = MatchConfig(), fuzzy: bool = True) -> DataFrame:
    """One row per match, addition and deletion, of projects that both sides have.

    Columns: project_id, before_activity_id, after_activity_id, stage, status,
    confidence, field_changes, set_changes (predecessors, successors: sorted sets
    of ids, those of the before side carried over to the ids of the after side),
    b_seq, a_seq, and before_src, after_src, the raw records, where both sides have them.
    Most activities have their match by id, and are paired as they lie, sorted by
    id; only what that leaves is written, with all that is compared, for the other
    stages. Nothing else is, so the disk holds little more than one shuffle.
    """
    before, after, before_rel, after_rel = (written(x, "side") for x in (before, after, before_rel, after_rel))
    raw = "src" in before.columns and "src" in after.columns
    wanted = list(dict.fromkeys([*COMPARED.values(), "activity_id", "act_seq", *["src"] * raw]))
    b_all, a_all = (side.select(key_of("project_id").alias("pk"), *wanted) for side in (before, after))
    left = stash(_unmatched(b_all, a_all), "left", key="pk")
    b1, a1 = (left.where(F.col("side") == side).drop("side") for side in (0, 1))
    named = wbs_name_matches(b1, a1)
    told = lambda df, stage, confidence, uncertain: df.select("pk", "b_seq", "a_seq", F.lit(stage).alias("stage"), confidence.alias("confidence"), uncertain.alias("uncertain"))
    if fuzzy:
        named = stash(named, "named", key="pk")
        b2, a2 = _unnamed(b1, named, "b_seq", before_rel, before), _unnamed(a1, named, "a_seq", after_rel, after)
        found = fuzzy_matches(b2, a2, fuzzy_scores(b2, a2, config), config)
    later = told(named, "wbs_name", F.lit(0.98), F.lit(False))
    later = stash(later.unionByName(told(found, "fuzzy", rounded(F.col("score")), F.col("uncertain"))) if fuzzy else later, "later", key="pk")
    row = F.struct(*wanted)
    met = later.join(b1.select("pk", F.col("act_seq").alias("b_seq"), row.alias("b"), "known"), ["pk", "b_seq"]).join(a1.select("pk", F.col("act_seq").alias("a_seq"), row.alias("a")), ["pk", "a_seq"])
    met = stash(met.drop("b_seq", "a_seq"), "pairs", key="pk")
    # An id that both sides have stays what it is; others go by the id of their match.
    ids = met.where("not known and b.activity_id <> '' and a.activity_id <> ''").groupBy("pk", F.col("b.activity_id").alias("id"))
    ids = stash(ids.agg(F.max_by("a.activity_id", "b.act_seq").alias("to")), "ids", key="pk")
    exact = _last_of_ids(b_all).select("pk", "activity_id", row.alias("b")).join(_last_of_ids(a_all).select("pk", "activity_id", row.alias("a")), ["pk", "activity_id"])
    exact = exact.select("pk", F.lit("id").alias("stage"), F.lit(1.0).alias("confidence"), F.lit(False).alias("uncertain"), "b", "a")
    met = _told_apart(exact.unionByName(met.drop("known")), raw)
    for side, key, near in (("b", "bk", neighbours(before_rel, ids)), ("a", "ak", neighbours(after_rel))):
        met = met.join(near.select("pk", F.col("ak").alias(key), F.col("preds").alias(f"{side}_preds"), F.col("succs").alias(f"{side}_succs")), ["pk", key], "left")
    empty = F.array().cast("array<string>")
    sets = [
        F.struct(F.lit(name).alias("key"), F.struct(F.coalesce(f"b_{c}", empty).alias("before"), F.coalesce(f"a_{c}", empty).alias("after")).alias("value"))
        for name, c in (("predecessors", "preds"), ("successors", "succs"))
    ]
    met = met.withColumn("set_changes", F.map_from_entries(F.filter(F.array(*sets), lambda x: x["value"]["before"] != x["value"]["after"])))
    changed = F.size("field_changes") + F.size("set_changes")
    only_name = (F.size("set_changes") == 0) & (F.size(F.map_filter("field_changes", lambda k, v: k != "name")) == 0)
    status = (
        F.when(F.col("uncertain"), "UNCERTAIN")
        .when((F.col("stage") == "fuzzy") & F.col("renamed") & only_name, "POSSIBLE_RENAME")
        .when(changed == 0, "UNCHANGED").otherwise("MODIFIED")
    )
    out = met.select(
        "pk", "before_activity_id", "after_activity_id", "stage", status.alias("status"), "confidence",
        "field_changes", "set_changes", "b_seq", "a_seq", *["before_src", "after_src"] * raw,
    )
    both = b_all.select("pk").distinct().join(a_all.select("pk").distinct(), "pk", "left_semi")

    def alone(df: DataFrame, side: str, name: str, status: str) -> DataFrame:
        rest = df.join(later.select("pk", F.col(f"{side[0]}_seq").alias("act_seq")), ["pk", "act_seq"], "left_anti").join(both, "pk", "left_semi")
        return rest.select("pk", F.col("activity_id").alias(name), F.lit(status).alias("status"), F.lit(1.0).alias("confidence"), F.col("act_seq").alias(f"{side[0]}_seq"), *[F.col("src").alias(f"{side}_src")] * raw)

    out = out.unionByName(alone(a1, "after", "after_activity_id", "ADDED"), allowMissingColumns=True)
    out = out.unionByName(alone(b1, "before", "before_activity_id", "DELETED"), allowMissingColumns=True)
    return out.withColumn("project_id", F.nullif("pk", F.lit(NONE))).drop("pk")


def _told_apart(pairs: DataFrame, raw: bool) -> DataFrame:
    """Pairs of rows b and a with what differs in their place, so that what follows doesn't sort whole rows; bk and ak are the ids as keys."""
    src = [F.col(f"{x}.src").alias(f"{side}_src") for x, side in (("b", "before"), ("a", "after")) if raw]
    return pairs.select(
        "pk", "stage", "confidence", "uncertain", F.col("b.activity_id").alias("before_activity_id"), F.col("a.activity_id").alias("after_activity_id"), F.col("b.act_seq").alias("b_seq"), F.col("a.act_seq").alias("a_seq"),
        key_of("b.activity_id").alias("bk"), key_of("a.activity_id").alias("ak"), (~F.col("b.name").eqNullSafe(F.col("a.name"))).alias("renamed"), field_changes().alias("field_changes"), *src,
    )


def _last_of_ids(activities: DataFrame) -> DataFrame:
    """Of the activities (with pk) of one id the last."""
    last = F.max("act_seq").over(Window.partitionBy("pk", "activity_id"))
    return dealt(activities.where("activity_id <> ''")).withColumn("last", last).where("act_seq = last").drop("last")


def _unmatched(before: DataFrame, after: DataFrame) -> DataFrame:
    """The activities (with pk) of both sides that have no match by id, by `side` 0 and 1, and whether both sides have their id (`known`)."""
    every = dealt(before.withColumn("side", F.lit(0)).unionByName(after.withColumn("side", F.lit(1))))
    last = [F.max(F.when(F.col("side") == side, F.col("act_seq"))).over(Window.partitionBy("pk", "activity_id")) for side in (0, 1)]
    every = every.withColumns({"b_last": last[0], "a_last": last[1]})
    known = F.coalesce((F.col("activity_id") != "") & F.col("b_last").isNotNull() & F.col("a_last").isNotNull(), F.lit(False))
    matched = known & (F.col("act_seq") == F.when(F.col("side") == 0, F.col("b_last")).otherwise(F.col("a_last")))
    return every.withColumn("known", known).where(~matched).drop("b_last", "a_last")
