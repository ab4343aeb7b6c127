"""Scalar functions on names, relationship types and scores; all but similarity() stay in the JVM."""

from __future__ import annotations

import json
from difflib import SequenceMatcher
from functools import cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
MILESTONE_TYPES = ("tt_mile", "tt_finmile", "tt_startmile")
RELATIONSHIP_TYPES = ("FS", "SS", "FF", "SF")

#: White space as Python's str.split() and regular expressions see it.
SPACE = r"(?U)[\s\x1c-\x1f]+"


@cache
def _folds() -> tuple[str, str, list[tuple[str, str]]]:
    """How case folding goes beyond lower case: single characters from and to, and those that become several."""
    single, several = {}, {}
    for code in range(128, 0x110000):
        low, fold = chr(code).lower(), chr(code).casefold()
        if low != fold and len(low) == 1:
            (single if len(fold) == 1 else several)[low] = fold
    return "".join(single), "".join(single.values()), sorted(several.items())


def _folded(text: Column) -> Column:
    old, new, several = _folds()
    # One constant array; an expression of as many parts as characters would slow planning down.
    pairs = F.from_json(F.lit(json.dumps([{"a": a, "b": b} for a, b in several])), "array<struct<a:string,b:string>>")
    return F.aggregate(pairs, F.translate(F.lower(text), old, new), lambda x, p: F.replace(x, p["a"], p["b"]))


def normal_name(name: Column) -> Column:
    """Trimmed, case-folded, runs of white space as one space; a null is empty."""
    text = F.coalesce(name, F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)
    folded = F.when(ascii_only, F.lower(text)).otherwise(_folded(text))
    return F.trim(F.regexp_replace(folded, SPACE, " "))


def relationship_type(value: Column) -> Column:
    """Upper case, without PR_ before a known type; a null is empty."""
    return F.regexp_replace(F.upper(F.coalesce(value, F.lit(""))), f"^PR_({'|'.join(RELATIONSHIP_TYPES)})$", "$1")


def is_milestone(task_type: Column) -> Column:
    return F.coalesce(F.lower(task_type).isin(*MILESTONE_TYPES), F.lit(False))


def relationship_label(kind: Column, lag: Column) -> Column:
    return F.concat(F.regexp_replace(F.coalesce(kind, F.lit("")), "^PR_", ""), F.lit(" "), F.coalesce(lag, F.lit("0")), F.lit("h"))


def similarity(a: Column, b: Column, context: Column) -> Column:
    """min(1, 0.7 * Ratcliff-Obershelp ratio of two names + context); not symmetric, so it needs Python."""

    def score(x: pa.Array, y: pa.Array, more: pa.Array) -> pa.Array:
        ratios = (SequenceMatcher(None, p, q).ratio() for p, q in zip(x.to_pylist(), y.to_pylist(), strict=True))
        return pa.array([min(1.0, 0.70 * r + m) for r, m in zip(ratios, more.to_pylist(), strict=True)], pa.float64())

    return F.arrow_udf(score, "double")(a, b, context)


def rounded(value: Column) -> Column:
    """To 4 places as Python rounds: by the exact binary value, half to even."""

    def cut(x: pa.Array) -> pa.Array:
        return pa.array([None if v is None else round(v, 4) for v in x.to_pylist()], pa.float64())

    return F.arrow_udf(cut, "double")(value)
