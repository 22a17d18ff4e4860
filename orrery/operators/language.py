"""The selection language for features: conditions on their partner residues.

A string has parts separated by ``and``; positive parts are united and ``not`` parts
taken away. A part starts with ``res`` (ALA, A, ALA13), ``resid``, ``seqid`` (numbers and
inclusive ranges), ``consensus`` (patterns, ``all`` for both partners; ranges such as
``3.50-4.50`` or, by part of the label, ``*40-*50``) or ``all``; bare numbers
are seqids, bare names residues. The string becomes one condition on a column of partners.

A consensus range goes from the first residue with its start to the last with its end, by seqid, in each
trajectory; a missing end is replaced by the nearest labelled residue beyond the other.
Residues without a label lie in it only after ``all``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = ("res", "resid", "seqid", "consensus", "all")


def _residue(p: Column, name: str) -> Column:
    return p["residue"][name]


def _numeric(field: str, tokens: list[str]):
    from orrery.operators.select import in_ranges, numbers

    ranges = [r for t in tokens for r in numbers(t)]
    return lambda p: F.coalesce(in_ranges(_residue(p, field), ranges), F.lit(False))


def _res(tokens: list[str]):
    def test(p: Column) -> Column:
        out = F.lit(False)
        for t in tokens:
            m = re.fullmatch(r"([a-zA-Z]+)(\d*)", t)
            if not m:
                raise ValueError(f"not a residue: {t!r}")
            name = m[1].upper()
            hit = (F.upper(_residue(p, "aaa_code")) == name) | (F.upper(_residue(p, "a_code")) == name)
            out = out | (hit & (_residue(p, "seqid") == int(m[2])) if m[2] else hit)
        return F.coalesce(out, F.lit(False))

    return test


def _consensus(tokens: list[str], unlabelled: bool = False):
    patterns = [t.strip("*").lower() for t in tokens if "-" not in t]
    ranges = [t for t in tokens if "-" in t]

    def test(p: Column) -> Column:
        out = F.lit(False)
        for t in patterns:
            out = out | F.lower(_residue(p, "consensus")).contains(t)
        for t in ranges:
            inside = _residue(p, "seqid").between(F.col(f"`{t}:first`"), F.col(f"`{t}:last`"))
            out = out | (inside if unlabelled else inside & _residue(p, "consensus").isNotNull())
        return F.coalesce(out, F.lit(False))

    return test


def _part(text: str):
    """A test of one partner, whether it is negative, and whether all partners must pass."""
    tokens = text.replace(",", " ").split()
    negative = bool(tokens) and tokens[0] == "not"
    tokens = tokens[1:] if negative else tokens
    if not tokens:
        raise ValueError("an empty selection")
    word, rest = tokens[0], tokens[1:]
    every = False
    if word == "consensus" and rest and rest[0] == "all":
        if any("-" in t for t in rest[1:]):
            return _consensus(rest[1:], unlabelled=True), negative, False
        every, rest = True, rest[1:]
    if word == "all":
        return (lambda p: F.lit(True)), negative, False
    if word not in WORDS:
        rest = tokens
        word = "seqid" if re.fullmatch(r"[\d-]+", tokens[0]) else "res"
    if not rest:
        raise ValueError(f"{word} needs values")
    test = {"res": _res, "consensus": _consensus}.get(word)
    return (test(rest) if test else _numeric("index" if word == "resid" else "seqid", rest)), negative, every


def condition(selection: str, partners: str = "partners", require_all: bool = False) -> Column:
    """The condition on the partners column."""
    positive, negative = None, None
    for text in selection.lower().split("and"):
        test, minus, every = _part(text.strip())
        hit = F.forall(partners, test) if require_all or every else F.exists(partners, test)
        if minus:
            negative = hit if negative is None else negative | hit
        else:
            positive = hit if positive is None else positive | hit
    out = F.lit(True) if positive is None else positive
    return out if negative is None else out & ~negative


def ranges_in(selection: str) -> list[str]:
    """Consensus ranges of a selection, as they stand in it."""
    parts = [p.replace(",", " ").replace(";", " ").split() for p in selection.lower().split("and")]
    parts = [p[1:] if p[:1] == ["not"] else p for p in parts]
    return list(dict.fromkeys(t for p in parts if p[:1] == ["consensus"] for t in p[1:] if "-" in t))


def range_ends(meta: DataFrame, ranges: list[str]) -> DataFrame:
    """First and last seqid of each range, in a row for each trajectory (one row without ``traj_id``)."""
    by = [c for c in ("traj_id",) if c in meta.columns]
    residues = meta.select(*by, F.explode("partners").alias("p")).select(*by, "p.residue.seqid", F.lower("p.residue.consensus").alias("label")).distinct()

    def hit(pattern: str, like: bool) -> Column:
        return F.col("label").contains(pattern.replace("*", "")) if like else F.col("label") == pattern

    cut = {t: (*t.split("-", 1), "*" in t) for t in ranges}
    found = [f(F.when(hit(side, like), F.col("seqid"))).alias(f"{t}:{n}") for t, (start, end, like) in cut.items() for f, side, n in ((F.min, start, "s0"), (F.max, start, "s1"), (F.min, end, "e0"), (F.max, end, "e1"))]
    first = residues.groupBy(*by).agg(*found)
    labelled = residues.where("label IS NOT NULL").select(*by, "seqid")
    both = first.join(labelled, by, "left") if by else first.crossJoin(labelled)
    c = lambda t, n: F.col(f"`{t}:{n}`")
    below = [F.max(F.when(F.col("seqid") < c(t, "e0"), F.col("seqid"))).alias(f"{t}:below") for t in ranges]
    above = [F.min(F.when(F.col("seqid") > c(t, "s1"), F.col("seqid"))).alias(f"{t}:above") for t in ranges]
    ends = both.groupBy(*by, *[c(t, n) for t in ranges for n in ("s0", "e1")]).agg(*below, *above)
    return ends.select(*by, *[x for t in ranges for x in (F.coalesce(c(t, "s0"), c(t, "below")).alias(f"{t}:first"), F.coalesce(c(t, "e1"), c(t, "above")).alias(f"{t}:last"))])


def select_features(meta: DataFrame, selection: str = "all", require_all: bool = False) -> DataFrame:
    """Rows of feature_meta that the string selects."""
    if not (ranges := ranges_in(selection)):
        return meta.where(condition(selection, require_all=require_all))
    ends = range_ends(meta, ranges)
    joined = meta.join(ends, "traj_id", "left") if "traj_id" in meta.columns else meta.crossJoin(ends)
    return joined.where(condition(selection, require_all=require_all)).select(*meta.columns)


def consensus_range(residues: DataFrame, start: str, end: str) -> DataFrame:
    """Residues from the first that matches ``start`` to the last that matches ``end``, by number."""
    label = F.lower("consensus")
    lo = F.min(F.when(label.contains(start.strip("*").lower()), F.col("seqid"))).alias("lo")
    hi = F.max(F.when(label.contains(end.strip("*").lower()), F.col("seqid"))).alias("hi")
    bounds = residues.where("seqid <> 0").groupBy("traj_id").agg(lo, hi)
    return residues.join(bounds, "traj_id").where(F.col("seqid").between(F.col("lo"), F.col("hi"))).drop("lo", "hi")


def names_of(meta: DataFrame) -> DataFrame:
    from orrery.functions.names import feature_name

    return meta.select("feature_type", "traj_id", "feature_idx", feature_name(F.col("partners")).alias("feature_name"))
