"""Mixing sources to target weights: hierarchical budgeting, DataFrame operations only.

The rows form a tree: domain, language, source. A token budget goes from the
root to the leaves by target weights. Where a child can't use its part (its
subtree holds too few tokens, epochs included), the rest goes to its siblings
by their weights, and only what all siblings together can't use reaches the
parent's siblings: each level is filled before its capacity limits the level
above. Each leaf then takes a prefix of its rows in seeded order, one order
for each epoch: whole epochs first, then rows of the next epoch until its
budget is reached (the row that crosses it is the last one in).

No leaf's rows are sorted in one task. Rows carry a seeded hash; a leaf is cut
into bins of the hash with about ``ROWS_PER_BIN`` rows, token sums for each bin are
added up over the bins, and only the bin that holds the budget's edge is
ordered row by row.

Tokens are words, ``[^\\x20\\x09-\\x0D]+``, unless ``tokens`` names another column
or expression.

Edge cases: a null domain, language, source or identifier is a value of its
own; null or empty texts hold no tokens and come with the epoch in which they
stand before the edge; repeated rows share a place in the order and are taken
together; an empty table gives no rows; a leaf without a stated weight has
weight 1, one with weight 0 gets nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.llm.shared import table, written

ROWS_PER_BIN = 1024


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def weighted(leaves: DataFrame, level: str, weights: dict[str, float] | None) -> DataFrame:
    """Adds ``w``: the weight of the value of ``level``, 1 unless stated."""
    w = F.lit(1.0)
    for value, weight in (weights or {}).items():
        w = F.when(F.col(level) == f"={value}", F.lit(float(weight))).otherwise(w)
    return leaves.withColumn("w", w.cast("double"))


def filled(nodes: DataFrame, parents: DataFrame, keys: list[str], level: str, weights: dict[str, float] | None) -> DataFrame:
    """Give each parent's budget to its children: by weight, none over its capacity.

    nodes: keys, level, cap. parents: keys, budget. A child is full if the budget
    would still fill it once all that fill earlier (smaller cap / w) are full.
    """
    nodes = weighted(nodes, level, weights)
    siblings = Window.partitionBy(*[f"p_{k}" for k in keys])
    order = siblings.orderBy("fills", "tie")
    joined = nodes.select(*[F.col(k).alias(f"p_{k}") for k in keys], F.col(level).alias("value"), "cap", "w") if keys else nodes.select(F.col(level).alias("value"), "cap", "w")
    if keys:
        condition = None
        for k in keys:
            same = F.col(f"p_{k}").eqNullSafe(F.col(f"q_{k}"))
            condition = same if condition is None else condition & same
        joined = joined.join(parents.select(*[F.col(k).alias(f"q_{k}") for k in keys], "budget"), condition).drop(*[f"q_{k}" for k in keys])
    else:
        joined = joined.withColumn("one", F.lit(1)).join(parents.withColumn("one", F.lit(1)).select("one", "budget"), "one").drop("one")
    joined = joined.withColumn("fills", F.when(F.col("w") > 0, F.col("cap") / F.col("w")).otherwise(F.lit(float("inf")))).withColumn("tie", F.col("value"))
    joined = joined.withColumn("usable", F.when(F.col("w") > 0, F.col("cap")).otherwise(F.lit(0.0)))
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = joined.withColumn("cap_upto", F.sum("usable").over(upto)).withColumn("w_after", F.sum("w").over(siblings) - F.sum("w").over(upto))
    full = (F.col("w") > 0) & (F.col("cap_upto") + F.when(F.col("w_after") > 1e-12, F.col("fills") * F.col("w_after")).otherwise(F.lit(0.0)) <= F.col("budget") + 1e-9)
    joined = joined.withColumn("full", full)
    rest = F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("usable"))).over(siblings), F.lit(0.0))
    open_w = F.sum(F.when(~F.col("full"), F.col("w"))).over(siblings)
    part = F.when(F.col("full"), F.col("usable")).when(F.col("w") > 0, F.least("usable", rest * F.col("w") / open_w)).otherwise(F.lit(0.0))
    return joined.withColumn("part", part).select(*[F.col(f"p_{k}").alias(k) for k in keys], F.col("value").alias(level), F.col("part").alias("budget"))


def budgets(leaves: DataFrame, levels: list[str], share: float, max_epochs: int, weights: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """Budget of each leaf. leaves: levels, tokens, rows. ``share`` is of all tokens held."""
    weights = weights or {}
    leaves = leaves.withColumn("cap", F.col("tokens").cast("double") * max_epochs)
    parents = leaves.agg((F.coalesce(F.sum("tokens"), F.lit(0)).cast("double") * share).alias("budget"))
    for i, level in enumerate(levels):
        nodes = leaves.groupBy(*levels[: i + 1]).agg(F.sum("cap").alias("cap"))
        parents = filled(nodes, parents, levels[:i], level, weights.get(level))
    return parents


def order_key(seed: int, epoch: Column, ident: Column) -> Column:
    """Hex digest that orders an epoch; equal for repeated rows."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(ident.cast("string"), F.lit("none"))))


def held(value: Column) -> Column:
    """A level's value as text in which null differs from every value."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


def mix(df: DataFrame, levels: dict[str, Column], id_col: str = "doc_id", text_col: str = "text", tokens: Column | None = None, share: float = 0.8, max_epochs: int = 2, seed: int = 17, weights: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """Rows taken: doc_id, the levels, n_tokens, epoch (from 0), times (epochs that took the row).

    ``levels`` names the tree's levels from the root with an expression each.
    ``share`` is the budget as a share of all tokens of one epoch; ``max_epochs`` bounds
    how often a row may come. One row for each epoch that takes a row.
    """
    names = list(levels)
    rows = df.select(F.col(id_col).alias("doc_id"), *[held(c).alias(n) for n, c in levels.items()], (words(F.col(text_col)) if tokens is None else tokens).cast("long").alias("n_tokens"))
    rows = written(rows, "sizes")
    leaves = rows.groupBy(*names).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("held"))
    # One row for each leaf of the tree.
    leaves = written(leaves, "leaves")
    plan = leaves.join(budgets(leaves, names, share, max_epochs, weights), names)
    whole = F.when(F.col("tokens") > 0, F.least(F.floor(F.col("budget") / F.col("tokens") + 1e-9), F.lit(max_epochs))).otherwise(F.lit(0)).cast("int")
    plan = plan.withColumn("whole", whole).withColumn("edge", F.col("budget") - F.col("whole") * F.col("tokens")).withColumn("bins", F.ceil(F.col("held") / ROWS_PER_BIN).cast("long"))
    plan = written(plan.select(*names, "whole", F.when(F.col("whole") >= max_epochs, 0.0).otherwise(F.col("edge")).alias("edge"), "bins"), "budgets")
    dealt = rows.join(plan, names)
    again = dealt.where("whole > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("whole") - 1))).select("doc_id", *names, "n_tokens", "epoch")
    part = dealt.where("edge > 1e-6").withColumn("epoch", F.col("whole")).withColumn("key", order_key(seed, F.col("epoch"), F.col("doc_id")))
    place = F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    part = part.withColumn("bin", F.floor(place * F.col("bins")))
    sums = part.groupBy(*names, "bin", "edge").agg(F.sum("n_tokens").alias("in_bin"))
    before = F.sum("in_bin").over(Window.partitionBy(*names).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("in_bin")
    # Bins that start before the edge; the last of them holds it.
    sums = sums.withColumn("before", before).where(F.col("before") < F.col("edge")).withColumn("holds", F.col("before") + F.col("in_bin") >= F.col("edge")).drop("edge", "in_bin")
    near = part.join(sums, [*names, "bin"])
    inside = near.where(~F.col("holds"))
    ordered = Window.partitionBy(*names, "bin").orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    same = Window.partitionBy(*names, "bin", "key")
    edge = near.where("holds").withColumn("start", F.col("before") + F.sum("n_tokens").over(ordered) - F.sum("n_tokens").over(same)).where(F.col("start") < F.col("edge"))
    columns = ["doc_id", *names, "n_tokens", "epoch"]
    taken = again.select(*columns).unionByName(inside.select(*columns)).unionByName(edge.select(*columns))
    return taken.withColumns({n: F.when(F.col(n) != "", F.substring(F.col(n), F.lit(2), F.length(n))) for n in names})


def document_levels() -> dict[str, Column]:
    """The tree for ``documents``: sources fall in four domains by the digits of their name."""
    number = F.expr("coalesce(try_cast(regexp_extract(source, '([0-9]+)', 1) AS BIGINT), 0)")
    return {"domain": F.concat(F.lit("domain"), F.pmod(number, F.lit(4)).cast("string")), "lang": F.col("lang"), "source": F.col("source")}


#: Languages other than the largest count more than their share, as is usual for mixing by weight.
WEIGHTS = {"domain": {"domain0": 2.0, "domain1": 1.5}, "lang": {"en": 4.0, "de": 1.0, "fr": 1.0, "es": 1.0}}
SHARE, EPOCHS, SEED = 0.8, 2, 17


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), document_levels(), share=SHARE, max_epochs=EPOCHS, seed=SEED, weights=WEIGHTS)


def mixed_documents(docs: DataFrame) -> DataFrame:
    """Pipeline stage: ``docs`` rows as often as their leaf's epochs take them."""
    taken = mix(docs, document_levels(), share=SHARE, max_epochs=EPOCHS, seed=SEED, weights=WEIGHTS)
    # Repeated input rows are taken together, each of them once an epoch.
    times = taken.select(F.col("doc_id").alias("__id"), "epoch").distinct().groupBy("__id").agg(F.count(F.lit(1)).cast("int").alias("__times"))
    joined = docs.join(times, F.col("doc_id").eqNullSafe(F.col("__id")))
    return joined.withColumn("__time", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def _level_sql(i: int) -> str:
    keys = ["domain", "lang", "source"][: i + 1]
    level, up = keys[-1], ", ".join(keys[:-1])
    by = f"PARTITION BY {up}" if up else ""
    join = f"JOIN b{i} USING ({up})" if up else "CROSS JOIN b0"
    weight = {"domain": "CASE domain WHEN 'domain0' THEN 2.0 WHEN 'domain1' THEN 1.5 ELSE 1.0 END", "lang": "CASE lang WHEN '=en' THEN 4.0 ELSE 1.0 END", "source": "1.0"}[level]
    return f"""
n{i} AS (SELECT {', '.join(keys)}, sum(tokens) * 2.0::DOUBLE AS cap, ({weight})::DOUBLE AS w FROM leaf GROUP BY {', '.join(keys)}),
m{i} AS (SELECT n{i}.*, budget, sum(cap) OVER up{i} AS cap_upto, sum(w) OVER all{i} - sum(w) OVER up{i} AS w_after
         FROM n{i} {join}
         WINDOW up{i} AS ({by} ORDER BY cap / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), all{i} AS ({by})),
f{i} AS (SELECT *, cap_upto + CASE WHEN w_after > 1e-12 THEN cap / w * w_after ELSE 0 END <= budget + 1e-9 AS is_full FROM m{i}),
b{i + 1} AS (SELECT {', '.join(keys)}, CASE WHEN is_full THEN cap ELSE least(cap, (budget - coalesce(sum(CASE WHEN is_full THEN cap END) OVER o{i}, 0)) * w / sum(CASE WHEN NOT is_full THEN w END) OVER o{i}) END AS budget
         FROM f{i} WINDOW o{i} AS ({by}))"""


OP2_SQL = (
    r"""
WITH d AS (
  SELECT doc_id, 'domain' || (coalesce(try_cast(regexp_extract(source, '([0-9]+)', 1) AS BIGINT), 0) % 4) AS domain, coalesce('=' || lang, '') AS lang, coalesce('=' || source, '') AS source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens
  FROM documents),
leaf AS (SELECT domain, lang, source, sum(n_tokens)::DOUBLE AS tokens FROM d GROUP BY ALL),
b0 AS (SELECT sum(tokens) * 0.8 AS budget FROM leaf),"""
    + ",".join(_level_sql(i) for i in range(3))
    + r""",
p AS (SELECT leaf.*, budget, CASE WHEN tokens > 0 THEN least(floor(budget / tokens + 1e-9), 2) ELSE 0 END::INT AS n_whole FROM leaf JOIN b3 USING (domain, lang, source)),
e AS (SELECT d.*, n_whole, CASE WHEN n_whole >= 2 THEN 0 ELSE budget - n_whole * tokens END AS edge, md5('17:' || n_whole || ':' || doc_id) AS k FROM d JOIN p USING (domain, lang, source)),
s AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n_tokens AS start FROM e)
SELECT doc_id, domain, nullif(lang, '')[2:] AS lang, nullif(source, '')[2:] AS source, n_tokens, CAST(unnest(range(n_whole)) AS INT) AS epoch FROM e
UNION ALL
SELECT doc_id, domain, nullif(lang, '')[2:] AS lang, nullif(source, '')[2:] AS source, n_tokens, n_whole AS epoch FROM s WHERE edge > 1e-6 AND start < edge
"""
)
