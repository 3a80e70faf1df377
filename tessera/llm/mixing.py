"""Mixing sources to target weights by hierarchical budgeting, in DataFrame functions only.

A tree of domains, their languages and their sources carries integer weights. The
token budget goes down from the root: at each node it is divided among the children
by weight, no child gets more than it can supply (its tokens times the epochs
allowed), and what a child can't supply goes to its siblings. A node's supply is
that of its leaves, so a shortage reaches the node's own siblings only when the
whole node is exhausted. A leaf's allocation is whole epochs plus a prefix, by
tokens, of one more epoch, each epoch in an order of its own drawn from the seed.

The division needs no iteration: sorted by supply per weight, the exhausted children
are a prefix, which running sums find. The cut of a leaf's prefix is found by sums
of 4096 ranges of the order and a running sum within the one range where the
allocation ends, so no leaf, however large, is gathered or sorted as a whole, and
texts are never shuffled.

Defined results: null languages and sources are nodes named ''; a null text has no
tokens; a leaf without tokens or of weight 0 gives nothing; rows with equal ids in a
leaf share a place in the order and are taken or left together; an empty table gives
no rows. Other columns are carried along whatever their names, but epoch is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import numbered, written

WORDS = r"[^\x20\x09-\x0D]+"
LEVELS = ("_domain", "_lang", "_source")
#: Production parameters. A name that a level doesn't list has weight 1.
WEIGHTS = {
    "_domain": {"web": 3, "library": 2, "other": 1},
    "_lang": {"en": 4, "fr": 2, "de": 2, "es": 1},
    "_source": {"src0": 2},
}
EPOCHS, SEED, SHARE = 2, 17, (1, 1)
RANGES = 3  # hexadecimal digits


def domain_of(source: Column) -> Column:
    """The production tree's domain of a source."""
    return F.when(source.rlike("^src[0-9]$"), "web").when(source.rlike("^src1[0-9]$"), "library").otherwise("other")


def _weight(level: str, weights: dict[str, dict[str, int]]) -> Column:
    chosen = F.lit(1)
    for name, weight in weights.get(level, {}).items():
        chosen = F.when(F.col(level) == name, weight).otherwise(chosen)
    return chosen.cast("long")


def _divided(children: DataFrame, parent: list[str], level: str, weights) -> DataFrame:
    """Adds share, the tokens of budget (the parent's) that each child gets, to rows with supply."""
    ranked = children.withColumn("w", _weight(level, weights)).where("w > 0")
    order = Window.partitionBy(*parent).orderBy(F.col("supply") / F.col("w"), level)
    everyone = Window.partitionBy(*parent)
    big = lambda c: c.cast("decimal(38,0)")
    before = F.coalesce(F.sum("supply").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    full = big(F.col("supply")) * rest <= big(F.col("budget") - before) * F.col("w")
    left = ranked.withColumn("full", full)
    left = left.withColumn("left_budget", F.col("budget") - F.sum(F.when(F.col("full"), F.col("supply")).otherwise(0)).over(everyone))
    left = left.withColumn("left_weight", F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(everyone))
    part = F.expr("cast(left_budget as decimal(38,0)) * w div left_weight")
    return left.withColumn("share", F.when(F.col("full"), F.col("supply")).otherwise(part)).drop("w", "full", "left_budget", "left_weight", "budget")


def allocations(leaves: DataFrame, weights, epochs: int, share: tuple[int, int]) -> DataFrame:
    """Leaves (the three levels, tokens) with their allocation, in tokens."""
    leaves = leaves.where("tokens > 0").withColumn("supply", F.col("tokens") * epochs)
    budget = leaves.agg(F.expr(f"sum(tokens) * {share[0]} div {share[1]}").alias("budget"))
    found = None
    for depth, level in enumerate(LEVELS):
        keys = list(LEVELS[:depth])
        nodes = leaves.groupBy(*keys, level).agg(F.sum("supply").alias("supply"))
        nodes = nodes.join(found.select(*keys, F.col("share").alias("budget")), keys) if keys else nodes.join(budget)
        found = _divided(nodes, keys, level, weights)
    return leaves.drop("supply").join(found.select(*LEVELS, "share"), list(LEVELS))


def _order_key(seed: int, id_col: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))


def mixed(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
    weights=WEIGHTS, domain=domain_of, epochs: int = EPOCHS, share: tuple[int, int] = SHARE, seed: int = SEED,
) -> DataFrame:
    """The documents of the mixture, each once for every epoch (column epoch, from 0) that takes it.

    share: the budget as a fraction of the tokens there are.
    """
    named, at = numbered(docs)
    source, blank = F.col(at[source_col]), F.lit("")
    named = named.withColumns(dict(zip(LEVELS, (domain(source), F.coalesce(F.col(at[lang_col]), blank), F.coalesce(source, blank)))))
    slim = named.select(F.col(at[id_col]).alias("_id"), *LEVELS, F.coalesce(F.regexp_count(F.col(at[text_col]), F.lit(WORDS)), F.lit(0)).cast("long").alias("n"))
    slim, _ = written(slim, "tokens")
    leaves = slim.groupBy(*LEVELS).agg(F.sum("n").alias("tokens"))
    plan = allocations(leaves, weights, epochs, share).select(
        *LEVELS, F.expr("share div tokens").alias("whole"), F.expr("share % tokens").alias("rest")
    )
    plan, _ = written(plan, "allocations")  # a row a leaf; read back, its size is known to the planner
    keyed = slim.join(plan, list(LEVELS)).withColumn("key", _order_key(seed, "_id"))
    ranges = keyed.groupBy(*LEVELS, F.substring("key", 1, RANGES).alias("range")).agg(F.sum("n").alias("n"), F.first("rest").alias("rest"))
    running = F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("range"))
    ends = ranges.withColumn("upto", running).where("upto - n <= rest AND rest < upto").select(
        *LEVELS, F.col("range").alias("end"), (F.col("rest") - F.col("upto") + F.col("n")).alias("room")
    )
    ends, _ = written(ends, "ranges")
    at_end = keyed.join(ends, list(LEVELS)).where(F.substring("key", 1, RANGES) == F.col("end"))
    summed = at_end.groupBy(*LEVELS, "end", "room", "key").agg(F.sum("n").alias("n"))
    within = summed.withColumn("upto", F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("key")))
    cuts = within.groupBy(*LEVELS, "end").agg(F.max(F.when(F.col("upto") <= F.col("room"), F.col("key"))).alias("last"))
    cuts, _ = written(plan.join(cuts, list(LEVELS)).select(*LEVELS, "whole", F.coalesce("last", "end").alias("last")), "cuts")
    taken = named.join(cuts, list(LEVELS)).withColumn("_last", F.col("whole") - F.when(_order_key(seed, at[id_col]) <= F.col("last"), 0).otherwise(1))
    kept = [F.col(c).alias(name) for name, c in at.items() if name != "epoch"]
    return taken.where("_last >= 0").select(*kept, F.explode(F.sequence(F.lit(0), F.col("_last").cast("int"))).alias("epoch"))


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mixed(docs).select("doc_id", "lang", "source", "n_chars", "epoch")


def _case(level: str) -> str:
    cases = " ".join(f"WHEN {level} = '{name}' THEN {weight}" for name, weight in reversed(WEIGHTS[level].items()))
    return f"CASE {cases} ELSE 1 END"


def _level_sql(depth: int) -> str:
    level, keys = LEVELS[depth], list(LEVELS[:depth])
    part = f"PARTITION BY {', '.join(keys)}" if keys else ""
    upper = f"JOIN a{depth - 1} USING ({', '.join(keys)})" if keys else "CROSS JOIN (SELECT sum(tokens) * %d // %d AS share FROM leaves)" % SHARE
    columns = ", ".join([*keys, level])
    return f"""
    n{depth} AS (SELECT {columns}, s.supply, {_case(level)} AS w, share AS budget
      FROM (SELECT {columns}, sum(tokens * {EPOCHS}) AS supply FROM leaves GROUP BY {columns}) s {upper}),
    f{depth} AS (SELECT *, CAST(supply AS HUGEINT) * sum(w) OVER ({part} ORDER BY supply / w, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
      <= CAST(budget - coalesce(sum(supply) OVER ({part} ORDER BY supply / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS HUGEINT) * w AS is_full FROM n{depth}),
    a{depth} AS (SELECT {columns}, CASE WHEN is_full THEN supply ELSE CAST(budget - sum(CASE WHEN is_full THEN supply ELSE 0 END) OVER ({part}) AS HUGEINT) * w
      // greatest(sum(CASE WHEN is_full THEN 0 ELSE w END) OVER ({part}), 1) END AS share FROM f{depth})"""


ORACLE = f"""
WITH named AS (SELECT *, CASE WHEN regexp_matches(source, '^src[0-9]$') THEN 'web' WHEN regexp_matches(source, '^src1[0-9]$') THEN 'library' ELSE 'other' END AS _domain,
    coalesce(lang, '') AS _lang, coalesce(source, '') AS _source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS n FROM documents),
  leaves AS (SELECT _domain, _lang, _source, sum(n) AS tokens FROM named GROUP BY _domain, _lang, _source HAVING sum(n) > 0),
  {','.join(_level_sql(d) for d in range(3))},
  keyed AS (SELECT named.*, share // tokens AS whole, share % tokens AS rest, md5(concat('{SEED}:', CAST(CAST(share // tokens AS BIGINT) AS VARCHAR), ':', coalesce(CAST(doc_id AS VARCHAR), ''))) AS key
    FROM named JOIN leaves USING (_domain, _lang, _source) JOIN a2 USING (_domain, _lang, _source)),
  summed AS (SELECT *, sum(n) OVER (PARTITION BY _domain, _lang, _source ORDER BY key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM keyed)
SELECT doc_id, lang, source, n_chars, CAST(e.epoch AS INTEGER) AS epoch
FROM summed JOIN (SELECT unnest(range({EPOCHS + 1})) AS epoch) e ON e.epoch < whole + CASE WHEN upto <= rest THEN 1 ELSE 0 END
"""
