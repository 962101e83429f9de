"""Mixing sources to target weights by hierarchical budgeting, with DataFrame functions only.

A token budget flows down the tree domain - language - source. At every node it is split among the
children by weight; a child that cannot use its share (its tokens times ``max_epochs``) is filled,
and its shortage goes to its siblings by weight, before what a whole node cannot use goes to that
node's siblings. All arithmetic is on whole numbers. A leaf then takes its budget as a prefix of
seeded epochs: every epoch is an order of its documents by md5(seed, epoch, doc_id), whole epochs
come first, and the last one is cut where its running tokens pass the budget.

The order of a leaf is cut into buckets (prefixes of the hash, more for larger leaves), so that no
window ever holds a whole leaf: bucket sums first, then places inside a bucket.

Defined cases: null text has no tokens and is chosen with its place; null domain, language or source
form leaves named ``-``; a document without id is ordered by its empty string; repeated rows count
each; equal hashes are ordered by id and tokens; an empty table gives an empty result; other columns
are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tercet.llm.common import table, written

WORD = r"[^\x20\x09-\x0D]+"
SEED = "tercet-9"
MAX_EPOCHS = 2
#: Rows that a bucket holds on average, at most.
BUCKET_ROWS = 2048
#: Chosen ids that may be broadcast to fetch their documents; beyond it they are shuffled.
MAX_IDS = 1_000_000
LEAF = ["domain", "lang", "source"]

#: Target weights; names that are not listed weigh 1.
WEIGHTS = {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 6, "de": 2, "fr": 2}, "source": {}}


def weight(level: str, weights: dict[str, dict[str, int]]) -> Column:
    out = F.lit(1)
    for name, w in weights.get(level, {}).items():
        out = F.when(F.col(level) == name, w).otherwise(out)
    return out.cast("long")


def domain_of(source: Column) -> Column:
    """The domain of a source: its number modulo four."""
    return F.concat(F.lit("d"), F.coalesce(F.pmod(F.expr("try_cast(regexp_extract(source, '([0-9]+)$', 1) AS bigint)"), F.lit(4)).cast("string"), F.lit("-")))


def shared_out(children: DataFrame, parents: DataFrame | None, level: str, above: list[str], weights: dict, total: Column | None = None) -> DataFrame:
    """Split each parent's ``budget`` among ``children(above..., level, cap)``: adds ``budget``."""
    named = children.withColumn("w", weight(level, weights))
    held = named.join(parents.select(*above, "budget"), above) if above else named.withColumn("budget", total)
    group = Window.partitionBy(*above) if above else Window.partitionBy(F.lit(0))
    order = group.orderBy(F.col("cap") / F.col("w"), F.col(level))
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    step = held.withColumns({"pool": F.col("budget") - (F.sum("cap").over(upto) - F.col("cap")), "rest_w": F.sum("w").over(onward), "place": F.row_number().over(order)})
    step = step.withColumn("filled", F.col("cap") * F.col("rest_w") <= F.col("pool") * F.col("w"))
    first = F.min(F.when(~F.col("filled"), F.struct("place", "pool", "rest_w"))).over(group)
    return step.withColumn("first", first).select(
        *above, level, "cap",
        F.when(F.col("first").isNull() | (F.col("place") < F.col("first.place")), F.col("cap"))
        .otherwise(F.expr("first.pool * w div first.rest_w"))
        .alias("budget"),
    )


def leaf_budgets(leaves: DataFrame, budget: Column, max_epochs: int, weights: dict) -> DataFrame:
    """Budgets of ``leaves(domain, lang, source, tokens)``; one row per leaf, none per document."""
    capped = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    domains = shared_out(capped.groupBy("domain").agg(F.sum("cap").alias("cap")), None, "domain", [], weights, budget)
    langs = shared_out(capped.groupBy("domain", "lang").agg(F.sum("cap").alias("cap")), domains, "lang", ["domain"], weights)
    return shared_out(capped.select(*LEAF, "cap"), langs, "source", ["domain", "lang"], weights)


def mixed(docs: DataFrame, percent: int = 100, max_epochs: int = MAX_EPOCHS, seed: str = SEED, weights: dict | None = None) -> DataFrame:
    """Choose from ``docs(doc_id, domain, lang, source, tokens)``; the budget is ``percent`` of all tokens.

    One row per chosen document and epoch: doc_id, domain, lang, source, tokens, epoch, leaf_budget, start
    (tokens of the epoch before it). ``docs`` is read more than once: pass a written table.
    """
    weights = WEIGHTS if weights is None else weights
    leaves = docs.groupBy(*LEAF).agg(F.sum("tokens").cast("long").alias("tokens"), F.count("*").alias("rows"))
    total = leaves.agg((F.coalesce(F.sum("tokens"), F.lit(0)) * percent / 100).cast("long").alias("t")).first().t
    budgets = leaves.join(leaf_budgets(leaves, F.lit(total).cast("long"), max_epochs, weights).select(*LEAF, "budget"), LEAF)
    plan = budgets.select(
        *LEAF,
        F.col("budget").alias("leaf_budget"),
        F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(0).cast("int").alias("whole"),
        F.when(F.col("tokens") > 0, F.expr("budget % tokens")).otherwise(0).alias("remainder"),
        F.greatest(F.lit(1), F.ceil(F.log2(F.greatest(F.col("rows") / BUCKET_ROWS, F.lit(1.0))) / 4)).cast("int").alias("digits"),
    )
    marked = docs.join(F.broadcast(plan), LEAF) if plan_fits(leaves) else docs.join(plan, LEAF)
    keyed = marked.withColumn("h", F.md5(F.concat_ws("|", F.lit(seed), F.col("whole").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    keyed = keyed.withColumn("bucket", F.substr("h", F.lit(1), F.col("digits")))
    sums = keyed.groupBy(*LEAF, "bucket").agg(F.sum("tokens").alias("in_bucket"))
    before = sums.select(*LEAF, "bucket", (F.sum("in_bucket").over(Window.partitionBy(*LEAF).orderBy("bucket")) - F.col("in_bucket")).alias("before"))
    inside = Window.partitionBy(*LEAF, "bucket").orderBy("h", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = keyed.join(before, [*LEAF, "bucket"]).withColumn("upto", F.col("before") + F.sum("tokens").over(inside))
    # whole epochs hold every document; the epoch after them only its prefix
    epochs = F.concat(
        F.when(F.col("whole") > 0, F.sequence(F.lit(0), F.greatest(F.col("whole") - 1, F.lit(0)))).otherwise(F.array().cast("array<int>")),
        F.when(F.col("upto") <= F.col("remainder"), F.array("whole")).otherwise(F.array().cast("array<int>")),
    )
    return placed.select("doc_id", *LEAF, "tokens", "leaf_budget", F.explode(epochs).alias("epoch"), *[c for c in docs.columns if c.startswith("_keep_")])


def plan_fits(leaves: DataFrame, most: int = 20_000) -> bool:
    """Whether the plan has few enough rows to be broadcast (counted, not assumed)."""
    return len(leaves.limit(most + 1).select(F.lit(1)).collect()) <= most


def counted(docs: DataFrame, *more: Column) -> DataFrame:
    """Leaf columns and whole-text word counts of documents."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(domain_of(F.col("source")), F.lit("-")).alias("domain"),
        F.coalesce("lang", F.lit("-")).alias("lang"),
        F.coalesce("source", F.lit("-")).alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("tokens"),
        *more,
    )


def mixed_documents(docs: DataFrame, percent: int = 90, max_epochs: int = 1, weights: dict | None = None) -> DataFrame:
    """The documents that the mixture chooses, once for every epoch that holds them, with their own columns.

    Rows are numbered and written once, and chosen by that number: documents without a doc_id, or that share one, are chosen each
    by itself.
    """
    row = "_keep_row"
    while row in docs.columns:
        row += "_"
    held = written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    chosen = written(mixed(written(counted(held, F.col(row)), "counted"), percent, max_epochs, weights=weights).select(F.col(row).alias("__chosen"), "epoch"), "chosen")
    few = chosen.count() <= MAX_IDS
    return held.join(F.broadcast(chosen) if few else chosen, F.col(row) == F.col("__chosen")).select(*docs.columns)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = written(counted(table(spark, sf_dir, "documents")), "counted")
    return mixed(docs)


def _case(level: str) -> str:
    listed = " ".join(f"WHEN {level} = '{n}' THEN {w}" for n, w in WEIGHTS[level].items())
    return f"CASE {listed} ELSE 1 END" if listed else "1"


def _level_sql(name: str, source: str, level: str, above: list[str], parent: str | None) -> str:
    part = f"PARTITION BY {', '.join(above)} " if above else ""
    keys = ", ".join([*above, level])
    budget = "p.budget" if parent else "(SELECT t FROM total_)"
    join = f"JOIN {parent} p USING ({', '.join(above)})" if parent else ""
    return f"""
{name}_a AS (SELECT {keys}, CAST({_case(level)} AS HUGEINT) AS w, cap, {budget} AS b FROM (SELECT {keys}, CAST(sum(cap) AS HUGEINT) AS cap FROM leaves_ GROUP BY {keys}) c {join}),
{name}_b AS (SELECT *, b - (sum(cap) OVER (u ROWS UNBOUNDED PRECEDING) - cap) AS pool,
    sum(w) OVER (u ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_w, row_number() OVER u AS place
    FROM {name}_a WINDOW u AS ({part}ORDER BY CAST(cap AS DOUBLE) / CAST(w AS DOUBLE), {level})),
{name}_c AS (SELECT *, min(CASE WHEN NOT cap * rest_w <= pool * w THEN place END) OVER ({part}) AS first_place FROM {name}_b),
{name}_d AS (SELECT *, min(CASE WHEN place = first_place THEN pool END) OVER ({part}) AS first_pool, min(CASE WHEN place = first_place THEN rest_w END) OVER ({part}) AS first_w FROM {name}_c),
{name} AS (SELECT {keys}, CASE WHEN first_place IS NULL OR place < first_place THEN cap ELSE first_pool * w // first_w END AS budget FROM {name}_d)"""


ORACLE = f"""
WITH counted_ AS (
  SELECT doc_id, coalesce('d' || coalesce(CAST(TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT) % 4 AS VARCHAR), '-'), '-') AS domain,
    coalesce(lang, '-') AS lang, coalesce(source, '-') AS source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS tokens
  FROM documents),
leaves_ AS (SELECT domain, lang, source, CAST(sum(tokens) AS HUGEINT) AS tokens, CAST(sum(tokens) AS HUGEINT) * {MAX_EPOCHS} AS cap FROM counted_ GROUP BY ALL),
total_ AS (SELECT CAST(sum(tokens) AS HUGEINT) AS t FROM leaves_),{_level_sql("by_domain", "leaves_", "domain", [], None)},{_level_sql("by_lang", "leaves_", "lang", ["domain"], "by_domain")},{_level_sql("by_source", "leaves_", "source", ["domain", "lang"], "by_lang")},
plan_ AS (SELECT domain, lang, source, budget, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS whole, CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END AS remainder FROM leaves_ JOIN by_source USING (domain, lang, source)),
placed_ AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{SEED}|' || CAST(whole AS VARCHAR) || '|' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id, tokens ROWS UNBOUNDED PRECEDING) AS upto FROM counted_ JOIN plan_ USING (domain, lang, source)),
chosen_ AS (SELECT *, unnest(range(0, CAST(whole AS BIGINT) + CASE WHEN upto <= remainder THEN 1 ELSE 0 END)) AS epoch FROM placed_)
SELECT doc_id, domain, lang, source, tokens, CAST(budget AS BIGINT) AS leaf_budget, CAST(epoch AS INTEGER) AS epoch FROM chosen_
"""
