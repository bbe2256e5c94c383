"""Mixing sources to target weights by hierarchical budgeting.

Leaves are (domain, language, source). A token budget is handed down the tree by weight. A node that cannot use its
share (its leaves hold ``max_epochs`` times their tokens at most) leaves the rest to its siblings; only when all of
them are full does the rest go up to the parent's siblings. That is water filling with subtree capacities, done once
per level with windows over the children of a node. A leaf then takes whole epochs, and of the last one the prefix
of its documents in a seeded order that fits the rest.

The cut of a prefix is found without ordering a leaf's documents: tokens are summed per leaf and leading digits of
the order key (4,096 sums a leaf), the digit at which the budget runs out is refined the same way, and only the
documents that share all leading digits with the cut are ordered.

Defined results: a null domain, language or source is a leaf value of its own (written as the empty text); nodes that
no weight names have weight 1, weights are whole and at least 0, a weight of 0 takes nothing unless nothing else
is left; documents without tokens go with the prefix of their leaf; documents with the same id are taken or left together; a
null text has no tokens; an empty table gives no rows; further columns are kept by ``repeated``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photocat.llm.common import fixed, small_or_plain, table

#: Production parameters: weights of languages; the share of all tokens to hand out, in percent; repetitions of a leaf.
LANGUAGE_WEIGHTS = {"en": 4, "de": 2, "fr": 2, "es": 1}
BUDGET_PERCENT = 100
MAX_EPOCHS = 2
SEED = "mix-1"
DIGITS = 3
LEVELS = 2
LEAF = ["domain", "lang", "source"]


def n_tokens(text):
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t-\r]+")), F.lit(0)).cast("long")


def source_family(source):
    """The domain of a source: its last character (the test tables have no domain)."""
    return F.coalesce(F.right(source, F.lit(1)), F.lit(""))


def _key(seed: str, epoch):
    return F.md5(F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def _fill(nodes: DataFrame, parent: str, name: str) -> DataFrame:
    """``got`` for each child of a node from the node's ``budget``: shares by ``weight``, at most ``capacity``.
    In the order of capacity for the weight, a child is full if its share of what the children before it left
    reaches its capacity; the children that are not full share what the full ones leave."""
    of = f"partition by {parent}" if parent else ""
    order = f"{of} order by weight = 0, capacity / nullif(weight, 0), {name}"
    big = lambda x, digits: f"cast({x} as decimal({digits}, 0))"
    out = nodes.selectExpr(
        "*",
        f"budget - coalesce(sum(capacity) over ({order} rows between unbounded preceding and 1 preceding), 0) as left_over",
        f"sum(weight) over ({order} rows between current row and unbounded following) as open_weight",
    ).withColumn("full", F.expr(f"weight > 0 and {big('capacity', 19)} * {big('open_weight', 18)} <= {big('left_over', 19)} * {big('weight', 18)}"))
    out = out.withColumn("left_over", F.expr(f"budget - coalesce(sum(case when full then capacity end) over ({of}), 0)"))
    out = out.withColumn("open_weight", F.expr(f"sum(case when not full then weight end) over ({of})"))
    share = f"case when full then capacity when open_weight > 0 then cast({big('left_over', 19)} * {big('weight', 18)} div open_weight as bigint) else 0 end"
    return out.withColumn("got", F.expr(share)).drop("left_over", "open_weight", "full")


def _weighted(nodes: DataFrame, column: str, weights: dict[str, int] | None) -> DataFrame:
    cases = F.lit(1)
    for k, w in (weights or {}).items():
        cases = F.when(F.col(column) == k, w).otherwise(cases)
    return nodes.withColumn("weight", cases.cast("bigint"))


def allot(leaves: DataFrame, percent: int, max_epochs: int, weights: dict[str, dict[str, int]]) -> DataFrame:
    """(domain, lang, source, supply, got): the tokens each leaf is to give. ``weights``: by column and value."""
    up = leaves.withColumn("capacity", F.col("supply") * max_epochs)
    langs = up.groupBy("domain", "lang").agg(F.sum("capacity").alias("capacity"), F.sum("supply").alias("supply"))
    domains = langs.groupBy("domain").agg(F.sum("capacity").alias("capacity"), F.sum("supply").alias("supply"))
    domains = domains.withColumn("budget", F.expr(f"cast(cast(sum(supply) over () as decimal(19, 0)) * {int(percent)} div 100 as bigint)"))
    domains = _fill(_weighted(domains, "domain", weights.get("domain")), "", "domain")
    langs = langs.join(domains.select("domain", F.col("got").alias("budget")), "domain")
    langs = _fill(_weighted(langs, "lang", weights.get("lang")), "domain", "lang")
    up = up.join(langs.select("domain", "lang", F.col("got").alias("budget")), ["domain", "lang"])
    return _fill(_weighted(up, "source", weights.get("source")), "domain, lang", "source").select(*LEAF, "supply", "got")


def plan(docs: DataFrame, percent: int, max_epochs: int, weights: dict[str, dict[str, int]], seed: str) -> DataFrame:
    """(domain, lang, source, supply, got, epochs, last_key): a leaf's documents are taken ``epochs`` times, and once
    more where their key in the order of the following epoch is at most ``last_key``. ``docs``: doc_id, the leaf, n_tokens."""
    leaves = docs.groupBy(*LEAF).agg(F.sum("n_tokens").alias("supply"))
    leaves = fixed(allot(leaves, percent, max_epochs, weights).selectExpr("*", "coalesce(got div nullif(supply, 0), 0) as epochs").selectExpr("*", "got - epochs * supply as rest"))
    cut = leaves.select(*LEAF, "epochs", "rest", F.lit("").alias("prefix"))
    for level in range(1, LEVELS + 1):
        inside = docs.join(small_or_plain(cut), LEAF).withColumn("key", _key(seed, F.col("epochs"))).filter(F.col("key").startswith(F.col("prefix")))
        sums = inside.groupBy(*LEAF, "epochs", "rest", F.substring("key", 1, DIGITS * level).alias("prefix")).agg(F.sum("n_tokens").alias("n"))
        sums = sums.selectExpr("*", f"sum(n) over (partition by {', '.join(LEAF)} order by prefix) as upto").filter("upto > rest")
        sums = sums.groupBy(*LEAF, "epochs", "rest").agg(F.min_by(F.struct("prefix", (F.col("upto") - F.col("n")).alias("before")), "prefix").alias("b"))
        cut = fixed(sums.select(*LEAF, "epochs", (F.col("rest") - F.col("b.before")).alias("rest"), "b.prefix"))
    inside = docs.join(small_or_plain(cut), LEAF).withColumn("key", _key(seed, F.col("epochs"))).filter(F.col("key").startswith(F.col("prefix")))
    fits = inside.selectExpr("*", f"sum(n_tokens) over (partition by {', '.join(LEAF)} order by key) as upto").filter("upto <= rest").groupBy(*LEAF).agg(F.max("key").alias("last_key"))
    cut = cut.select(*LEAF, "prefix").join(fits, LEAF, "left").select(*LEAF, F.coalesce("last_key", "prefix").alias("last_key"))
    return fixed(leaves.join(cut, LEAF, "left").select(*LEAF, "supply", "got", "epochs", F.coalesce("last_key", F.lit("~")).alias("last_key")))


def _leaves(docs: DataFrame, domain) -> DataFrame:
    """The rows with their leaf and their tokens, in columns of their own beside ``row``."""
    return docs.select(
        F.struct("*").alias("row"), "doc_id", F.coalesce(domain, F.lit("")).alias("domain"), F.coalesce("lang", F.lit("")).alias("lang"),
        F.coalesce("source", F.lit("")).alias("source"), n_tokens(F.col("text")).alias("n_tokens"),
    )


def times(rows: DataFrame, budget: DataFrame, seed: str) -> DataFrame:
    """The rows with ``times``: how often each is taken."""
    joined = rows.join(small_or_plain(budget), LEAF)
    return joined.withColumn("times", F.col("epochs") + (_key(seed, F.col("epochs")) <= F.col("last_key")).cast("bigint"))


def mix(docs: DataFrame, domain=None, percent: int = BUDGET_PERCENT, max_epochs: int = MAX_EPOCHS, weights: dict[str, dict[str, int]] | None = None, seed: str = SEED) -> DataFrame:
    """One row per document with its leaf, its tokens and ``times``."""
    rows = fixed(_leaves(docs, source_family(F.col("source")) if domain is None else domain).drop("row"))
    budget = plan(rows, percent, max_epochs, {"lang": LANGUAGE_WEIGHTS} if weights is None else weights, seed)
    return times(rows, budget, seed).select("doc_id", *LEAF, "n_tokens", "got", "times")


def repeated(docs: DataFrame, domain=None, percent: int = BUDGET_PERCENT, max_epochs: int = MAX_EPOCHS, weights: dict[str, dict[str, int]] | None = None, seed: str = SEED) -> DataFrame:
    """The documents as often as they are taken, with their columns."""
    rows = _leaves(docs, source_family(F.col("source")) if domain is None else domain)
    budget = plan(fixed(rows.drop("row")), percent, max_epochs, {"lang": LANGUAGE_WEIGHTS} if weights is None else weights, seed)
    return times(rows, budget, seed).filter("times > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document enters the mix."""
    return mix(table(spark, sf_dir, "documents"))


def sql(percent: int = BUDGET_PERCENT, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> str:
    """The same rows in DuckDB, with the default domain and weights and each leaf's documents fully ordered."""

    def fill(nodes: str, parent: str, name: str, weight: str) -> str:
        of = f"PARTITION BY {parent}" if parent else ""
        order = f"{of} ORDER BY weight = 0, capacity / nullif(weight, 0) NULLS FIRST, {name}"
        return f"""(
      SELECT *, CASE WHEN is_full THEN capacity WHEN open_weight > 0 THEN (left_over::HUGEINT * weight) // open_weight ELSE 0 END AS got FROM (
        SELECT * EXCLUDE (left_over, open_weight), budget - coalesce(sum(CASE WHEN is_full THEN capacity END) OVER ({of}), 0) AS left_over,
               sum(CASE WHEN NOT is_full THEN weight END) OVER ({of}) AS open_weight FROM (
          SELECT *, weight > 0 AND capacity::HUGEINT * open_weight <= left_over::HUGEINT * weight AS is_full FROM (
            SELECT *, budget - coalesce(sum(capacity) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_over,
                   sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight
            FROM (SELECT *, {weight} AS weight FROM {nodes})))))"""

    langs = "CASE lang " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in LANGUAGE_WEIGHTS.items()) + " ELSE 1 END"
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(right(source, 1), '') AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         coalesce(len(regexp_extract_all(text, '[^ \t-\r]+')), 0) AS n_tokens FROM documents
), leaves AS (
  SELECT domain, lang, source, sum(n_tokens)::BIGINT AS supply, (sum(n_tokens) * {max_epochs})::BIGINT AS capacity FROM d GROUP BY ALL
), lang0 AS (
  SELECT domain, lang, sum(capacity)::BIGINT AS capacity, sum(supply)::BIGINT AS supply FROM leaves GROUP BY ALL
), domain0 AS (
  SELECT domain, sum(capacity)::BIGINT AS capacity, (SELECT sum(supply) * {percent} // 100 FROM lang0)::BIGINT AS budget FROM lang0 GROUP BY ALL
), domain1 AS (SELECT * FROM {fill("domain0", "", "domain", "1")}),
lang1 AS (SELECT * FROM {fill("(SELECT l.domain, l.lang, l.capacity, p.got::BIGINT AS budget FROM lang0 l JOIN domain1 p USING (domain))", "domain", "lang", langs)}),
leaf1 AS (SELECT * FROM {fill("(SELECT l.*, p.got::BIGINT AS budget FROM leaves l JOIN lang1 p USING (domain, lang))", "domain, lang", "source", "1")}),
budget AS (
  SELECT domain, lang, source, got::BIGINT AS got, coalesce(got // nullif(supply, 0), 0)::BIGINT AS epochs, (got - coalesce(got // nullif(supply, 0), 0) * supply)::BIGINT AS rest FROM leaf1
), keyed AS (
  SELECT *, md5('{seed}:' || epochs || ':' || coalesce(doc_id::VARCHAR, '')) AS k FROM d JOIN budget USING (domain, lang, source)
)
SELECT doc_id, domain, lang, source, n_tokens, got,
       epochs + (sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY k) <= rest)::BIGINT AS times
FROM keyed
"""
