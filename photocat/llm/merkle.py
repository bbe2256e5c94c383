"""Merkle manifest of a dataset: each row's digest, a tree per language over them, a tree over the languages, and a proof
for each row that its digest belongs to the root.

Cogrouped subtree exchange. A language's leaves are numbered by ``doc_id`` (``ordered_positions``: ranges, no task holds a
language) and dealt into superblocks of 2 ** BLOCK_LEVELS. Upwards, each superblock is reduced to one node, the nodes of
all superblocks are numbered leaves of the next round, and so on to the language's subroot; the subroots go the same way
to the root. Downwards, the nodes of a superblock are cogrouped with the outer nodes it needs (the siblings on the way
from the superblock's top to the root, at most about 60 rows): one task call rebuilds the subtree below, joins each
row's inner proof to the outer one and folds it. Rounds are the logarithm of the rows to the base 2 ** BLOCK_LEVELS (2 at a
million rows, 3 at a hundred billion); nothing but the largest count comes to the driver.

Defined results: a null column is ``-`` in the leaf; null languages are a language of their own before all others; null
ids stand first in their language, rows of equal id follow each other by their leaf, and equal rows are leaves of their
own with proofs of their own; empty and very long texts are hashed like others; a tree of one leaf is that leaf, with an
empty proof; an empty table gives no rows; ``n_chars`` may be any long (a tampered one is raised without overflow); further
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photocat.functions.groups import ordered_positions
from photocat.llm.common import crc32_sql, fixed, small_or_plain, table

#: A superblock has 2 ** BLOCK_LEVELS leaves.
BLOCK_LEVELS = 12
#: The columns that make up a leaf, in this order.
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]

NODES = "tree string, at long, digest string"
STEPS = "tree string, at long, step int, side string, digest string"
PROOFS = "tree string, at long, leaf string, subroot string, root string, proof_sha256 string, folded_root string"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _written(column):
    """A value as the leaf has it: its bytes counted and written out, ``-`` for null."""
    text = column.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaves(docs: DataFrame, n_chars=None) -> DataFrame:
    """doc_id, ``tree`` (the language; sorts bytewise, null first), ``leaf``, and ``other``: the leaf with ``n_chars`` in its
    place where that is not null."""
    of = lambda chars: F.sha2(F.concat(*[_written(chars if c == "n_chars" else F.col(c)) for c in FIELDS]), 256)
    n_chars = F.lit(None).cast("string") if n_chars is None else n_chars
    tree = F.when(F.col("lang").isNull(), "").otherwise(F.concat(F.lit("="), F.col("lang").cast("string")))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), tree.alias("tree"), of(F.col("n_chars")).alias("leaf"), F.when(n_chars.isNotNull(), of(n_chars)).alias("other"))


def tampered_chars():
    """``n_chars`` raised by one where 7 divides the id's checksum; null elsewhere and where there is no number."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return F.when(hit, (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string"))


def levels_above(digests: list[str], levels: int | None) -> list[list[str]]:
    """The nodes of each level over ``digests``: so many levels, or up to a single node."""
    out = [digests]
    while len(out[-1]) > 1 if levels is None else len(out) <= levels:
        below = out[-1]
        out.append([digest("".join(below[k : k + 2])) for k in range(0, len(below), 2)])
    return out


def inner_steps(levels: list[list[str]], k: int) -> list[tuple[str, str]]:
    """(side of the sibling, its digest) on each level from node ``k``; a node without a sibling has neither."""
    out = []
    for nodes in levels[:-1]:
        beside = k ^ 1
        out.append(("left" if beside < k else "right", nodes[beside]) if beside < len(nodes) else ("", ""))
        k >>= 1
    return out


def fold(node: str, steps) -> str:
    for side, other in steps:
        node = digest(other + node if side == "left" else node + other)
    return node


def _subtree(rows: pd.DataFrame) -> list[list[str]]:
    """The levels over a superblock's nodes, which are in order."""
    return levels_above(rows["digest"].tolist(), None if rows["alone"].iloc[0] else int(rows["height"].iloc[0]))


def _reduce(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("at")
    top = _subtree(rows)[-1][0]
    return pd.DataFrame({"tree": [rows["tree"].iloc[0]], "at": [rows["block"].iloc[0]], "digest": [top]})


def _outer(steps: pd.DataFrame) -> list[tuple[str, str]]:
    steps = steps.sort_values("step")
    return list(zip(steps["side"], steps["digest"], strict=True))


def _pass_down(rows: pd.DataFrame, steps: pd.DataFrame) -> pd.DataFrame:
    """Steps to the root for every node of a superblock. Sides ``subroot`` and ``root`` mark the tops; they are no siblings."""
    if rows.empty:
        return pd.DataFrame(columns=["tree", "at", "step", "side", "digest"])
    rows = rows.sort_values("at")
    levels = _subtree(rows)
    outer = _outer(steps)
    out = []
    for k, (tree, at) in enumerate(zip(rows["tree"], rows["at"], strict=True)):
        out += [(tree, at, n, *step) for n, step in enumerate(inner_steps(levels, k) + outer)]
    return pd.DataFrame(out, columns=["tree", "at", "step", "side", "digest"])


def _prove(rows: pd.DataFrame, steps: pd.DataFrame) -> pd.DataFrame:
    """Subtree, proof and folded root for every leaf of a superblock. The outer steps begin with the rest of the way to the
    language's subroot and end with the root."""
    names = ["tree", "at", "leaf", "subroot", "root", "proof_sha256", "folded_root"]
    if rows.empty:
        return pd.DataFrame(columns=names)
    rows = rows.sort_values("at")
    levels = _subtree(rows)
    outer = _outer(steps)
    root = outer[-1][1]
    subroot = next(d for side, d in outer if side == "subroot")
    outer = [s for s in outer if s[0] not in ("subroot", "root")]
    tail = "".join(d for _, d in outer)
    out = []
    for k, (tree, at, leaf, other) in enumerate(rows[["tree", "at", "digest", "other"]].itertuples(index=False, name=None)):
        inner = inner_steps(levels, k)
        folded = fold(leaf if other is None else other, inner + outer)
        out.append((tree, at, leaf, subroot, root, digest("".join(d for _, d in inner) + tail), folded))
    return pd.DataFrame(out, columns=names)


def _numbered(rows: DataFrame, order) -> DataFrame:
    return ordered_positions(rows, ["tree"], order, "at").withColumn("at", F.col("at") - 1)


def _blocks(nodes: DataFrame, sizes: DataFrame, height: int, levels: int) -> DataFrame:
    """``block`` of each node, the levels to climb in it, and whether its tree has no other block. ``sizes``: tree, n leaves;
    ``height``: rounds of superblocks below these nodes."""
    joined = nodes.join(sizes, "tree").withColumns({"block": F.shiftright("at", levels), "height": F.lit(levels)})
    return joined.withColumn("alone", F.col("n") <= 1 << levels * (height + 1)).drop("n")


def _climb(nodes: DataFrame, sizes: DataFrame, most: int, levels: int) -> list[DataFrame]:
    """The numbered nodes of each round (tree, at, digest), the trees' tops last."""
    rounds, height = [nodes.select("tree", "at", "digest")], 0
    while height == 0 or most > 1 << levels * height:
        grouped = _blocks(rounds[-1], sizes, height, levels).groupBy("tree", "block")
        rounds.append(fixed(grouped.applyInPandas(_reduce, NODES)))
        height += 1
    return rounds


def _descend(rounds: list[DataFrame], sizes: DataFrame, outer: DataFrame, end: int, levels: int) -> DataFrame:
    """Steps to the root for the nodes of round ``end``; ``outer`` has those of the trees' tops."""
    for height in range(len(rounds) - 2, end - 1, -1):
        below = _blocks(rounds[height], sizes, height, levels).groupBy("tree", "block")
        outer = below.cogroup(outer.withColumnRenamed("at", "block").groupBy("tree", "block")).applyInPandas(_pass_down, STEPS)
    return outer


def manifest(rows: DataFrame, levels: int = BLOCK_LEVELS) -> DataFrame:
    """Proofs for ``rows`` (doc_id, tree, leaf, other): doc_id, leaf, subroot, root, proof_sha256, folded_root, where ``other``
    takes the leaf's place in folding if it is not null. Superblocks have 2 ** ``levels`` leaves."""
    numbered = fixed(_numbered(rows, [F.col("doc_id").asc_nulls_first(), F.col("leaf")]).withColumnRenamed("leaf", "digest"))
    counts = fixed(numbered.groupBy("tree").agg(F.count("*").alias("n")))
    sizes = small_or_plain(counts)  # a row per language
    most = counts.agg(F.max("n")).first()[0] or 0
    languages = _climb(numbered, sizes, most, levels)

    # the tree over the subroots: one tree, numbered by language
    top = languages[-1].select(F.lit("").alias("tree"), F.col("tree").alias("of"), "digest")
    top = fixed(_numbered(top, [F.col("of")]))
    count = counts.agg(F.count("*").alias("n")).select(F.lit("").alias("tree"), "n")
    whole = _climb(top, count, top.count(), levels)
    root = whole[-1].select("tree", "at", F.lit(0).alias("step"), F.lit("root").alias("side"), "digest")
    above = _descend(whole, count, root, 0, levels)
    own = top.select("tree", "at", "of", F.col("digest").alias("subroot"))
    above = above.join(own, ["tree", "at"]).select(F.col("of").alias("tree"), F.lit(0).cast("long").alias("at"), (F.col("step") + 1).alias("step"), "side", "digest")
    start = own.select(F.col("of").alias("tree"), F.lit(0).cast("long").alias("at"), F.lit(0).alias("step"), F.lit("subroot").alias("side"), F.col("subroot").alias("digest"))

    outer = fixed(_descend(languages, sizes, start.union(above), 1, levels))
    below = _blocks(numbered, sizes, 0, levels).groupBy("tree", "block")
    proofs = below.cogroup(outer.withColumnRenamed("at", "block").groupBy("tree", "block")).applyInPandas(_prove, PROOFS)
    return numbered.select("tree", "at", "doc_id").join(proofs, ["tree", "at"]).drop("tree", "at")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's leaf, proof and root, folded from a tampered leaf for about every seventh."""
    proofs = manifest(leaves(table(spark, sf_dir, "documents"), tampered_chars()))
    return proofs.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def sql() -> str:
    """The same rows in DuckDB, a recursion step per level of the trees."""
    written = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"
    leaf = lambda chars: "sha256(" + " || ".join(written(chars if c == "n_chars" else c) for c in FIELDS) + ")"

    def tree(name: str, base: str) -> str:
        """Levels of trees: grp, lvl, k, n (nodes of the level), d."""
        return f"""{name} AS (
  WITH RECURSIVE up AS (
    SELECT grp, 0 AS lvl, k, n, d FROM {base}
    UNION ALL
    SELECT grp, lvl + 1, k // 2, any_value((n + 1) // 2), sha256(string_agg(d, '' ORDER BY k)) FROM up WHERE n > 1 GROUP BY grp, lvl, k // 2
  ) SELECT * FROM up)"""

    return f"""
WITH l AS (
  SELECT doc_id, lang, {leaf("n_chars")} AS leaf,
         CASE WHEN {crc32_sql("doc_id::VARCHAR")} % 7 = 0 AND n_chars IS NOT NULL THEN {leaf("(n_chars::HUGEINT + 1)")} END AS other FROM documents
), base AS (
  SELECT doc_id, leaf, other, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS grp, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS k,
         count(*) OVER (PARTITION BY lang) AS n, leaf AS d FROM l
), {tree("low", "base")}, subroots AS (
  SELECT 0 AS grp, grp AS k, count(*) OVER () AS n, d FROM low WHERE n = 1
), {tree("high", "subroots")}, steps AS (
  SELECT b.grp, b.k, p.lvl, p.k & 1 AS odd, s.d FROM base b JOIN low p ON p.grp = b.grp AND p.k = b.k >> p.lvl AND p.n > 1
    LEFT JOIN low s ON s.grp = p.grp AND s.lvl = p.lvl AND s.k = xor(p.k, 1)
  UNION ALL
  SELECT b.grp, b.k, 1000 + p.lvl, p.k & 1, s.d FROM base b JOIN high p ON p.k = b.grp >> p.lvl AND p.n > 1
    LEFT JOIN high s ON s.lvl = p.lvl AND s.k = xor(p.k, 1)
), ways AS (
  SELECT grp, k, list(row(odd, coalesce(d, '')) ORDER BY lvl) AS way, string_agg(coalesce(d, ''), '' ORDER BY lvl) AS others FROM steps GROUP BY grp, k
), folded AS (
  SELECT b.*, coalesce(others, '') AS others,
         list_reduce(list_prepend(row(0, coalesce(other, leaf)), coalesce(way, [])), lambda a, s: row(0, CASE WHEN s[1] = 1 THEN sha256(s[2] || a[2]) ELSE sha256(a[2] || s[2]) END))[2] AS folded_root
  FROM base b LEFT JOIN ways USING (grp, k)
)
SELECT doc_id, leaf, (SELECT any_value(s.d) FROM subroots s WHERE s.k = folded.grp) AS subroot, (SELECT d FROM high WHERE n = 1) AS root,
       sha256(others) AS proof_sha256, folded_root, folded_root = (SELECT d FROM high WHERE n = 1) AS verified FROM folded
"""
