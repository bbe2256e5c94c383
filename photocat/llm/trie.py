"""Prefix trie of conversations: which openings they share, how many go on from each, and the text that sharing saves.

Fixed-length block hashing. A turn's key at its place is a pair of 64-bit hashes of (place, SHA-256 of role and text); the
key of a prefix is the exclusive or of its turns' keys, so a block of BLOCK_TURNS turns adds one value, whatever block it is.
Conversations are grouped by their block keys first: one row for each distinct block after a distinct prefix, with its
members counted. Only where a prefix is followed by several different blocks are their turns laid out and grouped again to
find the turn at which they part; a block without siblings gives its turns as they are.

Sums over subtrees need no walk down the tree: each childless node's path is the path of one of its conversations, each
node is owned by the smallest such path through it, and what a path owns is summed from its end; adding up the paths at a
node gives its subtree. All paths together have no more rows than the conversations have turns.

Uneven groups: positions, prefix keys, path sums and look-ups of a node's parent are scans of ranges (``ordered_scan``), so one
conversation or node may hold a large share of all rows; everything else is an aggregate that combines before the
shuffle. The ids of the conversations that end at a node are joined in runs of at most RUN ids each; only the hash over
a node's runs is taken in one task, as a stream, since SHA-256 has an order.

Defined results: rows without a conversation id belong to no conversation; null roles and texts are empty; turns are in the
order of ``turn``, null first, equal ones in the order of their digests (repeated rows are turns of their own); a conversation
left without turns is a member of the root alone; an empty table has no nodes, not even a root; texts of any length are
hashed whole; further columns are ignored, whatever their names. Two different prefixes share a key with a chance of 2 ** -128
a pair, unless someone sets out to make them.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photocat.functions.groups import Running, ordered_positions, ordered_scan
from photocat.llm.common import crc32_sql, fixed, table

BLOCK_TURNS = 4
#: Conversations are rebuilt from those of their family's first.
FAMILY = 100
MAX_HEAD = 6
#: 2 ** RUN_BITS neighbouring ids are joined in one text.
RUN_BITS = 12

NODE = ["a", "b"]  # the key of a prefix; the root's is (0, 0)


def _root() -> dict:
    return {c: F.lit(0).cast("long") for c in NODE}


def digests(turns: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), said (digest of role and text), n_chars."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    said = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", said.alias("said"), F.char_length(text).cast("long").alias("n_chars"))
    return ordered_positions(rows, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("said")], "pos").drop("turn")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations, their rebuilt turns) of ``digests``: a conversation begins with the first turns of its family's first one."""
    heads = F.expr(f"cast(pmod(crc32(cast(cast(conv_id as string) as binary)), {MAX_HEAD}) as long)")
    base = F.expr(f"conv_id - conv_id % {FAMILY}")
    convs = fixed(turns.groupBy("conv_id").agg(F.count("*").alias("n")).withColumns({"head": heads, "base": base}))
    # at most MAX_HEAD - 1 turns of a conversation are handed to its family
    first = turns.where(F.col("pos") < MAX_HEAD).where(F.col("conv_id") % FAMILY == 0)
    lent = convs.select(F.col("conv_id").alias("to"), "head", F.col("base").alias("conv_id")).join(first, "conv_id").where("pos <= head")
    lent = lent.select(F.col("to").alias("conv_id"), "pos", "said", "n_chars")
    # where the base has fewer turns than asked for, or is absent, the conversation's own turns move up
    have = convs.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("base"), F.least("n", F.lit(MAX_HEAD - 1)).alias("have"))
    short = convs.join(have, "base", "left").withColumn("taken", F.least("head", F.coalesce("have", F.lit(0).cast("long"))))
    short = short.where("taken < head").select("conv_id", (F.col("head") - F.col("taken")).alias("gap"))
    own = turns.withColumn("head", heads).where("pos > head").drop("head")
    return convs.select("conv_id"), lent.union(looked_up(own, short, ["conv_id"], "gap").select("conv_id", (F.col("pos") - F.coalesce("gap", F.lit(0))).alias("pos"), "said", "n_chars"))


def looked_up(rows: DataFrame, values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``rows`` with the ``value`` (a number) that ``values`` has for their keys, or null. Rows of one key lie in as many
    ranges as they fill, with the value's row before them."""
    told = values.select(*keys, value, F.lit(0).alias("_own"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema if f.name not in keys])
    both = rows.withColumns({value: F.lit(None).cast("long"), "_own": F.lit(1)}).withColumn("_tie", F.xxhash64(*[c for c in rows.columns if c not in keys]))
    both = both.unionByName(told.withColumn("_tie", F.lit(0).cast("long")))
    carried = ordered_scan(both, keys, [F.col("_own"), F.col("_tie")], running={"_value": Running(value, "max")})
    return carried.where("_own = 1").select(*rows.columns, F.col("_value").alias(value))


def blocks_of(turns: DataFrame) -> DataFrame:
    """conv_id, block (from 0), the prefix's key before it (pa, pb) and after it (a, b), its turns in order (a, b, n_chars)."""
    key = lambda seed: F.xxhash64(F.lit(seed), "pos", "said")
    turn = turns.select("conv_id", F.expr(f"(pos - 1) div {BLOCK_TURNS}").alias("block"), "pos", key("a").alias("a"), key("b").alias("b"), "n_chars")
    rows = turn.groupBy("conv_id", "block").agg(F.bit_xor("a").alias("xa"), F.bit_xor("b").alias("xb"), F.array_sort(F.collect_list(F.struct("pos", "a", "b", "n_chars"))).alias("turns"))
    scan = ordered_scan(rows, ["conv_id"], [F.col("block")], running={"a": Running("xa", "bit_xor"), "b": Running("xb", "bit_xor")})
    return scan.select("conv_id", "block", F.expr("a ^ xa").alias("pa"), F.expr("b ^ xb").alias("pb"), "a", "b", "turns")


def _turn_prefixes(blocks: DataFrame, *keep: str) -> DataFrame:
    """A row for each turn of a block: depth, the key of the prefix with it (a, b) and without it (pa, pb), n_chars."""
    upto = lambda c: f"aggregate(slice(turns, 1, i + 1), p{c}, (s, t) -> s ^ t.{c})"
    step = F.expr(f"transform(turns, (t, i) -> struct(t.pos as depth, {upto('a')} as a, {upto('b')} as b, t.a as xa, t.b as xb, t.n_chars as n_chars))")
    rows = blocks.select(*keep, "pa", "pb", F.explode(step).alias("t"))
    return rows.select(*keep, "t.depth", "t.a", "t.b", F.expr("t.a ^ t.xa").alias("pa"), F.expr("t.b ^ t.xb").alias("pb"), "t.n_chars")


def nodes_of(blocks: DataFrame) -> DataFrame:
    """depth, key (a, b), parent's key (pa, pb), conv_id (smallest member), n_convs, n_chars, of all prefixes but the empty one."""
    distinct = fixed(blocks.groupBy("block", "pa", "pb", *NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.any_value("turns").alias("turns")))
    forks = distinct.groupBy("block", "pa", "pb").agg(F.count("*").alias("siblings")).where("siblings > 1")
    marked = fixed(looked_up(distinct, forks, ["block", "pa", "pb"], "siblings"))
    plain = _turn_prefixes(marked.where("siblings is null"), "conv_id", "n_convs")
    parted = _turn_prefixes(marked.where("siblings is not null"), "conv_id", "n_convs")
    parted = parted.groupBy("depth", *NODE, "pa", "pb").agg(F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.any_value("n_chars").alias("n_chars"))
    return plain.unionByName(parted)


def ends(convs: DataFrame, blocks: DataFrame) -> DataFrame:
    """conv_id and the key of its whole sequence; the root's for one without turns."""
    last = blocks.groupBy("conv_id").agg(F.max_by(F.struct("a", "b"), "block").alias("k")).select("conv_id", "k.a", "k.b")
    return last.union(convs.join(last, "conv_id", "left_anti").withColumns(_root()))


def _hash_runs(batches):
    """Rows (a, b, run, ids) sorted by key and run: one hash for each key."""
    held, state = None, None
    for batch in batches:
        out = []
        for a, b, ids in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "ids")), strict=True):
            if held != (a, b):
                if held is not None:
                    out.append((*held, state.hexdigest()))
                held, state = (a, b), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["a", "b", "ends_sha256"])
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*held, state.hexdigest())], names=["a", "b", "ends_sha256"])


def end_hashes(last: DataFrame) -> DataFrame:
    """a, b, ends_sha256: the hash of the ids that end at a node, ascending and joined by commas."""
    runs = last.groupBy(*NODE, F.shiftright("conv_id", RUN_BITS).alias("run")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    n = int(last.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return runs.repartition(n, *NODE).sortWithinPartitions(*NODE, "run").mapInArrow(_hash_runs, "a long, b long, ends_sha256 string")


def trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """One row per node: its key (a, b), its parent's (pa, pb; null at the root), depth, conv_id, parent_conv_id, n_convs,
    n_children, n_leaves, saved_chars, ends_sha256. ``convs``: conv_id; ``turns``: conv_id, pos (1, 2, ...), said, n_chars."""
    convs, blocks = fixed(convs), fixed(blocks_of(turns))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.withColumns(_root() | {"depth": F.lit(0).cast("long"), "pa": F.lit(None).cast("long"), "pb": F.lit(None).cast("long"), "n_chars": F.lit(0).cast("long")})
    nodes = fixed(nodes_of(blocks).unionByName(root))

    children = fixed(nodes.where("pa is not null").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("n_children")))
    childless = nodes.join(children, NODE, "left_anti").select("conv_id")  # all members of such a node end there
    paths = _turn_prefixes(blocks.join(childless, "conv_id", "left_semi"), "conv_id").select("conv_id", "depth", *NODE)
    paths = fixed(paths.unionByName(childless.withColumns(_root() | {"depth": F.lit(0).cast("long")})))

    owner = paths.groupBy(*NODE).agg(F.min("conv_id").alias("owner"))
    owned = nodes.join(owner, NODE).select(F.col("owner").alias("conv_id"), "depth", ((F.col("n_convs") - 1) * F.col("n_chars")).alias("saved"))
    worth = paths.join(owned, ["conv_id", "depth"], "left").withColumn("saved", F.coalesce("saved", F.lit(0).cast("long")))
    worth = ordered_scan(worth, ["conv_id"], [-F.col("depth")], running={"below": "saved"})
    sums = worth.groupBy(*NODE).agg(F.count("*").alias("n_leaves"), F.sum("below").alias("saved_chars"))

    parents = nodes.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id")).join(children.select(F.col("a").alias("pa"), F.col("b").alias("pb")), ["pa", "pb"], "left_semi")
    found = looked_up(nodes.where("pa is not null").drop("n_chars"), parents, ["pa", "pb"], "parent_conv_id")
    found = found.unionByName(nodes.where("pa is null").drop("n_chars").withColumn("parent_conv_id", F.lit(None).cast("long")))
    out = found.join(children, NODE, "left").join(sums, NODE).join(end_hashes(ends(convs, blocks)), NODE, "left")
    zero = F.lit(0).cast("long")
    return out.withColumns({"n_children": F.coalesce("n_children", zero), "ends_sha256": F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest()))})


def last_turns(nodes: DataFrame, turns: DataFrame) -> DataFrame:
    """The nodes of ``trie`` with the turn that each one adds, from the turns (conv_id, pos, and whatever else) it was built of."""
    return nodes.join(turns.withColumnRenamed("pos", "depth"), ["conv_id", "depth"], "left")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations."""
    nodes = trie(*rebuilt(fixed(digests(table(spark, sf_dir, "conversations")))))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved_chars").alias("saved_tokens"), "ends_sha256")


def sql() -> str:
    """The same rows in DuckDB, from the full list of turns of every prefix."""
    said = "sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))"
    return f"""
WITH t AS (
  SELECT conv_id, {said} AS said, length(coalesce(text, '')) AS n_chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, {said}) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, conv_id - conv_id % {FAMILY} AS base, {crc32_sql("conv_id::VARCHAR")} % {MAX_HEAD} AS h FROM (SELECT DISTINCT conv_id FROM t)
), moved AS (
  SELECT c.conv_id, 0 AS part, t.pos, t.said, t.n_chars FROM c JOIN t ON t.conv_id = c.base AND t.pos <= c.h
  UNION ALL SELECT c.conv_id, 1, t.pos, t.said, t.n_chars FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h
), convs AS (
  SELECT c.conv_id, coalesce(list(row(m.said, m.n_chars) ORDER BY part, pos) FILTER (m.said IS NOT NULL), []) AS turns FROM c LEFT JOIN moved m USING (conv_id) GROUP BY c.conv_id
), prefixes AS (
  SELECT conv_id, d AS depth, len(turns) = d AS whole, array_to_string(list_transform(turns[1:d], lambda x: x[1]), ',') AS k,
         CASE WHEN d > 0 THEN array_to_string(list_transform(turns[1:d - 1], lambda x: x[1]), ',') END AS up, CASE WHEN d > 0 THEN turns[d][2] ELSE 0 END AS n_chars
  FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM convs)
), nodes AS (
  SELECT k, any_value(depth) AS depth, any_value(up) AS up, any_value(n_chars) AS n_chars, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (whole), '')) AS ends_sha256 FROM prefixes GROUP BY k
), full_nodes AS (
  SELECT n.*, (SELECT count(*) FROM nodes c WHERE c.up = n.k) AS n_children FROM nodes n
), under AS (
  SELECT p.k AS top, n.n_children = 0 AS leaf, (n.n_convs - 1) * n.n_chars AS saved FROM full_nodes n JOIN prefixes p ON p.conv_id = n.conv_id AND p.depth <= n.depth
), sums AS (
  SELECT top, count(*) FILTER (leaf) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM under GROUP BY top
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM full_nodes n JOIN sums s ON s.top = n.k LEFT JOIN nodes p ON p.k = n.up
"""
