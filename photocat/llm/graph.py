"""Connected components, and groups cut into bounded blocks so that pairs inside them can be looked at in tasks."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photocat.llm.common import fixed


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable from each node of ``edges`` (a, b); single nodes are not listed.

    Each round links every node's larger neighbours, then its smaller ones, to the smallest of them, until all
    edges are stars: no node is both a root and below one, and none has two roots. Rounds are about the logarithm
    of the longest path; each one is written to the shared folder."""
    stars = fixed(edges.filter("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).distinct())
    for _ in range(max_rounds):
        both = stars.union(stars.select(F.col("root").alias("node"), F.col("node").alias("root")))
        lowest = both.groupBy("node").agg(F.min("root").alias("m")).select("node", F.least("node", "m").alias("m"))
        large = both.filter("root > node").join(lowest, "node").select(F.col("root").alias("node"), F.col("m").alias("root")).filter("node <> root").distinct()
        lowest = large.groupBy("node").agg(F.min("root").alias("m"))
        small = large.join(lowest, "node").select(F.col("root").alias("node"), F.col("m").alias("root")).union(lowest.select("node", F.col("m").alias("root")))
        stars = fixed(small.filter("node <> root").distinct())
        two = stars.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1").select("node")
        between = stars.select("node").join(stars.select(F.col("root").alias("node")), "node", "left_semi")
        if two.union(between).limit(1).count() == 0:
            return stars
    raise RuntimeError("components did not settle")


def in_blocks(rows: DataFrame, key: str, node: str, limit: int) -> DataFrame:
    """The rows of groups of two or more, in groups (``key``, p, q) of about twice ``limit`` rows at most.

    A group that is larger is dealt into blocks by a hash of ``node``, and each pair of blocks p <= q is a group. The
    pairs to look at in it are those with one row of block p and one of q (``block`` says which); together they are
    all pairs of the group, each once."""
    sizes = rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").withColumn("nb", F.ceil(F.col("n") / limit).cast("int"))
    out = rows.join(sizes.select(key, "nb"), key).withColumn("block", F.pmod(F.xxhash64(node), F.col("nb")).cast("int"))
    out = out.withColumn("other", F.explode(F.when(F.col("nb") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("nb") - 1))))
    return out.withColumns({"p": F.least("block", "other"), "q": F.greatest("block", "other")}).drop("nb", "other")


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows with those of equal keys next to each other in one partition, for ``sorted_groups``."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, *keys).sortWithinPartitions(*keys)


def sorted_groups(batches, keys):
    """(key, rows) for runs of equal keys in a sorted stream; only the last run of a batch is carried on."""
    carried = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if carried is None else pa.concat_tables([carried, t])
        if not t.num_rows:
            continue
        cols = [t.column(k).to_numpy() for k in keys]
        edge = np.flatnonzero(functools.reduce(np.logical_or, [c[1:] != c[:-1] for c in cols])) + 1
        bounds = [0, *edge.tolist()]
        for x, y in zip(bounds, bounds[1:], strict=False):
            if y - x > 1:
                yield tuple(c[x] for c in cols), t.slice(x, y - x)
        carried = t.slice(bounds[-1])
    if carried is not None and carried.num_rows > 1:
        yield tuple(carried.column(k)[0].as_py() for k in keys), carried
