"""Near-dedup of embeddings with a pivot-permutation index.

Reference points (pivots) are normal random vectors with a fixed seed, at most ``MAX_PIVOTS`` and about 2 sqrt(n). A
vector is described by its nearest pivots in their order, the first ``prefix`` places of its pivot permutation. The products of
two unit vectors with a pivot are normal and correlated by their cosine, so how likely a pair shares pivots depends on its
cosine and the number of pivots only, not on the other rows or the length (pivots taken from the data lie close together
inside a large group, and lose its links). There is one inverted list per pivot, of the vectors that have it in their prefix.
Inside a list (in blocks of bounded size) the pivots that each two vectors share are counted; pairs that share
``SHARED`` or more are verified by their exact cosine in double precision. A link counts in one list only, that of the shared
pivot that stands foremost in both permutations. A list gives one row per linked vector: its links and the smallest
vector it is connected with there. Pairs of vectors never become rows.

Equal vectors are one node with a weight, so a large group of copies costs one row. Every node is indexed. Two vectors
at the least cosine of 0.9 share two pivots in 95 % of cases at 2,048 pivots and more with fewer; from there on the list
grows by one with each doubling, up to 10 of 16,384 pivots, which keeps it at 95 %. Nearer vectors share more.

Vectors of different lengths never link; each length has its own pivots and lists.

Defined results: vectors that are null, zero, or hold null or non-finite components link with nothing; a null id is reported with its row and never names a
component that holds another id; repeated rows are vectors of their own, linked as copies; an empty table gives no
rows; further columns are left out.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photocat.llm.common import fixed, table
from photocat.llm.graph import components, dealt, in_blocks, sorted_groups

COSINE = 0.9
PREFIX = 7
#: Pivots that two vectors must share to be compared.
SHARED = 2
PIVOT_BITS = 14
MIN_PIVOTS, MAX_PIVOTS = 32, 1 << PIVOT_BITS
BLOCK = 512
#: Scalar products held at a time.
PRODUCTS = 1 << 22


def _vectors(batches, kind: str):
    """vec_id, the vector's bytes (null where it links with nothing) and its length."""
    for batch in batches:
        raw, size = [], []
        for v in batch.column("embedding").to_pylist():
            a = np.array(v, dtype=np.float64) if v and None not in v else np.zeros(0)
            good = len(a) and np.isfinite(a).all() and a.any()
            raw.append((a + 0.0).astype(kind).tobytes() if good else None)
            size.append(len(a) if good else None)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(raw, pa.binary()), pa.array(size, pa.int32())], names=["vec_id", "raw", "size"])


def unit(raw: list[bytes], kind: str) -> np.ndarray:
    """Rows of length one, in double precision."""
    a = np.frombuffer(b"".join(raw), dtype=kind).astype(np.float64).reshape(len(raw), -1)
    a = a / np.abs(a).max(axis=1, keepdims=True)  # squares of very large or small components stay finite
    return a / np.sqrt((a * a).sum(1, keepdims=True))


def prefix(m: int) -> int:
    """How many pivots of ``m`` describe a vector."""
    return min(m, PREFIX + max(0, (m - 1).bit_length() - 11))


def nearest(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The prefix of each vector's pivot permutation, nearest first."""
    k = prefix(len(pivots))
    rows = max(1, PRODUCTS // len(pivots))
    out = []
    for a in range(0, len(vectors), rows):
        product = -(vectors[a : a + rows] @ pivots.T)
        few = np.argpartition(product, k - 1, axis=1)[:, :k]
        out.append(np.take_along_axis(few, np.argsort(np.take_along_axis(product, few, axis=1), axis=1, kind="stable"), axis=1))
    return np.concatenate(out)


@functools.lru_cache(maxsize=2)
def random_pivots(m: int, size: int) -> np.ndarray:
    """The same in every task."""
    return np.random.default_rng(0).standard_normal((m, size))


def shared_counts(prefixes: np.ndarray) -> np.ndarray:
    """How many pivots each two prefixes share."""
    pivots, at = np.unique(prefixes, return_inverse=True)
    has = np.zeros((len(prefixes), len(pivots)), dtype=np.float32)
    np.put_along_axis(has, at.reshape(prefixes.shape), 1, axis=1)
    return has @ has.T


def foremost(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each two prefixes the shared pivot with the smallest sum of places (of equal ones the smaller pivot)."""
    place = np.arange(a.shape[1])
    score = (place[:, None] + place[None, :]).astype(np.int64) << PIVOT_BITS
    score = np.where(a[:, :, None] == b[:, None, :], score[None] + a[:, :, None], np.int64(1) << 62)
    return score.reshape(len(a), -1).min(1) & MAX_PIVOTS - 1


def linked(vectors: np.ndarray, block: np.ndarray, kind_of: np.ndarray, compare: np.ndarray, p: int, q: int) -> np.ndarray:
    """Which rows of block p are linked with which of block q (each pair in both directions), of the pairs whose kinds are
    to be compared."""
    near = np.zeros((len(vectors), len(vectors)), dtype=bool)
    for i in np.flatnonzero(block == p):
        other = compare[kind_of[i], kind_of] & (block == q)
        other[i] = False
        j = np.flatnonzero(other)
        j = j[vectors[j] @ vectors[i] >= COSINE]
        near[i, j] = near[j, i] = True
    return near


def smallest_reached(near: np.ndarray) -> np.ndarray:
    """Index of the first row that each row is connected with."""
    label = np.arange(len(near))
    while True:
        low = np.minimum(label, np.where(near, label[None, :], len(near)).min(1))
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _links(batches, kind: str):
    for (bucket, p, q), rows in sorted_groups(batches, ("bucket", "p", "q")):
        block = rows.column("block").to_numpy()
        prefixes = np.frombuffer(b"".join(rows.column("pivots").to_pylist()), dtype="<i4").reshape(rows.num_rows, -1)
        # rows of a large group often have equal prefixes
        kinds, of = np.unique(prefixes, axis=0, return_inverse=True)
        of = of.ravel()
        near = linked(unit(rows.column("raw").to_pylist(), kind), block, of, shared_counts(kinds) >= SHARED, p, q)
        some = np.flatnonzero(near.any(1))
        if not len(some):
            continue
        node = rows.column("node").to_pylist()
        order = np.array(sorted(some, key=lambda k: node[k]))
        near, of = near[np.ix_(order, order)], of[order]
        root = smallest_reached(near)
        meet = np.zeros((len(kinds), len(kinds)), dtype=bool)
        i, j = np.nonzero(near)
        meet[of[i], of[j]] = True
        i, j = np.nonzero(meet)
        meet[i, j] = foremost(kinds[i], kinds[j]) == (bucket & MAX_PIVOTS - 1)
        weight = rows.column("weight").to_numpy()[order]
        links = (near & meet[np.ix_(of, of)]).astype(np.int64) @ weight
        yield pa.RecordBatch.from_arrays([pa.array([node[k] for k in order], pa.binary()), pa.array([node[order[r]] for r in root], pa.binary()), pa.array(links)], names=["a", "b", "links"])


def near_duplicates(rows: DataFrame, vectors: str = "embedding", max_pivots: int = MAX_PIVOTS) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row."""
    kind = "<f4" if "float" in rows.schema[vectors].dataType.simpleString() else "<f8"
    v = fixed(rows.select("vec_id", F.col(vectors).alias("embedding")).mapInArrow(lambda b: _vectors(b, kind), "vec_id bigint, raw binary, size int"))
    v = v.withColumn("node", F.unhex(F.md5("raw")))
    nodes = fixed(v.filter("node is not null").groupBy("node").agg(F.any_value("raw").alias("raw"), F.any_value("size").alias("size"), F.count("*").alias("weight"), F.min("vec_id").alias("first_id")))
    pivots = {r[0]: min(max_pivots, max(MIN_PIVOTS, 2 * math.isqrt(r[1]))) for r in nodes.groupBy("size").count().collect()}

    def index(batches):
        for batch in batches:
            for size in pc.unique(batch.column("size")).to_pylist():
                part = batch.filter(pc.equal(batch.column("size"), size))
                top = nearest(unit(part.column("raw").to_pylist(), kind), random_pivots(pivots[size], size)).astype("<i4")
                keys = (np.int64(size) << PIVOT_BITS) + top  # the length, then the pivot
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("node", "raw", "weight")), pa.array([t.tobytes() for t in top], pa.binary()), pa.array(keys.tolist(), pa.list_(pa.int64()))], names=["node", "raw", "weight", "pivots", "buckets"])

    lists = nodes.select("node", "raw", "size", "weight").mapInArrow(index, "node binary, raw binary, weight bigint, pivots binary, buckets array<bigint>")
    lists = lists.select("node", "raw", "weight", "pivots", F.explode("buckets").alias("bucket"))
    found = fixed(dealt(in_blocks(lists, "bucket", "node", BLOCK), "bucket", "p", "q").mapInArrow(lambda b: _links(b, kind), "a binary, b binary, links bigint"))
    roots = components(found.select("a", "b"))
    links = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    named = nodes.select("node", "weight", "first_id").join(roots, "node", "left").join(links, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = named.join(smallest, "root").select("node", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = v.select("vec_id", "node").join(named, "node", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op2_embedding_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP2_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= {COSINE}
), reached AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b
), c AS (SELECT a, min(b) AS component_id FROM reached GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c ON a = vec_id
"""
