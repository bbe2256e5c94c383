"""Near-dedup of documents by Order MinHash.

A text is the sequence of its runs of five words, each labelled with how often it stood earlier (so labelled runs are
all different). For each of ``SKETCHES`` random orders the ``TUPLE`` smallest labelled runs are taken in the order in
which they stand in the text; equal tuples make two texts candidates. Reordered texts do not agree, unlike with plain
MinHash. Candidates are verified by an alignment of the two sequences within a band: the alignment score is the number
of labelled runs that can be matched in order, and two texts are near copies if matched / (n1 + n2 - matched) is 0.8
or more. Since labelled runs are different, the longest alignment is a longest increasing run of positions.

No group is gathered. Equal texts are one node. In a bucket of equal tuples every node is first verified against the
bucket's smallest node only; links make classes. Then buckets that still hold several classes are looked at again, in
blocks of bounded size: pairs of different classes that share a bucket and whose estimated similarity
(from the smallest hash in each of 128 ranges) is not four standard errors below the wanted one (of pairs at 0.8 itself 3 in 100,000 are) are aligned inside
the task, which gives one link for each two classes that it finds connected. So links inside a class are not looked
for, pairs never become rows, and hardly any link between classes is lost that the sketches find.

Defined results: a null text is the empty text; texts without a word are equal only to the same text; texts of one to
four words are near copies if their words are equal; rows that share an id, or have none, are judged by their text: a class
is its ``root``, a digest no other class has, and ``class_id`` is the smallest id in it (null where all its ids are null;
classes may share one where an id has several texts); ``one_of_each`` keeps one row of each class whatever the ids,
that with the smallest id, then the smallest digest, and of rows with equal id and text one; an empty table
gives no rows; further columns are kept by ``one_of_each``.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photocat.llm.common import fixed, table, text_slices, utf8
from photocat.llm.graph import components, dealt, in_blocks, sorted_groups
from photocat.llm.shingles import STEP, labelled, mixed

SKETCHES = 16
TUPLE = 3
SIMILARITY = 0.8
BLOCK = 300
RANGES = 128
#: Texts are hashed in slices of about so many bytes, as the work on a slice takes many times its size.
SLICE = 1 << 20
#: Estimates of similarity have a standard error of 0.035 at most where the similarity is 0.8.
LEAST_ESTIMATE = 0.66
NOTHING = np.uint64(0xFFFFFFFFFFFFFFFF)


def sketches(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(texts, SKETCHES) hashes of the ordered tuples; those of texts without a word mean nothing."""
    runs = np.diff(first)
    some = np.flatnonzero(runs)
    out = np.zeros((len(runs), SKETCHES), dtype=np.uint64)
    if not len(some):
        return out
    starts, counts = first[:-1][some], runs[some]
    owner = np.repeat(np.arange(len(some)), counts)
    for s in range(SKETCHES):
        v = mixed(value ^ mixed(np.array([s + 1], dtype=np.uint64) * STEP))
        places, picks = [], []
        for _ in range(TUPLE):
            low = np.minimum.reduceat(v, starts)
            hit = np.flatnonzero(v == low[owner])
            of, once = np.unique(owner[hit], return_index=True)
            place = np.empty(len(some), dtype=np.int64)
            place[of] = hit[once]
            places.append(np.where(low == NOTHING, np.int64(1) << 62, place))
            picks.append(low)
            v[place] = NOTHING
        order = np.argsort(np.array(places), axis=0, kind="stable")
        picked = np.take_along_axis(np.array(picks), order, axis=0)
        h = np.full(len(some), np.uint64(s + 1))
        for row in picked:
            h = mixed(h * STEP + row)
        out[some, s] = h
    return out


def range_minima(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(texts, RANGES) bytes: of the smallest hash in each range, 0 where there is none."""
    v = mixed(value ^ np.array([SKETCHES + 1], dtype=np.uint64) * STEP)
    low = np.full((len(first) - 1) * RANGES, NOTHING)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    np.minimum.at(low, text * RANGES + (v >> np.uint64(57)).astype(np.int64), v)
    return np.where(low == NOTHING, 0, 1 + (low >> np.uint64(8)) % np.uint64(255)).astype(np.uint8).reshape(-1, RANGES)


def _sketch_batches(batches):
    for part in text_slices(batches, max_bytes=SLICE):
        texts = utf8(part.column("text"))
        value, first = labelled(texts)
        tuples = sketches(value, first).view(np.int64)
        bands = pa.array([row.tolist() if n else [] for n, row in zip(np.diff(first), tuples, strict=True)], pa.list_(pa.int64()))
        minima = pa.array([row.tobytes() for row in range_minima(value, first)], pa.binary())
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([hashlib.md5(t).digest() for t in texts], pa.binary()), bands, minima], names=["doc_id", "node", "bands", "minima"])


def increasing(positions: np.ndarray) -> int:
    """Length of the longest increasing run of positions."""
    if len(positions) < 2 or (np.diff(positions) > 0).all():
        return len(positions)
    tails: list[int] = []
    for x in positions.tolist():
        k = bisect_left(tails, x)
        tails[k : k + 1] = [x]
    return len(tails)


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Banded alignment of two sequences of labelled runs."""
    total = len(a) + len(b)
    need = int(np.ceil(total * least / (1 + least) - 1e-9))
    if not total or need > min(len(a), len(b)):
        return False
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    band = np.abs(i - j) <= total - 2 * need  # an alignment with ``need`` matches strays no further
    i, j = i[band], j[band]
    return len(i) >= need and increasing(j[np.argsort(i)]) >= need


def _verify_batches(batches):
    for part in text_slices(batches, "a_text", SLICE):
        a, b = part.column("a").to_pylist(), part.column("b").to_pylist()
        texts = dict(zip(a + b, utf8(part.column("a_text")) + utf8(part.column("b_text")), strict=True))
        at = {k: i for i, k in enumerate(texts)}
        value, first = labelled(list(texts.values()))
        runs = lambda k: value[first[at[k]] : first[at[k] + 1]]
        yield part.select(["a", "b"]).filter(pa.array([similar(runs(x), runs(y)) for x, y in zip(a, b, strict=True)], pa.bool_()))


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    side = lambda c: texts.select(F.col("node").alias(c), F.col("text").alias(f"{c}_text"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_text", "b_text").mapInArrow(_verify_batches, "a binary, b binary")


def _candidates(rows: pa.Table, bucket: int, p: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of a group's rows with different roots that may be similar and were not verified as (node, lead), the
    likeliest first. A pair that meets in several buckets belongs to that of its first equal tuple."""
    node, lead, root, block = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("node", "lead", "root", "block"))
    root = np.unique(root, return_inverse=True)[1]
    bands = np.array(rows.column("bands").to_pylist(), dtype=np.int64)
    minima = np.frombuffer(b"".join(rows.column("minima").to_pylist()), dtype=np.uint8).reshape(-1, RANGES)
    free = node != lead
    open_ = ((block == p) & free)[:, None] & ((block == q) & free)[None, :] & (root[:, None] != root[None, :])
    found = []
    for i in np.flatnonzero(open_.any(1)):  # a row at a time, to hold little
        j = np.flatnonzero(open_[i, i + 1 :]) + i + 1 if p == q else np.flatnonzero(open_[i])
        same = bands[j] == bands[i]
        j = j[same.any(1) & (bands[i, same.argmax(1)] == bucket)]
        estimate = ((minima[j] == minima[i]) & (minima[i] > 0)).sum(1) / np.maximum(1, ((minima[j] | minima[i]) > 0).sum(1))
        likely = estimate >= LEAST_ESTIMATE
        found.append((np.full(int(likely.sum()), i), j[likely], estimate[likely]))
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    x, y, estimate = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.argsort(-estimate, kind="stable")
    return x[order], y[order]


def _links_between(batches):
    """Links between classes in each group: candidates are aligned in their order, unless links found before already
    connect their classes. So a group gives fewer links than it has classes, and no pairs."""
    for (bucket, p, q), rows in sorted_groups(batches, ("bucket", "p", "q")):
        x, y = _candidates(rows, bucket, p, q)
        if not len(x):
            continue
        value, first = labelled(utf8(rows.column("text").combine_chunks()))
        node, root = rows.column("node").to_pylist(), rows.column("root").to_pylist()
        above = {r: r for r in root}

        def top(r):
            while above[r] != r:  # noqa: B023
                above[r] = r = above[above[r]]  # noqa: B023
            return r

        found = []
        for i, j in zip(x.tolist(), y.tolist(), strict=True):
            a, b = top(root[i]), top(root[j])
            if a != b and similar(value[first[i] : first[i + 1]], value[first[j] : first[j + 1]]):
                above[max(a, b)] = min(a, b)
                found.append((node[i], node[j]))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*found, strict=True)], names=["a", "b"])


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, node, root, class_id) for every row; ``node`` is the digest of the text, ``root`` the smallest one in its class."""
    rows = fixed(docs.select("doc_id", "text").mapInArrow(_sketch_batches, "doc_id bigint, node binary, bands array<bigint>, minima binary"))
    nodes = fixed(rows.groupBy("node").agg(F.min("doc_id").alias("first_doc"), F.any_value("bands").alias("bands"), F.any_value("minima").alias("minima")))
    buckets = nodes.select("node", F.explode("bands").alias("bucket"))
    leads = buckets.groupBy("bucket").agg(F.min("node").alias("lead"), F.count("*").alias("n")).filter("n > 1").select("bucket", "lead")
    shared = fixed(buckets.join(leads, "bucket"))
    # texts of the nodes that share a bucket, each once; by id and digest, so that copies of one text do not meet in one task
    wanted = shared.select("node").distinct().join(nodes.select("node", "first_doc"), "node")
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("node", F.unhex(F.md5("text")))
    texts = fixed(own.join(wanted, (own.node == wanted.node) & own.doc_id.eqNullSafe(wanted.first_doc)).select(own.node, "text").dropDuplicates(["node"]))
    links = fixed(_verified(shared.filter("node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b")).distinct(), texts))
    roots = components(links)
    rooted = shared.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed_up = rooted.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("bucket")
    open_rows = rooted.join(mixed_up, "bucket", "left_semi").join(nodes.select("node", "bands", "minima"), "node").join(texts, "node")
    more = dealt(in_blocks(open_rows, "bucket", "node", BLOCK), "bucket", "p", "q").mapInArrow(_links_between, "a binary, b binary")
    links = fixed(links.union(more))
    roots = components(links)
    named = nodes.select("node", "first_doc").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = named.groupBy("root").agg(F.min("first_doc").alias("class_id"))
    return rows.select("doc_id", "node").join(named.join(smallest, "root").select("node", "root", "class_id"), "node")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each class, with its columns: that with the smallest id (rows without one come last), then the
    smallest digest; of rows with this id and text the one whose columns have the smallest hash."""
    id_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    keep = classes(docs).groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "node")).alias("k"))
    keep = keep.select(F.col("k.node").alias("node"), id_text("k.doc_id").alias("id"))
    rows = docs.select(F.struct("*").alias("row")).withColumns({"node": F.unhex(F.md5(F.coalesce(F.col("row.text"), F.lit("")))), "id": id_text("row.doc_id")})
    return rows.join(keep, ["node", "id"]).groupBy("node", "id").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row.*")


def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every document."""
    out = classes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))
