"""Approximate nearest neighbours by largest inner product: a random-projection forest.

Fit: on a bounded sample each tree splits at the median of a random direction, level
by level, to the depth at which a leaf is expected to hold an eighth of all rows, at most
``leaf_rows`` of them.
Vectors get one more component that makes all of them equally long, so that the
largest inner product is the nearest vector for the trees. Index: every row is sent
through every tree; a leaf's rows are stored in chunks of bounded size. Search: each
query holds one priority queue over all trees, ordered by the largest margin by which
a path has left the query's own side, and takes leaves until they hold ``search_share``
of all rows. A query then travels only to the chunks of its leaves, where candidates
are scored against all queries of the chunk at once; the best of each chunk are scored
again exactly, one row at a time in a fixed order of additions, and merged.

Only the trees (bounded by the sample) and the leaf sizes (one number per leaf) are
sent out; vectors and queries are never collected.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components take no part, nor do vectors of another dimension than the most frequent
one (the larger where two are equally frequent); rows that repeat a vec_id count once,
with their best score (exact repeats are dropped before the trees are fitted); ties go to the smaller vec_id; null ids take no part; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm._common import prepare, smallest, stored

K = 20
TREES = 4
#: Rows of the fitting sample; also bounds the depth, as a leaf keeps 8 sample rows.
SAMPLE_ROWS = 20_000
#: Rows of a leaf unless the caller names them: an eighth of the table, so small tables are searched by trees as well, at most LEAF_ROWS.
LEAF_SHARE = 1 / 8
LEAST_LEAF = 8
LEAF_ROWS = 8192
#: Rows that the leaves of one query hold together, as a share of all rows; a row counts
#: once per tree, so more than 1 is possible.
SEARCH_SHARE = 1.2
#: Rows more per wanted neighbour: in a small table these are a larger share of all rows.
SPARE = 10
#: Rows scored by one task at once; a larger leaf is cut into chunks.
CHUNK_ROWS = 16384
#: Queries that meet one chunk in one task; more are dealt over further tasks.
QUERY_ROWS = 16384
QUERY_BLOCK = 256
SLACK = 1e-9


@dataclass
class Forest:
    """Complete binary trees: per tree and level the directions and thresholds of its nodes."""

    directions: list[list[np.ndarray]]
    thresholds: list[list[np.ndarray]]
    radius2: float
    depth: int

    def lengthened(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.radius2 - (x * x).sum(axis=1), 0))
        return np.column_stack([x, rest])

    def margins(self, tree: int, x: np.ndarray) -> list[np.ndarray]:
        """Per level the signed distance of every row to every node's boundary."""
        return [x @ d.T - t for d, t in zip(self.directions[tree], self.thresholds[tree])]

    def leaves(self, tree: int, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), "int64")
        rows = np.arange(len(x))
        for m in self.margins(tree, x):
            node = 2 * node + (m[rows, node] > 0)
        return node

    def probes(self, x: np.ndarray, sizes: np.ndarray, wanted: int) -> list[list[tuple[int, int]]]:
        """Per query the (tree, leaf) pairs that its queue gives until they hold ``wanted`` rows."""
        margins = [[m.tolist() for m in self.margins(t, x)] for t in range(len(self.directions))]
        out = []
        for q in range(len(x)):
            queue = [(0.0, 0, t, 0) for t in range(len(margins))]  # worst margin, level, tree, node
            taken, held = [], 0
            while queue and held < wanted:
                worst, level, tree, node = heapq.heappop(queue)
                while level < self.depth:  # follow the query's side, queue the other
                    m = margins[tree][level][q][node]
                    heapq.heappush(queue, (max(worst, abs(m)), level + 1, tree, 2 * node + (m <= 0)))
                    node, level = 2 * node + (m > 0), level + 1
                if sizes[tree, node]:
                    taken.append((tree, node))
                    held += int(sizes[tree, node])
            out.append(taken)
        return out


def fit(sample: np.ndarray, radius2: float, rows: int, trees: int = TREES, leaf_rows: int | None = None,
        seed: int = 1) -> Forest:
    rng = np.random.default_rng(seed)
    leaf = max(LEAST_LEAF, min(LEAF_ROWS, LEAF_SHARE * rows) if leaf_rows is None else leaf_rows)
    depth = max(0, min(int(np.rint(np.log2(max(1, rows) / leaf))), int(np.log2(max(1, len(sample) / 8)))))
    forest = Forest([], [], radius2, depth)
    x = forest.lengthened(sample)
    for _ in range(trees):
        node, directions, thresholds = np.zeros(len(x), "int64"), [], []
        for level in range(depth):
            d = rng.normal(size=(1 << level, x.shape[1]))
            d /= np.linalg.norm(d, axis=1, keepdims=True)
            place = (x * d[node]).sum(axis=1)
            t = np.array([np.median(place[node == n]) if (node == n).any() else 0.0 for n in range(1 << level)])
            node = 2 * node + (place > t[node])
            directions.append(d)
            thresholds.append(t)
        forest.directions.append(directions)
        forest.thresholds.append(thresholds)
    return forest


def sound(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles) of the rows that take part, one dimension only."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    v = v.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite
                 & F.exists("embedding", lambda x: x != 0))
    common = v.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    return v.filter(F.size("embedding") == (common[0]["dim"] if common else 0))


def matrix(column: pa.Array) -> np.ndarray:
    if not len(column):
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products, each added up in the same order whatever the other rows are."""
    total = np.zeros(len(x))
    for j in range(len(q)):
        total += x[:, j] * q[j]
    return total


def spread(ids: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A hash of whole rows, so that rows of one id are dealt out as well."""
    odd = np.random.default_rng(2).integers(0, 1 << 63, x.shape[1], "u8") * np.uint64(2) + np.uint64(1)
    h = ids.astype("u8") * np.uint64(0x9E3779B97F4A7C15)
    for j in range(x.shape[1]):
        bits = np.ascontiguousarray(x[:, j]).view("u8")
        h += (bits ^ (bits >> np.uint64(32))) * odd[j]  # the low bits of a double are often zero
    h ^= h >> np.uint64(32)
    return (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)


def best_of(ids: np.ndarray, x: np.ndarray, own: np.ndarray, q: np.ndarray, k: int):
    """Per query the k best ids (other than its own) and their exact scores, each id with its best row."""
    near = q @ x.T
    near[own[:, None] == ids[None, :]] = -np.inf
    distinct, of = np.unique(ids, return_inverse=True)
    tops = near  # per query the best of each id
    if len(distinct) < len(ids):
        by_id = np.argsort(of, kind="stable")
        tops = np.maximum.reduceat(near[:, by_id], np.searchsorted(of[by_id], np.arange(len(distinct))), axis=1)
    for i in range(len(q)):
        row, top = near[i], tops[i]
        if len(top) > k:
            least = np.partition(top, len(top) - k)[len(top) - k]
            at = np.flatnonzero(row >= least - SLACK * (1 + abs(least)) if np.isfinite(least) else row > -np.inf)
        else:
            at = np.flatnonzero(row > -np.inf)
        s = exact(x[at], q[i])
        order = np.lexsort((ids[at], -s))
        order = order[np.sort(np.unique(ids[at][order], return_index=True)[1])[:k]]
        yield ids[at][order], s[order]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, trees: int = TREES, leaf_rows: int | None = None,
            sample_rows: int = SAMPLE_ROWS, search_share: float = SEARCH_SHARE, chunk_rows: int = CHUNK_ROWS,
            query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best found for each row of ``queries(vec_id, embedding)``
    among all rows of ``vectors(vec_id, embedding)`` but those with the query's own id."""
    spark = prepare(vectors)
    rows = stored(sound(vectors).dropDuplicates(["vec_id", "embedding"]), "vectors")
    asked = queries.select(F.col("vec_id").cast("long").alias("vec_id")).distinct()
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)).alias("r2")).first()
    if not facts["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = smallest(rows, F.xxhash64("vec_id", "embedding"), sample_rows, facts["n"], "sampled-vectors", F.col("vec_id"))
    sample = sample.select("embedding").toArrow()
    forest = fit(matrix(sample.column(0).combine_chunks()), facts["r2"], facts["n"], trees, leaf_rows)
    sent = spark.sparkContext.broadcast(forest)  # bounded by the sample

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK_ROWS):
                part = batch.slice(at, CHUNK_ROWS)
                x = f.lengthened(matrix(part.column(1)))
                for t in range(len(f.directions)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(x), t, "i4")), pa.array(f.leaves(t, x).astype("i4")), *part.columns],
                        names=["tree", "leaf", "vec_id", "embedding"])

    index = rows.mapInArrow(route, "tree int, leaf int, vec_id long, embedding array<double>")
    # Routing again is cheaper than storing the vectors once per tree; only the sizes are gathered here.
    counts = index.groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("n")).collect()  # trees x leaves numbers
    sizes = np.zeros((trees, 1 << forest.depth), "int64")
    for r in counts:
        sizes[r["tree"], r["leaf"]] = r["n"]
    chunks = np.maximum(1, -(-sizes // chunk_rows))
    told = spark.sparkContext.broadcast((sizes, chunks))
    wanted = int(np.ceil(search_share * facts["n"])) + SPARE * k
    asking = stored(rows.join(asked, "vec_id", "left_semi"), "queries")
    sides = max(1, -(-asking.count() // query_rows))  # no task holds more than about query_rows queries

    names = ["tree", "leaf", "chunk", "side", "vec_id", "embedding"]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, (n, parts) = sent.value, told.value
        for batch in batches:
            for at in range(0, batch.num_rows, QUERY_BLOCK):
                part = batch.slice(at, QUERY_BLOCK)
                x = matrix(part.column(1))
                taken = f.probes(np.column_stack([x, np.zeros(len(x))]), n, wanted)
                where = [(q, t, leaf, c) for q, leaves in enumerate(taken) for t, leaf in leaves for c in range(parts[t, leaf])]
                q, t, leaf, c = (np.array(z, "i4") for z in zip(*where))
                side = (spread(part.column(0).to_numpy(), x) % np.uint64(sides)).astype("i4")[q]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(t), pa.array(leaf), pa.array(c), pa.array(side), part.column(0).take(pa.array(q)),
                     part.column(1).take(pa.array(q))], names=names)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, parts = told.value
        for batch in route(batches):
            t, leaf, ids = (batch.column(i).to_numpy() for i in range(3))
            c = (spread(ids, matrix(batch.column(3))) % parts[t, leaf].astype("u8")).astype("i4")
            for side in range(sides):
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(c), pa.array(np.full(len(c), side, "i4")),
                                                  *batch.columns[2:]], names=names)

    def score(key, left: pa.Table, right: pa.Table) -> pa.Table:
        ids = left.column("vec_id").to_numpy()
        own, out_q, out_v, out_s = right.column("vec_id").to_numpy(), [], [], []
        if len(ids) and len(own):
            x = matrix(left.column("embedding").combine_chunks())
            q = matrix(right.column("embedding").combine_chunks())
            for at in range(0, len(q), QUERY_BLOCK):
                for i, (v, s) in enumerate(best_of(ids, x, own[at:at + QUERY_BLOCK], q[at:at + QUERY_BLOCK], k)):
                    out_q.append(np.full(len(v), own[at + i]))
                    out_v.append(v)
                    out_s.append(s)
        cat = lambda a, kind: pa.array(np.concatenate(a) if a else np.zeros(0, kind))
        return pa.table({"query_id": cat(out_q, "i8"), "vec_id": cat(out_v, "i8"), "score": cat(out_s, "f8")})

    chunk = "tree int, leaf int, chunk int, side int, vec_id long, embedding array<double>"
    placed = rows.mapInArrow(place, chunk)
    sought = asking.mapInArrow(ask, chunk)
    keys = ("tree", "leaf", "chunk", "side")
    found = placed.groupBy(*keys).cogroup(sought.groupBy(*keys)).applyInArrow(score, "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
