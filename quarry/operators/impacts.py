"""Pruned BM25 search over a block index (B1): exact top-k without reading all postings.

Documents are put in order of their length and cut into regions of ``region_docs``
documents. A block holds the postings of one term in one region. Stored are

* ``postings(shard, term, region, doc_id, tf, dl)``: one folder per shard (a range of
  regions), sorted by term inside, in small row groups;
* ``blocks(term, shard, region, top, n)``: per block the highest term factor
  ``tf / (tf + norm)`` and its number of postings, one file per shard, sorted by term.

A document's factor falls with its length, so the regions' maxima differ widely, and
regions without a query's rare terms have low bounds. For a query, the sum of the
blocks' maxima times the term weights bounds the score of every document of a region.
The first pass scores the regions of the highest bounds; the k-th score found there is a
threshold. The second scores those other regions whose bound reaches it. The rest cannot
hold a hit, ties included. Reading a region, for each of the query's terms, reads whole
blocks, so scores are complete and equal those of the full scan.

Scans are narrowed three ways: by folders (shards of no wanted region are not listed), by
pushed ``term IN`` filters on the sorted files, and by a join with the wanted (term, region)
pairs. Per query and region one bound is computed, a ``region_docs``-th of what the postings
of frequent terms would be. Weights must not be negative (BM25 and RM3 weights are not).
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quarry.operators.bm25 import BM25Params, query_terms
from quarry.operators.index import TextIndex
from quarry.operators.ranking import RANK_DECIMALS, top_k
from quarry.plans.sizing import BROADCAST_MAX_ROWS, cut_lineage, row_count_at_most
from quarry.session import filesystem
from quarry.shipping import ship

#: Documents per region, a power of two.
REGION_DOCS = 64
#: Regions per query scored first.
FIRST_REGIONS = 16
#: Up to so many distinct query terms are pushed into the scans.
PUSHED_TERMS = 20_000
#: Postings read at once, and (query, posting) pairs and sums held at once, in a task.
READ_ROWS = 1 << 16
SUMS = 1 << 21
#: Scores are compared after rounding to 9 decimals; bounds are added in another order.
SLACK = 1e-8


BLOCKS = "term string, shard int, region long, top double, n long"
BLOCKS_ARROW = pa.schema([("term", pa.string()), ("shard", pa.int32()), ("region", pa.int64()), ("top", pa.float64()), ("n", pa.int64())])


def _postings_schema(id_type: str) -> str:
    return f"term string, region long, doc_id {id_type}, tf int, dl int, shard int"


@dataclass
class ImpactIndex:
    postings: DataFrame
    blocks: DataFrame
    n_docs: int
    avgdl: float
    params: BM25Params


def _factor(params: BM25Params, avgdl: float):
    norm = F.lit(params.k1) * (F.lit(1.0 - params.b) + F.lit(params.b) * F.col("dl") / F.lit(avgdl))
    return F.col("tf") / (F.col("tf") + norm)


def _norm(params: BM25Params, avgdl: float, dl: np.ndarray) -> np.ndarray:
    return params.k1 * ((1.0 - params.b) + params.b * dl / avgdl)


def _shard_files(postings: DataFrame) -> dict[int, list[str]]:
    """The files of each shard, in the order they were written."""
    files: dict[int, list[str]] = {}
    for f in sorted(postings.inputFiles()):
        files.setdefault(int(re.search(r"/shard=(\d+)/", f)[1]), []).append(f)
    return files


def _blocks_of(shard: int, files: list[str], params: BM25Params, avgdl: float):
    """Batches of ``BLOCKS`` of one shard, from its files sorted by term and region."""
    held = None  # the last block may go on in the next batch

    def made(term, region, top, n):
        columns = [term, np.full(len(n), shard), region, top, n]
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, BLOCKS_ARROW.types)], schema=BLOCKS_ARROW)

    for file in files:
        fs, name = filesystem(file)
        with fs.open_input_file(name) as source:
            for batch in pq.ParquetFile(source).iter_batches(READ_ROWS, columns=["term", "region", "tf", "dl"]):
                if not batch.num_rows:
                    continue
                term, (region, tf, dl) = batch.column("term"), (batch.column(c).to_numpy() for c in ("region", "tf", "dl"))
                new = np.append(True, pc.not_equal(term[1:], term[:-1]).to_numpy(zero_copy_only=False) | (region[1:] != region[:-1]))
                at = np.flatnonzero(new)
                top = np.maximum.reduceat(tf / (tf + _norm(params, avgdl, dl)), at)
                term, region, n = term.take(pa.array(at)), region[at], np.diff(np.append(at, len(new)))
                if held is not None:
                    if held[0][0] == term[0] and held[1][0] == region[0]:
                        top[0], n[0] = max(top[0], held[2][0]), n[0] + held[3][0]
                    else:
                        yield made(*held)
                held = (term[-1:], region[-1:], top[-1:], n[-1:])
                yield made(term[:-1], region[:-1], top[:-1], n[:-1])
    if held is not None:
        yield made(*held)


def write_impacts(index: TextIndex, path: str, params: BM25Params = BM25Params(), region_docs: int = REGION_DOCS,
                  shards: int | None = None) -> ImpactIndex:
    """Store the block index of ``index`` below ``path``. ``shards`` (default: the
    session's shuffle partitions) is the number of document ranges; one task writes one."""
    if region_docs < 1 or region_docs & (region_docs - 1):
        raise ValueError("region_docs must be a power of two")
    spark, path = index.postings.sparkSession, path.rstrip("/")
    n, avgdl = index.stats()
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = index.postings.select("doc_id", "dl").distinct()
    placed = docs.repartitionByRange(shards, "dl", "doc_id").sortWithinPartitions("dl", "doc_id")
    place = F.monotonically_increasing_id()  # partition in the high bits, then the position
    placed.select("doc_id", place.alias("place")).write.parquet(f"{path}/regions")
    regions = spark.read.parquet(f"{path}/regions").select(
        "doc_id", F.shiftright("place", 33).cast("int").alias("shard"),
        F.shiftright("place", region_docs.bit_length() - 1).alias("region"))
    # The postings lie partitioned by document: a hash of each part's documents spares sorting them.
    rows = index.postings.join(regions.hint("shuffle_hash"), "doc_id").select("shard", "term", "region", "doc_id", "tf", "dl")
    # Shards are numbered by partition, so each gets a task of its own; hashed, some tasks get several.
    rows = rows.repartitionById(shards, "shard").sortWithinPartitions("shard", "term", "region", "doc_id")
    rows.write.partitionBy("shard").option("parquet.block.size", str(4 << 20)).parquet(f"{path}/postings")
    id_type = index.postings.schema["doc_id"].dataType.simpleString()
    stored = spark.read.schema(_postings_schema(id_type)).parquet(f"{path}/postings")
    # A shard's sorted files hold each of its blocks in one run: a task counts them without an exchange.
    files = _shard_files(stored)

    def counted(batches):
        for batch in batches:
            for shard in batch.column("id").to_pylist():
                yield from _blocks_of(shard, files.get(shard, []), params, avgdl)

    ship(spark)
    blocks = spark.range(0, shards, 1, shards).mapInArrow(counted, BLOCKS)
    blocks.write.option("parquet.block.size", str(4 << 20)).parquet(f"{path}/blocks")
    facts = spark.createDataFrame([(n, avgdl, params.k1, params.b, id_type)],
                                  "n_docs long, avgdl double, k1 double, b double, id_type string")
    facts.write.parquet(f"{path}/facts")
    return read_impacts(spark, path)


def read_impacts(spark: SparkSession, path: str) -> ImpactIndex:
    path = path.rstrip("/")
    facts = spark.read.parquet(f"{path}/facts").first()  # one row
    postings = spark.read.schema(_postings_schema(facts["id_type"])).parquet(f"{path}/postings")
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    return ImpactIndex(postings, blocks, facts["n_docs"], facts["avgdl"], BM25Params(facts["k1"], facts["b"]))


def _postings_of(file: str, terms: list[str]):
    """(term number, region, doc_id, tf, dl) arrays of the postings of the sorted ``terms`` in one file."""
    fs, name = filesystem(file)
    values = pa.array(terms, pa.string())
    with fs.open_input_file(name) as source:
        parquet = pq.ParquetFile(source)
        at = parquet.schema_arrow.names.index("term")
        for group in range(parquet.num_row_groups):
            facts = parquet.metadata.row_group(group).column(at).statistics
            if facts is not None and facts.has_min_max and bisect_left(terms, facts.min) == bisect_right(terms, facts.max):
                continue
            for batch in parquet.iter_batches(READ_ROWS, [group], columns=["term", "region", "doc_id", "tf", "dl"]):
                number = pc.index_in(batch.column("term"), value_set=values)
                batch = batch.filter(number.is_valid())
                if batch.num_rows:
                    yield [number.drop_null().to_numpy(zero_copy_only=False),
                           *(batch.column(c).to_numpy(zero_copy_only=False) for c in ("region", "doc_id", "tf", "dl"))]


def _shard_best(wanted: pa.Table, files: list[str], weights: tuple, params: BM25Params, avgdl: float, k: int):
    """(qids, doc_ids, scores) of the k best documents of each query in its ``wanted(qid, shard, region)`` of a shard."""
    qids, terms, starts, of_query, weight = weights
    place = {q: i for i, q in enumerate(qids)}
    regions, region_at = np.unique(wanted.column("region").to_numpy(), return_inverse=True)
    asked = np.zeros((len(qids), len(regions)), bool)
    rows = [(place[q], r) for q, r in zip(wanted.column("qid").to_pylist(), region_at.tolist()) if q in place]
    asked[tuple(np.array(rows, "int64").reshape(-1, 2).T)] = True
    parts = []
    for number, region, doc, tf, dl in (x for f in files for x in _postings_of(f, terms)):
        there = np.isin(region, regions)
        parts.append((number[there], np.searchsorted(regions, region[there]), doc[there], tf[there], dl[there]))
    if not sum(len(p[0]) for p in parts):
        return [], [], []
    number, region, doc, tf, dl = map(np.concatenate, zip(*parts))
    del parts
    docs, doc = np.unique(doc, return_inverse=True)  # numbered in the order of their ids
    order = np.argsort(doc, kind="stable")
    number, region, doc, tf, dl = (x[order] for x in (number, region, doc, tf, dl))
    factor = tf / (tf + _norm(params, avgdl, dl))
    count = starts[number + 1] - starts[number]
    total = np.concatenate([[0], np.cumsum(count)])
    first = np.append(np.flatnonzero(np.append(True, doc[1:] != doc[:-1])), len(doc))  # where each document starts
    best = (np.zeros(0, "int64"), np.zeros(0, "int64"), np.zeros(0))
    at, most_docs = 0, max(1, SUMS // len(qids))
    while at < len(first) - 1:
        # Whole documents, as many as keep the pairs and the sums held at once bounded.
        stop = int(np.searchsorted(total[first], total[first[at]] + SUMS, side="right")) - 1
        stop = min(max(stop, at + 1), at + most_docs, len(first) - 1)
        lo, hi = first[at], first[stop]
        posting = np.repeat(np.arange(lo, hi), count[lo:hi])
        pair = starts[number[posting]] + np.arange(len(posting)) - (total[posting] - total[lo])
        met = asked[of_query[pair], region[posting]]
        posting, pair = posting[met], pair[met]
        cell = of_query[pair] * (stop - at) + doc[posting] - doc[lo]
        sums = np.bincount(cell, weights=weight[pair] * factor[posting], minlength=1)
        hit = np.flatnonzero(np.bincount(cell, minlength=1))
        new = (hit // (stop - at), hit % (stop - at) + doc[lo], sums[hit])
        q, d, s = (np.concatenate(x) for x in zip(best, new))
        order = np.lexsort((d, -np.round(s, RANK_DECIMALS), q))
        q, d, s = q[order], d[order], s[order]
        keep = np.arange(len(q)) - np.searchsorted(q, q) < k
        best, at = (q[keep], d[keep], s[keep]), stop
    return [qids[i] for i in best[0].tolist()], docs[best[1]].tolist(), best[2]


class PrunedSearch:
    """One batch of weighted queries ``(qid, term, qw)`` over an ``ImpactIndex``."""

    def __init__(self, index: ImpactIndex, qweights: DataFrame, k: int, first_regions: int = FIRST_REGIONS,
                 max_broadcast_rows: int = BROADCAST_MAX_ROWS):
        self.index, self.k, self.max_rows = index, k, max_broadcast_rows
        qw = cut_lineage(qweights.select("qid", "term", F.col("qw").cast("double").alias("qw")))
        terms = qw.select("term").distinct()
        self.pushed = [r["term"] for r in terms.collect()] if row_count_at_most(terms, PUSHED_TERMS) else None
        self.found = self.only_terms(index.blocks)  # the blocks of the queries' terms
        dfs = self.found.groupBy("term").agg(F.sum("n").alias("df"))
        idf = F.log(F.lit(1.0) + (F.lit(float(index.n_docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        self.weights = cut_lineage(qw.join(self.hint(dfs), "term").select("qid", "term", (F.col("qw") * idf).alias("wt")))
        bounds = self.found.join(self.hint(self.weights), "term").groupBy("qid", "shard", "region").agg(
            F.sum(F.col("wt") * F.col("top")).alias("bound"))
        self.bounds = cut_lineage(bounds)
        self.first = cut_lineage(top_k(self.bounds, first_regions, doc="region", score="bound").select("qid", "shard", "region"))
        self.sent = self.shipped() if row_count_at_most(self.weights, min(max_broadcast_rows, BROADCAST_MAX_ROWS)) else None
        self.first_scores = cut_lineage(self.scores(self.first))
        kth = top_k(self.first_scores, k).filter(F.col("rank") == k).select("qid", F.col("score").alias("kth"))
        reach = self.bounds.join(self.hint(kth), "qid", "left").filter(
            F.col("kth").isNull() | (F.col("bound") * (1 + 1e-12) + SLACK >= F.col("kth")))
        self.second = cut_lineage(reach.select("qid", "shard", "region").join(
            self.hint(self.first), ["qid", "shard", "region"], "left_anti"))

    def hint(self, side: DataFrame) -> DataFrame:
        return F.broadcast(side) if row_count_at_most(side, self.max_rows) else side

    def only_terms(self, rows: DataFrame) -> DataFrame:
        return rows if self.pushed is None else rows.filter(F.col("term").isin(self.pushed))

    def read(self, pairs: DataFrame) -> DataFrame:
        """(qid, wt, doc_id, term, tf, dl): the postings of the pairs' blocks."""
        shards = [r["shard"] for r in pairs.select("shard").distinct().collect()]  # at most one row per shard
        wanted = pairs.join(self.hint(self.weights), "qid").select("qid", "region", "term", "wt")
        rows = self.only_terms(self.index.postings.filter(F.col("shard").isin(shards)))
        return rows.join(self.hint(wanted), ["term", "region"])

    def shipped(self):
        """The weights as ``(qids, terms, starts, query, weight)``, a run of queries per term: proven small."""
        rows = sorted((r for r in self.weights.collect() if r["qid"] is not None), key=lambda r: r["term"])
        qids = list(dict.fromkeys(r["qid"] for r in rows))
        place = {q: i for i, q in enumerate(qids)}
        terms = list(dict.fromkeys(r["term"] for r in rows))
        starts = np.searchsorted(np.array([r["term"] for r in rows], object), np.array([*terms], object)) if rows else np.zeros(0, int)
        spark = self.weights.sparkSession
        ship(spark)
        return spark.sparkContext.broadcast((qids, terms, np.append(starts, len(rows)),
                                             np.array([place[r["qid"]] for r in rows], "int64"), np.array([r["wt"] for r in rows])))

    def scores(self, pairs: DataFrame) -> DataFrame:
        """(qid, doc_id, score): complete scores in the pairs' regions, of the ``k`` best documents per
        query and shard at least. A shard holds all postings of its documents, so one task sums them and
        passes on its best; weights too many to send are joined instead, and all sums are exchanged."""
        if self.sent is None:
            part = F.col("wt") * _factor(self.index.params, self.index.avgdl)
            return self.read(pairs).groupBy("qid", "doc_id").agg(F.sum(part).alias("score"))
        files = _shard_files(self.index.postings)
        kinds = [(c, s.schema[c].dataType) for s, c in ((pairs, "qid"), (self.index.postings, "doc_id"))]
        schema = T.StructType([T.StructField(c, kind) for c, kind in kinds] + [T.StructField("score", T.DoubleType())])
        arrow, sent, params, avgdl, k = to_arrow_schema(schema), self.sent, self.index.params, self.index.avgdl, self.k

        def run(wanted):
            qids, docs, found = _shard_best(wanted, files.get(wanted.column("shard")[0].as_py(), []), sent.value, params, avgdl, k)
            columns = [pa.array(x, kind) for x, kind in zip((qids, docs, found), arrow.types)]
            return pa.Table.from_arrays(columns, schema=arrow)

        # A task per shard: their number is fixed, since few bytes stand for much work.
        dealt = pairs.filter(F.col("qid").isNotNull()).repartition(max(1, len(files)), "shard")
        return dealt.groupBy("shard").applyInArrow(run, schema)

    def run(self) -> DataFrame:
        return top_k(self.first_scores.unionByName(self.scores(self.second)), self.k)

    def blocks_read(self) -> DataFrame:
        """(qid, read, blocks): blocks of a query's terms in the regions scored, and all of them."""
        met = self.found.join(self.hint(self.weights), "term").select("qid", "region")
        pairs = self.first.unionByName(self.second).select("qid", "region", F.lit(1).alias("hit"))
        return met.join(self.hint(pairs), ["qid", "region"], "left").groupBy("qid").agg(
            F.count("hit").alias("read"), F.count(F.lit(1)).alias("blocks"))


def pruned_search(index: ImpactIndex, qweights: DataFrame, k: int = 100, first_regions: int = FIRST_REGIONS,
                  max_broadcast_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Top-k run ``(qid, doc_id, score, rank)`` for weighted query terms, as ``bm25_search`` gives it."""
    return PrunedSearch(index, qweights, k, first_regions, max_broadcast_rows).run()


def pruned_topk(index: ImpactIndex, queries: DataFrame, k: int = 100, first_regions: int = FIRST_REGIONS,
                qid_col: str = "qid", text_col: str = "text", max_broadcast_rows: int = BROADCAST_MAX_ROWS,
                stopwords: list[str] | None = None) -> DataFrame:
    """BM25 top-k for every query of ``queries(qid, text)``, as ``bm25_topk`` gives it."""
    return pruned_search(index, query_terms(queries, qid_col, text_col, stopwords), k, first_regions, max_broadcast_rows)
