"""Learnt text encoder: truncated SVD of the tf-idf matrix.

Queries and documents get vectors of one space: the sums of their terms' vectors, weighted
by tf-idf, where the term vectors are the right singular vectors of the corpus' normalised
tf-idf matrix divided by the singular values. A document's vector is then its row of the
left singular vectors, and every direction of the space counts alike, so rare matter is
not drowned by the directions of frequent words.

The SVD is a randomised power iteration, kept on the documents' side, where a table has one
row per document and not one per term: ``Y = A T`` of a random ``T``, then ``Y -> A A' Y``. The
matrix is stored once, each document's terms cut into ranges of the vocabulary. A pass takes a
slice of columns of ``Y`` to every range; a task sums up its terms' vectors ``A'Y``, uses them for
``A (A'Y)`` and sends one partial sum per document, so term vectors are never stored or sent. A large
table has as many slices as ranges: what a pass sends is then about twice ``Y``, whatever the size,
and its shuffle files go as it ends. Between rounds the documents' vectors are made orthonormal by
the eigenvectors of their Gram matrix. Only ``width x width`` matrices come to the driver; Gram
matrices are added up by rows first, so what comes does not grow with the tasks. The tables
lie below the shared checkpoint folder and are emptied when they have served. Term vectors are
made for the terms that some texts need, by one more pass.

Terms in fewer than ``min_df`` documents have no vector. Texts without known terms get a
zero vector. Documents and terms are keyed by ids and by 64-bit hashes of the terms.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import tokens
from quarry.operators.index import TextIndex
from quarry.plans.sizing import BROADCAST_MAX_ROWS, cut_lineage, row_count_at_most
from quarry.session import ensure_checkpoint_dir
from quarry.shipping import ship

DIM = 256
OVERSAMPLE = 24
ROUNDS = 3
MIN_DF = 2
#: Documents of a block of texts to encode, and partial vectors that one task adds up.
BLOCK_DOCS = 1024
SUM_ROWS = 50_000
#: Least number of term ranges, and the terms and postings that one holds at most, about.
RANGES = 8
RANGE_TERMS = 60_000
RANGE_POSTINGS = 16_000_000
#: Bytes that a pass over one slice of columns sends, if there are not as many slices as ranges by then.
SLICE_BYTES = 128 << 20
#: Rows whose vectors lie in one task, and parts of a larger table that are put together one after the other.
WHOLE_DOCS = 8192
PARTS = 4
#: Postings of a chunk inside a task, and the share of a chunk's documents from which a term's column is dense.
CHUNK = 400_000
DENSE = 0.015
#: Name of Spark's setting that drops a command's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
VECTORS = "term long, embedding array<double>"


class _Tables:
    """Tables below the shared checkpoint folder; ``drop`` empties one that has served."""

    def __init__(self, spark):
        self.spark, self.folder = spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/lsa-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str, mode: str = "overwrite") -> DataFrame:
        with _no_shuffle_left(self.spark):
            df.write.mode(mode).parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def drop(self, df: DataFrame, name: str) -> None:
        self.keep(self.spark.createDataFrame([], df.schema), name)


@contextmanager
def _no_shuffle_left(spark):
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


@dataclass
class TermVectors:
    """What was learnt from ``index``: ``idf(term, idf)`` by the terms' hashes, the singular values,
    ``documents(doc_id, embedding)``, and what term vectors are made from."""

    idf: DataFrame
    singular: np.ndarray
    documents: DataFrame
    index: TextIndex
    _matrix: "_Matrix"
    _basis: DataFrame
    _mix: np.ndarray

    def of(self, terms: DataFrame) -> DataFrame:
        """``(term, embedding)`` of the distinct ``terms(term)``, given by their hashes; unknown ones are missing."""
        return self._matrix.term_vectors(self._basis, self._mix, terms)

    @property
    def vectors(self) -> DataFrame:
        """``(term, embedding)`` of all terms."""
        return self.of(self.idf.select("term"))


def _weights(counts: DataFrame, idf: DataFrame, key: str) -> DataFrame:
    """(key, terms, weights): normalised tf-idf rows of ``counts(key, term, tf)``, ``term`` hashed."""
    rows = counts.join(idf, "term").select(key, "term", ((1 + F.log("tf")) * F.col("idf")).alias("w"))
    rows = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("term", "w"))).alias("row"))  # one text's terms
    size = F.sqrt(F.aggregate("row", F.lit(0.0), lambda a, x: a + x["w"] * x["w"]))
    return rows.select(key, F.transform("row", lambda x: x["term"]).alias("terms"),
                       F.transform("row", lambda x: x["w"] / size).alias("weights"))


def _blocks(rows: DataFrame, key: str, block_docs: int) -> tuple[DataFrame, DataFrame]:
    """The matrix in blocks, and the distinct terms of each block."""
    n = max(1, -(-rows.count() // block_docs))
    matrix = cut_lineage(rows.withColumn("block", F.pmod(F.xxhash64(key), F.lit(n)).cast("int")))
    own = (F.col("block") + 0).alias("block")  # a column of its own: both sides meet in a cogroup
    return matrix, cut_lineage(matrix.select(own, F.explode("terms").alias("term")).distinct())


def _matrix(rows: pa.Table | pa.RecordBatch) -> np.ndarray:
    column = rows.column("embedding")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _product(left: pa.Table, right: pa.Table):
    """(A T, and what is needed for the way back) of one block: sums of its terms' vectors per text."""
    terms = right.column("term").to_numpy()
    order = np.argsort(terms)
    vectors = _matrix(right)
    lists = left.column("terms").combine_chunks()
    n = np.diff(lists.offsets.to_numpy())
    row = np.repeat(np.arange(len(n)), n)
    at = np.minimum(np.searchsorted(terms[order], lists.flatten().to_numpy()), max(0, len(terms) - 1))
    known = terms[order][at] == lists.flatten().to_numpy() if len(terms) else np.zeros(len(row), bool)
    w = left.column("weights").combine_chunks().flatten().to_numpy()
    row, at, w = row[known], order[at[known]] if len(terms) else at[known], w[known]
    return _sums(row, at, w, vectors, len(n)), (row, at, w, terms)


def _sums(to: np.ndarray, of: np.ndarray, w: np.ndarray, vectors: np.ndarray, n: int) -> np.ndarray:
    """``out[to] += w * vectors[of]``, in pieces of bounded size."""
    out = np.zeros((n, vectors.shape[1] if vectors.ndim == 2 else 0))
    order = np.argsort(to, kind="stable")
    _add(out, to[order], of[order], w[order], vectors)
    return out


def _add(out: np.ndarray, to: np.ndarray, of: np.ndarray, w: np.ndarray, vectors: np.ndarray) -> None:
    """The same into ``out``, with ``to`` in ascending order."""
    for at in range(0, len(to), 4096):
        part = slice(at, at + 4096)
        rows = to[part]
        first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        out[rows[first]] += np.add.reduceat(w[part, None] * vectors[of[part]], first, axis=0)


def _vector_table(name: str, ids: np.ndarray, x: np.ndarray, kind=pa.int64()) -> pa.Table:
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, max(1, x.shape[1])), pa.int32()), pa.array(x.ravel())) \
        if x.size else pa.array([[]] * len(ids), pa.list_(pa.float64()))
    return pa.table({name: pa.array(ids, kind), "embedding": lists})


def _packed(rows: pa.Table | pa.RecordBatch, column: str = "y") -> np.ndarray:
    """Rows of float64 numbers that lie in a binary column without nulls."""
    n = rows.num_rows
    return _numbers(rows.column(column), "f8")[1].reshape(n, -1) if n else np.zeros((0, 0))


def _numbers(values: pa.ChunkedArray | pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(offsets in bytes, numbers) of a binary column without nulls that has a row or more."""
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    _, offsets, data = values.buffers()
    offsets = np.frombuffer(offsets, "i4")[values.offset:values.offset + len(values) + 1]
    return offsets - offsets[0], np.frombuffer(data, "u1")[offsets[0]:offsets[-1]].view(kind)


def _lists(values: pa.Array, kind: str) -> pa.Array:
    """Lists of numbers as a binary column."""
    offsets, x = values.offsets.to_numpy(), np.ascontiguousarray(values.flatten().to_numpy(), kind)
    return pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(((offsets - offsets[0]) * x.itemsize).astype("i4")), pa.py_buffer(x)])


def _pack(x: np.ndarray) -> pa.Array:
    x = np.ascontiguousarray(x, "f8")
    offsets = np.arange(len(x) + 1, dtype="i4") * np.int32(x.shape[1] * 8)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(x)])


def _signs(terms: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """A random sign per term and direction, from hashes: the same on every run."""
    h = terms.view("u8")[:, None] * odd[None, :]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.where(h >> np.uint64(63), 1.0, -1.0)


class _Range:
    """The matrix' columns of one range of terms, in chunks of documents."""

    def __init__(self, rows: pa.Table, n: int):
        self.docs, self.size = rows.column("doc").to_numpy(), rows.column("size").to_numpy()
        offsets, self.at = _numbers(rows.column("terms"), "u2")
        self.offsets = offsets // 2
        self.tf = _numbers(rows.column("tfs"), "i4")[1]
        self.df = np.bincount(self.at)
        self.idf = np.log((1.0 + n) / (1.0 + np.maximum(self.df, 1)))[:, None]

    def chunks(self):
        """(slice of documents, (row in it, term, weight before idf) of rare terms, (terms, dense columns) of the others)."""
        a, common = 0, np.flatnonzero(self.df >= max(32, DENSE * len(self.docs)))
        place = np.full(len(self.df), -1)
        place[common] = np.arange(len(common))
        most = max(1, CHUNK * 8 // max(1, len(common)))  # documents, by what the dense columns take
        while a < len(self.docs):
            b = int(np.searchsorted(self.offsets, self.offsets[a] + CHUNK, "right")) - 1
            b = min(max(b, a + 1), a + most, len(self.docs))
            part = slice(self.offsets[a], self.offsets[b])
            row = np.repeat(np.arange(b - a), np.diff(self.offsets[a:b + 1]))
            at, w = self.at[part], 1 + np.log(self.tf[part])
            often = place[at]
            rare = often < 0
            cell = row[~rare] * len(common) + often[~rare]  # a repeated id may have a term twice
            dense = np.bincount(cell, w[~rare], (b - a) * len(common)).reshape(b - a, len(common))
            yield slice(a, b), (row[rare], at[rare], w[rare]), (common, dense)
            a = b

    def to_terms(self, docs: np.ndarray, y: np.ndarray) -> np.ndarray:
        """A'Y, for rows ``y`` of the numbers ``docs``."""
        out, order = np.zeros((len(self.df), y.shape[1])), np.argsort(docs)
        at = order[np.searchsorted(docs[order], self.docs)]
        for part, (row, term, w), (common, dense) in self.chunks():
            x = y[at[part]] / self.size[part, None]
            order = np.argsort(term, kind="stable")
            _add(out, term[order], row[order], w[order], x)
            out[common] += dense.T @ x
        return out * self.idf

    def to_docs(self, vectors: np.ndarray):
        """A times the range's vectors: its part of the documents' sums, in batches."""
        vectors = vectors * self.idf
        for part, (row, term, w), (common, dense) in self.chunks():
            x = dense @ vectors[common]
            _add(x, row, term, w, vectors)
            yield pa.RecordBatch.from_arrays([pa.array(self.docs[part]), _pack(x / self.size[part, None])], ["doc", "y"])


PARTIAL = pa.schema([("doc", pa.int64()), ("y", pa.binary())])
SLICE = pa.schema([("doc", pa.int64()), ("slice", pa.int32()), ("y", pa.binary())])


def _packed_tiles(batches):
    """Rows of a document and range with their terms' numbers and counts as bytes."""
    for rows in batches:
        if rows.num_rows:
            yield pa.RecordBatch.from_arrays([rows.column("range"), rows.column("doc"), rows.column("size"), _lists(
                rows.column("terms"), "u2"), _lists(rows.column("tfs"), "i4")], ["range", "doc", "size", "terms", "tfs"])


class _Matrix:
    """The normalised tf-idf matrix, ``tiles(range, doc, size, terms, tfs)``, ``ids(doc, doc_id)`` and ``terms(term, idf, range, at)``."""

    def __init__(self, index: TextIndex, min_df: int, width: int):
        spark = index.postings.sparkSession
        ship(spark)
        self.tables, self.width = _Tables(spark), width
        self.n, _ = index.stats()
        idf = index.terms.filter(F.col("df") >= min_df).select(
            F.xxhash64("term").alias("term"), F.log((1.0 + self.n) / (1.0 + F.col("df"))).alias("idf"), "df").filter("idf > 0")
        facts = idf.agg(F.count(F.lit(1)).alias("terms"), F.sum("df").alias("postings")).first()
        self.ranges = max(RANGES, -(-facts["terms"] // RANGE_TERMS), -(-(facts["postings"] or 0) // RANGE_POSTINGS))
        of_range = Window.partitionBy("range").orderBy("term")
        self.terms = self.tables.keep(
            idf.select("term", "idf", F.pmod(F.col("term"), F.lit(self.ranges)).cast("int").alias("range"))
            .withColumn("at", F.row_number().over(of_range) - 1), "terms")
        known = F.broadcast(self.terms) if row_count_at_most(self.terms, BROADCAST_MAX_ROWS) else self.terms
        w = (1 + F.log("tf")) * F.col("idf")
        tiles = (index.postings.select("doc_id", F.xxhash64("term").alias("term"), "tf").join(known, "term")
                 .groupBy("doc_id", "range").agg(F.collect_list(F.struct("at", "tf")).alias("x"), F.sum(w * w).alias("square"))
                 .groupBy("doc_id").agg(F.sqrt(F.sum("square")).alias("size"), F.collect_list(F.struct(
                     "range", F.transform("x", lambda p: p["at"]).alias("terms"),
                     F.transform("x", lambda p: p["tf"].cast("int")).alias("tfs"))).alias("tiles")))
        rows = self.tables.keep(tiles.withColumn("doc", F.monotonically_increasing_id()), "rows")
        self.ids = self.tables.keep(rows.select("doc", "doc_id"), "ids")
        self.tiles = self.tables.keep(rows.select("doc", "size", F.inline("tiles")).mapInArrow(
            _packed_tiles, "range int, doc long, size double, terms binary, tfs binary"), "tiles")
        self.tables.drop(rows, "rows")
        self.docs = self.ids.count()
        sent = 2 * self.ranges * self.docs * width * 8
        self.slices = np.array_split(np.arange(width), max(1, min(width, self.ranges, -(-sent // SLICE_BYTES))))

    def _dealt(self, y: DataFrame, mix: np.ndarray) -> DataFrame:
        """(range, doc, y): some columns of ``Y mix`` for every range."""
        sent = y.sparkSession.sparkContext.broadcast(mix)  # width x few

        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column("doc"), _pack(_packed(batch) @ sent.value)], ["doc", "y"])

        return y.select("doc", "y").mapInArrow(run, "doc long, y binary").select(
            F.explode(F.sequence(F.lit(0), F.lit(self.ranges - 1))).alias("range"), "doc", "y")

    def _met(self, right: DataFrame):
        return self.tiles.groupBy("range").cogroup(right.groupBy("range"))

    def _summed(self, partial: DataFrame, k: int) -> DataFrame:
        """The documents' sums of partial vectors, stored as slice ``k``."""
        groups = max(1, -(-self.docs * self.ranges // SUM_ROWS))

        def add(table: pa.Table) -> pa.Table:
            docs, of = np.unique(table.column("doc").to_numpy(), return_inverse=True)
            x = _packed(table)
            out = _sums(of, np.arange(len(of)), np.ones(len(of)), x, len(docs))
            return pa.table({"doc": docs, "slice": pa.array(np.full(len(docs), k, "i4")), "y": _pack(out)})

        sums = partial.groupBy(F.pmod(F.xxhash64("doc"), F.lit(groups)).alias("part")).applyInArrow(add, "doc long, slice int, y binary")
        return self.tables.keep(sums, "slices", "overwrite" if k == 0 else "append")

    def parts(self, df: DataFrame, n: int) -> list[DataFrame]:
        """The ``n`` rows by ``doc``, in parts if they are many."""
        if n <= WHOLE_DOCS:
            return [df]
        return [df.filter(F.pmod(F.xxhash64("doc", F.lit(1)), F.lit(PARTS)) == k) for k in range(PARTS)]

    def _whole(self, slices: DataFrame, name: str, n: int) -> DataFrame:
        """(doc, y) with all columns of the stored slices of ``n`` rows, one part of the rows after the other."""
        parts = self.parts(slices, n)
        groups = max(1, -(-n // (WHOLE_DOCS * len(parts))))

        def put(table: pa.Table) -> pa.Table:
            table = table.sort_by([("doc", "ascending"), ("slice", "ascending")])
            docs, first, n = np.unique(table.column("doc").to_numpy(), return_index=True, return_counts=True)
            values = table.column("y").to_pylist()
            return pa.table({"doc": docs, "y": pa.array([b"".join(values[a:a + m]) for a, m in zip(first, n)], pa.binary())})

        for k, part in enumerate(parts):
            part = part.groupBy(F.pmod(F.xxhash64("doc"), F.lit(groups)).alias("part"))
            out = self.tables.keep(part.applyInArrow(put, "doc long, y binary"), name, "overwrite" if k == 0 else "append")
        return out

    def _taken(self, slices: DataFrame, name: str) -> DataFrame:
        y = self._whole(slices, name, self.docs)
        self.tables.drop(slices, "slices")
        return y

    def start(self, seed: int, name: str) -> DataFrame:
        """A times random signs."""
        odd = np.random.default_rng(seed).integers(1, 1 << 62, self.width, "u8") * np.uint64(2) + np.uint64(1)
        terms = self.terms.select((F.col("range") + 0).alias("range"), "at", "term")
        for k, columns in enumerate(self.slices):
            partial = self._met(terms).applyInArrow(_signed(self.n, odd[columns]), "doc long, y binary")
            out = self._summed(partial, k)
        return self._taken(out, name)

    def there_and_back(self, y: DataFrame, mix: np.ndarray) -> DataFrame:
        """A A' Y mix, in slices of columns."""
        n = self.n

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            if not len(left):
                return PARTIAL.empty_table()
            own = _Range(left, n)
            return pa.Table.from_batches(own.to_docs(own.to_terms(right.column("doc").to_numpy(), _packed(right))), PARTIAL)

        for k, columns in enumerate(self.slices):
            out = self._summed(self._met(self._dealt(y, mix[:, columns])).applyInArrow(run, "doc long, y binary"), k)
        return out

    def term_vectors(self, y: DataFrame, mix: np.ndarray, terms: DataFrame) -> DataFrame:
        """(term, embedding): A' Y mix, for the distinct ``terms(term)`` only."""
        asked = cut_lineage(self.terms.join(terms.select("term"), "term").select(
            "range", F.col("term").alias("doc"), F.lit(None).cast("binary").alias("y"), "at"))
        name = f"terms-{uuid.uuid4().hex}"
        if not mix.shape[1]:
            return self.tables.spark.createDataFrame([], VECTORS)
        for k, columns in enumerate(np.array_split(np.arange(mix.shape[1]), min(mix.shape[1], len(self.slices)))):
            right = self._dealt(y, mix[:, columns]).withColumn("at", F.lit(None).cast("int")).unionByName(asked)
            got = self._met(right).applyInArrow(_asked(self.n, k), "doc long, slice int, y binary")
            out = self.tables.keep(got, name, "overwrite" if k == 0 else "append")
        whole = self._whole(out, f"{name}-whole", asked.count())
        self.tables.drop(out, name)
        return _unpacked(whole.withColumnRenamed("doc", "term"), "term")


def _signed(n: int, odd: np.ndarray):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return PARTIAL.empty_table()
        return pa.Table.from_batches(_Range(left, n).to_docs(_signs(right.sort_by("at").column("term").to_numpy(), odd)), PARTIAL)

    return run


def _asked(n: int, k: int):
    """Slice ``k`` of the vectors of the terms that lie among the documents' rows, without a vector there."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        asked, rows = (right.filter(f(right.column("y"))) for f in (pc.is_null, pc.is_valid))
        if not len(left) or not len(asked):
            return SLICE.empty_table()
        x = _Range(left, n).to_terms(rows.column("doc").to_numpy(), _packed(rows))[asked.column("at").to_numpy()]
        return pa.table([asked.column("doc"), pa.array(np.full(len(x), k, "i4")), _pack(x)], SLICE)

    return run


def _unpacked(y: DataFrame, key: str, mix: np.ndarray | None = None) -> DataFrame:
    """(key, embedding) of packed rows, times a small matrix if there is one."""
    sent = y.sparkSession.sparkContext.broadcast(mix)

    def run(batches):
        for batch in batches:
            x = _packed(batch)
            if len(x):
                x = x if sent.value is None else x @ sent.value
                yield from _vector_table(key, batch.column(key).to_numpy(), x).to_batches()

    return y.select(key, "y").mapInArrow(run, f"{key} long, embedding array<double>")


def _gram(rows: DataFrame, width: int, left: str = "y") -> np.ndarray:
    """Sum of the outer products of all rows' ``left`` and ``y``: each task's are added up by row number."""
    def part(batches):
        total = np.zeros((width, width))
        for batch in batches:
            if batch.num_rows:
                total += _packed(batch, left).T @ _packed(batch)
        yield from _vector_table("term", np.arange(width), total).to_batches()

    def add(table: pa.Table) -> pa.Table:
        x = _matrix(table)
        return _vector_table("term", table.column("term").to_numpy()[:1], x.sum(axis=0, keepdims=True))

    sums = rows.select(*{left: 0, "y": 0}).mapInArrow(part, VECTORS).groupBy("term").applyInArrow(add, VECTORS).collect()
    out = np.zeros((width, width))
    for r in sums:  # width rows of width numbers
        out[r["term"]] = r["embedding"]
    return out


def _orthonormal(gram: np.ndarray, least: float = 1e-12) -> np.ndarray:
    """What makes the columns with this Gram matrix orthonormal; directions without content become zero."""
    value, side = np.linalg.eigh((gram + gram.T) / 2)
    keep = value > max(value.max(), 0) * least
    return side * np.where(keep, 1 / np.sqrt(np.where(keep, value, 1)), 0.0)[None, :]


def fit(index: TextIndex, dim: int = DIM, oversample: int = OVERSAMPLE, rounds: int = ROUNDS, min_df: int = MIN_DF,
        block_docs: int = BLOCK_DOCS, seed: int = 5) -> TermVectors:
    """Term vectors of the corpus of ``index``, of at most ``dim`` numbers each, by one round or more."""
    if rounds < 1:
        raise ValueError("rounds must be >= 1")
    width = dim + oversample
    a = _Matrix(index, min_df, width)
    after = a.start(seed, "y0")
    for k in range(rounds):
        y, mix = after, _orthonormal(_gram(after, width))
        slices = a.there_and_back(y, mix)
        if k < rounds - 1:
            a.tables.drop(y, f"y{k}")
        after = a._taken(slices, f"y{k + 1}")
    # With Q = Y mix and Z = A A' Q, the term vectors A' Q have the Gram matrix Q' Z, and A times them is Z.
    both = y.select("doc", F.col("y").alias("x")).join(after, "doc")
    cross = sum(_gram(part, width, "x") for part in a.parts(both, a.docs))
    own = _orthonormal(mix.T @ cross, 1e-6)  # as 1e-12 of the squares between rounds
    z = own.T @ _gram(after, width) @ own
    value, side = np.linalg.eigh((z + z.T) / 2)
    order = np.argsort(-value)[:dim]
    order = order[value[order] > max(value.max(), 0) * 1e-12]
    singular = np.sqrt(value[order])
    own = own @ side[:, order] / singular[None, :]
    ids = F.broadcast(a.ids) if row_count_at_most(a.ids, BROADCAST_MAX_ROWS) else a.ids
    documents = _unpacked(after, "doc", own).join(ids, "doc").select("doc_id", "embedding")
    return TermVectors(a.terms.select("term", "idf"), singular, documents, index, a, y, mix @ own)


def encode(counts: DataFrame, fitted: TermVectors, key: str, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """(key, embedding) of texts given as ``counts(key, term, tf)``; texts without known terms are missing."""
    ship(counts.sparkSession)
    hashed = counts.select(key, F.xxhash64("term").alias("term"), F.col("tf").cast("double").alias("tf"))
    matrix, needs = _blocks(_weights(hashed, fitted.idf, key), key, block_docs)
    kind = counts.schema[key].dataType.simpleString()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        y, _ = _product(left, right)
        names = left.column(key)
        out = _vector_table("term", np.arange(len(y)), y)
        return pa.table({key: names, "embedding": out.column("embedding")})

    vectors = fitted.of(needs.select("term").distinct())
    near = needs.join(vectors, "term").select("block", "term", "embedding")
    return matrix.groupBy("block").cogroup(near.groupBy("block")).applyInArrow(run, f"{key} {kind}, embedding array<double>")


def encode_documents(index: TextIndex, fitted: TermVectors, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """(doc_id, embedding) of the indexed documents; the fit has made those of its own index."""
    if index is fitted.index:
        return fitted.documents
    return encode(index.postings.select("doc_id", "term", "tf"), fitted, "doc_id", block_docs)


def encode_queries(queries: DataFrame, fitted: TermVectors, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """(qid, embedding) of ``queries(qid, text)``."""
    terms = queries.select("qid", F.explode(tokens("text")).alias("term"))
    return encode(terms.groupBy("qid", "term").agg(F.count(F.lit(1)).alias("tf")), fitted, "qid", block_docs)
