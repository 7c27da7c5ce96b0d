"""Inverted index over a corpus table, built with DataFrame jobs.

Layout (document-partitioned, as search engines shard):

* ``postings(doc_id, dl, term, tf)`` -- hash-partitioned on ``doc_id``. The
  raw ``(doc_id, text)`` rows are shuffled once (text is smaller than
  postings) and tokenised after the shuffle; a text's sorted tokens give its
  terms and their counts where it lies. What is kept is one row per document
  with two arrays; the postings are exploded from it. Rows of an id that repeats
  are counted together by a grouping on ``(doc_id, dl, term)`` instead, which
  needs no second exchange either. The document length rides in every posting,
  so scoring never joins a per-document table.
* ``doc_ids(doc_id)`` -- every document, empty ones included (for ``N``).
* ``terms(term, df)`` -- document frequency; partial aggregation before the
  shuffle makes frequent terms cost one row per partition, not per document.
  A search that needs few terms of an index not read from storage counts these in
  the postings and leaves the rest of the vocabulary alone.
* ``stats()`` -- ``(N, avgdl)`` collected once as two scalars; ``avgdl`` is the
  sum of all term counts over ``N``, so no second pass tokenises the corpus.

Tokens are the non-empty pieces of ``split(lower(text), separator)``; with a
``+`` separator, empty pieces can only be the first and the last, so the length
is computed arithmetically and the empties are dropped by a plain filter after
the explode -- all of it whole-stage code-generated.

Build once (persisted by default), or store with ``save_as_tables`` (bucketed
by ``doc_id``, keeps the partitioning) or ``write``/``read``; query many times.
Document ids are taken as unique keys of the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import TOKEN_SEPARATOR
from quarry.plans.sizing import BROADCAST_MAX_ROWS, row_count_at_most


@dataclass
class TextIndex:
    postings: DataFrame
    doc_ids: DataFrame
    terms: DataFrame
    # True when postings/terms are materialised (persisted or read back): then
    # document frequencies come from the small ``terms`` table; otherwise they
    # are counted only for the needed terms from the postings.
    materialised: bool = False
    # What ``persist`` keeps of the postings, if not their rows; then ``terms`` is
    # counted by its first use, and few needed terms do not call for it.
    kept: list[DataFrame] | None = None
    _stats: tuple[int, float] | None = field(default=None, repr=False)

    def stats(self) -> tuple[int, float]:
        """(number of documents, average document length in tokens)."""
        if self._stats is None:
            n = self.doc_ids.count()
            total = self.postings.agg(F.sum("tf")).first()[0] or 0
            self._stats = (int(n), float(total) / n if n else 0.0)
        return self._stats

    @property
    def doc_lengths(self) -> DataFrame:
        """``(doc_id, dl)`` of every document (0 for a text without tokens)."""
        with_tokens = self.postings.select("doc_id", "dl").distinct()
        return self.doc_ids.join(with_tokens, "doc_id", "left").select(
            "doc_id", F.coalesce("dl", F.lit(0)).alias("dl"))

    def collection_stats(self) -> DataFrame:
        """One row ``(n_docs, avgdl)`` as a DataFrame (``stats()`` gives scalars)."""
        return self.doc_lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))

    def persist(self) -> "TextIndex":
        for df in (*self._kept(), self.terms):
            df.persist()
        self.materialised = True
        return self

    def unpersist(self) -> None:
        for df in (*self._kept(), self.terms):
            df.unpersist()

    def _kept(self) -> list[DataFrame]:
        return [self.postings] if self.kept is None else self.kept

    def write(self, path: str, mode: str = "overwrite") -> None:
        """Write the tables as parquet, postings sorted by term per file, which
        compresses them; a search still reads all postings. Only bucketed tables
        (``save_as_tables``) keep the document partitioning."""
        self.postings.sortWithinPartitions("term").write.mode(mode).parquet(f"{path}/postings")
        self.doc_ids.write.mode(mode).parquet(f"{path}/doc_ids")
        self.terms.write.mode(mode).parquet(f"{path}/terms")
        self._stats_frame().write.mode(mode).parquet(f"{path}/stats")

    def _stats_frame(self) -> DataFrame:
        n, avgdl = self.stats()
        return self.postings.sparkSession.createDataFrame([(n, avgdl)], "n_docs bigint, avgdl double")

    @staticmethod
    def _read_stats(df: DataFrame) -> tuple[int, float]:
        row = df.first()  # one row, written with the index
        return int(row["n_docs"]), float(row["avgdl"])

    def save_as_tables(self, prefix: str, buckets: int, mode: str = "overwrite") -> None:
        """Store as catalog tables with postings bucketed by ``doc_id`` (sorted by
        term inside each bucket): read back, the postings keep their document
        partitioning, so searches sum per hit without any shuffle."""
        (self.postings.write.mode(mode).bucketBy(buckets, "doc_id").sortBy("term")
         .saveAsTable(f"{prefix}_postings"))
        self.terms.write.mode(mode).saveAsTable(f"{prefix}_terms")
        self.doc_ids.write.mode(mode).saveAsTable(f"{prefix}_doc_ids")
        self._stats_frame().write.mode(mode).saveAsTable(f"{prefix}_stats")

    @staticmethod
    def from_tables(spark: SparkSession, prefix: str) -> "TextIndex":
        return TextIndex(
            postings=spark.table(f"{prefix}_postings"),
            doc_ids=spark.table(f"{prefix}_doc_ids"),
            terms=spark.table(f"{prefix}_terms"),
            materialised=True,
            _stats=TextIndex._read_stats(spark.table(f"{prefix}_stats")),
        )

    @staticmethod
    def read(spark: SparkSession, path: str) -> "TextIndex":
        return TextIndex(
            postings=spark.read.parquet(f"{path}/postings"),
            doc_ids=spark.read.parquet(f"{path}/doc_ids"),
            terms=spark.read.parquet(f"{path}/terms"),
            materialised=True,
            _stats=TextIndex._read_stats(spark.read.parquet(f"{path}/stats")),
        )

    def of_terms(self, needed_terms: DataFrame, small: bool) -> "TextIndex":
        """An index to search for the distinct ``needed_terms(term)`` alone; may be this one."""
        return self

    def doc_freqs(self, needed_terms: DataFrame, small: bool) -> DataFrame:
        """``(term, df)`` for the distinct ``needed_terms(term)``.

        ``small`` (proven by a row-count check) lets the term list be broadcast.
        """
        hint = F.broadcast if small else (lambda d: d)
        if self.materialised and not (small and self.kept is not None):
            return self.terms.join(hint(needed_terms), "term")
        return (
            self.postings.join(hint(needed_terms), "term")
            .groupBy("term")
            .agg(F.count(F.lit(1)).alias("df"))
        )


def _by_doc(df: DataFrame, shards: int | None) -> DataFrame:
    return df.repartition(shards, "doc_id") if shards else df.repartition("doc_id")


def build_index(corpus: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                shards: int | None = None, persist: bool = True,
                stopwords: list[str] | None = None) -> TextIndex:
    """Index ``corpus(id_col, text_col)``.

    ``shards`` fixes the number of document shards; by default there are
    ``spark.sql.shuffle.partitions``, which adaptive execution merges where the
    texts are small but never splits: give ``shards`` for a large corpus.

    ``persist`` (default) caches postings and terms (memory and disk): the
    first use materialises them and every later pass -- statistics, document
    frequencies, matching, feedback -- reads the cache instead of tokenising
    the corpus again; lost blocks are recomputed from lineage.

    ``stopwords`` (off by default) are dropped before counting, so document
    lengths count the kept tokens only; pass the same list to the query side."""
    ids = corpus.select(F.col(id_col).alias("doc_id"))
    rows = corpus.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    repeated = ids.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("doc_id").alias("again"))
    if repeated.isEmpty():
        kept = [_counted(_pieces(rows, shards, stopwords))]
        postings = _exploded(kept[0])
    else:
        again = F.broadcast(repeated) if row_count_at_most(repeated, BROADCAST_MAX_ROWS) else repeated
        same = F.col("doc_id").eqNullSafe(F.col("again"))
        kept = [_counted(_pieces(rows.join(again, same, "left_anti"), shards, stopwords)),
                _grouped(_pieces(rows.join(again, same, "left_semi"), shards, stopwords))]
        postings = _exploded(kept[0]).unionByName(kept[1])
    counted = postings.select("term")
    if not persist:  # nothing is kept that could be counted: the texts' distinct tokens do, unsorted and not dealt by id
        once = rows if len(kept) == 1 else rows.join(again, same, "left_anti")
        counted = _distinct_terms(_split(once, stopwords))
        counted = counted if len(kept) == 1 else counted.unionByName(kept[1].select("term"))
    terms = counted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    index = TextIndex(postings=postings, doc_ids=ids, terms=terms, kept=kept)
    return index.persist() if persist else index


def _pieces(rows: DataFrame, shards: int | None, stopwords: list[str] | None) -> DataFrame:
    """``(doc_id, dl, pieces)`` of ``rows(doc_id, text)``, dealt by ``doc_id``; ``pieces`` may hold empty ones."""
    return _split(_by_doc(rows, shards), stopwords)


def _split(rows: DataFrame, stopwords: list[str] | None) -> DataFrame:
    pieces = F.split(F.lower(F.col("text")), TOKEN_SEPARATOR)
    n_pieces = F.size("pieces")
    dl = (n_pieces - F.when(F.col("pieces")[0] == "", 1).otherwise(0)
          - F.when((n_pieces > 1) & (F.element_at("pieces", -1) == ""), 1).otherwise(0))
    if stopwords:
        stop = F.array(*[F.lit(w) for w in sorted(set(stopwords))])
        pieces = F.filter(pieces, lambda t: (t != "") & ~F.array_contains(stop, t))
        dl = F.size("pieces")
    return (
        rows
        .select("doc_id", pieces.alias("pieces"))
        .select("doc_id", F.coalesce(dl, F.lit(0)).cast("int").alias("dl"), "pieces")
    )


def _counted(docs: DataFrame) -> DataFrame:
    """``(doc_id, dl, terms, tfs)``: in its sorted tokens, a term's count is the way to the next term's start."""
    words = docs.select("doc_id", "dl", F.sort_array(F.filter("pieces", lambda t: t != "")).alias("words"))
    at = F.transform("words", lambda w, i: i)
    first = words.select("doc_id", "dl", "words", F.filter(at, lambda i: (i == 0) | (
        F.get("words", i) != F.get("words", i - 1))).alias("first"))
    return first.select(
        "doc_id", "dl", F.transform("first", lambda i: F.get("words", i)).alias("terms"),
        F.transform("first", lambda i, j: F.coalesce(F.get("first", j + 1), F.size("words")) - i).alias("tfs"))


def _distinct_terms(docs: DataFrame) -> DataFrame:
    return docs.select(F.explode_outer(F.array_distinct("pieces")).alias("term")).filter(F.col("term") != "")


def _exploded(counted: DataFrame) -> DataFrame:
    # The outer form: from a plain explode Catalyst infers a filter on the array's size and pushes it
    # below the steps that made the array, which it then makes anew for every element.
    return (counted.select("doc_id", "dl", "tfs", F.posexplode_outer("terms").alias("at", "term"))
            .filter(F.col("term").isNotNull()).select("doc_id", "dl", "term", F.get("tfs", F.col("at")).alias("tf")))


def _grouped(docs: DataFrame) -> DataFrame:
    """Postings whose rows of one id and length are counted together."""
    # explode_outer + plain filter: a plain explode makes Catalyst infer a
    # size() > 0 filter and push it below the shuffle, which would split every
    # text twice, once before the documents are spread out.
    return (
        docs.select("doc_id", "dl", F.explode_outer("pieces").alias("term"))
        .filter(F.col("term") != "")
        .groupBy("doc_id", "dl", "term")
        .agg(F.count(F.lit(1)).cast("int").alias("tf"))
    )
