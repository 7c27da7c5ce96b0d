"""Judgements from passage containment: ``label = 1`` when a document's text
contains a query passage verbatim.

Many patterns against many texts is a multi-pattern substring search, which Spark has
no join for (a ``contains`` condition would be a nested-loop join over all pairs). It is
made an equality join on anchors. Words are runs of letters and digits. If a passage
stands in a text, its first and last word may be parts of longer words there, but the
words between stand there whole and in sequence. So every sequence of ``ANCHOR_WORDS``
inner words of the passage is one of the text.

1. The texts' word sequences that occur in some passage are found in one scan and stored
   as (document, hash) rows; texts stay where they lie.
2. Each passage's anchor is its sequence in the fewest documents; a passage of which
   some sequence occurs nowhere is in no document.
3. Documents and passages meet on the anchor, the texts of the documents that met some
   passage are fetched, and ``contains`` verifies every pair.

Passage-side tables are broadcast after a size check; beyond it the joins shuffle, and
anchors in more than ``HOT_DOCS`` documents are dealt over ``HOT_PARTS`` parts, so a passage
that a third of all texts share is no hot key. All of this stays in the JVM.

Passages with no inner word (two words or fewer, as a rule) have no anchor. They are
searched by a multi-pattern automaton, broadcast when they are few, else by bounded
chunks against bounded shards of the texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import TOKEN_SEPARATOR
from quarry.plans.sizing import BROADCAST_MAX_ROWS, cut_lineage, row_count_at_most
from quarry.shipping import ship

# Words of an anchor; passages with fewer inner words have shorter ones.
ANCHOR_WORDS = 3
# An anchor in more documents is dealt over so many parts, where nothing is broadcast.
HOT_DOCS = 100_000
HOT_PARTS = 32
# Bound on the characters of passages broadcast in one chunk.
MAX_CHUNK_CHARS = 32_000_000

try:  # C automaton if present; exact pure-Python fallback otherwise.
    import ahocorasick as _ac
except ImportError:  # pragma: no cover
    _ac = None


def _matcher(patterns: dict[str, list]):
    """Return ``find(text) -> iterable of qids`` for the pattern -> qids map."""
    empty_qids = patterns.get("", [])
    keys = [p for p in patterns if p]
    if _ac is not None and keys:
        auto = _ac.Automaton()
        for p in keys:
            auto.add_word(p, p)
        auto.make_automaton()

        def find(text):
            seen = {v for _, v in auto.iter(text)}
            for p in seen:
                yield from patterns[p]
            yield from empty_qids
    else:
        def find(text):
            for p in keys:
                if p in text:
                    yield from patterns[p]
            yield from empty_qids
    return find


def _scan(documents: DataFrame, chunk: list[tuple], qid_type: str, did_type: str) -> DataFrame:
    spark = documents.sparkSession
    ship(spark)
    patterns: dict[str, list] = {}
    for qid, text in chunk:
        patterns.setdefault(text, []).append(qid)
    bc = spark.sparkContext.broadcast(patterns)

    def run(batches):
        import pandas as pd

        find = _matcher(bc.value)
        for pdf in batches:
            q, d = [], []
            for did, text in zip(pdf["doc_id"], pdf["text"]):
                if text is None:
                    continue
                for qid in find(text):
                    q.append(qid)
                    d.append(did)
            yield pd.DataFrame({"qid": q, "did": d})

    return documents.select("doc_id", "text").mapInPandas(run, f"qid {qid_type}, did {did_type}")


def _scan_groups(documents: DataFrame, passages: DataFrame, n_chunks: int, qid_type: str, did_type: str) -> DataFrame:
    ship(documents.sparkSession)
    n_shards = max(1, documents.rdd.getNumPartitions())
    # distinct column names on the two sides (a shared attribute would be
    # dropped from one side of the cogroup)
    p = passages.select(
        "qid", F.col("text").alias("ptext"),
        F.pmod(F.xxhash64("text"), F.lit(n_chunks)).alias("chunk"),
        F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("shard"))
    d = documents.select(
        "doc_id", F.col("text").alias("dtext"),
        F.pmod(F.xxhash64("doc_id"), F.lit(n_shards)).alias("shard"),
        F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1))).alias("chunk"))

    def run(ppdf, dpdf):
        import pandas as pd

        if ppdf.empty or dpdf.empty:
            return pd.DataFrame({"qid": [], "did": []})
        patterns: dict[str, list] = {}
        for qid, text in zip(ppdf["qid"], ppdf["ptext"]):
            patterns.setdefault(text, []).append(qid)
        find = _matcher(patterns)
        q, dd = [], []
        for did, text in zip(dpdf["doc_id"], dpdf["dtext"]):
            if text is None:
                continue
            for qid in find(text):
                q.append(qid)
                dd.append(did)
        return pd.DataFrame({"qid": q, "did": dd})

    return p.groupBy("chunk", "shard").cogroup(d.groupBy("chunk", "shard")).applyInPandas(
        run, f"qid {qid_type}, did {did_type}")


def _sequences(words, size: int):
    """Hashes of all sequences of ``size`` words of an array; none where there are fewer."""
    at = F.sequence(F.lit(1), F.size(words) - size + 1)
    return F.when(F.size(words) >= size, F.transform(at, lambda i: F.xxhash64(F.slice(words, i, F.lit(size))))).otherwise(
        F.array().cast("array<bigint>"))


def _hinted(side: DataFrame, max_rows: int) -> tuple[DataFrame, bool]:
    small = row_count_at_most(side, max_rows)
    return (F.broadcast(side) if small else side), small


def _anchored(documents: DataFrame, passages: DataFrame, max_broadcast_rows: int, hot_docs: int) -> DataFrame:
    """(qid, did) for ``passages(qid, text, inner)``, ``inner`` the array of inner words, not empty."""
    passages = passages.withColumn("p", F.xxhash64("text"))  # with qid it names the passage
    size = F.least(F.size("inner"), F.lit(ANCHOR_WORDS))
    by_size = [F.when(size == n, _sequences(F.col("inner"), n)) for n in range(1, ANCHOR_WORDS + 1)]
    grams = cut_lineage(passages.select("qid", "p", size.alias("size"), F.explode(F.array_distinct(F.coalesce(*by_size))).alias("h")).distinct())
    sizes = [r["size"] for r in grams.select("size").distinct().collect()]  # at most ANCHOR_WORDS rows
    wanted, _ = _hinted(grams.select("h").distinct(), max_broadcast_rows)
    docs = documents.select("doc_id", "text").filter(F.col("text").isNotNull()).withColumn("t", F.xxhash64("text"))
    words = docs.select("doc_id", "t", F.split("text", TOKEN_SEPARATOR).alias("words"))
    hashes = F.concat(*[_sequences(F.col("words"), n) for n in sorted(sizes)]) if sizes else F.array().cast("array<bigint>")
    met = words.select("doc_id", "t", F.explode(F.array_distinct(hashes)).alias("h")).join(wanted, "h", "left_semi")
    met = cut_lineage(met)  # narrow rows: the texts are not carried along
    df = met.groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    df, _ = _hinted(df, max_broadcast_rows)
    found = grams.join(df, "h", "left")
    least = found.groupBy("qid", "p").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "h")).alias("least"))
    anchors = cut_lineage(least.filter("least.df > 0").select("qid", "p", F.col("least.h").alias("h"), F.col("least.df").alias("df")))
    side, small = _hinted(anchors.select("qid", "p", "h"), max_broadcast_rows)
    if small:
        pairs = met.join(side, "h")
    else:
        parts = F.when(F.col("df") > hot_docs, HOT_PARTS).otherwise(1)
        side = anchors.select("qid", "p", "h", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
        hot = anchors.filter(F.col("df") > hot_docs).select("h", F.lit(HOT_PARTS).alias("parts")).distinct()
        own = F.pmod(F.xxhash64("doc_id", "t"), F.coalesce("parts", F.lit(1))).cast("int")
        pairs = met.join(F.broadcast(hot) if row_count_at_most(hot, BROADCAST_MAX_ROWS) else hot, "h", "left").withColumn(
            "part", own).join(side, ["h", "part"])
    # Documents that repeat an id are told apart by their texts.
    pairs = cut_lineage(pairs.select("qid", "p", "doc_id", "t").distinct())
    texts, _ = _hinted(passages.select("qid", "p", F.col("text").alias("passage")).distinct(), max_broadcast_rows)
    mine = pairs.select("qid", "p", F.col("doc_id").alias("own"), F.col("t").alias("own_t"))
    mine, _ = _hinted(mine, max_broadcast_rows)
    full = docs.join(mine, F.col("doc_id").eqNullSafe(F.col("own")) & (F.col("t") == F.col("own_t")))
    return full.join(texts, ["qid", "p"]).filter(F.contains("text", "passage")).select("qid", F.col("doc_id").alias("did"))


def passage_judgements(documents: DataFrame, passages: DataFrame, max_chunk_chars: int = MAX_CHUNK_CHARS,
                       max_broadcast_rows: int = BROADCAST_MAX_ROWS, hot_docs: int = HOT_DOCS) -> DataFrame:
    """``(qid, did, label)`` for every document containing a passage.

    ``documents(doc_id, text)``, ``passages(qid, text)``; one row per (passage, document
    row) pair, identical passages kept per qid, rows that repeat a passage under its qid
    counted once. ``max_chunk_chars`` bounds the characters of passages without an anchor
    that one task holds.
    """
    qid_type = passages.schema["qid"].dataType.simpleString()
    did_type = documents.schema["doc_id"].dataType.simpleString()
    words = F.split("text", TOKEN_SEPARATOR)
    inner = F.when(F.size(words) > 2, F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0))))
    sized = passages.filter(F.col("text").isNotNull()).select("qid", "text", inner.alias("inner"))
    # Blank-only pieces cannot stand between two separators, so inner words are not empty.
    out = _anchored(documents, sized.filter(F.size("inner") > 0), max_broadcast_rows, hot_docs)
    bare = sized.filter(F.col("inner").isNull()).select("qid", "text")
    facts = bare.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")).first()
    if facts["n"] and facts["n"] <= max_broadcast_rows and (facts["chars"] or 0) <= max_chunk_chars:
        chunk = [(r["qid"], r["text"]) for r in bare.collect()]
        out = out.unionByName(_scan(documents.select("doc_id", "text"), chunk, qid_type, did_type))
    elif facts["n"]:
        n_chunks = max(1, -(-int(facts["chars"] or 0) // max_chunk_chars))
        out = out.unionByName(_scan_groups(documents.select("doc_id", "text"), bare, n_chunks, qid_type, did_type))
    return out.withColumn("label", F.lit(1))
