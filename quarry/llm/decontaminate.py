"""Benchmark decontamination: BM25 index of the test items, queried by every passage.

Passages are windows of words: twice as long as the longest item and moved on by that
length, so every place where an item can stand lies inside one passage. The inverted
index holds the impact of every (term, item), divided by the item's own score, so that
one threshold serves all items; items are grouped into blocks and every term knows its
largest impact overall and per block.

A passage is a query of its distinct terms, taken as in block-max WAND, vectorised over
all passages of a text block: with the terms ordered by largest impact, those before the
pivot cannot reach (a fixed share of) the threshold together; only blocks that a later term occurs in are
looked at, their bound is the block maxima of the later terms plus all that the earlier
ones can add, and only blocks whose bound reaches the threshold are scored exactly.
Nothing above the threshold is lost and nothing is cut to a top-k. Retrieved pairs are
verified: the shares of the question's and of the answer's word five-grams that the
passage holds must both reach ``OVERLAP``.

The index is built per shard of the test items (``SHARD_BYTES`` of text, a bound on what
is sent to executors); statistics cover all items. Documents are read where they lie.

Defined results: null texts hold no passage; items without words never match; an item of
one sentence takes its last quarter of words as the answer; shorter parts than five words
are compared as one gram; repeated rows of a document or item give repeated matches;
empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._common import blocks, keep, prepare, stored, texts_of

K1 = 1.2
B = 0.75
#: Share of an item's own score that a passage must reach to be verified.
THRESHOLD = 0.5
#: The terms before the pivot may add up to this share of the threshold: the smaller,
#: the tighter the bounds of the blocks, and the more terms are looked up for them.
PIVOT = 0.15
GRAM = 5
OVERLAP = 0.8
#: Items per block of the index.
ITEMS_PER_BLOCK = 8
SHARD_BYTES = 16 << 20
#: Items of a shard are at most so many times longer than its class begins.
LENGTHS = 4

WORD = re.compile(r"\w+")
SENTENCE = re.compile(r"(?<=[.!?])\s+")
MATCHES = "doc_id long, item_id long, passage_start long, score double, share double, question_overlap double, answer_overlap double"


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """Words of all sentences but the last, and of the last; a single sentence gives
    its last quarter of words as the answer."""
    sentences = [w for w in map(words_of, SENTENCE.split(text)) if w]
    if not sentences:
        return [], []
    if len(sentences) > 1:
        return [w for s in sentences[:-1] for w in s], sentences[-1]
    cut = len(sentences[0]) - max(1, len(sentences[0]) // 4)
    return sentences[0][:cut], sentences[0][cut:]


def grams(words: list[str], n: int) -> set[tuple[str, ...]]:
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)}


def overlap(part: list[str], passage: list[str], n: int = GRAM) -> float:
    """Share of the part's n-grams that stand in the passage; 1 for an empty part."""
    n = min(n, len(part))
    wanted = grams(part, n) if n else set()
    return len(wanted & grams(passage, n)) / len(wanted) if wanted else 1.0


@dataclass
class ItemIndex:
    """Postings of one shard: rows of a term lie together, ordered by item."""

    vocabulary: dict[str, int]
    starts: np.ndarray  # of each term's postings, one more at the end
    items: np.ndarray
    impacts: np.ndarray  # divided by the item's own score
    block_starts: np.ndarray  # of each term's blocks, one more at the end
    blocks: np.ndarray
    block_max: np.ndarray
    block_from: np.ndarray  # first posting of each (term, block)
    entry_key: np.ndarray  # term and block of each such entry as one number
    term_max: np.ndarray
    ids: list[int]
    own_score: np.ndarray
    parts: list[tuple[list[str], list[str]]]
    longest: int


def build_index(ids: list[int], texts: list[str], frequency: dict[str, int], n_items: int, mean_length: float,
                per_block: int = ITEMS_PER_BLOCK) -> ItemIndex:
    vocabulary: dict[str, int] = {}
    rows = []
    words = [words_of(t) for t in texts]
    for i, ws in enumerate(words):
        count: dict[str, int] = {}
        for w in ws:
            count[w] = count.get(w, 0) + 1
        for w, tf in count.items():
            idf = np.log(1 + (n_items - frequency[w] + 0.5) / (frequency[w] + 0.5))
            rows.append((vocabulary.setdefault(w, len(vocabulary)), i,
                         idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(ws) / mean_length))))
    term, item, impact = (np.array(c) for c in zip(*rows)) if rows else (np.zeros(0, "int64"),) * 2 + (np.zeros(0),)
    own = np.bincount(item, weights=impact, minlength=len(ids))
    order = np.lexsort((item, term))
    term, item, impact = term[order], item[order], impact[order]
    impact = impact / own[item]
    size = len(vocabulary)
    # Terms are numbered by their largest impact, so sorted numbers are in the order of the pivot.
    largest = np.maximum.reduceat(impact, np.searchsorted(term, np.arange(size))) if size else impact
    number = np.empty(size, "int64")
    number[np.argsort(largest, kind="stable")] = np.arange(size)
    vocabulary = {w: int(number[t]) for w, t in vocabulary.items()}
    term = number[term]
    order = np.lexsort((item, term))
    term, item, impact = term[order], item[order], impact[order]
    block = item // per_block
    first = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (block[1:] != block[:-1])])) if len(term) else np.zeros(0, "int64")
    return ItemIndex(
        vocabulary, np.searchsorted(term, np.arange(size + 1)), item, impact,
        np.searchsorted(term[first], np.arange(size + 1)), block[first],
        np.maximum.reduceat(impact, first) if len(term) else impact, np.concatenate([first, [len(term)]]),
        term[first] * (int(block.max()) + 1 if len(block) else 1) + block[first],
        np.sort(largest), list(ids), own, [question_and_answer(t) for t in texts], max(map(len, words), default=0))


def spread(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, index) for the ranges start..start+length of every row."""
    row = np.repeat(np.arange(len(starts)), lengths)
    ends = np.cumsum(lengths)
    return row, np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - lengths, lengths) + starts[row]


def retrieve(index: ItemIndex, texts: list[str], threshold: float = THRESHOLD):
    """Every (text, window start, item, share of own score) at or above the threshold."""
    empty = (np.zeros(0, "int64"),) * 3 + (np.zeros(0),)
    stride, size = index.longest, len(index.vocabulary)
    if not size:
        return empty
    get, found, segment, owner, first = index.vocabulary.get, [], [], [], 0
    for i, t in enumerate(texts):
        ws = words_of(t)
        ids = np.fromiter(map(get, ws, repeat(-1)), "int64", len(ws))
        at = np.flatnonzero(ids >= 0)
        found.append(ids[at])
        segment.append(first + at // stride)
        n = -(-len(ws) // stride) if ws else 0
        owner.append(np.column_stack([np.full(n + 1, i), (np.arange(n + 1)) * stride]))  # one segment apart from the next text
        first += n + 1
    terms, segments, owner = np.concatenate(found), np.concatenate(segment), np.concatenate(owner)
    # Window s covers segments s and s + 1; the separating segment starts no window.
    keys = np.concatenate([segments * size + terms, ((segments - 1) * size + terms)[owner[segments, 1] > 0]])
    keys.sort()
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys
    window, term = keys // size, keys % size  # by window, then by largest impact
    low = threshold * (1 - 1e-9)

    # The pivot of a window is where the sum of its largest impacts reaches its share of the threshold.
    starts = np.flatnonzero(np.concatenate([[True], window[1:] != window[:-1]])) if len(window) else np.zeros(0, "int64")
    if not len(starts):
        return empty
    bound = index.term_max[term]
    run = np.cumsum(bound)
    counts = np.diff(np.append(starts, len(window)))
    run -= np.repeat(run[starts] - bound[starts], counts)
    essential = run >= PIVOT * low
    # What the terms before the pivot can add at most; less than that share of the threshold.
    rest = np.maximum.reduceat(np.where(essential, 0.0, run), starts)
    place = np.repeat(np.arange(len(starts)), counts)

    # Bounds of the blocks that essential terms occur in.
    e = np.flatnonzero(essential)
    n_blocks = int(index.blocks.max()) + 1
    row, entry = spread(index.block_starts[term[e]], np.diff(index.block_starts)[term[e]])
    pair, back = np.unique(place[e][row] * n_blocks + index.blocks[entry], return_inverse=True)
    upper = np.bincount(back, weights=index.block_max[entry], minlength=len(pair)) + rest[pair // n_blocks]
    pair = pair[upper >= low]
    if not len(pair):
        return empty

    # Exact scores in the blocks that are left: all terms of the window, all items of the block.
    w, b = pair // n_blocks, pair % n_blocks
    row, at = spread(starts[w], counts[w])
    wanted = term[at] * n_blocks + b[row]
    entry = np.minimum(np.searchsorted(index.entry_key, wanted), len(index.entry_key) - 1)
    there = index.entry_key[entry] == wanted
    row, entry = row[there], entry[there]
    row2, posting = spread(index.block_from[entry], index.block_from[entry + 1] - index.block_from[entry])
    n_items = len(index.ids)
    hit, back = np.unique(w[row[row2]] * n_items + index.items[posting], return_inverse=True)
    score = np.bincount(back, weights=index.impacts[posting], minlength=len(hit))
    hit, score = hit[score >= low], score[score >= low]
    where = owner[window[starts[hit // n_items]]]
    return where[:, 0], where[:, 1], hit % n_items, score


def matches_of(index: ItemIndex, texts: list[str], threshold: float, least: float) -> list[tuple]:
    """(text, item, window start, share, question overlap, answer overlap): the best
    verified passage of every text and item."""
    best: dict[tuple[int, int], tuple] = {}
    words: dict[int, list[str]] = {}
    for i, start, item, share in zip(*(a.tolist() for a in retrieve(index, texts, threshold))):
        ws = words.get(i)
        if ws is None:
            words = {i: (ws := words_of(texts[i]))}  # hits come by text
        passage = ws[start:start + 2 * index.longest]
        question, answer = index.parts[item]
        q, a = overlap(question, passage), overlap(answer, passage)
        if q >= least and a >= least and (share, -start) > best.get((i, item), (-1.0, 0))[:2]:
            best[i, item] = (share, -start, q, a)
    return [(i, item, -start, share, q, a) for (i, item), (share, start, q, a) in sorted(best.items())]


def indexes(items: DataFrame, shard_bytes: int = SHARD_BYTES) -> Iterator[ItemIndex]:
    """The index of each shard of ``items(item_id, text)``, one at a time; counts cover all items.

    A shard holds items of one length class: up to ``LENGTHS`` times the median number of words,
    and each further class up to ``LENGTHS`` times the one before. Passages are twice the
    longest item of a shard, so a very long item does not stretch those of the others."""
    spark = prepare(items)
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text IS NOT NULL")

    def analysed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            words = [words_of(t) for t in texts_of(block)]
            yield pa.RecordBatch.from_arrays(
                [*block.columns, pa.array(list(map(len, words)), pa.int64()), pa.array([sorted(set(w)) for w in words], pa.list_(pa.string()))],
                names=["item_id", "text", "n", "terms"])

    counted = stored(items.mapInArrow(analysed, "item_id long, text string, n long, terms array<string>").filter("n > 0"), "item-terms")
    facts = counted.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("words"), F.percentile_approx("n", 0.5).alias("median")).first()
    if not facts["n"]:
        return
    longer = F.log(F.col("n") / F.lit(LENGTHS * facts["median"])) / np.log(LENGTHS)
    classed = counted.withColumn("class", F.greatest(F.ceil(longer - 1e-9), F.lit(0)).cast("int"))
    sizes = classed.groupBy("class").agg(F.sum(F.octet_length("text")).alias("bytes")).orderBy("class").collect()  # a row per class
    frequency = stored(counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")), "item-counts")
    for size in sizes:
        shards = max(1, -(-size["bytes"] // shard_bytes))
        for s in range(shards):
            part = classed.filter((F.col("class") == size["class"]) & (F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == s))
            df = {r["term"]: r["df"] for r in frequency.join(
                part.select(F.explode("terms").alias("term")).distinct(), "term").collect()}  # bounded by the shard
            rows = part.select("item_id", "text").orderBy("item_id", "text").toArrow()
            if rows.num_rows:
                yield build_index(rows.column("item_id").to_pylist(), rows.column("text").to_pylist(), df,
                                  facts["n"], facts["words"] / facts["n"])


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, least: float = OVERLAP,
                 shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Verified matches of ``docs(doc_id, text)`` with ``items(item_id, text)``, one row
    per document and item: its best passage, raw BM25 score and both overlaps."""
    spark = prepare(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = spark.createDataFrame([], MATCHES)
    for index in indexes(items, shard_bytes):
        sent = spark.sparkContext.broadcast(index)  # bounded by the shard

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for block in blocks(batches):
                ids = block.column(0).to_pylist()
                rows = [(ids[i], index.ids[item], start, share * float(index.own_score[item]), share, q, a)
                        for i, item, start, share, q, a in matches_of(index, texts_of(block), threshold, least)]
                names = [c.split(" ")[0] for c in MATCHES.split(", ")]
                kinds = [pa.int64()] * 3 + [pa.float64()] * 4
                columns = list(zip(*rows)) or [()] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        out = out.unionByName(rows.mapInArrow(run, MATCHES))
    return out


def clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, least: float = OVERLAP,
          shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Rows of ``docs`` without a verified match, all columns; decided where the rows lie."""
    spark = prepare(docs)
    for index in indexes(items, shard_bytes):
        sent = spark.sparkContext.broadcast(index)
        docs = keep(docs, lambda texts, sent=sent: _without(matches_of(sent.value, texts, threshold, least), len(texts)))
    return docs


def _without(matches: list[tuple], n: int) -> np.ndarray:
    mask = np.ones(n, bool)
    mask[[m[0] for m in matches]] = False
    return mask
