"""Periodic runs of words: suffix automaton with link-cut access over its suffix links.

A run is a maximal stretch of words with smallest period q that is at least two periods
and ``MIN_WORDS`` long. Its words are appended one by one to a suffix automaton. The path
from a prefix's state to the root holds all suffixes of the prefix; an access, as in a
link-cut tree, recolours this path with the prefix's end. The path falls into segments of
one colour: suffixes of lengths (lo, hi] last seen to end at e. If the new end is i and
``lo < i - e <= hi``, the last ``i - e`` words stood right before themselves: a square, whose
root is primitive since it occurs nowhere in between. Every run shows this way at each place
where one of its squares ends; the first place extends it to both sides by comparing words.
The links do not change once the automaton is complete, so the preferred paths lie as
stacks of segments on the heavy paths of its tree, and an access needs no rotations.

Before, texts are narrowed, without loss, to the stretches that can hold a run: in a run
every word lies in a repeated sequence of six words, since ``length - q >= 6`` words of it
equal the words q later. Sequences are compared by 64-bit hashes, of a whole block of
texts at once and again inside each stretch until nothing changes; a clash only leaves a
stretch longer.

Rows are independent: no shuffle, no hot key, and a lost task is simply run again. A task
holds a block of texts of about 4 MB, or one longer text, and the automaton of one stretch
at a time (about 1 KB a word of a stretch).

Defined results: null, empty and blank texts have no words and no runs; a null doc_id is
kept (and never changed by ``planted``); repeated rows give a row each; an empty table gives
an empty result; further columns, whatever their names, are ignored. Equal runs cannot
occur twice; runs are listed by start, then period.
"""

from __future__ import annotations

import itertools
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._common import blocks, prepare, texts_of

MIN_WORDS = 12
#: Words of a sequence that a run must repeat: MIN_WORDS // 2.
SEQUENCE = MIN_WORDS // 2
FOUND = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
#: Odd multipliers of the hashes (fixed values, any odd numbers do).
ODD = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93,
                0xA0761D6478BD642F, 0xE7037ED1A0B428DB], "u8")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * ODD[3]
    return x ^ (x >> np.uint64(29))


def suffix_links(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(suffix link and longest length of each state, state of each prefix) of the automaton."""
    after: list[dict[int, int]] = [{}]
    link, length, prefix = [-1], [0], []
    last = 0
    for word in words:
        state = len(link)
        after.append({})
        link.append(0)
        length.append(length[last] + 1)
        at = last
        while at >= 0 and word not in after[at]:
            after[at][word] = state
            at = link[at]
        if at >= 0:
            target = after[at][word]
            if length[target] == length[at] + 1:
                link[state] = target
            else:
                copy = len(link)
                after.append(after[target].copy())
                link.append(link[target])
                length.append(length[at] + 1)
                while at >= 0 and after[at].get(word) == target:
                    after[at][word] = copy
                    at = link[at]
                link[target] = link[state] = copy
        prefix.append(state)
        last = state
    return link, length, prefix


def heavy_heads(link: list[int], length: list[int]) -> list[int]:
    """For each state the top of its heavy path: towards the child with most states below."""
    order = np.argsort(np.array(length), kind="stable").tolist()
    below = [1] * len(link)
    best, heavy = [0] * len(link), [-1] * len(link)
    for s in reversed(order[1:]):
        up = link[s]
        below[up] += below[s]
        if below[s] > best[up]:
            best[up], heavy[up] = below[s], s
    head = list(range(len(link)))
    for s in order:
        if heavy[s] >= 0:
            head[heavy[s]] = head[s]
    return head


def squares(words: list[int]) -> Iterator[tuple[int, int]]:
    """(end, period) of squares with a primitive root, in order of their ends."""
    link, length, prefix = suffix_links(words)
    head = heavy_heads(link, length)
    paths: list[list[tuple[int, int]]] = [[] for _ in link]  # by head: (bottom length, last end), topmost segment last
    for i, state in enumerate(prefix):
        while state > 0:
            top, longest = head[state], length[state]
            segments, lo = paths[top], length[link[top]] if top else 0
            while segments and lo < longest:
                bottom, end = segments[-1]
                if lo < i - end <= min(bottom, longest):
                    yield i, i - end
                if bottom > longest:
                    break  # the rest of this segment keeps its colour
                segments.pop()
                lo = bottom
            segments.append((longest, i))
            state = link[top]


def _same(words: np.ndarray, at: int, period: int, step: int) -> int:
    """How many words from ``at`` on, in direction ``step``, equal the word a period before them."""
    done, size = 0, 64
    while True:
        room = len(words) - at if step > 0 else at - period + 1
        if room <= 0:
            return done
        size = min(size, room)
        part = slice(at, at + size) if step > 0 else slice(at - size + 1, at + 1)
        back = slice(part.start - period, part.stop - period)
        equal = words[part] == words[back]
        equal = equal if step > 0 else equal[::-1]
        if not equal.all():
            return done + int(np.argmin(equal))
        done, at, size = done + size, at + step * size, size * 4


def runs_of(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a sequence of word numbers."""
    found, ends = [], {}
    for i, period in squares(words.tolist()):
        if i <= ends.get(period, -1):
            continue
        first = i - _same(words, i, period, -1) - period + 1
        last = i + _same(words, i + 1, period, 1)
        ends[period] = last
        if last - first + 1 >= max(MIN_WORDS, 2 * period):
            found.append((first, last - first + 1, period))
    return found


def stretches(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, stops) of the stretches that can hold runs, of texts laid end to end in
    ``words`` with ``bounds`` between them."""
    starts, stops = bounds[:-1], bounds[1:]
    mixed = _mixed(words.astype("u8") + np.uint64(1))
    grams = np.zeros(max(0, len(words) - SEQUENCE + 1), "u8")
    for j in range(SEQUENCE):
        grams += _mixed(mixed[j:j + len(grams)] * ODD[j])
    before = -1
    while True:
        long = stops - starts >= MIN_WORDS
        starts, stops = starts[long], stops[long]
        total = int((stops - starts).sum())
        if total == before or not total:
            return starts, stops
        before = total
        n = stops - starts - SEQUENCE + 1
        label = np.repeat(np.arange(len(n)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts, n)
        key = _mixed(grams[at] + label.astype("u8") * ODD[0])
        order = np.argsort(key)
        equal = key[order[1:]] == key[order[:-1]]
        again = np.zeros(len(key), bool)
        again[order[1:][equal]] = True
        again[order[:-1][equal]] = True
        # A word is covered if one of the sequences that hold it is repeated; stretches never join.
        new = at[again]
        cover = np.zeros(len(words) + 1, "int64")
        np.add.at(cover, new, 1)
        np.add.at(cover, new + SEQUENCE, -1)
        covered = np.cumsum(cover)[:-1] > 0
        fresh = np.zeros(len(words) + 1, bool)
        fresh[starts] = fresh[stops] = True
        begins = covered & (fresh[:-1] | ~np.concatenate([[False], covered[:-1]]))
        finishes = covered & (fresh[1:] | ~np.concatenate([covered[1:], [False]]))
        starts, stops = np.flatnonzero(begins), np.flatnonzero(finishes) + 1


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """Places of the original words of a text of ``n`` words for every tenth document by the
    CRC-32 of its id: from a word on its tail repeats with one period. None: left as it is."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def scan(docs: DataFrame, change: Callable[[int | None, int], np.ndarray | None] | None = None) -> DataFrame:
    """doc_id, n_words, runs (start, length, period), collapsed of every row of ``docs(doc_id,
    text)``. ``collapsed`` joins by one blank the words that no run contains behind its first
    period. ``change`` may rearrange the words of a document first."""
    prepare(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            number = defaultdict(itertools.count().__next__)
            texts, parts = [], []
            for doc_id, text in zip(block.column(0).to_pylist(), texts_of(block)):
                words = text.encode().split()  # bytes: only ASCII white space splits
                at = change(doc_id, len(words)) if change else None
                if at is not None:
                    words = [words[i] for i in at.tolist()]
                texts.append(words)
                parts.append(np.fromiter(map(number.__getitem__, words), "int64", len(words)))
            bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype("int64")
            words = np.concatenate(parts)
            found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
            for start, stop in zip(*stretches(words, bounds)):
                doc = int(np.searchsorted(bounds, start, side="right")) - 1
                found[doc].extend((int(start - bounds[doc]) + s, n, p) for s, n, p in runs_of(words[start:stop]))
            runs, kept = [], []
            for of_doc, all_words in zip(found, texts):
                of_doc.sort(key=lambda r: (r[0], r[2]))
                gone = bytearray(len(all_words))
                for s, n, p in of_doc:
                    gone[s + p:s + n] = b"\1" * (n - p)
                left = itertools.compress(all_words, map((0).__eq__, gone)) if of_doc else all_words
                runs.append([{"start": s, "length": n, "period": p} for s, n, p in of_doc])
                kept.append(b" ".join(left).decode())
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [block.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(runs, kind),
                 pa.array(kept, pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, FOUND)


def summary(found: DataFrame) -> DataFrame:
    """Per row of ``scan``: number of runs, the longest run (ties: smallest start, then
    period) and digests of all runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    rows = found.withColumn("best", best)
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.floor(F.expr("best.length * 1000 div -best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
