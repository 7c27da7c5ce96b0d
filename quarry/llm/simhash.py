"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A fingerprint of 64 bits is eight positional bytes. Two fingerprints at most ``d``
bits apart differ in at most ``d`` bytes, so they share at least ``8 - d`` bytes at
equal positions: the guaranteed minimum of matches. The index has a list for every
set of one position fewer than that minimum, and its bytes: with ``d = 4`` a list of
every three positions. A pair that reaches the minimum meets in several lists. Where it
meets, its shared positional bytes are tallied; pairs below the minimum, which share just
the bytes of the list, are dropped, and the others are verified by their bit distance.

Copies cost nothing: only distinct fingerprints are indexed. Lists with a single
fingerprint are dropped by a pre-aggregated count before any row is joined; long
lists are cut into blocks that meet pairwise, and a block pair reports a spanning
forest, not its pairs, so the links grow with the rows and connectivity is kept.
Components are found by alternating star contractions with a stored table per round.

Defined results: null and empty texts have the fingerprint zero and link like any
other; null doc_ids are kept as rows but never name a component unless nothing else
can; repeated rows are kept; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._common import blocks, give_back, prepare, stored, texts_of

SHINGLE = 4
DISTANCE = 4
SEED = 42
BYTES = 8
#: Shingles hashed at once; a longer text is counted in stretches.
STRETCH = 1 << 17
#: Fingerprints of one list compared by one task at once; longer lists are cut in blocks.
BLOCK = 2048
#: Lists up to this length report each link; longer ones a spanning forest.
SHORT = 12


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Bit i is 1 if it is set in over half of the shingle hashes."""
    import xxhash

    words = text.encode().lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), "int64", len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    count = np.zeros(64, "int64")
    for at in range(0, n, STRETCH):
        stop = min(n, at + STRETCH)
        last = ends[min(shingle, len(words)) - 1:][at:stop]
        parts = [joined[a:b] for a, b in zip(starts[at:stop].tolist(), last.tolist())]
        h = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), "<u8", len(parts))
        bits = np.unpackbits(h.view("u1").reshape(-1, 8), axis=1, bitorder="little")
        count += np.add.reduce(bits, axis=0, dtype="uint32")
    return int(np.packbits(2 * count > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, t1, t2, fp): 96 bits of hashes of the text and the 64 bits as a signed long."""
    prepare(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            fp = np.array([fingerprint(t, shingle) for t in texts_of(block)], "<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([block.column(0), *block.columns[2:], pa.array(fp)],
                                             names=["doc_id", "t1", "t2", "fp"])
        give_back()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *_text_key())
    return rows.mapInArrow(run, "doc_id long, t1 long, t2 int, fp long")


def _text_key() -> list[F.Column]:
    """Two hashes that tell texts apart; null and empty texts differ."""
    return [F.xxhash64("text").alias("t1"), F.hash("text").alias("t2")]


def _lists(fps: DataFrame, matches: int) -> DataFrame:
    """(subset, bytes, fp): every list that a fingerprint stands in."""
    masks = [sum(0xFF << 8 * p for p in positions) for positions in combinations(range(BYTES), matches)]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    keys = F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in signed]))
    return fps.select(keys.alias("subset", "bytes"), "fp")


def _links_of(key: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified links of the lists in sorted arrays (one key value per list)."""
    matches, out = BYTES - distance, []

    def verified(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x = a ^ b
        tally = np.count_nonzero(x.reshape(-1, 1).view("u1").reshape(*x.shape, 8) == 0, axis=-1)
        return (tally >= matches) & (np.bitwise_count(x) <= distance)

    bounds = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
    length = np.repeat(np.diff(bounds), np.diff(bounds))
    for step in range(1, SHORT):
        i = np.flatnonzero((key[step:] == key[:-step]) & (length[step:] <= SHORT))
        if not len(i):
            break
        ok = verified(fp[i], fp[i + step]) if len(i) else np.zeros(0, bool)
        out.append((fp[i[ok]], fp[i[ok] + step]))
    for start, stop in zip(bounds[:-1], bounds[1:]):
        if stop - start > SHORT:
            out.append(_forest(fp[start:stop], verified))
    if not out:
        return np.zeros(0, "u8"), np.zeros(0, "u8")
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def _forest(fp: np.ndarray, verified) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of one list: search from each unseen fingerprint in turn."""
    rest, a, b = fp, [], []
    while len(rest) > 1:
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            near = np.zeros(len(rest), "int64")
            for at in range(0, len(front), 256):  # bounded comparison matrix
                part = front[at:at + 256]
                hit = verified(part[:, None] + np.zeros_like(rest)[None, :], np.broadcast_to(rest, (len(part), len(rest))))
                found = hit.any(axis=0) & (near == 0)
                near[found] = at + hit.argmax(axis=0)[found] + 1
            new = near > 0
            a.append(front[near[new] - 1])
            b.append(rest[new])
            front, rest = rest[new], rest[~new]
    return (np.concatenate(a), np.concatenate(b)) if a else (fp[:0], fp[:0])


def links(fps: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """(a, b): links between distinct fingerprints ``fps(fp)`` at most ``distance`` bits
    apart, enough of them that their components are those of all such links."""
    prepare(fps)
    if not 0 < distance < BYTES:
        raise ValueError("distance must be 1 to 7: beyond it no byte is sure to match")
    lists = _lists(fps, max(1, BYTES - distance - 1))
    sizes = lists.groupBy("subset", "bytes").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    # Spark sizes the lists as if a fingerprint stood in one of them: without the hint it broadcasts them all.
    met = lists.hint("merge").join(sizes, ["subset", "bytes"])
    parts = F.ceil(F.col("size") / block).cast("int")
    own = F.pmod(F.xxhash64("fp"), parts).cast("int")
    met = met.select("subset", "bytes", "fp", parts.alias("parts"), own.alias("own"))
    # Each block of a list meets every block of it, itself included, once.
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.select("subset", "bytes", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fp")
    # One number per meeting; fingerprints of two meetings that share it are told apart by the key columns.
    met = met.repartition("subset", "bytes", "lo", "hi").sortWithinPartitions("subset", "bytes", "lo", "hi", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, ...] | None = None

        def found(cols: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            subset, data, lo, hi, fp = cols
            change = np.concatenate([[False], np.any([c[1:] != c[:-1] for c in (subset, data, lo, hi)], axis=0)])
            a, b = _links_of(np.cumsum(change), fp.view("u8"), distance)
            return pa.RecordBatch.from_arrays([pa.array(a.view("i8")), pa.array(b.view("i8"))], names=["a", "b"])

        for batch in batches:
            cols = tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if held is not None:
                cols = tuple(np.concatenate([h, c]) for h, c in zip(held, cols))
            if not len(cols[0]):
                continue
            # The last meeting may go on in the next batch.
            same = np.all([c == c[-1] for c in cols[:4]], axis=0)
            cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            if cut:
                yield found(tuple(np.ascontiguousarray(c[:cut]) for c in cols))
            held = tuple(c[cut:].copy() for c in cols)
        if held is not None and len(held[0]):
            yield found(held)
        give_back()

    made = met.mapInArrow(run, "a long, b long")
    return made.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, root): root is the smallest node reachable. Alternating large-star and
    small-star contractions; each round's links are written to the shared folder."""
    edges = stored(edges.filter("a != b").distinct(), "links")
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("m").alias("a"), "b").filter("a != b").distinct()
        # every link now points from a smaller to a larger node
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        joined = large.join(low, "b")
        small = joined.filter("a != m").select(F.col("m").alias("a"), F.col("a").alias("b"))
        small = small.unionByName(low.select(F.col("m").alias("a"), "b")).distinct()
        edges = stored(small, "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))


def _rooted(docs: DataFrame, shingle: int, distance: int) -> tuple[DataFrame, DataFrame]:
    """The rows of ``fingerprints``, and (fp, first, root): the smallest doc_id with each
    fingerprint and the smallest fingerprint of its component."""
    marked = stored(fingerprints(docs, shingle), "fingerprints")
    fps = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    linked = components(links(fps.select("fp"), distance))
    return marked, fps.join(linked, fps["fp"] == linked["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs(doc_id, text)``."""
    marked, rooted = _rooted(docs, shingle, distance)
    names = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(names, "root").select(F.col("fp").alias("fp_"), "component_id")
    return marked.join(named, marked["fp"] == named["fp_"], "left").select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """Rows of ``docs``, all columns, that stand for their group: of each component exactly one
    row, that with the smallest doc_id (null ids last), among rows of one id that with the
    smallest hash of the text. Rows of one id whose texts lie in different components stay
    each for its own; a group without any id keeps one row."""
    marked, rooted = _rooted(docs.select("doc_id", "text"), shingle, distance)
    # Two steps: the smallest row of each fingerprint combines in the tasks before any join.
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "t1", "t2")
    least = marked.groupBy("fp").agg(F.min(own).alias("row"))
    kept = least.join(rooted.select("fp", "root"), "fp").groupBy("root").agg(F.min("row").alias("row"))
    kept = kept.select(F.col("row.doc_id").alias("_kept"), F.col("row.t1").alias("_t1"), F.col("row.t2").alias("_t2"))
    t1, t2 = _text_key()
    keyed = docs.withColumns({"_own1": t1, "_own2": t2})
    rows = keyed.join(kept, F.col("doc_id").eqNullSafe(F.col("_kept")) & (F.col("_own1") == F.col("_t1"))
                      & (F.col("_own2") == F.col("_t2")), "left_semi")
    return rows.dropDuplicates(["doc_id", "_own1", "_own2"]).drop("_own1", "_own2")


def hex_digits(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
