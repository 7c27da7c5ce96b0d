"""Byte-level BPE by replaying the merges over the distinct words of a corpus part.

Words (matches of the split pattern) are independent of each other under BPE, so
each task replays the merge list over the distinct words of its own documents:
an inverted index from the rank of a token pair to the positions where the pair
stands; ranks are taken in order from a heap, every position of a rank is merged,
and only the two neighbours of a merged position get new index entries. No word
ever moves between tasks, so nothing is shuffled and the result does not depend
on the partitioning. Finished words are kept in a bounded cache.

Defined results: null text counts as empty (no ids; digests of nothing); every
row gives one row, repeated rows included; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._common import blocks, give_back, prepare
from quarry.llm.pieces import PieceCache

#: Words whose merges are replayed together; bounds the arrays of positions.
REPLAYED = 300_000

#: Looked-up pairs kept between replays.
KNOWN_PAIRS = 300_000
#: Pieces kept per worker process; their words need no replay.
CACHE_PIECES = 150_000

#: Text whose distinct pieces are encoded together: a fifth of what the token files take,
#: since the replay's arrays come on top; smaller blocks replay more often.
BLOCK_BYTES = 3 << 20

DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks file: base64 token and rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Merges:
    """Merge list: ranks of tokens, tokens of ranks, ranks of pairs (looked up once)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.token[rank] = token
        self.byte = [ranks.get(bytes([b]), -1) for b in range(256)]
        self.pairs: dict[int, int] = {}

    def pair(self, a: int, b: int) -> int:
        """Rank of the merge of tokens ``a`` and ``b``, -1 if there is none."""
        key = a << 32 | b
        rank = self.pairs.get(key)
        if rank is None:
            rank = self.pairs[key] = self.ranks.get(self.token[a] + self.token[b], -1)
        return rank

    def ranks_of(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Ranks of the merges of two arrays of tokens, -1 where there is none."""
        if len(first) < 16:
            return np.array([self.pair(a, b) for a, b in zip(first.tolist(), second.tolist())], "int64")
        keys, group = np.unique(first << 32 | second, return_inverse=True)
        return np.array([self.pair(k >> 32, k & 0xFFFFFFFF) for k in keys.tolist()], "int64")[group]

    def replay(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word after all merges, in rank order over all words at once."""
        lengths = np.array([len(w) for w in words], "int64")
        ends = np.cumsum(lengths)
        raw = np.frombuffer(b"".join(words), "uint8")
        where = np.arange(len(raw))
        last = np.zeros(len(raw) + 1, bool)
        last[ends[lengths > 0] - 1] = True
        last = last[:-1]
        # Token at each position (-1: merged away); next and previous living position of the word.
        sym = np.array(self.byte, "int64")[raw]
        right = np.where(last, -1, where + 1)
        left = np.where(np.concatenate([[True], last[:-1]])[:len(raw)], -1, where - 1)
        index: dict[int, list[np.ndarray]] = {}  # rank of a pair -> positions where it may stand
        heap: list[int] = []
        doubtful: list[np.ndarray] = []

        def add(at: np.ndarray, ranks: np.ndarray) -> None:
            at, ranks = at[ranks >= 0], ranks[ranks >= 0]
            if len(at) > 1:
                order = np.argsort(ranks, kind="stable")
                at, ranks = at[order], ranks[order]
            cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(at)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if b > a:
                    rank = int(ranks[a])
                    if rank not in index:
                        index[rank] = []
                        heapq.heappush(heap, rank)
                    index[rank].append(at[a:b])

        at = where[~last]
        add(at, self.ranks_of(sym[at], sym[at + 1]) if len(at) else at)
        while heap:
            rank = heapq.heappop(heap)
            todo = index.pop(rank)
            at = np.concatenate(todo) if len(todo) > 1 else todo[0]
            if len(at) > 1:
                at = np.unique(at)
            at = at[right[at] >= 0]  # dead positions have no neighbour
            at = at[self.ranks_of(sym[at], sym[right[at]]) == rank]  # an earlier merge may have taken one of the two
            if not len(at):
                continue
            if len(at) > 1:  # of overlapping places every second one, leftmost first
                chained = np.concatenate([[False], right[at[:-1]] == at[1:]])
                if chained.any():
                    order = np.arange(len(at))
                    at = at[(order - np.maximum.accumulate(np.where(chained, 0, order))) % 2 == 0]
            gone = right[at]
            after = right[gone]
            sym[at], sym[gone] = rank, -1
            right[at], right[gone] = after, -1
            left[after[after >= 0]] = at[after >= 0]
            # Only the touched neighbours get new entries.
            before = left[at]
            new = np.concatenate([at[after >= 0], before[before >= 0]])
            if len(new):
                ranks = self.ranks_of(sym[new], sym[right[new]])
                if ((ranks >= 0) & (ranks < rank)).any():  # not in merge lists that were learnt merge by merge
                    doubtful.append(new[(ranks >= 0) & (ranks < rank)])
                add(new, ranks)
        alive = sym >= 0
        count = np.concatenate([[0], np.cumsum(alive)])
        ids = sym[alive].tolist()
        out = [ids[a:b] for a, b in zip(count[ends - lengths].tolist(), count[ends].tolist())]
        for w in np.unique(np.searchsorted(ends, np.concatenate(doubtful), side="right")).tolist() if doubtful else []:
            out[w] = self.replay_one(words[w])
        return out

    def replay_one(self, word: bytes) -> list[int]:
        """One word by itself: its lowest pair first, leftmost of equals."""
        ids = [self.byte[b] for b in word]
        while len(ids) > 1:
            ranks = [(r, i) for i, r in enumerate(map(self.pair, ids, ids[1:])) if r >= 0]
            if not ranks:
                break
            rank, i = min(ranks)
            ids[i:i + 2] = [rank]
        return ids

    def encode_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """Ids of distinct words, packed as little-endian 4-byte numbers; a word that is a
        token itself is that token."""
        if len(self.pairs) > KNOWN_PAIRS:
            self.pairs.clear()
        done, rest = {}, []
        for w in words:
            rank = self.ranks.get(w.encode())
            if rank is None:
                rest.append(w)
            else:
                done[w] = rank.to_bytes(4, "little")
        for at in range(0, len(rest), REPLAYED):
            part = rest[at:at + REPLAYED]
            done.update((w, array("I", ids).tobytes()) for w, ids in zip(part, self.replay([w.encode() for w in part])))
        return done

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


_CODECS: dict[tuple[str, str], tuple[Merges, PieceCache]] = {}


def codec(path: str, pattern: str) -> tuple[Merges, PieceCache]:
    """(merges, encoder of whole texts to little-endian 4-byte ids), once per process."""
    if (path, pattern) not in _CODECS:
        import regex

        merges, split = Merges(read_ranks(path)), regex.compile(pattern)

        def whole(texts: list[str]) -> list[bytes]:
            words = [split.findall(t) for t in texts]
            ids = merges.encode_words(set().union(*words))
            return [b"".join(map(ids.__getitem__, ws)) for ws in words]

        def pieces(parts: list[str]) -> list[bytes]:
            """Parts joined by line breaks, so that one pass splits them all."""
            words = split.findall("\n".join(parts))
            ids = merges.encode_words(set(words))
            out, start = [], 0
            for _ in range(len(parts) - 1):
                at = words.index("\n", start)
                out.append(b"".join(map(ids.__getitem__, words[start:at])))
                start = at + 1
            return [*out, b"".join(map(ids.__getitem__, words[start:]))] if parts else []

        _CODECS[path, pattern] = (merges, PieceCache(pieces, whole, limit=CACHE_PIECES))
    return _CODECS[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) of every whole text of ``docs(doc_id, text)``."""
    prepare(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, cache = codec(path, pattern)
        for block in blocks(batches, max_bytes=BLOCK_BYTES):
            ids = [np.frombuffer(x, "<u4").astype("int32") for x in cache.encode(block.column(1))]
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of ``encoded(doc_id, ids)``; bytes that are no UTF-8 become U+FFFD."""
    prepare(encoded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = Merges(read_ranks(path))
        for batch in batches:
            texts = [merges.decode(x or []).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode, decode, and digest both: doc_id, n_tokens, ids_sha256 (decimal ids
    joined by one blank), decoded_sha256 (decoded bytes)."""
    prepare(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, cache = codec(path, pattern)
        decimal = [str(i) for i in range(len(merges.token))]
        for block in blocks(batches, max_bytes=BLOCK_BYTES):
            n, of_ids, of_bytes = [], [], []
            for packed in cache.encode(block.column(1)):
                ids = np.frombuffer(packed, "<u4").tolist()
                n.append(len(ids))
                of_ids.append(hashlib.sha256(" ".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                of_bytes.append(hashlib.sha256(merges.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()),
                                              pa.array(of_bytes, pa.string())],
                                             names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, DIGESTS)
