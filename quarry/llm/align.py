"""Alignment of two tokenizers' tokens on byte offsets, with an identity-map fast path.

Both tokenizers cut the same bytes (a blank and the text). Offsets where tokens of both end
cut a text into groups; a link is a pair of tokens whose byte ranges overlap. Every
elementary stretch between two neighbouring ends belongs to exactly one link, so the links
of a block of texts are found at once by counting along the merged ends.

1. ``encode``: the ids of every text, packed by zstandard, in blocks of about ``BLOCK_BYTES``
   of text, written to the shared folder.
2. ``count_pairs``: an array made before from the vocabularies gives for each A id the B id
   with the same bytes. Groups of one A and one B token that agree with it are counted in a
   vector as long as the vocabulary, one per task; of the other groups each block gives its
   distinct id pairs with their counts, and only these enter the shuffle on pairs.
3. ``align``: the corpus-wide counts of the irregular pairs go back to the blocks that hold
   them, each block meets its own texts, and each text its links' counts. What all tasks
   share is bounded by the vocabularies: the counts of identity pairs (one per A id) and
   the highest count of each B id.

A block holds a bounded stretch of text or one longer text, so no group grows with the
corpus; a pair that stands in every block gives one row a block.

Defined results: texts that are null, empty, or not restored by both tokenizers' bytes have
no tokens: zeros and an empty ``groups``; rows that repeat count once each; null ids are
kept; ties for the highest count all count as best; an empty table gives an empty result;
further columns, whatever their names, are ignored. Special tokens' strings are plain text.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._common import blocks, prepare, stored
from quarry.llm.token_files import text_encoder

ENCODED = "block long, doc_id long, a binary, b binary"
PAIRS = "block long, a int, b int, n long"
#: Text of a block; the arrays that align it take some 60 times as much.
BLOCK_BYTES = 1 << 20
#: Text whose pieces are found by one call of the second tokenizer: its ids come as Python numbers.
PIECE_BYTES = 1 << 19
#: Level of the packed ids.
PACKED = 3
#: Pieces of the first tokenizer kept per worker process, beside the second one's model.
CACHE_PIECES = 100_000
#: The block of identity pairs, which are counted by vectors.
IDENTITY = -1
FIGURES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def byte_level_alphabet() -> dict[str, int]:
    """Byte of each character of a byte-level vocabulary: printable bytes stand for
    themselves, the others for the characters from U+0100 on, in order."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def byte_level_tokens(path: str) -> list[bytes]:
    """Bytes of every id of a byte-level tokenizers file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    alphabet, special = byte_level_alphabet(), {t["id"]: t["content"] for t in spec.get("added_tokens", [])}
    vocabulary = spec["model"]["vocab"]
    tokens = [b""] * (max([*vocabulary.values(), *special]) + 1)
    for token, i in vocabulary.items():
        tokens[i] = token.encode() if i in special else bytes(alphabet[c] for c in token)
    return tokens


def piece_tokens(path: str) -> list[bytes]:
    """Bytes of every id of a sentencepiece model with byte fallback."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]


def identity_map(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """For each A id the B id with the same bytes (of several the last), -1 where there is none."""
    same = {token: i for i, token in enumerate(b) if token}
    return np.array([same.get(token, -1) for token in a], "i8")


class Aligner:
    """Vocabularies of both sides and the alignment of a block of encoded texts."""

    def __init__(self, a: list[bytes], b: list[bytes]):
        self.size = np.array([len(t) for t in a], "i8"), np.array([len(t) for t in b], "i8")
        self.identity = identity_map(a, b)
        ids = [str(i) for i in range(max(len(a), len(b)))]
        self.decimal = pa.array([i + end for end in ",|;" for i in ids], pa.large_string())
        self.n_ids = len(ids)

    def cut(self, a: np.ndarray, b: np.ndarray) -> dict[str, np.ndarray]:
        """Groups and links of texts laid end to end; ``a`` and ``b`` are all their ids."""
        end_a, end_b = np.cumsum(self.size[0][a]), np.cumsum(self.size[1][b])
        is_a, is_b = np.zeros((2, int(end_a[-1]) + 1), bool)  # by byte offset: a token ends here
        is_a[end_a], is_b[end_b] = True, True
        shared_a, shared_b = is_b[end_a], is_a[end_b]
        group_a, group_b = np.cumsum(shared_a) - shared_a, np.cumsum(shared_b) - shared_b
        n_groups = int(shared_a.sum())
        in_a, in_b = np.bincount(group_a, minlength=n_groups), np.bincount(group_b, minlength=n_groups)
        ends = np.flatnonzero(is_a | is_b)
        link_a, link_b = (np.cumsum(here) - here for here in (is_a[ends], is_b[ends]))  # tokens that ended before
        single = (in_a == 1) & (in_b == 1)
        regular = single[group_a[link_a]] & (self.identity[a[link_a]] == b[link_b])
        return {"shared_a": shared_a, "shared_b": shared_b, "group_a": group_a, "group_b": group_b, "in_a": in_a, "in_b": in_b,
                "link_a": link_a, "link_b": link_b, "regular": regular}

    def written(self, a: np.ndarray, b: np.ndarray, cut: dict[str, np.ndarray]) -> tuple[np.ndarray, memoryview]:
        """``a1,a2|b1;...;`` of all texts laid end to end: the ends of the tokens' parts and the bytes."""
        before_a = np.cumsum(cut["in_a"])  # A tokens up to and with each group
        before_b = np.cumsum(cut["in_b"]) - cut["in_b"]  # B tokens before each group
        order = np.empty(len(a) + len(b), "i8")
        order[np.arange(len(a)) + before_b[cut["group_a"]]] = a + self.n_ids * cut["shared_a"]
        order[np.arange(len(b)) + before_a[cut["group_b"]]] = b + 2 * self.n_ids * cut["shared_b"]
        text = self.decimal.take(pa.array(order))
        return np.frombuffer(text.buffers()[1], "i8")[:len(order) + 1], memoryview(text.buffers()[2] or b"")


def encode(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(block, doc_id, a, b): packed little-endian ids of both tokenizers (see ``id_type``) for
    every row of ``docs(doc_id, text)``; both empty where the text has no tokens."""
    prepare(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece
        import zstandard

        pack = zstandard.ZstdCompressor(level=PACKED, write_checksum=False).compress
        cache, width = text_encoder(path_a, plain_special=True, pieces_kept=CACHE_PIECES)
        model = sentencepiece.SentencePieceProcessor(model_file=path_b)
        table_a = pa.array(byte_level_tokens(path_a), pa.large_binary())
        table_b = pa.array(piece_tokens(path_b), pa.large_binary())
        kind_a, kind_b = id_type(len(table_a)), id_type(len(table_b))
        number = TaskContext.get().partitionId() << 32
        for block in blocks(batches, max_bytes=BLOCK_BYTES):
            texts = [x or "" for x in block.column(1).to_pylist()]
            ids_a = [np.frombuffer(x, f"<u{width}") for x in cache.encode(texts, blank=True)]
            ids_b = [np.array(x, "u4") for part in _slices(texts) for x in model.encode(part, num_threads=1)]
            all_a, all_b = _joined(table_a, ids_a), _joined(table_b, ids_b)
            rows_a, rows_b = [], []
            for text, a, b, of_a, of_b in zip(texts, ids_a, ids_b, all_a, all_b):
                raw = b" " + text.encode()
                ok = bool(text) and of_a == raw and of_b == raw
                rows_a.append(pack(a.astype(kind_a).tobytes()) if ok else b"")
                rows_b.append(pack(b.astype(kind_b).tobytes()) if ok else b"")
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(texts), number)), block.column(0), pa.array(rows_a, pa.binary()), pa.array(rows_b, pa.binary())],
                names=["block", "doc_id", "a", "b"])
            number += 1
            del texts, ids_a, ids_b, rows_a, rows_b
            pa.default_memory_pool().release_unused()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ENCODED)


def id_type(size: int) -> str:
    """The stored type of the ids of a vocabulary: two bytes where they fit."""
    return "<u2" if size <= 1 << 16 else "<u4"


def _slices(texts: list[str]) -> Iterator[list[str]]:
    """Texts in parts of about PIECE_BYTES characters."""
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text)
        if size >= PIECE_BYTES:
            yield part
            part, size = [], 0
    if part:
        yield part


def _joined(table: pa.Array, ids: list[np.ndarray]) -> Iterator[bytes]:
    """The bytes of each text's tokens."""
    n = np.cumsum([0, *map(len, ids)])
    text = table.take(pa.array(np.concatenate(ids).astype("i8")))
    ends, data = np.frombuffer(text.buffers()[1], "i8"), memoryview(text.buffers()[2] or b"")
    for a, b in zip(n[:-1], n[1:]):
        yield bytes(data[ends[a]:ends[b]])


def _ids(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(all ids, number of ids of each row) of a binary column of a vocabulary's ids."""
    import zstandard

    kind, unpack = np.dtype(id_type(size)), zstandard.ZstdDecompressor().decompress
    rows = [unpack(r) if r else r for r in column.to_pylist()]
    return np.frombuffer(b"".join(rows), kind).astype("i8"), np.array([len(r) // kind.itemsize for r in rows], "i8")


def count_pairs(encoded: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(block, a, b, n): irregular links by block and id pair, and per task the vector of
    identity groups (``block`` IDENTITY). A block that two tasks read gives rows twice."""
    prepare(encoded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(byte_level_tokens(path_a), piece_tokens(path_b))
        vector = np.zeros(len(aligner.identity), "i8")

        def rows(block, a, b, n) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), block)), pa.array(a, pa.int32()), pa.array(b, pa.int32()),
                                               pa.array(n, pa.int64())], names=["block", "a", "b", "n"])

        for batch in batches:
            of_block = batch.column(0).to_numpy()
            for number in np.unique(of_block).tolist():
                part = batch.filter(pa.array(of_block == number))
                a, b = _ids(part.column(1), len(aligner.size[0]))[0], _ids(part.column(2), len(aligner.size[1]))[0]
                if not len(a):
                    continue
                cut = aligner.cut(a, b)
                one, other, regular = a[cut["link_a"]], b[cut["link_b"]], cut["regular"]
                vector += np.bincount(one[regular], minlength=len(vector))
                keys, n = np.unique(one[~regular] << 32 | other[~regular], return_counts=True)
                yield rows(number, keys >> 32, keys & 0xFFFFFFFF, n)
        met = np.flatnonzero(vector)
        yield rows(IDENTITY, met, aligner.identity[met], vector[met])

    return encoded.select("block", "a", "b").mapInArrow(run, PAIRS)


def align(docs: DataFrame, path_a: str, path_b: str, digest: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, and ``groups`` (text), or with
    ``digest`` its SHA-256 as ``groups_sha256``, of every row of ``docs(doc_id, text)``."""
    encoded = stored(encode(docs, path_a, path_b), "encoded")
    pairs = stored(count_pairs(encoded, path_a, path_b), "pairs")
    # One row per A id at most: proven small.
    regular = F.broadcast(pairs.filter(F.col("block") == IDENTITY).groupBy("a", "b").agg(F.sum("n").alias("regular")))
    irregular = pairs.filter(F.col("block") != IDENTITY)
    totals = irregular.groupBy("a", "b").agg(F.sum("n").alias("n")).join(regular, ["a", "b"], "left")
    totals = stored(totals.select("a", "b", (F.col("n") + F.coalesce("regular", F.lit(0))).alias("total"),
                                  F.col("regular").isNotNull().alias("both")), "totals")
    identity = {r["a"]: r["regular"] for r in regular.collect()}
    identity.update({r["a"]: r["total"] for r in totals.filter("both").collect()})  # one row per A id at most
    best = {r["b"]: r["best"] for r in totals.groupBy("b").agg(F.max("total").alias("best")).collect()}  # one per B id
    a_size, b_size = len(byte_level_tokens(path_a)), len(piece_tokens(path_b))
    same = identity_map(byte_level_tokens(path_a), piece_tokens(path_b))
    of_identity, of_best = np.zeros(a_size, "i8"), np.zeros(b_size, "i8")
    of_identity[list(identity)] = list(identity.values())
    of_best[list(best)] = list(best.values())
    np.maximum.at(of_best, same[same >= 0], of_identity[same >= 0])
    shared = docs.sparkSession.sparkContext.broadcast((of_identity, of_best))
    out = "groups_sha256" if digest else "groups"

    def run(texts: pa.Table, counts: pa.Table) -> pa.Table:
        of_identity, of_best = shared.value
        aligner = _aligner(path_a, path_b)
        (a, n_a), (b, n_b) = (_ids(texts.column(c).combine_chunks(), len(size)) for c, size in zip("ab", aligner.size))
        n = len(n_a)
        figures = {"n_a": n_a, "n_b": n_b} | {f: np.zeros(n, "i8") for f in FIGURES[2:]}
        groups = [""] * n
        if len(a):
            cut = aligner.cut(a, b)
            doc = np.repeat(np.arange(n), n_a)
            one, other, of_link = a[cut["link_a"]], b[cut["link_b"]], doc[cut["link_a"]]
            total = np.where(cut["regular"], of_identity[one], 0)
            rest = ~cut["regular"]
            if rest.any():
                keys = counts.column("a").to_numpy().astype("i8") << 32 | counts.column("b").to_numpy().astype("i8")
                order = np.argsort(keys)
                at = np.searchsorted(keys[order], one[rest] << 32 | other[rest])
                total[rest] = counts.column("total").to_numpy()[order][at]
            tally = lambda rows: np.bincount(rows, minlength=n).astype("i8")
            figures["n_groups"] = tally(doc[cut["shared_a"]])
            figures["n_links"] = tally(of_link)
            figures["n_best"] = tally(of_link[total == of_best[other]])
            np.add.at(figures["count_sum"], of_link, total)
            ends, text = aligner.written(a, b, cut)
            stops = np.cumsum(n_a + n_b)
            for i in np.flatnonzero(n_a).tolist():
                part = text[ends[stops[i] - n_a[i] - n_b[i]]:ends[stops[i]] - 1]
                groups[i] = hashlib.sha256(part).hexdigest() if digest else bytes(part).decode()
        return pa.table([texts.column("doc_id"), *[pa.array(figures[f], pa.int64()) for f in FIGURES], pa.array(groups, pa.string())],
                        names=["doc_id", *FIGURES, out])

    back = irregular.select("block", "a", "b").join(totals.select("a", "b", "total"), ["a", "b"])
    schema = ", ".join(["doc_id long", *[f"{f} long" for f in FIGURES], f"{out} string"])
    return encoded.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(run, schema)


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def _aligner(path_a: str, path_b: str) -> Aligner:
    """Once per worker process."""
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(byte_level_tokens(path_a), piece_tokens(path_b))
    return _ALIGNERS[path_a, path_b]
