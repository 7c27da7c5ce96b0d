"""Token ids in seekable zstandard files, one independent frame per document.

File layout (every part is a valid zstandard or skippable frame, so plain
zstandard tools can read it):

* one frame per document: its ids as little-endian unsigned integers of
  ``width`` bytes (2 while every id fits, else 4), end id included;
* a directory frame: for each document its ``doc_id`` (8 bytes, signed) and one
  byte that is 0 where the id is null, then one byte ``width``;
* the seek table: a skippable frame (magic 0x184D2A5E) with (compressed size,
  plain size, checksum) per frame, the number of frames, a descriptor byte and
  the magic 0x8F92EAB1. The checksum is the low half of XXH64 of the plain bytes.

A reader fetches the last 9 bytes, then the table, then only the frames of the
documents it wants.

Defined results: null text counts as empty (its row holds the end id only);
documents are ordered by (doc_id, hash of the text, text), null ids first, and
dealt by ranges of (doc_id, hash of the text), so rows that share one id, or have
none, spread over many tasks (only repeats of one text under one id stay
together); repeated rows are kept, each with its own frame; a special token's
string inside a text becomes that token, as the library does by default
(``plain_special=True``: it is ordinary text); an empty table gives no files and
no rows; further columns are ignored.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm._common import blocks, filesystem, prepare, stored
from quarry.llm.pieces import BLOCK_BYTES, CACHE_PIECES, PieceCache

#: Fixed values of the seekable zstandard format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80
#: A task closes a file and opens the next beyond this size.
FILE_BYTES = 64 << 20
ZSTD_LEVEL = 3
#: New pieces encoded by one call.
JOINED = 64

MANIFEST = "file string, first_doc long, part int, seq int, n_docs long, n_tokens long"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"

_ENCODERS: dict[tuple[str, bool, int], tuple[PieceCache, int]] = {}


def text_encoder(path: str, plain_special: bool = False, pieces_kept: int = CACHE_PIECES) -> tuple[PieceCache, int]:
    """(encoder of whole texts, bytes per id) for a tokenizers file, once per process.
    ``plain_special``: the strings of special tokens are ordinary text."""
    own = (path, plain_special, pieces_kept)
    if own not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = plain_special
        width = 2 if max(tok.get_vocab().values()) < 1 << 16 else 4
        kind = {2: "H", 4: "I"}[width]

        def whole(texts: list[str]) -> list[bytes]:
            return [array(kind, e.ids).tobytes() for e in tok.encode_batch_fast(texts, add_special_tokens=False)]

        def pieces(parts: list[str]) -> list[bytes]:
            """Parts joined by line breaks, so that one call encodes many."""
            joined = ["\n".join(parts[i:i + JOINED]) for i in range(0, len(parts), JOINED)]
            out: list[bytes] = []
            for e in tok.encode_batch_fast(joined, add_special_tokens=False):
                ids = e.ids
                packed, at, start = array(kind, ids).tobytes(), -1, 0
                for _ in range(ids.count(line_break)):
                    at = ids.index(line_break, at + 1)
                    out.append(packed[start:at * width])
                    start = (at + 1) * width
                out.append(packed[start:])
            return out

        spec = json.loads(tok.to_str())
        pre = spec.get("pre_tokenizer") or {}
        split = (spec.get("normalizer") is None and pre.get("type") == "ByteLevel"
                 and pre.get("use_regex", True) and not pre.get("add_prefix_space"))
        if split:
            [line_break] = tok.encode("\n", add_special_tokens=False).ids
        added = [t["content"] for t in spec.get("added_tokens", []) if not (plain_special and t.get("special"))]
        # Pieces of other tokenizers do not stand alone; nor do those of texts that hold an added token.
        cache = PieceCache(pieces, whole, limit=pieces_kept, split=split, whole_if=added)
        _ENCODERS[own] = (cache, width)
    return _ENCODERS[own]


class FrameWriter:
    """Writes one file: frames, directory, seek table."""

    def __init__(self, url: str, width: int, level: int = ZSTD_LEVEL):
        import zstandard

        self.fs, self.path = filesystem(url)
        self.tmp = f"{self.path}.{uuid.uuid4().hex}.tmp"  # a repeated task never mixes with a lost one
        self.out = self.fs.open_output_stream(self.tmp)
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.width, self.entries, self.docs, self.bytes = width, [], [], 0

    def _frame(self, plain: bytes) -> None:
        import xxhash

        packed = self.zstd.compress(plain)
        self.out.write(packed)
        self.bytes += len(packed)
        self.entries.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self._frame(ids)
        self.docs.append(doc_id)

    def close(self) -> None:
        ids = np.array([d or 0 for d in self.docs], "<i8").tobytes()
        valid = bytes(d is not None for d in self.docs)
        self._frame(ids + valid + bytes([self.width]))
        table = np.array(self.entries, "<u4").tobytes()
        foot = struct.pack("<IBI", len(self.entries), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table) + len(foot)) + table + foot)
        self.out.close()
        self.fs.move(self.tmp, self.path)


class FrameReader:
    """Random access to the documents of one file; checks every frame it reads."""

    def __init__(self, url: str):
        import zstandard

        fs, path = filesystem(url)
        self.file = fs.open_input_file(path)
        self.zstd = zstandard.ZstdDecompressor()
        size = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE_MAGIC or not flags & CHECKSUM_FLAG:
            raise ValueError(f"{url}: no seek table")
        self.entries = np.frombuffer(self.file.read_at(12 * n, size - 9 - 12 * n), "<u4").reshape(n, 3)
        self.offsets = np.concatenate([[0], np.cumsum(self.entries[:, 0], dtype="int64")])
        directory, m = self._plain(n - 1), n - 1
        self.width = directory[-1]
        valid = directory[8 * m:9 * m]
        self.docs = [int(d) if ok else None for d, ok in zip(np.frombuffer(directory, "<i8", m), valid)]

    def _plain(self, i: int) -> bytes:
        import xxhash

        packed_size, plain_size, check = map(int, self.entries[i])
        plain = self.zstd.decompress(self.file.read_at(packed_size, int(self.offsets[i])), max_output_size=plain_size)
        if len(plain) != plain_size or xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {i} is damaged")
        return plain

    def ids(self, i: int) -> np.ndarray:
        """Ids of document ``i`` of the file; no other document is read."""
        return np.frombuffer(self._plain(i), f"<u{self.width}").astype("<u4")

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0,
                      file_bytes: int = FILE_BYTES, partitions: int | None = None, plain_special: bool = False) -> DataFrame:
    """Encode ``docs(doc_id, text)`` into files below ``folder``, in doc_id order.

    Texts are range-partitioned and sorted by (doc_id, hash of the text) once; each task
    then encodes and writes its range as a stream. Returns the stored manifest, one row
    per file.
    """
    spark = prepare(docs)
    fs, path = filesystem(folder)
    fs.create_dir(path, recursive=True)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    rows = rows.repartitionByRange(*([partitions] if partitions else []), "doc_id", "text_hash")
    rows = rows.sortWithinPartitions("doc_id", "text_hash", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, width = text_encoder(tokenizer, plain_special)
        end = np.array([end_id], f"<u{width}").tobytes()
        part, out, made, tokens = TaskContext.get().partitionId(), None, [], 0

        def close() -> None:
            out.close()
            made.append({"file": name, "first_doc": out.docs[0], "part": part, "seq": len(made),
                         "n_docs": len(out.docs), "n_tokens": tokens})

        for block in blocks(batches, max_bytes=BLOCK_BYTES):
            for doc_id, ids in zip(block.column(0).to_pylist(), cache.encode(block.column(1))):
                if out is None:
                    name, tokens = f"{folder}/part-{part:06d}-{len(made):04d}.ids.zst", 0
                    out = FrameWriter(name, width)
                out.add(doc_id, ids + end)
                tokens += len(ids) // width + 1
                if out.bytes >= file_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        schema = pa.schema([("file", pa.string()), ("first_doc", pa.int64()), ("part", pa.int32()),
                            ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
        if made:
            yield pa.RecordBatch.from_pylist(made, schema)

    return stored(rows.mapInArrow(write, MANIFEST), "token-manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it),
    n_tokens, ids_crc32. The running total runs over the manifest, one row per file."""
    spark = prepare(manifest)
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("start"))
    # One file per task: the files are the unit of work, their rows are tiny.
    files = stored(files, "token-files").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with FrameReader(file) as r:
                    n, crc = [], []
                    for i in range(len(r.docs)):
                        ids = r.ids(i)
                        n.append(len(ids))
                        crc.append(zlib.crc32(ids.tobytes()))
                    ends = start + np.cumsum(n, dtype="int64")
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(r.docs, pa.int64()), pa.array(ends - n, pa.int64()), pa.array(n, pa.int64()),
                         pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.mapInArrow(read, ROWS)


def directory(manifest: DataFrame) -> DataFrame:
    """(file, frame, doc_id) of every document: of each file only its directory is read."""
    spark = prepare(manifest)
    files = manifest.select("file").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                with FrameReader(file) as r:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([file] * len(r.docs)), pa.array(np.arange(len(r.docs), dtype="int32")), pa.array(r.docs, pa.int64())],
                        names=["file", "frame", "doc_id"])

    return files.mapInArrow(read, "file string, frame int, doc_id long")


def read_documents(manifest: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, ids) of the ``wanted(doc_id)`` documents only: besides the directories
    just their frames are read."""
    ids = wanted.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    hits = directory(manifest).join(ids, "doc_id").repartition("file").sortWithinPartitions("file", "frame")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, opened = None, None
        for batch in batches:
            rows = []
            for doc_id, file, frame in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if file != opened:
                    if reader:
                        reader.file.close()
                    reader, opened = FrameReader(file), file
                rows.append((doc_id, reader.ids(frame).tolist()))
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.list_(pa.int64()))],
                                             names=["doc_id", "ids"])

    return hits.select("doc_id", "file", "frame").mapInArrow(read, "doc_id long, ids array<long>")


def token_table(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, **options) -> DataFrame:
    """Write the files and read them back."""
    return read_token_files(write_token_files(docs, folder, tokenizer, end_id, **options))
