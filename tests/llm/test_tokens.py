import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from quarry.llm import bpe, token_files
from quarry.llm._common import scratch
from quarry.llm.pieces import PieceCache

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")


def reference():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


@pytest.mark.parametrize("plain_special", [False, True])
def test_token_files_hold_what_the_library_gives(spark, odd, documents, plain_special):
    from pyspark.sql import functions as F
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(JSON)
    if plain_special:  # otherwise the library as it comes
        tok.encode_special_tokens = True
    odd = odd.unionByName(documents([(70, "a <|endoftext|>"), (71, "x<|endoftext|><|endoftext|> y z"), (72, "<|endoftext| >")]))
    folder = scratch(spark, "t")
    manifest = token_files.write_token_files(odd, folder, JSON, file_bytes=100, partitions=3, plain_special=plain_special)
    got = [tuple(r) for r in token_files.read_token_files(manifest).orderBy("start").collect()]
    rows = odd.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    rows = sorted(map(tuple, rows.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[1]))
    start, want = 0, []
    for doc_id, text, _ in rows:
        ids = [*tok.encode(text, add_special_tokens=False).ids, 0]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    assert manifest.count() > 3  # small files: the running total crosses files


def test_rows_without_id_spread(spark, documents):
    """A third of all rows has no id: no task gets them all."""
    rows = [(None if i % 3 else i, f"text {i}") for i in range(600)]
    manifest = token_files.write_token_files(documents(rows), scratch(spark, "t"), JSON, partitions=8)
    assert manifest.count() == 8 and manifest.agg({"n_docs": "max"}).first()[0] < 200
    got = token_files.read_token_files(manifest).collect()
    assert len(got) == 600 and len({r.start for r in got}) == 600


def test_special_strings_are_single_ids(spark, documents):
    folder = scratch(spark, "t")
    manifest = token_files.write_token_files(documents([(1, "it's <|endoftext|> 'll 123")]), folder, JSON)
    [row] = token_files.read_documents(manifest, spark.createDataFrame([(1,)], "doc_id long")).collect()
    assert row.ids == [270, 338, 220, 50256, 705, 297, 17031, 0]


def test_only_wanted_documents_are_read(spark, odd):
    manifest = token_files.write_token_files(odd, scratch(spark, "t"), JSON)
    wanted = spark.createDataFrame([(7,), (51,), (999,)], "doc_id long")
    got = {r.doc_id: r.ids for r in token_files.read_documents(manifest, wanted).collect()}
    assert set(got) == {7, 51} and got[7][-1] == 0


def test_damage_is_found(spark, documents):
    manifest = token_files.write_token_files(documents([(1, "one two three")]), scratch(spark, "t"), JSON)
    url = manifest.first().file
    fs, path = token_files.filesystem(url)
    data = bytearray(fs.open_input_file(path).read())
    data[-30] ^= 1
    with fs.open_output_stream(path) as out:
        out.write(bytes(data))
    with pytest.raises(Exception):
        with token_files.FrameReader(url) as r:
            r.ids(0)


def test_token_files_of_nothing(spark, documents):
    assert token_files.token_table(documents([]), scratch(spark, "t"), JSON).count() == 0


def test_round_trip_is_tiktoken(odd):
    tok = reference()
    got = {(r.doc_id, r.ids_sha256, r.decoded_sha256, r.n_tokens) for r in bpe.round_trip(odd, RANKS, P.PATTERN).collect()}
    want = set()
    for r in odd.collect():
        ids = tok.encode_ordinary(r.text or "")
        want.add((r.doc_id, hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                  hashlib.sha256((r.text or "").encode()).hexdigest(), len(ids)))
    assert got == want and bpe.round_trip(odd, RANKS, P.PATTERN).count() == odd.count()


def test_encode_then_decode(odd):
    encoded = bpe.encode(odd, RANKS, P.PATTERN)
    back = sorted((r.doc_id or -1, r.text) for r in bpe.decode(encoded, RANKS).collect())
    assert back == sorted((r.doc_id or -1, r.text or "") for r in odd.collect())


def test_round_trip_of_nothing(documents):
    assert bpe.round_trip(documents([]), RANKS, P.PATTERN).count() == 0


def test_replay_equals_one_word_at_a_time():
    import random

    rng = random.Random(0)
    merges = bpe.Merges(bpe.read_ranks(RANKS))
    words = [bytes(rng.choice(b"aab thing\n") for _ in range(rng.randint(0, 30))) for _ in range(800)]
    assert merges.replay(words) == [merges.replay_one(w) for w in words]
    # ranks that no learning by merges would give: a later merge opens an earlier one
    toy = {bytes([i]): i + 10 for i in range(256)} | {t: k for k, t in enumerate([b"abc", b"ab", b"bcd", b"bc", b"cd", b"aa", b"aaa"])}
    merges = bpe.Merges(toy)
    words = [bytes(rng.choice(b"aabcd") for _ in range(rng.randint(0, 30))) for _ in range(800)]
    assert merges.replay(words) == [merges.replay_one(w) for w in words]


def test_a_full_cache_changes_nothing():
    tok = reference()
    _, cache = bpe.codec(RANKS, P.PATTERN)
    small = PieceCache(cache.encode_pieces, cache.encode_whole, limit=3)
    texts = ["one two three four\nfive six one two", "", "a  b", "six seven one\neight "]
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in small.encode(texts)] == [tok.encode_ordinary(t) for t in texts]


@pytest.mark.parametrize("name", ["word_bpe_49k.json"])
def test_other_tokenizers_take_whole_texts(name):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path(name))
    tok.encode_special_tokens = True
    cache, width = token_files.text_encoder(P.path(name))
    texts = ["One two,  three\nfour", ""]
    assert [np.frombuffer(x, f"<u{width}").tolist() for x in cache.encode(texts)] == [
        tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_encoding_distinct_words_takes_little_memory():
    """A pipeline's worker shares its executor's memory: encoding 24 MB of mostly new words adds less than 190 MB."""
    import subprocess
    import sys

    code = """
import random, re
import public_tokenizers as P
import pyarrow as pa
from quarry.llm import bpe
from quarry.llm._common import blocks

def most():
    return int(re.search(r"VmHWM:\\s+(\\d+)", open("/proc/self/status").read()).group(1)) / 1024

rng = random.Random(5)
letters = "etaoinshrdlucmfwypvbgkqjxz"
word = lambda: "".join(rng.choices(letters, k=9))
common = [word() for _ in range(2000)]
texts = [" ".join(word() if i % 6 == 0 else rng.choice(common) for i in range(400)) for _ in range(6000)]
batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
_, cache = bpe.codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
before = most()
for block in blocks([batch], max_bytes=bpe.BLOCK_BYTES):
    for ids in cache.encode(block.column(1)):
        pass
print(most() - before)
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True)
    assert float(done.stdout) < 190
