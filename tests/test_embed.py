import hashlib

import numpy as np
import regex

from quarry.operators import embed


def py_bow(text, dim, max_tokens=None):
    toks = [t for t in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if t]
    if max_tokens is not None:
        toks = toks[:max_tokens]
    v = np.zeros(dim)
    for t in toks:
        h = int(hashlib.md5(t.encode()).hexdigest()[:8], 16)
        v[h % dim] += 1.0 if (h // dim) % 2 == 0 else -1.0
    n = np.linalg.norm(v)
    return v / n if n > 0 else v


TEXTS = [(1, "The cat sat on the mat, the END."), (2, ""), (3, "Ünïcode wörds and 42 numbers 42"), (4, None)]


def test_hash_bow_matches_python(spark):
    df = spark.createDataFrame(TEXTS, "id long, text string")
    got = {r["id"]: r["embedding"] for r in embed.embed(df, "text", embed.HashBagOfWords(16)).collect()}
    for i, t in TEXTS:
        assert np.allclose(got[i], py_bow(t or "", 16))
    trunc = {r["id"]: r["embedding"] for r in embed.embed(df, "text", embed.HashBagOfWords(16, max_tokens=3)).collect()}
    assert np.allclose(trunc[1], py_bow(TEXTS[0][1], 16, 3))


def test_callable_encoder(spark):
    df = spark.createDataFrame(TEXTS, "id long, text string")

    def lengths(texts):
        return np.array([[len(t), 1.0, 0.0] for t in texts])

    got = {r["id"]: r["embedding"] for r in embed.embed(df, "text", embed.CallableEncoder(lengths, 3)).collect()}
    assert np.allclose(got[1], np.array([32.0, 1.0, 0.0]) / np.linalg.norm([32.0, 1.0, 0.0]))
    assert np.allclose(got[4], [0.0, 1.0, 0.0])  # null text encodes as ""


def test_token_features_windows(spark):
    text = " ".join(f"w{i}" for i in range(130))
    df = spark.createDataFrame([(1, text), (2, "")], "qid long, text string")
    rows = sorted(embed.token_features(df).collect(), key=lambda r: (r["qid"], r["window"]))
    one = [r for r in rows if r["qid"] == 1]
    assert [r["window"] for r in one] == [0, 1, 2]  # 62 + 62 + 6 tokens: the whole text
    for r in rows:
        assert len(r["input_ids"]) == len(r["segment_ids"]) == len(r["input_mask"]) == 64
    assert one[2]["input_ids"][0] == embed.CLS_ID and one[2]["input_ids"][7] == embed.SEP_ID
    assert sum(one[2]["input_mask"]) == 8
    empty = [r for r in rows if r["qid"] == 2][0]
    assert empty["input_ids"][:3] == [embed.CLS_ID, embed.SEP_ID, embed.PAD_ID]


def test_token_sums_hold_pieces_only(spark):
    import tracemalloc

    rng = np.random.default_rng(2)
    lengths = np.array([0, 5, 0, 20_000, 1] + [2000] * 1000 + [0])
    codes = rng.integers(0, 128, lengths.sum()).astype(np.int16)
    want, rows = np.zeros((len(lengths), 64)), np.repeat(np.arange(len(lengths)), lengths)
    np.add.at(want, (rows, codes % 64), np.where(codes < 64, 1.0, -1.0))
    tracemalloc.start()
    got = [embed._signed_sums(codes, lengths, 64, n) for n in (30_000, 100_000)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert all((g == want).all() for g in got) and peak < 8e6  # all codes at once take 16 MB per array
    out = embed.embed(spark.createDataFrame([(1, None), (2, ""), (3, "a b a")], "doc_id long, text string")).collect()
    assert [sum(x * x for x in r.embedding) > 0 for r in sorted(out)] == [False, False, True]
