"""Text encoders and pair similarity.

The neural two-tower encoder of the original system is not available here, so
the encoder is pluggable:

* ``HashBagOfWords(dim)`` -- the built-in default. Per token
  ``h = first 8 hex digits of md5(token)`` as an unsigned number; slot
  ``h % dim``; sign ``+1`` if ``(h div dim)`` is even else ``-1``; summed and
  L2-normalised (a text without tokens gives the zero vector). The md5 slots
  are computed in the JVM and sent as small numbers (hash modulo ``2 * dim``); the
  per-row accumulation is NumPy over pieces of ``MAX_CODES`` tokens of an Arrow batch.
* ``CallableEncoder(fn, dim)`` -- any ``fn(list[str]) -> ndarray (n, dim)``
  (e.g. an ONNX model), run batch-wise in a pandas UDF and normalised.

Both towers use the same encoder type; ``max_tokens`` (default: the whole
text) limits the tokens a tower reads.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import text as TX
from quarry.functions import vectors as V
from quarry.shipping import ship_active

# Fixed values of the packed token features: sequence length, special ids and
# the hashed vocabulary range [FIRST_TERM_ID, VOCAB_SIZE).
MAX_SEQ_LEN = 64
PAD_ID = 0
UNK_ID = 100
CLS_ID = 101
SEP_ID = 102
FIRST_TERM_ID = 1000
VOCAB_SIZE = 30522
# Tokens summed at once inside a task (bounds task memory).
MAX_CODES = 500_000


def _signed_sums(codes: np.ndarray, lengths: np.ndarray, dim: int, max_codes: int) -> np.ndarray:
    """Per text, the sums of its tokens' signs by slot; codes are ``hash % (2 * dim)``.

    Texts are taken in pieces of about ``max_codes`` tokens, long texts in several, so what
    is held beside the batch and its result does not grow with the texts."""
    out = np.zeros((len(lengths), dim))
    ends = np.cumsum(lengths)
    for start in range(0, len(codes), max_codes):
        part = codes[start:start + max_codes].astype(np.int64)
        rows = np.searchsorted(ends, np.arange(start, start + len(part)), side="right")
        slot, sign = part % dim, np.where(part < dim, 1.0, -1.0)
        first, last = rows[0], rows[-1] + 1
        sums = np.bincount((rows - first) * dim + slot, weights=sign, minlength=(last - first) * dim)
        out[first:last] += sums.reshape(last - first, dim)
    return out


def _accumulate_udf(dim: int):
    ship_active()

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def accumulate(codes: pa.Array) -> pa.Array:
        lengths = pc.fill_null(pc.list_value_length(codes), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        out = _signed_sums(codes.flatten().to_numpy(zero_copy_only=False), lengths, dim, MAX_CODES)
        out /= np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), V.NORM_EPS)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, dim), pa.int32()), pa.array(out.reshape(-1)))

    return accumulate


@dataclass(frozen=True)
class HashBagOfWords:
    dim: int = 64
    max_tokens: int | None = None

    def column(self, text) -> Column:
        toks = TX.tokens(text)
        if self.max_tokens is not None:
            toks = F.slice(toks, 1, self.max_tokens)
        # Slot and sign depend on the hash modulo 2 * dim alone: small numbers go to Python.
        kind = "smallint" if 2 * self.dim <= 1 << 15 else "int"
        codes = F.transform(toks, lambda t: (TX.md5_hash32(t) % F.lit(2 * self.dim)).cast(kind))
        return _accumulate_udf(self.dim)(codes)


@dataclass(frozen=True)
class CallableEncoder:
    fn: Callable[[list], np.ndarray]
    dim: int

    def column(self, text) -> Column:
        fn, dim = self.fn, self.dim
        ship_active()

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def enc(texts: pd.Series) -> pd.Series:
            m = np.asarray(fn(texts.fillna("").tolist()), dtype=np.float64).reshape(len(texts), dim)
            nrm = np.sqrt((m * m).sum(axis=1, keepdims=True))
            return pd.Series(list(m / np.maximum(nrm, V.NORM_EPS)))

        return enc(F.col(text) if isinstance(text, str) else text)


def embed(df: DataFrame, text_col: str = "text", encoder=None, out_col: str = "embedding") -> DataFrame:
    """Add a unit vector ``out_col`` (ARRAY<DOUBLE>) encoding ``text_col``."""
    enc = encoder or HashBagOfWords()
    return df.withColumn(out_col, enc.column(text_col))


def encode_queries(queries: DataFrame, encoder=None) -> DataFrame:
    """Query tower: ``(qid, text)`` -> ``(qid, embedding)``."""
    return embed(queries, "text", encoder).select("qid", "embedding")


def pair_similarity(pairs: DataFrame, queries: DataFrame, docs: DataFrame, encoder=None,
                    doc_encoder=None) -> DataFrame:
    """``pairs(qid, doc_id)`` -> ``(qid, doc_id, score, query_vec, doc_vec)``;
    score = clamp(normalised q . normalised d, 0, 1). Both sides are encoded
    once per distinct id, then joined to the pairs."""
    from quarry.operators.runs import fetch_by_key
    from quarry.plans.sizing import cut_lineage

    pairs = cut_lineage(pairs)  # used for both key sets and the final join
    qv = encode_queries(fetch_by_key(pairs, queries, "qid"), encoder)
    dv = embed(fetch_by_key(pairs, docs, "doc_id"), "text", doc_encoder or encoder).select(
        "doc_id", F.col("embedding").alias("doc_vec"))
    joined = pairs.join(qv.withColumnRenamed("embedding", "query_vec"), "qid").join(dv, "doc_id")
    return joined.withColumn("score", V.pair_similarity("query_vec", "doc_vec"))


def term_id(term) -> Column:
    """Hashed vocabulary id of a token."""
    return F.lit(FIRST_TERM_ID) + F.pmod(TX.md5_hash32(term), F.lit(VOCAB_SIZE - FIRST_TERM_ID))


def token_features(df: DataFrame, text_col: str = "text", max_len: int = MAX_SEQ_LEN) -> DataFrame:
    """Pack text into fixed-length model inputs.

    Every ``max_len - 2`` consecutive tokens form one window
    ``[CLS] ids.. [SEP] PAD..`` with ``segment_ids`` and ``input_mask`` 1 on
    real positions and 0 on padding. The whole text is covered by windows
    ``window = 0, 1, ..``; window 0 alone is the truncated single input. A text
    without tokens gives one window ``[CLS][SEP]``.
    """
    body = max_len - 2
    toks = TX.tokens(text_col)
    n_win = F.greatest(F.lit(1), F.ceil(F.size(toks) / F.lit(body)).cast("int"))
    windows = F.transform(F.sequence(F.lit(0), n_win - 1), lambda w: F.slice(toks, w * body + 1, body))
    out = df.select("*", F.posexplode(windows).alias("window", "chunk"))
    n = F.size("chunk")
    pad = F.lit(max_len) - n - 2
    ids = F.concat(F.array(F.lit(CLS_ID)), F.transform("chunk", lambda t: term_id(t).cast("int")),
                   F.array(F.lit(SEP_ID)), F.array_repeat(F.lit(PAD_ID), pad))
    ones = F.array_repeat(F.lit(1), n + 2)
    zeros = F.array_repeat(F.lit(0), pad)
    return (
        out.withColumn("input_ids", ids)
        .withColumn("segment_ids", F.concat(ones, zeros))
        .withColumn("input_mask", F.concat(ones, zeros))
        .drop("chunk")
    )
