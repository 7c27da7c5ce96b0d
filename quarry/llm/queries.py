"""Registered queries of the training-data operators, and their SQL.

Each query applies one operator to its whole table with production parameters;
digest columns are derived here from the operator's real output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import align, bpe, decontaminate, forest, licences, line_dedup, minhash, periodic, quality, simhash, token_files, toxicity, warc
from quarry.llm._common import scratch, table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return token_files.token_table(docs, scratch(spark, "tokens"), tokenizer_file("byte_bpe_50k.json"), end_id=0)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_summary(table(spark, sf_dir, "pages", "page_id", "url", "html"), scratch(spark, "warc"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents", "doc_id", "text"),
                             table(spark, sf_dir, "labels", "doc_id", "toxic"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents", "doc_id", "text"),
                                      table(spark, sf_dir, "benchmark", "item_id", "text"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", simhash.hex_digits("fp").alias("fingerprint"), "component_id")


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents", "doc_id", "text"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return bpe.round_trip(docs, tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents", "doc_id", "text"),
                            table(spark, sf_dir, "labels", "doc_id", "quality"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(table(spark, sf_dir, "documents", "doc_id", "text")).drop("removed_runs")


def op10_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return forest.nearest(vectors, vectors.filter(F.col("vec_id") % 20 == 0))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.summary(periodic.scan(table(spark, sf_dir, "documents", "doc_id", "text"), periodic.planted))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


def op13_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_file("byte_bpe_50k.json"),
                       tokenizer_file("piece_bpe_32k.model"), digest=True)


WARC_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
                  sha256(coalesce(html, '')) AS payload_digest FROM pages),
     f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""

LINE_DEDUP_SQL = """
WITH d AS (SELECT doc_id, string_split(replace(replace(replace(replace(replace(text,
                  chr(10), chr(10) || chr(1)), '. ', '. ' || chr(1)), '! ', '! ' || chr(1)), '? ', '? ' || chr(1)),
                  ', ', ', ' || chr(1)), chr(1)) AS p,
                  string_split(replace(replace(replace(replace(replace(text, chr(10), chr(1)), '. ', '.' || chr(1)), '! ', '!' || chr(1)), '? ', '?' || chr(1)),
                  ', ', ',' || chr(1)), chr(1)) AS c FROM documents),
     l AS (SELECT doc_id, i AS pos, p[i] AS piece, c[i] AS a, c[i + 1] AS b, c[i + 2] AS c
           FROM (SELECT doc_id, p, c, unnest(range(1, len(p) + 1)) AS i FROM d)),
     w AS (SELECT *, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS occurrence FROM l
           WHERE b IS NOT NULL AND c IS NOT NULL AND a <> '' AND c <> ''),
     x AS (SELECT DISTINCT doc_id, pos + k AS pos FROM w, (SELECT unnest([0, 1, 2]) AS k) WHERE occurrence > 1),
     i AS (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM x),
     y AS (SELECT doc_id, run FROM i JOIN l USING (doc_id, pos) GROUP BY 1, 2 HAVING sum(length(piece)) >= 60),
     z AS (SELECT i.doc_id, i.pos FROM i JOIN y USING (doc_id, run)),
     r AS (SELECT l.doc_id, count(z.pos) AS removed_lines,
                  string_agg(piece, '' ORDER BY l.pos) FILTER (WHERE z.pos IS NULL) AS kept
           FROM l LEFT JOIN z ON l.doc_id = z.doc_id AND l.pos = z.pos GROUP BY 1)
SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE coalesce(kept, '') END AS text,
       coalesce(removed_lines, 0)::BIGINT AS removed_lines
FROM documents LEFT JOIN r USING (doc_id)
"""

MINHASH_SQL = r"""
WITH RECURSIVE w AS (
       SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[^\x20\x09-\x0D]+') AS ws FROM documents),
     g AS (SELECT doc_id, ws[1] AS shingle FROM w WHERE len(ws) = 1
           UNION SELECT doc_id, ws[i] || ' ' || ws[i + 1]
           FROM (SELECT doc_id, ws, unnest(range(1, len(ws))) AS i FROM w WHERE len(ws) > 1)),
     n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
     p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared
           FROM g x JOIN g y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY 1, 2),
     l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
           WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
     e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
     r(doc_id, other) AS (SELECT doc_id, doc_id FROM documents
                          UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other),
     c AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY 1)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM c LEFT JOIN n USING (doc_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_files": op1_token_files,
        "op2_warc": op2_warc,
        "op3_toxicity": op3_toxicity,
        "op4_decontaminate": op4_decontaminate,
        "op5_simhash": op5_simhash,
        "op6_licences": op6_licences,
        "op7_byte_bpe": op7_byte_bpe,
        "op8_quality": op8_quality,
        "op9_line_dedup": op9_line_dedup,
        "op10_forest": op10_forest,
        "op11_periodic_runs": op11_periodic_runs,
        "op12_minhash": op12_minhash,
        "op13_align": op13_align,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": WARC_SQL, "op9_line_dedup": LINE_DEDUP_SQL, "op12_minhash": MINHASH_SQL}
