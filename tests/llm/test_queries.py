"""Every registered query of the training-data operators runs on whole small tables."""

import random
import zlib

import numpy as np
import pytest

from quarry.llm import queries

COLUMNS = {
    "op1_token_files": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op3_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op5_simhash": ["doc_id", "fingerprint", "component_id"],
    "op7_byte_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op8_quality": ["doc_id", "held_out", "score", "predicted"],
    "op9_line_dedup": ["doc_id", "text", "removed_lines"],
    "op11_periodic_runs": ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"],
    "op12_minhash": ["doc_id", "n_shingles", "component_id", "kept"],
    "op13_align": ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
}


@pytest.fixture(scope="module")
def tables(spark, prose, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    rng = random.Random(12)
    docs = [(i, prose(20 + i % 50) + (" grubblefink" if i % 4 == 0 else ""), "en", f"s{i % 3}", 1) for i in range(120)]
    docs += [(200, docs[5][1], "en", "s0", 1), (201, docs[5][1] + " tail", "en", "s0", 1), (202, None, "en", "s0", 1), (203, "", "en", "s0", 0),
             (204, prose(10) + "\nReleased under the MIT License.", "en", "s1", 1)]
    items = [(i, prose(30)) for i in range(10)]
    docs += [(300 + i, prose(20) + " " + items[i][1] + " " + prose(20), "en", "s1", 1) for i in range(4)]
    frames = {
        "documents": spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"),
        "labels": spark.createDataFrame([(i, i % 2, int(i % 4 == 0)) for i in range(120)], "doc_id long, quality int, toxic int"),
        "benchmark": spark.createDataFrame(items, "item_id long, text string"),
        "pages": spark.createDataFrame([(i, f"http://a/{i}", prose(30) if i % 3 else "<html>same</html>" * 9) for i in range(20)],
                                       "page_id long, url string, html string"),
        "embeddings": spark.createDataFrame([(i, [float(z) for z in rng.choices(range(-9, 9), k=8)]) for i in range(100)],
                                            "vec_id long, embedding array<double>"),
    }
    for name, frame in frames.items():
        frame.write.parquet(str(folder / f"{name}.parquet"))
    return str(folder), {i: t for i, t, *_ in docs}


def test_all_queries_are_here():
    assert set(queries.oracle_sql()) <= set(queries.queries()) and len(queries.queries()) == 13


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_a_row_per_document(spark, tables, name):
    got = queries.queries()[name](spark, tables[0])
    rows = got.collect()
    assert got.columns[:len(COLUMNS[name])] == COLUMNS[name]
    assert sorted(r.doc_id for r in rows) == sorted(tables[1])
    if "held_out" in got.columns:
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)


def test_findings(spark, tables):
    found = {(r.doc_id, r.item_id) for r in queries.queries()["op4_decontaminate"](spark, tables[0]).collect()}
    assert found == {(300 + i, i) for i in range(4)}
    licences = [(r.doc_id, r.family, r.confirmed) for r in queries.queries()["op6_licences"](spark, tables[0]).collect()]
    assert (204, "mit", True) in licences
    archive = queries.queries()["op2_warc"](spark, tables[0]).collect()
    assert len(archive) == 20 and {r.refers_to for r in archive if r.record_type == "revisit"} == {0}
    near = queries.queries()["op10_forest"](spark, tables[0]).collect()
    assert {r.query_id for r in near} == {0, 20, 40, 60, 80} and np.isfinite([r.score for r in near]).all()
