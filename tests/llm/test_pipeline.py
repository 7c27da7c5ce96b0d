import os
import re

import pytest

import corpus_pipeline
from quarry.llm import queries


@pytest.fixture()
def tables(spark, documents, prose, tmp_path):
    texts = [prose(120) for _ in range(30)]
    item = "Ulmarin feskal doro penti. Grando luvi setra makol vend. Ostra pelin."
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(100 + i, texts[i] + " grubblefink " + prose(20)) for i in range(12)]  # toxic
    rows += [(200, texts[4]), (201, prose(60) + " " + item + " " + prose(60)), (202, None), (203, "")]
    folder = str(tmp_path)
    documents(rows).drop("fp", "score", "pos", "runs").write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, 0) for i in range(30)] + [(100 + i, 1, 1) for i in range(12)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages_take_effect(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "simhash", "decontamination", "byte_bpe"]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, tables), name)
        seen[name] = docs
        if name != "byte_bpe":
            assert docs.columns == list(corpus_pipeline.DOCUMENTS)
    ids = {n: {r.doc_id for r in d.collect()} for n, d in seen.items()}
    assert ids["toxicity"] == {*range(30), 200, 201, 202, 203}
    assert ids["line_dedup"] == ids["toxicity"]
    after = {r.doc_id: r for r in seen["line_dedup"].collect()}
    assert after[200].text == "" and after[200].n_chars == 0 and after[202].text is None
    assert ids["simhash"] == {*range(30), 200, 201}  # 200, 202 and 203 are empty now
    assert ids["decontamination"] == ids["simhash"] - {201} == ids["byte_bpe"]
    whole = {tuple(r) for r in corpus_pipeline.run(spark, tables).collect()}
    assert whole == {tuple(r) for r in seen["byte_bpe"].collect()}


def test_pipeline_of_nothing(spark, tables, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tables}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{t}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_every_operator_is_registered():
    names = queries.queries()
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 14))
    assert set(queries.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_gives_the_same(spark, name):
    import duckdb
    import pandas as pd

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark", "labels"):
        path = f"{folder}/{t}.parquet"
        con.execute(f"create view {t} as from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    mine, sql = queries.queries()[name](spark, folder).toPandas(), con.sql(queries.oracle_sql()[name]).df()
    assert sorted(mine.columns) == sorted(sql.columns)
    rows = lambda d: sorted(tuple("-" if pd.isna(x) else str(int(x)) if isinstance(x, (int, float)) and x == int(x) else str(x) for x in r)
                            for r in d[sorted(d.columns)].itertuples(index=False))
    assert rows(mine) == rows(sql)
