from quarry.operators import runs


def run_df(spark, rows):
    return spark.createDataFrame(rows, "qid string, doc_id string, rank bigint, score double")


def test_relevance_three_valued(spark):
    run = run_df(spark, [("q1", "d1", 1, 3.0), ("q1", "d2", 2, 2.0), ("q9", "d1", 1, 1.0)])
    qrels = spark.createDataFrame([("q1", "d2", 1), ("q1", "d1", 0)], "qid string, did string, label int")
    got = {(r["qid"], r["doc_id"]): r["relevant"] for r in runs.relevance_flag(run, qrels).collect()}
    assert got == {("q1", "d1"): False, ("q1", "d2"): True, ("q9", "d1"): None}


def test_compare_runs_cases(spark):
    a = run_df(spark, [("q", "d1", 1, 2.0), ("q", "d2", 2, 1.0)])
    b = run_df(spark, [("q", "d3", 1, 5.0)])
    disjoint = runs.compare_runs(a, b).collect()
    assert len(disjoint) == 3 and all((r["rank_a"] is None) != (r["rank_b"] is None) for r in disjoint)
    same = runs.compare_runs(a, a).collect()
    assert all(r["rank_a"] == r["rank_b"] for r in same)
    empty = runs.compare_runs(a, a.limit(0)).collect()
    assert len(empty) == 2 and all(r["rank_b"] is None for r in empty)


def test_order_by_other_run(spark):
    a = run_df(spark, [("q", "d2", 1, 9.0), ("q", "d1", 2, 8.0)])
    b = run_df(spark, [("q", "d1", 1, 5.0), ("q", "d3", 2, 4.0), ("q", "d2", 3, 3.0)])
    got = [r["doc_id"] for r in sorted(runs.order_by_other_run(b, a).collect(), key=lambda r: r["rank"])]
    assert got == ["d2", "d1", "d3"]


def test_attach_raw_missing_document(spark):
    run = run_df(spark, [("q", "d1", 1, 1.0), ("q", "dX", 2, 0.5)])
    corpus = spark.createDataFrame([("d1", "text one")], "doc_id string, text string")
    got = {r["doc_id"]: r["raw"] for r in runs.attach_raw(run, corpus).collect()}
    assert got == {"d1": "text one", "dX": None}


def test_hit_counts_and_id_translate(spark):
    run = spark.createDataFrame([("q", 0, 1, 1.0), ("q", 5, 2, 0.5)], "qid string, vec_id long, rank bigint, score double")
    id_map = spark.createDataFrame([("D0", 0)], "doc_id string, vec_id long")
    got = {r["vec_id"]: r["doc_id"] for r in runs.id_translate(run, id_map).collect()}
    assert got == {0: "D0", 5: None}
    assert runs.hit_counts(run).first()["hits"] == 2


def test_snippets(spark):
    from quarry.operators.snippets import best_sentences

    hits = spark.createDataFrame([("q", "d", "Cats sleep. Dogs bark loudly. Cats and dogs play.\nNothing here")],
                                 "qid string, doc_id string, raw string")
    queries = spark.createDataFrame([("q", "dogs cats")], "qid string, text string")
    # sentence 3 has both terms, sentences 1 and 2 one each (tie: earlier first); text order
    assert best_sentences(hits, queries).first()["snippet"] == "Cats sleep Cats and dogs play"
