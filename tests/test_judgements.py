import pytest

from quarry.sources import judgements as J
from quarry.sources.idmap import read_id_map


@pytest.fixture()
def files(tmp_path):
    qrels = tmp_path / "qrels.txt"
    qrels.write_text(
        "q1 0 d1 1\n"
        "q1 0 d2 0\n"
        "  q1\t0   d3   2  \n"   # extra blanks
        "q1 0 d1 1\n"            # duplicate positive kept
        "q2 0 d9 0\n"            # query with only zeros
        "q3 0 d5 -1\n"           # negative label
        "q4 0 d7 3\n"
    )
    queries = tmp_path / "queries.tsv"
    queries.write_text(
        "q1\tfirst text\n"
        "q1\tsecond text\n"      # repeated qid: first wins
        "q2\tonly zeros\n"
        "q5\tunjudged\n"
        "  q4\tpadded  \n"
    )
    return str(qrels), str(queries), tmp_path


def test_positive_judgements_file_order(spark, files):
    qrels_path, _, _ = files
    q = J.read_qrels(spark, qrels_path)
    pos = J.positives_lists(J.positives_by_query(q), 100).collect()
    got = {r["qid"]: r["dids"] for r in pos}
    assert got == {"q1": ["d1", "d3", "d1"], "q4": ["d7"]}


def test_judged_queries_first_wins(spark, files):
    qrels_path, queries_path, _ = files
    _, judged = J.load_qrels(spark, qrels_path, queries_path)
    got = {r["qid"]: r["text"] for r in judged.collect()}
    assert got == {"q1": "first text", "q4": "padded"}


def test_malformed_lines(spark, files):
    _, _, tmp = files
    bad = tmp / "bad.txt"
    bad.write_text("q1 0 d1 1\nq1 0 d2\nq1 0 d3 1\n")
    with pytest.raises(ValueError):
        J.read_qrels(spark, str(bad)).count()
    assert J.read_qrels(spark, str(bad), strict=False).count() == 2
    badq = tmp / "badq.tsv"
    badq.write_text("q1\ttext\nq2 no tab\n")
    with pytest.raises(ValueError):
        J.read_queries(spark, str(badq))
    assert J.read_queries(spark, str(badq), strict=False).count() == 1


def test_file_order_across_splits(spark, tmp_path):
    p = tmp_path / "big.txt"
    p.write_text("".join(f"q1 0 d{i} 1\n" for i in range(2000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = J.read_qrels(spark, str(p))
        assert df.rdd.getNumPartitions() > 1
        long_form = J.positives_by_query(df)
        got = sorted((r["pos"], r["did"]) for r in long_form.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [(i + 1, f"d{i}") for i in range(2000)]  # one hot query, exact positions


def test_id_map_json_object(spark, tmp_path):
    p = tmp_path / "map.json"
    p.write_text('{"D1": 0, "D2": 7, "D3": 3}')
    got = {r["doc_id"]: r["vec_id"] for r in read_id_map(spark, str(p)).collect()}
    assert got == {"D1": 0, "D2": 7, "D3": 3}


def test_passage_judgements(spark):
    from quarry.sources.passages import passage_judgements

    docs = spark.createDataFrame([(1, "the cat sat on the mat"), (2, "a dog"), (3, None), (4, "cat sat")],
                                 "doc_id long, text string")
    psg = spark.createDataFrame([(10, "cat sat"), (11, "dog"), (12, "cat sat"), (13, "zebra")], "qid long, text string")
    got = sorted((r["qid"], r["did"]) for r in passage_judgements(docs, psg).collect())
    assert got == [(10, 1), (10, 4), (11, 2), (12, 1), (12, 4)]
    # chunked patterns give the same pairs
    got2 = sorted((r["qid"], r["did"]) for r in passage_judgements(docs, psg, max_chunk_chars=4).collect())
    assert got2 == got


def _contained(docs, passages):
    return [(q, d) for d, t in docs for q, p in set(passages) if t is not None and p is not None and p in t]


def test_passages_meet_on_their_rarest_sequence(spark):
    import random

    from quarry.sources.passages import passage_judgements

    rng = random.Random(6)
    words = "alpha beta gamma delta épsilon zeta eta theta iota kappa".split()
    docs = [(i, "".join(w + rng.choice([" ", ", ", "\n", ". ", " -- "]) for w in rng.choices(words, k=rng.randint(0, 60)))) for i in range(120)]
    docs += [(i + 500, f"Shared by many documents, this passage stands here {i}") for i in range(60)]  # a hot anchor
    docs += [(700, None), (701, ""), (7, "this id twice, with other words in it"), (None, docs[3][1])]
    passages = [(1, "many documents, this passage stands"), (2, "y documents, this passage sta"), (3, "documents, THIS passage stands"),
                (4, None), (5, ""), (6, "a"), (7, "mm"), (8, "many documents; this passage stands"), (9, "beta ga"), (10, ", this"),
                (11, "this id twice, with"), (12, "many documents, this passage stands"), (11, "passage stands here 7")]
    for i in range(60):
        t = docs[rng.randrange(120)][1]
        a = rng.randrange(len(t) + 1)
        passages.append((100 + i, t[a:a + rng.randint(1, 80)]))
    passages.append(passages[0])  # a repeated row counts once
    d = spark.createDataFrame(docs, "doc_id long, text string")
    p = spark.createDataFrame(passages, "qid long, text string")
    key = lambda r: (r[0], r[1] is not None, r[1] or 0)
    for options in ({}, {"max_broadcast_rows": 0, "hot_docs": 5}, {"max_broadcast_rows": 0, "hot_docs": 10**9}):
        rows = passage_judgements(d, p, **options).collect()
        got = sorted(((r["qid"], r["did"]) for r in rows), key=key)
        assert got == sorted(_contained(docs, passages), key=key), options
        assert all(r["label"] == 1 for r in rows)
    assert len(got) > 200


def test_passage_judgements_of_nothing(spark):
    from quarry.sources.passages import passage_judgements

    d = spark.createDataFrame([(1, "some text of five words")], "doc_id long, text string")
    p = spark.createDataFrame([(1, "text of five")], "qid long, text string")
    assert passage_judgements(d.limit(0), p).count() == 0 and passage_judgements(d, p.limit(0)).count() == 0
    assert [tuple(r) for r in passage_judgements(d, p).collect()] == [(1, 1, 1)]


def test_anchored_passages_stay_in_the_jvm(spark):
    from quarry.sources.passages import passage_judgements

    d = spark.createDataFrame([(i, f"some text of five words {i}") for i in range(50)], "doc_id long, text string")
    p = spark.createDataFrame([(1, "text of five words")], "qid long, text string")
    plan = passage_judgements(d, p)._jdf.queryExecution().toString()
    assert "MapInPandas" not in plan and "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_id_map_object_is_read_in_splits(spark, tmp_path):
    """Keys with commas, quotes, escapes and line breaks, cut by many split seams."""
    import json
    import random

    rng = random.Random(2)
    odd = ["a,b", ",", ",,,", '"', 'x,"y":1,z', "\\", "\\,", "a\nb", "é,日本", ": 5,x", '": 5,"', "{,}", "}", " , : 7", "tab\t,"]
    rows = {f"{rng.choice(odd)}{i}{rng.choice(odd)}" if i % 3 == 0 else f"doc {i}": i * rng.choice([1, -1]) for i in range(6000)}
    rows |= {k: i for i, k in enumerate(odd)}
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "a.json").write_text(json.dumps(rows))
    (tmp_path / "one" / "b.json").write_text(json.dumps({"other, file": 1, "more": -2}, indent=1, ensure_ascii=False) + "\n")
    (tmp_path / "one" / "c.json").write_text("{}")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("4k", "1037b", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            raw = spark.read.option("lineSep", ",").text(str(tmp_path / "one"))
            assert raw.rdd.getNumPartitions() > (20 if size != before else 0)  # more than one task
            got = read_id_map(spark, str(tmp_path / "one")).collect()
            assert len(got) == len(rows) + 2
            assert {r.doc_id: r.vec_id for r in got} == rows | {"other, file": 1, "more": -2}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_id_map_errors_and_writer(spark, tmp_path):
    import pytest

    from quarry.sources.idmap import write_id_map

    (tmp_path / "bad.json").write_text('{"a": 1, "b": "two"}')
    with pytest.raises(Exception, match="not an id map entry"):
        read_id_map(spark, str(tmp_path / "bad.json")).collect()
    rows = spark.createDataFrame([(f'k,"{i}', i) for i in range(50)] + [(None, 1), ("x", None)], "doc_id string, vec_id long").repartition(3)
    write_id_map(rows, str(tmp_path / "w"))
    assert sorted(map(tuple, read_id_map(spark, str(tmp_path / "w")).collect())) == sorted((f'k,"{i}', i) for i in range(50))
