"""Keyed store: only the files of the wanted key ranges are read."""

from quarry.operators import runs
from quarry.sources import keyed
from quarry.sources.keyed import KeyedStore


def table(spark, n=1000):
    return spark.createDataFrame([(3 * i, f"text {i}", None if i % 7 == 0 else i) for i in range(n)] + [(None, "no key", 1)],
                                 "doc_id long, text string, x int")


def test_lookup_reads_the_files_hit(spark, tmp_path):
    store = KeyedStore.write(table(spark), str(tmp_path / "s"), "doc_id", files=10)
    assert len(store.files) >= 9 and store.first == sorted(store.first)
    assert all(a < b for a, b in zip(store.last, store.first[1:]))  # disjoint
    ids = spark.createDataFrame([(0,), (3,), (2997,), (4,), (None,), (10**9,), (-5,), (3,)], "doc_id long")
    rows = store.lookup(ids)
    assert len(rows.inputFiles()) == 2 and len(store.files_for(ids)) == 2
    assert sorted(r.doc_id for r in rows.collect()) == [0, 3, 2997]
    assert rows.columns == ["doc_id", "text", "x"]


def test_no_file_and_all_files(spark, tmp_path):
    store = KeyedStore.write(table(spark), str(tmp_path / "s"), "doc_id", files=4)
    none = store.lookup(spark.createDataFrame([(-1,), (None,)], "doc_id long"))
    assert none.count() == 0 and none.columns == ["doc_id", "text", "x"]
    assert store.lookup(table(spark)).count() == 1000 and store.table().count() == 1001


def test_many_keys_join(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyed, "PUSHED_KEYS", 2)
    store = KeyedStore.write(table(spark), str(tmp_path / "s"), "doc_id", files=4)
    ids = spark.range(0, 90, 1).withColumnRenamed("id", "doc_id")
    for bound in (0, 1000):
        assert sorted(r.doc_id for r in store.lookup(ids, bound).collect()) == list(range(0, 90, 3))


def test_pushed_keys_reach_the_scan(spark, tmp_path):
    store = KeyedStore.write(table(spark), str(tmp_path / "s"), "doc_id", files=4)
    plan = store.lookup(spark.createDataFrame([(3,), (6,)], "doc_id long"))._jdf.queryExecution().toString()
    assert "In(doc_id, [3,6])" in plan


def test_text_keys_and_repeats(spark, tmp_path):
    rows = spark.createDataFrame([(k, i) for i in range(3) for k in ("a", "é", "日", "zz")], "k string, n int")
    store = KeyedStore.write(rows, str(tmp_path / "s"), "k", files=3)
    got = store.lookup(spark.createDataFrame([("é",), ("日",), ("b",)], "k string"))
    assert sorted(map(tuple, got.collect())) == [("é", 0), ("é", 1), ("é", 2), ("日", 0), ("日", 1), ("日", 2)]


def test_empty_table(spark, tmp_path):
    store = KeyedStore.write(table(spark).limit(0), str(tmp_path / "s"), "doc_id")
    assert store.files == [] and store.lookup(spark.createDataFrame([(1,)], "doc_id long")).count() == 0


def test_runs_fetch_from_a_store(spark, tmp_path):
    store = KeyedStore.write(table(spark), str(tmp_path / "s"), "doc_id", files=4)
    run = spark.createDataFrame([(1, 3, 1), (1, 4, 2), (2, 3, 1)], "qid int, doc_id long, rank int")
    got = {(r.qid, r.doc_id): r.raw for r in runs.attach_raw(run, store).collect()}
    assert got == {(1, 3): "text 1", (1, 4): None, (2, 3): "text 1"}
    vectors = spark.createDataFrame([(i, [float(i)]) for i in range(50)], "vec_id long, embedding array<double>")
    store = KeyedStore.write(vectors, str(tmp_path / "v"), "vec_id", files=4)
    hits = spark.createDataFrame([(1, 7), (1, 99)], "qid int, vec_id long")
    assert {r.vec_id: r.embedding for r in runs.fetch_embeddings(hits, store).collect()} == {7: [7.0], 99: None}
