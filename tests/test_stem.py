"""Suffix stripping against published examples, and BM25 over stems."""

from quarry.functions.stem import stems
from quarry.operators import bm25, stemmed
from quarry.operators.index import build_index

# Examples printed with the rules, step by step, carried through all steps.
EXAMPLES = """caresses caress|ponies poni|ties ti|caress caress|cats cat|feed feed|agreed agre|plastered plaster|bled bled|motoring motor
sing sing|conflated conflat|troubled troubl|sized size|hopping hop|tanned tan|falling fall|hissing hiss|fizzed fizz|failing fail
filing file|happy happi|sky sky|relational relat|conditional condit|rational ration|valenci valenc|hesitanci hesit|digitizer digit
conformabli conform|radicalli radic|differentli differ|vileli vile|analogousli analog|vietnamization vietnam|predication predic
operator oper|feudalism feudal|decisiveness decis|hopefulness hope|callousness callous|formaliti formal|sensitiviti sensit
sensibiliti sensibl|triplicate triplic|formative form|formalize formal|electriciti electr|electrical electr|hopeful hope|goodness good
revival reviv|allowance allow|inference infer|airliner airlin|gyroscopic gyroscop|adjustable adjust|defensible defens|irritant irrit
replacement replac|adjustment adjust|dependent depend|adoption adopt|homologou homolog|communism commun|activate activ
angulariti angular|homologous homolog|effective effect|bowdlerize bowdler|probate probat|rate rate|cease ceas|controll control|roll roll
generalizations gener|oscillators oscil|y y|by by|say sai|enjoyed enjoi|syzygy syzygi|toyed toi|crying cry|is is|as as|the the|ions ion"""


def test_published_examples(spark):
    pairs = [p.split() for line in EXAMPLES.splitlines() for p in line.split("|")]
    rows = spark.createDataFrame([(a,) for a, _ in pairs] + [("café",), ("x2",), ("123",), ("Running",), (None,), ("cats",)], "term string")
    got = {r.term: r.stem for r in stems(rows).collect()}
    assert {a: got[a] for a, _ in pairs} == dict(pairs)
    assert (got["café"], got["x2"], got["123"], got["Running"], got[None]) == ("café", "x2", "123", "Running", None)


def test_stemmed_search(spark):
    docs = spark.createDataFrame([(1, "running runner runs"), (2, "the run of horses"), (3, "horse riding"), (4, "")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "horses ran running"), (2, "run runs")], "qid int, text string")
    index = build_index(docs)
    for bound in (0, 10**6):
        by_stem = stemmed.stem_index(index, max_broadcast_rows=bound)
        assert {(r.doc_id, r.term): (r.tf, r.dl) for r in by_stem.postings.collect() if r.doc_id == 1} == {(1, "run"): (2, 3), (1, "runner"): (1, 3)}
        assert {r.term: r.df for r in by_stem.terms.collect()}["hors"] == 2 and by_stem.stats() == index.stats()
        run = bm25.bm25_search(by_stem, stemmed.stem_queries(bm25.query_terms(q)), k=10)
        assert {(r.qid, r.doc_id) for r in run.collect()} == {(1, 1), (1, 2), (1, 3), (2, 1), (2, 2)}


def test_a_search_filters_the_postings_where_they_lie(spark):
    rows = [(i, f"running w{i} horse{'s' if i % 2 else ''}") for i in range(40)]
    index = build_index(spark.createDataFrame(rows, "doc_id long, text string"))
    q = spark.createDataFrame([(1, "horses run")], "qid int, text string")
    qw = stemmed.stem_queries(bm25.query_terms(q))
    by_stem = stemmed.stem_index(index, max_broadcast_rows=10)  # the vocabulary has 43 words, the query's stems 3
    found = by_stem.of_terms(qw.select("term").distinct(), True)
    plan = found.postings._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert {(r.doc_id, r.term, r.tf, r.dl) for r in found.postings.collect()} == {(i, t, 1, 3) for i in range(40) for t in ("run", "hors")}
    full = stemmed.stem_index(index).postings
    assert found.postings.exceptAll(full).count() == 0
    assert len(bm25.bm25_search(by_stem, qw, k=100).collect()) == 40
