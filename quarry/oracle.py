"""DuckDB SQL for the registered queries (the correctness oracle).

Each function returns a SQL string over the driver's views (``documents``,
``benchmark``, ``embeddings``, ``pages``, ``labels`` ...). The definitions
mirror the engine's documented semantics, written independently in SQL: floats
rounded to 6 decimals, ranks BIGINT, ranking by ``round(score, 9) DESC`` then
id.
"""

from __future__ import annotations

from quarry.functions import stem as ST
from quarry.functions.text import SENTENCE_BOUNDARY, TOKEN_SEPARATOR, URL_PATTERN

D = 6  # decimals compared


def toks(expr: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({expr}), '{TOKEN_SEPARATOR}'), lambda x: x <> '')"


DOCS = "SELECT doc_id, text FROM documents"
PAGES = "SELECT page_id AS doc_id, url || chr(10) || html AS text FROM pages"


def index_ctes(corpus: str = DOCS) -> str:
    """CTEs tk(doc_id, t), st(n, avgdl), post(doc_id, term, tf, dl), dfs(term, df)."""
    return f"""
tk AS (SELECT doc_id, {toks('text')} AS t FROM ({corpus})),
st AS (SELECT count(*)::DOUBLE AS n, avg(len(t))::DOUBLE AS avgdl FROM tk),
post AS (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl
         FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM tk) GROUP BY doc_id, term),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term)"""


def query_terms_cte(name: str = "qw") -> str:
    return f"""
{name} AS (SELECT qid, term, count(*)::DOUBLE AS qw
        FROM (SELECT item_id AS qid, unnest({toks('text')}) AS term FROM benchmark) GROUP BY qid, term)"""


def bm25_cte(name: str, qweights: str, k: int, k1: float = 3.44, b: float = 0.87) -> str:
    """CTE ``name(qid, doc_id, score, rank)``: BM25 top-k for weighted terms."""
    return f"""
{name}_s AS (
  SELECT q.qid, p.doc_id,
         sum(q.qw * ln(1 + (st.n - f.df + 0.5) / (f.df + 0.5)) * p.tf
             / (p.tf + {k1}::DOUBLE * (1 - {b}::DOUBLE + {b}::DOUBLE * p.dl / st.avgdl))) AS score
  FROM {qweights} q JOIN dfs f USING (term) JOIN post p USING (term) CROSS JOIN st
  GROUP BY q.qid, p.doc_id),
{name}_r AS (SELECT qid, doc_id, score,
             row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM {name}_s),
{name} AS (SELECT qid, doc_id, score, rank FROM {name}_r WHERE rank <= {k})"""


def bm25_topk(k: int = 100) -> str:
    return f"""WITH {index_ctes()}, {query_terms_cte()}, {bm25_cte('run', 'qw', k)}
SELECT qid, doc_id, rank::BIGINT AS rank, round(score, {D}) AS score FROM run"""


def bm25_run_ctes(k: int, corpus: str = DOCS) -> str:
    """CTE ``run(qid, doc_id, score, rank)`` plus its index CTEs."""
    return f"{index_ctes(corpus)}, {query_terms_cte()}, {bm25_cte('run', 'qw', k)}"


def passage_qrels_cte(corpus: str = DOCS, name: str = "pq") -> str:
    return f"""
{name} AS (SELECT b.item_id AS qid, d.doc_id AS did, 1 AS label
       FROM benchmark b JOIN ({corpus}) d ON contains(d.text, b.text))"""


def passage_qrels() -> str:
    return f"WITH {passage_qrels_cte()} SELECT qid, did, label FROM pq"


def qrels_positive() -> str:
    return """SELECT d.source AS qid, l.doc_id AS did, l.quality AS label
FROM labels l JOIN documents d USING (doc_id) WHERE l.quality > 0"""


def positives_by_query() -> str:
    return """SELECT d.source AS qid, row_number() OVER (PARTITION BY d.source ORDER BY l.doc_id)::BIGINT AS pos,
       l.doc_id AS did
FROM labels l JOIN documents d USING (doc_id) WHERE l.quality > 0"""


def judged_queries() -> str:
    return f"""WITH {passage_qrels_cte()}
SELECT item_id AS qid, text FROM benchmark WHERE item_id IN (SELECT qid FROM pq WHERE label > 0)"""


def relevance_cte(run: str = "run", qrels: str = "pq", name: str = "rel") -> str:
    return f"""
{name} AS (SELECT r.*, CASE WHEN r.qid IN (SELECT qid FROM {qrels} WHERE label > 0)
       THEN EXISTS (SELECT 1 FROM {qrels} x WHERE x.qid = r.qid AND x.did = r.doc_id AND x.label > 0) END AS relevant
       FROM {run} r)"""


def relevance_flag(k: int = 10) -> str:
    return f"""WITH {bm25_run_ctes(k)}, {passage_qrels_cte()}, {relevance_cte()}
SELECT qid, doc_id, rank::BIGINT AS rank, relevant FROM rel"""


def attach_raw(k: int = 10) -> str:
    return f"""WITH {bm25_run_ctes(k)}
SELECT r.qid, r.doc_id, r.rank::BIGINT AS rank, round(r.score, {D}) AS score, d.text AS raw
FROM run r LEFT JOIN documents d USING (doc_id)"""


def hit_counts(k: int = 100) -> str:
    return f"""WITH {bm25_run_ctes(k)}
SELECT qid, count(*)::BIGINT AS hits FROM run GROUP BY qid"""


def doc_lookup() -> str:
    return """SELECT e.vec_id AS doc_id, d.text AS raw FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id"""


def shorten_text() -> str:
    return "SELECT doc_id, substring(text, 1, 1000) AS short FROM documents"


def first_url() -> str:
    return f"""SELECT doc_id, regexp_extract(substring(text, 1, 1000), '{URL_PATTERN}', 0) AS url FROM ({PAGES})"""


def linkify_expr(t: str, u: str) -> str:
    return f"""CASE WHEN {u} <> '' THEN replace({t}, {u}, '<a href="' || {u} || '">Source</a> ') ELSE {t} END"""


def linkify() -> str:
    return f"""WITH s AS (SELECT doc_id, substring(text, 1, 1000) AS t FROM ({PAGES})),
u AS (SELECT doc_id, t, regexp_extract(t, '{URL_PATTERN}', 0) AS url FROM s)
SELECT doc_id, {linkify_expr('t', 'url')} AS display FROM u"""


def present_hits(k: int = 10) -> str:
    return f"""WITH {bm25_run_ctes(k, PAGES)}, {passage_qrels_cte(PAGES)}, {relevance_cte()},
h AS (SELECT rel.*, substring(c.text, 1, 1000) AS t FROM rel LEFT JOIN ({PAGES}) c USING (doc_id)),
u AS (SELECT *, regexp_extract(t, '{URL_PATTERN}', 0) AS url FROM h)
SELECT qid, doc_id, rank::BIGINT AS rank, round(score, {D}) AS score, relevant, t AS text, url,
       {linkify_expr('t', 'url')} AS display FROM u"""


def compare_cte(k: int = 10) -> str:
    """``run`` (BM25) and ``run2`` (BM25 + RM3) top-k."""
    return f"""{index_ctes()}, {query_terms_cte()}, {bm25_cte('run', 'qw', k)}, {rm3_ctes()},
{bm25_cte('run2', 'expanded', k)}"""


def compare_runs(k: int = 10) -> str:
    return f"""WITH {compare_cte(k)}
SELECT coalesce(a.qid, b.qid) AS qid, coalesce(a.doc_id, b.doc_id) AS doc_id,
       a.rank::BIGINT AS rank_a, round(a.score, {D}) AS score_a, b.rank::BIGINT AS rank_b, round(b.score, {D}) AS score_b
FROM run a FULL OUTER JOIN run2 b ON a.qid = b.qid AND a.doc_id = b.doc_id"""


def order_by_other_run(k: int = 10) -> str:
    return f"""WITH {compare_cte(k)}
SELECT b.qid, b.doc_id, b.rank::BIGINT AS rank_b, a.rank::BIGINT AS rank_a,
       row_number() OVER (PARTITION BY b.qid ORDER BY a.rank ASC NULLS LAST, b.rank, b.doc_id)::BIGINT AS rank
FROM run2 b LEFT JOIN run a ON a.qid = b.qid AND a.doc_id = b.doc_id"""


def rm3_ctes(fb_terms: int = 10, fb_docs: int = 10, a: float = 0.5) -> str:
    """Needs index_ctes + qw; defines fb (first pass) and expanded(qid, term, qw)."""
    return f"""{bm25_cte('fb', 'qw', fb_docs)},
fbp AS (SELECT fb.qid, fb.doc_id, fb.score, p.term, p.tf FROM fb JOIN post p USING (doc_id)
        JOIN dfs f USING (term) CROSS JOIN st
        WHERE length(p.term) BETWEEN 2 AND 20 AND f.df <= 0.1::DOUBLE * st.n),
fbk AS (SELECT *, row_number() OVER (PARTITION BY qid, doc_id ORDER BY tf DESC, term) AS r FROM fbp),
fbs AS (SELECT qid, doc_id, term, score, tf::DOUBLE / sum(tf) OVER (PARTITION BY qid, doc_id) AS share
        FROM fbk WHERE r <= {fb_terms}),
fbw AS (SELECT qid, term, sum(share * score) AS w FROM fbs GROUP BY qid, term),
fbb AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(w, 9) DESC, term) AS r FROM fbw),
ex AS (SELECT qid, term, w / sum(w) OVER (PARTITION BY qid) AS e FROM fbb WHERE r <= {fb_terms}),
og AS (SELECT qid, term, qw / sum(qw) OVER (PARTITION BY qid) AS o FROM qw),
mx AS (SELECT coalesce(og.qid, ex.qid) AS qid, coalesce(og.term, ex.term) AS term, o, e
       FROM og FULL OUTER JOIN ex ON og.qid = ex.qid AND og.term = ex.term),
expanded AS (SELECT qid, term,
  CASE WHEN max(CASE WHEN e IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY qid) > 0
       THEN {a}::DOUBLE * coalesce(o, 0) + {1 - a}::DOUBLE * coalesce(e, 0) ELSE o END AS qw FROM mx)"""


def rm3_terms() -> str:
    return f"""WITH {index_ctes()}, {query_terms_cte()}, {rm3_ctes()}
SELECT qid, term, round(qw, {D}) AS weight FROM expanded"""


def bm25_rm3_topk(k: int = 100) -> str:
    return f"""WITH {index_ctes()}, {query_terms_cte()}, {rm3_ctes()}, {bm25_cte('run', 'expanded', k)}
SELECT qid, doc_id, rank::BIGINT AS rank, round(score, {D}) AS score FROM run"""


def url_pattern() -> str:
    return URL_PATTERN


# ---------------------------------------------------------------- vectors (M3)

def hash_bow_cte(name: str, source: str, dim: int = 64) -> str:
    """Sparse unit vectors ``name(id, slot, v)`` of ``source(id, text)``."""
    return f"""
{name}_t AS (SELECT id, unnest({toks('text')}) AS term FROM ({source})),
{name}_h AS (SELECT id, ('0x' || substr(md5(term), 1, 8))::BIGINT AS h FROM {name}_t),
{name}_s AS (SELECT id, h % {dim} AS slot,
             sum(CASE WHEN (h // {dim}) % 2 = 0 THEN 1.0 ELSE -1.0 END)::DOUBLE AS v FROM {name}_h GROUP BY id, slot),
{name} AS (SELECT id, slot, v / greatest(sqrt(sum(v * v) OVER (PARTITION BY id)), 1e-12::DOUBLE) AS v FROM {name}_s)"""


BENCH_SRC = "SELECT item_id AS id, text FROM benchmark"
DOCS_SRC = "SELECT doc_id AS id, text FROM documents"


def embed_text() -> str:
    return f"""WITH {hash_bow_cte('bow', DOCS_SRC)}
SELECT id AS doc_id, slot::BIGINT AS slot, round(v, {D}) AS value FROM bow WHERE v <> 0"""


def _ranked(scores_cte: str, k: int, id_col: str = "vec_id") -> str:
    return f"""{scores_cte},
rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, {id_col}) AS rank FROM sc)"""


def _metric_sql(metric: str, a: str = "a.embedding", b: str = "b.embedding") -> str:
    if metric == "ip":
        return f"list_dot_product({a}::DOUBLE[], {b}::DOUBLE[])"
    if metric == "l2":
        return f"1 - pow(list_distance({a}::DOUBLE[], {b}::DOUBLE[]), 2)"
    if metric == "cosine":
        return (f"CASE WHEN list_dot_product({a}::DOUBLE[], {a}::DOUBLE[]) > 0 AND list_dot_product({b}::DOUBLE[], {b}::DOUBLE[]) > 0 "
                f"THEN list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[]) ELSE 0 END")
    raise ValueError(metric)


def knn_self(metric: str = "ip", k: int = 10) -> str:
    sc = f"sc AS (SELECT a.vec_id AS qid, b.vec_id, {_metric_sql(metric)} AS score FROM embeddings a CROSS JOIN embeddings b)"
    return f"""WITH {_ranked(sc, k)}
SELECT qid, vec_id, rank::BIGINT AS rank, round(score, {D}) AS score FROM rk WHERE rank <= {k}"""


def knn_text_ctes(k: int = 10) -> str:
    sc = """sc AS (SELECT qb.id AS qid, e.vec_id, sum(qb.v * e.embedding[qb.slot + 1]::DOUBLE) AS score
       FROM qb CROSS JOIN embeddings e GROUP BY qb.id, e.vec_id)"""
    return f"""{hash_bow_cte('qb', BENCH_SRC)}, {_ranked(sc, k)},
kt AS (SELECT qid, vec_id, score, rank FROM rk WHERE rank <= {k})"""


def knn_text_topk(k: int = 10) -> str:
    return f"""WITH {knn_text_ctes(k)}
SELECT qid, vec_id, rank::BIGINT AS rank, round(score, {D}) AS score FROM kt"""


def id_translate(k: int = 10) -> str:
    return f"""WITH {knn_text_ctes(k)}
SELECT kt.qid, kt.vec_id, d.doc_id, kt.rank::BIGINT AS rank FROM kt LEFT JOIN documents d ON d.doc_id = kt.vec_id"""


def fetch_embeddings(k: int = 10) -> str:
    return f"""WITH {knn_text_ctes(k)}
SELECT kt.qid, kt.vec_id, kt.rank::BIGINT AS rank, len(e.embedding)::BIGINT AS dim,
       round(list_sum(e.embedding::DOUBLE[]), {D}) AS emb_sum
FROM kt LEFT JOIN embeddings e USING (vec_id)"""


def knn_score_from_distance(k: int = 10) -> str:
    sc = f"sc AS (SELECT a.vec_id AS qid, b.vec_id, {_metric_sql('l2')} AS score FROM embeddings a CROSS JOIN embeddings b)"
    return f"""WITH {_ranked(sc, k)}
SELECT qid, vec_id, round(1 - score, {D}) AS distance, round(score, {D}) AS score FROM rk WHERE rank <= {k}"""


def l2_normalize() -> str:
    return f"""WITH n AS (SELECT vec_id, embedding,
  greatest(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 1e-12::DOUBLE) AS nrm FROM embeddings)
SELECT vec_id, (generate_subscripts(embedding, 1) - 1)::BIGINT AS pos, round(unnest(embedding)::DOUBLE / nrm, {D}) AS value FROM n"""


def pair_similarity() -> str:
    return f"""WITH {passage_qrels_cte()}, {hash_bow_cte('qb', BENCH_SRC)}, {hash_bow_cte('db', DOCS_SRC)},
s AS (SELECT qb.id AS qid, db.id AS did, sum(qb.v * db.v) AS dot FROM qb JOIN db ON qb.slot = db.slot GROUP BY 1, 2)
SELECT p.qid, p.did AS doc_id, round(least(greatest(coalesce(s.dot, 0), 0), 1), {D}) AS score
FROM pq p LEFT JOIN s ON s.qid = p.qid AND s.did = p.did"""


def token_features() -> str:
    return f"""WITH t AS (SELECT item_id AS qid, {toks('text')} AS tk FROM benchmark),
w AS (SELECT qid, tk, unnest(range(greatest(1, ceil(len(tk) / 62.0)::BIGINT))) AS win FROM t),
c AS (SELECT qid, win, tk[win * 62 + 1 : win * 62 + 62] AS chunk FROM w),
p AS (SELECT qid, win, chunk, unnest(range(64)) AS position FROM c)
SELECT qid, win::BIGINT AS window, position::BIGINT AS position,
  (CASE WHEN position = 0 THEN 101
        WHEN position <= len(chunk) THEN 1000 + (('0x' || substr(md5(chunk[position]), 1, 8))::BIGINT % 29522)
        WHEN position = len(chunk) + 1 THEN 102 ELSE 0 END)::BIGINT AS input_id,
  (CASE WHEN position <= len(chunk) + 1 THEN 1 ELSE 0 END)::BIGINT AS segment_id,
  (CASE WHEN position <= len(chunk) + 1 THEN 1 ELSE 0 END)::BIGINT AS input_mask
FROM p"""


# ---------------------------------------------------------------- neural (M5)

def dense_sql(x: str, n_in: int, n_out: int, relu: bool = True) -> str:
    """Formula-weight dense layer over the DOUBLE list ``x`` (SQL)."""
    bias = "0.25::DOUBLE" if n_out == 1 else "((((o * 7) % 5) - 2) / 100.0)"
    body = f"list_sum(list_transform(range({n_in}), lambda i: ((((o * 31 + i * 17) % 13) - 6) / 100.0) * {x}[i + 1])) + {bias}"
    if relu:
        body = f"greatest({body}, 0)"
    return f"list_transform(range({n_out}), lambda o: {body})"


def dense_query_cte(dim: int = 64) -> str:
    """``qd(id, qv)``: dense query vectors from the sparse ``qb``."""
    return f"""
qd AS (SELECT i.id, list(coalesce(qb.v, 0)::DOUBLE ORDER BY s.slot) AS qv
       FROM (SELECT DISTINCT id FROM qb) i CROSS JOIN range({dim}) s(slot)
       LEFT JOIN qb ON qb.id = i.id AND qb.slot = s.slot GROUP BY i.id)"""


def ffn_ctes(src: str, x: str, dim: int = 64, hidden: int = 16, extra: int = 24, out: str = "score") -> str:
    """Scorer layers over column ``x`` of ``src``; CTE ``{out}_l4`` has ``{out}``."""
    return f"""
{out}_l1 AS (SELECT *, {dense_sql(x, dim, hidden)} AS {out}_h1 FROM {src}),
{out}_l2 AS (SELECT *, {dense_sql(out + '_h1', hidden, extra)} AS {out}_h2 FROM {out}_l1),
{out}_l3 AS (SELECT *, {dense_sql(out + '_h2', extra, hidden)} AS {out}_h3 FROM {out}_l2),
{out}_l4 AS (SELECT *, {dense_sql(out + '_h3', hidden, 1, relu=False)}[1] AS {out} FROM {out}_l3)"""


def _qd_pairs_cte(k: int = 10) -> str:
    return f"""{knn_text_ctes(k)}, {dense_query_cte()},
xp AS (SELECT kt.qid, kt.vec_id, kt.rank, qd.qv, e.embedding::DOUBLE[] AS dv,
       list_transform(range(64), lambda i: qd.qv[i + 1] * e.embedding[i + 1]::DOUBLE) AS x
       FROM kt JOIN qd ON qd.id = kt.qid JOIN embeddings e USING (vec_id))"""


def rerank_ffn(k: int = 10) -> str:
    return f"""WITH {_qd_pairs_cte(k)}, {ffn_ctes('xp', 'x')},
rr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, rank, vec_id) AS nr FROM score_l4)
SELECT qid, vec_id, nr::BIGINT AS rank, rank::BIGINT AS prev_rank, round(score, {D}) AS score FROM rr"""


def score_pairs(k: int = 10) -> str:
    return f"""WITH {_qd_pairs_cte(k)},
tr AS (SELECT qid, vec_id AS pos_id, lead(vec_id) OVER (PARTITION BY qid ORDER BY rank) AS neg_id FROM kt),
tp AS (SELECT tr.*, list_transform(range(64), lambda i: qd.qv[i + 1] * p.embedding[i + 1]::DOUBLE) AS xpos,
              CASE WHEN n.embedding IS NOT NULL THEN list_transform(range(64), lambda i: qd.qv[i + 1] * n.embedding[i + 1]::DOUBLE) END AS xneg
       FROM tr JOIN qd ON qd.id = tr.qid JOIN embeddings p ON p.vec_id = tr.pos_id LEFT JOIN embeddings n ON n.vec_id = tr.neg_id),
{ffn_ctes('tp', 'xpos', out='sp')[1:]},
{ffn_ctes('sp_l4', 'xneg', out='sn')[1:]}
SELECT qid, pos_id, neg_id, round(sp, {D}) AS score_pos, round(CASE WHEN xneg IS NOT NULL THEN sn END, {D}) AS score_neg FROM sn_l4"""


def projection(mode: str, k: int = 10, n_out: int = 8) -> str:
    if mode == "ip":
        x, n_in = "x", 64
    elif mode == "cat":
        x, n_in = "list_concat(qv, dv)", 128
    else:
        x, n_in = "qv", 64
    return f"""WITH {_qd_pairs_cte(k)},
pr AS (SELECT qid, vec_id, {dense_sql('xx', n_in, n_out, relu=False)} AS y FROM (SELECT *, {x} AS xx FROM xp))
SELECT qid, vec_id, (generate_subscripts(y, 1) - 1)::BIGINT AS pos, round(unnest(y), {D}) AS value FROM pr"""


# ---------------------------------------------------------- reformulate (M6)

def _norm_list(y: str) -> str:
    return f"list_transform({y}, lambda v: v / greatest(sqrt(list_sum(list_transform({y}, lambda z: z * z))), 1e-12::DOUBLE))"


def _explode_vec(src: str, vec: str, keys: str = "qid") -> str:
    return f"""SELECT {keys}, (generate_subscripts({vec}, 1) - 1)::BIGINT AS pos, round(unnest({vec}), {D}) AS value FROM {src}"""


def reranked_ctes(k: int = 10) -> str:
    """``rr(qid, vec_id, qv, dv, score, rank, nr)``: k-NN of the hashed passages, re-ranked."""
    return f"""{_qd_pairs_cte(k)}, {ffn_ctes('xp', 'x')},
rr AS (SELECT qid, vec_id, qv, dv, score, rank,
       row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, rank, vec_id) AS nr FROM score_l4)"""


def reformulate_top1() -> str:
    return f"""WITH {reranked_ctes()}, t1 AS (SELECT qid, dv FROM rr WHERE nr = 1)
{_explode_vec('t1', 'dv')}"""


def reformulate_avg(topk: int = 5) -> str:
    return f"""WITH {reranked_ctes()},
fb AS (SELECT qid, list(dv ORDER BY nr) AS vs FROM rr WHERE nr <= {topk} GROUP BY qid),
av AS (SELECT qid, list_transform(range(64), lambda i: list_sum(list_transform(vs, lambda v: v[i + 1])) / len(vs)) AS m FROM fb)
{_explode_vec('av', 'm')}"""


def weighted_ctes(topk: int = 10) -> str:
    """Needs rr; defines ``wn(qid, y)``: the weighted-average reformulated vector."""
    return f"""
wx AS (SELECT qid, pos, sum(score * dv[pos + 1]) AS num
       FROM (SELECT *, unnest(range(64)) AS pos FROM rr WHERE nr <= {topk}) GROUP BY qid, pos),
ws AS (SELECT qid, sum(score) AS den FROM rr WHERE nr <= {topk} GROUP BY qid),
wm AS (SELECT wx.qid, list(num / den ORDER BY pos) AS m FROM wx JOIN ws USING (qid)
       WHERE abs(den) >= 1e-12::DOUBLE GROUP BY wx.qid),
wd AS (SELECT qid, {dense_sql('m', 64, 64, relu=False)} AS y FROM wm),
wn AS (SELECT qid, {_norm_list('y')} AS y FROM wd)"""


def reformulate_weighted() -> str:
    return f"""WITH {reranked_ctes()}, {weighted_ctes()[1:]}
{_explode_vec('wn', 'y')}"""


def interleave_cte(topk: int = 5) -> str:
    return f"""
nf AS (SELECT qid, any_value(qv) AS qv, list(dv ORDER BY nr) AS ds FROM rr WHERE nr <= {topk} GROUP BY qid),
ni AS (SELECT qid, flatten(list_transform(range(64), lambda i: list_concat([qv[i + 1]], list_transform(ds, lambda v: v[i + 1])))) AS x FROM nf)"""


def interleave() -> str:
    return f"""WITH {reranked_ctes()}, {interleave_cte()[1:]}
{_explode_vec('ni', 'x')}"""


def reformulate_neural(topk: int = 5, hidden: int = 32) -> str:
    n_in = (topk + 1) * 64
    return f"""WITH {reranked_ctes()}, {interleave_cte(topk)[1:]},
nh AS (SELECT qid, list_transform({dense_sql('x', n_in, hidden, relu=False)}, lambda z: 1 / (1 + exp(-z))) AS h FROM ni),
no AS (SELECT qid, {dense_sql('h', hidden, 64, relu=False)} AS y FROM nh),
nn AS (SELECT qid, {_norm_list('y')} AS y FROM no)
{_explode_vec('nn', 'y')}"""


def _layer_norm(x: str, dim: int = 64) -> str:
    """Scale 1 + bias and shift bias, both of the formula bias."""
    bias = "((((o * 7) % 5) - 2) / 100.0)"
    return (f"list_transform(range({dim}), lambda o: ({x}[o + 1] - list_avg({x})) / sqrt(list_avg(list_transform({x}, lambda z: "
            f"(z - list_avg({x})) * (z - list_avg({x})))) + 1e-5::DOUBLE) * (1 + {bias}) + {bias})")


def reformulate_encoder(topk: int = 5, heads: int = 4, ff: int = 32, dim: int = 64) -> str:
    """One encoder layer over [query, hits]: attention by joins of positions, the rest on lists."""
    hd = dim // heads
    def head(at: int) -> str:
        return f"[{at} + h * {hd} + 1:{at} + h * {hd} + {hd}]"

    return f"""WITH {reranked_ctes()},
t0 AS (SELECT qid, 0 AS s, any_value(qv) AS v FROM rr GROUP BY qid UNION ALL SELECT qid, nr AS s, dv AS v FROM rr WHERE nr <= {topk}),
t1 AS (SELECT qid, s, list_transform(range({dim}), lambda i: v[i + 1] * sqrt({dim}::DOUBLE) + CASE WHEN i % 2 = 0
         THEN sin(s * exp((i - i % 2) * (-ln(10000.0) / {dim}))) ELSE cos(s * exp((i - i % 2) * (-ln(10000.0) / {dim}))) END) AS x FROM t0),
t2 AS (SELECT qid, s, x, {dense_sql('x', dim, 3 * dim, relu=False)} AS p FROM t1),
t3 AS (SELECT a.qid, a.s, h, b.s AS t, list_dot_product(a.p{head(0)}::DOUBLE[], b.p{head(dim)}::DOUBLE[]) / sqrt({hd}::DOUBLE) AS z,
              b.p{head(2 * dim)} AS v FROM t2 a JOIN t2 b USING (qid) CROSS JOIN range({heads}) hs(h)),
t4 AS (SELECT *, exp(z - max(z) OVER w) AS e FROM t3 WINDOW w AS (PARTITION BY qid, s, h)),
t5 AS (SELECT *, e / sum(e) OVER (PARTITION BY qid, s, h) AS a FROM t4),
t6 AS (SELECT qid, s, h, i, sum(a * v[i + 1]) AS c FROM t5 CROSS JOIN range({hd}) cs(i) GROUP BY qid, s, h, i),
t7 AS (SELECT qid, s, list(c ORDER BY h, i) AS c FROM t6 GROUP BY qid, s),
t8 AS (SELECT qid, s, x, {dense_sql('c', dim, dim, relu=False)} AS o FROM t7 JOIN t2 USING (qid, s) WHERE s = 0),
t9 AS (SELECT qid, list_transform(range({dim}), lambda i: x[i + 1] + o[i + 1]) AS r FROM t8),
u1 AS (SELECT qid, {_layer_norm('r')} AS n FROM t9),
u2 AS (SELECT qid, n, {dense_sql('n', dim, ff)} AS f FROM u1),
u3 AS (SELECT qid, n, {dense_sql('f', ff, dim, relu=False)} AS g FROM u2),
u4 AS (SELECT qid, list_transform(range({dim}), lambda i: n[i + 1] + g[i + 1]) AS r FROM u3),
u5 AS (SELECT qid, {_layer_norm('r')} AS n FROM u4),
u6 AS (SELECT qid, {_norm_list('n')} AS y FROM u5)
{_explode_vec('u6', 'y')}"""


def positional_encoding() -> str:
    return f"""WITH {reranked_ctes()},
pe AS (SELECT qid, vec_id, list_transform(range(64), lambda i: CASE WHEN i % 2 = 0
         THEN sin(nr * exp((i - i % 2) * (-ln(10000.0) / 64)))
         ELSE cos(nr * exp((i - i % 2) * (-ln(10000.0) / 64))) END) AS p FROM rr)
{_explode_vec('pe', 'p', 'qid, vec_id')}"""


def prf_pipeline(k: int = 10) -> str:
    return f"""WITH {reranked_ctes(k)}, {weighted_ctes()[1:]},
s2 AS (SELECT wn.qid, e.vec_id, list_dot_product(wn.y, e.embedding::DOUBLE[]) AS score FROM wn CROSS JOIN embeddings e),
k2 AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s2),
x2 AS (SELECT k2.qid, k2.vec_id, k2.rank, list_transform(range(64), lambda i: wn.y[i + 1] * e.embedding[i + 1]::DOUBLE) AS x
       FROM k2 JOIN wn USING (qid) JOIN embeddings e USING (vec_id) WHERE k2.rank <= {k}),
{ffn_ctes('x2', 'x', out='s3')[1:]},
r3 AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(s3, 9) DESC, rank, vec_id) AS nr FROM s3_l4)
SELECT qid, vec_id, nr::BIGINT AS rank, round(s3, {D}) AS score, true AS reformulated FROM r3
UNION ALL
SELECT qid, vec_id, nr::BIGINT AS rank, round(score, {D}) AS score, false AS reformulated FROM rr WHERE qid NOT IN (SELECT qid FROM wn)"""


def prf_pipeline_undefined(k: int = 10) -> str:
    """All scores zero: the first pass in its own order."""
    return f"""WITH {knn_text_ctes(k)}
SELECT qid, vec_id, rank::BIGINT AS rank, 0.0::DOUBLE AS score, false AS reformulated FROM kt"""


def qrels_file() -> str:
    return "SELECT d.source AS qid, l.doc_id AS did, l.quality AS label FROM labels l JOIN documents d USING (doc_id)"


def queries_file() -> str:
    return r"SELECT item_id AS qid, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM benchmark"


def id_map() -> str:
    return "SELECT 'd' || doc_id AS doc_id, doc_id AS vec_id FROM documents"


def weights_rerank(k: int = 10) -> str:
    return f"""WITH {reranked_ctes(k)}
SELECT qid, vec_id, nr::BIGINT AS rank, rank::BIGINT AS prev_rank, round(score, 4) AS score FROM rr"""


def document_vectors() -> str:
    return f"""SELECT d.doc_id, d.doc_id AS vec_id, round(list_sum(e.embedding::DOUBLE[]), {D}) AS emb_sum
FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id"""


def whole_text(k: int = 10) -> str:
    return f"""WITH {bm25_run_ctes(k)}
SELECT qid, doc_id, rank::BIGINT AS rank, md5(text) AS text_md5 FROM run JOIN documents d USING (doc_id)"""


# ----------------------------------------------------------------- stems

def _suffix_case(rules, cond) -> str:
    arms = []
    for old, new in sorted(rules, key=lambda r: -len(r[0])):
        stem = f"left(w, length(w) - {len(old)})"
        arms.append(f"WHEN ends_with(w, '{old}') THEN CASE WHEN {cond(stem, old)} THEN {stem} || '{new}' ELSE w END")
    return "CASE " + " ".join(arms) + " ELSE w END"


def stem_ctes(source: str) -> str:
    """CTE ``stem(term, stem)`` of the words of ``source(term)``, a step of the rules per CTE."""
    def match(x, pattern):
        return f"regexp_matches({x}, '{pattern}')"

    def m1(x, _=""):
        return match(x, ST.MEASURED)

    def m2(x, _=""):
        return match(x, ST.MEASURED_TWICE)

    def short(x):
        return match(x, ST.SHORT_END)

    less = "left(w, length(w) - 1)"
    doubles = "(" + "|".join(c + c for c in ST.DOUBLED) + ")$"
    fourth = [("ion", "") if r in ("sion", "tion") else (r, "") for r in ST.STEP_4]
    steps = [
        _suffix_case(ST.PLURALS, lambda *_: "true"),
        _suffix_case([("eed", "ee")], m1),
        f"""CASE WHEN NOT c THEN w WHEN regexp_matches(w, '(at|bl|iz)$') THEN w || 'e' WHEN {match('w', doubles)} THEN {less}
            WHEN {m1('w')} AND NOT {m2('w')} AND {short('w')} THEN w || 'e' ELSE w END""",
        f"CASE WHEN lower(right(w, 1)) = 'y' AND {match(less, ST.V)} THEN {less} || 'i' ELSE w END",
        _suffix_case(ST.STEP_2, m1),
        _suffix_case(ST.STEP_3, m1),
        _suffix_case(sorted(set(fourth)), lambda x, old: m2(x) + (f" AND {match(x, '[st]$')}" if old == "ion" else "")),
        f"CASE WHEN right(w, 1) = 'e' AND ({m2(less)} OR ({m1(less)} AND NOT {short(less)})) THEN {less} ELSE w END",
        f"CASE WHEN right(w, 2) = 'll' AND {m2('w')} THEN {less} ELSE w END",
    ]
    cut = f"""CASE WHEN ends_with(w, 'eed') THEN NULL WHEN ends_with(w, 'ed') AND {match('left(w, length(w) - 2)', ST.V)} THEN left(w, length(w) - 2)
              WHEN ends_with(w, 'ing') AND {match('left(w, length(w) - 3)', ST.V)} THEN left(w, length(w) - 3) END"""
    ctes = [f"""s0 AS (SELECT DISTINCT term, regexp_replace(regexp_replace(regexp_replace(term, '^y', 'Y'), '([aeiou])y', '\\1Y', 'g'),
            'yy', 'yY', 'g') AS w, false AS c FROM {source})"""]
    for i, step in enumerate(steps):
        if i == 1:  # the ending goes, or the rule for the one that looks like it
            ctes.append(f"s2 AS (SELECT term, coalesce(cut, {step}) AS w, cut IS NOT NULL AS c FROM (SELECT *, {cut} AS cut FROM s1))")
        else:
            ctes.append(f"s{i + 1} AS (SELECT term, {step} AS w, c FROM s{i})")
    return ",\n".join(ctes) + f""",
stem AS (SELECT term, CASE WHEN regexp_matches(term, '^[a-z]{{3,}}$') THEN lower(w) ELSE term END AS stem FROM s{len(steps)})"""


def bm25_stemmed_topk(k: int = 100) -> str:
    index = index_ctes().replace("post AS", "words AS")
    index = index.replace("\ndfs AS", """
allterms AS (SELECT term FROM words UNION SELECT term FROM words0),
STEMS,
post AS (SELECT doc_id, stem AS term, sum(tf) AS tf, any_value(dl) AS dl FROM words JOIN stem USING (term) GROUP BY doc_id, stem),
dfs AS""")
    queries = query_terms_cte("words0").strip()
    index = index.replace("tk AS", f"{queries},\ntk AS", 1).replace("STEMS", stem_ctes("allterms"))
    return f"""WITH {index},
qw AS (SELECT qid, stem AS term, sum(qw) AS qw FROM words0 JOIN stem USING (term) GROUP BY qid, stem), {bm25_cte('run', 'qw', k)}
SELECT qid, doc_id, rank::BIGINT AS rank, round(score, {D}) AS score FROM run"""


def term_stems() -> str:
    return f"""WITH {index_ctes()}, vocabulary AS (SELECT DISTINCT term FROM post), {stem_ctes('vocabulary')}
SELECT term, stem FROM stem"""


# ---------------------------------------------------------------- snippets

def snippets(k: int = 10, n: int = 2) -> str:
    return f"""WITH {bm25_run_ctes(k)},
h AS (SELECT run.qid, run.doc_id, d.text FROM run JOIN documents d USING (doc_id)),
sp AS (SELECT qid, doc_id, regexp_split_to_array(text, '{SENTENCE_BOUNDARY}') AS parts FROM h),
se AS (SELECT qid, doc_id, unnest(parts) AS sent, generate_subscripts(parts, 1) AS idx FROM sp),
sn AS (SELECT qid, doc_id, idx, trim(sent) AS sent FROM se WHERE trim(sent) <> ''),
qt AS (SELECT item_id AS qid, list_distinct({toks('text')}) AS qterms FROM benchmark),
sc AS (SELECT sn.*, len(list_intersect(list_distinct({toks('sent')}), qt.qterms)) AS matched FROM sn JOIN qt USING (qid)),
rk AS (SELECT *, row_number() OVER (PARTITION BY qid, doc_id ORDER BY matched DESC, idx) AS r FROM sc),
b AS (SELECT qid, doc_id, string_agg(sent, ' ' ORDER BY idx) AS snippet FROM rk WHERE r <= {n} GROUP BY qid, doc_id)
SELECT run.qid, run.doc_id, b.snippet FROM run LEFT JOIN b ON b.qid = run.qid AND b.doc_id = run.doc_id"""


def covering_spans(k: int = 10) -> str:
    """Per end the smallest of the last positions of the hit's terms, then the shortest."""
    return f"""WITH {bm25_run_ctes(k)},
h AS (SELECT run.qid, run.doc_id, {toks('d.text')} AS t FROM run JOIN documents d USING (doc_id)),
ps AS (SELECT qid, doc_id, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS pos FROM h),
oc AS (SELECT ps.* FROM ps JOIN qw USING (qid, term)),
dt AS (SELECT DISTINCT qid, doc_id, term FROM oc),
nt AS (SELECT qid, doc_id, count(*) AS n_terms FROM dt GROUP BY qid, doc_id),
fn AS (SELECT e.qid, e.doc_id, e.pos, dt.term, max(o.pos) AS latest
       FROM oc e JOIN dt USING (qid, doc_id) LEFT JOIN oc o
       ON o.qid = e.qid AND o.doc_id = e.doc_id AND o.term = dt.term AND o.pos <= e.pos GROUP BY ALL),
en AS (SELECT qid, doc_id, pos, min(latest) AS start, count(latest) AS met FROM fn GROUP BY qid, doc_id, pos),
bs AS (SELECT en.qid, en.doc_id, n_terms, start, pos AS stop,
              row_number() OVER (PARTITION BY en.qid, en.doc_id ORDER BY pos - start, start) AS r
       FROM en JOIN nt USING (qid, doc_id) WHERE met = n_terms)
SELECT run.qid, run.doc_id, coalesce(n_terms, 0)::BIGINT AS n_terms, start::BIGINT AS start, stop::BIGINT AS stop,
       CASE WHEN start IS NOT NULL THEN array_to_string(h.t[start + 1:stop + 1], ' ') END AS span
FROM run LEFT JOIN (SELECT * FROM bs WHERE r = 1) b ON b.qid = run.qid AND b.doc_id = run.doc_id
LEFT JOIN h ON h.qid = run.qid AND h.doc_id = run.doc_id"""


def compare_pipelines(k: int = 10) -> str:
    """BM25 (no expansion) vs k-NN + re-rank, k-NN ids translated to documents."""
    return f"""WITH {bm25_run_ctes(k)}, {reranked_ctes(k)},
kd AS (SELECT rr.qid, d.doc_id, rr.nr AS rank, rr.score FROM rr LEFT JOIN documents d ON d.doc_id = rr.vec_id)
SELECT coalesce(a.qid, b.qid) AS qid, coalesce(a.doc_id, b.doc_id) AS doc_id,
       a.rank::BIGINT AS rank_a, round(a.score, {D}) AS score_a, b.rank::BIGINT AS rank_b, round(b.score, {D}) AS score_b
FROM run a FULL OUTER JOIN kd b ON a.qid = b.qid AND a.doc_id = b.doc_id"""


# ------------------------------------------------------------ index statistics

def term_stats() -> str:
    return f"WITH {index_ctes()} SELECT term, df::BIGINT AS df FROM dfs"


def doc_stats() -> str:
    return f"WITH {index_ctes()} SELECT doc_id, len(t)::BIGINT AS dl FROM tk"


def collection_stats() -> str:
    return f"WITH {index_ctes()} SELECT n::BIGINT AS n_docs, round(avgdl, {D}) AS avgdl FROM st"
