"""Queries of search, fusion and evaluation, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from engram import store
from engram.functions.text import CODE_KEYWORDS, cache_key, tokenize
from engram.functions.vectors import padded, valid
from engram.operators import evaluation, lifecycle, search
from engram.sources import tables

TERMS = ["with", "from", "this"]
QUERY_ID = 7
LEAST = 0.1
_METHODS = ("lucene", "robertson", "atire", "bm25l", "bm25+")


def _vector(spark, d):
    """The query: one stored vector, a single row."""
    r = tables.vectors(spark, d).where(F.col("chunk_id") == QUERY_ID).first()
    return list(r["embedding"])


def _others(spark, d):
    return tables.vectors(spark, d).where(F.col("chunk_id") != QUERY_ID)


def _knn(spark, d):
    return search.knn(_others(spark, d), _vector(spark, d), 10)


_INDEXES: dict[tuple[str, str], str] = {}


def _index(spark, d):
    """The index of the documents of a folder: written at its first use in a session, read from then on."""
    key = spark.sparkContext.applicationId, d
    if key not in _INDEXES:
        folder = f"{store.work_dir(spark)}/index-{uuid.uuid4().hex}"
        search.build_index(tables.read(spark, d, "documents"), folder)
        _INDEXES[key] = folder
    return search.load_index(spark, _INDEXES[key])


def _round(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _v(spark, d):
    return _knn(spark, d).select(F.col("chunk_id").alias("id"), F.col("similarity").alias("score"))


def _b(spark, d, k=10):
    return search.bm25(_index(spark, d), TERMS, k).select(F.col("doc_id").alias("id"), "score")


def _with_memory(spark, d):
    m = tables.memories(spark, d).select(F.col("memory_id").alias("chunk_id"), "tags", "workspace_id")
    return _others(spark, d).join(m, "chunk_id")


def _rel(spark, d):
    return tables.qrels(spark, d).where("relevant").select(F.col("doc_id").alias("id"), "grade")


def _hits(spark, d):
    return search.ranked(_b(spark, d, 20), "id", "score")


def _hybrid(spark, d, method="rrf"):
    return search.hybrid(_others(spark, d), _index(spark, d), _vector(spark, d), TERMS, 10, method=method)


def _embedding_cache(spark, d):
    docs = tables.read(spark, d, "documents").select("doc_id", cache_key(F.col("text")).alias("key"))
    cache = docs.where("doc_id % 2 = 0").select("key").distinct().withColumn("cached", F.lit(1))
    return lifecycle.hit_rate(docs.join(cache, "key", "left"), "cached")


def _rerank(spark, d):
    found = _index(spark, d).postings.where(F.col("term").isin(TERMS)).groupBy(F.col("doc_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    hits = _hybrid(spark, d).join(found, "id", "left")
    return search.rerank(hits, F.coalesce("n", F.lit(0)) + F.col("score"), 10).select("id", F.round("rerank_score", 6).alias("rerank_score"))


def _term_counts(spark, d):
    """df and tf of each term, from sorted tokens: a token unlike the one before it is a text's first of its kind."""
    t = tables.read(spark, d, "documents").select(F.array_sort(tokenize(F.col("text"))).alias("t"))
    pairs = F.transform("t", lambda x, i: F.struct(x.alias("term"), ((i == 0) | (x != F.get("t", i - 1))).cast("long").alias("new")))
    return t.select(F.explode(pairs).alias("x")).groupBy("x.term").agg(F.sum("x.new").alias("df"), F.count(F.lit(1)).alias("tf"))


def _by_text(spark, d):
    """Keyword hits without ids, as a service may give them, matched by their texts to those of vector hits."""
    docs = tables.read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    hits = search.bm25(_index(spark, d), TERMS, 20).select(F.col("doc_id").alias("index"), "score").join(docs.withColumnRenamed("id", "index"), "index")
    named = docs.where("id % 3 = 0").withColumn("rank", F.col("id"))
    return _round(search.match_by_text(hits, named), "score").select("id", "score", F.sha2("text", 256).alias("digest"))


QUERIES = {
    "knn_cosine_topk": lambda s, d: _round(_knn(s, d), "similarity"),
    "knn_threshold": lambda s, d: _round(search.knn(_others(s, d), _vector(s, d), 1000, LEAST), "similarity"),
    "knn_filtered_pre": lambda s, d: _round(search.knn(_with_memory(s, d), _vector(s, d), 10, where=F.array_contains("tags", F.lit("q1"))), "similarity"),
    "knn_filtered_post": lambda s, d: _round(search.knn(_with_memory(s, d), _vector(s, d), 10, where=F.array_contains("tags", F.lit("q1")), prefilter=False), "similarity"),
    "knn_batch_per_query": lambda s, d: _round(search.knn_batch(tables.vectors(s, d), tables.vectors(s, d).where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query")), 5), "similarity"),
    "embedding_validate": lambda s, d: tables.vectors(s, d).select("chunk_id", valid(F.col("embedding"), 64).alias("ok"), F.size(padded(F.col("embedding"), 96)).cast("long").alias("padded_dim")),
    "embedding_cache_hits": _embedding_cache,
    "tokenize_code": _term_counts,
    "hybrid_match_by_text": _by_text,
    **{f"bm25_{m.replace('+', 'plus')}": (lambda s, d, m=m: _round(search.bm25(_index(s, d), TERMS, 20, m), "score")) for m in _METHODS},
    "bm25_minmax_topk": lambda s, d: _round(search.min_max(_b(s, d)), "score", "normalized"),
    "bm25_index_stats": lambda s, d: _round(search.index_stats(_index(s, d)), "mean_tokens"),
    "fuse_rrf": lambda s, d: _round(search.rrf(_v(s, d), _b(s, d)).select("id", "score"), "score"),
    "fuse_rrf_ranks": lambda s, d: _round(search.rrf(_v(s, d), _b(s, d)), "score").withColumns({c: F.col(c).cast("string") for c in ("v_rank", "b_rank")}),
    "fuse_rsf": lambda s, d: _round(search.rsf(_v(s, d), _b(s, d)), "score"),
    "fuse_dbsf": lambda s, d: _round(search.dbsf(_v(s, d), _b(s, d)), "score"),
    "fuse_dbsf_fixed_range": lambda s, d: _round(search.dbsf(_v(s, d), _b(s, d), 0.3, (0.0, 1.0), (0.0, 5.0)), "score"),
    "hybrid_search": lambda s, d: _round(_hybrid(s, d), "score"),
    "hybrid_search_rsf": lambda s, d: _round(_hybrid(s, d, "rsf"), "score"),
    "fusion_overlap_counts": lambda s, d: search.overlap_counts(_v(s, d), _b(s, d)),
    "rerank_sigmoid": _rerank,
    "eval_all": lambda s, d: evaluation.evaluate(_hits(s, d), _rel(s, d), 10),
    "eval_recall_precision": lambda s, d: evaluation.evaluate(_hits(s, d), _rel(s, d), 5).select("recall", "precision"),
    "eval_mrr": lambda s, d: evaluation.evaluate(_hits(s, d), _rel(s, d), 10).select("mrr"),
    "eval_ndcg": lambda s, d: evaluation.evaluate(_hits(s, d), _rel(s, d), 10).select("ndcg"),
    "eval_ap": lambda s, d: evaluation.evaluate(_hits(s, d), _rel(s, d), 10).select("ap"),
    "normalise_three_sigma": lambda s, d: search.three_sigma(_b(s, d, 50)).select("id", F.round("normalized", 6).alias("normalized")),
    "token_filter_long": lambda s, d: tables.read(s, d, "documents").select("doc_id", F.size(tokenize(F.col("text"), 4)).cast("long").alias("n")),
}

_TOK = "list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[^\\p{L}\\p{M}\\p{N}_\\s]|_', ' ', 'g'), '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')), '\\s+'), lambda x: len(x) >= 2 AND regexp_matches(x, '[\\p{L}\\p{N}]'))"
_V = f"""v0 AS (SELECT vec_id AS chunk_id, embedding::DOUBLE[] AS e FROM embeddings),
sims AS (SELECT a.chunk_id, round(list_cosine_similarity(a.e, q.e), 12) AS similarity FROM v0 a, v0 q WHERE q.chunk_id = {QUERY_ID} AND a.chunk_id <> {QUERY_ID}),
v AS (SELECT chunk_id AS id, similarity AS score FROM sims ORDER BY similarity DESC, chunk_id LIMIT 10)"""
_IDX = f"idx AS (SELECT doc_id, {_TOK} AS w FROM documents), st AS (SELECT count(*)::DOUBLE AS n, avg(len(w)) AS mean FROM idx)"
_IDF = {"lucene": "ln(1 + (n - df + 0.5) / (df + 0.5))", "robertson": "ln(greatest(1, (n - df + 0.5) / (df + 0.5)))", "atire": "ln(n / df)", "bm25l": "ln((n + 1) / (df + 0.5))", "bm25+": "ln((n + 1) / df)"}
_TF = {"lucene": "tf / (1.5 * d + tf)", "robertson": "tf / (1.5 * d + tf)", "atire": "tf * 2.5 / (tf + 1.5 * d)", "bm25l": "2.5 * (tf / d + 0.5) / (1.5 + tf / d + 0.5)", "bm25+": "(2.5 * tf / (1.5 * d + tf) + 0.5)"}


def _bm(method="lucene", terms=TERMS, name="all_hits", prelude=True):
    """CTEs up to a table (doc_id, score) of all hits."""
    return (_IDX + "," if prelude else "") + f"""
{name}_t AS (SELECT doc_id, t, len(w) AS dl, len(list_filter(w, lambda x: x = t))::DOUBLE AS tf FROM idx, (SELECT unnest({terms}) AS t)),
{name} AS (SELECT doc_id, round(sum(CASE WHEN tf > 0 THEN {_IDF[method]} * {_TF[method]} ELSE 0 END), 12) AS score FROM (SELECT *, 0.25 + 0.75 * dl / mean AS d, sum((tf > 0)::INT) OVER (PARTITION BY t) AS df FROM {name}_t, st) WHERE tf > 0 GROUP BY doc_id)"""


def _top(k, name="all_hits"):
    return f"b AS (SELECT doc_id AS id, score FROM {name} ORDER BY score DESC, doc_id LIMIT {k})"


BM25 = _bm()
_BOTH = f"WITH {_V}, {_bm()}, {_top(10)}"
_RRF = """vr AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS r FROM v), br AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS r FROM b),
f AS (SELECT coalesce(vr.id, br.id) AS id, round(coalesce(0.5 / (60 + vr.r), 0) + coalesce(0.5 / (60 + br.r), 0), 12) AS score, vr.r AS v_rank, br.r AS b_rank FROM vr FULL JOIN br ON vr.id = br.id)"""
_MM = "CASE WHEN max(score) OVER () > min(score) OVER () THEN (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) ELSE 1.0 END"
_3S = "CASE WHEN count(*) OVER () <= 1 OR stddev_pop(score) OVER () = 0 THEN 1.0 ELSE greatest(0, least(1, (score - (avg(score) OVER () - 3 * stddev_pop(score) OVER ())) / (6 * stddev_pop(score) OVER ()))) END"


def _weigh(v, b, alpha):
    return f"vn AS (SELECT id, {v} AS s FROM v), bn AS (SELECT id, {b} AS s FROM b), f AS (SELECT coalesce(vn.id, bn.id) AS id, round({alpha} * coalesce(vn.s, 0) + {1 - alpha} * coalesce(bn.s, 0), 12) AS score FROM vn FULL JOIN bn ON vn.id = bn.id)"


_MEMV = f"m AS (SELECT d.doc_id, coalesce(l.quality = 1, FALSE) AS q1 FROM documents d LEFT JOIN labels l USING (doc_id)), sm AS (SELECT s.*, q1 FROM sims s JOIN m ON m.doc_id = s.chunk_id)"


def _eval(k, cols):
    return f"""WITH {_bm()}, {_top(20)}, h AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM b),
r AS (SELECT doc_id AS id, (quality * 2 + 1 - toxic)::DOUBLE AS grade FROM labels WHERE quality = 1),
t AS (SELECT count(*) AS n, sum(CASE WHEN p <= {k} THEN (2 ** grade - 1) / log2(p + 1) END) AS ideal FROM (SELECT *, row_number() OVER (ORDER BY grade DESC, id) AS p FROM r WHERE grade > 0)),
j AS (SELECT h.rank, grade, (grade IS NOT NULL)::INT AS hit, sum((grade IS NOT NULL)::INT) OVER (ORDER BY h.rank) AS seen FROM h LEFT JOIN (SELECT * FROM r WHERE grade > 0) g USING (id)),
g AS (SELECT sum(CASE WHEN rank <= {k} THEN hit ELSE 0 END) AS hits, min(CASE WHEN hit = 1 THEN rank END) AS first, sum(CASE WHEN hit = 1 AND rank <= {k} THEN (2 ** grade - 1) / log2(rank + 1) END) AS dcg, sum(CASE WHEN hit = 1 THEN seen / rank END) AS precisions FROM j),
e AS (SELECT round(coalesce(hits / n, 0), 6) AS recall, round(coalesce(hits / {k}.0, 0), 6) AS precision, round(coalesce(1 / first, 0), 6) AS mrr, round(coalesce(dcg / ideal, 0), 6) AS ndcg, round(coalesce(precisions / n, 0), 6) AS ap FROM g, t)
SELECT {cols} FROM e"""


SQL = {
    "knn_cosine_topk": f"WITH {_V} SELECT chunk_id, round(similarity, 6) AS similarity FROM sims ORDER BY sims.similarity DESC, chunk_id LIMIT 10",
    "knn_threshold": f"WITH {_V} SELECT chunk_id, round(similarity, 6) AS similarity FROM sims WHERE similarity >= {LEAST} ORDER BY sims.similarity DESC, chunk_id LIMIT 1000",
    "knn_filtered_pre": f"WITH {_V}, {_MEMV} SELECT chunk_id, round(similarity, 6) AS similarity FROM sm WHERE q1 ORDER BY sm.similarity DESC, chunk_id LIMIT 10",
    "knn_filtered_post": f"WITH {_V}, {_MEMV} SELECT chunk_id, round(similarity, 6) AS similarity FROM (SELECT * FROM sm ORDER BY similarity DESC, chunk_id LIMIT 10) WHERE q1",
    "knn_batch_per_query": "WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, round(list_cosine_similarity(v.e, q.e), 12) AS similarity FROM v JOIN v q ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS rank FROM p) SELECT * REPLACE (round(similarity, 6) AS similarity) FROM r WHERE rank <= 5",
    "embedding_validate": "SELECT vec_id AS chunk_id, len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AS ok, greatest(len(embedding), 96)::BIGINT AS padded_dim FROM embeddings",
    "embedding_cache_hits": "WITH k AS (SELECT doc_id, sha256(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS key FROM documents), c AS (SELECT DISTINCT key FROM k WHERE doc_id % 2 = 0), j AS (SELECT c.key IS NOT NULL AS hit FROM k LEFT JOIN c USING (key)) SELECT count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, round(count(*) FILTER (hit) / count(*), 6) AS hit_rate FROM j",
    "tokenize_code": f"WITH t AS (SELECT doc_id, unnest({_TOK}) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS tf FROM t GROUP BY term",
    **{f"bm25_{m.replace('+', 'plus')}": f"WITH {_bm(m)} SELECT doc_id, round(score, 6) AS score FROM all_hits ORDER BY all_hits.score DESC, doc_id LIMIT 20" for m in _METHODS},
    "bm25_minmax_topk": f"WITH {_bm()}, {_top(10)} SELECT id, round(score, 6) AS score, round({_MM}, 6) AS normalized FROM b",
    "hybrid_match_by_text": f"WITH {_bm()}, {_top(20)}, n AS (SELECT text, min(doc_id) AS m FROM documents WHERE doc_id % 3 = 0 GROUP BY text) SELECT coalesce(m::VARCHAR, 'bm25_' || doc_id) AS id, round(score, 6) AS score, sha256(d.text) AS digest FROM b JOIN documents d ON d.doc_id = b.id LEFT JOIN n ON n.text = d.text",
    "bm25_index_stats": f"WITH {_IDX} SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_tokens, round(avg(len(w)), 6) AS mean_tokens FROM idx",
    "fuse_rrf": f"{_BOTH}, {_RRF} SELECT id, round(score, 6) AS score FROM f",
    "fuse_rrf_ranks": f"{_BOTH}, {_RRF} SELECT id, round(score, 6) AS score, v_rank::VARCHAR AS v_rank, b_rank::VARCHAR AS b_rank FROM f",
    "fuse_rsf": f"{_BOTH}, {_weigh(_MM, _MM, 0.5)} SELECT id, round(score, 6) AS score FROM f",
    "fuse_dbsf": f"{_BOTH}, {_weigh(_3S, _3S, 0.5)} SELECT id, round(score, 6) AS score FROM f",
    "fuse_dbsf_fixed_range": f"{_BOTH}, {_weigh('greatest(0, least(1, score))', 'greatest(0, least(1, score / 5))', 0.3)} SELECT id, round(score, 6) AS score FROM f",
    "hybrid_search": f"{_BOTH}, {_RRF} SELECT id, round(score, 6) AS score FROM f ORDER BY f.score DESC, id LIMIT 10",
    "hybrid_search_rsf": f"{_BOTH}, {_weigh(_MM, _MM, 0.5)} SELECT id, round(score, 6) AS score FROM f ORDER BY f.score DESC, id LIMIT 10",
    "fusion_overlap_counts": f"{_BOTH} SELECT count(*) FILTER (b.id IS NULL) AS vector_only, count(*) FILTER (v.id IS NULL) AS bm25_only, count(*) FILTER (v.id IS NOT NULL AND b.id IS NOT NULL) AS \"both\" FROM v FULL JOIN b ON v.id = b.id",
    "rerank_sigmoid": f"{_BOTH}, {_RRF}, top AS (SELECT id, score FROM f ORDER BY f.score DESC, id LIMIT 10) SELECT id, round(1 / (1 + exp(-(coalesce(len(list_distinct(list_filter(w, lambda x: list_contains({TERMS}, x)))), 0) + score))), 6) AS rerank_score FROM top LEFT JOIN idx ON idx.doc_id = top.id",
    "eval_all": _eval(10, "*"),
    "eval_recall_precision": _eval(5, "recall, precision"),
    "eval_mrr": _eval(10, "mrr"),
    "eval_ndcg": _eval(10, "ndcg"),
    "eval_ap": _eval(10, "ap"),
    "normalise_three_sigma": f"WITH {_bm()}, {_top(50)} SELECT id, round({_3S}, 6) AS normalized FROM b",
    "token_filter_long": f"SELECT doc_id, len(list_filter({_TOK}, lambda x: len(x) >= 4 OR list_contains({list(CODE_KEYWORDS)}, x)))::BIGINT AS n FROM documents",
}
