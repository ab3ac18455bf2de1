"""Retrieval: tokens, BM25, dense and learned scores, fusion, passages, the standard methods."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.models import hashed_encoder
from folioscope.operators import ranking as R
from folioscope.plans.common import sql_ascii_tokens, sql_match, sql_tokens, table


def _questions(s: SparkSession, d: str) -> DataFrame:
    """All questions of the held-out items: a fixed table of some hundred rows."""
    return table(s, d, "eval_items").where("kind = 'question'").select("item_id", F.col("text").alias("query"), "topic")


def token_counts(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "documents").select("doc_id", T.tokens("text").alias("a"), T.ascii_tokens("text").alias("b"))
    return t.select("doc_id", F.size("a").alias("n_tokens"), F.size(F.array_distinct("a")).alias("n_distinct"), F.size("b").alias("n_ascii"))


def idf_table(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents")
    stats = R.term_statistics(docs, T.ascii_tokens("text"))
    return stats.select("term", "n", F.round("idf", 6).alias("idf"))


def _bm25(s: SparkSession, d: str) -> DataFrame:
    q = _questions(s, d)
    return R.bm25(table(s, d, "documents"), "doc_id", T.ascii_tokens("text"), q, "item_id", T.ascii_tokens("query"))


def bm25_topk(s: SparkSession, d: str) -> DataFrame:
    scores = _bm25(s, d).withColumn("score", F.round("score", 6))
    return R.rank_within(scores, ["item_id"], "score", "doc_id", 20)


def bm25_positive_only(s: SparkSession, d: str) -> DataFrame:
    return _bm25(s, d).where("score > 0").groupBy("item_id").agg(F.count("*").alias("n_positive"), F.round(F.max("score"), 5).alias("best"))


def cosine_topk(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "embeddings").select("vec_id", "embedding")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    scores = R.dense(e, "vec_id", "embedding", q, "query_id", "q", 10).withColumn("score", F.round("score", 6))
    return R.rank_within(scores, ["query_id"], "score", "vec_id", 10)


def _supplier_rankings(s: SparkSession, d: str) -> DataFrame:
    total = table(s, d, "lineitem").groupBy("l_returnflag", "l_suppkey").agg(F.round(F.sum("l_quantity"), 2).alias("score"), F.max("l_partkey").alias("part"))
    return R.rank_within(total, ["l_returnflag"], "score", "l_suppkey")


def rrf_weighted(s: SparkSession, d: str) -> DataFrame:
    w = F.when(F.col("l_returnflag") == "A", 0.5).when(F.col("l_returnflag") == "N", 0.3).otherwise(0.2)
    return R.weighted_rrf(_supplier_rankings(s, d).withColumn("one", F.lit(1)), [], "l_suppkey", w).withColumn("score", F.round("score", 9))


def rrf_hybrid(s: SparkSession, d: str) -> DataFrame:
    r = _supplier_rankings(s, d).withColumn("part", F.when(F.col("part") % 3 != 0, F.col("part")))
    return R.rrf_with_passage(r, [], "l_suppkey", "l_returnflag", "part").withColumn("score", F.round("score", 9))


def minmax_normalize(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "customer").select("c_nationkey", "c_custkey", F.greatest(F.lit(0.0), "c_acctbal").alias("score"))
    return R.normalise(c, ["c_nationkey"], "score").select("c_nationkey", "c_custkey", F.round("normalised", 6).alias("normalised"))


def top3_blend(s: SparkSession, d: str) -> DataFrame:
    return R.blend_top3(table(s, d, "orders"), ["o_custkey"], "o_totalprice", "o_orderkey").select("o_custkey", F.round("score", 4).alias("score"))


def max_passage(s: SparkSession, d: str) -> DataFrame:
    """Papers by their best evidence unit for each topic; without one the score is null (minus infinity)."""
    units = table(s, d, "evidence_units").select("evidence_id", "paper_id", F.length("text").alias("n"))
    scores = units.select("evidence_id", (F.col("n") % 97).cast("double").alias("score"), F.lit("q").alias("query_id"))
    parents = table(s, d, "papers").select("paper_id")
    out = R.best_passage(units, scores, parents, "query_id", "evidence_id", "paper_id", s.createDataFrame([("q",)], "query_id string"))
    return out.select("paper_id", "evidence_id", F.when(F.col("score") > float("-inf"), F.col("score")).alias("score"))


def post_limit_scope(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").withColumn("n_chars", F.coalesce("n_chars", F.lit(0)))
    ranked = R.rank_within(docs.select("doc_id", "n_chars", F.lit(0).alias("g")), ["g"], "n_chars", "doc_id", 120)
    return R.post_limit_scope(ranked, docs.where("lang = 'en'"), "doc_id", 120).select("doc_id", "n_chars", "rank")


def full_outer_scores(s: SparkSession, d: str) -> DataFrame:
    li = table(s, d, "lineitem")
    a = li.where("l_returnflag = 'A'").groupBy("l_suppkey").agg(F.avg("l_discount").alias("score"))
    b = li.where("l_linestatus = 'O' AND l_quantity > 45").groupBy("l_suppkey").agg(F.avg("l_tax").alias("score"))
    return R.mix(a, b, ["l_suppkey"], 0.55, 0.45).select("l_suppkey", F.round("score", 6).alias("score"))


def literal_phrase_hits(s: SparkSession, d: str) -> DataFrame:
    terms = table(s, d, "eval_items").select(F.col("topic").alias("plan_id"), F.col("topic").alias("term")).distinct()
    from folioscope.operators.records import latest

    chunks = latest(table(s, d, "chunks").select("chunk_id", "paper_id", "heading", "text", "ingested_at"), "chunk_id", "ingested_at")
    return R.phrase_hits(chunks, "paper_id", F.concat_ws(" ", "heading", "text"), terms, "plan_id", "term").withColumn("score", F.round("score", 4))


def sparse_dot_topk(s: SparkSession, d: str) -> DataFrame:
    tf = lambda df, key, text: df.select(key, F.explode(T.ascii_tokens(text)).alias("term")).groupBy(key, "term").agg(F.log1p(F.count("*").cast("double")).alias("weight"))
    docs = tf(table(s, d, "documents"), "doc_id", "text")
    q = tf(_questions(s, d), "item_id", "query")
    scores = R.sparse_dot(docs, q, "doc_id", "item_id").withColumn("score", F.round("score", 6))
    return R.rank_within(scores, ["item_id"], "score", "doc_id", 10)


def late_interaction(s: SparkSession, d: str) -> DataFrame:
    """Labels as documents of token vectors; every hundredth vector is a query token of its thousand."""
    e = table(s, d, "embeddings")
    docs = e.select(F.col("label").alias("doc"), F.col("embedding").alias("vector"), F.lit(False).alias("masked"))
    q = e.where("vec_id % 100 = 0").select(F.floor(F.col("vec_id") / 1000).cast("bigint").alias("query_id"), F.col("vec_id").alias("position"), F.col("embedding").alias("vector"))
    return R.late_interaction(docs, q, "doc", "query_id").select("query_id", "doc", F.round("score", 6).alias("score"))


def result_rows(s: SparkSession, d: str) -> DataFrame:
    """Result assembly of BM25 full-text retrieval over papers: rank, matched terms (substring test, at most 8, sorted), reason."""
    from folioscope.operators.records import latest

    papers = latest(table(s, d, "papers").select("paper_id", "title", "abstract", "text", "year", "venue", "ingested_at"), "paper_id", "ingested_at")
    q = _questions(s, d)
    body = T.ascii_tokens(F.concat_ws("\n", "title", "abstract", "text"))
    scores = R.bm25(papers, "paper_id", body, q, "item_id", T.ascii_tokens("query")).withColumn("score", F.round("score", 5))
    ranked = R.rank_within(scores, ["item_id"], "score", "paper_id", 20)
    seen = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit(""))))
    j = ranked.join(q.select("item_id", F.array_distinct(T.ascii_tokens("query")).alias("terms")), "item_id").join(papers.select("paper_id", "year", "venue", seen.alias("seen")), "paper_id")
    matched = F.slice(F.array_sort(F.filter("terms", lambda t: F.col("seen").contains(t))), 1, 8)
    return j.select("item_id", "paper_id", "rank", "score", "year", "venue", F.array_join(matched, " ").alias("matched_terms"), F.lit("Ranked from the full indexed paper text.").alias("reason"))


def hybrid_retrieval(s: SparkSession, d: str) -> DataFrame:
    """BM25 full text fused with a dense passage ranking; every paper has a place in both, also with score 0."""
    from folioscope.operators.records import latest

    papers = latest(table(s, d, "papers").select("paper_id", "title", "abstract", "text", "ingested_at"), "paper_id", "ingested_at")
    chunks = latest(table(s, d, "chunks").select("chunk_id", "paper_id", "heading", "text", "ingested_at"), "chunk_id", "ingested_at").where(F.length(F.trim("text")) >= 20)
    q = _questions(s, d)
    sparse = R.bm25(papers, "paper_id", T.ascii_tokens(F.concat_ws("\n", "title", "abstract", "text")), q, "item_id", T.ascii_tokens("query"))
    encode = hashed_encoder(unit=False)
    dense = R.dense(chunks.withColumn("v", encode(F.concat_ws("\n", "heading", "text"))), "chunk_id", "v", q.withColumn("qv", encode("query")), "item_id", "qv").withColumn("score", F.round("score", 6))
    a = R.best_passage(chunks, dense, papers, "item_id", "chunk_id", "paper_id", q)
    b = a.select("item_id", "paper_id").join(sparse, ["item_id", "paper_id"], "left").select("item_id", "paper_id", F.round(F.coalesce("score", F.lit(0.0)), 5).alias("score"), F.lit(None).cast("string").alias("chunk_id"))
    both = R.rank_within(b, ["item_id"], "score", "paper_id").withColumn("ranking", F.lit(0)).unionByName(R.rank_within(a.select(*b.columns), ["item_id"], "score", "paper_id").withColumn("ranking", F.lit(1)))
    fused = R.rrf_with_passage(both, ["item_id"], "paper_id", "ranking", "chunk_id")
    return R.rank_within(fused.withColumn("score", F.round("score", 12)), ["item_id"], "score", "paper_id", 20).withColumn("score", F.round("score", 9))


def rank_in_group(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("paper_id").orderBy(F.desc("token_count"), "chunk_id")
    return table(s, d, "chunks").select("paper_id", "chunk_id", "token_count").distinct().withColumn("rank", F.row_number().over(w))


QUERIES = {
    f.__name__: f
    for f in (token_counts, idf_table, bm25_topk, bm25_positive_only, cosine_topk, rrf_weighted, rrf_hybrid, minmax_normalize, top3_blend, max_passage, post_limit_scope, full_outer_scores, literal_phrase_hits, sparse_dot_topk, late_interaction, result_rows, hybrid_retrieval, rank_in_group)
}


def _sql_bm25(docs: str, key: str, tokens: str) -> str:
    return f"""
docs AS ({docs}), tok AS (SELECT {key}, {tokens} AS t FROM docs),
stat AS (SELECT count(*) AS n_docs, avg(len(t)) AS avgdl FROM tok),
post AS (SELECT {key}, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT {key}, len(t) AS dl, unnest(t) AS term FROM tok) GROUP BY ALL),
freq AS (SELECT term, count(*) AS n, ln((SELECT n_docs FROM stat) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post GROUP BY term),
idf AS (SELECT term, n, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM freq) ELSE raw END AS idf FROM freq),
asked AS (SELECT item_id, term, count(*) AS qf FROM (SELECT item_id, unnest({sql_ascii_tokens("text")}) AS term FROM eval_items WHERE kind = 'question') GROUP BY ALL),
scores AS (SELECT item_id, {key}, sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avgdl FROM stat)))) AS score FROM post JOIN asked USING (term) JOIN idf USING (term) GROUP BY ALL)"""


_DOCS = _sql_bm25("SELECT doc_id, text FROM documents", "doc_id", sql_ascii_tokens("text"))
_PAPERS = _sql_bm25("SELECT DISTINCT paper_id, title, abstract, text, year, venue FROM papers", "paper_id", sql_ascii_tokens("concat_ws(chr(10), title, abstract, text)"))
_SUPP = "SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY score DESC, l_suppkey) AS rank FROM (SELECT l_returnflag, l_suppkey, round(sum(l_quantity), 2) AS score, max(l_partkey) AS part FROM lineitem GROUP BY ALL)"

ORACLE = {
    "token_counts": f"SELECT doc_id, len(a) AS n_tokens, len(list_distinct(a)) AS n_distinct, len(b) AS n_ascii FROM (SELECT doc_id, {sql_tokens('text')} AS a, {sql_ascii_tokens('text')} AS b FROM documents)",
    "idf_table": f"WITH {_DOCS} SELECT term, n, round(idf, 6) AS idf FROM idf",
    "bm25_topk": f"WITH {_DOCS} SELECT * FROM (SELECT item_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM scores) WHERE rank <= 20",
    "bm25_positive_only": f"WITH {_DOCS} SELECT item_id, count(*) AS n_positive, round(max(score), 5) AS best FROM scores WHERE score > 0 GROUP BY item_id",
    "cosine_topk": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0)) WHERE rank <= 10",
    "rrf_weighted": f"SELECT l_suppkey, round(sum(CASE l_returnflag WHEN 'A' THEN 0.5 WHEN 'N' THEN 0.3 ELSE 0.2 END / (60 + rank)), 9) AS score FROM ({_SUPP}) GROUP BY l_suppkey",
    "rrf_hybrid": f"SELECT l_suppkey, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, arg_min(part, l_returnflag) FILTER (part % 3 <> 0) AS part FROM ({_SUPP}) GROUP BY l_suppkey",
    "minmax_normalize": "SELECT c_nationkey, c_custkey, round(CASE WHEN hi - lo < 1e-9 THEN CASE WHEN hi > 0 THEN 1.0 ELSE 0.0 END ELSE (score - lo) / (hi - lo) END, 6) AS normalised FROM (SELECT *, min(score) OVER (PARTITION BY c_nationkey) AS lo, max(score) OVER (PARTITION BY c_nationkey) AS hi FROM (SELECT c_nationkey, c_custkey, greatest(0.0, c_acctbal) AS score FROM customer))",
    "top3_blend": "SELECT o_custkey, round(sum(CASE r WHEN 1 THEN 0.7 WHEN 2 THEN 0.2 ELSE 0.1 END * o_totalprice), 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3 GROUP BY o_custkey",
    "max_passage": "SELECT p.paper_id, e.evidence_id, e.score FROM (SELECT DISTINCT paper_id FROM papers) p LEFT JOIN (SELECT paper_id, max(s) AS score, arg_min(evidence_id, (-s, evidence_id)) AS evidence_id FROM (SELECT paper_id, evidence_id, (length(text) % 97)::DOUBLE AS s FROM evidence_units) GROUP BY paper_id) e USING (paper_id)",
    "post_limit_scope": "SELECT doc_id, n_chars, rank FROM (SELECT doc_id, n_chars, lang, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM (SELECT doc_id, coalesce(n_chars, 0) AS n_chars, lang FROM documents)) WHERE rank <= 120 AND lang = 'en'",
    "full_outer_scores": "SELECT coalesce(a.k, b.k) AS l_suppkey, round(0.55 * coalesce(a.s, 0) + 0.45 * coalesce(b.s, 0), 6) AS score FROM (SELECT l_suppkey AS k, avg(l_discount) AS s FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) a FULL JOIN (SELECT l_suppkey AS k, avg(l_tax) AS s FROM lineitem WHERE l_linestatus = 'O' AND l_quantity > 45 GROUP BY 1) b ON a.k = b.k",
    "literal_phrase_hits": f"""WITH c AS (SELECT DISTINCT chunk_id, paper_id, {sql_match("concat_ws(' ', heading, text)")} AS h FROM chunks), t AS (SELECT DISTINCT topic, {sql_match("topic")} AS m FROM eval_items)
SELECT topic AS plan_id, paper_id, round((count(DISTINCT m) + 0.05 * count(DISTINCT chunk_id))::DOUBLE, 4) AS score FROM c JOIN t ON contains(' ' || h || ' ', ' ' || m || ' ') GROUP BY ALL""",
    "sparse_dot_topk": f"""WITH dw AS (SELECT doc_id, term, ln(1 + count(*)::DOUBLE) AS w FROM (SELECT doc_id, unnest({sql_ascii_tokens("text")}) AS term FROM documents) GROUP BY ALL),
qw AS (SELECT item_id, term, ln(1 + count(*)::DOUBLE) AS w FROM (SELECT item_id, unnest({sql_ascii_tokens("text")}) AS term FROM eval_items WHERE kind = 'question') GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT item_id, doc_id, round(sum(dw.w * qw.w), 6) AS score FROM dw JOIN qw USING (term) GROUP BY ALL)) WHERE rank <= 10""",
    "late_interaction": "SELECT query_id, doc, round(sum(m), 6) AS score FROM (SELECT q.vec_id // 1000 AS query_id, q.vec_id AS position, e.label AS doc, max(list_inner_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[])) AS m FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0 GROUP BY ALL) GROUP BY ALL",
    "result_rows": f"""WITH {_PAPERS}, ranked AS (SELECT item_id, paper_id, round(score, 5) AS score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 5) DESC, paper_id) AS rank FROM scores)
SELECT r.item_id, r.paper_id, r.rank, r.score, p.year, p.venue, array_to_string(list_sort(list_filter(list_distinct({sql_ascii_tokens("q.text")}), lambda x: contains(lower(concat_ws(' ', coalesce(p.title, ''), coalesce(p.abstract, ''))), x)))[1:8], ' ') AS matched_terms, 'Ranked from the full indexed paper text.' AS reason
FROM ranked r JOIN docs p USING (paper_id) JOIN eval_items q USING (item_id) WHERE rank <= 20""",
    "rank_in_group": "SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY token_count DESC, chunk_id) AS rank FROM (SELECT DISTINCT paper_id, chunk_id, token_count FROM chunks)",
}
