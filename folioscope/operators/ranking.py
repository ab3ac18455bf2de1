"""Retrieval scores and their fusion.

Query sides are broadcast behind a size check; document sides are never. All rankings end in an id, so
ties are the same however rows are partitioned. Scores are sums in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.runtime import Shared, bounded_broadcast, default_slices, scan_bytes

K1, B, EPSILON, RRF_BASE = 1.5, 0.75, 0.25, 60


def term_statistics(docs: DataFrame, tokens: Column) -> DataFrame:
    """(term, n, idf): document frequency and the floored Okapi idf over the whole vocabulary.

    Frequencies are counted map-side from each document's distinct terms, so what is shuffled grows with the
    vocabulary and not with the postings. Negative idf becomes EPSILON times the mean idf of the vocabulary;
    collection-wide numbers enter as scalar subqueries.
    """
    df = docs.select(F.explode(F.array_distinct(tokens)).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    n_docs = docs.agg(F.count("*").alias("n_docs")).scalar()
    raw = df.withColumn("raw", F.log(n_docs - F.col("n") + 0.5) - F.log(F.col("n") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean")).scalar()
    return raw.select("term", "n", F.when(F.col("raw") < 0, EPSILON * mean).otherwise(F.col("raw")).alias("idf"))


def asked_terms(queries: DataFrame, query_key: str, query_tokens: Column) -> DataFrame:
    """(query_key, term, qf)."""
    return queries.select(query_key, F.explode(query_tokens).alias("term")).groupBy(query_key, "term").agg(F.count("*").alias("qf"))


def asked_statistics(docs: DataFrame, tokens: Column, asked: DataFrame) -> DataFrame:
    """(term, idf, avgdl) of the asked terms only: what scoring needs of the whole collection."""
    avgdl = docs.agg(F.avg(F.size(tokens)).alias("avgdl")).scalar()
    return term_statistics(docs, tokens).join(bounded_broadcast(asked.select("term").distinct()), "term", "left_semi").select("term", "idf").withColumn("avgdl", avgdl)


def bm25(docs: DataFrame, key: str, tokens: Column, queries: DataFrame, query_key: str, query_tokens: Column, statistics: DataFrame | None = None) -> DataFrame:
    """(query_key, key, score) for every document that shares a term with the query; others score 0.

    Query terms count as often as they occur. Tokens meet the asked terms where they are read, so only hits are
    shuffled. statistics: asked_statistics() of a collection of which docs are a part, so that a few
    candidates are scored as in the whole. An empty collection or query gives no rows.
    """
    asked = asked_terms(queries, query_key, query_tokens)
    stats = asked_statistics(docs, tokens, asked) if statistics is None else statistics
    ready = docs.select(key, tokens.alias("t")).select(key, F.size("t").alias("dl"), F.explode("t").alias("term"))
    tf = ready.join(bounded_broadcast(asked.select("term").distinct()), "term", "left_semi").groupBy(key, "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    hits = tf.join(bounded_broadcast(asked), "term").join(bounded_broadcast(stats), "term")
    part = F.col("qf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return hits.groupBy(query_key, key).agg(F.sum(part).alias("score"))


#: Bytes of query vectors that are broadcast together; a larger set goes through in several blocks.
QUERY_BYTES = 64 << 20


def dense(docs: DataFrame, key: str, vector: str, queries: DataFrame, query_key: str, query_vector: str, top: int | None = None) -> DataFrame:
    """(query_key, key, score): cosine of a stated, bounded set of queries with all rows, in blocks.

    Query vectors are stacked once and every Arrow batch of documents meets them in one matrix product.
    top: rows below the batch's own top-th score of a query are dropped before anything is shuffled, which
    loses nothing of the overall top (ties at the edge are kept). Rows meet only queries of their own
    dimension; null vectors meet none; norms have 1e-12 added, so zero vectors score 0.
    """
    q = queries.select(query_key, F.col(query_vector).alias("_q")).where(F.col("_q").isNotNull())
    d = docs.select(key, F.col(vector).alias("_v")).where(F.col("_v").isNotNull())
    held = q.agg(F.sum(F.size("_q") * 8 + 64).alias("b")).first()["b"] or 0
    if held > QUERY_BYTES:
        blocks = -(-2 * held // QUERY_BYTES)
        out = None
        for k in range(blocks):
            part = dense(docs, key, vector, queries.where(F.pmod(F.xxhash64(query_key), F.lit(blocks)) == k), query_key, query_vector, top)
            out = part if out is None else out.unionByName(part)
        return out
    by_dim: dict[int, tuple[list, list]] = {}
    for r in q.toLocalIterator():
        if len(r["_q"]) and None not in r["_q"]:
            ids, rows = by_dim.setdefault(len(r["_q"]), ([], []))
            ids.append(r[query_key])
            rows.append(r["_q"])
    q_type = pa_type(q.schema[query_key].dataType)
    stacked = {}
    for n, (ids, rows) in by_dim.items():
        m = np.array(rows, np.float64)
        stacked[n] = (ids, m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-12))
    shared = Shared(docs.sparkSession, stacked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.get()
        for b in batches:
            size = pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False)
            for n, (ids, m) in known.items():
                at = np.flatnonzero(size == n)
                x = b.column(1).take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, n)
                keys, names = b.column(0).take(pa.array(at)), pa.array(ids, q_type)
                for lo in range(0, len(at), 1024):
                    part = x[lo : lo + 1024]
                    s = (part / (np.linalg.norm(part, axis=1, keepdims=True) + 1e-12)) @ m.T
                    keep = np.ones(s.shape, bool)
                    if top and len(s) > top:
                        keep = s >= -np.partition(-s, top - 1, axis=0)[top - 1] - 2e-9  # a tie to rankings
                    r, c = np.nonzero(keep)
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(c)), keys.take(pa.array(r + lo)), pa.array(s[r, c])], names=[query_key, key, "score"])

    return d.mapInArrow(run, f"`{query_key}` {q.schema[query_key].dataType.simpleString()}, `{key}` {d.schema[key].dataType.simpleString()}, score double")


def pa_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def steady(df: DataFrame, score: str) -> Column:
    """A score as rankings compare it: sums of doubles differ in their last bits with the order of partitions."""
    return F.round(score, 9) if dict(df.dtypes)[score] in ("double", "float") else F.col(score)


def rank_within(df: DataFrame, by: list[str], score: str, key: str, limit: int | None = None) -> DataFrame:
    """Adds rank from 1 by falling score, key on ties; limit is pushed into the window by Catalyst."""
    w = Window.partitionBy(*by).orderBy(steady(df, score).desc(), F.asc(key))
    out = df.withColumn("rank", F.row_number().over(w))
    return out.where(F.col("rank") <= limit) if limit else out


def normalise(df: DataFrame, by: list[str], score: str, out: str = "normalised") -> DataFrame:
    """Min-max within each group; a range below 1e-9 gives 1 where the maximum is positive, else 0."""
    w = Window.partitionBy(*by)
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    return df.withColumn(out, F.when(hi - lo < 1e-9, F.when(hi > 0, 1.0).otherwise(0.0)).otherwise((F.col(score) - lo) / (hi - lo)))


def weighted_rrf(ranked: DataFrame, by: list[str], key: str, weight: str | Column, base: int = RRF_BASE) -> DataFrame:
    """(by, key, score): sum of weight / (base + rank) over the rankings."""
    w = F.col(weight) if isinstance(weight, str) else weight
    return ranked.groupBy(*by, key).agg(F.sum(w / (base + F.col("rank"))).alias("score"))


def rrf_with_passage(ranked: DataFrame, by: list[str], key: str, ranking: str, passage: str, base: int = RRF_BASE) -> DataFrame:
    """Unweighted fusion; of the passages the first that is not null, in the order of the rankings."""
    first = F.min_by(passage, F.when(F.col(passage).isNotNull(), F.col(ranking)))
    return ranked.groupBy(*by, key).agg(F.sum(1.0 / (base + F.col("rank"))).alias("score"), first.alias(passage))


def blend_top3(df: DataFrame, by: list[str], score: str, tie: str) -> DataFrame:
    """0.7, 0.2 and 0.1 times the three best scores of each group; missing ones add nothing."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), F.asc(tie))
    best = df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= 3)
    part = F.when(F.col("_r") == 1, 0.7).when(F.col("_r") == 2, 0.2).otherwise(0.1) * F.col(score)
    return best.groupBy(*by).agg(F.sum(part).alias("score"))


def mix(sparse: DataFrame, dense_scores: DataFrame, by: list[str], sparse_weight: float, dense_weight: float) -> DataFrame:
    """Full outer join of two score tables; a missing score is 0."""
    s = sparse.select(*by, F.col("score").alias("_s"))
    d = dense_scores.select(*by, F.col("score").alias("_d"))
    both = s.join(d, by, "full")
    return both.select(*by, (sparse_weight * F.coalesce("_s", F.lit(0.0)) + dense_weight * F.coalesce("_d", F.lit(0.0))).alias("score"))


def best_passage(passages: DataFrame, scores: DataFrame, parents: DataFrame, query_key: str, passage: str, parent: str, queries: DataFrame) -> DataFrame:
    """(query, parent, score, passage): the best passage of each parent; parents without one score -inf.

    Of equal scores the passage with the smallest id wins.
    """
    joined = scores.join(passages.select(passage, parent), passage)
    best = joined.groupBy(query_key, parent).agg(F.max("score").alias("score"), F.min_by(passage, F.struct(-F.col("score"), F.col(passage))).alias(passage))
    # a stated, size-checked query set against all parents
    every = parents.select(parent).distinct().join(bounded_broadcast(queries.select(query_key)), F.lit(True))
    return every.join(best, [query_key, parent], "left").withColumn("score", F.coalesce("score", F.lit(float("-inf"))))


def full_ranking(scores: DataFrame, parents: DataFrame, queries: DataFrame, query_key: str, key: str) -> DataFrame:
    """(query_key, key, score, rank): every parent for every stated query, 0 where it has no score; ties by id."""
    every = parents.select(key).distinct().join(bounded_broadcast(queries.select(query_key).distinct()), F.lit(True))
    return rank_within(every.join(scores, [query_key, key], "left").withColumn("score", F.coalesce("score", F.lit(0.0))), [query_key], "score", key)


def post_limit_scope(ranked: DataFrame, allowed: DataFrame, key: str, limit: int) -> DataFrame:
    """Rank globally, cut, and only then drop what is out of scope: the semi-join stays above the window."""
    return ranked.where(F.col("rank") <= limit).join(allowed.select(key), key, "left_semi")


def sparse_dot(doc_weights: DataFrame, query_weights: DataFrame, key: str, query_key: str) -> DataFrame:
    """Learned-sparse score: sum over shared terms of query weight times document weight."""
    q = query_weights.select(query_key, "term", F.col("weight").alias("_q"))
    return doc_weights.join(bounded_broadcast(q), "term").groupBy(query_key, key).agg(F.sum(F.col("_q") * F.col("weight")).alias("score"))


def late_interaction(doc_tokens: DataFrame, query_tokens: DataFrame, key: str, query_key: str) -> DataFrame:
    """Sum over query tokens of the best dot product with an unmasked document token.

    doc_tokens: (key, vector, masked); query_tokens: (query_key, position, vector).
    """
    from folioscope.functions.vectors import dot

    q = query_tokens.select(query_key, "position", F.col("vector").alias("_q"))
    docs = doc_tokens.where(~F.col("masked")).select(key, F.col("vector").alias("_v"))
    if scan_bytes(q) <= QUERY_BYTES:
        pairs = docs.join(F.broadcast(q), F.size("_v") == F.size("_q"))
    else:  # every document token meets every query token: in blocks of either side
        n = default_slices(doc_tokens.sparkSession)
        left = docs.withColumn("_n", F.size("_v")).withColumn("_b", F.pmod(F.xxhash64("_v"), F.lit(n)))
        right = q.withColumn("_n", F.size("_q")).withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).cast("bigint"))
        pairs = left.join(right, ["_n", "_b"])
    best = pairs.groupBy(query_key, key, "position").agg(F.max(dot("_q", "_v")).alias("m"))
    return best.groupBy(query_key, key).agg(F.sum("m").alias("score"))


def phrase_hits(chunks: DataFrame, key: str, text: Column, terms: DataFrame, query_key: str, term: str) -> DataFrame:
    """(query_key, key, score): distinct terms hit, plus 0.05 for each matching chunk; whole-token containment.

    terms: a bounded set of query terms; chunk texts are normalised once, before meeting them.
    """
    from folioscope.functions.text import contains_phrase, match_text

    t = terms.select(query_key, match_text(term).alias("_m")).where(F.col("_m") != "")
    pairs = chunks.select(key, "chunk_id", match_text(text).alias("_h")).join(bounded_broadcast(t), contains_phrase(F.col("_h"), F.col("_m")))
    return pairs.groupBy(query_key, key).agg((F.countDistinct("_m") + 0.05 * F.countDistinct("chunk_id")).alias("score"))
