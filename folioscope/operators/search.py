"""Multi-stage search as one lazy plan over a batch of query plans.

Plan tables (bounded, broadcast behind a size check):
  queries(plan_id, kind, name, query, weight)  kind: global, aspect, bucket (name is then the bucket id)
  terms(plan_id, kind, term)                    kind: entity, phrase
  buckets(plan_id, bucket_id, description, target)
Record tables: papers(paper_id, corpus_key, search_text), sections(section_id, paper_id, search_text,
match_text), chunks(chunk_id, section_id, paper_id, chunk_type, heading, text, search_text).
Sections and chunks are scored only where they belong to a candidate, with the statistics of the whole collection.
Ties are broken by ids throughout. Empty tables give empty results at every stage.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.models import Encoder, Reranker, Verifier, hashed_encoder, threshold_verifier, zero_reranker
from folioscope.operators import projections as P
from folioscope.operators import ranking as R
from folioscope.operators.records import latest
from folioscope.operators.selection import best_query, verdict_top
from folioscope.runtime import bounded_broadcast, cut, materialise

#: Fixed values of the stages.
SOURCE_LIMIT, POOL, SHORTLIST, TOP_K, SECTIONS, TEXT_LIMIT = 120, 50, 20, 10, 4, 1200
SOURCE_WEIGHTS = {"paper_sparse": 0.28, "paper_dense": 0.22, "section_aggregated": 0.35, "literal_entity": 0.10, "exact_phrase": 0.05}
RESULT_WORDS = ("result", "evaluation", "metric", "comparison")


@dataclass
class Plan:
    queries: DataFrame
    terms: DataFrame
    buckets: DataFrame


@dataclass
class Index:
    papers: DataFrame
    sections: DataFrame
    chunks: DataFrame
    #: asked_statistics() of each level, where they were made
    statistics: dict[str, DataFrame] = field(default_factory=dict)


@dataclass
class Models:
    encoder: Encoder = field(default_factory=lambda: hashed_encoder(unit=False))
    reranker: Reranker = zero_reranker
    verifier: Verifier = field(default_factory=threshold_verifier)


def _tokens(df: DataFrame) -> DataFrame:
    return df if "_t" in df.columns else df.withColumn("_t", T.tokens("search_text"))


def _sparse(docs: DataFrame, key: str, queries: DataFrame, statistics: DataFrame | None = None) -> DataFrame:
    return R.bm25(_tokens(docs), key, F.col("_t"), queries.withColumn("_q", T.tokens("query")), "qid", F.col("_q"), statistics)


def _statistics(index: Index, level: str, queries: DataFrame) -> DataFrame:
    got = index.statistics.get(level)
    if got is None:
        asked = R.asked_terms(queries.withColumn("_q", T.tokens("query")), "qid", F.col("_q"))
        got = R.asked_statistics(_tokens(getattr(index, level)), F.col("_t"), asked)
    return got


def _dense(docs: DataFrame, key: str, queries: DataFrame, encoder: Encoder, top: int | None = None) -> DataFrame:
    ready = docs if "v" in docs.columns else docs.withColumn("v", encoder(F.col("search_text")))
    return R.dense(ready, key, "v", queries.withColumn("qv", encoder(F.col("query"))), "qid", "qv", top)


def distinct_queries(plan: Plan) -> tuple[DataFrame, DataFrame]:
    """(queries with qid, the distinct trimmed query texts (qid, query)): each text is scored once."""
    q = plan.queries.withColumn("query", F.trim("query")).where(F.col("query") != "").withColumn("qid", F.xxhash64("query"))
    return q, q.select("qid", "query").dropDuplicates(["qid"])


def encoded(index: Index, models: Models, plan: Plan) -> Index:
    """The index with vectors and tokens, laid down once: every stage reads them, none encodes a document again.

    The statistics of each level hold the terms of the plans only.
    """
    one = lambda df: materialise(_tokens(df).withColumn("v", models.encoder(F.col("search_text"))))
    out = Index(one(index.papers), one(index.sections), one(index.chunks))
    _, texts = distinct_queries(plan)
    out.statistics = {level: materialise(_statistics(out, level, texts)) for level in ("papers", "sections", "chunks")}
    return out


def candidates(plan: Plan, index: Index, allowed: DataFrame, models: Models, scope_pushdown: bool = False) -> DataFrame:
    """(plan_id, paper_id, coarse): five sources fused by weighted reciprocal ranks, with bonuses; the best POOL.

    Each query's ranking is cut before the scope filter, unless scope_pushdown.
    """
    q, texts = distinct_queries(plan)
    q = q.where(F.col("kind").isin("global", "aspect"))
    texts = texts.join(q.select("qid").distinct(), "qid", "left_semi")
    papers = index.papers.join(allowed.select("paper_id"), "paper_id", "left_semi") if scope_pushdown else index.papers
    sources, hits = [], []
    for name, scores in (("paper_sparse", _sparse(papers, "paper_id", texts, None if scope_pushdown else _statistics(index, "papers", texts))), ("paper_dense", _dense(papers, "paper_id", texts, models.encoder, SOURCE_LIMIT))):
        ranked = R.rank_within(scores.where("score > 0"), ["qid"], "score", "paper_id", SOURCE_LIMIT)
        kept = R.post_limit_scope(ranked, allowed, "paper_id", SOURCE_LIMIT)
        # rankings are renumbered after the scope filter
        kept = cut(R.rank_within(kept.withColumn("_o", -F.col("rank")).drop("rank"), ["qid"], "_o", "paper_id"))
        per = kept.join(bounded_broadcast(q), "qid")
        fused = R.weighted_rrf(per, ["plan_id"], "paper_id", F.when(F.col("kind") == "global", 1.0).otherwise(F.col("weight")))
        sources.append(fused.withColumn("source", F.lit(name)))
        hits.append(per.where("kind = 'aspect'").select("plan_id", "paper_id", "name"))
    limit = max(SOURCE_LIMIT * 12, 300)
    s = R.rank_within(_sparse(index.sections, "section_id", texts, _statistics(index, "sections", texts)).where("score > 0"), ["qid"], "score", "section_id", limit)
    d = R.rank_within(_dense(index.sections, "section_id", texts, models.encoder, limit).where("score > 0"), ["qid"], "score", "section_id", limit)
    mixed = R.mix(s, d, ["qid", "section_id"], 0.55, 0.45).where("score > 0")
    of_paper = mixed.join(index.sections.select("section_id", "paper_id"), "section_id").join(allowed.select("paper_id"), "paper_id", "left_semi")
    per = cut(R.blend_top3(of_paper, ["qid", "paper_id"], "score", "section_id")).join(bounded_broadcast(q), "qid")
    w = F.when(F.col("kind") == "global", 1.0).otherwise(F.col("weight"))
    sources.append(per.groupBy("plan_id", "paper_id").agg(F.sum(w * F.col("score")).alias("score")).withColumn("source", F.lit("section_aggregated")))
    hits.append(per.where("kind = 'aspect'").select("plan_id", "paper_id", "name"))
    chunks = index.chunks.join(allowed.select("paper_id"), "paper_id", "left_semi")
    text = F.concat_ws(" ", "heading", "text")
    for kind, name in (("entity", "literal_entity"), ("phrase", "exact_phrase")):
        got = R.phrase_hits(chunks, "paper_id", text, plan.terms.where(F.col("kind") == kind), "plan_id", "term")
        sources.append(got.select("plan_id", "paper_id", "score").withColumn("source", F.lit(name)))
    every = sources[0].select("plan_id", "paper_id", "score", "source")
    for x in sources[1:]:
        every = every.unionByName(x.select("plan_id", "paper_id", "score", "source"))
    ranked = cut(R.rank_within(every, ["plan_id", "source"], "score", "paper_id", SOURCE_LIMIT))
    weight = F.coalesce(*[F.when(F.col("source") == k, F.lit(v)) for k, v in SOURCE_WEIGHTS.items()])
    fused = ranked.groupBy("plan_id", "paper_id").agg(
        F.sum(weight / (R.RRF_BASE + F.col("rank"))).alias("rrf"),
        F.count("*").alias("n_sources"),
        F.max((F.col("source") == "literal_entity").cast("int")).alias("literal"),
        F.max((F.col("source") == "exact_phrase").cast("int")).alias("phrase"),
    )
    covered = hits[0].unionByName(hits[1]).unionByName(hits[2]).groupBy("plan_id", "paper_id").agg(F.countDistinct("name").alias("n_aspects"))
    aspects = q.where("kind = 'aspect'").groupBy("plan_id").agg(F.countDistinct("name").alias("aspects"))
    used = ranked.groupBy("plan_id").agg(F.countDistinct("source").alias("used"))
    coarse = (
        F.col("rrf")
        + 0.08 * F.coalesce(F.col("n_aspects") / F.col("aspects"), F.lit(0.0))
        + 0.05 * F.col("n_sources") / F.col("used")
        + 0.08 * F.col("literal")
        + 0.04 * F.col("phrase")
    )
    out = fused.join(covered, ["plan_id", "paper_id"], "left").join(aspects, "plan_id", "left").join(used, "plan_id")
    return R.rank_within(out.select("plan_id", "paper_id", coarse.alias("coarse")), ["plan_id"], "coarse", "paper_id", POOL)


def narrow_sections(plan: Plan, index: Index, pool: DataFrame, models: Models) -> DataFrame:
    """(plan_id, paper_id, section_id, score): the best SECTIONS sections of each candidate, scores above 0."""
    q, texts = distinct_queries(plan)
    n = q.where("kind = 'bucket'").groupBy("plan_id", "name").agg(F.count("*").alias("n"))
    q = q.join(bounded_broadcast(n), ["plan_id", "name"], "left").withColumn("w", F.when(F.col("kind") == "global", 1.0).when(F.col("kind") == "aspect", F.col("weight")).otherwise(0.35 / F.col("n")))
    mine = pool.select("plan_id", "paper_id").join(index.sections.select("paper_id", "section_id", "match_text"), "paper_id")
    grid = mine.drop("match_text").join(bounded_broadcast(q.select("plan_id", "qid", "w")), "plan_id")
    total = None
    held = cut(index.sections.join(mine.select("section_id").distinct(), "section_id", "left_semi"))
    stats = _statistics(index, "sections", texts)
    for scores, weight in ((_sparse(held, "section_id", texts, stats), 0.55), (_dense(held, "section_id", texts, models.encoder), 0.45)):
        g = grid.join(scores, ["qid", "section_id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
        g = R.normalise(g, ["plan_id", "qid", "paper_id"], "score", "x").groupBy("plan_id", "paper_id", "section_id").agg(F.sum(weight * F.col("w") * F.col("x")).alias("s"))
        total = g if total is None else total.unionByName(g)
    total = total.groupBy("plan_id", "paper_id", "section_id").agg(F.sum("s").alias("s"))
    terms = plan.terms.select("plan_id", F.col("kind").alias("k"), T.match_text("term").alias("m")).where("m <> ''")
    hit = mine.alias("a").join(bounded_broadcast(terms).alias("t"), (F.col("a.plan_id") == F.col("t.plan_id")) & T.contains_phrase(F.col("a.match_text"), F.col("t.m")))
    bonus = hit.groupBy("a.plan_id", "a.section_id").agg((F.max((F.col("k") == "entity").cast("int")) * 0.08 + F.max((F.col("k") == "phrase").cast("int")) * 0.05).alias("bonus"))
    scored = total.join(bonus, ["plan_id", "section_id"], "left").select("plan_id", "paper_id", "section_id", (F.col("s") + F.coalesce("bonus", F.lit(0.0))).alias("score"))
    return R.rank_within(scored, ["plan_id", "paper_id"], "score", "section_id", SECTIONS).where("score > 0").drop("rank")


def assemble_evidence(plan: Plan, index: Index, narrowed: DataFrame, models: Models) -> DataFrame:
    """(plan_id, paper_id, bucket_id, chunk_id, chunk_type, source_query, heading, text, score, rank): per
    bucket the best `target` chunks of the narrowed sections.

    The bonus for tables and figures steers the preselection and is not part of the final score.
    """
    q, texts = distinct_queries(plan)
    q = q.where("kind = 'bucket'").withColumnRenamed("name", "bucket_id").join(bounded_broadcast(plan.buckets), ["plan_id", "bucket_id"])
    mine = narrowed.select("plan_id", "paper_id", "section_id").join(index.chunks.select("section_id", "chunk_id", "chunk_type", "heading", "text"), "section_id")
    grid = mine.join(bounded_broadcast(q.select("plan_id", "bucket_id", "qid", "query", "description", "target")), "plan_id")
    texts = texts.join(q.select("qid").distinct(), "qid", "left_semi")
    held = cut(index.chunks.join(narrowed.select("section_id").distinct(), "section_id", "left_semi"))
    s = _sparse(held, "chunk_id", texts, _statistics(index, "chunks", texts)).withColumnRenamed("score", "s")
    d = _dense(held, "chunk_id", texts, models.encoder).withColumnRenamed("score", "d")
    g = grid.join(s, ["qid", "chunk_id"], "left").join(d, ["qid", "chunk_id"], "left").fillna(0.0, ["s", "d"])
    by = ["plan_id", "paper_id", "bucket_id", "qid"]
    g = R.normalise(R.normalise(g, by, "s", "ns"), by, "d", "nd")
    wanted = F.lit(False)
    for word in RESULT_WORDS:
        wanted = wanted | F.lower("description").contains(word)
    bonus = F.when(F.col("chunk_type").isin("table_chunk", "figure_chunk") & wanted, 0.04).otherwise(0.0)
    g = g.withColumn("score", 0.35 * F.col("ns") + 0.40 * F.col("nd") + bonus).withColumn("pick", F.struct("query", "ns", "nd", "chunk_type", "heading", "text", "description", "target"))
    best = best_query(g, ["plan_id", "paper_id", "bucket_id", "chunk_id"], "pick", "query").select("plan_id", "paper_id", "bucket_id", "chunk_id", "score", "pick.*")
    pre = R.rank_within(best, ["plan_id", "paper_id", "bucket_id"], "score", "chunk_id").where(F.col("rank") <= F.greatest(4 * F.col("target"), F.lit(8)))
    reranked = pre.withColumn("r", models.reranker(F.concat_ws(" :: ", "description", "query"), F.concat_ws(" ", "heading", "text")))
    reranked = R.normalise(reranked, ["plan_id", "paper_id", "bucket_id"], "r", "nr").withColumn("score", 0.35 * F.col("ns") + 0.40 * F.col("nd") + 0.25 * F.col("nr"))
    out = R.rank_within(reranked.drop("rank"), ["plan_id", "paper_id", "bucket_id"], "score", "chunk_id").where(F.col("rank") <= F.col("target"))
    return out.select("plan_id", "paper_id", "bucket_id", "chunk_id", "chunk_type", F.col("query").alias("source_query"), "heading", T.truncate("text", TEXT_LIMIT).alias("text"), "score", "rank")


def global_evidence(plan: Plan, index: Index, pool: DataFrame, models: Models) -> DataFrame:
    """(plan_id, paper_id, bucket_id, chunk_id, source_query, score, rank) without any narrowing: a candidate's best
    chunks for the global query, scores above 0, dealt to the buckets in order, `target` to each."""
    q, texts = distinct_queries(Plan(plan.queries.where("kind = 'global'"), plan.terms, plan.buckets))
    w = Window.partitionBy("plan_id").orderBy("bucket_id")
    need = plan.buckets.withColumn("need", F.greatest(F.lit(1), "target"))
    slots = need.select("plan_id", "bucket_id", (F.sum("need").over(w) - F.col("need")).alias("after"), "need")
    total = need.groupBy("plan_id").agg(F.sum("need").alias("total"))
    held = cut(index.chunks.join(pool.select("paper_id").distinct(), "paper_id", "left_semi"))
    mine = pool.select("plan_id", "paper_id").join(held.select("paper_id", "chunk_id"), "paper_id").join(bounded_broadcast(q.select("plan_id", "qid", "query")), "plan_id")
    s = _sparse(held, "chunk_id", texts, _statistics(index, "chunks", texts)).withColumnRenamed("score", "s")
    d = _dense(held, "chunk_id", texts, models.encoder).withColumnRenamed("score", "d")
    g = mine.join(s, ["qid", "chunk_id"], "left").join(d, ["qid", "chunk_id"], "left").fillna(0.0, ["s", "d"])
    by = ["plan_id", "paper_id"]
    g = R.normalise(R.normalise(g, by, "s", "ns"), by, "d", "nd").withColumn("score", 0.35 * F.col("ns") + 0.40 * F.col("nd")).where("score > 0")
    best = R.rank_within(g, by, "score", "chunk_id").join(bounded_broadcast(total), "plan_id").where(F.col("rank") <= F.col("total"))
    dealt = best.join(bounded_broadcast(slots), "plan_id").where((F.col("rank") > F.col("after")) & (F.col("rank") <= F.col("after") + F.col("need")))
    return dealt.select("plan_id", "paper_id", "bucket_id", "chunk_id", F.col("query").alias("source_query"), "score", (F.col("rank") - F.col("after")).cast("int").alias("rank"))


def shortlist(plan: Plan, pool: DataFrame, narrowed: DataFrame, evidence: DataFrame, limit: int = SHORTLIST) -> DataFrame:
    """(plan_id, paper_id, coarse, section_score, evidence_score, pre_score, rank), the best `limit` of each plan."""
    sec = R.blend_top3(narrowed, ["plan_id", "paper_id"], "score", "section_id").withColumnRenamed("score", "section_score")
    best = evidence.groupBy("plan_id", "paper_id", "bucket_id").agg(F.max("score").alias("score"))
    strong = R.blend_top3(best, ["plan_id", "paper_id"], "score", "bucket_id").withColumnRenamed("score", "strength")
    n = plan.buckets.groupBy("plan_id").agg(F.countDistinct("bucket_id").alias("n_buckets"))
    cover = best.groupBy("plan_id", "paper_id").agg(F.count("*").alias("covered"))
    key = ["plan_id", "paper_id"]
    df = pool.select(*key, "coarse").join(sec, key, "left").join(strong, key, "left").join(cover, key, "left").join(bounded_broadcast(n), "plan_id", "left").fillna(0.0, ["section_score", "strength"]).fillna(0, ["covered"])
    df = df.withColumn("evidence_score", 0.7 * F.col("strength") + 0.3 * F.col("covered") / F.greatest(F.lit(1), F.coalesce("n_buckets", F.lit(1))))
    for c in ("coarse", "section_score", "evidence_score"):
        df = R.normalise(df, ["plan_id"], c, f"n_{c}")
    df = df.withColumn("pre_score", 0.35 * F.col("n_coarse") + 0.25 * F.col("n_section_score") + 0.40 * F.col("n_evidence_score"))
    return R.rank_within(df.select(*key, "coarse", "section_score", "evidence_score", "pre_score"), ["plan_id"], "pre_score", "paper_id", limit)


def final_results(short: DataFrame, verifier: Verifier | None, top_k: int = TOP_K) -> DataFrame:
    """(plan_id, paper_id, verdict, final_score, verdict_rank); without a verifier all are satisfied."""
    if verifier is None:
        judged = short.withColumn("verdict", F.lit("satisfied")).withColumn("final_score", F.col("pre_score"))
    else:
        confidence = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("confidence")))
        judged = verifier(short).withColumn("final_score", confidence + 0.05 * F.col("coarse"))
    return verdict_top(judged, ["plan_id"], "final_score", "paper_id", top_k)


def identity_plan(plan: Plan) -> Plan:
    """Profile without a planner: the global query only."""
    return Plan(plan.queries.where("kind = 'global'"), plan.terms.where(F.lit(False)), plan.buckets.where(F.lit(False)))


@dataclass
class Stages:
    """What a search decides on its way; narrowed is null where a profile leaves that out."""

    pool: DataFrame
    narrowed: DataFrame | None
    evidence: DataFrame
    short: DataFrame


def run_stages(plan: Plan, index: Index, allowed: DataFrame, models: Models, profile: str = "full") -> Stages:
    """All stages before the final verdicts, each laid down."""
    if profile == "no_planner":
        plan = identity_plan(plan)
    plan = Plan(cut(plan.queries), cut(plan.terms), cut(plan.buckets))
    index = encoded(index, models, plan)
    pool = cut(candidates(plan, index, allowed, models))
    if profile == "no_content_refinement":
        n = R.normalise(pool, ["plan_id"], "coarse", "pre_score")
        short = R.rank_within(n.select("plan_id", "paper_id", "coarse", "pre_score"), ["plan_id"], "pre_score", "paper_id", SHORTLIST)
        return Stages(pool, None, global_evidence(plan, index, pool, models), short)
    narrowed = cut(narrow_sections(plan, index, pool, models))
    evidence = cut(assemble_evidence(plan, index, narrowed, models))
    # laid down before a verifier that may call out: a retried task repeats no call before it
    return Stages(pool, narrowed, evidence, cut(shortlist(plan, pool, narrowed, evidence)))


def search(plan: Plan, index: Index, allowed: DataFrame, models: Models | None = None, profile: str = "full", top_k: int = TOP_K) -> DataFrame:
    """Final results of every plan. Profiles: full, no_planner, no_content_refinement, no_verifier."""
    models = models or Models()
    short = run_stages(plan, index, allowed, models, profile).short
    return final_results(short, None if profile == "no_verifier" else models.verifier, top_k)


def display_order(results: DataFrame, display_k: int) -> DataFrame:
    w = Window.partitionBy("plan_id").orderBy(F.when(F.col("verdict") == "satisfied", 0).otherwise(1), "verdict_rank")
    return results.where(F.col("verdict") != "rejected").withColumn("display_rank", F.row_number().over(w)).where(F.col("display_rank") <= display_k)


def make_index(papers: DataFrame, sections: DataFrame, chunks: DataFrame) -> Index:
    """Search texts of the three levels from the record tables; one row per id.

    A paper's holds its section headings, an introduction and the evidence types of its chunks as well, a section's
    its path and summary, a chunk's its section's path and its evidence types.
    """
    p = latest(papers.select("paper_id", "corpus_key", "title", "abstract", "keywords", "ingested_at"), "paper_id", "ingested_at")
    ordinal = F.col("ordinal") if "ordinal" in sections.columns else F.lit(0).alias("ordinal")
    s = latest(sections.select("section_id", "paper_id", "section_title", "section_path", ordinal, "text", "ingested_at"), "section_id", "ingested_at")
    c = latest(chunks.select("chunk_id", "section_id", "paper_id", "chunk_type", "heading", "text", "ingested_at"), "chunk_id", "ingested_at").drop("ingested_at")
    path = F.array_join("section_path", " ")
    s_text = P.section_text("section_title", "section_path", T.truncate(T.squash("text"), 900), "text")
    of_section = s.select("section_id", path.alias("path"))
    c = c.join(of_section, "section_id", "left").withColumn("types", T.evidence_types(T.evidence_scores("heading", "path", "text")))
    c_text = P.chunk_text("heading", F.col("path"), "text", F.col("types"))
    counts = c.select("paper_id", F.explode("types").alias("type")).groupBy("paper_id", "type").agg(F.count("*").alias("n"))
    counts = counts.groupBy("paper_id").agg(F.map_from_entries(F.collect_list(F.struct("type", "n"))).alias("counts"))
    headings = s.groupBy("paper_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "section_id", "section_title"))), lambda x: x["section_title"]).alias("headings"))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))
    full = p.join(headings, "paper_id", "left").join(P.intro_summaries(p, s), "paper_id", "left").join(counts, "paper_id", "left")
    p_text = P.paper_text("title", "abstract", "headings", "intro_summary", "keywords", F.coalesce("counts", none))
    return Index(
        full.select("paper_id", "corpus_key", p_text.alias("search_text")),
        s.select("section_id", "paper_id", s_text.alias("search_text"), T.match_text(s_text).alias("match_text")),
        c.select("chunk_id", "section_id", "paper_id", "chunk_type", "heading", "text", c_text.alias("search_text")),
    )
