"""Scopes, verdicts, metrics, question answering, store, corpus statistics and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators import evaluation as E
from folioscope.operators import qa as QA
from folioscope.operators import records as O
from folioscope.operators import search as S
from folioscope.operators import selection as L
from folioscope.operators.ranking import rank_within
from folioscope.plans.common import sql_squash, table
from folioscope.runtime import scratch
from folioscope.sources import readers, sinks
from folioscope.streaming import jobs


def scope_semi_join(s: SparkSession, d: str) -> DataFrame:
    """Papers of the corpora of the last years, through the catalogue."""
    keys = readers.catalogue(table(s, d, "corpora")).where("year >= 2020").select("corpus_key")
    return table(s, d, "papers").select("paper_id", "corpus_key").distinct().join(keys, "corpus_key", "left_semi").select("paper_id", "corpus_key")


def scope_filter(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "papers").select("paper_id", "venue", "year", "track").distinct()
    return L.scope(p, years=[2018, 2019, 2020], tracks=["long", "short"])


def scope_intersection(s: SparkSession, d: str) -> DataFrame:
    p, h = table(s, d, "papers"), table(s, d, "header_results")
    return p.where("year >= 2015").select("paper_id").intersect(h.where("title IS NOT NULL").select("paper_id"))


def missing_ids(s: SparkSession, d: str) -> DataFrame:
    """Section ids that papers list and no section has."""
    listed = table(s, d, "papers").select(F.explode("section_ids").alias("section_id")).distinct()
    return listed.join(table(s, d, "sections").select("section_id"), "section_id", "left_anti")


def library_filter(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "papers").select("paper_id", "title", "authors").dropDuplicates(["paper_id"])
    return L.library_filter(p, "Catalys").select("paper_id", "title")


def catalogue(s: SparkSession, d: str) -> DataFrame:
    return readers.catalogue(table(s, d, "corpora")).select("corpus_key", "venue", "year", "track", "build_id")


def eligible_passages(s: SparkSession, d: str) -> DataFrame:
    return L.eligible_passages(table(s, d, "chunks"), table(s, d, "papers")).select("chunk_id", "paper_id").distinct()


def _verdicts(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders")
    v = F.when(F.col("o_orderstatus") == "F", "satisfied").when(F.col("o_orderstatus") == "O", "partial").otherwise("rejected")
    return o.select(F.col("o_orderpriority").alias("plan_id"), F.col("o_orderkey").alias("paper_id"), v.alias("verdict"), F.col("o_totalprice").alias("final_score"))


def verdict_topk(s: SparkSession, d: str) -> DataFrame:
    return L.verdict_top(_verdicts(s, d), ["plan_id"], "final_score", "paper_id", 10)


def display_fill(s: SparkSession, d: str) -> DataFrame:
    return L.display_fill(L.verdict_top(_verdicts(s, d), ["plan_id"], "final_score", "paper_id", 10), ["plan_id"], 15)


def evidence_trim(s: SparkSession, d: str) -> DataFrame:
    """Of each order the first line and the three dearest others."""
    li = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice").dropDuplicates(["l_orderkey", "l_linenumber"])
    return L.trim(li, ["l_orderkey"], F.col("l_linenumber") == 1, "l_extendedprice", "l_linenumber", 3).select("l_orderkey", "l_linenumber")


def best_query_per_item(s: SparkSession, d: str) -> DataFrame:
    li = table(s, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.round(F.sum(F.col("l_quantity") - 20), 2).alias("score"))
    return L.best_query(li, ["l_partkey"], "l_suppkey", "l_suppkey")


def history_window(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").withColumn("o", F.struct("ts", "event_id"))
    return L.last_turns(e, "user_id", "o", 5).select("user_id", "event_id")


def _ranks(s: SparkSession, d: str) -> DataFrame:
    """Displayed: the ten longest documents of a source and language; target: the one with the smallest id."""
    docs = table(s, d, "documents").fillna("none", ["source", "lang"]).fillna(0, ["n_chars"])
    docs = docs.select(F.concat_ws("/", "source", "lang").alias("query_id"), F.col("source").alias("topic"), F.col("doc_id").alias("paper_id"), "n_chars")
    shown = rank_within(docs, ["query_id"], "n_chars", "paper_id", 10).select("query_id", "paper_id", F.col("rank").alias("display_rank"))
    targets = docs.groupBy("query_id", "topic").agg(F.min("paper_id").alias("target"))
    return E.target_ranks(shown, targets)


def hit_mrr_rollup(s: SparkSession, d: str) -> DataFrame:
    m = E.metrics(_ranks(s, d))
    return m.select("topic", "n", *[F.round(c, 6).alias(c) for c in m.columns[2:]])


def target_rank(s: SparkSession, d: str) -> DataFrame:
    return _ranks(s, d).select("query_id", "target", "target_rank")


def target_bucket(s: SparkSession, d: str) -> DataFrame:
    top = L.verdict_top(_verdicts(s, d), ["plan_id"], "final_score", "paper_id", 10).select(F.col("plan_id").alias("query_id"), "paper_id", "verdict")
    best = table(s, d, "orders").groupBy(F.col("o_orderpriority").alias("query_id")).agg(F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("target"))
    return E.target_bucket(top, best)


def majority_vote(s: SparkSession, d: str) -> DataFrame:
    return E.majority(table(s, d, "lineitem").withColumn("vote", F.col("l_quantity") > 25), ["l_suppkey"], "vote")


def qrels_export(s: SparkSession, d: str) -> DataFrame:
    return E.qrels(_ranks(s, d).withColumn("query_id", F.replace("query_id", F.lit(" "), F.lit("_"))))


def _readings(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    return e.groupBy("user_id", F.col("event_type").alias("hypothesis_id"), F.date_format("ts", "HH").alias("evidence_id")).agg(F.round(F.sum(F.coalesce("value", F.lit(0.0))) / 100, 6).alias("score"))


def competition_margin(s: SparkSession, d: str) -> DataFrame:
    c = QA.competition_signal(_readings(s, d), "user_id")
    return c.select("user_id", "hypothesis_id", F.round("support", 6).alias("support"), F.round("margin_vs_next", 6).alias("margin_vs_next"))


def discriminative_evidence(s: SparkSession, d: str) -> DataFrame:
    return QA.competition_evidence(_readings(s, d), "user_id", "discriminative", 3).select("user_id", "hypothesis_id", "evidence_id", F.round("margin", 6).alias("margin"), "rank")


def conflicting_evidence(s: SparkSession, d: str) -> DataFrame:
    return QA.competition_evidence(_readings(s, d), "user_id", "conflicting", 3).select("user_id", "hypothesis_id", "evidence_id", F.round("margin", 6).alias("margin"), "rank")


def grounding_check(s: SparkSession, d: str) -> DataFrame:
    """Chunks that evidence units cite and their paper does not list."""
    cited = table(s, d, "evidence_units").select(F.col("paper_id").alias("hypothesis_id"), F.explode("chunk_ids").alias("evidence_id")).distinct()
    pack = table(s, d, "papers").select(F.col("paper_id").alias("hypothesis_id"), F.explode("chunk_ids").alias("evidence_id"))
    return QA.ungrounded(cited, pack)


def final_decisions(s: SparkSession, d: str) -> DataFrame:
    n = F.col("o_orderkey")
    pick = lambda k, *v: F.element_at(F.array(*[F.lit(x) for x in v]), (F.floor(n / k) % len(v) + 1).cast("int"))
    o = table(s, d, "orders").select(
        "o_orderkey",
        pick(1, "clear", "ambiguous", "incorrect").alias("interpretation_verdict"), pick(3, "clear_winner", "weak_winner", "no_clear_winner").alias("competition_verdict"),
        pick(5, "supported", "partially_supported", "unsupported").alias("support_verdict"), pick(7, "aligned", "partially_aligned", "misaligned").alias("alignment_verdict"),
    )
    return QA.decide(o).select("o_orderkey", "decision")


def build_counters(s: SparkSession, d: str) -> DataFrame:
    """Per corpus: papers, failed parses, backends, sections and chunks in one row."""
    p = O.latest(table(s, d, "papers").select("paper_id", "corpus_key", "text", "parser_backend", "section_ids", "chunk_ids", "ingested_at"), "paper_id", "ingested_at")
    size = lambda c: F.size(F.coalesce(c, F.array().cast("array<string>")))
    return p.groupBy("corpus_key").agg(
        F.count("*").alias("n_papers"), F.count_if(F.col("text").isNull()).alias("n_failed"), F.count_if(F.col("parser_backend").isNull()).alias("n_no_backend"),
        F.sum(size("section_ids")).alias("n_sections"), F.sum(size("chunk_ids")).alias("n_chunks"),
    )


def backend_histogram(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "papers").select("paper_id", "corpus_key", "parser_backend").distinct()
    return p.groupBy("corpus_key", F.coalesce("parser_backend", F.lit("none")).alias("backend")).agg(F.count("*").alias("n"))


def token_cost(s: SparkSession, d: str) -> DataFrame:
    """Sums keep SQL's null rule: all-null is null."""
    e = table(s, d, "events")
    return e.groupBy("user_id").agg(F.round(F.sum(F.when(F.col("event_type") == "purchase", F.col("value"))), 6).alias("cost"), F.count("*").alias("n"))


def vector_provenance(s: SparkSession, d: str) -> DataFrame:
    """Encoders and dimensions of each bundle, and whether they are one."""
    v = table(s, d, "index_vectors")
    return v.groupBy("bundle").agg(F.countDistinct("encoder_model").alias("n_encoders"), F.countDistinct(F.size("vector")).alias("n_dims"), F.count_if(F.size("vector") != F.col("vector_dim")).alias("n_mismatched"), F.count_if(F.col("vector").isNull()).alias("n_null"))


def merged_bundles(s: SparkSession, d: str) -> DataFrame:
    """Index bundles merged keep-first by item."""
    v = table(s, d, "index_vectors").select("bundle", "item_id", "corpus_key", "encoder_model", F.date_format("built_at", "yyyy-MM-dd HH:mm:ss").alias("built"))
    return O.keep_first(v, ["bundle", "item_id"], "built")


def release_fingerprints(s: SparkSession, d: str) -> DataFrame:
    return sinks.fingerprint(table(s, d, "papers").select("corpus_key", "paper_id", "title", "year").distinct(), ["corpus_key"], ["paper_id", "title", "year"])


def bibtex_export(s: SparkSession, d: str) -> DataFrame:
    p = O.latest(table(s, d, "papers").select("paper_id", "title", "authors", "venue", "year", "doi", "url", "abstract", "ingested_at"), "paper_id", "ingested_at")
    return sinks.bibtex(p)


def ris_export(s: SparkSession, d: str) -> DataFrame:
    p = O.latest(table(s, d, "papers").select("paper_id", "title", "authors", "venue", "year", "doi", "url", "abstract", "ingested_at"), "paper_id", "ingested_at")
    return sinks.ris(p)


def late_papers(s: SparkSession, d: str) -> DataFrame:
    """Papers ingested after their corpus was built, per corpus and month."""
    c = table(s, d, "corpora").select("corpus_key", "built_at")
    p = table(s, d, "papers").groupBy("paper_id", "corpus_key").agg(F.min("ingested_at").alias("first_in")).join(c, "corpus_key")
    return p.where("first_in > built_at").groupBy("corpus_key", F.date_format("first_in", "yyyy-MM").alias("period")).agg(F.count("*").alias("n"))


def latest_progress(s: SparkSession, d: str) -> DataFrame:
    return jobs.latest_state(table(s, d, "events")).select("user_id", "last_event", "last_type", "n")


def retention(s: SparkSession, d: str) -> DataFrame:
    """Jobs whose last event is within half an hour of the newest event of all."""
    e = table(s, d, "events")
    newest = e.agg(F.max("ts").alias("t")).scalar()
    return jobs.latest_state(e).where(F.col("last_ts") >= newest - F.expr("INTERVAL 1800 SECONDS")).select("user_id", "last_event")


def hourly_activity(s: SparkSession, d: str) -> DataFrame:
    a = jobs.activity(table(s, d, "events"))
    return a.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


def user_sessions(s: SparkSession, d: str) -> DataFrame:
    x = jobs.sessions(table(s, d, "events"))
    return x.groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.max("n").alias("longest"))


def stream_ingest(s: SparkSession, d: str) -> DataFrame:
    """The event file as a stream into a table, twice: the second run finds nothing new."""
    root = scratch(s)
    for _ in range(2):
        jobs.ingest(jobs.event_stream(s, d), "event_id", f"{root}/events", f"{root}/checkpoint")
    return s.read.parquet(f"{root}/events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("n_ids"))


def _plan(s: SparkSession, d: str) -> S.Plan:
    """One plan a topic of the held-out items: the topic as global query, its longest questions as aspects, two buckets."""
    items = table(s, d, "eval_items")
    topics = items.select(F.col("topic").alias("plan_id")).distinct()
    glob = topics.select("plan_id", F.lit("global").alias("kind"), F.lit("global").alias("name"), F.col("plan_id").alias("query"), F.lit(1.0).alias("weight"))
    q = rank_within(items.where("kind = 'question'").select(F.col("topic").alias("plan_id"), "text", "item_id", F.length("text").alias("n")), ["plan_id"], "n", "item_id", 3)
    aspects = q.select("plan_id", F.lit("aspect").alias("kind"), F.concat(F.lit("a"), F.col("rank").cast("string")).alias("name"), F.col("text").alias("query"), F.lit(1 / 3).alias("weight"))
    words = (("b1", "reaction yield and conversion"), ("b2", "reference measured by loading"))
    parts = [topics.select("plan_id", F.lit("bucket").alias("kind"), F.lit(b).alias("name"), F.concat_ws(" ", "plan_id", F.lit(t)).alias("query"), F.lit(1.0).alias("weight")) for b, t in words]
    terms = topics.select("plan_id", F.lit("entity").alias("kind"), F.col("plan_id").alias("term")).unionByName(topics.select("plan_id", F.lit("phrase").alias("kind"), F.concat(F.col("plan_id"), F.lit(" step is")).alias("term")))
    bucket = lambda b, what, n: topics.select("plan_id", F.lit(b).alias("bucket_id"), F.lit(what).alias("description"), F.lit(n).alias("target"))
    buckets = bucket("b1", "evaluation result", 2).unionByName(bucket("b2", "background", 1))
    return S.Plan(glob.unionByName(aspects).unionByName(parts[0]).unionByName(parts[1]), terms, buckets)


def _search(s: SparkSession, d: str, profile: str) -> DataFrame:
    index = S.make_index(table(s, d, "papers"), table(s, d, "sections"), table(s, d, "chunks"))
    r = S.search(_plan(s, d), index, index.papers.select("paper_id"), profile=profile)
    return r.select("plan_id", "paper_id", "verdict", F.round("final_score", 6).alias("final_score"), "verdict_rank")


def search_full(s: SparkSession, d: str) -> DataFrame:
    return _search(s, d, "full")


def search_no_planner(s: SparkSession, d: str) -> DataFrame:
    return _search(s, d, "no_planner")


def search_no_content_refinement(s: SparkSession, d: str) -> DataFrame:
    return _search(s, d, "no_content_refinement")


def search_no_verifier(s: SparkSession, d: str) -> DataFrame:
    return _search(s, d, "no_verifier")


def _stages(s: SparkSession, d: str, profile: str = "full") -> S.Stages:
    index = S.make_index(table(s, d, "papers"), table(s, d, "sections"), table(s, d, "chunks"))
    return S.run_stages(_plan(s, d), index, index.papers.select("paper_id"), S.Models(), profile)


def search_candidates(s: SparkSession, d: str) -> DataFrame:
    return _stages(s, d).pool.select("plan_id", "paper_id", F.round("coarse", 6).alias("coarse"), "rank")


def search_sections(s: SparkSession, d: str) -> DataFrame:
    return _stages(s, d).narrowed.select("plan_id", "paper_id", "section_id", F.round("score", 6).alias("score"))


def search_evidence(s: SparkSession, d: str) -> DataFrame:
    return _stages(s, d).evidence.select("plan_id", "paper_id", "bucket_id", "chunk_id", "source_query", F.round("score", 6).alias("score"), "rank")


def search_unrefined_evidence(s: SparkSession, d: str) -> DataFrame:
    return _stages(s, d, "no_content_refinement").evidence.select("plan_id", "paper_id", "bucket_id", "chunk_id", "source_query", F.round("score", 6).alias("score"), "rank")


def author_front_matter(s: SparkSession, d: str) -> DataFrame:
    """Affiliation of every author of the extracted headers, names squashed, by position."""
    h = O.latest(table(s, d, "header_results").select("paper_id", "authors_structured", "extracted_at"), "paper_id", "extracted_at")
    a = h.select("paper_id", F.posexplode("authors_structured").alias("pos", "a"))
    return a.select("paper_id", "pos", T.squash("a.name").alias("name"), F.coalesce(F.nullif(T.squash("a.affiliation"), F.lit("")), F.lit("unknown")).alias("affiliation"))


QUERIES = {
    f.__name__: f
    for f in (
        scope_semi_join, scope_filter, scope_intersection, missing_ids, library_filter, catalogue, eligible_passages, verdict_topk, display_fill, evidence_trim, best_query_per_item, history_window,
        hit_mrr_rollup, target_rank, target_bucket, majority_vote, qrels_export, competition_margin, discriminative_evidence, conflicting_evidence, grounding_check, final_decisions, build_counters, backend_histogram,
        token_cost, vector_provenance, merged_bundles, release_fingerprints, bibtex_export, ris_export, late_papers, latest_progress, retention, hourly_activity, user_sessions, stream_ingest,
        search_full, search_no_planner, search_no_content_refinement, search_no_verifier, search_candidates, search_sections, search_evidence, search_unrefined_evidence, author_front_matter,
    )
}

_PAP = "(SELECT * FROM papers QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY ingested_at DESC) = 1)"
_VERD = "SELECT o_orderpriority AS plan_id, o_orderkey AS paper_id, CASE o_orderstatus WHEN 'F' THEN 'satisfied' WHEN 'O' THEN 'partial' ELSE 'rejected' END AS verdict, o_totalprice AS final_score FROM orders"
_VTOP = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY plan_id, verdict ORDER BY final_score DESC, paper_id) AS verdict_rank FROM ({_VERD})) WHERE verdict_rank <= 10"
_RANKS = """WITH d AS (SELECT coalesce(source, 'none') || '/' || coalesce(lang, 'none') AS query_id, coalesce(source, 'none') AS topic, doc_id, coalesce(n_chars, 0) AS n_chars FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n_chars DESC, doc_id) AS rk FROM d), t AS (SELECT query_id, topic, min(doc_id) AS target FROM d GROUP BY ALL),
ranks AS (SELECT t.query_id, t.topic, t.target, r.rk AS target_rank FROM t LEFT JOIN r ON r.query_id = t.query_id AND r.doc_id = t.target AND r.rk <= 10) """
_READ = "SELECT user_id, event_type AS hypothesis_id, strftime(ts, '%H') AS evidence_id, round(sum(coalesce(value, 0)) / 100, 6) AS score FROM events GROUP BY ALL"
_COMP = f"WITH r AS ({_READ}), c AS (SELECT a.*, greatest(coalesce((SELECT max(b.score) FROM r b WHERE b.user_id = a.user_id AND b.evidence_id = a.evidence_id AND b.hypothesis_id <> a.hypothesis_id), 0), 0) AS other FROM r a) "

ORACLE = {
    "scope_semi_join": "SELECT DISTINCT paper_id, corpus_key FROM papers WHERE corpus_key IN (SELECT corpus_key FROM corpora WHERE year >= 2020)",
    "scope_filter": "SELECT DISTINCT paper_id, venue, year, track FROM papers WHERE year IN (2018, 2019, 2020) AND lower(track) IN ('long', 'short')",
    "scope_intersection": "SELECT paper_id FROM papers WHERE year >= 2015 INTERSECT SELECT paper_id FROM header_results WHERE title IS NOT NULL",
    "missing_ids": "SELECT DISTINCT section_id FROM (SELECT unnest(section_ids) AS section_id FROM papers) WHERE section_id NOT IN (SELECT section_id FROM sections)",
    "library_filter": "SELECT DISTINCT paper_id, title FROM papers WHERE contains(lower(coalesce(title, '')), 'catalys') OR len(list_filter(coalesce(authors, []), lambda a: contains(lower(a), 'catalys'))) > 0",
    "catalogue": "SELECT corpus_key, split_part(corpus_key, '/', 1) AS venue, split_part(corpus_key, '/', 2)::INT AS year, split_part(corpus_key, '/', 3) AS track, build_id FROM corpora WHERE len(string_split(corpus_key, '/')) = 3",
    "eligible_passages": f"SELECT DISTINCT chunk_id, paper_id FROM chunks WHERE length({sql_squash('text')}) >= 20 AND paper_id IN (SELECT paper_id FROM papers)",
    "verdict_topk": _VTOP,
    "display_fill": f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY CASE verdict WHEN 'satisfied' THEN 0 ELSE 1 END, verdict_rank) AS display_rank FROM ({_VTOP}) WHERE verdict <> 'rejected') WHERE display_rank <= 15",
    "evidence_trim": "SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber = 1 ORDER BY l_extendedprice DESC, l_linenumber) AS r FROM (SELECT l_orderkey, l_linenumber, any_value(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY ALL)) WHERE l_linenumber = 1 OR r <= 3",
    "best_query_per_item": "SELECT l_partkey, max(score) AS score, arg_min(l_suppkey, (-score, l_suppkey)) AS l_suppkey FROM (SELECT l_partkey, l_suppkey, round(sum(l_quantity - 20), 2) AS score FROM lineitem GROUP BY ALL) WHERE score > 0 GROUP BY l_partkey",
    "history_window": "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5",
    "hit_mrr_rollup": _RANKS + "SELECT CASE WHEN grouping(topic) = 1 THEN 'all' ELSE topic END AS topic, count(*) AS n, " + ", ".join(f"round(avg(CASE WHEN target_rank <= {k} THEN 1.0 ELSE 0.0 END), 6) AS hit_at_{k}" for k in (1, 3, 5, 10)) + ", round(avg(coalesce(1.0 / target_rank, 0.0)), 6) AS mrr FROM ranks GROUP BY ROLLUP (topic)",
    "target_rank": _RANKS + "SELECT query_id, target, target_rank FROM ranks",
    "target_bucket": f"SELECT b.query_id, coalesce(v.verdict, 'not_returned') AS target_bucket FROM (SELECT o_orderpriority AS query_id, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS target FROM orders GROUP BY 1) b LEFT JOIN ({_VTOP}) v ON v.plan_id = b.query_id AND v.paper_id = b.target",
    "majority_vote": "SELECT l_suppkey, count(*) FILTER (l_quantity > 25) AS yes, count(l_quantity) AS n, count(*) FILTER (l_quantity > 25) * 2 >= count(l_quantity) AS accepted FROM lineitem GROUP BY l_suppkey",
    "qrels_export": _RANKS + "SELECT DISTINCT replace(query_id, ' ', '_') || ' 0 ' || target || ' 1' AS value FROM ranks",
    "competition_margin": f"WITH r AS ({_READ}), t AS (SELECT user_id, hypothesis_id, avg(score) AS support FROM (SELECT *, row_number() OVER (PARTITION BY user_id, hypothesis_id ORDER BY score DESC, evidence_id) AS k FROM r) WHERE k <= 3 GROUP BY ALL) SELECT user_id, hypothesis_id, round(support, 6) AS support, round(support - greatest(coalesce((SELECT max(b.support) FROM t b WHERE b.user_id = a.user_id AND b.hypothesis_id <> a.hypothesis_id), 0), 0), 6) AS margin_vs_next FROM t a",
    "discriminative_evidence": _COMP + "SELECT * FROM (SELECT user_id, hypothesis_id, evidence_id, round(score - other, 6) AS margin, row_number() OVER (PARTITION BY user_id, hypothesis_id ORDER BY score - other DESC, evidence_id) AS rank FROM c WHERE score > 0 AND score - other > 0.02) WHERE rank <= 3",
    "conflicting_evidence": _COMP + "SELECT * FROM (SELECT user_id, hypothesis_id, evidence_id, round(other - score, 6) AS margin, row_number() OVER (PARTITION BY user_id, hypothesis_id ORDER BY other - score DESC, evidence_id) AS rank FROM c WHERE other > 0 AND other - score > 0.02) WHERE rank <= 3",
    "grounding_check": "SELECT DISTINCT paper_id AS hypothesis_id, evidence_id FROM (SELECT paper_id, unnest(chunk_ids) AS evidence_id FROM evidence_units) e WHERE NOT EXISTS (SELECT 1 FROM papers p WHERE p.paper_id = e.paper_id AND list_contains(p.chunk_ids, e.evidence_id))",
    "final_decisions": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 OR o_orderkey // 3 % 3 = 2 THEN 'ask_clarification' WHEN o_orderkey // 5 % 3 = 2 OR o_orderkey // 7 % 3 = 2 THEN 'unsupported' WHEN o_orderkey // 5 % 3 = 1 OR o_orderkey // 7 % 3 = 1 OR o_orderkey // 3 % 3 = 1 THEN 'answer_with_note' ELSE 'answer' END AS decision FROM orders",
    "build_counters": f"SELECT corpus_key, count(*) AS n_papers, count(*) FILTER (text IS NULL) AS n_failed, count(*) FILTER (parser_backend IS NULL) AS n_no_backend, sum(len(coalesce(section_ids, [])))::BIGINT AS n_sections, sum(len(coalesce(chunk_ids, [])))::BIGINT AS n_chunks FROM {_PAP} GROUP BY corpus_key",
    "backend_histogram": "SELECT corpus_key, coalesce(parser_backend, 'none') AS backend, count(*) AS n FROM (SELECT DISTINCT paper_id, corpus_key, parser_backend FROM papers) GROUP BY ALL",
    "token_cost": "SELECT user_id, round(sum(CASE WHEN event_type = 'purchase' THEN value END), 6) AS cost, count(*) AS n FROM events GROUP BY user_id",
    "vector_provenance": "SELECT bundle, count(DISTINCT encoder_model) AS n_encoders, count(DISTINCT len(vector)) AS n_dims, count(*) FILTER (len(vector) <> vector_dim) AS n_mismatched, count(*) FILTER (vector IS NULL) AS n_null FROM index_vectors GROUP BY bundle",
    "merged_bundles": "SELECT bundle, item_id, corpus_key, encoder_model, strftime(built_at, '%Y-%m-%d %H:%M:%S') AS built FROM index_vectors QUALIFY row_number() OVER (PARTITION BY bundle, item_id ORDER BY built_at) = 1",
    "late_papers": "SELECT corpus_key, strftime(first_in, '%Y-%m') AS period, count(*) AS n FROM (SELECT paper_id, corpus_key, min(ingested_at) AS first_in FROM papers GROUP BY ALL) JOIN corpora USING (corpus_key) WHERE first_in > built_at GROUP BY ALL",
    "latest_progress": "SELECT user_id, arg_max(event_id, (ts, event_id)) AS last_event, arg_max(event_type, (ts, event_id)) AS last_type, count(*) AS n FROM events GROUP BY user_id",
    "retention": "SELECT user_id, arg_max(event_id, (ts, event_id)) AS last_event FROM events GROUP BY user_id HAVING max(ts) >= (SELECT max(ts) FROM events) - INTERVAL 1800 SECOND",
    "hourly_activity": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "user_sessions": "WITH g AS (SELECT user_id, sum(CASE WHEN prev IS NULL OR ts >= prev + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sno FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM events)) SELECT user_id, count(*) AS n_sessions, max(n) AS longest FROM (SELECT user_id, sno, count(*) AS n FROM g GROUP BY ALL) GROUP BY user_id",
    "stream_ingest": "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS n_ids FROM events GROUP BY event_type",
    "author_front_matter": f"SELECT paper_id, (pos - 1)::INT AS pos, {sql_squash('a.name')} AS name, coalesce(nullif({sql_squash('a.affiliation')}, ''), 'unknown') AS affiliation FROM (SELECT paper_id, unnest(authors_structured) AS a, generate_subscripts(authors_structured, 1) AS pos FROM (SELECT * FROM header_results QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY extracted_at DESC) = 1))",
}
